"""Personal information inside free text (problem 7).

Bootstrapped contextual extraction.  One pass over the texts finds candidates
by loose form (something like an address with an at, a number, a number beside
capitalised words, a name) with the words before them.  Seeds are the few
candidates that are certain: an e-mail address in plain form, a listed given
name before a capitalised word, a number in international form or after one of
a handful of captions, a house number and a listed street word before a
postcode or flat.  From there Spark scores the
graph of patterns (context before, shape, given name or street word) and
instances in turns: a pattern is as good as the instances it holds, an instance
as good as its patterns.  Good patterns then bring in identifiers that no seed
knew: addresses that are written out, captions in other languages, shapes
without a caption, names and street words not in the lists.

The graph is aggregated to distinct (context, shape, word) combinations with
counts before the first turn, so its size follows the variety of contexts and
not the rows.  Nothing is collected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.plans.lineage import cut_lineage, spread

TYPES = ("email", "phone", "id_number", "street_address", "person_name")

# -- candidate forms ---------------------------------------------------------------

_AT = r"(?:\s?@\s?|\s?[\[({]\s?at\s?[\])}]\s?)"
_DOT = r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?)"
_EMAIL = re.compile(rf"(?<![\w.+@-])\w[\w.+%-]*{_AT}\w[\w-]*(?:{_DOT}\w[\w-]*)*{_DOT}[a-z]{{2,}}(?![\w@-])", re.IGNORECASE)

_NUMBER = re.compile(
    r"(?<![\w@#+.,/\-])(?:"
    r"(?:\+\s?)?(?:\(\d{1,5}\)\s?)?\d+(?:[ .\-/]\d+|\s?\(\d{1,4}\)\s?\d+|-?[A-Z](?![\w-]))*"
    r"|[A-Z]{2} \d\d \d\d \d\d ?[A-Z]|[A-Z]{1,3}-?\d+(?:[ .-]\d+)*(?:[ -]?[A-Z])?)(?![\w@]|[-/.]\w)"
)

_UP = r"[A-ZÀ-ÖØ-ÞŒŠŽĀ-ŐА-ЯЁ]"
_CAP = rf"{_UP}[\w'’]+"
_PARTICLE = r"(?:van der|van den|van|von|de la|de|del|da|do|dos|di|du|le|ter)"
_FAMILY = rf"{_CAP}(?:-{_CAP})*"
_NAME = re.compile(
    rf"(?<![\w@.'’-])(?=((?:{_CAP}(?:-{_CAP})?|{_UP}\.) (?:{_UP}\. )?(?:{_PARTICLE} )?{_FAMILY}|{_FAMILY}, {_CAP})(?![\w@'’]|-\w))"
)

# Words that make a street of the words beside them.
_STREET_LAST = r"(?:Street|St\.|Road|Rd\.|Lane|Ln\.|Avenue|Ave\.|Drive|Way|Square|Terrace)"
_STREET_FIRST = (
    r"(?:Calle|Avenida|Av\.|Plaza|Paseo|Rua|Travessa|Praça|Via|Viale|Piazza|Corso|rue|avenue|boulevard|place|chemin|ул\.|улица|проспект)"
)
_STREET_TAIL = r"(?:weg|straße|strasse|str\.|gasse|allee|platz|straat|laan|plein|gracht|kade)"
_HOUSE = r"\d{1,4}(?: ?[a-z](?!\w))?"
_LINK = r"(?:des|de la|de los|de|del|du|da|do|dos|della|di|la|le)"
_ADDRESS = re.compile(
    rf"(?<![\w#/.-]){_HOUSE}(?: (?:bis|ter|quater))?,? (?:{_CAP} ){{1,3}}{_STREET_LAST}(?!\w)"
    rf"|(?<![\w#/.-]){_HOUSE}(?: (?:bis|ter|quater))?,? {_STREET_FIRST} (?:{_LINK} )?{_CAP}(?: {_CAP}(?= *[,.;]))?"
    rf"|(?<!\w){_STREET_FIRST} (?:{_LINK} )?{_CAP},? {_HOUSE}(?!\w)"
    rf"|(?<![\w-])(?:{_CAP}[- ])?{_UP}\w+(?:{_STREET_TAIL}| (?:Str\.|Straße|Weg|Platz|Allee|Gasse|Laan|Straat)),? {_HOUSE}(?!\w)"
)
_STREET_WORD = re.compile(rf"{_STREET_LAST}|{_STREET_FIRST}|{_STREET_TAIL}|Str\.|Straße|Weg", re.IGNORECASE)

# a house number beside capitalised words, whatever they are
_LOOSE = re.compile(
    rf"(?<![\w#/.,-]){_HOUSE} (?:{_CAP} ){{1,2}}{_CAP}(?![\w@'’])|(?<![\w.'’-])(?:{_CAP} ){{0,2}}{_CAP} {_HOUSE}(?![\w@/:-]|[.,]\d| ?\d)"
)
_AFTER_ADDRESS = re.compile(r"[,\n] ?(?:flat |apt\.? |apartment )?(?:\d|[A-Z]{1,2}\d)")

# Captions whose numbers are seeds of the type; forms of address.
_ID_SEEDS = re.compile(r"(?:passport|tax id|social security|national insurance|personal id|\bdni\b)[^\d\n.]{0,14}(?:\bno\.[:( ]*)?$", re.IGNORECASE)
_TITLES = frozenset("mr mrs ms dr prof mme m mlle sr sra srta frau herr herrn dhr mevr sig dott dear sehr geehrte".split())


def _context(text: str, start: int) -> tuple[str, bool]:
    """The two words before a place, case and digits levelled; whether a sentence or line starts there."""
    before = text[max(0, start - 48) : start]
    line = before.rsplit("\n", 1)[-1]
    bracket = line.endswith("(")
    words = line.rstrip("( ").lower().split()[-2:]
    opens = not words or (not bracket and words[-1][-1] in ".!?…" and words[-1].rstrip(".") not in _TITLES and words[-1] not in ("no.", "tel.", "nr."))
    if opens and not bracket:
        return "<start>", True
    if len(words) == 2 and words[0][-1] in ".!?…" and words[0].rstrip(".") not in _TITLES:
        words = words[1:]
    key = re.sub(r"\d", "0", " ".join(w.strip(":;,") or w for w in words))
    if words and words[-1] in ("©", "→", "☎", "@:"):
        key = words[-1]
    return ("( " if bracket else "") + key, False


def _shape(text: str) -> str:
    return re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", text))


def candidates(text: str, given: frozenset[str]) -> list[tuple[str, int, int, str, str, str, str | None]]:
    """(kind, start, end, context, shape, word, seed type) of everything that may be personal."""
    out = []
    taken: list[tuple[int, int]] = []
    for m in _EMAIL.finditer(text):
        context, _ = _context(text, m.start())
        shape = re.sub(r"[\w.+%-]+", "w", m.group())
        out.append(("email", m.start(), m.end(), context, shape, "", "email" if shape == "w@w" else None))
        taken.append(m.span())
    for m in _ADDRESS.finditer(text):
        a, b = m.span()
        if any(a < y and b > x for x, y in taken):
            continue
        context, _ = _context(text, a)
        word = _STREET_WORD.search(m.group()).group().lower().rstrip(".")
        shape = re.sub(r"\d+ ?[a-z]?\b", "0", re.sub(r"[^\W\d]\w*\.?", "w", m.group()))
        out.append(("address", a, b, context, shape, word, "street_address" if _AFTER_ADDRESS.match(text, b) else None))
        taken.append((a, b))
    for m in _LOOSE.finditer(text):
        a, b = m.span()
        context, opens = _context(text, a)
        if opens or any(a < y and b > x for x, y in taken):
            continue
        words = m.group().split()
        word = words[-1] if words[0][0].isdigit() else words[0] if len(words) > 2 else words[0][-4:]
        out.append(("loose", a, b, context, "loose", word.lower(), None))
    for m in _NUMBER.finditer(text):
        a, b = m.span()
        own = m.group()
        if sum(c.isdigit() for c in own) < 6 or any(a < y and b > x for x, y in taken):
            continue
        context, opens = _context(text, a)
        seed = None
        if own[0] == "+" and sum(c.isdigit() for c in own) >= 8:
            seed = "phone"
        elif not opens and _ID_SEEDS.search(text[max(0, a - 40) : a]):
            seed = "id_number"
        out.append(("number", a, b, context, _shape(own), "", seed))
    for m in _NAME.finditer(text):
        a, b = m.span(1)
        own = m.group(1)
        if any(a < y and b > x for x, y in taken) or _STREET_WORD.fullmatch(own.split()[-1]):
            continue
        words = own.split()
        if words[0].lower().rstrip(".,") in _TITLES:
            continue
        comma = words[-2].endswith(",") if len(words) > 1 else False
        first = words[-1] if comma else words[0]
        form = "family, given" if comma else "initial" if words[0].endswith(".") else "given family"
        context, opens = _context(text, a)
        if context.startswith("( ") or context == "(":
            if not text[b:].startswith(")"):
                continue
            context = "( )"
        if comma and (opens or text[max(0, a - 2) : a].rstrip().endswith(",")):
            continue  # a list of words, not a name
        listed = first.lower() in given
        other = words[0].rstrip(",") if comma else words[-1]
        if comma and other.lower() in given:
            continue
        seed = "person_name" if listed and other.lower() not in given and not opens else None
        out.append(("name", a, b, context, form, first.lower(), seed))
    return out


_CANDIDATE = "kind string, start int, end int, pii_text string, context string, shape string, word string, seed string"


def find_candidates(df: DataFrame, given_names: DataFrame, id_col: str = "page_id", text_col: str = "content", most_names: int = 1_000_000) -> DataFrame:
    """One row for each candidate of each text: offsets in code points, patterns and seed type.

    More than ``most_names`` given names are a ValueError.
    """
    listed = given_names.select(F.lower("given_name")).where("given_name is not null").distinct().limit(most_names + 1).collect()
    if len(listed) > most_names:
        raise ValueError(f"over {most_names} given names; they are held by every worker")
    given = frozenset(r[0] for r in listed)
    names = [id_col, "kind", "start", "end", "pii_text", "context", "shape", "word", "seed"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (key, kind, a, b, text[a:b], context, shape, word, seed)
                for key, text in zip(batch[id_col], batch["__text"])
                if isinstance(text, str) and text
                for kind, a, b, context, shape, word, seed in candidates(text, given)
            ]
            yield pd.DataFrame(rows, columns=names)

    narrow = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    id_type = df.schema[id_col].dataType.simpleString()
    return spread(narrow).mapInPandas(run, f"`{id_col}` {id_type}, {_CANDIDATE}")


# -- the graph ---------------------------------------------------------------------

_SCORES = ("email", "phone", "id_number", "person_name", "street_address")


def _mean(score: str, over: list[str], graph: DataFrame) -> DataFrame:
    """How good each pattern is: the mean of its instances, unknown ones at a lower weight.

    Half an instance of doubt keeps a pattern of one instance below certainty.
    """
    weight = F.when(F.col(score) > 0, 1.0).otherwise(0.35) * F.col("n")
    held = [F.sum("n").alias("held")] if over[-1] == "context" else []
    return graph.groupBy(*over).agg((F.sum(F.col(score) * F.col("n")) / (F.sum(weight) + 0.5)).alias(f"by_{over[-1]}"), *held)


def score_patterns(found: DataFrame, rounds: int = 3) -> DataFrame:
    """Scores from 0 to 1 for every distinct (kind, context, shape, word), by mutual reinforcement.

    Columns: the four keys, ``pii_type`` and ``score``.  Contexts that only say
    that a sentence starts carry no evidence.
    """
    graph = found.withColumn("kind", F.when(F.col("kind") == "loose", "address").otherwise(F.col("kind"))).groupBy("kind", "context", "shape", "word").agg(
        F.count("*").alias("n"), *[F.sum((F.col("seed") == t).cast("double")).alias(f"seeds_{t}") for t in _SCORES]
    )
    types = {"number": ("phone", "id_number"), "name": ("person_name",), "address": ("street_address",), "email": ("email",)}
    stacked = None
    for kind, own in types.items():
        for t in own:
            part = graph.where(F.col("kind") == kind).select(
                "kind", "context", "shape", "word", "n", F.lit(t).alias("pii_type"), (F.coalesce(F.col(f"seeds_{t}"), F.lit(0.0)) / F.col("n")).alias("seeded")
            )
            stacked = part if stacked is None else stacked.unionByName(part)
    graph = cut_lineage(stacked.withColumn("score", F.col("seeded")))
    neutral = F.col("context") == "<start>"
    for turn in range(rounds):
        contexts = _mean("score", ["kind", "pii_type", "context"], graph.where(~neutral))
        # what stands in a telling context of no type speaks against its shape; a bare one says nothing
        shapes = _mean("score", ["kind", "pii_type", "shape"], graph.where(~neutral | (F.col("score") > 0)))
        words = _mean("score", ["kind", "pii_type", "word"], graph.where(~neutral | (F.col("score") > 0)))
        joined = (
            graph.join(contexts, ["kind", "pii_type", "context"], "left")
            .join(shapes, ["kind", "pii_type", "shape"], "left")
            .join(words, ["kind", "pii_type", "word"], "left")
        )
        c, s, w = (F.coalesce(F.col(f"by_{x}"), F.lit(0.0)) for x in ("context", "shape", "word"))
        number = F.when(neutral, s * 0.95).otherwise(F.greatest(c, s * 0.9))
        name = F.when(F.col("shape") == "given family", F.greatest(c, F.when(neutral, w * 0.6).otherwise(F.least(w, c + 0.3)))).otherwise(c)
        # a street word in a context that often holds house numbers but no addresses is none
        listed = F.when(neutral, w * 0.9).otherwise(F.greatest(c, F.least(w, s) * F.when(F.coalesce(F.col("held"), F.lit(0)) * (1 - c) >= 20, 0.4).otherwise(0.9)))
        address = F.when(F.col("shape") == "loose", F.greatest(c * 0.7, F.least(w * 0.9, c + 0.5))).otherwise(listed)
        fresh = F.when(F.col("kind").isin("number", "email"), number).when(F.col("kind") == "name", name).otherwise(address)
        graph = joined.select("kind", "context", "shape", "word", "n", "pii_type", "seeded", F.least(F.lit(1.0), F.greatest("seeded", fresh)).alias("score"))
        if turn < rounds - 1:
            graph = cut_lineage(graph)
    return graph.select("kind", "context", "shape", "word", "pii_type", "score")


LEAST_SCORE = 0.4


def find_pii(
    df: DataFrame,
    given_names: DataFrame,
    id_col: str = "page_id",
    text_col: str = "content",
    least: float = LEAST_SCORE,
    rounds: int = 3,
) -> DataFrame:
    """``(id, pii_type, pii_text, start, end, score)`` of every accepted item.

    Items of one text never overlap: the better score wins, then the longer
    item, then the first.  Null and empty texts have no items; a repeated row
    repeats its items.
    """
    found = cut_lineage(find_candidates(df, given_names, id_col, text_col))
    best = (
        score_patterns(found, rounds)
        .where(F.col("score") >= least)
        .groupBy("kind", "context", "shape", "word")
        .agg(F.max(F.struct("score", "pii_type")).alias("best"))
        .select("kind", "context", "shape", "word", "best.score", "best.pii_type")
    )
    named = found.withColumn("kind", F.when(F.col("kind") == "loose", "address").otherwise(F.col("kind")))
    items = named.join(best, ["kind", "context", "shape", "word"]).select(id_col, "pii_type", "pii_text", "start", "end", "score")
    by_text = items.distinct().groupBy(id_col).agg(F.collect_list(F.struct("start", "end", "score", "pii_type", "pii_text")).alias("all"))
    return by_text.select(id_col, F.explode(_without_overlaps(F.col("all"))).alias("x")).select(
        id_col, "x.pii_type", "x.pii_text", "x.start", "x.end", "x.score"
    )


def _without_overlaps(items: Column) -> Column:
    """Of overlapping items the best: each is dropped for a better one that it touches."""
    better = lambda a, b: (
        (b["score"] > a["score"])
        | ((b["score"] == a["score"]) & (b["end"] - b["start"] > a["end"] - a["start"]))
        | ((b["score"] == a["score"]) & (b["end"] - b["start"] == a["end"] - a["start"]) & (b["start"] < a["start"]))
    )
    return F.filter(
        items, lambda a: ~F.exists(items, lambda b: (b["start"] < a["end"]) & (b["end"] > a["start"]) & better(a, b))
    )


def mask_pii(df: DataFrame, items: DataFrame, id_col: str = "page_id", text_col: str = "content", masked_col: str = "masked") -> DataFrame:
    """``df`` with ``masked_col``: each item replaced by ``[TYPE]``, the rest unchanged.

    Null texts stay null; ids and texts without items keep their text.
    """
    spans = items.select(id_col, "start", "end", "pii_type").distinct().groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "pii_type"))).alias("__spans")
    )
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    text = F.col(f"`{text_col}`")
    folded = F.aggregate(
        "__spans",
        start,
        lambda acc, s: F.struct(
            F.concat(acc["text"], text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["pii_type"]), F.lit("]")).alias("text"),
            s["end"].alias("at"),
        ),
        lambda acc: F.concat(acc["text"], text.substr(acc["at"] + 1, F.length(text))),
    )
    return df.join(spans, id_col, "left").withColumn(masked_col, F.when(F.col("__spans").isNull(), text).otherwise(folded)).drop("__spans")
