"""Language of documents and of the stretches of mixed documents (problem 6).

Nearest-centroid classification.  A stretch of text (a sentence or a line) is
a TF-IDF vector of character n-grams taken inside words, word borders included,
plus the words themselves; it is compared by cosine with several centroids per
language, which a spherical k-means finds among labelled sentences.  A stretch
that is too far from every centroid, or about as close to a second language, is
rejected and gets no language.

The dot products of a word with all centroids are the same wherever the word
occurs, so a worker remembers them per word and a stretch costs one sum over
its words.  The length of a stretch's vector is taken over its words, as if
n-grams of two words were never the same.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.plans.lineage import spread

# ISO 639 codes and names of the eight languages, as labels spell them.
LABEL_NAMES = {
    "en": ("en", "eng", "english", "englisch", "anglais", "inglés", "ingles", "inglês", "inglese", "engels", "английский"),
    "de": ("de", "deu", "ger", "german", "deutsch", "allemand", "alemán", "aleman", "alemão", "tedesco", "duits", "немецкий"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais", "französisch", "francés", "francês", "francese", "frans", "французский"),
    "es": ("es", "spa", "spanish", "español", "espanol", "spanisch", "castellano", "espagnol", "espanhol", "spagnolo", "spaans", "испанский"),
    "pt": ("pt", "por", "portuguese", "português", "portugues", "portugiesisch", "portugais", "portugués", "portoghese", "portugees", "португальский"),
    "it": ("it", "ita", "italian", "italiano", "italienisch", "italien", "italiaans", "итальянский"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands", "niederländisch", "néerlandais", "holandés", "holandês", "olandese", "нидерландский"),
    "ru": ("ru", "rus", "russian", "русский", "russisch", "russe", "ruso", "russo"),
}
_CODE_OF = {name: code for code, names in LABEL_NAMES.items() for name in names}


def label_code(label: Column) -> Column:
    """The two-letter code that a label names in any spelling, else null.

    Blanks around and case do not count; of ``en_GB`` or ``pt-BR`` the part
    before the region does.
    """
    plain = F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))
    head = F.regexp_extract(plain, r"^(\p{L}+)(?:[-_].*)?$", 1)
    table = F.create_map(*[F.lit(x) for pair in sorted(_CODE_OF.items()) for x in pair])
    return F.try_element_at(table, head)


# -- stretches ----------------------------------------------------------------

_STRETCH = re.compile(r"\n+|(?<=[.!?…])[\"'”’»)\]]*\s+")
_QUOTED = re.compile(r"«[^»]*»|“[^”]*”|„[^“”]*[“”]|\"[^\"]*\"|`[^`]*`|<[^<>]*>|\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}")
_LINK = re.compile(r"\S*[@/\\=#]\S*|\S+\.\S+[^\s.!?…]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_END = re.compile(r"[.!?…][\"'”’»)\]]*\s*$")


def stretches(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence or line that is not blank."""
    out, start = [], 0
    for cut in _STRETCH.finditer(text):
        out.append((start, cut.start() if text[cut.start()].isspace() else cut.end()))
        start = cut.end()
    out.append((start, len(text)))
    return [(a, b) for a, b in out if text[a:b].strip()]


def _grams(word: str) -> list[str]:
    padded = f"_{word}_"
    n = len(padded)
    out = [padded[i : i + size] for size in (2, 3, 4) for i in range(n - size + 1)]
    out.append(f"={word}")
    return out


class LanguageModel:
    """Centroids of TF-IDF vectors; fitted on the driver from labelled texts."""

    def __init__(self, languages: list[str], grams: dict[str, int], weights: np.ndarray, idf: np.ndarray, unseen: float) -> None:
        self.languages = languages
        self.grams = grams
        self.weights = weights  # (grams, languages * centroids): idf times centroid
        self.idf2 = idf**2
        self.unseen2 = unseen**2

    @classmethod
    def fit(
        cls, bags: Sequence[list[str]], labels: Sequence[str], centroids: int = 4, rounds: int = 10, least_df: int = 1, seed: int = 7
    ) -> LanguageModel:
        """Centroids from labelled bags of words; n-grams in fewer than ``least_df`` bags are left out."""
        counts = [Counter(g for w in bag for g in _grams(w)) for bag in bags]
        df = Counter(g for bag in counts for g in bag)
        grams = {g: i for i, g in enumerate(sorted(g for g, n in df.items() if n >= least_df))}
        n = len(bags)
        idf = np.array([np.log((1 + n) / (1 + df[g])) + 1 for g in grams], dtype=np.float64)
        unseen = float(np.log(1.0 + n) + 1)
        languages = sorted(set(labels))
        rng = np.random.default_rng(seed)
        matrix = np.zeros((len(grams), len(languages) * centroids))
        for k, language in enumerate(languages):
            own = [[(grams[g], m) for g, m in bag.items() if g in grams] for bag, label in zip(counts, labels) if label == language]
            own = [bag for bag in own if bag]
            sizes = np.array([len(bag) for bag in own])
            starts = np.cumsum(sizes) - sizes
            gram = np.array([g for bag in own for g, _ in bag])
            value = np.array([m for bag in own for _, m in bag]) * idf[gram]
            value /= np.repeat(np.sqrt(np.add.reduceat(value**2, starts)), sizes)
            row = np.repeat(np.arange(len(own)), sizes)
            whole = np.bincount(gram, weights=value, minlength=len(grams)) / len(own)
            near = rng.integers(0, centroids, len(own))
            for _ in range(rounds):
                c = np.stack([np.bincount(gram, weights=value * (near == j)[row], minlength=len(grams)) for j in range(centroids)])
                c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
                near = np.argmax(np.stack([np.add.reduceat(value * c[j][gram], starts) for j in range(centroids)]), axis=0)
            c += whole / np.linalg.norm(whole)  # what the whole language shares keeps weight in each centroid
            matrix[:, k * centroids : (k + 1) * centroids] = (c / np.linalg.norm(c, axis=1, keepdims=True)).T
        return cls(languages, grams, (matrix * idf[:, None]).astype(np.float32), idf.astype(np.float32), unseen)

    def _vector(self, word: str) -> np.ndarray:
        """Dot products of a word with all centroids, then its squared length."""
        known = [i for g in _grams(word) if (i := self.grams.get(g)) is not None]
        unknown = max(len(word) * 3 - 2, 1) + 1 - len(known)
        out = np.empty(self.weights.shape[1] + 1, dtype=np.float32)
        out[:-1] = self.weights[known].sum(0) if known else 0
        out[-1] = self.idf2[known].sum() + max(unknown, 0) * self.unseen2
        return out

    def scorer(self, cache_size: int = 300_000) -> Scorer:
        return Scorer(self, cache_size)


class Scorer:
    """Scores stretches, remembering the vectors of at most ``cache_size`` words."""

    def __init__(self, model: LanguageModel, cache_size: int) -> None:
        self.model = model
        self.size = cache_size
        self._reset()

    def _reset(self) -> None:
        self.row_of: dict[str, int] = {}
        self.rows = np.zeros((4096, self.model.weights.shape[1] + 1), dtype=np.float32)

    def cosines(self, bags: list[list[str]]) -> np.ndarray:
        """(stretches, languages): the cosine with each language's nearest centroid."""
        languages = len(self.model.languages)
        flat = [w for bag in bags for w in bag]
        if not flat:
            return np.zeros((len(bags), languages), dtype=np.float32)
        new = set(flat) - self.row_of.keys()
        if len(self.row_of) + len(new) > self.size:
            self._reset()
            new = set(flat)
        base = len(self.row_of)
        if base + len(new) > len(self.rows):
            grown = np.zeros((max(2 * len(self.rows), base + len(new)), self.rows.shape[1]), dtype=np.float32)
            grown[:base] = self.rows[:base]
            self.rows = grown
        for w in new:
            self.rows[len(self.row_of)] = self.model._vector(w)
            self.row_of[w] = len(self.row_of)
        index = np.fromiter(map(self.row_of.__getitem__, flat), dtype=np.int64, count=len(flat))
        lengths = np.fromiter(map(len, bags), dtype=np.int64, count=len(bags))
        filled = np.flatnonzero(lengths)
        sums = np.zeros((len(bags), self.rows.shape[1]), dtype=np.float32)
        starts = (np.cumsum(lengths) - lengths)[filled]
        sums[filled] = np.add.reduceat(self.rows[index], starts, axis=0)
        cos = sums[:, :-1] / np.sqrt(np.maximum(sums[:, -1:], 1e-9))
        return cos.reshape(len(bags), languages, -1).max(2)


# -- training and application over Spark tables ---------------------------------

LEAST_COSINE = 0.16  # a stretch below is too far from every centroid
LEAST_MARGIN = 0.15  # (best - second) / best of a stretch that may bring a language into a page
WEAK_MARGIN = 0.05  # the same for a stretch in a language that the page has anyway
LEAST_WORDS = 4


def _bag(stretch: str) -> list[str]:
    """Lower-case words outside quotes, brackets, links and addresses."""
    return _WORD.findall(_LINK.sub(" ", _QUOTED.sub(" ", stretch)).lower())


def _is_sentence(stretch: str, bag: list[str]) -> bool:
    return len(bag) >= LEAST_WORDS and _END.search(stretch) is not None


def fit_language_model(
    samples: DataFrame,
    pages: DataFrame | None = None,
    text_col: str = "content",
    label_col: str = "__language",
    id_col: str = "page_id",
    pages_per_language: int = 120,
    most_samples: int = 20_000,
) -> LanguageModel:
    """A model from ``samples`` (``sample_text``, ``lang``), refined on labelled pages.

    The refinement takes about ``pages_per_language`` pages of each usable
    label, drawn by a hash of the id (the bound of the training sample), and of
    these the sentences of pages on which at least four in five sentences are
    near the centroids of the label.  Labels that the content belies thus drop
    out.  Of more than ``most_samples`` samples about so many are drawn by a
    hash.  These two bound what the classifier is fitted on; everything else
    covers all rows.
    """
    known = samples.select("sample_text", "lang").where("sample_text is not null and lang is not null")
    count = known.count()
    if count > most_samples:
        known = known.where(F.pmod(F.xxhash64(F.lit("samples"), "sample_text"), F.lit(1_000_000)) < int(1_000_000 * most_samples / count))
    rows = known.orderBy("lang", "sample_text").collect()
    bags, labels = [_bag(r[0]) for r in rows], [r[1] for r in rows]
    model = LanguageModel.fit(bags, labels, centroids=3)
    if pages is None:
        return model
    coded = pages.select(
        F.col(f"`{text_col}`").alias("text"), label_code(F.col(f"`{label_col}`")).alias("code"), F.col(f"`{id_col}`").alias("id")
    ).where("code is not null and text is not null")
    sizes = {r["code"]: r["count"] for r in coded.groupBy("code").count().collect()}
    share = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, int(1_000_000 * min(1.0, pages_per_language / n)))]) if sizes else None
    if share is None:
        return model
    draw = F.pmod(F.xxhash64(F.lit("language sample"), "id"), F.lit(1_000_000))
    drawn = coded.where(draw < share[F.col("code")]).select("text", "code").orderBy("id").collect()  # about pages_per_language a label
    scorer = model.scorer(200_000)
    for text, code in drawn:
        own = [(text[a:b]) for a, b in stretches(text)]
        page = [bag for s in own if _is_sentence(s, bag := _bag(s))]
        if len(page) >= 2:
            near = scorer.cosines(page).argmax(1)
            if np.mean([model.languages[k] == code for k in near]) >= 0.8:
                bags += page
                labels += [code] * len(page)
    return LanguageModel.fit(bags, labels, centroids=4, least_df=2)


_SCHEMA = (
    "languages array<struct<lang:string,confidence:double,sentences:int,chars:int>>, "
    "segments array<struct<start:int,end:int,lang:string,confidence:double>>"
)


def _classify(texts: Sequence[str | None], scorer: Scorer) -> tuple[list, list]:
    names = scorer.model.languages
    spans = [stretches(t) if t else [] for t in texts]
    flat = [(t[a:b], a, b) for t, own in zip(texts, spans) for a, b in own]
    bags = [_bag(s) for s, _, _ in flat]
    cosines = scorer.cosines(bags)
    order = np.sort(cosines, axis=1)
    best, second = order[:, -1], order[:, -2]
    margin = (best - second) / np.maximum(best, 1e-9)
    which = cosines.argmax(1)
    sentence = np.array([_is_sentence(s, bag) for (s, _, _), bag in zip(flat, bags)], dtype=bool)
    strong = sentence & (best >= LEAST_COSINE) & (margin >= LEAST_MARGIN)
    filled = np.array([bool(bag) for bag in bags], dtype=bool)
    languages, segments, position = [], [], 0
    for own in spans:
        rows = range(position, position + len(own))
        position += len(own)
        present = {which[i] for i in rows if strong[i]}
        evidence: dict[int, list[tuple[float, int]]] = {k: [] for k in present}
        parts: list[list] = []
        for i in rows:
            k = which[i]
            if strong[i] or (k in present and filled[i] and margin[i] >= WEAK_MARGIN):
                sure = float(min(1.0, margin[i] * 2) * min(1.0, best[i] / (2 * LEAST_COSINE)))
                length = flat[i][2] - flat[i][1]
                if strong[i]:
                    evidence[k].append((sure, length))
                if parts and parts[-1][2] == k:
                    parts[-1][1] = flat[i][2]
                    parts[-1][3].append((sure, length))
                else:
                    parts.append([flat[i][1], flat[i][2], k, [(sure, length)]])
        mean = lambda pairs: round(sum(c * n for c, n in pairs) / max(sum(n for _, n in pairs), 1), 4)
        found = [(names[k], mean(pairs), len(pairs), sum(n for _, n in pairs)) for k, pairs in evidence.items()]
        languages.append([dict(zip(("lang", "confidence", "sentences", "chars"), x)) for x in sorted(found, key=lambda x: (-x[3], x[0]))])
        segments.append([{"start": a, "end": b, "lang": names[k], "confidence": mean(pairs)} for a, b, k, pairs in parts])
    return languages, segments


def detect_languages(df: DataFrame, model: LanguageModel, text_col: str = "content", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """The ``keep`` columns with ``languages`` and ``segments`` of each row's text.

    ``languages`` has an entry for each language with at least one sentence (four
    words or more outside quotes, brackets and addresses, and a sentence end),
    the largest first, with a confidence from 0 to 1.  ``segments`` covers the
    text's stretches in order; offsets are code points, neighbours of one
    language are joined, rejected stretches are left out.  Null, empty and
    wordless texts have empty arrays.  Repeated rows are classified each.
    """
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    data = df.sparkSession.sparkContext.broadcast(model)  # a few MB: bounded by the training sample

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = data.value.scorer()
        for batch in batches:
            out = batch[list(keep)].copy()
            out["languages"], out["segments"] = _classify([t if isinstance(t, str) else None for t in batch["__text"]], scorer)
            yield out

    narrow = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("__text"))
    return spread(narrow).mapInPandas(run, f"{fields}, {_SCHEMA}")


def mislabelled(detected: DataFrame, id_col: str = "page_id", label_col: str = "__language") -> DataFrame:
    """``(id, lang)`` for each language of the rows whose label is not exactly their one language.

    Rows without a language never count.  Rows that repeat an id count once.
    """
    langs = F.transform("languages", lambda x: x["lang"])
    named = (F.size("languages") == 1) & (label_code(F.col(f"`{label_col}`")) == F.try_element_at(langs, F.lit(1)))
    wrong = detected.where((F.size("languages") > 0) & ~F.coalesce(named, F.lit(False)))
    return wrong.select(F.col(f"`{id_col}`"), F.explode(langs).alias("lang")).distinct()
