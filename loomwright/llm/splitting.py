"""Splitting oversized texts at natural boundaries (problem 10).

A text is read in ranges with halos: a range owns the chunks (white-space
delimited runs) that start in it, and the halos on both sides show where its
first and last chunk begin and end and what stands before them, so that ranges
can be worked on anywhere and agree without talking.  A range gives a boundary
table: length, tokens and boundary strength of each atom.  The tables of a text
are stitched by range number, their lengths are prefix-summed, and pieces are
chosen on the stitched table alone.  Pieces are then cut out of the ranges by
offset.

Every text goes this way; the tables of a text of one range are stitched where
they are made, those of longer ones are shuffled, as tables and not as texts.
The table is the same however a text is cut into ranges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.bpe import BytePairEncoder
from loomwright.llm.tokenizer import DEFAULT_FOLDER, DEFAULT_NAME, encoder
from loomwright.plans.lineage import cut_lineage, spread

RANGE_CHARS = 65_536
GRID_CHARS = 2_048  # longer chunks are cut at the multiples of this place in the text
CONTEXT_CHARS = 256  # what is looked at before an atom to tell its boundary
LEAD_CHARS = GRID_CHARS + CONTEXT_CHARS
TAIL_CHARS = GRID_CHARS + 2

# boundary before an atom: inside a word, at a word, after a clause, a sentence, a line, a paragraph
INSIDE, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(6)
_SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")
_CLAUSE_END = re.compile(r"[,;:，；：、][\"'”’»)\]]*$")
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _is_cut(text: str, p: int) -> bool:
    """Whether a chunk starts at p > 0, from the characters around p alone."""
    before, here = text[p - 1] in _SPACE, text[p] in _SPACE
    if not before:
        return here
    if here:
        return p + 1 < len(text) and text[p + 1] not in _SPACE
    return text[p - 1] != " "


def _takeover(view: str, place: int) -> int:
    """Where the first chunk at or after ``place`` starts; ``place`` itself if it lies in a chunk of over GRID_CHARS."""
    right = next((p for p in range(place, min(len(view), place + GRID_CHARS + 1)) if _is_cut(view, p)), None)
    if right is None:
        return place if place + GRID_CHARS < len(view) else _short_end(view, place)
    left = next((p for p in range(place - 1, max(0, place - GRID_CHARS - 1), -1) if _is_cut(view, p)), max(0, place - GRID_CHARS - 1))
    return place if right - left > GRID_CHARS and right > place else right


def _short_end(view: str, place: int) -> int:
    """As :func:`_takeover` where the view, and so the text, ends in the chunk of ``place``."""
    left = next((p for p in range(place - 1, max(0, place - GRID_CHARS - 1), -1) if _is_cut(view, p)), max(0, place - GRID_CHARS - 1))
    return place if len(view) - left > GRID_CHARS else len(view)


def range_chunks(view: str, start: int, end: int, at: int, bpe: BytePairEncoder, last: bool) -> tuple[int, list[str]]:
    """(place in the view of the first one, the chunks that a range owns).

    ``start`` and ``end`` are the range's ends inside ``view``, which reaches a
    halo beyond both; ``at`` is the place of ``start`` in the text, a multiple
    of GRID_CHARS.
    """
    a = _takeover(view, start) if at else 0
    b = len(view) if last else _takeover(view, end)
    out: list[str] = []
    place = at + a - start
    left = b - a
    for chunk in bpe.chunks(view[a : b + 2]) if b > a else ():  # where a chunk ends is told by the two characters after it
        chunk = chunk[:left]
        left -= len(chunk)
        if not chunk:
            break
        if len(chunk) > GRID_CHARS or place % GRID_CHARS == 0 and len(chunk) >= GRID_CHARS:
            first = GRID_CHARS - place % GRID_CHARS
            out += [chunk[:first]] + [chunk[k : k + GRID_CHARS] for k in range(first, len(chunk), GRID_CHARS)]
        else:
            out.append(chunk)
        place += len(chunk)
    return a, out


def _strength(view: str, p: int, chunk: str) -> int:
    """The boundary before the chunk at p, from the CONTEXT_CHARS before it."""
    last = view[p - 1]
    if last.isalnum() and chunk[0] == " " and chunk[-1] not in _SPACE:
        return WORD
    if p > 0 and not _is_cut(view, p):
        return INSIDE
    before = view[max(0, p - CONTEXT_CHARS) : p]
    words = before.rstrip(_SPACE)
    breaks = (before[len(words) :] + chunk[: len(chunk) - len(chunk.lstrip(_SPACE))]).count("\n")
    if breaks:
        return PARAGRAPH if breaks > 1 else LINE
    return SENTENCE if _SENTENCE_END.search(words) else CLAUSE if _CLAUSE_END.search(words) else WORD


Atoms = tuple[np.ndarray, np.ndarray, np.ndarray]


def atoms(view: str, first: int, chunks: list[str], counts: np.ndarray, bpe: BytePairEncoder, most: int) -> Atoms:
    """(characters, tokens, strength of the boundary before) of the atoms of chunks that start at ``first`` of ``view``.

    An atom is a chunk or, where a chunk has over ``most`` tokens, its
    pre-tokens or, where these have, slices of them.
    """
    lengths = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
    places = (first + np.cumsum(lengths) - lengths).tolist()
    strength = np.fromiter((_strength(view, p, c) if p else WORD for p, c in zip(places, chunks)), dtype=np.int8, count=len(chunks))
    large = np.flatnonzero(counts > most)
    if not len(large):
        return lengths, counts, strength
    out_l, out_c, out_s = [], [], []
    position = 0
    for i in large.tolist():
        out_l.append(lengths[position:i])
        out_c.append(counts[position:i])
        out_s.append(strength[position:i])
        parts: list[str] = []
        for word in bpe.split(chunks[i]):
            width = max(1, most // 8)
            parts += [word] if len(word) <= width else [word[k : k + width] for k in range(0, len(word), width)]
        own = bpe.chunk_counts([parts])[0]
        out_l.append(np.fromiter(map(len, parts), dtype=np.int64))
        out_c.append(own)
        out_s.append(np.r_[strength[i], np.full(len(parts) - 1, INSIDE)].astype(np.int8))
        position = i + 1
    out_l.append(lengths[position:])
    out_c.append(counts[position:])
    out_s.append(strength[position:])
    return np.concatenate(out_l), np.concatenate(out_c), np.concatenate(out_s)


def plan_pieces(tokens: np.ndarray, strength: np.ndarray, most: int, overlap: int) -> list[tuple[int, int]]:
    """(first, end) atom of each piece.

    A piece ends at the strongest boundary of its later half, the last of equal
    ones; the next begins as many atoms earlier as fit into ``overlap`` tokens,
    and always after the start of the piece before.
    """
    total = np.r_[0, np.cumsum(tokens)]
    n = len(tokens)
    out, first = [], 0
    while first < n:
        end = int(np.searchsorted(total, total[first] + most, side="right")) - 1
        end = max(end, first + 1)
        if end >= n:
            out.append((first, n))
            break
        middle = int(np.searchsorted(total, total[first] + most / 2, side="left"))
        low = min(max(middle, first + 1), end)
        if out:  # a piece must reach beyond the one before
            low = max(low, min(out[-1][1] + 1, end))
        window = strength[low : end + 1]
        cut = low + len(window) - 1 - int(np.argmax(window[::-1]))
        out.append((first, cut))
        back = int(np.searchsorted(total, total[cut] - overlap, side="left"))
        first = min(max(back, first + 1), cut)
    return out


def _stitched(tables: list[Atoms], most: int, overlap: int) -> list[tuple[int, int, int, int, int]]:
    """(number, start, end, tokens, tokens shared with the piece before) from the tables of all ranges of a text; offsets in characters."""
    lengths, tokens, strength = (np.concatenate(v) for v in zip(*tables))
    if tokens.sum() <= most:
        return []
    ends = np.r_[0, np.cumsum(lengths)]
    total = np.r_[0, np.cumsum(tokens)]
    out, before = [], 0
    for number, (a, b) in enumerate(plan_pieces(tokens, strength, most, overlap)):
        shared = int(total[before] - total[a]) if number else 0
        out.append((number, int(ends[a]), int(ends[b]), int(total[b] - total[a]), max(shared, 0)))
        before = b
    return out


_PIECE = "piece_no int, start int, `end` int, n_tokens int, shared_tokens int"


def split_oversized(
    df: DataFrame,
    limits: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    range_chars: int = RANGE_CHARS,
    tokenizer: str = DEFAULT_NAME,
    folder: str = DEFAULT_FOLDER,
) -> DataFrame:
    """``(id, piece_no, start, end, n_tokens, shared_tokens, piece)`` for each text above its source's limit.

    ``limits`` has ``source, max_tokens, overlap_tokens``, one row a source.
    Pieces are in order and cover the text; start and end are code points.
    Neighbours share whole words of at most ``overlap_tokens`` tokens.  Texts
    within the limit, null texts and texts of sources without a limit have no
    pieces.  Ids must be unique.  ``range_chars`` is rounded up to a multiple of
    GRID_CHARS; it does not change the result.  The table is read twice, for
    texts of one range and of several: that costs less than to write all pieces.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    size = -(-range_chars // GRID_CHARS) * GRID_CHARS
    rules = limits.where("source is not null and max_tokens > 0").groupBy("source").agg(F.min("max_tokens").alias("most"), F.min("overlap_tokens").alias("overlap"))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{source_col}`").alias("source"))
    rows = spread(rows.where("text is not null and source is not null")).join(rules, "source").select(
        "id", "text", "most", F.least(F.coalesce("overlap", F.lit(0)), F.col("most") - 1).alias("overlap")
    )

    def tables(bpe: BytePairEncoder, batch: pd.DataFrame, above: bool = False) -> list[Atoms | None]:
        """The boundary table of each range of a batch (lead, body, tail, range, last, most); with ``above`` only where it has over ``most`` tokens."""
        views, cut = [], []
        for lead, body, tail, number, last in batch[["lead", "body", "tail", "range", "last"]].itertuples(index=False):
            views.append(lead + body + tail)
            cut.append(range_chunks(views[-1], len(lead), len(lead) + len(body), number * size, bpe, last))
        counts = bpe.chunk_counts([chunks for _, chunks in cut])
        most = batch["most"].tolist()
        return [None if above and n.sum() <= m else atoms(v, first, chunks, n, bpe, m) for v, (first, chunks), n, m in zip(views, cut, counts, most)]

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(tokenizer, folder)
        for batch in batches:
            # a text has at most as many tokens as bytes
            batch = batch[[len(t) > m or len(t.encode("utf-8", "surrogatepass")) > m for t, m in zip(batch["body"], batch["most"])]]
            out = []
            for key, text, most, overlap, table in zip(batch["id"], batch["body"], batch["most"].tolist(), batch["overlap"].tolist(), tables(bpe, batch, above=True)):
                out += [] if table is None else [(key, number, a, b, n, shared, text[a:b]) for number, a, b, n, shared in _stitched([table], most, overlap)]
            yield pd.DataFrame(out, columns=["id", "piece_no", "start", "end", "n_tokens", "shared_tokens", "piece"])

    one = rows.where(F.length("text") <= size).select(
        "id", "most", "overlap", F.lit("").alias("lead"), F.col("text").alias("body"), F.lit("").alias("tail"), F.lit(0).alias("range"), F.lit(True).alias("last")
    )
    short = one.mapInPandas(whole, f"id {id_type}, {_PIECE}, piece string")

    # ranges by one pass over the text; each goes on alone, with its halos
    bodies = rows.where(F.length("text") > size).select("id", "most", "overlap", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{size}}}+"), F.lit(0)).alias("all"))
    ranged = F.transform(
        "all",
        lambda body, i: F.struct(
            i.alias("range"),
            F.coalesce(F.right(F.get("all", i - 1), F.lit(LEAD_CHARS)), F.lit("")).alias("lead"),
            body.alias("body"),
            F.coalesce(F.left(F.get("all", i + 1), F.lit(TAIL_CHARS)), F.lit("")).alias("tail"),
            (i == F.size("all") - 1).alias("last"),
        ),
    )
    ranges = bodies.select("id", "most", "overlap", F.explode(ranged).alias("r")).select("id", "most", "overlap", "r.*")

    def table(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(tokenizer, folder)
        for batch in batches:
            made = tables(bpe, batch)
            out = batch[["id", "most", "overlap", "range", "body"]].copy()
            for i, name in enumerate(("lengths", "tokens", "strength")):
                out[name] = pd.Series([t[i].astype(np.int32) for t in made], index=out.index, dtype=object)
            yield out

    made = cut_lineage(ranges.mapInPandas(table, f"id {id_type}, most int, overlap int, range int, body string, lengths array<int>, tokens array<int>, strength array<int>"))

    def stitch(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("range")
        parts = [tuple(np.asarray(v, dtype=np.int64) for v in row) for row in pdf[["lengths", "tokens", "strength"]].itertuples(index=False)]
        out = pd.DataFrame(_stitched(parts, int(pdf["most"].iloc[0]), int(pdf["overlap"].iloc[0])), columns=["piece_no", "start", "end", "n_tokens", "shared_tokens"])
        out.insert(0, "id", [key[0]] * len(out))
        return out

    planned = made.drop("body").groupBy("id").applyInPandas(stitch, f"id {id_type}, {_PIECE}")
    # each piece takes its part of each range it touches
    touched = planned.withColumn("range", F.explode(F.sequence(F.floor(F.col("start") / size).cast("int"), F.floor((F.col("end") - 1) / size).cast("int"))))
    at = F.col("range") * size
    low = F.greatest(F.lit(0), F.col("start") - at)
    high = F.least(F.lit(size), F.col("end") - at)
    parts = touched.join(made.select("id", "range", "body"), ["id", "range"]).withColumn("part", F.substring("body", low + 1, high - low))
    cut = parts.groupBy("id", "piece_no", "start", "end", "n_tokens", "shared_tokens").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "part"))), lambda x: x["part"]), "").alias("piece")
    )
    return short.unionByName(cut).withColumnRenamed("id", id_col)


def rebuilt(df: DataFrame, pieces: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text)``: every text put together again from its pieces, without what neighbours share; texts without pieces as they are."""
    one = F.struct("piece_no", "start", "end", "piece")
    joined = F.aggregate(
        F.array_sort(F.collect_list(one)),
        F.struct(F.lit("").alias("text"), F.lit(0).alias("at")),
        lambda acc, x: F.struct(F.concat(acc["text"], x["piece"].substr(acc["at"] - x["start"] + 1, F.length(x["piece"]))).alias("text"), x["end"].alias("at")),
        lambda acc: acc["text"],
    )
    whole = pieces.groupBy(id_col).agg(joined.alias("__whole"))
    return df.select(id_col, text_col).join(whole, id_col, "left").select(id_col, F.coalesce("__whole", text_col).alias("text"))
