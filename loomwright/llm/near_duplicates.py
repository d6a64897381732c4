"""Near-duplicate texts with small edits (problem 5).

Similarity is the Jaccard index of the sets of character n-grams of the
normalised texts.  A text's fingerprint is its one-permutation min-hash: the
least hash in each of some hundred bins, ten bits of each, under a few
permutations.

Pivot distance tables find the pairs.  The fingerprint is cut into blocks; of
each block the Hamming distances to reference fingerprints are computed once
and stored as one row of coordinates.  Two texts can be alike in a block only
if no coordinate of their rows differs, so texts meet where a whole row is
equal (greatest coordinate difference 0), and all other pairs are discarded
without being looked at.  A row that many texts share is dealt out in parts, which meet
pairwise without a pair being written.  Of those that meet, distances of the
whole sketch to further references discard what the triangle inequality rules
out, the Hamming distance of the sketches discards what is too far, and the
survivors are verified exactly on the texts.

Equal texts are one text, named by its hash, until the result is written; each
task sends a text on once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.plans.components import connected_components
from loomwright.plans.lineage import cut_lineage, forget, spread


@dataclass(frozen=True)
class DuplicateSettings:
    """``threshold`` is the least similarity of a pair.

    With ``blocks`` blocks of ``block_values`` values a pair of similarity s is
    missed with a chance of (1 - s**block_values)**blocks: 0.20 % at 0.50,
    4e-5 at 0.55, 1e-7 at 0.60 with the defaults.  ``blocks_at_once`` blocks are
    joined in one turn, which bounds the disk, in tasks of about ``bucket_keys``
    keys (16 bytes each).  Up to ``run_rows`` texts that are
    equal in a block are paired at once; more go through the pivot distances of
    the whole sketch, ``deal_rows`` against ``deal_rows``.  ``slack`` is the margin, in
    similarity, that the sketch test leaves where every bin is filled (three
    standard errors); it grows as fewer bins are.
    """

    ngram: int = 9
    threshold: float = 0.5
    blocks: int = 196
    block_values: int = 5
    blocks_at_once: int = 49
    bucket_keys: int = 2_000_000
    run_rows: int = 256
    deal_rows: int = 4_000
    references: int = 10
    sketch_bits: int = 384
    whole_references: int = 8
    slack: float = 0.13


_SPACE = re.compile(r"\s+")


def normalise(text: str) -> str:
    """NFKC, every run of white space one underscore."""
    return _SPACE.sub("_", unicodedata.normalize("NFKC", text))


def _gram_hashes(texts: Sequence[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every n-gram, number of n-grams of each text)."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    counts = np.maximum(lengths - n + 1, 0)
    if not counts.sum():
        return np.zeros(0, np.uint64), counts
    with np.errstate(over="ignore"):
        h = np.zeros(len(points) - n + 1, dtype=np.uint64)
        for i in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + points[i : len(points) - n + 1 + i]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    starts = np.cumsum(lengths) - lengths
    inside = np.ones(len(h) + n, dtype=bool)
    for s, length in zip(starts[lengths > 0], lengths[lengths > 0]):
        inside[max(s, s + length - n + 1) : s + length] = False
    return h[inside[: len(h)]], counts


class Fingerprinter:
    def __init__(self, s: DuplicateSettings) -> None:
        self.s = s
        self.bins = s.blocks * s.block_values
        rng = np.random.default_rng(41)
        width = 10 * s.block_values
        self.block_refs = rng.integers(0, 1 << min(width, 62), (s.blocks, s.references)).astype(np.uint64)
        self.salt = rng.integers(0, 2**62, s.blocks).astype(np.uint64)
        self.turns = rng.integers(0, 2**62, s.block_values).astype(np.uint64)
        self.whole_refs = rng.integers(0, 2**63, (s.whole_references, s.sketch_bits // 64)).astype(np.uint64)

    def signatures(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(has n-grams, row keys of the blocks, sketch words, distances of the sketch to references and number of filled bins)."""
        s, bins = self.s, self.bins
        h, counts = _gram_hashes(texts, s.ngram)
        n = len(texts)
        # the values of a block come from permutations of their own, so that copies never fall into one block
        least = np.full((s.block_values, n * s.blocks), np.uint64(2**64 - 1))
        start = np.repeat(np.arange(n) * s.blocks, counts)
        for i in range(s.block_values if len(h) else 0):
            with np.errstate(over="ignore"):
                own = (h ^ self.turns[i]) * np.uint64(0x94D049BB133111EB)
            own ^= own >> np.uint64(32)
            np.minimum.at(least[i], start + (own % np.uint64(s.blocks)).astype(np.int64), own)
        least = least.reshape(s.block_values, n, s.blocks).transpose(1, 0, 2).reshape(-1, s.blocks)
        empty = least == np.uint64(2**64 - 1)
        # an empty bin takes the value of the next filled one, mixed with the way there
        index = np.where(~empty, np.arange(s.blocks), 2 * s.blocks)
        doubled = np.concatenate([index, index + s.blocks], axis=1)
        doubled[doubled >= 2 * s.blocks] = 4 * s.blocks
        following = np.minimum.accumulate(doubled[:, ::-1], axis=1)[:, ::-1][:, : s.blocks]
        step = np.where(following < 4 * s.blocks, following - np.arange(s.blocks), 0)
        value = np.take_along_axis(least, np.where(following < 4 * s.blocks, following % s.blocks, 0), axis=1)
        with np.errstate(over="ignore"):
            value = (value + step.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0x94D049BB133111EB)
        value ^= value >> np.uint64(31)
        value, empty = value.reshape(n, bins), empty.reshape(n, bins)

        ten = (value >> np.uint64(20)) & np.uint64(1023)
        words = np.zeros((n, s.blocks), dtype=np.uint64)
        for i in range(s.block_values):
            words = (words << np.uint64(10)) | ten[:, i * s.blocks : (i + 1) * s.blocks]
        keys = np.zeros((n, s.blocks), dtype=np.uint64)
        for r in range(s.references):  # one row of distances, six bits each
            keys = (keys << np.uint64(6)) | np.bitwise_count(words ^ self.block_refs[None, :, r]).astype(np.uint64)
        with np.errstate(over="ignore"):
            keys = (keys ^ self.salt[None, :]) * np.uint64(0xBF58476D1CE4E5B9)
        keys ^= keys >> np.uint64(33)
        keys &= np.uint64((1 << 44) - 1)

        i = np.arange(s.sketch_bits)
        place, shift = (i * bins // s.sketch_bits, 0 * i) if bins >= s.sketch_bits else (i % bins, i // bins)
        bits = ((value[:, place] >> (40 + shift).astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
        sketch = np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view(np.uint64)
        far = np.stack([np.bitwise_count(sketch ^ ref[None, :]).sum(1) for ref in self.whole_refs] + [(~empty).sum(1)], axis=1).astype(np.int16)
        return counts > 0, keys, sketch, far

    def most_bits(self, filled: np.ndarray) -> np.ndarray:
        """The Hamming distances of sketches that pairs of the least similarity stay within.

        ``filled`` is the larger number of filled bins of each pair: the sketch draws at least
        so many values, and the other bins copy them in runs of uneven length.
        """
        s, part = self.s, np.clip(filled, 1, self.bins) / self.bins
        drawn = np.minimum(s.sketch_bits, self.bins * part / (2 - part))
        slack = s.slack * np.sqrt((2 + s.sketch_bits / drawn) / 3)  # two thirds of the variance are the bits' own
        return (s.sketch_bits * (1 - (s.threshold - slack)) / 2).astype(np.int64)


def _signatures(df: DataFrame, id_col: str, text_col: str, s: DuplicateSettings) -> DataFrame:
    """``(id, h, t, keys, sketch)`` of every row with n-grams; h names the normalised text, t is the first half of h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Fingerprinter(s)
        for whole in batches:
            start = 0
            while start < whole.num_rows:
                texts, size = [], 0
                for t in whole.column(1).slice(start, 1000).to_pylist():
                    if texts and size > 4_000_000:
                        break
                    texts.append(normalise(t))
                    size += len(texts[-1])
                ids = whole.column(0).slice(start, len(texts))
                start += len(texts)
                filled, keys, sketch, far = make.signatures(texts)
                rows = np.flatnonzero(filled)
                packed = keys.view(np.uint8).reshape(len(texts), s.blocks, 8)[:, :, :6].tobytes()
                width = s.blocks * 6
                both = [sketch[i].tobytes() + far[i].tobytes() for i in rows]
                names = [xxhash.xxh3_128_digest(texts[i].encode("utf-8", "surrogatepass")) for i in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(rows)),
                        pa.array(names, pa.binary()),
                        pa.array(np.frombuffer(b"".join(x[:8] for x in names), dtype=">i8").astype(np.int64)),
                        pa.array([packed[i * width : (i + 1) * width] for i in rows], pa.binary()),
                        pa.array(both, pa.binary()),
                    ],
                    names=["id", "h", "t", "keys", "sketch"],
                )

    narrow = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t")).where("id is not null and t is not null")
    return spread(narrow).mapInArrow(run, "id bigint, h binary, t bigint, keys binary, sketch binary")


def _block_keys(df: DataFrame, first: int, last: int, buckets: int) -> DataFrame:
    """``(bucket, data)``: keys of the blocks from ``first`` to before ``last`` with their texts, each text once a task.

    Keys are dealt to buckets here and travel packed, a row for each bucket and
    batch: first all keys, then all texts, 8 bytes each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()  # at most the texts of one split
        for batch in batches:
            t = batch.column(0).to_pylist()
            new = [i for i, x in enumerate(t) if not (x in known or known.add(x))]
            if not new:
                continue
            packed = batch.column(1).take(pa.array(new)).to_pylist()
            six = np.frombuffer(b"".join(k[first * 6 : last * 6] for k in packed), dtype=np.uint8).reshape(-1, 6)
            eight = np.zeros((len(six), 8), dtype=np.uint8)
            eight[:, :6] = six
            keys = eight.view(np.int64).ravel()
            names = np.repeat(np.array(t, dtype=np.int64)[new], last - first)
            bucket = (keys % buckets).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            keys, names, bucket = keys[order], names[order], bucket[order]
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            ends = np.r_[starts[1:], len(bucket)]
            data = [keys[i:j].tobytes() + names[i:j].tobytes() for i, j in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array(data, pa.binary())], names=["bucket", "data"])

    return df.select("t", "keys").mapInArrow(run, "bucket int, data binary")


def _pairs_of_runs(keys: np.ndarray, t: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(one text, other text of the pairs of equal keys; key, text of the rows of longer runs) of sorted, distinct rows."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    left, right = [], []
    for n in np.unique(sizes[(sizes > 1) & (sizes <= most)]).tolist():
        i, j = np.triu_indices(n, 1)
        own = starts[sizes == n]
        left.append((own[:, None] + i[None, :]).ravel())
        right.append((own[:, None] + j[None, :]).ravel())
    large = np.repeat(sizes > most, sizes)
    none = np.zeros(0, dtype=np.int64)
    return t[np.concatenate([none, *left])], t[np.concatenate([none, *right])], keys[large], t[large]


def _meeting(keys: DataFrame, most: int) -> DataFrame:
    """``(a, b, key)``: pairs of texts with an equal key (key null), and the rows of keys that over ``most`` texts share (b null)."""

    def run(table: pa.Table) -> pa.Table:
        both = [np.frombuffer(x, dtype=np.int64).reshape(2, -1) for x in table.column("data").to_pylist()]
        k, t = np.concatenate(both, axis=1)
        order = np.lexsort((t, k))
        k, t = k[order], t[order]
        new = np.r_[True, (k[1:] != k[:-1]) | (t[1:] != t[:-1])]
        a, b, hot, texts = _pairs_of_runs(k[new], t[new], most)
        none = [np.r_[np.zeros(len(a), bool), np.ones(len(hot), bool)], np.r_[np.ones(len(a), bool), np.zeros(len(hot), bool)]]
        return pa.table({"a": np.r_[a, texts], "b": pa.array(np.r_[b, 0 * texts], mask=none[0]), "key": pa.array(np.r_[0 * a, hot], mask=none[1])})

    return keys.groupBy("bucket").applyInArrow(run, "a bigint, b bigint, key bigint")


def _sketch_arrays(column: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(words of the sketches, distances to the references and filled bins) of packed sketches."""
    raw = np.frombuffer(b"".join(column), dtype=np.uint8).reshape(len(column), -1)
    return np.ascontiguousarray(raw[:, : words * 8]).view(np.uint64), np.ascontiguousarray(raw[:, words * 8 :]).view(np.int16)


def _near_sketches(pairs: DataFrame, s: DuplicateSettings) -> DataFrame:
    """Pairs whose pivot distances and sketches allow the least similarity."""
    words = s.sketch_bits // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Fingerprinter(s)
        for batch in batches:
            if not batch.num_rows:
                continue
            (bits_a, far_a), (bits_b, far_b) = (_sketch_arrays(batch.column(i).to_pylist(), words) for i in (2, 3))
            most = make.most_bits(np.maximum(far_a[:, -1], far_b[:, -1]))
            keep = np.flatnonzero(np.abs(far_a[:, :-1] - far_b[:, :-1]).max(1) <= most)
            keep = keep[np.bitwise_count(bits_a[keep] ^ bits_b[keep]).sum(1) <= most[keep]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep))], names=["a", "b"])

    return pairs.select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a bigint, b bigint")


def _near_in_parts(hot: DataFrame, sketches: DataFrame, s: DuplicateSettings) -> DataFrame:
    """As :func:`_near_sketches` for all pairs of the texts of each key of ``hot`` (key, t).

    The texts of a key are dealt to parts of about ``deal_rows``; every two
    parts meet in a task of their own, and only near pairs leave it.
    """
    words = s.sketch_bits // 64
    sizes = hot.groupBy("key").agg(F.ceil(F.count("*") / s.deal_rows).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("t"), F.col("parts").cast("bigint")).cast("int")
    dealt = hot.join(sizes, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = dealt.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "t").join(sketches, "t")

    def run(table: pa.Table) -> pa.Table:
        make = Fingerprinter(s)
        table = table.sort_by("t")
        t, part = table.column("t").to_numpy(), table.column("own").to_numpy()
        crossing = table.column("low")[0].as_py() != table.column("high")[0].as_py()
        bits, far = _sketch_arrays(table.column("sketch").to_pylist(), words)
        left, right = [], []
        for i in range(len(t)):
            j = np.arange(i + 1, len(t))
            j = j[part[j] != part[i]] if crossing else j
            most = make.most_bits(np.maximum(far[j, -1], far[i, -1]))
            ok = np.abs(far[j, :-1] - far[i, :-1]).max(1) <= most if len(j) else np.zeros(0, bool)
            j, most = j[ok], most[ok]
            j = j[np.bitwise_count(bits[j] ^ bits[i]).sum(1) <= most]
            left.append(np.full(len(j), t[i]))
            right.append(t[j])
        return pa.table({"a": pa.array(np.concatenate(left).astype(np.int64)), "b": pa.array(np.concatenate(right).astype(np.int64))})

    return placed.groupBy("key", "low", "high").applyInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, s: DuplicateSettings) -> DataFrame:
    """Exact similarities of pairs that carry their texts; those below the threshold are gone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets: dict[int, np.ndarray] = {}

            def grams(key: int, text: str, sets=sets) -> np.ndarray:
                if key not in sets:
                    if len(sets) > 4000:
                        sets.clear()
                    sets[key] = np.unique(_gram_hashes([normalise(text)], s.ngram)[0])
                return sets[key]

            values = []
            for a, b, ta, tb in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"]):
                x, y = grams(a, ta), grams(b, tb)
                common = len(np.intersect1d(x, y, assume_unique=True))
                values.append(common / max(len(x) + len(y) - common, 1))
            out = batch[["a", "b"]].assign(similarity=np.array(values, dtype=float))
            yield out[out["similarity"] >= s.threshold]

    return pairs.select("a", "b", "text_a", "text_b").sortWithinPartitions("a", "b").mapInPandas(run, "a bigint, b bigint, similarity double")


def _near_in_blocks(texts: DataFrame, sketches: DataFrame, first: int, last: int, buckets: int, s: DuplicateSettings) -> DataFrame:
    """``(a, b)`` of the texts that are equal in one of the blocks and near by their sketches."""
    met = cut_lineage(_meeting(_block_keys(texts, first, last, buckets), s.run_rows).distinct())
    pairs = met.where("b is not null")
    with_sketches = pairs.join(sketches.toDF("a", "sketch_a"), "a").join(sketches.toDF("b", "sketch_b"), "b")
    near = _near_sketches(with_sketches, s)
    hot = met.where("key is not null").select("key", F.col("a").alias("t"))
    if hot.limit(1).count():
        near = near.unionByName(_near_in_parts(hot, sketches, s))
    near = cut_lineage(near)
    forget(met)
    return near


def near_duplicate_links(
    df: DataFrame, id_col: str, text_col: str, settings: DuplicateSettings = DuplicateSettings()
) -> tuple[DataFrame, DataFrame]:
    """(links: a, b, similarity between representatives; members: id, rep).

    ``members`` has every id whose text has n-grams, with the lowest id that has
    the same normalised text; ``links`` joins different texts of at least the
    threshold, a < b.  Null, empty and very short texts are in neither.  Rows
    that repeat an id count once; where their texts differ the lowest text hash
    stands for the id.
    """
    s = settings
    texts = cut_lineage(_signatures(df, id_col, text_col, s))
    one = texts.groupBy("id").agg(F.min("h").alias("h"))
    short = F.conv(F.hex(F.substring("h", 1, 8)), 16, -10).cast("bigint")  # t: the first half of h
    reps = cut_lineage(one.groupBy("h").agg(F.min("id").alias("rep")).select("h", "rep", short.alias("t")))
    members = cut_lineage(one.join(reps, "h").select("id", "rep"))
    sketches = cut_lineage(texts.select("t", "sketch").dropDuplicates(["t"]))
    spark = df.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-texts.count() * s.blocks_at_once // s.bucket_keys))
    near = None
    for first in range(0, s.blocks, s.blocks_at_once):
        found = _near_in_blocks(texts, sketches, first, min(first + s.blocks_at_once, s.blocks), buckets, s)
        near = found if near is None else near.unionByName(found)
        spark.sparkContext._jvm.System.gc()  # lets Spark delete the shuffle files of the turn
    named = reps.select("t", "rep")
    pairs = near.distinct().join(named.toDF("a", "rep_a"), "a").join(named.toDF("b", "rep_b"), "b")
    near = cut_lineage(pairs.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).where("a < b"))
    # a small table of ids is broadcast by its true size, a large one is shuffled
    involved = cut_lineage(near.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    content = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")
    content = content.join(involved, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    full = near.join(content.toDF("a", "text_a"), "a").join(content.toDF("b", "text_b"), "b")
    return _verified(full, s), members


def link_recall(
    df: DataFrame, id_col: str, text_col: str, links: DataFrame, members: DataFrame, every: int = 20, block: int = 1_000, settings: DuplicateSettings = DuplicateSettings()
) -> DataFrame:
    """``(similarity, pairs, found, recall)`` in bands of a tenth, against brute force.

    Queries are all representatives divisible by ``every``, against the texts
    of all representatives, in blocks of ``block`` queries, each block sent to
    the executors once as an inverted index of its n-grams.
    """
    s = settings
    text = F.col(f"`{text_col}`").cast("string")
    reps = members.select(F.col("rep").alias("id")).distinct()
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), text.alias("text")).where("text is not null").join(reps, "id", "left_semi")
    rows = cut_lineage(rows.groupBy("id").agg(F.min("text").alias("text")))
    queries = rows.where(F.col("id") % every == 0)
    blocks = max(1, -(-queries.count() // block))
    exact = None
    for number in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number).collect()
        sets = [np.unique(_gram_hashes([normalise(r.text)], s.ngram)[0]) for r in part]
        grams = np.concatenate([np.zeros(0, np.uint64), *sets])
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(grams, kind="stable")
        index = (np.array([r.id for r in part], dtype=np.int64), np.array([len(x) for x in sets], dtype=np.int64), grams[order], owner[order].astype(np.int32))
        shared = df.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, sizes, grams, owner = shared.value
            for batch in batches:
                out = []
                for key, text in zip(batch["id"], batch["text"]):
                    own = np.unique(_gram_hashes([normalise(text)], s.ngram)[0])
                    low, high = np.searchsorted(grams, own, "left"), np.searchsorted(grams, own, "right")
                    n = high - low
                    at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    common = np.bincount(owner[at], minlength=len(ids))
                    value = common / np.maximum(sizes + len(own) - common, 1)
                    hit = np.flatnonzero((value >= s.threshold) & (ids != key))
                    out += [(min(key, ids[i]), max(key, ids[i]), float(value[i])) for i in hit.tolist()]
                yield pd.DataFrame(out, columns=["a", "b", "s"]).astype({"a": "int64", "b": "int64", "s": float})

        found = rows.mapInPandas(run, "a bigint, b bigint, s double")
        exact = found if exact is None else exact.unionByName(found)
    exact = cut_lineage(exact.groupBy("a", "b").agg(F.max("s").alias("s")))
    both = exact.join(links.select("a", "b", F.lit(True).alias("hit")), ["a", "b"], "left")
    band = F.floor(F.col("s") * 10 + 1e-9) / 10
    return both.groupBy(band.alias("similarity")).agg(
        F.count("*").alias("pairs"), F.count_if("hit").alias("found"), F.round(F.count_if("hit") / F.count("*"), 4).alias("recall")
    )


def duplicate_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """``(a, b)``, a < b: every linked pair of ids, copies of one text included."""
    left = links.select("a", "b").join(members.toDF("x", "a"), "a").select("x", "b")
    across = left.join(members.toDF("y", "b"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    one, two = members.toDF("a", "rep"), members.toDF("b", "rep")
    return across.unionByName(one.join(two, "rep").where("a < b").select("a", "b"))


def duplicate_groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """``(id, group_id, links)`` of every id with a link or a copy.

    ``group_id`` is the lowest id of the connected group, ``links`` the number
    of other ids the id is linked to.
    """
    sizes = members.groupBy("rep").agg(F.count("*").alias("copies"))
    ends = links.select("a", "b").union(links.select("b", "a"))
    degrees = ends.join(sizes.toDF("b", "n"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("across"))
    groups = connected_components(links, "a", "b").toDF("rep", "component")
    by_text = sizes.join(degrees, "rep", "left").join(groups, "rep", "left").select(
        "rep", F.coalesce("component", "rep").alias("group_id"), (F.coalesce("across", F.lit(0)) + F.col("copies") - 1).alias("links")
    )
    return members.join(by_text.where("links > 0"), "rep").select("id", "group_id", "links")
