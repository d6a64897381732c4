"""Exact and min-hash deduplication."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.text import WHITESPACE
from loomwright.plans.lineage import cut_lineage

_RUNS = re.compile(f"[{WHITESPACE}]+")


def exact_dedup(df: DataFrame, fields: Sequence[str], order_col: str) -> DataFrame:
    """The first row, by ``order_col``, of each combination of values; nulls are equal.

    Rows without an order come after all others; of rows with an equal order the
    one with the least hash stays, so exactly one row of each combination is
    kept.  The first is found by a map-side minimum over hashes and not by a
    window, so a value that most rows share is no hot task.
    """
    column = {c: F.col(f"`{c}`") for c in df.columns}
    key = [F.xxhash64(F.lit(seed), *[F.struct(column[f].isNull(), column[f]) for f in fields]).alias(f"__k{seed}") for seed in (1, 2)]
    plain = [column[f.name] for f in df.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    order = F.struct(column[order_col].isNull(), column[order_col], F.xxhash64(*plain))
    first = df.groupBy(*key).agg(F.min_by(F.struct(*column.values()), order).alias("__row"))
    return first.select(*[F.col("__row").getField(c).alias(c) for c in df.columns])


_MASK = np.uint64(0x9E3779B97F4A7C15)


def _shingle_set(text: str | None, k: int) -> np.ndarray:
    """Distinct 64-bit hashes of the k-character shingles of a text in NFKC, white space as underscores."""
    plain = _RUNS.sub("_", unicodedata.normalize("NFKC", text)) if text else ""
    points = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(points) < k:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(points) - k + 1, dtype=np.uint64)
        for i in range(k):
            h = h * _MASK + points[i : len(points) - k + 1 + i]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    h = np.sort(h ^ (h >> np.uint64(29)))
    return h[np.r_[True, h[1:] != h[:-1]]]  # np.unique by hashing takes four times as long


@cache
def _permutations(num_perm: int) -> tuple[np.ndarray, np.ndarray]:
    factor, offset = np.random.default_rng(1).integers(1, 2**62, (2, num_perm)).astype(np.uint64)
    return factor[:, None] | np.uint64(1), offset[:, None]


def _least(h: np.ndarray, num_perm: int) -> np.ndarray:
    """The least of the hashes under each of ``num_perm`` fixed permutations."""
    factor, offset = _permutations(num_perm)
    out = np.full(num_perm, np.uint64(2**64 - 1))
    with np.errstate(over="ignore"):
        for i in range(0, len(h), 512):  # small enough for the caches of a core
            mixed = h[None, i : i + 512] * factor
            mixed += offset
            mixed ^= mixed >> np.uint64(32)
            np.minimum(out, mixed.min(axis=1), out=out)
    return out


def shingle_hashes(text: Column, k: int = 9) -> Column:
    """Distinct hashes of a text's shingles; null and shorter texts have none."""

    @F.pandas_udf("array<bigint>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: _shingle_set(t, k).view(np.int64))

    return run(text)


def minhash(text: Column, k: int = 9, num_perm: int = 128) -> Column:
    """The min-hash signature of a text's shingle set; null for null, all -1 for shorter texts."""

    @F.pandas_udf("array<bigint>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: _least(_shingle_set(t, k), num_perm).view(np.int64), na_action="ignore")

    return run(text)


def compute_minhashes(df: DataFrame, field: str, k: int = 9, num_perm: int = 128) -> DataFrame:
    """``__minhash__<field>``: the min-hash signature of a text column."""
    return df.withColumn(f"__minhash__{field}", minhash(F.col(f"`{field}`").cast("string"), k, num_perm))


def _parities(h: np.ndarray) -> bytes:
    """A bit for each of as many bins as there are hashes, about: whether the bin holds an odd number of them."""
    bins = max(64, 1 << int(np.ceil(np.log2(max(0.7 * len(h), 1)))))
    counts = np.bincount((h & np.uint64(bins - 1)).astype(np.int64), minlength=bins)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def _close(keys: np.ndarray, sizes: np.ndarray, sketches: list[bytes], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs with an equal key that may be ``threshold`` alike.

    Left out are only pairs that cannot be: the smaller set is too small, or
    more bins differ in parity than the sets may differ in members.
    """
    order = np.lexsort((sizes, keys))
    key, size = keys[order], sizes[order].astype(np.float64)
    words = np.array([len(s) // 8 for s in sketches])[order]
    matrix = {w: np.frombuffer(b"".join(sketches[i] for i in order[words == w]), dtype=np.uint64).reshape(-1, w) for w in np.unique(words).tolist()}
    place = np.zeros(len(order), dtype=np.int64)
    for w in matrix:
        place[words == w] = np.arange(len(matrix[w]))
    folded = {(w, w): m for w, m in matrix.items()}
    most = (1 - threshold) / (1 + threshold)
    left, right = [], []
    live, step = np.arange(len(order) - 1), 1
    while len(live):
        other = live + step
        ok = (key[live] == key[other]) & (size[live] >= threshold * size[other])  # sizes ascend, so a row that fails is done
        live = live[ok]
        pairs = words[live] << 32 | words[live + step]
        for both in np.unique(pairs).tolist():
            w, v = both >> 32, both & 0xFFFFFFFF
            if (v, w) not in folded:
                folded[v, w] = np.bitwise_xor.reduce(matrix[v].reshape(-1, v // w, w), axis=1)
            some = live[pairs == both]
            for i in range(0, len(some), max(1, (1 << 20) // w)):
                x = some[i : i + max(1, (1 << 20) // w)]
                y = x + step
                odd = np.bitwise_count(matrix[w][place[x]] ^ folded[v, w][place[y]]).sum(axis=1, dtype=np.int64)
                near = odd <= most * (size[x] + size[y]) + 1e-6
                left.append(x[near])
                right.append(y[near])
        step += 1
        live = live[live + step < len(order)]
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return order[np.concatenate(left)], order[np.concatenate(right)]


def minhash_pairs(
    df: DataFrame, id_col: str, field: str, threshold: float = 0.8, k: int = 9, bands: int = 16, rows: int = 4, bucket_rows: int = 20_000, most_marks: int = 4_000_000
) -> DataFrame:
    """``(a, b, jaccard)``: pairs that share a band and whose shingle sets are at least ``threshold`` alike.

    Of equal texts the one with the least id stands for all, so copies do not
    multiply; the similarity is exact.  Neither texts nor shingle sets travel to
    find pairs: texts that share a band meet with the sizes of their sets and the
    parities of hash bins, which bound the similarity from above, and a pair is
    written only if that bound allows it.  Then the texts of such pairs alone are
    fetched; marks of up to ``most_marks`` of their ids keep others from the join.
    """
    text = F.col(f"`{field}`").cast("string")
    id_type = df.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
    named = df.where(text.isNotNull() & F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.lit(1), text).alias("h1"), F.xxhash64(F.lit(2), text).alias("h2"), text.alias("t")
    )

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [_shingle_set(t, k) for t in batch["t"]]
            keep = np.array([len(h) > 0 for h in sets], dtype=bool)
            sets = [h for h in sets if len(h)]
            out = batch.loc[keep, ["id", "h1", "h2"]].copy()
            out["n"] = [len(h) for h in sets]
            out["m"] = [_least(h, bands * rows).view(np.int64) for h in sets]
            out["sketch"] = [_parities(h) for h in sets]
            yield out

    signed = named.mapInPandas(sign, f"id {id_type}, h1 bigint, h2 bigint, n int, m array<bigint>, sketch binary")
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.slice("m", b * rows + 1, rows)))
    one = signed.select("h1", "h2", "id", F.struct("id", "n", keys.alias("keys"), "sketch").alias("x")).groupBy("h1", "h2").agg(F.min_by("x", "id").alias("x"))
    one = cut_lineage(one.select("h1", "h2", "x.*"))
    in_band = Window.partitionBy("key").orderBy("id")
    banded = one.select("id", F.explode("keys").alias("key"))
    shared = cut_lineage(
        banded.withColumns({"before": F.lag("id").over(in_band), "after": F.lead("id").over(in_band)}).where("before is not null or after is not null").select("key", "id")
    )
    buckets = max(1, -(-shared.count() // bucket_rows))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = _close(pdf["key"].to_numpy(), pdf["n"].to_numpy(), pdf["sketch"].tolist(), max(threshold - 1e-6, 0.0))
        ids = pdf["id"].to_numpy()
        a, b = ids[x], ids[y]
        return pd.DataFrame({"a": np.where(a < b, a, b), "b": np.where(a < b, b, a)}).drop_duplicates()

    met = shared.join(one.select("id", "n", "sketch"), "id").withColumn("bucket", F.pmod("key", F.lit(buckets)))
    pairs = cut_lineage(met.groupBy("bucket").applyInPandas(meet, f"a {id_type}, b {id_type}").distinct().where("a < b"))
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = cut_lineage(one.select("id", "h1", "h2").join(ids, "id"))
    if wanted.count() <= most_marks:
        marks = df.sparkSession.sparkContext.broadcast(np.unique(wanted.select("h1").toPandas()["h1"].to_numpy(dtype=np.int64)))

        @F.pandas_udf("boolean")
        def marked(h: pd.Series) -> pd.Series:
            m = marks.value
            return pd.Series(m[np.minimum(np.searchsorted(m, h.to_numpy()), len(m) - 1)] == h.to_numpy()) if len(m) else pd.Series(np.zeros(len(h), bool))

        named = named.where(marked("h1"))
    texts = cut_lineage(named.join(wanted, ["id", "h1", "h2"]).groupBy("id", "h1", "h2").agg(F.first("t").alias("t")).select("id", "t"))
    full = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")

    @F.pandas_udf("double")
    def jaccard(ta: pd.Series, tb: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(ta, tb):
            sx, sy = _shingle_set(x, k), _shingle_set(y, k)
            common = len(np.intersect1d(sx, sy, assume_unique=True))
            out.append(common / (len(sx) + len(sy) - common))
        return pd.Series(out, dtype=float)

    return full.select("a", "b", F.round(jaccard("ta", "tb"), 6).alias("jaccard")).where(F.col("jaccard") >= threshold)


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row of each key by a window; for keys of bounded size."""
    window = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n")
