"""Embedding columns as compact unit vectors, and k-means on a bounded sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.plans.lineage import spread

SCALE = 32_767


def pack(unit: np.ndarray) -> np.ndarray:
    """Unit vectors as 16-bit integers; each value is off by at most 2e-5."""
    return np.rint(unit * SCALE).astype(np.int16)


def unpack(column, dim: int) -> np.ndarray:
    """Rows of packed vectors, as float32 unit vectors."""
    raw = np.frombuffer(b"".join(column), dtype=np.int16).reshape(-1, dim).astype(np.float32)
    return raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-9)


def usable_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, unit vectors) of the lists with exactly ``dim`` finite numbers, not all zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    rows = np.flatnonzero(lengths == dim)
    if not len(rows):
        return rows, np.zeros((0, dim), dtype=np.float32)
    lists = column.take(pa.array(rows))
    values = lists.flatten()
    flat = np.asarray(values.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)
    finite = np.isfinite(flat).all(axis=1)
    top = np.abs(np.where(np.isfinite(flat), flat, 0)).max(axis=1)
    good = finite & (top > 0)
    flat = flat[good] / top[good, None]
    return rows[good], (flat / np.linalg.norm(flat, axis=1, keepdims=True)).astype(np.float32)


def packed_rows(df: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """``(id, h, q)`` of every row with a usable vector: q its packed unit vector (2 * dim bytes), h a hash of q. Null ids are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, unit = usable_rows(batch.column(1), dim)
            packed = pack(unit).tobytes()
            width = 2 * dim
            each = [packed[i * width : (i + 1) * width] for i in range(len(rows))]
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, each), dtype=np.uint64, count=len(each)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(h), pa.array(each, pa.binary())], names=["id", "h", "q"])

    narrow = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vector_col}`").cast("array<float>").alias("v")).where("id is not null")
    return spread(narrow).mapInArrow(run, "id bigint, h bigint, q binary")


def packed_vectors(df: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """``(id, q)``: each id with a usable vector once; rows that repeat an id keep the least q."""
    return packed_rows(df, id_col, vector_col, dim).groupBy("id").agg(F.min("q").alias("q"))


def sample_vectors(packed: DataFrame, rows: int, total: int, dim: int, what: str, key: str = "id") -> np.ndarray:
    """About ``rows`` of ``total`` vectors, drawn by a hash of ``key``, to fit centres on."""
    share = min(1.0, rows / max(total, 1))
    draw = F.pmod(F.xxhash64(F.lit(what), key), F.lit(1_000_000_000)) < int(share * 1_000_000_000)
    drawn = packed.where(draw).select("q").toArrow()
    return unpack(drawn.column("q").to_pylist(), dim) if drawn.num_rows else np.zeros((0, dim), dtype=np.float32)


def most_alike(sims: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns, values) of the ``most`` largest values of each row, in no order.

    The largest values lie in the blocks with the largest maxima, so only those
    are partitioned and not whole rows.
    """
    n, m = sims.shape
    most = min(most, m)
    width = int(np.sqrt(m / most)) if most else 0
    if width < 2:
        at = np.argpartition(sims, m - most, axis=1)[:, m - most :] if 0 < most < m else np.tile(np.arange(most), (n, 1))
        return at, np.take_along_axis(sims, at, 1)
    blocks = m // width
    maxima = sims[:, : width * blocks].reshape(n, width, blocks).max(1)
    best = np.argpartition(maxima, blocks - most, axis=1)[:, blocks - most :]
    inside = (best[:, None, :] + blocks * np.arange(width)[None, :, None]).reshape(n, -1)
    tail = np.broadcast_to(np.arange(width * blocks, m), (n, m - width * blocks))
    columns = np.concatenate([inside, tail], axis=1)
    values = np.take_along_axis(sims, columns, 1)
    at = np.argpartition(values, values.shape[1] - most, axis=1)[:, -most:]
    return np.take_along_axis(columns, at, 1), np.take_along_axis(values, at, 1)


def _means(x: np.ndarray, near: np.ndarray, k: int, old: np.ndarray) -> np.ndarray:
    order = np.argsort(near, kind="stable")
    counts = np.bincount(near, minlength=k)
    filled = np.flatnonzero(counts)
    sums = np.add.reduceat(x[order], (np.cumsum(counts) - counts)[filled], axis=0)
    out = old.copy()
    out[filled] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return out


def nearest(x: np.ndarray, centres: np.ndarray, block: int = 4096) -> np.ndarray:
    return np.concatenate([np.argmax(x[i : i + block] @ centres.T, axis=1) for i in range(0, len(x), block)]) if len(x) else np.zeros(0, np.int64)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 6, balance: float = 2.5, seed: int = 11) -> np.ndarray:
    """Centres of about ``k`` balanced cells: cells of over ``balance`` times the mean size are halved."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        centres = _means(x, nearest(x, centres), len(centres), centres)
    for _ in range(3):
        near = nearest(x, centres)
        sizes = np.bincount(near, minlength=len(centres))
        large = np.flatnonzero(sizes > max(balance * len(x) / k, 8))
        extra = []
        for cell in large:
            own = x[near == cell]
            pair = own[rng.permutation(len(own))[:2]]
            for _ in range(4):
                pair = _means(own, nearest(own, pair), 2, pair)
            centres[cell] = pair[0]
            extra.append(pair[1])
        if not extra:
            break
        centres = np.vstack([centres, np.array(extra)])
        centres = _means(x, nearest(x, centres), len(centres), centres)
    return centres[np.bincount(nearest(x, centres), minlength=len(centres)) > 0].astype(np.float32)


def tree_kmeans(x: np.ndarray, k: int, direct: int = 1024, seed: int = 11) -> np.ndarray:
    """Centres of about ``k`` balanced cells; for large ``k`` in two levels, so that the work grows with ``len(x) * sqrt(k)``."""
    if k <= direct or len(x) <= direct:
        return spherical_kmeans(x, k, seed=seed)
    coarse = spherical_kmeans(x, int(np.sqrt(k)), seed=seed)
    near = nearest(x, coarse)
    parts = []
    for cell in range(len(coarse)):
        own = x[near == cell]
        if len(own):
            parts.append(spherical_kmeans(own, max(1, round(k * len(own) / len(x))), seed=seed + cell))
    return np.concatenate(parts)


class CellRouter:
    """The nearest centres of vectors: all of them are compared up to ``direct``, beyond that those of the nearest groups of centres."""

    def __init__(self, centres: np.ndarray, direct: int = 512, groups_asked: int = 8) -> None:
        self.centres = centres
        self.asked = groups_asked
        self.groups = spherical_kmeans(centres, int(np.sqrt(len(centres)))) if len(centres) > direct else None
        if self.groups is not None:
            near = nearest(centres, self.groups)
            self.members = [np.flatnonzero(near == g) for g in range(len(self.groups))]

    def top(self, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(centres, best first, -1 where there are no more; similarities) of each row."""
        most = min(most, len(self.centres))
        if self.groups is None:
            return self._best(x @ self.centres.T, most)
        ids = np.full((len(x), most), -1, dtype=np.int64)
        sims = np.full((len(x), most), -2, dtype=np.float32)
        groups, _ = self._best(x @ self.groups.T, self.asked)
        for g in np.unique(groups):
            rows = np.flatnonzero((groups == g).any(1))
            at, s = self._best(x[rows] @ self.centres[self.members[g]].T, most)
            both = np.concatenate([sims[rows], s], axis=1)
            names = np.concatenate([ids[rows], self.members[g][at]], axis=1)
            order = np.argsort(-both, axis=1, kind="stable")[:, :most]
            ids[rows], sims[rows] = np.take_along_axis(names, order, 1), np.take_along_axis(both, order, 1)
        return ids, sims

    @staticmethod
    def _best(sims: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        most = min(most, sims.shape[1])
        at = np.argpartition(-sims, most - 1, axis=1)[:, :most]
        values = np.take_along_axis(sims, at, 1)
        order = np.argsort(-values, axis=1, kind="stable")
        return np.take_along_axis(at, order, 1), np.take_along_axis(values, order, 1)
