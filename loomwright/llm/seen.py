"""Has this key been seen before? (problem 3)

Rows are judged in arrival order.  Keys are spread over parts by hash.  Of each
part the newest keys are an exact set; when that set has grown by a given part
of the keys sealed so far it is sealed: a minimal perfect hash gives each of
its keys a slot, and only a fingerprint per slot is kept.  A key is called seen
when the exact set holds it or when some sealed segment has its fingerprint in
its slot.  Segments grow geometrically, so their number follows the logarithm
of the keys.  Memory is about ``fingerprint_bits`` + 6 bits for each sealed key
and 128 bits for each of the exact set, a fifth of all keys.

The segments and exact sets are rows of a table, which the next batch of
arrivals starts from (:class:`SeenState`).

A new key is wrongly called seen with a chance of at most
``segments / 2**fingerprint_bits``; a seen key is never called new.
:func:`wrong_answers` measures the rate against the exact answer.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.plans.lineage import cut_lineage

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class MinimalPerfectHash:
    """Slots 0..n-1 for n distinct 64-bit keys; any other key gets some slot or -1.

    Level by level, keys that are alone at their place of a bit array are
    settled there and the others go on to the next, smaller array.  A slot is
    the number of set bits before the key's bit.
    """

    def __init__(self, keys: np.ndarray, gamma: float = 2.0) -> None:
        self.words: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.size = len(keys)
        total = 0
        with np.errstate(over="ignore"):
            while len(keys):
                bits = max(64, -(-int(gamma * len(keys)) // 64) * 64)
                place = self._place(keys, len(self.sizes), bits)
                alone = np.bincount(place, minlength=bits) == 1
                packed = np.packbits(alone, bitorder="little").view(np.uint64)
                counts = np.bitwise_count(packed).astype(np.int64)
                self.words.append(packed)
                self.before.append((total + np.cumsum(counts) - counts).astype(np.int64))
                self.sizes.append(bits)
                total += int(counts.sum())
                keys = keys[~alone[place]]
                if len(self.sizes) > 60:
                    raise ValueError("the keys are not distinct")

    @staticmethod
    def _place(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        return (_mix(keys + np.uint64(level + 1) * _GOLDEN) % np.uint64(bits)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, dtype=np.int64)
        open_rows = np.arange(len(keys))
        with np.errstate(over="ignore"):
            for level, bits in enumerate(self.sizes):
                if not len(open_rows):
                    break
                place = self._place(keys[open_rows], level, bits)
                word, bit = place >> 6, (place & 63).astype(np.uint64)
                w = self.words[level][word]
                hit = (w >> bit) & np.uint64(1) == 1
                below = np.bitwise_count(w & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
                out[open_rows[hit]] = (self.before[level][word] + below)[hit]
                open_rows = open_rows[~hit]
        return out


class SealedSegment:
    """Answers whether a key was sealed here, from slots and fingerprints alone."""

    def __init__(self, keys: np.ndarray, prints: np.ndarray, fingerprint_bits: int) -> None:
        self.mask = np.uint64((1 << fingerprint_bits) - 1)
        self.hash = MinimalPerfectHash(keys)
        kind = np.uint16 if fingerprint_bits <= 16 else np.uint32 if fingerprint_bits <= 32 else np.uint64
        self.prints = np.zeros(len(keys), dtype=kind)
        self.prints[self.hash.slots(keys)] = (prints & self.mask).astype(kind)

    def contains(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        slot = self.hash.slots(keys)
        known = slot >= 0
        known[known] = self.prints[slot[known]] == (prints[known] & self.mask)
        return known


    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        h = self.hash
        np.savez(out, mask=self.mask, prints=self.prints, sizes=np.array(h.sizes, dtype=np.int64), words=np.concatenate(h.words), before=np.concatenate(h.before))
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> SealedSegment:
        with np.load(io.BytesIO(raw)) as z:
            own = cls.__new__(cls)
            own.mask, own.prints = z["mask"][()], z["prints"]
            own.hash = MinimalPerfectHash(np.zeros(0, np.uint64))
            own.hash.size, own.hash.sizes = len(own.prints), z["sizes"].tolist()
            cuts = np.cumsum(z["sizes"] // 64)[:-1]
            own.hash.words, own.hash.before = np.split(z["words"], cuts), np.split(z["before"], cuts)
        return own


def _sorted_pairs(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((prints, keys))
    return keys[order], prints[order]


class SeenKeys:
    """Keys in order of arrival: an exact set of the newest, sealed segments of the rest.

    The exact set is sealed when it has ``seal_keys`` keys and ``growth`` times
    as many as are sealed already.  It is kept as sorted runs of which each is
    over twice as long as the next.
    """

    def __init__(self, seal_keys: int = 256, fingerprint_bits: int = 32, growth: float = 0.25) -> None:
        self.seal_keys = seal_keys
        self.fingerprint_bits = fingerprint_bits
        self.growth = growth
        self.segments: list[SealedSegment] = []
        self.sealed = 0
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []

    def add_segment(self, segment: SealedSegment) -> None:
        self.segments.append(segment)
        self.sealed += len(segment.prints)

    def recent(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys, prints) of the exact set."""
        empty = np.zeros(0, dtype=np.uint64)
        return tuple(np.concatenate([empty, *(run[i] for run in self.runs)]) for i in (0, 1))

    def remember(self, keys: np.ndarray, prints: np.ndarray) -> None:
        """New, distinct pairs into the exact set."""
        if len(keys):
            self.runs.append(_sorted_pairs(keys, prints))
        while len(self.runs) > 1 and len(self.runs[-2][0]) <= 2 * len(self.runs[-1][0]):
            a, b = self.runs.pop(), self.runs.pop()
            self.runs.append(_sorted_pairs(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])))

    def seal(self) -> None:
        keys, prints = self.recent()
        if not len(keys):
            return
        keys, prints = _sorted_pairs(keys, prints)
        first = np.r_[True, keys[1:] != keys[:-1]]
        self.add_segment(SealedSegment(keys[first], prints[first], self.fingerprint_bits))
        self.runs = []
        self.remember(keys[~first], prints[~first])  # a second print of one key waits for the next segment

    def _in_recent(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        known = np.zeros(len(keys), dtype=bool)
        for own_keys, own_prints in self.runs:
            at = np.searchsorted(own_keys, keys)
            live = np.flatnonzero(at < len(own_keys))
            while len(live):
                live = live[own_keys[at[live]] == keys[live]]
                known[live] |= own_prints[at[live]] == prints[live]
                at[live] += 1
                live = live[at[live] < len(own_keys)]
        return known

    def judge(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """True for each key that was there before, in this call or an earlier one."""
        step = max(self.seal_keys, 1)
        parts = [self._judge(keys[i : i + step], prints[i : i + step]) for i in range(0, len(keys), step)]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=bool)

    def _judge(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        order = np.lexsort((np.arange(len(keys)), prints, keys))
        again = np.r_[False, (keys[order][1:] == keys[order][:-1]) & (prints[order][1:] == prints[order][:-1])]
        seen = np.zeros(len(keys), dtype=bool)
        seen[order[again]] = True
        for segment in reversed(self.segments):
            rest = np.flatnonzero(~seen)
            seen[rest] = segment.contains(keys[rest], prints[rest])
        rest = np.flatnonzero(~seen)
        seen[rest] = self._in_recent(keys[rest], prints[rest])
        new = np.flatnonzero(~seen)
        self.remember(keys[new], prints[new])
        # a later copy of a key that a segment or the exact set had is seen as well: it was marked before they were asked
        if sum(len(run[0]) for run in self.runs) >= max(self.seal_keys, self.growth * self.sealed):
            self.seal()
        return seen


@dataclass(frozen=True)
class SeenState:
    """What is kept of the keys so far: ``(part, kind, keys, raw)`` rows, kind sealed or recent, and the number of parts."""

    table: DataFrame
    parts: int
    fingerprint_bits: int


_STATE = "part int, kind string, keys bigint, raw binary"


def _advance(
    rows: DataFrame, state: SeenState, key_col: str, order_col: str | None, seal_keys: int, seal_all: bool
) -> DataFrame:
    """Answers (``order``, ``seen``; none without ``order_col``) and the new rows of the state, in one table."""
    key = F.col(f"`{key_col}`")
    order_type = rows.schema[order_col].dataType.simpleString() if order_col else "bigint"
    order = F.col(f"`{order_col}`") if order_col else F.lit(None).cast("bigint")
    wanted = rows if order_col else rows.where(key.isNotNull())
    hashed = wanted.select(
        order.alias("__order"),
        F.xxhash64(F.lit("key"), key).alias("__key"),
        F.xxhash64(F.lit("print"), key).alias("__print"),
        key.isNull().alias("__null"),
    )

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.sort_values("__order", kind="stable")
            again = batch.duplicated(["__key", "__print"]) & ~batch["__null"]
            batch["__seen"] = again
            yield batch if order_col else batch[~again]

    middle = f"__order {order_type}, __key bigint, __print bigint, __null boolean, __seen boolean"
    local = hashed.mapInPandas(settle, middle)
    spot = F.when(F.col("__null") | F.col("__seen"), F.xxhash64("__order")).otherwise(F.col("__key"))
    news = local.withColumns({"part": F.pmod(spot, F.lit(state.parts)).cast("int"), "__stage": F.lit(1), "kind": F.lit(None).cast("string"), "raw": F.lit(None).cast("binary")})
    # no nulls among integers, which would travel as floats
    none = F.lit(0).cast(order_type) if order_type in ("tinyint", "smallint", "int", "bigint") else F.lit(None).cast(order_type)
    known = state.table.select("part", "kind", "raw").withColumns(
        {"__stage": F.lit(0), "__order": none, "__key": F.lit(0).cast("bigint"), "__print": F.lit(0).cast("bigint"), "__null": F.lit(True), "__seen": F.lit(False)}
    )
    together = news.unionByName(known).repartition(max(1, -(-state.parts // 4)), "part")
    ordered = together.sortWithinPartitions("part", "__stage", "__order")
    bits = state.fingerprint_bits

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, own, old = None, SeenKeys(seal_keys, bits), 0

        def kept() -> list[tuple]:
            if seal_all:
                own.seal()
            out = [(part, "sealed", len(x.prints), x.to_bytes()) for x in own.segments[old:]]
            keys, prints = own.recent()
            return out + ([(part, "recent", len(keys), keys.tobytes() + prints.tobytes())] if len(keys) else [])

        def rows_of(state_rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(state_rows, columns=["part", "kind", "keys", "raw"])
            return out.assign(order=None, seen=None)[names]

        names = ["order", "seen", "part", "kind", "keys", "raw"]
        for batch in batches:
            if not len(batch):
                continue
            cuts = np.flatnonzero(np.diff(batch["part"].to_numpy())) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]):
                piece = batch.iloc[a:b]
                if (here := int(piece["part"].iloc[0])) != part:
                    if part is not None:
                        yield rows_of(kept())
                    part, own, old = here, SeenKeys(seal_keys, bits), 0
                fresh = piece["__stage"].to_numpy() == 1
                for kind, raw in zip(piece["kind"][~fresh], piece["raw"][~fresh]):
                    if kind == "sealed":
                        own.add_segment(SealedSegment.from_bytes(raw))
                        old += 1
                    else:
                        pairs = np.frombuffer(raw, dtype=np.uint64).reshape(2, -1)
                        own.remember(pairs[0], pairs[1])
                piece = piece[fresh]
                seen = piece["__seen"].to_numpy(dtype=bool).copy()
                open_rows = np.flatnonzero(~seen & ~piece["__null"].to_numpy(dtype=bool))
                keys, prints = (piece[c].to_numpy(dtype=np.int64)[open_rows].view(np.uint64) for c in ("__key", "__print"))
                seen[open_rows] = own.judge(keys, prints)
                if order_col and len(piece):
                    yield pd.DataFrame({"order": piece["__order"], "seen": seen, "part": None, "kind": None, "keys": None, "raw": None})[names]
        if part is not None:
            yield rows_of(kept())

    columns = ["part", "__stage", "kind", "raw", "__order", "__key", "__print", "__null", "__seen"]
    return cut_lineage(ordered.select(*columns).mapInPandas(judge, f"order {order_type}, seen boolean, {_STATE}"))


def seal_earlier(
    earlier: DataFrame, key_col: str = "content", fingerprint_bits: int = 32, parts: int | None = None, seal_keys: int = 256
) -> SeenState:
    """The state that holds the keys of a table, all of them sealed; nulls are no keys.

    Without ``parts`` there are four for each shuffle partition, and one for
    each million rows where that is more.  A table without rows gives a state
    without keys.
    """
    spark = earlier.sparkSession
    if parts is None:
        parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-earlier.count() // 1_000_000))
    empty = SeenState(spark.createDataFrame([], _STATE), parts, fingerprint_bits)
    made = _advance(earlier.select(key_col), empty, key_col, None, seal_keys, True)
    return SeenState(made.where("kind is not null").select("part", "kind", "keys", "raw"), parts, fingerprint_bits)


def seen_in_batch(
    arrivals: DataFrame, state: SeenState, key_col: str = "content", order_col: str = "arrival_no", seal_keys: int = 256
) -> tuple[DataFrame, SeenState]:
    """(``(order_col, seen)`` for every row of ``arrivals``, the state after them).

    ``seen`` is true when the key is in the state or in a row with a lower
    ``order_col``; false for null keys.  The empty string is a key.  Of rows
    with an equal order number one goes first.  Keys are compared as exact
    strings through two independent 64-bit hashes.

    Before the shuffle each Arrow batch settles its own repetitions, so a key
    that holds a third of all rows sends one row per batch and not all of them.
    """
    made = _advance(arrivals, state, key_col, order_col, seal_keys, False)
    answers = made.where("kind is null").select(F.col("order").alias(order_col), "seen")
    fresh = made.where("kind is not null").select("part", "kind", "keys", "raw")
    return answers, SeenState(state.table.where("kind = 'sealed'").unionByName(fresh), state.parts, state.fingerprint_bits)


def seen_before(
    arrivals: DataFrame,
    earlier: DataFrame | None = None,
    key_col: str = "content",
    order_col: str = "arrival_no",
    fingerprint_bits: int = 32,
    seal_keys: int = 256,
    parts: int | None = None,
) -> tuple[DataFrame, SeenState]:
    """:func:`seen_in_batch` for one batch after the keys of ``earlier``, which are sealed first."""
    spark = arrivals.sparkSession
    if parts is None:
        parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-arrivals.count() // 1_000_000))
    if earlier is None:
        earlier = arrivals.where(F.lit(False))
    state = seal_earlier(earlier, key_col, fingerprint_bits, parts, seal_keys)
    return seen_in_batch(arrivals, state, key_col, order_col, seal_keys)


def state_size(state: SeenState) -> DataFrame:
    """One row: sealed segments, keys in them, keys in exact sets, and bits for each key."""
    keys = F.coalesce(F.sum("keys"), F.lit(0))
    return state.table.agg(
        F.count_if(F.col("kind") == "sealed").alias("segments"),
        F.coalesce(F.sum(F.when(F.col("kind") == "sealed", F.col("keys"))), F.lit(0)).alias("sealed_keys"),
        F.coalesce(F.sum(F.when(F.col("kind") == "recent", F.col("keys"))), F.lit(0)).alias("exact_keys"),
        F.round(8 * F.coalesce(F.sum(F.length("raw")), F.lit(0)) / F.greatest(keys, F.lit(1)), 1).alias("bits_per_key"),
    )


def wrong_answers(
    judged: DataFrame, arrivals: DataFrame, earlier: DataFrame, key_col: str = "content", order_col: str = "arrival_no"
) -> DataFrame:
    """One row: answers, those wrongly called seen and wrongly called new, and the rate.

    The exact answer comes from the lowest order number of each key, found with
    a map-side minimum, so a hot key costs one row per task.
    """
    key = F.col(f"`{key_col}`")
    first = arrivals.where(key.isNotNull()).groupBy(key.alias("__k")).agg(F.min(order_col).alias(order_col))
    new = first.join(earlier.select(key.alias("__k")).distinct(), "__k", "left_anti").select(order_col)
    new = new.unionByName(arrivals.where(key.isNull()).select(order_col)).withColumn("__new", F.lit(True))
    both = judged.join(new, order_col, "left").select("seen", F.coalesce("__new", F.lit(False)).alias("new"))
    return both.agg(
        F.count("*").alias("answers"),
        F.count_if(F.col("seen") & F.col("new")).alias("wrongly_seen"),
        F.count_if(~F.col("seen") & ~F.col("new")).alias("wrongly_new"),
        F.round(F.count_if(F.col("seen") == F.col("new")) / F.greatest(F.count("*"), F.lit(1)), 9).alias("wrong_rate"),
    )
