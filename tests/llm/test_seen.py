import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwright.llm.seen import MinimalPerfectHash, SealedSegment, SeenKeys, seal_earlier, seen_before, seen_in_batch, state_size, wrong_answers


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=400))
def test_slots_are_a_permutation(keys):
    keys = np.array(sorted(keys), dtype=np.uint64)
    slots = MinimalPerfectHash(keys).slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))


def test_foreign_keys_mostly_miss_and_own_keys_never():
    rng = np.random.default_rng(3)
    keys, prints = (rng.integers(0, 2**63, 40_000).astype(np.uint64) for _ in range(2))
    state = SeenKeys(seal_keys=5_000, fingerprint_bits=8)
    first = state.judge(keys[:20_000], prints[:20_000])
    state.judge(keys[20_000:], prints[20_000:])
    assert state.segments and first.mean() < 0.05
    assert state.judge(keys, prints).all()
    new = state.judge(rng.integers(0, 2**63, 20_000).astype(np.uint64), rng.integers(0, 2**63, 20_000).astype(np.uint64))
    assert 0 < new.mean() < 2 * len(state.segments) / 256


def _brute(rows, earlier):
    keys, out = {k for (k,) in earlier if k is not None}, set()
    for no, key, *_ in sorted(rows):
        if key is not None:
            if key in keys:
                out.add(no)
            keys.add(key)
    return out


def test_against_brute_force_with_a_hot_key(spark):
    rng = random.Random(4)
    rows = [(n, rng.choice(["hot", "", None, f"k{rng.randrange(300)}", f"K{rng.randrange(300)} "]), "x") for n in range(3000)]
    rng.shuffle(rows)
    earlier = [("k1",), ("k1",), (None,), ("K7 ",)]
    df = spark.createDataFrame(rows, "arrival_no bigint, content string, seen string").repartition(5)
    old = spark.createDataFrame(earlier, "content string")
    judged, state = seen_before(df, old, seal_keys=50, parts=3)
    got = {r.arrival_no for r in judged.where("seen").collect()}
    assert got == _brute(rows, earlier)
    assert judged.count() == len(rows)
    assert wrong_answers(judged, df, old).first()[:3] == (3000, 0, 0)
    size = state_size(state).first()
    assert size.segments > 3 and size.sealed_keys + size.exact_keys == len({k for _, k, _ in rows if k is not None} | {"k1", "K7 "})


def test_state_passes_from_batch_to_batch(spark):
    rng = random.Random(9)
    rows = [(n, f"k{rng.randrange(900)}") for n in range(2500)]
    old = spark.createDataFrame([("k5",), (None,)], "content string")
    state, got = seal_earlier(old, parts=2, seal_keys=40), set()
    for start in range(0, 2500, 500):
        batch = spark.createDataFrame(rows[start : start + 500], "arrival_no bigint, content string")
        judged, state = seen_in_batch(batch, state, seal_keys=40)
        got |= {r.arrival_no for r in judged.where("seen").collect()}
    assert got == _brute(rows, [("k5",), (None,)])
    assert 2 <= state_size(state).first().segments < 40


def test_segments_survive_writing_and_grow_slowly():
    rng = np.random.default_rng(6)
    keys, prints = (rng.integers(0, 2**63, 60_000).astype(np.uint64) for _ in range(2))
    state = SeenKeys(seal_keys=100)
    state.judge(keys, prints)
    assert len(state.segments) < 40 and len(state.recent()[0]) <= 0.3 * 60_000
    again = [SealedSegment.from_bytes(x.to_bytes()) for x in state.segments]
    for a, b in zip(state.segments, again):
        assert (a.contains(keys, prints) == b.contains(keys, prints)).all()


def test_one_key_with_two_prints():
    keys, prints = np.array([7, 7, 7, 8], dtype=np.uint64), np.array([1, 2, 1, 1], dtype=np.uint64)
    state = SeenKeys(seal_keys=2)
    assert state.judge(keys, prints).tolist() == [False, False, True, False]
    assert state.judge(keys, prints).all()


def test_short_fingerprints_are_measured(spark):
    df = spark.range(4000).selectExpr("id as arrival_no", "concat('k', id) as content")
    old = spark.createDataFrame([("z",)], "content string")
    judged, _ = seen_before(df, old, fingerprint_bits=4, seal_keys=200, parts=2)
    row = wrong_answers(judged, df, old).first()
    assert row.wrongly_new == 0 and row.wrongly_seen > 0 and row.wrong_rate == round(row.wrongly_seen / 4000, 9)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "arrival_no bigint, content string")
    assert seen_before(empty, empty.select("content"))[0].count() == 0
    assert seen_before(spark.createDataFrame([(1, "a")], "arrival_no bigint, content string"))[0].first().seen is False
