import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwright.llm.near_duplicates import DuplicateSettings, _gram_hashes, _meeting, duplicate_groups, duplicate_pairs, link_recall, near_duplicate_links, normalise


def _grams(text, n=9):
    t = normalise(text)
    return {t[i : i + n] for i in range(len(t) - n + 1)}


def _brute(rows, threshold=0.5):
    sets = {i: g for i, t in rows if t is not None and (g := _grams(t))}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def test_pairs_and_groups_against_brute_force(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    texts = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(60)]
        texts.append(" ".join(base))
        for edits in (0, 1, 3, 8, 20):
            edited = base[:]
            for _ in range(edits):
                edited[rng.randrange(60)] = rng.choice(words)
            texts.append("  ".join(edited) if edits else "\n".join(edited))
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, "short"), (903, "short"), (904, "ﬁne words here"), (905, "fine  words here")]
    data = [(i, t, "x") for i, t in rows]
    df = spark.createDataFrame(data + data[:7], "page_id bigint, content string, rep string").repartition(3)
    links, members = near_duplicate_links(df, "page_id", "content")
    got = [tuple(r) for r in duplicate_pairs(links, members).collect()]
    want = _brute(rows)
    assert len(got) == len(set(got)) and len(set(got) - want) == 0
    assert len(want & set(got)) >= 0.99 * len(want) and (904, 905) in got
    groups = {r.id: (r.group_id, r.links) for r in duplicate_groups(links, members).collect()}
    degree = {i: sum(i in p for p in got) for i in {x for p in got for x in p}}
    assert {i: n for i, (_, n) in groups.items()} == degree
    assert all(groups[a][0] == groups[b][0] for a, b in got)


def _edited(rng, base, low, high):
    """``base`` with words replaced until the similarity lies within the bounds."""
    grams = _grams(base)
    while True:
        words = base.split("_")
        for k in rng.sample(range(len(words)), max(1, round(len(words) * rng.uniform(0.05, 0.3)))):
            words[k] = "".join(rng.choice("klmnopqrs") for _ in words[k])
        other = _grams("_".join(words))
        if low <= len(grams & other) / len(grams | other) <= high:
            return "_".join(words)


def test_pairs_just_above_the_threshold_are_found(spark):
    rng = random.Random(11)
    rows = []
    for size in [25] * 300 + [150] * 300:  # fewer n-grams than bins, and more
        base = "_".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(size))
        rows += [(len(rows), base), (len(rows) + 1, _edited(rng, base, 0.5, 0.57))]
    links, _ = near_duplicate_links(spark.createDataFrame(rows, "page_id bigint, content string"), "page_id", "content")
    got = {(r.a, r.b) for r in links.collect()}
    assert got <= {(k, k + 1) for k in range(0, len(rows), 2)}
    assert len({p for p in got if p[0] < 600}) >= 298 and len({p for p in got if p[0] >= 600}) >= 298


def test_rows_that_many_texts_share_lose_nothing(spark):
    """Texts over one template share many rows of pivot distances; small limits send them through the parts."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9)))
    frame = " ".join(word() for _ in range(60))
    rows = [(i, frame + " " + " ".join(word() for _ in range(rng.choice([5, 20, 60])))) for i in range(120)]
    df = spark.createDataFrame(rows + rows[:5], "page_id bigint, content string").repartition(3)
    want = _brute(rows)
    for limits in ({}, {"run_rows": 8, "deal_rows": 20}, {"run_rows": 1, "deal_rows": 1000}):
        links, members = near_duplicate_links(df, "page_id", "content", DuplicateSettings(**limits))
        got = {(r.a, r.b) for r in links.collect()}
        assert got <= want and len(got) >= 0.998 * len(want) > 500
    recall = link_recall(df, "page_id", "content", links, members, every=3).collect()
    assert sum(r.pairs for r in recall) == len([p for p in want if p[0] % 3 == 0 or p[1] % 3 == 0])
    assert all(r.recall >= 0.95 for r in recall)


def test_runs_of_equal_keys(spark):
    rng = random.Random(2)

    def met(rows, most):
        packed = [[(t, k) for t, k in rows if k % 2 == half] for half in (0, 1)]
        parts = [(half, np.array([[k for _, k in own], [t for t, _ in own]], dtype=np.int64).tobytes()) for half, all_ in enumerate(packed) for own in (all_[:50], all_[50:]) if own]
        return _meeting(spark.createDataFrame(parts, "bucket int, data binary"), most).collect()

    keys = [(t, rng.choice([7, 8, 9, t])) for t in range(3000)]
    assert {(r.a, r.key) for r in met(keys + keys[:500], 100) if r.b is None} == {(t, k) for t, k in keys if k in (7, 8, 9)}
    small = met([(1, 5), (2, 5), (3, 5), (1, 5), (4, 6), (5, 6), (6, 1)], 100)
    assert {(r.a, r.b) for r in small} == {(1, 2), (1, 3), (2, 3), (4, 5)} and len(small) == 4


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab🙂é ", max_size=30), max_size=6))
def test_gram_hashes_stay_inside_their_texts(texts):
    h, counts = _gram_hashes(texts, 9)
    assert counts.tolist() == [max(len(t) - 8, 0) for t in texts] and len(h) == counts.sum()
    start = 0
    for t, n in zip(texts, counts.tolist()):
        own = h[start : start + n]
        start += n
        assert len(np.unique(own)) == len({t[i : i + 9] for i in range(n)})


def test_empty_table_and_long_text(spark):
    empty = spark.createDataFrame([], "page_id bigint, content string")
    links, members = near_duplicate_links(empty, "page_id", "content", DuplicateSettings(blocks=16))
    assert duplicate_pairs(links, members).count() == 0 and duplicate_groups(links, members).count() == 0
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    df = spark.createDataFrame([(1, long), (2, long[:-500] + "z" * 500), (3, "a" * 50_000)], "page_id bigint, content string")
    links, members = near_duplicate_links(df, "page_id", "content")
    assert [tuple(r)[:2] for r in links.collect()] == [(1, 2)]
