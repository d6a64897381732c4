import numpy as np
import pytest

from pyspark.sql import functions as F

from loomwright.llm import clusters
from loomwright.llm.clusters import ClusterSettings, density_clusters, describe_clusters
from loomwright.llm.neighbours import CentroidGraph, SearchSettings, most_similar, recall_of, similar_pairs
from loomwright.llm.vectors import CellRouter, most_alike, spherical_kmeans, tree_kmeans

DIM = 16


def _unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(2)
    centres = np.eye(DIM)[:5]
    x = np.vstack([c + 0.12 * rng.normal(size=(n, DIM)) for c, n in zip(centres, (300, 120, 60, 20, 8))])
    noise = rng.normal(size=(60, DIM))
    return _unit(np.vstack([x, noise])), np.r_[np.repeat(np.arange(5), (300, 120, 60, 20, 8)), np.full(60, -1)]


@pytest.fixture(scope="module")
def table(spark, data):
    rows = [(i, [float(v) for v in x * (1 + i % 3)], "q") for i, x in enumerate(data[0])]
    odd = [(9001, None, "q"), (9002, [], "q"), (9003, [1.0] * 15, "q"), (9004, [0.0] * DIM, "q"), (9005, [float("nan")] + [1.0] * (DIM - 1), "q"), (None, [1.0] * DIM, "q")]
    return spark.createDataFrame(rows + rows[:9] + odd, f"id bigint, v array<float>, cluster string").repartition(3)


def test_neighbours_against_brute_force(table, data):
    settings = SearchSettings(list_rows=40, group_rows=200, probes=10, probe_ratio=3.0)
    got = most_similar(table, "id", "v", DIM, settings=settings).collect()
    x = data[0]
    s = x @ x.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i])[:5]}
    have = {(r.id, r.neighbour) for r in got}
    assert 5 * len(x) * 0.99 <= len(have) == len(got) <= 5 * len(x)
    assert len(have & want) / len(want) > 0.95
    assert all(abs(r.similarity - s[r.id, r.neighbour]) < 1e-3 for r in got)
    row = recall_of(most_similar(table, "id", "v", DIM, settings=settings), table, "id", "v", DIM).first()
    assert row.recall > 0.9 and row.queries == len([i for i in range(len(x)) if i % 20 == 0])


def test_many_equal_vectors(spark):
    rng = np.random.default_rng(5)
    same = [float(v) for v in np.eye(DIM)[0]]
    rows = [(i, same) for i in range(200)] + [(1000 + i, [float(v) for v in r]) for i, r in enumerate(_unit(rng.normal(size=(30, DIM))))]
    df = spark.createDataFrame(rows, "id bigint, v array<float>")
    near = most_similar(df, "id", "v", DIM, settings=SearchSettings(list_rows=20, probes=10, probe_ratio=5.0))
    by_id = {}
    for r in near.collect():
        by_id.setdefault(r.id, []).append((r.rank, r.neighbour))
    assert len(by_id) == 230 and all(len(v) == 5 for v in by_id.values())
    assert [n for _, n in sorted(by_id[150])] == [0, 1, 2, 3, 4]
    assert [n for _, n in sorted(by_id[2])] == [0, 1, 3, 4, 5]
    pairs = {tuple(r) for r in similar_pairs(near, 0.99).collect()}
    assert pairs == {(min(i, j), max(i, j)) for i in range(200) for j in [k for k in range(6) if k != i][:5]}


def test_graph_search_finds_the_nearest_centroids():
    rng = np.random.default_rng(0)
    centres = _unit(rng.normal(size=(400, DIM))).astype(np.float32)
    queries = _unit(rng.normal(size=(200, DIM))).astype(np.float32)
    ids, sims = CentroidGraph(centres, 8).search(queries, beam=16, steps=20)
    assert (ids[:, 0] == (queries @ centres.T).argmax(1)).mean() > 0.95
    assert (np.diff(sims, axis=1) <= 1e-6).all()


def test_graph_search_misses_no_nearest_centroid_among_many():
    rng = np.random.default_rng(4)
    centres = _unit(rng.normal(size=(6000, 64))).astype(np.float32)  # as far apart as clusters are
    queries = _unit(centres[:300] + 0.08 * rng.normal(size=(300, 64))).astype(np.float32)
    ids, sims = CentroidGraph(centres, 8).search(queries, SearchSettings.beam, SearchSettings.steps)
    exact = np.argsort(-(queries @ centres.T), axis=1)[:, : SearchSettings.probes]
    assert (ids[:, 0] == np.arange(300)).all()
    assert (np.sort(ids[:, : SearchSettings.probes], axis=1) == np.sort(exact, axis=1)).mean() > 0.999
    # beyond ``direct`` centroids a walk goes on from the entries and gives no centroid twice
    ids, _ = CentroidGraph(centres, 8, direct=3000).search(queries, 20, 40)
    assert all(len(set(r)) == 20 for r in ids.tolist()) and (ids[:, 0] == np.arange(300)).mean() > 0.6


def test_most_alike_is_exact():
    rng = np.random.default_rng(6)
    for m, most in ((1, 5), (3, 5), (5, 5), (19, 5), (20, 5), (21, 5), (803, 5), (4097, 20)):
        sims = rng.normal(size=(7, m)).astype(np.float32)
        at, values = most_alike(sims, most)
        assert (np.sort(values, axis=1) == np.sort(sims, axis=1)[:, -most:]).all() and (np.take_along_axis(sims, at, 1) == values).all()


def test_kmeans_balances():
    rng = np.random.default_rng(1)
    x = _unit(np.vstack([np.eye(DIM)[0] + 0.05 * rng.normal(size=(900, DIM)), rng.normal(size=(100, DIM))])).astype(np.float32)
    centres = spherical_kmeans(x, 10)
    assert np.bincount((x @ centres.T).argmax(1)).max() < 400


def test_clusters_by_definition(table, data):
    settings = ClusterSettings(cell_rows=150, core_neighbours=4)
    got = density_clusters(table, "id", "v", DIM, settings)
    x, truth = data
    label = {r.id: r.cluster for r in got.collect()}
    assert set(label) == set(range(len(x)))
    for k in range(4):
        own = {label[i] for i in np.flatnonzero(truth == k) if x[i] @ np.eye(DIM)[k] > 0.75}
        assert len(own) == 1 and None not in own
    assert all(label[i] is None for i in np.flatnonzero(truth == 4))  # 8 members are too few
    info = {r["size"]: r for r in describe_clusters(got).collect()}
    assert len(info) == 4 and all(len(r.medoids) == 5 for r in info.values())


def test_large_cells_are_cut_again(table, data):
    settings = ClusterSettings(cell_rows=1000, core_neighbours=4, most_points=150)
    label = {r.id: r.cluster for r in density_clusters(table, "id", "v", DIM, settings).collect()}
    own = {label[i] for i in np.flatnonzero(data[1] == 0) if data[0][i, 0] > 0.75}
    assert len(own) == 1 and None not in own


def test_shared_core_points_join_the_cells(spark, monkeypatch):
    """One cluster over many cells comes out whole, and only because its local clusters are merged."""
    rng = np.random.default_rng(8)
    x = _unit(np.vstack([np.eye(DIM)[0] + 0.2 * rng.normal(size=(1500, DIM)), np.eye(DIM)[1] + 0.1 * rng.normal(size=(80, DIM))]))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id bigint, v array<float>")
    settings = ClusterSettings(cell_rows=150, margin_ratio=1.3, kept_variance=0.95)

    def rows():
        got = {r.id: r.cluster for r in density_clusters(df, "id", "v", DIM, settings).collect() if r.cluster is not None}
        return got, {got[i] for i in range(1500) if i in got}

    whole, names = rows()
    assert len(names) == 1 and len(whole) > 1500 * 0.9
    monkeypatch.setattr(clusters, "_merge", lambda cells, dim, s: cells.where("kind = 3").select("local", F.col("local").alias("cluster")))
    alone, names = rows()
    assert len(names) > 1 and alone != whole


def test_router_in_two_levels():
    rng = np.random.default_rng(3)
    centres = tree_kmeans(_unit(rng.normal(size=(6000, DIM))).astype(np.float32), 600, direct=64)
    x = _unit(rng.normal(size=(500, DIM))).astype(np.float32)
    ids, sims = CellRouter(centres, direct=100).top(x, 3)
    assert 400 < len(centres) < 1200
    assert (ids[:, 0] == (x @ centres.T).argmax(1)).mean() > 0.95
    assert np.allclose(sims, np.take_along_axis(x @ centres.T, ids, 1), atol=1e-5)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id bigint, v array<float>")
    assert most_similar(empty, "id", "v", DIM).count() == 0
    assert density_clusters(empty, "id", "v", DIM).count() == 0
    one = spark.createDataFrame([(1, [1.0] * DIM)], "id bigint, v array<float>")
    assert most_similar(one, "id", "v", DIM).count() == 0
    assert [r.cluster for r in density_clusters(one, "id", "v", DIM).collect()] == [None]
