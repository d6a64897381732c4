"""Most similar vectors for every vector (problem 2).

Balanced posting lists.  A sample gives centroids of about
``list_rows`` vectors each; lists that would be large are halved.  A vector is
stored in the list of its nearest centroid and, when it lies near a border, in
up to ``replicas`` lists whose centroids are nearly as close.  A query compares
all centroids and keeps those within a ratio of the best distance: a walk over
a graph of the centroids misses the nearest one more and more often as lists
grow in number, and with it true neighbours.  The lists therefore grow in
number only with the root of the vectors once comparing centroids costs more
than reading lists; only beyond ``direct`` centroids does a best-first walk over
their neighbour graph go on from the best of as many.  Queries and lists meet in
groups of neighbouring lists, so a vector travels once to each group and not
once to each list.

Vectors travel as 16-bit integers.  Equal vectors are one point that stands
for its lowest ids: no more than k + 1 of equal vectors can be anybody's k
nearest, so copies beyond get their answer from those ids alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.vectors import CellRouter, most_alike, packed_vectors, sample_vectors, tree_kmeans, unpack
from loomwright.plans.lineage import cut_lineage


class CentroidGraph:
    """Centroids, the neighbour graph over them, and groups of neighbouring centroids."""

    def __init__(self, centres: np.ndarray, groups: int, degree: int = 16, direct: int = 65_536) -> None:
        k = len(centres)
        self.centres = centres
        self.entries = np.arange(0, k, -(-k // direct), dtype=np.int32)
        walked = k if len(self.entries) < k else 0  # where every centroid is an entry nothing is left to walk to
        degree = min(degree, max(k - 1, 1))
        self.edges = np.zeros((walked, degree), dtype=np.int32)
        router = CellRouter(centres, direct=4_096) if walked else None
        for i in range(0, walked, 2048):
            near, _ = router.top(centres[i : i + 2048], degree + 1)
            own = near == np.arange(i, i + len(near))[:, None]
            own[~own.any(1), -1] = True  # drop the centroid itself or else the last one
            near = near[~own].reshape(len(near), -1)
            self.edges[i : i + 2048] = np.where(near < 0, 0, near)[:, :degree]
        self.group = np.zeros(k, dtype=np.int32)
        self._bisect(np.arange(k), max(1, groups), 0)

    def _bisect(self, rows: np.ndarray, groups: int, first: int) -> None:
        """Equal shares along the main axis, again and again."""
        if groups == 1 or len(rows) <= 1:
            self.group[rows] = first
            return
        own = self.centres[rows] - self.centres[rows].mean(0)
        axis = np.linalg.svd(own.T @ own)[0][:, 0]
        order = rows[np.argsort(own @ axis, kind="stable")]
        left = groups // 2
        cut = len(order) * left // groups
        self._bisect(order[:cut], left, first)
        self._bisect(order[cut:], groups - left, first + left)

    def search(self, queries: np.ndarray, beam: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, similarities), best first: the best entries, and a best-first walk from them where other centroids exist."""
        k = len(self.centres)
        beam = min(beam, k)
        rows = np.arange(len(queries))[:, None]
        starts = self.centres[self.entries].T
        take = min(beam, starts.shape[1])
        ids = np.full((len(queries), beam), -1, dtype=np.int32)
        sims = np.full((len(queries), beam), -2, dtype=np.float32)
        part = max(32, (1 << 22) // starts.shape[1])  # 16 MB of similarities at once
        for i in range(0, len(queries), part):
            at, sims[i : i + part, :take] = most_alike(queries[i : i + part] @ starts, take)
            ids[i : i + part, :take] = self.entries[at]
        done = np.zeros(ids.shape, dtype=bool)
        for _ in range(steps if len(self.edges) else 0):
            waiting = np.where(done | (ids < 0), -3, sims)
            pick = waiting.argmax(1)
            live = waiting[rows[:, 0], pick] > -3
            if not live.any():
                break
            done[rows[:, 0], pick] = True
            near = self.edges[np.maximum(ids[rows[:, 0], pick], 0)]
            fresh = np.einsum("bd,bkd->bk", queries, self.centres[near])
            known = (near[:, :, None] == ids[:, None, :]).any(2) | ~live[:, None]
            fresh[known] = -2
            all_ids = np.concatenate([ids, np.where(known, -1, near)], axis=1)
            all_sims = np.concatenate([sims, fresh], axis=1)
            all_done = np.concatenate([done, known], axis=1)
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids, sims, done = all_ids[rows, best], all_sims[rows, best], all_done[rows, best]
        order = np.argsort(-sims, axis=1, kind="stable")
        return ids[rows, order], sims[rows, order]


@dataclass(frozen=True)
class SearchSettings:
    """How much work a search does.

    A list holds about ``list_rows`` vectors, or more where that would make over
    ``lists_per_root`` times the root of the number of vectors: a vector is
    compared with all centroids, and with all vectors of the lists it asks, so
    the work of both grows with that root.  The centroids are fitted on a sample
    of ``sample_rows`` vectors or ``sample_per_list`` a list, whichever is more.
    ``most_lists`` bounds the graph that is broadcast (330 bytes a list at 64
    dimensions, 270 MB); no vector is left out.
    """

    list_rows: int = 500
    lists_per_root: float = 4.0
    group_rows: int = 5_000
    sample_rows: int = 20_000
    sample_per_list: int = 10
    most_lists: int = 800_000
    replicas: int = 3
    replica_ratio: float = 1.12
    probes: int = 14
    probe_ratio: float = 1.45
    beam: int = 20
    steps: int = 12


def _points(packed: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(points: q, ids; copies: q, id): at most k + 1 lowest ids of each vector, and all other ids."""
    repeated = cut_lineage(packed.groupBy("q").count().where("count > 1").select("q"))
    alone = packed.join(repeated, "q", "left_anti").select("q", F.array("id").alias("ids"))
    several = packed.join(repeated, "q").select("q", "id")
    # the k + 1 lowest ids by salted windows, so that no task sorts all copies of one vector
    salted = Window.partitionBy("q", "salt").orderBy("id")
    lowest = several.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= k + 1)
    ids = lowest.groupBy("q").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids"))
    return alone.unionByName(ids), several


def most_similar(
    df: DataFrame, id_col: str, vector_col: str, dim: int = 64, k: int = 5, settings: SearchSettings = SearchSettings()
) -> DataFrame:
    """``(id, neighbour, similarity, rank)``: the k most similar other ids of every usable vector.

    Similarity is the cosine; equal similarities go by the lower id.  Unusable
    vectors (null, wrong length, not finite, all zero) are neither queries nor
    answers; an id counts once, however often its row is repeated.  Where
    the lists that a query reads hold fewer than k others it has fewer answers.
    """
    packed = cut_lineage(packed_vectors(df, id_col, vector_col, dim))
    total = packed.count()
    if total == 0:
        return df.sparkSession.createDataFrame([], "id bigint, neighbour bigint, similarity double, rank int")
    s = settings
    lists = max(1, min(s.most_lists, -(-total // s.list_rows), int(s.lists_per_root * np.sqrt(total))))
    sample = sample_vectors(packed, max(s.sample_rows, s.sample_per_list * lists), total, dim, "lists")
    graph = CentroidGraph(tree_kmeans(sample, lists), groups=-(-lists * s.list_rows // s.group_rows))  # as many lists a group, however long they are
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(graph)  # bounded by most_lists

    distinct, several = _points(packed, k)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                if not batch.num_rows:
                    continue
                x = unpack(batch.column(0).to_pylist(), dim)
                lists, sims = g.search(x, s.beam, s.steps)
                distance = np.maximum(1 - sims, 1e-6)
                ratio = np.where(lists >= 0, distance / distance[:, :1], np.inf)
                stored = (ratio <= s.replica_ratio) & (np.arange(lists.shape[1]) < s.replicas)
                asked = (ratio <= s.probe_ratio) & (np.arange(lists.shape[1]) < s.probes)
                row, col = np.nonzero(stored | asked)
                cell = lists[row, col]
                group = g.group[cell]
                order = np.lexsort((group, row))
                row, cell, group = row[order], cell[order], group[order]
                code = cell * 4 + stored[row, col[order]] * 2 + asked[row, col[order]]
                first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (group[1:] != group[:-1])])
                offsets = pa.array(np.r_[first, len(row)].astype(np.int32))
                take = pa.array(row[first])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group[first]), batch.column(0).take(take), batch.column(1).take(take), pa.ListArray.from_arrays(offsets, pa.array(code.astype(np.int32)))],
                    names=["grp", "q", "ids", "lists"],
                )

    routed = distinct.select("q", "ids").mapInArrow(route, "grp int, q binary, ids array<bigint>, lists array<int>")

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        x = unpack(pdf["q"].tolist(), dim)
        code = np.concatenate([np.asarray(v) for v in pdf["lists"]])
        row = np.repeat(np.arange(len(pdf)), [len(v) for v in pdf["lists"]])
        cells = code >> 2
        order = np.argsort(cells, kind="stable")
        bounds = np.flatnonzero(np.r_[True, np.diff(cells[order]) != 0, True])
        found_q, found_m, found_s = [], [], []
        for a, b in zip(bounds[:-1], bounds[1:]):
            part = order[a:b]
            members = row[part[(code[part] & 2) > 0]]
            queries = row[part[(code[part] & 1) > 0]]
            if not len(members) or not len(queries):
                continue
            for i in range(0, len(queries), 2048):
                some = queries[i : i + 2048]
                sims = x[some] @ x[members].T
                sims[some[:, None] == members[None, :]] = -2
                at, best = most_alike(sims, k)
                found_q.append(np.repeat(some, at.shape[1]))
                found_m.append(members[at].ravel())
                found_s.append(best.ravel())
        if not found_q:
            return pd.DataFrame({"own": pd.Series([], dtype=object), "near": pd.Series([], dtype=object)})
        q, m, sim = map(np.concatenate, (found_q, found_m, found_s))
        ok = sim > -2
        q, m, sim = q[ok], m[ok], sim[ok]
        order = np.lexsort((m, q))
        q, m, sim = q[order], m[order], sim[order]
        new = np.r_[True, (q[1:] != q[:-1]) | (m[1:] != m[:-1])] if len(q) else np.zeros(0, bool)
        q, m, sim = q[new], m[new], sim[new]
        order = np.lexsort((-sim, q))
        q, m, sim = q[order], m[order], sim[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        keep = rank < k
        q, m, sim = q[keep], m[keep], sim[keep].astype(np.float64)
        ids = pdf["ids"].tolist()
        out: dict[int, list] = {}
        for a, b, c in zip(q.tolist(), m.tolist(), sim.tolist()):
            out.setdefault(a, []).extend({"s": -c, "id": int(i)} for i in ids[b])
        return pd.DataFrame({"own": pd.Series([ids[a] for a in out], dtype=object), "near": pd.Series(list(out.values()), dtype=object)})

    partial = routed.groupBy("grp").applyInPandas(scan, "own array<bigint>, near array<struct<s:double,id:bigint>>")
    # one row for a point with several ids; near holds all ids of its nearest points
    # two groups may give the same neighbour with the last bit of its similarity apart
    gathered = partial.groupBy("own").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("all"))
    once = F.filter("all", lambda x, i: ~F.exists(F.slice("all", 1, i), lambda y: y["id"] == x["id"]))
    merged = gathered.select("own", F.slice(once, 1, k).alias("near"))
    with_lonely = merged.unionByName(
        distinct.where(F.size("ids") > 1).select(F.col("ids").alias("own"), F.array().cast("array<struct<s:double,id:bigint>>").alias("near"))
    ).groupBy("own").agg(F.flatten(F.collect_list("near")).alias("near"))
    copies = lambda x: F.transform(F.filter("own", lambda y: y != x), lambda y: F.struct(F.lit(-1.0).alias("s"), y.alias("id")))
    each = with_lonely.select("own", "near", F.explode("own").alias("id"))
    ranked = each.select("id", F.slice(F.concat(copies(F.col("id")), "near"), 1, k).alias("near"))
    # ids beyond the k + 1 lowest of their vector: the k lowest are their neighbours
    lowest = distinct.where(F.size("ids") > k)
    rest = several.join(lowest, "q").where(~F.array_contains("ids", F.col("id"))).select(
        "id", F.transform(F.slice("ids", 1, k), lambda y: F.struct(F.lit(-1.0).alias("s"), y.alias("id"))).alias("near")
    )
    return ranked.unionByName(rest).select("id", F.posexplode("near").alias("rank", "x")).select(
        "id", F.col("x.id").alias("neighbour"), (-F.col("x.s")).alias("similarity"), (F.col("rank") + 1).alias("rank")
    )


def similar_pairs(neighbours: DataFrame, least: float) -> DataFrame:
    """``(a, b)``, a < b: pairs of at least ``least`` in which one is among the other's neighbours."""
    close = neighbours.where(F.col("similarity") >= least)
    return close.select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b")).distinct()


def recall_of(
    neighbours: DataFrame, df: DataFrame, id_col: str, vector_col: str, dim: int = 64, k: int = 5, every: int = 20, block: int = 16_384
) -> DataFrame:
    """One row: recall and mean loss of similarity against brute force.

    Queries are all ids divisible by ``every``, against all rows, in blocks of
    ``block`` queries, each block sent to the executors once.
    """
    packed = cut_lineage(packed_vectors(df, id_col, vector_col, dim))
    queries = packed.where(F.col("id") % every == 0)
    count = queries.count()
    blocks = max(1, -(-count // block))
    exact = None
    for number in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number).toArrow()
        q_ids = part.column("id").to_numpy()
        q_x = unpack(part.column("q").to_pylist(), dim) if len(q_ids) else np.zeros((0, dim), np.float32)
        shared = df.sparkSession.sparkContext.broadcast((q_ids, q_x))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            q_ids, q_x = shared.value
            for batch in batches:
                if not len(batch) or not len(q_ids):
                    continue
                ids, x = batch["id"].to_numpy(), unpack(batch["q"].tolist(), dim)
                for i in range(0, len(q_ids), 2048):
                    s = q_x[i : i + 2048] @ x.T
                    s[q_ids[i : i + 2048, None] == ids[None, :]] = -2
                    take = min(k, len(ids))
                    at = np.argpartition(-s, take - 1, axis=1)[:, :take]
                    yield pd.DataFrame({"id": np.repeat(q_ids[i : i + 2048], take), "neighbour": ids[at].ravel(), "s": np.take_along_axis(s, at, 1).ravel().astype(float)})

        found = packed.mapInPandas(scan, "id bigint, neighbour bigint, s double").where("s > -2")
        top = found.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("s", "neighbour")), asc=False), 1, k).alias("top"))
        exact = top if exact is None else exact.unionByName(top)
    got = neighbours.where(F.col("id") % every == 0).groupBy("id").agg(F.sort_array(F.collect_list("similarity"), asc=False).alias("got"))
    both = exact.join(got, "id", "left").select(
        F.size("top").alias("n"),
        F.expr("size(filter(coalesce(got, array()), x -> x >= element_at(top, -1).s - 1e-5))").alias("hits"),
        (F.expr("aggregate(top, 0D, (a, x) -> a + x.s)") - F.expr("aggregate(coalesce(got, array()), 0D, (a, x) -> a + x)")).alias("loss"),
    )
    return both.agg(
        F.count("*").alias("queries"),
        F.round(F.sum("hits") / F.sum("n"), 4).alias("recall"),
        F.round(F.sum("loss") / F.sum("n"), 5).alias("mean_similarity_loss"),
    )
