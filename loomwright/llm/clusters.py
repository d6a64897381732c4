"""Grouping vectors into density clusters with typical members (problem 1).

Vectors are reduced by principal components and spread over spatial cells;
a vector within a margin of a cell's border lies in that cell too.  Inside a
cell, a vector is a core point when enough others are close; from the densest
core points on, each moves to the mean direction of what lies around it, and
the points around a direction so found form a local cluster.  Local clusters of
different cells that share core points are one cluster, found as connected
components.  A vector belongs to the cluster of its local cluster in its own
cell; what has none there is offered to the clusters of the cells further
around it.  An exact check follows: a member stays if it is close enough to the
mean direction of its cluster.  What is left over goes through another turn, in
cells of its own, until a turn finds no further cluster.

A cell with more points than ``most_points`` is cut by centres of its own, with
the same margins, inside its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.vectors import CellRouter, pack, packed_rows, sample_vectors, spherical_kmeans, tree_kmeans, unpack
from loomwright.plans.components import connected_components
from loomwright.plans.lineage import cut_lineage


@dataclass(frozen=True)
class ClusterSettings:
    """What a cluster is, and how the work is cut.

    ``least_members`` vectors with a cosine of at least ``member_cosine`` to
    their mean direction make a cluster.  ``local_cosine`` is the same inside a
    cell, with room for the error of a local mean.  The centres of the cells are
    fitted on a sample of ``sample_rows`` vectors or ``sample_per_cell`` a cell,
    whichever is more; everything else covers all vectors.
    """

    least_members: int = 15
    member_cosine: float = 0.65
    local_cosine: float = 0.6
    near_cosine: float = 0.5  # neighbourhood of a core point
    core_neighbours: int = 6
    same_cosine: float = 0.8  # two local directions of one cell that are one
    link_cosine: float = 0.85  # of the directions of two local clusters that shared core points join
    apart_cosine: float = 0.6  # directions this close are not two clusters; one that is ``stray_ratio`` times smaller is chance
    stray_ratio: int = 8
    kept_variance: float = 0.85
    cell_rows: int = 3_000
    replicas: int = 3
    margin_ratio: float = 1.12
    offers: int = 10  # cells around a vector whose clusters it is offered to
    most_points: int = 12_000
    most_cells: int = 200_000  # bounds the broadcast centres (60 MB at 64 dimensions); cells beyond are larger and cut in their tasks
    sample_rows: int = 20_000
    sample_per_cell: int = 40


def _covariance(packed: DataFrame, dim: int) -> np.ndarray:
    """Second moments of all vectors, summed per partition and then over the partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                x = unpack(batch.column(0).to_pylist(), dim)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(list(total))], names=["i", "row"])

    rows = packed.select("q").mapInArrow(run, "i int, row array<double>")
    sums = rows.groupBy("i").agg(*[F.sum(F.col("row")[j]).alias(f"x{j}") for j in range(dim)]).toPandas()  # dim rows
    out = np.zeros((dim, dim))
    out[sums["i"]] = sums.drop(columns="i").to_numpy()
    return out


def _axes(covariance: np.ndarray, kept: float) -> np.ndarray:
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values)
    share = np.cumsum(values[order]) / max(values.sum(), 1e-12)
    return vectors[:, order[: int(np.searchsorted(share, kept)) + 1]].astype(np.float32)


def _reduced(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    r = x @ axes
    return r / np.maximum(np.linalg.norm(r, axis=1, keepdims=True), 1e-9)


def _near_cells(router: CellRouter, r: np.ndarray, most: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """(cells, best first; whether within the margin) of each row."""
    cells, sims = router.top(r, most)
    distance = np.maximum(1 - sims, 1e-6)
    return cells, (cells >= 0) & (distance <= ratio * distance[:, :1])


def local_clusters(x: np.ndarray, weight: np.ndarray, s: ClusterSettings) -> tuple[np.ndarray, np.ndarray]:
    """(label of each point or -1, core flag) of one cell, by density and mean shift."""
    n = len(x)
    count = np.zeros(n, dtype=np.float32)
    toward = np.zeros_like(x)
    heavy = x * weight[:, None]
    for i in range(0, n, 1024):
        close = (x[i : i + 1024] @ x.T >= s.near_cosine).astype(np.float32)
        count[i : i + 1024] = close @ weight
        toward[i : i + 1024] = close @ heavy
    toward /= np.maximum(np.linalg.norm(toward, axis=1, keepdims=True), 1e-9)
    core = count >= s.core_neighbours
    left = np.flatnonzero(core)
    left = left[np.argsort(-count[left], kind="stable")]
    found = np.zeros((0, x.shape[1]), dtype=np.float32)
    while len(left):
        # the densest core point moves to the mean of what lies around it; core points that head there are done
        direction = toward[left[0]]
        for _ in range(3):
            moved = heavy[x @ direction >= s.local_cosine].sum(0)
            size = np.linalg.norm(moved)
            if size < 1e-9:
                break
            direction = (moved / size).astype(np.float32)
        done = toward[left] @ direction >= s.same_cosine - 0.1
        done[0] = True
        left = left[~done]
        if weight[x @ direction >= s.local_cosine].sum() >= s.core_neighbours and not (len(found) and (found @ direction).max() >= s.same_cosine):
            found = np.vstack([found, direction[None, :]])
    label = np.full(n, -1, dtype=np.int32)
    if len(found):
        sims = x @ found.T
        best = sims.argmax(1)
        label = np.where(sims[np.arange(n), best] >= s.local_cosine, best, -1).astype(np.int32)
    return label, core & (label >= 0)


def _cut_cell(r: np.ndarray, weight: np.ndarray, home: np.ndarray, s: ClusterSettings) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, which of them are at home, whether each lies in several parts) of the parts of one cell; one part if it is not too large."""
    n = len(r)
    if n <= s.most_points:
        yield np.arange(n), home, np.zeros(n, dtype=bool)
        return
    router = CellRouter(spherical_kmeans(r, -(-n // s.cell_rows)))
    cells, near = _near_cells(router, r, s.replicas, s.margin_ratio)
    several = near.sum(1) > 1
    for part in range(len(router.centres)):
        inside = np.flatnonzero(((cells == part) & near).any(1))
        if len(inside):
            yield inside, home[inside] & (cells[inside, 0] == part), several[inside]


# kinds of rows that a cell gives: members and others at home, core points that lie in several cells, local clusters
_MEMBER, _OTHER, _SHARED, _LOCAL = range(4)
_CELL_ROW = "kind int, h bigint, cell int, local bigint, weight bigint, q binary, v array<double>"


def _local_pass(points: DataFrame, axes: np.ndarray, router: CellRouter, turn: int, dim: int, s: ClusterSettings) -> DataFrame:
    """The rows of all cells, each point at home in one of them."""
    shared = points.sparkSession.sparkContext.broadcast((axes, router))  # a centre for each cell_rows points, 2 * dim bytes

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes, router = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                cells, near = _near_cells(router, _reduced(unpack(batch.column(1).to_pylist(), dim), axes), s.replicas, s.margin_ratio)
                row, col = np.nonzero(near)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cells[row, col].astype(np.int32)), pa.array(col == 0), pa.array((near.sum(1) > 1)[row]),
                        batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take),
                    ],
                    names=["cell", "home", "several", "h", "q", "weight"],
                )

    routed = points.select("h", "q", "weight").mapInArrow(route, "cell int, home boolean, several boolean, h bigint, q binary, weight bigint")

    def cluster(table: pa.Table) -> pa.Table:
        table = table.sort_by("h")
        cell = table.column("cell")[0].as_py()
        h, q = table.column("h").to_numpy(), table.column("q").to_pylist()
        home, several = (table.column(c).to_numpy(zero_copy_only=False) for c in ("home", "several"))
        amount = table.column("weight").to_numpy()
        x = unpack(q, dim)
        r = _reduced(x, shared.value[0])
        weight = amount.astype(np.float32)
        first = (turn << 54) + (int(cell) << 22)
        kind, rows, local = [], [], []
        names, sizes, totals, toward = [], [], [], []  # weights and sums of the members at home, directions of all members
        for part, own, both in _cut_cell(r, weight, home, s):
            label, core = local_clusters(r[part], weight[part], s)
            name = np.where(label >= 0, first + label.astype(np.int64), -1)
            for which, k in ((own & (label >= 0), _MEMBER), (own & (label < 0), _OTHER), (core & (several[part] | both), _SHARED)):
                at = np.flatnonzero(which)
                kind.append(np.full(len(at), k, dtype=np.int32))
                rows.append(part[at])
                local.append(name[at])
            count = int(label.max(initial=-1)) + 1
            if count:
                total = np.zeros((2, count, dim))
                for i, which in enumerate((own & (label >= 0), label >= 0)):
                    mine = np.flatnonzero(which)
                    np.add.at(total[i], label[mine], x[part[mine]] * weight[part[mine], None])
                at_home = np.flatnonzero(own & (label >= 0))
                names.append(first + np.arange(count))
                sizes.append(np.bincount(label[at_home], amount[part[at_home]], count).astype(np.int64))
                totals.append(total[0])
                toward.append((total[1] / np.maximum(np.linalg.norm(total[1], axis=1, keepdims=True), 1e-9)).astype(np.float32))
            first += count
        kind, rows, local = (np.concatenate(v) for v in (kind, rows, local))
        n = len(kind)
        sums = np.concatenate(totals) if totals else np.zeros((0, dim))
        names = np.concatenate(names) if names else np.zeros(0, np.int64)
        m = len(names)
        with_q = kind != _SHARED
        return pa.table(
            {
                "kind": pa.array(np.r_[kind, np.full(m, _LOCAL)].astype(np.int32)),
                "h": pa.array(np.r_[h[rows], np.zeros(m, np.int64)], pa.int64(), mask=np.r_[np.zeros(n, bool), np.ones(m, bool)]),
                "cell": pa.array(np.full(n + m, cell, dtype=np.int32)),
                "local": pa.array(np.r_[local, names].astype(np.int64)),
                "weight": pa.array(np.r_[amount[rows], np.concatenate(sizes) if sizes else np.zeros(0, np.int64)].astype(np.int64)),
                "q": pa.array([q[i] if w else None for i, w in zip(rows.tolist(), with_q.tolist())] + [d.tobytes() for t in toward for d in t], pa.binary()),
                "v": pa.array([None] * n + list(sums), pa.list_(pa.float64())),
            }
        )

    return routed.groupBy("cell").applyInArrow(cluster, _CELL_ROW)


def _merge(cells: DataFrame, dim: int, s: ClusterSettings) -> DataFrame:
    """``(local, cluster)``: local clusters joined through shared core points.

    Chance may put single points of one cluster into another's neighbourhood,
    so a shared core point joins only local clusters of about one direction.
    """
    locals_ = cells.where(F.col("kind") == _LOCAL).select("local", "q")
    by_point = cells.where(F.col("kind") == _SHARED).groupBy("h").agg(F.array_sort(F.collect_set("local")).alias("all")).where(F.size("all") > 1)
    pairs = by_point.select(F.explode(F.expr("flatten(transform(all, a -> transform(filter(all, b -> b > a), b -> struct(a as a, b as b))))")).alias("p"))  # at most replicas ** 2 a point
    common = pairs.select("p.a", "p.b").distinct()
    both = common.join(locals_.toDF("a", "qa"), "a").join(locals_.toDF("b", "qb"), "b")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.float32).reshape(-1, dim) for c in (2, 3))
                keep = pa.array((x * y).sum(1) >= s.link_cosine)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["src", "dst"])

    links = both.select("a", "b", "qa", "qb").mapInArrow(agree, "src bigint, dst bigint")
    groups = connected_components(links).toDF("local", "cluster")
    return locals_.select("local").join(groups, "local", "left").select("local", F.coalesce("cluster", "local").alias("cluster"))


def _directions(cells: DataFrame, merged: DataFrame, dim: int, s: ClusterSettings) -> DataFrame:
    """``(cluster, n, direction)``: size and mean direction of the members of the local clusters of each cluster.

    Those with less than half of ``least_members`` are chance; their members are offered to others.
    """
    sums = cells.where(F.col("kind") == _LOCAL).select("local", "weight", "v").join(merged, "local").groupBy("cluster").agg(
        F.sum("weight").alias("n"), *[F.sum(F.col("v")[j]).alias(f"x{j}") for j in range(dim)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = np.stack([batch.column(j + 2).to_numpy(zero_copy_only=False) for j in range(dim)], axis=1)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                d = pa.array([row.tobytes() for row in v.astype(np.float32)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), d], names=["cluster", "n", "direction"])

    return sums.where((F.col("n") > 0) & (2 * F.col("n") >= s.least_members)).mapInArrow(run, "cluster bigint, n bigint, direction binary")


def _stray(in_cells: DataFrame, dim: int, s: ClusterSettings) -> DataFrame:
    """``(cluster)``: those that point almost like one of a cell they share that is much larger, or older."""

    def run(table: pa.Table) -> pa.Table:
        d = np.frombuffer(b"".join(table.column("direction").to_pylist()), dtype=np.float32).reshape(-1, dim)
        n, old = table.column("n").to_numpy(), table.column("old").to_numpy(zero_copy_only=False)
        gone = np.zeros(len(n), dtype=bool)
        for start in range(0, len(n), 1024):
            part = slice(start, start + 1024)
            above = old[None, :] | (n[None, :] >= s.stray_ratio * n[part, None])
            gone[part] = ((d[part] @ d.T >= s.apart_cosine) & above).any(1) & ~old[part]
        return pa.table({"cluster": table.column("cluster").filter(pa.array(gone))})

    return in_cells.groupBy("cell").applyInArrow(run, "cluster bigint").distinct()


def _checked(members: DataFrame, dim: int, s: ClusterSettings) -> DataFrame:
    """``(h, cluster, similarity, q, weight)``: the cluster of those whose vector is close to its direction.

    The vector stays with all others, and with the members of clusters that may turn out to be too small.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q, d, n = batch.column(2), batch.column(3), batch.column(5)
            has = np.asarray(d.is_valid())
            sims = np.full(len(q), -2.0)
            toward = np.frombuffer(b"".join(d.drop_null().to_pylist()), dtype=np.float32).reshape(-1, dim)
            sims[has] = (unpack(q.filter(pa.array(has)).to_pylist(), dim) * toward).sum(1)
            out = sims < s.member_cosine
            doubtful = out | (n.fill_null(0).to_numpy(zero_copy_only=False) < 3 * s.least_members)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(batch.column(1).to_numpy(zero_copy_only=False), pa.int64(), mask=out, from_pandas=True),
                    pa.array(sims, pa.float64(), mask=out),
                    pc.if_else(pa.array(doubtful), q, pa.scalar(None, pa.binary())),
                    batch.column(4),
                ],
                names=["h", "cluster", "similarity", "q", "weight"],
            )

    return members.select("h", F.coalesce("cluster", F.lit(-1)).alias("cluster"), "q", "direction", "weight", "n").mapInArrow(
        run, "h bigint, cluster bigint, similarity double, q binary, weight bigint"
    )


def _offered(others: DataFrame, in_cells: DataFrame, axes: np.ndarray, router: CellRouter, dim: int, s: ClusterSettings) -> DataFrame:
    """``(h, cluster, similarity)``: for vectors without a local cluster at home, the best cluster of the cells around them."""
    shared = others.sparkSession.sparkContext.broadcast((axes, router))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes, router = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                cells, _ = router.top(_reduced(unpack(batch.column(1).to_pylist(), dim), axes), s.offers)
                row, col = np.nonzero(cells >= 0)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(cells[row, col].astype(np.int32)), batch.column(0).take(take), batch.column(1).take(take)], names=["cell", "h", "q"])

    routed = others.select("h", "q").mapInArrow(route, "cell int, h bigint, q binary")

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = {"h": pa.array([], pa.int64()), "cluster": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())}
        if not left.num_rows or not right.num_rows:
            return pa.table(empty)
        d = np.frombuffer(b"".join(right.column("direction").to_pylist()), dtype=np.float32).reshape(-1, dim)
        names, h = right.column("cluster").to_numpy(), left.column("h").to_numpy()
        found = []
        for start in range(0, left.num_rows, 8192):
            sims = unpack(left.column("q").slice(start, 8192).to_pylist(), dim) @ d.T
            best = sims.argmax(1)
            top = sims[np.arange(len(best)), best]
            ok = np.flatnonzero(top >= s.member_cosine)
            found.append((h[start + ok], names[best[ok]], top[ok].astype(np.float64)))
        return pa.table(dict(zip(empty, (pa.array(np.concatenate(v)) for v in zip(*found)))))

    each = routed.groupBy("cell").cogroup(in_cells.groupBy("cell")).applyInArrow(choose, "h bigint, cluster bigint, similarity double")
    best = each.groupBy("h").agg(F.max(F.struct("similarity", "cluster")).alias("best"))
    return best.select("h", "best.cluster", "best.similarity")


def _cells_of(directions: DataFrame, axes: np.ndarray, router: CellRouter, dim: int, s: ClusterSettings) -> DataFrame:
    """``(cell, cluster, n, direction, old)``: earlier clusters in the cells around their directions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.float32).reshape(-1, dim)
                cells, _ = router.top(_reduced(d, axes), s.offers)
                row, col = np.nonzero(cells >= 0)
                own = [c.take(pa.array(row)) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([pa.array(cells[row, col].astype(np.int32)), *own, pa.array(np.ones(len(row), bool))], names=["cell", "cluster", "n", "direction", "old"])

    return directions.select("cluster", "n", "direction").mapInArrow(run, "cell int, cluster bigint, n bigint, direction binary, old boolean")


def _one_turn(
    points: DataFrame, left: int, turn: int, earlier: DataFrame | None, axes: np.ndarray, dim: int, s: ClusterSettings
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, CellRouter]:
    """(members: h, cluster, similarity; points without a cluster; clusters; members with their vectors of clusters that may be too small; cells) of one pass."""
    wanted = min(s.most_cells, -(-left // s.cell_rows))
    sample = _reduced(sample_vectors(points, max(s.sample_rows, s.sample_per_cell * wanted), left, dim, f"cells {turn}", "h"), axes)
    router = CellRouter(tree_kmeans(sample, wanted, seed=turn))
    cells = cut_lineage(_local_pass(points, axes, router, turn, dim, s))
    merged = cut_lineage(_merge(cells, dim, s))
    directions = cut_lineage(_directions(cells, merged, dim, s))
    places = cells.where(F.col("kind") == _LOCAL).select("cell", "local").join(merged, "local").select("cell", "cluster").distinct()
    in_cells = places.join(directions, "cluster").select("cell", "cluster", "n", "direction", F.lit(False).alias("old"))
    if earlier is not None:
        in_cells = in_cells.unionByName(_cells_of(earlier, axes, router, dim, s))
    in_cells = cut_lineage(in_cells)
    stray = cut_lineage(_stray(in_cells, dim, s))
    in_cells, directions = in_cells.join(stray, "cluster", "left_anti"), directions.join(stray, "cluster", "left_anti")
    known = merged.join(directions, "cluster").select("local", "cluster", "direction", "n")
    checked = cut_lineage(_checked(cells.where(F.col("kind") == _MEMBER).select("h", "local", "q", "weight").join(known, "local", "left"), dim, s))
    others = cells.where(F.col("kind") == _OTHER).unionByName(checked.where("cluster is null").select("h", "q", "weight"), allowMissingColumns=True).select("h", "q", "weight")
    around = cut_lineage(_offered(others, in_cells, axes, router, dim, s))
    members = checked.where("cluster is not null").select("h", "cluster", "similarity").unionByName(around)
    doubtful = checked.where("cluster is not null and q is not null").select("h", "cluster", "q", "weight")
    doubtful = doubtful.unionByName(others.join(around.select("h", "cluster"), "h").select("h", "cluster", "q", "weight"))
    return members, others.join(around.select("h"), "h", "left_anti"), directions, doubtful, router


def _of_ids(ids: DataFrame, members: DataFrame) -> DataFrame:
    """``(id, cluster, similarity)`` from members by vector; of several vectors of an id the nearer to its cluster counts."""
    best = ids.join(members, "h").groupBy("id").agg(F.max(F.struct("similarity", "cluster")).alias("best"))
    return best.select("id", "best.cluster", "best.similarity")


def density_clusters(
    df: DataFrame, id_col: str, vector_col: str, dim: int = 64, settings: ClusterSettings = ClusterSettings()
) -> DataFrame:
    """``(id, cluster, similarity)`` of every usable vector; cluster and similarity are null where there is none.

    ``similarity`` is the cosine to the cluster's mean direction.  Unusable
    vectors and null ids are left out; an id counts once, and of different
    vectors of one id one that is in a cluster counts; equal vectors of
    different ids are one point with their number as weight.
    """
    s = settings
    rows = cut_lineage(packed_rows(df, id_col, vector_col, dim))
    total = rows.count()
    ids = rows.select("id", "h")
    clustered = clusters = None
    if total >= s.least_members:
        axes = _axes(_covariance(rows, dim), s.kept_variance)
        points = rows.groupBy("h").agg(F.min("q").alias("q"), F.count("*").alias("weight"))
        turn, left = 0, total
        while left >= s.least_members:
            members, rest, directions, doubtful, router = _one_turn(points, left, turn, clusters, axes, dim, s)
            found = cut_lineage(_of_ids(ids, members))
            # clusters of earlier turns may still gain members here
            large = found.groupBy("cluster").count().where(F.col("count") >= s.least_members).select("cluster")
            fresh = cut_lineage(directions.join(large, "cluster", "left_semi"))
            clusters = fresh if clusters is None else clusters.unionByName(fresh)
            # the members of clusters that are too small are offered to the others
            left_over = cut_lineage(doubtful.join(clusters.select("cluster"), "cluster", "left_anti").drop("cluster"))
            again = cut_lineage(_offered(left_over, _cells_of(clusters, axes, router, dim, s).select("cell", "cluster", "direction"), axes, router, dim, s))
            rest = rest.unionByName(left_over.join(again.select("h"), "h", "left_anti"))
            found = found.join(clusters.select("cluster"), "cluster", "left_semi").select("id", "cluster", "similarity").unionByName(_of_ids(ids, again))
            clustered = found if clustered is None else clustered.unionByName(found)
            if fresh.limit(1).count() == 0:
                break
            points = cut_lineage(rest)
            left = points.count()
            turn += 1
    if clustered is None:
        return ids.select("id").distinct().select("id", F.lit(None).cast("bigint").alias("cluster"), F.lit(None).cast("double").alias("similarity"))
    one = clustered.groupBy("id").agg(F.max(F.struct("similarity", "cluster")).alias("best")).select("id", "best.cluster", "best.similarity")
    return ids.select("id").distinct().join(one, "id", "left")


def describe_clusters(members: DataFrame, typical: int = 5) -> DataFrame:
    """``(cluster, size, mean_similarity, medoids)``; the medoids are the ``typical`` most central ids.

    For unit vectors the member with the highest mean similarity to all members
    is the one nearest to their mean direction.  The ranking is cut per salt
    first, so that no task sorts a whole large cluster.
    """
    own = members.where("cluster is not null")
    salted = own.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    window = Window.partitionBy("cluster", "salt").orderBy(F.desc("similarity"), "id")
    top = salted.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= typical)
    medoids = top.groupBy("cluster").agg(
        F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "id"))), 1, typical), lambda x: x["id"]).alias("medoids")
    )
    sizes = own.groupBy("cluster").agg(F.count("*").alias("size"), F.round(F.avg("similarity"), 4).alias("mean_similarity"), F.min("id").alias("first_id"))
    return sizes.join(medoids, "cluster")
