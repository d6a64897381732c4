"""Embedding columns: neighbours, centroids, clusters, semantic deduplication, reduction."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.vectors import dot, literal, similarity
from loomwright.operators.frame import with_row_id
from loomwright.plans.components import connected_components
from loomwright.plans.lineage import cut_lineage


def nearest_neighbors(df: DataFrame, query: Sequence[float], k: int, vector_col: str, id_col: str, metric: str = "dot") -> DataFrame:
    """The k rows most similar to one query, best first; ties by id."""
    scored = df.withColumn("score", similarity(metric)(F.col(vector_col), literal(query)))
    return scored.where("score is not null").orderBy(F.desc("score"), id_col).limit(k)


def centroids(df: DataFrame, cluster_col: str, vector_col: str) -> DataFrame:
    """``(cluster, center)``: the mean vector of each cluster, noise (-1) and null left out."""
    cells = df.where(F.col(cluster_col) >= 0).select(F.col(cluster_col).alias("cluster"), F.posexplode(vector_col).alias("pos", "x"))
    means = cells.groupBy("cluster", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("center"))


def with_center(df: DataFrame, centers: DataFrame, cluster_col: str, vector_col: str, metric: str = "dot") -> DataFrame:
    """Rows of the clusters of ``centers`` with ``center_score``, their similarity to the centre."""
    joined = df.join(centers.withColumnRenamed("cluster", cluster_col), cluster_col)
    return joined.withColumn("center_score", similarity(metric)(F.col(vector_col), F.col("center"))).drop("center")


def nearest_class(df: DataFrame, classes: DataFrame, vector_col: str, id_col: str, metric: str = "dot", block: int = 2_048) -> DataFrame:
    """``(id, label)``: the class (label, center) of the highest similarity, the least label of equal ones.

    Up to ``block`` classes are packed into one row that travels with the plan;
    more go in blocks, of which each row keeps its best.
    """
    score = similarity(metric)
    count = classes.count()
    blocks = max(1, -(-count // block))
    best = None
    for number in range(blocks):
        own = classes if blocks == 1 else classes.where(F.pmod(F.xxhash64("label"), F.lit(blocks)) == number)
        packed = own.agg(F.array_sort(F.collect_list(F.struct("label", "center"))).alias("classes"))
        scored = df.select(id_col, vector_col).join(F.broadcast(packed)).select(  # one row on the right
            F.col(id_col), F.array_min(F.transform("classes", lambda c: F.struct((-score(F.col(vector_col), c["center"])).alias("s"), c["label"].alias("label")))).alias("best")
        )
        best = scored if best is None else best.unionByName(scored)
    if blocks > 1:
        best = best.groupBy(id_col).agg(F.min("best").alias("best"))
    return best.select(id_col, F.col("best.label").alias("label"))


def medoids(df: DataFrame, cluster_col: str, vector_col: str, id_col: str) -> DataFrame:
    """``(cluster, id)``: the row of each cluster most similar to its centre, the least id of equal ones."""
    scored = with_center(df, centroids(df, cluster_col, vector_col), cluster_col, vector_col)
    nearest = F.min_by(id_col, F.struct(-F.round("center_score", 9), F.col(id_col)))
    return scored.where("center_score is not null").groupBy(F.col(cluster_col).alias("cluster")).agg(nearest.alias(id_col))


def remove_cluster(df: DataFrame, cluster_col: str, cluster_id: int) -> DataFrame:
    """Without one cluster; rows without a cluster stay."""
    return df.where(~F.col(cluster_col).eqNullSafe(F.lit(cluster_id)))


def cluster_info(df: DataFrame, cluster_col: str, vector_col: str, id_col: str, context: Sequence[str] = (), n_neighbors: int = 3, truncate: int = 250) -> DataFrame:
    """``(cluster, size, rank, id, context...)``: each cluster's size and its rows nearest to the centre; noise left out."""
    scored = with_center(df, centroids(df, cluster_col, vector_col), cluster_col, vector_col)
    sizes = df.where(F.col(cluster_col) >= 0).groupBy(F.col(cluster_col).alias("cluster")).agg(F.count("*").alias("size"))
    order = [F.desc(F.round("center_score", 9)), F.col(id_col)]
    salted = Window.partitionBy(cluster_col, F.pmod(F.xxhash64(id_col), F.lit(64))).orderBy(*order)
    top = scored.withColumn("n", F.row_number().over(salted)).where(F.col("n") <= n_neighbors)
    ranked = top.withColumn("rank", F.row_number().over(Window.partitionBy(cluster_col).orderBy(*order))).where(F.col("rank") <= n_neighbors)
    return ranked.select(F.col(cluster_col).alias("cluster"), "rank", id_col, *[F.left(F.col(c).cast("string"), F.lit(truncate)).alias(c) for c in context]).join(sizes, "cluster")


def _block_pairs(df: DataFrame, cluster_col: str, vector_col: str, id_col: str, block: int, core_col: str | None = None) -> DataFrame:
    """Rows of each cluster, dealt by hash to blocks of about ``block`` rows and sent to every pair of blocks they are in.

    Vectors of different lengths never meet; noise, null clusters, vectors and ids are left out.
    """
    rows = df.where((F.col(cluster_col) >= 0) & F.col(vector_col).isNotNull() & F.col(id_col).isNotNull())
    core = F.col(core_col) if core_col else F.lit(None).cast("double")
    rows = rows.select(F.col(cluster_col).alias("cluster"), F.size(vector_col).alias("dim"), F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), core.alias("core"))
    sizes = rows.groupBy("cluster", "dim").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks").cast("bigint")).cast("int")
    dealt = rows.join(sizes, ["cluster", "dim"]).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    both = dealt.select("cluster", "dim", "id", "v", "core", "own", other)
    return both.select("cluster", "dim", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id", "v", "core")


def _scores(table: pa.Table, metric: str) -> tuple[np.ndarray, np.ndarray, Callable[[int, int], np.ndarray]]:
    """(ids in order, own block of each, similarities of some rows to all) of a pair of blocks; null and NaN compare with nothing."""
    table = table.sort_by("id")
    column = table.column("v").combine_chunks()
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(table.num_rows, -1)
    if metric == "cosine":
        size = np.linalg.norm(x, axis=1, keepdims=True)
        with np.errstate(invalid="ignore", divide="ignore"):
            x = x / size
    return table.column("id"), table.column("own").to_numpy(), lambda a, b: x[a:b] @ x.T


def similar_pairs(df: DataFrame, cluster_col: str, vector_col: str, id_col: str, threshold: float, metric: str = "dot", block: int = 2_000) -> DataFrame:
    """``(cluster, a, b, score)``, a < b: pairs of one cluster with a similarity above the threshold; noise left out.

    Blocks of a cluster meet pairwise as matrix products, and only the pairs
    above the threshold leave them, so a cluster of any size is many tasks.
    """
    similarity(metric)
    kinds = {c: df.schema[n].dataType.simpleString() for c, n in (("cluster", cluster_col), ("id", id_col))}

    def run(table: pa.Table) -> pa.Table:
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        ids, own, scores = _scores(table, metric)
        left, right, values = [], [], []
        for start in range(0, len(own), 1024):
            s = scores(start, start + 1024)
            meets = (own[start : start + 1024, None] != own[None, :]) if low != high else np.True_
            i, j = np.nonzero((s > threshold) & meets & (np.arange(start, start + len(s))[:, None] < np.arange(len(own))[None, :]))
            left.append(i + start)
            right.append(j)
            values.append(s[i, j])
        i, j, s = (np.concatenate(v) for v in (left, right, values))
        return pa.table({"cluster": pa.repeat(table.column("cluster")[0], len(i)), "a": ids.take(pa.array(i)), "b": ids.take(pa.array(j)), "score": pa.array(s)})

    blocks = _block_pairs(df, cluster_col, vector_col, id_col, block)
    return blocks.groupBy("cluster", "dim", "low", "high").applyInArrow(run, f"cluster {kinds['cluster']}, a {kinds['id']}, b {kinds['id']}, score double")


def similarity_range(df: DataFrame, cluster_col: str, vector_col: str, id_col: str, metric: str = "dot", block: int = 2_000) -> DataFrame:
    """``(cluster, least, greatest)``: the range of the similarities of different rows of each cluster; single rows have none."""
    similarity(metric)
    kind = df.schema[cluster_col].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        _, own, scores = _scores(table, metric)
        least, most = np.inf, -np.inf
        for start in range(0, len(own), 1024):
            s = scores(start, start + 1024)
            meets = (own[start : start + 1024, None] != own[None, :]) if low != high else np.arange(start, start + len(s))[:, None] != np.arange(len(own))[None, :]
            s = s[meets & np.isfinite(s)]
            if len(s):
                least, most = min(least, s.min()), max(most, s.max())
        found = [] if least > most else [0]
        return pa.table({"cluster": pa.repeat(table.column("cluster")[0], len(found)), "least": pa.array([least] * len(found), pa.float64()), "greatest": pa.array([most] * len(found), pa.float64())})

    parts = _block_pairs(df, cluster_col, vector_col, id_col, block).groupBy("cluster", "dim", "low", "high").applyInArrow(run, f"cluster {kind}, least double, greatest double")
    return parts.groupBy("cluster").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"))


def _spanning(s: Callable[[int, int], np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one end, other end, similarity) of a maximum spanning tree of n rows, by growing it from the first."""
    best, origin = np.full(n, -np.inf), np.zeros(n, dtype=np.int64)
    left = np.ones(n, dtype=bool)
    here, a, b, w = 0, [], [], []
    for _ in range(n - 1):
        left[here] = False
        row = np.nan_to_num(s(here, here + 1)[0], nan=-np.inf)
        better = left & (row > best)
        best[better], origin[better] = row[better], here
        here = int(np.argmax(np.where(left, best, -np.inf)))
        if not left[here]:
            break
        a.append(origin[here])
        b.append(here)
        w.append(best[here])
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64), np.array(w)


def core_similarity(df: DataFrame, cluster_col: str, vector_col: str, id_col: str, k: int, metric: str = "cosine", block: int = 2_000) -> DataFrame:
    """``(id, core)``: the similarity of each row to its k-th most similar other row of its cluster, or to the last there is."""
    similarity(metric)
    kind = df.schema[id_col].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        ids, own, scores = _scores(table, metric)
        rows, values = [], []
        for start in range(0, len(own), 1024):
            s = np.nan_to_num(scores(start, start + 1024), nan=-np.inf)
            here = np.arange(start, start + len(s))
            s[(own[here][:, None] == own[None, :]) if low != high else (here[:, None] == np.arange(len(own))[None, :])] = -np.inf
            take = min(k, s.shape[1])
            top = np.partition(s, s.shape[1] - take, axis=1)[:, s.shape[1] - take :]
            i, j = np.nonzero(top > -np.inf)
            rows.append(here[i])
            values.append(top[i, j])
        return pa.table({"id": ids.take(pa.array(np.concatenate(rows))), "s": pa.array(np.concatenate(values))})

    near = _block_pairs(df, cluster_col, vector_col, id_col, block).groupBy("cluster", "dim", "low", "high").applyInArrow(run, f"id {kind}, s double")
    return near.groupBy("id").agg(F.sort_array(F.collect_list("s"), asc=False).alias("all")).select("id", F.get("all", F.least(F.lit(k), F.size("all")) - 1).alias("core"))


def linkage(df: DataFrame, cluster_col: str, vector_col: str, id_col: str, metric: str = "dot", block: int = 2_000, core_col: str | None = None) -> DataFrame:
    """``(cluster, a, b, score)``: a maximum spanning tree of the rows of each cluster.

    With ``core_col`` a pair counts as no more similar than either row is to its core.

    At any threshold the pairs above it join just what the tree's edges above
    it join.  Every pair of blocks gives its own tree, as an edge that is not
    in it is in no larger one; the edges of a cluster, a few for each row and
    block, are then joined in order of their similarity.
    """
    similarity(metric)
    kinds = {c: df.schema[n].dataType.simpleString() for c, n in (("cluster", cluster_col), ("id", id_col))}
    shape = f"cluster {kinds['cluster']}, a {kinds['id']}, b {kinds['id']}, score double"

    def grow(table: pa.Table) -> pa.Table:
        ids, own, scores = _scores(table, metric)
        if core_col:
            core = table.sort_by("id").column("core").to_numpy()
            plain = scores
            scores = lambda a, b: np.minimum(np.minimum(plain(a, b), core[None, :]), core[a:b, None])
        a, b, w = _spanning(scores, len(own))
        return pa.table({"cluster": pa.repeat(table.column("cluster")[0], len(a)), "a": ids.take(pa.array(a)), "b": ids.take(pa.array(b)), "score": pa.array(w, pa.float64())})

    def join(table: pa.Table) -> pa.Table:
        root: dict = {}

        def find(x):
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x

        table = table.sort_by([("score", "descending"), ("a", "ascending"), ("b", "ascending")])
        kept = []
        for i, (a, b) in enumerate(zip(table.column("a").to_pylist(), table.column("b").to_pylist())):
            a, b = find(a), find(b)
            if a != b:
                root[a] = b
                kept.append(i)
        return table.take(pa.array(kept, pa.int64()))

    edges = _block_pairs(df, cluster_col, vector_col, id_col, block, core_col).groupBy("cluster", "dim", "low", "high").applyInArrow(grow, shape)
    return edges.groupBy("cluster").applyInArrow(join, shape)


def duplicates(df: DataFrame, cluster_col: str, vector_col: str, id_col: str, threshold: float, strategy: str = "random", metric: str = "dot") -> DataFrame:
    """``(id)``: all but one row of each connected group of similar rows.

    ``random`` keeps the least id, ``nearest`` the row most similar to the
    cluster's centre, ``furthest`` the least similar; ties by id.
    """
    if strategy not in ("random", "nearest", "furthest"):
        raise ValueError("strategy must be random, nearest or furthest")
    pairs = similar_pairs(df, cluster_col, vector_col, id_col, threshold, metric)
    groups = connected_components(pairs, "a", "b")
    if strategy == "random":
        return groups.where("node <> component").select(F.col("node").alias(id_col))
    scored = with_center(df, centroids(df, cluster_col, vector_col), cluster_col, vector_col, metric).select(F.col(id_col).alias("node"), "center_score")
    sign = -1 if strategy == "nearest" else 1
    both = groups.join(scored, "node").withColumn("key", F.struct((F.col("center_score") * sign).alias("s"), "node"))
    kept = both.groupBy("component").agg(F.min("key")["node"].alias("kept"))
    return both.join(kept, "component").where("node <> kept").select(F.col("node").alias(id_col))


def tune_threshold(df: DataFrame, cluster_col: str, vector_col: str, id_col: str, target_retention: float, tolerance: float = 0.01, clusters: Sequence[int] | None = None, max_iter: int = 30) -> float:
    """The threshold at which about ``target_retention`` of the rows of some clusters stay, by bisection.

    The rows that go at a threshold are as many as the edges above it in the
    clusters' spanning trees, so each step is a count over one row a row.
    """
    rows = df if clusters is None else df.where(F.col(cluster_col).isin(list(clusters)))
    rows = rows.where(F.col(cluster_col) >= 0)
    n = rows.count()
    edges = cut_lineage(linkage(rows, cluster_col, vector_col, id_col).select("score"))
    low, high = edges.agg(F.min("score"), F.max("score")).first()
    if not n or low is None:
        return 1.0
    tolerance, middle = max(tolerance, 1 / n), (low + high) / 2
    for _ in range(max_iter):
        middle = (low + high) / 2
        retention = 1 - edges.where(F.col("score") > middle).count() / n
        if abs(retention - target_retention) <= tolerance:
            break
        low, high = (middle, high) if retention < target_retention else (low, middle)
    return float(middle)


def semdedup(df: DataFrame, cluster_col: str, vector_col: str, id_col: str, threshold: float | None = None, target_retention: float | None = None, strategy: str = "random", tuning_clusters: int = 3) -> DataFrame:
    """Without semantic duplicates inside clusters; give a threshold or a target retention, not both."""
    if (threshold is None) == (target_retention is None):
        raise ValueError("give either threshold or target_retention")
    if threshold is None:
        drawn = df.where(F.col(cluster_col) >= 0).select(cluster_col).distinct().orderBy(F.xxhash64(F.col(cluster_col))).limit(tuning_clusters).collect()
        each = [tune_threshold(df, cluster_col, vector_col, id_col, target_retention, clusters=[r[0]]) for r in drawn]
        threshold = sum(each) / max(len(each), 1)
    return df.join(duplicates(df, cluster_col, vector_col, id_col, threshold, strategy), id_col, "left_anti")


def remove_prototypes(df: DataFrame, cluster_col: str, vector_col: str, id_col: str, target_retention: float = 0.75) -> DataFrame:
    """Without the floor(n * (1 - retention)) rows of each cluster that are most like its centre; noise and single rows stay.

    Ranks come from one numbering of all rows by cluster and similarity, over
    range partitions, so no task sorts a whole cluster.
    """
    scored = with_center(df, centroids(df, cluster_col, vector_col), cluster_col, vector_col).select(cluster_col, id_col, F.round("center_score", 9).alias("__s"))
    numbered = with_row_id(scored, [cluster_col, F.desc_nulls_last("__s"), id_col], "__n")
    first = numbered.groupBy(cluster_col).agg(F.min("__n").alias("__first"), F.count("*").alias("__size"))
    rank = F.col("__n") - F.col("__first") + 1
    gone = numbered.join(first, cluster_col).where((F.col("__size") >= 2) & (rank <= F.floor(F.round(F.col("__size") * (1 - target_retention), 9)))).select(id_col)
    return df.join(gone, id_col, "left_anti")


def retention_by_cluster(df: DataFrame, kept: DataFrame, cluster_col: str) -> DataFrame:
    """``(cluster, size, kept, retention)``."""
    before = df.groupBy(F.col(cluster_col).alias("cluster")).agg(F.count("*").alias("size"))
    after = kept.groupBy(F.col(cluster_col).alias("cluster")).agg(F.count("*").alias("kept"))
    joined = before.join(after, "cluster", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    return joined.withColumn("retention", F.round(F.col("kept") / F.col("size"), 6))


def condensed_labels(a: np.ndarray, b: np.ndarray, distance: np.ndarray, n: int, least: int) -> np.ndarray:
    """A label or -1 for each of n rows, from a spanning tree: the most persistent groups of at least ``least`` rows.

    Edges are joined from the shortest on.  Seen from the top, a group splits
    where both sides have ``least`` rows; otherwise it only loses rows.  A group
    is worth the sum, over its rows, of how much longer (in 1 / distance) they
    stay in it; of nested groups the more worthy generation is taken.  The whole
    is never a group.
    """
    order = np.argsort(distance, kind="stable")
    child, size, at = np.zeros((n, 2), dtype=np.int64), np.ones(2 * n, dtype=np.int64), np.zeros(2 * n)
    root, parent = list(range(2 * n)), list(range(2 * n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    node = n
    for e in order.tolist():
        x, y = find(int(a[e])), find(int(b[e]))
        if x == y:
            continue
        child[node - n] = x, y
        at[node], size[node] = distance[e], size[x] + size[y]
        parent[x] = parent[y] = node
        node += 1
    label = np.full(n, -1, dtype=np.int64)
    density = lambda d: 1 / max(d, 1e-12)

    def rows_of(top: int) -> list[int]:
        out, stack = [], [top]
        while stack:
            x = stack.pop()
            if x < n:
                out.append(x)
            else:
                stack += child[x - n].tolist()
        return out

    born, worth, inside, below = [], [], [], []  # of each group
    tops = [x for x in range(node) if parent[x] == x and (x >= n or size[x] > 1)]
    stack = []
    for top in tops:
        born.append(0.0), worth.append(0.0), inside.append(top), below.append([])
        stack.append((top, len(born) - 1))
    roots = set(range(len(born)))
    while stack:
        x, group = stack.pop()
        while x >= n:
            here = density(at[x])
            left, right = child[x - n].tolist()
            large = [y for y in (left, right) if size[y] >= least]
            if len(large) == 2:
                worth[group] += (here - born[group]) * int(size[x])
                for y in large:
                    born.append(here), worth.append(0.0), inside.append(y), below.append([])
                    below[group].append(len(born) - 1)
                    stack.append((y, len(born) - 1))
                break
            gone = sum(int(size[y]) for y in (left, right) if size[y] < least)
            worth[group] += (here - born[group]) * gone
            if not large:
                break
            x = large[0]
    best, chosen = list(worth), [True] * len(born)
    for group in range(len(born) - 1, -1, -1):  # children come after their parents
        if below[group]:
            nested = sum(best[c] for c in below[group])
            if nested > worth[group] or group in roots:
                best[group], chosen[group] = nested, False
        elif group in roots:
            chosen[group] = False
    stack = list(roots)
    number = 0
    while stack:
        group = stack.pop()
        if chosen[group]:
            label[rows_of(inside[group])] = number
            number += 1
        else:
            stack += below[group]
    return label


def _density(df: DataFrame, vector_col: str, id_col: str, cluster_col: str, cells: int, least: int, seed: int) -> DataFrame:
    """``(id, cluster)`` of the rows in a group of :func:`condensed_labels`, found in each of some k-means cells; cosine distance."""
    rows = df.select(id_col, vector_col).where(F.col(vector_col).isNotNull())
    features = rows.withColumn("__features", array_to_vector(F.col(vector_col).cast("array<double>")))
    placed = KMeans(k=cells, seed=seed, featuresCol="__features", predictionCol="__cell").fit(features).transform(features) if cells > 1 else features.withColumn("__cell", F.lit(0))
    placed = cut_lineage(placed.drop("__features"))
    core = core_similarity(placed, "__cell", vector_col, id_col, least).withColumnRenamed("id", id_col)
    edges = linkage(placed.join(core, id_col), "__cell", vector_col, id_col, "cosine", core_col="core")
    kind = df.schema[id_col].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        ids, code = np.unique(np.concatenate([table.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")]), return_inverse=True)
        half = table.num_rows
        label = condensed_labels(code[:half], code[half:], 1 - table.column("score").to_numpy(), len(ids), least)
        kept = np.flatnonzero(label >= 0)
        cell = table.column("cluster")[0].as_py()
        return pa.table({"id": pa.array(ids[kept]), "c": pa.array(label[kept] * cells + cell)})

    found = edges.groupBy("cluster").applyInArrow(run, f"id {kind}, c bigint")
    return found.select(F.col("id").alias(id_col), F.col("c").alias(cluster_col))


def cluster(
    df: DataFrame, vector_col: str, n_clusters: int | None = None, method: str = "kmeans", cluster_col: str = "__cluster", id_col: str | None = None,
    overwrite: bool = False, seed: int = 42, threshold: float = 0.5, min_cluster_size: int = 25, cell_rows: int = 20_000,
) -> DataFrame:
    """``cluster_col``: k-means (also for minibatch_kmeans), density or linkage.

    ``density`` takes the most persistent groups of a hierarchy over mutual
    reachability, in k-means cells of about ``cell_rows`` rows (``n_clusters``
    of them where given); ``linkage`` the connected groups of rows more similar
    than ``threshold``, in ``n_clusters`` cells (one where not given).  Both take
    groups of at least ``min_cluster_size``, need ``id_col``, give noise -1, and
    keep groups within their cell.
    """
    if cluster_col in df.columns and not overwrite:
        raise ValueError(f"{cluster_col} exists; pass overwrite=True")
    if method not in ("kmeans", "minibatch_kmeans", "density", "linkage"):
        raise ValueError("method must be kmeans, minibatch_kmeans, density or linkage")
    base = df.drop(cluster_col)
    if method in ("density", "linkage"):
        if id_col is None:
            raise ValueError(f"{method} needs id_col")
        if method == "density":
            label = _density(base, vector_col, id_col, cluster_col, n_clusters or max(1, -(-base.count() // cell_rows)), min_cluster_size, seed)
        else:
            placed = cluster(base, vector_col, n_clusters, cluster_col=cluster_col, seed=seed) if n_clusters else base.withColumn(cluster_col, F.lit(0))
            groups = connected_components(similar_pairs(placed, cluster_col, vector_col, id_col, threshold, "cosine"), "a", "b")
            sizes = groups.groupBy("component").count().where(F.col("count") >= min_cluster_size)
            label = groups.join(sizes, "component").select(F.col("node").alias(id_col), F.col("component").cast("bigint").alias(cluster_col))
        return base.join(label, id_col, "left").withColumn(cluster_col, F.coalesce(cluster_col, F.lit(-1)))
    if n_clusters is None:
        raise ValueError("n_clusters is required")
    features = base.withColumn("__features", array_to_vector(F.col(vector_col).cast("array<double>")))
    return KMeans(k=n_clusters, seed=seed, featuresCol="__features", predictionCol=cluster_col).fit(features).transform(features).drop("__features")


def reduce_dimensions(df: DataFrame, vector_col: str, n_dims: int = 50, method: str = "pca", new_column: str | None = None, landmarks: int = 1_000, gamma: float | None = None) -> DataFrame:
    """``<vector_col>_<method>_<n_dims>``: principal components (centred), right singular vectors (not centred), or kernel components.

    ``kernel_pca`` uses a Gaussian kernel of width ``gamma`` (one over the
    dimensions where not given) against ``landmarks`` rows drawn by a hash, all
    rows where there are fewer; then it is exact.  Null vectors give null.
    """
    if method not in ("pca", "incremental_pca", "svd", "kernel_pca"):
        raise ValueError("method must be pca, incremental_pca, svd or kernel_pca")
    if method == "kernel_pca":
        name = new_column or f"{vector_col}_{method}_{n_dims}"
        return df.withColumn(name, _kernel_components(df.where(F.col(vector_col).isNotNull()), vector_col, n_dims, landmarks, gamma)(F.col(vector_col).cast("array<double>")))
    name = new_column or f"{vector_col}_{method}_{n_dims}"
    rows = df.withColumn("__raw", array_to_vector(F.col(vector_col).cast("array<double>")))
    if method == "svd":
        axes = _right_singular(df.where(F.col(vector_col).isNotNull()), vector_col, n_dims)
        return rows.drop("__raw").withColumn(name, F.array(*[dot(F.col(vector_col), literal(axis)) for axis in axes]))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="__raw", outputCol="__centred").fit(rows).transform(rows)
    out = PCA(k=n_dims, inputCol="__centred", outputCol="__pca").fit(centred).transform(centred)
    return out.withColumn(name, vector_to_array("__pca")).drop("__raw", "__centred", "__pca")


def _right_singular(df: DataFrame, vector_col: str, n_dims: int) -> list[list[float]]:
    """The first right singular vectors, from the sums of products of all rows, which are gathered per partition first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(0).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(batch.num_rows, -1)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total))], names=["i", "row"])

    rows = df.select(F.col(vector_col).cast("array<double>")).mapInArrow(run, "i int, row array<double>")
    sums = rows.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()  # dimensions squared
    if not len(sums):
        return []
    gram = np.zeros((sums["i"].max() + 1,) * 2)
    gram[sums["i"], sums["j"]] = sums["x"]
    _, v = np.linalg.eigh(gram)
    v = v[:, ::-1][:, :n_dims].T
    return (v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None]).tolist()


def _kernel_components(df: DataFrame, vector_col: str, n_dims: int, landmarks: int, gamma: float | None) -> Callable:
    vectors = df.select(F.col(vector_col).cast("array<double>").alias("v"))
    drawn = vectors.withColumn("h", F.xxhash64("v")).orderBy("h").limit(landmarks).toPandas()  # a bounded sample
    marks = np.array(drawn["v"].tolist(), dtype=np.float64)
    width = gamma if gamma is not None else 1 / max(marks.shape[-1], 1)

    def kernel(x: np.ndarray) -> np.ndarray:
        squares = (x * x).sum(1)[:, None] + (marks * marks).sum(1)[None, :] - 2 * x @ marks.T
        return np.exp(-width * np.maximum(squares, 0))

    own = kernel(marks) if len(marks) else np.zeros((0, 0))
    mean = own.mean(0) if len(own) else np.zeros(0)
    centred = own - mean[None, :] - mean[:, None] + (mean.mean() if len(mean) else 0)
    values, axes = np.linalg.eigh(centred)
    values, axes = values[::-1][:n_dims], axes[:, ::-1][:, :n_dims]
    if len(axes):
        axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])[None, :]
    scale = axes / np.sqrt(np.maximum(values, 1e-12))[None, :]

    @F.pandas_udf("array<double>")
    def project(s: pd.Series) -> pd.Series:
        has = s.dropna()
        k = kernel(np.array(has.tolist(), dtype=np.float64)) if len(has) else np.zeros((0, len(marks)))
        out = (k - mean[None, :] - k.mean(1, keepdims=True) + mean.mean()) @ scale if len(has) else k
        return pd.Series(list(out), index=has.index, dtype=object).reindex(s.index)

    return project


def cluster_centers(df: DataFrame, vector_col: str, n_clusters: int, seed: int = 42) -> DataFrame:
    """``(cluster, center)`` of the k-means of :func:`cluster`."""
    features = df.select(array_to_vector(F.col(vector_col).cast("array<double>")).alias("__features"))
    centers = KMeans(k=n_clusters, seed=seed, featuresCol="__features").fit(features).clusterCenters()
    return df.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)], "cluster int, center array<double>")


def plot_points(df: DataFrame, vector_col: str, color_by: str | None = None) -> DataFrame:
    """``(x, y, label)`` of all two-dimensional vectors, for a plot; draw them in as many as the driver can hold."""
    label = F.col(color_by).cast("string") if color_by else F.lit(None).cast("string")
    return df.where(F.size(vector_col) == 2).select(F.col(vector_col)[0].alias("x"), F.col(vector_col)[1].alias("y"), label.alias("label"))
