"""Rows and columns: ids, selection, projection, counting, sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.plans.lineage import cut_lineage


def _numbered(df: DataFrame, order_by: Sequence[str | Column], name: str) -> DataFrame:
    """``df`` with dense numbers from 0 in the given order, found partition by partition inside the JVM.

    Rows are range-partitioned by the order; a number is the rows of the
    partitions before plus the row's place in its own, so no task sees all rows.
    """
    low = (1 << 33) - 1  # monotonically_increasing_id: partition, then place in it
    placed = df.orderBy(*order_by).withColumn("__place", F.monotonically_increasing_id())
    placed = cut_lineage(placed.withColumn("__part", F.shiftright("__place", 33)))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("n"))  # a row for each partition
    before = sizes.select("__part", (F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("__before"))
    return placed.join(before, "__part").withColumn(name, F.col("__before") + F.col("__place").bitwiseAND(low)).drop("__part", "__place", "__before")


def with_row_id(df: DataFrame, order_by: Sequence[str | Column], id_col: str = "__id") -> DataFrame:
    """Dense ids 0..n-1 in the given order; a column of that name is kept if its ids are unique, else a ValueError."""
    if id_col in df.columns:
        if df.groupBy(id_col).count().where("count > 1").limit(1).count():
            raise ValueError(f"{id_col} holds duplicates")
        return df
    return _numbered(df, order_by, id_col)


def row_at(df: DataFrame, index: int, id_col: str = "__id") -> dict | None:
    """The row with the id as a dict; None if there is none."""
    row = df.where(F.col(id_col) == index).limit(1).first()
    return None if row is None else row.asDict(recursive=True)


def select_rows(df: DataFrame, ids: Sequence[int], id_col: str = "__id") -> DataFrame:
    return df.where(F.col(id_col).isin([int(i) for i in ids]))


def head(df: DataFrame, n: int, id_col: str = "__id") -> DataFrame:
    return df.orderBy(id_col).limit(n)


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in columns])


def drop_column(df: DataFrame, column: str) -> DataFrame:
    """Without the column; one that is not there is no error."""
    return df.drop(column)


def mapped(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """New columns added, existing ones replaced."""
    return df.withColumns(columns)


def shuffled(df: DataFrame, seed: int, id_col: str) -> DataFrame:
    """A random order that depends on ids and seed alone."""
    return df.orderBy(F.xxhash64(F.lit(seed), id_col), id_col)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(f"`{column}`").alias("value")).agg(F.count("*").alias("n"))


def true_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How often each boolean column is true, in one row."""
    return df.agg(*[F.count_if(F.col(f"`{c}`")).alias(c) for c in columns])


def hash_split(df: DataFrame, key: str, validation: float = 0.1, test: float = 0.1, seed: int = 42) -> DataFrame:
    """``split``: train, validation or test, by a hash of the key; a key never changes sides."""
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) / 1_000_000
    return df.withColumn("split", F.when(draw < test, "test").when(draw < test + validation, "validation").otherwise("train"))


def sampled_per_group(df: DataFrame, group: str, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """``n`` random rows of each group, drawn by a hash; salted, so that no task ranks a whole group."""
    order = F.xxhash64(F.lit(seed), id_col)
    salted = Window.partitionBy(group, F.pmod(order, F.lit(64))).orderBy(order, id_col)
    top = df.withColumn("__n", F.row_number().over(salted)).where(F.col("__n") <= n)
    return top.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(order, id_col))).where(F.col("__n") <= n).drop("__n")


def drawn_per_group(df: DataFrame, group: str, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """``n`` draws with replacement from each group: ``draw`` 0..n-1 beside the drawn row.

    Each draw takes the row whose hash under that draw is least, a map-side
    minimum, so no task ranks a group.
    """
    each = df.select(group, id_col, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))
    key = F.struct(F.xxhash64(F.lit(seed), "draw", id_col), F.col(id_col))
    drawn = each.groupBy(group, "draw").agg(F.min_by(id_col, key).alias(id_col)).drop(group)
    return df.join(drawn, id_col)


def class_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """``(label, rows, predicted_rows, hits, precision, recall)`` of each class; a class that was never predicted has null precision."""
    real = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("rows"))
    guessed = df.where(F.col(predicted).isNotNull()).groupBy(F.col(predicted).alias("label")).agg(
        F.count("*").alias("predicted_rows"), F.count_if(F.col(label).eqNullSafe(F.col(predicted))).alias("hits")
    )
    both = real.join(guessed, "label", "full").fillna(0, ["rows", "predicted_rows", "hits"])
    share = lambda of: F.when(F.col(of) > 0, F.round(F.col("hits") / F.col(of), 6))
    return both.withColumns({"precision": share("predicted_rows"), "recall": share("rows")})
