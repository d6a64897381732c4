"""Mixing sources to target weights (problem 9).

Weights: given target shares, or temperature mixing, where the token shares
are raised to an exponent that bisection finds for a wanted entropy.  Between
given targets and natural shares, the same bisection finds the nearest weights
that a repetition limit allows at a wanted total.  Realisation: each source
gets its budget in whole passes over its documents and one part pass over
blocks of documents in a fixed random order; only the block that the budget
ends in is looked at document by document.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.plans.lineage import cut_lineage


MOST_SOURCES = 100_000


def _entropy(w: np.ndarray) -> float:
    w = w[w > 0]
    return float(-(w * np.log(w)).sum())


def _bisect(good: Callable[[float], bool], low: float, high: float, rounds: int = 60) -> float:
    """The largest value in [low, high] for which ``good`` holds; low is taken to be good."""
    if good(high):
        return high
    for _ in range(rounds):
        middle = (low + high) / 2
        low, high = (middle, high) if good(middle) else (low, middle)
    return low


def temperature_weights(tokens: dict[str, float], entropy: float | None = None, total: float | None = None, max_repeats: dict[str, int] | None = None) -> dict[str, float]:
    """Shares raised to an exponent in [0, 1], made to sum to 1.

    With ``entropy`` the exponent is the largest that reaches it (0, equal
    weights, if none does); with ``total`` and ``max_repeats`` it is the
    smallest, flattest one whose budgets fit the repetition limits (1 if none does).
    """
    names = sorted(s for s, t in tokens.items() if t > 0)
    if not names:
        return {}
    shares = np.array([tokens[s] for s in names], dtype=float)
    shares /= shares.sum()

    def weights(exponent: float) -> np.ndarray:
        w = shares**exponent
        return w / w.sum()

    exponent = 1.0
    if entropy is not None:
        exponent = _bisect(lambda e: _entropy(weights(e)) >= entropy, 0.0, 1.0)
    if total is not None and max_repeats is not None:
        most = np.array([tokens[s] * max_repeats.get(s, 1) for s in names])
        fits = lambda e: bool((weights(e) * total <= most * (1 + 1e-9)).all())
        if not fits(exponent):
            exponent = 1.0 - _bisect(lambda flat: fits(1.0 - flat), 0.0, 1.0 - exponent)
    return dict(zip(names, weights(exponent).tolist()))


def target_weights(tokens: dict[str, float], targets: dict[str, float], max_repeats: dict[str, int], total: float | None = None) -> tuple[dict[str, float], float]:
    """(weights, total tokens of the mix).

    The weights are ``shares**(1 - x) * targets**x``, made to sum to 1, with the
    largest exponent x in [0, 1] that the repetition limits allow at the total.
    Without ``total`` it is the largest at which x reaches 1, so that the weights
    are the targets (of sources that have tokens); both are bisected.
    """
    names = sorted(s for s, t in targets.items() if t > 0 and tokens.get(s, 0) > 0)
    if not names:
        return {}, 0.0
    want = np.array([targets[s] for s in names])
    have = np.array([tokens[s] for s in names], dtype=float)
    most = have * np.array([max_repeats.get(s, 1) for s in names])
    want = want / want.sum()

    def weights(x: float) -> np.ndarray:
        w = (have / have.sum()) ** (1 - x) * want**x
        return w / w.sum()

    def fits(x: float, size: float) -> bool:
        return bool((weights(x) * size <= most * (1 + 1e-9)).all())

    whole = float(most.sum())
    total = _bisect(lambda size: fits(1.0, size), 0.0, whole, rounds=100) if total is None else min(total, whole)
    w = weights(_bisect(lambda x: fits(x, total), 0.0, 1.0))
    return dict(zip(names, w.tolist())), min(total, float((most / w).min()))


def source_tokens(counted: DataFrame) -> dict[str, float]:
    """Tokens of each source of ``(source, tokens)`` rows."""
    return {r["source"]: float(r["t"]) for r in counted.where("source is not null").groupBy("source").agg(F.sum("tokens").alias("t")).collect()}


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    """Documents of one block, the longest first, each taken if it still fits, so that short ones fill what is left."""
    pdf = pdf.sort_values(["tokens", "turn", "doc_id"], ascending=[False, True, True], kind="stable")
    room = float(pdf["left"].iloc[0]) - float(pdf["before"].iloc[0])
    extra = []
    for tokens in pdf["tokens"].tolist():
        fits = tokens <= room
        room -= tokens * fits
        extra.append(int(fits))
    return pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": pdf["tokens"], "passes": pdf["passes"], "extra": extra})


def realise(counted: DataFrame, weights: dict[str, float], total: float, block_rows: int = 128, most_blocks: int = 65_536, seed: str = "mix") -> DataFrame:
    """``(doc_id, source, tokens, repeats)`` for every row of ``counted``.

    A source with budget b and t tokens repeats all its documents floor(b / t)
    times.  The rest is taken from its documents in a random order that depends
    on the ids alone: whole blocks of about ``block_rows`` documents while they
    fit, and of the next block each document that still fits, the longest first.
    A source thus stays below its budget by less than a short document.  Documents of other
    sources, and without tokens, have 0 repeats.
    """
    spark = counted.sparkSession
    sizes = counted.where("tokens > 0 and source is not null").groupBy("source").agg(F.count("*").alias("n"), F.sum("tokens").alias("all_tokens"))
    budgets = spark.createDataFrame([(s, float(w * total)) for s, w in weights.items()] or [(None, 0.0)], "source string, budget double")
    plan = (
        sizes.join(budgets, "source")
        .withColumn("passes", F.floor(F.col("budget") / F.col("all_tokens") + 1e-9))
        .select(
            "source", "passes", F.greatest(F.lit(0.0), F.col("budget") - F.col("passes") * F.col("all_tokens")).alias("left"),
            F.least(F.lit(most_blocks), F.greatest(F.lit(1), F.floor(F.col("n") / block_rows))).alias("blocks"),
        )
    )  # a row for each source
    rows = counted.select("doc_id", "source", "tokens").join(plan, "source", "left")
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("blocks")))
    own = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.where("tokens > 0 and blocks is not null").groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens"))
    blocks = blocks.withColumn("before", F.coalesce(F.sum("block_tokens").over(own), F.lit(0)))  # at most most_blocks rows a source
    joined = cut_lineage(rows.join(blocks, ["source", "block"], "left"))
    inside = F.coalesce((F.col("before") < F.col("left")) & (F.col("before") + F.col("block_tokens") > F.col("left")) & (F.col("tokens") > 0), F.lit(False))
    whole = F.coalesce(F.col("before") + F.col("block_tokens") <= F.col("left"), F.lit(False))
    rest = joined.where(~inside).select("doc_id", "source", "tokens", "passes", whole.cast("int").alias("extra"))
    id_type = counted.schema["doc_id"].dataType.simpleString()
    last = joined.where(inside).withColumn("turn", F.xxhash64(F.lit(seed), F.lit(1), "doc_id"))
    last = last.select("doc_id", "source", "block", "tokens", "passes", "left", "before", "turn").groupBy("source", "block").applyInPandas(
        _fill, f"doc_id {id_type}, source string, tokens bigint, passes bigint, extra int"
    )
    repeats = F.when((F.col("tokens") > 0) & F.col("passes").isNotNull(), F.col("passes") + F.col("extra")).otherwise(0)
    return rest.unionByName(last).select("doc_id", "source", "tokens", repeats.cast("int").alias("repeats"))


def mix_to_targets(counted: DataFrame, targets: DataFrame, total: float | None = None) -> tuple[DataFrame, dict[str, float], float]:
    """(realised mix, weights, total) for ``targets`` (source, target_share, max_repeats; one row a source).

    The targets are held on the driver: more than MOST_SOURCES rows are a ValueError.
    """
    counted = cut_lineage(counted)
    rows = targets.where("source is not null and target_share is not null").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} targets")
    tokens = source_tokens(counted)
    weights, size = target_weights(tokens, {r["source"]: float(r["target_share"]) for r in rows}, {r["source"]: int(r["max_repeats"] or 1) for r in rows}, total)
    return realise(counted, weights, size), weights, size


def mix_shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """Wanted and reached shares of each source, with documents, tokens and the most repeats of one document."""
    reached = mix.groupBy("source").agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("repeats") > 0).alias("documents_used"),
        F.coalesce(F.max("repeats"), F.lit(0)).alias("most_repeats"),
        F.sum("tokens").alias("tokens"),
        F.sum(F.col("tokens") * F.col("repeats")).alias("mixed_tokens"),
    )
    everything = reached.agg(F.sum("mixed_tokens").alias("all_tokens"))
    shares = reached.join(F.broadcast(everything))  # a single row
    wanted = targets.select("source", "target_share", "max_repeats")
    return shares.join(wanted, shares["source"].eqNullSafe(wanted["source"]), "left").select(
        shares["source"], "target_share",
        F.round(F.col("mixed_tokens") / F.greatest("all_tokens", F.lit(1)), 6).alias("reached_share"),
        "max_repeats", "most_repeats", "documents", "documents_used", "tokens", "mixed_tokens",
    )
