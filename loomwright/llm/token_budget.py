"""Token budget per source, language and topic domain (problem 4).

The tokenizer and the language model are loaded once per worker; texts are
encoded in vectorised batches to exact counts, and leave the plan there.  Only
narrow rows are shuffled: one per document, then one per slice.  Recorded
counts are reported beside the exact ones and never used; a label is only used
where the text itself does not tell its language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.language import _WORD, LanguageModel, label_code
from loomwright.llm.tokenizer import DEFAULT_FOLDER, DEFAULT_NAME, encoder
from loomwright.plans.lineage import cut_lineage, spread

LEAST_MARGIN = 0.1


def host_of(url: Column | str) -> Column:
    """The host of a url or a bare host: lower case, without scheme, user, ``www.``, port and path; empty is null."""
    bare = F.regexp_replace(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://|^//", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^(?:[^/?#@]*@)?([^/?#:]*)", 1), r"^www\.", ""), r"\.$", "")
    return F.when(host != "", host)


def measured(df: DataFrame, model: LanguageModel, tokenizer: str = DEFAULT_NAME, folder: str = DEFAULT_FOLDER) -> DataFrame:
    """``df`` (with ``text``) without the text, with ``tokens`` and ``found_language``.

    ``found_language`` is the nearest language of the whole text, null where no
    language is clearly nearest.  Null and empty texts have 0 tokens.
    """
    keep = [c for c in df.columns if c != "text"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, scorer = encoder(tokenizer, folder), shared.value.scorer()
        names = np.array([*scorer.model.languages, None], dtype=object)
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            out = batch[keep].copy()
            out["tokens"] = bpe.count_batch(texts)
            cosines = scorer.cosines([_WORD.findall(t.lower()) if t else [] for t in texts])
            order = np.sort(cosines, axis=1)
            clear = (order[:, -1] > 0) & (order[:, -1] - order[:, -2] >= LEAST_MARGIN * order[:, -1]) if len(order) else np.zeros(0, bool)
            out["found_language"] = names[np.where(clear, cosines.argmax(1), len(names) - 1)] if len(order) else []
            yield out

    return spread(df.select(*keep, F.col("text").cast("string"))).mapInPandas(run, f"{fields}, tokens bigint, found_language string")


def token_budget(corpora: dict[str, DataFrame], domains: DataFrame, model: LanguageModel) -> DataFrame:
    """Totals over every combination of corpus, source, language and topic domain.

    Each corpus has ``id, text, source, label, host, recorded``; an id counts
    once per corpus.  A dimension that a row sums over is ``*``; what is not
    known is ``unknown``.  Columns: the four dimensions, ``documents``,
    ``tokens``, ``recorded_documents`` (with a positive recorded count),
    ``recorded_tokens`` and ``labels_belied`` (usable labels that the text
    contradicts).
    """
    rows = None
    for name, df in corpora.items():
        part = measured(df, model).withColumn("corpus", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    # the exact counts of all texts, stored once
    once = cut_lineage(rows.groupBy("corpus", "id").agg(
        F.min(F.struct("tokens", "found_language", "source", "label", "host", "recorded")).alias("x")
    ).select("corpus", "id", "x.*"))
    code = label_code(F.col("label"))
    known = domains.where("site is not null").groupBy(F.lower("site").alias("host")).agg(F.min("topic_domain").alias("topic_domain"))
    # a row for each host of a slice meets the domains, so that a host with many texts is no hot key
    by_host = (
        once.withColumns({
            "language": F.coalesce("found_language", code, F.lit("unknown")),
            "source": F.coalesce("source", F.lit("unknown")),
            "belied": (code != F.col("found_language")).cast("bigint"),
            "recorded": F.when(F.col("recorded") > 0, F.col("recorded").cast("bigint")),
        })
        .groupBy("corpus", "source", "language", "host")
        .agg(
            F.count("*").alias("documents"),
            F.sum("tokens").alias("tokens"),
            F.count("recorded").alias("recorded_documents"),
            F.coalesce(F.sum("recorded"), F.lit(0)).alias("recorded_tokens"),
            F.coalesce(F.sum("belied"), F.lit(0)).alias("labels_belied"),
        )
    )
    sums = ("documents", "tokens", "recorded_documents", "recorded_tokens", "labels_belied")
    dims = ["corpus", "source", "language", "topic_domain"]
    slices = by_host.join(known, "host", "left").withColumn("topic_domain", F.coalesce("topic_domain", F.lit("unknown"))).groupBy(*dims).agg(*[F.sum(c).alias(c) for c in sums])
    cube = slices.cube(*dims).agg(
        *[F.grouping(d).alias(f"g_{d}") for d in dims],
        *[F.sum(c).alias(c) for c in sums],
    )
    return cube.select(*[F.when(F.col(f"g_{d}") == 1, "*").otherwise(F.col(d)).alias(d) for d in dims], *sums)
