"""Driver queries of the training-data problems, and their SQL where SQL can say it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions.vectors import cosine, unit
from loomwright.llm.clusters import density_clusters, describe_clusters
from loomwright.llm.language import detect_languages, fit_language_model, mislabelled
from loomwright.llm.mixing import mix_shares, mix_to_targets, realise, source_tokens, temperature_weights
from loomwright.llm.near_duplicates import duplicate_groups, duplicate_pairs, link_recall, near_duplicate_links
from loomwright.llm.neighbours import most_similar, recall_of, similar_pairs
from loomwright.llm.pii import find_pii, mask_pii
from loomwright.llm.seen import seen_before, state_size, wrong_answers
from loomwright.llm.splitting import rebuilt, split_oversized
from loomwright.llm.token_budget import host_of, token_budget
from loomwright.llm.token_ids import decode_corpus, encode_corpus, with_token_counts
from loomwright.operators.vectors import centroids
from loomwright.operators.vectors import similar_pairs as core_pairs
from loomwright.plans.lineage import cut_lineage

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    members = cut_lineage(density_clusters(_table(spark, folder, "embedded_instructions"), "instr_id", "__embedding").where("cluster is not null"))
    first = members.groupBy("cluster").agg(F.min("id").alias("first_id"))
    return members.join(first, "cluster").where("id > first_id").select("first_id", F.col("id").alias("instr_id"))


def p1_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Every cluster with its size and its most typical instructions."""
    table = _table(spark, folder, "embedded_instructions")
    clusters = describe_clusters(cut_lineage(density_clusters(table, "instr_id", "__embedding"))).drop("cluster")
    texts = table.groupBy("instr_id").agg(F.min("instruction").alias("instruction"))
    each = clusters.select("first_id", "size", "mean_similarity", F.posexplode("medoids").alias("place", "instr_id"))
    return each.join(texts, "instr_id").select("first_id", "size", "mean_similarity", (F.col("place") + 1).alias("place"), "instr_id", "instruction")


def p1_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """How many clusters are too small, members too far from their mean direction, and mean directions too close, recomputed from the table."""
    table = _table(spark, folder, "embedded_instructions").select("instr_id", "__embedding")
    members = cut_lineage(density_clusters(table, "instr_id", "__embedding").where("cluster is not null"))
    rows = table.where(F.size("__embedding") == 64).groupBy("instr_id").agg(F.min("__embedding").alias("v")).join(members, members["id"] == F.col("instr_id"))
    units = rows.select("cluster", "instr_id", unit(F.col("v")).alias("v"))
    centers = cut_lineage(centroids(units, "cluster", "v"))
    sizes = members.groupBy("cluster").count()
    far = units.join(centers, "cluster").where(cosine(F.col("v"), F.col("center")) < 0.649)
    close = core_pairs(centers.withColumn("one", F.lit(0)), "one", "center", "cluster", 0.4, "cosine")
    one = [x.agg(F.count("*").alias(name)) for x, name in ((sizes.where("count < 15"), "too_small"), (far, "too_far"), (close, "too_close"))]
    return one[0].join(one[1]).join(one[2])  # a row each


P1_INVARIANTS_SQL = "SELECT 0::BIGINT AS too_small, 0::BIGINT AS too_far, 0::BIGINT AS too_close"


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    near = most_similar(_table(spark, folder, "embedded_instructions"), "instr_id", "__embedding")
    return similar_pairs(near, 0.90).toDF("instr_id_a", "instr_id_b")


def p2_recall(spark: SparkSession, folder: str) -> DataFrame:
    """The loss against the exact answer, for every id divisible by 20 against all rows."""
    table = _table(spark, folder, "embedded_instructions")
    return recall_of(most_similar(table, "instr_id", "__embedding"), table, "instr_id", "__embedding")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return seen_before(_table(spark, folder, "arrivals"), _table(spark, folder, "seen_contents"))[0].where("seen").select("arrival_no")


def p3_wrong_rate(spark: SparkSession, folder: str) -> DataFrame:
    """How many answers are wrong, by the exact answer, and what the answers were read from."""
    arrivals, earlier = _table(spark, folder, "arrivals"), _table(spark, folder, "seen_contents")
    judged, state = seen_before(arrivals, earlier)
    return wrong_answers(judged, arrivals, earlier).join(state_size(state))  # one row each


P3_FOUND_SQL = """
SELECT arrival_no FROM (
  SELECT arrival_no, content, min(arrival_no) OVER (PARTITION BY content) AS first_no FROM arrivals WHERE content IS NOT NULL
) WHERE arrival_no > first_no OR content IN (SELECT content FROM seen_contents WHERE content IS NOT NULL)
"""


def p4_budget(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "web_docs")
    model = fit_language_model(_table(spark, folder, "lang_samples"), pages)
    web = pages.select(
        F.col("page_id").alias("id"), F.col("content").alias("text"), "source", F.col("__language").alias("label"),
        host_of(F.col("url")).alias("host"), F.col("__token_count__content").alias("recorded"),
    )
    documents = _table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), "text", "source", F.col("lang").alias("label"), host_of(F.col("site")).alias("host"), F.lit(None).cast("int").alias("recorded")
    )
    return token_budget({"web_docs": web, "documents": documents}, _table(spark, folder, "site_domains"), model)


def p4_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The part of the cube by source that the recorded columns can tell."""
    cube = p4_budget(spark, folder).where("corpus <> '*' and source <> '*' and language = '*' and topic_domain = '*'")
    return cube.select("corpus", "source", "documents", "recorded_documents", "recorded_tokens")


P4_DOCUMENTS_SQL = """
SELECT corpus, coalesce(source, 'unknown') AS source, count(*) AS documents, (count(*) FILTER (WHERE recorded > 0))::BIGINT AS recorded_documents,
  coalesce(sum(recorded) FILTER (WHERE recorded > 0), 0)::BIGINT AS recorded_tokens
FROM (SELECT DISTINCT 'web_docs' AS corpus, page_id AS id, source, __token_count__content AS recorded FROM web_docs
  UNION ALL SELECT 'documents', doc_id, source, NULL FROM documents) GROUP BY 1, 2
"""


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    links, members = near_duplicate_links(_table(spark, folder, "web_docs"), "page_id", "content")
    return duplicate_pairs(links, members).toDF("page_id_a", "page_id_b")


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each page with near-duplicates: its group and its number of links."""
    links, members = near_duplicate_links(_table(spark, folder, "web_docs"), "page_id", "content")
    return duplicate_groups(cut_lineage(links), members).toDF("page_id", "group_id", "links")


def p5_recall(spark: SparkSession, folder: str) -> DataFrame:
    """How many of the pairs of each band of similarity are found, for every page id divisible by 20 against all pages."""
    pages = _table(spark, folder, "web_docs")
    links, members = near_duplicate_links(pages, "page_id", "content")
    return link_recall(pages, "page_id", "content", cut_lineage(links), members)


def _web_languages(spark: SparkSession, folder: str, *keep: str) -> DataFrame:
    pages = _table(spark, folder, "web_docs")
    model = fit_language_model(_table(spark, folder, "lang_samples"), pages)
    return detect_languages(pages, model, keep=("page_id", *keep))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return mislabelled(_web_languages(spark, folder, "__language"))


def p6_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Each stretch of one language of each page, with its confidence."""
    detected = _web_languages(spark, folder)
    return detected.select("page_id", F.explode("segments").alias("s")).select("page_id", "s.*").distinct()


def _web_pii(spark: SparkSession, folder: str) -> DataFrame:
    return find_pii(_table(spark, folder, "web_docs"), _table(spark, folder, "given_names"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _web_pii(spark, folder).select("page_id", "pii_type", "pii_text").distinct()


def p7_masked(spark: SparkSession, folder: str) -> DataFrame:
    """Every page with its items replaced by placeholders of their types."""
    pages = _table(spark, folder, "web_docs").select("page_id", "content").dropDuplicates(["page_id"])
    return mask_pii(pages, _web_pii(spark, folder)).select("page_id", "masked")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(_table(spark, folder, "documents"))


def p8_text(spark: SparkSession, folder: str) -> DataFrame:
    """A digest of every text, decoded from its token ids; null texts have none."""
    documents = _table(spark, folder, "documents")
    decoded = decode_corpus(encode_corpus(documents))
    return decoded.join(documents.select("doc_id", F.col("text").isNull().alias("none")), "doc_id").select("doc_id", F.when(~F.col("none"), F.md5("text")).alias("digest"))


P8_TEXT_SQL = "SELECT doc_id, md5(text) AS digest FROM documents"


def _counted(spark: SparkSession, folder: str) -> DataFrame:
    return with_token_counts(_table(spark, folder, "documents").select("doc_id", "source", "text"), "text")


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """How often each document is taken."""
    return mix_to_targets(_counted(spark, folder), _table(spark, folder, "source_targets"))[0]


def p9_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each document is used within its source's limit, and whether its source comes within a hundredth of its share."""
    targets = _table(spark, folder, "source_targets")
    mix = cut_lineage(mix_to_targets(_counted(spark, folder), targets)[0])
    near = mix_shares(mix, targets).select("source", "max_repeats", (F.abs(F.col("reached_share") - F.col("target_share")) <= 0.01).alias("near"))
    near = near.where("source is not null")
    return mix.join(near, "source", "left").select(
        "doc_id", (F.col("repeats") <= F.coalesce("max_repeats", F.lit(0))).alias("within"), F.coalesce("near", F.lit(True)).alias("near")
    )


P9_LIMITS_SQL = "SELECT doc_id, true AS within, true AS near FROM documents"


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Wanted and reached shares of the sources."""
    targets = _table(spark, folder, "source_targets")
    return mix_shares(mix_to_targets(_counted(spark, folder), targets)[0], targets)


def p9_temperature(spark: SparkSession, folder: str) -> DataFrame:
    """Without targets: shares raised to the exponent whose entropy is nine tenths of the greatest, as many tokens as there are."""
    counted = cut_lineage(_counted(spark, folder))
    tokens = source_tokens(counted)
    repeats = {r["source"]: r["max_repeats"] for r in _table(spark, folder, "source_targets").collect()}
    total = sum(tokens.values())
    weights = temperature_weights(tokens, entropy=0.9 * math.log(max(len(tokens), 1)), total=total, max_repeats=repeats)
    mix = realise(counted, weights, total)
    targets = spark.createDataFrame([(s, w, repeats.get(s, 1)) for s, w in weights.items()], "source string, target_share double, max_repeats int")
    return mix_shares(mix, targets)


def p10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_oversized(_table(spark, folder, "documents"), _table(spark, folder, "split_limits"))


def p10_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """A digest of every text, put together again from its pieces where it has some: nothing is lost, doubled or moved."""
    documents = _table(spark, folder, "documents")
    return rebuilt(documents, p10_pieces(spark, folder)).select("doc_id", F.md5("text").alias("digest"))


P10_REBUILT_SQL = "SELECT doc_id, md5(text) AS digest FROM documents"


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_clusters, p1_invariants, p2_found, p2_recall, p3_found, p3_wrong_rate, p4_budget, p4_documents, p5_found, p5_groups, p5_recall, p6_found, p6_segments, p7_found, p7_masked, p8_ids, p8_text, p9_mix, p9_limits, p9_shares, p9_temperature, p10_pieces, p10_rebuilt)}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_invariants": P1_INVARIANTS_SQL, "p3_found": P3_FOUND_SQL, "p4_documents": P4_DOCUMENTS_SQL, "p8_text": P8_TEXT_SQL,
        "p9_limits": P9_LIMITS_SQL, "p10_rebuilt": P10_REBUILT_SQL,
    }
