"""Driver queries of the core operators, each beside the SQL that gives the same rows."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import text as tx
from loomwright.functions import vectors as vx
from loomwright.functions.templates import rendered, rendered_each
from loomwright.operators import conversations as cv
from loomwright.operators import dedup, filters, frame, models
from loomwright.operators import vectors as ve
from loomwright.plans.lineage import cut_lineage, shared_folder, spread
from loomwright.sources import io
from loomwright.streaming.ingest import stream_ingest, write_parquet

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "documents")


# -- filters, tags, text -------------------------------------------------------------

_HIT = "coalesce(contains({0}, 'shelf') OR contains({0}, 'recipe'), false)"


@_query("""
SELECT coalesce(source, 'none') AS source, count(*) AS docs, sum(strlen(text))::BIGINT AS bytes,
       (count(*) FILTER (WHERE regexp_matches(text, '[0-9]{3}')))::BIGINT AS numbered
FROM documents WHERE NOT coalesce(contains(text, 'shelf'), false) GROUP BY 1
""")
def flagship(spark, folder):
    """Filter, tag, count bytes and aggregate in one pass over the scan."""
    kept = filters.tag_regex(filters.filter_string(_docs(spark, folder), ["text"], ["shelf"]), ["text"], "[0-9]{3}", "numbered")
    return kept.groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(
        F.count("*").alias("docs"), F.sum(tx.byte_count(F.col("text"))).alias("bytes"), F.count_if("__tag__numbered").alias("numbered")
    )


@_query(f"SELECT doc_id FROM documents WHERE NOT {_HIT.format('text')}")
def filter_string_docs(spark, folder):
    return filters.filter_string(_docs(spark, folder), ["text", "absent"], ["shelf", "recipe"]).select("doc_id")


@_query("SELECT doc_id FROM documents WHERE NOT coalesce(regexp_matches(text, '[0-9]{3} [a-z]+'), false)")
def filter_regex_docs(spark, folder):
    return filters.filter_regex(_docs(spark, folder), ["text"], "[0-9]{3} [a-z]+").select("doc_id")


@_query(f"SELECT doc_id, {_HIT.format('text')} AS hit FROM documents")
def tag_string_docs(spark, folder):
    return filters.tag_string(_docs(spark, folder), ["text"], ["shelf", "recipe"], "x").select("doc_id", F.col("__tag__x").alias("hit"))


@_query("SELECT doc_id, coalesce(regexp_matches(text, '(apple|carrot|apfel|manzana)'), false) AS hit FROM documents")
def tag_regex_docs(spark, folder):
    return filters.tag_regex(_docs(spark, folder), ["text"], "(apple|carrot|apfel|manzana)", "x").select("doc_id", F.col("__tag__x").alias("hit"))


@_query("SELECT lang AS value, count(*) AS n FROM documents GROUP BY lang")
def value_counts_lang(spark, folder):
    return frame.value_counts(_docs(spark, folder), "lang")


@_query("SELECT (count(*) FILTER (WHERE contains(text, 'shelf')))::BIGINT AS \"__tag__a\", (count(*) FILTER (WHERE regexp_matches(text, '[0-9]')))::BIGINT AS \"__tag__b\" FROM documents")
def bool_sum_tags(spark, folder):
    tagged = filters.tag_regex(filters.tag_string(_docs(spark, folder), ["text"], ["shelf"], "a"), ["text"], "[0-9]", "b")
    return frame.true_counts(tagged, ["__tag__a", "__tag__b"])


@_query("SELECT doc_id, strlen(text)::BIGINT AS bytes FROM documents")
def byte_counts(spark, folder):
    return _docs(spark, folder).select("doc_id", tx.byte_count(F.col("text")).alias("bytes"))


@_query("SELECT doc_id, n_chars, lang FROM documents WHERE lang = 'en' AND n_chars BETWEEN 200 AND 900 AND NOT contains(lower(text), 'recipe')")
def filter_by_label(spark, folder):
    """By the stored label and length; detect_then_filter detects and measures."""
    return _docs(spark, folder).where((F.col("lang") == "en") & F.col("n_chars").between(200, 900) & ~F.contains(F.lower("text"), F.lit("recipe"))).select("doc_id", "n_chars", "lang")


def _languages(spark, folder):
    samples = _table(spark, folder, "lang_samples")
    model = models.train_language_detector(samples, "sample_text", "lang")
    return models.detect_language(_docs(spark, folder), model, "text", "language")


@_query()
def lang_predict(spark, folder):
    """The language of every text, from the text alone."""
    return _languages(spark, folder).select("doc_id", "language")


@_query()
def detect_then_filter(spark, folder):
    """By the detected language and the length of the text itself; stored labels play no part."""
    n_chars = F.length("text").cast("bigint").alias("n_chars")
    kept = _languages(spark, folder).where((F.col("language") == "en") & F.length("text").between(200, 900) & ~F.contains(F.lower("text"), F.lit("recipe")))
    return kept.select("doc_id", n_chars, "language")


@_query("SELECT doc_id, row_number() OVER (ORDER BY added_at NULLS FIRST, doc_id) - 1 AS id FROM documents")
def dense_row_ids(spark, folder):
    return frame.with_row_id(_docs(spark, folder).select("doc_id", "added_at"), [F.asc_nulls_first("added_at"), "doc_id"], "id").select("doc_id", "id")


@_query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 10")
def head_rows(spark, folder):
    return frame.head(frame.select_columns(_docs(spark, folder), ["doc_id", "source"]), 10, "doc_id")


@_query("SELECT doc_id, text, n_chars * 2 AS n_chars, upper(source) AS source_upper FROM documents")
def mapped_columns(spark, folder):
    """One column replaced, one added."""
    docs = frame.select_columns(_docs(spark, folder), ["doc_id", "text", "source", "n_chars"])
    return frame.drop_column(frame.mapped(docs, {"n_chars": F.col("n_chars") * 2, "source_upper": F.upper("source")}), "source")


@_query("SELECT doc_id, lang, n_chars, source, site, added_at FROM documents")
def dropped_column(spark, folder):
    return frame.drop_column(frame.drop_column(_docs(spark, folder), "text"), "absent")


@_query("SELECT doc_id, source FROM documents WHERE doc_id IN (1001, 1005, 1008, 1013, 99999999)")
def selected_rows(spark, folder):
    return frame.select_columns(frame.select_rows(_docs(spark, folder), [1001, 1005, 1008, 1013, 99999999], "doc_id"), ["doc_id", "source"])


@_query("SELECT doc_id, n_chars, source FROM documents WHERE doc_id = 1007")
def row_by_index(spark, folder):
    docs = frame.select_columns(_docs(spark, folder), ["doc_id", "n_chars", "source"])
    row = frame.row_at(docs, 1007, "doc_id")
    return spark.createDataFrame([row] if row else [], docs.schema)


@_query("SELECT doc_id, source FROM documents")
def shuffled_docs(spark, folder):
    """Every row once, in a random order."""
    return frame.shuffled(_docs(spark, folder), 7, "doc_id").select("doc_id", "source")


@_query("SELECT doc_id, 1::BIGINT AS sides FROM documents")
def split_sides(spark, folder):
    """On how many sides of a train, validation and test split each key comes to lie, over two passes."""
    both = frame.hash_split(_docs(spark, folder), "doc_id").select("doc_id", "split").unionByName(frame.hash_split(_docs(spark, folder).orderBy("text"), "doc_id").select("doc_id", "split"))
    return both.groupBy("doc_id").agg(F.count_distinct("split").alias("sides"))


@_query("SELECT coalesce(source, 'none') AS source, least(count(*), 5) AS drawn, 5::BIGINT AS draws FROM documents GROUP BY 1")
def examples_per_source(spark, folder):
    """Five examples of each source without and with replacement, counted."""
    docs = _docs(spark, folder).select("doc_id", F.coalesce("source", F.lit("none")).alias("source"))
    once = frame.sampled_per_group(docs, "source", 5, "doc_id").groupBy("source").agg(F.count_distinct("doc_id").alias("drawn"))
    again = frame.drawn_per_group(docs, "source", 5, "doc_id").groupBy("source").agg(F.count_distinct("draw").alias("draws"))
    return once.join(again, "source")


_WS = tx.WHITESPACE


@_query(f"SELECT doc_id, regexp_replace(text, '[{_WS}]+', '_', 'g') AS text FROM documents")
def underscored_text(spark, folder):
    return _docs(spark, folder).select("doc_id", tx.underscored(F.col("text")).alias("text"))


@_query(f"SELECT doc_id, regexp_replace(regexp_replace(text, '^[{_WS}]+', '', 'g'), '[{_WS}]+$', '', 'g') AS text, upper(regexp_replace(site, '^[{_WS}]+|[{_WS}]+$', '', 'g')) AS site FROM documents")
def chained_text(spark, folder):
    return _docs(spark, folder).select("doc_id", tx.chained(F.col("text"), ["lstrip", "rstrip"]).alias("text"), tx.chained(F.col("site"), ["strip", "upper"]).alias("site"))


@_query(r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]')) AS words FROM documents")
def word_counts(spark, folder):
    return _docs(spark, folder).select("doc_id", tx.word_count(F.col("text")).alias("words"))


@_query()
def token_counts(spark, folder):
    """Tokens of each text under a vocabulary file."""
    vocabulary = os.path.join(os.environ.get("LOOMWRIGHT_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")
    return spread(_docs(spark, folder).select("doc_id", "text")).select("doc_id", tx.token_count(F.col("text"), tx.byte_pairs(vocabulary)).alias("tokens"))


@_query("SELECT doc_id, strip_accents(nfc_normalize(source)) AS source, strip_accents(nfc_normalize(site)) AS site FROM documents")
def accents_stripped(spark, folder):
    return _docs(spark, folder).select("doc_id", *[tx.strip_accents(F.col(c)).alias(c) for c in ("source", "site")])



@_query(f"SELECT doc_id, regexp_replace(text, '^[{_WS}]+|[{_WS}]+$', '', 'g') AS text FROM documents")
def trim_whitespace_text(spark, folder):
    return _docs(spark, folder).select("doc_id", tx.strip(F.col("text")).alias("text"))


@_query("SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def unicode_nfc(spark, folder):
    return spread(_docs(spark, folder).select("doc_id", "text")).select("doc_id", tx.normalize_unicode(F.col("text")).alias("text"))


_STRIPPED = f"regexp_replace({{0}}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


@_query(
    "SELECT doc_id, regexp_replace(" + _STRIPPED.format("lower(replace(" + _STRIPPED.format("text") + ", chr(10), ' __newline__ '))") + ", '([.!?,''/()])', ' \\1 ', 'g') AS text FROM documents"
)
def classifier_preprocess(spark, folder):
    return _docs(spark, folder).select("doc_id", tx.classifier_text(F.col("text")).alias("text"))


@_query("SELECT doc_id, replace(lower(source), ' ', '_') AS label, left(text, 250) AS shown FROM documents")
def labels_and_truncation(spark, folder):
    return _docs(spark, folder).select("doc_id", tx.canonical_label(F.col("source")).alias("label"), tx.truncated(F.col("text")).alias("shown"))


_LM_ONE = {a: b for a, b in tx.LM_PUNCTUATION.items() if len(b) == 1}
_LM_SQL = "regexp_replace(strip_accents(lower(" + _STRIPPED.format("text") + ")), '\\p{Nd}', '0', 'g')"
_LM_FROM, _LM_TO = ("".join(x).replace("'", "''") for x in (_LM_ONE, _LM_ONE.values()))
_LM_SQL = f"translate({_LM_SQL}, '{_LM_FROM}', '{_LM_TO}')"
for _mark, _plain in tx.LM_PUNCTUATION.items():
    if len(_plain) > 1:
        _LM_SQL = f"replace({_LM_SQL}, '{_mark}', '{_plain}')"


@_query(f"SELECT doc_id, regexp_replace({_LM_SQL}, '[\\x00-\\x1f\\x7f-\\x{{9f}}]', '', 'g') AS text FROM documents")
def language_model_text(spark, folder):
    return spread(_docs(spark, folder).select("doc_id", "text")).select("doc_id", tx.language_model_text(F.col("text")).alias("text"))


@_query("SELECT source, site, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def exact_dedup_docs(spark, folder):
    return dedup.exact_dedup(_docs(spark, folder), ["text"], "doc_id").select("source", "site", "doc_id")


@_query("SELECT md5(content) AS digest, min(fetched_at) AS fetched_at FROM web_docs GROUP BY content")
def exact_dedup_pages(spark, folder):
    """One row of each content, the first fetched; many are fetched at once or at no known time."""
    return dedup.exact_dedup(_table(spark, folder, "web_docs"), ["content"], "fetched_at").select(F.md5("content").alias("digest"), "fetched_at")


@_query("SELECT doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY text, source ORDER BY doc_id) AS n FROM documents WHERE n_chars > 100 AND lang = 'en') WHERE n = 1 ORDER BY doc_id LIMIT 500")
def ingest_bounded(spark, folder):
    kept = io.ingest(_docs(spark, folder), "doc_id", [F.col("n_chars") > 100, F.col("lang") == "en"], ["text", "source"], 500)
    return kept.select("doc_id", "text")


_P = {k: v.replace("'", "''") for k, v in filters.PII_PATTERNS.items()}


@_query("SELECT page_id, loaded_at, " + ", ".join(f"coalesce(regexp_matches(content, '{_P[k]}'), false) AS {k}" for k in ("email", "phone", "credential"))
        + ", " + " OR ".join(f"coalesce(regexp_matches(content, '{p}'), false)" for p in _P.values()) + " AS any_pii FROM web_docs")
def pii_flags(spark, folder):
    found = filters.detect_pii(_table(spark, folder, "web_docs"), ["content"])
    return found.select("page_id", "loaded_at", *[F.col(f"__pii__{k}").alias(k) for k in ("email", "phone", "credential")], F.col("__pii__any").alias("any_pii"))


@_query("SELECT doc_id, 'Source: ' || coalesce(source, '') || ' / ' || coalesce(lang, '') || chr(10) || coalesce(text, '') AS prompt FROM documents")
def prompt_render(spark, folder):
    docs = _docs(spark, folder)
    return docs.select("doc_id", rendered("Source: {{source}} / {{ lang }}\n{{text}}", docs.columns).alias("prompt"))


@_query("""
WITH p AS (SELECT doc_id, left(text, 60) AS a, left(lag(text) OVER (ORDER BY doc_id), 60) AS b FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, regexp_replace(a, '^[%(ws)s]+|[%(ws)s]+$', '', 'g') AS a, regexp_replace(b, '^[%(ws)s]+|[%(ws)s]+$', '', 'g') AS b FROM p WHERE b IS NOT NULL)
SELECT doc_id, list_max(list_concat([0], list_filter(range(1, 61), lambda i: i <= length(a) AND i <= length(b) AND left(a, i) = left(b, i))))::BIGINT AS shared FROM s
""".replace("%(ws)s", _WS))
def shared_prefix_lengths(spark, folder):
    """Common prefix of each whole text and the one before it in id order; the SQL looks at 60 characters, so it agrees up to there."""
    numbered = frame.with_row_id(_docs(spark, folder).where("text is not null").select("doc_id", F.col("text").alias("a")), ["doc_id"], "n")
    before = numbered.select((F.col("n") + 1).alias("n"), F.col("a").alias("b"))
    return numbered.join(before, "n").select("doc_id", F.length(tx.shared_prefix(F.col("a"), F.col("b"))).cast("bigint").alias("shared"))


@_query("""SELECT chat_id, received_at, a, b, left(a, k) AS prefix, substr(a, k + 1) AS rest_a, substr(b, k + 1) AS rest_b FROM (
  SELECT *, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN coalesce(list_max(list_filter(range(1, least(length(a), length(b))::BIGINT + 1), lambda i: left(a, i) = left(b, i))), 0) END AS k
  FROM (SELECT chat_id, received_at, conversation[1].content AS a, conversation[2].content AS b FROM std_chats))""")
def shared_prefix_of_turns(spark, folder):
    """What the first two messages of a chat begin with, and what follows it in each."""
    turns = _chats(spark, folder).select("chat_id", "received_at", F.get("conversation", F.lit(0))["content"].alias("a"), F.get("conversation", F.lit(1))["content"].alias("b"))
    return tx.with_shared_prefix(turns, "a", "b", "prefix", "rest_a", "rest_b", strip_whitespace=False)


# -- vectors -------------------------------------------------------------------------

_EMB = "(SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


def _emb(spark, folder):
    return _table(spark, folder, "embeddings")


_Q = [((i * 37) % 64 - 32) / 64 for i in range(64)]


@_query(f"SELECT vec_id, round(list_inner_product(v, {_Q}::DOUBLE[]), 4) AS score FROM {_EMB} ORDER BY list_inner_product(v, {_Q}::DOUBLE[]) DESC, vec_id LIMIT 10")
def knn_top_k(spark, folder):
    return ve.nearest_neighbors(_emb(spark, folder), _Q, 10, "embedding", "vec_id").select("vec_id", F.round("score", 4).alias("score"))


_CENTERS = f"""c AS (SELECT label, list(x ORDER BY pos) AS center FROM (
  SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(v) AS x, unnest(range(1, 65)) AS pos FROM {_EMB}) GROUP BY 1, 2) GROUP BY 1)"""


@_query(f"WITH {_CENTERS} SELECT label::BIGINT AS cluster, round(list_sum(center), 4) AS total, round(center[1], 4) AS x1, round(center[64], 4) AS x64 FROM c")
def centroids(spark, folder):
    c = ve.centroids(_emb(spark, folder), "label", "embedding")
    total = F.aggregate("center", F.lit(0.0), lambda s, x: s + x)
    return c.select(F.col("cluster").cast("bigint").alias("cluster"), F.round(total, 4).alias("total"), F.round(F.col("center")[0], 4).alias("x1"), F.round(F.col("center")[63], 4).alias("x64"))


@_query(f"""WITH {_CENTERS} SELECT vec_id, arg_min(label, (s, label))::BIGINT AS label FROM (
  SELECT e.vec_id, c.label, -list_inner_product(e.v, c.center) AS s FROM {_EMB} e, c) GROUP BY vec_id""")
def nearest_class(spark, folder):
    classes = ve.centroids(_emb(spark, folder), "label", "embedding").withColumnRenamed("cluster", "label")
    return ve.nearest_class(_emb(spark, folder), classes, "embedding", "vec_id").select("vec_id", F.col("label").cast("bigint").alias("label"))


@_query(f"""WITH {_CENTERS}, s AS (SELECT e.vec_id, e.label, count(*) OVER (PARTITION BY e.label) AS size,
  row_number() OVER (PARTITION BY e.label ORDER BY round(list_inner_product(e.v, c.center), 9) DESC, e.vec_id) AS r FROM {_EMB} e JOIN c USING (label))
SELECT label::BIGINT AS cluster, r::BIGINT AS rank, vec_id, size FROM s WHERE r <= 3""")
def cluster_info(spark, folder):
    info = ve.cluster_info(_emb(spark, folder), "label", "embedding", "vec_id")
    return info.select(F.col("cluster").cast("bigint").alias("cluster"), F.col("rank").cast("bigint").alias("rank"), "vec_id", "size")


@_query("SELECT vec_id FROM embeddings WHERE label IS DISTINCT FROM 3")
def remove_cluster(spark, folder):
    return ve.remove_cluster(_emb(spark, folder), "label", 3).select("vec_id")


_PAIRS = f"SELECT a.label, a.vec_id AS a, b.vec_id AS b, list_inner_product(a.v, b.v) AS s FROM {_EMB} a JOIN {_EMB} b ON a.label = b.label AND a.vec_id < b.vec_id"


@_query(f"SELECT a, b, round(s, 4) AS score FROM ({_PAIRS}) WHERE s > 0.3")
def semdedup_edges(spark, folder):
    return ve.similar_pairs(_emb(spark, folder), "label", "embedding", "vec_id", 0.3).select("a", "b", F.round("score", 4).alias("score"))


@_query(f"""WITH RECURSIVE e AS (SELECT a, b FROM ({_PAIRS}) WHERE s > 0.3), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS n, a AS m FROM u UNION SELECT r.n, u.b FROM r JOIN u ON r.m = u.a)
SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT n FROM r GROUP BY n HAVING min(m) < n)""")
def semdedup_survivors(spark, folder):
    return ve.semdedup(_emb(spark, folder), "label", "embedding", "vec_id", threshold=0.3).select("vec_id")


@_query(f"""WITH RECURSIVE {_CENTERS}, e AS (SELECT a, b FROM ({_PAIRS}) WHERE s > 0.3), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS n, a AS m FROM u UNION SELECT r.n, u.b FROM r JOIN u ON r.m = u.a), g AS (SELECT n, min(m) AS component FROM r GROUP BY n),
k AS (SELECT component, arg_max(n, (round(list_inner_product(x.v, c.center), 12), -n)) AS kept FROM g JOIN {_EMB} x ON x.vec_id = g.n JOIN c ON c.label = x.label GROUP BY component)
SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT n FROM g JOIN k USING (component) WHERE n <> kept)""")
def semdedup_nearest(spark, folder):
    """Of each group the row most like its cluster's centre stays."""
    return ve.semdedup(_emb(spark, folder), "label", "embedding", "vec_id", threshold=0.3, strategy="nearest").select("vec_id")


@_query("SELECT DISTINCT label::BIGINT AS label FROM embeddings WHERE label >= 0")
def cluster_ids(spark, folder):
    return frame.value_counts(_emb(spark, folder).where("label >= 0"), "label").select(F.col("value").cast("bigint").alias("label"))


@_query(f"SELECT label::BIGINT AS cluster, round(min(s), 4) AS least, round(max(s), 4) AS greatest FROM ({_PAIRS}) GROUP BY label")
def similarity_ranges(spark, folder):
    r = ve.similarity_range(_emb(spark, folder), "label", "embedding", "vec_id")
    return r.select(F.col("cluster").cast("bigint").alias("cluster"), F.round("least", 4).alias("least"), F.round("greatest", 4).alias("greatest"))


@_query(f"WITH {_CENTERS} SELECT label::BIGINT AS cluster, arg_max(vec_id, (round(s, 9), -vec_id)) AS vec_id FROM (SELECT e.vec_id, e.label, list_inner_product(e.v, c.center) AS s FROM {_EMB} e JOIN c USING (label)) GROUP BY label")
def medoid_rows(spark, folder):
    return ve.medoids(_emb(spark, folder), "label", "embedding", "vec_id").select(F.col("cluster").cast("bigint").alias("cluster"), "vec_id")


@_query(f"""WITH {_CENTERS}, p AS (SELECT vec_id, any_value(real) AS real, arg_min(label, (s, label)) AS guess FROM (
  SELECT e.vec_id, e.label AS real, c.label, -list_inner_product(e.v, c.center) AS s FROM {_EMB} e, c) GROUP BY vec_id)
SELECT label::BIGINT AS label, (count(*) FILTER (WHERE real = label))::BIGINT AS rows, (count(*) FILTER (WHERE guess = label))::BIGINT AS predicted_rows,
  (count(*) FILTER (WHERE guess = label AND real = label))::BIGINT AS hits,
  round((count(*) FILTER (WHERE guess = label AND real = label)) / nullif(count(*) FILTER (WHERE guess = label), 0), 6) AS precision,
  round((count(*) FILTER (WHERE guess = label AND real = label)) / nullif(count(*) FILTER (WHERE real = label), 0), 6) AS recall
FROM p, (SELECT DISTINCT label FROM embeddings) GROUP BY label""")
def class_report(spark, folder):
    """Precision and recall of each class, for the nearest centre as the guess."""
    emb = _emb(spark, folder)
    classes = ve.centroids(emb, "label", "embedding").withColumnRenamed("cluster", "label")
    guesses = ve.nearest_class(emb, classes, "embedding", "vec_id").withColumnRenamed("label", "guess")
    report = frame.class_report(emb.join(guesses, "vec_id"), "label", "guess")
    return report.select(F.col("label").cast("bigint").alias("label"), "rows", "predicted_rows", "hits", "precision", "recall")


@_query("SELECT count(*) AS rows, 0::BIGINT AS misplaced, 10::BIGINT AS centers FROM embeddings")
def kmeans_nearest_center(spark, folder):
    """K-means puts every row to the nearest of its centres."""
    emb = _emb(spark, folder)
    centers = ve.cluster_centers(emb, "embedding", 10)
    squares = F.aggregate("center", F.lit(0.0), lambda s, x: s + x * x)
    # |v - c| is least where v.c - |c|^2 / 2 is greatest: one more coordinate says so
    longer = centers.select(F.col("cluster").alias("label"), F.concat("center", F.array(-squares / 2)).alias("center"))
    points = emb.select("vec_id", F.concat(F.col("embedding").cast("array<double>"), F.array(F.lit(1.0))).alias("v"))
    near = ve.nearest_class(points, longer, "v", "vec_id")
    both = ve.cluster(emb, "embedding", 10, cluster_col="__cluster").join(near.withColumnRenamed("label", "near"), "vec_id")
    return both.agg(F.count("*").alias("rows"), F.count_if(F.col("__cluster") != F.col("near")).alias("misplaced")).withColumn("centers", F.lit(centers.count()))


@_query("SELECT vec_id, round(sqrt(list_inner_product(v, v)), 4) AS length FROM " + _EMB)
def svd_keeps_lengths(spark, folder):
    """All singular vectors are a rotation: lengths stay."""
    return ve.reduce_dimensions(_emb(spark, folder), "embedding", 64, "svd").select("vec_id", F.round(vx.norm(F.col("embedding_svd_64")), 4).alias("length"))


@_query(f"SELECT a.vec_id AS vec_id, round(sqrt(list_sum(list_transform(list_zip(a.v, m.m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 4) AS length FROM {_EMB} a, (SELECT list(x ORDER BY pos) AS m FROM (SELECT pos, avg(x) AS x FROM (SELECT unnest(v) AS x, unnest(range(1, 65)) AS pos FROM {_EMB}) GROUP BY pos)) m")
def pca_keeps_distances(spark, folder):
    """All principal components are a rotation about the mean: distances to it stay."""
    return ve.reduce_dimensions(_emb(spark, folder), "embedding", 64).select("vec_id", F.round(vx.norm(F.col("embedding_pca_64")), 4).alias("length"))


@_query("SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label::VARCHAR AS label FROM embeddings")
def plotted_points(spark, folder):
    emb = _emb(spark, folder).select("vec_id", "label", F.slice("embedding", 1, 2).alias("two"))
    points = ve.plot_points(emb.withColumn("label", F.concat_ws(" ", "vec_id", "label")), "two", "label")
    parts = F.split("label", " ")
    return points.select(parts[0].cast("bigint").alias("vec_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), parts[1].alias("label"))


@_query("SELECT count(*) AS rows, true AS within FROM embeddings WHERE label >= 0")
def tuned_retention(spark, folder):
    """Whether the tuned threshold, applied to all clusters, keeps the wanted four fifths within the tolerance."""
    emb = _emb(spark, folder).where("label >= 0")
    threshold = ve.tune_threshold(emb, "label", "embedding", "vec_id", 0.8)
    n = emb.count()
    kept = n - ve.duplicates(emb, "label", "embedding", "vec_id", threshold).count()
    return spark.createDataFrame([(n, abs(kept / n - 0.8) <= max(0.01, 1 / n) + 1e-9)], "rows bigint, within boolean")


@_query()
def semdedup_tuned(spark, folder):
    emb = _emb(spark, folder)
    return ve.retention_by_cluster(emb, cut_lineage(ve.semdedup(emb, "label", "embedding", "vec_id", target_retention=0.8, tuning_clusters=2)), "label")


@_query(f"""WITH {_CENTERS}, s AS (SELECT e.vec_id, count(*) OVER (PARTITION BY e.label) AS size,
  row_number() OVER (PARTITION BY e.label ORDER BY round(list_inner_product(e.v, c.center), 9) DESC, e.vec_id) AS r FROM {_EMB} e JOIN c USING (label))
SELECT vec_id FROM s WHERE NOT (size >= 2 AND r <= floor(round(size * 0.25, 9)))""")
def remove_prototypes(spark, folder):
    return ve.remove_prototypes(_emb(spark, folder), "label", "embedding", "vec_id", 0.75).select("vec_id")


@_query("SELECT label::BIGINT AS cluster, count(*) AS size, (count(*) FILTER (WHERE embedding[1] > 0))::BIGINT AS kept, round((count(*) FILTER (WHERE embedding[1] > 0)) / count(*), 6) AS retention FROM embeddings GROUP BY label")
def retention_by_cluster(spark, folder):
    emb = _emb(spark, folder)
    return ve.retention_by_cluster(emb, emb.where(F.col("embedding")[0] > 0), "label").select(F.col("cluster").cast("bigint").alias("cluster"), "size", "kept", "retention")


@_query("SELECT vec_id, round(sqrt(list_inner_product(v, v)), 4) AS length FROM " + _EMB)
def vector_norms(spark, folder):
    return _emb(spark, folder).select("vec_id", F.round(vx.norm(F.col("embedding")), 4).alias("length"))


@_query()
def kmeans_assign(spark, folder):
    return ve.cluster(_emb(spark, folder), "embedding", 10, cluster_col="__cluster").groupBy("__cluster").agg(F.count("*").alias("n"))


@_query()
def density_assign(spark, folder):
    return ve.cluster(_emb(spark, folder), "embedding", method="density", id_col="vec_id", min_cluster_size=5).select("vec_id", "__cluster")


@_query(f"""WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM {_EMB} a JOIN {_EMB} b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) > 0.4),
r AS (SELECT a AS n, a AS m FROM e UNION SELECT r.n, e.b FROM r JOIN e ON r.m = e.a), g AS (SELECT n, min(m) AS component FROM r GROUP BY n)
SELECT vec_id, coalesce(CASE WHEN size >= 3 THEN component END, -1)::BIGINT AS cluster FROM embeddings LEFT JOIN (SELECT n, component, count(*) OVER (PARTITION BY component) AS size FROM g) ON n = vec_id""")
def linkage_assign(spark, folder):
    """Connected groups of at least three rows more alike than 0.4."""
    return ve.cluster(_emb(spark, folder), "embedding", method="linkage", id_col="vec_id", threshold=0.4, min_cluster_size=3).select("vec_id", F.col("__cluster").alias("cluster"))


@_query()
def kernel_pca_embed(spark, folder):
    return ve.reduce_dimensions(_emb(spark, folder), "embedding", 8, "kernel_pca").select("vec_id", "embedding_kernel_pca_8")


@_query()
def pca_embed(spark, folder):
    return ve.reduce_dimensions(_emb(spark, folder), "embedding", 8).select("vec_id", "embedding_pca_8")


@_query()
def svd_embed(spark, folder):
    return ve.reduce_dimensions(_emb(spark, folder), "embedding", 2, "svd").select("vec_id", "embedding_svd_2")


# -- min-hash ------------------------------------------------------------------------


@_query()
def minhash_signatures(spark, folder):
    return dedup.compute_minhashes(spread(_docs(spark, folder).select("doc_id", "text")), "text", num_perm=16).select("doc_id", "__minhash__text")


@_query("SELECT doc_id, true AS same FROM documents")
def minhash_of_copies(spark, folder):
    """Whether each text has the signature of the first text that equals it."""
    signed = cut_lineage(dedup.compute_minhashes(spread(_docs(spark, folder).select("doc_id", "text")), "text", num_perm=16).withColumnRenamed("__minhash__text", "m"))
    first = signed.groupBy("text").agg(F.min_by("m", "doc_id").alias("of_first"))
    return signed.join(first, signed["text"].eqNullSafe(first["text"])).select("doc_id", F.col("m").eqNullSafe(F.col("of_first")).alias("same"))


@_query()
def minhash_pairs(spark, folder):
    return dedup.minhash_pairs(spread(_docs(spark, folder).select("doc_id", "text")), "doc_id", "text", 0.8)


# -- conversations -------------------------------------------------------------------

_U, _A, _S = "<U>", "<A>", "<S>"


def _chats(spark, folder):
    return _table(spark, folder, "std_chats").select("chat_id", "conversation", "received_at")


def _conv(spark, folder, f, *cols):
    return f(_chats(spark, folder)).select("chat_id", "received_at", *cols)


_MARK = "CASE m.role WHEN 'user' THEN '<U>' WHEN 'assistant' THEN '<A>' WHEN 'system' THEN '<S>' ELSE 'unknown' END"
_RENDER = f"regexp_replace(array_to_string(list_transform({{0}}, lambda m: {_MARK} || coalesce(m.content, '')), ''), '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _rendered(column="conversation", output="rendered"):
    return lambda df: cv.to_string(df, column, _U, _A, _S, output)


@_query(f"SELECT chat_id, received_at, {_RENDER.format('conversation')} AS rendered FROM std_chats")
def conv_to_string(spark, folder):
    return _conv(spark, folder, _rendered(), "rendered")


@_query("SELECT chat_id, received_at, len(conversation) AS n FROM std_chats")
def conv_length(spark, folder):
    return _conv(spark, folder, lambda df: cv.with_length(df, "conversation", "n"), "n")


@_query("SELECT chat_id, received_at, array_to_string(list_transform(conversation, lambda m: coalesce(m.role, '?')), '|') AS speakers FROM std_chats")
def conv_speakers(spark, folder):
    roles = F.array_join(F.transform("__speakers", lambda r: F.coalesce(r, F.lit("?"))), "|")
    return _conv(spark, folder, lambda df: cv.with_speakers(df, "conversation"), roles.alias("speakers"))


@_query("SELECT chat_id, received_at, len(list_filter(range(1, len(conversation)), lambda i: conversation[i].role IS NOT DISTINCT FROM conversation[i + 1].role)) = 0 AS alternating FROM std_chats")
def conv_alternating(spark, folder):
    return _conv(spark, folder, lambda df: cv.with_alternating(df, "conversation", output="alternating"), "alternating")


@_query("SELECT chat_id, received_at, conversation[-1].role AS last_speaker FROM std_chats")
def conv_last_speaker(spark, folder):
    return _conv(spark, folder, lambda df: cv.with_last_speaker(df, "conversation", output="last_speaker"), "last_speaker")


@_query(f"""SELECT chat_id, received_at, {_RENDER.format('c')} AS rendered FROM (SELECT chat_id, received_at, conversation[1:coalesce(list_max(
  list_filter(range(1, len(conversation) + 1), lambda i: coalesce(conversation[i].role = 'assistant', false))), 0)] AS c FROM std_chats)""")
def conv_standardize_last(spark, folder):
    return _conv(spark, folder, lambda df: _rendered()(cv.standardize_last_turn(df, "conversation", "assistant")), "rendered")


@_query(f"SELECT chat_id, received_at, regexp_replace('<S>Be brief.' || array_to_string(list_transform(conversation, lambda m: {_MARK} || coalesce(m.content, '')), ''), '^[{_WS}]+|[{_WS}]+$', '', 'g') AS rendered FROM std_chats")
def conv_add_system(spark, folder):
    return _conv(spark, folder, lambda df: _rendered()(cv.add_initial_system_message(df, "conversation", "Be brief.")), "rendered")


@_query("""SELECT chat_id, received_at, CASE WHEN conversation[1].role = 'system' THEN conversation[1].content END AS system_message,
  len(conversation) - CASE WHEN conversation[1].role = 'system' THEN 1 ELSE 0 END AS n_left FROM std_chats""")
def conv_take_system(spark, folder):
    return _conv(spark, folder, lambda df: cv.with_length(cv.take_initial_system_message(df, "conversation", "system_message"), "conversation", "n_left"), "system_message", "n_left")


@_query("SELECT chat_id, received_at, conversation[-1].content AS last_message, CASE WHEN conversation IS NOT NULL THEN greatest(len(conversation) - 1, 0) END AS n_left FROM std_chats")
def conv_take_last(spark, folder):
    return _conv(spark, folder, lambda df: cv.with_length(cv.take_last_message(df, "conversation", "last_message"), "conversation", "n_left"), "last_message", "n_left")


@_query("""SELECT chat_id, received_at, array_to_string(list_transform(conversation, lambda m: CASE m.role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt'
  WHEN 'system' THEN 'system' ELSE '?' END || '=' || coalesce(m.content, '?')), chr(10)) AS turns FROM std_chats""")
def conv_from_dicts(spark, folder):
    turned = lambda df: cv.from_dicts(df, "conversation", cv.OPENAI, "turned", cv.SHAREGPT)
    lines = F.array_join(F.transform("turned", lambda m: F.concat(F.coalesce(m["from"], F.lit("?")), F.lit("="), F.coalesce(m["value"], F.lit("?")))), "\n")
    return _conv(spark, folder, turned, lines.alias("turns"))


@_query("SELECT chat_id, received_at, len(list_filter(conversation, lambda m: coalesce(m.role, '') IN ('user', 'assistant', 'system'))) AS known FROM std_chats")
def conv_round_trip(spark, folder):
    """Written as a transcript and read again: every message with a known role comes back."""
    df = cv.to_string(_chats(spark, folder), "conversation", "<|U|>", "<|A|>", "<|S|>", "t", strip_whitespace=False)
    back = cv.from_string(df, "t", "<|U|>", "<|A|>", "<|S|>", "back")
    return cv.with_length(back, "back", "known").select("chat_id", "received_at", "known")


@_query("SELECT chat_id, received_at, array_to_string(list_transform(conversation, lambda m: '- ' || coalesce(m.role, '') || ': ' || coalesce(m.content, '')), chr(10)) AS prompt FROM std_chats")
def prompt_render_loop(spark, folder):
    return _chats(spark, folder).select("chat_id", "received_at", rendered_each(F.col("conversation"), "- {{role}}: {{content}}").alias("prompt"))


# -- models --------------------------------------------------------------------------


@_query(r"""
WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS word FROM documents),
f AS (SELECT word, count(*) AS f FROM w GROUP BY 1), s AS (SELECT sum(f) AS total, count(*) AS kinds FROM f),
l AS (SELECT word, log10((f + 1) / (total + kinds)) AS lp FROM f, s)
SELECT d.doc_id, count(w.word) AS words, round(pow(10, -sum(lp) / count(w.word)), 1) AS perplexity FROM documents d LEFT JOIN w USING (doc_id) LEFT JOIN l USING (word) GROUP BY 1
""")
def perplexity_unigram(spark, folder):
    """Every text, by the word frequencies of all texts."""
    return models.unigram_perplexity(_docs(spark, folder), "doc_id", "text")


@_query()
def perplexity_bigram(spark, folder):
    """Every text by an ARPA file, which the language samples are made into first."""
    path = _folder(spark, "bigrams").removeprefix("file:") + ".arpa"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    models.write_arpa_bigrams(_table(spark, folder, "lang_samples").withColumn("t", F.lower("sample_text")), "t", path)
    return models.arpa_perplexity(spread(_docs(spark, folder).select("doc_id", F.lower("text").alias("text"))), "text", "perplexity", path).select("doc_id", "perplexity")


@_query()
def text_classifier(spark, folder):
    docs = _docs(spark, folder).where("text is not null")
    model, accuracy = models.train_text_classifier(docs, "text", "source", "doc_id")
    return models.classify_text(docs, model, "text", "predicted").select("doc_id", "predicted", F.lit(round(accuracy, 4)).alias("accuracy"))


@_query()
def embedding_classifier(spark, folder):
    emb = _emb(spark, folder)
    model, accuracy = models.train_embedding_classifier(emb, "embedding", "label", "vec_id")
    return models.classify_embeddings(emb, model, "embedding", "predicted").select("vec_id", "predicted", F.lit(round(accuracy, 4)).alias("accuracy"))


@_query()
def hashed_embeddings(spark, folder):
    docs = spread(_docs(spark, folder).select("doc_id", "text"))
    return models.with_embeddings(docs, "text", models.embedding_backend("hashed"), "v", normalize=True).select("doc_id", "v")


@_query("SELECT doc_id, CASE WHEN text IS NOT NULL THEN 48 END::BIGINT AS dims, CASE WHEN text IS NOT NULL THEN CASE WHEN regexp_matches(text, '[^ \t\n\x0b\f\r]') THEN 1.0 ELSE 0.0 END END::DOUBLE AS length FROM documents")
def embedding_lengths(spark, folder):
    """Unit vectors of the wanted size; blank texts have no direction."""
    docs = spread(_docs(spark, folder).select("doc_id", "text"))
    v = models.with_embeddings(docs, "text", models.embedding_backend("hashed", dim=48), "v", normalize=True)
    return v.select("doc_id", F.when(F.col("v").isNotNull(), F.size("v")).cast("bigint").alias("dims"), F.round(vx.norm(F.col("v")), 4).alias("length"))


_RULES = {"True": ["recipe", "shelf"], "cooking": ["recipe"], "storage": ["shelf"]}


@_query("SELECT doc_id, CASE WHEN contains(text, 'recipe') OR contains(text, 'shelf') THEN 'True' ELSE 'False' END AS tag FROM documents")
def ai_tags(spark, folder):
    """Tags by a stand-in service that looks for words."""
    docs = spread(_docs(spark, folder).select("doc_id", "text"))
    return models.ai_tagger(docs, "text", {"home": "cooking or storage"}, models.KeywordBackend(_RULES)).select("doc_id", F.col("__ai_tag__home").alias("tag"))


@_query("SELECT doc_id, CASE WHEN contains(text, 'recipe') THEN 'cooking' WHEN contains(text, 'shelf') THEN 'storage' ELSE 'other' END AS kind FROM documents")
def ai_classes(spark, folder):
    docs = spread(_docs(spark, folder).select("doc_id", "text"))
    return models.ai_classifier(docs, "kind", "text", ["cooking", "storage", "other"], models.KeywordBackend(_RULES)).select("doc_id", "kind")


@_query("SELECT doc_id, trim(lower(coalesce(source, '') || ' at ' || coalesce(site, ''))) AS said FROM documents")
def ai_columns(spark, folder):
    docs = spread(_docs(spark, folder).select("doc_id", "source", "site"))
    return models.ai_column(docs, "said", "Say\n\n{{source}} at {{site}}", ["source", "site"], models.KeywordBackend(), ["strip", "lower"]).select("doc_id", "said")


@_query(f"""WITH {_CENTERS}, s AS (SELECT e.vec_id, e.label, row_number() OVER (PARTITION BY e.label ORDER BY round(list_inner_product(e.v, c.center), 9) DESC, e.vec_id) AS r FROM {_EMB} e JOIN c USING (label)),
n AS (SELECT label, string_agg(vec_id::VARCHAR, chr(10) ORDER BY r) AS name FROM s WHERE r <= 3 GROUP BY label) SELECT vec_id, n.name FROM embeddings LEFT JOIN n USING (label)""")
def ai_cluster_names(spark, folder):
    """Each cluster named after its three rows nearest to the centre, by a stand-in that repeats what it is shown."""
    emb = _emb(spark, folder)
    examples = ve.cluster_info(emb, "label", "embedding", "vec_id", n_neighbors=3)
    return models.ai_label_clusters(emb.select("vec_id", "label"), examples, "label", "name", ["vec_id"], models.KeywordBackend(), "Name\n\n{{examples}}").select("vec_id", "name")


@_query()
def html_to_text(spark, folder):
    page = F.concat(F.lit("<html><head><title>"), F.col("source"), F.lit("</title><script>x()</script></head><body><p>"), F.col("content"), F.lit("</p></body></html>"))
    pages = spread(_table(spark, folder, "web_docs").select("page_id", page.alias("html")))
    return io.with_html_text(pages, "html", "text").select("page_id", "text")


# -- sources, sinks, streams ------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{os.urandom(4).hex()}"


@_query("SELECT doc_id, text, lang, source, n_chars, site, added_at FROM documents")
def parquet_round_trip(spark, folder):
    path = _folder(spark, "docs") + ".parquet"
    io.save(_docs(spark, folder), path)
    return io.from_parquet(spark, path)


_TURNS = "array_to_string(list_transform(conversation, lambda m: coalesce(m.role, '?') || '=' || coalesce(m.content, '?')), chr(10))"


@_query(f"SELECT chat_id, len(conversation) AS n, {_TURNS} AS turns FROM std_chats")
def jsonl_round_trip(spark, folder):
    path = _folder(spark, "chats") + ".jsonl"
    chats = _chats(spark, folder).select("chat_id", "conversation")
    io.save(chats, path)
    turns = F.array_join(F.transform("conversation", lambda m: F.concat(F.coalesce(m["role"], F.lit("?")), F.lit("="), F.coalesce(m["content"], F.lit("?")))), "\n")
    return cv.with_length(io.from_jsonl(spark, path, chats.schema), "conversation", "n").select("chat_id", "n", turns.alias("turns"))


@_query("SELECT doc_id, text, source FROM documents")
def csv_round_trip(spark, folder):
    path = _folder(spark, "docs") + ".csv"
    docs = _docs(spark, folder).select("doc_id", "text", "source")
    io.save(docs, path, null_value="\\N")
    return io.from_csv(spark, path, docs.schema, null_value="\\N")


@_query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def pandas_round_trip(spark, folder):
    """Two small tables to the driver, joined there, and back."""
    nation, region = _table(spark, folder, "nation").toPandas(), _table(spark, folder, "region").toPandas()
    return io.from_pandas(spark, nation.merge(region, left_on="n_regionkey", right_on="r_regionkey")[["n_nationkey", "n_name", "r_name"]])


@_query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS no, 'doc ' || doc_id AS name FROM documents")
def hub_rows(spark, folder):
    """A data set that a load function streams, as a hub would."""
    ids = _docs(spark, folder).select("doc_id").orderBy("doc_id")
    load = lambda path, split: ({"no": i, "name": f"{path} {r.doc_id}"} for i, r in enumerate(ids.toLocalIterator()))
    return io.from_hub(spark, "doc", load=load, schema="no bigint, name string")


@_query("SELECT DISTINCT url, CASE WHEN url LIKE 'https://%' THEN url WHEN url LIKE 'http://%' THEN 'https' || substr(url, 5) END AS target FROM web_docs")
def redirected_urls(spark, folder):
    """Where a stand-in service sends each url: http to https, the rest is unknown."""
    head = lambda url: (200, None) if url.startswith("https://") else (308, "https" + url[4:]) if url.startswith("http://") else (404, None)
    return io.redirected(_table(spark, folder, "web_docs").select("url").distinct(), "url", "target", head)


@_query("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY event_id) = 1")
def stream_dedup_events(spark, folder):
    """The stateful ingest over a bounded stream, run to its end."""
    path = _folder(spark, "stream")
    source = _table(spark, folder, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(folder) if os.path.isfile(f"{folder}/events.parquet") else spark.readStream.schema(source.schema).parquet(f"{folder}/events.parquet")
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    kept = stream_ingest(stream, "ts", [F.col("event_type") == "click"], ["event_id"], "1 hour").select("event_id", "user_id", "event_type")
    write_parquet(kept, path + "/out", path + "/state").awaitTermination()
    return spark.read.schema(kept.schema).parquet(path + "/out")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
