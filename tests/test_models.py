import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.functions import text as tx
from loomwright.operators import frame, models
from loomwright.operators import vectors as ve
from loomwright.sources import io


def _points(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([c + 0.1 * rng.normal(size=(60, 4)) for c in np.eye(4)[:3]])
    return spark.createDataFrame([(i, [float(v) for v in row], "abc"[i // 60]) for i, row in enumerate(x)], "id bigint, v array<double>, label string"), x


def test_token_counts_against_another_library(spark, tmp_path):
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    if not os.path.exists(path):
        pytest.skip("no vocabulary file")
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    encoding = tiktoken.Encoding("t", pat_str=tx.BYTE_BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["There are three words", "", None, "a  b\n\n<|endoftext|> 🙂", "x" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(2)
    got = {r.id: r.n for r in df.select("id", tx.token_count(F.col("t"), tx.byte_pairs(path)).alias("n")).collect()}
    assert got == {i: None if t is None else len(encoding.encode(t, disallowed_special=())) for i, t in enumerate(texts)}


def test_arpa_models(spark, tmp_path):
    lines = ["\\data\\", "ngram 1=4", "", "\\1-grams:", "-1.0\t<unk>", "-99\t<s>\t-0.5", "-0.5\ta\t-0.2", "-0.7\t</s>", "", "\\2-grams:", "-0.1\t<s> a", "", "\\end\\"]
    model = models.ArpaModel(lines)
    assert model.perplexity("a") == pytest.approx(10 ** ((0.1 + 0.2 + 0.7) / 2))
    assert model.perplexity("b") == pytest.approx(10 ** ((0.5 + 1.0 + 0.7) / 2))
    path = f"{tmp_path}/m.arpa"
    df = spark.createDataFrame([(1, "the cat sat"), (2, "the dog sat"), (3, None)], "id int, t string")
    models.write_arpa_bigrams(df, "t", path)
    trained = models.ArpaModel.load(path)
    for context in ("<s>", "the", "cat"):  # a distribution: all next words sum to one
        assert sum(10 ** trained._word((context,), w) for w in ("the", "cat", "dog", "sat", "</s>", "<unk>")) == pytest.approx(1, abs=1e-6)
    got = {r.id: r.p for r in models.arpa_perplexity(df, "t", "p", path).collect()}
    assert got[3] is None and got[1] < models.ArpaModel.load(path).perplexity("sat the the")


def test_request_budget_waits_for_both_limits():
    now, slept = [0.0], []
    budget = models.RequestBudget(60, 6000, lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(60):
        budget.wait(1, 10)
    assert slept == []
    budget.wait(1, 10)
    assert slept == [pytest.approx(1.0)]
    budget.wait(1, 6000)
    assert now[0] == pytest.approx(6.1)  # 610 tokens have to come back


def test_pauses_and_failures(spark):
    class Strict:
        def __init__(self):
            self.asked = 0

        def answer(self, prompts, choices=None):
            self.asked += 1
            if self.asked == 2:
                raise models.RateLimited
            return [None if p == "never" else p.upper() for p in prompts]

    settings = models.RequestSettings(batch_rows=2, at_once=1, pause=0.0)
    got = models._ask(["a", "b", "never", "c", "d"], Strict(), None, settings, models.RequestBudget(None, None))
    assert got == ["A", "B", None, "C", "D"]


def test_failed_requests_are_null(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, p string")

    class Never:
        def answer(self, prompts, choices=None):
            return [None] * len(prompts)

    assert [r.a for r in models.answered(df, "p", "a", Never()).collect()] == [None, None]


def test_embedding_backends():
    run = lambda ids, mask: np.stack([np.full((ids.shape[1], 2), row.sum()) for row in ids * mask])
    local = models.embedding_backend("session", make=lambda: (lambda t: [len(w) for w in t.split()], run), most=3)
    local.load()
    assert local.embed(["a bb", "ccc", "a a a a a", ""]).tolist() == [[3, 3], [3, 3], [3, 3], [0, 0]]
    calls = []

    def post(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise OSError
        return [[float(len(t))] for t in texts]

    remote = models.embedding_backend("service", post=post, batch=2, pause=0.0)
    remote.load()
    assert remote.embed(["a", "bb", "ccc"]).tolist() == [[1], [2], [3]] and calls == [2, 2, 1]


def test_trained_classifiers(spark):
    df, _ = _points(spark)
    for kind in ("logistic", "svm"):
        model, accuracy = models.train_embedding_classifier(df, "v", "label", "id", kind)
        assert accuracy > 0.95
        guesses = models.classify_embeddings(df, model, "v", "guess")
        report = {r.label: r for r in frame.class_report(guesses, "label", "guess").collect()}
        assert set(report) == {"a", "b", "c"} and all(r.precision > 0.95 and r.recall > 0.95 and r.rows == 60 for r in report.values())
    with pytest.raises(ValueError):
        models.train_embedding_classifier(df, "v", "label", "id", "forest")


def test_reduction_and_clusters(spark):
    df, x = _points(spark)
    svd = {r.id: r.s for r in ve.reduce_dimensions(df, "v", 2, "svd", "s").collect()}
    u, d, _ = np.linalg.svd(x, full_matrices=False)
    want = u[:, :2] * d[:2]
    got = np.array([svd[i] for i in range(len(x))])
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-8)
    pca = np.array([r.v_pca_2 for r in ve.reduce_dimensions(df, "v", 2).orderBy("id").collect()])
    assert np.allclose(np.cov(pca.T), np.diag(np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:2]), atol=1e-8)
    found = {(r.label, r["__cluster"]) for r in ve.cluster(df, "v", 3).collect()}
    assert len(found) == 3
    for options in ({"method": "linkage", "threshold": 0.9}, {"method": "density", "n_clusters": 1}, {"method": "density", "n_clusters": 1, "min_cluster_size": 10}):
        dense = {(r.label, r["__cluster"]) for r in ve.cluster(df, "v", id_col="id", **options).collect() if r["__cluster"] != -1}
        assert len(dense) == 3 == len({c for _, c in dense})
    kernel = {r.id: r.k for r in ve.reduce_dimensions(df, "v", 2, "kernel_pca", "k", gamma=0.7).collect()}
    k = np.exp(-0.7 * ((x[:, None, :] - x[None, :, :]) ** 2).sum(2))
    h = np.eye(len(x)) - 1 / len(x)
    values, axes = np.linalg.eigh(h @ k @ h)
    want = np.abs(axes[:, ::-1][:, :2] * np.sqrt(values[::-1][:2]))
    assert np.allclose(np.abs([kernel[i] for i in range(len(x))]), want, atol=1e-6)
    assert ve.cluster_centers(df, "v", 3).count() == 3
    with pytest.raises(ValueError):
        ve.reduce_dimensions(df, "v", 2, "umap")


def test_persistent_groups():
    x = np.r_[np.linspace(0, 1, 40), np.linspace(5, 5.6, 30), np.linspace(6.2, 6.8, 30), [20.0, 30.0, -9.0]]  # two of the three groups lie close together
    order = np.argsort(x)
    a, b = order[:-1], order[1:]
    label = ve.condensed_labels(a, b, x[b] - x[a], len(x), 10)
    assert {len(set(label[s].tolist()) - {-1}) for s in (slice(0, 40), slice(40, 70), slice(70, 100))} == {1}
    assert len(set(label.tolist()) - {-1}) == 3 and (label[100:] == -1).all()
    assert (label[:100] >= 0).mean() > 0.9
    assert (ve.condensed_labels(np.zeros(0, int), np.zeros(0, int), np.zeros(0), 1, 5) == -1).all()


def test_pages_links_and_hubs(spark):
    df = spark.createDataFrame([(1, "<title>T</title><p>a &amp; b</p><script>x</script>"), (2, ""), (3, None)], "id int, h string")
    assert {r.id: r.t for r in io.with_html_text(df, "h", "t").collect()} == {1: "Title: T\na & b", 2: None, 3: None}
    urls = spark.createDataFrame([("u1",), ("u2",), ("u3",), ("u4",), (None,)], "u string")

    def head(u):
        if u == "u4":
            raise OSError
        return {"u1": (200, None), "u2": (308, "v2"), "u3": (404, None)}[u]

    assert {r.u: r.to for r in io.redirected(urls, "u", "to", head).collect()} == {"u1": "u1", "u2": "v2", "u3": None, "u4": None, None: None}
    hub = io.from_hub(spark, "set", load=lambda p, s: ({"a": i, "b": f"{p}/{s}"} for i in range(10)), max_rows=7)
    assert hub.count() == 7 and {r.b for r in hub.collect()} == {"set/train"}
    assert io.from_hub(spark, "set", load=lambda p, s: iter(()), schema="a int").count() == 0
    with pytest.raises(ValueError):
        io.from_hub(spark, "set", load=lambda p, s: iter(()))


def test_pages_from_a_local_server(spark):
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response({"/a": 200, "/moved": 308}.get(self.path, 404))
            if self.path == "/moved":
                self.send_header("Location", "/a")
            self.end_headers()
            if self.command == "GET":
                self.wfile.write("<p>né</p>".encode())

        do_HEAD = do_GET
        log_message = lambda *a: None

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        df = spark.createDataFrame([(f"{base}/a",), (f"{base}/none",), (None,)], "u string")
        assert {r.u: r.t for r in io.fetched(df, "u", "t", io.http_get(), "Failed to scrape").collect()} == {f"{base}/a": "<p>né</p>", f"{base}/none": "Failed to scrape", None: None}
        df = spark.createDataFrame([(f"{base}/a",), (f"{base}/moved",), (f"{base}/none",)], "u string")
        assert {r.u.rsplit("/")[-1]: r.t for r in io.redirected(df, "u", "t", io.http_head()).collect()} == {"a": f"{base}/a", "moved": "/a", "none": None}
    finally:
        server.shutdown()


def test_extracted_files(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.bin").write_bytes(b"hy-\nphen")
    assert [r.text for r in io.extracted(spark, f"{tmp_path}/f", lambda b: b.decode()).collect()] == ["hyphen"]


def test_shuffles_and_draws(spark):
    df = spark.range(200).withColumn("g", F.col("id") % 3)
    one, two = ([r.id for r in frame.shuffled(df, s, "id").collect()] for s in (1, 2))
    assert sorted(one) == list(range(200)) and one != two and one != sorted(one)
    drawn = frame.drawn_per_group(df, "g", 50, "id").collect()
    assert len(drawn) == 150 and all(r.g == r.id % 3 for r in drawn) and len({r.id for r in drawn}) < 150
    numbered = frame.with_row_id(df.repartition(7), [F.desc("id")], "n")
    assert all(r.n == 199 - r.id for r in numbered.collect())
    assert frame.row_at(numbered, 3, "n")["id"] == 196 and frame.row_at(numbered, 900, "n") is None
    split = {r.split: r.n for r in frame.hash_split(spark.range(5000), "id", 0.2, 0.1).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert abs(split["validation"] - 1000) < 120 and abs(split["test"] - 500) < 100


def test_a_stream_drops_repetitions_and_late_rows(spark, tmp_path):
    from loomwright.streaming.ingest import stream_ingest, write_parquet

    schema = "ts timestamp, k string, v int"
    parts = [
        [("2024-01-01 10:00:00", "a", 1), ("2024-01-01 10:05:00", "a", 2), ("2024-01-01 12:00:00", "b", 3)],
        [("2024-01-01 12:10:00", "c", 4), ("2024-01-01 12:01:00", "b", 5)],
        [("2024-01-01 08:00:00", "d", 6), ("2024-01-01 12:20:00", "e", -1), ("2024-01-01 12:30:00", "f", 7)],
    ]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "ts string, k string, v int").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/in/p{i}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        write_parquet(stream_ingest(stream, "ts", [F.col("v") > 0], ["k"], "1 hour"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = sorted((r.k, r.v) for r in spark.read.schema(schema).parquet(f"{tmp_path}/out").collect())
    # one a, one b; d came four hours late, e is filtered
    assert [k for k, _ in got] == ["a", "b", "c", "f"]


def test_prefix_columns(spark):
    df = spark.createDataFrame([(" abc", "abd "), ("x", None), ("", "y")], "a string, b string")
    rows = tx.with_shared_prefix(df, "a", "b", "p", "ra", "rb").select("p", "ra", "rb").collect()
    assert [tuple(r) for r in rows] == [("ab", "c", "d"), (None, None, None), ("", "", "y")]
