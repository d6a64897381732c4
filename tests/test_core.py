import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwright.functions import text as tx
from loomwright.functions import vectors as vx
from loomwright.functions.templates import rendered
from loomwright.operators import conversations as cv
from loomwright.operators import dedup, filters, frame, models
from loomwright.operators import vectors as ve
from loomwright.plans.components import connected_components
from loomwright.plans.queries import oracle_sql, queries
from loomwright.sources import io


def _values(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_filters_and_nulls(spark):
    df = spark.createDataFrame([(1, "a.blogspot.com", None), (2, None, "x+y"), (3, "None", "(z)")], "id int, url string, content string")
    assert _values(filters.filter_string(df, ["url", "gone"], ["blogspot"]), "id") == [2, 3]
    assert _values(filters.filter_string(df, ["content"], ["+y", "("]), "id") == [1]
    assert _values(filters.filter_regex(df, ["url"], "(?P<n>^N)"), "id") == [1, 2]
    assert _values(filters.tag_string(df, ["url"], ["None"], "t"), "__tag__t") == [False, False, True]
    with pytest.raises(ValueError):
        filters.filter_string(df, ["url"], [])
    pii = filters.detect_pii(spark.createDataFrame([("a@b.co",), ("https://x.y",), (None,)], "t string"), ["t"]).collect()
    assert [(r["__pii__email"], r["__pii__any"]) for r in pii] == [(True, True), (False, True), (False, False)]


def test_text(spark):
    df = spark.createDataFrame([("\t\x1c  é \n",), (None,), ("",)], "t string")
    assert _values(df, tx.strip(F.col("t"))) == ["é", None, ""]
    assert _values(df, tx.normalize_unicode(F.col("t"), "NFC"))[0] == "\t\x1c  é \n"
    assert _values(df, tx.byte_count(F.col("t"))) == [8, None, 0]
    assert _values(df.limit(1), tx.language_model_text(F.lit(" Ça coûte 12 — «ok»… "))) == ['ca coute 00  -  "ok"...']
    assert _values(df.limit(1), tx.classifier_text(F.lit("Hi,\nYou!"))) == ["hi ,  __newline__ you ! "]
    with pytest.raises(ValueError):
        tx.chained(F.col("t"), ["shout"])
    with pytest.raises(ValueError):
        tx.normalize_unicode(F.col("t"), "NFX")
    assert _values(spark.createDataFrame([("a", None)], "a string, b string"), rendered("{{a}}-{{ b }}.", ["a", "b"])) == ["a-."]
    with pytest.raises(ValueError):
        rendered("{{c}}", ["a"])


def test_shared_prefix(spark):
    rows = [("abcd", "abxy", "ab"), ("abc", "abc", "abc"), ("ab", "abc", "ab"), ("", "x", ""), ("x", "y", ""), (None, "y", None), (" ab", "ab ", "ab")]
    df = spark.createDataFrame(rows, "a string, b string, want string").select(tx.shared_prefix(F.col("a"), F.col("b")).alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())


def test_ids_and_splits(spark):
    df = spark.range(100).select((99 - F.col("id")).alias("k")).repartition(5)
    numbered = frame.with_row_id(df, ["k"])
    assert all(r["k"] == r["__id"] for r in numbered.collect()) and frame.with_row_id(numbered, ["k"]) is numbered
    with pytest.raises(ValueError):
        frame.with_row_id(df.union(df).withColumnRenamed("k", "__id"), ["__id"])
    assert frame.hash_split(df, "k").groupBy("split").count().count() == 3
    assert frame.sampled_per_group(df.withColumn("g", F.col("k") % 3), "g", 4, "k").count() == 12
    assert _values(frame.select_rows(numbered, [3, 5]).orderBy("__id"), "__id") == [3, 5] and "k" not in frame.drop_column(numbered, "k").columns


def test_exact_dedup_and_minhash(spark):
    df = spark.createDataFrame([(3, "a", None), (1, "a", None), (2, None, None), (5, None, None), (4, "a", "b")], "id int, x string, y string")
    once = dedup.exact_dedup(df, ["x", "y"], "id")
    assert sorted(_values(once, "id")) == [1, 2, 4] and sorted(_values(dedup.exact_dedup(once, ["x", "y"], "id"), "id")) == [1, 2, 4]
    tied = spark.createDataFrame([(1, "B", 1), (5, "A", 2), (5, "B", 3), (None, "Z", 4), (5, "A", 5), (None, "A", 6)], "o int, x string, r int")
    assert sorted((r.x, r.o) for r in dedup.exact_dedup(tied, ["x"], "o").collect()) == [("A", 5), ("B", 1), ("Z", None)]
    assert dedup.exact_dedup(tied.union(tied), ["x", "o"], "o").count() == 5
    base = " ".join(f"word{i}" for i in range(80))
    texts = spark.createDataFrame([(1, base), (2, base + " end"), (3, "short"), (4, None), (5, base), (6, "else " * 40)], "id int, t string")
    assert [tuple(r)[:2] for r in dedup.minhash_pairs(texts, "id", "t", 0.8).collect()] == [(1, 2)]
    signatures = {r.id: r["__minhash__t"] for r in dedup.compute_minhashes(texts, "t", num_perm=32).collect()}
    assert signatures[1] == signatures[5] and signatures[4] is None and set(signatures[3]) == {-1}


def test_minhash_pairs_that_share_a_band_are_written_only_if_they_can_be_alike(spark):
    rng = np.random.default_rng(3)
    draw = lambda n: "".join(rng.choice(list("abcdefghij"), n))
    head, rows = draw(260), []
    for i in range(60):  # half a text in common: they share bands, and none is a pair
        rows.append((f"u{i:03}", head + draw(240)))
    for i in range(12):
        base = draw(150 * (1 + i))
        rows += [(f"v{i:03}", base), (f"w{i:03}", base[:-9] + draw(9)), (f"x{i:03}", base), (f"y{i:03}", base[: len(base) * 3 // 4])]
    rows += [(None, head), ("z", None), ("z1", ""), ("v000", rows[60][1])]
    sets = {i: set(dedup._shingle_set(t, 9).tolist()) for i, t in rows if i and t and not i.startswith("x")}
    like = lambda a, b: len(a & b) / len(a | b)
    want = {(a, b): round(like(sets[a], sets[b]), 6) for a in sets for b in sets if a < b and round(like(sets[a], sets[b]), 6) >= 0.8}
    df = spark.createDataFrame(rows, "id string, t string")
    for more in ({}, {"bucket_rows": 10, "most_marks": 0}):
        got = dedup.minhash_pairs(df, "id", "t", 0.8, **more).collect()
        assert len(got) == len(want) and {(r.a, r.b): r.jaccard for r in got} == want
    names = sorted(sets)
    hashes = [np.array(sorted(sets[i]), dtype=np.uint64) for i in names]
    for threshold in (0.8, 0.5, 0.1):
        x, y = dedup._close(np.zeros(len(names), np.int64), np.array([len(h) for h in hashes]), [dedup._parities(h) for h in hashes], threshold)
        met = {tuple(sorted((names[i], names[j]))) for i, j in zip(x.tolist(), y.tolist())}
        alike = {(a, b) for a in names for b in names if a < b and like(sets[a], sets[b]) >= threshold}
        assert alike <= met and len(met) == len(x)
        if threshold == 0.8:
            assert len(met) < 100  # of 3,486


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), max_size=25))
def test_components(spark, edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*edges, (None, 3)], "src int, dst int")
    assert {r.node: r.component for r in connected_components(df).collect()} == {n: find(n) for n in {x for e in edges for x in e}}


def _clusters(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [0.99, 0.1], 0), (3, [0.9, 0.4], 0), (4, [0.0, 1.0], 0), (5, [0.0, 1.0], 1), (6, [5.0, 5.0], -1), (7, [5.0, 5.0], -1), (8, None, None)]
    return spark.createDataFrame(rows, "id int, v array<double>, c int")


def test_vectors(spark):
    df = _clusters(spark)
    assert _values(ve.nearest_neighbors(df, [1.0, 0.0], 2, "v", "id"), "id") == [6, 7]
    assert _values(ve.nearest_neighbors(df, [1.0, 0.0], 2, "v", "id", "cosine"), "id") == [1, 2]
    assert _values(df.where("id = 6"), vx.norm(vx.unit(F.col("v")))) == pytest.approx([1.0])
    # a~b and b~c join a and c
    assert sorted(_values(ve.duplicates(df, "c", "v", "id", 0.92), "id")) == [2, 3]
    fewer = [ve.semdedup(df, "c", "v", "id", threshold=t).count() for t in (0.1, 0.92, 0.95, 2.0)]
    assert fewer == sorted(fewer) and fewer[-1] == 8
    assert sorted(_values(ve.remove_prototypes(df, "c", "v", "id", 0.75), "id")).__len__() == 7
    assert sorted(_values(ve.remove_cluster(df, "c", -1), "id")) == [1, 2, 3, 4, 5, 8]
    with pytest.raises(ValueError):
        ve.semdedup(df, "c", "v", "id")
    with pytest.raises(ValueError):
        ve.cluster(df, "v", 2, cluster_col="c")
    assert 0.4 < ve.tune_threshold(df, "c", "v", "id", 0.6, clusters=[0]) <= 1.0
    info = ve.cluster_info(df, "c", "v", "id", ["v"], 2).collect()
    assert {(r.cluster, r["size"]) for r in info} == {(0, 4), (1, 1)} and len(info) == 3


def test_blocks_of_a_cluster_meet(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 6))
    rows = [(i, [float(v) for v in row], i % 2) for i, row in enumerate(x)] + [(200, None, 0), (201, [1.0] * 5, 0), (202, [2.0] * 6, -1), (203, [float("nan")] * 6, 1)]
    df = spark.createDataFrame(rows, "id int, v array<double>, c int")
    s = x @ x.T
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if i % 2 == j % 2 and s[i, j] > 1.5}
    for block in (7, 1000):
        got = ve.similar_pairs(df, "c", "v", "id", 1.5, block=block).collect()
        assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
        assert all(abs(r.score - s[r.a, r.b]) < 1e-9 and r.cluster == r.a % 2 for r in got)
        tree = [r for r in ve.linkage(df, "c", "v", "id", block=block).collect() if r.score > -1e9]
        assert len(tree) == 88
        for t in (-1.0, 0.5, 2.0):  # the tree joins what the pairs join
            pairs = spark.createDataFrame([(i, j) for i in range(90) for j in range(i) if i % 2 == j % 2 and s[i, j] > t] or [(None, None)], "src int, dst int")
            assert connected_components(pairs).where("node <> component").count() == sum(r.score > t for r in tree)
        low = {r.cluster: (r.least, r.greatest) for r in ve.similarity_range(df, "c", "v", "id", block=block).collect()}
        for c in (0, 1):
            own = [s[i, j] for i in range(c, 90, 2) for j in range(c, i, 2)]
            assert low[c] == pytest.approx((min(own), max(own)))
    few, many = (ve.nearest_class(df.where("id < 90"), spark.createDataFrame([(k, [float(v) for v in x[k]]) for k in range(20)], "label int, center array<double>"), "v", "id", block=b) for b in (100, 6))
    assert {tuple(r) for r in few.collect()} == {tuple(r) for r in many.collect()} == {(i, int(np.argmax(s[i, :20]))) for i in range(90)}


CHATS = [(1, [("system", "s"), ("user", "a"), ("assistant", "b"), ("user", "c")]), (2, []), (3, None), (4, [("user", "x"), ("user", None), ("odd", "y")])]


def test_conversations(spark):
    df = spark.createDataFrame(CHATS, "id int, c array<struct<role:string,content:string>>")
    by = lambda d, col: {r.id: r[col] for r in d.collect()}
    assert by(cv.with_length(df, "c", "n"), "n") == {1: 4, 2: 0, 3: None, 4: 3}
    assert by(cv.with_alternating(df, "c", output="a"), "a") == {1: True, 2: True, 3: None, 4: False}
    assert by(cv.with_last_speaker(df, "c", output="l"), "l") == {1: "user", 2: None, 3: None, 4: "odd"}
    assert {i: None if c is None else len(c) for i, c in by(cv.standardize_last_turn(df, "c", "assistant"), "c").items()} == {1: 3, 2: 0, 3: None, 4: 0}
    taken = cv.take_initial_system_message(df, "c", "s")
    assert by(taken, "s") == {1: "s", 2: None, 3: None, 4: None} and len(by(taken, "c")[1]) == 3
    last = cv.take_last_message(df, "c", "m")
    assert by(last, "m") == {1: "c", 2: None, 3: None, 4: "y"} and len(by(last, "c")[4]) == 2
    assert by(cv.add_initial_system_message(df, "c", "hi"), "c")[2][0]["content"] == "hi"
    text = cv.to_string(df, "c", "<U>", "<A>", "<S>", "t")
    assert by(text, "t") == {1: "<S>s<U>a<A>b<U>c", 2: "", 3: None, 4: "<U>x<U>unknowny"}
    back = by(cv.from_string(text, "t", "<U>", "<A>", "<S>", "b"), "b")
    assert [tuple(m) for m in back[1]] == CHATS[0][1] and back[2] == []
    raw = spark.createDataFrame([(1, [("human", "q", 3), ("bot", "z", 4)])], "id int, items array<struct<`from`:string,value:string,w:int>>")
    got = by(cv.from_dicts(raw, "items", metadata=["w"]), "items")[1]
    assert [(m["role"], m["content"], m["metadata"]["w"]) for m in got] == [("user", "q", 3), (None, "z", 4)]


def _Echo():
    class Echo:  # inside a function, so that it travels to the workers by value
        calls = 0

        def answer(self, prompts, choices=None):
            self.calls += 1
            return [None if self.calls == 1 else choices[0] if choices else f" {p.upper()} " for p in prompts]

    return Echo()


def test_backends(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "id int, t string").coalesce(1)
    assert _values(models.ai_column(df, "n", "say {{t}}", ["t"], _Echo(), ["strip", "lower"]), "n") == ["say ab", "say"]
    assert _values(models.ai_tagger(df, "t", ["is odd"], _Echo()), "__ai_tag__is_odd") == ["True", "True"]
    assert _values(models.ai_classifier(df, "k", "t", ["x", "y"], _Echo()), "k") == ["x", "x"]
    vectors = models.with_embeddings(df, "t", models.embedding_backend("hashed", dim=8), normalize=True).collect()
    assert sum(x * x for x in vectors[0]["__embedding"]) == pytest.approx(1, abs=1e-5) and vectors[1]["__embedding"] is None
    assert [len(p) for p in models.split_tokens(range(11), 4)] == [4, 4, 3] and [len(p) for p in models.split_tokens(range(11), 4, "greedy")] == [4, 4, 3]
    with pytest.raises(ValueError):
        models.embedding_backend("none")


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q"\nb', ["x"]), (2, None, None)], "id int, t string, l array<string>")
    for kind, read in (("jsonl", lambda p: io.from_jsonl(spark, p, df.schema)), ("parquet", lambda p: io.from_parquet(spark, p))):
        io.save(df, f"{tmp_path}/o.{kind}")
        assert sorted(map(tuple, read(f"{tmp_path}/o.{kind}").collect())) == sorted(map(tuple, df.collect()))
    io.save(df, f"{tmp_path}/o.csv")
    assert {r.id: r.t for r in io.from_csv(spark, f"{tmp_path}/o.csv").collect()} == {1: 'a "q"\nb', 2: None}
    with pytest.raises(ValueError):
        io.save(df, f"{tmp_path}/o.txt")
    with pytest.raises(Exception):
        io.save(df, f"{tmp_path}/o.csv")
    (tmp_path / "l.csv").write_bytes("t\ncafé\n".encode("latin-1"))
    assert _values(io.from_csv(spark, f"{tmp_path}/l.csv", encoding="ISO-8859-1"), "t") == ["café"]
    assert io.from_pandas(spark, pd.DataFrame({"a": [1]})).count() == 1
    assert io.html_text("<title>T</title><script>x</script><p>a&amp;b</p><nav>n</nav>c") == "Title: T\na&b\nc" and io.html_text("") is None
    kept = io.ingest(df.union(df), "id", [F.col("id") > 0], ["t"], None)
    assert kept.count() == 2  # one of each text, equal order numbers or not


def test_whole_tables_are_covered(spark, tmp_path):
    texts = ["One two, two!", "Élan vital two", "Привет мир", None, "", "日本 two"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: {r[0]: r for r in queries()[name](spark, str(tmp_path)).collect()}
    words = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in enumerate(texts)}
    f = Counter(w for ws in words.values() for w in ws)
    size = sum(f.values()) + len(f)
    got = run("perplexity_unigram")
    assert set(got) == set(words)
    for i, ws in words.items():
        want = 10 ** (-sum(math.log10((f[w] + 1) / size) for w in ws) / len(ws)) if ws else None
        assert got[i].words == len(ws) and got[i].perplexity == (want if want is None else pytest.approx(want, abs=0.051))
    shown = {i: r.text for i, r in run("classifier_preprocess").items()}
    assert shown == {0: "one two ,  two ! ", 1: "élan vital two", 2: "привет мир", 3: None, 4: "", 5: "日本 two"}
    chats = spark.createDataFrame(CHATS + [(5, [("odd", "z")])], "chat_id bigint, conversation array<struct<role:string,content:string>>")
    chats.withColumn("received_at", F.lit(None).cast("timestamp")).write.parquet(f"{tmp_path}/std_chats.parquet")
    added = {i: r.rendered for i, r in run("conv_add_system").items()}
    assert added == {1: "<S>Be brief.<S>s<U>a<A>b<U>c", 2: "<S>Be brief.", 3: None, 4: "<S>Be brief.<U>x<U>unknowny", 5: "<S>Be brief.unknownz"}


def test_languages_are_detected_from_the_text(spark, tmp_path):
    en, de = ["the house is old and the river is long", "we went there with our friends"], ["das Haus ist alt und der Fluss ist lang", "wir gingen mit unseren Freunden dorthin"]
    samples = [(i, lang, t) for lang, ts in (("en", en), ("de", de)) for i, t in enumerate(ts)]
    spark.createDataFrame(samples, "sample_id int, lang string, sample_text string").write.parquet(f"{tmp_path}/lang_samples.parquet")
    long_en, long_de = "The friends went to the old house. " * 10, "Die Freunde gingen zu dem alten Haus. " * 10
    docs = [(1, long_en, "en_GB"), (2, long_en, None), (3, long_de, "en"), (4, None, "en"), (5, "12 - 7", "en"), (6, long_en * 9, "en"), (7, "the old recipe " * 20, "en")]
    spark.createDataFrame([(*d, -1) for d in docs], "doc_id bigint, text string, lang string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: [tuple(r) for r in queries()[name](spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert run("lang_predict") == [(1, "en"), (2, "en"), (3, "de"), (4, None), (5, None), (6, "en"), (7, "en")]
    assert run("detect_then_filter") == [(1, len(long_en), "en"), (2, len(long_en), "en")]


def test_classifier_reads_word_pairs(spark):
    rows = [(i, "red fox blue hen" if i % 2 else "blue fox red hen", "x" if i % 2 else "y") for i in range(200)]  # the same words in another order
    df = spark.createDataFrame(rows, "id bigint, t string, label string")
    model, accuracy = models.train_text_classifier(df, "t", "label", "id")
    assert accuracy == 1.0
    assert all(r.label == r.guess for r in models.classify_text(df, model, "t", "guess").collect())


def test_shared_prefixes_are_those_of_whole_texts(spark, tmp_path):
    rows = [(1, "a" * 100 + "x"), (2, "a" * 100 + "y"), (3, None), (4, "a" * 70), (5, "b")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.shared for r in queries()["shared_prefix_lengths"](spark, str(tmp_path)).collect()} == {2: 100, 4: 70, 5: 0}


def test_svd_keeps_every_row_and_its_id(spark, tmp_path):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)], i % 2) for i in range(50_100)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries()["svd_embed"](spark, str(tmp_path))
    assert got.columns == ["vec_id", "embedding_svd_2"] and got.select("vec_id").distinct().count() == len(rows)
    assert got.where(F.size("embedding_svd_2") != 2).count() == 0


def test_every_query_has_sql_or_a_reason():
    assert set(oracle_sql()) <= set(queries()) and len(oracle_sql()) > 35
