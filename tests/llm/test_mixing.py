import math

import pytest

from loomwright.llm.language import LanguageModel, _bag
from loomwright.llm.mixing import mix_shares, mix_to_targets, target_weights, temperature_weights
from loomwright.llm.token_budget import host_of, token_budget
from loomwright.llm.queries import p9_temperature
from loomwright.llm.tokenizer import encoder


def test_temperature_reaches_the_entropy():
    tokens = {"a": 900.0, "b": 90.0, "c": 10.0, "none": 0.0}
    w = temperature_weights(tokens, entropy=1.0)
    assert abs(-sum(x * math.log(x) for x in w.values()) - 1.0) < 1e-6 and w["a"] > w["b"] > w["c"] and "none" not in w
    assert temperature_weights(tokens, entropy=9.9) == pytest.approx(dict.fromkeys("abc", 1 / 3))
    held = temperature_weights(tokens, entropy=9.9, total=300, max_repeats={"a": 1, "b": 2, "c": 2})
    assert held["c"] * 300 <= 20 + 1e-6 and held["b"] * 300 <= 180 + 1e-6
    assert temperature_weights({}) == {}


def test_target_weights_respect_repeats():
    w, total = target_weights({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 3})
    assert w == {"a": 0.5, "b": 0.5} and total == pytest.approx(60)
    w, total = target_weights({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 3}, total=90)
    assert total == pytest.approx(90) and w["b"] * 90 <= 30 + 1e-6 and w["b"] > 10 / 110
    assert target_weights({}, {"a": 1.0}, {}) == ({}, 0.0)


def test_shares_are_reached(spark):
    rows = [(i, "big" if i % 10 else "small", 5 + i * 7 % 90) for i in range(4000)] + [(5000, None, 10), (5001, "big", 0), (5002, "unlisted", 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3), ("absent", 0.0, 1)], "source string, target_share double, max_repeats int")
    mix, weights, total = mix_to_targets(df, targets)
    got = {r.doc_id: r.repeats for r in mix.collect()}
    assert len(got) == len(rows) and got[5000] == got[5001] == got[5002] == 0
    shares = {r.source: r for r in mix_shares(mix, targets).collect()}
    assert abs(shares["big"].reached_share - 0.6) < 1e-3 and abs(shares["small"].reached_share - 0.4) < 1e-3
    assert shares["big"].most_repeats <= 1 and shares["small"].most_repeats <= 3
    assert sum(r.mixed_tokens for r in shares.values()) <= total + 1e-6
    assert mix_to_targets(df.limit(0), targets)[0].count() == 0


def test_temperature_mix_is_as_large_as_the_corpus(spark, tmp_path):
    rows = [(i, "big" if i % 5 else "small", f"some words of text number {i}") for i in range(2000)]
    spark.createDataFrame(rows, "doc_id bigint, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 4)], "source string, target_share double, max_repeats int")
    targets.write.parquet(f"{tmp_path}/source_targets.parquet")
    got = {r.source: r for r in p9_temperature(spark, str(tmp_path)).collect()}
    everything = sum(r.tokens for r in got.values())
    assert 0.99 * everything <= sum(r.mixed_tokens for r in got.values()) <= everything
    assert all(r.most_repeats <= r.max_repeats for r in got.values())


def test_budget_totals(spark):
    model = LanguageModel.fit([_bag("The house by the river is old."), _bag("Das Haus am Fluss ist alt.")], ["en", "de"], centroids=1)
    rows = [(1, "The house is old.", "s", "de", "a.test", 9), (1, "The house is old.", "s", "de", "a.test", 9), (2, "Das Haus ist alt.", None, None, "b.test", None), (3, None, "s", "fr", None, -4), (4, "", "s", "xx", "a.test", 0)]
    df = spark.createDataFrame(rows, "id bigint, text string, source string, label string, host string, recorded int")
    domains = spark.createDataFrame([("A.test", "cooking"), ("b.test", None), (None, "x")], "site string, topic_domain string")
    got = {(r.corpus, r.source, r.language, r.topic_domain): r for r in token_budget({"c": df}, domains, model).collect()}
    count = lambda t: len(encoder().encode(t))
    everything = got[("*", "*", "*", "*")]
    assert everything.documents == 4 and everything.tokens == count(rows[0][1]) + count(rows[2][1])
    assert (everything.recorded_documents, everything.recorded_tokens, everything.labels_belied) == (1, 9, 1)
    assert got[("c", "s", "en", "cooking")].tokens == count(rows[0][1])
    assert got[("c", "unknown", "de", "unknown")].documents == 1 and got[("c", "s", "fr", "unknown")].tokens == 0
    assert token_budget({"c": df.limit(0)}, domains, model).where("corpus <> '*'").count() == 0


def test_hosts(spark):
    urls = [("https://WWW.A.test:80/x?y#z", "a.test"), ("b.test/p", "b.test"), ("//c.test.", "c.test"), ("http://u:p@d.test/", "d.test"), ("", None), (None, None)]
    df = spark.createDataFrame(urls, "url string, want string").select(host_of("url").alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())
