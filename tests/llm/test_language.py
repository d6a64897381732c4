import pytest

from loomwright.llm.language import LanguageModel, _bag, _classify, detect_languages, label_code, mislabelled, stretches

EN = ["The house by the river is old and quiet.", "We have seen that they do not want to leave the town.", "You should ask them before the end of the week.", "There were only a few of them on the shelf."]
DE = ["Das Haus am Fluss ist alt und ruhig.", "Wir haben gesehen, dass sie die Stadt nicht verlassen wollen.", "Man sollte sie vor dem Ende der Woche fragen.", "Es gab nur wenige davon auf dem Brett."]


@pytest.fixture(scope="module")
def model():
    return LanguageModel.fit([_bag(s) for s in EN + DE], ["en"] * 4 + ["de"] * 4, centroids=2)


def test_mixed_text_and_segments(model):
    text = EN[0] + " " + EN[1] + "\n" + DE[2] + "\n«ganz anders» 12 34"
    languages, segments = _classify([text, None, "", "12 34 !!"], model.scorer())
    assert [x["lang"] for x in languages[0]] == ["en", "de"]
    assert [text[s["start"] : s["end"]] for s in segments[0]] == [EN[0] + " " + EN[1], DE[2]]
    assert languages[1:] == [[], [], []] and segments[1:] == [[], [], []]


def test_far_text_is_rejected(model):
    languages, _ = _classify(["Qwzx vbnq plkj zzyx wqqw."], model.scorer())
    assert languages == [[]]


def test_quotes_do_not_count(model):
    languages, _ = _classify([EN[0] + " «" + DE[0] + "»"], model.scorer())
    assert [x["lang"] for x in languages[0]] == ["en"]


def test_labels(spark):
    rows = [("en_GB", "en"), (" DE ", "de"), ("Français", "fr"), ("pt-BR", "pt"), ("es_419", "es"), ("und", None), ("", None), (None, None), ("русский", "ru"), ("xx", None)]
    df = spark.createDataFrame(rows, "label string, want string").select(label_code("label").alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())


def test_mislabelled_rows(spark, model):
    rows = [(1, EN[0], "en-US"), (2, EN[0], "de"), (2, EN[0], "de"), (3, EN[0] + " " + DE[0], "en"), (4, None, "en"), (5, "", None), (6, DE[1], None)]
    df = spark.createDataFrame(rows, "page_id bigint, content string, `__language` string")
    got = detect_languages(df, model, keep=("page_id", "__language"))
    assert sorted(map(tuple, mislabelled(got).collect())) == [(2, "en"), (3, "de"), (3, "en"), (6, "de")]
    assert detect_languages(df.limit(0), model).count() == 0


def test_stretches_cover_the_text():
    text = "One. Two!\n\nThree"
    assert [text[a:b] for a, b in stretches(text)] == ["One.", "Two!", "Three"]
    assert stretches(" \n ") == []
