import pytest

from loomwright.llm.pii import candidates, find_pii, mask_pii

GIVEN = ["Anna", "Hugo", "Rose"]


@pytest.fixture(scope="module")
def given(spark):
    return spark.createDataFrame([(i, g) for i, g in enumerate(GIVEN)] + [(9, None)], "name_id int, given_name string")


TEXTS = [
    "This piece was written by Anna Falk for the page.",
    "This piece was written by Hugo Brandt for the page.",
    "This piece was written by Rose von Stahl for the page.",
    "This piece was written by Tavio Renner for the page. Basil, Olive, Ginger",
    "Keep your passport no. (ZZ1234567) at hand.",
    "passport no.: ZZ7654321\npassport no.: ZZ7654399",
    "Reisepass: ZZ1111111 und mehr.",
    "Invoice 4136885523 and Order no. 7667-54074-45, SKU 974-59-5089X",
    "Call +44 20 7946 0123 before noon. Fax or phone ((286) 555-0101) both work.",
    "Call (212) 555-0116 before noon.\nCall (213) 555-0117 before noon.\nCall +1 214-555-0118 now.",
    "She lives at 12b Oak Street, flat 4. The shop is in Elm Street.",
    "Write to a.b [at] mill [dot] example or c@d.test, a@b = c@d, lib@7.1.5, @handle",
    "Write to e.f@mill.example again.",
]


def test_items_and_decoys(spark, given):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(90, None, "x"), (91, "", "x")], "page_id bigint, content string, start string")
    got = {(r.page_id, r.pii_type, r.pii_text) for r in find_pii(df, given).collect()}
    assert got == {
        (0, "person_name", "Anna Falk"),
        (1, "person_name", "Hugo Brandt"),
        (2, "person_name", "Rose von Stahl"),
        (3, "person_name", "Tavio Renner"),  # not a listed name: the context brings it in
        (4, "id_number", "ZZ1234567"),
        (5, "id_number", "ZZ7654321"),
        (5, "id_number", "ZZ7654399"),
        (6, "id_number", "ZZ1111111"),  # not a known caption: the shape brings it in
        (8, "phone", "+44 20 7946 0123"),
        (8, "phone", "(286) 555-0101"),  # neither seed nor known caption: the shape brings it in
        (9, "phone", "(212) 555-0116"),
        (9, "phone", "(213) 555-0117"),
        (9, "phone", "+1 214-555-0118"),
        (10, "street_address", "12b Oak Street"),
        (11, "email", "a.b [at] mill [dot] example"),  # written out: its context brings it in
        (11, "email", "c@d.test"),
        (12, "email", "e.f@mill.example"),
    }


def test_addresses_go_through_the_graph(spark, given):
    texts = [f"Send the parcel to {i} Oak Street, flat {i}. Thanks." for i in range(1, 9)]
    texts += ["Send the parcel to 14 Barrow Close, please.", *[f"Send the parcel to {n} Alder Close, please." for n in (15, 18, 19, 21, 23)], "We met near 16 Alder Close yesterday."]
    texts += [f"The server said status {400 + i} Error Drive again." for i in range(30)]
    texts += [f"We read about page Chapter {i} there." for i in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "page_id bigint, content string")
    got = {r.pii_text: r.score for r in find_pii(df, given).where("pii_type = 'street_address'").collect()}
    assert {t for t in got if "Oak" in t} == {f"{i} Oak Street" for i in range(1, 9)}
    assert {t for t in got if "Oak" not in t} == {"14 Barrow Close", *(f"{n} Alder Close" for n in (15, 16, 18, 19, 21, 23))}  # a street word no list has
    assert got["16 Alder Close"] < 1.0


def test_mask_changes_only_the_items(spark, given):
    df = spark.createDataFrame([(1, "x 🙂 Write to c@d.test now"), (2, None), (3, "nothing")], "page_id bigint, content string")
    masked = {r.page_id: r.masked for r in mask_pii(df, find_pii(df, given)).collect()}
    assert masked == {1: "x 🙂 Write to [EMAIL] now", 2: None, 3: "nothing"}


def test_empty_table_and_long_text(spark, given):
    empty = spark.createDataFrame([], "page_id bigint, content string")
    assert find_pii(empty, given).count() == 0
    text = "word " * 50_000 + "c@d.test"
    assert [c[0] for c in candidates(text, frozenset())] == ["email"]
    assert candidates("9" * 50_000 + " " + "A" * 50_000, frozenset()) is not None
