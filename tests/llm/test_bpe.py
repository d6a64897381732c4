import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwright.llm.bpe import RankQueue, load_ranks
from loomwright.llm.token_ids import encode_corpus, with_token_counts
from loomwright.llm.tokenizer import DEFAULT_FOLDER, PATTERN, encoder


@pytest.fixture(scope="module")
def public():
    return _PUBLIC


_PUBLIC = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load_ranks(f"{DEFAULT_FOLDER}/byte_bpe_50k.tiktoken"), special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_any_text_encodes_like_the_public_library(text):
    assert encoder().encode(text) == _PUBLIC.encode_ordinary(text)


def test_long_and_odd_pre_tokens(public):
    rng = random.Random(5)
    cases = [
        "a" * 5000,
        "ab" * 3000 + "́",
        "".join(rng.choice("etaoin shrdlu") for _ in range(4000)),
        "<|endoftext|> don't 'S we'll",
        " \n\n\t  x  \r\n y \x1c\x1d z　 w ",
        "日本語テキスト" * 300,
        "🙂🙃" * 50,
        "0123456789" * 400,
    ]
    ids, counts = encoder().encode_batch(cases)
    position = 0
    for text, n in zip(cases, counts.tolist()):
        assert ids[position : position + n].tolist() == public.encode_ordinary(text)
        position += n


def test_rank_queue_orders_like_a_set():
    rng = random.Random(1)
    queue, members = RankQueue(50_257), set()
    for _ in range(3000):
        rank = rng.randrange(50_257)
        if rng.random() < 0.6:
            queue.add(rank)
            members.add(rank)
        elif members:
            low = min(members)
            assert queue.first() == low
            queue.discard(low)
            members.discard(low)
    assert queue.first() == (min(members) if members else -1)


def test_corpus_rows(spark, public):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello wörld", "x"), (3, "Hello wörld", "y"), (4, " " * 50, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in encode_corpus(df).collect())
    want = sorted((i, public.encode_ordinary(t) if t else []) for i, t, _ in rows)
    assert got == want
    counted = {(r.doc_id, r.ids): r.tokens for r in with_token_counts(df, "text").collect()}
    assert counted[(1, "x")] == 0 and counted[(3, "y")] == len(public.encode_ordinary("Hello wörld"))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert encode_corpus(df).count() == 0
