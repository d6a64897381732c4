import random

import numpy as np
import pytest

from loomwright.llm.splitting import GRID_CHARS, LEAD_CHARS, TAIL_CHARS, atoms, range_chunks, rebuilt, split_oversized
from loomwright.llm.bpe import _CHUNKS
from loomwright.llm.tokenizer import encoder


def _texts():
    rng = random.Random(3)
    words = ["alpha", "beta,", "gamma.", "délta", "epsilon!\n", "zeta\n\n", "日本語", "🙂", "  ", "x" * 30]
    long = " ".join(rng.choice(words) for _ in range(3000))
    return {
        1: long,
        2: "a short one",
        3: "9f3k" * 900,
        4: "",
        5: None,
        6: "One sentence here. " * 60,
        7: "\n" * 400 + " " * 300 + "word " * 100,
        8: "ab " + "語" * 5000 + " end. " + "tail " * 50,
    }


@pytest.mark.parametrize("range_chars", [1_000_000, 3_000])
def test_pieces_cover_texts_and_keep_the_limit(spark, range_chars):
    texts = _texts()
    rows = [(i, t, "s", "q") for i, t in texts.items()] + [(20, "word " * 900, None, "q"), (21, "word " * 900, "other", "q")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, piece string")
    limits = spark.createDataFrame([("s", 64, 8), ("empty", None, 3)], "source string, max_tokens int, overlap_tokens int")
    got = {}
    for r in split_oversized(df, limits, range_chars=range_chars).collect():
        got.setdefault(r.doc_id, []).append(r)
    count = lambda t: len(encoder().encode(t))
    assert set(got) == {i for i, t in texts.items() if t and count(t) > 64}
    for i, pieces in got.items():
        pieces.sort(key=lambda r: r.piece_no)
        assert [r.piece_no for r in pieces] == list(range(len(pieces)))
        assert pieces[0].start == 0 and pieces[-1].end == len(texts[i])
        for before, r in zip([None, *pieces], pieces):
            assert r.piece == texts[i][r.start : r.end] and count(r.piece) <= 64
            if before is not None:
                assert before.start < r.start <= before.end < r.end
                assert count(texts[i][r.start : before.end]) <= 8
    ends = [r.piece for r in sorted(got[6], key=lambda r: r.piece_no)[:-1]]
    assert all(p.rstrip().endswith(".") for p in ends)
    assert any(r.shared_tokens > 0 for r in got[1])


def test_the_table_does_not_depend_on_the_ranges():
    bpe = encoder()
    texts = [t for t in _texts().values() if t]
    texts += ["x" * (GRID_CHARS - 3) + " end. " * 900, ("w" * 3000 + "\n\n") * 5 + "a b. " * 700, " " * 5000 + "z. " * 900, "y" * GRID_CHARS + " " + "q" * (2 * GRID_CHARS)]
    for text in texts:
        tables = []
        for size in (GRID_CHARS, 2 * GRID_CHARS, 64 * GRID_CHARS):
            out, cut = [], []
            for a in range(0, len(text), size):
                b = min(a + size, len(text))
                low = max(a - LEAD_CHARS, 0)
                view = text[low : b + TAIL_CHARS]
                first, chunks = range_chunks(view, a - low, b - low, a, bpe, b == len(text))
                cut += chunks
                out.append(atoms(view, first, chunks, bpe.chunk_counts([chunks])[0], bpe, 64))
            assert "".join(cut) == text
            if max(map(len, _CHUNKS(text))) <= GRID_CHARS:
                assert cut == _CHUNKS(text)
            tables.append([np.concatenate(v).tolist() for v in zip(*out)])
        assert tables[0] == tables[1] == tables[2]


def test_same_pieces_for_every_range_size(spark):
    df = spark.createDataFrame([(i, t, "s") for i, t in _texts().items()], "doc_id bigint, text string, source string")
    limits = spark.createDataFrame([("s", 64, 8)], "source string, max_tokens int, overlap_tokens int")
    got = [sorted(map(tuple, split_oversized(df, limits, range_chars=n).collect())) for n in (1_000_000, GRID_CHARS, 3 * GRID_CHARS)]
    assert got[0] == got[1] == got[2] and len(got[0]) > 100
    whole = {r.doc_id: r.text for r in rebuilt(df, split_oversized(df, limits, range_chars=GRID_CHARS)).collect()}
    assert whole == _texts()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    limits = spark.createDataFrame([("s", 64, 8)], "source string, max_tokens int, overlap_tokens int")
    assert split_oversized(df, limits).count() == 0
