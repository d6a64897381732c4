"""Encoding of a whole corpus with a public tokenizer (problem 8).

Every text goes through :class:`loomwright.llm.bpe.BytePairEncoder`, whose
hierarchical-bitmap rank queue keeps very long pre-tokens linear.  The encoder
is loaded once per Python worker; rows travel as Arrow batches; there is no
shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.tokenizer import DEFAULT_FOLDER, DEFAULT_NAME, encoder, vocabulary
from loomwright.plans.lineage import spread


def encode_corpus(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = DEFAULT_NAME,
    folder: str = DEFAULT_FOLDER,
    ids_col: str = "ids",
) -> DataFrame:
    """``(id, ids)`` for every row of ``df``, ids without special tokens.

    Null and empty texts give an empty list.  Strings that look like special
    tokens are ordinary text.  Repeated rows stay repeated; other columns are
    dropped before the Python step.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer, folder)
        for batch in batches:
            ids, counts = bpe.encode_batch(batch.column(1).to_pylist())
            offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[id_col, ids_col])

    narrow = df.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("__text"))
    return spread(narrow).mapInArrow(run, f"`{id_col}` {id_type}, `{ids_col}` array<int>")


def with_token_counts(
    df: DataFrame,
    text_col: str,
    count_col: str = "tokens",
    tokenizer: str = DEFAULT_NAME,
    folder: str = DEFAULT_FOLDER,
) -> DataFrame:
    """``df`` without ``text_col``, with the exact token count of each text.

    Null and empty texts count 0.  The text leaves the plan here, so no later
    shuffle carries it.
    """
    keep = [c for c in df.columns if c not in (text_col, count_col)]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[f"`{c}`" for c in keep]).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer, folder)
        for batch in batches:
            counts = bpe.count_batch(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts)], names=[*keep, count_col])

    narrow = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("__text"))
    return spread(narrow).mapInArrow(run, f"{fields}{', ' if fields else ''}`{count_col}` bigint")


def decode_corpus(
    df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", text_col: str = "text", tokenizer: str = DEFAULT_NAME, folder: str = DEFAULT_FOLDER
) -> DataFrame:
    """``(id, text)`` from the token ids of :func:`encode_corpus`; an empty list gives an empty text, null gives null."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(tokenizer, folder)
        for batch in batches:
            texts = [None if ids is None else b"".join(map(words.__getitem__, ids)).decode("utf-8", "surrogatepass") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, text_col])

    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {id_type}, `{text_col}` string")
