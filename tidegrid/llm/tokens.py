"""Encoding of a whole corpus with a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytepairs import encoder, merges_of, read_ranks

#: Where the vocabulary files lie unless a caller says otherwise.
VOCABULARIES = "/opt/tokenizers"
BYTE_BPE_50K = f"{VOCABULARIES}/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=4)
def vocabulary(path: str) -> tuple[list[bytes], list[tuple[int, int, int]]]:
    """Tokens and merges of a rank file; its size is that of the vocabulary, whatever the corpus."""
    tokens = read_ranks(path)
    return tokens, merges_of(tokens)


def _rows(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    return df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("__text"))


def encode_corpus(df: DataFrame, text: str = "text", keep: list[str] | None = None, path: str = BYTE_BPE_50K) -> DataFrame:
    """``keep`` columns (default doc_id) and ``ids`` ARRAY<INT>, the token ids of the whole text without special tokens.

    A null text and an empty text both give an empty list, so every row has a list. Texts of any length are encoded
    whole; rows are neither dropped nor joined, and there is no exchange. Strings that look like special tokens are text.
    """
    keep = ["doc_id"] if keep is None else keep
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, shared)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], code.encode(batch.column(batch.num_columns - 1))], [*keep, "ids"])

    rows = _rows(df, keep, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, ids array<int>")


def count_tokens(df: DataFrame, text: str = "text", keep: list[str] | None = None, path: str = BYTE_BPE_50K) -> DataFrame:
    """``keep`` columns (default doc_id) and ``n_tokens`` BIGINT, 0 for null and empty texts."""
    keep = ["doc_id"] if keep is None else keep
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, shared)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(code.counts(batch.column(batch.num_columns - 1)))], [*keep, "n_tokens"])

    rows = _rows(df, keep, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, n_tokens bigint")


def decode_corpus(df: DataFrame, ids: str = "ids", keep: list[str] | None = None, path: str = BYTE_BPE_50K) -> DataFrame:
    """``keep`` columns and ``text``, the concatenated labels of ``ids``; null ids give null, bytes that are no UTF-8 the replacement sign."""
    keep = ["doc_id"] if keep is None else keep
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(path)[0])

    @F.pandas_udf("string")
    def spell(rows):
        tokens = shared.value
        return rows.map(lambda row: b"".join(tokens[i] for i in row).decode("utf-8", "replace"), na_action="ignore")

    return df.select(*(F.col(f"`{c}`") for c in keep), spell(F.col(f"`{ids}`")).alias("text"))
