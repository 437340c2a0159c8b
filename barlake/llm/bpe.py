"""Byte-level BPE encoding and decoding with a local rank file."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
import tiktoken.registry
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm.shared import read_table, slices

RANKS = "byte_bpe_multi_50k.tiktoken"
# Characters after which the next safe boundary is taken.
PIECE = 1 << 16
# Between a character that is no white space and a blank, tab or line break no match of the pattern continues: only
# white-space matches hold white space behind their first character, and they hold nothing else.
_SAFE = re.compile(r"\S(?=[ \t\r\n])")


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """One encoder per worker, kept in the library's own table; the rank file is read where the task runs."""
    name, known = f"{path}\0{pattern}", tiktoken.registry.ENCODINGS
    if name not in known:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        known[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return known[name]


def pieces(text: str) -> Iterator[str]:
    """The text in pieces that encode like the whole; a run without safe boundary stays in one piece."""
    start = 0
    while len(text) - start > PIECE:
        cut = _SAFE.search(text, start + PIECE - 1)
        if cut is None:
            break
        yield text[start : cut.end()]
        start = cut.end()
    if start < len(text):
        yield text[start:]


def encode_text(text: str | None, path: str, pattern: str) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    own = encoding(path, pattern)
    return b"".join(np.asarray(own.encode_ordinary(p), dtype="<u4").tobytes() for p in pieces(text or ""))


def decode_ids(ids: bytes, path: str, pattern: str, step: int = 1 << 16) -> bytes:
    own, every = encoding(path, pattern), np.frombuffer(ids, dtype="<u4")
    return b"".join(own.decode_bytes(every[i : i + step].tolist()) for i in range(0, len(every), step))


def encoded(text: Column, path: str, pattern: str = public_tokenizers.PATTERN) -> Column:
    """Column of ids (binary, little-endian uint32) of a text column, without special tokens; null is empty."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([encode_text(t, path, pattern) for t in batch], dtype=object)

    return run(text)


def decoded(ids: Column, path: str, pattern: str = public_tokenizers.PATTERN) -> Column:
    """Column of raw bytes of an id column; null is empty."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([decode_ids(i or b"", path, pattern) for i in batch], dtype=object)

    return run(ids)


def both_ways(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", pattern: str = public_tokenizers.PATTERN
) -> DataFrame:
    """``doc_id``, ``ids`` (binary, little-endian uint32) and ``raw`` (the ids decoded again) for every row of ``docs``.

    One Python worker a task does both: ``encoded`` and ``decoded`` in one query run two, each with its own batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [encode_text(t, path, pattern) for t in part.column("text").to_pylist()]
                raw = [decode_ids(i, path, pattern) for i in ids]
                columns = [part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "raw"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, raw binary")


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row of ``docs``; other columns do not matter.

    Null and empty texts have no ids. Repeated rows and null ids keep their own output row. Long texts are cut at
    safe boundaries, so memory holds few texts and their ids.
    """
    return both_ways(docs, path, doc_id, text).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("raw", 256).alias("decoded_sha256"),
    )


def op6_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


QUERIES = {"op6_byte_level_bpe": op6_byte_level_bpe}
SQL: dict[str, str] = {}
