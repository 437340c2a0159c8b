"""What the corpus operators share: tables in the shared folder, Arrow plumbing, byte helpers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.session import fresh_folder

# A-Z to a-z on UTF-8 bytes; bytes of other characters are 0x80 and above and stay.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_SPACE = re.compile(rb"[\x20\x09-\x0D]")

# Parquet row groups of tables with large binary values: a reader decodes one group at a time.
ROW_GROUP_BYTES = 16 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Scratch:
    """Written tables below ``spark.checkpoint.dir``: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = fresh_folder(spark, label)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.mode("overwrite").option("parquet.block.size", ROW_GROUP_BYTES).option("compression", "zstd").parquet(
            path
        )
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that no returned frame reads any more."""
        fs, path = pafs.FileSystem.from_uri(self.path(name))
        if fs.get_file_info(path).type != pafs.FileType.NotFound:
            fs.delete_dir(path)


@contextmanager
def held(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Inside, a setting has this value."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a finished job are removed at once, so that rounds do not add up on disk."""
    with held(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        yield


def with_row_key(df: DataFrame, *columns: str) -> DataFrame:
    """``row_key``: equal for repeated rows, never null, so joins work with null and repeated ids."""
    return df.withColumn("row_key", F.xxhash64(*[F.col(c) for c in columns]))


def free_name(df: DataFrame, name: str) -> str:
    """The name, or a longer one that no column has."""
    while name in df.columns:
        name += "_"
    return name


def text_blocks(raw: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A text in parts of about ``size`` bytes that end before white space; a longer word stays whole."""
    at = 0
    while at < len(raw):
        cut = _SPACE.search(raw, at + size) if at + size < len(raw) else None
        end = cut.start() if cut else len(raw)
        yield raw[at:end]
        at = end


def slices(batch: pa.RecordBatch, text: str, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ``size`` bytes of text, so that only few texts are held as Python objects at a time;
    a longer text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def binary_list(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()
