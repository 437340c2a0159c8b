"""Price bars from files or tables, and header clean-up."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from barlake import schemas
from barlake.functions.text import plain_header


class NoPriceData(ValueError):
    """The source holds no bar for the request."""


def read_files(
    spark: SparkSession, path: str | Sequence[str], fmt: str = "parquet", schema: T.StructType = schemas.SOURCE_BARS
) -> DataFrame:
    """Bars from parquet, csv or json files under a declared schema (no inference pass)."""
    paths = [path] if isinstance(path, str) else list(path)
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", "true")
    return reader.format(fmt).load(paths)


def named_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table or temporary view."""
    return spark.table(name)


def publish_view(df: DataFrame, name: str) -> DataFrame:
    """Hands a frame to SQL under ``name``."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def bars_since(
    bars: DataFrame, symbols: Sequence[str], start: dt.date | str, interval: str = "1d", strict: bool = False
) -> DataFrame:
    """Bars of the requested symbols from ``start`` on; all three filters reach the scan.

    ``strict`` raises when nothing is left, at the price of one limit-1 job.
    """
    wanted = bars.filter(
        F.col("source_symbol").isin(list(symbols))
        & (F.col("date") >= F.lit(str(start)).cast("timestamp"))
        & (F.col("source_interval") == interval)
    )
    if strict and wanted.isEmpty():
        raise NoPriceData(f"no bars for {', '.join(symbols)} since {start}")
    return wanted


def plain_headers(df: DataFrame) -> DataFrame:
    """Renames every column to its plain form; metadata only."""
    return df.toDF(*[plain_header(c) for c in df.columns])
