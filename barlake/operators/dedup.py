"""One row per symbol and date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

# Newest version first; the remaining columns make the order total.
VERSION_ORDER = ("ingestion_ts", "ingestion_run_id", "open", "high", "low", "close", "adj_close", "volume")


def _first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``row_number() = 1``: each map task sorts its rows and passes on at most one row per key
    (WindowGroupLimit), so a key with a large share of the log never meets in one task."""
    window = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("rn", F.row_number().over(window)).filter("rn = 1").drop("rn")


def latest_version(valid: DataFrame, keys: Sequence[str] = ("symbol", "date")) -> DataFrame:
    """The newest version per key; rows without an ingestion time come last."""
    return _first(valid, keys, [c for c in VERSION_ORDER if c in valid.columns])


def last_per_date(
    daily: DataFrame, order: Sequence[str] = ("ingestion_ts", "volume", "close", "adj_close")
) -> DataFrame:
    """Keeps the row loaded last per symbol and date; without load times, and among equal ones, the largest values."""
    return _first(daily, ["symbol", "date"], [c for c in order if c in daily.columns])
