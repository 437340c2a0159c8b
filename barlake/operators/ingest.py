"""Lineage stamp and the incremental start."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

# Fixed values.
OVERLAP_DAYS = 7
FIRST_START = "1999-01-01"


def stamp_lineage(
    bars: DataFrame,
    system: str,
    interval: str,
    run_id: str | None = None,
    ingestion_ts: dt.datetime | None = None,
    symbol: str | None = None,
) -> DataFrame:
    """Adds where and when the rows came from.

    The run id is one literal per call, so all rows of a run (and a retried task) share it.
    """
    stamped = bars.withColumns(
        {
            "source_system": F.lit(system),
            "source_interval": F.lit(interval),
            "ingestion_run_id": F.lit(run_id or str(uuid.uuid4())),
            "ingestion_ts": F.lit(ingestion_ts) if ingestion_ts else F.current_timestamp(),
        }
    ).withColumn("ingestion_date", F.to_date("ingestion_ts"))
    return stamped.withColumn("source_symbol", F.lit(symbol)) if symbol else stamped


def raw_or_none(spark: SparkSession, table: str) -> DataFrame | None:
    return spark.table(table) if spark.catalog.tableExists(table) else None


def incremental_start(
    requested: DataFrame,
    raw: DataFrame | None,
    overlap_days: int = OVERLAP_DAYS,
    first_start: str = FIRST_START,
    whole_table: bool = False,
) -> DataFrame:
    """One row per requested symbol with the first date to fetch.

    Each symbol has its own watermark, so a newly requested one gets its whole history;
    ``whole_table`` uses the newest date of the whole table for all of them instead.
    """
    default = F.lit(first_start).cast("date")
    if raw is None:
        return requested.select("symbol", default.alias("fetch_start"))
    newest = F.date_sub(F.to_date(F.max("date")), overlap_days)
    if whole_table:
        mark = raw.agg(newest.alias("mark")).scalar()
        return requested.select("symbol", F.coalesce(mark, default).alias("fetch_start"))
    marks = raw.groupBy(F.col("source_symbol").alias("symbol")).agg(newest.alias("mark"))
    return requested.join(marks, "symbol", "left").select(
        "symbol", F.coalesce("mark", default).alias("fetch_start")
    )


def requested_symbols(spark: SparkSession, symbols: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(s,) for s in symbols], "symbol string")
