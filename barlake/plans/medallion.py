"""Raw log to clean bars, daily series, feature matrix."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Observation, functions as F

from barlake import schemas
from barlake.operators import conform as C, dedup, features, quality
from barlake.operators.upsert import upsert_table
from barlake.session import fresh_folder
from barlake.sources.tables import append_rejects


def labelled(raw: DataFrame) -> DataFrame:
    return quality.label_quality(C.conform(raw))


def clean(raw: DataFrame) -> DataFrame:
    """Newest valid version per symbol and date."""
    return dedup.latest_version(quality.valid_rows(labelled(raw)))


def daily(clean_rows: DataFrame) -> DataFrame:
    """The modelling view of the clean table."""
    return clean_rows.select("symbol", "date", "close", "adj_close", "volume")


def daily_from_raw(raw: DataFrame) -> DataFrame:
    return daily(clean(raw))


def matrix_from_raw(raw: DataFrame) -> DataFrame:
    return features.feature_matrix(daily_from_raw(raw))


def refresh_clean(
    raw: DataFrame, clean_table: str, reject_table: str, since: dt.date | str | None = None, buckets: int | None = None
) -> DataFrame:
    """One load: upsert the valid rows, append the new rejects, return the counts.

    ``since`` takes only raw rows ingested from that date on (whole folders of the log are skipped);
    as the upsert is idempotent this ends where a load of everything would.
    """
    spark = raw.sparkSession
    fresh = raw if since is None else raw.filter(F.col("ingestion_date") >= F.lit(str(since)).cast("date"))
    # The raw rows are read once: counted on their way into two folders, valid and rejected.
    seen = Observation()
    staged = f"{fresh_folder(spark, 'load')}/rows"
    rows = labelled(fresh).observe(seen, *quality.counts())
    rows.write.partitionBy("is_valid").parquet(staged)
    stored = spark.read.schema(schemas.REJECTS).parquet(staged)
    upsert_table(quality.valid_rows(stored), clean_table, buckets)
    append_rejects(quality.rejected_rows(stored), reject_table)
    return spark.createDataFrame([tuple(seen.get[n] for n in quality.COUNTS)], ", ".join(f"{n} bigint" for n in quality.COUNTS))
