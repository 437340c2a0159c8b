"""Mergeable summaries of raw loads: watermarks and ingestion status without reading the raw log.

A summary row holds, for one load, symbol and block of days, the newest price date and ingestion time and a bitmap of the
days with prices. Rows of any loads merge by maximum and by bitwise or, so a day that several loads bring counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barlake.operators.ingest import FIRST_START, OVERLAP_DAYS
from barlake.session import work_root
from barlake.sources.tables import create_table

SUMMARY_DDL = (
    "source_symbol string, day_block bigint, days binary, last_price_date timestamp, last_ingestion_ts timestamp,"
    " load_id string"
)
def summarise(raw: DataFrame, load_id: str) -> DataFrame:
    """A row per symbol and block of days; rows without a date keep their symbol and load time in a block of their own."""
    number = F.date_diff(F.to_date("date"), F.lit("1970-01-01").cast("date")).alias("day")
    return raw.select("source_symbol", "date", "ingestion_ts", number).groupBy("source_symbol", F.bitmap_bucket_number("day").alias("day_block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("day")).alias("days"),
        F.max("date").cast("timestamp").alias("last_price_date"),
        F.max("ingestion_ts").alias("last_ingestion_ts"),
        F.lit(load_id).alias("load_id"),
    )


def append_summary(raw: DataFrame, load_id: str, table: str) -> None:
    """Stores the summary of a load, once per load id. The load is read here only, when it has just arrived."""
    spark = raw.sparkSession
    create_table(spark, table, SUMMARY_DDL, ["load_id"])
    spark.catalog.refreshTable(table)
    if spark.table(table).filter(F.col("load_id") == load_id).isEmpty():
        work_root(spark)
        summarise(raw, load_id).select(spark.table(table).columns).coalesce(1).write.insertInto(table)


def status(summaries: DataFrame, symbol: str | None = None) -> DataFrame:
    """Newest price date, newest load and number of distinct price days per symbol."""
    rows = summaries if symbol is None else summaries.filter(F.col("source_symbol") == symbol)
    blocks = rows.groupBy("source_symbol", "day_block").agg(
        F.bitmap_or_agg("days").alias("days"),
        F.max("last_price_date").alias("last_price_date"),
        F.max("last_ingestion_ts").alias("last_ingestion_ts"),
    )
    return blocks.groupBy("source_symbol").agg(
        F.max("last_price_date").alias("last_price_date"),
        F.max("last_ingestion_ts").alias("last_ingestion_ts"),
        F.sum(F.bitmap_count("days")).alias("unique_trading_days"),
    )


def start_from(
    requested: DataFrame, summaries: DataFrame, overlap_days: int = OVERLAP_DAYS, first_start: str = FIRST_START
) -> DataFrame:
    """One row per requested symbol with the first date to fetch, from its newest summarised date."""
    newest = F.date_sub(F.to_date(F.max("last_price_date")), overlap_days)
    marks = summaries.groupBy(F.col("source_symbol").alias("symbol")).agg(newest.alias("mark"))
    default = F.lit(first_start).cast("date")
    return requested.join(marks, "symbol", "left").select("symbol", F.coalesce("mark", default).alias("fetch_start"))


def stored(spark: SparkSession, table: str) -> DataFrame:
    spark.catalog.refreshTable(table)
    return spark.table(table)
