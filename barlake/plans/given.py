"""Price logs, job records and serving tables derived from the given tables.

No price table is given, so every row of ``lineitem`` stands for one raw version of a daily bar.
Defects (missing and NaN prices, swapped high and low, negative volume, missing times) follow from
the order key, so that the SQL checks can spell them the same way. All rows are used.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SYSTEM = "tpch_lineitem"
SPLIT_DATE = "1998-07-01"
NAN = float("nan")
PUBLISHED = dt.datetime(2024, 2, 1, 6, 0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _every(n: int) -> Column:
    return F.col("l_orderkey") % n == 0


def _log(spark: SparkSession, sf_dir: str, symbol: Column) -> DataFrame:
    price = F.col("l_extendedprice")
    shipped = F.col("l_shipdate").cast("timestamp")
    high = price * (F.lit(1.1) + F.col("l_tax"))
    low = price * (F.lit(0.9) - F.col("l_discount"))
    adjusted = F.when(shipped < F.lit(SPLIT_DATE).cast("timestamp"), price * 0.5).otherwise(price)
    minutes = F.col("l_linenumber") * 60 + F.col("l_orderkey") % 60
    return table(spark, sf_dir, "lineitem").select(
        F.when(~_every(211), symbol).alias("source_symbol"),
        F.when(~_every(199), shipped).alias("date"),
        F.when(~_every(97), price * (F.lit(1.0) - F.col("l_discount"))).alias("open"),
        F.when(_every(101), low).otherwise(high).alias("high"),
        F.when(_every(101), high).otherwise(low).alias("low"),
        F.when(_every(113), F.lit(NAN)).otherwise(price).alias("close"),
        F.when(~(_every(7) | ((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F"))), adjusted).alias(
            "adj_close"
        ),
        F.when(_every(107), F.lit(NAN))
        .when(_every(103), -F.col("l_quantity"))
        .otherwise(F.col("l_quantity"))
        .alias("volume"),
        F.lit(SYSTEM).alias("source_system"),
        F.lit("1d").alias("source_interval"),
        F.concat(F.lit("run-"), (F.col("l_orderkey") % 3).cast("string")).alias("ingestion_run_id"),
        F.when(~_every(223), F.timestamp_seconds(F.unix_timestamp(shipped) + minutes * 60)).alias("ingestion_ts"),
        F.to_date(shipped).alias("ingestion_date"),
    )


def raw_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol = return flag and line status (6 symbols, each with a large share of the log)."""
    return _log(spark, sf_dir, F.concat("l_returnflag", "l_linestatus"))


def raw_supplier_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol = supplier, small lots apart; the number of symbols grows with the data."""
    lot = F.when(F.col("l_quantity") < 10, F.lit(".ODD")).otherwise(F.lit(""))
    return _log(spark, sf_dir, F.concat(F.lit("S"), F.col("l_suppkey").cast("string"), lot))


def raw_text_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log with download-style headers and text values, some of them not numbers."""
    raw = raw_prices(spark, sf_dir)

    def text(name: str) -> Column:
        return F.coalesce(F.nanvl(F.col(name), F.lit(None).cast("double")).cast("string"), F.lit("n/a"))

    return raw.select(
        "source_symbol",
        F.col("date").alias("Date"),
        text("open").alias("Open"),
        text("high").alias("High"),
        text("low").alias("Low"),
        text("close").alias("Close"),
        F.col("adj_close").cast("string").alias("Adj Close"),
        text("volume").alias("Volume"),
        "source_system",
        "source_interval",
        "ingestion_ts",
        "ingestion_date",
        "ingestion_run_id",
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as jobs; every 10th has no name."""
    named = F.when(F.col("c_custkey") % 10 != 0, F.concat_ws(" ", "c_mktsegment", "c_name"))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("job_id"), F.struct(named.alias("name")).alias("settings")
    )


def job_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs; two customers share a job, so every second job has no run."""
    key = F.col("o_orderkey")
    start = F.unix_millis(F.col("o_orderdate").cast("timestamp")) + (key % 7) * 250
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") - F.col("o_custkey") % 2).alias("job_id"),
        key.alias("run_id"),
        F.when(key % 53 == 0, F.lit(0)).when(key % 59 != 0, start).cast("bigint").alias("start_time"),
        F.when(F.col("o_orderstatus") != "P", start + 3_600_000).cast("bigint").alias("end_time"),
        F.col("o_orderpriority").alias("trigger"),
        F.when(
            key % 61 != 0,
            F.struct(
                F.when(F.col("o_orderstatus") == "P", F.lit("RUNNING"))
                .when(F.col("o_orderpriority") != "5-LOW", F.lit("TERMINATED"))
                .alias("life_cycle_state"),
                F.when(F.col("o_orderstatus") == "F", F.lit("SUCCESS"))
                .when(F.col("o_orderstatus") == "O", F.lit("FAILED"))
                .alias("result_state"),
            ),
        ).alias("state"),
    )


def _events(spark: SparkSession, sf_dir: str, apart: str = "U") -> DataFrame:
    """All events by symbol; ``apart`` leads the symbols of every 41st user, so that they miss in other tables."""
    lead = F.when(F.col("user_id") % 41 == 0, F.lit(apart)).otherwise(F.lit("U"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id"),
        F.concat(lead, F.col("user_id").cast("string")).alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_type",
        "value",
    )


def served_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as published forecast rows: symbol = user, run = day, horizon = hour + 1."""
    key = F.col("event_id")
    return _events(spark, sf_dir).select(
        "symbol",
        F.col("ts").alias("forecast_date"),
        (F.hour("ts") + 1).cast("bigint").alias("horizon_day"),
        F.when(key % 17 != 0, F.col("value")).alias("pred_close"),
        (F.col("value") - F.col("value") * (key % 5) * 0.004).alias("pred_low_80"),
        (F.col("value") + F.col("value") * (key % 7) * 0.002).alias("pred_high_80"),
        F.col("event_type").alias("model_name"),
        ((key % 11) * 0.15).alias("cv_mae"),
        F.date_trunc("day", "ts").alias("forecast_ts"),
    )


def served_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an exposed next-day row (many versions per symbol)."""
    key = F.col("event_id")
    value = F.col("value")
    return _events(spark, sf_dir, "L").select(
        "symbol",
        F.to_date("ts").alias("next_trading_day"),
        F.when(key % 19 != 0, value).alias("predicted_close"),
        F.when(key % 23 != 0, value - value * (key % 5) * 0.004).alias("predicted_low_80"),
        F.when(key % 23 != 0, value + value * (key % 7) * 0.002).alias("predicted_high_80"),
        F.col("event_type").alias("model_name"),
        F.when(key % 13 != 0, (key % 11) * 0.15).alias("cv_mae"),
        F.col("ts").alias("exposed_ts"),
    )


def served_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a published metrics row."""
    key = F.col("event_id")
    return _events(spark, sf_dir, "M").select(
        "symbol",
        F.when(key % 29 != 0, F.col("event_type")).alias("selected_model"),
        F.when(key % 31 != 0, (key % 11) * 0.15).alias("best_cv_mae"),
        ((key % 13) * 0.6).alias("pred_std"),
        (key % 1000).alias("train_rows"),
        F.concat(F.lit("run-"), (key + 1_000_000_000).cast("string")).alias("pipeline_run_id"),
        F.col("ts").alias("loaded_ts"),
    )


def watchlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One saved list per order: owner, selected symbol and the raw saved texts."""
    key = F.col("o_orderkey")
    many = F.transform(F.sequence(F.lit(1), F.lit(14)), lambda i: F.concat(F.lit("u"), ((key + i * 7) % 120).cast("string")))
    some = F.array(
        F.concat(F.lit(" u"), (F.col("o_custkey") % 100).cast("string")),
        F.lower("o_orderpriority"),
        F.lit("##"),
        F.concat(F.lit("U"), (key % 100).cast("string")),
        F.lit(None).cast("string"),
    )
    return table(spark, sf_dir, "orders").select(
        key.alias("owner"),
        F.concat(F.lit("U"), (F.col("o_custkey") % 150).cast("string")).alias("selected"),
        F.when(F.col("o_orderstatus") == "P", many)
        .when(F.col("o_orderstatus") == "O", some)
        .otherwise(F.array(F.lit("!!")))
        .alias("saved"),
    )
