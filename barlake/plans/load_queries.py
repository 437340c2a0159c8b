"""Registered queries: sources, sinks, conform, quality, dedup, upsert, features."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from barlake import schemas
from barlake.functions.text import lenient_symbol
from barlake.operators import calendar, conform as C, dedup, features, increments, ingest, quality, serving, summaries
from barlake.operators import upsert
from barlake.plans import forecasting, given, medallion
from barlake.plans.shape import report
from barlake.session import fresh_folder
from barlake.sources import prices, snapshots, tables

STAMP = dt.datetime(2024, 1, 31, 18, 30)
BAR = ("source_symbol", "date", "open", "high", "low", "close", "adj_close", "volume")


def _namespace(spark: SparkSession) -> str:
    """A schema of its own for the tables a query writes, in the shared work folder."""
    name = f"barlake_{uuid.uuid4().hex[:12]}"
    tables.create_namespace(spark, name, fresh_folder(spark, "tables"))
    return name


# --- sources, sinks, catalog ---------------------------------------------------------------------


def a1_price_source(spark: SparkSession, sf: str) -> DataFrame:
    bars = prices.bars_since(given.raw_prices(spark, sf), ["AF", "NO", "RF"], "1998-01-01")
    return report(bars.select(*BAR, "ingestion_ts"))


def a2_plain_headers(spark: SparkSession, sf: str) -> DataFrame:
    odd = given.raw_text_prices(spark, sf).withColumnsRenamed({"Open": " Open ", "Volume": "VOLUME "})
    plain = prices.plain_headers(odd)
    numbers = [F.col(c).try_cast("double").alias(c) for c in BAR[2:]]
    return report(plain.select("source_symbol", "date", *numbers))


def a3_lineage_stamp(spark: SparkSession, sf: str) -> DataFrame:
    bars = given.raw_prices(spark, sf).select(*BAR)
    return report(ingest.stamp_lineage(bars, "files", "1d", "run-42", STAMP))


def a4_append_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Three runs on three days appended one after the other, read back per ingestion date."""
    table = f"{_namespace(spark)}.raw_prices"
    raw = given.raw_prices(spark, sf)
    for run in range(3):
        bars = raw.filter(F.col("ingestion_run_id") == f"run-{run}").select(*BAR)
        tables.append_raw(ingest.stamp_lineage(bars, "files", "1d", f"load-{run}", STAMP + dt.timedelta(run)), table)
    stored = prices.named_table(spark, table)
    return report(
        stored.groupBy("ingestion_date", "ingestion_run_id").agg(
            F.count(F.lit(1)).alias("row_count"), F.max("high").alias("top_high")
        )
    )


def a5_incremental_start(spark: SparkSession, sf: str) -> DataFrame:
    raw = given.raw_supplier_prices(spark, sf)
    known = given.table(spark, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"))
    requested = known.union(ingest.requested_symbols(spark, ["NVDA", "MSFT"]))
    return report(ingest.incremental_start(requested, raw))


def a5_incremental_start_whole_table(spark: SparkSession, sf: str) -> DataFrame:
    raw = given.raw_supplier_prices(spark, sf)
    requested = ingest.requested_symbols(spark, ["S1", "NVDA"])
    return report(ingest.incremental_start(requested, raw, whole_table=True))


def a6_fixed_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed layout created (twice, the second time without effect), filled and read back."""
    table = f"{_namespace(spark)}.clean_prices"
    buckets = [tables.create_clean_table(spark, table) for _ in range(2)]
    rows = tables.with_folders(medallion.clean(given.raw_prices(spark, sf)), buckets[0])
    snapshots.commit(spark, table, snapshots.current(spark, table), rows.hint("rebalance", tables.BUCKET, tables.PERIOD), rows)
    return report(
        spark.table(table).groupBy("symbol").agg(F.count(F.lit(1)).alias("row_count"), F.max("date").alias("last_date"))
    )


def a7_clustered_write(spark: SparkSession, sf: str) -> DataFrame:
    table = f"{_namespace(spark)}.clustered_rejects"
    rows = quality.rejected_rows(medallion.labelled(given.raw_prices(spark, sf)))
    tables.clustered(rows, "quality_issue", "ingestion_date").write.format("parquet").saveAsTable(table)
    return report(
        spark.table(table).groupBy("quality_issue").agg(
            F.count(F.lit(1)).alias("row_count"),
            F.min("ingestion_date").alias("first_date"),
            F.max("ingestion_date").alias("last_date"),
        )
    )


def a7_space_filling(spark: SparkSession, sf: str) -> DataFrame:
    """Rejects along a curve through issue and load date, read back."""
    table = f"{_namespace(spark)}.curved_rejects"
    rows = quality.rejected_rows(medallion.labelled(given.raw_prices(spark, sf)))
    tables.space_filled(rows, ["quality_issue", "ingestion_date"], 16).write.format("parquet").saveAsTable(table)
    return report(
        spark.table(table).groupBy("ingestion_date", "quality_issue").agg(F.count(F.lit(1)).alias("row_count"))
    )


def a8_reject_append(spark: SparkSession, sf: str) -> DataFrame:
    """The same rejects appended twice; the second run adds nothing."""
    table = f"{_namespace(spark)}.rejects"
    rows = quality.rejected_rows(medallion.labelled(given.raw_prices(spark, sf)))
    tables.append_rejects(rows, table)
    tables.append_rejects(rows, table)
    return report(spark.table(table).select("symbol", "date", "ingestion_ts", "ingestion_run_id", "quality_issue"))


def a8_reject_append_parts(spark: SparkSession, sf: str) -> DataFrame:
    """The rejects of a log that comes in several loads: the same as in one."""
    table = f"{_namespace(spark)}.rejects"
    rows = quality.rejected_rows(medallion.labelled(given.raw_prices(spark, sf)))
    first = F.col("ingestion_run_id") == "run-0"
    for part in (rows.where(first), rows.where(~first), rows):
        tables.append_rejects(part, table)
    return report(spark.table(table).groupBy("quality_issue").agg(F.count("*").alias("reject_rows")))


def _summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Summaries of three loads of the log; the first one is announced twice."""
    table = f"{_namespace(spark)}.load_summaries"
    raw = given.raw_supplier_prices(spark, sf)
    for run in (0, 1, 2, 0):
        part = raw.filter(F.col("ingestion_run_id") == f"run-{run}")
        summaries.append_summary(part, f"load-{run}", table)
    return summaries.stored(spark, table)


def a5_start_from_summaries(spark: SparkSession, sf: str) -> DataFrame:
    known = given.table(spark, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"))
    requested = known.union(ingest.requested_symbols(spark, ["NVDA", "MSFT"]))
    return report(summaries.start_from(requested, _summaries(spark, sf)))


def f1_status_from_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return report(summaries.status(_summaries(spark, sf)))


def h4_status_from_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return report(summaries.status(_summaries(spark, sf), "S7"))


def a9_snapshot_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    """A snapshot replaced by one with another layout."""
    table = f"{_namespace(spark)}.snapshot"
    rows = medallion.clean(given.raw_prices(spark, sf))
    tables.overwrite_snapshot(rows.groupBy("symbol").agg(F.max("date").alias("last_date")), table)
    tables.overwrite_snapshot(medallion.daily(rows), table)
    return report(spark.table(table))


def a10_named_view(spark: SparkSession, sf: str) -> DataFrame:
    view = f"clean_prices_{uuid.uuid4().hex[:8]}"
    prices.publish_view(medallion.clean(given.raw_prices(spark, sf)), view)
    counted = spark.sql(
        f"SELECT symbol, year(date) AS year, count(*) AS bar_count, max(high) AS top_high FROM {view} GROUP BY ALL"
    )
    return report(counted)


def a11_newest_raw(spark: SparkSession, sf: str) -> DataFrame:
    raw = given.raw_prices(spark, sf)
    order = [F.col(c).desc_nulls_last() for c in ("ingestion_ts", "source_symbol", "open", "high", "low", "volume")]
    return report(tables.newest(raw, 20, *order).select("source_symbol", "ingestion_ts", "open", "high"))


def a11_newest_clean(spark: SparkSession, sf: str) -> DataFrame:
    rows = medallion.clean(given.raw_prices(spark, sf))
    return report(tables.newest(rows, 20, F.desc("date"), F.asc("symbol")).select("symbol", "date", "close", "volume"))


def a12_load_counts(spark: SparkSession, sf: str) -> DataFrame:
    return quality.load_counts(medallion.labelled(given.raw_prices(spark, sf)))


def a12_one_pass_load(spark: SparkSession, sf: str) -> DataFrame:
    """The counts of a whole load, taken on the way to its one write."""
    names = [f"{_namespace(spark)}.{t}" for t in ("clean_prices", "rejects")]
    return medallion.refresh_clean(given.raw_prices(spark, sf), *names)


# --- projection, conform, predicates -------------------------------------------------------------


def b1_column_pick(spark: SparkSession, sf: str) -> DataFrame:
    raw = given.raw_text_prices(spark, sf)
    return report(
        raw.select(
            "source_symbol",
            C.present(raw, ["Date", "date"]).alias("picked_date"),
            C.present(raw, ["Adj Close", "adj_close", "adj close"]).try_cast("double").alias("picked_adj_close"),
            C.present(raw, ["dividend", "Dividend"]).alias("picked_dividend"),
        )
    )


def b2_conform(spark: SparkSession, sf: str) -> DataFrame:
    return report(C.conform(given.raw_text_prices(spark, sf)))


def b2_conform_plain_headers(spark: SparkSession, sf: str) -> DataFrame:
    return report(C.conform(given.raw_prices(spark, sf)))


def b3_to_date(spark: SparkSession, sf: str) -> DataFrame:
    raw = given.raw_prices(spark, sf).withColumn("price_date", F.to_date("date"))
    return report(raw.groupBy("price_date").agg(F.count(F.lit(1)).alias("row_count")))


def b4_of_symbol(spark: SparkSession, sf: str) -> DataFrame:
    rows = medallion.clean(given.raw_prices(spark, sf))
    return report(C.of_symbol(rows, "RF", "symbol", "date", "close", "adj_close", "volume"))


def b5_check_symbols(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    typed = (
        F.when(key % 4 == 0, F.concat(F.lit(" \t"), F.lower("o_orderpriority"), F.lit("\n")))
        .when(key % 4 == 1, F.concat(F.lit("u"), F.col("o_custkey").cast("string"), F.lit(" ")))
        .when(key % 4 == 2, F.concat(F.lit("brk.b_"), key.cast("string")))
        .otherwise(F.concat(F.lit("a b"), F.col("o_orderstatus")))
    )
    orders = given.table(spark, sf, "orders").select("o_orderkey", typed.alias("typed"))
    return C.check_symbols(orders, "typed").select("o_orderkey", "symbol", "is_valid")


def b6_lenient_symbols(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = lenient_symbol(F.concat(F.lit(" "), F.col("p_brand"), F.lit("~"), F.col("p_name")))
    name_only = lenient_symbol(F.when(F.col("p_size") > 25, F.lit("#! ")).otherwise(F.col("p_name")))
    parts = given.table(spark, sf, "part").select("p_partkey", cleaned.alias("symbol"), name_only.alias("short"))
    return parts.filter("short <> ''")


def b7_adjusted_prices(spark: SparkSession, sf: str) -> DataFrame:
    return report(features.with_adjusted(medallion.daily_from_raw(given.raw_prices(spark, sf))))


def b7_adjusted_report(spark: SparkSession, sf: str) -> DataFrame:
    return features.adjusted_report(medallion.daily_from_raw(given.raw_prices(spark, sf)))


def b8_bounded_limit(spark: SparkSession, sf: str) -> DataFrame:
    rows = medallion.daily_from_raw(given.raw_supplier_prices(spark, sf))
    return report(serving.top_per(rows, ["symbol"], [F.desc("date")], 100, serving.RUNS_LIMIT).select("symbol", "date", "close"))


# --- data quality --------------------------------------------------------------------------------


def c1_quality_label(spark: SparkSession, sf: str) -> DataFrame:
    rows = medallion.labelled(given.raw_prices(spark, sf))
    return report(rows.select("symbol", "date", "ingestion_ts", "high", "low", "volume", "quality_issue", "is_valid"))


def c2_valid_rows(spark: SparkSession, sf: str) -> DataFrame:
    return report(quality.valid_rows(medallion.labelled(given.raw_prices(spark, sf))))


def c2_rejected_rows(spark: SparkSession, sf: str) -> DataFrame:
    return report(quality.rejected_rows(medallion.labelled(given.raw_prices(spark, sf))))


def c3_series_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Over unlabelled rows, so that every check has something to find."""
    rows = C.conform(given.raw_supplier_prices(spark, sf))
    return quality.series_violations(features.with_adjusted(rows))


def c3_excluded_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Why a symbol is left out of the forecast, over rows that no quality rule has filtered."""
    rows = C.conform(given.raw_supplier_prices(spark, sf)).filter("symbol IS NOT NULL AND date IS NOT NULL")
    return forecasting.excluded_series(medallion.daily(dedup.latest_version(rows)))


def c4_history_check(spark: SparkSession, sf: str) -> DataFrame:
    return features.history_check(medallion.matrix_from_raw(given.raw_supplier_prices(spark, sf)))


def c6_reject_summary(spark: SparkSession, sf: str) -> DataFrame:
    return report(quality.reject_summary(quality.rejected_rows(medallion.labelled(given.raw_prices(spark, sf)))))


# --- dedup, upsert -------------------------------------------------------------------------------


def d1_latest_version(spark: SparkSession, sf: str) -> DataFrame:
    return report(medallion.clean(given.raw_prices(spark, sf)))


def d2_last_per_date(spark: SparkSession, sf: str) -> DataFrame:
    rows = quality.valid_rows(medallion.labelled(given.raw_prices(spark, sf)))
    return report(dedup.last_per_date(medallion.daily(rows)))


def _two_loads(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Earlier runs as the stored side, the last run as the new side."""
    rows = quality.valid_rows(medallion.labelled(given.raw_prices(spark, sf)))
    last = F.col("ingestion_run_id") == "run-2"
    return dedup.latest_version(rows.filter(~last)), dedup.latest_version(rows.filter(last))


def d2_last_loaded(spark: SparkSession, sf: str) -> DataFrame:
    """The same with load times."""
    rows = quality.valid_rows(medallion.labelled(given.raw_prices(spark, sf)))
    return report(medallion.daily(dedup.last_per_date(rows)))


def d3_conditional_upsert(spark: SparkSession, sf: str) -> DataFrame:
    stored, fresh = _two_loads(spark, sf)
    return report(upsert.merge_newer(stored, fresh))


def d3_upsert_table(spark: SparkSession, sf: str) -> DataFrame:
    """The same through a stored table, one rewrite per load."""
    table = f"{_namespace(spark)}.clean_prices"
    stored, fresh = _two_loads(spark, sf)
    upsert.upsert_table(stored, table)
    upsert.upsert_table(fresh, table)
    return report(spark.table(table).select(schemas.CLEAN.names))


def d6_without_holidays(spark: SparkSession, sf: str) -> DataFrame:
    """Bars that lie on exchange days."""
    days = medallion.daily_from_raw(given.raw_prices(spark, sf)).select("symbol", "date")
    return report(calendar.without_holidays(days, calendar.holidays_around(days, "date")).groupBy("symbol", "date").count().drop("count"))


# --- features ------------------------------------------------------------------------------------


def _with(spark: SparkSession, sf: str, made: dict, digits: int | None = 6) -> DataFrame:
    rows = features.with_adjusted(medallion.daily_from_raw(given.raw_prices(spark, sf)))
    return report(rows.select("symbol", "date", *[c.alias(n) for n, c in made.items()]), digits)


def e1_target(spark: SparkSession, sf: str) -> DataFrame:
    return _with(spark, sf, {"target": features.target()})


def e2_lags(spark: SparkSession, sf: str) -> DataFrame:
    return _with(spark, sf, features.lags())


def e3_returns(spark: SparkSession, sf: str) -> DataFrame:
    return _with(spark, sf, features.returns(), None)


def e4_roll_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _with(spark, sf, features.rolling_means())


def e5_roll_std(spark: SparkSession, sf: str) -> DataFrame:
    return _with(spark, sf, features.rolling_stds(), 4)


def e6_calendar_parts(spark: SparkSession, sf: str) -> DataFrame:
    return _with(spark, sf, features.calendar_parts())


def e7_log_volume(spark: SparkSession, sf: str) -> DataFrame:
    return _with(spark, sf, features.log_volume())


def _matrix_report(rows: DataFrame) -> DataFrame:
    # A return is one division and one subtraction: equal to the last bit, while rounding has ties.
    stds = {name: 4 for name in features.FEATURES if name.startswith("roll_std")}
    return report(rows, 6, ret_1=None, ret_5=None, **stds)


def e8_feature_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _matrix_report(medallion.matrix_from_raw(given.raw_prices(spark, sf)))


def e8_incremental_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """The matrix of a log that comes in three loads, each with a week of overlap; closed rows are appended."""
    table = f"{_namespace(spark)}.features"
    bars = medallion.daily_from_raw(given.raw_prices(spark, sf)).checkpoint()
    state = spark.createDataFrame([], increments.STATE_DDL)
    for since, until in (("1900-01-01", "1996-06-30"), ("1996-06-24", "1999-03-31"), ("1999-03-25", "2100-01-01")):
        done = increments.step(state, bars.filter(F.col("date").between(F.lit(since), F.lit(until))))
        state = done.state.checkpoint()
        done.closed.write.mode("append").format("parquet").saveAsTable(table)
    return _matrix_report(spark.table(table).unionByName(increments.open_rows(state)))


def e8_feature_matrix_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return _matrix_report(medallion.matrix_from_raw(given.raw_supplier_prices(spark, sf)))


def e9_training_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _matrix_report(features.training_rows(medallion.matrix_from_raw(given.raw_prices(spark, sf))))


def e10_scoring_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _matrix_report(features.scoring_rows(medallion.matrix_from_raw(given.raw_prices(spark, sf))))
