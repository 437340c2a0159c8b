"""Registered queries: serving reads, job runs, signals, ranking, series, lookup joins, the stream."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from barlake import schemas
from barlake.functions.times import freshness_text
from barlake.operators import ranking, runs, series, serving, signals
from barlake.plans import given
from barlake.plans.load_queries import _namespace
from barlake.plans.shape import report
from barlake.session import fresh_folder
from barlake.streaming.keyed_stream import keyed_upsert_stream
from barlake.streaming.upsert_stream import upsert_stream

NOW = dt.datetime(2024, 1, 31, 0, 0)
ANCHOR = "U1"
WEIGHTS = ranking.Weights(1.5, 0.25, 0.4)


def _state(spark: SparkSession, sf: str) -> DataFrame:
    return signals.symbol_state(
        given.served_latest(spark, sf), given.served_history(spark, sf), given.served_metrics(spark, sf)
    )


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return signals.scorecard(_state(spark, sf))


def _watchlists(spark: SparkSession, sf: str) -> DataFrame:
    return given.watchlists(spark, sf).select("owner", "selected", ranking.clean_watchlist(F.col("saved")).alias("watchlist"))


def _items(spark: SparkSession, sf: str) -> DataFrame:
    latest = serving.latest_forecast(given.served_latest(spark, sf))
    return ranking.lookup_latest(ranking.comparison_items(_watchlists(spark, sf)), latest)


def _universe(spark: SparkSession, sf: str) -> DataFrame:
    rows = ranking.anchor_for_all(serving.latest_forecast(given.served_latest(spark, sf)), ANCHOR)
    return ranking.with_signal(ranking.with_delta(ranking.with_risk(rows)), WEIGHTS)


# --- aggregates and serving reads ----------------------------------------------------------------


def f1_ingestion_status(spark: SparkSession, sf: str) -> DataFrame:
    return report(serving.ingestion_status(given.raw_supplier_prices(spark, sf)))


def f6_forecast_summary(spark: SparkSession, sf: str) -> DataFrame:
    return report(series.forecast_summary(serving.forecast_history(given.served_history(spark, sf))))


def f7_result_counts(spark: SparkSession, sf: str) -> DataFrame:
    return serving.listed(serving.forecast_history(given.served_history(spark, sf), 60), ["symbol"])


def h1_latest_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return report(serving.latest_forecast(given.served_latest(spark, sf)))


def h2_forecast_history(spark: SparkSession, sf: str) -> DataFrame:
    return report(serving.forecast_history(given.served_history(spark, sf)))


def h3_metrics_history(spark: SparkSession, sf: str) -> DataFrame:
    return report(serving.metrics_history(given.served_metrics(spark, sf)))


def h4_symbol_status(spark: SparkSession, sf: str) -> DataFrame:
    return report(serving.ingestion_status(given.raw_supplier_prices(spark, sf), "S7"))


# --- jobs and runs -------------------------------------------------------------------------------


def i1_job_search(spark: SparkSession, sf: str) -> DataFrame:
    return runs.search_jobs(given.jobs(spark, sf), "  BUILDING customer").select("job_id", F.col("settings.name").alias("name"))


def i1_job_list(spark: SparkSession, sf: str) -> DataFrame:
    return runs.search_jobs(given.jobs(spark, sf), " ").select("job_id", F.col("settings.name").alias("name"))


def i2_job_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return runs.job_by_id(given.jobs(spark, sf), 42).select("job_id", F.col("settings.name").alias("name"))


def i3_recent_runs(spark: SparkSession, sf: str) -> DataFrame:
    rows = runs.recent_runs(given.job_runs(spark, sf))
    return rows.select("job_id", "run_id", "trigger", "start_time_iso", "end_time_iso")


def i4_latest_run_state(spark: SparkSession, sf: str) -> DataFrame:
    return runs.latest_run_state(given.jobs(spark, sf), given.job_runs(spark, sf))


def i5_run_table(spark: SparkSession, sf: str) -> DataFrame:
    return runs.run_table(given.job_runs(spark, sf))


def i5_run_id_tail(spark: SparkSession, sf: str) -> DataFrame:
    rows = given.served_metrics(spark, sf)
    return rows.select("symbol", "pipeline_run_id", runs.id_tail(F.col("pipeline_run_id")).alias("run_id_tail"))


# --- signals -------------------------------------------------------------------------------------


def j1_trend(spark: SparkSession, sf: str) -> DataFrame:
    return report(signals.trend(signals.leading_rows(given.served_history(spark, sf))))


def j2_latest_close(spark: SparkSession, sf: str) -> DataFrame:
    return report(signals.latest_close(_state(spark, sf)))


def j3_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    return report(_scores(spark, sf))


def j4_decision(spark: SparkSession, sf: str) -> DataFrame:
    return signals.decision(_scores(spark, sf)).select("symbol", "score", "decision", "confidence")


def j5_alerts(spark: SparkSession, sf: str) -> DataFrame:
    states = runs.latest_run_state(given.jobs(spark, sf), given.job_runs(spark, sf))
    of_symbol = states.select(F.concat(F.lit("U"), F.col("job_id").cast("string")).alias("symbol"), "run_state")
    return signals.alerts(_scores(spark, sf), of_symbol)


# --- lookup, comparison, ranking -----------------------------------------------------------------


def d4_lookup_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = _items(spark, sf)
    return report(rows.select("owner", "position", "symbol", "has_row", "predicted_close", "model_name"))


def d5_anchor_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = ranking.anchor_for_all(serving.latest_forecast(given.served_latest(spark, sf)), ANCHOR)
    return report(rows.select("symbol", "predicted_close", "anchor_close"))


def d5_anchor_by_owner(spark: SparkSession, sf: str) -> DataFrame:
    rows = ranking.anchor_by_owner(_items(spark, sf))
    return report(rows.select("owner", "symbol", "predicted_close", "anchor_close"))


def j6_comparison_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.comparison_items(_watchlists(spark, sf))


def j7_watchlist(spark: SparkSession, sf: str) -> DataFrame:
    return _watchlists(spark, sf).select("owner", F.concat_ws(",", "watchlist").alias("watchlist"))


def j7_watchlist_toggle(spark: SparkSession, sf: str) -> DataFrame:
    toggled = ranking.toggle_symbol(F.col("watchlist"), F.col("selected"))
    return _watchlists(spark, sf).select("owner", F.concat_ws(",", toggled).alias("watchlist"))


def j8_risk_index(spark: SparkSession, sf: str) -> DataFrame:
    return report(ranking.with_risk(_items(spark, sf)).select("owner", "symbol", "close", "risk_index"))


def j9_delta(spark: SparkSession, sf: str) -> DataFrame:
    rows = ranking.with_delta(ranking.with_risk(ranking.anchor_by_owner(_items(spark, sf))))
    return report(rows.select("owner", "symbol", "delta", "delta_pct", "delta_tone"))


def j10_signal_score(spark: SparkSession, sf: str) -> DataFrame:
    return report(_universe(spark, sf).select("symbol", "delta_pct", "risk_index", "signal_score"))


def j11_ranking(spark: SparkSession, sf: str) -> DataFrame:
    rows = ranking.with_delta(ranking.with_risk(ranking.anchor_by_owner(_items(spark, sf))))
    ranks = ("signal_rank", "risk_rank", "price_rank", "symbol_rank")
    scored = ranking.with_signal(rows, WEIGHTS)
    stable = scored.withColumns({c: F.round(c, 9) for c in ("signal_score", "risk_index", "close")})
    return report(ranking.ranked(stable).select("owner", "symbol", *ranks))


# --- series --------------------------------------------------------------------------------------


def _cut(spark: SparkSession, sf: str, size: int = 30) -> DataFrame:
    return series.range_cut(serving.forecast_history(given.served_history(spark, sf)), size)


def _newest_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return serving.metrics_history(given.served_metrics(spark, sf))


def j12_range_cut(spark: SparkSession, sf: str) -> DataFrame:
    parts = [_cut(spark, sf, size).withColumn("size", F.lit(size)) for size in (*series.RANGES, 0)]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return report(rows.select("size", "symbol", "rn", "pred_close"))


def j13_trajectory(spark: SparkSession, sf: str) -> DataFrame:
    return report(series.trajectory(_cut(spark, sf)))


def j14_band_width(spark: SparkSession, sf: str) -> DataFrame:
    return report(series.band_width(_cut(spark, sf)))


def j15_model_error(spark: SparkSession, sf: str) -> DataFrame:
    return report(series.model_error(_newest_metrics(spark, sf)))


def j16_insights(spark: SparkSession, sf: str) -> DataFrame:
    cut = _cut(spark, sf)
    errors = series.model_error(_newest_metrics(spark, sf))
    symbols = given.served_history(spark, sf).select("symbol").distinct()
    return report(series.insights(symbols, series.trajectory(cut), series.band_width(cut), errors))


def j17_freshness(spark: SparkSession, sf: str) -> DataFrame:
    symbols = given.served_history(spark, sf).select("symbol").distinct()
    updated = given.served_latest(spark, sf).groupBy("symbol").agg(F.max("exposed_ts").alias("updated"))
    rows = symbols.join(updated, "symbol", "left")
    return rows.select("symbol", freshness_text(F.col("updated"), F.lit(NOW)).alias("freshness"))


def j17_freshness_minutes(spark: SparkSession, sf: str) -> DataFrame:
    """Every event seen from the end of its own hour: the short buckets."""
    rows = given.served_history(spark, sf)
    hour_end = F.date_trunc("hour", "forecast_date") + F.expr("INTERVAL 61 MINUTES")
    return rows.select("symbol", "forecast_date", freshness_text(F.col("forecast_date"), hour_end).alias("freshness")).groupBy(
        "symbol", "freshness"
    ).agg(F.count(F.lit(1)).alias("row_count"))


# --- stream --------------------------------------------------------------------------------------


def _raw_files(spark: SparkSession, raw: DataFrame) -> str:
    """The log as a folder of raw files of each run.

    The few runs of a task are written side by side instead of being sorted, and row groups are small, so that the tasks
    of a batch share a large file.
    """
    folder = fresh_folder(spark, "raw")
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, "16")
    try:
        rows = raw.hint("rebalance", "ingestion_run_id").write.partitionBy("ingestion_run_id")
        rows.option("parquet.block.size", 4 << 20).parquet(folder)
    finally:
        spark.conf.set(key, before)
    return folder


def l1_upsert_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The log as a folder of raw files of each run, streamed file by file: versions of a key come in several batches."""
    raw = given.raw_prices(spark, sf)
    folder = _raw_files(spark, raw)
    names = _namespace(spark)
    clean, rejects = f"{names}.clean_prices", f"{names}.rejects"
    upsert_stream(spark, folder, raw.schema, clean, rejects, fresh_folder(spark, "stream"), 1).awaitTermination()
    return report(spark.table(clean).select(schemas.CLEAN.names))


def l1_keyed_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same stream with the newest version of each key as state; rows later than the overlap are settled in the table."""
    raw = given.raw_prices(spark, sf)
    folder = _raw_files(spark, raw)
    names = _namespace(spark)
    clean, rejects = f"{names}.clean_prices", f"{names}.rejects"
    checkpoint = fresh_folder(spark, "stream")
    keyed_upsert_stream(spark, folder, raw.schema, clean, rejects, checkpoint, files_per_batch=1).awaitTermination()
    return report(spark.table(clean).select(schemas.CLEAN.names))


def l1_stream_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """The rejects the same stream has stored, counted by day and issue."""
    raw = given.raw_prices(spark, sf)
    folder = _raw_files(spark, raw)
    names = _namespace(spark)
    clean, rejects = f"{names}.clean_prices", f"{names}.rejects"
    upsert_stream(spark, folder, raw.schema, clean, rejects, fresh_folder(spark, "stream"), 1, buckets=2).awaitTermination()
    counted = spark.table(rejects).groupBy("ingestion_date", "quality_issue").agg(F.count("*").alias("reject_rows"))
    return report(counted)
