"""What the physical plans look like, and that one hot symbol does no harm."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from barlake.operators import features, ranking, serving, signals
from barlake.plans import forecasting, given, medallion
from barlake.sources import prices

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df) -> int:
    return plan(df).count("Exchange hashpartitioning")


@pytest.fixture(scope="module")
def raw(spark):
    return given.raw_prices(spark, SF)


def test_dedup_prunes_before_its_one_shuffle(raw):
    text = plan(medallion.clean(raw))
    assert text.count("Exchange ") == 1
    after, before = text.split("Exchange ", 1)
    assert "Final" in after and "WindowGroupLimit" in before and "Partial" in before


def test_matrix_adds_one_shuffle(raw):
    daily = medallion.daily_from_raw(raw)
    assert shuffles(features.feature_matrix(daily)) == shuffles(daily) + 1


def test_folds_fits_and_scores_add_none(raw):
    """Both branches (rows and fits) share the same feature shuffle, which AQE reuses."""
    daily = medallion.daily_from_raw(raw)
    run = forecasting.CheckRun(daily)
    per_branch = shuffles(features.feature_matrix(daily))
    assert shuffles(run.segmented) == per_branch
    assert shuffles(run.fits) == per_branch
    assert shuffles(run.oof) == shuffles(run.scored) == shuffles(run.chosen) == 2 * per_branch


def test_same_shuffles_are_reused_at_run_time(raw):
    oof = forecasting.CheckRun(medallion.daily_from_raw(raw)).oof
    oof.collect()
    assert "ReusedExchange" in plan(oof)


def test_scan_reads_only_what_the_query_needs(spark):
    text = plan(medallion.daily_from_raw(given.raw_prices(spark, SF)).groupBy("symbol").count())
    schema = text.split("ReadSchema: ")[1].split(">")[0]
    assert "l_partkey" not in schema and "l_suppkey" not in schema


def test_top_lists_are_cut_before_the_shuffle(spark):
    for df in (
        serving.forecast_history(given.served_history(spark, SF)),
        serving.latest_forecast(given.served_latest(spark, SF)),
        signals.leading_rows(given.served_history(spark, SF)),
    ):
        after, before = plan(df).split("Exchange ", 1)
        assert "WindowGroupLimit" in before


def test_latest_preview_is_a_top_k(raw):
    from barlake.sources import tables

    assert "TakeOrderedAndProject" in plan(tables.newest(raw, 20, F.desc("ingestion_ts")))


def test_no_cross_joins_anywhere(spark):
    import __spark_entry__ as entry

    for name in ("j10_signal_score", "j11_ranking", "j16_insights", "j3_scorecard", "g11_sessions", "d3_conditional_upsert", "j5_alerts"):
        text = plan(entry.queries()[name](spark, SF))
        assert "Cartesian" not in text and "NestedLoop" not in text, name


def test_ranking_has_no_global_window(spark):
    latest = serving.latest_forecast(given.served_latest(spark, SF))
    lists = given.watchlists(spark, SF).select("owner", "selected", ranking.clean_watchlist(F.col("saved")).alias("watchlist"))
    items = ranking.lookup_latest(ranking.comparison_items(lists), latest)
    rows = ranking.with_signal(ranking.with_delta(ranking.with_risk(ranking.anchor_by_owner(items))))
    assert "SinglePartition" not in plan(ranking.ranked(rows))


def test_many_versions_of_one_hot_bar(spark):
    """Half of the log is one symbol and date; each map task passes on one row of it."""
    hot = spark.range(20000).select(
        F.lit("HOT").alias("source_symbol"), F.lit("2024-01-02").cast("timestamp").alias("date"),
        *[F.lit(10.0).alias(c) for c in ("open", "high", "low")], F.col("id").cast("double").alias("close"),
        F.lit(1.0).alias("adj_close"), F.lit(1.0).alias("volume"), F.lit("s").alias("source_system"), F.lit("1d").alias("source_interval"),
        F.timestamp_seconds(F.col("id")).alias("ingestion_ts"), F.lit("2024-01-02").cast("date").alias("ingestion_date"),
        F.lit("r").alias("ingestion_run_id"),
    ).repartition(8)
    rows = medallion.clean(hot)
    assert [r.close for r in rows.collect()] == [19999.0]


def test_views_are_plain_relations(spark, raw):
    assert prices.publish_view(raw, "raw_view").count() == raw.count()


def test_a_hot_symbol_is_written_by_several_tasks(spark, namespace):
    """All rows share symbol and date; the clustered write still makes several files."""
    from barlake.sources import tables

    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64kb")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "16kb")
    try:
        rows = spark.range(0, 200000, 1, 8).select(
            F.lit("HOT").alias("source_symbol"), F.lit("2024-01-02").cast("date").alias("date"), F.rand(1).alias("close"),
            F.lit("2024-01-03").cast("date").alias("ingestion_date"),
        )
        tables.append_raw(rows, f"{namespace}.raw")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    stored = spark.table(f"{namespace}.raw")
    assert stored.count() == 200000 and len(stored.inputFiles()) >= 4


def test_served_tables_hold_every_event(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").count()
    assert given.served_latest(spark, SF).count() == given.served_metrics(spark, SF).count() == events
