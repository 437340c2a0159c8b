"""The stream ends where the batch job ends, also after a replay and with late versions."""

from __future__ import annotations

import time
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from barlake import schemas
from barlake.operators import dedup, quality
from barlake.plans import given, medallion, signal_queries
from barlake.session import fresh_folder
from barlake.streaming import keyed_stream
from barlake.streaming.keyed_stream import OVERLAP, keyed_upsert_stream
from barlake.streaming.upsert_stream import upsert_stream

SF = "/root/testdata/sf0.001"


def stored(spark, name):
    """The stream writes from its own session, so the file list here has to be read anew."""
    spark.catalog.refreshTable(name)
    return spark.table(name)


def rows(df):
    return sorted(map(str, df.select(schemas.CLEAN.names).collect()))


def test_stream_equals_batch(spark, namespace):
    raw = given.raw_prices(spark, SF)
    folder = fresh_folder(spark, "raw")
    names = f"{namespace}.clean", f"{namespace}.rejects"
    checkpoint = fresh_folder(spark, "stream")
    early = F.col("ingestion_date") < F.lit("1998-01-01").cast("date")
    raw.filter(early).coalesce(2).write.parquet(folder)
    first = upsert_stream(spark, folder, raw.schema, *names, checkpoint, files_per_batch=1)
    first.awaitTermination()
    raw.filter(~early).coalesce(1).write.mode("append").parquet(folder)
    second = upsert_stream(spark, folder, raw.schema, *names, checkpoint)
    second.awaitTermination()
    assert first.exception() is None and second.exception() is None
    # Rows without an ingestion time settle in arrival order; all others as in the batch job.
    timed = lambda df: df.filter("ingestion_ts IS NOT NULL")
    labelled = medallion.labelled(raw)
    assert rows(timed(stored(spark, names[0]))) == rows(timed(medallion.clean(raw)))
    known = quality.rejected_rows(labelled).count()
    assert stored(spark, names[1]).count() == known

    # A second checkpoint replays everything.
    again = upsert_stream(spark, folder, raw.schema, *names, fresh_folder(spark, "stream"))
    again.awaitTermination()
    assert rows(timed(stored(spark, names[0]))) == rows(timed(medallion.clean(raw)))
    assert stored(spark, names[1]).count() == known


@pytest.mark.parametrize("newest_first", [False, True])
def test_keyed_stream_equals_batch_in_any_order_of_files(spark, namespace, newest_first):
    raw = given.raw_prices(spark, SF).filter("source_symbol IN ('AF', 'RF', '')").checkpoint()
    newest = raw.agg(F.max("ingestion_ts")).first()[0]
    # Files by ingestion time; null times come with the first.
    cuts = raw.selectExpr("percentile(unix_millis(ingestion_ts), array(0.34, 0.67))").first()[0]
    part = F.when(F.unix_millis("ingestion_ts") > cuts[1], 2).when(F.unix_millis("ingestion_ts") > cuts[0], 1).otherwise(0)
    folder, late = fresh_folder(spark, "raw"), fresh_folder(spark, "late")
    for n in (2, 1, 0) if newest_first else (0, 1, 2):
        raw.filter(part == n).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files are taken by their time of change
    names = f"{namespace}.clean", f"{namespace}.rejects"
    stream = keyed_upsert_stream(spark, folder, raw.schema, *names, fresh_folder(spark, "stream"), late, 1)
    stream.awaitTermination()
    assert stream.exception() is None
    assert rows(stored(spark, names[0])) == rows(medallion.clean(raw))
    assert stored(spark, names[1]).count() == quality.rejected_rows(medallion.labelled(raw)).distinct().count()

    # The state ends with the keys of the overlap, the rest went with the watermark.
    held = stream.lastProgress.stateOperators[0].numRowsTotal
    inside = medallion.clean(raw).filter(F.col("ingestion_ts") > F.lit(newest) - F.expr(f"INTERVAL {OVERLAP}")).count()
    assert held == inside < medallion.clean(raw).count() / 10

    # Late: below the watermark of the rows seen before. In order, only rows without a time are.
    outcome = spark.read.schema(schemas.CLEAN).parquet(late)
    if newest_first:
        assert outcome.filter("ingestion_ts IS NOT NULL").count() > 0
        assert outcome.agg(F.max("ingestion_ts")).first()[0] <= newest
    else:
        assert outcome.filter("ingestion_ts IS NOT NULL").count() == 0


@pytest.mark.parametrize("waiting", [1 << 17, 30])
def test_a_task_passes_on_one_row_per_key(spark, monkeypatch, waiting):
    """Also of many Arrow batches; where more keys wait than are held, a key may come again, but its newest row is there."""
    monkeypatch.setattr(keyed_stream, "WAITING", waiting, raising=False)
    every = spark.range(0, 1200, 1, 1).selectExpr(
        "concat('S', id % 40) AS symbol", "date'2024-01-02' AS date", "CAST(id AS double) AS open", "2D AS high", "1D AS low",
        "1D AS close", "1D AS adj_close", "1L AS volume", "'t' AS source_system", "'1d' AS source_interval",
        "CASE WHEN id % 40 <> 7 THEN timestamp_seconds(1700000000 + id % 400) END AS ingestion_ts",
        "date'2024-01-02' AS ingestion_date", "'run-0' AS ingestion_run_id",
    )
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(size, "10")
    try:
        got = keyed_stream.newest_of_batches(every).collect()
    finally:
        spark.conf.unset(size)
    assert len(got) == 40 if waiting > 1200 else 40 <= len(got) <= 1200
    newest = {(r.symbol, r.open) for r in dedup.latest_version(every).collect()}
    assert len(newest) == 40 and newest <= {(r.symbol, r.open) for r in got}
    assert keyed_stream.newest_of_batches(every.limit(0)).count() == 0


def test_a_raw_file_of_a_run_has_several_row_groups(spark):
    """The tasks of a batch share a large file: it has several row groups."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    wide = ["rand() AS a", "rand() AS b", "rand() AS c", "rand() AS d", "rand() AS e"]
    raw = spark.range(0, 1_400_000, 1, 2).selectExpr("concat('run-', id % 2) AS ingestion_run_id", "id", *wide)
    folder = signal_queries._raw_files(spark, raw)
    assert spark.conf.get(key) == before
    assert spark.read.parquet(folder).agg(F.count("*"), F.sum("id")).first() == raw.agg(F.count("*"), F.sum("id")).first()
    groups = [pq.ParquetFile(f).num_row_groups for f in Path(folder.removeprefix("file:")).glob("*/*.parquet")]
    assert groups and max(groups) > 1
