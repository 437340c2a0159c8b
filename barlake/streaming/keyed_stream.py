"""The incremental load as a stream with keyed state: only versions that can win reach the clean table.

State holds the version order of the newest row per (symbol, date). A timer drops it once the watermark, the newest
ingestion time less the overlap, has passed that version: any row that is still on time is newer than what was dropped.
So the state is bounded by the keys of the overlap, not by the history. What comes later than the overlap is labelled
``late`` and settled against the clean table by the version order, so the result is that of a batch load, whatever the
order of the files.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from barlake import schemas
from barlake.operators import quality
from barlake.operators.dedup import VERSION_ORDER
from barlake.operators.upsert import KEYS, upsert_table
from barlake.plans.medallion import labelled
from barlake.session import fresh_folder
from barlake.sources.tables import append_rejects

# What runs in tasks travels to the workers as code, so they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: the overlap of an incremental load.
OVERLAP = "7 days"
NEWEST, LATE, REJECTED = "newest", "late", "rejected"
ORDER = tuple(VERSION_ORDER)
ROW_DDL = schemas.CLEAN_DDL + ", arrived bigint"
OUTCOME_DDL = schemas.REJECT_DDL + ", outcome string"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
# Rows of a task that wait to be reduced to one per key.
WAITING = 1 << 17
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def newest_of_batches(valid: DataFrame) -> DataFrame:
    """The newest row per key of each task, so a key with a large share of the rows reaches its state thinned out.

    At most ``WAITING`` rows and a batch are held. Where keys hardly repeat, what is reduced is passed on.
    """
    order = [(c, "descending") for c in ORDER]

    def newest(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        import numpy as np

        best = pa.Table.from_batches(held).sort_by(order)
        place = best.select(list(KEYS)).append_column("place", pa.array(np.arange(len(best))))
        first = place.group_by(list(KEYS), use_threads=False).aggregate([("place", "min")])
        return best.take(first.column("place_min")).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(part.num_rows for part in held) >= WAITING:
                held = newest(held)
                if sum(part.num_rows for part in held) > WAITING // 2:
                    yield from held
                    held = []
        if held:
            yield from newest(held)

    timed = valid.select(*schemas.CLEAN.names, F.unix_micros("ingestion_ts").alias("arrived"))
    return timed.mapInArrow(run, ROW_DDL)


def _version(row: Row) -> tuple:
    """What the version order looks at; the time as microseconds, as state gives times back without their zone."""
    return (row.arrived, *[row[c] for c in ORDER[1:]])


def _rank(version: tuple) -> tuple:
    """A missing value comes before all others."""
    return tuple((False,) if value is None else (True, value) for value in version)


class NewestVersion(StatefulProcessor):
    """Passes on a version that is newer than the key's state, or late and without a state to compare with."""

    def init(self, handle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", f"arrived bigint, {_ddl(ORDER[1:])}")

    def handleInputRows(self, key, rows, timerValues):
        best = max(rows, key=lambda row: _rank(_version(row)))
        held = self.newest.get()
        if held is not None and _rank(_version(best)) <= _rank(held):
            return
        if held is None and (best.arrived is None or best.arrived // 1000 <= timerValues.getCurrentWatermarkInMs()):
            yield _outcome(best, LATE)
            return
        self.newest.update(_version(best))
        # A version without an ingestion time never replaces a held one, so there always is one here, and the one timer
        # of a key is that of the held version.
        if held is not None:
            self.handle.deleteTimer(held[0] // 1000)
        self.handle.registerTimer(best.arrived // 1000)
        yield _outcome(best, NEWEST)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.newest.clear()
        return iter([])


def _ddl(names) -> str:
    kinds = dict(part.split() for part in schemas.CLEAN_DDL.split(","))
    return ", ".join(f"{n} {kinds[n]}" for n in names)


def _outcome(row: Row, outcome: str) -> Row:
    values = row.asDict()
    values.pop("arrived")
    return Row(**values, quality_issue=None, is_valid=True, outcome=outcome)


def outcomes(raw: DataFrame, overlap: str = OVERLAP) -> DataFrame:
    """Rows of a raw stream that matter, labelled ``newest``, ``late`` or ``rejected``.

    Rows without an ingestion time cannot be placed before or after the watermark: they count as late. Versions that lose
    against the state are left out.
    """
    rows = labelled(raw.withWatermark("ingestion_ts", overlap))
    # The reduced rows carry no watermark column, so Spark itself drops no late row.
    valid = newest_of_batches(quality.valid_rows(rows))
    settled = valid.groupBy(*KEYS).transformWithState(
        NewestVersion(), OUTCOME_DDL, outputMode="Update", timeMode="EventTime"
    )
    rejected = quality.rejected_rows(rows).select(*schemas.REJECTS.names, F.lit(REJECTED).alias("outcome"))
    return settled.unionByName(rejected)


def keyed_upsert_stream(
    spark: SparkSession,
    raw_folder: str,
    raw_schema: T.StructType,
    clean_table: str,
    reject_table: str,
    checkpoint: str,
    late_folder: str | None = None,
    files_per_batch: int | None = None,
    every: str | None = None,
    buckets: int | None = None,
    overlap: str = OVERLAP,
) -> StreamingQuery:
    """Starts the stream; without ``every`` it takes what is there and stops.

    Late rows are also kept in ``late_folder``, one folder a batch, so a repeated batch replaces its own.
    """
    reader = spark.readStream.schema(raw_schema).format("parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    adaptive = spark.conf.get("spark.sql.adaptive.enabled")

    def load(batch: DataFrame, batch_id: int) -> None:
        try:
            settle(batch, batch_id)
        finally:
            batch.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")

    def settle(batch: DataFrame, batch_id: int) -> None:
        # Written once: the state is read and advanced by this one pass.
        staged = f"{fresh_folder(batch.sparkSession, 'stream-rows')}/rows"
        batch.write.partitionBy("outcome").parquet(staged)
        # A stateful stream runs without adaptive execution; what follows is no part of its state.
        batch.sparkSession.conf.set("spark.sql.adaptive.enabled", adaptive)
        layout = T.StructType([*schemas.REJECTS.fields, T.StructField("outcome", T.StringType())])
        stored = batch.sparkSession.read.schema(layout).parquet(staged)
        valid = stored.filter(F.col("outcome").isin(NEWEST, LATE)).select(schemas.CLEAN.names)
        upsert_table(valid, clean_table, buckets, by_version=True)
        append_rejects(stored.filter(F.col("outcome") == REJECTED).select(schemas.REJECTS.names), reject_table)
        if late_folder:
            late = stored.filter(F.col("outcome") == LATE).select(schemas.CLEAN.names)
            late.write.mode("overwrite").parquet(f"{late_folder}/batch_id={batch_id}")

    writer = outcomes(reader.load(raw_folder), overlap).writeStream.outputMode("update").foreachBatch(load)
    writer = writer.option("checkpointLocation", checkpoint)
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        timed = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
        return timed.start()
    finally:
        spark.conf.set(STATE_STORE, before)
