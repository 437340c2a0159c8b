"""Job and run records as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barlake.functions.times import iso_from_millis
from barlake.operators.serving import RUNS_LIMIT, top_per

# Words for missing states.
NO_RUN = "NO DATA"
NO_LIFE_CYCLE = "UNKNOWN"
NO_RESULT = "IN_PROGRESS"
ID_TAIL = 10


def search_jobs(jobs: DataFrame, query: str) -> DataFrame:
    """Jobs whose name contains the query, whatever the case; a blank query keeps all."""
    name = F.lower(F.coalesce("settings.name", F.lit("")))
    wanted = query.lower().strip()
    return jobs.filter(F.contains(name, F.lit(wanted))) if wanted else jobs


def job_by_id(jobs: DataFrame, job_id: int) -> DataFrame:
    return jobs.filter(F.col("job_id") == job_id)


def recent_runs(runs: DataFrame, n: int | None = None, job_id: int | None = None) -> DataFrame:
    """The newest n runs per job with readable times."""
    rows = runs if job_id is None else runs.filter(F.col("job_id") == job_id)
    order = [F.col("start_time").desc_nulls_last(), F.desc("run_id")]
    listed = top_per(rows, ["job_id"], order, n, RUNS_LIMIT).drop("rn")
    return listed.withColumns(
        {"start_time_iso": iso_from_millis(F.col("start_time")), "end_time_iso": iso_from_millis(F.col("end_time"))}
    )


def _or(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def latest_run_state(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Per job: newest run and its ``life cycle / result`` label.

    The newest run is a map-side combinable aggregate, so a job with most of the runs is no hot spot.
    """
    recency = F.struct(F.coalesce("start_time", F.lit(-1).cast("bigint")), "run_id")
    newest = runs.groupBy("job_id").agg(F.max_by(F.struct("run_id", "state"), recency).alias("run"))
    state = F.concat_ws(
        " / ", _or(F.col("run.state.life_cycle_state"), NO_LIFE_CYCLE), _or(F.col("run.state.result_state"), NO_RESULT)
    )
    return jobs.join(newest, "job_id", "left").select(
        "job_id",
        F.col("run.run_id").alias("run_id"),
        F.when(F.col("run").isNull(), F.lit(NO_RUN)).otherwise(state).alias("run_state"),
    )


def run_table(runs: DataFrame) -> DataFrame:
    """The listed form of runs."""
    return runs.select(
        "job_id",
        "run_id",
        _or(F.col("state.life_cycle_state"), "-").alias("life_cycle"),
        _or(F.col("state.result_state"), NO_RESULT).alias("result"),
        "start_time",
        "end_time",
    )


def id_tail(run_id: Column) -> Column:
    """The last ten characters of a run id, or a dash."""
    return F.coalesce(F.right(F.nullif(run_id, F.lit("")), F.lit(ID_TAIL)), F.lit("-"))
