"""Chart series and their summaries, from listed history and metrics rows (numbered ``rn``)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from barlake.functions.numbers import or_zero

# Fixed values.
RANGES = (7, 30, 60)
BAND_ROWS = 8
METRIC_ROWS = 5


def forecast_summary(listed: DataFrame) -> DataFrame:
    """Average and highest price of the listed rows, a missing price counting as 0."""
    price = or_zero(F.col("pred_close"))
    return listed.groupBy("symbol").agg(F.avg(price).alias("avg_forecast"), F.max(price).alias("max_forecast"))


def range_cut(listed: DataFrame, size: int) -> DataFrame:
    """The first ``size`` listed rows; all of them when the size is not positive."""
    return listed.filter(F.col("rn") <= size) if size > 0 else listed


def trajectory(cut: DataFrame) -> DataFrame:
    """The listed rows the other way round: (symbol, series, position, label, value).

    Each symbol has at most as many rows as a list may hold.
    """
    total = cut.groupBy("symbol").agg(F.max("rn").alias("last"))
    position = F.col("last") - F.col("rn") + 1
    return _points(cut.join(total, "symbol").withColumn("position", position).withColumns(
        {"label": F.concat(F.lit("D"), F.col("position").cast("string")), "value": or_zero(F.col("pred_close"))}
    ), "forecast")


def band_width(cut: DataFrame) -> DataFrame:
    """Width of the band over the first rows, not below 0."""
    width = F.greatest(or_zero(F.col("pred_high_80")) - or_zero(F.col("pred_low_80")), F.lit(0.0))
    horizon = F.coalesce(F.nullif(F.col("horizon_day"), F.lit(0)).cast("string"), F.lit("-"))
    rows = cut.filter(F.col("rn") <= BAND_ROWS)
    return _points(rows.withColumns(
        {"position": F.col("rn"), "label": F.concat(F.lit("D"), horizon), "value": width}
    ), "range")


def model_error(metrics: DataFrame) -> DataFrame:
    """CV error of the newest metrics rows, newest first."""
    label = F.coalesce(F.nullif("selected_model", F.lit("")), F.lit("model"))
    rows = metrics.filter(F.col("rn") <= METRIC_ROWS)
    return _points(rows.withColumns(
        {"position": F.col("rn"), "label": label, "value": or_zero(F.col("best_cv_mae"))}
    ), "metrics")


def _points(rows: DataFrame, series: str) -> DataFrame:
    return rows.select("symbol", F.lit(series).alias("series"), "position", "label", "value")


def insights(symbols: DataFrame, *series: DataFrame) -> DataFrame:
    """Last listed, lowest and highest value per symbol and series; empty series give NULLs.

    "Last" is the last of the list: the newest row for the trajectory, the eighth band, the oldest
    of the five errors.
    """
    points = reduce(DataFrame.unionByName, series)
    measured = points.groupBy("symbol", "series").agg(
        F.max_by("value", "position").alias("latest"), F.min("value").alias("lowest"), F.max("value").alias("highest")
    )
    names = F.explode(F.array(*[F.lit(n) for n in ("forecast", "range", "metrics")])).alias("series")
    return symbols.select("symbol", names).join(measured, ["symbol", "series"], "left")
