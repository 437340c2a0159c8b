"""Forecast and metrics rows, the flat guard and the experiment record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barlake.operators.features import FEATURES
from barlake.operators.recursion import path_rows, path_spread
from barlake.operators.selection import band

# Fixed values.
MIN_STD = 0.0001
UNSCHEDULED = "interactive"


class FlatForecast(ValueError):
    """The forecast of a symbol does not move."""


def resolve_run_id(job_run_id: object | None = None) -> str:
    """The scheduler's run id, or a fixed word for a run by hand."""
    return UNSCHEDULED if job_run_id is None else str(job_run_id)


def forecast_rows(paths: DataFrame, run_id: str) -> DataFrame:
    """Forecast table rows from path rows (symbol, model, dates, preds and the choice's numbers)."""
    bounds = band(F.col("pred"), F.col("q_low"), F.col("q_high"))
    return path_rows(paths).select(
        "symbol",
        F.col("date").cast("timestamp").alias("forecast_date"),
        F.col("step").cast("bigint").alias("horizon_day"),
        F.col("pred").alias("pred_close"),
        *[c.alias(n) for n, c in bounds.items()],
        F.col("model").alias("model_name"),
        "cv_mae",
        F.lit(run_id).alias("pipeline_run_id"),
    )


def dispersion(forecast: DataFrame) -> DataFrame:
    return forecast.groupBy("symbol").agg(
        F.stddev_samp("pred_close").alias("pred_std"), F.count(F.lit(1)).alias("forecast_rows")
    )


def flat_check(forecast: DataFrame, min_std: float = MIN_STD) -> DataFrame:
    """Per symbol: spread and whether it is flat; a single step has no spread and passes."""
    flat = F.coalesce(F.col("pred_std") < min_std, F.lit(False))
    return dispersion(forecast).withColumn("is_flat", flat)


def path_reason(min_std: float = MIN_STD) -> Column:
    """Why a path is not published, or NULL."""
    return F.when(F.exists("preds", lambda p: p.isNull()), F.lit("missing_prediction")).when(
        path_spread(F.col("preds")) < min_std, F.lit("flat_forecast")
    )


def require_moving(forecast: DataFrame, min_std: float = MIN_STD) -> DataFrame:
    flat = [r.symbol for r in flat_check(forecast, min_std).filter("is_flat").orderBy("symbol").limit(10).collect()]
    if flat:
        raise FlatForecast(f"flat forecast: {', '.join(flat)}")
    return forecast


def metrics_rows(paths: DataFrame, run_id: str) -> DataFrame:
    """One metrics row per path."""
    return paths.select(
        "symbol",
        F.col("model").alias("selected_model"),
        F.col("cv_mae").alias("best_cv_mae"),
        path_spread(F.col("preds")).alias("pred_std"),
        F.col("train_rows").cast("bigint").alias("train_rows"),
        F.lit(run_id).alias("pipeline_run_id"),
    )


def experiment_record(
    scored: DataFrame, paths: DataFrame, run_id: str, horizon: int, min_std: float = MIN_STD
) -> DataFrame:
    """Everything worth keeping of a run as (run_id, symbol, kind, key, number, text) rows."""

    def item(kind: str, key: str, number=None, text=None):
        return F.struct(
            F.lit(kind).alias("kind"),
            F.lit(key).alias("key") if isinstance(key, str) else key.alias("key"),
            (F.lit(None) if number is None else number).cast("double").alias("number"),
            (F.lit(None) if text is None else text).cast("string").alias("text"),
        )

    per_symbol = paths.select(
        "symbol",
        F.inline(
            F.array(
                item("param", "symbol", text=F.col("symbol")),
                item("param", "forecast_horizon", F.lit(horizon)),
                item("param", "min_std_threshold", F.lit(min_std)),
                item("param", "pipeline_run_id", text=F.lit(run_id)),
                item("param", "train_rows", F.col("train_rows")),
                item("param", "feature_count", F.lit(len(FEATURES))),
                item("metric", "best_cv_mae", F.col("cv_mae")),
                item("metric", "pred_std", path_spread(F.col("preds"))),
                item("metric", "forecast_rows", F.size("preds")),
                item("tag", "selected_model", text=F.col("model")),
            )
        ),
    )
    key = F.concat(F.lit("cv_mae_"), F.col("model"))
    per_model = scored.select("symbol", F.inline(F.array(item("metric", key, F.col("cv_mae")))))
    return per_symbol.unionByName(per_model).select(F.lit(run_id).alias("run_id"), "*")
