"""Trend, scorecard, decision and alerts per symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barlake.functions.numbers import clamp, first_nonzero, or_zero, percent_of
from barlake.operators.serving import HISTORY_LIMIT, METRICS_LIMIT, history_order, latest_forecast, top_per

# Score limits, confidence, alert limits and texts.
TIGHT_RANGE_PCT = 1.2
LOW_ERROR = 1.0
HEALTHY_STD = 5.0
BUY_SCORE, HOLD_SCORE = 3, 2
CONFIDENCE_BASE, CONFIDENCE_STEP, CONFIDENCE_MIN, CONFIDENCE_MAX = 48, 12, 40, 92
WIDE_RANGE_PCT = 1.8
HIGH_ERROR = 1.0
MAX_ALERTS = 3
ALERTS = {
    "trend": ("warn", "Short-term trend turned bearish",
              "Recent forecast points are moving down. Consider waiting for trend stabilization."),
    "range": ("warn", "Forecast uncertainty increased",
              "80% band width is {}%, which indicates wider variance than usual."),
    "error": ("danger", "Model error is elevated",
              "Cross-validation MAE is {}. Review the selected model and recent pipeline runs."),
    "run": ("danger", "Latest pipeline run failed",
            "The job did not complete successfully. Forecast freshness may be impacted."),
}


def tone(current: Column, previous: Column) -> Column:
    """up, down or flat; a missing side is flat."""
    return F.when(current > previous, F.lit("up")).when(current < previous, F.lit("down")).otherwise(F.lit("flat"))


def leading_rows(history: DataFrame) -> DataFrame:
    """Per symbol the prices of the first two listed history rows."""
    first_two = top_per(history, ["symbol"], history_order(), 2, HISTORY_LIMIT)
    at = lambda n: F.max(F.when(F.col("rn") == n, F.col("pred_close")))
    return first_two.groupBy("symbol").agg(
        at(1).alias("first_close"), at(2).alias("second_close"), F.count(F.lit(1)).alias("listed_rows")
    )


def trend(leading: DataFrame) -> DataFrame:
    """First listed row against the second (the order of the list, newest run, nearest day first)."""
    moved = tone(or_zero(F.col("first_close")), or_zero(F.col("second_close")))
    return leading.withColumn("trend", F.when(F.col("listed_rows") >= 2, moved).otherwise(F.lit("flat")))


def newest_metrics(metrics: DataFrame) -> DataFrame:
    order = [F.desc("loaded_ts"), F.desc("pipeline_run_id")]
    return top_per(metrics, ["symbol"], order, 1, METRICS_LIMIT).drop("rn")


def symbol_state(latest: DataFrame, history: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row per symbol known to any of the three tables; all joins are on the symbol."""
    exposed = latest_forecast(latest).select(
        "symbol", "predicted_close", "predicted_low_80", "predicted_high_80", F.lit(True).alias("in_latest")
    )
    scored = newest_metrics(metrics).select("symbol", "best_cv_mae", "pred_std", F.lit(True).alias("in_metrics"))
    return trend(leading_rows(history)).join(exposed, "symbol", "full_outer").join(scored, "symbol", "full_outer")


def latest_close(state: DataFrame) -> DataFrame:
    """First listed history price, else the exposed one, else 0."""
    return state.select(
        "symbol", first_nonzero(F.col("first_close"), F.col("predicted_close")).alias("latest_close")
    )


def scorecard(state: DataFrame) -> DataFrame:
    """Numbers, four conditions and the score.

    Missing numbers count as 0, so a symbol without a band or metrics passes those conditions; the
    has_* columns tell.
    """
    measured = state.select(
        "symbol",
        F.coalesce("trend", F.lit("flat")).alias("trend"),
        first_nonzero(F.col("predicted_close"), F.col("first_close")).alias("close"),
        or_zero(F.col("predicted_low_80")).alias("low"),
        or_zero(F.col("predicted_high_80")).alias("high"),
        or_zero(F.col("best_cv_mae")).alias("cv_mae"),
        or_zero(F.col("pred_std")).alias("pred_std"),
        (F.col("predicted_low_80").isNotNull() & F.col("predicted_high_80").isNotNull()).alias("has_band"),
        F.coalesce("in_metrics", F.lit(False)).alias("has_metrics"),
    )
    spread = measured.withColumn("range", F.col("high") - F.col("low")).withColumn(
        "range_pct", percent_of(F.col("range"), F.col("close"))
    )
    conditions = {
        "trend_up": F.col("trend") == "up",
        "tight_range": F.coalesce(F.col("range_pct") < TIGHT_RANGE_PCT, F.lit(False)),
        "low_error": F.col("cv_mae") < LOW_ERROR,
        "healthy_volatility": F.col("pred_std") < HEALTHY_STD,
    }
    judged = spread.withColumns(conditions)
    return judged.withColumn("score", sum((F.col(c).cast("int") for c in conditions), F.lit(0)))


def decision(scores: DataFrame) -> DataFrame:
    word = (
        F.when(F.col("score") >= BUY_SCORE, F.lit("BUY"))
        .when(F.col("score") == HOLD_SCORE, F.lit("HOLD"))
        .otherwise(F.lit("AVOID"))
    )
    confidence = clamp(CONFIDENCE_BASE + F.col("score") * CONFIDENCE_STEP, CONFIDENCE_MIN, CONFIDENCE_MAX)
    return scores.withColumns({"decision": word, "confidence": confidence.cast("int")})


def alerts(scores: DataFrame, run_states: DataFrame) -> DataFrame:
    """At most three alerts per symbol in fixed order, numbered from 1.

    ``run_states`` holds (symbol, run_state); symbols without one raise no run alert.
    """

    def alert(key: str, value: Column | None = None) -> Column:
        kind, title, text = ALERTS[key]
        before, _, after = text.partition("{}")
        filled = F.lit(text) if value is None else F.concat(F.lit(before), value, F.lit(after))
        return F.struct(F.lit(kind).alias("tone"), F.lit(title).alias("title"), filled.alias("description"))

    candidates = F.array(
        F.when(F.col("trend") == "down", alert("trend")),
        F.when(F.col("range_pct") > WIDE_RANGE_PCT, alert("range", F.format_string("%.1f", "range_pct"))),
        F.when(F.col("cv_mae") > HIGH_ERROR, alert("error", F.format_string("%.4f", "cv_mae"))),
        F.when(F.contains("run_state", F.lit("FAILED")), alert("run")),
    )
    raised = F.slice(F.filter(candidates, lambda a: a.isNotNull()), 1, MAX_ALERTS)
    known = scores.join(run_states, "symbol", "left")
    return known.select("symbol", F.posexplode(raised).alias("pos", "alert")).select(
        "symbol", (F.col("pos") + 1).alias("position"), "alert.tone", "alert.title", "alert.description"
    )
