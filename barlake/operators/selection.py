"""Model scores, choice and band, from the out-of-fold table only.

Out-of-fold rows: symbol, model, model_order, fold, date, y, pred, residual.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barlake.operators.splits import FOLDS

# Fixed values.
BAND_QUANTILES = (0.1, 0.9)
MIN_RESIDUALS = 30

_MODEL = ("symbol", "model", "model_order")


def fold_mae(oof: DataFrame) -> DataFrame:
    return oof.groupBy(*_MODEL, "fold").agg(
        F.avg(F.abs("residual")).alias("mae"), F.count(F.lit(1)).alias("row_count")
    )


def cv_mae(folds: DataFrame) -> DataFrame:
    """The mean of the fold errors (folds weigh the same, not rows)."""
    return folds.groupBy(*_MODEL).agg(
        F.avg("mae").alias("cv_mae"), F.sum("row_count").alias("residual_rows")
    )


def residual_bounds(oof: DataFrame) -> DataFrame:
    """CV error and pooled 0.1 / 0.9 residual quantiles; with few residuals plus and minus the error.

    One grouped pass: the fold errors are conditional averages. A symbol's residuals number at most
    its dates, so the exact percentile's buffer stays small.
    """
    errors = F.array(*[F.avg(F.when(F.col("fold") == k, F.abs("residual"))) for k in range(1, FOLDS + 1)])
    pooled = oof.groupBy(*_MODEL).agg(
        F.filter(errors, lambda e: e.isNotNull()).alias("fold_errors"),
        F.count(F.lit(1)).alias("residual_rows"),
        F.percentile("residual", list(BAND_QUANTILES)).alias("q"),
    )
    total = F.aggregate("fold_errors", F.lit(0.0), lambda a, x: a + x)
    scored = pooled.withColumn("cv_mae", F.try_divide(total, F.size("fold_errors")))
    enough = F.col("residual_rows") >= MIN_RESIDUALS
    return scored.select(
        *_MODEL,
        "cv_mae",
        "residual_rows",
        F.when(enough, F.col("q")[0]).otherwise(-F.col("cv_mae")).alias("q_low"),
        F.when(enough, F.col("q")[1]).otherwise(F.col("cv_mae")).alias("q_high"),
    )


def choose_model(scored: DataFrame) -> DataFrame:
    """The smallest CV error per symbol; the earlier candidate wins a tie."""
    rest = [c for c in scored.columns if c != "symbol"]
    # A candidate without an error comes last.
    best = F.min_by(F.struct(*rest), F.struct(F.col("cv_mae").isNull(), "cv_mae", "model_order")).alias("best")
    return scored.groupBy("symbol").agg(best).select("symbol", "best.*")


def band(pred: Column, q_low: Column, q_high: Column) -> dict[str, Column]:
    """Constant-width band around the prediction, bounds put in order, not floored."""
    a, b = pred + q_low, pred + q_high
    return {"pred_low_80": F.least(a, b), "pred_high_80": F.greatest(a, b)}
