"""Row rules, series checks and load counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

# Columns that must be filled, in label order.
REQUIRED = ("symbol", "date", "open", "high", "low", "close", "volume")


class SeriesError(ValueError):
    """A series is not fit for modelling."""


def _rules() -> list[tuple[str, Column]]:
    missing = [(f"{c}_null", F.col(c).isNull()) for c in REQUIRED]
    return missing + [
        ("high_lt_low", F.col("high") < F.col("low")),
        ("volume_negative", F.col("volume") < 0),
    ]


def label_quality(clean: DataFrame) -> DataFrame:
    """Adds the first broken rule (or NULL) and ``is_valid``."""
    broken = [F.when(condition, F.lit(label)) for label, condition in _rules()]
    labelled = clean.withColumn("quality_issue", F.coalesce(*broken))
    return labelled.withColumn("is_valid", F.col("quality_issue").isNull())


def valid_rows(labelled: DataFrame) -> DataFrame:
    return labelled.filter("is_valid").drop("quality_issue", "is_valid")


def rejected_rows(labelled: DataFrame) -> DataFrame:
    return labelled.filter("NOT is_valid")


COUNTS = ("total_rows", "valid_rows", "rejected_rows")


def counts() -> list[Column]:
    """Total, valid and rejected rows; as aggregates of a query or observed on the way to a write."""
    made = (F.count(F.lit(1)), F.count_if("is_valid"), F.count_if(~F.col("is_valid")))
    return [c.alias(n) for n, c in zip(COUNTS, made, strict=True)]


def load_counts(labelled: DataFrame) -> DataFrame:
    """Total, valid and rejected rows in one pass."""
    return labelled.agg(*counts())


def reject_summary(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy("quality_issue", "ingestion_date").agg(F.count(F.lit(1)).alias("row_count"))


def series_violations(daily: DataFrame) -> DataFrame:
    """Per symbol: counts of everything that makes its series unusable."""
    counts = {
        "null_date": F.col("date").isNull(),
        "null_close": F.col("close").isNull(),
        "null_adj_close": F.col("adj_close").isNull(),
        "null_volume": F.col("volume").isNull(),
        "close_not_positive": F.col("close") <= 0,
        "volume_negative": F.col("volume") < 0,
    }
    checked = daily.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.count_if(condition).alias(name) for name, condition in counts.items()],
    )
    bad = sum((F.col(name) for name in counts), F.lit(0))
    return checked.withColumn("is_usable", bad == 0)


def series_reasons() -> list[tuple[str, Column]]:
    """Why a series is left out, first reason first, as a condition on one of its rows."""
    missing = [F.col(c).isNull() for c in ("date", "close", "adj_close", "volume")]
    return [
        ("null_values", reduce(lambda a, b: a | b, missing)),
        ("close_not_positive", F.col("close") <= 0),
        ("volume_negative", F.col("volume") < 0),
    ]


def usable_rows(daily: DataFrame) -> DataFrame:
    """Rows of the usable symbols. The window has the order of the feature windows, so it shares their shuffle."""
    series = Window.partitionBy("symbol").orderBy("date")
    whole = series.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bad = reduce(lambda a, b: a | b, [F.coalesce(condition, F.lit(False)) for _, condition in series_reasons()])
    return daily.withColumn("bad_rows", F.count_if(bad).over(whole)).filter("bad_rows = 0").drop("bad_rows")


def require_usable(daily: DataFrame) -> DataFrame:
    """Strict form: raises on an empty frame or the first unusable symbols."""
    checked = series_violations(daily)
    if checked.isEmpty():
        raise SeriesError("no price rows")
    bad = [r.symbol for r in checked.filter("NOT is_usable").orderBy("symbol").limit(10).collect()]
    if bad:
        raise SeriesError(f"unusable series: {', '.join(map(str, bad))}")
    return daily
