"""The leak-free feature matrix over daily bars.

All windows share one partitioning and order (symbol, date), hence one shuffle and one sort. After
dedup a symbol has at most one row per calendar date, so a window partition is bounded by the
length of the calendar however many raw versions the symbol has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

# Lags, return spans and rolling widths.
LAGS = (1, 2, 3, 5, 10, 20)
RETURNS = (1, 5)
WIDTHS = (5, 10, 20, 50)
MIN_TRAIN_ROWS = 250

FEATURES: tuple[str, ...] = (
    *[f"lag_close_{k}" for k in LAGS],
    *[f"ret_{k}" for k in RETURNS],
    *[name for w in WIDTHS for name in (f"roll_mean_{w}", f"roll_std_{w}")],
    "dow",
    "month",
    "log_volume",
)

# A row has all features exactly when these are set: a full frame of the widest roll holds every lag
# and every narrower roll, a return is also empty after a zero price, the rest needs date and
# volume. Naming six columns instead of nineteen keeps Catalyst's constraint sets small.
WITNESSES = (f"roll_mean_{max(WIDTHS)}", *[f"ret_{k}" for k in RETURNS], "month", "log_volume")


def by_date() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("date")


def with_adjusted(daily: DataFrame) -> DataFrame:
    """Fills ``adj_close`` from ``close``; also covers a series without any adjusted price."""
    adjusted = F.coalesce("adj_close", "close") if "adj_close" in daily.columns else F.col("close")
    return daily.withColumn("adj_close", adjusted)


def adjusted_report(daily: DataFrame) -> DataFrame:
    """Per symbol: rows filled from ``close`` and whether the whole series had to be."""
    missing = F.col("adj_close").isNull()
    return daily.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(missing).alias("filled_rows"),
        F.bool_and(missing).alias("all_missing"),
    )


def target() -> Column:
    """The next bar's unadjusted close."""
    return F.lead("close", 1).over(by_date())


def lags() -> dict[str, Column]:
    return {f"lag_close_{k}": F.lag("adj_close", k).over(by_date()) for k in LAGS}


def returns() -> dict[str, Column]:
    price = F.col("adj_close")
    return {f"ret_{k}": F.try_divide(price, F.lag("adj_close", k).over(by_date())) - 1 for k in RETURNS}


def _full_frame(aggregate, width: int) -> Column:
    """An aggregate over the ``width`` bars before the current one, NULL until all exist."""
    frame = by_date().rowsBetween(-width, -1)
    return F.when(F.count("adj_close").over(frame) == width, aggregate("adj_close").over(frame))


def rolling_means() -> dict[str, Column]:
    return {f"roll_mean_{w}": _full_frame(F.avg, w) for w in WIDTHS}


def rolling_stds() -> dict[str, Column]:
    return {f"roll_std_{w}": _full_frame(F.stddev_samp, w) for w in WIDTHS}


def calendar_parts() -> dict[str, Column]:
    """Monday is 0."""
    return {"dow": F.weekday("date"), "month": F.month("date")}


def log_volume() -> dict[str, Column]:
    return {"log_volume": F.log1p(F.col("volume").cast("double"))}


def all_features() -> dict[str, Column]:
    made = {**lags(), **returns(), **rolling_means(), **rolling_stds(), **calendar_parts(), **log_volume()}
    return {name: made[name].cast("double") for name in FEATURES}


def feature_matrix(daily: DataFrame) -> DataFrame:
    """symbol, date, close, adj_close, volume, the 19 features and the target."""
    made = [c.alias(n) for n, c in all_features().items()]
    return with_adjusted(daily).select(
        "symbol", "date", "close", "adj_close", "volume", *made, target().alias("target")
    )


def training_rows(matrix: DataFrame) -> DataFrame:
    """Rows with every feature and the target."""
    return matrix.dropna(subset=[*WITNESSES, "target"])


def scoring_rows(matrix: DataFrame) -> DataFrame:
    """The newest row per symbol with every feature; its target may be missing."""
    window = Window.partitionBy("symbol").orderBy(F.col("date").desc())
    complete = matrix.dropna(subset=list(WITNESSES))
    return complete.withColumn("rn", F.row_number().over(window)).filter("rn = 1").drop("rn")


def is_training_row() -> Column:
    complete = F.col("target").isNotNull()
    for name in WITNESSES:
        complete = complete & F.col(name).isNotNull()
    return complete


def history_check(matrix: DataFrame, min_rows: int = MIN_TRAIN_ROWS) -> DataFrame:
    """Per symbol: complete training rows and, when too few, the reason to leave it out."""
    counted = matrix.groupBy("symbol").agg(F.count_if(is_training_row()).alias("train_rows"))
    return counted.withColumn(
        "reason", F.when(F.col("train_rows") < min_rows, F.lit("insufficient_history"))
    )


def enough_history(train: DataFrame, min_rows: int = MIN_TRAIN_ROWS, strict: bool = False) -> DataFrame:
    """Training rows of symbols with enough of them; ``strict`` raises on the first short one."""
    sized = train.withColumn("train_rows", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    if strict:
        short = sized.filter(F.col("train_rows") < min_rows).select("symbol").limit(1).collect()
        if short or sized.isEmpty():
            raise ValueError(f"not enough history to train: {short[0].symbol if short else 'no symbol'}")
    return sized.filter(F.col("train_rows") >= min_rows)
