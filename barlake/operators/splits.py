"""Expanding time-ordered folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

FOLDS = 5
FINAL_FIT = FOLDS + 1


def with_segments(train: DataFrame) -> DataFrame:
    """Numbers each symbol's training rows and cuts them into segments 0..5.

    Segments 1..5 are the equally long test blocks at the end (a sixth of the rows each); segment 0
    is what comes before. Fold f tests on segment f and trains on all segments below f; the final
    fit uses all of them.
    """
    by_date = Window.partitionBy("symbol").orderBy("date")
    whole = Window.partitionBy("symbol")
    # The history check has counted the rows already.
    sized = train if "train_rows" in train.columns else train.withColumn("train_rows", F.count(F.lit(1)).over(whole))
    placed = sized.withColumns(
        {"pos": F.row_number().over(by_date) - 1, "block": F.floor(F.col("train_rows") / (FOLDS + 1))}
    )
    first_test = F.col("train_rows") - FOLDS * F.col("block")
    segment = F.when(F.col("pos") < first_test, F.lit(0)).otherwise(
        F.floor((F.col("pos") - first_test) / F.col("block")) + 1
    )
    return placed.withColumn("segment", segment.cast("int")).drop("block")


def fold_bounds(segmented: DataFrame) -> DataFrame:
    """Per symbol and fold: rows and dates of both sides."""
    folds = segmented.withColumn("fold", F.explode(F.sequence(F.greatest("segment", F.lit(1)), F.lit(FOLDS))))
    tested = F.col("segment") == F.col("fold")
    return folds.groupBy("symbol", "fold").agg(
        F.count_if(~tested).alias("train_rows"),
        F.count_if(tested).alias("test_rows"),
        F.max(F.when(~tested, F.col("date"))).alias("train_end"),
        F.min(F.when(tested, F.col("date"))).alias("test_start"),
        F.max(F.when(tested, F.col("date"))).alias("test_end"),
    )
