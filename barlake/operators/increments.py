"""The feature matrix by loads: features of new bars only, from a carried state of the last bars.

Bars of the last days of a symbol are open, because the next load fetches them again and may correct them; all earlier
ones are closed and their feature rows never change. The state holds the open bars and the 51 before them, which is all
that their features need, so a load costs the same however long the history is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from barlake.operators.features import WIDTHS, feature_matrix, with_adjusted
from barlake.operators.ingest import OVERLAP_DAYS

BARS = ("symbol", "date", "close", "adj_close", "volume")
STATE_DDL = "symbol string, date date, close double, adj_close double, volume bigint, open_from date"
DEPTH = max(WIDTHS) + 1
FIRST_DAY = "0001-01-01"


@dataclass(frozen=True)
class Step:
    """What a load adds: closed feature rows to append, the next state, bars too old to be taken."""

    closed: DataFrame
    state: DataFrame
    late: DataFrame


def _merged(state: DataFrame, bars: DataFrame) -> DataFrame:
    """Carried and new bars with the first open date of the symbol."""
    series = Window.partitionBy("symbol")
    both = state.select(*BARS, "open_from", F.lit(0).alias("fresh")).unionByName(
        bars.select(*BARS, F.lit(None).cast("date").alias("open_from"), F.lit(1).alias("fresh"))
    )
    # A first load of a symbol opens with its first date.
    before = F.coalesce(F.max("open_from").over(series), F.lit(FIRST_DAY).cast("date"))
    return both.withColumn("was_open_from", before)


def step(state: DataFrame, bars: DataFrame, overlap_days: int = OVERLAP_DAYS) -> Step:
    """One load of daily bars (one row per symbol and date) on top of a state (``STATE_DDL``, empty at first).

    ``closed`` has the columns of the feature matrix. ``late`` are new bars before the open ones: they are not taken, and
    where they are corrections the matrix of their symbols has to be built anew from the whole history.
    """
    series = Window.partitionBy("symbol")
    merged = _merged(state, with_adjusted(bars))
    # Carried bars before the open ones are context; new bars there would change closed rows.
    taken = merged.where((F.col("fresh") == 0) | (F.col("date") >= F.col("was_open_from")))
    newest = Window.partitionBy("symbol", "date").orderBy(F.desc("fresh"))
    taken = taken.withColumn("rn", F.row_number().over(newest)).where("rn = 1")
    late = merged.where((F.col("fresh") == 1) & (F.col("date") < F.col("was_open_from"))).select(*BARS)
    bound = F.greatest("was_open_from", F.date_sub(F.max("date").over(series), overlap_days))
    known = taken.withColumn("now_open_from", bound).select(*BARS, "was_open_from", "now_open_from")
    bounds = known.select("symbol", "date", "was_open_from", "now_open_from")
    closed = feature_matrix(known.select(*BARS)).join(bounds, ["symbol", "date"])
    inside = (F.col("date") >= F.col("was_open_from")) & (F.col("date") < F.col("now_open_from"))
    context = Window.partitionBy("symbol", F.col("date") < F.col("now_open_from")).orderBy(F.desc("date"))
    ranked = known.withColumn("rn", F.row_number().over(context))
    kept = ranked.where((F.col("date") >= F.col("now_open_from")) | (F.col("rn") <= DEPTH))
    return Step(
        closed.where(inside).drop("was_open_from", "now_open_from"),
        kept.select(*BARS, F.col("now_open_from").alias("open_from")),
        late,
    )


def open_rows(state: DataFrame) -> DataFrame:
    """Feature rows of the open bars; the newest one is what the next prediction starts from."""
    bounds = state.select("symbol", "date", "open_from")
    rows = feature_matrix(state.select(*BARS)).join(bounds, ["symbol", "date"])
    return rows.where(F.col("date") >= F.col("open_from")).drop("open_from")
