"""Watchlists, comparison with an anchor symbol, risk, signal and ranks."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlake.functions.numbers import or_zero
from barlake.functions.text import lenient_symbol
from barlake.operators.signals import tone

# Quick symbols, fallback, list sizes, weights and factors.
QUICK_SYMBOLS = ("NVDA", "MSFT", "AAPL", "AMD", "TSLA")
FALLBACK = "NVDA"
WATCHLIST_MAX = 12
COMPARE_MAX = 4
WEIGHT_MIN, WEIGHT_MAX = 0.0, 2.0
RISK_PER_MAE = 12.0
PENALTY_PER_MAE = 10.0


@dataclass(frozen=True)
class Weights:
    """Signal weights, each kept within [0, 2]."""

    delta: float = 1.0
    risk: float = 0.25
    mae: float = 0.4

    def __post_init__(self) -> None:
        for name in ("delta", "risk", "mae"):
            object.__setattr__(self, name, min(WEIGHT_MAX, max(WEIGHT_MIN, getattr(self, name))))


def weights_from_saved(saved: dict | None) -> Weights:
    """Stored weights; an unusable or zero one falls back to its default."""
    usual = Weights()

    def read(name: str) -> float:
        try:
            value = float((saved or {}).get(name))
        except (TypeError, ValueError):
            return getattr(usual, name)
        value = min(WEIGHT_MAX, max(WEIGHT_MIN, value)) if not math.isnan(value) else 0.0
        return value or getattr(usual, name)

    return Weights(read("delta"), read("risk"), read("mae"))


def clean_watchlist(saved: Column) -> Column:
    """Each text made a symbol, empties dropped, the first twelve; never empty."""
    symbols = F.filter(F.transform(F.coalesce(saved, F.array()), lenient_symbol), lambda s: s != "")
    kept = F.slice(symbols, 1, WATCHLIST_MAX)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(FALLBACK)))


def toggle_symbol(watchlist: Column, symbol: Column) -> Column:
    """Takes the symbol out when it is in, else puts it first."""
    without = F.array_remove(watchlist, symbol)
    shorter = F.when(F.size(without) > 0, without).otherwise(F.array(F.lit(FALLBACK)))
    longer = F.slice(F.array_prepend(watchlist, symbol), 1, WATCHLIST_MAX)
    return F.when(F.array_contains(watchlist, symbol), shorter).otherwise(longer)


def comparison_symbols(selected: Column, watchlist: Column) -> Column:
    """Selected, watched, then quick symbols: the first four different ones."""
    merged = F.concat(F.array(selected), watchlist, F.array(*[F.lit(s) for s in QUICK_SYMBOLS]))
    return F.slice(F.array_distinct(F.filter(merged, lambda s: s != "")), 1, COMPARE_MAX)


def comparison_items(watchlists: DataFrame) -> DataFrame:
    """(owner, selected, position, symbol) from (owner, selected, watchlist); at most four per owner."""
    symbols = comparison_symbols(F.col("selected"), F.col("watchlist"))
    return watchlists.select("owner", "selected", F.posexplode(symbols).alias("pos", "symbol")).select(
        "owner", "selected", (F.col("pos") + 1).alias("position"), "symbol"
    )


def lookup_latest(items: DataFrame, latest: DataFrame) -> DataFrame:
    """Left join to the one latest row per symbol; ``has_row`` tells a missing row from missing values.

    Every list may hold the same few symbols. The left side of a left join may be split, so adaptive execution deals a
    popular symbol's items out over as many tasks as their size asks for, or broadcasts the short latest rows.
    """
    joined = items.join(latest.select("*", F.lit(True).alias("has_row")), "symbol", "left")
    return joined.withColumn("has_row", F.coalesce("has_row", F.lit(False)))


def anchor_by_owner(items: DataFrame) -> DataFrame:
    """Adds the selected symbol's price to every item of an owner.

    The selected symbol always leads its owner's list, so the anchor is found inside the owner's own
    (at most four) rows and needs no second lookup.
    """
    own = Window.partitionBy("owner")
    anchor = F.max(F.when((F.col("symbol") == F.col("selected")) & F.col("has_row"), or_zero(F.col("predicted_close"))))
    return items.withColumn("anchor_close", anchor.over(own))


def anchor_for_all(latest: DataFrame, symbol: str) -> DataFrame:
    """Every symbol's latest row beside one anchor price (a scalar subquery, NULL when missing)."""
    price = latest.filter(F.col("symbol") == symbol).agg(F.max(or_zero(F.col("predicted_close")))).scalar()
    return latest.select("*", F.lit(True).alias("has_row"), price.alias("anchor_close"))


def with_risk(rows: DataFrame) -> DataFrame:
    """Band width in percent plus weighted CV error, not below 0; a missing row has none."""
    close, cv = _when_row("predicted_close"), _when_row("cv_mae")
    band = (_when_row("predicted_high_80") - _when_row("predicted_low_80")) / F.nullif(close, F.lit(0.0)) * 100.0
    risk = F.coalesce(band, F.lit(0.0)) + F.coalesce(cv * RISK_PER_MAE, F.lit(0.0))
    return rows.withColumns({"close": close, "cv_error": cv, "risk_index": F.greatest(F.lit(0.0), risk)})


def _when_row(name: str) -> Column:
    """A missing value in a row is 0, a missing row is NULL."""
    return F.when(F.col("has_row"), or_zero(F.col(name)))


def with_delta(rows: DataFrame) -> DataFrame:
    """Distance to the anchor, absolute and in percent, and its tone."""
    gap = F.col("close") - F.col("anchor_close")
    delta = F.coalesce(gap, F.lit(0.0))
    percent = F.coalesce(delta / F.nullif("anchor_close", F.lit(0.0)) * 100.0, F.lit(0.0))
    return rows.withColumns({"delta": delta, "delta_pct": percent, "delta_tone": tone(gap, F.lit(0.0))})


def with_signal(rows: DataFrame, weights: Weights = Weights()) -> DataFrame:
    penalty = F.coalesce(F.col("cv_error") * PENALTY_PER_MAE, F.lit(0.0))
    score = F.col("delta_pct") * weights.delta - F.col("risk_index") * weights.risk - penalty * weights.mae
    return rows.withColumn("signal_score", score)


def ranked(rows: DataFrame) -> DataFrame:
    """Place of each item in its owner's list under the four orders; missing prices come last."""

    def place(*order: Column) -> Column:
        return F.row_number().over(Window.partitionBy("owner").orderBy(*order, F.asc("symbol")))

    return rows.withColumns(
        {
            "signal_rank": place(F.col("signal_score").desc_nulls_last()),
            "risk_rank": place(F.col("risk_index").asc_nulls_last()),
            "price_rank": place(F.col("close").desc_nulls_last()),
            "symbol_rank": place(),
        }
    )


def sorted_by(rows: DataFrame, order: str = "signal") -> DataFrame:
    """All rows in one order (a distributed sort)."""
    orders = {
        "signal": F.col("signal_score").desc_nulls_last(),
        "risk": F.col("risk_index").asc_nulls_last(),
        "price_desc": F.col("close").desc_nulls_last(),
    }
    return rows.orderBy("symbol") if order == "symbol" else rows.orderBy(orders.get(order, orders["signal"]), "symbol")
