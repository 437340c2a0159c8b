"""The forecast job: daily bars of all symbols to forecast, metrics and run record."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from barlake.learners import linear, trees
from barlake.operators import calendar, features, forecast as FC, quality, recursion, selection, splits
from barlake.session import work_root

# The deterministic candidates of the SQL checks: one feature each.
CHECK_CANDIDATES = {"ols_lag_1": "lag_close_1", "ols_mean_5": "roll_mean_5"}


def segmented_rows(daily: DataFrame, min_rows: int = features.MIN_TRAIN_ROWS) -> DataFrame:
    """Training rows of every symbol with enough history, cut into segments."""
    train = features.training_rows(features.feature_matrix(daily))
    return splits.with_segments(features.enough_history(train, min_rows))


def excluded_series(daily: DataFrame, min_rows: int = features.MIN_TRAIN_ROWS) -> DataFrame:
    """(symbol, reason) of every symbol whose series cannot be trained on."""
    matrix = features.feature_matrix(daily)
    broken = [(reason, F.max(F.coalesce(condition, F.lit(False)))) for reason, condition in quality.series_reasons()]
    broken.append(("insufficient_history", F.count_if(features.is_training_row()) < min_rows))
    reason = F.coalesce(*[F.when(condition, F.lit(name)) for name, condition in broken])
    return matrix.groupBy("symbol").agg(reason.alias("reason")).filter(F.col("reason").isNotNull())


def sizes(segmented: DataFrame) -> DataFrame:
    return segmented.groupBy("symbol").agg(F.count(F.lit(1)).alias("train_rows"))


class CheckRun:
    """The forecast job with the deterministic candidates: lazy frames, no action.

    Everything after the feature shuffle stays partitioned by symbol. Unusable series are not trained on and paths
    that do not move are not in the forecast; ``excluded`` names both.
    """

    def __init__(
        self,
        daily: DataFrame,
        job_run_id: object | None = None,
        horizon: int = calendar.HORIZON,
        min_std: float = FC.MIN_STD,
    ) -> None:
        self.offered = daily
        self.run_id = FC.resolve_run_id(job_run_id)
        self.horizon = horizon
        self.min_std = min_std

    @cached_property
    def daily(self) -> DataFrame:
        return quality.usable_rows(features.with_adjusted(self.offered))

    @cached_property
    def segmented(self) -> DataFrame:
        return segmented_rows(self.daily)

    @cached_property
    def fits(self) -> DataFrame:
        return linear.single_feature_fits(self.segmented, CHECK_CANDIDATES)

    @cached_property
    def packed(self) -> DataFrame:
        return linear.packed_fits(self.fits)

    @cached_property
    def oof(self) -> DataFrame:
        return linear.out_of_fold(self.segmented, self.packed)

    @cached_property
    def scored(self) -> DataFrame:
        return selection.residual_bounds(self.oof)

    @cached_property
    def chosen(self) -> DataFrame:
        return selection.choose_model(self.scored)

    @cached_property
    def states(self) -> DataFrame:
        closed = calendar.holidays_around(calendar.last_bars(self.daily), "last_date")
        return recursion.start_states(self.daily, closed, self.horizon)

    @cached_property
    def final_fits(self) -> DataFrame:
        return linear.chosen_final_fits(self.packed, self.chosen)

    @cached_property
    def walked(self) -> DataFrame:
        """The paths of all chosen models."""
        return recursion.linear_paths(self.states, self.final_fits)

    @cached_property
    def paths(self) -> DataFrame:
        return self.walked.filter(FC.path_reason(self.min_std).isNull())

    @cached_property
    def excluded(self) -> DataFrame:
        """(symbol, reason): symbols without a published forecast."""
        unmoved = self.walked.select("symbol", FC.path_reason(self.min_std).alias("reason")).filter("reason IS NOT NULL")
        return excluded_series(self.offered).unionByName(unmoved)

    @cached_property
    def forecast(self) -> DataFrame:
        return FC.forecast_rows(self.paths, self.run_id)

    @cached_property
    def metrics(self) -> DataFrame:
        return FC.metrics_rows(self.paths, self.run_id)

    @cached_property
    def record(self) -> DataFrame:
        return FC.experiment_record(self.scored, self.paths, self.run_id, self.horizon, self.min_std)


def default_trees() -> list[trees.TreeCandidate]:
    return [trees.random_forest(), trees.gradient_boosting(), trees.second_order_boosting()]


class FullRun(CheckRun):
    """Elastic net and tree candidates per symbol; frames used by many fits are checkpointed."""

    def __init__(
        self,
        daily: DataFrame,
        candidates: Sequence[trees.TreeCandidate] | None = None,
        job_run_id: object | None = None,
        horizon: int = calendar.HORIZON,
        min_std: float = FC.MIN_STD,
    ) -> None:
        super().__init__(daily, job_run_id, horizon, min_std)
        work_root(daily.sparkSession)
        self.candidates = default_trees() if candidates is None else list(candidates)

    @cached_property
    def daily(self) -> DataFrame:
        """Read by the segments and by the states, so the log is cleaned once."""
        return quality.usable_rows(features.with_adjusted(self.offered)).checkpoint()

    @cached_property
    def segmented(self) -> DataFrame:
        return segmented_rows(self.daily).checkpoint()

    @cached_property
    def fits(self) -> DataFrame:
        return linear.elastic_net_fits(self.segmented).checkpoint()

    @cached_property
    def frame(self) -> DataFrame:
        return trees.training_frame(self.segmented)

    @cached_property
    def oof(self) -> DataFrame:
        rows = linear.out_of_fold(self.segmented, self.packed)
        for candidate in self.candidates:
            rows = rows.unionByName(trees.out_of_fold(self.frame, candidate))
        return rows.checkpoint()

    @cached_property
    def chosen(self) -> DataFrame:
        return selection.choose_model(self.scored).checkpoint()

    @cached_property
    def walked(self) -> DataFrame:
        start = self.states.checkpoint()
        parts = [recursion.linear_paths(start, self.final_fits)]
        # At most one name per candidate comes back.
        winners = {r.model for r in self.chosen.select("model").distinct().collect()}
        picked = self.chosen.join(sizes(self.segmented), "symbol")
        for candidate in self.candidates:
            if candidate.name in winners:
                won = picked.filter(F.col("model") == candidate.name).drop("model")
                models = trees.final_fit(self.frame.join(won.select("symbol"), "symbol", "left_semi"), candidate)
                parts.append(recursion.tree_paths(start.join(won, "symbol"), models, candidate.name))
        return recursion.all_paths(parts).checkpoint()


def candidate_roster(segmented: DataFrame, candidates: Sequence[trees.TreeCandidate] | None = None) -> DataFrame:
    """Which candidates are fitted per symbol, how often and on how many rows in the end."""
    made = default_trees() if candidates is None else candidates
    listed = F.array(
        *[F.struct(F.lit(n).alias("model"), F.lit(i).alias("model_order"))
          for n, i in [("elastic_net", 1), *[(c.name, c.order) for c in made]]]
    )
    rows = sizes(segmented).select("symbol", "train_rows", F.inline(listed))
    return rows.withColumn("fit_count", F.lit(splits.FINAL_FIT))
