"""Registered queries: folds, candidates, selection, forecasts, run record.

Queries with a SQL check use the deterministic one-feature candidates; the others fit the real
candidates at their full size.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from barlake.learners import linear, trees
from barlake.operators import calendar, features, forecast as FC, recursion, selection, serving, splits
from barlake.plans import forecasting, given, medallion
from barlake.plans.shape import report
from barlake.session import fresh_folder, work_root
from barlake.sources import tables


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    return medallion.daily_from_raw(given.raw_prices(spark, sf))


def _check(spark: SparkSession, sf: str, job_run_id: object | None = None) -> forecasting.CheckRun:
    return forecasting.CheckRun(_daily(spark, sf), job_run_id)


def _segmented(spark: SparkSession, sf: str) -> DataFrame:
    return forecasting.segmented_rows(_daily(spark, sf))


def c4_enough_history(spark: SparkSession, sf: str) -> DataFrame:
    daily = medallion.daily_from_raw(given.raw_supplier_prices(spark, sf))
    train = features.training_rows(features.feature_matrix(daily))
    return report(features.enough_history(train).select("symbol", "date", "target", "train_rows"))


def c5_flat_guard(spark: SparkSession, sf: str) -> DataFrame:
    return report(FC.flat_check(_check(spark, sf).forecast, 100.0), 4)


def c5_moving_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """A run with a high threshold: what moves less is not in the forecast."""
    run = forecasting.CheckRun(_daily(spark, sf), min_std=100.0)
    return report(run.forecast.select("symbol", "horizon_day", "pred_close"), 4)


def f2_fold_mae(spark: SparkSession, sf: str) -> DataFrame:
    return report(selection.fold_mae(_check(spark, sf).oof), 4)


def f3_cv_mae(spark: SparkSession, sf: str) -> DataFrame:
    return report(selection.cv_mae(selection.fold_mae(_check(spark, sf).oof)), 4)


def f4_residual_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return report(_check(spark, sf).scored, 4)


def f5_dispersion(spark: SparkSession, sf: str) -> DataFrame:
    return report(FC.dispersion(_check(spark, sf).forecast), 4)


def g1_time_folds(spark: SparkSession, sf: str) -> DataFrame:
    return report(_segmented(spark, sf).select("symbol", "date", "pos", "train_rows", "segment"))


def g1_fold_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return report(splits.fold_bounds(_segmented(spark, sf)))


def g2_elastic_net(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of every symbol and fit, one row per feature."""
    fits = linear.elastic_net_fits(_segmented(spark, sf))
    names = F.array(*[F.lit(n) for n in features.FEATURES])
    return report(
        fits.select(
            "symbol", "fit", "train_rows", "intercept", F.inline(F.arrays_zip(names.alias("feature"), F.col("coef").alias("weight")))
        )
    )


def g2_co_moments(spark: SparkSession, sf: str) -> DataFrame:
    """What the elastic net is solved from: means and correlations of features and target per symbol and segment."""
    names = [*features.FEATURES, "target"]
    moments = linear.co_moments(_segmented(spark, sf), "symbol", "segment")
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    places = lambda values: F.array(*map(F.lit, values))
    different = [k for k, (i, j) in enumerate(pairs) if i < j]
    rows = moments.withColumn("k", F.explode(places(different)))
    first, second, own = places([i for i, _ in pairs])[F.col("k")], places([j for _, j in pairs])[F.col("k")], places(
        [pairs.index((i, i)) for i in range(len(names))]
    )
    rows = rows.withColumns({"i": first, "j": second, "own": own})
    spread = F.sqrt(F.col("moment")[F.col("own")[F.col("i")]] * F.col("moment")[F.col("own")[F.col("j")]])
    return report(
        rows.select(
            "symbol", "segment", F.col("n").alias("row_count"), places(names)[F.col("i")].alias("feature_a"),
            places(names)[F.col("j")].alias("feature_b"), F.col("mean")[F.col("i")].alias("mean_a"),
            F.try_divide(F.col("moment")[F.col("k")], spread).alias("correlation"),
        ), 6, mean_a=4,
    )


def g2_check_fits(spark: SparkSession, sf: str) -> DataFrame:
    fits = _check(spark, sf).fits
    slope = F.aggregate("coef", F.lit(0.0), lambda a, x: a + x)
    return report(fits.select("symbol", "model", "fit", "train_rows", slope.alias("slope"), "intercept"), 6, intercept=4)


def _tree_oof(spark: SparkSession, sf: str, candidate: trees.TreeCandidate) -> DataFrame:
    work_root(spark)
    return report(trees.out_of_fold(trees.training_frame(_segmented(spark, sf)), candidate), 4)


def g3_random_forest(spark: SparkSession, sf: str) -> DataFrame:
    return _tree_oof(spark, sf, trees.random_forest())


def g4_gradient_boosting(spark: SparkSession, sf: str) -> DataFrame:
    return _tree_oof(spark, sf, trees.gradient_boosting())


def g5_second_order_boosting(spark: SparkSession, sf: str) -> DataFrame:
    return _tree_oof(spark, sf, trees.second_order_boosting())


def g5_candidate_roster(spark: SparkSession, sf: str) -> DataFrame:
    return forecasting.candidate_roster(_segmented(spark, sf))


def g6_out_of_fold(spark: SparkSession, sf: str) -> DataFrame:
    return report(_check(spark, sf).oof, 4)


def g6_out_of_fold_all(spark: SparkSession, sf: str) -> DataFrame:
    return report(forecasting.FullRun(_daily(spark, sf)).oof, 4)


def g7_model_choice(spark: SparkSession, sf: str) -> DataFrame:
    return report(_check(spark, sf).chosen, 4)


def g8_refit(spark: SparkSession, sf: str) -> DataFrame:
    """The final fit of each symbol's chosen candidate."""
    slope = F.aggregate("coef", F.lit(0.0), lambda a, x: a + x)
    final = _check(spark, sf).final_fits  # one row per symbol
    return report(final.select("symbol", "model", "train_rows", slope.alias("slope"), "intercept"), 6, intercept=4)


def g8_refit_forest(spark: SparkSession, sf: str) -> DataFrame:
    """A forest fitted on all training rows, applied to each symbol's newest bar."""
    work_root(spark)
    matrix = medallion.matrix_from_raw(given.raw_prices(spark, sf)).checkpoint()
    segmented = splits.with_segments(features.enough_history(features.training_rows(matrix)))
    models = trees.final_fit(trees.training_frame(segmented), trees.random_forest())
    scored = trees.predict_rows(models, features.scoring_rows(matrix))
    return report(scored.select("symbol", "date", "adj_close", "pred"), 4)


def g9_band(spark: SparkSession, sf: str) -> DataFrame:
    done = _check(spark, sf)
    bounds = selection.band(F.col("pred"), F.col("q_low"), F.col("q_high"))
    rows = done.oof.join(done.chosen.select("symbol", "model", "q_low", "q_high"), ["symbol", "model"])
    return report(rows.select("symbol", "date", *[c.alias(n) for n, c in bounds.items()]), 4)


def g10_recursive_path(spark: SparkSession, sf: str) -> DataFrame:
    done = _check(spark, sf)
    rows = done.forecast.select("symbol", "model_name", "horizon_day", "pred_close")
    return report(rows, 4)


def g10_recursive_elastic_net(spark: SparkSession, sf: str) -> DataFrame:
    daily = medallion.daily_from_raw(given.raw_supplier_prices(spark, sf))
    fits = linear.elastic_net_fits(forecasting.segmented_rows(daily)).filter(F.col("fit") == splits.FINAL_FIT)
    states = recursion.start_states(daily, calendar.holidays_around(calendar.last_bars(daily), "last_date"))
    return report(recursion.path_rows(recursion.linear_paths(states, fits)), 4)


def g10_recursive_all(spark: SparkSession, sf: str) -> DataFrame:
    """Choice among all real candidates per symbol and the winner's path."""
    daily = _daily(spark, sf)
    return report(forecasting.FullRun(daily).forecast, 4)


def g11_sessions(spark: SparkSession, sf: str) -> DataFrame:
    daily = medallion.daily_from_raw(given.raw_supplier_prices(spark, sf))
    last = calendar.last_bars(daily)
    return report(calendar.sessions_after(last, calendar.holidays_around(last, "last_date")))


def g12_forecast_rows(spark: SparkSession, sf: str) -> DataFrame:
    return report(_check(spark, sf).forecast, 4)


def g13_metrics_rows(spark: SparkSession, sf: str) -> DataFrame:
    return report(_check(spark, sf).metrics, 4)


def g14_experiment_record(spark: SparkSession, sf: str) -> DataFrame:
    return report(_check(spark, sf).record, 4)


def g15_run_id(spark: SparkSession, sf: str) -> DataFrame:
    """The same metrics from a run by hand and from a scheduled one."""
    rows = None
    for job_run_id in (None, 90125):
        part = _check(spark, sf, job_run_id).metrics.select("symbol", "selected_model", "pipeline_run_id")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def h5_publish_latest(spark: SparkSession, sf: str) -> DataFrame:
    done = _check(spark, sf)
    return report(serving.latest_from_forecast(done.forecast, given.PUBLISHED), 4)


def h5_publish_history(spark: SparkSession, sf: str) -> DataFrame:
    return report(serving.history_from_forecast(_check(spark, sf).forecast, given.PUBLISHED), 4)


def h5_publish_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return report(serving.metrics_from_run(_check(spark, sf).metrics, given.PUBLISHED), 4)


def _published(spark: SparkSession, sf: str) -> str:
    """Namespace of a run that was published twice under one time."""
    namespace = f"barlake_{uuid.uuid4().hex[:12]}"
    tables.create_namespace(spark, namespace, fresh_folder(spark, "tables"))
    done = _check(spark, sf)
    work_root(spark)
    forecast, metrics = done.forecast.checkpoint(), done.metrics.checkpoint()
    for _ in range(2):
        serving.publish(forecast, metrics, namespace, given.PUBLISHED)
    return namespace


def h5_published_history(spark: SparkSession, sf: str) -> DataFrame:
    return report(spark.table(f"{_published(spark, sf)}.forecast_history"), 4)


def h5_published_latest(spark: SparkSession, sf: str) -> DataFrame:
    return report(spark.table(f"{_published(spark, sf)}.forecast_latest"), 4)


def h5_published_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return report(spark.table(f"{_published(spark, sf)}.forecast_metrics"), 4)
