"""Tree candidates: one forest or booster per symbol and fit, grown side by side on the executors.

After dedup a symbol has one row per calendar date, so the rows of one fit always fit a task, however many symbols there
are. A work item is (symbol, fit, batch): a forest is cut into batches of trees, as many as it takes to keep all cores
busy; the rounds of a booster are one item. Random draws follow from seed, symbol, fit and tree number alone, so neither
the batches nor a repeated task change a result. Fits 1..5 are the folds, 6 is the final one.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from barlake.learners.growth import Columns, Trees, bootstrap, draws, grow, noise
from barlake.learners.linear import oof_rows
from barlake.operators.features import FEATURES
from barlake.operators.splits import FINAL_FIT, FOLDS

# What runs in tasks travels to the workers as code, so they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Candidate settings.
FOREST_TREES = 500
FOREST_DEPTH = 10
FOREST_LEAF = 3
BOOST_ROUNDS = 100
BOOST_RATE = 0.1
BOOST_DEPTH = 3
SECOND_ORDER_ROUNDS = 600
SECOND_ORDER_RATE = 0.03
SECOND_ORDER_DEPTH = 5
SECOND_ORDER_ROWS = 0.9
SECOND_ORDER_COLUMNS = 0.9
SECOND_ORDER_RIDGE = 1.0
SEED = 42

# Trees of a forest in one work item at least, so that sorting the columns once pays off.
LEAST_BATCH = 10
ITEMS_PER_CORE = 16

MODEL_SCHEMA = (
    "symbol string, model string, fit int, batch int, base double, share double, roots array<int>,"
    " feature array<smallint>, threshold array<double>, left array<int>, value array<double>"
)
_MODEL_ARROW = pa.schema(
    [("symbol", pa.string()), ("model", pa.string()), ("fit", pa.int32()), ("batch", pa.int32()), ("base", pa.float64()),
     ("share", pa.float64()), ("roots", pa.list_(pa.int32())), ("feature", pa.list_(pa.int16())),
     ("threshold", pa.list_(pa.float64())), ("left", pa.list_(pa.int32())), ("value", pa.list_(pa.float64()))]
)
_NODE_FIELDS = ("roots", "feature", "threshold", "left", "value")


@dataclass(frozen=True)
class TreeCandidate:
    """``trees`` numbers of one fit; ``fit(columns, y, seed, numbers)`` returns (base, share of a tree, trees)."""

    name: str
    order: int
    trees: int
    fit: Callable[[Columns, np.ndarray, np.uint64, range], tuple[float, float, Trees]]
    # Whether the trees do not depend on each other, so that they may be grown in batches.
    independent: bool = False


def random_forest(
    trees: int = FOREST_TREES, depth: int = FOREST_DEPTH, order: int = 2, leaf: int = FOREST_LEAF, seed: int = SEED
) -> TreeCandidate:
    """The mean of trees on bootstrap samples; all features compete for every split."""

    def fit(data: Columns, y: np.ndarray, series: np.uint64, numbers: range):
        centre = y.mean()
        grown = []
        for number in numbers:
            weight = bootstrap(noise(seed, int(series), number), len(y)).astype(float)
            grown.append(grow(data, (y - centre) * weight, weight, depth, leaf, rows=weight > 0))
        # Every batch adds its trees' share of the mean, and of the centre.
        return centre * len(numbers) / trees, 1 / trees, Trees.joined(grown)

    return TreeCandidate("random_forest", order, trees, fit, independent=True)


def _boosted(data: Columns, y: np.ndarray, rounds: range, rate: float, one_round) -> tuple[float, float, Trees]:
    """Trees on what the rounds before have left of the target."""
    base = float(y.mean())
    left, grown = y - base, []
    for number in rounds:
        tree = one_round(left, number)
        left = left - rate * tree.each(data.values)[:, 0]
        grown.append(tree)
    return base, rate, Trees.joined(grown)


def gradient_boosting(
    rounds: int = BOOST_ROUNDS, order: int = 3, rate: float = BOOST_RATE, depth: int = BOOST_DEPTH
) -> TreeCandidate:
    """Least-squares boosting: each round fits the residuals of all rows."""

    def fit(data: Columns, y: np.ndarray, series: np.uint64, numbers: range):
        return _boosted(data, y, numbers, rate, lambda left, _: grow(data, left, None, depth))

    return TreeCandidate("gradient_boosting", order, rounds, fit)


def second_order_boosting(
    rounds: int = SECOND_ORDER_ROUNDS, order: int = 4, rate: float = SECOND_ORDER_RATE, depth: int = SECOND_ORDER_DEPTH,
    row_share: float = SECOND_ORDER_ROWS, column_share: float = SECOND_ORDER_COLUMNS, ridge: float = SECOND_ORDER_RIDGE,
    seed: int = SEED,
) -> TreeCandidate:
    """Boosting with gradient and hessian gains, shrunk leaves, and a sample of rows and columns for each tree."""

    def fit(data: Columns, y: np.ndarray, series: np.uint64, numbers: range):
        width = data.order.shape[0]

        def one_round(left: np.ndarray, number: int) -> Trees:
            own = noise(seed, int(series), number)
            rows = draws(own, len(left)) < np.uint64(int(row_share * (2**64 - 1)))
            rows[0] |= not rows.any()
            picked = np.argsort(draws(noise(int(own), 1), width))[: max(1, int(column_share * width))]
            columns = np.zeros(width, bool)
            columns[picked] = True
            return grow(data, left, None, depth, ridge=ridge, rows=rows, columns=columns)

        return _boosted(data, y, numbers, rate, one_round)

    return TreeCandidate("second_order_boosting", order, rounds, fit)


def training_frame(segmented: DataFrame) -> DataFrame:
    """What the fits read, cut from its lineage: it is counted and then sent to the work items of each candidate."""
    return segmented.select("symbol", "date", "segment", "target", *FEATURES).checkpoint()


def _tasks(frame: DataFrame) -> int:
    spark = frame.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def batches_of(candidate: TreeCandidate, items: int, tasks: int) -> int:
    """Into how many batches the trees of one fit are cut when there are ``items`` fits."""
    if not candidate.independent:
        return 1
    wanted = -(-ITEMS_PER_CORE * tasks // max(items, 1))
    return max(1, min(wanted, candidate.trees // LEAST_BATCH))


def _numbers(trees: int, batches: int, batch: int) -> range:
    return range(trees * batch // batches, trees * (batch + 1) // batches)


def _items(frame: DataFrame, fits: list[int], batches: int) -> DataFrame:
    """Rows beside each fit and batch that reads them (for training or as its test block), dealt by work item."""
    wanted = F.filter(F.array(*map(F.lit, fits)), lambda f: f >= F.greatest("segment", F.lit(1)))
    spread = frame.withColumn("fit", F.explode(wanted)).withColumn(
        "batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1)))
    )
    # A number of partitions by name: merged ones would line the items up behind each other.
    return spread.repartition(ITEMS_PER_CORE * _tasks(frame), "symbol", "fit", "batch")


def _matrix(table: pa.Table) -> np.ndarray:
    return np.column_stack([table.column(n).to_numpy().astype(float) for n in FEATURES])


def _fitted(candidate: TreeCandidate, batches: int, key: tuple, table: pa.Table):
    """The item's rows in date order, which of them are for training, and the fit."""
    symbol, fit, batch = (k.as_py() for k in key)
    table = table.sort_by("date")
    train = table.column("segment").to_numpy() < fit
    data = Columns.of(_matrix(table.filter(pa.array(train))))
    y = table.column("target").to_numpy()[train].astype(float)
    series = noise(zlib.crc32(symbol.encode()), fit)
    return table, train, candidate.fit(data, y, series, _numbers(candidate.trees, batches, batch))


def out_of_fold(frame: DataFrame, candidate: TreeCandidate) -> DataFrame:
    """Predictions of the five fold fits on their test blocks."""
    batches = batches_of(candidate, frame.select("symbol").distinct().count() * FOLDS, _tasks(frame))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table, train, (base, share, trees) = _fitted(candidate, batches, key, table)
        tested = table.filter(pa.array(~train))
        part = base + share * trees.total(_matrix(tested))
        kept = tested.select(["symbol", "date", "target", "fit", "batch"])
        return kept.append_column("part", pa.array(part))

    items = _items(frame, list(range(1, FOLDS + 1)), batches)
    parts = items.groupBy("symbol", "fit", "batch").applyInArrow(
        run, "symbol string, date date, target double, fit int, batch int, part double"
    )
    # Batches add up in their order, so the last digits do not depend on the order of arrival.
    ordered = F.array_sort(F.collect_list(F.struct("batch", "part")))
    rows = parts.groupBy("symbol", F.col("fit").alias("fold"), "date").agg(
        F.first("target").alias("target"), F.aggregate(ordered, F.lit(0.0), lambda a, x: a + x["part"]).alias("pred")
    )
    return oof_rows(rows.withColumns({"model": F.lit(candidate.name), "model_order": F.lit(candidate.order)}))


def final_fit(frame: DataFrame, candidate: TreeCandidate) -> DataFrame:
    """Fitted trees of every symbol of the frame as rows of node arrays, one per batch (``MODEL_SCHEMA``)."""
    batches = batches_of(candidate, frame.select("symbol").distinct().count(), _tasks(frame))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, _, (base, share, trees) = _fitted(candidate, batches, key, table)
        row = [key[0].as_py(), candidate.name, FINAL_FIT, key[2].as_py(), base, share]
        row += [getattr(trees, n) for n in _NODE_FIELDS]
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(row, _MODEL_ARROW.types, strict=True)], schema=_MODEL_ARROW)

    items = _items(frame, [FINAL_FIT], batches)
    return items.groupBy("symbol", "fit", "batch").applyInArrow(run, MODEL_SCHEMA)


def predictor(models: pa.Table) -> Callable[[np.ndarray], np.ndarray]:
    """One function of feature rows from all batches of one model."""
    parts = []
    for m in models.sort_by("batch").to_pylist():
        nodes = {n: np.array(m[n], t) for n, t in zip(_NODE_FIELDS, (np.int32, np.int16, float, np.int32, float), strict=True)}
        parts.append((m["base"], m["share"], Trees(**nodes)))
    base = sum(p[0] for p in parts)
    trees = Trees.joined([p[2] for p in parts])
    # A missing feature makes no prediction.
    return lambda x: np.where(np.isfinite(x).all(axis=1), base + parts[0][1] * trees.total(np.nan_to_num(x)), np.nan)


def predict_rows(models: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds ``pred`` to rows that carry the features, each by its symbol's model; null without a model."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]
    names = rows.columns

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        pred = predictor(right)(_matrix(left)) if len(right) else np.full(len(left), np.nan)
        return left.select(names).append_column("pred", pa.array(pred, from_pandas=True))

    grouped = rows.groupBy("symbol").cogroup(models.groupBy("symbol"))
    return grouped.applyInArrow(run, ", ".join([*fields, "pred double"]))

