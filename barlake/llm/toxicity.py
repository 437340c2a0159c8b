"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text."""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard as zstd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm.shared import read_table, text_blocks

# Bounds of the training sample: rows of each class, and windows of a text that may be in it.
SAMPLE_ROWS = 4000
SAMPLE_WINDOWS = 2048
DICTIONARY_BYTES = 8192
# A window is a word (at most this many bytes of it) between blanks; the padding lets its last bytes match.
WINDOW_BYTES = 32
PAD = b" " + bytes(10)
GAINS = (1, 2, 3, 4, 6)
THRESHOLD = 0.3
MEMO = 400_000

# Letters, digits and bytes of other characters make words; A-Z are folded.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_SETTINGS = dict(
    window_log=14, chain_log=14, hash_log=14, search_log=5, min_match=4, target_length=32,
    strategy=zstd.STRATEGY_LAZY2, write_dict_id=0, write_checksum=0, write_content_size=0,
)


def _words(folded: bytes) -> list[bytes]:
    out = []
    for word in folded.split():
        out += [word] if len(word) <= WINDOW_BYTES else [
            word[i : i + WINDOW_BYTES] for i in range(0, len(word), WINDOW_BYTES)
        ]
    return out


@dataclass(frozen=True)
class Settings:
    """Toxic windows are those with a string of ``gram`` bytes (a shorter word as a whole) that at least ``min_texts``
    toxic training texts hold and that is ``min_lift`` (natural logarithm) likelier in toxic texts.

    The defaults are what ``cross_validated`` prefers on rows outside the held-out fold.
    """

    gram: int = 9
    min_texts: int = 3
    min_lift: float = 3.0


GRID = tuple(Settings(g, n, x) for g in (7, 9, 11) for n in (2, 3, 5) for x in (2.0, 3.0, 4.0))
CROSS_FOLDS = 3


@dataclass(frozen=True)
class Sampled:
    """Windows of one labelled text in their order, and how many it has in all."""

    windows: tuple[bytes, ...]
    total: int


def sampled(text: str | None, bound: int = SAMPLE_WINDOWS) -> Sampled:
    """At most ``bound`` windows of the whole text, drawn alike from all of it; which ones follows from the text."""
    raw = (text or "").encode().translate(_FOLD)
    rng = np.random.default_rng(zlib.crc32(raw))
    kept: list[tuple[float, int, bytes]] = []
    total = 0
    for block in text_blocks(raw):
        for word in _words(block):
            total += 1
            mark = rng.random()
            if len(kept) < bound:
                heapq.heappush(kept, (-mark, total, word))
            elif -mark > kept[0][0]:
                heapq.heapreplace(kept, (-mark, total, word))
    return Sampled(tuple(word for _, _, word in sorted(kept, key=lambda k: k[1])), total)


def _grams(word: bytes, gram: int) -> set[bytes]:
    padded = b" " + word + b" "
    size = min(gram, len(padded))
    return {padded[i : i + size] for i in range(len(padded) - size + 1)}


def _dictionary(samples: list[bytes], segment: int) -> bytes:
    """A trained dictionary; of too few samples zstandard trains none, then their last bytes are the dictionary."""
    try:
        return zstd.train_dictionary(DICTIONARY_BYTES, samples, k=segment, d=6, level=19).as_bytes()
    except (zstd.ZstdError, ValueError):
        return (bytes(8) + b"".join(samples))[-DICTIONARY_BYTES:]


def _compressor(content: bytes) -> zstd.ZstdCompressor:
    settings = zstd.ZstdCompressionParameters(**_SETTINGS)
    trained = zstd.ZstdCompressionDict(content)
    trained.precompute_compress(compression_params=settings)
    return zstd.ZstdCompressor(dict_data=trained, compression_params=settings)


@dataclass(frozen=True)
class Model:
    """Two dictionaries and a calibrated score; without both classes the score is the share of toxic labels."""

    prior: float
    toxic: bytes = b""
    ordinary: bytes = b""
    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()

    def scorer(self):
        if not self.weights:
            flat = lambda text: self.prior
            flat.of_sample = flat
            return flat
        toxic, ordinary = _compressor(self.toxic), _compressor(self.ordinary)
        mean, scale, weights = np.array(self.mean), np.array(self.scale), np.array(self.weights)
        memo: dict[bytes, int] = {}

        def counted(counts: Counter, share: float = 1.0) -> np.ndarray:
            """Features of a text of which ``counts`` are the given share."""
            if len(memo) > MEMO:
                memo.clear()
            gains = []
            for word in counts:
                gain = memo.get(word)
                if gain is None:
                    window = b" " + word + PAD
                    gain = memo[word] = len(ordinary.compress(window)) - len(toxic.compress(window))
                gains.append(gain)
            gains, n = np.array(gains, dtype=np.int64), np.array(list(counts.values()), dtype=np.int64)
            hits = np.array([n[gains >= g].sum() for g in GAINS], dtype=float)
            return np.concatenate([np.log1p(hits / share), hits / max(int(n.sum()), 1)])

        def of_sample(sample: Sampled) -> np.ndarray:
            return counted(Counter(sample.windows), len(sample.windows) / max(sample.total, 1) or 1.0)

        def calibrated(features: np.ndarray) -> float:
            z = weights[0] + weights[1:] @ ((features - mean) / scale)
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        def score(text) -> float:
            counts: Counter = Counter()
            for block in text_blocks((text or "").encode().translate(_FOLD)):
                counts.update(_words(block))
            return calibrated(counted(counts))

        score.features = of_sample
        score.of_sample = lambda sample: calibrated(of_sample(sample))
        return score


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 50) -> np.ndarray:
    a, b = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        w = p * (1 - p) + 1e-6
        b += np.linalg.solve((a * w[:, None]).T @ a + ridge * np.eye(len(b)), a.T @ (y - p) - ridge * b)
    return b


def train(toxic: list[Sampled], ordinary: list[Sampled], prior: float, settings: Settings = Settings()) -> Model:
    """Half of each class trains the dictionaries, the other half calibrates the score."""
    if len(toxic) < 2 or len(ordinary) < 2:
        return Model(prior)
    first = [[t.windows for t in side[::2]] for side in (toxic, ordinary)]
    grams = lambda word: _grams(word, settings.gram)
    seen = [Counter(g for words in side for g in {g for w in set(words) for g in grams(w)}) for side in first]
    lift = {
        g: math.log((n + 0.5) / (len(first[0]) + 1)) - math.log((seen[1][g] + 0.5) / (len(first[1]) + 1))
        for g, n in seen[0].items()
        if n >= settings.min_texts
    }
    lifted = [[w for w in words if any(lift.get(g, 0.0) >= settings.min_lift for g in grams(w))] for words in first[0]]
    join = lambda sides: [b" " + b" ".join(words) + b" " for words in sides if words]
    model = Model(prior, _dictionary(join(lifted), 24), _dictionary(join(first[1]), 24), (0,), (1,), (0, 0))
    features = model.scorer().features
    x = np.array([features(t) for side in (toxic, ordinary) for t in side[1::2]])
    y = np.repeat([1.0, 0.0], [len(toxic[1::2]), len(ordinary[1::2])])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    weights = _logistic((x - mean) / scale, y)
    logit = lambda p: math.log(p / (1 - p))
    weights[0] += logit(min(max(prior, 1e-6), 1 - 1e-6)) - logit(y.mean())
    return Model(prior, model.toxic, model.ordinary, tuple(mean), tuple(scale), tuple(weights))


def _fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[Sampled], list[Sampled], float]:
    """Toxic and ordinary texts outside the held-out fold (crc32 of the id as text, modulo 4, is 2), and the toxic share.

    At most ``SAMPLE_ROWS`` rows of each class, in the order of a hash of the id; of a text of any length at most
    ``SAMPLE_WINDOWS`` windows, drawn on the executors. Rows with a null id, label or text are left out.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(_fold(F.col("doc_id")) != 2)
    known = known.select("doc_id", "toxic").distinct()
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    # Twice the bound, as some labels have no text here.
    order = F.xxhash64("doc_id")
    chosen = [known.where(F.col("toxic") == c).orderBy(order, "doc_id").limit(2 * SAMPLE_ROWS) for c in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))
    texts = docs.select("doc_id", "text").where("text IS NOT NULL").join(ids, "doc_id")
    drawn = texts.select("doc_id", "toxic", _drawn(F.col("text")).alias("sample")).select("doc_id", "toxic", "sample.*")

    def rows(toxic: int) -> list[Sampled]:
        found = drawn.where(F.col("toxic") == toxic).orderBy(order, "windows", "total").limit(SAMPLE_ROWS).collect()
        return [Sampled(tuple(bytes(r["windows"]).split()), r["total"]) for r in found]

    return rows(1), rows(0), prior


def _drawn(text: Column) -> Column:
    @F.pandas_udf("windows binary, total bigint")
    def run(texts: pd.Series) -> pd.DataFrame:
        samples = [sampled(t) for t in texts]
        columns = {"windows": [b" ".join(s.windows) for s in samples], "total": [s.total for s in samples]}
        return pd.DataFrame(columns)

    return run(text)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from ``training_sample``."""
    return train(*training_sample(docs, labels))


def cross_validated(
    spark: SparkSession, toxic: list[Sampled], ordinary: list[Sampled], prior: float, grid: tuple[Settings, ...] = GRID
) -> list[tuple[float, Settings]]:
    """Settings with their mean loss over folds of the training sample, best first; a task per setting and fold.

    The loss is the negative logarithm of what the score gives the label, classes weighted to the toxic share.
    """

    def loss(side: list[Sampled], label: int, score) -> float:
        likely = [score(t) if label else 1 - score(t) for t in side]
        return float(np.mean([-math.log(max(p, 1e-9)) for p in likely])) if likely else 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            losses = []
            for at, fold in zip(batch["setting"], batch["fold"], strict=True):
                kept = [[t for i, t in enumerate(side) if i % CROSS_FOLDS != fold] for side in (toxic, ordinary)]
                score = train(*kept, prior, grid[at]).scorer().of_sample
                left = [loss(side[fold::CROSS_FOLDS], label, score) for side, label in ((toxic, 1), (ordinary, 0))]
                losses.append(prior * left[0] + (1 - prior) * left[1])
            yield pd.DataFrame({"setting": batch["setting"], "loss": losses})

    work = [(at, fold) for at in range(len(grid)) for fold in range(CROSS_FOLDS)]
    tasks = spark.createDataFrame(work, "setting int, fold int").repartition(len(work), "setting", "fold")
    found = tasks.mapInPandas(run, "setting int, loss double").groupBy("setting").agg(F.avg("loss").alias("loss"))
    return sorted(((r["loss"], grid[r["setting"]]) for r in found.collect()), key=lambda x: x[0])


def toxicity(text: Column, model: Model) -> Column:
    """Score of 0 to 1 of every whole text; null counts as empty."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = model.scorer()
        for batch in batches:
            yield pd.Series([score(t) for t in batch], dtype="float64")

    return run(text)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row, repeated rows and null ids (not held out) included."""
    rows = docs.select("doc_id", toxicity(F.col("text"), model).alias("score"))
    return rows.select(
        "doc_id",
        F.coalesce(_fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs`` with a score below the threshold, all columns as they are."""
    return docs.where(toxicity(F.col("text"), model) < THRESHOLD)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, read_table(spark, sf_dir, "labels")))


QUERIES = {"op5_toxicity": op5_toxicity}
SQL: dict[str, str] = {}
