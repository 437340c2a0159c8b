"""Exact top-k inner products in three phases with a uniform threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlake.llm.shared import Scratch, read_table

K = 20
SCALE = 64
QUERY_STEP = 20
# Rows of a block of vectors and of a block of queries, and dimensions of one score list.
VECTOR_BLOCK = 8192
QUERY_BLOCK = 512
LIST_DIMS = 16

_BLOCK = "block bigint, dims int, ids binary, values binary"
# Below these sizes sums of integer products are exact in single and in double precision.
_SINGLE = 1 << 24
_DOUBLE = 1 << 53
# The cutoff of a query with fewer than k candidates: every entry is sufficient.
_OPEN = np.iinfo(np.int64).min


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, v``: components as floor(64 * x), x as double; vectors with null or non-finite ones take no part."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    whole = F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf")))
    )
    return vectors.where(whole & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(x, lambda e: F.floor(e * SCALE)).alias("v")
    )


def blocks(vectors: DataFrame, size: int, scratch: Scratch, name: str) -> DataFrame:
    """Packed blocks of at most ``size`` vectors of one length, written once so that their numbers hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        held: dict[int, list] = {}

        def flush(dims):
            nonlocal block
            ids, values = zip(*held.pop(dims), strict=True)
            row = [[block], [dims], [np.concatenate(ids).tobytes()], [np.concatenate(values).tobytes()]]
            block += 1
            types = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(row, types, strict=True)], names=["block", "dims", "ids", "values"]
            )

        for batch in batches:
            ids, lists = batch.column("vec_id").to_numpy(), batch.column("v")
            ends = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy().astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(ends)])
            for dims in np.unique(ends).tolist():
                rows = np.flatnonzero(ends == dims)
                for at in range(0, len(rows), size):
                    own = rows[at : at + size]
                    if sum(len(i) for i, _ in held.get(dims, [])) + len(own) > size:
                        yield flush(dims)
                    values = flat[starts[own][:, None] + np.arange(dims)] if dims else np.empty((len(own), 0), np.int64)
                    held.setdefault(dims, []).append((ids[own], values.ravel()))
        for dims in list(held):
            yield flush(dims)

    return scratch.table(vectors.mapInArrow(run, _BLOCK), name)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products, in the narrowest type in which no sum can leave the exact range."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    kind = np.float32 if top < _SINGLE else np.float64 if top < _DOUBLE else np.int64
    return a.astype(kind) @ b.astype(kind).T


def _exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _product(a, b).astype(np.int64)


def sufficient(q: np.ndarray, v: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Phase 2: the candidates (vectors by query) that entries at or above the uniform threshold leave open.

    The threshold is cutoff / lists, rounded down. Of each list only entries that reach it count; any other entry is at
    most one less than the threshold, and without a sufficient entry the sum of these stays below the cutoff. A vector
    whose sufficient entries and these bounds cannot reach the cutoff is out. No whole score is worked out here.
    """
    starts = range(0, max(q.shape[1], 1), LIST_DIMS)
    wide = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(q.shape[1], 1) >= _DOUBLE
    open_ = cut == _OPEN
    below = np.where(open_, 0, cut) // len(starts) - 1
    bound = np.zeros((len(q), len(v)), np.int64 if wide else np.float64)
    for at in starts:
        part = _product(q[:, at : at + LIST_DIMS], v[:, at : at + LIST_DIMS])
        # Entries lie strictly inside the exact range of their type, so cutting the bound to it changes nothing.
        limit = {"f4": _SINGLE, "f8": _DOUBLE}.get(part.dtype.str[1:])
        floor = below if limit is None else below.clip(-limit, limit).astype(part.dtype)
        bound += np.maximum(part, floor[:, None]).astype(bound.dtype, copy=False)
    return (bound >= np.where(open_, 0, cut)[:, None]) | open_[:, None]


def _matrix(row: dict, prefix: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{prefix}ids"], np.int64)
    return ids, np.frombuffer(row[f"{prefix}values"], np.int64).reshape(len(ids), row["dims"])


def _order(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k best, by score descending and id ascending."""
    if len(scores) > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}


def _hit_batch(query: list, vector: list, score: list) -> pa.RecordBatch:
    columns = [np.concatenate(c) if c else np.empty(0, np.int64) for c in (query, vector, score)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])


def _lists(k: int):
    """Phase 1: of each score list (16 dimensions) of a block the best k + 1, with their whole scores, the best k of them."""

    def run(batches):
        for row in _pairs(batches):
            qid, q = _matrix(row, "q_")
            vid, v = _matrix(row, "")
            seen = np.zeros((len(qid), len(vid)), bool)
            take = min(k + 1, len(vid))
            for at in range(0, max(row["dims"], 1), LIST_DIMS):
                part = _product(q[:, at : at + LIST_DIMS], v[:, at : at + LIST_DIMS])
                best = np.argpartition(part, len(vid) - take, axis=1)[:, len(vid) - take :]
                np.put_along_axis(seen, best, True, axis=1)
            out = [], [], []
            for i in range(len(qid)):
                own = np.flatnonzero(seen[i] & (vid != qid[i]))
                scores = _exact_product(q[i : i + 1], v[own])[0]
                best = _order(scores, vid[own], k)
                out[0].append(np.full(len(best), qid[i]))
                out[1].append(vid[own][best])
                out[2].append(scores[best])
            yield _hit_batch(*out)

    return run


def _resolved(k: int):
    """Phases 2 and 3: whole scores of the candidates that ``sufficient`` leaves, and of no others."""

    def run(batches):
        for row in _pairs(batches):
            qid, q = _matrix(row, "q_")
            vid, v = _matrix(row, "")
            known = {c["query_id"]: c["cutoff"] for c in row["cutoffs"] or []}
            cut = np.array([known.get(i, _OPEN) for i in qid.tolist()], dtype=np.int64)
            candidates = sufficient(q, v, cut)
            out = [], [], []
            for i in range(len(qid)):
                own = np.flatnonzero(candidates[i] & (vid != qid[i]))
                scores = _exact_product(q[i : i + 1], v[own])[0]
                best = _order(scores, vid[own], k)
                out[0].append(np.full(len(best), qid[i]))
                out[1].append(vid[own][best])
                out[2].append(scores[best])
            yield _hit_batch(*out)

    return run


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k largest integer inner products; ties to the smaller vec_id.

    Both frames have ``vec_id, embedding``; a query is not compared with rows of its own id. Vectors of other lengths
    than the query's, with a null id, or null or non-finite components take no part. Repeated rows are compared once
    each among the vectors and once as a query; of query rows with one id and different vectors the smallest vector (in the
    order of arrays) asks. Other columns do not matter. Fewer than k candidates give them all; no rows give no rows.

    Every pair of a block of queries and a block of vectors of the same length is one row, joined on the pair, so work
    spreads over pairs. A pair keeps at most k entries of a query, enough for the exact result even if all scores tie.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = integer_vectors(vectors).repartition(F.xxhash64("vec_id", "v") % F.lit(1 << 20))
    own = blocks(whole, VECTOR_BLOCK, scratch, "vectors")
    asked = integer_vectors(queries).groupBy("vec_id").agg(F.min("v").alias("v")).coalesce(max(1, parallel // 4))
    asked = blocks(asked, QUERY_BLOCK, scratch, "queries")
    names = {"block": "q_block", "ids": "q_ids", "values": "q_values"}
    asked = asked.withColumnsRenamed(names)
    keys = scratch.table(own.select("block", "dims").join(asked.select("q_block", "dims"), "dims").drop("dims"), "pairs")
    own = own.join(keys, "block")

    def paired(questions: DataFrame) -> DataFrame:
        asking = questions.join(keys, "q_block").drop("dims")
        return own.join(asking, ["block", "q_block"]).drop("block", "q_block")

    hits = "query_id bigint, vec_id bigint, score bigint"
    found = _ranked(paired(asked).mapInArrow(_lists(k), hits), k)
    kth = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("cutoff"))
    ids = asked.select("q_block", F.explode(_ids(F.col("q_ids"))).alias("query_id"))
    cutoffs = ids.join(kth, "query_id").groupBy("q_block").agg(
        F.collect_list(F.struct("query_id", "cutoff")).alias("cutoffs")
    )
    asked = scratch.table(asked.join(cutoffs, "q_block", "left"), "cutoffs")
    return _ranked(paired(asked).mapInArrow(_resolved(k), hits), k).select("query_id", "rank", "vec_id", "score")


def _ids(packed):
    """Longs of a packed block."""

    @F.pandas_udf("array<bigint>")
    def run(column):
        return column.map(lambda b: np.frombuffer(b, np.int64))

    return run(packed)


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % QUERY_STEP == 0))


SQL = {
    "op4_exact_top_k": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
),
ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
}
QUERIES = {"op4_exact_top_k": op4_exact_top_k}
