"""Best-fit packing of documents into sequences, certified by lower bounds of dual-feasible functions.

1. Every text becomes token ids and an end id; longer documents are cut into full sequences and one shorter first
   piece. Only digests and lengths of the pieces are kept.
2. Pieces below the full length are dealt into groups of a fixed mean size by a hash of their row number, and each group
   is packed best-fit decreasing on its own.
3. A dual-feasible function f maps sizes to shares so that the shares of any one full sequence add up to at most 1;
   so a group needs at least the sum of its shares, rounded up. The largest such bound over several families of
   functions certifies the group when it equals the number of its sequences.
4. A certified group gives up only its emptiest sequences, whose room makes one sequence (what rounding up costs it);
   a group with a gap gives up all that are not full, in the first rounds. What was given up is dealt anew into fewer
   groups and packed again, until it fits one group.

Groups exchange rows, never sums over all documents: no task holds more than a group, however large the table is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm.bpe import pieces as safe_pieces
from barlake.llm.shared import Scratch, read_table, shuffles_freed
from barlake.llm.vocabularies import json_encoding

VOCABULARY = "byte_bpe_50k.json"
SEQUENCE = 1024
END_ID = 2
# Mean number of pieces in a group, and rounds in which groups with a gap give up all that is not full.
GROUP = 16384
EXCHANGES = 6

_PIECES = "uid bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_ARROW = pa.schema(
    [("uid", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
     ("ids_crc32", pa.int64())]
)
_FIELDS = [f.split()[0] for f in _PIECES.split(", ")]


def document_ids(text: str | None, path: str, end_id: int = END_ID) -> np.ndarray:
    """Ids of a whole text and the end id, as the tokenizers library gives them (special strings are special)."""
    own = json_encoding(path, public_tokenizers.PATTERN)
    parts = [own.encode_to_numpy(p, allowed_special="all") for p in safe_pieces(text or "")]
    return np.concatenate([*parts, [end_id]]).astype("<u4")


def cuts(n: int, sequence: int) -> list[int]:
    """Bounds of the pieces of n ids: full ones at the end, the rest first."""
    first = n % sequence or sequence
    return [0, *range(first, n + 1, sequence)]


def pieces(docs: DataFrame, path: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """A row per piece; ``uid`` numbers the rows of one run, so it is fixed by writing the frame once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 36
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = document_ids(text.as_py(), path, end_id)
                bounds = cuts(len(ids), sequence)
                for piece, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    rows.append((uid, doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                    uid += 1
            if rows:
                columns = zip(zip(*rows, strict=True), _ARROW.types, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], schema=_ARROW)

    return docs.select("doc_id", "text").mapInArrow(run, _PIECES)


@cache
def dual_feasible(sequence: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of each function (rows) for the sizes 0 to ``sequence``, as whole numbers, and what makes a sequence full.

    Three families: sizes rounded to multiples of 1/k with exact ones left alone; sizes above 1 - e count 1 and below e
    nothing; halves and less count one part of the parts of at least e that fit.
    """
    x = np.arange(sequence + 1, dtype=np.int64)
    rows, full = [], []
    for k in range(1, min(100, sequence)):
        exact = (k + 1) * x % sequence == 0
        rows.append(np.where(exact, k * x, sequence * ((k + 1) * x // sequence)))
        full.append(k * sequence)
    for e in range(1, sequence // 2 + 1):
        rows.append(np.where(x > sequence - e, sequence, np.where(x < e, 0, x)))
        full.append(sequence)
        parts = sequence // e
        rows.append(np.where(2 * x > sequence, parts - (sequence - x) // e, (x >= e).astype(np.int64)))
        full.append(parts)
    return np.array(rows), np.array(full, dtype=np.int64)


def lower_bound(sizes: np.ndarray, sequence: int = SEQUENCE) -> int:
    """No packing of these sizes has fewer sequences."""
    values, full = dual_feasible(sequence)
    totals = values @ np.bincount(sizes, minlength=sequence + 1)
    return int((-(-totals // full)).max()) if len(sizes) else 0


def best_fit_decreasing(sizes: np.ndarray, sequence: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of every size, and the room left in each sequence.

    Largest first; each goes where the least room is left that takes it. Open sequences wait in lists by their room,
    and the bits of one number tell which lists are filled.
    """
    waiting: list[list[int]] = [[] for _ in range(sequence + 1)]
    filled, room = 0, []
    where, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = filled >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            own = waiting[left].pop()
            if not waiting[left]:
                filled ^= 1 << left
        else:
            left, own = sequence, len(room)
            room.append(0)
        where[i], offset[i] = own, sequence - left
        left -= size
        room[own] = left
        if left:
            waiting[left].append(own)
            filled |= 1 << left
    return where, offset, np.array(room, dtype=np.int64)


def _packed(round_: int, sequence: int, last: bool):
    """Packs a group; rows of sequences that are given up have no ``sequence_id``."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        # A fixed order, so that a repeated task packs alike.
        table = table.select(_FIELDS).sort_by("uid")
        sizes = table.column("length").to_numpy()
        where, offset, room = best_fit_decreasing(sizes, sequence)
        gap = len(room) - lower_bound(sizes, sequence)
        emptiest = np.argsort(-room, kind="stable")
        emptiest = emptiest[room[emptiest] > 0]
        # With a gap all that is not full; certified, the sequences whose room together makes one.
        enough = 1 + int(np.searchsorted(np.cumsum(room[emptiest]), sequence))
        give_up = len(emptiest) if gap and round_ < EXCHANGES else max(1, min(enough, len(room) // 8))
        give_up = 0 if last else give_up
        kept = ~np.isin(where, emptiest[:give_up])
        ids = (round_ << 56) + (key[0].as_py() << 20) + where
        return table.append_column("sequence_id", pa.array(ids, mask=~kept)).append_column("offset", pa.array(offset))

    return run


def pack(docs: DataFrame, path: str, sequence: int = SEQUENCE, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of every row of ``docs``.

    Null and empty texts are the end id alone. Rows with equal or null ids are documents of their own. Other columns do
    not matter. No rows give no rows. Sequence ids are unique but not dense.
    """
    if not 1 <= group <= 1 << 18:
        raise ValueError("a group has 1 to 262,144 pieces")
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = scratch.table(pieces(docs, path, sequence, end_id), "pieces")
    full = every.where(F.col("length") == sequence)
    done = full.withColumns({"sequence_id": -1 - F.col("uid"), "offset": F.lit(0).cast("bigint")})
    pool = every.where(F.col("length") < sequence)
    schema = f"{_PIECES}, sequence_id bigint, offset bigint"
    with shuffles_freed(spark):
        left, round_ = pool.count(), 0
        while left:
            groups = -(-left // group)
            dealt = pool.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(round_)), F.lit(groups)))
            packed = dealt.groupBy("part").applyInArrow(_packed(round_, sequence, groups == 1), schema)
            packed = scratch.table(packed, f"round-{round_}")
            done = done.unionByName(packed.where("sequence_id IS NOT NULL"))
            pool = packed.where("sequence_id IS NULL").drop("sequence_id", "offset")
            left, round_ = pool.count(), round_ + 1
    return done.drop("uid")


def certificate(packed: DataFrame, sequence: int = SEQUENCE) -> tuple[int, int]:
    """Number of sequences, and the bound that no packing of the same pieces can go below.

    The functions see sizes only, so the counts of the sizes (at most ``sequence`` rows) decide.
    """
    used = packed.select("sequence_id").distinct().count()
    counts = {r.length: r["count"] for r in packed.groupBy("length").count().collect()}
    values, full = dual_feasible(sequence)
    totals = sum(values[:, size].astype(object) * n for size, n in counts.items())
    return used, max((-(-int(t) // int(f)) for t, f in zip(totals, full, strict=True)), default=0) if counts else 0


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


QUERIES = {"op11_best_fit_packing": op11_best_fit_packing}
SQL: dict[str, str] = {}
