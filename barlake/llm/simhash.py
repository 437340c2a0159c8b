"""SimHash near-duplicates: segment-popcount embedding, grid range join, exact check, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm.components import components
from barlake.llm.shared import ASCII_LOWER, Scratch, binary_list, free_name, read_table, slices, text_blocks

MAX_BITS = 3
SHINGLE = 3
SEED = 42
# Cells up to this size are compared by lag; larger ones by a search that drops what it has reached.
LAG_CELL = 48

_EVEN = 0x55555555


def _bit_counts(shingles: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8", count=len(shingles))
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes | None) -> int:
    """Signed 64-bit SimHash of a text's 3-word shingles; 0 for a text without words."""
    if not text:
        return 0
    counts, total, carry = np.zeros(64, np.int64), 0, []
    for block in text_blocks(text.translate(ASCII_LOWER)):
        words = carry + block.split()
        if len(words) >= SHINGLE:
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words])
            starts = np.concatenate([[0], ends[:-1]])
            spans = zip(starts[: 1 - SHINGLE].tolist(), (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)
            shingles = [joined[a:b] for a, b in spans]
            counts += _bit_counts(shingles)
            total += len(shingles)
        carry = words[1 - SHINGLE :]
    if not total:
        if not carry:
            return 0
        counts, total = _bit_counts([b" ".join(carry)]), 1
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """The given columns without the text, and ``fp``; null texts count as empty."""
    kept = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                fps = pa.array([fingerprint(t) for t in binary_list(part.column(text))], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [fps], names=[*kept, "fp"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text)
    return docs.mapInArrow(run, f"{fields}, fp bigint")


def grid_cells(fps: DataFrame) -> DataFrame:
    """Home cell and upper neighbour cells of every fingerprint, for both halves.

    A half of 32 bits is embedded as the popcounts (0, 1, 2) of its 16 two-bit segments, held in two bits each. The
    Manhattan distance of two embeddings is at most the Hamming distance of the halves. Fingerprints that differ in 3
    bits or fewer differ in at most one bit in one of the halves, so their embeddings there are equal or one step
    apart in one segment: the lower of the two reaches the other's home by a step up.
    """
    halves = []
    for half in (0, 1):
        bits = F.shiftrightunsigned("fp", 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
        at = bits.bitwiseAND(F.lit(_EVEN)) + F.shiftright(bits, 1).bitwiseAND(F.lit(_EVEN))
        home = F.struct((at + F.lit(half << 32)).alias("cell"), F.lit(True).alias("home"))
        steps = [
            F.when(
                F.shiftright(at, 2 * s).bitwiseAND(F.lit(3)) < 2,
                F.struct((at + F.lit((1 << (2 * s)) + (half << 32))).alias("cell"), F.lit(False).alias("home")),
            )
            for s in range(16)
        ]
        halves += [home, *steps]
    cells = F.array_compact(F.array(*halves))
    return fps.select("fp", F.explode(cells).alias("c")).select("c.cell", "fp", "c.home")


def _spanning(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within a cell: what a search has reached is not looked at again."""
    rest = fps
    left, right = [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            node = queue.pop()
            near = np.bitwise_count(rest ^ node) <= MAX_BITS
            if near.any():
                found = rest[near]
                left.append(np.full(len(found), node, dtype=np.uint64))
                right.append(found)
                queue.extend(found)
                rest = rest[~near]
    if not left:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(left), np.concatenate(right)


def _links(cell: np.ndarray, fp: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exactly checked links between members of the same cell; rows are ordered by cell."""
    change = np.flatnonzero(np.diff(cell)) + 1
    starts = np.concatenate([[0], change])
    sizes = np.diff(np.concatenate([starts, [len(cell)]]))
    left, right = [], []
    for start, size in zip(starts[sizes > LAG_CELL], sizes[sizes > LAG_CELL], strict=True):
        a, b = _spanning(np.unique(fp[start : start + size]))
        left.append(a)
        right.append(b)
    rows = np.repeat((sizes > 1) & (sizes <= LAG_CELL), sizes)
    cell, fp, home = cell[rows], fp[rows], home[rows]
    for lag in range(1, LAG_CELL):
        if len(cell) <= lag:
            break
        same = cell[lag:] == cell[:-lag]
        if not same.any():
            break
        at = np.flatnonzero(same & (home[lag:] | home[:-lag]))
        a, b = fp[at], fp[at + lag]
        near = (np.bitwise_count(a ^ b) <= MAX_BITS) & (a != b)
        left.append(a[near])
        right.append(b[near])
    if not left:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(left), np.concatenate(right)


def _cell_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links per cell from rows ordered by cell; the last cell of a batch waits for the next batch."""
    held = None

    def emit(columns):
        a, b = _links(*columns)
        pairs = np.unique(np.stack([a, b], axis=1), axis=0).view(np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        columns = [
            batch.column("cell").to_numpy(),
            batch.column("fp").to_numpy().view(np.uint64),
            batch.column("home").to_numpy(zero_copy_only=False),
        ]
        if held is not None:
            columns = [np.concatenate(pair) for pair in zip(held, columns, strict=True)]
        if not len(columns[0]):
            continue
        last = int(np.searchsorted(columns[0], columns[0][-1]))
        held = [c[last:].copy() for c in columns]
        if last:
            yield emit([c[:last] for c in columns])
    if held is not None:
        yield emit(held)


def linked(fps: DataFrame) -> DataFrame:
    """A link table ``(a, b)`` that spans the links of distinct fingerprints ``fp`` (3 or fewer differing bits).

    All links inside a small cell, a spanning forest of a large one: a group of near copies does not expand into all
    its pairs, and no connection is lost. The distinct fingerprints of one group lie within few bits of one point, so
    the size of a cell is bounded by the bits, not by the rows.
    """
    cells = grid_cells(fps).repartition("cell").sortWithinPartitions("cell")
    return cells.mapInArrow(_cell_links, "a bigint, b bigint")


def _grouped(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` without the text, with ``fp``, ``component_id`` and ``component_root`` (least fingerprint)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    docs = docs.drop("fp", "component_id", "component_root")
    marked = scratch.table(fingerprints(docs, text), "fingerprints")
    distinct = scratch.table(marked.groupBy("fp").agg(F.min(doc_id).alias("least")), "distinct")
    roots = components(linked(distinct.select("fp")), scratch)
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("component_root")
    )
    least = rooted.groupBy("component_root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "component_root").select("fp", "component_id", "component_root")
    return marked.join(named, "fp")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns of ``docs`` without the text, with ``fp`` and ``component_id``.

    component_id is the smallest id reachable over links of 3 or fewer differing bits, the row's own included. Null
    texts count as empty and, like all texts without words, have fingerprint 0, linked like any other. Rows with a
    null id take part in links, but null is never the smallest id (a component of null ids only has a null one).
    Repeated rows keep their own output row. No rows give no rows. Other columns pass through; columns
    named ``fp``, ``component_id`` or ``component_root`` are replaced.
    """
    return _grouped(docs, doc_id, text).drop("component_root")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group: the one with the smallest id (nulls last), of equal ids the smallest text hash."""
    key = free_name(docs, "row_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    groups = _grouped(keyed.select("doc_id", F.col(key).alias("row_key"), "text"), "doc_id", "text")
    first = groups.groupBy("component_root").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("first")
    )
    stays = keyed.join(first.select(F.col("first.row_key").alias(key)), key, "left_semi")
    return stays.dropDuplicates([key]).select(*docs.columns)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash_near_dedup": op10_simhash_near_dedup}
SQL: dict[str, str] = {}
