"""Which tokens of two tokenizers cover the same bytes, and how often each pair of ids meets in the corpus.

Both token streams of a text are laid on its bytes. A merge_asof by document finds, for every token start, the token of
the other side that covers it; two tokens overlap exactly when one of them starts inside the other, so both directions
together are all overlaps. Tokens that start together start a group: there the ends before them are equal.

1. Texts are cut at single spaces into parts that both tokenizers treat alone, and laid out in units of some MB. A unit
   keeps figures and group digests per document, its different id pairs with their counts, and per document which of
   them occur.
2. The counts of all units add up by pair (a unit sends each pair once, so a pair that is everywhere is one row a unit);
   the highest count of each B id follows.
3. Totals go back to the units that hold the pair, which sum them up per document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm.shared import Scratch, read_table, shuffles_freed
from barlake.llm.vocabularies import json_encoding, pieces_of, token_sizes

A_VOCABULARY, B_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Text bytes in a unit (it ends with the document that reaches them), and bytes that are aligned at a time.
UNIT_BYTES = 8 << 20
STEP_BYTES = 1 << 20
# Characters after which the next safe boundary of a text is taken.
PART = 1 << 16
_SAFE = re.compile(r"(?<=\S) (?=\S)")
# A pair is one number: the A id times this, plus the B id.
B_IDS = 1 << 16


@dataclass
class Aligned:
    """Tokens of some texts end to end: ids, text numbers, group numbers; overlapping pairs of token numbers."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_text: np.ndarray
    b_text: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    left: np.ndarray
    right: np.ndarray


def parts_of(text: str) -> Iterator[str]:
    """The text cut at single spaces between words, without these spaces: each part is encoded like a text."""
    start = 0
    while len(text) - start > PART:
        cut = _SAFE.search(text, start + PART)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.end()
    yield text[start:]


@cache
def _a_sizes(path: str) -> np.ndarray:
    return token_sizes(json_encoding(path, public_tokenizers.PATTERN))


def tokens_of(text: str | None, a_path: str, b_path: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids of space + text on both sides; None if a side's bytes differ from it, or for no text."""
    if not text:
        return None
    encoding, (model, raw, sizes) = json_encoding(a_path, public_tokenizers.PATTERN), pieces_of(b_path)
    a_parts, b_parts = [], []
    for part in parts_of(text):
        want = (" " + part).encode()
        a = encoding.encode_to_numpy(" " + part, allowed_special=set(), disallowed_special=())
        b = np.array(model.encode(part), np.int64)
        if _a_sizes(a_path)[a].sum() != len(want) or sizes[b].sum() != len(want):
            return None
        if b"".join(map(raw.__getitem__, b.tolist())) != want:
            return None
        a_parts.append(a)
        b_parts.append(b)
    return np.concatenate(a_parts).astype(np.int64), np.concatenate(b_parts)


def _covering(starts: pd.DataFrame, other: pd.DataFrame) -> np.ndarray:
    """Number of the other side's token that covers each start, within the text."""
    found = pd.merge_asof(starts, other, on="start", by="text")
    return found["token"].to_numpy()


def aligned(texts: list[tuple[np.ndarray, np.ndarray]], a_path: str, b_path: str) -> Aligned:
    """Aligns the token streams of several texts, each with the same bytes on both sides."""
    sides = []
    for side, sizes in ((0, _a_sizes(a_path)), (1, pieces_of(b_path)[2])):
        ids = np.concatenate([t[side] for t in texts]) if texts else np.empty(0, np.int64)
        text = np.repeat(np.arange(len(texts)), [len(t[side]) for t in texts])
        size = sizes[ids]
        sides.append((ids, text, np.cumsum(size) - size))
    (a_ids, a_text, a_start), (b_ids, b_text, b_start) = sides
    frames = [pd.DataFrame({"text": t, "start": s}) for _, t, s in sides]
    numbered = [f.assign(token=np.arange(len(f))) for f in frames]
    over_a, over_b = _covering(frames[0], numbered[1]), _covering(frames[1], numbered[0])
    together_a, together_b = b_start[over_a] == a_start, a_start[over_b] == b_start
    own = np.arange(len(b_ids))[~together_b]
    left = np.concatenate([np.arange(len(a_ids)), over_b[~together_b]])
    right = np.concatenate([over_a, own])
    group = np.cumsum(together_a), np.cumsum(together_b)
    return Aligned(a_ids, b_ids, a_text, b_text, group[0], group[1], left, right)


@cache
def _digits() -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the ids, right-aligned in five places and one for what follows, and which places are used."""
    n = np.arange(B_IDS)
    place = 10 ** np.arange(4, -1, -1)
    digits = (n[:, None] // place % 10 + ord("0")).astype(np.uint8)
    used = (n[:, None] >= place) | (place == 1)
    end = np.zeros((B_IDS, 1), np.uint8)
    return np.hstack([digits, end]), np.hstack([used, np.ones((B_IDS, 1), bool)])


def group_digests(found: Aligned, texts: int) -> list[str]:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3`` of each text."""
    ids = np.concatenate([found.a_ids, found.b_ids])
    text = np.concatenate([found.a_text, found.b_text])
    group = np.concatenate([2 * found.a_group, 2 * found.b_group + 1])
    order = np.argsort(group, kind="stable")
    ids, text, group = ids[order], text[order], group[order]
    digits, used = _digits()
    cells, mask = digits[ids], used[ids]
    same = np.zeros(len(ids), bool)
    same[:-1] = group[1:] == group[:-1]
    cells[:, 5] = np.where(same, ord(","), np.where(group % 2 == 0, ord("|"), ord(";")))
    line = cells[mask]
    ends = np.cumsum(np.bincount(text, mask.sum(axis=1), minlength=texts)).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    # Without the separator behind the last group.
    return [hashlib.sha256(line[a : b - 1]).hexdigest() for a, b in zip(starts, ends, strict=True)]


def _planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, lowest bytes first: small numbers leave runs of zeros, which compress."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplaned(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


_UNIT = pa.schema(
    [("unit", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_a", pa.list_(pa.int64())), ("n_b", pa.list_(pa.int64())),
     ("n_groups", pa.list_(pa.int64())), ("n_links", pa.list_(pa.int64())), ("digests", pa.list_(pa.string())),
     ("n_pairs", pa.list_(pa.int32())), ("which", pa.binary()), ("times", pa.binary()), ("pairs", pa.list_(pa.int64())),
     ("counts", pa.list_(pa.int64()))]
)
_UNIT_SQL = (
    "unit bigint, doc_ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>,"
    " n_links array<bigint>, digests array<string>, n_pairs array<int>, which binary, times binary, pairs array<bigint>,"
    " counts array<bigint>"
)
_PER_DOC = ("n_a", "n_b", "n_groups", "n_links", "digests")


class _UnitOf:
    """Gathers documents of one unit: figures at once, pairs of all steps together at the end."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.paths = a_path, b_path
        self.doc_ids: list = []
        self.columns: dict[str, list] = {n: [] for n in _PER_DOC}
        self.keys: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.bytes = 0
        self.waiting: list = []
        self.waiting_bytes = 0

    def add(self, doc_id, text: str | None) -> None:
        tokens = tokens_of(text, *self.paths)
        self.doc_ids.append(doc_id)
        self.waiting.append(tokens)
        size = len(text.encode()) if text else 0
        self.bytes += size
        self.waiting_bytes += size
        if self.waiting_bytes >= STEP_BYTES:
            self._step()

    def _step(self) -> None:
        first = len(self.columns["n_a"])
        texts = [t for t in self.waiting if t]
        at = np.array([i for i, t in enumerate(self.waiting) if t], np.int64)
        n = len(self.waiting)
        figures = {c: np.zeros(n, np.int64) for c in _PER_DOC[:-1]}
        digests = [""] * n
        if texts:
            found = aligned(texts, *self.paths)
            link_text = found.a_text[found.left]
            figures["n_a"][at] = np.bincount(found.a_text, minlength=len(texts))
            figures["n_b"][at] = np.bincount(found.b_text, minlength=len(texts))
            figures["n_links"][at] = np.bincount(link_text, minlength=len(texts))
            opens = np.diff(found.a_group, prepend=0) > 0
            figures["n_groups"][at] = np.bincount(found.a_text[opens], minlength=len(texts))
            for i, digest in zip(at, group_digests(found, len(texts)), strict=True):
                digests[i] = digest
            self.keys.append((found.a_ids[found.left] * B_IDS + found.b_ids[found.right]).astype(np.uint32))
            self.docs.append((at[link_text] + first).astype(np.int32))
        for c in _PER_DOC[:-1]:
            self.columns[c] += figures[c].tolist()
        self.columns["digests"] += digests
        self.waiting, self.waiting_bytes = [], 0

    def row(self, unit: int) -> pa.RecordBatch:
        self._step()
        keys = np.concatenate(self.keys) if self.keys else np.empty(0, np.uint32)
        docs = np.concatenate(self.docs) if self.docs else np.empty(0, np.int32)
        codes, pairs = pd.factorize(keys)
        counts = np.bincount(codes, minlength=len(pairs))
        # Each document's different pairs and how often it has them.
        both, times = np.unique(docs.astype(np.int64) << 32 | codes, return_counts=True)
        owner, which = both >> 32, both & 0xFFFFFFFF
        step = np.diff(which, prepend=0)
        opens = np.diff(owner, prepend=-1) > 0
        step[opens] = which[opens]
        values = [
            unit, self.doc_ids, *[self.columns[c] for c in _PER_DOC],
            np.bincount(owner, minlength=len(self.doc_ids)), _planes(step), _planes(times), pairs.astype(np.int64), counts,
        ]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _UNIT.types, strict=True)], schema=_UNIT)


def units(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row per unit of documents; its number is fixed by writing the frame once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, unit = TaskContext.get().partitionId() << 32, _UnitOf(a_path, b_path)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                unit.add(doc_id, text.as_py())
                if unit.bytes >= UNIT_BYTES:
                    yield unit.row(number)
                    number, unit = number + 1, _UnitOf(a_path, b_path)
        if unit.doc_ids:
            yield unit.row(number)

    return docs.select("doc_id", "text").mapInArrow(run, _UNIT_SQL)


_OUT = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint,"
    " groups_sha256 string"
)


def _summed(key: tuple, unit: pa.Table, answers: pa.Table) -> pa.Table:
    """Rows of the documents of a unit, from the totals of its pairs."""
    row = unit.to_pylist()[0]
    n = len(answers)
    place = answers.column("place").to_numpy() if n else np.empty(0, np.int64)
    total, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    total[place], best[place] = answers.column("total").to_numpy(), answers.column("best").to_numpy()
    step, times = _unplaned(row["which"]), _unplaned(row["times"])
    ends = np.cumsum(np.array(row["n_pairs"], np.int64))
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    owner = np.repeat(np.arange(len(ends)), ends - starts)
    run = np.cumsum(step)
    which = run - np.concatenate([[0], run])[starts][owner] if len(run) else run
    sums = [np.zeros(len(ends), np.int64) for _ in range(2)]
    np.add.at(sums[0], owner, times * best[which])
    np.add.at(sums[1], owner, times * total[which])
    columns = [row["doc_ids"], row["n_a"], row["n_b"], row["n_groups"], row["n_links"], *sums, row["digests"]]
    names = [f.split()[0] for f in _OUT.split(", ")]
    types = [pa.int64()] * 7 + [pa.string()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Figures of both token streams of every row of ``docs`` (``doc_id, text``).

    ``n_a, n_b`` tokens, ``n_groups`` (cut where tokens of both sides end), ``n_links`` overlapping token pairs,
    ``n_best`` links whose pair is the most frequent one of its B id in the corpus (ties included), ``count_sum`` of the
    corpus counts over the links, ``groups_sha256``. Null and empty texts, and texts whose bytes a tokenizer changes, have
    zeros and an empty digest. Repeated rows and null ids keep their own rows and count as often as they occur. Other
    columns do not matter. No rows give no rows. A text without a single space between words is one part.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "alignment")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with shuffles_freed(spark):
        laid = scratch.table(units(docs, a_path, b_path), "units")
        both = F.arrays_zip(F.col("pairs").alias("pair"), F.col("counts").alias("n"))
        listed = laid.select("unit", F.posexplode(both).alias("place", "own")).select(
            "unit", "place", F.col("own.pair").alias("pair"), F.col("own.n").alias("n")
        )
        counted = scratch.table(listed.groupBy("pair").agg(F.sum("n").alias("total")), "counted")
        # At most one row per B id.
        highest = counted.groupBy(F.col("pair") % B_IDS).agg(F.max("total").alias("highest"))
        highest = highest.withColumnRenamed(highest.columns[0], "b_id")
        marked = counted.join(F.broadcast(highest), F.col("pair") % B_IDS == F.col("b_id")).select(
            "pair", "total", (F.col("total") == F.col("highest")).cast("bigint").alias("best")
        )
        answers = listed.join(marked, "pair").select(F.col("unit").alias("home"), "place", "total", "best")
        kept = laid.drop("pairs", "counts")
        rows = kept.groupBy("unit").cogroup(answers.groupBy("home")).applyInArrow(_summed, _OUT)
        return scratch.table(rows, "rows")


def groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The groups themselves: ``doc_id, groups`` with the A ids and the B ids of each, in order; empty without tokens."""
    schema = "doc_id bigint, groups array<struct<a: array<bigint>, b: array<bigint>>>"
    kind = pa.list_(pa.struct([("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for text in batch.column("text"):
                tokens = tokens_of(text.as_py(), a_path, b_path)
                found = aligned([tokens] if tokens else [], a_path, b_path)
                sides = [
                    np.split(ids, np.flatnonzero(np.diff(group)) + 1) if len(ids) else []
                    for ids, group in ((found.a_ids, found.a_group), (found.b_ids, found.b_group))
                ]
                lists.append([{"a": a, "b": b} for a, b in zip(*sides, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lists, kind)], names=["doc_id", "groups"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path(A_VOCABULARY), public_tokenizers.path(B_VOCABULARY)
    return align(read_table(spark, sf_dir, "documents"), *paths)


QUERIES = {"op12_cross_tokenizer_alignment": op12_cross_tokenizer_alignment}
SQL: dict[str, str] = {}
