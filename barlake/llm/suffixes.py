"""Exact repeated substrings across documents: suffixes sorted bucket by bucket, pruned by difference-cover ranks.

A difference cover D modulo v holds, for any two positions i and j, a shift d < v with both i + d and j + d in D. Two
suffixes that agree on 50 bytes therefore agree, at some shift d <= 30, on a cover position and the 20 bytes from it.

1. Texts are packed into units, written once to the shared folder; their numbering is fixed by that table.
2. Cover ranks: the 20-byte strings at the cover positions (6 of 31) are ranked in buckets; the rank only tells whether
   another occurrence exists. A suffix without such a sample among its next 31 positions has no tie of 50 bytes and
   is left out. One bit per distinct sample goes back to its unit.
3. The remaining suffixes are sorted a range of buckets at a time. What a round shuffles is bounded by the text size,
   whatever the share of repeats; shuffle files of a round are freed before the next. Ties (equal 64-bit
   fingerprints of the next 50 bytes, besides the bucket) learn the smallest document that holds them. A unit sends
   each distinct suffix once, so a passage in a third of all documents is one entry a unit.
4. One bit per distinct suffix goes back; units mark the covered bytes and cut them out.

Only equality of 50 bytes matters, so suffixes are ordered by fingerprint instead of by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm.shared import Scratch, binary_list, held, read_table, shuffles_freed, slices

DEPTH = 50
PERIOD = 31
# A perfect difference set modulo 31.
COVER = (1, 5, 11, 24, 25, 27)
SAMPLE = DEPTH - PERIOD + 1

UNIT_BYTES = 2 << 20
# Positions hashed at a time.
SLICE = 1 << 18
# Text bytes whose suffixes share a bucket, and the share of the text size that one round may shuffle.
BUCKET_TEXT = 8 << 20
ROUND_SHARE = 1.25
ENTRY_BYTES = 10
# Suffixes of a bucket that are sorted at a time.
SORTED = 1 << 19
# Bytes that travel to a Python worker at a time.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "16m")

_LAST = np.iinfo(np.int64).max
_STEP = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.frombuffer(hashlib.shake_256(b"byte values").digest(8 * 256), dtype="<u8")


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of the ``width`` bytes from each position that has as many left."""
    n = len(data) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        power = {1: _TABLE[data]}
        factor = {1: _STEP}
        size = 1
        while size * 2 <= width:
            now = power[size]
            power[size * 2] = now[:-size] * factor[size] + now[size:]
            factor[size * 2] = factor[size] * factor[size]
            size *= 2
        out, at = None, 0
        while size:
            if width & size:
                part = power[size][at : at + n]
                out = part.copy() if out is None else out * factor[size] + part
                at += size
            size //= 2
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


@dataclass
class Unit:
    """A run of documents: their bytes end to end, their ids and end offsets."""

    data: np.ndarray
    ids: np.ndarray
    ends: np.ndarray

    @staticmethod
    def of(row: dict) -> Unit:
        return Unit(
            np.frombuffer(row["data"], np.uint8),
            np.frombuffer(row["ids"], np.int64),
            np.frombuffer(row["ends"], np.int64),
        )

    def hashes(self, width: int, wanted: np.ndarray) -> np.ndarray:
        """Hashes of ``width`` bytes at the wanted positions (ascending), a slice at a time."""
        out, done = np.empty(len(wanted), np.uint64), 0
        for start in range(0, max(len(self.data) - width + 1, 0), SLICE):
            a, b = np.searchsorted(wanted, (start, start + SLICE))
            if a < b:
                out[a:b] = window_hashes(self.data[start : start + SLICE + width - 1], width)[wanted[a:b] - start]
                done = b
        return out[:done]

    def inside(self, at: np.ndarray, width: int) -> np.ndarray:
        """Positions whose next ``width`` bytes stay in their document."""
        if not len(at):
            return at
        return at[at + width <= self.ends[np.searchsorted(self.ends, at, side="right")]]

    def cover(self) -> np.ndarray:
        grid = np.arange(0, len(self.data), PERIOD, dtype=np.int64)[:, None] + np.array(COVER, dtype=np.int64)
        at = grid.ravel()
        return self.inside(at[at < len(self.data)], SAMPLE)

    def samples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cover positions; distinct hashes; the distinct one of each position; occurrences of each."""
        at = self.cover()
        distinct, back, count = np.unique(self.hashes(SAMPLE, at), return_inverse=True, return_counts=True)
        return at, distinct, back, count

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """Positions of 50-byte suffixes with a shared sample among their next 31 positions."""
        n = len(self.data)
        change = np.zeros(n + 1, np.int32)
        np.add.at(change, np.maximum(shared - PERIOD + 1, 0), 1)
        np.add.at(change, shared + 1, -1)
        return self.inside(np.flatnonzero(np.cumsum(change[:n])), DEPTH)

    def suffixes(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Candidate positions from the packed mask, and the hashes of their suffixes."""
        at = np.flatnonzero(np.unpackbits(mask, count=len(self.data))).astype(np.int32)
        return at, self.hashes(DEPTH, at)

    def owners(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, side="right")


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of the upper 32 bits, so they ascend with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, t) for column, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema
    )


def pack_units(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows of about 2 MB of text. The other columns travel along as an Arrow stream (``rest``)."""
    schema = pa.schema(
        [("unit", pa.int64()), ("data", pa.binary()), ("ids", pa.binary()), ("ends", pa.binary()), ("rest", pa.binary())]
    )
    rest = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch, text, UNIT_BYTES):
                texts = [t or b"" for t in binary_list(piece.column(text))]
                ids = piece.column(doc_id).cast(pa.int64()).fill_null(_LAST).to_numpy()
                kept = piece.select(rest)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, kept.schema) as out:
                    out.write_batch(kept)
                row = (
                    (part << 32) + seq,
                    b"".join(texts),
                    ids.tobytes(),
                    np.cumsum([len(t) for t in texts], dtype=np.int64).tobytes(),
                    sink.getvalue().to_pybytes(),
                )
                yield _batch(schema, [row])
                seq += 1

    return docs.mapInArrow(run, "unit bigint, data binary, ids binary, ends binary, rest binary")


def _sample_parts(buckets: int):
    schema = pa.schema([("unit", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary())])

    def run(batches):
        for row in _rows(batches):
            _, distinct, _, _ = Unit.of(row).samples()
            if not len(distinct):
                continue
            low = distinct.astype(np.uint32)
            where = bucket_of(distinct, buckets)
            cuts = np.flatnonzero(np.diff(where)) + 1
            parts = np.split(low, cuts)
            names = where[np.concatenate([[0], cuts])]
            yield _batch(schema, [(row["unit"], int(b), p.tobytes()) for b, p in zip(names, parts, strict=True)])

    return run


_ANSWER = pa.schema([("unit", pa.int64()), ("bucket", pa.int64()), ("n", pa.int32()), ("bits", pa.binary())])
_ANSWER_SQL = "unit bigint, bucket bigint, n int, bits binary"


def _shared_samples(key: tuple, table: pa.Table) -> pa.Table:
    """Of a bucket's samples, which occur in more than one unit: one bit per distinct sample of each unit."""
    units = table.column("unit").to_pylist()
    keys = [np.frombuffer(k, np.uint32) for k in table.column("keys").to_pylist()]
    every = np.sort(np.concatenate(keys))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    rows = []
    for unit, own in zip(units, keys, strict=True):
        at = np.searchsorted(twice, own)
        hit = (at < len(twice)) & (twice[np.minimum(at, len(twice) - 1)] == own) if len(twice) else np.zeros(len(own), bool)
        rows.append((unit, key[0].as_py(), len(own), np.packbits(hit).tobytes()))
    return pa.Table.from_batches([_batch(_ANSWER, rows)])


def _unpacked(answers: list[dict] | None) -> np.ndarray:
    """Bits of all buckets of a unit in the order of the hashes."""
    ordered = sorted(answers or [], key=lambda a: a["bucket"])
    parts = [np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=a["n"]) for a in ordered]
    return np.concatenate(parts).astype(bool) if parts else np.empty(0, bool)


def _marked(batches):
    schema = pa.schema(
        [("unit", pa.int64()), ("data", pa.binary()), ("ids", pa.binary()), ("ends", pa.binary()), ("rest", pa.binary()),
         ("mask", pa.binary()), ("candidates", pa.int64())]
    )
    for row in _rows(batches):
        unit = Unit.of(row)
        at, _, back, count = unit.samples()
        shared = at[((count > 1) | _unpacked(row["answers"]))[back]] if len(at) else at
        found = unit.candidates(shared)
        mask = np.zeros(len(unit.data), bool)
        mask[found] = True
        yield _batch(
            schema,
            [(row["unit"], row["data"], row["ids"], row["ends"], row["rest"], np.packbits(mask).tobytes(), len(found))],
        )


def _distinct_suffixes(unit: Unit, mask: bytes, buckets: int = 1, low: int = 0, high: int = 1):
    """Positions, distinct hashes, least document id of each, and the order of the positions by hash with its first ones.

    Of the suffixes in the buckets low to high - 1 only, which are picked before anything is sorted.
    """
    at, hashes = unit.suffixes(np.frombuffer(mask, np.uint8))
    if high - low < buckets:
        where = bucket_of(hashes, buckets)
        mine = (where >= low) & (where < high)
        at, hashes = at[mine], hashes[mine]
    order = np.argsort(hashes)
    hashes = hashes[order]
    first = _firsts(hashes)
    ids = unit.ids[unit.owners(at[order])]
    least = np.minimum.reduceat(ids, np.flatnonzero(first)) if len(ids) else ids
    return at, hashes[first], least, order, first


def _firsts(ordered: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before."""
    first = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    return first


def _suffix_parts(buckets: int, low: int, high: int):
    """The suffixes of the buckets low to high - 1."""
    schema = pa.schema(
        [("unit", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary()), ("ids", pa.binary())]
    )

    def run(batches):
        for row in _rows(batches):
            unit = Unit.of(row)
            distinct, least = _distinct_suffixes(unit, row["mask"], buckets, low, high)[1:3]
            if not len(distinct):
                continue
            names, starts = np.unique(bucket_of(distinct, buckets), return_index=True)
            rows = []
            for name, keys, owner in zip(names, np.split(distinct, starts[1:]), np.split(least, starts[1:]), strict=True):
                ids, docs = np.unique(owner, return_inverse=True)
                kind = np.uint16 if len(ids) <= 1 << 16 else np.uint32
                rows.append((row["unit"], int(name), keys.tobytes(), docs.astype(kind).tobytes(), ids.tobytes()))
            yield _batch(schema, rows)

    return run


def _a_bucket_at_a_time(solve):
    """Takes the batches itself, so that a bucket is let go before the next one is read."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from solve(key, pa.Table.from_batches(batches)).to_batches()

    return run


def _arrays(column: pa.ChunkedArray) -> Iterator[pa.Buffer]:
    """The values of a binary column where they lie, without a copy."""
    return (value.as_buffer() for chunk in column.chunks for value in chunk)


def _tied_suffixes(key: tuple, table: pa.Table) -> pa.Table:
    """Sorts a bucket; a unit's suffix gets bit 1 if a document smaller than its own holds it in another unit.

    The suffixes of a unit come in order, so a bucket of many is sorted a range of hashes at a time: beside the rows
    themselves only ``SORTED`` suffixes or so are held. A hash comes once a unit at most, so the ranges are even.
    """
    units = table.column("unit").to_pylist()
    keys = [np.frombuffer(k, np.uint64) for k in _arrays(table.column("keys"))]
    docs = [
        np.frombuffer(d, np.uint16 if d.size == 2 * len(own) else np.uint32)
        for d, own in zip(_arrays(table.column("docs")), keys, strict=True)
    ]
    ids = [np.frombuffer(i, np.int64) for i in _arrays(table.column("ids"))]
    smaller = [np.empty(len(own), bool) for own in keys]
    ranges = -(-sum(map(len, keys)) // SORTED)
    least, most = min(int(own[0]) for own in keys), max(int(own[-1]) for own in keys)
    edges = np.array([least + (most - least) * r // ranges for r in range(1, ranges)], np.uint64)
    cuts = [np.concatenate([[0], np.searchsorted(own, edges), [len(own)]]) for own in keys]
    for r in range(ranges):
        spans = [(i, int(cut[r]), int(cut[r + 1])) for i, cut in enumerate(cuts) if cut[r] < cut[r + 1]]
        if spans:
            hits = _smaller([keys[i][a:b] for i, a, b in spans], [ids[i][docs[i][a:b]] for i, a, b in spans])
            start = 0
            for i, a, b in spans:
                smaller[i][a:b] = hits[start : start + b - a]
                start += b - a
    bucket = key[0].as_py()
    rows = [(unit, bucket, len(own), np.packbits(own).tobytes()) for unit, own in zip(units, smaller, strict=True)]
    return pa.Table.from_batches([_batch(_ANSWER, rows)])


def _smaller(keys: list[np.ndarray], owners: list[np.ndarray]) -> np.ndarray:
    """Per suffix, one array after the other: does a smaller document than its own hold it?"""
    every, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(every)
    first = _firsts(every[order])
    owner = owner[order]
    least = np.minimum.reduceat(owner, np.flatnonzero(first))
    hits = np.empty(len(every), bool)
    hits[order] = least[np.cumsum(first, dtype=np.int32) - 1] < owner
    return hits


def _cut(fields: list[str], text: str | None):
    """Original columns of each document, the kept bytes and the figures of the cut."""

    def run(batches):
        for row in _rows(batches):
            unit = Unit.of(row)
            at, _, least, order, first = _distinct_suffixes(unit, row["mask"])
            if len(at):
                back = np.cumsum(first, dtype=np.int32) - 1
                at = at[order]
                at = at[_unpacked(row["answers"])[back] | (least[back] < unit.ids[unit.owners(at)])]
            starts = at
            change = np.zeros(len(unit.data) + 1, np.int32)
            change[starts] += 1
            change[starts + DEPTH] -= 1
            gone = np.cumsum(change[:-1]) > 0
            figures, kept = [], []
            for a, b in zip(np.concatenate([[0], unit.ends[:-1]]), unit.ends, strict=True):
                cut = gone[a:b]
                spans = int(np.count_nonzero(cut[1:] & ~cut[:-1])) + int(len(cut) > 0 and cut[0])
                rest = unit.data[a:b][~cut].tobytes()
                kept.append(rest)
                figures.append((int(b - a), int(np.count_nonzero(cut)), spans, hashlib.sha256(rest).hexdigest()))
            own = pa.ipc.open_stream(row["rest"]).read_all().combine_chunks().to_batches()
            columns = dict(zip(own[0].schema.names, own[0].columns, strict=True)) if own else {}
            if text:
                columns[text] = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
            n_bytes, n_removed, n_spans, digest = zip(*figures, strict=True)
            columns |= {
                "kept_bytes": pa.array(kept, pa.binary()),
                "n_bytes": pa.array(n_bytes, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "n_spans": pa.array(n_spans, pa.int64()),
                "kept_sha256": pa.array(digest, pa.string()),
            }
            yield pa.RecordBatch.from_arrays([columns[f] for f in fields], names=fields)

    return run


def _with_answers(units: DataFrame, answers: DataFrame) -> DataFrame:
    grouped = answers.groupBy("unit").agg(F.collect_list(F.struct("bucket", "n", "bits")).alias("answers"))
    return units.join(grouped, "unit", "left")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", figures: bool = True) -> DataFrame:
    """Cuts every byte covered by a 50-byte string that also starts in a document with a smaller id.

    Returns the columns of ``docs`` in their order, the text replaced by what is left (bytes of characters cut in
    half are dropped there), and with ``figures`` also ``kept_bytes`` (exact), ``n_bytes``, ``n_removed``,
    ``n_spans`` and ``kept_sha256``; columns of these names are replaced then. Null texts are empty.
    Documents with a null id come after all others. Rows with equal ids (also repeated rows) are never smaller than
    each other, so they do not cut each other. Texts under 50 bytes stay whole. Matches never cross documents. No rows give no rows.
    """
    added = ["kept_bytes binary", "n_bytes bigint", "n_removed bigint", "n_spans bigint", "kept_sha256 string"]
    if figures:
        docs = docs.drop(*[a.split()[0] for a in added])
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    schema = "unit bigint, data binary, ids binary, ends binary, rest binary"
    with shuffles_freed(spark), held(spark, *BATCH):
        units = scratch.table(pack_units(docs, doc_id, text), "units")
        size = units.agg(F.sum(F.octet_length("data"))).first()[0] or 0
        parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(parallel, -(-size // BUCKET_TEXT))
        samples = units.mapInArrow(_sample_parts(buckets), "unit bigint, bucket bigint, keys binary")
        shared = samples.groupBy("bucket").applyInArrow(_a_bucket_at_a_time(_shared_samples), _ANSWER_SQL)
        ranks = scratch.table(shared, "ranks")
        joined = _with_answers(units, ranks).mapInArrow(_marked, f"{schema}, mask binary, candidates bigint")
        marked = scratch.table(joined, "marked")
        scratch.drop("units")
        scratch.drop("ranks")
        left = (marked.agg(F.sum("candidates")).first()[0] or 0) * ENTRY_BYTES
        rounds = max(1, min(buckets, -(-left // max(int(size * ROUND_SHARE), 1))))
        edges = [buckets * r // rounds for r in range(rounds + 1)]
        ties = None
        for low, high in zip(edges, edges[1:], strict=False):
            parts = marked.select("unit", "data", "ids", "ends", "mask").mapInArrow(
                _suffix_parts(buckets, low, high), "unit bigint, bucket bigint, keys binary, docs binary, ids binary"
            )
            tied = parts.groupBy("bucket").applyInArrow(_a_bucket_at_a_time(_tied_suffixes), _ANSWER_SQL)
            found = scratch.table(tied, f"ties-{low}")
            ties = found if ties is None else ties.unionByName(found)
    shape = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + (added if figures else [])
    names = [f.name for f in docs.schema] + ([a.split()[0] for a in added] if figures else [])
    return _with_answers(marked.drop("candidates"), ties).mapInArrow(_cut(names, text), ", ".join(shape))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op8_suffix_array_dedup": op8_suffix_array_dedup}
SQL: dict[str, str] = {}
