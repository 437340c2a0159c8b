"""Near-duplicate paragraphs: MinHash bands, exact Jaccard within buckets, removal by components."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm.components import components
from barlake.llm.shared import ASCII_LOWER, Scratch, binary_list, read_table, shuffles_freed, with_row_key

SHINGLE = 5
SIMILAR = 0.8
# Nine bands of three rows find a pair of similarity 0.8 with probability 1 - (1 - 0.8 ** 3) ** 9 = 0.998.
BANDS = 9
ROWS = 3
# Members of a bucket compared in one group; larger buckets become pairs of blocks of half this size.
GROUP = 4096
SEED = 42

# Lines with at least this many blanks are also looked at sentence by sentence.
LONG = 60

_LINES = re.compile(rb"[^\r\n]+")
_SENTENCE_ENDS = re.compile(rb"[.!?](?:[\x20\x09]|$)")
_RANDOM = np.random.default_rng(SEED)
_FACTORS = _RANDOM.integers(1, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RANDOM.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)


def paragraphs(text: bytes | None) -> list[tuple[int, int, list[bytes]]]:
    """Start, end and lower-case words of the paragraphs (lines) with at least one shingle of five words."""
    found = []
    for line in _LINES.finditer(text or b""):
        words = line.group().translate(ASCII_LOWER).split()
        if len(words) >= SHINGLE:
            found.append((line.start(), line.end(), words))
    return found


def sentences(text: bytes | None) -> list[tuple[int, int, tuple[int, int]]]:
    """Start, end and a 128-bit hash of the words of the sentences of long lines, each of at least five words.

    A sentence ends behind . ! or ? before white space, whatever stands around it, so a passage that was copied into
    another line falls into the same sentences there. The blank behind a sentence belongs to it.
    """
    found = []
    for line in _LINES.finditer(text or b""):
        raw = line.group()
        if raw.count(b" ") < LONG:
            continue
        at = 0
        for end in [*(m.end() for m in _SENTENCE_ENDS.finditer(raw)), len(raw)]:
            words = raw[at:end].translate(ASCII_LOWER).split()
            if len(words) >= SHINGLE:
                key = xxhash.xxh3_128_intdigest(b" ".join(words), SEED)
                halves = (key >> 64) - (1 << 63), (key & (1 << 64) - 1) - (1 << 63)
                found.append((line.start() + at, line.start() + end, halves))
            at = end
    return found


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles."""
    joined, at, starts = b" ".join(words), 0, []
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = [*(s - 1 for s in starts[SHINGLE:]), len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=False)], dtype=np.uint64))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of band keys for each set of shingles."""
    out = np.empty((len(sets), BANDS), np.uint64)
    start = 0
    while start < len(sets):
        stop, size = start, 0
        while stop < len(sets) and (stop == start or size + len(sets[stop]) <= 1 << 16):
            size += len(sets[stop])
            stop += 1
        every = np.concatenate(sets[start:stop])
        cuts = np.cumsum([0] + [len(s) for s in sets[start : stop - 1]])
        mixed = every * _FACTORS + _OFFSETS
        mixed ^= mixed >> np.uint64(29)
        least = np.minimum.reduceat(mixed, cuts, axis=1).T.reshape(stop - start, BANDS, ROWS)
        keys = np.zeros((stop - start, BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
        for r in range(ROWS):
            keys = (keys ^ least[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
            keys ^= keys >> np.uint64(32)
        out[start:stop] = keys
        start = stop
    return out


def _listed(docs: DataFrame) -> DataFrame:
    """``row_key, doc_id, idx, pid, bands`` of every paragraph; pid is a 128-bit hash of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column("row_key").to_pylist(), batch.column("doc_id").to_pylist()
            rows, sets = [], []
            for key, doc_id, text in zip(keys, ids, binary_list(batch.column("text")), strict=True):
                for idx, (_, _, words) in enumerate(paragraphs(text)):
                    rows.append((key, doc_id, idx, xxhash.xxh3_128_digest(b" ".join(words), SEED)))
                    sets.append(shingles(words))
            if not rows:
                continue
            bands = band_keys(sets).view(np.int64)
            columns = list(zip(*rows, strict=True))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(bands.ravel()), BANDS).cast(pa.list_(pa.int64()))
            types = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, lists], names=["row_key", "doc_id", "idx", "pid", "bands"])

    return docs.select("row_key", "doc_id", "text").mapInArrow(
        run, "row_key bigint, doc_id bigint, idx int, pid binary, bands array<bigint>"
    )


def _bucket_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by band key: members of keys with two or more, their block, and a sum that tells member sets apart."""
    half, held = GROUP // 2, None

    def emit(keys, pids, marks, seen):
        """``seen``: members of the first key that earlier batches have already sent."""
        change = np.flatnonzero(np.diff(keys)) + 1
        starts = np.concatenate([[0], change])
        sizes = np.diff(np.concatenate([starts, [len(keys)]]))
        place = np.arange(len(keys)) - np.repeat(starts, sizes)
        place[: sizes[0]] += seen
        total = sizes.copy()
        total[0] += seen
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(marks, starts)
        take = np.flatnonzero(np.repeat(total > 1, sizes))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(keys[take]),
                pids.take(pa.array(take)),
                pa.array((place[take] // half).astype(np.int32)),
                pa.array(np.repeat(sums, sizes)[take]),
            ],
            names=["key", "pid", "block", "sum"],
        )

    seen = 0
    for batch in batches:
        keys = batch.column("key").to_numpy()
        marks = batch.column("mark").to_numpy()
        pids = batch.column("pid")
        if held is not None:
            keys = np.concatenate([held[0], keys])
            pids = pa.concat_arrays([held[1], pids])
            marks = np.concatenate([held[2], marks])
        if not len(keys):
            continue
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            yield emit(keys[:last], pids.slice(0, last), marks[:last], seen)
            seen = 0
        if len(keys) - last > 4 * GROUP:
            # A hot bucket goes out in parts; one member stays back for the next part.
            yield emit(keys[last:-1], pids.slice(last, len(keys) - last - 1), marks[last:-1], seen)
            seen += len(keys) - last - 1
            last = len(keys) - 1
        held = keys[last:].copy(), pids.slice(last), marks[last:].copy()
    if held is not None:
        yield emit(*held, seen)


def _similar(ids: list[bytes], sets: list[np.ndarray]) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the pairs with a Jaccard similarity of 0.8 or more, worked out exactly."""
    universe = np.unique(np.concatenate(sets))
    bits = np.zeros((len(sets), -(-len(universe) // 64) * 64), np.uint8)
    for i, s in enumerate(sets):
        bits[i, np.searchsorted(universe, s)] = 1
    words = np.packbits(bits, axis=1).view(np.uint64)
    size = np.array([len(s) for s in sets])
    rest, links = np.arange(len(sets)), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            node = queue.pop()
            close = rest[np.minimum(size[rest], size[node]) * 5 >= np.maximum(size[rest], size[node]) * 4]
            common = np.bitwise_count(words[close] & words[node]).sum(axis=1, dtype=np.int64)
            found = close[common * 5 >= (size[close] + size[node] - common) * 4]
            if len(found):
                links += [(ids[node], ids[j]) for j in found]
                queue.extend(found)
                rest = np.setdiff1d(rest, found, assume_unique=True)
    return links


def _group_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each group of rows that are ordered by ``group``."""
    group, ids, sets = None, [], []

    def emit():
        links = _similar(ids, sets) if len(ids) > 1 else []
        return pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in links], pa.binary()), pa.array([y for _, y in links], pa.binary())], names=["a", "b"]
        )

    for batch in batches:
        for g, pid, s in zip(*[batch.column(c).to_pylist() for c in ("group", "pid", "shingles")], strict=True):
            if g != group:
                yield emit()
                group, ids, sets = g, [], []
            ids.append(pid)
            sets.append(np.frombuffer(s, np.uint64))
    yield emit()


def _shingles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of the wanted paragraphs of each text."""
    for batch in batches:
        pids, sets = [], []
        for text, wanted in zip(binary_list(batch.column("text")), batch.column("wanted").to_pylist(), strict=True):
            own = paragraphs(text)
            for w in wanted:
                pids.append(w["pid"])
                sets.append(shingles(own[w["idx"]][2]).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(pids, pa.binary()), pa.array(sets, pa.binary())], names=["pid", "shingles"])


def candidate_groups(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """``(group, pid)``: members of each bucket with two or more, equal member sets once, large buckets in block pairs."""
    rows = distinct.select("pid", F.explode("bands").alias("key")).withColumn("mark", F.xxhash64("pid"))
    ordered = rows.repartition("key").sortWithinPartitions("key")
    members = scratch.table(
        ordered.mapInArrow(_bucket_members, "key bigint, pid binary, block int, sum bigint"), "members"
    )
    per_key = members.groupBy("key").agg(F.max("block").alias("last"), F.count("*").alias("n"), F.max("sum").alias("sum"))
    whole = per_key.where("last = 0").groupBy("n", "sum").agg(F.min("key").alias("key")).select("key", F.lit(0).alias("last"))
    chosen = whole.unionByName(per_key.where("last > 0").select("key", "last"))
    joined = members.join(chosen, "key")
    single = joined.where("last = 0").select(F.xxhash64("key").alias("group"), "pid")
    other = F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other")
    split = joined.where("last > 0").select("key", "pid", "block", other)
    pairs = split.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("group"), "pid")
    return single.unionByName(pairs)


def classes(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """All paragraphs, and ``pid, root, first`` of those that belong to a class of two or more occurrences."""
    listed = scratch.table(_listed(docs), "listed")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key", "idx")
    distinct = listed.groupBy("pid").agg(
        F.min(place).alias("first"), F.count("*").alias("n"), F.min("bands").alias("bands")
    )
    distinct = scratch.table(distinct, "distinct")
    groups = scratch.table(candidate_groups(distinct, scratch).distinct(), "groups")
    wanted = (
        distinct.join(groups.select("pid").distinct(), "pid", "left_semi")
        .groupBy(F.col("first.row_key").alias("row_key"))
        .agg(F.collect_list(F.struct("pid", F.col("first.idx").alias("idx"))).alias("wanted"))
    )
    texts = docs.dropDuplicates(["row_key"]).join(wanted, "row_key").select("text", "wanted")
    sets = scratch.table(texts.mapInArrow(_shingles_of, "pid binary, shingles binary"), "shingles")
    full = groups.join(sets, "pid").repartition("group").sortWithinPartitions("group", "pid")
    links = full.mapInArrow(_group_links, "a binary, b binary")
    roots = components(links, scratch).select(F.col("node").alias("pid"), "root")
    rooted = distinct.drop("bands").join(roots, "pid", "left").withColumn("root", F.coalesce("root", "pid"))
    grouped = rooted.groupBy("root").agg(F.min("first").alias("kept"), F.sum("n").alias("members")).where("members > 1")
    return listed, scratch.table(rooted.select("pid", "root").join(grouped, "root").drop("members"), "classes")


def _sentence_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, ids = batch.column("row_key").to_pylist(), batch.column("doc_id").to_pylist()
        rows = [
            (key, doc_id, idx, *halves)
            for key, doc_id, text in zip(keys, ids, binary_list(batch.column("text")), strict=True)
            for idx, (_, _, halves) in enumerate(sentences(text))
        ]
        if rows:
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["row_key", "doc_id", "idx", "h", "g"])


def repeated_sentences(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``row_key, sentences, first_in``: sentences of long lines that a document with a smaller id holds word for word.

    Null ids come after all others. Judged on the texts as given, not on what is left of them.
    """
    schema = "row_key bigint, doc_id bigint, idx int, h bigint, g bigint"
    place = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    listed = docs.select("row_key", "doc_id", "text").mapInArrow(_sentence_rows, schema).withColumn("place", place)
    listed = scratch.table(listed.drop("doc_id"), "sentences")
    known = listed.groupBy("h", "g").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    known = known.where("first < last").drop("last")
    again = listed.join(known, ["h", "g"]).where(F.col("place") > F.col("first"))
    return again.groupBy("row_key").agg(F.collect_set("idx").alias("sentences"), F.collect_set("first").alias("first_in"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        columns = [batch.column(c).to_pylist() for c in ("doc_id", "gone", "kept_in", "sentences", "first_in")]
        for doc_id, gone, kept_in, again, first_in, text in zip(*columns, binary_list(batch.column("text")), strict=True):
            raw, own = text or b"", paragraphs(text)
            cuts = []
            for idx in gone or []:
                start, end, _ = own[idx]
                # The line break behind a paragraph goes with it.
                cuts.append((start, end + len(re.match(rb"\r?\n?", raw[end : end + 2]).group())))
            if again:
                listed = sentences(text)
                cuts += [listed[idx][:2] for idx in again]
            parts, at, removed, spans = [], 0, 0, 0
            for start, end in sorted(cuts):
                if end <= at:
                    continue
                parts.append(raw[at:start])
                spans += start > at or not removed
                removed += end - max(start, at)
                at = end
            parts.append(raw[at:])
            kept = b"".join(parts)
            kept_ids = sorted({*(kept_in or []), *(first_in or [])})
            rows.append(
                (doc_id, len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), len(own), len(gone or []),
                 kept_ids, kept.decode("utf-8", "ignore"))
            )
        if not rows:
            continue
        types = [pa.int64()] * 4 + [pa.string()] + [pa.int64()] * 2 + [pa.list_(pa.int64()), pa.string()]
        names = [f.split()[0] for f in _CUT.split(", ")]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names
        )


_CUT = (
    "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_paragraphs bigint,"
    " n_removed_paragraphs bigint, kept_in array<bigint>, text string"
)


def remove_near_duplicates(docs: DataFrame) -> DataFrame:
    """Cuts every paragraph that has an earlier near-duplicate; one result row per row of ``docs`` (``doc_id, text``).

    A paragraph is a line of at least five words; shorter lines stay. Paragraphs link at a Jaccard similarity of 0.8
    or more of their five-word shingles (lower-case A-Z, words between ASCII white space); of each component the first
    by doc_id (null last), then by place, stays. Of lines with 60 blanks or more, sentences of at least five words that
    a document with a smaller id holds word for word in such a line go too, as given, so a passage that was copied into
    another line is found. ``kept_in`` lists the documents that keep the removed paragraphs' classes and sentences. Null texts are empty. Repeated rows are treated alike: both keep what the first of them keeps. Other
    columns do not matter. No rows give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "paragraphs")
    keyed = with_row_key(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "doc_id", "text")
    with shuffles_freed(spark):
        listed, found = classes(keyed, scratch)
        same = (F.col("row_key") == F.col("kept.row_key")) & (F.col("idx") == F.col("kept.idx"))
        gone = listed.drop("bands").join(found, "pid").where(~same)
        gone = gone.groupBy("row_key").agg(
            F.collect_set("idx").alias("gone"), F.collect_set("kept.doc_id").alias("kept_in")
        )
        gone = scratch.table(gone.join(repeated_sentences(keyed, scratch), "row_key", "full_outer"), "gone")
    return keyed.join(gone, "row_key", "left").mapInArrow(_cut, _CUT)


def op2_paragraph_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_near_duplicates(read_table(spark, sf_dir, "documents")).drop("text")


QUERIES = {"op2_paragraph_minhash_dedup": op2_paragraph_minhash_dedup}
SQL: dict[str, str] = {}
