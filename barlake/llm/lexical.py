"""Ranked lexical search over pipelined term owners, exact and in whole numbers.

1. Documents are read once for each block of query terms (a block holds a bounded number of terms). Documents of some MB
   make a unit; a unit has one posting row per term: document numbers, occurrences and document lengths, packed.
2. Terms belong to stages by the share of documents that hold them, the rarest first. Items travel in bundles: for each
   unit a bundle carries a sparse table of (item, document, score so far). In a stage the bundle meets, by cogroup on
   (bundle, unit), the postings of the stage's terms and adds their contributions.
3. A document can be dropped from an item's table when not even the greatest contributions of all later terms lift it to
   the unit's 50th score, and no new one is taken up once these could not. Both are exact: partial scores only grow, and
   the 50th score within one unit is never above the 50th of all.
4. After the last stage every unit gives its 50 best scores per item, ties included, and the ranks follow over all units.

A term in every document is one posting row a unit; a group holds one unit's postings for one bundle, whatever the number
of documents or items.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlake.llm.shared import ASCII_LOWER, Scratch, read_table, shuffles_freed, text_blocks

TOP = 50
# Items that travel together, and query terms that one pass over the documents looks for.
BUNDLE = 256
TERMS = 200_000
# Text bytes and documents of a unit (whichever comes first).
UNIT_BYTES = 8 << 20
UNIT_ROWS = 16_384
# Stage of a term: how many of these shares of all documents it reaches.
SHARES = (0.001, 0.01, 0.1)
STAGES = len(SHARES) + 1
# Stands for a null id while ids are packed; such an id itself would come back as null.
_NO_ID = -(1 << 63)
# Fixed values of the score: no contribution of weight 1 reaches CEILING.
CEILING = 1_000_000

# Letters, digits and bytes of other characters make terms; A-Z are folded.
_TERM_BYTES = bytes(
    ASCII_LOWER[b] if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def term_counts(text: str | None) -> Counter:
    """Terms of a whole text with their occurrences."""
    counts: Counter = Counter()
    for block in text_blocks((text or "").encode().translate(_TERM_BYTES)):
        counts.update(block.split())
    return counts


def _terms(text: Column) -> Column:
    """The distinct terms of a text."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.regexp_extract_all(lowered, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0)))


_POSTING = pa.schema(
    [("unit", pa.int64()), ("term", pa.string()), ("docs", pa.binary()), ("tf", pa.binary()), ("lengths", pa.binary())]
)
_POSTING_SQL = "unit bigint, term string, docs binary, tf binary, lengths binary"


class _Unit:
    """Postings of one unit under construction."""

    def __init__(self) -> None:
        self.ids: list = []
        self.lengths: list[int] = []
        self.found: list[tuple[int, int, int]] = []
        self.bytes = 0

    def add(self, doc_id, text: str | None, wanted: dict[bytes, int]) -> None:
        counts = term_counts(text)
        row = len(self.ids)
        self.ids.append(doc_id)
        self.lengths.append(counts.total())
        self.bytes += len(text or "")
        # The smaller side is looked up in the other.
        if len(counts) <= len(wanted):
            self.found += [(wanted[t], row, n) for t, n in counts.items() if t in wanted]
        else:
            self.found += [(i, row, counts[t]) for t, i in wanted.items() if t in counts]

    def rows(self, unit: int, names: list[str], first: bool) -> pa.RecordBatch:
        """A row per term; in the first pass also one without a term, with the ids and lengths of all documents."""
        term, row, tf = np.array(self.found, np.int64).reshape(-1, 3).T
        order = np.argsort(term, kind="stable")
        term, row, tf = term[order], row[order], tf[order]
        lengths = np.array(self.lengths, np.int64)
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        out = [(unit, None, _longs([_NO_ID if i is None else i for i in self.ids]), None, _longs(lengths))] if first else []
        for a, b in zip(starts, np.append(starts, len(term))[1:], strict=True):
            own = row[a:b]
            out.append((unit, names[term[a]], own.astype("<u4").tobytes(), tf[a:b].astype("<u4").tobytes(), _longs(lengths[own])))
        columns = zip(zip(*out, strict=True), _POSTING.types, strict=True) if out else ((None, t) for t in _POSTING.types)
        return pa.RecordBatch.from_arrays([pa.array(c or [], t) for c, t in columns], schema=_POSTING)


def _longs(values) -> bytes:
    return np.asarray(values, "<i8").tobytes()


def postings(docs: DataFrame, terms: list[str], first: bool) -> DataFrame:
    """Posting rows of a block of terms. Units are numbered alike in every pass over the same written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        wanted = {t.encode(): i for i, t in enumerate(terms)}
        number, unit = TaskContext.get().partitionId() << 32, _Unit()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                unit.add(doc_id, text.as_py(), wanted)
                if unit.bytes >= UNIT_BYTES or len(unit.ids) >= UNIT_ROWS:
                    yield unit.rows(number, terms, first)
                    number, unit = number + 1, _Unit()
        if unit.ids:
            yield unit.rows(number, terms, first)

    return docs.mapInArrow(run, _POSTING_SQL)


_STATE = "bundle bigint, unit bigint, items binary, docs binary, scores binary"


def _numbers(raw: bytes | None, kind: str) -> np.ndarray:
    return np.frombuffer(raw or b"", kind).astype(np.int64)


class _Table:
    """Sparse scores of a bundle in a unit: sorted keys (item, document) and their sums."""

    def __init__(self, keys: np.ndarray, scores: np.ndarray) -> None:
        self.keys, self.scores = keys, scores

    @staticmethod
    def of(rows: pa.Table) -> _Table:
        if not len(rows):
            return _Table(np.empty(0, np.int64), np.empty(0, np.int64))
        row = rows.to_pylist()[0]
        return _Table(_numbers(row["items"], "<i8") << 32 | _numbers(row["docs"], "<u4"), _numbers(row["scores"], "<i8"))

    def item(self, slot: int) -> slice:
        return slice(*np.searchsorted(self.keys, [slot << 32, (slot + 1) << 32]))


def _top_cut(scores: np.ndarray, top: int) -> int:
    """The ``top``-th score, or 0 when there are fewer."""
    return int(np.partition(scores, len(scores) - top)[len(scores) - top]) if len(scores) >= top else 0


def _stage(n_docs: int, n_terms: int, top: int, last: bool):
    """Adds a stage's contributions to the bundle's table of a unit."""

    def contributions(row: dict) -> tuple[np.ndarray, np.ndarray]:
        tf, length = _numbers(row["tf"], "<u4"), _numbers(row["lengths"], "<i8")
        m = 100 - 50 + (50 * length * n_docs) // n_terms
        return _numbers(row["docs"], "<u4"), row["weight"] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))

    def run(key: tuple, state: pa.Table, found: pa.Table) -> pa.Table:
        table = _Table.of(state)
        added: dict[int, list] = {}
        bounds: dict[int, tuple[int, int]] = {}
        for row in found.to_pylist():
            docs, part = contributions(row)
            for i in row["items"]:
                added.setdefault(i["slot"], []).append((docs, part))
                bounds[i["slot"]] = i["before"], i["after"]
        keys, scores = [], []
        old = np.unique(table.keys >> 32).tolist()
        for slot in sorted({*old, *added}):
            own = table.item(slot)
            docs, sums = table.keys[own] & 0xFFFFFFFF, table.scores[own]
            if slot in added:
                before, after = bounds[slot]
                every = np.concatenate([docs, *[d for d, _ in added[slot]]])
                part = np.concatenate([sums, *[p for _, p in added[slot]]])
                merged, back = np.unique(every, return_inverse=True)
                total = np.zeros(len(merged), np.int64)
                np.add.at(total, back, part)
                # New documents count only while they can still reach the unit's cut.
                if before < _top_cut(sums, top):
                    known = np.isin(merged, docs, assume_unique=True)
                    merged, total = merged[known], total[known]
                keep = total + after >= _top_cut(total, top)
                docs, sums = merged[keep], total[keep]
            keep = sums >= max(_top_cut(sums, top), 1) if last else slice(None)
            keys.append(slot << 32 | docs[keep])
            scores.append(sums[keep])
        keys = np.concatenate(keys) if keys else np.empty(0, np.int64)
        scores = np.concatenate(scores) if scores else np.empty(0, np.int64)
        bundle, unit = (k.as_py() for k in key)
        if last:
            return pa.table(
                {"bundle": np.full(len(keys), bundle), "unit": np.full(len(keys), unit), "slot": keys >> 32,
                 "doc": keys & 0xFFFFFFFF, "score": scores}
            )
        packed = (keys >> 32).astype("<i8").tobytes(), (keys & 0xFFFFFFFF).astype("<u4").tobytes(), _longs(scores)
        return pa.table(
            {"bundle": [bundle], "unit": [unit]} | {n: pa.array([v], pa.binary()) for n, v in zip(("items", "docs", "scores"), packed, strict=True)}
        )

    return run


def _query_terms(items: DataFrame, found: DataFrame, n_docs: int, bundle: int) -> DataFrame:
    """Per bundle and term: stage, weight, and the items that hold it with what their terms can add before and after it."""
    df = found.groupBy("term").agg(F.sum(F.octet_length("docs") / 4).cast("bigint").alias("df"))
    ratio = F.lit(2.0 * n_docs + 2) / (2.0 * F.col("df") + 1)
    stage = sum(((F.col("df") >= s * n_docs).cast("int") for s in SHARES), F.lit(0))
    known = df.select("term", F.floor(1000 * F.log(ratio)).alias("weight"), stage.alias("stage"))
    held = items.select("item", "slot", "bundle", F.explode("terms").alias("term")).join(known, "term")
    rest = Window.partitionBy("item").orderBy("stage").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    later = Window.partitionBy("item").orderBy("stage").rangeBetween(1, Window.unboundedFollowing)
    bound = lambda w: F.coalesce(F.sum("weight").over(w), F.lit(0)) * CEILING
    held = held.withColumns({"before": bound(rest), "after": bound(later)})
    return held.groupBy("bundle", "term", "stage", "weight").agg(
        F.collect_list(F.struct("slot", "before", "after")).alias("items")
    )


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, bundle: int = BUNDLE, terms: int = TERMS) -> DataFrame:
    """The ``top`` best documents (``doc_id, text``) of each item (``item_id, text``): ``item_id, rank, doc_id, score``.

    Scores above 0 only; equal scores by doc_id, null ids (shown as null) before all others. Null and empty texts hold no
    terms: as documents they are not counted, as items they have no rows. Rows with equal ids are documents of their own;
    equal item rows count once, equal item ids with different texts are ranked apart. Other columns do not matter. Empty
    tables give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    listed = queries.select("item_id", "text").distinct().select("item_id", _terms(F.col("text")).alias("terms"))
    listed = scratch.table(listed.where("size(terms) > 0").withColumn("item", F.monotonically_increasing_id()), "listed")
    count = listed.count()
    bundles = max(1, -(-count // bundle))
    dealt = listed.withColumn("bundle", F.pmod(F.xxhash64("item"), F.lit(bundles)))
    slots = Window.partitionBy("bundle").orderBy("item")
    items = scratch.table(dealt.withColumn("slot", F.row_number().over(slots).cast("bigint")), "items")
    wanted = scratch.table(items.select(F.explode("terms").alias("term")).distinct(), "terms")
    blocks = max(1, -(-wanted.count() // terms))
    if blocks > 1:
        # Every pass has to cut the documents into the same units.
        docs = scratch.table(docs, "documents")
    with shuffles_freed(spark):
        found = None
        for block in range(blocks):
            # At most about ``terms`` strings travel to the tasks at a time.
            names = [r.term for r in wanted.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == block).collect()]
            part = scratch.table(postings(docs, names, block == 0), f"postings-{block}")
            found = part if found is None else found.unionByName(part)
        units = found.where("term IS NULL").select("unit", F.col("docs").alias("ids"), "lengths")
        sums = units.mapInArrow(_length_sums, "n_docs bigint, n_terms bigint").agg(F.sum("n_docs"), F.sum("n_terms")).first()
        n_docs, n_terms = sums[0] or 0, sums[1] or 0
        found = found.where("term IS NOT NULL")
        asked = scratch.table(_query_terms(items, found, n_docs, bundle), "asked")
        state = None
        for stage in range(STAGES):
            last = stage == STAGES - 1
            here = found.join(asked.where(F.col("stage") == stage), "term").select(
                "bundle", "unit", "weight", "items", "docs", "tf", "lengths"
            )
            before = spark.createDataFrame([], _STATE) if state is None else state
            grouped = before.groupBy("bundle", "unit").cogroup(
                here.select(F.col("bundle").alias("b"), F.col("unit").alias("u"), "weight", "items", "docs", "tf", "lengths")
                .groupBy("b", "u")
            )
            out = "bundle bigint, unit bigint, slot bigint, doc bigint, score bigint" if last else _STATE
            state = scratch.table(grouped.applyInArrow(_stage(n_docs, n_terms, top, last), out), f"stage-{stage}")
    best = Window.partitionBy("bundle", "slot").orderBy(F.desc("score"))
    cut = state.withColumn("rn", F.rank().over(best)).where(F.col("rn") <= top).drop("rn")
    named = units.mapInArrow(_document_ids, "unit bigint, doc bigint, doc_id bigint")
    ranked = cut.join(named, ["unit", "doc"]).join(items.select("bundle", "slot", "item_id"), ["bundle", "slot"])
    order = Window.partitionBy("bundle", "slot").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "unit", "doc")
    return (
        ranked.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
        .select("item_id", "rank", "doc_id", "score")
    )


def _length_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with a term and their terms, per unit."""
    for batch in batches:
        lengths = [_numbers(raw, "<i8") for raw in batch.column("lengths").to_pylist()]
        yield pa.RecordBatch.from_pydict(
            {"n_docs": [int(np.count_nonzero(n)) for n in lengths], "n_terms": [int(n.sum()) for n in lengths]}
        )


def _document_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for unit, raw in zip(batch.column("unit").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            ids = _numbers(raw, "<i8")
            shown = pa.array(ids, mask=ids == _NO_ID)
            yield pa.RecordBatch.from_pydict({"unit": np.full(len(ids), unit), "doc": np.arange(len(ids)), "doc_id": shown})


def op13_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUERIES = {"op13_ranked_lexical_search": op13_ranked_lexical_search}
SQL = {
    "op13_ranked_lexical_search": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS terms FROM documents),
sized AS (SELECT doc_id, terms, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
whole AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM sized),
tf AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM sized)
       GROUP BY doc_id, n, term),
q AS (SELECT DISTINCT item_id, term FROM (
      SELECT item_id, unnest(regexp_extract_all({_LOWER}, '{_WORD}')) AS term FROM benchmark)),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf WHERE term IN (SELECT term FROM q) GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * big_n + 2) / (2.0::DOUBLE * df + 1)))::BIGINT AS w FROM df, whole),
scored AS (
  SELECT item_id, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * big_n) // big_l))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term), whole GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, doc_id, score,
                  row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank
           FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50"""
}
