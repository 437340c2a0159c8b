"""Benchmark decontamination by winnowing, in DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlake.llm.shared import Scratch, free_name, read_table, with_row_key

# A document is hit where it holds this many consecutive words of an item (all words of a shorter item).
SPAN = 13
# Words of a hashed gram, and grams of which the least hash is kept: any span of 13 words holds a whole group.
GRAM = 5
GROUP = SPAN - GRAM + 1
# A document is contaminated if it is hit and this many times its hit words reach its words.
SHARE = 20
# Benchmark windows are broadcast up to this many bytes of text; beyond, they are shuffled.
BROADCAST_BYTES = 8 << 20

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-case A-Z, then runs of a-z, 0-9 and characters beyond ASCII."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    folded = F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )
    return F.array_remove(F.split(F.coalesce(folded, F.lit("")), _GAP), "")


def _positions(length: Column, width: int) -> Column:
    """1 to length - width + 1, or none."""
    return F.when(length >= width, F.sequence(F.lit(1), length - (width - 1))).otherwise(
        F.array().cast("array<int>")
    )


def _gram_hash(words: str, at: Column, width: int, kind: int) -> Column:
    # Single elements: a slice inside a lambda copies its whole array.
    return F.xxhash64(*[F.get(words, at + (j - 1)) for j in range(width)], F.lit(kind))


def _gram_hashes(words: str, width: int, kind: int) -> Column:
    return F.transform(_positions(F.size(words), width), lambda i: _gram_hash(words, i, width, kind))


def _least(hashes: str, at: Column) -> Column:
    return F.least(*[F.get(hashes, at + (j - 1)) for j in range(GROUP)])


def benchmark_windows(items: DataFrame) -> DataFrame:
    """``(item_id, span, width, fp)``: every window of an item and the fingerprint it is found by."""
    words = items.select("item_id", words_of(F.col("text")).alias("words"))
    words = words.withColumn("n", F.size("words")).where("n > 0")
    grams = words.where(F.col("n") >= SPAN).withColumn("hashes", _gram_hashes("words", GRAM, SPAN))
    long = grams.select("item_id", "words", "hashes", F.explode(_positions(F.col("n"), SPAN)).alias("at")).select(
        "item_id",
        F.concat_ws(" ", F.slice("words", F.col("at"), SPAN)).alias("span"),
        F.lit(SPAN).alias("width"),
        _least("hashes", F.col("at")).alias("fp"),
    )
    short = words.where(F.col("n") < SPAN)
    fp = F.lit(None).cast("bigint")
    for width in range(1, SPAN):
        fp = F.when(F.col("n") == width, _gram_hash("words", F.lit(1), width, width)).otherwise(fp)
    short = short.select("item_id", F.concat_ws(" ", "words").alias("span"), F.col("n").alias("width"), fp.alias("fp"))
    return long.unionByName(short).distinct()


def fingerprints(docs: DataFrame, short: list[int]) -> DataFrame:
    """``row_key, doc_id, n_words, fps``: winnowed grams, and all grams of the widths of short items."""
    words = docs.select("row_key", "doc_id", words_of(F.col("text")).alias("words"))
    grams = words.withColumn("hashes", _gram_hashes("words", GRAM, SPAN))
    kept = [F.transform(_positions(F.size("hashes"), GROUP), lambda i: _least("hashes", i))]
    kept += [_gram_hashes("words", width, width) for width in short]
    return grams.select(
        "row_key",
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        F.array_distinct(F.concat(*kept)).alias("fps"),
    )


def hits(docs: DataFrame, windows: DataFrame, widths: list[int]) -> DataFrame:
    """``(row_key, start, width, span)``: every occurrence of a window in the given documents."""
    words = docs.dropDuplicates(["row_key"]).select("row_key", words_of(F.col("text")).alias("words"))
    spans = words.select("row_key", "words", F.explode(F.array(*[F.lit(w) for w in widths])).alias("width"))
    ends = F.size("words") - F.col("width") + 1
    at = spans.where(ends >= 1).select("row_key", "words", "width", F.explode(F.sequence(F.lit(1), ends)).alias("start"))
    found = at.select("row_key", "start", "width", F.concat_ws(" ", F.slice("words", "start", "width")).alias("span"))
    return found.join(windows.select("span", "width").distinct(), ["span", "width"], "left_semi")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``row_key, doc_id, n_words, n_hit, n_items, item_ids, contaminated`` for every row of ``docs``.

    Columns ``doc_id, text`` and ``item_id, text`` are used; others, also of these result names, do not matter.
    Null texts have no words; items without words have no windows. Repeated rows get the same result each; repeated
    items count once; an item with a null id marks words but is not listed. With no items nothing is hit.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "winnowing")
    keyed = with_row_key(docs.select("doc_id", "text"), "doc_id", "text")
    windows = scratch.table(benchmark_windows(items), "windows")
    size, widths = windows.agg(
        F.coalesce(F.sum(F.octet_length("span") + 32), F.lit(0)), F.sort_array(F.collect_set("width"))
    ).first()
    marked = scratch.table(fingerprints(keyed, [w for w in widths if w < SPAN]), "fingerprints")
    small = F.broadcast if size <= BROADCAST_BYTES else lambda df: df
    rows = marked.select("row_key", F.explode("fps").alias("fp"))
    near = rows.join(small(windows.select("fp").distinct()), "fp", "left_semi").select("row_key").distinct()
    candidates = scratch.table(near, "candidates")
    found = hits(keyed.join(candidates, "row_key", "left_semi"), small(windows), widths or [SPAN])
    found = scratch.table(found, "hits")

    by_start = found.groupBy("row_key", "start").agg(F.max("width").alias("width"))
    end = F.col("start") + F.col("width")
    before = Window.partitionBy("row_key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    new = end - F.least(end, F.greatest("start", F.coalesce(F.max(end).over(before), "start")))
    n_hit = by_start.select("row_key", new.alias("new")).groupBy("row_key").agg(F.sum("new").alias("n_hit"))
    listed = (
        found.select("row_key", "span").distinct()
        .join(small(windows.select("span", "item_id")), "span")
        .groupBy("row_key").agg(F.collect_set(F.col("item_id").cast("string")).alias("item_ids"))
    )
    per_row = n_hit.join(listed, "row_key", "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    ids = F.array_sort(F.coalesce("item_ids", F.array().cast("array<string>")))
    return marked.drop("fps").join(per_row, "row_key", "left").select(
        "row_key",
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size(ids).cast("bigint").alias("n_items"),
        ids.alias("item_ids"),
        ((hit > 0) & (hit * SHARE >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are not contaminated, all columns as they are."""
    bad = contamination(docs, items).where("contaminated").select("row_key")
    name = free_name(docs, "row_key")
    keyed = docs.withColumn(name, F.xxhash64("doc_id", "text"))
    return keyed.join(bad.withColumnRenamed("row_key", name), name, "left_anti").select(*docs.columns)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

SQL = {
    "op9_benchmark_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, least(len(w), 13) AS width,
           array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS span
    FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)
),
widths AS (SELECT DISTINCT width FROM windows),
grams AS (
    SELECT doc_id, i, width, array_to_string(w[i:i + width - 1], ' ') AS span
    FROM (SELECT doc_id, w, width, unnest(generate_series(1, len(w) - width + 1)) AS i FROM d, widths WHERE len(w) >= width)
),
hits AS (SELECT g.doc_id, g.i, g.width, x.item_id FROM grams g JOIN windows x ON g.span = x.span AND g.width = x.width),
covered AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(generate_series(i, i + width - 1)) AS p FROM (SELECT DISTINCT doc_id, i, width FROM hits))
    GROUP BY doc_id
),
items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
}
QUERIES = {"op9_benchmark_decontamination": op9_benchmark_decontamination}
