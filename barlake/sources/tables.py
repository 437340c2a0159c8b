"""Namespaces, tables and the write paths."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barlake import schemas
from barlake.session import work_root
from barlake.sources import snapshots

# Folder columns of the clean table, and the property that holds how many hash buckets of symbols it has.
BUCKET, PERIOD = "symbol_bucket", "bar_year"
BUCKETS_PROPERTY = "symbol_buckets"
# A bucket's year makes a file of about this size; a stored bar takes about so many bytes.
FILE_BYTES = 128 << 20
BAR_BYTES = 48
# Folder column of the reject table.
LOADED, DIGEST = "load_month", "reject_digest"


def create_namespace(spark: SparkSession, name: str, location: str | None = None) -> None:
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name}{where}")


def create_table(
    spark: SparkSession, name: str, ddl: str, partition_by: Sequence[str] = (), properties: dict[str, object] | None = None
) -> None:
    """A parquet table with a fixed layout; nothing happens when it exists."""
    parts = f" PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
    kept = ", ".join(f"'{k}' = '{v}'" for k, v in (properties or {}).items())
    more = f" TBLPROPERTIES ({kept})" if kept else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet{parts}{more}")


def buckets_for(rows_in_largest_period: int) -> int:
    """Into how many buckets of symbols a table is cut, from the rows of its largest year."""
    return max(1, -(-rows_in_largest_period * BAR_BYTES // FILE_BYTES))


def create_clean_table(spark: SparkSession, name: str, buckets: int | None = None, first_load: DataFrame | None = None) -> int:
    """Clean bars in folders of a hash bucket of symbols and a year; returns how many buckets the table has.

    A load of new bars touches the newest years only. The number of buckets is fixed when the table is made: as given,
    or from the size of the first load.
    """
    if not snapshots.exists(spark, name):
        if buckets is None and first_load is not None:
            years = first_load.groupBy(F.trunc("date", "YEAR")).count()
            buckets = buckets_for(years.agg(F.max("count")).first()[0] or 0)
        folders = {BUCKET: "int", PERIOD: "date"}
        snapshots.create(spark, name, schemas.CLEAN_DDL, folders, {BUCKETS_PROPERTY: buckets or 1})
    found = snapshots.properties(spark, name).get(BUCKETS_PROPERTY)
    if found is None or (buckets is not None and int(found) != buckets):
        raise ValueError(f"{name} has {found or 'no'} symbol buckets, not {buckets}")
    return int(found)


def with_folders(rows: DataFrame, buckets: int) -> DataFrame:
    """Adds the folder columns; they are never null for valid bars, whatever the symbol."""
    bucket = F.pmod(F.xxhash64("symbol"), F.lit(buckets)).cast("int")
    return rows.withColumns({BUCKET: bucket, PERIOD: F.trunc("date", "YEAR")})


def create_reject_table(spark: SparkSession, name: str) -> None:
    """Rejects with a digest of all their columns, in folders of the month they were loaded in."""
    create_table(spark, name, f"{schemas.REJECT_DDL}, {DIGEST} bigint, {LOADED} date", [LOADED])


def append_raw(df: DataFrame, table: str, cluster_by: Sequence[str] = ("source_symbol", "date")) -> None:
    """Append log partitioned by ingestion date, clustered by symbol."""
    rows = clustered(df, *cluster_by) if cluster_by else df
    rows.write.mode("append").format("parquet").partitionBy("ingestion_date").saveAsTable(table)


def clustered(df: DataFrame, first: str, *others: str) -> DataFrame:
    """Rows gathered by the first column and sorted by all, so file statistics let readers skip.

    The rebalance hint evens out the files: small groups share one, and a value that holds a large
    share of the rows, whatever its other columns say, is split over several tasks.
    """
    return df.hint("rebalance", first).sortWithinPartitions(first, *others)


def _order_code(df: DataFrame, name: str) -> Column:
    """A number that keeps the order of the column: of text the first seven bytes decide."""
    kind, column = dict(df.dtypes)[name], F.col(name)
    if kind == "string":
        head = F.rpad(F.hex(F.substring(column.cast("binary"), 1, 7)), 14, "0")
        return F.conv(head, 16, 10).cast("bigint")
    if kind == "date":
        return F.unix_date(column).cast("bigint")
    return F.unix_micros(column) if kind == "timestamp" else column.cast("double")


def _rank(code: Column, bounds: list, bits: int) -> Column:
    """The share of the bounds that are not above the code, from 0 (also for null) to 2^bits - 1.

    A frequent value takes several quantiles, which then are one bound; the share spreads the ranks over all bits again.
    """
    passed = F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= code) if bounds else F.array()
    share = F.floor(F.size(passed) * ((1 << bits) - 1) / max(len(bounds), 1))
    return F.when(code.isNull(), F.lit(0)).otherwise(share).cast("bigint")


def space_filled(df: DataFrame, columns: Sequence[str], files: int, bits: int = 6) -> DataFrame:
    """Rows dealt over ``files`` files along a curve through all the columns, so a filter on any of them skips files.

    Each column is cut at its approximate quantiles into 2^bits ranks, and the bits of the ranks are interleaved. Rows of
    one hot value still differ in the other columns' bits, and equal places on the curve are told apart by a hash of the
    row, so no value is bound to one file. Nulls come first. The quantiles take one pass with small sketches.
    """
    codes = {c: f"code_{i}" for i, c in enumerate(columns)}
    coded = df.withColumns({name: _order_code(df, c) for c, name in codes.items()})
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = coded.agg(*[F.percentile_approx(name, shares).alias(name) for name in codes.values()]).first()
    place = F.lit(0).cast("bigint")
    for j, name in enumerate(codes.values()):
        coded = coded.withColumn(f"rank_{j}", _rank(F.col(name), sorted(set(cuts[name] or [])), bits))
        for i in range(bits):
            bit = F.shiftright(F.col(f"rank_{j}"), i).bitwiseAND(F.lit(1))
            place = place.bitwiseOR(F.shiftleft(bit, i * len(columns) + len(columns) - 1 - j))
    placed = coded.withColumns({"place": place, "salt": F.xxhash64(*df.columns)})
    return placed.repartitionByRange(files, "place", "salt").sortWithinPartitions("place", *columns).select(df.columns)


def overwrite_snapshot(df: DataFrame, table: str) -> None:
    """Replaces rows and schema of a snapshot table."""
    df.write.mode("overwrite").option("overwriteSchema", "true").format("parquet").saveAsTable(table)


def unseen_rejects(rejects: DataFrame, known: DataFrame, key: Sequence[str] = schemas.REJECTS.names) -> DataFrame:
    """Different rejects that are not stored yet; rows are the same if all columns agree (nulls match nulls).

    So the stored rejects do not depend on how the log is cut into loads. Both sides meet by digest, and the columns are
    compared where digests agree. The stored side is reduced to distinct rows before the shuffle, so a row with many
    copies costs one there.
    """
    rejects = rejects.dropDuplicates(list(key))
    stored = known.select(F.col(DIGEST).alias(f"known_{DIGEST}"), *[F.col(c).alias(f"known_{c}") for c in key]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"known_{c}")) for c in key])
    return rejects.join(stored, (F.col(DIGEST) == F.col(f"known_{DIGEST}")) & same, "left_anti")


def with_digest(rejects: DataFrame) -> DataFrame:
    """Adds the digest and the folder of each reject, both functions of its own columns."""
    # Hashing skips nulls, so a mark of where they are goes along.
    marks = F.concat(*[F.col(c).isNull().cast("string") for c in schemas.REJECTS.names])
    digest = F.xxhash64(*schemas.REJECTS.names, marks)
    return rejects.withColumns({DIGEST: digest, LOADED: F.trunc("ingestion_date", "MM")})


def stored_beside(rejects: DataFrame, stored: DataFrame) -> DataFrame:
    """The stored rejects of the months of ``rejects``: equal rows have equal load dates, so no other folder matters.

    At most one value per month comes back to name the folders.
    """
    months = [r[LOADED] for r in rejects.select(LOADED).distinct().collect()]
    named = F.col(LOADED).isin([m for m in months if m is not None])
    return stored.filter(named | F.col(LOADED).isNull() if None in months else named)


def append_rejects(rejects: DataFrame, table: str) -> None:
    """Idempotent append: a second run over the same raw rows adds nothing. It opens the folders of its own months only."""
    spark = rejects.sparkSession
    create_reject_table(spark, table)
    spark.catalog.refreshTable(table)
    work_root(spark)
    rows = with_digest(rejects.select(schemas.REJECTS.names)).checkpoint()
    fresh = unseen_rejects(rows, stored_beside(rows, spark.table(table)))
    ordered = fresh.select(spark.table(table).columns).hint("rebalance", LOADED)
    ordered.sortWithinPartitions(LOADED, "quality_issue", "ingestion_date").write.insertInto(table)


def newest(df: DataFrame, n: int, *order) -> DataFrame:
    """Top-n preview (TakeOrderedAndProject: each task keeps n rows)."""
    return df.orderBy(*order).limit(n)
