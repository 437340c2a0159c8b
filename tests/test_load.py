"""Sources, conform, quality, dedup, upsert, rejects."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import Row, functions as F

from barlake import schemas
from barlake.functions.text import canonical_symbol, is_symbol, lenient_symbol, plain_header
from barlake.operators import conform, dedup, ingest, quality, serving, summaries, upsert
from barlake.plans import medallion
from barlake.sources import prices, snapshots, tables

T0 = dt.datetime(2024, 1, 2, 10)


def clean_row(symbol="A", day=1, close=10.0, ts=T0, run="r", **over):
    row = dict(
        symbol=symbol, date=dt.date(2024, 1, day), open=1.0, high=20.0, low=1.0, close=close, adj_close=close, volume=5,
        source_system="s", source_interval="1d", ingestion_ts=ts, ingestion_date=dt.date(2024, 1, 2), ingestion_run_id=run,
    )
    return {**row, **over}


def clean(spark, *rows):
    return spark.createDataFrame([tuple(r[n] for n in schemas.CLEAN.names) for r in rows], schemas.CLEAN)


def values(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize(
    "over, label",
    [
        ({"symbol": None}, "symbol_null"), ({"date": None}, "date_null"), ({"open": None}, "open_null"),
        ({"high": None}, "high_null"), ({"low": None}, "low_null"), ({"close": None}, "close_null"),
        ({"volume": None}, "volume_null"), ({"high": 0.5}, "high_lt_low"), ({"volume": -1}, "volume_negative"),
        ({"symbol": None, "volume": -1}, "symbol_null"), ({"close": None, "high": 0.5}, "close_null"),
        ({"high": 0.5, "volume": -1}, "high_lt_low"), ({}, None), ({"volume": 0}, None), ({"adj_close": None}, None),
    ],
)
def test_first_broken_rule(spark, over, label):
    row = quality.label_quality(clean(spark, clean_row(**over))).first()
    assert (row.quality_issue, row.is_valid) == (label, label is None)


def test_conform_bad_values(spark):
    raw = spark.createDataFrame(
        [
            ("A", "2024-01-02 00:00:00", "1.5", "x", "NaN", "2", None, "12.0"),
            ("B", "not a date", "1", "2", "3", "4", "5", "9007199254740993"),
        ],
        "source_symbol string, Date string, Open string, High string, Low string, Close string, `Adj Close` string, Volume string",
    )
    out = {r.symbol: r for r in conform.conform(raw).collect()}
    assert (out["A"].date, out["A"].open, out["A"].high, out["A"].low, out["A"].volume) == (dt.date(2024, 1, 2), 1.5, None, None, 12)
    assert (out["B"].date, out["B"].adj_close, out["B"].volume) == (None, 5.0, 9007199254740993)
    assert out["A"].source_system is None
    assert conform.conform(raw).schema.simpleString() == schemas.CLEAN.simpleString()


def test_conform_nan_and_header_preference(spark):
    raw = spark.createDataFrame([Row(source_symbol="A", Close=float("nan"), close_=1.0, volume=float("nan"))])
    raw = raw.withColumn("Open", F.lit(3.0))
    row = conform.conform(raw).first()
    assert (row.close, row.volume, row.open, row.high) == (None, None, 3.0, None)


def test_newest_version_ties_and_missing_times(spark):
    rows = clean(
        spark,
        clean_row(close=1.0, ts=None), clean_row(close=2.0), clean_row(close=3.0, run="z"),
        clean_row(day=2, ts=None, close=7.0), clean_row(day=2, ts=None, close=8.0),
    )
    assert values(dedup.latest_version(rows), "date", "close") == [(dt.date(2024, 1, 1), 3.0), (dt.date(2024, 1, 2), 8.0)]


LATER, EARLIER = T0 + dt.timedelta(hours=1), T0 - dt.timedelta(hours=1)


@pytest.mark.parametrize(
    "stored_ts, new_ts, taken",
    [(T0, LATER, True), (T0, T0, True), (T0, EARLIER, False), (None, T0, False), (T0, None, False), (None, None, False)],
)
def test_upsert_rule(spark, stored_ts, new_ts, taken):
    stored = clean(spark, clean_row(close=1.0, ts=stored_ts), clean_row(day=2, close=5.0))
    fresh = clean(spark, clean_row(close=2.0, ts=new_ts), clean_row(day=3, close=6.0, ts=None))
    merged = upsert.merge_newer(stored, fresh)
    assert values(merged, "close") == sorted([(2.0 if taken else 1.0,), (5.0,), (6.0,)])


@pytest.mark.parametrize("buckets", [None, 3])
def test_upsert_table_is_idempotent_and_leaves_others(spark, namespace, buckets):
    table = f"{namespace}.clean"
    first = clean(spark, clean_row("A"), clean_row("B", close=3.0), clean_row("C", close=4.0))
    upsert.upsert_table(first, table, buckets)
    fresh = clean(spark, clean_row("A", close=11.0, ts=LATER), clean_row("A", day=2, close=12.0))
    for _ in range(2):
        upsert.upsert_table(fresh, table, buckets)
    expected = [("A", 11.0), ("A", 12.0), ("B", 3.0), ("C", 4.0)]
    assert values(spark.table(table), "symbol", "close") == expected
    with pytest.raises(ValueError, match="symbol buckets"):
        upsert.upsert_table(fresh, table, 5)


def files_of(spark, table, year):
    """Which commit wrote the files of each bucket of a year that a reader of the table sees."""
    live = snapshots.live_folders(spark, table, snapshots.current(spark, table))
    return {tuple(r) for r in live.filter(F.year("bar_year") == year).select("commit_id", "symbol_bucket").collect()}


def test_a_new_week_leaves_older_years_alone(spark, namespace):
    table = f"{namespace}.clean"
    old = [clean_row(s, date=dt.date(2023, m, 5)) for s in "ABCDEFGH" for m in (10, 11, 12)]
    upsert.upsert_table(clean(spark, *old, *[clean_row(s) for s in "ABCDEFGH"]), table, 3)
    before = files_of(spark, table, 2023)
    week = clean(spark, *[clean_row(s, day, close=50.0, ts=LATER) for s in "ABCDEFGH" for day in range(1, 6)])
    upsert.upsert_table(week, table)
    assert before and before == files_of(spark, table, 2023)
    assert spark.table(table).count() == 24 + 40 and spark.table(table).filter("close = 50").count() == 40
    upsert.upsert_table(week.limit(0), table)
    assert spark.table(table).count() == 64


def test_buckets_follow_from_the_first_load(spark, namespace, monkeypatch):
    """A wide first load makes several buckets; one new bar then rewrites the files of one of them."""
    monkeypatch.setattr(tables, "FILE_BYTES", 10 * tables.BAR_BYTES)
    table = f"{namespace}.clean"
    upsert.upsert_table(clean(spark, *[clean_row(f"S{i}") for i in range(60)]), table)
    assert tables.create_clean_table(spark, table) == 6
    before = files_of(spark, table, 2024)
    upsert.upsert_table(clean(spark, clean_row("S1", day=2, close=50.0)), table)
    after = files_of(spark, table, 2024)
    assert len(before - after) == 1 and spark.table(table).count() == 61
    assert [tables.buckets_for(n) for n in (0, 10, 11, 100)] == [1, 1, 2, 10]


@pytest.mark.parametrize("step", ["insert_files", "insert_list", "point", "show"])
def test_a_job_that_ends_inside_a_commit_leaves_a_whole_table(spark, namespace, monkeypatch, step):
    """Ended between any two steps: readers see the old rows; the next load ends where it should."""
    table = f"{namespace}.clean"
    old = clean(spark, *[clean_row(s, day, close=1.0) for s in "AB" for day in (1, 2)])
    upsert.upsert_table(old, table)
    fresh = clean(spark, clean_row("A", close=2.0, ts=LATER), clean_row("C", close=3.0))
    target = {"point": (snapshots, "_point"), "show": (snapshots, "_show")}.get(step, (type(spark.range(1).write), "insertInto"))
    real, calls = getattr(*target), []

    def dying(*args, **kwargs):
        calls.append(1)
        if len(calls) == (2 if step == "insert_list" else 1):
            raise KeyboardInterrupt(step)
        return real(*args, **kwargs)

    with monkeypatch.context() as patch:
        patch.setattr(*target, dying)
        with pytest.raises(KeyboardInterrupt):
            upsert.upsert_table(fresh, table)
    before = [("A", 1.0), ("A", 1.0), ("B", 1.0), ("B", 1.0)]
    done = sorted([("A", 2.0), ("A", 1.0), ("B", 1.0), ("B", 1.0), ("C", 3.0)])
    spark.catalog.refreshTable(table)
    assert values(spark.table(table), "symbol", "close") == before
    # With the version file made the commit stands, and the view is mended.
    committed = step == "show"
    assert snapshots.repair(spark, table).number == (2 if committed else 1)
    assert values(spark.table(table), "symbol", "close") == (done if committed else before)
    upsert.upsert_table(fresh, table)
    assert values(spark.table(table), "symbol", "close") == done
    snapshots.vacuum(spark, table)
    assert values(spark.table(table), "symbol", "close") == done


def test_of_two_writers_the_later_one_fails(spark, namespace):
    table = f"{namespace}.clean"
    upsert.upsert_table(clean(spark, clean_row("A")), table)
    base = snapshots.current(spark, table)
    upsert.upsert_table(clean(spark, clean_row("B")), table)
    rows = tables.with_folders(clean(spark, clean_row("C")), 1)
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(spark, table, base, rows, rows)
    with pytest.raises(snapshots.Conflict):
        snapshots._point(spark, table, snapshots.Version(2, "late"))
    assert values(spark.table(table), "symbol") == [("A",), ("B",)]
    assert len(snapshots.vacuum(spark, table)) >= 1 and spark.table(table).count() == 2


def test_reject_append_opens_the_folders_of_its_own_months(spark, namespace):
    table = f"{namespace}.rejects"
    made = lambda *days: quality.rejected_rows(
        quality.label_quality(clean(spark, *[clean_row(open=None, ingestion_date=d) for d in days]))
    )
    months = [dt.date(2024, m, 3) for m in (1, 2, 3)]
    tables.append_rejects(made(*months, None), table)
    rows = tables.with_digest(made(months[1], months[1]))
    beside = tables.stored_beside(rows, spark.table(table))
    assert {r[0] for r in beside.select("load_month").collect()} == {dt.date(2024, 2, 1)}
    scan = beside._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(load_month" in scan and "2024-02-01" in scan
    for again in (made(months[1], None, None), made(*months)):
        tables.append_rejects(again, table)
        assert spark.table(table).count() == 4
    tables.append_rejects(made(dt.date(2024, 2, 4)), table)
    assert spark.table(table).count() == 5


def test_a_load_reads_the_raw_rows_once(spark, namespace):
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    raw = clean(spark, clean_row(), clean_row(day=2, open=None), clean_row(day=3)).withColumnRenamed("symbol", "source_symbol")
    counts = medallion.refresh_clean(raw.mapInArrow(watched, raw.schema), f"{namespace}.clean", f"{namespace}.rejects").first()
    assert counts == Row(total_rows=3, valid_rows=2, rejected_rows=1) and seen.value == 3


def test_space_filling_files_skip_by_either_column(spark, tmp_path):
    """A filter on one column alone meets few files, for each column; a hot value is spread over several."""
    rows = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("issue"), F.col("id") % 40)).alias("issue"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") * 7919 % 1000).cast("int")).alias("day"), "id",
    )
    tables.space_filled(rows, ["issue", "day"], 16).write.parquet(f"{tmp_path}/curve")
    stored = spark.read.parquet(f"{tmp_path}/curve").withColumn("file", F.input_file_name())
    assert stored.count() == 20000 and stored.select("id").distinct().count() == 20000
    ranges = stored.groupBy("file").agg(F.min("issue").alias("i0"), F.max("issue").alias("i1"), F.min("day").alias("d0"), F.max("day").alias("d1"))
    listed = ranges.collect()
    meets = lambda lo, hi, v: sum(r[lo] <= v <= r[hi] for r in listed)
    assert len(listed) == 16
    days = [meets("d0", "d1", dt.date(2020, 1, 1) + dt.timedelta(d)) for d in range(0, 1000, 50)]
    issues = [meets("i0", "i1", f"issue{i}") for i in range(40)]
    assert sum(days) / len(days) <= 9 and sum(issues) / len(issues) <= 9, (days, issues)
    assert stored.filter("issue = 'hot'").select("file").distinct().count() >= 4
    empty = tables.space_filled(rows.limit(0), ["issue", "day"], 4)
    assert empty.count() == 0


def test_summaries_merge_like_one_read_of_the_log(spark, namespace):
    rows = [clean_row(s, day, ts=t) for s in ("A", "B") for day, t in ((1, T0), (2, LATER), (2, T0))]
    rows += [clean_row("A", date=dt.date(1961, 5, 4)), clean_row("A", date=dt.date(1970, 1, 1)), clean_row(None), clean_row("N", date=None)]
    log = clean(spark, *rows).withColumnRenamed("symbol", "source_symbol").withColumn("date", F.col("date").cast("timestamp"))
    table = f"{namespace}.summaries"
    for k in (0, 1, 0):
        summaries.append_summary(log.filter(F.hash("date", "ingestion_ts") % 2 == k), f"load-{k}", table)
    got = summaries.status(summaries.stored(spark, table))
    plain = serving.ingestion_status(log.filter(F.hash("date", "ingestion_ts") % 2 >= 0))
    names = plain.columns
    assert values(got, *names) == values(plain, *names)


def test_empty_symbol_keeps_its_history(spark, namespace):
    table = f"{namespace}.clean_prices"
    for day in (2, 3):
        upsert.upsert_table(clean(spark, clean_row("", day)), table)
    assert spark.table(table).count() == 2


def test_upsert_of_many_symbols_and_months(spark, namespace):
    """More folders than rows a folder; every key is there once, with the newer close."""
    table = f"{namespace}.clean"
    rows = [clean_row(f"S{i}", date=dt.date(2000 + i % 7, 1 + i % 12, 3)) for i in range(300)]
    upsert.upsert_table(clean(spark, *rows), table, 16)
    upsert.upsert_table(clean(spark, *[{**r, "close": 2.0, "ingestion_ts": LATER} for r in rows[::2]]), table)
    upsert.upsert_table(clean(spark, *[{**r, "close": 3.0, "ingestion_ts": EARLIER} for r in rows]), table)
    assert values(spark.table(table), "symbol", "close") == sorted((r["symbol"], 10.0 if i % 2 else 2.0) for i, r in enumerate(rows))


def test_refresh_twice_changes_nothing(spark, namespace):
    raw = clean(
        spark, clean_row(), clean_row(day=2, open=None), clean_row(symbol=None, ts=None), clean_row(day=3, volume=-2)
    ).withColumnRenamed("symbol", "source_symbol")
    names = f"{namespace}.clean", f"{namespace}.rejects"
    counts = [medallion.refresh_clean(raw, *names).first() for _ in range(2)]
    assert counts[0] == counts[1] == Row(total_rows=4, valid_rows=1, rejected_rows=3)
    assert spark.table(names[0]).count() == 1
    assert values(spark.table(names[1]), "quality_issue") == [("open_null",), ("symbol_null",), ("volume_negative",)]


def test_loads_by_ingestion_date_end_like_one_load(spark, namespace):
    log = clean(
        spark, clean_row(close=1.0), clean_row(day=2, open=None),
        clean_row(close=2.0, ts=LATER, ingestion_date=dt.date(2024, 1, 3)), clean_row(day=3, ingestion_date=dt.date(2024, 1, 3)),
    ).withColumnRenamed("symbol", "source_symbol")
    tables.append_raw(log, f"{namespace}.raw")
    raw = spark.table(f"{namespace}.raw")
    medallion.refresh_clean(raw.filter("ingestion_date < '2024-01-03'"), f"{namespace}.a", f"{namespace}.ra")
    step = medallion.refresh_clean(raw, f"{namespace}.a", f"{namespace}.ra", since="2024-01-03")
    medallion.refresh_clean(raw, f"{namespace}.b", f"{namespace}.rb", buckets=4)
    assert step.first().total_rows == 2
    for one, other in (("a", "b"), ("ra", "rb")):
        names = schemas.CLEAN.names
        assert values(spark.table(f"{namespace}.{one}"), *names) == values(spark.table(f"{namespace}.{other}"), *names)


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_file_sources(spark, tmp_path, fmt):
    rows = spark.createDataFrame(
        [("A", "1d", T0, 1.0, 2.0, 0.5, 1.5, 1.5, 9.0), ("B", "1d", T0, 1.0, 2.0, 0.5, 1.5, None, 9.0)], schemas.SOURCE_BARS
    )
    writer = rows.write.option("header", "true") if fmt == "csv" else rows.write
    writer.format(fmt).save(f"{tmp_path}/bars")
    read = prices.read_files(spark, f"{tmp_path}/bars", fmt)
    assert sorted(map(tuple, read.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert prices.bars_since(read, ["A"], "2024-01-01", strict=True).count() == 1
    with pytest.raises(prices.NoPriceData):
        prices.bars_since(read, ["A"], "2025-01-01", strict=True)


def test_filters_reach_the_scan(spark, tmp_path):
    rows = spark.createDataFrame([("A", "1d", T0, 1.0, 2.0, 0.5, 1.5, 1.5, 9.0)], schemas.SOURCE_BARS)
    rows.write.parquet(f"{tmp_path}/bars")
    wanted = prices.bars_since(prices.read_files(spark, f"{tmp_path}/bars"), ["A"], "2024-01-01").select("close")
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source_symbol,A)" in plan or "In(source_symbol" in plan
    assert "GreaterThanOrEqual(date" in plan
    assert "ReadSchema: struct<source_symbol:string,source_interval:string,date:timestamp,close:double>" in plan


def test_incremental_start(spark):
    wanted = ingest.requested_symbols(spark, ["A", "B"])
    raw = spark.createDataFrame([("A", T0), ("A", T0 - dt.timedelta(3)), ("C", T0)], "source_symbol string, date timestamp")
    starts = dict(ingest.incremental_start(wanted, raw).collect())
    assert starts == {"A": dt.date(2023, 12, 26), "B": dt.date(1999, 1, 1)}
    assert set(dict(ingest.incremental_start(wanted, raw, whole_table=True).collect()).values()) == {dt.date(2023, 12, 26)}
    assert set(dict(ingest.incremental_start(wanted, ingest.raw_or_none(spark, "no_such_table")).collect()).values()) == {dt.date(1999, 1, 1)}


def test_one_run_id_per_stamp(spark):
    stamped = ingest.stamp_lineage(spark.range(100).repartition(4), "files", "1d", symbol="A")
    assert stamped.select("ingestion_run_id").distinct().count() == 1
    assert stamped.first().source_symbol == "A"


@pytest.mark.parametrize(
    "header, plain", [("Adj Close", "adj_close"), (" Open ", "open"), (("Close", "A"), "close"), ("a  B", "a__b")]
)
def test_plain_header(header, plain):
    assert plain_header(header) == plain


@pytest.mark.parametrize(
    "text, symbol, ok",
    [
        ("  brk.b\t\n", "BRK.B", True), (" x ", "X", True), ("A B", "A B", False), ("", "", False),
        ("ABCDEFGHIJ", "ABCDEFGHIJ", True), ("ABCDEFGHIJK", "ABCDEFGHIJK", False), ("a\nb", "A\nB", False), ("^GSPC", "^GSPC", False),
    ],
)
def test_strict_symbols(spark, text, symbol, ok):
    row = spark.createDataFrame([(text,)], "t string").select(canonical_symbol(F.col("t")).alias("s")).select("s", is_symbol(F.col("s")).alias("ok")).first()
    assert (row.s, row.ok) == (symbol, ok) == (text.strip().upper(), ok)


@pytest.mark.parametrize("text, symbol", [(" b#rk.b!", "BRK.B"), (None, ""), ("abcdefghijklm", "ABCDEFGHIJ"), ("~~", "")])
def test_lenient_symbols(spark, text, symbol):
    assert spark.createDataFrame([(text,)], "t string").select(lenient_symbol(F.col("t"))).first()[0] == symbol


def test_series_checks(spark):
    rows = clean(spark, clean_row("A"), clean_row("B", close=0.0), clean_row("C", volume=-1), clean_row("D", volume=None))
    assert values(quality.series_violations(rows).filter("is_usable"), "symbol") == [("A",)]
    quality.require_usable(rows.filter("symbol = 'A'"))
    with pytest.raises(quality.SeriesError, match="B, C, D"):
        quality.require_usable(rows)
    with pytest.raises(quality.SeriesError, match="no price rows"):
        quality.require_usable(rows.filter("symbol = 'Z'"))


def test_snapshot_overwrite_replaces_schema(spark, namespace):
    tables.overwrite_snapshot(spark.range(3), f"{namespace}.snap")
    tables.overwrite_snapshot(spark.range(2).withColumn("x", F.lit("y")), f"{namespace}.snap")
    assert spark.table(f"{namespace}.snap").columns == ["id", "x"]
    assert spark.table(f"{namespace}.snap").count() == 2
