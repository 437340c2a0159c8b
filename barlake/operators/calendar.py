"""Exchange sessions from the public holiday rules."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Search span, default horizon, unscheduled full-day closures.
SEARCH_DAYS = 120
HORIZON = 30
CLOSURES = (
    "1994-04-27", "2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14", "2004-06-11", "2007-01-02",
    "2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09",
)


def _nth(month: int, weekday: int, n: int) -> Column:
    """n-th weekday (Monday 0) of a month; n = -1 is the last."""
    if n > 0:
        first = F.make_date("year", F.lit(month), F.lit(1))
        return F.date_add(first, F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)) + 7 * (n - 1))
    last = F.last_day(F.make_date("year", F.lit(month), F.lit(1)))
    return F.date_sub(last, F.pmod(F.weekday(last) - F.lit(weekday), F.lit(7)))


def _observed(month: int, day: int, saturday_moves: bool = True) -> Column:
    """Sunday moves to Monday; Saturday moves to Friday or is not kept."""
    date = F.make_date("year", F.lit(month), F.lit(day))
    saturday = F.date_sub(date, 1) if saturday_moves else F.lit(None).cast("date")
    return F.when(F.weekday(date) == 6, F.date_add(date, 1)).when(F.weekday(date) == 5, saturday).otherwise(date)


def _easter() -> Column:
    """Sunday of Easter by the anonymous Gregorian computus."""
    year = F.col("year")

    def div(a: Column, b: int) -> Column:
        return F.floor(a / F.lit(b))

    century = div(year, 100)
    golden = year % 19
    epact = (
        19 * golden + century - div(century, 4) - div(century - div(century + 8, 25) + 1, 3) + 15
    ) % 30
    shift = (32 + 2 * (century % 4) + 2 * div(year % 100, 4) - epact - (year % 100) % 4) % 7
    late = div(golden + 11 * epact + 22 * shift, 451)
    days = epact + shift - 7 * late
    return F.date_add(F.make_date(year, F.lit(3), F.lit(22)), days.cast("int"))


def holidays(spark: SparkSession, first_year: int, last_year: int, closures: Iterable[str] = CLOSURES) -> DataFrame:
    """Full-day holidays (date, name) of a span of years; ten or so rows a year."""
    return holidays_of(spark.range(first_year, last_year + 1, 1, 1).select(F.col("id").cast("int").alias("year")), closures)


def holidays_around(days: DataFrame, date: str, closures: Iterable[str] = CLOSURES) -> DataFrame:
    """The same for the years in which the dates lie and the years after them, whatever they are."""
    year = F.year(date)
    years = days.select(F.explode(F.array(year, year + 1)).alias("year")).where("year IS NOT NULL").distinct()
    return holidays_of(years, closures)


def holidays_of(years: DataFrame, closures: Iterable[str] = CLOSURES) -> DataFrame:
    """Holidays of the given years (column ``year``)."""
    since = lambda year, date: F.when(F.col("year") >= year, date)
    rules = {
        "new_year": _observed(1, 1, saturday_moves=False),
        "martin_luther_king": since(1998, _nth(1, 0, 3)),
        "washington": _nth(2, 0, 3),
        "good_friday": F.date_sub(_easter(), 2),
        "memorial": _nth(5, 0, -1),
        "juneteenth": since(2022, _observed(6, 19)),
        "independence": _observed(7, 4),
        "labor": _nth(9, 0, 1),
        "thanksgiving": _nth(11, 3, 4),
        "christmas": _observed(12, 25),
    }
    named = F.array(*[F.struct(rule.alias("date"), F.lit(name).alias("name")) for name, rule in rules.items()])
    ruled = years.select(F.inline(named)).filter("date IS NOT NULL")
    extra = list(closures)
    if not extra:
        return ruled
    dates = F.array(*[F.lit(d).cast("date") for d in extra])
    one = years.sparkSession.range(0, 1, 1, 1)
    return ruled.union(one.select(F.explode(dates).alias("date"), F.lit("closure").alias("name")))


def without_holidays(days: DataFrame, closed: DataFrame) -> DataFrame:
    """Candidate days that are not holidays.

    The holiday side has 10 rows a calendar year plus the closures, so it is broadcast.
    """
    return days.join(F.broadcast(closed.select("date")), "date", "left_anti")


def with_sessions(
    last_bars: DataFrame, closed: DataFrame, horizon: int = HORIZON, search_days: int = SEARCH_DAYS
) -> DataFrame:
    """Adds ``dates``, the next ``horizon`` sessions after ``last_date``, without a shuffle.

    Looks ``search_days`` ahead; a longer horizon is cut to the sessions found there. The holidays
    (10 dates a calendar year plus the closures) come in as one array.
    """
    holiday_list = closed.agg(F.collect_list("date")).scalar()
    ahead = F.sequence(F.date_add("last_date", 1), F.date_add("last_date", search_days))
    not_closed = last_bars.withColumn("dates", F.array_except(ahead, holiday_list))
    weekdays = F.filter("dates", lambda d: F.weekday(d) < 5)
    return not_closed.withColumn("dates", F.slice(weekdays, 1, horizon))


def sessions_after(
    last_bars: DataFrame, closed: DataFrame, horizon: int = HORIZON, search_days: int = SEARCH_DAYS
) -> DataFrame:
    """The same, one row per session: (symbol, date, step)."""
    lists = with_sessions(last_bars, closed, horizon, search_days)
    return lists.select("symbol", F.posexplode("dates").alias("pos", "date")).select(
        "symbol", "date", (F.col("pos") + 1).alias("step")
    )


def last_bars(daily: DataFrame) -> DataFrame:
    return daily.groupBy("symbol").agg(F.max("date").alias("last_date"))
