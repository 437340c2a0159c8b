"""Epoch milliseconds and freshness text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def iso_from_millis(millis: Column) -> Column:
    """ISO-8601 UTC text; a fraction only when there is one; 0, null and bad text give null."""
    ms = millis.try_cast("bigint")
    utc = F.to_utc_timestamp(F.timestamp_millis(ms), F.current_timezone())
    whole = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.when(ms % 1000 != 0, F.date_format(utc, ".SSSSSS")).otherwise(F.lit(""))
    return F.when(ms != 0, F.concat(whole, fraction, F.lit("+00:00")))


def freshness_text(updated: Column, now: Column) -> Column:
    """How long ago ``updated`` was, in whole minutes, then whole hours."""
    minutes = F.floor((F.unix_millis(now) - F.unix_millis(updated)) / F.lit(60000))
    hours = F.floor(minutes / F.lit(60))
    return (
        F.when(updated.isNull(), F.lit("No updates yet"))
        .when(minutes <= 0, F.lit("Updated just now"))
        .when(minutes == 1, F.lit("Updated 1 minute ago"))
        .when(minutes < 60, F.concat(F.lit("Updated "), minutes.cast("string"), F.lit(" minutes ago")))
        .when(hours == 1, F.lit("Updated 1 hour ago"))
        .otherwise(F.concat(F.lit("Updated "), hours.cast("string"), F.lit(" hours ago")))
    )
