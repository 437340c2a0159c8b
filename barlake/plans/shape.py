"""Final projection of a registered query: dates and times as text, doubles rounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def rounded(value: Column, digits: int) -> Column:
    """Rounded; minus zero becomes zero."""
    r = F.round(value, digits)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


def report(df: DataFrame, digits: int | None = 6, **special: int | None) -> DataFrame:
    """Digits per column, else ``digits``; None leaves a value as it is."""
    out = []
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            places = special.get(field.name, digits)
            value = value if places is None else rounded(value, places)
        elif isinstance(field.dataType, T.DateType):
            value = F.date_format(value, "yyyy-MM-dd")
        elif isinstance(field.dataType, T.TimestampType):
            value = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
        out.append(value.alias(field.name))
    return df.select(out)
