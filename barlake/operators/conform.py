"""Raw rows of any known header style to the clean layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from barlake.functions.numbers import number
from barlake.functions.text import canonical_symbol, is_symbol

# Accepted headers per clean column, in order of preference, with the clean type.
HEADERS: dict[str, tuple[tuple[str, ...], str]] = {
    "symbol": (("source_symbol",), "string"),
    "date": (("Date", "date"), "date"),
    "open": (("Open", "open"), "double"),
    "high": (("High", "high"), "double"),
    "low": (("Low", "low"), "double"),
    "close": (("Close", "close"), "double"),
    "adj_close": (("Adj Close", "adj_close", "adj close"), "double"),
    "volume": (("Volume", "volume"), "bigint"),
    "source_system": (("source_system",), "string"),
    "source_interval": (("source_interval",), "string"),
    "ingestion_ts": (("ingestion_ts",), "timestamp"),
    "ingestion_date": (("ingestion_date",), "date"),
    "ingestion_run_id": (("ingestion_run_id",), "string"),
}


def present(df: DataFrame, candidates: Sequence[str]) -> Column:
    """The first candidate the frame has, else NULL; presence decides, not content."""
    found = next((c for c in candidates if c in df.columns), None)
    return F.lit(None).cast("string") if found is None else df[f"`{found}`"]


def _typed(value: Column, source: T.DataType, target: str) -> Column:
    """``try_cast`` everywhere: a value that does not parse becomes NULL and is labelled later."""
    if target == "double":
        return number(value.try_cast("double"))
    if target == "bigint":
        # Text such as "12.0" is a whole number too; a decimal keeps all digits of a long one.
        exact = value.try_cast("decimal(38,18)") if isinstance(source, T.StringType) else value
        return exact.try_cast("bigint")
    if target == "date":
        return F.to_date(value.try_cast("timestamp"))
    return value.try_cast(target)


def conform(raw: DataFrame) -> DataFrame:
    """The 13 typed clean columns; NaN counts as missing."""
    types = {f.name: f.dataType for f in raw.schema.fields}
    out = []
    for name, (candidates, target) in HEADERS.items():
        found = next((c for c in candidates if c in types), None)
        out.append(_typed(present(raw, candidates), types.get(found, T.StringType()), target).alias(name))
    return raw.select(out)


def of_symbol(df: DataFrame, symbol: str, *columns: str) -> DataFrame:
    """Rows of one symbol, pruned to ``columns``."""
    kept = df.filter(F.col("symbol") == symbol)
    return kept.select(*columns) if columns else kept


def check_symbols(df: DataFrame, column: str) -> DataFrame:
    """Adds the canonical symbol and whether it is acceptable."""
    canonical = canonical_symbol(F.col(column))
    return df.withColumns({"symbol": canonical, "is_valid": is_symbol(canonical)})
