"""Name to query, for every registered module."""

from __future__ import annotations

import re
from collections.abc import Callable
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

from barlake.plans import forecast_queries, load_queries, signal_queries

Query = Callable[[SparkSession, str], DataFrame]


def _registered(*modules: ModuleType) -> dict[str, Query]:
    """Public functions named after an operator group and number, in file order."""
    return {
        name: f for m in modules for name, f in vars(m).items() if re.fullmatch(r"[a-l]\d+_\w+", name) and callable(f)
    }


QUERIES = _registered(load_queries, forecast_queries, signal_queries)
