"""DuckDB SQL for the registered queries, written apart from the Spark code."""

from __future__ import annotations


def all_sql() -> dict[str, str]:
    from oracles import forecast, load, serve

    return {**load.SQL, **forecast.SQL, **serve.SQL}
