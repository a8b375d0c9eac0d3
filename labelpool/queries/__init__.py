"""Registered queries over the test tables and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, tuple[Query, str | None]]:
    from labelpool.queries import pool, records, rounds, text

    out: dict[str, tuple[Query, str | None]] = {}
    for module in (pool, rounds, text, records):
        for name, entry in module.QUERIES.items():
            if name in out:
                raise ValueError(f"query {name} is registered twice")
            out[name] = entry
    return out
