"""Where queries are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, run: Callable[[SparkSession, str], DataFrame], check: str | None = None, recursive: bool = False, lists: tuple[str, ...] = ()) -> None:
    """``lists`` names array columns; they are compared as text, items joined by commas."""
    QUERIES[name] = (lambda s, d: run(s, d).withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in lists})) if lists else run
    if check:
        text = sql(check, recursive)
        if lists:
            text = f"SELECT * REPLACE ({', '.join(f"array_to_string({c}, ',') AS {c}" for c in lists)}) FROM ({text})"
        SQL[name] = text
