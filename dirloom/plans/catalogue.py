"""All registered queries of the core and, where SQL can say them, their equivalents for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import engine, found

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {f"p{n}_found": getattr(found, f"p{n}_found") for n in (1, 2, 3, 4, 6)} | engine.QUERIES
ORACLES: dict[str, str] = found.ORACLES | engine.ORACLES
