"""Exit codes and the smoke run of all queries."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEAN, FINDINGS, USAGE = 0, 1, 2
RUN_SCHEMA = "query string, rows bigint, seconds double, error string"


def exit_code(result: DataFrame) -> int:
    """0 where nothing is wrong and 1 where something is.

    A result with ``severity`` is wrong by its errors, one with ``serious`` by its serious rows, one with ``left`` by
    what is left of level hard, one with ``level`` by its hard rows, any other by having rows.
    """
    tests = {"severity": "severity = 'ERROR'", "serious": "serious", "left": "level = 'hard' and left > 0", "level": "level = 'hard'"}
    test = next((t for c, t in tests.items() if c in result.columns), "true")
    return CLEAN if result.where(test).isEmpty() else FINDINGS


def run(queries: dict[str, Callable[[SparkSession, str], DataFrame]], spark: SparkSession, name: str | None, folder: str | None, out: str | None = None) -> int:
    """One query by its name: its exit code, 2 for an unknown name or a path that isn't there; ``out`` takes the result as Parquet."""
    if name not in queries or not folder:
        return USAGE
    try:
        result = queries[name](spark, folder)
        if out:
            result.write.mode("error").parquet(out)
            result = spark.read.parquet(out)
        return exit_code(result)
    except Exception as e:  # a path that isn't there, a file that can't be read
        print(f"{name}: {e}")
        return USAGE


def smoke(queries: dict[str, Callable[[SparkSession, str], DataFrame]], spark: SparkSession, folder: str) -> DataFrame:
    """(query, rows, seconds, error) of every query; one that fails stops no other."""
    rows = []
    for name, query in queries.items():
        began = time.perf_counter()
        try:
            n, error = query(spark, folder).agg(F.count(F.lit(1))).first()[0], None
        except Exception as e:
            n, error = None, f"{type(e).__name__}: {e}"[:300]
        rows.append((name, n, round(time.perf_counter() - began, 3), error))
    return spark.createDataFrame(rows, RUN_SCHEMA)
