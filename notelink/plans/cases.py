"""Queries over cases: every row of a driver table takes one case by its key, with inputs of its own.

A case is a pair of inputs and hand-derived expected outputs; the oracle gives the
expected ones by the same key, so a query is right only if its operator is, row for row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    if isinstance(v, int):
        return str(v)
    return "'" + str(v).replace("'", "''") + "'"


def case_query(queries: dict, oracle: dict, name: str, table: str, key: str, inputs: str, outputs: str, cases: Sequence[tuple[tuple, tuple]], run: Callable[[DataFrame], DataFrame], doc: str = "") -> None:
    """Register ``name``: rows ``(key, *inputs)`` through ``run``, which keeps ``key`` and gives ``outputs``."""
    cols = [x.split(" ", 1) for x in outputs.split(", ")]

    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = spark.createDataFrame([(k, *i) for k, (i, _) in enumerate(cases)], f"__case int, {inputs}")
        base = spark.read.parquet(f"{sf}/{table}.parquet").select(F.col(key).cast("long").alias("key"))
        rows = base.withColumn("__case", F.pmod("key", F.lit(len(cases))).cast("int")).join(F.broadcast(rows), "__case").drop("__case")
        return run(rows).select("key", *[F.col(c).cast(t).alias(c) for c, t in cols])

    query.__name__, query.__doc__ = name, doc
    queries[name] = query
    types = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}
    values = ", ".join("(" + ", ".join([str(k), *map(literal, want)]) + ")" for k, (_, want) in enumerate(cases))
    picked = ", ".join(f'CAST(c."{n}" AS {types[t]}) AS "{n}"' for n, t in cols)
    oracle[name] = "WITH c(case_no, " + ", ".join(f'"{n}"' for n, _ in cols) + f") AS (VALUES {values}) SELECT CAST({key} AS BIGINT) AS key, {picked} FROM {table} JOIN c ON c.case_no = {key} % {len(cases)}"
