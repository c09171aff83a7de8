"""Named queries with their SQL twins.

``register`` wraps both sides alike: measured columns are compared at seven
significant digits (the two engines add floats in different orders).
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lamella.core import signif

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
IDS: dict[str, str] = {}
DIGITS = 7


def _round(df: DataFrame) -> DataFrame:
    cols = []
    for name, typ in df.dtypes:
        c = F.col(f"`{name}`")
        if typ == "double":
            cols.append(F.when(F.abs(c) < 1e-9, F.lit(0.0)).otherwise(signif(c, DIGITS)).alias(name))
        elif typ in ("int", "smallint"):
            cols.append(c.cast("bigint").alias(name))
        else:
            cols.append(c)
    return df.select(*cols)


def _round_sql(sql: str, doubles: str) -> str:
    def one(c):
        s = f"({DIGITS - 1} - floor(log10(abs({c}))))"
        return (f"CASE WHEN {c} IS NULL OR abs({c}) < 1e-9 THEN CASE WHEN {c} IS NULL THEN NULL ELSE 0.0 END "
                f"WHEN {s} >= 0 THEN round({c}*pow(10.0,{s}))/pow(10.0,{s}) "
                f"ELSE round({c}/pow(10.0,-{s}))*pow(10.0,-{s}) END AS {c}")
    if not doubles:
        return sql
    rep = ", ".join(one(c) for c in doubles.split())
    casts = ", ".join(f"cast({c} as double) AS {c}" for c in doubles.split())
    return f"SELECT * REPLACE ({rep}) FROM (SELECT * REPLACE ({casts}) FROM (\n{sql}\n) _q0) _q"


def register(name: str, ids: str, sql: str | None = None, doubles: str = ""):
    """Decorator: ``fn(spark, sf_dir)`` becomes query ``name`` covering inventory rows ``ids``."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = lambda spark, d: _round(fn(spark, d))
        IDS[name] = ids
        if sql is not None:
            ORACLES[name] = _round_sql(sql, doubles)
        return fn
    return deco
