"""Named queries and their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from .daily import DAILY_RATES, RUNS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

D = f"WITH RECURSIVE d AS ({DAILY_RATES})"
R = f"WITH r AS ({RUNS})"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


def draw(*columns: str | Column) -> Column:
    """A number below 2^32 that is drawn from these columns, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *columns)), 1, 8), 16, 10).cast("long")


def draw_sql(*columns: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('-', {', '.join(columns)})), 1, 8) AS BIGINT)"


def normal(*columns: str | Column) -> Column:
    """A standard normal number drawn from these columns, the same in any engine (Box and Muller)."""
    u, v = ((draw(F.lit(seed), *columns) + 0.5) / float(1 << 32) for seed in ("u", "v"))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def normal_sql(*columns: str) -> str:
    u, v = (f"(({draw_sql(seed, *columns)}) + 0.5) / {float(1 << 32)!r}" for seed in ("'u'", "'v'"))
    return f"sqrt(-2 * ln({u})) * cos({2 * math.pi!r} * {v})"


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zero, so that engines agree on every bit."""
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})


def mean(c: str) -> Column:
    """The mean of values of at most six decimals, summed exactly, so that it doesn't depend on
    the order of rows."""
    return M.exact_mean(c)


def mean_sql(c: str, where: str = "") -> str:
    where = f" FILTER (WHERE {where})" if where else ""
    return f"(CAST(sum(CAST({c} AS DECIMAL(18,6))){where} AS DOUBLE) / count({c}){where})"
