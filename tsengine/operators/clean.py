"""Cleaning of series: filters, imputation, deduplication, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import carried


def along(keys: str = "well", order: str = "t") -> Window:
    """The one window spec that all operators share, so that a plan sorts once."""
    return Window.partitionBy(keys).orderBy(order)


def filter_wells(df: DataFrame, wells: list[str], strict: bool = True) -> DataFrame:
    """Rows of the named wells. Strict: it is an error if there are none."""
    out = df.filter(F.col("well").isin(wells))
    if strict and out.isEmpty():
        raise ValueError(f"no rows for {wells}")
    return out


def drop_zero_rates(df: DataFrame, c: str, mode: str = "nonzero_dropna") -> DataFrame:
    """`nonzero_dropna`: c is neither zero nor null; `nonzero`: nulls stay; `positive`: c > 0."""
    return df.filter({"nonzero_dropna": F.col(c) != 0, "nonzero": F.col(c).isNull() | (F.col(c) != 0), "positive": F.col(c) > 0}[mode])


def canonicalize(df: DataFrame, renames: dict[str, str], columns: list[str], keys: list[str]) -> DataFrame:
    """Rename, add missing columns as 0, and order: keys, then columns."""
    df = df.withColumnsRenamed(renames)
    return df.select(*keys, *[F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in columns])


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def ffill(df: DataFrame, c: str, out: str, keys: str = "well", order: str = "t") -> DataFrame:
    """`out`: the last known value of c. A block gets what the blocks before it end with."""
    spot = F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("t"), F.col(c).alias("v")))
    df, w, _ = carried(df, {"_past": (spot, F.max, False)}, keys, order)
    here = F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, F.coalesce(here, F.col("_past.v"))).drop("_past", "_block")


def causal_impute(df: DataFrame, c: str, out: str, limit: int = 3, keys: str = "well", order: str = "t") -> DataFrame:
    """Carry the last value forward for `limit` rows; what is left of a gap is interpolated
    between its neighbours after that, the tail carries on, and the head stays null.

    `order` numbers a series' rows without gaps. A row needs the known values before and after it
    only: running aggregates along its block, forward and backward, or what earlier and later
    blocks have, so that a series of any length is worked on in many tasks."""
    spot = F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("t"), F.col(c).alias("v")))
    df, ahead, back = carried(df.withColumn("_spot", spot), {"_past": (spot, F.max, False), "_next": (spot, F.min, True)}, keys, order)
    near = lambda w, far: F.coalesce(F.last("_spot", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col(far))
    df = df.withColumns({"_past": near(ahead, "_past"), "_next": near(back, "_next")})
    t, last, begin = F.col(order), F.col("_past.v"), F.col("_past.t") + limit
    blend = last + (F.col("_next.v") - last) * (t - begin) / (F.col("_next.t") - begin)
    filled = F.when(t <= begin, last).when(F.col("_past").isNotNull() & F.col("_next").isNotNull(), blend).otherwise(last)
    return df.withColumn(out, filled).drop("_spot", "_past", "_next", "_block")


def mean_impute(df: DataFrame, columns: list[str], keys: str = "well") -> DataFrame:
    w = Window.partitionBy(keys)
    return df.withColumns({c: F.coalesce(F.col(c), F.avg(c).over(w)) for c in columns})


def bad_values(df: DataFrame, columns: list[str], threshold: float = 1e30) -> DataFrame:
    """One row for each column: nulls or NaN, +inf, -inf, and values beyond the threshold."""
    inf = float("inf")
    tests = {
        "n_null": lambda c: c.isNull() | F.isnan(c),
        "n_pos_inf": lambda c: c == F.lit(inf),
        "n_neg_inf": lambda c: c == F.lit(-inf),
        "n_big": lambda c: (F.abs(c) > threshold) & (F.abs(c) < F.lit(inf)),
    }
    # One pass: all counts at once, then a row for each column.
    wide = df.agg(*[F.count_if(f(F.col(c).cast("double"))).alias(f"{c}__{k}") for c in columns for k, f in tests.items()], F.count(F.lit(1)).alias("n"))
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col("n").alias("total"), *[F.col(f"{c}__{k}").alias(k) for k in tests]) for c in columns])
    return wide.select(F.inline(rows))


def data_check(tables: dict[str, DataFrame], outlier: float = 1e6) -> DataFrame:
    """One row for each dataset: values that are null or NaN, infinite ones, whether any finite
    value lies beyond `outlier`, and whether nothing was found. All numeric columns count."""
    out = None
    for name, df in tables.items():
        numeric = [F.col(c).cast("double") for c, kind in df.dtypes if kind in ("int", "bigint", "float", "double", "smallint", "tinyint") or kind.startswith("decimal")]
        inf = float("inf")
        total = lambda test: sum((F.count_if(test(c)) for c in numeric), F.lit(0))
        one = df.agg(
            total(lambda c: c.isNull() | F.isnan(c)).cast("long").alias("n_missing"),
            total(lambda c: F.abs(c) == F.lit(inf)).cast("long").alias("n_infinite"),
            (total(lambda c: (F.abs(c) > outlier) & (F.abs(c) < F.lit(inf))) > 0).alias("outliers"),
        ).select(F.lit(name).alias("dataset"), "*", ((F.col("n_missing") + F.col("n_infinite") == 0) & ~F.col("outliers")).alias("ok"))
        out = one if out is None else out.unionAll(one)
    return out


def check_valid(df: DataFrame, columns: list[str], threshold: float = 1e30) -> None:
    """Raise if any column holds a bad value."""
    bad = [r.asDict() for r in bad_values(df, columns, threshold).filter("n_null + n_pos_inf + n_neg_inf + n_big > 0").collect()]
    if bad:
        raise ValueError(f"invalid values: {bad}")


def decimate(df: DataFrame, step: int, skip: int = 0, keys: str = "well", order: str = "t") -> DataFrame:
    """Every step-th row of a series, after the first `skip`."""
    rn = F.row_number().over(along(keys, order)) - 1 - skip
    return df.withColumn("_rn", rn).filter((F.col("_rn") >= 0) & (F.col("_rn") % step == 0)).drop("_rn")
