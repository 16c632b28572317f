"""Places, ranks and quantiles over everything or over large groups, without one task for a group.

Values are counted first, so that however often one occurs it is one row, and then cut into ranges
of some ROWS rows by approximate quantiles. A range is ordered on its own; what lies before it is
a sum over the ranges' counts, one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range, and ranges at most (their bounds are a literal of the plan).
ROWS, RANGES = 1_000_000, 4096


def _range_of(df: DataFrame, c: str) -> Column:
    """The number of the range that a value of c lies in. The bounds are fixed now, so that each use
    of the plan cuts alike; any bounds give the same results."""
    n = min(RANGES, df.count() // ROWS)
    bounds = sorted(set(df.approxQuantile(c, [i / n for i in range(1, n)], 0.25 / n))) if n > 1 else []
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(c)))


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    on = F.lit(True)
    for k in names:
        on = on & a[k].eqNullSafe(b[f"_{k}"])
    return on


def _met(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
    """a joined with b on these columns, null with null."""
    b = b.withColumnsRenamed({k: f"_{k}" for k in names})
    return a.join(b, _same(a, b, names), "left").drop(*[f"_{k}" for k in names])


def ordered_counts(df: DataFrame, keys: list[str], c: str) -> DataFrame:
    """(keys, c, n, before): each value of a group, how often it occurs, and how many values of the
    group are smaller. Nulls and NaN are left out."""
    df = df.select(*keys, F.col(c).cast("double").alias(c)).filter(F.col(c).isNotNull() & ~F.isnan(c))
    counted = df.groupBy(*keys, c).agg(F.count(F.lit(1)).alias("n")).withColumn("_range", _range_of(df, c))
    totals = counted.groupBy(*keys, "_range").agg(F.sum("n").alias("_total"))
    past = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_range", F.coalesce(F.sum("_total").over(past), F.lit(0)).alias("_past"))
    here = F.sum("n").over(Window.partitionBy(*keys, "_range").orderBy(c).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return _met(counted.withColumn("_here", here), totals, [*keys, "_range"]).select(*keys, c, "n", (F.col("_here") + F.col("_past")).alias("before"))


def average_ranks(df: DataFrame, keys: list[str], c: str, out: str) -> DataFrame:
    """`df` with the rank of c within its group, from 1; equal values share the mean of their places.
    Nulls and NaN have none."""
    counts = ordered_counts(df, keys, c).select(*keys, c, (F.col("before") + (F.col("n") + 1) / 2).alias(out))
    return _met(df.withColumn(c, F.col(c).cast("double")), counts, [*keys, c])


def quantiles(df: DataFrame, keys: list[str], c: str, shares: dict[str, float]) -> DataFrame:
    """(keys, a column for each name in `shares`): exact quantiles, interpolated between neighbours.
    A group without any value has nulls."""
    counts = ordered_counts(df, keys, c)
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("_size"))
    counts = _met(counts, sizes, keys)
    picked = []
    for name, p in shares.items():
        at = p * (F.col("_size") - 1)
        for side, k in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            inside = (F.col("before") <= k) & (k < F.col("before") + F.col("n"))
            picked.append(F.max(F.when(inside, F.col(c))).alias(f"_{name}_{side}"))
        picked.append(F.max(at - F.floor(at)).alias(f"_{name}_part"))
    found = counts.groupBy(*keys).agg(*picked)
    mix = [(F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_part")).alias(n) for n in shares]
    found = found.select(*keys, *mix)
    return found if not keys else _met(df.select(*keys).distinct(), found, keys)


def numbered(df: DataFrame, c: str, ties: list[str], out: str) -> DataFrame:
    """`df` with each row's place in the order of c, then of `ties`, from 1. Null comes first, and
    counts as one range."""
    there = df.withColumn("_range", F.when(F.col(c).isNotNull(), _range_of(df.filter(F.col(c).isNotNull()), c)).otherwise(-1))
    counts = there.groupBy("_range").agg(F.count(F.lit(1)).alias("_total"))
    past = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    counts = counts.select("_range", F.coalesce(F.sum("_total").over(past), F.lit(0)).alias("_past"))
    here = F.row_number().over(Window.partitionBy("_range").orderBy(c, *ties))
    return _met(there.withColumn("_here", here), counts, ["_range"]).withColumn(out, F.col("_here") + F.col("_past")).drop("_range", "_here", "_past")


def spearman(df: DataFrame, keys: list[str], a: str, b: str, out: str) -> DataFrame:
    """(keys, out): the correlation of average ranks of two columns in each group."""
    ranked = average_ranks(average_ranks(df, keys, a, "_a"), keys, b, "_b")
    return ranked.groupBy(*keys).agg(F.corr("_a", "_b").alias(out))
