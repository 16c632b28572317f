"""Scores, leaderboards, rankings and tests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import numbered


def smape(y: str, p: str) -> Column:
    """100 times the mean of |y - p| over the mean of |y| and |p|; 0 / 0 counts as 0."""
    den = F.abs(F.col(y)) + F.abs(F.col(p))
    return 100 * F.avg(F.when(den == 0, 0.0).otherwise(2 * F.abs(F.col(y) - F.col(p)) / F.nullif(den, F.lit(0.0))))


def scores(df: DataFrame, keys: list[str], y: str = "truth", p: str = "pred") -> DataFrame:
    """R2, SMAPE, MAE and MSE of each group in one aggregate. A constant truth gives R2 1 for
    a perfect forecast, else 0."""
    sst = F.var_pop(y) * F.count(y)
    sse = F.sum(F.pow(F.col(y) - F.col(p), 2))
    agg = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*keys).agg(
        sse.alias("_sse"), sst.alias("_sst"), smape(y, p).alias("smape"), F.avg(F.abs(F.col(y) - F.col(p))).alias("mae"), F.avg(F.pow(F.col(y) - F.col(p), 2)).alias("mse"), F.count(F.lit(1)).alias("n")
    )
    r2 = F.when(F.col("_sst") == 0, F.when(F.col("_sse") == 0, 1.0).otherwise(0.0)).otherwise(1 - F.col("_sse") / F.nullif("_sst", F.lit(0.0)))
    return agg.select(*keys, r2.alias("r2"), "smape", "mae", "mse", "n")


def exact_mean(c: str, decimals: int = 6) -> Column:
    """The mean of values of so many decimals at most: summed as decimals, divided once, and so
    the same in whatever order rows come."""
    return F.sum(F.col(c).cast(f"decimal(18,{decimals})")).cast("double") / F.count(c)


def leaderboard(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean SMAPE of each configuration, best first."""
    return numbered(runs.groupBy(*keys).agg(exact_mean("smape").alias("mean_smape")), "mean_smape", keys, "rank")


def composite_rank(df: DataFrame, group: str, name: str, weights: dict[str, float], rising: set[str]) -> DataFrame:
    """Min-max scores within a group (0.5 where all are equal), weighted, ranked."""
    w = Window.partitionBy(group)
    total = F.lit(0.0)
    for c, weight in weights.items():
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        x = (F.col(c) - lo) if c in rising else (hi - F.col(c))
        total = total + weight * F.when(hi == lo, 0.5).otherwise(x / F.nullif(hi - lo, F.lit(0.0)))
    df = df.withColumn("score", F.round(total, 9))
    return df.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), name)))


def welch_t(df: DataFrame, group: str, a: str, b: str, metric: str) -> DataFrame:
    """t and the degrees of freedom of Welch's test between two groups; nulls are left out."""
    side = lambda v, k: F.when(F.col(group) == v, F.col(metric))
    x, y = side(a, metric), side(b, metric)
    s = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate((x, y)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    s = s.withColumns({"e0": F.col("v0") / F.col("n0"), "e1": F.col("v1") / F.col("n1")})
    t = (F.col("m0") - F.col("m1")) / F.sqrt(F.col("e0") + F.col("e1"))
    dof = F.pow(F.col("e0") + F.col("e1"), 2) / (F.pow("e0", 2) / (F.col("n0") - 1) + F.pow("e1", 2) / (F.col("n1") - 1))
    return s.select(t.alias("t"), dof.alias("dof"))


def concentration(share: str) -> Column:
    """An aggregate of shares that sum to 1: 0 or so when all are equal, towards 1 with their number."""
    return 1 - 2.0 / F.count(F.lit(1)) * (1 - (F.min(share) + F.max(share)) / 2)


def t_test_p(t: Column, dof: Column, nodes: int = 2000) -> Column:
    """Two-sided p-value of Student's t: the share of cos^(dof - 1) between atan(|t| / sqrt(dof))
    and a right angle, or where the curve has long ended, by Simpson's rule."""
    right = F.least(F.lit(math.pi / 2), 40 / F.sqrt(dof))
    theta = F.least(F.atan(F.abs(t) / F.sqrt(dof)), right)

    def area(a: Column, b: Column) -> Column:
        h = (b - a) / nodes
        weight = lambda i: F.when((i == 0) | (i == nodes), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        height = lambda i: F.pow(F.greatest(F.cos(a + i * h), F.lit(0.0)), dof - 1)
        return F.aggregate(F.sequence(F.lit(0), F.lit(nodes)), F.lit(0.0), lambda s, i: s + weight(i) * height(i)) * h / 3

    return area(theta, right) / area(F.lit(0.0), right)


def welch_conclusions(df: DataFrame, group: str, pairs: list[tuple[str, str]], metric: str, alpha: float = 0.05) -> DataFrame:
    """Welch's test of each pair of groups in one pass: t, dof, p and a conclusion in words."""
    stats = df.groupBy(F.col(group).alias("_g")).agg(F.avg(metric).alias("m"), (F.var_samp(metric) / F.count(metric)).alias("e"), F.count(metric).alias("n"))
    names = df.sparkSession.createDataFrame(pairs, "a string, b string")
    side = lambda i: stats.select(F.col("_g").alias("ab"[i]), *[F.col(c).alias(f"{c}{i}") for c in ("m", "e", "n")])
    s = names.join(side(0), "a").join(side(1), "b")
    both = F.col("e0") + F.col("e1")
    s = s.withColumns({"t": (F.col("m0") - F.col("m1")) / F.sqrt(both), "dof": F.pow(both, 2) / (F.pow("e0", 2) / (F.col("n0") - 1) + F.pow("e1", 2) / (F.col("n1") - 1))})
    s = s.withColumn("p", t_test_p(F.col("t"), F.col("dof")))
    better = F.when(F.col("m0") < F.col("m1"), F.col("a")).otherwise(F.col("b"))
    said = F.when(F.col("p") < alpha, F.concat(F.lit("significant difference, lower in "), better)).otherwise("no significant difference")
    return s.select("a", "b", "t", "dof", "p", said.alias("conclusion"))


def place(df: DataFrame, groups: list[Column], within: list[Column]) -> DataFrame:
    """`place` of each row in the order of groups, then within. Groups are numbered from their
    counts, a short table; only rows of one group are sorted together."""
    keyed = df.withColumns({f"_g{i}": g for i, g in enumerate(groups)})
    names = [f"_g{i}" for i in range(len(groups))]
    counts = keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy(*[F.col(c).asc_nulls_last() for c in names]).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).drop("_n")
    same = [keyed[c].eqNullSafe(before[c]) for c in names]
    joined = keyed.join(before, same).drop(*[before[c] for c in names])
    k = F.row_number().over(Window.partitionBy(*names).orderBy(*within))
    return joined.withColumn("place", (k + F.col("_before")).cast("long")).drop("_before", *names)


def merge_val_test(val: DataFrame, test: DataFrame, metrics: list[str]) -> DataFrame:
    """Full outer join on all common other columns, null keys equal; metrics get a suffix."""
    keys = [c for c in val.columns if c in test.columns and c not in metrics]
    v = val.select(*[F.col(k).alias(f"_v{k}") for k in keys], *[F.col(m).alias(f"{m}_val") for m in metrics])
    t = test.select(*[F.col(k).alias(f"_t{k}") for k in keys], *[F.col(m).alias(f"{m}_test") for m in metrics])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"_v{k}").eqNullSafe(F.col(f"_t{k}"))
    return v.join(t, on, "full").select(*[F.coalesce(f"_v{k}", f"_t{k}").alias(k) for k in keys], *[f"{m}_val" for m in metrics], *[f"{m}_test" for m in metrics])
