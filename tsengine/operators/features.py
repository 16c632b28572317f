"""Features of series: physics, lags, windows, splits, stitching."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.units import RESERVOIR_KPA, convert, guarded
from .blocks import in_blocks, renumbered
from .clean import along, causal_impute

EPS = 1e-6


def decline_rate(df: DataFrame, q: str, out: str, window: int = 10, eps: float = EPS) -> DataFrame:
    """`out`: -ln(q / previous), where previous is the previous rate, or where it isn't positive the
    mean of the last `window` rows; nothing falls below eps."""
    return in_blocks(df, lambda rows, w: rows.withColumn(out, _decline(q, w, window, eps)), window, 0)


def _decline(q: str, w: WindowSpec, window: int, eps: float) -> Column:
    prev = F.lag(q).over(w)
    prev = F.coalesce(F.when(prev > 0, prev), F.avg(q).over(w.rowsBetween(-window, -1)), F.lit(eps))
    return -F.log(F.greatest(F.col(q) / F.greatest(prev, F.lit(eps)), F.lit(eps)))


def field_features(df: DataFrame) -> DataFrame:
    """Rates and pressures of a producing field to stb/d, scf/d and psi, drawdown (imputed,
    guarded against 0), productivity, decline and choke efficiency."""
    df = df.select(
        "well",
        "t",
        convert(F.col("oil"), "m3d_stbd").alias("oil"),
        convert(F.col("gas"), "m3d_scfd").alias("gas"),
        convert(F.col("downhole"), "bar_psi").alias("downhole"),
        convert(F.col("whp"), "bar_psi").alias("whp"),
        "choke",
    ).withColumn("_dp", F.col("downhole") - F.col("whp"))
    df = causal_impute(df, "_dp", "dp").withColumn("dp", guarded(F.col("dp"))).drop("_dp")
    df = df.select("*", (F.col("oil") / F.col("dp")).alias("pi"), F.try_divide("oil", F.nullif("choke", F.lit(0.0))).alias("ce"))
    return decline_rate(df, "oil", "decline")


def simulated_features(df: DataFrame, reservoir_kpa: float = RESERVOIR_KPA) -> DataFrame:
    """Features of a simulated well: positive rates only, log gas (no less than 0, no more than
    1e9), drawdown from the reservoir pressure; the first row, whose decline is made up, goes."""
    df = decline_rate(renumbered(df.filter("oil > 0")), "oil", "decline")
    dp = convert(F.lit(reservoir_kpa), "kpa_psi") - convert(F.col("downhole"), "kpa_psi")
    return df.select("well", "t", "oil", F.log1p(F.least(F.greatest("gas", F.lit(0.0)), F.lit(1e9))).alias("log_gas"), dp.alias("dp"), (F.col("oil") / dp).alias("pi"), "decline").filter("t > 1")


def lag_features(df: DataFrame, target: str, window: int, horizon: int) -> DataFrame:
    """Lags of the target, <target>_lag0 .. <target>_lag(window - 1), and its value `horizon` steps
    ahead; incomplete rows go."""

    def work(rows: DataFrame, w: WindowSpec) -> DataFrame:
        lags = [F.lag(target, k).over(w).alias(f"{target}_lag{k}") for k in range(window)]
        return rows.select("_block", "_own", "well", "t", *lags, F.lead(target, horizon).over(w).alias("label")).na.drop()

    return in_blocks(df, work, window - 1, horizon)


def window_rows(df: DataFrame, target: str, others: list[str], window: int, horizon: int) -> DataFrame:
    """For each anchor t: other features at t, the last `window` targets, oldest first, as an
    array, their mean, and the label at t + horizon. Incomplete windows go."""

    def work(rows: DataFrame, w: WindowSpec) -> DataFrame:
        past = w.rowsBetween(-window + 1, 0)
        out = rows.select("_block", "_own", "well", "t", *others, F.collect_list(target).over(past).alias("lags"), F.avg(target).over(past).alias("window_mean"), F.lead(target, horizon).over(w).alias("label"))
        return out.filter((F.size("lags") == window) & F.col("label").isNotNull())

    return in_blocks(df, work, window - 1, horizon)


def seq_windows(df: DataFrame, features: list[str], target: str, length: int, horizon: int, stride: int = 1) -> DataFrame:
    """Sequence to sequence windows: x, the features of `length` rows, and y, the next
    `horizon` targets. A series of n rows has n - (length + horizon) + 1 of them."""

    def work(rows: DataFrame, w: WindowSpec) -> DataFrame:
        x = F.collect_list(F.array(*features)).over(w.rowsBetween(-length + 1, 0))
        y = F.collect_list(target).over(w.rowsBetween(1, horizon))
        out = rows.select("_block", "_own", "well", (F.col("t") - length).cast("int").alias("window_id"), x.alias("x"), y.alias("y"))
        return out.filter((F.size("x") == length) & (F.size("y") == horizon) & (F.col("window_id") % stride == 0))

    return in_blocks(df, work, length - 1, horizon)


def ratio_normalize(df: DataFrame) -> DataFrame:
    """Of window_rows: lags and label as ratios to the window's mean."""
    m = F.nullif(F.col("window_mean"), F.lit(0.0))
    return df.withColumns({"label": F.col("label") / m, "lags": F.transform("lags", lambda x: x / m)})


def chrono_split(df: DataFrame, share: float) -> DataFrame:
    """side: the last int(n * share) rows of each series are `test`."""
    n = F.count(F.lit(1)).over(Window.partitionBy("well"))
    return df.withColumn("side", F.when(F.row_number().over(along()) > n - F.floor(n * share), "test").otherwise("train"))


def three_way_split(df: DataFrame, test: float, validation: float) -> DataFrame:
    """side: train, then the first int(n_test * validation) test rows as val, then test."""
    n = F.count(F.lit(1)).over(Window.partitionBy("well"))
    n_test = F.floor(n * test)
    k = F.row_number().over(along()) - (n - n_test)
    return df.withColumn("side", F.when(k <= 0, "train").when(k <= F.floor(n_test * validation), "val").otherwise("test"))


def reconstruct(df: DataFrame, horizon: int, value: str = "y", tail: str = "last", tail_steps: int = 7) -> DataFrame:
    """Overlapping windows (well, window_id, step 1.., value) back to a series: the first
    window whole, then of each the last step, or the mean of its last `tail_steps`."""
    first = F.min("window_id").over(Window.partitionBy("well"))
    df = df.withColumn("_first", first)
    head = df.filter("window_id = _first").select("well", (F.col("window_id") + F.col("step")).alias("t"), F.col(value).alias("value"))
    rest = df.filter((F.col("window_id") > F.col("_first")) & (F.col("step") > (horizon - tail_steps if tail == "mean" else horizon - 1)))
    rest = rest.groupBy("well", (F.col("window_id") + horizon).alias("t")).agg(F.avg(value).alias("value"))
    return head.unionByName(rest)


def stitch(df: DataFrame, horizon: int, stride: int, value: str = "y") -> DataFrame:
    """Walk-forward forecasts every `stride` windows: the first whole, then the last `stride`
    steps of each."""
    first = F.min("window_id").over(Window.partitionBy("well"))
    df = df.withColumn("_first", first).filter((F.col("window_id") - F.col("_first")) % stride == 0)
    df = df.filter((F.col("window_id") == F.col("_first")) | (F.col("step") > horizon - stride))
    return df.select("well", (F.col("window_id") + F.col("step")).alias("t"), F.col(value).alias("value"))


def walk_forward_folds(df: DataFrame, length: int = 150, window: int = 7, horizon: int = 56) -> DataFrame:
    """Fold T trains on anchors T - (horizon + length - window) .. T - horizon and tests on
    anchor T. The range is joined by equality on blocks of anchors, each fold to the two
    blocks that it can touch, never by a nested loop."""
    span = length - window + 1
    folds = df.filter(F.col("t") >= window + horizon + length - window).select("well", F.col("t").alias("fold"))
    lo = F.col("fold") - (horizon + length - window)
    folds = folds.withColumn("block", F.explode(F.sequence(F.floor(lo / span), F.floor((F.col("fold") - horizon) / span))))
    anchors = df.select("well", F.col("t").alias("anchor"), F.floor(F.col("t") / span).alias("block"))
    return folds.join(anchors, ["well", "block"]).filter(F.col("anchor").between(lo, F.col("fold") - horizon)).select("well", "fold", "anchor")


def late_decline(length: int, seed: int, low: float = 0.6, high: float = 1.0) -> tuple[int, float]:
    """Where a window of `length` rows begins to decline, in its later two thirds, and to what share."""
    rng = random.Random(seed)
    return rng.randint(length // 3, length - 1), rng.uniform(low, high)


def warped(c: str, cut: Column, alpha: Column, features: int) -> Column:
    """A window (an array of values, or of arrays of `features` values) times alpha from place cut on."""
    scale = lambda v, i: v * F.when(i >= cut, alpha).otherwise(1.0)
    return F.transform(c, (lambda row, i: F.transform(row, lambda v: scale(v, i))) if features else scale)


def augment(df: DataFrame, scale: tuple[float, ...] = (), jitter: float = 0.0, warp: float = 1.0, bootstrap: int = 0, seed: int = 7) -> DataFrame:
    """well, t, oil, downhole and `block`: the rows, and copies of them by the techniques that are
    on. scale: rate and pressure by each factor; jitter: noise of this deviation on the pressure;
    warp: the later half of each series' rates times this; bootstrap: so many copies in which
    blocks of 30 rows are drawn anew."""
    parts = [df.withColumn("block", F.lit("original"))]
    for f in scale:
        parts.append(df.withColumns({"oil": F.col("oil") / f, "downhole": F.col("downhole") / f, "block": F.lit(f"scale {f}")}))
    if jitter:
        parts.append(df.withColumns({"downhole": F.col("downhole") + F.randn(seed) * jitter, "block": F.lit("jitter")}))
    if warp != 1.0:
        late = F.percent_rank().over(along()) > 0.5
        parts.append(df.withColumns({"oil": F.when(late, F.col("oil") * warp).otherwise(F.col("oil")), "block": F.lit("warp")}))
    for b in range(bootstrap):
        n = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("well")) / 30)
        blocks = df.select("well", F.floor((F.col("t") - 1) / 30).alias("_to"), n.alias("_n")).distinct()
        drawn = blocks.select("well", "_to", F.pmod(F.xxhash64(F.lit(seed + b), "well", "_to"), F.col("_n")).alias("_from"))
        source = df.withColumn("_from", F.floor((F.col("t") - 1) / 30))
        copy = drawn.join(source, ["well", "_from"]).withColumns({"t": (F.col("_to") * 30 + (F.col("t") - 1) % 30 + 1).cast("int"), "block": F.lit(f"bootstrap {b}")})
        parts.append(copy.select(*df.columns, "block"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
