"""Signal filters on series (scans of affine maps over blocks) and on arrays (column expressions)."""

from __future__ import annotations

import math
from types import ModuleType

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import written
from .blocks import block_of, geometric, in_blocks, scan, starts_of_blocks

#: Rows of a block of a filtered series.
BLOCK = 8192


class Level:
    """The local-level Kalman filter of variances q (of the level) and r (of a value) in closed form.

    The level's variance P follows P' = r (P + q) / (P + q + r), a linear fractional map, so that
    (P_i - high) / (P_i - low) falls geometrically, where high and low are its fixed points.
    Gains depend on a row's place i (from 1) only. The state begins as the first value, with
    variance 1 before it. `m` is NumPy or pyspark.sql.functions."""

    def __init__(self, q: float, r: float):
        if q < 0 or r <= 0:
            raise ValueError("q is not negative and r is positive")
        self.q, self.r, self.first = q, r, r / (1 + r)
        root = math.sqrt(q * q + 4 * q * r)
        self.high, self.low = 2 * q * r / (root + q) if q else 0.0, -(root + q) / 2
        self.log_keep = -math.log1p((q + root) / (2 * r))  # of the product of 1 - gain, once gains are steady
        self.ratio = math.exp(self.log_keep)
        ahead = self.first - self.high
        self.sign = math.copysign(1.0, ahead) if ahead and q else 0.0
        share = root / (self.first - self.low)  # 1 - share is the first row's e
        self.log_e = math.log1p(-share) if share < 0.5 else math.log(abs(ahead) / (self.first - self.low)) if self.sign else 0.0

    def _log(self, i):
        return self.log_e + 2 * self.log_keep * (i - 1)

    def _e(self, m: ModuleType, i):
        return self.sign * m.exp(self._log(i)) if self.sign else i * 0.0

    def _rest(self, m: ModuleType, i):
        """1 - e, without cancellation."""
        return -m.expm1(self._log(i)) if self.sign > 0 else 1 - self._e(m, i)

    def variance(self, m: ModuleType, i):
        if not self.q:
            return self.r * self.first / (self.r + (i - 1) * self.first)
        return self.high + (self.high - self.low) * self._e(m, i) / self._rest(m, i)

    def gain(self, m: ModuleType, i):
        """Of rows after the first, whose gain is 1."""
        p = self.variance(m, i - 1) + self.q
        return p / (p + self.r)

    def keep(self, m: ModuleType, i, end):
        """The product of 1 - gain over rows i + 1 .. end: the weight of state i in state `end`."""
        if not self.q:
            return (self.r + (i - 1) * self.first) / (self.r + (end - 1) * self.first)
        return m.exp(self.log_keep * (end - i)) * self._rest(m, i) / self._rest(m, end)

    def lead(self, m: ModuleType, i):
        """The smoother's weight of the row after row i."""
        p = self.variance(m, i)
        return p / (p + self.q)

    def back(self, m: ModuleType, i, end):
        """The product of `lead` over rows i .. end - 1: the weight of smoothed row `end` in row i."""
        if not self.q:
            return 1.0 + 0.0 * i
        share = lambda k: self.high - self.low * self._e(m, k)
        return m.exp(self.log_keep * (end - i)) * share(i) / share(end)


class Exponential:
    """Exponential smoothing with a fixed weight of the newest value, from the first value on."""

    def __init__(self, alpha: float):
        self.alpha = alpha

    def gain(self, m: ModuleType, i):
        return self.alpha + i * 0.0

    def keep(self, m: ModuleType, i, end):
        return m.exp((end - i) * math.log1p(-self.alpha)) if self.alpha < 1 else (end - i) * 0.0


def _placed(df: DataFrame, keys: list[str], order: str, block: int) -> tuple[DataFrame, Column, Column]:
    """Rows with their block, their place, and the last place of the block."""
    return df.withColumn("_block", block_of(order, block)), F.col(order).cast("double"), ((F.col("_block") + 1) * block).cast("double")


def _scanned(df: DataFrame, maps: DataFrame, columns: list[str], keys: list[str], order: str, reverse: bool, each) -> DataFrame:
    """Each block's rows, with the state it begins with: each(values, places, start) of a column."""
    starts = starts_of_blocks(maps, keys, columns, reverse)
    schema = ", ".join(f"`{c}` {'double' if c in columns else kind}" for c, kind in df.dtypes if c != "_block")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ascending=not reverse)
        place = pdf[order].to_numpy(float)
        out = {c: each(pdf[c].to_numpy(float), place, pdf[f"_start_{c}"].iloc[0]) for c in columns}
        return pdf.drop(columns=["_block", *(f"_start_{c}" for c in columns)]).assign(**out)

    return df.join(starts, [*keys, "_block"], "left").groupBy(*keys, "_block").applyInPandas(run, schema)


def _filter(df: DataFrame, columns: list[str], gains: Level | Exponential, keys: list[str], order: str, block: int) -> DataFrame:
    """x_1 = z_1, then x_i = x_{i-1} + gain_i (z_i - x_{i-1}). A block's map is an aggregate with
    weights in closed form; maps are composed, and then each block is scanned from its state."""
    df, t, end = _placed(df, keys, order, block)
    first = F.col(order) == 1
    # Exponents of the last block would overflow where `end` lies beyond the series; its map is not used.
    weight = F.when(first, 1.0).otherwise(gains.gain(F, t)) * gains.keep(F, t, end)
    maps = df.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(weight * F.col(c)).alias(c) for c in columns]).filter(F.col("_n") == block)
    last = (F.col("_block") + 1).cast("double") * block
    maps = maps.withColumn("_a", F.when(F.col("_block") == 0, 0.0).otherwise(gains.keep(F, last - block, last)))

    def each(z: np.ndarray, place: np.ndarray, start: float) -> np.ndarray:
        k = np.where(place == 1, 1.0, gains.gain(np, np.maximum(place, 2)))
        return scan(1 - k, k * z, 0.0 if place[0] == 1 else start)

    return _scanned(df, maps, columns, keys, order, False, each)


def _smooth(df: DataFrame, columns: list[str], level: Level, keys: list[str], order: str, block: int) -> DataFrame:
    """Rauch, Tung and Striebel's backward pass over filtered values: s_n = x_n, then
    s_i = x_i + lead_i (s_{i+1} - x_i), from the last block to the first."""
    ends = df.groupBy(*keys).agg(F.max(order).alias("_last"))
    df, t, _ = _placed(df.join(ends, keys), keys, order, block)
    first = (F.col("_block") * block + 1).cast("double")
    final = F.col(order) == F.col("_last")
    weight = F.when(final, 1.0).otherwise(1 - level.lead(F, t)) * level.back(F, first, t)
    whole = F.max(final.cast("int"))
    maps = df.groupBy(*keys, "_block").agg(whole.alias("_final"), *[F.sum(weight * F.col(c)).alias(c) for c in columns])
    begin = (F.col("_block") * block + 1).cast("double")
    maps = maps.withColumn("_a", F.when(F.col("_final") == 1, 0.0).otherwise(level.back(F, begin, begin + block)))

    def each(x: np.ndarray, place: np.ndarray, start: float) -> np.ndarray:
        c = level.lead(np, place)
        if np.isnan(start):  # the last block: its last row is smoothed already
            c[0] = 0.0
        return scan(c, (1 - c) * x, 0.0 if np.isnan(start) else start)

    return _scanned(df.drop("_last"), maps, columns, keys, order, True, each)


def filter_columns(df: DataFrame, columns: list[str], method: str = "kalman", keys: list[str] | None = None, order: str = "t", block: int = BLOCK, **params: float) -> DataFrame:
    """`df` with these columns filtered and their raw values kept as <column>_Original.

    Methods: `kalman` (local level; values that are not positive become eps), `kalman_smooth` (with
    the backward pass, raw values) and `exponential`. `order` numbers a series' rows from 1
    without gaps. All are recursions x_i = a_i x_{i-1} + b_i whose a_i depend on the place only:
    blocks' maps are aggregated and composed, then each block is scanned from its true state, so
    that one long series spreads over many tasks and the result is the recursion's for any
    parameters. A null value counts as NaN, and so does all after it. An unknown column or
    method is an error."""
    keys = keys or ["well"]
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no columns {missing}")
    if method not in FILTERS:
        raise ValueError(f"unknown filter {method}; known: {', '.join(FILTERS)}")
    raw = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) if c in columns else F.col(c) for c in df.columns], *[F.col(c).cast("double").alias(f"{c}_Original") for c in columns])
    return FILTERS[method](raw, columns, keys, order, block, **params).select(*df.columns, *[f"{c}_Original" for c in columns])


def _kalman(df, columns, keys, order, block, q: float = 1e-4, r: float = 1e-3, eps: float = 1e-6):
    df = df.withColumns({c: F.greatest(F.col(c) + eps, F.lit(eps)) for c in columns})
    return _filter(df, columns, Level(q, r), keys, order, block)


def _kalman_smooth(df, columns, keys, order, block, q: float = 1e-5, r: float = 1e-3):
    level = Level(q, r)
    return _smooth(written(_filter(df, columns, level, keys, order, block)), columns, level, keys, order, block)


def _exponential(df, columns, keys, order, block, alpha: float = 0.2):
    return _filter(df, columns, Exponential(alpha), keys, order, block)


FILTERS = {"kalman": _kalman, "kalman_smooth": _kalman_smooth, "exponential": _exponential}


def filter_series(df: DataFrame, c: str, method: str, **params: float) -> DataFrame:
    """well, t, c and `filtered` of every series."""
    out = filter_columns(df.select("well", "t", c), [c], method, **params)
    return out.select("well", "t", F.col(f"{c}_Original").alias(c), F.col(c).alias("filtered"))


def restarted(z: np.ndarray, level: Level, m: int) -> np.ndarray:
    """The filter's state after the m values z[s] .. z[s + m - 1], begun anew at each s.

    With the gains' closed form the state is a sum of the first value, values that decay with
    their distance from the last one, and values that decay with that from the first: two sliding
    geometric sums, whatever m is."""
    n = max(0, len(z) - m + 1)
    if not level.q:
        total = geometric(z[1:], 1.0, m - 1)[:n] if m > 1 else 0.0
        return (level.r * z[:n] + level.first * total) / (level.r + (m - 1) * level.first)
    mu, e, one = level.ratio, float(level._e(np, np.float64(1))), np.float64(1)
    late = geometric(z[1:], mu, m - 1)[:n] if m > 1 else 0.0
    early = geometric(z[1:][::-1], mu, m - 1)[::-1][:n] if m > 1 else 0.0
    inner = -math.expm1(level.log_keep) * (late + e * mu ** (m - 1) * early)
    return (inner + mu ** (m - 1) * float(level._rest(np, one)) * z[:n]) / float(level._rest(np, np.float64(m)))


def kalman_per_fold(df: DataFrame, c: str, length: int = 150, window: int = 7, horizon: int = 56, q: float = 1e-6, r: float = 1e-3, eps: float = 1e-6, block: int = BLOCK) -> DataFrame:
    """For each fold, the filter restarted at the fold's own slice of the series: rows T - (length
    + horizon - 1) .. T + horizon of fold T. Returns the filtered lags of the test anchor T,
    oldest first, and its filtered label.

    Blocks of the series have a halo of a slice's length; no slice is copied for a fold, and the
    work for a fold is a constant."""
    size, level = length + 2 * horizon, Level(q, r)
    anchor = size - horizon  # values up to the anchor
    counts = [*range(anchor - window + 1, anchor + 1), size]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        z, n = pdf["z"].to_numpy(float), max(0, len(pdf) - size + 1)
        x = np.stack([restarted(z, level, m)[:n] for m in counts], 1)
        mine = pdf["_own"].to_numpy()[anchor - 1 : anchor - 1 + n]
        rows = pdf.iloc[anchor - 1 : anchor - 1 + n][mine]
        return pd.DataFrame({"well": rows["well"], "fold": rows["t"], "lags": pd.Series(list(x[mine, :-1]), index=rows.index, dtype=object), "label": x[mine, -1], "_own": np.ones(len(rows), bool), "_block": rows["_block"]})

    z = df.select("well", "t", F.greatest(F.col(c) + eps, F.lit(eps)).alias("z"))
    work = lambda rows, _: rows.groupBy("well", "_block").applyInPandas(run, "well string, fold int, lags array<double>, label double, _own boolean, _block long")
    return in_blocks(z, work, anchor - 1, horizon, block=block)


def smoother_weights(n: int, q: float, r: float) -> np.ndarray:
    """The local-level smoother of n values as a matrix: row i holds the weights of the values in
    smoothed value i. Gains depend on the place only, so it is linear in the values."""
    level, place = Level(q, r), np.arange(1, n + 1, dtype=float)
    gain = np.where(place == 1, 1.0, level.gain(np, np.maximum(place, 2)))
    ahead = scan(np.broadcast_to(1 - gain, (n, n)), np.eye(n) * gain)  # [value, place]
    lead = level.lead(np, place)
    lead[-1] = 0.0
    return scan(np.broadcast_to(lead[::-1], (n, n)), ((1 - lead) * ahead)[:, ::-1])[:, ::-1].T


def exponential_weights(n: int, alpha: float) -> np.ndarray:
    """One-step fitted values of exponential smoothing of n values as a matrix. With a fixed alpha the
    best first level is least squares, so it is linear in the values too (see exp_smooth)."""
    k = np.arange(n)
    far = k[:, None] - 1 - k[None, :]
    base = np.where(far >= 0, alpha * (1 - alpha) ** np.maximum(far, 0), 0.0)
    level = (1 - alpha) ** k.astype(float)
    return base + np.outer(level, level @ (np.eye(n) - base) / (level @ level))


def weighted_windows(df: DataFrame, c: str, weights: np.ndarray, out: str) -> DataFrame:
    """`out`: a matrix times each window."""
    dot = lambda w: F.aggregate(F.zip_with(c, F.array(*map(F.lit, w)), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return df.withColumn(out, F.array(*[dot(w) for w in weights.tolist()]))


def smooth_windows(df: DataFrame, c: str, n: int, q: float = 1e-5, r: float = 1e-3) -> DataFrame:
    """`smoothed`: the smoother over each window of n values, by constant weights."""
    return weighted_windows(df, c, smoother_weights(n, q, r), "smoothed")


#: Filters of windows by name: (rows, array column, its length, parameters) -> rows, name of the result.
WINDOW_FILTERS = {
    "exponential_smoothing": lambda df, c, n, **p: (weighted_windows(df, c, exponential_weights(n, p.get("smoothing_level", 0.2)), "fitted"), "fitted"),
    "wavelet": lambda df, c, n, **p: (haar_denoise(df, c, 3, p.get("threshold")), "denoised"),
    "kalman": lambda df, c, n, **p: (smooth_windows(df, c, n, p.get("process_var", 1e-5), p.get("measurement_var", 1e-3)), "smoothed"),
}


def filter_windows(df: DataFrame, columns: dict[str, int], method: str = "exponential_smoothing", **params) -> DataFrame:
    """Windows (array columns and their lengths), each filtered on its own by the filter of that name:
    `<column>_filtered`. An unknown name is an error."""
    if method not in WINDOW_FILTERS:
        raise ValueError(f"unknown filter {method}; known: {', '.join(WINDOW_FILTERS)}")
    for c, n in columns.items():
        df, out = WINDOW_FILTERS[method](df, c, n, **params)
        df = df.withColumnRenamed(out, f"{c}_filtered")
    return df


def exp_smooth(df: DataFrame, c: str, alpha: float = 0.2) -> DataFrame:
    """One-step fitted values of simple exponential smoothing of windows (an array column).

    With a fixed alpha the best first level is linear least squares: s0 = level without it."""
    decay = 1 - alpha
    # State: level from 0 before each value, as fitted values of a first level of 0.
    base = F.aggregate(
        c,
        F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("f")),
        lambda a, y: F.struct((decay * a["s"] + alpha * y).alias("s"), F.concat(a["f"], F.array(a["s"])).alias("f")),
        lambda a: a["f"],
    )
    df = df.withColumn("_base", base)
    w = lambda i: F.pow(F.lit(decay), i.cast("double"))
    idx = F.sequence(F.lit(0), F.size(c) - 1)
    num = F.aggregate(idx, F.lit(0.0), lambda a, i: a + w(i) * (F.get(F.col(c), i) - F.get(F.col("_base"), i)))
    den = F.aggregate(idx, F.lit(0.0), lambda a, i: a + w(i) * w(i))
    df = df.withColumn("_level", num / den)
    return df.withColumn("fitted", F.transform("_base", lambda b, i: b + F.col("_level") * w(i))).drop("_base", "_level")


def haar_step(x: Column) -> tuple[Column, Column]:
    """Approximation and detail of an array of even length."""
    half = F.sequence(F.lit(0), (F.size(x) / 2).cast("int") - 1)
    pair = lambda sign: F.transform(half, lambda i: (F.get(x, 2 * i) + sign * F.get(x, 2 * i + 1)) / F.sqrt(F.lit(2.0)))
    return pair(1), pair(-1)


def haar_inverse(a: Column, d: Column) -> Column:
    pairs = F.zip_with(a, d, lambda u, v: F.array((u + v) / F.sqrt(F.lit(2.0)), (u - v) / F.sqrt(F.lit(2.0))))
    return F.flatten(pairs)


def soft(x: Column, t: Column) -> Column:
    """Soft threshold of every element."""
    return F.transform(x, lambda v: F.signum(v) * F.greatest(F.abs(v) - t, F.lit(0.0)))


def haar_denoise(df: DataFrame, c: str, levels: int = 3, threshold: Column | None = None) -> DataFrame:
    """`denoised`: the array with all detail bands softened by half the array's population
    standard deviation (or a given threshold); odd lengths repeat their last value."""
    n = F.size(c)
    mean = F.aggregate(c, F.lit(0.0), lambda s, v: s + v) / n
    std = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / n)
    df = df.withColumns({"_t": 0.5 * std if threshold is None else threshold, "_a0": F.col(c)})
    for i in range(levels):
        df = df.withColumn(f"_e{i}", F.when(F.size(f"_a{i}") % 2 == 1, F.concat(f"_a{i}", F.slice(f"_a{i}", -1, 1))).otherwise(F.col(f"_a{i}")))
        a, d = haar_step(F.col(f"_e{i}"))
        df = df.withColumns({f"_a{i + 1}": a, f"_d{i}": soft(d, F.col("_t"))})
    out = F.col(f"_a{levels}")
    for i in reversed(range(levels)):
        out = F.slice(haar_inverse(out, F.col(f"_d{i}")), F.lit(1), F.size(f"_a{i}"))
        df = df.withColumn(f"_r{i}", out)
        out = F.col(f"_r{i}")
    return df.withColumn("denoised", out).drop(*[x for x in df.columns if x.startswith("_")])
