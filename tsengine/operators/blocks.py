"""Work on long series in blocks, so that one series spreads over many tasks.

`order` numbers a series' rows from 1 without gaps. A block is BLOCK rows in sequence. What a row
needs of its neighbours comes as a halo of copied rows where it lies within a bound, and as a
state carried from block to block where it doesn't."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows of a block: some megabytes of a few columns.
BLOCK = 1 << 16


def block_of(order: str, block: int) -> Column:
    return F.floor((F.col(order) - 1) / block).cast("long")


def in_blocks(df: DataFrame, work: Callable[[DataFrame, WindowSpec], DataFrame], before: int, after: int, keys: str = "well", order: str = "t", block: int | None = None) -> DataFrame:
    """work(rows, window) over blocks with a halo of `before` and `after` rows.

    `window` takes the place of a window along the whole series: it has keys, block and order.
    Work must reach no further than the halo, and keep the columns _block and _own of its rows,
    which go at the end together with the halo's rows. A block's first rows see nothing before
    the halo, but in the first block, which begins as the series does."""
    block = block or BLOCK
    number = F.col(order) - 1
    blocks = F.sequence(F.floor(F.greatest(number - after, F.lit(0)) / block), F.floor((number + before) / block))
    spread = df.withColumn("_block", F.explode(blocks)).withColumn("_own", block_of(order, block) == F.col("_block"))
    done = work(spread, Window.partitionBy(keys, "_block").orderBy(order))
    return done.filter("_own").drop("_own", "_block")


def carried(df: DataFrame, states: dict[str, tuple[Column, Callable[[Column], Column], bool]], keys: str = "well", order: str = "t", block: int | None = None) -> tuple[DataFrame, WindowSpec, WindowSpec]:
    """`df` with its blocks and, for each name in `states`, what the blocks before a row's own give.

    A state is (value, aggregate, reverse): the aggregate (sum, max or min, say) of the value over
    all earlier blocks, or all later ones with reverse; null if there are none. Only one row for
    each block of a series meets in one task. Also returns the windows over a block's rows,
    forward and backward; the column _block is the caller's to drop."""
    df = df.withColumn("_block", block_of(order, block or BLOCK))
    totals = df.groupBy(keys, "_block").agg(*[agg(value).alias(name) for name, (value, agg, _) in states.items()])
    w = Window.partitionBy(keys)
    along = {False: w.orderBy("_block"), True: w.orderBy(F.desc("_block"))}
    before = totals.select(keys, "_block", *[agg(F.col(name)).over(along[reverse].rowsBetween(Window.unboundedPreceding, -1)).alias(name) for name, (_, agg, reverse) in states.items()])
    w = Window.partitionBy(keys, "_block")
    return df.join(before, [keys, "_block"], "left"), w.orderBy(order), w.orderBy(F.desc(order))


def cumulative(df: DataFrame, c: str, out: str, keys: str = "well", order: str = "t") -> DataFrame:
    """The running total of c along each series; nulls add nothing."""
    df, w, _ = carried(df, {"_before": (F.col(c), F.sum, False)}, keys, order)
    here = F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.when(here.isNotNull() | F.col("_before").isNotNull(), F.coalesce(here, F.lit(0)) + F.coalesce("_before", F.lit(0)))
    return df.withColumn(out, total).drop("_before", "_block")


def renumbered(df: DataFrame, keys: str = "well", order: str = "t") -> DataFrame:
    """Rows numbered from 1 again, in the same order: `order` may have gaps."""
    df, w, _ = carried(df, {"_before": (F.lit(1), F.sum, False)}, keys, order)
    return df.withColumn(order, (F.row_number().over(w) + F.coalesce("_before", F.lit(0))).cast("int")).drop("_before", "_block")


def scan(a: np.ndarray, b: np.ndarray, start: float | np.ndarray = 0.0) -> np.ndarray:
    """x[i] = a[i] x[i - 1] + b[i] along the last axis, from x[-1] = start: the maps are composed by
    doubling, in as many steps as the length has bits."""
    a, x = np.array(np.broadcast_to(a, b.shape), float), np.array(b, float)
    if not x.shape[-1]:
        return x
    x[..., 0] += a[..., 0] * start
    step = 1
    while step < x.shape[-1]:
        x[..., step:] += a[..., step:] * x[..., :-step].copy()
        a[..., step:] *= a[..., :-step].copy()
        step *= 2
    return x


def geometric(z: np.ndarray, ratio: float, width: int) -> np.ndarray:
    """Sums of ratio^u z[t - u] over u < width, for each t from width - 1 on.

    A window lies in two blocks of its own width: the suffix of one and the prefix of the next,
    the two stacks of a sliding composition. Nothing is ever subtracted."""
    n = len(z)
    if width < 1 or n < width:
        return np.zeros(max(0, n - width + 1))
    rows = np.zeros((-(-n // width), width))
    rows.ravel()[:n] = z
    power = ratio ** np.arange(width, dtype=float)
    head = scan(np.float64(ratio), rows)
    tail = np.cumsum((rows * power[::-1])[:, ::-1], 1)[:, ::-1]
    t = np.arange(width - 1, n)
    k, i = t // width, t % width
    inside = i == width - 1
    rest = np.where(inside, 0.0, tail[np.maximum(k - 1, 0), np.minimum(i + 1, width - 1)] * (power[i] * ratio))
    return head[k, i] + rest


def starts_of_blocks(maps: DataFrame, keys: list[str], columns: list[str], reverse: bool = False) -> DataFrame:
    """The state with which each block begins, from the blocks' maps x -> _a x + column: one row for
    each block of a series, in one task for each series. With reverse the last block is first."""
    schema = ", ".join(f"`{k}` {t}" for k, t in maps.dtypes if k in keys) + ", _block long, " + ", ".join(f"`_start_{c}` double" for c in columns)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block", ascending=not reverse)
        out = pdf[keys].assign(_block=pdf["_block"] + (-1 if reverse else 1))
        return out.assign(**{f"_start_{c}": scan(pdf["_a"].to_numpy(float), pdf[c].to_numpy(float)) for c in columns})

    return maps.groupBy(*keys).applyInPandas(run, schema)
