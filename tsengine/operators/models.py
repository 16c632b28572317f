"""Forecasters: least squares from windowed sums, and Spark ML models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.files import written
from .blocks import in_blocks
from .clean import along


def _gram(df: DataFrame, window: int, horizon: int) -> tuple[DataFrame, list[str]]:
    """Lags, the label and a constant of each anchor, and the names of all products."""
    work = lambda rows, w: _anchors(rows, w, window, horizon, "_block", "_own")
    return in_blocks(df, work, window - 1, horizon), [f"x{i}" for i in range(window + 1)]


def _anchors(rows: DataFrame, w: WindowSpec, window: int, horizon: int, *kept: str) -> DataFrame:
    x = [F.lit(1.0).alias("x0"), *[F.lag("oil", k).over(w).alias(f"x{k + 1}") for k in range(window)]]
    return rows.select(*kept, "well", "t", *x, F.lead("oil", horizon).over(w).alias("y"))


def lag_regression(df: DataFrame, window: int = 7, horizon: int = 56) -> DataFrame:
    """beta of each well: least squares of the label on the last `window` values.

    One aggregate a well gathers the normal equations; only they reach Python."""
    rows, xs = _gram(df, window, horizon)
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(xs) for b in xs[i:]] + [F.sum(F.col(a) * F.col("y")).alias(f"{a}_y") for a in xs]
    return _solve(rows.na.drop().groupBy("well").agg(*sums), ["well"], xs)


def _betas(pdf: pd.DataFrame, xs: list[str]) -> np.ndarray:
    """Solutions of all rows' normal equations at once, by a ridge of 1e-9 of the trace."""
    g = np.empty((len(pdf), len(xs), len(xs)))
    for i, a in enumerate(xs):
        for j, b in enumerate(xs[i:], i):
            g[:, i, j] = g[:, j, i] = pdf[f"{a}_{b}"]
    right = pdf[[f"{a}_y" for a in xs]].to_numpy(float)
    ridge = np.eye(len(xs)) * (1e-9 * np.trace(g, axis1=1, axis2=2))[:, None, None]
    return np.linalg.solve(g + ridge, right[:, :, None])[:, :, 0]


def _solve(sums: DataFrame, keys: list[str], xs: list[str]) -> DataFrame:
    """Normal equations in rows -> beta."""

    def run(it):
        for pdf in it:
            yield pdf[keys].assign(beta=list(_betas(pdf, xs)))

    types = dict(sums.dtypes)
    return sums.mapInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", beta array<double>")


def walk_forward(df: DataFrame, length: int = 150, window: int = 7, horizon: int = 56, known: bool = True) -> DataFrame:
    """A forecast at each fold T from the model of the anchors T - (horizon + length - window)
    .. T - horizon. Normal equations of a frame are differences of running sums over a block of
    the series and what lies before it in its first frame, so each row is added once, whatever
    the frame's length, and folds are never copied.

    Anchors with a null among their lags or label are left out of the fit, as a whole; a fold
    whose own lags have one, or whose frame has fewer whole anchors than the model has numbers,
    gives no forecast. Folds whose truth is not known yet are left out unless known is False."""
    xs, span = [f"x{i}" for i in range(window + 1)], length - window + 1
    pairs = [(a, b) for i, a in enumerate(xs) for b in xs[i:]] + [(a, "y") for a in xs]

    def work(rows: DataFrame, w: WindowSpec) -> DataFrame:
        keep = ["_block", "_own", "well", "t", "y", *xs]
        running = w.rowsBetween(Window.unboundedPreceding, 0)
        rows = _anchors(rows, w, window, horizon, "_block", "_own")
        whole = F.col("y").isNotNull()
        for x in xs:
            whole = whole & F.col(x).isNotNull()
        total = lambda c: F.sum(F.when(whole, c).otherwise(0.0)).over(running)
        # The label of a future anchor isn't in the frame, as frames end `horizon` rows before T.
        rows = rows.select(*keep, total(F.lit(1.0)).alias("_n"), *[total(F.col(a) * F.col(b)).alias(f"_{a}_{b}") for a, b in pairs])
        frame = lambda c: F.lag(c, horizon).over(w) - F.lag(c, horizon + span, 0).over(w)
        rows = rows.select(*keep, frame("_n").alias("n"), *[frame(f"_{a}_{b}").alias(f"{a}_{b}") for a, b in pairs])
        return rows.filter((F.col("t") >= horizon + length) & (F.col("n") >= len(xs)))

    rows = in_blocks(df, work, horizon + length, horizon)
    rows = rows.na.drop(subset=[*xs, "y"] if known else xs)
    beta = _solve(rows.drop("n"), ["well", "t", "y", *xs], xs)
    pred = sum((F.get("beta", F.lit(i)) * F.col(x) for i, x in enumerate(xs)), F.lit(0.0))
    return beta.select("well", "t", F.col("y").alias("truth"), pred.alias("pred"))


def blend_weights(df: DataFrame, keys: list[str], a: str, b: str, y: str, low: float = 0.2, high: float = 1.0) -> DataFrame:
    """(keys, alpha): the weight of a against b that fits y best by least squares, kept within low and
    high, where the sum of squares is least too, as it is a parabola. One aggregate of cross terms;
    where a and b never differ, alpha is high."""
    d = F.col(a) - F.col(b)
    best = F.try_divide(F.sum(d * (F.col(y) - F.col(b))), F.sum(d * d))
    return df.groupBy(*keys).agg(F.coalesce(F.least(F.greatest(best, F.lit(low)), F.lit(high)), F.lit(high)).alias("alpha"))


def linear_attribution(df: DataFrame, features: list[str], target: str, horizon: int) -> DataFrame:
    """phi_<feature> of each row: the exact Shapley values beta (x - mean x) of the linear model
    that is fitted to each series' target `horizon` rows ahead."""
    rows = df.select("well", "t", *features, F.lead(target, horizon).over(along()).alias("y"))
    known = rows.filter("y is not null")
    cov = [F.covar_pop(a, b).alias(f"{a}__{b}") for a in features for b in [*features, "y"]]
    sums = known.groupBy("well").agg(*cov)

    def solve(it):
        for pdf in it:
            betas = [np.linalg.solve([[r[f"{a}__{b}"] for b in features] for a in features], [r[f"{a}__y"] for a in features]).tolist() for r in pdf.to_dict("records")]
            yield pdf[["well"]].assign(beta=betas)

    means = rows.groupBy("well").agg(*[F.avg(c).alias(f"_{c}") for c in features])
    fitted = rows.join(sums.mapInPandas(solve, "well string, beta array<double>").join(means, "well"), "well")
    return fitted.select("well", "t", *[(F.get("beta", F.lit(i)) * (F.col(c) - F.col(f"_{c}"))).alias(f"phi_{c}") for i, c in enumerate(features)])


def gbt_forecast(windows: DataFrame, max_iter: int = 5, max_depth: int = 3, step: float = 0.3, seed: int = 7) -> DataFrame:
    """Boosted trees pooled over wells, on ratio-normalised windows with a chronological split."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GBTRegressor

    rows = windows.select("well", "t", "label", "window_mean", "side", array_to_vector("lags").alias("features"))
    model = GBTRegressor(maxIter=max_iter, maxDepth=max_depth, stepSize=step, maxBins=64, seed=seed).fit(rows.filter("side = 'train'"))
    return model.transform(rows.filter("side = 'test'")).select("well", "t", (F.col("label") * F.col("window_mean")).alias("truth"), (F.col("prediction") * F.col("window_mean")).alias("pred"))


#: Rows of a partition where a fit's many short jobs read the same rows again.
FIT_ROWS = 16_384


def in_partitions(df: DataFrame, n: int, order: list[str], size: int | None = None) -> DataFrame:
    """`df`, of n rows, in ranges of `order` of about `size` rows each, sorted: as many tasks as its
    rows are worth, whatever plan they come from, and the same sequence in any cluster."""
    return df.repartitionByRange(max(1, -(-n // (size or FIT_ROWS))), *order).sortWithinPartitions(*order)


def gbt_search(windows: DataFrame, grid: dict[str, list], n_iter: int | None = None, folds: int = 3, last: int | None = None, seed: int = 7) -> DataFrame:
    """Boosted trees of each point of the grid, scored by the mean squared error of `folds`
    cross-validation folds over all training rows of all wells that have a label. n_iter: only so
    many points, drawn at random; last: only so many rows of each well, the latest. Returns a row
    for each point: params, mse, chosen.

    A booster's first trees are the shorter booster, so points that differ only in maxIter share
    their fits, and the longest is scored after each of its trees."""
    import random
    from itertools import product
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GBTRegressor

    rows = windows.filter("side = 'train' and label is not null")
    if last is not None:
        place = F.row_number().over(Window.partitionBy("well").orderBy(F.desc("t")))
        rows = rows.withColumn("_k", place).filter(F.col("_k") <= last)
    labelled = written(rows.select("well", "t", "lags", "label", F.pmod(F.xxhash64("well", "t"), F.lit(folds)).cast("int").alias("fold")))
    sizes = [r["count"] for r in labelled.groupBy("fold").count().collect()]
    if len(sizes) < max(folds, 2):
        raise ValueError(f"{sum(sizes)} rows leave a fold of {folds} empty")
    # Files, not a cached table: a fit's plan is then one scan, for which the driver keeps no thread and no stages.
    rows = written(in_partitions(labelled, sum(sizes), ["well", "t"]).select("lags", "label", "fold"))
    rows = rows.select(array_to_vector("lags").alias("features"), "label", "fold")

    points = [dict(zip(grid, values)) for values in product(*grid.values())]
    if n_iter is not None and n_iter < len(points):
        points = random.Random(seed).sample(points, n_iter)
    gbt = GBTRegressor(seed=seed, maxBins=64)
    trees = lambda p: p.get("maxIter", gbt.getMaxIter())
    others = lambda p: tuple((k, v) for k, v in p.items() if k != "maxIter")
    longest: dict[tuple, int] = {}
    for p in points:
        longest[others(p)] = max(trees(p), longest.get(others(p), 0))

    def errors(fit: tuple) -> list[float]:
        fold, point, n = fit
        model = gbt.fit(rows.filter(F.col("fold") != fold), {gbt.getParam(k): v for k, v in (*point, ("maxIter", n))})
        return model.evaluateEachIteration(rows.filter(F.col("fold") == fold), "squared")

    fits = [(fold, point, n) for point, n in longest.items() for fold in range(folds)]
    with ThreadPool(8) as pool:
        scored = dict(zip(fits, pool.map(inheritable_thread_target(windows.sparkSession)(errors), fits, chunksize=1)))
    mse = [sum(scored[fold, others(p), longest[others(p)]][trees(p) - 1] for fold in range(folds)) / folds for p in points]
    best = min(range(len(points)), key=lambda i: mse[i])
    return windows.sparkSession.createDataFrame([({k: float(v) for k, v in p.items()}, float(m), i == best) for i, (p, m) in enumerate(zip(points, mse))], "params map<string,double>, mse double, chosen boolean")


def choose_k(df: DataFrame, features: str, grid: list[int], share: float = 0.98, seed: int = 7) -> DataFrame:
    """Silhouette of each k, and whether it is the smallest within `share` of the best."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    rows = df.select(array_to_vector(F.transform(features, lambda x: x.cast("double"))).alias("features")).persist()
    found = [(k, float(ClusteringEvaluator().evaluate(KMeans(k=k, seed=seed, maxIter=10).fit(rows).transform(rows)))) for k in grid]
    rows.unpersist()
    best = max(s for _, s in found)
    pick = min(k for k, s in found if s >= share * best)
    return df.sparkSession.createDataFrame([(k, s, k == pick) for k, s in found], "k int, silhouette double, chosen boolean")


def trend_weights(n: int, degree: int = 2) -> np.ndarray:
    """Least squares as a matrix: coefficients are these weights times the n values."""
    return np.linalg.pinv(np.vander(np.linspace(0, 1, n), degree + 1, increasing=True))


def polynomial_trend(windows: DataFrame, c: str, n: int, degree: int = 2) -> DataFrame:
    """Coefficients of a polynomial in t from 0 to 1, by least squares, of each array of n values."""
    dot = lambda w: F.aggregate(F.zip_with(c, F.array(*map(F.lit, w.tolist())), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return windows.withColumn("coef", F.array(*map(dot, trend_weights(n, degree))))
