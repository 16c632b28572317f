"""Operators against plain versions: filters, models, tests, files and streams."""

import json
import os
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tsengine.operators import blocks, clean, experiments, features, metrics, models, ranking, signals
from tsengine.sources import files
from tsengine.streaming import jobs, state


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(1)
    rows = [(w, i + 1, float(v)) for w, n in (("a", 900), ("b", 300)) for i, v in enumerate(np.abs(np.cumsum(rng.normal(size=n))) + 1)]
    return spark.createDataFrame(rows, "well string, t int, oil double").repartition(3)


def arrays(df, c="oil"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.t):
        out.setdefault(r.well, []).append(r[c])
    return {w: np.array(v) for w, v in out.items()}


def kalman(z, q=1e-4, r=1e-3, eps=1e-6):
    """The recursion, value by value."""
    z = np.where(np.asarray(z) + eps <= 0, eps, np.asarray(z) + eps)
    x, p, out = z[0], 1.0, []
    for i, v in enumerate(z):
        p = p + q if i else p
        k = p / (p + r)
        x, p = x + k * (v - x), p * (1 - k)
        out.append(x)
    return np.array(out)


def kalman_smooth(z, q=1e-5, r=1e-3):
    x, p, xs, ps = z[0], 1.0, [], []
    for i, v in enumerate(z):
        p = p + q if i else p
        k = p / (p + r)
        x, p = x + k * (v - x), p * (1 - k)
        xs.append(x)
        ps.append(p)
    for i in range(len(z) - 2, -1, -1):
        xs[i] += ps[i] / (ps[i] + q) * (xs[i + 1] - xs[i])
    return np.array(xs)


def exponential(z, alpha=0.2):
    out = [z[0]]
    for v in z[1:]:
        out.append(out[-1] + alpha * (v - out[-1]))
    return np.array(out)


PLAIN = {"kalman": kalman, "kalman_smooth": kalman_smooth, "exponential": exponential}
PARAMS = [("kalman", {}), ("kalman", {"q": 1e-8}), ("kalman", {"q": 0.0}), ("kalman", {"q": 5.0, "r": 2.0}), ("kalman_smooth", {}), ("kalman_smooth", {"q": 1e-8, "r": 1.0}), ("kalman_smooth", {"q": 0.0}), ("exponential", {}), ("exponential", {"alpha": 1.0})]


@pytest.mark.parametrize("method, params", PARAMS)
def test_filters_in_blocks(series, method, params):
    raw = arrays(series)
    for block in (100, 8192):
        got = signals.filter_columns(series.withColumn("kept", F.lit("x")), ["oil"], method, block=block, **params)
        assert got.columns == ["well", "t", "oil", "kept", "oil_Original"]
        for w, v in arrays(got).items():
            assert np.allclose(v, PLAIN[method](raw[w], **params), rtol=1e-10, atol=1e-10)
        assert all(np.array_equal(v, raw[w]) for w, v in arrays(got, "oil_Original").items())


@pytest.mark.parametrize("n, q, r", [(7, 1e-5, 1e-3), (30, 1e-5, 1e-3), (12, 1.0, 0.1), (1, 1e-5, 1e-3), (9, 0.0, 1.0)])
def test_smoothed_windows(spark, n, q, r):
    y = np.random.default_rng(3).normal(size=(20, n))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "i int, y array<double>")
    for row in signals.smooth_windows(df, "y", n, q, r).collect():
        assert np.allclose(row.smoothed, kalman_smooth(y[row.i], q, r))
    if n == 7:
        for name in signals.WINDOW_FILTERS:
            got = signals.filter_windows(df, {"y": n}, name).collect()
            assert len(got) == 20 and all(len(row.y_filtered) == n for row in got)


def test_filters_by_wrong_names(spark, series):
    with pytest.raises(ValueError):
        signals.filter_windows(series, {"oil": 1}, "nothing")
    with pytest.raises(ValueError):
        signals.filter_columns(series, ["nothing"])
    with pytest.raises(ValueError):
        signals.filter_columns(series, ["oil"], "nothing")


@pytest.mark.parametrize("method", sorted(PLAIN))
def test_one_long_series_is_filtered_in_many_tasks(spark, method):
    """A random walk of a million rows; a small q remembers for long."""
    rng = np.random.default_rng(5)
    z = np.abs(np.cumsum(rng.normal(size=1_000_000))) + 1
    df = spark.createDataFrame(pd.DataFrame({"well": "w", "t": np.arange(1, len(z) + 1, dtype=np.int32), "oil": z}))
    params = {} if method == "exponential" else {"q": 1e-8}
    got = signals.filter_columns(df, ["oil"], method, **params)
    tasks = got.select(F.spark_partition_id().alias("p")).distinct().count()
    x = got.select("t", "oil").toPandas().sort_values("t")["oil"].to_numpy()
    assert tasks > 1 and np.allclose(x, PLAIN[method](z, **params), rtol=1e-9)


@pytest.mark.parametrize("q", [1e-6, 1e-8, 0.0, 1.0])
def test_filter_of_each_fold(series, q):
    raw = arrays(series)
    for block in (64, 8192):
        got = signals.kalman_per_fold(series, "oil", length=30, window=4, horizon=10, q=q, block=block).collect()
        assert len(got) == len({(r.well, r.fold) for r in got}) == sum(len(v) - 49 for v in raw.values())
        for r in got[::50]:
            x = kalman(raw[r.well][r.fold - 40 : r.fold + 10], q=q)
            assert np.allclose(r.lags, x[36:40]) and np.isclose(r.label, x[-1])


def field(spark, n, seed=4, null=0.3):
    rng = np.random.default_rng(seed)
    some = lambda: np.where(rng.random(n) < null, None, np.round(rng.random(n) * 9 + 1, 3))
    rows = list(zip(["w"] * n, range(1, n + 1), np.round(np.where(rng.random(n) < 0.1, 0.0, rng.random(n) * 9), 3).tolist(), some().tolist(), some().tolist(), some().tolist(), [float(i % 4) for i in range(n)]))
    rows += [("v", t, *rest) for _, t, *rest in rows[: n // 3]]
    return spark.createDataFrame(rows, "well string, t int, oil double, gas double, downhole double, whp double, choke double").repartition(3)


WORK = {
    "ffill": lambda d: clean.ffill(d, "whp", "f"),
    "impute": lambda d: clean.causal_impute(d, "whp", "f"),
    "cumulative": lambda d: blocks.cumulative(d, "gas", "f"),
    "renumbered": lambda d: blocks.renumbered(d.filter("oil > 1")),
    "field": features.field_features,
    "simulated": features.simulated_features,
    "lags": lambda d: features.lag_features(d, "oil", 4, 5),
    "windows": lambda d: features.window_rows(d, "oil", ["gas"], 5, 7),
    "sequences": lambda d: features.seq_windows(d, ["oil", "choke"], "oil", 6, 9),
    "walk_forward": lambda d: models.walk_forward(d, 30, 3, 5).select("well", "t", "truth", F.round("pred", 6)),
    "regression": lambda d: models.lag_regression(d, 3, 5).select("well", F.transform("beta", lambda x: F.round(x, 6))),
}


@pytest.mark.parametrize("name", sorted(WORK))
def test_blocks_change_nothing(spark, name, monkeypatch):
    """The same rows whether a series is one block or many."""
    df = field(spark, 330)

    def rows():
        return sorted(repr([round(v, 7) if isinstance(v, float) else v for v in r]) for r in WORK[name](df).collect())

    whole = rows()
    for size in (7, 64):
        monkeypatch.setattr(blocks, "BLOCK", size)
        assert rows() == whole and whole


def test_one_long_series_spreads_over_many_tasks(spark):
    n = 500_000
    df = spark.range(1, n + 1).select(F.lit("w").alias("well"), F.col("id").cast("int").alias("t"), (F.abs(F.sin("id")) + 1).alias("oil"), F.when(F.col("id") % 3 > 0, F.col("id") * 1.0).alias("whp"))
    for work, name in ((features.lag_features(df, "oil", 3, 5), "label"), (clean.causal_impute(df, "whp", "f"), "f"), (blocks.cumulative(df, "oil", "total"), "total"), (models.walk_forward(df, 30, 3, 5), "pred")):
        got = work.groupBy(F.spark_partition_id()).agg(F.count(name).alias("n")).collect()
        assert len(got) > 1 and sum(r.n for r in got) > n - 100
    t = np.arange(1, n + 1)
    total = blocks.cumulative(df, "oil", "total").filter(F.col("t") == n).first().total
    assert np.isclose(total, np.sum(np.abs(np.sin(t)) + 1), rtol=1e-12)


def test_walk_forward_leaves_rows_with_nulls_out(spark):
    rng = np.random.default_rng(8)
    v = [float(x) for x in np.abs(np.cumsum(rng.normal(size=320))) + 1]
    v[100] = v[101] = v[200] = None
    df = spark.createDataFrame([("a", i + 1, x) for i, x in enumerate(v)], "well string, t int, oil double")
    got = {r.t: r.pred for r in models.walk_forward(df, 40, 3, 5).collect()}
    row = lambda i: [1.0, v[i], v[i - 1], v[i - 2]]
    want = {}
    for t in range(45, 316):
        whole = [i for i in range(t - 1 - 42, t - 5) if None not in row(i) and v[i + 5] is not None]
        if None in row(t - 1) or v[t + 4] is None or len(whole) < 4:
            continue
        x = np.array([row(i) for i in whole])
        g = x.T @ x
        beta = np.linalg.solve(g + np.eye(4) * 1e-9 * np.trace(g), x.T @ np.array([v[i + 5] for i in whole]))
        want[t] = beta @ row(t - 1)
    assert got.keys() == want.keys() and all(np.isclose(got[t], want[t], rtol=1e-6) for t in want)


def test_normal_equations_of_many_folds_are_solved_together():
    xs, rng = ["x0", "x1", "x2"], np.random.default_rng(4)
    x = rng.normal(size=(60_000, 9, 3))
    y = rng.normal(size=(60_000, 9))
    g, right = x.transpose(0, 2, 1) @ x, (x * y[:, :, None]).sum(1)
    sums = {f"{a}_{b}": g[:, i, j] for i, a in enumerate(xs) for j, b in enumerate(xs) if i <= j} | {f"{a}_y": right[:, i] for i, a in enumerate(xs)}
    pdf, began = pd.DataFrame(sums), time.process_time()
    got = models._betas(pdf, xs)
    assert time.process_time() - began < 1
    assert all(np.allclose(got[i], np.linalg.solve(g[i] + np.eye(3) * 1e-9 * np.trace(g[i]), right[i]), rtol=1e-12) for i in range(0, 60_000, 997))
    assert models._betas(pdf[:0], xs).shape == (0, 3)


def test_regressions_are_least_squares(spark, series):
    raw = arrays(series)
    for r in models.lag_regression(series, 3, 5).collect():
        v = raw[r.well]
        x = np.array([[1, v[i], v[i - 1], v[i - 2]] for i in range(2, len(v) - 5)])
        assert np.allclose(r.beta, np.linalg.lstsq(x, v[7:], rcond=None)[0], atol=1e-4)
    got = {(r.well, r.t): r for r in models.walk_forward(series, 40, 3, 5).collect()}
    assert len(got) == sum(len(v) - 5 - (40 + 5) + 1 for v in raw.values())
    for (w, t), r in list(got.items())[::60]:
        v = raw[w]
        anchors = range(t - 1 - 5 - 37, t - 5)
        x = np.array([[1, v[i], v[i - 1], v[i - 2]] for i in anchors])
        g = x.T @ x
        beta = np.linalg.solve(g + np.eye(4) * 1e-9 * np.trace(g), x.T @ v[[i + 5 for i in anchors]])
        assert np.isclose(r.pred, beta @ [1, v[t - 1], v[t - 2], v[t - 3]], rtol=1e-5) and r.truth == v[t + 4]
    later = models.walk_forward(series, 40, 3, 5, known=False)
    assert later.count() == len(got) + 5 * len(raw)


def test_trends_are_those_of_polyfit(spark):
    y = np.random.default_rng(2).normal(size=(20, 30))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "i int, y array<double>")
    for r in models.polynomial_trend(df, "y", 30).collect():
        assert np.allclose(r.coef, np.polynomial.polynomial.polyfit(np.linspace(0, 1, 30), y[r.i], 2))


@pytest.mark.parametrize("t, dof, p", [(2.0, 10.0, 0.0733880), (-2.0, 10.0, 0.0733880), (0.0, 5.0, 1.0), (12.7062047, 1.0, 0.05), (1.9599640, 1e6, 0.05), (2.5, 17.3, 0.0227743)])
def test_p_values(spark, t, dof, p):
    got = spark.range(1).select(metrics.t_test_p(F.lit(t), F.lit(dof)).alias("p")).first().p
    if dof == 17.3:  # by a sum of the density
        x = np.linspace(0, t, 200_001)
        wide = np.linspace(0, 400, 4_000_001)
        f = lambda u: (1 + u * u / dof) ** (-(dof + 1) / 2)
        p = 1 - np.trapezoid(f(x), x) / np.trapezoid(f(wide), wide)
    assert abs(got - p) < 2e-5


def test_place_is_the_order(spark):
    rows = [(g, k) for g in ("b", "a", None, "c") for k in range(7)]
    df = spark.createDataFrame(rows, "g string, k int").repartition(3)
    got = sorted(metrics.place(df, [F.col("g")], [F.desc("k")]).collect(), key=lambda r: r.place)
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or "", -r[1]))
    assert [(r.g, r.k) for r in got] == want and [r.place for r in got] == list(range(1, 29))


@pytest.mark.parametrize("rows", [1_000_000, 40])
def test_ranks_and_quantiles(spark, rows, monkeypatch):
    """A group with one very frequent value, nulls and NaN; ranges of few rows."""
    monkeypatch.setattr(ranking, "ROWS", rows)
    rng = np.random.default_rng(9)
    values = [("a", float(v), i) for i, v in enumerate(np.round(rng.normal(size=300), 1))] + [("a", 0.5, i) for i in range(300, 700)]
    values += [("b", float(v), i) for i, v in enumerate(rng.random(50))] + [(None, 2.0, 1), (None, 1.0, 2), ("c", None, 1), ("a", None, 1), ("b", float("nan"), 2)]
    df = spark.createDataFrame(values, "g string, v double, i int").repartition(3)
    got = {r.g: r for r in ranking.quantiles(df, ["g"], "v", {"q": 0.3, "m": 0.5}).collect()}
    for g in ("a", "b", None):
        v = [x for k, x, _ in values if k == g and x is not None and x == x]
        assert np.allclose([got[g].q, got[g].m], np.quantile(v, [0.3, 0.5]))
    assert got["c"].q is None
    for g, v, rank in [(r.g, r.v, r.rank) for r in ranking.average_ranks(df, ["g"], "v", "rank").collect()]:
        mine = [x for k, x, _ in values if k == g and x is not None and x == x]
        assert rank is None if v is None or v != v else rank == sum(x < v for x in mine) + (sum(x == v for x in mine) + 1) / 2
    known = df.filter("v is null or not isnan(v)")
    places = sorted((r.place, r.v is not None, r.v or 0, r.g or "", r.i) for r in ranking.numbered(known, "v", ["g", "i"], "place").collect())
    assert [p[0] for p in places] == list(range(1, known.count() + 1)) and [p[1:] for p in places] == sorted(p[1:] for p in places)


def test_search_draws_distinct_points(spark, series):
    w = features.chrono_split(features.ratio_normalize(features.window_rows(series, "oil", [], 3, 5)), 0.2)
    got = models.gbt_search(w, {"maxIter": [1, 2], "maxDepth": [1, 2]}, 4, folds=2).collect()
    assert len({tuple(sorted(r.params.items())) for r in got}) == 4 and sum(r.chosen for r in got) == 1
    assert min(r.mse for r in got) == next(r.mse for r in got if r.chosen)


def test_search_is_over_all_rows_and_points(spark, series):
    """Every training row counts, not the last of each well, and every point; shorter boosters that
    are scored within the longest equal those fitted alone. A window of zeros has no label."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GBTRegressor
    from pyspark.ml.tuning import CrossValidator

    zeros = series.withColumn("oil", F.when((F.col("well") == "b") & F.col("t").between(50, 70), 0.0).otherwise(F.col("oil")))
    w = features.chrono_split(features.ratio_normalize(features.window_rows(zeros, "oil", [], 3, 5)), 0.2).localCheckpoint()
    assert w.filter("label is null").count() > 0
    grid = {"maxIter": [1, 3], "maxDepth": [2], "subsamplingRate": [0.6, 1.0]}
    rows = w.filter("side = 'train' and label is not null").withColumns({"fold": F.pmod(F.xxhash64("well", "t"), F.lit(2)).cast("int"), "features": array_to_vector("lags")})
    assert rows.count() > 900
    gbt = GBTRegressor(seed=7, maxBins=64)

    def alone(rows):
        maps = [{gbt.maxIter: n, gbt.maxDepth: 2, gbt.subsamplingRate: s} for n in (1, 3) for s in (0.6, 1.0)]
        cv = CrossValidator(estimator=gbt, estimatorParamMaps=maps, evaluator=RegressionEvaluator(metricName="mse"), numFolds=2, foldCol="fold")
        return {(m[gbt.maxIter], m[gbt.subsamplingRate]): e for m, e in zip(maps, cv.fit(models.in_partitions(rows, 1, ["well", "t"])).avgMetrics)}

    scored = lambda **kw: {(r.params["maxIter"], r.params["subsamplingRate"]): r.mse for r in models.gbt_search(w, grid, folds=2, **kw).collect()}
    same = lambda got, want: got.keys() == want.keys() and all(np.isclose(got[k], want[k], rtol=1e-9) for k in want)
    assert same(scored(n_iter=4), alone(rows))
    latest = rows.join(rows.groupBy("well").agg(F.max("t").alias("_to")), "well").filter("t > _to - 60")
    assert same(scored(last=60), alone(latest))


def test_search_names_empty_folds(spark, series):
    w = features.chrono_split(features.ratio_normalize(features.window_rows(series, "oil", [], 3, 5)), 0.2)
    with pytest.raises(ValueError, match="empty"):
        models.gbt_search(w.filter("t > 1e6"), {"maxIter": [1]}, 1, folds=2)


def test_search_is_the_same_from_any_partitions(spark, series):
    """Subsampling draws by partition: a fit's rows come in the same ones, no more than they fill."""
    w = features.chrono_split(features.ratio_normalize(features.window_rows(series, "oil", [], 3, 5)), 0.2).localCheckpoint()
    run = lambda d: [r.mse for r in models.gbt_search(d, {"maxIter": [1], "maxDepth": [2], "subsamplingRate": [0.6]}, 1, folds=2).collect()]
    assert run(w.coalesce(1)) == run(w.repartition(13, "label"))
    parts = models.in_partitions(spark.range(1000), 1000, ["id"], 300)
    assert parts.rdd.getNumPartitions() == 4 and [r.id for r in parts.collect()] == list(range(1000))


def test_failing_jobs_leave_the_others_whole(spark, series, monkeypatch):
    def odd(z, window, horizon, length):
        raise RuntimeError("a defect")

    monkeypatch.setitem(experiments.MODELS, "odd", odd)
    table = [(1, "a", "linear", 3, 5, 40), (2, "a", "nothing", 3, 5, 40), (3, "b", "mean", 4, 5, 40), (4, "zzz", "mean", 4, 5, 40), (5, "b", "mean", None, 5, 40), (6, "b", "last", 1, 5, 400), (7, "a", "linear", 30, 5, 40), (8, "b", "last", 1, 5, 40)]
    jobs_ = spark.createDataFrame(table, "job_id long, well string, model string, window int, horizon int, length int")
    for block in (64, 8192):
        status, forecasts = experiments.run_jobs(jobs_, series, block)
        got = {r.job_id: (r.status, r.error) for r in status.collect()}
        assert [j for j, (s, _) in got.items() if s == "success"] == [1, 3, 8] or sorted(j for j, (s, _) in got.items() if s == "success") == [1, 3, 8]
        assert "unknown model" in got[2][1] and "zzz" in got[4][1] and "window" in got[5][1] and "fewer" in got[6][1] and "too few" in got[7][1]
        want = {r.t: r.pred for r in models.walk_forward(series.filter("well = 'a'"), 40, 3, 5).withColumn("t", F.col("t") + 5).collect()}
        mine = {r.t: r for r in forecasts.filter("job_id = 1").collect()}
        assert len(mine) > 700 and all(np.isclose(r.pred, want[t], rtol=1e-5) for t, r in mine.items())
        scored = experiments.collate(status, forecasts).collect()
        assert sorted((r.job_id, r.kind) for r in scored) == [(j, k) for j in (1, 3, 8) for k in ("aggregated", "cumulative")]
        raw = arrays(series)["b"]
        e = np.abs(raw[44:] - raw[39:-5])
        row = next(r for r in scored if r.job_id == 8 and r.kind == "aggregated")
        assert np.isclose(row.mae_val, e[: len(e) // 2].mean()) and np.isclose(row.mae_test, e[len(e) // 2 :].mean())
    none = experiments.collate(*experiments.run_jobs(jobs_.filter("false"), series))
    assert none.count() == 0


def test_queues_and_configurations(spark):
    got = [tuple(r) for r in experiments.job_queue(spark, ("a", ["x", "y"]), ("b", [1, 2, 3])).orderBy("exp_id").collect()]
    assert got == [(i * 3 + j + 1, a, b) for i, a in enumerate("xy") for j, b in enumerate((1, 2, 3))]
    assert [c["filter_method"] for c in experiments.filter_configurations(["kalman", "wavelet"])] == ["kalman", "wavelet"]
    assert experiments.filter_configurations([])[0]["apply_adaptive_filtering"] is False


def test_concentration_of_a_published_attribution(spark):
    # Strengths of eleven features and their published concentration.
    strength = [0.48772423373561147, 0.22934939556257128, 0.22746941058883546, 0.382628185984989, 0.13276563527162782, 0.13645797697891895]
    strength += [0.17225421990588075, 0.213144329211597, 0.30044983578651835, 0.47015580222958103, 0.14766796595520443]
    share = spark.createDataFrame([(x / sum(strength),) for x in strength], "share double")
    assert abs(share.agg(metrics.concentration("share").alias("g")).first().g - 0.8376324619361502) < 1e-12


def test_data_check(spark):
    df = spark.createDataFrame([(1.0, 2, "x"), (None, 3, "y"), (float("inf"), 4, "z"), (2e6, 5, None), (float("nan"), 6, "")], "a double, b int, c string")
    got = {r.dataset: r for r in clean.data_check({"one": df, "two": df.select("b"), "none": df.limit(0)}).collect()}
    assert (got["one"].n_missing, got["one"].n_infinite, got["one"].outliers, got["one"].ok) == (2, 1, True, False)
    assert got["two"].ok and got["none"].ok


def test_files(spark, tmp_path):
    quoted = tmp_path / "quoted.tsv"
    quoted.write_text('"WELL\tDAY\tQOOB"\n"w\t1\t2.5"\n"v\tx\t7"\n')
    got = sorted(map(tuple, files.read_tab(spark, str(quoted), ["WELL", "DAY", "QOOB"], ["DAY", "QOOB"]).collect()))
    assert got == [("v", None, 7.0), ("w", 1.0, 2.5)]
    with pytest.raises(ValueError):
        files.read_tab(spark, str(quoted), ["WELL", "OTHER"], [])
    wells = tmp_path / "wells"
    wells.mkdir()
    (wells / "Well_A_x.csv").write_text("Day,Oil\n1,2\n")
    assert [tuple(r) for r in files.read_per_well(spark, str(wells), "Well_([^_/]+)_", ["Day", "Oil"]).collect()] == [("A", 1.0, 2.0)]
    (wells / "Well_B_x.csv").write_text("Date,Oil\n1,2\n")
    with pytest.raises(ValueError):
        files.read_per_well(spark, str(wells), "Well_([^_/]+)_", ["Day", "Oil"])
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_per_well(spark, str(tmp_path / "none"), "x", ["Day"])
    assert files.series_name("WIND") == "GB_GBN_wind_generation_actual" and files.series_name("load", "DE").startswith("DE_load")
    with pytest.raises(ValueError):
        files.series_name("tide")


def test_notebooks(spark, tmp_path):
    stream = lambda t: {"output_type": "stream", "text": t}
    cells = [{"outputs": [stream("a\n"), {"output_type": "display_data"}, stream(["b", "c"])]}, {"source": "no outputs"}, {"outputs": [stream("[d")]}]
    names = ["output_x.ipynb", "output_sens_x.ipynb", "output_0f8fad5b-d9cb-469f-a165-70867728950e.ipynb", "output_x-checkpoint.ipynb", "other.ipynb"]
    for n in names:
        (tmp_path / n).write_text(json.dumps({"cells": cells}, indent=1) if n != "other.ipynb" else "no notebook")
    text = {r.file.split("/")[-1]: r.text for r in files.read_notebook_text(spark, str(tmp_path)).collect()}
    assert text["output_x.ipynb"] == "a\n\nbc\n[d" and text["other.ipynb"] == ""
    found = {r.file.split("/")[-1]: r["mode"] for r in files.find_runs(spark, str(tmp_path)).collect()}
    assert found == {names[0]: "simple", names[1]: "sensitivity", names[2]: "manifest"}
    assert files.find_runs(spark, str(tmp_path), "manifest").count() == 1


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Three files in sequence of time, which a stream takes one after the other."""
    folder = tmp_path_factory.mktemp("stream")
    rng = np.random.default_rng(3)
    rows = [(f"k{int(rng.integers(2))}", i, i * 7, float(rng.random() * 10)) for i in range(900)]
    (folder / "events.parquet").mkdir()
    for f in range(3):
        part = spark.createDataFrame(rows[f * 300 : f * 300 + 300], "event_type string, event_id long, minute int, value double")
        part = part.select("event_type", "event_id", F.timestamp_seconds(F.col("minute") * 60 + 1_700_000_000).cast("timestamp_ntz").alias("ts"), "value")
        part.toPandas().to_parquet(folder / "events.parquet" / f"part-{f}.parquet", coerce_timestamps="us")
    return f"{folder}/events.parquet", {k: [v for t, _, _, v in rows if t == k] for k in ("k0", "k1")}


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.k):
        out.setdefault(r.event_type, []).append(r)
    return out


def test_streams_in_several_batches(spark, events):
    path, values = events
    for k, rows in collected(jobs.online_kalman(spark, path, files=1)).items():
        assert np.allclose([r.x for r in rows], kalman(values[k]), atol=1e-9)
    for k, rows in collected(jobs.rolling_buffer(spark, path, 7, files=1)).items():
        v = values[k]
        assert [r.k for r in rows] == list(range(7, len(v) + 1))
        assert np.allclose([r.total for r in rows], [sum(v[i - 6 : i + 1]) for i in range(6, len(v))])
        assert np.allclose([r.running for r in rows], np.cumsum(v)[6:])
        assert all(r.lags == v[r.k - 7 : r.k][::-1] for r in rows)
    for k, rows in collected(jobs.running_metrics(spark, path, files=1)).items():
        v = values[k]
        errors = [abs(v[i] - np.mean(v[i - 11 : i - 4])) for i in range(11, len(v))]
        assert np.allclose([r.mae for r in rows], np.cumsum(errors) / np.arange(1, len(errors) + 1)) and [r.n for r in rows] == list(range(1, len(errors) + 1))
        y, p = np.array(v[11:]), np.array([np.mean(v[i - 11 : i - 4]) for i in range(11, len(v))])
        assert np.isclose(rows[-1].r2, 1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2)) and np.isclose(rows[-1].smape, 100 * np.mean(2 * abs(y - p) / (y + p)))


def test_refits_are_those_of_the_whole_series(spark, events):
    path, values = events
    rows = [(k, i + 1, x) for k, v in values.items() for i, x in enumerate(v)]
    whole = models.walk_forward(spark.createDataFrame(rows, "well string, t long, oil double"), 60, 3, 5, known=False)
    want = {(r.well, r.t): r.pred for r in whole.collect()}
    got = {(r.event_type, r.k): r.forecast for r in jobs.online_refit(spark, path, files=1).collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[x], want[x], rtol=1e-5) for x in got)


def test_late_rows(spark, tmp_path):
    """A row that is late by less than the bound takes its place in time; one that is later goes."""
    folder = tmp_path / "late.parquet"
    folder.mkdir()
    minutes = [(1, 10), (2, 20), (3, 40)], [(4, 30), (5, 400)], [(7, 390)], [(6, 15), (8, 410)], [(9, 800)]  # 6 comes when 15 has passed
    for f, rows in enumerate(minutes):
        part = pd.DataFrame({"event_type": "k", "event_id": [i for i, _ in rows], "ts": [pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=m) for _, m in rows], "value": [float(i) for i, _ in rows]})
        part.to_parquet(folder / f"part-{f}.parquet", coerce_timestamps="us")
        os.utime(folder / f"part-{f}.parquet", (f, f))
    got = jobs.rolling_buffer(spark, str(folder), 2, files=1, late="60 minutes").orderBy("k").collect()
    kept = [1.0, 2, 4, 3, 7, 5, 8, 9]
    assert [r.lags for r in got] == [[b, a] for a, b in zip(kept, kept[1:])]


@pytest.mark.parametrize("batches", [1, 40])
def test_updated_factors_are_those_of_the_whole_fit(batches):
    rng = np.random.default_rng(6)
    v = np.abs(np.cumsum(rng.normal(size=100_000))) + 1
    v[5_000:5_200] = 3.0  # no rank
    work, got, k = state.Refit(60, 3, 5), {}, 0
    numbers = work.begin()
    for part in np.array_split(v, batches):
        numbers, out = work.step(k, np.array(numbers), pd.DataFrame({"value": part}))
        got |= dict(zip(out.get("k", []), out.get("forecast", [])))
        k += len(part)
    assert sorted(got) == list(range(65, len(v) + 1))
    for t in range(65, len(v) + 1, 37):
        anchors = range(t - 1 - 5 - 57, t - 5)
        x = np.array([[1, v[i], v[i - 1], v[i - 2]] for i in anchors])
        beta = np.linalg.lstsq(x, v[[i + 5 for i in anchors]], rcond=1e-8)[0]
        assert np.isclose(got[t], beta @ [1, v[t - 1], v[t - 2], v[t - 3]], rtol=1e-8)


def test_refits_of_a_long_series_take_microseconds_each():
    v = np.abs(np.cumsum(np.random.default_rng(9).normal(size=300_000))) + 1
    work, began = state.Refit(60, 3, 5), time.process_time()
    _, out = work.step(0, np.array(work.begin()), pd.DataFrame({"value": v}))
    assert len(out) == len(v) - 64 and time.process_time() - began < 9


def test_forecasts_wait_in_the_state_of_one_step():
    """In pieces of any size as in one; a truth that comes too late isn't judged, and what is carried
    doesn't grow."""
    rng = np.random.default_rng(5)
    v, at = rng.random(200) + 1, np.cumsum(rng.integers(1, 9, 200))
    for parts in (1, 7, 200):
        work, rows, k = state.Scores(3, 5, 24), [], 0
        numbers = work.begin()
        for part in np.array_split(np.arange(200), parts):
            numbers, out = work.step(k, np.array(numbers, float), pd.DataFrame({"at": at[part], "value": v[part]}))
            rows += out.to_dict("records")
            k += len(part)
        assert len(numbers) == 7 + 2 * 7
        judged = [i for i in range(7, 200) if at[i] - at[i - 5] <= 24]
        assert 20 < len(judged) < 180 and [r["k"] for r in rows] == [i + 1 for i in judged] and [r["n"] for r in rows] == list(range(1, len(judged) + 1))
        assert np.allclose([r["mae"] for r in rows], np.cumsum([abs(v[i] - np.mean(v[i - 7 : i - 4])) for i in judged]) / np.arange(1, len(judged) + 1))


def test_factors_that_lose_rank_are_told():
    factor = np.linalg.cholesky(np.eye(3))
    x = np.array([0.5, 0.2, 0.1])
    assert state.update(factor, x, 1) and np.allclose(factor @ factor.T, np.eye(3) + np.outer(x, x))
    assert state.update(factor, x, -1) and np.allclose(factor, np.eye(3))
    assert not state.update(factor, np.array([1.0, 0, 0]), -1)


def test_windows_close_behind_the_watermark(spark, events):
    path, _ = events
    got = sorted((r.event_type, str(r.start), r.n, str(r.first_ts)) for r in jobs.tumbling_first(spark, path).collect())
    e = spark.read.parquet(path).groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "12 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"))
    want = sorted((r.event_type, str(r.start), r.n, str(r.first_ts)) for r in e.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "first_ts").collect())
    assert got == want


def test_prepared_data_are_reused(spark, tmp_path):
    calls = []

    def prepare():
        calls.append(1)
        return spark.range(3)

    for params in ({"a": 1, "b": 2}, {"b": 2, "a": 1}, {"a": 2, "b": 2}):
        assert files.prepared(spark, str(tmp_path), params, prepare).count() == 3
    assert len(calls) == 2


class Kept:
    """The engine's state in memory: a value, a list or a map, and timers."""

    def __init__(self):
        self.rows, self.timers = {}, set()

    def state(self, *_):
        k = Kept()
        k.exists = lambda: bool(k.rows)
        k.get = lambda: k.rows[0] if 0 in k.rows else iter(())
        k.update = lambda v: k.rows.update({0: v})
        k.clear = k.rows.clear
        k.getValue, k.updateValue, k.removeKey = k.rows.__getitem__, k.rows.__setitem__, k.rows.pop
        k.appendList = lambda v: k.rows.update({0: [*k.rows.get(0, []), *v]})
        k.put = lambda v: k.rows.update({0: v})
        return k

    getMapState = getValueState = getListState = state

    def listTimers(self):
        return list(self.timers)

    def registerTimer(self, at):
        self.timers.add(at)


def test_waiting_rows_are_handed_on_in_pieces(monkeypatch):
    """However many rows wait, a step gets a bounded part of them, all in order of time and number."""
    for name, size in (("RUN", 200), ("BLOCK", 16), ("PIECE", 50), ("RUNS", 4)):
        monkeypatch.setattr(state.InOrder, name, size, raising=False)
    rng, seen, mark = np.random.default_rng(3), [], [0]

    class Seen(state.Work):
        schema = "event_type string, k long"

        def step(self, k, numbers, rows):
            seen.append(list(zip(rows["at"], rows["event_id"], rows["value"])))
            return numbers, pd.DataFrame({"k": range(k + 1, k + len(rows) + 1)})

    job, times = state.InOrder(Seen()), type("Times", (), {"getCurrentWatermarkInMs": lambda self: mark[0]})()
    job.init(Kept())
    rows = pd.DataFrame({"event_id": rng.permutation(6000), "at": rng.integers(0, 400, 6000) * 1000, "value": rng.random(6000)})
    taken = []
    for i, now in enumerate((-1, 30, 200, 201, 1000)):
        late = rows.iloc[i::5]
        late = late[late["at"] > mark[0] * 1000] if i else late
        taken.append(late)
        list(job.handleInputRows(("a",), (late.iloc[j : j + 70] for j in range(0, len(late), 70)), times))
        mark[0] = now
        out = [k for part in job.handleExpiredTimer(("a",), times, None) for k in part["k"]]
        got = [x for part in seen for x in part]
        assert out == list(range(len(got) - len(out) + 1, len(got) + 1))
        waiting = pd.concat(taken)
        assert got == [tuple(x) for x in waiting[waiting["at"] <= now * 1000].sort_values(["at", "event_id"])[["at", "event_id", "value"]].itertuples(index=False)]
    assert len(got) > 4000 and max(map(len, seen)) < 50 + 16 * 6
