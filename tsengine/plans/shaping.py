"""Queries: features, windows, splits, stitching, physics, scenarios."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.units import DECLINES, decline
from ..operators import features as X
from ..operators import models as ML
from ..operators.blocks import cumulative as cumulate
from ..operators.clean import along
from ..operators.metrics import scores
from ..operators.ranking import quantiles
from .daily import daily_rates
from .registry import ORACLE_SQL, QUERIES, D, normal, normal_sql, query, rounded

_PREV = "CASE WHEN lag(oil) OVER w > 0 THEN lag(oil) OVER w END"
_DECLINE = f"-ln(greatest(oil / greatest(coalesce({_PREV}, avg(oil) OVER (PARTITION BY well ORDER BY t ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 1e-6), 1e-6), 1e-6))"


@query("decline_rate", D + f" SELECT well, t, round({_DECLINE}, 6) + 0.0 AS decline FROM d WINDOW w AS (PARTITION BY well ORDER BY t)")
def decline_rate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.decline_rate(daily_rates(spark, sf), "oil", "decline").select("well", "t", "decline"), "decline")


_FIELD = """, u AS (SELECT well, t, oil * 6.2898 AS oil, downhole * 14.5038 - whp * 14.5038 AS v, choke FROM d),
i AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY well ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS c FROM u),
j AS (SELECT *, last_value(CASE WHEN c IS NOT NULL THEN t END IGNORE NULLS) OVER a AS pt, last_value(c IGNORE NULLS) OVER a AS pv,
             first_value(CASE WHEN c IS NOT NULL THEN t END IGNORE NULLS) OVER b AS nt, first_value(c IGNORE NULLS) OVER b AS nv
      FROM i WINDOW a AS (PARTITION BY well ORDER BY t ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY well ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
k AS (SELECT *, coalesce(c, CASE WHEN pt IS NOT NULL AND nt IS NOT NULL THEN pv + (nv - pv) * (t - pt) / (nt - pt) END, pv) AS x FROM j),
l AS (SELECT *, CASE WHEN x = 0 THEN 1e-6 ELSE x END AS dp FROM k)
SELECT well, t, round(dp, 4) AS dp, round(oil / dp, 4) + 0.0 AS pi, oil / nullif(choke, 0) AS ce, round(""" + _DECLINE + ", 6) + 0.0 AS decline FROM l WINDOW w AS (PARTITION BY well ORDER BY t)"


@query("engineer_features", D + _FIELD)
def engineer_features(spark, sf):
    f = X.field_features(daily_rates(spark, sf)).select("well", "t", "dp", "pi", "ce", "decline")
    return rounded(rounded(f, "decline"), "dp", "pi", digits=4)


@query("engineer_features_sim", D + 
    f", w0 AS (SELECT well, t, oil, gas, 63000 * 0.145037738 - downhole * 0.145037738 AS dp FROM d) SELECT well, t, "
    f"round(log_gas, 6) AS log_gas, round(dp, 4) AS dp, round(oil / dp, 6) AS pi, round(decline, 6) + 0.0 AS decline "
    f"FROM (SELECT *, ln(1 + gas) AS log_gas, {_DECLINE} AS decline FROM w0 WINDOW w AS (PARTITION BY well ORDER BY "
    f"t)) WHERE t > 1")
def engineer_features_sim(spark, sf):
    f = X.simulated_features(daily_rates(spark, sf)).select("well", "t", "log_gas", "dp", "pi", "decline")
    return rounded(rounded(f, "log_gas", "pi", "decline"), "dp", digits=4)


@query("cumulative", D + " SELECT well, t, sum(oil) OVER (PARTITION BY well ORDER BY t ROWS UNBOUNDED PRECEDING) AS total FROM d")
def cumulative(spark, sf):
    return cumulate(daily_rates(spark, sf), "oil", "total").select("well", "t", "total")


@query("lag_features", D + 
    ", l AS (SELECT well, t, oil AS oil_lag0, lag(oil, 1) OVER w AS oil_lag1, lag(oil, 2) OVER w AS oil_lag2, lag(oil, "
    "3) OVER w AS oil_lag3, lead(oil, 5) OVER w AS label FROM d WINDOW w AS (PARTITION BY well ORDER BY t)) SELECT "
    "* FROM l WHERE oil_lag3 IS NOT NULL AND label IS NOT NULL")
def lag_features(spark, sf):
    return X.lag_features(daily_rates(spark, sf), "oil", 4, 5)


_WIN = """, w0 AS (SELECT well, t, gas, list(oil) OVER (PARTITION BY well ORDER BY t ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS lags,
 avg(oil) OVER (PARTITION BY well ORDER BY t ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS m, lead(oil, 56) OVER (PARTITION BY well ORDER BY t) AS label FROM d),
w AS (SELECT * FROM w0 WHERE len(lags) = 7 AND label IS NOT NULL)"""


@query("window_dataset", D + _WIN + " SELECT well, t, gas, lags[1] AS oldest, lags[7] AS newest, list_sum(lags) AS total, round(m, 6) AS window_mean, label FROM w")
def window_dataset(spark, sf):
    w = X.window_rows(daily_rates(spark, sf), "oil", ["gas"], 7, 56)
    return rounded(w.select("well", "t", "gas", F.get("lags", F.lit(0)).alias("oldest"), F.get("lags", F.lit(6)).alias("newest"), F.aggregate("lags", F.lit(0.0), lambda a, x: a + x).alias("total"), "window_mean", "label"), "window_mean")


@query("ratio_normalize", D + _WIN + " SELECT well, t, label / m AS label, lags[7] / m AS newest, round(label / m * m, 4) AS back FROM w")
def ratio_normalize(spark, sf):
    w = X.ratio_normalize(X.window_rows(daily_rates(spark, sf), "oil", ["gas"], 7, 56))
    w = w.select("well", "t", "label", F.get("lags", F.lit(6)).alias("newest"), (F.col("label") * F.col("window_mean")).alias("back"))
    return rounded(w, "back", digits=4)


_SEQ = """, s AS (SELECT well, t - 7 AS window_id, list(oil) OVER (PARTITION BY well ORDER BY t ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS x,
 list(gas) OVER (PARTITION BY well ORDER BY t ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS g,
 list(oil) OVER (PARTITION BY well ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 30 FOLLOWING) AS y FROM d),
q AS (SELECT * FROM s WHERE len(x) = 7 AND len(y) = 30), e AS (SELECT well, window_id, CAST(k AS INTEGER) AS step, y[k] AS y, y[k] * 0.9 + k AS p FROM q, (SELECT unnest(range(1, 31)) AS k))"""


def _windows(spark, sf, stride: int = 1) -> DataFrame:
    return X.seq_windows(daily_rates(spark, sf), ["oil", "gas"], "oil", 7, 30, stride)


def _steps(spark, sf) -> DataFrame:
    """Overlapping windows in long form with a forecast p for each step."""
    long = _windows(spark, sf).select("well", "window_id", F.posexplode("y").alias("step", "y")).withColumn("step", F.col("step") + 1)
    return long.withColumn("p", F.col("y") * 0.9 + F.col("step"))


@query("seq_windows", D + _SEQ + " SELECT well, window_id, x[1] AS x_first, x[7] AS x_last, g[7] AS gas_last, y[1] AS y_first, y[30] AS y_last FROM q")
def seq_windows(spark, sf):
    at = lambda c, i: F.get(c, F.lit(i))
    return _windows(spark, sf).select("well", "window_id", at(at("x", 0), 0).alias("x_first"), at(at("x", 6), 0).alias("x_last"), at(at("x", 6), 1).alias("gas_last"), at("y", 0).alias("y_first"), at("y", 29).alias("y_last"))


@query("window_context", D + _SEQ + 
    " SELECT well, window_id, round(list_avg(x), 6) AS mean_oil, x[7] AS last_oil, round(list_avg(g), 4) AS mean_gas, "
    "len(x) + len(g) AS flat FROM q")
def window_context(spark, sf):
    w = _windows(spark, sf)
    mean = lambda i: F.aggregate("x", F.lit(0.0), lambda a, r: a + F.get(r, F.lit(i))) / F.size("x")
    w = w.select("well", "window_id", mean(0).alias("mean_oil"), F.get(F.element_at("x", -1), F.lit(0)).alias("last_oil"), mean(1).alias("mean_gas"), F.size(F.flatten("x")).cast("long").alias("flat"))
    return rounded(rounded(w, "mean_oil"), "mean_gas", digits=4)


@query("reconstruct_series", D + _SEQ + " SELECT well, window_id + step AS t, y AS value FROM e WHERE window_id = 0 OR step = 30")
def reconstruct_series(spark, sf):
    return X.reconstruct(_steps(spark, sf), 30)


@query("aggregate_predictions", D + _SEQ + 
    " SELECT well, t, round(value, 6) AS value FROM (SELECT well, window_id + step AS t, p AS value FROM e WHERE window_id "
    "= 0 UNION ALL SELECT well, window_id + 30, avg(p) FROM e WHERE window_id > 0 AND step > 23 GROUP BY well, window_id)")
def aggregate_predictions(spark, sf):
    return rounded(X.reconstruct(_steps(spark, sf), 30, "p", "mean", 7), "value")


@query("stitch_forecasts", D + _SEQ + " SELECT well, window_id + step AS t, round(p, 6) AS value FROM e WHERE window_id % 10 = 0 AND (window_id = 0 OR step > 20)")
def stitch_forecasts(spark, sf):
    return rounded(X.stitch(_steps(spark, sf), 30, 10, "p"), "value")


_SCORE = "round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 6) AS r2, round(100 * avg(CASE WHEN abs(y) + abs(p) = 0 THEN 0 ELSE 2 * abs(y - p) / (abs(y) + abs(p)) END), 6) AS smape, round(avg(abs(y - p)), 6) AS mae"


@query("stitched_eval", D + _SEQ + 
    ", m AS (SELECT well, window_id, CAST(k AS INTEGER) AS step, y[k] AS y, x[7] AS \"last\", list_avg(x) AS mean FROM q, (SELECT unnest(range(1, 31)) AS k)), "
    "c AS (SELECT * FROM m WHERE window_id % 10 = 0 AND (window_id = 0 OR step > 20)), "
    "l AS (SELECT well, 'last' AS model, y, \"last\" AS p FROM c UNION ALL SELECT well, 'mean', y, mean FROM c) "
    "SELECT well, model, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 6) AS r2, round(100 * avg(CASE WHEN abs(y) + abs(p) = 0 THEN 0 ELSE 2 * abs(y - p) / (abs(y) + abs(p)) END), 6) AS smape, "
    "round(avg(abs(y - p)), 6) AS mae, count(*) AS n FROM l GROUP BY well, model")
def stitched_eval(spark, sf, stride: int = 10):
    """Forecasts of every `stride`-th window, stitched into one curve of each well and model (the
    first whole, then the last steps of each), and scored as that curve."""
    w = _windows(spark, sf).select("well", "window_id", F.transform("x", lambda r: F.get(r, F.lit(0))).alias("x"), "y")
    mean = F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / F.size("x")
    models = F.inline(F.array(*[F.struct(F.lit(n).alias("model"), p.alias("p")) for n, p in (("last", F.element_at("x", -1)), ("mean", mean))]))
    steps = w.select("well", "window_id", "y", models).select("well", "window_id", "model", "p", F.posexplode("y").alias("step", "y"))
    steps = steps.withColumns({"step": F.col("step") + 1, "value": F.struct("model", "y", "p")})
    curve = X.stitch(steps, 30, stride, "value").select("well", "value.*")
    return rounded(scores(curve, ["well", "model"], "y", "p").drop("mse"), "r2", "smape", "mae")


@query("seq_eval", D + _SEQ + 
    f", a AS (SELECT well, window_id + step AS t, y FROM e WHERE window_id = 0 OR step = 30), b AS (SELECT well, window_id "
    f"+ step AS t, p FROM e WHERE window_id = 0 UNION ALL SELECT well, window_id + 30, avg(p) FROM e WHERE window_id "
    f"> 0 AND step > 23 GROUP BY well, window_id) SELECT well, {_SCORE} FROM a JOIN b USING (well, t) GROUP BY well")
def seq_eval(spark, sf):
    steps = _steps(spark, sf)
    truth = X.reconstruct(steps, 30).withColumnRenamed("value", "truth")
    pred = X.reconstruct(steps, 30, "p", "mean", 7).withColumnRenamed("value", "pred")
    return rounded(scores(truth.join(pred, ["well", "t"]), ["well"]).select("well", "r2", "smape", "mae"), "r2", "smape", "mae")


@query("slice_metrics", D + _SEQ + 
    f", c AS (SELECT well, max(window_id) + 1 AS n FROM q GROUP BY well) SELECT well, pct, {_SCORE} FROM e JOIN c USING "
    f"(well), (SELECT unnest([25, 50, 100]) AS pct) WHERE window_id < ceil(n * pct / 100.0) GROUP BY well, pct")
def slice_metrics(spark, sf):
    s = _steps(spark, sf)
    n = F.max("window_id").over(Window.partitionBy("well")) + 1
    s = s.withColumn("n", n).withColumn("pct", F.explode(F.array(F.lit(25), F.lit(50), F.lit(100)))).filter(F.col("window_id") < F.ceil(F.col("n") * F.col("pct") / 100.0))
    return rounded(scores(s, ["well", "pct"], "y", "p").select("well", "pct", "r2", "smape", "mae"), "r2", "smape", "mae")


_N = ", n AS (SELECT *, count(*) OVER (PARTITION BY well) AS n FROM d)"


@query("chrono_split", D + _N + " SELECT well, t, CASE WHEN t > n - floor(n * 0.2) THEN 'test' ELSE 'train' END AS side FROM n")
def chrono_split(spark, sf):
    return X.chrono_split(daily_rates(spark, sf), 0.2).select("well", "t", "side")


@query("three_way_split", D + _N + 
    " SELECT well, t, CASE WHEN t <= n - floor(n * 0.4) THEN 'train' WHEN t - (n - floor(n * 0.4)) <= floor(floor(n "
    "* 0.4) * 0.5) THEN 'val' ELSE 'test' END AS side FROM n")
def three_way_split(spark, sf):
    return X.three_way_split(daily_rates(spark, sf), 0.4, 0.5).select("well", "t", "side")


@query("ratio_split", D + _N + " SELECT well, count(*) FILTER (WHERE t <= ceil(n * 0.6)) AS head, count(*) FILTER (WHERE t > ceil(n * 0.6)) AS tail FROM n GROUP BY well")
def ratio_split(spark, sf):
    n = F.count(F.lit(1)).over(Window.partitionBy("well"))
    d = daily_rates(spark, sf).withColumn("left", F.col("t") <= F.ceil(n * 0.6))
    return d.groupBy("well").agg(F.count_if("left").alias("head"), F.count_if(~F.col("left")).alias("tail"))


@query("block_validation_split", D + 
    ", b AS (SELECT well, t, t % 3 AS block FROM d), k AS (SELECT *, row_number() OVER (PARTITION BY well, block ORDER "
    "BY t) AS rn, count(*) OVER (PARTITION BY well, block) AS n FROM b) SELECT well, block, t FROM k WHERE rn > n - "
    "floor(n * 0.1)")
def block_validation_split(spark, sf):
    w = Window.partitionBy("well", "block")
    b = daily_rates(spark, sf).withColumn("block", F.col("t") % 3)
    b = b.withColumns({"rn": F.row_number().over(w.orderBy("t")), "n": F.count(F.lit(1)).over(w)})
    return b.filter(F.col("rn") > F.col("n") - F.floor(F.col("n") * 0.1)).select("well", "block", "t")


@query(
    "last_k_train",
    D
    + _N
    + """ SELECT well, t FROM (SELECT well, t, row_number() OVER (PARTITION BY well ORDER BY t DESC) AS k FROM n
 WHERE t <= n - floor(n * 0.2)) WHERE k <= 50""",
)
def last_k_train(spark, sf):
    """The last 50 training rows of each well."""
    k = F.row_number().over(Window.partitionBy("well").orderBy(F.desc("t")))
    train = X.chrono_split(daily_rates(spark, sf), 0.2).filter("side = 'train'")
    return train.select("well", "t", k.alias("k")).filter("k <= 50").select("well", "t")


@query("feature_branches", D + 
    " SELECT well, t, branch, round(v, 4) AS v FROM (SELECT well, t, 'gas-water-downhole' AS branch, gas + water + "
    "downhole AS v FROM d UNION ALL SELECT well, t, 'gas-water-choke', gas + water + choke FROM d UNION ALL SELECT "
    "well, t, 'gas-downhole-choke', gas + downhole + choke FROM d UNION ALL SELECT well, t, 'water-downhole-choke', "
    "water + downhole + choke FROM d)")
def feature_branches(spark, sf):
    from itertools import combinations

    branches = [F.struct(F.lit("-".join(c)).alias("branch"), sum((F.col(x) for x in c[1:]), F.col(c[0])).alias("v")) for c in combinations(["gas", "water", "downhole", "choke"], 3)]
    return rounded(daily_rates(spark, sf).select("well", "t", F.inline(F.array(*branches))), "v", digits=4)


@query("cumulative_eval", D + _N + 
    " SELECT well, t, (SELECT sum(b.oil) FROM n b WHERE b.well = n.well AND b.t <= b.n - floor(b.n * 0.2)) + sum(oil) "
    "OVER (PARTITION BY well ORDER BY t ROWS UNBOUNDED PRECEDING) AS total FROM n WHERE t > n - floor(n * 0.2)")
def cumulative_eval(spark, sf):
    d = X.chrono_split(daily_rates(spark, sf), 0.2)
    before = d.filter("side = 'train'").groupBy("well").agg(F.sum("oil").alias("before"))
    test = cumulate(d.filter("side = 'test'"), "oil", "total").select("well", "t", "total")
    return test.join(before, "well").select("well", "t", (F.col("before") + F.col("total")).alias("total"))


# Physics: the curve from each well's last row, 30 steps ahead.
_LAST = ", l AS (SELECT well, max_by(oil, t) / 100 AS pi, max_by(downhole, t) AS pwf, 1.1 * avg(downhole) AS p FROM d GROUP BY well), s AS (SELECT *, CAST(tau AS INTEGER) AS tau_ FROM l, (SELECT unnest(range(1, 31)) AS tau))"
_CURVES = {
    "exponential": "abs(pi * (p * exp(-0.01 * tau) - pwf))",
    "arps": "abs(pi * (p / power(1 + 0.5 * 0.01 * tau, 2.0) - pwf))",
    "static": "abs(pi * (p - pwf))",
    "diffusivity": "abs(pi * (p - pwf) * (1 - exp(-0.1 * tau)))",
}
_CURVES["combined"] = f"({_CURVES['exponential']} + {_CURVES['arps']}) / 2"
_CURVES["pressure_ensemble"] = f"({_CURVES['exponential']} + {_CURVES['static']}) / 2"
_CURVES["weighted"] = f"0.5 * ({_CURVES['pressure_ensemble']}) + 0.5 * {_CURVES['exponential']}"


def _last_rows(spark, sf) -> DataFrame:
    last = daily_rates(spark, sf).groupBy("well").agg((F.max_by("oil", "t") / 100).alias("pi"), F.max_by("downhole", "t").alias("pwf"), (1.1 * F.avg("downhole")).alias("p"))
    return last.withColumn("tau", F.explode(F.sequence(F.lit(1), F.lit(30))))


def _curve(name: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        q = decline(name, F.col("pi"), F.col("pwf"), F.col("p"), F.col("tau"))
        return rounded(_last_rows(spark, sf).select("well", "tau", q.alias("q")), "q", digits=4)

    return run


for _name in DECLINES:
    QUERIES[f"decline_{_name}"] = _curve(_name)
    ORACLE_SQL[f"decline_{_name}"] = D + _LAST + f" SELECT well, tau_ AS tau, round({_CURVES[_name]}, 4) AS q FROM s"


_GRID = ", g AS (SELECT pf, dd, bb FROM (SELECT unnest([1.05, 1.1, 1.3]) AS pf), (SELECT unnest([0.001, 0.01, 0.1]) AS dd), (SELECT unnest([0.25, 0.5, 1.0]) AS bb)), h AS (SELECT well, t, oil, downhole, oil / 100 AS pi FROM d), m AS (SELECT well, avg(downhole) AS p FROM h GROUP BY well)"


@query("decline_fit_grid", D + _GRID + 
    ", x AS (SELECT well, pf, dd, bb, sum(power(oil - abs(pi * (p * pf / power(1 + bb * dd * t, 1 / bb) - downhole)), "
    "2)) AS sse FROM h JOIN m USING (well), g GROUP BY ALL) SELECT well, arg_min(pf, sse) AS p_factor, arg_min(dd, "
    "sse) AS d, arg_min(bb, sse) AS b, round(min(sse), 2) AS sse FROM x GROUP BY well")
def decline_fit_grid(spark, sf):
    """The best (P, D, b) of a fixed grid for each well."""
    h = daily_rates(spark, sf).withColumn("p", F.avg("downhole").over(Window.partitionBy("well")))
    for c, values in (("pf", [1.05, 1.1, 1.3]), ("d", [0.001, 0.01, 0.1]), ("b", [0.25, 0.5, 1.0])):
        h = h.withColumn(c, F.explode(F.array(*map(F.lit, values))))
    q = F.abs(F.col("oil") / 100 * (F.col("p") * F.col("pf") / F.pow(1 + F.col("b") * F.col("d") * F.col("t"), 1 / F.col("b")) - F.col("downhole")))
    sse = h.groupBy("well", "pf", "d", "b").agg(F.sum(F.pow(F.col("oil") - q, 2)).alias("sse"))
    best = sse.groupBy("well").agg(F.min_by("pf", "sse").alias("p_factor"), F.min_by("d", "sse").alias("d"), F.min_by("b", "sse").alias("b"), F.min("sse").alias("sse"))
    return rounded(best, "sse", digits=2)


@query("blend_forecast", D + _LAST + 
    f" SELECT well, tau_ AS tau, round((0.8 / (1 + exp(-(tau - 15) / 10.0)) + 0.2) * {_CURVES['exponential']} + (1 - "
    f"(0.8 / (1 + exp(-(tau - 15) / 10.0)) + 0.2)) * pwf, 4) AS q FROM s")
def blend_forecast(spark, sf):
    alpha = 0.8 / (1 + F.exp(-(F.col("tau") - 15) / 10.0)) + 0.2
    q = decline("exponential", F.col("pi"), F.col("pwf"), F.col("p"), F.col("tau"))
    return rounded(_last_rows(spark, sf).select("well", "tau", (alpha * q + (1 - alpha) * F.col("pwf")).alias("q")), "q", digits=4)


_BLEND = ", b AS (SELECT well, t, oil, avg(oil) OVER (PARTITION BY well ORDER BY t ROWS 6 PRECEDING) AS m FROM d), g AS (SELECT b.well, b.t, step, c.oil AS y, b.oil * exp(-0.01 * step) AS q, b.m AS r FROM b, (SELECT unnest(range(1, 57)) AS step) s JOIN d c ON c.well = b.well AND c.t = b.t + s.step WHERE b.t >= 7)"


@query("fitted_blend", D + _BLEND + 
    ", a AS (SELECT step, least(greatest(sum((q - r) * (y - r)) / sum((q - r) * (q - r)), 0.2), 1.0) AS alpha FROM g GROUP BY step) "
    "SELECT step, round(any_value(alpha), 6) AS alpha, round(avg(abs(y - alpha * q - (1 - alpha) * r)), 5) AS mae, count(*) AS n FROM g JOIN a USING (step) GROUP BY step")
def fitted_blend(spark, sf, horizon: int = 56):
    """A decline curve blended with the mean of the last rows, by a fitted weight for each step."""
    w = along()
    ahead = F.array(*[F.struct(F.lit(s).cast("long").alias("step"), F.lead("oil", s).over(w).alias("y")) for s in range(1, horizon + 1)])
    g = daily_rates(spark, sf).select("well", "t", F.col("oil").alias("o"), F.avg("oil").over(w.rowsBetween(-6, 0)).alias("r"), ahead.alias("e")).filter("t >= 7")
    g = g.select("o", "r", F.inline("e")).filter("y is not null").withColumn("q", F.col("o") * F.exp(-0.01 * F.col("step")))
    weights = ML.blend_weights(g, ["step"], "q", "r", "y")
    p = F.col("alpha") * F.col("q") + (1 - F.col("alpha")) * F.col("r")
    out = g.join(F.broadcast(weights), "step").groupBy("step").agg(F.first("alpha").alias("alpha"), F.avg(F.abs(F.col("y") - p)).alias("mae"), F.count(F.lit(1)).alias("n"))  # a row for each step
    return rounded(rounded(out, "alpha"), "mae", digits=5)


# Ensembles: member m forecasts the value of 56 + m steps ago.
_F = ", f AS (SELECT well, t, m, oil AS y, lag(oil, CAST(56 + m AS INTEGER)) OVER (PARTITION BY well, m ORDER BY t) AS p FROM d, (SELECT unnest(range(0, 5)) AS m)), f1 AS (SELECT * FROM f WHERE t > 60)"


def members(spark, sf) -> DataFrame:
    each = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lag("oil", 56 + m).over(along()).alias("p")) for m in range(5)])
    return daily_rates(spark, sf).select("well", "t", F.col("oil").alias("y"), each.alias("e")).filter("t > 60").select("well", "t", "y", F.inline("e"))


@query("ensemble_mean", D + _F + " SELECT well, t, round(avg(p), 6) AS mean, round(sum(p * (m + 1)) / sum(m + 1), 6) AS weighted FROM f1 GROUP BY well, t")
def ensemble_mean(spark, sf):
    out = members(spark, sf).groupBy("well", "t").agg(F.avg("p").alias("mean"), (F.sum(F.col("p") * (F.col("m") + 1)) / F.sum(F.col("m") + 1)).alias("weighted"))
    return rounded(out, "mean", "weighted")


@query("ensemble_sigma", D + _F + " SELECT well, t, round(sqrt(avg((p * 0.1) * (p * 0.1)) + var_pop(p)), 4) AS sigma FROM f1 GROUP BY well, t")
def ensemble_sigma(spark, sf):
    s = F.col("p") * 0.1
    return rounded(members(spark, sf).groupBy("well", "t").agg(F.sqrt(F.avg(s * s) + F.var_pop("p")).alias("sigma")), "sigma", digits=4)


@query("scenario_empirical", D + _F + " SELECT well, t, round(quantile_cont(p, 0.05), 4) AS p5, round(quantile_cont(p, 0.95), 4) AS p95 FROM f1 GROUP BY well, t")
def scenario_empirical(spark, sf):
    q = lambda x: F.percentile("p", F.lit(x))
    return rounded(members(spark, sf).groupBy("well", "t").agg(q(0.05).alias("p5"), q(0.95).alias("p95")), "p5", "p95", digits=4)


def z_score(p: float) -> float:
    if not 0 < p < 1:
        raise ValueError("p must lie between 0 and 1")
    return NormalDist().inv_cdf(p)


_MS = ", ms AS (SELECT well, t, any_value(y) AS y, avg(p) AS mu, stddev_samp(p) AS sigma FROM f1 GROUP BY well, t)"


def _mu_sigma(spark, sf) -> DataFrame:
    return members(spark, sf).groupBy("well", "t").agg(F.first("y").alias("y"), F.avg("p").alias("mu"), F.stddev_samp("p").alias("sigma"))


@query("scenario_curve", D + _F + _MS + 
    f" SELECT well, t, round(mu + {z_score(0.1)!r} * sigma, 4) AS p10, round(mu, 4) AS p50, round(mu + {z_score(0.9)!r} "
    f"* sigma, 4) AS p90 FROM ms")
def scenario_curve(spark, sf):
    m = _mu_sigma(spark, sf)
    out = m.select("well", "t", (F.col("mu") + z_score(0.1) * F.col("sigma")).alias("p10"), F.col("mu").alias("p50"), (F.col("mu") + z_score(0.9) * F.col("sigma")).alias("p90"))
    return rounded(out, "p10", "p50", "p90", digits=4)


@query("cumulative_envelope", D + _F + _MS + 
    f", c AS (SELECT well, t, sum(mu) OVER w AS mid, sum(mu - {z_score(0.9)!r} * sigma) OVER w AS lo, sum(mu + {z_score(0.9)!r} "
    f"* sigma) OVER w AS hi, first_value(y) OVER w - first_value(mu) OVER w AS shift FROM ms WINDOW w AS (PARTITION "
    f"BY well ORDER BY t ROWS UNBOUNDED PRECEDING)) SELECT well, t, round(lo + shift, 2) AS lo, round(mid + shift, 2) "
    f"AS mid, round(hi + shift, 2) AS hi FROM c")
def cumulative_envelope(spark, sf):
    w = along().rowsBetween(Window.unboundedPreceding, 0)
    z = z_score(0.9)
    curve = {"lo": F.col("mu") - z * F.col("sigma"), "mid": F.col("mu"), "hi": F.col("mu") + z * F.col("sigma")}
    shift = F.first("y").over(w) - F.first("mu").over(w)
    return rounded(_mu_sigma(spark, sf).select("well", "t", *[(F.sum(c).over(w) + shift).alias(k) for k, c in curve.items()]), "lo", "mid", "hi", digits=2)


_BAND = {"P10": (0.1, 0.1), "P50": (0.5, 0.5), "P90": (0.9, 0.9), "BAND": (0.1, 0.9)}
_BAND_SQL = ", ".join(f"('{k}', {z_score(a)!r}, {z_score(b)!r})" for k, (a, b) in _BAND.items())


@query("scenario_select", D + _F + _MS + 
    f" SELECT well, t, CASE WHEN t % 4 = 0 THEN 'P50' ELSE kind END AS shown, kind, round(CASE WHEN t % 4 = 0 THEN mu ELSE mu + zlo * sigma END, 4) AS lo, "
    f"round(CASE WHEN t % 4 = 0 THEN mu ELSE mu + zhi * sigma END, 4) AS hi FROM ms, (VALUES {_BAND_SQL}) k(kind, zlo, zhi)")
def scenario_select(spark, sf):
    """P10, P50, P90 or the band between two shares; where sigma is missing all are P50."""
    m = _mu_sigma(spark, sf).withColumn("sigma", F.when(F.col("t") % 4 != 0, F.col("sigma")))
    kinds = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(z_score(a)).alias("zlo"), F.lit(z_score(b)).alias("zhi")) for k, (a, b) in _BAND.items()]))
    m = m.select("well", "t", "mu", "sigma", kinds)
    edge = lambda z: F.coalesce(F.col("mu") + F.col(z) * F.col("sigma"), F.col("mu"))
    shown = F.when(F.col("sigma").isNull(), "P50").otherwise(F.col("kind"))
    return rounded(m.select("well", "t", shown.alias("shown"), "kind", edge("zlo").alias("lo"), edge("zhi").alias("hi")), "lo", "hi", digits=4)


@query("mc_sample", D + _F + _MS + f" SELECT well, t, CAST(n AS INTEGER) AS draw, round(mu + sigma * {normal_sql('well', 't', 'n')}, 4) AS value FROM ms, (SELECT unnest(range(1, 11)) AS n)")
def mc_sample(spark, sf):
    """Ten seeded draws of each row's distribution."""
    m = _mu_sigma(spark, sf).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(10))))
    noise = normal("well", F.col("t").cast("string"), F.col("draw").cast("string"))
    return rounded(m.select("well", "t", "draw", (F.col("mu") + noise * F.col("sigma")).alias("value")), "value", digits=4)


@query("align_forecast", D + _F + " SELECT well, t, m, y, p FROM f WHERE p IS NOT NULL AND t <= (SELECT min(c) FROM (SELECT count(*) AS c FROM d GROUP BY well))")
def align_forecast(spark, sf):
    """Members joined with the truth where both exist, up to the shortest series."""
    d = daily_rates(spark, sf)
    each = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lag("oil", 56 + m).over(along()).alias("p")) for m in range(5)])
    forecast = d.select("well", "t", each.alias("e")).select("well", "t", F.inline("e")).filter("p is not null")
    shortest = d.groupBy("well").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("shortest"))
    return forecast.join(d.select("well", "t", F.col("oil").alias("y")), ["well", "t"]).crossJoin(F.broadcast(shortest)).filter("t <= shortest").select("well", "t", "m", "y", "p")


@query("metrics_by_well", D + _F + f" SELECT well, m, {_SCORE}, round(avg((y - p) * (y - p)), 4) AS mse, count(*) AS n FROM f1 GROUP BY well, m")
def metrics_by_well(spark, sf):
    return rounded(rounded(scores(members(spark, sf), ["well", "m"], "y", "p"), "r2", "smape", "mae"), "mse", digits=4)


@query("select_best_members", D + _F + 
    ", l AS (SELECT well, t // 250 AS cycle, m, avg(abs(y - p)) AS loss FROM f1 GROUP BY ALL), c AS (SELECT * FROM l QUALIFY row_number() OVER "
    "(PARTITION BY well, cycle ORDER BY loss, m) = 1), k AS (SELECT *, row_number() OVER (PARTITION BY well ORDER BY loss, cycle) AS place FROM c) "
    "SELECT well, cycle, m, round(loss, 6) AS loss, place FROM k WHERE place <= 3")
def select_best_members(spark, sf, cycle: int = 250, best: int = 3):
    """The best member of each cycle, and of these the best few of each well."""
    loss = members(spark, sf).groupBy("well", F.floor(F.col("t") / cycle).alias("cycle"), "m").agg(F.avg(F.abs(F.col("y") - F.col("p"))).alias("loss"))
    first = loss.withColumn("_k", F.row_number().over(Window.partitionBy("well", "cycle").orderBy("loss", "m"))).filter("_k = 1").drop("_k")
    k = first.withColumn("place", F.row_number().over(Window.partitionBy("well").orderBy("loss", "cycle")).cast("long")).filter(F.col("place") <= best)
    return rounded(k, "loss")


@query("contribution_share", D + _F + 
    ", c AS (SELECT well, abs(0.6 * p) AS a, abs(0.4 * (y - p)) AS b FROM f1) SELECT well, round(avg(a / (a + b + 1e-8)), "
    "6) AS mean_share, round(sum(a) / (sum(a) + sum(b)), 6) AS global_share FROM c GROUP BY well")
def contribution_share(spark, sf):
    a, b = F.abs(0.6 * F.col("p")), F.abs(0.4 * (F.col("y") - F.col("p")))
    out = members(spark, sf).groupBy("well").agg(F.avg(a / (a + b + 1e-8)).alias("mean_share"), (F.sum(a) / (F.sum(a) + F.sum(b))).alias("global_share"))
    return rounded(out, "mean_share", "global_share")


@query("standard_scale", D + 
    " SELECT well, t, round((oil - avg(oil) OVER w) / CASE WHEN stddev_pop(oil) OVER w = 0 THEN 1 ELSE stddev_pop(oil) "
    "OVER w END, 6) + 0.0 AS scaled, round((oil - avg(oil) OVER w) / greatest(stddev_pop(oil) OVER w, 1e-3), 6) + 0.0 "
    "AS guarded FROM d WINDOW w AS (PARTITION BY well)")
def standard_scale(spark, sf):
    d = daily_rates(spark, sf)
    stats = d.groupBy("well").agg(F.avg("oil").alias("center"), F.stddev_pop("oil").alias("scale"))
    x = F.col("oil") - F.col("center")
    out = d.join(stats, "well").select("well", "t", (x / F.when(F.col("scale") == 0, 1.0).otherwise(F.col("scale"))).alias("scaled"), (x / F.greatest("scale", F.lit(1e-3))).alias("guarded"))
    return rounded(out, "scaled", "guarded")


@query("inverse_scale", D + 
    ", s AS (SELECT well, median(oil) AS c, quantile_cont(oil, 0.75) - quantile_cont(oil, 0.25) AS k FROM d GROUP BY "
    "well) SELECT well, t, round((oil - c) / k, 6) + 0.0 AS scaled, round((oil - c) / k * k + c, 4) AS back FROM d "
    "JOIN s USING (well)")
def inverse_scale(spark, sf):
    d = daily_rates(spark, sf)
    stats = quantiles(d, ["well"], "oil", {"q1": 0.25, "c": 0.5, "q3": 0.75}).select("well", "c", (F.col("q3") - F.col("q1")).alias("k"))
    x = (F.col("oil") - F.col("c")) / F.col("k")
    return rounded(rounded(d.join(stats, "well").select("well", "t", x.alias("scaled"), (x * F.col("k") + F.col("c")).alias("back")), "scaled"), "back", digits=4)
