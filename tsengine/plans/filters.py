"""Queries: signal filters, augmentation, models, files, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import models as ML
from ..operators import signals as S
from ..operators.clean import along
from ..operators.metrics import scores
from ..sources import files
from ..streaming import jobs
from .daily import daily_rates, read, runs
from .registry import D, R, draw, draw_sql, mean, mean_sql, normal, normal_sql, query, rounded
from .shaping import _SEQ, _steps, _windows

_K = ", z AS (SELECT well, t, oil, greatest(oil + 1e-6, 1e-6) AS z FROM d), k(well, t, x, p) AS (SELECT well, t, z::DOUBLE, 1 - 1 / (1 + 1e-3)::DOUBLE FROM z WHERE t = 1 UNION ALL SELECT z.well, z.t, k.x + (k.p + 1e-4) / (k.p + 1e-4 + 1e-3) * (z.z - k.x), (1 - (k.p + 1e-4) / (k.p + 1e-4 + 1e-3)) * (k.p + 1e-4) FROM k JOIN z ON z.well = k.well AND z.t = k.t + 1)"


@query("kalman_filter", D + _K + " SELECT well, t, round(x, 4) AS filtered FROM k")
def kalman_filter(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.filter_series(daily_rates(spark, sf), "oil", "kalman").select("well", "t", "filtered"), "filtered", digits=4)


_SMOOTHED = """,
n AS (SELECT well, max(t) AS n FROM d GROUP BY well),
f(well, t, x, p) AS (
  SELECT well, t, CAST(oil AS DOUBLE), CAST(1 - 1 / (1 + 1e-3) AS DOUBLE) FROM d WHERE t = 1
  UNION ALL
  SELECT d.well, d.t, f.x + (f.p + 1e-5) / (f.p + 1e-5 + 1e-3) * (d.oil - f.x), (1 - (f.p + 1e-5) / (f.p + 1e-5 + 1e-3)) * (f.p + 1e-5)
  FROM f JOIN d ON d.well = f.well AND d.t = f.t + 1),
b(well, t, x) AS (
  SELECT f.well, f.t, f.x FROM f JOIN n ON n.well = f.well AND n.n = f.t
  UNION ALL
  SELECT f.well, f.t, f.x + f.p / (f.p + 1e-5) * (b.x - f.x) FROM b JOIN f ON f.well = b.well AND f.t = b.t - 1)"""


@query("kalman_smooth", D + _SMOOTHED + " SELECT well, t, round(x, 4) AS filtered FROM b")
def kalman_smooth(spark, sf):
    return rounded(S.filter_series(daily_rates(spark, sf), "oil", "kalman_smooth").select("well", "t", "filtered"), "filtered", digits=4)


@query("filtered_vs_raw_metrics", D + _K + _SMOOTHED + 
    ", u(well, t, x) AS (SELECT well, t, oil FROM d WHERE t = 1 UNION ALL SELECT d.well, d.t, u.x + 0.2 * (d.oil - u.x) FROM u JOIN d ON d.well = u.well AND d.t = u.t + 1), "
    "a AS (SELECT 'kalman' AS method, well, t, x FROM k UNION ALL SELECT 'kalman_smooth', well, t, x FROM b UNION ALL SELECT 'exponential', well, t, x FROM u), "
    "y AS (SELECT well, t, oil AS raw, lead(oil) OVER (PARTITION BY well ORDER BY t) AS y FROM d) "
    "SELECT method, well, round(avg(abs(y - raw)), 4) AS mae_raw, round(avg(abs(y - x)), 4) AS mae_filtered FROM a JOIN y USING (well, t) WHERE y IS NOT NULL GROUP BY method, well")
def filtered_vs_raw_metrics(spark, sf):
    """The last value as a forecast, raw and through each filter by its name."""
    d = daily_rates(spark, sf).select("well", "t", "oil", F.lead("oil").over(along()).alias("y"))
    out = None
    for method in ("kalman", "kalman_smooth", "exponential"):
        f = S.filter_columns(d, ["oil"], method).filter("y is not null")
        error = lambda c: F.avg(F.abs(F.col("y") - F.col(c)))
        one = f.groupBy(F.lit(method).alias("method"), "well").agg(error("oil_Original").alias("mae_raw"), error("oil").alias("mae_filtered"))
        out = one if out is None else out.unionByName(one)
    return rounded(out, "mae_raw", "mae_filtered", digits=4)


@query("exp_smooth", D + _SEQ + """, o AS (SELECT well, window_id, y, k FROM q, (SELECT unnest(range(1, 31)) AS k)),
b AS (SELECT well, window_id, k, y[k] AS v, coalesce(list_sum([0.2 * power(0.8, k - 1 - j) * y[j] for j in range(1, k)]), 0) AS base FROM o),
l AS (SELECT well, window_id, sum(power(0.8, k - 1) * (v - base)) / sum(power(0.8, k - 1) * power(0.8, k - 1)) AS s0 FROM b GROUP BY 1, 2)
SELECT well, window_id, round(max(CASE WHEN k = 1 THEN base + s0 END), 4) AS first, round(max(CASE WHEN k = 30 THEN base + s0 * power(0.8, 29) END), 4) AS last FROM b JOIN l USING (well, window_id) GROUP BY 1, 2""")
def exp_smooth(spark, sf):
    w = S.exp_smooth(_windows(spark, sf).select("well", "window_id", "y"), "y")
    return rounded(w.select("well", "window_id", F.get("fitted", F.lit(0)).alias("first"), F.element_at("fitted", -1).alias("last")), "first", "last", digits=4)


_SOFT = "sign({x}) * greatest(abs({x}) - {t}, 0)"
_E = "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x, 0.5 * list_stddev_pop(list_transform(embedding, lambda x: x::DOUBLE)) AS th FROM embeddings)"


def _haar_sql(levels: int, t: str) -> str:
    sql, n = _E, 64
    for i in range(levels):
        src = "x" if i == 0 else f"a{i}"
        prev = "e" if i == 0 else f"h{i}"
        pair = lambda s: f"[({src}[2*i-1] {s} {src}[2*i]) / sqrt(2.0) for i in range(1, {n // 2 + 1})]"
        sql += f", h{i + 1} AS (SELECT *, {pair('+')} AS a{i + 1}, {pair('-')} AS c{i + 1} FROM {prev})"
        n //= 2
    last, out = f"h{levels}", f"a{levels}"
    for i in range(levels, 0, -1):
        d = f"[{_SOFT.format(x='v', t=t)} for v in c{i}]"
        sql += f", s{i} AS (SELECT *, {d} AS d{i} FROM {last}), r{i} AS (SELECT *, flatten([[({out}[i] + d{i}[i]) / sqrt(2.0), ({out}[i] - d{i}[i]) / sqrt(2.0)] for i in range(1, {n + 1})]) AS y{i} FROM s{i})"
        last, out, n = f"r{i}", f"y{i}", n * 2
    return sql + f" SELECT vec_id, round({out}[1], 6) + 0.0 AS first, round({out}[64], 6) + 0.0 AS last, round(list_sum({out}), 5) + 0.0 AS total FROM {last}"


def _vectors(spark, sf) -> DataFrame:
    return read(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))


def _ends(df: DataFrame) -> DataFrame:
    out = df.select("vec_id", F.get("denoised", F.lit(0)).alias("first"), F.element_at("denoised", -1).alias("last"), F.aggregate("denoised", F.lit(0.0), lambda a, v: a + v).alias("total"))
    return rounded(rounded(out, "first", "last"), "total", digits=5)


@query("haar_denoise", _haar_sql(3, "th"))
def haar_denoise(spark, sf):
    return _ends(S.haar_denoise(_vectors(spark, sf), "x"))


@query("haar_single", _haar_sql(1, "0.1"))
def haar_single(spark, sf):
    return _ends(S.haar_denoise(_vectors(spark, sf), "x", 1, F.lit(0.1)))


@query("gaussian_smooth", D + _SEQ + 
    ", g AS (SELECT unnest(range(-2, 3)) AS k), n AS (SELECT k, exp(-0.5 * power(k / 1.2, 2)) / (SELECT sum(exp(-0.5 "
    "* power(k / 1.2, 2))) FROM g) AS w FROM g) SELECT a.well, a.window_id, a.step, round(sum(coalesce(b.y, 0) * w), "
    "4) AS y FROM e a CROSS JOIN n LEFT JOIN e b ON b.well = a.well AND b.window_id = a.window_id AND b.step = a.step "
    "+ k GROUP BY 1, 2, 3")
def gaussian_smooth(spark, sf):
    import math

    raw = [math.exp(-0.5 * (k / 1.2) ** 2) for k in range(-2, 3)]
    w = Window.partitionBy("well", "window_id").orderBy("step")
    total = sum((F.coalesce(F.lead("y", k).over(w) if k > 0 else F.lag("y", -k).over(w), F.lit(0.0)) * (r / sum(raw)) for k, r in zip(range(-2, 3), raw)), F.lit(0.0))
    return rounded(_steps(spark, sf).select("well", "window_id", "step", total.alias("y")), "y", digits=4)


# The amplitude factors of the scaled copies.
SCALES = (1.5, 2.0, 3.0, 5.0, 7.0, 9.0, 11.0, 13.0, 15.0, 17.0, 19.0)
_SCALES = f"(SELECT unnest({[1.0, *SCALES]!r}::DOUBLE[]) AS f)"


@query("augment_scale", D + _SEQ + f" SELECT well, window_id, f AS block, round(x[7] / f, 6) AS x_last, round(y[30] / f, 6) AS y_last FROM q, {_SCALES}")
def augment_scale(spark, sf):
    """The windows, and a copy of each for every factor."""
    w = _windows(spark, sf).withColumn("block", F.explode(F.array(*map(F.lit, (1.0, *SCALES)))))
    return rounded(w.select("well", "window_id", "block", (F.get(F.element_at("x", -1), F.lit(0)) / F.col("block")).alias("x_last"), (F.element_at("y", -1) / F.col("block")).alias("y_last")), "x_last", "y_last")


@query(
    "augment_subsample",
    D
    + _SEQ
    + f""", w AS (SELECT well, window_id, f AS block FROM q, {_SCALES}),
k AS (SELECT *, row_number() OVER (PARTITION BY well, block ORDER BY {draw_sql("7", "well", "window_id", "CAST(block * 2 AS INTEGER)")}, window_id) AS k,
             count(*) OVER (PARTITION BY well, block) AS n FROM w),
c AS (SELECT well, window_id, block FROM k WHERE block = 1 OR k <= floor(n * 0.95)),
ends AS (SELECT well, block, CAST(sum(count(*)) OVER (PARTITION BY well ORDER BY block) AS BIGINT) AS block_end FROM c GROUP BY well, block)
SELECT well, window_id, block, block_end FROM c JOIN ends USING (well, block)""",
)
def augment_subsample(spark, sf):
    """The windows, and of each scaled copy 95 %, chosen by a seeded hash, in order of time; with
    the end of each block among a well's rows."""
    w = _windows(spark, sf).select("well", "window_id", F.explode(F.array(*map(F.lit, (1.0, *SCALES)))).alias("block"))
    p = Window.partitionBy("well", "block")
    order = draw(F.lit("7"), "well", F.col("window_id").cast("string"), (F.col("block") * 2).cast("int").cast("string"))
    w = w.withColumns({"k": F.row_number().over(p.orderBy(order, "window_id")), "n": F.count(F.lit(1)).over(p)})
    kept = w.filter((F.col("block") == 1) | (F.col("k") <= F.floor(F.col("n") * 0.95))).select("well", "window_id", "block")
    ends = kept.groupBy("well", "block").agg(F.count(F.lit(1)).alias("_n"))
    ends = ends.select("well", "block", F.sum("_n").over(Window.partitionBy("well").orderBy("block")).alias("block_end"))
    return kept.join(ends, ["well", "block"]).select("well", "window_id", "block", "block_end")


@query("augment_decline", D + 
    f" SELECT well, t, f, round(oil / f, 6) AS oil, round(downhole / f, 6) AS downhole, round(gas / f, 6) AS gas, "
    f"round(oil / downhole / f, 9) AS pi, choke FROM d, (SELECT unnest({list(SCALES)!r}::DOUBLE[]) AS f)")
def augment_decline(spark, sf):
    """Rate, pressure, gas and productivity of poorer regimes."""
    d = daily_rates(spark, sf).withColumn("pi", F.col("oil") / F.col("downhole")).withColumn("f", F.explode(F.array(*map(F.lit, SCALES))))
    d = d.select("well", "t", "f", *[(F.col(c) / F.col("f")).alias(c) for c in ("oil", "downhole", "gas", "pi")], "choke")
    return rounded(rounded(d, "oil", "downhole", "gas"), "pi", digits=9)


_WARPS = [X.late_decline(7, seed) for seed in range(5)]


@query("augment_warp", D + 
    ", s AS (SELECT well, t - 7 AS window_id, list(oil) OVER a AS x, list(downhole - coalesce(whp, 0)) OVER a AS p, list(oil) OVER b AS y FROM d "
    "WINDOW a AS (PARTITION BY well ORDER BY t ROWS 6 PRECEDING), b AS (PARTITION BY well ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 30 FOLLOWING)), "
    "q AS (SELECT * FROM s WHERE len(x) = 7 AND len(y) = 30), w AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {c}, {a!r}::DOUBLE)" for i, (c, a) in enumerate(_WARPS)) + ") v(copy, cut, alpha)) "
    "SELECT well, window_id, copy, round(x[7] * alpha, 6) AS x_last, round(CASE WHEN cut > 3 THEN x[4] ELSE x[4] * alpha END, 6) AS x_middle, "
    "round(p[7] * alpha, 6) AS drop_last, round(list_sum(y[1:cut]) + alpha * list_sum(y[cut + 1:30]), 4) AS y_total FROM q, w")
def augment_warp(spark, sf):
    """Copies whose rates, pressure drops and labels decline from a drawn place on."""
    d = daily_rates(spark, sf).withColumn("drop", F.col("downhole") - F.coalesce("whp", F.lit(0.0)))
    w = X.seq_windows(d, ["oil", "drop"], "oil", 7, 30)
    copies = F.explode(F.array(*[F.struct(F.lit(i).alias("copy"), F.lit(c).alias("cut"), F.lit(a).alias("alpha")) for i, (c, a) in enumerate(_WARPS)]))
    w = w.withColumn("_w", copies).select("well", "window_id", "_w.copy", *[X.warped(c, F.col("_w.cut"), F.col("_w.alpha"), k).alias(n) for n, c, k in (("x", "x", 2), ("y", "y", 0))])
    at = lambda i, k: F.get(F.get("x", F.lit(i)), F.lit(k))
    out = w.select("well", "window_id", "copy", at(6, 0).alias("x_last"), at(3, 0).alias("x_middle"), at(6, 1).alias("drop_last"), F.aggregate("y", F.lit(0.0), lambda a, v: a + v).alias("y_total"))
    return rounded(rounded(out, "x_last", "x_middle", "drop_last"), "y_total", digits=4)


@query("augment_jitter", D + f", n AS (SELECT *, 10 * {normal_sql('well', 't')} AS noise FROM d) SELECT well, t, round(downhole + noise, 4) AS downhole, round(whp + noise, 4) AS whp FROM n")
def augment_jitter(spark, sf):
    """The same seeded noise on both pressures of a row."""
    d = daily_rates(spark, sf).withColumn("noise", 10 * normal("well", F.col("t").cast("string")))
    return rounded(d.select("well", "t", *[(F.col(c) + F.col("noise")).alias(c) for c in ("downhole", "whp")]), "downhole", "whp", digits=4)


@query(
    "augment_bootstrap",
    D
    + _SEQ
    + f""", n AS (SELECT well, max(window_id) + 1 AS n FROM q GROUP BY well)
SELECT q.well, q.window_id AS draw, CAST({draw_sql("7", "q.well", "q.window_id")} % n AS INTEGER) AS window_id FROM q JOIN n USING (well)""",
)
def augment_bootstrap(spark, sf):
    """Whole windows drawn with replacement."""
    w = _windows(spark, sf).select("well", "window_id")
    n = F.max("window_id").over(Window.partitionBy("well")) + 1
    place = draw(F.lit("7"), "well", F.col("window_id").cast("string"))
    drawn = w.select("well", (place % n).cast("int").alias("window_id"), F.col("window_id").alias("draw"))
    return drawn.join(w, ["well", "window_id"]).select("well", "draw", "window_id")


@query("augment_phys")
def augment_phys(spark, sf):
    """The parts that are switched on, each with its block: scaled, jitter, warp, bootstrap."""
    return X.augment(daily_rates(spark, sf).select("well", "t", "oil", "downhole"), scale=(1.5, 2.0), jitter=5.0, warp=0.8, bootstrap=2, seed=7)


@query(
    "hybrid_validation",
    D
    + f""", n AS (SELECT *, count(*) OVER (PARTITION BY well) AS n FROM d),
s AS (SELECT well, t, CASE WHEN t <= n - floor(n * 0.4) THEN 'train' WHEN t - (n - floor(n * 0.4)) <= floor(floor(n * 0.4) * 0.5) THEN 'val' ELSE 'test' END AS side FROM n)
SELECT well, t, side FROM s WHERE side = 'val' OR side = 'train' AND {draw_sql("well", "t")} % 10 = 0""",
)
def hybrid_validation(spark, sf):
    """A hashed tenth of the training rows joined with the explicit validation rows."""
    d = X.three_way_split(daily_rates(spark, sf), 0.4, 0.5).select("well", "t", "side")
    tenth = draw("well", F.col("t").cast("string")) % 10 == 0
    return d.filter((F.col("side") == "val") | (F.col("side") == "train") & tenth)


_TREND = [f"list_dot_product(y, {w.tolist()!r}::DOUBLE[])" for w in ML.trend_weights(30)]


@query(
    "poly_trend",
    D + _SEQ + " SELECT well, window_id, " + ", ".join(f"round({w}, 8) + 0.0 AS c{i}" for i, w in enumerate(_TREND)) + " FROM q",
)
def poly_trend(spark, sf):
    w = ML.polynomial_trend(_windows(spark, sf).select("well", "window_id", "y"), "y", 30)
    w = w.select("well", "window_id", *[F.get("coef", F.lit(i)).alias(f"c{i}") for i in range(3)])
    return rounded(w, "c0", "c1", "c2", digits=8)


@query("lag_regression")
def lag_regression(spark, sf):
    return ML.lag_regression(daily_rates(spark, sf))


@query("lag_gram", D + 
    ", g AS (SELECT well, oil, lag(oil, 1) OVER w AS x1, lag(oil, 6) OVER w AS x6, lead(oil, 56) OVER w AS y FROM d "
    "WINDOW w AS (PARTITION BY well ORDER BY t)) SELECT well, count(*) AS n, sum(oil * x1) AS g01, sum(oil * y) AS "
    "g0y, sum(x6 * y) AS g6y FROM g WHERE x6 IS NOT NULL AND y IS NOT NULL GROUP BY well")
def lag_gram(spark, sf):
    """Some of the sums that the regression solves."""
    rows, _ = ML._gram(daily_rates(spark, sf), 7, 56)
    product = lambda a, b: F.sum(F.col(a) * F.col(b))
    return rows.na.drop().groupBy("well").agg(F.count(F.lit(1)).alias("n"), product("x1", "x2").alias("g01"), product("x1", "y").alias("g0y"), product("x7", "y").alias("g6y"))


@query(
    "linear_attribution",
    D
    + """,
l AS (SELECT well, t, oil, water, lead(oil, 56) OVER (PARTITION BY well ORDER BY t) AS y FROM d),
c AS (SELECT well, covar_pop(oil, oil) AS s11, covar_pop(oil, water) AS s12, covar_pop(water, water) AS s22,
             covar_pop(oil, y) AS s1, covar_pop(water, y) AS s2 FROM l WHERE y IS NOT NULL GROUP BY well),
b AS (SELECT well, (s22 * s1 - s12 * s2) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2 - s12 * s1) / (s11 * s22 - s12 * s12) AS b2 FROM c)
SELECT l.well, t, round(b1 * (oil - avg(oil) OVER w), 4) + 0.0 AS phi_oil, round(b2 * (water - avg(water) OVER w), 4) + 0.0 AS phi_water
FROM l JOIN b ON l.well = b.well WINDOW w AS (PARTITION BY l.well)""",
)
def linear_attribution(spark, sf):
    """Exact attributions of the linear model that is fitted to each well."""
    phi = ML.linear_attribution(daily_rates(spark, sf), ["oil", "water"], "oil", 56)
    return rounded(phi, "phi_oil", "phi_water", digits=4)


@query("walk_forward_eval")
def walk_forward_eval(spark, sf):
    """Each fold's forecasts by a fitted and two plain models, joined into one series of each well
    and model, and scored."""
    d, past = daily_rates(spark, sf), along().rowsBetween(-6, 0)
    folds = ML.walk_forward(d).join(d.select("well", "t", F.col("oil").alias("last"), F.avg("oil").over(past).alias("mean")), ["well", "t"])
    each = F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("forecast")) for m, c in (("linear", "pred"), ("last", "last"), ("mean", "mean"))]))
    return scores(folds.select("well", "t", "truth", each), ["well", "model"], "truth", "forecast")


@query("gbt_forecast")
def gbt_forecast(spark, sf):
    w = X.ratio_normalize(X.window_rows(daily_rates(spark, sf), "oil", [], 7, 56))
    return scores(ML.gbt_forecast(X.chrono_split(w, 0.2)), ["well"])


@query("choose_k")
def choose_k(spark, sf):
    return ML.choose_k(read(spark, sf, "embeddings"), "embedding", [2, 4, 8])


@query("tabular_prepare", D + 
    ", l AS (SELECT well, t, oil AS x, lag(oil) OVER w AS x1, lead(oil, 5) OVER w AS y FROM d WINDOW w AS (PARTITION "
    "BY well ORDER BY t)), m AS (SELECT *, row_number() OVER (PARTITION BY well ORDER BY t) AS k, count(*) OVER (PARTITION "
    "BY well) AS n FROM l WHERE x1 IS NOT NULL AND y IS NOT NULL), s AS (SELECT well, avg(x) AS c, stddev_pop(x) AS "
    "sd, sum(y) AS before FROM m WHERE k <= n - floor(n * 0.2) GROUP BY well) SELECT m.well, t, round((x - c) / sd, "
    "6) + 0.0 AS scaled, before, k <= n - floor(n * 0.2) AS train FROM m JOIN s ON m.well = s.well")
def tabular_prepare(spark, sf):
    rows = X.chrono_split(X.lag_features(daily_rates(spark, sf), "oil", 2, 5), 0.2)
    stats = rows.filter("side = 'train'").groupBy("well").agg(F.avg("oil_lag0").alias("c"), F.stddev_pop("oil_lag0").alias("sd"), F.sum("label").alias("before"))
    return rounded(rows.join(stats, "well").select("well", "t", ((F.col("oil_lag0") - F.col("c")) / F.col("sd")).alias("scaled"), "before", (F.col("side") == "train").alias("train")), "scaled")


# Files: written below the shared folder, then read by the reader under test.
@query("src_tab", D + " SELECT well AS \"WELL\", t::DOUBLE AS \"DAY\", CASE WHEN t % 50 = 0 THEN NULL ELSE oil END AS \"QOOB\" FROM d")
def src_tab(spark, sf):
    path = files.shared_folder(spark)
    bad = F.when(F.col("t") % 50 == 0, "bad").otherwise(F.col("oil").cast("string"))
    daily_rates(spark, sf).select(F.col("well").alias("WELL"), F.col("t").alias("DAY"), bad.alias("QOOB")).write.option("header", True).option("sep", "\t").csv(path)
    return files.load(spark, "tab", path, columns=["WELL", "DAY", "QOOB"], numeric=["DAY", "QOOB"])


@query("src_decimal_comma", D + " SELECT well, t::DOUBLE AS t, downhole FROM d")
def src_decimal_comma(spark, sf):
    path = files.shared_folder(spark)
    daily_rates(spark, sf).select("well", "t", F.regexp_replace(F.col("downhole").cast("string"), r"\.", ",").alias("downhole")).write.option("header", True).option("sep", ";").csv(path)
    return files.load(spark, "decimal_comma", path, columns=["well", "t", "downhole"], numeric=["t", "downhole"])


@query("src_per_well_files", D + ' SELECT well, t::DOUBLE AS "Day", oil AS "Oil" FROM d')
def src_per_well_files(spark, sf):
    path = files.shared_folder(spark)
    daily_rates(spark, sf).select("well", F.col("t").alias("Day"), F.col("oil").alias("Oil")).write.partitionBy("well").option("header", True).csv(path)
    return files.load(spark, "per_well", path, pattern="well=([^/]+)/", columns=["Day", "Oil"])


@query("src_timestamp", "SELECT ts AS utc_timestamp, value AS wind FROM events")
def src_timestamp(spark, sf):
    path = files.shared_folder(spark)
    read(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("utc_timestamp"), F.col("value").alias("wind")).write.option("header", True).csv(path)
    return files.load(spark, "timestamped", path, time="utc_timestamp", columns=["wind"])


@query("sink_results", R + " SELECT architecture_id, well, smape FROM r")
def sink_results(spark, sf):
    path = files.shared_folder(spark)
    files.save_results(runs(spark, sf).select("architecture_id", "well", "smape"), path, ["architecture_id"])
    return spark.read.parquet(path).select("architecture_id", "well", "smape")


@query("load_experiments", R + 
    f" SELECT architecture_id AS variant, 'smape' AS metric, count(*) AS n, round({mean_sql('smape')}, 6) AS value FROM r GROUP "
    f"BY 1 UNION ALL SELECT architecture_id, 'mae', count(*), round({mean_sql('mae')}, 6) FROM r GROUP BY 1")
def load_experiments(spark, sf):
    """Saved as one folder a variant and metric, and found again by partition discovery."""
    path = files.shared_folder(spark)
    long = runs(spark, sf).select(F.col("architecture_id").alias("variant"), F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("smape", "mae")])))
    files.save_results(long, path, ["variant", "metric"])
    out = spark.read.parquet(path).groupBy("variant", "metric").agg(F.count(F.lit(1)).alias("n"), mean("value").alias("value"))
    return rounded(out, "value")


# Streams: the table is read as a stream of files until it ends; results equal the batch's.
@query("stream_decimation", 
    "SELECT event_type, date_trunc('day', ts) + CASE WHEN hour(ts) >= 12 THEN INTERVAL 12 HOUR ELSE INTERVAL 0 HOUR "
    "END AS start, count(*) AS n, min(ts) AS first_ts FROM events GROUP BY 1, 2")
def stream_decimation(spark, sf):
    return jobs.tumbling_first(spark, f"{sf}/events.parquet")


@query("stream_kalman", 
    "WITH RECURSIVE e AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k, "
    "value + 1e-6 AS z FROM events), k(event_type, k, x, p) AS (SELECT event_type, k, z::DOUBLE, 1 - 1 / (1 + 1e-3)::DOUBLE "
    "FROM e WHERE k = 1 UNION ALL SELECT e.event_type, e.k, k.x + (k.p + 1e-4) / (k.p + 1e-4 + 1e-3) * (greatest(e.z, "
    "1e-6) - k.x), (1 - (k.p + 1e-4) / (k.p + 1e-4 + 1e-3)) * (k.p + 1e-4) FROM k JOIN e ON e.event_type = k.event_type "
    "AND e.k = k.k + 1) SELECT event_type, k, round(x, 4) AS x FROM k")
def stream_kalman(spark, sf):
    return rounded(jobs.online_kalman(spark, f"{sf}/events.parquet"), "x", digits=4)


@query("stream_window_rows", 
    "WITH e AS (SELECT event_type, row_number() OVER w AS k, sum(value) OVER (PARTITION BY event_type ORDER BY ts, "
    "event_id ROWS 6 PRECEDING) AS total, sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED "
    "PRECEDING) AS running FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)) SELECT event_type, "
    "k, round(total, 4) AS total, round(running, 2) AS running FROM e WHERE k >= 7")
def stream_window_rows(spark, sf):
    out = jobs.rolling_buffer(spark, f"{sf}/events.parquet", 7).drop("lags")
    return rounded(rounded(out, "total", digits=4), "running", digits=2)
