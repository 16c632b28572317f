"""Queries: filters of columns, folds and windows, jobs and their files, checks, tests."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import clean
from ..operators import experiments as E
from ..operators import features as X
from ..operators import metrics as M
from ..operators import models as ML
from ..operators import signals as S
from ..operators.blocks import cumulative
from ..operators.clean import along
from ..sources import files
from ..streaming import jobs
from .daily import MANY_RATES, daily_rates, many_rates, read, runs
from .registry import D, R, mean, mean_sql, query, rounded
from .results import SEGMENTS
from .shaping import _SEQ, _steps, _windows, z_score


def _kalman_sql(source: str, columns: list[str], keys: str, order: str, q: float, r: float = 1e-3) -> str:
    """Tables f(keys, order, columns ...): the filter of each column of `source`, as a recursion."""
    z = ", ".join(f"greatest({c} + 1e-6, 1e-6) AS {c}" for c in columns)
    first = ", ".join(f"CAST({c} AS DOUBLE)" for c in columns)
    gain = f"((f.p + {q!r}) / (f.p + {q!r} + {r!r}))"
    step = ", ".join(f"f.{c} + {gain} * (fz.{c} - f.{c})" for c in columns)
    same = " AND ".join(f"fz.{k} = f.{k}" for k in keys.split(", "))
    return f""",
fz AS (SELECT {keys}, {order}, {z} FROM {source}),
f({keys}, {order}, {", ".join(columns)}, p) AS (
  SELECT {keys}, {order}, {first}, CAST(1 - 1 / (1 + {r!r}) AS DOUBLE) FROM fz WHERE {order} = 1
  UNION ALL
  SELECT {", ".join(f"fz.{k}" for k in keys.split(", "))}, fz.{order}, {step}, (1 - {gain}) * (f.p + {q!r})
  FROM f JOIN fz ON {same} AND fz.{order} = f.{order} + 1)"""


@query(
    "kalman_columns",
    D
    + _kalman_sql("d", ["oil", "gas"], "well", "t", 1e-5)
    + """
SELECT d.well, d.t, round(f.oil, 4) AS oil, d.oil AS "oil_Original", round(f.gas, 3) AS gas, d.gas AS "gas_Original"
FROM d JOIN f USING (well, t)""",
)
def kalman_columns(spark: SparkSession, sf: str) -> DataFrame:
    d = daily_rates(spark, sf).select("well", "t", "oil", "gas")
    return rounded(rounded(S.filter_columns(d, ["oil", "gas"], q=1e-5), "oil", digits=4), "gas", digits=3)


@query(
    "filter_lag_columns",
    D
    + """,
l AS (SELECT well, t, oil AS oil_lag0, lag(oil) OVER w AS oil_lag1, lead(oil, 5) OVER w AS label
      FROM d WINDOW w AS (PARTITION BY well ORDER BY t)),
m AS (SELECT *, row_number() OVER (PARTITION BY well ORDER BY t) AS k, count(*) OVER (PARTITION BY well) AS n
      FROM l WHERE oil_lag1 IS NOT NULL AND label IS NOT NULL),
s AS (SELECT well, t, oil_lag0, oil_lag1, label, CASE WHEN k > n - floor(n * 0.2) THEN 'test' ELSE 'train' END AS side FROM m),
o AS (SELECT *, row_number() OVER (PARTITION BY well, side ORDER BY t) AS k FROM s)"""
    + _kalman_sql("o", ["oil_lag0", "oil_lag1", "label"], "well, side", "k", 1e-4)
    + """
SELECT o.well, o.side, o.t, round(f.oil_lag0, 4) AS oil_lag0, round(f.oil_lag1, 4) AS oil_lag1,
       round(CASE WHEN o.side = 'train' THEN f.label ELSE o.label END, 4) AS label
FROM o JOIN f ON o.well = f.well AND o.side = f.side AND o.k = f.k""",
)
def filter_lag_columns(spark, sf):
    """Lag columns of train and test are filtered apart, the target of train only."""
    rows = X.chrono_split(X.lag_features(daily_rates(spark, sf), "oil", 2, 5), 0.2)
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("well", "side").orderBy("t")))
    out = S.filter_columns(rows, ["oil_lag0", "oil_lag1", "label"], keys=["well", "side"], order="k")
    label = F.when(F.col("side") == "train", F.col("label")).otherwise(F.col("label_Original"))
    return rounded(out.select("well", "side", "t", "oil_lag0", "oil_lag1", label.alias("label")), "oil_lag0", "oil_lag1", "label", digits=4)


@query(
    "kalman_per_fold",
    D
    + """,
z AS (SELECT well, t, greatest(oil + 1e-6, 1e-6) AS z, max(t) OVER (PARTITION BY well) AS n FROM d),
g(k, gain, p) AS (
  SELECT 1, CAST(1 AS DOUBLE), CAST(1 - 1 / (1 + 1e-3) AS DOUBLE)
  UNION ALL
  SELECT k + 1, (p + 1e-6) / (p + 1e-6 + 1e-3), (1 - (p + 1e-6) / (p + 1e-6 + 1e-3)) * (p + 1e-6) FROM g WHERE k < 262),
f(well, fold, k, x) AS (
  SELECT well, t + 205, 1, CAST(z AS DOUBLE) FROM z WHERE t + 261 <= n
  UNION ALL
  SELECT f.well, f.fold, f.k + 1, f.x + g.gain * (z.z - f.x)
  FROM f JOIN g ON g.k = f.k + 1 JOIN z ON z.well = f.well AND z.t = f.fold - 205 + f.k)
SELECT well, CAST(fold AS INTEGER) AS fold, round(max(CASE WHEN k = 200 THEN x END), 4) AS oldest,
       round(max(CASE WHEN k = 206 THEN x END), 4) AS newest, round(max(CASE WHEN k = 262 THEN x END), 4) AS label
FROM f GROUP BY well, fold""",
)
def kalman_per_fold(spark, sf):
    f = S.kalman_per_fold(daily_rates(spark, sf), "oil")
    out = f.select("well", "fold", F.get("lags", F.lit(0)).alias("oldest"), F.get("lags", F.lit(6)).alias("newest"), "label")
    return rounded(out, "oldest", "newest", "label", digits=4)


def _smooth_sql(column: str, size: int) -> str:
    """Tables b_<c> and l_<c>: fitted values of windows from a first level of 0, and the best one."""
    c = column
    return f""",
o_{c} AS (SELECT well, window_id, {c} AS v, k FROM q, (SELECT unnest(range(1, {size + 1})) AS k)),
b_{c} AS (SELECT well, window_id, k, v[k] AS v,
          coalesce(list_sum([0.2 * power(0.8, k - 1 - j) * v[j] for j in range(1, k)]), 0) AS base FROM o_{c}),
l_{c} AS (SELECT well, window_id, max(CASE WHEN k = 1 THEN base END) AS b1, max(CASE WHEN k = {size} THEN base END) AS bn,
          sum(power(0.8, k - 1) * (v - base)) / sum(power(0.8, k - 1) * power(0.8, k - 1)) AS s0 FROM b_{c} GROUP BY 1, 2)"""


def _wavelet_sql(source: str, column: str, n: int) -> str:
    """Tables that end in z_<c>: three Haar steps of windows of n values, details softened by half the
    window's deviation, and back. Odd lengths repeat their last value."""
    c, sizes = column, [n]
    sql = f", t_{c} AS (SELECT well, window_id, {c} AS a0, 0.5 * list_stddev_pop({c}) AS th FROM {source})"
    last = f"t_{c}"
    for i in range(3):
        half = (sizes[-1] + 1) // 2
        even = f"list_append(a{i}, a{i}[-1])" if sizes[-1] % 2 else f"a{i}"
        pair = lambda sign: f"[(v[2*i-1] {sign} v[2*i]) / sqrt(2.0) for i in range(1, {half + 1})]"  # noqa: B023, E731
        soft = f"[sign(w) * greatest(abs(w) - th, 0) for w in {pair('-')}]"
        sql += f", u_{c}{i} AS (SELECT *, {even} AS v FROM {last}), h_{c}{i} AS (SELECT * EXCLUDE v, {pair('+')} AS a{i + 1}, {soft} AS d{i} FROM u_{c}{i})"
        last, sizes = f"h_{c}{i}", [*sizes, half]
    out = "a3"
    for i in reversed(range(3)):
        sql += f", r_{c}{i} AS (SELECT *, flatten([[({out}[i] + d{i}[i]) / sqrt(2.0), ({out}[i] - d{i}[i]) / sqrt(2.0)] for i in range(1, {sizes[i + 1] + 1})])[1:{sizes[i]}] AS y{i} FROM {last})"
        last, out = f"r_{c}{i}", f"y{i}"
    return sql + f", z_{c} AS (SELECT well, window_id, y0 AS z FROM {last})"


def _smoother_sql(column: str, n: int) -> str:
    """The local-level smoother of windows as a recursion forward and one back: table s_<c>."""
    c, gain = column, "((f.p + 1e-5) / (f.p + 1e-5 + 1e-3))"
    return f""", f_{c}(well, window_id, k, x, p) AS (
  SELECT well, window_id, 1, CAST({c}[1] AS DOUBLE), CAST(1 - 1 / (1 + 1e-3) AS DOUBLE) FROM q
  UNION ALL
  SELECT f.well, f.window_id, f.k + 1, f.x + {gain} * (q.{c}[f.k + 1] - f.x), (1 - {gain}) * (f.p + 1e-5)
  FROM f_{c} f JOIN q ON q.well = f.well AND q.window_id = f.window_id WHERE f.k < {n}),
s_{c}(well, window_id, k, x) AS (
  SELECT well, window_id, k, x FROM f_{c} WHERE k = {n}
  UNION ALL
  SELECT f.well, f.window_id, f.k, f.x + f.p / (f.p + 1e-5) * (s.x - f.x) FROM s_{c} s JOIN f_{c} f ON f.well = s.well AND f.window_id = s.window_id AND f.k = s.k - 1)"""


@query(
    "filter_windows",
    D
    + _SEQ
    + _smooth_sql("x", 7)
    + _smooth_sql("y", 30)
    + _wavelet_sql("q", "x", 7)
    + _wavelet_sql("q", "y", 30)
    + _smoother_sql("x", 7)
    + _smoother_sql("y", 30)
    + """
SELECT 'exponential_smoothing' AS method, well, window_id, round(a.b1 + a.s0, 4) AS x_first, round(a.bn + a.s0 * power(0.8, 6), 4) AS x_last,
       round(b.b1 + b.s0, 4) AS y_first, round(b.bn + b.s0 * power(0.8, 29), 4) AS y_last
FROM l_x a JOIN l_y b USING (well, window_id)
UNION ALL SELECT 'wavelet', well, window_id, round(a.z[1], 4), round(a.z[7], 4), round(b.z[1], 4), round(b.z[30], 4) FROM z_x a JOIN z_y b USING (well, window_id)
UNION ALL SELECT 'kalman', a.well, a.window_id, round(max(a.x) FILTER (WHERE a.k = 1), 4), round(max(a.x) FILTER (WHERE a.k = 7), 4),
                 round(max(b.x) FILTER (WHERE b.k = 1), 4), round(max(b.x) FILTER (WHERE b.k = 30), 4)
          FROM s_x a JOIN s_y b ON a.well = b.well AND a.window_id = b.window_id AND (a.k IN (1, 7) AND b.k IN (1, 30)) GROUP BY 2, 3""",
)
def filter_windows(spark, sf):
    """Windows' target column and label through each filter by its name."""
    w = _windows(spark, sf).select("well", "window_id", F.transform("x", lambda r: F.get(r, F.lit(0))).alias("x"), "y")
    out = None
    for method in S.WINDOW_FILTERS:
        f = S.filter_windows(w, {"x": 7, "y": 30}, method)
        ends = [e.alias(f"{c}_{n}") for c in ("x", "y") for n, e in (("first", F.get(f"{c}_filtered", F.lit(0))), ("last", F.element_at(f"{c}_filtered", -1)))]
        one = f.select(F.lit(method).alias("method"), "well", "window_id", *ends)
        out = one if out is None else out.unionByName(one)
    return rounded(out, "x_first", "x_last", "y_first", "y_last", digits=4)


@query(
    "envelope",
    D
    + _SEQ
    + f"""
SELECT well, window_id + step AS t, round(p + {z_score(0.1)!r} * y * 0.1, 4) AS lo, round(p + {z_score(0.9)!r} * y * 0.1, 4) AS hi
FROM e WHERE window_id = 0 OR step = 30""",
)
def envelope(spark, sf):
    """Percentile curves of overlapping windows, on the series that they make up."""
    steps = _steps(spark, sf).withColumn("sigma", F.col("y") * 0.1)
    mu = X.reconstruct(steps, 30, "p").withColumnRenamed("value", "mu")
    sigma = X.reconstruct(steps, 30, "sigma").withColumnRenamed("value", "sigma")
    curve = lambda p: F.col("mu") + z_score(p) * F.col("sigma")
    return rounded(mu.join(sigma, ["well", "t"]).select("well", "t", curve(0.1).alias("lo"), curve(0.9).alias("hi")), "lo", "hi", digits=4)


@query(
    "sensitivity_grid",
    R
    + """
SELECT architecture_id AS dataset, well, CAST(w AS INTEGER) AS window_size, CAST(h AS INTEGER) AS forecast_horizon
FROM (SELECT DISTINCT architecture_id, well FROM r), (SELECT unnest([7, 14, 28]) AS w), (SELECT unnest([1, 28, 56]) AS h)""",
)
def sensitivity_grid(spark, sf):
    """A job for each window size and horizon of each well of each dataset."""
    jobs_ = runs(spark, sf).select(F.col("architecture_id").alias("dataset"), "well").distinct()
    jobs_ = jobs_.withColumn("window_size", F.explode(F.array(*map(F.lit, (7, 14, 28)))))
    return jobs_.withColumn("forecast_horizon", F.explode(F.array(*map(F.lit, (1, 28, 56)))))


@query(
    "option_grid",
    R
    + """
SELECT architecture_id AS dataset, well, hyperparam_id AS config, strategy, extractor, fuser
FROM r, (SELECT unnest(['pressure', 'arps']) AS strategy), (SELECT unnest(['cnn', 'gru']) AS extractor),
     (SELECT unnest(['sum', 'gate', 'concat']) AS fuser)""",
)
def option_grid(spark, sf):
    """Each well's configurations with each strategy, extractor and fuser."""
    grid = runs(spark, sf).select(F.col("architecture_id").alias("dataset"), "well", F.col("hyperparam_id").alias("config"))
    for c, values in (("strategy", ["pressure", "arps"]), ("extractor", ["cnn", "gru"]), ("fuser", ["sum", "gate", "concat"])):
        grid = grid.withColumn(c, F.explode(F.array(*map(F.lit, values))))
    return grid


_RUN_NAME = """CASE n % 5 WHEN 0 THEN 'output_sens_' || replace(well, ' ', '_') || '.ipynb'
 WHEN 1 THEN 'output_' || regexp_replace(md5(job_id), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') || '.ipynb'
 WHEN 2 THEN 'output_' || well || '-checkpoint.ipynb' WHEN 3 THEN 'notes_' || well || '.ipynb' ELSE 'output_' || well || '.ipynb' END"""


@query(
    "classify_run_files",
    R
    + f""", f AS (SELECT job_id, {_RUN_NAME} AS name FROM r)
SELECT job_id, CASE WHEN name NOT LIKE 'output\\_%' ESCAPE '\\' OR name LIKE '%-checkpoint%' THEN NULL
  WHEN starts_with(name, 'output_sens_') THEN 'sensitivity'
  WHEN regexp_matches(name, '_[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}\\.ipynb$') THEN 'manifest' ELSE 'simple' END AS mode FROM f""",
)
def classify_run_files(spark, sf):
    r, k = runs(spark, sf), F.col("n") % 5
    digest = F.regexp_replace(F.md5("job_id"), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    name = F.when(k == 0, F.concat(F.lit("output_sens_"), F.translate("well", " ", "_"))).when(k == 1, F.concat(F.lit("output_"), digest))
    name = name.when(k == 2, F.concat(F.lit("output_"), "well", F.lit("-checkpoint"))).when(k == 3, F.concat(F.lit("notes_"), "well")).otherwise(F.concat(F.lit("output_"), "well"))
    return r.select("job_id", files.run_mode(F.concat(name, F.lit(".ipynb"))).alias("mode"))


@query(
    "nb_text",
    R
    + """
SELECT architecture_id AS run, string_agg('SMAPE: ' || CAST(n AS VARCHAR) || ' of ' || well, chr(10) ORDER BY job_id) AS text
FROM r GROUP BY architecture_id""",
)
def nb_text(spark, sf):
    """Notebooks with an output of each run, written and read again."""
    path = files.shared_folder(spark)
    said = F.concat(F.lit("SMAPE: "), F.col("n").cast("string"), F.lit(" of "), "well")
    output = lambda kind, text: F.struct(F.lit(kind).alias("output_type"), text.alias("text"))
    cell = F.struct(F.array(output("display_data", F.lit("a plot")), output("stream", said)).alias("outputs"))
    cells = F.transform(F.sort_array(F.collect_list(F.struct("job_id", cell.alias("cell")))), lambda x: x["cell"])
    nb = runs(spark, sf).groupBy(F.col("architecture_id").alias("run")).agg(F.to_json(F.struct(cells.alias("cells"))).alias("value"))
    nb.write.partitionBy("run").text(path)
    return files.read_notebook_text(spark, path).select(F.regexp_extract("file", "run=([^/]+)/", 1).alias("run"), "text")


@query(
    "sink_experiment",
    R
    + f"""
SELECT 'ORDERS-LINES_seq_ens5_20240131' AS experiment, architecture_id AS variant, 'smape' AS metric, count(*) AS n,
       round({mean_sql('smape')}, 6) AS value, '[7, 56]' AS shape FROM r GROUP BY 2
UNION ALL SELECT 'ORDERS-LINES_seq_ens5_20240131', architecture_id, 'mae', count(*), round({mean_sql('mae')}, 6), '[7, 56]' FROM r GROUP BY 2""",
)
def sink_experiment(spark, sf):
    """Saved with its configuration under its name, and read again."""
    name = files.experiment_name(["ORDERS", "LINES"], "seq", 5, "20240131")
    metrics = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("smape", "mae")]))
    results = runs(spark, sf).select(F.col("architecture_id").alias("variant"), "well", metrics)
    path = files.save_experiment(spark, files.shared_folder(spark), name, {"shape": [7, 56], "members": 5}, results)
    shape = spark.read.parquet(f"{path}/config").filter("key = 'shape'").first().value
    out = spark.read.parquet(f"{path}/results").groupBy("variant", "metric").agg(F.count(F.lit(1)).alias("n"), mean("value").alias("value"))
    return rounded(out.select(F.lit(name).alias("experiment"), "*", F.lit(shape).alias("shape")), "value")


@query(
    "prepared_reuse",
    D + " SELECT well, count(*) AS n, sum(oil) AS oil, true AS reused FROM d WHERE oil > 0 GROUP BY well",
)
def prepared_reuse(spark, sf):
    """Prepared once for its parameters; the second call, with the same ones, reads what is there."""
    folder, params, calls = files.shared_folder(spark), {"mode": "positive", "column": "oil"}, []

    def prepare() -> DataFrame:
        calls.append(1)
        return clean.drop_zero_rates(daily_rates(spark, sf), "oil", "positive")

    for order in (params, dict(reversed(params.items()))):
        rows = files.prepared(spark, folder, order, prepare)
    return rows.groupBy("well").agg(F.count(F.lit(1)).alias("n"), F.sum("oil").alias("oil"), F.lit(len(calls) == 1).alias("reused"))


@query(
    "data_check",
    D
    + """
SELECT 'daily' AS dataset, CAST(count(*) FILTER (WHERE whp IS NULL) AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_infinite,
       coalesce(bool_or(greatest(abs(t), abs(oil), abs(gas), abs(water), abs(downhole), abs(coalesce(whp, 0)), abs(choke)) > 1e6), false) AS outliers,
       count(*) FILTER (WHERE whp IS NULL) = 0 AND NOT coalesce(bool_or(greatest(abs(t), abs(oil), abs(gas), abs(water), abs(downhole), abs(coalesce(whp, 0)), abs(choke)) > 1e6), false) AS ok FROM d
UNION ALL
SELECT 'events', count(*) FILTER (WHERE value IS NULL OR isnan(value)), count(*) FILTER (WHERE isinf(value)),
       coalesce(bool_or(abs(value) > 1e6 AND NOT isinf(value)), false),
       count(*) FILTER (WHERE value IS NULL OR isnan(value) OR isinf(value)) = 0 AND NOT coalesce(bool_or(abs(value) > 1e6), false) FROM events""",
)
def data_check(spark, sf):
    return clean.data_check({"daily": daily_rates(spark, sf), "events": read(spark, sf, "events").select("value")})


def _simpson(a: str, b: str) -> str:
    h = f"(({b}) - ({a})) / 2000"
    weight = "CASE WHEN i IN (0, 2000) THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END"
    return f"list_sum([{weight} * power(greatest(cos({a} + i * {h}), 0), dof - 1) for i in range(0, 2001)]) * {h} / 3"


@query(
    "welch_conclusions",
    R
    + f""",
g AS (SELECT architecture_id AS g, avg(smape) AS m, var_samp(smape) / count(smape) AS e, count(smape) AS n FROM r GROUP BY 1),
s AS (SELECT a.g AS a, b.g AS b, a.m AS m0, b.m AS m1, (a.m - b.m) / sqrt(a.e + b.e) AS t,
             power(a.e + b.e, 2) / (power(a.e, 2) / (a.n - 1) + power(b.e, 2) / (b.n - 1)) AS dof
      FROM g a JOIN g b ON a.g < b.g),
e AS (SELECT *, least(pi() / 2, 40 / sqrt(dof)) AS far FROM s),
p AS (SELECT *, ({_simpson("least(atan(abs(t) / sqrt(dof)), far)", "far")}) / ({_simpson("0.0", "far")}) AS p FROM e)
SELECT a, b, round(t, 6) AS t, round(dof, 4) AS dof, round(p, 6) AS p,
       CASE WHEN p < 0.05 THEN 'significant difference, lower in ' || CASE WHEN m0 < m1 THEN a ELSE b END ELSE 'no significant difference' END AS conclusion FROM p""",
)
def welch_conclusions(spark, sf):
    """Every pair of architectures."""
    pairs = list(combinations(SEGMENTS, 2))
    return rounded(rounded(M.welch_conclusions(runs(spark, sf), "architecture_id", pairs, "smape"), "t", "p"), "dof", digits=4)


@query(
    "cumulative_eval_variants",
    D
    + """,
n AS (SELECT *, count(*) OVER (PARTITION BY well) AS n FROM d),
b AS (SELECT well, sum(oil) AS whole, sum(oil) - max_by(oil, t) AS but_last, max_by(oil, t) AS last FROM n WHERE t <= n - floor(n * 0.2) GROUP BY well),
c AS (SELECT well, t, sum(oil) OVER (PARTITION BY well ORDER BY t ROWS UNBOUNDED PRECEDING) AS total FROM n WHERE t > n - floor(n * 0.2))
SELECT well, t, variant, CASE variant WHEN 'whole' THEN whole + total WHEN 'prepended' THEN but_last + last + total ELSE total END AS total
FROM c JOIN b USING (well), (SELECT unnest(['whole', 'prepended', 'zero']) AS variant)""",
)
def cumulative_eval_variants(spark, sf):
    """The test curve after the whole training sum, after it without its last point, which is put
    in front of the test rows, and from 0."""
    d = X.chrono_split(daily_rates(spark, sf), 0.2)
    before = d.filter("side = 'train'").groupBy("well").agg(F.sum("oil").alias("whole"), F.max_by("oil", "t").alias("last"))
    test = cumulative(d.filter("side = 'test'"), "oil", "total").select("well", "t", "total").join(before, "well")
    offset = {"whole": F.col("whole"), "prepended": (F.col("whole") - F.col("last")) + F.col("last"), "zero": F.lit(0.0)}
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("variant"), (v + F.col("total")).alias("total")) for k, v in offset.items()]))
    return test.select("well", "t", each)


@query(
    "many_wells_eval",
    f"WITH RECURSIVE d AS ({MANY_RATES})"
    + """,
f AS (SELECT well, oil AS y, avg(oil) OVER (PARTITION BY well ORDER BY t ROWS BETWEEN 62 PRECEDING AND 56 PRECEDING) AS p, t FROM d)
SELECT well, round(avg(abs(y - p)), 6) AS mae, count(*) AS n FROM f WHERE t > 62 GROUP BY well""",
)
def many_wells_eval(spark, sf):
    """The mean of a window as the forecast 56 days on, over one series for each supplier."""
    w = along().rowsBetween(-62, -56)
    f = many_rates(spark, sf).select("well", "t", F.col("oil").alias("y"), F.avg("oil").over(w).alias("p")).filter("t > 62")
    return rounded(f.groupBy("well").agg(F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"), F.count(F.lit(1)).alias("n")), "mae")


@query("many_wells_walk_forward")
def many_wells_walk_forward(spark, sf):
    """The walk-forward regression over one series for each supplier."""
    return M.scores(ML.walk_forward(many_rates(spark, sf)), ["well"])


@query("many_wells_kalman")
def many_wells_kalman(spark, sf):
    f = S.filter_series(many_rates(spark, sf), "oil", "kalman")
    return f.groupBy("well").agg(F.max_by("filtered", "t").alias("last"), F.count(F.lit(1)).alias("n"))


@query("gbt_search")
def gbt_search(spark, sf):
    """Every point of a grid, each cross-validated over all training rows of all wells."""
    w = X.chrono_split(X.ratio_normalize(X.window_rows(daily_rates(spark, sf), "oil", [], 7, 56)), 0.2)
    grid = {"maxIter": [2, 3, 5], "stepSize": [0.05, 0.1, 0.3], "maxDepth": [2, 3, 4], "minInstancesPerNode": [1, 3, 5], "subsamplingRate": [0.8, 0.9, 1.0]}
    return ML.gbt_search(w, grid)


@query("stream_refit")
def stream_refit(spark, sf):
    return rounded(jobs.online_refit(spark, f"{sf}/events.parquet"), "forecast", digits=3)


_EVENTS = """WITH e AS (SELECT event_type, row_number() OVER w AS k, value, avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS 6 PRECEDING) AS f
 FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))"""


@query(
    "stream_running_metrics",
    _EVENTS
    + """,
m AS (SELECT event_type, k, value AS y, lag(CASE WHEN k >= 7 THEN f END, 5) OVER (PARTITION BY event_type ORDER BY k) AS p FROM e),
j AS (SELECT *, y - first_value(y) OVER (PARTITION BY event_type ORDER BY k) AS c FROM m WHERE p IS NOT NULL)
SELECT event_type, k, k - 11 AS n, round(avg(abs(y - p)) OVER w, 6) AS mae,
       round(100 * avg(CASE WHEN abs(y) + abs(p) = 0 THEN 0 ELSE 2 * abs(y - p) / (abs(y) + abs(p)) END) OVER w, 6) AS smape,
       round(CASE WHEN k > 20 THEN 1 - sum((y - p) * (y - p)) OVER w / (sum(c * c) OVER w - power(sum(c) OVER w, 2) / (k - 11)) END, 5) AS r2
FROM j WINDOW w AS (PARTITION BY event_type ORDER BY k ROWS UNBOUNDED PRECEDING)""",
)
def stream_running_metrics(spark, sf):
    """R2 is compared from the tenth forecast on: of few truths the variance may be next to nothing."""
    out = jobs.running_metrics(spark, f"{sf}/events.parquet").withColumn("r2", F.when(F.col("k") > 20, F.col("r2")))
    return rounded(rounded(out, "mae", "smape"), "r2", digits=5)


@query(
    "stream_lag_rows",
    """SELECT event_type, k, lags[7] AS newest, lags[1] AS oldest FROM (SELECT event_type, row_number() OVER w AS k,
 list(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS 6 PRECEDING) AS lags FROM events
 WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)) WHERE len(lags) = 7""",
)
def stream_lag_rows(spark, sf):
    out = jobs.rolling_buffer(spark, f"{sf}/events.parquet", 7)
    return out.select("event_type", "k", F.get("lags", F.lit(0)).alias("newest"), F.get("lags", F.lit(6)).alias("oldest"))


#: Each well with each of these; the last three of a well fail, as a job may.
_JOBS = [("last", 7, 56, 150), ("mean", 7, 56, 150), ("mean", 14, 28, 150), ("linear", 7, 56, 150), ("linear", 7, 28, 150), ("nothing", 7, 56, 150), ("mean", 0, 56, 150), ("last", 7, 56, 100_000)]
_JOBS_SQL = "SELECT well || '/' || i AS job_id, well, model, win, hor, len FROM (SELECT DISTINCT well FROM d), (VALUES " + ", ".join(f"({i}, '{m}', {w}, {h}, {n})" for i, (m, w, h, n) in enumerate(_JOBS)) + ") v(i, model, win, hor, len)"


def _job_table(spark, sf) -> DataFrame:
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("model"), F.lit(w).alias("window"), F.lit(h).alias("horizon"), F.lit(n).alias("length")) for i, (m, w, h, n) in enumerate(_JOBS)])
    wells = daily_rates(spark, sf).select("well").distinct()
    return wells.select("well", F.inline(each)).withColumn("job_id", F.concat_ws("/", "well", "i")).drop("i")


@query("run_experiments")
def run_experiments(spark, sf):
    """A table of jobs, run, collated and merged; failing jobs are left out, the others complete."""
    return E.collate(*E.run_jobs(_job_table(spark, sf), daily_rates(spark, sf).select("well", "t", "oil")))


_JOB_ROWS = """, j AS (%s WHERE model IN ('last', 'mean') AND win > 0),
z AS (SELECT j.*, d.t, d.oil, count(*) OVER (PARTITION BY job_id) AS n FROM j JOIN d USING (well)),
p AS (SELECT z.*, CASE WHEN model = 'last' THEN b.oil ELSE (SELECT avg(c.oil) FROM d c WHERE c.well = z.well AND c.t BETWEEN z.t - hor - win + 1 AND z.t - hor) END AS p
      FROM z JOIN d b ON b.well = z.well AND b.t = z.t - hor WHERE n >= len + 2 * hor AND z.t >= len + hor),
h AS (SELECT *, CASE WHEN row_number() OVER w <= floor(count(*) OVER (PARTITION BY job_id) / 2) THEN 'val' ELSE 'test' END AS half FROM p WINDOW w AS (PARTITION BY job_id ORDER BY t)),
k AS (SELECT job_id, half, 'aggregated' AS kind, oil AS y, p FROM h UNION ALL
      SELECT job_id, half, 'cumulative', sum(oil) OVER w, sum(p) OVER w FROM h WINDOW w AS (PARTITION BY job_id, half ORDER BY t ROWS UNBOUNDED PRECEDING)),
s AS (SELECT job_id, kind, half, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)) AS r2, 100 * avg(CASE WHEN abs(y) + abs(p) = 0 THEN 0 ELSE 2 * abs(y - p) / (abs(y) + abs(p)) END) AS smape, avg(abs(y - p)) AS mae FROM k GROUP BY ALL)
SELECT job_id, kind, """ % _JOBS_SQL + ", ".join(f"round(max({m}) FILTER (WHERE half = '{h}'), 5) AS {m}_{h}" for m in ("r2", "smape", "mae") for h in ("val", "test")) + " FROM s GROUP BY job_id, kind"


@query("job_metrics", D + _JOB_ROWS)
def job_metrics(spark, sf):
    """The metrics of the jobs whose models SQL can express."""
    jobs_ = _job_table(spark, sf).filter("model <> 'linear'")
    out = E.collate(*E.run_jobs(jobs_, daily_rates(spark, sf).select("well", "t", "oil")))
    metrics = [f"{m}_{h}" for m in ("r2", "smape", "mae") for h in ("val", "test")]
    return rounded(out.select("job_id", "kind", *metrics), *metrics, digits=5)


@query(
    "collate_status",
    D
    + f""", j AS ({_JOBS_SQL}), n AS (SELECT well, count(*) AS n FROM d GROUP BY well),
s AS (SELECT j.*, CASE WHEN model = 'nothing' THEN 'ValueError: unknown model nothing' WHEN win < 1 THEN 'ValueError: window is not positive'
                       WHEN n < len + 2 * hor THEN 'ValueError: ' || n || ' rows are fewer than length + 2 * horizon' END AS error FROM j JOIN n USING (well))
SELECT model, CASE WHEN error IS NULL THEN 'success' ELSE 'failure' END AS status, count(*) AS n, min(error) AS error FROM s GROUP BY ALL""",
)
def collate_status(spark, sf):
    """How many jobs of each model succeed and fail, with a message."""
    status, _ = E.run_jobs(_job_table(spark, sf), daily_rates(spark, sf).select("well", "t", "oil"))
    return status.groupBy("model", "status").agg(F.count(F.lit(1)).alias("n"), F.min("error").alias("error"))


@query(
    "job_queue",
    """SELECT row_number() OVER (ORDER BY d, w, e) AS exp_id, d.dataset, w.well, e.method
FROM (SELECT unnest(['field', 'simulated']) AS dataset, unnest([1, 2]) AS d) d, (SELECT n_name AS well, row_number() OVER (ORDER BY n_name) AS w FROM nation) w,
     (SELECT unnest([NULL, 'exponential_smoothing', 'wavelet', 'kalman']) AS method, unnest([1, 2, 3, 4]) AS e) e""",
)
def job_queue(spark, sf):
    """The simple queue: datasets, then wells, then filter configurations, with a running number."""
    wells = [r.n_name for r in read(spark, sf, "nation").select("n_name").orderBy("n_name").collect()]  # the names of a dimension
    methods = [c["filter_method"] for c in E.filter_configurations(None) + E.filter_configurations(["exponential_smoothing", "wavelet", "kalman"])]
    return E.job_queue(spark, ("dataset", ["field", "simulated"]), ("well", wells), ("method", methods))
