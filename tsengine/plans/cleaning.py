"""Queries: cleaning, joins of inputs, job tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.units import FACTORS, convert
from ..operators import clean as C
from ..operators.ranking import quantiles
from .daily import daily_rates, read, runs
from .registry import D, R, query, rounded


@query("filter_well", D + " SELECT well, t, oil FROM d WHERE well IN ('A-F', 'N-O')")
def filter_well(spark: SparkSession, sf: str) -> DataFrame:
    return C.filter_wells(daily_rates(spark, sf), ["A-F", "N-O"], strict=False).select("well", "t", "oil")


@query("select_sources", D + " SELECT DISTINCT well FROM d WHERE well IN ('R-F', 'none')")
def select_sources(spark, sf):
    return daily_rates(spark, sf).filter(F.col("well").isin("R-F", "none")).select("well").distinct()


@query("drop_zero_rates", D + 
    " SELECT mode, well, count(*) AS n FROM (SELECT 'nonzero_dropna' AS mode, well, t FROM d WHERE choke <> 0 UNION "
    "ALL SELECT 'nonzero', well, t FROM d WHERE choke IS NULL OR choke <> 0 UNION ALL SELECT 'positive', well, t FROM "
    "d WHERE choke > 0) GROUP BY 1, 2")
def drop_zero_rates(spark, sf):
    d = daily_rates(spark, sf)
    parts = [C.drop_zero_rates(d, "choke", m).select(F.lit(m).alias("mode"), "well") for m in ("nonzero_dropna", "nonzero", "positive")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy("mode", "well").agg(F.count(F.lit(1)).alias("n"))


@query("canonicalize", D + ' SELECT well, t, 0.0::DOUBLE AS "PI", oil AS "BORE_OIL_VOL", gas AS "BORE_GAS_VOL", downhole AS "AVG_DOWNHOLE_PRESSURE" FROM d')
def canonicalize(spark, sf):
    names = {"oil": "BORE_OIL_VOL", "gas": "BORE_GAS_VOL", "downhole": "AVG_DOWNHOLE_PRESSURE"}
    return C.canonicalize(daily_rates(spark, sf), names, ["PI", "BORE_OIL_VOL", "BORE_GAS_VOL", "AVG_DOWNHOLE_PRESSURE"], ["well", "t"])


@query("project_features", D + " SELECT well, t, gas, whp, oil FROM d WHERE gas IS NOT NULL AND whp IS NOT NULL AND oil IS NOT NULL")
def project_features(spark, sf):
    return daily_rates(spark, sf).select("well", "t", "gas", "whp", "oil").na.drop(subset=["gas", "whp", "oil"])


@query("dedupe_first", 
    "SELECT event_type, slot, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, slot ORDER "
    "BY ts, event_id) AS rn FROM (SELECT *, date_trunc('hour', ts) AS slot FROM events)) WHERE rn = 1")
def dedupe_first(spark, sf):
    e = read(spark, sf, "events").withColumn("slot", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return C.first_of(e, ["event_type", "slot"], [F.col("ts"), F.col("event_id")]).select("event_type", "slot", "event_id", "value")


@query("ffill", D + " SELECT well, t, last_value(whp IGNORE NULLS) OVER (PARTITION BY well ORDER BY t ROWS UNBOUNDED PRECEDING) AS whp FROM d")
def ffill(spark, sf):
    return C.ffill(daily_rates(spark, sf).select("well", "t", "whp"), "whp", "whp")


_IMPUTED = """, g AS (SELECT *, CASE WHEN t % 11 < 6 THEN NULL ELSE whp END AS v FROM d),
i AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY well ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS c FROM g),
j AS (SELECT *, last_value(CASE WHEN c IS NOT NULL THEN t END IGNORE NULLS) OVER a AS pt, last_value(c IGNORE NULLS) OVER a AS pv,
             first_value(CASE WHEN c IS NOT NULL THEN t END IGNORE NULLS) OVER b AS nt, first_value(c IGNORE NULLS) OVER b AS nv
      FROM i WINDOW a AS (PARTITION BY well ORDER BY t ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY well ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT well, t, round(coalesce(c, CASE WHEN pt IS NOT NULL AND nt IS NOT NULL THEN pv + (nv - pv) * (t - pt) / (nt - pt) END, pv), 6) AS filled FROM j"""


@query("causal_impute", D + _IMPUTED)
def causal_impute(spark, sf):
    d = daily_rates(spark, sf).withColumn("v", F.when(F.col("t") % 11 < 6, None).otherwise(F.col("whp")))
    return rounded(C.causal_impute(d, "v", "filled").select("well", "t", "filled"), "filled")


@query("mean_impute", D + " SELECT well, t, round(coalesce(whp, avg(whp) OVER (PARTITION BY well)), 6) AS whp FROM d")
def mean_impute(spark, sf):
    return rounded(C.mean_impute(daily_rates(spark, sf), ["whp"]).select("well", "t", "whp"), "whp")


@query("validity_gate", D + 
    " SELECT 'whp' AS \"column\", count(*) AS total, count(*) FILTER (WHERE whp IS NULL) AS n_null, 0::BIGINT AS n_pos_inf, "
    "0::BIGINT AS n_neg_inf, 0::BIGINT AS n_big FROM d UNION ALL SELECT 'gas', count(*), 0, 0, 0, count(*) FILTER (WHERE "
    "abs(gas) > 1e6) FROM d")
def validity_gate(spark, sf):
    return C.bad_values(daily_rates(spark, sf), ["whp", "gas"], 1e6)


@query("integrity_report", D + 
    " SELECT well, count(*) AS total, count(*) FILTER (WHERE whp IS NULL) AS n_null, round(100.0 * count(*) FILTER "
    "(WHERE whp IS NULL) / count(*), 6) AS pct_null FROM d GROUP BY well")
def integrity_report(spark, sf):
    n = F.count_if(F.col("whp").isNull())
    out = daily_rates(spark, sf).groupBy("well").agg(F.count(F.lit(1)).alias("total"), n.alias("n_null"), (100.0 * n / F.count(F.lit(1))).alias("pct_null"))
    return rounded(out, "pct_null")


@query("unit_convert", D + 
    " SELECT well, t, round(downhole * 0.145037738, 6) AS kpa_psi, round(downhole * 14.5038, 6) AS bar_psi, round(oil "
    "* 6.2898, 6) AS m3d_stbd, round(oil * 35.3147, 6) AS m3d_scfd, round(downhole / 14.5038, 6) AS psi_bar FROM d")
def unit_convert(spark, sf):
    source = {"kpa_psi": "downhole", "bar_psi": "downhole", "m3d_stbd": "oil", "m3d_scfd": "oil"}
    d = daily_rates(spark, sf).select("well", "t", *[convert(F.col(source[k]), k).alias(k) for k in FACTORS], convert(F.col("downhole"), "bar_psi", inverse=True).alias("psi_bar"))
    return rounded(d, *FACTORS, "psi_bar")


@query("unit_sanity", D + " SELECT well, median(downhole) AS mid, median(downhole) > 160 AS suspicious FROM d GROUP BY well")
def unit_sanity(spark, sf):
    return quantiles(daily_rates(spark, sf), ["well"], "downhole", {"mid": 0.5}).withColumn("suspicious", F.col("mid") > 160)


@query("decimate", D + " SELECT well, t, oil FROM d WHERE t > 20 AND (t - 21) % 24 = 0")
def decimate(spark, sf):
    return C.decimate(daily_rates(spark, sf), 24, 20).select("well", "t", "oil")


@query("time_index", D + 
    " SELECT well, day, t, date_add(DATE '2020-01-01', CAST(t - 1 AS INTEGER))::DATE AS synthetic FROM d WHERE t > "
    "1".replace("date_add(DATE '2020-01-01', CAST(t - 1 AS INTEGER))::DATE", "CAST(DATE '2020-01-01' + CAST(t - 1 AS INTEGER) AS DATE)"))
def time_index(spark, sf):
    return daily_rates(spark, sf).filter("t > 1").select("well", "day", "t", F.date_add(F.lit("2020-01-01").cast("date"), F.col("t") - 1).alias("synthetic"))


@query("dataset_filter", R + 
    " SELECT architecture_id, hyperparam_id, well, smape FROM r WHERE architecture_id <> 'BUILDING' AND well IN ('NATION_1', "
    "'NATION_2', 'NATION_3')")
def dataset_filter(spark, sf):
    r = runs(spark, sf)
    return r.filter(~F.col("architecture_id").isin("BUILDING") & F.col("well").isin("NATION_1", "NATION_2", "NATION_3")).select("architecture_id", "hyperparam_id", "well", "smape")


@query("eligible_folds", D + 
    " SELECT well, it FROM (SELECT well, count(*) AS n FROM d GROUP BY well), (SELECT unnest(range(0, (SELECT CAST(max(t) AS BIGINT) FROM d), 250)) AS "
    "it) WHERE n - 150 - 112 > it")
def eligible_folds(spark, sf):
    n = daily_rates(spark, sf).groupBy("well").agg(F.count(F.lit(1)).alias("n"))
    last = F.col("n") - 150 - 2 * 56 - 1  # no series is too long to have all its folds
    return n.filter(last >= 0).select("well", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(250).cast("long"))).alias("it"))


@query("pending_jobs", R + " SELECT job_id FROM r WHERE n % 2 = 0")
def pending_jobs(spark, sf):
    status = F.when(F.col("n") % 2 == 0, "pending").otherwise("done")
    return runs(spark, sf).withColumn("status", status).filter("status = 'pending'").select("job_id")


@query("structure_results", R + 
    " SELECT r2 AS \"R2\", smape AS \"SMAPE\", mae AS \"MAE\", upper(category[1]) || lower(category[2:]) AS category, "
    "well FROM r".replace("upper(category[1]) || lower(category[2:])", "array_to_string(list_transform(string_split(category, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ')"))
def structure_results(spark, sf):
    return runs(spark, sf).drop("architecture_id", "hyperparam_id", "job_id", "n").select(F.col("r2").alias("R2"), F.col("smape").alias("SMAPE"), F.col("mae").alias("MAE"), F.initcap("category").alias("category"), "well")


@query("injection_join", D + " SELECT a.well, a.t, a.oil, coalesce(b.water, 0) AS injected FROM d a LEFT JOIN d b ON b.well = 'R-F' AND a.day = b.day")
def injection_join(spark, sf, injector_well: str = "R-F"):
    """All producers with the field's one injector, whose name is a parameter."""
    d = daily_rates(spark, sf)
    injector = d.filter(F.col("well") == injector_well).select("day", F.col("water").alias("injected"))
    return d.join(injector, "day", "left").select("well", "t", "oil", F.coalesce("injected", F.lit(0.0)).alias("injected"))


@query(
    "job_matrix",
    R
    + """ SELECT row_number() OVER (ORDER BY a, h, w) AS job_id, a, h, w, CAST(NULL AS DOUBLE) AS smape, 'pending' AS status
FROM (SELECT DISTINCT architecture_id AS a FROM r), (SELECT DISTINCT hyperparam_id AS h FROM r), (SELECT DISTINCT well AS w FROM r)""",
)
def job_matrix(spark, sf):
    """All combinations of three lists of names; a job's number follows from its places in them."""
    names = [F.array_sort(F.collect_set(c)).alias(n) for c, n in (("architecture_id", "as"), ("hyperparam_id", "hs"), ("well", "ws"))]
    grid = runs(spark, sf).agg(*names)
    for c in "ahw":
        grid = grid.select("*", F.posexplode(f"{c}s").alias(f"i{c}", c))
    number = (F.col("ia") * F.size("hs") + F.col("ih")) * F.size("ws") + F.col("iw") + 1
    return grid.select(number.cast("long").alias("job_id"), "a", "h", "w", F.lit(None).cast("double").alias("smape"), F.lit("pending").alias("status"))


@query("prep_signature", R + """ SELECT well, sha256('{"architecture_id":"' || architecture_id || '","hyperparam_id":"' || hyperparam_id || '"}') AS signature, count(*) AS n FROM r GROUP BY ALL""")
def prep_signature(spark, sf):
    r = runs(spark, sf).withColumn("signature", F.sha2(F.to_json(F.struct("architecture_id", "hyperparam_id")), 256))
    return r.groupBy("well", "signature").agg(F.count(F.lit(1)).alias("n"))


_NAME = "translate(well, ' ', '_') || '_w' || CAST(n % 9 + 1 AS VARCHAR) || '_h' || CAST(n % 5 AS VARCHAR)"


@query("parse_run_name", R + 
    f" SELECT job_id, replace(regexp_extract({_NAME}, '^(.*)_w([0-9]+)_h([0-9]+)$', 1), '_', '/') AS well_name, CAST(regexp_extract({_NAME}, "
    f"'_w([0-9]+)_h', 1) AS INTEGER) AS win, CAST(regexp_extract({_NAME}, '_h([0-9]+)$', 1) AS INTEGER) AS hor FROM "
    f"r")
def parse_run_name(spark, sf):
    r = runs(spark, sf).withColumn("f", F.concat(F.translate("well", " ", "_"), F.lit("_w"), (F.col("n") % 9 + 1).cast("string"), F.lit("_h"), (F.col("n") % 5).cast("string")))
    part = lambda i: F.regexp_extract("f", r"^(.*)_w([0-9]+)_h([0-9]+)$", i)
    return r.select("job_id", F.translate(part(1), "_", "/").alias("well_name"), part(2).cast("int").alias("win"), part(3).cast("int").alias("hor"))


@query("log_metrics", R + 
    " SELECT architecture_id, well, smape, mae FROM (SELECT *, row_number() OVER (PARTITION BY architecture_id, well "
    "ORDER BY hyperparam_id DESC) AS k FROM r) WHERE k = 1")
def log_metrics(spark, sf):
    """Metric lines of a run's log belong to the next header; a later line overwrites."""
    line = F.concat(F.lit("SMAPE on the test set: "), F.col("smape").cast("string"), F.lit("%\nMAE on the test set: "), F.col("mae").cast("string"), F.lit("\n"))
    by_well = runs(spark, sf).groupBy("architecture_id", "well").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("hyperparam_id", line.alias("line")))), lambda x: x["line"]), "").alias("part"))
    section = F.concat("part", F.lit("Metrics per Well ("), "well", F.lit("):\n"))
    logs = by_well.groupBy("architecture_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("well", section.alias("s")))), lambda x: x["s"]), "").alias("log"))
    head = F.regexp_extract_all("log", F.lit(r"Metrics per Well \(([^)]*)\):"), F.lit(1))
    parts = logs.select("architecture_id", F.posexplode(F.arrays_zip(head.alias("well"), F.slice(F.split("log", r"Metrics per Well \([^)]*\):\n"), F.lit(1), F.size(head)).alias("body"))).alias("i", "x"))
    last = lambda p: F.element_at(F.regexp_extract_all("x.body", F.lit(p), F.lit(1)), -1).cast("double")
    return parts.select("architecture_id", "x.well", last(r"SMAPE on the test set: ([-0-9.E]+)%").alias("smape"), last(r"(?m)^MAE on the test set: ([-0-9.E]+)$").alias("mae"))


@query("walk_forward_folds", D + 
    " SELECT f.well, f.t AS fold, count(*) AS n, min(a.t) AS first_anchor, max(a.t) AS last_anchor FROM d f JOIN d "
    "a ON a.well = f.well AND a.t BETWEEN f.t - 199 AND f.t - 56 WHERE f.t >= 206 GROUP BY 1, 2")
def walk_forward_folds(spark, sf):
    from ..operators.features import walk_forward_folds as folds

    return folds(daily_rates(spark, sf)).groupBy("well", "fold").agg(F.count(F.lit(1)).alias("n"), F.min("anchor").alias("first_anchor"), F.max("anchor").alias("last_anchor"))


@query(
    "leak_check",
    D
    + """, n AS (SELECT well, t, count(*) OVER (PARTITION BY well) - floor(count(*) OVER (PARTITION BY well) * 0.2) AS last FROM d),
both_ AS (SELECT well, t FROM n WHERE t <= last INTERSECT SELECT well, t FROM n WHERE t > last - 6)
SELECT well, count(*) AS n FROM both_ GROUP BY well""",
)
def leak_check(spark, sf):
    """Rows of each well that both training and the windows of the test rows use."""
    from ..operators.features import chrono_split

    d = chrono_split(daily_rates(spark, sf), 0.2)
    train = d.filter("side = 'train'").select("well", "t")
    used = d.filter("side = 'test'").select("well", F.explode(F.sequence(F.col("t") - 6, F.col("t"))).alias("t")).distinct()
    return train.intersect(used).groupBy("well").agg(F.count(F.lit(1)).alias("n"))


@query("drop_finished_wells", D + " SELECT DISTINCT well FROM d WHERE well NOT IN (SELECT well FROM d GROUP BY well HAVING count(*) < 1000)")
def drop_finished_wells(spark, sf):
    d = daily_rates(spark, sf)
    finished = d.groupBy("well").agg(F.count(F.lit(1)).alias("n")).filter("n < 1000")
    return d.select("well").distinct().join(finished, "well", "left_anti")


@query("wells_by_size", D + " SELECT well, count(*) AS n, max(count(*)) OVER () AS longest FROM d GROUP BY well")
def wells_by_size(spark, sf):
    from pyspark.sql import Window

    n = daily_rates(spark, sf).groupBy("well").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("longest", F.max("n").over(Window.partitionBy()))


@query("describe", D + 
    " SELECT well, count(whp) AS n, round(avg(whp), 6) AS mean, round(stddev_samp(whp), 6) AS std, min(whp) AS lo, "
    "quantile_cont(whp, 0.25) AS q1, median(whp) AS mid, quantile_cont(whp, 0.75) AS q3, max(whp) AS hi FROM d GROUP "
    "BY well")
def describe(spark, sf):
    d = daily_rates(spark, sf)
    out = d.groupBy("well").agg(F.count("whp").alias("n"), F.avg("whp").alias("mean"), F.stddev_samp("whp").alias("std"), F.min("whp").alias("lo"), F.max("whp").alias("hi"))
    return rounded(out.join(quantiles(d, ["well"], "whp", {"q1": 0.25, "mid": 0.5, "q3": 0.75}), "well"), "mean", "std")
