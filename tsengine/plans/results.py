"""Queries: experiment results, rankings, tests, attributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators.ranking import quantiles, spearman
from .daily import daily_rates, read, runs
from .registry import D, R, mean, mean_sql, query, rounded

KEYS = ["architecture_id", "hyperparam_id"]
_BOARD = f", b AS (SELECT architecture_id, hyperparam_id, {mean_sql('smape')} AS m FROM r GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (ORDER BY m, architecture_id, hyperparam_id) AS rank FROM b)"


@query("leaderboard", R + _BOARD + " SELECT architecture_id, hyperparam_id, round(m, 6) AS mean_smape, rank FROM k")
def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    r = runs(spark, sf)
    jobs = r.select("job_id", *KEYS)
    return rounded(M.leaderboard(jobs.join(r.select("job_id", "smape"), "job_id"), KEYS), "mean_smape").withColumn("rank", F.col("rank").cast("long"))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
#: A label for each architecture.
LABELS = dict(zip(SEGMENTS, ("GRU", "Conv", "Transformer", "Dense", "BiLSTM")))


@query("label_lookup", R + _BOARD + " SELECT architecture_id, CASE architecture_id " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items()) + " END AS label, rank FROM k")
def label_lookup(spark, sf):
    names = spark.createDataFrame(list(LABELS.items()), "architecture_id string, label string")
    board = M.leaderboard(runs(spark, sf), KEYS)
    return board.join(F.broadcast(names), "architecture_id", "left").select("architecture_id", "label", F.col("rank").cast("long").alias("rank"))


@query(
    "leaderboard_pivot",
    R + " SELECT hyperparam_id, " + ", ".join(f"round({mean_sql('smape', f"architecture_id = '{a}'")}, 9) AS \"{a}\"" for a in SEGMENTS) + " FROM r GROUP BY 1",
)
def leaderboard_pivot(spark, sf, names=tuple(SEGMENTS)):
    return rounded(runs(spark, sf).groupBy("hyperparam_id").pivot("architecture_id", list(names)).agg(mean("smape")), *names, digits=9)


@query(
    "sensitivity_pivot",
    R + " SELECT win, " + ", ".join(f"round({mean_sql('smape', f'hor = {h}')}, 6) AS h{h}" for h in (0, 1, 2)) + " FROM (SELECT *, n % 4 AS win, n % 3 AS hor FROM r) GROUP BY 1",
)
def sensitivity_pivot(spark, sf):
    """Window sizes by horizons; the horizons are those that occur."""
    r = runs(spark, sf).withColumns({"win": F.col("n") % 4, "hor": F.concat(F.lit("h"), F.col("n") % 3)})
    out = r.groupBy("win").pivot("hor").agg(mean("smape"))
    return rounded(out, *[c for c in out.columns if c != "win"])


@query("drilldown", R + 
    f" SELECT architecture_id, well, round({mean_sql('smape')}, 9) AS smape, round({mean_sql('mae')}, 9) AS mae, count(*) AS n "
    "FROM r GROUP BY ROLLUP (architecture_id, well)")
def drilldown(spark, sf):
    return rounded(runs(spark, sf).rollup("architecture_id", "well").agg(mean("smape").alias("smape"), mean("mae").alias("mae"), F.count(F.lit(1)).alias("n")), "smape", "mae", digits=9)


@query("best_cell", R + _BOARD + 
    " SELECT arg_min(architecture_id, m) AS architecture_id, arg_min(hyperparam_id, m) AS hyperparam_id, round(min(m), "
    "6) AS best, round(median(m), 6) AS middle FROM k")
def best_cell(spark, sf):
    b = runs(spark, sf).groupBy(*KEYS).agg(mean("smape").alias("m"))
    best = b.agg(*[F.min_by(k, "m").alias(k) for k in KEYS], F.min("m").alias("best"))
    return rounded(best.join(quantiles(b, [], "m", {"middle": 0.5})), "best", "middle")  # one row each


@query("category_stats", R + 
    " SELECT category, split_part(category, ' ', 1) AS base, count(*) AS n, " + f"round({mean_sql('smape')}, 9) AS mean_smape, round(stddev_samp(smape), 9) AS std_smape, round({mean_sql('r2')}, 9) AS mean_r2 FROM r GROUP BY category")
def category_stats(spark, sf):
    g = runs(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("n"), mean("smape").alias("mean_smape"), F.stddev_samp("smape").alias("std_smape"), mean("r2").alias("mean_r2"))
    return rounded(g.withColumn("base", F.split_part("category", F.lit(" "), F.lit(1))), "mean_smape", "std_smape", "mean_r2", digits=9)


_CAT = f", c AS (SELECT architecture_id AS g, hyperparam_id AS h, {mean_sql('r2')} AS r2, {mean_sql('smape')} AS smape, {mean_sql('mae')} AS mae FROM r GROUP BY 1, 2)"


@query("composite_rank", R + _CAT + 
    ", x AS (SELECT g, h, round(0.3 * CASE WHEN max(r2) OVER w = min(r2) OVER w THEN 0.5 ELSE (r2 - min(r2) OVER w) "
    "/ (max(r2) OVER w - min(r2) OVER w) END + 0.5 * CASE WHEN max(smape) OVER w = min(smape) OVER w THEN 0.5 ELSE "
    "(max(smape) OVER w - smape) / (max(smape) OVER w - min(smape) OVER w) END + 0.2 * CASE WHEN max(mae) OVER w = "
    "min(mae) OVER w THEN 0.5 ELSE (max(mae) OVER w - mae) / (max(mae) OVER w - min(mae) OVER w) END, 9) AS score FROM "
    "c WINDOW w AS (PARTITION BY g)) SELECT g, h, round(score, 6) AS score, row_number() OVER (PARTITION BY g ORDER "
    "BY score DESC, h) AS rank FROM x")
def composite_rank(spark, sf):
    c = runs(spark, sf).groupBy(F.col("architecture_id").alias("g"), F.col("hyperparam_id").alias("h")).agg(*[mean(m).alias(m) for m in ("r2", "smape", "mae")])
    out = M.composite_rank(c, "g", "h", {"r2": 0.3, "smape": 0.5, "mae": 0.2}, {"r2"})
    return rounded(out.select("g", "h", "score", F.col("rank").cast("long").alias("rank")), "score")


@query("welch_t", R + 
    ", s AS (SELECT avg(smape) FILTER (WHERE a) AS m0, avg(smape) FILTER (WHERE b) AS m1, var_samp(smape) FILTER (WHERE "
    "a) / count(smape) FILTER (WHERE a) AS e0, var_samp(smape) FILTER (WHERE b) / count(smape) FILTER (WHERE b) AS "
    "e1, count(smape) FILTER (WHERE a) AS n0, count(smape) FILTER (WHERE b) AS n1 FROM (SELECT smape, architecture_id "
    "= 'BUILDING' AS a, architecture_id = 'MACHINERY' AS b FROM r)) SELECT round((m0 - m1) / sqrt(e0 + e1), 6) AS t, "
    "round(power(e0 + e1, 2) / (power(e0, 2) / (n0 - 1) + power(e1, 2) / (n1 - 1)), 4) AS dof FROM s")
def welch_t(spark, sf):
    return rounded(rounded(M.welch_t(runs(spark, sf), "architecture_id", "BUILDING", "MACHINERY", "smape"), "t"), "dof", digits=4)


@query("merge_val_test", R + 
    ", v AS (SELECT architecture_id, hyperparam_id, well, smape AS smape_val FROM r WHERE n % 3 <> 0), t AS (SELECT "
    "architecture_id, hyperparam_id, well, mae AS smape_test FROM r WHERE n % 4 <> 0) SELECT coalesce(v.architecture_id, "
    "t.architecture_id) AS architecture_id, coalesce(v.hyperparam_id, t.hyperparam_id) AS hyperparam_id, coalesce(v.well, "
    "t.well) AS well, smape_val, smape_test FROM v FULL JOIN t ON v.architecture_id = t.architecture_id AND v.hyperparam_id "
    "= t.hyperparam_id AND v.well = t.well")
def merge_val_test(spark, sf):
    r = runs(spark, sf)
    cols = [*KEYS, "well"]
    return M.merge_val_test(r.filter("n % 3 <> 0").select(*cols, "smape"), r.filter("n % 4 <> 0").select(*cols, F.col("mae").alias("smape")), ["smape"])


@query("topn_detail", R + _BOARD + 
    f" SELECT r.architecture_id, r.hyperparam_id, round({mean_sql('smape')}, 6) AS mean_smape, count(*) AS n FROM r JOIN k ON "
    "r.architecture_id = k.architecture_id AND r.hyperparam_id = k.hyperparam_id WHERE k.rank <= 5 GROUP BY 1, 2")
def topn_detail(spark, sf):
    r = runs(spark, sf)
    top = M.leaderboard(r, KEYS).filter("rank <= 5")
    return rounded(r.join(top, KEYS, "left_semi").groupBy(*KEYS).agg(mean("smape").alias("mean_smape"), F.count(F.lit(1)).alias("n")), "mean_smape")


@query("top10_by_smape", R + " SELECT job_id, smape FROM r ORDER BY smape, job_id LIMIT 10")
def top10_by_smape(spark, sf):
    return runs(spark, sf).select("job_id", "smape").orderBy("smape", "job_id").limit(10)


@query(
    "ordered_results",
    R
    + """ SELECT well, smape, architecture_id,
 row_number() OVER (ORDER BY list_position(['MACHINERY', 'BUILDING'], architecture_id) NULLS LAST, architecture_id, well, job_id) AS place FROM r""",
)
def ordered_results(spark, sf):
    """Listed architectures first, in the list's order, then the others by name."""
    listed = F.array(F.lit("MACHINERY"), F.lit("BUILDING"))
    first = F.nullif(F.array_position(listed, F.col("architecture_id")), F.lit(0))
    out = M.place(runs(spark, sf), [first, F.col("architecture_id"), F.col("well")], [F.col("job_id")])
    return out.select("well", "smape", "architecture_id", "place")


@query("topn_per_group", R + 
    " SELECT architecture_id, job_id, smape FROM (SELECT *, row_number() OVER (PARTITION BY architecture_id ORDER BY "
    "smape, job_id) AS k FROM r) WHERE k <= 3")
def topn_per_group(spark, sf):
    k = F.row_number().over(Window.partitionBy("architecture_id").orderBy("smape", "job_id"))
    return runs(spark, sf).withColumn("k", k).filter("k <= 3").select("architecture_id", "job_id", "smape")


@query("union_metrics", R + 
    " SELECT job_id, smape, coalesce(mae, 0) AS mae, coalesce(kind, 'global') AS kind FROM (SELECT job_id, smape, NULL::DOUBLE "
    "AS mae, NULL AS kind FROM r WHERE n % 2 = 0 UNION ALL SELECT job_id, smape, mae, 'slice' FROM r WHERE n % 2 = "
    "1)")
def union_metrics(spark, sf):
    r = runs(spark, sf)
    a, b = r.filter("n % 2 = 0").select("job_id", "smape"), r.filter("n % 2 = 1").select("job_id", "smape", "mae", F.lit("slice").alias("kind"))
    return a.unionByName(b, allowMissingColumns=True).na.fill({"mae": 0.0, "kind": "global"})


@query("top_correlations", D + 
    " SELECT feature, round(r, 6) AS r FROM (SELECT 'gas' AS feature, corr(oil, gas) AS r FROM d UNION ALL SELECT 'water', "
    "corr(oil, water) FROM d UNION ALL SELECT 'downhole', corr(oil, downhole) FROM d UNION ALL SELECT 'choke', corr(oil, "
    "choke) FROM d) ORDER BY abs(r) DESC LIMIT 3")
def top_correlations(spark, sf):
    names = ["gas", "water", "downhole", "choke"]
    wide = daily_rates(spark, sf).agg(*[F.corr("oil", c).alias(c) for c in names])
    long = wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("r")) for c in names])))
    return rounded(long.orderBy(F.desc(F.abs("r"))).limit(3), "r")


# Attributions: feature = position in a vector, iteration = label.
_A = """WITH a AS (SELECT label AS iteration, CAST(k - 1 AS INTEGER) AS feature, vec_id, CAST(embedding[k] AS DOUBLE) AS x, CAST(embedding[k] AS DOUBLE) * (label - 4.5) + (vec_id % 7) * 0.01 AS phi FROM embeddings, (SELECT unnest(range(1, 65)) AS k)),
s AS (SELECT iteration, feature, round(avg(abs(phi)), 9) AS strength FROM a GROUP BY 1, 2),
q AS (SELECT *, strength / sum(strength) OVER (PARTITION BY iteration) AS share, rank() OVER (PARTITION BY iteration ORDER BY strength DESC) AS rank FROM s)"""


def attributions(spark, sf) -> DataFrame:
    e = read(spark, sf, "embeddings")
    long = e.select(F.col("label").alias("iteration"), "vec_id", F.posexplode("embedding").alias("feature", "v"))
    x = F.col("v").cast("double")
    return long.select("iteration", "feature", "vec_id", x.alias("x"), (x * (F.col("iteration") - 4.5) + (F.col("vec_id") % 7) * 0.01).alias("phi"))


def _report(spark, sf) -> DataFrame:
    s = attributions(spark, sf).groupBy("iteration", "feature").agg(F.round(F.avg(F.abs("phi")), 9).alias("strength"))
    w = Window.partitionBy("iteration")
    return s.select("*", (F.col("strength") / F.sum("strength").over(w)).alias("share"), F.rank().over(w.orderBy(F.desc("strength"))).cast("long").alias("rank"))


@query("attr_report", _A + " SELECT iteration, feature, round(strength, 6) AS strength, round(share, 6) AS share, rank FROM q")
def attr_report(spark, sf):
    return rounded(_report(spark, sf), "strength", "share")


_GINI = "1 - 2.0 / count(*) * (1 - (min(share) + max(share)) / 2)"


@query("attr_gini", _A + f" SELECT iteration, round({_GINI}, 6) AS gini FROM q GROUP BY 1")
def attr_gini(spark, sf):
    gini = M.concentration("share")
    return rounded(_report(spark, sf).groupBy("iteration").agg(gini.alias("gini")), "gini")


@query("attr_stability", _A + 
    " SELECT b.iteration, round(corr(a.rank, b.rank), 6) AS rho FROM q a JOIN q b ON a.feature = b.feature AND a.iteration "
    "= b.iteration - 1 GROUP BY 1")
def attr_stability(spark, sf):
    q = _report(spark, sf).select("iteration", "feature", "rank")
    prev = q.select((F.col("iteration") + 1).alias("iteration"), "feature", F.col("rank").alias("before"))
    return rounded(q.join(prev, ["iteration", "feature"]).groupBy("iteration").agg(F.corr("rank", "before").alias("rho")), "rho")


@query("attr_direction", _A + 
    ", k AS (SELECT iteration, feature, rank() OVER x + (count(*) OVER y - 1) / 2.0 AS rx, rank() OVER p + (count(*) "
    "OVER o - 1) / 2.0 AS rp FROM a WINDOW x AS (PARTITION BY iteration, feature ORDER BY x), y AS (PARTITION BY iteration, "
    "feature, x), p AS (PARTITION BY iteration, feature ORDER BY phi), o AS (PARTITION BY iteration, feature, phi)) "
    "SELECT iteration, feature, CASE WHEN corr(rx, rp) >= 0 THEN 'up' ELSE 'down' END AS direction, round(corr(rx, "
    "rp), 4) AS rho FROM k GROUP BY 1, 2")
def attr_direction(spark, sf):
    g = spearman(attributions(spark, sf), ["iteration", "feature"], "x", "phi", "rho")
    return rounded(g.withColumn("direction", F.when(F.col("rho") >= 0, "up").otherwise("down")), "rho", digits=4)


@query(
    "attr_summary",
    _A
    + f""", g AS (SELECT iteration, {_GINI} AS gini FROM q GROUP BY 1),
rho AS (SELECT b.iteration, corr(a.rank, b.rank) AS rho FROM q a JOIN q b ON a.feature = b.feature AND a.iteration = b.iteration - 1 GROUP BY 1),
dir AS (SELECT feature, avg(phi) AS mean_phi, avg(abs(phi)) AS strength FROM a GROUP BY 1)
SELECT (SELECT array_to_string(list(feature ORDER BY round(strength, 9) DESC, feature)[1:5], ',') FROM dir) AS top,
       round((SELECT min(rho) FROM rho), 6) AS least_rho, (SELECT min(rho) >= 0.9 FROM rho) AS stable,
       round((SELECT arg_max(gini, iteration) - arg_min(gini, iteration) FROM g), 6) AS gini_change,
       (SELECT count(*) FILTER (WHERE round(mean_phi, 9) > 0) FROM dir) AS positive, (SELECT count(*) FILTER (WHERE round(mean_phi, 9) < 0) FROM dir) AS negative""",
)
def attr_summary(spark, sf):
    """Over all iterations: the most influential features, whether their order is stable, how far
    the gini moved, and how many features drive the outcome up and down."""
    q = _report(spark, sf).select("iteration", "feature", "rank", "share")
    gini = M.concentration("share")
    change = q.groupBy("iteration").agg(gini.alias("gini")).agg((F.max_by("gini", "iteration") - F.min_by("gini", "iteration")).alias("gini_change"))
    before = q.select((F.col("iteration") + 1).alias("iteration"), "feature", F.col("rank").alias("before"))
    rho = q.join(before, ["iteration", "feature"]).groupBy("iteration").agg(F.corr("rank", "before").alias("rho")).agg(F.min("rho").alias("least_rho"))
    each = attributions(spark, sf).groupBy("feature").agg(F.round(F.avg("phi"), 9).alias("mean_phi"), F.round(F.avg(F.abs("phi")), 9).alias("strength"))
    order = F.sort_array(F.collect_list(F.struct((-F.col("strength")).alias("s"), "feature")))
    names = F.array_join(F.transform(F.slice(order, 1, 5), lambda x: x["feature"].cast("string")), ",")
    drivers = each.agg(names.alias("top"), F.count_if(F.col("mean_phi") > 0).alias("positive"), F.count_if(F.col("mean_phi") < 0).alias("negative"))
    one = lambda df: df.withColumn("_one", F.lit(1))  # noqa: E731  three single rows
    out = one(drivers).join(one(rho), "_one").join(one(change), "_one").drop("_one")
    return rounded(out.withColumn("stable", F.col("least_rho") >= 0.9), "least_rho", "gini_change")


@query("attr_longitudinal", _A + 
    f", g AS (SELECT iteration, {_GINI} AS gini, arg_min(feature, rank * 1000 + feature) AS top FROM q GROUP BY 1) SELECT "
    f"arg_min(top, iteration) AS first_top, arg_max(top, iteration) AS last_top, round(arg_min(gini, iteration), 6) "
    f"AS first_gini, round(arg_max(gini, iteration), 6) AS last_gini FROM g")
def attr_longitudinal(spark, sf):
    gini = M.concentration("share")
    g = _report(spark, sf).groupBy("iteration").agg(gini.alias("gini"), F.min_by("feature", F.col("rank") * 1000 + F.col("feature")).alias("top"))
    out = g.agg(F.min_by("top", "iteration").alias("first_top"), F.max_by("top", "iteration").alias("last_top"), F.min_by("gini", "iteration").alias("first_gini"), F.max_by("gini", "iteration").alias("last_gini"))
    return rounded(out, "first_gini", "last_gini")
