"""Input series derived from the given tables: one row for each well and step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Daily rates of the wells that order lines stand for; the SQL runs in Spark and DuckDB.
DAILY_RATES = """
SELECT well, day, CAST(row_number() OVER (PARTITION BY well ORDER BY day) AS INT) AS t, oil, gas, water, downhole, whp, choke FROM (
SELECT concat(l_returnflag, '-', l_linestatus) AS well, CAST(l_shipdate AS DATE) AS day,
       CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS oil,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS gas,
       CAST(SUM(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) AS water,
       150.0 + 10.0 * CAST(SUM(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS downhole,
       CAST(CASE WHEN COUNT(*) % 7 = 0 THEN NULL ELSE 20 + COUNT(*) END AS DOUBLE) AS whp,
       CAST(COUNT(*) % 5 AS DOUBLE) AS choke
FROM lineitem GROUP BY 1, 2) g"""

#: The same with a well for each supplier.
MANY_RATES = DAILY_RATES.replace("concat(l_returnflag, '-', l_linestatus)", "CAST(l_suppkey AS VARCHAR(20))")

#: Results of experiments: an architecture, a parameter set and a well each.
RUNS = """
SELECT architecture_id, hyperparam_id, well, n, smape, smape * 1.5 + n % 7 AS mae, 1 - smape / 4 AS r2,
       concat(CASE WHEN n % 3 = 0 THEN 'deep' WHEN n % 3 = 1 THEN 'linear' ELSE 'tree' END, ' ', hyperparam_id) AS category,
       concat(architecture_id, '/', hyperparam_id, '/', well) AS job_id FROM (
SELECT c_mktsegment AS architecture_id, o_orderpriority AS hyperparam_id, n_name AS well, CAST(COUNT(*) AS BIGINT) AS n,
       ROUND(CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) / 100000, 4) AS smape
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY 1, 2, 3) g"""


def daily_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DAILY_RATES.replace("FROM lineitem", "FROM {lineitem}"), lineitem=read(spark, sf_dir, "lineitem"))


def many_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MANY_RATES.replace("FROM lineitem", "FROM {lineitem}"), lineitem=read(spark, sf_dir, "lineitem"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = RUNS
    tables = {t: read(spark, sf_dir, t) for t in ("orders", "customer", "nation")}
    sql = sql.replace("FROM orders JOIN customer", "FROM {orders} orders JOIN {customer} customer").replace("JOIN nation", "JOIN {nation} nation")
    return spark.sql(sql, **tables)
