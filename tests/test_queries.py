"""Registered queries against DuckDB on the smallest tables, and small known cases."""

import math
import os
from decimal import Decimal

import duckdb
import numpy as np
import pytest

from tsengine.functions.units import decline
from tsengine.operators import clean, features, metrics, models
from tsengine.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def norm(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    key = lambda row: tuple((v is None, str(v)) for v in row)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=key)
    sql = f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({ORACLE_SQL[name]})"
    assert got == sorted((tuple(map(norm, r)) for r in db.execute(sql).fetchall()), key=key)


def test_causal_impute_known_case(spark):
    values = [None, 1.0, None, None, None, None, None, 9.0, None]
    df = spark.createDataFrame([("w", i + 1, v) for i, v in enumerate(values)], "well string, t int, v double")
    got = [r.f for r in clean.causal_impute(df, "v", "f").orderBy("t").collect()]
    assert got[0] is None
    assert np.allclose(got[1:], [1, 1, 1, 1, 11 / 3, 19 / 3, 9, 9])


@pytest.mark.parametrize("n, expected", [(1135, 1099), (1701, 1665)])
def test_number_of_windows(spark, n, expected):
    df = spark.range(1, n + 1).selectExpr("'w' AS well", "cast(id AS int) AS t", "cast(id AS double) AS oil")
    assert features.seq_windows(df, ["oil"], "oil", 7, 30).count() == expected


def test_poly_trend_fits_every_window(spark):
    ids = lambda name: sorted((r.well, r.window_id) for r in QUERIES[name](spark, SF).select("well", "window_id").collect())
    assert ids("poly_trend") == ids("window_context")


def test_fold_of_205(spark):
    df = spark.range(1, 301).selectExpr("'w' AS well", "cast(id AS int) AS t")
    anchors = [r.anchor for r in features.walk_forward_folds(df).filter("fold = 206").collect()]
    assert len(anchors) == 144 and max(anchors) + 56 <= 206


def test_published_leaderboard(spark):
    """Published mean SMAPEs in order of rank (architecture, parameters, mean)."""
    board = """
    Model2_2xConv hp_medium_balanced 0.6764, Model2_2xConv hp_stable_regularized 0.6833, Model2_2xConv hp_small_fast 0.6905,
    Model2_2xConv hp_large_robust 0.6951, Model2_2xConv hp_wide_and_shallow 0.7031, Model4_Transformer_BiLSTM hp_medium_balanced 0.7144,
    Model4_Transformer_BiLSTM hp_large_robust 0.7317, Model4_Transformer_BiLSTM hp_wide_and_shallow 0.7535, Model4_Transformer_BiLSTM hp_small_fast 0.7567,
    Model5_Transformer_2xConv hp_small_fast 0.7619, Model5_Transformer_2xConv hp_medium_balanced 0.7648, Model5_Transformer_2xConv hp_large_robust 0.7669"""
    rows = [x.split() for x in board.replace("\n", " ").split(",")]
    # Two wells each, whose mean is the published one, in another order.
    runs = [(a, h, float(m) + d) for a, h, m in reversed(rows) for d in (0.1, -0.1)]
    got = metrics.leaderboard(spark.createDataFrame(runs, "architecture_id string, hyperparam_id string, smape double"), ["architecture_id", "hyperparam_id"]).orderBy("rank").collect()
    assert [(r.architecture_id, r.hyperparam_id, round(r.mean_smape, 4), r["rank"]) for r in got] == [(a, h, float(m), i + 1) for i, (a, h, m) in enumerate(rows)]


def test_published_means(spark):
    """Published MAE and SMAPE of each well with filtered data, and their means."""
    mae = [17726.9053, 16386.5034, 12812.5637, 2119.3548, 5023.2735, 4222.1757, 4302.1665, 6788.1031, 4534.5577, 3909.5242, 3792.7705, 3284.52, 3058.8728, 4804.3128, 123718.0812, 24928.7346, 52207.5184]
    smape = [2.8679, 0.7292, 0.7035, 2.1713, 0.2776, 0.1225, 0.2053, 0.3791, 0.171, 0.1162, 0.1532, 0.1531, 0.1727, 0.2181, 0.2256, 2.5666, 0.9659]
    df = spark.createDataFrame(list(zip(mae, smape)), "mae double, smape double").repartition(4)
    got = df.agg(metrics.exact_mean("mae").alias("mae"), metrics.exact_mean("smape").alias("smape")).first()
    assert round(got.mae, 6) == 17271.761071 and round(got.smape, 6) == 0.717576


def test_search_query_leaves_nothing_out(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(models, "gbt_search", lambda windows, grid, **limits: calls.append((windows, limits)))
    QUERIES["gbt_search"](spark, SF)
    [(windows, limits)] = calls
    want = features.chrono_split(QUERIES["window_dataset"](spark, SF), 0.2)
    assert not limits and windows.filter("side = 'train'").count() == want.filter("side = 'train'").count() > 0


def test_unknown_names_are_errors():
    with pytest.raises(ValueError):
        decline("nothing", None, None, None, None)
