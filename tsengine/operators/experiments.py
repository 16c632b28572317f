"""Experiments from a table of jobs: each job forecasts one series, may fail alone, and is scored."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import written
from .blocks import carried
from .metrics import merge_val_test, scores

#: Rows of a job's series that one call works on.
BLOCK = 8192

JOB = ["job_id", "well", "model", "window", "horizon", "length"]


def filter_configurations(methods: list[str] | None, level: float = 0.2) -> list[dict]:
    """A configuration for each filter method; without any, the one that filters nothing."""
    if not methods:
        return [{"apply_adaptive_filtering": False, "filter_method": None, "filter_kwargs": {}}]
    return [{"apply_adaptive_filtering": True, "filter_method": m, "filter_kwargs": {"smoothing_level": level}} for m in methods]


def job_queue(spark: SparkSession, *lists: tuple[str, list]) -> DataFrame:
    """Every combination of the named lists, numbered from 1, the last list running fastest. The
    lists are short and named by the caller; combinations are made by Spark."""
    out, number = spark.range(1).select(F.lit(0).cast("long").alias("_n")), 1
    for name, values in lists:
        number *= len(values)
        out = out.select("*", F.posexplode(F.array(*map(F.lit, values))).alias("_at", name)).withColumn("_n", F.col("_n") * len(values) + F.col("_at")).drop("_at")
    return out.select((F.col("_n") + 1).alias("exp_id"), *[name for name, _ in lists])


def _last(z: np.ndarray, window: int, horizon: int, length: int) -> np.ndarray:
    return z


def _mean(z: np.ndarray, window: int, horizon: int, length: int) -> np.ndarray:
    out = np.full(len(z), np.nan)
    if len(z) >= window:
        out[window - 1 :] = np.lib.stride_tricks.sliding_window_view(z, window).mean(1)
    return out


def _linear(z: np.ndarray, window: int, horizon: int, length: int) -> np.ndarray:
    """At each anchor, least squares on the last length - window + 1 anchors with known labels."""
    n, p, span = len(z), window + 1, length - window + 1
    out = np.full(n, np.nan)
    if span < p:
        raise ValueError(f"{span} anchors are too few for {p} numbers")
    if n < length + horizon:
        return out
    x = np.column_stack([np.ones(n - window + 1), np.lib.stride_tricks.sliding_window_view(z, window)[:, ::-1]])
    label = z[window - 1 + horizon :]
    sums = lambda a: np.concatenate([np.zeros((1, *a.shape[1:])), np.cumsum(a, 0)])
    m = len(label)
    gram, right = sums(x[:m, :, None] * x[:m, None, :]), sums(x[:m] * label[:, None])
    last = np.arange(span, m + 1)  # frames of anchors last - span .. last - 1
    g, r = gram[last] - gram[last - span], right[last] - right[last - span]
    ridge = 1e-9 * np.trace(g, axis1=1, axis2=2)
    beta = np.linalg.solve(g + ridge[:, None, None] * np.eye(p), r[:, :, None])[:, :, 0]
    at = last - 1 + horizon  # row of x of the anchor that forecasts
    out[at + window - 1] = (x[at] * beta).sum(1)
    return out


#: A model gives, for each place of a series, the forecast `horizon` rows ahead, NaN where it has none.
MODELS: dict[str, Callable[[np.ndarray, int, int, int], np.ndarray]] = {"last": _last, "mean": _mean, "linear": _linear}


def _forecast(pdf: pd.DataFrame) -> pd.DataFrame:
    job = pdf.iloc[0]
    if pd.isna(job["t"]):
        raise ValueError(f"no rows for well {job['well']}")
    if job["model"] not in MODELS:
        raise ValueError(f"unknown model {job['model']}")
    for c in ("window", "horizon", "length"):
        if pd.isna(job[c]) or job[c] < 1:
            raise ValueError(f"{c} is not positive")
    window, horizon, length = (int(job[c]) for c in ("window", "horizon", "length"))
    if job["_size"] < length + 2 * horizon:
        raise ValueError(f"{int(job['_size'])} rows are fewer than length + 2 * horizon")
    pdf = pdf.sort_values("t")
    z = pdf["oil"].to_numpy(float)
    pred = np.full(len(z), np.nan)
    pred[horizon:] = MODELS[job["model"]](z, window, horizon, length)[:-horizon]
    keep = pdf["_own"].to_numpy(bool) & ~np.isnan(pred) & ~np.isnan(z) & (pdf["t"].to_numpy() >= length + horizon)
    return pd.DataFrame({"job_id": job["job_id"], "t": pdf["t"].to_numpy()[keep], "truth": z[keep], "pred": pred[keep]})


def _run(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block of one job. Whatever goes wrong is a row, not the end of the others."""
    try:
        return _forecast(pdf).assign(error=None)
    except Exception as e:  # noqa: BLE001  any model may fail in any way
        return pd.DataFrame({"job_id": [pdf["job_id"].iloc[0]], "t": [None], "truth": [None], "pred": [None], "error": [f"{type(e).__name__}: {e}"]})


def run_jobs(jobs: DataFrame, series: DataFrame, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The jobs' statuses (JOB, status, error) and the forecasts (job_id, t, truth, pred) of those
    that succeed.

    `jobs` has the columns JOB, `series` well, t (from 1, without gaps) and oil. A job forecasts row
    t from row t - horizon and what lies before it, from row length + horizon on. Blocks of its
    series are worked on apart, with a halo of length + horizon rows; errors are caught in the
    executors. A job fails as a whole if any block does, and its first message (by order of text)
    is kept. A job of an unknown well, with a null or no positive parameter, or of a series of
    fewer than length + 2 * horizon rows fails; an empty table of jobs has no result."""
    block = block or BLOCK
    sizes = series.groupBy("well").agg(F.count(F.lit(1)).alias("_size"))
    rows = jobs.select(*JOB).join(series.select("well", "t", "oil"), "well", "left").join(sizes, "well", "left")
    number, halo = F.col("t") - 1, F.greatest(F.coalesce(F.col("length") + F.col("horizon"), F.lit(0)), F.lit(0))
    blocks = F.sequence(F.floor(number / block), F.floor((number + halo) / block))
    rows = rows.withColumn("_block", F.explode_outer(blocks)).withColumn("_own", F.floor(number / block) == F.col("_block"))
    rows = rows.filter(F.col("_block").isNull() | (F.col("_block") * block < F.col("_size")))
    kind = dict(jobs.dtypes)["job_id"]
    done = written(rows.groupBy("job_id", "_block").applyInPandas(_run, f"job_id {kind}, t long, truth double, pred double, error string"))
    failed = done.filter("error is not null").groupBy("job_id").agg(F.min("error").alias("error"))
    status = jobs.select(*JOB).join(failed, "job_id", "left")
    status = status.select(*JOB, F.when(F.col("error").isNull(), "success").otherwise("failure").alias("status"), "error")
    return status, done.filter("error is null").join(failed, "job_id", "left_anti").drop("error")


def collate(status: DataFrame, forecasts: DataFrame) -> DataFrame:
    """The successful jobs' metrics: kind `aggregated` over forecasts and `cumulative` over their
    running totals, r2, smape and mae of the earlier half (val) and of the later (test), each
    from its own beginning, merged by job."""
    sizes = forecasts.groupBy("job_id").agg(F.count(F.lit(1)).alias("_n"), F.min("t").alias("_first"))
    halves = forecasts.join(sizes, "job_id").withColumn("half", F.when(F.col("t") - F.col("_first") < F.floor(F.col("_n") / 2), "val").otherwise("test"))
    halves = halves.withColumn("_key", F.concat_ws(":", "half", F.col("job_id").cast("string")))
    total, w, _ = carried(halves, {"_truth": (F.col("truth"), F.sum, False), "_pred": (F.col("pred"), F.sum, False)}, "_key", "t")
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    running = total.select("job_id", "half", *[(F.sum(c).over(past) + F.coalesce(f"_{c}", F.lit(0.0))).alias(c) for c in ("truth", "pred")])
    both = halves.select("job_id", "half", F.lit("aggregated").alias("kind"), "truth", "pred").unionByName(running.withColumn("kind", F.lit("cumulative")))
    scored = scores(both, ["job_id", "kind", "half"])
    val, test = (scored.filter(F.col("half") == h).select("job_id", "kind", "r2", "smape", "mae") for h in ("val", "test"))
    return status.filter("status = 'success'").select(*JOB).join(merge_val_test(val, test, ["r2", "smape", "mae"]), "job_id")
