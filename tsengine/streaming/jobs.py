"""Structured Streaming versions of the daily loop: buffers, online filters, refits, decimation.

Each job reads a table as a stream until it ends (availableNow), writes its output as
Parquet below the shared folder, and returns what was written.

Late rows: rows are taken in order of (ts, event_id). A row waits in state until the watermark,
`late` behind the newest row so far, has passed it; one that comes for a time that the
watermark has passed already is dropped (the engine's watermark begins at 1970)."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import shared_folder
from .state import InOrder, Kalman, Lags, Refit, Scores, Work

#: Files of a micro-batch: bounds what is sorted at once.
FILES = 4


def _stream(spark: SparkSession, path: str, files: int = FILES) -> DataFrame:
    """The files of the table at `path`, one file or a folder of them, as a stream."""
    table = spark.read.parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    one = all(f.rstrip("/").endswith(f"/{name}") for f in table.inputFiles())
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", name if one else "*.parquet")
    return stream.parquet(folder if one else path)


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB, on the executors' disks with a copy in the checkpoint, for what starts here."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _run(df: DataFrame, out: str) -> None:
    with _rocksdb(df.sparkSession):
        q = df.writeStream.outputMode("append").format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()


class Closing:
    """A stream with an end: one more row, of a time after all others, which closes what waits for
    the watermark. Its own key is null, and it is never passed itself."""

    def __init__(self, spark: SparkSession, like: DataFrame, out: str):
        values = {"ts": F.lit("2250-01-01").cast("timestamp")}
        row = spark.range(1).select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema])
        self.row, self.folder = row, f"{out}/closing"
        row.filter("false").write.parquet(f"{self.folder}/none")
        self.stream = lambda: like.unionByName(spark.readStream.schema(row.schema).parquet(f"{self.folder}/*"))

    def close(self) -> None:
        self.row.write.parquet(f"{self.folder}/last")


def tumbling_first(spark: SparkSession, path: str, width: str = "12 hours", late: str = "1 day") -> DataFrame:
    """Rows and first time of each window of `width`. Windows close `late` behind the newest row,
    and what comes for a closed window is dropped, so that only open windows are state. When the
    stream has ended, a row of a time after all others closes the last windows; its own never
    closes."""
    out = shared_folder(spark)
    closing = Closing(spark, _stream(spark, path).select("event_type", F.col("ts").cast("timestamp").alias("ts")), out)
    both = closing.stream().withWatermark("ts", late)
    agg = both.groupBy("event_type", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"))
    flat = agg.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"))
    _run(flat, out)
    closing.close()
    _run(flat, out)  # goes on from the checkpoint
    return spark.read.schema(flat.schema).parquet(f"{out}/data")


def _events(spark: SparkSession, path: str, files: int) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return _stream(spark, path, files).select("event_type", "event_id", ts.alias("ts"), F.unix_micros(ts).alias("at"), F.col("value").cast("double").alias("value"))


def _stateful(rows: DataFrame, work: Work) -> DataFrame:
    """`work` over the rows of each event_type in order of time (see InOrder)."""
    return rows.groupBy("event_type").transformWithStateInPandas(statefulProcessor=InOrder(work), outputStructType=work.schema, outputMode="Append", timeMode="EventTime")


def in_order(events: DataFrame, work: Work, out: str, late: str) -> DataFrame:
    """`work` over the rows of each event_type in order of time: its columns for each row. Stateful
    in the engine: rows that wait and what `work` carries on are maps and values in RocksDB,
    timers are by event time, and keys silent for work.ttl_days are forgotten."""
    closing = Closing(events.sparkSession, events, out)

    done = lambda: _stateful(closing.stream().withWatermark("ts", late), work)
    _run(done(), out)
    closing.close()
    _run(done(), out)
    return events.sparkSession.read.schema(work.schema).parquet(f"{out}/data")


def online_kalman(spark: SparkSession, path: str, q: float = 1e-4, r: float = 1e-3, files: int = FILES, late: str = "1 day") -> DataFrame:
    """event_type, k and x, the local-level filter's state after row k."""
    return in_order(_events(spark, path, files), Kalman(q, r), shared_folder(spark), late)


def rolling_buffer(spark: SparkSession, path: str, window: int, files: int = FILES, late: str = "1 day") -> DataFrame:
    """From the window-th row of a key on, each new row gives the sum of the last `window` values,
    these values as lags, newest first, and the running total."""
    return in_order(_events(spark, path, files), Lags(window), shared_folder(spark), late).select("event_type", "k", "total", "running", "lags")


def online_refit(spark: SparkSession, path: str, length: int = 60, window: int = 3, horizon: int = 5, files: int = FILES, late: str = "1 day") -> DataFrame:
    """Each new row refits the linear model on the last anchors whose labels are known, and
    forecasts `horizon` rows ahead: event_type, k, forecast."""
    return in_order(_events(spark, path, files), Refit(length, window, horizon), shared_folder(spark), late)


def running_metrics(spark: SparkSession, path: str, window: int = 7, horizon: int = 5, files: int = FILES, late: str = "1 day", delay: str = "365 days") -> DataFrame:
    """Each new value is the truth of the forecast that was made `horizon` rows before, the mean of
    the `window` values up to there: event_type, k, n (forecasts judged so far), and of these
    r2, smape and mae.

    A forecast waits for its truth in the state of the step that made it, as the few values and
    times that it needs: both are rows of one key in one order, so that a stream-stream join by
    the row's number would ship and keep every row twice to find what is at hand. A truth that
    comes more than `delay` after its forecast isn't judged."""
    work = Scores(window, horizon, pd.Timedelta(delay) // pd.Timedelta("1us"))
    return in_order(_events(spark, path, files), work, shared_folder(spark), late)
