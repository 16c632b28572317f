"""Readers of series files and writers of result tables."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def number(c: str, decimal_comma: bool = False) -> Column:
    """A text column as double; what isn't a number, or is NaN, becomes null."""
    text = F.regexp_replace(c, ",", ".") if decimal_comma else F.col(c)
    x = F.trim(text).try_cast("double")
    return F.when(~F.isnan(x), x)


def _text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_tab(spark: SparkSession, path: str, columns: list[str], numeric: list[str]) -> DataFrame:
    """A tab-separated table with a header; the expected columns are checked.

    A file whose lines were quoted whole, so that all columns came as one, is split on tabs."""
    header = spark.read.option("header", True).option("sep", "\t").csv(path).columns
    if len(header) == 1 and "\t" in header[0]:
        names = [c.strip() for c in header[0].split("\t")]
        if missing := set(columns) - set(names):
            raise ValueError(f"missing columns: {sorted(missing)}")
        lines = spark.read.option("header", True).option("sep", "\t").schema(_text_schema(["line"])).csv(path)
        parts = F.split("line", "\t")
        df = lines.select(*[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(names)])
        return df.select(*[number(c).alias(c) if c in numeric else F.col(c) for c in columns])
    if missing := set(columns) - set(header):
        raise ValueError(f"missing columns: {sorted(missing)}")
    df = spark.read.option("header", True).option("sep", "\t").schema(_text_schema(header)).csv(path)
    return df.select(*[number(c).alias(c) if c in numeric else F.col(c) for c in columns])


def read_decimal_comma(spark: SparkSession, path: str, columns: list[str], numeric: list[str]) -> DataFrame:
    """A semicolon-separated table whose numbers have a decimal comma."""
    df = spark.read.option("header", True).option("sep", ";").schema(_text_schema(columns)).csv(path)
    return df.select(*[number(c, True).alias(c) if c in numeric else F.col(c) for c in columns])


def read_per_well(spark: SparkSession, path: str, pattern: str, columns: list[str]) -> DataFrame:
    """One file for each well; the well's name is taken from the file's. No file at all is an
    error, as is a file whose header lacks one of the columns."""
    heads = spark.read.option("recursiveFileLookup", True).text(path, wholetext=False).select(F.col("_metadata.file_path").alias("file"), "value", F.col("_metadata.file_block_start").alias("at"))
    heads = heads.filter("at = 0").groupBy("file").agg(F.first("value").alias("head"))
    lacking = heads.filter(~F.forall(F.array(*map(F.lit, columns)), lambda c: F.array_contains(F.transform(F.split("head", ","), F.trim), c)))
    if bad := [r.file for r in lacking.limit(5).collect()]:
        raise ValueError(f"columns {columns} are not all in {bad}")
    df = spark.read.option("header", True).option("recursiveFileLookup", True).schema(_text_schema(columns)).csv(path)
    return df.select(F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).alias("well"), *[number(c).alias(c) for c in columns])


def read_timestamped(spark: SparkSession, path: str, time: str, columns: list[str]) -> DataFrame:
    """A table with a time column; unreadable times are null."""
    df = spark.read.option("header", True).schema(_text_schema([time, *columns])).csv(path)
    return df.select(F.try_to_timestamp(F.col(time)).cast("timestamp_ntz").alias(time), *[number(c).alias(c) for c in columns])


def read_notebook_text(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): the stream outputs of all cells of each notebook below `path`, in sequence,
    joined by newlines. A text may be one string or a list of them; other outputs are left out;
    a file that is no notebook has an empty text."""
    schema = "cells array<struct<outputs: array<struct<output_type: string, text: string>>>>"
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", schema).alias("nb"))
    outputs = F.flatten(F.transform(F.coalesce("nb.cells", F.array().cast("array<struct<outputs:array<struct<output_type:string,text:string>>>>")), lambda c: F.coalesce(c["outputs"], F.array().cast("array<struct<output_type:string,text:string>>"))))
    one = lambda o: F.coalesce(F.array_join(F.from_json(F.when(o["text"].startswith("["), o["text"]), "array<string>"), ""), o["text"], F.lit(""))
    return raw.select("file", F.array_join(F.transform(F.filter(outputs, lambda o: o["output_type"] == "stream"), one), "\n").alias("text"))


def run_mode(name: Column) -> Column:
    """What a run file's name says it is: `sensitivity`, `manifest` (it ends in a UUID), `simple`,
    or null for names of other files and checkpoints."""
    stem = F.regexp_extract(name, r"^(output_.*)\.ipynb$", 1)
    last = F.regexp_replace(F.regexp_extract(stem, r"([^_]*)$", 1), r"^urn:|uuid:|[{}-]", "")
    named = (stem != "") & ~name.contains("-checkpoint")
    return F.when(named & name.startswith("output_sens_"), "sensitivity").when(named & last.rlike("^[0-9A-Fa-f]{32}$"), "manifest").when(named, "simple")


def find_runs(spark: SparkSession, path: str, mode: str | None = None) -> DataFrame:
    """(file, mode) of the run files below `path`, all or those of one mode."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "output_*.ipynb").load(path)
    found = files.select(F.col("path").alias("file"), run_mode(F.element_at(F.split("path", "/"), -1)).alias("mode")).filter("mode is not null")
    return found if mode is None else found.filter(F.col("mode") == mode)


def series_name(kind: str, region: str = "GB_GBN") -> str:
    """The column of the open power data that a type of source stands for: `load`, or generation
    by `wind` or `solar`; an unknown type is a ValueError."""
    # Fixed formats: the data set's own column names.
    formats = {"wind": "{}_wind_generation_actual", "solar": "{}_solar_generation_actual", "load": "{}_load_actual_entsoe_transparency"}
    if kind.lower() not in formats:
        raise ValueError(f"unknown type {kind}; known: {', '.join(formats)}")
    return formats[kind.lower()].format(region)


READERS: dict[str, Callable[..., DataFrame]] = {"tab": read_tab, "decimal_comma": read_decimal_comma, "per_well": read_per_well, "timestamped": read_timestamped}


def load(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    """Read with the reader of that (lower-cased) name; an unknown name is a ValueError."""
    if kind.lower() not in READERS:
        raise ValueError(f"unknown source {kind}; known: {', '.join(READERS)}")
    return READERS[kind.lower()](spark, path, **options)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a local session without it gets a temporary one."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if (conf.get("spark.master") or "").split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """`df`, written once below the shared folder and read from there: what is used twice is not
    made twice, and a lost executor costs no more than its own part."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_results(df: DataFrame, path: str, by: list[str]) -> None:
    """Result tables as Parquet, one folder for each value of `by`."""
    df.write.partitionBy(*by).parquet(path)


def signature(params: dict) -> str:
    """A name for parameters: the same for the same values in any order."""
    return hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()


def prepared(spark: SparkSession, folder: str, params: dict, prepare: Callable[[], DataFrame]) -> DataFrame:
    """What `prepare` gives, written once below `folder` under the signature of the parameters
    that it depends on, and read from there by every later call with the same ones."""
    path = f"{folder.rstrip('/')}/prepared-{signature(params)}"
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # not there yet
        prepare().write.parquet(path)
        return spark.read.parquet(path)


def experiment_name(datasets: list[str], architecture: str, members: int, date: str) -> str:
    return f"{'-'.join(datasets)}_{architecture}_ens{members}_{date}"


def save_experiment(spark: SparkSession, folder: str, name: str, config: dict, results: DataFrame) -> str:
    """An experiment's configuration and results (variant, metric, ...) below folder/name: one
    folder for each variant and metric, and the configuration as a table of its own."""
    path = f"{folder.rstrip('/')}/{name}"
    rows = [(k, json.dumps(v, sort_keys=True, default=str)) for k, v in sorted(config.items())]
    spark.createDataFrame(rows, "key string, value string").write.parquet(f"{path}/config")
    save_results(results, f"{path}/results", ["variant", "metric"])
    return path
