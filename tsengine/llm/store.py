"""Shared scratch tables and row keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Only a local session without that setting (tests) gets a folder of its own."""
    conf = spark.sparkContext.getConf()
    shared = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not (conf.get("spark.master") or "").split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, "file:" + tempfile.mkdtemp(prefix="spark-"))


def table(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: lineage is
    cut, and later passes read only the columns they use."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A key made from a row's content, the same whenever the row is read again."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def apart(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """`docs` with doc_id and text, its other columns under names that no operator uses, and the
    expressions that give the columns back."""
    names = {c: c if c in ("doc_id", "text") else f"_column_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), [F.col(new).alias(old) for old, new in names.items()]


class KeyFilter:
    """A bit for each class of the 64-bit keys that may be looked for; others are surely absent.

    It has RATE bits for each key, within BITS, so that it can always be broadcast (16 bytes for
    a word of 64 bits: 32 MB at most); with more keys it lets more pass, and the exact join
    behind it decides. `keys` is a written table."""

    RATE, BITS = 128, (1 << 20, 1 << 27)

    def __init__(self, keys: DataFrame, key: str):
        n = keys.count()
        self.log = int(np.ceil(np.log2(min(max(self.RATE * n, self.BITS[0]), self.BITS[1]))))
        word, bit = self._place(key)
        self.words = keys.groupBy(word.alias("_word")).agg(F.bit_or(F.expr(f"shiftleft(1L, {bit})")).alias("_bits"))

    def _place(self, key: str) -> tuple[Column, str]:
        at = f"shiftrightunsigned({key}, {64 - self.log})"
        return F.expr(f"shiftright({at}, 6)"), f"cast({at} & 63 as int)"

    def maybe(self, docs: DataFrame, key: str, among: bool = True) -> DataFrame:
        """The rows of `docs` whose `key` may be one of the keys; the others with among=False."""
        word, bit = self._place(key)
        met = docs.withColumn("_word", word).join(F.broadcast(self.words), "_word", "left")
        there = F.expr(f"coalesce(shiftrightunsigned(_bits, {bit}) & 1, 0L) = 1")
        return met.filter(there if among else ~there).drop("_word", "_bits")

    def lookup(self) -> KeyLookup:
        """The same filter for Python tasks."""
        words = self.words.toArrow()
        bits = np.zeros(1 << self.log - 6, np.uint64)
        bits[words.column("_word").to_numpy()] = words.column("_bits").to_numpy().view(np.uint64)
        return KeyLookup(self.log, bits)


@dataclass
class KeyLookup:
    log: int
    bits: np.ndarray

    def where(self, x: np.ndarray) -> np.ndarray:
        """Positions in x (unsigned) whose value may be among the keys."""
        at = x >> np.uint64(64 - self.log)
        return np.flatnonzero(self.bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1))


def with_texts(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """`wanted`, a written table with the columns key (row_key) and id (doc_id), with text. Rows
    that repeat give a text twice. One plan at every size: a sort-merge join, to which only texts
    go that may be wanted, by a filter of bounded size, and whose hot keys adaptive execution
    splits."""
    texts = docs.select(row_key().alias("key"), F.col("doc_id").alias("_doc"), "text")
    met = KeyFilter(wanted, "key").maybe(texts, "key").join(wanted.hint("merge"), "key")
    return met.filter(F.col("id").eqNullSafe(F.col("_doc"))).drop("_doc")


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, size: str = "8m") -> None:
    """Arrow batches of some `size` bytes from now on, unless the session has a size of its own.

    A Python task holds several copies of a batch outside the heap, and an executor runs several;
    Spark's own 64 MB make that a gigabyte. The setting stays, as what an operator returns is
    run later."""
    if spark.conf.get(_BATCH).lower() in ("64mb", "64m", "67108864", "67108864b"):
        spark.conf.set(_BATCH, size)


@contextmanager
def batches_of(spark: SparkSession, size: str) -> Iterator[None]:
    """Arrow batches of some `size` bytes, not Spark's 64 MB, in what runs meanwhile: a task
    holds several copies of a batch outside the heap. The session's own setting returns."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, size)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)
