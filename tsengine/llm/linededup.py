"""Line deduplication that returns per-document keep bitmaps."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytetext as B
from .store import KeyFilter, apart, bound_batches, row_key, table

MIN_POINTS = 40
MIN_DOCS = 5


def _keys(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, position, stripped start and end of every line; every row ends with a newline."""
    ends = np.flatnonzero(data == 0x0A)
    begins = np.concatenate(([0], ends[:-1] + 1))
    row = np.searchsorted(starts, begins, "right") - 1
    pos = np.arange(len(begins)) - np.searchsorted(begins, starts[:-1])[row]
    solid = ~B.SPACES[data]
    at = np.arange(len(data))
    after = np.minimum.accumulate(np.where(solid, at, len(data))[::-1])[::-1]
    before = np.maximum.accumulate(np.where(solid, at, -1))
    s = np.minimum(after[begins], ends)
    e = np.where(ends > begins, np.maximum(before[ends - 1] + 1, s), s)
    return row, pos, s, np.where(s == ends, s, e)


def long_lines(docs: DataFrame, min_points: int) -> DataFrame:
    """Two hashes of the key of every line of at least min_points code points."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, starts in B.text_chunks(batch.column("text")):
                row, pos, s, e = _keys(data, starts)
                points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                at = np.flatnonzero(points[e] - points[s] >= min_points)
                lines = np.bincount(row, minlength=hi - lo)
                row, pos, s, e = row[at], pos[at], s[at], e[at]
                data = B.LOWER[data]
                take = pa.array(lo + row)
                yield pa.record_batch(
                    [*(pa.array(h.view(np.int64)) for h in B.span_hashes(data, s, e)), batch.column("doc_id").take(take), batch.column("row_key").take(take), pa.array(lines[row].astype(np.int32)), pa.array(pos.astype(np.int32))],
                    ["h1", "h2", "doc_id", "row_key", "n_lines", "pos"],
                )

    schema = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), docs.schema["doc_id"], T.StructField("row_key", T.LongType()), T.StructField("n_lines", T.IntegerType()), T.StructField("pos", T.IntegerType())])
    return docs.select("doc_id", row_key().alias("row_key"), "text").mapInArrow(split, schema)


def _stream(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """One range of the sorted lines, read once; the largest document of a run comes first.

    Of a run that begins here, the first document keeps its lines; those of the next ones
    wait until min_docs documents are seen, then all are dropped (kind 0). A run that began
    in an earlier range, or ends undecided, is left open: its rows are kind 1. Kind 2 sums up
    the first and the last run. So at most the lines of min_docs - 1 documents wait."""
    types = [pa.int8(), pa.int64(), pa.int64(), None, pa.int64(), pa.int32(), pa.int32(), pa.int64(), None]
    out: list[list] = [[] for _ in types]
    doc_type = pa.int64()

    def put(kind, h, doc, rk, n, pos, docs=None, last=None):
        for c, v in zip(out, (kind, *h, doc, rk, n, pos, docs, last), strict=True):
            c.append(v)

    def flush() -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(c, k or doc_type) for c, k in zip(out, types)], ["kind", "h1", "h2", "doc_id", "row_key", "n_lines", "pos", "n_docs", "last_doc"])
        for c in out:
            c.clear()
        return batch

    run, opening, n_docs, top, last, waiting = None, False, 0, None, None, []
    for batch in batches:
        doc_type = batch.column("doc_id").type
        h1, h2 = (batch.column(c).to_numpy() for c in ("h1", "h2"))
        if not len(h1):
            continue
        cuts = np.concatenate(([0], np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1, [len(h1)]))
        worth = np.diff(cuts) >= min_docs  # shorter runs inside a batch drop nothing
        worth[[0, -1]] = True
        cols = [batch.column(c) for c in ("doc_id", "row_key", "n_lines", "pos")]
        for k in np.flatnonzero(worth).tolist():
            a, b = int(cuts[k]), int(cuts[k + 1])
            h = (int(h1[a]), int(h2[a]))
            rows = list(zip(*(c.slice(a, b - a).to_pylist() for c in cols), strict=True))
            if h != run:
                if opening:
                    put(2, run, top, None, None, None, n_docs, last)
                opening, run, n_docs, top, last, waiting = run is None, h, 0, rows[0][0], None, []
            for x in rows:
                if not n_docs or x[0] != last:
                    n_docs, last = n_docs + 1, x[0]
                    if n_docs == min_docs:
                        for w in waiting:
                            put(1 if opening else 0, run, *w)
                        waiting = []
                if opening:
                    put(1, run, *x)
                elif n_docs >= min_docs:
                    put(0, run, *x)
                elif n_docs > 1:
                    waiting.append(x)
        if len(out[0]) > 20_000:
            yield flush()
    if run is not None:
        for w in waiting:
            put(1, run, *w)
        put(2, run, top, None, None, None, n_docs, last)
    yield flush()


def line_keep_bitmaps(docs: DataFrame, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The lines that each document keeps, as a compressed bitmap, for documents that lose any.

    A line's key is the line without [\\x20\\x09-\\x0D] at both ends and with A-Z lower-cased.
    Keys of at least min_points code points found in at least min_docs documents lose all
    their lines except in the largest doc_id that holds them.

    128-bit hashes of the keys are range-partitioned together with document and position, so
    that a key found everywhere spreads over many ranges, sorted, and streamed once. What a
    range cannot decide about its first and last run is settled from their sums, two rows a
    range, which are broadcast.

    Returns doc_id, row_key, n_lines, n_dropped, keep_bitmap (zlib of one bit a line, first
    line highest; 1 is kept). A null doc_id is a document of its own that is smaller than all
    others; rows of one doc_id are one document; a null or empty text is one empty line."""
    bound_batches(docs.sparkSession)
    lines = table(long_lines(docs, min_points), "lines")
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc_nulls_last(), F.col("row_key"), F.col("pos")]
    doc_type = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("kind", T.ByteType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("doc_id", doc_type), T.StructField("row_key", T.LongType())]
        + [T.StructField("n_lines", T.IntegerType()), T.StructField("pos", T.IntegerType()), T.StructField("n_docs", T.LongType()), T.StructField("last_doc", doc_type)]
    )
    said = table(lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda it: _stream(it, min_docs), schema), "line-runs")
    by_hash = Window.partitionBy("h1", "h2").orderBy(F.col("doc_id").desc_nulls_last(), F.col("last_doc").desc_nulls_last())
    goes_on = F.lag(F.struct("last_doc")).over(by_hash) == F.struct(F.col("doc_id").alias("last_doc"))
    sums = said.filter("kind = 2").withColumn("again", F.coalesce(goes_on.cast("long"), F.lit(0)))
    sums = sums.groupBy("h1", "h2").agg((F.sum("n_docs") - F.sum("again")).alias("docs"), F.max("doc_id").alias("top"))
    open_ = said.filter("kind = 1").select("h1", "h2", "doc_id", "row_key", "n_lines", "pos").join(F.broadcast(sums), ["h1", "h2"])
    open_ = open_.filter((F.col("docs") >= min_docs) & ~F.col("doc_id").eqNullSafe(F.col("top")))
    cols = ["doc_id", "row_key", "n_lines", "pos"]
    drops = said.filter("kind = 0").select(cols).unionAll(open_.select(cols)).groupBy("doc_id", "row_key", "n_lines").agg(F.collect_set("pos").alias("drop"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for n, drop in zip(batch.column("n_lines").to_pylist(), batch.column("drop").to_pylist(), strict=True):
                keep = np.ones(n, bool)
                keep[drop] = False
                maps.append(zlib.compress(np.packbits(keep).tobytes()))
            n_dropped = pa.array([len(x) for x in batch.column("drop").to_pylist()], pa.int64())
            yield pa.record_batch([batch.column("doc_id"), batch.column("row_key"), batch.column("n_lines").cast(pa.int64()), n_dropped, pa.array(maps, pa.binary())], ["doc_id", "row_key", "n_lines", "n_dropped", "keep_bitmap"])

    packed = T.StructType([T.StructField("doc_id", doc_type), T.StructField("row_key", T.LongType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("keep_bitmap", T.BinaryType())])
    return drops.mapInArrow(pack, packed)


def apply_keep_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """`docs` with text cut to the kept lines, joined by newlines, and two more columns:
    n_lines (before) and n_dropped, which replace columns of these names. A document without a
    bitmap keeps its text as it is, and only texts that may have one are shuffled."""
    bound_batches(docs.sparkSession)
    flag = [F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), F.col("n_dropped").alias("_dropped"), F.col("keep_bitmap").alias("_bitmap")]
    flag = table(bitmaps.select(*flag), "line-flags")
    docs, back = apart(docs.drop("n_lines", "n_dropped"))
    names = docs.columns
    keyed, keys = docs.withColumn("_row", row_key()), KeyFilter(flag, "_key")
    whole = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    rest = keys.maybe(keyed, "_row", False).select(*names, F.coalesce(whole, F.lit(1)).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    kept = keys.maybe(keyed, "_row").join(flag, (F.col("_row") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, maps = batch.column("text").to_pylist(), batch.column("_bitmap").to_pylist()
            n_lines = [(t or "").count("\n") + 1 for t in texts]
            for i, m in enumerate(maps):
                if m is not None:
                    keep = np.unpackbits(np.frombuffer(zlib.decompress(m), np.uint8))
                    texts[i] = "\n".join(x for x, k in zip(texts[i].split("\n"), keep) if k)
            out = {c: batch.column(c) for c in names}
            out |= {"text": pa.array(texts, pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": batch.column("_dropped").fill_null(0)}
            yield pa.record_batch([out[f.name] for f in schema.fields], [f.name for f in schema.fields])

    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return rest.unionByName(kept.select(*names, "_dropped", "_bitmap").mapInArrow(cut, schema)).select(*back, "n_lines", "n_dropped")
