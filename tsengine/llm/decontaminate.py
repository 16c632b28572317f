"""Benchmark decontamination: a prefix-filtered set join of item windows with documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytetext as B
from .store import KeyFilter, bound_batches, row_key, table

#: Words in a window; a shorter item is one window.
WINDOW = 13
#: Words in the shingles that windows and documents are joined on; a shorter window is one.
SHINGLE = 3
#: Windows (some 150 bytes each) up to which they are broadcast; more are met by a shuffle.
BROADCAST_WINDOWS = 200_000
#: Places that a document's task sends on together.
SENT = 50_000


def _word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    s, e, first = B.words(data, starts, B.ALNUM)
    return B.Spans(data).of(s, e), s, e, first


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, win, k, keys) for every window of every item that has words: its words, joined by
    blanks, their number, and its shingles' hashes in sequence."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["item_id", "win", "k", "keys"]
        for batch in batches:
            for lo, hi, data, starts in B.text_chunks(batch.column("text")):
                data = B.LOWER[data]
                h, s, e, first = _word_hashes(data, starts)
                raw, grams = data.tobytes(), [B.shingles(h, m).view(np.int64) for m in range(1, SHINGLE + 1)]
                out: list[tuple] = []

                def flush(id_column=batch.column("item_id")) -> pa.RecordBatch:
                    rows, wins, ks, keys = zip(*out) if out else ((), (), (), ())
                    columns = [id_column.take(pa.array(rows, pa.int64())), pa.array(wins, pa.string()), pa.array(ks, pa.int32()), pa.array(keys, pa.list_(pa.int64()))]
                    out.clear()
                    return pa.record_batch(columns, names)

                for r in range(lo, hi):
                    a, b = int(first[r - lo]), int(first[r - lo + 1])
                    words = [raw[s[i] : e[i]].decode() for i in range(a, b)]
                    for i in range(max(1, b - a - WINDOW + 1) if b > a else 0):
                        k = min(WINDOW, b - a)
                        m = min(SHINGLE, k)
                        out.append((r, " ".join(words[i : i + k]), k, grams[m - 1][a + i : a + i + k - m + 1]))
                        if len(out) >= SENT:
                            yield flush()
                yield flush()

    schema = T.StructType([items.schema["item_id"], T.StructField("win", T.StringType()), T.StructField("k", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    return items.select("item_id", "text").mapInArrow(split, schema)


def _inside(at: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """Which shingles of m words at these words end in the row they begin in."""
    row = np.searchsorted(first, at, "right") - 1
    return at + m <= first[row + 1]


def _shingle_counts(docs: DataFrame, keys: DataFrame, sizes: list[int]) -> DataFrame:
    """(key, n): how often each of `keys` occurs in the documents, if it does."""
    shared = docs.sparkSession.sparkContext.broadcast(KeyFilter(keys, "key").lookup())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_, held, n = shared.value, [], 0

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held or [np.zeros(0, np.uint64)]), return_counts=True)
            held.clear()
            return pa.record_batch([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["key", "n"])

        for batch in batches:
            for _, _, data, starts in B.text_chunks(batch.column("text")):
                h, _, _, first = _word_hashes(B.LOWER[data], starts)
                for m in sizes:
                    g = B.shingles(h, m)
                    at = filter_.where(g)
                    held.append(g[at[_inside(at, first, m)]])
                    n += len(held[-1])
            if n > 1 << 20:
                yield flush()
                n = 0
        yield flush()

    counted = docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return counted.join(keys, "key", "left_semi")


def _places(docs: DataFrame, keys: DataFrame, sizes: list[int]) -> DataFrame:
    """A row for each document (pos is null), with its number of words, and one for each place
    where a prefix shingle may occur: the words around it that a window can reach. A shingle of
    fewer than SHINGLE words is a whole window and needs no more than itself."""
    shared = docs.sparkSession.sparkContext.broadcast(KeyFilter(keys, "key").lookup())
    names = ["rid", "row_key", "doc_id", "n_words", "key", "pos", "from", "ctx"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = shared.value
        for batch in batches:
            for lo, hi, data, starts in B.text_chunks(batch.column("text")):
                data = B.LOWER[data]
                h, s, e, first = _word_hashes(data, starts)
                raw, n = data.tobytes(), hi - lo
                null = [pa.nulls(n, t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()))]
                yield pa.record_batch([*(batch.column(c).slice(lo, n) for c in names[:3]), pa.array(np.diff(first).astype(np.int64)), *null], names)
                for m in sizes:
                    g = B.shingles(h, m)
                    at = filter_.where(g)
                    at = at[_inside(at, first, m)]
                    row = np.searchsorted(first, at, "right") - 1
                    wide = WINDOW - 1 if m == SHINGLE else 0
                    a = np.maximum(first[row], at - wide)
                    b = np.minimum(first[row + 1], np.maximum(at + m, at + wide + 1))
                    for x in range(0, len(at), SENT):
                        part = slice(x, x + SENT)
                        ctx = [[raw[s[j] : e[j]].decode() for j in range(p, q)] for p, q in zip(a[part].tolist(), b[part].tolist())]
                        take = pa.array(lo + row[part])
                        begin = first[row[part]]
                        cols = [pa.array(g[at[part]].view(np.int64)), pa.array((at[part] - begin).astype(np.int32)), pa.array((a[part] - begin).astype(np.int32)), pa.array(ctx, pa.list_(pa.string()))]
                        yield pa.record_batch([*(batch.column(c).take(take) for c in names[:3]), pa.nulls(len(take), pa.int64()), *cols], names)

    long = lambda c: T.StructField(c, T.LongType())
    schema = T.StructType([long("rid"), long("row_key"), docs.schema["doc_id"], long("n_words"), long("key"), T.StructField("pos", T.IntegerType()), T.StructField("from", T.IntegerType()), T.StructField("ctx", T.ArrayType(T.StringType()))])
    return docs.select(F.monotonically_increasing_id().alias("rid"), row_key().alias("row_key"), "doc_id", "text").mapInArrow(probe, schema)


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Which words of each document lie in a window of a benchmark item.

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z. Windows are sets of
    3-word shingles. Shingles are ordered by how often they occur in the documents; as a
    window must be contained whole, its necessary prefix is its rarest shingle, on which
    windows and documents are joined. Bounds on position and length follow, then the words
    of the whole window are compared. Equal windows are one; items are attached to those that
    occur. The documents are read twice, however many items there are: a filter of bounded
    size thins what is sent, an exact join decides.

    Returns a row for each row of `docs`: doc_id, row_key, n_words, n_hit (words inside a
    window's occurrence), items (sorted ids, as strings, of items with an occurring window).
    item_id may have any type; an item without id is not listed, though its words count. Null
    or wordless texts have no words and no hits, such items no windows; repeated rows and
    repeated doc_ids are judged row by row, repeated items count once; a long text's places
    are rows of their own; without items nothing is hit, without documents nothing returned;
    other columns are ignored, whatever their names."""
    bound_batches(docs.sparkSession)
    wins = table(item_windows(items), "item-windows")
    each = table(wins.select("win", "k", "keys").dropDuplicates(["win"]), "windows")
    sizes = sorted(r.m for r in each.select(F.least("k", F.lit(SHINGLE)).alias("m")).distinct().collect())  # at most SHINGLE
    counts = table(_shingle_counts(docs, table(each.select(F.explode("keys").alias("key")).distinct(), "shingles"), sizes), "shingle-counts")
    ranked = each.select("win", "k", F.posexplode("keys").alias("off", "key")).join(counts, "key", "left")
    rarest = ranked.groupBy("win", "k").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "off")).alias("least"))
    # A window with a shingle that occurs nowhere occurs nowhere.
    prefix = table(rarest.filter("least.n > 0").select("win", "k", "least.key", "least.off"), "prefix")
    seen = table(_places(docs, prefix.select("key"), sizes), "places")
    if prefix.count() <= BROADCAST_WINDOWS:
        prefix = F.broadcast(prefix)
    places = seen.filter("pos is not null").select("rid", "key", "pos", "from", "ctx", (F.col("from") + F.size("ctx")).alias("to"))
    start = F.col("pos") - F.col("off")
    fits = (start >= F.col("from")) & (start + F.col("k") <= F.col("to"))
    words = F.array_join(F.slice("ctx", F.greatest(start - F.col("from") + 1, F.lit(1)), F.col("k")), " ")
    hits = places.join(prefix, "key").filter(fits).filter(words == F.col("win")).select("rid", "win", start.alias("s"), (start + F.col("k")).alias("e"))
    hits = table(hits.distinct(), "hits")
    # Words covered by any occurrence: each adds what lies beyond the ones before it.
    before = F.max("e").over(Window.partitionBy("rid").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s"), F.coalesce(before, F.lit(0))))
    n_hit = hits.select("rid", "s", "e").distinct().select("rid", fresh.alias("fresh")).groupBy("rid").agg(F.sum("fresh").alias("n_hit"))
    listed = hits.select("rid", "win").distinct().join(wins.select("win", F.col("item_id").cast("string").alias("item")).distinct(), "win")
    listed = listed.groupBy("rid").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = n_hit.join(listed, "rid", "left")
    return seen.filter("pos is null").select("rid", "doc_id", "row_key", "n_words").join(found, "rid", "left").select(
        "doc_id", "row_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def is_contaminated() -> Column:
    """At least one word in twenty lies in a benchmark window."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))
