"""Word-level substring deduplication: repeated windows found by level-wise doubling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytetext as B
from .store import KeyFilter, bound_batches, row_key, table, with_texts

#: Words of a window.
WINDOW = 50
#: Text that a task works on at once, in bytes.
TEXT = 1 << 18

_FACTORS = (B.U(0x9DDFEA08EB382D69), B.U(0xE7037ED1A0B428DB))
_SIDE = B.U(0x8EBC6AF09C88C6E3)


class Windows:
    """Hashes, two independent ones, of the windows of any length that begin at each word.

    A window is named by the names of two shorter ones that cover it, from single words on, each
    time by a bijective mix: no polynomial over the words, which structured texts could defeat."""

    def __init__(self, words: list[np.ndarray]):
        self.n, self.by = len(words[0]), {1: words}

    def of(self, length: int) -> list[np.ndarray]:
        if length not in self.by:
            half, m = 1 << (length - 1).bit_length() - 1, max(0, self.n - length + 1)
            gap = length - half
            self.by[length] = [B.mix(h[:m] * f + h[gap : gap + m]) for h, f in zip(self.of(half), _FACTORS)]
        return self.by[length]

    def spans(self, start: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
        """The same for windows of their own lengths."""
        out = [np.zeros(len(start), B.U) for _ in _FACTORS]
        step = np.maximum(0, np.ceil(np.log2(np.maximum(length, 2))).astype(np.int64) - 1)
        for k in np.unique(step).tolist():
            at = np.flatnonzero(step == k)
            a, b = start[at], start[at] + length[at] - (1 << k)
            for x, h, f in zip(out, self.of(1 << k), _FACTORS):
                x[at] = B.mix(B.mix(h[a] * f + h[b]) + length[at].astype(B.U))
        return out


def _gram(window: int) -> int:
    return -(-window // 4)


def _windows(data: np.ndarray, starts: np.ndarray) -> tuple[Windows, np.ndarray]:
    """The windows of some rows laid end to end, and the first word of each row."""
    s, e, first = B.words(data, starts, ~B.SPACES)
    return Windows(B.span_hashes(data, s, e)), first


def _runs(data: np.ndarray, starts: np.ndarray, window: int):
    w, first = _windows(data, starts)
    lo, hi, a, row = B.anchored_runs(w.of(_gram(window))[0], first[:-1], np.diff(first), window, _gram(window))
    return w, first, lo, hi, a, row


def anchors(docs: DataFrame, window: int) -> DataFrame:
    """(g, n): the first level. Each window has one anchor, its gram of a quarter of its length
    with the least hash; n runs of windows have the anchor g. Only those with n > 1 go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, starts in B.text_chunks(batch.column("text"), TEXT):
                w, _, _, _, a, _ = _runs(data, starts, window)
                g, n = np.unique(w.of(_gram(window))[0][a], return_counts=True)
                yield pa.record_batch([pa.array(g.view(np.int64)), pa.array(n)], ["g", "n"])

    return docs.select("text").mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))


def runs(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, key, lo, n, place, g, d1, d2): n starts of windows from word lo on with the anchor g,
    which lies `place` words behind lo; d1 and d2 are hashes of all words of these windows."""
    doc_type = docs.schema["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, _, data, starts in B.text_chunks(batch.column("text"), TEXT):
                w, first, lo, hi, a, row = _runs(data, starts, window)
                take = pa.array(at + row)
                whole = w.spans(lo, hi - lo + window)
                numbers = [pa.array(x.astype(np.int32)) for x in (lo - first[row], hi - lo + 1, a - lo)]
                hashes = [pa.array(x.view(np.int64)) for x in (w.of(_gram(window))[0][a], *whole)]
                yield pa.record_batch([batch.column("doc_id").take(take), batch.column("key").take(take), *numbers, *hashes], ["doc_id", "key", "lo", "n", "place", "g", "d1", "d2"])

    ints, longs = ("lo", "n", "place"), ("g", "d1", "d2")
    schema = T.StructType([doc_type, T.StructField("key", T.LongType()), *[T.StructField(c, T.IntegerType()) for c in ints], *[T.StructField(c, T.LongType()) for c in longs]])
    return docs.select("doc_id", row_key().alias("key"), "text").mapInArrow(run, schema)


def _later(doc: str, first: str) -> Column:
    """Whether a smaller document than `doc` has it too; a null doc_id is larger than all others."""
    return F.col(first).isNotNull() & (F.col(doc).isNull() | (F.col(doc) > F.col(first)))


def second_level(wanted: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """(e, doc_id, key, lo, windows): anchors extended to twice their length, to the right for the
    starts of windows that hold this extension, to the left for the others; e is the hash of
    the extended anchor, `windows` those of the windows from start lo on, 16 bytes each."""
    gram = _gram(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("runs")
            for at, end, data, starts in B.text_chunks(batch.column("text"), TEXT):
                w, first = _windows(data, starts)
                mine = lists.slice(at, end - at)
                of = np.repeat(np.arange(end - at), np.diff(mine.offsets.to_numpy()))
                lo, n, place = (x.to_numpy().astype(np.int64) for x in mine.flatten().flatten())
                lo = lo + first[of]
                a = lo + place
                cut = np.clip(a - gram + 1, lo, lo + n)  # the first start that is less than a gram before a
                e, full = w.of(2 * gram)[0], np.stack(w.of(window), 1)
                for begin, stop, anchor, side in ((lo, cut, a - gram, B.U(0)), (cut, lo + n, a, _SIDE)):
                    k = np.flatnonzero(stop > begin)
                    take = pa.array(at + of[k])
                    blobs = [full[x:y].tobytes() for x, y in zip(begin[k].tolist(), stop[k].tolist())]
                    yield pa.record_batch(
                        [pa.array((e[anchor[k]] ^ side).view(np.int64)), batch.column("id").take(take), batch.column("key").take(take), pa.array((begin - first[of])[k].astype(np.int32)), pa.array(blobs, pa.binary())],
                        ["e", "doc_id", "key", "lo", "windows"],
                    )

    schema = T.StructType([T.StructField("e", T.LongType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("key", T.LongType()), T.StructField("lo", T.IntegerType()), T.StructField("windows", T.BinaryType())])
    return with_texts(wanted, docs).select("id", "key", "text", "runs").mapInArrow(run, schema)


def third_level(kept: DataFrame) -> DataFrame:
    """(w1, w2, doc_id, key, lo): a row for each whole window of `kept`, that starts at word lo."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = np.frombuffer(b"".join(batch.column("windows").to_pylist()), B.U).reshape(-1, 2)
            n = pa.compute.binary_length(batch.column("windows")).to_numpy().astype(np.int64) // 16
            of = np.repeat(np.arange(len(n)), n)
            lo = batch.column("lo").to_numpy()[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            take = pa.array(of)
            yield pa.record_batch([*(pa.array(np.ascontiguousarray(full[:, k]).view(np.int64)) for k in (0, 1)), batch.column("doc_id").take(take), batch.column("key").take(take), pa.array(lo.astype(np.int32))], ["w1", "w2", "doc_id", "key", "lo"])

    schema = T.StructType([T.StructField("w1", T.LongType()), T.StructField("w2", T.LongType()), *[kept.schema[c] for c in ("doc_id", "key", "lo")]])
    return kept.select("doc_id", "key", "lo", "windows").mapInArrow(run, schema)


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, key, lo, hi): the starts lo .. hi of windows whose words also start in a document
    with a smaller doc_id. `docs` has doc_id and text; key is row_key().

    Levels: windows of a quarter of the length, one in each whole window (its anchor); those that
    repeat are extended to a half, to the right or to the left; those that repeat again to the
    whole. What is alone at one level is not looked at again, and if nothing is left the search
    ends. Between the first two, runs of windows that are the same from their first to their
    last word are one: copies lose them at once, and the smallest document's go on for all, if
    the anchor is in other runs too."""
    grams = table(anchors(docs, window).filter("n > 1").select("g"), "doubling-grams")
    live = KeyFilter(grams, "g").maybe(runs(docs, window), "g").join(grams.hint("merge"), "g")
    live = table(live, "doubling-runs")
    same = ["g", "d1", "d2"]
    classes = table(live.groupBy(*same).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "doubling-classes")
    several = table(classes.groupBy("g").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("g", F.lit(True).alias("open")), "doubling-open")
    classes = classes.join(several, "g", "left").filter("copies > 1 or open")
    named = live.join(table(classes, "doubling-classes").hint("merge"), same)
    span = ["doc_id", "key", "lo", "n"]
    named = table(named.select(*span, "place", "open", _later("doc_id", "first").alias("gone")).filter("gone or open"), "doubling-named")
    found = named.filter("gone").select("doc_id", "key", "lo", (F.col("lo") + F.col("n") - 1).alias("hi"))
    wanted = named.filter("open and not gone").groupBy("key", F.col("doc_id").alias("id")).agg(F.collect_set(F.struct("lo", "n", "place")).alias("runs"))
    halves = table(second_level(table(wanted, "doubling-wanted"), docs, window), "doubling-halves")
    again = table(halves.groupBy("e").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("e"), "doubling-again")
    if again.isEmpty():
        return found
    whole = table(third_level(halves.join(again.hint("merge"), "e")), "doubling-windows")
    firsts = whole.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    lost = whole.join(table(firsts, "doubling-firsts").hint("merge"), ["w1", "w2"]).filter(_later("doc_id", "first"))
    return found.unionAll(lost.select("doc_id", "key", "lo", F.col("lo").alias("hi")))


def window_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Remove the words that lie in a window of `window` words which also starts in a document with
    a smaller doc_id; see repeated_windows. Windows are judged on the input.

    Words are runs without [\\x20\\x09-\\x0D], unchanged. Returns a row for each row: doc_id,
    n_words, n_removed, kept (the remaining words, joined by one space) and kept_sha256.

    A null or empty text has no words, one of fewer words than a window loses none. A null doc_id
    is larger than all others, and rows of one doc_id are one document. A very long text is
    worked on in one piece, some hundred bytes a word. An empty table gives an empty one; other
    columns are ignored, whatever their names."""
    if window < 4:
        raise ValueError("a window has at least four words")
    bound_batches(docs.sparkSession, "4m")
    docs = docs.select("doc_id", "text")
    lost = repeated_windows(docs, window).groupBy("key", F.col("doc_id").alias("id")).agg(F.collect_set(F.struct("lo", "hi")).alias("lost"))
    lost = table(lost, "doubling-lost")
    names = ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, rows = batch.column("lost"), []
            for r, text in enumerate(batch.column("text")):
                words = (text.as_py() or "").encode().split()
                kept = words
                if spans[r].is_valid:
                    lo, hi = (spans[r].values.field(c).to_numpy() for c in ("lo", "hi"))
                    mark = np.bincount(lo, minlength=len(words) + 1) - np.bincount(hi + window, minlength=len(words) + 1)
                    kept = [words[k] for k in np.flatnonzero(np.cumsum(mark[:-1]) == 0).tolist()]
                text = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), text.decode(), hashlib.sha256(text).hexdigest()))
            columns = list(zip(*rows)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch([batch.column("doc_id"), *map(pa.array, columns, kinds)], names)

    keys = KeyFilter(lost, "key")
    keyed = docs.withColumn("_row", row_key())
    clean = keys.maybe(keyed, "_row", False).select("doc_id", "text", F.lit(None).cast(lost.schema["lost"].dataType).alias("lost"))
    match = (F.col("_row") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id"))
    met = keys.maybe(keyed, "_row").join(lost.hint("merge"), match, "left").select("doc_id", "text", "lost")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("kept_sha256", T.StringType())])
    return clean.unionAll(met).mapInArrow(cut, schema)
