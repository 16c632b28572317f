"""Substring deduplication over a sparse, range-partitioned suffix array."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytetext as B
from .store import KeyFilter, bound_batches, table

#: Bytes of a repeated string.
LENGTH = 200
#: Bytes of an anchor's gram; each string of LENGTH bytes holds WINDOW grams.
GRAM = 64
WINDOW = LENGTH - GRAM + 1
#: Bytes of a machine word, and words of a sort key: the anchor's first, its place, the string.
WORD = 8
KEY_WORDS = 2 + LENGTH // WORD
#: Entries in a bucket of anchors, and suffixes in one of the suffix array.
BUCKET = 200_000
#: Of an anchor that a map task holds more often, its entries are dealt by content instead.
OFTEN = 8
#: Splitters at most (209 bytes each), and sampled suffixes for each of them. With more buckets,
#: a range is dealt on by a hash of the string.
MAX_SPLITTERS, OVERSAMPLED = 4096, 16


def _anchors(data: np.ndarray, starts: np.ndarray):
    """The runs of starts of strings of LENGTH bytes with one anchor (B.anchored_runs), and the
    hashes that chose the anchors. These only choose, so they need not be strong."""
    spans = B.Spans(data)
    gram = B.mix((spans.prefix[GRAM:] - spans.prefix[:-GRAM]) * spans.powers[: max(0, len(data) - GRAM + 1)])
    return *B.anchored_runs(gram, starts[:-1], np.diff(starts) - 1, LENGTH, GRAM), spans


def _words_of(data: np.ndarray) -> np.ndarray:
    """At each position, the WORD bytes from there on as one number, in byte order. The last
    ones are not to be used."""
    return np.ndarray((max(0, len(data) - WORD + 1),), ">u8", np.ascontiguousarray(data), 0, (1,))


def _blob(x: np.ndarray | None) -> bytes | None:
    return None if x is None else np.ascontiguousarray(x).tobytes()


def _groups(x: np.ndarray) -> list[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


def _packed(cols: list[np.ndarray], bucket: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket; every column as one block of bytes, in the order of row and
    place (the first and third column), which shuffles well compressed."""
    order = np.lexsort((cols[2], cols[0], bucket))
    bucket, cols = bucket[order], [c[order] for c in cols]
    cut = _groups(bucket)
    return pa.record_batch([pa.array([int(bucket[a]) for a, _ in cut], pa.int32())] + [pa.array([_blob(c[a:b]) for a, b in cut], pa.binary()) for c in cols], ["bucket"] + [f"c{i}" for i in range(len(cols))])


def _buckets(batches: Iterator[pa.RecordBatch], kinds: list) -> Iterator[list[np.ndarray]]:
    """The columns of one bucket after the other; a task's rows are sorted by bucket."""
    current, held = None, []
    for batch in batches:
        ids, blobs = batch.column("bucket").to_pylist(), [batch.column(f"c{i}") for i in range(len(kinds))]
        for r, b in enumerate(ids):
            if b != current and held:
                yield [np.concatenate([h[i] for h in held]) for i in range(len(kinds))]
                held = []
            current = b
            held.append([np.frombuffer(c[r].as_py(), k) for c, k in zip(blobs, kinds)])
    if held:
        yield [np.concatenate([h[i] for h in held]) for i in range(len(kinds))]


def _runs(sorted_keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each row and size of its group, for rows sorted by these keys."""
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    of = np.cumsum(new) - 1
    return of, np.bincount(of)[of] if len(of) else of


def anchor_runs(docs: DataFrame, n_buckets: int) -> DataFrame:
    """Runs of starts whose anchor gram occurs more than once: (k1, k2, lo, hi, anchor, state), in
    bytes of the row that has this key. State 1: the whole stretch, by its length and a digest of
    128 bits, occurs elsewhere with the same anchor, so that all its starts repeat. State 0:
    open. State 2: as 1, and one of its kind is compared with the open ones.

    Grams are told apart by 64 bits only: a collision opens a run that need not be open, and the
    suffix array decides about it."""
    kinds = [np.int64, np.int64, np.int32, np.int32, np.int32, B.U, B.U, B.U, np.uint8]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            k1, k2, lo, hi, a, gram, w1, w2 = (np.concatenate([h[i] for h in held]) for i in range(8))
            held.clear()
            order = np.lexsort((w2, w1, gram))
            k1, k2, lo, hi, a, gram, w1, w2 = (x[order] for x in (k1, k2, lo, hi, a, gram, w1, w2))
            of, n_whole = _runs([gram, w1, w2])
            _, n_gram = _runs([gram])
            # Of equal stretches one stands for all; the others are settled here.
            settled = np.append(False, of[1:] == of[:-1])[: len(of)]
            lone = np.ones(len(gram), bool)
            lone[1:] = gram[1:] != gram[:-1]
            flag = (n_whole > 1).astype(np.uint8) | (n_gram > 1).astype(np.uint8) << 1 | settled.astype(np.uint8) << 2
            key = np.where((n_gram > OFTEN) & ~lone, w1, gram)  # one of an anchor always goes by its gram
            return _packed([k1, k2, lo, hi, a, gram, w1, w2, flag], _spread(np.where(settled, B.mix(k1.view(B.U)), key), n_buckets))

        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy() for c in ("k1", "k2"))
            for first_row, _, data, starts in B.text_chunks(batch.column("text")):
                lo, hi, a, row, spans = _anchors(data, starts)
                if not len(lo):
                    continue
                place = (a - lo).astype(B.U) * B.U(0x9E3779B97F4A7C15)
                whole = [B.mix(h + place) for h in B.span_hashes(data, lo, hi + LENGTH)]
                at = starts[row]
                held.append([k1[first_row + row], k2[first_row + row], *((x - at).astype(np.int32) for x in (lo, hi, a)), spans.of(a, a + GRAM), *whole])
                size += len(lo)
                if size > 2 * BUCKET:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k1, k2, lo, hi, a, gram, w1, w2, flag in _buckets(batches, kinds):
            done = flag & 4 > 0
            state = np.full(len(gram), -1, np.int8)
            state[done] = 1
            at = np.flatnonzero(~done)
            order = at[np.lexsort((w2[at], w1[at], gram[at]))]
            g, f = gram[order], flag[order]
            of_w, n_w = _runs([g, w1[order], w2[order]])
            of_g, n_g = _runs([g])
            if len(order):
                repeats = (n_w > 1) | (np.bincount(of_w, f & 1)[of_w] > 0)
                shared = (n_g > 1) | (np.bincount(of_g, f & 2)[of_g] > 0)
                first = np.ones(len(order), bool)
                first[1:] = of_w[1:] != of_w[:-1]
                # Every anchor dealt elsewhere by content may be open there, so witnesses are
                # left out only when this bucket holds the whole of the anchor.
                lonely = (np.bincount(of_g, ~repeats)[of_g] == 0) & (np.bincount(of_g, f & 2)[of_g] == 0)
                state[order] = np.where(shared, np.where(repeats, np.where(first & ~lonely, 2, 1), 0), -1)
            keep = state >= 0
            yield pa.record_batch([pa.array(x[keep]) for x in (k1, k2, lo, hi, a, state)], ["k1", "k2", "lo", "hi", "anchor", "state"])

    packed = docs.select("k1", "k2", "text").mapInArrow(find, "bucket int, " + ", ".join(f"c{i} binary" for i in range(9)))
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "k1 long, k2 long, lo int, hi int, anchor int, state byte")


def _spread(key: np.ndarray, n: int) -> np.ndarray:
    return ((key >> B.U(40)) * B.U(n) >> B.U(24)).astype(np.int64)


def stretches(docs: DataFrame, opened: DataFrame) -> DataFrame:
    """(k1, k2, lo, place, state, bytes) for each run of `opened`: the bytes from its first start to
    the end of its last string; its anchor lies `place` bytes behind the first start."""
    runs = F.sort_array(F.collect_set(F.struct("lo", "hi", "anchor", "state"))).alias("runs")
    named = table(opened.groupBy("k1", "k2").agg(runs), "suffix-open")
    texts = KeyFilter(named, "k1").maybe(docs, "k1").select("k1", "k2", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k1", "k2", "lo", "place", "state", "bytes"]
        for batch in batches:
            runs, rows = batch.column("runs"), batch.select(["k1", "k2"])
            for r, text in enumerate(batch.column("text")):
                data, mine = text.as_py().encode(), runs[r].values
                lo, hi, anchor, state = (mine.field(c).to_numpy() for c in ("lo", "hi", "anchor", "state"))
                k1, k2 = (rows.column(c)[r].as_py() for c in ("k1", "k2"))
                for i in range(0, len(lo), 10_000):
                    p = slice(i, i + 10_000)
                    n = len(lo[p])
                    parts = [data[x : y + LENGTH] for x, y in zip(lo[p].tolist(), hi[p].tolist())]
                    yield pa.record_batch([pa.array(np.full(n, k1)), pa.array(np.full(n, k2)), pa.array(lo[p]), pa.array((anchor - lo)[p]), pa.array(state[p]), pa.array(parts, pa.binary())], names)

    return texts.join(named, ["k1", "k2"]).select("k1", "k2", "text", "runs").mapInArrow(cut, "k1 long, k2 long, lo int, place int, state byte, bytes binary")


class Suffixes:
    """Strings of LENGTH bytes in a buffer, with their sort keys: the first word of the string's
    anchor, where in the string it lies, then the string. A string has one anchor, wherever it
    stands, so equal strings have equal keys."""

    def __init__(self, data: np.ndarray, at: np.ndarray, place: np.ndarray):
        self.data, self.at, self.place = data, at, place
        self.words = _words_of(data)

    def word(self, k: np.ndarray, depth: np.ndarray) -> np.ndarray:
        at = np.where(depth == 0, self.at[k] + self.place[k], self.at[k] + WORD * np.maximum(depth - 2, 0))
        return np.where(depth == 1, self.place[k].astype(np.uint64), self.words[at].astype(np.uint64))

    def key(self, k: int) -> bytes:
        i, x = int(self.at[k]), int(self.place[k])
        return self.data[i + x : i + x + WORD].tobytes() + bytes([x]) + self.data[i : i + LENGTH].tobytes()


def multikey_quicksort(n: int, words: int, word: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order of n keys of `words` words, and which differ from the key before them.

    Bentley and Sedgewick's multikey quicksort on words, all open segments side by side: a
    segment, whose keys agree in the first `depth` words, is split into three by its middle
    key's next word; the part that is equal to it goes on with the word after."""
    order = np.arange(n)
    differs = np.zeros(n, bool)
    differs[:1] = True
    begin, size, depth = np.zeros(1, np.int64), np.array([n], np.int64), np.zeros(1, np.int64)
    while True:
        live = (size > 1) & (depth < words)
        begin, size, depth = begin[live], size[live], depth[live]
        if not len(begin):
            return order, differs
        base = np.cumsum(size) - size
        seg = np.repeat(np.arange(len(size)), size)
        where = np.arange(len(seg)) - base[seg] + begin[seg]
        mine = order[where]
        w = word(mine, depth[seg])
        pivot = w[base + size // 2][seg]
        less, equal = w < pivot, w == pivot
        n_less, n_equal = np.add.reduceat(less, base, dtype=np.int64), np.add.reduceat(equal, base, dtype=np.int64)
        rank = lambda mask: (c := np.cumsum(mask) - mask) - c[base][seg]
        to = np.where(less, rank(less), np.where(equal, n_less[seg] + rank(equal), (n_less + n_equal)[seg] + rank(~(less | equal))))
        order[begin[seg] + to] = mine
        parts = [(begin, n_less, depth), (begin + n_less, n_equal, depth + 1), (begin + n_less + n_equal, size - n_less - n_equal, depth)]
        begin, size, depth = (np.concatenate([p[i] for p in parts]) for i in range(3))
        differs[begin[size > 0]] = True


def _starts(n: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pieces of n starts each: the piece of each start, and its number in it plus first."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of]


def _pieces(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and size of each run that begins where new is True."""
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(new)))


def splitters(runs: DataFrame, n_starts: int, n_ranges: int) -> list[bytes]:
    """Sampled keys that cut the suffixes of `runs` into about n_ranges ranges."""
    if n_ranges < 2:
        return []
    share = min(1.0, OVERSAMPLED * n_ranges / max(1, n_starts / (WINDOW / 2)))
    draw = F.pmod(F.xxhash64("k1", "k2", "lo"), F.lit(1 << 30)) / float(1 << 30)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, place in zip(batch.column("bytes").to_pylist(), batch.column("place").to_pylist()):
                x = (len(text) - LENGTH + 1) // 2  # the middle start's key stands for all of them
                out.append(Suffixes(np.frombuffer(text, np.uint8), np.array([x]), np.array([place - x])).key(0))
            yield pa.record_batch([pa.array(out, pa.binary())], ["key"])

    drawn = runs.filter((draw < share) & (F.octet_length("bytes") >= LENGTH)).select("bytes", "place").mapInArrow(key, "key binary")
    sample = sorted(drawn.toArrow().column("key").to_pylist())  # about OVERSAMPLED * n_ranges
    return [sample[i] for i in np.linspace(0, len(sample) - 1, n_ranges + 1).astype(int)[1:-1]] if sample else []


def _ranges(keys: list[bytes], s: Suffixes) -> np.ndarray:
    """The range of each suffix. Most are told by the anchor's first word; of keys that are equal
    to splitters, each goes to one of the ranges that these splitters bound."""
    leads = np.array([int.from_bytes(k[:WORD], "big") for k in keys], np.uint64)
    lead = s.words[s.at + s.place].astype(np.uint64)
    out = np.searchsorted(leads, lead, "left")
    for k in np.flatnonzero(np.searchsorted(leads, lead, "right") > out).tolist():
        key = s.key(k)
        a, b = bisect_left(keys, key), bisect_right(keys, key)
        out[k] = a + int(s.at[k]) % (b - a + 1)
    return out


#: What a task says about starts: runs of starts that repeat (kind 0), or the start of an edge
#: key, the key, and whether it repeats in its range (kind 1; lo is -1 for a witness).
_SAID = {"kind": pa.int8(), "k1": pa.int64(), "k2": pa.int64(), "lo": pa.int32(), "hi": pa.int32(), "edge": pa.binary(), "many": pa.bool_()}
_SAID_SCHEMA = "kind byte, k1 long, k2 long, lo int, hi int, edge binary, many boolean"
#: What it sends to a range: pieces (runs of starts), as columns of bytes, and their text.
_SENT = {"bucket": pa.int32(), **{f"c{i}": pa.binary() for i in range(7)}}
_SENT_SCHEMA = "bucket int, " + ", ".join(f"c{i} binary" for i in range(7))
_PIECE = [np.int64, np.int64, np.int32, np.int32, np.uint8, np.uint8, np.uint8]  # k1, k2, lo, n, place, flag, text


def _batch(columns: dict[str, pa.Array], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    """A batch of all `kinds`; columns that are not given are null."""
    n = len(next(iter(columns.values())))
    return pa.record_batch([columns[c] if c in columns else pa.nulls(n, t) for c, t in kinds.items()], list(kinds))


def _repeating(k1: np.ndarray, k2: np.ndarray, at: np.ndarray) -> dict[str, pa.Array]:
    """Starts that repeat, as runs."""
    order = np.lexsort((at, k2, k1))
    k1, k2, at = k1[order], k2[order], at[order]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    first, n = _pieces(new)
    return {"kind": pa.array(np.zeros(len(first), np.int8)), "k1": pa.array(k1[first]), "k2": pa.array(k2[first]), "lo": pa.array(at[first]), "hi": pa.array((at[first] + n - 1).astype(np.int32))}


def _sending(data: np.ndarray, at: np.ndarray, n: np.ndarray, cols: list[np.ndarray], bucket: np.ndarray) -> dict[str, pa.Array]:
    """One row for each bucket: its pieces' columns as blocks of bytes, and their text."""
    order = np.argsort(bucket, kind="stable")
    bucket, cols = bucket[order], [c[order] for c in cols]
    _, i = _starts(n[order] + LENGTH - 1, at[order])
    text, ends = data[i], np.cumsum(n[order] + LENGTH - 1)
    cut = _groups(bucket)
    blobs = [[_blob(c[a:b]) for a, b in cut] for c in cols] + [[_blob(text[ends[a - 1] if a else 0 : ends[b - 1]]) for a, b in cut]]
    return {"bucket": pa.array([int(bucket[a]) for a, _ in cut], pa.int32()), **{f"c{i}": pa.array(x, pa.binary()) for i, x in enumerate(blobs)}}


def _suffixes(n: np.ndarray, place: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, Suffixes]:
    """The piece of each start, its number in it, and the strings of pieces of n starts each, whose
    texts follow each other in `data`; `place` is that of the anchor in a piece's first string."""
    size = n.astype(np.int64) + LENGTH - 1
    first = np.cumsum(size) - size
    piece, at = _starts(n.astype(np.int64), first)
    within = at - first[piece]
    return piece, within, Suffixes(data, at, place[piece].astype(np.int64) - within)


def _deal(batches: Iterator[pa.RecordBatch], split: list[bytes], fan: int) -> Iterator[pa.RecordBatch]:
    """Stretches to pieces for their ranges. Suffixes are sorted here already: of those that are
    held twice one goes on for all (flag 1), the others are known to repeat (flag 2: a witness,
    which is itself settled)."""
    kinds = _SENT | _SAID
    held, size = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        k1, k2, lo, place, state = (np.concatenate([h[i] for h in held]) for i in range(5))
        data = np.frombuffer(b"".join(t for h in held for t in h[5]), np.uint8)
        length = np.array([len(t) for h in held for t in h[5]], np.int64)
        held.clear()
        run, within, s = _suffixes(length - LENGTH + 1, place, data)
        order, differs = multikey_quicksort(len(run), KEY_WORDS, s.word)
        group = np.cumsum(differs) - 1
        twice, first = np.zeros(len(run), bool), np.zeros(len(run), bool)
        twice[order], first[order] = np.bincount(group)[group] > 1, differs
        start, state = (lo[run] + within).astype(np.int32), state[run]
        hit = np.flatnonzero(~first & (state == 0))
        yield _batch(_repeating(k1[run[hit]], k2[run[hit]], start[hit]), kinds)
        to = _ranges(split, s) * fan
        if fan > 1:
            to += _spread(B.Spans(data).of(s.at, s.at + LENGTH), fan)
        flag = twice.astype(np.uint8) | (state == 2).astype(np.uint8) << 1
        kept = np.flatnonzero(first)
        new = np.ones(len(kept), bool)
        new[1:] = kept[1:] != kept[:-1] + 1
        for x in (run, to, flag):
            new[1:] |= x[kept[1:]] != x[kept[:-1]]
        begin, n = _pieces(new)
        a = kept[begin]
        yield _batch(_sending(data, s.at[a], n, [k1[run[a]], k2[run[a]], start[a], n.astype(np.int32), s.place[a].astype(np.uint8), flag[a]], to[a]), kinds)

    for batch in batches:
        held.append([*(batch.column(c).to_numpy() for c in ("k1", "k2", "lo", "place", "state")), batch.column("bytes").to_pylist()])
        size += sum(map(len, held[-1][5])) - (LENGTH - 1) * len(batch)
        if size > 2 * BUCKET:
            yield from flush()
            size = 0
    if size:
        yield from flush()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges, one after the other: sorted, neighbours compared. The first and the last key may go
    on in other ranges, so a row tells about each."""

    def close(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        k1, k2, lo, n, place, flag, data = (np.concatenate([h[i] for h in held]) for i in range(7))
        piece, within, s = _suffixes(n, place, data)
        order, differs = multikey_quicksort(len(piece), KEY_WORDS, s.word)
        group, row = np.cumsum(differs) - 1, piece[order]
        f, start = flag[row], (lo[piece] + within).astype(np.int32)[order]
        many = (np.bincount(group)[group] > 1) | (np.bincount(group, f & 1)[group] > 0)
        hit = many & (f & 2 == 0)
        yield _batch(_repeating(k1[row[hit]], k2[row[hit]], start[hit]), _SAID)
        at = np.unique(np.searchsorted(group, [0, group[-1]]))
        lo_ = pa.array(np.where(f[at] & 2, -1, start[at]).astype(np.int32))
        edge = [s.key(int(k)) for k in order[at]]
        yield _batch({"kind": pa.array(np.ones(len(at), np.int8)), "k1": pa.array(k1[row[at]]), "k2": pa.array(k2[row[at]]), "lo": lo_, "hi": lo_, "edge": pa.array(edge, pa.binary()), "many": pa.array(many[at])}, _SAID)

    current, held = None, []
    for batch in batches:
        sent = batch.column("bucket").is_valid()
        said = batch.select(list(_SAID)).filter(pa.compute.invert(sent))
        if len(said):
            yield said
        for r in np.flatnonzero(sent.to_numpy(zero_copy_only=False)).tolist():
            b = batch.column("bucket")[r].as_py()
            if b != current and held:
                yield from close(held)
                held = []
            current = b
            held.append([np.frombuffer(batch.column(f"c{i}")[r].as_py(), kind) for i, kind in enumerate(_PIECE)])
    if held:
        yield from close(held)


def repeated_starts(runs: DataFrame, n_starts: int) -> DataFrame:
    """(k1, k2, lo, hi): starts of the open runs whose LENGTH bytes also start elsewhere.

    `runs` are stretches. Their suffixes are cut into ranges by sampled splitters on the leading
    bytes. Each range is sorted by multikey quicksort and neighbours are compared, as are the
    first and the last key of each range with those of others: keys that are equal to a
    splitter lie on both sides of it."""
    n_buckets = max(1, -(-n_starts // BUCKET))
    keys = splitters(runs, n_starts, min(n_buckets, MAX_SPLITTERS))
    fan = max(1, -(-n_buckets // (len(keys) + 1)))
    shared = runs.sparkSession.sparkContext.broadcast(keys)
    dealt = runs.mapInArrow(lambda it: _deal(it, shared.value, fan), f"{_SENT_SCHEMA}, {_SAID_SCHEMA}")
    to = F.coalesce(F.col("bucket"), F.pmod(F.xxhash64("k1"), F.lit(max(8, n_buckets))).cast("int"))
    out = dealt.withColumn("to", to).repartition("to").sortWithinPartitions("bucket").drop("to").mapInArrow(_meet, _SAID_SCHEMA)
    out = table(out, "suffix-starts")
    # A key that is alone in its range repeats if another range has it too.
    edges = out.filter("kind = 1")
    again = edges.groupBy("edge").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("edge")
    crossed = edges.filter("lo >= 0 and not many").join(again, "edge").select("k1", "k2", "lo", "hi")
    return out.filter("kind = 0").select("k1", "k2", "lo", "hi").unionAll(crossed)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """The bytes of each text that lie in a string of LENGTH bytes which also starts elsewhere.

    All suffixes would be two hundred times the text, so anchors thin them out without loss:
    each start belongs to the least 64-byte gram of its string. Anchors that occur once end
    there; stretches between anchors that occur twice as a whole are settled as a whole; the
    suffixes at all other starts are range-partitioned by sampled splitters, sorted by multikey
    quicksort and compared with their neighbours.

    `docs` has k1 and k2, a key of each row's doc_id and text. Returns k1, k2, starts (runs lo ..
    hi of starts, in bytes) for texts that have any. Matches never cross texts; a text of fewer
    bytes, or null, has none; rows of one doc_id and text count as copies of each other."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    runs = table(anchor_runs(docs, max(1, int(total / 60 / BUCKET))), "suffix-anchors")
    cut = table(stretches(docs, runs.filter("state <> 1")), "suffix-stretches")
    n_starts = cut.agg(F.sum(F.octet_length("bytes") - LENGTH + 1)).first()[0] or 0
    starts = repeated_starts(cut, n_starts)
    settled = runs.filter("state > 0").select("k1", "k2", "lo", "hi")
    return settled.unionAll(starts).groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("starts"))


def remove_repeated(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (remaining bytes) and kept_sha256 of each row.
    Only texts that may lose bytes, by a filter of bounded size, are met by a shuffle."""
    spans = table(spans, "suffix-spans")
    keys = KeyFilter(spans, "k1")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = batch.column("starts")
            size, gone, n_spans, kept, digest = [], [], [], [], []
            for lo, hi, data, offs in B.text_chunks(batch.column("text")):
                for r in range(lo, hi):
                    text = data[offs[r - lo] : offs[r - lo + 1] - 1]
                    size.append(len(text))
                    if starts[r].is_valid:
                        mark = np.zeros(len(text) + 1, np.int32)
                        v = starts[r].values
                        np.add.at(mark, v.field("lo").to_numpy(), 1)
                        np.add.at(mark, v.field("hi").to_numpy() + LENGTH, -1)
                        out = np.cumsum(mark[:-1]) > 0
                        gone.append(int(out.sum()))
                        n_spans.append(len(B.runs(out)[0]))
                        text = text[~out]
                    else:
                        gone.append(0)
                        n_spans.append(0)
                    kept.append(text.tobytes())
                    digest.append(hashlib.sha256(kept[-1]).hexdigest())
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, gone, n_spans)), pa.array(kept, pa.binary()), pa.array(digest, pa.string())], names)

    long = [T.StructField(c, T.LongType()) for c in names[1:4]]
    schema = T.StructType([docs.schema["doc_id"], *long, T.StructField("kept", T.BinaryType()), T.StructField("kept_sha256", T.StringType())])
    none = F.lit(None).cast(spans.schema["starts"].dataType).alias("starts")
    clean = keys.maybe(docs, "k1", False).select("doc_id", "text", none)
    met = keys.maybe(docs, "k1").join(spans, ["k1", "k2"], "left").select("doc_id", "text", "starts")
    return clean.unionAll(met).mapInArrow(cut, schema)


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """Find and remove the repeated bytes of all texts; see repeated_spans. Rows are met by a key
    of 128 bits of doc_id and text; repeated rows are copies of each other and each keeps a row;
    texts of any length are cut into stretches; an empty table gives an empty one; other columns
    are ignored, whatever their names."""
    bound_batches(docs.sparkSession)
    keys = [F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias(f"k{seed}") for seed in (1, 2)]
    docs = docs.select(*keys, "doc_id", "text")
    return remove_repeated(docs, repeated_spans(docs))
