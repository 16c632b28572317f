"""Hard-negative mining with rotated one-bit codes and deterministic score intervals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import batches_of, table
from .vectors import fit_vectors, whole

#: A component x counts as floor(SCALE * x).
SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: Rows of a packed block, and blocks that a cell of the grid has of each side.
BLOCK, ANCHOR_BLOCKS, ROW_BLOCKS = 1024, 4, 16
#: Bits of an anchor's rotated entries, one plane each.
PLANES = 8
#: Of a tile, the share of pairs whose intervals stay open from which whole rows and columns are scored.
DENSE = 0.02


def rotation(d: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same for all tasks."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


class Codes:
    """One bit for each rotated entry of some vectors, the norm of each vector, and how well its
    code aligns with it: the inner product of the unit vector with the unit code."""

    def __init__(self, x: np.ndarray, turn: np.ndarray):
        y = x @ turn
        d = x.shape[1]
        self.bits = np.packbits(y > 0, axis=1, bitorder="little")
        self.norm = np.sqrt((x * x).sum(1))
        self.align = np.where(self.norm > 0, np.abs(y).sum(1) / np.sqrt(d) / np.maximum(self.norm, 1e-300), 1.0)


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 64-bit words."""
    n, w = bits.shape
    out = np.zeros((n, -(-w // 8) * 8), np.uint8)
    out[:, :w] = bits
    return out.view(np.uint64)


class Queries:
    """Anchors whose rotated entries are PLANES-bit numbers, as bit planes, so that inner products
    with one-bit codes are sums of popcounts."""

    def __init__(self, x: np.ndarray, turn: np.ndarray):
        y, d = x @ turn, x.shape[1]
        low, high = y.min(1, keepdims=True), y.max(1, keepdims=True)
        self.low, self.step = low[:, 0], np.maximum((high - low)[:, 0] / ((1 << PLANES) - 1), 1e-300)
        level = np.clip(np.rint((y - low) / self.step[:, None]), 0, (1 << PLANES) - 1).astype(np.int64)
        rounded = low + level * self.step[:, None]
        self.planes = [_words(np.packbits(level >> b & 1, axis=1, bitorder="little")) for b in range(PLANES)]
        self.total = level.sum(1)
        self.norm = np.sqrt((x * x).sum(1))
        self.lost = np.sqrt(((y - rounded) ** 2).sum(1))
        self.root = np.sqrt(d)

    def interval(self, at: slice, codes: Codes, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the inner products of anchors `at` with coded vectors, one row for each anchor.

        Let u be a vector's unit code and c its alignment: v = |v| (c u + r) with r orthogonal to u
        and |r|^2 = 1 - c^2. Then q.v = |v| (c q.u + q.r), and by Cauchy and Schwarz |q.r| is at
        most |r| times what of q is orthogonal to u. q.u is known but for the rounding of q."""
        set_ = np.bitwise_count(bits).sum(1, dtype=np.int64)
        hits = sum((np.bitwise_count(p[at][:, None, :] & bits[None]).sum(2, dtype=np.int32) << b for b, p in enumerate(self.planes)), np.int32(0))
        low, step, total = (x[at][:, None] for x in (self.low, self.step, self.total))
        d = self.root**2
        # Signs are 2 bit - 1; a rounded entry is low + step * level.
        along = (low * (2 * set_ - d)[None] + step * (2 * hits - total)) / self.root
        lost, norm = self.lost[at][:, None], self.norm[at][:, None]
        c = np.minimum(codes.align, 1.0)
        rest = np.sqrt(np.maximum(norm**2 - np.maximum(np.abs(along) - lost, 0) ** 2, 0))
        wide = codes.norm * (c * lost + np.sqrt(np.maximum(1 - c * c, 0) + 1e-12) * rest)
        wide += 1e-9 * (norm * codes.norm + 1)  # of floating point
        mid = codes.norm * c * along
        return mid - wide, mid + wide


def packed(rows: DataFrame, d: int) -> DataFrame:
    """Blocks of up to BLOCK rows (vec_id, label, rid, vector): ids, labels and row numbers as
    bytes, the integer vectors, and with a rotation their codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(d)
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                x = whole(part.column("vector"), d, SCALE)
                codes = Codes(x, turn)
                longs = [part.column(c).to_numpy().astype(np.int64).tobytes() for c in ("vec_id", "label", "rid")]
                blobs = [*longs, x.astype(np.float32 if np.abs(x).max(initial=0) < 1 << 24 else np.float64).tobytes(), codes.bits.tobytes(), np.stack([codes.norm, codes.align]).tobytes()]
                yield pa.record_batch([pa.array([b], pa.binary()) for b in blobs], ["ids", "labels", "rids", "x", "bits", "bounds"])

    return rows.select("vec_id", "label", "rid", "vector").mapInArrow(run, "ids binary, labels binary, rids binary, x binary, bits binary, bounds binary")


class Block:
    """A packed block in memory."""

    def __init__(self, row: dict, d: int):
        self.ids, self.labels, self.rids = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels", "rids"))
        n = len(self.ids)
        self.x = np.frombuffer(row["x"], np.float32 if len(row["x"]) == 4 * n * d else np.float64).astype(np.float64).reshape(n, d)
        self.codes = Codes.__new__(Codes)
        self.codes.bits = np.frombuffer(row["bits"], np.uint8).reshape(n, -1)
        self.codes.norm, self.codes.align = np.frombuffer(row["bounds"], np.float64).reshape(2, n)
        self.bits = _words(self.codes.bits)


def score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of a with those of b. Doubles are exact while sums stay
    below 2^53; beyond that Python's integers are taken."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 1 << 53:
        return (a @ b.T).astype(np.int64)
    out = a.astype(np.int64).astype(object) @ b.astype(np.int64).astype(object).T
    if max(map(abs, out.ravel()), default=0) >= 1 << 63:
        raise OverflowError("a score does not fit a long")
    return out.astype(np.int64)


def score_open(open_: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores of the pairs that are open; of others what is at hand."""
    out = np.zeros(open_.shape, np.int64)
    if open_.mean() < DENSE and np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 1 << 53:
        i, j = np.nonzero(open_)
        out[i, j] = np.einsum("ij,ij->i", a[i], b[j]).astype(np.int64)
    else:
        i, j = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
        out[np.ix_(i, j)] = score(a[i], b[j])
    return out


class Best:
    """The first k rows found so far for each of n lists: higher scores, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k, self.rows = k, [np.zeros((0, 3), np.int64) for _ in range(n)]
        self.bar = np.full(n, np.iinfo(np.int64).min)

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray, rids: np.ndarray) -> None:
        rows = np.concatenate([self.rows[i], np.stack([scores, ids, rids], 1)])
        self.rows[i] = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))[: self.k]]
        if len(self.rows[i]) == self.k:
            self.bar[i] = self.rows[i][-1, 0]


def _kth_highest(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th highest of each row; rows hold -inf for what doesn't count."""
    return np.full(len(x), -np.inf) if x.shape[1] < k else np.partition(x, x.shape[1] - k, 1)[:, x.shape[1] - k]


def find_positives(q: Queries, block: Block, anchors: Block, at: slice, best: Best) -> None:
    """Rows of the anchor's label, but the anchor itself."""
    same = (anchors.labels[at][:, None] == block.labels[None]) & (anchors.rids[at][:, None] != block.rids[None])
    lo, hi = q.interval(at, block.codes, block.bits)
    bar = np.maximum(best.bar[at], _kth_highest(np.where(same, lo, -np.inf), best.k))
    open_ = same & (hi >= bar[:, None])
    scores = score_open(open_, anchors.x[at], block.x)
    for r in np.flatnonzero(open_.any(1)).tolist():
        j = np.flatnonzero(open_[r] & (scores[r] >= best.bar[at][r]))
        if len(j):
            best.add(at.start + r, scores[r, j], block.ids[j], block.rids[j])


def find_negatives(q: Queries, block: Block, anchors: Block, at: slice, best: Best, limits: np.ndarray) -> None:
    """Rows of other labels whose scores lie within the limits of one of the anchor's positives."""
    n, k = limits.shape[1], best.k
    other = anchors.labels[at][:, None] != block.labels[None]
    lo, hi = q.interval(at, block.codes, block.bits)
    open_ = np.zeros(other.shape, bool)
    for p in range(n):
        least, most = (limits[at, p, e][:, None] for e in (0, 1))
        surely = np.where(other & (lo >= least) & (hi <= most), lo, -np.inf)
        bar = np.maximum(best.bar[np.arange(at.start, at.stop) * n + p], _kth_highest(surely, k))
        open_ |= other & (hi >= np.maximum(least, bar[:, None])) & (lo <= most)
    scores = score_open(open_, anchors.x[at], block.x)
    for r in np.flatnonzero(open_.any(1)).tolist():
        for p in range(n):
            i, (least, most) = (at.start + r) * n + p, limits[at.start + r, p]
            j = np.flatnonzero(open_[r] & (scores[r] >= max(least, best.bar[i])) & (scores[r] <= most))
            if len(j) > 8 * k:  # the k-th highest and what is equal to it
                j = j[scores[r, j] >= np.partition(scores[r, j], len(j) - k)[len(j) - k]]
            if len(j):
                best.add(i, scores[r, j], block.ids[j], block.rids[j])


def grid(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, d: int, search: Callable[[list[dict], Iterator[Block]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Meet all blocks of anchors with all blocks of rows. A cell of the grid has up to
    ANCHOR_BLOCKS blocks of anchors, held in memory, and a stream of blocks of rows."""
    tall, wide = max(1, -(-n_anchors // ANCHOR_BLOCKS)), max(1, -(-n_rows // ROW_BLOCKS))
    deal = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "rids"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sides = anchors.select(F.lit(0).alias("kind"), deal(tall, 1).alias("i"), each(wide).alias("j"), "*")
    other = rows.select(F.lit(1).alias("kind"), each(tall).alias("i"), deal(wide, 2).alias("j"), "*")
    cells = sides.unionByName(other, allowMissingColumns=True).repartition("i", "j").sortWithinPartitions("i", "j", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = ((r["i"], r["j"], r["kind"], r) for b in batches for k in range(len(b)) for r in b.slice(k, 1).to_pylist())
        nxt = next(stream, None)
        while nxt:
            cell, held = nxt[:2], []
            while nxt and nxt[:3] == (*cell, 0):
                held.append(nxt[3])
                nxt = next(stream, None)

            def blocks() -> Iterator[Block]:
                nonlocal nxt
                while nxt and nxt[:2] == cell:
                    yield Block(nxt[3], d)
                    nxt = next(stream, None)

            if held:
                yield from search(held, blocks())
            for _ in blocks():
                pass

    return cells.mapInArrow(run, schema)


#: Anchors of a tile.
TILE = 128


def _tiles(n: int) -> list[slice]:
    return [slice(a, min(n, a + TILE)) for a in range(0, n, TILE)]


def positives(anchors: DataFrame, rows: DataFrame, sizes: tuple[int, int], d: int, k: int) -> DataFrame:
    """(rid, place, id, score): the first k rows of each anchor's label."""

    def search(held: list[dict], blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        turn = rotation(d)
        mine = [Block(h, d) for h in held]
        queries, best = [Queries(m.x, turn) for m in mine], [Best(len(m.ids), k) for m in mine]
        for block in blocks:
            for m, q, b in zip(mine, queries, best):
                for at in _tiles(len(m.ids)):
                    find_positives(q, block, m, at, b)
        for m, b in zip(mine, best):
            found = np.concatenate(b.rows or [np.zeros((0, 3), np.int64)])
            rid = np.repeat(m.rids, [len(x) for x in b.rows])
            yield pa.record_batch([pa.array(rid), *(pa.array(np.ascontiguousarray(found[:, c])) for c in (1, 2, 0))], ["rid", "id", "other", "score"])

    found = grid(anchors, rows, *sizes, d, search, "rid long, id long, other long, score long")
    place = F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("score"), "id", "other"))
    return found.withColumn("place", place).filter(F.col("place") <= k).select("rid", "place", "id", "score")


def negatives(anchors: DataFrame, rows: DataFrame, sizes: tuple[int, int], d: int, k: int, limits: tuple[int, int]) -> DataFrame:
    """(rid, anchor_id, place, positive_id, positive_score, rank, negative_id, negative_score).
    `anchors` are blocks with their rows' positives: (places, pids, pscores), k each, padded."""

    def search(held: list[dict], blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        turn = rotation(d)
        mine = [Block(h, d) for h in held]
        given = [[np.frombuffer(h[c], np.int64).reshape(len(m.ids), -1) for c in ("pids", "pscores", "there")] for h, m in zip(held, mine)]
        queries, ends = [Queries(m.x, turn) for m in mine], []
        for _, s, there in given:
            # lower * s <= 100 * score <= upper * s, in whole numbers; nothing lies between for no positive
            ends.append(np.stack([np.where(there > 0, -(-limits[0] * s // 100), 1), np.where(there > 0, limits[1] * s // 100, 0)], 2))
        best = [Best(e.shape[0] * e.shape[1], k) for e in ends]
        for block in blocks:
            for m, q, b, e in zip(mine, queries, best, ends):
                for at in _tiles(len(m.ids)):
                    find_negatives(q, block, m, at, b, e)
        for m, b, (pids, scores, there) in zip(mine, best, given):
            n = pids.shape[1]
            sizes_ = [len(x) for x in b.rows]
            found, of = np.concatenate(b.rows or [np.zeros((0, 3), np.int64)]), np.repeat(np.arange(len(b.rows)), sizes_)
            columns = [m.rids[of // n], m.ids[of // n], of % n, pids.ravel()[of], scores.ravel()[of], found[:, 1], found[:, 2], found[:, 0]]
            yield pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in columns], ["rid", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "other", "negative_score"])

    found = grid(anchors, rows, *sizes, d, search, "rid long, anchor_id long, place long, positive_id long, positive_score long, negative_id long, other long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("rid", "place").orderBy(F.desc("negative_score"), "negative_id", "other"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _with_positives(blocks: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Blocks of anchors with the ids and scores of their rows' positives, in order, and whether
    there is one."""
    lists = found.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("found"))
    rids = blocks.select(F.xxhash64("rids").alias("block"), "rids")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("rids").to_pylist()):
                rid = np.frombuffer(blob, np.int64)
                yield pa.record_batch([pa.array(np.full(len(rid), block)), pa.array(np.arange(len(rid))), pa.array(rid)], ["block", "at", "rid"])

    met = rids.mapInArrow(spread, "block long, at long, rid long").join(lists, "rid", "left")
    met = met.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "found"))).alias("rows"))  # BLOCK rows at most

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, rows in zip(batch.column("block").to_pylist(), batch.column("rows").to_pylist()):
                out = np.zeros((3, len(rows), k), np.int64)
                for r in rows:
                    for p, x in enumerate(r["found"] or []):
                        out[:, r["at"], p] = x["id"], x["score"], 1
                yield pa.record_batch([pa.array([block]), *(pa.array([x.tobytes()], pa.binary()) for x in out)], ["block", "pids", "pscores", "there"])

    given = met.mapInArrow(gather, "block long, pids binary, pscores binary, there binary")
    return blocks.withColumn("block", F.xxhash64("rids")).join(given, "block").drop("block")


def hard_negatives(rows: DataFrame, every: int = 50, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, limits: tuple[int, int] = (50, 95)) -> DataFrame:
    """For each anchor (vec_id divisible by `every`) its first n_positives rows of the same label,
    and for each of these the first n_negatives rows of other labels whose score lies between
    limits[0] and limits[1] percent of the positive's.

    `rows` has vec_id, label (whole numbers) and vector. A score is the inner product of the
    vectors' components, each as floor(SCALE * x); higher ones come first, ties by smaller vec_id.

    Each vector has a one-bit code after a random rotation, its norm, and its alignment with the
    code. Popcounts estimate a score, and the Cauchy-Schwarz inequality bounds the rest, surely:
    only rows whose interval may reach an anchor's list, whole or so far, are scored in integers.
    Anchors and rows meet in a grid of cells, whatever their labels, so no label is a hot key; a
    cell returns its best rows, and a window over these the final ones.

    Rows with a null id or label, or a vector that fit_vectors leaves out, take no part. Rows that
    repeat count each; of equal score and id, any order. No anchor, no positive or no row within
    the limits gives no row; so does an empty table. Other columns are ignored."""
    rows = rows.select("vec_id", "label", "vector").filter("vec_id is not null and label is not null")
    rows, d = fit_vectors(rows, "vector")
    spark = rows.sparkSession
    kinds = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not d:
        return spark.createDataFrame([], kinds)
    rows = table(rows.withColumn("rid", F.monotonically_increasing_id()), "negatives-rows")
    with batches_of(spark, "2m"):
        blocks = table(packed(rows, d), "negatives-blocks")
        anchors = table(packed(rows.filter(F.col("vec_id") % every == 0).repartition(max(1, spark.sparkContext.defaultParallelism)), d), "negatives-anchors")
        sizes = (anchors.count(), blocks.count())
        found = table(positives(anchors, blocks, sizes, d, n_positives), "negatives-positives")
        given = table(_with_positives(anchors, found, n_positives), "negatives-given")
        out = table(negatives(given, blocks, sizes, d, n_negatives, limits), "negatives-found")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
