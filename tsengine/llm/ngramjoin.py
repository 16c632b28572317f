"""N-gram Jaccard self-join by T-occurrence search (DivideSkip), reduced to components."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytetext as B
from .graph import components
from .store import batches_of, row_key, table, with_texts

WORDS = 5
#: Jaccard similarity of at least PERCENT / 100.
PERCENT = 80
#: Shingles kept as frequent, most frequent first: 16 bytes each in a broadcast. Only the order
#: of tokens depends on them, and with it the size of groups; no result does.
MAX_FREQUENT = 1 << 18
#: Hashes counted together, and the count from which a shingle is reported.
COUNTED, REPORTED = 1 << 22, 3
#: Documents, and shingles, of one block of the inverted index.
BLOCK, WEIGHT = 2048, 400_000
#: Text that a task works on at once, in bytes.
TEXT = 1 << 18
#: Sets among which a map task finds copies.
SEEN = 100_000
#: Least number of a signature's bits; it has at least one for each shingle.
SIG_BITS = 2048
#: DivideSkip's weight of a long list (Li, Lu and Lu, 2008).
MU = 0.0085


def document_sets(data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    data = B.LOWER[data]
    s, e, first = B.words(data, starts, ~B.SPACES)
    h = B.span_hashes(data, s, e, 1)[0]
    g = B.shingles(h, WORDS)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        n = b - a
        out.append(np.unique(g[a : b - WORDS + 1]) if n >= WORDS else B.shingles(h[a:b], n)[:1] if n else g[:0])
    return out


def required(n: int) -> int:
    """Overlap that any partner of a set of n shingles must reach; also its least size."""
    return -(-PERCENT * n // 100)


def required_of_larger(n: int) -> int:
    """Overlap that a partner of at least n shingles must reach."""
    return -(-2 * PERCENT * n // (100 + PERCENT))


def divide_skip(lists: list[list[int]], t: int) -> dict[int, int]:
    """Elements that occur in at least t of the sorted lists, with their number of lists.

    The longest lists are set aside; the others are merged with a heap, skipping what can't
    reach the rest of t, and the survivors are looked up in the long lists by binary search."""
    lists = sorted(lists, key=len)
    if len(lists) < t or not lists:
        return {}
    n_long = min(t - 1, int(t / (MU * math.log2(max(2, len(lists[-1]))) + 1)))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    need, out = t - n_long, {}
    at = [0] * len(short)
    heap = [(x[0], i) for i, x in enumerate(short) if x]
    heapq.heapify(heap)
    while len(heap) >= need:
        value, popped = heap[0][0], []
        while heap and heap[0][0] == value:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= need:
            n, left = len(popped), len(long)
            for x in reversed(long):
                if n + left < t:
                    break
                left -= 1
                j = bisect_left(x, value)
                n += j < len(x) and x[j] == value
            if n >= t:
                out[value] = n
            target = value + 1
        else:
            while len(popped) < need - 1 and heap:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                break
            target = heap[0][0]
        for i in popped:
            at[i] = bisect_left(short[i], target, at[i])
            if at[i] < len(short[i]):
                heapq.heappush(heap, (short[i][at[i]], i))
    return out


def signature(u: np.ndarray) -> np.ndarray:
    """How often each class of hashes, modulo a power of two above len(u), occurs: the parities.
    Sets that differ in d shingles differ in at most d parities."""
    bits = max(SIG_BITS, 1 << int(len(u)).bit_length())
    return np.packbits((np.bincount((u & B.U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)).view(np.uint64)


def _folded(sig: np.ndarray, words: int) -> np.ndarray:
    """Signatures (rows) of a smaller power of two: the halves laid onto each other."""
    while sig.shape[1] > words:
        half = sig.shape[1] // 2
        sig = sig[:, :half] ^ sig[:, half:]
    return sig


class Bounds:
    """Sizes and signatures of some sets, to tell which may be linked."""

    def __init__(self, n: np.ndarray, signatures: list[np.ndarray]):
        self.n, self.words = n, np.array([len(x) for x in signatures], np.int64)
        self.place = np.zeros(len(n), np.int64)
        self.rows = {}
        for words in np.unique(self.words).tolist():
            at = np.flatnonzero(self.words == words)
            self.place[at] = np.arange(len(at))
            self.rows[words] = np.stack([signatures[i] for i in at])

    def may_link(self, q: int, at: np.ndarray) -> np.ndarray:
        """Which of the sets `at` have a size and a signature that allow a link with set q."""
        n = self.n
        at = at[100 * np.minimum(n[at], n[q]) >= PERCENT * np.maximum(n[at], n[q])]
        mine, apart = self.rows[int(self.words[q])][self.place[q], None], np.zeros(len(at), np.int64)
        for words, rows in self.rows.items():
            k = np.flatnonzero(self.words[at] == words)
            if len(k):
                least = min(words, mine.shape[1])
                apart[k] = np.bitwise_count(_folded(rows[self.place[at[k]]], least) ^ _folded(mine, least)).sum(1, dtype=np.int64)
        return at[(100 + PERCENT) * apart <= (100 - PERCENT) * (n[at] + n[q])]


class BlockIndex:
    """The inverted lists of one block of sets: token -> sorted positions of the sets that hold it."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.n = sets, np.array([len(u) for u in sets], np.int64)
        token, member = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.n)
        order = np.argsort(token, kind="stable")
        token, member = token[order], member[order]
        begin = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        size = np.diff(np.append(begin, len(token)))
        shared = size > 1  # a list of one holds nothing but the query itself
        self.token, self.begin, self.end = token[begin[shared]], begin[shared], (begin + size)[shared]
        self.member = member.tolist()
        self.bounds = Bounds(self.n, [signature(u) for u in sets])

    def open_partners(self, q: int, component: np.ndarray) -> bool:
        """Whether a set of another component is left whose size and signature allow a link."""
        return len(self.bounds.may_link(q, np.flatnonzero(component != component[q]))) > 0

    def search(self, q: int) -> list[int]:
        """The sets similar to set q: those that reach the overlap any partner must reach, by
        T-occurrence search over q's lists, and then that of their own size."""
        u, n = self.sets[q], self.n
        at = np.minimum(np.searchsorted(self.token, u), max(0, len(self.token) - 1))
        at = at[self.token[at] == u] if len(self.token) else at[:0]
        t = required(len(u))
        if len(at) < t:
            return []
        lists = [self.member[a:b] for a, b in zip(self.begin[at].tolist(), self.end[at].tolist())]
        return [d for d, o in divide_skip(lists, t).items() if d != q and 100 * o >= PERCENT * (int(n[q] + n[d]) - o)]


def links(index: BlockIndex, component: np.ndarray, queries: list[int], lead: int | None = None) -> list[tuple[int, int]]:
    """Links that join the components of a block as far as any link between a query and another
    set does; `component` follows.

    With a lead, which is searched first, sets that are linked to it are no queries any more:
    they are joined already, and their links to others are found from those."""
    out = []

    def run(q: int) -> list[int]:
        found = index.search(q)
        for d in found:
            if component[d] != component[q]:
                component[component == component[d]] = component[q]
                out.append((q, d))
        return found

    if lead is not None:
        near = {lead, *run(lead)}
        queries = [q for q in queries if q not in near]
    for q in queries:
        if index.open_partners(q, component):
            run(q)
    return out


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles and their counts, from all documents. Counts of less than
    REPORTED within COUNTED hashes are left out; only the order of tokens depends on them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held or [np.zeros(0, B.U)]), return_counts=True)
            top = counts >= REPORTED
            return pa.record_batch([pa.array(keys[top].view(np.int64)), pa.array(counts[top].astype(np.int64))], ["token", "n"])

        for batch in batches:
            for _, _, data, starts in B.text_chunks(batch.column("text"), TEXT):
                held += document_sets(data, starts)
                n = sum(map(len, held[-(len(starts) - 1) :])) + n
                if n >= COUNTED:
                    yield flush()
                    held, n = [], 0
        yield flush()

    top = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(MAX_FREQUENT).toArrow()
    token, n = (top.column(c).to_numpy() for c in ("token", "n"))
    order = np.argsort(token.view(B.U))
    return token.view(B.U)[order], n[order]


def profiles(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: size of its set, two hashes of the set, the first of the
    task's last SEEN sets that is the same (rep), and for that row the prefix tokens, a
    signature and a priority: the share of its tokens that are frequent, then a hash.

    Tokens are ordered by frequency, then hash. Two similar sets share one of their first
    n - required(n) + 1 tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, count = shared.value
        members, seen = B.Members(token), {}
        for batch in batches:
            rid = batch.column("rid").to_pylist()
            ns, h1, h2, reps, priority, prefixes, sigs = [], [], [], [], [], [], []
            if len(seen) > SEEN:
                seen.clear()
            for lo, _, data, starts in B.text_chunks(batch.column("text"), TEXT):
                for i, u in enumerate(document_sets(data, starts)):
                    n = len(u)
                    key = (n, int(B.mix(u.sum(dtype=B.U, keepdims=True)).view(np.int64)[0]), int(np.bitwise_xor.reduce(B.mix(u)).astype(B.U).view(np.int64)) if n else 0)
                    rep = seen.setdefault(key, rid[lo + i]) if n else rid[lo + i]
                    ns.append(n)
                    h1.append(key[1])
                    h2.append(key[2])
                    reps.append(rep)
                    if n == 0 or rep != rid[lo + i]:
                        prefixes.append(None)
                        priority.append(None)
                        sigs.append(None)
                        continue
                    rank = np.zeros(n, np.int64)
                    hit = members.where(u)
                    rank[hit] = count[np.searchsorted(token, u[hit])]
                    prefixes.append(u[np.lexsort((u, rank))][: n - required(n) + 1].view(np.int64))
                    priority.append((len(hit) * 0x7FFF // n) << 48 | key[1] & 0xFFFFFFFFFFFF)
                    sigs.append(signature(u).tobytes())
            same = [batch.column(c) for c in ("rid", "row_key", "doc_id")]
            yield pa.record_batch(
                [*same, *(pa.array(x, pa.int64()) for x in (ns, h1, h2, reps, priority)), pa.array(prefixes, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                ["rid", "row_key", "doc_id", "n", "h1", "h2", "rep", "priority", "prefix", "sig"],
            )

    long = [T.StructField(c, T.LongType()) for c in ("rid", "row_key", "n", "h1", "h2", "rep", "priority")]
    schema = T.StructType([*long[:2], docs.schema["doc_id"], *long[2:], T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())])
    return docs.select(F.monotonically_increasing_id().alias("rid"), row_key().alias("row_key"), "doc_id", "text").mapInArrow(run, schema)


def index_groups(sets: DataFrame) -> DataFrame:
    """(lead, rid, n, priority): groups such that two similar sets are together in one at least.

    The first token that two similar sets share lies among the first n - required(n) + 1 tokens
    of both, and of the smaller one's among the first n - required_of_larger(n) + 1: its core.
    So a token's list matters to sets that have it in their core, and to others that are no
    smaller than one of those. Of these sets the one of the highest priority is the list's lead.
    A set joins the groups of the leads of all its lists, so sets that share a token share a
    group. A set whose tokens are all frequent leads most lists of its copies, which keeps the
    groups of a set few. No list is ever gathered: leads are an aggregate, met again by a join."""
    core = f"pos <= n - int((2 * {PERCENT} * n + {99 + PERCENT}) div {100 + PERCENT})"
    postings = sets.select("rid", "n", "priority", F.posexplode("prefix").alias("pos", "token")).selectExpr("rid", "n", "priority", "token", f"{core} as core")
    least = F.min(F.when(F.col("core"), F.col("n"))).alias("least")
    leads = postings.groupBy("token").agg(F.max("priority").alias("lead"), least, F.count(F.lit(1)).alias("df")).filter("df > 1 and least is not null").drop("df")
    leads = table(leads, "jaccard-leads")  # a side of its own, so that a hot token's postings are split
    return postings.join(leads, "token").filter("core or n >= least or priority = lead").select("lead", "rid", "n", "priority").distinct()


def _weighed(n_rows: str, n_shingles: str) -> Column:
    """Blocks for so many sets with so many shingles."""
    return F.greatest(F.ceil(F.col(n_rows) / BLOCK), F.ceil(F.col(n_shingles) / WEIGHT)).cast("int")


def _dealt(rid: str, n: Column, seed: int) -> Column:
    """Which of n blocks a set goes to."""
    return F.pmod(F.xxhash64(F.lit(seed), rid), n).cast("int")


def _open_rows(rows: DataFrame) -> DataFrame:
    """Of groups of one block (lead, rid, n, sig, ...), the rows that have a partner whose size
    and signature allow a link; the texts of the others need not be met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def close() -> Iterator[pa.RecordBatch]:
            group = pa.Table.from_batches(held).combine_chunks()
            if len(group) > 1:
                bounds = Bounds(group.column("n").to_numpy(), [np.frombuffer(x, np.uint64) for x in group.column("sig").to_pylist()])
                keep = np.zeros(len(group), bool)
                for q in range(len(group) - 1):
                    at = bounds.may_link(q, np.arange(q + 1, len(group)))
                    keep[at] = True
                    keep[q] |= len(at) > 0
                yield from group.filter(pa.array(keep)).drop_columns(["n", "sig"]).to_batches()

        for batch in batches:
            lead = batch.column("lead").to_numpy()
            for a, b in _groups(lead):
                if lead[a] != key and held:
                    yield from close()
                    held = []
                key = lead[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from close()

    kept = T.StructType([f for f in rows.schema if f.name not in ("n", "sig")])
    return rows.repartition("lead").sortWithinPartitions("lead", "rid").mapInArrow(run, kept)


def _groups(x: np.ndarray) -> list[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


def _search(placed: DataFrame, docs: DataFrame) -> DataFrame:
    """Search the blocks of `placed`: (lead, part, rid, priority, comp, role, split, key, id). A
    block is the rows of one lead and part. Role 1 is a query; role 2 too, and leads the block.

    Returns (kind, u, v, lead, o, total). Kind 0: u and v are similar. Kind 1, for blocks that
    are parts of a split group: set u, the size of its intersection and of its union with the
    lead's."""
    wanted = table(placed, "jaccard-wanted")
    rows = with_texts(wanted, docs).select("lead", "part", "role", "priority", "rid", "comp", "split", "text")
    rows = rows.repartition("lead", "part").sortWithinPartitions("lead", "part", F.desc("priority"), "rid")
    names = ["kind", "u", "v", "lead", "o", "total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []  # held: rid, comp, role, split, set

        def close() -> None:
            if len(held) < 2:
                return
            rid, component = [h[0] for h in held], np.array([h[1] for h in held], np.int64)
            index = BlockIndex([h[4] for h in held])
            lead = 0 if held[0][2] == 2 else None
            out.extend((0, rid[a], rid[b], key[0], 0, 0) for a, b in links(index, component, [k for k, h in enumerate(held) if h[2]], lead))
            if lead is not None and held[0][3]:
                first = held[0][4]
                for r, _, _, _, u in held:
                    o = len(np.intersect1d(first, u, assume_unique=True))
                    out.append((1, r, r, key[0], o, len(first) + len(u) - o))

        def flush() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array([x[k] for x in out], pa.int64()) for k in range(6)], names)
            out.clear()
            return batch

        for batch in batches:
            lead, part, role, rid, comp, split = (batch.column(c).to_pylist() for c in ("lead", "part", "role", "rid", "comp", "split"))
            for lo, _, data, starts in B.text_chunks(batch.column("text"), TEXT):
                for i, u in enumerate(document_sets(data, starts), lo):
                    if (lead[i], part[i]) != key:
                        close()
                        key, held = (lead[i], part[i]), []
                        if len(out) > 10_000:
                            yield flush()
                    if not held or held[-1][0] != rid[i]:  # rows that repeat give a text twice
                        held.append((rid[i], comp[i], role[i], split[i], u))
        close()
        yield flush()

    return rows.mapInArrow(run, "kind long, u long, v long, lead long, o long, total long")


_IDS = ("rid", "row_key as key", "doc_id as id")


def _first_blocks(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Groups dealt into blocks, each with the group's lead. Groups of two whose sizes forbid a
    link are left out, and sets without a possible partner in a group of one block."""
    stats = groups.groupBy("lead").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    stats = stats.filter(f"rows > 2 or rows = 2 and 100 * lo >= {PERCENT} * hi").select("lead", _weighed("rows", "shingles").alias("blocks"))
    placed = groups.join(table(stats, "jaccard-sizes"), "lead")
    leads = F.col("priority") == F.col("lead")
    part = F.when(leads, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(_dealt("rid", F.col("blocks"), 1)))
    role = F.when(leads, 2).otherwise(1)
    placed = placed.withColumn("part", F.explode(part)).join(sets.selectExpr(*_IDS, "sig").hint("merge"), "rid")
    columns = [F.col("part").cast("string").alias("part"), F.col("rid").alias("comp"), role.alias("role"), (F.col("blocks") > 1).alias("split")]
    placed = placed.select("lead", "rid", "priority", *columns, "key", "id", "n", "sig")
    return _open_rows(placed.filter("not split")).unionByName(placed.filter("split").drop("n", "sig"))


def _place(kind: str, i: Column, j: Column, query: Column | bool) -> Column:
    """A block of two sides i and j, and whether a set is a query in it."""
    query = F.lit(query) if isinstance(query, bool) else query
    return F.struct(F.concat_ws(":", F.lit(kind), i, j).alias("part"), query.cast("int").alias("role"))


def _places(n: Column, place: Callable[[Column], Column]) -> Column:
    """The places for each of n blocks; none if n is 0."""
    none = F.array().cast("array<struct<part:string,role:int>>")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), place)).otherwise(none)


def _sides(state: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets of split groups, with their components: linked to the group's lead; or not (far),
    and of these whether they may be linked to one that is (near).

    Sets linked to the lead are one component. The distance 1 - Jaccard obeys the triangle
    inequality, so a set that is linked to one at most 1 - p from the lead is at most 2 - 2p
    from the lead."""
    state = state.select("lead", F.col("u").alias("rid"), "o", "total").distinct().join(sets.select("rid", "n", "priority"), "rid")
    state = state.join(labels, state["rid"] == labels["node"], "left").withColumn("comp", F.coalesce("component", "rid"))
    top = state.filter("priority = lead").groupBy("lead").agg(F.min("comp").alias("top"))
    linked = F.expr(f"100 * o >= {PERCENT} * total")
    reachable = F.expr(f"100 * o >= {max(0, 2 * PERCENT - 100)} * total")
    side = {"linked": linked, "far": ~linked, "near": ~linked & reachable & (F.col("comp") != F.col("top"))}
    return state.join(top, "lead").select("lead", "rid", "n", "priority", "comp", *[c.alias(name) for name, c in side.items()])


def _later_blocks(state: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Of groups that were dealt into several blocks, what is still to be searched: far sets
    against each other, and near ones against linked ones. Each side is cut into blocks, and
    two of them make a block to search; sets of the first are its queries."""
    state = _sides(state, labels, sets)
    sides = ("linked", "far", "near")
    sums = [F.sum(F.when(F.col(x), c).otherwise(0)).alias(f"{x}_{name}") for x in sides for name, c in (("rows", F.lit(1)), ("shingles", F.col("n")))]
    blocks = state.groupBy("lead").agg(*sums).filter("far_rows > 0").select("lead", *[_weighed(f"{x}_rows", f"{x}_shingles").alias(f"n_{x}") for x in sides])
    state = state.join(table(blocks, "jaccard-open"), "lead")
    mine = {x: _dealt("rid", F.greatest(f"n_{x}", F.lit(1)), seed) for seed, x in enumerate(sides, 2)}
    among = _places(F.col("n_far"), lambda k: _place("far", F.least(mine["far"], k), F.greatest(mine["far"], k), mine["far"] <= k))
    across = _places(F.col("n_linked"), lambda k: _place("near", mine["near"], k, True))
    under = _places(F.col("n_near"), lambda k: _place("near", k, mine["linked"], False))
    places = F.when(F.col("linked"), under).when(F.col("near"), F.concat(among, across)).otherwise(among)
    placed = state.select("lead", "rid", "priority", "comp", F.explode(places).alias("place"))
    return placed.select("lead", "place.part", "rid", "priority", "comp", "place.role", F.lit(False).alias("split")).join(sets.selectExpr(*_IDS), "rid")


def jaccard_components(docs: DataFrame, batch_size: str = "4m") -> DataFrame:
    """Link documents whose 5-word shingle sets have a Jaccard similarity of 0.8 or more.

    Words are lower-cased (A-Z) runs without [\\x20\\x09-\\x0D]; fewer than five words are one
    shingle. Equal sets are one. Prefix tokens put each set into a few groups (index_groups);
    a group is cut into blocks of bounded size, and the inverted lists of a block are searched
    for each set that may still join two components, by T-occurrence search with DivideSkip.
    A block returns links that join its components, never all its pairs. Groups of one block
    are done then; of others, sets that are not linked to the lead are searched against the
    other blocks too. One pass over the links gives the components.

    Returns a row for each row: doc_id, row_key, n_shingles, component_id (smallest doc_id
    reachable) and kept (one row of each component: the one with that doc_id, read first).
    Texts without words are linked with nothing; a null doc_id is never a component_id unless
    all are null; repeated rows are copies; very long texts take a block of their own; an empty
    table gives an empty one; other columns are ignored, whatever their names."""
    with batches_of(docs.sparkSession, batch_size):
        return _components(docs.select("doc_id", "text"))


def _components(docs: DataFrame) -> DataFrame:
    prof = table(profiles(docs), "jaccard-profiles")
    digest = ["n", "h1", "h2"]
    sets = table(prof.filter("prefix is not null").select("rid", "row_key", "doc_id", *digest, "priority", "prefix", "sig").dropDuplicates(digest), "jaccard-sets")
    found = table(_search(_first_blocks(table(index_groups(sets), "jaccard-groups"), sets), docs), "jaccard-found")
    edges = found.filter("kind = 0").select("u", "v")
    labels = table(components(edges), "jaccard-labels")
    state = found.filter("kind = 1").select("lead", "u", "o", "total")
    if not state.filter(f"100 * o < {PERCENT} * total").isEmpty():
        later = table(_search(_later_blocks(state, labels, sets), docs), "jaccard-found").select("u", "v")
        if not later.isEmpty():
            labels = table(components(labels.select(F.col("node").alias("u"), F.col("component").alias("v")).unionAll(later)), "jaccard-labels")
    node = sets.select(*digest, F.col("rid").alias("node")).join(labels, "node", "left").select(*digest, F.coalesce("component", "node").alias("component"))
    named = prof.filter("n > 0").select("doc_id", "row_key", "rid", *digest).join(node, digest).select("doc_id", "row_key", "n", "rid", "component")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("rid").alias("row"))
    named = table(named, "jaccard-named")
    top = table(named.groupBy("component").agg(F.min(first).alias("top")), "jaccard-top")
    linked = named.join(top, "component").select("doc_id", "row_key", F.col("n").alias("n_shingles"), F.col("top.id").alias("component_id"), (F.col("rid") == F.col("top.row")).alias("kept"))
    alone = prof.filter("n = 0").select("doc_id", "row_key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionAll(alone)
