"""Lexical retrieval packing: fill training windows with BM25 neighbours."""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import bound_batches, table

WINDOW = 1024
#: A shard of the index ends at this many tokens or documents; it bounds a task's memory.
SHARD_TOKENS, SHARD_DOCS = 2_000_000, 2048
#: Terms of a seed that are looked up, the weightiest ones, and neighbours taken from one lookup.
QUERY_TERMS, NEIGHBOURS = 16, 16
K1, B = 1.2, 0.75
END = 0
#: The fast library's pattern needs stack in proportion to a run of blanks; it fails at some 10^6.
#: The look-behind keeps the search linear.
MANY_BLANKS = 1 << 16
_BLANKS = re.compile(rf"(?<!\s)\s{{{MANY_BLANKS}}}")


class Tokens:
    """Ids of texts, without special tokens, each followed by END.

    The fast library reads the same vocabulary as ranks and gives the same ids; a text that
    spells a special token goes to `tokenizers`, which alone treats it as one, and so does one
    with a run of MANY_BLANKS blanks."""

    def __init__(self, vocabulary: str, ranks: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.slow = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.size = self.slow.get_vocab_size()
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table_ = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table_, special_tokens={})

    def ids(self, text: str | None) -> np.ndarray:
        text = text or ""
        if self.fast is None or any(s in text for s in self.special) or len(text) >= MANY_BLANKS and _BLANKS.search(text):
            ids = self.slow.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.frombuffer(array("I", [*ids, END]).tobytes(), np.uint32)


_TOKENS: dict[tuple, Tokens] = {}


def terms(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and their counts."""
    s = np.sort(ids.astype(np.uint16) if len(ids) and ids.max() < 1 << 16 else ids, kind="stable")
    at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    return s[at].astype(np.int64), np.diff(np.append(at, len(s)))


def tokenize(docs: DataFrame, vocabulary: str, ranks: str | None, pattern: str | None) -> DataFrame:
    """(doc_id, n, route, salt, ids) of each row; rows without doc_id and n, at most one for
    each batch, hold how many of its documents each term is in. A document's route is its most
    frequent late merge, by which lexically close documents are brought together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (vocabulary, ranks, pattern)
        tok = _TOKENS.get(key) or _TOKENS.setdefault(key, Tokens(*key))
        rarity = np.log1p(np.arange(tok.size + 1) / 256.0) ** 2
        names = ["doc_id", "n", "route", "salt", "ids", "df"]
        for batch in batches:
            df = np.zeros(tok.size + 1, np.int32)
            texts, doc_ids, salts = batch.column("text"), batch.column("doc_id"), batch.column("salt")
            for lo in range(0, len(texts), 512):  # ids of some rows at a time
                n, route, ids = [], [], []
                for text in texts.slice(lo, 512).to_pylist():
                    x = tok.ids(text)
                    t, tf = terms(x)
                    df[t] += 1
                    n.append(len(x))
                    route.append(int(t[np.argmax(tf * rarity[t])]))
                    ids.append((x.astype(np.uint16) if tok.size < 1 << 16 else x).tobytes())
                yield pa.record_batch([doc_ids.slice(lo, 512), pa.array(n, pa.int64()), pa.array(route, pa.int32()), salts.slice(lo, 512), pa.array(ids, pa.binary()), pa.nulls(len(n), pa.binary())], names)
            yield pa.record_batch([pa.nulls(1, doc_ids.type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([df.tobytes()], pa.binary())], names)

    schema = T.StructType(
        [docs.schema["doc_id"].__class__("doc_id", docs.schema["doc_id"].dataType, True), T.StructField("n", T.LongType()), T.StructField("route", T.IntegerType()), T.StructField("salt", T.LongType())]
        + [T.StructField("ids", T.BinaryType()), T.StructField("df", T.BinaryType())]
    )
    return docs.select("doc_id", "text", F.xxhash64("doc_id", F.length("text")).alias("salt")).mapInArrow(run, schema)


class Shard:
    """A BM25 index of the documents of one shard."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray):
        per = [terms(d) for d in docs]
        size = np.array([len(d) for d in docs], np.float64)
        doc = np.repeat(np.arange(len(docs)), [len(t) for t, _ in per])
        term, tf = (np.concatenate([p[i] for p in per]) for i in (0, 1))
        norm = K1 * (1 - B + B * size / size.mean())
        weight = idf[term] * tf * (K1 + 1) / (tf + norm[doc])
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.begin = np.searchsorted(term[order], np.arange(len(idf) + 1))
        self.query = []
        for t, n in per:
            w = idf[t] * n
            self.query.append(t[np.argpartition(-w, QUERY_TERMS)[:QUERY_TERMS]] if len(t) > QUERY_TERMS else t)
        self.n = len(docs)

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with the seed, best first."""
        spans = [(self.begin[t], self.begin[t + 1]) for t in self.query[seed].tolist()]
        score = np.bincount(np.concatenate([self.doc[a:b] for a, b in spans]), np.concatenate([self.weight[a:b] for a, b in spans]), self.n) * unused
        k = min(NEIGHBOURS, self.n)
        top = np.argpartition(-score, k - 1)[:k]
        top = top[score[top] > 0]
        return top[np.lexsort((top, -score[top]))]


def pack(tokens: DataFrame, idf: np.ndarray, window: int) -> DataFrame:
    """Fill the windows, shard by shard, from a stream of documents."""
    shared = tokens.sparkSession.sparkContext.broadcast(idf)  # one number for each term
    wide = pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        part = TaskContext.get().partitionId()
        counter, out, doc_type = 0, [], wide
        # The window being filled: pieces (doc_id, start, ids, doc tokens) and tokens so far.
        open_, filled = [], 0

        def emit() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [()] * 7
            out.clear()
            kinds = [doc_type, wide, wide, pa.binary(), wide, wide, wide]
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        def close(pieces: list, size: int) -> None:
            nonlocal counter
            at = 0
            for doc_id, start, ids, n in pieces:
                out.append((doc_id, start, len(ids), ids.astype("<u4").tobytes(), n, part << 32 | counter, at))
                at += len(ids)
            counter += 1

        def shard(ids: list[np.ndarray], names: list) -> None:
            nonlocal open_, filled
            index = Shard(ids, idf)
            rest = [len(x) % window for x in ids]
            unused = np.array([r > 0 for r in rest])
            for x, d in zip(ids, names):
                for a in range(0, len(x) - len(x) % window, window):
                    close([(d, a, x[a : a + window], len(x))], window)
            order = np.argsort([-r for r in rest], kind="stable").tolist()
            at, near, seed = 0, [], None
            while True:
                if not filled:
                    near = []
                elif seed is not None and not near:
                    near = index.neighbours(seed, unused).tolist()[::-1]
                while near and not unused[near[-1]]:
                    near.pop()
                if near:
                    i = near.pop()
                else:
                    while at < len(order) and not unused[order[at]]:
                        at += 1
                    if at == len(order):
                        break
                    i = order[at]
                unused[i] = False
                if not filled or seed is None:
                    seed, near = i, []
                x = ids[i]
                a = len(x) - rest[i]
                take = min(rest[i], window - filled)
                open_.append((names[i], a, x[a : a + take], len(x)))
                filled += take
                if filled == window:
                    close(open_, window)
                    open_, filled, seed, near = [], 0, None, []
                    if take < rest[i]:  # what is left of a cut document is the next seed
                        open_, filled, seed = [(names[i], a + take, x[a + take :], len(x))], rest[i] - take, i

        ids, names, size = [], [], 0
        for batch in batches:
            doc_type = batch.column("doc_id").type
            for d, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                ids.append(np.frombuffer(x.as_buffer(), np.uint16 if len(idf) <= 1 << 16 else np.uint32))
                names.append(d)
                size += len(ids[-1])
                if size >= SHARD_TOKENS or len(ids) >= SHARD_DOCS:
                    shard(ids, names)
                    ids, names, size = [], [], 0
                    yield emit()
        if ids:
            shard(ids, names)
        # The task's last window is cut into powers of two, which need no padding.
        while filled:
            size, pieces, space = 1 << filled.bit_length() - 1, [], 1 << filled.bit_length() - 1
            while space:
                d, a, x, n = open_.pop(0)
                pieces.append((d, a, x[:space], n))
                if len(x) > space:
                    open_.insert(0, (d, a + space, x[space:], n))
                space -= len(pieces[-1][2])
            close(pieces, size)
            filled -= size
        yield emit()

    long = [T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")]
    schema = T.StructType([tokens.schema["doc_id"], *long[:2], T.StructField("ids", T.BinaryType()), *long[2:]])
    return tokens.select("doc_id", "ids").mapInArrow(run, schema)


def packed_sequences(docs: DataFrame, vocabulary: str, ranks: str | None = None, pattern: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pack all texts into sequences of at most `window` tokens.

    A document's whole windows stand alone. Its rest is a seed or a neighbour: for each seed,
    a BM25 index of its shard (idf over all documents) returns unused documents, which fill
    the seed's window in order of score; the one that overflows is cut, and what is left of it
    is the next seed. Shards are runs of documents that are brought together by a term of
    theirs, range-partitioned so that a frequent term spreads over many tasks.

    Returns a row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id and offset. Null and empty texts are the end token alone; repeated
    rows are packed each; each task cuts its last window into powers of two. A text of any length
    is one list of ids, in whole windows but for its rest; an empty table gives an empty one;
    other columns are ignored, whatever their names."""
    bound_batches(docs.sparkSession)
    tokens = table(tokenize(docs, vocabulary, ranks, pattern), "packing-tokens")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column("df").to_pylist():
                d = np.frombuffer(x, np.int32).astype(np.int64)
                total = d if total is None else total + d
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array(at), pa.array(total[at]), pa.array(np.full(len(at), len(total)))], ["term", "df", "size"])

    n_docs = tokens.filter("n is not null").count()
    rows = tokens.filter("df is not null").select("df").mapInArrow(add, "term long, df long, size long").groupBy("term").agg(F.sum("df").alias("df"), F.max("size").alias("size")).collect()  # the vocabulary
    df = np.zeros(max((r["size"] for r in rows), default=1))
    for r in rows:
        df[r.term] = r.df
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
    near = tokens.filter("n is not null").select("doc_id", "route", "salt", "ids").repartitionByRange("route", "salt").sortWithinPartitions("route", "salt")
    return pack(near, idf, window)
