"""Personal data: patterns for four kinds, and bootstrapped contexts for what they miss."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import bound_batches, table

KINDS = ("email", "ip", "card", "phone")
#: Words to the left of a candidate, on its line, that make its pattern; of a longer word than
#: LONG_WORD its beginning and a digest of the whole.
CONTEXT, LONG_WORD = 2, 40
#: A pattern is trusted for a kind from this confidence and this many different instances on.
MIN_CONFIDENCE, MIN_INSTANCES = 0.8, 5
#: Instances that count as unknown in a pattern's confidence.
DOUBT = 1.0
#: Bootstrapping ends when no confidence grows by more than SETTLED in a round; that it doesn't in
#: ROUNDS rounds is an error.
SETTLED, ROUNDS = 1e-3, 100
#: Trusted patterns up to which they are broadcast (some 60 bytes each); more are joined.
MAX_PATTERNS = 20_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Numbers joined by single dots; four of them after each other are a match of the IP pattern.
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_EDGE = "\"'()[]{}<>,;:!?*#$%&=|."
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A word that may be an identifier has one of these.
_MARK = re.compile("[0-9@]")
_DIGIT = re.compile("[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern: as the part before @ holds none, a match begins with the
    run of its characters that ends there, cut at the match before."""
    done, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        if m:
            a = at
            while a > done and text[a - 1] in _LOCAL:
                a -= 1
            if a < at:
                yield a, m.end()
                done = m.end()
                at = m.end() - 1
        at = text.find("@", at + 1)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the IP pattern with parts of at most 255: a match takes four whole numbers of
    a dotted run, and the next begins with the fifth, so that each digit is read once."""
    runs = [(m.start(), m.group().split(".")) for m in _DOTTED.finditer(text) if m.end() - m.start() > 6] if "." in text else []
    for a, parts in runs:
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            b = a + sum(map(len, four)) + 3
            if all(len(x := p.lstrip("0")) < 4 and int(x or 0) <= 255 for p in four):
                yield a, b
            a = b + 1


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, leftmost non-overlapping per kind."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    out += [(1, a, b) for a, b in _ips(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdecimal() for c in m.group()) <= 15:
                out.append((3, m.start(), m.end()))
    return out


class Contexts:
    """Patterns of places in one text: the CONTEXT words before a place on its line, lower-cased,
    digits as 9. A word that a place lies in counts with its part from the place asked before
    to this one, so that all patterns together read the text a few times only."""

    def __init__(self, text: str):
        self.text, self.words = text, [m.span() for m in _WORD.finditer(text)]
        self.begins = [a for a, _ in self.words]
        self.known: dict[int, tuple[str, bool]] = {}  # a word, and whether its line ends there
        self.last = 0

    def _clean(self, a: int, b: int) -> str:
        w = self.text[a:b].strip("\"'()[]{}<>*")
        tail = f"#{_digest(w):x}" if len(w) > LONG_WORD else ""
        return _DIGIT.sub("9", w[:LONG_WORD].lower()) + tail

    def before(self, start: int, end: int) -> str:
        """The pattern of start .. end. Places must come in sequence."""
        i = bisect_right(self.begins, start) - 1
        a = self.begins[i]
        out = [self._clean(max(a, self.last), start)] if a < start else []
        self.last = end
        while len(out) < CONTEXT and i > 0:
            i -= 1
            if i not in self.known:
                a, b = self.words[i]
                self.known[i] = self._clean(a, b), self.text.find("\n", b, self.begins[i + 1]) >= 0
            word, ended = self.known[i]
            if ended:
                break
            out.append(word)
        return " ".join(reversed(out))


def places(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[str, int | None, int, int]]]:
    """Base spans, and (pattern, kind, start, end) of these and of the words outside all of them
    that might be identifiers (kind None), in sequence."""
    base = base_spans(text)
    if not base and not _MARK.search(text):
        return base, []
    contexts, taken = Contexts(text), sorted((a, b, k) for k, a, b in base)
    found: list[tuple[int, int, int | None]] = list(taken)
    i = 0
    for a, b in contexts.words:
        if not _MARK.search(text, a, b):
            continue
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if b - a < 4 or i < len(taken) and taken[i][0] < b:
            continue
        if text.find("@", a, b) < 0 and sum(1 for _ in zip(range(3), _DIGIT.finditer(text, a, b))) < 3:
            continue
        found.append((a, b, None))
    found.sort(key=lambda x: x[:2])
    return base, [(contexts.before(a, b), k, a, b) for a, b, k in found]


def _digest(word: str) -> int:
    return int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "little", signed=True)


def context_edges(docs: DataFrame) -> DataFrame:
    """Distinct pattern-instance edges: (pattern, digest of the instance, kind or null)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[tuple] = set()
            for text in batch.column("text").to_pylist():
                if not text:
                    continue
                seen.update((p, _digest(text[a:b]), k) for p, k, a, b in places(text)[1])
            rows = [x for x in seen if x[0]]
            yield pa.record_batch([pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.int32())], ["pattern", "instance", "kind"])

    return docs.select("text").mapInArrow(scan, "pattern string, instance long, kind int").distinct()


def trusted_patterns(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, confidence) learned by bootstrapping.

    A seed's belief in its kind is 1. In each round a pattern's confidence in a kind is the
    summed belief of its instances over their number plus DOUBT, and an unseen instance's
    belief is that of its best pattern. Patterns without seeds are scored as well, as soon as
    one of their instances is believed. Confidences only grow, and rounds go on until they have
    settled, however far from a seed a pattern is. Edges and scores stay in Spark tables."""
    edges = table(context_edges(docs), "pii-edges")
    degree = edges.groupBy("pattern").agg(F.countDistinct("instance").alias("n")).filter(f"n >= {MIN_INSTANCES}")
    edges = table(edges.join(degree, "pattern"), "pii-graph")
    belief = edges.filter("kind is not null").select("instance", "kind", F.lit(1.0).alias("belief")).distinct()
    seeds = belief
    scored, steps = None, edges.select("pattern", "instance", "n").distinct()
    for _ in range(rounds):
        before, joined = scored, steps.join(belief, "instance")
        scored = table(joined.groupBy("pattern", "kind", "n").agg((F.sum("belief") / (F.col("n") + DOUBT)).alias("confidence")), "pii-patterns")
        if before is not None:
            old = before.select("pattern", "kind", F.col("confidence").alias("old"))
            grown = F.max(F.col("confidence") - F.coalesce("old", F.lit(0.0)))
            if (scored.join(old, ["pattern", "kind"], "left").agg(grown).first()[0] or 0.0) <= SETTLED:
                break
        fresh = edges.filter("kind is null").select("pattern", "instance").distinct().join(scored.filter(F.col("confidence") >= MIN_CONFIDENCE / 2), "pattern")
        fresh = fresh.groupBy("instance", "kind").agg(F.max("confidence").alias("belief"))
        belief = table(seeds.unionByName(fresh).groupBy("instance", "kind").agg(F.max("belief").alias("belief")), "pii-belief")
    else:
        raise RuntimeError("patterns did not settle")
    return scored.filter(F.col("confidence") >= MIN_CONFIDENCE).groupBy("pattern").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"), F.max("confidence").alias("confidence"))


def personal_data(docs: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """All personal data of every whole text.

    Returns doc_id, base (spans of the four fixed patterns) and spans (those and what trusted
    contexts discover), as arrays of (kind, start, end) in code points, ordered by kind and
    start. A discovered word has the kind of its pattern and never overlaps a base span.
    Null texts count as empty; repeated rows are searched row by row; a text or word of any
    length is read in linear time; an empty table learns nothing and returns nothing; other
    columns are ignored, whatever their names."""
    bound_batches(docs.sparkSession)
    patterns = (trusted_patterns(docs) if patterns is None else patterns).select("pattern", "kind")
    few = patterns.limit(MAX_PATTERNS + 1).collect()
    known = {r.pattern: r.kind for r in few}
    span = T.StructType([T.StructField(c, T.IntegerType()) for c in ("kind", "start", "end")])
    base_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    if len(few) > MAX_PATTERNS:
        return _joined(docs, patterns, span, base_type)
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            base, spans = [], []
            for text in batch.column("text").to_pylist():
                b, all_ = places(text) if text else ([], [])
                more = [(known[p], s, e) for p, k, s, e in all_ if k is None and p in known]
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in b])
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in sorted(b + more)])
            yield pa.record_batch([batch.column("doc_id"), pa.array(base, base_type), pa.array(spans, base_type)], ["doc_id", "base", "spans"])

    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.ArrayType(span)) for c in ("base", "spans"))])
    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def _joined(docs: DataFrame, patterns: DataFrame, span: T.StructType, base_type: pa.DataType) -> DataFrame:
    """personal_data with more patterns than are broadcast: candidate places, written once with
    their row's number, are joined with the whole pattern table."""
    found_type = pa.list_(pa.struct([("pattern", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, found = [], []
            for text in batch.column("text").to_pylist():
                b, all_ = places(text) if text else ([], [])
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in b])
                found.append([{"pattern": p, "start": s, "end": e} for p, k, s, e in all_ if k is None and p])
            yield pa.record_batch([batch.column("row"), batch.column("doc_id"), pa.array(base, base_type), pa.array(found, found_type)], ["row", "doc_id", "base", "found"])

    place = T.StructType([T.StructField("pattern", T.StringType()), *span.fields[1:]])
    schema = T.StructType([T.StructField("row", T.LongType()), docs.schema["doc_id"], T.StructField("base", T.ArrayType(span)), T.StructField("found", T.ArrayType(place))])
    rows = table(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(scan, schema), "pii-places")
    more = rows.select("row", F.inline("found")).join(patterns, "pattern").groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(T.ArrayType(span)))))
    return rows.join(more, "row", "left").select("doc_id", "base", spans.alias("spans"))
