"""Toxicity: maximum-scoring segments of token log-odds, calibrated by extreme values."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytetext as B
from .store import bound_batches, table

#: About so many labelled rows of each class are learned from; more are thinned by a hash.
MAX_TOXIC, MAX_CLEAN = 8_000, 16_000
#: Features that may open a passage: log-odds of at least MIN_ODDS, MIN_Z standard deviations from 0.
MIN_Z = 4.0
MIN_ODDS = 2.0
#: Features of clean texts: negative log-odds, this many standard deviations from 0.
CLEAN_Z = 2.0
#: Sums of so many best segments are looked at; 64 surprising ones are past any doubt.
SUMS = (2, 4, 8, 16, 32, 64)
#: Clean texts fall by at least this a word.
DRIFT = 0.02
#: Steps to a unit of score in which the scores of clean words are counted.
STEPS = 64
#: Weight of the prior, in documents.
PRIOR = 50.0
#: Bytes of a word's beginning that are features beside the whole word (0).
STEMS = (0, 4, 5, 6, 7)
#: A passage is significant when its chance in a clean document of this length is at most this.
ALPHA = 0.01


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weight: np.ndarray
    z: np.ndarray
    default: float  # score of a word without a feature
    lam: float
    log_k: float
    coef: tuple[float, float]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _features(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: the words that have it, and its hash."""
    spans = B.Spans(data)
    for stem in STEMS:
        at = np.flatnonzero(e - s >= max(stem, 1))
        end = s[at] + stem if stem else e[at]
        yield at, B.mix(spans.of(s[at], end) + B.U(stem + 1))


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """About MAX_TOXIC + MAX_CLEAN labelled rows that are not held out, of equal ones one: (text,
    toxic, tune). Equal texts are on one side of `tune`, and on the same one in every run."""
    known = labels.filter("toxic is not null and doc_id is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    share = F.when(F.col("toxic") == 1, min(1.0, MAX_TOXIC / max(1, n.get(1, 0)))).otherwise(min(1.0, MAX_CLEAN / max(1, n.get(0, 0))))
    few = known.filter(draw < share)  # 16 bytes a row
    tune = F.pmod(F.xxhash64("text", F.lit("tune")), F.lit(4)) == 0
    return docs.join(F.broadcast(few), "doc_id").select("text", "toxic").distinct().select("text", "toxic", tune.alias("tune"))


def _document_counts(sample: DataFrame) -> DataFrame:
    """In how many toxic and clean documents each feature occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_numpy()
            for lo, _, data, starts in B.text_chunks(batch.column("text")):
                data = B.LOWER[data]
                s, e, first = B.words(data, starts, B.ALNUM)
                row = np.searchsorted(first, np.arange(len(s)), "right") - 1
                seen = []
                for at, h in _features(data, s, e):
                    order = np.lexsort((row[at], h))
                    hh, rr = h[order], row[at][order]
                    new = np.ones(len(hh), bool)
                    new[1:] = (hh[1:] != hh[:-1]) | (rr[1:] != rr[:-1])
                    seen.append((hh[new], toxic[lo + rr[new]]))
                h, y = np.concatenate([x for x, _ in seen]), np.concatenate([y for _, y in seen])
                keys, inv = np.unique(h, return_inverse=True)
                n1 = np.bincount(inv, weights=y, minlength=len(keys)).astype(np.int64)
                n = np.bincount(inv, minlength=len(keys))
                yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(n1), pa.array(n - n1)], ["f", "n1", "n0"])

    return sample.mapInArrow(count, "f long, n1 long, n0 long").groupBy("f").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def _log_odds(counts: DataFrame, docs1: int, docs0: int) -> DataFrame:
    """Log-odds of a feature in toxic against clean documents under a Dirichlet prior that
    follows its share in all of them, and their z-score."""
    prior = F.lit(PRIOR) * (F.col("n1") + F.col("n0")) / (docs1 + docs0)
    y1, y0 = F.col("n1") + prior, F.col("n0") + prior
    odds = F.log(y1 / F.greatest(docs1 + PRIOR - y1, F.lit(0.5))) - F.log(y0 / F.greatest(docs0 + PRIOR - y0, F.lit(0.5)))
    return counts.filter("n1 + n0 >= 3").select("f", odds.alias("w"), (odds / F.sqrt(1 / y1 + 1 / y0)).alias("z"), "n1", "n0")


def token_scores(model: Model, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Each word's score: that of its most significant feature; NaN if it has none."""
    score, best = np.full(len(s), np.nan), np.zeros(len(s))
    members = B.Members(model.features)
    for at, h in _features(data, s, e):
        hit = members.where(h)
        k = np.searchsorted(model.features, h[hit])
        to, z = at[hit], np.abs(model.z[k])
        more = z > best[to]
        score[to[more]], best[to[more]] = model.weight[k[more]], z[more]
    return score


def maximal_segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), by Ruzzo and Tompa's linear scan.

    Only positive tokens open or close one, so the scan steps from one to the next. Each
    candidate links to the nearest earlier one with a smaller sum before it: what a search has
    passed over once is never looked at again."""
    total = np.concatenate(([0.0], np.cumsum(score))).tolist()
    stack: list[tuple] = []  # start, end, sum before, sum after, link
    for i in np.flatnonzero(score > 0).tolist():
        a, left, right, j = i, total[i], total[i + 1], len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append((a, i + 1, left, right, j))
                break
            a, _, left, _, link = stack[j]
            del stack[j:]
            j = link
    return [(a, b, r - lo) for a, b, lo, r, _ in stack]


def _surprise(model: Model, top: float, n: int) -> float:
    """-ln of the chance that a clean document of n words has a segment of this score."""
    if top <= 0 or n == 0:
        return 0.0
    expected = model.log_k + math.log(n) - model.lam * top
    return max(0.0, -math.log(-math.expm1(-math.exp(min(50.0, expected))))) if expected > -30 else -expected


@lru_cache
def _law_of_sums(r: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the r best normalised scores of a clean document, and -ln of the chance of as much
    or more: Karlin and Altschul's density, integrated numerically."""
    low, top = r - 1 - r * math.log(r) - 8 * math.sqrt(2 * r), 200.0
    t, y = np.linspace(low, top, 2048), np.linspace(0.0, top + r * (6 + math.log(r)), 1025)[1:]
    f = (r - 2) * np.log(y) - np.exp(np.minimum(50.0, (y - t[:, None]) / r))
    most = f.max(axis=1)
    density = most + np.log(np.exp(f - most[:, None]).sum(axis=1) * (y[1] - y[0])) - t - math.lgamma(r + 1) - math.lgamma(r - 1)
    between = np.logaddexp(density[:-1], density[1:]) + math.log((t[1] - t[0]) / 2)
    chance = np.logaddexp.accumulate(np.append(density[-1], between[::-1]))[::-1]  # beyond the end it falls as exp(-t)
    return t, np.maximum(0.0, -chance)


def sum_surprise(r: int, total: float) -> float:
    """-ln of the chance that the r best normalised scores of a clean document sum to `total` or more."""
    t, surprise = _law_of_sums(r)
    return float(np.interp(total, t, surprise)) + max(0.0, total - float(t[-1]))


def evidence(model: Model, scores: list[float], n: int) -> float:
    """How surprising all segments of a document of n words are together: the most surprising of
    its best one and of the sums of its best ones in SUMS. Without a segment 0."""
    if not scores or n == 0:
        return 0.0
    scores = -np.sort(-np.asarray(scores))
    sums = np.cumsum(model.lam * scores - model.log_k - math.log(n))
    return max([_surprise(model, float(scores[0]), n), *(sum_surprise(r, float(sums[r - 1])) for r in SUMS if r <= len(sums))])


def _probability(model: Model, surprise: float) -> float:
    a, b = model.coef
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * min(60.0, surprise)))))


def _score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """`docs` columns in `keep`, and n_words, top, surprise, score, passages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # grows with the labelled sample only
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            n, top, odd, prob, found = [], [], [], [], []
            for lo, hi, data, starts in B.text_chunks(batch.column("text")):
                data = B.LOWER[data]
                s, e, first = B.words(data, starts, B.ALNUM)
                score = token_scores(model, data, s, e)
                score[np.isnan(score)] = model.default
                any_hit = np.add.reduceat(np.append(score > 0, False), first[:-1]) * (np.diff(first) > 0) if hi > lo else []
                for r in range(hi - lo):
                    a, b = first[r], first[r + 1]
                    segments = maximal_segments(score[a:b]) if any_hit[r] else []
                    best = max((x[2] for x in segments), default=0.0)
                    n.append(int(b - a))
                    top.append(float(best))
                    odd.append(evidence(model, [x[2] for x in segments], int(b - a)))
                    prob.append(_probability(model, odd[-1]))
                    bar = -math.log(ALPHA)
                    found.append([{"start": int(x), "end": int(y), "score": float(v)} for x, y, v in segments if _surprise(model, v, int(b - a)) >= bar])
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(n, pa.int64()), *(pa.array(x, pa.float64()) for x in (top, odd, prob)), pa.array(found, kind)], [*keep, "n_words", "top", "surprise", "score", "passages"])

    fields = [docs.schema[c] for c in keep] + [T.StructField("n_words", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("top", "surprise", "score"))]
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField("passages", T.ArrayType(span))]))


def _score_counts(sample: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """Scores of words of clean texts in steps of 1 / STEPS, how many words have each, and for
    each class how many words have no feature (keys 0 and 1) or one (2 and 3)."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_numpy()
            for lo, _, data, starts in B.text_chunks(batch.column("text")):
                data = B.LOWER[data]
                s, e, first = B.words(data, starts, B.ALNUM)
                score = token_scores(shared.value, data, s, e)
                y = toxic[lo + np.searchsorted(first, np.arange(len(s)), "right") - 1]
                known = ~np.isnan(score)
                step = np.where(known, np.round(np.nan_to_num(score) * STEPS), 0).astype(np.int64)
                keys, n = np.unique(np.column_stack([y, known, step]), axis=0, return_counts=True)
                yield pa.record_batch([*(pa.array(c.astype(np.int64)) for c in keys.reshape(-1, 3).T), pa.array(n.astype(np.int64))], ["toxic", "known", "step", "n"])

    rows = sample.mapInArrow(count, "toxic long, known long, step long, n long").groupBy("toxic", "known", "step").agg(F.sum("n").alias("n")).orderBy("toxic", "known", "step").collect()  # a row a step
    clean = [(r.step / STEPS, r.n) for r in rows if r.known and not r.toxic]
    totals = {k: sum(r.n for r in rows if 2 * r.known + r.toxic == k) for k in range(4)}
    return np.array([x for x, _ in clean]), np.array([n for _, n in clean], float), totals


def decay(score: np.ndarray, share: np.ndarray) -> float:
    """The positive root of E[exp(lambda * score)] = 1 over a clean document's words, whose mean
    score is negative."""
    lo, hi = 1e-6, 20.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (share * np.exp(np.minimum(700.0, mid * score))).sum() < 1 else (lo, mid)
    return hi


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labelled rows that are not held out, at most about MAX_TOXIC + MAX_CLEAN.

    Three quarters give the log-odds, the rest the scores of clean words, the extreme-value law
    and the logistic curve. Without any labels of one class every score is that class's share."""
    sample = table(_sample(docs, labels), "toxicity-sample")
    learn, tune = sample.filter("not tune"), sample.filter("tune")
    n = {r.toxic: r["count"] for r in learn.groupBy("toxic").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    model = Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), -0.01, 1.0, 0.0, (math.log((n1 + 0.5) / (n0 + 0.5)) if n1 + n0 else -5.0, 0.0))
    if not n1 or not n0:
        return model
    odds = _log_odds(_document_counts(learn), n1, n0)
    # Each stands for at least three texts of the sample, so the sample bounds them.
    rows = odds.filter((F.col("z") >= MIN_Z) & (F.col("w") >= MIN_ODDS) | (F.col("z") <= -CLEAN_Z)).select("f", "w", "z").toArrow()
    if not rows.num_rows:
        return model
    f, w, z = (rows.column(c).to_numpy() for c in ("f", "w", "z"))
    order = np.argsort(f.view(np.uint64))
    model.features, model.weight, model.z = f.view(np.uint64)[order], w[order], z[order]

    score, words, totals = _score_counts(tune, model)
    every = words.sum() + totals[0]
    if not every or not (score > 0).any():
        score, words, every = np.append(score, model.weight.max()), np.append(words, 0.5), every + 0.5
    toxic_every = totals[1] + totals[3]
    # A word without a feature: its own log-odds, and low enough that clean texts fall.
    plain = math.log((totals[1] + 0.5) / (toxic_every + 1)) - math.log((totals[0] + 0.5) / (every + 1))
    falling = (-DRIFT * every - (score * words).sum()) / max(totals[0], 1.0)
    model.default = min(-1e-3, plain, falling)
    model.lam = decay(np.append(score, model.default), np.append(words, totals[0]) / every)
    clean = [(r.n_words, r.top) for r in _score(tune.filter("toxic = 0"), model, ["toxic"]).select("n_words", "top").collect() if r.n_words]
    if clean:
        # Gumbel: the mean of lambda * top - ln n over clean documents is ln K + Euler's constant.
        model.log_k = min(2.0, math.fsum(model.lam * t - math.log(w) for w, t in clean) / len(clean) - 0.5772)
    again = sorted((min(60.0, r.surprise), r.toxic) for r in _score(tune, model, ["toxic"]).select("toxic", "surprise").collect())
    model.coef = _logistic(np.array([x for x, _ in again]), np.array([y for _, y in again], float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope (at least 0) of a logistic regression of y on x with a weak pull to 0."""
    X, pull = np.column_stack([np.ones(len(x)), x]), np.array([1e-3, 1e-2])
    w = _least(X, y, pull)
    return (float(w[0]), float(w[1])) if w[1] >= 0 else (float(_least(X[:, :1], y, pull[:1])[0]), 0.0)


def _least(X: np.ndarray, y: np.ndarray, pull: np.ndarray) -> np.ndarray:
    """Where the logistic loss is least. Where classes lie apart, full Newton steps go round in
    circles; each is halved until the loss falls, which ends there from any start, as it is convex."""

    def loss(w: np.ndarray) -> float:
        return np.logaddexp(0, (1 - 2 * y) * (X @ w)).sum() + pull @ (w * w) / 2

    w = np.zeros(X.shape[1])
    now = loss(w)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -500, 500)))
        slope = X.T @ (p - y) + pull * w
        step = np.linalg.solve(X.T @ (X * (p * (1 - p))[:, None]) + np.diag(pull), slope)
        falls, t = slope @ step, 1.0
        while (new := loss(w - t * step)) > now - 1e-4 * t * falls and t > 1e-9:
            t /= 2
        if falls < 1e-9 or new >= now:
            break
        w, now = w - t * step, new
    return w


def toxicity(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Score every whole text for toxicity.

    Words are lower-cased runs of letters, digits and non-ASCII characters; a word scores the
    log-odds, of either sign, of its most significant feature (itself or its first 4 to 7
    bytes). Ruzzo and Tompa's scan finds all maximal scoring segments. The chance of the best
    one in a clean text of that length, by an extreme-value law, and the chances of the sums of
    several by the law of sums, give the text's surprise, and a logistic curve a probability.

    Returns the columns in `keep` (doc_id), n_words, top (best segment's score), surprise (-ln of
    the chance), score (0 to 1) and passages (start, end, score in words) that are significant
    by themselves. A null, empty or
    wordless text has no passage and the score of one that shows nothing. Rows whose
    crc32(doc_id) mod 5 is 0 are never learned from; repeated labels count once, toxic first.
    Repeated rows are scored row by row, texts of any length are scanned whole in linear time,
    an empty table gives an empty one. Columns of `docs` that are not in `keep` are ignored; a
    name in `keep` that this operator returns itself is refused."""
    bound_batches(docs.sparkSession)
    keep = keep or ["doc_id"]
    if clash := {"n_words", "top", "surprise", "score", "passages"} & set(keep):
        raise ValueError(f"rename {sorted(clash)} before")
    return _score(docs.select(*keep, *([] if "text" in keep else ["text"])), fit(docs.select("doc_id", "text"), labels), keep)
