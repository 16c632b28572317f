"""Language identification of words by a linear-chain conditional random field."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytetext as B
from .store import bound_batches

#: About so many labelled rows of each language are learned from, in up to SEGMENTS pieces of
#: SEGMENT_WORDS words spread over the whole text.
MAX_ROWS, SEGMENTS, SEGMENT_WORDS = 400, 8, 10
#: Hashed feature slots.
SLOTS = 1 << 15
#: Words of a piece of a text's chain; pieces run side by side, and messages pass between them.
CHAIN = 128
#: Share of switches of language between training segments of one chain.
SWITCH = 0.5
ROUNDS = 60

@dataclass
class Model:
    langs: list[str]
    slots: np.ndarray  # SLOTS x langs
    lexicon: np.ndarray  # sorted word hashes
    lexicon_of: np.ndarray  # their language
    lexicon_weight: np.ndarray  # langs x langs
    bias: np.ndarray
    transition: np.ndarray


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _slots(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of all words, flat, and the number of each word's: beginnings and ends of
    1 to 3 bytes, and all runs of 2 and 3 bytes of the word with its borders."""
    out_slot, out_word = [], []
    spans = B.Spans(data)
    word = np.arange(len(s))
    for size in (1, 2, 3):
        at = word[e - s >= size]
        for kind, a in ((size, s[at]), (size + 3, e[at] - size)):
            out_slot.append(B.mix(spans.raw(a, a + size) + B.U(kind)) & B.U(SLOTS - 1))
            out_word.append(at)
    for size in (2, 3):
        n = np.maximum(0, e - s - size + 1)
        at = np.repeat(word, n)
        a = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + s[at]
        out_slot.append(B.mix(spans.raw(a, a + size) + B.U(size + 6)) & B.U(SLOTS - 1))
        out_word.append(at)
    return np.concatenate(out_slot).astype(np.int64), np.concatenate(out_word)


def _emissions(model: Model, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    slot, word = _slots(data, s, e)
    k = len(model.langs)
    out = np.empty((len(s), k))
    for j in range(k):
        out[:, j] = np.bincount(word, weights=model.slots[slot, j], minlength=len(s)) + model.bias[j]
    h = B.Spans(data).of(s, e)
    if len(model.lexicon):
        at = B.Members(model.lexicon).where(h)
        out[at] += model.lexicon_weight[model.lexicon_of[np.searchsorted(model.lexicon, h[at])]]
    return out


def forward_backward(emit: np.ndarray, length: np.ndarray, transition: np.ndarray, enter: np.ndarray | None = None, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of padded chains emit[chain, step, label]; also the expected transitions and
    the log-likelihood's normaliser of each chain. Chains must be sorted, longest first.

    A chain that is a piece of a longer one has the messages enter[chain, label] from what is
    before it and leave[chain, label] from what follows; only its marginals are meant then."""
    n, steps, k = emit.shape
    peak = emit.max(2, keepdims=True)
    p, A = np.exp(emit - peak), np.exp(transition)
    if enter is not None:
        p[:, 0] *= enter
    alpha, beta, scale = np.zeros_like(p), np.ones_like(p), np.ones((n, steps))
    if leave is not None:
        beta[np.arange(n), length - 1] = leave
    live = [int(np.searchsorted(-length, -t, "left")) for t in range(steps + 1)]  # chains longer than t
    for t in range(steps):
        m = live[t]
        a = p[:m, t] if t == 0 else (alpha[:m, t - 1] @ A) * p[:m, t]
        scale[:m, t] = a.sum(1)
        alpha[:m, t] = a / scale[:m, t, None]
    pairs = np.zeros((k, k))
    for t in range(steps - 2, -1, -1):
        m = live[t + 1]
        right = p[:m, t + 1] * beta[:m, t + 1] / scale[:m, t + 1, None]
        beta[:m, t] = right @ A.T
        pairs += (alpha[:m, t].T @ right) * A
    mask = np.arange(steps)[None] < length[:, None]
    log_z = ((np.log(scale) + peak[:, :, 0]) * mask).sum(1)
    both = alpha * beta * mask[:, :, None]
    return both if leave is None else both / np.maximum(both.sum(2, keepdims=True), 1e-300), pairs, log_z


def messages(emit: np.ndarray, length: np.ndarray, transition: np.ndarray, first: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """enter and leave for forward_backward over the pieces of longer chains, up to a factor.

    Rows of emit are pieces, sorted, longest first; long chain c consists of the rows
    first[c, 0] .. first[c, pieces[c] - 1] in sequence. All pieces are multiplied through side
    by side, then the messages are handed on in sequence."""
    n, steps, k = emit.shape
    p, A = np.exp(emit - emit.max(2, keepdims=True)), np.exp(transition)
    through = np.eye(k)[None] * p[:, 0, None, :]  # from a piece's first label to its last
    for t in range(1, steps):
        m = int(np.searchsorted(-length, -t, "left"))
        x = (through[:m] @ A) * p[:m, t, None, :]
        through[:m] = x / np.maximum(x.max((1, 2), keepdims=True), 1e-300)
    enter, leave = np.ones((n, k)), np.ones((n, k))
    for j in range(1, int(pieces.max())):
        c = np.flatnonzero(pieces > j)
        at, before = first[c, j], first[c, j - 1]
        x = np.einsum("ci,cij->cj", enter[before], through[before]) @ A
        enter[at] = x / x.sum(1, keepdims=True)
    for j in range(int(pieces.max()) - 2, -1, -1):
        c = np.flatnonzero(pieces > j + 1)
        at, after = first[c, j], first[c, j + 1]
        x = np.einsum("cij,cj->ci", through[after], leave[after]) @ A.T
        leave[at] = x / x.sum(1, keepdims=True)
    return enter, leave


def text_marginals(emit: np.ndarray, n_words: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Each text's marginals, summed over its words: texts are chains of n_words[r] rows of emit,
    one after the other. Long texts are cut into pieces of CHAIN words that pass their messages
    on, so that every chain is one, whatever its length."""
    k = emit.shape[1]
    row = np.repeat(np.arange(len(n_words)), n_words)
    within = np.arange(len(emit)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    new = within % CHAIN == 0
    piece = np.cumsum(new) - 1
    length, of = np.bincount(piece), row[new]
    order = np.argsort(-length, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    padded = np.zeros((len(order), int(length.max()), k))
    padded[rank[piece], within % CHAIN] = emit
    pieces = np.bincount(of, minlength=len(n_words))
    enter = leave = None
    if pieces.max() > 1:
        # Only pieces of long texts are handed on.
        long = np.flatnonzero(pieces > 1)
        inside = np.flatnonzero(pieces[of] > 1)
        mine = inside[np.argsort(-length[inside], kind="stable")]
        place = np.full(len(length), -1)
        place[mine] = np.arange(len(mine))
        begin = np.cumsum(pieces) - pieces
        steps = np.minimum(begin[long, None] + np.arange(int(pieces.max())), len(length) - 1)
        e, l_ = messages(padded[rank[mine]], length[mine], transition, place[steps], pieces[long])
        enter, leave = np.ones((len(order), k)), np.ones((len(order), k))
        enter[rank[mine]], leave[rank[mine]] = e, l_
    marg = forward_backward(padded, length[order], transition, enter, leave)[0].sum(1)
    return np.stack([np.bincount(of, weights=marg[rank, j], minlength=len(n_words)) for j in range(k)], 1)


def _segments(docs: DataFrame) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, out = batch.column("lang").to_pylist(), []
            for lo, hi, data, starts in B.text_chunks(batch.column("text")):
                data = B.LOWER[data]
                s, e, first = B.words(data, starts, B.ALNUM)
                raw = data.tobytes()
                for r in range(hi - lo):
                    n = int(first[r + 1] - first[r])
                    for i in sorted({int(x) for x in np.linspace(0, max(0, n - SEGMENT_WORDS), SEGMENTS)}) if n else []:
                        a, b = first[r] + i, first[r] + min(n, i + SEGMENT_WORDS)
                        out.append((langs[lo + r], [raw[s[j] : e[j]].decode() for j in range(a, b)]))
            yield pa.record_batch([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.list_(pa.string()))], ["lang", "words"])

    return docs.select("lang", "text").mapInArrow(cut, "lang string, words array<string>")


def fit(docs: DataFrame, rounds: int = ROUNDS) -> Model | None:
    """Learn from about MAX_ROWS rows of each language that are not held out; every language in
    `lang` is learned.

    Segments of different texts are chained, half of them with a change of language, so that
    transitions are learned from code-switched chains; the likelihood is climbed by Adam."""
    known = docs.filter("lang is not null and text is not null").filter(~held_out(F.col("doc_id")))
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return None
    langs = sorted(counts)
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, MAX_ROWS / counts[lang]))])[F.col("lang")]
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    rows = _segments(known.filter(draw < share)).collect()  # about MAX_ROWS * SEGMENTS rows a language
    k = len(langs)
    model = Model(langs, np.zeros((SLOTS, k)), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((k, k)), np.zeros(k), np.zeros((k, k)))
    if k == 1 or not rows:
        return model
    rng = np.random.default_rng(7)
    rows = sorted((langs.index(r.lang), tuple(r.words)) for r in rows if r.words)
    by_lang = [[w for y, w in rows if y == j] for j in range(k)]
    present = [j for j in range(k) if by_lang[j]]
    chains, n_chains = [], max(1, len(rows) // 4)
    for _ in range(n_chains):
        y, words, labels = rng.choice(present), [], []
        for _ in range(4):
            if rng.random() < SWITCH:
                y = rng.choice(present)
            seg = by_lang[y][rng.integers(len(by_lang[y]))]
            words += seg
            labels += [y] * len(seg)
        chains.append((words, labels))
    chains.sort(key=lambda c: -len(c[0]))
    length = np.array([len(c[0]) for c in chains])
    flat = [w.encode() for c in chains for w in c[0]]
    gold = np.array([y for c in chains for y in c[1]])
    data = np.frombuffer(b" ".join(flat) + b" ", np.uint8)
    ends = np.cumsum([len(w) + 1 for w in flat]) - 1
    begins = ends - np.array([len(w) for w in flat])
    slot, word = _slots(data, begins, ends)
    h = B.Spans(data).of(begins, ends)
    # Lexicon: words seen twice or more, nine times in ten in one language.
    keys, inv = np.unique(h, return_inverse=True)
    per = np.stack([np.bincount(inv[gold == j], minlength=len(keys)) for j in range(k)], 1)
    sure = (per.sum(1) >= 2) & (per.max(1) >= 0.9 * per.sum(1))
    model.lexicon, model.lexicon_of = keys[sure], per[sure].argmax(1)
    lex_at = B.Members(model.lexicon).where(h)
    lex_id = model.lexicon_of[np.searchsorted(model.lexicon, h[lex_at])]
    chain = np.repeat(np.arange(len(chains)), length)
    step = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
    steps = int(length.max())
    onehot = np.eye(k)[gold]
    same = chain[1:] == chain[:-1]
    gold_pairs = np.zeros((k, k))
    np.add.at(gold_pairs, (gold[:-1][same], gold[1:][same]), 1)
    params = {"slots": model.slots, "lexicon_weight": model.lexicon_weight, "bias": model.bias, "transition": model.transition}
    m1, m2 = {x: np.zeros_like(v) for x, v in params.items()}, {x: np.zeros_like(v) for x, v in params.items()}
    for it in range(1, rounds + 1):
        emit = np.stack([np.bincount(word, weights=model.slots[slot, j], minlength=len(flat)) for j in range(k)], 1) + model.bias
        emit[lex_at] += model.lexicon_weight[lex_id]
        padded = np.zeros((len(chains), steps, k))
        padded[chain, step] = emit
        marg, pairs, _ = forward_backward(padded, length, model.transition)
        diff = onehot - marg[chain, step]
        grad = {"slots": np.stack([np.bincount(slot, weights=diff[word, j], minlength=SLOTS) for j in range(k)], 1)}
        grad["lexicon_weight"] = np.stack([np.bincount(lex_id, weights=diff[lex_at, j], minlength=k) for j in range(k)], 1)
        grad["bias"], grad["transition"] = diff.sum(0), gold_pairs - pairs
        for x, v in params.items():
            g = grad[x] / len(chains) - 1e-4 * v
            m1[x] = 0.9 * m1[x] + 0.1 * g
            m2[x] = 0.99 * m2[x] + 0.01 * g * g
            v += 0.1 * (m1[x] / (1 - 0.9**it)) / (np.sqrt(m2[x] / (1 - 0.99**it)) + 1e-8)
    return model


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Label the words of every whole text, and the text by their summed marginals.

    Returns doc_id, lang_pred, score (the mean marginal of lang_pred over the words) and
    word_share (each language's, by name). A text that is null or has no letter is `und`
    with score 0, as is every text when nothing could be learned."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS numbers for each language
    langs = model.langs if model else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k = len(langs)
        for batch in batches:
            letter = [t is not None and any(map(str.isalpha, t)) for t in batch.column("text").to_pylist()]
            share = np.zeros((len(batch), max(1, k)))
            for lo, hi, data, starts in B.text_chunks(batch.column("text")):
                data = B.LOWER[data]
                s, e, first = B.words(data, starts, B.ALNUM)
                if not len(s) or not k:
                    continue
                emit = _emissions(model, data, s, e)
                share[lo:hi] = text_marginals(emit, np.diff(first), model.transition)
            share = share / np.maximum(share.sum(1, keepdims=True), 1e-12)
            best = share.argmax(1)
            known = np.array(letter, bool) & (k > 0)
            pred = pa.array([langs[b] if ok else "und" for b, ok in zip(best.tolist(), known.tolist(), strict=True)], pa.string())
            score = np.where(known, np.clip(share[np.arange(len(best)), best], 0, 1), 0.0)
            shares = pa.array([[(langs[j], float(x[j])) for j in range(k)] for x in share], pa.map_(pa.string(), pa.float64()))
            yield pa.record_batch([batch.column("doc_id"), pred, pa.array(score), shares], ["doc_id", "lang_pred", "score", "word_share"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("word_share", T.MapType(T.StringType(), T.DoubleType()))])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def language(docs: DataFrame) -> DataFrame:
    """Learn from the rows of `docs` that are not held out (crc32(doc_id) mod 4 is not 2) and
    have a lang, then identify all rows. Only text is looked at in a prediction. Repeated rows
    are judged row by row; a null doc_id is not held out; texts of any length are one chain each;
    an empty table gives an empty one; other columns are ignored, whatever their names."""
    bound_batches(docs.sparkSession)
    return identify(docs, fit(docs.select("doc_id", "text", "lang")))
