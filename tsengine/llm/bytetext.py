"""Vectorised splitting and hashing of UTF-8 text held in Arrow buffers.

Rows of a batch are laid end to end with one separator between them, so that one
numpy expression works on many documents. Two kinds of hashes: Spans, polynomials over random
byte values modulo 2^64, for any span from prefix sums, which only ever pre-select (structured
texts of a kilobyte can collide in them); and span_hashes, which tell texts apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 5
BASE_INV = pow(BASE, -1, 1 << 64)
#: Bytes of text worked on at once; bounds a task's memory. One longer row is taken alone.
CHUNK = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUES = _rng.integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) * U(2) + U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: space and 0x09-0x0D
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: complement of [\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; kept up to a few chunks' length."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, 2 * CHUNK), base, U)
        p[0] = 1
        have = np.cumprod(p, dtype=U)
        if len(have) <= 4 * CHUNK:
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets): `bytes` holds the rows' texts, each
    followed by a newline; row r begins at offsets[r - first]. Nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        valid = column.is_valid().to_numpy(zero_copy_only=False)
    else:
        valid = None
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        lens = np.diff(offs[at : end + 1])
        part = data[offs[at] : offs[end]]
        if valid is not None and not valid[at:end].all():
            keep = np.repeat(valid[at:end], lens)
            part, lens = part[keep], np.where(valid[at:end], lens, 0)
        starts = np.zeros(end - at + 1, np.int64)
        np.cumsum(lens + 1, out=starts[1:])
        out = np.full(starts[-1], 0x0A, np.uint8)
        out[np.arange(len(part)) + np.repeat(np.arange(end - at), lens)] = part
        yield at, end, out, starts
        at = end


#: Spans of up to this many bytes are hashed side by side; longer ones by a library, one by one.
SHORT = 64
_LANES = ((0x9AE16A3B2F90404F, 0xC3A5C85C97CB3127), (0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03))
_TAILS = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lanes: int = 2) -> list[np.ndarray]:
    """64-bit hashes of these spans, `lanes` of them, independent of each other.

    Eight bytes at a time are mixed into a state; mixing is a bijection and no polynomial, so
    that no structure of a text makes two collide more often than chance."""
    n = end - start
    words = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    out = [mix(n.astype(U) + U(seed)) for seed, _ in _LANES[:lanes]]
    short = n <= SHORT
    for k in range(0, min(SHORT, int(n.max(initial=0))), 8):
        at = np.flatnonzero(short & (n > k)) if k else np.flatnonzero(short)
        w = words[start[at] + k] & _TAILS[np.minimum(n[at] - k, 8)]
        for h, (_, factor) in zip(out, _LANES):
            h[at] = mix((h[at] ^ w) * U(factor))
    at = np.flatnonzero(~short)
    if len(at):
        raw, digest = data.tobytes(), xxhash.xxh3_128_digest
        both = b"".join([digest(raw[a:b]) for a, b in zip(start[at].tolist(), end[at].tolist())])
        for h, x in zip(out, np.frombuffer(both, ">u8").reshape(-1, 2).T):
            h[at] = x
    return out


class Spans:
    """Hashes of any spans of a byte array."""

    def __init__(self, data: np.ndarray, lane: int = 0):
        n = len(data)
        self.prefix = np.zeros(n + 1, U)
        np.cumsum(BYTE_VALUES[lane][data] * powers(BASE_INV, n), dtype=U, out=self.prefix[1:])
        self.powers = powers(BASE, n + 1)

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.powers[start]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.zeros(len(mask) + 2, np.int8)
    edge[1:-1] = mask
    edge = np.diff(edge)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def words(data: np.ndarray, starts: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and first[r] .. first[r + 1], the words of row r."""
    s, e = runs(is_word[data])
    return s, e, np.searchsorted(s, starts)


def anchored_runs(value: np.ndarray, begin: np.ndarray, count: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every start of a window within a row belongs to the window's gram of the least value, the
    leftmost of equals; an equal window has the same one wherever it stands.

    value[i] is that of the gram that begins at place i; row r has count[r] places from begin[r]
    on. Returns for each maximal run of starts with one anchor: first and last start, anchor, row."""
    fit = np.maximum(0, count - window + 1)
    row = np.repeat(np.arange(len(count)), fit)
    at = np.arange(len(row)) - np.repeat(np.cumsum(fit) - fit, fit) + begin[row]
    if not len(at):
        return at, at, at, at
    bits = max(21, len(value).bit_length())
    low = (value >> U(bits) << U(bits)) | np.arange(len(value), dtype=U)
    grams, width = window - gram + 1, 1
    while 2 * width <= grams:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (grams - width)], low[grams - width :])
    a = (low & U((1 << bits) - 1)).astype(np.int64)[at]
    new = np.ones(len(at), bool)
    new[1:] = (a[1:] != a[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return at[first], at[last], a[first], row[first]


def shingles(word_hash: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words that begin at each word; the last ones are cut short
    and are the caller's to leave out."""
    out = word_hash * U(0x9E3779B97F4A7C15 + 2 * size)
    for j in range(1, size):
        shifted = np.zeros_like(word_hash)
        shifted[:-j or None] = word_hash[j:]
        out = out * U(0xC2B2AE3D27D4EB4F) + shifted
    return mix(out)


class Members:
    """Membership in a set of 64-bit values: a bit table first, then a binary search."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(np.asarray(values, U))
        self.bits = max(16, int(np.ceil(np.log2(max(1, len(self.values)) * 16))))
        self.hit = np.zeros(1 << self.bits, bool)
        self.hit[self.values >> U(64 - self.bits)] = True

    def where(self, x: np.ndarray) -> np.ndarray:
        """Positions in x whose value is in the set."""
        at = np.flatnonzero(self.hit[x >> U(64 - self.bits)])
        if not len(at) or not len(self.values):
            return at[:0]
        found = np.minimum(np.searchsorted(self.values, x[at]), len(self.values) - 1)
        return at[self.values[found] == x[at]]
