"""Stateful steps of the streams: what a key carries from row to row."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.blocks import scan
from ..operators.signals import Level

DAY = 86_400_000


class InOrder(StatefulProcessor):
    """Hands each key's rows to `work` in order of (at, event_id), `at` in microseconds.

    Rows wait in state until the watermark has passed them: sorted runs of at most RUN rows, an
    entry for each BLOCK of them. A timer by event time wakes the key then; the due rows of all
    runs are merged from their first blocks and handed on in pieces of about PIECE rows, so that
    Python holds a run that is being sorted, or a block of each run, however many rows wait. More
    than RUNS runs become one. A timer ttl_days behind the last row lets the key be forgotten.
    `work` has a schema, begin() (the numbers that it carries at first) and step(k, numbers,
    rows), which returns the numbers after these rows and a row of output for each, or for some."""

    RUN, BLOCK, PIECE, RUNS = 1 << 19, 1 << 13, 1 << 16, 64

    def __init__(self, work: Any):
        self.work, self.type = work, np.dtype([("at", "<i8"), ("event_id", "<i8"), ("value", "<f8")])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getMapState("blocks", "run long, block long", "rows binary")
        self.runs = handle.getValueState("runs", "run long, spans array<long>")  # next run; run, first block, end of each
        self.carried = handle.getValueState("carried", "k long, last long, numbers array<double>")

    def _spans(self) -> tuple[int, list[list[int]]]:
        fresh, flat = self.runs.get() if self.runs.exists() else (0, [])
        return fresh, [list(flat[i : i + 3]) for i in range(0, len(flat), 3)]

    def _keep(self, fresh: int, spans: list[list[int]]) -> None:
        self.runs.update((fresh, [x for s in spans for x in s]))

    def _block(self, run: int, block: int) -> np.ndarray:
        return np.frombuffer(self.blocks.getValue((run, block))[0], self.type)

    def _write(self, run: int, pieces: Iterator[np.ndarray]) -> list[int]:
        """A run of sorted pieces, in blocks."""
        n, rest = 0, np.empty(0, self.type)
        for piece in pieces:
            rest = np.concatenate([rest, piece])
            whole = len(rest) // self.BLOCK * self.BLOCK
            for i in range(0, whole, self.BLOCK):
                self.blocks.updateValue((run, n), (rest[i : i + self.BLOCK].tobytes(),))
                n += 1
            rest = rest[whole:]
        if len(rest):
            self.blocks.updateValue((run, n), (rest.tobytes(),))
        return [run, 0, n + (len(rest) > 0)]

    def _add(self, held: list[np.ndarray]) -> None:
        fresh, spans = self._spans()
        if len(spans) >= self.RUNS:
            span = self._write(fresh, self._due(spans, np.iinfo("i8").max))
            fresh, spans = fresh + 1, [span]
        spans.append(self._write(fresh, iter([_sorted(held)])))
        self._keep(fresh + 1, spans)

    def _due(self, spans: list[list[int]], limit: int) -> Iterator[np.ndarray]:
        """The waiting rows up to the time `limit`, in sequence; they leave the state and `spans`."""
        heads = [(s, self._block(s[0], s[1])) for s in spans]
        heads = [(s, h) for s, h in heads if h["at"][0] <= limit]
        while heads:
            # Blocks that are not read yet hold nothing before the least last row of those that are.
            at, event_id = min((h["at"][-1], h["event_id"][-1]) for _, h in heads)
            taken, left = [], []
            for s, h in heads:
                a, b = np.searchsorted(h["at"], at), np.searchsorted(h["at"], at, "right")
                n = min(a + np.searchsorted(h["event_id"][a:b], event_id, "right"), np.searchsorted(h["at"], limit, "right"))
                taken.append(h[:n])
                if n == len(h):
                    self.blocks.removeKey((s[0], s[1]))
                    s[1] += 1
                    if s[1] == s[2]:
                        continue
                    h, n = self._block(s[0], s[1]), 0
                if n and h["at"][n] > limit:  # no more of this run is due
                    self.blocks.updateValue((s[0], s[1]), (h[n:].tobytes(),))
                elif h["at"][n] <= limit:
                    left.append((s, h[n:]))
            yield _sorted(taken)
            heads = left
        spans[:] = [s for s in spans if s[1] < s[2]]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for part in rows:
            part = part[part["event_id"].notna()]
            if len(part):
                held.append(np.empty(len(part), self.type))
                for c in self.type.names:
                    held[-1][c] = part[c].to_numpy(self.type[c])
                n += len(part)
            if n >= self.RUN:
                self._add(held)
                held, n = [], 0
        if n:
            self._add(held)
        self._wake(timerValues.getCurrentWatermarkInMs() + 1)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        k, last, numbers = self.carried.get() if self.carried.exists() else (0, 0, self.work.begin())
        numbers, before = np.array(numbers, float), k
        fresh, spans = self._spans()
        for ready in _pieces(self._due(spans, now * 1000), self.PIECE):
            numbers, out = self.work.step(k, numbers, pd.DataFrame(ready))
            k, last = k + len(ready), int(ready["at"][-1]) // 1000
            if len(out):
                yield out.assign(event_type=key[0])[[c.split()[0] for c in self.work.schema.split(", ")]]
        if k > before:
            self.carried.update((k, last, [float(x) for x in numbers]))
            self._keep(fresh, spans)
        if spans:
            self._wake(now + 1)
        elif now >= last + self.work.ttl_days * DAY:
            self.carried.clear()
            self.runs.clear()
        else:
            self._wake(last + self.work.ttl_days * DAY)

    def _wake(self, at: int) -> None:
        if at not in set(self.handle.listTimers()):
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def _sorted(parts: list[np.ndarray]) -> np.ndarray:
    rows = np.concatenate(parts)
    return rows[np.lexsort((rows["event_id"], rows["at"]))]


def _pieces(parts: Iterator[np.ndarray], size: int) -> Iterator[np.ndarray]:
    """The same rows in parts of at least `size`, but the last."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part)
        if n >= size:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


class Work:
    ttl_days = 3650

    def begin(self) -> list[float]:
        return []


def _lags(values: np.ndarray, window: int) -> np.ndarray:
    """For each place from window - 1 on, the last `window` values, newest first."""
    return np.lib.stride_tricks.sliding_window_view(values, window)[:, ::-1]


class Kalman(Work):
    """The local-level filter. Carries the level; gains depend on the row's number only."""

    schema = "event_type string, k long, x double"

    def __init__(self, q: float, r: float, eps: float = 1e-6):
        self.level, self.eps = Level(q, r), eps

    def begin(self) -> list[float]:
        return [0.0]

    def step(self, k: int, numbers: np.ndarray, rows: pd.DataFrame) -> tuple[np.ndarray, pd.DataFrame]:
        z, place = np.maximum(rows["value"].to_numpy(float) + self.eps, self.eps), np.arange(k + 1, k + len(rows) + 1, dtype=float)
        gain = np.where(place == 1, 1.0, self.level.gain(np, np.maximum(place, 2)))
        x = scan(1 - gain, gain * z, numbers[0])
        return x[-1:], pd.DataFrame({"k": place.astype(int), "x": x})


class Lags(Work):
    """Carries the running total and the last window - 1 values."""

    schema = "event_type string, k long, total double, running double, lags array<double>"

    def __init__(self, window: int):
        self.window = window

    def begin(self) -> list[float]:
        return [0.0]

    def step(self, k: int, numbers: np.ndarray, rows: pd.DataFrame) -> tuple[np.ndarray, pd.DataFrame]:
        v = rows["value"].to_numpy(float)
        past = np.concatenate([numbers[1:], v])
        running = numbers[0] + np.cumsum(v)
        keep = self.window - 1
        carried = np.concatenate([running[-1:], past[max(0, len(past) - keep) :] if keep else []])
        n = max(0, len(past) - keep)  # rows with a whole window, the last ones
        if not n:
            return carried, pd.DataFrame(columns=["k"])
        lags = _lags(past, self.window)
        at = slice(len(v) - n, None)
        return carried, pd.DataFrame({"k": np.arange(k + 1, k + len(v) + 1)[at], "total": lags.sum(1), "running": running[at], "lags": pd.Series(list(lags), dtype=object)})


class Scores(Work):
    """Running R2, SMAPE and MAE of forecasts: each value is the truth of the one that was made
    `horizon` rows before, the mean of the `window` values up to there, unless that is more than
    `delay` microseconds ago. Carries the count, the first truth, sums over truths less the first
    one (for their variance) and over errors, and the values and times that forecasts still need."""

    schema = "event_type string, k long, n long, r2 double, smape double, mae double"

    def __init__(self, window: int, horizon: int, delay: int):
        self.window, self.horizon, self.delay = window, horizon, delay
        self.reach = horizon + window - 1

    def begin(self) -> list[float]:
        return [0.0] * 7

    def step(self, k: int, numbers: np.ndarray, rows: pd.DataFrame) -> tuple[np.ndarray, pd.DataFrame]:
        sums, (values, times) = numbers[:7], numbers[7:].reshape(2, -1)
        past = np.concatenate([values, rows["value"].to_numpy(float)])
        at = np.concatenate([times.astype(np.int64), rows["at"].to_numpy(np.int64)])
        before, keep = len(values), max(0, len(past) - self.reach)
        i = np.arange(max(before, self.reach), len(past))
        out = pd.DataFrame(columns=["k"])
        if len(i):
            forecast = _lags(past[: len(past) - self.horizon], self.window).mean(1)[i - self.reach]
            judged = (at[i] - at[i - self.horizon] <= self.delay) & ~np.isnan(forecast)
            if judged.any():
                sums, out = self._score(sums, k + 1 + i[judged] - before, past[i[judged]], forecast[judged])
        return np.concatenate([sums, past[keep:], at[keep:].astype(float)]), out

    def _score(self, sums: np.ndarray, k: np.ndarray, y: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, pd.DataFrame]:
        first = sums[1] if sums[0] else y[0]
        size = np.abs(y) + np.abs(p)
        each = [np.ones(len(y)), y - first, (y - first) ** 2, (y - p) ** 2, np.divide(2 * np.abs(y - p), size, out=np.zeros(len(y)), where=size > 0), np.abs(y - p)]
        n, s, ss, sse, sm, ae = (sums[i] + np.cumsum(x) for i, x in zip((0, 2, 3, 4, 5, 6), each))
        sst = ss - s * s / n
        r2 = np.where(sst > 0, 1 - np.divide(sse, sst, out=np.zeros(len(y)), where=sst > 0), np.where(sse == 0, 1.0, 0.0))
        out = pd.DataFrame({"k": k, "n": n.astype(int), "r2": r2, "smape": 100 * sm / n, "mae": ae / n})
        return np.array([n[-1], first, s[-1], ss[-1], sse[-1], sm[-1], ae[-1]]), out


def update(factor: np.ndarray, x: np.ndarray, sign: int) -> np.ndarray:
    """The Cholesky factors of L L' + sign x x' for each L in `factor` and x, in place, by rotations;
    False where a downdate would leave a matrix that is not positive."""
    x, ok = x.copy(), np.ones(x.shape[:-1], bool)
    with np.errstate(divide="ignore", invalid="ignore"):
        for i in range(x.shape[-1]):
            d, e = factor[..., i, i].copy(), x[..., i].copy()
            square = d * d + sign * e * e
            ok = ok & ~(square <= 1e-14 * d * d)
            r = np.sqrt(np.where(ok, square, 1.0))
            c, s = (r / d)[..., None], (e / d)[..., None]
            factor[..., i, i] = r
            factor[..., i + 1 :, i] = (factor[..., i + 1 :, i] + sign * s * x[..., i + 1 :]) / c
            x[..., i + 1 :] = c * x[..., i + 1 :] - s * factor[..., i + 1 :, i]
    return ok


def solve(factor: np.ndarray, right: np.ndarray) -> np.ndarray:
    """beta of L L' beta = right, for each L in `factor`."""
    beta, p = right.copy(), right.shape[-1]
    for i in range(p):
        beta[..., i] = (beta[..., i] - (factor[..., i, :i] * beta[..., :i]).sum(-1)) / factor[..., i, i]
    for i in reversed(range(p)):
        beta[..., i] = (beta[..., i] - (factor[..., i + 1 :, i] * beta[..., i + 1 :]).sum(-1)) / factor[..., i, i]
    return beta


class Refit(Work):
    """Least squares on the last length - window + 1 anchors whose labels are known. Carries the
    values that these reach, the Cholesky factor of the normal equations and their right side: an
    anchor that comes updates the factor, one that leaves downdates it. Every ANEW rows, or where
    a downdate loses rank, the factor is made anew from the values, so that rounding never adds
    up; anchors without full rank get the shortest solution. What lies between two such rows
    depends on nothing before, so all these stretches are gone through side by side."""

    schema = "event_type string, k long, forecast double"
    ANEW = 256

    def __init__(self, length: int, window: int, horizon: int):
        self.length, self.window, self.horizon = length, window, horizon
        self.p, self.span = window + 1, length - window + 1
        self.size = length + horizon

    def begin(self) -> list[float]:
        return [0.0] * (self.p * self.p + self.p)

    def _anew(self, x: np.ndarray, past: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Factors and right sides of the anchors that end with each of `new`; from the anchors
        themselves, not from their products, which would lose half the digits."""
        rows = new[:, None] + np.arange(1 - self.span, 1)
        anchors, labels = x[rows], past[rows + self.window - 1 + self.horizon]
        r = np.linalg.qr(anchors, mode="r")
        sign = np.where(np.diagonal(r, axis1=1, axis2=2) < 0, -1.0, 1.0)
        return (r * sign[:, :, None]).transpose(0, 2, 1), (anchors * labels[:, :, None]).sum(1)

    def step(self, k: int, numbers: np.ndarray, rows: pd.DataFrame) -> tuple[np.ndarray, pd.DataFrame]:
        v = rows["value"].to_numpy(float)
        m = self.p * self.p
        factor, right = numbers[:m].reshape(self.p, self.p).copy(), numbers[m : m + self.p].copy()
        past = np.concatenate([numbers[m + self.p :], v])
        before = len(past) - len(v)
        x = np.column_stack([np.ones(max(0, len(past) - self.window + 1)), _lags(past, self.window)]) if len(past) >= self.window else np.zeros((0, self.p))
        number = np.arange(k + 1, k + len(v) + 1)
        active = number >= self.size
        ks, places = number[active], np.arange(before, len(past))[active]
        out = np.empty(len(ks))
        if len(ks):
            fresh = (ks == self.size) | (ks % self.ANEW == 0)
            first = np.flatnonzero(fresh | (np.arange(len(ks)) == 0))  # where each stretch begins
            length = np.diff(np.append(first, len(ks)))
            factors, rights = np.broadcast_to(factor, (len(first), self.p, self.p)).copy(), np.broadcast_to(right, (len(first), self.p)).copy()
            for j in range(length.max()):
                on = np.flatnonzero(length > j)
                at = first[on] + j
                i, f, g = places[at], factors[on], rights[on]
                new = i - self.horizon - self.window + 1  # row of x of the newest known anchor
                old = np.maximum(new - self.span, 0)  # of a fresh factor none
                lost = fresh[at] | ~(update(f, x[new], 1) & update(f, x[old], -1))
                g += x[new] * past[i][:, None] - x[old] * past[i - self.span][:, None]
                if lost.any():
                    f[lost], g[lost] = self._anew(x, past, new[lost])
                size = np.abs(np.diagonal(f, axis1=1, axis2=2))
                poor = size.min(1) <= 1e-8 * size.max(1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    beta = solve(f, g)
                for q in np.flatnonzero(poor):
                    anchors = slice(new[q] - self.span + 1, new[q] + 1)
                    beta[q] = np.linalg.lstsq(x[anchors], past[i[q] - self.span + 1 : i[q] + 1], rcond=1e-8)[0]
                out[at] = (x[i - self.window + 1] * beta).sum(1)
                factors[on], rights[on] = f, g
            factor, right = factors[-1], rights[-1]
        kept = past[max(0, len(past) - self.size) :]
        return np.concatenate([factor.ravel(), right, kept]), pd.DataFrame({"k": ks, "forecast": out})
