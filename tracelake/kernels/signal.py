"""Array kernels for one trace; no Spark here."""

from __future__ import annotations

from math import pi, sqrt, tan

import numpy as np


def butterworth2(fps: float, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Second-order low-pass coefficients (b, a), bilinear transform; the cutoff is held inside (0, 0.95 Nyquist]."""
    k = tan(pi * min(max(cutoff / (fps / 2), 1e-4), 0.95) / 2)
    n = 1 + sqrt(2) * k + k * k
    return np.array([k * k, 2 * k * k, k * k]) / n, np.array([1, 2 * (k * k - 1) / n, (1 - sqrt(2) * k + k * k) / n])


def lowpass(x: np.ndarray, fps: float, cutoff: float = 1.0, init: str = "first_sample") -> np.ndarray:
    """Causal filter along the last axis, all traces of a matrix at once.

    ``init``: both state words hold x[0], the steady state, or zero after a pad of 64 samples.
    """
    b, a = butterworth2(fps, cutoff)
    x = np.asarray(x, float)
    if not x.size:
        return x
    pad = 64 if init == "padded" else 0
    y = np.concatenate([np.repeat(x[..., :1], pad, -1), x], -1)
    y = np.ascontiguousarray(np.moveaxis(y, -1, 0))
    z0, z1 = {"first_sample": (y[0], y[0]), "steady": ((1 - b[0]) * y[0], (b[2] - a[2]) * y[0]), "padded": (y[0] * 0, y[0] * 0)}[init]
    out = np.empty_like(y)
    for i, v in enumerate(y if y.ndim > 1 else y.tolist()):
        out[i] = w = b[0] * v + z0
        z0, z1 = b[1] * v - a[1] * w + z1, b[2] * v - a[2] * w
    return np.moveaxis(out[pad:], 0, -1)


def savgol_derivative(x: np.ndarray, fps: float, window_ms: float = 333, order: int = 2) -> np.ndarray:
    """First derivative by local polynomials; the end windows are fitted once and evaluated at their samples."""
    x = np.asarray(x, float)
    w = max(3, int(round(window_ms / 1000 * fps)) | 1)
    if len(x) < w:
        w = len(x) if len(x) % 2 else len(x) - 1
    if w < order + 1 or w < 3:
        return np.gradient(x) * fps if len(x) > 1 else np.zeros(len(x))
    m = w // 2
    basis = np.vander(np.arange(-m, m + 1), order + 1, increasing=True)
    fit = np.linalg.pinv(basis)
    out = np.convolve(x, fit[1][::-1], "same")
    slope = lambda c, at: sum(k * c[k] * at ** (k - 1) for k in range(1, order + 1))
    at = np.arange(-m, m + 1)
    out[:m], out[-m:] = slope(fit @ x[:w], at)[:m], slope(fit @ x[-w:], at)[-m:]
    return out * fps


def interpolate(x: np.ndarray) -> np.ndarray:
    """Fill non-finite samples linearly, ends held; an empty or all-missing trace becomes zeros."""
    x = np.asarray(x, float)
    ok = np.isfinite(x)
    return np.interp(np.arange(len(x)), np.flatnonzero(ok), x[ok]) if ok.any() else np.zeros(len(x))


def rolling_rank(x: np.ndarray, window: int, percent: float, edge: str = "edge") -> np.ndarray:
    """Order statistic of a sliding window; ``edge``: 'edge' repeats the end sample, 'symmetric' mirrors."""
    return rolling_ranks(np.asarray(x, float)[None], window, percent, edge)[0]


#: Numbers in all windows of a call up to which these are sorted one by one.
SMALL = 4_000_000


def rolling_ranks(x: np.ndarray, window: int, percent: float, edge: str = "edge") -> np.ndarray:
    """The same for all rows of a matrix at once, in memory linear in it.

    Samples are known by their places in the row's order. A row has a mark for each place inside the window and a count for
    each block of places; a step sets one mark, clears one, and finds the wanted place by its block's count. One step serves
    all rows.
    """
    window = max(1, window)
    left = window // 2
    y = np.pad(np.asarray(x, float), ((0, 0), (left, window - 1 - left)), mode=edge)
    rows, n = y.shape
    rank = min(window - 1, int(window * percent / 100))
    if rows * n * window <= SMALL:
        return np.partition(np.lib.stride_tricks.sliding_window_view(y, window, axis=1), rank, axis=2)[:, :, rank]
    order = np.argsort(y, axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(n), (rows, n)), axis=1)
    ordered = np.take_along_axis(y, order, axis=1)
    block = max(8, int(np.sqrt(n)))
    blocks = -(-n // block)
    marks, counts = np.zeros((rows, blocks, block), np.int8), np.zeros((rows, blocks), np.int32)
    which, at = np.divmod(place, block)
    row = np.arange(rows)
    for i in range(window - 1):
        marks[row, which[:, i], at[:, i]] = 1
        counts[row, which[:, i]] += 1
    out = np.empty((rows, n - window + 1))
    for i in range(window - 1, n):
        marks[row, which[:, i], at[:, i]] = 1
        counts[row, which[:, i]] += 1
        below = np.cumsum(counts, axis=1)
        b = (below > rank).argmax(1)
        rest = rank - (below[row, b] - counts[row, b])
        k = (np.cumsum(marks[row, b], axis=1, dtype=np.int32) > rest[:, None]).argmax(1)
        first = i - window + 1
        out[:, first] = ordered[row, b * block + k]
        marks[row, which[:, first], at[:, first]] = 0
        counts[row, which[:, first]] -= 1
    return out


def dff_rolling(f: np.ndarray, fps: float, window_s: float = 45, percent: float = 10) -> np.ndarray:
    """dF/F of a trace, or of the rows of a matrix, against a rolling percentile that is held above its own first percentile.

    The window is odd and no longer than the trace; one below three frames is replaced by the percentile of the whole trace.
    """
    f = np.asarray(f, float)
    rows = np.stack([interpolate(v) for v in np.atleast_2d(f)])
    n = rows.shape[1]
    window = min(max(3, int(window_s * fps) | 1), n if n % 2 else n - 1)
    if window < 3:
        base = np.broadcast_to(np.percentile(rows, percent, axis=1, keepdims=True), rows.shape) if n else rows
    else:
        base = rolling_ranks(rows, window, percent)
    floor = np.percentile(base, 1, axis=1, keepdims=True) if n else np.ones((len(rows), 1))
    out = (rows - base) / np.maximum(base, np.where(floor > 0, floor, 1e-9))
    return out if f.ndim > 1 else out[0]


def dff_first(f: np.ndarray, fps: float, minutes: float = 2.0) -> np.ndarray:
    f = np.asarray(f, float)
    base = f[: max(1, int(minutes * 60 * fps))].mean()
    return (f - base) / max(base, 1e-9)


def robust_z(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    m = np.median(x)
    return (x - m) / (1.4826 * (np.median(np.abs(x - m)) + 1e-12))


def gaussian(x: np.ndarray, sigma: float) -> np.ndarray:
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(np.asarray(x, float), r, mode="edge"), k / k.sum(), "valid")


def hysteresis(z: np.ndarray, high: float = 3.5, low: float = 1.5, gap: int = 0) -> np.ndarray:
    """Frames where an idle trace reaches ``high``; it is idle again at ``low``. Kept if ``gap`` frames after the last kept."""
    z = np.asarray(z, float)
    state = np.where(z >= high, 1, np.where(z <= low, 0, -1))
    known = np.maximum.accumulate(np.where(state >= 0, np.arange(len(z)), -1))
    on = np.where(known >= 0, state[np.maximum(known, 0)], 0)
    return spaced(np.flatnonzero(np.diff(np.append(0, on)) == 1), gap)


def spaced(at: np.ndarray, gap: float, strict: bool = False) -> np.ndarray:
    out: list = []
    for a in at:
        if not out or (a - out[-1] > gap if strict else a - out[-1] >= gap):
            out.append(a)
    return np.array(out, dtype=np.asarray(at).dtype)


def _summits(x: np.ndarray) -> np.ndarray:
    """Middles of plateaus that are higher than both sides; the ends are none."""
    edge = np.flatnonzero(np.diff(x) != 0)
    start, end = np.append(0, edge + 1), np.append(edge, len(x) - 1)
    rises, falls = np.append(False, x[start[1:]] > x[start[1:] - 1]), np.append(x[end[:-1]] > x[end[:-1] + 1], False)
    return ((start + end) // 2)[rises & falls]


def _thinned(x: np.ndarray, at: np.ndarray, distance: int) -> np.ndarray:
    """From the highest down (of ties the later), a summit removes those nearer than ``distance``."""
    first, past = np.searchsorted(at, at - distance, "right"), np.searchsorted(at, at + distance)
    keep = np.ones(len(at), bool)
    crowded = past - first > 1
    order = np.lexsort((at, x[at]))[::-1]
    first, past = first.tolist(), past.tolist()
    for i in order[crowded[order]].tolist():
        if keep[i]:
            keep[first[i] : past[i]] = False
            keep[i] = True
    return at[keep]


def peaks_and_prominences(x: np.ndarray, prominence: float, width: float = 1, distance: int = 4, span: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Summits thinned by distance, then by prominence and width at half prominence.

    Prominence looks ``span // 2`` samples to each side (0: the whole trace), up to the next higher sample.
    """
    x = np.asarray(x, float)
    if len(x) < 3:
        return np.zeros(0, int), np.zeros(0)
    found, drops = [], []
    reach = min(len(x), span // 2) if span else len(x)
    at = _thinned(x, _summits(x), distance)
    step = max(1, 2_000_000 // (reach + 1))
    for some in (at[i : i + step] for i in range(0, len(at), step)):
        sides = []
        for sign in (-1, 1):
            place = some[:, None] + sign * np.arange(reach + 1)
            v = np.where((place >= 0) & (place < len(x)), x[np.clip(place, 0, len(x) - 1)], np.inf)
            v[np.logical_or.accumulate(v > x[some][:, None], axis=1)] = np.inf
            sides.append(v)
        drop = x[some] - np.maximum(sides[0].min(1), sides[1].min(1))
        level, wide = x[some] - drop / 2, np.zeros(len(some))
        for v in sides:
            # The first sample at or below the level, and where the line from its neighbour crosses it.
            k = np.maximum((v <= level[:, None]).argmax(1), 1)
            rows = np.arange(len(some))
            low, high = v[rows, k], v[rows, k - 1]
            with np.errstate(invalid="ignore", divide="ignore"):
                wide += k - np.where(low < level, (level - low) / (high - low), 0)
        ok = (drop >= prominence) & (wide >= width)
        found.append(some[ok])
        drops.append(drop[ok])
    return (np.concatenate(found), np.concatenate(drops)) if found else (np.zeros(0, int), np.zeros(0))


def peaks(x: np.ndarray, prominence: float, width: float = 1, distance: int = 4, span: int = 0) -> np.ndarray:
    return peaks_and_prominences(x, prominence, width, distance, span)[0]


def sections(fps: float, cutoff: float, order: int = 2) -> list[tuple[np.ndarray, np.ndarray]]:
    """Butterworth low-pass of an even order as second-order sections."""
    k = tan(pi * min(max(cutoff / (fps / 2), 1e-4), 0.95) / 2)
    out = []
    for i in range(order // 2):
        q = 2 * np.sin(pi * (2 * i + 1) / (2 * order))
        n = 1 + q * k + k * k
        out.append((np.array([k * k, 2 * k * k, k * k]) / n, np.array([1, 2 * (k * k - 1) / n, (1 - q * k + k * k) / n])))
    return out


def run_section(x: np.ndarray, b: np.ndarray, a: np.ndarray, state: tuple[float, float]) -> tuple[np.ndarray, tuple[float, float]]:
    """One section over a chunk; the returned state continues the next chunk."""
    (z0, z1), out = state, np.empty(len(x))
    for i, v in enumerate(x):
        out[i] = w = b[0] * v + z0
        z0, z1 = b[1] * v - a[1] * w + z1, b[2] * v - a[2] * w
    return out, (z0, z1)


def zero_phase(x: np.ndarray, fps: float, cutoff: float = 1.0, order: int = 2) -> np.ndarray:
    """Forward and backward from steady states, with ends extended by odd reflection."""
    x = np.asarray(x, float)
    pad = min(len(x) - 1, 3 * (2 * (order // 2) + 1))
    if pad < 1:
        return x
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        for b, a in sections(fps, cutoff, order):
            y = run_section(y, b, a, ((1 - b[0]) * y[0], (b[2] - a[2]) * y[0]))[0]
        y = y[::-1]
    return y[pad : len(y) - pad]


def power(x: np.ndarray, fps: float) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and squared magnitudes of the real transform."""
    return np.fft.rfftfreq(len(x), 1 / fps), np.abs(np.fft.rfft(x)) ** 2
