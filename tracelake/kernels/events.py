"""Population events of one recording: density, peaks against a shuffled floor, boundaries; no Spark here."""

from __future__ import annotations

from dataclasses import dataclass, replace
from statistics import NormalDist

import numpy as np

from tracelake.kernels import signal, stats


@dataclass(frozen=True)
class EventParams:
    """Seconds unless named otherwise; ``min_prominence`` serves where no floor comes from shuffles."""

    # The defaults.
    bin_s: float = 0.025
    sigma_bins: float = 1.5
    normalise: bool = True
    min_prominence: float = 0.002
    min_width_bins: float = 1
    min_distance_bins: int = 4
    prominence_window_s: float = 1.0
    shuffles: int = 200
    floor_percentile: float = 99
    seed: int = 0
    rolling: bool = True
    baseline_s: float = 5.0
    baseline_percentile: float = 5
    quiet_percentile: float = 40
    noise_factor: float = 1.4826
    threshold_k: float = 1.5
    walk_s: float = 2.0
    cap_s: float = 0.5
    split: bool = True
    symmetric: bool = False
    gaussian: bool = False
    gaussian_quantile: float = 0.99
    gaussian_pad_s: float = 0.5
    gaussian_min_sigma_s: float = 0.05


DEFAULT = EventParams()
#: The interactive preset: wider bins and longer events.
GUI = replace(DEFAULT, bin_s=0.05, cap_s=1.3)


def density(trains: list[np.ndarray], duration: float, p: EventParams) -> tuple[np.ndarray, np.ndarray]:
    """Bin centres and smoothed onsets per bin (and unit, silent ones included); the last bin is closed."""
    n = max(1, int(np.ceil(duration / p.bin_s - 1e-9)))
    edges = np.arange(n + 1) * p.bin_s
    full = [np.asarray(t, float) for t in trains if len(t)]
    counts = np.histogram(np.concatenate(full) if full else np.zeros(0), edges)[0].astype(float)
    if p.normalise and trains:
        counts /= len(trains)
    return (edges[1:] + edges[:-1]) / 2, signal.gaussian(counts, p.sigma_bins)


def span_bins(p: EventParams) -> int:
    return max(3, int(round(p.prominence_window_s / p.bin_s)) | 1)


def candidates(x: np.ndarray, p: EventParams) -> np.ndarray:
    """Prominences of all peaks that pass the distance and width gates."""
    at, drop = signal.peaks_and_prominences(x, 1e-12, p.min_width_bins, p.min_distance_bins, span_bins(p))
    return drop


def null_prominences(trains: list[np.ndarray], duration: float, p: EventParams) -> np.ndarray:
    """Pooled candidate prominences of circularly shifted trains, one generator over all shuffles."""
    r = np.random.default_rng(p.seed)
    return np.concatenate([np.zeros(0)] + [candidates(density(stats.circular_onsets(trains, duration, r), duration, p)[1], p) for _ in range(p.shuffles)])


def floor(trains: list[np.ndarray], duration: float, p: EventParams) -> float:
    """The percentile of the null; the fixed prominence without shuffles or without a null peak."""
    pooled = null_prominences(trains, duration, p) if p.shuffles > 0 else np.zeros(0)
    return float(np.percentile(pooled, p.floor_percentile)) if len(pooled) else p.min_prominence


def baseline(x: np.ndarray, p: EventParams) -> np.ndarray:
    n = len(x)
    window = min(max(3, int(round(p.baseline_s / p.bin_s)) | 1), n if n % 2 else n - 1)
    if p.rolling and window >= 3:
        return signal.rolling_rank(x, window, p.baseline_percentile, "symmetric")
    return np.full(n, np.percentile(x, p.baseline_percentile) if n else 0.0)


def quiet_noise(x: np.ndarray, base: np.ndarray, p: EventParams) -> float:
    """Scaled MAD of the residuals up to a percentile; of all of them if that leaves fewer than 32 bins."""
    rest = x - base
    if not len(rest):
        return 0.0
    quiet = rest[rest <= np.percentile(rest, p.quiet_percentile)]
    quiet = quiet if len(quiet) >= 32 else rest
    return float(p.noise_factor * (np.median(np.abs(quiet - np.median(quiet))) + 1e-12))


def extents(x: np.ndarray, at: np.ndarray, threshold: np.ndarray, walk: int) -> tuple[np.ndarray, np.ndarray]:
    """Last bins above the threshold on both sides of each peak, at most ``walk`` bins away."""
    low = np.concatenate([[-1], np.flatnonzero(x <= threshold), [len(x)]])
    left, right = low[np.searchsorted(low, at) - 1] + 1, low[np.searchsorted(low, at, "right")] - 1
    return np.maximum(left, at - walk), np.minimum(right, at + walk)


def split_overlaps(x: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping neighbours meet at the lowest bin between their peaks."""
    left, right = left.copy(), right.copy()
    for i in np.flatnonzero(left[1:] <= right[:-1]):
        a, b = at[i], at[i + 1]
        valley = a + int(x[a : b + 1].argmin()) if b - a >= 2 else (a + b) // 2
        right[i], left[i + 1] = valley, min(valley + 1, b)
    return left, right


def detect(trains: list[np.ndarray], duration: float, p: EventParams = DEFAULT) -> list[dict]:
    """Event windows in order of their peaks."""
    centre, x = density(trains, duration, p)
    limit = floor(trains, duration, p)
    at = signal.peaks_and_prominences(x, limit, p.min_width_bins, p.min_distance_bins, span_bins(p))[0]
    base = baseline(x, p)
    noise = quiet_noise(x, base, p)
    threshold = base + p.threshold_k * noise
    left, right = extents(x, at, threshold, max(1, int(round(p.walk_s / p.bin_s))))
    if p.split:
        left, right = split_overlaps(x, at, left, right)
    start, end, peak = centre[left], centre[right], centre[at]
    mu, sigma = np.full(len(at), np.nan), np.full(len(at), np.nan)
    by_fit = np.zeros((2, len(at)), bool)
    if p.gaussian:
        z, pad = NormalDist().inv_cdf(p.gaussian_quantile), int(round(p.gaussian_pad_s / p.bin_s))
        for i in range(len(at)):
            here = slice(max(0, left[i] - pad), right[i] + pad + 1)
            w, t = np.maximum(x[here] - base[here], 0), centre[here]
            mu[i], sigma[i] = peak[i], p.gaussian_min_sigma_s
            if len(t) > 1 and w.sum() > 0:
                mu[i] = np.average(t, weights=w)
                sigma[i] = max(np.sqrt(np.average((t - mu[i]) ** 2, weights=w)), p.gaussian_min_sigma_s)
        by_fit = np.array([mu - z * sigma >= start, mu + z * sigma <= end])
        start, end = np.minimum(np.maximum(start, mu - z * sigma), peak), np.maximum(np.minimum(end, mu + z * sigma), peak)
    half = p.cap_s / 2
    if p.symmetric:
        start, end = peak - half, peak + half
    else:
        long = end - start > p.cap_s
        start, end = np.where(long, np.maximum(start, peak - half), start), np.where(long, np.minimum(end, peak + half), end)
    source = np.where(by_fit, "gaussian", "baseline")
    return [
        {"event_id": i, "start_s": float(start[i]), "peak_s": float(peak[i]), "end_s": float(end[i]), "height": float(x[at[i]]), "prominence": float(x[at[i]] - threshold[at[i]]), "mu_s": float(mu[i]), "sigma_s": float(sigma[i]), "source_left": str(source[0, i]), "source_right": str(source[1, i]), "floor": limit, "noise": noise}
        for i in range(len(at))
    ]


def backtrack(onsets: np.ndarray, lp: np.ndarray, window: int, min_rise: float = 0.0) -> np.ndarray:
    """Onsets moved to the foot of their rise: the lowest sample of the run below the onset's level that ends there.

    With ``min_rise`` > 0, onsets whose rise from the foot to the highest sample ahead is smaller are dropped.
    """
    lp, window, feet = np.asarray(lp, float), max(1, window), []
    for c in np.clip(np.asarray(onsets, int), 0, len(lp) - 1) if len(lp) else ():
        behind = lp[max(0, c - window) : c]
        above = np.flatnonzero(behind >= lp[c])
        begin = c - len(behind) + (above[-1] + 1 if len(above) else 0)
        foot = begin + int(lp[begin : c + 1].argmin())
        if min_rise <= 0 or lp[c : c + window + 1].max() - lp[foot] >= min_rise:
            feet.append(foot)
    return np.unique(np.array(feet, int))


def backtrack_window(fps: float, tau_s: float | None = None, cutoff: float = 1.0, explicit_s: float | None = None) -> int:
    seconds = explicit_s if explicit_s else max(tau_s or 0.0, 0.8 / cutoff)
    return max(1, int(round(seconds * fps)))
