"""Event detection against planted bursts and slow loops."""

from dataclasses import replace

import numpy as np

from tracelake.kernels import events as ev
from tracelake.kernels import signal


def slow_prominence(x, p, half):
    low = []
    for sign in (-1, 1):
        i, m = p, x[p]
        while 0 <= i + sign < len(x) and abs(i + sign - p) <= half and x[i + sign] <= x[p]:
            i += sign
            m = min(m, x[i])
        low.append(m)
    return x[p] - max(low)


def bursts(seed=1):
    r = np.random.default_rng(seed)
    at = np.arange(12) * 45.0 + 20
    return at, [np.sort(np.concatenate([at + r.normal(0, 0.05, 12), r.uniform(0, 597, 6)])) for _ in range(60)]


def test_prominences_against_a_walk():
    x = np.round(np.random.default_rng(0).random(500), 2)
    for span in (0, 41):
        at, drop = signal.peaks_and_prominences(x, 1e-12, 0, 1, span)
        assert len(at) > 100
        assert np.allclose(drop, [slow_prominence(x, p, span // 2 if span else 500) for p in at])
    assert len(signal.peaks(np.ones(50), 0.1)) == 0 and len(signal.peaks([], 0.1)) == 0


def test_planted_bursts():
    at, trains = bursts()
    found = ev.detect(trains, 597.2, replace(ev.DEFAULT, shuffles=20))
    assert len(found) == 12
    for e, t in zip(found, at, strict=True):
        assert abs(e["peak_s"] - t) < 0.1 and e["start_s"] <= e["peak_s"] <= e["end_s"] and e["end_s"] - e["start_s"] <= 0.5 + 1e-9
    fitted = ev.detect(trains, 597.2, replace(ev.DEFAULT, shuffles=20, gaussian=True))
    assert all(abs(e["mu_s"] - t) < 0.1 for e, t in zip(fitted, at, strict=True))
    even = ev.detect(trains, 597.2, replace(ev.DEFAULT, shuffles=20, symmetric=True))
    assert all(abs(e["end_s"] - e["start_s"] - 0.5) < 1e-9 for e in even)


def test_no_onsets_no_events():
    assert ev.detect([np.zeros(0)] * 4, 60.0) == [] and ev.detect([], 60.0) == []


def test_extents_and_split():
    x = np.array([0, 1, 3, 2, 1.5, 2, 4, 1, 0.0])
    left, right = ev.extents(x, np.array([2, 6]), np.full(9, 0.5), 10)
    assert left.tolist() == [1, 1] and right.tolist() == [7, 7]
    left, right = ev.split_overlaps(x, np.array([2, 6]), left, right)
    assert left.tolist() == [1, 5] and right.tolist() == [4, 7]
    assert ev.extents(x, np.array([6]), np.full(9, 0.5), 1)[0].tolist() == [5]


def test_backtrack():
    lp = np.array([2.0, 5, 1, 0.5, 1, 2, 3, 4, 3])
    assert ev.backtrack([5, 6], lp, 12).tolist() == [3]
    assert ev.backtrack([5], lp, 12, min_rise=10).tolist() == []
    assert ev.backtrack([], lp, 12).tolist() == []


def test_filters():
    x = np.sin(np.arange(300) / 40)
    assert np.abs(signal.zero_phase(x, 15.07) - x).max() < 0.05
    b, a = signal.sections(15.07, 1.0)[0]
    assert np.allclose(b, signal.butterworth2(15.07, 1.0)[0])
    whole = signal.run_section(x, b, a, (0, 0))[0]
    first, state = signal.run_section(x[:100], b, a, (0, 0))
    assert np.allclose(np.append(first, signal.run_section(x[100:], b, a, state)[0]), whole)
    f, p = signal.power(np.sin(2 * np.pi * 2 * np.arange(100) / 10), 10.0)
    assert f[p.argmax()] == 2
