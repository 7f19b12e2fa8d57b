"""Kernels against slow loops, and planted truth."""

import numpy as np
import pytest

from tracelake.kernels import signal, stats


def test_lowpass_keeps_a_constant():
    b, a = signal.butterworth2(15.07, 1.0)
    assert abs(b.sum() / a.sum() - 1) < 1e-12
    for init in ("steady", "padded"):
        assert np.abs(signal.lowpass(np.ones(200), 15.07, init=init)[150:] - 1).max() < 1e-6
    assert signal.lowpass(np.ones(50), 15.07).max() > 2  # the start that holds the first sample overshoots


def test_savgol_is_exact_on_parabolas():
    t = np.arange(40) / 15.07
    assert np.allclose(signal.savgol_derivative(3 * t * t + t, 15.07), 6 * t + 1)


def test_interpolate_and_flat():
    assert signal.interpolate([np.nan, 1, np.nan, 3, np.nan]).tolist() == [1, 1, 2, 3, 3]
    assert signal.interpolate([np.nan] * 3).tolist() == [0, 0, 0]
    assert len(signal.hysteresis(signal.robust_z(np.ones(300)))) == 0


def test_hysteresis_against_a_loop():
    z = np.random.default_rng(0).standard_normal(2000) * 2
    on, found = False, []
    for i, v in enumerate(z):
        if not on and v >= 3:
            on = True
            found.append(i)
        elif on and v <= 1:
            on = False
    assert signal.hysteresis(z, 3, 1).tolist() == found


def test_rolling_rank_against_sorting():
    x = np.random.default_rng(1).standard_normal(60)
    y = np.pad(x, (3, 3), mode="edge")
    assert signal.rolling_rank(x, 7, 10).tolist() == [sorted(y[i : i + 7])[0] for i in range(60)]


def test_peaks():
    x = np.zeros(60)
    x[10], x[9], x[11] = 5, 2, 2
    x[30:33] = 4
    x[50] = 0.5
    assert signal.peaks(x, 1.0).tolist() == [10, 31]


def test_lag_and_leader():
    r = np.random.default_rng(2)
    a = r.standard_normal(600)
    b = np.roll(a, 5) + 0.1 * r.standard_normal(600)
    lag, best, _ = stats.lagged(a[:, None], b[:, None], 10.0, 2.0)
    assert lag[0, 0] == -0.5 and best[0, 0] > 0.9
    assert stats.lagged(np.ones((100, 1)), np.ones((100, 1)), 10.0, 2.0)[0][0, 0] == -2.0
    assert stats.shift_null(a[:, None], b[:, None], 10.0, 2.0, 50)[0, 0] == pytest.approx(1 / 51)
    assert stats.shift_null(a[:20, None], b[:20, None], 10.0, 2.0, 50)[0, 0] == 1


def test_fdr():
    assert np.allclose(stats.fdr([0.01, 0.04, 0.03, 0.5]), [0.04, 0.05333333, 0.05333333, 0.5])
    assert len(stats.fdr([])) == 0


def test_ward_against_all_pairs():
    x = np.random.default_rng(3).standard_normal((12, 4))
    z = stats.ward(x)
    groups, heights = [[i] for i in range(12)], []
    cost = lambda a, b: np.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(x[a].mean(0) - x[b].mean(0))
    while len(groups) > 1:
        h, i, j = min((cost(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i))
        heights.append(h)
        groups[j] += groups.pop(i)
    assert np.allclose(z[:, 2], heights)
    assert z[-1, 3] == 12 and len(set(stats.cut(z, z[-4, 2]))) == 4


def test_ward_of_equal_rows_takes_the_lowest_nodes():
    r = np.random.default_rng(11)
    x = np.repeat(r.integers(-9, 9, (5, 3)), [1, 2, 4, 5, 3], 0)[r.permutation(15)].astype(float)
    nodes, want = {i: (1, v) for i, v in enumerate(x)}, []
    while len(nodes) > 1:
        d, i, j = min((round(2 * p * q / (p + q) * float(((a - b) ** 2).sum()), 9), i, j) for i, (p, a) in nodes.items() for j, (q, b) in nodes.items() if i < j)
        (p, a), (q, b) = nodes.pop(i), nodes.pop(j)
        nodes[15 + len(want)] = p + q, (p * a + q * b) / (p + q)
        want.append((i, j, np.sqrt(d), p + q))
    assert np.allclose(stats.ward(x), want)
    for bad in (np.nan, np.inf):
        with pytest.raises(ValueError):
            stats.ward(np.array([[0.0], [1.0], [bad]]))


def test_ward_in_memory_of_its_rows():
    import tracemalloc

    r = np.random.default_rng(12)
    x = np.concatenate([r.standard_normal((2000, 8)) * 0.1 + c for c in (0, 5, 11)]) * 1e30
    tracemalloc.start()
    z = stats.ward(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20  # the distances of all pairs take 288 MB
    assert sorted(z[-2:, 3]) == [4000, 6000] and (np.diff(z[:, 2]) >= 0).all()


def test_direction_and_drift():
    r = np.random.default_rng(4)
    x, y = r.uniform(0, 100, 30), r.uniform(0, 100, 30)
    theta, rho, p = stats.monotonicity(x, y, x * np.cos(np.pi / 6) + y * np.sin(np.pi / 6), shuffles=200)
    assert abs(np.degrees(theta) - 30) <= 3 and rho > 0.99 and p < 0.02
    assert stats.monotonicity([0, 1], [0, 1], [0, 1]) is None
    t = np.zeros(4000)
    t[1000:] += 50
    t[3000:] += 50
    assert stats.steps(t + r.standard_normal(4000) * 0.1).tolist() == [1000, 3000]


def test_partial_and_sign_flip():
    r = np.random.default_rng(5)
    a = r.standard_normal(2000)
    x = np.stack([a, a + r.standard_normal(2000), a + r.standard_normal(2000)], 1)
    assert abs(stats.partial(x)[1, 2]) < 0.1 < stats.zscore(x)[:, 1] @ stats.zscore(x)[:, 2] / 2000
    assert stats.partial(x[:5]) is None
    assert stats.sign_flip(np.ones(20), 500) < 0.01 and stats.sign_flip(r.standard_normal(50), 500) > 0.001


@pytest.mark.parametrize("init", ["first_sample", "steady", "padded"])
def test_lowpass_of_a_matrix(init):
    x = np.random.default_rng(6).standard_normal((5, 80))
    assert np.allclose(signal.lowpass(x, 15.07, init=init), [signal.lowpass(v, 15.07, init=init) for v in x])
    b, a = signal.butterworth2(15.07, 1.0)
    y = signal.lowpass(x[0], 15.07)
    slow = [b[0] * x[0, 0] + x[0, 0]]
    assert y[0] == pytest.approx(slow[0])
    for i in range(2, 80):  # the difference equation
        assert signal.lowpass(x[0], 15.07, init=init)[i] == pytest.approx(b @ x[0, [i, i - 1, i - 2]] - a[1] * signal.lowpass(x[0], 15.07, init=init)[i - 1] - a[2] * signal.lowpass(x[0], 15.07, init=init)[i - 2])


def test_sliding_order_statistics():
    r = np.random.default_rng(0)
    x = r.standard_normal((6, 900)).round(1)
    for window, edge in ((677, "edge"), (5, "symmetric"), (200, "symmetric"), (1, "edge")):
        left = window // 2
        wide = np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (left, window - 1 - left)), mode=edge), window, axis=1)
        want = np.sort(wide, axis=2)[:, :, min(window - 1, int(window * 10 / 100))]
        for small in (0, 10**9):
            signal.SMALL, before = small, signal.SMALL
            got = signal.rolling_ranks(x, window, 10, edge)
            signal.SMALL = before
            assert (got == want).all()


def test_shift_null_equals_a_sweep_for_each_draw():
    r = np.random.default_rng(1)
    a, b = r.standard_normal((400, 5)).cumsum(0), r.standard_normal((400, 3)).cumsum(0)
    a[:, 2] = 3
    for fps, most in ((15, 1), (10, 2), (1, 0)):
        limit, draws, hits = int(fps * most), np.random.default_rng(3), 0
        real = stats.lagged(a, b, fps, most)[1]
        for _ in range(40):
            hits = hits + (stats.lagged(np.roll(a, int(draws.integers(limit + 1, 400 - limit - 1)), 0), b, fps, most)[1] >= real)
        for cells in (1, 8_000_000):
            assert np.allclose(stats.shift_null(a, b, fps, most, 40, 3, cells), (1 + hits) / 41)


def test_sign_flip_and_leading_vector():
    r = np.random.default_rng(2)
    x = r.standard_normal(9) + 0.5
    signs = 1 - 2 * ((np.arange(512)[:, None] >> np.arange(9)) & 1)
    exact = (np.abs(signs @ x) >= abs(x.sum()) - 1e-12).mean()
    assert abs(stats.sign_flip(x, 40_000) - exact) < 0.01 and stats.sign_flip(np.zeros(4)) == 1
    g = r.standard_normal((50, 20))
    v, w = stats.leading_vector(g.T @ g), np.linalg.eigh(g.T @ g)[1][:, -1]
    assert min(np.abs(v - w).max(), np.abs(v + w).max()) < 1e-9
