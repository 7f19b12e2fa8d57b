"""The two-branch network: gradients against differences, training with early stop, scores of held-out rows."""

import numpy as np
import pytest

from tracelake.kernels import network
from tracelake.operators import cells

SMALL = network.Shape(channels=2, size=7, spatial=(3, 4), temporal=(2, 3), width=3, embed=4, dense=5)


def test_gradients():
    r = np.random.default_rng(0)
    p = {k: v + 0.05 * r.standard_normal(v.shape) for k, v in network.start(SMALL).items()}
    patches, traces, labels = r.standard_normal((6, 2, 7, 7)), r.standard_normal((6, 11)), np.array([0, 1, 1, 0, 0, 1.0])
    loss, grads = network.gradients(p, patches, traces, labels, 2.5)
    assert set(grads) == set(p)
    for k in p:
        for _ in range(6):
            at = tuple(r.integers(0, n) for n in p[k].shape)
            low, high = ({**p, k: p[k].copy()} for _ in range(2))
            low[k][at] -= 1e-6
            high[k][at] += 1e-6
            slope = (network.gradients(high, patches, traces, labels, 2.5)[0] - network.gradients(low, patches, traces, labels, 2.5)[0]) / 2e-6
            assert abs(slope - grads[k][at]) < 1e-6 + 1e-4 * abs(slope), k
    assert all((network.shaped(network.flat(p), p)[k] == p[k]).all() for k in p)


def test_convolution_is_a_sum_over_neighbours():
    r = np.random.default_rng(1)
    x, w, b = r.standard_normal((2, 3, 5, 4)), r.standard_normal((2, 3, 3, 3)), r.standard_normal(2)
    got, _ = network._convolve(x, w, b)
    for n, o, i, j in ((0, 0, 0, 0), (1, 1, 2, 3), (0, 1, 4, 1)):
        want = b[o] + sum(x[n, c, i + u, j + v] * w[o, c, u + 1, v + 1] for c in range(3) for u in (-1, 0, 1) for v in (-1, 0, 1) if 0 <= i + u < 5 and 0 <= j + v < 4)
        assert abs(got[n, o, i, j] - want) < 1e-9


def test_training_finds_cells(spark):
    r = np.random.default_rng(2)
    rows = []
    for i in range(240):
        label = int(i % 3 == 0)
        patch, trace = r.standard_normal((1, 8, 8)), r.standard_normal(24)
        if label:
            patch[0, 3:6, 3:6] += 1.5
            trace[8:12] += 2
        rows.append((f"r{i % 7}", i, patch.ravel().tolist(), trace.tolist(), label, i % 4 == 1))
    df = spark.createDataFrame(rows, "rec_id string, roi_id int, patch array<double>, trace array<double>, label int, validation boolean")
    shape = network.Shape(channels=1, size=8, spatial=(4, 8), temporal=(4, 8), width=5, embed=8, dense=8)
    model = cells.fit_network(df, shape, epochs=9, patience=2, rate=1e-2, trainers=2)
    best = max(h[2] for h in model.history)
    assert best > 0.9 and model.history[-1][1] < model.history[0][1]
    got = {g.roi_id: g.p_cell for g in cells.score(df, model).collect()}
    held = [(got[i], label) for _, i, _, _, label, v in rows if v]
    pairs = [(a > b) + 0.5 * (a == b) for a, x in held if x for b, y in held if not y]
    assert abs(np.mean(pairs) - best) < 1e-9
    again = cells.fit_network(df, shape, epochs=2, rate=1e-2, trainers=2)
    assert np.allclose([h[1:] for h in again.history], [h[1:] for h in model.history[:2]])
    none = cells.fit_network(df.where("not validation"), shape, epochs=1, trainers=2)
    assert len(none.history) == 1 and np.isnan(none.history[0][2])
    with pytest.raises(ValueError, match="no rows"):
        cells.fit_network(df.limit(0), shape, epochs=1)
