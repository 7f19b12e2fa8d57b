"""A two-branch convolutional network in NumPy: an image patch and a trace to one logit; no Spark here.

Each branch is blocks of convolution, rectifier and maximum over pairs, then the mean of what is left and a linear layer; both
ends go through a hidden layer to the logit. Gradients are written out; ``tests`` hold them against differences.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

View = np.lib.stride_tricks.sliding_window_view


@dataclass(frozen=True)
class Shape:
    """Patches of ``channels`` x ``size`` x ``size`` and traces of one channel; widths of blocks and layers."""

    channels: int = 3
    size: int = 32
    spatial: tuple[int, ...] = (16, 32, 64)
    temporal: tuple[int, ...] = (16, 32, 64)
    width: int = 7
    embed: int = 64
    dense: int = 64


def start(shape: Shape, seed: int = 0) -> dict[str, np.ndarray]:
    """Weights of random sign and size by the number of inputs, biases 0."""
    r, out = np.random.default_rng(seed), {}

    def layer(name: str, *dims: int) -> None:
        out[f"{name}.w"] = r.standard_normal(dims) * np.sqrt(2 / np.prod(dims[1:]))
        out[f"{name}.b"] = np.zeros(dims[0])

    for branch, first, widths, kernel in (("s", shape.channels, shape.spatial, (3, 3)), ("t", 1, shape.temporal, (shape.width,))):
        for i, n in enumerate(widths):
            layer(f"{branch}{i}", n, first, *kernel)
            first = n
        layer(branch, shape.embed, first)
    layer("hidden", shape.dense, 2 * shape.embed)
    layer("logit", 1, shape.dense)
    return out


def _convolve(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Same-size convolution over one or two last axes, channels second; also the unfolded input."""
    kernel = w.shape[2:]
    axes = tuple(range(2, x.ndim))
    pad = [(0, 0), (0, 0), *((k // 2, k // 2) for k in kernel)]
    cols = View(np.pad(x, pad), kernel, axis=axes)
    cols = np.moveaxis(cols, 1, x.ndim - 1).reshape(len(x), *x.shape[2:], -1)
    return np.moveaxis(cols @ w.reshape(len(w), -1).T + b, -1, 1), cols


def _convolve_back(d: np.ndarray, cols: np.ndarray, w: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    flat = np.moveaxis(d, 1, -1)
    dw = (flat.reshape(-1, len(w)).T @ cols.reshape(-1, cols.shape[-1])).reshape(w.shape)
    db = flat.reshape(-1, len(w)).sum(0)
    if first:
        return dw, db, None
    turned = np.flip(w, tuple(range(2, w.ndim))).swapaxes(0, 1)
    return dw, db, _convolve(d, turned, np.zeros(turned.shape[0]))[0]


def _pool(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximum over pairs along each spatial axis, odd ends left out; and which of a cell's samples is the first greatest."""
    for axis in range(2, x.ndim):
        x = x[(slice(None),) * axis + (slice(x.shape[axis] // 2 * 2),)]
    if x.ndim == 3:
        cells = x.reshape(*x.shape[:2], -1, 2)
    else:
        n, c, h, w = x.shape
        cells = x.reshape(n, c, h // 2, 2, w // 2, 2).swapaxes(3, 4).reshape(n, c, h // 2, w // 2, 4)
    which = cells.argmax(-1)
    return np.take_along_axis(cells, which[..., None], -1)[..., 0], which


def _pool_back(d: np.ndarray, which: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(shape)
    cells = np.zeros((*d.shape, 2 if d.ndim == 3 else 4))
    np.put_along_axis(cells, which[..., None], d[..., None], -1)
    if d.ndim == 3:
        out[:, :, : 2 * d.shape[2]] = cells.reshape(*d.shape[:2], -1)
    else:
        n, c, h, w = d.shape
        out[:, :, : 2 * h, : 2 * w] = cells.reshape(n, c, h, w, 2, 2).swapaxes(3, 4).reshape(n, c, 2 * h, 2 * w)
    return out


def _branch(p: dict, name: str, x: np.ndarray) -> tuple[np.ndarray, list]:
    kept, i = [], 0
    while f"{name}{i}.w" in p:
        y, cols = _convolve(x, p[f"{name}{i}.w"], p[f"{name}{i}.b"])
        small = min(y.shape[2:]) < 2
        z = np.maximum(y, 0)
        out, which = (z, None) if small else _pool(z)
        kept.append((cols, y > 0, which, y.shape))
        x, i = out, i + 1
    mean = x.reshape(*x.shape[:2], -1).mean(2)
    return mean @ p[f"{name}.w"].T + p[f"{name}.b"], [kept, mean, x.shape]


def _branch_back(p: dict, name: str, d: np.ndarray, state: list, grads: dict) -> None:
    kept, mean, shape = state
    grads[f"{name}.w"], grads[f"{name}.b"] = d.T @ mean, d.sum(0)
    d = d @ p[f"{name}.w"] / np.prod(shape[2:])
    d = np.broadcast_to(d.reshape(*d.shape, *(1,) * (len(shape) - 2)), shape)
    for i in range(len(kept) - 1, -1, -1):
        cols, positive, which, full = kept[i]
        d = (d if which is None else _pool_back(d, which, full)) * positive
        grads[f"{name}{i}.w"], grads[f"{name}{i}.b"], d = _convolve_back(d, cols, p[f"{name}{i}.w"], i == 0)


def forward(p: dict, patches: np.ndarray, traces: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Logits of patches [n, channels, size, size] and traces [n, frames]."""
    a, s = _branch(p, "s", patches)
    b, t = _branch(p, "t", traces[:, None])
    both = np.concatenate([a, b], 1)
    hidden = np.maximum(both @ p["hidden.w"].T + p["hidden.b"], 0)
    return hidden @ p["logit.w"][0] + p["logit.b"][0], (s, t, both, hidden)


def gradients(p: dict, patches: np.ndarray, traces: np.ndarray, labels: np.ndarray, weight: float = 1.0) -> tuple[float, dict]:
    """Mean cross-entropy with positives weighing ``weight``, and its gradients."""
    logit, (s, t, both, hidden) = forward(p, patches, traces)
    w = np.where(labels > 0, weight, 1.0)
    loss = float((w * (np.logaddexp(0, logit) - labels * logit)).mean())
    d = w * (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - labels) / len(labels)
    grads = {"logit.w": (d @ hidden)[None], "logit.b": np.array([d.sum()])}
    d = d[:, None] * p["logit.w"] * (hidden > 0)
    grads["hidden.w"], grads["hidden.b"] = d.T @ both, d.sum(0)
    d = d @ p["hidden.w"]
    half = d.shape[1] // 2
    _branch_back(p, "s", d[:, :half], s, grads)
    _branch_back(p, "t", d[:, half:], t, grads)
    return loss, grads


class Adam:
    def __init__(self, rate: float):
        self.rate, self.n, self.m, self.v = rate, 0, {}, {}

    def step(self, p: dict, grads: dict) -> None:
        self.n += 1
        for k, g in grads.items():
            self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g
            self.v[k] = 0.999 * self.v.get(k, 0) + 0.001 * g * g
            p[k] = p[k] - self.rate * (self.m[k] / (1 - 0.9**self.n)) / (np.sqrt(self.v[k] / (1 - 0.999**self.n)) + 1e-8)


def flat(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def shaped(x: np.ndarray, like: dict) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = x[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out
