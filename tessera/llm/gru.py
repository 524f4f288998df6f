"""A bidirectional gated recurrent network with attention pooling, in numpy.

Inputs are rows of a table (one a distinct word) and places into it; place 0 is padding,
which leaves states as they are and gets no attention.  States and inputs are float32.  Gates and
candidates use the softsign x / (1 + |x|) in place of sigmoid and tanh: the same shape at a
third of the time.
"""

from __future__ import annotations

import numpy as np

GATES = ("z", "r", "n")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def start(dim: int, hidden: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    p = {}
    for side in "fb":
        for g in GATES:
            p[f"W{g}{side}"] = rng.normal(0, dim ** -0.5, (dim, hidden))
            p[f"U{g}{side}"] = rng.normal(0, 0.5 * hidden ** -0.5, (hidden, hidden))
            p[f"b{g}{side}"] = np.full(hidden, -0.5 if g == "z" else 0.0)
    p["look"] = rng.normal(0, 0.5, 2 * hidden)
    p["out"] = rng.normal(0, 0.5, 2 * hidden)
    p["bias"] = np.zeros(1)
    return {k: v.astype(np.float32) for k, v in p.items()}


def _softsign(x: np.ndarray) -> np.ndarray:
    below = np.abs(x)
    below += 1
    x /= below
    return x


def _gate(x: np.ndarray) -> np.ndarray:
    """From 0 to 1, in place."""
    _softsign(x)
    x += 1
    x *= 0.5
    return x


def _states(p: dict, table: np.ndarray, places: np.ndarray, side: str, keep: list | None) -> np.ndarray:
    """Hidden states [step, window, unit]; ``keep`` gets what going back needs."""
    gates = [np.ascontiguousarray(table @ p[f"W{g}{side}"] + p[f"b{g}{side}"]) for g in GATES]
    u = [p[f"U{g}{side}"] for g in GATES]
    n, steps = places.shape
    h = np.zeros((n, len(u[0])), dtype=np.float32)
    out = np.empty((steps, *h.shape), dtype=np.float32)
    padded = ~places.all(axis=0)
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        at = places[:, t]
        z = _gate(np.take(gates[0], at, axis=0) + h @ u[0])
        r = _gate(np.take(gates[1], at, axis=0) + h @ u[1])
        hu = h @ u[2]
        new = r * hu
        new += np.take(gates[2], at, axis=0)
        _softsign(new)
        if keep is not None:
            keep.append((t, at, h, z, r, hu, new))
        after = h - new
        after *= z
        after += new  # z of the old state, the rest of the new one
        if padded[t]:
            after = np.where((at > 0)[:, None], after, h)
        h = out[t] = after
    return out


def forward(p: dict, table: np.ndarray, places: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logit of each window (a row of ``places``)."""
    sides = [[] if keep is not None else None for _ in "fb"]
    h = [_states(p, table, places, s, k) for s, k in zip("fb", sides)]
    units = h[0].shape[2]
    look = h[0] @ p["look"][:units] + h[1] @ p["look"][units:]  # [step, window]
    look = np.where(places.T > 0, look, np.float32(-1e9))
    look -= look.max(axis=0)
    share = np.exp(look)
    share /= share.sum(axis=0)
    pooled = np.concatenate([np.einsum("tb,tbh->bh", share, x) for x in h], axis=1)
    if keep is not None:
        keep.update(h=h, share=share, pooled=pooled, sides=sides)
    return pooled @ p["out"] + p["bias"]


def backward(p: dict, table: np.ndarray, places: np.ndarray, kept: dict, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the parameters and of the table's rows."""
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    d_table = np.zeros_like(table)
    h, share, pooled = kept["h"], kept["share"], kept["pooled"]
    units = h[0].shape[2]
    grads["out"], grads["bias"] = d_logit @ pooled, np.array([d_logit.sum()], np.float32)
    d_pooled = d_logit[:, None] * p["out"]
    for k, side in enumerate("fb"):
        own = slice(k * units, (k + 1) * units)
        pull = d_pooled[:, own]
        d_h = share[:, :, None] * pull
        # through the softmax: each state's pull less their mean, both sides together
        d_look = share * (np.einsum("tbh,bh->tb", h[0], d_pooled[:, :units]) + np.einsum("tbh,bh->tb", h[1], d_pooled[:, units:])
                          - (pooled * d_pooled).sum(axis=1))
        grads["look"][own] = np.einsum("tb,tbh->h", d_look, h[k])
        d_h += d_look[:, :, None] * p["look"][own]
        carried = np.zeros_like(pull)
        w, u = ([p[f"{m}{g}{side}"] for g in GATES] for m in "WU")
        for t, at, before, z, r, hu, new in reversed(kept["sides"][k]):
            d = d_h[t] + carried
            live = (at > 0)[:, None]
            stay, d = np.where(live, 0, d), np.where(live, d, 0)
            # slope of the softsign: the square of 1 - |value|
            d_new = d * (1 - z) * (1 - np.abs(new)) ** 2
            d_r = d_new * hu * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            d_z = d * (before - new) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            carried = stay + d * z
            for g, dg, through in zip(GATES, (d_z, d_r, d_new), (d_z, d_r, d_new * r)):
                grads[f"U{g}{side}"] += before.T @ through
                grads[f"b{g}{side}"] += dg.sum(axis=0)
                carried += through @ u[GATES.index(g)].T
                grads[f"W{g}{side}"] += table[at].T @ dg
            np.add.at(d_table, at, d_z @ w[0].T + d_r @ w[1].T + d_new @ w[2].T)
    d_table[0] = 0
    return grads, d_table


class Adam:
    def __init__(self, p: dict, rate: float = 0.01):
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in "mv")

    def step(self, grads: dict) -> None:
        self.t += 1
        fix = self.rate * (1 - 0.999 ** self.t) ** 0.5 / (1 - 0.9 ** self.t)
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.p[k] -= (fix * self.m[k] / (np.sqrt(self.v[k]) + 1e-7)).astype(np.float32)
