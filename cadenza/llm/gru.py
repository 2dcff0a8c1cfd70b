"""A bidirectional gated recurrent network in numpy: forward over many sequences at once, backpropagation through time.

Gates use the piecewise linear sigmoid and the candidate state the piecewise linear tanh, which cost no exponentials and
have exact derivatives. States are (sequences, units); the two directions are two networks over reversed steps.
"""

from __future__ import annotations

import numpy as np

GATES = ("r", "z", "n")


def hard_sigmoid(x: np.ndarray) -> np.ndarray:
    return np.clip(0.25 * x + 0.5, 0, 1)


def init_direction(rng: np.random.Generator, units: int) -> dict[str, np.ndarray]:
    return {f"U{g}": (rng.normal(size=(units, units)) * 0.5 / np.sqrt(units)).astype(np.float32) for g in GATES}


def ends_forward(tables: dict[str, np.ndarray], U: dict[str, np.ndarray], ids: np.ndarray, active: list[int]) -> tuple[np.ndarray, list]:
    """End states (rows, units) of sequences sorted from the longest on: step t has the first active[t] rows.

    Gate inputs are rows of `tables` by the ids (steps, rows).
    """
    h, tape = np.zeros((ids.shape[1], tables["n"].shape[1]), np.float32), []
    for t, k in enumerate(active):
        own, at = h[:k].copy(), ids[t, :k]
        ar, az = tables["r"][at] + own @ U["Ur"], tables["z"][at] + own @ U["Uz"]
        r, z = hard_sigmoid(ar), hard_sigmoid(az)
        rh = r * own
        an = tables["n"][at] + rh @ U["Un"]
        n = np.clip(an, -1, 1)
        tape.append((own, r, z, n, rh, np.abs(ar) < 2, np.abs(az) < 2, np.abs(an) < 1))
        h[:k] = own + (1 - z) * (n - own)
    return h, tape


def ends_backward(dh: np.ndarray, tape: list, U: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, list[np.ndarray]]]:
    """Gradients of U, and of each step's gate inputs, from those of the end states."""
    grads, dins, dh = {k: np.zeros_like(v) for k, v in U.items()}, {g: [] for g in GATES}, dh.copy()
    for own, r, z, n, rh, lr, lz, ln in reversed(tape):
        k = len(own)
        d = dh[:k]
        dn, dz = d * (1 - z) * ln, d * (own - n) * 0.25 * lz
        drh = dn @ U["Un"].T
        dr = drh * own * 0.25 * lr
        grads["Un"] += rh.T @ dn
        grads["Uz"] += own.T @ dz
        grads["Ur"] += own.T @ dr
        for g, v in (("r", dr), ("z", dz), ("n", dn)):
            dins[g].append(v)
        dh[:k] = d * z + drh * r + dz @ U["Uz"].T + dr @ U["Ur"].T
    return grads, {g: v[::-1] for g, v in dins.items()}


def forward(inputs: dict[str, np.ndarray], U: dict[str, np.ndarray], mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States (steps, rows, units) from gate inputs (steps, rows, units); a step of mask 0 leaves the state as it is."""
    steps, rows, units = inputs["n"].shape
    h, out, tape = np.zeros((rows, units), np.float32), np.empty((steps, rows, units), np.float32), []
    for t in range(steps):
        ar, az = inputs["r"][t] + h @ U["Ur"], inputs["z"][t] + h @ U["Uz"]
        r, z = hard_sigmoid(ar), hard_sigmoid(az)
        rh = r * h
        an = inputs["n"][t] + rh @ U["Un"]
        n = np.clip(an, -1, 1)
        m = mask[t][:, None]
        new = h + m * (1 - z) * (n - h)
        if keep:
            tape.append((h, r, z, n, rh, np.abs(ar) < 2, np.abs(az) < 2, np.abs(an) < 1, m))
        h = new
        out[t] = h
    return out, tape


def backward(dout: np.ndarray, tape: list, U: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Gradients of U and of the gate inputs, from those of the states."""
    grads = {k: np.zeros_like(v) for k, v in U.items()}
    dins = {g: np.zeros_like(dout) for g in GATES}
    dh = np.zeros_like(dout[0])
    for t in range(len(tape) - 1, -1, -1):
        h, r, z, n, rh, lr, lz, ln, m = tape[t]
        dh = dh + dout[t]
        dn = dh * m * (1 - z) * ln
        dz = dh * m * (h - n) * 0.25 * lz
        drh = dn @ U["Un"].T
        dr = drh * h * 0.25 * lr
        grads["Un"] += rh.T @ dn
        grads["Uz"] += h.T @ dz
        grads["Ur"] += h.T @ dr
        dins["n"][t], dins["z"][t], dins["r"][t] = dn, dz, dr
        dh = dh * (1 - m * (1 - z)) + drh * r + dz @ U["Uz"].T + dr @ U["Ur"].T
    return grads, dins


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float) -> None:
        self.p, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray], scale: float = 1.0) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
        clip = min(1.0, 1.0 / (norm + 1e-12))
        for k, g in grads.items():
            g = g * clip
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            self.p[k] -= (self.rate * scale * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-8)).astype(np.float32)


class Fast:
    """Forward only, without temporaries, for one direction: rows of precomputed gate inputs are gathered by id."""

    def __init__(self, tables: dict[str, np.ndarray], U: dict[str, np.ndarray], rows: int) -> None:
        scale = {"r": 0.25, "z": 0.25, "n": 1.0}  # the linear sigmoid's slope and offset go into the tables
        self.tables = {g: np.ascontiguousarray(tables[g] * scale[g] + (0 if g == "n" else 0.5), np.float32) for g in GATES}
        self.U = {g: np.ascontiguousarray(U[f"U{g}"] * scale[g], np.float32) for g in GATES}
        self.units = next(iter(U.values())).shape[0]
        self.buffers = [np.empty((rows, self.units), np.float32) for _ in range(4)]

    def start(self, rows: int) -> np.ndarray:
        return np.zeros((rows, self.units), np.float32)

    def step(self, ids: np.ndarray, h: np.ndarray) -> None:
        """Advance the states `h` in place by one step; the last table row must leave a state near zero unchanged."""
        a, r, z, n = (b[: len(h)] for b in self.buffers)
        np.take(self.tables["r"], ids, axis=0, out=r, mode="clip")
        np.take(self.tables["z"], ids, axis=0, out=z, mode="clip")
        np.take(self.tables["n"], ids, axis=0, out=n, mode="clip")
        np.matmul(h, self.U["r"], out=a)
        r += a
        np.clip(r, 0, 1, out=r)
        np.matmul(h, self.U["z"], out=a)
        z += a
        np.clip(z, 0, 1, out=z)
        r *= h
        np.matmul(r, self.U["n"], out=a)
        n += a
        np.clip(n, -1, 1, out=n)
        h -= n
        h *= z
        h += n
