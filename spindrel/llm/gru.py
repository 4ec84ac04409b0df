"""Gated recurrent layers and Adam in numpy: forward, backward, nothing else."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def weights(rng: np.random.Generator, *shape: int) -> np.ndarray:
    return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)


def layer(rng: np.random.Generator, inputs: int, hidden: int, name: str) -> dict[str, np.ndarray]:
    """A layer's parameters: inputs to (update, reset, new), state to (update, reset), state to new, biases."""
    return {f"{name}.w": weights(rng, inputs, 3 * hidden), f"{name}.u": weights(rng, hidden, 2 * hidden), f"{name}.v": weights(rng, hidden, hidden), f"{name}.b": np.zeros(3 * hidden, np.float32)}


def step(p: dict, name: str, x: np.ndarray, h: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
    """One step from inputs already multiplied by w (plus b); rows with mask 0 keep a zero state."""
    n = h.shape[1]
    gates = sigmoid(x[:, : 2 * n] + h @ p[f"{name}.u"])
    z, r = gates[:, :n], gates[:, n:]
    new = np.tanh(x[:, 2 * n :] + (r * h) @ p[f"{name}.v"])
    out = (h + z * (new - h)) * mask[:, None]
    return out, (h, z, r, new, mask)


def run(p: dict, name: str, x: np.ndarray, mask: np.ndarray, reverse: bool = False, keep: bool = False) -> tuple[np.ndarray, list]:
    """x (rows, steps, 3 hidden), mask (rows, steps) -> states (rows, steps, hidden), and what `back` needs."""
    rows, steps, n = x.shape[0], x.shape[1], x.shape[2] // 3
    h, kept, states = np.zeros((rows, n), np.float32), [], np.empty((rows, steps, n), np.float32)
    for t in range(steps - 1, -1, -1) if reverse else range(steps):
        h, saved = step(p, name, x[:, t], h, mask[:, t])
        states[:, t] = h
        if keep:
            kept.append((t, saved))
    return states, kept


def back(p: dict, grads: dict, name: str, kept: list, grad: np.ndarray) -> np.ndarray:
    """Gradients of the states -> gradients of x (as in `run`); those of u and v are added to grads."""
    n = grad.shape[2]
    out = np.zeros((grad.shape[0], grad.shape[1], 3 * n), np.float32)
    carry = np.zeros((grad.shape[0], n), np.float32)
    u, v = p[f"{name}.u"], p[f"{name}.v"]
    for t, (h, z, r, new, mask) in reversed(kept):
        g = (grad[:, t] + carry) * mask[:, None]
        dnew = g * z * (1 - new * new)
        drh = dnew @ v.T
        dz, dr = g * (new - h) * z * (1 - z), drh * h * r * (1 - r)
        dgates = np.concatenate([dz, dr], axis=1)
        grads[f"{name}.u"] += h.T @ dgates
        grads[f"{name}.v"] += (r * h).T @ dnew
        out[:, t, : 2 * n], out[:, t, 2 * n :] = dgates, dnew
        carry = g * (1 - z) + drh * r + dgates @ u.T
    return out


class Adam:
    def __init__(self, p: dict, rate: float) -> None:
        self.rate, self.t = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.s = {k: np.zeros_like(v) for k, v in p.items()}

    def update(self, p: dict, grads: dict) -> None:
        self.t += 1
        scale = self.rate * (1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t)
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.s[k] += 0.001 * (g * g - self.s[k])
            p[k] -= scale * self.m[k] / (np.sqrt(self.s[k]) + 1e-7)
