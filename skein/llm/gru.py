"""A bidirectional gated recurrent network with attention pooling, in numpy.

Each word enters as a word vector beside the mean of its character n-gram vectors (both from hashed
tables). Attention weighs the states of both directions; a logistic unit scores the window.
"""

from __future__ import annotations

import numpy as np

WORD_ROWS, CHAR_ROWS = 1 << 13, 1 << 15
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 12, 24, 24, 16
IN = WORD_DIM + CHAR_DIM


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def new_weights(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    made = lambda *shape: (rng.standard_normal(shape) * (shape[0] ** -0.5)).astype(np.float32)
    w = {"words": (rng.standard_normal((WORD_ROWS, WORD_DIM)) * 0.1).astype(np.float32), "chars": (rng.standard_normal((CHAR_ROWS, CHAR_DIM)) * 0.3).astype(np.float32)}
    for d in "fb":
        w |= {f"W{d}": made(IN, 3 * HIDDEN), f"U{d}": made(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
    w |= {"A": made(2 * HIDDEN, ATTENTION), "a": np.zeros(ATTENTION, np.float32), "v": made(ATTENTION), "o": made(2 * HIDDEN), "c": np.zeros(1, np.float32)}
    return w


def _run(given: np.ndarray, mask: np.ndarray, U: np.ndarray, back: bool, keep: bool) -> tuple[np.ndarray, list]:
    """States of one direction. ``given``: inputs times W plus b, batch x time x 3 hidden."""
    n, length, _ = given.shape
    h, out, memory = np.zeros((n, HIDDEN), np.float32), np.zeros((n, length, HIDDEN), np.float32), []
    for t in range(length)[:: -1 if back else 1]:
        g, m = given[:, t], mask[:, t, None]
        u = h @ U
        zr = _sigmoid(g[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        new = np.tanh(g[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
        after = m * ((1 - z) * new + z * h) + (1 - m) * h
        if keep:
            memory.append((t, h, z, r, new, u, m))
        h = after
        out[:, t] = h
    return out, memory


def _pool(w: dict, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    hidden = np.tanh(states @ w["A"] + w["a"])
    weight = np.exp(np.clip(hidden @ w["v"], -30, 30)) * mask
    weight /= np.maximum(weight.sum(1, keepdims=True), 1e-9)
    pooled = (states * weight[..., None]).sum(1)
    return _sigmoid(pooled @ w["o"] + w["c"]), pooled, weight, hidden


def project(w: dict, x: np.ndarray) -> np.ndarray:
    """What both directions take of inputs x: the same for a word wherever it stands."""
    return np.concatenate([x @ w["Wf"] + w["bf"], x @ w["Wb"] + w["bb"]], -1)


def score(w: dict, projected: np.ndarray, mask: np.ndarray) -> np.ndarray:
    forward, _ = _run(projected[..., : 3 * HIDDEN], mask, w["Uf"], False, False)
    backward, _ = _run(projected[..., 3 * HIDDEN :], mask, w["Ub"], True, False)
    return _pool(w, np.concatenate([forward, backward], -1), mask)[0]


def gradients(w: dict, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray, float]:
    """Gradients of the mean weighted log loss by the dense weights and by the inputs x, and the loss."""
    memory, states = {}, []
    for d, back in (("f", False), ("b", True)):
        out, memory[d] = _run(x @ w[f"W{d}"] + w[f"b{d}"], mask, w[f"U{d}"], back, True)
        states.append(out)
    s = np.concatenate(states, -1)
    p, pooled, alpha, hidden = _pool(w, s, mask)
    n = len(y)
    loss = float(-(weight * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).mean())
    dp = (weight * (p - y) / n).astype(np.float32)
    grad = {"o": pooled.T @ dp, "c": dp.sum(keepdims=True)}
    dpool = dp[:, None] * w["o"]
    ds = alpha[..., None] * dpool[:, None]
    dalpha = (s * dpool[:, None]).sum(-1)
    de = alpha * (dalpha - (alpha * dalpha).sum(1, keepdims=True))
    grad["v"] = np.einsum("nta,nt->a", hidden, de)
    dh = de[..., None] * w["v"] * (1 - hidden**2)
    grad["A"], grad["a"] = np.einsum("nts,nta->sa", s, dh), dh.sum((0, 1))
    ds = ds + dh @ w["A"].T
    dx = np.zeros_like(x)
    for d, part in (("f", ds[..., :HIDDEN]), ("b", ds[..., HIDDEN:])):
        W, U = w[f"W{d}"], w[f"U{d}"]
        dW, dU, db, carry = np.zeros_like(W), np.zeros_like(U), np.zeros(3 * HIDDEN, np.float32), np.zeros((n, HIDDEN), np.float32)
        for t, h, z, r, new, u, m in reversed(memory[d]):
            total = part[:, t] + carry
            inner = total * m
            dnew = inner * (1 - z) * (1 - new**2)
            dz = inner * (h - new) * z * (1 - z)
            dr = dnew * u[:, 2 * HIDDEN :] * r * (1 - r)
            dg = np.concatenate([dz, dr, dnew], 1)
            du = np.concatenate([dz, dr, dnew * r], 1)
            dW += x[:, t].T @ dg
            dU += h.T @ du
            db += dg.sum(0)
            dx[:, t] += dg @ W.T
            carry = total * (1 - m) + inner * z + du @ U.T
        grad |= {f"W{d}": dW, f"U{d}": dU, f"b{d}": db}
    return grad, dx, loss
