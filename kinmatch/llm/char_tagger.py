"""A character-level bidirectional LSTM with CRF transitions, trained and applied in numpy.

Characters become classes (letters without case, one class for digits, single
signs, one class for everything beyond ASCII). Training runs backpropagation
through time and the CRF's forward-backward algorithm with Adam. Applying it
runs many windows side by side; a window whose best path is provably the empty
one is not decoded.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

KINDS = ("email", "ip", "card", "phone")
N_LABELS = len(KINDS) + 1
_SIGNS = "@.-+()[]{}_%,:;/\\\"'=#*!?<>&|~ \n\t"
PAD = 0
_OTHER = 1
_WIDE = 2
_DIGIT = 3


def _classes() -> np.ndarray:
    out = np.full(256, _OTHER, dtype=np.int16)
    out[128:] = _WIDE
    for c in range(10):
        out[48 + c] = _DIGIT
    for c in range(26):
        out[65 + c] = out[97 + c] = 4 + c
    for i, s in enumerate(_SIGNS):
        out[ord(s)] = 30 + i
    return out


CLASS_OF = _classes()
N_CLASSES = 30 + len(_SIGNS)


def classes_of(data: np.ndarray) -> np.ndarray:
    """One class for each code point of UTF-8 bytes."""
    return CLASS_OF[data[(data & 0xC0) != 0x80]]


@dataclass(frozen=True)
class Training:
    hidden: int = 8
    epochs: int = 12
    batch: int = 128
    rate: float = 0.02
    seed: int = 3


class Tagger:
    """Weights: for either direction a table of gate inputs by class, recurrent weights; then emissions and transitions."""

    def __init__(self, hidden: int, seed: int = 0) -> None:
        random = np.random.default_rng(seed)
        h = hidden
        self.hidden = h
        self.w: dict[str, np.ndarray] = {}
        for d in ("f", "b"):
            self.w[f"x{d}"] = random.normal(0, 0.3, (N_CLASSES, 4 * h))
            self.w[f"x{d}"][:, h : 2 * h] += 1.0  # remember at first
            self.w[f"u{d}"] = random.normal(0, 0.3, (h, 4 * h))
        self.w["v"] = random.normal(0, 0.3, (2 * h, N_LABELS))
        self.w["c"] = np.zeros(N_LABELS)
        self.w["c"][0] = 2.0
        self.w["t"] = np.where(np.eye(N_LABELS) > 0, 1.0, -1.0)

    # training

    def _run(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """Hidden states of (batch, time) classes, in order of time, and what backpropagation needs."""
        n, steps = x.shape
        h = self.hidden
        table, u = self.w[f"x{d}"], self.w[f"u{d}"]
        state, cell = np.zeros((n, h)), np.zeros((n, h))
        out, kept = np.zeros((steps, n, h)), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = table[x[:, t]] + state @ u
            s = 0.5 * np.tanh(0.5 * z[:, : 3 * h]) + 0.5
            i, f, o, g = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :], np.tanh(z[:, 3 * h :])
            before, last = cell, state
            cell = f * cell + i * g
            th = np.tanh(cell)
            state = o * th
            out[t] = state
            kept.append((t, i, f, o, g, before, last, th))
        return out, kept

    def _back(self, x: np.ndarray, d: str, kept: list, grad: np.ndarray, into: dict[str, np.ndarray]) -> None:
        h = self.hidden
        u = self.w[f"u{d}"]
        gx, gu = np.zeros_like(self.w[f"x{d}"]), np.zeros_like(u)
        dh, dc = np.zeros(grad.shape[1:]), np.zeros(grad.shape[1:])
        for t, i, f, o, g, before, last, th in reversed(kept):
            dh = dh + grad[t]
            dc = dc + dh * o * (1 - th * th)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            np.add.at(gx, x[:, t], dz)
            gu += last.T @ dz
            dh, dc = dz @ u.T, dc * f
        into[f"x{d}"], into[f"u{d}"] = gx, gu

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of labels y (batch, time), and its gradients."""
        n, steps = x.shape
        hf, kept_f = self._run(x, "f")
        hb, kept_b = self._run(x, "b")
        both = np.concatenate([hf, hb], axis=2)
        e = both @ self.w["v"] + self.w["c"]
        t = self.w["t"]
        alpha = np.zeros_like(e)
        alpha[0] = e[0]
        lse = lambda a, axis: (m := a.max(axis=axis)) + np.log(np.exp(a - np.expand_dims(m, axis)).sum(axis=axis))
        for k in range(1, steps):
            alpha[k] = lse(alpha[k - 1][:, :, None] + t, 1) + e[k]
        beta = np.zeros_like(e)
        for k in range(steps - 2, -1, -1):
            beta[k] = lse(t + (e[k + 1] + beta[k + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        rows = np.arange(n)
        score = e[0, rows, y[:, 0]]
        gold_t = np.zeros_like(t)
        for k in range(1, steps):
            score = score + e[k, rows, y[:, k]] + t[y[:, k - 1], y[:, k]]
            np.add.at(gold_t, (y[:, k - 1], y[:, k]), 1)
        ge = np.exp(alpha + beta - z[None, :, None])
        gt = np.zeros_like(t)
        for k in range(1, steps):
            gt += np.exp(alpha[k - 1][:, :, None] + t + (e[k] + beta[k])[:, None, :] - z[:, None, None]).sum(axis=0)
        ge[np.arange(steps)[:, None], rows[None, :], y.T] -= 1
        ge /= n
        grads = {"t": (gt - gold_t) / n, "v": np.einsum("tnh,tnk->hk", both, ge), "c": ge.sum(axis=(0, 1))}
        gh = ge @ self.w["v"].T
        self._back(x, "f", kept_f, gh[:, :, : self.hidden], grads)
        self._back(x, "b", kept_b, gh[:, :, self.hidden :], grads)
        return float((z - score).mean()), grads

    def fit(self, x: np.ndarray, y: np.ndarray, p: Training) -> list[float]:
        """Adam over shuffled batches; the mean loss of each epoch."""
        random = np.random.default_rng(p.seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        step, history = 0, []
        total = p.epochs * -(-len(x) // p.batch)
        for _ in range(p.epochs):
            order, losses = random.permutation(len(x)), []
            for lo in range(0, len(x), p.batch):
                some = order[lo : lo + p.batch]
                value, grads = self.loss(x[some], y[some])
                losses.append(value)
                norm = np.sqrt(sum((g * g).sum() for g in grads.values()))
                step += 1
                rate = p.rate * min(1.0, 2.0 * (1 - step / (total + 1)))
                for k, g in grads.items():
                    g = g * min(1.0, 5.0 / (norm + 1e-12))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.99 * s[k] + 0.01 * g * g
                    self.w[k] = self.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
            history.append(float(np.mean(losses)))
        return history

    # application

    def packed(self) -> dict[str, np.ndarray]:
        """Weights for ``emissions``: gates first, single precision, halved where a sigmoid is made of a tanh."""
        h = self.hidden
        half = np.concatenate([np.full(3 * h, 0.5), np.ones(h)])
        out = {f"x{d}": np.ascontiguousarray((self.w[f"x{d}"] * half).T.astype(np.float32)) for d in ("f", "b")}
        out |= {f"u{d}": np.ascontiguousarray((self.w[f"u{d}"] * half).T.astype(np.float32)) for d in ("f", "b")}
        return out | {"v": np.ascontiguousarray(self.w["v"].T.astype(np.float32)), "c": self.w["c"].astype(np.float32)[:, None], "t": self.w["t"].astype(np.float32)}


def _states(w: dict[str, np.ndarray], x: np.ndarray, d: str, out: np.ndarray) -> None:
    """Hidden states of (time, windows) classes into out (time, hidden, windows)."""
    steps, n = x.shape
    table, u = w[f"x{d}"], w[f"u{d}"]
    h = u.shape[1]
    z, r, cell = np.empty((4 * h, n), np.float32), np.empty((4 * h, n), np.float32), np.zeros((h, n), np.float32)
    state, tmp = np.zeros((h, n), np.float32), np.empty((h, n), np.float32)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        np.take(table, x[t], axis=1, out=z, mode="clip")
        np.dot(u, state, out=r)
        z += r
        np.tanh(z, out=z)
        s = z[: 3 * h]
        s *= 0.5
        s += 0.5
        cell *= z[h : 2 * h]
        np.multiply(z[:h], z[3 * h :], out=tmp)
        cell += tmp
        np.tanh(cell, out=tmp)
        state = out[t]
        np.multiply(z[2 * h : 3 * h], tmp, out=state)


def emissions(w: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Label scores (time, label, windows) of (time, windows) classes."""
    steps, n = x.shape
    h = w["uf"].shape[1]
    both = np.empty((steps, 2 * h, n), np.float32)
    part = np.empty((steps, h, n), np.float32)
    for k, d in enumerate(("f", "b")):
        _states(w, x, d, part)
        both[:, k * h : (k + 1) * h] = part
    out = np.matmul(w["v"], both)
    out += w["c"]
    return out


def undecided(w: dict[str, np.ndarray], e: np.ndarray) -> np.ndarray:
    """Windows whose best path may hold a label.

    All labels are taken for one, with the best of their scores and transitions at every step. Where no stretch of it
    gains over the empty path, the best path is the empty one, and needn't be searched for.
    """
    t = w["t"]
    enter, stay, leave = float(t[0, 1:].max() - t[0, 0]), float(t[1:, 1:].max() - t[0, 0]), float(t[1:, 0].max() - t[0, 0])
    more = e[:, 1:].max(axis=1) - e[:, 0]
    gain = more[0].copy()
    best = gain.copy()
    for step in more[1:]:
        gain += stay
        np.maximum(gain, enter, out=gain)
        gain += step
        np.maximum(best, gain, out=best)
    return np.flatnonzero((best + leave >= 0) | (gain >= 0))


def log_odds(w: dict[str, np.ndarray], e: np.ndarray, a: int, b: int, label: int, window: int) -> float:
    """How much more likely the path with steps a to b (exclusive) labelled is than without them, as a log."""
    t = w["t"]
    return float((e[a:b, label, window] - e[a:b, 0, window]).sum() + t[0, label] + (b - a - 1) * t[label, label] + t[label, 0] - (b - a + 1) * t[0, 0])


def viterbi(w: dict[str, np.ndarray], e: np.ndarray) -> np.ndarray:
    """The best labels (time, windows)."""
    steps, k, n = e.shape
    t = w["t"][:, :, None]
    score = e[0]
    back = np.zeros((steps, k, n), dtype=np.int8)
    for s in range(1, steps):
        all_ = score[:, None, :] + t
        back[s] = all_.argmax(axis=0)
        score = all_.max(axis=0) + e[s]
    out = np.zeros((steps, n), dtype=np.int8)
    out[-1] = score.argmax(axis=0)
    rows = np.arange(n)
    for s in range(steps - 1, 0, -1):
        out[s - 1] = back[s, out[s], rows]
    return out
