"""A bidirectional gated recurrent network with attention pooling, in numpy, for windows of words.

A word enters as the last states of a bidirectional character network over its letters and as a hashed word vector. A
bidirectional word network runs over a window; attention pools its states; one logit comes out. Training is by
back-propagation through time and Adam.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np

LETTERS, LONGEST, CHAR, WORD_ROWS, WORD, HIDDEN, ATTENTION = 512, 14, 8, 4096, 8, 8, 8


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def spell(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of each word from the front and from the back (T, n), and its row of the word table."""
    lengths = np.array([len(w) for w in words], np.int64)
    letters = (np.frombuffer("".join(words).encode("utf-32-le"), np.uint32) % (LETTERS - 1) + 1).astype(np.int32)
    starts = np.cumsum(lengths) - lengths
    front, back = np.zeros((LONGEST, len(words)), np.int32), np.zeros((LONGEST, len(words)), np.int32)
    for k in range(LONGEST):
        have = np.flatnonzero(lengths > k)
        front[k, have] = letters[starts[have] + k]
        back[k, have] = letters[starts[have] + lengths[have] - 1 - k]
    rows = np.array([crc32(w.encode()) % WORD_ROWS for w in words], np.int64)
    return front, back, rows


def gru(x: np.ndarray, u: np.ndarray, keep: np.ndarray | None = None, trace: bool = False):
    """States (T, n, h) for inputs x (T, n, 3h) and recurrent weights u (h, 3h); where ``keep`` is 0 a state stays."""
    steps, n, h = x.shape[0], x.shape[1], u.shape[0]
    state = np.zeros((n, h), np.float32)
    states, traces = np.empty((steps, n, h), np.float32), []
    for t in range(steps):
        v = state @ u
        gates = sigmoid(x[t, :, : 2 * h] + v[:, : 2 * h])
        r, z = gates[:, :h], gates[:, h:]
        new = np.tanh(x[t, :, 2 * h :] + r * v[:, 2 * h :])
        if trace:
            traces.append((state, r, z, new, v[:, 2 * h :]))
        after = new + z * (state - new)
        state = after if keep is None else np.where(keep[t][:, None], after, state)
        states[t] = state
    return states, traces


def gru_back(grad: np.ndarray, u: np.ndarray, traces: list, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of x and u from those of the states."""
    steps, n, h = grad.shape
    dx, du, carry = np.empty((steps, n, 3 * h), np.float32), np.zeros_like(u), np.zeros((n, h), np.float32)
    for t in range(steps - 1, -1, -1):
        state, r, z, new, v = traces[t]
        d = grad[t] + carry
        stay = 0.0
        if keep is not None:
            stay = np.where(keep[t][:, None], 0, d)
            d = np.where(keep[t][:, None], d, 0)
        dn = d * (1 - z) * (1 - new * new)
        dz = d * (state - new) * z * (1 - z)
        dr = dn * v * r * (1 - r)
        dx[t] = np.concatenate([dr, dz, dn], axis=1)
        dv = np.concatenate([dr, dz, dn * r], axis=1)
        du += state.T @ dv
        carry = d * z + dv @ u.T + stay
    return dx, du


class Network:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)

        def normal(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.p = {
            "front": normal(LETTERS, 3 * CHAR, scale=0.4), "front_u": normal(CHAR, 3 * CHAR, scale=0.3), "back": normal(LETTERS, 3 * CHAR, scale=0.4), "back_u": normal(CHAR, 3 * CHAR, scale=0.3),
            "word": normal(WORD_ROWS, WORD, scale=0.1),
            "left": normal(2 * CHAR + WORD, 3 * HIDDEN, scale=0.3), "left_b": np.zeros(3 * HIDDEN, np.float32), "left_u": normal(HIDDEN, 3 * HIDDEN, scale=0.3),
            "right": normal(2 * CHAR + WORD, 3 * HIDDEN, scale=0.3), "right_b": np.zeros(3 * HIDDEN, np.float32), "right_u": normal(HIDDEN, 3 * HIDDEN, scale=0.3),
            "att": normal(2 * HIDDEN, ATTENTION, scale=0.3), "att_v": normal(ATTENTION, scale=0.3), "out": normal(2 * HIDDEN, scale=0.3), "out_b": np.zeros(1, np.float32),
        }
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        self.steps = 0

    def __getstate__(self) -> dict:
        return {"p": self.p}

    def __setstate__(self, state: dict) -> None:
        self.p = state["p"]

    def words(self, spelled, trace: bool = False):
        """Input vectors of words from their spelling."""
        front, back, rows = spelled
        p = self.p
        one, a = gru(p["front"][front], p["front_u"], front > 0, trace)
        two, b = gru(p["back"][back], p["back_u"], back > 0, trace)
        return np.concatenate([one[-1], two[-1], p["word"][rows]], axis=1), (a, b)

    def inputs(self, vectors: np.ndarray) -> np.ndarray:
        """What words give to the two directions' gates, side by side."""
        p = self.p
        return np.concatenate([vectors @ p["left"] + p["left_b"], vectors @ p["right"] + p["right_b"]], axis=1)

    def windows(self, given: np.ndarray, ids: np.ndarray, trace: bool = False):
        """Logits of windows ``ids`` (n, T) over the table ``given`` of word inputs."""
        p, h = self.p, 3 * HIDDEN
        x = given[ids.T]
        left, a = gru(x[:, :, :h], p["left_u"], None, trace)
        right, b = gru(x[::-1, :, h:], p["right_u"], None, trace)
        states = np.concatenate([left, right[::-1]], axis=2)
        hidden = np.tanh(states @ p["att"])
        scores = hidden @ p["att_v"]
        weights = np.exp(scores - scores.max(axis=0))
        weights /= weights.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weights, states)
        return pooled @ p["out"] + p["out_b"][0], (a, b, states, hidden, weights, pooled)

    def learn(self, spelled, ids: np.ndarray, labels: np.ndarray, weights: np.ndarray, rate: float) -> float:
        """One Adam step on windows over the given words; the mean loss."""
        p, g = self.p, {}
        front, back, rows = spelled
        vectors, (ca, cb) = self.words(spelled, True)
        logits, (a, b, states, hidden, att, pooled) = self.windows(self.inputs(vectors), ids, True)
        prob = sigmoid(logits)
        loss = float(-(weights * (labels * np.log(prob + 1e-7) + (1 - labels) * np.log(1 - prob + 1e-7))).sum() / weights.sum())
        d = ((prob - labels) * weights / weights.sum()).astype(np.float32)
        g["out"], g["out_b"] = pooled.T @ d, d.sum(keepdims=True)
        dpooled = d[:, None] * p["out"]
        dstates = att[:, :, None] * dpooled
        datt = np.einsum("nh,tnh->tn", dpooled, states)
        dscores = att * (datt - (att * datt).sum(axis=0))
        dhidden = dscores[:, :, None] * p["att_v"] * (1 - hidden * hidden)
        g["att_v"] = np.einsum("tn,tna->a", dscores, hidden)
        g["att"] = np.einsum("tnh,tna->ha", states, dhidden)
        dstates = dstates + dhidden @ p["att"].T
        dleft, g["left_u"] = gru_back(np.ascontiguousarray(dstates[:, :, :HIDDEN]), p["left_u"], a)
        dright, g["right_u"] = gru_back(np.ascontiguousarray(dstates[::-1, :, HIDDEN:]), p["right_u"], b)
        dgiven = np.zeros((len(rows), 6 * HIDDEN), np.float32)
        np.add.at(dgiven, ids.T.ravel(), np.concatenate([dleft, dright[::-1]], axis=2).reshape(-1, 6 * HIDDEN))
        h = 3 * HIDDEN
        g["left"], g["left_b"], g["right"], g["right_b"] = vectors.T @ dgiven[:, :h], dgiven[:, :h].sum(axis=0), vectors.T @ dgiven[:, h:], dgiven[:, h:].sum(axis=0)
        dvectors = dgiven[:, :h] @ p["left"].T + dgiven[:, h:] @ p["right"].T
        g["word"] = np.zeros_like(p["word"])
        np.add.at(g["word"], rows, dvectors[:, 2 * CHAR :])
        for name, letters, traces, at in (("front", front, ca, 0), ("back", back, cb, CHAR)):
            last = np.zeros((LONGEST, len(rows), CHAR), np.float32)
            last[-1] = dvectors[:, at : at + CHAR]
            dx, g[f"{name}_u"] = gru_back(last, p[f"{name}_u"], traces, letters > 0)
            g[name] = np.zeros_like(p[name])
            np.add.at(g[name], letters.ravel(), dx.reshape(-1, 3 * CHAR))
        self.steps += 1
        for k, grad in g.items():
            m, v = self.moments[k]
            grad = np.clip(grad, -1, 1)
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            p[k] -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)
        return loss
