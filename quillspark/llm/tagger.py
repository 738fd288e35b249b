"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Characters are read as one of a few classes. Each direction has HIDDEN units; both feed one score per
tag, and the CRF adds a score per pair of neighbouring tags. Training maximises the likelihood of the
labelled tags (forward-backward over the CRF, back-propagation through time, Adam).
"""

from __future__ import annotations

import numpy as np

OWN_CLASS = "@.-+()_%:=/\"', \n"  # characters with a class of their own
DIGIT, LOWER, UPPER, OTHER_LETTER, OTHER, PAD = range(6)
CLASSES = 6 + len(OWN_CLASS)
HIDDEN = 12


def char_classes(text: str) -> np.ndarray:
    """The class of each character."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.full(len(codes), OTHER, np.int64)
    out[codes > 191] = OTHER_LETTER
    out[(codes >= 97) & (codes <= 122)] = LOWER
    out[(codes >= 65) & (codes <= 90)] = UPPER
    out[(codes >= 48) & (codes <= 57)] = DIGIT
    for i, c in enumerate(OWN_CLASS):
        out[codes == ord(c)] = 6 + i
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def log_sum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    def __init__(self, tags: int, hidden: int = HIDDEN, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.tags, self.hidden = tags, hidden
        self.p = {"out": rng.normal(0, 0.3, (2 * hidden, tags)), "bias": np.zeros(tags), "pairs": np.zeros((tags, tags)), "first": np.zeros(tags)}
        for way in ("f", "b"):
            self.p["in" + way] = rng.normal(0, 0.3, (CLASSES, 4 * hidden))
            self.p["rec" + way] = rng.normal(0, 0.3, (hidden, 4 * hidden))
            self.p["in" + way][:, hidden : 2 * hidden] += 1  # forget gates start open

    def _lstm(self, x, way: str, keep: bool):
        h, steps = self.hidden, x.shape[1]
        state, cell = np.zeros((len(x), h)), np.zeros((len(x), h))
        out, trace = np.empty((len(x), steps, h)), [None] * steps
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = self.p["in" + way][x[:, t]] + state @ self.p["rec" + way]
            gates, g = sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            before, old = state, cell
            cell = f * old + i * g
            tc = np.tanh(cell)
            state = o * tc
            out[:, t] = state
            if keep:
                trace[t] = (i, f, o, g, before, old, tc)
        return out, trace

    def _lstm_back(self, x, way: str, trace, d_out, grads):
        h, steps = self.hidden, x.shape[1]
        d_state, d_cell = np.zeros((len(x), h)), np.zeros((len(x), h))
        every = np.empty((steps, len(x), 4 * h))
        for t in range(steps - 1, -1, -1) if way == "f" else range(steps):
            i, f, o, g, before, old, tc = trace[t]
            d_state = d_state + d_out[:, t]
            d_cell = d_cell + d_state * o * (1 - tc * tc)
            d_z = np.concatenate((d_cell * g * i * (1 - i), d_cell * old * f * (1 - f), d_state * tc * o * (1 - o), d_cell * i * (1 - g * g)), axis=1)
            every[t] = d_z
            grads["rec" + way] += before.T @ d_z
            d_state, d_cell = d_z @ self.p["rec" + way].T, d_cell * f
        grads["in" + way] += np.eye(CLASSES)[x.T.ravel()].T @ every.reshape(-1, 4 * h)

    def scores(self, x, keep: bool = False):
        forward, tf = self._lstm(x, "f", keep)
        backward, tb = self._lstm(x, "b", keep)
        both = np.concatenate((forward, backward), axis=2)
        return both @ self.p["out"] + self.p["bias"], both, tf, tb

    def loss(self, x, y):
        """Mean negative log-likelihood a window, and its gradient."""
        n, steps = x.shape
        emit, both, tf, tb = self.scores(x, True)
        pairs, rows = self.p["pairs"], np.arange(n)
        alpha, beta = np.empty_like(emit), np.zeros_like(emit)
        alpha[:, 0] = emit[:, 0] + self.p["first"]
        for t in range(1, steps):
            alpha[:, t] = emit[:, t] + log_sum(alpha[:, t - 1, :, None] + pairs, 1)
        for t in range(steps - 2, -1, -1):
            beta[:, t] = log_sum(pairs + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        whole = log_sum(alpha[:, -1], 1)
        gold = self.p["first"][y[:, 0]] + emit[rows[:, None], np.arange(steps), y].sum(1) + pairs[y[:, :-1], y[:, 1:]].sum(1)
        d_emit = np.exp(alpha + beta - whole[:, None, None])
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["first"] = d_emit[:, 0].sum(0)
        for t in range(1, steps):
            joint = alpha[:, t - 1, :, None] + pairs + (emit[:, t] + beta[:, t])[:, None, :] - whole[:, None, None]
            grads["pairs"] += np.exp(joint).sum(0)
        np.subtract.at(grads["first"], y[:, 0], 1)
        np.subtract.at(grads["pairs"], (y[:, :-1], y[:, 1:]), 1)
        d_emit[rows[:, None], np.arange(steps), y] -= 1
        grads["bias"] = d_emit.sum((0, 1))
        grads["out"] = np.tensordot(both, d_emit, ((0, 1), (0, 1)))
        d_both = d_emit @ self.p["out"].T
        self._lstm_back(x, "f", tf, d_both[:, :, : self.hidden], grads)
        self._lstm_back(x, "b", tb, d_both[:, :, self.hidden :], grads)
        return (whole - gold).mean(), {k: v / n for k, v in grads.items()}

    def train(self, x, y, epochs: int, batch: int = 32, rate: float = 0.02, seed: int = 0):
        rng, step = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        steps = epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for begin in range(0, len(x), batch):
                part = order[begin : begin + batch]
                _, grads = self.loss(x[part], y[part])
                norm = np.sqrt(sum((g * g).sum() for g in grads.values()))
                now, scale = rate * (1 - step / steps), min(1.0, 5 / (norm + 1e-9))
                step += 1
                for k, g in grads.items():
                    g = g * scale
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] = self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def decode(self, x):
        """The best tags of each window (Viterbi), and the scores of each character's tags without the CRF."""
        emit = self.scores(x)[0]
        n, steps, tags = emit.shape
        best, back = emit[:, 0] + self.p["first"], np.zeros((n, steps, tags), np.int8)
        for t in range(1, steps):
            joint = best[:, :, None] + self.p["pairs"]
            back[:, t] = joint.argmax(1)
            best = emit[:, t] + joint.max(1)
        path = np.empty((n, steps), np.int64)
        path[:, -1] = best.argmax(1)
        for t in range(steps - 1, 0, -1):
            path[:, t - 1] = back[np.arange(n), t, path[:, t]]
        return path, emit
