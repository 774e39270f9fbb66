"""A character tagger in numpy: a bidirectional LSTM whose outputs are the emissions of a
conditional random field; trained by backpropagation through time and Adam."""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]
#: Log weight of what the labels' scheme rules out.
NEVER = np.float32(-1e4)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Tagger:
    """Labels: 0 outside, 2k + 1 the first character of a span of kind k, 2k + 2 its others."""

    def __init__(self, classes: int, kinds: int, hidden: int = 24, seed: int = 1):
        rng, n = np.random.default_rng(seed), 2 * kinds + 1
        self.hidden, self.labels = hidden, n
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p: Params = {"out": draw(2 * hidden, n, scale=0.2), "bias": np.zeros(n, np.float32), "step": np.zeros((n, n), np.float32), "begin": np.zeros(n, np.float32)}
        for way in "lr":
            self.p |= {f"in_{way}": draw(classes, 4 * hidden, scale=0.3), f"on_{way}": draw(hidden, 4 * hidden, scale=1 / np.sqrt(hidden))}
            self.p[f"in_{way}"][:, :hidden] += 0.5  # gates that keep
        inner = np.arange(2, n, 2)
        self.barred = np.zeros((n, n), np.float32)
        self.barred[:, inner] = NEVER
        self.barred[inner, inner] = self.barred[inner - 1, inner] = 0
        self.barred_at_start = np.where(np.isin(np.arange(n), inner), NEVER, 0).astype(np.float32)

    # --- recurrent layers: gates are keep, write, show and the new content ---
    def _layer(self, x: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """States (time, rows, hidden) of one direction for x (time, rows)."""
        h, table, on = self.hidden, self.p[f"in_{way}"], self.p[f"on_{way}"]
        state = cell = np.zeros((x.shape[1], h), np.float32)
        out = np.empty((*x.shape, h), np.float32)
        for t in range(len(x)) if way == "l" else range(len(x) - 1, -1, -1):
            gates = table[x[t]] + state @ on
            gates[:, : 3 * h] = _sigmoid(gates[:, : 3 * h])
            gates[:, 3 * h :] = np.tanh(gates[:, 3 * h :])
            before, last = cell, state
            cell = gates[:, :h] * before + gates[:, h : 2 * h] * gates[:, 3 * h :]
            shown = np.tanh(cell)
            state = gates[:, 2 * h : 3 * h] * shown
            out[t] = state
            if keep is not None:
                keep.append((t, gates, before, shown, last))
        return out

    def _layer_back(self, x: np.ndarray, way: str, kept: list, d_out: np.ndarray, grad: Params) -> None:
        h, on = self.hidden, self.p[f"on_{way}"]
        classes = np.arange(len(self.p[f"in_{way}"]))[:, None]
        d_table, d_on = np.zeros_like(self.p[f"in_{way}"]), np.zeros_like(on)
        d_state = d_cell = np.zeros((x.shape[1], h), np.float32)
        for t, gates, before, shown, last in reversed(kept):
            keep, write, show, new = (gates[:, i * h : (i + 1) * h] for i in range(4))
            d_state = d_state + d_out[t]
            d_cell = d_cell + d_state * show * (1 - shown * shown)
            d = np.concatenate([d_cell * before * keep * (1 - keep), d_cell * new * write * (1 - write), d_state * shown * show * (1 - show), d_cell * write * (1 - new * new)], 1)
            d_table += (x[t] == classes).astype(np.float32) @ d
            d_on += last.T @ d
            d_state, d_cell = d @ on.T, d_cell * keep
        grad[f"in_{way}"], grad[f"on_{way}"] = d_table, d_on

    def emissions(self, x: np.ndarray, kept: dict[str, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(time, rows, labels) for classes x (time, rows), and the states they come from."""
        states = np.concatenate([self._layer(x, way, kept[way] if kept else None) for way in "lr"], 2)
        return states @ self.p["out"] + self.p["bias"], states

    # --- the random field ---
    def _weights(self) -> tuple[np.ndarray, np.ndarray]:
        return self.p["step"] + self.barred, self.p["begin"] + self.barred_at_start

    def _field(self, e: np.ndarray) -> tuple[np.ndarray, ...]:
        """Probabilities of labels given what came before and, over these, given what comes
        behind; weights of emissions, sums of each step, and the log of the total."""
        step, begin = (np.exp(w) for w in self._weights())
        top = e.max(2, keepdims=True)
        x = np.exp(e - top)
        a, b, z = np.empty_like(e), np.ones_like(e), np.empty((*e.shape[:2], 1), e.dtype)
        for t in range(len(e)):
            a[t] = x[t] * (a[t - 1] @ step if t else begin)
            z[t] = a[t].sum(1, keepdims=True)
            a[t] /= z[t]
        for t in range(len(e) - 2, -1, -1):
            b[t] = (x[t + 1] * b[t + 1] / z[t + 1]) @ step.T
        return a, b, x, z, (np.log(z) + top).sum((0, 2))

    def marginals(self, e: np.ndarray) -> np.ndarray:
        a, b, *_ = self._field(e)
        return a * b

    def best(self, e: np.ndarray) -> np.ndarray:
        """The likeliest labels (time, rows)."""
        step, begin = self._weights()
        came, score = np.empty(e.shape, np.int8), begin + e[0]
        for t in range(1, len(e)):
            ways = score[:, :, None] + step
            came[t] = ways.argmax(1)
            score = ways.max(1) + e[t]
        path = np.empty(e.shape[:2], np.int8)
        path[-1] = score.argmax(1)
        rows = np.arange(e.shape[1])
        for t in range(len(e) - 1, 0, -1):
            path[t - 1] = came[t][rows, path[t]]
        return path

    def loss_and_gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, Params]:
        """Mean negative log likelihood of labels y (time, rows), and its gradient."""
        kept: dict[str, list] = {"l": [], "r": []}
        e, states = self.emissions(x, kept)
        step, begin = self._weights()
        a, b, weight, z, total = self._field(e)
        n, rows = x.shape[1], np.arange(x.shape[1])
        true = begin[y[0]] + step[y[:-1], y[1:]].sum(0) + np.take_along_axis(e, y[:, :, None], 2).sum((0, 2))
        d_e = a * b
        both = np.einsum("tni,tnj->ij", a[:-1], weight[1:] * b[1:] / z[1:], optimize=True) * np.exp(step)
        told = np.bincount((y[:-1] * self.labels + y[1:]).ravel(), minlength=self.labels**2).reshape(step.shape)
        grad: Params = {"begin": d_e[0].sum(0) - np.bincount(y[0], minlength=self.labels), "step": both - told}
        d_e[np.arange(len(y))[:, None], rows[None, :], y] -= 1
        flat, h = d_e.reshape(-1, self.labels), self.hidden
        grad["out"], grad["bias"] = states.reshape(-1, 2 * h).T @ flat, flat.sum(0)
        d_states = d_e @ self.p["out"].T
        self._layer_back(x, "l", kept["l"], d_states[:, :, :h], grad)
        self._layer_back(x, "r", kept["r"], d_states[:, :, h:], grad)
        return float((total - true).mean()), {k: (g / n).astype(np.float32) for k, g in grad.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int = 192, rate: float = 0.02, seed: int = 2) -> None:
        """Adam by steps of batches of rows of x and y (rows, time), in an order drawn anew for
        each pass, with clipped gradients and a falling rate."""
        rng, first, second = np.random.default_rng(seed), {}, {}
        order = np.empty(0, np.int64)
        for n in range(1, steps + 1):
            if len(order) < min(batch, len(x)):
                order = np.concatenate([order, rng.permutation(len(x))])
            own, order = order[:batch], order[batch:]
            _, grad = self.loss_and_gradient(np.ascontiguousarray(x[own].T), np.ascontiguousarray(y[own].T).astype(np.int64))
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            pace = rate * (1 - 0.9 * n / steps)
            for k, g in grad.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                first[k] = 0.9 * first.get(k, 0) + 0.1 * g
                second[k] = 0.99 * second.get(k, 0) + 0.01 * g * g
                self.p[k] -= (pace * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.99**n)) + 1e-8)).astype(np.float32)
