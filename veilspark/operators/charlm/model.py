"""A one-block character transformer in numpy: embeddings, causal self-attention, ReLU network, read-out."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np

from .rng import Rng

FORMAT = "veilspark-charlm-1"
FILE_BYTES = 64 << 20


def shapes(vocab: int, context: int, dim: int) -> dict[str, tuple[int, ...]]:
    """Names and shapes of the weights, in the order in which they are drawn."""
    hidden = 2 * dim
    square = (dim, dim)
    return {
        "E": (vocab, dim), "P": (context, dim), "Wq": square, "Wk": square, "Wv": square, "Wo": square,
        "W1": (dim, hidden), "b1": (hidden,), "W2": (hidden, dim), "b2": (dim,), "Wout": (dim, vocab), "bout": (vocab,),
    }


@dataclass
class Model:
    chars: list[str]
    context: int
    dim: int
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, chars: list[str], context: int, dim: int, rng: Rng) -> Model:
        """Matrices drawn from N(0, 0.05 squared), biases zero."""
        draw = lambda s: np.array([rng.normal() for _ in range(s[0] * s[1])]).reshape(s) * 0.05 if len(s) == 2 else np.zeros(s)
        return cls(list(chars), context, dim, {k: draw(s) for k, s in shapes(len(chars), context, dim).items()})

    @property
    def size(self) -> int:
        return sum(w.size for w in self.weights.values())

    def encode(self, text: str) -> list[int]:
        index = {c: i for i, c in enumerate(self.chars)}
        return [index[c] for c in text if c in index]

    def decode(self, ids) -> str:
        return "".join(self.chars[i] for i in ids)

    def to_json(self, training: dict | None = None) -> str:
        body = {"format": FORMAT, "context": self.context, "dim": self.dim, "chars": self.chars, "weights": {k: w.ravel().tolist() for k, w in self.weights.items()}}
        return json.dumps(body | ({"training": training} if training else {}))

    @classmethod
    def from_json(cls, raw: str) -> Model:
        """Raises ValueError for anything but a whole weights file."""
        if len(raw) > FILE_BYTES:
            raise ValueError("the weights file is too large")
        body = json.loads(raw)
        if not isinstance(body, dict) or body.get("format") != FORMAT or not isinstance(body.get("chars"), list) or not isinstance(body.get("weights"), dict):
            raise ValueError("this is no weights file")
        chars, context, dim = sorted(set(body["chars"])), int(body.get("context") or 0), int(body.get("dim") or 0)
        if len(chars) < 2 or context < 1 or dim < 1:
            raise ValueError("the weights file is damaged")
        weights = {}
        for name, shape in shapes(len(chars), context, dim).items():
            flat = np.asarray(body["weights"].get(name, []), np.float64)
            if flat.size != np.prod(shape):
                raise ValueError(f"the weights file is damaged ({name})")
            weights[name] = flat.reshape(shape)
        return cls(chars, context, dim, weights)

    def forward(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """x: codes, one row a window. Returns what the backward pass needs, logits included."""
        w, t = self.weights, x.shape[1]
        x0 = w["E"][x] + w["P"][:t]
        q, k, v = x0 @ w["Wq"], x0 @ w["Wk"], x0 @ w["Wv"]
        scores = np.where(np.tri(t, dtype=bool), q @ k.swapaxes(1, 2) / np.sqrt(self.dim), -np.inf)
        a = softmax(scores)
        mixed = a @ v
        x1 = x0 + mixed @ w["Wo"]
        h = np.maximum(x1 @ w["W1"] + w["b1"], 0)
        x2 = x1 + h @ w["W2"] + w["b2"]
        return {"x": x, "x0": x0, "q": q, "k": k, "v": v, "a": a, "mixed": mixed, "x1": x1, "h": h, "x2": x2, "logits": x2 @ w["Wout"] + w["bout"]}

    def backward(self, c: dict[str, np.ndarray], d_logits: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of all weights from that of the logits."""
        w, scale = self.weights, 1 / np.sqrt(self.dim)
        outer = lambda left, right: np.einsum("bti,btj->ij", left, right)
        g = {"Wout": outer(c["x2"], d_logits), "bout": d_logits.sum((0, 1))}
        d2 = d_logits @ w["Wout"].T
        g["W2"], g["b2"] = outer(c["h"], d2), d2.sum((0, 1))
        dh = (d2 @ w["W2"].T) * (c["h"] > 0)
        g["W1"], g["b1"] = outer(c["x1"], dh), dh.sum((0, 1))
        d1 = d2 + dh @ w["W1"].T
        g["Wo"] = outer(c["mixed"], d1)
        d_mixed = d1 @ w["Wo"].T
        da = d_mixed @ c["v"].swapaxes(1, 2)
        ds = c["a"] * (da - (da * c["a"]).sum(-1, keepdims=True)) * scale
        dq, dk, dv = ds @ c["k"], ds.swapaxes(1, 2) @ c["q"], c["a"].swapaxes(1, 2) @ d_mixed
        g["Wq"], g["Wk"], g["Wv"] = outer(c["x0"], dq), outer(c["x0"], dk), outer(c["x0"], dv)
        d0 = d1 + dq @ w["Wq"].T + dk @ w["Wk"].T + dv @ w["Wv"].T
        g["E"], g["P"] = np.zeros_like(w["E"]), np.zeros_like(w["P"])
        np.add.at(g["E"], c["x"], d0)
        g["P"][: c["x"].shape[1]] = d0.sum(0)
        return g


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def loss(logits: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean cross-entropy and its gradient by the logits."""
    top = logits.max(-1, keepdims=True)
    log_p = logits - top - np.log(np.exp(logits - top).sum(-1, keepdims=True))
    at = np.expand_dims(y, -1)
    d = np.exp(log_p)
    np.put_along_axis(d, at, np.take_along_axis(d, at, -1) - 1, -1)
    return float(-np.take_along_axis(log_p, at, -1).mean()), d / y.size


def clip(g: dict[str, np.ndarray], most: float) -> float:
    """Scales all gradients down to a common length of most (0: off); returns their length before."""
    norm = float(np.sqrt(sum(float((a * a).sum()) for a in g.values())))
    if 0 < most < norm:
        for a in g.values():
            a *= most / norm
    return norm


def epoch(m: Model, x: np.ndarray, y: np.ndarray, batch: int, rate: float, most: float, rng: Rng) -> float:
    """One pass over the windows in random order; the mean loss, or NaN as soon as it isn't finite."""
    order, total = np.array(rng.order(len(x)), int), 0.0
    for rows in (order[i : i + batch] for i in range(0, len(order), batch)):
        cache = m.forward(x[rows])
        value, d = loss(cache["logits"], y[rows])
        g = m.backward(cache, d)
        clip(g, most)
        for name, a in m.weights.items():
            a -= rate * g[name]
        total += value * len(rows)
        if not np.isfinite(value):
            return float("nan")
    return total / len(x)


def evaluate(m: Model, x: np.ndarray, y: np.ndarray, batch: int = 256) -> tuple[float, int]:
    """Sum of the windows' losses and their number."""
    total = sum(loss(m.forward(x[i : i + batch])["logits"], y[i : i + batch])[0] * len(x[i : i + batch]) for i in range(0, len(x), batch))
    return total, len(x)


def generate(m: Model, seed: str, n: int, temperature: float, rng: Rng) -> str:
    """n characters more, one at a time; a seed without known characters is a space or the first character."""
    ids = m.encode(seed) or m.encode(" ") or [0]
    for _ in range(n):
        z = m.forward(np.array([ids[-m.context :]]))["logits"][0, -1]
        p = np.exp((z - z.max()) / max(temperature, 1e-6)).cumsum()
        ids.append(min(int(np.searchsorted(p, rng.next() * p[-1], "right")), len(p) - 1))
    return m.decode(ids)


def gradient_check(seed: int = 7, eps: float = 1e-5) -> float:
    """The worst relative difference between backward() and central differences on a small model."""
    rng = Rng(seed)
    m = Model.fresh([chr(97 + i) for i in range(7)], 5, 6, rng)
    for w in m.weights.values():
        w *= 4
        w += np.array([rng.normal() for _ in range(w.size)]).reshape(w.shape) * 0.1
    codes = np.array([rng.below(7) for _ in range(30)]).reshape(3, 5, 2)
    x, y = codes[..., 0], codes[..., 1]
    cache = m.forward(x)
    exact = m.backward(cache, loss(cache["logits"], y)[1])
    worst = 0.0
    for name, w in m.weights.items():
        flat, numeric = w.reshape(-1), np.empty(w.size)
        for i in range(w.size):
            old = flat[i]
            flat[i] = old + eps
            up = loss(m.forward(x)["logits"], y)[0]
            flat[i] = old - eps
            numeric[i] = (up - loss(m.forward(x)["logits"], y)[0]) / (2 * eps)
            flat[i] = old
        ours = exact[name].reshape(-1)
        worst = max(worst, np.abs(numeric - ours).max() / (np.abs(numeric).max() + np.abs(ours).max() + 1e-12))
    return worst
