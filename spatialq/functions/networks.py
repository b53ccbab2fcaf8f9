"""Small encoder-decoder networks in NumPy, for the cells of one batch: depth = encoder(x, y), expression = decoder(depth).

encoder: ``nn``, or ``midline``, the distance from a line whose angle and offset are learned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Plan:
    """How to train. decoder: linear, quadratic or nn; encoder: nn or midline; metric: gaussian or poisson.

    batch: cells of a step (0: all of them). cosine: the rate falls along half a cosine to
    least_rate, over all steps. warm: so many epochs fit log(1 + counts per 10,000) with squared
    loss before the Poisson loss; from then on the encoder rests if ``freeze``.
    """

    decoder: str = "linear"
    encoder: str = "nn"
    metric: str = "gaussian"
    epochs: int = 200
    rate: float = 5e-3
    hidden: int = 20
    patience: int = 40
    seed: int = 0
    batch: int = 0
    cosine: bool = False
    least_rate: float = 0.0
    warm: int = 0
    freeze: bool = False


class Adam:
    """Steps for one flat vector of parameters a row; rows move on their own."""

    def __init__(self, params: np.ndarray, rate: float) -> None:
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = np.zeros_like(params), np.zeros_like(params)

    def step(self, rows: np.ndarray, grads: np.ndarray, rate: float | None = None, fixed: int = 0) -> None:
        """Move the given rows; the first ``fixed`` parameters stay."""
        grads = grads.copy()
        grads[:, :fixed] = 0
        self.t += 1
        self.m[rows] += 0.1 * (grads - self.m[rows])
        self.v[rows] += 0.001 * (grads * grads - self.v[rows])
        move = (self.rate if rate is None else rate) * (self.m[rows] / (1 - 0.9**self.t)) / (np.sqrt(self.v[rows] / (1 - 0.999**self.t)) + 1e-8)
        move[:, :fixed] = 0
        self.params[rows] -= move


class Stack:
    """Dense layers with ReLU between them."""

    def __init__(self, sizes: list[int], rng: np.random.Generator) -> None:
        self.w = [rng.uniform(-1, 1, (a, b)) / np.sqrt(a) for a, b in zip(sizes, sizes[1:], strict=False)]
        self.b = [rng.uniform(-1, 1, b) / np.sqrt(a) for a, b in zip(sizes, sizes[1:], strict=False)]

    def params(self) -> list[np.ndarray]:
        return [*self.w, *self.b]

    def forward(self, x: np.ndarray) -> np.ndarray:
        self.inputs = []
        for i, (w, b) in enumerate(zip(self.w, self.b, strict=True)):
            self.inputs.append(x)
            x = x @ w + b
            if i < len(self.w) - 1:
                x = np.maximum(x, 0)
        return x

    def backward(self, g: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        gw, gb = [None] * len(self.w), [None] * len(self.w)
        for i in reversed(range(len(self.w))):
            gw[i], gb[i] = self.inputs[i].T @ g, g.sum(0)
            g = g @ self.w[i].T
            if i:
                g = g * (self.inputs[i] > 0)
        return g, [*gw, *gb]


class Midline:
    """|x cos t + y sin t - c|, with two parameters."""

    def __init__(self, rng: np.random.Generator) -> None:
        self.t, self.c = rng.uniform(0, np.pi, 1), np.zeros(1)

    def params(self) -> list[np.ndarray]:
        return [self.t, self.c]

    def forward(self, x: np.ndarray) -> np.ndarray:
        self.x = x
        self.u = x @ np.concatenate([np.cos(self.t), np.sin(self.t)]) - self.c
        return np.abs(self.u)[:, None]

    def backward(self, g: np.ndarray) -> tuple[None, list[np.ndarray]]:
        own = g[:, 0] * np.sign(self.u)
        turn = self.x @ np.concatenate([-np.sin(self.t), np.cos(self.t)])
        return None, [np.array([(own * turn).sum()]), np.array([-own.sum()])]


class DepthModel:
    """Encoder with a decoder for each group of cells (one group: a plain model)."""

    def __init__(self, n_genes: int, plan: Plan, n_groups: int = 1, n_covariates: int = 0) -> None:
        rng = np.random.default_rng(plan.seed)
        self.plan, h = plan, plan.hidden
        self.encoder = Midline(rng) if plan.encoder == "midline" else Stack([2, h, h, 1], rng)
        width = {"linear": 1, "quadratic": 2, "nn": 1}[plan.decoder] + n_covariates
        sizes = [width, h, h, n_genes] if plan.decoder == "nn" else [width, n_genes]
        self.decoders = [Stack(sizes, rng) for _ in range(n_groups)]

    def params(self) -> list[np.ndarray]:
        return [*self.encoder.params(), *(p for d in self.decoders for p in d.params())]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.params()])

    def load(self, flat: np.ndarray) -> DepthModel:
        at = 0
        for p in self.params():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        return self

    def predict(self, s: np.ndarray, group: np.ndarray, cov: np.ndarray | None) -> np.ndarray:
        self.z = self.encoder.forward(s)
        x = np.concatenate([self.z, self.z**2], 1) if self.plan.decoder == "quadratic" else self.z
        x = x if cov is None else np.concatenate([x, cov], 1)
        self.rows = [np.flatnonzero(group == k) for k in range(len(self.decoders))]
        out = np.zeros((len(s), self.decoders[0].b[-1].shape[0]))
        for d, r in zip(self.decoders, self.rows, strict=True):
            out[r] = d.forward(x[r])
        self.n_in = x.shape[1]
        return out

    def gradients(self, g: np.ndarray) -> list[np.ndarray]:
        gx, grads = np.zeros((len(g), self.n_in)), []
        for d, r in zip(self.decoders, self.rows, strict=True):
            gx[r], own = d.backward(g[r])
            grads += own
        gz = gx[:, :1] + (2 * self.z * gx[:, 1:2] if self.plan.decoder == "quadratic" else 0)
        return [*self.encoder.backward(gz)[1], *grads]


def loss_sums(out: np.ndarray, a: np.ndarray, factor: np.ndarray | None, metric: str) -> np.ndarray:
    """The summed loss of each cell."""
    if metric == "poisson":
        return (factor * np.exp(np.clip(out, -30, 30)) - a * out).sum(1)
    d = out - a
    return (d * d).sum(1)


def loss_slopes(out: np.ndarray, a: np.ndarray, factor: np.ndarray | None, metric: str) -> np.ndarray:
    """Gradient of the summed loss at the outputs."""
    return factor * np.exp(np.clip(out, -30, 30)) - a if metric == "poisson" else 2 * (out - a)
