"""Small gradient-boosted trees: fitted on the driver from a bounded sample, scored as a SQL expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


@dataclass
class Boosted:
    """``bias`` plus, for each tree of depth two, one of four values by ``(feature, cut)`` at its root and at either side; then a logistic scale."""

    bias: float
    trees: list[tuple]
    scale: tuple[float, float] = (1.0, 0.0)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for (f, c), left, right in self.trees:
            for (g, d, low, high), side in ((left, x[:, f] <= c), (right, x[:, f] > c)):
                out += np.where(side, np.where(x[:, g] <= d, low, high), 0.0)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return _sigmoid(a * self.margin(x) + b)

    def sql(self, features: list[str]) -> str:
        """The calibrated probability as SQL over expressions of doubles."""
        each = [f"{self.bias!r}D"]
        for (f, c), left, right in self.trees:
            low, high = (f"if({features[g]} <= {d!r}D, {a!r}D, {b!r}D)" for g, d, a, b in (_finite(left), _finite(right)))
            each.append(f"if({features[f]} <= {c!r}D, {low}, {high})")
        a, b = self.scale
        return f"(1 / (1 + exp(-(({' + '.join(each)}) * {a!r}D + {b!r}D))))"


def _finite(side: tuple) -> tuple:
    """A side without a split has an infinite cut, which SQL has no number for: the largest double does as well."""
    g, d, a, b = side
    return g, min(d, 1.7e308), a, b


def _split(x, g, h, rows, cuts, ridge):
    """The best (gain, feature, cut, value left, value right) over ``rows``."""
    gs, hs = g[rows].sum(), h[rows].sum()
    best = (0.0, 0, np.inf, -gs / (hs + ridge), 0.0)
    for f, own in enumerate(cuts):
        for c in own:
            low = rows & (x[:, f] <= c)
            gl, hl = g[low].sum(), h[low].sum()
            gr, hr = gs - gl, hs - hl
            gain = gl * gl / (hl + ridge) + gr * gr / (hr + ridge) - gs * gs / (hs + ridge)
            if gain > best[0] + 1e-12:
                best = (gain, f, float(c), -gl / (hl + ridge), -gr / (hr + ridge))
    return best


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 30, rate: float = 0.3, ridge: float = 1.0) -> Boosted:
    """Boost the logistic loss with trees of depth two, cuts at eighths of each feature's values."""
    base = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(float(np.log(base / (1 - base))), [])
    cuts = [np.unique(np.quantile(np.unique(x[:, f]), np.linspace(0, 1, 9)[:-1])) if len(np.unique(x[:, f])) > 1 else np.zeros(0) for f in range(x.shape[1])]
    margin = np.full(len(x), model.bias)
    every = np.ones(len(x), bool)
    for _ in range(trees):
        p = _sigmoid(margin)
        g, h = p - y, p * (1 - p)
        _, f, c, _, _ = _split(x, g, h, every, cuts, ridge)
        c = min(c, 1.7e308)
        sides = []
        for rows in (x[:, f] <= c, x[:, f] > c):
            _, f2, c2, low, high = _split(x, g, h, rows, cuts, ridge)
            sides.append((f2, c2, float(rate * low), float(rate * high)))
        tree = ((f, c), *sides)
        one = Boosted(0.0, [tree])
        margin = margin + one.margin(x)
        model.trees.append(tree)
    return model


def calibrate(model: Boosted, x: np.ndarray, y: np.ndarray, steps: int = 100, ridge: float = 1.0) -> Boosted:
    """Fit the logistic scale of the margins on held-out rows, towards smoothed targets, so that separable rows don't drive it to infinity.

    Damped Newton steps on a loss with a ridge towards the scale the margins have; a step that doesn't lower the loss is halved.
    """
    m = model.margin(x)
    design = np.stack([m, np.ones(len(m))], 1)
    positive = float(y.sum())
    target = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (len(y) - positive + 2))
    start = np.array([1.0, 0.0])

    def loss(w):
        z = design @ w
        return float((np.logaddexp(0, z) - target * z).sum() + ridge / 2 * ((w - start) ** 2).sum())

    w = start
    for _ in range(steps):
        p = _sigmoid(design @ w)
        gradient = design.T @ (p - target) + ridge * (w - start)
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        move, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-6 and loss(w - size * move) > loss(w):
            size /= 2
        if size <= 1e-6 or np.abs(size * move).max() < 1e-9:
            break
        w = w - size * move
    return Boosted(model.bias, model.trees, (float(w[0]), float(w[1])))


def threshold(probability: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest cut-off at which the held-out rows above it have this share of positives; infinite if none has."""
    order = np.argsort(-probability, kind="stable")
    share = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero((share >= precision) & (np.append(np.diff(probability[order]), -1.0) < 0))
    return float(probability[order][good[-1]]) if len(good) else float("inf")
