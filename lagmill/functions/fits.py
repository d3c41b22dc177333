"""Small fits run inside tasks: each takes the scaled training rows of one (series, origin) and all grid points."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np


@dataclass
class LinearFit:
    """One weight column and intercept per grid point."""

    weights: np.ndarray
    intercepts: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.intercepts

    def explain(self, x: np.ndarray, background: np.ndarray) -> tuple[np.ndarray, float]:
        """Contributions of a single-point fit: weight times distance from the background mean."""
        center = background.mean(axis=0)
        base = float(center @ self.weights[:, 0] + self.intercepts[0])
        return self.weights[:, 0] * (x - center), base


def fit_elastic_net(x: np.ndarray, y: np.ndarray, points: Sequence[dict], sweeps: int = 50000) -> LinearFit:
    """min |y - xw - c|^2 / 2n + alpha l1 |w|_1 + alpha (1 - l1) |w|^2 / 2 for all grid points at once.

    Coordinate descent on the k x k moment matrix finds signs; as soon as the linear system of the active set agrees
    with the optimality conditions, its exact solution is taken."""
    n, k = x.shape
    x_mean, y_mean = x.mean(axis=0), y.mean()
    xc = x - x_mean
    moments, cross = xc.T @ xc / n, xc.T @ (y - y_mean) / n
    alpha = np.array([p["alpha"] for p in points], dtype=float)
    ratio = np.array([p["l1_ratio"] for p in points], dtype=float)
    lasso, ridge = alpha * ratio, alpha * (1 - ratio)
    w = np.zeros((k, len(points)))
    diagonal = np.diag(moments)
    open_points = np.arange(len(points))
    for sweep in range(sweeps):
        moved = 0.0
        for j in range(k):
            cols = w[:, open_points]
            partial = cross[j] - moments[j] @ cols + diagonal[j] * cols[j]
            shrunk = np.sign(partial) * np.maximum(np.abs(partial) - lasso[open_points], 0.0)
            curvature = diagonal[j] + ridge[open_points]
            new = np.divide(shrunk, curvature, out=np.zeros_like(shrunk), where=curvature > 0)
            moved = max(moved, float(np.max(np.abs(new - cols[j]))))
            w[j, open_points] = new
        if moved <= 1e-13 * max(1e-300, float(np.max(np.abs(w[:, open_points])))):
            break
        if sweep % 10 == 0:
            left = []
            for p in open_points:
                exact = _solve_active(moments, cross, w[:, p], lasso[p], ridge[p])
                if exact is None:
                    left.append(p)
                else:
                    w[:, p] = exact
            open_points = np.array(left, dtype=int)
            if not len(open_points):
                break
    return LinearFit(w, y_mean - x_mean @ w)


def _solve_active(moments, cross, w, lasso, ridge) -> np.ndarray | None:
    active = np.flatnonzero(w) if lasso > 0 else np.arange(len(w))
    exact = np.zeros_like(w)
    if len(active):
        signs = np.sign(w[active]) if lasso > 0 else 0.0
        system = moments[np.ix_(active, active)] + ridge * np.eye(len(active))
        try:
            exact[active] = np.linalg.solve(system, cross[active] - lasso * signs)
        except np.linalg.LinAlgError:
            return None
        if lasso > 0 and np.any(np.sign(exact[active]) != signs):
            return None
    slack = np.abs(cross - moments @ exact - ridge * exact)
    slack[active] = 0.0
    return exact if np.all(slack <= lasso * (1 + 1e-9) + 1e-300) else None


def minimize(gradient: Callable, start: np.ndarray, iterations: int, tolerance: float, memory: int = 10) -> np.ndarray:
    """Limited-memory quasi-Newton descent; ``gradient`` returns (value, gradient)."""
    x, (value, g) = start, gradient(start)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(iterations):
        if np.max(np.abs(g)) <= tolerance:
            break
        direction, alphas = -g, []
        for s, d, rho in reversed(steps):
            a = rho * (s @ direction)
            direction = direction - a * d
            alphas.append(a)
        if steps:
            s, d, _ = steps[-1]
            direction = direction * ((s @ d) / (d @ d))
        else:
            direction = direction / max(1.0, float(np.linalg.norm(g)))
        for (s, d, rho), a in zip(steps, reversed(alphas)):
            direction = direction + s * (a - rho * (d @ direction))
        slope = g @ direction
        if slope >= 0:
            direction, slope, steps = -g, -(g @ g), []
        length = 1.0
        for _ in range(40):
            trial = x + length * direction
            new_value, new_g = gradient(trial)
            if np.isfinite(new_value) and new_value <= value + 1e-4 * length * slope:
                break
            length *= 0.5
        else:
            break
        s, d = trial - x, new_g - g
        improved = value - new_value
        x, value, g = trial, new_value, new_g
        if s @ d > 1e-12 * np.linalg.norm(s) * np.linalg.norm(d):
            steps = [*steps, (s, d, 1.0 / (s @ d))][-memory:]
        if improved <= 1e-15 * max(abs(value), 1e-300):
            break
    return x


def fit_huber(x: np.ndarray, y: np.ndarray, points: Sequence[dict], iterations: int = 1000) -> LinearFit:
    """min sum(s + H_eps((xw + c - y) / s) s) + alpha |w|^2 over w, c and the scale s > 0, for all grid points at once.

    The objective is convex and piecewise smooth, so damped Newton steps reach it in a few rounds. Residuals are
    measured in units of the target's spread, which leaves the minimum as it is."""
    n, k = x.shape
    unit = float(np.std(y)) or 1.0
    design = np.column_stack([x, np.ones(n)])
    squares = (design[:, :, None] * design[:, None, :]).reshape(n, -1)
    target = (y / unit)[:, None]
    eps = np.array([p["epsilon"] for p in points], dtype=float)
    penalty = np.array([p["alpha"] for p in points], dtype=float) * unit
    weighted = np.append(np.ones(k), 0.0)[:, None] * penalty

    def value(beta, scale):
        size = np.abs(design @ beta - target)
        far = size > eps * scale
        loss = np.where(far, 2 * eps * size - eps * eps * scale, size * size / scale).sum(0)
        return n * scale + loss + (weighted * beta * beta).sum(0)

    start = np.linalg.lstsq(design, target, rcond=None)[0]
    beta = np.repeat(start, len(points), axis=1)
    scale = np.full(len(points), max(float(np.std(target - design @ start)), 1e-6))
    now = value(beta, scale)
    for _ in range(iterations):
        r = design @ beta - target
        near = np.abs(r) <= eps * scale
        inner = np.where(near, r, 0.0)
        pull = np.where(near, 2 * r / scale, 2 * eps * np.sign(r))
        g = np.vstack([design.T @ pull + 2 * weighted * beta,
                       n - np.where(near, (r / scale) ** 2, eps * eps).sum(0)])
        h = np.zeros((len(points), k + 2, k + 2))
        h[:, :k + 1, :k + 1] = (near.T.astype(float) @ squares).reshape(-1, k + 1, k + 1) * (2 / scale)[:, None, None]
        h[:, np.arange(k + 1), np.arange(k + 1)] += 2 * weighted.T
        h[:, :k + 1, -1] = h[:, -1, :k + 1] = (-2 / scale ** 2 * (design.T @ inner)).T
        h[:, -1, -1] = 2 / scale ** 3 * (inner * inner).sum(0)
        trace = np.trace(h, axis1=1, axis2=2)
        h[:, np.arange(k + 2), np.arange(k + 2)] += (1e-12 * trace + 1e-12)[:, None]
        step = -np.linalg.solve(h, g.T[:, :, None])[:, :, 0].T
        slope = (g * step).sum(0)
        length = np.where(step[-1] < 0, np.minimum(1.0, 0.9 * scale / np.maximum(-step[-1], 1e-300)), 1.0)
        open_points = slope < -1e-12 * np.abs(now)
        for _ in range(30):
            trial_beta, trial_scale = beta + length * step[:-1], scale + length * step[-1]
            tried = value(trial_beta, trial_scale)
            bad = open_points & ~(tried <= now + 1e-4 * length * slope)
            if not bad.any():
                break
            length = np.where(bad, length * 0.5, length)
        took = open_points & (tried < now)
        beta = np.where(took, trial_beta, beta)
        scale = np.where(took, trial_scale, scale)
        now = np.where(took, tried, now)
        if not took.any() or scale.min() < 1e-12:
            break
    return LinearFit(beta[:k] * unit, beta[k] * unit)


def fit_sgd(x: np.ndarray, y: np.ndarray, points: Sequence[dict], epochs: int = 1000, seed: int = 24) -> LinearFit:
    """Seeded stochastic gradient descent on the Huber loss with an elastic-net penalty, all grid points in step.

    Step size 0.01 t^-0.25; a point stops once five epochs in a row fail to improve its mean loss by 0.001. The L1 part
    is applied as a cumulative penalty that never moves a weight past zero."""
    n, k = x.shape
    alpha, eps, ratio = (np.array([p[c] for p in points], dtype=float) for c in ("alpha", "epsilon", "l1_ratio"))
    w, c = np.zeros((k, len(points))), np.zeros(len(points))
    owed, paid = np.zeros(len(points)), np.zeros_like(w)
    best, stale = np.full(len(points), np.inf), np.zeros(len(points), dtype=int)
    running = np.ones(len(points), dtype=bool)
    rng, t = np.random.default_rng(seed), 1
    for _ in range(epochs):
        total = np.zeros(len(points))
        for i in rng.permutation(n):
            rate = 0.01 * t ** -0.25 * running
            residual = x[i] @ w + c - y[i]
            size = np.abs(residual)
            total += np.where(size <= eps, 0.5 * residual * residual, eps * size - 0.5 * eps * eps)
            step = rate * np.clip(residual, -eps, eps)
            w *= np.maximum(0.0, 1.0 - (1.0 - ratio) * rate * alpha)
            w -= np.outer(x[i], step)
            c -= step
            owed += ratio * rate * alpha
            before = w.copy()
            w = np.where(w > 0, np.maximum(0.0, w - (owed + paid)), np.minimum(0.0, w + (owed - paid)))
            w = np.where((before != 0) & running, w, before)
            paid += w - before
            t += 1
        stale = np.where(total > best - 1e-3 * n, stale + 1, 0)
        best = np.minimum(best, total)
        running &= stale < 5
        if not running.any():
            break
    return LinearFit(w, c)


@dataclass
class NetworkFit:
    """One hidden layer per grid point."""

    layers: list[tuple]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([_activate(act, x @ a + b) @ c + d for act, a, b, c, d in self.layers])

    def explain(self, x: np.ndarray, background: np.ndarray) -> tuple[np.ndarray, float]:
        return permutation_shapley(lambda rows: self.predict(rows)[:, 0], x, background)


def _activate(name: str, z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0.0) if name == "relu" else np.tanh(z)


def fit_network(x: np.ndarray, y: np.ndarray, points: Sequence[dict], iterations: int = 5000,
                seed: int = 24) -> NetworkFit:
    """min |y - f(x)|^2 / 2n + alpha |weights|^2 / 2n for a one-hidden-layer network, seeded uniform start."""
    n, k = x.shape
    layers = []
    for point in points:
        size, act, alpha = int(point["hidden"]), point["activation"], float(point["alpha"])
        rng = np.random.default_rng(seed)
        cuts = np.cumsum([k * size, size, size])

        def unpack(v):
            a, b, c, d = np.split(v, cuts)
            return a.reshape(k, size), b, c, d[0]

        def objective(v):
            a, b, c, d = unpack(v)
            hidden = _activate(act, x @ a + b)
            error = hidden @ c + d - y
            back = np.outer(error, c) * ((hidden > 0) if act == "relu" else 1 - hidden * hidden)
            g = np.concatenate([(x.T @ back + alpha * a).ravel(), back.sum(0), hidden.T @ error + alpha * c,
                                [error.sum()]]) / n
            value = (error @ error + alpha * ((a * a).sum() + c @ c)) / (2 * n)
            return value, g

        first, second = np.sqrt(6.0 / (k + size)), np.sqrt(6.0 / (size + 1))
        start = np.concatenate([rng.uniform(-first, first, k * size + size), rng.uniform(-second, second, size + 1)])
        layers.append((act, *unpack(minimize(objective, start, iterations, 1e-4))))
    return NetworkFit(layers)


def permutation_shapley(predict: Callable, x: np.ndarray, background: np.ndarray, pairs: int = 8,
                        seed: int = 24) -> tuple[np.ndarray, float]:
    """Shapley values against a background: mean change of the prediction when features are switched from background
    to live values one by one, over random orders and their reverses. Base plus values equals the prediction."""
    k = len(x)
    rng = np.random.default_rng(seed)
    orders = [o for p in (rng.permutation(k) for _ in range(pairs)) for o in (p, p[::-1])]
    stacked = np.empty((len(orders), k + 1, *background.shape))
    for i, order in enumerate(orders):
        rows = background.copy()
        stacked[i, 0] = rows
        for j, f in enumerate(order):
            rows[:, f] = x[f]
            stacked[i, j + 1] = rows
    means = predict(stacked.reshape(-1, k)).reshape(len(orders), k + 1, -1).mean(axis=2)
    values = np.zeros(k)
    for order, path in zip(orders, means):
        values[order] += np.diff(path) / len(orders)
    return values, float(means[0, 0])
