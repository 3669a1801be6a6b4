"""Dense kernels that run inside tasks: optimiser, transforms, probes, decoders, clustering."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np

from sparkgauge.functions.vocab import FIT_CLIP


class NotConverged(RuntimeError):
    pass


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int = 500, tolerance: float = 1e-5, memory: int = 20) -> tuple[np.ndarray, float, bool]:
    """Limited-memory quasi-Newton descent with a backtracking search that keeps curvature positive.

    Returns the point, its value and whether the gradient or the decrease fell below the tolerance. A search
    that finds no lower point starts again without memory; if that fails too, the fit has not converged unless the gradient says so.
    """
    value, g = f(x)
    failed = False
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        if np.abs(g).max() <= tolerance * max(1.0, abs(value)):
            return x, value, True
        q = g.copy()
        alphas = []
        for s, y, rho in reversed(pairs):
            a = rho * (s @ q)
            alphas.append(a)
            q -= a * y
        if pairs:
            s, y, _ = pairs[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, np.abs(g).sum())
        for (s, y, rho), a in zip(pairs, reversed(alphas)):
            q += (a - rho * (y @ q)) * s
        slope = g @ q
        if slope <= 0:
            q, slope, pairs = g.copy(), g @ g, []
        step, low, high = 1.0, 0.0, np.inf
        for _ in range(40):
            new = x - step * q
            nv, ng = f(new)
            if not np.isfinite(nv) or nv > value - 1e-4 * step * slope:
                high = step
            elif ng @ q > 0.9 * slope:
                low = step
            else:
                break
            step = (low + high) / 2 if np.isfinite(high) else 2 * step
        if not nv <= value:
            if not pairs or failed:
                return x, value, bool(np.abs(g).max() <= 10 * tolerance * max(1.0, abs(value)))
            failed, pairs = True, []
            continue
        failed = False
        s, y = new - x, ng - g
        sy = s @ y
        if sy > 1e-12 * (y @ y):
            pairs = [*pairs[-(memory - 1) :], (s, y, 1.0 / sy)]
        done = value - nv <= 1e-10 * max(1.0, abs(value))
        x, value, g = new, nv, ng
        if done:
            return x, value, True
    return x, value, False


def log_softmax(s: np.ndarray) -> np.ndarray:
    s = s - s.max(axis=1, keepdims=True)
    return s - np.log(np.exp(s).sum(axis=1, keepdims=True))


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0.0)


def bits(p: np.ndarray, y: np.ndarray, clip: float = FIT_CLIP) -> np.ndarray:
    return -np.log2(np.clip(p[np.arange(len(y)), y], clip, 1.0))


# transforms, fitted on training rows only


@dataclass(frozen=True)
class Transform:
    """x -> ((x - mean) / scale) @ rotation + shift, blocks weighted by their multiplier."""

    mean: np.ndarray
    scale: np.ndarray
    rotation: np.ndarray | None = None
    shift: np.ndarray | None = None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return z if self.rotation is None else z @ self.rotation + self.shift


def scaler(x: np.ndarray, blocks: Sequence[int] | None = None, multipliers: Sequence[float] | None = None) -> Transform:
    """Zero mean and unit population deviation, constant columns left at scale 1; a block is then multiplied."""
    sd = x.std(axis=0)
    sd = np.where(sd > 0, sd, 1.0)
    if blocks:
        if sum(blocks) != x.shape[1] or len(blocks) != len(multipliers or ()):
            raise ValueError("blocks don't match the columns or the multipliers")
        w = np.repeat(np.asarray(multipliers, dtype=float), blocks)
        if (w < 0).any():
            raise ValueError("a multiplier is negative")
        if (w == 0).any():
            rot = np.diag(w)
            return Transform(x.mean(axis=0), sd, rot, np.zeros(x.shape[1]))
        sd = sd / w
    return Transform(x.mean(axis=0), sd)


def principal(x: np.ndarray, k: int, standardize: bool = True) -> tuple[Transform, np.ndarray]:
    """Standardised (or just centred) rows onto the first ``k`` principal axes, each with its largest weight positive; and explained shares."""
    base = scaler(x) if standardize else Transform(x.mean(axis=0), np.ones(x.shape[1]))
    z = base(x)
    center = z.mean(axis=0)
    _, s, vt = np.linalg.svd(z - center, full_matrices=False)
    if not 0 < k <= len(s):
        raise ValueError(f"{k} of {len(s)} components")
    axes = vt[:k]
    sign = np.sign(axes[np.arange(k), np.abs(axes).argmax(axis=1)])
    axes = axes * np.where(sign == 0, 1, sign)[:, None]
    share = s**2 / max((s**2).sum(), 1e-300)
    return Transform(base.mean, base.scale, axes.T, -center @ axes.T), share[:k]


# linear probes


def fit_multinomial(x: np.ndarray, y: np.ndarray, classes: int, c: float, intercept_penalty: bool = False, rounds: int = 20000, strict: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Weights (classes, d) and intercepts of 1/2 |W|^2 + C times the summed loss. Every class has to occur."""
    missing = np.setdiff1d(np.arange(classes), y)
    if len(missing):
        raise ValueError(f"classes without a row: {missing.tolist()}")
    n, d = x.shape
    hot = np.zeros((n, classes))
    hot[np.arange(n), y] = 1

    def f(v: np.ndarray) -> tuple[float, np.ndarray]:
        w, b = v[: classes * d].reshape(classes, d), v[classes * d :]
        lp = log_softmax(x @ w.T + b)
        r = np.exp(lp) - hot
        loss = -lp[np.arange(n), y].sum() / n + (w * w).sum() / (2 * c * n)
        gw, gb = r.T @ x / n + w / (c * n), r.sum(axis=0) / n
        if intercept_penalty:
            loss += (b * b).sum() / (2 * c * n)
            gb = gb + b / (c * n)
        return loss, np.concatenate([gw.ravel(), gb])

    v, _, ok = minimise(f, np.zeros(classes * (d + 1)), rounds)
    if strict and not ok:
        raise NotConverged("multinomial fit")
    w, b = v[: classes * d].reshape(classes, d), v[classes * d :]
    return w - w.mean(axis=0), b - b.mean()


def fit_binary(x: np.ndarray, y: np.ndarray, c: float, rounds: int = 20000) -> tuple[np.ndarray, float]:
    n = len(y)
    t = 2.0 * y - 1

    def f(v: np.ndarray) -> tuple[float, np.ndarray]:
        m = t * (x @ v[:-1] + v[-1])
        loss = np.logaddexp(0, -m).sum() / n + (v[:-1] @ v[:-1]) / (2 * c * n)
        g = -t / (1 + np.exp(np.clip(m, -500, 500))) / n
        return loss, np.concatenate([x.T @ g + v[:-1] / (c * n), [g.sum()]])

    v, _, ok = minimise(f, np.zeros(x.shape[1] + 1), rounds)
    if not ok:
        raise NotConverged("binary fit")
    return v[:-1], float(v[-1])


def predict_labels(x: np.ndarray, y: np.ndarray, new: np.ndarray, c: float) -> np.ndarray:
    """One against the rest for each column of ``y``; a constant label predicts its clipped share."""
    out = np.empty((len(new), y.shape[1]))
    for k in range(y.shape[1]):
        share = y[:, k].mean()
        if share in (0.0, 1.0):
            out[:, k] = share
        else:
            w, b = fit_binary(x, y[:, k], c)
            out[:, k] = 1 / (1 + np.exp(-np.clip(new @ w + b, -500, 500)))
    return np.clip(out, FIT_CLIP, 1 - FIT_CLIP)


# prototype decoders


def class_means(x: np.ndarray, y: np.ndarray, classes: int) -> np.ndarray:
    return np.array([x[y == k].mean(axis=0) for k in range(classes)])


def class_prior(y: np.ndarray, classes: int) -> np.ndarray:
    p = np.maximum(np.bincount(y, minlength=classes) / len(y), FIT_CLIP)
    return p / p.sum()


def site_scores(x: np.ndarray, sites: np.ndarray, weights: np.ndarray, gamma: float) -> np.ndarray:
    """(n, K) scores of K classes with m sites each: log of summed exp(weight - gamma d^2)."""
    k, m, d = sites.shape
    s = weights.reshape(-1)[None, :] - gamma * squared_distances(x, sites.reshape(k * m, d))
    s = s.reshape(len(x), k, m)
    top = s.max(axis=2)
    return top + np.log(np.exp(s - top[:, :, None]).sum(axis=2))


def fit_offsets(x: np.ndarray, y: np.ndarray, classes: int, gamma: float, c: float) -> tuple[np.ndarray, np.ndarray]:
    """Class means with free offsets under a ridge."""
    means = class_means(x, y, classes)
    base = -gamma * squared_distances(x, means)
    n = len(y)
    hot = np.eye(classes)[y]

    def f(o: np.ndarray) -> tuple[float, np.ndarray]:
        lp = log_softmax(base + o)
        return -lp[np.arange(n), y].sum() / n + (o @ o) / (2 * c * n), (np.exp(lp) - hot).sum(axis=0) / n + o / (c * n)

    o, _, _ = minimise(f, np.zeros(classes))
    return means, o


def fit_sites(x: np.ndarray, y: np.ndarray, start: np.ndarray, weights: np.ndarray, c: float, free_weights: bool, ridge: str = "linear", rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Sites (K, m, d) and weights that minimise the loss of softmax over log-sum-exp scores with gamma 1.

    The ridge is on each site's linear form, 2 s and weight - |s|^2 (``linear``), or on the site itself (``sites``). Distances
    enter by their expansion, so nothing larger than rows by sites is held.
    """
    v, _, _ = minimise(site_loss(x, y, start.shape, weights, c, free_weights, ridge), np.concatenate([start.ravel(), weights.ravel()]) if free_weights else start.ravel(), rounds)
    k, m, d = start.shape
    return v[: k * m * d].reshape(k, m, d), (v[k * m * d :].reshape(k, m) if free_weights else weights)


def site_loss(x: np.ndarray, y: np.ndarray, shape: tuple[int, int, int], weights: np.ndarray, c: float, free_weights: bool, ridge: str) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """Value and gradient of the objective of ``fit_sites``."""
    if ridge not in ("linear", "sites"):
        raise ValueError(ridge)
    linear = ridge == "linear"
    k, m, d = shape
    n = len(y)
    xx = (x * x).sum(axis=1)
    owner = np.repeat(np.arange(k), m)
    hot = np.eye(k)[y]

    def f(v: np.ndarray) -> tuple[float, np.ndarray]:
        s = v[: k * m * d].reshape(k * m, d)
        o = v[k * m * d :] if free_weights else weights.reshape(-1)
        ss = (s * s).sum(axis=1)
        z = o[None, :] - (xx[:, None] + ss[None, :] - 2 * x @ s.T)
        zk = z.reshape(n, k, m)
        top = zk.max(axis=2)
        e = np.exp(zk - top[:, :, None])
        score = top + np.log(e.sum(axis=2))
        within = (e / e.sum(axis=2, keepdims=True)).reshape(n, k * m)
        lp = log_softmax(score)
        r = ((np.exp(lp) - hot)[:, owner] * within) / n
        b = o - ss
        charge = 4 * (s * s).sum() + (b * b).sum() if linear else (s * s).sum()
        loss = -lp[np.arange(n), y].sum() / n + charge / (2 * c * n)
        total = r.sum(axis=0)
        gs = 2 * (r.T @ x) - 2 * total[:, None] * s + (4 * s - 2 * b[:, None] * s if linear else s) / (c * n)
        if not free_weights:
            return loss, gs.ravel()
        return loss, np.concatenate([gs.ravel(), total + (b / (c * n) if linear else 0)])

    return f


def power_form(w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sites and power weights of linear scores in the gauge of zero sums."""
    w, b = w - w.mean(axis=0), b - b.mean()
    return w / 2, b + (w * w).sum(axis=1) / 4


def kmeans(x: np.ndarray, m: int, rng: np.random.Generator, restarts: int = 5, fixed: np.ndarray | None = None, rounds: int = 100) -> np.ndarray:
    """``m`` centres by spread-out seeding and alternation, best of the restarts; ``fixed`` is a first centre that never moves."""
    m = min(m, len(x)) if fixed is None else m
    best, least = None, np.inf
    for _ in range(restarts):
        centres = [fixed if fixed is not None else x[rng.integers(len(x))]]
        while len(centres) < m:
            d = squared_distances(x, np.array(centres)).min(axis=1)
            centres.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
        c = np.array(centres)
        cell = None
        for _ in range(rounds):
            d = squared_distances(x, c)
            now = d.argmin(axis=1)
            if cell is not None and (now == cell).all():
                break
            cell = now
            for j in range(0 if fixed is None else 1, len(c)):
                own = cell == j
                if own.any():
                    c[j] = x[own].mean(axis=0)
        inertia = squared_distances(x, c).min(axis=1).sum()
        if inertia < least:
            best, least = c, inertia
    return best


def class_sites(x: np.ndarray, y: np.ndarray, classes: int, m: int, seed: int, restarts: int = 5, keep_mean: bool = False) -> np.ndarray:
    """(K, m, d): ``m`` centres of each class, the first its mean if asked; a small class repeats its centres."""
    out = []
    for k in range(classes):
        own = x[y == k]
        c = kmeans(own, m, np.random.default_rng(seed + k), restarts, own.mean(axis=0) if keep_mean else None)
        out.append(c[np.arange(m) % len(c)])
    return np.array(out)


# sampled learners


def nearest_site(x: np.ndarray, sites: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    d = ((x[:, None, :] - sites[None]) ** 2).sum(2) if len(x) * len(sites) * x.shape[1] < 2e7 else squared_distances(x, sites)
    return (d if weights is None else d - weights).argmin(axis=1)


def prototype_predict(train: np.ndarray, labels: np.ndarray, test: np.ndarray, classes: int) -> np.ndarray:
    """Label of the nearest mean of the sampled members; a label without members can't win."""
    means = np.full((classes, train.shape[1]), np.inf)
    for k in np.unique(labels):
        means[k] = train[labels == k].mean(axis=0)
    have = np.isfinite(means[:, 0])
    return np.nonzero(have)[0][squared_distances(test, means[have]).argmin(axis=1)]


def neighbour_predict(train: np.ndarray, labels: np.ndarray, test: np.ndarray, classes: int, k: int | None = None) -> np.ndarray:
    """Inverse squared distance votes of the k nearest, about the root of their number; exact matches vote alone."""
    k = k or max(1, round(np.sqrt(len(train))))
    out = np.empty(len(test), dtype=np.int64)
    hot = np.eye(classes)[labels]
    for a in range(0, len(test), 512):
        d = squared_distances(test[a : a + 512], train)
        near = np.argsort(d, axis=1, kind="stable")[:, :k]
        dd = np.take_along_axis(d, near, 1)
        exact = dd <= 1e-24
        w = np.where(exact.any(axis=1, keepdims=True), exact, 1 / np.maximum(dd, 1e-24))
        out[a : a + 512] = (w[:, :, None] * hot[near]).sum(axis=1).argmax(axis=1)
    return out


def agreement(truth: np.ndarray, guess: np.ndarray, classes: int) -> dict[str, float]:
    """Mutual information in nats, normalised, adjusted Rand index, macro F1 over the fixed axis, accuracy."""
    t = np.zeros((classes, classes))
    np.add.at(t, (truth, guess), 1)
    n = t.sum()
    a, b = t.sum(1), t.sum(0)
    nz = t > 0
    mi = float((t[nz] / n * np.log(n * t[nz] / np.outer(a, b)[nz])).sum())
    h = [float(-(v[v > 0] / n * np.log(v[v > 0] / n)).sum()) for v in (a, b)]
    pairs = lambda v: float((v * (v - 1) / 2).sum())
    expected = pairs(a) * pairs(b) / (n * (n - 1) / 2) if n > 1 else 0.0
    top = (pairs(a) + pairs(b)) / 2
    f1 = 2 * np.diag(t) / np.maximum(a + b, 1)
    return {"mi": mi, "nmi": mi / ((h[0] + h[1]) / 2) if sum(h) > 0 else 1.0, "ari": (pairs(t) - expected) / (top - expected) if top != expected else 1.0, "macro_f1": float(f1.mean()), "accuracy": float(np.trace(t) / n)}


def contrast(sites: np.ndarray) -> tuple[float, float]:
    d = np.sqrt(((sites[:, None] - sites[None]) ** 2).sum(2))[np.triu_indices(len(sites), 1)]
    return float(d.sum()), float(d.mean())


def representation(sites: np.ndarray, points: np.ndarray, cells: np.ndarray) -> tuple[float, float] | None:
    """Sum and mean distance of sites to their cells' centroids; None if a cell is empty."""
    d = []
    for k in range(len(sites)):
        own = points[cells == k]
        if not len(own):
            return None
        d.append(np.sqrt(((own.mean(axis=0) - sites[k]) ** 2).sum()))
    return float(np.sum(d)), float(np.mean(d))


def entropy_bits(supports: np.ndarray) -> float:
    p = supports[supports > 0] / supports.sum()
    return float(-(p * np.log2(p)).sum())
