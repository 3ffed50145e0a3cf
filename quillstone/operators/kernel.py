"""Kernel-regularised block models: the NumPy core of the adapter.

Rows are samples. A block keeps its training rows, their projection on the leading components,
the precision of the projections and the regularised inverse of their Gaussian kernel.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np

TINY = np.finfo(float).eps


def principal(y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(projections, components): the rows, not centred, on the leading components of their centred covariance.

    Components without variance are dropped; without any, ValueError.
    """
    c = y - y.mean(0)
    values, vectors = np.linalg.eigh(c.T @ c / (len(y) - 1))
    order = np.argsort(-values)
    some = int((values[order] > TINY).sum())
    if not some:
        raise ValueError("the rows of a block don't differ")
    pc = vectors[:, order[: min(n, some)]]
    return y @ pc, pc


def gaussian(a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """exp(-0.5 / n * squared distance in the metric root @ root), n the dimension."""
    n = a.shape[1]
    u, v = a @ root, b @ root
    d = (u * u).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * u @ v.T
    return np.exp(-0.5 / n * np.maximum(d, 0))


def regularised_inverse(k: np.ndarray, y: np.ndarray, tol: float = 1e-3, most: int = 100) -> np.ndarray:
    """(lambda I + K)^-1 of the last lambda of a fixed-point iteration that was inverted."""
    power = float((y * y).mean())
    tau = lam = 2 * power
    lam = tau + 0.5 * power
    inverse = None
    for _ in range(most):
        inverse = np.linalg.inv(lam * np.eye(len(k)) + k)
        rest = y - (k @ inverse) @ y
        new = tau + float((rest * rest).mean())
        change, lam = abs(new - lam), new
        if change <= tol:
            break
    return inverse


@dataclass
class Block:
    pc: np.ndarray
    z: np.ndarray
    inverse: np.ndarray
    y: np.ndarray
    root: np.ndarray

    @classmethod
    def fit(cls, y: np.ndarray, dim: int, min_range: float = 1e-3, repair: bool = True, seed: int = 0) -> Block:
        """Fit to rows. Where they are degenerate and `repair` is set, growing jitter is tried and then plain axes."""
        y = np.asarray(y, np.float32).astype(float)
        if len(y) < 2:
            if not repair:
                raise ValueError("a block needs two rows")
            y = np.concatenate([y, y])
        try:
            return cls._fit(y, dim, min_range)
        except (ValueError, np.linalg.LinAlgError):
            if not repair:
                raise
        rng, noise = np.random.default_rng(seed), 1e-4 * max(float(np.abs(y).max(initial=0.0)), 1.0)
        for _ in range(6):
            try:
                return cls._fit(y + noise * rng.normal(size=y.shape), dim, 0.0)
            except (ValueError, np.linalg.LinAlgError):
                noise *= 2
        pc = np.eye(y.shape[1])[:, :1]
        root = np.eye(1)
        z = y @ pc
        return cls(pc, z, regularised_inverse(gaussian(z, z, root), y), y, root)

    @classmethod
    def _fit(cls, y: np.ndarray, dim: int, min_range: float) -> Block:
        dim = min(dim, len(y) - 1)
        z, pc = principal(y, dim)
        while np.ptp(z, axis=0).min() < min_range and dim > 1:
            dim -= 1
            z, pc = principal(y, dim)
        precision = np.linalg.inv(np.atleast_2d(np.cov(z, rowvar=False)))
        values, vectors = np.linalg.eigh(precision)
        root = (vectors * np.sqrt(np.clip(values, 0, None))) @ vectors.T
        return cls(pc, z, regularised_inverse(gaussian(z, z, root), y), y, root)

    def reconstruct(self, x: np.ndarray) -> np.ndarray:
        """Training rows averaged by normalised kernel weights; a zero row where the weights sum to zero."""
        w = gaussian(x @ self.pc, self.z, self.root) @ self.inverse
        total = w.sum(1, keepdims=True)
        return (w / np.where(total == 0, 1.0, total)) @ self.y

    def distance(self, x: np.ndarray, kind: str = "folding") -> np.ndarray:
        return combine(x, self.reconstruct(x), kind)

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{k: np.asarray(v, np.float32) for k, v in self.__dict__.items()})
        return out.getvalue()

    @classmethod
    def loads(cls, blob: bytes) -> Block:
        z = np.load(io.BytesIO(blob))
        return cls(**{k: z[k].astype(float) for k in ("pc", "z", "inverse", "y", "root")})


def combine(x: np.ndarray, hat: np.ndarray, kind: str = "folding") -> np.ndarray:
    """The distance of rows from their reconstruction: 1 - exp(-|difference|) and the angle over pi, combined."""
    d1 = 1 - np.exp(-np.linalg.norm(hat - x, axis=1))
    norms = np.linalg.norm(hat, axis=1) * np.linalg.norm(x, axis=1)
    cos = np.divide((hat * x).sum(1), norms, out=np.zeros(len(x)), where=norms != 0)
    d2 = np.arccos(np.clip(cos, -1, 1)) / np.pi
    kinds = {"folding": lambda: np.sqrt(d1**2 + d2**2) / np.sqrt(2), "product": lambda: d1 * d2, "minimum": lambda: np.minimum(d1, d2), "maximum": lambda: np.maximum(d1, d2), "cosine": lambda: d2}
    if kind not in kinds:
        raise ValueError(f"unknown distance {kind!r}")
    return kinds[kind]()


def block_bounds(n: int, size: int) -> list[tuple[int, int]]:
    """n rows in round-half-up(n / size) contiguous blocks, the first ones a row longer."""
    m = max(1, int(np.floor(n / size + 0.5)))
    ends = np.cumsum([n // m + (i < n % m) for i in range(m)])
    return list(zip([0, *ends[:-1].tolist()], ends.tolist()))


def kmeans(y: np.ndarray, k: int, seed: int = 0, iterations: int = 25) -> np.ndarray:
    """Labels of Lloyd's algorithm from a k-means++ start; k = n: every row by itself."""
    n = len(y)
    if k > n:
        raise ValueError(f"{k} clusters of {n} rows")
    if k == n:
        return np.arange(n)
    rng = np.random.default_rng(seed)
    at = [int(rng.integers(n))]
    d = ((y - y[at[0]]) ** 2).sum(1)
    for _ in range(k - 1):
        at.append(int(rng.choice(n, p=d / d.sum())) if d.sum() > 0 else int(rng.integers(n)))
        d = np.minimum(d, ((y - y[at[-1]]) ** 2).sum(1))
    centers = y[at].astype(float)
    labels = np.full(n, -1)
    for _ in range(iterations):
        new = np.argmin((centers * centers).sum(1) - 2 * y @ centers.T, 1)
        if (new == labels).all():
            break
        labels = new
        for c in np.unique(labels):
            centers[c] = y[labels == c].mean(0)
    return np.unique(labels, return_inverse=True)[1]


def resolve_singletons(x: np.ndarray, y: np.ndarray, labels: np.ndarray, strategy: str = "augment", mix: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Clusters of one row get a second one ("augment": the input moved towards its nearest other row, of the
    same length, with the same output) or join the nearest larger cluster ("merge")."""
    if strategy not in ("augment", "merge"):
        raise ValueError(f"unknown strategy {strategy!r}")
    count = np.bincount(labels)
    alone = np.flatnonzero(count[labels] == 1)
    if not len(alone):
        return x, y, labels
    if len(x) < 2:
        raise ValueError("two rows are needed")
    if strategy == "merge":
        if (count == 1).all():
            raise ValueError("every row is a cluster: nothing to merge with")
        centers = np.array([y[labels == c].mean(0) for c in range(len(count))])
        labels = labels.copy()
        for i in alone:
            big = np.flatnonzero((count >= 2) & (np.arange(len(count)) != labels[i]))
            to = big[np.argmin(((centers[big] - y[i]) ** 2).sum(1))]
            count[labels[i]] -= 1
            count[to] += 1
            labels[i] = to
        return x, y, np.unique(labels, return_inverse=True)[1]
    d = (x * x).sum(1)[None, :] - 2 * x[alone] @ x.T
    d[np.arange(len(alone)), alone] = np.inf
    mixed = (1 - mix) * x[alone] + mix * x[np.argmin(d, 1)]
    mixed *= (np.linalg.norm(x[alone], axis=1) + 1e-12)[:, None] / (np.linalg.norm(mixed, axis=1) + 1e-12)[:, None]
    return np.concatenate([x, mixed]), np.concatenate([y, y[alone]]), np.concatenate([labels, labels[alone]])


def soft_weights(d: np.ndarray, alpha: float, topk: int | None) -> np.ndarray:
    """Weights of clusters (columns) from distances: (1 - d)^alpha, the top k kept, normalised; even if nothing is left."""
    s = np.clip(1 - d, 0, 1) ** alpha
    if topk and topk < s.shape[1]:
        order = np.argsort(-s, axis=1, kind="stable")
        np.put_along_axis(s, order[:, topk:], 0, 1)
    total = s.sum(1, keepdims=True)
    return np.where(total <= 1e-12, 1 / s.shape[1], s / np.where(total <= 1e-12, 1, total))


def refine_centers(p: np.ndarray, y: np.ndarray, centers: np.ndarray, mu: float = 0.1, eps: float = 1.0, epochs: int = 1, batch: int = 256, anchor: float = 0.0, seed: int = 0, unit: bool = False) -> tuple[np.ndarray, list[float]]:
    """Normalised least-mean-squares steps on the centers for weights p and outputs y, and each epoch's error
    as it was before its steps. `anchor` pulls towards the first centers, `unit` makes the result unit length."""
    if epochs < 1 or batch < 1 or mu <= 0 or eps <= 0:
        raise ValueError("epochs, batch, mu and eps must be positive")
    start, c, rng, history = centers.astype(float), centers.astype(float).copy(), np.random.default_rng(seed), []
    for _ in range(epochs):
        order, error = rng.permutation(len(p)), 0.0
        for i in range(0, len(p), batch):
            b = order[i : i + batch]
            e = y[b] - p[b] @ c
            error += float((e * e).sum())
            c += p[b].T @ (e * (mu / (eps + mu * (p[b] ** 2).sum(1)))[:, None])
            if anchor > 0:
                c -= mu * anchor * (c - start)
        history.append(error / max(1, y.size))
    if unit:
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c, history
