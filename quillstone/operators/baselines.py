"""Other encoders from one vector space to another, for comparison.

Each is trained per label on bounded rows and, where it gates, picks the label with the nearest
prototype of outputs. Models are small tables (label, params) with NumPy arrays as bytes.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators.adapter import bounded
from quillstone.operators.kernel import kmeans
from quillstone.session import materialize

MOST_LABELS = 10_000


def _dumps(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _loads(blob: bytes) -> dict[str, np.ndarray]:
    z = np.load(io.BytesIO(blob))
    return {k: z[k] for k in z.files}


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def prototypes(y: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Unit-length means of clusters of unit-length outputs."""
    u = _unit(y)
    labels = kmeans(u, min(n, len(u)), seed)
    return _unit(np.array([u[labels == c].mean(0) for c in range(labels.max() + 1)]))


def least_sqdist(a: np.ndarray, b: np.ndarray, block: int = 2048) -> np.ndarray:
    """Each row's least squared distance to rows of b, 0 at least; infinite if there are none."""
    if not len(b):
        return np.full(len(a), np.inf)
    bb = (b * b).sum(1)
    return np.concatenate([np.maximum(((r := a[i : i + block]) ** 2).sum(1) + (bb - 2 * r @ b.T).min(1), 0) for i in range(0, len(a), block)]) if len(a) else np.zeros(0)


class Mlp:
    """One hidden layer, ReLU, Adam; `loss(out, target) -> (value, gradient)`."""

    def __init__(self, weights: list[np.ndarray]) -> None:
        self.weights = weights

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, hidden: int = 64, epochs: int = 60, batch: int = 64, rate: float = 1e-2, decay: float = 1e-4, seed: int = 0, loss=None) -> Mlp:
        rng = np.random.default_rng(seed)
        w = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, y.shape[1])), np.zeros(y.shape[1])]
        m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        loss = loss or (lambda o, z: (((o - z) ** 2).mean(), 2 * (o - z) / o.size))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                b = order[i : i + batch]
                h = np.maximum(x[b] @ w[0] + w[1], 0)
                _, g = loss(h @ w[2] + w[3], y[b])
                gh = (g @ w[2].T) * (h > 0)
                grads = [x[b].T @ gh + decay * w[0], gh.sum(0), h.T @ g + decay * w[2], g.sum(0)]
                t += 1
                for k, gr in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * gr
                    v[k] = 0.999 * v[k] + 0.001 * gr * gr
                    w[k] = w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return cls(w)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.maximum(x @ w[0] + w[1], 0) @ w[2] + w[3]


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def distillation_loss(student: np.ndarray, teacher: np.ndarray, corpus: np.ndarray, temperature: float = 0.05, kl: float = 1.0, cos: float = 1.0, mse: float = 1.0, focus_topk: int = 0, focus: float = 0.0) -> tuple[float, np.ndarray]:
    """The loss of student outputs and its gradient: divergence of the softened score distributions over a label's
    corpus, the same over the teacher's top units alone, one minus the cosine, and the squared error."""
    n = len(student)
    norm = np.maximum(np.linalg.norm(student, axis=1, keepdims=True), 1e-12)
    u = student / norm
    value, gu = 0.0, np.zeros_like(u)
    parts = [(kl, corpus, slice(None))] if kl else []
    scores = teacher @ corpus.T
    if focus and focus_topk:
        parts.append((focus, corpus, np.argsort(-scores, axis=1, kind="stable")[:, :focus_topk]))
    for weight, c, top in parts:
        if isinstance(top, slice):
            p, q = _softmax(scores / temperature), _softmax(u @ c.T / temperature)
            value += weight * temperature**2 * float((p * (np.log(p + 1e-12) - np.log(q + 1e-12))).sum() / n)
            gu += weight * temperature * (q - p) @ c / n
        else:
            p, q = _softmax(np.take_along_axis(scores, top, 1) / temperature), _softmax(np.take_along_axis(u @ c.T, top, 1) / temperature)
            value += weight * temperature**2 * float((p * (np.log(p + 1e-12) - np.log(q + 1e-12))).sum() / n)
            gu += weight * temperature * np.einsum("ij,ijk->ik", q - p, c[top]) / n
    value += cos * float((1 - (u * teacher).sum(1)).mean())
    gu -= cos * teacher / n
    value += mse * float(((u - teacher) ** 2).mean())
    gu += mse * 2 * (u - teacher) / u.size
    return value, (gu - u * (gu * u).sum(1, keepdims=True)) / norm


KINDS = ("ridge", "mlp", "student", "logistic_proto", "mlp_proto")


def train(rows: DataFrame, kind: str, n_prototypes: int = 4, alpha: float = 1.0, hidden: int = 64, epochs: int = 60, seed: int = 0, max_rows: int = 20_000, corpus: DataFrame | None = None) -> DataFrame:
    """(label, params, error) from rows (id, label, x, y); for "student" also corpus (label, id, emb).

    "ridge", "mlp" and "student" learn outputs per label; "logistic_proto" and "mlp_proto" learn which
    prototype of the label an input belongs to and answer with the weighted prototypes.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}")
    few = bounded(rows.where("label IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL").withColumn("label", F.col("label").cast("string")), max_rows).select("label", "id", "x", "y", F.lit(True).alias("own"))
    if corpus is not None:
        c = bounded(corpus.withColumn("label", F.col("label").cast("string")), max_rows)
        few = few.unionByName(c.select("label", "id", F.lit(None).cast(few.schema["x"].dataType).alias("x"), F.col("emb").cast(few.schema["y"].dataType).alias("y"), F.lit(False).alias("own")))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        label = pdf["label"].iloc[0]
        try:
            own = pdf[pdf["own"]].sort_values("id")
            x, y = np.stack(own["x"].to_numpy()).astype(float), np.stack(own["y"].to_numpy()).astype(float)
            proto = prototypes(y, n_prototypes, seed)
            if kind == "ridge":
                params = {"w": np.linalg.solve(x.T @ x + alpha * np.eye(x.shape[1]), x.T @ y)}
            elif kind == "mlp":
                params = {f"w{i}": w for i, w in enumerate(Mlp.fit(x, y, hidden, epochs, seed=seed).weights)}
            elif kind == "student":
                units = pdf[~pdf["own"]].sort_values("id")
                c = _unit(np.stack(units["y"].to_numpy()).astype(float)) if len(units) else _unit(y)
                loss = lambda o, z: distillation_loss(o, z, c, focus_topk=min(10, len(c)), focus=0.5)
                params = {f"w{i}": w for i, w in enumerate(Mlp.fit(x, _unit(y), hidden, epochs, seed=seed, loss=loss).weights)}
            else:
                member = np.argmin(((_unit(y)[:, None, :] - proto[None]) ** 2).sum(2), 1)
                target = np.eye(len(proto))[member]
                cross = lambda o, z: (0.0, (_softmax(o) - z) / len(o))
                if kind == "mlp_proto":
                    params = {f"w{i}": w for i, w in enumerate(Mlp.fit(x, target, hidden, epochs, seed=seed, loss=cross).weights)}
                else:
                    w, b = np.zeros((x.shape[1], len(proto))), np.zeros(len(proto))
                    for _ in range(300):
                        g = cross(x @ w + b, target)[1]
                        w, b = w - 2.0 * (x.T @ g + alpha / max(1, len(x)) * 0.01 * w), b - 2.0 * g.sum(0)
                    params = {"w": w, "b": b}
            return pd.DataFrame({"label": [label], "params": [_dumps(proto=proto, **params)], "error": [None]})
        except Exception as e:  # reported in the table, label by label
            return pd.DataFrame({"label": [label], "params": [None], "error": [f"{type(e).__name__}: {e}"]})

    return materialize(few.groupBy("label").applyInPandas(fit, "label string, params binary, error string"), f"baseline-{kind}")


def predict(queries: DataFrame, model: DataFrame, kind: str, unit: bool = True) -> DataFrame:
    """(query_id, label, emb): each label's output, of which the one nearest to its label's prototypes is taken."""
    ready = model.where("error IS NULL").orderBy("label").limit(MOST_LABELS + 1).collect()  # a row of bounded size for each label
    if len(ready) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    shared = queries.sparkSession.sparkContext.broadcast([(r["label"], bytes(r["params"])) for r in ready])
    qt = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = [(label, _loads(b)) for label, b in shared.value]
        for b in batches:
            if b.empty or not models:
                continue
            x = np.stack(b["x"].to_numpy()).astype(float)
            best, emb, name = np.full(len(x), np.inf), None, np.empty(len(x), object)
            for label, p in models:
                if kind == "ridge":
                    out = x @ p["w"]
                elif kind in ("mlp", "student"):
                    out = Mlp([p[f"w{i}"] for i in range(4)])(x)
                else:
                    s = x @ p["w"] + p["b"] if kind == "logistic_proto" else Mlp([p[f"w{i}"] for i in range(4)])(x)
                    out = _softmax(s) @ p["proto"]
                d = least_sqdist(_unit(out), p["proto"])
                emb = np.zeros_like(out) if emb is None else emb
                better = d < best
                best[better], emb[better], name[better] = d[better], out[better], label
            yield pd.DataFrame({"query_id": b["query_id"].to_numpy(), "label": name, "emb": list(_unit(emb) if unit else emb)})

    return queries.where("x IS NOT NULL").select("query_id", "x").mapInPandas(run, f"query_id {qt}, label string, emb array<double>")
