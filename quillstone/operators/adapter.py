"""Per-label kernel adapters from one vector space to another.

Training and distances are numeric and run per label; weights, predictions, gates and the tuning of
soft parameters are relational, over one long table of distances (query_id, label, cluster, d). A
label's training rows are bounded: of a larger label, `max_rows` rows are taken by a hash of the id.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators import kernel as K
from quillstone.session import materialize, tasks

MODEL = "label string, cluster int, block int, n int, center array<double>, model binary, error string"
QUERY_BLOCK = 4096


def bounded(rows: DataFrame, max_rows: int, by: str = "label") -> DataFrame:
    """At most `max_rows` rows of each label, those with the smallest hash of the id."""
    w = Window.partitionBy(by).orderBy(F.xxhash64("id"), "id")
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= max_rows).drop("__r")


def train(rows: DataFrame, n_clusters: int = 10, dim: int = 8, block_rows: int = 100, seed: int = 0, singletons: str = "augment", mix: float = 0.1, unit_centers: bool = True, input_scale: float = 1.0, repair: bool = True, max_rows: int = 20_000) -> DataFrame:
    """The model table (label, cluster, block, n, center, model, error) from rows (id, label, x, y).

    Outputs are clustered, cluster means are the centers (unit length if wished), and the inputs of each
    cluster are fitted in blocks. A label that can't be trained has one row with its error, never none.
    """
    few = bounded(rows.where("label IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL"), max_rows).select(F.col("label").cast("string").alias("label"), "id", "x", "y")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        label = pdf["label"].iloc[0]
        out: list[tuple] = []
        try:
            pdf = pdf.sort_values("id")
            x, y = np.stack(pdf["x"].to_numpy()).astype(float) * input_scale, np.stack(pdf["y"].to_numpy()).astype(float)
            labels = K.kmeans(y, min(n_clusters, len(y)), seed)
            x, y, labels = K.resolve_singletons(x, y, labels, singletons, mix)
            for c in range(labels.max() + 1):
                own = labels == c
                center = y[own].mean(0)
                if unit_centers:
                    center = center / max(np.linalg.norm(center), 1e-12)
                for b, (i, j) in enumerate(K.block_bounds(int(own.sum()), block_rows)):
                    m = K.Block.fit(x[own][i:j], dim, repair=repair, seed=seed)
                    out.append((label, c, b, int(own.sum()), center.tolist(), m.dumps(), None))
        except Exception as e:  # reported in the table, label by label
            out = [(label, -1, -1, len(pdf), None, None, f"{type(e).__name__}: {e}")]
        return pd.DataFrame(out, columns=["label", "cluster", "block", "n", "center", "model", "error"])

    n = few.select("label").distinct().count()
    return materialize(few.repartition(max(1, min(n, 8 * tasks(rows.sparkSession))), "label").groupBy("label").applyInPandas(fit, MODEL), "adapter")


def distances(queries: DataFrame, model: DataFrame, kind: str = "folding", input_scale: float = 1.0) -> DataFrame:
    """(query_id, label, cluster, d): the least distance over a cluster's blocks, for each query (query_id, x) and each
    cluster of each label. Queries meet labels in blocks, so that no task and no broadcast grows with either."""
    parts = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    qt = queries.schema["query_id"].dataType.simpleString()
    ready = model.where("error IS NULL").select("label", "cluster", "block", "model")
    labels = ready.select("label").distinct()
    q = queries.where("x IS NOT NULL").select("query_id", "x", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part")).crossJoin(labels)  # every query asks every label
    m = ready.select(F.col("label").alias("m_label"), "cluster", "model", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("m_part"))
    n = max(1, min(labels.count() * parts, 8 * tasks(queries.sparkSession)))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query_id": a["query_id"][:0], "label": a["label"][:0], "cluster": np.zeros(0, np.int32), "d": np.zeros(0)})
        x = np.stack(a["x"].to_numpy()).astype(float) * input_scale
        out = []
        for c, blocks in b.groupby("cluster")["model"]:
            d = np.min([K.Block.loads(s).distance(x, kind) for s in blocks], axis=0)
            out.append(pd.DataFrame({"query_id": a["query_id"].to_numpy(), "label": a["label"].to_numpy(), "cluster": np.int32(c), "d": d}))
        return pd.concat(out)

    left, right = q.repartition(n, "label", "part").groupBy("label", "part"), m.repartition(n, "m_label", "m_part").groupBy("m_label", "m_part")
    return left.cogroup(right).applyInPandas(run, f"query_id {qt}, label string, cluster int, d double")


def combined_distance(d1: Column, d2: Column, kind: str = "folding") -> Column:
    """The combination of both distances as a Column."""
    return {
        "folding": F.sqrt(d1 * d1 + d2 * d2) / math.sqrt(2),
        "product": d1 * d2,
        "minimum": F.least(d1, d2),
        "maximum": F.greatest(d1, d2),
        "cosine": d2,
    }[kind]


def vector_distances(queries: DataFrame, rows: DataFrame, kind: str = "folding") -> DataFrame:
    """(query_id, label, cluster, d): the least distance of each query (query_id, x) from each cluster in each block of
    `rows` (id, label, cluster, x), whose vectors stand for themselves. All queries meet all rows, QUERY_BLOCK by QUERY_BLOCK."""
    q_parts, r_parts = (max(1, math.ceil(t.count() / QUERY_BLOCK)) for t in (queries, rows))
    qt, lt, ct = queries.schema["query_id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString(), rows.schema["cluster"].dataType.simpleString()
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.where("x IS NOT NULL").select("query_id", "x", part("query_id", q_parts).alias("q_part")).withColumn("r_part", every(r_parts))
    r = rows.where("x IS NOT NULL").select("label", "cluster", "x", part("id", r_parts).alias("r_part")).withColumn("q_part", every(q_parts))
    n = max(1, min(q_parts * r_parts, 8 * tasks(queries.sparkSession)))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query_id": a["query_id"][:0], "label": b["label"][:0], "cluster": b["cluster"][:0], "d": np.zeros(0)})
        group = b.groupby(["label", "cluster"], dropna=False).ngroup().to_numpy()
        order = np.argsort(group, kind="stable")
        starts = np.unique(group[order], return_index=True)[1]
        names, y = b[["label", "cluster"]].iloc[order[starts]], np.stack(b["x"].to_numpy()[order]).astype(float)
        yy, out = np.einsum("ij,ij->i", y, y), []
        for i in range(0, len(a), 256):
            own = a.iloc[i : i + 256]
            x = np.stack(own["x"].to_numpy()).astype(float)
            dot = x @ y.T
            d1 = 1 - np.exp(-np.sqrt(np.maximum(np.einsum("ij,ij->i", x, x)[:, None] + yy - 2 * dot, 0)))
            d2 = np.arccos(np.clip(dot, -1, 1)) / np.pi
            d = {"folding": lambda: np.sqrt(d1 * d1 + d2 * d2) / math.sqrt(2), "product": lambda: d1 * d2, "minimum": lambda: np.minimum(d1, d2), "maximum": lambda: np.maximum(d1, d2), "cosine": lambda: d2}[kind]()
            d = np.minimum.reduceat(d, starts, axis=1)
            m = len(names)
            out.append(pd.DataFrame({"query_id": np.repeat(own["query_id"].to_numpy(), m), "label": np.tile(names["label"].to_numpy(), len(own)), "cluster": np.tile(names["cluster"].to_numpy(), len(own)), "d": d.ravel()}))
        return pd.concat(out)

    left, right = (t.repartition(n, "q_part", "r_part").groupBy("q_part", "r_part") for t in (q, r))
    return left.cogroup(right).applyInPandas(run, f"query_id {qt}, label {lt}, cluster {ct}, d double")


def min_over_blocks(blocks: DataFrame) -> DataFrame:
    """(query_id, label, cluster, d) from distances per block."""
    return blocks.groupBy("query_id", "label", "cluster").agg(F.min("d").alias("d"))


def weights(d: DataFrame, alpha: float, topk: int | None, keys: Sequence[str] = ("query_id", "label")) -> DataFrame:
    """(*keys, cluster, p): (1 - d)^alpha of the top k clusters, normalised; even over all clusters if the sum is
    below 1e-12. topk of None, 0 or the number of clusters and more: no truncation. Ties go to the smaller cluster."""
    w = Window.partitionBy(*keys)
    t = d.withColumn("s", F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("d"))), F.lit(float(alpha))))
    if topk and topk > 0:
        t = t.withColumn("r", F.row_number().over(w.orderBy(F.desc("s"), "cluster"))).withColumn("s", F.when(F.col("r") <= topk, F.col("s")).otherwise(0.0))
    t = t.withColumn("total", F.sum("s").over(w)).withColumn("m", F.count(F.lit(1)).over(w))
    return t.select(*keys, "cluster", F.when(F.col("total") <= 1e-12, 1.0 / F.col("m")).otherwise(F.col("s") / F.col("total")).alias("p"))


def centers(model: DataFrame) -> DataFrame:
    """(label, cluster, center), one row for each cluster."""
    return model.where("error IS NULL AND block = 0").select("label", "cluster", "center")


def predict(p: DataFrame, c: DataFrame, keys: Sequence[str] = ("query_id", "label")) -> DataFrame:
    """(*keys, emb): weighted sums of centers."""
    t = p.where("p > 0").join(c, ["label", "cluster"]).select(*keys, "p", F.posexplode("center").alias("at", "v"))
    t = t.groupBy(*keys, "at").agg(F.sum(F.col("p") * F.col("v")).alias("v"))
    return t.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("emb"))


def predict_hard(d: DataFrame, c: DataFrame) -> DataFrame:
    """(query_id, label, emb): the center of the nearest cluster, the first of equally near ones."""
    best = d.groupBy("query_id", "label").agg(F.min_by("cluster", F.struct("d", "cluster")).alias("cluster"))
    return best.join(c, ["label", "cluster"]).select("query_id", "label", F.col("center").alias("emb"))


def gate(d: DataFrame, prefer: str = "first") -> DataFrame:
    """(query_id, label, d): the label whose best cluster is nearest; of equally near ones the first or the last by name, or a named one."""
    best = d.groupBy("query_id", "label").agg(F.min("d").alias("d"))
    if prefer == "first":
        order = [F.col("d"), F.col("label")]
    elif prefer == "last":
        order = [F.col("d"), F.desc("label")]
    else:
        order = [F.col("d"), (F.col("label") != prefer).cast("int"), F.col("label")]
    w = Window.partitionBy("query_id").orderBy(*order)
    return best.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def adapt(queries: DataFrame, model: DataFrame, alpha: float = 10.0, topk: int | None = 2, unit: bool = True, d: DataFrame | None = None) -> DataFrame:
    """(query_id, label, d, emb): the gate first, the prediction only for the winning label."""
    from quillstone.functions.vec import unit as unit_vector

    d = materialize(distances(queries, model), "distances") if d is None else d
    won = gate(d)
    p = weights(d.join(won.select("query_id", "label"), ["query_id", "label"], "left_semi"), alpha, topk)
    t = predict(p, centers(model)).join(won, ["query_id", "label"])
    return t.select("query_id", "label", "d", unit_vector(F.col("emb")).alias("emb") if unit else "emb")


def tune(d: DataFrame, c: DataFrame, targets: DataFrame, alphas: Sequence[float], topks: Sequence[int | None]) -> DataFrame:
    """(label, alpha, topk, mse, best) for each pair of soft parameters on held-out rows (query_id, label, y); the
    first best pair in the order of the lists is marked. One table of distances serves the whole grid."""
    grid = [(i, float(a), int(k or 0)) for i, (a, k) in enumerate((a, k) for a in alphas for k in topks)]
    own = d.join(targets.select("query_id", "label"), ["query_id", "label"], "left_semi")
    g = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("alpha"), F.lit(k).alias("topk")) for i, a, k in grid]))
    t = own.withColumn("g", g).select("query_id", "label", "cluster", "d", "g.*")
    w = Window.partitionBy("query_id", "label", "i")
    s = F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("d"))), F.col("alpha"))
    t = t.withColumn("s", s).withColumn("r", F.row_number().over(w.orderBy(F.desc("s"), "cluster")))
    t = t.withColumn("s", F.when((F.col("topk") <= 0) | (F.col("r") <= F.col("topk")), F.col("s")).otherwise(0.0))
    t = t.withColumn("total", F.sum("s").over(w)).withColumn("m", F.count(F.lit(1)).over(w))
    t = t.select("query_id", "label", "i", "alpha", "topk", "cluster", F.when(F.col("total") <= 1e-12, 1.0 / F.col("m")).otherwise(F.col("s") / F.col("total")).alias("p"))
    y = predict(t, c, ("query_id", "label", "i", "alpha", "topk")).join(targets.select("query_id", "label", "y"), ["query_id", "label"])
    error = F.aggregate(F.zip_with("emb", "y", lambda a, b: F.pow(a - b, F.lit(2))), F.lit(0.0), lambda acc, v: acc + v)
    e = y.groupBy("label", "i", "alpha", "topk").agg((F.sum(error) / F.sum(F.size("y"))).alias("mse"))
    first = Window.partitionBy("label").orderBy("mse", "i")
    return e.withColumn("best", F.row_number().over(first) == 1).drop("i")


def refine(d: DataFrame, model: DataFrame, targets: DataFrame, alpha: float = 10.0, topk: int | None = 2, max_rows: int = 20_000, **how) -> tuple[DataFrame, DataFrame]:
    """Refined centers (label, cluster, center) and the history (label, epoch, mse), per label on bounded rows (query_id, label, y)."""
    y = bounded(targets.withColumnRenamed("query_id", "id"), max_rows).withColumnRenamed("id", "query_id")
    p = weights(d.join(y.select("query_id", "label"), ["query_id", "label"], "left_semi"), alpha, topk)
    rows = p.groupBy("query_id", "label").agg(F.array_sort(F.collect_list(F.struct("cluster", "p"))).alias("ps")).join(y, ["query_id", "label"])
    c = centers(model).select(F.col("label").alias("m_label"), "cluster", "center")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"label": b["m_label"][:0], "cluster": np.zeros(0, np.int32), "center": b["center"][:0], "mse": np.zeros(0)})
        a, b = a.sort_values("query_id"), b.sort_values("cluster")
        at = {int(x): i for i, x in enumerate(b["cluster"])}
        m = np.zeros((len(a), len(b)))
        for i, ps in enumerate(a["ps"]):
            for s in ps:
                m[i, at[int(s["cluster"])]] = s["p"]
        new, history = K.refine_centers(m, np.stack(a["y"].to_numpy()).astype(float), np.stack(b["center"].to_numpy()), **how)
        label = b["m_label"].iloc[0]
        one = pd.DataFrame({"label": label, "cluster": b["cluster"].to_numpy(np.int32), "center": [r.tolist() for r in new], "mse": np.nan})
        return pd.concat([one, pd.DataFrame({"label": label, "cluster": -np.arange(1, len(history) + 1, dtype=np.int32), "center": [[0.0]] * len(history), "mse": history})])

    out = materialize(rows.groupBy("label").cogroup(c.groupBy("m_label")).applyInPandas(run, "label string, cluster int, center array<double>, mse double"), "refined")
    return out.where("cluster >= 0").select("label", "cluster", "center"), out.where("cluster < 0").select("label", (-F.col("cluster")).alias("epoch"), "mse")


def train_family(rows: DataFrame, validation: float = 0.05, alphas: Sequence[float] = (2.0, 5.0, 10.0), topks: Sequence[int | None] = (2, 5, None), epochs: int = 1, seed: int = 0, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Model table with refined centers, soft parameters (label, alpha, topk, mse) and held-out ids (label, id).

    Of each label, the rows whose hash falls below the share are held out; soft parameters are tuned on
    them, centers are refined on the others.
    """
    part = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(10_000)) < int(validation * 10_000)
    rows = materialize(rows.where("label IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL").withColumn("label", F.col("label").cast("string")).withColumn("held", part), "family-rows")
    model = train(rows.where("NOT held"), seed=seed, **how)
    q = rows.withColumnRenamed("id", "query_id")
    d = materialize(distances(q, model), "family-distances")
    best = tune(d, centers(model), q.where("held"), alphas, topks).where("best").drop("best")
    refined, _ = refine(d, model, q.where("NOT held").select("query_id", "label", "y"), epochs=epochs, seed=seed)
    c = refined.withColumnRenamed("center", "refined")
    model = model.join(c, ["label", "cluster"], "left").withColumn("center", F.coalesce("refined", "center")).select(*model.columns)
    return model, best, rows.where("held").select("label", "id")


def classify(queries: DataFrame, model: DataFrame) -> DataFrame:
    """(query_id, label, d): the label of the nearest block; a classifier is an adapter with one cluster for each label."""
    return gate(distances(queries, model))
