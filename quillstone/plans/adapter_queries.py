"""The adapter and other encoders over the embeddings table: inputs are the first 16 elements, outputs whole vectors.

Rows whose id is divisible by 10 are queries, the others train.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import vec
from quillstone.operators import adapter as A
from quillstone.operators import baselines as B
from quillstone.operators import lexical as L
from quillstone.operators import metrics as M
from quillstone.operators import retrieval as T
from quillstone.operators.encode import encode, hashing_encoder
from quillstone.session import materialize
from quillstone.sources.tables import table


def _rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"), vec.unit(vec.fix_dimension(F.col("embedding"), 16)).alias("x"), F.transform("embedding", lambda v: v.cast("double")).alias("y"))


def _model(spark: SparkSession, d: str, clusters: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = _rows(spark, d)
    model = A.train(rows.where("id % 10 <> 0"), clusters, 6, 60)
    q = rows.where("id % 10 = 0").select(F.col("id").alias("query_id"), "label", "x", "y")
    return model, q, materialize(A.distances(q, model), "distances")


def _table(spark: SparkSession, d: str) -> DataFrame:
    """Distances of all queries from all training vectors, a label's vectors modulo 4 being its clusters."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("x"))
    c = e.where("vec_id % 10 <> 0").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"), (F.col("vec_id") % 4).cast("int").alias("cluster"), F.col("embedding").alias("x"))
    return A.min_over_blocks(A.vector_distances(q, c).withColumn("d", F.round("d", 9)))


def h12_blocks(spark: SparkSession, d: str) -> DataFrame:
    """What was trained for each label, and errors."""
    m = A.train(_rows(spark, d).where("id % 10 <> 0"), 5, 6, 60)
    return m.groupBy("label").agg(F.count_distinct("cluster").alias("clusters"), F.count(F.lit(1)).alias("blocks"), F.max("error").alias("error"))


def h14_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distances of queries from labels' nearest clusters."""
    _, _, dist = _model(spark, d)
    return dist.groupBy("query_id", "label").agg(F.round(F.min("d"), 6).alias("d"))


def h14_combination(spark: SparkSession, d: str) -> DataFrame:
    """All combinations of two distances, here of event values."""
    d1, d2 = 1 - F.exp(-F.abs("value") / 10), (F.col("event_id") % 100) / 100
    kinds = ("folding", "product", "minimum", "maximum", "cosine")
    return table(spark, d, "events").select("event_id", *[F.round(A.combined_distance(d1, d2, k), 6).alias(k) for k in kinds])


def h15_block_minimum(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d).select("query_id", "label", "cluster", F.round("d", 6).alias("d"))


def h16_weights(spark: SparkSession, d: str) -> DataFrame:
    return A.weights(_table(spark, d), 10, 2).select("query_id", "label", "cluster", F.round("p", 6).alias("p"))


def h17_soft(spark: SparkSession, d: str) -> DataFrame:
    """Soft predictions and their distance from the target."""
    m, q, dist = _model(spark, d)
    own = dist.join(q.select("query_id", "label"), ["query_id", "label"], "left_semi")
    t = A.predict(A.weights(own, 10, 2), A.centers(m)).join(q, ["query_id", "label"])
    return t.select("query_id", F.round(vec.cosine(F.col("emb"), F.col("y")), 4).alias("cos"))


def h17_hard(spark: SparkSession, d: str) -> DataFrame:
    m, q, dist = _model(spark, d)
    t = A.predict_hard(dist, A.centers(m)).join(q, ["query_id", "label"])
    return t.select("query_id", F.round(vec.cosine(F.col("emb"), F.col("y")), 4).alias("cos"))


def h19_gate(spark: SparkSession, d: str) -> DataFrame:
    return A.gate(_table(spark, d)).select("query_id", "label", F.round("d", 6).alias("d"))


def h21_tuning(spark: SparkSession, d: str) -> DataFrame:
    m, q, dist = _model(spark, d)
    t = A.tune(dist, A.centers(m), q, (2.0, 5.0, 10.0), (2, None))
    return t.select("label", "alpha", "topk", F.round("mse", 6).alias("mse"), "best")


def h22_refinement(spark: SparkSession, d: str) -> DataFrame:
    m, q, dist = _model(spark, d)
    return A.refine(dist, m, q, epochs=3)[1].select("label", "epoch", F.round("mse", 6).alias("mse"))


def h24_classifier(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    m = A.train(rows.where("id % 10 <> 0"), 1, 6, 30)
    return A.classify(rows.where("id % 10 = 0").select(F.col("id").alias("query_id"), "x"), m).select("query_id", "label", F.round("d", 4).alias("d"))


def _quality(spark: SparkSession, d: str, adapted: DataFrame) -> DataFrame:
    """Mean metrics at k = 10 of adapted queries against the corpus, and the agreement with targets."""
    rows = _rows(spark, d)
    c = rows.where("id % 10 <> 0").select(F.col("id").alias("unit_id"), F.col("y").alias("emb"), "label")
    q = rows.where("id % 10 = 0").select(F.col("id").alias("query_id"), F.col("label").alias("gold"), "y")
    adapted = materialize(adapted.select("query_id", "emb"), "adapted")
    ranked = T.topk(adapted, c, 10, carry=("label",)).join(q.select("query_id", "gold"), "query_id")
    m = M.means(M.per_query(ranked, M.prior(c), [10]))
    e = vec.embedding_metrics(adapted.join(q, "query_id"), "emb", "y")
    return m.crossJoin(e.select(F.round("mse", 6).alias("mse"), F.round("cos_mean", 4).alias("cos_mean")))  # one row each


def h25_adapter(spark: SparkSession, d: str) -> DataFrame:
    m, q, dist = _model(spark, d)
    return _quality(spark, d, A.adapt(q, m, d=dist))


def e20_margins(spark: SparkSession, d: str) -> DataFrame:
    """Mean squared weights of clusters against their shares of training rows, per label."""
    m, q, dist = _model(spark, d)
    own = dist.join(q.select("query_id", "label"), ["query_id", "label"], "left_semi")
    p = A.weights(own, 10, 2).select(F.col("query_id").alias("id"), F.concat_ws(":", "label", "cluster").alias("cluster"), "p")
    n = m.where("error IS NULL AND block = 0").select(F.concat_ws(":", "label", "cluster").alias("cluster"), "n")
    t = M.support_margins(p, n)
    return t.select("cluster", *[F.round(c, 6).alias(c) for c in ("lhs", "rhs", "margin")])


def h23_family(spark: SparkSession, d: str) -> DataFrame:
    """Soft parameters chosen on held-out rows of each label."""
    _, best, _ = A.train_family(_rows(spark, d), 0.2, (2.0, 10.0), (2, None), n_clusters=4, dim=6, block_rows=60)
    return best.select("label", "alpha", "topk", F.round("mse", 6).alias("mse"))


def h6_index(spark: SparkSession, d: str) -> DataFrame:
    """A lexical index of passages and its answers to test queries."""
    t = table(spark, d, "ris_sentences").where("sentence IS NOT NULL")
    q = table(spark, d, "test").where("query_text IS NOT NULL")
    return L.answers(q, "query_id", "query_text", t, "sentence_id", "sentence", 3).select("query_id", "rank", "unit_id", F.round("score", 3).alias("score"))


def h7_encode(spark: SparkSession, d: str) -> DataFrame:
    """Test queries through the encoder interface."""
    q = table(spark, d, "test").select("query_id", "query_text")
    t = encode(q, hashing_encoder(64), "query_id", "query_text", dim=32, prefix="query: ")
    # a text has the vector of the same text, and no other
    same = F.count(F.lit(1)).over(Window.partitionBy("emb"))
    return t.select(F.col("id").alias("query_id"), F.size("emb").alias("d"), F.round(vec.norm(F.col("emb")), 4).alias("norm"), same.alias("n_same"))


def _baseline(kind: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = _rows(spark, d)
        t = rows.where("id % 10 <> 0")
        corpus = t.select("label", "id", F.col("y").alias("emb")) if kind == "student" else None
        m = B.train(t, kind, epochs=20, corpus=corpus)
        return _quality(spark, d, B.predict(rows.where("id % 10 = 0").select(F.col("id").alias("query_id"), "x"), m, kind))

    query.__doc__ = f"Quality of the encoder {kind!r}."
    return query


QUERIES = {f.__name__: f for f in (h12_blocks, h14_distances, h14_combination, h15_block_minimum, h16_weights, h17_soft, h17_hard, h19_gate, h21_tuning, h22_refinement, h24_classifier, h25_adapter, e20_margins, h23_family, h6_index, h7_encode)}
QUERIES |= {"h28_ridge": _baseline("ridge"), "h29_logistic": _baseline("logistic_proto"), "h30_mlp": _baseline("mlp"), "h30_mlp_proto": _baseline("mlp_proto"), "h31_student": _baseline("student")}

_D = """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
p AS (SELECT q.vec_id AS query_id, CAST(c.label AS VARCHAR) AS label, CAST(c.vec_id % 4 AS INTEGER) AS cluster, list_dot_product(q.v, c.v) AS dot, greatest(list_dot_product(q.v, q.v) + list_dot_product(c.v, c.v) - 2 * dot, 0) AS sq
  FROM e q, e c WHERE q.vec_id % 10 = 0 AND c.vec_id % 10 <> 0),
d AS (SELECT query_id, label, cluster, min(round(sqrt((1 - exp(-sqrt(sq))) ** 2 + (acos(greatest(-1, least(1, dot))) / 3.141592653589793) ** 2) / sqrt(2), 9)) AS d FROM p GROUP BY ALL)"""

ORACLE = {
    "h7_encode": "SELECT query_id, 32 AS d, 1.0::DOUBLE AS norm, count(*) OVER (PARTITION BY lower(query_text)) AS n_same FROM test WHERE query_text IS NOT NULL",
    "h14_combination": "WITH t AS (SELECT event_id, 1 - exp(-abs(value) / 10) AS a, CAST(event_id % 100 AS DOUBLE) / 100 AS b FROM events) SELECT event_id, round(sqrt(a * a + b * b) / sqrt(2), 6) AS folding, round(a * b, 6) AS product, round(least(a, b), 6) AS minimum, round(greatest(a, b), 6) AS maximum, round(b, 6) AS cosine FROM t",
    "h15_block_minimum": _D + " SELECT query_id, label, cluster, round(d, 6) AS d FROM d",
    "h16_weights": _D + ", s AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY query_id, label ORDER BY greatest(0, least(1, 1 - d)) ** 10 DESC, cluster) <= 2 THEN greatest(0, least(1, 1 - d)) ** 10 ELSE 0 END AS s FROM d), t AS (SELECT *, sum(s) OVER w AS total, count(*) OVER w AS m FROM s WINDOW w AS (PARTITION BY query_id, label)) SELECT query_id, label, cluster, round(CASE WHEN total <= 1e-12 THEN 1.0 / m ELSE s / total END, 6) AS p FROM t",
    "h19_gate": _D + ", b AS (SELECT query_id, label, min(d) AS d FROM d GROUP BY ALL) SELECT query_id, label, round(d, 6) AS d FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY b.d, label) = 1",
}
