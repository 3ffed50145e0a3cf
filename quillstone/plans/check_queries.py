"""Queries of small operators that others are built on, so that each has a result of its own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import vec
from quillstone.operators import passages as P
from quillstone.operators import retrieval as T
from quillstone.session import shared_dir
from quillstone.sources import loaders
from quillstone.sources.tables import table


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quillstone/{name}-{uuid.uuid4().hex}"


def c3_cosine(spark: SparkSession, d: str) -> DataFrame:
    """The cosine of each vector with the first one of its label."""
    e = table(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    return e.join(first, "label").select("vec_id", F.round(vec.cosine(F.col("embedding"), F.col("first")), 6).alias("cos"))


def c5_least(spark: SparkSession, d: str) -> DataFrame:
    """The least squared distance of each vector to another one, by exact search in blocks."""
    e = table(spark, d, "embeddings")
    other = T.nearest_other(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("x")))
    a, b = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("a")), e.select(F.col("vec_id").alias("other"), F.col("embedding").alias("b"))
    return other.join(a, "id").join(b, "other").select(F.col("id").alias("vec_id"), F.round(F.greatest(vec.squared_distance(F.col("a"), F.col("b")), F.lit(0.0)), 5).alias("least"))


def c6_kernel(spark: SparkSession, d: str) -> DataFrame:
    """The Gaussian kernel of each vector and the first one of its label, in the plain metric."""
    e = table(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    sq = F.greatest(vec.squared_distance(F.col("embedding"), F.col("first")), F.lit(0.0))
    return e.join(first, "label").select("vec_id", F.round(F.exp(-0.5 / F.size("embedding") * sq), 6).alias("k"))


def c10_pool(spark: SparkSession, d: str) -> DataFrame:
    """The mean of three of the first four pairs of elements, each pair a state."""
    v = F.col("embedding")
    states = F.array(*[F.transform(F.slice(v, 2 * i + 1, 2), lambda x: x.cast("double")) for i in range(4)])
    mask = F.array(*map(F.lit, (1, 0, 1, 1)))
    pooled = vec.mean_pool(states, mask, 2)
    return table(spark, d, "embeddings").select("vec_id", F.round(pooled[0], 6).alias("a"), F.round(pooled[1], 6).alias("b"))


def c11_float(spark: SparkSession, d: str) -> DataFrame:
    """Thirds of values in single precision."""
    return table(spark, d, "events").select("event_id", vec.as_float(F.array(F.col("value") / 3))[0].cast("double").alias("third"))


def b18_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents from page blocks that hold them from the last to the first, in reading order again."""
    t = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("doc"), F.lit(1).alias("page"), F.split("text", "\n").alias("ls"))
    line = lambda s, i: F.struct(F.array(F.lit(50.0), i * 10.0, F.lit(500.0), i * 10.0 + 9).alias("bbox"), F.array(s).alias("spans"))
    blocks = F.array(F.struct(F.lit(0).alias("type"), F.reverse(F.transform("ls", line)).alias("lines")))
    got = P.layout_lines(t.select("doc", "page", blocks.alias("blocks")))
    return got.select(F.col("doc").alias("doc_id"), "line", F.md5("text").alias("digest"))


def a12_sinks(spark: SparkSession, d: str) -> DataFrame:
    """Crawl results written as JSON lines and as CSV, read again."""
    t = table(spark, d, "download_report").select("law", "ok")
    lines, comma = _folder(spark, "json"), _folder(spark, "csv")
    loaders.write_json_lines(t, lines)
    loaders.write_csv(t, comma)
    back = spark.read.schema(t.schema).json(lines).withColumn("sink", F.lit("json")).unionByName(spark.read.schema(t.schema).option("header", True).csv(comma).withColumn("sink", F.lit("csv")))
    return back.groupBy("sink", "ok").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("law").alias("laws"))


def a13_verified(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written beside their place, counted, put in place and read again."""
    path = _folder(spark, "verified")
    n = loaders.write_verified(table(spark, d, "embeddings").select("vec_id", "label"), path)
    return spark.read.parquet(path).withColumn("n", F.lit(n).cast("long"))


def a15_model(spark: SparkSession, d: str) -> DataFrame:
    """A model of two tables, saved and loaded."""
    path = _folder(spark, "model")
    e = table(spark, d, "embeddings")
    loaders.save_model({"labels": e.select("label").distinct(), "sizes": e.groupBy("label").agg(F.count(F.lit(1)).alias("n"))}, path)
    m = loaders.load_model(spark, path, ("labels", "sizes"))
    return m["labels"].join(m["sizes"], "label")


QUERIES = {f.__name__: f for f in (c3_cosine, c5_least, c6_kernel, c10_pool, c11_float, b18_lines, a12_sinks, a13_verified, a15_model)}

_V = "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), f AS (SELECT label, arg_min(e, vec_id) AS f FROM v GROUP BY 1)"

ORACLE = {
    "c3_cosine": _V + " SELECT vec_id, round(list_dot_product(e, f) / sqrt(list_dot_product(e, e) * list_dot_product(f, f)), 6) AS cos FROM v JOIN f USING (label)",
    "c5_least": _V + " SELECT a.vec_id, round(greatest(min(list_dot_product(a.e, a.e) + list_dot_product(b.e, b.e) - 2 * list_dot_product(a.e, b.e)), 0), 5) AS least FROM v a JOIN v b ON a.vec_id <> b.vec_id GROUP BY 1",
    "c6_kernel": _V + " SELECT vec_id, round(exp(-0.5 / len(e) * greatest(list_dot_product(e, e) + list_dot_product(f, f) - 2 * list_dot_product(e, f), 0)), 6) AS k FROM v JOIN f USING (label)",
    "c10_pool": _V + " SELECT vec_id, round((e[1] + e[5] + e[7]) / 3, 6) AS a, round((e[2] + e[6] + e[8]) / 3, 6) AS b FROM v",
    "c11_float": "SELECT event_id, CAST(CAST(value / 3 AS FLOAT) AS DOUBLE) AS third FROM events",
    "b18_lines": r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id, i, regexp_replace(s, '^[\s\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x{1c}-\x{1f}\x{85}\p{Z}]+$', '', 'g') AS s FROM l) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS line, md5(s) AS digest FROM t WHERE s <> ''",
    "a12_sinks": "SELECT sink, ok, count(*) AS n, count(DISTINCT law) AS laws FROM download_report, (SELECT unnest(['json', 'csv']) AS sink) GROUP BY 1, 2",
    "a13_verified": "SELECT vec_id, label, (SELECT count(*) FROM embeddings) AS n FROM embeddings",
    "a15_model": "SELECT label, count(*) AS n FROM embeddings GROUP BY 1",
}
