"""Vector expressions over array<float> columns, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-12


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    """The inner product; null if a length differs."""
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def unit(v: Column, eps: float = EPS) -> Column:
    """Divided by the norm, or by eps if that is larger: a zero vector stays zero."""
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm(v), F.lit(eps)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(EPS)) * F.greatest(norm(b), F.lit(EPS)))


def squared_distance(a: Column, b: Column) -> Column:
    """|a|^2 + |b|^2 - 2ab; rounding may leave it slightly below zero."""
    return dot(a, a) + dot(b, b) - 2 * dot(a, b)


def fix_dimension(v: Column, d: int) -> Column:
    """The first d elements; an error if there are fewer."""
    return F.when(F.size(v) >= d, F.slice(v, 1, d)).otherwise(F.raise_error(F.concat(F.lit(f"a vector of {d} elements or more is wanted, not of "), F.size(v).cast("string"))))


def as_float(v: Column) -> Column:
    return v.cast("array<float>")


def mean_pool(states: Column, mask: Column, d: int) -> Column:
    """The mean of the states (array of vectors) that the mask keeps; divided by 1e-9 at least."""
    kept = _sum(F.transform(mask, lambda m: m.cast("double")))
    zero = F.array_repeat(F.lit(0.0), d)
    total = F.aggregate(F.zip_with(states, mask, lambda s, m: F.transform(s, lambda x: x * m)), zero, lambda acc, s: F.zip_with(acc, s, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.greatest(kept, F.lit(1e-9)))


def unit_norms(df: DataFrame, vec_col: str) -> DataFrame:
    """(p10, p50, p90, is_unit): whether the vectors look as if they were normalised."""
    q = df.agg(F.percentile(norm(F.col(vec_col)), F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"))
    p10, p50, p90 = (F.col("q")[i] for i in range(3))
    return q.select(p10.alias("p10"), p50.alias("p50"), p90.alias("p90"), (p50.between(0.9, 1.1) & (p10 >= 0.8) & (p90 <= 1.2)).alias("is_unit"))


def embedding_metrics(pairs: DataFrame, predicted: str, target: str) -> DataFrame:
    """(mse, r2, cos_mean, cos_p10, cos_p50, cos_p90) over rows of predicted and target vectors.

    The error is the mean over all elements, R2 is against the one mean of all target elements.
    """
    y, p = F.col(target), F.col(predicted)
    rows = pairs.select(
        F.size(y).alias("n"),
        _sum(F.transform(y, lambda x: x.cast("double"))).alias("s"),
        dot(y, y).alias("ss"),
        _sum(F.zip_with(p, y, lambda a, b: F.pow(a.cast("double") - b.cast("double"), F.lit(2)))).alias("sse"),
        cosine(p, y).alias("cos"),
    )
    t = rows.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum("sse").alias("sse"), F.avg("cos").alias("cos_mean"), F.percentile("cos", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"))
    return t.select(
        F.try_divide("sse", "n").alias("mse"),
        (1 - F.col("sse") / F.greatest(F.col("ss") - F.try_divide(F.col("s") * F.col("s"), F.col("n")), F.lit(EPS))).alias("r2"),
        "cos_mean",
        F.col("q")[0].alias("cos_p10"),
        F.col("q")[1].alias("cos_p50"),
        F.col("q")[2].alias("cos_p90"),
    )
