"""Per-key results over keys of which a few hold most rows.

Value-frequency compression: rows are first counted by (key, value), a grouping that is
combined before its shuffle and whose groups stay small however hot a key is. Every per-key
result is then derived from the weighted values: row counts, exact distinct counts, modes,
and exact interpolated percentiles by a two-level prefix sum over range-partitioned slices,
so that no key is ever sorted or collected by one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.session import materialize, tasks


def frequency_table(df: DataFrame, key: Column | str, value: Column | str) -> DataFrame:
    """(key, value, weight): how often each value occurs under each key. Nulls are values."""
    k = F.col(key) if isinstance(key, str) else key
    v = F.col(value) if isinstance(value, str) else value
    return df.groupBy(k.alias("key"), v.alias("value")).agg(F.count(F.lit(1)).alias("weight"))


def key_totals(freq: DataFrame) -> DataFrame:
    """Per key: rows, rows with a value, exact distinct values and the mode.

    The mode is the most frequent non-null value, of equally frequent ones the smallest;
    it is null where a key has no value.
    """
    present = F.col("value").isNotNull()
    return freq.groupBy("key").agg(
        F.sum("weight").alias("n_rows"),
        F.coalesce(F.sum(F.when(present, F.col("weight"))), F.lit(0)).cast("long").alias("n_values"),
        F.count("value").alias("n_distinct"),
        F.expr("min_by(value, IF(value IS NULL, NULL, struct(-weight AS w, value AS v)))").alias("mode"),
    )


def key_percentiles(freq: DataFrame, quantiles: Sequence[float], slices: int | None = None) -> DataFrame:
    """(key, q0, q1, ...): exact percentiles, linearly interpolated, of numeric values.

    The frequency table is range-partitioned by (key, value): a hot key spreads over as many
    slices as its distinct values need. Only slice totals are summed per key, at most one row
    per slice, and only the slices that hold a wanted rank are scanned again.
    """
    spark = freq.sparkSession
    q = [float(x) for x in quantiles]
    if any(not 0 <= x <= 1 for x in q):
        raise ValueError("quantiles must lie in [0, 1]")
    whole = (
        freq.where(F.col("value").isNotNull())
        .repartitionByRange(slices or tasks(spark), "key", "value")
        .withColumn("slice", F.spark_partition_id())
    )
    whole = materialize(whole, "freq-slices")
    parts = whole.groupBy("key", "slice").agg(F.sum("weight").alias("held"))
    by_key = Window.partitionBy("key")
    before = by_key.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "key",
        "slice",
        "held",
        F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"),
        F.sum("held").over(by_key).alias("total"),
    )
    wanted = F.explode(
        F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x).alias("p"), F.lit(side).alias("side")) for i, x in enumerate(q) for side in ("lo", "hi")])
    )
    ranks = parts.select("key", "slice", "held", "offset", "total", wanted.alias("w")).select(
        "key",
        "slice",
        "held",
        "offset",
        F.col("w.i").alias("i"),
        F.col("w.side").alias("side"),
        ((F.col("total") - 1) * F.col("w.p")).alias("at"),
    )
    rank = F.when(F.col("side") == "lo", F.floor("at")).otherwise(F.ceil("at"))
    ranks = (
        ranks.withColumn("rank", rank)
        .where((F.col("offset") <= F.col("rank")) & (F.col("rank") < F.col("offset") + F.col("held")))
        .groupBy("key", "slice", "offset")
        .agg(F.collect_list(F.struct("i", "side", "at", "rank")).alias("wants"))
    )
    inside = Window.partitionBy("key", "slice").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    r, w = ranks.alias("r"), whole.alias("w")
    hit = (
        w.join(r, F.col("w.key").eqNullSafe(F.col("r.key")) & (F.col("w.slice") == F.col("r.slice")))
        .select("w.key", "w.slice", "w.value", "w.weight", "r.offset", "r.wants")
        .withColumn("upto", F.sum("weight").over(inside) + F.col("offset"))
        .withColumn("wants", F.expr("filter(wants, x -> upto - weight <= x.rank AND x.rank < upto)"))
        .select("key", "value", F.explode("wants").alias("x"))
    )
    cols = []
    for i, _ in enumerate(q):
        at = lambda side: F.max(F.when((F.col("x.i") == i) & (F.col("x.side") == side), F.col("value").cast("double")))  # noqa: B023, E731
        pos = F.max(F.when(F.col("x.i") == i, F.col("x.at")))
        cols.append((at("lo") + (at("hi") - at("lo")) * (pos - F.floor(pos))).alias(f"q{i}"))
    return hit.groupBy("key").agg(*cols)


def key_profile(df: DataFrame, key: str, values: Sequence[str], quantiles: Sequence[float] = ()) -> DataFrame:
    """One row per key (a null key is a key): n_rows and, for each value column v, v_values,
    v_distinct, v_mode and, for numeric ones, v_q0, v_q1, ... (see `key_percentiles`).

    Extra columns of `df` are ignored. An empty input gives an empty result. A key whose
    values are all null gets 0 distinct values, a null mode and null percentiles.
    """
    out = None
    for v in values:
        freq = frequency_table(df, key, v)
        numeric = bool(quantiles) and isinstance(df.schema[v].dataType, T.NumericType)
        if numeric:
            freq = materialize(freq, "freq")
        t = key_totals(freq).select(
            "key",
            "n_rows",
            F.col("n_values").alias(f"{v}_values"),
            F.col("n_distinct").alias(f"{v}_distinct"),
            F.col("mode").alias(f"{v}_mode"),
        )
        if numeric:
            p = key_percentiles(freq, quantiles)
            p = p.select(F.col("key").alias("k2"), *[F.col(f"q{i}").alias(f"{v}_q{i}") for i in range(len(quantiles))])
            t = t.join(p, t["key"].eqNullSafe(p["k2"]), "left").drop("k2")
        if out is None:
            out = t
        else:
            t = t.drop("n_rows").withColumnRenamed("key", "k3")
            out = out.join(t, out["key"].eqNullSafe(t["k3"]), "left").drop("k3")
    if out is None:
        out = df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n_rows"))
    return out.withColumnRenamed("key", key)


def heavy_keys(df: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """(key, n_rows): the non-null keys that hold at least `share` of all rows of `df`.

    Null keys count in the total. Counts come from the (key, value) frequencies, so that the
    hottest key costs no more than its distinct values. An empty table has no heavy key.
    """
    part = Fraction(str(share))
    totals = key_totals(frequency_table(df, key, value)).select("key", "n_rows")
    all_rows = totals.agg(F.sum("n_rows").alias("all_rows"))
    return (
        totals.crossJoin(F.broadcast(all_rows))  # one row
        .where(F.col("key").isNotNull() & (F.col("n_rows") * part.denominator >= F.col("all_rows") * part.numerator))
        .select(F.col("key").alias(key), "n_rows")
    )
