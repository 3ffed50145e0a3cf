"""Bootstrap confidence intervals.

Two modes. "portable" draws come from md5 of seed, replicate and position, so that any engine
can repeat them; they are joined with the rows and summed per replicate, all distributed. "numpy"
draws come from numpy's generator with the given seed, in one task for each group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.order import numbered

LOW, HIGH = 0.025, 0.975


def draws(n: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """(b, i): for every replicate, as many positions as the one row of `n` (column n) says."""
    t = n.where("n > 0").select("n", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b"))
    t = t.select("n", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j"))
    text = F.concat_ws("|", F.lit(str(seed)), F.col("b").cast("string"), F.col("j").cast("string"))
    return t.select("b", (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % F.col("n")).alias("i"))


def replicates(df: DataFrame, order: Sequence[str], sums: dict[str, Column], n_boot: int, seed: int) -> DataFrame:
    """(b, *sums): sums over the drawn rows of each replicate. Rows are numbered in the order of the columns `order`."""
    rows = numbered(df.select(*order, *[c.cast("double").alias(s) for s, c in sums.items()]), order, "i").drop(*order)
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    return draws(n, n_boot, seed).join(rows, "i").groupBy("b").agg(F.count(F.lit(1)).alias("n"), *[F.sum(s).alias(s) for s in sums])


def interval(reps: DataFrame, value: Column, point: DataFrame, digits: int = 6) -> DataFrame:
    """(pt, lo, hi): the point estimate (one row, column pt) with the 2.5 and 97.5 percentiles of the replicates; null replicates are left out."""
    q = reps.select(value.alias("v")).where(F.col("v").isNotNull()).agg(F.percentile("v", F.array(F.lit(LOW), F.lit(HIGH))).alias("q"))
    return point.crossJoin(q).select(F.round("pt", digits).alias("pt"), F.round(F.col("q")[0], digits).alias("lo"), F.round(F.col("q")[1], digits).alias("hi"))  # one row each


def mean_ci(df: DataFrame, value: Column, order: Sequence[str], n_boot: int = 200, seed: int = 0) -> DataFrame:
    """(pt, lo, hi) of a mean. No rows: nulls."""
    r = replicates(df, order, {"s": value}, n_boot, seed)
    return interval(r, F.col("s") / F.col("n"), df.agg(F.avg(value.cast("double")).alias("pt")))


def paired_delta_ci(a: DataFrame, b: DataFrame, key: str, value: str, n_boot: int = 200, seed: int = 0) -> DataFrame:
    """(pt, lo, hi) of the mean of a - b over common keys."""
    t = a.select(key, F.col(value).alias("va")).join(b.select(key, F.col(value).alias("vb")), key)
    return mean_ci(t, F.col("va") - F.col("vb"), [key], n_boot, seed)


def macro_mean_ci(df: DataFrame, value: Column, group: str, n_boot: int = 200, seed: int = 0) -> DataFrame:
    """(pt, lo, hi) of the mean of group means; groups are resampled."""
    return mean_ci(df.groupBy(group).agg(F.avg(value).alias("m")), F.col("m"), [group], n_boot, seed)


def macro_paired_delta_ci(a: DataFrame, b: DataFrame, key: str, value: str, group: str, n_boot: int = 200, seed: int = 0) -> DataFrame:
    t = a.select(key, group, F.col(value).alias("va")).join(b.select(key, F.col(value).alias("vb")), key)
    return macro_mean_ci(t, F.col("va") - F.col("vb"), group, n_boot, seed)


def ratio_ci(df: DataFrame, top: Column, bottom: Column, order: Sequence[str], n_boot: int = 200, seed: int = 0) -> DataFrame:
    """(pt, lo, hi) of a ratio of sums; replicates whose lower sum is 0 are left out."""
    r = replicates(df, order, {"t": top, "u": bottom}, n_boot, seed)
    return interval(r, F.try_divide("t", "u"), df.agg(F.try_divide(F.sum(top.cast("double")), F.sum(bottom.cast("double"))).alias("pt")))


def decomposition_ci(a: DataFrame, b: DataFrame, key: str, tau: float, n_boot: int = 200, seed: int = 0) -> DataFrame:
    """(part, pt, lo, hi) of the accuracy difference, its coverage part and its precision part at tau.

    Both methods use the same draws. a and b have maj_frac and maj_correct per key.
    """
    cov = lambda c: (F.col(c) >= tau).cast("double")
    pick = lambda t, s: t.select(key, cov("maj_frac").alias(f"c{s}"), (cov("maj_frac") * F.col("maj_correct")).alias(f"a{s}"))
    t = pick(a, "a").join(pick(b, "b"), key)
    sums = {c: F.col(c) for c in ("ca", "aa", "cb", "ab")}
    r = replicates(t, [key], sums, n_boot, seed)
    whole = t.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums])
    m = {c: F.col(c) / F.col("n") for c in sums}
    pa, pb = (F.coalesce(F.try_divide(F.col(f"a{s}"), F.col(f"c{s}")), F.lit(0.0)) for s in "ab")
    parts = {"accuracy": m["aa"] - m["ab"], "coverage": (m["ca"] - m["cb"]) * (pa + pb) / 2, "precision": (pa - pb) * (m["ca"] + m["cb"]) / 2}
    out = None
    for name, v in parts.items():
        ci = interval(r, v, whole.select(v.alias("pt"))).select(F.lit(name).alias("part"), "pt", "lo", "hi")
        out = ci if out is None else out.unionByName(ci)
    return out


def numpy_ci(df: DataFrame, keys: Sequence[str], value: str, order: str, n_boot: int = 200, seed: int = 0) -> DataFrame:
    """(*keys, pt, lo, hi) of means with numpy's generator, the same seed for each group."""
    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", pt double, lo double, hi double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[value].to_numpy(float)
        rng = np.random.default_rng(seed)
        means = np.array([x[rng.integers(0, len(x), len(x))].mean() for _ in range(n_boot)])
        lo, hi = np.quantile(means, [LOW, HIGH])
        return pdf[list(keys)].iloc[:1].assign(pt=x.mean(), lo=lo, hi=hi)

    return df.where(F.col(value).isNotNull()).groupBy(*keys).applyInPandas(run, schema)
