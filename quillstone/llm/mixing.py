"""Mixtures of sources that meet target weights by size.

Temperature mixing raises shares to an exponent, found by bisection, that gives the mixture a wanted
entropy or keeps every source within its repetitions. Where target weights are given, each source first
gets its weight as far as its repetitions allow. What is then missing goes to sources that can give
more, by their token shares raised to the exponent that brings the entropy of the whole mixture
nearest to that of the targets. Weights are realised as budgeted block permutations: each pass over a
source is a permutation of its blocks, and of the records in them, by a hash; the last pass stops in
the block where the budget ends. Only sums of blocks are ever ordered, in groups of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.session import materialize

BLOCK_ROWS = 1024
MOST_SOURCES = 10_000  # of a target table


def source_name(c: Column | str) -> Column:
    """Sources are compared trimmed and lower-cased."""
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))


def entropy(p: list[float]) -> float:
    return -sum(x * math.log(x) for x in p if x > 0)


def tempered(shares: list[float], exponent: float) -> list[float]:
    """Shares raised to the exponent and normalised; a share of 0 stays 0."""
    raised = [s**exponent if s > 0 else 0.0 for s in shares]
    total = sum(raised)
    return [r / total for r in raised] if total else raised


def find_exponent(shares: list[float], wanted_entropy: float | None = None, limits: list[float] | None = None, steps: int = 60) -> float:
    """The exponent in [0, 1] (0: even, 1: natural shares) that meets the entropy, or the smallest
    that keeps every tempered share within its limit. Out of reach: the nearer end."""
    def too_even(e: float) -> bool:
        p = tempered(shares, e)
        if limits is not None and any(x > m * (1 + 1e-12) for x, m in zip(p, limits)):
            return True
        return wanted_entropy is not None and entropy(p) > wanted_entropy

    lo, hi = 0.0, 1.0
    if not too_even(lo):
        return lo
    if too_even(hi):
        return hi
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if too_even(mid) else (lo, mid)
    return hi


def nearest_exponent(mixture: Callable[[float], list[float]], wanted: float, steps: int = 40) -> float:
    """The exponent in [0, 1] for which the entropy of mixture(exponent) is nearest to the wanted one.

    Between two points of a grid where the entropy crosses it, bisection; where it never does, the nearest point.
    """
    grid = [i / 16 for i in range(17)]
    off = [entropy(mixture(e)) - wanted for e in grid]
    for lo, hi, a, b in zip(grid, grid[1:], off, off[1:]):
        if a * b < 0:
            for _ in range(steps):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if (entropy(mixture(mid)) - wanted) * a > 0 else (lo, mid)
            return hi
    return min(zip((abs(x) for x in off), grid))[1]


def fit_weights(sizes: Mapping[str, int], targets: Mapping[str, tuple[float, float]], budget: float | None = None) -> dict[str, float]:
    """Tokens that each source gives to a mixture of `budget` tokens (default: all tokens of the sources).

    targets: source -> (weight, most repetitions). No source gives more than its size times its
    repetitions; if all are exhausted, the mixture is smaller than the budget.
    """
    names = sorted(targets)
    size = {n: int(sizes.get(n, 0)) for n in names}
    total = sum(size.values())
    budget = float(total) if budget is None else float(budget)
    weights = {n: max(0.0, targets[n][0] or 0.0) for n in names}
    sum_w = sum(weights.values())
    most = {n: size[n] * max(0.0, targets[n][1] or 0.0) for n in names}
    if not total or not budget or not sum_w:
        return {n: 0.0 for n in names}
    given = {n: min(weights[n] / sum_w * budget, most[n]) for n in names}
    wanted = entropy([weights[n] / sum_w for n in names])
    for _ in range(4 * len(names)):  # each round exhausts the rest or a source
        rest = budget - sum(given.values())
        free = [n for n in names if weights[n] > 0 and most[n] - given[n] > 1e-9 * budget]
        if rest <= 1e-9 * budget or not free:
            break
        shares = [size[n] / sum(size[f] for f in free) for n in free]

        def mixture(e: float) -> list[float]:
            more = dict(zip(free, tempered(shares, e)))
            return [(given[n] + rest * more.get(n, 0.0)) / budget for n in names]

        for n, p in zip(free, tempered(shares, nearest_exponent(mixture, wanted))):
            given[n] = min(most[n], given[n] + rest * p)
    return given


def temperature_targets(sizes: DataFrame, wanted_entropy: float | None = None) -> DataFrame:
    """The rows of `sizes` (source, weight, max_repeats, size) with weights by temperature alone: the size
    shares raised to the exponent that gives the wanted entropy (default: that of the weights in
    `sizes`) and lets a mixture of the total size keep all repetitions."""
    rows = sorted(sizes.limit(MOST_SOURCES + 1).collect(), key=lambda r: r["source"])  # one for each row of the target table
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} target sources")
    total = sum(r["size"] for r in rows)
    weights = [max(0.0, r["weight"]) for r in rows]
    if wanted_entropy is None:
        wanted_entropy = entropy([w / sum(weights) for w in weights]) if sum(weights) else 0.0
    shares = [r["size"] / total if total else 0.0 for r in rows]
    e = find_exponent(shares, wanted_entropy, [s * r["max_repeats"] for s, r in zip(shares, rows)])
    out = [(r["source"], p, r["max_repeats"], r["size"]) for r, p in zip(rows, tempered(shares, e))]
    return sizes.sparkSession.createDataFrame(out, "source string, weight double, max_repeats int, size long")


def source_sizes(docs: DataFrame, targets: DataFrame, size: Column, source_col: str = "source") -> DataFrame:
    """(source, weight, max_repeats, size): one row for each source of `targets`, named as in `source_name`.

    Rows of `targets` with the same name add their weights and keep the largest number of repetitions;
    null names, weights or repetitions count as no target, 0 and 0.
    """
    t = targets.select(source_name("source").alias("source"), "weight", "max_repeats").where("source IS NOT NULL")
    t = t.groupBy("source").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight"), F.coalesce(F.max("max_repeats"), F.lit(0)).cast("int").alias("max_repeats"))
    s = docs.groupBy(source_name(source_col).alias("source")).agg(F.sum(size).alias("size"))
    return t.join(s, "source", "left").select("source", "weight", "max_repeats", F.coalesce("size", F.lit(0)).cast("long").alias("size"))


def mix_plan(sizes: DataFrame, budget: float | None = None) -> DataFrame:
    """`sizes` with what each source gives (planned, in tokens) and whether its repetitions hold it below its weight (held)."""
    rows = sizes.limit(MOST_SOURCES + 1).collect()  # one for each row of the target table
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} target sources")
    given = fit_weights({r["source"]: r["size"] for r in rows}, {r["source"]: (r["weight"], r["max_repeats"]) for r in rows}, budget)
    full = {r["source"]: r["size"] * max(0, r["max_repeats"]) for r in rows}
    out = [(r["source"], r["weight"], r["max_repeats"], r["size"], float(given[r["source"]]), given[r["source"]] >= full[r["source"]] * (1 - 1e-9)) for r in rows]
    return sizes.sparkSession.createDataFrame(out, "source string, weight double, max_repeats int, size long, planned double, held boolean")


def out_of_reach(plan: DataFrame) -> DataFrame:
    """(source): of the sources that the plan of a mixture of all tokens repeats as often as allowed, those whose weight asks for
    more than that (an exact check)."""
    total = plan.agg(F.sum("size").alias("total"))
    return plan.where("held").crossJoin(F.broadcast(total)).where(F.col("size") * F.col("max_repeats") < F.col("weight") * F.col("total")).select("source")  # total: one row


def mix(docs: DataFrame, sizes: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source", budget: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The mixture (id, source, copy, block, nth, at, tokens) and the plan (source, weight, max_repeats, size, planned, held).

    copy numbers the passes over a source from 1. Ordered by (copy, nth, at) the records of a source are
    in the order of the mixture: nth is the place of their block in the pass, `at` orders them within it.
    Records of size 0, or of a source that is no target, are not mixed. A source falls short of its plan by
    less than its largest record.
    """
    plan = mix_plan(sizes, budget)
    d = docs.select(F.col(id_col).alias("id"), source_name(source_col).alias("source"), size.alias("tokens")).where("tokens > 0")
    live = plan.where("size > 0 AND planned > 0").select("source", F.floor(F.col("planned") / F.col("size")).cast("int").alias("full"), (F.col("planned") - F.floor(F.col("planned") / F.col("size")) * F.col("size")).alias("rest"))
    d = d.join(F.broadcast(live), "source")  # at most MOST_SOURCES rows
    d = materialize(d, "mix-records")  # texts are read once
    counts = d.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks"))  # at most as many
    d = materialize(d.join(F.broadcast(counts), "source").withColumn("block", F.pmod(F.xxhash64("id", "tokens"), F.col("blocks")).cast("int")).drop("blocks"), "mix-blocks")
    # blocks in the order of a hash for each pass; ranges of the hash make groups of about BLOCK_ROWS blocks, so that
    # neither the groups of a source nor the blocks of a group are many
    sums = d.groupBy("source", "block", "full", "rest").agg(F.sum("tokens").alias("held"))
    sums = sums.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("full") + 1)))
    sums = sums.withColumn("key", F.pmod(F.xxhash64("source", "block", "copy"), F.lit(1 << 40)))
    groups = counts.select("source", F.ceil(F.col("blocks") / BLOCK_ROWS).alias("groups"))
    sums = sums.join(F.broadcast(groups), "source").withColumn("group", F.floor(F.col("key") * F.col("groups") / F.lit(float(1 << 40))))
    of_group = sums.groupBy("source", "copy", "group").agg(F.sum("held").alias("g_held"), F.count(F.lit(1)).alias("g_blocks"))
    earlier = Window.partitionBy("source", "copy").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    of_group = of_group.select("source", "copy", "group", F.coalesce(F.sum("g_held").over(earlier), F.lit(0)).alias("g_before"), F.coalesce(F.sum("g_blocks").over(earlier), F.lit(0)).alias("g_nth"))
    inner = Window.partitionBy("source", "copy", "group").orderBy("key", "block")
    before = F.col("g_before") + F.coalesce(F.sum("held").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.join(of_group, ["source", "copy", "group"]).select("source", "block", "copy", "full", "rest", "held", before.alias("before"), (F.col("g_nth") + F.row_number().over(inner)).alias("nth"))
    partial = F.col("copy") > F.col("full")  # the last pass: whole blocks while they fit, then a part of one
    cut = sums.where(~partial | (F.col("before") < F.col("rest"))).select("source", "block", "copy", "before", "nth", (partial & (F.col("before") + F.col("held") > F.col("rest"))).alias("edge"))
    d = d.join(cut, ["source", "block"]).withColumn("at", F.xxhash64("id", "tokens", "copy"))
    upto = Window.partitionBy("source", "block").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    edge = d.where("edge").withColumn("upto", F.col("before") + F.sum("tokens").over(upto)).where(F.col("upto") <= F.col("rest")).drop("upto")  # one block of each source
    mixed = d.where("NOT edge").unionByName(edge)
    return mixed.select("id", "source", "copy", "block", "nth", "at", "tokens"), plan


def mix_report(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """For each target source: its weight, size, planned and actual tokens, actual share and repetitions."""
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("actual"), F.max("copy").alias("most_copies"))
    t = plan.join(got, "source", "left").na.fill({"actual": 0, "most_copies": 0})
    total = t.agg(F.sum("actual").alias("all_tokens"))
    return t.crossJoin(F.broadcast(total)).select(
        "source",
        "weight",
        "max_repeats",
        "size",
        F.round("planned", 3).alias("planned"),
        "actual",
        F.round(F.try_divide("actual", "all_tokens"), 6).alias("share"),
        "most_copies",
        F.round(F.try_divide("actual", "size"), 6).alias("repeats"),
    )
