"""Label-level metrics of ranked lists.

The input of everything here is one long table ranked(query_id, rank, label, gold, ...), with a
column `method` where methods are compared. Lists may be shorter than k; shares are of the actual length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("hit", "top1", "majority", "cons_frac", "lift", "mrr")


def prior(corpus: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, prior): how often each label occurs, and its share."""
    n = corpus.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("label", "n", (F.col("n") / F.col("total")).alias("prior"))  # total: one row


def per_query(ranked: DataFrame, priors: DataFrame, ks: Sequence[int], tau: float = 0.1, keys: Sequence[str] = ()) -> DataFrame:
    """One row for each (k, *keys, query_id): all metrics and vote diagnostics of its first k ranks.

    keys name further columns, such as the method. A query without any hit has no list and no row.
    The majority label is the most frequent one, of equally frequent ones the one ranked first.
    """
    keys = list(keys)
    at = ranked.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks]))).where(F.col("rank") <= F.col("k"))
    lc = at.groupBy("k", *keys, "query_id", "gold", "label").agg(F.count(F.lit(1)).alias("cnt"), F.min("rank").alias("fr"))
    own = F.col("label") == F.col("gold")
    q = lc.groupBy("k", *keys, "query_id", "gold").agg(
        F.sum("cnt").alias("n"),
        F.count(F.lit(1)).alias("n_unique"),
        F.max_by("label", F.struct("cnt", -F.col("fr"))).alias("maj_label"),
        F.sort_array(F.collect_list("cnt"), False).alias("cnts"),
        F.collect_list("fr").alias("frs"),
        F.max(F.when(own, F.col("cnt"))).alias("gold_cnt"),
        F.max(F.when(own, F.col("fr"))).alias("gold_fr"),
    )
    p = priors.select(F.col("label").alias("gold"), "prior")
    q = q.join(p, "gold", "left")  # the label table is small or not: Catalyst decides by its size
    n = F.col("n").cast("double")
    frac = lambda c: F.coalesce(c, F.lit(0)) / n
    maj_frac = F.col("cnts")[0] / n
    one = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    cons = frac(F.col("gold_cnt"))
    before = F.size(F.expr("filter(frs, x -> x < gold_fr)"))
    return q.select(
        "k",
        *keys,
        "query_id",
        "gold",
        one(F.col("gold_cnt") > 0).alias("hit"),
        one(F.col("gold_fr") == 1).alias("top1"),
        one((F.col("maj_label") == F.col("gold")) & (maj_frac >= tau)).alias("majority"),
        cons.alias("cons_frac"),
        F.when(F.coalesce(F.col("prior"), F.lit(0)) > 0, cons / F.col("prior")).otherwise(0.0).alias("lift"),
        F.when(F.col("gold_fr").isNull(), 0.0).otherwise(1 / (1 + before)).alias("mrr"),
        "maj_label",
        one(F.col("maj_label") == F.col("gold")).alias("maj_correct"),
        maj_frac.alias("maj_frac"),
        (maj_frac - frac(F.get("cnts", F.lit(1)))).alias("margin"),
        F.aggregate("cnts", F.lit(0.0), lambda acc, c: acc - c / n * F.log(c / n)).alias("entropy"),
        F.col("n_unique").cast("int").alias("n_unique"),
        F.col("n").cast("int").alias("n"),
    )


def means(q: DataFrame, keys: Sequence[str] = ("k",), columns: Sequence[str] = METRICS, digits: int = 6) -> DataFrame:
    """Mean of each column, and the number of queries, per key."""
    return q.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_queries"), *[F.round(F.avg(c), digits).alias(c) for c in columns])


def macro_means(q: DataFrame, keys: Sequence[str] = ("k",), label: str = "gold", columns: Sequence[str] = METRICS, digits: int = 6) -> DataFrame:
    """The mean over labels of each label's mean."""
    by = q.groupBy(*keys, label).agg(*[F.avg(c).alias(c) for c in columns])
    return by.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_labels"), *[F.round(F.avg(c), digits).alias(c) for c in columns])


def threshold_curve(q: DataFrame, thresholds: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """(*keys, tau, cov, acc, prec): the share of queries whose majority share reaches tau, those of them that
    are right, and the share of right ones among them (null if none reaches it)."""
    t = q.withColumn("tau", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])))
    over = F.col("maj_frac") >= F.col("tau")
    t = t.groupBy(*keys, "tau").agg(F.avg(over.cast("double")).alias("cov"), F.avg((over & (F.col("maj_correct") == 1)).cast("double")).alias("acc"))
    return t.withColumn("prec", F.try_divide("acc", "cov"))


def recommend_threshold(curve: DataFrame, min_coverage: float, by: str = "prec", keys: Sequence[str] = ()) -> DataFrame:
    """The row of the curve with the best precision (by="prec") or accuracy (by="acc") among those of
    enough coverage, or among all if none has enough; the other measure and then the smaller tau decide ties."""
    other = {"prec": "acc", "acc": "prec"}[by]
    w = Window.partitionBy(*keys).orderBy((F.col("cov") >= min_coverage).desc(), F.col(by).desc_nulls_last(), F.col(other).desc_nulls_last(), "tau")
    return curve.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def decompose(curve: DataFrame, a: str, b: str) -> DataFrame:
    """(tau, d_acc, cov_part, prec_part): how much of the accuracy difference of two methods comes from
    coverage and how much from precision (Shapley values). A method that covers nothing has precision 0 here."""
    pick = lambda m, s: curve.where(F.col("method") == m).select("tau", F.col("cov").alias(f"c{s}"), F.coalesce("prec", F.lit(0.0)).alias(f"p{s}"), F.col("acc").alias(f"a{s}"))
    t = pick(a, "a").join(pick(b, "b"), "tau")
    half = lambda x: x / 2
    return t.select(
        "tau",
        (F.col("aa") - F.col("ab")).alias("d_acc"),
        half((F.col("ca") - F.col("cb")) * (F.col("pa") + F.col("pb"))).alias("cov_part"),
        half((F.col("pa") - F.col("pb")) * (F.col("ca") + F.col("cb"))).alias("prec_part"),
    )


def set_overlap(ranked: DataFrame, a: str, b: str, k: int) -> DataFrame:
    """(query_id, jaccard, overlap, label_jaccard) of the first k units and labels of two methods; empty lists give 0."""
    t = ranked.where(F.col("rank") <= k).groupBy("query_id").agg(
        *[f(F.when(F.col("method") == m, F.col(c))).alias(f"{p}{s}") for s, m in (("a", a), ("b", b)) for p, c, f in (("u", "unit_id", F.collect_set), ("l", "label", F.collect_set))]
    )
    jac = lambda p: F.coalesce(F.try_divide(F.size(F.array_intersect(f"{p}a", f"{p}b")), F.size(F.array_union(f"{p}a", f"{p}b"))), F.lit(0.0))
    return t.select("query_id", jac("u").alias("jaccard"), (F.size(F.array_intersect("ua", "ub")) / k).alias("overlap"), jac("l").alias("label_jaccard"))


def strata(df: DataFrame, groups: dict[str, Column], style: str | None = None) -> DataFrame:
    """A row for each group that a row belongs to, named `stratum`; groups may overlap. With `style`, also "style/<value>"."""
    names = [F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in groups.items()]
    if style:
        names.append(F.concat(F.lit("style/"), F.col(style)))
    return df.withColumn("stratum", F.explode(F.array_compact(F.array(*names))))


def deltas(q: DataFrame, baseline: str, columns: Sequence[str] = METRICS, digits: int = 6) -> DataFrame:
    """(k, method, metric, delta): mean paired difference of each method from the baseline."""
    base = q.where(F.col("method") == baseline).select("k", "query_id", *[F.col(c).alias(f"b_{c}") for c in columns])
    t = q.where(F.col("method") != baseline).join(base, ["k", "query_id"])
    m = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), (F.col(c) - F.col(f"b_{c}")).alias("d")) for c in columns]))
    return t.select("k", "method", m.alias("m")).groupBy("k", "method", F.col("m.metric").alias("metric")).agg(F.round(F.avg("m.d"), digits).alias("delta"))


def long_format(wide: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(*keys, metric, value) from one column for each metric."""
    return wide.unpivot(list(keys), list(columns), "metric", "value")


def verdict(cis: DataFrame) -> DataFrame:
    """(k, n, supported, significant) from (k, metric, pt, lo, hi): supported if every lower bound exceeds 0,
    significant: how many intervals exclude 0."""
    return cis.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("lo") > 0).alias("supported"), F.count_if((F.col("lo") > 0) | (F.col("hi") < 0)).alias("significant"))


def query_set_summary(queries: DataFrame, by: str) -> DataFrame:
    """(by, n, n_texts, n_topics) counts, distinct texts and distinct topics per value of a column."""
    return queries.groupBy(F.col(by)).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("query_text").alias("n_texts"), F.count_distinct("topic_id").alias("n_topics"))


def split_hygiene(train: DataFrame, test: DataFrame) -> DataFrame:
    """One row: distinct texts and topics that both splits have, and the share of the test topics."""
    common = lambda c: train.select(c).where(F.col(c).isNotNull()).intersect(test.select(c).where(F.col(c).isNotNull())).agg(F.count(F.lit(1)).alias(f"{c}_overlap"))
    n = test.agg(F.count_distinct("topic_id").alias("test_topics"))
    t = common("query_text").crossJoin(common("topic_id")).crossJoin(n)  # one row each
    return t.withColumn("topic_share", F.round(F.coalesce(F.try_divide("topic_id_overlap", "test_topics"), F.lit(0.0)), 6))


def support_margins(probabilities: DataFrame, counts: DataFrame) -> DataFrame:
    """(cluster, lhs, rhs, margin): mean squared probability against the share of rows of each cluster.

    probabilities: (id, cluster, p); counts: (cluster, n)."""
    total = counts.agg(F.sum("n").alias("total"))
    n = probabilities.select("id").distinct().agg(F.count(F.lit(1)).alias("ids"))
    s = probabilities.groupBy("cluster").agg(F.sum(F.col("p") * F.col("p")).alias("s"))
    t = counts.join(s, "cluster", "left").crossJoin(total).crossJoin(n)  # one row each
    lhs, rhs = F.coalesce("s", F.lit(0.0)) / F.col("ids"), F.col("n") / F.col("total")
    return t.select("cluster", lhs.alias("lhs"), rhs.alias("rhs"), (lhs - rhs).alias("margin"))
