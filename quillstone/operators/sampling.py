"""Target counts, stratified samples and train/test splits without text repeats.

Samples follow a hash of the seed and the id instead of a shuffle: they are the same on any
number of partitions and in any engine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffle_key(seed: int, id_col: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))


def target_counts(labels: DataFrame, total: int, label: str = "label") -> DataFrame:
    """(label, target): `total` spread evenly over the distinct labels, the remainder to the first in order.

    The labels of a benchmark are few; they are ranked in one window.
    """
    u = labels.select(F.col(label).alias("label")).where("label IS NOT NULL").distinct()
    w = Window.orderBy("label")
    t = u.withColumn("r", F.row_number().over(w)).crossJoin(F.broadcast(u.agg(F.count(F.lit(1)).alias("m"))))  # one row
    return t.select("label", (F.floor(F.lit(total) / F.col("m")) + (F.col("r") <= F.lit(total) % F.col("m")).cast("long")).cast("long").alias("target"))


def style_targets(by_label: DataFrame, styles: Sequence[str], seed: int = 0) -> DataFrame:
    """(label, style, target): each label's target spread over styles, the remainder to styles in a hash order of the label."""
    n = len(styles)
    t = by_label.withColumn("style", F.explode(F.array(*[F.lit(s) for s in styles])))
    w = Window.partitionBy("label").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "label", "style")))
    t = t.withColumn("r", F.row_number().over(w))
    return t.select("label", "style", (F.floor(F.col("target") / n) + (F.col("r") <= F.col("target") % n).cast("long")).cast("long").alias("target"))


def stratified_sample(pool: DataFrame, targets: DataFrame, strata: Sequence[str], seed: int, forbidden: DataFrame | None = None, id_col: str = "query_id", text_col: str = "query_text") -> DataFrame:
    """Rows of `pool`, as many of each stratum as `targets` (strata, target) wants, no text twice and none of `forbidden` (a column of texts).

    Of rows with the same text the first in hash order stays, whatever its stratum. Null texts are
    no candidates. A stratum without enough candidates gives what it has: see `shortfalls`.
    """
    key = shuffle_key(seed, id_col)
    t = pool.where(F.col(text_col).isNotNull())
    if forbidden is not None:
        t = t.join(forbidden.select(F.col(forbidden.columns[0]).alias("__no")).distinct(), F.col(text_col) == F.col("__no"), "left_anti")
    t = t.withColumn("__key", key)
    first = Window.partitionBy(text_col).orderBy("__key", id_col)
    t = t.withColumn("__r", F.row_number().over(first)).where("__r = 1")
    place = Window.partitionBy(*strata).orderBy("__key", id_col)
    t = t.join(targets, list(strata)).withColumn("__r", F.row_number().over(place)).where(F.col("__r") <= F.col("target"))
    return t.drop("__key", "__r", "target")


def shortfalls(sample: DataFrame, targets: DataFrame, strata: Sequence[str]) -> DataFrame:
    """(strata, target, got) where a sample has fewer rows than wanted."""
    n = sample.groupBy(*strata).agg(F.count(F.lit(1)).alias("got"))
    return targets.join(n, list(strata), "left").na.fill({"got": 0}).where("got < target")


def split_train_test(pool: DataFrame, train: DataFrame, test: DataFrame, strata: Sequence[str], seed: int, mode: str = "iid", topic_col: str = "topic_id", id_col: str = "query_id", text_col: str = "query_text") -> DataFrame:
    """Rows of `pool` with `split`: a stratified training and test sample that share no text.

    mode "iid": test topics occur in training (with the same first stratum); "iid_unrestricted": any;
    "topic_disjoint": no test topic occurs in training.
    """
    a = stratified_sample(pool, train, strata, seed, None, id_col, text_col)
    rest = pool
    if mode == "iid":
        rest = pool.join(a.select(strata[0], topic_col).distinct(), [strata[0], topic_col], "left_semi")
    elif mode == "topic_disjoint":
        rest = pool.join(a.select(topic_col).distinct(), topic_col, "left_anti")
    elif mode != "iid_unrestricted":
        raise ValueError(f"unknown mode {mode!r}")
    b = stratified_sample(rest.select(*pool.columns), test, strata, seed + 101, a.select(text_col), id_col, text_col)
    return a.select(*pool.columns).withColumn("split", F.lit("train")).unionByName(b.select(*pool.columns).withColumn("split", F.lit("test")))


def template_capacity(templates: DataFrame, slots: DataFrame) -> DataFrame:
    """(spec, capacity): how many texts templates (spec, template) can give with slots (spec, slot, value).

    A template gives the product of the numbers of distinct values of its {slots}; one with an unknown slot gives none.
    """
    sizes = slots.groupBy("spec", "slot").agg(F.count_distinct("value").alias("m"))
    t = templates.select("spec", "template", F.posexplode_outer(F.regexp_extract_all("template", F.lit(r"\{([a-zA-Z_][a-zA-Z0-9_]*)\}"), F.lit(1))).alias("i", "slot"))
    t = t.join(sizes, ["spec", "slot"], "left").withColumn("m", F.when(F.col("slot").isNull(), 1).otherwise(F.coalesce("m", F.lit(0))))
    per = t.groupBy("spec", "template").agg(F.product("m").cast("long").alias("c"))
    return per.groupBy("spec").agg(F.sum("c").alias("capacity"))


def expand_templates(templates: DataFrame, slots: DataFrame, most: int, seed: int) -> DataFrame:
    """(spec, text): up to `most` distinct texts per spec, of all combinations the first in hash order.

    Slots are filled one after the other by joins; blanks are collapsed.
    """
    t = templates.select("spec", "template", F.col("template").alias("text"))
    longest = templates.select(F.max(F.size(F.regexp_extract_all("template", F.lit(r"\{([a-zA-Z_][a-zA-Z0-9_]*)\}"), F.lit(1))))).first()[0] or 0
    s = slots.select("spec", "slot", "value").distinct()
    for _ in range(longest):
        t = t.withColumn("slot", F.regexp_extract("text", r"\{([a-zA-Z_][a-zA-Z0-9_]*)\}", 1))
        open_, done = t.where("slot <> ''"), t.where("slot = ''").drop("slot")
        filled = open_.join(s, ["spec", "slot"]).withColumn("text", F.expr("replace(text, concat('{', slot, '}'), value)")).drop("slot", "value")
        t = filled.unionByName(done)
    t = t.select("spec", F.trim(F.regexp_replace("text", r"(?U)\s+", " ")).alias("text")).distinct()
    w = Window.partitionBy("spec").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "text")), "text")
    return t.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("spec", "text")


def merged_terms(*lists: Column) -> Column:
    """The union of lists in order, each element once; null lists are empty."""
    return F.array_distinct(F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])))
