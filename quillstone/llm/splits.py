"""Train, validation and test splits that keep related records together.

Topics that a row names together, or that rows with the same record id name, are tied. Ties
are followed by pointer jumping over a table of components that is persisted between
deliveries: a delivery is contracted to the components known so far, so that its cost follows
its own size. A component that has a split keeps it; new ones fill the deficits of the splits,
in each stratum and overall; a delivery that joins components of different splits puts the
joined component in quarantine.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.session import discard, materialize

SPLITS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))
QUARANTINE = "quarantine"
TOPIC = r"[\p{L}\p{N}][_\- ][Tt](\d+)(?![\p{L}\p{N}])"  # label, separator, T, number
BUCKET_UNITS = 1000
POOL_UNITS = 100_000  # whose classes one task folds
NEAR = 0.001  # overall shares as near as this are not mended
STATE = "unit string, split string, stratum string, n_rows long, delivery int"


def topic_numbers(cell: str = "topic_id"):
    """The distinct topic numbers that a cell names, as array<long>; numbers beyond LONG are no topics."""
    found = F.regexp_extract_all(F.col(cell), F.lit(TOPIC), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda s: s.try_cast("long")), lambda n: n.isNotNull())))


def topic_ties(df: DataFrame, id_col: str = "query_id", topic_col: str = "topic_id") -> tuple[DataFrame, DataFrame]:
    """(node) and (a, b): all topic numbers, and ties a < b that connect what is tied.

    Ties go from a cell's or an id's smallest topic to its others, never between all pairs. Null
    cells, and cells without a topic, tie nothing; a null id ties only within its cell.
    """
    cells = df.select(F.col(id_col).alias("id"), topic_numbers(topic_col).alias("topics")).where(F.size("topics") > 0)
    named = cells.select("id", F.explode("topics").alias("topic")).distinct()
    named = materialize(named, "topic-names")
    span = named.where("id IS NOT NULL").groupBy("id").agg(F.min("topic").alias("a"), F.max("topic").alias("z")).where("a < z")
    by_id = named.join(span, "id").where("topic <> a").select("a", F.col("topic").alias("b"))
    by_cell = cells.where("id IS NULL AND size(topics) > 1").select(F.col("topics")[0].alias("a"), F.explode(F.slice("topics", 2, 2147483647)).alias("b"))
    return named.select(F.col("topic").alias("node")).distinct(), by_id.unionByName(by_cell).distinct()


def components(ties: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): for every node of `ties` (a, b), the smallest node it is connected with.

    Each round points every node at the smallest node within two ties, follows the pointers
    by doubling until they are roots, and contracts the ties to roots. All tables are written to
    the shared folder; nothing is gathered by the driver. An empty input has no components.
    """
    edges, n = _written(ties.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b"), "ties")
    labels = None
    for _ in range(max_rounds):
        if not n:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))  # over closed neighbourhoods
        points = both.join(low.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("low").alias("p"))
        points = materialize(points.select(F.col("a").alias("node"), F.least("a", "p").alias("p")), "points")
        moved = True
        while moved:  # pointer jumping
            up = points.select(F.col("node").alias("p"), F.col("p").alias("pp"))
            jumped, moved = _written(points.join(up, "p").select("node", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "points", "moved")
            discard(points)
            points = jumped.drop("moved")
            points._quillstone_path = jumped._quillstone_path
        if labels is None:
            new = points.select("node", F.col("p").alias("root"))
        else:
            to = points.select(F.col("node").alias("root"), "p")
            new = labels.join(to, "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        new = materialize(new, "components")
        if labels is not None:
            discard(labels)
        labels = new
        pa, pb = points.select(F.col("node").alias("a"), F.col("p").alias("ra")), points.select(F.col("node").alias("b"), F.col("p").alias("rb"))
        left = edges.join(pa, "a").join(pb, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        left, n = _written(left, "ties")
        discard(edges)
        discard(points)
        edges = left
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    if labels is None:
        return ties.sparkSession.createDataFrame([], "node long, root long")
    return labels


def _written(df: DataFrame, tag: str, what: str = "true") -> tuple[DataFrame, bool]:
    """The written table, and whether it has a row that satisfies `what`."""
    out = materialize(df, tag)
    return out, not out.where(what).isEmpty()


def moves(size: np.ndarray, count: np.ndarray, over: np.ndarray, near: float, width: int = 200_000, most: int = 16) -> list[tuple[int, int, int, int]]:
    """(size, from, to, units): what brings the splits to at most `near` rows from their targets, or as near as is found.

    count[s, i] units of size[s] rows may leave split i, which has over[i] rows too many. As many units
    as fit at once are moved first; then a beam search moves up to `most` units one by one.
    """
    over, left, n = over.astype(float).copy(), count.copy(), len(over)
    if np.abs(over).max() <= near or not len(size):
        return []
    for s in np.argsort(-size):
        for i in np.argsort(-over):
            for j in np.argsort(over):
                k = int(min(left[s, i], max(0, min(over[i], -over[j])) // size[s]))
                left[s, i], left[s, j] = left[s, i] - k, left[s, j] + k
                over[i], over[j] = over[i] - k * size[s], over[j] + k * size[s]
    # states: what is too much, and the steps that led there; equal states, by a sum of random numbers for their units, are kept once
    steps = [(s, i, j) for s in range(len(size)) for i in range(n) for j in range(n) if i != j]
    at, out, to = (np.array(x) for x in zip(*steps))
    mark = np.random.default_rng(3).integers(1 << 40, size=count.shape)
    change = size[at][:, None] * (np.eye(n)[to] - np.eye(n)[out])
    states, names, paths, seen = over[None, :], np.zeros(1, np.int64), np.zeros((1, 0), np.int64), np.zeros(1, np.int64)
    best, path = np.abs(over).max(), paths[0]
    for _ in range(most):
        if best <= near or not len(states):
            break
        can = np.repeat(left[None, at, out], len(states), 0)  # units that a step may still take
        for p in paths.T:
            can += (at[p][:, None] == at) * ((to[p][:, None] == out).astype(int) - (out[p][:, None] == out))
        who, step = np.nonzero(can > 0)
        name = names[who] + mark[at[step], to[step]] - mark[at[step], out[step]]
        name, first = np.unique(name, return_index=True)
        new = ~np.isin(name, seen)
        name, first = name[new], first[new]
        after = states[who[first]] + change[step[first]]
        far = np.abs(after).max(1)
        keep = np.argsort(far, kind="stable")[: max(16, width // len(steps))]
        states, names, paths = after[keep], name[keep], np.column_stack([paths[who[first[keep]]], step[first[keep]]])
        seen = np.concatenate([seen, names])
        if len(keep) and far[keep[0]] < best - 1e-9:
            best, path = far[keep[0]], paths[0]
    for p in path:
        left[at[p], out[p]] -= 1
        left[at[p], to[p]] += 1
    found = []
    for s, more in enumerate(left - count):  # only what changes in all, so that no unit moves twice
        for i in np.flatnonzero(more < 0):
            for j in np.flatnonzero(more > 0):
                if k := min(-more[i], more[j]):
                    found.append((int(size[s]), int(i), int(j), int(k)))
                    more[i], more[j] = more[i] + k, more[j] - k
    return found


def _moved(given: DataFrame, moved: list[tuple[int, int, int, int]], n_splits: int) -> DataFrame:
    """Classes (pool, n_rows, bucket, give, over) after the moves; units leave where their split has most rows too many."""
    limits, sizes = {}, sorted({m[0] for m in moved})
    for s, i, j, k in moved:  # of the units of a size that leave a split, those from lo on go to one other split
        lo = sum(m[3] for m in moved if m[:2] == (s, i) and m[2] < j)
        limits[s, i, j] = (lo, lo + k)
    pairs = [(i, j) for i in range(n_splits) for j in range(n_splits) if i != j]
    table = given.sparkSession.createDataFrame([(s, *[x for p in pairs for x in limits.get((s, *p), (0, 0))]) for s in sizes], "n_rows long, " + ", ".join(f"lo{i}_{j} long, hi{i}_{j} long" for i, j in pairs))
    t = given.join(F.broadcast(table), "n_rows", "left").na.fill(0)  # few sizes
    for i in range(n_splits):  # classes of a size are as many as pools, and one for each BUCKET_UNITS units
        t = t.withColumn(f"upto{i}", F.sum(F.col("give")[i]).over(Window.partitionBy("n_rows").orderBy(F.desc(F.col("over")[i]), "pool", "bucket").rowsBetween(Window.unboundedPreceding, 0)))
    gone = lambda i, j: F.greatest(F.lit(0), F.least(f"upto{i}", f"hi{i}_{j}") - F.greatest(F.col(f"upto{i}") - F.col("give")[i], F.col(f"lo{i}_{j}")))
    give = [sum([gone(j, i) - gone(i, j) for j in range(n_splits) if j != i], F.col("give")[i]) for i in range(n_splits)]
    return t.select("pool", "n_rows", "bucket", F.array(*give).alias("give"), "over")


class SplitTable:
    """Splits of the units seen so far: `topics` (node, root) and `units` (unit, split, ...).

    A unit is a component of topics ("t" and its smallest topic) or, for a record without any topic,
    the record itself ("q" and its id). `update` takes a delivery of rows.
    """

    def __init__(self, spark: SparkSession, splits: Sequence[tuple[str, float]] = SPLITS, small: int = 30) -> None:
        if abs(sum(w for _, w in splits) - 1) > 1e-9:
            raise ValueError("the shares of the splits must sum to 1")
        self.spark, self.splits, self.small, self.deliveries = spark, tuple(splits), small, 0
        self.topics = spark.createDataFrame([], "node long, root long")
        self.units = spark.createDataFrame([], STATE)
        self.records = spark.createDataFrame([], "id string, unit string")

    def save(self, path: str) -> None:
        self.topics.write.parquet(f"{path}/topics")
        self.units.write.parquet(f"{path}/units")
        self.records.write.parquet(f"{path}/records")

    @classmethod
    def load(cls, spark: SparkSession, path: str, splits: Sequence[tuple[str, float]] = SPLITS, small: int = 30) -> SplitTable:
        t = cls(spark, splits, small)
        t.topics, t.units, t.records = (spark.read.parquet(f"{path}/{x}") for x in ("topics", "units", "records"))
        t.deliveries = (t.units.agg(F.max("delivery")).first()[0] or 0) + 1
        return t

    def tie(self, df: DataFrame, id_col: str = "query_id", topic_col: str = "topic_id") -> DataFrame:
        """(node, root): the topics known with those of a delivery, by component. The table itself is left as it is."""
        return self._tie(df.select(F.col(id_col).cast("string").alias("id"), F.col(topic_col).alias("cell")))[0]

    def _tie(self, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The component table after a delivery (id, cell), each record's first topic there, and (id, was) of records known with a topic."""
        # records known to belong to a topic tie their new topics with it
        nodes, ties = topic_ties(rows, "id", "cell")
        first = rows.select("id", topic_numbers("cell").alias("ts")).where("id IS NOT NULL AND size(ts) > 0").groupBy("id").agg(F.min(F.col("ts")[0]).alias("topic"))
        old = self.records.where("unit LIKE 't%'").select("id", F.expr("CAST(substring(unit, 2) AS BIGINT)").alias("was"))
        if self.deliveries:
            first = materialize(first, "first-topics")
            ties = ties.unionByName(first.join(old, "id").where("topic <> was").select(F.least("topic", "was").alias("a"), F.greatest("topic", "was").alias("b")))

            def rooted(t: DataFrame, c: str) -> DataFrame:
                known = self.topics.select(F.col("node").alias(c), F.col("root").alias("known"))
                return t.join(known, c, "left").withColumn(c, F.coalesce("known", c)).drop("known")

            ties = rooted(rooted(ties, "a"), "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            nodes = nodes.join(self.topics, "node", "left_anti")
        to = components(ties).select(F.col("node").alias("root"), F.col("root").alias("to"))  # over roots and new topics
        every = self.topics.unionByName(nodes.select("node", F.col("node").alias("root")))
        topics = materialize(every.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "topics")
        return topics, first, old

    def update(self, df: DataFrame, id_col: str = "query_id", topic_col: str = "topic_id", stratum_col: str | None = "consensus_law") -> None:
        """Take a delivery. Rows with a null id are not assigned (there is nothing to assign), but their cell still ties."""
        stratum = F.coalesce(F.trim(F.col(stratum_col)), F.lit("")) if stratum_col else F.lit("")
        rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(topic_col).alias("cell"), stratum.alias("stratum"))
        topics, first, old = self._tie(rows.select("id", "cell"))

        # the unit of each record of the delivery; a record known before keeps a topic it had
        root = topics.select(F.col("node").alias("topic"), F.col("root"))
        had = old.withColumnRenamed("was", "topic").join(rows.select("id").distinct(), "id", "left_semi")
        named = first.unionByName(had.select("id", "topic")).groupBy("id").agg(F.min("topic").alias("topic"))
        unit_of = (
            rows.where("id IS NOT NULL")
            .groupBy("id")
            .agg(F.count(F.lit(1)).alias("n"))
            .join(named.join(root, "topic").select("id", "root"), "id", "left")
            .select("id", "n", F.when(F.col("root").isNotNull(), F.concat(F.lit("t"), F.col("root"))).otherwise(F.concat(F.lit("q"), F.col("id"))).alias("unit"))
        )
        unit_of = materialize(unit_of, "record-units")
        by_stratum = rows.where("id IS NOT NULL").groupBy("id", "stratum").agg(F.count(F.lit(1)).alias("n"))
        weights = by_stratum.join(unit_of.select("id", "unit"), "id").groupBy("unit", "stratum").agg(F.sum("n").alias("n"))
        fresh = weights.groupBy("unit").agg(F.sum("n").cast("long").alias("n_rows"), F.expr("max_by(stratum, struct(n, stratum))").alias("stratum"))

        # units known before, under the names they have now
        moved = topics.join(self.topics.select("node", F.col("root").alias("was")), "node").where("root <> was").select(F.concat(F.lit("t"), F.col("was")).alias("unit"), F.concat(F.lit("t"), F.col("root")).alias("now")).distinct()
        gone = self.records.where("unit LIKE 'q%'").select("id", "unit").join(unit_of.select("id", F.col("unit").alias("now")), "id").where("unit <> now").select("unit", "now")
        moved = moved.unionByName(gone)
        kept = self.units.join(moved, "unit", "left").withColumn("unit", F.coalesce("now", "unit")).drop("now")
        kept = kept.groupBy("unit").agg(
            F.when(F.count_distinct("split") > 1, F.lit(QUARANTINE)).otherwise(F.min("split")).alias("split"),
            F.expr("max_by(stratum, struct(n_rows, stratum))").alias("stratum"),
            F.sum("n_rows").alias("n_rows"),
            F.min("delivery").alias("delivery"),
        )
        kept = materialize(kept, "kept-units")
        adds = fresh.join(kept.select("unit"), "unit", "left_semi").select("unit", F.col("n_rows").alias("more"))
        kept_now = kept.join(adds, "unit", "left").withColumn("n_rows", F.col("n_rows") + F.coalesce("more", F.lit(0))).drop("more")
        new = materialize(fresh.join(kept.select("unit"), "unit", "left_anti"), "new-units")
        assigned = self._assign(new, kept_now)
        cols = ["unit", "split", "stratum", F.col("n_rows").cast("long"), F.col("delivery").cast("int")]
        units = kept_now.select(*cols).unionByName(assigned.withColumn("delivery", F.lit(self.deliveries)).select(*cols))
        others = self.records.join(unit_of.select("id"), "id", "left_anti").join(moved, "unit", "left").select("id", F.coalesce("now", "unit").alias("unit"))
        self.units = materialize(units, "units")
        self.records = materialize(unit_of.select("id", "unit").unionByName(others), "records")
        self.topics, self.deliveries = topics, self.deliveries + 1

    def _assign(self, new: DataFrame, kept: DataFrame) -> DataFrame:
        """Give new units splits so that each stratum, and all of them, come near the shares.

        Units are compressed to classes of equal (pool, rows, bucket); a sequential fold over a pool's classes decides
        how many units of each go to which split; units take their places by a hash. Strata of few rows are pooled, and
        those of more than POOL_UNITS units are dealt to several pools. What the pools' sums then lack of the overall
        shares is added to what the pools want, in proportion to their rows, and the fold is done again. What is then
        missing still, because units are large beside the pools, is mended by moving single units (see `moves`).
        """
        spark, names = self.spark, [n for n, _ in self.splits]
        shares = np.array([w for _, w in self.splits])
        total = new.select("stratum", "n_rows", F.lit(1).alias("u")).unionByName(kept.select("stratum", "n_rows", F.lit(0).alias("u"))).groupBy("stratum").agg(F.sum("n_rows").alias("all_rows"), F.sum("u").alias("u"))
        pool = F.when(F.col("all_rows") < self.small, F.lit("~")).otherwise(F.concat(F.lit("="), F.col("stratum"))).alias("pool")
        pools = materialize(total.select("stratum", pool, F.greatest(F.lit(1), F.ceil(F.col("u") / POOL_UNITS)).alias("parts")), "pools")
        # the pool of small strata holds few units for each stratum, but there may be many strata
        parts = materialize(pools.join(total.select("stratum", "u"), "stratum").groupBy("pool").agg(F.greatest(F.lit(1), F.ceil(F.sum("u") / POOL_UNITS)).alias("parts")), "pool-parts")
        pools = pools.select("stratum", "pool").join(parts, "pool")
        named = lambda part: F.concat_ws("#", part.cast("string"), "pool")
        new = new.join(pools, "stratum").withColumn("pool", named(F.pmod(F.xxhash64("unit", F.lit(9)), F.col("parts")))).drop("parts")
        size = new.groupBy("pool", "n_rows").agg(F.count(F.lit(1)).alias("c"))
        bucket = F.pmod(F.xxhash64("unit"), F.ceil(F.col("c") / BUCKET_UNITS)).cast("int")
        new = materialize(new.join(size, ["pool", "n_rows"]).withColumn("bucket", bucket).drop("c"), "pooled-units")
        classes = new.groupBy("pool", "n_rows", "bucket").agg(F.count(F.lit(1)).alias("c"))
        have = kept.join(pools, "stratum").where(F.col("split") != QUARANTINE).groupBy("pool").agg(F.first("parts").alias("parts"), *[F.sum(F.when(F.col("split") == n, F.col("n_rows")).otherwise(0)).alias(f"h{i}") for i, n in enumerate(names)])
        have = have.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(named(F.col("part")).alias("pool"), *[(F.col(f"h{i}") / F.col("parts")).alias(f"h{i}") for i in range(len(names))])
        classes = materialize(classes.join(have, "pool", "left").na.fill(0), "unit-classes")

        def fold_with(more: np.ndarray):
            def fold(pdf: pd.DataFrame) -> pd.DataFrame:
                pdf = pdf.sort_values(["n_rows", "bucket"], ascending=[False, True])
                held = pdf[[f"h{i}" for i in range(len(names))]].iloc[0].to_numpy(float)
                rows = held.sum() + float((pdf["n_rows"] * pdf["c"]).sum())
                want = (shares + more) * rows
                out = []
                tie = np.roll(np.arange(len(names)), zlib.crc32(pdf["pool"].iloc[0].encode())) * 1e-6  # equal lacks: not always the same split
                for n, c in zip(pdf["n_rows"].to_numpy(), pdf["c"].to_numpy()):
                    lack = want - held
                    give = np.floor(np.maximum(lack, 0) / n).astype(np.int64)
                    if give.sum() > c:
                        give = np.floor(give * (c / give.sum())).astype(np.int64)
                    held = held + give * n
                    while give.sum() < c:
                        i = int(np.argmax(want - held + tie))
                        give[i] += 1
                        held[i] += n
                    out.append(give.tolist())
                over = held - shares * rows
                return pdf[["pool", "n_rows", "bucket"]].assign(give=out, over=[over.tolist()] * len(pdf))

            return materialize(classes.groupBy("pool").applyInPandas(fold, "pool string, n_rows long, bucket int, give array<long>, over array<double>"), "given-classes")

        old = kept.where(F.col("split") != QUARANTINE).groupBy("split").agg(F.sum("n_rows").alias("n")).collect()  # one row for each split
        before = np.array([sum(r["n"] for r in old if r["split"] == n) for n in names], float)
        # units of each size in each split: the different sizes are at most the root of twice the rows
        by_size = [F.sum(F.col("give")[i]).alias(f"g{i}") for i in range(len(names))]

        def reached(t: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            rows = np.array([tuple(r) for r in t.groupBy("n_rows").agg(*by_size).orderBy("n_rows").collect()], np.int64).reshape(-1, len(names) + 1)
            return rows[:, 0], rows[:, 1:], before + rows[:, 0] @ rows[:, 1:]

        given = fold_with(np.zeros(len(names)))
        size, count, have = reached(given)
        if have.sum():
            lack = shares - have / have.sum()
            if np.abs(lack).max() * have.sum() >= 1:
                given = fold_with(lack)
                size, count, have = reached(given)
            moved = moves(size, count, have - shares * have.sum(), NEAR * have.sum())
            if moved:
                given = materialize(_moved(given, moved, len(names)), "mended-classes")
        sums = F.transform(F.sequence(F.lit(1), F.lit(len(names))), lambda i: F.aggregate(F.slice("give", 1, i), F.lit(0).cast("long"), lambda a, b: a + b))
        given = given.select("pool", "n_rows", "bucket", sums.alias("upto"))
        place = Window.partitionBy("pool", "n_rows", "bucket").orderBy(F.xxhash64("unit", F.lit(3)), "unit")
        split = F.element_at(F.array(*[F.lit(n) for n in names]), F.size(F.filter("upto", lambda u: u < F.col("place"))) + 1)
        return new.withColumn("place", F.row_number().over(place)).join(given, ["pool", "n_rows", "bucket"]).select("unit", split.alias("split"), "stratum", "n_rows")

    def assignments(self) -> DataFrame:
        """(id, unit, split) for every record seen."""
        return self.records.join(self.units.select("unit", "split"), "unit").select("id", "unit", "split")
