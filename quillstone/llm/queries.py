"""Queries of the subpackage llm, with the SQL they are checked against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm import crosssplit, mixing, neardup, packing, residue, splits, vectors
from quillstone.llm.sizes import byte_tokens, character_begins
from quillstone.session import shared_dir
from quillstone.sources.tables import table

QUERY_ROWS = "id % 50 = 0"  # the stated query set of searches


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of passages where one is among the 5 most similar of the other, at cosine 0.80 or more."""
    pairs = vectors.similar_pairs(table(spark, d, "embedding_index"), "sentence_id", "embeddings", 5, 0.8)
    return pairs.select(F.col("a").alias("sentence_id_a"), F.col("b").alias("sentence_id_b"))


def _neighbors(spark: SparkSession, d: str) -> DataFrame:
    return vectors.knn(table(spark, d, "embedding_index"), "sentence_id", "embeddings", 5, QUERY_ROWS)


def p2_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most similar passages of each query passage, searched among all rows."""
    return _neighbors(spark, d)


def p2_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of `p2_neighbors`, which searches as `p2_found` does, against brute force."""
    exact = vectors.exact_neighbors(table(spark, d, "embedding_index"), "sentence_id", "embeddings", 5, QUERY_ROWS)
    return vectors.recall(_neighbors(spark, d), exact)


def _splits(spark: SparkSession, d: str, parts: int = 1) -> splits.SplitTable:
    t, train = splits.SplitTable(spark), table(spark, d, "train")
    if parts == 1:
        t.update(train)
        return t
    late = F.coalesce(F.col("created_at") >= F.lit("2025-01-01").cast("timestamp") + F.expr("INTERVAL 180 DAYS"), F.lit(True))
    t.update(train.where(~late))
    path = f"{shared_dir(spark)}/quillstone/split-table-{uuid.uuid4().hex}"  # a later job takes the next delivery
    t.save(path)
    t = splits.SplitTable.load(spark, path)
    t.update(train.where(late))
    return t


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of topics that must share a split: the topics of a component, which are few."""
    topics = splits.SplitTable(spark).tie(table(spark, d, "train"))
    some = topics.join(topics.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("root"), "root")
    a, b = some.select("root", F.col("node").alias("topic_no_a")), some.select("root", F.col("node").alias("topic_no_b"))
    return a.join(b, "root").where("topic_no_a < topic_no_b").select("topic_no_a", "topic_no_b")


def p3_split(spark: SparkSession, d: str) -> DataFrame:
    """The split of every training query."""
    return _splits(spark, d).assignments().select(F.col("id").alias("query_id"), "unit", "split")


def p3_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Units after a second delivery: kept, new and quarantined ones."""
    return _splits(spark, d, 2).units


def _shares(t: splits.SplitTable, train: DataFrame) -> DataFrame:
    rows = train.select(F.col("query_id").alias("id"), F.trim("consensus_law").alias("law")).join(t.assignments(), "id")
    n = rows.groupBy("law", "split").count().withColumn("of", F.lit("law")).unionByName(rows.groupBy("split").count().select(F.lit(None).cast("string").alias("law"), "split", "count", F.lit("all").alias("of")))
    w = Window.partitionBy("of", "law")
    return n.select("of", "law", "split", F.col("count").alias("n_rows"), F.round(F.col("count") / F.sum("count").over(w), 6).alias("share"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows and share of each split, by law and overall (null law: all), after one and after two deliveries; the latter have quarantined rows."""
    train = table(spark, d, "train")
    one = _shares(_splits(spark, d), train).withColumn("deliveries", F.lit(1))
    return one.unionByName(_shares(_splits(spark, d, 2), train).withColumn("deliveries", F.lit(2)))


def p3_kept(spark: SparkSession, d: str) -> DataFrame:
    """For each training record, whether all records tied with it share its split; and whether all shares are within a hundredth."""
    t, train = _splits(spark, d), table(spark, d, "train")
    of = packing.materialize(t.assignments(), "assignments")
    topic = train.select(F.col("query_id").alias("id"), F.explode(splits.topic_numbers("topic_id")).alias("topic")).distinct().join(of, "id")
    torn = topic.groupBy("topic").agg(F.count_distinct("split").alias("n")).where("n > 1").select("topic")
    torn = topic.join(torn, "topic").select("id").distinct().withColumn("torn", F.lit(True))
    n = train.where("query_id IS NOT NULL").join(of.withColumnRenamed("id", "query_id"), "query_id").agg(*[F.avg((F.col("split") == name).cast("double")).alias(name) for name, _ in splits.SPLITS])
    near = n.select(F.greatest(*[F.abs(F.col(name) - share) for name, share in splits.SPLITS]).alias("off")).select((F.col("off") < 0.01).alias("near_shares"))
    return of.join(torn, "id", "left").select(F.col("id").alias("query_id"), F.col("torn").isNull().alias("together")).crossJoin(F.broadcast(near))  # one row


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of training queries whose texts are nearly the same."""
    members, _, pairs = neardup.near_duplicates(table(spark, d, "train"), "query_id", "query_text", "0.7")
    return neardup.duplicate_pairs(members, pairs).select(F.col("a").alias("query_id_a"), F.col("b").alias("query_id_b"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """The class of texts with the same words of each training query, and the links of the class."""
    return neardup.duplicate_groups(*neardup.near_duplicates(table(spark, d, "train"), "query_id", "query_text", "0.7")).withColumnRenamed("id", "query_id")


def _across(spark: SparkSession, d: str):
    return crosssplit.overlapping(table(spark, d, "test"), table(spark, d, "train"), "query_id", "query_text", "0.7")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a test and a training query with nearly the same text."""
    e, t, pairs = _across(spark, d)
    e, t = e.select(F.col("id").alias("test_query_id"), F.col("cid").alias("e")), t.select(F.col("id").alias("train_query_id"), F.col("cid").alias("t"))
    return pairs.join(e, "e").join(t, "t").select("test_query_id", "train_query_id").distinct()


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Queries of the test split, and those that training has exactly or almost, by topic and overall (null topic: none named)."""
    e, t, pairs = _across(spark, d)
    best = pairs.groupBy(F.col("e").alias("cid")).agg(F.max("similarity").alias("best"), F.count(F.lit(1)).alias("partners"))
    hit = e.join(best, "cid").groupBy("id").agg(F.max("best").alias("best"))
    rows = table(spark, d, "test").select(F.col("query_id").alias("id"), "topic_id").dropDuplicates().join(hit, "id", "left")
    sums = [
        F.count(F.lit(1)).alias("n_queries"),
        F.count_if(F.col("best") == 1).alias("n_same_words"),
        F.count_if(F.col("best") < 1).alias("n_almost"),
        F.round(F.max("best"), 6).alias("max_similarity"),
    ]
    split = F.lit("test").alias("split")
    every = rows.agg(*sums).select(split, F.lit("all").alias("of"), F.lit(None).cast("string").alias("topic_id"), "n_queries", "n_same_words", "n_almost", "max_similarity")
    return rows.groupBy("topic_id").agg(*sums).select(split, F.lit("topic").alias("of"), "topic_id", "n_queries", "n_same_words", "n_almost", "max_similarity").unionByName(every)


def p5_seen(spark: SparkSession, d: str) -> DataFrame:
    """How many words of each test query lie in runs of five or more words that training has."""
    return crosssplit.seen_words(table(spark, d, "test"), table(spark, d, "train"), "query_id", "query_text", 5).select(F.col("id").alias("query_id"), "n_words", "seen")


CAPACITY = 4096


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, or of the parts of one that exceeds the capacity."""
    return packing.pack(table(spark, d, "documents").select("doc_id", "text"), byte_tokens(F.col("text")), "doc_id", CAPACITY, begins=character_begins(F.col("text"), CAPACITY)).withColumnRenamed("id", "doc_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that had to be split."""
    return p6_pack(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select("doc_id")


def p6_placed(spark: SparkSession, d: str) -> DataFrame:
    """What the containers hold of each document, and whether any of them holds too much."""
    placed = packing.materialize(p6_pack(spark, d), "placed")
    over = placed.groupBy("container").agg(F.sum("size").alias("used")).where(F.col("used") > CAPACITY).select(F.col("container").alias("over"))
    t = placed.join(over, F.col("container") == F.col("over"), "left")
    # parts follow each other without a gap
    return t.groupBy("doc_id").agg(F.sum("size").alias("n_tokens"), (F.count(F.lit(1)) == 1).alias("whole"), (F.max(F.col("begin") + F.col("size")) == F.sum("size")).alias("gapless"), F.count("over").alias("n_over_full"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    return packing.packing_report(p6_pack(spark, d), CAPACITY)


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return mixing.source_sizes(table(spark, d, "documents"), table(spark, d, "mix_targets"), byte_tokens(F.col("text")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that can't reach their weight: the plan of the mixture repeats them as often as allowed."""
    return mixing.out_of_reach(mixing.mix_plan(_sizes(spark, d)))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, d, "documents").select("doc_id", "source", "text"), _sizes(spark, d), byte_tokens(F.col("text")))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The records of the mixture, a row for each copy."""
    return _mix(spark, d)[0].withColumnRenamed("id", "doc_id")


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    """For each target source, whether its repetitions hold it below its weight, and whether the mixture keeps what it promises."""
    mixed, plan = _mix(spark, d)
    mixed = mixing.materialize(mixed, "mixed")
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("actual"), F.max("copy").alias("copies"), F.max("tokens").alias("largest"))
    twice = mixed.groupBy("source", "id", "tokens", "copy").count().where("count > 1").select("source").distinct().withColumn("twice", F.lit(True))
    passes = mixed.groupBy("source", "copy").agg(F.count_distinct("nth").alias("n"), F.max("nth").alias("last")).where("n < last").select("source").distinct().withColumn("gap", F.lit(True))
    t = plan.join(got, "source", "left").join(twice, "source", "left").join(passes, "source", "left").na.fill({"actual": 0, "copies": 0, "largest": 1})
    total = t.select(F.sum("size").over(Window.partitionBy(F.lit(1))).alias("total"), "*")  # rows of the target table
    least = F.least(F.col("weight") * F.col("total"), F.col("size") * F.col("max_repeats"))
    return total.select(
        "source",
        "max_repeats",
        "size",
        (F.col("copies") <= F.col("max_repeats")).alias("repeats_kept"),
        (F.col("actual") > least - F.col("largest")).alias("weight_met"),
        (F.col("actual") <= F.col("planned") + 1e-6).alias("budget_kept"),
        (F.col("twice").isNull() & F.col("gap").isNull()).alias("order_whole"),
    )


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Weights and actual shares of the sources."""
    return mixing.mix_report(*_mix(spark, d))


def p7_tempered(spark: SparkSession, d: str) -> DataFrame:
    """The same for weights by temperature, as even as the targets where repetitions allow."""
    docs, size = table(spark, d, "documents").select("doc_id", "source", "text"), byte_tokens(F.col("text"))
    return mixing.mix_report(*mixing.mix(docs, mixing.temperature_targets(_sizes(spark, d)), size))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with template residue, filler, an error message or a script notice."""
    return residue.residue(table(spark, d, "documents")).where("size(kinds) > 0").select(F.col("id").alias("doc_id"))


def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    """The documents that stay."""
    return residue.without_residue(table(spark, d, "documents")).select("doc_id", "source", "lang")


def p8_parted(spark: SparkSession, d: str) -> DataFrame:
    """For each document, whether it is either found or kept, and whether a blank one is kept."""
    docs, found, kept = table(spark, d, "documents").select("doc_id", "text"), p8_found(spark, d).withColumn("f", F.lit(1)), p8_kept(spark, d).select("doc_id", F.lit(1).alias("k"))
    t = docs.join(found, "doc_id", "left").join(kept, "doc_id", "left")
    f, k = F.coalesce("f", F.lit(0)), F.coalesce("k", F.lit(0))
    blank = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", "")) == ""
    return t.select("doc_id", (f + k == 1).alias("once"), (blank & (f == 1)).alias("blank_found"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each kind of residue, by source as stored, and how much of them it covers."""
    docs = table(spark, d, "documents")
    marked = residue.residue(docs).where("size(kinds) > 0").select(F.col("id").alias("doc_id"), F.explode("kinds").alias("kind"), "coverage")
    return docs.select("doc_id", "source").join(marked, "doc_id").groupBy("source", "kind").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("coverage"), 4).alias("mean_coverage"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p2_found": p2_found, "p2_neighbors": p2_neighbors, "p2_recall": p2_recall, "p3_found": p3_found, "p3_split": p3_split, "p3_incremental": p3_incremental, "p3_report": p3_report, "p3_kept": p3_kept, "p4_found": p4_found, "p4_groups": p4_groups, "p5_found": p5_found, "p5_report": p5_report, "p5_seen": p5_seen, "p6_found": p6_found, "p6_pack": p6_pack, "p6_placed": p6_placed, "p6_report": p6_report, "p7_found": p7_found, "p7_mix": p7_mix, "p7_kept": p7_kept, "p7_report": p7_report, "p7_tempered": p7_tempered, "p8_found": p8_found, "p8_kept": p8_kept, "p8_parted": p8_parted, "p8_report": p8_report}


def oracle_sql() -> dict[str, str]:
    sizes = """
WITH t AS (SELECT lower(trim(source)) AS source, sum(weight) AS weight, max(max_repeats) AS max_repeats FROM mix_targets WHERE source IS NOT NULL GROUP BY 1),
     s AS (SELECT lower(trim(source)) AS source, sum(strlen(text)) AS size FROM documents GROUP BY 1),
     z AS (SELECT t.source, weight, max_repeats, coalesce(size, 0) AS size FROM t LEFT JOIN s USING (source))"""
    words = "SELECT DISTINCT query_id, list_sort(list_distinct(regexp_extract_all(lower(query_text), '[\\p{{L}}\\p{{N}}]+'))) AS w FROM {0} WHERE query_text IS NOT NULL"
    near = """
WITH a AS (SELECT * FROM ({0}) WHERE len(w) > 0), b AS (SELECT * FROM ({1}) WHERE len(w) > 0),
     p AS (SELECT x.query_id AS qa, x.w AS wa, y.query_id AS qb, y.w AS wb, count(*) AS n
           FROM (SELECT query_id, w, unnest(w) AS t FROM a) x JOIN (SELECT query_id, w, unnest(w) AS t FROM b) y ON x.t = y.t AND {2} GROUP BY ALL)
SELECT DISTINCT qa AS {3}, qb AS {4} FROM p WHERE n * 10 >= 7 * (len(wa) + len(wb) - n)"""
    links = near.replace("SELECT DISTINCT qa AS {3}, qb AS {4} FROM p WHERE n * 10", "{3} FROM p WHERE n * 10")
    groups = f"""
WITH a AS (SELECT * FROM ({words.format("train")}) WHERE len(w) > 0), c AS (SELECT w, min(query_id) AS class_id, count(*) AS copies FROM a GROUP BY 1),
     p AS (SELECT x.w AS wa, y.w AS wb, count(*) AS n FROM (SELECT w, unnest(w) AS t FROM c) x JOIN (SELECT w, unnest(w) AS t FROM c) y ON x.t = y.t AND x.w <> y.w GROUP BY ALL),
     l AS (SELECT wa AS w, count(*) AS links FROM p WHERE n * 10 >= 7 * (len(wa) + len(wb) - n) GROUP BY 1)
SELECT query_id, class_id, copies, coalesce(links, 0) AS links FROM a JOIN c USING (w) LEFT JOIN l USING (w)"""
    best = links.format(words.format("test"), words.format("train"), "true", "SELECT qa AS query_id, max(n / (len(wa) + len(wb) - n)) AS best") + " GROUP BY 1"
    report = f"""
WITH b AS ({best}), r AS (SELECT DISTINCT query_id, topic_id FROM test), j AS (SELECT r.*, best FROM r LEFT JOIN b USING (query_id))
SELECT 'test' AS split, CASE WHEN grouping(topic_id) = 1 THEN 'all' ELSE 'topic' END AS "of", topic_id, count(*) AS n_queries, count(*) FILTER (best = 1) AS n_same_words, count(*) FILTER (best < 1) AS n_almost, round(max(best), 6) AS max_similarity
FROM j GROUP BY GROUPING SETS ((topic_id), ())"""
    seen = """
WITH e AS (SELECT query_id, regexp_extract_all(lower(min(query_text)), '[\\p{L}\\p{N}]+') AS w FROM test WHERE query_text IS NOT NULL GROUP BY 1),
     t AS (SELECT DISTINCT regexp_extract_all(lower(query_text), '[\\p{L}\\p{N}]+') AS w FROM train WHERE query_text IS NOT NULL),
     g AS (SELECT DISTINCT w[i:i + 4] AS s FROM t, range(1, 2000) r(i) WHERE i + 4 <= len(w)),
     m AS (SELECT DISTINCT query_id, i + k AS pos FROM e, range(1, 2000) r(i), range(0, 5) u(k) WHERE i + 4 <= len(w) AND w[i:i + 4] IN (SELECT s FROM g))
SELECT query_id, CAST(len(any_value(w)) AS INTEGER) AS n_words, CAST(count(pos) AS INTEGER) AS seen FROM e LEFT JOIN m USING (query_id) WHERE len(w) > 0 GROUP BY 1"""
    return {
        "p4_groups": groups,
        "p5_report": report,
        "p5_seen": seen,
        "p2_found": NEAREST,
        "p4_found": near.format(words.format("train"), words.format("train"), "x.query_id < y.query_id", "query_id_a", "query_id_b"),
        "p5_found": near.format(words.format("test"), words.format("train"), "true", "test_query_id", "train_query_id"),
        "p3_found": TIED,
        "p3_kept": "SELECT DISTINCT query_id, true AS together, true AS near_shares FROM train WHERE query_id IS NOT NULL",
        "p8_parted": "SELECT doc_id, true AS once, false AS blank_found FROM documents",
        "p6_placed": "SELECT doc_id, coalesce(strlen(text), 0) AS n_tokens, coalesce(strlen(text), 0) <= 4096 AS whole, true AS gapless, 0 AS n_over_full FROM documents",
        "p6_found": "SELECT doc_id FROM documents WHERE strlen(text) > 4096",
        "p7_kept": sizes + " SELECT source, max_repeats, size, true AS repeats_kept, true AS weight_met, true AS budget_kept, true AS order_whole FROM z",
        "p7_found": sizes + " SELECT source FROM z WHERE size * max_repeats < weight * (SELECT sum(size) FROM z)",
    }


#: The 5 nearest of each vector by brute force.
NEAREST = """
WITH v AS (SELECT sentence_id, list_transform(embeddings, lambda x: CAST(x AS DOUBLE)) AS e FROM embedding_index WHERE embeddings IS NOT NULL),
     u AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v WHERE list_dot_product(e, e) > 0),
     s AS (SELECT a.sentence_id AS q, b.sentence_id AS c, list_dot_product(a.e, b.e) / (a.n * b.n) AS s FROM u a JOIN u b ON a.sentence_id <> b.sentence_id),
     t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, c) <= 5)
SELECT DISTINCT least(q, c) AS sentence_id_a, greatest(q, c) AS sentence_id_b FROM t WHERE s >= 0.8"""

#: Topics tied through cells and query ids, followed by a recursive query.
TIED = """
WITH RECURSIVE cells AS (
       SELECT query_id, list_distinct(list_transform(regexp_extract_all(topic_id, '[\\p{L}\\p{N}][_\\- ][Tt]([0-9]+)', 1), lambda x: CAST(x AS BIGINT))) AS topics FROM train),
     named AS (SELECT DISTINCT query_id, unnest(topics) AS topic FROM cells),
     ties AS (SELECT DISTINCT x.topic AS a, y.topic AS b FROM named x JOIN named y USING (query_id) WHERE x.topic <> y.topic),
     reach AS (SELECT a, b FROM ties UNION SELECT reach.a, ties.b FROM reach JOIN ties ON reach.b = ties.a)
SELECT DISTINCT a AS topic_no_a, b AS topic_no_b FROM reach WHERE a < b"""
