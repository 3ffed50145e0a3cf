"""Sources, streams and general relational queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.operators import retrieval as T
from quillstone.operators.order import numbered
from quillstone.sources import loaders as IO
from quillstone.sources.tables import table
from quillstone.streaming import windows as S


def a8_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The corpus, read with its checks, counted per law and page range."""
    c = IO.read_corpus(spark, f"{d}/ris_sentences.parquet")
    return c.groupBy("law_type").agg(F.count(F.lit(1)).alias("n"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))


def a9_bundle(spark: SparkSession, d: str) -> DataFrame:
    t = IO.read_bundle(spark, f"{d}/embedding_index.parquet")
    return t.select("unit_id", F.size("emb").alias("d"), F.round(F.col("emb")[0].cast("double"), 5).alias("first"))


def a10_subset(spark: SparkSession, d: str) -> DataFrame:
    b = IO.read_bundle(spark, f"{d}/embeddings.parquet", False)
    wanted = table(spark, d, "embeddings").where("label = 3").select(F.col("vec_id").alias("unit_id"))
    return IO.subset_by_ids(b, wanted).select("unit_id", F.size("emb").alias("d"))


def a11_queries(spark: SparkSession, d: str) -> DataFrame:
    return IO.usable_queries(table(spark, d, "test")).select("query_id", "consensus_law")


def a14_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return IO.fingerprint_rows(table(spark, d, "ris_sentences"), "sentence_id", "sentence")


def a14_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return IO.fingerprint(table(spark, d, "ris_sentences"), "sentence_id", "sentence")


def a19_report(spark: SparkSession, d: str) -> DataFrame:
    """Results of the crawl: laws fetched, skipped and failed; the best row of a law counts."""
    t = table(spark, d, "download_report").where("law IS NOT NULL").groupBy("law").agg(F.bool_or("ok").alias("ok"), F.count(F.lit(1)).alias("tries"), F.max("pdf_url").alias("pdf_url"))
    state = F.when(~F.coalesce("ok", F.lit(False)), "failed").when(F.col("pdf_url").isNull(), "skipped").otherwise("fetched")
    return t.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("laws"), F.sum("tries").alias("tries"))


def r1_pricing(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(net), 2).alias("sum_disc"), F.round(F.sum(net * (1 + F.col("l_tax"))), 2).alias("sum_charge"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n")
    )


def r3_open_orders(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderdate")
    t = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    t = t.groupBy("l_orderkey", "o_orderdate").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    return t.orderBy(F.desc("revenue"), "l_orderkey").limit(10).select("l_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "revenue")


def r5_regions(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def r_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "train").rollup("style", "consensus_law").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level"))


def r_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.grouping_id().cast("long").alias("level"))


def r_frames(spark: SparkSession, d: str) -> DataFrame:
    """Running and moving sums of events per user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = table(spark, d, "events")
    return t.select("event_id", F.round(F.sum("value").over(w.rowsBetween(-2, 0)), 4).alias("last3"), F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("running"), F.lag("event_type").over(w).alias("before"), F.ntile(4).over(w).alias("quarter"))


def r_sets(spark: SparkSession, d: str) -> DataFrame:
    a, b = (table(spark, d, n).select("consensus_law").where("consensus_law IS NOT NULL").distinct() for n in ("train", "test"))
    tag = lambda t, s: t.select("consensus_law", F.lit(s).alias("side"))
    return tag(a.intersect(b), "both").unionByName(tag(a.subtract(b), "train")).unionByName(tag(b.subtract(a), "test"))


def r_dates(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders")
    return t.groupBy(F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"), F.weekday("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def r_json(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events").select("event_type", F.from_json("props", "k long").alias("p"))
    return t.groupBy("event_type").agg(F.count("p.k").alias("n"), F.min("p.k").alias("least"), F.max("p.k").alias("most"))


def r_asof(spark: SparkSession, d: str) -> DataFrame:
    """The last view of a user before each purchase, by a union and a window instead of a range join."""
    e = table(spark, d, "events")
    both = e.where("event_type IN ('purchase', 'view')").select("event_id", "user_id", "ts", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    t = both.withColumn("view_id", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), True).over(w))
    return t.where("event_type = 'purchase'").select("event_id", "view_id")


def r_numbered(spark: SparkSession, d: str) -> DataFrame:
    return numbered(table(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"], "n", 1).select("event_id", "n")


def _stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def s1_tumbling(spark: SparkSession, d: str) -> DataFrame:
    s = S.windowed_counts(S.read_stream(spark, f"{d}/events.parquet"), "ts", S.tumbling("ts", "6 hours"), "event_type", "value", "365 days")
    return S.run_to_table(s, ["start", "event_type"]).select(_stamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def s2_sliding(spark: SparkSession, d: str) -> DataFrame:
    s = S.windowed_counts(S.read_stream(spark, f"{d}/events.parquet"), "ts", S.sliding("ts", "12 hours", "6 hours"), "event_type", "value", "365 days")
    return S.run_to_table(s, ["start", "event_type"]).select(_stamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def s3_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users: events less than a day apart. By gaps and islands."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = (F.col("ts").cast("double") - F.lag("ts").over(w).cast("double")) >= 86400
    t = e.withColumn("s", F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(w)).groupBy("user_id", "s").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))
    return t.select("user_id", "first_event", "n")


def s3_session_windows(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events").groupBy(S.session("ts", "1 day").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))
    return t.select("user_id", "first_event", "n")


def s4_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval for a stream of query vectors, a micro-batch at a time."""
    e = table(spark, d, "embeddings")
    corpus = e.where("vec_id % 10 <> 0").select(F.col("vec_id").alias("unit_id"), F.col("embedding").alias("emb"))
    stream = S.read_stream(spark, f"{d}/embeddings.parquet").where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("emb"))
    return S.for_each_batch(stream, lambda q: T.topk(q, corpus, 3), ["query_id", "rank"]).select("query_id", "rank", "unit_id", F.round("score", 6).alias("score"))


QUERIES = {f.__name__: f for f in (a8_corpus, a9_bundle, a10_subset, a11_queries, a14_fingerprints, a14_fingerprint, a19_report, r1_pricing, r3_open_orders, r5_regions, r_rollup, r_cube, r_frames, r_sets, r_dates, r_json, r_asof, r_numbered, s1_tumbling, s2_sliding, s3_sessions, s3_session_windows, s4_retrieval)}

_NET = "l_extendedprice * (1 - l_discount)"
_SESSIONS = "WITH e AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events), s AS (SELECT *, sum(CASE WHEN gap >= 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM e) SELECT user_id, min(event_id) AS first_event, count(*) AS n FROM s GROUP BY user_id, s"

ORACLE = {
    "a8_corpus": "SELECT law_type, count(*) AS n, min(page) AS first_page, max(page) AS last_page FROM ris_sentences GROUP BY 1",
    "a9_bundle": "WITH t AS (SELECT sentence_id, list_transform(embeddings, lambda x: CAST(x AS DOUBLE)) AS e FROM embedding_index WHERE embeddings IS NOT NULL) SELECT sentence_id AS unit_id, CAST(len(e) AS INTEGER) AS d, round(CAST(CAST(e[1] / greatest(sqrt(list_dot_product(e, e)), 1e-12) AS FLOAT) AS DOUBLE), 5) AS first FROM t",
    "a10_subset": "SELECT vec_id AS unit_id, CAST(len(embedding) AS INTEGER) AS d FROM embeddings WHERE label = 3",
    "a11_queries": "SELECT query_id, consensus_law FROM test WHERE trim(query_id) <> '' AND trim(query_text) <> '' AND trim(consensus_law) <> ''",
    "a14_fingerprints": r"SELECT sentence_id AS id, sha256(sentence_id || chr(0) || coalesce(sentence, '') || chr(10)) AS digest FROM ris_sentences",
    "a14_fingerprint": "WITH r AS (SELECT sentence_id AS id, sha256(sentence_id || chr(0) || coalesce(sentence, '') || chr(10)) AS digest FROM ris_sentences), b AS (SELECT substr(digest, 1, 2) AS bucket, sha256(string_agg(digest, '' ORDER BY id)) AS d, count(*) AS n FROM r GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(d, '' ORDER BY bucket)) AS fingerprint FROM b",
    "a19_report": "WITH t AS (SELECT law, bool_or(ok) AS ok, count(*) AS tries, max(pdf_url) AS u FROM download_report WHERE law IS NOT NULL GROUP BY 1) SELECT CASE WHEN NOT coalesce(ok, false) THEN 'failed' WHEN u IS NULL THEN 'skipped' ELSE 'fetched' END AS state, count(*) AS laws, CAST(sum(tries) AS BIGINT) AS tries FROM t GROUP BY 1",
    "r1_pricing": f"SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum({_NET}), 2) AS sum_disc, round(sum({_NET} * (1 + l_tax)), 2) AS sum_charge, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "r3_open_orders": f"SELECT l_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, round(sum({_NET}), 2) AS revenue FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1, 2 ORDER BY revenue DESC, l_orderkey LIMIT 10",
    "r5_regions": "SELECT r_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "r_rollup": "SELECT style, consensus_law, count(*) AS n, grouping_id(style, consensus_law) AS level FROM train GROUP BY ROLLUP (style, consensus_law)",
    "r_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, grouping_id(l_returnflag, l_linestatus) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "r_frames": "SELECT event_id, round(sum(value) OVER (w ROWS 2 PRECEDING), 4) AS last3, round(sum(value) OVER (w ROWS UNBOUNDED PRECEDING), 4) AS running, lag(event_type) OVER w AS before, CAST(ntile(4) OVER w AS INTEGER) AS quarter FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "r_sets": "WITH a AS (SELECT DISTINCT consensus_law FROM train WHERE consensus_law IS NOT NULL), b AS (SELECT DISTINCT consensus_law FROM test WHERE consensus_law IS NOT NULL) SELECT consensus_law, CASE WHEN consensus_law IN (SELECT * FROM a) AND consensus_law IN (SELECT * FROM b) THEN 'both' WHEN consensus_law IN (SELECT * FROM a) THEN 'train' ELSE 'test' END AS side FROM (SELECT * FROM a UNION SELECT * FROM b)",
    "r_dates": "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS day, count(*) AS n FROM orders GROUP BY ALL",
    "r_json": "SELECT event_type, count(json_extract(props, '$.k')) AS n, min(CAST(json_extract(props, '$.k') AS BIGINT)) AS least, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS most FROM events GROUP BY 1",
    "r_asof": "SELECT p.event_id, (SELECT v.event_id FROM events v WHERE v.event_type = 'view' AND v.user_id = p.user_id AND (v.ts, v.event_id) < (p.ts, p.event_id) ORDER BY v.ts DESC, v.event_id DESC LIMIT 1) AS view_id FROM events p WHERE p.event_type = 'purchase'",
    "r_numbered": "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS n FROM events",
    "s1_tumbling": "SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "s2_sliding": "WITH w AS (SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOURS * i AS s, event_type, value FROM events, range(2) t(i)) SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2",
    "s3_sessions": _SESSIONS,
    "s3_session_windows": _SESSIONS,
    "s4_retrieval": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, c.vec_id AS unit_id, list_dot_product(q.e, c.e) AS score FROM v q, v c WHERE q.vec_id % 10 = 0 AND c.vec_id % 10 <> 0) SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS INTEGER) AS rank, unit_id, round(score, 6) AS score FROM s QUALIFY rank <= 3",
}
