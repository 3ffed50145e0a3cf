"""Retrieval over the embeddings table and everything that follows from ranked lists.

Rows whose id is divisible by 10 are queries, the others the corpus. Two methods: "dense" uses
whole vectors, "lexical" their first 16 elements, made unit length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import vec
from quillstone.operators import metrics as M
from quillstone.operators import resampling as R
from quillstone.operators import retrieval as T
from quillstone.session import materialize
from quillstone.sources.tables import table

KS = (3, 10, 20)
TAU = 0.1
TAUS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6)
SHORT = 16


def _sides(spark: SparkSession, d: str, method: str = "dense") -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    v = F.col("embedding") if method == "dense" else vec.unit(vec.fix_dimension(F.col("embedding"), SHORT))
    q = e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), v.alias("emb"), F.col("label").alias("gold"))
    c = e.where("vec_id % 10 <> 0").select(F.col("vec_id").alias("unit_id"), v.alias("emb"), "label")
    return q, c


def ranked(spark: SparkSession, d: str, method: str = "dense", k: int = 20) -> DataFrame:
    """One search at the largest k; smaller k are prefixes."""
    q, c = _sides(spark, d, method)
    return T.topk(q, c, k, carry=("label",)).join(q.select("query_id", "gold"), "query_id")


def per_query(spark: SparkSession, d: str, method: str = "dense", ks=KS) -> DataFrame:
    return M.per_query(ranked(spark, d, method, max(ks)), M.prior(_sides(spark, d)[1]), ks, TAU)


def _both(spark: SparkSession, d: str, ks=(10,)) -> DataFrame:
    t = [per_query(spark, d, m, ks).withColumn("method", F.lit(m)) for m in ("dense", "lexical")]
    return materialize(t[0].unionByName(t[1]), "per-query")


def d1_topk(spark: SparkSession, d: str) -> DataFrame:
    return ranked(spark, d, k=10).select("query_id", "rank", "unit_id", F.round("score", 6).alias("score"))


def d1_topk_sql(spark: SparkSession, d: str) -> DataFrame:
    q, c = _sides(spark, d)
    return T.topk(q, c, 10, "sql").select("query_id", "rank", "unit_id", F.round("score", 6).alias("score"))


def d3_align(spark: SparkSession, d: str) -> DataFrame:
    """Passages that both vector tables know (ids of the second are shifted onto the first)."""
    u = table(spark, d, "ris_sentences").select(F.col("sentence_id").alias("unit_id"), F.col("law_type").alias("label"))
    a = table(spark, d, "embedding_index").where("embeddings IS NOT NULL").select(F.col("sentence_id").alias("unit_id"), F.col("embeddings").alias("emb"))
    b = table(spark, d, "embeddings").select((F.col("vec_id") + 1).alias("unit_id"), F.col("embedding").alias("emb"))
    return T.align(u, a, b).select("unit_id", "label", F.size("emb_0").alias("d0"), F.size("emb_1").alias("d1"))


def d4_metadata(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "embedding_index").select("sentence_id")
    return u.join(table(spark, d, "ris_sentences").where("sentence IS NOT NULL"), "sentence_id").select("sentence_id", "law_type", "page")


def d5_known(spark: SparkSession, d: str) -> DataFrame:
    q, c = table(spark, d, "test"), table(spark, d, "ris_sentences")
    known, unknown = T.known_labels(q, c, "consensus_law", "law_type")
    tag = lambda t, s: t.groupBy("consensus_law").agg(F.count(F.lit(1)).alias("n")).withColumn("status", F.lit(s))
    return tag(known, "known").unionByName(tag(unknown, "unknown"))


def d6_unseen(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ris_sentences").select(F.col("law_type").alias("label")).exceptAll(table(spark, d, "train").select("consensus_law")).where("label IS NOT NULL").distinct().join(table(spark, d, "train").select(F.col("consensus_law").alias("label")), "label", "left_anti")


def d7_hits(spark: SparkSession, d: str) -> DataFrame:
    """Ranked hits with their texts, cut."""
    docs = table(spark, d, "documents").select((F.col("doc_id")).alias("unit_id"), "text")
    t = ranked(spark, d, k=5).join(docs, "unit_id")
    return t.select("query_id", "rank", "unit_id", F.round("score", 6).alias("score"), "label", T.shorten(F.col("text")).alias("text"))


def d9_nearest(spark: SparkSession, d: str) -> DataFrame:
    return T.nearest_other(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x")))


def d10_prompts(spark: SparkSession, d: str) -> DataFrame:
    q, c = _sides(spark, d)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), F.col("lang").alias("label"), "text")
    queries = q.select("query_id", F.concat(F.lit("query "), F.col("query_id")).alias("query_text"))
    return T.prompts(T.topk(q, c, 3), queries, docs).select("query_id", "query_text", "prompt", F.array_join("unit_ids", ",").alias("unit_ids"))


def _rounded(t: DataFrame, skip=()) -> DataFrame:
    return t.select(*[F.round(c, 6).alias(c) if k == "double" and c not in skip else F.col(c) for c, k in t.dtypes])


def e1_metrics_mean(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: mean metrics of ranked lists per k."""
    return M.means(per_query(spark, d))


def e1_per_query(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(per_query(spark, d).select("k", "query_id", *M.METRICS))


def e2_prior(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.prior(table(spark, d, "ris_sentences"), "law_type"))


def e3_majority(spark: SparkSession, d: str) -> DataFrame:
    return per_query(spark, d, ks=(10,)).select("query_id", "maj_label", F.round("maj_frac", 6).alias("maj_frac"))


def e4_votes(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(per_query(spark, d, ks=(10,)).select("query_id", "maj_frac", "maj_correct", "margin", "entropy", "n_unique"))


def e5_curve(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.threshold_curve(per_query(spark, d, ks=(10,)), TAUS))


def e6_recommend(spark: SparkSession, d: str) -> DataFrame:
    grid = sorted({round(i / 100, 2) for i in range(101)} | set(TAUS))
    curve = materialize(M.threshold_curve(per_query(spark, d, ks=(10,)), grid), "curve")
    t = [M.recommend_threshold(curve, c, by).withColumn("by", F.lit(by)).withColumn("min_coverage", F.lit(c)) for by in ("prec", "acc") for c in (0.2, 2.0)]
    return _rounded(t[0].unionByName(t[1]).unionByName(t[2]).unionByName(t[3]))


def e7_decomposition(spark: SparkSession, d: str) -> DataFrame:
    curve = M.threshold_curve(_both(spark, d), TAUS, ["method"])
    return _rounded(M.decompose(curve, "dense", "lexical"))


def e8_profile(spark: SparkSession, d: str) -> DataFrame:
    """Means and percentiles of the majority share, and how often all labels agree."""
    q = per_query(spark, d, ks=(10,))
    t = q.agg(F.avg("maj_frac").alias("mean_frac"), F.percentile("maj_frac", F.array(F.lit(0.5), F.lit(0.75), F.lit(0.9))).alias("p"), F.avg((F.col("maj_frac") >= 1 - 1e-12).cast("double")).alias("all_one"), F.avg("margin").alias("margin"), F.avg("entropy").alias("entropy"))
    return _rounded(t.select("mean_frac", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p75"), F.col("p")[2].alias("p90"), "all_one", "margin", "entropy"))


def e9_overlap(spark: SparkSession, d: str) -> DataFrame:
    t = [ranked(spark, d, m, 10).withColumn("method", F.lit(m)) for m in ("dense", "lexical")]
    return _rounded(M.set_overlap(t[0].unionByName(t[1]), "dense", "lexical", 10))


def e10_macro(spark: SparkSession, d: str) -> DataFrame:
    return M.macro_means(per_query(spark, d))


def e11_strata(spark: SparkSession, d: str) -> DataFrame:
    q = per_query(spark, d, ks=(10,))
    groups = {"full": F.lit(True), "low": F.col("gold") < 5, "even": F.col("query_id") % 20 == 0, "none": F.lit(False)}
    return M.means(M.strata(q, groups), ["stratum"])


def e12_deltas(spark: SparkSession, d: str) -> DataFrame:
    return M.deltas(_both(spark, d, KS), "dense")


def e13_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Whether "dense" is better than "lexical" in all metrics, by portable intervals."""
    q = _both(spark, d)
    a, b = q.where("method = 'dense'"), q.where("method = 'lexical'")
    cis = None
    for m in M.METRICS:
        ci = R.paired_delta_ci(a, b, "query_id", m, 100).select(F.lit(10).alias("k"), F.lit(m).alias("metric"), "pt", "lo", "hi")
        cis = ci if cis is None else cis.unionByName(ci)
    return M.verdict(cis)


def e14_summary(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "train")
    return M.query_set_summary(t, "style").withColumnRenamed("style", "value").withColumn("of", F.lit("style")).unionByName(M.query_set_summary(t, "consensus_law").withColumnRenamed("consensus_law", "value").withColumn("of", F.lit("law")))


def e15_hygiene(spark: SparkSession, d: str) -> DataFrame:
    return M.split_hygiene(table(spark, d, "train"), table(spark, d, "test"))


def e17_histogram(spark: SparkSession, d: str) -> DataFrame:
    """The labels chosen most often."""
    n = per_query(spark, d, ks=(10,)).groupBy("maj_label").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "maj_label").limit(8)


def e18_rank_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs (here: methods and k) by quality."""
    from pyspark.sql import Window

    t = M.means(_both(spark, d, KS), ["method", "k"], ("mrr", "hit"))
    return t.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mrr"), F.desc("hit"), "method", "k")))  # as many rows as runs


def _ci(t: DataFrame, name: str) -> DataFrame:
    return t.select(F.lit(name).alias("what"), "pt", "lo", "hi")


def f1_mean_ci(spark: SparkSession, d: str) -> DataFrame:
    return R.mean_ci(table(spark, d, "embeddings"), F.col("label"), ["vec_id"], 200, 0)


def f1_numpy_ci(spark: SparkSession, d: str) -> DataFrame:
    return R.numpy_ci(per_query(spark, d), ["k"], "mrr", "query_id")


def f2_paired_ci(spark: SparkSession, d: str) -> DataFrame:
    q = _both(spark, d)
    return R.paired_delta_ci(q.where("method = 'dense'"), q.where("method = 'lexical'"), "query_id", "mrr", 200, 1)


def f3_macro_ci(spark: SparkSession, d: str) -> DataFrame:
    return R.macro_mean_ci(per_query(spark, d, ks=(10,)), F.col("mrr"), "gold", 200, 2)


def f4_macro_paired_ci(spark: SparkSession, d: str) -> DataFrame:
    q = _both(spark, d)
    return R.macro_paired_delta_ci(q.where("method = 'dense'"), q.where("method = 'lexical'"), "query_id", "mrr", "gold", 200, 3)


def f5_ratio_ci(spark: SparkSession, d: str) -> DataFrame:
    q = per_query(spark, d, ks=(10,))
    over = (F.col("maj_frac") >= 0.3).cast("double")
    return R.ratio_ci(q, over * F.col("maj_correct"), over, ["query_id"], 200, 4)


def f6_decomposition_ci(spark: SparkSession, d: str) -> DataFrame:
    q = _both(spark, d)
    return R.decomposition_ci(q.where("method = 'dense'"), q.where("method = 'lexical'"), "query_id", 0.3, 200, 5)


def g6_long(spark: SparkSession, d: str) -> DataFrame:
    return M.long_format(e1_metrics_mean(spark, d), ["k"], M.METRICS)


QUERIES = {f.__name__: f for f in (d1_topk, d1_topk_sql, d3_align, d4_metadata, d5_known, d6_unseen, d7_hits, d9_nearest, d10_prompts, e1_metrics_mean, e1_per_query, e2_prior, e3_majority, e4_votes, e5_curve, e6_recommend, e7_decomposition, e8_profile, e9_overlap, e10_macro, e11_strata, e12_deltas, e13_verdict, e14_summary, e15_hygiene, e17_histogram, e18_rank_runs, f1_mean_ci, f1_numpy_ci, f2_paired_ci, f3_macro_ci, f4_macro_paired_ci, f5_ratio_ci, f6_decomposition_ci, g6_long)}

_DOUBLES = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
_FIRST = f"list_transform(embedding[1:{SHORT}], lambda x: CAST(x AS DOUBLE))"


def _ranked_sql(name: str, v: str, k: int) -> str:
    return f"""
v_{name} AS (SELECT vec_id, label, {v} AS e FROM embeddings),
s_{name} AS (SELECT q.vec_id AS query_id, q.label AS gold, c.vec_id AS unit_id, c.label AS label, list_dot_product(q.e, c.e) / {'1' if name == 'dense' else 'sqrt(list_dot_product(q.e, q.e) * list_dot_product(c.e, c.e))'} AS score
  FROM v_{name} q, v_{name} c WHERE q.vec_id % 10 = 0 AND c.vec_id % 10 <> 0),
r_{name} AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS INTEGER) AS rank FROM s_{name} QUALIFY rank <= {k}),"""


def _per_query_sql(name: str) -> str:
    return f"""
lc_{name} AS (SELECT k, query_id, gold, label, count(*) AS cnt, min(rank) AS fr FROM r_{name}, ks WHERE rank <= k GROUP BY ALL),
m_{name} AS (SELECT k, query_id, label AS maj_label, cnt AS c1, row_number() OVER w AS r, lead(cnt) OVER w AS c2 FROM lc_{name} WINDOW w AS (PARTITION BY k, query_id ORDER BY cnt DESC, fr)),
n_{name} AS (SELECT k, query_id, gold, sum(cnt) AS n, count(*) AS n_unique, max(cnt) FILTER (label = gold) AS gc, max(fr) FILTER (label = gold) AS gf FROM lc_{name} GROUP BY ALL),
o_{name} AS (SELECT n.k, n.query_id, -sum(l.cnt / n.n * ln(l.cnt / n.n)) AS entropy, count(*) FILTER (l.fr < n.gf) AS before FROM n_{name} n JOIN lc_{name} l USING (k, query_id) GROUP BY ALL),
q_{name} AS (SELECT n.k, n.query_id, n.gold, CAST(coalesce(gc, 0) > 0 AS DOUBLE) AS hit, CAST(coalesce(gf = 1, false) AS DOUBLE) AS top1,
  CAST(maj_label = gold AND c1 / n >= {TAU} AS DOUBLE) AS majority, coalesce(gc, 0) / n AS cons_frac,
  CASE WHEN coalesce(prior, 0) > 0 THEN coalesce(gc, 0) / n / prior ELSE 0 END AS lift, CASE WHEN gf IS NULL THEN 0 ELSE 1 / (1 + before) END AS mrr,
  maj_label, CAST(maj_label = gold AS DOUBLE) AS maj_correct, c1 / n AS maj_frac, c1 / n - coalesce(c2, 0) / n AS margin, entropy, CAST(n_unique AS INTEGER) AS n_unique
  FROM n_{name} n JOIN m_{name} m ON n.k = m.k AND n.query_id = m.query_id AND m.r = 1 JOIN o_{name} o ON n.k = o.k AND n.query_id = o.query_id LEFT JOIN priors p ON p.label = n.gold),"""


def _with(ks, k=None, lexical=False) -> str:
    k = k or max(ks)
    head = f"WITH ks AS (SELECT unnest([{', '.join(map(str, ks))}]) AS k), priors AS (SELECT label, count(*) / (SELECT count(*) FROM embeddings WHERE vec_id % 10 <> 0) AS prior FROM embeddings WHERE vec_id % 10 <> 0 GROUP BY 1),"
    head += _ranked_sql("dense", _DOUBLES, k) + _per_query_sql("dense")
    if lexical:
        head += _ranked_sql("lexical", _FIRST, k) + _per_query_sql("lexical")
    return head


_MEANS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in M.METRICS)


def _boot(seed: int, n_boot: int, base: str, sums: dict[str, str]) -> str:
    """CTEs x (numbered rows i, n) and reps (b, n, sums) over a query `base` with columns o (order) and the sums."""
    return f"""
x AS (SELECT *, row_number() OVER (ORDER BY o) - 1 AS i, count(*) OVER () AS n FROM ({base})),
dr AS (SELECT b, ('0x' || substr(md5('{seed}|' || b || '|' || j), 1, 8))::BIGINT % n AS i FROM (SELECT max(n) AS n FROM x), range({n_boot}) t(b), range((SELECT max(n) FROM x)) u(j)),
reps AS (SELECT b, count(*) AS n, {', '.join(f'sum({e}) AS {s}' for s, e in sums.items())} FROM dr JOIN x USING (i) GROUP BY b)"""


def _interval(value: str, point: str) -> str:
    return f"round({point}, 6) AS pt, (SELECT round(quantile_cont({value}, 0.025), 6) FROM reps) AS lo, (SELECT round(quantile_cont({value}, 0.975), 6) FROM reps) AS hi"


_CURVE = "curve_{0} AS (SELECT tau, avg(CAST(maj_frac >= tau AS DOUBLE)) AS cov, avg(CAST(maj_frac >= tau AND maj_correct = 1 AS DOUBLE)) AS acc, acc / nullif(cov, 0) AS prec FROM q_{0}, taus GROUP BY 1)"
_TAUS = f"taus AS (SELECT unnest([{', '.join(map(str, TAUS))}]) ::DOUBLE AS tau),"
_GRID = sorted({round(i / 100, 2) for i in range(101)} | set(TAUS))
_GRIDS = f"taus AS (SELECT unnest([{', '.join(map(str, _GRID))}]) ::DOUBLE AS tau),"
_PAIR = "(SELECT a.query_id AS o, a.gold, a.{0} - b.{0} AS v, * FROM q_dense a JOIN q_lexical b USING (k, query_id))"


def _verdict_sql() -> str:
    parts = []
    for m in M.METRICS:
        parts.append(f"SELECT quantile_cont(s, 0.025) AS lo, quantile_cont(s, 0.975) AS hi FROM (SELECT b, avg({m}) AS s FROM dr JOIN x USING (i) GROUP BY b)")
    base = "SELECT a.query_id AS o, " + ", ".join(f"a.{m} - b.{m} AS {m}" for m in M.METRICS) + " FROM q_dense a JOIN q_lexical b USING (k, query_id)"
    return _with((10,), lexical=True) + _boot(0, 100, base, {"s": "1"}) + ", cis AS (" + " UNION ALL ".join(parts) + ") SELECT 10 AS k, count(*) AS n, bool_and(round(lo, 6) > 0) AS supported, count(*) FILTER (round(lo, 6) > 0 OR round(hi, 6) < 0) AS significant FROM cis"


ORACLE = {
    "d1_topk": "WITH" + _ranked_sql("dense", _DOUBLES, 10) + " z AS (SELECT 1) SELECT query_id, rank, unit_id, round(score, 6) AS score FROM r_dense",
    "d3_align": "SELECT s.sentence_id AS unit_id, law_type AS label, CAST(len(i.embeddings) AS INTEGER) AS d0, CAST(len(e.embedding) AS INTEGER) AS d1 FROM ris_sentences s JOIN embedding_index i ON s.sentence_id = i.sentence_id AND i.embeddings IS NOT NULL JOIN embeddings e ON e.vec_id + 1 = s.sentence_id",
    "d4_metadata": "SELECT i.sentence_id, law_type, page FROM embedding_index i JOIN ris_sentences s USING (sentence_id) WHERE sentence IS NOT NULL",
    "d5_known": "SELECT consensus_law, count(*) AS n, CASE WHEN consensus_law IN (SELECT law_type FROM ris_sentences WHERE law_type IS NOT NULL) THEN 'known' ELSE 'unknown' END AS status FROM test GROUP BY 1, 3",
    "d6_unseen": "SELECT law_type AS label FROM ris_sentences WHERE law_type IS NOT NULL EXCEPT SELECT consensus_law FROM train",
    "d7_hits": "WITH" + _ranked_sql("dense", _DOUBLES, 5) + " z AS (SELECT 1) SELECT query_id, rank, unit_id, round(score, 6) AS score, label, CASE WHEN length(text) > 401 THEN substr(text, 1, 400) || '…' ELSE text END AS text FROM r_dense JOIN documents ON doc_id = unit_id",
    "d9_nearest": f"WITH v AS (SELECT vec_id, {_DOUBLES} AS e FROM embeddings) SELECT a.vec_id AS id, b.vec_id AS other FROM v a JOIN v b ON a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) = 1",
    "d10_prompts": "WITH"
    + _ranked_sql("dense", _DOUBLES, 3)
    + " h AS (SELECT query_id, rank, unit_id, lang, trim(replace(text, chr(10), ' ')) AS t FROM r_dense JOIN documents ON doc_id = unit_id AND text IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM h), l AS (SELECT query_id, rank, unit_id, '[' || i || '] (' || coalesce(lang, '?') || ') ' || CASE WHEN length(t) > 5000 THEN rtrim(substr(t, 1, 4997)) || '...' ELSE t END AS line FROM n) SELECT query_id, 'query ' || query_id AS query_text, 'Antworte auf Deutsch und nur aus den Fundstellen.' || chr(10) || 'Frage: query ' || query_id || chr(10) || string_agg(line, chr(10) ORDER BY rank) AS prompt, string_agg(CAST(unit_id AS VARCHAR), ',' ORDER BY rank) AS unit_ids FROM l GROUP BY query_id",
    "e1_metrics_mean": _with(KS) + f" z AS (SELECT 1) SELECT k, count(*) AS n_queries, {_MEANS} FROM q_dense GROUP BY 1",
    "e1_per_query": _with(KS) + f" z AS (SELECT 1) SELECT k, query_id, {', '.join(f'round({m}, 6) AS {m}' for m in M.METRICS)} FROM q_dense",
    "e2_prior": "SELECT law_type AS label, count(*) AS n, round(count(*) / (SELECT count(*) FROM ris_sentences), 6) AS prior FROM ris_sentences GROUP BY 1",
    "e3_majority": _with((10,)) + " z AS (SELECT 1) SELECT query_id, maj_label, round(maj_frac, 6) AS maj_frac FROM q_dense",
    "e4_votes": _with((10,)) + " z AS (SELECT 1) SELECT query_id, round(maj_frac, 6) AS maj_frac, maj_correct, round(margin, 6) AS margin, round(entropy, 6) AS entropy, n_unique FROM q_dense",
    "e5_curve": _with((10,)) + _TAUS + _CURVE.format("dense") + " SELECT tau, round(cov, 6) AS cov, round(acc, 6) AS acc, round(prec, 6) AS prec FROM curve_dense",
    "e6_recommend": _with((10,))
    + _GRIDS
    + _CURVE.format("dense")
    + ", wants AS (SELECT * FROM (VALUES ('prec', 0.2), ('prec', 2.0), ('acc', 0.2), ('acc', 2.0)) t(\"by\", min_coverage)) SELECT tau, round(cov, 6) AS cov, round(acc, 6) AS acc, round(prec, 6) AS prec, \"by\", CAST(min_coverage AS DOUBLE) AS min_coverage FROM curve_dense, wants QUALIFY row_number() OVER (PARTITION BY \"by\", min_coverage ORDER BY cov >= min_coverage DESC, CASE WHEN \"by\" = 'prec' THEN prec ELSE acc END DESC NULLS LAST, CASE WHEN \"by\" = 'prec' THEN acc ELSE prec END DESC NULLS LAST, tau) = 1",
    "e7_decomposition": _with((10,), lexical=True)
    + _TAUS
    + _CURVE.format("dense")
    + ","
    + _CURVE.format("lexical")
    + " SELECT tau, round(a.acc - b.acc, 6) AS d_acc, round((a.cov - b.cov) * (coalesce(a.prec, 0) + coalesce(b.prec, 0)) / 2, 6) AS cov_part, round((coalesce(a.prec, 0) - coalesce(b.prec, 0)) * (a.cov + b.cov) / 2, 6) AS prec_part FROM curve_dense a JOIN curve_lexical b USING (tau)",
    "e8_profile": _with((10,)) + " z AS (SELECT 1) SELECT round(avg(maj_frac), 6) AS mean_frac, round(quantile_cont(maj_frac, 0.5), 6) AS p50, round(quantile_cont(maj_frac, 0.75), 6) AS p75, round(quantile_cont(maj_frac, 0.9), 6) AS p90, round(avg(CAST(maj_frac >= 1 - 1e-12 AS DOUBLE)), 6) AS all_one, round(avg(margin), 6) AS margin, round(avg(entropy), 6) AS entropy FROM q_dense",
    "e9_overlap": "WITH"
    + _ranked_sql("dense", _DOUBLES, 10)
    + _ranked_sql("lexical", _FIRST, 10)
    + " a AS (SELECT query_id, list(DISTINCT unit_id) AS u, list(DISTINCT label) AS l FROM r_dense GROUP BY 1), b AS (SELECT query_id, list(DISTINCT unit_id) AS u, list(DISTINCT label) AS l FROM r_lexical GROUP BY 1) SELECT query_id, round(len(list_intersect(a.u, b.u)) / len(list_distinct(a.u || b.u)), 6) AS jaccard, round(len(list_intersect(a.u, b.u)) / 10, 6) AS overlap, round(len(list_intersect(a.l, b.l)) / len(list_distinct(a.l || b.l)), 6) AS label_jaccard FROM a JOIN b USING (query_id)",
    "e10_macro": _with(KS) + f" by_label AS (SELECT k, gold, {', '.join(f'avg({m}) AS {m}' for m in M.METRICS)} FROM q_dense GROUP BY ALL) SELECT k, count(*) AS n_labels, {_MEANS} FROM by_label GROUP BY 1",
    "e11_strata": _with((10,)) + f" t AS (SELECT 'full' AS stratum, * FROM q_dense UNION ALL SELECT 'low', * FROM q_dense WHERE gold < 5 UNION ALL SELECT 'even', * FROM q_dense WHERE query_id % 20 = 0) SELECT stratum, count(*) AS n_queries, {_MEANS} FROM t GROUP BY 1",
    "e12_deltas": _with(KS, lexical=True) + " t AS (SELECT k, " + ", ".join(f"avg(b.{m} - a.{m}) AS {m}" for m in M.METRICS) + f" FROM q_dense a JOIN q_lexical b USING (k, query_id) GROUP BY 1) SELECT k, 'lexical' AS method, metric, round(delta, 6) AS delta FROM t UNPIVOT (delta FOR metric IN ({', '.join(M.METRICS)}))",
    "e13_verdict": _verdict_sql(),
    "e14_summary": "SELECT style AS value, count(*) AS n, count(DISTINCT query_text) AS n_texts, count(DISTINCT topic_id) AS n_topics, 'style' AS \"of\" FROM train GROUP BY 1 UNION ALL SELECT consensus_law, count(*), count(DISTINCT query_text), count(DISTINCT topic_id), 'law' FROM train GROUP BY 1",
    "e15_hygiene": "SELECT *, round(topic_id_overlap / test_topics, 6) AS topic_share FROM (SELECT (SELECT count(*) FROM (SELECT query_text FROM train WHERE query_text IS NOT NULL INTERSECT SELECT query_text FROM test)) AS query_text_overlap, (SELECT count(*) FROM (SELECT topic_id FROM train WHERE topic_id IS NOT NULL INTERSECT SELECT topic_id FROM test)) AS topic_id_overlap, (SELECT count(DISTINCT topic_id) FROM test) AS test_topics)",
    "e17_histogram": _with((10,)) + " z AS (SELECT 1) SELECT maj_label, count(*) AS n FROM q_dense GROUP BY 1 ORDER BY n DESC, maj_label LIMIT 8",
    "e18_rank_runs": _with(KS, lexical=True) + " t AS (SELECT 'dense' AS method, * FROM q_dense UNION ALL SELECT 'lexical', * FROM q_lexical), u AS (SELECT method, k, count(*) AS n_queries, round(avg(mrr), 6) AS mrr, round(avg(hit), 6) AS hit FROM t GROUP BY ALL) SELECT *, CAST(row_number() OVER (ORDER BY mrr DESC, hit DESC, method, k) AS INTEGER) AS place FROM u",
    "f1_mean_ci": "WITH" + _boot(0, 200, "SELECT vec_id AS o, label AS v FROM embeddings", {"s": "v"}) + " SELECT " + _interval("s / n", "(SELECT avg(v) FROM x)"),
    "f2_paired_ci": _with((10,), lexical=True) + _boot(1, 200, "SELECT a.query_id AS o, a.mrr - b.mrr AS v FROM q_dense a JOIN q_lexical b USING (k, query_id)", {"s": "v"}) + " SELECT " + _interval("s / n", "(SELECT avg(v) FROM x)"),
    "f3_macro_ci": _with((10,)) + _boot(2, 200, "SELECT gold AS o, avg(mrr) AS v FROM q_dense GROUP BY 1", {"s": "v"}) + " SELECT " + _interval("s / n", "(SELECT avg(v) FROM x)"),
    "f4_macro_paired_ci": _with((10,), lexical=True) + _boot(3, 200, "SELECT a.gold AS o, avg(a.mrr - b.mrr) AS v FROM q_dense a JOIN q_lexical b USING (k, query_id) GROUP BY 1", {"s": "v"}) + " SELECT " + _interval("s / n", "(SELECT avg(v) FROM x)"),
    "f5_ratio_ci": _with((10,)) + _boot(4, 200, "SELECT query_id AS o, CAST(maj_frac >= 0.3 AS DOUBLE) AS u, u * maj_correct AS t FROM q_dense", {"t": "t", "u": "u"}) + " SELECT " + _interval("t / nullif(u, 0)", "(SELECT sum(t) / nullif(sum(u), 0) FROM x)"),
    "f6_decomposition_ci": _with((10,), lexical=True)
    + _boot(5, 200, "SELECT a.query_id AS o, CAST(a.maj_frac >= 0.3 AS DOUBLE) AS ca, ca * a.maj_correct AS aa, CAST(b.maj_frac >= 0.3 AS DOUBLE) AS cb, cb * b.maj_correct AS ab FROM q_dense a JOIN q_lexical b USING (k, query_id)", {"ca": "ca", "aa": "aa", "cb": "cb", "ab": "ab"})
    + ", w AS (SELECT count(*) AS n, sum(ca) AS ca, sum(aa) AS aa, sum(cb) AS cb, sum(ab) AS ab FROM x), p AS (SELECT 0 AS whole, n, ca, aa, cb, ab FROM reps UNION ALL SELECT 1, * FROM w), y AS (SELECT whole, coalesce(aa / nullif(ca, 0), 0) AS pa, coalesce(ab / nullif(cb, 0), 0) AS pb, (aa - ab) / n AS accuracy, (ca - cb) / n * (pa + pb) / 2 AS coverage, (pa - pb) * (ca + cb) / n / 2 AS precision FROM p), long AS (SELECT whole, part, v FROM y UNPIVOT (v FOR part IN (accuracy, coverage, precision)))"
    + " SELECT part, round(max(v) FILTER (whole = 1), 6) AS pt, round(quantile_cont(v, 0.025) FILTER (whole = 0), 6) AS lo, round(quantile_cont(v, 0.975) FILTER (whole = 0), 6) AS hi FROM long GROUP BY 1",
    "g6_long": _with(KS) + f" t AS (SELECT k, {_MEANS} FROM q_dense GROUP BY 1) SELECT k, metric, value FROM t UNPIVOT (value FOR metric IN ({', '.join(M.METRICS)}))",
}
ORACLE["d1_topk_sql"] = ORACLE["d1_topk"]
