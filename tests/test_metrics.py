"""Hand-computed values and properties of ranked-list metrics."""

import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import metrics as M
from quillstone.operators import resampling as R
from quillstone.operators import retrieval as T

LISTS = {"q1": ("BABAC", "A"), "q2": ("CCAAB", "A"), "q3": ("BBBAA", "C"), "q4": ("ABABC", "B"), "q5": ("BBBAA", "B")}


def ranked(spark, lists=LISTS, extra=()):
    rows = [(q, i + 1, c, gold) for q, (s, gold) in lists.items() for i, c in enumerate(s)]
    return spark.createDataFrame([*rows, *extra], "query_id string, rank int, label string, gold string")


def priors(spark):
    return spark.createDataFrame([("A", 5, 0.5), ("B", 3, 0.3), ("C", 2, 0.2)], "label string, n int, prior double")


def test_fixture_rows(spark):
    got = {r["query_id"]: r for r in M.per_query(ranked(spark), priors(spark), [5], 0.1).collect()}
    want = {
        "q1": (1, 0, 0, 0.4, 0.8, 0.5, "B", 0.4, 0.0, 1.054920, 3),
        "q2": (1, 0, 0, 0.4, 0.8, 0.5, "C", 0.4, 0.0, 1.054920, 3),
        "q3": (0, 0, 0, 0.0, 0.0, 0.0, "B", 0.6, 0.2, 0.673012, 2),
        "q4": (1, 0, 0, 0.4, 1.333333, 0.5, "A", 0.4, 0.0, 1.054920, 3),
        "q5": (1, 1, 1, 0.6, 2.0, 1.0, "B", 0.6, 0.2, 0.673012, 2),
    }
    for q, w in want.items():
        r = got[q]
        have = (r["hit"], r["top1"], r["majority"], r["cons_frac"], r["lift"], r["mrr"], r["maj_label"], r["maj_frac"], r["margin"], r["entropy"], r["n_unique"])
        assert have == tuple(pytest.approx(x, abs=1e-5) if isinstance(x, float) else x for x in w), q


def test_thresholds_and_recommendation(spark):
    q = M.per_query(ranked(spark), priors(spark), [5])
    curve = M.threshold_curve(q, [0.4, 0.5, 0.6, 0.7])
    got = {round(r["tau"], 1): (r["cov"], r["acc"], r["prec"]) for r in curve.collect()}
    assert got[0.4] == pytest.approx((1.0, 0.2, 0.2)) and got[0.5] == pytest.approx((0.4, 0.2, 0.5)) and got[0.6] == pytest.approx((0.4, 0.2, 0.5))
    assert got[0.7] == (0, 0, None)
    assert M.recommend_threshold(curve, 0.4).first()["tau"] == 0.5
    assert M.recommend_threshold(curve, 2.0).first()["tau"] == 0.5  # no threshold covers enough: the same order without it
    assert M.recommend_threshold(curve, 0.4, "acc").first()["tau"] == 0.5


def test_decomposition_adds_up(spark):
    c = spark.createDataFrame([("a", 0.41, 0.562, 0.346, 0.346 / 0.562), ("b", 0.41, 0.525, 0.308, 0.308 / 0.525)], "method string, tau double, cov double, acc double, prec double")
    r = M.decompose(c, "a", "b").first()
    assert r["d_acc"] == pytest.approx(0.038) and r["cov_part"] == pytest.approx(0.022243, abs=1e-5) and r["prec_part"] == pytest.approx(0.015757, abs=1e-5)


def test_short_single_and_empty_lists(spark):
    lists = {"one": ("AAA", "A"), "miss": ("B", "A")}
    got = {r["query_id"]: r for r in M.per_query(ranked(spark, lists), priors(spark), [10]).collect()}
    assert got["one"]["margin"] == got["one"]["maj_frac"] == 1 and got["one"]["entropy"] == 0 and got["one"]["n"] == 3
    assert got["miss"]["hit"] == 0 and got["miss"]["mrr"] == 0
    assert M.per_query(ranked(spark, {}), priors(spark), [10]).count() == 0
    assert M.means(M.per_query(ranked(spark, {}), priors(spark), [10])).count() == 0


def test_bounds_and_prefixes(spark):
    rng = random.Random(1)
    lists = {f"q{i}": ("".join(rng.choice("ABC") for _ in range(rng.randint(1, 12))), rng.choice("ABC")) for i in range(60)}
    rows = M.per_query(ranked(spark, lists), priors(spark), [1, 3, 10]).collect()
    by = {(r["k"], r["query_id"]): r for r in rows}
    for r in rows:
        assert 0 <= r["cons_frac"] <= 1 and 0 <= r["margin"] <= r["maj_frac"] <= 1 and r["majority"] <= r["hit"] and r["top1"] <= r["mrr"] <= 1
    assert all(by[3, q]["hit"] >= by[1, q]["hit"] for q in lists)


@pytest.mark.parametrize("strategy", ["sql", "blocks"])
def test_topk_ties_blocks_and_short_corpora(spark, strategy, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 7)
    c = spark.createDataFrame([(i, [float(i % 3), 1.0], "x") for i in range(40)] + [(99, None, "n")], "unit_id long, emb array<float>, label string")
    q = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", None)], "query_id string, emb array<float>")
    got = {}
    for r in T.topk(q, c, 4, strategy).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["unit_id"])
    assert got == {"a": [2, 5, 8, 11], "b": [0, 1, 2, 3]}
    assert T.topk(q, c.limit(0), 4, strategy).count() == 0
    assert T.topk(q, c.where("unit_id < 2"), 4, strategy).count() == 4


def test_topk_is_the_same_on_any_partitions(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(200)]
    c = spark.createDataFrame(rows, "unit_id long, emb array<float>")
    q = c.where("unit_id % 20 = 0").withColumnRenamed("unit_id", "query_id")
    one = T.topk(q, c.repartition(1), 5).collect()
    many = T.topk(q.repartition(5), c.repartition(8), 5).collect()
    key = lambda t: sorted((r["query_id"], r["rank"], r["unit_id"]) for r in t)
    assert key(one) == key(many) == key(T.topk(q, c, 5, "sql").collect())


def test_topk_streams_the_corpus_past_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 5)
    monkeypatch.setattr(T, "GROUP", 2)
    rng = random.Random(3)
    c = spark.createDataFrame([(f"u{i:03d}", [float(rng.randrange(-2, 3)) for _ in range(4)]) for i in range(150)], "unit_id string, emb array<float>").repartition(3)
    q = c.limit(31).withColumnRenamed("unit_id", "query_id")
    got = T.topk(q, c, 4)
    assert "CoGroups" not in got._jdf.queryExecution().toString()  # no copies of the corpus for each block
    key = lambda t: sorted((r["query_id"], r["rank"], r["unit_id"], r["score"]) for r in t.collect())
    assert key(got) == key(T.topk(q, c, 4, "sql"))
    assert T.topk(q.limit(0), c, 4).count() == 0


def test_nearest_other(spark):
    p = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [5.0, 5.0]), (4, [5.0, 5.0])], "id long, x array<float>")
    assert {(r["id"], r["other"]) for r in T.nearest_other(p).collect()} == {(1, 2), (2, 1), (3, 4), (4, 3)}
    assert [(r["id"], r["other"]) for r in T.nearest_other(p.limit(1)).collect()] == [(1, 1)]


def test_portable_bootstrap(spark):
    import hashlib

    x = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0]
    df = spark.createDataFrame(list(enumerate(x)), "id long, v double").repartition(3)
    means = []
    for b in range(50):
        at = [int(hashlib.md5(f"7|{b}|{j}".encode()).hexdigest()[:8], 16) % len(x) for j in range(len(x))]
        means.append(sum(x[i] for i in at) / len(x))
    import numpy as np

    r = R.mean_ci(df, F.col("v"), ["id"], 50, 7).first()
    assert (r["pt"], r["lo"], r["hi"]) == pytest.approx((sum(x) / 7, np.quantile(means, 0.025), np.quantile(means, 0.975)), abs=1e-6)
    empty = R.mean_ci(df.limit(0), F.col("v"), ["id"]).first()
    assert empty["pt"] is None and empty["lo"] is None
    z = R.ratio_ci(df, F.lit(0.0), F.lit(0.0), ["id"], 20).first()
    assert z["pt"] is None and z["lo"] is None


def test_numpy_bootstrap_is_repeatable(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(20)], "g string, id long, v double")
    one, two = R.numpy_ci(df, ["g"], "v", "id").first(), R.numpy_ci(df.repartition(4), ["g"], "v", "id").first()
    assert one == two and one["lo"] < one["pt"] == 9.5 < one["hi"]


def test_strata_overlap_and_verdict(spark):
    df = spark.createDataFrame([(1, "s"), (2, "t"), (3, None)], "id long, style string")
    got = {(r["id"], r["stratum"]) for r in M.strata(df, {"all": F.lit(True), "odd": F.col("id") % 2 == 1, "none": F.lit(None).cast("boolean")}, "style").collect()}
    assert got == {(1, "all"), (1, "odd"), (1, "style/s"), (2, "all"), (2, "style/t"), (3, "all"), (3, "odd")}
    cis = spark.createDataFrame([(5, "a", 1.0, 0.1, 2.0), (5, "b", 1.0, -0.1, 2.0), (9, "a", -1.0, -2.0, -0.5)], "k int, metric string, pt double, lo double, hi double")
    assert {(r["k"], r["supported"], r["significant"]) for r in M.verdict(cis).collect()} == {(5, False, 1), (9, False, 1)}
