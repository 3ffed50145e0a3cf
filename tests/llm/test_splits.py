import random
from collections import Counter, defaultdict

from quillstone.llm import splits

SCHEMA = "query_id string, topic_id string, consensus_law string, unit string, split string"


def tied_pairs(topics):
    a, b = topics.withColumnRenamed("node", "a"), topics.withColumnRenamed("node", "b")
    return a.join(b, "root").where("a < b").select("a", "b")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "u", "s") for r in rows], SCHEMA)


def union_find(ties):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in ties:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {x: find(x) for x in up}


def test_topic_numbers(spark):
    cells = ["LATStG_T00001125", " Quell-VO-T671 ", "ab T7 (v2)", "MÜH_t00000873 #2024", "A_T1|B_T2", "A_T1\nA_T00001", "A_T5 rev. 3", "T5", "", None, "A_T99999999999999999999", "A_T5x", "A_X_T6"]
    df = spark.createDataFrame([(c,) for c in cells], "topic_id string").select(splits.topic_numbers())
    assert [r[0] for r in df.collect()] == [[1125], [671], [7], [873], [1, 2], [1], [5], [], [], None, [], [], [6]]


def test_components_match_union_find(spark):
    rng = random.Random(5)
    ties = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(50)]  # random, a chain, a star
    df = spark.createDataFrame([tuple(sorted(t)) for t in ties], "a long, b long")
    got = {r["node"]: r["root"] for r in splits.components(df).collect()}
    want = {x: r for x, r in union_find([t for t in ties if t[0] != t[1]]).items()}
    assert got == want


def test_related_rows_land_together_and_shares_hold(spark):
    rng = random.Random(2)
    rows = [(f"q{i}", f"L{i % 5}_T{rng.randrange(600)}" + (f" / M_T{rng.randrange(600)}" if rng.random() < 0.02 else ""), f"L{i % 5}") for i in range(3000)]
    rows += [(f"q{i}", f"Z_T{rng.randrange(600)}", None) for i in range(0, 3000, 97)] + [("n1", None, None), ("n2", "no topic", "L1")]
    t = splits.SplitTable(spark)
    t.update(frame(spark, rows))
    got = {r["id"]: (r["unit"], r["split"]) for r in t.assignments().collect()}
    assert set(got) == {r[0] for r in rows}
    topics = {r["node"]: r["root"] for r in t.topics.collect()}
    by_topic = defaultdict(set)
    for q, cell, _ in rows:
        for n in (int(x) for x in __import__("re").findall(r"_T(\d+)", cell or "")):
            by_topic[topics[n]].add(got[q][1])
    assert all(len(s) == 1 for s in by_topic.values())
    n = Counter(got[r[0]][1] for r in rows)
    assert abs(n["train"] / len(rows) - 0.8) < 0.03 and abs(n["test"] / len(rows) - 0.1) < 0.02


def test_overall_shares_hold_where_units_are_large_beside_their_strata(spark):
    sizes = [46, 36, 17, 17, 14, 12, 11, 5, 1, 1]
    rows = [(f"q{i}_{k}", f"L_T{i}", f"L{i % 7}") for i, n in enumerate(sizes) for k in range(n)]
    t = splits.SplitTable(spark)
    t.update(frame(spark, rows))
    n = Counter(r["split"] for r in t.assignments().collect())
    assert all(abs(n[name] / len(rows) - share) < 0.01 for name, share in splits.SPLITS)
    got = {r["unit"]: r["split"] for r in t.assignments().collect()}
    t.update(frame(spark, [(f"n{i}_{k}", f"L_T{100 + i}", f"L{i % 7}") for i, n in enumerate(sizes) for k in range(n)]))
    assert all(r["split"] == got[r["unit"]] for r in t.units.collect() if r["unit"] in got)
    assert sum(r["n_rows"] for r in t.units.collect()) == 2 * len(rows)


def test_updates_keep_fill_and_quarantine(spark, tmp_path):
    first = [(f"a{i}", f"L_T{i}", "L") for i in range(100)]
    t = splits.SplitTable(spark)
    t.update(frame(spark, first))
    before = {r["id"]: r["split"] for r in t.assignments().collect()}
    train = [i for i in range(100) if before[f"a{i}"] == "train"]
    other = next(i for i in range(100) if before[f"a{i}"] != "train")
    t.save(str(tmp_path / "state"))
    t = splits.SplitTable.load(spark, str(tmp_path / "state"))
    second = [("b1", f"L_T{train[0]}", "L"), ("b2", f"L_T{train[1]} / L_T{train[2]}", "L"), ("b3", f"L_T{train[3]};L_T{other}", "L"), ("b4", "L_T500", "L"), ("b5", f"L_T600 und L_T{other + 0}", "L")]
    t.update(frame(spark, second))
    after = {r["id"]: r["split"] for r in t.assignments().collect()}
    assert after["b1"] == after["b2"] == "train"
    assert after["b3"] == splits.QUARANTINE == after[f"a{other}"] == after[f"a{train[3]}"] == after["b5"]
    assert after["b4"] in ("train", "validation", "test")
    untouched = set(before) - {f"a{other}", f"a{train[3]}"}
    assert all(after[q] == before[q] for q in untouched)
    assert {r["id"]: r["unit"] for r in t.assignments().collect()}["b2"] == f"t{min(train[1], train[2])}"


def test_one_hot_component_and_repeated_rows(spark):
    rows = [("q", f"L_T{i}", "L") for i in range(50)] * 2 + [(f"r{i}", "L_T3", None) for i in range(50)]
    t = splits.SplitTable(spark)
    t.update(frame(spark, rows))
    assert t.units.count() == 1
    assert tied_pairs(t.topics).count() == 50 * 49 // 2


def test_null_ids_tie_within_their_cell_only(spark):
    rows = [(None, "L_T1 / L_T2", "L"), (None, "L_T3", "L"), ("q", "L_T2", "L")]
    t = splits.SplitTable(spark)
    t.update(frame(spark, rows))
    assert {(r["a"], r["b"]) for r in tied_pairs(t.topics).collect()} == {(1, 2)}
    assert [r["id"] for r in t.assignments().collect()] == ["q"]


def test_empty(spark):
    t = splits.SplitTable(spark)
    t.update(frame(spark, []))
    assert t.assignments().count() == 0 and tied_pairs(t.topics).count() == 0
