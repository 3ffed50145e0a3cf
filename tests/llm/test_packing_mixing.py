import itertools
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillstone.llm import mixing, packing, sizes

SCHEMA = "doc_id long, text string, source string, id string, size long, container string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, "c") for i, t, s in rows], SCHEMA)


def fewest(items, capacity):
    """The fewest containers, by trying everything."""
    best = len(items)

    def put(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(items):
            best = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms)}.values():
            if rooms[i] >= items[k]:
                put(k + 1, rooms[:i] + [rooms[i] - items[k]] + rooms[i + 1 :])
        put(k + 1, [*rooms, capacity - items[k]])

    items = sorted(items, reverse=True)
    put(0, [])
    return best


def test_bin_completion_is_near_the_optimum():
    rng, off = random.Random(1), 0
    for _ in range(60):
        items = [rng.randint(10, 70) for _ in range(rng.randint(1, 10))]
        got = packing.bin_completion(items, 100)
        assert sorted(itertools.chain(*got)) == sorted(items) and all(sum(b) <= 100 for b in got)
        least = fewest(items, 100)
        assert packing.lower_bound(items, 100) <= least <= len(got)
        off += len(got) - least
    assert off <= 1


def test_bin_completion_improves_on_best_fit():
    items = [6, 5, 5, 4, 4, 4, 3, 3, 3, 3]  # 40: best fit decreasing may leave gaps; four containers of 10 suffice
    assert len(packing.bin_completion(items, 10)) == 4


def test_pack_places_everything_once(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, "ä" * rng.randint(0, 40), "s") for i in range(300)] + [(900, None, None), (901, "", "s"), (902, "x" * 1000, "s"), (903, "x" * 200, "s"), (904, "x" * 100, "s"), (904, "x" * 100, "s"), (None, "abc", "s")]
    placed = packing.pack(frame(spark, rows), sizes.byte_tokens(F.col("text")), capacity=100, group_items=64)
    got = placed.collect()
    used, parts = Counter(), defaultdict(list)
    for r in got:
        used[r["container"]] += r["size"]
        parts[r["id"]].append((r["part"], r["begin"], r["size"]))
    assert max(used.values()) <= 100
    assert sorted(parts[902]) == [(k, 100 * k, 100) for k in range(10)] and sorted(parts[903]) == [(0, 0, 100), (1, 100, 100)]
    assert parts[904] == [(0, 0, 100)] * 2 and parts[900] == parts[901] == [(0, 0, 0)] and parts[None] == [(0, 0, 3)]
    for i, t, _ in rows:
        if i not in (904, None):
            assert sum(s for _, _, s in parts[i]) == len((t or "").encode()) and (len(parts[i]) == 1 or i in (902, 903))
    report = packing.packing_report(placed, 100).first()
    assert report["fill"] > 0.9 and report["n_items"] == len(got) and report["n_containers"] == len(used)


def test_search_improves_on_best_fit_with_many_items_in_a_container():
    rng = random.Random(5)
    items = [rng.randint(700, 1400) for _ in range(400)]
    assert len(packing.bin_completion(items, 4096)) < len(packing.best_fit_decreasing(items, 4096))
    small = [rng.randint(20, 300) for _ in range(500)]  # a dozen and more in each
    assert len(packing.bin_completion(small, 4096)) == packing.lower_bound(small, 4096)


def test_fillings_are_undominated_and_complete():
    stock = packing._Stock([7, 5, 4, 3, 2, 2])
    got = list(packing.fillings(stock, 9, 9, [10**6]))
    assert got[0] in {(7, 2), (5, 4)} and (7, 2) in got and (5, 4) in got
    assert all(sum(f) <= 9 for f in got) and len(set(got)) == len(got)
    assert (4, 3, 2) not in got and (3, 2, 2) not in got  # 7 takes the place of 4 and 3, and of all three


def test_very_large_capacities():
    rng = random.Random(6)
    items = [rng.randint(1, 10**9) for _ in range(60)]
    got = packing.bin_completion(items, 10**9)
    assert sorted(itertools.chain(*got)) == sorted(items) and max(map(sum, got)) <= 10**9


def test_long_texts_are_cut_between_characters(spark):
    text = "aä€😀" * 50
    rows = [(1, text, "s"), (2, "é" * 7, "s"), (3, None, "s"), (4, "é" * 5, "s")]
    got = packing.pack(frame(spark, rows), sizes.byte_tokens(F.col("text")), capacity=10, begins=sizes.character_begins(F.col("text"), 10)).orderBy("id", "begin").collect()
    for i, t, _ in rows:
        mine = [r for r in got if r["id"] == i]
        whole = (t or "").encode()
        assert "".join(whole[r["begin"] : r["begin"] + r["size"]].decode() for r in mine) == (t or "")
        assert [r["part"] for r in mine] == list(range(len(mine))) and all(r["size"] <= 10 for r in mine)
    assert len([r for r in got if r["id"] == 4]) == 1


def test_pack_empty_and_bad_capacity(spark):
    assert packing.pack(frame(spark, []), sizes.byte_tokens(F.col("text")), capacity=10).count() == 0
    assert packing.packing_report(packing.pack(frame(spark, []), F.col("size"), capacity=10), 10).first()["n_containers"] == 0
    with pytest.raises(ValueError):
        packing.pack(frame(spark, []), F.col("size"), capacity=0)


def test_public_tokenizer_sizes(spark):
    import os

    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    if not os.path.exists(path):
        pytest.skip("no vocabulary")
    n = [r[0] for r in frame(spark, [(1, "hello world", ""), (2, None, ""), (3, "<|endoftext|>", "")]).select(sizes.bpe_tokens(F.col("text"), path)).collect()]
    assert n[:2] == [2, 0] and n[2] > 1


def test_exponent_meets_entropy_and_limits():
    shares = [0.7, 0.2, 0.1]
    for wanted in (0.85, 0.95, 1.05):
        e = mixing.find_exponent(shares, wanted)
        assert abs(mixing.entropy(mixing.tempered(shares, e)) - wanted) < 1e-6
    e = mixing.find_exponent(shares, None, [1, 1, 0.2])
    assert abs(mixing.tempered(shares, e)[2] - 0.2) < 1e-6
    assert mixing.find_exponent(shares, 5.0) == 0 and mixing.find_exponent(shares, 0.0) == 1
    assert mixing.tempered([0.0, 0.0], 0.5) == [0.0, 0.0]


def test_fit_weights_respects_repetitions():
    got = mixing.fit_weights({"a": 1000, "b": 100, "c": 500}, {"a": (0.5, 2), "b": (0.4, 2), "c": (0.1, 1), "d": (0.0, 3)})
    assert got["b"] == 200 and abs(sum(got.values()) - 1600) < 1e-6 and got["d"] == 0
    assert got["a"] >= 0.5 * 1600 and got["c"] >= 0.1 * 1600  # the others have their weight at least, and share what b can't give
    short = mixing.fit_weights({"a": 10, "b": 10}, {"a": (0.5, 1), "b": (0.5, 0)})
    assert short == {"a": 10, "b": 0}
    assert mixing.fit_weights({}, {"a": (1.0, 2)}) == {"a": 0.0}


def test_mix_meets_weights(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 16)
    rng = random.Random(3)
    names = {"a": 600, "b": 60, "c": 300, "other": 50}
    rows = [(n * 1000 + i, "x" * rng.randint(1, 30), f" {s.upper()} " if i % 7 == 0 else s) for n, (s, k) in enumerate(names.items()) for i in range(k)] + [(9000, None, "a"), (9001, "abc", None)]
    targets = spark.createDataFrame([("A", 0.5, 2, "z"), ("b ", 0.4, 3, "z"), ("c", 0.1, 1, "z"), ("missing", 0.0, 3, "z"), (None, 0.1, 1, "z")], "source string, weight double, max_repeats int, size string")
    df, size = frame(spark, rows), sizes.byte_tokens(F.col("text"))
    s = mixing.source_sizes(df, targets, size)
    assert {r["source"] for r in mixing.out_of_reach(mixing.mix_plan(s)).collect()} == {"b"}
    mixed, plan = mixing.mix(df, s, size)
    report = {r["source"]: r for r in mixing.mix_report(mixed, plan).collect()}
    assert report["b"]["actual"] == 3 * report["b"]["size"] and report["b"]["most_copies"] == 3
    for r in report.values():
        assert r["most_copies"] <= r["max_repeats"] and r["planned"] - 30 < r["actual"] <= r["planned"] + 1e-6
    assert report["a"]["share"] > 0.49 and report["c"]["share"] > 0.09
    got = mixed.collect()
    for source in ("a", "b", "c"):  # each pass has its blocks numbered without a gap, and another order of them
        orders = {}
        for r in got:
            if r["source"] == source:
                orders.setdefault(r["copy"], {})[r["nth"]] = r["block"]
        assert all(sorted(o) == list(range(1, len(o) + 1)) for o in orders.values())
        full = [tuple(o[i] for i in sorted(o)) for c, o in orders.items() if c <= report[source]["planned"] // report[source]["size"]]
        assert len(full) < 2 or len(set(full)) > 1  # few blocks: two passes may fall on the same order
    assert len({(r["id"], r["copy"]) for r in got}) == len(got) and not {9000, 9001} & {r["id"] for r in got}
    assert abs(sum(r["share"] for r in report.values()) - 1) < 1e-5


def test_exponent_of_the_remainder_brings_the_entropy_to_the_targets():
    sizes = {"a": 5000, "b": 40, "c": 800, "d": 300}
    targets = {"a": (0.4, 3), "b": (0.3, 2), "c": (0.2, 3), "d": (0.1, 9)}
    got = mixing.fit_weights(sizes, targets)
    total = sum(sizes.values())
    p = [got[n] / total for n in sorted(got)]
    rest = 1 - 0.7 - 80 / total
    others = []
    for e in (0.0, 1.0):  # neither end of the exponent is nearer
        share = mixing.tempered([5000 / 6100, 800 / 6100, 300 / 6100], e)
        others.append(mixing.entropy([0.4 + rest * share[0], 80 / total, 0.2 + rest * share[1], 0.1 + rest * share[2]]))
    wanted = mixing.entropy([0.4, 0.3, 0.2, 0.1])
    assert abs(mixing.entropy(p) - wanted) <= min(abs(x - wanted) for x in others) + 1e-9
    assert all(got[n] >= min(targets[n][0] * total, sizes[n] * targets[n][1]) - 1e-6 for n in got)


def test_mix_by_temperature_and_empty(spark):
    rows = [(i, "x" * 10, "a" if i < 90 else "b") for i in range(100)]
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], "source string, weight double, max_repeats int")
    size = sizes.byte_tokens(F.col("text"))
    t = {r["source"]: r["weight"] for r in mixing.temperature_targets(mixing.source_sizes(frame(spark, rows), targets, size)).collect()}
    assert abs(t["b"] - 0.2) < 1e-6 and abs(t["a"] - 0.8) < 1e-6  # b at most twice
    s = mixing.source_sizes(frame(spark, []), targets, size)
    mixed, plan = mixing.mix(frame(spark, []), s, size)
    assert mixed.count() == 0 and plan.count() == 2 and mixing.mix_report(mixed, plan).count() == 2
    assert not math.isnan(sum(r["weight"] for r in mixing.temperature_targets(s).collect()))
