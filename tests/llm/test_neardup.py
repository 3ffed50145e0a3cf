import random
import re

import numpy as np
import pytest
from fractions import Fraction

from quillstone.llm import crosssplit, neardup, words
from quillstone.llm.fmindex import FMIndex

SCHEMA = "query_id string, query_text string, id string, words string, cid string"


def frame(spark, rows):
    return spark.createDataFrame([(q, t, "a", "b", "c") for q, t in rows], SCHEMA)


def sets(rows):
    out = []
    for q, t in rows:
        w = frozenset(re.findall(r"[^\W_]+", (t or "").lower()))
        if q is not None and w:
            out.append((q, w))
    return out


def similar(a, b, t=Fraction(7, 10)):
    k = len(a & b)
    return k * t.denominator >= (len(a) + len(b) - k) * t.numerator


def brute(rows, other=None):
    s = sets(rows)
    if other is None:
        return {(min(p, q), max(p, q)) for p, a in s for q, b in s if p != q and similar(a, b)}
    return {(p, q) for p, a in s for q, b in sets(other) if similar(a, b)}


def texts(n, seed=3, vocabulary=60, length=(1, 14)):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            w = (out[rng.randrange(len(out))][1] or "x").split()
            for _ in range(rng.randrange(3)):
                k = rng.randrange(3)
                if k == 0:
                    w.insert(rng.randrange(len(w) + 1), f"w{rng.randrange(vocabulary)}")
                elif k == 1 and len(w) > 1:
                    del w[rng.randrange(len(w))]
                else:
                    rng.shuffle(w)
        else:
            w = [f"w{min(rng.randrange(vocabulary), rng.randrange(vocabulary))}" for _ in range(rng.randint(*length))]
        out.append((f"q{i:04d}", " ".join(w)))
    return out


def pairs(spark, rows):
    members, _, found = neardup.near_duplicates(frame(spark, rows), "query_id", "query_text")
    return {(r["a"], r["b"]) for r in neardup.duplicate_pairs(members, found).collect()}


def test_pairs_match_brute_force(spark):
    rows = texts(400)
    assert pairs(spark, rows) == brute(rows)


def test_hot_words_are_keyed_twice_and_tiled(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 8)
    rows = texts(250, seed=9, vocabulary=14)
    assert pairs(spark, rows) == brute(rows)


@pytest.mark.parametrize("threshold", ["0.3", "0.5", "0.7", "0.9"])
def test_no_pair_is_lost_to_hot_words(spark, monkeypatch, threshold):
    monkeypatch.setattr(neardup, "HOT", 2)
    rows = texts(120, seed=13, vocabulary=9, length=(1, 5)) + [("a", "alpha"), ("b", "alpha beta"), ("c", "alpha beta gamma"), ("d", "alpha delta")]
    members, _, found = neardup.near_duplicates(frame(spark, rows), "query_id", "query_text", threshold)
    s = sets(rows)
    want = {(min(p, q), max(p, q)) for p, a in s for q, b in s if p != q and similar(a, b, Fraction(threshold))}
    assert {(r["a"], r["b"]) for r in neardup.duplicate_pairs(members, found).collect()} == want


def test_nulls_blanks_copies_and_repeated_rows(spark):
    rows = [("a", "eins zwei drei"), ("b", "Drei, ZWEI eins!"), ("b", "Drei, ZWEI eins!"), ("c", None), ("d", "  "), ("e", "..."), (None, "eins zwei drei"), ("f", "eins"), ("f", "ganz anders hier")]
    assert pairs(spark, rows) == {("a", "b")}
    groups = neardup.duplicate_groups(*neardup.near_duplicates(frame(spark, rows), "query_id", "query_text")).collect()
    assert {(r["id"], r["class_id"], r["copies"], r["links"]) for r in groups} == {("a", "a", 2, 0), ("b", "a", 2, 0), ("f", "f", 1, 0)}


def test_very_long_texts(spark):
    rng = random.Random(4)
    long = [f"x{i}" for i in range(5000)]
    edited = [w for w in long if rng.random() > 0.1] + [f"y{i}" for i in range(200)]
    rows = [("a", " ".join(long)), ("b", " ".join(edited)), ("c", " ".join(f"z{i}" for i in range(4000)))]
    assert pairs(spark, rows) == {("a", "b")}


def test_empty(spark):
    assert pairs(spark, []) == set()
    assert pairs(spark, [("a", None)]) == set()


def test_a_third_of_rows_are_copies(spark):
    rows = texts(60, seed=1) + [(f"z{i}", "immer der gleiche text hier") for i in range(30)]
    assert pairs(spark, rows) == brute(rows)


def test_bit_sliced_distances():
    rng = np.random.default_rng(0)
    n = 200
    bits = (rng.random((n, neardup.SLOTS)) < 0.1).astype(np.uint8)
    bits[100:] = bits[:100] ^ (rng.random((100, neardup.SLOTS)) < 0.01)
    sizes = np.sort(rng.integers(10, 40, n))
    i, j = neardup.close_pairs(bits, sizes, np.arange(n) + 1, np.full(n, n), Fraction(7, 10))
    got = set(zip(i.tolist(), j.tolist()))
    t = Fraction(7, 10)
    dist = (bits[:, None, :] ^ bits[None, :, :]).sum(2)
    for a in range(n):
        for b in range(a + 1, n):
            within = dist[a, b] <= (sizes[a] + sizes[b]) * 3 // 17 and sizes[b] * 7 <= sizes[a] * 10
            assert not within or (a, b) in got
    assert len(got) < n * (n - 1) // 4
    assert t


@pytest.mark.parametrize("n", range(1, 30))
def test_guaranteed_run_holds(n):
    t, rng = Fraction(7, 10), random.Random(n)
    m = crosssplit.guaranteed_run(n, t)
    for _ in range(200):
        a = set(range(0, 2 * n, 2))
        b = set(a)
        for _ in range(rng.randrange(6)):
            (b.discard if rng.random() < 0.5 else b.add)(rng.randrange(2 * n))
        if b and similar(a, b):
            run = best = 0
            for x in sorted(a | b):
                run = run + 1 if x in a and x in b else 0
                best = max(best, run)
            assert best >= m


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 5, rng.integers(0, 12)).astype(np.int64) * 7919 for _ in range(40)]
    flat, starts = words.flatten(docs)
    fm = FMIndex.loads(FMIndex.build(flat, starts).dumps())
    for _ in range(300):
        p = rng.integers(0, 6, rng.integers(1, 4)).astype(np.int64) * 7919
        s = fm.symbols(p)
        lo, hi = fm.start(s[-1:])
        for c in s[-2::-1]:
            lo, hi = fm.extend(np.array([c]), lo, hi)
        doc, offset = fm.locate(np.arange(lo[0], hi[0]))
        got = sorted(zip(doc.tolist(), offset.tolist()))
        want = [(d, i) for d, w in enumerate(docs) for i in range(len(w) - len(p) + 1) if (w[i : i + len(p)] == p).all()]
        assert got == sorted(want)


def test_fm_index_gives_its_texts_back_and_is_compressed():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 300, rng.integers(0, 30)).astype(np.int64) * 104729 for _ in range(500)]
    flat, starts = words.flatten(docs)
    fm = FMIndex.loads(FMIndex.build(flat, starts).dumps())
    got, at = fm.words(np.arange(len(docs)))
    assert all((got[at[i] : at[i + 1]][::-1] == d).all() and at[i + 1] - at[i] == len(d) for i, d in enumerate(docs))
    assert len(fm.dumps()) < 4 * len(flat)  # of 8 bytes for each word, and with what locates them


def test_spans_are_merged():
    names, n = crosssplit._covered(np.array([3, 1, 3, 3]), np.array([0, 2, 1, 7]), np.array([4, 3, 2, 9]))
    assert names.tolist() == [1, 3] and n.tolist() == [1, 6]


def across(spark, rows, other):
    e, t, found = crosssplit.overlapping(frame(spark, rows), frame(spark, other), "query_id", "query_text")
    e, t = e.withColumnRenamed("id", "p").withColumnRenamed("cid", "e"), t.withColumnRenamed("id", "q").withColumnRenamed("cid", "t")
    return {(r["p"], r["q"]) for r in found.join(e, "e").join(t, "t").collect()}


def test_cross_split_pairs_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(crosssplit, "SHARD_SETS", 40)
    monkeypatch.setattr(crosssplit, "STREAM_ROWS", 70)
    monkeypatch.setattr(crosssplit, "BATCH_VISITS", 500)
    train = texts(300, seed=5)
    test = [(f"t{q}", x) for q, x in texts(120, seed=6)] + [("tc", train[7][1]), ("tn", None), ("tb", " ")]
    assert across(spark, test, train) == brute(test, train)


def test_cross_split_with_few_words(spark):
    test, train = [(f"t{q}", x) for q, x in texts(80, seed=7, vocabulary=6, length=(1, 5))], texts(80, seed=8, vocabulary=6, length=(1, 5))
    assert across(spark, test, train) == brute(test, train)


def test_cross_split_with_very_long_texts(spark):
    rng = random.Random(4)
    long = [f"x{i}" for i in range(6000)]
    edited = [w for w in long if rng.random() > 0.1] + [f"y{i}" for i in range(200)]
    test, train = [("ta", " ".join(long)), ("tb", "kurz")], [("a", " ".join(edited)), ("b", " ".join(f"z{i}" for i in range(4000))), ("c", "kurz")]
    assert across(spark, test, train) == {("ta", "a"), ("tb", "c")}
    got = {r["id"]: r["seen"] for r in crosssplit.seen_words(frame(spark, test), frame(spark, train), "query_id", "query_text").collect()}
    assert 3000 < got["ta"] < 6000 and got["tb"] == 0


def test_cross_split_empty_sides(spark):
    some = texts(5)
    assert across(spark, [], some) == set() == across(spark, some, []) == across(spark, [], [])


def test_seen_words_match_brute_force(spark):
    train = texts(200, seed=11, vocabulary=12, length=(3, 20))
    test = [(f"t{q}", x) for q, x in texts(60, seed=12, vocabulary=12, length=(3, 20))] + [("tn", None)]
    grams = set()
    for _, x in train:
        w = x.split()
        grams |= {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    want = {}
    for q, x in test:
        w = (x or "").split()
        if w:
            seen = {i + k for i in range(len(w) - 4) if tuple(w[i : i + 5]) in grams for k in range(5)}
            want[q] = (len(w), len(seen))
    got = {r["id"]: (r["n_words"], r["seen"]) for r in crosssplit.seen_words(frame(spark, test), frame(spark, train), "query_id", "query_text").collect()}
    assert got == want
