import tracemalloc

import numpy as np

from quillstone.llm import vectors

SCHEMA = "sentence_id long, embeddings array<float>, id string, similarity double"


def brute(rows, k, low):
    ids = [i for i, v in rows]
    x = np.array([v for _, v in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.minimum(x @ x.T, 1.0)
    out = {}
    for a, i in enumerate(ids):
        near = sorted(((-round(s[a, b], 9), j) for b, j in enumerate(ids) if j != i))[:k]
        out[i] = [(j, -c) for c, j in near if -c >= low]
    return out


def data(n=300, d=16, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 3, d))
    x = np.concatenate([base, base + 0.05 * rng.normal(size=base.shape), rng.normal(size=(n - 2 * len(base), d))])
    return [(i + 1, [float(v) for v in np.float32(row)]) for i, row in enumerate(x)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0.5) for i, v in rows], SCHEMA)


def test_near_copies_are_all_found(spark):
    rows = data()
    got = {(r["a"], r["b"]) for r in vectors.similar_pairs(frame(spark, rows), "sentence_id", "embeddings", 3, 0.8, cell_rows=32).collect()}
    want = {tuple(sorted((i, j))) for i, near in brute(rows, 3, 0.8).items() for j, _ in near}
    assert want and got == want


def test_search_has_high_recall(spark):
    df = frame(spark, data(400, 24))
    found = vectors.knn(df, k=5, query_filter="id % 50 = 0", target_recall=1.0, cell_rows=64)
    exact = vectors.exact_neighbors(df, "sentence_id", "embeddings", 5, "id % 50 = 0")
    assert vectors.recall(found, exact).first()["recall"] >= 0.9
    assert {r["query_id"] for r in found.collect()} == {i for i in range(50, 401, 50)}


def test_exact_copies_scaled_copies_and_ties(spark):
    rows = data(60, 8)
    v = rows[0][1]
    copies = [(1000 + i, v) for i in range(20)]  # a third of all rows: one group of copies
    rows = rows + copies
    got = {}
    for r in vectors.knn(frame(spark, rows), k=5, min_similarity=0.8, cell_rows=16).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["neighbor_id"])
    assert got[1019] == [1, 1000, 1001, 1002, 1003]
    assert got[1000] == [1, 1001, 1002, 1003, 1004]
    assert got[1] == [1000, 1001, 1002, 1003, 1004]


def test_filtered_queries_that_are_copies_of_earlier_rows(spark):
    rows = data(60, 8)
    rows += [(100, rows[6][1]), (150, rows[6][1]), (201, rows[8][1]), (202, rows[9][1])]
    for how in ({"target_recall": 1.0}, {}):
        got = {}
        for r in vectors.knn(frame(spark, rows), k=5, query_filter="id % 50 = 0", shortlist=64, cell_rows=16 if how else 64, **how).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["neighbor_id"])
        assert got == {i: [j for j, _ in near] for i, near in brute(rows, 5, -1).items() if i % 50 == 0}


def test_large_cells_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD_ROWS", 16)
    rows = data(120, 8)
    got = {(r["a"], r["b"]) for r in vectors.similar_pairs(frame(spark, rows), "sentence_id", "embeddings", 3, 0.8, cell_rows=64).collect()}
    assert got == {tuple(sorted((i, j))) for i, near in brute(rows, 3, 0.8).items() for j, _ in near}


def test_unusable_vectors_are_left_out(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [1.0, 0.1]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (6, [1.0, 0.1])]
    got = vectors.knn(frame(spark, rows), k=5).collect()
    assert {(r["query_id"], r["neighbor_id"]) for r in got} == {(1, 6), (6, 1)}


def test_empty(spark):
    assert vectors.knn(frame(spark, []), k=5).count() == 0
    assert vectors.similar_pairs(frame(spark, [(1, None)]), "sentence_id", "embeddings").count() == 0


def test_encoding_is_no_worse_with_a_wider_beam():
    x = np.random.default_rng(0).normal(size=(500, 12)).astype(np.float32)
    errors = []
    for beam in (1, 8):
        aq = vectors.AdditiveQuantizer.fit(x, [8], 4, 16, beam=beam, seed=3)
        codes, err = aq.encode(x)
        approx = aq.approximate(codes[:, 0])
        assert np.allclose(err[:, 0], ((x - approx) ** 2).sum(1) - (x**2).sum(1), atol=1e-3)
        assert np.allclose(aq.centres(aq.cell_of(codes[:, 0])), aq.books[0][codes[:, 0, 0]])
        errors.append(((x - approx) ** 2).sum())
    assert errors[1] <= errors[0]


def test_counting_cells_takes_little_memory():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(512, 64)).astype(np.float32)
    for sizes in ([2048], [512, 4]):  # the nearest 2048 cells of 512 rows, with what each leaves over, would be 268 MB
        aq = vectors.AdditiveQuantizer([rng.normal(size=(n, 64)).astype(np.float32) for n in sizes], len(sizes))
        far = aq.nearest_cells(x, 2048)[0][:, -1]
        tracemalloc.start()
        need = vectors.needed_cells(aq, x, np.arange(512), far, 1.0)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert need == 2048 and most < 150e6


def test_with_a_threshold_few_cells_hold_what_is_wanted(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD_ROWS", 64)
    monkeypatch.setattr(vectors, "PASS_LEAST", 16)
    monkeypatch.setattr(vectors, "PASS_VISITS", 2)
    probes, measure = [], vectors.measured_probes
    monkeypatch.setattr(vectors, "measured_probes", lambda *a: probes.append(measure(*a)) or probes[-1])
    rows = data(900, 32)
    got = {(r["a"], r["b"]) for r in vectors.similar_pairs(frame(spark, rows), "sentence_id", "embeddings", 3, 0.8, cell_rows=8).collect()}
    assert got == {tuple(sorted((i, j))) for i, near in brute(rows, 3, 0.8).items() for j, _ in near}
    vectors.knn(frame(spark, rows), k=3, cell_rows=8)
    assert probes[0] <= 16 < probes[1]
