"""Queries over small fixtures: all rows count."""

import math

import numpy as np

import __spark_entry__ as e
from quillstone.operators import adapter as A


def test_gate_and_weights_count_every_vector(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 8))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    rows = [(i, v.tolist(), int(rng.integers(0, 3))) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = {}
    for q, a, _ in rows[::10]:
        for i, b, label in rows:
            if i % 10:
                a64, b64 = np.array(a, float), np.array(b, float)
                d1, d2 = 1 - math.exp(-np.linalg.norm(a64 - b64)), math.acos(a64 @ b64) / math.pi
                key = (q, str(label), i % 4)
                want[key] = min(want.get(key, 9.0), math.sqrt(d1 * d1 + d2 * d2) / math.sqrt(2))
    for block in (4096, 16):
        monkeypatch.setattr(A, "QUERY_BLOCK", block)
        got = {(r["query_id"], r["label"], r["cluster"]): r["d"] for r in e.queries()["h15_block_minimum"](spark, str(tmp_path)).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    best = {r["query_id"]: (r["label"], r["d"]) for r in e.queries()["h19_gate"](spark, str(tmp_path)).collect()}
    assert best.keys() == {q for q, _, _ in want}
    for q, (label, d) in best.items():
        assert (label, round(d, 5)) == min(((n, round(v, 5)) for (i, n, _), v in want.items() if i == q), key=lambda t: (t[1], t[0]))
    p = {(r["query_id"], r["label"], r["cluster"]): r["p"] for r in e.queries()["h16_weights"](spark, str(tmp_path)).collect()}
    assert p.keys() == want.keys()
    for q, label in {k[:2] for k in want}:
        s = sorted((((1 - v) ** 10, -c) for (i, n, c), v in want.items() if (i, n) == (q, label)), reverse=True)
        top, total = {-c: v for v, c in s[:2]}, sum(v for v, _ in s[:2])
        assert all(abs(p[q, label, -c] - top.get(-c, 0.0) / total) < 1e-4 for _, c in s)


def test_headers_are_whole_lines(spark, tmp_path):
    same, head = "Dieser Anfang ist für alle Sätze gleich, ", "Bundesgesetz über das Salzwesen, Seite 1"
    rows = [(i, 1 + i % 4, s, "a.pdf") for i, s in enumerate([same + w for w in ("eins", "zwei", "drei", "vier")] + [head, head.replace("1", "22"), f"  {head}", "kurz", "kurz"])]
    spark.createDataFrame(rows, "sentence_id long, page int, sentence string, source_file string").write.parquet(f"{tmp_path}/ris_sentences.parquet")
    assert [tuple(r) for r in e.queries()["b11_headers"](spark, str(tmp_path)).collect()] == [("a.pdf", "bundesgesetz über das salzwesen, seite <d>")]


def test_rare_terms_count_in_lexical_retrieval(spark, tmp_path):
    n = 4200  # more terms than any cap of 4000; each frequent term is in two rows, the rare ones in one
    rows = [(f"t{i:05d}", f"wort{i % n}x haus") for i in range(2 * n)] + [("r1", "haus seltenes"), ("r2", "haus rares"), ("r3", "einzig")]
    spark.createDataFrame(rows, "query_id string, query_text string").write.parquet(f"{tmp_path}/train.parquet")
    spark.createDataFrame(rows[-3:], "query_id string, query_text string").write.parquet(f"{tmp_path}/test.parquet")
    got = {r["query_id"] for r in e.queries()["h4_svd_retrieval"](spark, str(tmp_path)).where("rank = 1").collect()}
    assert got == {"r1", "r2", "r3"}
    spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "sentence_id long, sentence string").write.parquet(f"{tmp_path}/ris_sentences.parquet")
    got = {r["query_id"] for r in e.queries()["h6_index"](spark, str(tmp_path)).where("rank = 1").collect()}
    assert got == {"r1", "r2", "r3"}


def test_all_char_ngrams_of_three_to_six_letters(spark, tmp_path):
    texts = ["abcdefgh ijklmnopqr", "abcdefgh ijklmnopqr stuvwxyzabc", "defghijk stuvwxyzabc lmnopqrst abcdefgh", "nur einmal uvwxyzabcdef uvwxyzabcdef", "uvwxyzabcdef", "qqq"]
    spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "query_id string, query_text string").write.parquet(f"{tmp_path}/test.parquet")
    df, total, grams = {}, {}, {}
    for i, t in enumerate(texts):
        own = [w[j : j + n] for w in (f" {w} " for w in t.split()) for n in range(3, 7) for j in range(len(w) - n + 1)]
        for g in own:
            total[g] = total.get(g, 0) + 1
        for g in set(own):
            df[g] = df.get(g, 0) + 1
        grams[str(i)] = set(own)
    want = {(g, k, total[g]) for g, k in df.items() if 2 <= k <= 0.99 * len(texts)}
    assert len(want) > 100 and {tuple(r) for r in e.queries()["h2_char_ngrams"](spark, str(tmp_path)).collect()} == want
    words = {str(i): {w for w in t.split() if sum(w in u.split() for u in texts) >= 2} for i, t in enumerate(texts)}
    sizes = {q: len(words[q]) + sum(df[x] >= 2 for x in g) for q, g in grams.items()}
    assert {r["query_id"]: r["n"] for r in e.queries()["h3_union"](spark, str(tmp_path)).collect()} == {q: n for q, n in sizes.items() if n}


def test_prompts_hold_whole_sources(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist(), i % 3) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    docs = [(i, f"Quelle {i} " + "wort " * 180 + f"Ende{i}", "de") for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = e.queries()["d10_prompts"](spark, str(tmp_path)).collect()
    assert got and all(f"Ende{u}" in r["prompt"] for r in got for u in r["unit_ids"].split(","))
