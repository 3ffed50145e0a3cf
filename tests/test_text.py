"""Expressions over text against hand-made values and plain Python versions."""

import re

import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.functions import vec
from quillstone.operators import ngram as N
from quillstone.operators import passages as P
from quillstone.operators import sampling as S


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "s string").select(f(F.col("s"))).first()[0]


def test_lexical(spark):
    s = "Gemäß §§ 12 Abs. 3, BGBl. Nr. 100/1988 und A4"
    assert one(spark, s, X.lexical) == "gemäß paragraf num12 abs. num3 , bgbl. nr. num100 / num1988 und a4"
    assert one(spark, "§ 5 ÄÖ", lambda c: X.lexical(c, "remove")) == "paragraf äö"
    assert one(spark, "A  1 B", lambda c: X.lexical(c, "keep")) == "a 1 b"
    assert one(spark, None, X.lexical) is None
    with pytest.raises(ValueError):
        X.lexical(F.lit("x"), "other")


@pytest.mark.parametrize(
    "raw,want",
    [
        ("Die Ver-\nordnung gilt.", "Die Verordnung gilt."),
        ("Bundes-\nGesetz", "Bundes-Gesetz"),
        ("(1) Erstens\n2. Zweitens\na. Drittens\nIV. Viertens", "1) Erstens 2) Zweitens a) Drittens IV) Viertens"),
        ("Seite 3 von 79\nText\nwww.ris.bka.gv.at Seite 1 von 2", "Text"),
        ("Kurztitel: Name\nhttps://x.y/z\nFassung vom 1.1.", "Name 1.1."),
        ("Liste: 1. eins; 2. zwei", "Liste: 1) eins; 2) zwei"),
        ("weich­es  Wort", "weiches Wort"),
        ("", ""),
    ],
)
def test_normalize(spark, raw, want):
    assert one(spark, raw, lambda c: X.normalize(c, X.DROP_LINES)) == want


@pytest.mark.parametrize(
    "raw,want",
    [
        ("Nach § 5 Abs. 2 gilt das. Dann nicht!", ["Nach § 5 Abs. 2 gilt das.", "Dann nicht!"]),
        ("Siehe § 12. Abs 3 und u.a. hier. Neu", ["Siehe § 12. Abs 3 und u.a. hier.", "Neu"]),
        ("Etwa z.B. hier.", ["Etwa z.B.", "hier."]),  # "Z." is an abbreviation of its own and comes first
        ("Wer? Ich. Du.", ["Wer?", "Ich.", "Du."]),
        ("Es gilt BGBl. Nr. 1 i.V.m. Art. 3 Z. 4. Punkt.", ["Es gilt BGBl. Nr. 1 i.V.m. Art. 3 Z. 4.", "Punkt."]),
        ("   ", []),
        (None, []),
    ],
)
def test_sentences(spark, raw, want):
    assert one(spark, raw, lambda c: X.sentences(c, False)) == want


def test_false_ends_are_merged_once(spark):
    df = spark.createDataFrame([(["vgl. § 7.", "Abs 2 und § 8.", "lit a", "Ende."],)], "s array<string>")
    assert df.select(X.merge_false_ends(F.col("s"))).first()[0] == ["vgl. § 7. Abs 2 und § 8.", "lit a", "Ende."]


@pytest.mark.parametrize("raw,want", [("ohne Marken", ["ohne Marken"]), ("nur 1) eine", ["nur 1) eine"]), ("vor 1) eins 2) zwei a) drei", ["vor 1) eins", "2) zwei", "a) drei"]), ("• x • y", ["• x", "• y"])])
def test_list_marks(spark, raw, want):
    assert one(spark, raw, X.split_list_marks) == want


def test_meaningful_and_tokens(spark):
    rows = ["Das ist ein ganzer Satz mit Sinn.", "kurz", "12345 67890 12345 a b c", "-- ;; --", None, "  "]
    df = spark.createDataFrame([(r,) for r in rows], "s string")
    assert [r[0] for r in df.select(X.is_meaningful(F.col("s"), 10, 3, 0.5)).collect()] == [True, False, False, False, False, False]
    assert [r[0] for r in df.select(X.token_count(F.col("s"))).collect()] == [len(re.findall(r"\w+", r or "")) for r in rows]
    assert one(spark, "vor¼mals fünf_sechs", X.token_count) == 2


def test_keywords_tokens_hash_abbreviations(spark):
    assert one(spark, "Wie ist die Frist-Verlängerung im Jahr 7 nach AB?", X.keywords) == "frist verlängerung jahr 7"
    assert one(spark, "Wie IST das", X.keywords) == "wie ist das"
    assert one(spark, " Über 3-Tage! ", X.ui_tokens) == ["über", "3", "tage"]
    assert [one(spark, s, X.stable_hash) for s in ("a", "ab", "A:issues", "ä", "")] == [97, 12903, 2247516256, 228, 0]
    pairs = spark.createDataFrame([("TKG", "TKG 2021"), ("AWG", ""), ("AB", "CD"), ("a-b", "AB")], "a string, b string")
    assert [r[0] for r in pairs.select(X.abbreviations_match(F.col("a"), F.col("b"))).collect()] == [True, True, False, True]
    assert [r[0] for r in pairs.select(X.abbreviations_match(F.col("a"), F.col("b"), False)).collect()] == [True, False, False, True]


def test_labels_are_found_as_words(spark):
    df = spark.createDataFrame([("das äMRG",), ("das mrg",), ("MRG1",), ("(MRG)",), ("a MRG_",)], "s string").withColumn("p", X.label_pattern(F.lit("MRG")))
    assert [r[0] for r in df.select(F.expr("s RLIKE p")).collect()] == [False, True, False, True, False]
    df = spark.createDataFrame([(r"x a+b\E y",)], "s string").withColumn("p", X.label_pattern(F.lit(r"A+B\E")))
    assert df.select(F.expr("s RLIKE p")).first()[0]


def test_links(spark):
    page = '<a href="x?a=1&amp;b=2"><img src="CompleteNorm.gif"></a> <a href="y"><IMG alt="Gesamte geltende Rechtsvorschrift"></a><a href="x?a=1&amp;b=2"><img src="completenorm.png"></a>'
    assert one(spark, page, X.complete_links) == ["x?a=1&b=2", "y"]
    page = '<a href="no.pdf"><img src="pdf.gif"></a> Andere Formate <a href="yes.pdf?x=1&amp;y=2"><img src="pdf.gif" alt="PDF-Dokument"></a>'
    assert one(spark, page, X.pdf_link) == "yes.pdf?x=1&y=2"
    assert one(spark, "nothing", X.pdf_link) is None
    assert one(spark, "https://a.b/c?x=1&Gesetzesnummer=100%2F5#t", lambda c: X.query_parameter(c, "Gesetzesnummer", "gesetzesnummer")) == "100/5"


def test_nearest_rank(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "v double").withColumn("g", F.lit("x"))
    assert tuple(P.nearest_rank_by(df, ["g"], "v", [0.1, 0.5, 0.9]).first())[1:] == (1.0, 3.0, 4.0)
    arr = F.array(*[F.lit(float(x)) for x in (4, 1, 3, 2)])
    assert spark.range(1).select(P.nearest_rank(arr, 0.5)).first()[0] == 3.0
    assert spark.range(1).select(P.nearest_rank(F.array().cast("array<double>"), 0.5)).first()[0] == 0.0


def test_chunks_overlap_and_limits(spark):
    paras = [(i + 1, " ".join(f"w{i}_{j}" for j in range(50))) for i in range(12)]
    plain = P.chunk(paras, target=120, overlap=10, least=40, most=200)
    assert [p for p, _ in plain] == [1, 3, 5, 7, 9, 11] and " ".join(s for _, s in plain).split() == " ".join(p for _, p in paras).split()
    got = P.chunk(paras, target=120, overlap=10, least=40, most=200, repeat=True)
    words = [s.split() for _, s in got]
    assert [p for p, _ in got][:2] == [1, 3] and all(40 <= len(w) <= 200 for w in words)
    for a, b in zip(words, words[1:]):
        assert b[:10] == a[-10:]
    assert {w for x in words for w in x} == {w for _, p in paras for w in p.split()}
    assert P.chunk([(1, "zu kurz")]) == [] and P.chunk([]) == []
    long = [(1, "1) " + "a " * 300 + "2) " + "b " * 300)]
    assert len(P.chunk(long, most=320)) == 2


def test_paragraphs_pages_and_headers(spark):
    def line(page, n, y, text, x0=50.0):
        return ("d.pdf", page, n, x0, y, y + 9.0, 800.0, text)

    rows = [line(p, 1, 10.0, f"Kopfzeile {p}") for p in (1, 2, 3)]
    rows += [line(1, 2, 100.0, "Der Satz geht wei-"), line(1, 3, 110.0, "ter und weiter"), line(1, 4, 200.0, "ohne Ende"), line(2, 2, 100.0, "bis hier."), line(2, 3, 110.0, "§ 5. Neu")]
    df = spark.createDataFrame(rows, "doc string, page int, line int, x0 double, y0 double, y1 double, height double, text string")
    black = P.header_blacklist(df)
    assert [r["key"] for r in black.collect()] == ["kopfzeile <d>"]
    paras = P.paragraphs(P.content_lines(df, black))
    assert [(r["page"], r["text"]) for r in paras.orderBy("page", "para").collect()] == [(1, "Der Satz geht weiter und weiter"), (1, "ohne Ende"), (2, "bis hier."), (2, "§ 5. Neu")]
    assert [(r["page"], r["text"]) for r in P.merge_pages(paras).orderBy("pos").collect()] == [(1, "Der Satz geht weiter und weiter ohne Ende bis hier."), (2, "§ 5. Neu")]


def test_corpus_is_filtered_deduplicated_and_numbered(spark):
    s = "Dieser Satz ist lang genug für die Sammlung."
    rows = [("b.pdf", 1, 1, s), ("a.pdf", 1, 2, s), ("a.pdf", 0, 1, s + " Zwei."), ("a.pdf", 2, 3, s), ("a.pdf", 3, 3, "kurz"), ("a.pdf", 4, 3, None)]
    got = P.corpus(spark.createDataFrame(rows, "doc string, pos int, page int, text string")).orderBy("unit_id").collect()
    assert [(r["unit_id"], r["label"], r["page"]) for r in got] == [(1, "a", 1), (2, "a", 2), (3, "b", 1)]


def test_layout_lines(spark):
    blocks = [(0, [([50.0, 20.0, 90.0, 29.0], ["zwei"]), ([10.0, 20.001, 40.0, 29.0], ["ei", "ns"]), ([0.0, 5.0, 1.0, 6.0], [" "])]), (1, [([0.0, 0.0, 1.0, 1.0], ["Bild"])])]
    df = spark.createDataFrame([("d", 1, blocks)], "doc string, page int, blocks array<struct<type: int, lines: array<struct<bbox: array<double>, spans: array<string>>>>>")
    assert [(r["line"], r["text"]) for r in P.layout_lines(df).orderBy("line").collect()] == [(1, "eins"), (2, "zwei")]


def test_ngrams(spark):
    df = spark.createDataFrame([(s.split(),) for s in ("a b c", "a b d", "a b c", "x")], "tokens array<string>")
    m = N.ngram_model(df)
    got = {(tuple(r["ctx"]), r["next"]): r["cnt"] for r in m.collect()}
    assert got == {(("<s>", "<s>"), "a"): 3, (("<s>", "a"), "b"): 3, (("a", "b"), "c"): 2, (("a", "b"), "d"): 1, (("b", "c"), "</s>"): 2, (("b", "d"), "</s>"): 1}
    p = spark.createDataFrame([("1", ["a", "b"]), ("2", ["z", "a"]), ("3", [])], "id string, tokens array<string>")
    assert [(r["id"], r["next"], r["rank"]) for r in N.suggestions(m, p).orderBy("id", "rank").collect()] == [("1", "c", 1), ("1", "d", 2), ("2", "b", 1)]
    w = spark.createDataFrame([("ab",), ("abc",), ("abd",), ("abcd",), ("abc",)], "word string")
    assert [r[0] for r in N.completions(w, "ab", 2).collect()] == ["abc", "abd"] and N.completions(w, "a").count() == 0


def test_cells_and_tables(spark):
    df = spark.createDataFrame([("0.5 [0.1, 0.9]",), ("−1.5 [−2, 3e-1]",), ("≈ 7 ms",), ("–",)], "c string").select(N.parse_cell(F.col("c")).alias("p"))
    assert [tuple(r["p"]) for r in df.collect()] == [(0.5, 0.1, 0.9), (-1.5, -2.0, 0.3), (7.0, None, None), (None, None, None)]
    lines = spark.createDataFrame([("| a | b |",), ("|---|:-:|",), ("text",), ("| 1 | |",)], "line string")
    assert [r["cells"] for r in N.markdown_rows(lines).collect()] == [["a", "b"], ["1", ""]]


def test_targets_samples_and_splits(spark):
    labels = spark.createDataFrame([("C",), ("A",), ("B",), (None,)], "label string")
    assert {r["label"]: r["target"] for r in S.target_counts(labels, 10).collect()} == {"A": 4, "B": 3, "C": 3}
    assert S.target_counts(labels.limit(0), 10).count() == 0
    by_style = S.style_targets(S.target_counts(labels, 10), ["x", "y", "z"], 1)
    assert {r["label"]: r[1] for r in by_style.groupBy("label").sum("target").collect()} == {"A": 4, "B": 3, "C": 3}
    pool = spark.createDataFrame([(f"q{i}", f"t{i % 70}", f"T{i % 30}", "AB"[i % 2]) for i in range(100)], "query_id string, query_text string, topic_id string, label string")
    for mode in ("iid", "iid_unrestricted", "topic_disjoint"):
        got = S.split_train_test(pool, S.target_counts(pool, 30), S.target_counts(pool, 10), ["label"], 3, mode).collect()
        train, test = ([r for r in got if r["split"] == s] for s in ("train", "test"))
        assert len(train) == 30 and not {r["query_text"] for r in train} & {r["query_text"] for r in test}
        assert len({r["query_text"] for r in got}) == len(got)
        if mode == "iid":
            assert {(r["label"], r["topic_id"]) for r in test} <= {(r["label"], r["topic_id"]) for r in train}
        if mode == "topic_disjoint":
            assert not {r["topic_id"] for r in test} & {r["topic_id"] for r in train}
    short = S.stratified_sample(pool, S.target_counts(pool, 500), ["label"], 3)
    assert S.shortfalls(short, S.target_counts(pool, 500), ["label"]).count() == 2


def test_templates(spark):
    t = spark.createDataFrame([("s", "{a} und {b}"), ("s", "fest"), ("s", "{zz} fehlt")], "spec string, template string")
    slots = spark.createDataFrame([("s", "a", "1"), ("s", "a", "2"), ("s", "b", "x"), ("s", "b", "y"), ("s", "b", "x")], "spec string, slot string, value string")
    assert S.template_capacity(t, slots).first()["capacity"] == 5
    got = [r["text"] for r in S.expand_templates(t, slots, 10, 1).collect()]
    assert sorted(got) == ["1 und x", "1 und y", "2 und x", "2 und y", "fest"]
    assert S.expand_templates(t, slots, 3, 1).count() == 3


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    r = df.select(vec.unit(F.col("a")), vec.dot(F.col("a"), F.col("b")), vec.squared_distance(F.col("a"), F.col("b")), vec.cosine(F.col("a"), F.col("b"))).collect()
    assert r[0][0] == pytest.approx([0.6, 0.8]) and r[0][1:] == pytest.approx((24.0, 2.0, 0.96)) and r[1][0] == [0.0, 0.0] and r[1][3] == 0
    assert df.select(vec.fix_dimension(F.col("a"), 1)).first()[0] == [3.0]
    with pytest.raises(Exception, match="vector of 3"):
        df.select(vec.fix_dimension(F.col("a"), 3)).collect()
    pooled = spark.range(1).select(vec.mean_pool(F.expr("array(array(1D, 2D), array(3D, 4D), array(9D, 9D))"), F.expr("array(1, 1, 0)"), 2)).first()[0]
    assert pooled == [2.0, 3.0]
