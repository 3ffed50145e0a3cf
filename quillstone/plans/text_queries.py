"""Text expressions, passages, sampling, n-grams and TF-IDF over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.functions import vec
from quillstone.operators import generation as G
from quillstone.operators import lexical as L
from quillstone.operators import ngram as N
from quillstone.operators import passages as P
from quillstone.operators import sampling as S
from quillstone.sources.tables import spread, table

STYLES = ("nl_short", "nl_long", "scenario", "procedural", "authority", "keyword", "fragment")
LETTERS = "[A-Za-zÄÖÜäöüß]"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text", "lang", "source"))


def _laws(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ris_sentences").where("sentence IS NOT NULL")


def a2_links(spark: SparkSession, d: str) -> DataFrame:
    """Links found in a result page that is written around each report row."""
    t = table(spark, d, "download_report").where("whole_law_url IS NOT NULL")
    a = lambda c, img: F.concat(F.lit('<a  href="'), F.replace(F.col(c), F.lit("/norm/"), F.lit("/norm?x=1&amp;id=")), F.lit(f'" class="i">\n <img src="{img}"></a>'))
    page = F.concat(a("whole_law_url", "completenorm.gif"), a("pdf_url", "pdf.gif"), a("whole_law_url", "CompleteNorm.png"))
    return t.select("law", "whole_law_url", F.array_join(X.complete_links(page), "|").alias("complete"), X.pdf_link(page).alias("pdf"))


def a3_parameter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "download_report").select("law", "search_url", X.query_parameter(F.col("search_url"), "Kurz", "kurz").alias("kurz"))


def a4_abbreviations(spark: SparkSession, d: str) -> DataFrame:
    """Labels of passages and crawled laws that may be the same."""
    a = _laws(spark, d).select(F.col("law_type").alias("label")).where("label IS NOT NULL").distinct()
    b = table(spark, d, "download_report").select("law").where("law IS NOT NULL").distinct()
    return a.join(b, X.abbreviations_match(F.col("label"), F.col("law"), False)).select("label", "law")


def b1_lexical(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", X.lexical(F.col("text")).alias("replaced"), X.lexical(F.col("text"), "remove").alias("removed"), X.lexical(F.col("text"), "keep").alias("kept"))


def b2_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", X.normalize(F.col("text"), X.DROP_LINES).alias("text"))


def b3_noise(spark: SparkSession, d: str) -> DataFrame:
    t = _laws(spark, d).where("law_type IS NOT NULL")
    return t.select("sentence_id", X.strip_noise(F.concat(F.lit("  Norm : "), F.col("law_type"), F.lit(" Stand"))).alias("line"))


def b5_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences per document, without list splitting."""
    t = _docs(spark, d).select("doc_id", F.posexplode(X.sentences(F.col("text"), False)).alias("pos", "sentence"))
    return t.select("doc_id", "pos", "sentence")


def b7_list_parts(spark: SparkSession, d: str) -> DataFrame:
    t = _docs(spark, d).select("doc_id", X.sentences(F.col("text"), True).alias("s"))
    return t.select("doc_id", F.size("s").alias("n"), F.array_join("s", " ¦ ").alias("parts"))


def b8_meaningful(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "ris_sentences")
    return t.select("sentence_id", X.is_meaningful(F.col("sentence"), 25, 3, 0.85).alias("keep"), X.is_meaningful(F.col("sentence"), 130, 12, 0.02).alias("strict"))


def b9_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _laws(spark, d).select("sentence_id", X.token_count(F.col("sentence")).alias("n"))


def b10_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages of each law file, from its sentences in order."""
    t = _laws(spark, d).where("source_file IS NOT NULL").select(F.col("source_file").alias("doc"), F.col("sentence_id").alias("pos"), F.coalesce("page", F.lit(0)).alias("page"), F.col("sentence").alias("text"))
    return P.passages(t)


def b11_headers(spark: SparkSession, d: str) -> DataFrame:
    """Line keys that repeat within a law file, every line taken as an edge line."""
    t = _laws(spark, d).select(F.col("source_file").alias("doc"), F.coalesce("page", F.lit(1)).alias("page"), F.lit(0.0).alias("y0"), F.lit(5.0).alias("y1"), F.lit(100.0).alias("height"), F.col("sentence").alias("text"))
    return P.header_blacklist(t)


def b12_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of documents whose lines are laid out ten points apart."""
    t = _docs(spark, d).select(F.col("doc_id").alias("doc"), F.lit(1).alias("page"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    y = F.col("line") * 10.0
    return P.paragraphs(t.where(X.strip(F.col("text")) != "").select("doc", "page", "line", F.lit(50.0).alias("x0"), y.alias("y0"), (y + 9).alias("y1"), "text")).select("doc", "page", "para", "text")


def b13_merged(spark: SparkSession, d: str) -> DataFrame:
    return P.merge_pages(b12_paragraphs(spark, d))


def b14_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return P.nearest_rank_by(table(spark, d, "ris_sentences"), ["law_type"], "page", [0.1, 0.5, 0.9])


def b15_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return P.keep_first(_laws(spark, d), ["source_file"], "sentence", ["sentence_id"]).select("sentence_id", "source_file")


def a7_corpus(spark: SparkSession, d: str) -> DataFrame:
    t = _laws(spark, d).where("source_file IS NOT NULL").select(F.col("source_file").alias("doc"), F.col("sentence_id").alias("pos"), "page", F.col("sentence").alias("text"))
    return P.corpus(t)


def b16_keywords(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "train").where("query_text IS NOT NULL").select("query_id", "query_text", X.keywords(F.col("query_text")).alias("keywords")).distinct()


def b17_ui_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "test").select("query_id", F.array_join(X.ui_tokens(F.col("query_text")), " ").alias("tokens"))


def e16_leakage(spark: SparkSession, d: str) -> DataFrame:
    """How many queries name their own law, any law, or another one, by style."""
    t = table(spark, d, "test").where("query_text IS NOT NULL")
    labels = t.select(F.col("consensus_law").alias("label")).where("label IS NOT NULL").distinct().select("label", X.label_pattern(F.col("label")).alias("p"))
    hit = t.join(labels, F.expr("query_text RLIKE p")).groupBy("query_id").agg(F.collect_set("label").alias("named"))
    t = t.join(hit, "query_id", "left")
    own = F.coalesce(F.array_contains("named", F.col("consensus_law")), F.lit(False))
    other = F.coalesce(F.size(F.array_except("named", F.array("consensus_law"))) > 0, F.lit(False))
    return t.groupBy("style").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("named").isNotNull()).alias("any_named"), F.count_if(own).alias("gold_named"), F.count_if(other).alias("other_named"))


def c1_unit(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "embedding_index").where("embeddings IS NOT NULL")
    u = vec.unit(F.col("embeddings"))
    return t.select("sentence_id", F.round(u[0], 6).alias("first"), F.round(vec.norm(u), 6).alias("norm"), F.round(vec.dot(F.col("embeddings"), F.col("embeddings")), 4).alias("square"))


def c2_unit_norms(spark: SparkSession, d: str) -> DataFrame:
    t = vec.unit_norms(table(spark, d, "embedding_index").where("embeddings IS NOT NULL"), "embeddings")
    return t.select(*[F.round(c, 6).alias(c) for c in ("p10", "p50", "p90")], "is_unit")


def c4_distances(spark: SparkSession, d: str) -> DataFrame:
    """Least squared distance of each vector to the first vector of each label."""
    e = table(spark, d, "embeddings")
    w = Window.partitionBy("label").orderBy("vec_id")
    proto = e.withColumn("r", F.row_number().over(w)).where("r = 1").select(F.col("embedding").alias("p"))
    t = e.crossJoin(F.broadcast(proto))  # one prototype for each label
    return t.groupBy("vec_id").agg(F.round(F.greatest(F.min(vec.squared_distance(F.col("embedding"), F.col("p"))), F.lit(0.0)), 5).alias("least"))


def c7_output_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Quality of predicting each vector by its own shrunken and shifted copy."""
    t = table(spark, d, "embeddings").withColumn("p", F.transform("embedding", lambda x, i: x.cast("double") * 0.9 + F.when(i == 0, 0.1).otherwise(0.0)))
    m = vec.embedding_metrics(t, "p", "embedding")
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


def c8_fixed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.round(vec.norm(vec.fix_dimension(F.col("embedding"), 8)), 6).alias("norm"))


def g1_ngrams(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "train").where("query_text IS NOT NULL").select(X.ui_tokens(F.col("query_text")).alias("tokens"))
    return N.ngram_model(t).select(F.array_join("ctx", " ").alias("ctx"), "next", "cnt")


def g2_suggestions(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "train").where("query_text IS NOT NULL").select(X.ui_tokens(F.col("query_text")).alias("tokens"))
    q = table(spark, d, "test").where("query_text IS NOT NULL").select(F.col("query_id").alias("id"), F.slice(X.ui_tokens(F.col("query_text")), 1, 2).alias("tokens"))
    return N.suggestions(N.ngram_model(t), q, 3)


def g3_completions(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "train").select(F.explode(X.ui_tokens(F.col("query_text"))).alias("word"))
    return N.completions(t, "salz")


def g4_lengths(spark: SparkSession, d: str) -> DataFrame:
    return N.length_stats(table(spark, d, "train").where("query_text IS NOT NULL").select(X.ui_tokens(F.col("query_text")).alias("tokens")))


def g5_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells written from event values and parsed again."""
    v = F.format_string("%.2f [%.2f, %.2f]", "value", F.col("value") - 1, F.col("value") + 1)
    t = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.format_string("%.2f", "value")).otherwise(v).alias("c"))
    return t.select("event_id", N.parse_cell(F.col("c")).alias("p")).select("event_id", "p.pt", "p.lo", "p.hi")


def h1_tfidf(spark: SparkSession, d: str) -> DataFrame:
    c = L.term_counts(_docs(spark, d), "doc_id", "text")
    w = L.tfidf(c, L.vocabulary(c, _docs(spark, d).count(), 2))
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.round(F.max("w"), 6).alias("top"), F.round(F.sum("w"), 5).alias("total"))


def h1_idf(spark: SparkSession, d: str) -> DataFrame:
    c = L.term_counts(_docs(spark, d), "doc_id", "text")
    return L.vocabulary(c, _docs(spark, d).count(), 2).select("term", "df", F.round("idf", 6).alias("idf"))


def h2_char_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Character n-grams of query texts that two texts or more have, but not more than 99 % of them."""
    t = table(spark, d, "test").where("query_text IS NOT NULL")
    c = L.char_counts(t, "query_id", "query_text")
    return c.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n")).where((F.col("df") >= 2) & (F.col("df") <= 0.99 * t.count()))


def h3_union(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "test").where("query_text IS NOT NULL")
    n = t.count()
    blocks = []
    for c, weight in ((L.term_counts(t, "query_id", "query_text"), 1.0), (L.char_counts(t, "query_id", "query_text"), 0.9)):
        blocks.append(L.tfidf(c, L.vocabulary(c, n, 2), weight=weight))
    u = L.union_features(*blocks)
    return u.groupBy(F.col("doc_id").alias("query_id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("w") * F.col("w")), 5).alias("square"))


def h4_svd_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Test queries against training queries in a reduced lexical space."""
    q, t = (table(spark, d, n).where("query_text IS NOT NULL").select("query_id", "query_text").dropDuplicates(["query_id"]) for n in ("test", "train"))
    return L.answers(q, "query_id", "query_text", t, "query_id", "query_text", 5).select("query_id", "rank", "unit_id", F.round("score", 4).alias("score"))


def i1_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "train").select("query_id", X.stable_hash(F.col("query_id")).alias("h")).distinct()


def i2_capacity(spark: SparkSession, d: str) -> DataFrame:
    s, t = _spec(spark, d)
    return S.template_capacity(t, s)


def _spec(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    laws = table(spark, d, "download_report").select(F.col("law").alias("spec")).where("law IS NOT NULL").distinct()
    slots = laws.select("spec", F.explode(F.expr("array(struct('kind' AS slot, 'Frist' AS value), struct('kind' AS slot, 'Gebühr' AS value), struct('kind' AS slot, 'Frist' AS value), struct('act' AS slot, spec AS value), struct('act' AS slot, 'Antrag' AS value), struct('act' AS slot, 'Bescheid' AS value))")).alias("x")).select("spec", "x.slot", "x.value")
    templates = laws.select("spec", F.explode(F.array(F.lit("{kind} bei {act}"), F.lit("Wer zahlt  {kind}?"), F.lit("Allgemeines"), F.lit("{kind} und {other}"))).alias("template"))
    return slots, templates


def i2_expansion(spark: SparkSession, d: str) -> DataFrame:
    slots, templates = _spec(spark, d)
    return S.expand_templates(templates.where("template NOT LIKE '%other%'"), slots, 5, 19)


def i3_queries(spark: SparkSession, d: str) -> DataFrame:
    """Generated queries for each topic of the test table."""
    t = table(spark, d, "test").where("topic_id IS NOT NULL AND issue IS NOT NULL").groupBy("topic_id").agg(F.min("consensus_law").alias("label"), F.min("issue").alias("issue"))
    styles = {"nl_short": ("Was gilt bei {issue}?", "Wer entscheidet über {issue} in {place}?"), "keyword": ("{issue} {place}",)}
    return G.queries(t, styles, {"place": ("Langtal", "Obermoos", "Kaltbach")})


def i4_noise(spark: SparkSession, d: str) -> DataFrame:
    """How many generated texts differ from those without noise and hints, by style."""
    t = table(spark, d, "test").where("topic_id IS NOT NULL AND issue IS NOT NULL").groupBy("topic_id").agg(F.min("consensus_law").alias("label"), F.min("issue").alias("issue"))
    styles = {"nl_short": ("Was gilt bei {issue}?",), "keyword": ("{issue}",)}
    n = G.queries(t, styles, {}, noise_share=1.0, hint_share=0.0).select("query_id", "style", F.col("query_text").alias("noisy"))
    c = G.queries(t, styles, {}, noise_share=0.0, hint_share=0.0).select("query_id", "query_text")
    return n.join(c, "query_id").groupBy("style").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("noisy") != F.col("query_text")).alias("changed"))


def i5_targets(spark: SparkSession, d: str) -> DataFrame:
    return S.target_counts(table(spark, d, "train"), 1000, "consensus_law")


def i5_style_targets(spark: SparkSession, d: str) -> DataFrame:
    return S.style_targets(i5_targets(spark, d), STYLES, 19)


def i6_sample(spark: SparkSession, d: str) -> DataFrame:
    pool = table(spark, d, "train").where("consensus_law IS NOT NULL").groupBy("query_id").agg(F.min("query_text").alias("query_text"), F.min("consensus_law").alias("label"))
    return S.stratified_sample(pool, S.target_counts(pool, 300), ["label"], 19).select("query_id", "label")


def i7_split(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of splits in the three modes."""
    pool = table(spark, d, "train").where("consensus_law IS NOT NULL AND topic_id IS NOT NULL").groupBy("query_id").agg(F.min("query_text").alias("query_text"), F.min("topic_id").alias("topic_id"), F.min("consensus_law").alias("label"))
    out = None
    for mode in ("iid", "iid_unrestricted", "topic_disjoint"):
        t = S.split_train_test(pool, S.target_counts(pool, 400), S.target_counts(pool, 100), ["label"], 19, mode)
        t = t.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("query_text").alias("texts"), F.count_distinct("topic_id").alias("topics")).withColumn("mode", F.lit(mode))
        out = t if out is None else out.unionByName(t)
    return out


def i8_terms(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "train").select("query_id", S.merged_terms(F.split("issue", " "), F.array("style"), F.split("issue", " ")).alias("t"))
    return t.select("query_id", F.array_join("t", "|").alias("terms")).distinct()


def i9_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "train").groupBy("consensus_law", "style").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (a2_links, a3_parameter, a4_abbreviations, a7_corpus, b1_lexical, b2_normalize, b3_noise, b5_sentences, b7_list_parts, b8_meaningful, b9_tokens, b10_passages, b11_headers, b12_paragraphs, b13_merged, b14_nearest_rank, b15_keep_first, b16_keywords, b17_ui_tokens, c1_unit, c2_unit_norms, c4_distances, c7_output_metrics, c8_fixed, e16_leakage, g1_ngrams, g2_suggestions, g3_completions, g4_lengths, g5_cells, h1_idf, h1_tfidf, h2_char_ngrams, h3_union, h4_svd_retrieval, i1_hash, i2_capacity, i2_expansion, i3_queries, i4_noise, i5_targets, i5_style_targets, i6_sample, i7_split, i8_terms, i9_counts)}

# SQL. RE2 has no Unicode classes for \s, \d, \w and no look-around: they are spelt out.
_S = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
_W = r"[\p{L}\p{N}_]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_S}+|{_S}+$', '', 'g')"


def _lexical_sql(c: str, to: str | None) -> str:
    c = f"regexp_replace({c}, '§+', ' paragraf ', 'g')"
    if to is not None:
        c = rf"regexp_replace({c}, '\b(\d+)\b', '{to}', 'g')"
    return _strip(f"regexp_replace(lower({c}), '{_S}+', ' ', 'g')")


def _normalize_sql(c: str) -> str:
    c = f"replace({c}, '­', '')"
    c = rf"regexp_replace({c}, '(?m)^{_S}*www\.ris\.bka\.gv\.at{_S}+Seite{_S}+\d+{_S}+von{_S}+\d+{_S}*$', '', 'gi')"
    c = rf"regexp_replace({c}, '(?m)^{_S}*https?://\S+{_S}*$', '', 'gi')"
    keep = rf"NOT (regexp_matches(trim(x), '^({_S}*Seite{_S}+\d+({_S}+von{_S}+\d+)?{_S}*|{_S}*www\.ris\.bka\.gv\.at{_S}*|{_S}*RIS{_S}*)$', 'i'))"
    line = "x"
    for p in X.NOISE_PREFIXES:
        line = f"regexp_replace({line}, '{p.replace(chr(92) + 's', _S)}', '', 'i')"
    c = rf"array_to_string(list_transform(list_filter(string_split_regex({c}, '\r\n|[\n\x0b\f\r\x85\x{{2028}}\x{{2029}}\x1c-\x1e]'), lambda x: {keep}), lambda x: {line}), chr(10))"
    c = rf"regexp_replace({c}, '({LETTERS})-{_S}*\n{_S}*([a-zäöüß])', '\1\2', 'g')"
    c = rf"regexp_replace({c}, '({LETTERS})-{_S}*\n{_S}*([A-ZÄÖÜ])', '\1-\2', 'g')"
    for mark in (r"([IVXLCDM]{1,8})\.", r"\((\d{1,3})\)", r"([A-Za-z])\.", r"(\d{1,3})\."):
        c = rf"regexp_replace({c}, '(?m)^{_S}*{mark}{_S}+', '\1) ', 'g')"
    c = rf"regexp_replace({c}, '([:;]){_S}*(\d{{1,3}})\.{_S}+', '\1 \2) ', 'g')"
    c = rf"regexp_replace({c}, '{_S}*\n{_S}*', ' ', 'g')"
    return _strip(rf"regexp_replace({c}, '[ \t\r\f\x0B]+', ' ', 'g')")


_UI = "regexp_extract_all(lower(trim({0})), '[a-zäöüß0-9]+')"


def _meaningful(chars: int, words: int, digits: float) -> str:
    return rf"""(SELECT sentence_id, coalesce(length(s) >= {chars} AND length(s) > 0 AND NOT regexp_matches(s, '^(?:{_S}|[\-–—.,;:/()\[\]{{}}])+$')
  AND len(regexp_extract_all(s, '{LETTERS}+')) >= {words} AND len(regexp_extract_all(s, '\p{{Nd}}')) / greatest(length(s), 1) <= {digits}, false) AS keep FROM (SELECT sentence_id, {_strip('sentence')} AS s FROM ris_sentences))"""


_TERMS = "t AS (SELECT doc_id, unnest(regexp_extract_all(" + _lexical_sql("text", r" num\1 ") + rf", '{_W}+')) AS term FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL), v AS (SELECT term, count(*) AS df, ln((1.0 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM c, n GROUP BY 1 HAVING count(*) >= 2)"
_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)

ORACLE = {
    "a3_parameter": "SELECT law, search_url, nullif(url_decode(regexp_extract(search_url, '[?&][Kk]urz=([^&#]*)', 1)), '') AS kurz FROM download_report",
    "a4_abbreviations": "WITH a AS (SELECT DISTINCT law_type AS label, regexp_replace(upper(law_type), '[^0-9A-Z]+', '', 'g') AS x FROM ris_sentences WHERE sentence IS NOT NULL AND law_type IS NOT NULL), b AS (SELECT DISTINCT law, regexp_replace(upper(law), '[^0-9A-Z]+', '', 'g') AS y FROM download_report WHERE law IS NOT NULL) SELECT label, law FROM a, b WHERE x <> '' AND y <> '' AND (starts_with(x, y) OR starts_with(y, x))",
    "b1_lexical": "SELECT doc_id, " + _lexical_sql("text", r" num\1 ") + " AS replaced, " + _lexical_sql("text", " ") + " AS removed, " + _lexical_sql("text", None) + " AS kept FROM documents WHERE text IS NOT NULL",
    "b2_normalize": "SELECT doc_id, " + _normalize_sql("text") + " AS text FROM documents WHERE text IS NOT NULL",
    "b3_noise": "SELECT sentence_id, ltrim(law_type) || ' Stand' AS line FROM ris_sentences WHERE sentence IS NOT NULL AND law_type IS NOT NULL",
    "b8_meaningful": "SELECT a.sentence_id, a.keep, b.keep AS strict FROM " + _meaningful(25, 3, 0.85) + " a JOIN " + _meaningful(130, 12, 0.02) + " b USING (sentence_id)",
    "b9_tokens": f"SELECT sentence_id, CAST(len(regexp_extract_all(sentence, '{_W}+')) AS INTEGER) AS n FROM ris_sentences WHERE sentence IS NOT NULL",
    "b11_headers": rf"WITH l AS (SELECT source_file AS doc, coalesce(page, 1) AS page, regexp_replace(lower({_strip(f'''regexp_replace(sentence, '{_S}+', ' ', 'g')''')}), '\p{{Nd}}+', '<d>', 'g') AS key FROM ris_sentences WHERE sentence IS NOT NULL), p AS (SELECT doc, max(page) AS pages FROM l GROUP BY 1), k AS (SELECT doc, key, count(*) AS n FROM l WHERE key <> '' GROUP BY ALL) SELECT doc, key FROM k JOIN p USING (doc) WHERE n >= greatest(3, round_even(pages * 0.2, 0)) AND length(key) BETWEEN 2 AND 120",
    "b14_nearest_rank": "WITH r AS (SELECT law_type, page, row_number() OVER (PARTITION BY law_type ORDER BY page) - 1 AS i, count(*) OVER (PARTITION BY law_type) AS n FROM ris_sentences WHERE page IS NOT NULL) SELECT law_type, max(page) FILTER (i = round_even((n - 1) * 0.1, 0)) AS q0, max(page) FILTER (i = round_even((n - 1) * 0.5, 0)) AS q1, max(page) FILTER (i = round_even((n - 1) * 0.9, 0)) AS q2 FROM r GROUP BY 1",
    "b15_keep_first": "SELECT min(sentence_id) AS sentence_id, source_file FROM ris_sentences WHERE sentence IS NOT NULL GROUP BY source_file, sentence",
    "b16_keywords": f"WITH t AS (SELECT DISTINCT query_id, query_text, list_filter(list_transform(regexp_extract_all(replace(query_text, '-', ' '), '[A-Za-zÄÖÜäöüß0-9]+'), lambda x: lower(x)), lambda x: x NOT IN ({_STOP}) AND (regexp_matches(x, '^[0-9]+$') OR length(x) > 2)) AS w FROM train WHERE query_text IS NOT NULL) SELECT query_id, query_text, CASE WHEN len(w) > 0 THEN array_to_string(w[1:10], ' ') ELSE lower(substr(query_text, 1, 50)) END AS keywords FROM t",
    "b17_ui_tokens": f"SELECT query_id, array_to_string({_UI.format('query_text')}, ' ') AS tokens FROM test",
    "c1_unit": "WITH t AS (SELECT sentence_id, list_transform(embeddings, lambda x: CAST(x AS DOUBLE)) AS e FROM embedding_index WHERE embeddings IS NOT NULL), s AS (SELECT *, list_dot_product(e, e) AS q FROM t) SELECT sentence_id, round(e[1] / greatest(sqrt(q), 1e-12), 6) AS first, CASE WHEN q > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS norm, round(q, 4) AS square FROM s",
    "c2_unit_norms": "WITH t AS (SELECT sqrt(list_dot_product(e, e)) AS n FROM (SELECT list_transform(embeddings, lambda x: CAST(x AS DOUBLE)) AS e FROM embedding_index WHERE embeddings IS NOT NULL)), q AS (SELECT quantile_cont(n, 0.1) AS p10, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.9) AS p90 FROM t) SELECT round(p10, 6) AS p10, round(p50, 6) AS p50, round(p90, 6) AS p90, p50 BETWEEN 0.9 AND 1.1 AND p10 >= 0.8 AND p90 <= 1.2 AS is_unit FROM q",
    "c4_distances": "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), p AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1) SELECT v.vec_id, round(greatest(min(list_dot_product(v.e, v.e) + list_dot_product(p.e, p.e) - 2 * list_dot_product(v.e, p.e)), 0), 5) AS least FROM v, p GROUP BY 1",
    "c7_output_metrics": "WITH v AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS y, list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * 0.9::DOUBLE + CASE WHEN i = 1 THEN 0.1::DOUBLE ELSE 0::DOUBLE END) AS p FROM embeddings), r AS (SELECT len(y) AS n, list_sum(y) AS s, list_dot_product(y, y) AS ss, list_dot_product(p, p) + list_dot_product(y, y) - 2 * list_dot_product(p, y) AS sse, list_dot_product(p, y) / sqrt(list_dot_product(p, p) * list_dot_product(y, y)) AS c FROM v) SELECT round(sum(sse) / sum(n), 6) AS mse, round(1 - sum(sse) / (sum(ss) - sum(s) * sum(s) / sum(n)), 6) AS r2, round(avg(c), 6) AS cos_mean, round(quantile_cont(c, 0.1), 6) AS cos_p10, round(quantile_cont(c, 0.5), 6) AS cos_p50, round(quantile_cont(c, 0.9), 6) AS cos_p90 FROM r",
    "c8_fixed": "SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS norm FROM (SELECT vec_id, list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)",
    "e16_leakage": r"WITH t AS (SELECT * FROM test WHERE query_text IS NOT NULL), l AS (SELECT DISTINCT consensus_law AS label FROM t WHERE consensus_law IS NOT NULL), h AS (SELECT query_id, list(label) AS named FROM t, l WHERE regexp_matches(query_text, '(?i)(^|[^\p{L}\p{N}_])' || regexp_escape(label) || '($|[^\p{L}\p{N}_])') GROUP BY 1) SELECT style, count(*) AS n, count(named) AS any_named, count(*) FILTER (list_contains(named, consensus_law)) AS gold_named, count(*) FILTER (len(list_filter(named, lambda x: x IS DISTINCT FROM consensus_law)) > 0) AS other_named FROM t LEFT JOIN h USING (query_id) GROUP BY 1",
    "g1_ngrams": f"WITH t AS (SELECT ['<s>', '<s>'] || {_UI.format('query_text')} || ['</s>'] AS w FROM train WHERE query_text IS NOT NULL AND len({_UI.format('query_text')}) >= 2), g AS (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM t) SELECT w[i] || ' ' || w[i + 1] AS ctx, w[i + 2] AS next, count(*) AS cnt FROM g GROUP BY ALL",
    "g2_suggestions": f"WITH t AS (SELECT ['<s>', '<s>'] || {_UI.format('query_text')} || ['</s>'] AS w FROM train WHERE query_text IS NOT NULL AND len({_UI.format('query_text')}) >= 2), g AS (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM t), m AS (SELECT * FROM (SELECT w[i] AS a, w[i + 1] AS b, w[i + 2] AS next, count(*) AS cnt FROM g GROUP BY ALL) WHERE next NOT IN ('<s>', '</s>')), q AS (SELECT query_id AS id, ['<s>', '<s>'] || {_UI.format('query_text')}[1:2] AS w FROM test WHERE query_text IS NOT NULL AND len({_UI.format('query_text')}) > 0), d AS (SELECT id, next, cnt FROM q JOIN m ON a = w[-2] AND b = w[-1]), f AS (SELECT * FROM d UNION ALL SELECT id, next, cnt FROM q JOIN m ON a = '<s>' AND b = w[-1] WHERE id NOT IN (SELECT id FROM d)) SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY cnt DESC, next) AS INTEGER) AS rank FROM f QUALIFY rank <= 3",
    "g3_completions": f"SELECT DISTINCT word, FROM (SELECT unnest({_UI.format('query_text')}) AS word FROM train) WHERE starts_with(word, 'salz') AND word <> 'salz' ORDER BY length(word), word LIMIT 8",
    "g4_lengths": f"WITH t AS (SELECT len({_UI.format('query_text')}) AS n FROM train WHERE query_text IS NOT NULL) SELECT CAST(quantile_cont(n, 0.5) AS DOUBLE) AS median, CAST(quantile_cont(n, 0.95) AS DOUBLE) AS p95 FROM t",
    "g5_cells": "SELECT event_id, CAST(printf('%.2f', value) AS DOUBLE) AS pt, CASE WHEN event_id % 3 <> 0 THEN CAST(printf('%.2f', value - 1) AS DOUBLE) END AS lo, CASE WHEN event_id % 3 <> 0 THEN CAST(printf('%.2f', value + 1) AS DOUBLE) END AS hi FROM events",
    "h1_idf": "WITH " + _TERMS + " SELECT term, df, round(idf, 6) AS idf FROM v",
    "h1_tfidf": "WITH " + _TERMS + ", w AS (SELECT doc_id, (1 + ln(tf)) * idf AS w FROM c JOIN v USING (term)), u AS (SELECT doc_id, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w) SELECT doc_id, count(*) AS terms, round(max(w), 6) AS top, round(sum(w), 5) AS total FROM u GROUP BY 1",
    "i1_hash": "WITH t AS (SELECT DISTINCT query_id, list_transform(string_split(query_id, ''), lambda x: unicode(x)::HUGEINT) AS c FROM train) SELECT query_id, CAST(list_reduce(list_prepend(0::HUGEINT, list_transform(c, lambda x, i: x * i)), lambda a, b: (a * 131 + b) % 4294967296) AS BIGINT) AS h FROM t",
    "i2_capacity": "SELECT law AS spec, CASE WHEN law IN ('Antrag', 'Bescheid') THEN 2 ELSE 3 END * 2::BIGINT + 2 + 1 AS capacity FROM (SELECT DISTINCT law FROM download_report WHERE law IS NOT NULL)",
    "i5_targets": "WITH u AS (SELECT DISTINCT consensus_law AS label FROM train WHERE consensus_law IS NOT NULL), r AS (SELECT label, row_number() OVER (ORDER BY label) AS r, count(*) OVER () AS m FROM u) SELECT label, 1000 // m + CAST(r <= 1000 % m AS BIGINT) AS target FROM r",
    "i8_terms": "SELECT DISTINCT query_id, array_to_string(list_filter(CASE WHEN issue IS NULL THEN [style] ELSE list_transform(list_filter(list_zip(string_split(issue, ' ') || [style], range(1, 100)), lambda x: x[1] IS NOT NULL AND list_position(string_split(issue, ' ') || [style], x[1]) = x[2]), lambda x: x[1]) END, lambda x: x IS NOT NULL), '|') AS terms FROM train",
    "i9_counts": "SELECT consensus_law, style, count(*) AS n FROM train GROUP BY ALL",
    "a2_links": "WITH t AS (SELECT law, whole_law_url, replace(whole_law_url, '/norm/', '/norm?x=1&id=') AS w, replace(pdf_url, '/norm/', '/norm?x=1&id=') AS p FROM download_report WHERE whole_law_url IS NOT NULL) SELECT law, whole_law_url, w AS complete, p AS pdf FROM t",
    "a7_corpus": "WITH k AS (SELECT s.*, row_number() OVER (PARTITION BY source_file, sentence ORDER BY sentence_id) AS r FROM ris_sentences s JOIN " + _meaningful(25, 3, 0.85) + rf""" m USING (sentence_id) WHERE m.keep AND source_file IS NOT NULL AND NOT regexp_matches({_strip('sentence')}, '^(Seite{_S}+\d+({_S}+von{_S}+\d+)?|www\.ris\.bka\.gv\.at|RIS)$', 'i'))
SELECT row_number() OVER (ORDER BY source_file, sentence_id) AS unit_id, regexp_replace(source_file, '\.[^.]*$', '') AS label, page, sentence AS text, source_file FROM k WHERE r = 1""",
    "h2_char_ngrams": "WITH w AS (SELECT query_id, ' ' || unnest(list_filter(string_split(" + _lexical_sql("query_text", r" num\1 ") + ", ' '), lambda x: x <> '')) || ' ' AS w FROM test WHERE query_text IS NOT NULL), g AS (SELECT query_id, substr(w, i, n) AS term FROM w, range(3, 7) t(n), range(1, 1000) u(i) WHERE (length(w) >= n OR n = 3) AND i <= greatest(length(w) - n + 1, 1)) SELECT term, count(DISTINCT query_id) AS df, count(*) AS n FROM g GROUP BY 1 HAVING count(DISTINCT query_id) BETWEEN 2 AND 0.99 * (SELECT count(*) FROM test WHERE query_text IS NOT NULL)",
    "h3_union": "WITH q AS (SELECT query_id, " + _lexical_sql("query_text", r" num\1 ") + rf" AS s FROM test WHERE query_text IS NOT NULL), n AS (SELECT count(*) AS n FROM q), t AS (SELECT 0 AS b, 1.0::DOUBLE AS weight, query_id, unnest(regexp_extract_all(s, '{_W}+')) AS term FROM q UNION ALL SELECT 1, 0.9, query_id, substr(w, i, n) FROM (SELECT query_id, ' ' || unnest(list_filter(string_split(s, ' '), lambda x: x <> '')) || ' ' AS w FROM q), range(3, 7) r(n), range(1, 1000) u(i) WHERE (length(w) >= n OR n = 3) AND i <= greatest(length(w) - n + 1, 1)), c AS (SELECT b, weight, query_id, term, count(*) AS tf FROM t GROUP BY ALL), v AS (SELECT b, term, ln((1.0 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM c, n GROUP BY 1, 2 HAVING count(*) >= 2), w AS (SELECT b, query_id, weight, (1 + ln(tf)) * idf AS w FROM c JOIN v USING (b, term)), u AS (SELECT query_id, weight * w / sqrt(sum(w * w) OVER (PARTITION BY b, query_id)) AS w FROM w) SELECT query_id, count(*) AS n, round(sum(w * w), 5) AS square FROM u GROUP BY 1",
    "i2_expansion": "WITH laws AS (SELECT DISTINCT law AS spec FROM download_report WHERE law IS NOT NULL), kinds AS (SELECT unnest(['Frist', 'Gebühr']) AS kind), t AS (SELECT spec, kind || ' bei ' || act AS text FROM (SELECT DISTINCT spec, unnest([spec, 'Antrag', 'Bescheid']) AS act FROM laws), kinds UNION SELECT spec, 'Wer zahlt ' || kind || '?' FROM laws, kinds UNION SELECT spec, 'Allgemeines' FROM laws) SELECT spec, text FROM t QUALIFY row_number() OVER (PARTITION BY spec ORDER BY md5('19|' || text), text) <= 5",
    "i5_style_targets": "WITH u AS (SELECT DISTINCT consensus_law AS label FROM train WHERE consensus_law IS NOT NULL), r AS (SELECT label, row_number() OVER (ORDER BY label) AS r, count(*) OVER () AS m FROM u), t AS (SELECT label, 1000 // m + CAST(r <= 1000 % m AS BIGINT) AS target FROM r), s AS (SELECT label, target, style, row_number() OVER (PARTITION BY label ORDER BY md5('19|' || label || '|' || style)) AS r FROM t, (SELECT unnest([" + ", ".join(f"'{x}'" for x in STYLES) + f"]) AS style)) SELECT label, style, target // {len(STYLES)} + CAST(r <= target % {len(STYLES)} AS BIGINT) AS target FROM s",
}

_POOL = "pool AS (SELECT query_id, min(query_text) AS query_text, {0} min(consensus_law) AS label FROM train WHERE consensus_law IS NOT NULL {1} GROUP BY 1), labels AS (SELECT label, row_number() OVER (ORDER BY label) AS r, count(*) OVER () AS m FROM (SELECT DISTINCT label FROM pool))"


def _sample_sql(name: str, pool: str, total: int, seed: int, forbid: str = "SELECT NULL WHERE false") -> str:
    """CTEs of a stratified sample: the first row of each text in hash order, then the first of each label."""
    return f""", {name}_f AS (SELECT *, md5('{seed}|' || query_id) AS key FROM {pool} WHERE query_text IS NOT NULL AND query_text NOT IN ({forbid})),
{name}_o AS (SELECT * FROM {name}_f QUALIFY row_number() OVER (PARTITION BY query_text ORDER BY key, query_id) = 1),
{name} AS (SELECT o.* FROM {name}_o o JOIN labels USING (label) QUALIFY row_number() OVER (PARTITION BY label ORDER BY key, query_id) <= {total} // m + CAST(r <= {total} % m AS BIGINT))"""


def _split_sql() -> str:
    test = {"iid": "SELECT p.* FROM pool p WHERE (label, topic_id) IN (SELECT label, topic_id FROM a)", "iid_unrestricted": "SELECT * FROM pool", "topic_disjoint": "SELECT * FROM pool WHERE topic_id NOT IN (SELECT topic_id FROM a)"}
    sql = "WITH " + _POOL.format("min(topic_id) AS topic_id,", "AND topic_id IS NOT NULL") + _sample_sql("a", "pool", 400, 19)
    for i, (mode, rest) in enumerate(test.items()):
        sql += f", rest{i} AS ({rest})" + _sample_sql(f"b{i}", f"rest{i}", 100, 120, "SELECT query_text FROM a")
    count = "SELECT '{1}' AS split, count(*) AS n, count(DISTINCT query_text) AS texts, count(DISTINCT topic_id) AS topics, '{2}' AS mode FROM {0} HAVING count(*) > 0"
    return sql + " " + " UNION ALL ".join(count.format(t, s, mode) for i, mode in enumerate(test) for t, s in (("a", "train"), (f"b{i}", "test")))


ORACLE["i6_sample"] = "WITH " + _POOL.format("", "") + _sample_sql("a", "pool", 300, 19) + " SELECT query_id, label FROM a"
ORACLE["i7_split"] = _split_sql()
