"""TF-IDF with a fixed or learnt vocabulary, character n-grams, feature union and truncated SVD."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import WORD, lexical
from quillstone.operators.retrieval import topk
from quillstone.session import discard, materialize, read_shared, release, shared_files, tasks, trim

SLICE = 256
BATCH = 1024  # dense vectors made together
NONZEROS = 2048  # entries multiplied together
CELLS = 1 << 22  # cells of products of terms that a task sums up at once
PAIRS = 1 << 20  # pairs of entries added together


def term_counts(docs: DataFrame, id_col: str, text_col: str, number_mode: str = "replace") -> DataFrame:
    """(doc_id, term, tf) of the preprocessed text's words."""
    words = F.regexp_extract_all(lexical(F.col(text_col), number_mode), F.lit(f"{WORD}+"), F.lit(0))
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(words).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def char_counts(docs: DataFrame, id_col: str, text_col: str, low: int = 3, high: int = 6, number_mode: str = "replace") -> DataFrame:
    """(doc_id, term, tf) of character n-grams within words, each word between blanks; a word shorter than n gives itself once."""
    words = F.filter(F.split(lexical(F.col(text_col), number_mode), " "), lambda w: w != "")
    t = docs.select(F.col(id_col).alias("doc_id"), F.explode(words).alias("w")).withColumn("w", F.concat(F.lit(" "), F.col("w"), F.lit(" ")))
    t = t.withColumn("n", F.explode(F.sequence(F.lit(low), F.lit(high)))).where((F.length("w") >= F.col("n")) | (F.col("n") == low))
    t = t.withColumn("i", F.explode(F.sequence(F.lit(1), F.greatest(F.length("w") - F.col("n") + 1, F.lit(1)))))
    return t.groupBy("doc_id", F.substring(F.col("w"), F.col("i"), F.col("n")).alias("term")).agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(counts: DataFrame, n_docs: int, min_df: int = 1, max_df: float = 1.0, most: int | None = None) -> DataFrame:
    """(term, df, idf) with the smoothed idf ln((1 + n) / (1 + df)) + 1; `most` keeps the terms that occur most often."""
    v = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    if most:
        v = v.orderBy(F.desc("total"), "term").limit(most)
    return v.select("term", "df", (F.log(F.lit(1.0 + n_docs) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(counts: DataFrame, vocab: DataFrame, sublinear: bool = True, l2: bool = True, weight: float = 1.0) -> DataFrame:
    """(doc_id, term, w): tf or 1 + ln tf, times idf, times `weight`, of unit length per document if `l2`."""
    tf = (1 + F.log("tf")) if sublinear else F.col("tf").cast("double")
    t = counts.join(vocab.select("term", "idf"), "term").select("doc_id", "term", (tf * F.col("idf")).alias("w"))
    if l2:
        n = t.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n"))
        t = t.join(n, "doc_id").select("doc_id", "term", (F.col("w") / F.greatest("n", F.lit(1e-12))).alias("w"))
    return t.select("doc_id", "term", (F.col("w") * weight).alias("w"))


def union_features(*blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, term, w) side by side: terms get the number of their block."""
    out = None
    for i, b in enumerate(blocks):
        b = b.select("doc_id", F.concat(F.lit(f"{i}:"), F.col("term")).alias("term"), "w")
        out = b if out is None else out.unionByName(b)
    return out


def cosine_topk(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, doc_id, score): sparse inner products through the common terms; ties to the smaller id."""
    q = queries.select(F.col("doc_id").alias("query_id"), "term", F.col("w").alias("qw"))
    s = q.join(docs, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("qw") * F.col("w")).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


class TruncatedSVD:
    """Uncentred truncated SVD of a sparse table (doc_id, term, w) by randomised subspace iteration.

    Matrices of (terms x components) are tables of slices of SLICE terms in the shared folder, which the
    tasks read; the driver holds (components x components) only. Each pass over the documents is one
    distributed sum; where documents are many for their terms, products of terms are summed up once and the
    passes are over them. The signs of components are arbitrary: compare scores, not coordinates. The number of
    components is at most one less than the number of terms or documents. A row with `copies` counts so many times.
    """

    def __init__(self, terms: list[str], components: DataFrame, singular: np.ndarray) -> None:
        self.terms, self.components, self.singular = terms, components, singular

    @classmethod
    def fit(cls, weights: DataFrame, k: int, vocab: DataFrame, iterations: int = 6, oversample: int = 10, seed: int = 42, most_terms: int = 200_000) -> TruncatedSVD:
        """`weights` is (doc_id, term, w), or (doc_id, idx, val) with the places of the terms in order (see `weight_rows`)."""
        terms = _terms(vocab, most_terms)
        spark = weights.sparkSession
        rows = weights if "idx" in weights.columns else materialize(_rows(weights, terms), "svd-rows")
        copies, size = F.col("copies") if "copies" in rows.columns else F.lit(1), F.size("idx").cast("long")
        n, entries, pairs = rows.agg(F.coalesce(F.sum(copies), F.lit(0)), F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(size * size), F.lit(0))).first()
        k = max(1, min(k, len(terms) - 1, n - 1))
        width = min(len(terms), k + oversample)
        if hasattr(rows, "_quillstone_path") and _summed_pays(len(terms), entries, pairs, iterations + 1, width):
            products = _products(rows, len(terms))
            gram = lambda q: _product(spark, products, q, len(terms))
        else:
            products = None
            # a task's sum has a row for each term: it should have several entries for each, and there is one for each core
            rows = rows.coalesce(max(1, min(entries // (4 * max(1, len(terms))), tasks(spark, 1))))
            gram = lambda q: _gram(rows, q, len(terms))

        def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rng = np.random.default_rng(seed)
                for i in range(b.num_rows and -(-len(terms) // SLICE)):
                    yield _block(i, rng.normal(size=(min(SLICE, len(terms) - i * SLICE), width)))

        q = _orthonormal(materialize(spark.range(1, numPartitions=1).mapInArrow(start, BLOCKS), "svd-start"), width)
        for _ in range(iterations):
            product = gram(q)
            discard(q)
            q = _orthonormal(product, _width(q))
        product, width = gram(q), _width(q)
        if products is not None:
            discard(products)
        path = q._quillstone_path

        def both() -> Callable[[int, np.ndarray], np.ndarray]:
            base = _matrix(path, len(terms), width)

            def of(i: int, y: np.ndarray) -> np.ndarray:
                x = base[i * SLICE : i * SLICE + len(y)].astype(np.float64)
                return np.concatenate([x.T @ y, x.T @ x])

            return of

        inner, square = np.split(_summed(product, width, both), 2)
        discard(product)
        # the base is orthonormal up to rounding only
        root = np.linalg.inv(np.linalg.cholesky(square))
        values, vectors = np.linalg.eigh(root @ ((inner + inner.T) / 2) @ root.T)
        order = np.argsort(-values)[:k]
        out = _times(q, width, root.T @ vectors[:, order], "svd-components")
        discard(q)
        return cls(terms, out, np.sqrt(np.maximum(values[order], 0)))

    def transform(self, weights: DataFrame, unit_length: bool = False, kind: str = "double") -> DataFrame:
        """(doc_id, emb), of unit length if wished, as "double" or "float": documents without any known term have no row."""
        path, n, width = self.components._quillstone_path, len(self.terms), len(self.singular)
        t = weights.schema["doc_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = None
            for b in (b.slice(i, BATCH) for b in batches for i in range(0, b.num_rows, BATCH)):  # dense vectors are large
                c = _matrix(path, n, width) if c is None else c
                emb = np.zeros((len(b), width))
                for lo, hi, idx, val, at in _pieces(b):
                    emb[lo:hi] = np.add.reduceat(val[:, None] * c[idx], at, axis=0)
                if unit_length:
                    emb /= np.maximum(np.linalg.norm(emb, axis=1, keepdims=True), 1e-12)
                lists = pa.ListArray.from_arrays(np.arange(len(b) + 1, dtype=np.int32) * width, pa.array(emb.ravel().astype(np.float32 if kind == "float" else np.float64, copy=False)))
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), lists], names=["doc_id", "emb"])
            c = None
            trim()

        rows = weights if "idx" in weights.columns else _rows(weights, self.terms)
        return rows.select("doc_id", "idx", "val").mapInArrow(run, f"doc_id {t}, emb array<{kind}>")


def build_index(docs: DataFrame, id_col: str, text_col: str, dim: int = 512, min_df: int = 1, most_terms: int = 100_000, chars: bool = False, iterations: int = 6, seed: int = 42) -> tuple[DataFrame, TruncatedSVD, DataFrame]:
    """(doc_id, emb) of unit length, the SVD and the vocabulary (term, df, idf), fitted on `docs`.

    With `chars`, character n-grams of three to six letters are joined with weight 0.9. Of the documents only
    the weights of their terms are written; dense vectors, which take many times the space of the texts, are computed as they are read.
    """
    n, vocab = docs.count(), None
    for i, (counts, _) in enumerate(_counts(docs, id_col, text_col, chars)):
        v = vocabulary(counts, n, min_df, most=most_terms // (1 + chars)).withColumn("term", F.concat(F.lit(f"{i}:"), F.col("term")))
        vocab = v if vocab is None else vocab.unionByName(v)
    vocab = materialize(vocab, "vocabulary")
    w = materialize(weight_rows(docs, id_col, text_col, vocab, _terms(vocab, most_terms), chars), "svd-rows")
    release(docs.sparkSession)
    svd = TruncatedSVD.fit(w, dim, vocab, iterations, seed=seed, most_terms=most_terms)
    return _vectors(svd, w), svd, vocab


def answers(queries: DataFrame, query_id: str, query_text: str, docs: DataFrame, id_col: str, text_col: str, k: int, dim: int = 512, min_df: int = 1, most_terms: int = 100_000, iterations: int = 6, seed: int = 42) -> DataFrame:
    """(query_id, rank, unit_id, score): the k best of `docs` for each query in the space of `build_index`, ties to the smaller id.

    Documents, and queries, of the same words are compared once; each of their ids has its place in the result.
    """
    n, counts = docs.count(), _counts(docs, id_col, text_col, False)[0][0]
    vocab = materialize(vocabulary(counts, n, min_df, most=most_terms).withColumn("term", F.concat(F.lit("0:"), F.col("term"))), "vocabulary")
    terms = _terms(vocab, most_terms)
    units, unit_copies = _once(weight_rows(docs, id_col, text_col, vocab, terms))
    asked, asked_copies = _once(weight_rows(queries, query_id, query_text, vocab, terms))
    release(docs.sparkSession)
    svd = TruncatedSVD.fit(units, dim, vocab, iterations, seed=seed, most_terms=most_terms)
    found = topk(_vectors(svd, asked).withColumnRenamed("doc_id", "query_id"), _vectors(svd, units).withColumnRenamed("doc_id", "unit_id"), k).drop("rank")
    if unit_copies is not None or asked_copies is not None:
        found = materialize(found, "answers")
    if unit_copies is not None:
        w = Window.partitionBy("first").orderBy("doc_id")
        few = unit_copies.withColumn("r", F.row_number().over(w)).where(F.col("r") < k)  # besides the first
        found = found.unionByName(found.join(few, F.col("unit_id") == F.col("first")).select("query_id", F.col("doc_id").alias("unit_id"), "score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "unit_id")
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if asked_copies is not None:
        best = best.unionByName(best.join(asked_copies, F.col("query_id") == F.col("first")).select(F.col("doc_id").alias("query_id"), "unit_id", "score", "rank"))
    return best.select("query_id", "rank", "unit_id", "score")


def _vectors(svd: TruncatedSVD, rows: DataFrame) -> DataFrame:
    return svd.transform(rows, True, "float")


def _once(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, idx, val, copies): equal rows once, under their smallest id; and (first, doc_id), the other ids of each, if there are any."""
    rows = materialize(rows.withColumn("h", F.xxhash64("idx", "val")), "lexical-rows")
    once = rows.groupBy("h", "idx", "val").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    once = materialize(once.select("doc_id", "h", "idx", "val", "copies"), "svd-rows")
    same = once.where("copies > 1").select(F.col("doc_id").alias("first"), "h", "idx", "val")
    others = materialize(rows.join(same, ["h", "idx", "val"]).where("doc_id <> first").select("first", "doc_id"), "copies")
    discard(rows)
    return once, None if others.isEmpty() else others


def embed(docs: DataFrame, id_col: str, text_col: str, svd: TruncatedSVD, vocab: DataFrame, chars: bool = False) -> DataFrame:
    """(doc_id, emb): other texts in the space of `build_index`; texts without any known term have no row."""
    return _vectors(svd, materialize(weight_rows(docs, id_col, text_col, vocab, svd.terms, chars), "lexical-rows"))


def _counts(docs: DataFrame, id_col: str, text_col: str, chars: bool) -> list[tuple[DataFrame, float]]:
    """The counts of terms, and of character n-grams, with their weights; rows of a document are brought together once, as texts."""
    docs = docs.select(id_col, text_col).repartition(id_col)
    return [(term_counts(docs, id_col, text_col), 1.0), *([(char_counts(docs, id_col, text_col), 0.9)] if chars else [])]


def weight_rows(docs: DataFrame, id_col: str, text_col: str, vocab: DataFrame, terms: list[str], chars: bool = False) -> DataFrame:
    """(doc_id, idx, val): the weights of `tfidf` of each document, terms by their places in `terms`; single terms are never shuffled."""
    known = F.broadcast(vocab.select("term", "idf").join(_numbers(docs.sparkSession, terms), "term"))  # a bounded vocabulary
    out = None
    for i, (counts, weight) in enumerate(_counts(docs, id_col, text_col, chars)):
        t = counts.where("doc_id IS NOT NULL").withColumn("term", F.concat(F.lit(f"{i}:"), F.col("term"))).join(known, "term")
        t = t.select("doc_id", "i", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
        t = t.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("b"))  # in order, so that equal texts have equal vectors
        t = t.select("doc_id", F.col("b.i").alias("idx"), F.col("b.w").alias("val"))
        length = F.greatest(F.sqrt(F.aggregate("val", F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-12))
        t = t.withColumn("n", length).select("doc_id", "idx", F.transform("val", lambda x: (x / F.col("n") * weight).cast("float")).alias("val"))
        out = t if out is None else out.unionByName(t)
    if chars:
        out = out.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "val"))).alias("b")).select("doc_id", F.flatten("b.idx").alias("idx"), F.flatten("b.val").alias("val"))
    return out


def _terms(vocab: DataFrame, most_terms: int) -> list[str]:
    terms = sorted(r["term"] for r in vocab.select("term").limit(most_terms + 1).collect())  # a bounded vocabulary
    if len(terms) > most_terms:
        raise ValueError(f"more than {most_terms} terms: bound the vocabulary first")
    return terms


def _numbers(spark, terms: list[str]) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame({"term": terms, "i": np.arange(len(terms), dtype=np.int32)}), "term string, i int")


def _rows(weights: DataFrame, terms: list[str]) -> DataFrame:
    return weights.join(_numbers(weights.sparkSession, terms), "term").groupBy("doc_id").agg(F.collect_list("i").alias("idx"), F.collect_list("w").alias("val"))


BLOCKS = "slice int, block binary"


def _block(i: int, x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "block": [x.astype(np.float32).tobytes()]})


def _matrix(path: str, n: int, width: int) -> np.ndarray:
    """The matrix whose slices are in the shared folder. A task reads it anew: idle processes should hold none."""
    out = np.zeros((n, width), np.float32)
    for b in read_shared(path, 1):
        i, x = b.column(0)[0].as_py(), np.frombuffer(b.column(1)[0].as_buffer(), np.float32).reshape(-1, width)
        out[i * SLICE : i * SLICE + len(x)] = x
    return out


def _summed(blocks: DataFrame, width: int, make: Callable[[], Callable[[int, np.ndarray], np.ndarray]]) -> np.ndarray:
    """The sum of a function of (slice, rows), made once in each task, over all slices: a matrix for each task comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, of = None, None
        for b in batches:
            of = of or make()
            for i, block in zip(b.column(0).to_pylist(), b.column(1)):
                x = of(i, np.frombuffer(block.as_buffer(), np.float32).reshape(-1, width).astype(np.float64))
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_pydict({"sum": [total.tobytes()]})

    few = blocks.coalesce(tasks(blocks.sparkSession, 1))
    return sum(np.frombuffer(r["sum"]) for r in few.mapInArrow(run, "sum binary").toLocalIterator()).reshape(-1, width)


def _times(blocks: DataFrame, width: int, by: np.ndarray, tag: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, block in zip(b.column(0).to_pylist(), b.column(1)):
                yield _block(i, np.frombuffer(block.as_buffer(), np.float32).reshape(-1, width) @ by)

    out = materialize(blocks.mapInArrow(run, BLOCKS), tag)
    out._width = by.shape[1]
    return out


def _width(blocks: DataFrame) -> int:
    return blocks._width


def _orthonormal(blocks: DataFrame, width: int) -> DataFrame:
    """A base of the columns, orthonormal up to rounding, by the Cholesky factor of their products; directions that they hardly have are left out."""
    square = _summed(blocks, width, lambda: lambda i, x: x.T @ x)
    scale = 1 / np.sqrt(np.maximum(np.diag(square), 1e-300))
    square = square * scale[:, None] * scale
    try:
        by = np.linalg.inv(np.linalg.cholesky(square)).T
        if np.abs(by).max() > 1e5:
            raise np.linalg.LinAlgError
    except np.linalg.LinAlgError:
        values, vectors = np.linalg.eigh(square)
        some = values > 1e-12 * values.max()
        by = vectors[:, some] / np.sqrt(values[some])
    out = _times(blocks, width, scale[:, None] * by, "svd-base")
    discard(blocks)
    return out


def _pieces(b: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows lo..hi - 1 of a batch (idx, val) with at most NONZEROS entries, or one row: their flat entries and where each row begins."""
    at, idx, val = _entries(b)
    lo = 0
    while lo < len(b):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + NONZEROS, side="right")) - 1)
        yield lo, hi, idx[at[lo] : at[hi]], val[at[lo] : at[hi]], at[lo:hi] - at[lo]
        lo = hi


def _entries(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each row of a batch (idx, val) begins and ends, and its flat entries, which are larger for `copies` of a row."""
    lists, values = b.column(b.schema.get_field_index("idx")), b.column(b.schema.get_field_index("val"))
    at = lists.offsets.to_numpy().astype(np.int64)
    at -= at[0]
    idx, val = lists.flatten().to_numpy(), values.flatten().to_numpy(zero_copy_only=False)
    if "copies" in b.schema.names:
        val = val * np.repeat(np.sqrt(b.column(b.schema.get_field_index("copies")).to_numpy()), np.diff(at))
    return at, idx, val


def _gram(rows: DataFrame, q: DataFrame, n: int) -> DataFrame:
    """X'X q as sparse products of batches, summed in slices of SLICE terms; only slices that a task has terms of are sent."""
    path, width = q._quillstone_path, _width(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, total = None, {}
        for b in batches:
            m = _matrix(path, n, width) if m is None else m
            for lo, hi, idx, val, at in _pieces(b):
                val = val.astype(np.float32)[:, None]
                scores = np.add.reduceat(val * m[idx], at, axis=0)
                part = val * np.repeat(scores, np.diff(np.append(at, len(idx))), axis=0)
                order = np.argsort(idx, kind="stable")
                terms, first = np.unique(idx[order], return_index=True)
                sums = np.add.reduceat(part[order], first, axis=0)
                cuts = np.flatnonzero(np.diff(terms // SLICE)) + 1
                for t, x in zip(np.split(terms, cuts), np.split(sums, cuts)):
                    i = int(t[0]) // SLICE
                    if i not in total:
                        total[i] = np.zeros((min(SLICE, n - i * SLICE), width), np.float32)
                    total[i][t % SLICE] += x
        m = None
        for i in list(total):
            yield _block(i, total.pop(i))
        trim()

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b, np.float32).astype(np.float64) for b in pdf["block"])
        return pd.DataFrame({"slice": pdf["slice"][:1], "block": [total.astype(np.float32).tobytes()]})

    out = materialize(rows.select("idx", "val", *[c for c in rows.columns if c == "copies"]).mapInArrow(run, BLOCKS).groupBy("slice").applyInPandas(add, BLOCKS), "svd-product")
    release(rows.sparkSession)
    return out


def _summed_pays(n: int, entries: int, pairs: int, passes: int, width: int) -> bool:
    """Whether it takes less time to sum up the products of terms and to multiply those than to pass over the entries again and again."""
    units = -(-n // _height(n))
    return n * n <= 1 << 32 and 30 * pairs + 25 * units * entries + passes * n * n * width / 50 < passes * entries * width * 8


def _height(n: int) -> int:
    """The number of terms, in whole slices, whose products with all terms a task sums up at once."""
    return SLICE * max(1, CELLS // (max(1, n) * SLICE))


def _products(rows: DataFrame, n: int) -> DataFrame:
    """(slice, some, val): X'X in slices of SLICE terms, as bits of the cells that aren't zero and their values. Each task reads the
    table `rows`, of which it takes the entries of its terms; its sums are in double precision."""
    path, high = rows._quillstone_path, _height(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in (u for b in batches for u in b.column(0).to_pylist()):
            low = unit * high
            total = np.zeros(min(high, n - low) * n)
            for b in read_shared(path, 32768):
                at, idx, val = _entries(b)
                own = np.flatnonzero((idx >= low) & (idx < low + high))
                row = np.searchsorted(at, own, side="right") - 1
                size = at[row + 1] - at[row]
                ends = np.cumsum(size)
                lo = 0
                while lo < len(own):
                    before = ends[lo] - size[lo]
                    hi = max(lo + 1, int(np.searchsorted(ends, before + PAIRS, side="right")))
                    each, k = own[lo:hi], size[lo:hi]
                    other = np.arange(ends[hi - 1] - before) + np.repeat(at[row[lo:hi]] - (ends[lo:hi] - k - before), k)
                    cell = np.repeat((idx[each].astype(np.int64) - low) * n, k) + idx[other]
                    np.add.at(total, cell, np.repeat(val[each].astype(np.float64), k) * val[other])
                    lo = hi
            for i in range(0, len(total), SLICE * n):
                part = total[i : i + SLICE * n].astype(np.float32)
                some = part != 0
                yield pa.RecordBatch.from_pydict({"slice": pa.array([(low + i // n) // SLICE], pa.int32()), "some": [np.packbits(some).tobytes()], "val": [part[some].tobytes()]})
            total = None
        trim()

    units = -(-n // high)
    return materialize(rows.sparkSession.range(0, units, 1, units).mapInArrow(run, "slice int, some binary, val binary"), "svd-products")


def _product(spark, products: DataFrame, q: DataFrame, n: int) -> DataFrame:
    """X'X q from the sums of `_products`; each task reads its files itself, as rows are large."""
    path, base, width = products._quillstone_path, q._quillstone_path, _width(q)
    files = shared_files(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = None
        for f in (files[i] for b in batches for i in b.column(0).to_pylist()):
            m = _matrix(base, n, width) if m is None else m
            for b in read_shared(path, 1, [f]):
                size = min(SLICE, n - b.column(0)[0].as_py() * SLICE) * n
                x = np.zeros(size, np.float32)
                x[np.unpackbits(np.frombuffer(b.column(1)[0].as_buffer(), np.uint8), count=size).view(bool)] = np.frombuffer(b.column(2)[0].as_buffer(), np.float32)
                yield _block(b.column(0)[0].as_py(), x.reshape(-1, n) @ m)
        m = None
        trim()

    few = min(len(files), tasks(spark, 1))
    return materialize(spark.range(0, len(files), 1, few).mapInArrow(run, BLOCKS), "svd-product")
