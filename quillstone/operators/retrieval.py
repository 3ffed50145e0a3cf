"""Exact inner-product retrieval and what surrounds it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import vec
from quillstone.session import materialize, read_shared, shared_files, tasks, trim

BLOCK = 4096  # queries scored together
PIECE = 2048  # units scored together
GROUP = 32  # blocks whose results a task holds


def topk(queries: DataFrame, corpus: DataFrame, k: int, strategy: str = "blocks", carry: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, rank, unit_id, score, *carry): the k units of largest inner product for each query.

    queries: (query_id, emb); corpus: (unit_id, emb, *carry). Ranks start at 1, ties go to the smaller
    unit_id, a short corpus gives short lists. Null vectors are left out. Strategy "sql" is a plain
    join with a window that keeps k rows of each group before its shuffle; "blocks" streams the corpus past
    bounded blocks of queries and multiplies matrices, so that no task and no broadcast grows with either.
    """
    q, c = queries.where("emb IS NOT NULL"), corpus.where("emb IS NOT NULL")
    if strategy == "sql":
        scored = q.select("query_id", F.col("emb").alias("q")).repartition("query_id").crossJoin(c.select("unit_id", F.col("emb").alias("c")))
        scored = scored.select("query_id", "unit_id", vec.dot(F.col("q"), F.col("c")).alias("score"))
    elif strategy == "blocks":
        scored = _blocks(q, c, k)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "unit_id")
    best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if carry:
        best = best.join(c.select("unit_id", *carry), "unit_id")
    return best.select("query_id", "rank", "unit_id", "score", *carry)


def _blocks(q: DataFrame, c: DataFrame, k: int) -> DataFrame:
    """(query_id, unit_id, score), with the k best of each query: queries are written in blocks, which the corpus streams past.

    The corpus is neither copied nor shuffled; each task passes on its k best for each query. Tasks hold the results
    of at most GROUP blocks of queries: beyond that the corpus streams again.
    """
    spark, blocks = q.sparkSession, max(1, math.ceil(q.count() / BLOCK))
    qt, ut = q.schema["query_id"].dataType.simpleString(), c.schema["unit_id"].dataType.simpleString()
    folder = materialize(q.select("query_id", "emb").repartition(blocks), "asking")._quillstone_path
    files = shared_files(folder)
    corpus = c.select("unit_id", "emb").coalesce(tasks(spark, 1))

    def of(some: list[str]) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[str, int], tuple[pa.Array, pd.DataFrame, np.ndarray]] = {}
            for b in batches:
                for f in some if b.num_rows else []:
                    for n, a in enumerate(read_shared(folder, 1 << 20, [f])):  # one, unless vectors are very long
                        for i in range(0, b.num_rows, PIECE):
                            part = b.slice(i, PIECE)
                            held[f, n] = _better(held.get((f, n)), a, _vectors(part.column("emb")), part.column("unit_id"), k)
                trim()
            for asked, best, _ in held.values():
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(best["q"], pa.int64())), pa.array(best["u"], b.column("unit_id").type), pa.array(best["s"])], names=["query_id", "unit_id", "score"])

        return corpus.mapInArrow(search, f"query_id {qt}, unit_id {ut}, score double")

    out = of(files[:GROUP])
    for i in range(GROUP, len(files), GROUP):
        out = out.unionByName(of(files[i : i + GROUP]))
    return out


def _vectors(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _better(held, a: pa.RecordBatch, y: np.ndarray, units: pa.Array, k: int) -> tuple[pa.Array, pd.DataFrame, np.ndarray]:
    """The k best so far of a block of queries, and of each the score that must be reached: products in single precision, and
    again in double what their rounding leaves open."""
    x = _vectors(a.column("emb"))
    asked, best, low = held or (a.column("query_id"), None, np.full(len(x), -np.inf))
    x4, y4 = x.astype(np.float32, copy=False), y.astype(np.float32, copy=False).T
    slack = (x.shape[1] + 4) * 1.2e-7 * np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1).max()
    rows, cols, scores = [], [], []
    for s in range(0, len(x), 512):
        m, least = x4[s : s + 512] @ y4, low[s : s + 512] - slack[s : s + 512]
        if np.isneginf(least).any() and m.shape[1] > k:
            least = np.maximum(least, -np.partition(-m, k - 1, axis=1)[:, k - 1] - 2 * slack[s : s + 512])
        r, col = np.nonzero(m >= least[:, None])
        for i in range(0, len(r), 2048):
            rows.append(r[i : i + 2048] + s)
            cols.append(col[i : i + 2048])
            scores.append(np.einsum("ij,ij->i", x[rows[-1]].astype(np.float64), y[cols[-1]].astype(np.float64)))
    if rows:
        r, col, score = (np.concatenate(z) for z in (rows, cols, scores))
        found = pd.DataFrame({"q": r, "s": score, "u": units.take(pa.array(col)).to_pandas()})[score >= low[r]]
        best = (found if best is None else pd.concat([best, found])).sort_values(["q", "s", "u"], ascending=[True, False, True], ignore_index=True)
        nth = best.groupby("q").cumcount()
        best, low = best[nth < k], low.copy()
        low[best["q"][nth == k - 1]] = best["s"][nth == k - 1]
    return asked, best if best is not None else pd.DataFrame({"q": rows, "s": rows, "u": rows}), low


def align(corpus: DataFrame, *spaces: DataFrame) -> DataFrame:
    """Rows of `corpus` (unit_id, ...) whose unit every space (unit_id, emb) has, with emb_0, emb_1, ..."""
    out = corpus
    for i, s in enumerate(spaces):
        out = out.join(s.select("unit_id", F.col("emb").alias(f"emb_{i}")), "unit_id")
    return out


def missing_ids(wanted: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Ids of `wanted` that `held` lacks; an aligned load is complete if there are none."""
    return wanted.select(key).join(held.select(key), key, "left_anti")


def known_labels(queries: DataFrame, corpus: DataFrame, gold: str = "gold", label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Queries whose gold label the corpus has, and the others (null labels are unknown)."""
    labels = corpus.select(F.col(label).alias(gold)).distinct()
    return queries.join(labels, gold, "left_semi"), queries.join(labels, gold, "left_anti")


def shorten(text: Column, most: int = 400) -> Column:
    """The first characters and an ellipsis, if the text is longer than one more."""
    return F.when(F.length(text) > most + 1, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def excerpt(text: Column, most: int) -> Column:
    """One line of at most `most` characters, the last three of a cut one being dots."""
    line = F.trim(F.replace(text, F.lit("\n"), F.lit(" ")))
    return F.when(F.length(line) > most, F.concat(F.rtrim(F.substring(line, 1, most - 3)), F.lit("..."))).otherwise(line)


def prompts(ranked: DataFrame, queries: DataFrame, units: DataFrame, most_chars: int = 5000, language: str = "Deutsch") -> DataFrame:
    """(query_id, query_text, prompt, unit_ids, scores): ranked excerpts below the question.

    Units without metadata or text are dropped, the order of the ranks is kept.
    """
    t = ranked.join(units.where("text IS NOT NULL").select("unit_id", "label", "text"), "unit_id")
    t = t.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "unit_id", "score", "label", "text"))).alias("hits"))
    lines = F.transform("hits", lambda h, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] ("), F.coalesce(h["label"].cast("string"), F.lit("?")), F.lit(") "), excerpt(h["text"], most_chars)))
    head = F.concat(F.lit(f"Antworte auf {language} und nur aus den Fundstellen.\nFrage: "), F.col("query_text"), F.lit("\n"))
    return t.join(queries.select("query_id", "query_text"), "query_id").select(
        "query_id",
        "query_text",
        F.concat(head, F.array_join(lines, "\n")).alias("prompt"),
        F.transform("hits", lambda h: h["unit_id"]).alias("unit_ids"),
        F.transform("hits", lambda h: h["score"]).alias("scores"),
    )


def nearest_other(points: DataFrame, k: int = 5) -> DataFrame:
    """(id, other): the nearest other point by Euclidean distance, ties to the smaller id.

    points: (id, x). Distances rank like inner products of (x, 1) with (x, -|x|^2 / 2), for which
    `topk` is exact; a point without any other is its own neighbour.
    """
    p = materialize(points.where("x IS NOT NULL"), "points")
    q = p.select(F.col("id").alias("query_id"), F.concat(F.transform("x", lambda v: v.cast("double")), F.array(F.lit(1.0))).alias("emb"))
    c = p.select(F.col("id").alias("unit_id"), F.concat(F.transform("x", lambda v: v.cast("double")), F.array(-vec.dot(F.col("x"), F.col("x")) / 2)).alias("emb"))
    near = topk(q, c, max(2, k)).where("unit_id <> query_id")
    w = Window.partitionBy("query_id").orderBy("rank")
    near = near.withColumn("r", F.row_number().over(w)).where("r = 1").select(F.col("query_id").alias("id"), F.col("unit_id").alias("other"))
    return p.select("id").join(near, "id", "left").select("id", F.coalesce("other", "id").alias("other"))
