"""Texts as sets of words, and classes of texts with the same set.

Words are maximal runs of letters and digits of the lower-cased text. Similarity of two texts is
the number of words they share over the number of words in either; null texts and texts without
words are left out.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.session import materialize

WORD = r"[\p{L}\p{N}]+"


def word_hashes(text: Column) -> Column:
    """The distinct words of a text as ascending 64-bit hashes."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))))


def word_sets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h1, h2, words) of each row with an id and words; h1 and h2 together name the word set."""
    t = df.select(F.col(id_col).alias("id"), word_hashes(F.col(text_col)).alias("words")).where("id IS NOT NULL AND size(words) > 0")
    return t.select("id", F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(17), F.reverse("words")).alias("h2"), "words")


def set_members(sets: DataFrame, classes: DataFrame, tag: str) -> DataFrame:
    """(id, cid), one row for each different id and class; an id with several texts is in several classes."""
    ids = sets.select("id", "h1", "h2").distinct()  # words stay out of this shuffle
    return materialize(ids.join(classes.select("h1", "h2", "cid"), ["h1", "h2"]).select("id", "cid"), tag)


def set_classes(sets: DataFrame, tag: str) -> DataFrame:
    """(cid, h1, h2, words): each different word set once, with a number that is unique."""
    c = sets.groupBy("h1", "h2").agg(F.first("words").alias("words"))
    return materialize(c.select(F.monotonically_increasing_id().alias("cid"), "h1", "h2", "words"), tag)


def frequent_words(classes: DataFrame, share: float = 0.001, least: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Words of more than `share` of all sets, ascending, and their ranks, the most frequent last.

    There are at most (mean set size / share) of them, whatever the number of sets.
    """
    n = classes.count()
    df = classes.select(F.explode("words").alias("w")).groupBy("w").count().where(F.col("count") > max(least, share * n))
    rows = df.toPandas().sort_values(["count", "w"])
    words = rows["w"].to_numpy(np.int64)
    order = np.argsort(words)
    return words[order], (np.arange(len(words)) + 1)[order]


def ceil_share(t: Fraction, n: np.ndarray) -> np.ndarray:
    """ceil(t * n), exactly."""
    return -(-(n.astype(np.int64) * t.numerator) // t.denominator)


def flatten(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All elements, and where each list starts (one more entry than lists)."""
    sizes = np.fromiter((len(x) for x in lists), np.int64, len(lists))
    return (np.concatenate(lists) if len(lists) else np.zeros(0, np.int64)), np.concatenate([[0], np.cumsum(sizes)])


def rare_first(flat: np.ndarray, starts: np.ndarray, frequent: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The elements of each list ordered by (rank, hash); words that aren't frequent have rank 0."""
    rank = np.zeros(len(flat), np.int64)
    if len(frequent) and len(flat):
        at = np.minimum(np.searchsorted(frequent, flat), len(frequent) - 1)
        rank = np.where(frequent[at] == flat, ranks[at], 0)
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    return flat[np.lexsort((flat, rank, row))]


def overlaps(flat: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray, flat_b: np.ndarray | None = None, starts_b: np.ndarray | None = None) -> np.ndarray:
    """How many elements lists a[i] and b[i] share; the elements of a list differ."""
    flat_b, starts_b = (flat, starts) if flat_b is None else (flat_b, starts_b)
    out = np.zeros(len(a), np.int64)
    na, nb = np.diff(starts)[a], np.diff(starts_b)[b]
    for lo in range(0, len(a), 65536):
        i = slice(lo, lo + 65536)
        ca, cb = na[i], nb[i]
        p = np.arange(len(ca))
        ia = np.repeat(starts[a[i]], ca) + np.arange(ca.sum()) - np.repeat(np.cumsum(ca) - ca, ca)
        ib = np.repeat(starts_b[b[i]], cb) + np.arange(cb.sum()) - np.repeat(np.cumsum(cb) - cb, cb)
        pair = np.concatenate([np.repeat(p, ca), np.repeat(p, cb)])
        word = np.concatenate([flat[ia], flat_b[ib]])
        o = np.lexsort((word, pair))
        pair, word = pair[o], word[o]
        same = (pair[1:] == pair[:-1]) & (word[1:] == word[:-1])
        out[i] = np.bincount(pair[1:][same], minlength=len(ca))
    return out
