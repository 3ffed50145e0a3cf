"""Near-duplicate texts by bit-sliced comparison of word-set sketches.

Texts with the same word set form a class; classes are compared, never copies. A sketch has
one bit for each hash slot, the parity of the set's words in it, so that the Hamming distance of
two sketches is at most the number of words that only one of the sets has. For a similarity of t
that number is at most (1 - t) / (1 + t) times the sum of the set sizes: sketches farther apart
need no further look.

Sets that may be similar meet in a block: with words ordered rare first, they share one of their
first n - ceil(t n) + 1 words, or, where that word is in very many sets, two of their first
n - ceil(t n) + 2, or are both so small that one word is enough. A block that is still too large is cut
into tiles. Sketches, not words, travel to the blocks, so that a long text sends little. In a block, they are
stored vertically, a bit plane for each slot with one lane for each set; the distances of a set
to 64 others advance together through carry-save counters, and a lane word is abandoned once all
its distances exceed the radius. Surviving pairs are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import words as W
from quillstone.session import materialize, tasks

SLOTS = 256
HOT = 4096  # sets in a block before it is keyed by two words, or cut into tiles
STEP = 16  # planes between looks at the radius
CHUNK = 1 << 15  # rows of blocks worked on together
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketches(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Parity sketches, (rows, SLOTS) of 0 and 1."""
    n = len(starts) - 1
    row = np.repeat(np.arange(n), np.diff(starts))
    slot = ((flat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.int64) % SLOTS
    return (np.bincount(row * SLOTS + slot, minlength=n * SLOTS).reshape(n, SLOTS) & 1).astype(np.uint8)


def close_pairs(bits: np.ndarray, sizes: np.ndarray, first: np.ndarray, last: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, whose sketches are within the radius for similarity t.

    Row i is compared with rows first[i] to last[i] - 1 of its block; rows of a block are ordered by size.
    """
    n = len(bits)
    lanes = (n + 63) // 64
    padded = np.zeros((SLOTS, lanes * 64), np.uint8)
    padded[:, :n] = bits.T
    planes = np.packbits(padded, axis=1, bitorder="little").view(np.uint64).reshape(SLOTS, lanes)
    # one task for each row and each lane word that its range touches
    w0, w1 = first // 64, (last + 63) // 64
    count = np.where(last > first, w1 - w0, 0)
    row = np.repeat(np.arange(n), count)
    lane = np.repeat(w0, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    big = np.zeros(lanes * 64, np.int64)
    big[:n] = sizes
    big = big.reshape(lanes, 64).max(1)
    out_i, out_j = [], []
    for at in range(0, len(row), 1 << 16):
        r, ln = row[at : at + (1 << 16)], lane[at : at + (1 << 16)]
        most = np.minimum(big[ln], sizes[r] * t.denominator // t.numerator)  # the largest partner that counts
        radius = (sizes[r] + most) * (t.denominator - t.numerator) // (t.denominator + t.numerator)
        lo, hi = np.clip(first[r] - ln * 64, 0, 64), np.clip(last[r] - ln * 64, 0, 64)
        live = _low_mask(hi) & ~_low_mask(lo)
        i, j = _compare(planes, bits, r, ln, radius, live)
        ok = sizes[j] * t.numerator <= sizes[i] * t.denominator
        out_i.append(i[ok])
        out_j.append(j[ok])
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _low_mask(n: np.ndarray) -> np.ndarray:
    n = n.astype(np.uint64)
    return np.where(n >= 64, FULL, (np.uint64(1) << np.minimum(n, np.uint64(63))) - np.uint64(1))


def _compare(planes: np.ndarray, bits: np.ndarray, r: np.ndarray, ln: np.ndarray, radius: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    deep = min(int(radius.max(initial=0)), SLOTS).bit_length() + 1
    counter = np.zeros((deep, len(r)), np.uint64)
    over = np.zeros(len(r), np.uint64)
    for p0 in range(0, SLOTS, STEP):
        for p in range(p0, p0 + STEP, 4):  # four planes become ones, twos and fours before they are counted
            a, b, c, d = (planes[q][ln] ^ (np.uint64(0) - bits[r, q].astype(np.uint64)) for q in range(p, p + 4))
            x = a ^ b
            ones, twos = x ^ c, (a & b) | (x & c)
            ones, c1 = ones ^ d, ones & d
            twos, fours = twos ^ c1, twos & c1
            k = counter[0] & ones
            counter[0] ^= ones
            for level, add in ((1, twos), (2, fours)):
                if level < deep:
                    y = counter[level] ^ add
                    k, counter[level] = (counter[level] & add) | (y & k), y ^ k
                else:
                    k = k | add if level == deep else k
            for level in range(3, deep):
                k, counter[level] = counter[level] & k, counter[level] ^ k
            over |= k if deep > 2 else k | fours
        live &= ~(over | _exceeds(counter, radius))
        keep = np.flatnonzero(live)
        if len(keep) < len(live):
            r, ln, radius, live, over, counter = r[keep], ln[keep], radius[keep], live[keep], over[keep], np.ascontiguousarray(counter[:, keep])
        if not len(r):
            break
    at, lane = np.nonzero(np.unpackbits(live.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return r[at], ln[at] * 64 + lane


def _exceeds(counter: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Lanes whose bit-sliced count is greater than the task's radius."""
    more, same = np.zeros(counter.shape[1], np.uint64), np.full(counter.shape[1], FULL)
    for level in range(len(counter) - 1, -1, -1):
        bit = np.uint64(0) - ((radius >> level) & 1).astype(np.uint64)
        more |= same & counter[level] & ~bit
        same &= ~(counter[level] ^ bit)
    return more


def similar_sets(classes: DataFrame, threshold: str = "0.7") -> DataFrame:
    """(a, b, similarity), a < b: all pairs of classes (cid, words) with at least that similarity."""
    t = Fraction(threshold)
    if not 0 < t <= 1:
        raise ValueError("the threshold must lie in (0, 1]")
    spark = classes.sparkSession
    known = spark.sparkContext.broadcast(W.frequent_words(classes))  # bounded, see frequent_words

    def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The words that may name a block of each set, rare first, and its sketch; the other words stay behind."""
        for b in batches:
            flat, starts = W.flatten(b["words"].to_list())
            n = np.diff(starts)
            keys = np.minimum(n, n - W.ceil_share(t, n) + 2)
            sketch = np.packbits(sketches(flat, starts), axis=1)
            flat = W.rare_first(flat, starts, *known.value)
            yield pd.DataFrame({"cid": b["cid"], "n": n.astype(np.int32), "sketch": [r.tobytes() for r in sketch], "keys": [flat[a : a + k] for a, k in zip(starts[:-1], keys)]})

    ordered = materialize(classes.select("cid", "words").mapInPandas(order, "cid long, n int, sketch binary, keys array<long>"), "ordered-sets")
    least = F.expr(f"CAST((n * {t.numerator}L + {t.denominator - 1}) DIV {t.denominator} AS INT)")  # ceil(t n)
    sets = ordered.withColumn("least", least)
    posts = sets.drop("sketch")
    posts = posts.select("*", F.explode(F.slice("keys", F.lit(1), F.col("n") - F.col("least") + 1)).alias("key"))
    sizes = materialize(posts.groupBy("key").count().where("count > 1"), "block-sizes")  # a word of one set only makes no pair
    hot = materialize(sizes.where(F.col("count") > HOT), "hot-blocks")
    thin = sets.select("cid", "n", "sketch", "least", F.explode(F.slice("keys", F.lit(1), F.col("n") - F.col("least") + 1)).alias("key"))
    plain = thin.join(sizes.where(F.col("count") <= HOT), "key").select("key", "cid", "n", "sketch", F.lit(1).alias("tiles"))
    rows = plain
    if not hot.isEmpty():
        # Sets of a hot word meet again in blocks of two words. Of a similar pair that shares one word only,
        # both sets have ceil(t n) = 1: these few small sets meet under the hot word too, in tiles.
        small = thin.where("least = 1").join(hot.select("key"), "key")
        small = small.join(small.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "key")
        small = small.select(F.xxhash64("key", F.lit(1)).alias("key"), "cid", "n", "sketch", F.ceil(F.col("m") / HOT).cast("int").alias("tiles"))
        twice = posts.where("n > 1").join(hot.select("key"), "key")
        other = F.explode(F.array_except(F.slice("keys", F.lit(1), F.col("n") - F.col("least") + 2), F.array("key")))
        twice = twice.withColumn("other", other).select(F.xxhash64(F.least("key", "other"), F.greatest("key", "other"), F.lit(2)).alias("key"), "cid").distinct()
        both = twice.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        twice = twice.join(both, "key").join(ordered.select("cid", "n", "sketch"), "cid").select("key", "cid", "n", "sketch", F.ceil(F.col("m") / HOT).cast("int").alias("tiles"))
        rows = plain.unionByName(twice).unionByName(small)
    own = F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int")
    rows = rows.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("key", F.least("own", "with").alias("ti"), F.greatest("own", "with").alias("tj"), "own", "cid", "n", "sketch")
    n_rows = sizes.agg(F.sum("count")).first()[0] or 0
    rows = rows.repartition(max(tasks(spark), n_rows // (4 * CHUNK)), "key", "ti", "tj").sortWithinPartitions("key", "ti", "tj", "n", "cid")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for b in batches:
            held.append(b)
            size += len(b)
            if size < CHUNK:
                continue
            all_rows = pd.concat(held, ignore_index=True)
            k = all_rows[["key", "ti", "tj"]].to_numpy()
            cut = np.flatnonzero((k[1:] != k[:-1]).any(1))
            if not len(cut):
                held = [all_rows]
                continue
            cut = int(cut[-1]) + 1  # the last block may go on
            held, size = [all_rows.iloc[cut:]], len(all_rows) - cut
            yield _blocks(all_rows.iloc[:cut], t)
        if held:
            yield _blocks(pd.concat(held, ignore_index=True), t)

    near = rows.mapInPandas(compare, "a long, b long").distinct()
    # what the sketches leave open is compared exactly
    words = classes.select("cid", "words")
    near = near.join(words.select(F.col("cid").alias("a"), F.col("words").alias("wa")), "a").join(words.select(F.col("cid").alias("b"), F.col("words").alias("wb")), "b")
    both = F.size(F.array_intersect("wa", "wb"))
    near = near.select("a", "b", both.alias("both"), (F.size("wa") + F.size("wb") - both).alias("either"))
    found = near.where(F.col("both") * t.denominator >= F.col("either") * t.numerator).select("a", "b", (F.col("both") / F.col("either")).alias("similarity"))
    return materialize(found, "similar-sets")


def _blocks(pdf: pd.DataFrame, t: Fraction) -> pd.DataFrame:
    sizes, cid, own = pdf["n"].to_numpy(np.int64), pdf["cid"].to_numpy(np.int64), pdf["own"].to_numpy()
    k = pdf[["key", "ti", "tj"]].to_numpy()
    n = len(pdf)
    start = np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1]) if n else np.zeros(0, np.int64)
    block = np.zeros(n, np.int64)
    block[start[1:]] = 1
    block = np.cumsum(block)
    end = np.append(start[1:], n)[block] if n else block
    # within a block, sizes ascend: the last partner that can be similar
    most = sizes * t.denominator // t.numerator
    wide = int(sizes.max(initial=0)) + 2
    last = np.minimum(np.searchsorted(block * wide + sizes, block * wide + np.minimum(most, wide - 1), side="right"), end)
    bits = np.unpackbits(np.frombuffer(b"".join(pdf["sketch"].to_list()), np.uint8).reshape(n, -1), axis=1) if n else np.zeros((0, SLOTS), np.uint8)
    i, j = close_pairs(bits, sizes, np.arange(n) + 1, last, t)
    cross = (k[i, 1] == k[i, 2]) | (own[i] != own[j])
    i, j = cid[i[cross]], cid[j[cross]]
    return pd.DataFrame({"a": np.minimum(i, j), "b": np.maximum(i, j)}).drop_duplicates()


def near_duplicates(df: DataFrame, id_col: str, text_col: str, threshold: str = "0.7") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (id, cid), classes (cid, h1, h2, words) and similar pairs of classes (a, b, similarity).

    Rows with a null id, a null text or a text without words are left out; an id may have several
    texts and then belongs to several classes; repeated rows count once; extra columns are ignored.
    """
    sets = materialize(W.word_sets(df, id_col, text_col), "word-sets")
    classes = W.set_classes(sets, "set-classes")
    pairs = similar_sets(classes, threshold)
    return W.set_members(sets, classes, "set-members"), classes, pairs


def duplicate_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of different ids with similar texts."""
    a, b = members.select(F.col("id").alias("a"), F.col("cid").alias("ca")), members.select(F.col("id").alias("b"), F.col("cid").alias("cb"))
    links = pairs.select(F.col("a").alias("ca"), F.col("b").alias("cb"))
    twins = members.groupBy("cid").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(F.col("cid").alias("ca"), F.col("cid").alias("cb"))
    x = links.unionByName(twins).join(a, "ca").join(b, "cb")
    return x.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def duplicate_groups(members: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row for each (id, class): class_id (its smallest id), copies, and links to other classes."""
    names = members.groupBy("cid").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    ends = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid")))
    links = ends.groupBy("cid").agg(F.count(F.lit(1)).alias("links"))
    t = members.join(names, "cid").join(links, "cid", "left")
    return t.select("id", "class_id", "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
