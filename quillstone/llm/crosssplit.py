"""Records of evaluation splits that occur, exactly or almost, in the training split.

The evaluation texts are indexed in shards of bounded size (`fmindex`), written to the shared
folder. The training texts stream past: each task reads a shard after the other and searches it
backward for the maximal matches of its texts. Two indexes serve two questions.

Over word sets in rare-first order, the spans of maximal matches are merged to counts of shared
words of each (training, evaluation) pair. Sets of similarity t share two of their first
n - ceil(t n) + 2 words, and one of the runs that their differences leave has a guaranteed length:
the matches that end in these words, or those of that length, whichever occur less often, lead to
every similar pair. What they lead to is compared exactly. Similar sets also have their three
rarest shared words in both beginnings: each shard has a filter of the triples of its sets, and only
texts with such a triple are searched for.

Over texts in their own word order, maximal matches of at least five words are located and
their spans merged, which tells how much of each evaluation text training has seen.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm import words as W
from quillstone.llm.fmindex import FMIndex, spread
from quillstone.llm.neardup import sketches
from quillstone.session import materialize, tasks, trim

SHARD_SETS = 32768
STREAM_ROWS = 32768
TRIPLES = (256, 1024)  # of a training and of an evaluation set, at most, for the filter
BATCH_VISITS = 1 << 22


def _shards(texts: DataFrame, build: Callable[[pd.DataFrame], bytes]) -> str:
    """Index the texts (cid, words) in shards; the folder of the index files."""
    shards = max(1, math.ceil(texts.count() / SHARD_SETS))

    def blob(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"blob": [build(pdf)]})
        trim()
        return out

    built = texts.withColumn("shard", F.pmod(F.xxhash64("cid"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(blob, "blob binary")
    return materialize(built, "fm-index")._quillstone_path


def _read_shards(folder: str) -> Iterator[bytes]:
    """The indexes in a folder that all executors share, one at a time."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    for f in sorted(system.get_file_info(fs.FileSelector(path)), key=lambda f: f.path):
        if f.path.endswith(".parquet"):
            with system.open_input_file(f.path) as source:
                for batch in pq.ParquetFile(source).iter_batches(batch_size=1):
                    yield batch.column(0)[0].as_py()


def _stream(training: DataFrame, folder: str, search: Callable[..., pd.DataFrame], schema: str, prepare: Callable[[pd.DataFrame], object] | None = None) -> DataFrame:
    """Stream (cid, words) past all shards: no text is copied, each task reads the shards once for STREAM_ROWS texts.

    `prepare` is called once for these texts; `search` gets what it returns as a third argument."""
    m = training.count()
    parts = max(1, math.ceil(m / STREAM_ROWS), min(tasks(training.sparkSession), m // 2048))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def every() -> Iterator[pd.DataFrame]:
            if held:
                train = pd.concat(held, ignore_index=True)
                more = (prepare(train),) if prepare else ()
                for blob in _read_shards(folder):
                    yield search(blob, train, *more)

        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= STREAM_ROWS:
                yield from every()
                held = []
                trim()
        yield from every()
        held.clear()
        trim()

    return training.select("cid", "words").repartition(parts).mapInPandas(run, schema)


def guaranteed_run(n: int, t: Fraction) -> int:
    """The least length of the longest common run of a set of n words, in any fixed order, with a set of similarity t."""
    b = np.arange(-(-n * t.numerator // t.denominator), n * t.denominator // t.numerator + 1, dtype=np.int64)  # sizes of the other set
    both = -(-(n + b) * t.numerator // (t.denominator + t.numerator))
    runs = -(-both // (n + b - 2 * both + 1))
    return max(1, int(runs[both <= np.minimum(n, b)].min(initial=n)))


class KeyFilter:
    """A Bloom filter of keys: what was put in is always found."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.mask = bits, np.uint64(8 * len(bits) - 1)

    @classmethod
    def sized(cls, keys: int) -> KeyFilter:
        return cls(np.zeros(1 << min(25, max(6, (4 * keys).bit_length())), np.uint8))

    def _at(self, keys: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
        at = (keys + np.uint64(i) * (keys >> np.uint64(33) | np.uint64(1))) & self.mask
        return (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)

    def put(self, keys: np.ndarray) -> None:
        for i in range(4):
            np.bitwise_or.at(self.bits, *self._at(keys, i))

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Which of the keys may have been put in."""
        step = 1 << 18
        return np.concatenate([i + self._has(keys[i : i + step]) for i in range(0, max(1, len(keys)), step)])

    def _has(self, keys: np.ndarray) -> np.ndarray:
        at = (keys & self.mask).view(np.int64)
        left = np.flatnonzero(self.bits[at >> 3] >> (at & 7).astype(np.uint8) & np.uint8(1))
        for i in range(1, 4):
            byte, bit = self._at(keys[left], i)
            left = left[self.bits[byte] & bit != 0]
        return left


def _subsets(length: int, of: int) -> int:
    return math.comb(max(length, 0), of)


def filter_sizes(t: Fraction) -> tuple[int, int]:
    """The largest training set that is looked up in the filter, and the largest evaluation set that is in it: all that can be similar to one that is looked up."""
    begin = lambda n: n - math.ceil(t * n) + 3
    most = [max((n for n in range(1, 4096) if _subsets(begin(n), 3) <= limit), default=0) for limit in TRIPLES]
    looked_up = min(most[0], math.floor(t * most[1]))
    return looked_up, math.floor(looked_up / t)


def subset_keys(ordered: np.ndarray, starts: np.ndarray, rows: np.ndarray, t: Fraction, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys (rows, keys of a row) of all `size` words among the first n - ceil(t n) + size of each of these rows."""
    n = np.diff(starts)[rows]
    begin = np.minimum(n, n - W.ceil_share(t, n) + size)
    for length in np.unique(begin[begin >= size]):
        some, which = rows[begin == length], np.array(list(itertools.combinations(range(int(length)), size)))
        step = max(1, (1 << 18) // len(which))
        for i in range(0, len(some), step):
            r = some[i : i + step]
            w = ordered[starts[r][:, None] + np.arange(length)].astype(np.uint64)
            key = np.full((len(r), len(which)), np.uint64(size))
            for j in range(size):
                key = (key ^ w[:, which[:, j]]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            yield r, key


def triple_filter(ordered: np.ndarray, starts: np.ndarray, t: Fraction) -> KeyFilter:
    """The filter of evaluation sets in rare-first order; those that may be similar to a set with fewer than three words to share have single words and pairs, too."""
    n = np.diff(starts)
    sets = [(np.flatnonzero(n <= filter_sizes(t)[1] if size == 3 else n * t.numerator**2 <= 2 * t.denominator**2), size) for size in (1, 2, 3)]
    lengths = [(np.minimum(n[rows], n[rows] - W.ceil_share(t, n[rows]) + size), size) for rows, size in sets]
    out = KeyFilter.sized(sum(int(c) * _subsets(int(x), size) for begin, size in lengths for x, c in zip(*np.unique(begin, return_counts=True))))
    for rows, size in sets:
        for _, keys in subset_keys(ordered, starts, rows, t, size):
            out.put(keys.ravel())
    return out


def lookup_keys(ordered: np.ndarray, starts: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of training sets and the row of each; rows too large to be looked up."""
    n = np.diff(starts)
    size = np.minimum(3, W.ceil_share(t, n))  # a similar set shares so many words at least
    small = n <= filter_sizes(t)[0]
    keys, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    for s in (1, 2, 3):
        for r, k in subset_keys(ordered, starts, np.flatnonzero(small & (size == s)), t, s):
            keys.append(k.ravel())
            of.append(np.repeat(r.astype(np.int32), k.shape[1]))
    return np.concatenate(keys), np.concatenate(of), np.flatnonzero(~small)


def similar_across(evaluation: DataFrame, training: DataFrame, threshold: str = "0.7") -> DataFrame:
    """(e, t, similarity): all pairs of an evaluation and a training class (cid, words) with at least that similarity."""
    t = Fraction(threshold)
    known = evaluation.sparkSession.sparkContext.broadcast(W.frequent_words(evaluation))  # bounded, see frequent_words

    def build(pdf: pd.DataFrame) -> bytes:
        flat, starts = W.flatten(pdf["words"].to_list())
        ordered = W.rare_first(flat, starts, *known.value)
        bits = triple_filter(ordered, starts, t).bits.tobytes()
        return np.int64(len(bits)).tobytes() + bits + _pack(pdf["cid"], FMIndex.build(ordered, starts))

    def prepare(train: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat, starts = W.flatten(train["words"].to_list())
        return lookup_keys(W.rare_first(flat, starts, *known.value), starts, t)

    def search(blob: bytes, train: pd.DataFrame, looked_up: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pd.DataFrame:
        keys, of, large = looked_up
        size = int(np.frombuffer(blob[:8], np.int64)[0])
        hit = KeyFilter(np.frombuffer(blob, np.uint8, size, 8)).has(keys)
        rows = np.union1d(of[hit], large)
        if not len(rows):
            return pd.DataFrame({"e": np.zeros(0, np.int64), "t": np.zeros(0, np.int64), "similarity": np.zeros(0)})
        return _search_sets(*_unpack(blob[8 + size :]), train.iloc[rows], known.value, t)

    folder = _shards(evaluation.select("cid", "words"), build)
    return materialize(_stream(training, folder, search, "e long, t long, similarity double", prepare), "cross-pairs")


def _pack(cid: pd.Series, fm: FMIndex) -> bytes:
    ids = cid.to_numpy(np.int64).tobytes()
    return np.int64(len(ids)).tobytes() + ids + fm.dumps()


def _unpack(blob: bytes) -> tuple[np.ndarray, FMIndex]:
    n = int(np.frombuffer(blob[:8], np.int64)[0])
    return np.frombuffer(blob[8 : 8 + n], np.int64), FMIndex.loads(blob[8 + n :])


def _covered(pair: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs, and how many positions the union of their spans begin..end - 1 has."""
    wide = int(end.max(initial=0)) + 1
    order = np.argsort(pair * wide + begin)
    pair, begin, end = pair[order], begin[order], end[order]
    new = np.concatenate([[True], pair[1:] != pair[:-1]])[: len(pair)]
    names, at = pair[new], np.cumsum(new) - 1
    reach = np.maximum.accumulate(end + at * wide) - at * wide  # the farthest end so far in a pair
    before = np.concatenate([[0], reach[:-1]])
    before[: len(new)][new] = 0
    return names, np.bincount(at, np.maximum(0, end - np.maximum(begin, before[: len(at)])), minlength=len(names)).astype(np.int64)


def _search_sets(cid: np.ndarray, fm: FMIndex, train: pd.DataFrame, known, t: Fraction) -> pd.DataFrame:
    tflat, tstarts = W.flatten(train["words"].to_list())
    ordered = W.rare_first(tflat, tstarts, *known)
    n = np.diff(tstarts)
    row = np.repeat(np.arange(len(n)), n)
    pos = np.arange(len(ordered)) - tstarts[row]
    symbol = fm.symbols(ordered)
    lo, hi = fm.start(symbol)
    need = W.ceil_share(t, n)
    share = np.minimum(2, need)  # of the first n - need + share words, so many are shared
    anchor = pos < (n - need + share)[row]
    sizes, which_size = np.unique(n, return_inverse=True)
    runs = np.array([guaranteed_run(int(x), t) for x in sizes], np.int64)[which_size]
    # how often the runs occur: backward search over as many words as one run must have
    rlo, rhi, depth = lo.copy(), hi.copy(), 1
    live = np.flatnonzero((hi > lo) & (runs > 1)[row])
    while len(live):
        live = live[(runs[row[live]] > depth) & (pos[live] >= depth)]
        rlo[live], rhi[live] = fm.extend(symbol[live - depth], rlo[live], rhi[live])
        live = live[rhi[live] > rlo[live]]
        depth += 1
    rhi = np.where(pos + 1 < runs[row], rlo, rhi)
    by_run = np.bincount(row, rhi - rlo, minlength=len(n)) < np.bincount(row, (hi - lo) * anchor, minlength=len(n))
    ends = np.flatnonzero(np.where(by_run[row], rhi > rlo, anchor & (hi > lo)))
    end, length, mlo, mhi = fm.maximal(symbol, tstarts[row], np.where(by_run, runs, 1)[row], ends)
    wanted = np.where(by_run, runs, share)
    doc_size = fm.size.astype(np.int64)
    tsketch = np.packbits(sketches(tflat, tstarts), axis=1).view(np.uint64)
    order = np.argsort(end, kind="stable")
    end, length, mlo, mhi = end[order], length[order], mlo[order], mhi[order]
    visits = np.cumsum(np.bincount(row[end], mhi - mlo, minlength=len(n))) if len(n) else np.zeros(0)
    cut = np.unique(np.minimum(np.searchsorted(visits, np.arange(BATCH_VISITS, (visits[-1] if len(visits) else 0) + BATCH_VISITS, BATCH_VISITS)) + 1, len(n)))
    out = []
    for a, b in zip([0, *cut[:-1]], cut):  # training rows a to b - 1
        m = slice(*np.searchsorted(end, [tstarts[a], tstarts[b]]))
        at, which = spread(mlo[m], mhi[m])
        # rows of the suffix array that several matches share are located once
        rows, back = np.unique(at, return_inverse=True)
        e = fm.locate(rows)[0][back]
        of = row[end[m]][which]
        ok = (doc_size[e] * t.denominator >= n[of] * t.numerator) & (doc_size[e] * t.numerator <= n[of] * t.denominator)
        of, e, which = of[ok], e[ok], which[ok]
        stop = pos[end[m]][which] + 1
        key, count = _covered(of * len(cid) + e, stop - length[m][which], stop)
        r, e = key // len(cid), key % len(cid)
        ok = count >= wanted[r]
        r, e = r[ok], e[ok]
        if not len(r):
            continue
        docs, place = np.unique(e, return_inverse=True)
        flat, starts = fm.words(docs)
        esketch = np.packbits(sketches(flat, starts), axis=1).view(np.uint64)
        # sketches farther apart than the sets may be need no exact check
        far = np.bitwise_count(tsketch[r] ^ esketch[place]).sum(1, dtype=np.int64)
        ok = far * (t.denominator + t.numerator) <= (n[r] + doc_size[e]) * (t.denominator - t.numerator)
        r, e, place = r[ok], e[ok], place[ok]
        both = W.overlaps(tflat, tstarts, r, place, flat, starts)
        either = n[r] + doc_size[e] - both
        ok = both * t.denominator >= either * t.numerator
        out.append(pd.DataFrame({"e": cid[e[ok]], "t": train["cid"].to_numpy(np.int64)[r[ok]], "similarity": both[ok] / either[ok]}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"e": np.zeros(0, np.int64), "t": np.zeros(0, np.int64), "similarity": np.zeros(0)})


def overlapping(evaluation: DataFrame, training: DataFrame, id_col: str, text_col: str, threshold: str = "0.7") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (id, cid) of evaluation and of training classes, and similar pairs of classes (e, t, similarity).

    Rows with a null id, a null text or a text without words are left out; copies are compared once.
    """
    sides = []
    for name, df in (("evaluation", evaluation), ("training", training)):
        sets = materialize(W.word_sets(df, id_col, text_col), f"{name}-sets")
        classes = W.set_classes(sets, f"{name}-classes")
        sides.append((W.set_members(sets, classes, f"{name}-members"), classes))
    return sides[0][0], sides[1][0], similar_across(sides[0][1], sides[1][1], threshold)


def seen_words(evaluation: DataFrame, training: DataFrame, id_col: str, text_col: str, least: int = 5) -> DataFrame:
    """(id, n_words, seen, longest): the words of each evaluation text that lie in a run of at least
    `least` words which also occurs in a training text, and the longest such run (0: none).

    Of several texts of an id the smallest counts; null ids, null texts and texts without words are left out.
    """
    tokens = lambda c: F.transform(F.regexp_extract_all(F.lower(F.col(c)), F.lit(W.WORD), F.lit(0)), lambda w: F.xxhash64(w))
    own = evaluation.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL").groupBy("id").agg(F.min("text").alias("text"))
    own = own.select("id", tokens("text").alias("words")).where("size(words) > 0").withColumn("h1", F.xxhash64("words")).withColumn("h2", F.xxhash64(F.lit(17), F.reverse("words")))
    own = materialize(own, "evaluation-texts")
    texts = W.set_classes(own, "evaluation-text-classes")
    other = training.select(tokens(text_col).alias("words")).where(F.size("words") >= least)
    other = W.set_classes(other.withColumn("h1", F.xxhash64("words")).withColumn("h2", F.xxhash64(F.lit(17), F.reverse("words"))), "training-text-classes")

    def build(pdf: pd.DataFrame) -> bytes:
        return _pack(pdf["cid"], FMIndex.build(*W.flatten(pdf["words"].to_list())))

    def search(blob: bytes, train: pd.DataFrame) -> pd.DataFrame:
        cid, fm = _unpack(blob)
        flat, starts = W.flatten(train["words"].to_list())
        _, run, lo, hi = fm.maximal(fm.symbols(flat), np.repeat(starts[:-1], np.diff(starts)), least)
        once = np.unique(np.stack([run, lo, hi]), axis=1)  # many training texts have the same match
        at, which = spread(once[1], once[2])
        rows, back = np.unique(at, return_inverse=True)
        doc, offset = fm.locate(rows)
        longest = np.zeros(len(rows), np.int64)
        np.maximum.at(longest, back, once[0][which])
        return pd.DataFrame({"cid": cid[doc], "begin": offset, "run": longest})

    folder = _shards(texts.select("cid", "words"), build)
    spans = _stream(other, folder, search, "cid long, begin long, run long").groupBy("cid", "begin").agg(F.max("run").alias("run"))  # at most one for each word
    # the union of the spans of a text: what each adds to those that begin before it
    before = Window.partitionBy("cid").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("begin") + F.col("run")
    spans = spans.withColumn("reach", F.coalesce(F.max(end).over(before), F.lit(0)))
    seen = spans.groupBy("cid").agg(F.sum(F.greatest(F.lit(0), end - F.greatest("begin", "reach"))).cast("int").alias("seen"), F.max("run").cast("int").alias("longest"))
    t = own.select("id", "h1", "h2", F.size("words").alias("n_words")).join(texts.select("h1", "h2", "cid"), ["h1", "h2"]).join(seen, "cid", "left")
    return t.select("id", "n_words", F.coalesce("seen", F.lit(0)).alias("seen"), F.coalesce("longest", F.lit(0)).alias("longest"))
