"""A compressed full-text index over sequences of words (64-bit hashes).

The Burrows-Wheeler transform of the concatenated sequences is kept as a wavelet matrix with
rank counts in two levels; patterns are searched backward, many at once. The suffix array is
sampled: an entry is located by steps backward in the text to a sampled one. The words
themselves are read back from the transform, so that no copy of the texts is kept.
"""

from __future__ import annotations

import io

import numpy as np

SAMPLE = 8  # every so many positions of a sequence are sampled, and its first
SUPER = 512  # words of bits that share a rank count


class Bits:
    """Bits with ranks: a count for each SUPER words, and one of two bytes for each word."""

    def __init__(self, word: np.ndarray, high: np.ndarray | None = None, low: np.ndarray | None = None) -> None:
        if high is None:
            total = np.concatenate([[0], np.cumsum(np.bitwise_count(word).astype(np.int64))])[:-1]
            high = total[::SUPER]
            low = (total - np.repeat(high, SUPER)[: len(total)]).astype(np.uint16)
        self.word, self.high, self.low = word, high, low

    @classmethod
    def of(cls, b: np.ndarray) -> Bits:
        padded = np.zeros((len(b) // 64 + 1) * 64, np.uint8)
        padded[: len(b)] = b
        return cls(np.packbits(padded, bitorder="little").view(np.uint64))

    def ranks(self, at: np.ndarray) -> np.ndarray:
        """How many bits before each position are set."""
        w, inside = at >> 6, (at & 63).astype(np.uint64)
        return self.high[w // SUPER] + self.low[w] + np.bitwise_count(self.word[w] & ((np.uint64(1) << inside) - np.uint64(1))).astype(np.int64)

    def at(self, at: np.ndarray) -> np.ndarray:
        return ((self.word[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class FMIndex:
    PARTS = ("vocabulary", "first", "zeros", "doc", "offset", "ends", "size")

    def __init__(self, levels: list[Bits], marks: Bits, **parts: np.ndarray) -> None:
        self.levels, self.marks = levels, marks
        self.__dict__.update(parts)
        n = len(self.vocabulary) + 1
        self._begin = self._descend(np.arange(n), np.zeros(n, np.int64))

    @classmethod
    def build(cls, flat: np.ndarray, starts: np.ndarray) -> FMIndex:
        """Index the lists flat[starts[i]:starts[i + 1]]."""
        n_docs = len(starts) - 1
        vocabulary = np.unique(flat)
        sizes = np.diff(starts)
        doc = np.repeat(np.arange(n_docs), sizes + 1)
        begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        offset = np.arange(len(doc)) - begin[doc]
        text = np.zeros(len(doc), np.int64)  # 0 ends each sequence
        text[offset < sizes[doc]] = np.searchsorted(vocabulary, flat) + 1
        order = cls._suffixes(text, int(sizes.max(initial=0)) + 1)
        bwt = text[order - 1]
        first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(vocabulary) + 1))])
        depth = max(1, int(len(vocabulary)).bit_length())
        levels, zeros = [], []
        for level in range(depth - 1, -1, -1):
            b = ((bwt >> level) & 1).astype(np.uint8)
            levels.append(Bits.of(b))
            zeros.append(len(b) - int(b.sum()))
            bwt = np.concatenate([bwt[b == 0], bwt[b == 1]])
        sampled = offset[order] % SAMPLE == 0
        ends = np.empty(n_docs, np.int32)
        last = np.flatnonzero(offset[order] == sizes[doc[order]])
        ends[doc[order][last]] = last
        return cls(levels, Bits.of(sampled.astype(np.uint8)), vocabulary=vocabulary, first=first, zeros=np.array(zeros, np.int64), doc=doc[order][sampled].astype(np.int32), offset=offset[order][sampled].astype(np.int32), ends=ends, size=sizes.astype(np.int32))

    @staticmethod
    def _suffixes(text: np.ndarray, depth: int) -> np.ndarray:
        """Suffixes ordered by their first `depth` words at least, by prefix doubling."""
        n, width = len(text), 1
        rank = text.copy()
        order = np.argsort(rank, kind="stable")
        while width < depth:
            after = np.zeros(n, np.int64)
            after[: n - width] = rank[width:] + 1 if width < n else 0
            key = rank * (n + len(text) + 2) + after
            order = np.argsort(key, kind="stable")
            s = key[order]
            new = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = new
            if n and new[-1] == n - 1:
                break
            width *= 2
        return order

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, bits in enumerate(self.levels):
            ones = bits.ranks(at)
            at = np.where((symbol >> (len(self.levels) - 1 - k)) & 1 == 1, self.zeros[k] + ones, at - ones)
        return at

    def back(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol before each suffix, and the row of the suffix that begins with it."""
        symbol, at = np.zeros(len(row), np.int64), row
        for k, bits in enumerate(self.levels):
            bit, ones = bits.at(at), bits.ranks(at)
            symbol = symbol * 2 + bit
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
        return symbol, self.first[symbol] + at - self._begin[symbol]

    def locate(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequence of each suffix and its position there."""
        row = row.astype(np.int64)
        doc, offset, steps = np.empty(len(row), np.int64), np.empty(len(row), np.int64), 0
        left = np.arange(len(row))
        while len(left):
            known = self.marks.at(row) == 1
            at = self.marks.ranks(row[known])
            doc[left[known]], offset[left[known]] = self.doc[at], self.offset[at] + steps
            left, row = left[~known], row[~known]
            if len(left):
                _, row = self.back(row)
            steps += 1
        return doc, offset

    def words(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words of these sequences, flat, and where each begins (one more entry than sequences); last word first."""
        row, who = self.ends[docs].astype(np.int64), np.arange(len(docs))
        of, found = [], []
        while len(who):
            symbol, row = self.back(row)
            go = symbol > 0
            who, row = who[go], row[go]
            of.append(who)
            found.append(self.vocabulary[symbol[go] - 1])
        of = np.concatenate(of) if of else who
        found = np.concatenate(found) if found else np.zeros(0, np.int64)
        return found[np.argsort(of, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(docs)))])

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """The words' symbols; -1 for words that the index doesn't have."""
        if not len(self.vocabulary):
            return np.full(len(words), -1, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at + 1, -1)

    def start(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of suffixes that begin with the symbol."""
        s = np.maximum(symbol, 0)
        return np.where(symbol < 0, 0, self.first[s]), np.where(symbol < 0, 0, self.first[s + 1])

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the interval of what lo..hi begins with, preceded by the symbol."""
        s = np.maximum(symbol, 0)
        both = self._descend(np.concatenate([s, s]), np.concatenate([lo, hi]))
        base = self.first[s] - self._begin[s]
        dead = (symbol < 0) | (lo >= hi)
        return np.where(dead, 0, base + both[: len(s)]), np.where(dead, 0, base + both[len(s) :])

    def maximal(self, symbols: np.ndarray, row_start: np.ndarray, least: int | np.ndarray, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Matches (end position, length, lo, hi) that are maximal to the left for some indexed sequence, of at
        least `least` words (of one number, or one for each position).

        row_start[i] is where the pattern of position i begins; `ends` are the end positions wanted (default: all).
        For every end position the match is extended to the left as far as it occurs; it is reported at each
        length beyond which some of its occurrences end, so that a sequence that has only a part of the
        longest match gets its own.
        """
        lo, hi = self.start(symbols)
        least = np.broadcast_to(least, len(symbols))
        found = []
        at = np.arange(len(symbols)) if ends is None else ends
        at, length = at[hi[at] > lo[at]], 1
        while len(at):
            left = at - length
            can = left >= row_start[at]
            a, b = self.extend(np.where(can, symbols[np.maximum(left, 0)], -1), lo[at], hi[at])
            done = (b - a < hi[at] - lo[at]) & (length >= least[at])
            found.append((at[done], np.full(done.sum(), length), lo[at[done]], hi[at[done]]))
            go = b > a
            at = at[go]
            lo[at], hi[at] = a[go], b[go]
            length += 1
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate([f[i] for f in found]) if found else none for i in range(4))

    def dumps(self) -> bytes:
        out = io.BytesIO()
        vectors = [self.marks, *self.levels]
        bits = {f"{name}{i}": getattr(v, name) for i, v in enumerate(vectors) for name in ("word", "high", "low")}
        np.savez_compressed(out, **{p: getattr(self, p) for p in self.PARTS}, **bits)
        return out.getvalue()

    @classmethod
    def loads(cls, blob: bytes) -> FMIndex:
        z = np.load(io.BytesIO(blob))
        n = sum(k.startswith("word") for k in z.files)
        marks, *levels = (Bits(z[f"word{i}"], z[f"high{i}"], z[f"low{i}"]) for i in range(n))
        return cls(levels, marks, **{p: z[p] for p in cls.PARTS})


def spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All members of the intervals lo..hi, and which interval each is of."""
    count = hi - lo
    which = np.repeat(np.arange(len(lo)), count)
    return np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count), which
