"""Sizes of texts in tokens."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: How byte-level BPE cuts a text before merging (a published, fixed pattern).
CUT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_tokens(text: Column) -> Column:
    """One token for each UTF-8 byte; 0 for a null text."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def character_begins(text: Column, capacity: int) -> Column:
    """Bytes of the UTF-8 text where parts of at most `capacity` bytes begin, each at a character."""
    if capacity < 4:
        raise ValueError("a part must have room for a character")
    whole = F.encode(text, "UTF-8")
    inside = lambda b, at: F.conv(F.hex(F.substring(b, at + 1, F.lit(1))), 16, 10).cast("int").between(128, 191)

    def next_begin(begins: Column, b: Column) -> Column:
        at = (F.element_at(begins, -1) + capacity).cast("int")
        for _ in range(3):  # a character has at most four bytes
            at = F.when(inside(b, at), at - 1).otherwise(at)
        return F.when(at < F.length(b), F.concat(begins, F.array(at.cast("long")))).otherwise(begins)

    rounds = F.sequence(F.lit(1), F.ceil(F.length(whole) / (capacity - 3)).cast("int"))
    return F.aggregate(rounds, F.struct(F.array(F.lit(0).cast("long")).alias("begins"), whole.alias("b")), lambda acc, _: F.struct(next_begin(acc["begins"], acc["b"]).alias("begins"), acc["b"].alias("b")), lambda acc: acc["begins"])


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=CUT, mergeable_ranks=ranks, special_tokens={})


def bpe_tokens(text: Column, vocabulary: str) -> Column:
    """Tokens of a byte-level BPE whose ranks are in the file `vocabulary`, a path that every executor can read."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoding(vocabulary)
        for b in batches:
            yield pd.Series([0 if t is None else len(enc.encode_ordinary(t)) for t in b], dtype="int64")

    return count(text)
