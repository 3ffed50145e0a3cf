"""Encoding texts with any encoder, and choosing the space a query is searched in."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The query encoders and the index that each of them searches.
SPACES = {"lexical": "lexical", "dense": "dense", "adapter": "dense"}

Encoder = Callable[[list[str]], np.ndarray]


def encode(texts: DataFrame, make: Callable[[], Encoder], id_col: str, text_col: str, batch: int = 64, dim: int | None = None, normalize: bool = True, prefix: str = "") -> DataFrame:
    """(id, emb): vectors of non-null texts. `make` builds the encoder once in each task; a batch that runs out
    of memory is halved. Longer vectors are cut to `dim` before they are made unit length, shorter ones are an error."""
    t = texts.schema[id_col].dataType.simpleString()

    def some(encoder: Encoder, items: list[str]) -> np.ndarray:
        try:
            return np.asarray(encoder(items), np.float32)
        except MemoryError:
            if len(items) == 1:
                raise
            half = len(items) // 2
            return np.concatenate([some(encoder, items[:half]), some(encoder, items[half:])])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make()
        for b in batches:
            for i in range(0, len(b), batch):
                part = b.iloc[i : i + batch]
                x = some(encoder, [prefix + s for s in part["text"]])
                if x.shape != (len(part), x.shape[1]) or (dim and x.shape[1] < dim):
                    raise ValueError(f"the encoder gave {x.shape} for {len(part)} texts, {dim} elements are wanted")
                x = x[:, :dim] if dim else x
                if normalize:
                    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "emb": list(x)})

    return texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL").mapInPandas(run, f"id {t}, emb array<float>")


def hashing_encoder(dim: int = 64) -> Callable[[], Encoder]:
    """An encoder without a model: signed counts of hashed words. For tests and as a floor for comparisons."""

    def make() -> Encoder:
        def run(items: list[str]) -> np.ndarray:
            x = np.zeros((len(items), dim), np.float32)
            for i, s in enumerate(items):
                for w in s.lower().split():
                    h = zlib.crc32(w.encode())
                    x[i, h % dim] += 1 if h & 1 << 20 else -1
            return x

        return run

    return make


def index_for(method: str, indexes: dict[str, DataFrame]) -> DataFrame:
    """The index that queries of this method are searched in."""
    if method not in SPACES:
        raise ValueError(f"unknown method {method!r}, known: {sorted(SPACES)}")
    return indexes[SPACES[method]]
