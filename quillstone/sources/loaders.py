"""Loading and storing corpora, vectors, queries, models and results, with the checks that they need."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions import vec

#: Names under which ids and vectors are found, the first that is there counts.
ID_NAMES = ("sentence_ids", "ids", "sentence_id", "query_id", "unit_id", "vec_id")
VECTOR_NAMES = ("embeddings", "embedding", "X", "emb")
QUERY_FIELDS = ("query_id", "query_text", "consensus_law")

CORPUS_SCHEMA = T.StructType(
    [T.StructField("unit_id", T.LongType()), T.StructField("label", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("source_file", T.StringType())]
)
QUERY_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("query_id", "topic_id", "query_text", "consensus_law", "style", "issue")])


class DataError(ValueError):
    """Data that doesn't keep the contract of its reader."""


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise DataError(f"missing columns: {missing}")


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of ids that occur more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(df: DataFrame, key: str) -> None:
    if row := duplicate_ids(df, key).first():
        raise DataError(f"id {row[0]!r} occurs {row[1]} times in {key}")


def read_corpus(spark: SparkSession, path: str, id_col: str = "sentence_id", label_col: str = "law_type", text_col: str = "sentence") -> DataFrame:
    """Passages (id, label, text, ...) whose ids are unique."""
    df = spark.read.parquet(path)
    require_columns(df, [id_col, label_col, text_col])
    require_unique(df, id_col)
    return df


def pick(columns: Sequence[str], names: Sequence[str]) -> str:
    for n in names:
        if n in columns:
            return n
    raise DataError(f"none of {list(names)} in {list(columns)}")


def read_bundle(spark: SparkSession, path: str, normalize: bool = True) -> DataFrame:
    """(unit_id, emb): vectors of one dimension and unique ids, of unit length if `normalize`. Null vectors are left out."""
    df = spark.read.parquet(path)
    i, v = pick(df.columns, ID_NAMES), pick(df.columns, VECTOR_NAMES)
    df = df.select(F.col(i).alias("unit_id"), F.col(v).alias("emb")).where("emb IS NOT NULL")
    require_unique(df, "unit_id")
    if df.select(F.size("emb").alias("d")).distinct().limit(2).count() > 1:
        raise DataError("vectors of more than one dimension")
    return df.select("unit_id", vec.unit(F.col("emb")).cast("array<float>").alias("emb")) if normalize else df


def subset_by_ids(bundle: DataFrame, wanted: DataFrame, key: str = "unit_id") -> DataFrame:
    """The rows of the wanted ids; an error if one is missing. `wanted` may carry an order column."""
    if row := wanted.select(key).join(bundle.select(key), key, "left_anti").first():
        raise DataError(f"no vector for id {row[0]!r}")
    return wanted.join(bundle, key)


def read_queries(spark: SparkSession, path: str, fields: Sequence[str] = QUERY_FIELDS) -> DataFrame:
    """Queries from JSON lines or Parquet; the required fields are there and not blank, ids are unique."""
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.schema(QUERY_SCHEMA).option("mode", "FAILFAST").json(path)
    require_columns(df, fields)
    blank = F.lit(False)
    for f in fields:
        blank = blank | F.col(f).isNull() | (F.trim(F.col(f)) == "")
    if row := df.where(blank).first():
        raise DataError(f"a required field of {row!r} is blank")
    require_unique(df, fields[0])
    return df


def usable_queries(df: DataFrame, fields: Sequence[str] = QUERY_FIELDS) -> DataFrame:
    """Rows whose required fields are not blank."""
    for f in fields:
        df = df.where(F.col(f).isNotNull() & (F.trim(F.col(f)) != ""))
    return df


def write_verified(df: DataFrame, path: str, fmt: str = "parquet") -> int:
    """Write beside the target, count what can be read there, and only then put it in place; the number of rows."""
    spark, temp = df.sparkSession, f"{path}.writing-{uuid.uuid4().hex}"
    df.write.format(fmt).save(temp)
    n = spark.read.format(fmt).schema(df.schema).load(temp).count()
    jvm = spark._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(temp), jvm.org.apache.hadoop.fs.Path(path)
    fs = source.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        fs.delete(target, True)
    if not fs.rename(source, target):
        raise OSError(f"{temp} can't be put in the place of {path}")
    return n


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def fingerprint_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest) SHA-256 of each row's id, a zero byte, its text and a line feed."""
    row = F.concat(F.col(id_col).cast("string"), F.lit("\0"), F.coalesce(text_col, F.lit("")), F.lit("\n"))
    return df.select(F.col(id_col).alias("id"), F.sha2(row, 256).alias("digest"))


def fingerprint(df: DataFrame, id_col: str, text_col: str, buckets: int = 256) -> DataFrame:
    """(n, fingerprint) of a dataset whatever its partitions: the digest of the digests of buckets of row digests in order of the id.

    This is not the digest of one ordered stream, which would need one task.
    """
    r = fingerprint_rows(df, id_col, text_col).withColumn("bucket", F.conv(F.substring("digest", 1, 2), 16, 10).cast("int") % buckets)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "digest"))), lambda s: s["digest"]), "")
    b = r.groupBy("bucket").agg(F.sha2(joined, 256).alias("d"), F.count(F.lit(1)).alias("n"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "d"))), lambda s: s["d"]), "")
    return b.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(whole, 256).alias("fingerprint"))


def ordered_fingerprint(df: DataFrame, id_col: str, text_col: str, most: int = 1_000_000) -> str:
    """SHA-256 over all rows in order of the id, for a dataset of at most `most` rows."""
    import hashlib

    h, n = hashlib.sha256(), 0
    for r in df.select(id_col, text_col).orderBy(id_col).toLocalIterator():
        n += 1
        if n > most:
            raise DataError(f"more than {most} rows")
        h.update(f"{r[0]}\0{r[1] or ''}\n".encode())
    return h.hexdigest()


def save_model(tables: dict[str, DataFrame], path: str) -> None:
    """A model is a few tables; each is written and verified."""
    for name, t in tables.items():
        write_verified(t, f"{path}/{name}")


def load_model(spark: SparkSession, path: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def read_arrays(spark: SparkSession, path: str, layout: str = "rows") -> DataFrame:
    """(unit_id, emb) from npy or npz files; in npz, ids and vectors are found by name. "columns": samples are columns."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                z = np.load(io.BytesIO(content))
                if name.endswith(".npz"):
                    x = z[pick(z.files, VECTOR_NAMES)]
                    ids = z[pick(z.files, ID_NAMES)] if set(ID_NAMES) & set(z.files) else None
                else:
                    x, ids = z, None
                x = x.T if layout == "columns" else x
                ids = np.arange(len(x)) if ids is None else ids
                if len(ids) != len(x):
                    raise DataError(f"{len(ids)} ids for {len(x)} vectors in {name}")
                for i in range(0, len(x), 4096):
                    yield pd.DataFrame({"unit_id": ids[i : i + 4096].astype(np.int64), "emb": list(x[i : i + 4096].astype(np.float32))})

    return files.mapInPandas(run, "unit_id long, emb array<float>")


def write_arrays(df: DataFrame, path: str, layout: str = "rows", most: int = 1_000_000) -> int:
    """One npz file (ids, embeddings) of at most `most` vectors, written beside its place and moved there."""
    rows = df.select("unit_id", "emb").orderBy("unit_id").limit(most + 1).toPandas()
    if len(rows) > most:
        raise DataError(f"more than {most} vectors")
    x = np.stack(rows["emb"].to_numpy()).astype(np.float32) if len(rows) else np.zeros((0, 0), np.float32)
    temp = Path(path).with_suffix(f".{uuid.uuid4().hex}.npz")
    np.savez(temp, ids=rows["unit_id"].to_numpy(np.int64), embeddings=x.T if layout == "columns" else x)
    with np.load(temp) as z:
        if len(z["ids"]) != len(rows):
            raise OSError(f"{temp} is incomplete")
    temp.replace(path)
    return len(rows)
