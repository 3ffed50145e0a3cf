"""Event-time windows and retrieval over streams of files.

Results are written in update mode, a Parquet folder for each micro-batch, and read back as the
latest row of each key: late events within the watermark correct a window, later ones are dropped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.session import shared_dir


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files of a folder (or a single file). Timestamps without zone become
    timestamps of the session's zone, as watermarks need them."""
    schema = spark.read.parquet(path).schema
    t = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path.rstrip("/") + "*")
    return t.select(*[F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name) for f in schema])


def run_to_table(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Run the stream over all that is there and return the latest row of each key."""
    spark, base = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/quillstone/stream-{uuid.uuid4().hex}"

    def store(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(store).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.option("mergeSchema", "true").parquet(f"{base}/out").drop("batch")
    w = Window.partitionBy(*keys).orderBy(F.desc("__batch"))
    return out.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__batch")


def windowed_counts(events: DataFrame, ts: str, window: Column, by: str, value: str, late: str = "1 hour") -> DataFrame:
    """(start, end, by, n, total) per window and value of `by`."""
    t = events.withWatermark(ts, late).groupBy(window.alias("w"), F.col(by)).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return t.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total")


def tumbling(ts: str, size: str) -> Column:
    return F.window(F.col(ts), size)


def sliding(ts: str, size: str, step: str) -> Column:
    return F.window(F.col(ts), size, step)


def session(ts: str, gap: str) -> Column:
    return F.session_window(F.col(ts), gap)


def for_each_batch(stream: DataFrame, answer: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """A stateless answer to each micro-batch, such as retrieval for a log of queries; the latest row of each key."""
    spark, base = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/quillstone/answers-{uuid.uuid4().hex}"

    def store(batch: DataFrame, number: int) -> None:
        answer(batch).withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    q = stream.writeStream.option("checkpointLocation", f"{base}/state").foreachBatch(store).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{base}/out").drop("batch")
    w = Window.partitionBy(*keys).orderBy(F.desc("__batch"))
    return out.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__batch")
