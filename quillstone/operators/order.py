"""A global order without a global sort in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.session import materialize, tasks


def numbered(df: DataFrame, order: Sequence[str], name: str = "index", start: int = 0, slices: int | None = None) -> DataFrame:
    """`df` with consecutive numbers in the order of the columns `order` (nulls first).

    Rows are range-partitioned; each slice is numbered by itself and shifted by the rows of the
    slices before it, of which there is one sum each. Rows that tie are numbered arbitrarily.
    """
    whole = materialize(df.repartitionByRange(slices or tasks(df.sparkSession), *order).withColumn("__slice", F.spark_partition_id()), "numbered")
    sizes = whole.groupBy("__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as slices
    sizes = sizes.select("__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__slice").orderBy(*order))
    t = whole.withColumn(name, own).join(F.broadcast(sizes), "__slice")
    return t.withColumn(name, F.col(name) + F.col("__before") + (start - 1)).drop("__slice", "__before")
