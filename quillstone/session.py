"""Session settings and the shared working folder."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quillstone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators expect (UTC, AQE, Arrow)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.executorEnv.OMP_NUM_THREADS": "1",
        "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
    }
    for k, v in (settings | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's `spark.checkpoint.dir`.

    Only where the session names none (local tests) a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
        if found:
            found = found.rsplit("/", 1)[0]
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillstone-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back.

    This cuts the lineage so that neither a lost executor nor a second use recomputes the
    plan, and later readers see a stable row set.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillstone/{tag}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillstone_path = path  # for discard()
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind a `materialize` result that nothing reads any more."""
    path = getattr(df, "_quillstone_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what nothing refers to any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Give memory that a task has freed back to the system: Python processes outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def shared_files(folder: str) -> list[str]:
    """The Parquet files of a table in the shared folder, in order."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    return sorted(f.path for f in system.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet"))


def read_shared(folder: str, batch_size: int = 65536, files: list[str] | None = None) -> Iterator[pa.RecordBatch]:
    """The batches of a table in the shared folder, or of some of its files, read by the task that calls."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, _ = fs.FileSystem.from_uri(folder)
    for f in shared_files(folder) if files is None else files:
        with system.open_input_file(f) as source:
            yield from pq.ParquetFile(source).iter_batches(batch_size=batch_size)


def clean(spark: SparkSession) -> None:
    """Delete all working tables in the shared folder, once no result that reads them is needed any more."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quillstone")
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def tasks(spark: SparkSession, per_core: int = 2) -> int:
    """A number of tasks that keeps every core of the session busy."""
    return max(1, spark.sparkContext.defaultParallelism) * per_core


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_quillstone_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="quillstone-")) / "quillstone.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    sc.addPyFile(str(target))
    sc._quillstone_shipped = True
