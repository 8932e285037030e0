"""The folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a local session (tests, a laptop) may leave it unset: it gets a temporary
    folder; on a cluster that would be a folder of the driver alone, so there it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        key = spark.sparkContext.applicationId
        if key not in _OWN:
            _OWN[key] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        root = _OWN[key]
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/tidemark/{tag}-{uuid.uuid4().hex}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage ends there,
    and a lost executor costs only the tasks it was running."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more. Its cleaner learns of them from the
    driver's garbage collector, which on its own runs only when the driver's heap fills, long after disks do."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of tables from :func:`staged` that nothing will read again."""
    for t in tables:
        path = getattr(t, "_staged_at", None)
        if path:
            spark = t.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
