"""What every operator of this subpackage shares: the shared folder, written tables, Python on executors.

Tables that several jobs read are written as Parquet below ``spark.checkpoint.dir``; a lost executor
then costs its running tasks only. Nothing is kept in machine-local folders.
"""

from __future__ import annotations

import atexit
import gc
import importlib
import os
import sys
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Used only where the session names no shared folder (local tests).
LOCAL_DIR = "file:///tmp/checkpoints"
#: Seconds between two collections of the driver's garbage.
COLLECT_S = 0.5
_collected = 0.0
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only for a local master whose session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    return (found or LOCAL_DIR).rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The driver's garbage is collected before, so that shuffle files of earlier jobs go while this one writes its own: the tables
    they were made for are written, and their plans are unreachable by now."""
    global _collected
    spark = df.sparkSession
    if time.monotonic() - _collected > COLLECT_S:
        gc.collect()
        spark._jvm.System.gc()
        _collected = time.monotonic()
    path = f"{shared_dir(spark)}/sparkevid/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    out = spark.read.schema(schema).parquet(path)
    out.written_to = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def dropped(*tables: DataFrame) -> None:
    """Delete written tables that no later job reads; what was made of them has been written."""
    for df in tables:
        _delete(df.sparkSession, df.written_to)
        _written.remove((df.sparkSession, df.written_to))


def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended
            return


def on_executors(module: str, function: str, *args) -> Callable[[Iterator], Iterator]:
    """``function(batches, *args)`` of a module of this subpackage, imported on the executor by name."""
    root, full = _ROOT, f"{__package__}.{module}"

    def run(batches):
        if root not in sys.path:
            sys.path.append(root)
        return getattr(importlib.import_module(full), function)(batches, *args)

    return run


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), and the key k1, k2 of a row: repeated rows share it, and so their result."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("k1"),
        F.xxhash64(text, F.col("doc_id").isNull()).alias("k2"),
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
