"""Session settings that results depend on, and small helpers for plans."""

from __future__ import annotations

import atexit
import logging
import os
import uuid
from logging.handlers import RotatingFileHandler

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def session(name: str = "sparkevid", **conf: str) -> SparkSession:
    """A session in UTC; ``conf`` keys have underscores for dots."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC")
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def log_to(path: str, name: str = "sparkevid", size: int = 10 << 20, files: int = 3) -> logging.Logger:
    """The driver's log as a file that is rotated at ``size`` bytes; ``files`` old ones are kept. A path is opened once."""
    log = logging.getLogger(name)
    if not any(getattr(h, "baseFilename", None) == os.path.abspath(path) for h in log.handlers):
        handler = RotatingFileHandler(path, maxBytes=size, backupCount=files, encoding="utf-8")
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(handler)
        log.setLevel(logging.INFO)
    return log


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Used only where a local session names no shared folder.
LOCAL_DIR = "file:///tmp/checkpoints"
_stored: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """The folder of this application that all machines share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    return f"{(root or LOCAL_DIR).rstrip('/')}/sparkevid/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """A table that several jobs read, as Parquet in the cluster's shared folder (spark.checkpoint.dir): its lineage ends there, so a lost
    executor costs running tasks only, and plans stay short. Deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    schema = df.schema
    df.write.parquet(path)
    if not _stored:
        atexit.register(_clean)
    _stored.append((spark, path))
    out = spark.read.schema(schema).parquet(path)
    out.stored_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    _delete(df.sparkSession, df.stored_at)
    _stored.remove((df.sparkSession, df.stored_at))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _stored:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended
            return


def spread(df: DataFrame) -> DataFrame:
    """A table in fewer splits than there are cores is dealt anew before expensive expressions."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def top(df: DataFrame, k: int, by: list[str], *order: Column, rank: str = "rank") -> DataFrame:
    """The first k rows of each group in a total order; Spark prunes groups before the shuffle."""
    number = F.row_number().over(Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order))
    return df.withColumn(rank, number).where(F.col(rank) <= k)


#: Rows and bytes up to which a side of a join is broadcast, both measured first; rows of a side with texts that another table's count stands for.
SMALL, SMALL_BYTES, SMALL_TEXTS = 100_000, 64 << 20, 10_000


def _width(df: DataFrame) -> Column:
    """Bytes of a row, about: its strings as they are, 16 for any other value, arrays by their text form."""
    parts = [F.lit(16)]
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        parts.append(F.coalesce(F.octet_length(f"`{f.name}`" if kind in ("string", "binary") else F.to_json(F.struct(f"`{f.name}`"))), F.lit(0)) if kind in ("string", "binary") or "<" in kind else F.lit(16))
    return sum(parts[1:], parts[0]).cast("long")


def small(df: DataFrame, of: DataFrame | None = None, times: int = 1) -> DataFrame:
    """A side that is expected to be small (terms of questions, chosen hits): marked for broadcast if it is, else joined by a shuffle.

    Spark cannot know the size of what an aggregation will return when it plans, and would shuffle the corpus. ``of``: a table
    that is cheap to count, of which ``df`` has at most ``times`` rows each; ``df`` itself is then not computed twice. Else its rows and bytes are
    measured. A table is measured once."""
    counted = df if of is None else of
    if "measured" not in vars(counted):
        first = counted.limit(SMALL + 1)
        counted.measured = first.agg(F.count("*"), F.coalesce(F.sum(_width(first)) if of is None else F.lit(0), F.lit(0))).first()
    rows, size = counted.measured
    texts = any(f.dataType.simpleString() == "string" or "<" in f.dataType.simpleString() for f in df.schema.fields)
    most = SMALL if of is None or not texts else SMALL_TEXTS
    return F.broadcast(df) if rows * times <= most and (of is not None or size <= SMALL_BYTES) else df
