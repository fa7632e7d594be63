"""Cutting lineage through the checkpoint folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session (a folder all executors share).  Only a local session
    without one, as in tests, gets a temporary folder; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not named and not (sc.master or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = named or tempfile.mkdtemp(prefix="factloom-ckpt-")
        sc.setCheckpointDir(named)
    return named or sc.getCheckpointDir()


#: Spark deletes the shuffle files of a query when it ends; else they stay until the driver's garbage is collected
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files; the session's setting comes back."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows once and go on from the written copy: later uses neither recompute nor depend on executors."""
    checkpoint_root(df.sparkSession)
    with _shuffles_dropped(df.sparkSession):
        # the setting holds for queries planned under it, so not for ``df`` itself
        return df.select("*").checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint root."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as a columnar table below the checkpoint root and read it back, for data that several queries scan
    with different columns."""
    path = scratch(df.sparkSession, name)
    with _shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``stored`` has written; no plan may read it later."""
    spark = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
