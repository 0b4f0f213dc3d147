"""Session-level helpers: where lineage may be cut and how wide a shuffle should be."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    Read from ``spark.checkpoint.dir``.  Only where the cluster names none (a
    local test session) a temporary folder is made and set for the session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = current.get() if current.isDefined() else None
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="pricetide-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, for a table written by one run."""
    return os.path.join(shared_dir(spark), "pricetide", f"{label}-{uuid.uuid4().hex}")


def release(spark: SparkSession) -> None:
    """Let the driver give up what finished queries hold there: places of shuffled data, broadcasts and plans.

    They go with the driver's garbage, which a long run of small queries else leaves until its heap is full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table and all below it, on whatever file system it lies."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Scan one table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
