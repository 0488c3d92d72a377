"""Readers for a folder of parquet tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    """The table ``name`` of a folder that holds one parquet file or directory a table.

    ``spread``: rows that take much work each are dealt out over all cores where the files give fewer
    tasks than there are; large tables are read as they lie.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() < cores else df


def cache_folder(argument: str | None = None, variable: str = "LOTWISE_CACHE", default: str | None = None) -> str | None:
    """Where documents are kept: the argument, else the environment variable, else the default; None for "off" and "none"."""
    chosen = next((v.strip() for v in (argument, os.environ.get(variable), default) if v and v.strip()), None)
    return None if chosen is None or chosen.lower() in ("off", "none") else chosen


def shared_folder(spark: SparkSession) -> str | None:
    """The folder all executors share, as the cluster names it; None where it is unset."""
    return spark.conf.get("spark.checkpoint.dir", None)


def ensure_checkpoints(spark: SparkSession) -> None:
    """Let ``checkpoint()`` write to the cluster's shared folder.

    Only where no such folder is named (single-machine tests) a local one is made.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = shared_folder(spark)
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("a cluster must name a folder that all executors share in spark.checkpoint.dir")
        import tempfile

        named = tempfile.mkdtemp(prefix="lotwise-checkpoints-")
    sc.setCheckpointDir(named)
