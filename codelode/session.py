"""Session helpers: table access and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores, dealt out to all of them.

    For rows that cost much each: one small file would otherwise keep one core busy.
    Any input of more partitions than cores stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors see, as the cluster names it in spark.checkpoint.dir.

    Only where that setting is absent and executors are threads of this machine
    (tests, a laptop) a local one is made; a cluster must name one.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    one_machine = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
    if not named and sc.getCheckpointDir() is None and not one_machine:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="codelode-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared folder and forget how it was made."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
