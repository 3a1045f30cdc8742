"""Cutting lineage so that a lost executor never loses the cut point."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session, or a fresh local one where none is named."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(named)
    return named


def durable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result is written to the shared folder and read back from it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
