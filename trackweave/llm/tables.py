"""Tables on their way: to Python workers by bytes, between steps as Parquet in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from trackweave.plans.durable import checkpoint_dir

#: what a Python worker is given at once: texts come by bytes, not by thousands of rows
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def by_bytes(spark: SparkSession) -> None:
    """Hand texts to Python in batches of at most ``BATCH_BYTES`` (a longer row alone), whatever the number of rows.

    A frame is planned when it is read, so the session keeps the setting; no result depends on it.
    """
    spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back: lineage ends in files that outlive any executor."""
    path = f"{checkpoint_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
