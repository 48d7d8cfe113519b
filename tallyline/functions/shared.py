"""The folder that driver and executors share, and what is kept there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """As spark.checkpoint.dir names it, else beside the warehouse's tables."""
    context = spark.sparkContext
    return context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir() or f"{spark.conf.get('spark.sql.warehouse.dir')}/tallyline-shared"


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new name in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoints_on(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder, those of Spark ML's fits as well, which makes none without a folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives the loss of any executor."""
    checkpoints_on(df.sparkSession)
    return df.checkpoint()
