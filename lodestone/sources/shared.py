"""The folder that the driver and all executors share, and tables kept there."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: For sessions of one machine that name no folder, as in tests.
LOCAL = "/tmp/checkpoints"


def folder(spark: SparkSession) -> str:
    """The cluster's shared folder, ready for checkpoint(); a session of several machines must name it in spark.checkpoint.dir."""
    to = spark.conf.get("spark.checkpoint.dir", None)
    if not to:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        to = LOCAL
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(to)
    return to.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """df, computed once and kept as a compressed table in the shared folder, with a folder for each value of ``by``."""
    to = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").partitionBy(*by or []).parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to).select(*df.columns)
