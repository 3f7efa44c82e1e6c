"""Candidates for noisy records that arrive as a stream: a stream-static join of their keys to those of S1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators import blocking, records
from lodestone.sources import tables


def read_stream(spark: SparkSession, folder: str, src: int = 2) -> DataFrame:
    """New TSV files of the entity format in a folder."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in tables.SOURCE_COLUMNS])
    return spark.readStream.schema(schema).csv(folder, sep="\t", header=True, quote='"', escape='"').withColumn("src", F.lit(src))


def candidate_stream(s1: DataFrame, stream: DataFrame, names: tuple[str, ...] = ("a", "g")) -> DataFrame:
    """(s1_id, noisy_id, rule) of key rules; without state, so late and repeated rows are as good as others."""
    noisy = records.normalize_records(stream, unicode=True)
    out = None
    for name in names:
        one = blocking.rule(name, s1, noisy).withColumn("rule", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def run_available(candidates: DataFrame, to: str, checkpoint: str, score=None) -> None:
    """Handles what has arrived, a batch at a time, and stops. A batch is written under its number, so a repeated one replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select(*blocking.PAIR).distinct()
        (score(rows) if score else rows).write.mode("overwrite").parquet(f"{to}/batch={number}")

    candidates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
