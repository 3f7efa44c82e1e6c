"""Deterministic samples: every choice is by an md5 bucket of the id and a seed, so it doesn't depend on the order of rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.sources import shared

SEED = 1337
BUCKETS = 1 << 32


def bucket(key: Column, seed: int = SEED) -> Column:
    """0 to 2**32 - 1 from the first 8 hex digits of md5(key|seed)."""
    return F.conv(F.substr(F.md5(F.concat(key, F.lit(f"|{seed}"))), F.lit(1), F.lit(8)), 16, 10).cast("long")


def bernoulli(df: DataFrame, key: str, rate: float, seed: int = SEED) -> DataFrame:
    return df.where(bucket(F.col(key), seed) < F.lit(int(rate * BUCKETS)))


def sample_n(df: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    """n rows without replacement, those of the smallest buckets: a top-n, so each task keeps n rows at most."""
    return df.orderBy(bucket(F.col(key), seed), key).limit(n)


def split(df: DataFrame, key: str, validation: float = 0.2, seed: int = SEED) -> DataFrame:
    """Adds is_validation; all rows of a key go the same way."""
    return df.withColumn("is_validation", bucket(F.col(key), seed) >= F.lit(int((1 - validation) * BUCKETS)))


def hard_negatives(labelled: DataFrame, per_entity: int = 15) -> DataFrame:
    """All positives, and the first negatives of each S1 id in the order of source and noisy id."""
    order = Window.partitionBy("s1_id", "label").orderBy("src", "noisy_id")
    return labelled.withColumn("rank", F.row_number().over(order)).where((F.col("label") == 1) | (F.col("rank") <= per_entity)).drop("rank")


def balanced(df: DataFrame, key: str, most: int = 500_000, seed: int = SEED) -> DataFrame:
    """At most ``most`` rows, half of each label; what one label doesn't need the other gets."""
    counts = {r["label"]: r["n"] for r in df.groupBy("label").agg(F.count("*").alias("n")).collect()}
    half = most // 2
    ones = min(counts.get(1, 0), max(half, most - counts.get(0, 0)))
    zeros = min(counts.get(0, 0), most - ones)
    if ones == counts.get(1, 0) and zeros == counts.get(0, 0):
        return df
    wanted = {1: ones, 0: zeros}
    # a bucket below which more than enough rows are expected: only these are written and sorted
    below = {k: math.ceil(BUCKETS * (n + 8 * math.sqrt(n) + 64) / max(1, counts.get(k, 0))) for k, n in wanted.items()}
    digits = F.substr(F.md5(F.concat(F.col(key), F.lit(f"|{seed}"))), F.lit(1), F.lit(8))
    low = {k: F.col("label") == k if n >= counts.get(k, 0) or below[k] >= BUCKETS else (F.col("label") == k) & (digits < F.lit(f"{below[k]:08x}")) for k, n in wanted.items()}
    few = shared.written(df.where(low[1] | low[0]), "sample")
    got = {r["label"]: r["n"] for r in few.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if any(got.get(k, 0) < n for k, n in wanted.items()):
        few = df
    return sample_n(few.where("label = 1"), key, ones, seed).unionByName(sample_n(few.where("label = 0"), key, zeros, seed))


def capped(df: DataFrame, by: list[str], most: int, order: str = "entity_id") -> DataFrame:
    """The first ``most`` rows of each key in the order of ids."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("rank", nth).where(F.col("rank") <= most)


def controlled_negatives(pairs: DataFrame, s1: DataFrame, noisy: DataFrame, same: str, most: int, seed: int = SEED) -> DataFrame:
    """For each true pair another noisy record that agrees with the S1 record on ``same`` (nn, na or country) but isn't its
    match: of the first ``most`` of each key the one whose md5 bucket with the S1 id is smallest."""
    pool = capped(noisy.where(F.col(same) != ""), [same], most).select(F.col("entity_id").alias("noisy_id"), same)
    wanted = pairs.select("s1_id").distinct().join(s1.select(F.col("entity_id").alias("s1_id"), same), "s1_id")
    options = wanted.join(pool, same).select("s1_id", "noisy_id").join(pairs, ["s1_id", "noisy_id"], "left_anti")
    pick = F.row_number().over(Window.partitionBy("s1_id").orderBy(bucket(F.concat("s1_id", F.lit("|"), "noisy_id"), seed), "noisy_id"))
    return options.withColumn("n", pick).where("n = 1").select("s1_id", "noisy_id")
