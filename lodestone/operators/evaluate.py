"""Evaluation: per-entity and macro F0.5, recall of blocking, distribution summaries, threshold sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The thresholds of the sweep: 0.10 to 0.90 by 0.02.
GRID = [round(0.1 + 0.02 * k, 2) for k in range(41)]


def _d(x) -> Column:
    return F.lit(float(x))


def prf_columns(tp: Column, predicted: Column, true: Column) -> dict[str, Column]:
    """Precision, recall and F0.5 of an entity. One without true matches: 1, 1, 1 if nothing is predicted, else 0, 1, 0."""
    p = F.when(predicted > 0, tp / F.when(predicted > 0, predicted)).otherwise(_d(0))
    r = F.when(true > 0, tp / F.when(true > 0, true)).otherwise(_d(0))
    bottom = 0.25 * p + r
    f = F.when(bottom > 0, 1.25 * p * r / F.when(bottom > 0, bottom)).otherwise(_d(0))
    single = true == 0
    return {"precision": F.when(single, F.when(predicted == 0, _d(1)).otherwise(_d(0))).otherwise(p), "recall": F.when(single, _d(1)).otherwise(r), "f05": F.when(single, F.when(predicted == 0, _d(1)).otherwise(_d(0))).otherwise(f)}


def entity_prf(s1_ids: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row for each S1 id: tp, n_predicted, n_true, precision, recall, f05; pairs of other ids are ignored."""
    both = predicted.select("s1_id", "noisy_id").distinct().withColumn("p", F.lit(1)).join(truth.select("s1_id", "noisy_id").distinct().withColumn("t", F.lit(1)), ["s1_id", "noisy_id"], "full")
    counts = both.groupBy("s1_id").agg(F.sum(F.when(F.col("p").isNotNull() & F.col("t").isNotNull(), 1).otherwise(0)).alias("tp"), F.count("p").alias("n_predicted"), F.count("t").alias("n_true"))
    out = s1_ids.select("s1_id").distinct().join(counts, "s1_id", "left").na.fill(0, ["tp", "n_predicted", "n_true"])
    return out.withColumns(prf_columns(F.col("tp"), F.col("n_predicted"), F.col("n_true")))


def macro(per_entity: DataFrame) -> DataFrame:
    """One row: macro_f05, mean_precision, mean_recall, singleton_accuracy (1 without singletons), n; all 0 without entities."""
    single = F.col("n_true") == 0
    some = F.count("*") > 0
    accuracy = F.coalesce(F.avg(F.when(single, F.when(F.col("n_predicted") == 0, _d(1)).otherwise(_d(0)))), F.when(some, _d(1)).otherwise(_d(0)))
    return per_entity.agg(*[F.coalesce(F.avg(c), _d(0)).alias(n) for c, n in (("f05", "macro_f05"), ("precision", "mean_precision"), ("recall", "mean_recall"))], accuracy.alias("singleton_accuracy"), F.count("*").alias("n"))


def threshold_sweep(s1_ids: DataFrame, scored: DataFrame, truth: DataFrame, grid: list[float] = GRID, score: str = "score") -> DataFrame:
    """Macro F0.5 at each threshold, from one pass over the scored pairs; is_best marks the first of the best."""
    n_true = truth.groupBy("s1_id").agg(F.count("*").alias("n_true"))
    hit = scored.join(truth.withColumn("t", F.lit(1)), ["s1_id", "noisy_id"], "left")
    # level 0 isn't filtered out: the filter would go below the join and compute the score once for each threshold
    level = sum(((F.col(score) >= t).cast("int") for t in grid), F.lit(0))
    by_level = hit.select("s1_id", level.alias("level"), F.col("t").isNotNull().cast("int").alias("hit")).groupBy("s1_id", "level").agg(F.count("*").alias("n"), F.sum("hit").alias("tp"))
    lists = by_level.groupBy("s1_id").agg(F.collect_list(F.struct("level", "n", "tp")).alias("levels"))  # one entry a threshold at most
    entities = s1_ids.select("s1_id").join(n_true, "s1_id", "left").join(lists, "s1_id", "left")
    steps = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(k + 1).alias("k")) for k, t in enumerate(grid)]))
    each = entities.select("s1_id", F.coalesce("n_true", F.lit(0)).alias("n_true"), "levels", steps.alias("x"))
    total = lambda f: F.coalesce(F.aggregate(F.filter("levels", lambda v: v["level"] >= F.col("x.k")), F.lit(0).cast("long"), lambda s, v: s + v[f]), F.lit(0))
    each = each.select("n_true", F.col("x.threshold").alias("threshold"), total("n").alias("n_predicted"), total("tp").alias("tp"))
    each = each.withColumns(prf_columns(F.col("tp"), F.col("n_predicted"), F.col("n_true")))
    out = each.groupBy("threshold").agg(F.avg("f05").alias("macro_f05"), F.avg("precision").alias("mean_precision"), F.avg("recall").alias("mean_recall"))
    best = F.row_number().over(Window.orderBy(F.desc(F.round("macro_f05", 12)), "threshold")) == 1  # a row a threshold
    return out.withColumn("is_best", best)


def summary(value: Column, percentiles: tuple[int, ...] = (90, 95, 99)) -> list[Column]:
    """count, min, median, mean, percentiles (linear interpolation) and max."""
    return [F.count(value).alias("count"), F.min(value).cast("double").alias("min"), F.percentile(value, F.lit(0.5)).alias("median"), F.avg(value).alias("mean"), *[F.percentile(value, F.lit(p / 100)).alias(f"p{p}") for p in percentiles], F.max(value).cast("double").alias("max")]


def histogram_percentiles(df: DataFrame, value: str, percentiles: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Nearest rank upwards from a histogram: the smallest value v with (rows up to v) - 1 >= (n - 1) p."""
    counts = df.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("rows"))
    upto = F.sum("rows").over(Window.orderBy("value"))  # a row a distinct value
    totals = counts.select("value", upto.alias("upto"), F.sum("rows").over(Window.partitionBy()).alias("n"))
    return totals.agg(*[F.min(F.when(F.col("upto") - 1 >= (F.col("n") - 1) * F.lit(p / 100), F.col("value"))).alias(f"p{p}") for p in percentiles])


def candidate_counts(ids: DataFrame, pairs: DataFrame, key: str = "s1_id") -> DataFrame:
    """Candidates of each id, zeros included."""
    counts = pairs.groupBy(key).agg(F.count("*").alias("n"))
    return ids.select(key).join(counts, key, "left").na.fill(0, ["n"])


def hits(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """Truth pairs with hit 0 or 1."""
    return truth.join(pairs.select("s1_id", "noisy_id").withColumn("__hit", F.lit(1)), ["s1_id", "noisy_id"], "left").select("s1_id", "noisy_id", F.coalesce("__hit", F.lit(0)).alias("hit"))


def entity_recall(s1_ids: DataFrame, truth: DataFrame, pairs: DataFrame, with_singletons: bool = False) -> DataFrame:
    """One row: entities, those with all matches retrieved, and their share."""
    per = hits(truth, pairs).groupBy("s1_id").agg(F.min("hit").alias("all_hit"))
    every = s1_ids.select("s1_id").join(per, "s1_id", "left").select(F.coalesce("all_hit", F.lit(1)).alias("all_hit")) if with_singletons else per
    return every.agg(F.count("*").alias("entities"), F.sum("all_hit").cast("long").alias("all_retrieved"), F.avg("all_hit").alias("rate"))
