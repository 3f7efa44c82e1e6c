"""End-to-end plans over tables of the entity format: train a matcher, predict matches, generate candidates, evaluate."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import blocking, evaluate, features, matcher, records, sampling
from lodestone.sources import shared, tables


def load_source(spark: SparkSession, path: str, number: int, max_rows: int | None = None) -> DataFrame:
    return tables.read_strict(spark, path, tables.SOURCE_COLUMNS, max_rows).withColumn("src", F.lit(number))


def load_sources(spark: SparkSession, paths: list[str], max_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Normalised (S1, noisy sources), each written once to the shared folder."""
    loaded = [load_source(spark, p, k + 1, max_rows) for k, p in enumerate(paths)]
    noisy = loaded[1]
    for more in loaded[2:]:
        noisy = noisy.unionByName(more)
    return shared.written(records.normalize_records(loaded[0], unicode=True), "s1"), shared.written(records.normalize_records(noisy, unicode=True), "noisy")


def labelled_candidates(s1: DataFrame, noisy: DataFrame, truth: DataFrame, top_k: int, most: int) -> DataFrame:
    """(s1_id, noisy_id, src, label) of the bounded candidates."""
    pairs = blocking.bounded_candidates(s1, noisy, top_k, most).select(*blocking.PAIR)
    marked = pairs.join(truth.select(*blocking.PAIR).distinct().withColumn("__t", F.lit(1)), blocking.PAIR, "left")
    return marked.join(noisy.select(F.col("entity_id").alias("noisy_id"), "src"), "noisy_id").select(*blocking.PAIR, "src", F.coalesce("__t", F.lit(0)).alias("label"))


def train(s1: DataFrame, noisy: DataFrame, truth: DataFrame, to: str, top_k: int = blocking.TOP_K, most: int = blocking.MAX_DF, negatives: int = 15, sample: int = 500_000, iterations: int = 100, seed: int = sampling.SEED) -> dict:
    """Fits a model, picks the threshold on the validation ids, saves both below ``to`` and returns the metadata.

    The candidates with their features are written once and read by the fit, the scores and the recall.
    """
    began = time.time()
    spark = s1.sparkSession
    pairs = labelled_candidates(s1, noisy, truth, top_k, most)
    path = f"{to}/candidates"
    vector = features.with_features(records.pair_columns(pairs, s1, noisy, features.RECORD)).select(*blocking.PAIR, "src", "label", *features.FEATURES)
    sampling.split(vector, "s1_id", seed=seed).write.mode("overwrite").parquet(path)
    table = spark.read.parquet(path)
    rows = sampling.hard_negatives(table.where("not is_validation"), negatives).withColumn("pair", F.concat_ws("|", *blocking.PAIR))
    model = matcher.fit_gbt(sampling.balanced(rows, "pair", sample, seed), iterations, seed=seed)
    ids = s1.select(F.col("entity_id").alias("s1_id"))
    held = sampling.split(ids, "s1_id", seed=seed).where("is_validation").select("s1_id")
    scored = matcher.score_gbt(table.where("is_validation"), model).select(*blocking.PAIR, "score")
    sweep = evaluate.threshold_sweep(held, scored, truth.join(held, "s1_id", "left_semi"))
    best = sweep.where("is_best").first()
    known = truth.join(ids, "s1_id", "left_semi")
    recall = evaluate.hits(known, table).agg(F.avg("hit")).first()[0]
    metadata = {"threshold": best["threshold"], "validation_f05": best["macro_f05"], "validation_precision": best["mean_precision"], "validation_recall": best["mean_recall"], "blocking_recall": recall or 0.0, "top_k": top_k, "max_df": most, "negatives": negatives, "seconds": round(time.time() - began, 1)}
    matcher.save(model, to, metadata)
    return metadata


def predict(s1: DataFrame, noisy: DataFrame, model_path: str, to: str, top_k: int = blocking.TOP_K, most: int = blocking.MAX_DF) -> tuple[str, str]:
    """Writes candidate and match lists, a row for every S1 id, and returns their paths; frequencies are those of this S1."""
    model, metadata = matcher.load(s1.sparkSession, model_path)
    pairs = blocking.bounded_candidates(s1, noisy, top_k, most).select(*blocking.PAIR)
    scored = features.with_features(records.pair_columns(pairs, s1, noisy, features.RECORD))
    path = f"{to}/scored"
    matcher.score_gbt(scored, model).select(*blocking.PAIR, "score").write.mode("overwrite").parquet(path)
    table = s1.sparkSession.read.parquet(path)
    ids = s1.select(F.col("entity_id").alias("s1_id"))
    candidates = tables.write_tsv(tables.grouped_lists(ids, table, "candidate_entity_ids"), f"{to}/candidate_pairs")
    matches = tables.write_tsv(tables.grouped_lists(ids, table.where(F.col("score") >= metadata["threshold"]), "matched_entity_ids"), f"{to}/matching_results")
    return candidates, matches


def generate_candidates(s1: DataFrame, noisy: DataFrame, to: str, union: str = "c_union_e", most: int = blocking.MAX_DF) -> str:
    """Candidate lists of a union of rules, a row for every S1 id."""
    ids = s1.select(F.col("entity_id").alias("s1_id"))
    return tables.write_tsv(tables.grouped_lists(ids, blocking.pairs_of(union, s1, noisy, most), "candidate_entity_ids"), to)


def score_files(spark: SparkSession, truth_path: str, predicted_path: str) -> dict:
    """Macro metrics of a match file against the truth; only ids of the truth file count."""
    truth = tables.read_matches(spark, truth_path)
    predicted = tables.read_matches(spark, predicted_path)
    per = evaluate.entity_prf(truth.select("s1_id"), tables.explode_matches(predicted), tables.explode_matches(truth))
    return evaluate.macro(per).first().asDict()
