"""Reports: small aggregates of the operators, collected by the driver and written as JSON and Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import analysis, blocking, evaluate, features, quality, records, sampling
from lodestone.sources import tables


def audit(spark: SparkSession, paths: list[str], to: str) -> dict:
    report = {}
    for path in paths:
        header = tables.header_of(spark, path)
        raw = tables.read_raw(spark, path)
        report[path] = [{"header": header, "missing": [c for c in tables.SOURCE_COLUMNS if c not in header], **quality.audit_lines(raw, header).first().asDict()}]
        report[f"{path}: malformed"] = tables.rows_of(quality.malformed_examples(raw, header))
    tables.write_report(to, report, "File audit")
    return report


def profile(sources: DataFrame, to: str) -> dict:
    """sources: records with src."""
    report = {"columns": tables.rows_of(quality.profile(sources)), "ids": tables.rows_of(quality.id_profile(sources, F.concat(F.lit("S"), "src", F.lit("-")))), "duplicates": tables.rows_of(quality.duplicates(sources)), "countries": tables.rows_of(sources.groupBy("src", "country").agg(F.count("*").alias("n")).orderBy("src", F.desc("n"), "country"))}
    findings = {"confirmed": [], "review": []}
    for r in report["ids"]:
        findings["confirmed" if not (r["repeated_ids"] or r["prefix_violations"]) else "review"].append(f"source {r['src']}: {r['repeated_ids']} repeated ids, {r['prefix_violations']} prefix violations")
    report |= {"findings confirmed": findings["confirmed"], "findings to review": findings["review"]}
    tables.write_report(to, report, "Column profile")
    return report


def pair_analysis(s1: DataFrame, noisy: DataFrame, truth: DataFrame, to: str, sample: int = 200_000) -> dict:
    ids = s1.select(F.col("entity_id").alias("s1_id"))
    some = sampling.sample_n(truth.withColumn("pair", F.concat_ws("|", *blocking.PAIR)), "pair", sample).select(*blocking.PAIR)
    metrics = features.with_metrics(records.pair_columns(some, s1, noisy, features.RECORD))
    report = {"structure": tables.rows_of(analysis.truth_structure(ids, truth)), "histogram": tables.rows_of(analysis.match_count_histogram(ids, truth).orderBy("matches")), "integrity": tables.rows_of(analysis.referential_integrity(truth, s1, noisy))}
    for c in ("name_levenshtein_sim", "addr_levenshtein_sim", "name_jaccard", "addr_jaccard"):
        report[c] = tables.rows_of(metrics.agg(*evaluate.summary(F.col(c))))
    report["evidence"] = tables.rows_of(metrics.groupBy(features.evidence_bucket().alias("bucket")).agg(F.count("*").alias("pairs")).orderBy(F.desc("pairs"), "bucket"))
    report["singletons"] = tables.rows_of(analysis.singleton_diagnostics(s1, noisy, truth))
    report["ambiguity"] = tables.rows_of(analysis.positive_ambiguity(truth, noisy))
    tables.write_report(to, report, "Analysis of true pairs")
    return report


def blocking_benchmark(s1: DataFrame, noisy: DataFrame, truth: DataFrame, to: str, names: list[str], sample: int = 20_000, most: int = blocking.MAX_DF) -> dict:
    """Recall, volume and reduction ratio of rules and unions for a sample of S1 records against all noisy ones."""
    some = sampling.sample_n(s1, "entity_id", sample)
    ids = some.select(F.col("entity_id").alias("s1_id"))
    known = truth.join(ids, "s1_id", "left_semi")
    n, corpus = ids.count(), noisy.count()
    report = {}
    for name in names:
        pairs = blocking.pairs_of(name, some, noisy, most)
        one = evaluate.hits(known, pairs).agg(F.count("*").alias("truth"), F.sum("hit").alias("hits"), F.avg("hit").alias("recall")).first().asDict()
        volume = evaluate.candidate_counts(ids, pairs).agg(F.sum("n").alias("pairs"), *evaluate.summary(F.col("n"))).first().asDict()
        report[name] = [one | volume | {"reduction_ratio": 1 - volume["mean"] / corpus if corpus and n else None} | evaluate.entity_recall(ids, known, pairs).first().asDict()]
    tables.write_report(to, report, "Blocking benchmark")
    return report
