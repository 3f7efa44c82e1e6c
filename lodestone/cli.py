"""python -m lodestone.cli COMMAND ...: the plans on files of the entity format."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from lodestone.operators import blocking, quality
from lodestone.plans import matching, reports
from lodestone.sources import tables


def session() -> SparkSession:
    return SparkSession.builder.appName("lodestone").config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: str, options: dict | None = None) -> None:
        c = sub.add_parser(name)
        for a in arguments:
            c.add_argument(a, nargs="+" if a.endswith("s") else None)
        for k, v in (options or {}).items():
            c.add_argument(f"--{k}", type=type(v) if v is not None else str, default=v)

    three = ("s1", "s2", "s3")
    command("audit", "files", options={"to": "reports/audit"})
    command("profile", *three, options={"to": "reports/profile"})
    command("analyze", *three, "truth", options={"to": "reports/pairs", "sample": 200_000})
    command("benchmark", *three, "truth", options={"to": "reports/blocking", "rules": "a,c,g,a_union_g,ag_e_rare", "sample": 20_000, "max-df": blocking.MAX_DF})
    command("candidates", *three, options={"to": "output/candidates", "union": "c_union_e", "max-df": blocking.MAX_DF})
    command("train", *three, "truth", options={"to": "models/v1", "top-k": blocking.TOP_K, "max-df": blocking.MAX_DF, "negatives": 15, "sample": 500_000, "iterations": 100, "seed": 1337, "max-rows": 0})
    command("predict", *three, "model", options={"to": "output", "top-k": blocking.TOP_K, "max-df": blocking.MAX_DF})
    command("evaluate", "truth", "predicted")
    command("log", "registry", options={c: "" for c in tables.EXPERIMENT_COLUMNS})
    command("validate", "matches_file", "s1", options={"candidates": None})
    return p


def validate(spark: SparkSession, path: str, s1: str, candidates: str | None) -> int:
    """Prints errors and warnings of a match file; 1 if there are errors."""
    header = "\t".join(tables.header_of(spark, path))
    errors = quality.validate_header(header, [c.lower() for c in tables.TRUTH_COLUMNS])
    body = lambda p: tables.read_raw(spark, p).where(f"value <> '{chr(9).join(tables.header_of(spark, p))}'")
    if not errors:
        raw = body(path)
        need = tables.read_strict(spark, s1, ["entity_id"]).withColumnRenamed("entity_id", "s1_id")
        counts = quality.validate_rows(raw).first()
        if counts["malformed"]:
            errors.append(f"{counts['malformed']} lines without a tab")
        for what, frame in (("repeated rows", quality.validate_repeats(raw)), ("repeated ids in a list", quality.validate_inner_repeats(raw)), ("wrong ids", quality.validate_ids(raw)), ("ids missing or extra", quality.validate_coverage(raw, need))):
            some = frame.limit(5).collect()
            if some:
                errors.append(f"{what}: {[tuple(r) for r in some]}")
        if candidates and (some := quality.validate_subset(raw, body(candidates)).limit(5).collect()):
            print("warning: matches that aren't candidates:", [tuple(r) for r in some])
    print("\n".join(errors) or "valid")
    return int(bool(errors))


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "log":
        done = tables.log_experiment(a.registry, {c: getattr(a, c) for c in tables.EXPERIMENT_COLUMNS})
        print("logged" if done else "the experiment id is missing or there already")
        return int(not done)
    spark = session()
    paths = [getattr(a, k) for k in ("s1", "s2", "s3") if hasattr(a, k)]
    if a.command == "audit":
        reports.audit(spark, a.files, a.to)
    elif a.command == "evaluate":
        print(json.dumps(matching.score_files(spark, a.truth, a.predicted)))
    elif a.command == "validate":
        return validate(spark, a.matches_file, a.s1, a.candidates)
    elif a.command == "profile":
        sources = matching.load_source(spark, paths[0], 1)
        for k, p in enumerate(paths[1:], 2):
            sources = sources.unionByName(matching.load_source(spark, p, k))
        reports.profile(sources, a.to)
    else:
        s1, noisy = matching.load_sources(spark, paths, getattr(a, "max_rows", 0) or None)
        truth = tables.explode_matches(tables.read_matches(spark, a.truth)) if hasattr(a, "truth") else None
        if a.command == "analyze":
            reports.pair_analysis(s1, noisy, truth, a.to, a.sample)
        elif a.command == "benchmark":
            reports.blocking_benchmark(s1, noisy, truth, a.to, a.rules.split(","), a.sample, a.max_df)
        elif a.command == "candidates":
            matching.generate_candidates(s1, noisy, a.to, a.union, a.max_df)
        elif a.command == "train":
            print(json.dumps(matching.train(s1, noisy, truth, a.to, a.top_k, a.max_df, a.negatives, a.sample, a.iterations, a.seed)))
        elif a.command == "predict":
            matching.predict(s1, noisy, a.model, a.to, a.top_k, a.max_df)
    return 0


if __name__ == "__main__":
    sys.exit(main())
