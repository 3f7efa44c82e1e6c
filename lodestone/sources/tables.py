"""Reading and writing the tab-separated tables: strict, raw and list formats, reports and the experiment registry."""

from __future__ import annotations

import csv
import json
import os
import re
import shutil
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

SOURCE_COLUMNS = ["entity_id", "business_name", "business_address", "country"]
TRUTH_COLUMNS = ["source1_entity_id", "matched_entity_ids"]
#: Columns of the experiment registry (fixed values).
EXPERIMENT_COLUMNS = ["experiment_id", "timestamp_utc", "git_commit", "blocking_strategy", "matcher", "model_params", "feature_set", "decision_threshold", "validation_split", "validation_f05", "validation_precision", "validation_recall", "singleton_accuracy", "candidate_mean", "candidate_median", "candidate_p95", "candidate_p99", "candidate_max", "public_lb_score", "leaderboard_rank", "submission_day", "submission_number", "change_summary", "result", "notes"]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a session of several machines must name it in spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def header_of(spark: SparkSession, path: str) -> list[str]:
    rows = spark.read.text(path).where("value <> ''").limit(1).collect()
    if not rows:
        return []
    return [c.strip().strip('"') for c in rows[0][0].lstrip("﻿").rstrip("\r").split("\t")]


def read_strict(spark: SparkSession, path: str, columns: list[str], max_rows: int | None = None) -> DataFrame:
    """The named columns of a quoted TSV with a header, in any order; '' for missing text.

    A missing column raises KeyError; a row with more or fewer fields than the header fails the query, whichever columns
    are used, as column pruning in the parser is off.
    """
    header = header_of(spark, path)
    if missing := [c for c in columns if c not in header]:
        raise KeyError(f"{path}: no column {', '.join(missing)}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    rows = spark.read.schema(schema).option("mode", "FAILFAST").option("columnPruning", "false").csv(path, sep="\t", header=True, quote='"', escape='"')
    out = rows.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns])
    return out if max_rows is None else out.limit(max_rows)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Physical lines without quoting: value, fields."""
    value = F.regexp_replace("value", r"\r$", "")
    return spark.read.text(path).select(value.alias("value")).withColumn("fields", F.split("value", "\t"))


def read_lenient(spark: SparkSession, path: str, columns: list[str] = SOURCE_COLUMNS, key: str = "entity_id") -> DataFrame:
    """Rows of the header's number of fields and a key; others are skipped; a column that isn't there is ''."""
    header = header_of(spark, path)
    whole = "\t".join(header)
    rows = read_raw(spark, path).where((F.col("value") != "") & (F.regexp_replace("value", "^﻿", "") != whole) & (F.size("fields") == len(header)))
    out = rows.select(*[(F.get("fields", F.lit(header.index(c))) if c in header else F.lit("")).alias(c) for c in columns])
    return out.where(F.col(key) != "")


def list_column(c: Column) -> Column:
    """A comma list as a set: trimmed, without empty parts."""
    return F.array_distinct(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != ""))


def truth_columns(header: list[str]) -> tuple[str, str]:
    """(id, list) columns: by name, else by parts of names; a list column is never the id column."""
    low = [h.strip().lower() for h in header]
    lists = [k for k, h in enumerate(low) if "match" in h or "candidate" in h]
    ids = [k for k, h in enumerate(low) if h == "source1_entity_id"] or [k for k, h in enumerate(low) if k not in lists and ("source1" in h or "s1" in h)] or [k for k, h in enumerate(low) if k not in lists and "entity_id" in h]
    if not ids:
        raise KeyError(f"no id column in {header}")
    rest = [k for k in lists if k != ids[0]] or [k for k in range(len(header)) if k != ids[0]]
    if not rest:
        raise KeyError(f"no list column in {header}")
    return header[ids[0]], header[rest[0]]


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """(s1_id, ids): list columns as sets; of a repeated id the last line counts."""
    header = header_of(spark, path)
    one, many = truth_columns(header)
    rows = read_raw(spark, path).withColumn("__line", F.monotonically_increasing_id())
    rows = rows.where((F.col("value") != "") & (F.col("value") != "\t".join(header)))
    get = lambda c: F.coalesce(F.get("fields", F.lit(header.index(c))), F.lit(""))
    rows = rows.select(F.trim(get(one)).alias("s1_id"), list_column(get(many)).alias("ids"), "__line").where("s1_id <> ''")
    last = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("__line")))
    return rows.withColumn("__n", last).where("__n = 1").select("s1_id", "ids")


def explode_matches(lists: DataFrame, ids: str = "ids") -> DataFrame:
    return lists.select("s1_id", F.explode(ids).alias("noisy_id"))


def grouped_lists(s1_ids: DataFrame, pairs: DataFrame, output: str) -> DataFrame:
    """One row for every S1 id: its ids sorted and comma-joined, '' for none."""
    joined = pairs.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("noisy_id")), ",").alias(output))
    return s1_ids.select("s1_id").join(joined, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(output, F.lit("")).alias(output))


def write_tsv(df: DataFrame, path: str, single: bool = False, quoted: bool = False) -> str:
    out = df.coalesce(1) if single else df
    quotes = {"quote": '"', "escape": '"', "emptyValue": ""} if quoted else {"quote": "", "emptyValue": ""}
    out.write.mode("overwrite").csv(path, sep="\t", header=True, nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **quotes)
    return path


def write_report(path: str, report: dict, title: str) -> None:
    """A report of small aggregates as JSON and as Markdown, by the driver."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(f"{path}.json", "w", encoding="utf-8") as f:
        json.dump(report, f, indent=2, ensure_ascii=False, default=str)
    lines = [f"# {title}", ""]
    for section, body in report.items():
        lines += [f"## {section}", ""]
        rows = body if isinstance(body, list) else [body]
        if rows and isinstance(rows[0], dict):
            names = list(rows[0])
            lines += ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
            lines += ["| " + " | ".join(str(r.get(n)) for n in names) + " |" for r in rows]
        else:
            lines += [f"- {r}" for r in rows]
        lines.append("")
    with open(f"{path}.md", "w", encoding="utf-8") as f:
        f.write("\n".join(lines))


def rows_of(df: DataFrame, most: int = 1000) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.limit(most).collect()]


def append_experiments(existing: DataFrame, new: DataFrame, now: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(registry with the new rows, rejected rows): an experiment id that is there already, or comes twice, is rejected."""
    stamp = now or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    have = {c.lower() for c in new.columns}
    rows = new.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")).alias(c) for c in EXPERIMENT_COLUMNS])
    rows = rows.withColumn("timestamp_utc", F.when(F.col("timestamp_utc") == "", stamp).otherwise(F.col("timestamp_utc")))
    nth = F.row_number().over(Window.partitionBy("experiment_id").orderBy(*EXPERIMENT_COLUMNS))
    known = existing.select("experiment_id").distinct().withColumn("__known", F.lit(True))
    judged = rows.withColumn("__nth", nth).join(known, "experiment_id", "left")
    ok = F.col("__known").isNull() & (F.col("__nth") == 1) & (F.col("experiment_id") != "")
    return existing.select(*EXPERIMENT_COLUMNS).unionByName(judged.where(ok).select(*EXPERIMENT_COLUMNS)), judged.where(~ok).select(*EXPERIMENT_COLUMNS)


def log_experiment(path: str, row: dict[str, str], now: str | None = None) -> bool:
    """Appends one row to a registry file, with a header if it is new; False if its id is empty or there already."""
    known: set[str] = set()
    fresh = not os.path.exists(path) or os.path.getsize(path) == 0
    if not fresh:
        with open(path, newline="", encoding="utf-8") as f:
            known = {r["experiment_id"] for r in csv.DictReader(f)}
    if not row.get("experiment_id") or row["experiment_id"] in known:
        return False
    stamp = row.get("timestamp_utc") or now or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    with open(path, "a", newline="", encoding="utf-8") as f:
        out = csv.DictWriter(f, EXPERIMENT_COLUMNS)
        if fresh:
            out.writeheader()
        out.writerow({c: row.get(c) or "" for c in EXPERIMENT_COLUMNS} | {"timestamp_utc": stamp})
    return True


def find_tables(root: str, names: list[str] | None = None, skip: tuple[str, ...] = (".git", "__pycache__", "venv", ".venv", "node_modules")) -> list[str]:
    """TSV files below a folder, sorted; with names, the first hit of each."""
    found = []
    for folder, folders, files in os.walk(root):
        folders[:] = sorted(d for d in folders if d not in skip)
        found += [os.path.join(folder, f) for f in sorted(files) if f.endswith(".tsv")]
    if names is None:
        return sorted(found)
    return [next(f for f in found if os.path.basename(f) == n) for n in names if any(os.path.basename(f) == n for f in found)]


def require_disk(path: str, free_bytes: int) -> None:
    if shutil.disk_usage(path).free < free_bytes:
        raise OSError(f"{path}: less than {free_bytes} bytes free")
