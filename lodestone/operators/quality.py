"""Audit, profile and validation of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"^\s+$"


def audit_lines(raw: DataFrame, header: list[str]) -> DataFrame:
    """One row of counts of a raw file (sources.read_raw): lines, blank, repeated headers, data rows, malformed data rows.

    Malformed rows are data rows too, as are all lines that are neither blank nor the header.
    """
    whole = "\t".join(header)
    is_head, blank = F.col("value") == whole, F.col("value") == ""
    data = ~is_head & ~blank
    return raw.agg(F.count("*").alias("lines"), F.count_if(blank).alias("blank_rows"), F.greatest(F.lit(0), F.count_if(is_head) - 1).alias("duplicate_headers"), F.count_if(data).alias("data_rows"), F.count_if(data & (F.size("fields") != len(header))).alias("malformed_rows"))


def malformed_examples(raw: DataFrame, header: list[str], most: int = 200, preview: int = 200) -> DataFrame:
    """The first malformed rows: fields and a preview with tabs written out."""
    whole = "\t".join(header)
    shown = F.replace("value", F.lit("\t"), F.lit("<TAB>"))
    bad = raw.where((F.col("value") != "") & (F.col("value") != whole) & (F.size("fields") != len(header)))
    return bad.select(F.lit(len(header)).alias("expected_fields"), F.size("fields").alias("actual_fields"), F.when(F.length(shown) > preview, F.concat(F.substring(shown, 1, preview), F.lit("..."))).otherwise(shown).alias("preview")).orderBy("preview").limit(most)


def profile(records: DataFrame) -> DataFrame:
    """One row a source: rows, empty and blank values, lengths, characters beyond ASCII, white space at ends."""
    name, address = F.col("business_name"), F.col("business_address")
    n = lambda c: F.count_if(c)
    aggregates = [F.count("*").alias("rows")]
    for label, c in (("id", F.col("entity_id")), ("name", name), ("address", address), ("country", F.col("country"))):
        aggregates += [n(c == "").alias(f"{label}_empty"), n(c.rlike(WHITE)).alias(f"{label}_blank")]
    for label, c in (("name", name), ("address", address)):
        aggregates += [F.min(F.length(c)).alias(f"{label}_min"), F.max(F.length(c)).alias(f"{label}_max"), F.avg(F.length(c)).alias(f"{label}_mean"), n(c.rlike(r"[^\x00-\x7F]")).alias(f"{label}_non_ascii"), n(c.rlike(r"^\s|\s$")).alias(f"{label}_outer_space")]
    return records.groupBy("src").agg(*aggregates)


def id_profile(records: DataFrame, prefix: Column) -> DataFrame:
    """One row a source: unique ids, ids that repeat, rows beyond the first of an id, prefix violations."""
    per = records.where("entity_id <> ''").groupBy("src", "entity_id").agg(F.count("*").alias("c"), F.first(prefix).alias("p"))
    return per.groupBy("src").agg(F.count("*").alias("unique_ids"), F.count_if(F.col("c") > 1).alias("repeated_ids"), F.sum(F.col("c") - 1).alias("extra_rows"), F.sum(F.when(~F.col("entity_id").startswith(F.col("p")), F.col("c")).otherwise(0)).alias("prefix_violations"))


def duplicates(records: DataFrame) -> DataFrame:
    """For name, address and both: values that repeat within a source, and rows beyond the first of a value."""
    out = None
    for label, columns in (("name", ["business_name"]), ("address", ["business_address"]), ("name_address", ["business_name", "business_address"])):
        some = records
        for c in columns:
            some = some.where(F.col(c) != "")
        per = some.groupBy("src", *columns).agg(F.count("*").alias("c")).where("c > 1")
        one = per.groupBy("src").agg(F.count("*").alias("repeated_values"), F.sum(F.col("c") - 1).alias("extra_rows")).select("src", F.lit(label).alias("kind"), "repeated_values", "extra_rows")
        out = one if out is None else out.unionByName(one)
    return out


def submission_rows(raw: DataFrame) -> DataFrame:
    """(s1, rest) of lines with a tab; ids as they stand, not trimmed."""
    at = F.instr("value", "\t")
    return raw.where(at > 0).select(F.substring_index("value", "\t", 1).alias("s1"), F.expr("substring(value, instr(value, '\t') + 1)").alias("rest"))


def id_lists(rows: DataFrame) -> DataFrame:
    return rows.select("s1", F.when(F.trim("rest") == "", F.array().cast("array<string>")).otherwise(F.split("rest", ",")).alias("ids"))


def validate_rows(raw: DataFrame) -> DataFrame:
    """One row: rows, empty and filled lists, malformed lines (no tab, not blank)."""
    lists = id_lists(submission_rows(raw)).agg(F.count("*").alias("rows"), F.count_if(F.size("ids") == 0).alias("empty"), F.count_if(F.size("ids") > 0).alias("non_empty"))
    bad = raw.agg(F.count_if((F.instr("value", "\t") == 0) & (F.trim("value") != "")).alias("malformed"))
    return lists.crossJoin(bad)  # one row each


def validate_repeats(raw: DataFrame) -> DataFrame:
    return submission_rows(raw).groupBy("s1").agg(F.count("*").alias("n")).where("n > 1")


def validate_inner_repeats(raw: DataFrame) -> DataFrame:
    return id_lists(submission_rows(raw)).where(F.size("ids") != F.size(F.array_distinct("ids"))).select("s1").distinct()


def validate_ids(raw: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(kind, id) of offending ids: self (S1-), prefix (neither S2- nor S3-), else unknown; known: frame of noisy_id."""
    ids = id_lists(submission_rows(raw)).select(F.explode("ids").alias("id")).distinct()
    marked = ids.withColumn("known", F.lit(True)) if known is None else ids.join(known.select(F.col("noisy_id").alias("id"), F.lit(True).alias("known")).distinct(), "id", "left")
    kind = F.when(F.col("id").startswith("S1-"), "self").when(~(F.col("id").startswith("S2-") | F.col("id").startswith("S3-")), "prefix").when(F.col("known").isNull(), "unknown")
    return marked.select(kind.alias("kind"), "id").where("kind is not null")


def validate_coverage(raw: DataFrame, required: DataFrame) -> DataFrame:
    """(kind, id): S1 ids that are missing from the file, and extra ones."""
    seen = submission_rows(raw).select(F.col("s1").alias("id")).distinct()
    need = required.select(F.col("s1_id").alias("id")).distinct()
    return need.join(seen, "id", "left_anti").select(F.lit("missing").alias("kind"), "id").unionByName(seen.join(need, "id", "left_anti").select(F.lit("extra").alias("kind"), "id"))


def validate_subset(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matches that aren't candidates; a warning only."""
    pairs = lambda raw: id_lists(submission_rows(raw)).select("s1", F.explode("ids").alias("id"))
    return pairs(matches).join(pairs(candidates), ["s1", "id"], "left_anti").distinct()


def validate_header(header_line: str, expected: list[str]) -> list[str]:
    """Errors of a header line: empty, comma-separated, or not the expected columns (case and outer space don't matter)."""
    if not header_line.strip():
        return ["the file is empty"]
    if "\t" not in header_line and "," in header_line:
        return ["the header is separated by commas, not tabs"]
    have = [c.strip().lower() for c in header_line.lstrip("﻿").rstrip("\r\n").split("\t")]
    return [] if have == expected else [f"unexpected header {have}, not {expected}"]
