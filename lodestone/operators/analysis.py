"""Analyses of ground truth, corpora and blocking keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import blocking


def id_class(column: str):
    return F.when(F.col(column).startswith("S2-"), "S2").when(F.col(column).startswith("S3-"), "S3").otherwise("other")


def truth_structure(s1_ids: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: entities, singletons, pairs, and entities whose matches are in S2 only, S3 only or both."""
    per = truth.groupBy("s1_id").agg(F.count("*").alias("n"), F.max(F.col("noisy_id").startswith("S2-")).alias("in2"), F.max(F.col("noisy_id").startswith("S3-")).alias("in3"))
    every = s1_ids.select("s1_id").join(per, "s1_id", "left")
    return every.agg(F.count("*").alias("entities"), F.count_if(F.col("n").isNull()).alias("singletons"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.count_if(F.col("in2") & ~F.col("in3")).alias("s2_only"), F.count_if(F.col("in3") & ~F.col("in2")).alias("s3_only"), F.count_if(F.col("in2") & F.col("in3")).alias("both"))


def match_count_histogram(s1_ids: DataFrame, truth: DataFrame) -> DataFrame:
    per = truth.groupBy("s1_id").agg(F.count("*").alias("matches"))
    return s1_ids.select("s1_id").join(per, "s1_id", "left").groupBy(F.coalesce("matches", F.lit(0)).alias("matches")).agg(F.count("*").alias("entities"))


def referential_integrity(truth: DataFrame, s1: DataFrame, noisy: DataFrame) -> DataFrame:
    """One row: truth ids that aren't in S1, matched ids that are in neither noisy source, matched ids that are S1 ids."""
    ids = s1.select(F.col("entity_id").alias("id"))
    others = noisy.select(F.col("entity_id").alias("id"))
    left = truth.select(F.col("s1_id").alias("id")).distinct()
    right = truth.select(F.col("noisy_id").alias("id")).distinct()
    parts = {"unknown_s1": left.join(ids, "id", "left_anti"), "unknown_matches": right.join(others, "id", "left_anti"), "self_matches": right.join(ids, "id", "left_semi")}
    rows = None
    for name, part in parts.items():
        one = part.select(F.lit(name).alias("kind"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.agg(*[F.count_if(F.col("kind") == n).alias(n) for n in parts])


#: Keys whose frequencies are counted, by rule.
FREQUENCY_KEYS = {"name": ["nn"], "address": ["na"], "first_token": ["tok1"], "country_token": ["country", "tok1"]}


def corpus_frequencies(records: DataFrame) -> DataFrame:
    """(src, kind, key, n) of normalised names, addresses, first tokens and country with first token; not of empty ones."""
    kinds = [F.struct(F.lit(k).alias("kind"), (F.col(c[0]) if len(c) == 1 else F.when(F.col(c[1]) != "", F.concat_ws("|", *c)).otherwise("")).alias("key")) for k, c in FREQUENCY_KEYS.items()]
    return records.select("src", F.explode(F.array(*kinds)).alias("x")).where("x.key <> ''").groupBy("src", "x.kind", "x.key").agg(F.count("*").alias("n"))


def key_frequencies(s1: DataFrame, noisy: DataFrame) -> DataFrame:
    """(rule, key, n): noisy rows of each key of rules A, B, C, D, F and G that some S1 record has."""
    key = lambda columns: F.when(sum((F.col(c).isNull() | (F.col(c) == "")).cast("int") for c in columns) == 0, F.concat_ws("|", *columns))
    table = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), key(c).alias("key")) for r, c in blocking.KEYS.items()])).alias("x")).select("x.rule", "x.key").where("key is not null")
    return table(noisy).join(table(s1).distinct(), ["rule", "key"], "left_semi").groupBy("rule", "key").agg(F.count("*").alias("n"))


def posting_stats(s1: DataFrame) -> DataFrame:
    """Distinct keys and postings of the C and E indexes of S1."""
    c = s1.where("country <> '' and tok1 <> ''").select(F.lit("c").alias("rule"), F.concat_ws("|", "country", "tok1").alias("key"))
    e = s1.select(F.lit("e").alias("rule"), F.explode("at").alias("key"))
    return c.unionByName(e).groupBy("rule").agg(F.count_distinct("key").alias("keys"), F.count("*").alias("postings"))


def singleton_diagnostics(s1: DataFrame, noisy: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: singletons, and those whose name or address stands in a noisy source too."""
    single = s1.join(truth.select(F.col("s1_id").alias("entity_id")), "entity_id", "left_anti")
    has = lambda c, n: noisy.where(F.col(c) != "").select(c).distinct().withColumn(n, F.lit(1))
    marked = single.join(has("nn", "by_name"), "nn", "left").join(has("na", "by_address"), "na", "left")
    return marked.agg(F.count("*").alias("singletons"), F.count("by_name").alias("name_elsewhere"), F.count("by_address").alias("address_elsewhere"))


def positive_ambiguity(truth: DataFrame, noisy: DataFrame) -> DataFrame:
    """One row: true pairs, those whose name or address is not unique in its source, repeated (source, name, address)."""
    freq = lambda c, n: noisy.where(F.col(c) != "").groupBy("src", c).agg(F.count("*").alias(n))
    pairs = truth.join(noisy.select(F.col("entity_id").alias("noisy_id"), "src", "nn", "na"), "noisy_id")
    marked = pairs.join(freq("nn", "names"), ["src", "nn"], "left").join(freq("na", "addresses"), ["src", "na"], "left")
    one = marked.agg(F.count("*").alias("pairs"), F.count_if(F.col("names") > 1).alias("ambiguous_names"), F.count_if(F.col("addresses") > 1).alias("ambiguous_addresses"))
    same = pairs.groupBy("src", "nn", "na").agg(F.count("*").alias("c")).agg(F.count_if(F.col("c") > 1).alias("ambiguous_both"))
    return one.crossJoin(same)  # one row each


def token_rarity(s1: DataFrame, limits: tuple[int, ...] = (5, 10, 20, 50, 100, 200)) -> DataFrame:
    """(field, limit, surviving, tokens): tokens of document frequency within each limit."""
    out = None
    for field, column in (("address", "at"), ("name", "nt")):
        df = blocking.document_frequency(s1, column)
        each = df.select("df", F.explode(F.array(*[F.lit(k) for k in limits])).alias("limit"))
        one = each.groupBy("limit").agg(F.count_if(F.col("df") <= F.col("limit")).alias("surviving"), F.count("*").alias("tokens")).select(F.lit(field).alias("field"), "limit", "surviving", "tokens")
        out = one if out is None else out.unionByName(one)
    return out
