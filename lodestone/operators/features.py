"""Features and metrics of pairs, on a_ and b_ columns of normalised records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import similarity as sim
from lodestone.functions import text

#: The order of the feature vector.
FEATURES = ["name_exact_raw", "name_exact_norm", "name_levenshtein_sim", "name_jaccard_sim", "name_token_sort_sim", "name_first_token_match", "name_length_diff_abs", "name_length_ratio", "address_exact_norm", "address_levenshtein_sim", "address_jaccard_sim", "address_overlap_ratio", "address_is_missing", "address_digit_jaccard", "country_match"]
RECORD = ["business_name", "business_address", "country", "nn", "na", "nt", "at", "tok1"]
#: Thresholds of the evidence buckets.
NAME_STRONG, NAME_WEAK, ADDRESS_STRONG, ADDRESS_WEAK = 0.85, 0.5, 0.8, 0.4


def feature_columns() -> dict[str, Column]:
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    return {
        "name_exact_raw": sim.flag(sim.equal_not_empty(F.trim(a("business_name")), F.trim(b("business_name")))),
        "name_exact_norm": sim.flag(sim.equal_not_empty(a("nn"), b("nn"))),
        "name_levenshtein_sim": sim.levenshtein_sim(a("nn"), b("nn")),
        "name_jaccard_sim": sim.set_jaccard(a("nt"), b("nt")),
        "name_token_sort_sim": sim.token_sort_sim(a("nn"), b("nn")),
        "name_first_token_match": sim.flag(sim.equal_not_empty(a("tok1"), b("tok1"))),
        "name_length_diff_abs": F.abs(F.length(a("nn")) - F.length(b("nn"))).cast("double"),
        "name_length_ratio": sim.length_ratio(a("nn"), b("nn")),
        "address_exact_norm": sim.flag(sim.equal_not_empty(a("na"), b("na"))),
        "address_levenshtein_sim": sim.levenshtein_sim(a("na"), b("na")),
        "address_jaccard_sim": sim.set_jaccard(a("at"), b("at")),
        "address_overlap_ratio": sim.overlap_ratio(a("at"), b("at")),
        "address_is_missing": sim.flag((a("na") == "") | (b("na") == "")),
        "address_digit_jaccard": sim.set_jaccard(text.digit_tokens(a("na")), text.digit_tokens(b("na"))),
        "country_match": sim.flag(sim.equal_not_empty(a("country"), b("country"))),
    }


def with_features(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns(feature_columns())


def metric_columns() -> dict[str, Column]:
    """Metrics of a pair; null where a pair isn't comparable."""
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    either = lambda c: (a(c) != "") | (b(c) != "")
    return {
        "name_exact_raw": sim.equal_not_empty(a("business_name"), b("business_name")),
        "name_exact_norm": sim.equal_not_empty(a("nn"), b("nn")),
        "addr_exact_raw": sim.equal_not_empty(a("business_address"), b("business_address")),
        "addr_exact_norm": sim.equal_not_empty(a("na"), b("na")),
        "name_levenshtein_sim": F.when(either("nn"), sim.levenshtein_sim(a("nn"), b("nn"))),
        "addr_levenshtein_sim": F.when(either("na"), sim.levenshtein_sim(a("na"), b("na"))),
        "name_jaccard": sim.set_jaccard_or_null(a("nt"), b("nt")),
        "addr_jaccard": sim.set_jaccard_or_null(a("at"), b("at")),
        "either_addr_empty": (F.trim(a("business_address")) == "") | (F.trim(b("business_address")) == ""),
        "both_addr_present": (F.trim(a("business_address")) != "") & (F.trim(b("business_address")) != ""),
        "country_equal": F.when((a("country") != "") & (b("country") != ""), a("country") == b("country")),
    }


def with_metrics(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns(metric_columns())


def evidence_bucket() -> Column:
    """name=.../address=... of a frame of with_metrics()."""
    name, address = F.coalesce("name_levenshtein_sim", F.lit(0.0)), F.coalesce("addr_levenshtein_sim", F.lit(0.0))
    n = F.when(F.col("name_exact_norm"), "exact").when(name >= NAME_STRONG, "strong").when(name >= NAME_WEAK, "weak").otherwise("dissimilar")
    a = F.when(F.col("either_addr_empty"), "empty").when(F.col("addr_exact_norm"), "exact").when(address >= ADDRESS_STRONG, "strong").when(address >= ADDRESS_WEAK, "weak").otherwise("dissimilar")
    return F.concat(F.lit("name="), n, F.lit("/address="), a)


def tfidf_cosine(pairs: DataFrame, a: str, b: str, key: list[str]) -> DataFrame:
    """key columns and the cosine of the TF-IDF vectors of two texts; the corpus is both texts of all pairs.

    Words of two or more characters, raw counts, idf = ln((1 + n) / (1 + df)) + 1, cosine; 0 if a side has no word.
    """
    long = pairs.select(*key, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col(a).alias("t")), F.struct(F.lit(1).alias("side"), F.col(b).alias("t")))).alias("x")).select(*key, "x.side", "x.t")
    words = long.select(*key, "side", F.explode(F.filter(text.all_tokens(F.col("t")), lambda w: F.length(w) >= 2)).alias("word"))
    counts = words.groupBy(*key, "side", "word").agg(F.count("*").alias("tf"))
    total = pairs.agg((2 * F.count("*")).alias("n"))
    df = counts.groupBy("word").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total))  # one row
    idf = df.select("word", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    weights = counts.join(idf, "word").withColumn("w", F.col("tf") * F.col("idf"))
    by_word = weights.groupBy(*key, "word").agg(F.sum(F.when(F.col("side") == 0, F.col("w")).otherwise(0.0)).alias("wa"), F.sum(F.when(F.col("side") == 1, F.col("w")).otherwise(0.0)).alias("wb"))
    norm = F.sqrt(F.sum(F.col("wa") * F.col("wa"))) * F.sqrt(F.sum(F.col("wb") * F.col("wb")))
    dot = by_word.groupBy(*key).agg((F.sum(F.col("wa") * F.col("wb")) / F.when(norm > 0, norm)).alias("cosine"))
    return pairs.select(*key).join(dot, key, "left").select(*key, F.coalesce("cosine", F.lit(0.0)).alias("cosine"))
