"""Normalised entity records: everything that blocking rules and features need, computed once a record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text


def normalize_records(records: DataFrame, unicode: bool | None = None) -> DataFrame:
    """Adds nn, na (normalised name and address), nt, at (their token sets), tok1, tok2; texts null -> ''.

    unicode: whether to provide for characters that need Python: rows that hold any are a branch of their own, so no other
    row leaves the JVM; a stream, which two branches would read twice, sends the other rows along as nulls. None looks
    whether there are any.
    """
    texts = ("business_name", "business_address")
    r = records
    for c in (*texts, "country"):
        r = r.withColumn(c, F.coalesce(c, F.lit("")))
    if unicode is None:
        unicode = text.needs_unicode(r, *texts)
    r = r.withColumn("country", F.trim("country"))
    normal = lambda df, python: df.withColumn("nn", text.normalize_text(F.col("business_name"), python)).withColumn("na", text.normalize_text(F.col("business_address"), python))
    if unicode and not r.isStreaming:
        beyond = text.beyond_native(*texts)
        r = normal(r.where(~beyond), False).unionByName(normal(r.where(beyond), True))
    else:
        r = normal(r, bool(unicode))
    return r.withColumn("nt", text.tokens(F.col("nn"))).withColumn("at", text.tokens(F.col("na"))).withColumn("tok1", text.first_token(F.col("nn"))).withColumn("tok2", text.first_two_tokens(F.col("nn")))


def pair_columns(pairs: DataFrame, s1: DataFrame, noisy: DataFrame, columns: list[str]) -> DataFrame:
    """pairs with the records' columns, prefixed a_ and b_."""
    a = s1.select(F.col("entity_id").alias("s1_id"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = noisy.select(F.col("entity_id").alias("noisy_id"), *[F.col(c).alias(f"b_{c}") for c in columns])
    return pairs.join(a, "s1_id").join(b, "noisy_id")
