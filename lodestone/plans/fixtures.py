"""Entity records derived from the documents table: three sources and the truth, by rules on words and doc_id."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import records
from lodestone.sources import shared


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entity_records(documents: DataFrame) -> DataFrame:
    """(src, entity_id, business_name, business_address, country, doc_id)."""
    # eight words are used: the first nine parts, of which the first may be empty, hold them; the rest of a text stays unsplit
    w = documents.select("doc_id", F.upper("lang").alias("country"), F.filter(F.slice(F.split("text", r"\s+", 10), 1, 9), lambda x: x != "").alias("w"))
    joined = lambda start, n: F.concat_ws(" ", F.slice("w", start, n))
    base = w.select("doc_id", "country", joined(1, 3).alias("nm"), joined(1, 2).alias("nm2"), F.concat_ws(" ", F.get("w", F.lit(1)), F.get("w", F.lit(0))).alias("swapped"), joined(4, 5).alias("ad"), (F.col("doc_id") % 997).cast("string").alias("num"))
    i = F.col("doc_id")
    one = F.struct(F.lit(1).alias("src"), F.concat(F.lit("S1-"), i).alias("entity_id"), F.col("nm").alias("business_name"), F.concat("num", F.lit(" "), "ad").alias("business_address"))
    name2 = F.when(i % 3 == 0, F.upper(F.replace("nm", F.lit("ß"), F.lit("ss")))).when(i % 5 == 0, F.col("nm2")).otherwise(F.concat("nm", F.lit(" Ltd.")))
    two = F.struct(F.lit(2).alias("src"), F.concat(F.lit("S2-"), i).alias("entity_id"), name2.alias("business_name"), F.when(i % 11 == 0, "").otherwise(F.concat("ad", F.lit(", "), "num")).alias("business_address"))
    three = F.struct(F.lit(3).alias("src"), F.concat(F.lit("S3-"), i).alias("entity_id"), F.when(i % 2 == 0, F.col("swapped")).otherwise(F.col("nm")).alias("business_name"), F.when(i % 13 == 0, "").otherwise(F.col("ad")).alias("business_address"))
    in3 = (i % 4).isin(0, 3) | ((i % 4 == 2) & (i % 7 != 0))
    each = F.filter(F.array(F.when(i % 4 != 3, one), F.when((i % 4).isin(0, 1, 3), two), F.when(in3, three)), lambda x: x.isNotNull())
    return base.select("doc_id", "country", F.explode(each).alias("r")).select("r.*", "country", "doc_id")


@dataclass
class Entities:
    """Normalised records and the truth of one data set; the records are written once, so that plans read them narrow."""

    records: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, sf_dir: str) -> Entities:
        return cls(shared.written(records.normalize_records(entity_records(table(spark, sf_dir, "documents")), unicode=True), "records", ["src"]))

    @property
    def s1(self) -> DataFrame:
        return self.records.where("src = 1")

    @property
    def noisy(self) -> DataFrame:
        return self.records.where("src > 1")

    @property
    def ids(self) -> DataFrame:
        return self.s1.select(F.col("entity_id").alias("s1_id"))

    @property
    def truth(self) -> DataFrame:
        return self.s1.select("doc_id", F.col("entity_id").alias("s1_id")).join(self.noisy.select("doc_id", F.col("entity_id").alias("noisy_id")), "doc_id").select("s1_id", "noisy_id")
