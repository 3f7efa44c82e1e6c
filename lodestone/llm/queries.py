"""The queries of the operators in this package, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql import types as T

from lodestone.llm import decontaminate, linededup, neardup, packing, secrets, shards, shared, sql, suffixes, toxicity, vectors, warc

#: The vocabulary file that op7 names, and how the tokenizer splits texts before it merges bytes.
TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cleaned = suffixes.remove_repeats_with(docs, "doc_id", "text", suffixes.LENGTH, suffixes.GRAM, suffixes.MOST, suffixes.sha256_of, T.StringType(), "kept_sha256")
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cleaned.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shards.assign_shards(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    deduped = linededup.dedup_lines(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return deduped.select("doc_id", "n_lines", "n_removed", "emptied", F.sha2("deduped", 256).alias("text_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs.where(toxicity.may_learn()), labels.where(toxicity.may_learn()))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (~toxicity.may_learn()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), *tokenizer()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    manifest = warc.write_warc(pages, shared.new_folder(spark, "warc"))
    return warc.read_warc(manifest, pages.schema["page_id"].dataType).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("secrets", lambda s: s["kind"].isin([r.kind for r in secrets.BASE]))
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(r.kind) for r in secrets.BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op10_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.similar_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_suffix_array_dedup, op3_sharding, op4_decontaminate, op5_line_dedup, op6_toxicity, op7_packing, op8_warc, op9_secrets, op10_embedding_neardup)}
#: Without SQL: op3 (cuts follow Spark's hash of texts), op6 (a trained model) and op7 (a tokenizer); tests hold them against plain versions.
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": sql.NEAR_DUPLICATES, "op2_suffix_array_dedup": sql.REPEATS, "op4_decontaminate": sql.CONTAMINATION, "op5_line_dedup": sql.LINES,
    "op8_warc": sql.WARC, "op9_secrets": sql.secrets_sql(), "op10_embedding_neardup": sql.VECTORS,
}
