"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents:

1. toxicity: documents that the classifier rejects go. It learns from labelled documents outside the held-out fifth.
2. line dedup: lines that stand earlier in the corpus, exactly or within one edit, go; so do documents left without any.
3. n-gram Jaccard join: of each group of near duplicates (five-word shingles, 0.8 or more) the smallest id stays.
4. benchmark decontamination: documents that hold a ten-word window of a benchmark item go.
5. best-fit packing: what is left becomes pieces of token sequences of at most 1024 tokens.

Nulls, empty texts and empty tables pass through all stages as the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontaminate, linededup, neardup, packing, queries, shared, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = queries.table(spark, sf_dir, "labels").where(toxicity.may_learn())
    model = toxicity.fit(docs.where(toxicity.may_learn()), labels)
    return toxicity.drop_toxic(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.drop_emptied(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, *queries.tokenizer())


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("packing", pack_sequences)]

#: A trained classifier, near duplicates and a tokenizer aren't SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
