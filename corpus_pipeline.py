"""A training-data pipeline of five of the operators, each stage on all that the one before kept.

Stages: documents that the quality classifier rejects go; one document of each
group of near duplicates stays; documents that hold a benchmark item go; personal
data is replaced by surrogates; texts are encoded, and the ids kept.  All but the last return the
columns of ``documents``.  Every stage judges a row by its own text, whether its id is null or
repeated; a null text counts as empty.  An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chomeflow.llm import bpe_chunks, decontaminate, minhash_cpsjoin, pii_surrogates, quality_rff
from chomeflow.llm.queries import tokenizer_path
from chomeflow.llm.tables import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_rff.fit(docs, table(spark, sf_dir, "labels"))
    whole = docs.select("doc_id", "text", F.struct("*").alias("row"))
    return quality_rff.score_quality(whole, model, keep=["row"]).where("predicted = 1").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_cpsjoin.deduplicated(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii_surrogates.masked(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_chunks.encode_decode(docs, tokenizer_path(), outputs=["ids"])


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("bpe", bpe)]

#: No SQL expresses the classifier or the surrogates; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
