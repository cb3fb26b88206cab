"""A training corpus from ``documents`` in five stages, each an operator of ``pavelens.llm`` over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. ``run`` writes each
stage as Parquet to the shared folder and reads it again for the next, so a lost executor costs no finished stage.

Nulls: a null text passes every stage (no toxic window, no words, no secrets) and encodes to no tokens; rows with a null doc_id pass the near-duplicate
stage, since no id can name them for removal. Rows that repeat one doc_id count as one document there. Empty tables give empty results; further columns
of ``documents`` are kept up to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pavelens.llm.bpe import encode_messages
from pavelens.llm.decontam import drop_leaked_labels
from pavelens.llm.jaccard import alike_labels
from pavelens.llm.queries import toxicity_model, vocabulary_path
from pavelens.llm.secrets import redact_secrets
from pavelens.llm.toxicity import drop_toxic
from pavelens.session import shared_dir


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose compression distance calls them toxic go. The model is fitted on a bounded sample of ``labels``."""
    return drop_toxic(docs, toxicity_model(spark, sf_dir), message="text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of documents that links of Jaccard similarity 0.8 or more join, the one with the smallest doc_id stays."""
    gone = alike_labels(docs, image="doc_id", value="text").where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which passages of ``benchmark`` make up a twentieth or more go."""
    return drop_leaked_labels(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), value="text", test_image="item_id")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets inside texts are replaced by a mark; every document stays. ``n_chars`` follows the text."""
    clean = redact_secrets(docs, message="text")
    changed = F.length("text").cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", F.when(F.contains("text", F.lit("[secret]")), changed).otherwise(F.col("n_chars"))).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text of every document that is left."""
    return encode_messages(docs, vocabulary_path(), key="doc_id", message="text")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("encoding", encoding)]

#: SQL cannot express compression distance, a sampled join or a tokenizer; tests/llm compares the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/llm-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
