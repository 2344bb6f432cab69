"""The corpus pipeline: stages over documents, each one operator of varloom.llm.

A stage gets what its predecessor kept, as read from files, and works on all of it. All but the last return the columns
of documents; the last returns packed pieces. No stage can be put in SQL that gives the same rows (a trained model,
seeded samples and a tokenizer are among them), so ORACLE_SQL is None, and the stages are tested against brute force.

Defined cases, each stage as its operator states them: a null text counts as empty, and empty texts are copies of each
other; a null doc_id or source takes part like any other value; repeated rows are copies; very long texts are read whole.
Extra columns go through all stages but the last, whatever their names (those that begin with _vl_ are the operators' own).
An empty table, or labels without any document, ends in an empty result or in a classifier that keeps everything.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from varloom.llm import common, exact_dedup, mixing, near_dedup, packing, quality


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    index = exact_dedup.DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", buckets)
    out = exact_dedup.keep_first(docs, index, batch="pipeline")
    index.drop()  # `out` comes from docs and from tables that were written before
    return out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, that with the least doc_id."""
    return near_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights: rows appear as often as the mix takes them."""
    return mixing.repeat_documents(docs, mixing.repeating(5, 2, 1), share=1.5, max_epochs=2.0, seed="mix")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 2048."""
    return packing.pack(docs)


STAGES = [("quality", classify), ("exact", drop_copies), ("near", drop_near_copies), ("mixing", mix_sources), ("packing", pack_sequences)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents, each one's result written to the shared folder and read again.

    What a stage wrote on its way, and its predecessor's result, go when its own result is written.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = common.scratch_path(spark, f"stage-{name}")
        with common.temporary(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if last:
            common.delete(spark, last)
        last = path
    return docs
