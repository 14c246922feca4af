"""A corpus from raw documents: quality, exact copies, near copies, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return
the columns of documents, which may have any names beside doc_id, text and source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import lsm_dedup, mixing, nbsvm, packing, simhash
from tideline.llm._shared import remove, scratch, scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels outside the held-out fold, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return nbsvm.keep_accepted(docs, nbsvm.train_classifier(docs, labels))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the largest doc_id."""
    return lsm_dedup.unique_rows(docs, keep="largest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each component of near copies.

    Five-word shingles, Jaccard similarity of 0.8 or more, all pairs that similar: fingerprints at
    14 of 64 bits and an exact prefix filter find the candidates (see the README).
    """
    return simhash.one_of_each(docs, width=5, least=0.8, max_bits=14)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: a row for each round that draws words of a document, with those words."""
    return mixing.mixed_documents(docs, mixing.mix_sources(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed sequences of the mixed documents: a row per bin with its text and what it holds."""
    return packing.packed_sequences(docs)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("simhash", near_dedup), ("mix", mix), ("pack", pack)]

#: Fitting, sampling and packing are not for SQL; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written and read again, and what led to it is removed."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch(spark) as kept:
            out = stage(spark, docs, sf_dir)
            path = scratch_path(spark, f"pipeline-{name}")
            kept.append(path)
            out.write.parquet(path)
        if before:
            remove(spark, [before])
        docs, before = spark.read.schema(out.schema).parquet(path), path
    return docs
