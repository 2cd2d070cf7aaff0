"""From raw documents to a training mixture: quality rules, near-duplicates, benchmark
decontamination, secrets, mixing.  Each stage works on all that the stage before it kept.

All stages take documents as they come: null, blank and very long texts, null ids, repeated rows, ties,
empty tables, and columns of any name besides doc_id, text, lang and source.  Each says what it makes
of them; all but the last return the columns of documents as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linetrace.llm import decontaminate, mixing, quality_rules, secret_scan, simhash
from linetrace.llm.common import stash, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the cutoffs of their language.  Null, blank and short
    texts go; a null language is one of its own; repeated rows stay repeated; a measure that equals a
    cutoff passes; without labels only the base rule acts."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: the least doc_id, then the least hash of id and
    text; null ids come last.  Texts without words are one group, repeated rows copies."""
    return simhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark.  Null and blank texts contain none; repeated
    rows share their fate; null items are not searched."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced.  Null and blank texts, and repeated rows, stay."""
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each use of a document in the mixture.  Null sources are one source; texts without
    words have no tokens; documents of equal hash are in the order of their ids."""
    return mixing.mix(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("secrets", secrets), ("mixture", mixture)]

#: Shingle fingerprints and edit distances can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
