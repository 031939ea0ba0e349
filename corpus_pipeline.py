"""From raw documents to packed training sequences: quality rules, near-duplicates, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wavesift.llm import minhash, packing, pii, quality, shared, simhash

#: SQL cannot express fingerprints' components, boosted trees or packing.
ORACLE_SQL = None


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, by language (a null one is a language of its own), with cutoffs certified
    on the labels of sf_dir. Null, empty and short texts go; rows are judged each by itself, also repeated ones and
    those with a null id; an empty table stays empty."""
    return quality.keep(docs, shared.table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles: the one with
    the smallest id (null last), and of repeated rows of that id one. Candidates are the groups of op2's operator, from
    fingerprints of these shingles, and MinHash bands; each is verified. Texts without words are one group; a shorter
    text is one shingle; an empty table stays empty."""
    return simhash.one_of_each(docs, classify=minhash.classified)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated ones too, with personal data in whole texts replaced by its kind; null texts stay null."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences; null texts are their end id, an empty table has no pieces."""
    return packing.pack(docs)


STAGES = [("quality", good), ("near_duplicates", distinct), ("pii", clean), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written to the shared folder before the next reads it."""
    docs = shared.documents(spark, sf_dir)
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = shared.settle(docs, name)
    return docs
