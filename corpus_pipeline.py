"""The corpus pipeline: quality rules, toxicity, near-duplicates, decontamination, encoding.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; each but the last
keeps the columns of ``documents``.  Stages are written and read again between
each other, in the folder of spark.checkpoint.dir, so a lost executor costs a
part of one stage; a stage's folder goes once the next one is written, and that
of the last stays, since the result reads it.

Defined results, by stage: a null or empty text has no words, which the quality
rules reject.  A null doc_id is kept where its text is; it never stands for a
group of near-duplicates that has an id.  Of repeated rows the near-duplicate
stage keeps one.  Texts of any length go through every stage whole.  Columns beyond
those of documents, whatever their names, pass all stages but the last, which
returns the columns it names.  An empty table gives an empty result; empty labels
give a list without learned rules and a toxicity model that rejects nothing; an
empty benchmark cuts nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import bpe, decontaminate, quality_rules, simhash, toxicity
from plumbline.llm.common import discard, scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned list reject go."""
    return quality_rules.filter_documents(docs, table(spark, sf_dir, "labels"))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.filter_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    return simhash.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source with the token count and the digests of ids and decoded text."""
    return bpe.round_trip(docs.select("doc_id", "lang", "source", "text"))


STAGES = [
    ("quality rules", quality),
    ("toxicity", toxic),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("encoding", encoded),
]

#: Learned rules, a learned classifier and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = scratch(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return docs
