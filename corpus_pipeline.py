"""The corpus pipeline: documents from raw text to tokens, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but
the last return the columns of documents.  ``run`` writes each stage's rows to the shared
folder and reads them again for the next, so a lost executor costs its own tasks only.
Rows with nulls pass through the stages by the rules in each operator's docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stepwell.llm import bpe, decontamination, exact_dedup, jaccard_join, queries, tables, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    labels = queries.table(spark, sf_dir, "labels")
    return toxicity.accept(docs, toxicity.train(docs, labels, queries.CATEGORIES))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with one text, A-Z lower-cased, the one with the largest identifier stays."""
    return exact_dedup.keep_one(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least identifier stays."""
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontamination.clean(docs, queries.table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document, and whether they decode to its text."""
    vocabulary = bpe.read_vocabulary(queries.VOCABULARY)
    coded = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), vocabulary)
    return coded.selectExpr("doc_id", "lang", "source", "size(token_ids) AS n_tokens", "token_ids", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("BPE", tokenise),
]

#: No stage but the second has an SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = tables.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
