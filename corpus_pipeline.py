"""The corpus pipeline: language ID, near-duplicates, decontamination, mixing and token files, one after the other."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidframe.llm.common import materialise, table
from bidframe.llm.decontam import decontaminate
from bidframe.llm.langid import keep_identified
from bidframe.llm.mixing import mix_sources
from bidframe.llm.neardup import near_duplicates
from bidframe.llm.tokens import tokenise_documents

#: A document goes if no language is predicted, or none with this share of the likelihood.
LEAST_SCORE = 0.5
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_identified_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose language is identified. Every row is judged by its own text: repeated rows stay together, and a row with a null doc_id is judged like any other."""
    return keep_identified(docs, LEAST_SCORE).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate group. Rows that repeat a doc_id are one document: they stay or go together, and it goes if any of its texts is a copy of an earlier document's."""
    dropped = materialise(near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct(), "near-copies")
    return docs.join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def drop_benchmark_holders(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; one without a doc_id goes by its own text."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; of rows that repeat a doc_id, each as often as the one taken most. Rows with a null doc_id are one document in this."""
    taken = materialise(mix_sources(docs).groupBy(F.col("doc_id").alias("taken_id")).agg(F.max("copies").alias("copies")).filter("copies > 0"), "copies")
    rows = docs.join(taken, F.col("doc_id").eqNullSafe(F.col("taken_id")))
    return rows.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' digest of every document, copies of the mix one after the other."""
    return tokenise_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


STAGES = [
    ("language_id", keep_identified_languages),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_benchmark_holders),
    ("mixing", mix),
    ("token_files", write_tokens),
]

#: Language ID, near-duplicate signatures and tokenizing can't be said in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
