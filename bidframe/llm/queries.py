"""The corpus operators over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidframe.llm.align import align_tokenizers
from bidframe.llm.common import table
from bidframe.llm.decontam import contaminated
from bidframe.llm.langid import identify_documents
from bidframe.llm.licences import licence_scan
from bidframe.llm.mixing import mix_sources
from bidframe.llm.neardup import near_duplicates
from bidframe.llm.pii import KINDS, find_personal_data, span_text
from bidframe.llm.prefixtrie import conversation_trie
from bidframe.llm.sharding import assign_shards
from bidframe.llm.simhash import simhash_duplicates
from bidframe.llm.tokens import tokenise_documents
from bidframe.llm.topk import top_k
from bidframe.llm.urlfilter import filter_urls

#: Where the tokenizers' vocabularies lie is up to this package.
TOKENIZER = "byte_bpe_50k.json"
OTHER_TOKENIZER = "piece_bpe_32k.model"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_documents(table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item it holds."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenise_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=2)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are those of the document with the page's id: bad if toxic or of low quality."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    bad = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    return filter_urls(pages, pages.join(bad, "page_id").select("url", "bad")).select("page_id", "host", "path", "rule", "verdict", "mined_rules")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))

    def count_of(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count_of(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(table(spark, sf_dir, "documents"))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), shards=16)


def op11_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.path(OTHER_TOKENIZER))


def op12_simhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_language_id, op2_near_duplicates, op3_top_k, op4_decontaminate, op5_mix_sources, op6_token_files, op7_url_filter, op8_personal_data, op9_licence_scan, op10_shards, op11_align_tokenizers, op12_simhash_duplicates, op13_conversation_trie)
    return {f.__name__: f for f in found}
