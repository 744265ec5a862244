"""The corpus pipeline: quality rules, line dedup, near duplicates, source mixing, sentence pieces.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; the driver of run() writes
each result as Parquet in the shared checkpoint folder and reads it again as the next stage's docs.

Cases: null and empty texts have no words, so the quality rules reject them; where a stage meets them by itself, line dedup
drops them (nothing without a word stays), near duplicates keeps them (they link with nothing), the mix takes nothing of
them, the encoder gives null or no ids. Equal rows are judged one by one by the rules, cleaned alike by line dedup, stay
both in near duplicates when they share the doc_id that stays, and are mixed and encoded each for itself. Very long
texts are read whole. An empty table gives no rows. Columns other than those of documents are dropped, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import jaccard_join, line_dedup, mixing, quality_rules, sentence_pieces
from palimpsest.llm.common import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the current policy of the rule ledger rejects."""
    return quality_rules.filter_documents(docs.select(*COLUMNS))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated chunks of lines out of the texts; what is left without a word goes."""
    return line_dedup.clean(docs.select(*COLUMNS)).where("rlike(text, '[^\\\\x20\\\\x09-\\\\x0D]')").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked documents."""
    return jaccard_join.keep_one(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes sources at their target weights: documents repeat where their source is taken more than once."""
    return mixing.mix_documents(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix."""
    return sentence_pieces.encode_documents(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("source mixing", mix), ("sentence pieces", encode)]

#: SQL can't express the encoder; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
