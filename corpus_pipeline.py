"""From raw documents to token files: five stages, each one operator of ``songloom.llm``.

A stage takes (spark, docs, sf_dir) and gives a DataFrame; ``run`` writes each stage's rows as
Parquet in the shared folder and rereads them as the next stage's documents. All stages but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from songloom.llm.common import table
from songloom.llm.decontaminate import drop_contaminated
from songloom.llm.mixing import mix_documents
from songloom.llm.near_join import keep_one
from songloom.llm.token_files import default_tokenizer, encode_and_read
from songloom.llm.toxicity import reject_toxic
from songloom.storage import cut_lineage


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text isn't toxic."""
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words of a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, size and checksum of every document in the token files."""
    return encode_and_read(spark, docs, default_tokenizer())


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("mixing", mixing),
    ("token_files", token_files),
]

#: Tokens and learned lexicons are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
