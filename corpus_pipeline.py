"""A corpus from raw documents to packed sequences, in five stages.

``run(spark, sf_dir)`` applies ``STAGES`` to the table of documents; what a stage returns is written as Parquet and read
again as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeframe.llm.common import TEXT_ROWS, written
from lodeframe.llm.exact_dedup import without_copies
from lodeframe.llm.mixing import mixed_documents
from lodeframe.llm.packing import packed_documents
from lodeframe.llm.perplexity import character_quality, train_characters
from lodeframe.llm.similar import without_similar


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read like those labelled good in the same language, stored, as whoever writes them would send Python
    batches of the session's size."""
    model = train_characters(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return written(character_quality(docs, model).where("accepted").select(*docs.columns), "quality-accepted", TEXT_ROWS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space aside."""
    return without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash links: of sets of five words with a similarity of about 0.8 or more."""
    return without_similar(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; texts at the cut of a source's budget are shortened."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of at most 2048 tokens."""
    return packed_documents(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", exact_dedup),
    ("simhash near-dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: The first stage is a trained model and the last uses a tokenizer: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
