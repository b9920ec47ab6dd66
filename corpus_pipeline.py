"""The training-corpus pipeline: documents in, packed sequences out.

Each stage calls one operator of ``quarry.llm`` on all that the stage before
kept. All stages but the last return the columns of ``documents``, whatever
their names and however many. An empty table gives an empty result at every
stage. Null texts count as empty ones but in the first stage, which drops them;
null ids are allowed everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontaminate, exact_dedup, language, packing, simhash
from quarry.llm.queries import word_tokenizer
from quarry.session import materialize, ship_package


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: texts without letters (null and empty
    ones among them) and texts of which no language gets 0.4 of the
    probability over their bytes. Repeated rows are judged alike."""
    ship_package(spark)
    return language.keep_identified(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the largest doc_id stays;
    a null id is the smallest, of repeated rows one stays."""
    ship_package(spark)
    return exact_dedup.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group (3-word shingles, at most 2 bits) the row with
    the smallest doc_id stays; a null id is the largest, texts without words
    are one group."""
    ship_package(spark)
    return simhash.drop_near_copies(docs, shingle=3, distance=2)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of words with ``benchmark`` go; texts
    without words stay, an empty benchmark drops nothing."""
    ship_package(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, see ``packing.pack_documents``; an empty text
    is a document of the end id alone."""
    ship_package(spark)
    return packing.pack_documents(docs, word_tokenizer(), sequence=2048)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

# language identification, SimHash and tokenisation are not expressible in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents`` in order, each written as Parquet
    in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
