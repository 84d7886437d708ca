"""Training-data pipeline: quality classifier, language ID, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every
stage's result as Parquet in the shared folder and reads it again as the next
one's documents. All but the last stage return the columns of ``documents``.
Null, empty, repeated and very long rows and ties are treated as the operators' docstrings
say: rows without text or letters go with the first two stages; of rows with the same id and
text near-dedup keeps one; rows that share only their id stay apart, each with its own class.
Extra columns are carried to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlweave.llm import op2_quality, op6_langid, op7_packing, op9_minhash
from sqlweave.llm.common import load
from sqlweave.session import write_table

LEAST_LANGUAGE = 0.3  # documents whose best language explains less are rejected


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    scorer = op2_quality.fit(docs)
    return op2_quality.keep(docs, scorer)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents without letters and those that fit no learned language."""
    return op6_langid.keep(docs, op6_langid.fit(docs), LEAST_LANGUAGE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of every near-duplicate class."""
    return op9_minhash.keep_first(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 1,024 tokens."""
    return op7_packing.pack(docs)


STAGES = [("quality", quality), ("language", language), ("near_dedup", near_dedup), ("packing", packing)]

#: The stages learn models and hash; SQL can't express them. tests/llm rebuilds the rows stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
