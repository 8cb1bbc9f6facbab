"""Stages that turn raw documents into training data.

Each stage takes (spark, docs, sf_dir), where docs is all that its predecessor
kept, and calls one operator of ``terraflux.llm``. Every stage but the last
returns the columns of docs, whatever their names; they need doc_id and text, the
first also lang and source. ``run`` applies them one after another, each on the
written table of the one before.

Nulls in lang, source and n_chars stay as they are. Null and empty texts fail the
quality rules; in later stages alone a null text stays null, holds no benchmark item,
has the fingerprint 0 and is encoded as an empty one. Rows with a null doc_id are
documents like any other, repeated rows are copies of each other, of which the near-dedup
stage keeps one. Texts of any length pass whole. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraflux.llm.common import free_name, materialise, table
from terraflux.llm.decontaminate import contaminated
from terraflux.llm.line_dedup import dedup_lines
from terraflux.llm.quality import judge
from terraflux.llm.sentencepiece_codec import encode
from terraflux.llm.simhash import first_of_each_class


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the outlier test keep."""
    info = free_name(docs.columns, "quality")
    return judge(docs, info=info).where(f"{info}.kept").drop(info)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the chunks and whole runs of lines that occur earlier, and with n_chars
    to match, where docs has it; a document of which nothing is left, so any copy of an
    earlier one, goes."""
    info = free_name(docs.columns, "line_dedup")
    left = dedup_lines(docs, info=info)
    removed = F.col(f"{info}.n_removed_lines")
    left = left.where(~((removed > 0) & (removed == F.col(f"{info}.n_lines"))))
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        left = left.withColumn("n_chars", F.when(removed > 0, size).otherwise(F.col("n_chars")))
    return left.drop(info)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id."""
    return first_of_each_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return contaminated(docs, table(spark, sf_dir, "benchmark"), False)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, begins, ends and decoded of every document."""
    return encode(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Robust estimates, SimHash classes and SentencePiece ids aren't expressible in SQL; the
#: stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
