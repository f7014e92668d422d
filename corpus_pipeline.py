"""A corpus pipeline: five stages over documents, each written and read again.

Each stage takes (spark, docs, sf_dir), works on every row that the one before
kept, and returns the columns of documents; the last returns tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isolume.llm.common import documents, stored
from isolume.llm.line_dedup import dedup_lines
from isolume.llm.minhash_dedup import keep_one
from isolume.llm.mixing import mixed_documents
from isolume.llm.quality import THRESHOLD, score_documents
from isolume.llm.sentencepiece import encode_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    scored = score_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), name="__score")
    return scored.filter(F.col("__score") >= THRESHOLD).drop("__score")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more leave all texts; documents stay, even those left empty."""
    out = dedup_lines(docs)
    new = {"text": F.col("__kept"), "n_chars": F.length("__kept").cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by weight, up to two passes; a document stands as often as it is taken whole."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the checksum of the decoded text."""
    return encode_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near-duplicates", near_duplicates),
    ("mixing", mixing),
    ("sentencepiece", tokens),
]

#: Models and signatures have no SQL form; the pipeline is tested against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
