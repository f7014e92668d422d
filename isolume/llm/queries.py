"""The queries opN_<name>: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isolume.llm.common import documents, held_out
from isolume.llm.lang_id import identify
from isolume.llm.license_scan import scan_licenses
from isolume.llm.line_dedup import dedup_lines
from isolume.llm.media import media_features
from isolume.llm.minhash_dedup import classes_of
from isolume.llm.mixing import mix
from isolume.llm.quality import predicted, score_documents
from isolume.llm.secret_scan import RULES, scan_secrets, spans_string
from isolume.llm.sentencepiece import encode_documents
from isolume.llm.topk import top_k


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"), min_docs=10, min_chars=1)
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("__kept", 256).alias("kept_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=20, every=20, scale=64)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = score_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted(F.col("score")).alias("predicted"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(documents(spark, sf_dir), weights=(5, 2, 1), budget=1.5, repeat=2)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir)).drop("spans")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes_of(documents(spark, sf_dir))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(documents(spark, sf_dir))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(documents(spark, sf_dir))
    base = [r.kind for r in RULES if r.base]
    counts = [F.size(F.filter("found", lambda s: s["ord"] == n)).cast("long").alias(f"n_{k}") for n, k in enumerate(base)]  # noqa: B023
    of_base = F.filter("found", lambda s: s["ord"] < len(base))
    return found.select("doc_id", *counts, F.sha2(spans_string(of_base), 256).alias("base_sha256"), spans_string(F.col("found")).alias("spans"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_language_id,
        op3_exact_topk,
        op4_quality_classifier,
        op5_source_mixing,
        op6_license_scan,
        op7_sentencepiece,
        op8_minhash_dedup,
        op9_media_columns,
        op10_secret_scan,
    )
}
