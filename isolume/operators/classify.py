"""Labels against a reference annotation: interval join, class code of every pair, best pair of every query."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isolume.config import CLASS_CODE_PRIORITY
from isolume.functions.kernels import classify_pair, side
from isolume.operators.interval import BIN, overlap_join


def reference(transcripts: DataFrame) -> DataFrame:
    """The columns of a reference that labels need; of a repeated ID the last transcript is the one that counts."""
    last = transcripts.groupBy("transcript_id").agg(F.max("ord").alias("ord"))
    return transcripts.join(last, ["transcript_id", "ord"]).select("transcript_id", "gene_id", "chrom", "start", "end", "strand", "exons", "junctions", "ord")


def classify_pairs(queries: DataFrame, refs: DataFrame, key: str, threshold: int, bin_width: int | None = BIN) -> DataFrame:
    """(key, ref_transcript_id, ref_gene_id, ref_ord, code) of every overlapping pair that has a code; strands are not compared before."""
    q = queries.select(F.col(key).alias("key"), "chrom", "start", "end", "strand", "exons", "junctions")
    pairs = overlap_join(q, refs, ["chrom"], bin_width)
    code = classify_pair(side("a_"), side("b_"), threshold)
    pairs = pairs.select(F.col("a_key").alias(key), F.col("b_transcript_id").alias("ref_transcript_id"), F.col("b_gene_id").alias("ref_gene_id"), F.col("b_ord").alias("ref_ord"), code.alias("code"))
    return pairs.filter(F.col("code").isNotNull())


def classify_best(queries: DataFrame, refs: DataFrame | None, key: str, threshold: int, bin_width: int | None = BIN) -> DataFrame:
    """queries with class_code, ref_transcript_id and ref_gene_id: the pair of the best code, of equal ones the earlier reference; u if there is none."""
    if refs is None:
        null = F.lit(None).cast("string")
        return queries.withColumn("class_code", F.lit("u")).withColumn("ref_transcript_id", null).withColumn("ref_gene_id", null)
    priority = F.create_map(*[F.lit(x) for x in chain.from_iterable(CLASS_CODE_PRIORITY.items())])
    pairs = classify_pairs(queries, refs, key, threshold, bin_width).filter(F.col("code") != "u")
    best = pairs.groupBy(key).agg(F.min_by(F.struct("code", "ref_transcript_id", "ref_gene_id"), F.struct(priority[F.col("code")], "ref_ord")).alias("best"))
    best = best.select(key, F.col("best.code").alias("class_code"), "best.ref_transcript_id", "best.ref_gene_id")
    return queries.join(best, key, "left").withColumn("class_code", F.coalesce("class_code", F.lit("u")))
