"""Order of merged transcripts and their IDs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: IDs of a chromosome's transcripts start this far apart.
SPACING = 1_000_000
#: Rows of a stretch of merge_ord, and bases of one of the axis, within which one task sums.
STRETCH, BASES = 1 << 16, 1 << 22


def running(df: DataFrame, ident: str, keys: list[str], stretch: Column, order: Column, amount: Column) -> DataFrame:
    """(ident, total): the sum of amount up to each row in order within its keys.

    stretch must rise with order. Sums are made over stretches and then within one, on narrow rows, so no key's rows lie
    in one task.
    """
    narrow = df.select(F.col(ident), *keys, stretch.alias("__stretch"), order.alias("__order"), amount.cast("bigint").alias("__amount"))
    earlier = Window.partitionBy(*keys).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = narrow.groupBy(*keys, "__stretch").agg(F.sum("__amount").alias("__sum"))
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(earlier), F.lit(0))).drop("__sum")
    here = F.sum("__amount").over(Window.partitionBy(*keys, "__stretch").orderBy("__order").rowsBetween(Window.unboundedPreceding, 0))
    return narrow.withColumn("__here", here).join(sums, [*keys, "__stretch"]).select(ident, (F.col("__before") + F.col("__here")).alias("total"))


def merge_order(merged: DataFrame) -> DataFrame:
    """Adds merge_ord: within a chromosome multi-exon results, then mono-exon ones; strands as first met, clusters as founded."""
    met = merged.groupBy("chrom", "mono", "strand").agg(F.min("first_ord").alias("met"))
    placed = merged.join(F.broadcast(met), ["chrom", "mono", "strand"])  # at most six rows for each chromosome
    place = F.col("seed_place")
    coarse = F.when(F.col("mono"), F.struct(F.floor(place["a"] / BASES).alias("a"), F.lit(0).cast("bigint").alias("b"))).otherwise(F.struct(place["a"].alias("a"), F.floor(place["b"] / 256).alias("b")))
    order = running(placed, "seed", ["chrom"], F.struct("mono", "met", coarse.alias("place")), F.struct("mono", "met", "seed_place"), F.lit(1))
    return merged.join(order.withColumn("merge_ord", F.col("total").cast("int")).drop("total"), "seed").select(*merged.columns, "merge_ord")


def assign_ids(merged: DataFrame, chrom_order: DataFrame, prefix: str) -> DataFrame:
    """Adds transcript_id: that of the reference where the code is =, else prefix.Tx<number>.<chrom>.<code>.

    Numbers count the results without a reference's ID, in merge order, from 1 + SPACING * the chromosome's place.
    """
    inherits = (F.col("class_code") == "=") & F.col("ref_transcript_id").isNotNull()
    so_far = running(merged, "merge_id", ["chrom"], F.floor(F.col("merge_ord") / STRETCH), F.col("merge_ord"), F.when(inherits, 0).otherwise(1))
    out = merged.join(F.broadcast(chrom_order), "chrom").join(so_far, "merge_id").withColumn("number", F.col("total") + F.col("chrom_ord") * SPACING)
    novel = F.concat_ws(".", F.lit(prefix), F.concat(F.lit("Tx"), F.format_string("%06d", F.col("number"))), "chrom", "class_code")
    return out.withColumn("transcript_id", F.when(inherits, F.col("ref_transcript_id")).otherwise(novel)).drop("number", "total")
