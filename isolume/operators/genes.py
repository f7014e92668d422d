"""Genes: connected components of exon overlap, their numbers, IDs and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isolume.operators.components import components
from isolume.operators.ids import BASES, running
from isolume.operators.interval import BIN, islands, overlap_join
from isolume.storage import stored


def exon_links(exons: DataFrame, bin_width: int | None = BIN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What overlapping exons of (chrom, strand, id, i, t_start, t_end, start, end) connect: (bases, hubs, pairs).

    Exons that overlap in a chain form an island, and its transcripts hang together at the least of them, its hub.
    bases: (id, base), the least hub of a transcript's islands; hubs: (u, v), bases and the other hubs of their
    transcripts, far fewer than the exons. Only an overlap whose later transcript starts within the earlier one's
    span counts; where a transcript of an island has exons outside its span, the island's transcripts are looked at
    one by one: pairs (u, v).
    """
    keys = ["chrom", "strand"]
    odd = (F.col("start") < F.col("t_start")) | (F.col("end") > F.col("t_end"))
    exons = exons.filter("start < end").withColumn("odd", odd).withColumn("exon", F.struct("id", "i"))
    found = stored(islands(exons, keys, F.col("start"), F.col("end"), -1, tie="exon"), "exon_islands")
    of_island = found.groupBy(*keys, "island").agg(F.min("id").alias("hub"), F.max("odd").alias("any_odd"))
    told = stored(found.join(of_island, [*keys, "island"]).select(*keys, "island", "id", "t_start", "t_end", "start", "end", "hub", "any_odd"), "exon_hubs")
    plain = told.filter("NOT any_odd")
    bases = plain.groupBy("id").agg(F.min("hub").alias("base"))
    hubs = plain.join(bases, "id").filter("base <> hub").select(F.col("base").alias("u"), F.col("hub").alias("v")).distinct()
    rest = told.filter("any_odd").drop("hub", "any_odd")
    pairs = overlap_join(rest, rest, [*keys, "island"], bin_width)
    first = F.struct("a_t_start", "a_id") < F.struct("b_t_start", "b_id")
    looked = pairs.filter(first & (F.col("b_t_start") <= F.col("a_t_end"))).select(F.col("a_id").alias("u"), F.col("b_id").alias("v"))
    return bases, hubs, looked.distinct()


def exon_roots(exons: DataFrame, more: DataFrame | None = None, bin_width: int | None = BIN) -> DataFrame:
    """(node, root) of all transcripts that hang together by exons or by more links (u, v); the root is the least of them.

    Rounds run over hubs only: every other transcript takes its base's root.
    """
    bases, hubs, pairs = exon_links(exons, bin_width)
    bases = stored(bases, "gene_bases")
    direct = pairs if more is None else pairs.unionByName(more)
    based = lambda end: bases.select(F.col("id").alias(end), F.col("base").alias(f"{end}_base"))
    direct = direct.join(based("u"), "u", "left").join(based("v"), "v", "left")
    edges = hubs.unionByName(direct.select(F.coalesce("u_base", "u").alias("u"), F.coalesce("v_base", "v").alias("v")))
    found = components(edges)
    own = bases.select(F.col("id").alias("node"), "base").join(found.withColumnRenamed("node", "base"), "base", "left").select("node", F.coalesce("root", "base").alias("root"))
    others = found.join(bases, found["node"] == bases["id"], "left_anti")
    return own.unionByName(others)


def exons_of(transcripts: DataFrame, ident: str) -> DataFrame:
    """One row for each exon, with its transcript's span."""
    e = transcripts.select("chrom", "strand", F.col(ident).alias("id"), F.col("start").alias("t_start"), F.col("end").alias("t_end"), F.posexplode("exons").alias("i", "e"))
    return e.select("chrom", "strand", "id", "i", "t_start", "t_end", "e.start", "e.end")


def gene_roots(merged: DataFrame, by_reference: bool = False) -> DataFrame:
    """(node, root): genes, which are transcripts of one strand whose exons overlap.

    by_reference also links transcripts of one reference gene.
    """
    more = None
    if by_reference:
        known = merged.filter(F.col("ref_gene_id").isNotNull())
        hubs = known.groupBy("chrom", "strand", "ref_gene_id").agg(F.min("merge_id").alias("v"))
        more = known.join(hubs, ["chrom", "strand", "ref_gene_id"]).select(F.col("merge_id").alias("u"), "v").filter("u <> v").distinct()
    return exon_roots(exons_of(merged, "merge_id"), more)


def define_genes(merged: DataFrame, prefix: str, by_reference: bool = False) -> DataFrame:
    """merged (with merge_id, the chromosome's merge_ord and ref_gene_id) with component, gene_no and gene_id.

    Genes are numbered within a chromosome: strands in the order in which the merge met them, components by their
    first transcript in order of start. A gene whose transcripts name one reference gene has its ID.
    """
    roots = gene_roots(merged, by_reference)
    out = merged.join(roots.select(F.col("node").alias("merge_id"), "root"), "merge_id", "left").withColumn("component", F.coalesce("root", "merge_id")).drop("root")
    met = merged.groupBy("chrom", "strand").agg(F.min("merge_ord").alias("strand_ord"))
    genes = out.groupBy("chrom", "strand", "component").agg(
        F.min(F.struct("start", "merge_ord")).alias("first"),
        F.collect_set("ref_gene_id").alias("refs"),
        F.min("start").alias("gene_start"),
        F.max("end").alias("gene_end"),
        F.count(F.lit(1)).alias("num_transcripts"),
        F.size(F.array_distinct(F.flatten(F.collect_list("sample_ids")))).alias("gene_samples"),
    )
    genes = genes.join(F.broadcast(met), ["chrom", "strand"])  # two or three strands for each chromosome
    genes = stored(genes, "genes")
    numbers = running(genes, "component", ["chrom"], F.struct("strand_ord", F.floor(F.col("first.start") / BASES).alias("at")), F.struct("strand_ord", "first"), F.lit(1))
    genes = genes.join(numbers, "component")
    known = F.when(F.size("refs") == 1, F.element_at("refs", 1))
    genes = genes.withColumn("gene_no", F.col("total").cast("int")).withColumn("gene_id", F.coalesce(known, F.concat(F.lit(f"{prefix}G"), F.col("gene_no").cast("string"))))
    genes = genes.withColumn("gene_ref", F.array_min("refs")).drop("refs", "first", "strand_ord", "total")
    return out.join(genes, ["chrom", "strand", "component"])


def genes_of(merged: DataFrame) -> DataFrame:
    """One row for each gene of define_genes' result."""
    kept = ["chrom", "strand", "component", "gene_no", "gene_id", "gene_ref", "gene_start", "gene_end", "num_transcripts", "gene_samples"]
    return merged.select(*kept).distinct()
