"""Lenses: genomic shapes over order and event tables, and one query for each operator.

An order is a transcript and its lines are exons. Orders that share their key
modulo GENES lie on one gene, 20 kb from the next; its strand and chromosome
follow from its number. Line k stands at 500 k from the gene's start; some parts
drift by up to 4 bp, every other order starts one exon later, and short orders
are truncated, so exact, drifted, truncated and single-exon shapes all occur.
Genes are independent of each other, so the work is linear in the orders of a
gene; their number is a parameter of the lens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isolume.config import ClusterConfig, MergeConfig
from isolume.functions.arrays import first_least, first_mode, first_per, first_most
from isolume.functions.kernels import (
    coord_error,
    exonic_length,
    exons_overlap,
    junction_chain,
    junctions_of,
    match_nearest,
    merge_mono,
    merge_multi,
    penalty_score,
    side,
    similarity,
)
from isolume.operators import consensus, legacy
from isolume.operators.classify import classify_best, classify_pairs, reference
from isolume.operators.consensus import pick_end, truncations
from isolume.operators.genes import define_genes, exon_roots, exons_of
from isolume.operators.greedy import merge_clusters, merge_mono_exon
from isolume.operators.ids import assign_ids
from isolume.operators.interval import islands, overlap_join, self_overlap
from isolume.plans.cluster import cluster_totals, cluster_transcripts, mark_reference, occurrences, similar_pairs
from isolume.plans.merge import merge_transcripts
from isolume.sources import sinks
from isolume.sources.gtf import assemble, natural_order, parse_attributes
from isolume.sources.manifest import duplicate_samples
from isolume.storage import stored

GENES = 2000
SAMPLES = 7
CFG = MergeConfig()
SIM = ClusterConfig()
#: A gene fits in a bin of the interval joins.
WIDTH = 1 << 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place(gene: Column) -> dict[str, Column]:
    return {
        "chrom": F.concat(F.lit("chr"), (gene % 5 + 1).cast("string")),
        "strand": F.when(F.expr("gene div 5") % 2 == 0, "+").otherwise("-"),
    }


def lens_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, gene, chrom, strand, sample_id, start, end): one row for each line of an order."""
    line = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ord"), "l_partkey", F.row_number().over(line).alias("rn"))
    rows = rows.withColumn("gene", F.col("ord") % GENES).withColumns(_place(F.col("gene")))
    k = F.col("rn") + F.expr(f"ord div {GENES}") % 2
    drift = F.when(F.col("l_partkey") % 11 == 0, F.col("l_partkey") % 5).otherwise(0)
    start = F.col("gene") * 20000 + k * 500 + drift
    rows = rows.withColumn("start", start).withColumn("end", F.col("start") + 100 + 10 * (F.col("gene") % 7))
    return rows.select("ord", "gene", "chrom", "strand", F.concat(F.lit("s"), (F.col("ord") % SAMPLES).cast("string")).alias("sample_id"), "start", "end")


def lens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of the lens: one shuffle on the order, which the row numbers have made already."""
    exon = F.struct("start", "end", "strand")
    t = lens_exons(spark, sf_dir).groupBy("ord").agg(*[F.first(c).alias(c) for c in ("gene", "chrom", "strand", "sample_id")], F.array_sort(F.collect_list(exon)).alias("exons"))
    return t.select(
        F.concat(F.lit("t"), F.col("ord").cast("string")).alias("transcript_id"),
        F.concat(F.lit("g"), F.col("gene").cast("string")).alias("gene_id"),
        "chrom",
        F.array_min(F.transform("exons", lambda e: e["start"])).alias("start"),
        F.array_max(F.transform("exons", lambda e: e["end"])).alias("end"),
        "strand",
        "sample_id",
        "ord",
        "exons",
        junctions_of(F.col("exons")).alias("junctions"),
        "gene",
    )


def lens_ref(spark: SparkSession) -> DataFrame:
    """A reference: each gene's whole chain (r<gene>), and of every third gene also its exons 2 to 5 (c<gene>)."""
    genes = spark.range(GENES).withColumnRenamed("id", "gene").withColumns(_place(F.col("gene")))

    def chain(df: DataFrame, letter: str, first: int, last: int, ord_: Column) -> DataFrame:
        start = lambda k: F.col("gene") * 20000 + k * 500
        exons = F.transform(
            F.sequence(F.lit(first), F.lit(last)),
            lambda k: F.struct(start(k).alias("start"), (start(k) + 100 + 10 * (F.col("gene") % 7)).alias("end"), F.col("strand").alias("strand")),
        )
        t = df.withColumn("exons", exons).withColumn("ord", ord_)
        return t.select(
            F.concat(F.lit(letter), F.col("gene").cast("string")).alias("transcript_id"),
            F.concat(F.lit("g"), F.col("gene").cast("string")).alias("gene_id"),
            "chrom",
            F.element_at("exons", 1)["start"].alias("start"),
            F.element_at("exons", -1)["end"].alias("end"),
            "strand",
            "exons",
            junctions_of(F.col("exons")).alias("junctions"),
            "ord",
        )

    return chain(genes, "r", 1, 13, F.col("gene")).unionByName(chain(genes.filter("gene % 3 = 0"), "c", 2, 5, F.col("gene") + GENES))


def neighbours(t: DataFrame) -> DataFrame:
    """Each transcript (b_) beside the one before it on its gene (a_): as many pairs as transcripts."""
    cols = [F.col(c) for c in ("ord", "chrom", "start", "end", "strand", "exons", "junctions")]
    before = F.lag(F.struct(*cols)).over(Window.partitionBy("gene").orderBy("ord"))
    pairs = t.withColumn("a", before).filter(F.col("a").isNotNull())
    names = ("ord", "chrom", "start", "end", "strand", "exons", "junctions")
    return pairs.select(*[F.col(f"a.{c}").alias(f"a_{c}") for c in names], *[F.col(c).alias(f"b_{c}") for c in names])


def lens_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exons as lines of annotation files, in no particular order."""
    e = lens_exons(spark, sf_dir)
    told = F.create_map(F.lit("gene_id"), F.concat(F.lit("g"), F.col("gene").cast("string")), F.lit("transcript_id"), F.concat(F.lit("t"), F.col("ord").cast("string")))
    sample = (F.col("ord") % SAMPLES).cast("int").alias("sample_ord")
    return e.select("sample_id", sample, F.xxhash64("ord", "start").alias("ord"), "chrom", F.lit("lens").alias("source"), F.lit("exon").alias("feature"), "start", "end", "strand", told.alias("attributes"))


def assemble_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.array_join(F.transform("exons", lambda e: F.concat_ws("-", e["start"].cast("string"), e["end"].cast("string"))), ",")
    t = assemble(lens_lines(spark, sf_dir))
    return t.select("transcript_id", "gene_id", "chrom", "start", "end", "strand", "sample_id", F.size("exons").cast("long").alias("n_exons"), exonic_length(F.col("exons")).alias("length"), shown.alias("exons"))


def junction_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lens(spark, sf_dir).filter(F.size("junctions") > 0)
    return t.select("ord", junction_chain(F.col("chrom"), F.col("strand"), F.col("junctions")).alias("chain"))


def chain_groupby(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legacy.chain_groups(lens(spark, sf_dir)).select("chain", "members", "samples", "start", "end", "first_ord")


def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = lens(spark, sf_dir).select("ord", "chrom", "start", "end")
    r = lens_ref(spark).select("transcript_id", "chrom", "start", "end")
    return overlap_join(q, r, ["chrom"], WIDTH).select(F.col("a_ord").alias("ord"), F.col("b_transcript_id").alias("ref_transcript_id"))


def exon_semi_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = lens_ref(spark).filter("transcript_id LIKE 'c%'").select("chrom", "start", "end", "exons")
    q = lens(spark, sf_dir).select("ord", "chrom", "start", "end", "exons")
    hit = overlap_join(q, refs, ["chrom"], WIDTH).filter(exons_overlap(F.col("a_exons"), F.col("b_exons")))
    return hit.select(F.col("a_ord").alias("ord")).distinct()


def pair_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_pairs(lens(spark, sf_dir), lens_ref(spark), "ord", CFG.junction_threshold, WIDTH).select("ord", "ref_transcript_id", "code")


def best_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify_best(lens(spark, sf_dir), lens_ref(spark), "ord", CFG.junction_threshold, WIDTH)
    return out.select("ord", "class_code", "ref_transcript_id", "ref_gene_id")


def merge_pair_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = neighbours(lens(spark, sf_dir)).filter((F.size("a_exons") > 1) & (F.size("b_exons") > 1))
    return pairs.select("a_ord", "b_ord", merge_multi(side("a_"), side("b_"), CFG).alias("s")).select("a_ord", "b_ord", "s.ok", "s.status")


def mono_pair_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = neighbours(lens(spark, sf_dir).filter(F.size("exons") == 1))
    return pairs.select("a_ord", "b_ord", merge_mono(side("a_"), side("b_"), CFG).alias("s")).select("a_ord", "b_ord", "s.ok", "s.status")


def similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = neighbours(lens(spark, sf_dir)).select("a_ord", "b_ord", similarity(side("a_"), side("b_"), SIM).alias("s"))
    return pairs.select("a_ord", "b_ord", *[F.round(f"s.{c}", 6).alias(c) for c in ("structural", "junction", "jaccard", "total")])


def similarity_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered pairs of overlapping transcripts of one strand (all pairs of a gene)."""
    return similar_pairs(lens(spark, sf_dir), SIM, WIDTH)


def mode_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By gene and exon ordinal: the most frequent start and end, of equal ones the first in order of the transcripts."""
    e = lens(spark, sf_dir).select("gene", "ord", F.posexplode("exons").alias("i", "e"))
    items = F.array_sort(F.collect_list(F.struct("ord", F.col("e.start").alias("start"), F.col("e.end").alias("end"))))
    grouped = e.groupBy("gene", "i").agg(items.alias("m"))
    return grouped.select("gene", F.col("i").cast("long").alias("i"), first_mode(F.transform("m", lambda x: x["start"])).alias("start"), first_mode(F.transform("m", lambda x: x["end"])).alias("end"))


def first_per_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = first_per(F.col("members"), "sample_id")
    return _by_gene(lens(spark, sf_dir)).select("gene", F.explode(first).alias("m")).select("gene", "m.sample_id", "m.ord")


def _by_gene(t: DataFrame) -> DataFrame:
    member = F.struct("ord", "sample_id", "transcript_id", "start", "end", "strand", "exons", "junctions")
    return t.groupBy("gene", "strand").agg(F.array_sort(F.collect_list(member)).alias("members"))


def tss_tes_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _by_gene(lens(spark, sf_dir))
    m, s = F.col("members"), F.col("strand")
    picks = {"tss_longest": ("longest", True), "tss_freq": ("freq", True), "tes_longest": ("longest", False), "tes_freq": ("freq", False)}
    g = g.select("gene", *[pick_end(m, how, s, up).alias(name) for name, (how, up) in picks.items()])
    return g.select("gene", *[F.col(f"{n}.coord").alias(n) for n in picks], *[F.col(f"{n}.source").alias(f"{n}_source") for n in picks])


def scaffolds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every gene the first transcript with the most exons, and the first that starts leftmost."""
    g = _by_gene(lens(spark, sf_dir))
    most = first_most(F.col("members"), lambda x: F.size(x["exons"]))
    return g.select("gene", most["ord"].alias("most_exons"), first_least(F.col("members"), "start")["ord"].alias("leftmost"))


def _chains(spark: SparkSession) -> DataFrame:
    return lens_ref(spark).filter("transcript_id LIKE 'r%'").select(F.col("ord").alias("r_gene"), F.col("junctions").alias("r_junctions"))


def junction_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By gene and junction ordinal: how many transcripts have it and their greatest distance from the gene's chain."""
    g = _by_gene(lens(spark, sf_dir)).join(_chains(spark), F.col("gene") == F.col("r_gene"))
    j = g.select("gene", F.explode(consensus.junction_support(F.col("members"), F.col("r_junctions"))).alias("s"))
    number = lambda c: F.size(c).cast("long")
    return j.select("gene", F.col("s.j").cast("long").alias("j"), number("s.samples").alias("support"), number(F.array_distinct("s.samples")).alias("samples"), F.col("s.drift").alias("drift"))


def truncation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By gene: transcripts that lack junctions of its chain on either side, and the most that one lacks."""
    t = lens(spark, sf_dir).join(_chains(spark), F.col("gene") == F.col("r_gene"))
    member = F.array(F.struct("sample_id", "junctions"))
    t = t.select("gene", F.explode(truncations(member, F.col("r_junctions"), CFG.junction_threshold)).alias("x"))
    count = lambda c: F.sum((F.col(c) > 0).cast("long"))
    return t.groupBy("gene").agg(
        count("x.miss_5").alias("truncated_5"), count("x.miss_3").alias("truncated_3"), F.max("x.miss_5").cast("long").alias("most_5"), F.max("x.miss_3").cast("long").alias("most_3")
    )


def gene_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each transcript's component of exon overlap, named by its least transcript."""
    found = exon_roots(exons_of(lens(spark, sf_dir), "ord")).withColumnRenamed("node", "ord")
    t = lens(spark, sf_dir).select("ord")
    return t.join(found, "ord", "left").select("ord", F.coalesce("root", "ord").alias("component"))


def _as_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of the lens as if each were a merged one, labelled."""
    t = lens(spark, sf_dir).withColumn("merge_id", F.col("ord")).withColumn("sample_ids", F.array("sample_id"))
    t = t.withColumn("merge_ord", F.row_number().over(Window.partitionBy("chrom").orderBy("ord")))
    return stored(classify_best(t, lens_ref(spark), "merge_id", CFG.junction_threshold, WIDTH), "lens_labelled")


def novel_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _as_merged(spark, sf_dir).drop("transcript_id")
    return assign_ids(t, natural_order(t), "Novel").select("ord", "transcript_id")


def gene_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes of the labelled lens: ID, span, transcripts, samples."""
    t = _as_merged(spark, sf_dir).drop("gene_id")
    g = define_genes(t, "Novel")
    kept = ["chrom", "strand", "gene_id", "gene_start", "gene_end", "num_transcripts", "gene_samples"]
    out = g.select(*kept, "gene_no").distinct()
    return out.select(*kept[:-1], F.col("gene_samples").cast("long").alias("gene_samples"))


def ref_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference transcripts whose ID no transcript inherits."""
    told = F.create_map(F.lit("transcript_id"), F.col("transcript_id"))
    left = sinks.unused_reference(lens_ref(spark).withColumn("attributes", told), best_codes(spark, sf_dir))
    return left.select("transcript_id", "gene_id")


def manifest_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("sample_id"))
    return duplicate_samples(samples)


def attr_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of GTF-like text made from parts: a repeated key, a part without a value, blanks around."""
    text = F.concat(
        F.lit('gene_id "'), F.col("p_brand"), F.lit('"; transcript_id "'), F.col("p_type"), F.lit('";  bad; gene_id "g'), F.col("p_size").cast("string"), F.lit('"; note "two words";')
    )
    a = table(spark, sf_dir, "part").select("p_partkey", parse_attributes(text).alias("a"))
    return a.select("p_partkey", *[F.element_at("a", k).alias(k) for k in ("gene_id", "transcript_id", "note", "bad")], F.size("a").cast("long").alias("n"))


def sample_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = F.size(first_per(F.col("members"), "sample_id"))
    g = _by_gene(lens(spark, sf_dir))
    return g.select("gene", samples.cast("long").alias("samples"), F.size("members").cast("long").alias("transcripts"), consensus.frequency(samples, SAMPLES).alias("freq"))


def chain_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over the groups of equal chains: members, groups, mean size, groups of one."""
    chains = junction_chains(spark, sf_dir).withColumnRenamed("chain", "cluster_no")
    return cluster_totals(chains).select(F.col("inputs").alias("members"), F.col("clusters").alias("groups"), "avg_size", "singletons")


def _shared_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts that share IDs: orders modulo 997."""
    return lens(spark, sf_dir).withColumn("transcript_id", F.concat(F.lit("x"), (F.col("ord") % 997).cast("string")))


def occurrence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences(_shared_ids(spark, sf_dir)).select("transcript_id", F.col("n_occurrences").alias("n"))


def reference_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By chromosome: transcripts whose ID is a reference's, and others."""
    refs = lens_ref(spark).withColumn("transcript_id", F.regexp_replace("transcript_id", "^[rc]", "t"))
    t = mark_reference(lens(spark, sf_dir).select("transcript_id", "chrom"), refs)
    return t.groupBy("chrom").agg(F.count_if("is_ref").alias("refs"), F.count_if(~F.col("is_ref")).alias("others"))


def reference_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of transcripts that share an ID the last."""
    return reference(_shared_ids(spark, sf_dir)).select(F.col("transcript_id").alias("id"), "ord", "start", "end")


def chrom_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Natural order of names made from orders (chr1, chr2, chr10, chrX...)."""
    n = F.col("o_custkey") % 23
    name = F.concat(F.lit("chr"), F.when(n == 0, "X").when(n == 22, "M").otherwise(n.cast("string")))
    out = natural_order(table(spark, sf_dir, "orders").select(name.alias("chrom")).distinct())
    return out.select("chrom", F.col("chrom_ord").cast("long").alias("chrom_ord"))


def strand_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By chromosome and strand: transcripts, single-exon ones, exonic bases, first transcript."""
    return (
        lens(spark, sf_dir)
        .groupBy("chrom", "strand")
        .agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.size("exons") == 1, 1)).alias("mono"), F.sum(exonic_length(F.col("exons"))).alias("bases"), F.min("ord").alias("first_ord"))
    )


def exon_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GTF lines of all exons."""
    t = lens(spark, sf_dir).select("transcript_id", "gene_id", "chrom", "strand", F.posexplode("exons").alias("i", "e"))
    told = F.concat_ws("; ", *[sinks.attribute(k, v) for k, v in (("gene_id", F.col("gene_id")), ("transcript_id", F.col("transcript_id")), ("exon_number", (F.col("i") + 1).cast("string")))])
    return t.select(sinks.gtf_line(F.col("chrom"), "lens", "exon", F.col("e.start"), F.col("e.end"), F.col("strand"), told).alias("line"))


def _spans(spark: SparkSession, sf_dir: str, minutes: int) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("start"))
    return e.withColumn("end", F.col("start") + minutes * 60_000_000)


def event_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events that are at most two hours apart."""
    t = islands(_spans(spark, sf_dir, 120), ["user_id"], F.col("start"), F.col("end"), tie="event_id", stretch=86_400_000_000)
    return t.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("start"), F.max("end").alias("end"))


def event_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a user's events within two hours of each other."""
    t = _spans(spark, sf_dir, 120)
    return self_overlap(t, ["user_id"], "event_id", 4 * 3_600_000_000).filter("a_event_id < b_event_id").select("a_event_id", "b_event_id")


def penalty_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = neighbours(lens(spark, sf_dir))
    s = penalty_score(F.col("a_junctions"), F.col("b_junctions"), CFG.junction_threshold)
    return pairs.select("a_ord", "b_ord", s.alias("s")).select("a_ord", "b_ord", "s.mergeable", "s.kind", "s.score")


def penalty_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lens(spark, sf_dir).drop("gene")
    roots = legacy.penalty_components(t, CFG.junction_threshold, 90.0, WIDTH)
    return legacy.penalty_consensus(t, roots, CFG.junction_threshold)


def reference_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legacy.reference_ladder(lens(spark, sf_dir), lens_ref(spark), "ord", 0, WIDTH)


def matched_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest matches of every transcript's junctions with its gene's chain: how many, first and last, total error."""
    t = lens(spark, sf_dir).join(_chains(spark), F.col("gene") == F.col("r_gene"))
    t = t.select("ord", match_nearest(F.col("junctions"), F.col("r_junctions"), CFG.junction_threshold).alias("m")).filter(F.size("m") > 0)
    js = F.transform("m", lambda p: p["j"])
    error = F.aggregate("m", F.lit(0).cast("bigint"), lambda n, p: n + p["err"])
    return t.select("ord", F.size("m").cast("long").alias("matches"), F.array_min(js).cast("long").alias("first"), F.array_max(js).cast("long").alias("last"), error.alias("error"))


def greedy_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_clusters(lens(spark, sf_dir), CFG).select("ord", "seed", "mono", "status")


def greedy_mono(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_mono_exon(lens(spark, sf_dir).filter(F.size("exons") == 1), CFG)


def greedy_mono_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legacy.merge_mono_legacy(lens(spark, sf_dir).filter(F.size("exons") == 1))


def similarity_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lens(spark, sf_dir).drop("gene").withColumn("attributes", F.lit(None).cast("map<string,string>"))
    refs = lens_ref(spark).withColumn("sample_id", F.lit("ref")).withColumn("attributes", F.lit(None).cast("map<string,string>"))
    return sinks.cluster_table(cluster_transcripts(t, SIM, refs.select(*t.columns)))


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lens(spark, sf_dir).drop("gene")
    return merge_transcripts(t, CFG, SAMPLES, natural_order(t), lens_ref(spark))


def tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.tracking(_merged(spark, sf_dir))


def merged_gtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.gtf_lines(_merged(spark, sf_dir)).select("chrom_ord", "gene_start", "gene_no", "line")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        assemble_transcripts, junction_chains, chain_groupby, overlap_pairs, exon_semi_overlap, pair_codes, best_codes, merge_pair_status, mono_pair_status,
        similarity_pairs, similarity_table, mode_consensus, first_per_sample, tss_tes_pick, scaffolds, junction_support, truncation_counts, gene_components, novel_ids,
        gene_spans, ref_only, manifest_dupes, attr_parse, sample_freq, chain_stats, occurrence_counts, reference_members, reference_dedup, chrom_order, strand_groups,
        exon_lines, event_islands, event_overlaps, penalty_pairs, penalty_consensus, reference_ladder, matched_junctions, greedy_merge, greedy_mono, greedy_mono_legacy,
        similarity_clusters, tracking, merged_gtf,
    )
}
