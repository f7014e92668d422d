"""Representatives of clusters: one shuffle brings a cluster's members into an array in merge order; everything else is Column expressions over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isolume.config import MergeConfig
from isolume.functions.arrays import first_least, first_mode, first_most, first_per
from isolume.functions.kernels import bound, coord_error, junctions_of, match_nearest, tes, tss

MEMBER = ("sample_id", "transcript_id", "start", "end", "strand", "exons", "junctions")


def members_of(clusters: DataFrame) -> DataFrame:
    """(chrom, strand, seed, mono, status, members): members in the order in which they were placed, the seed first."""
    place = F.when(F.col("mono"), F.struct(F.col("start").alias("a"), F.lit(0).cast("bigint").alias("b"), F.col("ord").alias("c"))).otherwise(
        F.struct((-F.size("junctions")).cast("bigint").alias("a"), (-F.col("length")).alias("b"), F.col("ord").alias("c"))
    )
    item = F.struct(place.alias("place"), *MEMBER)
    grouped = clusters.groupBy("chrom", "strand", "seed", "mono", "status").agg(F.array_sort(F.collect_list(item)).alias("members"), F.min("ord").alias("first_ord"))
    return grouped.withColumn("seed_place", F.col("members")[0]["place"])


def pick_end(members: Column, strategy: str, strand: Column, upstream: bool) -> Column:
    """struct<coord, source> of the start (upstream) or end of transcription.

    longest: the extreme coordinate and the first member that has it. Other strategies: the most frequent
    coordinate, with the first member's sample whether or not it has it. Here only + is plus.
    """

    def at(field: str, low: bool) -> Column:
        if strategy == "longest":
            best = first_least(members, field) if low else first_most(members, lambda m: m[field])
            return bound(best, lambda m: F.struct(m[field].alias("coord"), m["sample_id"].alias("source")))
        return F.struct(first_mode(F.transform(members, lambda m: m[field])).alias("coord"), F.element_at(members, 1)["sample_id"].alias("source"))

    plus = at("start", True) if upstream else at("end", False)
    other = at("end", False) if upstream else at("start", True)
    return F.when(strand == "+", plus).otherwise(other)


def representative_exons(members: Column, strand: Column, tss_coord: Column, tes_coord: Column, fix_minus: bool = False) -> Column:
    """Exons by vote: the first member with the most exons says how many; each ordinal's start and end are the modes.

    The outer coordinates are the chosen ends. Without fix_minus they are set on minus-strand and unknown-strand
    clusters as the compatible behaviour has it: the first exon ends at the start of transcription and the last
    one starts at its end.
    """
    n = F.array_max(F.transform(members, lambda m: F.size(m["exons"])))

    def exon(i: Column) -> Column:
        have = F.filter(members, lambda m: F.size(m["exons"]) > i)
        first, last = i == 0, i == n - 1
        start = first_mode(F.transform(have, lambda m: F.get(m["exons"], i)["start"]))
        end = first_mode(F.transform(have, lambda m: F.get(m["exons"], i)["end"]))
        if fix_minus:
            start = F.when((strand == "+") & first, tss_coord).when((strand != "+") & first, tes_coord).otherwise(start)
            end = F.when((strand == "+") & last, tes_coord).when((strand != "+") & last, tss_coord).otherwise(end)
        else:
            start = F.when((strand == "+") & first, tss_coord).when((strand != "+") & last, tes_coord).otherwise(start)
            end = F.when((strand == "+") & last, tes_coord).when((strand != "+") & first, tss_coord).otherwise(end)
        return F.struct(start.alias("start"), end.alias("end"), strand.alias("strand"))

    return F.filter(F.transform(F.sequence(F.lit(0), n - 1), exon), lambda e: e["start"] < e["end"])


def junction_support(members: Column, junctions: Column) -> Column:
    """array<struct<j, samples, drift>>: by ordinal, the members that have the junction and their greatest distance from it."""

    def of(junction: Column, j: Column) -> Column:
        have = F.filter(members, lambda m: F.size(m["junctions"]) > j)
        drift = F.array_max(F.transform(have, lambda m: coord_error(junction, F.get(m["junctions"], j))))
        return F.struct(j.alias("j"), F.transform(have, lambda m: m["sample_id"]).alias("samples"), drift.alias("drift"))

    return F.filter(F.transform(junctions, of), lambda s: F.size(s["samples"]) > 0)


def truncations(members: Column, junctions: Column, threshold: int) -> Column:
    """array<struct<sample_id, miss_5, miss_3>> of members with fewer junctions than the representative that match it somewhere."""
    n = F.size(junctions)
    short = F.filter(members, lambda m: F.size(m["junctions"]) < n)

    def of(m: Column) -> Column:
        return bound(
            F.transform(match_nearest(junctions, m["junctions"], threshold), lambda p: p["i"]),
            lambda i: F.when(F.size(i) > 0, F.struct(m["sample_id"].alias("sample_id"), F.array_min(i).alias("miss_5"), (n - 1 - F.array_max(i)).alias("miss_3"))),
        )

    return F.array_compact(F.transform(short, of))


def _spread(values: Column, from_: Column) -> Column:
    away = F.transform(values, lambda v: F.abs(v - from_))
    return F.concat(F.array_min(away).cast("string"), F.lit("-"), F.array_max(away).cast("string"), F.lit("bp"))


def frequency(n_samples: Column, total_samples: int) -> Column:
    """The share of all samples, to four places (half to even)."""
    return F.bround(n_samples / max(total_samples, 1), 4)


def build_merged(clusters: DataFrame, cfg: MergeConfig, total_samples: int) -> DataFrame:
    """One row for each cluster: representative, provenance by sample, and how far the members are from it."""
    c = members_of(clusters).withColumn("uniq", first_per(F.col("members"), "sample_id"))
    uniq, strand = F.col("uniq"), F.col("strand")
    c = c.withColumn("tss", pick_end(uniq, cfg.tss_strategy, strand, True)).withColumn("tes", pick_end(uniq, cfg.tes_strategy, strand, False))
    c = c.withColumn("tss_coord", F.col("tss.coord")).withColumn("tes_coord", F.col("tes.coord"))
    c = c.withColumn("exons", representative_exons(uniq, strand, F.col("tss_coord"), F.col("tes_coord"), cfg.fix_minus_strand))
    c = c.withColumn("junctions", F.transform(junctions_of(F.col("exons")), lambda j: F.struct(j["donor"].alias("donor"), j["acceptor"].alias("acceptor"), strand.alias("strand"))))
    c = c.withColumn("support", junction_support(uniq, F.col("junctions")))
    c = c.withColumn("lost", truncations(uniq, F.col("junctions"), cfg.junction_threshold))
    n, samples = F.size("junctions"), F.transform(uniq, lambda m: m["sample_id"])
    drifted = F.size(F.filter("support", lambda s: s["drift"] > 0))
    lost = lambda f: F.filter("lost", lambda x: x[f] > 0)
    named = lambda f, word: F.nullif(F.array_join(F.transform(lost(f), lambda x: F.concat(x["sample_id"], F.lit(f":{word}_"), x[f].cast("string"))), ";"), F.lit(""))
    out = c.select(
        "chrom",
        "strand",
        "seed",
        "mono",
        "first_ord",
        "seed_place",
        F.least("tss_coord", "tes_coord").alias("start"),
        F.greatest("tss_coord", "tes_coord").alias("end"),
        "exons",
        "junctions",
        F.transform(uniq, lambda m: F.concat_ws(":", m["sample_id"], m["transcript_id"])).alias("source_transcripts"),
        samples.alias("sample_ids"),
        F.size(uniq).alias("num_samples"),
        F.col("status").alias("merge_status"),
        F.transform(samples, lambda s: F.struct(s.alias("sample"), F.col("status").alias("status"))).alias("per_sample_status"),
        "tss_coord",
        "tes_coord",
        F.col("tss.source").alias("tss_source"),
        F.col("tes.source").alias("tes_source"),
        _spread(F.transform(uniq, lambda m: tss(m["start"], m["end"], m["strand"])), F.col("tss_coord")).alias("tss_diff_range"),
        _spread(F.transform(uniq, lambda m: tes(m["start"], m["end"], m["strand"])), F.col("tes_coord")).alias("tes_diff_range"),
        F.size(lost("miss_5")).alias("truncation_5_count"),
        F.size(lost("miss_3")).alias("truncation_3_count"),
        named("miss_5", "first").alias("missing_junctions_5"),
        named("miss_3", "last").alias("missing_junctions_3"),
        F.col("support").alias("per_junction_support"),
        drifted.alias("diff_junction_count"),
        F.bround(F.when(n > 0, drifted / n).otherwise(0.0), 4).alias("diff_junction_ratio"),
        frequency(F.size(uniq), total_samples).alias("freq_score"),
        F.when(strand == ".", "unknown").otherwise("known").alias("strand_status"),
    )
    return out.filter(F.col("num_samples") >= cfg.min_samples)
