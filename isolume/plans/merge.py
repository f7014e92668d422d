"""The merge plan: samples in, consolidated and labelled transcripts with genes out."""

from __future__ import annotations

import logging
import time
from dataclasses import asdict
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isolume.config import MergeConfig
from isolume.operators.classify import classify_best, reference
from isolume.operators.consensus import build_merged
from isolume.operators.genes import define_genes, genes_of
from isolume.operators.greedy import merge_clusters
from isolume.operators.ids import assign_ids, merge_order
from isolume.plans.checkpoint import Staged
from isolume.sources import gtf, sinks
from isolume.sources.manifest import read_manifest, validate
from isolume.storage import stored

log = logging.getLogger("isolume")


def consolidate(transcripts: DataFrame, cfg: MergeConfig, total_samples: int) -> DataFrame:
    """Merged transcripts with merge_id (that of the founding transcript) and merge_ord, before labels."""
    if cfg.min_transcript_len:
        transcripts = transcripts.filter(F.aggregate("exons", F.lit(0).cast("bigint"), lambda n, e: n + e["end"] - e["start"]) >= cfg.min_transcript_len)
    merged = stored(build_merged(merge_clusters(transcripts, cfg), cfg, total_samples), "consensus")
    return merge_order(merged).withColumn("merge_id", F.col("seed"))


def merge_transcripts(transcripts: DataFrame, cfg: MergeConfig, total_samples: int, chrom_order: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """The whole plan on DataFrames: merged transcripts with labels, IDs and genes."""
    merged = stored(classify_best(consolidate(transcripts, cfg, total_samples), refs, "merge_id", cfg.junction_threshold), "classified")
    merged = stored(assign_ids(merged, chrom_order, cfg.novel_prefix), "labelled")
    return define_genes(merged, cfg.novel_prefix)


#: Settings that don't change results.
NOT_RESULTS = ("resume", "force", "sharded", "at_once", "checkpoint_dir", "output", "output_extended")


def _together(sizes: list[tuple[str, int]], most: int) -> list[list[str]]:
    """Chromosomes in order, as many at once as have `most` transcripts (a larger one alone): each lot is a resume point."""
    lots: list[list[str]] = []
    held = 0
    for chrom, n in sizes:
        if not lots or held + n > most:
            lots.append([])
            held = 0
        lots[-1].append(chrom)
        held += n
    return lots


def run_merge(spark: SparkSession, cfg: MergeConfig, base: str = "") -> dict[str, int]:
    """Reads a manifest, writes <output>.gtf, _tracking.tsv, _summary.txt and, if asked, _extended.gtf; returns the totals.

    Chromosomes are merged in lots of about cfg.at_once transcripts, and each lot's results are staged and marked in
    the checkpoint folder; a resumed run makes only the chromosomes that are not there. IDs depend on a chromosome's
    place among all, so neither lots nor resuming change them. cfg.sharded writes folders of ordered parts instead
    of single files.
    """
    began = time.time()
    samples = read_manifest(spark, cfg.input, base)
    n_samples = samples.count()
    if not n_samples:
        raise ValueError("no samples in the manifest")
    if errors := validate(samples, cfg.ref_gtf):
        raise ValueError("; ".join(errors))
    every = gtf.read_lines(spark, samples, features=None)
    chrom_order = gtf.natural_order(gtf.chromosomes(every))
    point = Staged(spark, cfg.checkpoint_dir, {k: v for k, v in asdict(cfg).items() if k not in NOT_RESULTS})
    if cfg.force or not cfg.resume:
        point.clear()
    transcripts = stored(gtf.assemble(every), "transcripts", "chrom")
    refs = stored(reference(gtf.read_transcripts(spark, gtf.one_file(spark, cfg.ref_gtf))), "reference") if cfg.ref_gtf else None
    done = point.done()
    log.info("%d samples, %d chromosomes, %d done before", n_samples, chrom_order.count(), len(done))

    counts = transcripts.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))
    sizes = chrom_order.join(counts, "chrom", "left").orderBy("chrom_ord").collect()  # a row for each chromosome
    schema = None
    for chroms in _together([(r.chrom, r.n or 0) for r in sizes if r.chrom not in done], cfg.at_once):
        fresh = merge_transcripts(transcripts.filter(F.col("chrom").isin(*chroms)), cfg, n_samples, chrom_order, refs)
        schema = fresh.schema
        point.write(fresh, chroms)
    schema = schema or merge_transcripts(transcripts.limit(0), cfg, n_samples, chrom_order, refs).schema
    merged = point.read(schema, [r.chrom for r in sizes])

    head = ["##gtf-version 2.2", "##generated-by isolume", f"##date {datetime.now().isoformat()}"]
    write = sinks.write_parts if cfg.sharded else sinks.write_one
    write(sinks.ordered_gtf(merged), f"{cfg.output}.gtf", head)
    table = sinks.tracking(merged).orderBy("chrom_ord", "merge_ord")
    write(sinks.tsv(table, sinks.TRACKING), f"{cfg.output}_tracking.tsv", ["\t".join(sinks.TRACKING)])
    if cfg.output_extended and cfg.ref_gtf:
        lines = gtf.read_lines(spark, gtf.one_file(spark, cfg.ref_gtf))
        write(sinks.extended_gtf(merged, lines), f"{cfg.output}_extended.gtf", head)
    totals = {"samples": n_samples, "input": transcripts.count(), "merged": merged.count(), "genes": genes_of(merged).count()}
    report(f"{cfg.output}_summary.txt", "Merge", began, totals)
    return totals


def report(path: str, title: str, began: float, totals: dict) -> str:
    """A short report, saved and returned."""
    rows = [f"{title} summary", f"Date: {datetime.now():%Y-%m-%d %H:%M:%S}", f"Elapsed: {time.time() - began:.1f}s", *[f"{k}: {v:,}" for k, v in totals.items()]]
    text = "\n".join(rows)
    with open(path, "w") as f:
        f.write(text + "\n")
    return text
