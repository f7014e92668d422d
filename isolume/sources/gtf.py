"""GTF scans: lines, attributes, and transcripts assembled from them.

Files may be gzipped (by suffix). A line has nine tab-separated fields; comments
and shorter lines are left out. Start and end become 0-based and half-open.
Lines are numbered by sample and place in the file, so that everything that
depends on input order is repeatable.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isolume.functions.kernels import junctions_of
from isolume.sources.manifest import stem
from isolume.storage import file_system, stored

#: ord = sample_ord * LINES + place in the file's bytes and splits.
LINES = 1 << 40
FEATURES = ("transcript", "exon")
#: Splits (about 30 bytes each) up to which their places are broadcast.
BROADCAST_SPLITS = 500_000


def parse_attributes(text: Column) -> Column:
    """map<string,string> of `key "value"; ...`: of a repeated key the last value, parts without a blank are left out."""
    parts = F.filter(F.transform(F.split(F.rtrim(F.trim(text), F.lit(";")), ";"), lambda x: F.trim(x)), lambda p: F.instr(p, " ") > 0)
    pairs = F.transform(parts, lambda p: F.struct(F.substring_index(p, " ", 1).alias("k"), F.trim(F.substr(p, F.instr(p, " ") + 1), F.lit('"')).alias("v")))
    last = F.filter(pairs, lambda p, i: F.size(F.filter(pairs, lambda q, j: (q["k"] == p["k"]) & (j > i))) == 0)
    return F.map_from_entries(last)


def _one_slash(uri: Column) -> Column:
    """Local files are named file:/ or file:/// by turns."""
    return F.regexp_replace(uri, "^file:/+", "file:/")


def resolved(spark: SparkSession, path: str) -> str:
    """A file's full name as the scan's metadata has it: scheme, authority and place, encoded."""
    files, at = file_system(spark, path)
    uri = spark._jvm.org.apache.spark.paths.SparkPath.fromPath(files.makeQualified(at)).urlEncoded()
    return re.sub("^file:/+", "file:/", uri)


def read_lines(spark: SparkSession, samples: DataFrame, features: tuple[str, ...] | None = FEATURES, chrom: str | None = None) -> DataFrame:
    """(sample_id, sample_ord, ord, chrom, source, feature, start, end, strand, attributes) of all samples' files.

    A file's lines belong to the samples whose path resolves to that very file. The numbering is made once and
    stored: a line's split and place in it name its place in the file.
    """
    manifest = samples.select("sample_ord", "sample_id", "gtf_path").collect()  # a line for each sample
    paths = [r.gtf_path for r in manifest]
    if not paths:
        empty = "sample_id string, sample_ord int, ord bigint, chrom string, source string, feature string, start bigint, end bigint, strand string, attributes map<string,string>"
        return spark.createDataFrame([], empty)
    named = spark.createDataFrame([(r.sample_ord, r.sample_id, resolved(spark, r.gtf_path)) for r in manifest], "sample_ord int, sample_id string, path string")
    raw = spark.read.text(sorted(set(paths)))
    raw = raw.select("value", _one_slash(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    raw = raw.join(F.broadcast(named), "path")
    cells = F.split("value", "\t", -1)
    rows = raw.filter(~F.startswith("value", F.lit("#"))).withColumn("cells", cells).filter(F.size("cells") >= 9)
    rows = rows.select(
        "sample_id",
        "sample_ord",
        "path",
        "block",
        "line",
        F.col("cells")[0].alias("chrom"),
        F.col("cells")[1].alias("source"),
        F.col("cells")[2].alias("feature"),
        (F.col("cells")[3].cast("bigint") - 1).alias("start"),
        F.col("cells")[4].cast("bigint").alias("end"),
        F.col("cells")[6].alias("strand"),
        F.when(F.size("cells") == 9, F.col("cells")[8]).otherwise(F.raise_error(F.concat(F.lit("a line has more than nine fields: "), "value"))).alias("text"),
    )
    if chrom is not None:
        rows = rows.filter(F.col("chrom") == chrom)
    if features is not None:
        rows = rows.filter(F.col("feature").isin(*features))
    rows = stored(rows.withColumn("attributes", parse_attributes(F.col("text"))).drop("text"), "gtf_lines")
    # Within one file splits are in order of their first byte and lines in order of their number: two sums make one place.
    sizes = rows.groupBy("sample_ord", "block").agg(F.min("line").alias("first"), (F.max("line") - F.min("line") + 1).alias("n"))
    before = Window.partitionBy("sample_ord").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    sizes = stored(sizes, "gtf_splits")
    placed = rows.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_SPLITS else sizes, ["sample_ord", "block"])
    number = F.col("sample_ord").cast("bigint") * LINES + F.col("before") + F.col("line") - F.col("first")
    return placed.select("sample_id", "sample_ord", number.alias("ord"), "chrom", "source", "feature", "start", "end", "strand", "attributes")


def assemble(lines: DataFrame) -> DataFrame:
    """Transcripts of (sample, chrom, transcript_id): exons in order of start, and the junctions between them.

    A transcript without a transcript line spans its exons; one without exons is left out. Only + and - are strands
    of a transcript, anything else is '.'; exons keep what the line says. The order of the lines doesn't matter.
    """
    named = lines.filter(F.col("feature").isin(*FEATURES)).withColumn("transcript_id", F.coalesce(F.element_at("attributes", "transcript_id"), F.lit("")))
    named = named.filter((F.col("feature") == "transcript") | (F.col("transcript_id") != ""))
    told, exon = F.col("feature") == "transcript", F.col("feature") == "exon"
    head = F.struct("start", "end", "strand", "attributes")
    out = named.groupBy("sample_id", "sample_ord", "chrom", "transcript_id").agg(
        F.max_by(F.when(told, head), F.when(told, F.col("ord"))).alias("t"),
        F.min_by(F.when(exon, head), F.when(exon, F.col("ord"))).alias("e"),
        F.min("ord").alias("ord"),
        F.min(F.when(exon, F.col("start"))).alias("first"),
        F.max(F.when(exon, F.col("end"))).alias("last"),
        F.array_sort(F.collect_list(F.when(exon, F.struct("start", "ord", "end", "strand")))).alias("found"),
    )
    out = out.filter(F.size("found") > 0).withColumn("head", F.coalesce("t", "e"))
    exons = F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["strand"].alias("strand")))
    out = out.withColumn("exons", exons).filter(F.col("t").isNotNull() | (F.coalesce(F.element_at("head.attributes", "gene_id"), F.lit("")) != ""))
    return out.select(
        "transcript_id",
        F.coalesce(F.element_at("head.attributes", "gene_id"), F.lit("")).alias("gene_id"),
        "chrom",
        F.when(F.col("t").isNotNull(), F.col("t.start")).otherwise(F.col("first")).alias("start"),
        F.when(F.col("t").isNotNull(), F.col("t.end")).otherwise(F.col("last")).alias("end"),
        F.when(F.col("head.strand").isin("+", "-"), F.col("head.strand")).otherwise(".").alias("strand"),
        "sample_id",
        "ord",
        "exons",
        junctions_of(F.col("exons")).alias("junctions"),
        F.col("head.attributes").alias("attributes"),
    )


def read_transcripts(spark: SparkSession, samples: DataFrame, chrom: str | None = None) -> DataFrame:
    return assemble(read_lines(spark, samples, chrom=chrom))


def one_file(spark: SparkSession, path: str, sample_ord: int = 0) -> DataFrame:
    """A manifest of a single file."""
    from isolume.schema import MANIFEST

    return spark.createDataFrame([(sample_ord, path, stem(path), "no_cap", 1, "")], MANIFEST)


def is_gtf(path: str) -> bool:
    """Whether an input is a GTF file by its suffix (else it is a manifest)."""
    suffix = path[path.rfind(".") :] if "." in path.rsplit("/", 1)[-1] else ""
    return suffix in (".gtf", ".gz") or "gtf" in suffix.lower()


def chromosomes(lines: DataFrame) -> DataFrame:
    """(chrom, first_ord): names in the order in which they are first seen."""
    return lines.groupBy("chrom").agg(F.min("ord").alias("first_ord"))


def natural_key(chrom: str) -> list[tuple]:
    """Numbers by value, before names; chr is left out."""
    return [(0, int(p), "") if p.isdigit() else (1, 0, p) for p in re.split(r"(\d+)", chrom.replace("chr", "")) if p]


def natural_order(chroms: DataFrame) -> DataFrame:
    """(chrom, chrom_ord) in natural order; a genome has few names, so they are sorted on the driver."""
    names = [r.chrom for r in chroms.select("chrom").distinct().collect()]
    rows = [(c, i) for i, c in enumerate(sorted(names, key=lambda c: (natural_key(c), c)))]
    return chroms.sparkSession.createDataFrame(rows, "chrom string, chrom_ord int")
