"""Transcripts from junction lists, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from isolume.schema import TRANSCRIPT


def exons_of(junctions, start, end):
    edges = [start, *(x for j in junctions for x in j), end]
    return [(edges[i], edges[i + 1]) for i in range(0, len(edges), 2)]


def row(junctions, strand="+", chrom="chr1", start=100, end=2000, sample="S1", tid=None, ord=0, exons=None, gene="G1"):
    xs = exons if exons is not None else exons_of(junctions, start, end)
    return (
        tid or f"t_{sample}", gene, chrom, start, end, strand, sample, ord,
        [(a, b, strand) for a, b in xs], [(x[1], y[0], strand) for x, y in zip(xs, xs[1:], strict=False)], {},
    )


def frame(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(list(rows), TRANSCRIPT)


def pairs(spark: SparkSession, cases) -> DataFrame:
    """(case, a_*, b_*) of a list of pairs of rows."""
    fields = [x.split(" ", 1) for x in TRANSCRIPT.split(", ")]
    kind = "struct<" + ", ".join(f"{n}: {t}" for n, t in fields) + ">"
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], f"case int, a {kind}, b {kind}")
    return df.select("case", *[df[s][n].alias(f"{s}_{n}") for s in "ab" for n, _ in fields])
