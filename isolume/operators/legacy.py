"""The earlier model's operators: chain groups, penalty scores and their graph, mono-exon merging, and the reference ladder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isolume.functions.arrays import first_mode
from isolume.functions.kernels import junction_chain, match_nearest, penalty_score, side
from isolume.operators.greedy import PLACED, _gapless, _grouped, first_fit, nearest
from isolume.operators.interval import BIN, islands, overlap_join, transcript_islands
from isolume.storage import stored


def chain_groups(t: DataFrame) -> DataFrame:
    """Multi-exon transcripts grouped by identical junction chain: members, samples, drift-free by definition (anchor)."""
    chain = junction_chain(F.col("chrom"), F.col("strand"), F.col("junctions"))
    grouped = t.filter(F.size("junctions") > 0).withColumn("chain", chain).groupBy("chain", "chrom", "strand")
    return grouped.agg(
        F.count(F.lit(1)).alias("members"),
        F.count_distinct("sample_id").alias("samples"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.min("ord").alias("first_ord"),
    ).withColumn("anchor", F.lit(True))


def penalty_pairs(t: DataFrame, threshold: int, bin_width: int | None = BIN, **penalties) -> DataFrame:
    """(a_ord, b_ord, mergeable, kind, score) of pairs of one chromosome and strand that overlap or touch, the earlier first."""
    closed = t.withColumn("end", F.col("end") + 1)  # spans that only touch count
    pairs = overlap_join(closed, closed, ["chrom", "strand"], bin_width).filter("a_ord < b_ord")
    score = penalty_score(F.col("a_junctions"), F.col("b_junctions"), threshold, **penalties)
    return pairs.select("a_ord", "b_ord", score.alias("s")).select("a_ord", "b_ord", "s.mergeable", "s.kind", "s.score")


def _links(a: list, b: list, threshold: int, min_score: float, per_bp: float = 1.0, trunc5: float = 0.0, trunc3: float = 5.0, retention: float = 50.0, min_shared: int = 1) -> bool:
    """Whether penalty_score finds a pair mergeable and gives it at least min_score."""
    links = nearest(a, b, threshold)
    if len(links) < max(min_shared, 1) or not (_gapless([j for _, j, _ in links]) and _gapless([i for i, _, _ in links])):
        return False
    return max(0.0, 100.0 - sum(e for _, _, e in links) * per_bp - links[0][0] * trunc5 - (len(a) - 1 - links[-1][0]) * trunc3) >= min_score


def _linked(rows: list[dict], link: Callable[[list, list], bool]) -> list[tuple]:
    """(ord, root) of an island's shapes: each goes through the components met before it, up to the first member that it is linked to."""
    parts: list[list[dict]] = []
    for r in sorted((r for r in rows if link(r["j"], r["j"])), key=lambda r: r["ord"]):
        near = lambda p: p["start"] <= r["end"] and r["start"] <= p["end"] and (link(p["j"], r["j"]) or (r["ord"] < p["last"] and link(r["j"], p["j"])))  # noqa: B023, E731
        apart, joined = [], [r]
        for part in parts:
            if any(near(p) for p in part):
                joined += part
            else:
                apart.append(part)
        parts = [*apart, joined]
    return [(p["ord"], min(q["ord"] for q in part)) for part in parts for p in part]


def penalty_components(t: DataFrame, threshold: int, min_score: float, bin_width: int | None = BIN, **penalties) -> DataFrame:
    """(ord, root): transcripts linked by mergeable pairs of at least min_score; others are their own root.

    Transcripts of one span and chain are one shape, which links to itself at 100 points if it links to anything, so
    components are found over shapes, island by island, and a pair that hangs together already isn't scored. Of two
    shapes the one that has an earlier transcript than the other's last may be the pair's first.
    """
    shape = ["chrom", "strand", "start", "end", "junctions"]
    t = stored(t.select("ord", *shape), "penalty_input")
    shapes = t.filter((F.size("junctions") > 0) & (F.col("start") <= F.col("end"))).groupBy(*shape).agg(F.min("ord").alias("first"), F.max("ord").alias("last"))
    shapes = stored(shapes.withColumnRenamed("first", "ord").withColumn("exons", F.array().cast("array<struct<start:bigint,end:bigint,strand:string>>")), "penalty_shapes")
    found = islands(shapes, ["chrom", "strand"], F.col("start"), F.col("end"))  # spans that only touch share an island
    roots = _grouped(found, lambda rows: _linked(rows, lambda a, b: _links(a, b, threshold, min_score, **penalties)), ("last",), "first bigint, root bigint")
    rooted = shapes.withColumnRenamed("ord", "first").join(roots, "first").select(*shape, "root")
    return t.join(rooted, shape, "left").select("ord", F.coalesce("root", "ord").alias("root"))


def penalty_consensus(t: DataFrame, roots: DataFrame, threshold: int, **penalties) -> DataFrame:
    """Of every component: its representative (most junctions, earliest), the mean score of its samples against it, and the commonest kind."""
    m = t.join(roots, "ord")
    rep = m.groupBy("root").agg(F.min_by(F.struct("ord", "junctions"), F.struct(-F.size("junctions"), F.col("ord"))).alias("rep"), F.count(F.lit(1)).alias("members"))
    first = F.row_number().over(Window.partitionBy("root", "sample_id").orderBy("ord"))
    each = m.withColumn("n", first).filter("n = 1").join(rep, "root")
    each = each.withColumn("s", penalty_score(F.col("rep.junctions"), F.col("junctions"), threshold, **penalties))
    out = each.groupBy("root", "members").agg(
        F.first("rep.ord").alias("representative"),
        F.avg("s.score").alias("avg_score"),
        F.array_sort(F.collect_list(F.struct("ord", F.col("s.kind").alias("kind")))).alias("kinds"),
        F.count(F.lit(1)).alias("samples"),
    )
    kind = F.when(F.col("members") == 1, "singleton").otherwise(first_mode(F.transform("kinds", lambda k: k["kind"])))
    return out.select("root", "representative", "members", "samples", F.when(F.col("members") == 1, 100.0).otherwise(F.col("avg_score")).alias("avg_score"), kind.alias("kind"))


def mono_likeness(seed: dict, t: dict, overlap: float, three: int, five: int) -> str | None:
    """Status of a mono-exon pair in the earlier model: equal exons always merge."""
    (a, b), (c, d) = seed["x"][0][:2], t["x"][0][:2]
    shorter = min(b - a, d - c)
    if shorter == 0:
        return None
    left, right = abs(a - c), abs(b - d)
    if left == right == 0:
        return "monoexon_exact"
    d5, d3 = {"+": (left, right), "-": (right, left)}.get(seed["strand"], (max(left, right), min(left, right)))
    near = max(0, min(b, d) - max(a, c)) / shorter >= overlap and d3 <= three and d5 <= five
    return "monoexon_overlap" if near else None


def merge_mono_legacy(t: DataFrame, overlap: float = 0.5, three: int = 50, five: int = 500) -> DataFrame:
    """(ord, seed, status) of mono-exon transcripts in order of start."""

    def run(rows: list[dict]) -> list[tuple]:
        rows.sort(key=lambda r: (r["start"], r["ord"]))
        return first_fit(rows, lambda seed, r: mono_likeness(seed, r, overlap, three, five), lambda r: r["x"][0][0], max(three, five))

    return _grouped(transcript_islands(t, 0 if overlap > 0 else max(three, five)), run, schema=PLACED)


def reference_ladder(queries: DataFrame, refs: DataFrame, key: str, threshold: int = 0, bin_width: int | None = BIN) -> DataFrame:
    """(key, match, ref_gene_id, ref_transcript_id): full_match, junction_match, partial_match, gene_match or novel.

    Of references that overlap or touch on the same strand (a query's '.' agrees with any), the first full match
    wins; else the last junction match, else the last partial match, else the first gene match, which names no
    transcript.
    """
    wide = lambda df: df.withColumn("end", F.col("end") + 1)
    q = wide(queries.select(F.col(key).alias("key"), "chrom", "start", "end", "strand", "exons", "junctions"))
    pairs = overlap_join(q, wide(refs), ["chrom"], bin_width)
    a, b = side("a_"), side("b_")
    pairs = pairs.filter((a["strand"] == b["strand"]) | (a["strand"] == "."))
    chain = lambda s: junction_chain(s["chrom"], s["strand"], s["junctions"])
    shared = F.size(match_nearest(b["junctions"], a["junctions"], threshold))
    mono = F.size(a["exons"]) == 1
    linked = (F.size(a["junctions"]) > 0) & (F.size(b["junctions"]) > 0)
    match = (
        F.when(mono, "gene_match")
        .when(~linked, F.lit(None).cast("string"))
        .when(chain(a) == chain(b), "full_match")
        .when(shared == F.size(a["junctions"]), "junction_match")
        .when(shared > 0, "partial_match")
        .otherwise("gene_match")
    )
    pairs = pairs.withColumn("match", match).filter(F.col("match").isNotNull())
    rung = F.when(F.col("match") == "full_match", F.struct(F.lit(1).alias("r"), F.col("b_ord").alias("o")))
    rung = rung.when(F.col("match") == "junction_match", F.struct(F.lit(2).alias("r"), (-F.col("b_ord")).alias("o")))
    rung = rung.when(F.col("match") == "partial_match", F.struct(F.lit(3).alias("r"), (-F.col("b_ord")).alias("o"))).otherwise(F.struct(F.lit(4).alias("r"), F.col("b_ord").alias("o")))
    named = F.struct("match", F.col("b_gene_id").alias("gene"), F.when(F.col("match") != "gene_match", F.col("b_transcript_id")).alias("transcript"))
    best = pairs.groupBy(F.col("a_key").alias(key)).agg(F.min_by(named, rung).alias("best"))
    out = queries.select(key).join(best, key, "left")
    return out.select(key, F.coalesce("best.match", F.lit("novel")).alias("match"), F.col("best.gene").alias("ref_gene_id"), F.col("best.transcript").alias("ref_transcript_id"))


