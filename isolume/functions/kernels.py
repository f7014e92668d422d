"""Scalar kernels over exon and junction arrays, as Column expressions.

Arguments are Columns: arrays of struct<start, end, strand> (exons) or of
struct<donor, acceptor, strand> (junctions). Every index loop holds for empty
arrays. An inner result that is used twice is bound by a one-element transform.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_PAIRS = "array<struct<i:int,j:int,err:bigint>>"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def junctions_of(exons: Column) -> Column:
    """Gaps between consecutive exons; they take the upstream exon's strand."""
    n = F.size(exons)
    left, right = F.slice(exons, 1, F.greatest(n - 1, F.lit(0))), F.slice(exons, 2, F.greatest(n - 1, F.lit(0)))
    return F.zip_with(left, right, lambda a, b: F.struct(a["end"].alias("donor"), b["start"].alias("acceptor"), a["strand"].alias("strand")))


def exonic_length(exons: Column) -> Column:
    return F.aggregate(exons, F.lit(0).cast("long"), lambda n, e: n + e["end"] - e["start"])


def tss(start: Column, end: Column, strand: Column) -> Column:
    """Start of transcription; an unknown strand reads as plus."""
    return F.when(strand == "-", end).otherwise(start)


def tes(start: Column, end: Column, strand: Column) -> Column:
    return F.when(strand == "-", start).otherwise(end)


def junction_chain(chrom: Column, strand: Column, junctions: Column) -> Column:
    """chrom:strand:donor-acceptor:..., the key of equal structures."""
    links = F.transform(junctions, lambda j: F.concat_ws("-", j["donor"].cast("string"), j["acceptor"].cast("string")))
    return F.concat_ws(":", chrom, strand, F.array_join(links, ":"))


def strands_agree(a: Column, b: Column) -> Column:
    return (a == b) | (a == ".") | (b == ".")


def coord_error(a: Column, b: Column) -> Column:
    return F.greatest(F.abs(a["donor"] - b["donor"]), F.abs(a["acceptor"] - b["acceptor"]))


def matches(a: Column, b: Column, threshold: int) -> Column:
    return strands_agree(a["strand"], b["strand"]) & (coord_error(a, b) <= threshold)


def _greedy(ja: Column, jb: Column, threshold: int, by_error: bool) -> Column:
    """One-to-one pairs: each a in turn takes its best free b (nearest, or simply first; ties to the first)."""
    start = F.struct(F.array().cast(_PAIRS).alias("pairs"), F.array().cast("array<int>").alias("used"))
    numbered = F.transform(ja, lambda a, i: F.struct(i.alias("i"), a.alias("a")))

    def step(acc: Column, x: Column) -> Column:
        offers = F.transform(
            jb,
            lambda b, j: F.when(
                matches(x["a"], b, threshold) & ~F.array_contains(acc["used"], j),
                F.struct((coord_error(x["a"], b) if by_error else F.lit(0).cast("long")).alias("rank"), j.alias("j"), coord_error(x["a"], b).alias("err")),
            ),
        )
        pair = lambda best: F.array(F.struct(x["i"].alias("i"), best["j"].alias("j"), best["err"].alias("err")))
        return bound(
            F.array_min(F.array_compact(offers)),
            lambda best: F.when(best.isNull(), acc).otherwise(
                F.struct(F.concat(acc["pairs"], pair(best)).alias("pairs"), F.concat(acc["used"], F.array(best["j"])).alias("used"))
            ),
        )

    return F.aggregate(numbered, start, step, lambda acc: acc["pairs"])


def match_nearest(ja: Column, jb: Column, threshold: int) -> Column:
    """array<struct<i, j, err>>: greedy nearest matching."""
    return _greedy(ja, jb, threshold, True)


def match_first(ja: Column, jb: Column, threshold: int) -> Column:
    """array<struct<i, j, err>>: greedy first-fit matching."""
    return _greedy(ja, jb, threshold, False)


def is_continuous(indices: Column) -> Column:
    """True if the indices are a run of consecutive numbers in order (or at most one)."""
    run = F.sequence(F.element_at(indices, 1), F.greatest(F.element_at(indices, -1), F.element_at(indices, 1)))
    return (F.size(indices) <= 1) | F.coalesce(indices == run, F.lit(False))


def exons_overlap(a: Column, b: Column) -> Column:
    return F.exists(a, lambda x: F.exists(b, lambda y: (x["start"] < y["end"]) & (x["end"] > y["start"])))


def spans_overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return (a["chrom"] == b["chrom"]) & (a["start"] < b["end"]) & (a["end"] > b["start"])


def within_span(inner: dict[str, Column], outer: dict[str, Column]) -> Column:
    return (inner["start"] >= outer["start"]) & (inner["end"] <= outer["end"])


def in_intron(q: dict[str, Column], junctions: Column) -> Column:
    return F.exists(junctions, lambda j: (q["start"] >= j["donor"]) & (q["end"] <= j["acceptor"]))


def chains_match(ja: Column, jb: Column, threshold: int) -> Column:
    """Equal length, not empty, and every pair by position matches."""
    pairs = F.zip_with(ja, jb, lambda a, b: matches(a, b, threshold))
    return (F.size(ja) == F.size(jb)) & (F.size(ja) > 0) & F.forall(pairs, lambda ok: F.coalesce(ok, F.lit(False)))


SIDE = ("chrom", "start", "end", "strand", "exons", "junctions")


def side(prefix: str = "", source=None) -> dict[str, Column]:
    """Columns of one side of a pair, by prefix (or of a struct or frame)."""
    return {c: (source[f"{prefix}{c}"] if source is not None else F.col(f"{prefix}{c}")) for c in SIDE}


def classify_pair(q: dict[str, Column], r: dict[str, Column], threshold: int) -> Column:
    """Class code of a query against one reference transcript; null if they have nothing to do with each other.

    The rules are tried from top to bottom: a clean retention whose junctions all match is therefore c, and a
    query that spans its reference is y even if junctions match.
    """
    nq, nr = F.size(q["junctions"]), F.size(r["junctions"])
    mono_q, mono_r = F.size(q["exons"]) == 1, F.size(r["exons"]) == 1
    touch = exons_overlap(q["exons"], r["exons"])
    q1, r1 = F.element_at(q["exons"], 1), F.element_at(r["exons"], 1)
    inside = lambda a, b: (a["start"] >= b["start"]) & (a["end"] <= b["end"])
    blind = F.exists(q["junctions"], lambda a: F.exists(r["junctions"], lambda b: coord_error(a, b) <= threshold))

    opposite = F.when(blind, "s").when(touch, "x")
    mono_query = F.when(
        mono_r,
        F.when((q1["start"] == r1["start"]) & (q1["end"] == r1["end"]), "=").when(inside(q1, r1), "c").when(inside(r1, q1), "k").otherwise("o"),
    ).otherwise(F.when(F.exists(r["exons"], lambda e: inside(q1, e)), "c").otherwise("e"))
    mono_ref = F.when(F.exists(q["exons"], lambda e: inside(r1, e)), "k").otherwise("o")

    def of_pairs(m: Column) -> Column:
        retained = (F.size(m["q"]) > 0) & (nq < nr) & ~is_continuous(F.transform(m["q"], lambda p: p["j"]))
        return (
            F.when((F.size(m["q"]) == nq) & (nq > 0) & (nq < nr), "c")
            .when((nr < nq) & (nr > 0) & (F.size(m["r"]) == nr), "k")
            .when(within_span(r, q) & ~within_span(q, r), "y")
            .when(retained, "m")
            .when(F.size(m["q"]) > 0, "j")
            .otherwise("o")
        )

    found = F.struct(match_first(q["junctions"], r["junctions"], threshold).alias("q"), F.when(nr < nq, match_first(r["junctions"], q["junctions"], threshold)).alias("r"))
    both_multi = F.when(chains_match(q["junctions"], r["junctions"], threshold), "=").otherwise(bound(found, of_pairs))
    same = (
        F.when(in_intron(q, r["junctions"]) & ~touch, "i")
        .when(~touch, F.lit(None).cast("string"))
        .when(mono_q, mono_query)
        .when(mono_r, mono_ref)
        .otherwise(both_multi)
    )
    return F.when(spans_overlap(q, r), F.when(strands_agree(q["strand"], r["strand"]), same).otherwise(opposite))


def merge_multi(a: dict[str, Column], b: dict[str, Column], cfg) -> Column:
    """struct<ok, status>: whether two multi-exon transcripts may be one molecule, and how or why not."""
    na, nb = F.size(a["junctions"]), F.size(b["junctions"])
    verdict = lambda ok, s: F.struct(F.lit(ok).alias("ok"), F.lit(s).alias("status"))

    def judged(m: Column) -> Column:
        ai, bi = F.transform(m, lambda p: p["i"]), F.transform(m, lambda p: p["j"])
        left = F.greatest(F.element_at(ai, 1), F.element_at(bi, 1))
        right = F.greatest(na - 1 - F.element_at(ai, -1), nb - 1 - F.element_at(bi, -1))
        if cfg.strand_aware_trunc:
            miss_5, miss_3 = F.when(a["strand"] == "-", right).otherwise(left), F.when(a["strand"] == "-", left).otherwise(right)
        else:
            miss_5, miss_3 = left, right
        drift = F.size(F.filter(m, lambda p: p["err"] > 0))
        no_5_limit = cfg.unlimited_5trunc and cfg.max_5trunc < 0
        out = F.when(F.size(m) == 0, verdict(False, "no_match")).when(~is_continuous(ai) | ~is_continuous(bi), verdict(False, "internal_gap"))
        if not no_5_limit:
            out = out.when(miss_5 > cfg.max_5trunc, verdict(False, "5trunc_too_many"))
        if cfg.max_3trunc >= 0:
            out = out.when(miss_3 > cfg.max_3trunc, verdict(False, "3trunc_too_many"))
        out = out.when(F.abs(tss(a["start"], a["end"], a["strand"]) - tss(b["start"], b["end"], b["strand"])) > cfg.tss_window, verdict(False, "tss_too_far"))
        out = out.when(F.abs(tes(a["start"], a["end"], a["strand"]) - tes(b["start"], b["end"], b["strand"])) > cfg.tes_window, verdict(False, "tes_too_far"))
        if cfg.max_diff_count >= 0:
            out = out.when(drift > cfg.max_diff_count, verdict(False, "diff_count_exceeded"))
        out = out.when(drift / F.size(m) > cfg.max_diff_ratio, verdict(False, "diff_ratio_exceeded"))
        out = out.when((miss_5 == 0) & (miss_3 == 0), F.when(drift > 0, verdict(True, "fuzzy_match")).otherwise(verdict(True, "exact_match")))
        return out.when(miss_3 == 0, verdict(True, "truncation_5")).when(miss_5 == 0, verdict(True, "truncation_3")).otherwise(verdict(True, "truncation_both"))

    return (
        F.when(a["chrom"] != b["chrom"], verdict(False, "diff_chrom"))
        .when(~strands_agree(a["strand"], b["strand"]), verdict(False, "diff_strand"))
        .otherwise(bound(match_nearest(a["junctions"], b["junctions"], cfg.junction_threshold), judged))
    )


def merge_mono(a: dict[str, Column], b: dict[str, Column], cfg) -> Column:
    """struct<ok, status> of two mono-exon transcripts, by overlap of the first exons and distance of either end."""
    verdict = lambda ok, s: F.struct(F.lit(ok).alias("ok"), F.lit(s).alias("status"))
    x, y = F.get(a["exons"], F.lit(0)), F.get(b["exons"], F.lit(0))
    overlap = F.greatest(F.lit(0), F.least(x["end"], y["end"]) - F.greatest(x["start"], y["start"]))
    shorter = F.least(x["end"] - x["start"], y["end"] - y["start"])
    left, right = F.abs(x["start"] - y["start"]), F.abs(x["end"] - y["end"])
    d5 = F.when(a["strand"] == "+", left).when(a["strand"] == "-", right).otherwise(F.greatest(left, right))
    d3 = F.when(a["strand"] == "+", right).when(a["strand"] == "-", left).otherwise(F.least(left, right))
    return (
        F.when(a["chrom"] != b["chrom"], verdict(False, "diff_chrom"))
        .when(~strands_agree(a["strand"], b["strand"]), verdict(False, "diff_strand"))
        .when(x.isNull() | y.isNull(), verdict(False, "no_exon"))
        .when(shorter == 0, verdict(False, "zero_length"))
        .when(overlap / F.nullif(shorter, F.lit(0)) < cfg.mono_overlap, verdict(False, "overlap_too_low"))
        .when(d5 > cfg.mono_5end, verdict(False, "5end_too_far"))
        .when(d3 > cfg.mono_3end, verdict(False, "3end_too_far"))
        .when((left == 0) & (right == 0), verdict(True, "monoexon_exact"))
        .otherwise(verdict(True, "monoexon_overlap"))
    )


def _ratio_likeness(a: Column, b: Column) -> Column:
    most = F.greatest(a, b)
    return F.when(most > 0, 1.0 - F.abs(a - b) / most).otherwise(0.0)


def structural_score(ea: Column, eb: Column) -> Column:
    """Likeness of exon counts times likeness of exonic lengths."""
    return _ratio_likeness(F.size(ea), F.size(eb)) * _ratio_likeness(exonic_length(ea), exonic_length(eb))


def junction_score(ja: Column, jb: Column, threshold: int, fuzzy: int) -> Column:
    """Strict matches count 1 and fuzzy ones 0.5, over the union of junctions.

    A junction that is within the threshold of any strictly used partner gets no fuzzy match, even if that
    partner was taken by another one.
    """

    def fuzzy_hits(used: Column) -> Column:
        open_ = F.filter(ja, lambda a: ~F.exists(used, lambda k: matches(a, F.get(jb, k), threshold)))

        def step(acc: Column, a: Column) -> Column:
            free = F.filter(F.transform(jb, lambda b, k: F.when(matches(a, b, fuzzy) & ~F.array_contains(acc, k), k)), lambda k: k.isNotNull())
            return F.concat(acc, F.slice(free, 1, 1))

        return F.aggregate(open_, used, step, lambda acc: F.size(acc) - F.size(used))

    strict = F.transform(match_first(ja, jb, threshold), lambda p: p["j"])

    def total(used: Column) -> Column:
        n = F.size(used)
        return F.least((n + 0.5 * fuzzy_hits(used)) / F.greatest(F.size(ja) + F.size(jb) - n, F.lit(1)), F.lit(1.0))

    empty_a, empty_b = F.size(ja) == 0, F.size(jb) == 0
    return F.when(empty_a & empty_b, 1.0).when(empty_a | empty_b, 0.0).otherwise(bound(strict, total))


def jaccard_score(ea: Column, eb: Column) -> Column:
    """Shared bases over all bases of the exons."""
    zero = F.lit(0).cast("long")
    shared = F.aggregate(
        ea, zero, lambda n, x: n + F.aggregate(eb, zero, lambda m, y: m + F.greatest(zero, F.least(x["end"], y["end"]) - F.greatest(x["start"], y["start"])))
    )
    return bound(shared, lambda s: F.when(exonic_length(ea) + exonic_length(eb) - s == 0, 0.0).otherwise(s / F.nullif(exonic_length(ea) + exonic_length(eb) - s, zero)))


def similarity(a: dict[str, Column], b: dict[str, Column], cfg) -> Column:
    """struct<structural, junction, jaccard, total> in full precision; callers that compare to a limit round to 4 places first."""
    both_mono = (F.size(a["junctions"]) == 0) & (F.size(b["junctions"]) == 0)
    parts = F.struct(
        structural_score(a["exons"], b["exons"]).alias("structural"),
        junction_score(a["junctions"], b["junctions"], cfg.junction_threshold, cfg.fuzzy_threshold).alias("junction"),
        F.when(a["chrom"] == b["chrom"], jaccard_score(a["exons"], b["exons"])).otherwise(0.0).alias("jaccard"),
    )
    ws, wn, wc = cfg.weight_structural, cfg.weight_junction, cfg.weight_jaccard
    mono_w, all_w = ws + wc, ws + wn + wc

    def total(p: Column) -> Column:
        mono = (ws / mono_w * p["structural"] + wc / mono_w * p["jaccard"]) if mono_w else F.lit(0.0)
        multi = (ws / all_w * p["structural"] + wn / all_w * p["junction"] + wc / all_w * p["jaccard"]) if all_w else F.lit(0.0)
        return F.struct(p["structural"].alias("structural"), p["junction"].alias("junction"), p["jaccard"].alias("jaccard"), F.when(both_mono, mono).otherwise(multi).alias("total"))

    return bound(parts, total)


def penalty_score(
    ja: Column, jb: Column, threshold: int, per_bp: float = 1.0, trunc5: float = 0.0, trunc3: float = 5.0, retention: float = 50.0, min_shared: int = 1
) -> Column:
    """struct<mergeable, kind, score>: the earlier model, 100 points less penalties; gaps inside either chain end it."""
    n = F.size(ja)
    out = lambda ok, kind, score: F.struct(F.lit(ok).alias("mergeable"), F.lit(kind).alias("kind"), (score if isinstance(score, Column) else F.lit(float(score))).alias("score"))

    def judged(m: Column) -> Column:
        ai, bi = F.transform(m, lambda p: p["i"]), F.transform(m, lambda p: p["j"])
        first, last = F.element_at(ai, 1), F.element_at(ai, -1)
        err = F.aggregate(m, F.lit(0).cast("long"), lambda s, p: s + p["err"])
        miss_5, miss_3, drift = first, n - 1 - last, F.exists(m, lambda p: p["err"] > 0)
        score = F.greatest(F.lit(0.0), 100.0 - err * per_bp - miss_5 * trunc5 - miss_3 * trunc3)
        retained = F.greatest(F.lit(0.0), 100.0 - (last - first + 1 - F.size(m)) * retention)
        ok = lambda fuzzy, exact: F.when(drift, out(True, fuzzy, score)).otherwise(out(True, exact, score))
        return (
            F.when(F.size(m) < min_shared, out(False, "singleton", 0.0))
            .when(~is_continuous(bi), out(False, "singleton", 0.0))
            .when(~is_continuous(ai), out(False, "singleton", retained))
            .when((miss_5 == 0) & (miss_3 == 0), ok("fuzzy_intron", "exact_match"))
            .when(miss_3 == 0, ok("fuzzy_truncation_5", "truncation_5"))
            .when(miss_5 == 0, ok("fuzzy_truncation_3", "truncation_3"))
            .otherwise(out(True, "truncation_both", score))
        )

    matched = bound(match_nearest(ja, jb, threshold), judged)
    return F.when((n == 0) | (F.size(jb) == 0), out(False, "singleton", 0.0)).otherwise(matched)
