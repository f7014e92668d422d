"""Scalar kernels: the cases that fix their semantics, and random ones against plain Python."""

from __future__ import annotations

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from shapes import pairs, row

from isolume.config import ClusterConfig, MergeConfig
from isolume.functions import kernels as K
from isolume.operators.greedy import mono_status, multi_status, nearest, similarity_parts

J4 = [(200, 300), (500, 600), (800, 900), (1100, 1200)]
J3, J2 = J4[:3], J4[:2]
CFG = MergeConfig()


def one(spark, cases, column):
    return [r.x for r in pairs(spark, cases).select("case", column.alias("x")).orderBy("case").collect()]


def judged(spark, cases, cfg):
    return [(r.ok, r.status) for r in one(spark, cases, K.merge_multi(K.side("a_"), K.side("b_"), cfg))]


def test_multi_exon_status(spark):
    cases = [
        (row(J3), row(J3)),
        (row(J3), row([(500, 600), (800, 900)])),
        (row(J4), row([(800, 900), (1100, 1200)])),
        (row(J3), row(J2)),
        (row(J3), row([(200, 300), (800, 900)])),
        (row(J2), row(J2, start=500 - 500 + 150)),
        (row(J2, start=100), row([(700, 800)], start=500)),
        (row(J2), row(J2, end=2200)),
        (row(J4), row([(d + 2, a) for d, a in J4])),
        (row(J2), row(J2, chrom="chr2")),
        (row(J2), row(J2, strand="-")),
        (row(J2), row([])),
    ]
    assert judged(spark, cases, CFG) == [
        (True, "exact_match"),
        (True, "truncation_5"),
        (False, "5trunc_too_many"),
        (False, "3trunc_too_many"),
        (False, "internal_gap"),
        (True, "exact_match"),
        (False, "no_match"),
        (False, "tes_too_far"),
        (False, "diff_ratio_exceeded"),
        (False, "diff_chrom"),
        (False, "diff_strand"),
        (False, "no_match"),
    ]
    assert judged(spark, [(row(J2), row([(201, 300), (500, 602)]))], replace(CFG, max_diff_ratio=1.0)) == [(True, "fuzzy_match")]
    assert judged(spark, [(row(J3), row(J2))], replace(CFG, max_3trunc=1)) == [(True, "truncation_3")]
    assert judged(spark, [(row(J2), row(J2, start=150, end=2000)), (row(J2, start=-400), row(J2))], replace(CFG, tss_window=200))[1] == (False, "tss_too_far")
    assert judged(spark, [(row(J2), row(J2))], replace(CFG, max_5trunc=-1)) == [(False, "5trunc_too_many")]
    assert judged(spark, [(row(J2), row(J2))], replace(CFG, max_5trunc=-1, unlimited_5trunc=True)) == [(True, "exact_match")]
    minus = (row(J3, strand="-"), row(J3[1:], strand="-"))
    assert judged(spark, [minus], CFG) == [(True, "truncation_5")]  # sides are genomic
    assert judged(spark, [minus], replace(CFG, strand_aware_trunc=True)) == [(False, "3trunc_too_many")]


def test_mono_exon_status(spark):
    cases = [(row([], start=a, end=b, strand=s), row([], start=c, end=d, strand=s)) for a, b, c, d, s in [(100, 500, 100, 500, "+"), (100, 500, 120, 520, "+"), (100, 500, 100, 700, "+"), (100, 500, 100, 700, "-"), (100, 500, 600, 700, "+"), (100, 500, 100, 700, ".")]]
    got = [(r.ok, r.status) for r in one(spark, cases, K.merge_mono(K.side("a_"), K.side("b_"), CFG))]
    assert got == [(True, "monoexon_exact"), (True, "monoexon_overlap"), (False, "3end_too_far"), (True, "monoexon_overlap"), (False, "overlap_too_low"), (True, "monoexon_overlap")]


def test_similarity(spark):
    cases = [
        (row(J2), row(J2)),
        (row(J2), row([(2000, 2300), (2500, 2600)], start=1900, end=3000)),
        (row(J3), row([(201, 300), (500, 602), (799, 900)])),
        (row([], start=0, end=100), row([], start=0, end=50)),
        (row(J2), row([])),
    ]
    got = [r.total for r in one(spark, cases, K.similarity(K.side("a_"), K.side("b_"), ClusterConfig()))]
    assert got[0] == 1.0 and got[1] < 0.5 and got[2] > 0.9
    assert got[3] == pytest.approx((0.4 * 0.5 + 0.2 * 0.5) / 0.6)


def test_class_codes(spark):
    ref = row(J3, tid="R")
    cases = {
        "=": (row(J2), row(J2)),
        "c": (row(J2, end=700), ref),
        "k": (row(J4), row(J2)),
        "j": (row([(200, 300), (700, 900)]), row(J3, end=3000)),
        "i": (row([], start=350, end=450), row([(300, 500)], end=800)),
        "s": (row(J2, strand="-"), row(J2)),
        "x": (row([], strand="-", start=150, end=180), row(J2)),
        "e": (row([], start=150, end=250), ref),
        "o": (row([(250, 280)], start=150, end=700), row([(320, 400)], start=160, end=800)),
        "y": (row([(220, 700)], start=50, end=3000), row([(400, 450)], start=210, end=800)),
        "m": (row([(200, 300), (800, 900), (950, 960)], end=1950), row(J4, end=2100)),
        None: (row([(2200, 2300)], start=2000, end=2500), row(J2, end=800)),
    }
    got = one(spark, cases.values(), K.classify_pair(K.side("a_"), K.side("b_"), 3))
    assert got == list(cases)


def test_mono_and_precedence(spark):
    inside = (row([], start=310, end=340), row(J2))  # inside an exon
    kept = (row([(200, 300), (800, 900)]), row(J3))  # a retention whose junctions all match
    refs = [(row([], start=100, end=500), row([], start=a, end=b)) for a, b in [(100, 500), (50, 600), (200, 300), (300, 700)]]
    multi_mono = [(row(J2), row([], start=310, end=400)), (row(J2), row([], start=310, end=700))]
    got = one(spark, [inside, kept, *refs, *multi_mono], K.classify_pair(K.side("a_"), K.side("b_"), 3))
    assert got == ["c", "c", "=", "c", "k", "o", "k", "o"]


def test_matching_differs_between_nearest_and_first(spark):
    a, b = row([(200, 300)]), row([(198, 300), (200, 301)], exons=[(0, 198), (300, 200), (301, 400)])
    a = (*a[:9], [(200, 300, "+")], {})
    b = (*b[:9], [(198, 300, "+"), (200, 301, "+")], {})
    near = one(spark, [(a, b)], K.match_nearest(F.col("a_junctions"), F.col("b_junctions"), 3))[0]
    first = one(spark, [(a, b)], K.match_first(F.col("a_junctions"), F.col("b_junctions"), 3))[0]
    assert [(p.i, p.j) for p in near] == [(0, 1)] and [(p.i, p.j) for p in first] == [(0, 0)]


def random_row(rnd, ord=0, mono=False):
    n = 0 if mono else rnd.randint(0, 4)
    points = sorted(rnd.sample(range(10, 400, 3), 2 * n + 2))
    points = [p + rnd.choice([0, 0, 1, 2]) for p in points]
    points = sorted(set(points))
    points = points if len(points) % 2 == 0 else points[:-1]
    xs = [(points[i], points[i + 1]) for i in range(0, len(points), 2)]
    return row([], start=xs[0][0], end=xs[-1][1], exons=xs, strand=rnd.choice("+-"), ord=ord, sample=f"s{ord % 3}", tid=f"t{ord}")


def as_dict(r):
    return {"start": r[3], "end": r[4], "strand": r[5], "x": r[8], "j": r[9], "length": sum(b - a for a, b, _ in r[8])}


def test_columns_equal_plain_kernels(spark):
    rnd = random.Random(7)
    cases = []
    while len(cases) < 250:
        a, b = random_row(rnd), random_row(rnd)
        b = (*b[:5], a[5], *b[6:8], [(x, y, a[5]) for x, y, _ in b[8]], [(x, y, a[5]) for x, y, _ in b[9]], {})
        cases.append((a, b))
    cfg = replace(CFG, junction_threshold=8, max_5trunc=2, max_3trunc=2, tss_window=200, tes_window=200, max_diff_ratio=1.0)
    ok = judged(spark, cases, cfg)
    for (a, b), (good, status) in zip(cases, ok, strict=True):
        assert (status if good else None) == multi_status(as_dict(a), as_dict(b), cfg)
    near = one(spark, cases, K.match_nearest(F.col("a_junctions"), F.col("b_junctions"), 8))
    assert [[tuple(p) for p in x] for x in near] == [nearest(a[9], b[9], 8) for a, b in cases]
    sim = ClusterConfig(junction_threshold=5, fuzzy_threshold=20)
    for (a, b), s in zip(cases, one(spark, cases, K.similarity(K.side("a_"), K.side("b_"), sim)), strict=True):
        assert (s.structural, s.junction, s.jaccard, s.total) == pytest.approx(similarity_parts(as_dict(a), as_dict(b), sim)[:4], abs=1e-4)
    monos = [(random_row(rnd, mono=True), random_row(rnd, mono=True)) for _ in range(120)]
    monos = [(a, (*b[:5], a[5], *b[6:8], [(x, y, a[5]) for x, y, _ in b[8]], [], {})) for a, b in monos]
    got = one(spark, monos, K.merge_mono(K.side("a_"), K.side("b_"), CFG))
    assert [r.status if r.ok else None for r in got] == [mono_status(as_dict(a), as_dict(b), CFG) for a, b in monos]


def test_empty_arrays(spark):
    empty = row([], exons=[])
    got = one(spark, [(empty, row(J2)), (empty, empty)], K.classify_pair(K.side("a_"), K.side("b_"), 3))
    assert got == [None, None]
    assert [r.status for r in one(spark, [(empty, row([]))], K.merge_mono(K.side("a_"), K.side("b_"), CFG))] == ["no_exon"]
    assert one(spark, [(empty, row(J2))], K.junctions_of(F.col("a_exons"))) == [[]]


def test_chain_and_ends(spark):
    case = [(row(J2, strand="-"), row(J2))]
    assert one(spark, case, K.junction_chain(F.col("a_chrom"), F.col("a_strand"), F.col("a_junctions"))) == ["chr1:-:200-300:500-600"]
    assert one(spark, case, K.tss(F.col("a_start"), F.col("a_end"), F.col("a_strand"))) == [2000]
    assert one(spark, case, K.is_continuous(F.array(F.lit(2), F.lit(3), F.lit(5)))) == [False]


def test_penalties(spark):
    cases = [(row(J3), row(J3)), (row(J3), row([(202, 300), (500, 600), (800, 900)])), (row(J3), row(J2)), (row(J3), row(J3[1:])), (row(J3), row([(200, 300), (800, 900)])), (row(J3), row([]))]
    got = one(spark, cases, K.penalty_score(F.col("a_junctions"), F.col("b_junctions"), 3))
    assert [(r.mergeable, r.kind, r.score) for r in got] == [
        (True, "exact_match", 100.0), (True, "fuzzy_intron", 98.0), (True, "truncation_3", 95.0), (True, "truncation_5", 100.0), (False, "singleton", 50.0), (False, "singleton", 0.0),
    ]
