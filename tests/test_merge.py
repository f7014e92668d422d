"""Greedy merging, consensus, labels, genes and IDs: against plain Python, and as invariants."""

from __future__ import annotations

import random

from pyspark.sql import functions as F
from shapes import frame, row
from test_kernels import as_dict, random_row

from isolume.config import ClusterConfig, MergeConfig
from isolume.operators.classify import classify_best, reference
from isolume.operators.genes import define_genes, gene_roots
from isolume.operators.greedy import merge_clusters, mono_status, most_similar, multi_status, similarity_clusters, similarity_parts
from isolume.operators.ids import assign_ids, merge_order
from isolume.plans.merge import consolidate
from isolume.sources.gtf import natural_order

CFG = MergeConfig(junction_threshold=4, tss_window=120, tes_window=120, max_3trunc=1)


def greedy(rows, key, accept):
    """First fit without islands, over each chromosome and strand."""
    seeds, out = {}, {}
    for r in sorted(rows, key=key):
        group = seeds.setdefault((r[2], r[5]), [])
        for s in group:
            if accept(as_dict(s), as_dict(r), CFG):
                out[r[7]] = s[7]
                break
        else:
            group.append(r)
            out[r[7]] = r[7]
    return out


def many(n=160, seed=3):
    rnd = random.Random(seed)
    rows = [random_row(rnd, ord=i) for i in range(n)]
    return rows + [(*r[:7], 1000 + r[7], *r[8:]) for r in rows[:40]]  # some twice


def test_greedy_equals_plain_python(spark):
    rows = many()
    multi, mono = [r for r in rows if len(r[8]) > 1], [r for r in rows if len(r[8]) == 1]
    want = greedy(multi, lambda r: (-len(r[9]), -as_dict(r)["length"], r[7]), multi_status) | greedy(mono, lambda r: (r[3], r[7]), mono_status)
    got = {r.ord: r.seed for r in merge_clusters(frame(spark, rows), CFG).collect()}
    assert got == want
    assert got == {r.ord: r.seed for r in merge_clusters(frame(spark, rows).repartition(7), CFG).collect()}


def test_statuses(spark):
    j3 = [(200, 300), (500, 600), (800, 900)]
    rows = [
        row(j3, ord=0, sample="a"), row(j3[1:], ord=1, sample="b"), row([(201, 300), *j3[1:]], ord=2, sample="c"),
        row([], ord=3, start=5000, end=5400, sample="a"), row([], ord=4, start=5000, end=5400, sample="b"), row([], ord=5, start=5010, end=5400, sample="c"),
        row([], ord=6, start=9000, end=9400, sample="a"),
    ]
    got = {r.ord: (r.seed, r.status) for r in merge_clusters(frame(spark, rows), MergeConfig()).collect()}
    # Junctions and exonic length being equal, the drifted one comes first only if it is longer.
    assert {s for _, s in got.values()} == {"fuzzy_match", "monoexon_overlap", "singleton"}
    assert got[6] == (6, "singleton") and got[3][0] == got[5][0] == 3


def test_similarity_clusters_equal_plain_python(spark):
    cfg = ClusterConfig(junction_threshold=4, min_similarity=0.4)
    rows = many(120, 9)
    reps, want = {}, {}
    for r in sorted(rows, key=lambda r: (-as_dict(r)["length"], r[0], r[7])):
        best, most = None, 0.0
        for s in reps.setdefault((r[2], r[5]), []):
            total = similarity_parts(as_dict(s), as_dict(r), cfg)[3]
            if s[3] < r[4] and s[4] > r[3] and total >= cfg.min_similarity and total > most:
                best, most = s, total
        if best is None:
            reps[r[2], r[5]].append(r)
        want[r[7]] = best[7] if best else r[7]
    t = frame(spark, rows).withColumn("is_ref", F.lit(False)).withColumn("n_occurrences", F.lit(1))
    assert {r.ord: r.seed for r in similarity_clusters(t, cfg).collect()} == want


def test_clusters_of_four(spark):
    j2 = [(200, 300), (500, 600)]
    rows = [row(j2, tid="t1", ord=0), row([(201, 300), (500, 602)], tid="t2", ord=1), row(j2, tid="t3", ord=2), row([(2200, 2300), (2500, 2600)], start=2000, end=3000, tid="t4", ord=3)]
    t = frame(spark, rows).withColumn("is_ref", F.lit(False)).withColumn("n_occurrences", F.lit(1))
    sizes = similarity_clusters(t, ClusterConfig()).groupBy("seed").count().select("count").collect()
    assert sorted(r[0] for r in sizes) == [1, 3]


def test_consensus(spark):
    j = [(200, 300), (500, 600)]
    rows = [row(j, start=100, sample="a", tid="x", ord=0), row(j, start=90, sample="b", tid="y", ord=1), row([(200, 301), (500, 600)], start=90, end=2010, sample="b", tid="z", ord=2), row(j, start=95, sample="c", tid="w", ord=3)]
    m = consolidate(frame(spark, rows), MergeConfig(), 4).first()
    # Longest first: z (1519 bases), y (1510), w (1505), x (1500). z and y are of sample b, which z stands for.
    assert (m.start, m.tss_coord, m.tss_source, m.tes_coord, m.tes_source) == (90, 90, "b", 2000, "b")
    assert list(m.sample_ids) == ["b", "c", "a"] and list(m.source_transcripts) == ["b:z", "c:w", "a:x"] and m.num_samples == 3 and m.freq_score == 0.75
    assert [(x.donor, x.acceptor) for x in m.junctions] == j and (m.tss_diff_range, m.tes_diff_range) == ("0-10bp", "0-10bp")
    assert m.merge_status == "fuzzy_match" and (m.diff_junction_count, m.diff_junction_ratio) == (1, 0.5)


def test_minus_strand_representatives(spark):
    j = [(200, 300), (500, 600)]
    rows = [row(j, strand="-", sample=s, ord=i) for i, s in enumerate("ab")]
    m = consolidate(frame(spark, rows), MergeConfig(), 2).first()
    assert [(x.donor, x.acceptor) for x in m.junctions] == [(2000, 300), (500, 100)]
    m = consolidate(frame(spark, rows), MergeConfig(fix_minus_strand=True), 2).first()
    assert [(x.donor, x.acceptor) for x in m.junctions] == j


def test_best_reference_and_ids(spark):
    j2, j3 = [(200, 300), (500, 600)], [(200, 300), (500, 600), (800, 900)]
    refs = [row(j3, tid="R1", gene="A", ord=0), row(j2, tid="R2", gene="B", ord=1), row(j2, tid="R2", gene="C", ord=2), row(j2, tid="R3", gene="D", ord=3)]
    ref = reference(frame(spark, refs))
    assert ref.count() == 3
    rows = [row(j2, ord=0, tid="q"), row([], start=5000, end=6000, ord=1, tid="u")]
    got = {r.ord: (r.class_code, r.ref_transcript_id, r.ref_gene_id) for r in classify_best(frame(spark, rows), ref, "ord", 3).collect()}
    assert got == {0: ("=", "R2", "C"), 1: ("u", None, None)}
    assert classify_best(frame(spark, rows), None, "ord", 3).filter("class_code = 'u'").count() == 2
    merged = consolidate(frame(spark, [*rows, row(j2, chrom="chr10", ord=2), row(j2, chrom="chr2", ord=3)]), MergeConfig(), 1)
    merged = assign_ids(classify_best(merged, ref, "merge_id", 3), natural_order(merged), "N")
    assert sorted(r.transcript_id for r in merged.collect()) == ["N.Tx000001.chr1.u", "N.Tx1000001.chr2.u", "N.Tx2000001.chr10.u", "R2"]


def test_genes(spark):
    rows = [
        row([(200, 300)], start=100, end=400, ord=0), row([], start=350, end=450, ord=1), row([], start=220, end=280, ord=2),
        row([], start=390, end=600, strand="-", ord=3), row([], start=100, end=150, chrom="chr2", ord=4),
    ]
    cfg = MergeConfig()
    merged = merge_order(consolidate(frame(spark, rows), cfg, 1).drop("merge_ord")).withColumn("ref_gene_id", F.when(F.col("seed") == 1, "K"))
    got = {r.seed: r.gene_id for r in define_genes(merged, "N").collect()}
    assert got[0] == got[1] == "K" and got[2] == "NG2" and got[3] == "NG3" and got[4] == "NG1"
    linked = define_genes(merged.withColumn("ref_gene_id", F.lit("K")), "N", by_reference=True)
    assert linked.filter("chrom = 'chr1' AND strand = '+'").select("component").distinct().count() == 1


def test_bound_of_the_similarity():
    rnd = random.Random(12)
    for _ in range(3000):
        a, b = ({**as_dict(random_row(rnd)), "plain": True} for _ in range(2))
        b["strand"] = a["strand"]
        cfg = ClusterConfig(junction_threshold=rnd.choice([0, 5, 60]), fuzzy_threshold=80, weight_structural=rnd.random(), weight_junction=rnd.random(), weight_jaccard=rnd.random())
        assert similarity_parts(a, b, cfg)[3] <= most_similar(a, b, cfg)


def test_gene_links_stop_at_spans(spark):
    """A representative with an exon outside its span: that overlap counts only if the later start is within the earlier span."""
    rows = [
        row([], start=100, end=200, ord=0, exons=[(100, 150), (400, 500)]), row([], start=300, end=600, ord=1),
        row([], start=1000, end=1200, ord=2, exons=[(1000, 1100), (1300, 1500)]), row([], start=1150, end=1400, ord=3, exons=[(1350, 1400)]),
    ]
    t = frame(spark, rows).withColumn("merge_id", F.col("ord"))
    roots = {r.node: r.root for r in gene_roots(t).collect()}
    assert {r[7]: roots.get(r[7], r[7]) for r in rows} == {0: 0, 1: 1, 2: 2, 3: 2}


def test_gene_links_connect_what_pairs_connect(spark):
    rnd = random.Random(21)
    rows = [random_row(rnd, ord=i) for i in range(150)]
    rows = [(*r[:3], r[3] + 450 * (r[7] % 6), r[4] + 450 * (r[7] % 6), *r[5:8], [(a + 450 * (r[7] % 6), b + 450 * (r[7] % 6), s) for a, b, s in r[8]], *r[9:]) for r in rows]
    parent = {r[7]: r[7] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in rows:
        for b in rows:
            if a[5] == b[5] and a[3] <= b[3] <= a[4] and any(x[0] < y[1] and x[1] > y[0] for x in a[8] for y in b[8]):
                u, v = sorted((find(a[7]), find(b[7])))
                parent[v] = u
    t = frame(spark, rows).withColumn("merge_id", F.col("ord"))
    roots = {r.node: r.root for r in gene_roots(t).collect()}
    assert {r[7]: roots.get(r[7], r[7]) for r in rows} == {r[7]: find(r[7]) for r in rows}
