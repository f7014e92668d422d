"""Scans, manifests, joins, sinks, whole plans, resuming and arrivals."""

from __future__ import annotations

import gzip
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from shapes import frame, row

from isolume.config import ClusterConfig, MergeConfig
from isolume.operators.interval import islands, overlap_join
from isolume.plans import merge
from isolume.plans.checkpoint import Staged
from isolume.plans.cli import parser, settings
from isolume.plans.cluster import run_cluster
from isolume.plans.merge import run_merge
from isolume.sources import gtf, manifest
from isolume.streaming.arrivals import staged_transcripts, stream_transcripts


def lines_of(transcripts, with_heads=True):
    out = ["# made for a test"]
    for tid, gene, chrom, strand, exons in transcripts:
        told = f'gene_id "{gene}"; transcript_id "{tid}"; gene_name "n";'
        if with_heads:
            out.append(f"{chrom}\tx\ttranscript\t{exons[0][0]}\t{exons[-1][1]}\t.\t{strand}\t.\t{told}")
        out += [f"{chrom}\tx\texon\t{a}\t{b}\t.\t{strand}\t.\t{told}" for a, b in exons]
    return "\n".join(out) + "\n"


PLUS = [(1001, 1200), (1501, 1800), (2001, 2300)]
MINUS = [(11001, 11400), (11701, 12100), (12401, 13000)]
A = [("a1", "ga", "chr1", "+", PLUS), ("a2", "ga", "chr1", "+", [(5001, 6500)]), ("a3", "gb", "chr1", "-", MINUS), ("a4", "gc", "chr10", "+", [(1, 90)])]
B = [("b1", "ga", "chr1", "+", PLUS), ("b2", "ga", "chr1", "+", [(4801, 6500)]), ("b3", "gb", "chr1", "-", MINUS), ("b4", "gd", "chr2", "+", [(1, 90)])]
REF = [("R1", "G1", "chr1", "+", PLUS), ("R3", "G3", "chr1", "-", MINUS), ("R9", "G9", "chr2", "-", [(500, 600)])]


@pytest.fixture
def files(tmp_path):
    (tmp_path / "a.gtf").write_text(lines_of(A))
    with gzip.open(tmp_path / "b.gtf.gz", "wt") as f:
        f.write(lines_of(B))
    (tmp_path / "ref.gtf").write_text(lines_of(REF))
    (tmp_path / "samples.tsv").write_text("gtf_path\tsample_id\tcap_status\tpriority\tmetadata\n# note\n\na.gtf\tsa\tcapped\t2\tm\nb.gtf.gz\tsb\tstrange\n")
    return tmp_path


def test_manifest(spark, files):
    rows = manifest.read_manifest(spark, str(files / "samples.tsv"), str(files)).collect()
    assert [(r.sample_ord, r.sample_id, r.cap_status, r.priority, r.metadata) for r in rows] == [(0, "sa", "capped", 2, "m"), (1, "sb", "no_cap", 1, "")]
    (files / "bad.tsv").write_text("a.gtf\tx\nb.gtf\tx\nempty.gtf\ty\n")
    (files / "empty.gtf").write_text("")
    errors = manifest.validate(manifest.read_manifest(spark, str(files / "bad.tsv"), str(files)), str(files / "none.gtf"))
    assert [e.split(":")[0] for e in errors] == ["sample IDs occur more than once", "no such file", "no bytes in the file", "no such reference"]
    (files / "odd.tsv").write_text("a.gtf\tx\tcapped\thigh\n")
    odd = manifest.read_manifest(spark, str(files / "odd.tsv"), str(files))
    assert manifest.validate(odd) == ["sample x: its priority is not a whole number"]
    assert "is none of" in manifest.validate(odd.withColumn("cap_status", F.lit("half")))[0]


def test_files_belong_to_the_samples_that_name_them(spark, tmp_path):
    """Paths that end alike, names with blanks, one file for two samples."""
    names = ["a.gtf", "xa.gtf", "x/a.gtf", "x y/a.gtf", "x%20y/a.gtf"]
    for i, n in enumerate(names):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text(lines_of([(f"t{i}", "g", "chr1", "+", [(1 + i, 90)])]))
    (tmp_path / "m.tsv").write_text("".join(f"{n}\ts{i}\n" for i, n in enumerate([*names, names[0]])))
    samples = manifest.read_manifest(spark, str(tmp_path / "m.tsv"), str(tmp_path))
    got = gtf.read_transcripts(spark, samples)
    assert sorted((r.sample_id, r.transcript_id) for r in got.collect()) == [*((f"s{i}", f"t{i}") for i in range(5)), ("s5", "t0")]
    uri = spark.createDataFrame([(0, f"file://{tmp_path}/a.gtf", "s", "no_cap", 1, "")], "sample_ord int, gtf_path string, sample_id string, cap_status string, priority int, metadata string")
    assert gtf.read_transcripts(spark, uri).count() == 1


def test_assembly(spark, files, tmp_path):
    samples = manifest.read_manifest(spark, str(files / "samples.tsv"), str(files))
    t = gtf.read_transcripts(spark, samples).orderBy("ord").collect()
    assert [r.transcript_id for r in t] == ["a1", "a2", "a3", "a4", "b1", "b2", "b3", "b4"]
    assert (t[0].start, t[0].end, t[0].exons[0].start, t[0].junctions[0].donor, t[0].junctions[0].acceptor) == (1000, 2300, 1000, 1200, 1500)
    assert t[0].attributes["gene_name"] == "n" and t[4].sample_id == "sb"
    assert gtf.read_transcripts(spark, samples, chrom="chr1").count() == 6
    (tmp_path / "bare.gtf").write_text(lines_of([("z", "g", "c", "*", [(30, 40), (1, 9)]), ("y", "g", "c", "+", [(5, 6)])], with_heads=False) + "short\tline\n")
    bare = {r.transcript_id: r for r in gtf.read_transcripts(spark, gtf.one_file(spark, str(tmp_path / "bare.gtf"))).collect()}
    assert (bare["z"].start, bare["z"].end, bare["z"].strand, bare["z"].exons[0].strand) == (0, 40, ".", "*") and len(bare) == 2


def test_attributes(spark):
    df = spark.createDataFrame([('a "1"; b "x y"; a "2"; lone; ',), ("",), (None,)], "t string")
    assert [r.m for r in df.select(gtf.parse_attributes(F.col("t")).alias("m")).collect()] == [{"a": "2", "b": "x y"}, {}, None]


def test_natural_order(spark):
    names = ["chrX", "chr10", "chr2", "chr1", "scaffold_7", "chr1_alt"]
    df = gtf.natural_order(spark.createDataFrame([(n,) for n in names], "chrom string"))
    assert [r.chrom for r in df.orderBy("chrom_ord").collect()] == ["chr1", "chr1_alt", "chr2", "chr10", "chrX", "scaffold_7"]


def test_styles(spark, files):
    lines = gtf.read_lines(spark, manifest.read_manifest(spark, str(files / "samples.tsv"), str(files)))
    assert manifest.chromosome_style(lines) == (True, "ucsc")


def test_overlap_join_equals_nested_loops(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice("xy"), a := rnd.randint(0, 3000), a + rnd.randint(0, 900)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, chrom string, start bigint, end bigint")
    want = {(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[2] < b[3] and a[3] > b[2] and a[2] < a[3] and b[2] < b[3]}
    for width in (None, 64, 1 << 17):
        got = [(r.a_id, r.b_id) for r in overlap_join(df, df, ["chrom"], width).select("a_id", "b_id").collect()]
        assert len(got) == len(want) and set(got) == want
    for tol in (0, 40):
        sparse = [(i, c, a * 20, a * 20 + (b - a)) for i, c, a, b in rows if a < b]
        far, now = {}, {}
        for i, c, a, b in sorted(sparse, key=lambda r: (r[2], r[0])):
            if c not in far or a > far[c][0] + tol:
                far[c] = (b, a)
            now[i] = (c, far[c][1])
            far[c] = (max(far[c][0], b), far[c][1])
        t = spark.createDataFrame(sparse, "ord int, chrom string, start bigint, end bigint")
        for stretch in (100, 1 << 22):
            found = islands(t, ["chrom"], F.col("start"), F.col("end"), tol, stretch=stretch)
            assert {r.ord: (r.chrom, r.island) for r in found.collect()} == now


def test_merge_plan(spark, files):
    cfg = MergeConfig(input=str(files / "samples.tsv"), output=str(files / "out"), ref_gtf=str(files / "ref.gtf"), output_extended=True)
    assert run_merge(spark, cfg, str(files)) == {"samples": 2, "input": 8, "merged": 5, "genes": 5}
    head, *rows = [x.split("\t") for x in (files / "out_tracking.tsv").read_text().splitlines()]
    assert len(head) == 31 and all(len(r) == 31 for r in rows)
    got = [dict(zip(head, r, strict=True)) for r in rows]
    shown = [(r["transcript_id"], r["gene_id"], r["merge_status"], r["class_code"], r["sample_ids"], r["tss_coord"], r["tes_coord"]) for r in got]
    assert shown == [
        ("R1", "G1", "exact_match", "=", "sa,sb", "1000", "2300"),
        ("Novel.Tx000001.chr1.o", "G3", "exact_match", "o", "sa,sb", "13000", "11000"),
        ("Novel.Tx000002.chr1.u", "NovelG2", "monoexon_overlap", "u", "sb,sa", "4800", "6500"),
        ("Novel.Tx1000001.chr2.u", "NovelG1", "singleton", "u", "sb", "0", "90"),
        ("Novel.Tx2000001.chr10.u", "NovelG1", "singleton", "u", "sa", "0", "90"),
    ]
    assert got[1]["junction_coords"] == "13000-11700,12100-11000" and got[1]["per_junction_max_coord_diff"] == "j0:1600bp,j1:1400bp"
    assert got[2]["tss_diff_range"] == "0-200bp" and got[0]["per_junction_sample_support"] == "j0:sa:sb,j1:sa:sb"
    text = (files / "out.gtf").read_text().splitlines()
    assert [x.split("\t")[2] for x in text[3:8]] == ["gene", "transcript", "exon", "exon", "exon"]
    assert text[3].endswith('gene_id "G1"; gene_name "NA"; ref_gene_id "G1"; num_transcripts "1"; num_samples "2"')
    more = (files / "out_extended.gtf").read_text().splitlines()[len(text) :]
    assert {x.split('transcript_id "')[1].split('"')[0] for x in more} == {"R3", "R9"}
    before, gtf_before = (files / "out_tracking.tsv").read_text(), (files / "out.gtf").read_text().splitlines()[3:]
    run_merge(spark, MergeConfig(**{**cfg.__dict__, "sharded": True, "output": str(files / "parts"), "at_once": 1}), str(files))
    joined = lambda folder: "".join(p.read_text() for p in sorted((files / folder).glob("part-*"))).splitlines()
    assert joined("parts_tracking.tsv") == before.splitlines() and joined("parts.gtf")[3:] == gtf_before
    assert Counter(joined("parts_extended.gtf")[3:]) == Counter((files / "out_extended.gtf").read_text().splitlines()[3:])


def test_resuming(spark, files, monkeypatch):
    """A run that dies after one chromosome's results goes on from there; other settings start anew."""
    cfg = MergeConfig(input=str(files / "samples.tsv"), output=str(files / "out"), at_once=1)
    made, real = [], merge.merge_transcripts

    def dies(transcripts, *args):
        made.append(sorted({r.chrom for r in transcripts.select("chrom").distinct().collect()}))
        if len(made) == 2:
            raise RuntimeError("lost")
        return real(transcripts, *args)

    monkeypatch.setattr(merge, "merge_transcripts", dies)
    again = MergeConfig(**{**cfg.__dict__, "resume": True, "checkpoint_dir": str(files / "point")})
    with pytest.raises(RuntimeError, match="lost"):
        run_merge(spark, again, str(files))
    assert run_merge(spark, again, str(files)) == {"samples": 2, "input": 8, "merged": 5, "genes": 5}
    assert made == [["chr1"], ["chr2"], ["chr2"], ["chr10"]]
    point = lambda cfg: Staged(spark, str(files / "point"), {k: v for k, v in cfg.__dict__.items() if k not in merge.NOT_RESULTS})
    assert point(again).done() == {"chr1", "chr2", "chr10"} and point(MergeConfig(**{**again.__dict__, "tss_window": 20})).done() == set()


def test_cluster_plan(spark, files):
    cfg = ClusterConfig(input=str(files / "samples.tsv"), output=str(files / "c"), ref_gtf=str(files / "ref.gtf"))
    totals = run_cluster(spark, cfg, str(files))
    rows = [x.split("\t") for x in (files / "c_clusters.tsv").read_text().splitlines()][1:]
    assert totals["inputs"] == 11 and totals["clusters"] == len({r[0] for r in rows})
    assert [r[:3] for r in rows[:3]] == [["C000001", "R1", "yes"], ["C000001", "a1", "no"], ["C000001", "b1", "no"]]
    single = run_cluster(spark, ClusterConfig(input=str(files / "a.gtf"), output=str(files / "d")))
    assert single["inputs"] == 4 and single["singletons"] == 4


def test_command_line():
    cfg = settings(parser().parse_args(["merge", "-i", "x", "-o", "y", "--platform", "ont", "--max_5trunc", "-1", "--output_extended", "--threads", "8"]))
    assert (cfg.junction_threshold, cfg.max_5trunc, cfg.output_extended, cfg.checkpoint_dir) == (5, -1, True, "y_checkpoint")
    assert settings(parser().parse_args(["cluster", "-i", "x", "-o", "y", "--min_similarity", "0.5"])).min_similarity == 0.5


def test_arrivals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.gtf").write_text(lines_of(A))
    run = lambda: stream_transcripts(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    run()
    (tmp_path / "in/b.gtf").write_text(lines_of(B))
    run()
    assert {(r.sample_id, r.transcript_id) for r in staged_transcripts(spark, str(tmp_path / "out")).collect()} == {("a", x[0]) for x in A} | {("b", x[0]) for x in B}


# A toy of three samples and a reference: transcript, gene, strand, exons; all on chr1. Results were worked out by hand.
GENE = ["ENSMUSG00000000001", "ENSMUSG00000000002", "ENSMUSG00000000003"]
T = ["ENSMUST00000000001", "ENSMUST00000000002", "ENSMUST00000000003"]
LONG_1, LONG_2 = [(1001, 1200), (1501, 1800), (2001, 2300), (2601, 3000), (3201, 5000)], [(6001, 6300), (6601, 6900), (7201, 7600), (7901, 9500)]
TOY = {
    "ref": [(T[0], GENE[0], "+", LONG_1), (T[1], GENE[1], "+", LONG_2), (T[2], GENE[2], "-", MINUS)],
    "brain": [(T[0], GENE[0], "+", LONG_1), ("transcript1.chr1.nic", GENE[0], "+", [(1050, 1200), *LONG_1[1:]]), (T[1], GENE[1], "+", LONG_2), (T[2], GENE[2], "-", MINUS),
              ("transcript2.chr1.nnic", "N1", "+", [(15001, 16500)])],
    "liver": [(T[0] + ".liver", GENE[0], "+", LONG_1[1:]), (T[1] + ".liver", GENE[1], "+", [(6002, 6300), (6601, 6900), (7201, 7601), (7901, 9500)]), (T[2] + ".liver", GENE[2], "-", MINUS[:2]),
              ("transcript3.chr1.nnic", "N1", "+", [(15100, 16500)]), ("transcript4.chr1.nnic", "N2", "+", [(20001, 20500), (21001, 21500), (22001, 23000)])],
    "ESC": [(T[0] + ".esc", GENE[0], "+", LONG_1), ("transcript5.chr1.nic", GENE[0], "+", [(1001, 1200), (1501, 1800), (2001, 3000)]), (T[1] + ".esc", GENE[1], "+", LONG_2),
            (T[2] + ".esc", GENE[2], "-", MINUS), ("transcript6.chr1.nnic", "N1", "+", [(14800, 16500)]), ("transcript7.chr1.nnic", "N3", "-", [(25001, 27000)])],
}


@pytest.fixture
def toy(tmp_path):
    for name, rows in TOY.items():
        (tmp_path / f"{name}.gtf").write_text(lines_of([(t, g, "chr1", s, x) for t, g, s, x in rows]))
    (tmp_path / "samples.tsv").write_text("".join(f"{n}.gtf\t{n}\tno_cap\t1\n" for n in ("brain", "liver", "ESC")))
    return tmp_path


def test_toy_merge(spark, toy):
    cfg = MergeConfig(input=str(toy / "samples.tsv"), output=str(toy / "o"), ref_gtf=str(toy / "ref.gtf"), output_extended=True)
    assert run_merge(spark, cfg, str(toy)) == {"samples": 3, "input": 16, "merged": 9, "genes": 6}
    head, *rows = [x.split("\t") for x in (toy / "o_tracking.tsv").read_text().splitlines()]
    got = [dict(zip(head, r, strict=True)) for r in rows]
    shown = "transcript_id gene_id merge_status class_code sample_ids junction_coords tss_coord tes_coord".split()
    assert [" ".join(r[c] for c in shown) for r in got] == [
        f"{T[0]} {GENE[0]} exact_match = brain,ESC 1200-1500,1800-2000,2300-2600,3000-3200 1000 5000",
        f"Novel.Tx000001.chr1.c {GENE[0]} singleton c liver 1800-2000,2300-2600,3000-3200 1500 5000",
        f"{T[1]} {GENE[1]} exact_match = brain,liver,ESC 6300-6600,6900-7200,7600-7900 6000 9500",
        "Novel.Tx000002.chr1.u NovelG4 singleton u liver 20500-21000,21500-22000 20000 23000",
        f"Novel.Tx000003.chr1.c {GENE[0]} singleton c ESC 1200-1500,1800-2000 1000 3000",
        f"Novel.Tx000004.chr1.o {GENE[2]} exact_match o brain,ESC 13000-11700,12100-11000 13000 11000",
        f"Novel.Tx000005.chr1.o {GENE[2]} singleton o liver 12100-11000 12100 11000",
        "Novel.Tx000006.chr1.u NovelG3 monoexon_overlap u ESC,brain,liver NA 14799 16500",
        "Novel.Tx000007.chr1.u NovelG6 singleton u ESC NA 27000 25000",
    ]
    more = "per_junction_max_coord_diff diff_junction_count diff_junction_ratio tss_diff_range freq_score".split()
    assert [got[2][c] for c in more] == ["j0:0bp,j1:0bp,j2:1bp", "1", "0.3333", "0-1bp", "1.0000"] and got[0]["freq_score"] == "0.6667"
    assert got[5]["per_junction_max_coord_diff"] == "j0:1600bp,j1:1400bp" and got[6]["per_junction_max_coord_diff"] == "j0:700bp" and got[7]["tss_diff_range"] == "0-300bp"
    genes = [x.split("\t")[8] for x in (toy / "o.gtf").read_text().splitlines() if "\tgene\t" in x]
    assert [(g.split('"')[1], g.split('num_transcripts "')[1][0]) for g in genes] == [(GENE[0], "3"), (GENE[1], "1"), (GENE[2], "2"), ("NovelG3", "1"), ("NovelG4", "1"), ("NovelG6", "1")]
    left = [x.split("\t") for x in (toy / "o_extended.gtf").read_text().splitlines()[len((toy / "o.gtf").read_text().splitlines()) :]]
    assert [x[2] for x in left] == ["transcript", "exon", "exon", "exon"] and all(T[2] in x[8] for x in left)


def test_toy_clusters(spark, toy):
    totals = run_cluster(spark, ClusterConfig(input=str(toy / "samples.tsv"), output=str(toy / "c"), ref_gtf=str(toy / "ref.gtf")), str(toy))
    assert (totals["inputs"], totals["clusters"], totals["singletons"]) == (19, 8, 4)
    rows = [x.split("\t") for x in (toy / "c_clusters.tsv").read_text().splitlines()[1:]]
    got = {}
    for r in rows:
        got.setdefault(r[0], []).append((r[1], r[3]))
    one = "1.0000"
    assert {k: sorted(v) for k, v in got.items()} == {
        "C000001": sorted([(T[0], one), (T[0], one), (T[0] + ".esc", one), ("transcript1.chr1.nic", "0.9902"), (T[0] + ".liver", "0.7853")]),
        "C000002": sorted([(T[1], one), (T[1], one), (T[1] + ".esc", one), (T[1] + ".liver", "0.9998")]),
        "C000003": [("transcript4.chr1.nnic", one)],
        "C000004": sorted([("transcript6.chr1.nnic", one), ("transcript2.chr1.nnic", "0.8818"), ("transcript3.chr1.nnic", "0.8236")]),
        "C000005": [("transcript5.chr1.nic", one)],
        "C000006": sorted([(T[2], one), (T[2], one), (T[2] + ".esc", one)]),
        "C000007": [("transcript7.chr1.nnic", one)],
        "C000008": [(T[2] + ".liver", one)],
    }


def test_empty_input(spark):
    from isolume.plans.merge import consolidate

    assert consolidate(frame(spark, []), MergeConfig(), 1).count() == 0
    assert consolidate(frame(spark, [row([(5, 6)], start=0, end=9)]), MergeConfig(), 1).count() == 1
