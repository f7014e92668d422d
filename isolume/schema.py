"""Types of the nested transcript model. Coordinates are 0-based and half-open."""

from __future__ import annotations

EXON = "struct<start:bigint,end:bigint,strand:string>"
JUNCTION = "struct<donor:bigint,acceptor:bigint,strand:string>"

MANIFEST = "sample_ord int, gtf_path string, sample_id string, cap_status string, priority int, metadata string"

#: ord numbers the input: samples in manifest order, lines in file order.
TRANSCRIPT = (
    "transcript_id string, gene_id string, chrom string, start bigint, end bigint, strand string, sample_id string, "
    f"ord bigint, exons array<{EXON}>, junctions array<{JUNCTION}>, attributes map<string,string>"
)
