"""Settings of the two commands and the fixed code tables."""

from __future__ import annotations

from dataclasses import dataclass

# Class codes and their priority, the least first.
CLASS_CODE_PRIORITY = {"=": 1, "c": 2, "k": 3, "m": 4, "n": 5, "j": 6, "e": 7, "o": 8, "s": 9, "x": 10, "i": 11, "y": 12, "p": 13, "u": 14}
# Statuses of a pair that may be merged, the best first; two kinds of truncation are equally good.
STATUS_PRIORITY = {"exact_match": 1, "fuzzy_match": 2, "truncation_5": 3, "truncation_3": 3, "truncation_both": 4}


@dataclass(frozen=True)
class MergeConfig:
    """Consolidation of samples.

    Options that are not in the compatible behaviour are off by default: unlimited_5trunc (a negative limit
    means none), strand_aware_trunc (5' and 3' after the strand), fix_minus_strand (outer exons of minus-strand
    representatives keep their sides), min_samples and min_transcript_len (filters on results and inputs), sharded
    (folders of ordered parts instead of single files). at_once: transcripts of one resume point, about.
    """

    input: str = ""
    output: str = ""
    ref_gtf: str | None = None
    novel_prefix: str = "Novel"
    output_extended: bool = False
    platform: str = "pacbio"
    junction_threshold: int = 3
    max_5trunc: int = 1
    max_3trunc: int = 0
    tss_window: int = 200
    tes_window: int = 50
    max_diff_count: int = -1
    max_diff_ratio: float = 0.5
    mono_overlap: float = 0.5
    mono_5end: int = 500
    mono_3end: int = 50
    tss_strategy: str = "longest"
    tes_strategy: str = "freq"
    min_samples: int = 1
    min_transcript_len: int = 0
    unlimited_5trunc: bool = False
    strand_aware_trunc: bool = False
    fix_minus_strand: bool = False
    checkpoint_dir: str = ""
    resume: bool = False
    force: bool = False
    sharded: bool = False
    at_once: int = 5_000_000

    def __post_init__(self):
        if self.platform == "ont" and self.junction_threshold == 3:  # noisier reads
            object.__setattr__(self, "junction_threshold", 5)
        if not self.checkpoint_dir and self.output:
            object.__setattr__(self, "checkpoint_dir", f"{self.output}_checkpoint")


@dataclass(frozen=True)
class ClusterConfig:
    """Similarity clusters. classify_members (off by default) labels members against the reference; sharded as in merging."""

    input: str = ""
    output: str = ""
    ref_gtf: str | None = None
    junction_threshold: int = 3
    fuzzy_threshold: int = 50
    weight_structural: float = 0.4
    weight_junction: float = 0.4
    weight_jaccard: float = 0.2
    min_similarity: float = 0.7
    classify_members: bool = False
    sharded: bool = False
