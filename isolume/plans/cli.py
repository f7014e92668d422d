"""Command line: merge and cluster.

Options that only concern threads and temporary files are accepted and left to Spark. --representative_order is
accepted too; representatives are always taken with references first.
"""

from __future__ import annotations

import argparse
import logging
from dataclasses import MISSING, fields

from pyspark.sql import SparkSession

from isolume import __version__
from isolume.config import ClusterConfig, MergeConfig

#: Options whose values are one of a few.
CHOICES = {
    "platform": ["pacbio", "ont", "custom"],
    "tss_strategy": ["longest", "common", "freq"],
    "tes_strategy": ["longest", "common", "freq"],
    "representative_order": ["ref_first", "length", "samples", "random"],
}


def _add_settings(command: argparse.ArgumentParser, config: type) -> None:
    """An option for each field of the settings, with its default and type."""
    command.add_argument("-i", "--input", required=True)
    command.add_argument("-o", "--output", required=True)
    for f in fields(config):
        if f.name in ("input", "output"):
            continue
        default = None if f.default is MISSING else f.default
        if isinstance(default, bool):
            command.add_argument(f"--{f.name}", action="store_true")
        else:
            command.add_argument(f"--{f.name}", default=default, type=str if default is None else type(default), choices=CHOICES.get(f.name))
    command.add_argument("--threads", type=int, default=4)
    command.add_argument("--tmp_dir", default="/tmp")
    command.add_argument("--verbose", action="store_true")
    command.add_argument("--log_file", default="")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="isolume")
    p.add_argument("--version", action="version", version=f"isolume {__version__}")
    commands = p.add_subparsers(dest="command", required=True)
    merge = commands.add_parser("merge", formatter_class=argparse.ArgumentDefaultsHelpFormatter)
    _add_settings(merge, MergeConfig)
    merge.add_argument("--keep_tmp", action="store_true")
    cluster = commands.add_parser("cluster", formatter_class=argparse.ArgumentDefaultsHelpFormatter)
    _add_settings(cluster, ClusterConfig)
    cluster.add_argument("--representative_order", default="ref_first", choices=CHOICES["representative_order"])
    return p


def settings(args: argparse.Namespace) -> MergeConfig | ClusterConfig:
    config = MergeConfig if args.command == "merge" else ClusterConfig
    return config(**{f.name: getattr(args, f.name) for f in fields(config)})


def main(argv: list[str] | None = None) -> None:
    from isolume.plans.cluster import run_cluster
    from isolume.plans.merge import run_merge

    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO, filename=args.log_file or None)
    spark = SparkSession.builder.appName(f"isolume {args.command}").getOrCreate()
    cfg = settings(args)
    totals = run_merge(spark, cfg) if args.command == "merge" else run_cluster(spark, cfg)
    print("\n".join(f"{k}: {v}" for k, v in totals.items()))
