"""Command line: python -m stratavox.cli {locate,filter,summarize,collate,analyze} …"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from . import api
from .session import scratch
from .sources import files
from .sources.volumes import read_label_volume


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="stratavox", formatter_class=argparse.ArgumentDefaultsHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *flags: tuple[str, dict]) -> None:
        sub = commands.add_parser(name, formatter_class=argparse.ArgumentDefaultsHelpFormatter)
        for flag, options in flags:
            sub.add_argument(flag, **options)

    need, many = {"required": True}, {"action": "append", "default": []}
    # one input and output, or all files below a folder, whose outputs come under the same names in another one; finished ones are skipped
    source = [("--cells", {}), ("--root", {}), ("--suffix", {"default": ".parquet"}), ("--exclude", many), ("--output-root", {}), ("--all-types", {"action": "store_true"})]
    outline = ("--outline", need)
    command("locate", *source, ("--volume", need), ("--atlas-name", {"default": ""}), ("--outline", {}), ("--output", {}))
    command("filter", *source, ("--filter", {**many, "required": True}), ("--output", {}), ("--removed", {}))
    command("summarize", *source, outline, ("--volumes", need), ("--output", {}), ("--filter", many), ("--atlas-name", {"default": ""}), ("--merge-tree", {}), ("--levels", {"action": "store_true"}))
    lookup = [("--metadata", need), ("--summaries-root", need), ("--channel", {**many, "type": int, "required": True}), ("--lookup-column", need), ("--pattern", need)]
    command("collate", *lookup, ("--first-columns", {"type": int, "default": 1}), ("--output", need))
    command(
        "analyze", *lookup, outline, ("--factor", {**many, "required": True}), ("--exclude-group", {"action": "append", "nargs": "+", "default": []}), ("--region-column", {"default": "ID"}),
        ("--include-region", {**many, "type": int}), ("--exclude-region", {**many, "type": int}), ("--stat-column", need), ("--average-column", many), ("--all-regions", {"action": "store_true"}),
        ("--t-test", {"action": "store_true"}), ("--false-discovery", {"action": "store_true"}), ("--negative-binomial", {"action": "store_true"}),
        ("--raw", {}), ("--means", {}), ("--matrix", {}), ("--samples", {}), ("--analyzed", {}),
    )
    return top


def parse_group(pairs: list[str]) -> dict[str, str]:
    """Key=Value texts of one excluded group, without case."""
    group = {}
    for pair in pairs:
        key, sep, value = pair.partition("=")
        if not sep:
            raise ValueError(f"Not Key=Value: {pair!r}")
        group[key.lower()] = value.lower()
    return group


def jobs(spark: SparkSession, args: argparse.Namespace) -> list[argparse.Namespace]:
    """One set of arguments per input: the given one, or every file below ``--root`` that has no output yet."""
    if args.command not in ("locate", "filter", "summarize") or args.cells:
        if args.command in ("locate", "summarize") and not args.output:
            raise ValueError("--cells needs --output")
        return [args]
    if not args.root or not args.output_root:
        raise ValueError("Give --cells, or --root and --output-root")
    found = files.discover(spark, args.root, args.suffix, tuple(args.exclude))
    start = len(files.plain_path(args.root).rstrip("/")) + 1
    end = ".csv" if args.command == "summarize" else ".parquet"
    pairs = [(path, f"{args.output_root.rstrip('/')}/{files.plain_path(path)[start:].removesuffix(args.suffix)}{end}") for path in found]
    return [argparse.Namespace(**{**vars(args), "cells": cells, "output": output}) for cells, output in files.without_outputs(spark, pairs)]


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    """All jobs of the arguments, one after another; intermediate tables go with each."""
    for job in jobs(spark, args):
        with scratch():
            _run(spark, job)


def _run(spark: SparkSession, args: argparse.Namespace) -> None:
    cells = files.read_cells(spark, args.cells, not args.all_types) if hasattr(args, "cells") else None
    if args.command == "locate":
        tree = files.read_outline(spark, args.outline) if args.outline else None
        api.locate_cells(cells=cells, annotation=read_label_volume(spark, args.volume), atlas_name=args.atlas_name, outline=tree, output_path=args.output)
    elif args.command == "filter":
        api.filter_cells(cells=cells, cell_filters=args.filter, output_path=args.output, removed_path=args.removed)
    elif args.command == "summarize":
        merge = files.read_merge_tree(spark, args.merge_tree) if args.merge_tree else None
        api.summarize_regions(
            cells=cells, outline=files.read_outline(spark, args.outline), volumes=files.read_volumes(spark, args.volumes), output_path=args.output, cell_filters=args.filter,
            atlas_name=args.atlas_name, merge_tree=merge, levels=args.levels,
        )
    elif args.command == "collate":
        api.collate_summaries(
            spark=spark, metadata_path=args.metadata, summaries_root=args.summaries_root, channels=args.channel, lookup_column=args.lookup_column, first_columns=args.first_columns, pattern=args.pattern, output_path=args.output
        )
    else:
        api.analyze_summaries(
            spark=spark, metadata_path=args.metadata, lookup_column=args.lookup_column, factors=args.factor, summaries_root=args.summaries_root, channels=args.channel, pattern=args.pattern,
            outline=files.read_outline(spark, args.outline), stat_column=args.stat_column, average_columns=args.average_column, region_column=args.region_column,
            excluded_groups=[parse_group(g) for g in args.exclude_group], include_regions=args.include_region, exclude_regions=args.exclude_region, only_leafs=not args.all_regions,
            t_test=args.t_test, false_discovery=args.false_discovery, negative_binomial=args.negative_binomial,
            raw_path=args.raw, means_path=args.means, matrix_path=args.matrix, samples_path=args.samples, analyzed_path=args.analyzed,
        )


def main() -> None:
    logging.basicConfig(level=logging.INFO)
    run(SparkSession.builder.appName("stratavox").getOrCreate(), parser().parse_args())


if __name__ == "__main__":
    main()
