"""``python -m probelake.cli``: the run as a whole or step by step, and conversion of probe sets."""

from __future__ import annotations

import argparse
import inspect
import os

from pyspark.sql import SparkSession

from . import tech as techs
from .operators.manifest import convert_probes, revert_probes
from .plans import pipeline
from .sources import read_panel


def _reads(sub: argparse.ArgumentParser, multiplex: int) -> None:
    sub.add_argument("--probes", required=True)
    sub.add_argument("--trim_probes", type=int, default=-1)
    sub.add_argument("-r1", nargs="*")
    sub.add_argument("-r2", nargs="*")
    sub.add_argument("--project", help="prefix or pattern of the reads' files")
    sub.add_argument("--whitelist", nargs="+", required=True, help="cell barcodes; for two-part barcodes the lists of both halves")
    sub.add_argument("--samples", help="list of sample barcodes: entry, corrected, well")
    which = sub.add_mutually_exclusive_group()
    which.add_argument("--multiplex", type=int, default=multiplex)
    which.add_argument("--barcode", action="append", default=[])
    sub.add_argument("--technology", default="Flex")
    sub.add_argument("--tech_def", help="module:name of a technology of one's own")
    sub.add_argument("--cellranger_output", action="append", default=[])
    sub.add_argument("--r1_length", type=int)
    sub.add_argument("--r2_length", type=int)
    sub.add_argument("--threshold", type=float, default=1)
    for flag in ("--unmapped_reads", "--skip_constant_seq", "--allow_any_combination", "--flexible_start_mapping", "--allow_indels"):
        sub.add_argument(flag, action="store_true")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="probelake")
    subs = out.add_subparsers(dest="command", required=True)
    steps = {name: subs.add_parser(name) for name in ("run", "count", "correct-umis", "correct-gapfill", "collect", "summarize")}
    for sub in steps.values():
        sub.add_argument("--output", required=True)
        sub.add_argument("--overwrite", action="store_true")
        sub.add_argument("--cores", type=int, default=1, help="for a session of its own: local threads, all below 1")
    _reads(steps["run"], 0)
    _reads(steps["count"], 1)
    steps["correct-umis"].add_argument("--threshold", type=float, default=1)
    for name in ("run", "correct-umis"):
        steps[name].add_argument("--allow_chimeras", action="store_true")
    for name in ("run", "collect"):
        steps[name].add_argument("--max_pcr_thresholds", type=int, default=10)
    for name in ("run", "collect", "summarize"):
        steps[name].add_argument("--flatten", action="store_true")
        steps[name].add_argument("--reads_per_gapfill", type=int, default=0)
    steps["summarize"].add_argument("--cellranger_output", action="append", default=[])
    steps["collect"].add_argument("--multiplex", type=int, default=1)
    for name in ("convert-probes", "revert-probes"):
        sub = subs.add_parser(name)
        sub.add_argument("--input", required=True)
        sub.add_argument("--output", required=True)
    subs.add_parser("print-tech")
    return out


def _count_args(a: argparse.Namespace) -> dict:
    tech = techs.load(a.tech_def) if a.tech_def else techs.technology(a.technology)
    if a.multiplex > 1 and not a.samples:
        raise SystemExit("--multiplex needs --samples")
    if not a.project and not a.r1:
        raise SystemExit("name the reads by --project or by -r1 and -r2")
    return {
        "fastqs": a.project, "r1": a.r1, "r2": a.r2, "panel": a.probes, "whitelist": a.whitelist, "output": a.output, "tech": tech, "samples": a.samples, "decoys": a.allow_any_combination, "trim": a.trim_probes,
        "per10": a.threshold, "skip_constant": a.skip_constant_seq, "flexible": a.flexible_start_mapping, "indels": a.allow_indels, "unmapped": a.unmapped_reads, "overwrite": a.overwrite,
        "barcodes": a.barcode or None, "r1_length": a.r1_length, "r2_length": a.r2_length, "wta": a.cellranger_output or None,
    }


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    if a.command == "print-tech":
        print(inspect.getsource(techs))
        return
    builder = SparkSession.builder.appName("probelake")
    if getattr(a, "cores", None) is not None and "PYSPARK_GATEWAY_PORT" not in os.environ and SparkSession.getActiveSession() is None:
        builder = builder.master(f"local[{a.cores if a.cores >= 1 else '*'}]")  # not under spark-submit, which names a master
    spark = builder.getOrCreate()
    if a.command == "run":
        pipeline.run(spark, **_count_args(a), allow_chimeras=a.allow_chimeras, reads_per_gapfill=a.reads_per_gapfill, max_pcr_thresholds=a.max_pcr_thresholds, flatten=a.flatten)
    elif a.command == "count":
        pipeline.count(spark, **_count_args(a))
    elif a.command == "correct-umis":
        pipeline.correct_umis(spark, a.output, a.threshold, a.allow_chimeras, a.overwrite)
    elif a.command == "correct-gapfill":
        pipeline.correct_gapfills(spark, a.output, a.overwrite)
    elif a.command == "collect":
        pipeline.collect(spark, a.output, a.max_pcr_thresholds, a.reads_per_gapfill, a.flatten, a.overwrite)
    elif a.command == "summarize":
        pipeline.summarize(spark, a.output, a.overwrite, a.cellranger_output or None, a.reads_per_gapfill, a.flatten)
    elif a.command == "convert-probes":
        convert_probes(spark.read.csv(a.input, header=True, comment="#")).write.csv(a.output, sep="\t", header=True)
    else:
        revert_probes(read_panel(spark, a.input)).write.csv(a.output, header=True)


if __name__ == "__main__":
    main()
