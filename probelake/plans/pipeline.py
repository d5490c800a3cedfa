"""The staged run, reads to summary: every stage a Parquet folder, skipped when its ``_SUCCESS`` is there.

A run of several samples (``samples``) keeps them apart from end to end: a cell is a barcode of a sample, and entries,
layers, features and the summary have the sample's column, by which tables are partitioned on disk.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import counts, filters, mapping, molecules
from ..operators.manifest import build_manifest
from ..sources import possible_barcodes, read_fastqs, read_panel, read_slide, read_well_list, read_whitelist, write_unmapped
from ..tech import Technology, technology

PLEX = "probe_barcode"


def staged(spark: SparkSession, path: str, make: Callable[[], DataFrame], overwrite: bool = False, partition: str | None = None) -> DataFrame:
    """``make()`` written at ``path``, unless a finished write is there."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if overwrite or not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        out = make().write.mode("overwrite")
        (out.partitionBy(partition) if partition else out).parquet(path)
    if partition:  # a sample's number stays text
        found = spark.read.option("basePath", path).parquet(path)
        return found.withColumn(partition, F.col(partition).cast("string"))
    return spark.read.parquet(path)


def count(
    spark: SparkSession, fastqs: str | None, panel: str, whitelist: str | list[str], output: str, tech: str | Technology = "Flex", samples: str | None = None, decoys: bool = False, trim: int = -1, per10: float = 1,
    skip_constant: bool = False, flexible: bool = False, indels: bool = False, unmapped: bool = False, overwrite: bool = False, r1: list[str] | None = None, r2: list[str] | None = None,
    barcodes: list[str] | None = None, r1_length: int | None = None, r2_length: int | None = None, wta: list[str] | None = None,
) -> dict[str, DataFrame]:
    """First step: probes, mapped reads, cells and metrics. ``barcodes``: samples that pass; ``wta``: 10x outputs whose cells pass."""
    tech = technology(tech)
    at = lambda name, make, part=None: staged(spark, f"{output}/{name}", make, overwrite, part)
    if skip_constant and samples:
        raise ValueError("without the constant sequence samples can't be told apart")
    manifest = at("probes", lambda: build_manifest(read_panel(spark, panel), decoys, trim))
    reads = read_fastqs(spark, fastqs, r1, r2)
    if tech.two_part:
        listed = read_slide(spark, *([whitelist] if isinstance(whitelist, str) else whitelist))
    else:
        listed = read_whitelist(spark, *([whitelist] if isinstance(whitelist, str) else whitelist))
        known = possible_barcodes(spark, wta) if wta else None
        listed = listed.join(known, "entry", "left_semi") if known is not None else listed
    sample_list, allowed = None, None
    if samples:
        wells = read_well_list(spark, samples)
        sample_list = wells.select("entry").distinct()
        if barcodes:
            rows = wells.collect()  # at most a few hundred
            names = {r["well"] or r["entry"]: r["entry"] for r in rows} | {str(k + 1): r["entry"] for k, r in enumerate(rows)}
            allowed = [names[x] for x in tech.sample_ids(barcodes, list(names))]
    mapped = at("mapped", lambda: mapping.map_reads(reads, manifest, listed, tech, sample_list, per10, skip_constant, flexible, indels, r1_length, r2_length, allowed), PLEX)
    if unmapped:
        write_unmapped(mapped, reads, f"{output}/unmapped")
    good = mapped.filter("probe_idx is not null")
    cells = at("cells", lambda: counts.cell_index(good, ["cell_barcode", PLEX], written=f"{output}/cells_unnumbered").withColumnRenamed("cell_barcode", "barcode"))
    metrics = at("metrics", lambda: counts.state_metrics(mapped, probes=manifest.count()))
    return {"probes": manifest, "mapped": mapped, "cells": cells, "metrics": metrics}


def correct_umis(spark: SparkSession, output: str, per10: float = 1, allow_chimeras: bool = False, overwrite: bool = False) -> DataFrame:
    """Second step: mapped reads under their cells' numbers, identifiers corrected, chimeras removed."""

    def corrected() -> DataFrame:
        cells = spark.read.parquet(f"{output}/cells").select(F.col("barcode").alias("cell_barcode"), PLEX, "cell_idx")
        mapped = spark.read.parquet(f"{output}/mapped").withColumn(PLEX, F.col(PLEX).cast("string"))
        indexed = mapped.filter("probe_idx is not null").join(cells, ["cell_barcode", PLEX])
        fixed = molecules.correct_umis(indexed, per10)
        fixed = fixed if allow_chimeras else molecules.remove_chimeras(fixed)
        return fixed.drop("umi").withColumnRenamed("corrected_umi", "umi")

    return staged(spark, f"{output}/umis", corrected, overwrite, PLEX)


def correct_gapfills(spark: SparkSession, output: str, overwrite: bool = False) -> DataFrame:
    """Third step: one row a molecule, with its consensus gapfill."""
    reads = lambda: spark.read.parquet(f"{output}/umis").withColumn(PLEX, F.col(PLEX).cast("string"))
    return staged(spark, f"{output}/molecules", lambda: molecules.consensus(reads()), overwrite, PLEX)


def collect(spark: SparkSession, output: str, max_pcr_thresholds: int = 10, reads_per_gapfill: int = 0, flatten: bool = False, overwrite: bool = False) -> dict[str, DataFrame]:
    """Fourth step: entries, layers and features by sample, the run's attributes, and the flat table on request."""
    at = lambda name, make, part=None: staged(spark, f"{output}/{name}", make, overwrite, part)
    mols = spark.read.parquet(f"{output}/molecules").withColumn(PLEX, F.col(PLEX).cast("string"))
    cells = spark.read.parquet(f"{output}/cells")
    kept = mols.filter(F.col("pcr_duplicate_count") >= reads_per_gapfill)
    out = {
        "entries": at("entries", lambda: counts.collect_counts(counts.of_cells(kept, cells), (PLEX,)), PLEX), "features": at("features", lambda: counts.feature_dictionary(kept, (PLEX,))),
        "pcr_layers": at("pcr_layers", lambda: counts.pcr_layers(kept, max_pcr_thresholds, (PLEX,)), PLEX),
    }

    def attributes() -> DataFrame:
        per = cells.groupBy(PLEX).agg(F.count(F.lit(1)).alias("n_cells"))
        per = per.join(out["features"].groupBy(PLEX).agg(F.countDistinct("probe_idx").alias("n_probes"), F.count(F.lit(1)).alias("n_probe_gapfill_combinations")), PLEX, "left")
        per = per.join(kept.groupBy(PLEX).agg(F.max("pcr_duplicate_count").alias("max_pcr_duplicates")), PLEX, "left")
        return per.withColumns({"project": F.lit(output.rstrip("/").rsplit("/", 1)[-1]), "created_date": F.lit(datetime.now(timezone.utc).isoformat(timespec="seconds"))})

    out["attributes"] = at("attributes", attributes)
    if flatten:
        out["flat"] = at("flat", lambda: counts.flat_file(kept, spark.read.parquet(f"{output}/probes"), cells))
    return out


def summarize(spark: SparkSession, output: str, overwrite: bool = False, wta: list[str] | None = None, reads_per_gapfill: int = 0, flatten: bool = False) -> dict[str, DataFrame]:
    """Fifth step: the summary over all samples and by sample; with ``wta``, also of the cells that those outputs call.

    ``reads_per_gapfill`` recounts molecules with so many reads at least; ``flatten`` filters the flat table alike.
    """
    at = lambda name, make, part=None: staged(spark, f"{output}/{name}", make, overwrite, part)
    cells = spark.read.parquet(f"{output}/cells")
    entries = spark.read.parquet(f"{output}/entries").withColumn(PLEX, F.col(PLEX).cast("string"))
    if reads_per_gapfill > 0:
        mols = spark.read.parquet(f"{output}/molecules").withColumn(PLEX, F.col(PLEX).cast("string"))
        recounted = lambda: counts.collect_counts(mols.filter(F.col("pcr_duplicate_count") >= reads_per_gapfill), (PLEX,))
        entries = at("filtered_entries", recounted, PLEX)
    out = {"summary": at("summary", lambda: counts.summarize(entries, cells)), "summary_by_plex": at("summary_by_plex", lambda: counts.summarize_by(entries, cells))}
    called = possible_barcodes(spark, wta) if wta else None
    if called is not None:
        listed = called.select(F.col("entry").alias("barcode"), F.xxhash64("entry").alias("position"))
        moved, new = filters.filter_barcodes(entries.drop(PLEX), cells, listed)
        out["filtered_cells"] = at("filtered_cells", lambda: new)
        out["filtered_summary"] = at("filtered_summary", lambda: counts.summarize(moved, new))
    if flatten:
        flat = spark.read.parquet(f"{output}/flat").filter(F.col("pcr_duplicate_count") >= reads_per_gapfill)
        out["filtered_flat"] = at("filtered_flat", lambda: flat.join(called.withColumnRenamed("entry", "barcode"), "barcode", "left_semi") if called is not None else flat)
    return out


def run(
    spark: SparkSession, fastqs: str | None, panel: str, whitelist: str | list[str], output: str, tech: str | Technology = "Flex", samples: str | None = None, decoys: bool = False, trim: int = -1, per10: float = 1,
    allow_chimeras: bool = False, skip_constant: bool = False, flexible: bool = False, indels: bool = False, reads_per_gapfill: int = 0, max_pcr_thresholds: int = 10,
    flatten: bool = False, unmapped: bool = False, overwrite: bool = False, r1: list[str] | None = None, r2: list[str] | None = None, barcodes: list[str] | None = None,
    r1_length: int | None = None, r2_length: int | None = None, wta: list[str] | None = None,
) -> dict[str, DataFrame]:
    """The tables of a run, by name: all five steps."""
    out = count(spark, fastqs, panel, whitelist, output, tech, samples, decoys, trim, per10, skip_constant, flexible, indels, unmapped, overwrite, r1, r2, barcodes, r1_length, r2_length, wta)
    correct_umis(spark, output, per10, allow_chimeras, overwrite)
    out["molecules"] = correct_gapfills(spark, output, overwrite)
    out |= collect(spark, output, max_pcr_thresholds, reads_per_gapfill, flatten, overwrite)
    return out | summarize(spark, output, overwrite, wta)
