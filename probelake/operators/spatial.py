"""Spatial bins: coarser grids, joins with a whole-transcriptome grid, and image blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tech import spatial_barcode
from .genotypes import call_genotypes
from .knn import impute_genotypes


def bin_entries(entries: DataFrame, resolutions: tuple[int, ...] = (8,), base: int = 2) -> DataFrame:
    """(resolution, row, col, barcode, probe_idx, gapfill, n_umis): entries of ``base`` micron bins summed on coarser grids.

    Several resolutions come from one pass: sums at the finest are the input of none other, so each entry is expanded
    by resolution and combined before the shuffle.
    """
    for r in resolutions:
        if r % base or (r // base) & (r // base - 1):
            raise ValueError(f"{r} is not {base} times a power of two")
    sizes = F.explode(F.array(*[F.lit(r) for r in resolutions]))
    out = entries.withColumn("resolution", sizes)
    k = F.col("resolution") / base
    out = out.groupBy("resolution", F.floor(F.col("row") / k).alias("row"), F.floor(F.col("col") / k).alias("col"), "probe_idx", "gapfill").agg(F.sum("n_umis").alias("n_umis"))
    name = F.format_string("s_%03dum_%05d_%05d-1", F.col("resolution"), F.col("row"), F.col("col"))
    return out.withColumn("barcode", name)


def join_with_wta(entries: DataFrame, wta_bins: DataFrame, resolutions: tuple[int, ...] = (2, 8, 16), base: int = 2) -> DataFrame:
    """Every bin of ``wta_bins`` (resolution, row, col) with its entries; bins without have one row of nulls and n_umis 0."""
    binned = bin_entries(entries, resolutions, base).drop("barcode")
    out = wta_bins.join(binned, ["resolution", "row", "col"], "left")
    return out.withColumn("n_umis", F.coalesce("n_umis", F.lit(0)))


def marginals(entries: DataFrame) -> DataFrame:
    """(row, col, level, n_umis): sums by bin, by row and by column, in one grouping-sets pass; ``level`` tells which."""
    out = entries.groupingSets([["row", "col"], ["row"], ["col"]], "row", "col").agg(F.sum("n_umis").alias("n_umis"), F.grouping_id().alias("level"))
    return out.select("row", "col", "level", "n_umis")


def downsample(pixels: DataFrame, factor: int) -> DataFrame:
    """(row, col, value): block means of ``pixels`` (row, col, value, alpha) that are not empty and not transparent."""
    shown = (F.col("alpha") > 0) & (F.col("value") > 0)
    return pixels.groupBy(F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col")).agg(F.coalesce(F.avg(F.when(shown, F.col("value"))), F.lit(0.0)).alias("value"))


def genotype_map(calls: DataFrame, cells: DataFrame, probe: int) -> tuple[DataFrame, DataFrame]:
    """((row, col, genotype), (genotype, n)) of one probe over all bins of ``cells`` (cell_idx, row, col); bins without a call have null."""
    own = calls.filter(F.col("probe_idx") == probe).select("cell_idx", "genotype")
    placed = cells.join(own, "cell_idx", "left").select("row", "col", "genotype")
    return placed, placed.groupBy("genotype").agg(F.count(F.lit(1)).alias("n"))


def impute_by_resolution(entries: DataFrame, clusters: DataFrame, resolutions: tuple[int, ...] = (2, 8, 16), threshold: float = 0.5, **options) -> DataFrame:
    """(resolution, row, col, probe_idx, genotype, certainty): imputation on every grid, of the calls made on it.

    ``clusters`` is (resolution, row, col, cluster). Options go to ``impute_genotypes``.
    """
    out = None
    for r in resolutions:
        at = F.xxhash64("row", "col")
        binned = bin_entries(entries, (r,)).withColumn("cell_idx", at)
        own = clusters.filter(F.col("resolution") == r).select(at.alias("cell_idx"), "cluster", "row", "col")
        found = impute_genotypes(call_genotypes(binned, threshold), own.select("cell_idx", "cluster"), **options)[0]
        part = found.join(own.select("cell_idx", "row", "col"), "cell_idx").select(F.lit(r).alias("resolution"), "row", "col", "probe_idx", "genotype", "certainty")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no resolutions")
    return out


def check_spatial(cells: DataFrame) -> None:
    """An error unless cells have places on the grid."""
    if lost := [c for c in ("row", "col") if c not in cells.columns]:
        raise ValueError(f"not a spatial table: it lacks {lost}")


def check_genotypes(calls: DataFrame) -> None:
    """An error unless a table holds genotype calls."""
    if lost := [c for c in ("cell_idx", "probe_idx", "genotype") if c not in calls.columns]:
        raise ValueError(f"call genotypes first: {lost} are missing")


__all__ = ["bin_entries", "check_genotypes", "check_spatial", "downsample", "genotype_map", "impute_by_resolution", "join_with_wta", "marginals", "spatial_barcode"]
