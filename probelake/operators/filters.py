"""Filters over entries, genotypes and cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filter_gapfills(entries: DataFrame, min_cells: int = 10, min_umis: int = 0, min_reads: int = 0, min_percent: float = 0.0) -> DataFrame:
    """Entries that reach reads, support and molecules, of features left with at least ``min_cells`` cells."""
    kept = entries.filter((F.col("total_reads") >= min_reads) & (F.col("percent_supporting") >= min_percent) & (F.col("n_umis") >= max(1, min_umis)))
    cells = kept.groupBy("probe_idx", "gapfill").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_cells)
    return kept.join(cells, ["probe_idx", "gapfill"], "left_semi")


def filter_genotypes(genotypes: DataFrame, min_umis: int = 1, min_cells: int = 10, min_proportion: float = 0.0, top_n: int | None = None) -> DataFrame:
    """``genotypes`` with calls set to null that are weak, not among the probe's ``top_n`` (tie: genotype), or too rare."""
    strong = F.when((F.col("n_umis") >= min_umis) & (F.col("proportion") >= min_proportion), F.col("genotype"))
    calls = genotypes.withColumn("genotype", strong)
    counts = calls.filter("genotype is not null").groupBy("probe_idx", "genotype").agg(F.count(F.lit(1)).alias("n"))
    if top_n is not None:
        counts = counts.withColumn("r", F.row_number().over(Window.partitionBy("probe_idx").orderBy(F.desc("n"), "genotype"))).filter(F.col("r") <= top_n)
    good = counts.filter(F.col("n") >= min_cells).select(F.col("probe_idx").alias("of"), F.col("genotype").alias("good"))
    joined = calls.join(good, (F.col("probe_idx") == F.col("of")) & (F.col("genotype") == F.col("good")), "left")
    return joined.withColumn("genotype", F.col("good")).drop("good", "of")


def filter_barcodes(entries: DataFrame, cells: DataFrame, listed: DataFrame, pad: bool = True) -> tuple[DataFrame, DataFrame]:
    """(entries, cells) of the listed barcodes, numbered in list order; unseen ones are cells without entries if ``pad``.

    ``listed`` is (barcode, position); ``cells`` is (cell_idx, barcode).
    """
    new = listed.join(cells.select("barcode", F.col("cell_idx").alias("old")), "barcode", "left" if pad else "inner")
    new = new.withColumnRenamed("position", "cell_idx")
    moved = entries.withColumnRenamed("cell_idx", "old").join(new.filter("old is not null").select("old", "cell_idx"), "old").drop("old")
    return moved, new.select("cell_idx", "barcode", F.col("old").isNull().alias("padded"))


def in_box(row: Column, col: Column, top: int, left: int, bottom: int, right: int) -> Column:
    return row.between(top, bottom) & col.between(left, right)


def in_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Whether a point lies inside a polygon: an odd number of edges cross the ray to its right."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1]):
        if y1 == y2:
            continue
        meets = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
        crossings = crossings + meets.cast("int")
    return crossings % 2 == 1


def intersect_cells(a: DataFrame, b: DataFrame, key: str = "cell_idx") -> tuple[DataFrame, DataFrame]:
    """Each table's rows of cells that both have."""
    return a.join(b.select(key).distinct(), key, "left_semi"), b.join(a.select(key).distinct(), key, "left_semi")


def expressed_cells(wta: DataFrame, min_counts: int = 100, min_cells: int = 10, max_mito: float = 0.3, mito: str = "gene like 'MT-%'") -> DataFrame:
    """``wta`` (cell_idx, gene, n) without poor cells (few counts, much mitochondrial) and rare genes."""
    cells = wta.groupBy("cell_idx").agg(F.sum("n").alias("t"), F.sum(F.when(F.expr(mito), F.col("n")).otherwise(0)).alias("m"))
    cells = cells.filter((F.col("t") >= min_counts) & (F.col("m") < max_mito * F.col("t")))
    kept = wta.join(cells, "cell_idx", "left_semi")
    return kept.join(kept.groupBy("gene").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= min_cells), "gene", "left_semi")
