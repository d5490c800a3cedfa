"""Correlations, fits, flows and bulk statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """``df`` with 1-based ranks, ties averaged. Ranks are made over distinct values, whose counts are summed in order."""
    n = df.groupBy(value).agg(F.count(F.lit(1)).alias("k"))
    upto = F.sum("k").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranks = n.select(value, (upto - (F.col("k") - 1) / 2).alias(out))
    return df.join(ranks, value)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: rank correlation of two columns, and the number of rows."""
    ranked = average_ranks(average_ranks(df.select(x, y), x, "rx"), y, "ry")
    return ranked.agg(F.corr("rx", "ry").alias("spearman"), F.count(F.lit(1)).alias("n"))


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"))


def density(df: DataFrame, x: str, y: str, bins: int = 64) -> DataFrame:
    """(x, y, n, density): a Gaussian kernel density over a grid of ``bins`` x ``bins`` cells that hold rows, at their centres.

    Rows are counted by cell first, so what meets in one task is bins squared at most; the bandwidth is Silverman's.
    """
    ends = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"), F.stddev_samp(x).alias("sx"), F.stddev_samp(y).alias("sy"), F.count(F.lit(1)).alias("n")).first()  # one row
    if not ends["n"]:
        return df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("density"))
    wx, wy = ((ends[f"{c}1"] - ends[f"{c}0"]) / bins or 1.0 for c in "xy")
    cell = lambda c, low, w: F.least(F.lit(bins - 1), F.floor((F.col(c) - low) / w))
    counts = df.groupBy(cell(x, ends["x0"], wx).alias("i"), cell(y, ends["y0"], wy).alias("j")).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.select((ends["x0"] + (F.col("i") + 0.5) * wx).alias("x"), (ends["y0"] + (F.col("j") + 0.5) * wy).alias("y"), "n")
    wide = ends["n"] ** (-1 / 6)
    hx, hy, total = (ends["sx"] or 0.0) * wide or wx, (ends["sy"] or 0.0) * wide or wy, ends["n"]

    def run(cells):
        a, b, n = (cells[c].to_numpy(float) for c in ("x", "y", "n"))
        kernel = np.exp(-0.5 * (((a[:, None] - a) / hx) ** 2 + ((b[:, None] - b) / hy) ** 2))
        return cells.assign(density=kernel @ n / (2 * np.pi * hx * hy * total))

    return rows.groupBy().applyInPandas(run, "x double, y double, n long, density double")


# The flows of a run's read accounting.
FLOWS = (
    ("TOTAL_READS", "MAPPED", "PROBE_CONTAINING_READS"), ("TOTAL_READS", "NO_LHS", "FILTERED_NO_LHS"), ("TOTAL_READS", "NO_RHS", "FILTERED_NO_RHS"), ("TOTAL_READS", "NO_CONSTANT", "FILTERED_NO_CONSTANT"),
    ("TOTAL_READS", "NO_PROBE_BARCODE", "FILTERED_NO_PROBE_BARCODE"), ("TOTAL_READS", "NO_CELL_BARCODE", "FILTERED_NO_CELL_BARCODE"), ("MAPPED", "EXACT", "EXACT"),
)


def flow_edges(metrics: DataFrame) -> DataFrame:
    """(src, dst, value): the read flow of (metric, value); what is missing is 0."""
    flows = F.explode(F.array(*[F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst"), F.lit(m).alias("metric")) for a, b, m in FLOWS]))
    edges = metrics.sparkSession.range(1).select(flows.alias("f")).select("f.*")
    return edges.join(metrics, "metric", "left").select("src", "dst", F.coalesce("value", F.lit(0)).cast("long").alias("value"))


def dense_summary(entries: DataFrame, n_cells: int) -> DataFrame:
    """One row over the dense cell x probe matrix: probes, mean, and median with implicit zeros."""
    sums = entries.groupBy("cell_idx", "probe_idx").agg(F.sum("n_umis").alias("v"))
    n_probes = F.countDistinct("probe_idx")
    a = sums.agg(n_probes.alias("probes"), F.sum("v").alias("total"), F.count(F.lit(1)).alias("filled"))
    size = F.col("probes") * n_cells
    by_value = sums.groupBy("v").agg(F.count(F.lit(1)).alias("k"))
    zeros = a.select(F.lit(0).cast("long").alias("v"), (size - F.col("filled")).alias("k"))
    steps = by_value.union(zeros).groupBy("v").agg(F.sum("k").alias("k"))
    total = F.sum("k").over(Window.partitionBy())
    upto = F.sum("k").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    marked = steps.withColumns({"upto": upto, "total": total})
    low, high = F.min(F.when(F.col("upto") >= F.floor((F.col("total") + 1) / 2), F.col("v"))), F.min(F.when(F.col("upto") >= F.floor(F.col("total") / 2) + 1, F.col("v")))
    median = marked.agg(((low + high) / 2).alias("median"), F.max("total").alias("dense"))
    return a.withColumn("one", F.lit(1)).join(median.withColumn("one", F.lit(1)), "one").select("probes", (F.col("total") / F.col("dense")).alias("mean"), "median")
