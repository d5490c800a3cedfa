"""The Parquet star schema of a run: entries, cells, features, probes, molecules, attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bin_coordinates

TABLES = ("entries", "cells", "features", "probes", "molecules", "attributes")


def write_star(tables: dict[str, DataFrame], path: str, overwrite: bool = False) -> None:
    """Each table in a folder of its own; entries and molecules by sample, so one sample's scan reads only its files."""
    unknown = set(tables) - set(TABLES)
    if unknown:
        raise ValueError(f"unknown tables {sorted(unknown)}")
    for name, df in tables.items():
        out = df.write.mode("overwrite" if overwrite else "errorifexists")
        if name in ("entries", "molecules") and "probe_barcode" in df.columns:
            out = out.partitionBy("probe_barcode")
        out.parquet(f"{path}/{name}")


def read_star(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that are there; probe names must be unique."""
    out = {}
    for name in TABLES:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
            out[name] = spark.read.parquet(f"{path}/{name}")
    if "probes" in out and out["probes"].groupBy("name").count().filter("count > 1").limit(1).count():
        raise ValueError("probe names are not unique")
    return out


def read_counts(spark: SparkSession, path: str, plex: str | None = None) -> dict[str, DataFrame]:
    """A run's tables ready for analysis, of one sample on request: features with their probe's manifest row, cells with places.

    Cells of a spatial run whose places are missing or not whole get them from their names.
    """
    out = read_star(spark, path)
    if plex is not None:
        out = {k: v.filter(F.col("probe_barcode") == plex) if "probe_barcode" in v.columns else v for k, v in out.items()}
    if "features" in out and "probes" in out:
        out["features"] = out["features"].join(out["probes"].withColumnRenamed("index", "probe_idx"), "probe_idx", "left")
    if "cells" in out and {"array_row", "array_col"} & set(out["cells"].columns):
        at = bin_coordinates(F.col("barcode"))
        whole = lambda c: F.when(F.col(c).cast("double") == F.floor(F.col(c).cast("double")), F.col(c).cast("int"))
        out["cells"] = out["cells"].withColumns({"array_row": F.coalesce(whole("array_row"), at["row"]), "array_col": F.coalesce(whole("array_col"), at["col"])})
    return out
