"""Whole-transcriptome outputs in 10x folder layouts, Visium HD slide designs, run tables by sample, metrics read back."""

from __future__ import annotations

import json
import re
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strip_suffix

# Where the matrix folder lies below the folders that a user may name.
BINNED = "square_002um/filtered_feature_bc_matrix"
LAYOUTS = ("", "filtered_feature_bc_matrix", BINNED, f"binned_outputs/{BINNED}", f"outs/binned_outputs/{BINNED}", "outs/filtered_feature_bc_matrix")


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def _listed(spark: SparkSession, folder: str) -> list[str]:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return sorted(x.getPath().getName() for x in jpath.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(jpath))


def matrix_folder(spark: SparkSession, path: str) -> str:
    """The folder with the barcodes' table, wherever it lies below ``path``."""
    for layout in LAYOUTS:
        at = f"{path.rstrip('/')}/{layout}".rstrip("/")
        if any(_exists(spark, f"{at}/barcodes.tsv{end}") for end in (".gz", "")):
            return at
    raise FileNotFoundError(f"no barcodes.tsv below {path}")


def _named(spark: SparkSession, folder: str, *names: str) -> str:
    for name in names:
        for end in (".gz", ""):
            if _exists(spark, f"{folder}/{name}{end}"):
                return f"{folder}/{name}{end}"
    raise FileNotFoundError(f"none of {names} in {folder}")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(at, value): a small text table's lines, numbered from 0; such files are one partition each."""
    rows = spark.read.text(path, wholetext=True)
    lines = rows.select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("at", "value"))
    return lines.select(F.col("at").cast("long").alias("at"), "value")


def read_wta_barcodes(spark: SparkSession, path: str) -> DataFrame:
    """(barcode) of a 10x output: a folder of any known layout, or a table whose first column holds them; ``-N`` is cut."""
    if path.endswith(".h5"):
        raise ValueError("HDF5 outputs can't be read here; name the folder of the matrix instead")
    file = path if re.search(r"\.(tsv|txt|csv)(\.gz)?$", path) else _named(spark, matrix_folder(spark, path), "barcodes.tsv")
    return spark.read.text(file).select(strip_suffix(F.split("value", r"[\t,]")[0]).alias("barcode")).filter("barcode <> ''")


def read_wta(spark: SparkSession, path: str) -> DataFrame:
    """(barcode, gene_id, gene, n) of a 10x matrix folder: its entries with the names of their rows and columns."""
    from .text import read_mtx

    folder = matrix_folder(spark, path)
    barcodes = _lines(spark, _named(spark, folder, "barcodes.tsv")).select(F.col("at").alias("col"), strip_suffix(F.split("value", "\t")[0]).alias("barcode"))
    parts = F.split("value", "\t")
    features = _lines(spark, _named(spark, folder, "features.tsv", "genes.tsv")).select(F.col("at").alias("row"), parts[0].alias("gene_id"), F.coalesce(F.get(parts, 1), parts[0]).alias("gene"))
    entries = read_mtx(spark, _named(spark, folder, "matrix.mtx"))
    return entries.join(features, "row").join(barcodes, "col").select("barcode", "gene_id", "gene", F.col("value").alias("n"))


def possible_barcodes(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """(entry): distinct barcodes of several outputs; what can't be read is skipped with a warning, and None is left if nothing can."""
    out = None
    for path in paths:
        try:
            found = read_wta_barcodes(spark, path)
        except (FileNotFoundError, ValueError) as e:
            warnings.warn(f"{path} is skipped: {e}", stacklevel=2)
            continue
        out = found if out is None else out.unionByName(found)
    return None if out is None else out.select(F.col("barcode").alias("entry")).distinct()


def read_slide(spark: SparkSession, first: str, second: str) -> DataFrame:
    """(first, x, second, y): the two halves' barcodes, one a line, and their places on the slide's axes.

    The halves stay apart, as the slide's barcodes are their product: a row has a first or a second half.
    """
    a = _lines(spark, first).select(F.col("value").alias("first"), F.col("at").cast("int").alias("x"))
    b = _lines(spark, second).select(F.col("value").alias("second"), F.col("at").cast("int").alias("y"))
    return a.unionByName(b, allowMissingColumns=True)


def read_chemistry(spark: SparkSession, path: str, name: str = "SPATIAL-HD-v1") -> dict[str, int]:
    """Offsets and lengths of two-part barcodes from a JSON file of chemistry definitions."""
    text = spark.read.text(path, wholetext=True).first()[0]
    found = json.loads(text)[name]
    one, two = found["barcode"][:2]
    params = found["barcode_extraction"]["params"]
    return {"first_offset": one["offset"], "first_length": one["length"], "second_offset": two["offset"], "second_length": two["length"], "min_offset": params["min_offset"], "max_offset": params["max_offset"]}


def slide_positions(cells: DataFrame, slide: DataFrame, first_length: int = 14) -> DataFrame:
    """``cells`` (barcode of two halves) with x and y; halves of other lengths are found by the longest first half that fits."""
    a, b = slide.filter("first is not null").select("first", "x"), slide.filter("second is not null").select("second", "y")
    cut = F.explode(F.sequence(F.lit(first_length + 1), F.lit(first_length - 1), F.lit(-1)))
    tried = cells.withColumn("sp_cut", cut).withColumns({"first": F.expr("left(barcode, sp_cut)"), "second": F.expr("substr(barcode, sp_cut + 1)")})
    placed = tried.join(a, "first").join(b, "second").groupBy("barcode").agg(F.max(F.struct("sp_cut", "x", "y")).alias("p"))
    return cells.join(placed.select("barcode", F.col("p.x").alias("x"), F.col("p.y").alias("y")), "barcode", "left")


def read_metrics(spark: SparkSession, path: str) -> dict[str, float]:
    """A run's metrics or summary, by name."""
    df = spark.read.csv(path, sep="\t", header=True) if path.endswith((".tsv", ".tsv.gz")) else spark.read.parquet(path)
    name, value = df.columns[:2]
    return {r[0]: float(r[1]) for r in df.select(name, F.col(value).cast("double")).collect()}  # a few rows


def discover_plexes(spark: SparkSession, entries: str) -> list[str]:
    """The samples of a run's entries by their folders: by number where all are numbers, else by name."""
    found = [n.split("=", 1)[1] for n in _listed(spark, entries) if n.startswith("probe_barcode=")]
    return sorted(found, key=int) if all(x.isdigit() for x in found) else sorted(found)


def read_well_list(spark: SparkSession, path: str) -> DataFrame:
    """(entry, corrected, well) of a list of sample barcodes in up to three columns; a missing second is the first itself."""
    c = F.split("value", r"\s+|,")
    rows = spark.read.text(path).filter("trim(value) <> '' and value not like '#%'")
    return rows.select(c[0].alias("entry"), F.coalesce(F.get(c, 1), c[0]).alias("corrected"), F.get(c, 2).alias("well"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A manifest, barcode or read-record table: Parquet, or tab-separated text with a header, plain or gzip by suffix."""
    return spark.read.csv(path, sep="\t", header=True, inferSchema=True, emptyValue="") if re.search(r"\.(tsv|txt)(\.gz)?$", path) else spark.read.parquet(path)
