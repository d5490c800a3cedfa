"""Small text formats: panels, whitelists, coordinates, sparse matrices, SAM tags, ground truth, unmapped reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strip_suffix
from ..operators.manifest import normalize_panel


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """A panel by suffix: ``.csv`` by commas, else by tabs; an empty gap sequence stays empty, a missing one is null."""
    sep = "," if path.lower().rstrip(".gz").endswith(".csv") else "\t"
    return normalize_panel(spark.read.csv(path, sep=sep, header=True, comment="#", nullValue="NA", emptyValue=""))


def read_whitelist(spark: SparkSession, *paths: str) -> DataFrame:
    """(entry): distinct first columns of one or more lists, without ``-N``."""
    return spark.read.text(list(paths)).select(strip_suffix(F.split("value", r"[\t,]")[0]).alias("entry")).filter("entry <> ''").distinct()


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="barcode string, x int, y int")


def read_mtx(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, value), from 0, of a Matrix Market file; the line of sizes is the one that follows the comments."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("%")).select(F.split("value", r"\s+").alias("p"), F.monotonically_increasing_id().alias("i"))
    first = lines.agg(F.min("i")).first()[0]
    return lines.filter(F.col("i") != F.lit(first)).select((F.col("p")[0].cast("long") - 1).alias("row"), (F.col("p")[1].cast("long") - 1).alias("col"), F.col("p")[2].cast("double").alias("value"))


def read_sam_tags(spark: SparkSession, path: str, tags: tuple[str, ...] = ("CB", "CR", "1R")) -> DataFrame:
    """Distinct tag values of SAM lines that have them all."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("@"))
    tag = lambda t: F.nullif(F.regexp_extract("value", rf"\t{t}:Z:([^\t]*)", 1), F.lit(""))
    return lines.select(*[tag(t).alias(t) for t in tags]).dropna().distinct()


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(cell_type, name, alleles) of a ground-truth table whose allele columns are named 0 and 1."""
    return spark.read.csv(path, header=True).select("cell_type", "name", F.array_compact(F.array("`0`", "`1`")).alias("alleles"))


def write_unmapped(mapped: DataFrame, reads: DataFrame, path: str) -> None:
    """Both mates of reads without a probe as FASTQ records, in folders R1 and R2, titled with the states that explain them."""
    lost = mapped.filter("probe_idx is null").select("read_id", F.array_join("states", ",").alias("why")).join(reads, "read_id")
    for k in (1, 2):
        lost.select(F.concat(F.lit("@"), f"title{k}", F.lit(" "), "why", F.lit("\n"), f"r{k}", F.lit("\n+\n"), f"q{k}").alias("value")).write.mode("overwrite").option("compression", "gzip").text(f"{path}/R{k}")
