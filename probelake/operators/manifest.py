"""Probe panels: reading rules, decoy combinations, trimming, and conversion from and to vendor probe sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Other names under which panels give these columns.
ALIASES = {"expected_gapfill": "gap_probe_sequence", "reference_gapfill": "original_gap_probe_sequence", "symbol": "gene", "gene_name": "gene", "gene_symbol": "gene"}
MOST_ARMS = 50_000
PANEL = ("name", "lhs_probe", "rhs_probe", "gap_probe_sequence", "original_gap_probe_sequence", "gene")


def normalize_panel(raw: DataFrame) -> DataFrame:
    """Columns lower-cased, aliases resolved, rows distinct but for the name, repeated names suffixed ``_i``."""
    out = raw.toDF(*[c.lower() for c in raw.columns])
    for alias, name in ALIASES.items():
        if alias in out.columns and name not in out.columns:
            out = out.withColumnRenamed(alias, name)
    missing = [c for c in PANEL[:3] if c not in out.columns]
    if missing:
        raise ValueError(f"panel lacks {missing}")
    out = out.select(*[c for c in PANEL if c in out.columns])
    rest = [c for c in out.columns if c != "name"]
    out = out.groupBy(*rest).agg(F.min("name").alias("name"))
    w = Window.partitionBy("name")
    i = F.row_number().over(w.orderBy(*[F.col(c) for c in rest])) - 1
    n = F.count(F.lit(1)).over(w)
    return out.withColumn("name", F.when(n > 1, F.concat_ws("_", "name", i.cast("string"))).otherwise(F.col("name"))).select("name", *rest)


def with_decoys(panel: DataFrame) -> DataFrame:
    """The panel, ``was_defined``, and every other pairing of its left and right arms, named ``left/right``.

    The result is a cross of a panel's two columns of arms, asked for explicitly; a panel of more than ``MOST_ARMS`` arms
    is refused, as its square would not be a dimension any more.
    """
    left = panel.groupBy("lhs_probe").agg(F.min("name").alias("left_name"))
    right = panel.groupBy("rhs_probe").agg(F.min("name").alias("right_name"))
    if (n := left.count()) > MOST_ARMS:
        raise ValueError(f"{n} left arms: all combinations are made of {MOST_ARMS} at most")
    pairs = left.crossJoin(F.broadcast(right)).join(panel, ["lhs_probe", "rhs_probe"], "left_anti")
    decoys = pairs.select(F.concat_ws("/", "left_name", "right_name").alias("name"), "lhs_probe", "rhs_probe", F.lit(False).alias("was_defined"))
    return panel.withColumn("was_defined", F.lit(True)).unionByName(decoys, allowMissingColumns=True)


def trimmed(panel: DataFrame, length: int) -> DataFrame:
    """Right arms cut so that both arms and the longer expected gap fit ``length``; kept whole where that can't be."""
    gap = F.greatest(F.length(F.coalesce("gap_probe_sequence", F.lit(""))), F.length(F.coalesce("original_gap_probe_sequence", F.lit(""))))
    room = F.lit(length) - gap - F.length("lhs_probe")
    return panel.withColumn("rhs_probe", F.when(room >= 0, F.col("rhs_probe").substr(F.lit(1), room)).otherwise(F.col("rhs_probe")))


def build_manifest(panel: DataFrame, decoys: bool = False, trim: int = -1) -> DataFrame:
    """The panel with decoys and trimming on request, and ``index`` (defined probes first, by name)."""
    out = with_decoys(panel) if decoys else panel.withColumn("was_defined", F.lit(True))
    out = trimmed(out, trim) if trim > 0 else out
    return out.withColumn("index", (F.row_number().over(Window.orderBy(F.desc("was_defined"), "name")) - 1).cast("long"))


def convert_probes(vendor: DataFrame) -> DataFrame:
    """A vendor probe set (probe_seq of 50, probe_id ``ens|gene|hash``) as a panel of two arms of 25."""
    return vendor.select(
        F.col("probe_id").alias("name"), F.substring("probe_seq", 1, 25).alias("lhs_probe"), F.substring("probe_seq", 26, 25).alias("rhs_probe"), F.split_part("probe_id", F.lit("|"), F.lit(2)).alias("gene")
    )


def revert_probes(panel: DataFrame) -> DataFrame:
    """A panel as a vendor probe set: a REF row and, where the expected gap differs, an ALT row for each probe."""
    variants = F.array(
        F.struct(F.lit("REF").alias("kind"), F.coalesce("original_gap_probe_sequence", F.lit("")).alias("gap")),
        F.struct(F.lit("ALT").alias("kind"), F.coalesce("gap_probe_sequence", F.lit("")).alias("gap")),
    )
    out = panel.select("name", "gene", "lhs_probe", "rhs_probe", F.explode(F.array_distinct(variants)).alias("v"))
    out = out.withColumn("n", F.row_number().over(Window.partitionBy("name", "v.gap").orderBy(F.desc("v.kind")))).filter("n = 1")
    return out.select(F.concat_ws("|", "gene", "name", "v.kind").alias("probe_id"), F.substring(F.concat("lhs_probe", "v.gap", "rhs_probe"), 1, 50).alias("probe_seq"), F.lit(True).alias("included"))
