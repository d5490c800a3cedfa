"""Genotype calls, allele annotation and statistics over them; calls are long: one row a (cell, probe)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-4
MOST_PROBES = 100_000


def call_genotypes(entries: DataFrame, threshold: float = 0.5, cells: DataFrame | None = None) -> DataFrame:
    """(cell_idx, probe_idx, genotype, n_umis, proportion).

    Gapfills in order of molecules (tie: the later one first) until their share reaches the threshold, joined by ``/``;
    if it is never reached, the first alone. With ``cells``, (cell, probe) pairs without molecules get null, 0, 0.0.
    A (cell, probe) has few gapfills, so they are gathered and folded rather than ranked in a window.
    """
    some = entries.filter("n_umis > 0").groupBy("cell_idx", "probe_idx").agg(
        F.sum("n_umis").alias("total"), F.sort_array(F.collect_list(F.struct(F.col("n_umis").alias("n"), "gapfill")), asc=False).alias("g")
    )
    state = F.struct(F.array().cast("array<string>").alias("names"), F.lit(0).cast("long").alias("n"))

    def add(s: Column, x: Column) -> Column:
        more = s["n"] < F.lit(threshold) * F.col("total")
        return F.struct(F.when(more, F.concat(s["names"], F.array(x["gapfill"]))).otherwise(s["names"]).alias("names"), F.when(more, s["n"] + x["n"]).otherwise(s["n"]).alias("n"))

    folded = some.withColumn("c", F.aggregate("g", state, add))
    reached = F.col("c.n") >= F.lit(threshold) * F.col("total")
    first = F.col("g")[0]
    calls = folded.select(
        "cell_idx", "probe_idx",
        F.when(reached, F.array_join("c.names", "/")).otherwise(first["gapfill"]).alias("genotype"),
        F.when(reached, F.col("c.n")).otherwise(first["n"]).alias("n_umis"),
        (F.when(reached, F.col("c.n")).otherwise(first["n"]) / F.col("total")).alias("proportion"),
    )
    if cells is None:
        return calls
    probes = entries.select("probe_idx").distinct()
    if probes.count() > MOST_PROBES:
        raise ValueError(f"a row for each cell and probe is made for {MOST_PROBES} probes at most")
    grid = cells.select("cell_idx").crossJoin(F.broadcast(probes))  # the result's own size
    return grid.join(calls, ["cell_idx", "probe_idx"], "left").withColumns({"n_umis": F.coalesce("n_umis", F.lit(0)), "proportion": F.coalesce("proportion", F.lit(0.0))})


def annotate_alleles(genotype: Column, reference: Column, expected: Column, unknown_as_alt: bool = True, call_het: bool = True) -> Column:
    """REF, ALT, HET (or the kinds joined by ``/``) or UNKNOWN of a call."""
    kinds = F.transform(
        F.split(genotype, "/"), lambda g: F.when(g == reference, "REF").when(g == expected, "ALT").otherwise(F.lit("ALT" if unknown_as_alt else "UNKNOWN"))
    )
    distinct = F.array_sort(F.array_distinct(kinds))
    mixed = F.lit("HET") if call_het else F.array_join(distinct, "/")
    known = F.when(F.array_contains(distinct, "UNKNOWN"), "UNKNOWN").when(F.size(distinct) > 1, mixed).otherwise(F.element_at(distinct, 1))
    return F.when(genotype.isNull(), "UNKNOWN").otherwise(known)


def mutational_burden(alleles: DataFrame, normalize: bool = True, cells: DataFrame | None = None) -> DataFrame:
    """(cell_idx, burden): mean of REF 0, HET 0.5, ALT 1 over a cell's known alleles, 0 without any; min-max scaled over all cells on request."""
    value = F.when(F.col("allele") == "REF", 0.0).when(F.col("allele").isin("HET", "ALT/REF"), 0.5).when(F.col("allele") == "ALT", 1.0)
    out = alleles.groupBy("cell_idx").agg(F.avg(value).alias("b"))
    if cells is not None:
        out = cells.select("cell_idx").join(out, "cell_idx", "left")
    out = out.select("cell_idx", F.coalesce("b", F.lit(0.0)).alias("burden"))
    if not normalize:
        return out
    ends = out.agg(F.min("burden").alias("lo"), F.max("burden").alias("hi")).first()  # one row
    if ends["lo"] is None or ends["lo"] == ends["hi"]:
        return out
    return out.withColumn("burden", (F.col("burden") - ends["lo"]) / (ends["hi"] - ends["lo"]))


def transfer_genotypes(wta_cells: DataFrame, calls: DataFrame) -> DataFrame:
    """Every cell of ``wta_cells`` with its calls; cells without have one row of nulls, and come last."""
    out = wta_cells.select("cell_idx").join(calls, "cell_idx", "left")
    return out.withColumn("has_genotype", F.col("probe_idx").isNotNull())


def value_counts(calls: DataFrame, by: list[str]) -> DataFrame:
    """(by, genotype, n, share): calls by group, and their share of the group's."""
    n = calls.filter("genotype is not null").groupBy(*by, "genotype").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def allele_presence(calls: DataFrame, wild: Column, alternative: Column) -> Column:
    """WT, ALT, HET or Other, by which alleles a call holds."""
    parts = F.split(F.col("genotype"), "/")
    has_w, has_a = F.array_contains(parts, wild), F.array_contains(parts, alternative)
    return F.when(has_w & has_a, "HET").when(has_w, "WT").when(has_a, "ALT").when(F.col("genotype").isNotNull(), "Other")


def pseudobulk(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, probe_idx, gapfill, n_umis): molecules by group of cells; ``groups`` is (cell_idx, grp)."""
    return entries.join(groups, "cell_idx").groupBy("grp", "probe_idx", "gapfill").agg(F.sum("n_umis").alias("n_umis"))


def accuracy_by_threshold(molecules: DataFrame, truth: DataFrame, most: int = 5) -> DataFrame:
    """(threshold, n_calls, accuracy): share of cells whose most frequent gapfill is the truth, by least reads a molecule."""
    layers = molecules.withColumn("threshold", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.col("pcr_duplicate_count").cast("int")))))
    counts = layers.groupBy("threshold", "cell_idx", "probe_idx", "gapfill").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("threshold", "cell_idx", "probe_idx").agg(F.max(F.struct("n", "gapfill")).alias("b"))
    right = best.join(truth, "probe_idx").withColumn("ok", (F.col("b.gapfill") == F.col("truth")).cast("int"))
    return right.groupBy("threshold").agg(F.count(F.lit(1)).alias("n_calls"), (F.sum("ok") / (F.count(F.lit(1)) + F.lit(EPS))).alias("accuracy"))


def relative_efficiency(entries: DataFrame, controls: DataFrame) -> DataFrame:
    """(probe_idx, n_probe, n_control, median_ratio) against each probe's control probe, cells without molecules as 0.

    ``controls`` is (probe_idx, control_idx). Cells count that have either.
    """
    sums = entries.groupBy("cell_idx", "probe_idx").agg(F.sum("n_umis").alias("n"))
    own = sums.join(controls, "probe_idx").select("cell_idx", "probe_idx", F.col("n").alias("p"))
    ctl = sums.withColumnRenamed("probe_idx", "control_idx").join(controls, "control_idx").select("cell_idx", "probe_idx", F.col("n").alias("c"))
    both = own.join(ctl, ["cell_idx", "probe_idx"], "full").select("probe_idx", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("c", F.lit(0)).alias("c"))
    return both.groupBy("probe_idx").agg(F.sum("p").alias("n_probe"), F.sum("c").alias("n_control"), F.median((F.col("p") + 1) / (F.col("c") + 1)).alias("median_ratio"))


def allele_balance(entries: DataFrame, truth: DataFrame, groups: DataFrame, least: int = 0) -> DataFrame:
    """(grp, probe_idx, wt, alt): molecules of the two alleles by group; ``truth`` is (probe_idx, wt_gapfill, alt_gapfill)."""
    x = entries.join(groups, "cell_idx").join(truth, "probe_idx")
    out = x.groupBy("grp", "probe_idx").agg(
        F.sum(F.when(F.col("gapfill") == F.col("wt_gapfill"), F.col("n_umis")).otherwise(0)).alias("wt"), F.sum(F.when(F.col("gapfill") == F.col("alt_gapfill"), F.col("n_umis")).otherwise(0)).alias("alt")
    )
    return out.filter(F.greatest("wt", "alt") > least)


def specific_probes(truth: DataFrame) -> DataFrame:
    """(probe_idx, grp, genotype): genotypes that one group alone has. ``truth`` is (grp, probe_idx, genotype)."""
    owners = truth.groupBy("probe_idx", "genotype").agg(F.countDistinct("grp").alias("k"), F.min("grp").alias("grp"))
    return owners.filter("k = 1").select("probe_idx", "grp", "genotype")


def distinct_allele_probes(calls: DataFrame, pattern: list[str] | None = None, top: int | None = None) -> DataFrame:
    """(probe_idx, genotypes, n): probes with two or more genotypes, by number of calls."""
    out = calls.filter("genotype is not null").groupBy("probe_idx").agg(F.array_sort(F.collect_set("genotype")).alias("g"), F.count(F.lit(1)).alias("n")).filter(F.size("g") >= 2)
    if pattern:
        out = out.filter(F.forall(F.array(*[F.lit(p) for p in pattern]), lambda p: F.array_contains("g", p)))
    out = out.select("probe_idx", F.array_join("g", "|").alias("genotypes"), "n")
    return out.orderBy(F.desc("n"), "probe_idx").limit(top) if top else out


def alt_fraction(entries: DataFrame, truth: DataFrame) -> DataFrame:
    """(cell_idx, probe_idx, alt_fraction): share of the alternative among both alleles' molecules, null without any."""
    x = entries.join(truth, "probe_idx").groupBy("cell_idx", "probe_idx").agg(
        F.sum(F.when(F.col("gapfill") == F.col("alt_gapfill"), F.col("n_umis")).otherwise(0)).alias("a"), F.sum(F.when(F.col("gapfill") == F.col("wt_gapfill"), F.col("n_umis")).otherwise(0)).alias("w")
    )
    return x.select("cell_idx", "probe_idx", F.try_divide(F.col("a"), F.col("a") + F.col("w")).alias("alt_fraction"))


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """(value, share at or below): over distinct values, so the running sum is short."""
    n = df.groupBy(value).agg(F.count(F.lit(1)).alias("k"))
    total = F.sum("k").over(Window.partitionBy())
    return n.select(value, (F.sum("k").over(Window.orderBy(value)) / total).alias("share"))


def genotype_frequencies(calls: DataFrame, entries: DataFrame, mode: str = "cells") -> DataFrame:
    """(probe_idx, gapfill, value): by ``cells`` (composites count for each allele), ``umis`` (split equally), ``raw`` (molecules), or ``relative`` (molecules' share of their cell)."""
    if mode in ("cells", "umis"):
        parts = calls.filter("genotype is not null").withColumn("p", F.split("genotype", "/"))
        weight = F.lit(1.0) if mode == "cells" else F.col("n_umis") / F.size("p")
        return parts.withColumn("w", weight).withColumn("gapfill", F.explode("p")).groupBy("probe_idx", "gapfill").agg(F.sum("w").alias("value"))
    if mode == "raw":
        return entries.groupBy("probe_idx", "gapfill").agg(F.sum("n_umis").cast("double").alias("value"))
    if mode == "relative":
        share = F.col("n_umis") / F.sum("n_umis").over(Window.partitionBy("cell_idx", "probe_idx"))
        return entries.withColumn("s", share).groupBy("probe_idx", "gapfill").agg(F.sum("s").alias("value"))
    raise ValueError(f"unknown mode {mode!r}")


def logo_matrix(frequencies: DataFrame) -> DataFrame:
    """(probe_idx, position, base, share) of right-padded gapfills weighted by value, for sequence logos."""
    padded = frequencies.withColumn("w", F.max(F.length("gapfill")).over(Window.partitionBy("probe_idx")))
    letters = padded.select("probe_idx", "value", F.posexplode(F.filter(F.split(F.rpad("gapfill", F.col("w"), F.lit("-")), ""), lambda c: c != "")).alias("position", "base"))
    sums = letters.groupBy("probe_idx", "position", "base").agg(F.sum("value").alias("v"))
    return sums.select("probe_idx", "position", "base", (F.col("v") / F.sum("v").over(Window.partitionBy("probe_idx", "position"))).alias("share"))
