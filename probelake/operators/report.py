"""The data behind reports and figures: aggregates over entries, calls and groups of cells. Rendering is not done here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import gene_of
from .counts import collapse_gapfills, saturation, saturation_curve
from .genotypes import logo_matrix

CONTROL = "0bp"  # what marks the name of a control probe


# Groups of cells


def expression_by_group(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, probe_idx, gapfill, mean, fraction): mean molecules over all of a group's cells, and the share that has any.

    ``groups`` is (cell_idx, grp). Cells without entries count as zeros.
    """
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("cells"))
    sums = entries.filter("n_umis > 0").join(groups, "cell_idx").groupBy("grp", "probe_idx", "gapfill").agg(F.sum("n_umis").alias("n"), F.countDistinct("cell_idx").alias("c"))
    return sums.join(sizes, "grp").select("grp", "probe_idx", "gapfill", (F.col("n") / F.col("cells")).alias("mean"), (F.col("c") / F.col("cells")).alias("fraction"))


def pseudobulk_alleles(entries: DataFrame, groups: DataFrame, truth: DataFrame, expected: DataFrame) -> DataFrame:
    """(grp, probe_idx, wt, alt, other, expected_genotype): molecules by allele; cells without a group don't count.

    ``truth`` is (probe_idx, wt_gapfill, alt_gapfill), ``expected`` (grp, expected_genotype).
    """
    x = entries.join(groups.filter("grp is not null"), "cell_idx").join(truth, "probe_idx")
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("n_umis"))), F.lit(0))
    wt, alt = F.col("gapfill") == F.col("wt_gapfill"), F.col("gapfill") == F.col("alt_gapfill")
    out = x.groupBy("grp", "probe_idx").agg(of(wt).alias("wt"), of(alt).alias("alt"), of(~wt & ~alt).alias("other"))
    return out.join(expected, "grp", "left")


def single_calls(entries: DataFrame, truth: DataFrame) -> DataFrame:
    """(cell_idx, probe_idx, call): HET where a cell has several gapfills of a probe, else WT, ALT or Other."""
    some = entries.filter("n_umis > 0").groupBy("cell_idx", "probe_idx").agg(F.countDistinct("gapfill").alias("k"), F.min("gapfill").alias("g"))
    call = F.when(F.col("k") > 1, "HET").when(F.col("g") == F.col("wt_gapfill"), "WT").when(F.col("g") == F.col("alt_gapfill"), "ALT").otherwise("Other")
    return some.join(truth, "probe_idx").select("cell_idx", "probe_idx", call.alias("call"))


def accuracy_by_method(methods: dict[str, DataFrame], truth: DataFrame, groups: DataFrame, expected: DataFrame) -> DataFrame:
    """(method, probe_idx, true_call, n_cells, correct): share of cells whose call is their group's genotype, WT or ALT.

    ``methods`` are entries by name, such as those of two kinds of probes; heterozygous groups don't count.
    """
    parts = [single_calls(e, truth).withColumn("method", F.lit(m)) for m, e in methods.items()]
    calls = parts[0]
    for p in parts[1:]:
        calls = calls.unionByName(p)
    known = expected.filter(F.col("expected_genotype").isin("WT", "ALT")).withColumnRenamed("expected_genotype", "true_call")
    x = calls.join(groups, "cell_idx").join(known, "grp")
    return x.groupBy("method", "probe_idx", "true_call").agg(F.count(F.lit(1)).alias("n_cells"), F.avg((F.col("call") == F.col("true_call")).cast("int")).alias("correct"))


def support_by_cell(entries: DataFrame, alleles: DataFrame, groups: DataFrame, least: float = 0, controls: DataFrame | None = None) -> DataFrame:
    """(cell_idx, grp, support1, support2): molecules that speak for either of two groups' genotypes, over discordant probes.

    ``alleles`` is (probe_idx, allele1, allele2); ``controls`` (probe_idx, control_idx): a cell's molecules of a probe are
    divided by its control's plus one, where it has any. Cells stay with more than ``least`` on either side.
    """
    x = entries.join(alleles, "probe_idx").groupBy("cell_idx", "probe_idx").agg(
        F.sum(F.when(F.col("gapfill") == F.col("allele1"), F.col("n_umis")).otherwise(0)).cast("double").alias("a"),
        F.sum(F.when(F.col("gapfill") == F.col("allele2"), F.col("n_umis")).otherwise(0)).cast("double").alias("b"),
    )
    if controls is not None:
        own = entries.groupBy("cell_idx", F.col("probe_idx").alias("control_idx")).agg(F.sum("n_umis").alias("ctl"))
        x = x.join(controls, "probe_idx", "left").join(own, ["cell_idx", "control_idx"], "left")
        by = F.when(F.col("ctl") > 0, F.col("ctl") + 1).otherwise(1)
        x = x.select("cell_idx", "probe_idx", (F.col("a") / by).alias("a"), (F.col("b") / by).alias("b"))
    out = x.groupBy("cell_idx").agg(F.sum("a").alias("support1"), F.sum("b").alias("support2"))
    return out.filter((F.col("support1") > least) | (F.col("support2") > least)).join(groups, "cell_idx").select("cell_idx", "grp", "support1", "support2")


def discordant_alleles(genotypes: DataFrame, truth: DataFrame, one: str, two: str) -> DataFrame:
    """(probe_idx, allele1, allele2) of probes for which two groups are WT and ALT, or ALT and WT; ``genotypes`` is (grp, probe_idx, kind)."""
    of = lambda g, c: genotypes.filter(F.col("grp") == g).filter(F.col("kind").isin("WT", "ALT")).select("probe_idx", F.col("kind").alias(c))
    both = of(one, "k1").join(of(two, "k2"), "probe_idx").filter("k1 <> k2").join(truth, "probe_idx")
    allele = lambda k: F.when(F.col(k) == "WT", F.col("wt_gapfill")).otherwise(F.col("alt_gapfill"))
    return both.select("probe_idx", allele("k1").alias("allele1"), allele("k2").alias("allele2"))


def line_specific_probes(genotypes: DataFrame, target: object, include_het: bool = False) -> DataFrame:
    """(probe_idx, kind, het_groups, same_groups): probes by which ``target`` differs from some other group.

    ``genotypes`` is (grp, probe_idx, kind) of WT, ALT, HET or Unknown. The target's own must be WT or ALT. A
    heterozygous other group rules a probe out, or with ``include_het`` counts as another genotype.
    """
    own = genotypes.filter((F.col("grp") == F.lit(target)) & F.col("kind").isin("WT", "ALT")).select("probe_idx", "kind")
    other = genotypes.filter(F.col("grp") != F.lit(target)).select("probe_idx", "grp", F.col("kind").alias("other"))
    het, plain = F.col("other") == "HET", F.col("other").isin("WT", "ALT")
    out = own.join(other, "probe_idx").groupBy("probe_idx", "kind").agg(
        F.count_if(het).alias("het_groups"), F.count_if(plain & (F.col("other") == F.col("kind"))).alias("same_groups"), F.count_if(plain & (F.col("other") != F.col("kind"))).alias("different"),
    )
    differs = (F.col("different") > 0) | (F.lit(include_het) & (F.col("het_groups") > 0))
    return out.filter(differs & (F.lit(include_het) | (F.col("het_groups") == 0))).select("probe_idx", "kind", "het_groups", "same_groups")


# Libraries


def library_sizes(entries: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """(cell_idx, library_size): a cell's molecules, but for those of the probes ``without`` (probe_idx)."""
    kept = entries.join(without, "probe_idx", "left_anti") if without is not None else entries
    return kept.groupBy("cell_idx").agg(F.sum("n_umis").alias("library_size"))


def compare_libraries(wta: DataFrame, entries: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """(cell_idx, wta_size, gapfill_size) of every cell of ``wta`` (cell_idx, gene, n)."""
    a = wta.groupBy("cell_idx").agg(F.sum("n").alias("wta_size"))
    b = library_sizes(entries, without).withColumnRenamed("library_size", "gapfill_size")
    return a.join(b, "cell_idx", "left").withColumn("gapfill_size", F.coalesce("gapfill_size", F.lit(0)))


def sites_genotyped(calls: DataFrame, n_probes: int, cells: DataFrame | None = None) -> DataFrame:
    """(cell_idx, n_genotyped, percent, any_genotyped): how many of a panel's probes have a call in a cell."""
    out = calls.filter("genotype is not null and genotype <> 'N/A'").groupBy("cell_idx").agg(F.countDistinct("probe_idx").alias("n_genotyped"))
    if cells is not None:
        out = cells.select("cell_idx").join(out, "cell_idx", "left").withColumn("n_genotyped", F.coalesce("n_genotyped", F.lit(0)))
    return out.withColumns({"percent": F.col("n_genotyped") * 100 / n_probes, "any_genotyped": F.col("n_genotyped") >= 1})


def molecules_by_probe(entries: DataFrame) -> DataFrame:
    """(probe_idx, n_umis, n_cells), most molecules first when sorted: cells count that have any."""
    pairs = entries.groupBy("cell_idx", "probe_idx").agg(F.sum("n_umis").alias("n"))
    return pairs.groupBy("probe_idx").agg(F.sum("n").alias("n_umis"), F.count_if(F.col("n") > 0).alias("n_cells"))


def cell_probe_histogram(entries: DataFrame, bins: int = 25) -> DataFrame:
    """(bin, n) of molecules in a (cell, probe) that has any, in equal bins up to the largest."""
    by_value = entries.groupBy("cell_idx", "probe_idx").agg(F.sum("n_umis").alias("v")).filter("v > 0").groupBy("v").agg(F.count(F.lit(1)).alias("k"))
    low, high = F.min("v").over(Window.partitionBy()), F.max("v").over(Window.partitionBy())  # over distinct values
    at = F.when(F.col("high") == F.col("low"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("low")) * bins / (F.col("high") - F.col("low")))))
    return by_value.withColumns({"low": low, "high": high}).groupBy(at.cast("int").alias("bin")).agg(F.sum("k").alias("n"))


def controls_of(probes: DataFrame) -> DataFrame:
    """(probe_idx, control_idx): each probe's control, of the same gene, named so or as the gene itself (the least index).

    ``probes`` is (probe_idx, name, gene).
    """
    is_control = F.col("name").contains(CONTROL) | (F.col("name") == F.col("gene"))
    control = probes.filter(is_control).groupBy("gene").agg(F.min("probe_idx").alias("control_idx"))
    return probes.join(control, "gene").filter("probe_idx <> control_idx").select("probe_idx", "control_idx")


def saturations(runs: dict[str, DataFrame], points: int = 1000) -> tuple[DataFrame, DataFrame]:
    """((run, saturation) and (run, fraction, mean_reads_per_cell, saturation)) over the entries of several runs."""
    now, curves = None, None
    for name, entries in sorted(runs.items()):
        collapsed = collapse_gapfills(entries)
        a, b = saturation(collapsed).withColumn("run", F.lit(name)), saturation_curve(collapsed, points).withColumn("run", F.lit(name))
        now, curves = (a, b) if now is None else (now.unionByName(a), curves.unionByName(b))
    if now is None:
        raise ValueError("no runs")
    return now.select("run", "saturation"), curves.select("run", "fraction", "mean_reads_per_cell", "saturation")


# Whole transcriptome


def wta_in_order(wta: DataFrame, cells: DataFrame) -> DataFrame:
    """``wta`` (barcode, gene, n) of cells that the run has, under the run's cell numbers."""
    return wta.join(cells.select("barcode", "cell_idx"), "barcode").drop("barcode")


def probes_with_genes(entries: DataFrame, probes: DataFrame, wta: DataFrame) -> DataFrame:
    """(cell_idx, probe_idx, n_umis, gene_count): a probe's molecules beside its gene's counts in the cell, 0 without any.

    ``probes`` is (probe_idx, name); ``wta`` is (cell_idx, gene, n); a probe's gene is its name's first part.
    """
    named = probes.select("probe_idx", gene_of(F.col("name")).alias("gene"))
    own = entries.groupBy("cell_idx", "probe_idx").agg(F.sum("n_umis").alias("n_umis")).join(named, "probe_idx")
    genes = wta.groupBy("cell_idx", "gene").agg(F.sum("n").alias("gene_count"))
    return own.join(genes, ["cell_idx", "gene"], "left").select("cell_idx", "probe_idx", "n_umis", F.coalesce("gene_count", F.lit(0)).alias("gene_count"))


def with_metadata(table: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """Every row of a dimension with what is known of it: features by probe, cells by barcode."""
    return table.join(metadata, key, "left")


# Names


def probe_label(name: Column) -> Column:
    """A probe's gene and variant, of ``id|gene|variant|...``; other names stay."""
    parts = F.split(name, r"\|")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 2, 2), " ")).otherwise(name)


def variant_alleles(name: Column) -> Column:
    """struct(wild, variant) of a name with ``ref>alt``: the letter before the sign and what follows it; nulls without."""
    last = F.element_at(F.split(name, " "), -1)
    has = last.contains(">")
    before, after = F.split_part(last, F.lit(">"), F.lit(1)), F.split_part(last, F.lit(">"), F.lit(2))
    return F.struct(F.when(has, F.right(before, F.lit(1))).alias("wild"), F.when(has, after).alias("variant"))


def dual_probe_pairs(probes: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(mutant, wild, variant, reference): mutant probes ``x>y`` with the wild-type probe ``x>x`` of theirs, by name.

    ``probes`` is (name); ``more`` (mutant, wild, variant, reference) adds pairs whose names don't follow the rule.
    Controls and probes without a partner are left out.
    """
    named = probes.filter(~F.col("name").contains(CONTROL) & F.col("name").contains(">")).select("name").distinct()
    orig, alt = F.split_part("name", F.lit(">"), F.lit(1)), F.split_part("name", F.lit(">"), F.lit(2))
    parts = named.select("name", orig.alias("orig"), alt.alias("variant"), F.right(orig, F.lit(1)).alias("reference")).filter("variant <> reference")
    wild = parts.select(F.col("name").alias("mutant"), F.concat_ws(">", "orig", "reference").alias("wild"), "variant", "reference")
    out = wild.join(probes.select(F.col("name").alias("wild")).distinct(), "wild", "left_semi").select("mutant", "wild", "variant", "reference")
    return out.unionByName(more) if more is not None else out


def recast_dual_probes(entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """``entries`` (cell_idx, name, gapfill, n_umis) of pairs of probes as alleles of one: the mutant's name, its allele as gapfill.

    Molecules with a gapfill of their own are left out, as such probes have none; controls stay as they are.
    """
    plain = entries.filter("gapfill = ''")
    control = plain.filter(F.col("name").contains(CONTROL)).select("cell_idx", "name", "gapfill", "n_umis")
    as_wild = pairs.select(F.col("wild").alias("name"), "mutant", F.col("reference").alias("allele"))
    as_mutant = pairs.select(F.col("mutant").alias("name"), "mutant", F.col("variant").alias("allele"))
    out = plain.join(as_wild.unionByName(as_mutant), "name").select("cell_idx", F.col("mutant").alias("name"), F.col("allele").alias("gapfill"), "n_umis")
    return out.unionByName(control)


# Samples and selections


def combined(tables: dict[str, DataFrame], key: str = "barcode", by: str = "sample") -> DataFrame:
    """Several samples' rows under one roof: names as ``sample-name``, columns that some lack as nulls."""
    out = None
    for name, df in sorted(tables.items()):
        part = df.withColumns({key: F.concat_ws("-", F.lit(name), key), by: F.lit(name)})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no samples")
    return out


def one_sample(table: DataFrame, name: str, key: str = "barcode", by: str = "sample") -> DataFrame:
    """What ``combined`` was given for a sample."""
    return table.filter(F.col(by) == name).withColumn(key, F.col(key).substr(F.lit(len(name) + 2), F.length(key))).drop(by)


def missing_cells(a: DataFrame, b: DataFrame, key: str = "cell_idx") -> DataFrame:
    """(key) of cells that ``a`` has and ``b`` lacks."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def genotype_columns(calls: DataFrame, probes: list[int] | None = None) -> DataFrame:
    """(cell_idx, probe_idx, genotype) of the asked probes, as heat maps and embeddings colour cells by; an unknown probe is an error."""
    if probes is None:
        return calls.select("cell_idx", "probe_idx", "genotype")
    known = {r[0] for r in calls.filter(F.col("probe_idx").isin(probes)).select("probe_idx").distinct().collect()}
    if lost := sorted(set(probes) - known):
        raise ValueError(f"no such probes: {lost}")
    return calls.filter(F.col("probe_idx").isin(probes)).select("cell_idx", "probe_idx", "genotype")


# Logos


def logo_difference(reference: DataFrame, other: DataFrame) -> DataFrame:
    """(probe_idx, position, base, difference) of two sets of frequencies: shares of the first less those of the second."""
    a, b = logo_matrix(reference).withColumnRenamed("share", "x"), logo_matrix(other).withColumnRenamed("share", "y")
    return a.join(b, ["probe_idx", "position", "base"], "full").select("probe_idx", "position", "base", (F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))).alias("difference"))


def reverse_complement_logo(logo: DataFrame) -> DataFrame:
    """A logo as read from the other strand: positions from the end, bases complemented."""
    last = F.max("position").over(Window.partitionBy("probe_idx"))
    return logo.withColumns({"position": last - F.col("position"), "base": F.translate("base", "ACGT", "TGCA")})
