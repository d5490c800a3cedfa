"""Molecules to counts, in long form: one row a (cell, probe, gapfill) that occurs; zeros are implicit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ENTRY = ["cell_idx", "probe_idx", "gapfill"]
PCR_EPS = 1e-4


def collect_counts(molecules: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """n_umis, total_reads and the mean support of each entry (its sum over n_umis + 1e-4); ``by``: sample columns that part entries."""
    return molecules.groupBy(*by, *ENTRY).agg(
        F.count(F.lit(1)).alias("n_umis"), F.sum("pcr_duplicate_count").alias("total_reads"),
        (F.sum("percent_supporting") / (F.count(F.lit(1)) + F.lit(PCR_EPS))).alias("percent_supporting"),
    )


def of_cells(molecules: DataFrame, cells: DataFrame, plex: str = "probe_barcode") -> DataFrame:
    """Molecules of the cells that their own sample lists: a cell of another sample is another cell, whatever its number."""
    return molecules.join(cells.select(plex, "cell_idx").distinct(), [plex, "cell_idx"], "left_semi")


def feature_dictionary(molecules: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(probe_idx, gapfill, feature_idx) in lexicographic order; features are a dimension, small beside the reads."""
    features = molecules.select(*by, "probe_idx", "gapfill").distinct()
    w = Window.partitionBy(*by).orderBy("probe_idx", "gapfill")
    return features.withColumn("feature_idx", (F.row_number().over(w) - 1).cast("long"))


def numbered(df: DataFrame, name: str, by: str, *rest: str) -> DataFrame:
    """``df`` with ``name``, 0 upwards by the numeric column ``by``, then ``rest``, without one task that sees all rows.

    Rows go to ranges between quantiles of ``by`` and are numbered in each, after what earlier ranges count. ``df`` is
    read three times, so it should be a written table.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = df.agg(F.percentile_approx(by, [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0]
    bounds = F.array(*[F.lit(x) for x in sorted(set(found or []))]).cast("array<bigint>")
    ranged = df.withColumn("nb_range", F.coalesce(F.size(F.filter(bounds, lambda x: x < F.col(by))), F.lit(0)))
    before, pairs = 0, []
    for r in sorted(ranged.groupBy("nb_range").count().collect()):  # a row for each range
        pairs += [F.lit(r["nb_range"]), F.lit(before)]
        before += r["count"]
    start = F.create_map(*pairs)[F.col("nb_range")] if pairs else F.lit(0)
    at = F.row_number().over(Window.partitionBy("nb_range").orderBy(by, *rest)) - 1
    return ranged.withColumn(name, (start + at).cast("long")).drop("nb_range")


def cell_index(reads: DataFrame, key: str | list[str] = "barcode", order: str = "read_id", written: str | None = None) -> DataFrame:
    """(key, first_read, cell_idx) numbered by first appearance. In multiplexed runs the key holds the sample as well.

    ``written``: a folder for the unnumbered cells, which are then numbered by ranges instead of in one window.
    """
    keys = [key] if isinstance(key, str) else list(key)
    cells = reads.groupBy(*keys).agg(F.min(order).alias("first_read"))
    if written:
        cells.write.mode("overwrite").parquet(written)
        return numbered(reads.sparkSession.read.parquet(written), "cell_idx", "first_read", *keys)
    return cells.withColumn("cell_idx", (F.row_number().over(Window.orderBy("first_read", *keys)) - 1).cast("long"))


def pcr_layers(molecules: DataFrame, most: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """(entry, threshold, n_umis): molecules with at least ``threshold`` reads, for 1 to the most reads of any entry, ``most`` at most.

    Counts by entry and number of reads come first, so the expansion by threshold is over entries, not molecules.
    """
    by_reads = molecules.groupBy(*by, *ENTRY, F.least("pcr_duplicate_count", F.lit(most)).cast("int").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    layers = by_reads.withColumn("threshold", F.explode(F.sequence(F.lit(1), F.col("d"))))
    return layers.groupBy(*by, *ENTRY, "threshold").agg(F.sum("n").alias("n_umis"))


def with_min_duplicates(molecules: DataFrame, threshold: int) -> DataFrame:
    """Counts over molecules with at least ``threshold`` reads."""
    if threshold < 1:
        raise ValueError("threshold must be at least 1")
    return collect_counts(molecules.filter(F.col("pcr_duplicate_count") >= threshold))


def flat_file(molecules: DataFrame, manifest: DataFrame, cells: DataFrame) -> DataFrame:
    """Every molecule with its cell's barcode and its probe's two arms' names (a decoy's name holds both, by ``/``)."""
    probes = manifest.select(F.col("index").alias("probe_idx"), F.split_part("name", F.lit("/"), F.lit(1)).alias("lhs_name"), F.coalesce(F.nullif(F.split_part("name", F.lit("/"), F.lit(2)), F.lit("")), F.col("name")).alias("rhs_name"))
    return molecules.join(F.broadcast(probes) if _small(manifest) else probes, "probe_idx").join(cells.select("cell_idx", "barcode"), "cell_idx")


def _small(df: DataFrame, limit: int = 8 << 20) -> bool:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def collapse_gapfills(entries: DataFrame, value_cols: tuple[str, ...] = ("n_umis", "total_reads")) -> DataFrame:
    """Entries summed by (cell, probe); percent_supporting is the mean over all the probe's features, absent ones as 0."""
    widths = entries.select("probe_idx", "gapfill").distinct().groupBy("probe_idx").agg(F.count(F.lit(1)).alias("n_features"))
    sums = entries.groupBy("cell_idx", "probe_idx").agg(*[F.sum(c).alias(c) for c in value_cols], F.sum("percent_supporting").alias("support"))
    joined = sums.join(F.broadcast(widths) if _small(widths) else widths, "probe_idx")
    return joined.select("cell_idx", "probe_idx", *value_cols, (F.col("support") / F.col("n_features")).alias("percent_supporting"))


def saturation(entries: DataFrame) -> DataFrame:
    """One row: 1 - occupied (cell, probe) pairs / reads."""
    pairs = entries.groupBy("cell_idx", "probe_idx").agg(F.sum("total_reads").alias("r")).filter("r > 0")
    return pairs.agg((1 - F.count(F.lit(1)) / F.sum("r")).alias("saturation"))


def saturation_curve(entries: DataFrame, points: int = 1000, seed: int | None = None) -> DataFrame:
    """(fraction, mean_reads_per_cell, saturation) at ``points`` fractions of the reads.

    The expectation of binomial thinning, in one pass: sum(n p) reads and sum(1 - (1 - p)^n) occupied pairs, counted by
    distinct n. With ``seed``, each read is drawn by a hash instead.
    """
    pairs = entries.groupBy("cell_idx", "probe_idx").agg(F.sum("total_reads").alias("r")).filter("r > 0")
    n_cells = pairs.agg(F.countDistinct("cell_idx")).first()[0]
    step = (1 - 1e-5) / max(1, points - 1)
    ps = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.struct(i.alias("i"), (F.lit(1e-5) + i * F.lit(step)).alias("fraction")))
    if seed is None:
        by_n = pairs.groupBy("r").agg(F.count(F.lit(1)).alias("k")).withColumn("p", F.explode(ps))
        out = by_n.groupBy("p.i", "p.fraction").agg(F.sum(F.col("k") * F.col("r") * F.col("p.fraction")).alias("reads"), F.sum(F.col("k") * (1 - F.pow(1 - F.col("p.fraction"), F.col("r")))).alias("seen"))
    else:
        reads = pairs.withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), F.col("r"))))
        draw = F.pmod(F.xxhash64("cell_idx", "probe_idx", "j", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
        kept = reads.withColumn("draw", draw).withColumn("p", F.explode(ps)).filter("draw < p.fraction")
        out = kept.groupBy("p.i", "p.fraction", "cell_idx", "probe_idx").agg(F.count(F.lit(1)).alias("n"))
        out = out.groupBy("i", "fraction").agg(F.sum("n").alias("reads"), F.count(F.lit(1)).alias("seen"))
    return out.select("fraction", (F.col("reads") / F.lit(max(1, n_cells))).alias("mean_reads_per_cell"), (1 - F.col("seen") / F.col("reads")).alias("saturation"))


def summarize(entries: DataFrame, cells: DataFrame) -> DataFrame:
    """(statistic, value). Cells without entries count as zeros; deviations are of the population."""
    per_cell = cells.select("cell_idx").join(entries.groupBy("cell_idx").agg(F.sum("n_umis").alias("u")), "cell_idx", "left").select(F.coalesce("u", F.lit(0)).alias("u"))
    per_feature = entries.filter("n_umis > 0").groupBy("probe_idx", "gapfill").agg(F.countDistinct("cell_idx").alias("c"))
    a = per_cell.agg(
        F.count(F.lit(1)).alias("TOTAL_CELLS"), F.sum("u").alias("TOTAL_UMIS"), F.count_if(F.col("u") > 0).alias("GAPFILL_CONTAINING_CELLS"),
        F.avg("u").alias("UMIS_PER_CELL_MEAN"), F.median("u").alias("UMIS_PER_CELL_MEDIAN"), F.stddev_pop("u").alias("UMIS_PER_CELL_STD"),
        F.min("u").alias("UMIS_PER_CELL_MIN"), F.min(F.when(F.col("u") > 0, F.col("u"))).alias("UMIS_PER_CELL_MIN_EXCLUDING_ZERO"), F.max("u").alias("UMIS_PER_CELL_MAX"),
    )
    b = per_feature.agg(
        F.avg("c").alias("CELLS_PER_GAPFILL_MEAN"), F.median("c").alias("CELLS_PER_GAPFILL_MEDIAN"), F.stddev_pop("c").alias("CELLS_PER_GAPFILL_STD"),
        F.min("c").alias("CELLS_PER_GAPFILL_MIN"), F.max("c").alias("CELLS_PER_GAPFILL_MAX"),
    )
    c = saturation(entries).withColumnRenamed("saturation", "SEQUENCING_SATURATION")
    parts = [x.unpivot([], [F.col(n) for n in x.columns], "statistic", "value") for x in (y.select([F.col(n).cast("double") for n in y.columns]) for y in (a, b, c))]
    return parts[0].union(parts[1]).union(parts[2])


def summarize_by(entries: DataFrame, cells: DataFrame, plex: str = "probe_barcode") -> DataFrame:
    """(plex, statistic, value): ``summarize`` of every sample in one pass; both tables have the sample's column."""
    u = cells.select(plex, "cell_idx").join(entries.groupBy(plex, "cell_idx").agg(F.sum("n_umis").alias("u")), [plex, "cell_idx"], "left").select(plex, F.coalesce("u", F.lit(0)).alias("u"))
    c = entries.filter("n_umis > 0").groupBy(plex, "probe_idx", "gapfill").agg(F.countDistinct("cell_idx").alias("c"))
    pairs = entries.groupBy(plex, "cell_idx", "probe_idx").agg(F.sum("total_reads").alias("r")).filter("r > 0")
    a = u.groupBy(plex).agg(
        F.count(F.lit(1)).alias("TOTAL_CELLS"), F.sum("u").alias("TOTAL_UMIS"), F.count_if(F.col("u") > 0).alias("GAPFILL_CONTAINING_CELLS"),
        F.avg("u").alias("UMIS_PER_CELL_MEAN"), F.median("u").alias("UMIS_PER_CELL_MEDIAN"), F.stddev_pop("u").alias("UMIS_PER_CELL_STD"),
        F.min("u").alias("UMIS_PER_CELL_MIN"), F.min(F.when(F.col("u") > 0, F.col("u"))).alias("UMIS_PER_CELL_MIN_EXCLUDING_ZERO"), F.max("u").alias("UMIS_PER_CELL_MAX"),
    )
    b = c.groupBy(plex).agg(
        F.avg("c").alias("CELLS_PER_GAPFILL_MEAN"), F.median("c").alias("CELLS_PER_GAPFILL_MEDIAN"), F.stddev_pop("c").alias("CELLS_PER_GAPFILL_STD"),
        F.min("c").alias("CELLS_PER_GAPFILL_MIN"), F.max("c").alias("CELLS_PER_GAPFILL_MAX"),
    )
    s = pairs.groupBy(plex).agg((1 - F.count(F.lit(1)) / F.sum("r")).alias("SEQUENCING_SATURATION"))
    parts = [x.select(plex, *[F.col(n).cast("double") for n in x.columns if n != plex]) for x in (a, b, s)]
    longs = [x.unpivot([plex], [n for n in x.columns if n != plex], "statistic", "value") for x in parts]
    return longs[0].union(longs[1]).union(longs[2])


def barcode_ranks(entries: DataFrame) -> DataFrame:
    """(rank, n_umis, n_cells): the knee curve, one row a distinct total; ``rank`` is the last cell's with that total.

    Ranking is over distinct totals, whose number is small however many cells there are.
    """
    totals = entries.groupBy("cell_idx").agg(F.sum("n_umis").alias("n_umis")).groupBy("n_umis").agg(F.count(F.lit(1)).alias("n_cells"))
    return totals.withColumn("rank", F.sum("n_cells").over(Window.orderBy(F.desc("n_umis"))))


def duplicate_histogram(molecules: DataFrame, bins: int = 100) -> DataFrame:
    """(bin, n) of log10(reads + 1) in equal bins up to the largest."""
    by_reads = molecules.groupBy("pcr_duplicate_count").agg(F.count(F.lit(1)).alias("k")).withColumn("v", F.log10(F.col("pcr_duplicate_count") + 1))
    top = by_reads.agg(F.max("v").alias("top")).first()["top"] or 1.0
    return by_reads.groupBy(F.least(F.lit(bins - 1), F.floor(F.col("v") * bins / F.lit(top))).alias("bin")).agg(F.sum("k").alias("n"))


def reads_per_feature(entries: DataFrame) -> DataFrame:
    """(probe_idx, gapfill, reads, rank, uniform): ranked by reads, with what each would have if all had the same."""
    sums = entries.groupBy("probe_idx", "gapfill").agg(F.sum("total_reads").alias("reads"))
    w = Window.orderBy(F.desc("reads"), "probe_idx", "gapfill")
    return sums.withColumns({"rank": F.row_number().over(w), "uniform": F.avg("reads").over(Window.partitionBy())})


def state_metrics(reads: DataFrame, states: str = "states", probes: int | None = None) -> DataFrame:
    """(metric, value): reads by state, and totals."""
    by_state = reads.select(F.explode(states).alias("metric")).groupBy("metric").agg(F.count(F.lit(1)).alias("value"))
    totals = reads.agg(
        F.count(F.lit(1)).alias("TOTAL_READS"), F.count_if(F.col("probe_idx").isNotNull()).alias("PROBE_CONTAINING_READS"), F.countDistinct("probe_idx").alias("PROBES_ENCOUNTERED")
    )
    if probes is not None:
        totals = totals.withColumn("POSSIBLE_PROBES", F.lit(probes).cast("long"))
    return by_state.union(totals.unpivot([], totals.columns, "metric", "value"))
