"""Reads to molecules: identifier correction, chimera removal and gapfill consensus.

Reads are ``(cell_idx, probe_idx, probe_barcode, umi, gapfill, read_id)``; ``read_id`` is the order in which reads were
seen and the last tie-break everywhere, so results don't depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import max_distance
from .fuzzy import coded, coded_hamming, pair_keys

PAD = "~"
GROUP = ["cell_idx", "probe_barcode"]


def near_identifiers(nodes: DataFrame) -> DataFrame:
    """(group, umi, rank, earlier): identifiers within the distance of ones of their group visited before, and which.

    ``nodes`` is (group, umi, rank, padded, d). Candidates share segments: pairs of them for the usual distances of 1
    and 2, single ones beyond. No (cell, sample) meets in one row or task.
    """
    d, n = F.col("d"), F.length("padded")
    single = F.transform(F.sequence(F.lit(0), d.cast("int")), lambda i: F.struct(i.alias("i"), n.alias("n"), F.col("padded").substr(F.floor(n * i / (d + 1)).cast("int") + 1, (F.floor(n * (i + 1) / (d + 1)) - F.floor(n * i / (d + 1))).cast("int")).alias("s")))
    keys = F.when(d == 1, pair_keys(F.col("padded"), n, 1)).when(d == 2, pair_keys(F.col("padded"), n, 2)).otherwise(single)
    keyed = nodes.select(*GROUP, "umi", "rank", "padded", "d", coded(F.col("padded")).alias("code"), F.explode(keys).alias("k"))
    a = keyed.withColumnsRenamed({c: f"{c}_a" for c in ("umi", "rank", "padded", "d", "code")})  # the same exchange serves both sides
    both = a.join(keyed, [*GROUP, "k"]).filter((F.col("rank_a") < F.col("rank")) & (coded_hamming(F.col("padded_a"), F.col("code_a"), F.col("padded"), F.col("code")) <= F.col("d")) & (F.col("d_a") == F.col("d")))
    return both.groupBy(*GROUP, "umi", "rank").agg(F.array_sort(F.collect_set(F.struct(F.col("rank_a").alias("rank"), F.col("umi_a").alias("umi")))).alias("earlier"))


def _visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, sample, umi, rank, earlier) in order: each with the first earlier one that was accepted, or itself."""
    group, accepted, seen = None, set(), set()
    for batch in batches:
        taken = []
        for cell, sample, umi, rank, earlier in zip(*(c.to_pylist() for c in batch.columns)):
            if (cell, sample) != group:
                group, accepted, seen = (cell, sample), set(), set()
            to = None
            for x in earlier:
                # One that has no earlier neighbour itself isn't among the rows and stands.
                if x["rank"] in accepted or x["rank"] not in seen:
                    to = x["umi"]
                    break
            seen.add(rank)
            if to is None:
                accepted.add(rank)
            taken.append(to)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(taken, pa.string())], names=["fix_cell", "fix_sample", "fix_umi", "taken"])


def correct_umis(reads: DataFrame, per10: float = 1) -> DataFrame:
    """``reads`` with ``corrected_umi``.

    In each cell and sample, (probe, identifier) pairs are visited by probe (descending), reads (descending) and first
    read; an identifier within the distance of an accepted one takes the first such, else is accepted. What an
    identifier is taken for is settled at its first visit, so the visit is over a sample's distinct identifiers, and it
    depends on earlier neighbours only: these are found by a join on segments, and the ordered pass is over identifiers
    that have any, streamed in visiting order; the others stand as they are. Reads of no cell or sample keep theirs.
    """
    pairs = reads.groupBy(*GROUP, "probe_idx", "umi").agg(F.count(F.lit(1)).alias("n"), F.min("read_id").alias("first_read"))
    visit = F.struct((-F.col("probe_idx")).alias("p"), (-F.col("n")).alias("n"), "first_read")
    first = pairs.groupBy(*GROUP, "umi").agg(F.min(visit).alias("visit"))
    longest = F.max(F.length("umi")).over(Window.partitionBy("cell_idx"))
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy("visit", "umi")).cast("long")
    nodes = first.select(*GROUP, "umi", longest.alias("longest"), rank.alias("rank"))
    nodes = nodes.select(*GROUP, "umi", "rank", F.rpad("umi", F.col("longest"), PAD).alias("padded"), max_distance(F.col("longest"), per10).alias("d"))
    kinds = {c: reads.schema[c].dataType.simpleString() for c in GROUP}
    fixed = near_identifiers(nodes).repartition(*GROUP).sortWithinPartitions(*GROUP, "rank").mapInArrow(_visit, f"fix_cell {kinds['cell_idx']}, fix_sample {kinds['probe_barcode']}, fix_umi string, taken string")
    on = (F.col("cell_idx") == F.col("fix_cell")) & (F.col("probe_barcode") == F.col("fix_sample")) & (F.col("umi") == F.col("fix_umi"))
    return reads.join(fixed.filter("taken is not null"), on, "left").select(*reads.columns, F.coalesce("taken", "umi").alias("corrected_umi"))


def remove_chimeras(reads: DataFrame, umi: str = "corrected_umi") -> DataFrame:
    """Reads of the probe with most reads for each (cell, sample, identifier); ties go to the higher probe index."""
    counts = reads.groupBy("cell_idx", "probe_barcode", umi, "probe_idx").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("cell_idx", "probe_barcode", umi).agg(F.max(F.struct("n", "probe_idx")).alias("b"))
    best = best.select("cell_idx", "probe_barcode", umi, F.col("b.probe_idx").alias("probe_idx"))
    return reads.join(best, ["cell_idx", "probe_barcode", umi, "probe_idx"], "left_semi")


def consensus(reads: DataFrame, umi: str = "umi") -> DataFrame:
    """One row a molecule: gapfill, pcr_duplicate_count, percent_supporting, corrected.

    Unanimous molecules keep their sequence. Others keep the most frequent length (tie: seen first); if one sequence is
    left it stands, else each position takes the base with most votes (tie: A, T, C, G; N votes for all four). Only
    those with several sequences of that length are split into positions.
    """
    key = ["cell_idx", "probe_idx", "probe_barcode", umi]
    seqs = reads.groupBy(*key, "gapfill").agg(F.count(F.lit(1)).alias("n"), F.min("read_id").alias("first_read"))
    seqs = seqs.withColumn("len", F.length("gapfill"))
    lengths = seqs.groupBy(*key, "len").agg(
        F.sum("n").alias("n"), F.min("first_read").alias("first_read"), F.collect_list(F.struct("gapfill", F.col("n").alias("k"))).alias("seqs")
    )
    chosen = lengths.groupBy(*key).agg(F.sum("n").alias("total"), F.max(F.struct("n", (-F.col("first_read")).alias("order"), "seqs", "len")).alias("best"))
    chosen = chosen.select(*key, "total", F.col("best.seqs").alias("seqs"), F.col("best.len").alias("len"))
    bases = F.array(*[F.lit(b) for b in "ATCG"])

    def at(i: Column) -> Column:
        votes = F.transform(
            bases,
            lambda b, k: F.struct(
                F.aggregate(F.col("seqs"), F.lit(0).cast("long"), lambda s, x: s + F.when(x["gapfill"].substr(i, F.lit(1)).isin("N") | (x["gapfill"].substr(i, F.lit(1)) == b), x["k"]).otherwise(0)).alias("v"),
                (-k).alias("k"), b.alias("b"),
            ),
        )
        return F.array_max(votes)["b"]

    voted = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.col("len"), F.lit(1))), at), "")
    seq = F.when(F.size("seqs") == 1, F.col("seqs")[0]["gapfill"]).otherwise(voted)
    out = chosen.withColumn("gapfill", seq)
    exact = F.aggregate("seqs", F.lit(0).cast("long"), lambda s, x: s + F.when(x["gapfill"] == F.col("gapfill"), x["k"]).otherwise(0))
    out = out.withColumn("percent_supporting", exact / F.col("total"))
    return out.select(*key, "gapfill", F.col("total").alias("pcr_duplicate_count"), "percent_supporting", (F.col("percent_supporting") < 1).alias("corrected"))
