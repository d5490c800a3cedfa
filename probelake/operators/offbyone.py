"""Gapfills one base short of better supported ones of the same cell and probe take those ones' place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUP = "array<struct<len:int,gapfill:string,n:double>>"


def one_gap_distance(short: Column, long: Column) -> Column:
    """Least edits of an alignment that puts one gap into the shorter of two sequences and none into the longer: 1 and its mismatches."""

    def without(i: Column) -> Column:
        return F.split(F.concat(long.substr(F.lit(1), i - 1), long.substr(i + 1, F.length(long))), "")

    def mismatches(i: Column) -> Column:
        return F.aggregate(F.zip_with(without(i), F.split(short, ""), lambda a, b: F.when(a.eqNullSafe(b), 0).otherwise(1)), F.lit(0), lambda s, x: s + x)

    return 1 + F.array_min(F.transform(F.sequence(F.lit(1), F.length(long)), mismatches))


def correct_off_by_one(entries: DataFrame, probes: list[int] | None = None) -> DataFrame:
    """``entries`` (cell_idx, probe_idx, gapfill, n_umis) after moving molecules from gapfills of length L - 1 to L.

    For every length on its own, by the counts as given: nothing moves from several shorter gapfills to a single longer
    one, nor where the longer ones together have no more molecules, nor where aligning a shorter one with its nearest
    longer one takes a gap in the longer. Else each shorter one moves to its nearest longer one; where several are as
    near, its molecules are split in proportion to theirs and rounded (half to even). What a gapfill receives it keeps,
    even if its own molecules move on. Only ``probes`` are corrected, all by default. A (cell, probe) has few gapfills:
    they are gathered to arrays. Null or zero counts take no part and give no rows; an empty gapfill has length 0.
    """
    groups = entries.filter("n_umis > 0").groupBy("cell_idx", "probe_idx").agg(
        F.sort_array(F.collect_list(F.struct(F.length("gapfill").alias("len"), "gapfill", F.col("n_umis").cast("double").alias("n")))).cast(GROUP).alias("g")
    )
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x["n"])

    def moves(size: Column) -> Column:
        """What moves from length ``size`` - 1: array<struct<gapfill, n>>, signed."""
        longer, shorter = F.filter("g", lambda x: x["len"] == size), F.filter("g", lambda x: x["len"] == size - 1)
        usable = (F.size(longer) > 0) & (F.size(shorter) > 0) & ((F.size(longer) > 1) | (F.size(shorter) == 1)) & (total(longer) > total(shorter))

        def nearest(s: Column) -> Column:
            least = F.array_min(F.transform(longer, lambda x: F.levenshtein(x["gapfill"], s["gapfill"])))
            return F.filter(longer, lambda x: F.levenshtein(x["gapfill"], s["gapfill"]) == least)

        gapped = F.exists(shorter, lambda s: F.exists(nearest(s), lambda x: one_gap_distance(s["gapfill"], x["gapfill"]) > F.levenshtein(x["gapfill"], s["gapfill"])))

        def of(s: Column) -> Column:
            to = nearest(s)
            gains = F.transform(to, lambda x: F.struct(x["gapfill"].alias("gapfill"), F.bround(s["n"] * x["n"] / total(to), 0).alias("n")))
            return F.concat(gains, F.array(F.struct(s["gapfill"].alias("gapfill"), (-s["n"]).alias("n"))))

        return F.when(usable & ~gapped, F.flatten(F.transform(shorter, of))).otherwise(F.array().cast("array<struct<gapfill:string,n:double>>"))

    asked = F.col("probe_idx").isin(list(probes)) if probes is not None else F.lit(True)
    several = asked & (F.size("g") > 1)
    lengths = F.array_distinct(F.transform("g", lambda x: x["len"]))
    out = groups.withColumn("moved", F.when(several, F.flatten(F.transform(lengths, moves))).otherwise(F.array().cast("array<struct<gapfill:string,n:double>>")))
    changed = F.transform("g", lambda x: F.struct(x["gapfill"].alias("gapfill"), (x["n"] + F.aggregate(F.filter("moved", lambda m: m["gapfill"] == x["gapfill"]), F.lit(0.0), lambda s, m: s + m["n"])).alias("n")))
    flat = out.select("cell_idx", "probe_idx", F.explode(changed).alias("x")).select("cell_idx", "probe_idx", F.col("x.gapfill").alias("gapfill"), F.col("x.n").cast("long").alias("n_umis"))
    return flat.filter("n_umis > 0")
