"""Multiple alignment of a probe's gapfills: every sequence against the best supported one, gaps merged."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MATCH, MISMATCH, GAP = 1, -1, -2


def pairwise(a: str, b: str) -> tuple[str, str]:
    """A global alignment of two sequences; among equals, letters are paired rather than gaps put in, gaps come late."""
    rows = [[GAP * j for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row = [GAP * i]
        for j, y in enumerate(b, 1):
            row.append(max(rows[-1][j - 1] + (MATCH if x == y else MISMATCH), rows[-1][j] + GAP, row[-1] + GAP))
        rows.append(row)
    i, j, top, low = len(a), len(b), [], []
    while i or j:
        if j and rows[i][j] == rows[i][j - 1] + GAP:
            j -= 1
            top.append("-"), low.append(b[j])
        elif i and rows[i][j] == rows[i - 1][j] + GAP:
            i -= 1
            top.append(a[i]), low.append("-")
        else:
            i, j = i - 1, j - 1
            top.append(a[i]), low.append(b[j])
    return "".join(reversed(top)), "".join(reversed(low))


def aligned(sequences: list[str], weights: list[float]) -> list[str]:
    """All sequences at one length, gaps as ``-``; the centre is the one of most weight (tie: the longest, then the least)."""
    if not sequences:
        return []
    centre = min(range(len(sequences)), key=lambda k: (-weights[k], -len(sequences[k]), sequences[k]))
    pairs = [pairwise(sequences[centre], s) for s in sequences]
    n = len(sequences[centre])
    most = [0] * (n + 1)  # gaps before each letter of the centre, and at its end
    for top, _ in pairs:
        at, run = 0, 0
        for c in top:
            if c == "-":
                run += 1
            else:
                most[at], at, run = max(most[at], run), at + 1, 0
        most[at] = max(most[at], run)
    out = []
    for top, low in pairs:
        at, run, letters = 0, [], []
        for c, x in zip(top, low):
            if c == "-":
                run.append(x)
            else:
                letters += ["".join(run).ljust(most[at], "-"), x]
                at, run = at + 1, []
        letters.append("".join(run).ljust(most[at], "-"))
        out.append("".join(letters))
    return out


def align_gapfills(frequencies: DataFrame, align: bool = True) -> DataFrame:
    """``frequencies`` (probe_idx, gapfill, value) with ``aligned``: gapfills of a probe at one length.

    Without ``align`` they are padded on the right. A probe has few gapfills, so each probe is aligned in one go.
    """
    if not align:
        width = F.max(F.length("gapfill")).over(Window.partitionBy("probe_idx"))
        return frequencies.withColumn("aligned", F.rpad("gapfill", width, F.lit("-")))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("gapfill")
        return rows.assign(aligned=aligned(rows["gapfill"].tolist(), rows["value"].tolist()))

    kind = frequencies.schema["probe_idx"].dataType.simpleString()
    return frequencies.select("probe_idx", "gapfill", F.col("value").cast("double").alias("value")).groupBy("probe_idx").applyInPandas(run, f"probe_idx {kind}, gapfill string, value double, aligned string")


def aligned_logo(frequencies: DataFrame, align: bool = True) -> DataFrame:
    """(probe_idx, position, base, share) of aligned gapfills weighted by value."""
    letters = align_gapfills(frequencies, align).select("probe_idx", "value", F.posexplode(F.filter(F.split("aligned", ""), lambda c: c != "")).alias("position", "base"))
    sums = letters.groupBy("probe_idx", "position", "base").agg(F.sum("value").alias("v"))
    return sums.select("probe_idx", "position", "base", (F.col("v") / F.sum("v").over(Window.partitionBy("probe_idx", "position"))).alias("share"))
