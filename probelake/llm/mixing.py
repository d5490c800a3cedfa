"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same fractional number of copies, target / source size. Its whole part
is taken; the fractions are settled pairwise: two documents exchange words (copies times size, so a source's total
stays as it is) at random until one of them is whole, each keeping its expectation. Groups of a source's documents
settle on their own and leave at most one fraction, and the leftovers meet in a reduction tree of fixed fan-in
until one is left a source. That one is rounded, and smaller documents of the last group make up for what that is off,
as far as they can; a source's words differ from its target by less than one document at most. Draws depend on seed, source and group only, so reruns agree.

Null text has size 0, a null source is a source of its own (last in order). Documents of size 0 get no copies. Rows
that agree in id, source and size are settled as one and get the same number of copies; documents of equal size are
taken in order of id. A very long text is one document: what rounding is off by can be as large as it. The last group's
make-up step is no pivotal step: documents that it moves keep their expectation only up to one document a source. Empty
tables give none. Other columns pass through ``mix``; names that start with ``mx_`` are its own.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .common import cut, maybe_broadcast, table, words

GROUP_DOCS, FAN_IN, MOST_COPIES, WEIGHTS = 2000, 32, 3, (1, 2, 3)
EPS = 1e-9


def positions(df: DataFrame, order) -> DataFrame:
    """``df`` with ``position``, 0 upwards in the given order; sorted by range partitions, so nothing meets in one task."""
    ranged = cut(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("mx_at", F.monotonically_increasing_id()))
    part = F.shiftright("mx_at", 33)
    counts = sorted((r["p"], r["n"]) for r in ranged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, pairs = 0, []
    for p, n in counts:  # a row for each partition
        pairs += [F.lit(p), F.lit(before)]
        before += n
    if not pairs:
        return ranged.withColumn("position", F.lit(0).cast("long")).drop("mx_at")
    return ranged.withColumn("position", (F.create_map(*pairs)[part] + F.col("mx_at").bitwiseAND((1 << 33) - 1)).cast("long")).drop("mx_at")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """From (mx_source, mx_size): mx_source, mx_docs, mx_source_size, mx_weight, mx_target.

    Shares are by weight; a target above ``most`` times its source is held there and the excess is shared anew.
    """
    sources = sizes.groupBy("mx_source").agg(F.sum("mx_size").cast("long").alias("mx_source_size"), F.count(F.lit(1)).alias("mx_docs"))
    sources = positions(sources, F.col("mx_source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    sources = cut(sources.withColumn("mx_weight", weight).drop("position"))
    cap, level, held = most * F.col("mx_source_size"), 0.0, -1
    total = sources.agg(F.sum("mx_source_size")).first()[0] or 0
    while total:  # one row to the driver each time
        above = cap <= level * F.col("mx_weight")
        r = sources.agg(
            F.sum(F.when(above, cap)).alias("caps"), F.sum(F.when(~above, F.col("mx_weight"))).alias("w"), F.count(F.when(above, 1)).alias("n")
        ).first()
        if r["n"] == held or not r["w"]:
            break
        held, level = r["n"], (total - (r["caps"] or 0)) / r["w"]
    return sources.withColumn("mx_target", F.least(cap.cast("double"), F.lit(float(level)) * F.col("mx_weight")))


def settle(group: tuple, rows: pd.DataFrame, seed: int, level: int, last: bool) -> pd.DataFrame:
    """Settle the fractions of one group; all rows but one at most come out whole, and that too if ``last``."""
    rows = rows.sort_values(["mx_id", "mx_size"], kind="stable").reset_index(drop=True)
    rng = np.random.default_rng(zlib.crc32(repr((seed, level, *[None if pd.isna(g) else g for g in group])).encode()))
    draws = rng.random(len(rows) + 1)
    touched = ((rows["mx_part"] > EPS) & (rows["mx_part"] < 1 - EPS)).tolist()
    sizes, x, open_at = (rows["mx_size"] * rows["mx_rows"]).tolist(), rows["mx_part"].tolist(), -1
    for i, s in enumerate(sizes):
        if not EPS < x[i] < 1 - EPS:
            continue
        if open_at < 0:
            open_at = i
            continue
        j = open_at
        up = min(1 - x[i], x[j] * sizes[j] / s)
        down = min(x[i], (1 - x[j]) * sizes[j] / s)
        step = up if draws[i] * (up + down) < down else -down
        x[i] += step
        x[j] -= step * s / sizes[j]
        whole_i, whole_j = not EPS < x[i] < 1 - EPS, not EPS < x[j] < 1 - EPS
        open_at = (-1 if whole_j else j) if whole_i else i
    if last and open_at >= 0:
        over = (round_up := float(draws[-1] < x[open_at])) * sizes[open_at] - x[open_at] * sizes[open_at]
        x[open_at] = round_up
        for i in sorted(range(len(x)), key=lambda i: -sizes[i]):  # what rounding is off by, smaller documents make up
            whole = round(x[i]) if i != open_at and not EPS < x[i] < 1 - EPS and touched[i] else -1
            if whole == 1 and sizes[i] <= over:
                x[i], over = 0.0, over - sizes[i]
            elif whole == 0 and 0 < sizes[i] <= -over:
                x[i], over = 1.0, over + sizes[i]
    x = np.array(x)
    done = ~((x > EPS) & (x < 1 - EPS))
    rows["mx_part"] = np.where(done, np.round(x), x)
    rows["mx_done"] = done
    return rows


def settler(seed: int, level: int, last: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return settle(key, rows, seed, level, last)

    return run


def copies(sizes: DataFrame, seed: int = 7, group_docs: int = GROUP_DOCS, fan_in: int = FAN_IN, most: int = MOST_COPIES) -> DataFrame:
    """From (mx_id, mx_source, mx_size), a row for each distinct one: those, mx_rows, mx_source_size, mx_target, mx_copies."""
    sizes = cut(sizes)
    targets = cut(source_targets(sizes, most=most))
    n_groups = F.greatest(F.lit(1), F.ceil(F.col("mx_docs") / group_docs))
    rate = F.when(F.col("mx_source_size") > 0, F.least(F.lit(float(most)), F.col("mx_target") / F.col("mx_source_size"))).otherwise(F.lit(0.0))
    units = sizes.groupBy("mx_id", "mx_source", "mx_size").agg(F.count(F.lit(1)).alias("mx_rows"))
    info = targets.select(F.col("mx_source").alias("mx_of"), "mx_source_size", "mx_target", n_groups.cast("long").alias("mx_groups"), rate.alias("mx_rate"))
    units = units.join(maybe_broadcast(info), F.col("mx_source").eqNullSafe(F.col("mx_of")), "left").drop("mx_of")
    rate = F.when(F.col("mx_size") > 0, F.col("mx_rate")).otherwise(F.lit(0.0))
    units = units.withColumns({
        "mx_whole": F.floor(rate), "mx_part": rate - F.floor(rate),
        "mx_group": F.pmod(F.xxhash64("mx_id", F.lit(seed)), F.col("mx_groups")),
    }).drop("mx_rate")
    most_groups = targets.agg(F.max(n_groups)).first()[0] or 1
    levels = max(0, math.ceil(math.log(most_groups, fan_in) - 1e-12))
    schema = StructType([*units.schema.fields, StructField("mx_done", BooleanType())])
    settled, left = [], units
    for level in range(levels + 1):
        last = level == levels
        step = left.withColumn("mx_group", F.floor(F.col("mx_group") / fan_in)) if level else left
        out = cut(step.groupBy("mx_source", "mx_group").applyInPandas(settler(seed, level, last), schema))
        settled.append(out.filter("mx_done"))
        left = out.filter("not mx_done").drop("mx_done")
    whole = settled[0]
    for x in settled[1:]:
        whole = whole.unionByName(x)
    return whole.select("mx_id", "mx_source", "mx_size", "mx_rows", "mx_source_size", "mx_target", (F.col("mx_whole") + F.col("mx_part")).cast("long").alias("mx_copies"))


def sizes_of(df: DataFrame, id: str, source: str, text: str) -> DataFrame:
    return df.select(F.col(id).alias("mx_id"), F.col(source).alias("mx_source"), F.size(words(F.col(text))).cast("long").alias("mx_size"))


def mix(df: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 7) -> DataFrame:
    """``df`` with each row as often as the mix takes it (0 to 3 times)."""
    decided = copies(sizes_of(df, id, source, text), seed).select("mx_id", F.col("mx_source").alias("mx_from"), F.col("mx_size").alias("mx_n"), "mx_copies")
    sized = df.withColumn("mx_size", F.size(words(F.col(text))).cast("long"))
    decided = cut(decided.filter("mx_copies > 0"))
    on = F.col(id).eqNullSafe(F.col("mx_id")) & F.col(source).eqNullSafe(F.col("mx_from")) & (F.col("mx_size") == F.col("mx_n"))
    taken = sized.join(maybe_broadcast(decided), on)
    return taken.withColumn("mx_copy", F.explode(F.sequence(F.lit(1), F.col("mx_copies").cast("int")))).select(*[F.col(c) for c in df.columns])


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = copies(sizes_of(table(spark, sf_dir, "documents"), "doc_id", "source", "text"))
    out = out.withColumn("mx_row", F.explode(F.sequence(F.lit(1), F.col("mx_rows").cast("int"))))
    return out.select(
        F.col("mx_id").alias("doc_id"), F.col("mx_size").alias("size"), F.col("mx_source_size").alias("source_size"), F.col("mx_target").alias("target"),
        (F.col("mx_copies") * F.col("mx_size")).alias("taken"), F.col("mx_source").alias("source"), F.col("mx_copies").alias("copies"),
    )


QUERIES = {"op4_mix_sources": op4_mix_sources}
ORACLES: dict[str, str] = {}
