"""Error-tolerant lookup in a whitelist, without comparing every sequence with every entry.

Exact matches come by an equi-join. For the rest, sequences and entries are cut into d + 2 segments: two of Hamming
distance d or less agree in two of them, so an equi-join on a pair of segments finds every candidate, with keys twice as
long as those of d + 1 segments. Candidates are compared by two-bit codes, and only what is near enough is kept and
shuffled. With indels, keys are the strings left by up to d deletions, which two of edit distance d or less share.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hamming_encoded, two_bit

CODED = 31  # letters that fit a two-bit code


def hamming(a: Column, b: Column) -> Column:
    """Differing positions of two sequences of one length."""
    pairs = F.arrays_zip(F.split(a, "").alias("a"), F.split(b, "").alias("b"))
    return F.size(F.filter(pairs, lambda p: p["a"] != p["b"]))


def coded(seq: Column) -> Column:
    """The two-bit code of a sequence of A, C, G, T that has room for it, else null."""
    return F.when(seq.rlike(f"^[ACGT]{{1,{CODED}}}$"), two_bit(seq))


def coded_hamming(a: Column, code_a: Column, b: Column, code_b: Column) -> Column:
    """``hamming``, by the codes where both have one."""
    return F.when(code_a.isNotNull() & code_b.isNotNull(), hamming_encoded(code_a, code_b)).otherwise(hamming(a, b))


def pair_keys(seq: Column, length: Column, d: int) -> Column:
    """array<struct<i, n, s>>: the pairs of d + 2 segments, of which two sequences within d of another share one."""
    parts = d + 2
    cut = lambda i: F.floor(length * i / parts).cast("int")
    piece = lambda i: seq.substr(cut(i) + 1, cut(i + 1) - cut(i))
    return F.array(*[F.struct(F.lit(k).alias("i"), length.alias("n"), F.concat(piece(x), piece(y)).alias("s")) for k, (x, y) in enumerate(combinations(range(parts), 2))])


def deletions(seq: Column, d: int) -> Column:
    """A sequence and what is left of it by deleting up to d letters."""
    out = F.array(seq)
    for _ in range(d):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(s.substr(F.lit(1), i - 1), s.substr(i + 1, F.length(s))))))))
    return out


def match_whitelist(queries: DataFrame, whitelist: DataFrame, distance: int = 1, seq: str = "seq", entry: str = "entry", indels: bool = False) -> DataFrame:
    """Each distinct ``seq`` with its nearest entry within the distance (tie: the least): seq, entry, edits. Others have nulls."""
    q = queries.select(F.col(seq).alias("q")).distinct()
    w = whitelist.select(F.col(entry).alias("e")).distinct()
    exact = q.join(w, F.col("q") == F.col("e"), "left")
    rest = exact.filter("e is null").select("q")
    if indels:
        keyed = lambda d, c: d.select(c, F.explode(deletions(F.col(c), distance)).alias("k"))
        edits = F.levenshtein("q", "e")
    else:
        keyed = lambda d, c: d.select(c, coded(F.col(c)).alias(f"c{c}"), F.explode(pair_keys(F.col(c), F.length(c), distance)).alias("k"))
        edits = coded_hamming(F.col("q"), F.col("cq"), F.col("e"), F.col("ce"))
    met = keyed(rest, "q").join(keyed(w, "e"), "k").withColumn("edits", edits.cast("int")).filter(F.col("edits") <= distance)
    best = met.groupBy("q").agg(F.min(F.struct("edits", "e")).alias("b"))
    near = rest.join(best, "q", "left").select("q", F.col("b.e").alias("e"), F.col("b.edits").alias("edits"))
    out = exact.filter("e is not null").select("q", "e", F.lit(0).alias("edits")).unionByName(near)
    return out.select(F.col("q").alias(seq), F.col("e").alias(entry), F.col("edits"))


def correct(reads: DataFrame, whitelist: DataFrame, column: str, distance: int = 1, indels: bool = False) -> DataFrame:
    """``reads`` with ``corrected`` and ``edits``; the lookup runs once for each distinct sequence."""
    found = match_whitelist(reads, whitelist, distance, column, "entry", indels)
    return reads.join(found.withColumnRenamed("entry", "corrected"), column, "left")


def two_part(reads: DataFrame, first: DataFrame, second: DataFrame, column: str, ranges: list[tuple[int, int, int]], distance: int = 1, most: int = 4) -> DataFrame:
    """Barcodes of two whitelisted halves at uncertain places: seq, first, second, edits of the best reading.

    ``ranges`` are (start, middle, end) of candidate splits. Each half is looked up on its own, so the product of the
    two whitelists is never made; the best has the fewest edits (``most`` in all), then the longest span, then the least halves.
    """
    at = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in ranges]))
    cand = reads.select(F.col(column).alias("seq")).distinct().withColumn("r", at).filter(F.length("seq") >= F.col("r.c"))
    cand = cand.select("seq", (F.col("r.c") - F.col("r.a")).alias("span"), F.col("seq").substr(F.col("r.a") + 1, F.col("r.b") - F.col("r.a")).alias("x"), F.col("seq").substr(F.col("r.b") + 1, F.col("r.c") - F.col("r.b")).alias("y"))
    fx = match_whitelist(cand, first.toDF("first"), distance, "x", "first").withColumnRenamed("edits", "ex").filter("first is not null")
    fy = match_whitelist(cand, second.toDF("second"), distance, "y", "second").withColumnRenamed("edits", "ey").filter("second is not null")
    both = cand.join(fx, "x").join(fy, "y").withColumn("edits", F.col("ex") + F.col("ey")).filter(F.col("edits") <= most)
    w = Window.partitionBy("seq").orderBy("edits", F.desc("span"), "first", "second")
    return both.withColumn("k", F.row_number().over(w)).filter("k = 1").select("seq", "first", "second", "edits")
