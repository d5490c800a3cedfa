"""I-Match fingerprints: terms within a band of inverse document frequency, hashed over randomised lexicon subsets.

Terms are the distinct lower-cased words of a text, as 64-bit hashes. Document frequencies are counted by term over
all documents. The terms in the band are never held in one place: each range of ids (below) gets those that its texts
have, in ``BUCKETS`` buckets to look them up by. As a range's texts are together anyway, its distinct terms take no
shuffle of their own; they are written, and meet the lexicon by a broadcast where that is small, by its counted rows,
else by a shuffle.
A text's terms in the band are sorted; where fewer than ``FEWEST`` are, all its terms count. Each subset of the lexicon
keeps a term at random with a fixed rate (``REPEATS`` subsets at each of ``RATES``), and hashes what it keeps of the
sorted terms. The fingerprint is those hashes; the likeness of two is the share of equal ones among subsets that keep a
term of either text. Small rates compare texts that differ much, large ones tell near copies apart.

The next document (ascending id, null last; after the last the first) comes from windows over ranges of ids, each
with a copy of the next range's first row, so no task holds more than a range. Its fingerprint comes the same way, so
each text is fingerprinted once.

Null text counts as empty, with the fingerprint of no terms; equal texts have equal fingerprints; rows that repeat
an id are ordered by text, and rows that agree in both are alike in what follows them as well. Very long texts are
taken whole. Empty tables give empty results. Only the id and the text are read, so other columns' names can't clash;
columns of its own start with ``im_``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, cut, discard, let, maybe_broadcast, table

BUCKETS, FEWEST = 1 << 13, 4
#: Documents that may hold a term: at most this share, at least this share and number.
MOST_SHARE, LEAST_SHARE, LEAST_DOCS = 0.1, 1e-5, 2
RATES, REPEATS = (1, 3, 5, 7, 9), 6  # powers of 1/2


def terms(text: Column) -> Column:
    """Distinct hashes of a text's words."""
    ws = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACES, -1), "")
    return F.array_distinct(F.transform(ws, lambda w: F.xxhash64(w)))


def lexicon(df: DataFrame, text: str = "text") -> DataFrame:
    """(term): those in the band."""
    n = df.count()
    docs = df.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("docs"))
    least, most = max(LEAST_DOCS, math.ceil(LEAST_SHARE * n)), max(LEAST_DOCS, MOST_SHARE * n)
    return docs.filter((F.col("docs") >= least) & (F.col("docs") <= most)).select("term")


def bucket(term: Column) -> Column:
    return term.bitwiseAND(BUCKETS - 1).cast("int")


def used_terms(rows: DataFrame, *texts: str) -> DataFrame:
    """(im_range, b, term): the distinct terms of a range's texts and their buckets; each bucket also has a row without a term.

    ``rows`` lie by im_range, so this shuffles nothing more; the ranges' copied rows, one a range, stand for the buckets.
    """
    own = F.transform(F.array_distinct(F.flatten(F.array(*[terms(F.col(t)) for t in texts]))), lambda t: F.struct(bucket(t).alias("b"), t.alias("term")))
    none = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda i: F.struct(i.alias("b"), F.lit(None).cast("long").alias("term")))
    return rows.select("im_range", F.explode(F.when(F.col("im_copy") == 1, F.concat(own, none)).otherwise(own)).alias("u")).select("im_range", "u.b", "u.term").distinct()


def known_terms(used: DataFrame, lex: DataFrame) -> DataFrame:
    """(im_range, b, term): those of ``used`` that the lexicon has."""
    known = maybe_broadcast(lex).withColumn("im_known", F.lit(True))
    return used.join(known, "term", "left").filter("im_known or term is null").select("im_range", "b", "term")


def held_terms(known: DataFrame) -> DataFrame:
    """(im_range, im_lex): a range's terms, an array of ``BUCKETS`` arrays."""
    held = known.groupBy("im_range", "b").agg(F.collect_list("term").alias("ts")).groupBy("im_range").agg(F.sort_array(F.collect_list(F.struct("b", "ts"))).alias("held"))
    return held.select("im_range", F.col("held.ts").alias("im_lex"))


def with_lexicon(rows: DataFrame, lex: DataFrame, *texts: str) -> DataFrame:
    """``rows`` with im_lex of their range."""
    return rows.join(cut(held_terms(cut(known_terms(cut(used_terms(rows, *texts)), lex)))), "im_range", "left")


def fingerprint(text: Column, lex: Column) -> Column:
    """array<long>: a 32-bit hash for each subset, 0 where the subset keeps none of the terms."""

    def hashes(kept: Column) -> Column:
        return let(F.transform(kept, lambda t: F.xxhash64(t, F.lit(17))), lambda hs: F.array(*[subset(hs, j, a) for j in range(REPEATS) for a in RATES]))

    def subset(hs: Column, j: int, a: int) -> Column:
        mask = ((1 << a) - 1) << (10 * j)
        kept = F.filter(hs, lambda h: h.bitwiseAND(F.lit(mask).cast("long")) == 0)
        return let(kept, lambda k: F.when(F.size(k) > 0, F.xxhash64(k).bitwiseAND(0xFFFFFFFF)).otherwise(F.lit(0).cast("long")))

    def banded(all_terms: Column) -> Column:
        inside = F.filter(all_terms, lambda t: F.coalesce(F.array_contains(F.get(lex, bucket(t)), t), F.lit(False)))
        return let(inside, lambda k: F.array_sort(F.when(F.size(k) >= FEWEST, k).otherwise(all_terms)))

    return let(terms(text), lambda ts: let(banded(ts), hashes))


def likeness(a: Column, b: Column) -> Column:
    pairs = F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: (p["a"] != 0) | (p["b"] != 0))
    return let(pairs, lambda ps: F.when(F.size(ps) == 0, F.lit(1.0)).otherwise(F.size(F.filter(ps, lambda p: p["a"] == p["b"])).cast("double") / F.size(ps)))


def as_text(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def order(id: str, text: str):
    return Window.partitionBy("im_range").orderBy("im_copy", F.col(id).asc_nulls_last(), F.coalesce(F.col(text), F.lit("")))


def with_next(df: DataFrame, id: str, text: str, ranges: int | None = None, copies: bool = False) -> DataFrame:
    """(id, text, im_range, im_next): the next row's text is taken by id. With ``copies``, also the ranges' copied rows, with im_copy 1."""
    spark = df.sparkSession
    ranges = ranges or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = df.select(id).filter(F.col(id).isNotNull())
    firsts = ids.repartitionByRange(ranges, id).groupBy(F.spark_partition_id()).agg(F.min(id).alias("first")).collect()
    firsts = sorted(r["first"] for r in firsts)  # one a range
    df = df.select(id, text)
    if not firsts:  # ids are all null, or there is no row: nothing orders them but their texts
        ranged = df.withColumn("im_range", F.lit(0))
        extra = df.agg(F.min(F.coalesce(F.col(text), F.lit(""))).alias("t"), F.count(F.lit(1)).alias("n")).filter("n > 0")
        extra = extra.select(F.lit(None).cast(df.schema[id].dataType).alias(id), F.col("t").alias(text), F.lit(0).alias("im_range"))
    else:
        width = max(1, math.isqrt(len(firsts)))
        coarse, all_firsts = F.array(*[F.lit(x) for x in firsts[::width]]), F.array(*[F.lit(x) for x in firsts])

        def of(key: Column) -> Column:
            block = F.greatest(F.lit(1), F.size(F.filter(coarse, lambda x: x <= key))) - 1
            return block * width + F.size(F.filter(F.slice(all_firsts, block * width + 1, width), lambda x: x <= key)) - 1

        last = len(firsts) - 1
        ranged = df.withColumn("im_range", F.coalesce(of(F.col(id)), F.lit(last)))
        heads = df.filter(F.col(id).isin(firsts)).groupBy(id).agg(F.min(F.coalesce(F.col(text), F.lit(""))).alias(text))
        at = of(F.col(id))
        extra = heads.withColumn("im_range", F.when(at == 0, F.lit(last)).otherwise(at - 1))
    rows = ranged.withColumn("im_copy", F.lit(0)).unionByName(extra.withColumn("im_copy", F.lit(1)))
    rows = rows.withColumn(text, F.coalesce(F.col(text), F.lit(""))).withColumn("im_next", F.lead(text).over(order(id, text)))
    return rows if copies else rows.filter("im_copy = 0").drop("im_copy")


def edited(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` (with im_next) with im_text, the edited text, and im_splice, the words in it that neither text need have."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    own, after = F.col(text).substr(F.lit(1), n - half), F.coalesce("im_next", F.lit("")).substr(F.lit(1), half)
    words = F.split(after, SPACES, -1)
    splice = F.concat(F.element_at(F.split(own, SPACES, -1), -1), words[0], F.lit(" "), F.element_at(words, -1))
    return df.withColumns({"im_text": F.concat(own, after), "im_splice": splice})


def fingerprints(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, im_text, im_own, im_edited, im_after): a row's fingerprint, its edited text's, and the next row's."""
    lex = cut(lexicon(df, text))
    rows = edited(with_next(df, id, text, copies=True), text)
    used = cut(used_terms(rows, text, "im_splice"))  # each step is written, so that the one before frees its shuffle files
    known = cut(known_terms(used, lex))
    discard(lex, used)
    held = cut(held_terms(known))
    discard(known)
    rows = rows.drop("im_splice", "im_next").join(held, "im_range", "left")
    rows = rows.withColumns({"im_own": fingerprint(F.col(text), F.col("im_lex")), "im_edited": F.when(F.col("im_copy") == 0, fingerprint(F.col("im_text"), F.col("im_lex")))}).drop("im_lex")
    return rows.withColumn("im_after", F.lead("im_own").over(order(id, text))).filter("im_copy = 0").select(id, text, "im_text", "im_own", "im_edited", "im_after")


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("im_text").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("im_own")).alias("fingerprint"), as_text(F.col("im_edited")).alias("edited_fingerprint"),
        likeness(F.col("im_own"), F.col("im_edited")).alias("near_edited"), likeness(F.col("im_own"), F.col("im_after")).alias("near_next"),
    )


QUERIES = {"op3_imatch": op3_imatch}
ORACLES: dict[str, str] = {}
