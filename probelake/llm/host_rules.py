"""Quality rules at host level: rule failures by host, shrunk with an empirical beta prior, joined back to documents.

A document's own rules give ``base_failed``. All rules (the base ones and softer ones on symbols, repeated lines
and word length) give ``any_failed``, whose rate by host is shrunk towards the corpus with a beta prior fitted by
moments over hosts. A host whose shrunk rate reaches ``host_limit`` is bad. A document is rejected if its base
rules fail, or if its host is bad and it fails any rule itself; a document without failures is always kept.

Null text counts as empty; a null host is a host of its own. Empty tables give empty results. Repeated rows count
each; very long texts are measured whole; a rate that equals the limit is bad. Other columns pass through
``apply_rules`` untouched, but for names that start with ``hr_``, which are its own and refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, let, maybe_broadcast, table, words

#: Rule thresholds; shares are exact integer comparisons.
MIN_WORDS, MAX_REPEAT_PERCENT, MAX_SYMBOL_PERCENT, MAX_DUP_LINE_PERCENT = 20, 30, 10, 30
WORD_LENGTH = (3, 10)
WINDOW = 8
#: The shrunk rate from which a host isn't trusted: a tenth of its documents fail some rule.
HOST_LIMIT = 0.1


def repeat_words(ws: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window (a power of two) found twice or more in the array, the first included."""

    def covered(hashes: Column) -> Column:
        def of(ordered: Column) -> Column:
            def same(x: Column, j: Column) -> Column:
                return F.coalesce(F.get(ordered, j)["h"] == x["h"], F.lit(False))

            twice = F.filter(ordered, lambda x, i: same(x, i - 1) | same(x, i + 1))
            return let(
                F.array_sort(F.transform(twice, lambda x: x["i"])),
                lambda at: F.aggregate(
                    at,
                    F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last")),
                    lambda s, p: F.struct((s["n"] + F.least(F.lit(window), p - s["last"])).alias("n"), p.alias("last")),
                    lambda s: s["n"],
                ),
            )

        plain = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(plain, F.lit(0).cast("long")).otherwise(
            let(F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), of)
        )

    def paired(h: Column, step: int) -> Column:
        """Hashes of twice the width, from those of ``step`` words: each with the one ``step`` further on."""
        return let(h, lambda a: F.zip_with(F.slice(a, 1, F.size(a) - step), F.slice(a, step + 1, F.size(a)), lambda x, y: F.xxhash64(x, y)))

    hashes, width = F.transform(ws, lambda w: F.xxhash64(w)), 1
    while width < window:
        hashes, width = paired(hashes, width), 2 * width
    return F.when(F.size(ws) < window + 1, F.lit(0).cast("long")).otherwise(let(hashes, covered))


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with hr_n_words, hr_word_chars, hr_n_symbols, hr_n_lines, hr_n_dup_lines, hr_n_repeat_words (long)."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^ \t-\r]"))
    out = df.withColumns({"hr_words": words(F.col(text)), "hr_lines": lines})
    return out.withColumns(
        {
            "hr_n_words": F.size("hr_words").cast("long"),
            "hr_word_chars": F.length(F.array_join("hr_words", "")).cast("long"),
            "hr_n_symbols": (F.size(F.split(t, r"[#*$%&|<>]", -1)) - 1).cast("long"),
            "hr_n_lines": F.size("hr_lines").cast("long"),
            "hr_n_dup_lines": (F.size("hr_lines") - F.size(F.array_distinct("hr_lines"))).cast("long"),
            "hr_n_repeat_words": repeat_words(F.col("hr_words")),
        }
    ).drop("hr_words", "hr_lines")


def with_failures(df: DataFrame) -> DataFrame:
    n, repeat = F.col("hr_n_words"), F.col("hr_n_repeat_words")
    base = (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n)
    soft = (
        (100 * F.col("hr_n_symbols") > MAX_SYMBOL_PERCENT * n)
        | (100 * F.col("hr_n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("hr_n_lines"))
        | (F.col("hr_word_chars") < WORD_LENGTH[0] * n)
        | (F.col("hr_word_chars") > WORD_LENGTH[1] * n)
    )
    return df.withColumn("hr_base_failed", base).withColumn("hr_any_failed", base | soft)


def host_verdicts(df: DataFrame, host: str, host_limit: float = HOST_LIMIT) -> DataFrame:
    """A row for each host: hr_host, hr_docs, hr_failed, hr_rate (shrunk), hr_bad. ``df`` has hr_any_failed."""
    hosts = df.groupBy(F.col(host).alias("hr_host")).agg(
        F.count(F.lit(1)).alias("hr_docs"), F.sum(F.col("hr_any_failed").cast("long")).alias("hr_failed")
    )
    # Moments of the rates over hosts, the sampling part of their variance taken off: one row, whatever the hosts.
    rate = F.col("hr_failed") / F.col("hr_docs")
    m = hosts.agg(
        F.sum("hr_failed").alias("f"), F.sum("hr_docs").alias("d"), F.count(F.lit(1)).alias("k"),
        F.var_pop(rate).alias("v"), F.avg(1 / F.col("hr_docs")).alias("inv"),
    ).first()
    mean = m["f"] / m["d"] if m["d"] else 0.5
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    spread = mean * (1 - mean)
    between = max((m["v"] or 0.0) - spread * (m["inv"] or 0.0), spread * 1e-3)
    strength = max(spread / between - 1, 1.0)
    shrunk = (F.col("hr_failed") + mean * strength) / (F.col("hr_docs") + strength)
    return hosts.withColumn("hr_rate", shrunk).withColumn("hr_bad", F.col("hr_rate") >= host_limit)


def apply_rules(df: DataFrame, text: str = "text", host: str = "source", host_limit: float = HOST_LIMIT, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, by default) with the measures, hr_base_failed, hr_any_failed, hr_rate and hr_kept.

    A row for each row. The measures are written to the shared folder once, as hosts and verdicts both need them.
    """
    keep = df.columns if keep is None else keep
    if own := [c for c in df.columns if c.startswith("hr_")]:
        raise ValueError(f"columns {own}: names that start with hr_ are taken")
    judged = with_failures(measures(df, text)).withColumn("hr_of", F.col(host))
    judged = cut(judged.select(*keep, *[c for c in judged.columns if c.startswith("hr_")]))
    verdicts = cut(host_verdicts(judged, "hr_of", host_limit).select("hr_host", "hr_rate", "hr_bad"))  # a row for each host
    out = judged.join(maybe_broadcast(verdicts), F.col("hr_of").eqNullSafe(F.col("hr_host")), "left").drop("hr_host", "hr_of")
    return out.withColumn("hr_kept", ~F.col("hr_base_failed") & ~(F.col("hr_bad") & F.col("hr_any_failed")))


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    judged = apply_rules(docs, keep=["doc_id"])
    return judged.select(
        "doc_id",
        *[F.col(f"hr_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")],
    )


QUERIES = {"op9_host_rules": op9_host_rules}
ORACLES = {
    "op9_host_rules": r"""with w as (select doc_id, source, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
win as (select doc_id, i, md5(array_to_string(ws[i:i + 7], ' ')) s from (select doc_id, ws, unnest(range(1, len(ws) - 6)) i from w)),
rep as (select doc_id, count(distinct p) r from (select doc_id, unnest(range(i, i + 8)) p from (select *, count(*) over (partition by doc_id, s) k from win) where k > 1) group by 1),
m as (select w.doc_id, source, cast(len(ws) as bigint) n_words, cast(length(array_to_string(ws, '')) as bigint) word_chars, cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) n_symbols,
 [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] ls, coalesce(r, 0) n_repeat_words from w left join rep using (doc_id)),
f as (select *, cast(len(ls) - len(list_distinct(ls)) as bigint) n_dup_lines, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed from m),
g as (select *, base_failed or 100 * n_symbols > 10 * n_words or 100 * n_dup_lines > 30 * len(ls) or word_chars < 3 * n_words or word_chars > 10 * n_words any_failed from f),
h as (select source, count(*) d, count(*) filter (any_failed) x from g group by 1),
p as (select greatest(1e-6, least(1 - 1e-6, sum(x) / sum(d))) mean, var_pop(x / d) v, avg(1 / d) inv from h),
q as (select mean, greatest(mean * (1 - mean) / greatest(v - mean * (1 - mean) * inv, mean * (1 - mean) * 1e-3) - 1, 1) strength from p),
bad as (select source, (x + mean * strength) / (d + strength) >= 0.1 b from h, q)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not (b and any_failed) kept from g join bad on g.source is not distinct from bad.source"""
}
