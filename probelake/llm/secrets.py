"""Secret scan: fixed patterns, and a randomness test battery on other strings.

Base spans come from three patterns, leftmost and non-overlapping each. The battery looks at every run of 20 or more
encoding characters that no base span touches. Its encoding (hex, base32, base36, base64) is inferred from the
characters; then

- chi-squared uniformity over that alphabet gives the collision rate, and from it the p-value of a rate as low under
  text-like use of the alphabet (``TEXT_RATE``): low for random strings, the lower the longer they are;
- a runs test about the alphabet's middle and a lag-1 serial correlation test must not reject randomness.

Over all strings of an encoding and length band, a Benjamini-Hochberg step on a fixed grid of p-values sets the
band's threshold (false-discovery rate ``FDR``), so only a bounded table of counts reaches the driver. What passes is
reported as kind ``random``.

Null text counts as empty; it and clean texts have no spans. Repeated rows are scanned each; very long texts are scanned
whole. Spans that start together are ordered by kind; a p-value that equals a threshold passes. Empty tables give
empty results. Positions are code points from 0, ends exclusive. Other columns pass through; names that start with
``sc_`` are its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, let, table

# The patterns of the base spans and the length that each match needs.
ASSIGN_HEAD = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]"""
ASSIGN = ASSIGN_HEAD + r"""\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
MIN_ASSIGN, MIN_ACCESS = 6, 20

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: Alphabet, size and collision rate of text-like strings, by encoding.
LOW, UP, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = ("hex", "base32", "base36", "base64")
ALPHABET = {"hex": DIGITS + "abcdef", "base32": UP + "234567", "base36": DIGITS + LOW, "base64": UP + LOW + DIGITS + "+/_-"}
TEXT_RATE = {"hex": 0.13, "base32": 0.07, "base36": 0.065, "base64": 0.05}
BANDS = (28, 40, 64)
FDR, ACCEPT, GRID, DEEPEST = 0.05, 0.005, 10, 110  # the grid ends beyond the least p-value that _phi gives
FOLD = 256

SPAN = "array<struct<start:int,kind:int,end:int>>"
CUTS = "array<struct<start:int,kind:int,before:int,until:int>>"


def _located(text: Column, pattern: str, kind: int, passes=None, group2: bool = False) -> Column:
    """Spans of a pattern's matches, from the lengths of the matches and of the gaps between them."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    checked = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if group2 else found
    rows = F.arrays_zip(F.transform(gaps, lambda g: F.length(g)).alias("g"), F.transform(found, lambda m: F.length(m)).alias("m"), F.transform(checked, lambda m: F.length(m)).alias("c"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(s: Column, x: Column) -> Column:
        a = s["at"] + x["g"]
        b = a + F.coalesce(x["m"], F.lit(0))
        keep = x["m"].isNotNull() & (passes(x["c"]) if passes else F.lit(True))
        span = F.array(F.struct(a.alias("start"), F.lit(kind).alias("kind"), b.alias("end"))).cast(SPAN)
        return F.struct(b.alias("at"), F.when(keep, F.concat(s["out"], span)).otherwise(s["out"]).alias("out"))

    def shifted(s: Column, part: Column) -> Column:
        moved = F.transform(part["out"], lambda x: F.struct((x["start"] + s["at"]).alias("start"), x["kind"].alias("kind"), (x["end"] + s["at"]).alias("end"))).cast(SPAN)
        return F.struct((s["at"] + part["at"]).alias("at"), F.concat(s["out"], moved).alias("out"))

    return F.aggregate(_parts(rows, start, step), start, shifted, lambda s: s["out"])


def _parts(rows: Column, start: Column, step) -> Column:
    """Folds of each FOLD rows: arrays that grow by one are copied within a fold only, so many matches of a long text don't cost their square."""
    return let(rows, lambda xs: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(xs) - 1), F.lit(FOLD)), lambda i: F.aggregate(F.slice(xs, i + 1, FOLD), start, step)))


def base_spans(text: Column) -> Column:
    none = F.array().cast(SPAN)
    found = F.concat(
        F.when(text.rlike(ASSIGN_HEAD), _located(text, ASSIGN, 0, lambda n: n >= MIN_ASSIGN, True)).otherwise(none),
        F.when(text.contains("AKIA"), _located(text, ACCESS, 1, lambda n: n >= MIN_ACCESS)).otherwise(none),
        F.when(text.rlike(HEX), _located(text, HEX, 2)).otherwise(none),
    )
    return F.array_sort(found)


def _phi(z: Column) -> Column:
    """The normal distribution function, by a logistic in z and its cube (error below 2e-4)."""
    z = F.greatest(F.lit(-6.0), F.least(F.lit(6.0), z))
    return 1 / (1 + F.exp(-1.5976 * z - 0.07056 * z * z * z))


def _encoding(s: Column) -> Column:
    digit, low, up = s.rlike("[0-9]"), s.rlike("[a-z]"), s.rlike("[A-Z]")
    return (
        F.when(digit & s.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") & (low | up), 0)
        .when(digit & up & s.rlike("^[A-Z2-7]+$"), 1)
        .when(digit & (low != up) & s.rlike("^(?:[0-9a-z]+|[0-9A-Z]+)$"), 2)
        .when(digit & low & up, 3)
    )


def _tested(s: Column) -> Column:
    """struct(stratum, grid): null where no encoding fits or randomness is rejected on order."""

    def with_encoding(e: Column) -> Column:
        alphabet = F.element_at(F.array(*[F.lit(ALPHABET[x]) for x in ENCODINGS]), e + 1)
        rate = F.element_at(F.array(*[F.lit(TEXT_RATE[x]) for x in ENCODINGS]), e + 1)
        folded = F.when(e == 1, F.upper(s)).when(e == 3, s).otherwise(F.lower(s))
        size = F.length(alphabet).cast("double")

        def of(codes: Column) -> Column:
            n = F.size(codes).cast("double")
            counts = F.transform(F.array_distinct(codes), lambda c: F.size(F.filter(codes, lambda x: x == c)).cast("double"))
            squares = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c)
            chi2 = size / n * squares - n
            collisions = (chi2 + n - size) / (size * (n - 1))  # the unbiased collision rate, from chi-squared
            sd = F.sqrt(2 * rate * (1 - rate) / (n * (n - 1)) + 0.2 * rate * rate / n)
            p_uniform = _phi((collisions - rate) / sd)
            above = F.aggregate(codes, F.lit(0.0), lambda a, c: a + F.when(c * 2 >= size, 1.0).otherwise(0.0))
            below = n - above
            pairs = F.arrays_zip(F.slice(codes, 1, F.size(codes) - 1).alias("a"), F.slice(codes, 2, F.size(codes)).alias("b"))
            runs = F.aggregate(pairs, F.lit(1.0), lambda t, p: t + F.when((p["a"] * 2 >= size) != (p["b"] * 2 >= size), 1.0).otherwise(0.0))
            expected = 2 * above * below / n + 1
            variance = F.greatest(F.lit(1e-9), (expected - 1) * (expected - 2) / (n - 1))
            mean = F.aggregate(codes, F.lit(0.0), lambda a, c: a + c) / n
            spread = F.greatest(F.lit(1e-9), F.aggregate(codes, F.lit(0.0), lambda a, c: a + (c - mean) * (c - mean)))
            serial = F.aggregate(pairs, F.lit(0.0), lambda t, p: t + (p["a"] - mean) * (p["b"] - mean)) / spread
            order = F.least(2 * _phi(-F.abs((runs - expected) / F.sqrt(variance))), 2 * _phi(-F.abs((serial + 1 / n) * F.sqrt(n))))
            p = F.when(order < ACCEPT, F.lit(1.0)).otherwise(p_uniform)
            grid = F.least(F.lit(DEEPEST), F.floor(-F.log10(p) * GRID).cast("int"))
            band = sum(((n >= b).cast("int") for b in BANDS), F.lit(0))
            return F.struct((e * (len(BANDS) + 1) + band).alias("stratum"), grid.alias("grid"))

        codes = F.transform(F.split(folded, ""), lambda c: (F.position(c, alphabet) - 1).cast("double"))
        return let(codes, of)

    return let(_encoding(s), lambda e: F.when(e.isNotNull(), with_encoding(e)))


def candidates(text: Column, base: Column) -> Column:
    """array<struct<start, end, stratum, grid>> of tested strings that no base span touches."""
    found = let(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), lambda ms: F.arrays_zip(ms.alias("s"), _located(text, CANDIDATE, 3).alias("p")))
    apart = F.filter(found, lambda x: ~F.exists(base, lambda b: (b["start"] < x["p"]["end"]) & (x["p"]["start"] < b["end"])))
    tested = F.transform(apart, lambda x: F.struct(x["p"]["start"].alias("start"), x["p"]["end"].alias("end"), _tested(x["s"]).alias("t")))
    kept = F.filter(tested, lambda x: x["t"].isNotNull())
    out = "array<struct<start:int,end:int,stratum:int,grid:int>>"
    flat = F.transform(kept, lambda x: F.struct(x["start"], x["end"], x["t"]["stratum"], x["t"]["grid"])).cast(out)
    return F.when(text.rlike(CANDIDATE), flat).otherwise(F.array().cast(out))


def thresholds(found: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """The least grid value that a stratum reports, from counts of at most strata x grid rows."""
    counts: dict[int, dict[int, int]] = {}
    for r in found.select(F.explode("sc_tested").alias("c")).groupBy("c.stratum", "c.grid").count().collect():
        counts.setdefault(r["stratum"], {})[r["grid"]] = r["count"]
    out = {}
    for stratum, grid in counts.items():
        total, above = sum(grid.values()), 0
        for g in sorted(grid, reverse=True):
            above += grid[g]
            if 10 ** (-g / GRID) <= fdr * above / total:
                out[stratum] = g
    return out


def scan(df: DataFrame, text: str = "text", keep: list[str] | None = None, fdr: float = FDR) -> DataFrame:
    """The columns ``keep`` (all, by default) with sc_base and sc_spans: sorted arrays of (start, kind, end)."""
    keep = df.columns if keep is None else keep
    t = F.coalesce(F.col(text), F.lit(""))
    found = df.withColumn("sc_base", base_spans(t))
    found = cut(found.withColumn("sc_tested", candidates(t, F.col("sc_base"))).select(*keep, "sc_base", "sc_tested"))
    least = thresholds(found, fdr)
    if not least:
        return found.withColumn("sc_spans", F.col("sc_base")).drop("sc_tested")
    limit = F.create_map(*[F.lit(x) for pair in least.items() for x in pair])
    passed = F.filter("sc_tested", lambda c: c["grid"] >= F.coalesce(limit[c["stratum"]], F.lit(1 << 30)))
    spans = F.transform(passed, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end"))).cast(SPAN)
    return found.withColumn("sc_spans", F.array_sort(F.concat("sc_base", spans))).drop("sc_tested")


def digest(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(scanned: DataFrame, text: str = "text") -> DataFrame:
    """``text`` with every span replaced by its kind in brackets; sc_ columns go."""
    t = F.col(text)
    name = F.array(*[F.lit(f"[{k}]") for k in KINDS])

    start = F.struct(F.lit(0).alias("at"), F.array().cast(CUTS).alias("out"))

    def step(s: Column, x: Column) -> Column:
        until = F.greatest(s["at"], x["end"])
        cut_ = F.array(F.struct(x["start"].alias("start"), x["kind"].alias("kind"), s["at"].alias("before"), until.alias("until"))).cast(CUTS)
        return F.struct(until.alias("at"), F.concat(s["out"], cut_).alias("out"))

    def joined(s: Column, part: Column) -> Column:
        at = s["at"]
        moved = F.transform(part["out"], lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), F.greatest(at, x["before"]).alias("before"), F.greatest(at, x["until"]).alias("until"))).cast(CUTS)
        return F.struct(F.greatest(at, part["at"]).alias("at"), F.concat(s["out"], moved).alias("out"))

    def piece(x: Column) -> Column:
        between = F.when(x["start"] > x["before"], t.substr(x["before"] + 1, x["start"] - x["before"])).otherwise(F.lit(""))
        return F.concat(between, F.when(x["start"] >= x["before"], F.element_at(name, x["kind"] + 1)).otherwise(F.lit("")))

    cuts = F.aggregate(_parts(F.col("sc_spans"), start, step), start, joined)
    cleaned = let(cuts, lambda c: F.concat(F.array_join(F.transform(c["out"], piece), ""), t.substr(c["at"] + 1, F.length(t))))
    return scanned.withColumn(text, F.when(F.size("sc_spans") > 0, cleaned).otherwise(t)).drop("sc_base", "sc_spans")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    count = lambda k: F.size(F.filter("sc_base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(digest(F.col("sc_base")), 256).alias("base_sha256"), digest(F.col("sc_spans")).alias("spans"),
    )


QUERIES = {"op1_secret_scan": op1_secret_scan}
ORACLES: dict[str, str] = {}
