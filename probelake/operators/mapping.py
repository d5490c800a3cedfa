"""Read pairs to mapped reads.

R2 is ``left arm | gapfill | right arm | constant sequence | sample barcode``. Parsing is one Arrow pass over the reads
(fuzzy substring search has no column expression): arms are found by exact segments first, so a read is compared with
few of them, and what was parsed lately is remembered. The pass needs the two columns of arms, not their pairs, which
are joined afterwards. Whitelist corrections of cell and sample barcodes are joins (``fuzzy``). A read's ``states`` tell
what was corrected and why it was rejected.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import reverse_complement
from ..tech import Technology, technology
from .fuzzy import correct, two_part

# The states of a read.
STATES = (
    "EXACT", "CORRECTED_BARCODE", "CORRECTED_LHS", "CORRECTED_RHS", "CORRECTED_PROBE_BARCODE", "FILTERED_NO_CONSTANT", "FILTERED_NO_LHS", "FILTERED_NO_RHS",
    "FILTERED_NO_PROBE_BARCODE", "FILTERED_INCORRECT_PROBE_BARCODE", "FILTERED_NO_CELL_BARCODE",
)
REMEMBERED = 100_000  # parsed reads that a task keeps, at most
SMALL = 100_000  # rows of a panel that are broadcast


def budget(length: int, per10: float) -> int:
    """Edits allowed in a part of R2: one for every ten full bases, times ``per10``, at least 1."""
    return max(1, int(length * per10 // 10))


def barcode_budget(length: int, per10: float) -> int:
    """Edits allowed in a cell barcode: one for every ten bases begun, times ``per10``, at least 1."""
    return max(1, -int(-(-(-length // 10) * per10) // 1))


def distance(a: str, b: str, most: int) -> int:
    """Hamming distance, or most + 1 if it is more or lengths differ."""
    if len(a) != len(b):
        return most + 1
    n = 0
    for x, y in zip(a, b):
        n += x != y
        if n > most:
            return n
    return n


def segments(pattern: str, most: int) -> list[tuple[int, str]]:
    """most + 1 pieces of a pattern and where they start: a match with ``most`` edits has one of them unchanged."""
    n, k = len(pattern), most + 1
    ends = [n * i // k for i in range(k + 1)]
    return [(a, pattern[a:b]) for a, b in zip(ends, ends[1:])]


def find(text: str, pattern: str, most: int, start: int = 0) -> tuple[int, int]:
    """(position, edits) of the best match by substitutions, leftmost first; (-1, 0) without any."""
    at = text.find(pattern, start)
    if at >= 0:
        return at, 0
    places = set()
    for offset, piece in segments(pattern, most):
        i = text.find(piece, start + offset)
        while i >= 0:
            places.add(i - offset)
            i = text.find(piece, i + 1)
    best = (most + 1, -1)
    for i in sorted(places):
        d = distance(text[i : i + len(pattern)], pattern, best[0] - 1)
        if d < best[0]:
            best = (d, i)
    return (best[1], best[0]) if best[1] >= 0 else (-1, 0)


def find_edits(text: str, pattern: str, most: int, start: int = 0) -> tuple[int, int, int]:
    """(start, end, edits) of the best match with insertions and deletions; ties: leftmost end, then the longest span."""
    row = [(i, start) for i in range(len(pattern) + 1)]  # (edits, where the match begins), by letters of the pattern
    best = (most + 1, -1, -1)
    if row[-1][0] <= most:
        best = (row[-1][0], start, start)
    for j in range(start, len(text)):
        new = [(0, j + 1)]
        for i, c in enumerate(pattern, 1):
            step = (row[i - 1][0] + (c != text[j]), row[i - 1][1])
            new.append(min(step, (row[i][0] + 1, row[i][1]), (new[i - 1][0] + 1, new[i - 1][1])))
        row = new
        if row[-1][0] < best[0]:
            best = (row[-1][0], row[-1][1], j + 1)
    return (best[1], best[2], best[0]) if best[1] >= 0 else (-1, -1, 0)


def edits_of_prefix(text: str, pattern: str, most: int) -> int:
    """Edits between a pattern and the prefix of ``text`` that is nearest to it, or most + 1."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for j, c in enumerate(text[: len(pattern) + most], 1):
        new = [j]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i - 1] + (p != c), row[i] + 1, new[i - 1] + 1))
        row = new
        best = min(best, row[-1])
    return min(best, most + 1)


class Arms:
    """One side's arms, looked up by exact text, by segments, or by how a cut one begins."""

    def __init__(self, arms: list[str], per10: float, indels: bool):
        self.arms, self.per10, self.indels = sorted(set(arms)), per10, indels
        self.known = set(self.arms)
        self.lengths = sorted({len(x) for x in self.arms}, reverse=True)
        self.least = min(self.lengths, default=0)
        self.by_segment: dict[tuple[int, int, str], list[str]] = {}
        for x in self.arms:
            for at, piece in segments(x, budget(len(x), per10)):
                self.by_segment.setdefault((len(x), at, piece), []).append(x)
        self.cuts = {n: [at for at, _ in segments("x" * n, budget(n, per10))] for n in self.lengths}

    def candidates(self, text: str, n: int, anywhere: int = 0) -> set[str]:
        """Arms of length n with a segment in place in ``text``, give or take ``anywhere`` places."""
        out: set[str] = set()
        ends = [*self.cuts[n][1:], n]
        for at, end in zip(self.cuts[n], ends):
            for shift in range(-anywhere, anywhere + 1):
                if at + shift >= 0:
                    out.update(self.by_segment.get((n, at, text[at + shift : end + shift]), ()))
        return out

    def prefix(self, read: str) -> tuple[str | None, int, bool]:
        """(arm, where it ends, corrected) at the start: longest arms first, exact before fuzzy, least edits then the least arm."""
        for n in self.lengths:
            if read[:n] in self.known:
                return read[:n], n, False
        for n in self.lengths:
            most = budget(n, self.per10)
            near = [(d, x) for x in self.candidates(read, n) if (d := distance(read[:n], x, most)) <= most]
            if not near and self.indels:
                near = [(d, x) for x in self.candidates(read, n, most) if (d := edits_of_prefix(read, x, most)) <= most]
            if near:
                return min(near)[1], n, True
        return None, 0, False

    def first(self, read: str) -> tuple[str | None, int, bool]:
        """As ``prefix``, but wherever an arm lies in the read."""
        near = []
        for x in self.arms:
            at, d = find(read, x, budget(len(x), self.per10))
            if at >= 0:
                near.append((d, at, x))
        if not near:
            return None, 0, False
        d, at, x = min(near)
        return x, at + len(x), d > 0

    def within(self, text: str, among: set[str] | None) -> tuple[str, int, int] | None:
        """(arm, where it starts, edits) of the best of ``among`` (None: all) in ``text``; one cut short by its end counts as corrected."""
        best: tuple | None = None
        if len(text) < self.least:
            for x in self.arms if among is None else sorted(among):
                half = -(-len(x) // 2)
                at = next((i for i in range(0, len(text) - half + 1) if x.startswith(text[i:])), -1)
                if at >= 0 and (best is None or (at, x) < best[:2]):
                    best = (at, x)
            return (best[1], best[0], 1) if best else None
        for x in self.arms if among is None else sorted(among):
            most = budget(len(x), self.per10)
            at, d = find(text, x, most)
            if at < 0 and self.indels:
                at, _, d = find_edits(text, x, most)
            if at >= 0 and (best is None or (d, at, x) < best):
                best = (d, at, x)
        return (best[2], best[1], best[0]) if best else None


class Parser:
    """Places the parts of R2. ``pairs``: the right arms that go with a left one; None where all do."""

    def __init__(self, left: list[str], right: list[str], pairs: dict[str, set[str]] | None, tech: Technology, per10: float, skip_constant: bool, flexible: bool, indels: bool = False):
        self.tech, self.per10, self.skip, self.flexible, self.indels, self.pairs = tech, per10, skip_constant, flexible, indels, pairs
        self.left, self.right = Arms(left, per10, indels), Arms(right, per10, indels)
        self.met: dict[str, tuple] = {}

    def parse(self, read: str) -> tuple:
        """(left arm, right arm, gapfill, start, end, sample barcode, states)."""
        found = self.met.get(read)
        if found is None:
            if len(self.met) >= REMEMBERED:
                self.met.clear()
            found = self.met[read] = self._parse(read)
        return found

    def _parse(self, read: str) -> tuple:
        states: list[str] = []
        arm, start, fixed = self.left.prefix(read)
        if arm is None and self.flexible:
            arm, start, fixed = self.left.first(read)
        if arm is None:
            return None, None, None, None, None, None, ["FILTERED_NO_LHS"]
        states += ["CORRECTED_LHS"] * fixed
        end, sample = len(read), None
        if self.tech.constant:
            constant, first = self.tech.constant, start + self.right.least
            most = budget(len(constant), self.per10)
            at, _ = find(read, constant, most, first)
            stop = at + len(constant)
            if at < 0 and self.indels:
                at, stop, _ = find_edits(read, constant, most, first)
            if at < 0:  # a constant cut short by the read's end
                half = -(-len(constant) // 2)
                at = next((i for i in range(max(0, first), len(read) - half + 1) if constant.startswith(read[i:])), -1)
                stop = at + len(constant)
            if at < 0 and not self.skip:
                return None, None, None, None, None, None, [*states, "FILTERED_NO_CONSTANT"]
            if at >= 0:
                end = at
                if self.tech.sample_length and not self.tech.sample_on_r1:
                    sample = read[stop + self.tech.sample_offset :][: self.tech.sample_length]
        rest = read[start:end]
        best = self.right.within(rest, self.pairs.get(arm, set()) if self.pairs is not None else None)
        if best is None:
            return None, None, None, None, None, sample, [*states, "FILTERED_NO_RHS"]
        right, at, d = best
        states += ["CORRECTED_RHS"] * (d > 0)
        return arm, right, rest[:at], start, start + at, sample, states


def parse_probes(reads: DataFrame, manifest: DataFrame, tech: str | Technology = "Flex", per10: float = 1, skip_constant: bool = False, flexible: bool = False, indels: bool = False) -> DataFrame:
    """``reads`` (with r2) and probe_idx, gapfill, gap_start, gap_end, sample_seq, states: one pass, without a shuffle of reads.

    The driver holds a panel's arms, and its defined pairs; of a panel with decoys, whose pairs are all that its arms
    make, only the arms. Of several probes with the same arms the least index is taken.
    """
    tech = technology(tech)
    defined = manifest.filter("was_defined") if "was_defined" in manifest.columns else manifest
    decoys = "was_defined" in manifest.columns and bool(manifest.filter("not was_defined").limit(1).count())
    arms = defined.select("lhs_probe", "rhs_probe").distinct().collect()  # a panel: a dimension
    left, right = [r["lhs_probe"] for r in arms], [r["rhs_probe"] for r in arms]
    pairs: dict[str, set[str]] | None = None
    if not decoys:
        pairs = {}
        for a, b in zip(left, right):
            pairs.setdefault(a, set()).add(b)
    kept = [f for f in reads.schema.fields]
    names = ["mp_left", "mp_right", "gapfill", "gap_start", "gap_end", "sample_seq", "states"]
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string())]
    place = reads.columns.index("r2")

    def run(batches):
        parser = Parser(left, right, pairs, tech, per10, skip_constant, flexible, indels)
        for batch in batches:
            rows = [parser.parse(s or "") for s in batch.column(place).to_pylist()]
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, t) for c, t in zip(cols, types)]], names=[*batch.schema.names, *names])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "mp_left string, mp_right string, gapfill string, gap_start int, gap_end int, sample_seq string, states array<string>"])
    parsed = reads.mapInArrow(run, schema)
    probes = manifest.groupBy(F.col("lhs_probe").alias("mp_left"), F.col("rhs_probe").alias("mp_right")).agg(F.min("index").alias("probe_idx"))
    probes = F.broadcast(probes) if manifest.count() <= SMALL else probes
    return parsed.join(probes, ["mp_left", "mp_right"], "left").drop("mp_left", "mp_right")


def correct_sample(reads: DataFrame, samples: DataFrame, tech: Technology, per10: float) -> DataFrame:
    """``reads`` with probe_barcode and sample_edits: fuzzy by the whole barcode, else, where the read ends within it, by at least half of one."""
    n = tech.sample_length
    out = correct(reads, samples, "sample_seq", budget(n, per10)).withColumnsRenamed({"corrected": "probe_barcode", "edits": "sample_edits"})
    cut = F.explode(F.sequence(F.lit(-(-n // 2)), F.lit(max(-(-n // 2), n - 1))))
    starts = samples.select("entry", cut.alias("size")).groupBy(F.col("entry").substr(F.lit(1), F.col("size")).alias("cut_seq")).agg(F.min("entry").alias("cut_entry"))
    out = out.join(F.broadcast(starts), F.col("sample_seq") == F.col("cut_seq"), "left")  # a few starts for each sample's barcode
    short = F.col("probe_barcode").isNull() & (F.length("sample_seq") < n)
    return out.withColumns({"probe_barcode": F.when(short, F.col("cut_entry")).otherwise(F.col("probe_barcode")), "sample_edits": F.when(short & F.col("cut_entry").isNotNull(), 1).otherwise(F.col("sample_edits"))}).drop("cut_seq", "cut_entry")


def correct_two_part(reads: DataFrame, tech: Technology, cells: DataFrame, column: str = "cell_seq") -> DataFrame:
    """``reads`` with cell_barcode and cell_edits, of two whitelisted halves; ``cells`` is (first, second), either null."""
    first, second = cells.filter("first is not null").select("first").distinct(), cells.filter("second is not null").select("second").distinct()
    found = two_part(reads, first, second, column, tech.pairing_ranges(), tech.half_edits)
    found = found.select(F.col("seq").alias(column), F.concat("first", "second").alias("cell_barcode"), F.col("edits").alias("cell_edits"))
    return reads.join(found, column, "left")


def map_reads(
    reads: DataFrame, manifest: DataFrame, cells: DataFrame, tech: str | Technology = "Flex", samples: DataFrame | None = None, per10: float = 1,
    skip_constant: bool = False, flexible: bool = False, indels: bool = False, r1_length: int | None = None, r2_length: int | None = None,
    allowed: list[str] | None = None, correct_cells: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Every read with probe, gapfill and its quality, corrected cell and sample barcode, identifier, and states.

    ``reads`` is (read_id, r1, r2, q1, q2), cut to the given lengths first; ``cells`` is (entry), or (first, second) for
    a technology of two-part barcodes; ``samples`` is (entry), of which only ``allowed`` pass if given. A function of
    (reads with cell_seq, cells) that adds cell_barcode and cell_edits may stand in for the correction of cell barcodes.
    Reads that fail keep their states and have no probe_idx.
    """
    tech = technology(tech)
    for n, columns in ((r1_length, ("r1", "q1")), (r2_length, ("r2", "q2"))):
        if n:
            reads = reads.withColumns({c: F.col(c).substr(1, n) for c in columns})
    out = parse_probes(reads, manifest, tech, per10, skip_constant, flexible, indels)
    part = lambda c, a, n: F.col(c).substr(a + 1, n)
    out = out.withColumns({"umi": part("r1", tech.umi_start, tech.umi_length), "umi_quality": part("q1", tech.umi_start, tech.umi_length), "cell_seq": part("r1", tech.cell_start, tech.cell_length)})
    out = out.withColumn("gapfill_quality", F.col("q2").substr(F.col("gap_start") + 1, F.col("gap_end") - F.col("gap_start")))
    if tech.sample_on_r1:
        out = out.withColumn("sample_seq", reverse_complement(F.expr(f"right(r1, {tech.sample_length})")))
    if correct_cells is not None:
        out = correct_cells(out, cells)
    elif tech.two_part:
        out = correct_two_part(out, tech, cells)
    else:
        edits = barcode_budget(tech.cell_length, per10)
        out = correct(out, cells, "cell_seq", edits, indels).withColumnsRenamed({"corrected": "cell_barcode", "edits": "cell_edits"})
    none = F.array().cast("array<string>")
    one = lambda s: F.array(F.lit(s))
    states: Column = F.concat("states", F.when(F.col("cell_barcode").isNull(), one("FILTERED_NO_CELL_BARCODE")).when(F.col("cell_edits") > 0, one("CORRECTED_BARCODE")).otherwise(none))
    if samples is not None and tech.sample_length:
        out = correct_sample(out, samples, tech, per10)
        wrong = ~F.col("probe_barcode").isin(allowed) if allowed else F.lit(False)
        states = F.concat(
            states,
            F.when(F.col("probe_barcode").isNull() & F.col("probe_idx").isNotNull(), one("FILTERED_NO_PROBE_BARCODE"))
            .when(wrong, one("FILTERED_INCORRECT_PROBE_BARCODE")).when(F.col("sample_edits") > 0, one("CORRECTED_PROBE_BARCODE")).otherwise(none),
        )
    else:
        out = out.withColumn("probe_barcode", F.lit("1"))
    out = out.withColumn("states", states)
    failed = F.exists("states", lambda s: s.startswith("FILTERED"))
    out = out.withColumn("states", F.when(F.size("states") == 0, one("EXACT")).otherwise(F.col("states")))
    out = out.withColumns({"probe_idx": F.when(~failed, F.col("probe_idx")), "gapfill": F.when(~failed, F.col("gapfill"))})
    return out.select("read_id", "probe_idx", "probe_barcode", "gapfill", "gapfill_quality", "cell_barcode", "umi", "umi_quality", "states")
