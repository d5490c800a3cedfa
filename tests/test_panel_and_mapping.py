import gzip

from pyspark.sql import functions as F

from probelake.operators import filters, fuzzy, knn, manifest, mapping, offbyone, spatial
from probelake.plans import pipeline
from probelake.sources import discover, discover_plexes, read_counts, read_fastqs, read_metrics, read_mtx, read_panel, read_sam_tags, read_star, read_whitelist, slide_positions, write_star
from probelake.tech import FLEX_V1, VISIUM_HD

CONST = FLEX_V1.constant


def test_trim_and_decoys(spark):
    p = spark.createDataFrame([("a", "L" * 25, "R" * 25, "AAA", "CCCCC"), ("b", "M" * 25, "S" * 25, "A", "A")], "name string, lhs_probe string, rhs_probe string, gap_probe_sequence string, original_gap_probe_sequence string")
    assert {r["name"]: len(r["rhs_probe"]) for r in manifest.trimmed(p, 50).collect()} == {"a": 20, "b": 24}
    d = manifest.with_decoys(p).filter("not was_defined")
    assert {r["name"] for r in d.collect()} == {"a/b", "b/a"}


def test_pigeonhole_equals_brute_force(spark):
    import random

    rng = random.Random(1)
    white = sorted({"".join(rng.choice("ACGT") for _ in range(10)) for _ in range(300)})
    asked = ["".join(c if rng.random() > 0.12 else rng.choice("ACGT") for c in rng.choice(white)) for _ in range(300)]
    got = {r["seq"]: (r["entry"], r["edits"]) for r in fuzzy.match_whitelist(spark.createDataFrame([(x,) for x in asked], "seq string"), spark.createDataFrame([(x,) for x in white], "entry string"), 2).collect()}
    for s in asked:
        best = min((sum(a != b for a, b in zip(s, w)), w) for w in white)
        assert got[s] == ((best[1], best[0]) if best[0] <= 2 else (None, None))


def test_two_part(spark):
    one = spark.createDataFrame([("ACGT",)], "entry string")
    two = spark.createDataFrame([("GGTT",)], "entry string")
    r = fuzzy.two_part(spark.createDataFrame([("ACGTGGTA",), ("TACGTGGTT",)], "seq string"), one, two, "seq", [(0, 4, 8), (1, 5, 9)], 1).collect()
    assert {(x["seq"], x["edits"]) for x in r} == {("ACGTGGTA", 1), ("TACGTGGTT", 0)}


def fastq(path, seqs):
    with gzip.open(path, "wt") as f:
        for i, s in enumerate(seqs):
            f.write(f"@r{i}\n{s}\n+\n{'I' * len(s)}\n")


def test_reads_to_counts(spark, tmp_path):
    left, right, cell, sample = "ACGTACGTAC", "TTGGCCAATT", "AACCGGTTAACCGGTT", "ACTTTAGG"
    r1 = [cell + "A" * 12, cell + "A" * 12, "T" + cell[1:] + "C" * 12, "G" * 16 + "C" * 12, cell + "G" * 12]
    r2 = [left + "CA" + right + CONST + "NN" + sample] * 4 + ["N" * 40]
    fastq(tmp_path / "s_R1.fastq.gz", r1)
    fastq(tmp_path / "s_R2.fastq.gz", r2)
    (tmp_path / "panel.tsv").write_text(f"Name\tLHS_probe\trhs_probe\tsymbol\np1\t{left}\t{right}\tG1\n")
    (tmp_path / "cells.txt").write_text(cell + "-1\n")
    (tmp_path / "samples.txt").write_text(sample + "\n")
    assert len(discover(str(tmp_path / "s"))) == 1 and read_fastqs(spark, str(tmp_path / "s")).count() == 5
    out = pipeline.run(spark, str(tmp_path / "s"), str(tmp_path / "panel.tsv"), str(tmp_path / "cells.txt"), str(tmp_path / "out"), samples=str(tmp_path / "samples.txt"), flatten=True, unmapped=True)
    m = {r["metric"]: r["value"] for r in out["metrics"].collect()}
    assert m["TOTAL_READS"] == 5 == m["PROBE_CONTAINING_READS"] + sum(v for k, v in m.items() if k.startswith("FILTERED"))
    assert (m["CORRECTED_BARCODE"], m["FILTERED_NO_CELL_BARCODE"], m["FILTERED_NO_LHS"]) == (1, 1, 1)
    e = out["entries"].collect()
    assert [(r["gapfill"], r["n_umis"], r["total_reads"]) for r in e] == [("CA", 2, 3)]
    again = pipeline.run(spark, str(tmp_path / "s"), str(tmp_path / "panel.tsv"), str(tmp_path / "cells.txt"), str(tmp_path / "out"), samples=str(tmp_path / "samples.txt"))
    assert again["entries"].count() == 1
    assert out["flat"].first()["barcode"] == cell


LEFT, RIGHT = "ACGTACGTAC", "TTGGCCAATT"
TAIL = CONST + "NN" + "ACTTTAGG"


def parser(panel, **options):
    by_left = {}
    for a, b in panel:
        by_left.setdefault(a, set()).add(b)
    defaults = {"pairs": by_left, "tech": FLEX_V1, "per10": 1, "skip_constant": False, "flexible": False}
    return mapping.Parser([a for a, _ in panel], [b for _, b in panel], **(defaults | options))


def test_reads_by_uri_and_by_list(spark, tmp_path):
    import pytest

    fastq(tmp_path / "u_R1.fastq.gz", ["A" * 28] * 3)
    fastq(tmp_path / "u_R2.fastq.gz", ["C" * 40] * 3)
    (tmp_path / "v_R1.fastq").write_text("@r0\nAC\n+\nII\n")
    (tmp_path / "v_R2.fastq").write_text("@r0\nGT\n+\nII\n")
    assert len(discover(f"file://{tmp_path}/u")) == 1 and read_fastqs(spark, f"file://{tmp_path}/u").count() == 3
    listed = read_fastqs(spark, r1=[f"{tmp_path}/u_R1.fastq.gz", f"{tmp_path}/v_R1.fastq"], r2=[f"{tmp_path}/u_R2.fastq.gz", f"{tmp_path}/v_R2.fastq"])
    assert sorted(r["r1"] for r in listed.collect()) == ["A" * 28] * 3 + ["AC"]
    with pytest.raises(FileNotFoundError):
        discover(f"file://{tmp_path}/none")
    (tmp_path / "w_R1.fastq").write_text("@r0\nAC\n+\n")
    (tmp_path / "w_R2.fastq").write_text("@r0\nAC\n+\n")
    with pytest.raises(Exception, match="breaks off"):
        read_fastqs(spark, f"{tmp_path}/w").count()


def test_parser_rejects_and_corrects():
    p = parser([(LEFT, RIGHT), (LEFT, "GGGGGGGGGG")])
    assert p.parse(LEFT + "" + "GGGGGGGGGG" + TAIL)[:3] == (LEFT, "GGGGGGGGGG", "")
    assert p.parse("TCGTACGTAC" + "C" + RIGHT + TAIL)[6] == ["CORRECTED_LHS"]
    assert p.parse(LEFT + "C" + RIGHT + "C" * 30)[6] == ["FILTERED_NO_CONSTANT"]


def test_parser_fallbacks():
    p = parser([(LEFT, RIGHT), ("CCCCAAAATT", "GATTACAGAT")])
    assert p.parse(LEFT + "CA" + RIGHT + CONST[:10])[1:4] == (RIGHT, "CA", 10)  # a constant cut short by the read's end
    assert p.parse(LEFT + "CA" + RIGHT + CONST[:6])[6] == ["FILTERED_NO_CONSTANT"]
    assert p.parse(LEFT + "CA" + "GATTACAGAT" + TAIL)[6] == ["FILTERED_NO_RHS"]  # not a pair of the panel
    every = parser([(LEFT, RIGHT), ("CCCCAAAATT", "GATTACAGAT")], pairs=None)
    assert every.parse(LEFT + "CA" + "GATTACAGAT" + TAIL)[:3] == (LEFT, "GATTACAGAT", "CA")
    loose = parser([(LEFT, RIGHT)], flexible=True)
    assert loose.parse("TT" + LEFT + "CA" + RIGHT + TAIL)[:5] == (LEFT, RIGHT, "CA", 12, 14)
    short = parser([(LEFT, RIGHT)], skip_constant=True)
    assert short.parse(LEFT + RIGHT[:6])[1:3] == (RIGHT, "") and short.parse(LEFT + RIGHT[:6])[6] == ["CORRECTED_RHS"]
    assert short.parse(LEFT + RIGHT[:4])[6] == ["FILTERED_NO_RHS"]


def test_parser_indels():
    p = parser([("ACGTACGTACGGTTAACCGG", "TTGGCCAATTGGAACCTTAA")], indels=True)
    plain = parser([("ACGTACGTACGGTTAACCGG", "TTGGCCAATTGGAACCTTAA")])
    read = "ACGTACGTACGGTAACCGG" + "TC" + "TTGGCCAATTAGGAACCTTAA" + TAIL  # a base less on the left, one more on the right
    assert p.parse(read)[6] == ["CORRECTED_LHS", "CORRECTED_RHS"] and plain.parse(read)[6] == ["FILTERED_NO_LHS"]
    assert mapping.find_edits("AAACGTTAAA", "CGGTT", 1)[2] == 1 and mapping.edits_of_prefix("ACGTT", "ACGGTT", 2) == 1


def test_find_equals_brute_force():
    import random

    rng = random.Random(4)
    for _ in range(300):
        text, pattern = ("".join(rng.choice("AC") for _ in range(n)) for n in (20, 7))
        most = rng.randrange(0, 3)
        places = [(sum(x != y for x, y in zip(text[i : i + 7], pattern)), i) for i in range(14)]
        best = min(places)
        want = (best[1], best[0]) if best[0] <= most else (-1, 0)
        assert mapping.find(text, pattern, most) == want


def test_budgets():
    assert [mapping.barcode_budget(n, 1) for n in (8, 10, 12, 16, 25, 90)] == [1, 1, 2, 2, 3, 9]
    assert [mapping.budget(n, 1) for n in (8, 10, 12, 16, 25, 90)] == [1, 1, 1, 1, 2, 9]
    assert mapping.barcode_budget(16, 0.5) == 1 and mapping.budget(25, 2) == 5


def pairs_of(spark, rows):
    return spark.createDataFrame([(i, a, "I" * len(a), b, "I" * len(b)) for i, (a, b) in enumerate(rows)], "read_id long, r1 string, q1 string, r2 string, q2 string")


PANEL = "index long, name string, lhs_probe string, rhs_probe string"


def test_cell_barcodes_of_one_two_and_three_edits(spark):
    cell, r2 = "AACCGGTTAACCGGTT", LEFT + "CA" + RIGHT + TAIL
    reads = pairs_of(spark, [(c + "A" * 12, r2) for c in (cell, "T" + cell[1:], "TT" + cell[2:], "TTT" + cell[3:])])
    panel = spark.createDataFrame([(0, "p", LEFT, RIGHT)], PANEL)
    got = {r["read_id"]: (r["cell_barcode"], r["states"]) for r in mapping.map_reads(reads, panel, spark.createDataFrame([(cell,)], "entry string")).collect()}
    assert got == {0: (cell, ["EXACT"]), 1: (cell, ["CORRECTED_BARCODE"]), 2: (cell, ["CORRECTED_BARCODE"]), 3: (None, ["FILTERED_NO_CELL_BARCODE"])}


def test_sample_barcodes(spark):
    cell, body = "AACCGGTTAACCGGTT", LEFT + "CA" + RIGHT + CONST + "NN"
    reads = pairs_of(spark, [(cell + "A" * 12, body + s) for s in ("ACTTTAGG", "ACTTTAGC", "ACTTA", "ACT", "GGGGGGGG", "TTTTCCCC")])
    panel = spark.createDataFrame([(0, "p", LEFT, RIGHT)], PANEL)
    cells, samples = spark.createDataFrame([(cell,)], "entry string"), spark.createDataFrame([("ACTTTAGG",), ("ACTTACCC",), ("TTTTCCCC",)], "entry string")
    got = {r["read_id"]: (r["probe_barcode"], r["states"]) for r in mapping.map_reads(reads, panel, cells, samples=samples, allowed=["ACTTTAGG", "ACTTACCC"]).collect()}
    assert got[0] == ("ACTTTAGG", ["EXACT"]) and got[1] == ("ACTTTAGG", ["CORRECTED_PROBE_BARCODE"])
    assert got[2] == ("ACTTACCC", ["CORRECTED_PROBE_BARCODE"])  # the read ends within it, more than half is there
    assert got[3] == got[4] == (None, ["FILTERED_NO_PROBE_BARCODE"]) and got[5][1] == ["FILTERED_INCORRECT_PROBE_BARCODE"]


def test_lengths_and_two_part_cells(spark):
    one, two = "ACGTACGTACGTAA", "GGTTGGTTGGTTCC"
    hd = VISIUM_HD
    reads = pairs_of(spark, [("A" * 9 + one + two + "T" * 6, LEFT + "CA" + RIGHT), ("A" * 10 + one + "T" + two[1:] + "T" * 5, LEFT + "CA" + RIGHT), ("A" * 9 + "C" * 34, LEFT + "CA" + RIGHT)])
    panel = spark.createDataFrame([(0, "p", LEFT, RIGHT)], PANEL)
    slide = spark.createDataFrame([(one, 3, None, None), (None, None, two, 5)], "first string, x int, second string, y int")
    got = {r["read_id"]: (r["cell_barcode"], r["states"]) for r in mapping.map_reads(reads, panel, slide, hd).collect()}
    assert got == {0: (one + two, ["EXACT"]), 1: (one + two, ["CORRECTED_BARCODE"]), 2: (None, ["FILTERED_NO_CELL_BARCODE"])}
    at = slide_positions(spark.createDataFrame([(one + two,)], "barcode string"), slide).first()
    assert (at["x"], at["y"]) == (3, 5)
    cut = mapping.map_reads(pairs_of(spark, [("A" * 28, LEFT + "CA" + RIGHT + TAIL)]), panel, spark.createDataFrame([("A" * 16,)], "entry string"), r2_length=22).first()
    assert cut["states"] == ["FILTERED_NO_CONSTANT"]


def test_two_samples_that_share_a_barcode(spark, tmp_path):
    cell, body = "AACCGGTTAACCGGTT", LEFT + "CA" + RIGHT + CONST + "NN"
    fastq(tmp_path / "m_R1.fastq.gz", [cell + "A" * 12, cell + "A" * 12, cell + "C" * 12, "N" * 28])
    fastq(tmp_path / "m_R2.fastq.gz", [body + "ACTTTAGG", body + "TTTTCCCC", body + "TTTTCCCC", body + "ACTTTAGG"])
    (tmp_path / "panel.tsv").write_text(f"name\tlhs_probe\trhs_probe\np1\t{LEFT}\t{RIGHT}\n")
    (tmp_path / "cells.txt").write_text(cell + "\n")
    (tmp_path / "samples.txt").write_text("ACTTTAGG ACTTTAGG A-A01\nTTTTCCCC TTTTCCCC A-B01\n")
    from probelake.cli import main

    common = ["--output", str(tmp_path / "out")]
    main(["count", "--probes", str(tmp_path / "panel.tsv"), "--project", str(tmp_path / "m"), "--whitelist", str(tmp_path / "cells.txt"), "--samples", str(tmp_path / "samples.txt"), "--barcode", "A01", "--barcode", "B01", "--unmapped_reads", *common])
    for step in ("correct-umis", "correct-gapfill", "collect", "summarize"):
        main([step, *common])
    out = read_counts(spark, str(tmp_path / "out"))
    assert {(r["probe_barcode"], r["n_umis"], r["total_reads"]) for r in out["entries"].collect()} == {("ACTTTAGG", 1, 1), ("TTTTCCCC", 2, 2)}
    assert out["cells"].count() == 2 and out["entries"].select("cell_idx").distinct().count() == 2
    assert discover_plexes(spark, str(tmp_path / "out" / "entries")) == ["ACTTTAGG", "TTTTCCCC"]
    assert read_counts(spark, str(tmp_path / "out"), "TTTTCCCC")["entries"].count() == 1
    by = {(r["probe_barcode"], r["statistic"]): r["value"] for r in spark.read.parquet(str(tmp_path / "out" / "summary_by_plex")).collect()}
    assert by["TTTTCCCC", "TOTAL_UMIS"] == 2 and by["ACTTTAGG", "TOTAL_CELLS"] == 1
    assert read_metrics(spark, str(tmp_path / "out" / "metrics"))["TOTAL_READS"] == 4
    for k in (1, 2):
        lost = [r[0] for r in spark.read.text(str(tmp_path / "out" / "unmapped" / f"R{k}")).collect()]
        assert len(lost) == 4 and lost[0].startswith("@r3 FILTERED")
    assert out["features"].filter("name = 'p1'").count() == 2 and out["attributes"].filter("n_cells = 1").count() == 2


def test_spatial_bin_and_polygon(spark):
    e = spark.createDataFrame([(5, 2, 0, "A", 4)], "row long, col long, probe_idx long, gapfill string, n_umis long")
    r = spatial.bin_entries(e, (8,)).first()
    assert (r["row"], r["col"], r["barcode"], r["n_umis"]) == (1, 0, "s_008um_00001_00000-1", 4)
    inside = filters.in_polygon(F.col("col"), F.col("row"), [(0, 0), (10, 0), (10, 10), (0, 10)])
    assert e.select(inside).first()[0] is True


def test_off_by_one(spark):
    e = spark.createDataFrame([(0, 0, "ACG", 10), (0, 0, "AC", 3), (0, 0, "TT", 2), (1, 0, "AC", 5)], "cell_idx long, probe_idx long, gapfill string, n_umis long")
    assert {(r["cell_idx"], r["gapfill"], r["n_umis"]) for r in offbyone.correct_off_by_one(e.filter("gapfill <> 'TT'")).collect()} == {(0, "ACG", 13), (1, "AC", 5)}


def test_off_by_one_rules(spark):
    def corrected(rows, probes=None):
        e = spark.createDataFrame([(0, p, g, n) for p, g, n in rows], "cell_idx long, probe_idx long, gapfill string, n_umis long")
        return {(r["probe_idx"], r["gapfill"], r["n_umis"]) for r in offbyone.correct_off_by_one(e, probes).collect()}

    same = lambda rows: {(p, g, n) for p, g, n in rows}
    many = [(0, "ACG", 10), (0, "AC", 3), (0, "TG", 2)]
    assert corrected(many) == same(many)  # several shorter, one longer
    weak = [(0, "ACG", 3), (0, "AC", 3)]
    assert corrected(weak) == same(weak)  # no more molecules
    assert corrected([(0, "ACG", 6), (0, "ATG", 3), (0, "AG", 3)]) == {(0, "ACG", 8), (0, "ATG", 4)}  # as near: in proportion
    assert corrected([(0, "ACG", 6), (0, "TTG", 3), (0, "AG", 3)]) == {(0, "ACG", 9), (0, "TTG", 3)}
    gap = [(0, "ACACACAC", 9), (0, "CACACAT", 4)]
    assert corrected(gap) == {(0, "ACACACAC", 13)}  # one base gone, one changed
    far = [(0, "AACCGGTTA", 9), (0, "ACCGGTTC", 4)]
    assert corrected(far) == {(0, "AACCGGTTA", 13)}
    shifted = [(0, "CACGTACG", 9), (0, "ACGTACG", 4), (1, "ACGTTGCATG", 9), (1, "CGATTGCTG", 2)]
    assert corrected(shifted, [0]) == {(0, "CACGTACG", 13), (1, "ACGTTGCATG", 9), (1, "CGATTGCTG", 2)}  # only the asked probe


def test_a_gap_in_the_longer_gapfill_rules_correction_out(spark):
    one, two = "TACGTACGGA", "ACGTTACGG"  # nearest by a base less at the start, one more within, one less at the end
    e = spark.createDataFrame([(0, 0, one, 9), (0, 0, two, 4)], "cell_idx long, probe_idx long, gapfill string, n_umis long")
    d = spark.range(1).select(F.levenshtein(F.lit(one), F.lit(two)), offbyone.one_gap_distance(F.lit(two), F.lit(one))).first()
    assert d[0] < d[1]
    assert {(r["gapfill"], r["n_umis"]) for r in offbyone.correct_off_by_one(e).collect()} == {(one, 9), (two, 4)}


def test_ten_x_layouts(spark, tmp_path):
    from probelake.sources import possible_barcodes, read_chemistry, read_slide, read_well_list, read_wta, read_wta_barcodes

    at = tmp_path / "outs" / "binned_outputs" / "square_002um" / "filtered_feature_bc_matrix"
    at.mkdir(parents=True)
    for name, text in (("barcodes.tsv", "AA-1\nCC-1\n"), ("features.tsv", "E1\tG1\tGene\nE2\tG2\tGene\n"), ("matrix.mtx", "%%MatrixMarket\n2 2 2\n1 2 5\n2 1 3\n")):
        with gzip.open(at / f"{name}.gz", "wt") as f:
            f.write(text)
    assert {r[0] for r in read_wta_barcodes(spark, str(tmp_path)).collect()} == {"AA", "CC"}
    assert {tuple(r) for r in read_wta(spark, str(tmp_path)).collect()} == {("CC", "E1", "G1", 5.0), ("AA", "E2", "G2", 3.0)}
    import pytest

    with pytest.warns(UserWarning):
        assert possible_barcodes(spark, [str(tmp_path), "/nowhere"]).count() == 2
    with pytest.warns(UserWarning):
        assert possible_barcodes(spark, ["/nowhere", "x.h5"]) is None
    (tmp_path / "a.txt").write_text("AA\nAC\n"), (tmp_path / "b.txt").write_text("GG\n")
    assert [tuple(r) for r in read_slide(spark, str(tmp_path / "a.txt"), str(tmp_path / "b.txt")).orderBy("first").collect()] == [(None, None, "GG", 0), ("AA", 0, None, None), ("AC", 1, None, None)]
    (tmp_path / "c.json").write_text('{"SPATIAL-HD-v1": {"barcode": [{"offset": 11, "length": 14}, {"offset": 25, "length": 14}], "barcode_extraction": {"params": {"min_offset": 8, "max_offset": 12}}}}')
    assert read_chemistry(spark, str(tmp_path / "c.json"))["max_offset"] == 12
    (tmp_path / "w.txt").write_text("AAA BBB A-A01\nCCC\n")
    assert [tuple(r) for r in read_well_list(spark, str(tmp_path / "w.txt")).collect()] == [("AAA", "BBB", "A-A01"), ("CCC", "CCC", None)]


def test_numbering_by_ranges(spark):
    from probelake.operators.counts import numbered

    d = spark.range(1000).select((F.col("id") * 7 % 1009).alias("x"), F.col("id").alias("y"))
    got = [tuple(r) for r in numbered(d, "n", "x", "y").orderBy("x", "y").select("n", "x").collect()]
    assert [n for n, _ in got] == list(range(1000))


def test_a_cell_of_many_identifiers(spark):
    from probelake.operators import molecules

    letters = lambda i: F.translate(F.lpad(F.conv(i.cast("string"), 10, 4), 12, "0"), "0123", "ACGT")
    n = 100_000
    r = spark.range(n).select(F.lit(0).cast("long").alias("cell_idx"), F.lit(0).cast("long").alias("probe_idx"), F.lit("1").alias("probe_barcode"), letters((F.col("id") * 7919 + 13) % (4**12)).alias("umi"), F.col("id").alias("read_id"))
    out = molecules.correct_umis(r).agg(F.count("*").alias("n"), F.countDistinct("corrected_umi").alias("k"), F.count_if(F.col("umi") == F.col("corrected_umi")).alias("same")).first()
    assert out["n"] == n and out["k"] == out["same"] < n


def test_imputation_takes_neighbours(spark):
    calls = [(c, p, "A" if c < 3 else "C") for c in range(6) for p in range(3) if (c, p) not in ((0, 0), (5, 0))]
    d = spark.createDataFrame([(c, p, g, 1, 1.0) for c, p, g in calls], "cell_idx long, probe_idx long, genotype string, n_umis long, proportion double")
    cells = spark.createDataFrame([(c, 0) for c in range(6)], "cell_idx long, cluster long")
    got, _ = knn.impute_genotypes(d, cells, k=2)
    assert {(r["cell_idx"], r["probe_idx"], r["genotype"]) for r in got.collect()} == {(0, 0, "A"), (5, 0, "C")}


def test_text_sources(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket\n%c\n2 2 1\n1 2 5\n")
    assert [tuple(r) for r in read_mtx(spark, str(tmp_path / "m.mtx")).collect()] == [(0, 1, 5.0)]
    (tmp_path / "x.sam").write_text("@HD\nr1\t0\tCB:Z:AA\tCR:Z:AC\t1R:Z:G\nr2\t0\tCB:Z:AA\n")
    assert read_sam_tags(spark, str(tmp_path / "x.sam")).count() == 1
    (tmp_path / "w.txt").write_text("AAA-1\nAAA-2\nCCC\n")
    assert {r[0] for r in read_whitelist(spark, str(tmp_path / "w.txt")).collect()} == {"AAA", "CCC"}
    (tmp_path / "p.csv").write_text("name,lhs_probe,rhs_probe,expected_gapfill\nx,A,C,\nx,A,G,T\nx,A,G,T\n")
    assert {r["name"] for r in read_panel(spark, str(tmp_path / "p.csv")).collect()} == {"x_0", "x_1"}
    e = spark.createDataFrame([(0, "")], "cell_idx long, gapfill string")
    write_star({"entries": e}, str(tmp_path / "star"))
    assert read_star(spark, str(tmp_path / "star"))["entries"].first()["gapfill"] == ""
