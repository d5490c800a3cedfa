"""Report operators on hand-made tables, alignment, imputation by grid, streaming, and guards."""

import pytest
from pyspark.sql import functions as F

from probelake import tech
from probelake.operators import align, genotypes, report, spatial
from probelake.streaming import stream_mapped


def test_line_specific_rules(spark):
    g = spark.createDataFrame([("a", 0, "WT"), ("b", 0, "ALT"), ("a", 1, "WT"), ("b", 1, "WT"), ("c", 1, "HET"), ("a", 2, "HET"), ("b", 2, "WT"), ("a", 3, "ALT"), ("b", 3, "WT"), ("c", 3, "HET")], "grp string, probe_idx long, kind string")
    plain = {(r["probe_idx"], r["kind"]) for r in report.line_specific_probes(g, "a").collect()}
    with_het = {(r["probe_idx"], r["het_groups"], r["same_groups"]) for r in report.line_specific_probes(g, "a", True).collect()}
    assert plain == {(0, "WT")} and with_het == {(0, 0, 0), (1, 1, 1), (3, 1, 0)}


def test_samples_come_apart_again(spark):
    a, b = spark.createDataFrame([("x", 1)], "barcode string, n long"), spark.createDataFrame([("x", 2.0)], "barcode string, m double")
    both = report.combined({"one": a, "two": b})
    assert {r["barcode"] for r in both.collect()} == {"one-x", "two-x"}
    assert [(r["barcode"], r["n"]) for r in report.one_sample(both, "one").collect()] == [("x", 1)]


def test_alignment():
    assert align.pairwise("ACGT", "AGT") == ("ACGT", "A-GT")
    out = align.aligned(["ACGT", "AGT", "ACGGT", "T"], [5, 1, 1, 1])
    assert len({len(x) for x in out}) == 1 and [x.replace("-", "") for x in out] == ["ACGT", "AGT", "ACGGT", "T"]
    assert align.aligned(["AC"], [1]) == ["AC"] and align.aligned([], []) == []


def test_padding_without_alignment(spark):
    f = spark.createDataFrame([(0, "ACT", 1.0), (0, "AC", 2.0), (0, "", 1.0)], "probe_idx long, gapfill string, value double")
    assert {r["aligned"] for r in align.align_gapfills(f, align=False).collect()} == {"ACT", "AC-", "---"}
    shares = {(r["position"], r["base"]): r["share"] for r in align.aligned_logo(f, align=False).collect()}
    assert shares[0, "A"] == 0.75 and shares[2, "-"] == 0.75


def test_imputation_on_every_grid(spark):
    rows = [(r, c, p, "A" if r < 8 else "C", 3) for r in range(16) for c in range(8) for p in range(3) if not (p == 0 and r in (0, 15) and c < 4)]
    e = spark.createDataFrame(rows, "row long, col long, probe_idx long, gapfill string, n_umis long")
    clusters = spark.createDataFrame([(res, r, c, 0) for res, k in ((2, 1), (8, 4)) for r in range(16 // k) for c in range(8 // k)], "resolution int, row long, col long, cluster int")
    got = {(r["resolution"], r["row"], r["col"], r["probe_idx"]): r["genotype"] for r in spatial.impute_by_resolution(e, clusters, (2, 8), k=5).collect()}
    assert got == {(2, r, c, 0): "A" if r == 0 else "C" for r in (0, 15) for c in range(4)}


def test_streamed_reads_are_mapped(spark, tmp_path):
    left, right, cell = "ACGTACGTAC", "TTGGCCAATT", "AACCGGTTAACCGGTT"
    constant = tech.FLEX_V1.constant
    reads = spark.createDataFrame([(0, cell + "A" * 12, "I" * 28, left + "CA" + right + constant, "I" * 38), (1, cell + "C" * 12, "I" * 28, "N" * 38, "I" * 38)], "read_id long, r1 string, q1 string, r2 string, q2 string")
    reads.write.parquet(f"{tmp_path}/in")
    panel = spark.createDataFrame([(0, "p", left, right)], "index long, name string, lhs_probe string, rhs_probe string")
    stream_mapped(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", panel, spark.createDataFrame([(cell,)], "entry string")).awaitTermination()
    got = {r["read_id"]: r["gapfill"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {0: "CA", 1: None}


def test_guards(spark):
    d = spark.createDataFrame([(1,)], "x long")
    for f in (lambda: spatial.check_spatial(d), lambda: spatial.check_genotypes(d), lambda: tech.technology("none"), lambda: spatial.bin_entries(d, (6,)), lambda: report.saturations({}), lambda: tech.FLEX_V1.pairing_ranges()):
        with pytest.raises(ValueError):
            f()
    assert tech.technology(tech.register(tech.Technology("mine", 0, 8, 8, 12)).name).cell_length == 12
    assert tech.FLEX_V1.sample_ids(["BC01", "B01"], ["1", "2", "A-B01"]) == ["1", "A-B01"]
    assert tech.load("probelake.tech:VISIUM").spatial


def test_variant_names(spark):
    d = spark.createDataFrame([("E|AKAP9|c.1389G>T|x",), ("PLAIN 0bp",)], "name string")
    got = [(r[0], r[1]["wild"], r[1]["variant"]) for r in d.select(report.probe_label(F.col("name")), report.variant_alleles(report.probe_label(F.col("name")))).collect()]
    assert got == [("AKAP9 c.1389G>T", "G", "T"), ("PLAIN 0bp", None, None)]


def test_dual_probes(spark):
    e = spark.createDataFrame([(0, "X c.1G>T", "", 2), (0, "X c.1G>G", "", 5), (0, "X 0bp", "", 7), (0, "Y c.2A>C", "", 1), (1, "X c.1G>T", "A", 3)], "cell_idx long, name string, gapfill string, n_umis long")
    pairs = report.dual_probe_pairs(e.select("name"))
    assert [tuple(r) for r in pairs.collect()] == [("X c.1G>T", "X c.1G>G", "T", "G")]
    assert {tuple(r) for r in report.recast_dual_probes(e, pairs).collect()} == {(0, "X c.1G>T", "T", 2), (0, "X c.1G>T", "G", 5), (0, "X 0bp", "", 7)}


def test_every_cell_and_probe_has_a_call(spark):
    e = spark.createDataFrame([(0, 0, "A", 2)], "cell_idx long, probe_idx long, gapfill string, n_umis long")
    got = {(r["cell_idx"], r["genotype"], r["n_umis"], r["proportion"]) for r in genotypes.call_genotypes(e, cells=spark.createDataFrame([(0,), (1,)], "cell_idx long")).collect()}
    assert got == {(0, "A", 2, 1.0), (1, None, 0, 0.0)}


def test_small_readers(spark, tmp_path):
    from probelake.operators import filters
    from probelake.sources import read_coordinates, read_truth

    (tmp_path / "at.txt").write_text("AAA\t1\t2\n")
    (tmp_path / "truth.csv").write_text("cell_type,0,1,name\nA,ACT,,p1\nB,ACT,CCT,p1\n")
    assert [tuple(r) for r in read_coordinates(spark, str(tmp_path / "at.txt")).collect()] == [("AAA", 1, 2)]
    assert {(r["cell_type"], tuple(r["alleles"])) for r in read_truth(spark, str(tmp_path / "truth.csv")).collect()} == {("A", ("ACT",)), ("B", ("ACT", "CCT"))}
    d = spark.createDataFrame([(1, 1), (5, 1), (1, 9)], "row long, col long")
    assert d.filter(filters.in_box(F.col("row"), F.col("col"), 0, 0, 2, 2)).count() == 1


def test_density(spark):
    import numpy as np

    from probelake.operators import stats

    rng = np.random.default_rng(1)
    xy = np.concatenate([rng.normal(0, 1, (400, 2)), rng.normal(6, 1, (100, 2))])
    d = spark.createDataFrame([(float(a), float(b)) for a, b in xy], "a double, b double")
    got = stats.density(d, "a", "b", 48).toPandas()
    assert got["n"].sum() == 500 and got.loc[got["density"].idxmax(), ["x", "y"]].abs().max() < 1.5
    sd = xy.std(0, ddof=1) * 500 ** (-1 / 6)
    for _, r in got.head(20).iterrows():
        exact = np.exp(-0.5 * (((xy - [r["x"], r["y"]]) / sd) ** 2).sum(1)).sum() / (2 * np.pi * sd[0] * sd[1] * 500)
        assert abs(exact - r["density"]) < 0.02 * got["density"].max()
    assert stats.density(d.filter("a > 100"), "a", "b").count() == 0
