"""Hand-derived truth tables for molecules, counts and genotypes."""

from pyspark.sql import functions as F

from probelake import functions as fn
from probelake.operators import counts, genotypes, molecules


def reads(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "cell_idx long, probe_idx long, probe_barcode string, umi string, gapfill string, read_id long")


def consensus_of(spark, seqs):
    r = molecules.consensus(reads(spark, [(0, 0, "1", "U", s) for s in seqs])).first()
    return r["gapfill"], r["pcr_duplicate_count"], round(r["percent_supporting"], 6), r["corrected"]


def test_consensus(spark):
    assert consensus_of(spark, ["ACG", "ACG", "ACT"]) == ("ACG", 3, round(2 / 3, 6), True)
    assert consensus_of(spark, ["AC", "ACG", "ACG"]) == ("ACG", 3, round(2 / 3, 6), True)
    assert consensus_of(spark, ["ACG", "ACT"]) == ("ACT", 2, 0.5, True)
    assert consensus_of(spark, ["AC", "ACG"]) == ("AC", 2, 0.5, True)
    assert consensus_of(spark, ["ANG", "ACG"]) == ("ACG", 2, 0.5, True)
    assert consensus_of(spark, ["", ""]) == ("", 2, 1.0, False)


def test_umis_and_chimeras(spark):
    a, t = "A" * 12, "A" * 11 + "T"
    x = molecules.correct_umis(reads(spark, [(0, 3, "1", a, "C")] * 2 + [(0, 1, "1", t, "C")] * 5))
    assert {(r["probe_idx"], r["umi"], r["corrected_umi"]) for r in x.collect()} == {(3, a, a), (1, t, a)}
    kept = molecules.remove_chimeras(x)
    assert [r["probe_idx"] for r in kept.collect()] == [1] * 5


def mols(spark, dups):
    return spark.createDataFrame([(0, 0, "A", d, 1.0) for d in dups], "cell_idx long, probe_idx long, gapfill string, pcr_duplicate_count long, percent_supporting double")


def test_pcr_layers(spark):
    got = {r["threshold"]: r["n_umis"] for r in counts.pcr_layers(mols(spark, [1, 2, 5])).collect()}
    assert got == {1: 3, 2: 2, 3: 1, 4: 1, 5: 1}


def test_collapse_counts_absent_features(spark):
    e = spark.createDataFrame([(0, 0, "A", 1, 1, 1.0), (1, 0, "C", 1, 1, 1.0)], "cell_idx long, probe_idx long, gapfill string, n_umis long, total_reads long, percent_supporting double")
    assert {r["percent_supporting"] for r in counts.collapse_gapfills(e).collect()} == {0.5}


def test_saturation(spark):
    e = spark.createDataFrame([(0, 0, "A", 3), (1, 0, "A", 1), (1, 1, "A", 2)], "cell_idx long, probe_idx long, gapfill string, total_reads long")
    assert counts.saturation(e).first()[0] == 0.5


def call(spark, n, threshold):
    e = spark.createDataFrame([(0, 0, g, k) for g, k in n.items()], "cell_idx long, probe_idx long, gapfill string, n_umis long")
    r = genotypes.call_genotypes(e, threshold).first()
    return r["genotype"], r["n_umis"], r["proportion"]


def test_genotype_calls(spark):
    assert call(spark, {"A": 3, "C": 3}, 0.5) == ("C", 3, 0.5)
    assert call(spark, {"A": 2, "C": 1, "G": 1}, 0.6) == ("A/G", 3, 0.75)
    e = spark.createDataFrame([(0, 0, "A", 1)], "cell_idx long, probe_idx long, gapfill string, n_umis long")
    got = genotypes.call_genotypes(e, 0.5, spark.createDataFrame([(0,), (1,)], "cell_idx long"))
    assert {(r["cell_idx"], r["genotype"], r["n_umis"]) for r in got.collect()} == {(0, "A", 1), (1, None, 0)}


def test_alleles_and_burden(spark):
    d = spark.createDataFrame([("CAC",), ("AAC",), ("CAC/AAC",), ("CAC/GGG",), (None,)], "genotype string")
    kinds = lambda **k: [r[0] for r in d.select(genotypes.annotate_alleles(F.col("genotype"), F.lit("CAC"), F.lit("AAC"), **k)).collect()]
    assert kinds() == ["REF", "ALT", "HET", "HET", "UNKNOWN"]
    assert kinds(unknown_as_alt=False)[3] == "UNKNOWN"
    assert kinds(call_het=False)[2] == "ALT/REF"
    a = spark.createDataFrame([(0, k) for k in ("REF", "HET", "ALT", "UNKNOWN")], "cell_idx long, allele string")
    assert genotypes.mutational_burden(a, normalize=False).first()["burden"] == 0.5


def test_scalars(spark):
    one = spark.range(1)
    v = lambda c: one.select(c).first()[0]
    assert [v(fn.max_distance(F.lit(n))) for n in (8, 10, 12, 16, 25, 90)] == [1, 1, 2, 2, 3, 9]
    assert [v(fn.max_distance_floor(F.lit(n))) for n in (8, 10, 12, 16, 25, 90)] == [1, 1, 1, 1, 2, 9]
    assert v(fn.reverse_complement(F.lit("AACGT"))) == "ACGTT"
    assert v(fn.int_to_hash(F.lit(0))) == "5ba93c9"
    assert v(fn.hamming_encoded(fn.two_bit(F.lit("ACGT")), fn.two_bit(F.lit("ACTA")))) == 2
    assert len(v(fn.substitutions(F.lit("AC")))) == 6
    assert v(fn.strip_suffix(F.lit("ACGT-1"))) == "ACGT" and v(fn.gene_of(F.lit("TP53 a_b"))) == "TP53"
