"""Registered queries look at all rows of their tables: small tables against brute force."""

from probelake.plans import queries as q


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def nearest(seq: str, entries: list[str]) -> tuple:
    best = min((edits(seq, e), e) for e in entries)
    return (seq, best[1], best[0]) if best[0] <= 1 else (seq, None, None)


def customers(spark, d, n):
    spark.range(1, n + 1).toDF("c_custkey").write.parquet(f"{d}/customer.parquet")


def test_indels_of_every_asked_sequence(spark, tmp_path):
    customers(spark, tmp_path, 60)
    white, asked = ([r[0] for r in x.collect()] for x in (q._whitelist(spark, str(tmp_path))[0], q._whitelist(spark, str(tmp_path))[1].select("seq")))
    got = [tuple(r) for r in q.whitelist_indels(spark, str(tmp_path)).select("seq", "entry", "edits").collect()]
    assert sorted(got, key=str) == sorted((nearest(s, white) for s in set(asked)), key=str)
    assert {g[2] for g in got} == {0, 1, None}


def test_indels_are_found(spark):
    from probelake.operators import fuzzy

    white = ["ACGTACGTACGTACGTACGTACGT", "AAACCCGGGTTTAAACCCGGGTTT"]
    asked = [white[0][:20] + white[0][21:], white[1][:13] + "G" + white[1][13:], white[0][:23] + "A", white[1], "T" * 24]
    table = lambda xs, name: spark.createDataFrame([(x,) for x in xs], f"{name} string")
    got = fuzzy.match_whitelist(table(asked, "seq"), table(white, "entry"), 1, indels=True).collect()
    assert sorted([(r["seq"], r["entry"], r["edits"]) for r in got], key=str) == sorted((nearest(s, white) for s in asked), key=str)


def test_specific_genotypes_of_all_customers(spark, tmp_path):
    rows = [(7, 1, "A"), (8, 1, "A"), (9, 2, "B"), (10, 1, "B"), (11, 3, "C"), (14, 1, "A"), (15, 2, "A")]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got = {(r["probe_idx"], r["grp"], r["genotype"]) for r in q.specific_probes(spark, str(tmp_path)).collect()}
    assert got == {(1, 1, "A"), (1, 3, "C")}


def test_summary_of_all_probes(spark, tmp_path):
    items = [(s, line, "A", "F", 10.0 * line, 0.01) for s in (1, 2) for line in range(1, 8)]
    spark.createDataFrame(items, "l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_quantity double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1,), (2,), (3,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r["statistic"]: r["value"] for r in q.summary_stats(spark, str(tmp_path)).collect()}
    assert (got["TOTAL_CELLS"], got["TOTAL_UMIS"], got["GAPFILL_CONTAINING_CELLS"], got["UMIS_PER_CELL_MIN"]) == (3, 14, 2, 0)
    assert got["SEQUENCING_SATURATION"] == round(1 - 14 / 560, 6)


def test_imputation_is_given_every_call(spark, monkeypatch):
    given = []
    monkeypatch.setattr(q.knn, "impute_genotypes", lambda calls, cells, **k: given.append((calls, cells, k)) or (calls, None))
    q.impute_genotypes(spark, "/root/testdata/sf0.001")
    calls, cells, options = given[0]
    assert calls.count() == q.QUERIES["call_genotypes"](spark, "/root/testdata/sf0.001").count() and options["hold_out"] > 0
    assert cells.count() == calls.select("cell_idx").distinct().count()


def test_components_keep_distances(spark):
    import numpy as np

    from probelake.operators import knn

    m = np.random.default_rng(3).integers(0, 4, (30, 6)).astype(float)
    rows = [(c, g, float(m[c, g])) for c in range(30) for g in range(6) if m[c, g]]
    got = {r["cell_idx"]: np.array(r["pc"]) for r in knn.principal_components(spark.createDataFrame(rows, "cell_idx long, gene long, x double"), 3).collect()}
    centred = m - m.mean(0)
    u, s, v = np.linalg.svd(centred, full_matrices=False)
    want = centred @ v[:3].T
    for a in range(30):
        assert abs(np.linalg.norm(got[a] - got[0]) - np.linalg.norm(want[a] - want[0])) < 1e-9


def test_every_cell_is_clustered(spark, tmp_path):
    items = [(s, p) for s in range(1, 71) for p in range(s % 7, 40, 3)]
    spark.createDataFrame(items, "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = q.coclustering(spark, str(tmp_path)).collect()
    assert sorted(r["node"] for r in got) == list(range(1, 71))
