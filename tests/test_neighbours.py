"""Neighbours and distances compared block by block, against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from probelake.operators import knn
from probelake.plans import queries as q
from probelake.plans import report_queries as rq

SCHEMA = "cluster long, cell_idx long, probe_idx long, genotype string"


def some_calls(cells=60, seed=5):
    """Two groups; copies, cells that share no probe with some others, repeated alleles, missing calls."""
    r = random.Random(seed)
    kinds = [[(p, "/".join(r.choices("ACGT", k=r.randint(1, 3)))) for p in r.sample(range(4), r.randint(1, 3))] for _ in range(12)]
    rows = [(c % 2, c * 3 % 61, p, g) for c in range(cells) for p, g in kinds[r.randrange(12)]]
    return [*rows, (0, 1000, 0, None), (0, 1001, 77, "A")]


def brute_distances(rows):
    cells = {}
    for group, c, p, g in rows:
        if g is not None:
            cells.setdefault((group, c), {})[p] = set(g.split("/"))
    out = {}
    for (ga, a), x in cells.items():
        for (gb, b), y in cells.items():
            both = x.keys() & y.keys()
            if ga == gb and a != b and both:
                out[ga, a, b] = sum(len(x[p] ^ y[p]) for p in both) ** 0.5 / len(both)
    return out


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(knn, "block_pairs", lambda *a, f=knn.block_pairs, **k: f(*a, **k | {"block": 7, "blocks": 3}))


def test_imputation_makes_no_row_a_pair(spark, monkeypatch):
    def refuse(*a, **k):
        raise AssertionError("a row a pair of cells")

    monkeypatch.setattr(knn, "genotype_distances", refuse)
    assert q.impute_genotypes(spark, "/root/testdata/sf0.001").collect()


def test_neighbours_against_brute_force(spark, small_blocks):
    rows = some_calls()
    want, near = set(), {}
    for (_, a, b), d in brute_distances(rows).items():
        near.setdefault(a, []).append((d, b))
    for a, x in near.items():
        want |= {(a, b, d, i) for i, (d, b) in enumerate(sorted(x)[:4], 1)}
    got = knn.genotype_neighbours(spark.createDataFrame(rows, SCHEMA), 4)
    assert {tuple(r) for r in got.select("src", "dst", "distance", "rank").collect()} == want


@pytest.mark.parametrize("features", [1024, 3])
def test_strips_of_few_alleles(monkeypatch, features):
    rows = [x for x in some_calls() if x[3]]
    cells = sorted({x[1] for x in rows})
    calls = [[{"probe_idx": p, "genotype": "/".join(sorted(set(g.split("/"))))} for _, c, p, g in rows if c == cell] for cell in cells]
    kind = pa.list_(pa.struct([("probe_idx", pa.int64()), ("genotype", pa.string())]))
    table = pa.table({"cell_idx": cells * 2, "calls": pa.array(calls * 2, kind), "side": [0] * len(cells) + [1] * len(cells)})
    monkeypatch.setattr(knn, "FEATURES", features)
    monkeypatch.setattr(knn, "AREA", 300)
    want = brute_distances([(0, *x[1:]) for x in rows])
    strips = list(knn.CallBlocks(table, "cell_idx").strips())
    assert len(strips) > 1
    differ, shared = (np.vstack([s[i] for s in strips]) for i in (1, 2))
    got = {(0, cells[i], cells[j]): float(differ[i, j]) ** 0.5 / float(shared[i, j]) for i, j in zip(*np.nonzero(shared)) if i != j}
    assert got == want


def test_neighbour_query_makes_no_row_a_pair(spark, monkeypatch):
    def refuse(*a, **k):
        raise AssertionError("a row a pair of cells")

    monkeypatch.setattr(knn, "genotype_distances", refuse)
    assert rq.genotype_knn(spark, "/root/testdata/sf0.001").collect()


def test_distances_against_brute_force(spark, small_blocks):
    rows = some_calls()
    want = {(g, a, b, d) for (g, a, b), d in brute_distances(rows).items() if a < b}
    assert {tuple(r) for r in knn.genotype_distances(spark.createDataFrame(rows, SCHEMA)).collect()} == want
    scaled = {tuple(r) for r in knn.genotype_distances(spark.createDataFrame(rows, SCHEMA), exact_scale=True, n_probes=5).collect()}
    assert {x[:3] for x in scaled} == {x[:3] for x in want}


def test_a_cell_is_copied_a_bounded_number_of_times(spark):
    rows = spark.range(3000).select("id", (knn.F.col("id") % 2).alias("g"))
    assert knn.block_pairs(rows, "id", "g", block=10, blocks=4).count() == 3000 * 4 * 2
    half = knn.block_pairs(rows, "id", "g", half=True, block=10, blocks=4)
    assert half.count() == 3000 * 5 and half.filter("own > other").count() == 0
