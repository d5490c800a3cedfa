import corpus_pipeline
from probelake.llm import host_rules

from . import helpers as h

DOCS = h.corpus(4)[:-1]


def test_stages(spark, tmp_path):
    d = str(tmp_path)
    docs = spark.createDataFrame(DOCS, h.SCHEMA)
    docs.write.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "secret_scan", "source_mix", "packing"]
    kept = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = kept
        kept = stage(spark, before, d)
        assert kept.columns == docs.columns
        kept.write.parquet(f"{d}/{name}")
        kept = spark.read.parquet(f"{d}/{name}")
        ids = {r[0] for r in kept.select("doc_id").collect()}
        rows = {r["doc_id"]: r for r in before.collect()}
        if name == "quality_rules":
            assert ids == {r["doc_id"] for r in host_rules.apply_rules(before).filter("hr_kept").collect()}
        elif name == "jaccard_join":
            comp = h.components(h.shingle_sets([tuple(r) for r in rows.values()]))
            assert ids == set(comp.values())
        elif name == "secret_scan":
            assert ids == set(rows) and not [r for r in kept.collect() if h.spans(r["text"])]
        else:
            assert ids <= set(rows) and kept.groupBy("doc_id").count().filter("count > 3").count() == 0
    out = corpus_pipeline.run(spark, d)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], h.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_without_an_id_and_repeated_rows(spark, tmp_path):
    rng = h.random.Random(3)
    a, b, c = (h.prose(rng, 60) for _ in range(3))
    rows = [(1, a), (1, a), (1, b), (None, c), (None, c), (None, a), (5, a + " x"), (6, "short text")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], h.SCHEMA)
    got = sorted([(r["doc_id"], r["text"]) for r in corpus_pipeline.near_copies(spark, docs, "").collect()], key=str)
    assert got == sorted([(1, a), (1, b), (None, c), (6, "short text")], key=str)


def test_a_run_goes_on_where_it_broke_off(spark, tmp_path, monkeypatch):
    d = str(tmp_path)
    spark.createDataFrame(DOCS, h.SCHEMA).write.parquet(f"{d}/documents.parquet")
    run_id = tmp_path.name
    stages = corpus_pipeline.STAGES

    def broken(*a):
        raise RuntimeError("lost")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [*stages[:3], ("source_mix", broken), stages[4]])
    try:
        corpus_pipeline.run(spark, d, run_id)
        raise AssertionError("it should have broken off")
    except RuntimeError:
        pass
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, broken) for n, _ in stages[:3]] + stages[3:])
    got = corpus_pipeline.run(spark, d, run_id)
    assert got.groupBy("doc_id").count().count() > 0
