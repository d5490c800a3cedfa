"""Genes are ranked by their rounded dispersion, as in the SQL."""

import duckdb

from probelake.plans import queries as q


def test_ties_of_rounded_dispersions(spark, tmp_path):
    # Every cell has 200 rows of each of 14 genes; a gene from 4 on has one more in one cell, which rounds to 0.
    (tmp_path / "lineitem.parquet").mkdir()
    c = duckdb.connect()
    c.sql(f"""copy (select s l_suppkey, g l_partkey from range(40) t(s), range(14) u(g), range(201) v(r) where r < 200 + case when g > 3 and s = 2 * g then 1 else 0 end) to '{tmp_path}/lineitem.parquet/a.parquet'""")
    c.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    got = [tuple(r) for r in q.variable_genes(spark, str(tmp_path)).select("gene", "dispersion").collect()]
    assert got == c.sql(q.ORACLES["variable_genes"]).fetchall()
    assert [g for g, _ in got] == list(range(10))
