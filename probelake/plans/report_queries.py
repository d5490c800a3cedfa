"""Queries over samples, groups of cells, libraries and names, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align, counts, genotypes, knn, molecules, report, spatial
from . import bindings as b
from .registry import query, r6

CALLS = f"with {b.ENTRIES_SQL}, {b.CALLS_SQL.format(t=0.6)}"
WIDE_CALLS = f"with {b.WIDE_SQL}, {b.CALLS_SQL.format(t=0.5)}"
NATION_SQL = "g as (select s_suppkey cell_idx, s_nationkey grp from supplier)"
ALLELES = "t(probe_idx, wt_gapfill, alt_gapfill) as (values (1, 'AF', 'NO'), (2, 'AF', 'NO'), (3, 'AF', 'NO'), (4, 'RF', 'NO'), (5, 'RF', 'NO'), (6, 'RF', 'AF'), (7, 'RF', 'AF'))"


def _groups(spark, d):
    return b.table(spark, d, "supplier").select(F.col("s_suppkey").alias("cell_idx"), F.col("s_nationkey").alias("grp"))


def _truth(spark):
    return spark.createDataFrame([(i, "AF" if i < 4 else "RF", "NO" if i < 6 else "AF") for i in range(1, 8)], "probe_idx long, wt_gapfill string, alt_gapfill string")


def _expected(spark, d):
    kind = F.element_at(F.array(F.lit("WT"), F.lit("ALT"), F.lit("HET")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    return b.table(spark, d, "nation").select(F.col("n_nationkey").alias("grp"), kind.alias("expected_genotype"))


EXPECTED = "x as (select n_nationkey grp, ['WT', 'ALT', 'HET'][n_nationkey % 3 + 1] expected_genotype from nation)"


# Samples of a multiplexed run


PLEX_SQL = """ev as (select event_id, event_type, cast(regexp_extract(props, '([0-9]+)', 1) as int) k, user_id from events),
r as (select 'c' || (user_id % 50) barcode, cast(user_id // 50 % 4 + 1 as varchar) probe_barcode, event_id read_id, cast(case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end as bigint) probe_idx,
 case when k % 10 < 8 then 'C' else 'G' end gapfill, cast(k as varchar) umi from ev),
ci as (select *, row_number() over (order by first_read, barcode, probe_barcode) - 1 cell_idx from (select barcode, probe_barcode, min(read_id) first_read from r group by all)),
m0 as (select ci.cell_idx, r.probe_barcode, probe_idx, umi, gapfill, count(*) n, min(read_id) f from r join ci using (barcode, probe_barcode) group by all),
m as (select cell_idx, probe_barcode, probe_idx, umi, gapfill, n, sum(n) over w total, row_number() over (partition by cell_idx, probe_barcode, probe_idx, umi order by n desc, gapfill) i from m0 window w as (partition by cell_idx, probe_barcode, probe_idx, umi)),
mols as (select cell_idx, probe_barcode, probe_idx, gapfill, cast(total as bigint) pcr_duplicate_count, n / total percent_supporting from m where i = 1),
entries as (select probe_barcode, cell_idx, probe_idx, gapfill, count(*) n_umis, cast(sum(pcr_duplicate_count) as bigint) total_reads, sum(percent_supporting) / (count(*) + 1e-4) percent_supporting from mols group by all)"""


def _plex(spark, d):
    """Events as reads of four samples that share barcodes: molecules and cells."""
    kinds = {"click": 0, "error": 1, "purchase": 2, "signup": 3}
    probe = F.lit(4)
    for name, i in kinds.items():
        probe = F.when(F.col("event_type") == name, i).otherwise(probe)
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    reads = b.table(spark, d, "events").select(
        F.concat(F.lit("c"), (F.col("user_id") % 50).cast("string")).alias("barcode"), (F.floor(F.col("user_id") / 50) % 4 + 1).cast("string").alias("probe_barcode"),
        F.col("event_id").alias("read_id"), probe.cast("long").alias("probe_idx"), F.when(k % 10 < 8, "C").otherwise("G").alias("gapfill"), k.cast("string").alias("umi"),
    )
    cells = counts.cell_index(reads, ["barcode", "probe_barcode"])
    return molecules.consensus(reads.join(cells.drop("first_read"), ["barcode", "probe_barcode"])), cells


@query(f"with {PLEX_SQL} select e.probe_barcode, ci.barcode, e.cell_idx, probe_idx, gapfill, n_umis, total_reads, round(percent_supporting, 6) percent_supporting from entries e join ci on ci.cell_idx = e.cell_idx")
def count_matrix_by_plex(spark, d):
    mols, cells = _plex(spark, d)
    entries = counts.collect_counts(counts.of_cells(mols, cells), ("probe_barcode",))
    return entries.join(cells.select("cell_idx", "barcode"), "cell_idx").select("probe_barcode", "barcode", "cell_idx", "probe_idx", "gapfill", "n_umis", "total_reads", *r6("percent_supporting"))


@query(f"""with {PLEX_SQL}, f as (select distinct probe_barcode, probe_idx, gapfill from mols) select *, row_number() over (partition by probe_barcode order by probe_idx, gapfill) - 1 feature_idx from f""")
def features_by_plex(spark, d):
    return counts.feature_dictionary(_plex(spark, d)[0], ("probe_barcode",))


@query(f"""with {PLEX_SQL}, u as (select ci.probe_barcode p, coalesce(sum(n_umis), 0) u from ci left join entries e on e.cell_idx = ci.cell_idx group by p, ci.cell_idx),
c as (select probe_barcode p, count(distinct cell_idx) c from entries group by p, probe_idx, gapfill), s as (select probe_barcode p, sum(total_reads) r from entries group by p, cell_idx, probe_idx),
t as (select p, 'TOTAL_CELLS' statistic, cast(count(*) as double) "value" from u group by p union all select p, 'TOTAL_UMIS', sum(u) from u group by p union all select p, 'GAPFILL_CONTAINING_CELLS', count(*) filter (u > 0) from u group by p
union all select p, 'UMIS_PER_CELL_MEAN', avg(u) from u group by p union all select p, 'UMIS_PER_CELL_MEDIAN', median(u) from u group by p union all select p, 'UMIS_PER_CELL_STD', stddev_pop(u) from u group by p union all select p, 'UMIS_PER_CELL_MIN', min(u) from u group by p
union all select p, 'UMIS_PER_CELL_MIN_EXCLUDING_ZERO', min(u) filter (u > 0) from u group by p union all select p, 'UMIS_PER_CELL_MAX', max(u) from u group by p union all select p, 'CELLS_PER_GAPFILL_MEAN', avg(c) from c group by p union all select p, 'CELLS_PER_GAPFILL_MEDIAN', median(c) from c group by p
union all select p, 'CELLS_PER_GAPFILL_STD', stddev_pop(c) from c group by p union all select p, 'CELLS_PER_GAPFILL_MIN', min(c) from c group by p union all select p, 'CELLS_PER_GAPFILL_MAX', max(c) from c group by p union all select p, 'SEQUENCING_SATURATION', 1 - count(*) / sum(r) from s group by p)
select p probe_barcode, statistic, round("value", 6) "value" from t""")
def summary_by_plex(spark, d):
    mols, cells = _plex(spark, d)
    return counts.summarize_by(counts.collect_counts(mols, ("probe_barcode",)), cells).withColumn("value", F.round("value", 6))


CHAIN_SQL = """ev as (select event_id read_id, user_id cell_idx, cast(event_id % 3 as bigint) probe_idx, cast(regexp_extract(props, '([0-9]+)', 1) as int) k from events),
reads as (select read_id, cell_idx, probe_idx, '1' probe_barcode, concat(substr('ACGT', k % 4 + 1, 1), substr('ACGT', k // 4 % 4 + 1, 1), substr('ACGT', k // 16 % 4 + 1, 1), substr('ACGT', read_id % 4 + 1, 1), 'ACGTAC') umi from ev),
pairs as (select cell_idx, probe_idx, umi, count(*) n, min(read_id) f from reads group by all),
firsts as (select cell_idx, umi, min({'p': -probe_idx, 'n': -n, 'f': f}) v from pairs group by all),
nodes as (select *, row_number() over (partition by cell_idx order by v, umi) r from firsts)"""


@query(f"""with recursive {CHAIN_SQL}, walk as (select cell_idx, umi, r, [umi] accepted, umi corrected_umi from nodes where r = 1
union all select n.cell_idx, n.umi, n.r, case when len(list_filter(w.accepted, lambda a: hamming(a, n.umi) <= 1)) = 0 then list_append(w.accepted, n.umi) else w.accepted end,
 coalesce(list_filter(w.accepted, lambda a: hamming(a, n.umi) <= 1)[1], n.umi) from walk w join nodes n on n.cell_idx = w.cell_idx and n.r = w.r + 1)
select read_id, umi, corrected_umi from reads join walk using (cell_idx, umi)""")
def umi_correction_chains(spark, d):
    """Identifiers that form chains and compete for neighbours: what is accepted depends on the order of visits."""
    k, letter = F.regexp_extract("props", "([0-9]+)", 1).cast("int"), lambda i: F.lit("ACGT").substr((i + 1).cast("int"), F.lit(1))
    reads = b.table(spark, d, "events").select(
        F.col("event_id").alias("read_id"), F.col("user_id").alias("cell_idx"), (F.col("event_id") % 3).cast("long").alias("probe_idx"), F.lit("1").alias("probe_barcode"),
        F.concat(letter(k % 4), letter(F.floor(k / 4) % 4), letter(F.floor(k / 16) % 4), letter(F.col("event_id") % 4), F.lit("ACGTAC")).alias("umi"),
    )
    return molecules.correct_umis(reads).select("read_id", "umi", "corrected_umi")


# Groups of cells


@query(f"""with {b.WIDE_SQL}, {NATION_SQL}, z as (select grp, count(*) cells from g group by 1)
select grp, probe_idx, gapfill, round(sum(n_umis) / any_value(cells), 6) mean, round(count(distinct cell_idx) / any_value(cells), 6) fraction from entries join g using (cell_idx) join z using (grp) group by grp, probe_idx, gapfill""")
def expression_by_group(spark, d):
    return report.expression_by_group(b.wide_entries(spark, d), _groups(spark, d)).select("grp", "probe_idx", "gapfill", *r6("mean", "fraction"))


@query(f"""with {b.WIDE_SQL}, {NATION_SQL}, {ALLELES}, {EXPECTED}
select grp, probe_idx, cast(coalesce(sum(n_umis) filter (gapfill = wt_gapfill), 0) as bigint) wt, cast(coalesce(sum(n_umis) filter (gapfill = alt_gapfill), 0) as bigint) alt, cast(coalesce(sum(n_umis) filter (gapfill not in (wt_gapfill, alt_gapfill)), 0) as bigint) other, any_value(expected_genotype) expected_genotype
from entries join g using (cell_idx) join t using (probe_idx) left join x using (grp) group by grp, probe_idx""")
def pseudobulk_alleles(spark, d):
    return report.pseudobulk_alleles(b.wide_entries(spark, d), _groups(spark, d), _truth(spark), _expected(spark, d))


METHODS_SQL = "e as (select 'dual' as \"method\", l_suppkey cell_idx, cast(l_linenumber as bigint) probe_idx, l_returnflag || l_linestatus gapfill from lineitem where l_discount > 0.08 and l_tax > 0.06 union all select 'gapfill', l_suppkey, l_linenumber, l_returnflag || l_linestatus from lineitem where l_discount < 0.01 and l_tax > 0.06)"


@query(f"""with {METHODS_SQL}, {NATION_SQL}, {ALLELES}, {EXPECTED}, k as (select "method", cell_idx, probe_idx, count(distinct gapfill) k, min(gapfill) f from e group by all),
c as (select "method", cell_idx, probe_idx, case when k > 1 then 'HET' when f = wt_gapfill then 'WT' when f = alt_gapfill then 'ALT' else 'Other' end call from k join t using (probe_idx))
select "method", probe_idx, expected_genotype true_call, count(*) n_cells, round(avg(cast(call = expected_genotype as int)), 6) correct from c join g using (cell_idx) join x using (grp) where expected_genotype in ('WT', 'ALT') group by all""")
def accuracy_by_method(spark, d):
    """Two methods' entries of the same cells, taken by two kinds of lines: calls against what a group should have."""
    li = b.table(spark, d, "lineitem").filter("l_tax > 0.06")
    of = lambda x: x.groupBy(F.col("l_suppkey").alias("cell_idx"), F.col("l_linenumber").cast("long").alias("probe_idx"), F.concat("l_returnflag", "l_linestatus").alias("gapfill")).agg(F.count(F.lit(1)).alias("n_umis"))
    out = report.accuracy_by_method({"dual": of(li.filter("l_discount > 0.08")), "gapfill": of(li.filter("l_discount < 0.01"))}, _truth(spark), _groups(spark, d), _expected(spark, d))
    return out.withColumn("correct", F.round("correct", 6))


KINDS_SQL = "k as (select n_nationkey grp, cast(p as bigint) probe_idx, ['WT', 'ALT', 'HET', 'Unknown'][(n_nationkey * 3 + p * p) % 5 % 4 + 1] kind from nation, range(1, 8) r(p))"


def _kinds(spark, d):
    p = F.explode(F.sequence(F.lit(1), F.lit(7)))
    at = ((F.col("n_nationkey") * 3 + F.col("p") * F.col("p")) % 5 % 4 + 1).cast("int")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("WT", "ALT", "HET", "Unknown")]), at)
    return b.table(spark, d, "nation").withColumn("p", p).select(F.col("n_nationkey").alias("grp"), F.col("p").cast("long").alias("probe_idx"), kind.alias("kind"))


@query(f"""with {b.WIDE_SQL}, {NATION_SQL}, {ALLELES}, {KINDS_SQL},
al as (select probe_idx, case a.kind when 'WT' then wt_gapfill else alt_gapfill end allele1, case z.kind when 'WT' then wt_gapfill else alt_gapfill end allele2 from k a join k z using (probe_idx) join t using (probe_idx) where a.grp = 0 and z.grp = 2 and a.kind in ('WT', 'ALT') and z.kind in ('WT', 'ALT') and a.kind <> z.kind),
ct as (select cell_idx, probe_idx + 1 probe_idx, sum(n_umis) ctl from entries where probe_idx < 7 group by all),
q as (select cell_idx, probe_idx, coalesce(sum(n_umis) filter (gapfill = allele1), 0) a, coalesce(sum(n_umis) filter (gapfill = allele2), 0) b from entries join al using (probe_idx) group by all),
n as (select cell_idx, a / (case when ctl > 0 then ctl + 1 else 1 end) a, b / (case when ctl > 0 then ctl + 1 else 1 end) b from q left join ct using (cell_idx, probe_idx)),
o as (select cell_idx, sum(a) support1, sum(b) support2 from n group by 1 having sum(a) > 0.1 or sum(b) > 0.1) select cell_idx, grp, round(support1, 6) support1, round(support2, 6) support2 from o join g using (cell_idx)""")
def support_by_cell(spark, d):
    """Each probe's control is the one before it."""
    alleles = report.discordant_alleles(_kinds(spark, d), _truth(spark), 0, 2)
    controls = spark.createDataFrame([(i, i - 1) for i in range(2, 8)], "probe_idx long, control_idx long")
    return report.support_by_cell(b.wide_entries(spark, d), alleles, _groups(spark, d), 0.1, controls).select("cell_idx", "grp", *r6("support1", "support2"))


def _line_sql(het: bool) -> str:
    rule = "d > 0 or h > 0" if het else "d > 0 and h = 0"
    return f"""with {KINDS_SQL}, o as (select a.probe_idx, a.kind, count(*) filter (z.kind = 'HET') h, count(*) filter (z.kind in ('WT', 'ALT') and z.kind = a.kind) s, count(*) filter (z.kind in ('WT', 'ALT') and z.kind <> a.kind) d
 from k a join k z on z.probe_idx = a.probe_idx and z.grp <> a.grp where a.grp = 5 and a.kind in ('WT', 'ALT') group by 1, 2) select probe_idx, kind, h het_groups, s same_groups from o where {rule}"""


@query(_line_sql(True))
def line_specific_probes(spark, d):
    return report.line_specific_probes(_kinds(spark, d), 5, True)


# Libraries


@query(f"with {b.WIDE_SQL} select cell_idx, cast(sum(n_umis) as bigint) library_size from entries where probe_idx <> 7 group by 1")
def library_sizes(spark, d):
    return report.library_sizes(b.wide_entries(spark, d), spark.createDataFrame([(7,)], "probe_idx long"))


@query(f"with {b.ENTRIES_SQL}, w as (select c_custkey cell_idx, sum(c_nationkey + 1) wta_size from customer group by 1), l as (select cell_idx, sum(n_umis) n from entries group by 1) select cell_idx, cast(wta_size as bigint) wta_size, cast(coalesce(n, 0) as bigint) gapfill_size from w left join l using (cell_idx)")
def compare_libraries(spark, d):
    wta = b.table(spark, d, "customer").select(F.col("c_custkey").alias("cell_idx"), F.lit("g").alias("gene"), (F.col("c_nationkey") + 1).alias("n"))
    return report.compare_libraries(wta, b.entries(spark, d))


@query(f"{CALLS}, s as (select cell_idx, count(distinct probe_idx) n from calls group by 1) select c_custkey cell_idx, coalesce(n, 0) n_genotyped, round(coalesce(n, 0) * 100 / 5, 6) percent, coalesce(n, 0) >= 1 any_genotyped from customer left join s on cell_idx = c_custkey")
def sites_genotyped(spark, d):
    cells = b.table(spark, d, "customer").select(F.col("c_custkey").alias("cell_idx"))
    return report.sites_genotyped(genotypes.call_genotypes(b.entries(spark, d), 0.6), 5, cells).withColumn("percent", F.round("percent", 6))


@query(f"with {b.WIDE_SQL}, s as (select cell_idx, probe_idx, sum(n_umis) n from entries group by all) select probe_idx, cast(sum(n) as bigint) n_umis, count(*) filter (n > 0) n_cells from s group by 1")
def molecules_by_probe(spark, d):
    return report.molecules_by_probe(b.wide_entries(spark, d))


@query(f"with {b.WIDE_SQL}, s as (select sum(n_umis) v from entries group by cell_idx, probe_idx), r as (select min(v) lo, max(v) hi from s) select cast(case when hi = lo then 0 else least(24, floor((v - lo) * 25 / (hi - lo))) end as int) bin, count(*) n from s, r group by 1")
def cell_probe_histogram(spark, d):
    return report.cell_probe_histogram(b.wide_entries(spark, d))


@query(f"""with {b.WIDE_SQL}, e2 as (select 'even' run, * from entries where probe_idx % 2 = 0 union all select 'odd', * from entries where probe_idx % 2 = 1), s as (select run, sum(total_reads) r from e2 group by run, cell_idx, probe_idx)
select run, round(1 - count(*) / sum(r), 9) saturation from s group by run""")
def saturations(spark, d):
    e = b.wide_entries(spark, d)
    return report.saturations({"even": e.filter("probe_idx % 2 = 0"), "odd": e.filter("probe_idx % 2 = 1")}, 10)[0].withColumn("saturation", F.round("saturation", 9))


@query(f"""with {b.ENTRIES_SQL}, p(probe_idx, name) as (values (0, 'AUTOMOBILE c.1A>T'), (1, 'BUILDING_x'), (2, 'FURNITURE'), (3, 'MACHINERY 0bp'), (4, 'NONE')),
w as (select c_custkey cell_idx, c_mktsegment gene, sum(c_nationkey + 1) n from customer group by all), s as (select cell_idx, probe_idx, sum(n_umis) n_umis from entries group by all)
select s.cell_idx, s.probe_idx, cast(n_umis as bigint) n_umis, cast(coalesce(w.n, 0) as bigint) gene_count from s join p using (probe_idx) left join w on w.cell_idx = s.cell_idx and w.gene = split_part(replace(name, ' ', '_'), '_', 1)""")
def probes_with_genes(spark, d):
    probes = spark.createDataFrame([(0, "AUTOMOBILE c.1A>T"), (1, "BUILDING_x"), (2, "FURNITURE"), (3, "MACHINERY 0bp"), (4, "NONE")], "probe_idx long, name string")
    wta = b.table(spark, d, "customer").select(F.col("c_custkey").alias("cell_idx"), F.col("c_mktsegment").alias("gene"), (F.col("c_nationkey") + 1).alias("n"))
    return report.probes_with_genes(b.entries(spark, d), probes, wta)


# Names


@query("""with p as (select p_partkey probe_idx, case when p_partkey % 5 = 0 then p_brand || ' 0bp' else p_brand || ' c.' || p_partkey end name, p_brand gene from part), c as (select gene, min(probe_idx) control_idx from p where name like '%0bp%' or name = gene group by 1)
select probe_idx, control_idx from p join c using (gene) where probe_idx <> control_idx""")
def probe_controls(spark, d):
    p = b.table(spark, d, "part")
    name = F.when(F.col("p_partkey") % 5 == 0, F.concat("p_brand", F.lit(" 0bp"))).otherwise(F.concat("p_brand", F.lit(" c."), F.col("p_partkey").cast("string")))
    return report.controls_of(p.select(F.col("p_partkey").alias("probe_idx"), name.alias("name"), F.col("p_brand").alias("gene")))


VARIANT_SQL = "v as (select p_partkey, 'ENS' || p_partkey || '|' || p_brand || '|c.' || p_size || substr('ACGT', p_partkey % 4 + 1, 1) || '>' || substr('ACGT', p_partkey // 4 % 4 + 1, 1) || '|h' as name from part)"


def _variant_names(spark, d):
    k, letter = F.col("p_partkey"), lambda i: F.lit("ACGT").substr((i + 1).cast("int"), F.lit(1))
    name = F.concat(F.lit("ENS"), k.cast("string"), F.lit("|"), "p_brand", F.lit("|c."), F.col("p_size").cast("string"), letter(k % 4), F.lit(">"), letter(F.floor(k / 4) % 4), F.lit("|h"))
    return b.table(spark, d, "part").select("p_partkey", name.alias("name"))


@query(f"with {VARIANT_SQL} select p_partkey, split_part(name, '|', 2) || ' ' || split_part(name, '|', 3) label, right(split_part(split_part(name, '|', 3), '>', 1), 1) wild, split_part(split_part(name, '|', 3), '>', 2) variant from v")
def variant_names(spark, d):
    out = _variant_names(spark, d).withColumn("label", report.probe_label(F.col("name")))
    return out.select("p_partkey", "label", report.variant_alleles(F.col("label")).alias("x")).select("p_partkey", "label", "x.*")


@query(f"""with {VARIANT_SQL}, n as (select distinct split_part(name, '|', 2) || ' ' || split_part(name, '|', 3) label from v), p as (select label mutant, split_part(label, '>', 1) || '>' || right(split_part(label, '>', 1), 1) wild, split_part(label, '>', 2) variant, right(split_part(label, '>', 1), 1) reference from n)
select * from p where variant <> reference and wild in (select label from n)""")
def dual_probe_pairs(spark, d):
    return report.dual_probe_pairs(_variant_names(spark, d).select(report.probe_label(F.col("name")).alias("name")))


@query(f"""with {VARIANT_SQL}, l as (select p_partkey, split_part(name, '|', 2) || ' ' || split_part(name, '|', 3) label from v), n as (select distinct label from l), p as (select label mutant, split_part(label, '>', 1) || '>' || right(split_part(label, '>', 1), 1) wild, split_part(label, '>', 2) variant, right(split_part(label, '>', 1), 1) reference from n where split_part(label, '>', 2) <> right(split_part(label, '>', 1), 1)),
q as (select * from p where wild in (select label from n)), e as (select l_suppkey cell_idx, label, count(*) n_umis from lineitem join l on p_partkey = l_partkey where l_returnflag <> 'R' group by all)
select cell_idx, mutant as name, variant gapfill, n_umis from e join q on label = mutant union all select cell_idx, mutant, reference, n_umis from e join q on label = wild""")
def recast_dual_probes(spark, d):
    """Lines with returns stand for molecules that have a gapfill, which such probes shouldn't."""
    named = _variant_names(spark, d).select("p_partkey", report.probe_label(F.col("name")).alias("name"))
    e = b.table(spark, d, "lineitem").join(named, F.col("l_partkey") == F.col("p_partkey"))
    e = e.groupBy(F.col("l_suppkey").alias("cell_idx"), "name", F.when(F.col("l_returnflag") == "R", "A").otherwise("").alias("gapfill")).agg(F.count(F.lit(1)).alias("n_umis"))
    return report.recast_dual_probes(e, report.dual_probe_pairs(named))


# Samples, selections, logos, graphs


@query("select 'a-' || c_name barcode, 'a' \"sample\", c_nationkey nation, null::varchar segment from customer where c_custkey % 2 = 0 union all select 'b-' || c_name, 'b', null, c_mktsegment from customer where c_custkey % 2 = 1")
def combined_samples(spark, d):
    c = b.table(spark, d, "customer")
    one, two = c.filter("c_custkey % 2 = 0").select(F.col("c_name").alias("barcode"), F.col("c_nationkey").alias("nation")), c.filter("c_custkey % 2 = 1").select(F.col("c_name").alias("barcode"), F.col("c_mktsegment").alias("segment"))
    return report.combined({"a": one, "b": two}).select("barcode", "sample", "nation", "segment")


@query("select c_custkey cell_idx from customer where c_custkey not in (select user_id from events)")
def missing_cells(spark, d):
    return report.missing_cells(b.table(spark, d, "customer").select(F.col("c_custkey").alias("cell_idx")), b.table(spark, d, "events").select(F.col("user_id").alias("cell_idx")))


LOGO_SQL = """w as (select *, max(length(gapfill)) over (partition by probe_idx) w from f), p as (select probe_idx, i - 1 position, substr(rpad(gapfill, cast(w as int), '-'), cast(i as int), 1) base, v from (select *, unnest(range(1, w + 1)) i from w)),
logo as (select probe_idx, position, base, sum(v) / sum(sum(v)) over (partition by probe_idx, position) share from p group by probe_idx, position, base)"""


@query(f"""with {b.ENTRIES_SQL}, o as (select probe_idx, gapfill, sum(n_umis) filter (cell_idx % 2 = 0) a, sum(n_umis) filter (cell_idx % 2 = 1) z from entries group by all),
x as (select probe_idx, i - 1 position, substr(rpad(gapfill, cast(w as int), '-'), cast(i as int), 1) base, a v from (select *, unnest(range(1, w + 1)) i from (select *, max(length(gapfill)) over (partition by probe_idx) w from o where a is not null))),
y as (select probe_idx, i - 1 position, substr(rpad(gapfill, cast(w as int), '-'), cast(i as int), 1) base, z v from (select *, unnest(range(1, w + 1)) i from (select *, max(length(gapfill)) over (partition by probe_idx) w from o where z is not null))),
lx as (select probe_idx, position, base, sum(v) / sum(sum(v)) over (partition by probe_idx, position) s from x group by probe_idx, position, base), ly as (select probe_idx, position, base, sum(v) / sum(sum(v)) over (partition by probe_idx, position) s from y group by probe_idx, position, base)
select probe_idx, cast(position as int) position, base, round(coalesce(lx.s, 0) - coalesce(ly.s, 0), 6) difference from lx full join ly using (probe_idx, position, base)""")
def logo_difference(spark, d):
    e = b.entries(spark, d)
    f = lambda r: genotypes.genotype_frequencies(e, e.filter(F.col("cell_idx") % 2 == r), "raw")
    return report.logo_difference(f(0), f(1)).withColumn("difference", F.round("difference", 6))


@query(f"""with {b.ENTRIES_SQL}, f as (select probe_idx, gapfill, sum(n_umis) v from entries group by all), {LOGO_SQL}
select probe_idx, cast(max(position) over (partition by probe_idx) - position as int) position, translate(base, 'ACGT', 'TGCA') base, round(share, 6) share from logo""")
def logo_reverse_complement(spark, d):
    e = b.entries(spark, d)
    return report.reverse_complement_logo(genotypes.logo_matrix(genotypes.genotype_frequencies(e, e, "raw"))).withColumn("share", F.round("share", 6))


@query(f"{CALLS} select probe_idx, gapfill, cast(count(*) as double) \"value\" from (select probe_idx, unnest(string_split(genotype, '/')) gapfill from calls) group by probe_idx, gapfill")
def genotype_frequencies_cells(spark, d):
    e = b.entries(spark, d)
    return genotypes.genotype_frequencies(genotypes.call_genotypes(e, 0.6), e, "cells")


@query(f"with {b.ENTRIES_SQL} select probe_idx, gapfill, round(sum(s), 6) \"value\" from (select probe_idx, gapfill, n_umis / sum(n_umis) over (partition by cell_idx, probe_idx) s from entries) group by all")
def genotype_frequencies_relative(spark, d):
    e = b.entries(spark, d)
    return genotypes.genotype_frequencies(genotypes.call_genotypes(e, 0.6), e, "relative").withColumn("value", F.round("value", 6))


@query(f"{CALLS} select cell_idx, probe_idx, case when list_contains(string_split(genotype, '/'), 'ACT') and list_contains(string_split(genotype, '/'), 'CCT') then 'HET' when list_contains(string_split(genotype, '/'), 'ACT') then 'WT' when list_contains(string_split(genotype, '/'), 'CCT') then 'ALT' else 'Other' end kind from calls")
def allele_presence(spark, d):
    calls = genotypes.call_genotypes(b.entries(spark, d), 0.6)
    return calls.select("cell_idx", "probe_idx", genotypes.allele_presence(calls, F.lit("ACT"), F.lit("CCT")).alias("kind"))


NEAR_SQL = """x as (select cell_idx % 7 cluster, cell_idx, probe_idx, genotype, string_split(genotype, '/') s from calls),
pd as (select a.cell_idx a, b.cell_idx b, sqrt(sum(len([z for z in a.s if not list_contains(b.s, z)]) + len([z for z in b.s if not list_contains(a.s, z)]))) / count(*) d from x a join x b on a.cluster = b.cluster and a.probe_idx = b.probe_idx and a.cell_idx <> b.cell_idx group by 1, 2),
kn as (select * from (select a src, b dst, d, row_number() over (partition by a order by d, b) r from pd) where r <= 5)"""


@query(f"{CALLS}, {NEAR_SQL} select src, dst, round(d, 6) distance, cast(r as int) rank from kn")
def genotype_knn(spark, d):
    calls = genotypes.call_genotypes(b.entries(spark, d), 0.6).withColumn("cluster", F.col("cell_idx") % 7)
    return knn.genotype_neighbours(calls, 5).select("src", "dst", *r6("distance"), "rank")


BIN_CALLS = f"""with entries as (select (l_orderkey % 64) * 64 + l_partkey % 64 cell_idx, cast(l_linenumber as bigint) probe_idx, l_returnflag gapfill, count(*) n_umis from lineitem group by all), {b.CALLS_SQL.format(t=0.5)},
x as (select cell_idx // 64 cluster, cell_idx, probe_idx, genotype, string_split(genotype, '/') s from calls),
pd as (select a.cell_idx a, b.cell_idx b, sqrt(sum(len([z for z in a.s if not list_contains(b.s, z)]) + len([z for z in b.s if not list_contains(a.s, z)]))) / count(*) d from x a join x b on a.cluster = b.cluster and a.probe_idx = b.probe_idx and a.cell_idx <> b.cell_idx group by 1, 2),
kn as (select * from (select a src, b dst, row_number() over (partition by a order by d, b) r from pd) where r <= 5)"""


@query(f"""{BIN_CALLS}, v as (select src cell_idx, y.probe_idx, y.genotype, count(*) n from kn join calls y on y.cell_idx = dst where not exists (select 1 from calls c where c.cell_idx = src and c.probe_idx = y.probe_idx) group by all),
w as (select *, sum(n) over (partition by cell_idx, probe_idx) t, sum(n) over (partition by cell_idx, probe_idx order by n desc, genotype desc rows unbounded preceding) u from v)
select cell_idx, probe_idx, string_agg(genotype, '/' order by u) genotype, round(max(u) / max(t), 6) certainty from w where u - n < 0.66 * t group by all""")
def genotype_imputation(spark, d):
    """Bins of the grid as cells, its rows as clusters: probes that a bin lacks are taken from the five nearest bins."""
    calls = genotypes.call_genotypes(b.spatial_entries(spark, d).withColumn("cell_idx", F.col("row") * 64 + F.col("col")))
    cells = calls.select("cell_idx", F.floor(F.col("cell_idx") / 64).alias("cluster")).distinct()
    return knn.impute_genotypes(calls, cells, k=5)[0].withColumn("certainty", F.round("certainty", 6))


@query(f"""with {b.SPATIAL_SQL}, f as (select *, row_number() over w k, sum(n_umis) over w upto, sum(n_umis) over (partition by "row", col) total from entries where probe_idx = 1 window w as (partition by "row", col order by n_umis desc, gapfill desc rows unbounded preceding))
select "row", col, string_agg(gapfill, '/' order by k) genotype from f where upto - n_umis < 0.5 * total group by "row", col""")
def spatial_genotypes(spark, d):
    e = b.spatial_entries(spark, d).withColumn("cell_idx", F.col("row") * 64 + F.col("col"))
    cells = e.filter("probe_idx = 1").select("cell_idx", "row", "col").distinct()
    return spatial.genotype_map(genotypes.call_genotypes(e), cells, 1)[0]


@query(f"""with {b.SPATIAL_SQL}, a as (select r resolution, cast("row" // (r // 2) as bigint) "row", cast(col // (r // 2) as bigint) col, probe_idx, gapfill, cast(sum(n_umis) as bigint) n_umis from entries, (select unnest([8, 16]) r) where not (("row" // 8 + col // 8 + probe_idx) % 4 = 0) group by all),
k as (select *, sum(n_umis) over w upto, sum(n_umis) over (partition by resolution, "row", col, probe_idx) total from a window w as (partition by resolution, "row", col, probe_idx order by n_umis desc, gapfill desc rows unbounded preceding)),
c as (select resolution, "row", col, probe_idx, string_agg(gapfill, '/' order by n_umis desc, gapfill desc) genotype from k where upto - n_umis < 0.5 * total group by all),
v as (select resolution, probe_idx, "row", col, string_split(genotype, '/') s from c),
calls as (select resolution, count(*) n_calls, count(distinct ("row", col)) n_bins from v group by 1) select cast(resolution as int) resolution, n_calls, n_bins from calls""")
def calls_by_resolution(spark, d):
    """Calls on two grids, of bins that lack some probes."""
    e = b.spatial_entries(spark, d).filter("not ((floor(row / 8) + floor(col / 8) + probe_idx) % 4 = 0)")
    parts = [genotypes.call_genotypes(spatial.bin_entries(e, (r,)).withColumn("cell_idx", F.struct("row", "col"))).agg(F.lit(r).alias("resolution"), F.count(F.lit(1)).alias("n_calls"), F.countDistinct("cell_idx").alias("n_bins")) for r in (8, 16)]
    return parts[0].unionByName(parts[1])


@query(None)
def aligned_gapfills(spark, d):
    """Gapfills of two lengths, aligned by a dynamic programme; SQL has none."""
    e = b.entries(spark, d)
    return align.align_gapfills(genotypes.genotype_frequencies(e, e, "raw"))
