"""Every registered query: an operator applied to a binding of the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import counts, filters, fuzzy, genotypes, knn, manifest, mapping, molecules, offbyone, spatial, stats
from . import bindings as b
from .registry import ORACLES, QUERIES, query, r6

__all__ = ["ORACLES", "QUERIES"]


# Molecules and counts


@query(f"with {b.ENTRIES_SQL} select cell_idx, probe_idx, gapfill, n_umis, total_reads, round(percent_supporting, 6) percent_supporting from entries")
def count_matrix(spark, d):
    return b.entries(spark, d).select("cell_idx", "probe_idx", "gapfill", "n_umis", "total_reads", *r6("percent_supporting"))


@query(f"with {b.MOLECULES_SQL} select cell_idx, probe_idx, probe_barcode, umi, gapfill, pcr_duplicate_count, round(percent_supporting, 6) percent_supporting, percent_supporting < 1 corrected from molecules")
def gapfill_consensus(spark, d):
    return b.molecules(spark, d).withColumn("percent_supporting", F.round("percent_supporting", 6))


CORRECTED_SQL = b.READS_SQL + """,
pairs as (select cell_idx, probe_barcode, probe_idx, umi, count(*) n, min(read_id) f from reads group by all),
fixed as (select *, first_value(umi) over (partition by cell_idx, probe_barcode, substr(umi, 1, 11) order by probe_idx desc, n desc, f) corrected_umi from pairs)"""


@query(f"with {CORRECTED_SQL} select r.read_id, r.umi, f.corrected_umi from reads r join fixed f using (cell_idx, probe_barcode, probe_idx, umi)")
def umi_correction(spark, d):
    return molecules.correct_umis(b.reads(spark, d)).select("read_id", "umi", "corrected_umi")


@query(f"""with {CORRECTED_SQL}, c as (select r.*, f.corrected_umi from reads r join fixed f using (cell_idx, probe_barcode, probe_idx, umi)),
g as (select cell_idx, probe_barcode, corrected_umi, probe_idx, row_number() over (partition by cell_idx, probe_barcode, corrected_umi order by count(*) desc, probe_idx desc) r from c group by cell_idx, probe_barcode, corrected_umi, probe_idx)
select c.read_id, c.corrected_umi, c.probe_idx from c join g using (cell_idx, probe_barcode, corrected_umi, probe_idx) where r = 1""")
def chimera_removal(spark, d):
    return molecules.remove_chimeras(molecules.correct_umis(b.reads(spark, d))).select("read_id", "corrected_umi", "probe_idx")


@query(f"with {b.READS_SQL}, c as (select cast(cell_idx as varchar) barcode, min(read_id) first_read from reads group by 1) select barcode, first_read, row_number() over (order by first_read, barcode) - 1 cell_idx from c")
def cell_index(spark, d):
    return counts.cell_index(b.reads(spark, d).withColumn("barcode", F.col("cell_idx").cast("string")))


@query(f"with {b.MOLECULES_SQL}, f as (select distinct probe_idx, gapfill from molecules) select probe_idx, gapfill, row_number() over (order by probe_idx, gapfill) - 1 feature_idx from f")
def feature_dictionary(spark, d):
    return counts.feature_dictionary(b.molecules(spark, d))


@query(f"with {b.MOLECULES_SQL} select cell_idx, probe_idx, gapfill, cast(t as int) threshold, count(*) n_umis from (select *, unnest(range(1, least(10, pcr_duplicate_count) + 1)) t from molecules) group by all")
def pcr_threshold_layers(spark, d):
    return counts.pcr_layers(b.molecules(spark, d))


@query(f"with {b.MOLECULES_SQL} select cell_idx, probe_idx, gapfill, count(*) n_umis, cast(sum(pcr_duplicate_count) as bigint) total_reads, round(sum(percent_supporting) / (count(*) + 1e-4), 6) percent_supporting from molecules where pcr_duplicate_count >= 3 group by all")
def pcr_filter(spark, d):
    return counts.with_min_duplicates(b.molecules(spark, d), 3).withColumn("percent_supporting", F.round("percent_supporting", 6))


@query(f"""with {b.MOLECULES_SQL}, m(probe_idx, name) as (values (0, 'click'), (1, 'error'), (2, 'buy/sell'), (3, 'signup'), (4, 'view'))
select cell_idx, 'c' || cell_idx barcode, probe_idx, split_part(name, '/', 1) lhs_name, case when name like '%/%' then split_part(name, '/', 2) else name end rhs_name, umi, gapfill, pcr_duplicate_count from molecules join m using (probe_idx)""")
def flat_file(spark, d):
    mols = b.molecules(spark, d)
    names = spark.createDataFrame([(0, "click"), (1, "error"), (2, "buy/sell"), (3, "signup"), (4, "view")], "index long, name string")
    cells = mols.select("cell_idx").distinct().withColumn("barcode", F.concat(F.lit("c"), F.col("cell_idx").cast("string")))
    return counts.flat_file(mols, names, cells).select("cell_idx", "barcode", "probe_idx", "lhs_name", "rhs_name", "umi", "gapfill", "pcr_duplicate_count")


STATES_SQL = b.READS_SQL + """,
s as (select case when k % 7 = 0 then null else probe_idx end probe_idx, case when k % 7 = 0 then ['FILTERED_NO_LHS'] when k % 5 = 0 then ['CORRECTED_LHS', 'CORRECTED_RHS'] when k % 5 = 1 then ['CORRECTED_BARCODE'] else ['EXACT'] end states from reads),
m as (select unnest(states) metric, count(*) "value" from s group by 1 union all select 'TOTAL_READS', count(*) from s union all select 'PROBE_CONTAINING_READS', count(probe_idx) from s
 union all select 'PROBES_ENCOUNTERED', count(distinct probe_idx) from s union all select 'POSSIBLE_PROBES', 5)"""


def _metrics(spark, d):
    k = F.col("k")
    states = F.when(k % 7 == 0, F.array(F.lit("FILTERED_NO_LHS"))).when(k % 5 == 0, F.array(F.lit("CORRECTED_LHS"), F.lit("CORRECTED_RHS"))).when(k % 5 == 1, F.array(F.lit("CORRECTED_BARCODE"))).otherwise(F.array(F.lit("EXACT")))
    return counts.state_metrics(b.reads(spark, d).select(F.when(k % 7 != 0, F.col("probe_idx")).alias("probe_idx"), states.alias("states")), probes=5)


@query(f'with {STATES_SQL} select metric, cast("value" as bigint) "value" from m')
def read_state_metrics(spark, d):
    return _metrics(spark, d)


@query(f"""with {STATES_SQL}, f(src, dst, metric) as (values {", ".join("('%s', '%s', '%s')" % x for x in stats.FLOWS)})
select src, dst, cast(coalesce(m."value", 0) as bigint) "value" from f left join m using (metric)""")
def read_flow_edges(spark, d):
    return stats.flow_edges(_metrics(spark, d))


@query(f"""with {b.WIDE_SQL}, w as (select probe_idx, count(distinct gapfill) k from entries group by 1)
select cell_idx, probe_idx, cast(sum(n_umis) as bigint) n_umis, cast(sum(total_reads) as bigint) total_reads, round(sum(percent_supporting) / any_value(k), 6) percent_supporting from entries join w using (probe_idx) group by all""")
def collapse_probe(spark, d):
    return counts.collapse_gapfills(b.wide_entries(spark, d)).withColumn("percent_supporting", F.round("percent_supporting", 6))


@query(f"with {b.WIDE_SQL} select round(1 - count(*) / sum(r), 9) saturation from (select sum(total_reads) r from entries group by cell_idx, probe_idx)")
def saturation(spark, d):
    return counts.saturation(b.wide_entries(spark, d)).select(F.round("saturation", 9).alias("saturation"))


@query(f"""with {b.WIDE_SQL}, p as (select sum(total_reads) r from entries group by cell_idx, probe_idx), c as (select count(distinct cell_idx) n from entries),
f as (select 1e-5 + i * ((1 - 1e-5) / 19) fraction from range(0, 20) t(i))
select round(fraction, 6) fraction, round(sum(r * fraction) / any_value(n), 4) mean_reads_per_cell, round(1 - sum(1 - pow(1 - fraction, r)) / sum(r * fraction), 6) saturation from f, p, c group by fraction""")
def saturation_curve_expected(spark, d):
    out = counts.saturation_curve(b.wide_entries(spark, d), 20)
    return out.select(*r6("fraction"), F.round("mean_reads_per_cell", 4).alias("mean_reads_per_cell"), *r6("saturation"))


@query(f"""with {b.WIDE_SQL}, u as (select s_suppkey, coalesce(sum(n_umis), 0) u from supplier left join entries e on cell_idx = s_suppkey group by 1),
c as (select count(distinct cell_idx) c from entries group by probe_idx, gapfill),
s as (select 1 - count(*) / sum(r) v from (select sum(total_reads) r from entries group by cell_idx, probe_idx)),
t as (select 'TOTAL_CELLS' statistic, cast(count(*) as double) "value" from u union all select 'TOTAL_UMIS', sum(u) from u union all select 'GAPFILL_CONTAINING_CELLS', count(*) filter (u > 0) from u
union all select 'UMIS_PER_CELL_MEAN', avg(u) from u union all select 'UMIS_PER_CELL_MEDIAN', median(u) from u union all select 'UMIS_PER_CELL_STD', stddev_pop(u) from u union all select 'UMIS_PER_CELL_MIN', min(u) from u
union all select 'UMIS_PER_CELL_MIN_EXCLUDING_ZERO', min(u) filter (u > 0) from u union all select 'UMIS_PER_CELL_MAX', max(u) from u union all select 'CELLS_PER_GAPFILL_MEAN', avg(c) from c union all select 'CELLS_PER_GAPFILL_MEDIAN', median(c) from c
union all select 'CELLS_PER_GAPFILL_STD', stddev_pop(c) from c union all select 'CELLS_PER_GAPFILL_MIN', min(c) from c union all select 'CELLS_PER_GAPFILL_MAX', max(c) from c union all select 'SEQUENCING_SATURATION', v from s)
select statistic, round("value", 6) "value" from t""")
def summary_stats(spark, d):
    cells = b.table(spark, d, "supplier").select(F.col("s_suppkey").alias("cell_idx"))
    return counts.summarize(b.wide_entries(spark, d), cells).withColumn("value", F.round("value", 6))


@query(f"with {b.WIDE_SQL}, t as (select sum(n_umis) n_umis from entries group by cell_idx) select cast(n_umis as bigint) n_umis, count(*) n_cells, cast(sum(count(*)) over (order by n_umis desc) as bigint) rank from t group by n_umis")
def knee_rank(spark, d):
    return counts.barcode_ranks(b.wide_entries(spark, d))


@query(f"""with {b.MOLECULES_SQL}, v as (select log10(pcr_duplicate_count + 1) v from molecules), t as (select max(v) top from v)
select cast(least(99, floor(v * 100 / top)) as bigint) bin, count(*) n from v, t group by 1""")
def pcr_histogram(spark, d):
    return counts.duplicate_histogram(b.molecules(spark, d))


@query(f"with {b.WIDE_SQL}, s as (select probe_idx, gapfill, cast(sum(total_reads) as bigint) reads from entries group by all) select probe_idx, gapfill, reads, cast(row_number() over (order by reads desc, probe_idx, gapfill) as int) rank, round(avg(reads) over (), 4) uniform from s")
def reads_per_feature(spark, d):
    return counts.reads_per_feature(b.wide_entries(spark, d)).withColumn("uniform", F.round("uniform", 4))


@query(f"with {b.ENTRIES_SQL}, c as (select count(distinct user_id) n from events), s as (select cell_idx, probe_idx, sum(n_umis) v from entries group by all), a as (select count(distinct probe_idx) p from s), g as (select coalesce(s.v, 0) v from (select distinct user_id cell_idx from events) x cross join (select distinct probe_idx from s) y left join s using (cell_idx, probe_idx)) select any_value(p) probes, round(avg(v), 6) mean, cast(median(v) as double) median from g, a")
def dense_summary(spark, d):
    n = b.table(spark, d, "events").select("user_id").distinct().count()
    return stats.dense_summary(b.entries(spark, d), n).withColumn("mean", F.round("mean", 6))


# Filters


@query(f"""with {b.WIDE_SQL}, k as (select * from entries where total_reads >= 60 and percent_supporting >= 0.3 and n_umis >= 2), c as (select probe_idx, gapfill from k group by all having count(*) >= 20)
select cell_idx, probe_idx, gapfill, n_umis, total_reads, round(percent_supporting, 6) percent_supporting from k join c using (probe_idx, gapfill)""")
def filter_gapfills(spark, d):
    return filters.filter_gapfills(b.wide_entries(spark, d), 20, 2, 60, 0.3).select("cell_idx", "probe_idx", "gapfill", "n_umis", "total_reads", *r6("percent_supporting"))


WIDE_CALLS = f"with {b.WIDE_SQL}, {b.CALLS_SQL.format(t=0.5)}"
EVENT_CALLS = f"with {b.ENTRIES_SQL}, {b.CALLS_SQL.format(t=0.6)}"


@query(f"""{WIDE_CALLS}, s as (select *, case when n_umis >= 3 and proportion >= 0.4 then genotype end g from calls),
c as (select probe_idx, g, count(*) n, row_number() over (partition by probe_idx order by count(*) desc, g) r from s where g is not null group by probe_idx, g)
select s.cell_idx, s.probe_idx, c.g genotype, s.n_umis, round(s.proportion, 6) proportion from s left join (select * from c where r <= 3 and n >= 5) c on s.probe_idx = c.probe_idx and s.g = c.g""")
def filter_genotypes_topn(spark, d):
    calls = genotypes.call_genotypes(b.wide_entries(spark, d))
    return filters.filter_genotypes(calls, 3, 5, 0.4, 3).select("cell_idx", "probe_idx", "genotype", "n_umis", *r6("proportion"))


@query(f"""with {b.ENTRIES_SQL}, l as (select 'c' || c_custkey barcode, c_custkey * 2 cell_idx, c_custkey k from customer where c_custkey % 3 = 0)
select l.cell_idx, l.barcode, e.probe_idx, e.gapfill, e.n_umis, e.cell_idx is null and not exists (select 1 from entries x where x.cell_idx = l.k) padded from l left join entries e on e.cell_idx = l.k""")
def barcode_filter_padded(spark, d):
    e = b.entries(spark, d)
    cells = e.select("cell_idx").distinct().withColumn("barcode", F.concat(F.lit("c"), F.col("cell_idx").cast("string")))
    listed = b.table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("barcode"), (F.col("c_custkey") * 2).alias("position"))
    moved, new = filters.filter_barcodes(e, cells, listed)
    return new.join(moved, "cell_idx", "left").select("cell_idx", "barcode", "probe_idx", "gapfill", "n_umis", "padded")


@query(f"with {b.ENTRIES_SQL} select cell_idx, probe_idx, gapfill, n_umis from entries where cell_idx in (select c_custkey from customer where c_mktsegment in ('BUILDING', 'MACHINERY'))")
def intersect_wta(spark, d):
    wta = b.table(spark, d, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(F.col("c_custkey").alias("cell_idx"))
    return filters.intersect_cells(b.entries(spark, d), wta)[0].select("cell_idx", "probe_idx", "gapfill", "n_umis")


@query("""with w as (select l_suppkey cell_idx, 'G' || (l_partkey % 50) gene, count(*) n from lineitem group by all), c as (select cell_idx, sum(n) t, sum(case when gene like 'G1%' then n else 0 end) m from w group by 1),
k as (select w.* from w join c using (cell_idx) where t >= 40 and m < 0.25 * t) select cell_idx, gene, n from k where gene in (select gene from k group by 1 having count(*) >= 10)""")
def expressed_cells(spark, d):
    w = b.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("cell_idx"), F.concat(F.lit("G"), (F.col("l_partkey") % 50).cast("string")).alias("gene")).agg(F.count(F.lit(1)).alias("n"))
    return filters.expressed_cells(w, 40, 10, 0.25, "gene like 'G1%'").select("cell_idx", "gene", "n")


@query(f"""with {b.SPATIAL_SQL}, e as (select * from (values (10.5, 5.5, 50.5, 20.5), (50.5, 20.5, 30.5, 55.5), (30.5, 55.5, 10.5, 5.5)) t(x1, y1, x2, y2))
select "row", col, cast(sum(n_umis) as bigint) n_umis from entries where (select count(*) from e where (y1 > "row") <> (y2 > "row") and col < (x2 - x1) * ("row" - y1) / (y2 - y1) + x1) % 2 = 1 group by all""")
def polygon_selection(spark, d):
    inside = filters.in_polygon(F.col("col"), F.col("row"), [(10.5, 5.5), (50.5, 20.5), (30.5, 55.5)])
    return b.spatial_entries(spark, d).filter(inside).groupBy("row", "col").agg(F.sum("n_umis").alias("n_umis"))


# Genotypes


@query(f"{EVENT_CALLS} select cell_idx, probe_idx, genotype, n_umis, round(proportion, 6) proportion from calls")
def call_genotypes(spark, d):
    return genotypes.call_genotypes(b.entries(spark, d), 0.6).withColumn("proportion", F.round("proportion", 6))


@query(f"{WIDE_CALLS} select probe_idx, genotype, count(*) n, round(count(*) / sum(count(*)) over (partition by probe_idx), 6) share from calls group by probe_idx, genotype")
def genotype_value_counts(spark, d):
    return genotypes.value_counts(genotypes.call_genotypes(b.wide_entries(spark, d)), ["probe_idx"]).withColumn("share", F.round("share", 6))


ALLELES_SQL = """alleles as (select cell_idx, probe_idx, genotype, case when genotype not like '%/%' then case when genotype = 'ACT' then 'REF' when genotype = 'CCT' then 'ALT' else 'UNKNOWN' end
 when len([x for x in string_split(genotype, '/') if x not in ('ACT', 'CCT')]) > 0 then 'UNKNOWN' else 'HET' end allele from calls)"""


def _alleles(spark, d):
    calls = genotypes.call_genotypes(b.entries(spark, d), 0.6)
    return calls.withColumn("allele", genotypes.annotate_alleles(F.col("genotype"), F.lit("ACT"), F.lit("CCT"), unknown_as_alt=False))


@query(f"{EVENT_CALLS}, {ALLELES_SQL} select cell_idx, probe_idx, genotype, allele from alleles")
def annotate_alleles(spark, d):
    return _alleles(spark, d).select("cell_idx", "probe_idx", "genotype", "allele")


@query(f"""{EVENT_CALLS}, {ALLELES_SQL}, m as (select cell_idx, coalesce(avg(case allele when 'REF' then 0.0 when 'HET' then 0.5 when 'ALT' then 1.0 end), 0.0) x from alleles group by 1), r as (select min(x) lo, max(x) hi from m)
select cell_idx, round(case when hi = lo then x else (x - lo) / (hi - lo) end, 6) burden from m, r""")
def mutational_burden(spark, d):
    return genotypes.mutational_burden(_alleles(spark, d)).withColumn("burden", F.round("burden", 6))


@query(f"{EVENT_CALLS} select c_custkey cell_idx, probe_idx, genotype, n_umis, round(proportion, 6) proportion, probe_idx is not null has_genotype from customer left join calls on cell_idx = c_custkey")
def transfer_genotypes(spark, d):
    wta = b.table(spark, d, "customer").select(F.col("c_custkey").alias("cell_idx"))
    return genotypes.transfer_genotypes(wta, genotypes.call_genotypes(b.entries(spark, d), 0.6)).withColumn("proportion", F.round("proportion", 6))


@query(f"with {b.WIDE_SQL} select s_nationkey grp, probe_idx, gapfill, cast(sum(n_umis) as bigint) n_umis from entries join supplier on s_suppkey = cell_idx group by all")
def pseudobulk_genotype(spark, d):
    groups = b.table(spark, d, "supplier").select(F.col("s_suppkey").alias("cell_idx"), F.col("s_nationkey").alias("grp"))
    return genotypes.pseudobulk(b.wide_entries(spark, d), groups)


@query(f"""with {b.MOLECULES_SQL}, l as (select cast(t as int) threshold, cell_idx, probe_idx, gapfill, count(*) n from (select *, unnest(range(1, least(5, pcr_duplicate_count) + 1)) t from molecules) group by all),
p as (select *, row_number() over (partition by threshold, cell_idx, probe_idx order by n desc, gapfill desc) r from l)
select threshold, count(*) n_calls, round(count(*) filter (gapfill = case when probe_idx % 2 = 0 then 'ACT' else 'CCT' end) / (count(*) + 1e-4), 6) accuracy from p where r = 1 group by threshold""")
def accuracy_by_pcr(spark, d):
    truth = spark.createDataFrame([(i, "ACT" if i % 2 == 0 else "CCT") for i in range(5)], "probe_idx long, truth string")
    return genotypes.accuracy_by_threshold(b.molecules(spark, d), truth).withColumn("accuracy", F.round("accuracy", 6))


@query(f"""with {b.WIDE_SQL}, s as (select cell_idx, probe_idx, sum(n_umis) n from entries group by all), p as (select cell_idx, probe_idx, n p from s where probe_idx < 4), c as (select cell_idx, probe_idx - 3 probe_idx, n c from s where probe_idx between 4 and 6),
j as (select cell_idx, probe_idx, coalesce(p, 0) p, coalesce(c, 0) c from p full join c using (cell_idx, probe_idx)) select probe_idx, cast(sum(p) as bigint) n_probe, cast(sum(c) as bigint) n_control, round(median((p + 1) / (c + 1)), 6) median_ratio from j group by probe_idx""")
def relative_efficiency(spark, d):
    controls = spark.createDataFrame([(i, i + 3) for i in (1, 2, 3)], "probe_idx long, control_idx long")
    return genotypes.relative_efficiency(b.wide_entries(spark, d), controls).withColumn("median_ratio", F.round("median_ratio", 6))


TRUTH_SQL = "truth as (select distinct c_nationkey grp, cast(c_custkey // 7 as bigint) probe_idx, c_mktsegment genotype from customer)"


@query(f"with {TRUTH_SQL} select probe_idx, min(grp) grp, genotype from truth group by probe_idx, genotype having count(*) = 1")
def specific_probes(spark, d):
    """Seven customers a probe, their nations as groups: some segments belong to one nation alone, at any scale."""
    c = b.table(spark, d, "customer")
    return genotypes.specific_probes(c.select(F.col("c_nationkey").alias("grp"), F.floor(F.col("c_custkey") / 7).alias("probe_idx"), F.col("c_mktsegment").alias("genotype")).distinct())


@query(f"{WIDE_CALLS} select probe_idx, string_agg(distinct genotype, '|' order by genotype) genotypes, count(*) n from calls group by 1 having count(distinct genotype) >= 2 order by n desc, probe_idx limit 5")
def distinct_allele_probes(spark, d):
    return genotypes.distinct_allele_probes(genotypes.call_genotypes(b.wide_entries(spark, d)), top=5)


@query(f"with {b.WIDE_SQL} select cell_idx, probe_idx, round(case when sum(n_umis) filter (gapfill in ('AF', 'NO')) > 0 then coalesce(sum(n_umis) filter (gapfill = 'NO'), 0) / sum(n_umis) filter (gapfill in ('AF', 'NO')) end, 6) alt_fraction from entries group by all")
def alt_fraction(spark, d):
    truth = spark.createDataFrame([(i, "AF", "NO") for i in range(1, 8)], "probe_idx long, wt_gapfill string, alt_gapfill string")
    return genotypes.alt_fraction(b.wide_entries(spark, d), truth).withColumn("alt_fraction", F.round("alt_fraction", 6))


@query(f"with {b.WIDE_SQL} select s_nationkey grp, probe_idx, cast(sum(case when gapfill = 'AF' then n_umis else 0 end) as bigint) wt, cast(sum(case when gapfill = 'NO' then n_umis else 0 end) as bigint) alt from entries join supplier on s_suppkey = cell_idx group by all having greatest(wt, alt) > 3")
def allele_balance(spark, d):
    truth = spark.createDataFrame([(i, "AF", "NO") for i in range(1, 8)], "probe_idx long, wt_gapfill string, alt_gapfill string")
    groups = b.table(spark, d, "supplier").select(F.col("s_suppkey").alias("cell_idx"), F.col("s_nationkey").alias("grp"))
    return genotypes.allele_balance(b.wide_entries(spark, d), truth, groups, 3)


@query(f"with {b.WIDE_SQL} select n_umis, round(sum(count(*)) over (order by n_umis) / sum(count(*)) over (), 6) share from entries group by n_umis")
def ecdf(spark, d):
    return genotypes.ecdf(b.wide_entries(spark, d), "n_umis").withColumn("share", F.round("share", 6))


@query(f"{EVENT_CALLS} select probe_idx, gapfill, round(sum(w), 6) \"value\" from (select probe_idx, unnest(string_split(genotype, '/')) gapfill, n_umis / len(string_split(genotype, '/')) w from calls) group by all")
def genotype_frequencies(spark, d):
    e = b.entries(spark, d)
    return genotypes.genotype_frequencies(genotypes.call_genotypes(e, 0.6), e, "umis").withColumn("value", F.round("value", 6))


@query(f"""with {b.ENTRIES_SQL}, f as (select probe_idx, gapfill, sum(n_umis) v from entries group by all), w as (select *, max(length(gapfill)) over (partition by probe_idx) w from f),
p as (select probe_idx, i - 1 position, substr(rpad(gapfill, cast(w as int), '-'), cast(i as int), 1) base, v from (select *, unnest(range(1, w + 1)) i from w))
select probe_idx, cast(position as int) position, base, round(sum(v) / sum(sum(v)) over (partition by probe_idx, position), 6) share from p group by probe_idx, position, base""")
def logo_matrix(spark, d):
    e = b.entries(spark, d)
    return genotypes.logo_matrix(genotypes.genotype_frequencies(e, e, "raw")).withColumn("share", F.round("share", 6))


# Statistics


@query(f"""with {b.WIDE_SQL}, s as (select sum(n_umis) x, sum(total_reads) y from entries group by cell_idx, probe_idx), r as (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2 rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2 ry from s)
select round(corr(rx, ry), 6) spearman, count(*) n from r""")
def spearman_pseudobulk(spark, d):
    s = b.wide_entries(spark, d).groupBy("cell_idx", "probe_idx").agg(F.sum("n_umis").alias("x"), F.sum("total_reads").alias("y"))
    return stats.spearman(s, "x", "y").withColumn("spearman", F.round("spearman", 6))


@query(f"with {b.WIDE_SQL}, s as (select sum(n_umis) x, sum(total_reads) y from entries group by cell_idx, probe_idx) select round(regr_slope(y, x), 4) slope, round(regr_intercept(y, x), 4) intercept, cast(regr_count(y, x) as bigint) n from s")
def linear_fit(spark, d):
    s = b.wide_entries(spark, d).groupBy("cell_idx", "probe_idx").agg(F.sum("n_umis").alias("x"), F.sum("total_reads").alias("y"))
    return stats.linear_fit(s, "x", "y").select(F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), "n")


# Space


def _bins_sql(sizes: str) -> str:
    return f"""with {b.SPATIAL_SQL}, g as (select cast(resolution as int) resolution, cast("row" // (resolution // 2) as bigint) "row", cast(col // (resolution // 2) as bigint) col, probe_idx, gapfill, cast(sum(n_umis) as bigint) n_umis from entries, (select unnest([{sizes}]) resolution) group by all)"""


@query(_bins_sql("8") + """ select resolution, "row", col, probe_idx, gapfill, n_umis, printf('s_%03dum_%05d_%05d-1', resolution, "row", col) barcode from g""")
def spatial_bin(spark, d):
    return spatial.bin_entries(b.spatial_entries(spark, d), (8,))


@query(_bins_sql("2, 8, 16") + """ select resolution, "row", col, probe_idx, gapfill, n_umis, printf('s_%03dum_%05d_%05d-1', resolution, "row", col) barcode from g""")
def spatial_bin_multires(spark, d):
    return spatial.bin_entries(b.spatial_entries(spark, d), (2, 8, 16))


@query(_bins_sql("2, 8, 16") + """, w as (select distinct cast(8 as int) resolution, c_custkey % 20 "row", c_custkey // 20 % 20 col from customer) select w.resolution, w."row", w.col, g.probe_idx, g.gapfill, coalesce(g.n_umis, 0) n_umis from w left join g using (resolution, "row", col)""")
def join_with_wta(spark, d):
    k = F.col("c_custkey")
    wta = b.table(spark, d, "customer").select(F.lit(8).alias("resolution"), (k % 20).alias("row"), (F.floor(k / 20) % 20).alias("col")).distinct()
    return spatial.join_with_wta(b.spatial_entries(spark, d), wta)


@query(f"""with {b.SPATIAL_SQL} select "row", col, cast(grouping("row", col) as bigint) as level, cast(sum(n_umis) as bigint) n_umis from entries group by grouping sets (("row", col), ("row"), (col))""")
def spatial_marginals(spark, d):
    return spatial.marginals(b.spatial_entries(spark, d))


@query("""with p as (select l_orderkey % 64 "row", l_partkey % 64 col, max(l_quantity) v, min(l_linenumber) - 1 alpha from lineitem group by 1, 2) select cast("row" // 4 as bigint) "row", cast(col // 4 as bigint) col, round(coalesce(avg(v) filter (alpha > 0 and v > 0), 0.0), 6) "value" from p group by 1, 2""")
def downsample_image(spark, d):
    px = b.table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 64).alias("row"), (F.col("l_partkey") % 64).alias("col")).agg(F.max("l_quantity").alias("value"), (F.min("l_linenumber") - 1).alias("alpha"))
    return spatial.downsample(px, 4).withColumn("value", F.round("value", 6))


# Whitelists, panels, scalar functions


WHITE_SQL = """digits as (select c_custkey k, {d} code from customer),
white as (select k, {t} entry from digits),
asked as (select k, case when k % 4 = 0 then entry when k % 4 = 1 then (case when entry like 'A%' then 'C' else 'A' end) || substr(entry, 2) when k % 4 = 2 then substr(entry, 1, 23) || (case when entry like '%A' then 'C' else 'A' end) else 'GGG' || substr(entry, 4, 18) || 'TTA' end seq from white)""".format(
    d=" || ".join(f"substr('ACGT', cast((c_custkey // {4**i}) % 4 + 1 as int), 1)" for i in range(7, -1, -1)), t=" || ".join(f"repeat(substr(code, {i}, 1), 3)" for i in range(1, 9))
)


def _whitelist(spark, d):
    code = b.code(F.col("c_custkey"))
    entry = F.regexp_replace(code, "(.)", "$1$1$1")
    white = b.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), entry.alias("entry"))
    e, k = F.col("entry"), F.col("k")
    seq = (
        F.when(k % 4 == 0, e).when(k % 4 == 1, F.concat(F.when(e.startswith("A"), "C").otherwise("A"), e.substr(2, 23)))
        .when(k % 4 == 2, F.concat(e.substr(1, 23), F.when(e.endswith("A"), "C").otherwise("A"))).otherwise(F.concat(F.lit("GGG"), e.substr(4, 18), F.lit("TTA")))
    )
    return white.select("entry"), white.select("k", seq.alias("seq"))


@query(f"with {WHITE_SQL} select a.k, a.seq, w.entry from asked a left join (select distinct entry from white) w on w.entry = a.seq")
def whitelist_exact(spark, d):
    white, asked = _whitelist(spark, d)
    return asked.join(white.distinct(), asked["seq"] == white["entry"], "left").select("k", "seq", "entry")


@query(f"""with {WHITE_SQL}, near as (select q.seq, w.entry, hamming(q.seq, w.entry) edits from (select distinct seq from asked) q join (select distinct entry from white) w on hamming(q.seq, w.entry) <= 2),
best as (select * from (select *, row_number() over (partition by seq order by edits, entry) r from near) where r = 1) select a.k, a.seq, best.entry, cast(best.edits as int) edits from asked a left join best using (seq)""")
def whitelist_pigeonhole(spark, d):
    white, asked = _whitelist(spark, d)
    found = fuzzy.match_whitelist(asked, white, 2)
    return asked.join(found, "seq", "left").select("k", "seq", "entry", "edits")


@query(f"""with {WHITE_SQL}, q as (select distinct seq from asked), w as (select distinct entry from white), near as (select seq, entry, levenshtein(seq, entry) edits from q join w on levenshtein(seq, entry) <= 1)
select seq, entry, cast(edits as int) edits from q left join (select * from (select *, row_number() over (partition by seq order by edits, entry) r from near) where r = 1) using (seq)""")
def whitelist_indels(spark, d):
    white, asked = _whitelist(spark, d)
    return fuzzy.match_whitelist(asked, white, 1, indels=True)


@query(f"""with {WHITE_SQL}, q as (select distinct seq from asked), r(a, m, z) as (values (0, 12, 24), (0, 11, 23), (1, 12, 24)),
one as (select distinct substr(entry, 1, 12) f from white), two as (select distinct substr(entry, 13, 12) s from white),
c as (select seq, z - a span, substr(seq, a + 1, m - a) x, substr(seq, m + 1, z - m) y from q, r where length(seq) >= z),
fx as (select * from (select x, f, hamming(x, f) ex, row_number() over (partition by x order by hamming(x, f), f) k from (select distinct x from c) join one on length(x) = length(f) and hamming(case when length(x) = length(f) then x else f end, f) <= 1) where k = 1),
fy as (select * from (select y, s, hamming(y, s) ey, row_number() over (partition by y order by hamming(y, s), s) k from (select distinct y from c) join two on length(y) = length(s) and hamming(case when length(y) = length(s) then y else s end, s) <= 1) where k = 1)
select seq, f as "first", s as "second", cast(ex + ey as int) edits from (select seq, f, s, ex, ey, row_number() over (partition by seq order by ex + ey, span desc, f, s) n from c join fx using (x) join fy using (y)) where n = 1""")
def two_part_barcodes(spark, d):
    white, asked = _whitelist(spark, d)
    return fuzzy.two_part(asked, white.select(F.col("entry").substr(1, 12).alias("entry")), white.select(F.col("entry").substr(13, 12).alias("entry")), "seq", [(0, 12, 24), (0, 11, 23), (1, 12, 24)], 1)


NAMED_SQL = f"""{b.PANEL_SQL}, uniq as (select min(name) name, lhs_probe, rhs_probe, gap_probe_sequence, original_gap_probe_sequence, gene from panel group by all),
named as (select case when count(*) over (partition by name) > 1 then name || '_' || (row_number() over (partition by name order by lhs_probe, rhs_probe, gap_probe_sequence, original_gap_probe_sequence, gene) - 1) else name end name, lhs_probe, rhs_probe, gap_probe_sequence, original_gap_probe_sequence, gene from uniq)"""


@query(f"with {NAMED_SQL} select * from named")
def manifest_dedup_names(spark, d):
    return manifest.normalize_panel(b.panel(spark, d))


@query(f"""with {NAMED_SQL}, l as (select lhs_probe, min(name) a from named group by 1), r as (select rhs_probe, min(name) b from named group by 1)
select name, lhs_probe, rhs_probe, true was_defined from named union all select a || '/' || b, lhs_probe, rhs_probe, false from l cross join r where not exists (select 1 from named n where n.lhs_probe = l.lhs_probe and n.rhs_probe = r.rhs_probe)""")
def manifest_decoys(spark, d):
    return manifest.with_decoys(manifest.normalize_panel(b.panel(spark, d))).select("name", "lhs_probe", "rhs_probe", "was_defined")


@query(f"""with {NAMED_SQL} select name, case when 14 - greatest(length(gap_probe_sequence), length(original_gap_probe_sequence)) - length(lhs_probe) >= 0 then substr(rhs_probe, 1, cast(14 - greatest(length(gap_probe_sequence), length(original_gap_probe_sequence)) - length(lhs_probe) as int)) else rhs_probe end rhs_probe,
row_number() over (order by name) - 1 "index" from named""")
def manifest_trim(spark, d):
    return manifest.build_manifest(manifest.normalize_panel(b.panel(spark, d)), trim=14).select("name", "rhs_probe", "index")


@query("select p_partkey, 'ENS' || p_partkey || '|' || p_brand || '|h' || p_size as name, substr(s, 1, 25) lhs_probe, substr(s, 26, 25) rhs_probe, p_brand gene from (select *, rpad(repeat('ACGTT', 8) || p_partkey, 50, 'G') s from part)")
def probe_convert(spark, d):
    p = b.table(spark, d, "part").select("p_partkey", F.rpad(F.concat(F.repeat(F.lit("ACGTT"), F.lit(8)), F.col("p_partkey").cast("string")), 50, "G").alias("probe_seq"), F.concat_ws("|", F.concat(F.lit("ENS"), F.col("p_partkey").cast("string")), "p_brand", F.concat(F.lit("h"), F.col("p_size").cast("string"))).alias("probe_id"))
    out = manifest.convert_probes(p)
    return out.withColumn("p_partkey", F.regexp_extract("name", r"^ENS(\d+)", 1).cast("long"))


@query(f"""with {NAMED_SQL}, v as (select name, gene, lhs_probe, rhs_probe, 'REF' kind, original_gap_probe_sequence gap from named union all select name, gene, lhs_probe, rhs_probe, 'ALT', gap_probe_sequence from named where gap_probe_sequence <> original_gap_probe_sequence)
select gene || '|' || name || '|' || kind probe_id, substr(lhs_probe || gap || rhs_probe, 1, 50) probe_seq, true included from v""")
def probe_revert(spark, d):
    return manifest.revert_probes(manifest.normalize_panel(b.panel(spark, d)))


@query(f"with {b.READS_SQL} select read_id, reverse(translate(umi, 'ACGT', 'TGCA')) rc from reads")
def revcomp(spark, d):
    return b.reads(spark, d).select("read_id", fn.reverse_complement(F.col("umi")).alias("rc"))


@query("select p_partkey, round(list_sum([pow(10, -(ascii(c) - 33) / 10.0) for c in string_split(p_name, '')]), 9) expected_errors from part")
def phred_probs(spark, d):
    p = F.aggregate(fn.phred_probabilities(F.col("p_name")), F.lit(0.0), lambda s, x: s + x)
    return b.table(spark, d, "part").select("p_partkey", F.round(p, 9).alias("expected_errors"))


@query("select p_partkey, cast(greatest(1, ceil(p_size / 10)) as bigint) by_ceiling, cast(greatest(1, floor(p_size * 1.0 / 10)) as bigint) by_floor from part")
def max_distance(spark, d):
    return b.table(spark, d, "part").select("p_partkey", fn.max_distance(F.col("p_size")).alias("by_ceiling"), fn.max_distance_floor(F.col("p_size")).alias("by_floor"))


@query("select c_custkey, substr(sha1(from_hex(case when length(hex(c_custkey)) % 2 = 1 then '0' || hex(c_custkey) else hex(c_custkey) end)), 1, 7) hash from customer")
def id_hash(spark, d):
    return b.table(spark, d, "customer").select("c_custkey", fn.int_to_hash(F.col("c_custkey")).alias("hash"))


@query("with p as (select p_partkey, printf('s_%03dum_%05d_%05d-1', 8, p_partkey % 77, p_size) barcode from part) select p_partkey, 8 resolution, cast(regexp_extract(barcode, '_([0-9]+)_([0-9]+)-', 1) as int) \"row\", cast(regexp_extract(barcode, '_([0-9]+)_([0-9]+)-', 2) as int) col from p")
def bin_coordinates(spark, d):
    from ..tech import spatial_barcode

    p = b.table(spark, d, "part").select("p_partkey", spatial_barcode(F.col("p_partkey") % 77, F.col("p_size"), F.lit(1), 8).alias("barcode"))
    return p.select("p_partkey", fn.bin_coordinates(F.col("barcode")).alias("c")).select("p_partkey", "c.*")


# Mapping


ARMS = [("ACGTACGTAC", "TTGGCCAATT"), ("CCCCAAAATT", "GATTACAGAT"), ("GTGTGTCACA", "CAGTCAGTCA"), ("TTTTGGGGCC", "AACCGGTTAA"), ("AGAGAGTCTC", "CTCTAGGATC")]


@query(f"""with {b.READS_SQL}, c as (select *, rpad({" || ".join(f"substr('ACGT', cast((cell_idx // {4**i}) % 4 + 1 as int), 1)" for i in range(7, -1, -1))}, 16, 'CACACACA') cell from reads),
s as (select *, k % 17 = 0 no_left, k % 13 = 0 no_cell, k % 17 <> 0 and k % 9 = 0 and probe_idx <> 2 fixed_left, k % 7 in (1, 2) fixed_right, k % 5 in (1, 2) fixed_cell, k % 8 = 0 fixed_sample, k % 8 = 1 no_sample from c)
select read_id, case when not no_left and not no_cell and not no_sample then probe_idx end probe_idx, case when not no_left and not no_cell and not no_sample then gapfill end gapfill,
 case when not no_cell then cell end cell_barcode, case when not no_left and not no_sample then 'ACTTTAGG' end probe_barcode, umi,
 coalesce(nullif(concat_ws(',', case when no_left then 'FILTERED_NO_LHS' when fixed_left then 'CORRECTED_LHS' end, case when not no_left and fixed_right then 'CORRECTED_RHS' end,
  case when no_cell then 'FILTERED_NO_CELL_BARCODE' when fixed_cell then 'CORRECTED_BARCODE' end,
  case when not no_left and no_sample then 'FILTERED_NO_PROBE_BARCODE' when not no_left and fixed_sample then 'CORRECTED_PROBE_BARCODE' end), ''), 'EXACT') states from s""")
def map_reads(spark, d):
    """events as read pairs built from a panel of five probes, then mapped back: arms, cells and samples with 0 to 3 edits."""
    panel = spark.createDataFrame([(i, f"p{i}", x, y) for i, (x, y) in enumerate(ARMS)], "index long, name string, lhs_probe string, rhs_probe string")
    left, right = (F.array(*[F.lit(x[i]) for x in ARMS]) for i in (0, 1))
    r = b.reads(spark, d)
    k, at = F.col("k"), (F.col("probe_idx") + 1).cast("int")
    code = b.code(F.col("cell_idx"))
    cell = F.rpad(code, 16, "CA")
    # Edits in a part that no other entry comes near: the padding of cells, the first letters of arms, the sample's end.
    seen = F.when(k % 13 == 0, F.repeat(F.lit("N"), F.lit(16))).when(k % 5 == 1, F.concat(code, F.lit("TACACACA"))).when(k % 5 == 2, F.concat(code, F.lit("TACACACT"))).otherwise(cell)
    arm = F.when(k % 17 == 0, "NNNNNNNNNN").when(k % 9 == 0, F.concat(F.lit("G"), F.element_at(left, at).substr(2, 9))).otherwise(F.element_at(left, at))
    other = F.when(k % 7 == 1, F.concat(F.element_at(right, at).substr(1, 9), F.lit("N"))).when(k % 7 == 2, F.concat(F.element_at(right, at).substr(1, 4), F.lit("N"), F.element_at(right, at).substr(6, 5))).otherwise(F.element_at(right, at))
    sample = F.when(k % 8 == 0, "ACTTTAGC").when(k % 8 == 1, "GGTTTAGC").otherwise("ACTTTAGG")
    r2 = F.concat(arm, "gapfill", other, F.lit("ACGCGGTTAGCACGTA"), F.lit("NN"), sample)
    pairs = r.select("read_id", F.concat(seen, F.col("umi")).alias("r1"), r2.alias("r2")).withColumns({"q1": F.repeat(F.lit("I"), F.length("r1")), "q2": F.repeat(F.lit("I"), F.length("r2"))})
    cells = r.select(cell.alias("entry")).distinct()
    samples = spark.createDataFrame([("ACTTTAGG",)], "entry string")
    return mapping.map_reads(pairs, panel, cells, "Flex", samples).select("read_id", "probe_idx", "gapfill", "cell_barcode", "probe_barcode", "umi", F.array_join("states", ",").alias("states"))


# Graphs


@query("""with v as (select vec_id, [cast(x as double) for x in embedding] v from embeddings), p as (select a.vec_id src, b.vec_id dst, round(list_distance(a.v, b.v), 9) distance from v a join v b on a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by src order by distance, dst) rank from p) select src, dst, round(distance, 5) distance, cast(rank as int) rank from r where rank <= 5""")
def knn_graph(spark, d):
    return knn.vector_knn(b.table(spark, d, "embeddings"), 5).withColumn("distance", F.round("distance", 5))


@query("""with a as (select n_nationkey src, n_regionkey dst, 1.0 weight from nation), b as (select s_nationkey src, s_suppkey % 5 dst, count(*) * 1.0 weight from supplier group by all)
select coalesce(a.src, b.src) src, cast(coalesce(a.dst, b.dst) as bigint) dst, round(0.3 * coalesce(a.weight, 0) + 0.7 * coalesce(b.weight, 0), 6) weight from a full join b on a.src = b.src and a.dst = b.dst""")
def graph_combine(spark, d):
    x = b.table(spark, d, "nation").select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").cast("long").alias("dst"), F.lit(1.0).alias("weight"))
    y = b.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("src"), (F.col("s_suppkey") % 5).alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return knn.combine_graphs(x, y, 0.3).withColumn("weight", F.round("weight", 6))


@query(f"""{EVENT_CALLS}, x as (select cell_idx % 7 cluster, cell_idx, probe_idx, string_split(genotype, '/') s from calls),
p as (select a.cluster, a.cell_idx a, b.cell_idx b, len([z for z in a.s if not list_contains(b.s, z)]) + len([z for z in b.s if not list_contains(a.s, z)]) d from x a join x b on a.cluster = b.cluster and a.probe_idx = b.probe_idx and a.cell_idx < b.cell_idx)
select cluster, a, b, round(sqrt(sum(d)) / count(*), 6) distance from p group by all""")
def genotype_distances(spark, d):
    calls = genotypes.call_genotypes(b.entries(spark, d), 0.6).withColumn("cluster", F.col("cell_idx") % 7)
    return knn.genotype_distances(calls).withColumn("distance", F.round("distance", 6))


@query(None)
def impute_genotypes(spark, d):
    calls = genotypes.call_genotypes(b.entries(spark, d), 0.6)
    cells = calls.select("cell_idx", (F.col("cell_idx") % 2).alias("cluster")).distinct()
    return knn.impute_genotypes(calls, cells, k=15, hold_out=1 / 3)[0]


@query(f"""with {b.ENTRIES_SQL}, en as (select cell_idx, probe_idx, gapfill, length(gapfill) len, n_umis n from entries where n_umis > 0),
t as (select cell_idx, probe_idx, len, count(*) k, sum(n) total from en group by all),
u as (select l.cell_idx, l.probe_idx, l.len from t l join t s on s.cell_idx = l.cell_idx and s.probe_idx = l.probe_idx and s.len = l.len - 1 where (l.k > 1 or s.k = 1) and l.total > s.total),
p as (select s.cell_idx, s.probe_idx, s.gapfill short, s.n, l.gapfill long, l.n m, rank() over (partition by s.cell_idx, s.probe_idx, s.gapfill order by levenshtein(s.gapfill, l.gapfill)) r from u join en s on s.cell_idx = u.cell_idx and s.probe_idx = u.probe_idx and s.len = u.len - 1 join en l on l.cell_idx = u.cell_idx and l.probe_idx = u.probe_idx and l.len = u.len),
gain as (select cell_idx, probe_idx, long gapfill, round_even(n * m / sum(m) over (partition by cell_idx, probe_idx, short), 0) d from p where r = 1),
every as (select cell_idx, probe_idx, gapfill, n d from en union all select cell_idx, probe_idx, gapfill, d from gain union all select distinct cell_idx, probe_idx, short, -n from p)
select cell_idx, probe_idx, gapfill, cast(sum(d) as bigint) n_umis from every group by all having sum(d) > 0""")
def off_by_one(spark, d):
    return offbyone.correct_off_by_one(b.entries(spark, d))


@query(None)
def coclustering(spark, d):
    li = b.table(spark, d, "lineitem")
    n = li.groupBy(F.col("l_suppkey").alias("cell_idx"), (F.col("l_partkey") % 40).alias("gene")).agg(F.count(F.lit(1)).alias("n"))
    at = n.select("cell_idx").distinct().select("cell_idx", F.floor(F.col("cell_idx") / 8).alias("row"), (F.col("cell_idx") % 8).alias("col"))
    return knn.cocluster(knn.log_normalized(n), at)


@query("""with n as (select l_suppkey cell_idx, l_partkey % 40 gene, count(*) n from lineitem group by all), x as (select *, ln(1 + n * 1e4 / sum(n) over (partition by cell_idx)) x from n), c as (select count(distinct l_suppkey) k from lineitem),
m as (select gene, sum(x) s, sum(x * x) q from x group by gene) select gene, round((q / k - pow(s / k, 2)) / (s / k), 6) dispersion from m, c order by dispersion desc, gene limit 10""")
def variable_genes(spark, d):
    li = b.table(spark, d, "lineitem")
    n = li.groupBy(F.col("l_suppkey").alias("cell_idx"), (F.col("l_partkey") % 40).alias("gene")).agg(F.count(F.lit(1)).alias("n"))
    return knn.variable_genes(knn.log_normalized(n), li.select("l_suppkey").distinct().count(), 10, 6)


from . import report_queries  # noqa: E402, F401  (registers its queries)
