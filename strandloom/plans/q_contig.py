"""Queries on contigs and bins."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import bins, contigs
from strandloom.plans.q_aln import SPAN
from strandloom.plans.registry import query

CONTIGS = "select concat('c', doc_id) as contig, sample, seq from {contigs}"


@query("cq1_contig_coverage", f"with a as (select contig, sum({SPAN}) as b from {{aln}} where pos - 1 + {SPAN} > 125 group by contig), c as ({CONTIGS}) select c.contig, round(coalesce(b, 0) / length(seq), 9) as coverage from c left join a on c.contig = a.contig where length(seq) > 0 and coalesce(b, 0) / length(seq) < 0.1")
def _(t):
    return contigs.contig_coverage(t.aln, t.sql(CONTIGS).where("seq <> ''"), 0.1).select("contig", F.round("coverage", 9).alias("coverage"))


@query("cq2_repetitive_filter", "select doc_id from {documents} where coalesce(length(regexp_replace(text, '[^a-zN]', ''/*g*/)), 0) / greatest(length(text), 1) < 0.8".replace("coalesce(length(regexp_replace(text, '[^a-zN]', ''/*g*/)), 0)", "length(regexp_replace(text, '[^a-zN]', ''/*g*/))"))
def _(t):
    return contigs.repetitive_filter(t.documents.withColumnRenamed("text", "seq")).select("doc_id")


@query("cq3_rename_contigs", f"with c as ({CONTIGS}) select sample || '_length_' || length(seq) || '_mean_cov_1.5' as contig, seq from c")
def _(t):
    return contigs.rename_contigs(t.sql(CONTIGS).withColumn("coverage", F.lit(1.5))).select("contig", "seq")


@query("cq4_supported_contigs", f"with c as ({CONTIGS}) select * from c where contig in (select contig from {{aln}} where {SPAN} > 0)")
def _(t):
    return contigs.supported_contigs(t.sql(CONTIGS), t.aln)


@query("cq5_read_to_contig_coverage")
def _(t):
    reads = t.sql("select item_id as read_id, regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz .,', 'ACGTACGTACGTACGTACGTACGTACACG'), '[^ACGT]', '') as seq from {benchmark}")
    other = t.sql("select concat('c', doc_id) as contig, regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz .,', 'ACGTACGTACGTACGTACGTACGTACACG'), '[^ACGT]', '') as seq from {documents}")
    return contigs.read_to_contig_coverage(reads, other.where("seq <> ''"), 21, 60).withColumn("coverage", F.round("coverage", 9))


@query("cq6_contig_mapping_table")
def _(t):
    breaks = t.sql("select 'A' as sample, concat('c', p_partkey) as chrom, cast(p_size * 60 as bigint) as pos from {part}")
    return contigs.contig_mapping_table(t.aln, breaks)


@query(
    "cq7_short_anchor",
    """with r as (select qname, qstart, qend, first_value(qend - qstart) over w as a, last_value(qend - qstart) over w as b from {contig_map} window w as (partition by qname order by qstart, qend rows between unbounded preceding and unbounded following))
    select qname, qstart, qend, a < 50 or b < 50 as short_anchor from r""",
)
def _(t):
    return contigs.short_anchor(t.contig_map).select("qname", "qstart", "qend", "short_anchor")


BREAKS = "select l_returnflag as sample, concat('chr', l_partkey % 5 + 1) as chrom, cast(l_orderkey * 97 % 5000000 as bigint) as pos from {lineitem}"


@query("cq8_overlaps_break", f"with b as (select distinct * from ({BREAKS}) x) select m.sample, m.qname, m.rstart, m.rend, exists (select 1 from b where b.sample = m.sample and b.chrom = m.chrom and m.rstart < pos + 20 and pos - 20 < m.rend) as vcf from {{contig_map}} m")
def _(t):
    return contigs.overlaps_break(t.contig_map, t.sql(BREAKS), 20, 500).select("sample", "qname", "rstart", "rend", "vcf")


@query("cq9_remove_common_sites")
def _(t):
    return contigs.remove_common_sites(t.contig_map, 2).select("sample", "qname", "chrom", "rstart", "rend")


@query(
    "cq10_contig_length_stats",
    """with s as (select sample, length(seq) as n from {contigs}), o as (select *, sum(n) over (partition by sample order by n desc) as u, sum(n) over (partition by sample) as t from s)
    select sample, count(*) as n_contigs, avg(n) as mean, max(n) as longest, max(n) filter (2 * u >= t) as n50 from o group by sample""",
)
def _(t):
    return contigs.contig_length_stats(t.contigs, ["sample"])


@query(
    "cq11_base_composition",
    """with c as (select doc_id, greatest(length(seq), 1) as n, length(seq) - length(replace(seq, 'A', '')) as a, length(seq) - length(replace(seq, 'C', '')) as c, length(seq) - length(replace(seq, 'G', '')) as g, length(seq) - length(replace(seq, 'T', '')) as t from {contigs})
    select doc_id, round(a / n, 9) as share_a, round(c / n, 9) as share_c, round(g / n, 9) as share_g, round(t / n, 9) as share_t, round((list_reverse_sort([a, c, g, t])[1] + list_reverse_sort([a, c, g, t])[2]) / n, 9) as top_two from c""",
)
def _(t):
    out = contigs.base_composition(t.contigs, "doc_id")
    return out.select("doc_id", *(F.round(f"share_{b}", 9).alias(f"share_{b.lower()}") for b in "ACGT"), F.round("top_two", 9).alias("top_two"))


FLANK = "select m.*, mapq / 60.0e0 as gap_score from {contig_map} m"


@query(
    "cq12_tandem_flanking",
    f"""with m as ({FLANK}), h as (select *, row_number() over (partition by qname order by qstart, qend, rstart) as i from m), p as (select *, lead(i) over w as j, lead(rend) over w as ne from h window w as (partition by qname, chrom order by i)),
    f as (select qname, i as a, j as b from p where j - i > 1 and abs(ne - rstart) < 1000 and gap_score > 0.2), k as (select h.* from h where not exists (select 1 from f where f.qname = h.qname and h.i > a and h.i < b and h.mapq < 30)),
    z as (select qname from k where qname in (select qname from f) group by qname having count(*) <= 2) select qname, chrom, qstart, mapq from k where qname not in (select qname from z)""",
)
def _(t):
    return contigs.tandem_flanking(t.sql(FLANK)).select("qname", "chrom", "qstart", "mapq")


ADJ = "select qname, qstart, qend, mapq, case when mapq % 3 = 0 then 'ACACAC' else 'TTGTT' end as section, mapq % 10 / 10.0e0 as section_score, 0.95e0 as top_two, 'ACAC' as dinucleotide, score % 30 / 100.0e0 as contig_score from {contig_map}"


@query(
    "cq13_tandem_adjacent",
    f"""with m as ({ADJ}), h as (select *, qname in (select qname from m where mapq = 0) as zero from m), k as (select * from h where not (zero and contig_score > 0.2)), o as (select *, row_number() over (partition by qname order by qstart, qend) as i from k),
    l as (select o.qname, o.i from o join o z on z.qname = o.qname and z.i > o.i and z.mapq > 0 and (starts_with(z.section, 'ACAC') or ends_with(z.section, 'ACAC') or starts_with(z.section, 'CACA') or ends_with(z.section, 'CACA')) where o.zero and o.mapq < 10 and o.section_score > 0.2)
    select qname, qstart, mapq from o where (qname, i) not in (select (qname, i) from l)""",
)
def _(t):
    return contigs.tandem_adjacent(t.sql(ADJ)).select("qname", "qstart", "mapq")


@query("cq14_parse_contig_name", "select qname, split_part(qname, '_', 1) as name_sample, cast(list_last(string_split(qname, '_')) as double) as name_cov, qend - qstart as qlength from {contig_map}".replace("list_last(string_split(qname, '_'))", "string_split(qname, '_')[-1]"))
def _(t):
    return contigs.parse_contig_name(t.contig_map).select("qname", "name_sample", "name_cov", "qlength")


@query("cq15_best_alignment_path")
def _(t):
    return contigs.best_alignment_path(t.contig_map)


@query(
    "cq16_contig_segments",
    """with e as (select qname, qstart as p, 1 as v from {contig_map} union all select qname, qend, -1 from {contig_map} union all select qname, 0, 0 from {contig_map} union all select qname, qlen, 0 from {contig_map}),
    s as (select qname, p, sum(v) as v from e group by 1, 2), c as (select qname, p, sum(v) over (partition by qname order by p) as cover, lead(p) over (partition by qname order by p) as z from s),
    k as (select qname, p, z, case when cover = 0 then 'u' when cover = 1 then 'a' else 'h' end as kind from c where z is not null), n as (select *, case when lag(kind) over (partition by qname order by p) is null or lag(kind) over (partition by qname order by p) <> kind then 1 else 0 end as nw from k),
    g as (select *, sum(nw) over (partition by qname order by p) as run from n) select qname, min(p) as start, max(z) as "end", min(kind) as kind from g group by qname, run""",
)
def _(t):
    return contigs.contig_segments(t.contig_map)


@query("cq17_microhomology_insertion", "with x as (select *, lag(qend) over (partition by qname order by qstart, qend) - qstart as x from {contig_map}) select qname, qstart, qend, greatest(x, 0) as microhomology, greatest(-x, 0) as insertion from x where x is not null")
def _(t):
    return contigs.microhomology_insertion(t.contig_map)


TELO = "select concat('chr', n_nationkey % 5 + 1) as chrom, cast(n_nationkey * 1900 as bigint) as t_start, cast(n_nationkey * 1900 + 100 as bigint) as t_end from {nation}"


@query("cq18_telomere_proximity", f"with x as ({TELO}) select m.qname, m.rstart, m.rend, m.qstart, min(greatest(0, t_start - rend, rstart - t_end)) as telomere_distance from {{contig_map}} m join x on m.chrom = x.chrom group by all")
def _(t):
    return contigs.telomere_proximity(t.contig_map, t.sql(TELO)).select("qname", "rstart", "rend", "qstart", "telomere_distance").distinct()


REPORT = "select concat('c', p_partkey) as contig, p_size * 50 as length, p_size * 50 * (p_partkey % 100) / 100.0e0 as aligned from {part}"


@query("cq19_contig_alignment_filter", f"with r as ({REPORT}) select * from r where length >= 600 and aligned / length > 0.5")
def _(t):
    return contigs.contig_alignment_filter(t.sql(REPORT), 600, 0.5)


@query("bn1_bin_profiles", "select bin, sample, median(abundance) as abundance from {profiles} p join {bins} b on p.contig = b.contig group by 1, 2")
def _(t):
    return bins.bin_profiles(t.profiles, t.bins)


@query("bn2_choose_bins", "with x as (select bin, grp, sum(length) as total from {bins} b join {contig_lengths} l on b.contig = l.contig group by 1, 2) select bin, cast(max(total) as bigint) as length from x group by bin having max(total) > 18000")
def _(t):
    return bins.choose_bins(t.bins, t.contig_lengths, 18000)


PROFILE = "with p as (select bin, sample, median(abundance) as abundance from {profiles} p join {bins} b on p.contig = b.contig group by 1, 2)"


@query("bn3_choose_samples", PROFILE + ", e as (select *, sum(abundance) over (partition by bin) < 180 or bin = 'BIN2' as excluded from p) select *, row_number() over (partition by bin order by abundance desc, sample) as rank from e where abundance >= 4")
def _(t):
    return bins.choose_samples(bins.bin_profiles(t.profiles, t.bins), 4, 180, t.sql("select distinct bin from {bins}").where("bin = 'BIN2'"))


EDGES = "select cast(s_suppkey as bigint) as edge, cast(2000 + s_nationkey * 100 as bigint) as len from {supplier}"
MAPS = "select concat('c', l_partkey) as contig, cast(l_suppkey as bigint) as edge, cast(l_quantity as bigint) as mapped from {lineitem}"
COLOUR = f"c as (select m.edge, bin, sum(mapped) / any_value(len) as share from ({MAPS}) m join {{bins}} b on m.contig = b.contig join ({EDGES}) e on m.edge = e.edge group by 1, 2 having sum(mapped) / any_value(len) >= 0.08)"


def coloured(t):
    return bins.colour_edges(t.sql(MAPS), t.bins, t.sql(EDGES), 0.08)


@query("bn4_colour_edges", f"with {COLOUR} select edge, bin, round(share, 9) as share from c")
def _(t):
    return coloured(t).withColumn("share", F.round("share", 9))


PATHS = "select distinct concat('c', l_partkey) as contig, cast(l_suppkey as bigint) as edge, (l_partkey + l_suppkey) % 12 / 10.0e0 as mapped_share, cast(2000 + l_suppkey as bigint) as len from {lineitem}"


@query(
    "bn5_contig_bins",
    f"with {COLOUR}, p as (select * from ({PATHS}) x where mapped_share >= 0.9), t as (select contig, sum(len) as t from p group by 1), k as (select contig, bin, sum(len) as k from p join c on p.edge = c.edge group by 1, 2) select k.contig, bin from k join t on k.contig = t.contig where k >= 0.3 * t",
)
def _(t):
    return bins.contig_bins(t.sql(PATHS), coloured(t))


@query("bn6_edges_of_bin", f"with {COLOUR} select distinct bin, c.edge, len from c join ({EDGES}) e on c.edge = e.edge where len >= 3000")
def _(t):
    return bins.edges_of_bin(coloured(t), t.sql(EDGES), 3000)


@query("bn6_relevant_bins", f"with {COLOUR} select contig, string_agg(distinct bin, ' ' order by bin) as bins from ({PATHS}) p join c on p.edge = c.edge group by contig")
def _(t):
    return bins.relevant_bins(t.sql(PATHS), coloured(t))


@query("bn6_filter_interesting", "select * from {bins} where bin in (select concat('BIN', r_regionkey) from {region})")
def _(t):
    return bins.filter_interesting(t.bins, t.sql("select concat('BIN', r_regionkey) as bin from {region}"))


@query("bn7_bin_reads", f"with {COLOUR} select distinct pair, bin from {{mates}} m join c on m.edge = c.edge")
def _(t):
    return bins.bin_reads(t.mates, coloured(t))


SPLITS = "select concat('c', l_partkey) as contig, l_orderkey as split, concat('BIN', l_suppkey % 4) as bin from {lineitem}"


@query("bn8_glue_splits", f"with n as (select contig, bin, row_number() over (partition by contig order by count(*) desc, bin) as r from ({SPLITS}) s group by 1, 2) select contig, bin from n where r = 1")
def _(t):
    return bins.glue_splits(t.sql(SPLITS))


PATH = "select cast(l_suppkey as bigint) as edge, cast(100 + l_suppkey as bigint) as len, l_linenumber > 2 as binned, l_linenumber > 5 as pre_binned from {lineitem}"


@query(
    "bn9_binning_stats",
    f"""with p as ({PATH}), u as (select count(*) as n, sum(len) as l from (select distinct edge, len from p where not binned) x)
    select count(*) as total_edges, cast(sum(p.len) as bigint) as total_length, count(*) filter (binned) as binned_edges, cast(sum(p.len) filter (binned) as bigint) as binned_length, count(*) filter (pre_binned) as pre_binned_edges,
    cast(sum(p.len) filter (pre_binned) as bigint) as pre_binned_length, count(*) filter (binned and not pre_binned) as propagated_edges, cast(sum(p.len) filter (binned and not pre_binned) as bigint) as propagated_length,
    any_value(u.n) as unbinned_edges, cast(any_value(u.l) as bigint) as unbinned_length from p, u""",
)
def _(t):
    return bins.binning_stats(t.sql(PATH))


FRACTIONS = "select concat('BIN', l_suppkey % 9) as bin, concat('ref', l_partkey % 6) as ref, round(sum(l_quantity) / 1500, 3) as fraction from {lineitem} group by 1, 2"


@query(
    "bn10_best_matches",
    f"""with f as ({FRACTIONS}), h as (select * from f where bin in (select bin from f group by bin having sum(fraction) > 0.01) and ref in (select ref from f group by ref having sum(fraction) > 0.01))
    select 'bin' as kind, bin as name, max((fraction, ref))[2] as best, max(fraction) as fraction from h group by bin union all select 'ref', ref, max((fraction, bin))[2], max(fraction) from h group by ref""".replace("max((fraction, ref))[2]", "arg_max(ref, fraction)").replace("max((fraction, bin))[2]", "arg_max(bin, fraction)"),
)
def _(t):
    return bins.best_matches(t.sql(FRACTIONS))


@query("bn11_purity", f"with f as ({FRACTIONS}) select bin, round(100 * max(fraction) / sum(fraction), 6) as purity from f group by bin")
def _(t):
    f = t.sql(FRACTIONS)
    out = bins.purity(f.select("bin", F.col("fraction").alias("aligned")), f.groupBy("bin").agg(F.sum("fraction").alias("total")))
    return out.withColumn("purity", F.round("purity", 6))


@query(
    "bn12_problem_report",
    f"""with f as ({FRACTIONS}), p as (select ref, sum(fraction) as total, max(fraction) as best, count(*) filter (fraction > 2) as n_bins, arg_max(bin, fraction) as bin from f group by ref), m as (select bin, count(*) as n from f where fraction > 2 group by bin)
    select ref, case when total <= 2 then 'missing' when total < 20 then 'underassembled' when best < 20 then 'fractured' else 'fine' end as state, n_bins, coalesce(n, 0) > 1 as mixture from p left join m on p.bin = m.bin""",
)
def _(t):
    return bins.problem_report(t.sql(FRACTIONS), 20, 2)


@query("bn13_summary_table", "select event_type as metric, count(*) filter (user_id % 3 = 0) as r0, count(*) filter (user_id % 3 = 1) as r1, count(*) filter (user_id % 3 = 2) as r2 from {events} group by 1")
def _(t):
    m = t.sql("select event_type as metric, concat('r', user_id % 3) as run, count(*) as value from {events} group by 1, 2")
    return bins.summary_table(m, ["r0", "r1", "r2"])


TRANSFORM = "x as (select contig, sample, (abundance + 0.0005) / sum(abundance + 0.0005) over (partition by sample) as x from {profiles}), y as (select contig, sample, ln(x / sum(x) over (partition by contig)) as value from x)"


@query("bn14_profile_transform", f"with {TRANSFORM} select contig, sample, round(value, 9) as value from y")
def _(t):
    return bins.profile_transform(t.profiles).select("contig", "sample", F.round("value", 9).alias("value"))


@query("bn14_unique_profiles", "with p as (select contig, list(sample || ':' || abundance order by sample) as p from {profiles} group by contig) select count(distinct p) as n_profiles from p")
def _(t):
    return bins.unique_profiles(t.profiles)


@query("bn14_bin_means", f"with {TRANSFORM} select bin, sample, round(avg(value), 9) as mean from y join {{bins}} b on y.contig = b.contig group by 1, 2")
def _(t):
    return bins.bin_means(bins.profile_transform(t.profiles), t.bins).withColumn("mean", F.round("mean", 9))


LINES = "select concat('c', c_custkey, ',cluster_', c_nationkey) as value from {customer}"


@query("bn15_parse_binning", f"select split_part(value, ',', 1) as contig, 'BIN' || regexp_extract(value, '([0-9]+)$', 1) as bin from ({LINES}) l")
def _(t):
    return bins.parse_binning(t.sql(LINES))


CELLS = "select s_suppkey as k, s_nationkey * 4.2 as value from {supplier}"


@query("bn16_regression_compare", f"with a as ({CELLS}), b as (select k, value + k % 3 * 9 as v2 from a) select a.k, value as expected, v2 as actual from a join b on a.k = b.k where not case when value >= 95 then v2 >= 95 when value <= 5 then v2 <= 5 else abs(value - v2) <= 10 end")
def _(t):
    a = t.sql(CELLS)
    return bins.regression_compare(a, a.select("k", (F.col("value") + F.col("k") % 3 * 9).alias("value")), ["k"])


@query("bn17_combine_profiles", "select 'g1-' || contig as contig, sample, abundance from {profiles} union all select 'g2-' || contig, sample, abundance from {profiles}")
def _(t):
    return bins.combine_profiles({"g1": t.profiles, "g2": t.profiles})


@query(
    "bn18_profile_layouts",
    "select contig, sum(abundance) as total_depth, max(abundance) filter (sample = 'A') as a_cov, max(abundance) filter (sample = 'N') as n_cov, max(abundance / 2) filter (sample = 'A') as a_var, max(abundance / 2) filter (sample = 'N') as n_var from {profiles} group by contig",
)
def _(t):
    return bins.profile_layout(t.profiles.withColumn("variance", F.col("abundance") / 2), ["A", "N"]).toDF("contig", "total_depth", "a_cov", "a_var", "n_cov", "n_var")


@query(
    "bn19_assign_groups",
    "select n_name as sample, case n_name when 'FRANCE' then 'west' when 'GERMANY' then 'west' else 'part' || ntile(4) over (partition by n_name in ('FRANCE', 'GERMANY') order by n_name) end as grp from {nation}",
)
def _(t):
    return bins.assign_groups(t.sql("select n_name as sample from {nation}"), {"west": ["FRANCE", "GERMANY"]}, 4)


@query("bn20_reassembly_cutoff", "select s_suppkey, round(0.3 * s_acctbal * (100 - 55) / (100 - 21), 9) as cutoff from {supplier}")
def _(t):
    return t.supplier.select("s_suppkey", F.round(bins.reassembly_cutoff(F.col("s_acctbal"), F.lit(100), 21, 55), 9).alias("cutoff"))
