"""Queries on structural variants and breakpoint chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import chains, sv
from strandloom.plans.registry import query

P = "p as (select chrom, count(*) as n_breaks, count(*) / (select count(distinct sample) from {breaks}) / 2678400 as p from {breaks} group by chrom)"
CLUSTERS = (
    P
    + """, u as (select distinct sample, chrom, pos from {breaks}),
 g as (select u.*, ln(1 - 0.2) / ln(1 - p.p) as bound, pos - lag(pos) over (partition by sample, u.chrom order by pos) as gap from u join p on u.chrom = p.chrom),
 c as (select sample, chrom, pos, cast(sum(case when gap is null or gap >= bound then 1 else 0 end) over (partition by sample, chrom order by pos) as bigint) as cluster from g)"""
)


def clusters_of(t, p_val: float = 0.2):
    return chains.local_clusters(t.breaks, chains.break_frequency(t.breaks, t.chrom_lengths), p_val)


def samples_of(t):
    return t.sql("select concat('S', user_id) as sample, avg(value) as v from {events} group by 1")


SAMPLES = "select concat('S', user_id) as sample, avg(value) as v from {events} group by 1"


@query("sv1_size_filter", "select * from {sv} where svlen is null or svlen >= 10000")
def _(t):
    return sv.size_filter(t.sv)


@query("sv2_size_filter_report", "select sample, count(*) as before, count(*) filter (svlen is null or svlen >= 10000) as after from {sv} group by sample")
def _(t):
    return sv.size_filter_report(t.sv)


@query(
    "sv3_support_filter",
    """select * from {sv} where not ((svtype = 'INS' and prob < 0.2 and su < 9) or (svtype = 'DEL' and prob < 0.3 and su < 9) or (svtype in ('INV', 'DUP') and prob < 0.15 and su < 6)
    or (svtype = 'TRA' and prob < 0.4 and su < 8))""",
)
def _(t):
    return sv.support_filter(t.sv)


@query("sv4_span_filter", "select * from {sv} where svtype not in ('DEL', 'INV') or abs(stop - pos) > 500")
def _(t):
    return sv.span_filter(t.sv)


@query("sv5_break_filter", "select * from {sv} where svtype = 'TRA' or stop - pos >= 50000")
def _(t):
    return sv.break_filter(t.sv)


@query(
    "sv6_breakends",
    """select sample, sv_id, 1 as side, chrom, pos from {sv} union all
    select sample, sv_id, 2, case when svtype = 'TRA' then chr2 else chrom end, case when svtype = 'TRA' then chr2_pos else stop end from {sv}""",
)
def _(t):
    return sv.breakends(t.sv)


@query(
    "sv7_to_bed",
    """with s as (select * from {sv} where stop >= pos)
    select sample, chrom, greatest(0, pos - 1000) as start, (case when stop - pos <= 1000 then stop else pos end) + 1000 as "end" from s union all
    select sample, chrom, greatest(0, stop - 1000), stop + 1000 from s where stop - pos > 1000 union all
    select sample, chr2, greatest(0, chr2_pos - 1000), chr2_pos + 1000 from s where chr2_pos is not null""",
)
def _(t):
    return sv.to_bed(t.sv)


@query("sv8_normalise_chrom", "select sv_id, sample, replace(chrom, 'chr', '') as chrom, pos from {breaks} where chrom in ('chr1', 'chr2', 'chr3')")
def _(t):
    return sv.normalise_chrom(t.breaks, ["1", "2", "3"]).select("sv_id", "sample", "chrom", "pos")


@query(
    "sv9_link_table",
    """with k as (select *, case when svtype = 'TRA' then 'inter' when svtype = 'INS' then 'point' else 'intra' end as kind from {sv})
    select sample, sv_id, kind, chrom as chrom1, pos as pos1, case when kind = 'inter' then chr2 else chrom end as chrom2,
    case when kind = 'inter' then chr2_pos when kind = 'point' then pos when stop - pos < 50000 then stop + 50000 else stop end as pos2 from k""",
)
def _(t):
    return sv.link_table(t.sv)


@query("sv10_cohort_split", f"with s as ({SAMPLES}) select *, case when v < 50 then 'short' else 'long' end as cohort from s")
def _(t):
    return sv.cohort_split(samples_of(t), "v", 50.0)


@query(
    "sv11_cohort_subsets",
    f"""with s as ({SAMPLES}), c as (select sample, case when v < 50 then 'short' else 'long' end as cohort from s), e as (select c.*, unnest([1, 2, 3]) as subset from c),
    r as (select *, row_number() over (partition by subset, cohort order by md5('0|' || subset || '|' || sample), sample) as nth from e)
    select subset, cohort, sample from r where nth <= 20""",
)
def _(t):
    return sv.cohort_subsets(sv.cohort_split(samples_of(t), "v", 50.0), 3, 40, 0.5)


EVIDENCE = "select event_id as sv_id, concat('S', user_id) as sample, props as contiga, case when event_id % 3 = 0 then null else event_type end as contigb from {events}"


@query("sv12_contig_pairs", f"with e as ({EVIDENCE}) select sample, sv_id, 0 as side, contiga as seq from e where contiga <> '' union all select sample, sv_id, 1, contigb from e where contigb <> ''")
def _(t):
    return sv.contig_pairs(t.sql(EVIDENCE))


SITES = """select l_returnflag as sample, concat('c', l_suppkey % 25) as chrom, cast(l_orderkey as bigint) as pos, l_linenumber > 5 as is_indel, cast(case when l_linenumber = 7 then 3 else 0 end as int) as dlen,
 cast(l_quantity as int) as quality, cast((l_suppkey * 7 + l_linenumber) % 61 as int) as mapq, cast(l_extendedprice / 700 as int) as depth, cast(l_linenumber % 3 as int) as support from {lineitem}"""


@query("sv13_site_filter")
def _(t):
    return sv.site_filter(t.sql(SITES))


PILE = """select concat('c', l_suppkey) as chrom, cast(l_orderkey as bigint) as pos, substring('ACGT', cast(l_partkey % 4 + 1 as int), 1) as ref, substring('ACGTMRWSYK', cast(l_orderkey % 10 + 1 as int), 1) as cons from {lineitem}"""


@query(
    "sv14_consensus_to_variants",
    f"""with d as ({PILE}), x as (select *, case cons when 'M' then 'AC' when 'R' then 'AG' when 'W' then 'AT' when 'S' then 'CG' when 'Y' then 'CT' when 'K' then 'GT' else cons || cons end as pair from d),
    y as (select chrom, pos, ref, pair[1] as a, pair[2] as b from x)
    select chrom, pos, ref, case when a = b then a when a = ref then b when b = ref then a else a || ',' || b end as alt,
    case when a = b then '1/1' when a = ref or b = ref then '0/1' else '1/2' end as genotype from y where not (a = ref and b = ref)""",
)
def _(t):
    return sv.consensus_to_variants(t.sql(PILE))


@query("ch1_break_frequency", f"with {P} select chrom, n_breaks, round(p, 15) as p from p")
def _(t):
    return chains.break_frequency(t.breaks, t.chrom_lengths).withColumn("p", F.round("p", 15))


@query("ch2_gap_pvalue", "select event_id, round(1 - power(1 - 0.00001, value * 100), 9) as p_value from {events}")
def _(t):
    return t.events.select("event_id", F.round(chains.gap_pvalue(F.col("value") * 100, F.lit(0.00001)), 9).alias("p_value"))


@query(
    "ch3_neighbour_edges",
    f"""with {P}, u as (select distinct sample, b.chrom, pos, ln(1 - 0.2) / ln(1 - p.p) as bound from {{breaks}} b join p on b.chrom = p.chrom)
    select a.sample, a.chrom, a.pos as pos1, b.pos as pos2 from u a join u b on a.sample = b.sample and a.chrom = b.chrom and b.pos > a.pos and b.pos - a.pos < a.bound""",
)
def _(t):
    return chains.neighbour_edges(t.breaks, chains.break_frequency(t.breaks, t.chrom_lengths), 0.2)


@query("ch4_local_clusters", f"with {CLUSTERS} select * from c")
def _(t):
    return clusters_of(t)


CHAIN_SV = "select sample, chrom, pos, chrom as chrom2, lead(pos) over (partition by sample order by sv_id) as pos2 from {breaks}"


def chains_of(t):
    links = t.sql(
        "select sample, chrom, pos, lead(chrom) over (partition by sample order by sv_id) as chrom2, lead(pos) over (partition by sample order by sv_id) as pos2, sv_id % 8 as k from {breaks}"
    ).where("k = 0")
    return links.drop("k"), chains.chains(links, clusters_of(t))


CHAINS = (
    CLUSTERS
    + """, v as (select sample, chrom, pos, lead(chrom) over (partition by sample order by sv_id) as chrom2, lead(pos) over (partition by sample order by sv_id) as pos2, sv_id % 8 as k from {breaks}),
 n as (select *, sample || '|' || chrom || '|' || lpad(cast(cluster as varchar), 9, '0') as node from c),
 e as (select a.node as a, b.node as b from v join n a on v.sample = a.sample and v.chrom = a.chrom and v.pos = a.pos join n b on v.sample = b.sample and v.chrom2 = b.chrom and v.pos2 = b.pos where v.k = 0),
 w as (select a, b from e union select b, a from e union select node, node from n),
 r as (select a as node, b as root from w union select r.node, w.b from r join w on r.root = w.a),
 m as (select node, min(root) as chain from r group by node),
 ch as (select n.sample, n.chrom, n.pos, n.cluster, m.chain from n join m on n.node = m.node)"""
)


@query("ch5_chains", f"with recursive {CHAINS} select * from ch")
def _(t):
    return chains_of(t)[1]


@query("ch6_chain_size_filter", f"with recursive {CHAINS} select * from ch where chain in (select chain from ch group by chain having count(*) >= 4)")
def _(t):
    return chains.chain_size_filter(chains_of(t)[1], 4)


@query(
    "ch7_cluster_stats",
    f"""with {CLUSTERS}, s as (select *, pos - lag(pos) over (partition by sample, chrom, cluster order by pos) as spacing from c)
    select sample, chrom, cluster, count(*) as n_breaks, max(pos) - min(pos) as size, cast(median(spacing) as double) as median_spacing, string_agg(cast(pos as varchar), ',' order by pos) as positions
    from s group by sample, chrom, cluster""",
)
def _(t):
    return chains.cluster_stats(clusters_of(t))


@query(
    "ch8_cluster_nbinom_p",
    f"""with {CLUSTERS}, s as (select sample, chrom, cluster, cast(count(*) as double) as n, greatest(cast(max(pos) - min(pos) - count(*) as double), 0) as k from c group by 1, 2, 3)
    select sample, s.chrom, cluster, round(exp(lgamma(k + n) - lgamma(k + 1) - lgamma(n) + n * ln(p.p) + k * ln(1 - p.p)), 9) as nbinom_p from s join p on s.chrom = p.chrom""",
)
def _(t):
    out = chains.cluster_nbinom_p(chains.cluster_stats(clusters_of(t)), chains.break_frequency(t.breaks, t.chrom_lengths))
    return out.select("sample", "chrom", "cluster", F.round("nbinom_p", 9).alias("nbinom_p"))


@query(
    "ch9_p_value_sweep",
    f"""with {P}, u as (select distinct sample, b.chrom, pos, p.p from {{breaks}} b join p on b.chrom = p.chrom), x as (select u.*, unnest([0.1, 0.2, 0.30000000000000004]::double[]) as p_val from u),
    g as (select *, ln(1 - p_val) / ln(1 - p) as bound, pos - lag(pos) over (partition by p_val, sample, chrom order by pos) as gap from x),
    c as (select p_val, sample, chrom, sum(case when gap is null or gap >= bound then 1 else 0 end) over (partition by p_val, sample, chrom order by pos) as cluster from g),
    n as (select p_val, sample, chrom, cluster, count(*) as n from c group by all) select round(p_val, 6) as p_val, sample, count(*) as n_clusters, max(n) as largest from n group by p_val, sample""",
)
def _(t):
    return chains.p_value_sweep(t.breaks, chains.break_frequency(t.breaks, t.chrom_lengths), 0.1, 0.30000000000000004, 3).withColumn("p_val", F.round("p_val", 6))


@query(
    "ch10_unique_chain_svs",
    f"""with recursive {CHAINS}, big as (select * from ch where chain in (select chain from ch group by chain having count(*) >= 4))
    select distinct v.sample, v.chrom, v.pos, v.chrom2, v.pos2 from v join big on v.sample = big.sample and v.chrom = big.chrom and v.pos = big.pos where v.k = 0""",
)
def _(t):
    links, found = chains_of(t)
    return chains.unique_chain_svs(links, chains.chain_size_filter(found, 4))


@query(
    "ch11_chain_group_compare",
    f"""with recursive {CHAINS}, s as ({SAMPLES}), n as (select sample, count(distinct chain) as n from ch where chain in (select chain from ch group by chain having count(*) >= 4) group by sample)
    select s.sample, case when v < 50 then 'short' else 'long' end as cohort, coalesce(n.n, 0) as n_chains from s left join n on s.sample = n.sample""".replace("n as (select sample, count", "nn as (select sample, count").replace("left join n on s.sample = n.sample", "left join nn on s.sample = nn.sample").replace("coalesce(n.n, 0)", "coalesce(nn.n, 0)"),
)
def _(t):
    return chains.chain_group_compare(sv.cohort_split(samples_of(t), "v", 50.0).drop("v"), chains.chain_size_filter(chains_of(t)[1], 4))
