"""Queries on alignment records."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import aln, intervals
from strandloom.plans.registry import query

SPAN = "cast(coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1), lambda x: cast(x as bigint))), 0) as bigint)"
SPANS = f"s as (select *, pos - 1 as start, pos - 1 + {SPAN} as stop from {{aln}})"
EVIDENCE = "((flag & 258) = 0 or len(list_filter(regexp_extract_all(cigar, '([0-9]+)S', 1), lambda x: cast(x as int) > 20)) > 0)"
HITS = f"{SPANS}, h as (select s.*, r.region, r.r_start, r.r_end from s join {{regions}} r on s.sample = r.sample and s.contig = r.contig and start < r_end and r_start < stop where {EVIDENCE})"
MERGE = """m as (select *, max(stop) over (partition by sample, contig order by start, stop rows between unbounded preceding and 1 preceding) as b from i),
 n as (select *, sum(case when b is null or start > b then 1 else 0 end) over (partition by sample, contig order by start, stop rows between unbounded preceding and current row) as g from m)"""
OPS = """o as (select a.*, unnest(regexp_extract_all(cigar, '([0-9]+[MIDNSHP=X])', 1)) as x, generate_subscripts(regexp_extract_all(cigar, '([0-9]+[MIDNSHP=X])', 1), 1) - 1 as nth from {aln} a),
 p as (select *, cast(regexp_extract(x, '[0-9]+') as int) as len, right(x, 1) as op from o),
 q as (select *, cast(coalesce(sum(case when op in ('M', 'I', 'S', '=', 'X') then len else 0 end) over w, 0) as bigint) as q_start, cast(pos + coalesce(sum(case when op in ('M', 'D', 'N', '=', 'X') then len else 0 end) over w, 0) as bigint) as r_start
   from p window w as (partition by sample, qname, flag, contig, pos, cigar order by nth rows between unbounded preceding and 1 preceding))"""


def hits(t):
    return aln.evidence_reads(t.aln, t.regions)


@query("al1_evidence_reads", f"with {HITS} select sample, qname, flag, pos, region from h")
def _(t):
    return hits(t).select("sample", "qname", "flag", "pos", "region")


@query("al2_cap_region", f"with {HITS}, r as (select *, row_number() over (partition by sample, region order by md5('0|' || qname || '|' || flag || '|' || pos), qname, flag, pos) as nth from h) select sample, qname, flag, pos, region from r where nth <= 2")
def _(t):
    return aln.cap_region(hits(t), 2).select("sample", "qname", "flag", "pos", "region")


@query("al3_merge_intervals", f"with {SPANS}, i as (select sample, contig, start, stop from s), {MERGE} select sample, contig, min(start) as start, max(stop) as \"end\", count(*) as members from n group by sample, contig, g")
def _(t):
    return intervals.merge_intervals(aln.spans(t.aln), ["sample", "contig"])


@query(
    "al4_mate_regions",
    f"""with i as (select sample, case when rnext = '=' then contig else rnext end as contig, pnext - 350 as start, pnext + 350 as stop from {{aln}}), {MERGE}
    select sample, contig, min(start) as start, max(stop) as "end", count(*) as members from n group by sample, contig, g having count(*) >= 2""",
)
def _(t):
    return aln.mate_regions(t.aln)


@query("al5_expand_regions")
def _(t):
    return aln.expand_regions(t.aln, t.regions.select("sample", "contig", F.col("r_start").alias("start"), F.col("r_end").alias("end")), max_depth=3)


@query("al6_dedup_reads", "with r as (select *, row_number() over (partition by sample, qname, flag order by pos, contig, cigar) as nth from {aln}) select sample, qname, flag, pos, contig, cigar from r where nth = 1")
def _(t):
    return aln.dedup_reads(t.aln)


@query(
    "al7_split_singles_pairs",
    """select sample, qname, flag, contig, pos, case when count(*) over (partition by sample, qname) = 2 then 'pair' else 'single' end as kind,
    row_number() over (partition by sample, qname order by flag & 64 desc, flag, pos, contig, cigar) as mate_order from {aln}""",
)
def _(t):
    return aln.split_singles_pairs(t.aln)


@query("al7_group_sizes", "select size, count(*) as n_names from (select count(*) as size from {aln} group by sample, qname) x group by size")
def _(t):
    return aln.group_sizes(t.aln)


@query("al8_cigar_ops", f"with {OPS} select sample, qname, flag, contig, pos, nth, op, len, q_start, r_start from q")
def _(t):
    return aln.cigar_ops(t.aln)


@query("al9_ref_span", f"select qname, flag, pos, {SPAN} as ref_span from {{aln}}")
def _(t):
    return aln.with_ref_span(t.aln).select("qname", "flag", "pos", "ref_span")


@query(
    "al10_query_interval",
    """with x as (select *, coalesce(try_cast(regexp_extract(cigar, '^([0-9]+)[SH]', 1) as int), 0) as a, coalesce(try_cast(regexp_extract(cigar, '([0-9]+)[SH]$', 1) as int), 0) as z,
    cast(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MISH=X]', 1), lambda v: cast(v as bigint))) as bigint) as n, ((flag & 16) = 16) <> (mapq % 2 = 1) as turn from {aln})
    select qname, flag, pos, case when turn then z else a end as q_start, case when turn then n - a else n - z end as q_end from x""",
)
def _(t):
    return aln.query_interval(t.aln.withColumn("primary_reverse", F.col("mapq") % 2 == 1)).select("qname", "flag", "pos", "q_start", "q_end")


@query(
    "al11_flagstat",
    """with x as (select *, (flag & 512) > 0 as qc_fail, (flag & 2304) = 0 and (flag & 1) > 0 as mp, (flag & 4) = 0 as ok from {aln})
    select qc_fail, count(*) as total, count(*) filter ((flag & 256) > 0) as secondary, count(*) filter ((flag & 256) = 0 and (flag & 2048) > 0) as supplementary, count(*) filter ((flag & 1024) > 0) as duplicates,
    count(*) filter (ok) as mapped, count(*) filter (mp) as paired, count(*) filter (mp and (flag & 64) > 0) as read1, count(*) filter (mp and (flag & 128) > 0) as read2,
    count(*) filter (mp and (flag & 2) > 0 and ok) as properly_paired, count(*) filter (mp and (flag & 12) = 0) as both_mapped, count(*) filter (mp and (flag & 8) > 0 and ok) as singletons from x group by qc_fail""",
)
def _(t):
    return aln.flagstat(t.aln)


DEPTH = f"{OPS}, u as (select sample, contig, unnest(range(r_start, r_start + len)) as pos from q where op in ('M', '=', 'X') and (flag & 1796) = 0 and mapq >= 10)"


@query("al12_depth", f"with {DEPTH} select sample, contig, pos, count(*) as depth from u group by 1, 2, 3")
def _(t):
    return aln.depth(t.aln, 10)


@query("al13_bedcov", f"with {DEPTH}, d as (select distinct contig, r_start, r_end from {{regions}}) select sample, u.contig, d.r_start, d.r_end, count(*) as summed_depth from u join d on u.contig = d.contig and pos > r_start and pos <= r_end group by 1, 2, 3, 4")
def _(t):
    return aln.bedcov(t.regions.select("contig", "r_start", "r_end").distinct(), t.aln, 10)


@query(
    "al14_rmdup_pairs",
    """with l as (select *, row_number() over (partition by sample, contig, pos, tlen order by base_quality desc, qname, flag) as nth from {aln} where (flag & 4) = 0 and (flag & 2304) = 0 and rnext = '=' and tlen > 0)
    select a.* from {aln} a where not exists (select 1 from l where nth > 1 and l.sample = a.sample and l.qname = a.qname)""",
)
def _(t):
    return aln.rmdup_pairs(t.aln)


SINGLE = f"x as (select *, (flag & 4) = 0 and (flag & 2304) = 0 as ok, case when (flag & 16) = 16 then pos + {SPAN} - 1 else pos end as outer_pos from {{aln}}), y as (select *, row_number() over (partition by sample, contig, flag & 16, outer_pos, ok order by base_quality desc, qname, flag, pos, cigar) as nth from x)"


@query("al15_rmdup_single", f"with {SINGLE} select sample, qname, contig, pos, flag, cigar from y where not ok or nth = 1")
def _(t):
    return aln.rmdup_single(t.aln).select("sample", "qname", "contig", "pos", "flag", "cigar")


@query("al16_dup_rate", f"with {SINGLE} select sample, count(*) as checked, count(*) filter (nth > 1) as removed, count(*) filter (nth > 1) / count(*) as rate from y where ok group by sample")
def _(t):
    return aln.dup_rate(t.aln)


MATES = f"""{SPANS}, f as (select *, row_number() over (partition by sample, qname, flag & 192 order by contig, pos, flag, cigar, stop) as nth from s where (flag & 2304) = 0 and (flag & 1) = 1),
 a as (select sample, qname, contig, pos, flag, cigar, stop from f where (flag & 64) = 64 and nth = 1), b as (select sample, qname, contig, pos, flag, cigar, stop from f where (flag & 128) = 128 and nth = 1)"""


@query(
    "al17_fixmate",
    f"""with {MATES}, x as (select a.sample, a.qname, a.contig, a.pos, a.flag, a.stop, b.contig as oc, b.pos as op, b.flag as ofl, b.stop as os from a join b on a.sample = b.sample and a.qname = b.qname
    union all select a.sample, a.qname, b.contig, b.pos, b.flag, b.stop, a.contig, a.pos, a.flag, a.stop from a join b on a.sample = b.sample and a.qname = b.qname)
    select sample, qname, contig, pos, (flag & ~40) + (case when (ofl & 4) > 0 then 8 else 0 end) + (case when (ofl & 16) > 0 then 32 else 0 end) as flag, case when contig = oc then '=' else oc end as rnext, op as pnext,
    case when contig = oc and (flag & 4) = 0 and (ofl & 4) = 0 then (case when (ofl & 16) > 0 then os else op - 1 end) - (case when (flag & 16) > 0 then stop else pos - 1 end) else 0 end as tlen from x""",
)
def _(t):
    return aln.fixmate(t.aln)




@query(
    "al18_template_cigar",
    f"""with {MATES.replace("from {aln}", "from (select * replace (concat('k', cast(substring(contig, 2) as bigint) % 5) as contig) from {aln}) z")},
    x as (select a.sample, a.qname, a.contig, a.pos, a.stop, b.pos as mp, b.stop as ms, '1' || (case when (a.flag & 16) > 0 then 'R' else 'F' end) || a.cigar as u, '2' || (case when (b.flag & 16) > 0 then 'R' else 'F' end) || b.cigar as v
    from a join b on a.sample = b.sample and a.qname = b.qname and a.contig = b.contig)
    select sample, qname, contig, case when pos <= mp then u || (mp - 1 - stop) || 'T' || v else v || (pos - 1 - ms) || 'T' || u end as template from x""",
)
def _(t):
    few = t.aln.withColumn("contig", F.concat(F.lit("k"), (F.expr("cast(substring(contig, 2) as bigint)") % 5).cast("string")))
    return aln.template_cigar(few)


@query(
    "al19_indel_by_homopolymer",
    f"""with {OPS}, w as (select q.sample, op, case when length(regexp_extract(substring(seq, r_start), '^(A+|C+|G+|T+|N+|)', 1)) >= 2 then 'long' else 'short' end as in_run from q join {{reference}} r on q.contig = r.contig where op in ('I', 'D') and len = 1)
    select sample, op, in_run, count(*) as n from w group by 1, 2, 3""",
)
def _(t):
    return aln.indel_by_homopolymer(t.aln, t.reference, 2)


TRUTH = "select *, case when score % 9 = 0 then 'x' else contig end as true_contig, pos + score % 40 as true_pos from {aln}"


@query(
    "al20_mapping_accuracy",
    f"""with a as ({TRUTH}), d as (select mapq // 10 as decile, count(*) filter (contig <> true_contig or abs(pos - true_pos) > 20) as wrong, count(*) as total from a where (flag & 4) = 0 group by 1)
    select decile, wrong, total, cast(sum(wrong) over (order by decile desc) as bigint) as cum_wrong, cast(sum(total) over (order by decile desc) as bigint) as cum_total from d""",
)
def _(t):
    return aln.mapping_accuracy(t.sql(TRUTH))


@query("al21_aligned_contigs", "select distinct sample, qname, contig from {aln} where (flag & 4) = 0 and mapq > 0")
def _(t):
    return aln.aligned_contigs(t.aln)


@query("al22_proper_alignment", "select qname, flag, pos, case when (flag & 16) > 0 then '-' else '+' end as strand from {aln} where (flag & 4) = 0 and (flag & 2304) = 0 and mapq <> 0")
def _(t):
    return aln.proper_alignments(t.aln).select("qname", "flag", "pos", "strand")


@query("al23_primary_alignment", "with r as (select *, row_number() over (partition by sample, qname order by (flag & 2304) = 0 desc, score desc, contig, pos, flag, cigar) as nth from {aln}) select sample, qname, contig, pos, flag from r where nth = 1")
def _(t):
    return aln.primary_alignment(t.aln).select("sample", "qname", "contig", "pos", "flag")


@query("al24_aln_to_bed", f"with {SPANS} select contig, start, stop as \"end\", qname, mapq, case when (flag & 16) > 0 then '-' else '+' end as strand from s")
def _(t):
    return aln.to_bed(t.aln)


@query("al25_concat_alignments", "select * from {aln} union all select * from {aln} where mapq > 30")
def _(t):
    return aln.concat_alignments([t.aln, t.aln.where("mapq > 30")])


@query("al26_shuffle_by_name", "select sample, qname, flag, pos from {aln}")
def _(t):
    return aln.shuffle_by_name(t.aln).select("sample", "qname", "flag", "pos")


@query(
    "al27_covered_regions",
    f"""with s0 as (select *, pos - 1 as start, pos - 1 + {SPAN} as stop from {{aln}} where (flag & 4) = 0),
    m as (select *, max(stop) over (partition by sample, contig order by start, stop rows between unbounded preceding and 1 preceding) as b from s0),
    n as (select *, sum(case when b is null or start > b + 200 then 1 else 0 end) over (partition by sample, contig order by start, stop rows between unbounded preceding and current row) as g from m),
    r as (select sample, contig, min(start) as start, max(stop) as stop, sum(stop - start) as bases from n group by sample, contig, g)
    select sample, contig, start, stop as "end", round(bases / (stop - start), 9) as coverage from r where stop - start > 100 and bases / (stop - start) > 0.2""",
)
def _(t):
    return aln.covered_regions(t.aln, 200, 0.2, 100).withColumn("coverage", F.round("coverage", 9))


@query("al28_extract_regions", "select g.contig || '_(' || r_start || '-' || r_end || ')' as name, substring(seq, r_start + 1, r_end - r_start) as seq from {regions} g join {reference} r on g.contig = r.contig")
def _(t):
    return aln.extract_regions(t.regions.select("contig", F.col("r_start").alias("start"), F.col("r_end").alias("end")), t.reference)


MAPS = "select qname as read, contig, cast(mapq as bigint) as q_start, cast(mapq + span as bigint) as q_end, 60 as read_length, base_quality % 101 / 100.0e0 as identity from {aln}"


@query(
    "al29_longest_mapping",
    f"""with m as ({MAPS}), r as (select *, q_end - q_start as length, row_number() over (partition by read order by q_end - q_start desc, identity desc, contig desc) as nth from m where q_end - q_start > 0.5 * read_length)
    select read, length, identity, contig from r where nth = 1""",
)
def _(t):
    return aln.longest_mapping(t.sql(MAPS), 0.5)


@query(
    "al30_alignment_report",
    f"""with m as ({MAPS}), r as (select *, q_end - q_start as length, row_number() over (partition by read order by q_end - q_start desc, identity desc) as nth from m), g as (select * from r where nth = 1 and length > least(0.5 * read_length, 1000))
    select (select count(distinct read) from m) as n_reads, count(*) as n_aligned, count(*) / (select count(distinct read) from m) as share, round(avg(identity), 9) as mean_identity from g""",
)
def _(t):
    maps = t.sql(MAPS)
    return aln.alignment_report(maps, maps, 0.5).withColumn("mean_identity", F.round("mean_identity", 9))
