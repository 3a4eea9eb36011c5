"""Queries on coverage and copy number."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import cn
from strandloom.plans.registry import query

MEDIAN = "(select median(coverage) from {coverage} where gc between 30 and 60 and map between 20 and 60)"
CELLS = f"cells as (select gc, map, median(coverage) - {MEDIAN} as value from {{coverage}} group by gc, map having median(coverage) < 1000)"
KEYS = ["sample", "chrom"]
WIDE = dict(gc=(30, 60), mappable=(20, 60))


def cells_of(t):
    return cn.gc_map_matrix(t.coverage, **WIDE)


@query("cn1_genomic_median", f"select cast({MEDIAN} as double) as genomic_median")
def _(t):
    return cn.genomic_median(t.coverage, **WIDE)


@query("cn2_gc_map_matrix", "with m as (select median(coverage) as m from {coverage} where gc between 30 and 60 and map between 20 and 60) select gc, map, median(coverage) - any_value(m.m) as value from {coverage}, m group by gc, map having median(coverage) < 1000")
def _(t):
    return cells_of(t)


@query("cn3_smooth_matrix")
def _(t):
    return cn.smooth_matrix(cells_of(t))


@query("cn4_normalise", f"with {CELLS} select c.*, case when cells.value is null then 0 else coverage - cells.value end as normalised from {{coverage}} c left join cells on c.gc = cells.gc and c.map = cells.map")
def _(t):
    return cn.normalise(t.coverage, cells_of(t))


HAAR = """with r as (select sample, chrom, bin, coverage as x, row_number() over (partition by sample, chrom order by bin) - 1 as i, count(*) over (partition by sample, chrom) as n from {coverage}),
 a as (select sample, chrom, n, i // 2 as j, arg_min(x, i) as u, arg_max(x, i) as v from r group by 1, 2, 3, 4), d1 as (select sample, chrom, j, (u - v) / sqrt(2) as d1, (u + v) / sqrt(2) as s1, n from a),
 b as (select sample, chrom, n, j // 2 as k, arg_min(s1, j) as u, arg_max(s1, j) as v from d1 group by 1, 2, 3, 4), d2 as (select sample, chrom, k, (u - v) / sqrt(2) as d2, (u + v) / sqrt(2) as s2 from b),
 c as (select sample, chrom, median(d1) as c from d1 group by 1, 2), g as (select d1.sample, d1.chrom, median(abs(d1 - c)) / 0.6745 * sqrt(2 * ln(any_value(n))) as lim from d1 join c on d1.sample = c.sample and d1.chrom = c.chrom group by 1, 2)
 select r.sample, r.chrom, r.bin, round(((s2 + (case when (i // 2) % 2 = 0 then 1 else -1 end) * sign(d2) * greatest(abs(d2) - lim, 0)) / sqrt(2) + (case when i % 2 = 0 then 1 else -1 end) * sign(d1) * greatest(abs(d1) - lim, 0)) / sqrt(2), 6) as denoised
 from r join d1 on r.sample = d1.sample and r.chrom = d1.chrom and d1.j = r.i // 2 join d2 on r.sample = d2.sample and r.chrom = d2.chrom and d2.k = r.i // 4 join g on r.sample = g.sample and r.chrom = g.chrom"""


@query("cn5_haar_denoise", HAAR)
def _(t):
    return cn.haar_denoise(t.coverage, KEYS).withColumn("denoised", F.round("denoised", 6))


PAIRS = "select 'A' as tumour, 'N' as normal union all select 'R', 'N'"


@query("cn6_relative_cn", f"with p as ({PAIRS}) select tumour, normal, a.chrom, a.bin, a.coverage - b.coverage as relative from p join {{coverage}} a on a.sample = tumour join {{coverage}} b on b.sample = normal and a.chrom = b.chrom and a.bin = b.bin")
def _(t):
    return cn.relative_cn(t.coverage, t.sql(PAIRS))


@query(
    "cn7_winsorize",
    """with m as (select sample, chrom, median(coverage) as c from {coverage} group by 1, 2), d as (select v.sample, v.chrom, c, 1.4826 * median(abs(coverage - c)) as mad from {coverage} v join m on v.sample = m.sample and v.chrom = m.chrom group by 1, 2, 3)
    select v.sample, v.chrom, v.bin, round(least(greatest(coverage, c - 2.5 * mad), c + 2.5 * mad), 6) as winsorized from {coverage} v join d on v.sample = d.sample and v.chrom = d.chrom""",
)
def _(t):
    return cn.winsorize(t.coverage, KEYS).select("sample", "chrom", "bin", F.round("winsorized", 6).alias("winsorized"))


@query("cn8_pcf_segments")
def _(t):
    return cn.pcf_segments(t.coverage, gamma=2e4, kmin=5)


@query("cn9_segment_rows")
def _(t):
    return cn.segment_rows(cn.pcf_segments(t.coverage, gamma=2e4, kmin=5))


@query("cn10_pcf_score", "select sample, chrom, round(sum(abs(mean)), 6) as score from {segments} group by sample, chrom")
def _(t):
    return cn.pcf_score(t.segments).withColumn("score", F.round("score", 6))


@query("cn11_segment_count", "select sample, chrom, count(*) filter (abs(mean) > 0.025) as n_segments from {segments} group by sample, chrom")
def _(t):
    return cn.segment_count(t.segments, 0.025)


@query("cn12_low_pass", "select sample, chrom, bin, round(avg(coverage) over (partition by sample, chrom order by bin rows between 5 preceding and 5 following), 6) as signal from {coverage}")
def _(t):
    return cn.low_pass(t.coverage, KEYS).withColumn("signal", F.round("signal", 6))


@query(
    "cn13_lowpass_score",
    """with s as (select sample, chrom, bin, coverage as y from {coverage}), x as (select *, lag(y) over w as b, lead(y) over w as a from s window w as (partition by sample, chrom order by bin)),
    p as (select * from x where (y > b and y > a) or (y < b and y < a)), d as (select *, abs(y - lag(y) over (partition by sample, chrom order by bin)) as step from p)
    select sample, chrom, round(sum(case when step > 0.5 then step else 0 end), 6) as score from d group by sample, chrom""",
)
def _(t):
    return cn.lowpass_score(t.coverage.select("sample", "chrom", "bin", F.col("coverage").alias("signal")), KEYS)


@query("cn14_gain_loss", "select sample, case when mean > 0.025 then 'Gain' when mean < -0.025 then 'Loss' else 'Neutral' end as state, count(*) as n_segments, cast(sum(n_probes) as bigint) as n_probes from {segments} group by 1, 2")
def _(t):
    return cn.gain_loss(t.segments, 0.025)


BINS = "select chrom, cast(b * 5000 as bigint) as r_start, cast(b * 5000 + 5000 as bigint) as r_end from (select distinct chrom, cast(floor(start / 5000) as bigint) as b from {segments}) x"


@query(
    "cn15_heatmap_bins",
    f"""with b as ({BINS}) select sample, s.chrom, r_start as bin_start, round(sum(mean * (least("end", r_end) - greatest(start, r_start))) / sum(least("end", r_end) - greatest(start, r_start)), 9) + 0.0 as mean
    from {{segments}} s join b on s.chrom = b.chrom and start < r_end and r_start < "end" group by 1, 2, 3""",
)
def _(t):
    return cn.heatmap_bins(t.segments, t.sql(BINS), 5000).withColumn("mean", F.round("mean", 9) + 0.0)
