"""Queries on assembly graphs, paired reads and pileups."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions.seq import revcomp
from strandloom.operators import correct, graph, kmers, pairs
from strandloom.plans.registry import query

READS = "select event_id as read, translate(md5(cast(event_id as varchar(20))), '0123456789abcdef', 'ACGTACGTACGTACGT') as seq from {events}"
EDGESEQ = "select item_id as edge, item_id % 30 as src, item_id % 17 + 30 as dst, regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz .,', 'ACGTACGTACGTACGTACGTACGTACACG'), '[^ACGT]', ''/*g*/) as seq from {benchmark}"
DOCSEQ = "select doc_id as read, regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz .,', 'ACGTACGTACGTACGTACGTACGTACACG'), '[^ACGT]', ''/*g*/) as seq from {documents}"
RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"
DEG = """o as (select src as v, count(*) as o from {graph_edges} group by 1), i as (select dst as v, count(*) as i from {graph_edges} group by 1), d as (select coalesce(o.v, i.v) as v, coalesce(o, 0) as o, coalesce(i, 0) as i from o full join i on o.v = i.v),
 h as (select e.*, a.o as so, a.i as si, b.o as dout, b.i as din from {graph_edges} e join d a on e.src = a.v join d b on e.dst = b.v),
 t as (select *, si = 0 and dout = 0 and so = 1 and din = 1 as isolated, ((dout = 0 and din = 1) or (si = 0 and so = 1)) and not (si = 0 and dout = 0 and so = 1 and din = 1) as tip from h)"""


@query(
    "gr1_extensions",
    f"""with r as ({READS}), w as (select distinct unnest([x, {RC.format("x")}]) as w from (select unnest(list_transform(range(1, length(seq) - 6), lambda i: substring(seq, i, 8))) as x from r) y),
    o as (select w[1:7] as kmer, w[8] as o, null as i from w union all select w[2:8], null, w[1] from w)
    select kmer, array_to_string(list_sort(list(distinct o) filter (o is not null)), '') as outs, array_to_string(list_sort(list(distinct i) filter (i is not null)), '') as ins, count(o) = 0 as dead_end, count(i) = 0 as dead_start,
    count(distinct o) = 1 and count(distinct i) = 1 as "unique" from o group by kmer""".replace("array_to_string(list_sort(list(distinct o) filter (o is not null)), '')", "coalesce(array_to_string(list_sort(list(distinct o) filter (o is not null)), ''), '')").replace("array_to_string(list_sort(list(distinct i) filter (i is not null)), '')", "coalesce(array_to_string(list_sort(list(distinct i) filter (i is not null)), ''), '')"),
)
def _(t):
    out = graph.extensions(t.sql(READS), 7)
    return out.withColumn("outs", F.array_join("outs", "")).withColumn("ins", F.array_join("ins", ""))


@query("gr2_unitigs")
def _(t):
    return graph.unitigs(graph.saved(graph.extension_masks(t.sql(READS), 11), "masks"), 11)


@query(
    "gr2_unitig_kmers",
    f"""with r as ({READS}), w as (select distinct unnest([x, {RC.format("x")}]) as w from (select unnest(list_transform(range(1, length(seq) - 10), lambda i: substring(seq, i, 12))) as x from r) y),
    k as (select w[1:11] as kmer from w union select w[2:12] from w) select kmer, 1 as n from k""",
)
def _(t):
    """Every k-mer of both strands lies on one place of one unitig."""
    edges = graph.unitigs(graph.saved(graph.extension_masks(t.sql(READS), 11), "masks"), 11)
    spelled = kmers.kmers(edges, 11, ("edge", "conjugate"))
    return spelled.groupBy("kmer").agg(F.count("*").cast("int").alias("n"))


@query("gr2_conjugates", "select cast(0 as bigint) as unpaired, cast(0 as bigint) as misspelled")
def _(t):
    """Edges whose conjugate is missing or isn't told back, and those that don't spell its reverse complement."""
    edges = graph.saved(graph.unitigs(graph.saved(graph.extension_masks(t.sql(READS), 11), "masks"), 11), "unitigs")
    other = edges.select(F.col("edge").alias("conjugate"), F.col("conjugate").alias("back"), revcomp("seq").alias("turned"))
    held = edges.join(other, "conjugate", "left")
    return held.agg(F.count_if(~F.coalesce(F.col("back") == F.col("edge"), F.lit(False))).alias("unpaired"), F.count_if(~F.coalesce(F.col("turned") == F.col("seq"), F.lit(False))).alias("misspelled"))


@query("gr3_early_tip_clip")
def _(t):
    return graph.early_tip_clip(graph.extensions(t.sql(READS), 9), 9, 6).select("kmer")


KS = "select edge, i, least(k, " + RC.format("k") + f") as kmer from (select edge, i, substring(seq, cast(i + 1 as int), 11) as k from ({EDGESEQ}) e, lateral (select unnest(range(0, greatest(length(seq) - 10, 0))) as i) x) y"
DOCK = "select least(k, " + RC.format("k") + f") as kmer, count(*) as n from (select unnest(list_transform(range(1, length(seq) - 9), lambda i: substring(seq, i, 11))) as k from ({DOCSEQ}) d) y group by 1"


@query("gr4_edge_coverage", f"with e as ({KS}), c as ({DOCK}) select edge, round(avg(coalesce(n, 0)), 9) as coverage, round(avg(coalesce(n, 0)) filter (i < 20), 9) as flank_coverage from e left join c on e.kmer = c.kmer group by edge")
def _(t):
    out = graph.edge_coverage(t.sql(EDGESEQ.replace("/*g*/", "")), kmers.kmer_counts(t.sql(DOCSEQ), 11, packed=True), 11, 20)
    return out.select("edge", *(F.round(c, 9).alias(c) for c in ("coverage", "flank_coverage")))


@query("gr5_avg_coverage", "select round(sum(raw_cov) / sum(len), 9) as avg_coverage from {graph_edges}")
def _(t):
    return graph.average_coverage(t.graph_edges).select(F.round("avg_coverage", 9).alias("avg_coverage"))


@query("gr5_cumulative_length", "select cast(sum(len) as bigint) as total_length from {graph_edges} where len >= 300")
def _(t):
    return graph.cumulative_length(t.graph_edges, 300)


@query("gr5_nx", "with o as (select len, sum(len) over (order by len desc) as u, sum(len) over () as t from {graph_edges}) select max(len) as nx from o where u >= 0.5 * t")
def _(t):
    return graph.nx(t.graph_edges, 50)


@query("gr6_median_coverage", "with o as (select raw_cov / len as c, sum(len) over (order by raw_cov / len) as u, sum(len) over () as t from {graph_edges}) select min(c) as median_coverage from o where u >= 0.5 * t")
def _(t):
    return graph.median_coverage(t.graph_edges)


@query(
    "gr6_uniformity_fraction",
    "with o as (select raw_cov / len as c, len, sum(len) over (order by raw_cov / len) as u, sum(len) over () as t from {graph_edges}), m as (select min(c) as m from o where u >= 0.5 * t) select round(sum(case when abs(c - m) <= 0.3 * m then len else 0 end) / sum(len), 9) as uniformity from o, m",
)
def _(t):
    return graph.uniformity_fraction(t.graph_edges, 0.3).select(F.round("uniformity", 9).alias("uniformity"))


SPARSE = "select event_id as edge, cast(event_id as bigint) as src, cast(event_id * event_id % 20011 as bigint) as dst, cast(floor(value * 10) + 1 as bigint) as len, value * 100 as raw_cov from {events}"


@query("gr7_components")
def _(t):
    return graph.graph_components(t.sql(SPARSE))


@query("gr8_component_filter")
def _(t):
    edges = t.sql(SPARSE)
    return graph.component_filter(graph.graph_components(edges), edges, 2, 1000, 100)


@query("gr9_degrees", f"with {DEG} select edge, so as src_out, si as src_in, dout as dst_out, din as dst_in, tip, dout = 0 or si = 0 as dead_end, isolated, so > 1 and din > 1 as alternative, src = dst as loop from t")
def _(t):
    return graph.degrees(t.graph_edges).select("edge", "src_out", "src_in", "dst_out", "dst_in", "tip", "dead_end", "isolated", "alternative", "loop")


TIPS = "select edge, src, edge + 1000000000 as dst, len, raw_cov from {graph_edges}"


@query(
    "gr10_relative_coverage_tip",
    f"""with e as ({TIPS}), c as (select edge, src, raw_cov / len as c, count(*) over (partition by dst) as ways from e), r as (select *, row_number() over (partition by src order by c desc, edge) as n, max(c) over (partition by src) as top, count(*) over (partition by src) as k from c),
    s as (select *, max(case when n = 2 then c end) over (partition by src) as second from r) select edge from s where k > 1 and ways = 1 and c <= 0.9 * ((case when n = 1 then second else top end) + 1)""",
)
def _(t):
    return graph.relative_coverage_tips(t.sql(TIPS), 0.9)


@query(
    "gr11_mismatch_tip",
    f"""with e as ({EDGESEQ}), x as (select item_id + 1000 as edge, src, item_id + 5000 as dst, seq[1:30] as seq from (select *, edge as item_id from e) z), u as (select edge, src, dst, seq from e union all select edge, src, dst, seq from x)
    select distinct a.edge from u a join u b on a.src = b.src and a.edge <> b.edge and length(b.seq) >= length(a.seq) where a.dst in (select dst from u group by dst having count(*) = 1) and a.dst not in (select src from u)
    and exists (select 1 from u z where z.dst = a.src or (select count(*) from u y where y.src = a.src) > 1) and hamming(a.seq, b.seq[1:length(a.seq)]) <= 3""",
)
def _(t):
    e = t.sql(EDGESEQ).select("edge", "src", "dst", "seq")
    more = e.select((F.col("edge") + 1000).alias("edge"), "src", (F.col("edge") + 5000).alias("dst"), F.expr("substring(seq, 1, 30)").alias("seq"))
    return graph.mismatch_tips(e.unionByName(more), 3)


@query("gr12_low_complexity_edge", f"with e as ({EDGESEQ}) select edge from e where greatest(length(seq) - length(replace(seq, 'A', '')), length(seq) - length(replace(seq, 'C', '')), length(seq) - length(replace(seq, 'G', '')), length(seq) - length(replace(seq, 'T', ''))) > 0.32 * length(seq)")
def _(t):
    return graph.low_complexity_edges(t.sql(EDGESEQ), 0.32)


@query("gr13_simplify_round")
def _(t):
    return graph.simplify_round(t.sql(SPARSE), F.col("tip") & graph.coverage_at_most(9.5), 2)


#: Short edges between few vertices, so that most have alternatives, with two humps of coverage.
TANGLED = """select cast(l_orderkey * 10 + l_linenumber as bigint) as edge, cast(l_partkey % 300 as bigint) as src, cast(l_suppkey * 3 + 1000 as bigint) as dst, cast(l_quantity as bigint) as len,
 l_quantity * (case when l_linenumber % 3 = 0 then 1 + l_orderkey % 9 else 30 + (l_orderkey % 13 + l_partkey % 17 + l_suppkey % 5) end + 0.25e0) as raw_cov from {lineitem}"""


@query(
    "gr14_erroneous_connection_threshold",
    f"""with e as ({TANGLED}), o as (select src as v, count(*) as o from e group by 1), i as (select dst as v, count(*) as i from e group by 1), tw as (select src, dst, count(*) as k from e group by 1, 2),
    b as (select cast(floor(raw_cov / len) as bigint) as x, count(*) as n from e join o on e.src = o.v join i on e.dst = i.v join tw on e.src = tw.src and e.dst = tw.dst where len <= 40 and o > 1 and i > 1 and not (o = 2 and i = 2 and k = 2) group by 1),
    f as (select (select sum(raw_cov) / sum(len) from e) as c, (select count(*) from b) as m, (select max(x) + 1 from b) as size), w as (select *, cast(floor(0.3e0 * c + 5) as bigint) as w from f),
    k as (select x - j as v, sum(n * least(j + 1, w - j)) as s from b, w, lateral (select unnest(range(0, w)) as j) y where x < m and x >= j group by 1),
    g as (select u.v, coalesce(s, 0) as s from (select unnest(range(0, size)) as v from w) u left join k on u.v = k.v), r as (select v, case when s > lag(s) over (order by v) then 1 else 0 end as r from g),
    q as (select v, (select coalesce(sum(r), 0) from r z where z.v <= r.v and z.v > r.v - w) as c2, w, size from r, w), t as (select min(v) as v from q where v >= 1 and v + w < size and 2 * c2 >= w)
    select round(coalesce(cast(v as double), 0.1e0 * c), 9) as threshold, round(c, 9) as avg_coverage, round(greatest(coalesce(cast(v as double), 0.1e0 * c), c), 9) as used from t, f""",
)
def _(t):
    return graph.erroneous_connection_threshold(t.sql(TANGLED), 40).select(*(F.round(c, 9).alias(c) for c in ("threshold", "avg_coverage", "used")))


CHOSEN = "select event_id as edge from {events} where event_type in ('click', 'view')"


@query(
    "gr15_expand_component",
    f"with e as ({SPARSE}), c as (select e.* from e where edge in ({CHOSEN})), v as (select src as v from c intersect select dst from c) select distinct edge from (select edge from c union all select edge from e where src in (select v from v) or dst in (select v from v)) x",
)
def _(t):
    return graph.expand_component(t.sql(SPARSE), t.sql(CHOSEN))


@query("gr15_dead_ends", f"with e as ({SPARSE}) select distinct src as v from e where src not in (select dst from e) union all select distinct dst from e where dst not in (select src from e)")
def _(t):
    return graph.dead_ends(t.sql(SPARSE))


@query(
    "gr16_graph_stats",
    f"with {DEG}, n as (select count(distinct v) as n from (select src as v from {{graph_edges}} union all select dst from {{graph_edges}}) x) select any_value(n.n) as n_vertices, count(*) as n_edges, cast(coalesce(sum(len) filter (raw_cov / len > 30), 0) as bigint) as covered_length, count(*) filter (isolated) as n_isolated, count(*) filter (src = dst) as n_loops from t, n",
)
def _(t):
    return graph.graph_stats(t.graph_edges)


@query("gr16_edges_off_paths", f"with e as ({SPARSE}) select * from e where edge not in ({CHOSEN})")
def _(t):
    return graph.edges_off_paths(t.sql(SPARSE), t.sql(CHOSEN))


IDX = f"ix as (select kmer, min(edge) as edge, min(i) as off from (select edge, i, substring(seq, cast(i + 1 as int), 15) as kmer from ({EDGESEQ}) e, lateral (select unnest(range(0, greatest(length(seq) - 14, 0))) as i) x) y group by kmer having count(*) = 1)"


@query(
    "gr17_map_reads",
    f"""with {IDX}, r as (select read, i, ix.edge, off from (select read, i, substring(seq, cast(i + 1 as int), 15) as kmer from ({DOCSEQ}) d, lateral (select unnest(range(0, greatest(length(seq) - 14, 0))) as i) x) y join ix on y.kmer = ix.kmer),
    n as (select *, case when lag(edge) over w is null or lag(edge) over w <> edge or lag(off - i) over w <> off - i or lag(i) over w <> i - 1 then 1 else 0 end as nw from r window w as (partition by read order by i)), g as (select *, sum(nw) over (partition by read order by i) as ord from n)
    select read, cast(ord as bigint) as ord, any_value(edge) as edge, min(i) as q_start, max(i) + 15 as q_end, min(off) as e_start, max(off) + 15 as e_end from g group by read, ord""",
)
def _(t):
    return graph.map_reads(t.sql(DOCSEQ), graph.kmer_edge_index(t.sql(EDGESEQ), 15), 15)


LENS = "select cast(s_suppkey as bigint) as edge, cast(2000 + s_nationkey * 100 as bigint) as len from {supplier}"


@query("gr18_edge_profiles", f"with e as ({LENS}), s as (select distinct sample from {{edge_maps}}), m as (select edge, sample, sum(e_end - e_start) as m from {{edge_maps}} group by 1, 2) select e.edge, s.sample, round(coalesce(m, 0) / len, 9) as profile from e cross join s left join m on m.edge = e.edge and m.sample = s.sample")
def _(t):
    return graph.edge_profiles(t.edge_maps, t.sql(LENS)).withColumn("profile", F.round("profile", 9))


@query("gr19_strand_coverage", f"with e as ({LENS}), m as (select edge, case when read % 2 = 0 then '+' else '-' end as strand, sum(e_end - e_start) as m from {{edge_maps}} group by 1, 2) select m.edge, strand, round(m / len, 9) as coverage from m join e on m.edge = e.edge")
def _(t):
    maps = t.edge_maps.withColumn("strand", F.when(F.col("read") % 2 == 0, "+").otherwise("-"))
    return graph.strand_coverage(maps, t.sql(LENS)).withColumn("coverage", F.round("coverage", 9))


@query(
    "gr20_edge_quality",
    f"""with d as ({DOCSEQ}), k as (select unnest(list_transform(range(1, length(s) - 13), lambda i: substring(s, i, 15))) as kmer from (select seq as s from d union all select {RC.format("seq")} from d) z), n as (select kmer, count(*) as n from k group by 1),
    e as (select edge, unnest(list_transform(range(1, length(seq) - 13), lambda i: substring(seq, i, 15))) as kmer from ({EDGESEQ}) q), h as (select edge, sum(n) as n from e join n on e.kmer = n.kmer group by 1)
    select q.edge, cast(coalesce(n, 0) as bigint) as quality from ({EDGESEQ}) q left join h on q.edge = h.edge""",
)
def _(t):
    return graph.edge_quality(t.sql(EDGESEQ), t.sql(DOCSEQ), 15)


@query("gr21_unused_bridges", f"with e as ({SPARSE}), u as (select * from e where edge in ({CHOSEN})) select edge from e where edge not in ({CHOSEN}) and src in (select dst from u) and dst in (select src from u)")
def _(t):
    return graph.unused_bridges(t.sql(SPARSE), t.sql(CHOSEN))


PATHS = "select user_id as path, event_id as ord, event_id as edge from {events}"


@query(
    "gr22_path_filter",
    f"""with p as ({PATHS}), e as ({SPARSE}), k as (select path, sum(len) as l, max(raw_cov / len) as c from p join e on p.edge = e.edge group by path) select * from p where path in (select path from k where l > 30000 and c > 5)""",
)
def _(t):
    return graph.path_filter(t.sql(PATHS), t.sql(SPARSE), 30000, 5.0)


SUBPATHS = "select l_orderkey as path, l_linenumber as ord, l_suppkey % 3 as edge from {lineitem}"


@query(
    "gr22_dedup_paths",
    f"""with p as ({SUBPATHS}), w as (select path, count(*) as n, ',' || string_agg(edge, ',' order by ord, edge) || ',' as s from p group by path) , x as (select a.path from w a where exists (select 1 from w b where b.path <> a.path and (a.n < b.n or (a.n = b.n and a.path > b.path)) and contains(b.s, a.s)))
    select * from p where path not in (select path from x)""",
)
def _(t):
    return graph.dedup_paths(t.sql(SUBPATHS))


@query(
    "gr23_merge_edge_positions",
    """with g as (select *, q_start - lag(q_end) over w as q, e_start - lag(e_end) over w as e from {edge_maps} window w as (partition by edge, read order by q_start, q_end, e_start, e_end)),
    r as (select *, sum(case when q is null or q > 100 or e > 100 or abs(q - e) > 60 then 1 else 0 end) over (partition by edge, read order by q_start, q_end, e_start, e_end rows between unbounded preceding and current row) as run from g)
    select edge, read, min(q_start) as q_start, max(q_end) as q_end, min(e_start) as e_start, max(e_end) as e_end from r group by edge, read, run""",
)
def _(t):
    return graph.merge_edge_positions(t.edge_maps, 100, 60)


RLEN = "select distinct l_orderkey as read, cast(500 as bigint) as length from {lineitem}"


@query(
    "gr24_path_gaps",
    f"""with x as (select read, q_start, q_end from {{edge_maps}} union all select read, length, length from ({RLEN}) l), u as (select *, coalesce(max(q_end) over (partition by read order by q_start, q_end rows between unbounded preceding and 1 preceding), 0) as gap_start from x)
    select read, gap_start, q_start as gap_end from u where q_start > gap_start""",
)
def _(t):
    return graph.path_gaps(t.edge_maps, t.sql(RLEN))


HIST = "select cast(l_quantity * 10 + l_linenumber as bigint) as insert_size, count(*) as n from {lineitem} group by 1"
MED = "o as (select insert_size, n, sum(n) over (order by insert_size) as u, sum(n) over () as t from h), med as (select min(insert_size) as m from o where u >= 0.5 * t), aw as (select abs(insert_size - m) as d, sum(n) as n from h, med group by 1), ao as (select d, sum(n) over (order by d) as u, sum(n) over () as t from aw), mad as (select min(d) as k from ao where u >= 0.5 * t)"


@query("pi1_insert_size_histogram", f"with e as ({LENS}), a as (select * from {{mates}} where mate = 0), b as (select * from {{mates}} where mate = 1) select b.e_start - a.e_start + b.mapped as insert_size, count(*) as n from a join b on a.pair = b.pair and a.edge = b.edge where a.edge in (select edge from e where len >= 2500) group by 1")
def _(t):
    return pairs.insert_size_histogram(t.mates, t.sql(LENS), 2500)


@query("pi1_counters", f"with h as ({HIST}) select cast(sum(n) as bigint) as mapped, cast(coalesce(sum(n) filter (insert_size < 0), 0) as bigint) as negative from h")
def _(t):
    return pairs.insert_size_counters(t.sql(HIST))


@query("pi2_median_mad", f"with h as ({HIST}), {MED} select m as median, k as mad from med, mad")
def _(t):
    return pairs.median_mad(t.sql(HIST))


@query("pi2_crop", f"with h as ({HIST}), {MED} select insert_size, n from h, med, mad where abs(insert_size - m) <= 1.5 * 1.4826 * k")
def _(t):
    return pairs.crop(t.sql(HIST), 1.5)


MOMENTS = "select sum(insert_size * n) / sum(n) as mean, sqrt(sum(insert_size * insert_size * n) / sum(n) - power(sum(insert_size * n) / sum(n), 2)) as sd from"


@query(
    "pi3_mean_sd_percentiles",
    f"""with h as ({HIST}), {MED}, f as (select h.* from h, med, mad where abs(insert_size - m) <= 5 * 1.4826e0 * k), mo as ({MOMENTS} f), c as (select f.* from f, mo where abs(insert_size - mean) <= 5 * sd), m2 as ({MOMENTS} c),
    o2 as (select insert_size, sum(n) over (order by insert_size) as u, sum(n) over () as t from c), p as (select unnest(range(5, 100, 5)) as percent) select cast(percent as int) as percent, min(insert_size) as value, round(any_value(mean), 6) as mean, round(any_value(sd), 6) as sd from p join o2 on u >= percent / 100e0 * t, m2 group by percent""",
)
def _(t):
    out = pairs.mean_sd_percentiles(t.sql(HIST))
    return out.withColumn("mean", F.round("mean", 6)).withColumn("sd", F.round("sd", 6))


@query("pi4_insert_size_interval", f"with h as ({HIST}), o as (select insert_size, sum(n) over (order by insert_size) as u, sum(n) over () as t from h) select min(insert_size) filter (u >= 0.1 * t) as low, min(insert_size) filter (u >= 0.9 * t) as high from o".replace("0.1 * t", "(1 - 0.8) / 2 * t").replace("0.9 * t", "(1 - (1 - 0.8) / 2) * t"))
def _(t):
    return pairs.insert_size_interval(t.sql(HIST), 0.8)


POINTS = "select a.edge as e1, b.edge as e2, b.e_start - a.e_start as d, cast(sum(a.mapped * b.mapped) as double) as w from {mates} a join {mates} b on a.pair = b.pair and a.mate = 0 and b.mate = 1 group by 1, 2, 3"


@query("pi5_pair_info", POINTS)
def _(t):
    return pairs.pair_info(t.mates, "product")


@query(
    "pi6_cluster_distances",
    f"with p as ({POINTS}), g as (select *, d - lag(d) over (partition by e1, e2 order by d) as g from p), r as (select *, sum(case when g is null or g > 100 then 1 else 0 end) over (partition by e1, e2 order by d) as run from g) select e1, e2, round(sum(d * w) / sum(w), 6) as d, sum(w) as w, (max(d) - min(d)) / 2 as half_width from r group by e1, e2, run",
)
def _(t):
    return pairs.cluster_distances(pairs.pair_info(t.mates, "product"), 100).withColumn("d", F.round("d", 6))


CAND = "select distinct a.edge as e1, b.edge as e2, (b.e_start - a.e_start) // 50 * 50 as path_d from {mates} a join {mates} b on a.pair = b.pair and a.mate = 0 and b.mate = 1"


@query(
    "pi7_snap_to_path_distances",
    f"""with p as ({POINTS}), c as ({CAND}), b as (select p.*, path_d, abs(d - path_d) as gap from p join c on p.e1 = c.e1 and p.e2 = c.e2 where abs(d - path_d) <= 60), r as (select *, rank() over (partition by e1, e2, d order by gap) as r from b),
    n as (select *, count(*) over (partition by e1, e2, d) as ties from r where r = 1) select e1, e2, path_d as d, round(sum(w / ties), 6) as w from n group by 1, 2, 3""",
)
def _(t):
    cand = t.sql(CAND.replace("(b.e_start - a.e_start) // 50 * 50", "cast((b.e_start - a.e_start) div 50 * 50 as bigint)"))
    return pairs.snap_to_path_distances(pairs.pair_info(t.mates, "product"), cand, 60).withColumn("w", F.round("w", 6))


@query("pi8_filter_pair_info", f"with p as ({POINTS}) select * from p where w >= 700")
def _(t):
    return pairs.filter_pair_info(pairs.pair_info(t.mates, "product"), 700)


COVS = "select cast(s_suppkey as bigint) as edge, s_acctbal as coverage from {supplier}"


@query("pi8_filter_by_coverage", f"with p as ({POINTS}), c as ({COVS}) select p.* from p left join c a on p.e1 = a.edge left join c b on p.e2 = b.edge where w >= 600 or w >= 0.1 * a.coverage or w >= 0.1 * b.coverage")
def _(t):
    return pairs.filter_by_coverage(pairs.pair_info(t.mates, "product"), t.sql(COVS), 600)


@query("pi9_scaffold_links", f"with p as ({POINTS}) select e1, e2, sum(w) as w from p where e1 <> e2 and d between -200 and 400 group by 1, 2 having sum(w) >= 900")
def _(t):
    return pairs.scaffold_links(pairs.pair_info(t.mates, "product"), 900, -200, 400)


#: Edges of both strands: supplier 2 i and 2 i + 1 are one edge and its conjugate.
STRANDS = "select cast(s_suppkey as bigint) as edge, cast(200 + s_suppkey // 2 % 5 * 50 as bigint) as len, cast(s_suppkey + 1 - s_suppkey % 2 * 2 as bigint) as conjugate from {supplier}"
STRAND_LINKS = f"p as ({POINTS}), s as ({STRANDS}), l as (select e1, e2, sum(w) as w from p join s on e1 = edge where e1 <> e2 and e2 <> conjugate and d between len - 300 and len + 300 group by 1, 2 having sum(w) >= 700)"


@query("pi9_scaffold_links_strands", f"with {STRAND_LINKS} select * from l")
def _(t):
    return pairs.scaffold_links(pairs.pair_info(t.mates, "product"), 700, -300, 300, t.sql(STRANDS.replace("//", "div")))


@query(
    "pi9_both_strands",
    f"""with {STRAND_LINKS}, t as (select e1, e2, b.conjugate as c1, a.conjugate as c2, w from l join s a on e1 = a.edge join s b on e2 = b.edge)
    select case when (e1, e2) <= (c1, c2) then e1 else c1 end as e1, case when (e1, e2) <= (c1, c2) then e2 else c2 end as e2, max(w) as w from t group by 1, 2""",
)
def _(t):
    edges = t.sql(STRANDS.replace("//", "div"))
    return pairs.both_strands(pairs.scaffold_links(pairs.pair_info(t.mates, "product"), 700, -300, 300, edges), edges)


LINKS = """select cast(l_orderkey % 200 as bigint) as "left", cast(l_suppkey as bigint) as "right", cast(l_linenumber * 7 % 30 + 1 as bigint) as left_offset, cast(30 as bigint) as left_len, cast(l_partkey % 12 as bigint) as right_offset,
 cast(12 as bigint) as right_len, translate(md5(cast(l_orderkey as varchar(20))), '0123456789abcdef', 'ACGTACGTACGTACGT') as read, cast(l_partkey % 25 as bigint) as seq_start, cast(l_suppkey % 32 as bigint) as seq_end from {lineitem}"""
GAPS = f"""l as ({LINKS}), a as (select *, least(greatest(seq_start - seq_end + 1, 0), left_offset - 1) as ls from l), b as (select *, seq_start - ls as s, left_offset - ls as lo from a),
 c as (select *, least(greatest(s - seq_end + 1, 0), right_len - right_offset - 1) as rs from b), d as (select *, seq_end + rs as e, right_offset + rs as ro from c),
 g as (select "left", "right", e - s as gap, left_len - lo as left_trim, ro as right_trim, substring(read, cast(s + 1 as int), cast(e - s as int)) as fill from d where s >= 0 and e <= length(read) and s < e)"""


@query("pi10_gap_table", f"with {GAPS} select * from g")
def _(t):
    return pairs.gap_table(t.sql(LINKS.replace('"left"', "left").replace('"right"', "right")))


@query(
    "pi10_gap_conjugates",
    f"""with {GAPS}, s as (select edge + 1 - edge % 2 * 2 as conjugate, edge from (select unnest(range(0, 1000)) as edge) x)
    select b.conjugate as "left", a.conjugate as "right", gap, right_trim as left_trim, left_trim as right_trim, {RC.format("fill")} as fill from g join s a on g."left" = a.edge join s b on g."right" = b.edge""",
)
def _(t):
    gaps = pairs.gap_table(t.sql(LINKS.replace('"left"', "left").replace('"right"', "right")))
    return pairs.gap_conjugates(gaps, t.spark.range(1000).select(F.col("id").alias("edge"), (F.col("id") + 1 - F.col("id") % 2 * 2).alias("conjugate")))


CONTIG = "select concat('c', item_id) as contig, regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz .,', 'ACGTACGTACGTACGTACGTACGTACACG'), '[^ACGT]', ''/*g*/) as seq from {benchmark}"
ALN = f"""select 's' as sample, concat('r', l_orderkey, '_', l_linenumber) as qname, 0 as flag, c.contig, cast(l_partkey % 40 + 1 as bigint) as pos,
 case when l_suppkey % 7 = 0 then '20M1I9M' when l_suppkey % 5 = 0 then '15M2D15M' else '30M' end as cigar,
 concat(substring(c.seq, cast(l_partkey % 40 + 1 as int), 10), substring('ACGT', cast(l_suppkey % 4 + 1 as int), 1), substring(c.seq, cast(l_partkey % 40 + 12 as int), 19)) as seq
 from {{lineitem}} l join ({CONTIG}) c on c.contig = concat('c', l.l_orderkey % 40) where length(c.seq) > 80"""


#: The three CIGAR strings of ALN spelled out, base by base.
VOTES = f"""a as ({ALN}), m as (select contig, pos + i as pos, substring(seq, cast(i as int) + 1, 1) as variant, cast(null as varchar) as inserted from a, lateral (select unnest(range(0, case cigar when '30M' then 30 when '20M1I9M' then 20 else 15 end)) as i) x
 union all select contig, pos + 20 + i, substring(seq, cast(i as int) + 22, 1), null from a, lateral (select unnest(range(0, 9)) as i) x where cigar = '20M1I9M' union all select contig, pos + 17 + i, substring(seq, cast(i as int) + 16, 1), null from a, lateral (select unnest(range(0, 15)) as i) x where cigar = '15M2D15M'
 union all select contig, pos + 15 + i, 'D', null from a, lateral (select unnest(range(0, 2)) as i) x where cigar = '15M2D15M' union all select contig, pos + 19, 'I', substring(seq, 21, 1) from a where cigar = '20M1I9M'),
 v as (select contig, pos, upper(variant) as variant, inserted, count(*) as votes from m where variant <> '' group by 1, 2, 3, 4)"""
CONSENSUS = f"""{VOTES}, own as (select contig, i as pos, upper(substring(seq, cast(i as int), 1)) as base from ({CONTIG}) c, lateral (select unnest(range(1, length(seq) + 1)) as i) x),
 pl as (select contig, pos, variant, sum(votes) as votes from v where variant <> 'I' group by 1, 2, 3), rk as (select pl.*, base, row_number() over (partition by pl.contig, pl.pos order by votes desc, variant = base desc, instr('ACGTND', variant)) as nth from pl join own on pl.contig = own.contig and pl.pos = own.pos),
 ir as (select contig, pos, inserted, sum(votes) over (partition by contig, pos) as total, row_number() over (partition by contig, pos order by votes desc, inserted desc) as nth from v where variant = 'I'),
 cs as (select rk.contig, rk.pos, base, variant, case when total * 1.5e0 > votes then inserted end as inserted from rk left join ir on rk.contig = ir.contig and rk.pos = ir.pos and ir.nth = 1 where rk.nth = 1)"""


def votes(t):
    return correct.alignment_votes(t.sql(ALN))


@query("co1_pileup_votes", f"with {VOTES} select * from v")
def _(t):
    return votes(t)


#: The contigs with some bases undefined.
HOLES = f"select contig, case when length(seq) % 3 = 0 then concat(substring(seq, 1, 30), 'NN', substring(seq, 33), seq, seq, 'n') else seq end as seq from ({CONTIG}) h"


@query(
    "co2_interesting_positions",
    f"""with {VOTES}, c as ({HOLES}), b as (select contig, pos, variant, sum(votes) as w, sum(sum(votes)) over (partition by contig, pos) as total from v where variant in ('A', 'C', 'G', 'T', 'N') group by 1, 2, 3),
    mx as (select b.contig, pos from b join c on b.contig = c.contig and pos <= length(seq) where total > 20 and w > 0.1e0 * total and w < 0.9e0 * total group by 1, 2 having count(*) > 1),
    n as (select contig, i as pos from (select contig, unnest(range(1, length(seq) + 1)) as i, unnest(string_split(seq, '')) as x from c where seq <> '') y where upper(x) not in ('A', 'C', 'G', 'T')),
    o as (select contig, pos, min(kind) as kind from (select contig, pos, 'mixed' as kind from mx union all select contig, pos, 'undefined' from n) z group by 1, 2),
    an as (select distinct o.contig, ((pos - 1) // 100 + j) * 100 + 1 as pos, length(seq) as len from o join c on o.contig = c.contig, lateral (select unnest(range(-6, 7)) as j) k)
    select contig, pos, kind from o union all select contig, pos, 'anchor' from an where pos >= 1 and pos <= len and not exists (select 1 from o where o.contig = an.contig and o.pos = an.pos)""",
)
def _(t):
    return correct.interesting_positions(votes(t), t.sql(HOLES))


@query("co3_consensus", f"with {CONSENSUS} select * from cs")
def _(t):
    return correct.consensus(votes(t), t.sql(CONTIG))


@query(
    "co4_corrected_contigs",
    f"""with {CONSENSUS}, p as (select own.contig, own.pos, base as own, (case when variant is null or variant = 'N' then own.base when variant = 'D' then '' else variant end) || coalesce(inserted, '') as piece from own left join (select contig, pos, variant, inserted from cs) c on own.contig = c.contig and own.pos = c.pos)
    select contig, string_agg(piece, '' order by pos) as seq, count(*) filter (piece <> own) as n_changes from p group by contig""",
)
def _(t):
    c = t.sql(CONTIG)
    return correct.corrected_contigs(c, correct.consensus(votes(t), c))


@query("co5_read_weighted_consensus")
def _(t):
    aln, contigs = t.sql(ALN), t.sql(CONTIG)
    return correct.alignment_weighted_consensus(aln, correct.interesting_positions(correct.alignment_votes(aln), contigs), contigs)
