"""Queries on sequences and reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions.packed import unpack
from strandloom.functions.seq import complement, hamming, revcomp
from strandloom.operators import kmers, seqs
from strandloom.plans.registry import query
from strandloom.plans.tables import saved

RC = "reverse(translate({0}, 'ACGTacgt', 'TGCAtgca'))"
QUAL = "translate(substring(md5(cast({0} as varchar(20))), 1, 32), '0123456789abcdef', '!#%&+59=AEFGHIJK')"
SHORT = f"select event_id as read_id, user_id as pair, event_id % 2 + 1 as mate, translate(md5(cast(event_id as varchar(20))), '0123456789abcdef', 'ACGTACGTACGTACGN') as seq, {QUAL.format('event_id + 7')} as qual from {{events}}"
KM = "select c.doc_id, substring(c.seq, i, {k}) as kmer, i from ({src}) c, lateral (select unnest(range(1, length(c.seq) - {k} + 2)) as i) x"
CAN = "least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA')))"
CONTIGS = "select doc_id, seq from {contigs}"


def km(k: int, src: str = CONTIGS) -> str:
    return KM.replace("{k}", str(k)).replace("{src}", src)


@query("sq1_revcomp", f"select doc_id, {RC.format('seq')} as rc, translate(seq, 'ACGTacgt', 'TGCAtgca') as comp, reverse(seq) as rev from {{raw}}")
def _(t):
    return t.raw.select("doc_id", revcomp("seq").alias("rc"), complement("seq").alias("comp"), F.reverse("seq").alias("rev"))


@query("sq2_with_rc", f"select doc_id, false as reverse, seq from {{contigs}} union all select doc_id, true, {RC.format('seq')} from {{contigs}}")
def _(t):
    return seqs.with_rc(t.contigs.select("doc_id", "seq"))


@query("sq3_orient", f"with r as ({SHORT}) select read_id, mate, case when mate = 2 then {RC.format('seq')} else seq end as seq from r")
def _(t):
    return seqs.orient(t.sql(SHORT), "FR").select("read_id", "mate", "seq")


@query("sq4_valid_filter", f"with r as ({SHORT}) select read_id, seq from r where not regexp_matches(seq, '[^ACGT]') and seq <> ''")
def _(t):
    return seqs.valid_filter(t.sql(SHORT)).select("read_id", "seq")


@query("sq5_longest_valid", "with x as (select doc_id, regexp_extract_all(seq, '[ACGT]+') as r from {raw}) select doc_id, case when len(r) = 0 then '' else list_filter(r, lambda v: length(v) = list_max(list_transform(r, lambda w: length(w))))[1] end as seq from x")
def _(t):
    return seqs.longest_valid(t.raw.select("doc_id", "seq"))


@query("sq6_split_on_ns", "with x as (select doc_id, regexp_extract_all(seq, '[ACGT]+') as r from {raw}) select doc_id, cast(i - 1 as int) as part, r[i] as seq from x, lateral (select unnest(range(1, len(r) + 1)) as i) y")
def _(t):
    return seqs.split_on_ns(t.raw.select("doc_id", "seq"))


@query(
    "sq7_trim_quality",
    f"""with r as ({SHORT}), p as (select *, list_transform(range(1, length(seq) + 1), lambda i: ascii(qual[i]) - 33 > 4 and seq[i] <> 'N') as g from r),
    s as (select read_id, seq, qual, list_position(g, true) as a, len(g) + 1 - list_position(list_reverse(g), true) as b from p where list_contains(g, true))
    select read_id, substring(seq, a, b - a + 1) as seq, substring(qual, a, b - a + 1) as qual from s""",
)
def _(t):
    return seqs.trim_quality(t.sql(SHORT)).select("read_id", "seq", "qual")


SIDES = "select item_id as record, concat('r', item_id) as name, text as seq from {benchmark}"


@query("sq8_pair_reads", f"with s as ({SIDES}) select a.record, a.name as left_name, a.seq as left_seq, b.name as right_name, b.seq as right_seq from s a join s b on a.record = b.record")
def _(t):
    return seqs.pair_reads(t.sql(SIDES), t.sql(SIDES))


SRC = f"select read_id as doc_id, seq from ({SHORT}) q"


@query(
    "sq9_median_coverage_filter",
    f"""with k as ({km(6, SRC)}), c as (select {CAN} as kmer, count(*) as n from k group by 1), h as (select k.doc_id as read_id, coalesce(c.n, 0) as n from k left join c on k.kmer = c.kmer),
    m as (select read_id, list_sort(list(n))[len(list(n)) // 2 + 1] as med from h group by read_id), r as ({SHORT}), g as (select pair, max(coalesce(med, 0)) as m from r left join m on r.read_id = m.read_id group by pair)
    select r.read_id, r.seq from r join g on r.pair = g.pair where g.m >= 5""",
)
def _(t):
    reads = t.sql(SHORT)
    return seqs.median_coverage_filter(reads, kmers.window_counts(reads, 6), 6, 5).select("read_id", "seq")


@query("sq10_read_stats", "select sample, count(*) as n_reads, max(length(seq)) as max_length, cast(sum(length(seq)) as bigint) as total from {raw} group by sample")
def _(t):
    return seqs.read_stats(t.raw, ["sample"])


NAMED = "select concat('d', doc_id) as contig, sample, seq from {contigs}"
RAWNAMED = "select concat('d', doc_id) as contig, sample, seq from {raw}"


@query(
    "sq11_chunk_contigs",
    f"""with c as ({NAMED}) select contig || '_(' || s || '_' || least(s + 500, length(seq)) || ')' as contig, substring(seq, cast(s as int) + 1, cast(least(s + 500, length(seq)) - s as int)) as seq
    from c, lateral (select unnest(range(0, greatest(length(seq), 1), 450)) as s) x where length(seq) >= 1000 and (s = 0 or s + 50 < length(seq))""",
)
def _(t):
    return seqs.chunk_contigs(t.sql(NAMED), 500, 50, 1000)


@query("sq12_prefix_sample", f"with c as ({NAMED}) select sample || '-' || contig as contig, sample, seq from c")
def _(t):
    return seqs.prefix_sample(t.sql(NAMED))


NAMES = "select concat('d', doc_id) as contig from {labels}"


@query("sq12_name_filter", f"with c as ({NAMED}) select * from c where contig not in ({NAMES})")
def _(t):
    return seqs.name_filter(t.sql(NAMED), t.sql(NAMES), retain=False)


@query("sq12_length_filter", f"with c as ({NAMED}) select * from c where length(seq) >= 900")
def _(t):
    return seqs.length_filter(t.sql(NAMED), 900)


def _repeat_sql() -> str:
    """Windows as whole numbers, made from the codes of single bases, and one pass for each k."""
    codes = ["v"]
    for k in range(2, 10):
        codes.append(f"({codes[-1]}) * 4 + v{k - 1}")
    leads = ", ".join(f"lead(v, {j}) over o as v{j}" for j in range(1, 9))
    each = " union all ".join(f"select doc_id, {k} as k, i, i - lag(i) over (partition by doc_id, c{k} order by i) as gap from p where i < n - {k}" for k in range(2, 10))
    return f"""with c as (select doc_id, unnest(string_split(seq, '')) as b, unnest(range(0, length(seq))) as i, length(seq) as n from {{contigs}} where seq <> ''),
    d as (select doc_id, i, n, cast(ascii(b) as bigint) // 2 % 4 as v from c), w as (select *, {leads} from d window o as (partition by doc_id order by i)),
    p as (select doc_id, i, n, {", ".join(f"{codes[k - 1]} as c{k}" for k in range(2, 10))} from w), g as ({each}),
    s as (select doc_id, avg(case when gap is null then 0 else exp(-0.25 / k * (gap - 1)) end) as s from g where i > k group by doc_id)
    select x.doc_id, round(coalesce(s, 0), 9) as repeat_score from {{contigs}} x left join s on x.doc_id = s.doc_id"""


@query("sq13_repeat_score", _repeat_sql())
def _(t):
    return seqs.repeat_score(t.contigs).withColumn("repeat_score", F.round("repeat_score", 9))


@query(
    "sq14_kmer_repeat_profile",
    f"""with k as ({km(9)}), g as (select *, i - lag(i) over (partition by doc_id, kmer order by i) as gap from k), b as (select doc_id, count(*) as n_windows, count(*) filter (gap is null) as n_distinct, count(gap) as n_repeats, cast(median(gap) as double) as median_gap from g group by doc_id),
    m as (select doc_id, gap, row_number() over (partition by doc_id order by count(*) desc, gap) as r from g where gap is not null group by doc_id, gap),
    v as (select k.doc_id, count(*) as n from k where exists (select 1 from k z where z.doc_id = k.doc_id and z.kmer = {RC.format("k.kmer")}) group by k.doc_id)
    select b.*, m.gap as modal_gap, coalesce(v.n, 0) as n_reverse from b left join m on b.doc_id = m.doc_id and m.r = 1 left join v on b.doc_id = v.doc_id""",
)
def _(t):
    return seqs.kmer_repeat_profile(t.contigs, k=9)


@query("sq15_split_scaffolds", f"with c as ({RAWNAMED}), p as (select contig, unnest(regexp_split_to_array(seq, 'N{{{{1,}}}}')) as seq, generate_subscripts(regexp_split_to_array(seq, 'N{{{{1,}}}}'), 1) - 1 as part from c) select contig, part, seq from p where seq <> ''".replace("{{", "{").replace("}}", "}").replace("N{1,}", "N+"))
def _(t):
    return seqs.split_scaffolds(t.sql(RAWNAMED), 1)


@query("sq16_trim_ns", f"with c as ({RAWNAMED}), x as (select contig, sample, regexp_replace(regexp_replace(seq, '^N+', ''), 'N+$', '') as seq from c) select * from x where seq <> ''")
def _(t):
    return seqs.trim_ns(t.sql(RAWNAMED))


@query("sq17_break_by_pattern")
def _(t):
    return seqs.break_by_pattern(t.sql(NAMED), "ACGTA", 150).select("contig", "seq")


HITS = "select concat('d', user_id) as contig, translate(md5(props), '0123456789abcdef', 'ACGTACGTACGTACGT') as seq from {events}"


@query("sq18_pattern_filter", f"with c as ({NAMED}), h as ({HITS}) select c.* from c where contig in (select contig from h where contains(seq, 'ACGTA'))")
def _(t):
    return seqs.pattern_filter(t.sql(NAMED), t.sql(HITS), "ACGTA")


COVER = "select concat('d', user_id) as contig, cast(event_id * 37 % 3000 as bigint) as start, cast(event_id * 37 % 3000 + value * 3 + 100 as bigint) as end from {events}"


@query("sq19_break_by_coverage")
def _(t):
    return seqs.break_by_coverage(t.sql(NAMED), t.sql(COVER))


@query("sq20_postprocess")
def _(t):
    return seqs.postprocess(t.sql(NAMED), t.sql(HITS), t.sql(COVER), "ACGTA", 100, 40)


BASES = "select concat('b', l_orderkey % 200) as contig, cast(l_partkey % 300 + 1 as bigint) as pos, substring('ACGT', cast(l_suppkey % 4 + 1 as int), 1) as base, cast(l_quantity as int) % 40 as phred from {lineitem}"
BCONTIG = "select concat('b', item_id) as contig, regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz .,', 'ACGTACGTACGTACGTACGTACGTACACG'), '[^ACGT]', ''/*g*/) as seq from {benchmark}"


@query(
    "sq21_consensus_quality",
    f"""with c as ({BCONTIG}), p as (select contig, i as pos, substring(seq, cast(i as int), 1) as own from c, lateral (select unnest(range(1, length(seq) + 1)) as i) x), b as ({BASES}),
    m as (select p.contig, p.pos, cast(floor(avg(phred)) as int) as q from p join b on p.contig = b.contig and p.pos = b.pos and own = base group by 1, 2)
    select p.contig, string_agg(chr(coalesce(q, 0) + 33), '' order by p.pos) as quality from p left join m on p.contig = m.contig and p.pos = m.pos group by p.contig""",
)
def _(t):
    return seqs.consensus_quality(t.sql(BCONTIG), t.sql(BASES))


INFO = "select n_name as sample, cast(20 + n_nationkey as double) as coverage from {nation}"
NREADS = "select n.n_name as sample, c.c_custkey as read_id from {customer} c join {nation} n on c.c_nationkey = n.n_nationkey"


@query(
    "sq22_subsample_to_coverage",
    f"with i as ({INFO}), r as ({NREADS}), s as (select least(1, 100 / sum(coverage)) as share from i) select r.* from r, s where sample in (select sample from i) and cast(('0x' || substring(md5('0|' || read_id), 1, 8)) as bigint) / 4294967296.0 < share",
)
def _(t):
    return seqs.subsample_to_coverage(t.sql(NREADS), t.sql(INFO))


TWO = "select event_id as pair, translate(substring(md5(cast(event_id as varchar(20))), 1, 12), '0123456789abcdef', 'ACGTACGTACGTACGT') as left, translate(substring(md5(cast(event_id + 1 as varchar(20))), 1, 12), '0123456789abcdef', 'ACGTACGTACGTACGT') as right from {events}"
TWOQ = TWO.replace("as left", 'as "left"').replace("as right", 'as "right"')


@query("sq23_hamming", f"with p as ({TWOQ}) select pair, hamming(\"left\", \"right\") as d, round(1 - hamming(\"left\", \"right\") / 12, 9) as score from p")
def _(t):
    return t.sql(TWO).select("pair", hamming("left", "right").alias("d"), F.round(seqs.overlap_score("left", "right"), 9).alias("score"))


FAR = f"select *, 20 - event_id % 80 as dist from ({TWO.replace('select event_id as pair', 'select event_id, event_id as pair')}) q"
FARQ = f"select *, 20 - event_id % 80 as dist from ({TWOQ.replace('select event_id as pair', 'select event_id, event_id as pair')}) q"


@query(
    "sq24_best_overlap",
    f"""with p as ({FARQ}), b as (select *, greatest(1, cast(round(0.05e0 * greatest(-dist, 0)) as int)) as a, least(12, 6 + greatest(-dist, 0)) as z from p),
    o as (select pair, l, 1 - hamming(right("left", cast(l as int)), left("right", cast(l as int))) / l as score from b, lateral (select unnest(range(a, z + 1)) as l) x),
    r as (select *, row_number() over (partition by pair order by l >= 3 desc, score desc, l desc) as nth from o where score > 0.5) select pair, cast(l as int) as overlap, round(score, 9) as score from r where nth = 1""",
)
def _(t):
    return seqs.best_overlap(t.sql(FAR), 6, 0.5, 3).withColumn("score", F.round("score", 9))


@query("sq25_edit_distance", f"with p as ({TWOQ}) select pair, levenshtein(\"left\", \"right\") as d from p")
def _(t):
    return t.sql(TWO).select("pair", F.levenshtein("left", "right").alias("d"))


@query("sq26_homopolymer_runs", "with r as (select unnest(regexp_extract_all(seq, '(A+|C+|G+|T+)', 1)) as r from {contigs}) select r[1] as nucl, length(r) as len, count(*) as n from r group by 1, 2")
def _(t):
    return seqs.run_lengths(t.contigs)


FILES = "select concat('/d/', translate(c_name, '#', 'x'), '_L00', c_nationkey % 9 + 1, '_R', c_custkey % 2 + 1, '.fastq') as path from {customer} union all select concat('/d/', translate(c_name, '#', 'x'), '_L00', c_nationkey % 9 + 1, '_R', case when c_custkey % 3 = 0 then c_custkey % 2 + 1 else (c_custkey + 1) % 2 + 1 end, '.fastq') from {customer}"


@query(
    "sq27_group_read_files",
    f"""with f as ({FILES}), b as (select regexp_extract(path, '([^/]+)$', 1) as base from f), k as (select regexp_replace(regexp_replace(base, '_R[12]', ''), '_L00[1-9]', '') as barcode, regexp_extract(base, '_R([12])', 1) as mate from b)
    select barcode, count(*) as n_files, count(distinct mate) as n_mates from k group by barcode having count(distinct mate) = 2""",
)
def _(t):
    return seqs.group_read_files(t.sql(FILES))


PARTS = "select user_id as path, event_id as ord, translate(substring(md5(cast(event_id as varchar(20))), 1, 12), '0123456789abcdef', 'ACGTACGTACGTACGT') as seq from {events}"


@query("sq28_merge_overlapping", f"with p as ({PARTS}), n as (select *, row_number() over (partition by path order by ord) as i from p) select path, string_agg(case when i = 1 then seq else substring(seq, 5) end, '' order by ord) as seq from n group by path")
def _(t):
    return seqs.merge_overlapping(t.sql(PARTS), 4)


BEFORE = "select event_id as id, user_id as ref_start, user_id + 100 as ref_end, event_id % 7 as distance from {events}"
AFTER = "select event_id as id, user_id + event_id % 20 as ref_start, user_id + 100 + event_id % 11 as ref_end, event_id % 5 as distance from {events}"


@query(
    "sq29_correction_report",
    f"""with a as ({BEFORE}), b as ({AFTER}), x as (select a.distance as d0, b.distance as d1 from a join b on a.id = b.id where abs(a.ref_start - b.ref_start) < 15 and abs(a.ref_end - b.ref_end) < 15)
    select count(*) as comparable, count(*) filter (d1 < d0) as improved, count(*) filter (d1 > d0) as corrupted, count(*) filter (d1 = 0 and d0 > 0) as fixed, avg(d0) as mean_before, avg(d1) as mean_after, sum(d0 - d1) / sum(d0) as gain from x""",
)
def _(t):
    return seqs.correction_report(t.sql(BEFORE), t.sql(AFTER))


LABELLED = "select concat('/out/plasmid_', p_size, '.fasta') as path, concat('NODE_', p_partkey) as contig, p_name as seq from {part}"


@query("sq30_collect_labelled", f"with l as ({LABELLED}) select contig || '_cutoff_' || regexp_extract(path, '_([0-9]+)[.]', 1) || '_type_plasmid' as contig, seq from l")
def _(t):
    return seqs.collect_labelled(t.sql(LABELLED))


@query("km1_kmers", f"with k as ({km(11)}) select doc_id, kmer, count(*) as n from k group by 1, 2")
def _(t):
    return kmers.kmers_of_each(t.contigs, 11, "doc_id")


@query(
    "km2_valid_kmers",
    f"""with r as ({SHORT}), p as (select *, list_transform(range(1, length(seq) + 1), lambda i: ascii(qual[i]) - 33) as q from r), g as (select *, list_transform(q, lambda x: x > 2) as g from p),
    b as (select *, list_position(g, true) as a, len(g) + 1 - list_position(list_reverse(g), true) as z from g), w as (select *, i as "at", substring(seq, cast(i as int), 8) as kmer from b, lateral (select unnest(range(1, length(seq) - 6)) as i) x)
    select read_id, "at", kmer, round(list_product(list_transform(q["at":"at" + 7], lambda x: 1 - power(10, -x / 10))), 9) as correct from w where "at" >= a and "at" + 7 <= z and not contains(kmer, 'N')""",
)
def _(t):
    return kmers.valid_kmers(t.sql(SHORT), 8).select("read_id", "at", "kmer", F.round("correct", 9).alias("correct"))


@query("km3_kmer_set", f"with k as ({km(11)}) select kmer from k union select {RC.format('kmer')} from k")
def _(t):
    return kmers.kmer_set(t.contigs, 11, spread=True)


COUNTS = f"select {CAN} as kmer, count(*) as n from k group by 1"


@query("km4_kmer_counts", f"with k as ({km(11)}) {COUNTS}")
def _(t):
    return kmers.kmer_counts(t.contigs, 11, spread=True)


@query("km5_kmer_cardinality")
def _(t):
    return kmers.sketch_cardinality(kmers.kmer_sketches(t.contigs, 11, ("sample",)))


@query("km5_sketch_error", f"with k as ({km(11)}), c as (select distinct {CAN} as kmer from k) select count(*) as n, true as near from c")
def _(t):
    """The exact count, and whether sketches of each library, united, are within four standard errors of it."""
    seen = saved(kmers.kmer_counts(t.contigs, 11, ("sample",), packed=True).select("sample", "kmer"), "kmers")  # the windows are made once
    united = kmers.sketch_cardinality(kmers.sketches_of(seen, ("sample",)))
    exact = seen.select("kmer").distinct().agg(F.count("*").alias("n"))
    return exact.join(F.broadcast(united)).select("n", (F.abs(F.col("estimate") - F.col("n")) <= 4 * 0.0082 * F.col("n")).alias("near"))


@query("km6_kmer_counts_capped", f"with k as ({km(11)}), c as ({COUNTS}) select kmer, least(n, 4) as n from c")
def _(t):
    return kmers.kmer_counts_capped(t.contigs, 11, 4)


@query("km7_coverage_histogram", f"with k as ({km(11)}), c as ({COUNTS}) select n, count(*) as n_kmers from c group by n")
def _(t):
    return kmers.coverage_histogram(kmers.kmer_counts(t.contigs, 11, packed=True))


@query(
    "km8_kmer_quality_stats",
    f"""with r as ({SHORT}), p as (select *, list_transform(range(1, length(seq) + 1), lambda i: ascii(qual[i]) - 33) as q from r), g as (select *, list_transform(q, lambda x: x > 2) as g from p),
    b as (select *, list_position(g, true) as a, len(g) + 1 - list_position(list_reverse(g), true) as z from g), w as (select *, i as "at", substring(seq, cast(i as int), 8) as kmer from b, lateral (select unnest(range(1, length(seq) - 6)) as i) x),
    v as (select kmer, q["at":"at" + 7] as quals from w where "at" >= a and "at" + 7 <= z and not contains(kmer, 'N')), t as (select kmer, count(*) as n, round(exp(sum(ln(greatest(1 - list_product(list_transform(quals, lambda x: 1 - power(10, -x / 10))), 1e-300)))), 9) as total_qual from v group by kmer),
    s as (select kmer, i, least(sum(quals[i]), 63) as q from v, lateral (select unnest(range(1, 9)) as i) x group by kmer, i), j as (select kmer, string_agg(cast(q as varchar), ',' order by i) as quals from s group by kmer) select t.*, quals from t join j on t.kmer = j.kmer""",
)
def _(t):
    out = kmers.kmer_quality_stats(kmers.valid_kmers(t.sql(SHORT), 8)).withColumn("total_qual", F.round("total_qual", 9))
    return out.withColumn("quals", F.array_join(F.transform("quals", lambda q: q.cast("string")), ","))


@query("km9_hamming_clusters")
def _(t):
    return kmers.hamming_clusters(kmers.kmer_counts(t.sql(SHORT), 24, packed=True), 2, 24).select(unpack("kmer", 24).alias("kmer"), unpack("component", 24).alias("component"))


@query("km10_hamming1_clusters")
def _(t):
    return kmers.hamming1_clusters(kmers.kmer_counts(t.sql(SHORT), 12, packed=True), 12).select(unpack("kmer", 12).alias("kmer"), unpack("component", 12).alias("component"))


CENTRES = "select concat('S', user_id) as component, concat(event_type, event_id) as kmer, event_id % 9 as n, value / 500 as quality from {events}"


@query(
    "km11_cluster_centre",
    f"with c as ({CENTRES}), r as (select *, count(*) over (partition by component) as size, row_number() over (partition by component order by n desc, kmer desc, quality desc) as nth from c) select component, kmer as centre, size, quality > (case when size = 1 then 0.995 else 0.9 end) as good from r where nth = 1",
)
def _(t):
    c = t.sql(CENTRES)
    return kmers.cluster_centre(c.select("component", "kmer"), c.select("kmer", "n", "quality"))


@query("km12_expand_solid")
def _(t):
    reads = t.sql(SHORT)
    return kmers.expand_solid(reads, kmers.kmers(reads, 7).groupBy("kmer").agg(F.count("*").alias("n")).where("n > 2"), 7)


BYSAMPLE = "select sample as doc_id, seq from {contigs}"


@query(
    "km13_multi_sample_counts",
    f"with k as ({km(9, BYSAMPLE)}), c as (select {CAN} as kmer, doc_id as sample, count(*) as n from k group by 1, 2), f as (select kmer from c group by kmer having count(distinct sample) >= 1 and (count(distinct sample) > 1 or sum(n) > 5)) select c.* from c join f on c.kmer = f.kmer",
)
def _(t):
    held = kmers.multi_sample_counts(kmers.kmer_counts(t.contigs, 9, ("sample",), packed=True), 1, 5)
    return held.withColumn("kmer", unpack("kmer", 9))


NATIONS = "select concat('b', item_id) as contig, 'b' as sample, regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz .,', 'ACGTACGTACGTACGTACGTACGTACACG'), '[^ACGT]', ''/*g*/) as seq from {benchmark}"
PROFILE = f"p as (select {CAN} as kmer, doc_id as sample, count(*) as n from ({km(7, BYSAMPLE)}) k group by 1, 2)"
KNOWN = f"{PROFILE}, r as (select doc_id as contig, {CAN} as kmer from ({km(7, 'select contig as doc_id, seq from (' + NATIONS + ') u')}) k), kn as (select * from r where kmer in (select kmer from p)), g as (select kn.contig, s.sample, coalesce(p.n, 0) as v from kn cross join (select distinct sample from p) s left join p on kn.kmer = p.kmer and s.sample = p.sample)"


@query(
    "km14_contig_abundance",
    f"""with {KNOWN}, o as (select *, row_number() over (partition by contig, sample order by v) - 1 as i, count(*) over (partition by contig, sample) as n from g),
    e as (select contig, sample, min(v) filter (i >= least(cast(ceil(n * 0.05) as bigint), n - 1)) as lo, min(v) filter (i >= greatest(n - 1 - cast(ceil(n * 0.05) as bigint), 0)) as hi from o group by 1, 2),
    c as (select o.contig, o.sample, least(greatest(v, lo), hi) as c from o join e on o.contig = e.contig and o.sample = e.sample), sh as (select r.contig, count(*) as a, count(*) filter (kmer in (select kmer from p)) as b from r group by 1)
    select c.contig, sample, case when any_value(b) >= 0.5 * any_value(a) then round(avg(c), 6) end as abundance from c join sh on c.contig = sh.contig group by 1, 2""",
)
def _(t):
    return kmers.contig_abundance(t.sql(NATIONS), kmers.kmer_counts(t.contigs, 7, ("sample",), packed=True), 7, 0, 0.5).select("contig", "sample", F.round("abundance", 6).alias("abundance"))


@query(
    "km15_contig_abundance_median",
    f"with {KNOWN}, m as (select contig, sample, list_sort(list(v))[len(list(v)) // 2 + 1] as median from g group by 1, 2), d as (select g.contig, g.sample, m.median, abs(v - median) as d from g join m on g.contig = m.contig and g.sample = m.sample) select contig, sample, median, list_sort(list(d))[len(list(d)) // 2 + 1] as mad from d group by 1, 2, 3",
)
def _(t):
    return kmers.contig_abundance_median(t.sql(NATIONS), kmers.kmer_counts(t.contigs, 7, ("sample",), packed=True), 7)


@query(
    "km16_two_class_threshold",
    """with p as (select user_id, value as split, count(*) as w, sum(value) as s from {events} group by 1, 2), h as (select user_id, split, sum(w) over u as lw, sum(s) over u as ls, sum(w) over (partition by user_id) as tw, sum(s) over (partition by user_id) as ts from p window u as (partition by user_id order by split)),
    g as (select user_id, split, (case when lw > 3 then ls * ls * (1 + 2 * ln(lw + 1)) / lw else 0 end) + (case when tw - lw > 3 then (ts - ls) * (ts - ls) * (1 + 2 * ln(tw - lw + 1)) / (tw - lw) else 0 end) as score from h), r as (select *, row_number() over (partition by user_id order by score desc, split desc) as nth from g)
    select user_id, split from r where nth = 1""",
)
def _(t):
    return kmers.two_class_threshold(t.events, "user_id", "value").select("user_id", "split")


CLASSED = "select event_type as class, concat('k', user_id) as kmer, value as quality from {events}"
KREF = "select concat('k', c_custkey * 3) as kmer from {customer}"


@query(
    "km17_cluster_quality",
    f"""with c as ({CLASSED}), r as ({KREF}) select class, count(*) as n, round(avg(case when kmer in (select kmer from r) then 1 else 0 end), 9) as share, round(avg(quality), 6) as mean, median(quality) as median, round(var_pop(quality), 6) as variance,
    round(quantile_cont(quality, 0.001), 6) as q0_1, round(quantile_cont(quality, 0.01), 6) as q1, round(quantile_cont(quality, 0.99), 6) as q99, round(quantile_cont(quality, 0.999), 6) as q99_9 from c group by class""",
)
def _(t):
    out = kmers.cluster_quality(t.sql(CLASSED), t.sql(KREF)).withColumn("share", F.round("share", 9))
    return out.select("class", "n", "share", "median", *(F.round(c, 6).alias(c) for c in ("mean", "variance", "q0_1", "q1", "q99", "q99_9")))


