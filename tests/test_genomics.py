"""Operators that SQL can't restate, on literals and against plain Python; and properties of the rest."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import seq
from strandloom.operators import aln, chains, cn, contigs, correct, graph, intervals, kmers, seqs, sv
from strandloom.plans import registry
from strandloom.plans.tables import components
from strandloom.sources import readers, writers


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_revcomp_is_its_own_inverse(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ACGT") for _ in range(rng.randint(0, 40))) for _ in range(50)]
    df = spark.createDataFrame([(t,) for t in texts], "seq string").select("seq", seq.revcomp(seq.revcomp("seq")).alias("twice"))
    assert all(r.seq == r.twice for r in df.collect())


def test_components_whatever_the_order_of_edges(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)]
    parent = list(range(121))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    nodes = {x for e in edges for x in e}
    want = sorted((n, root(n)) for n in nodes)
    for shuffled in (edges, edges[::-1]):
        found = components(spark.createDataFrame(shuffled, "a long, b long"))
        assert rows(found, "node", "component") == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pointer_doubling_on_chains_and_cycles(spark):
    steps = [(1, 2), (2, 3), (3, 4), (10, 11), (20, 21), (21, 22), (22, 20)]
    held = graph.condense(spark.createDataFrame(steps, "a long, b long"))
    assert rows(held, "node", "head", "rank") == [(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 1, 3), (10, 10, 0), (11, 10, 1), (20, 20, 0), (21, 20, 1), (22, 20, 2)]


def test_unitigs_spell_an_unbranched_sequence(spark):
    text = "ACGTTGCAAGGCTTACCGATAGGCA"
    found = {r.seq for r in graph.unitigs(graph.extensions(spark.createDataFrame([(text,)], "seq string"), 9), 9).collect()}
    turned = text[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert text in found and turned in found


def test_merging_is_idempotent_and_joins_overlap(spark):
    rng = random.Random(3)
    iv = [("s", "c", a, a + rng.randint(1, 30)) for a in (rng.randint(0, 600) for _ in range(80))]
    df = spark.createDataFrame(iv, "sample string, contig string, start long, end long")
    once = intervals.merge_intervals(df, ["sample", "contig"])
    assert rows(intervals.merge_intervals(once, ["sample", "contig"]), "start", "end") == rows(once, "start", "end")
    other = spark.createDataFrame([("s", "c", a, a + 7) for a in range(0, 600, 41)], "sample string, contig string, r_start long, r_end long")
    got = rows(intervals.overlap_join(df, other, ["sample", "contig"], 16), "start", "end", "r_start")
    assert got == sorted((a, b, c) for _, _, a, b in iv for c in range(0, 600, 41) if a < c + 7 and c < b)
    hit = rows(intervals.overlap_join(df, other, ["sample", "contig"], 16, "left_semi"), "start", "end")
    assert hit == sorted((a, b) for _, _, a, b in iv if any(a < c + 7 and c < b for c in range(0, 600, 41)))


def test_semi_and_anti_overlap_joins_tell_rows_by_all_values(spark):
    left = spark.createDataFrame([("c", 0, 5, None), ("c", 0, 5, None), ("c", 0, 40, "x"), ("c", 20, 25, "y"), (None, 0, 5, "z")], "contig string, start long, end long, tag string")
    right = spark.createDataFrame([("c", 3, 9), ("c", 4, 18)], "contig string, r_start long, r_end long")
    hit = intervals.overlap_join(left, right, ["contig"], 8, "left_semi").collect()
    missed = intervals.overlap_join(left, right, ["contig"], 8, "left_anti").collect()
    assert sorted((r.end, r.tag or "") for r in hit) == [(5, ""), (5, ""), (40, "x")]
    assert sorted((r.end, r.tag) for r in missed) == [(5, "z"), (25, "y")]


def test_reads_of_two_files_pair_or_fail(spark):
    left = spark.createDataFrame([(0, "a", "AC"), (1, "b", "GT")], "record long, name string, seq string")
    right = spark.createDataFrame([(0, "a", "TT")], "record long, name string, seq string")
    assert rows(seqs.pair_reads(left, left), "record", "left_name", "right_seq") == [(0, "a", "AC"), (1, "b", "GT")]
    for a, b in ((left, right), (right, left)):
        with pytest.raises(Exception, match="differ at record 1"):
            seqs.pair_reads(a, b).collect()


def test_interleaved_pairs_stay_together_in_parallel_files(spark, tmp_path):
    reads = [(i // 2, i % 2, f"r{i}", "ACGT", "IIII") for i in range(60)]
    df = spark.createDataFrame(reads, "pair long, mate long, name string, seq string, qual string").repartition(5)
    with_conf = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        writers.write_interleaved(df, f"file://{tmp_path}/fq")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", with_conf)
    back = readers.interleaved(readers.read_fastq(spark, f"file://{tmp_path}/fq")).collect()
    assert len({r["sample"] for r in back}) > 1
    by_pair = {}
    for r in back:
        by_pair.setdefault((r["sample"], r["pair"]), {})[r["mate"]] = int(r["name"][1:])
    assert sorted((v[1], v[2]) for v in by_pair.values()) == [(i, i + 1) for i in range(0, 60, 2)]


def test_depth_sums_to_the_aligned_bases(spark):
    data = [("s", f"r{i}", 0, "c", 1 + i * 3, 60, "5S10M2D5M", "=", 0, 0) for i in range(20)]
    df = spark.createDataFrame(data, "sample string, qname string, flag int, contig string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long")
    assert aln.depth(df).agg(F.sum("depth")).first()[0] == 20 * 15
    assert {r.ref_span for r in aln.with_ref_span(df).collect()} == {17}


def test_expand_regions_follows_mates_once(spark):
    data = [("s", f"r{i}", 1, "c", 100 + i, 60, "50M", "=", 5000 + i, 0) for i in range(3)] + [("s", f"q{i}", 1, "c", 5000 + i, 60, "50M", "=", 9000 + i, 0) for i in range(3)]
    df = spark.createDataFrame(data, "sample string, qname string, flag int, contig string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long")
    start = spark.createDataFrame([("s", "c", 90, 200)], "sample string, contig string, start long, end long")
    assert [r[0] for r in rows(aln.expand_regions(df, start, 100, 3), "depth")] == [0, 1, 2]


def test_segments_find_the_step(spark):
    y = [1.0] * 20 + [9.0] * 15
    assert cn.best_segments(np.array(y), 5.0, 3).tolist() == [0, 20]
    df = spark.createDataFrame([("s", "1", "p", i, v) for i, v in enumerate(y)], "sample string, chrom string, arm string, bin long, coverage double")
    segs = cn.segment_rows(cn.pcf_segments(df, 5.0, 3))
    assert rows(segs, "start", "end", "n_probes", "mean") == [(0, 19, 20, 1.0), (20, 34, 15, 9.0)]


def test_haar_keeps_a_constant_and_odd_lengths(spark):
    df = spark.createDataFrame([("s", i, 4.0) for i in range(11)], "sample string, bin long, coverage double")
    out = rows(cn.haar_denoise(df, ["sample"]), "bin", "denoised")
    assert len(out) == 11 and all(abs(v - 4) < 1e-9 for _, v in out)


def test_best_path_prefers_the_longer_chain():
    segments = [("c1", 0, 54, 41.0), ("c1", 10, 1381, 1337.0), ("c2", 90, 1381, 1116.0), ("c3", 91, 1381, 1127.0), ("c4", 915, 1381, 399.0)]
    path, score = contigs.best_path(segments, 1381)
    assert path == [1] and score == 1337 - 20
    jump, _ = contigs.best_path([("a", 0, 100, 100.0), ("b", 110, 200, 90.0)], 200)
    assert jump == [0, 1]


def test_site_filter_codes(spark):
    schema = "chrom string, pos long, is_indel boolean, dlen int, quality int, mapq int, depth int, support int"
    sites = [("1", 10, False, 0, 50, 60, 1, 0), ("1", 100, False, 0, 50, 60, 500, 0), ("1", 300, False, 0, 50, 10, 20, 0), ("1", 400, False, 0, 50, 60, 20, 0), ("1", 403, False, 0, 50, 60, 20, 0), ("1", 406, False, 0, 50, 60, 20, 0), ("1", 600, False, 0, 50, 60, 20, 0), ("1", 605, True, 0, 50, 60, 20, 1), ("1", 615, True, 0, 20, 60, 20, 0)]
    out = dict(rows(sv.site_filter(spark.createDataFrame(sites, schema)), "pos", "code"))
    assert [out[p] for p in (10, 100, 300, 400, 403, 406, 600, 605, 615)] == ["d", "D", "Q", "W", "W", "W", "g", "U", "G"]


def codes_by_definition(sites):
    """site_filter() restated over all pairs of sites of one chromosome."""
    code = {x["pos"]: "d" if x["depth"] < 3 else "D" for x in sites if not 3 <= x["depth"] <= 100}
    live = [dict(x, score=x["quality"] + 100 * x["support"], end=x["pos"] + x["dlen"] * x["is_indel"]) for x in sites if x["pos"] not in code]
    gaps, snps = [x for x in live if x["is_indel"]], [x for x in live if not x["is_indel"]]
    mapped = {x["pos"]: x["mapq"] >= (10 if x["is_indel"] else 25) for x in live}
    for x in gaps:
        rivals = [(y, y["pos"] < x["pos"]) for y in gaps if y is not x and max(x["pos"], y["pos"]) - min(x, y, key=lambda z: z["pos"])["end"] <= 30]
        lost = any(y["score"] >= x["score"] if earlier else y["score"] > x["score"] for y, earlier in rivals)
        code[x["pos"]] = "G" if lost else "U" if mapped[x["pos"]] else "Q"
    after_gap = {x["pos"]: any(0 < x["pos"] - g["pos"] and x["pos"] - g["end"] <= 10 and g["score"] >= 25 for g in gaps) for x in snps}
    crowded: set = set()
    while True:
        counts = {p for p in after_gap if mapped[p] or after_gap[p] or p in crowded}
        found = {p for p in after_gap if sum(q in counts for q in range(p - 10, p)) + 1 > 2}
        if found == crowded:
            break
        crowded = found
    for x in snps:
        p = x["pos"]
        first = min([(q, "W") for q in crowded if 0 < q - p <= 10] + [(g["pos"], "g") for g in gaps if 0 < g["pos"] - p <= 10 and g["quality"] >= 25], default=(0, "U"))[1]
        code[p] = "W" if p in crowded else "g" if after_gap[p] else first if mapped[p] else "Q"
    return code


def test_site_filter_on_crowded_sites(spark):
    rng = random.Random(19)
    made, want = [], {}
    for sample in ("a", "b"):
        for chrom in ("1", "2"):
            sites = [{"sample": sample, "chrom": chrom, "pos": p, "is_indel": rng.random() < 0.25, "dlen": rng.choice([0, 0, 4]), "quality": rng.randint(5, 60), "mapq": rng.choice([5, 20, 40, 60]), "depth": rng.choice([1, 20, 30, 40, 200]), "support": rng.randint(0, 2)} for p in rng.sample(range(3000), 420)]
            made += sites
            want |= {(sample, chrom, p): c for p, c in codes_by_definition(sites).items()}
    df = spark.createDataFrame([tuple(x.values()) for x in made], "sample string, chrom string, pos long, is_indel boolean, dlen int, quality int, mapq int, depth int, support int")
    out = {(r.sample, r.chrom, r.pos): r.code for r in sv.site_filter(df).collect()}
    assert out == want and set(want.values()) == set("UdDQWGg")
    coded = sv.site_filter(df.withColumn("is_ref", F.lit(False)), min_snp_quality=20, min_indel_quality=30)
    assert {r.code for r in coded.collect()} == set("UdDQWGgsi")
    ref = sv.site_filter(df.withColumn("is_indel", F.lit(False)).withColumn("is_ref", F.lit(True)), min_ref_quality=20)
    assert {r.code for r in ref.collect()} == set("UdDQC")


def test_nearby_breaks_cluster_alike_by_pairs_and_by_sessions(spark):
    rng = random.Random(4)
    breaks = spark.createDataFrame([(i, "s", "1", rng.randint(0, 40000)) for i in range(60)], "sv_id long, sample string, chrom string, pos long")
    lengths = spark.createDataFrame([("1", 40000)], "chrom string, length long")
    p = chains.break_frequency(breaks, lengths)
    clusters = rows(chains.local_clusters(breaks, p, 0.3), "pos", "cluster")
    edges = chains.neighbour_edges(breaks, p, 0.3).select(F.col("pos1").alias("a"), F.col("pos2").alias("b"))
    label = {r.node: r.component for r in components(edges).collect()}
    groups = {}
    for pos, c in clusters:
        groups.setdefault(c, []).append(pos)
    assert all({label.get(x, x) for x in g} == {g[0]} for g in groups.values())


def test_kmer_clusters(spark):
    found = dict(rows(kmers.hamming_clusters(spark.createDataFrame([("AAAAAA",), ("AAAAAT",), ("AAATTT",), ("CCCCCC",)], "kmer string"), 1, 6), "kmer", "component"))
    assert found == {"AAAAAA": "AAAAAA", "AAAAAT": "AAAAAA", "AAATTT": "AAATTT", "CCCCCC": "CCCCCC"}
    one = dict(rows(kmers.hamming1_clusters(spark.createDataFrame([("ACG",), ("ACT",), ("TTT",)], "kmer string"), 3), "kmer", "component"))
    assert one == {"ACG": "ACG", "ACT": "ACG", "TTT": "TTT"}
    reads = spark.createDataFrame([(1, "ACGTAC"), (2, "GTACCC")], "read_id long, seq string")
    solid = kmers.expand_solid(reads, spark.createDataFrame([("ACG",), ("TAC",)], "kmer string"), 3)
    assert rows(solid, "kmer") == [("ACG",), ("CGT",), ("GTA",), ("TAC",)]
    n = kmers.kmer_cardinality(reads, 3).first().estimate
    assert abs(n - kmers.kmer_counts(reads, 3).count()) <= 1


def test_consensus_substitutes_deletes_and_inserts(spark):
    ref = spark.createDataFrame([("c", "ACGTACGT")], "contig string, seq string")
    votes = [("c", 2, "T", None, 9), ("c", 2, "C", None, 2), ("c", 4, "D", None, 5), ("c", 6, "C", None, 4), ("c", 6, "I", "GG", 4), ("c", 7, "A", None, 3), ("c", 7, "G", None, 3)]
    table = spark.createDataFrame(votes, "contig string, pos long, variant string, inserted string, votes long")
    fixed = correct.corrected_contigs(ref, correct.consensus(table, ref)).first()
    assert fixed.seq == "ATGACGGGT" and fixed.n_changes == 3


def test_reads_that_disagree_lose_their_say(spark):
    contig = spark.createDataFrame([("c", "A" * 60)], "contig string, seq string")
    votes = [("c", f"bad{r}", p, "T" if p > 10 else "C") for r in range(3) for p in (5, 20, 30, 40)] + [("c", f"good{r}", p, "A") for r in range(4) for p in (5, 20, 30, 40)]
    bases = spark.createDataFrame([(*v, None) for v in votes], "contig string, qname string, pos long, variant string, inserted string")
    places = spark.createDataFrame([("c", p) for p in (5, 20, 30, 40)], "contig string, pos long")
    out = correct.read_weighted_consensus(bases, places, contig)
    assert {r.variant for r in out.collect()} == {"A"}


def test_breaking_contigs(spark):
    one = spark.createDataFrame([("a", "A" * 30 + "CCGGT" + "A" * 400)], "contig string, seq string")
    assert len(seqs.break_by_pattern(one, "CCGGT", 100).first().seq) == 400
    spans = spark.createDataFrame([("a", 0, 250)], "contig string, start long, end long")
    pieces = rows(seqs.break_by_coverage(one, spans, k=20, min0=50), "begin")
    assert pieces == [(0,)]


def test_text_formats_round_trip(spark, tmp_path):
    reads = [(f"r{i}", "ACGT" * (i + 1), "@III" * (i + 1)) for i in range(50)]
    writers.write_fastq(spark.createDataFrame(reads, "name string, seq string, qual string").repartition(3), f"file://{tmp_path}/fq")
    assert rows(readers.read_fastq(spark, f"file://{tmp_path}/fq"), "name", "seq", "qual") == sorted(reads)
    spark.createDataFrame([("@r1\nACGT\n+\nII",)], "value string").coalesce(1).write.text(f"file://{tmp_path}/bad")
    with pytest.raises(Exception, match="four-line"):
        readers.read_fastq(spark, f"file://{tmp_path}/bad").collect()
    with pytest.raises(ValueError):
        readers.interleaved(spark.createDataFrame([("s", 0), ("s", 1), ("s", 2)], "sample string, record long"))


def test_every_query_is_registered_once_and_oracles_have_queries():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert "{" not in registry.with_adapters("select * from {coverage}")


def test_entry_returns_clusters():
    import __spark_entry__

    assert callable(__spark_entry__.entry)


def test_smoothing_solves_for_every_cell(spark):
    cells = [(g, m, float(g * m % 7)) for g in range(4) for m in range(5)]
    out = {(r.gc, r.map): r.smoothed for r in cn.smooth_matrix(spark.createDataFrame(cells, "gc int, map int, value double"), 0.0).collect()}
    assert all(abs(out[g, m] - v) < 1e-6 for g, m, v in cells)  # without smoothing the surface runs through its cells
    flat = cn.smooth_matrix(spark.createDataFrame(cells, "gc int, map int, value double"), 500.0).agg(F.max("smoothed") - F.min("smoothed")).first()[0]
    assert flat < 6  # the values span 6


def test_read_to_contig_coverage_by_hand(spark):
    rng = random.Random(5)
    contig = "".join(rng.choice("ACGT") for _ in range(300))
    turned = contig[50:130][::-1].translate(str.maketrans("ACGT", "TGCA"))
    reads = [(1, contig[0:80]), (2, contig[40:120][:40] + "A" + contig[81:120]), (3, turned), (4, "".join(rng.choice("ACGT") for _ in range(80)))]
    out = contigs.read_to_contig_coverage(spark.createDataFrame(reads, "read_id long, seq string"), spark.createDataFrame([("c", contig), ("d", "ACGT" * 20)], "contig string, seq string"), 21, 70)
    assert rows(out, "contig", "uncovered", "coverage") == [("c", 170, (80 + 80 + 80) / 300), ("d", 80, 0.0)]


def test_contig_mapping_table_by_hand(spark):
    schema = "sample string, qname string, flag int, contig string, pos long, mapq int, cigar string, score long"
    data = [("s", "q", 16, "c1", 101, 60, "40M60S", 90), ("s", "q", 2048, "c2", 501, 30, "55S45M", 40), ("s", "p", 0, "c1", 901, 60, "100M", 99)]
    breaks = spark.createDataFrame([("s", "c1", 130)], "sample string, chrom string, pos long")
    out = rows(contigs.contig_mapping_table(spark.createDataFrame(data, schema), breaks, 20), "qname", "chrom", "rstart", "rend", "n_alignments", "qstart", "qend", "strand", "qlen", "short_anchor", "vcf")
    assert out == [("p", "c1", 900, 1000, 1, 0, 100, "+", 100, False, False), ("q", "c1", 100, 140, 2, 0, 40, "-", 100, True, True), ("q", "c2", 500, 545, 2, 0, 45, "+", 100, True, False)]


def test_common_sites_remove_contigs_of_several_samples(spark):
    data = [("a", "q1", "c", 10, 1000), ("b", "q2", "c", 12, 5000), ("b", "q3", "c", 5003, 9000), ("b", "q4", "c", 20000, 30000), ("a", "q5", "d", 10, 400)]
    out = contigs.remove_common_sites(spark.createDataFrame(data, "sample string, qname string, chrom string, rstart long, rend long"), 100)
    assert rows(out, "qname") == [("q4",), ("q5",)]  # q3 shares a site with q2, which shares one with q1 of another sample


def test_early_tips_go_and_long_ends_stay(spark):
    main = "ACGTTGCAAGGCTTACCGATAGGCATTCA"
    spelled = main[3:12] + "AAA"
    reads = spark.createDataFrame([(main,), (spelled,)], "seq string")
    k = 7
    ext = graph.extensions(reads, k)
    left = {r.kmer for r in graph.early_tip_clip(ext, k, 4).select("kmer").collect()}
    all_kmers = {r.kmer for r in ext.select("kmer").collect()}
    dead = {spelled[i : i + k] for i in range(len(spelled) - k + 1)} - {main[i : i + k] for i in range(len(main) - k + 1)}
    assert dead and dead & left == set() and {main[i : i + k] for i in range(len(main) - k + 1)} <= left <= all_kmers
    assert graph.early_tip_clip(ext, k, 0).count() == len(all_kmers)


def graph_of(spark):
    edges = [(1, 1, 2, 50, 500.0), (2, 2, 3, 10, 90.0), (3, 3, 4, 5, 50.0), (4, 2, 9, 3, 6.0), (10, 20, 21, 70, 70.0), (11, 21, 20, 1, 9.0), (20, 30, 30, 8, 8.0)]
    return spark.createDataFrame(edges, "edge long, src long, dst long, len long, raw_cov double")


def test_components_are_numbered_by_length_and_filtered(spark):
    edges = graph_of(spark)
    found = graph.graph_components(edges)
    assert rows(found, "edge", "component", "n_edges", "total") == [(1, 2, 4, 68), (2, 2, 4, 68), (3, 2, 4, 68), (4, 2, 4, 68), (10, 1, 2, 71), (11, 1, 2, 71), (20, 3, 1, 8)]
    assert rows(graph.component_filter(found, edges, 2, 4), "edge") == [(10,), (11,)]
    assert rows(graph.component_filter(found, edges, 0, None, 3), "edge") == [(1,), (2,), (3,), (4,), (10,), (11,)]
    assert rows(graph.component_filter(found, edges, wanted=spark.createDataFrame([(20,)], "edge long")), "edge") == [(20,)]


def test_simplifying_drops_a_tip_and_joins_what_is_left(spark):
    out = graph.simplify_round(graph_of(spark), F.col("tip") & graph.coverage_at_most(2.0), 1)
    assert rows(out, "edge", "src", "dst", "len", "raw_cov", "members") == [(1, 1, 4, 65, 640.0, 3), (10, 20, 20, 71, 79.0, 2), (20, 30, 30, 8, 8.0, 1)]


def test_relative_coverage_tips_by_hand(spark):
    edges = [(1, 1, 2, 10, 100.0), (2, 2, 3, 10, 100.0), (3, 2, 4, 10, 20.0), (4, 3, 5, 10, 90.0)]
    df = spark.createDataFrame(edges, "edge long, src long, dst long, len long, raw_cov double")
    assert rows(graph.relative_coverage_tips(df, 0.5), "edge") == [(3,)] and rows(graph.relative_coverage_tips(df, 0.1), "edge") == []


def test_postprocess_chains_its_steps(spark):
    text = "G" * 250 + "N" * 5 + "C" * 450
    hits = spark.createDataFrame([("a", "TTACGTATT"), ("b", "TTTT")], "contig string, seq string")
    spans = spark.createDataFrame([("a", 0, 705), ("b", 0, 705)], "contig string, start long, end long")
    df = spark.createDataFrame([("a", "s", text), ("b", "s", text)], "contig string, sample string, seq string")
    out = rows(seqs.postprocess(df, hits, spans, "ACGTA", 300, 40), "contig", "seq")
    assert [len(s) for _, s in out] == [450] and out[0][0].startswith("a")


def test_best_path_streams_contigs_over_batches(spark):
    rng = random.Random(6)
    data = [(f"q{c}", rng.choice("xy"), a, a + rng.randint(40, 400), rng.randint(10, 300), 1400) for c in range(60) for a in sorted(rng.sample(range(1000), 6))]
    df = spark.createDataFrame(data, "qname string, chrom string, qstart long, qend long, score long, qlen int")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = contigs.best_alignment_path(df).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    want = []
    for c in range(60):
        segments = sorted(x[2:5] + (x[1],) for x in data if x[0] == f"q{c}")
        path, total = contigs.best_path([(ch, a, b, s) for a, b, s, ch in segments], 1400.0)
        want += [(f"q{c}", segments[i][3], *segments[i][:3], total) for i in path]
    assert sorted(tuple(r) for r in out) == sorted(want)


def test_repeated_alignments_each_count_once(spark):
    data = [("s", "r", 0, "c", 3, "2M1D2M", "ACGT")] * 2
    bases = correct.read_bases(spark.createDataFrame(data, "sample string, qname string, flag int, contig string, pos long, cigar string, seq string"))
    assert rows(correct.pileup_votes(bases), "pos", "variant", "votes") == [(3, "A", 2), (4, "C", 2), (5, "D", 2), (6, "G", 2), (7, "T", 2)]


def test_cells_without_a_genomic_median_smooth_to_nothing(spark):
    cov = spark.createDataFrame([("s", 10, 5, 3.0), ("s", 10, 6, 4.0)], "sample string, gc int, map int, coverage double")
    cells = cn.gc_map_matrix(cov)
    assert rows(cells, "value") == [(None,), (None,)]
    assert cn.smooth_matrix(cells).collect() == []


def test_reads_that_read_alike_are_swept_as_one(spark):
    rng = random.Random(12)
    text = "".join(rng.choice("ACGT") for _ in range(560))
    data = []
    for i in range(160):
        at, c = rng.choice((1, 4, 490)), rng.choice(("30M", "12M1I17M", "10M2D18M"))
        got = list(text[at - 1 : at + 29])
        got[rng.randrange(3) * 9] = rng.choice("ACGTN")
        data.append(("s", f"r{i % 150}", 0, "c", at, c, "".join(got)))
    df = spark.createDataFrame(data, "sample string, qname string, flag int, contig string, pos long, cigar string, seq string")
    places = spark.createDataFrame([("c", p) for p in (*range(1, 40, 2), *range(495, 530, 3), 800)], "contig string, pos long")
    own = spark.createDataFrame([("c", text)], "contig string, seq string")
    for strategy in ("AllReads", "MappedSquared", "AllExceptJustStarted"):
        want = rows(correct.read_weighted_consensus(correct.read_bases(df), places, own, strategy), "pos", "base", "variant")
        assert len(want) > 25 and rows(correct.alignment_weighted_consensus(df, places, own, strategy), "pos", "base", "variant") == want


def test_repeats_of_sequences_read_whole_and_dealt_as_windows_agree(spark):
    rng = random.Random(13)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("AC", "ACGT", "ACGTN", "acgtACGT") for n in (0, 1, 3, 9, 10, 20, 300, 700)]
    df = spark.createDataFrame([*enumerate(texts), (len(texts), None)], "doc_id long, seq string")
    near, far = ({r.doc_id: r.repeat_score for r in seqs.repeat_score(df, whole=n).collect()} for n in (1 << 20, -1))
    assert near.keys() == far.keys() and all(near[d] == pytest.approx(far[d], abs=1e-12) for d in near)
    for k in (9, 40):
        near, far = (seqs.kmer_repeat_profile(df, k=k, whole=n) for n in (1 << 20, -1))
        assert near.dtypes == far.dtypes and sorted(near.collect()) == sorted(far.collect()) != []


def test_common_sites_link_contigs_through_sites_alone(spark, monkeypatch):
    rng = random.Random(14)
    data = [(rng.choice("ab"), f"q{i % 70}", rng.choice(("chr1", "chr2")), p, p + rng.randint(0, 25)) for i in range(90) for p in [rng.randrange(1500)]]
    nodes: dict = {}

    def root(x):
        while nodes.setdefault(x, x) != x:
            x = nodes[x]
        return x

    for s, q, c, a, b in data:
        for p in (a, b):
            nodes[root((s, q))] = root((c, p // 10))
    samples: dict = {}
    for s, q, *_ in data:
        samples.setdefault(root((s, q)), set()).add(s)
    want = sorted(x for x in data if len(samples[root(x[:2])]) == 1)
    asked = []
    monkeypatch.setattr(contigs, "components", lambda edges, name: asked.append(edges) or components(edges, name))
    out = contigs.remove_common_sites(spark.createDataFrame(data, "sample string, qname string, chrom string, rstart long, rend long"), 10)
    assert rows(out, "sample", "qname", "chrom", "rstart", "rend") == want and 0 < len(want) < len(data)
    assert {x for e in asked for r in e.collect() for x in r} <= {f"{c}|{p // 10}" for _, _, c, a, b in data for p in (a, b)}
