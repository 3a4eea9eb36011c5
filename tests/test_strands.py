"""Packed k-mers, graphs of both strands, and rules worked out from their definitions."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandloom.functions import packed
from strandloom.operators import correct, graph, kmers, pairs, seqs
from strandloom.plans.tables import saved

TURN = str.maketrans("ACGT", "TGCA")


def turned(s):
    return s[::-1].translate(TURN)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def random_reads(seed, n=40, letters="ACGT"):
    rng = random.Random(seed)
    return [(i, "".join(rng.choice(letters) for _ in range(rng.choice([0, 3, 12, 31, 40, 256, 300, 700])))) for i in range(n)]


@pytest.mark.parametrize("k", [1, 2, 11, 30, 31])
def test_packed_windows(spark, k):
    reads = random_reads(1) + [(100 + i, s) for i, s in random_reads(2, 10, "ACGTN")]
    df = spark.createDataFrame(reads, "id int, seq string")
    want = sorted((i, j, s[j : j + k], turned(s[j : j + k])) for i, s in reads for j in range(len(s) - k + 1) if "N" not in s[j : j + k])
    for spread in (False, True):
        got = packed.with_codes(df, k, ("id",), "at", spread).select("id", "at", packed.unpack("kmer", k).alias("w"), packed.unpack("rc", k).alias("r"), packed.pack(packed.unpack("kmer", k)).alias("again"), "kmer", packed.revcomp_code("kmer", k).alias("bits"), "rc")
        assert rows(got, "id", "at", "w", "r") == want
        assert got.where("again <> kmer or bits <> rc").count() == 0
    with pytest.raises(ValueError):
        packed.with_codes(df, 32)


def test_counts_are_those_of_strings(spark):
    reads = random_reads(3)
    df = spark.createDataFrame([(s, "ab"[i % 2]) for i, s in reads], "seq string, sample string")
    for k in (5, 33):  # numbers and strings
        want = Counter((("ab"[i % 2]), min(s[j : j + k], turned(s[j : j + k]))) for i, s in reads for j in range(len(s) - k + 1))
        assert rows(kmers.kmer_counts(df, k, ("sample",)), "sample", "kmer", "n") == sorted((a, w, n) for (a, w), n in want.items())
        assert rows(kmers.kmer_set(df, k), "kmer") == sorted({(x,) for _, w in want for x in (w, turned(w))})


def test_no_string_of_a_kmer_is_shuffled(spark):
    df = spark.createDataFrame(random_reads(4), "id int, seq string")
    plan = kmers.kmer_counts(df, 21)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(kmer" in plan
    counted = kmers.kmer_counts(df, 21, packed=True)
    assert dict(counted.dtypes)["kmer"] == "bigint" and dict(graph.extension_masks(df, 21).dtypes)["kmer"] == "bigint"


def test_valid_kmers_of_long_reads(spark):
    rng = random.Random(5)
    reads = [(i, "".join(rng.choice("ACGTN" if i == 2 else "ACGT") for _ in range(n)), "".join(chr(33 + rng.choice([0, 1, 2, 3, 30, 40])) for _ in range(n))) for i, n in enumerate((5, 300, 400, 900))]
    reads.append((9, "ACGTACGTAC", "!" * 10))
    want = []
    for i, s, q in reads:
        good = [j for j, c in enumerate(q) if ord(c) - 33 > 2]
        for j in range(len(s) - 7):
            if good and good[0] <= j and j + 7 <= good[-1] and "N" not in s[j : j + 8]:
                want.append((i, j + 1, s[j : j + 8], [ord(c) - 33 for c in q[j : j + 8]]))
    got = kmers.valid_kmers(spark.createDataFrame(reads, "read_id int, seq string, qual string"), 8)
    assert rows(got, "read_id", "at", "kmer", "quals") == sorted(want)


def test_sketches_unite_to_what_one_pass_finds(spark, tmp_path):
    reads = random_reads(6, 60)
    df = spark.createDataFrame([(f"lib{i % 3}", s) for i, s in reads], "lib string, seq string")
    stored = f"{tmp_path}/sketches"
    kmers.kmer_sketches(df.where("lib <> 'lib2'"), 13, ("lib",)).write.parquet(stored)
    kmers.kmer_sketches(df.where("lib = 'lib2'"), 13, ("lib",)).write.mode("append").parquet(stored)  # a library that comes later
    held = spark.read.parquet(stored)
    exact = kmers.kmer_counts(df, 13).count()
    united = kmers.sketch_cardinality(held).first()
    assert abs(united.estimate - exact) <= 3 * 0.0081 * exact and united.upper == -(-united.estimate * 11 // 10)
    assert united.estimate == kmers.kmer_cardinality(df, 13).first().estimate
    for r in kmers.sketch_cardinality(held, ("lib",)).collect():
        own = kmers.kmer_counts(df.where(F.col("lib") == r.lib), 13).count()
        assert abs(r.estimate - own) <= 3 * 0.0081 * own + 1


# ---------------------------------------------------------------- unitigs


def unitigs_of(spark, texts, k):
    masks = saved(graph.extension_masks(spark.createDataFrame([(t,) for t in texts], "seq string"), k), "masks")
    return graph.unitigs(masks, k).collect()


@pytest.mark.parametrize("k", [7, 8, 33])
def test_unitigs_come_once_a_strand_with_their_pair(spark, k):
    rng = random.Random(k)
    text = "".join(rng.choice("ACGT") for _ in range(400))
    texts = [text, text[50:130] + "".join(rng.choice("ACGT") for _ in range(60))]
    found = unitigs_of(spark, texts, k)
    by = {r.edge: r for r in found}
    assert len(by) == len(found) and len({r.seq for r in found}) == len(found)
    for r in found:
        assert by[r.conjugate].seq == turned(r.seq) and by[r.conjugate].conjugate == r.edge
    # every k-mer of both strands lies on one place of one edge
    spelled = Counter(r.seq[i : i + k] for r in found for i in range(len(r.seq) - k + 1))
    every = {x for t in texts for i in range(len(t) - k + 1) for x in (t[i : i + k], turned(t[i : i + k]))}
    assert set(spelled) == every and set(spelled.values()) == {1}


def test_cycles_of_both_strands_pair_up(spark):
    ring = "ACGTTGCAAGGCTTACCG"
    k = 7
    found = unitigs_of(spark, [ring + ring[: k + 1]], k)
    assert len(found) == 2 and {len(r.seq) for r in found} == {len(ring) + k - 1}
    a, b = found
    assert a.seq == turned(b.seq) and (a.conjugate, b.conjugate) == (b.edge, a.edge)


def test_a_hairpin_is_its_own_pair(spark):
    stem = "ACGGTTACCATGACA"
    found = unitigs_of(spark, [stem + turned(stem)], 7)
    spelled = {r.seq: r for r in found}
    assert stem + turned(stem) in spelled
    own = spelled[stem + turned(stem)]
    assert own.conjugate == own.edge
    edges = spark.createDataFrame([(1, 50, 1), (2, 60, 3), (3, 60, 2)], "edge long, len long, conjugate long")
    points = [(1, 1, 40, 9.0), (2, 3, 60, 9.0), (3, 2, 60, 9.0), (1, 2, 55, 5.0), (3, 1, 61, 6.0), (1, 3, 400, 9.0), (2, 1, 65, 2.0)]
    links = pairs.scaffold_links(spark.createDataFrame(points, "e1 long, e2 long, d long, w double"), 3, -20, 20, edges)
    assert rows(links, "e1", "e2", "w") == [(1, 2, 5.0), (3, 1, 6.0)]
    # 1 -> 2 and 3 -> 1 are one link on two strands (1 is its own conjugate)
    assert rows(pairs.both_strands(links, edges), "e1", "e2", "w") == [(1, 2, 6.0)]


def test_components_join_both_strands(spark):
    edges = [(1, 10, 11, 5, 2), (2, 21, 20, 5, 1), (3, 11, 12, 7, 4), (4, 22, 21, 7, 3), (5, 30, 31, 9, 6), (6, 41, 40, 9, 5), (7, 50, 50, 3, 7)]
    df = spark.createDataFrame(edges, "edge long, src long, dst long, len long, conjugate long")
    assert rows(graph.graph_components(df), "edge", "component", "n_edges", "total") == [(1, 1, 4, 24), (2, 1, 4, 24), (3, 1, 4, 24), (4, 1, 4, 24), (5, 2, 2, 18), (6, 2, 2, 18), (7, 3, 1, 3)]
    apart = graph.graph_components(df.drop("conjugate"))
    assert apart.select("component").distinct().count() == 5


def test_numbers_run_through_all_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    try:
        rng = random.Random(9)
        held = [(rng.randint(0, 30), i) for i in range(500)]
        got = graph.numbered(spark.createDataFrame(held, "total int, x int"), F.desc("total"), F.col("x"))
        assert [r[1] for r in sorted((r.id, (r.total, r.x)) for r in got.collect())] == sorted(held, key=lambda v: (-v[0], v[1]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 2)


# ---------------------------------------------------------------- paths


def test_paths_inside_others_go(spark):
    rng = random.Random(11)
    held = [[rng.randint(0, 3) for _ in range(rng.randint(1, 9))] for _ in range(120)] + [[7] * n for n in (1, 2, 5, 5)] + [[7]] * 30
    table = [(p, i, e) for p, edges in enumerate(held) for i, e in enumerate(edges)]
    df = spark.createDataFrame(table, "path long, ord long, edge long")
    inside = lambda a, b: any(b[i : i + len(a)] == a for i in range(len(b) - len(a) + 1))
    left = {p for p, a in enumerate(held) if not any(q != p and (len(a) < len(b) and inside(a, b) or a == b and q < p) for q, b in enumerate(held))}
    assert {r.path for r in graph.dedup_paths(df).select("path").distinct().collect()} == left


def test_a_repeat_edge_makes_one_row_not_a_pair_a_path(spark):
    table = [(p, i, e) for p in range(300) for i, e in enumerate([1000 + p, 1, 2000 + p])] + [(p, 0, 1) for p in range(300, 600)]
    df = spark.createDataFrame(table, "path long, ord long, edge long")
    windows = graph.path_windows(graph._path_sums(df))
    assert windows.where("n = 1").count() == 1 and windows.count() == 301
    assert graph.dedup_paths(df).count() == 900


# ---------------------------------------------------------------- thresholds


def threshold_by_hand(edges, max_len, width=None):
    outs, ins, twins = Counter(e[1] for e in edges), Counter(e[2] for e in edges), Counter((e[1], e[2]) for e in edges)
    average = sum(e[4] for e in edges) / sum(e[3] for e in edges)
    width = width or int(0.3 * average + 5)
    bins = Counter(int(e[4] / e[3]) for e in edges if e[3] <= max_len and outs[e[1]] > 1 and ins[e[2]] > 1 and not (outs[e[1]] == 2 == ins[e[2]] and twins[e[1], e[2]] == 2))
    weight = lambda v: sum(bins[v + i] * min(i + 1, width - i) for i in range(width) if v + i < len(bins))
    rises = []
    for i in range(1, max(bins, default=-1) + 1 - width):
        rises.append(weight(i) > weight(i - 1))
        if 2 * sum(rises[-width:]) >= width:
            return float(i), average
    return 0.1 * average, average


@pytest.mark.parametrize("width", [None, 3, 6])
def test_connection_threshold(spark, width):
    rng = random.Random(13)
    schema = "edge long, src long, dst long, len long, raw_cov double"
    for top in (30, 90):
        edges = [(i, rng.randint(0, 25), 100 + rng.randint(0, 25), 10, 10.0 * rng.choice([rng.randint(0, 6), rng.randint(top // 2, top)])) for i in range(400)]
        edges += [(1000, 900, 901, 10, 30.0), (1001, 900, 901, 10, 50.0)]  # a bulge of two edges
        want, average = threshold_by_hand(edges, 20, width)
        got = graph.erroneous_connection_threshold(spark.createDataFrame(edges, schema), 20, width).first()
        assert (round(got.threshold, 9), round(got.avg_coverage, 9), round(got.used, 9)) == (round(want, 9), round(average, 9), round(max(want, average), 9))
    none = graph.erroneous_connection_threshold(spark.createDataFrame([(1, 1, 2, 10, 100.0)], schema), 20, width).first()
    assert (none.threshold, none.used) == (1.0, 10.0)


def test_connection_threshold_of_a_written_out_histogram(spark):
    # 40 edges of coverage 0, then 2, 2, 3, 9, 20, 30, 20 at 1, 2, ... 7: with width 4 the sums 1 2 2 1 at 0, 1, 2 are
    # 40 + 2*2 + 2*2 + 3 = 51, 2 + 2*2 + 2*3 + 9 = 21, 2 + 2*3 + 2*9 + 20 = 46: the first rise is at 2, the second at 3 (3 + 18 + 40 + 30 = 91)
    counts = [40, 2, 2, 3, 9, 20, 30, 20]
    edges, n = [], 0
    for cov, many in enumerate(counts):
        for _ in range(many):
            edges.append((n, n % 3, 10 + n % 4, 10, 10.0 * cov))
            n += 1
    got = graph.erroneous_connection_threshold(spark.createDataFrame(edges, "edge long, src long, dst long, len long, raw_cov double"), 20, 4).first()
    assert got.threshold == 3.0


# ---------------------------------------------------------------- pairs, gaps, overlaps, repeats


def test_pair_info_passes_by_weight_or_coverage(spark):
    points = spark.createDataFrame([(1, 2, 0, 5.0), (1, 2, 1, 4.0), (3, 1, 0, 2.0), (9, 9, 0, 5.0), (9, 9, 1, 1.0)], "e1 long, e2 long, d long, w double")
    cov = spark.createDataFrame([(1, 100.0), (2, 100.0), (3, 20.0)], "edge long, coverage double")
    assert rows(pairs.filter_by_coverage(points, cov, 5.0), "e1", "e2", "d") == [(1, 2, 0), (3, 1, 0), (9, 9, 0)]


def test_gaps_are_mended_on_the_left_edge_first(spark):
    read = "ACGTACGTAC" + "GGCATTTGCA"
    schema = "left long, left_offset long, left_len long, right long, right_offset long, right_len long, read string, seq_start long, seq_end long"
    links = [
        (1, 30, 40, 2, 5, 50, read, 4, 9),  # a gap of five bases
        (3, 30, 40, 4, 5, 50, read, 9, 9),  # nothing between: one base of the left edge
        (5, 30, 40, 6, 5, 50, read, 12, 9),  # an overlap of three: four bases of the left edge
        (7, 3, 40, 8, 5, 50, read, 12, 9),  # two bases to give on the left edge, two more from the right one
        (9, 1, 40, 10, 5, 7, read, 12, 9),  # one base on the right edge isn't enough
        (11, 0, 40, 12, 5, 7, read, 4, 9), (13, 41, 40, 14, 5, 7, read, 4, 9), (15, 3, 40, 16, 7, 7, read, 4, 9),  # offsets outside of their edges
        (17, 3, 40, 18, 5, 50, read, 21, 19),  # one base of the right edge, the last of the read
        (19, 3, 40, 20, 5, 50, read, 22, 19),  # the right edge would begin behind the read
    ]
    gaps = pairs.gap_table(spark.createDataFrame(links, schema))
    want = [(1, 2, 5, 10, 5, read[4:9]), (3, 4, 1, 11, 5, read[8:9]), (5, 6, 1, 14, 5, read[8:9]), (7, 8, 1, 40 - 1, 5 + 2, read[10:11]), (17, 18, 1, 40 - 1, 5 + 1, read[19:20])]
    got = rows(gaps, "left", "right", "gap", "left_trim", "right_trim", "fill")
    assert got == want
    edges = spark.createDataFrame([(i, i + 1 if i % 2 else i - 1) for i in range(1, 21)], "edge long, conjugate long")
    other = rows(pairs.gap_conjugates(gaps, edges), "left", "right", "gap", "left_trim", "right_trim", "fill")
    assert other == sorted((r - 1, x + 1, g, b, a, turned(f)) for x, r, g, a, b, f in want)


def test_overlaps_are_bounded_by_the_estimated_distance(spark):
    held = [(1, "TTTTACGT", "ACGTCCCC", 5), (2, "TTTTACGT", "ACGTCCCC", -100), (3, "TTTTTTTT", "TCCCCCCC", 5), (4, "TTTTTTTT", "TCCCCCCC", -40), (5, "ACGTACGA", "ACGTACGT", 0), (6, "AACC", "GGTT", 0), (7, "", "A", 0)]
    df = spark.createDataFrame(held, "pair int, left string, right string, dist int")
    got = rows(seqs.best_overlap(df, 6, 0.6), "pair", "overlap")
    # 2: at least 5 bases, and none of 5 to 8 agrees; 4: at least 2
    assert got == [(1, 4), (3, 1), (5, 1)]
    assert rows(seqs.best_overlap(df, 6, 1.0), "pair") == []  # the score must be above the least one
    longer = spark.createDataFrame([(1, "CCACGA", "ACGTGG")], "pair int, left string, right string")
    assert rows(seqs.best_overlap(longer, 6, 0.6), "overlap") == [(1,)] and rows(seqs.best_overlap(longer, 6, 0.6, 3), "overlap") == [(4,)]


def test_repeat_score_leaves_out_the_last_window(spark):
    def by_hand(s):
        total = seen = 0
        for k in range(2, 10):
            last = {}
            for i in range(len(s) - k):
                w = s[i : i + k]
                if i > k:
                    total += 2.718281828459045 ** (-0.25 / k * (i - last[w] - 1)) if w in last else 0
                    seen += 1
                last[w] = i
        return total / seen if seen else 0.0

    texts = ["ACGACGACGT", "", "A", "ACGT", "A" * 30, "ACGTNNACGTNNACGT", *(s for _, s in random_reads(7, 8))]
    got = seqs.repeat_score(spark.createDataFrame(list(enumerate(texts)), "doc_id int, seq string"))
    found = dict(rows(got, "doc_id", "repeat_score"))
    assert round(found[0], 3) == 0.813
    assert all(abs(found[i] - by_hand(s)) < 1e-9 for i, s in enumerate(texts)) and len(found) == len(texts)


# ---------------------------------------------------------------- interesting positions


def test_anchors_lie_around_interesting_positions_only(spark):
    schema = "contig string, pos long, variant string, inserted string, votes long"
    votes = [("plain", p, "A", None, 30) for p in range(1, 2000, 7)]
    votes += [("mixed", 1234, "A", None, 15), ("mixed", 1234, "C", None, 10), ("mixed", 50, "A", None, 10), ("mixed", 50, "C", None, 10)]  # 20 votes aren't more than 20
    votes += [("few", 10, "A", None, 27), ("few", 10, "C", None, 3), ("few", 20, "A", None, 20), ("few", 20, "I", "G", 20), ("few", 30, "A", None, 12), ("few", 30, "N", None, 12)]
    texts = [("plain", "A" * 2000), ("mixed", "A" * 2000), ("few", "A" * 150), ("holes", "A" * 800 + "n" + "A" * 799), ("bare", "")]
    got = correct.interesting_positions(spark.createDataFrame(votes, schema), spark.createDataFrame(texts, "contig string, seq string"))
    by = defaultdict(set)
    for r in got.collect():
        by[r.contig, r.kind].add(r.pos)
    assert by["plain", "anchor"] == set() and "bare" not in {c for c, _ in by}
    assert by["mixed", "mixed"] == {1234} and by["mixed", "anchor"] == {600 + 100 * j + 1 for j in range(13)}
    assert by["few", "mixed"] == {30} and by["few", "anchor"] == {1, 101}
    # the base itself lies on a multiple of 100 (counted from 0), so it isn't named twice
    assert by["holes", "undefined"] == {801} and by["holes", "anchor"] == {200 + 100 * j + 1 for j in range(13)} - {801}


def test_reads_are_weighed_at_anchors_too(spark):
    contig = spark.createDataFrame([("c", "A" * 300)], "contig string, seq string")
    reads = [(f"a{i}", {150: "A", 201: "A"}) for i in range(13)] + [(f"c{i}", {150: "C", 201: "A"}) for i in range(12)] + [(f"alone{i}", {150: "C"}) for i in range(9)]
    bases = spark.createDataFrame([("c", q, p, v, None) for q, held in reads for p, v in held.items()], "contig string, qname string, pos long, variant string, inserted string")
    places = correct.interesting_positions(correct.pileup_votes(bases), contig)
    out = correct.read_weighted_consensus(bases, places, contig)
    # reads that cover one interesting position have no say, so A wins at 150 although C has more bases; and 201 is there as an anchor
    assert rows(out, "pos", "variant") == [(150, "A"), (201, "A")]
