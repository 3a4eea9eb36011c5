"""Sequences in pieces, exact segmentation with pruning, and Hamming clusters with split blocks and a limit."""

import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import packed, seq
from strandloom.operators import aln, chunked, cn, contigs, correct, kmers, seqs

TURN = str.maketrans("ACGT", "TGCA")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def text(rng, n, letters="ACGT"):
    return "".join(rng.choice(letters) for _ in range(n))


def sequences(spark, seed=1):
    rng = random.Random(seed)
    held = [(f"c{i}", text(rng, n)) for i, n in enumerate((0, 1, 511, 512, 513, 1500, 4000))]
    return dict(held), spark.createDataFrame(held, "contig string, seq string")


def test_pieces_hold_every_base_once(spark):
    held, df = sequences(spark)
    got = defaultdict(list)
    for r in chunked.pieces(df).collect():
        got[r.contig].append((r.piece, r.bases))
    assert {c: "".join(b for _, b in sorted(p)) for c, p in got.items()} == {c: s for c, s in held.items() if s}
    assert rows(chunked.pieces(df, lap=5).where("contig = 'c4'"), "piece", "bases") == [(0, held["c4"][:513]), (1, held["c4"][512:])]


def test_regions_across_pieces(spark):
    held, df = sequences(spark)
    rng = random.Random(2)
    regions = [(c, a, a + rng.randint(0, 1400)) for c in held for a in (rng.randint(0, 4100) for _ in range(6))] + [("c6", 0, 4000), ("c6", 5, 2000), ("c6", 5, 2000), ("none", 1, 5)]
    got = rows(aln.extract_regions(spark.createDataFrame(regions, "contig string, start long, end long"), df), "name", "seq")
    assert got == sorted((f"{c}_({a}-{b})", held[c][a:b]) for c, a, b in regions if c in held)


def test_plans_move_pieces_not_sequences(spark):
    """What is shuffled towards regions, indels and reads is the piece; the whole sequence is only read."""
    _, df = sequences(spark)
    regions = spark.createDataFrame([("c6", 5, 2000)], "contig string, start long, end long")
    reads = spark.createDataFrame([(1, "ACGT" * 30)], "read_id long, seq string")
    for out in (aln.extract_regions(regions, df), contigs.read_to_contig_coverage(reads, df, 21, 60)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        scans = [line for line in plan.splitlines() if "Join" in line]
        assert scans and "regexp_extract_all(seq" in plan


def test_indels_at_the_seams_of_pieces(spark):
    held = {"a": "C" * 510 + "AAAAAA" + "G" * 100 + "TTTT", "b": "ACGT"}
    df = spark.createDataFrame(list(held.items()), "contig string, seq string")
    places = [("a", 511), ("a", 512), ("a", 513), ("a", 618), ("a", 617), ("a", 5000), ("b", 2), ("none", 1)]
    alns = [("s", f"q{i}", 0, c, p - 10, f"10M1{'ID'[i % 2]}5M") for i, (c, p) in enumerate(places)]
    got = aln.indel_by_homopolymer(spark.createDataFrame(alns, "sample string, qname string, flag int, contig string, pos long, cigar string"), df, 4)
    want = Counter()
    for i, (c, p) in enumerate(places):
        if c in held:
            tail = held[c][p - 1 :]
            run = len(tail) - len(tail.lstrip(tail[0])) if tail else 0
            want["s", "ID"[i % 2], "long" if run >= 4 else "short"] += 1
    assert rows(got, "sample", "op", "in_run", "n") == sorted((*k, n) for k, n in want.items())


def test_coverage_runs(spark):
    rng = random.Random(3)
    held = {"x": text(rng, 1400), "y": text(rng, 90), "z": "ACGT" * 20}
    reads = [(1, held["x"][0:300]), (2, held["x"][200:700]), (3, held["x"][450:650][::-1].translate(TURN)), (4, held["x"][1300:] + text(rng, 60)), (5, text(rng, 40) + held["y"] + text(rng, 40)), (6, text(rng, 100))]
    out = contigs.read_to_contig_coverage(spark.createDataFrame(reads, "read_id long, seq string"), spark.createDataFrame(list(held.items()), "contig string, seq string"), 21, 80)
    depth = {c: np.zeros(len(s), int) for c, s in held.items()}
    for c, a, b in (("x", 0, 300), ("x", 200, 700), ("x", 450, 650), ("x", 1300, 1400), ("y", 0, 90)):
        depth[c][a:b] += 1
    for r in out.collect():
        spelled = np.concatenate([np.full(x.end - x.start, x.depth) for x in r.runs])
        assert spelled.tolist() == depth[r.contig].tolist() and r.uncovered == int((spelled == 0).sum()) and abs(r.coverage - spelled.mean()) < 1e-12
        assert all(a.end == b.start and a.depth != b.depth for a, b in zip(r.runs, r.runs[1:], strict=False))


def test_sparse_patches(spark):
    held, df = sequences(spark, 4)
    rng = random.Random(5)
    changes, want = [], {}
    for c, s in held.items():
        pieces = list(s)
        for p in rng.sample(range(len(s)), min(len(s), 12)):
            kind = rng.choice(["D", "N", "A", "C", "G", "T", None])
            more = rng.choice([None, None, "", "GATTACA"])
            changes.append((c, p + 1, s[p], kind, more))
            pieces[p] = (s[p] if kind in (None, "N") else "" if kind == "D" else kind) + (more or "")
        want[c] = ("".join(pieces), sum(a != b for a, b in zip(pieces, s, strict=True)))
    table = spark.createDataFrame(changes, "contig string, pos long, base string, variant string, inserted string")
    assert rows(correct.corrected_contigs(df, table), "contig", "seq", "n_changes") == sorted((c, *w) for c, w in want.items() if held[c])
    # rows are pieces, however long the contigs are
    assert correct.corrected_pieces(df, table).count() == sum(-(-len(s) // chunked.SIZE) for s in held.values())


def test_consensus_of_ties_and_changes_only(spark):
    votes = [("c", 1, "G", None, 3), ("c", 1, "T", None, 3), ("c", 2, "C", None, 2), ("c", 2, "A", None, 2), ("c", 3, "D", None, 4), ("c", 3, "T", None, 4), ("c", 4, "N", None, 9), ("c", 9, "A", None, 9)]
    table = spark.createDataFrame(votes, "contig string, pos long, variant string, inserted string, votes long")
    ref = spark.createDataFrame([("c", "acga")], "contig string, seq string")
    assert rows(correct.consensus(table, ref), "pos", "base", "variant") == [(1, "A", "G"), (2, "C", "C"), (3, "G", "T"), (4, "A", "N")]
    assert rows(correct.consensus(table, ref, changes_only=True), "pos") == [(1,), (3,)]


def test_quality_strings(spark):
    held, df = sequences(spark, 6)
    rng = random.Random(7)
    bases = [(c, rng.randint(1, len(s) + 2), rng.choice("ACGT"), rng.randint(2, 40)) for c, s in held.items() if s for _ in range(300)] + [("none", 1, "A", 30)]
    sums = defaultdict(list)
    for c, p, b, q in bases:
        if c in held and p <= len(held[c]) and held[c][p - 1] == b:
            sums[c, p].append(q)
    want = sorted((c, "".join(chr(33 + sum(sums[c, p]) // len(sums[c, p])) if (c, p) in sums else "!" for p in range(1, len(s) + 1))) for c, s in held.items() if s)
    assert rows(seqs.consensus_quality(df, spark.createDataFrame(bases, "contig string, pos long, base string, phred int")), "contig", "quality") == want


def test_bases_of_a_long_read_take_linear_time(spark):
    def seconds(n):
        read = spark.createDataFrame([("s", "q", 0, "c", 1, f"{n}M", "ACGT" * (n // 4))], "sample string, qname string, flag int, contig string, pos long, cigar string, seq string")
        began = time.perf_counter()
        got = correct.read_bases(read).agg(F.count("*"), F.max("pos"), F.count_if(F.col("variant") == "G")).first()
        assert tuple(got) == (n, n, n // 4)
        return time.perf_counter() - began

    seconds(4000)
    assert seconds(400_000) < 10 * max(0.5, seconds(40_000))


def test_hamming_and_qualities_of_strings(spark):
    df = spark.createDataFrame([("ACGT", "ACGA"), ("", ""), ("A", "AC"), (None, "A"), ("ÄB", "ÄC")], "a string, b string")
    assert [r.d for r in df.select(seq.hamming("a", "b").alias("d")).collect()] == [1, 0, None, None, 1]
    assert [r.q for r in spark.createDataFrame([("!I~",), ("",), (None,)], "s string").select(seq.qualities("s").alias("q")).collect()] == [[0, 40, 93], [], []]


# ---------------------------------------------------------------- segmentation


def plain_segments(y, gamma, kmin):
    n = len(y)
    total, square = np.append(0, np.cumsum(y)), np.append(0, np.cumsum(y * y))
    cost, back = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    cost[0] = -gamma
    for e in range(kmin, n + 1):
        s = np.arange(0, e - kmin + 1)
        fit = cost[s] + square[e] - square[s] - (total[e] - total[s]) ** 2 / (e - s) + gamma
        k = int(fit.argmin())
        cost[e], back[e] = fit[k], s[k]
    out, e = [], n
    while e > 0:
        e = back[e]
        out.append(int(e))
    return out[::-1]


def test_pruned_segmentation_is_exact():
    rng = np.random.default_rng(1)
    for t in range(300):
        n, kmin, gamma = int(rng.integers(1, 250)), int(rng.integers(1, 9)), float(rng.choice([0.1, 1, 5, 20, 100]))
        y = rng.normal(0, 1, n) + np.repeat(rng.normal(0, 3, 40), 10)[:n] + (1000 if t % 3 == 0 else 0)
        assert cn.best_segments(y, gamma, min(kmin, n)).tolist() == plain_segments(y, gamma, min(kmin, n))
    assert cn.best_segments(np.ones(50), 1.0, 3).tolist() == [0]


def test_few_starts_are_held_on_a_long_arm(monkeypatch):
    rng = np.random.default_rng(2)
    held = []
    add = cn._Levels.add
    monkeypatch.setattr(cn._Levels, "add", lambda self, *a: (add(self, *a), held.append(len(self.start)))[0])
    y = rng.normal(0, 1, 20_000) + np.repeat(rng.normal(0, 4, 20), 1000)
    assert 15 <= len(cn.best_segments(y, 40.0, 5)) <= 25
    assert np.mean(held) < 60 and max(held) < 400


# ---------------------------------------------------------------- Hamming clusters


def brute_clusters(kmers_, tau):
    parent = {x: x for x in kmers_}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    held = sorted(kmers_)
    codes = np.array([[ord(c) for c in x] for x in held])
    for i, x in enumerate(held):
        for j in np.flatnonzero((codes[i + 1 :] != codes[i]).sum(1) <= tau) + i + 1:
            a, b = sorted((root(x), root(held[j])))
            parent[b] = a
    return {x: root(x) for x in held}


@pytest.mark.parametrize(("tau", "k", "block"), [(1, 12, 50), (1, 12, 4), (2, 10, 3), (1, 33, 5)])
def test_clusters_match_brute_force(spark, tau, k, block):
    rng = random.Random(k + block)
    seeds = [text(rng, k) for _ in range(25)]
    made = set(seeds)
    for s in seeds:
        for _ in range(12):
            x = list(s)
            for i in rng.sample(range(k), rng.randint(0, 3)):
                x[i] = rng.choice("ACGT")
            made.add("".join(x))
    df = spark.createDataFrame([(x,) for x in made], "kmer string")
    assert dict(rows(kmers.hamming_clusters(df, tau, k, block), "kmer", "component")) == brute_clusters(made, tau)


def test_a_block_of_low_complexity_makes_few_pairs(spark):
    """50,000 k-mers that agree on a stretch: compared pair by pair they would be 1.25 thousand million pairs."""
    k, rng = 24, random.Random(9)
    made = set()
    while len(made) < 50_000:
        made.add("A" * 12 + text(rng, 4) + "A" * 4 + text(rng, 4))
    df = spark.createDataFrame([(x,) for x in made], "kmer string").select(packed.pack("kmer").alias("kmer"))
    pairs, links = kmers.hamming_candidates(df, 1, k)
    assert pairs.count() + links.count() < 60 * 50_000  # blocks of 50 at most, in two families, twice


def test_no_cluster_outgrows_the_limit(spark):
    rng = random.Random(10)
    made = {"A" * 6 + text(rng, 6) for _ in range(900)} | {text(rng, 12) for _ in range(60)}
    df = spark.createDataFrame([(x,) for x in made], "kmer string")
    whole = brute_clusters(made, 2)
    sizes = Counter(whole.values())
    limit = 100
    got = dict(rows(kmers.hamming_clusters(df, 2, 12, 20, limit), "kmer", "component"))
    assert set(got) == made and max(sizes.values()) > limit
    clusters = defaultdict(set)
    for x, c in got.items():
        clusters[c].add(x)
        assert whole[x] == whole[c]  # never beyond its component
        if sizes[whole[x]] <= limit:
            assert c == whole[x]
    assert max(map(len, clusters.values())) <= limit
    near = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True)) <= 2
    # no two clusters that are linked could still unite
    fits = lambda a, b: a + b <= limit and not (a > 75 and b > 50) and not (b > 75 and a > 50)
    names = sorted(clusters)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if fits(len(clusters[a]), len(clusters[b])):
                assert not any(near(x, y) for x in clusters[a] for y in clusters[b])
    again = dict(rows(kmers.hamming_clusters(df.repartition(3), 2, 12, 20, limit), "kmer", "component"))
    assert again == got
