"""What a task holds or moves doesn't grow with more than its share: plans and results of the steps that once did."""

import random
import re
from collections import Counter

from strandloom.functions.packed import pack, unpack
from strandloom.operators import contigs, correct, graph, intervals, kmers, pairs, seqs
from strandloom.plans import tables


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_are_made_after_reads_are_dealt(spark):
    data = [(1, 1, "ACGTACGTAC"), (2, 1, "AC"), (3, 2, "TTTTTTTTTG"), (4, 3, None), (5, 3, ""), (6, 4, "GATTACAGATTACA")]
    reads = spark.createDataFrame(data, "read_id int, pair int, seq string")
    counts = spark.createDataFrame([("ACGT", 9), ("CGTA", 9), ("TTTT", 2)], "kmer string, n int")
    got = seqs.median_coverage_filter(reads, counts, 4, 2)
    assert rows(got, "read_id") == [(1,), (2,), (3,)]
    text = plan(got)
    assert text.index("Generate") < text.index("hashpartitioning(read_id")  # the tree is printed from its root


def test_weighted_points_read_one_range(spark):
    rng = random.Random(3)
    data = [(g, rng.choice([None, *range(40)]) if g else rng.random(), rng.randint(1, 9)) for g in (None, 0, 1) for _ in range(300)]
    df = spark.createDataFrame([(g, None if v is None else float(v), w) for g, v, w in data], "g int, v double, w long").repartition(5)
    for down in (False, True):
        want = []
        for g in (None, 0, 1):
            own = sorted(((-1e9 if v is None else v), w) for k, v, w in data if k == g)
            own = own[::-1] if down else own
            for f in (0.1, 0.5, 1.0):
                total, at = 0, None
                for v, w in own:
                    total += w
                    if total >= f * sum(x for _, x in own):
                        at = v
                        break
                want.append((g, f, at))
        got = intervals.weighted_points(df, ["g"], "v", "w", [0.1, 0.5, 1.0], down)
        assert "Window" in plan(got) and "part_" in plan(got)
        found = {(r["g"], r["fraction"]): r["v"] for r in got.collect()}
        assert all(found[g, f] == at for g, f, at in want if at != -1e9) and len(found) == len(want)


def test_kmers_of_each_are_counted_without_a_shuffle_of_windows(spark, monkeypatch):
    rng = random.Random(5)
    data = [(i // 2 if i else None, "".join(rng.choice("ACGTN") if i % 3 else rng.choice("AC") for _ in range(rng.choice([0, 4, 5, 300, 900])))) for i in range(20)] + [(99, None)]
    want = Counter((d, s[i : i + 5]) for d, s in data if s for i in range(len(s) - 4) if "N" not in s[i : i + 5])
    df = spark.createDataFrame(data, "id int, seq string")
    for most in (1 << 20, 500):
        monkeypatch.setattr(kmers, "WHOLE", most)
        got = kmers.kmers_of_each(df, 5, "id")
        assert {(r["id"], r["kmer"]): r["n"] for r in got.collect()} == dict(want)
        assert "hashpartitioning(id" in plan(got) and ("kmer" in "".join(line for line in plan(got).splitlines() if "Exchange hash" in line)) == (most == 500)


def test_numbers_are_looked_up(spark):
    words = ["".join(random.Random(k).choice("ACGT") for _ in range(k)) for k in range(1, 32)]
    for w in words:
        df = spark.createDataFrame([(w,), (None,)], "w string").select("w", unpack(pack("w"), len(w)).alias("again"))
        assert df.where("w is distinct from again").isEmpty() and "conv(cast" not in plan(df)


def test_edges_ask_the_reference_for_their_kmers_only(spark):
    edges = spark.createDataFrame([("e", "ACGTAC"), ("f", "TTTTTT"), ("g", "AC")], "edge string, seq string")
    reference = spark.createDataFrame([("GTACGTACCC",), ("GGGGGG",), ("ACGT",)], "seq string")
    want = {}
    for e, s in (("e", "ACGTAC"), ("f", "TTTTTT"), ("g", "AC")):
        both = [x for r in ("GTACGTACCC", "GGGGGG", "ACGT") for x in (r, r[::-1].translate(str.maketrans("ACGT", "TGCA")))]
        want[e] = sum(r[i : i + 4] == s[j : j + 4] for j in range(len(s) - 3) for r in both for i in range(len(r) - 3))
    got = graph.edge_quality(edges, reference, 4)
    assert dict(rows(got, "edge", "quality")) == want
    assert "LeftSemi" in plan(got)


def test_profiles_are_counted_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(kmers, "saved", lambda df, name: made.append(name) or tables.saved(df, name))
    profiles = spark.createDataFrame([(6, "s", 4), (6, "t", 2), (27, "s", 1)], "kmer long, sample string, n long")  # ACG, CGT as 3-mers
    contig = spark.createDataFrame([("c", "AACGTT")], "contig string, seq string")
    assert rows(kmers.contig_abundance(contig, profiles, 3), "sample", "abundance") == [("s", 4.0), ("t", 2.0)]
    assert rows(kmers.contig_abundance_median(contig, profiles, 3), "sample", "median", "mad") == [("s", 4, 0), ("t", 2, 0)]
    assert made.count("profiles") == 2


def test_alignments_that_read_alike_vote_as_one(spark):
    data = [("s", f"r{i}", 0, "c", 3, cigar, seq) for i, (cigar, seq) in enumerate([("3M", "acg")] * 5 + [("1M1I1M", "ATC")] * 2 + [("1M2D2M", "AGG"), ("3M", "TCG")])]
    aln = spark.createDataFrame(data, "sample string, qname string, flag int, contig string, pos long, cigar string, seq string")
    each = lambda df: Counter(map(tuple, df.select("contig", "pos", "variant", "inserted", "votes").collect()))
    got = correct.alignment_votes(aln)
    assert each(got) == each(correct.pileup_votes(correct.read_bases(aln)))
    assert "Generate" not in plan(got)  # the votes are there


def test_reads_are_placed_from_small_tables(spark, monkeypatch):
    made = []
    monkeypatch.setattr(contigs, "saved", lambda df, name: made.append(name) or tables.saved(df, name))
    rng = random.Random(1)
    seq = "".join(rng.choice("ACGT") for _ in range(700))
    reads = spark.createDataFrame([(1, seq[490:560])], "read_id int, seq string")
    got = contigs.read_to_contig_coverage(reads, spark.createDataFrame([("c", seq)], "contig string, seq string"), 21, 60)
    assert rows(got, "contig", "uncovered", "coverage") == [("c", 630, 0.1)] and {"read-seeds", "placed-reads"} <= set(made)


def test_breaks_meet_places_as_islands(spark):
    rng = random.Random(2)
    spots = [(rng.choice(["A", "B", None]), "c", a, a + rng.choice([0, 1, 30, 300])) for a in (rng.randint(-50, 900) for _ in range(200))]
    breaks = [(rng.choice(["A", "B", None]), "c", rng.randint(-40, 400)) for _ in range(40)] + [("A", "c", 700)] * 9
    df = spark.createDataFrame(spots + spots[:20], "sample string, chrom string, rstart long, rend long")
    got = contigs.overlaps_break(df, spark.createDataFrame(breaks, "sample string, chrom string, pos long"), 10, 100)
    want = Counter((s, c, a, b, any(s is not None and s == t and a < p + 10 and p - 10 < b for t, _, p in breaks)) for s, c, a, b in spots + spots[:20])
    assert Counter(map(tuple, got.select("sample", "chrom", "rstart", "rend", "vcf").collect())) == want
    dense = spark.createDataFrame([("A", "c", p) for p in range(1000)], "sample string, chrom string, pos long")
    assert contigs.break_islands(dense, 10, 100).groupBy("bucket").count().where("count > 1").isEmpty()


def test_names_are_dealt_before_events(spark):
    df = spark.createDataFrame([("q", 5, 9, 20), ("q", 7, 12, 20)], "qname string, qstart long, qend long, qlen int")
    got = contigs.contig_segments(df)
    assert rows(got, "start", "end", "kind") == [(0, 5, "u"), (5, 7, "a"), (7, 9, "h"), (9, 12, "a"), (12, 20, "u")]
    assert plan(got).count("Exchange hashpartitioning(qname") == 1 and plan(got).index("Generate") < plan(got).index("Exchange hashpartitioning(qname")


def test_neighbours_are_linked_by_place(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("ACGT") for _ in range(5)) for _ in range(90)})
    label = {w: w for w in words}
    for _ in words:
        for a in words:
            label[a] = min(label[b] for b in words if sum(x != y for x, y in zip(a, b, strict=True)) < 2)
    df = spark.createDataFrame([(w,) for w in words], "kmer string")
    assert dict(rows(kmers.hamming1_clusters(df, 5), "kmer", "component")) == label
    numbers = kmers.hamming1_clusters(df.select(pack("kmer").alias("kmer")), 5)
    assert dict(rows(numbers.select(unpack("kmer", 5).alias("kmer"), unpack("component", 5).alias("c")), "kmer", "c")) == label


def test_short_kmers_are_distinct_before_they_are_sketched(spark):
    df = spark.createDataFrame([("s", "ACGTACGTTTGACA" * 9)], "sample string, seq string")
    short, long = kmers.kmer_sketches(df, 5, ("sample",)), kmers.kmer_sketches(df, 13, ("sample",))
    assert "keys=[sample" in plan(short).replace(" ", "") and plan(short).count("HashAggregate") > plan(long).count("HashAggregate")
    assert round(kmers.sketch_cardinality(short).first()["estimate"]) == kmers.kmer_counts(df, 5).count()


def test_lines_of_a_file_travel_without_its_path(spark, tmp_path):
    from strandloom.sources import readers

    for name in ("a", "b"):
        (tmp_path / f"{name}.fastq").write_text("".join(f"@{name}{i}\nACGT\n+\nIIII\n" for i in range(3)))
    got = readers.read_fastq(spark, f"file://{tmp_path}")
    assert rows(got, "record", "name") == [(i, f"{n}{i}") for i in range(3) for n in "ab"]
    assert "hashpartitioning(path" not in plan(got)


def test_mapping_ranges_are_dealt_by_their_number(spark, monkeypatch):
    rng = random.Random(23)
    data = [(rng.choice([None, 1, 2]), rng.choice([7, 8]), q, q + rng.randint(1, 60), e, e + rng.randint(1, 60)) for _ in range(200) for q, e in [(rng.randint(0, 4000), rng.randint(0, 4000))]]
    maps = spark.createDataFrame(data, "edge long, read long, q_start long, q_end long, e_start long, e_end long")
    want = []
    for key in {d[:2] for d in data}:
        own, last = sorted(d[2:] for d in data if d[:2] == key), None
        for q0, q1, e0, e1 in own:
            if last and q0 - last[1] <= 900 and e0 - last[3] <= 900 and abs(q0 - last[1] - e0 + last[3]) <= 500:
                low = want.pop()
                want.append((*key, low[2], max(low[3], q1), min(low[4], e0), max(low[5], e1)))
            else:
                want.append((*key, q0, q1, e0, e1))
            last = (q0, q1, e0, e1)
    names, order = maps.columns, lambda r: tuple(-1 if x is None else x for x in r)
    assert len(want) < len(data) - 20
    for most, parts in ((1 << 19, 2), (25, 8)):
        monkeypatch.setattr(tables, "ROWS", most)
        got = graph.merge_edge_positions(maps, 900, 500)
        assert sorted((tuple(r) for r in got.select(*names).collect()), key=order) == sorted(want, key=order)
        assert {int(n) for n in re.findall(r"hashpartitioning\([^()]*, (\d+)\)", plan(got))} == {parts}


def test_pairs_and_points_are_dealt_by_their_number(spark, monkeypatch):
    rng = random.Random(6)
    data = [(rng.randint(0, 40), rng.randint(0, 1), rng.choice([1, 2]), rng.randint(0, 900), rng.randint(1, 9)) for _ in range(200)]
    want = Counter()
    for p, m, e, s, n in data:
        for p2, m2, e2, s2, n2 in data:
            if (p, m, m2) == (p2, 0, 1):
                want[e, e2, s2 - s] += n * n2
    merged = []
    for key in sorted({k[:2] for k in want}):
        own = []
        for d in sorted(k[2] for k in want if k[:2] == key):
            own = own if own and d - own[-1][-1] <= 20 else [*own, []]
            own[-1].append(d)
        merged += [(*key, sum(d * want[*key, d] for d in ds) / sum(want[*key, d] for d in ds), float(sum(want[*key, d] for d in ds)), (ds[-1] - ds[0]) / 2) for ds in own]
    mates = spark.createDataFrame(data, "pair long, mate int, edge long, e_start long, mapped long")
    dealt = lambda df: {int(n) for n in re.findall(r"hashpartitioning\([^()]*, (\d+)\)", plan(df))}
    for most, parts, more in ((1 << 19, 2, 2), (40, 5, -(-len(want) // 40))):
        monkeypatch.setattr(tables, "ROWS", most)
        points = pairs.pair_info(mates, "product")
        assert rows(points, "e1", "e2", "d", "w") == sorted((*k, float(w)) for k, w in want.items()) and dealt(points) == {parts}
        got = pairs.cluster_distances(points, 20)
        assert rows(got, "e1", "e2", "d", "w", "half_width") == sorted(merged) and dealt(got) == {more}


def test_blocks_of_kmers_are_not_written(spark, monkeypatch):
    rng = random.Random(26)
    k, tau, written = 12, 2, []
    word = lambda: "".join(rng.choice("ACGT") for _ in range(k))
    made = {word() for _ in range(900)}
    for w in sorted(made)[:60]:
        made.add("".join(rng.choice("ACGT") if i in (2, 9) else c for i, c in enumerate(w)))
    crowd = {"ACGTACGT" + "".join(rng.choice("ACGT") for _ in range(4)) for _ in range(80)}  # a block of more than 20
    save = kmers.saved
    monkeypatch.setattr(kmers, "saved", lambda df, name: written.append((name, save(df, name))) or written[-1][1])

    def group(links):
        least = {x: x for pair in links for x in pair}
        while any(least[a] != least[b] for a, b in links):
            for a, b in links:
                least[a] = least[b] = min(least[a], least[b])
        return least

    for words, block in ((made, 50), (made | crowd, 20)):
        near = {(a, b) for a in words for b in words if a < b and sum(x != y for x, y in zip(a, b, strict=True)) <= tau}
        df = spark.createDataFrame([(w,) for w in sorted(words)], "kmer string").select(pack("kmer").alias("kmer"))
        pairs_, links = kmers.hamming_candidates(df, tau, k, block)
        text = lambda d, a, b: set(rows(d.select(unpack(a, k).alias("a"), unpack(b, k).alias("b")), "a", "b"))
        found, alike = text(pairs_, "kmer", "kmer2"), text(links, "a", "b")
        assert found <= near and alike <= near
        if words is made:
            assert found == near and not alike
            assert sum(t.count() for name, t in written if name == "kmer-blocks") < len(words)  # pairs, not a row for each block
        assert group(found | alike) == group(near)


def test_the_sweep_gets_a_number_for_an_alignment(spark, monkeypatch):
    rng = random.Random(5)
    texts = {c: "".join(rng.choice("ACGT") for _ in range(560)) for c in "cd"}
    data = []
    for i in range(300):
        c, at, cigar = rng.choice("cd"), rng.choice((1, 4, 500)), rng.choice(("20M", "8M1I11M", "10M2D10M"))
        seq = list(texts[c][at - 1 : at + 19])
        seq[rng.choice((0, 6, 9, 15))] = rng.choice("ACGTNa")
        data.append(("s", f"r{i % 230}", 0, c, at, cigar, "".join(seq)))
    data += [("s", "bare", 0, "c", 1, "10M2D10M", None), ("s", "bare", 0, "c", 4, "10M2D10M", None)]
    aln = spark.createDataFrame(data, "sample string, qname string, flag int, contig string, pos long, cigar string, seq string")
    places = [(c, p) for c in "cd" for p in (1, 7, 10, 11, 13, 15, 505, 510, 511, 600)]
    said = {}
    for r in correct.read_bases(aln).where("variant <> 'I'").collect():
        if (r.contig, r.pos) in places:
            said.setdefault((r.contig, r.qname), []).append((r.pos, r.variant))
    said = {k: v for k, v in said.items() if len(v) > 1}

    def swept(strategy):
        out = []
        for c in "cd":
            own = {q: v for (k, q), v in said.items() if k == c}
            wrong, right = Counter(), Counter()
            for p in sorted({p for v in own.values() for p, _ in v}, reverse=True):
                here = [(q, x) for q, v in own.items() for at, x in v if at == p]
                votes = Counter()
                for q, x in here:
                    factor = {"AllReads": 1, "MappedSquared": right[q] ** 2, "AllExceptJustStarted": not wrong[q] and not right[q]}[strategy]
                    votes[x] += ((100, 10, 8, 5, 2, 1)[wrong[q]] if wrong[q] < 6 else 0) * factor
                base = texts[c][p - 1]
                best = max(votes, key=lambda x: (votes[x], x == base, -"ACGTND".index(x))) if any(votes.values()) else base
                for q, x in here:
                    (right if x == best else wrong)[q] += 1
                out.append((c, p, base, best))
        return sorted(out)

    handed, whole = [], correct._swept
    monkeypatch.setattr(correct, "_swept", lambda df, *more: handed.append(df) or whole(df, *more))
    contig = spark.createDataFrame([*texts.items()], "contig string, seq string")
    for strategy in ("AllReads", "MappedSquared", "AllExceptJustStarted"):
        got = correct.alignment_weighted_consensus(aln, spark.createDataFrame(places, "contig string, pos long"), contig, strategy)
        assert rows(got, "contig", "pos", "base", "variant") == swept(strategy)
    assert handed[0].columns == ["contig", "parts", "n"] and handed[0].count() < len({d[1:4:2] for d in data})
    assert handed[0].selectExpr("max(size(parts))", "sum(size(parts) * n)").first()[:] == (max(Counter((d[3], d[1]) for d in data).values()), len(data))


def test_folders_cost_no_process_and_no_discovery(spark, tmp_path):
    from strandloom.sources import readers, writers

    names = ["a b", "é", "a%20b", "a+b", "a/b=c", "x'y\"#?*:[]{}^\\", None, "", "7"]
    data = [(n, "chr1", i, None if i % 3 else 'q"\t,x') for i, n in enumerate(names * 3)]
    df = spark.createDataFrame(data, "sample string, chrom string, start long, note string").repartition(3)
    df.write.partitionBy("sample").option("sep", "\t").csv(f"file://{tmp_path}/spark")
    writers.write_bed(df, f"file://{tmp_path}/bed")
    folders = {p.name for p in (tmp_path / "spark").glob("sample=*")}
    assert {p.name for p in (tmp_path / "bed").glob("sample=*")} == folders and len(folders) == 8
    lines = lambda d, f: sorted("".join(p.read_text() for p in (tmp_path / d / f).glob("part-*")).splitlines())
    assert all(lines("bed", f) == lines("spark", f) for f in folders)
    # Hadoop, which writes a checksum beside each file, starts a process for each of them
    assert not [*(tmp_path / "bed").rglob("*.crc")] and not [*(tmp_path / "bed").rglob(".part*")]
    got = readers.read_folders(spark, f"file://{tmp_path}/bed", "chrom string, start long, note string", "sample", sep="\t")
    assert Counter(map(tuple, got.collect())) == Counter((c, a, n, s or None) for s, c, a, n in data)
    assert "partitionfilters: []" in plan(got).lower() and "sample#" not in plan(got).split("FileScan")[1]
    lines = spark.createDataFrame([("s", 2, "b"), ("t", 1, "c"), ("s", 1, "a")], "sample string, n long, chrom string")
    writers.write_folders(writers.by_folder(lines, "sample"), f"file://{tmp_path}/head", ["sample"], "csv", header=True)
    assert sorted(next((tmp_path / "head/sample=s").iterdir()).read_text().splitlines()) == ["1,a", "2,b", "n,chrom"]
    assert next((tmp_path / "head/sample=t").iterdir()).read_text() == "n,chrom\n1,c\n"
