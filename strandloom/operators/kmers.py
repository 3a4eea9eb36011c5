"""K-mers: counts, clusters and abundance (KM1-KM17).

Up to 31 bases a k-mer is a number from the window on (functions/packed.py), and becomes a string at the end only; `packed=True`
leaves it a number. Counts are summed before anything is joined.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions.packed import Packed, codec
from strandloom.functions.seq import CHUNK, canonical, chunks, qualities, with_windows
from strandloom.plans.tables import components, dealt_by, dealt_by_rows, forget, saved


def kmers(reads: DataFrame, k: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """KM1: every window of k bases; shorter reads give none."""
    return with_windows(reads, k, carry)


#: Letters of a sequence whose k-mers one task may count.
WHOLE = 1 << 20


def kmers_of_each(reads: DataFrame, k: int, key: str) -> DataFrame:
    """KM1: key, kmer, n of windows of ACGT by sequence. Sequences are dealt out by key before their windows are made, so a k-mer is not
    shuffled; those of more than WHOLE letters are dealt as windows, by key and k-mer."""
    code = codec(k)
    count = lambda df: code.rows(df, k, (key,)).groupBy(key, "kmer").agg(F.count("*").alias("n"))
    held = reads.select(key, "seq")
    long = held.groupBy(key).agg(F.sum(F.length("seq").cast("long")).alias("n")).where(F.col("n") > WHOLE).select(key)
    long = saved(long, "long-sequences")
    short = held if long.isEmpty() else held.join(long, held[key].eqNullSafe(long[key]), "left_anti")
    out = count(dealt_by(short, key))
    if not long.isEmpty():
        out = out.unionByName(count(held.join(long, held[key].eqNullSafe(long[key]), "left_semi")))
    return out.select(key, code.text("kmer").alias("kmer"), "n")


def valid_kmers(reads: DataFrame, k: int, q: int = 2) -> DataFrame:
    """KM2: windows of ACGT inside the ends of quality above q, with the chance that all their bases are right.

    Bases and qualities are cut into the same chunks, so that a window drags no more of its read along than its chunk.
    """
    bad = "[!-" + "".join("\\" + c if c in "[]\\^-" else c for c in chr(33 + q)) + "]*"
    first, last = F.length(F.regexp_extract("qual", "^" + bad, 0)), F.length("qual") - F.length(F.regexp_extract("qual", bad + "$", 0))
    whole = reads.select("read_id", first.alias("a"), last.alias("b"), F.posexplode(F.arrays_zip(chunks("seq", k).alias("s"), chunks("qual", k).alias("q"))).alias("n", "c"))
    held = whole.where(F.length("c.s") >= k).select("read_id", "a", "b", "n", F.col("c.s").alias("seq"), qualities("c.q").alias("phred"))
    rows = held.select("*", F.explode(F.expr(f"sequence(0, length(seq) - {k})")).alias("i")).withColumn("start", F.col("n") * CHUNK + F.col("i"))
    rows = rows.where((F.col("start") >= F.col("a")) & (F.col("start") + k <= F.col("b"))).select("read_id", (F.col("start") + 1).alias("at"), F.expr(f"substring(seq, i + 1, {k})").alias("kmer"), F.slice("phred", F.col("i") + 1, k).alias("quals"))
    right = F.aggregate("quals", F.lit(1.0), lambda acc, x: acc * (1 - F.pow(F.lit(10.0), -x / 10.0)))
    return rows.where(~F.col("kmer").rlike("[^ACGT]")).select("read_id", "at", "kmer", right.alias("correct"), "quals")


def kmer_set(reads: DataFrame, k: int = 21, packed: bool = False, spread: bool = False) -> DataFrame:
    """KM3: distinct k-mers of both strands: distinct once as the smaller of both, then turned."""
    code = codec(k)
    one = code.rows(reads, k, spread=spread).select(F.least("kmer", "rc").alias("kmer")).distinct()
    both = one.withColumn("rc", code.rc("kmer")).select(F.explode(F.when(F.col("kmer") == F.col("rc"), F.array("kmer")).otherwise(F.array("kmer", "rc"))).alias("kmer"))
    return both if packed else both.select(code.text("kmer").alias("kmer"))


def kmer_counts(reads: DataFrame, k: int, keys: tuple[str, ...] = (), packed: bool = False, spread: bool = False) -> DataFrame:
    """KM4: counts of canonical k-mers, the smaller of a window of ACGT and its reverse complement."""
    code = codec(k)
    counts = code.rows(reads, k, keys, spread=spread).select(*keys, F.least("kmer", "rc").alias("kmer")).groupBy(*keys, "kmer").agg(F.count("*").alias("n"))
    return counts if packed else counts.select(*keys, code.text("kmer").alias("kmer"), "n")


def window_counts(reads: DataFrame, k: int) -> DataFrame:
    """Counts of canonical windows of any letters, as strings."""
    raw = kmers(reads, k).groupBy("kmer").agg(F.count("*").alias("n"))
    return raw.groupBy(canonical("kmer").alias("kmer")).agg(F.sum("n").alias("n"))


#: Registers of a sketch, as a power of two: a standard error of 1.04 / sqrt(2 ** 14), 0.8 %.
REGISTERS = 14
#: Bases up to which k-mers (4 ** 12 at most) are made distinct before they are sketched.
FEW = 12


def kmer_sketches(reads: DataFrame, k: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """KM5: keys, sketch: a mergeable sketch of the distinct canonical k-mers of each library, to be stored and united later."""
    rows = codec(k).rows(reads, k, keys).select(*keys, F.least("kmer", "rc").alias("kmer"))
    return sketches_of(rows.distinct() if k <= FEW else rows, keys)


def sketches_of(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """KM5: keys, sketch of canonical k-mers (keys, kmer), which may repeat: a sketch of the distinct ones is the same."""
    return rows.groupBy(*keys).agg(F.hll_sketch_agg("kmer", REGISTERS).alias("sketch"))


def unite_sketches(sketches: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """KM5: keys, sketch of what any of several sketches holds, the same as one sketch of all reads."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def sketch_cardinality(sketches: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """KM5: keys, estimate of the distinct k-mers, and an upper bound of 1.1 times that."""
    held = unite_sketches(sketches, keys).select(*keys, F.hll_sketch_estimate("sketch").alias("estimate"))
    return held.withColumn("upper", F.ceil(F.col("estimate") * 1.1))


def kmer_cardinality(reads: DataFrame, k: int) -> DataFrame:
    """KM5: estimate and upper bound for one library that isn't kept."""
    return sketch_cardinality(kmer_sketches(reads, k))


def kmer_counts_capped(reads: DataFrame, k: int, most: int) -> DataFrame:
    """KM6: counts that saturate."""
    return kmer_counts(reads, k).withColumn("n", F.least("n", F.lit(most)))


def coverage_histogram(counts: DataFrame, singletons: bool = True) -> DataFrame:
    """KM7: how many k-mers have each multiplicity."""
    return (counts if singletons else counts.where("n > 1")).groupBy("n").agg(F.count("*").alias("n_kmers"))


def kmer_quality_stats(valid: DataFrame, most: int = 63) -> DataFrame:
    """KM8: kmer, n, chance that every occurrence is wrong, and by position summed qualities that saturate."""
    basic = valid.groupBy("kmer").agg(F.count("*").alias("n"), F.exp(F.sum(F.log(F.greatest(1 - F.col("correct"), F.lit(1e-300))))).alias("total_qual"))
    by_pos = valid.select("kmer", F.posexplode("quals").alias("i", "q")).groupBy("kmer", "i").agg(F.least(F.sum("q"), F.lit(most)).alias("q"))
    quals = by_pos.groupBy("kmer").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "q"))), lambda x: x["q"]).alias("quals"))
    return basic.join(quals, "kmer")


#: Stretches, at most, that k-mers of a block agree on.
AGREE = 4
#: K-mers of a block from which on it is split again; k-mers that a cluster may have; from what share of that on it takes none but small ones, and how small.
BLOCK, CLUSTER, LARGE, SMALL = 50, 2500, 0.75, 50


def _blocks(rows: DataFrame, code: Packed, families: list, block: int, tau: int) -> tuple[DataFrame, DataFrame]:
    """rows (kmer, key) dealt to blocks of k-mers that agree at one family's positions: the pairs (kmer, kmer2) of up to tau apart within
    blocks of up to `block`, and the rows (kmer, key) of the others.

    Both are written at once, so that a row is shuffled once for each family: blocks are counted, joined and told apart where they are."""
    parts = F.array(*(F.struct(F.lit(i).alias("b"), code.part("kmer", p).alias("s")) for i, p in enumerate(families)))
    keyed = rows.select("kmer", "key", F.explode(parts).alias("x")).select("kmer", F.xxhash64("key", "x.b", "x.s").alias("key"))
    sized = dealt_by_rows(keyed, rows.count() * len(families), "key").withColumn("n", F.count("*").over(Window.partitionBy("key")))
    few = sized.where(F.col("n").between(2, block)).select("key", "kmer")
    near = (F.col("kmer") < F.col("kmer2")) & (code.distance("kmer", "kmer2") <= tau)
    pairs = few.join(few.withColumnRenamed("kmer", "kmer2"), "key").where(near).select("kmer", "kmer2", F.lit(None).cast("long").alias("key"))
    many = sized.where(F.col("n") > block).select("kmer", F.lit(None).cast(dict(rows.dtypes)["kmer"]).alias("kmer2"), "key")
    both = saved(pairs.union(many), "kmer-blocks")
    return both.where("kmer2 is not null").select("kmer", "kmer2"), both.where("kmer2 is null").select("kmer", "key")


def hamming_candidates(kmer_rows: DataFrame, tau: int, k: int, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """KM9: pairs (kmer, kmer2) and links (a, b) of distinct k-mers (numbers up to 31 bases) at a distance of tau or less.

    Of tau + 2 stretches such k-mers agree on two, of tau + 3 on three: as many as it takes that random k-mers fill no block. Blocks
    that agree on these are compared pair by pair; larger ones are split by strides first, of tau + 1 of which k-mers agree on one. What
    is in a large block still, low complexity, is linked without pairs: k-mers that agree outside of any tau positions are linked to the
    smallest of them.
    """
    code, rows = codec(k), kmer_rows.count()
    agree = next((a for a in range(2, AGREE) if 4 ** (a * k // (a + tau)) * block >= rows), AGREE)
    cuts = [i * k // (agree + tau) for i in range(agree + tau + 1)]
    stretches = [range(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    start = kmer_rows.select("kmer", F.lit(0).cast("long").alias("key"))
    few, many = _blocks(start, code, [[i for x in some for i in x] for some in combinations(stretches, agree)], block, tau)
    fewer, rest = _blocks(many, code, [range(i, k, tau + 1) for i in range(tau + 1)], block, tau)
    pairs = few.union(fewer).distinct()
    places = [[i for i in range(k) if i not in gone] for gone in combinations(range(k), tau)]
    alone = F.array(*(F.struct(F.lit(i).alias("b"), code.part("kmer", p).alias("s")) for i, p in enumerate(places)))
    alike = rest.select("kmer").distinct().select("kmer", F.explode(alone).alias("x"))  # 4 ** tau k-mers a key at most
    least = alike.groupBy("x").agg(F.min("kmer").alias("a"), F.collect_list("kmer").alias("all")).where(F.size("all") > 1)
    links = least.select("a", F.explode("all").alias("b")).where("a <> b").distinct()
    return pairs, links


def hamming_clusters(kmer_rows: DataFrame, tau: int, k: int, block: int = BLOCK, limit: int = CLUSTER) -> DataFrame:
    """KM9: kmer, component of k-mers joined by a Hamming distance of tau or less, none of more than `limit` k-mers.

    Components within the limit are whole. A larger one is put together anew, nearest k-mers first, as far as the limit lets it
    (see capped_clusters). k-mers may be strings or, up to 31 bases, numbers.
    """
    code, text = codec(k), dict(kmer_rows.dtypes)["kmer"] == "string"
    rows = saved(kmer_rows.select((code.of_text("kmer") if text else F.col("kmer")).alias("kmer")).distinct(), "kmers")
    pairs, alike = hamming_candidates(rows, tau, k, block)
    links = saved(pairs.select(F.col("kmer").alias("a"), F.col("kmer2").alias("b")).union(alike).distinct().withColumn("d", code.distance("a", "b")), "kmer-links")
    held = capped_clusters(rows, links, limit)
    return held.select(code.text("kmer").alias("kmer"), code.text("component").alias("component")) if text else held


def capped_clusters(nodes: DataFrame, links: DataFrame, limit: int = CLUSTER) -> DataFrame:
    """kmer, component of distinct nodes (kmer): components of links (a, b, d), but for those of more than `limit` nodes.

    In these, clusters that may unite do so in rounds, beginning with single nodes: half of the clusters, chosen by a hash for each
    round, take in those of the other half that are nearest to them, in the order of distance, as long as both together stay within the
    limit and, where one has more than LARGE of it, the other has SMALL nodes at most. It ends when no two linked clusters may unite.
    """
    linked = components(links.select("a", "b"), "kmer-clusters").select(F.col("node").alias("kmer"), "component")
    plain = saved(linked, "clusters-plain")  # a node without links is a cluster of one and joins at the end
    named = lambda held: nodes.join(held, "kmer", "left").select("kmer", F.coalesce("component", "kmer").alias("component"))
    over = plain.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("component")
    wide = saved(plain.join(over, "component", "left_semi").select("kmer", F.col("kmer").alias("cluster")), "clusters-wide")
    if wide.isEmpty():
        return named(plain)
    edges = saved(links.join(wide.select(F.col("kmer").alias("a")), "a", "left_semi").select(F.col("a").alias("x"), F.col("b").alias("y"), "d"), "clusters-edges")
    labels, step = wide, 0
    while True:
        size = saved(labels.groupBy("cluster").agg(F.count("*").alias("n")), f"clusters-sizes-{step}")
        both = edges.join(size.select(F.col("cluster").alias("x"), F.col("n").alias("nx")), "x").join(size.select(F.col("cluster").alias("y"), F.col("n").alias("ny")), "y")
        fits = lambda a, b: (a + b <= limit) & ~((a > LARGE * limit) & (b > SMALL)) & ~((b > LARGE * limit) & (a > SMALL))
        open_ = saved(both.where(fits(F.col("nx"), F.col("ny"))), f"clusters-open-{step}")
        if open_.isEmpty():
            break
        head = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(step)), F.lit(2)) == 0  # noqa: B023, E731
        way = lambda x, y: open_.where(head(x) & ~head(y)).select(F.col(x).alias("head"), F.col(y).alias("tail"), "d", F.col(f"n{x}").alias("nh"), F.col(f"n{y}").alias("nt"))  # noqa: B023, E731
        asks = way("x", "y").union(way("y", "x")).groupBy("tail").agg(F.min(F.struct("d", "head", "nh", "nt")).alias("m")).select("tail", "m.*")
        order = Window.partitionBy("head").orderBy("d", "tail").rowsBetween(Window.unboundedPreceding, -1)  # up to `limit` of them matter
        before = F.col("nh") + F.coalesce(F.sum("nt").over(order), F.lit(0))
        took = asks.withColumn("before", before).where(fits(F.col("before"), F.col("nt"))).select(F.col("tail").alias("cluster"), "head")
        took = saved(took, f"clusters-took-{step}")
        moved = lambda df, c: df.join(took.withColumnRenamed("cluster", c), c, "left").withColumn(c, F.coalesce("head", c)).drop("head")  # noqa: B023, E731
        new = saved(moved(labels, "cluster"), f"clusters-labels-{step}")
        less = saved(moved(moved(edges, "x"), "y").where("x <> y").groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min("d").alias("d")), f"clusters-edges-{step}")
        forget(size, open_, took, labels, edges)
        labels, edges, step = new, less, step + 1
    least = labels.groupBy("cluster").agg(F.min("kmer").alias("component"))
    capped = labels.join(least, "cluster").select("kmer", "component")
    return named(plain.join(over, "component", "left_anti").select("kmer", "component").unionByName(capped))


def hamming1_clusters(kmer_rows: DataFrame, k: int) -> DataFrame:
    """KM10: components of k-mers one substitution apart. K-mers that agree at all places but one, four at most, are linked to the least
    of them. The first links take each k-mer to the least k-mer near it only; what these leave apart is linked as whole components."""
    code, text = codec(k), dict(kmer_rows.dtypes)["kmer"] == "string"
    nodes = saved(kmer_rows.select((code.of_text("kmer") if text else F.col("kmer")).alias("kmer")).distinct(), "kmers")
    places = [[i for i in range(k) if i != gone] for gone in range(k)]
    agree = F.array(*(F.struct(F.lit(i).alias("b"), code.part("kmer", p).alias("s")) for i, p in enumerate(places)))

    def links(rows: DataFrame) -> DataFrame:
        """a, b: label and least label of rows (kmer, label) that agree at all places but one."""
        near = rows.select("label", F.explode(agree).alias("x")).groupBy("x").agg(F.collect_set("label").alias("all")).where(F.size("all") > 1)
        return near.select(F.explode("all").alias("a"), F.array_min("all").alias("b")).where("a <> b")

    nearest = links(nodes.withColumn("label", F.col("kmer"))).groupBy("a").agg(F.min("b").alias("b"))
    first = saved(_with_singles(nodes, nearest).withColumnRenamed("component", "label"), "kmer-labels")
    found = components(links(first).distinct(), "kmer-clusters").select(F.col("node").alias("label"), "component")
    held = first.join(found, "label", "left").select("kmer", F.coalesce("component", "label").alias("component"))
    return held.select(code.text("kmer").alias("kmer"), code.text("component").alias("component")) if text else held


def _with_singles(kmer_rows: DataFrame, edges: DataFrame) -> DataFrame:
    found = components(edges, "kmer-clusters")
    return kmer_rows.select("kmer").distinct().join(found.withColumnRenamed("node", "kmer"), "kmer", "left").select("kmer", F.coalesce("component", "kmer").alias("component"))


def cluster_centre(clusters: DataFrame, stats: DataFrame, singleton: float = 0.995, other: float = 0.9) -> DataFrame:
    """KM11: component, centre (the most frequent k-mer), size, and whether its quality passes the limit of its size."""
    held = clusters.join(stats, "kmer").groupBy("component").agg(F.max(F.struct("n", F.col("kmer"), "quality")).alias("c"), F.count("*").alias("size"))
    limit = F.when(F.col("size") == 1, singleton).otherwise(other)
    return held.select("component", F.col("c.kmer").alias("centre"), "size", (F.col("c.quality") > limit).alias("good"))


def expand_solid(reads: DataFrame, solid: DataFrame, k: int, max_iter: int = 25) -> DataFrame:
    """KM12: solid k-mers, grown by all k-mers of reads whose bases solid k-mers cover, until no more come."""
    rows = saved(with_windows(reads.select("read_id", "seq", F.length("seq").alias("len")), k, ("read_id", "len"), at="i"), "solid-rows")
    good = saved(solid.select("kmer").distinct(), "solid-0")
    order = Window.partitionBy("read_id").orderBy("i")
    for step in range(1, max_iter + 1):
        hit = rows.join(good, "kmer", "left_semi").withColumn("next", F.lead("i").over(order)).withColumn("before", F.lag("i").over(order))
        broken = F.col("before").isNull() & (F.col("i") > 0) | F.coalesce(F.col("next") - F.col("i") > k, F.col("i") + k < F.col("len"))
        whole = hit.groupBy("read_id").agg(F.max(broken.cast("int")).alias("broken")).where("broken = 0")
        more = rows.join(whole, "read_id", "left_semi").select("kmer").distinct().join(good, "kmer", "left_anti")
        more = saved(more, f"solid-more-{step}")
        if more.isEmpty():
            break
        grown = saved(good.union(more), f"solid-{step}")
        forget(good, more)
        good = grown
    return good


def multi_sample_counts(counts: DataFrame, min_samples: int, min_mult: int = 5) -> DataFrame:
    """KM13: rows (kmer, sample, n) of k-mers in min_samples or more, and in several samples or more than min_mult times."""
    keep = counts.groupBy("kmer").agg(F.count_distinct("sample").alias("s"), F.sum("n").alias("total")).where((F.col("s") >= min_samples) & ((F.col("s") > 1) | (F.col("total") > min_mult)))
    return counts.join(keep.select("kmer"), "kmer", "left_semi")


def _known(contigs: DataFrame, profiles: DataFrame, k: int, min_length: int) -> tuple[DataFrame, DataFrame]:
    """profiles hold k-mers as kmer_counts(..., packed=True) gives them."""
    rows = codec(k).rows(contigs.where(F.length("seq") >= min_length), k, ("contig",)).select("contig", F.least("kmer", "rc").alias("kmer"))
    profiles = saved(profiles, "profiles")  # counted once, and read for what is known, for the samples and for the counts
    seen = profiles.select("kmer").distinct()
    known = rows.join(seen, "kmer", "left_semi")
    share = rows.groupBy("contig").agg(F.count("*").alias("all")).join(known.groupBy("contig").agg(F.count("*").alias("known")), "contig", "left")
    grid = known.join(profiles.select("sample").distinct().withColumn("x", F.lit(1)), F.lit(True))
    values = grid.join(profiles, ["kmer", "sample"], "left").select("contig", "sample", F.coalesce("n", F.lit(0)).alias("v"))
    return saved(values, "known-counts"), share


def contig_abundance(contigs: DataFrame, profiles: DataFrame, k: int, min_length: int = 0, min_share: float = 0.0, clip: float = 0.05) -> DataFrame:
    """KM14: by contig and sample the mean and variance of the counts of its known k-mers, clipped at both tails; null below min_share known."""
    values, share = _known(contigs, profiles, k, min_length)
    per = values.groupBy("contig", "sample", "v").agg(F.count("*").alias("w"))
    order = Window.partitionBy("contig", "sample").orderBy("v")
    held = per.withColumn("upto", F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("w").over(Window.partitionBy("contig", "sample")))
    cut = F.ceil(F.col("n") * clip)
    low, high = F.least(cut, F.col("n") - 1), F.greatest(F.col("n") - 1 - cut, F.lit(0))
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col("v")))
    edge = held.groupBy("contig", "sample").agg(at(low).alias("lo"), at(high).alias("hi"))
    fixed = per.join(edge, ["contig", "sample"]).withColumn("c", F.least(F.greatest("v", "lo"), "hi"))
    mean = fixed.groupBy("contig", "sample").agg((F.sum(F.col("c") * F.col("w")) / F.sum("w")).alias("mean"), (F.sum(F.col("c") * F.col("c") * F.col("w")) / F.sum("w")).alias("sq"))
    ok = F.coalesce("known", F.lit(0)) >= min_share * F.col("all")
    return mean.join(share, "contig").select("contig", "sample", F.when(ok, F.col("mean")).alias("abundance"), F.when(ok, F.col("sq") - F.col("mean") * F.col("mean")).alias("variance"))


def contig_abundance_median(contigs: DataFrame, profiles: DataFrame, k: int) -> DataFrame:
    """KM15: upper median of the counts of known k-mers, and the upper median of their distances to it."""
    values, _ = _known(contigs, profiles, k, 0)
    nth = F.row_number().over(Window.partitionBy("contig", "sample").orderBy("v"))
    of = F.count("*").over(Window.partitionBy("contig", "sample"))
    middle = values.withColumn("nth", nth).withColumn("of", of).where(F.col("nth") == F.floor(F.col("of") / 2) + 1).select("contig", "sample", F.col("v").alias("median"))
    away = values.join(middle, ["contig", "sample"]).withColumn("v", F.abs(F.col("v") - F.col("median")))
    mad = away.withColumn("nth", nth).withColumn("of", of).where(F.col("nth") == F.floor(F.col("of") / 2) + 1).select("contig", "sample", "median", F.col("v").alias("mad"))
    return mad


def two_class_threshold(values: DataFrame, key: str, value: str) -> DataFrame:
    """KM16: by key the split of sorted values that maximises the sum over both sides of sum^2 (1 + 2 ln(count + 1)) / count, the last of equals; a side of up to 3 counts 0."""
    per = values.groupBy(key, F.col(value).alias("split")).agg(F.count("*").alias("w"), F.sum(value).alias("s"))
    upto = Window.partitionBy(key).orderBy("split").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)
    held = per.select(key, "split", F.sum("w").over(upto).alias("lw"), F.sum("s").over(upto).alias("ls"), F.sum("w").over(whole).alias("tw"), F.sum("s").over(whole).alias("ts"))
    gain = lambda s, w: F.when(w > 3, s * s * (1 + 2 * F.log(w + 1)) / w).otherwise(0.0)
    score = gain(F.col("ls"), F.col("lw")) + gain(F.col("ts") - F.col("ls"), F.col("tw") - F.col("lw"))
    return held.groupBy(key).agg(F.max(F.struct(score.alias("score"), F.col("split"))).alias("b")).select(key, "b.split", "b.score")


def cluster_quality(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """KM17: by class of k-mers (class, kmer, quality) the share in the reference, and mean, median, variance and tails of quality."""
    seen = reference.select("kmer").distinct().withColumn("there", F.lit(1))
    held = rows.join(seen, "kmer", "left")
    tails = F.percentile("quality", F.array(*map(F.lit, (0.001, 0.01, 0.99, 0.999))))
    return held.groupBy("class").agg(F.count("*").alias("n"), F.avg(F.coalesce("there", F.lit(0))).alias("share"), F.avg("quality").alias("mean"), F.percentile("quality", 0.5).alias("median"), F.var_pop("quality").alias("variance"), tails.alias("t")).select(
        "class", "n", "share", "mean", "median", "variance", *(F.col("t")[i].alias(n) for i, n in enumerate(("q0_1", "q1", "q99", "q99_9")))
    )
