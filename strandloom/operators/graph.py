"""Assembly-graph tables (GR1-GR24). Edges are rows; loops are joins, written to the shared folder each round."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions.packed import MOST, Packed, codec
from strandloom.functions.seq import base_count, hamming
from strandloom.operators.intervals import weighted_points
from strandloom.plans.tables import components, dealt_by_rows, forget, saved


def extension_masks(reads: DataFrame, k: int, spread: bool = False) -> DataFrame:
    """GR1: kmer (a number up to 30 bases) and the bases before and after it, from the (k+1)-mers of both strands: bits 0 to 3 of
    `mask` stand for A, C, G, T after the k-mer, bits 4 to 7 for those before."""
    code = codec(k, MOST - 1)
    one = code.rows(reads, k + 1, spread=spread).select(F.least("kmer", "rc").alias("kmer")).distinct()
    both = one.select(F.explode(F.array("kmer", code.rc("kmer", k + 1))).alias("w"))
    first, after, last, before = code.edge("w")
    ends = both.select(F.explode(F.array(F.struct(first.alias("kmer"), after.alias("bit")), F.struct(last.alias("kmer"), (before + 4).alias("bit")))).alias("x"))
    return ends.select("x.kmer", F.expr("shiftleft(1, x.bit)").alias("bit")).groupBy("kmer").agg(F.bit_or("bit").alias("mask"))


def _bases(mask: Column, shift: int) -> Column:
    return F.array_compact(F.array(*(F.when(mask.bitwiseAND(1 << (i + shift)) != 0, F.lit(c)) for i, c in enumerate("ACGT"))))


def extensions(reads: DataFrame, k: int) -> DataFrame:
    """GR1: kmer, outs, ins of each k-mer as letters; with dead ends and starts."""
    held = extension_masks(reads, k)
    held = held.select(codec(k, MOST - 1).text("kmer").alias("kmer"), _bases(F.col("mask"), 0).alias("outs"), _bases(F.col("mask"), 4).alias("ins"))
    return held.withColumn("dead_end", F.size("outs") == 0).withColumn("dead_start", F.size("ins") == 0).withColumn("unique", (F.size("outs") == 1) & (F.size("ins") == 1))


def condense(steps: DataFrame, name: str = "condense", conjugate: Callable[[str], Column] | None = None) -> DataFrame:
    """node, head, rank of the nodes of chains (a -> b, each a and b once): pointer doubling, log2 of the longest chain in rounds.

    A chain starts at a node that no step enters; on a cycle the smallest node does. With `conjugate` (the node on the other strand)
    cycles of both strands are cut at one place: before the smallest node of the two, and after it on the other strand.
    """
    conjugate = conjugate or F.col
    nodes = steps.select(F.col("a").alias("node")).union(steps.select(F.col("b").alias("node"))).distinct()
    first = nodes.join(steps.select(F.col("b").alias("node"), F.col("a").alias("to")), "node", "left")
    back = saved(first.select("node", "to", F.lit(1).cast("long").alias("rank"), F.when(F.col("node") <= conjugate("node"), F.col("node")).otherwise(conjugate("node")).alias("least"), F.col("to").isNotNull().alias("moved")), f"{name}-0")
    for r in range(1, max(1, back.count()).bit_length() + 2):
        if not back.where("moved").limit(1).count():
            break
        ahead = back.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("rank").alias("rank2"), F.col("least").alias("least2"))
        step = back.join(ahead, "to", "left")
        far = F.col("to2").isNotNull()
        new = step.select("node", F.when(far, F.col("to2")).otherwise(F.col("to")).alias("to"), F.when(far, F.col("rank") + F.col("rank2")).otherwise(F.col("rank")).alias("rank"), F.least("least", F.coalesce("least2", "least")).alias("least"), far.alias("moved"))
        new = saved(new, f"{name}-{r}")
        forget(back)
        back = new
    done = back.where("not moved").select("node", F.coalesce("to", "node").alias("head"), F.when(F.col("to").isNull(), 0).otherwise(F.col("rank")).alias("rank"))
    if not back.where("moved").limit(1).count():
        return done
    # pointers that still move run round cycles
    on = back.where("moved").select(F.col("node").alias("b"), "least").join(steps, "b")
    cut = saved(on.where((F.col("b") != F.col("least")) & ((conjugate("a") != F.col("least")) | (F.col("a") == F.col("least")))).select("a", "b"), f"{name}-cut")
    rest = condense(cut, f"{name}-cycles", conjugate)
    alone = on.select(F.col("b").alias("node")).join(rest.select("node"), "node", "left_anti")
    return done.unionByName(rest).unionByName(alone.select("node", F.col("node").alias("head"), F.lit(0).cast("long").alias("rank")))


def _masks(ext: DataFrame, code: Packed) -> DataFrame:
    """kmer, mask of what extensions() tells in letters."""
    bits = lambda c, shift: F.aggregate(c, F.lit(0), lambda acc, b: acc.bitwiseOR(F.pow(F.lit(2), F.instr(F.lit("ACGT"), b) - 1 + shift).cast("int")))
    return ext.select(code.of_text("kmer").alias("kmer"), bits("outs", 0).bitwiseOR(bits("ins", 4)).alias("mask"))


def unitigs(masks: DataFrame, k: int) -> DataFrame:
    """GR2: edge, conjugate, seq of maximal chains of k-mers (extension_masks, or extensions) with one way in and out between them, on both strands.

    An edge is named by its first k-mer, and `conjugate` names the edge that spells its reverse complement: the one that begins with
    the turned last k-mer, or the edge itself. A cycle begins where the smallest of its k-mers and their turns does.
    """
    code = codec(k, MOST - 1)
    masks = masks if "mask" in masks.columns else _masks(masks, code)
    base = F.expr("case mask & 15 when 1 then 0 when 2 then 1 when 4 then 2 else 3 end")
    one_out = masks.where("bit_count(mask & 15) = 1").select(F.col("kmer").alias("a"), code.after("kmer", base).alias("b"))
    one_in = masks.where("bit_count(mask & 240) = 1").select(F.col("kmer").alias("b"))
    steps = saved(one_out.join(one_in, "b").select("a", "b").where("a <> b"), "unitig-steps")
    held = condense(steps, "unitigs", code.rc)
    all_ = masks.select("kmer").join(held.withColumnRenamed("node", "kmer"), "kmer", "left").select("kmer", F.coalesce("head", "kmer").alias("edge"), F.coalesce("rank", F.lit(0)).alias("rank"))
    parts = all_.groupBy("edge").agg(F.sort_array(F.collect_list(F.struct("rank", code.last("kmer").alias("base")))).alias("p"), F.max_by("kmer", "rank").alias("end"))
    tail = F.array_join(F.transform(F.slice("p", 2, 1 << 30), lambda x: x["base"]), "")
    return parts.select("edge", code.rc("end").alias("conjugate"), F.concat(code.text("edge"), tail).alias("seq"))


def early_tip_clip(ext: DataFrame, k: int, bound: int) -> DataFrame:
    """GR3: k-mers without dead-end chains of at most `bound` k-mers that hang on a branching k-mer."""
    rows = saved(ext.select("kmer", "outs", "ins"), "tips")
    walk = rows.where((F.size("outs") == 0) & (F.size("ins") == 1)).select(F.col("kmer").alias("tip"), "kmer", "ins", F.array("kmer").alias("path"))
    lost = walk.select("kmer").limit(0)
    for _ in range(bound):
        if walk.isEmpty():
            break
        before = walk.select("tip", "path", F.concat(F.col("ins")[0], F.expr(f"left(kmer, {k - 1})")).alias("kmer"))
        met = saved(before.join(rows, "kmer"), "tips-step")
        ended = met.where(F.size("outs") > 1).select(F.explode("path").alias("kmer"))
        lost = lost.union(ended)
        walk = met.where((F.size("outs") == 1) & (F.size("ins") == 1) & (F.size("path") < bound)).select("tip", "kmer", "ins", F.concat("path", F.array("kmer")).alias("path"))
    return ext.join(lost.distinct(), "kmer", "left_anti")


def edge_coverage(edges: DataFrame, counts: DataFrame, k: int, flank: int) -> DataFrame:
    """GR4: edge, coverage (mean count of its k-mers, counted by kmer_counts(..., packed=True)) and flank_coverage (of the first `flank` of them)."""
    rows = codec(k).rows(edges, k, ("edge",), at="i").withColumn("kmer", F.least("kmer", "rc"))
    held = rows.join(counts, "kmer", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return held.groupBy("edge").agg(F.avg("n").alias("coverage"), F.avg(F.when(F.col("i") < flank, F.col("n"))).alias("flank_coverage"))


def average_coverage(edges: DataFrame) -> DataFrame:
    """GR5: coverage of the whole graph, by length."""
    return edges.agg((F.sum("raw_cov") / F.sum("len")).alias("avg_coverage"))


def cumulative_length(edges: DataFrame, min_length: int = 0) -> DataFrame:
    """GR5: total length of edges of min_length and more."""
    return edges.where(F.col("len") >= min_length).agg(F.sum("len").alias("total_length"))


def nx(edges: DataFrame, percent: float) -> DataFrame:
    """GR5: the length from which on edges, longest first, hold `percent` of the whole."""
    return weighted_points(edges.withColumn("g", F.lit(0)), ["g"], "len", "len", [percent / 100], descending=True).select(F.col("len").alias("nx"))


def median_coverage(edges: DataFrame, min_len: int = 0) -> DataFrame:
    """GR6: coverage at which half of the length is reached."""
    use = edges.where(F.col("len") >= min_len).withColumn("g", F.lit(0)).withColumn("cov", F.col("raw_cov") / F.col("len"))
    return weighted_points(use, ["g"], "cov", "len", [0.5]).select(F.col("cov").alias("median_coverage"))


def uniformity_fraction(edges: DataFrame, variation: float, min_len: int = 0) -> DataFrame:
    """GR6: share of the length whose coverage lies within `variation` of the median."""
    use = edges.where(F.col("len") >= min_len).withColumn("cov", F.col("raw_cov") / F.col("len")).join(F.broadcast(median_coverage(edges, min_len)))
    near = F.abs(F.col("cov") - F.col("median_coverage")) <= variation * F.col("median_coverage")
    return use.agg((F.sum(F.when(near, F.col("len")).otherwise(0)) / F.sum("len")).alias("uniformity"))


def numbered(rows: DataFrame, *order: Column, name: str = "id") -> DataFrame:
    """rows with their place in the given order, from 1: range-partitioned, numbered in each partition, and moved on by what lies before."""
    dealt = saved(rows.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy("part_").agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    nth = F.row_number().over(Window.partitionBy("part_").orderBy(*order))
    return dealt.join(F.broadcast(sizes.select("part_", before.alias("before_"))), "part_").withColumn(name, nth + F.col("before_")).drop("part_", "before_")


def graph_components(edges: DataFrame) -> DataFrame:
    """GR7: edge, component: weak components numbered by falling total length, then by smallest vertex; with edge counts.

    Where edges name their `conjugate`, both strands are one component: the way out of an edge and the way into its conjugate are one
    vertex seen from two sides. Lengths and counts are those of all edges of a component, both strands included.
    """
    links = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    if "conjugate" in edges.columns:
        other = edges.select(F.col("edge").alias("conjugate"), F.col("dst").alias("b"))
        links = links.union(edges.select("conjugate", F.col("src").alias("a")).join(other, "conjugate").select("a", "b"))
    found = components(links, "graph")
    held = edges.select("edge", "len", F.col("src").alias("node")).join(found, "node")
    per = held.groupBy("component").agg(F.sum("len").alias("total"), F.count("*").alias("n_edges"))
    named = numbered(per, F.desc("total"), F.col("component"))
    return held.join(named, "component").select("edge", F.col("id").alias("component"), "n_edges", "total")


def component_filter(rows: DataFrame, edges: DataFrame, min_vertices: int = 0, max_vertices: int | None = None, short: int | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """GR8: edges (edge, component) of components within the vertex range, with an edge of at most `short`, or with a wanted edge."""
    held = rows.select("edge", "component").join(edges.select("edge", "src", "dst", "len"), "edge")
    ends = held.select("component", F.explode(F.array("src", "dst")).alias("v")).groupBy("component").agg(F.count_distinct("v").alias("n"))
    keep = ends.where((F.col("n") >= min_vertices) & (F.lit(True) if max_vertices is None else F.col("n") <= max_vertices)).select("component")
    if short is not None:
        keep = keep.join(held.where(F.col("len") <= short).select("component"), "component", "left_semi")
    if wanted is not None:
        keep = keep.join(held.join(wanted.select("edge"), "edge", "left_semi").select("component"), "component", "left_semi")
    return rows.join(keep, "component", "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """GR9: edges with the in and out degrees of both ends, and what follows: tip, dead end, isolated, has alternatives, loop."""
    outs = edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("out"))
    ins = edges.groupBy(F.col("dst").alias("v")).agg(F.count("*").alias("in"))
    deg = outs.join(ins, "v", "full").select("v", F.coalesce("out", F.lit(0)).alias("out"), F.coalesce("in", F.lit(0)).alias("in"))
    at = lambda end, p: deg.select(F.col("v").alias(end), F.col("out").alias(f"{p}_out"), F.col("in").alias(f"{p}_in"))
    held = edges.join(at("src", "src"), "src").join(at("dst", "dst"), "dst")
    ends_here, starts_here = F.col("dst_out") == 0, F.col("src_in") == 0
    alone = starts_here & ends_here & (F.col("src_out") == 1) & (F.col("dst_in") == 1)
    tip = (ends_here & (F.col("dst_in") == 1) | starts_here & (F.col("src_out") == 1)) & ~alone
    return held.withColumn("tip", tip).withColumn("dead_end", ends_here | starts_here).withColumn("isolated", alone).withColumn("alternative", (F.col("src_out") > 1) & (F.col("dst_in") > 1)).withColumn("loop", F.col("src") == F.col("dst"))


def coverage_at_most(limit: float) -> Column:
    return F.col("raw_cov") / F.col("len") <= limit


def length_at_most(limit: int) -> Column:
    return F.col("len") <= limit


def relative_coverage_tips(edges: DataFrame, ratio: float) -> DataFrame:
    """GR10: tips that end (dst without way out) of a coverage of at most ratio * (largest coverage of an edge beside it + 1); loops don't compete."""
    cov = edges.withColumn("cov", F.col("raw_cov") / F.col("len"))
    rank = Window.partitionBy("src").orderBy(F.desc("cov"), "edge")
    best = cov.where("src <> dst").withColumn("nth", F.row_number().over(rank)).groupBy("src").agg(F.max(F.when(F.col("nth") == 1, F.struct("cov", "edge"))).alias("b1"), F.max(F.when(F.col("nth") == 2, F.col("cov"))).alias("c2"))
    tips = degrees(cov).where("tip and dst_out = 0").select("edge", "src", "cov").join(best, "src")
    rival = F.when(F.col("b1.edge") == F.col("edge"), F.col("c2")).otherwise(F.col("b1.cov"))
    return tips.where(F.col("cov") <= ratio * (rival + 1)).select("edge")


def mismatch_tips(edges: DataFrame, max_diff: int) -> DataFrame:
    """GR11: tips (src, dst, seq) within max_diff of the beginning of a longer edge from the same vertex."""
    tips = degrees(edges).where("tip and dst_out = 0").select("edge", "src", "seq")
    other = edges.select("src", F.col("edge").alias("edge2"), F.col("seq").alias("seq2"))
    both = tips.join(other, "src").where((F.col("edge") != F.col("edge2")) & (F.length("seq2") >= F.length("seq")))
    return both.where(hamming(F.col("seq"), F.expr("left(seq2, length(seq))")) <= max_diff).select("edge").distinct()


def low_complexity_edges(edges: DataFrame, max_share: float) -> DataFrame:
    """GR12: edges of which one base makes up more than max_share."""
    most = F.greatest(*(base_count("seq", b) for b in "ACGT"))
    return edges.where(most > max_share * F.length("seq")).select("edge")


def simplify_round(edges: DataFrame, drop: Column, iterations: int = 1) -> DataFrame:
    """GR13: edges (edge, src, dst, len, raw_cov) without those that `drop` holds for (over degrees()), then with vertices of one way in
    and out condensed: members, src, dst, len and raw_cov of each new edge, named by its smallest member; repeated."""
    for r in range(iterations):
        kept = degrees(edges).where(~F.coalesce(drop, F.lit(False))).select("edge", "src", "dst", "len", "raw_cov")
        kept = saved(kept, f"simplify-kept-{r}")
        through = kept.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("o"), F.min("edge").alias("b")).where("o = 1").join(kept.groupBy(F.col("dst").alias("v")).agg(F.count("*").alias("i"), F.min("edge").alias("a")).where("i = 1"), "v").where("a <> b").select("a", "b")
        held = condense(saved(through, f"simplify-steps-{r}"), f"simplify-{r}")
        named = kept.join(held.withColumnRenamed("node", "edge"), "edge", "left").withColumn("head", F.coalesce("head", "edge")).withColumn("rank", F.coalesce("rank", F.lit(0)))
        merged = named.groupBy("head").agg(F.min_by("src", "rank").alias("src"), F.max_by("dst", "rank").alias("dst"), F.sum("len").alias("len"), F.sum("raw_cov").alias("raw_cov"), F.min("edge").alias("edge"), F.count("*").alias("members"))
        edges = saved(merged.select("edge", "src", "dst", "len", "raw_cov", "members"), f"simplify-{r}-out")
    return edges


def erroneous_connection_threshold(edges: DataFrame, max_len: int, width: int | None = None) -> DataFrame:
    """GR14: threshold, avg_coverage, used: the coverage below which short edges with alternatives look wrong.

    The histogram has the whole coverages of edges of at most max_len that leave a vertex of two ways out or more and enter one of two
    ways in or more; a bulge of two edges alone is left out. Each value gets the sum of the next `width` counts, weighted by a triangle
    (1, 2, ... 2, 1); counts at or beyond the number of different coverages have no weight. The threshold is the first value at which
    half of the last `width` sums rose, and a tenth of the average coverage where there is none; `used` is not below the average.
    width: 0.3 times the average, and 5, unless given.
    """
    ways = degrees(edges).where((F.col("len") <= max_len) & (F.col("src_out") >= 2) & (F.col("dst_in") >= 2))
    twins = edges.groupBy("src", "dst").agg(F.count("*").alias("twins"))
    short = ways.join(twins, ["src", "dst"]).where("not (src_out = 2 and dst_in = 2 and twins = 2)")
    bins = short.groupBy(F.floor(F.col("raw_cov") / F.col("len")).alias("x")).agg(F.count("*").alias("n"))
    w = F.floor(0.3 * F.col("avg_coverage") + 5).cast("long") if width is None else F.lit(width).cast("long")
    facts = average_coverage(edges).join(bins.agg(F.count("*").alias("m"), (F.max("x") + 1).alias("size"))).withColumn("w", w)
    spread = bins.join(F.broadcast(facts.select("m", "w"))).where("x < m").select("n", "w", "x", F.explode(F.expr("sequence(0, w - 1)")).alias("i"))
    sums = spread.where("x >= i").groupBy((F.col("x") - F.col("i")).alias("v")).agg(F.sum(F.col("n") * F.least(F.col("i") + 1, F.col("w") - F.col("i"))).alias("s"))
    grid = facts.select("size", "w", F.explode(F.expr("sequence(0L, greatest(least(size, m + 1), 0L))")).alias("v"))  # beyond, no sum rises
    order = Window.orderBy("v")  # one row a coverage
    held = grid.join(sums, "v", "left").withColumn("s", F.coalesce("s", F.lit(0)))
    rose = held.withColumn("rose", (F.col("s") > F.lag("s").over(order)).cast("int")).withColumn("upto", F.sum(F.coalesce("rose", F.lit(0))).over(order))
    back = rose.select((F.col("v") + F.col("w")).alias("v"), F.col("upto").alias("gone"))
    cut = rose.join(back, "v", "left").where("v >= 1 and v + w < size and 2 * (upto - coalesce(gone, 0)) >= w").agg(F.min("v").alias("v"))
    threshold = F.coalesce(F.col("v").cast("double"), 0.1 * F.col("avg_coverage"))
    return average_coverage(edges).join(F.broadcast(cut)).select(threshold.alias("threshold"), "avg_coverage", F.greatest(threshold, "avg_coverage").alias("used"))


def expand_component(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """GR15: chosen edges and all that touch an inner vertex of theirs (one with chosen ways in and out)."""
    own = edges.join(chosen.select("edge"), "edge", "left_semi")
    inner = own.select(F.col("src").alias("v")).distinct().join(own.select(F.col("dst").alias("v")).distinct(), "v")
    more = edges.join(inner.withColumnRenamed("v", "src"), "src", "left_semi").unionByName(edges.join(inner.withColumnRenamed("v", "dst"), "dst", "left_semi"), allowMissingColumns=False)
    return own.select("edge").union(more.select("edge")).distinct()


def dead_ends(edges: DataFrame) -> DataFrame:
    """GR15: vertices without a way in or without a way out."""
    outs, ins = edges.select(F.col("src").alias("v")).distinct(), edges.select(F.col("dst").alias("v")).distinct()
    return outs.join(ins, "v", "left_anti").union(ins.join(outs, "v", "left_anti"))


def graph_stats(edges: DataFrame, covered: float = 30) -> DataFrame:
    """GR16: vertices, edges, length of edges covered above `covered`, isolated edges and loops."""
    held = degrees(edges)
    verts = edges.select(F.explode(F.array("src", "dst")).alias("v")).agg(F.count_distinct("v").alias("n_vertices"))
    stats = held.agg(F.count("*").alias("n_edges"), F.coalesce(F.sum(F.when(F.col("raw_cov") / F.col("len") > covered, F.col("len"))), F.lit(0)).alias("covered_length"), F.count_if("isolated").alias("n_isolated"), F.count_if("loop").alias("n_loops"))
    return verts.join(F.broadcast(stats))


def edges_off_paths(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """GR16: edges that are on none of the paths (path, edge)."""
    return edges.join(paths.select("edge"), "edge", "left_anti")


def kmer_edge_index(edges: DataFrame, k: int) -> DataFrame:
    """GR17: kmer (a number up to 31 bases), edge, offset of the k-mers that lie on one place only."""
    rows = codec(k).rows(edges, k, ("edge",), at="offset")
    return rows.groupBy("kmer").agg(F.count("*").alias("n"), F.min("edge").alias("edge"), F.min("offset").alias("offset")).where("n = 1").drop("n")


def map_reads(reads: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """GR17: read, edge, q_start, q_end, e_start, e_end, ord: ranges along which read and edge advance in step."""
    hits = codec(k).rows(reads, k, ("read",), at="i").select("read", "i", "kmer").join(index, "kmer")
    order = Window.partitionBy("read").orderBy("i")
    new = F.lag("edge").over(order).isNull() | (F.lag("edge").over(order) != F.col("edge")) | (F.lag(F.col("offset") - F.col("i")).over(order) != F.col("offset") - F.col("i")) | (F.lag("i").over(order) != F.col("i") - 1)
    held = hits.withColumn("new", new.cast("int")).withColumn("ord", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return held.groupBy("read", "ord").agg(F.first("edge").alias("edge"), F.min("i").alias("q_start"), (F.max("i") + k).alias("q_end"), F.min("offset").alias("e_start"), (F.max("offset") + k).alias("e_end"))


def edge_profiles(maps: DataFrame, edges: DataFrame) -> DataFrame:
    """GR18: mapped length over edge length for every edge and sample, 0 where there is none."""
    samples = maps.select("sample").distinct()
    per = maps.groupBy("edge", "sample").agg(F.sum(F.col("e_end") - F.col("e_start")).alias("mapped"))
    grid = edges.select("edge", "len").join(F.broadcast(samples))  # a row for each sample
    return grid.join(per, ["edge", "sample"], "left").select("edge", "sample", (F.coalesce("mapped", F.lit(0)) / F.col("len")).alias("profile"))


def strand_coverage(maps: DataFrame, edges: DataFrame, symmetric: bool = False) -> DataFrame:
    """GR19: mapped length over edge length by edge and strand; symmetric: both strands get all."""
    rows = maps.withColumn("strand", F.explode(F.array(F.lit("+"), F.lit("-")))) if symmetric else maps
    per = rows.groupBy("edge", "strand").agg(F.sum(F.col("e_end") - F.col("e_start")).alias("mapped"))
    return per.join(edges.select("edge", "len"), "edge").select("edge", "strand", (F.col("mapped") / F.col("len")).alias("coverage"))


def edge_quality(edges: DataFrame, reference: DataFrame, k: int) -> DataFrame:
    """GR20: k-mers of each edge that the reference holds on either strand, counted once a place of the reference."""
    code = codec(k)
    rows = code.rows(edges, k, ("edge",)).select("edge", F.least("kmer", "rc").alias("kmer"))
    asked = saved(rows.select("kmer").distinct(), "edge-kmers")  # written, so that its size is known: few are broadcast, and the reference isn't shuffled
    met = code.rows(reference, k).select(F.least("kmer", "rc").alias("kmer"), (F.col("kmer") == F.col("rc")).cast("long").alias("turn")).join(asked, "kmer", "left_semi")
    ref = met.groupBy("kmer").agg(F.sum(1 + F.col("turn")).alias("n"))
    hits = rows.join(ref, "kmer").groupBy("edge").agg(F.sum("n").alias("quality"))
    return edges.select("edge").join(hits, "edge", "left").select("edge", F.coalesce("quality", F.lit(0)).alias("quality"))


def unused_bridges(edges: DataFrame, used: DataFrame) -> DataFrame:
    """GR21: unused edges with used ones on both sides."""
    own = edges.join(used.select("edge"), "edge", "left_semi")
    rest = edges.join(used.select("edge"), "edge", "left_anti")
    return rest.join(own.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(own.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("edge")


def path_filter(paths: DataFrame, edges: DataFrame, min_length: int = 0, min_cov: float = 0.0, alone: int = 2) -> DataFrame:
    """GR22: paths (path, ord, edge) longer than min_length, with an edge covered above min_cov, and of more than `alone` isolated edges."""
    held = paths.join(degrees(edges).select("edge", "len", "raw_cov", "isolated"), "edge")
    keep = held.groupBy("path").agg(F.sum("len").alias("length"), F.max(F.col("raw_cov") / F.col("len")).alias("cov"), F.count("*").alias("n"), F.count_if("isolated").alias("iso"))
    keep = keep.where((F.col("length") > min_length) & (F.col("cov") > min_cov) & ~((F.col("n") <= alone) & (F.col("iso") == F.col("n"))))
    return paths.join(keep.select("path"), "path", "left_semi")


#: Fingerprints of edge sequences are polynomials over these fields, at these bases.
FIELDS = ((2147483647, 1_000_003), (2147483629, 998_244_353 % 2147483629))


def _power(base: int, exponent: Column, prime: int) -> Column:
    """base ** exponent modulo a prime below 2 ** 31, for exponents below 2 ** 24."""
    out, square = F.lit(1).cast("long"), base
    for b in range(24):
        out = out * F.when(exponent.bitwiseAND(F.lit(1 << b)) != 0, F.lit(square)).otherwise(F.lit(1)) % prime
        square = square * square % prime
    return out


def _path_sums(paths: DataFrame) -> DataFrame:
    """path, n, i, edge, b0, b1, s0, s1: sums of the terms of the edges before the i-th of each path, and with it."""
    order = Window.partitionBy("path").orderBy("ord", "edge")
    held = paths.select("path", "edge", F.row_number().over(order).cast("long").alias("i"), F.count("*").over(Window.partitionBy("path")).alias("n"))
    terms = [(F.pmod(F.xxhash64("edge", F.lit(f)), F.lit(p)) * _power(b, F.col("i"), p) % p).alias(f"t{f}") for f, (p, b) in enumerate(FIELDS)]
    upto = Window.partitionBy("path").orderBy("i")
    sums = held.select("path", "n", "i", "edge", *terms).select("*", *(F.sum(f"t{f}").over(upto).alias(f"s{f}") for f in (0, 1)))
    return sums.select("path", "n", "i", "edge", *((F.col(f"s{f}") - F.col(f"t{f}")).alias(f"b{f}") for f in (0, 1)), "s0", "s1")


def _prints(last: list[Column], before: list[Column], at: Column) -> list[Column]:
    """Fingerprints of stretches, whatever their place: sums from a place on, moved to the end of the range of places."""
    return [(F.pmod(s - b, F.lit(p)) * _power(base, F.lit((1 << 24) - 1) - at, p) % p).alias(f"f{f}") for f, ((p, base), s, b) in enumerate(zip(FIELDS, last, before, strict=True))]


def path_windows(sums: DataFrame) -> DataFrame:
    """n, f0, f1, longer, least of the stretches that begin with some path's first edge and are as long as it: whether a longer path
    holds them, and the smallest path that is no longer. One row for each different stretch, however often it comes."""
    asked = sums.where("i = 1").select("edge", F.col("n").alias("size")).distinct()
    begin = sums.select("path", "n", "i", "edge", "b0", "b1").join(asked, "edge").where("i + size - 1 <= n")
    ends = sums.select("path", F.col("i").alias("end"), "s0", "s1")
    both = begin.withColumn("end", F.col("i") + F.col("size") - 1).join(ends, ["path", "end"])
    each = both.select(F.col("size").alias("n"), F.col("n").alias("whole"), "path", *_prints([F.col("s0"), F.col("s1")], [F.col("b0"), F.col("b1")], F.col("i")))
    return each.groupBy("n", "f0", "f1").agg(F.max(F.col("whole") > F.col("n")).alias("longer"), F.min(F.when(F.col("whole") == F.col("n"), F.col("path"))).alias("least"))


def dedup_paths(paths: DataFrame) -> DataFrame:
    """GR22: without paths that equal another of smaller id or are part of a longer one. Paths have fewer than 2 ** 24 edges.

    Stretches of paths are named by rolling fingerprints (two of 31 bits over prime fields), so that a path meets one row, that of
    its own stretch, instead of all paths that hold its first edge.
    """
    sums = saved(_path_sums(paths), "path-sums")
    named = saved(path_windows(sums), "path-windows")
    zero = [F.lit(0).cast("long")] * 2
    whole = sums.where("i = n").select("path", "n", *_prints([F.col("s0"), F.col("s1")], zero, F.lit(1).cast("long")))
    gone = whole.join(named, ["n", "f0", "f1"]).where("longer or least < path")
    return paths.join(gone.select("path"), "path", "left_anti")


def merge_edge_positions(maps: DataFrame, max_gap: int, max_gap_diff: int) -> DataFrame:
    """GR23: by edge and read mapping ranges joined where both gaps to the one before are at most max_gap and differ by at most max_gap_diff.

    The rows of maps are counted first, and dealt to as many tasks as they need."""
    maps = dealt_by_rows(maps, maps.count(), "edge", "read")
    order = Window.partitionBy("edge", "read").orderBy("q_start", "q_end", "e_start", "e_end")
    q, e = F.col("q_start") - F.lag("q_end").over(order), F.col("e_start") - F.lag("e_end").over(order)
    new = q.isNull() | (q > max_gap) | (e > max_gap) | (F.abs(q - e) > max_gap_diff)
    held = maps.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return held.groupBy("edge", "read", "run").agg(F.min("q_start").alias("q_start"), F.max("q_end").alias("q_end"), F.min("e_start").alias("e_start"), F.max("e_end").alias("e_end")).drop("run")


def path_gaps(maps: DataFrame, lengths: DataFrame) -> DataFrame:
    """GR24: stretches of each read (read, length) that no mapping covers."""
    rows = maps.select("read", "q_start", "q_end").union(lengths.select("read", F.col("length"), F.col("length")))
    order = Window.partitionBy("read").orderBy("q_start", "q_end")
    upto = F.coalesce(F.max("q_end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("gap_start", upto).where(F.col("q_start") > F.col("gap_start")).select("read", "gap_start", F.col("q_start").alias("gap_end"))
