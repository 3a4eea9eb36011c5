"""Distances between paired reads, and the links they make (PI1-PI10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions.seq import revcomp
from strandloom.operators.intervals import weighted_points
from strandloom.plans.tables import dealt_by_rows, saved


def insert_size_histogram(mates: DataFrame, lengths: DataFrame, min_edge_len: int = 0) -> DataFrame:
    """PI1: insert sizes start2 - start1 + mapped2 of pairs whose mates lie on one edge of min_edge_len and more: insert_size, n."""
    side = lambda m, s: mates.where(F.col("mate") == m).select("pair", "edge", F.col("e_start").alias(f"start{s}"), F.col("mapped").alias(f"len{s}"))
    both = side(0, 1).join(side(1, 2), ["pair", "edge"]).join(lengths.where(F.col("len") >= min_edge_len).select("edge"), "edge", "left_semi")
    return both.groupBy((F.col("start2") - F.col("start1") + F.col("len2")).alias("insert_size")).agg(F.count("*").alias("n"))


def insert_size_counters(hist: DataFrame) -> DataFrame:
    """PI1: pairs in all, and those of a negative insert size."""
    return hist.agg(F.sum("n").alias("mapped"), F.coalesce(F.sum(F.when(F.col("insert_size") < 0, F.col("n"))), F.lit(0)).alias("negative"))


def _one(hist: DataFrame, fractions: list[float]) -> DataFrame:
    return weighted_points(hist.withColumn("g", F.lit(0)), ["g"], "insert_size", "n", fractions)


def median_mad(hist: DataFrame) -> DataFrame:
    """PI2: weighted median of a histogram, and of the distances to it; distances on both sides are summed."""
    median = _one(hist, [0.5]).select(F.col("insert_size").alias("median"))
    away = hist.join(F.broadcast(median)).groupBy(F.abs(F.col("insert_size") - F.col("median")).alias("insert_size")).agg(F.sum("n").alias("n"))
    return median.join(F.broadcast(_one(away, [0.5]).select(F.col("insert_size").alias("mad"))))


def crop(hist: DataFrame, width: float = 5.0) -> DataFrame:
    """PI2: the histogram within `width` robust deviations (1.4826 MAD) of its median."""
    held = hist.join(F.broadcast(median_mad(hist)))
    return held.where(F.abs(F.col("insert_size") - F.col("median")) <= width * 1.4826 * F.col("mad")).select("insert_size", "n")


def mean_sd_percentiles(hist: DataFrame, percents=range(5, 100, 5)) -> DataFrame:
    """PI3: mean, deviation and percentiles of the histogram, cropped by MAD and then by five deviations: percent, value, mean, sd."""
    first = crop(hist)
    moments = lambda h: h.agg((F.sum(F.col("insert_size") * F.col("n")) / F.sum("n")).alias("mean"), F.sqrt(F.sum(F.col("insert_size") ** 2 * F.col("n")) / F.sum("n") - (F.sum(F.col("insert_size") * F.col("n")) / F.sum("n")) ** 2).alias("sd"))
    cut = first.join(F.broadcast(moments(first))).where(F.abs(F.col("insert_size") - F.col("mean")) <= 5 * F.col("sd")).select("insert_size", "n")
    points = _one(cut, [p / 100 for p in percents])
    return points.select(F.round(F.col("fraction") * 100).cast("int").alias("percent"), F.col("insert_size").alias("value")).join(F.broadcast(moments(cut)))


def insert_size_interval(hist: DataFrame, quantile: float) -> DataFrame:
    """PI4: low and high end of the middle `quantile` of the histogram."""
    a, b = (1 - quantile) / 2, 1 - (1 - quantile) / 2
    return _one(hist, [a, b]).agg(F.min("insert_size").alias("low"), F.max("insert_size").alias("high"))


def pair_info(mates: DataFrame, weight: str = "one", step: int = 1) -> DataFrame:
    """PI5: (e1, e2, d, w) over all edges of the two mates of a pair; weight: one, or product of the mapped lengths; d rounded to `step`.

    The rows of mates are counted first, and pairs and points dealt to as many tasks as they need."""
    rows = mates.count()
    side = lambda m, s: dealt_by_rows(mates.where(F.col("mate") == m).select("pair", F.col("edge").alias(f"e{s}"), F.col("e_start").alias(f"s{s}"), F.col("mapped").alias(f"m{s}")), rows, "pair")
    both = side(0, 1).join(side(1, 2), "pair")
    w = F.lit(1.0) if weight == "one" else (F.col("m1") * F.col("m2")).cast("double")
    d = (F.round((F.col("s2") - F.col("s1")) / step) * step).cast("long")
    return dealt_by_rows(both.select("e1", "e2", d.alias("d"), w.alias("w")), rows, "e1", "e2", "d").groupBy("e1", "e2", "d").agg(F.sum("w").alias("w"))


def cluster_distances(points: DataFrame, linkage: int) -> DataFrame:
    """PI6: distances of an edge pair at most `linkage` apart as one: centre by weight, weight, half width.

    The points are written, counted, and dealt to as many tasks as they need."""
    points = saved(points, "points")
    points = dealt_by_rows(points, points.count(), "e1", "e2")
    order = Window.partitionBy("e1", "e2").orderBy("d")
    new = F.lag("d").over(order).isNull() | (F.col("d") - F.lag("d").over(order) > linkage)
    held = points.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return held.groupBy("e1", "e2", "run").agg((F.sum(F.col("d") * F.col("w")) / F.sum("w")).alias("d"), F.sum("w").alias("w"), ((F.max("d") - F.min("d")) / 2).alias("half_width")).drop("run")


def snap_to_path_distances(points: DataFrame, candidates: DataFrame, max_distance: float) -> DataFrame:
    """PI7: points moved to the nearest candidate distance (e1, e2, path_d) within max_distance; ties share the weight."""
    both = points.join(candidates.distinct(), ["e1", "e2"]).withColumn("gap", F.abs(F.col("d") - F.col("path_d"))).where(F.col("gap") <= max_distance)
    one = Window.partitionBy("e1", "e2", "d")
    near = both.withColumn("rank", F.rank().over(one.orderBy("gap"))).where("rank = 1").withColumn("ties", F.count("*").over(one))
    return near.groupBy("e1", "e2", F.col("path_d").alias("d")).agg(F.sum(F.col("w") / F.col("ties")).alias("w"))


def filter_pair_info(points: DataFrame, min_weight: float) -> DataFrame:
    """PI8: points of a weight of at least min_weight."""
    return points.where(F.col("w") >= min_weight)


def filter_by_coverage(points: DataFrame, coverage: DataFrame, min_weight: float, share: float = 0.1) -> DataFrame:
    """PI8: points of a weight of at least min_weight, or of at least `share` of the coverage (edge, coverage) of either edge."""
    cov = lambda e: coverage.select(F.col("edge").alias(e), F.col("coverage").alias(f"c_{e}"))
    both = points.join(cov("e1"), "e1", "left").join(cov("e2"), "e2", "left")
    enough = lambda e: F.coalesce(F.col("w") >= share * F.col(e), F.lit(False))
    return both.where((F.col("w") >= min_weight) | enough("c_e1") | enough("c_e2")).select("e1", "e2", "d", "w")


def scaffold_links(points: DataFrame, min_reads: float, low: float, high: float, edges: DataFrame | None = None) -> DataFrame:
    """PI9: edge pairs whose weight within the distance window is at least min_reads; not an edge with itself.

    With edges (edge, len, conjugate) the window lies from `low` to `high` around the length of the first edge, and an edge isn't
    linked with its own conjugate, the other strand of itself.
    """
    use = points.where(F.col("e1") != F.col("e2"))
    if edges is None:
        use = use.where(F.col("d").between(low, high))
    else:
        known = edges.select(F.col("edge").alias("e1"), "len", "conjugate")
        use = use.join(known, "e1").where((F.col("e2") != F.col("conjugate")) & F.col("d").between(F.col("len") + low, F.col("len") + high))
    return use.groupBy("e1", "e2").agg(F.sum("w").alias("w")).where(F.col("w") >= min_reads)


def both_strands(links: DataFrame, edges: DataFrame) -> DataFrame:
    """PI9: links (e1, e2, w) told once for both strands: a link from e1 to e2 is one from e2's conjugate to e1's; the larger weight holds."""
    other = lambda e: edges.select(F.col("edge").alias(e), F.col("conjugate").alias(f"c_{e}"))
    held = links.join(other("e1"), "e1").join(other("e2"), "e2")
    turned = F.struct(F.col("c_e2").alias("e1"), F.col("c_e1").alias("e2"))
    return held.select(F.least(F.struct("e1", "e2"), turned).alias("l"), "w").groupBy("l").agg(F.max("w").alias("w")).select("l.e1", "l.e2", "w")


def gap_table(links: DataFrame) -> DataFrame:
    """PI10: left, right, gap, left_trim, right_trim, fill of links (left, left_offset, left_len, right, right_offset, right_len, read,
    seq_start, seq_end): left_offset bases of the left edge end at seq_start of the read, the right edge goes on at seq_end from its
    right_offset on; what lies between is the fill.

    Where the alignments overlap in the read, or leave nothing between them, the left edge's end moves back by the overlap and one
    base, so that the fill isn't empty, but at least one base of the edge stays; what remains of the overlap moves the right edge's
    begin on, up to its last base. Links that can't be mended so, and those whose offsets lie outside their edges, give no row.
    """
    inside = "left_offset > 0 and left_offset <= left_len and right_offset >= 0 and right_offset < right_len"
    over = lambda start: F.greatest(start - F.col("seq_end") + 1, F.lit(0))
    left = F.least(over(F.col("seq_start")), F.col("left_offset") - 1)
    held = links.where(inside).withColumn("start_", F.col("seq_start") - left).withColumn("left_", F.col("left_offset") - left)
    right = F.least(over(F.col("start_")), F.col("right_len") - F.col("right_offset") - 1)
    held = held.withColumn("end_", F.col("seq_end") + right).withColumn("right_", F.col("right_offset") + right)
    held = held.where("start_ >= 0 and end_ <= length(read) and start_ < end_")
    trims = [(F.col("left_len") - F.col("left_")).alias("left_trim"), F.col("right_").alias("right_trim")]
    return held.select("left", "right", (F.col("end_") - F.col("start_")).alias("gap"), *trims, F.expr("substring(read, cast(start_ + 1 as int), cast(end_ - start_ as int))").alias("fill"))


def gap_conjugates(gaps: DataFrame, edges: DataFrame) -> DataFrame:
    """PI10: the same gaps seen from the other strand, by edges (edge, conjugate)."""
    other = lambda e: edges.select(F.col("edge").alias(e), F.col("conjugate").alias(f"c_{e}"))
    held = gaps.join(other("left"), "left").join(other("right"), "right")
    return held.select(F.col("c_right").alias("left"), F.col("c_left").alias("right"), "gap", F.col("right_trim").alias("left_trim"), F.col("left_trim").alias("right_trim"), revcomp("fill").alias("fill"))
