"""Breakpoints that lie closer than chance, and the chains they form (CH1-CH11)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.intervals import sessions
from strandloom.plans.tables import components


def break_frequency(breaks: DataFrame, contigs: DataFrame) -> DataFrame:
    """CH1: p = breaks / samples / length of each chromosome (chrom, length)."""
    samples = breaks.agg(F.count_distinct("sample").alias("n_samples"))
    counts = breaks.groupBy("chrom").agg(F.count("*").alias("n_breaks"))
    return counts.join(F.broadcast(samples)).join(contigs, "chrom").select("chrom", "n_breaks", (F.col("n_breaks") / F.col("n_samples") / F.col("length")).alias("p"))


def gap_pvalue(distance, p) -> Column:
    """CH2: chance of at least one break within a distance."""
    return 1 - F.pow(1 - p, distance)


def gap_bound(p_val: float | Column, p: Column) -> Column:
    """The distance at which gap_pvalue reaches p_val."""
    limit = F.lit(p_val) if isinstance(p_val, float) else p_val
    return F.log(1 - limit) / F.log(1 - p)


def neighbour_edges(breaks: DataFrame, frequency: DataFrame, p_val: float) -> DataFrame:
    """CH3: pairs of positions (pos1 < pos2) of a sample and chromosome closer than chance allows.

    A range join by buckets as wide as the largest gap of the chromosome: a position meets its own bucket and the next.
    """
    bound = frequency.select("chrom", gap_bound(p_val, F.col("p")).alias("bound"))
    rows = breaks.select("sample", "chrom", "pos").distinct().join(F.broadcast(bound), "chrom").withColumn("bucket", F.floor(F.col("pos") / F.greatest(F.col("bound"), F.lit(1.0))))
    left = rows.select("sample", "chrom", F.col("pos").alias("pos1"), "bound", F.explode(F.array("bucket", F.col("bucket") + 1)).alias("bucket"))
    right = rows.select("sample", "chrom", F.col("pos").alias("pos2"), "bucket")
    gap = F.col("pos2") - F.col("pos1")
    return left.join(right, ["sample", "chrom", "bucket"]).where((gap > 0) & (gap < F.col("bound"))).select("sample", "chrom", "pos1", "pos2")


def local_clusters(breaks: DataFrame, frequency: DataFrame, p_val: float) -> DataFrame:
    """CH4: the components of CH3 on a line: positions whose gap to the one before is below the bound share a cluster."""
    bound = frequency.select("chrom", gap_bound(p_val, F.col("p")).alias("bound"))
    rows = breaks.select("sample", "chrom", "pos").distinct().join(F.broadcast(bound), "chrom")
    return sessions(rows, ["sample", "chrom"], "pos", F.col("pos") - F.col("prev") >= F.col("bound"), "cluster").drop("bound")


def chains(sv: DataFrame, clusters: DataFrame) -> DataFrame:
    """CH5: sample, chrom, pos, cluster, chain: clusters of a sample joined by its variants (chrom, pos) - (chrom2, pos2)."""
    named = clusters.withColumn("node", F.concat_ws("|", "sample", "chrom", F.lpad(F.col("cluster").cast("string"), 9, "0")))
    side = lambda n, c, p: named.select("sample", F.col("chrom").alias(c), F.col("pos").alias(p), F.col("node").alias(n))
    edges = sv.join(side("a", "chrom", "pos"), ["sample", "chrom", "pos"]).join(side("b", "chrom2", "pos2"), ["sample", "chrom2", "pos2"]).select("a", "b")
    found = components(edges, "chains")
    return named.join(found, "node", "left").select("sample", "chrom", "pos", "cluster", F.coalesce("component", "node").alias("chain"))


def chain_size_filter(chain_rows: DataFrame, breaks: int = 20) -> DataFrame:
    """CH6: rows of chains with at least so many breakpoints."""
    keep = chain_rows.groupBy("chain").agg(F.count("*").alias("n")).where(F.col("n") >= breaks).select("chain")
    return chain_rows.join(keep, "chain", "left_semi")


def cluster_stats(clusters: DataFrame) -> DataFrame:
    """CH7: size, break count, median spacing and the positions of each cluster."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("sample", "chrom", "cluster").orderBy("pos")
    held = clusters.withColumn("spacing", F.col("pos") - F.lag("pos").over(order))
    return held.groupBy("sample", "chrom", "cluster").agg(
        F.count("*").alias("n_breaks"),
        (F.max("pos") - F.min("pos")).alias("size"),
        F.percentile("spacing", 0.5).alias("median_spacing"),
        F.array_join(F.transform(F.sort_array(F.collect_list("pos")), lambda x: x.cast("string")), ",").alias("positions"),
    )


def log_gamma(x: Column) -> Column:
    """ln gamma(x) for x >= 1: Stirling's series from x + 8 on, and the steps back; good to 1e-11."""
    steps = x
    for i in range(1, 8):
        steps = steps * (x + i)
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(steps)


def cluster_nbinom_p(stats: DataFrame, frequency: DataFrame) -> DataFrame:
    """CH8: probability that the n-th break comes after `size` bases: the negative binomial mass of size - n failures."""
    n, p = F.col("n_breaks").cast("double"), F.col("p")
    k = F.greatest(F.col("size") - n, F.lit(0.0))
    mass = F.exp(log_gamma(k + n) - log_gamma(k + 1) - log_gamma(n) + n * F.log(p) + k * F.log1p(-p))
    return stats.join(F.broadcast(frequency.select("chrom", "p")), "chrom").withColumn("nbinom_p", mass).drop("p")


def p_value_sweep(breaks: DataFrame, frequency: DataFrame, lower: float, upper: float, steps: int) -> DataFrame:
    """CH9: clusters and clustered breaks by sample for each of `steps` thresholds."""
    at = [lower + (upper - lower) * i / max(steps - 1, 1) for i in range(steps)]
    rows = breaks.select("sample", "chrom", "pos").distinct().withColumn("p_val", F.explode(F.array(*map(F.lit, at))))
    rows = rows.join(F.broadcast(frequency.select("chrom", "p")), "chrom").withColumn("bound", gap_bound(F.col("p_val"), F.col("p")))
    held = sessions(rows, ["p_val", "sample", "chrom"], "pos", F.col("pos") - F.col("prev") >= F.col("bound"), "cluster")
    per = held.groupBy("p_val", "sample", "chrom", "cluster").agg(F.count("*").alias("n"))
    return per.groupBy("p_val", "sample").agg(F.count("*").alias("n_clusters"), F.max("n").alias("largest"))


def unique_chain_svs(sv: DataFrame, chain_rows: DataFrame) -> DataFrame:
    """CH10: distinct variants whose first break lies in a kept chain."""
    keep = chain_rows.select("sample", "chrom", "pos").distinct()
    return sv.select("sample", "chrom", "pos", "chrom2", "pos2").distinct().join(keep, ["sample", "chrom", "pos"], "left_semi")


def chain_group_compare(samples: DataFrame, chain_rows: DataFrame) -> DataFrame:
    """CH11: chains of every sample (sample, cohort), 0 where it has none."""
    per = chain_rows.groupBy("sample").agg(F.count_distinct("chain").alias("n"))
    return samples.join(per, "sample", "left").select("sample", "cohort", F.coalesce("n", F.lit(0)).alias("n_chains"))
