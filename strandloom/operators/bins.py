"""Binning of multi-sample assemblies (BN1-BN20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def bin_profiles(profiles: DataFrame, bins: DataFrame) -> DataFrame:
    """BN1: median abundance of each bin by sample."""
    return profiles.join(bins, "contig").groupBy("bin", "sample").agg(F.percentile("abundance", 0.5).alias("abundance"))


def choose_bins(bins: DataFrame, lengths: DataFrame, min_len: int) -> DataFrame:
    """BN2: bins whose largest total length over groups (contig, grp, length) exceeds min_len."""
    per = bins.join(lengths, "contig").groupBy("bin", "grp").agg(F.sum("length").alias("total"))
    return per.groupBy("bin").agg(F.max("total").alias("length")).where(F.col("length") > min_len)


def choose_samples(profile: DataFrame, min_sample: float = 4, min_total: float = 1, exclude: DataFrame | None = None) -> DataFrame:
    """BN3: samples of each bin by falling weight, of at least min_sample; bins listed or below min_total are flagged."""
    total = F.sum("abundance").over(Window.partitionBy("bin"))
    rank = F.row_number().over(Window.partitionBy("bin").orderBy(F.desc("abundance"), "sample"))
    out = profile.withColumn("excluded", total < min_total).where(F.col("abundance") >= min_sample).withColumn("rank", rank)
    if exclude is not None:
        listed = F.broadcast(exclude.select("bin").distinct().withColumn("listed", F.lit(True)))
        out = out.join(listed, "bin", "left").withColumn("excluded", F.col("excluded") | F.coalesce("listed", F.lit(False))).drop("listed")
    return out


def colour_edges(maps: DataFrame, bins: DataFrame, edges: DataFrame, share: float = 0.3) -> DataFrame:
    """BN4: edge, bin: length mapped by contigs (contig, edge, mapped) of the bin over the edge's length (edge, len), from `share` up."""
    per = maps.join(bins, "contig").groupBy("edge", "bin").agg(F.sum("mapped").alias("mapped"))
    return per.join(edges.select("edge", "len"), "edge").withColumn("share", F.col("mapped") / F.col("len")).where(F.col("share") >= share).select("edge", "bin", "share")


def contig_bins(paths: DataFrame, coloured: DataFrame, least_mapped: float = 0.9, share: float = 0.3) -> DataFrame:
    """BN5: bins of contigs by the coloured length of their edges (contig, edge, mapped_share, len), from `share` of the whole."""
    use = paths.where(F.col("mapped_share") >= least_mapped)
    whole = use.groupBy("contig").agg(F.sum("len").alias("total"))
    per = use.join(coloured.select("edge", "bin").distinct(), "edge").groupBy("contig", "bin").agg(F.sum("len").alias("coloured"))
    return per.join(whole, "contig").where(F.col("coloured") >= share * F.col("total")).select("contig", "bin")


def edges_of_bin(coloured: DataFrame, edges: DataFrame, min_length: int = 0) -> DataFrame:
    """BN6: edges of every bin that are at least min_length long."""
    return coloured.join(edges.where(F.col("len") >= min_length).select("edge", "len"), "edge").select("bin", "edge", "len").distinct()


def relevant_bins(paths: DataFrame, coloured: DataFrame) -> DataFrame:
    """BN6: the sorted bins of each path's edges."""
    return paths.select("contig", "edge").join(coloured.select("edge", "bin"), "edge").groupBy("contig").agg(F.array_join(F.sort_array(F.collect_set("bin")), " ").alias("bins"))


def filter_interesting(bins: DataFrame, interesting: DataFrame) -> DataFrame:
    """BN6: only the bins of interest."""
    return bins.join(interesting.select("bin").distinct(), "bin", "left_semi")


def bin_reads(mates: DataFrame, coloured: DataFrame) -> DataFrame:
    """BN7: pairs (pair, edge) and every bin that one of their mates touches."""
    return mates.select("pair", "edge").join(coloured.select("edge", "bin").distinct(), "edge").select("pair", "bin").distinct()


def glue_splits(splits: DataFrame) -> DataFrame:
    """BN8: the bin of most splits (contig, split, bin) of each contig; of equals the first by name."""
    per = splits.groupBy("contig", "bin").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("contig").orderBy(F.desc("n"), "bin"))
    return per.withColumn("nth", nth).where("nth = 1").select("contig", "bin")


def binning_stats(path: DataFrame) -> DataFrame:
    """BN9: edges and lengths of a reference path (edge, len, pre_binned, binned): total, binned, unbinned (distinct), pre-binned, propagated."""
    kinds = {"total": F.lit(True), "binned": F.col("binned"), "pre_binned": F.col("pre_binned"), "propagated": F.col("binned") & ~F.col("pre_binned")}
    aggs = [x for k, c in kinds.items() for x in (F.count_if(c).alias(f"{k}_edges"), F.coalesce(F.sum(F.when(c, F.col("len"))), F.lit(0)).alias(f"{k}_length"))]
    loose = path.where("not binned").select("edge", "len").distinct().agg(F.count("*").alias("unbinned_edges"), F.coalesce(F.sum("len"), F.lit(0)).alias("unbinned_length"))
    return path.agg(*aggs).join(F.broadcast(loose))


def best_matches(fractions: DataFrame, least: float = 0.01) -> DataFrame:
    """BN10: the best reference of each bin and the best bin of each reference (bin, ref, fraction); rows and columns of almost nothing are left out."""
    big = lambda c: fractions.groupBy(c).agg(F.sum("fraction").alias("s")).where(F.col("s") > least).select(c)
    held = fractions.join(big("bin"), "bin", "left_semi").join(big("ref"), "ref", "left_semi")
    a = held.groupBy("bin").agg(F.max(F.struct("fraction", "ref")).alias("m")).select(F.lit("bin").alias("kind"), F.col("bin").alias("name"), F.col("m.ref").alias("best"), F.col("m.fraction").alias("fraction"))
    b = held.groupBy("ref").agg(F.max(F.struct("fraction", "bin")).alias("m")).select(F.lit("ref").alias("kind"), F.col("ref").alias("name"), F.col("m.bin").alias("best"), F.col("m.fraction").alias("fraction"))
    return a.unionByName(b)


def purity(aligned: DataFrame, totals: DataFrame) -> DataFrame:
    """BN11: percent of each bin's length that its best reference holds."""
    best = aligned.groupBy("bin").agg(F.max("aligned").alias("aligned"))
    return best.join(totals, "bin").select("bin", (100 * F.col("aligned") / F.col("total")).alias("purity"))


def problem_report(fractions: DataFrame, fractured: float = 90, part: float = 5) -> DataFrame:
    """BN12: each reference as missing, underassembled, fractured or fine, with the bins that hold more than `part` of it, and
    whether its best bin mixes references. fractions: bin, ref, fraction in percent."""
    per = fractions.groupBy("ref").agg(F.sum("fraction").alias("total"), F.max("fraction").alias("best"), F.count_if(F.col("fraction") > part).alias("n_bins"), F.max(F.struct("fraction", "bin"))["bin"].alias("bin"))
    mixed = fractions.where(F.col("fraction") > part).groupBy("bin").agg(F.count("*").alias("n_refs"))
    state = F.when(F.col("total") <= part, "missing").when(F.col("total") < fractured, "underassembled").when(F.col("best") < fractured, "fractured").otherwise("fine")
    return per.join(mixed, "bin", "left").select("ref", state.alias("state"), "n_bins", (F.coalesce("n_refs", F.lit(0)) > 1).alias("mixture"))


def summary_table(metrics: DataFrame, runs: list[str]) -> DataFrame:
    """BN13: metric by run: (metric, run, value) to one column a run."""
    return metrics.groupBy("metric").pivot("run", runs).agg(F.first("value"))


def profile_transform(profiles: DataFrame, small: float = 1 / 2000) -> DataFrame:
    """BN14: log of abundances plus `small`, normalised by sample and then by contig."""
    x = profiles.withColumn("x", F.col("abundance") + small)
    x = x.withColumn("x", F.col("x") / F.sum("x").over(Window.partitionBy("sample")))
    return x.withColumn("value", F.log(F.col("x") / F.sum("x").over(Window.partitionBy("contig")))).drop("x")


def unique_profiles(profiles: DataFrame) -> DataFrame:
    """BN14: how many different profiles there are."""
    whole = profiles.groupBy("contig").agg(F.sort_array(F.collect_list(F.struct("sample", "abundance"))).alias("p"))
    return whole.agg(F.count_distinct("p").alias("n_profiles"))


def bin_means(values: DataFrame, bins: DataFrame) -> DataFrame:
    """BN14: mean of the transformed values of each bin by sample."""
    return values.join(bins, "contig").groupBy("bin", "sample").agg(F.avg("value").alias("mean"))


def parse_binning(lines: DataFrame, sep: str = ",", keep: str | None = None) -> DataFrame:
    """BN15: contig and `BIN<n>` out of lines `contig,bin`; keep: a pattern of bins."""
    parts = F.split("value", sep)
    out = lines.select(F.trim(parts[0]).alias("contig"), F.concat(F.lit("BIN"), F.regexp_extract(F.element_at(parts, -1), "([0-9]+)\\s*$", 1)).alias("bin")).where(F.col("bin") != "BIN")
    return out if keep is None else out.where(F.col("bin").rlike(keep))


def regression_compare(expected: DataFrame, actual: DataFrame, keys: list[str], tolerance: float = 10) -> DataFrame:
    """BN16: cells (keys, value) that differ: from 95 up must stay there, to 5 must stay there, others may move by `tolerance`."""
    both = expected.withColumnRenamed("value", "expected").join(actual.withColumnRenamed("value", "actual"), keys, "full")
    e, a = F.col("expected"), F.col("actual")
    ok = F.when(e.isNull() | a.isNull(), False).when(e >= 95, a >= 95).when(e <= 5, a <= 5).otherwise(F.abs(e - a) <= tolerance)
    return both.where(~ok)


def combine_profiles(groups: dict[str, DataFrame]) -> DataFrame:
    """BN17: profiles of several groups, contigs named `group-contig`."""
    out = None
    for name, df in groups.items():
        part = df.withColumn("contig", F.concat(F.lit(f"{name}-"), "contig"))
        out = part if out is None else out.unionByName(part)
    return out


def profile_layout(profiles: DataFrame, samples: list[str]) -> DataFrame:
    """BN18: one row a contig: total depth and, by sample, abundance and variance columns."""
    aggs = [x for s in samples for x in (F.max(F.when(F.col("sample") == s, F.col("abundance"))).alias(f"{s}_cov"), F.max(F.when(F.col("sample") == s, F.col("variance"))).alias(f"{s}_var"))]
    return profiles.groupBy("contig").agg(F.sum("abundance").alias("total_depth"), *aggs)


def assign_groups(samples: DataFrame, groups: dict[str, list[str]], parts: int = 0) -> DataFrame:
    """BN19: listed samples to their groups; the rest into `parts` groups of equal size by name, or each alone."""
    rows = [(g, s) for g, members in groups.items() for s in members]
    listed = samples.sparkSession.createDataFrame(rows, "grp string, sample string")
    named = samples.select("sample").join(F.broadcast(listed), "sample")
    rest = samples.select("sample").join(F.broadcast(listed), "sample", "left_anti")
    if parts:  # as many rows as there are samples
        name: Column = F.concat(F.lit("part"), F.ntile(parts).over(Window.orderBy("sample")).cast("string"))
    else:
        name = F.col("sample")
    return named.select("sample", "grp").unionByName(rest.select("sample", name.alias("grp")))


def reassembly_cutoff(coverage: Column, read_length: Column, k_from: int, k_to: int, share: float = 0.3) -> Column:
    """BN20: share * coverage * (RL - k_to) / (RL - k_from)."""
    return share * coverage * (read_length - k_to) / (read_length - k_from)
