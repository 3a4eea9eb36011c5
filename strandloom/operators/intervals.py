"""Intervals and ordered values: range joins by buckets, merging, sessions, weighted quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.plans.tables import saved


def overlap_dealt(df: DataFrame, a: str, b: str, width: int) -> DataFrame:
    """df once for each bucket of `width` that its interval (a, b) touches."""
    last = F.floor((F.greatest(F.col(b), F.col(a) + 1) - 1) / width)
    return df.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(a) / width), last)))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: int, how: str = "inner") -> DataFrame:
    """Pairs of left (start, end) and right (r_start, r_end), half-open, that overlap within equal keys.

    Intervals are dealt to buckets of `width` and joined on (keys, bucket); a pair is kept in the one bucket where the later of
    the two starts lies. how: inner, or left_semi and left_anti for rows of left.
    """

    dealt = lambda df, a, b: overlap_dealt(df, a, b, width)
    hit = (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end"))
    if how == "inner":
        both = dealt(left, "start", "end").join(dealt(right, "r_start", "r_end"), [*keys, "bucket"])
        return both.where(hit & (F.floor(F.greatest("start", "r_start") / width) == F.col("bucket"))).drop("bucket")
    met = dealt(left, "start", "end").join(dealt(right.select(*keys, "r_start", "r_end"), "r_start", "r_end"), [*keys, "bucket"]).where(hit)
    # equal rows overlap alike, so a row is told by all its values
    found = met.select(*(F.col(c).alias(f"met_{i}") for i, c in enumerate(left.columns))).distinct()
    same = [left[c].eqNullSafe(found[f"met_{i}"]) for i, c in enumerate(left.columns)]
    return left.join(found, same, how)


def islands(df: DataFrame, keys: list[str], gap: int = 0, start: str = "start", end: str = "end") -> DataFrame:
    """df with an island number: an interval joins the island before it if it starts at most `gap` after that one's largest end."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0)
    return df.withColumn("is_new", new).withColumn("island", F.sum("is_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("is_new")


def merge_intervals(df: DataFrame, keys: list[str], gap: int = 0) -> DataFrame:
    """AL3: keys, start, end, members of merged intervals that overlap or touch (or lie within `gap`)."""
    return islands(df, keys, gap).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("members")).drop("island")


def sessions(df: DataFrame, keys: list[str], value: str, is_break: Column, name: str = "session", tie: list[str] | None = None) -> DataFrame:
    """df with a running number that grows where is_break holds; is_break may use F.lag over the given order through `prev`."""
    order = Window.partitionBy(*keys).orderBy(value, *(tie or []))
    held = df.withColumn("prev", F.lag(value).over(order)).withColumn("is_new", F.when(F.col("prev").isNull() | is_break, 1).otherwise(0))
    return held.withColumn(name, F.sum("is_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("prev", "is_new")


def weighted_points(df: DataFrame, keys: list[str], value: str, weight: str, fractions: list[float], descending: bool = False) -> DataFrame:
    """keys, fraction, value: the first value, in order, at which the cumulative weight reaches fraction * total.

    Values are dealt to ranges, so a key may have any number of them: the sums of the ranges tell in which one a fraction is
    reached, and only that one is put in order."""
    order = [*keys, F.desc(value) if descending else F.asc(value)]
    points = df.groupBy(*keys, value).agg(F.sum(weight).alias("w"))
    dealt = saved(points.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()), "weighted-points")
    # a row for each key of a range: what lies before it, and the ranges that reach a fraction
    sums = dealt.groupBy(*keys, "part_").agg(F.sum("w").alias("sum_"))
    of = Window.partitionBy(*keys)
    upto = F.sum("sum_").over(of.orderBy("part_").rowsBetween(Window.unboundedPreceding, 0))
    share = F.explode(F.array(*(F.lit(float(f)) for f in fractions)))
    ranges = sums.withColumn("upto_", upto).withColumn("total", F.sum("sum_").over(of)).withColumn("fraction", share).where(F.col("upto_") >= F.col("fraction") * F.col("total"))
    first = ranges.groupBy(*keys, "fraction").agg(F.min(F.struct("part_", (F.col("upto_") - F.col("sum_")).alias("before_"), "total")).alias("r"))
    first = first.select(*(F.col(k).alias(f"of_{i}") for i, k in enumerate(keys)), "fraction", F.col("r.part_").alias("range_"), "r.before_", "r.total")
    same = [F.col("part_") == F.col("range_"), *(F.col(k).eqNullSafe(F.col(f"of_{i}")) for i, k in enumerate(keys))]
    met = dealt.join(first, same)
    one = Window.partitionBy(*keys, "part_", "fraction").orderBy(F.desc(value) if descending else F.asc(value))
    held = met.withColumn("upto", F.col("before_") + F.sum("w").over(one.rowsBetween(Window.unboundedPreceding, 0)))
    end = F.max(value) if descending else F.min(value)
    return held.where(F.col("upto") >= F.col("fraction") * F.col("total")).groupBy(*keys, "fraction").agg(end.alias(value))


def upper_median(values: Column) -> Column:
    """sorted[n / 2] of an array: the upper of the two middle values."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))
