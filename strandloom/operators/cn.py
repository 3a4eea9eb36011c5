"""Coverage normalisation, segmentation and copy-number scores (CN1-CN15)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.operators.intervals import overlap_join

GC, MAP = (30, 60), (70, 101)


def genomic_median(cov: DataFrame, gc=GC, mappable=MAP) -> DataFrame:
    """CN1: the median coverage of bins of usual GC content and mappability, one row."""
    return cov.where(F.col("gc").between(*gc) & F.col("map").between(*mappable)).agg(F.percentile("coverage", 0.5).alias("genomic_median"))


def gc_map_matrix(cov: DataFrame, most: float = 1000, gc=GC, mappable=MAP) -> DataFrame:
    """CN2: by (gc, map) the median coverage minus the genomic median; cells of `most` and more are left out."""
    cells = cov.groupBy("gc", "map").agg(F.percentile("coverage", 0.5).alias("median")).where(F.col("median") < most)
    return cells.join(F.broadcast(genomic_median(cov, gc, mappable))).select("gc", "map", (F.col("median") - F.col("genomic_median")).alias("value"))


def smooth_matrix(cells: DataFrame, smooth: float = 5.0) -> DataFrame:
    """CN3: cells smoothed by multiquadric radial functions: (K + smooth I) w = value, read off at the cells.

    The grid has at most 101 x 101 cells, whatever the coverage's size, so it is solved in one task. Cells without a value take no
    part; where none has one (no bin gives a genomic median), there is nothing to smooth.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["gc", "map", "value"]).sort_values(["gc", "map"])
        if pdf.empty:
            return pdf.assign(smoothed=pdf["value"])[["gc", "map", "value", "smoothed"]]
        x = pdf[["gc", "map"]].to_numpy(float)
        gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        width = np.sqrt(np.prod(np.maximum(np.ptp(x, axis=0), 1)) / max(len(x), 1))
        kernel = np.sqrt((gap / width) ** 2 + 1)
        weight = np.linalg.lstsq(kernel - smooth * np.eye(len(x)), pdf["value"].to_numpy(float), rcond=None)[0]
        return pdf.assign(smoothed=kernel @ weight)[["gc", "map", "value", "smoothed"]]

    return cells.withColumn("grid", F.lit(0)).groupBy("grid").applyInPandas(solve, "gc int, map int, value double, smoothed double")


def normalise(cov: DataFrame, cells: DataFrame, value: str = "value") -> DataFrame:
    """CN4: coverage minus the value of its (gc, map) cell; 0 where there is no cell."""
    grid = F.broadcast(cells.select("gc", "map", F.col(value).alias("cell")))  # at most 101 x 101 rows
    return cov.join(grid, ["gc", "map"], "left").withColumn("normalised", F.when(F.col("cell").isNull(), 0.0).otherwise(F.col("coverage") - F.col("cell"))).drop("cell")


def haar_denoise(cov: DataFrame, keys: list[str], value: str = "coverage", level: int = 2) -> DataFrame:
    """CN5: Haar transform to `level`, soft threshold of the details by MAD / 0.6745 * sqrt(2 ln n), and back.

    An odd length is continued by its last value and cut again. Rows are numbered by `bin` within keys.
    """
    order = Window.partitionBy(*keys).orderBy("bin")
    whole = Window.partitionBy(*keys)
    rows = cov.select(*keys, "bin", F.col(value).cast("double").alias("x")).withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(whole))
    approx, details, root = rows.select(*keys, "i", "x", "n"), [], math.sqrt(2)
    for k in range(1, level + 1):
        pair = approx.groupBy(*keys, "n", F.floor(F.col("i") / 2).alias("j")).agg(F.min_by("x", "i").alias("a"), F.max_by("x", "i").alias("b"))
        details.append(pair.select(*keys, "j", ((F.col("a") - F.col("b")) / root).alias(f"d{k}")))
        approx = pair.select(*keys, F.col("j").alias("i"), ((F.col("a") + F.col("b")) / root).alias("x"), "n")
    middle = details[0].groupBy(*keys).agg(F.percentile("d1", 0.5).alias("centre"))
    sigma = details[0].join(middle, keys).groupBy(*keys).agg((F.percentile(F.abs(F.col("d1") - F.col("centre")), 0.5) / 0.6745).alias("sigma"))
    out = rows.join(sigma, keys).withColumn("limit", F.col("sigma") * F.sqrt(2 * F.log(F.col("n"))))
    out = out.withColumn("at", F.floor(F.col("i") / 2**level)).join(approx.select(*keys, F.col("i").alias("at"), F.col("x").alias("y")), [*keys, "at"]).drop("at")
    for k in range(level, 0, -1):
        d = details[k - 1].withColumnRenamed("j", "at")
        soft = F.signum(f"d{k}") * F.greatest(F.abs(f"d{k}") - F.col("limit"), F.lit(0.0))
        sign = F.when(F.floor(F.col("i") / 2 ** (k - 1)) % 2 == 0, 1).otherwise(-1)
        out = out.withColumn("at", F.floor(F.col("i") / 2**k)).join(d, [*keys, "at"]).withColumn("y", (F.col("y") + sign * soft) / root).drop("at", f"d{k}")
    return out.select(*keys, "bin", F.col("y").alias("denoised"))


def relative_cn(cov: DataFrame, pairs: DataFrame) -> DataFrame:
    """CN6: tumour minus paired normal (pairs: tumour, normal) in each bin."""
    side = lambda s: cov.select(F.col("sample").alias(s), "chrom", "bin", F.col("coverage").alias(f"{s}_coverage"))
    both = F.broadcast(pairs).join(side("tumour"), "tumour").join(side("normal"), ["normal", "chrom", "bin"])
    return both.select("tumour", "normal", "chrom", "bin", (F.col("tumour_coverage") - F.col("normal_coverage")).alias("relative"))


def winsorize(cov: DataFrame, keys: list[str], value: str = "coverage", width: float = 2.5) -> DataFrame:
    """CN7: values held within `width` robust deviations (1.4826 MAD) of the median of their keys."""
    middle = cov.groupBy(*keys).agg(F.percentile(value, 0.5).alias("centre"))
    mad = cov.join(middle, keys).groupBy(*keys, "centre").agg((1.4826 * F.percentile(F.abs(F.col(value) - F.col("centre")), 0.5)).alias("mad"))
    low, high = F.col("centre") - width * F.col("mad"), F.col("centre") + width * F.col("mad")
    return cov.join(mad, keys).withColumn("winsorized", F.least(F.greatest(F.col(value), low), high)).drop("centre", "mad")


class _Levels:
    """For every level that a segment could have, the start that is best for a segment which goes on: pieces of the range of levels
    between `edge`s, each with its start. A start without a piece can't win any more, whatever comes."""

    def __init__(self, low: float, high: float):
        self.edge, self.start = np.array([low, high]), np.zeros(1, int)
        self.empty = True

    def add(self, new: int, count, total, square):
        """A further start. count, total, square: of a start, how many values follow, their sum, and their squares with the cost before."""
        if self.empty:
            self.start, self.empty = np.array([new]), False
            return
        # where the old start of a piece is no worse than the new one: between the roots of an upward parabola
        a = count(self.start) - count(new)
        b = total(self.start) - total(new)
        c = square(self.start) - square(new)
        root = b * b - a * c
        slack = 1e-9 * (b * b + np.abs(a * c))
        wide = np.sqrt(np.maximum(root, 0.0))
        left = np.clip((b - wide) / a, self.edge[:-1], self.edge[1:])
        right = np.clip((b + wide) / a, self.edge[:-1], self.edge[1:])
        gone = (root < -slack) | (right <= left)
        left[gone] = right[gone] = self.edge[1:][gone]
        edge = np.empty(3 * len(self.start) + 1)
        edge[0], edge[1::3], edge[2::3], edge[3::3] = self.edge[0], left, right, self.edge[1:]
        start = np.empty(3 * len(self.start), int)
        start[0::3], start[1::3], start[2::3] = new, self.start, new
        keep = edge[1:] > edge[:-1]
        start = start[keep]
        edge = np.append(edge[:-1][keep], edge[-1])
        first = np.ones(len(start), bool)
        first[1:] = start[1:] != start[:-1]
        self.start, self.edge = start[first], np.append(edge[:-1][first], edge[-1])


def best_segments(y: np.ndarray, gamma: float, kmin: int) -> np.ndarray:
    """Starts of the segments of the least-squares fit with a penalty of gamma a segment and kmin values or more each.

    Exact, with pruning: of all starts only those stay that are best for some level of the segment, so an arm takes about as many steps
    as it has values, each over a few dozen starts, also where nothing changes. Of equal fits the earliest start is taken.
    """
    n = len(y)
    if n < kmin or not n:
        return np.array([0])
    y = y - y.mean()
    total, square = np.append(0, np.cumsum(y)), np.append(0, np.cumsum(y * y))
    cost, back = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    cost[0] = -gamma
    levels = _Levels(float(y.min()) - 1.0, float(y.max()) + 1.0)
    for e in range(kmin, n + 1):
        new = e - kmin
        if np.isfinite(cost[new]):
            levels.add(new, lambda s: e - s, lambda s: total[e] - total[s], lambda s: cost[s] + square[e] - square[s])  # noqa: B023
        s = np.unique(levels.start)
        fit = cost[s] + square[e] - square[s] - (total[e] - total[s]) ** 2 / (e - s) + gamma
        k = int(fit.argmin())
        cost[e], back[e] = fit[k], s[k]
    starts, e = [], n
    while e > 0:
        e = back[e]
        starts.append(e)
    return np.array(starts[::-1])


def pcf_segments(cov: DataFrame, gamma: float = 40.0, kmin: int = 5, value: str = "coverage", keys=("sample", "chrom", "arm")) -> DataFrame:
    """CN8: keys, bin, value, segment, fitted. The fit is sequential along an arm and parallel over arms."""
    kind = {f.name: f.dataType.simpleString() for f in cov.schema}
    schema = ", ".join(f"{k} {kind[k]}" for k in keys) + f", bin {kind['bin']}, value double, segment int, fitted double"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin").reset_index(drop=True)
        y = pdf[value].to_numpy(float)
        starts = best_segments(y, gamma, min(kmin, len(y)))
        segment = np.searchsorted(starts, np.arange(len(y)), "right")
        out = pdf[[*keys, "bin"]].assign(value=y, segment=segment.astype(np.int32))
        return out.assign(fitted=out.groupby("segment")["value"].transform("mean"))

    return cov.groupBy(*keys).applyInPandas(fit, schema)


def segment_rows(fitted: DataFrame, keys=("sample", "chrom", "arm")) -> DataFrame:
    """CN9: one row for each run of equal fitted values: start, end, n_probes, mean."""
    order = Window.partitionBy(*keys).orderBy("bin")
    new = F.when(F.lag("fitted").over(order).isNull() | (F.lag("fitted").over(order) != F.col("fitted")), 1).otherwise(0)
    held = fitted.withColumn("is_new", new).withColumn("run", F.sum("is_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return held.groupBy(*keys, "run").agg(F.min("bin").alias("start"), F.max("bin").alias("end"), F.count("*").alias("n_probes"), F.avg("value").alias("mean")).drop("run")


def pcf_score(segs: DataFrame) -> DataFrame:
    """CN10: sum of absolute segment means by sample and chromosome."""
    return segs.groupBy("sample", "chrom").agg(F.sum(F.abs("mean")).alias("score"))


def segment_count(segs: DataFrame, greyout: float) -> DataFrame:
    """CN11: segments whose mean is beyond the grey zone."""
    return segs.groupBy("sample", "chrom").agg(F.count_if(F.abs("mean") > greyout).alias("n_segments"))


def low_pass(cov: DataFrame, keys: list[str], half_width: int = 5, value: str = "coverage") -> DataFrame:
    """CN12: centred moving mean of up to 2 * half_width + 1 bins."""
    frame = Window.partitionBy(*keys).orderBy("bin").rowsBetween(-half_width, half_width)
    return cov.select(*keys, "bin", F.avg(value).over(frame).alias("signal"))


def lowpass_score(signal: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """CN13: sum of the differences between neighbouring peaks and troughs that exceed `least`, rounded."""
    order = Window.partitionBy(*keys).orderBy("bin")
    before, after = F.lag("signal").over(order), F.lead("signal").over(order)
    turn = ((F.col("signal") > before) & (F.col("signal") > after)) | ((F.col("signal") < before) & (F.col("signal") < after))
    peaks = signal.withColumn("turn", turn).where("turn").withColumn("step", F.abs(F.col("signal") - F.lag("signal").over(order)))
    return peaks.groupBy(*keys).agg(F.round(F.sum(F.when(F.col("step") > least, F.col("step")).otherwise(0.0)), 6).alias("score"))


def gain_loss(segs: DataFrame, t: float = 0.05) -> DataFrame:
    """CN14: segments by state, by sample."""
    state = F.when(F.col("mean") > t, "Gain").when(F.col("mean") < -t, "Loss").otherwise("Neutral")
    return segs.withColumn("state", state).groupBy("sample", "state").agg(F.count("*").alias("n_segments"), F.sum("n_probes").alias("n_probes"))


def heatmap_bins(segs: DataFrame, bins: DataFrame, width: int) -> DataFrame:
    """CN15: the mean of the segments (start, end) over each bin (chrom, r_start, r_end), weighted by their overlap."""
    both = overlap_join(segs, bins, ["chrom"], width)
    shared = F.least("end", "r_end") - F.greatest("start", "r_start")
    return both.groupBy("sample", "chrom", F.col("r_start").alias("bin_start")).agg((F.sum(F.col("mean") * shared) / F.sum(shared)).alias("mean"))


def heatmap_matrix(rows: DataFrame, samples: list[str]) -> DataFrame:
    """CN15 at the sink: one column a sample."""
    return rows.groupBy("chrom", "bin_start").pivot("sample", samples).agg(F.first("mean"))
