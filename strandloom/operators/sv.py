"""Structural variants: filters, projections and conversion (SV1-SV14)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.operators.intervals import overlap_join
from strandloom.plans.tables import saved

# fixed values: probability and support below which a variant of the type is dropped
SUPPORT = {"INS": (0.2, 9), "DEL": (0.3, 9), "INV": (0.15, 6), "DUP": (0.15, 6), "TRA": (0.4, 8)}
CHROMOSOMES = [*map(str, range(1, 23)), "X", "Y"]
# fixed values: ambiguity codes of two bases
IUPAC = {"M": "AC", "R": "AG", "W": "AT", "S": "CG", "Y": "CT", "K": "GT"}


def size_filter(sv: DataFrame, size: int = 10000) -> DataFrame:
    """SV1: drop rows with svlen < size; a missing svlen is kept."""
    return sv.where(~F.coalesce(F.col("svlen") < size, F.lit(False)))


def size_filter_report(sv: DataFrame, size: int = 10000) -> DataFrame:
    """SV2: rows before and after the size filter, by sample."""
    return sv.groupBy("sample").agg(F.count("*").alias("before"), F.count_if(~F.coalesce(F.col("svlen") < size, F.lit(False))).alias("after"))


def support_filter(sv: DataFrame, thresholds: dict[str, tuple[float, int]] = SUPPORT) -> DataFrame:
    """SV3: drop rows whose probability and support both lie below the thresholds of their type."""
    prob = F.create_map(*chain.from_iterable((F.lit(k), F.lit(float(p))) for k, (p, _) in thresholds.items()))
    su = F.create_map(*chain.from_iterable((F.lit(k), F.lit(s)) for k, (_, s) in thresholds.items()))
    low = (F.col("prob") < prob[F.col("svtype")]) & (F.col("su") < su[F.col("svtype")])
    return sv.where(~F.coalesce(low, F.lit(False)))


def span_filter(sv: DataFrame, least: int = 500) -> DataFrame:
    """SV4: deletions and inversions must span more than `least`."""
    return sv.where(~F.col("svtype").isin("DEL", "INV") | (F.abs(F.col("stop") - F.col("pos")) > least))


def break_filter(sv: DataFrame, least: int = 50000) -> DataFrame:
    """SV5: translocations, and others of at least `least` bases."""
    return sv.where((F.col("svtype") == "TRA") | (F.col("stop") - F.col("pos") >= least))


def breakends(sv: DataFrame) -> DataFrame:
    """SV6: two break-ends for each variant: sample, sv_id, side, chrom, pos."""
    far = F.col("svtype") == "TRA"
    second = F.struct(F.lit(2).alias("side"), F.when(far, F.col("chr2")).otherwise(F.col("chrom")).alias("chrom"), F.when(far, F.col("chr2_pos")).otherwise(F.col("stop")).alias("pos"))
    first = F.struct(F.lit(1).alias("side"), F.col("chrom").alias("chrom"), F.col("pos").alias("pos"))
    return sv.select("sample", "sv_id", F.explode(F.array(first, second)).alias("e")).select("sample", "sv_id", "e.side", "e.chrom", "e.pos")


def to_bed(sv: DataFrame, padding: int = 1000, joined: int = 1000) -> DataFrame:
    """SV7: padded intervals; a short variant gives one, a long one two, and the mate position another. stop < pos is skipped."""

    def around(chrom: str, a: Column, b: Column, ok: Column) -> Column:
        iv = F.struct(F.col(chrom).alias("chrom"), F.greatest(F.lit(0).cast("long"), a - padding).alias("start"), (b + padding).alias("end"))
        return F.when(ok, iv)

    pos, stop = F.col("pos"), F.col("stop")
    short = (stop - pos) <= joined
    parts = F.array(
        around("chrom", pos, F.when(short, stop).otherwise(pos), F.lit(True)),
        around("chrom", stop, stop, ~short),
        around("chr2", F.col("chr2_pos"), F.col("chr2_pos"), F.col("chr2_pos").isNotNull()),
    )
    rows = sv.where(stop >= pos).select("sample", F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("iv"))
    return rows.select("sample", "iv.chrom", "iv.start", "iv.end")


def normalise_chrom(df: DataFrame, order: list[str] = CHROMOSOMES, column: str = "chrom") -> DataFrame:
    """SV8: names without `chr`, of the listed chromosomes only."""
    return df.withColumn(column, F.regexp_replace(column, "^chr", "")).where(F.col(column).isin(*order))


def link_table(sv: DataFrame, widen: int = 50000) -> DataFrame:
    """SV9: chords within and between chromosomes, and points for insertions."""
    kind = F.when(F.col("svtype") == "TRA", "inter").when(F.col("svtype") == "INS", "point").otherwise("intra")
    end = F.when(kind == "inter", F.col("chr2_pos")).when(kind == "point", F.col("pos")).when(F.col("stop") - F.col("pos") < widen, F.col("stop") + widen).otherwise(F.col("stop"))
    other = F.when(kind == "inter", F.col("chr2")).otherwise(F.col("chrom"))
    return sv.select("sample", "sv_id", kind.alias("kind"), F.col("chrom").alias("chrom1"), F.col("pos").alias("pos1"), other.alias("chrom2"), end.alias("pos2"))


def cohort_split(samples: DataFrame, column: str, threshold, categorical: bool = False) -> DataFrame:
    """SV10: label samples short or long by a value, or by equality with a category."""
    is_short = F.col(column) == F.lit(threshold) if categorical else F.col(column) < F.lit(threshold)
    return samples.withColumn("cohort", F.when(is_short, "short").otherwise("long"))


def cohort_subsets(samples: DataFrame, n_subsets: int = 1, subsample: int = 100, split: float = 0.5, seed: str = "0") -> DataFrame:
    """SV11: draw, for each subset, a share of `subsample` from the short group and the rest from the long one; reproducible."""
    each = samples.withColumn("subset", F.explode(F.sequence(F.lit(1), F.lit(n_subsets))))
    draw = F.md5(F.concat_ws("|", F.lit(seed), F.col("subset").cast("string"), F.col("sample")))
    nth = F.row_number().over(Window.partitionBy("subset", "cohort").orderBy(draw, "sample"))
    take = F.when(F.col("cohort") == "short", int(split * subsample)).otherwise(subsample - int(split * subsample))
    return each.withColumn("nth", nth).where(F.col("nth") <= take).select("subset", "cohort", "sample")


def contig_pairs(sv: DataFrame) -> DataFrame:
    """SV12: evidence contigs of each variant: sample, sv_id, side, seq."""
    return sv.select("sample", "sv_id", F.posexplode(F.array("contiga", "contigb")).alias("side", "seq")).where(F.col("seq").isNotNull() & (F.col("seq") != ""))


def site_filter(sites: DataFrame, min_depth=3, max_depth=100, min_snp_mapq=25, min_gap_mapq=10, min_indel_score=25, snp_gap=10, dense=10, dense_snps=2, gap_gap=30, factor=100, min_snp_quality=0, min_indel_quality=0, min_ref_quality=0) -> DataFrame:
    """SV13: one code for each site of ([sample,] chrom, pos, is_indel, dlen, quality, mapq, depth, support[, is_ref]), U if it passes.

    d and D: depth; i, s, C: quality of an indel, a SNP, a reference site; those take no further part. Q: mapping quality. G: a
    gap within gap_gap of another (after its end) that scores more, or before it as much; its score is quality + factor * support.
    W: a SNP of more than dense_snps within `dense` bases; g: a SNP within snp_gap of a gap. Where a later site could give W or
    g, the first one does. SNPs of low mapping quality count as neighbours only with a W or g of their own.

    Sites meet by a join of close positions, not by a sweep, so a chromosome is not one task.
    """
    keys = [k for k in ("sample", "chrom") if k in sites.columns]
    is_ref = F.coalesce("is_ref", F.lit(False)) if "is_ref" in sites.columns else F.lit(False)
    gap = F.col("is_indel")
    first = F.when(F.col("depth") < min_depth, "d").when(F.col("depth") > max_depth, "D")
    first = first.when(gap & (F.col("quality") < min_indel_quality), "i").when(~gap & ~is_ref & (F.col("quality") < min_snp_quality), "s").when(is_ref & (F.col("quality") < min_ref_quality), "C")
    held = saved(sites.withColumn("site_id", F.monotonically_increasing_id()).withColumn("first_code", first), "sites")
    live = held.where("first_code is null").select(
        *keys, "site_id", "pos", "quality", F.when(gap, F.col("dlen")).otherwise(0).alias("dlen"), gap.alias("gap"), (~gap & ~is_ref).alias("snp"),
        (F.col("mapq") >= F.when(gap, min_gap_mapq).otherwise(min_snp_mapq)).alias("mapped"), (F.col("quality") + factor * F.col("support")).alias("score"), F.struct("pos", "is_indel", "site_id").alias("nth"),
    )
    columns = ("site_id", "pos", "dlen", "quality", "gap", "snp", "mapped", "score", "nth")
    side = lambda p: [*keys, *(F.col(c).alias(f"{p}_{c}") for c in columns)]
    reach = max(snp_gap, dense, gap_gap)
    before = live.where("gap or snp").select(*side("x")).withColumn("start", F.col("x_pos")).withColumn("end", F.col("x_pos") + F.col("x_dlen") + reach + 1)
    after = live.select(*side("y")).withColumn("r_start", F.col("y_pos")).withColumn("r_end", F.col("y_pos") + 1)
    pairs = overlap_join(before, after, keys, 256).where("x_nth < y_nth").withColumn("apart", F.col("y_pos") - F.col("x_pos") - F.col("x_dlen"))
    pairs = saved(pairs.select(*(f"{p}_{c}" for p in "xy" for c in columns), "apart"), "site-pairs")

    some = lambda what: F.max(F.coalesce(what, F.lit(False)))
    near_gap = (F.col("apart") <= snp_gap) & F.col("x_gap") & ~F.col("y_gap")
    stronger = F.col("x_gap") & F.col("y_gap") & (F.col("apart") <= gap_gap)
    behind = pairs.groupBy(F.col("y_site_id").alias("site_id")).agg(some(near_gap & (F.col("x_score") >= min_indel_score)).alias("g_back"), some(stronger & (F.col("x_score") >= F.col("y_score"))).alias("beaten"))
    behind = saved(behind, "site-behind")
    close = pairs.where("x_snp and not y_gap").where(F.col("apart") <= dense).select("x_site_id", "x_mapped", "y_site_id", "y_nth")
    close = close.join(behind.select(F.col("site_id").alias("x_site_id"), F.col("g_back").alias("x_g")), "x_site_id", "left")
    close = saved(close.withColumn("counts", F.col("x_mapped") | F.coalesce("x_g", F.lit(False))), "site-close")
    crowded = lambda c: c.where("counts").groupBy("y_site_id").agg(F.count("*").alias("n")).where(F.col("n") + 1 > dense_snps).select(F.col("y_site_id").alias("site_id"))
    dense_sites = saved(crowded(close), "site-dense")
    while True:  # a SNP of low mapping quality that turns out to be crowded counts for those after it
        more = close.join(dense_sites.withColumnRenamed("site_id", "x_site_id").withColumn("w", F.lit(True)), "x_site_id", "left")
        grown = saved(crowded(more.withColumn("counts", F.col("counts") | F.coalesce("w", F.lit(False)))), "site-dense")
        if grown.count() == dense_sites.count():
            break
        dense_sites = grown
    own = dense_sites.withColumn("crowded", F.lit(True))
    next_w = close.join(own.withColumnRenamed("site_id", "y_site_id"), "y_site_id").groupBy(F.col("x_site_id").alias("site_id")).agg(F.min("y_nth").alias("w_nth"))
    ahead = pairs.groupBy(F.col("x_site_id").alias("site_id")).agg(
        F.min(F.when(F.col("x_snp") & F.col("y_gap") & (F.col("apart") <= snp_gap) & (F.col("y_quality") >= min_indel_score), F.col("y_nth"))).alias("g_nth"),
        some(stronger & (F.col("y_score") > F.col("x_score"))).alias("outdone"),
    )
    told = held
    for facts in (behind, own, next_w, ahead):
        told = told.join(facts, "site_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    low = F.col("mapq") < F.when(gap, min_gap_mapq).otherwise(min_snp_mapq)
    of_gap = F.when(yes("beaten") | yes("outdone"), "G").when(low, "Q").otherwise("U")
    later = F.when(F.col("w_nth").isNotNull() & (F.col("g_nth").isNull() | (F.col("w_nth") < F.col("g_nth"))), "W").when(F.col("g_nth").isNotNull(), "g").otherwise("U")
    of_snp = F.when(yes("crowded"), "W").when(yes("g_back"), "g").when(low, "Q").when(is_ref, "U").otherwise(later)
    return told.select(*sites.columns, F.coalesce("first_code", F.when(gap, of_gap).otherwise(of_snp)).alias("code"))


def consensus_to_variants(pileup: DataFrame, keep_ref: bool = False) -> DataFrame:
    """SV14: ref, alt and genotype of pileup rows (chrom, pos, ref, cons); cons may be an ambiguity code."""
    codes = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in IUPAC.items()))
    ref, cons = F.upper("ref"), F.upper("cons")
    pair = F.coalesce(codes[cons], F.concat(cons, cons))
    a, b = F.substring(pair, 1, 1), F.substring(pair, 2, 1)
    alts = F.array_distinct(F.filter(F.array(a, b), lambda x: x != ref))
    number = lambda x: F.when(x == ref, F.lit(0)).otherwise(F.array_position(alts, x))
    low, high = F.least(number(a), number(b)), F.greatest(number(a), number(b))
    out = pileup.select("chrom", "pos", ref.alias("ref"), F.when(F.size(alts) > 0, F.array_join(alts, ",")).otherwise(".").alias("alt"), F.concat(low.cast("string"), F.lit("/"), high.cast("string")).alias("genotype"))
    return out if keep_ref else out.where("alt <> '.'")
