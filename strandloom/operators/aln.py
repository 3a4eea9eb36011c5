"""Alignment records: retrieval, depth, duplicates, pairs and reports (AL1-AL30)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions.seq import cigar, cigar_sum, has_flag, is_aligned, is_main, leading_clip, no_flag, ref_span, strand, trailing_clip
from strandloom.operators.chunked import joined, lengths, piece_of, pieces, stretches, within
from strandloom.operators.intervals import islands, merge_intervals, overlap_join
from strandloom.plans.tables import saved

#: Bases of a bucket of a range join: a few times the usual alignment.
BUCKET = 1000


def spans(aln: DataFrame) -> DataFrame:
    """Alignments with half-open 0-based start and end on their reference."""
    return aln.withColumn("start", F.col("pos") - 1).withColumn("end", F.col("pos") - 1 + ref_span("cigar"))


def is_evidence(clip: int = 20) -> Column:
    """Neither properly paired nor secondary, or with a soft clip longer than `clip`."""
    return no_flag("flag", 258) | F.exists(cigar("cigar"), lambda x: (x["op"] == "S") & (x["len"] > clip))


def evidence_reads(aln: DataFrame, regions: DataFrame, clip: int = 20) -> DataFrame:
    """AL1: evidence reads of each region (sample, contig, r_start, r_end, region)."""
    return overlap_join(spans(aln.where(is_evidence(clip))), regions, ["sample", "contig"], BUCKET)


def cap_region(reads: DataFrame, n: int = 1000, seed: str = "0") -> DataFrame:
    """AL2: at most n reads of each region, drawn by a hash: the same at every run."""
    draw = F.md5(F.concat_ws("|", F.lit(seed), "qname", F.col("flag").cast("string"), F.col("pos").cast("string")))
    nth = F.row_number().over(Window.partitionBy("sample", "region").orderBy(draw, "qname", "flag", "pos"))
    return reads.withColumn("nth", nth).where(F.col("nth") <= n).drop("nth")


def mate_regions(reads: DataFrame, pad: int = 350, least: int = 2) -> DataFrame:
    """AL4: merged regions around the mates of reads, of at least `least` reads."""
    around = reads.select("sample", F.when(F.col("rnext") == "=", F.col("contig")).otherwise(F.col("rnext")).alias("contig"), (F.col("pnext") - pad).alias("start"), (F.col("pnext") + pad).alias("end"))
    return merge_intervals(around, ["sample", "contig"]).where(F.col("members") >= least)


def expand_regions(aln: DataFrame, regions: DataFrame, pad: int = 350, max_depth: int = 3) -> DataFrame:
    """AL5: regions (sample, contig, start, end) and, breadth first, mate regions that overlap none seen before, with their depth."""
    seen = saved(regions.withColumn("depth", F.lit(0)), "expand-0")
    fresh = seen
    for depth in range(1, max_depth + 1):
        ask = fresh.select("sample", "contig", F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.monotonically_increasing_id().alias("region"))
        mates = mate_regions(evidence_reads(aln, ask), pad).select("sample", "contig", "start", "end")
        known = seen.select("sample", "contig", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
        fresh = saved(overlap_join(mates, known, ["sample", "contig"], BUCKET, "left_anti").withColumn("depth", F.lit(depth)), f"expand-{depth}")
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)
    return seen


def dedup_reads(aln: DataFrame) -> DataFrame:
    """AL6: distinct (sample, qname, flag), the first by position."""
    first = F.min(F.struct("pos", "contig", "cigar")).alias("x")
    return aln.groupBy("sample", "qname", "flag").agg(first).select("sample", "qname", "flag", "x.*")


def split_singles_pairs(aln: DataFrame) -> DataFrame:
    """AL7: names of exactly two reads are pairs, first-in-pair first; the others singles: qname, kind, mate_order."""
    name = Window.partitionBy("sample", "qname")
    order = name.orderBy(F.desc(F.col("flag").bitwiseAND(64)), "flag", "pos", "contig", "cigar")
    kind = F.when(F.count("*").over(name) == 2, "pair").otherwise("single")
    return aln.select("sample", "qname", "flag", "contig", "pos", kind.alias("kind"), F.row_number().over(order).alias("mate_order"))


def group_sizes(aln: DataFrame) -> DataFrame:
    """AL7: how many names have how many reads."""
    return aln.groupBy("sample", "qname").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_names"))


def cigar_ops(aln: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """AL8: one row for each operation with its start on the read and on the reference, and columns `carry` of the alignment."""
    ops = aln.withColumn("ops", cigar("cigar"))
    upto = lambda kinds: F.transform("ops", lambda x, i: cigar_sum(F.slice("ops", 1, i), kinds))
    each = ops.select("sample", "qname", "flag", "contig", "pos", "cigar", *carry, F.posexplode(F.arrays_zip("ops", upto("MIS=X").alias("q"), upto("MDN=X").alias("r"))).alias("nth", "x"))
    return each.select("sample", "qname", "flag", "contig", "pos", "nth", F.col("x.ops.op").alias("op"), F.col("x.ops.len").alias("len"), F.col("x.q").alias("q_start"), (F.col("pos") + F.col("x.r")).alias("r_start"), *carry)


def with_ref_span(aln: DataFrame) -> DataFrame:
    """AL9: the aligned length on the reference."""
    return aln.withColumn("ref_span", ref_span("cigar"))


def query_interval(aln: DataFrame) -> DataFrame:
    """AL10: q_start and q_end of an alignment on its read, turned round where its strand differs from the primary's."""
    ops = cigar("cigar")
    length = cigar_sum(ops, "MISH=X")
    a, b = leading_clip("cigar"), length - trailing_clip("cigar")
    turn = has_flag("flag", 16) != F.col("primary_reverse")
    return aln.withColumn("q_start", F.when(turn, length - b).otherwise(a)).withColumn("q_end", F.when(turn, length - a).otherwise(b))




def flagstat(aln: DataFrame) -> DataFrame:
    """AL11: eleven counters for reads that pass or fail quality control."""
    main_pair = is_main("flag") & has_flag("flag", 1)
    mapped = is_aligned("flag")
    return aln.withColumn("qc_fail", has_flag("flag", 512)).groupBy("qc_fail").agg(
        F.count("*").alias("total"),
        F.count_if(has_flag("flag", 256)).alias("secondary"),
        F.count_if(no_flag("flag", 256) & has_flag("flag", 2048)).alias("supplementary"),
        F.count_if(has_flag("flag", 1024)).alias("duplicates"),
        F.count_if(mapped).alias("mapped"),
        F.count_if(main_pair).alias("paired"),
        F.count_if(main_pair & has_flag("flag", 64)).alias("read1"),
        F.count_if(main_pair & has_flag("flag", 128)).alias("read2"),
        F.count_if(main_pair & has_flag("flag", 2) & mapped).alias("properly_paired"),
        F.count_if(main_pair & no_flag("flag", 12)).alias("both_mapped"),
        F.count_if(main_pair & has_flag("flag", 8) & mapped).alias("singletons"),
    )


def depth_runs(aln: DataFrame, min_mapq: int = 0, min_len: int = 0) -> DataFrame:
    """AL12: maximal stretches (contig, start, end, depth) of equal depth above 0, from +1/-1 events of match blocks."""
    use = aln.where(no_flag("flag", 1796) & (F.col("mapq") >= min_mapq) & (ref_span("cigar") >= min_len))
    block = cigar_ops(use).where(F.col("op").isin("M", "=", "X")).select("sample", "contig", F.col("r_start").alias("a"), (F.col("r_start") + F.col("len")).alias("b"))
    events = block.select("sample", "contig", F.explode(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("by")), F.struct(F.col("b").alias("at"), F.lit(-1).alias("by")))).alias("e"))
    step = events.groupBy("sample", "contig", F.col("e.at").alias("start")).agg(F.sum("e.by").alias("by"))
    order = Window.partitionBy("sample", "contig").orderBy("start")
    held = step.withColumn("depth", F.sum("by").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("end", F.lead("start").over(order))
    return held.where("depth > 0").select("sample", "contig", "start", "end", "depth")


def depth(aln: DataFrame, min_mapq: int = 0, min_len: int = 0) -> DataFrame:
    """AL12: depth at every covered position (1-based)."""
    runs = depth_runs(aln, min_mapq, min_len)
    return runs.select("sample", "contig", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"), "depth")


def bedcov(regions: DataFrame, aln: DataFrame, min_mapq: int = 0) -> DataFrame:
    """AL13: summed depth over each region (contig, r_start, r_end), by sample."""
    both = overlap_join(depth_runs(aln, min_mapq).withColumn("start", F.col("start") - 1).withColumn("end", F.col("end") - 1), regions, ["contig"], BUCKET)
    shared = F.least("end", "r_end") - F.greatest("start", "r_start")
    return both.groupBy("sample", "contig", "r_start", "r_end").agg(F.sum(F.col("depth") * shared).alias("summed_depth"))


def rmdup_pairs(aln: DataFrame) -> DataFrame:
    """AL14: without pairs that share library, contig, leftmost position and template length, but for the one of highest base quality.

    The left read of a pair (tlen > 0) decides and its mate goes with it, by name. Unmapped reads and mates elsewhere stay.
    """
    left = aln.where(is_aligned("flag") & is_main("flag") & (F.col("rnext") == "=") & (F.col("tlen") > 0))
    best = Window.partitionBy("sample", "contig", "pos", "tlen").orderBy(F.desc("base_quality"), "qname", "flag")
    lost = left.withColumn("nth", F.row_number().over(best)).where("nth > 1").select("sample", "qname").distinct()
    return aln.join(lost, ["sample", "qname"], "left_anti")


def rmdup_single(aln: DataFrame) -> DataFrame:
    """AL15: of mapped reads with one library, contig, strand and outer position the one of highest base quality; others as they are."""
    use = is_aligned("flag") & is_main("flag")
    outer = F.when(has_flag("flag", 16), F.col("pos") + ref_span("cigar") - 1).otherwise(F.col("pos"))
    best = Window.partitionBy("sample", "contig", has_flag("flag", 16), outer, use).orderBy(F.desc("base_quality"), "qname", "flag", "pos", "cigar")
    return aln.withColumn("nth", F.when(use, F.row_number().over(best)).otherwise(1)).where("nth = 1").drop("nth")


def dup_rate(aln: DataFrame) -> DataFrame:
    """AL16: removed and checked reads of AL15 by library, and their ratio."""
    use = lambda df: df.where(is_aligned("flag") & is_main("flag")).groupBy("sample")
    kept = use(rmdup_single(aln)).agg(F.count("*").alias("kept"))
    return use(aln).agg(F.count("*").alias("checked")).join(kept, "sample").select("sample", "checked", (F.col("checked") - F.col("kept")).alias("removed"), ((F.col("checked") - F.col("kept")) / F.col("checked")).alias("rate"))


def _mates(aln: DataFrame) -> tuple[DataFrame, DataFrame]:
    main = spans(aln.where(is_main("flag") & has_flag("flag", 1)))
    one = lambda bit: main.where(has_flag("flag", bit)).groupBy("sample", "qname").agg(F.min(F.struct("contig", "pos", "flag", "cigar", "end")).alias("x")).select("sample", "qname", "x.*")
    return one(64), one(128)


def fixmate(aln: DataFrame) -> DataFrame:
    """AL17: mate contig and position, mate bits of the flag and the signed template length of the two primary reads of a name."""
    a, b = _mates(aln)
    b = b.select("sample", "qname", *(F.col(c).alias(f"m_{c}") for c in ("contig", "pos", "flag", "cigar", "end")))
    both = a.join(b, ["sample", "qname"])
    m = {c: F.col(f"m_{c}") for c in ("contig", "pos", "flag", "end")}
    row = lambda c, p, f, e, oc, op, of, oe: F.struct(c.alias("contig"), p.alias("pos"), _mate_bits(f, of).alias("flag"), F.when(c == oc, "=").otherwise(oc).alias("rnext"), op.alias("pnext"), _tlen(c, p, f, e, oc, op, of, oe).alias("tlen"))
    own = (F.col("contig"), F.col("pos"), F.col("flag"), F.col("end"))
    other = (m["contig"], m["pos"], m["flag"], m["end"])
    return both.select("sample", "qname", F.explode(F.array(row(*own, *other), row(*other, *own))).alias("x")).select("sample", "qname", "x.*")


def _mate_bits(flag: Column, mate: Column) -> Column:
    kept = flag.bitwiseAND(F.lit(~40))
    return kept + F.when(has_flag(mate, 4), 8).otherwise(0) + F.when(has_flag(mate, 16), 32).otherwise(0)


def _tlen(c, p, f, e, oc, op, of, oe) -> Column:
    end5 = lambda pos, flag, end: F.when(has_flag(flag, 16), end).otherwise(pos - 1)
    return F.when((c == oc) & no_flag(f, 4) & no_flag(of, 4), end5(op, of, oe) - end5(p, f, e)).otherwise(F.lit(0))


def template_cigar(aln: DataFrame) -> DataFrame:
    """AL18: order, strand and CIGAR of both reads of a name on one contig, with the gap between: `1F30M20T2R30M`."""
    a, b = _mates(aln)
    b = b.select("sample", "qname", F.col("contig"), *(F.col(c).alias(f"m_{c}") for c in ("pos", "flag", "cigar", "end")))
    both = a.join(b, ["sample", "qname", "contig"])
    first = F.concat(F.lit("1"), F.when(has_flag("flag", 16), "R").otherwise("F"), "cigar")
    second = F.concat(F.lit("2"), F.when(has_flag("m_flag", 16), "R").otherwise("F"), "m_cigar")
    ahead = F.col("pos") <= F.col("m_pos")
    gap = F.when(ahead, F.col("m_pos") - 1 - F.col("end")).otherwise(F.col("pos") - 1 - F.col("m_end"))
    text = F.concat(F.when(ahead, first).otherwise(second), gap.cast("string"), F.lit("T"), F.when(ahead, second).otherwise(first))
    return both.select("sample", "qname", "contig", text.alias("template"))


def indel_by_homopolymer(aln: DataFrame, reference: DataFrame, long_run: int = 5) -> DataFrame:
    """AL19: insertions and deletions of one base in short and long runs of the reference (contig, seq), by sample.

    An indel meets the piece of its contig that its place lies on, with as many bases more as a long run has. Of places beyond the
    contig the run is short; indels on contigs that the reference doesn't have aren't counted.
    """
    one = cigar_ops(aln).where(F.col("op").isin("I", "D") & (F.col("len") == 1)).join(reference.select("contig").distinct(), "contig", "left_semi")
    at = F.col("r_start") - 1
    held = one.withColumn("piece", piece_of(at)).join(pieces(reference, lap=long_run), ["contig", "piece"], "left")
    run = F.substring(F.col("bases"), within(at), F.lit(long_run)).rlike("^(" + "|".join(f"{b}{{{long_run}}}" for b in "ACGTN") + ")$")
    return held.withColumn("in_run", F.when(run, "long").otherwise("short")).groupBy("sample", "op", "in_run").agg(F.count("*").alias("n"))


def mapping_accuracy(aln: DataFrame, gap: int = 20) -> DataFrame:
    """AL20: wrong and all placements by mapping-quality decile, and cumulated from the best; true_contig and true_pos are known."""
    wrong = (F.col("contig") != F.col("true_contig")) | (F.abs(F.col("pos") - F.col("true_pos")) > gap)
    per = aln.where(is_aligned("flag")).groupBy(F.floor(F.col("mapq") / 10).cast("int").alias("decile")).agg(F.count_if(wrong).alias("wrong"), F.count("*").alias("total"))
    down = Window.orderBy(F.desc("decile")).rowsBetween(Window.unboundedPreceding, 0)  # a handful of rows
    return per.select("decile", "wrong", "total", F.sum("wrong").over(down).alias("cum_wrong"), F.sum("total").over(down).alias("cum_total"))


def aligned_contigs(aln: DataFrame) -> DataFrame:
    """AL21: every name once for each contig to which one of its reads maps with a quality above 0."""
    return aln.where(is_aligned("flag") & (F.col("mapq") > 0)).select("sample", "qname", "contig").distinct()


def proper_alignments(aln: DataFrame) -> DataFrame:
    """AL22: aligned, main, of a mapping quality above 0; with the strand."""
    return aln.where(is_aligned("flag") & is_main("flag") & (F.col("mapq") != 0)).withColumn("strand", strand("flag"))


def primary_alignment(aln: DataFrame) -> DataFrame:
    """AL23: one alignment a name: primary before others, then the highest score."""
    order = Window.partitionBy("sample", "qname").orderBy(F.desc(is_main("flag")), F.desc("score"), "contig", "pos", "flag", "cigar")
    return aln.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def to_bed(aln: DataFrame) -> DataFrame:
    """AL24: contig, start, end, qname, mapq, strand."""
    return spans(aln).select("contig", "start", "end", "qname", "mapq", strand("flag").alias("strand"))


def concat_alignments(frames: list[DataFrame]) -> DataFrame:
    """AL25: all rows of tables with the same columns."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def shuffle_by_name(aln: DataFrame, partitions: int | None = None) -> DataFrame:
    """AL26: reads of a name together, names in the order of their hash."""
    mark = F.xxhash64("qname")
    dealt = aln.repartition(partitions, mark) if partitions else aln.repartition(mark)
    return dealt.sortWithinPartitions(mark, "qname", F.col("flag").bitwiseAND(192), "flag", "pos")


def covered_regions(aln: DataFrame, step: int = 0, min_cov: float = 2, min_len: int = 500) -> DataFrame:
    """AL27: islands of alignments at most `step` apart, longer than min_len and covered more than min_cov times."""
    held = islands(spans(aln.where(is_aligned("flag"))), ["sample", "contig"], step)
    regions = held.groupBy("sample", "contig", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum(F.col("end") - F.col("start")).alias("bases"))
    size = F.col("end") - F.col("start")
    return regions.where((size > min_len) & (F.col("bases") / size > min_cov)).select("sample", "contig", "start", "end", (F.col("bases") / size).alias("coverage"))


def extract_regions(regions: DataFrame, reference: DataFrame) -> DataFrame:
    """AL28: the sequence of each region (contig, start, end), named `contig_(start-end)`; what lies beyond its contig is left out.

    Regions that repeat are fetched once. A region meets only the pieces of its contig that it touches, which are put together at the end.
    """
    each = regions.groupBy("contig", "start", "end").agg(F.count("*").alias("times")).join(lengths(reference), "contig")
    cut = stretches(each.withColumn("end_", F.least("end", "length")), reference, "start", "end_")
    texts = joined(cut.select("contig", "start", "end", "piece", F.col("bases").alias("seq")), "seq", "contig", "start", "end")
    name = F.concat(F.col("contig"), F.lit("_("), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit(")"))
    held = each.join(texts, ["contig", "start", "end"], "left").select(name.alias("name"), F.coalesce("seq", F.lit("")).alias("seq"), F.explode(F.sequence(F.lit(1), F.col("times"))))
    return held.select("name", "seq")


def longest_mapping(maps: DataFrame, share: float = 0.8) -> DataFrame:
    """AL29: the longest mapping (read, q_start, q_end, read_length, identity) of each read that covers more than `share` of it."""
    length = F.col("q_end") - F.col("q_start")
    best = F.max(F.struct(length.alias("length"), F.col("identity"), F.col("contig"))).alias("best")
    return maps.where(length > share * F.col("read_length")).groupBy("read").agg(best).select("read", "best.length", "best.identity", "best.contig")


def alignment_report(maps: DataFrame, reads: DataFrame, share: float = 0.8, long_enough: int = 1000) -> DataFrame:
    """AL30: reads, those whose best block covers `share` of them or long_enough bases, their share and mean identity."""
    length = F.col("q_end") - F.col("q_start")
    best = maps.groupBy("read").agg(F.max(F.struct(length.alias("length"), F.col("identity"))).alias("b"), F.max("read_length").alias("read_length"))
    good = best.where(F.col("b.length") > F.least(share * F.col("read_length"), F.lit(float(long_enough)))).agg(F.count("*").alias("n_aligned"), F.avg("b.identity").alias("mean_identity"))
    return reads.agg(F.count_distinct("read").alias("n_reads")).join(F.broadcast(good)).select("n_reads", "n_aligned", (F.col("n_aligned") / F.col("n_reads")).alias("share"), "mean_identity")
