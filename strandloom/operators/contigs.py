"""Contig quality control and annotation (CQ1-CQ19)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions.packed import codec
from strandloom.functions.seq import base_count, cigar, hamming, ref_span, revcomp
from strandloom.operators.aln import primary_alignment, query_interval
from strandloom.operators.chunked import lengths, stretches
from strandloom.operators.intervals import islands, overlap_dealt
from strandloom.operators.seqs import repeat_score
from strandloom.plans.tables import components, dealt_by, saved

# fixed values: costs of the best path over a contig's alignments
INSERTION, HOMOLOGY, INTER, INTRA, MAX_INSERTION, MIN_ALIGNED, MAX_HOMOLOGY = 2.0, 1.5, 20.0, 10.0, 1500.0, 20.0, 1500.0


def contig_coverage(aln: DataFrame, contigs: DataFrame, max_cov: float = 45, least_end: int = 125) -> DataFrame:
    """CQ1: mean depth of each contig from alignments that end beyond least_end; contigs below max_cov."""
    per = aln.withColumn("span_", ref_span("cigar")).where(F.col("pos") - 1 + F.col("span_") > least_end).groupBy("contig").agg(F.sum("span_").alias("bases"))
    held = contigs.join(per, "contig", "left").withColumn("coverage", F.coalesce("bases", F.lit(0)) / F.length("seq"))
    return held.where(F.col("coverage") < max_cov).drop("bases")


def repetitive_filter(contigs: DataFrame, share: float = 0.8) -> DataFrame:
    """CQ2: without contigs whose bases are masked (lower case or N) to `share` and more."""
    masked = F.length(F.regexp_replace("seq", "[^a-zN]", "")) / F.greatest(F.length("seq"), F.lit(1))
    return contigs.where(masked < share)


def rename_contigs(contigs: DataFrame) -> DataFrame:
    """CQ3: contigs named `sample_length_l_mean_cov_c`."""
    name = F.concat("sample", F.lit("_length_"), F.length("seq").cast("string"), F.lit("_mean_cov_"), F.round("coverage", 2).cast("string"))
    return contigs.withColumn("contig", name)


def supported_contigs(contigs: DataFrame, evidence: DataFrame) -> DataFrame:
    """CQ4: contigs with evidence coverage above 0."""
    return contigs.join(evidence.where(ref_span("cigar") > 0).select("contig").distinct(), "contig", "left_semi")


def read_to_contig_coverage(reads: DataFrame, contigs: DataFrame, k: int = 21, least: int = 140) -> DataFrame:
    """CQ5: contig, uncovered, coverage, runs: the uncovered bases, the mean coverage and the coverage itself, as runs (start, end, depth)
    from the first to the last base, by reads of either strand that match at least `least` bases.

    Candidate placements are diagonals that a read shares with a contig by a k-mer; the bases that agree along a diagonal are
    its score, counted on the pieces of the contig that it crosses, and a read covers the best diagonal of a contig.
    """
    code = codec(k)
    both = reads.select("read_id", F.posexplode(F.array("seq", revcomp("seq"))).alias("strand", "seq"))
    # written, so that their sizes are known: few are broadcast, and neither k-mers nor pieces of contigs are shuffled to meet them
    seeds = saved(code.rows(both, k, ("read_id", "strand"), at="i").select("read_id", "strand", "i", "kmer"), "read-seeds")
    index = code.rows(contigs, k, ("contig",), at="j").select("contig", "j", "kmer")
    lines = index.join(seeds, "kmer").select("read_id", "strand", "contig", (F.col("j") - F.col("i")).alias("offset")).distinct()
    size = saved(lengths(contigs), "contig-lengths")
    placed = saved(lines.join(both, ["read_id", "strand"]).join(size, "contig"), "placed-reads").withColumn("a", F.greatest("offset", F.lit(0))).withColumn("b", F.least(F.col("offset") + F.length("seq"), F.col("length")))
    met = stretches(placed, contigs, "a", "b")
    own = F.substring(F.col("seq"), (F.col("from_") - F.col("offset") + 1).cast("int"), F.length("bases"))
    same = met.select("read_id", "contig", "strand", "offset", "a", "b", (F.length("bases") - hamming(F.col("bases"), own)).alias("same"))
    scored = same.groupBy("read_id", "contig", "strand", "offset", "a", "b").agg(F.sum("same").alias("score")).where(F.col("score") >= least)
    best = scored.groupBy("read_id", "contig").agg(F.max(F.struct("score", "a", "b")).alias("m"))
    ends = size.select("contig", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("by")), F.struct(F.col("length").alias("at"), F.lit(0).alias("by")))).alias("e"))
    step = best.select("contig", F.explode(F.array(F.struct(F.col("m.a").alias("at"), F.lit(1).alias("by")), F.struct(F.col("m.b").alias("at"), F.lit(-1).alias("by")))).alias("e")).union(ends).groupBy("contig", "e.at").agg(F.sum("e.by").alias("by"))
    order = Window.partitionBy("contig").orderBy("at")
    steps = step.join(size, "contig").where("by <> 0 or at = 0 or at = length")
    runs = steps.withColumn("depth", F.sum("by").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("end", F.lead("at").over(order)).where(F.col("end").isNotNull()).withColumn("size", F.col("end") - F.col("at"))
    listed = F.sort_array(F.collect_list(F.struct(F.col("at").alias("start"), "end", "depth"))).alias("runs")
    per = runs.groupBy("contig").agg(F.sum(F.when(F.col("depth") == 0, F.col("size")).otherwise(0)).alias("uncovered"), F.sum(F.col("depth") * F.col("size")).alias("bases"), listed)
    held = size.join(per, "contig", "left")
    return held.select("contig", F.coalesce("uncovered", F.lit(0).cast("long")).alias("uncovered"), (F.coalesce("bases", F.lit(0)) / F.when(F.col("length") > 0, F.col("length"))).alias("coverage"), "runs")


def overlaps_break(rows: DataFrame, breaks: DataFrame, pad: int = 500, width: int = 5000, places: DataFrame | None = None) -> DataFrame:
    """CQ8: rows (sample, chrom, rstart, rend; whole numbers) flagged by whether they overlap a padded break of their sample and chromosome.

    Places are told once, and meet padded breaks that are joined where they overlap, so the pairs grow with the rows. places: the
    places of rows, where they can be read more cheaply than rows."""
    spots = rows.select("sample", "chrom", "rstart", "rend") if places is None else places
    spots = spots.distinct()
    found = spots.select("*", F.col("rstart").alias("start"), F.col("rend").alias("end"))
    met = overlap_dealt(found, "start", "end", width).join(break_islands(breaks, pad, width), ["sample", "chrom", "bucket"])
    met = met.where((F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end")))
    hit = met.select("sample", "chrom", "rstart", "rend").distinct().withColumn("vcf", F.lit(True))
    return rows.join(hit, ["sample", "chrom", "rstart", "rend"], "left").select(*rows.columns, F.coalesce("vcf", F.lit(False)).alias("vcf"))


def break_islands(breaks: DataFrame, pad: int, width: int) -> DataFrame:
    """sample, chrom, bucket, r_start, r_end: padded breaks, joined within a bucket where they overlap. A bucket has at most
    width / (2 pad) + 2 of them, however many breaks it has."""
    around = breaks.select("sample", "chrom", (F.col("pos") - pad).alias("r_start"), (F.col("pos") + pad).alias("r_end")).distinct()
    keys = ["sample", "chrom", "bucket"]
    return islands(overlap_dealt(around, "r_start", "r_end", width), keys, -1, "r_start", "r_end").groupBy(*keys, "island").agg(F.min("r_start").alias("r_start"), F.max("r_end").alias("r_end")).drop("island")


def short_anchor(rows: DataFrame, least: int = 50) -> DataFrame:
    """CQ7: contigs whose first or last alignment is shorter than `least`, flagged on all their rows."""
    order = Window.partitionBy("qname").orderBy("qstart", "qend").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    size = F.col("qend") - F.col("qstart")
    return rows.withColumn("short_anchor", (F.first(size).over(order) < least) | (F.last(size).over(order) < least))


def contig_mapping_table(aln: DataFrame, breaks: DataFrame, pad: int = 500) -> DataFrame:
    """CQ6: one row for each alignment of a contig, with its place on the contig in the direction of the primary alignment."""
    first = primary_alignment(aln).select("sample", "qname", (F.col("flag").bitwiseAND(16) > 0).alias("primary_reverse"))
    placed = query_interval(aln.join(first, ["sample", "qname"]))
    length = F.aggregate(F.filter(cigar("cigar"), lambda x: x["op"].isin(*"MISH=X")), F.lit(0), lambda a, x: a + x["len"])
    rows = placed.select(
        "sample", F.col("contig").alias("chrom"), (F.col("pos") - 1).alias("rstart"), (F.col("pos") - 1 + ref_span("cigar")).alias("rend"), "qname",
        F.count("*").over(Window.partitionBy("sample", "qname")).alias("n_alignments"), (F.col("q_end") - F.col("q_start")).alias("aln_size"), F.col("q_start").alias("qstart"), F.col("q_end").alias("qend"),
        F.when(F.col("flag").bitwiseAND(16) > 0, "-").otherwise("+").alias("strand"), "mapq", length.alias("qlen"), F.col("score").alias("alignment_score"), "cigar",
    )
    places = aln.select("sample", F.col("contig").alias("chrom"), (F.col("pos") - 1).alias("rstart"), (F.col("pos") - 1 + ref_span("cigar")).alias("rend"))
    return overlaps_break(short_anchor(rows), breaks, pad, places=places)


def remove_common_sites(rows: DataFrame, pad: int = 500) -> DataFrame:
    """CQ9: without contigs in components of contigs that share padded breakpoints across samples.

    The components are those of sites alone: a contig links the first of its sites to its others and belongs where the first does,
    so the rounds run over distinct pairs of sites, whatever the number of contigs.
    """
    site = lambda pos: F.concat_ws("|", "chrom", F.floor(F.col(pos) / pad).cast("string"))
    ends = rows.select("sample", "qname", site("rstart").alias("a"), site("rend").alias("b"))
    both = F.array(F.least("a", "b"), F.greatest("a", "b"))
    first = ends.groupBy("sample", "qname").agg(F.min(F.least("a", "b")).alias("site"))
    low = F.min(F.least("a", "b")).over(Window.partitionBy("sample", "qname"))
    links = ends.select(low.alias("b"), both.alias("both")).select("b", F.explode("both").alias("a")).where("a <> b").distinct()
    told = saved(first.groupBy("site").agg(F.min("sample").alias("least"), F.max("sample").alias("most")), "site-samples")
    found = told.join(components(links, "common-sites").withColumnRenamed("node", "site"), "site", "left").withColumn("component", F.coalesce("component", "site"))
    wide = found.groupBy("component").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least <> most").select("component")
    bad = first.join(found.join(wide, "component", "left_semi").select("site"), "site", "left_semi").select("sample", "qname")
    return rows.join(bad, ["sample", "qname"], "left_anti")


def contig_length_stats(contigs: DataFrame, keys: list[str]) -> DataFrame:
    """CQ10: count, mean, longest and N50 by keys."""
    size = contigs.select(*keys, F.length("seq").alias("n"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n"))
    per = size.groupBy(*keys, "n").agg(F.sum("n").alias("w"))
    half = per.withColumn("upto", F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("w").over(Window.partitionBy(*keys)))
    n50 = half.where(F.col("upto") * 2 >= F.col("total")).groupBy(*keys).agg(F.max("n").alias("n50"))
    return size.groupBy(*keys).agg(F.count("*").alias("n_contigs"), F.avg("n").alias("mean"), F.max("n").alias("longest")).join(n50, keys)


def base_composition(seqs: DataFrame, key: str) -> DataFrame:
    """CQ11: shares of A, C, G, T and the share of the two most frequent."""
    n = F.greatest(F.length("seq"), F.lit(1))
    share = {b: base_count("seq", b) / n for b in "ACGT"}
    top = F.sort_array(F.array(*share.values()), asc=False)
    return seqs.select(key, *(v.alias(f"share_{k}") for k, v in share.items()), (top[0] + top[1]).alias("top_two"))


def tandem_flanking(rows: DataFrame, least_score: float = 0.2, near: int = 1000, low_mapq: int = 30) -> DataFrame:
    """CQ12: where two alignments of a contig on one chromosome, with others between, flank a tandem repeat: without the poorly
    mapped ones between, and without the contig if only two rows are left. gap_score: repeat score of the sequence after a row."""
    order = Window.partitionBy("qname").orderBy("qstart", "qend", "rstart")
    held = rows.withColumn("i", F.row_number().over(order))
    same = Window.partitionBy("qname", "chrom").orderBy("i")
    pairs = held.withColumn("j", F.lead("i").over(same)).withColumn("next_end", F.lead("rend").over(same))
    flank = pairs.where((F.col("j") - F.col("i") > 1) & (F.abs(F.col("next_end") - F.col("rstart")) < near) & (F.col("gap_score") > least_score)).select("qname", F.col("i").alias("a"), F.col("j").alias("b"))
    inner = held.alias("h").join(flank.alias("f"), "qname").where("h.i > f.a and h.i < f.b").where(F.col("mapq") < low_mapq).select("qname", "h.i").distinct()
    kept = held.join(inner, ["qname", "i"], "left_anti")
    left = kept.groupBy("qname").agg(F.count("*").alias("n")).join(flank.select("qname").distinct(), "qname").where("n <= 2").select("qname")
    return kept.join(left, "qname", "left_anti").drop("i")


def tandem_adjacent(rows: DataFrame, least_score: float = 0.2, two_bases: float = 0.9, low_mapq: int = 10) -> DataFrame:
    """CQ13: of contigs with a row of mapping quality 0: without those whose whole sequence scores as a repeat, and without
    poorly mapped rows of a repeated or two-base section whose doubled dinucleotide starts or ends a later, mapped row.

    rows: qname, qstart, qend, mapq, section, section_score, top_two, dinucleotide (both bases, doubled), contig_score.
    """
    zero = rows.where("mapq = 0").select("qname").distinct().withColumn("zero", F.lit(True))
    held = rows.join(zero, "qname", "left").withColumn("zero", F.coalesce("zero", F.lit(False))).where(~(F.col("zero") & (F.col("contig_score") > least_score)))
    held = held.withColumn("i", F.row_number().over(Window.partitionBy("qname").orderBy("qstart", "qend")))
    poor = held.where(F.col("zero") & (F.col("mapq") < low_mapq) & (F.col("section_score") > least_score) & (F.col("top_two") > two_bases)).select("qname", "i", "dinucleotide")
    later = held.where("mapq > 0").select("qname", F.col("i").alias("j"), F.col("section").alias("other"))
    unit, turned = F.col("dinucleotide"), F.reverse("dinucleotide")
    touch = F.startswith("other", unit) | F.endswith("other", unit) | F.startswith("other", turned) | F.endswith("other", turned)
    lost = poor.join(later, "qname").where((F.col("j") > F.col("i")) & touch).select("qname", "i").distinct()
    return held.join(lost, ["qname", "i"], "left_anti").drop("i", "zero")


def parse_contig_name(rows: DataFrame) -> DataFrame:
    """CQ14: sample and coverage out of `sample_..._cov`, and the length on the contig."""
    parts = F.split("qname", "_")
    return rows.withColumn("name_sample", F.element_at(parts, 1)).withColumn("name_cov", F.element_at(parts, -1).try_cast("double")).withColumn("qlength", F.col("qend") - F.col("qstart"))


def best_path(segments: list[tuple], length: float) -> tuple[list[int], float]:
    """Indices of the chain of (chrom, start, end, score), sorted by start, of the highest score less the costs of its jumps.
    All that may come before a segment are looked at together; of equal ones the last is taken, and a chain's begin before any."""
    n = len(segments)
    names = {c: k for k, c in enumerate(dict.fromkeys(s[0] for s in segments))}
    chrom = np.array([names[s[0]] for s in segments], int)
    start, end, score = (np.array([s[k] for s in segments], float) for k in (1, 2, 3))
    best, back = score - INSERTION * start, np.full(n, -1)
    for i in range(1, n):
        e = end[:i]
        fits = (start[i] > e - MAX_HOMOLOGY) & (end[i] > e + MIN_ALIGNED) & (start[i] - start[:i] > MIN_ALIGNED) & (start[i] - e <= MAX_INSERTION)
        j = np.flatnonzero(fits)[::-1]
        if not len(j):
            continue
        over = e[j] - start[i]
        through = best[j] - np.where(over >= 0, HOMOLOGY * over, -INSERTION * over) - np.where(chrom[j] == chrom[i], INTRA, INTER) + score[i]
        k = int(through.argmax())
        if through[k] > best[i]:
            best[i], back[i] = through[k], j[k]
    total = best - INSERTION * (length - end)
    i = int(total.argmax())
    path, top = [], float(total[i])
    while i >= 0:
        path.append(i)
        i = int(back[i])
    return path[::-1], top


def best_alignment_path(rows: DataFrame) -> DataFrame:
    """CQ15: qname, chrom, qstart, qend, score, path_score of the alignments on the best path over each contig.

    Contigs are sorted within their partitions and streamed through, so a task holds a batch and one contig at a time.
    """
    kind = dict(rows.dtypes)
    schema = f"qname {kind['qname']}, chrom {kind['chrom']}, qstart {kind['qstart']}, qend {kind['qend']}, score {kind['score']}, path_score double"
    columns = ["qname", "chrom", "qstart", "qend", "score", "qlen"]

    def chosen(segments: list[tuple]) -> list[tuple]:
        path, total = best_path([s[1:5] for s in segments], float(segments[0][5]))
        return [(*segments[i][:5], total) for i in path]

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for pdf in batches:
            out: list[tuple] = []
            for row in pdf.itertuples(index=False, name=None):
                if held and held[0][0] != row[0]:
                    out += chosen(held)
                    held = []
                held.append(row)
            yield pd.DataFrame(out, columns=[*columns[:5], "path_score"])
        if held:
            yield pd.DataFrame(chosen(held), columns=[*columns[:5], "path_score"])

    sorted_rows = rows.where("qname is not null").select(*columns).repartition("qname").sortWithinPartitions("qname", "qstart", "qend", "score", "chrom")
    return sorted_rows.mapInPandas(stream, schema)


def contig_segments(rows: DataFrame) -> DataFrame:
    """CQ16: stretches of each contig covered by no alignment (u), one (a) or several (h): qname, start, end, kind."""
    # rows are dealt out by name before they become events, which then need no other shuffle
    events = dealt_by(rows.select("qname", "qstart", "qend", "qlen"), "qname").select("qname", F.explode(F.array(F.struct(F.col("qstart").alias("at"), F.lit(1).alias("by")), F.struct(F.col("qend").alias("at"), F.lit(-1).alias("by")), F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("by")), F.struct(F.col("qlen").cast("long").alias("at"), F.lit(0).alias("by")))).alias("e"))
    step = events.groupBy("qname", "e.at").agg(F.sum("e.by").alias("by"))
    order = Window.partitionBy("qname").orderBy("at")
    cover = F.sum("by").over(order.rowsBetween(Window.unboundedPreceding, 0))
    kind = F.when(F.col("cover") == 0, "u").when(F.col("cover") == 1, "a").otherwise("h")
    runs = step.withColumn("cover", cover).withColumn("kind", kind).withColumn("end", F.lead("at").over(order)).where("end is not null")
    new = F.when(F.lag("kind").over(order).isNull() | (F.lag("kind").over(order) != F.col("kind")), 1).otherwise(0)
    held = runs.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return held.groupBy("qname", "run").agg(F.min("at").alias("start"), F.max("end").alias("end"), F.first("kind").alias("kind")).drop("run")


def microhomology_insertion(rows: DataFrame) -> DataFrame:
    """CQ17: overlap and gap between neighbouring alignments of a contig."""
    order = Window.partitionBy("qname").orderBy("qstart", "qend")
    gap = F.lag("qend").over(order) - F.col("qstart")
    held = rows.withColumn("x", gap).where("x is not null")
    return held.select("qname", "qstart", "qend", F.greatest("x", F.lit(0)).alias("microhomology"), F.greatest(-F.col("x"), F.lit(0)).alias("insertion"))


def telomere_proximity(rows: DataFrame, telomeres: DataFrame) -> DataFrame:
    """CQ18: distance of each row to the nearest telomere (chrom, t_start, t_end) of its chromosome; a few rows a chromosome."""
    near = F.broadcast(telomeres.groupBy("chrom").agg(F.collect_list(F.struct("t_start", "t_end")).alias("t")))
    least = F.array_min(F.transform("t", lambda x: F.greatest(F.lit(0), x["t_start"] - F.col("rend"), F.col("rstart") - x["t_end"])))
    return rows.join(near, "chrom", "left").withColumn("telomere_distance", least).drop("t")


def contig_alignment_filter(report: DataFrame, min_len: int, share: float) -> DataFrame:
    """CQ19: contigs (contig, length, aligned) of min_len and more that are aligned to more than `share` of their length."""
    return report.where((F.col("length") >= min_len) & (F.col("aligned") / F.col("length") > share))


def with_scores(rows: DataFrame, key: str) -> DataFrame:
    """SQ13 as a column of rows (key, seq)."""
    return rows.join(repeat_score(rows, key), key, "left").withColumn("repeat_score", F.coalesce("repeat_score", F.lit(0.0)))
