"""Sequences and reads (SQ1-SQ30)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions.packed import with_codes
from strandloom.functions.seq import CHUNK, acgt_runs, chunks, hamming, homopolymer_runs, is_valid, longest_run, qualities, revcomp, windows_of, with_windows
from strandloom.operators.chunked import base_at, joined, patched, piece_of, pieces, within
from strandloom.plans.tables import dealt_by, saved

TURN = str.maketrans("ACGTacgt", "TGCAtgca")
# fixed values: mates of each library layout that are turned round to face forward
TURNED = {"FR": (2,), "RF": (1,), "FF": (), "RR": (1, 2)}


def with_rc(reads: DataFrame) -> DataFrame:
    """SQ2: each read and its reverse complement, with a `reverse` flag."""
    both = F.array(F.struct(F.lit(False).alias("reverse"), F.col("seq").alias("s")), F.struct(F.lit(True).alias("reverse"), revcomp("seq").alias("s")))
    return reads.withColumn("both", F.explode(both)).withColumn("reverse", F.col("both.reverse")).withColumn("seq", F.col("both.s")).drop("both")


def orient(reads: DataFrame, layout: str) -> DataFrame:
    """SQ3: reads with the mates of a layout turned to face forward."""
    turned = TURNED[layout]
    return reads.withColumn("seq", F.when(F.col("mate").isin(*turned), revcomp("seq")).otherwise(F.col("seq"))) if turned else reads


def valid_filter(reads: DataFrame, keep: Column | None = None) -> DataFrame:
    """SQ4: reads of ACGT only, or those that another predicate keeps."""
    return reads.where(is_valid("seq") if keep is None else keep)


def longest_valid(reads: DataFrame) -> DataFrame:
    """SQ5: each read cut to its longest ACGT run, the leftmost of equals; empty when there is none."""
    return reads.withColumn("seq", longest_run("seq"))


def split_on_ns(reads: DataFrame) -> DataFrame:
    """SQ6: one row for each ACGT run."""
    return reads.withColumn("runs", acgt_runs("seq")).select(*[c for c in reads.columns if c != "seq"], F.posexplode("runs").alias("part", "seq"))


def trim_quality(reads: DataFrame, q: int = 4) -> DataFrame:
    """SQ7: without bases at both ends that are N or of quality q and less; reads that end up empty are dropped."""
    phred = qualities("qual")
    good = F.transform(phred, lambda x, i: (x > q) & (F.substring("seq", i + 1, F.lit(1)) != "N"))
    first = F.array_position(good, True)
    last = F.size(good) + 1 - F.array_position(F.reverse(good), True)
    held = reads.withColumn("a", first).withColumn("b", last).where("a > 0")
    cut = lambda c: F.substring(F.col(c), F.col("a").cast("int"), (F.col("b") - F.col("a") + 1).cast("int"))
    return held.withColumn("seq", cut("seq")).withColumn("qual", cut("qual")).drop("a", "b")


def pair_reads(left: DataFrame, right: DataFrame) -> DataFrame:
    """SQ8: reads of two files paired by record number; a record that one of them lacks is an error when it is met."""
    side = lambda df, s: df.select("record", F.col("name").alias(f"{s}_name"), F.col("seq").alias(f"{s}_seq"), F.lit(True).alias(f"in_{s}"))
    both = side(left, "left").join(side(right, "right"), "record", "full")
    alone = F.raise_error(F.concat(F.lit("left and right reads differ at record "), F.col("record").cast("string")))
    met = F.when(F.col("in_left") & F.col("in_right"), F.lit(True)).otherwise(alone.cast("boolean"))
    return both.where(met).drop("in_left", "in_right")


def median_coverage_filter(reads: DataFrame, counts: DataFrame, k: int, least: int) -> DataFrame:
    """SQ9: read_id of reads (read_id, pair, seq) of which one mate has an upper median k-mer count of `least` or more; short reads have 0."""
    # reads are dealt out by name before their windows are made, so a window is never shuffled where its count is at hand
    dealt = dealt_by(reads.select("read_id", "pair", "seq"), "read_id")
    none = F.coalesce(F.length("seq"), F.lit(0)) < k
    parts = F.when(none, F.array(F.lit(None).cast("string"))).otherwise(chunks("seq", k))
    cut = dealt.select("read_id", "pair", F.explode(parts).alias("chunk"))
    each = F.when(F.col("chunk").isNull(), F.array(F.lit(None).cast("string"))).otherwise(windows_of("chunk", k))
    held = cut.select("read_id", "pair", F.explode(each).alias("kmer")).join(saved(counts.select("kmer", "n"), "window-counts"), "kmer", "left")
    # the upper median of the counts of a read, over its window multiplicities
    order = Window.partitionBy("read_id").orderBy(F.coalesce("n", F.lit(0)))
    ranked = held.withColumn("nth", F.row_number().over(order)).withColumn("of", F.count("*").over(Window.partitionBy("read_id")))
    middle = ranked.where(F.col("nth") == F.floor(F.col("of") / 2) + 1).select("read_id", "pair", F.coalesce("n", F.lit(0)).alias("median"))
    good = middle.groupBy("pair").agg(F.max("median").alias("m")).where(F.col("m") >= least)
    return reads.join(good, "pair", "left_semi")


def read_stats(reads: DataFrame, keys: list[str]) -> DataFrame:
    """SQ10: reads, longest read and nucleotides by library."""
    return reads.groupBy(*keys).agg(F.count("*").alias("n_reads"), F.max(F.length("seq")).alias("max_length"), F.sum(F.length("seq")).alias("total"))


def chunk_contigs(contigs: DataFrame, size: int, overlap: int = 0, min_length: int = 2000, merge_last: bool = False) -> DataFrame:
    """SQ11: contigs of min_length or more in chunks of `size`, named `contig_(start_end)`; merge_last: a short rest joins the last."""
    step, n = size - overlap, F.length("seq")
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))
    starts = F.filter(starts, lambda s: (s == 0) | (s + overlap < n))
    if merge_last:
        starts = F.filter(starts, lambda s: (s == 0) | (s + size <= n))
    rows = contigs.where(n >= min_length).select("contig", "seq", F.explode(starts).alias("s"), F.array_max(starts).alias("last"))
    end = F.when(F.col("s") == F.col("last"), F.length("seq")).otherwise(F.col("s") + size) if merge_last else F.least(F.col("s") + size, F.length("seq"))
    name = F.concat("contig", F.lit("_("), F.col("s").cast("string"), F.lit("_"), end.cast("string"), F.lit(")"))
    return rows.select(name.alias("contig"), F.substring(F.col("seq"), F.col("s") + 1, end - F.col("s")).alias("seq"))


def prefix_sample(contigs: DataFrame) -> DataFrame:
    """SQ12: contig names with their sample in front."""
    return contigs.withColumn("contig", F.concat("sample", F.lit("-"), "contig"))


def name_filter(contigs: DataFrame, names: DataFrame, retain: bool = True) -> DataFrame:
    """SQ12: only the named contigs, or all others."""
    return contigs.join(names.select("contig").distinct(), "contig", "left_semi" if retain else "left_anti")


def length_filter(contigs: DataFrame, least: int) -> DataFrame:
    """SQ12: contigs of at least so many bases."""
    return contigs.where(F.length("seq") >= least)


#: Letters up to which a sequence is read by one task; longer ones are dealt as windows.
WHOLE = 1 << 20


def repeat_score(seqs: DataFrame, key: str = "doc_id", ks=range(2, 10), whole: int = WHOLE) -> DataFrame:
    """SQ13: mean over k and positions i > k of exp(-d * gap) / exp(-d), d = 0.25 / k, gap: distance to the same k-mer before (0 if none).

    The last window of a sequence takes no part, neither with a score of its own nor as one before; without positions the score is 0.
    Equal windows lie in one sequence, so sequences of up to `whole` letters are scored where they are read, without a shuffle.
    """
    short = F.coalesce(F.length("seq") <= whole, F.lit(True))

    def score(texts: list[str | None]) -> dict:
        return {"repeat_score": [_repeat_mean(t or "", ks) for t in texts]}

    near = _by_sequence(seqs.where(short), key, score, {"repeat_score": "double"})
    return near.unionByName(_repeat_score_dealt(seqs.where(~short), key, ks))


def _by_sequence(seqs: DataFrame, key: str, make, columns: dict[str, str]) -> DataFrame:
    """key and the columns (name: type) that `make` gives for the texts of a batch."""
    kind, types = dict(seqs.dtypes)[key], {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                made = make(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(made[c], types[t]) for c, t in columns.items())], [key, *columns])

    return seqs.select(key, "seq").mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in ({key: kind} | columns).items()))


def _letters(text: str) -> tuple[np.ndarray, int]:
    """The letters of a text as numbers from 0 on, and how many there are."""
    names, codes = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_inverse=True)
    return codes.astype(np.int64), len(names)


def _gaps(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places with an equal number before them, and how far before."""
    small = codes.astype(np.uint16) if len(codes) and codes.max() < 1 << 16 else codes  # sorted by digits
    order = np.argsort(small, kind="stable")
    same = small[order[1:]] == small[order[:-1]]
    return order[1:][same], (order[1:] - order[:-1])[same]


def _longer(codes: np.ndarray, base: int, n: int, letters: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """From windows of k - 1 letters (numbers below `base`) those of k: equal numbers for equal windows; renumbered before they outgrow a long."""
    if base * n >= 1 << 62:
        names, codes = np.unique(codes, return_inverse=True)
        base = len(names)
    return codes[: len(letters) - k + 1] * n + letters[k - 1 :], base * n


def _repeat_mean(text: str, ks) -> float:
    letters, n = _letters(text)
    codes, base, total, places = letters, n, 0.0, 0
    for k in range(1, min(max(ks), len(text) - 1) + 1):
        if k > 1:
            codes, base = _longer(codes, base, n, letters, k)
        if k in ks:
            at, gap = _gaps(codes[:-1])
            total += float(np.exp(-0.25 / k * (gap[at > k] - 1)).sum())
            places += max(len(codes) - 2 - k, 0)
    return total / places if places else 0.0


def _repeat_score_dealt(seqs: DataFrame, key: str, ks) -> DataFrame:
    """The same for sequences of any length: every window a row, ordered within equal ones."""
    plain = ~F.col("seq").rlike("[^ACGT]")
    rows = _repeat_codes(seqs.where(plain), key, ks).unionByName(_repeat_texts(seqs.where(~plain), key, ks))
    gap = F.col("i") - F.lag("i").over(Window.partitionBy(key, "k", "kmer").orderBy("i"))
    score = F.when(gap.isNull(), 0.0).otherwise(F.exp(-0.25 / F.col("k") * (gap - 1)))
    found = rows.withColumn("score", score).where(F.col("i") > F.col("k")).groupBy(key).agg(F.avg("score").alias("repeat_score"))
    return seqs.select(key).distinct().join(found, key, "left").select(key, F.coalesce("repeat_score", F.lit(0.0)).alias("repeat_score"))


def _repeat_codes(seqs: DataFrame, key: str, ks) -> DataFrame:
    """key, k, i, kmer of sequences of ACGT: the windows of the longest k as numbers, of which the shorter ones are the first bases."""
    most = max(ks)
    padded = seqs.select(key, F.length("seq").alias("whole"), F.concat("seq", F.lit("A" * (most - min(ks)))).alias("seq"))
    rows = with_codes(padded, most, (key, "whole"), "i", spread=True)
    each = rows.select(key, "whole", "i", "kmer", F.explode(F.array(*map(F.lit, ks))).alias("k")).where("i < whole - k")
    return each.select(key, "k", F.col("i").cast("long").alias("i"), F.expr(f"shiftright(kmer, 2 * ({most} - k))").alias("kmer"))


def _repeat_texts(seqs: DataFrame, key: str, ks) -> DataFrame:
    """The same for sequences with other letters, by hashes of their windows."""
    cut = seqs.select(key, F.length("seq").alias("whole"), F.posexplode(chunks("seq", max(ks))).alias("n", "chunk"))

    def named(k: int) -> Column:
        last = F.least(F.lit(CHUNK), F.length("chunk") - (k - 1))
        each = F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(F.lit(k).alias("k"), (F.col("n") * CHUNK + i - 1).cast("long").alias("i"), F.xxhash64(F.substring(F.col("chunk"), i, F.lit(k))).alias("kmer")))
        return F.when(last >= 1, each).otherwise(F.array().cast("array<struct<k:int,i:bigint,kmer:bigint>>"))

    return cut.select(key, "whole", F.explode(F.flatten(F.array(*map(named, ks)))).alias("x")).select(key, "whole", "x.*").where("i < whole - k").drop("whole")


def kmer_repeat_profile(seqs: DataFrame, key: str = "doc_id", k: int = 17, whole: int = WHOLE) -> DataFrame:
    """SQ14: windows, distinct share, repeats, median and most common gap between equal windows, and windows whose reverse complement occurs too.

    As in repeat_score(), sequences of up to `whole` letters are told where they are read; sequences without a window give no row.
    """
    columns = {"n_windows": "bigint", "n_distinct": "bigint", "n_repeats": "bigint", "median_gap": "double", "modal_gap": "int", "n_reverse": "bigint"}

    def profile(texts: list[str]) -> dict:
        return dict(zip(columns, zip(*(_profile_of(t, k) for t in texts), strict=True), strict=True))

    near = _by_sequence(seqs.where(F.length("seq").between(k, whole)), key, profile, columns)
    far = _kmer_repeat_profile_dealt(seqs.where(F.length("seq") > whole), key, k)
    return near.unionByName(far)


def _profile_of(text: str, k: int) -> tuple:
    n = len(text) - k + 1
    letters, base = _letters(text + text.translate(TURN)[::-1])  # windows on both strands under the same numbers
    size = base
    codes = letters
    for j in range(2, k + 1):
        codes, base = _longer(codes, base, size, letters, j)
    own, turned = codes[:n], codes[len(text) : len(text) + n]
    _, gap = _gaps(own)
    sizes, times = np.unique(gap, return_counts=True)
    reverse = int(np.isin(own, turned).sum())  # a window's complement occurs where the window occurs on the other strand
    middle, modal = (float(np.median(gap)), int(sizes[times.argmax()])) if len(gap) else (None, None)
    return n, n - len(gap), len(gap), middle, modal, reverse


def _kmer_repeat_profile_dealt(seqs: DataFrame, key: str, k: int) -> DataFrame:
    """The same for sequences of any length: every window a row."""
    rows = with_windows(seqs, k, (key,), at="i")
    held = rows.withColumn("gap", F.col("i") - F.lag("i").over(Window.partitionBy(key, "kmer").orderBy("i")))
    basic = held.groupBy(key).agg(F.count("*").alias("n_windows"), F.count_if(F.col("gap").isNull()).alias("n_distinct"), F.count("gap").alias("n_repeats"), F.percentile("gap", 0.5).alias("median_gap"))
    gaps = held.where("gap is not null").groupBy(key, "gap").agg(F.count("*").alias("n"))
    mode = gaps.groupBy(key).agg(F.max(F.struct("n", (-F.col("gap")).alias("g"))).alias("m")).select(key, (-F.col("m.g")).alias("modal_gap"))
    other = rows.select(key, F.col("kmer").alias("rc")).distinct()
    turned = rows.withColumn("rc", revcomp("kmer")).join(other, [key, "rc"], "left_semi").groupBy(key).agg(F.count("*").alias("n_reverse"))
    return basic.join(mode, key, "left").join(turned, key, "left").withColumn("n_reverse", F.coalesce("n_reverse", F.lit(0)))


def split_scaffolds(contigs: DataFrame, min_n: int = 3) -> DataFrame:
    """SQ15: pieces of contigs between runs of min_n N and more."""
    pieces = F.posexplode(F.split("seq", f"N{{{min_n},}}"))
    return contigs.select("contig", pieces.alias("part", "seq")).where("seq <> ''")


def trim_ns(contigs: DataFrame) -> DataFrame:
    """SQ16: without N at the ends; contigs of nothing else are dropped."""
    return contigs.withColumn("seq", F.regexp_replace("seq", "^N+|N+$", "")).where("seq <> ''")


def break_by_pattern(contigs: DataFrame, pattern: str, max_cut: int = 150) -> DataFrame:
    """SQ17: ends cut at a pattern or its reverse complement within max_cut bases; contigs under 2 * max_cut are dropped."""
    turned = pattern[::-1].translate(str.maketrans("ACGT", "TGCA"))
    head, tail = F.substring("seq", 1, max_cut), F.reverse(F.expr(f"right(seq, {max_cut})"))
    last = lambda text, p: F.when(F.instr(F.reverse(text), p[::-1]) > 0, F.length(text) - F.instr(F.reverse(text), p[::-1]) + 1).otherwise(0)
    left = F.greatest(last(head, pattern), last(head, turned))
    right = F.greatest(last(tail, pattern[::-1]), last(tail, turned[::-1]))
    rows = contigs.where(F.length("seq") >= 2 * max_cut)
    return rows.withColumn("seq", F.substring(F.col("seq"), (left + 1).cast("int"), (F.length("seq") - left - right).cast("int")))


def pattern_filter(contigs: DataFrame, hits: DataFrame, pattern: str) -> DataFrame:
    """SQ18: contigs that reads (contig, seq) with the pattern map to."""
    return contigs.join(hits.where(F.contains("seq", F.lit(pattern))).select("contig").distinct(), "contig", "left_semi")


def zero_runs(contigs: DataFrame, spans: DataFrame, min0: int) -> DataFrame:
    """Stretches (contig, start, end) longer than min0 that no span (contig, start, end) covers."""
    size = contigs.select("contig", F.length("seq").cast("long").alias("n"))
    events = spans.select("contig", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("by")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("by")))).alias("e"))
    edge = size.select("contig", F.lit(0).cast("long").alias("at"), F.lit(0).alias("by")).union(size.select("contig", F.col("n"), F.lit(0)))
    step = events.select("contig", "e.at", "e.by").union(edge).groupBy("contig", "at").agg(F.sum("by").alias("by"))
    order = Window.partitionBy("contig").orderBy("at")
    held = step.withColumn("cover", F.sum("by").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("end", F.lead("at").over(order))
    return held.where((F.col("cover") == 0) & (F.col("end") - F.col("at") > min0)).select("contig", F.col("at").alias("start"), "end")


def break_by_coverage(contigs: DataFrame, spans: DataFrame, k: int = 100, min0: int = 50) -> DataFrame:
    """SQ19: pieces of contigs between stretches longer than min0 that no pair span covers; spans lose k / 2 at both ends."""
    inner = spans.withColumn("start", F.col("start") + k // 2).withColumn("end", F.col("end") - k // 2).where("start < end")
    size = contigs.select("contig", F.length("seq").cast("long").alias("n"))
    gaps = zero_runs(contigs, inner.join(size.select("contig"), "contig", "left_semi"), min0)
    cuts = gaps.union(size.select("contig", F.col("n"), F.col("n")))
    begin = F.coalesce(F.lag("end").over(Window.partitionBy("contig").orderBy("start", "end")), F.lit(0).cast("long"))
    pieces = cuts.withColumn("begin", begin).where("start > begin").select("contig", "begin", F.col("start").alias("stop"))
    return contigs.select("contig", "seq").join(pieces, "contig").select("contig", "begin", F.expr("substring(seq, cast(begin as int) + 1, cast(stop - begin as int))").alias("seq"))


def postprocess(contigs: DataFrame, hits: DataFrame, spans: DataFrame, pattern: str, least: int = 1500, max_cut: int = 150) -> DataFrame:
    """SQ20: SQ18, SQ19, SQ17 and SQ15 in turn, then contigs of `least` bases and more."""
    out = break_by_coverage(pattern_filter(contigs, hits, pattern), spans)
    out = out.select(F.concat("contig", F.lit("_"), F.col("begin").cast("string")).alias("contig"), "seq")
    return length_filter(split_scaffolds(break_by_pattern(out, pattern, max_cut)), least)


def consensus_quality(contigs: DataFrame, bases: DataFrame) -> DataFrame:
    """SQ21: a quality string for each contig: the mean quality of read bases (contig, pos, base, phred) that agree with it, `!` where
    none does. Only positions with read bases become rows; the others are filled in by piece. Empty contigs give no row."""
    sums = bases.groupBy("contig", "pos", "base").agg(F.sum("phred").alias("s"), F.count("phred").alias("n"))
    mean = base_at(sums, contigs, name="own").where("own = base").select("contig", "pos", F.floor(F.col("s") / F.col("n")).cast("int").alias("q"))
    at = F.col("pos") - 1
    marks = mean.select("contig", piece_of(at).alias("piece"), F.struct(within(at).alias("at"), F.char(F.col("q") + 33).alias("new")).alias("c")).groupBy("contig", "piece").agg(F.sort_array(F.collect_list("c")).alias("marks"))
    held = pieces(contigs).select("contig", "piece", F.repeat(F.lit("!"), F.length("bases")).alias("blank")).join(marks, ["contig", "piece"], "left")
    return joined(held.select("contig", "piece", F.when(F.col("marks").isNull(), F.col("blank")).otherwise(patched(F.col("blank"), F.col("marks"))).alias("quality")), "quality", "contig")


def subsample_to_coverage(reads: DataFrame, info: DataFrame, max_cov: float = 100.0, seed: str = "0") -> DataFrame:
    """SQ22: reads of the chosen samples (sample, coverage), thinned so that their coverage sums to max_cov; mates share read_id and fate."""
    share = F.least(F.lit(1.0), max_cov / F.col("total"))
    total = info.agg(F.sum("coverage").alias("total")).select(share.alias("share"))
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("read_id").cast("string"))), 1, 8), 16, 10).cast("double") / 2**32
    return reads.join(info.select("sample"), "sample", "left_semi").join(F.broadcast(total)).where(draw < F.col("share")).drop("share")


def best_overlap(pairs: DataFrame, max_overlap: int, min_score: float, short: int = 0, share: float = 0.05) -> DataFrame:
    """SQ24: the overlap of a suffix of `left` and a prefix of `right` of the best share of equal bases above min_score, the longest of equals.

    Where `dist`, the estimated distance, is negative, overlaps may be as much longer than max_overlap, and are not shorter than `share`
    of it (rounded, 1 at least). Overlaps under `short` count only where no longer one does.
    """
    dist = F.least(F.col("dist"), F.lit(0)) if "dist" in pairs.columns else F.lit(0)
    longest = F.least(F.length("left"), F.length("right"), F.lit(max_overlap) - dist).cast("int")
    least = F.greatest(F.lit(1), F.round(-dist * share)).cast("int")
    rows = pairs.withColumn("a_", least).withColumn("b_", longest).where("a_ <= b_").withColumn("l", F.explode(F.sequence("a_", "b_")))
    a, b = F.expr("right(left, l)"), F.expr("substring(right, 1, l)")
    score = 1 - hamming(a, b) / F.col("l")
    best = F.max(F.struct((F.col("l") >= short).alias("long"), F.col("score"), F.col("l"))).alias("b")
    return rows.withColumn("score", score).where(F.col("score") > min_score).groupBy("pair").agg(best).select("pair", F.col("b.l").alias("overlap"), F.col("b.score").alias("score"))


def overlap_score(a, b) -> Column:
    """SQ23: share of equal bases of two strings of one length."""
    return 1 - hamming(a, b) / F.length(a if isinstance(a, Column) else F.col(a))


def run_lengths(seqs: DataFrame, key: str = "doc_id") -> DataFrame:
    """SQ26: homopolymer runs of each sequence, by base and length."""
    return seqs.select(key, F.explode(homopolymer_runs("seq")).alias("r")).groupBy("r.nucl", "r.len").agg(F.count("*").alias("n"))


def group_read_files(files: DataFrame) -> DataFrame:
    """SQ27: file names grouped by barcode: the name without R1/R2 and lane; groups of two mates."""
    base = F.regexp_extract("path", "([^/]+)$", 1)
    mate = F.regexp_extract(base, "_R([12])", 1)
    barcode = F.regexp_replace(F.regexp_replace(base, "_R[12]", ""), "_L0*(1[0-9]|[1-9])(?![0-9])", "")
    rows = files.select("path", barcode.alias("barcode"), mate.alias("mate")).where("mate <> ''")
    return rows.groupBy("barcode").agg(F.count("*").alias("n_files"), F.count_distinct("mate").alias("n_mates")).where("n_mates = 2")


def merge_overlapping(parts: DataFrame, overlap: int) -> DataFrame:
    """SQ28: path, seq: sequences of the edges of a path (path, ord, seq) joined with a fixed overlap."""
    ordered = F.sort_array(F.collect_list(F.struct("ord", "seq")))
    rest = F.transform("p", lambda x, i: F.when(i == 0, x["seq"]).otherwise(F.substring(x["seq"], F.lit(overlap + 1), F.length(x["seq"]))))
    return parts.groupBy("path").agg(ordered.alias("p")).select("path", F.array_join(rest, "").alias("seq"))


def correction_report(base: DataFrame, corrected: DataFrame, shift: int = 15) -> DataFrame:
    """SQ29: reads (id, ref_start, ref_end, distance) before and after correction: comparable, improved, corrupted, fully fixed, mean distances and gain."""
    a = base.select("id", F.col("ref_start").alias("s0"), F.col("ref_end").alias("e0"), F.col("distance").alias("d0"))
    both = a.join(corrected.select("id", F.col("ref_start").alias("s1"), F.col("ref_end").alias("e1"), F.col("distance").alias("d1")), "id")
    close = both.where((F.abs(F.col("s0") - F.col("s1")) < shift) & (F.abs(F.col("e0") - F.col("e1")) < shift))
    return close.agg(
        F.count("*").alias("comparable"), F.count_if(F.col("d1") < F.col("d0")).alias("improved"), F.count_if(F.col("d1") > F.col("d0")).alias("corrupted"),
        F.count_if((F.col("d1") == 0) & (F.col("d0") > 0)).alias("fixed"), F.avg("d0").alias("mean_before"), F.avg("d1").alias("mean_after"), (F.sum(F.col("d0") - F.col("d1")) / F.sum("d0")).alias("gain"),
    )


def collect_labelled(contigs: DataFrame) -> DataFrame:
    """SQ30: contigs (path, contig, seq) of many files, named with the cutoff and kind that their file name holds (`kind_cutoff.fasta`)."""
    base = F.regexp_extract("path", "([^/]+)$", 1)
    return contigs.select(F.concat("contig", F.lit("_cutoff_"), F.regexp_extract(base, "_([0-9]+)\\.", 1), F.lit("_type_"), F.regexp_extract(base, "^([a-z]+)", 1)).alias("contig"), "seq")


