"""Column functions on sequences, CIGAR strings and alignment flags; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bases that a valid sequence may hold.
BASES = "ACGT"


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def complement(seq) -> Column:
    return F.translate(_col(seq), "ACGTacgt", "TGCAtgca")


def revcomp(seq) -> Column:
    return F.reverse(complement(seq))


def canonical(seq) -> Column:
    """The smaller of a sequence and its reverse complement."""
    return F.least(_col(seq), revcomp(seq))


def is_valid(seq) -> Column:
    return (F.length(_col(seq)) > 0) & ~_col(seq).rlike("[^ACGT]")


def acgt_runs(seq) -> Column:
    return F.regexp_extract_all(_col(seq), F.lit("([ACGT]+)"), 1)


def longest_run(seq) -> Column:
    """The longest ACGT run, the leftmost of equals; empty if there is none."""
    return F.aggregate(acgt_runs(seq), F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))


#: Bases by which chunks of a sequence advance; a window is cut out of its chunk, since substring() walks from the start.
CHUNK = 256


def chunks(seq, k: int) -> Column:
    """Pieces of CHUNK bases, each followed by the k - 1 bases after it; the last ones may be shorter. Linear in the sequence."""
    return F.regexp_extract_all(_col(seq), F.lit(f"(?=(.{{1,{CHUNK + k - 1}}})).{{1,{CHUNK}}}"), 1)


def windows_of(chunk, k: int) -> Column:
    """The windows of one chunk."""
    chunk = _col(chunk)
    return F.when(F.length(chunk) >= k, F.transform(F.sequence(F.lit(1), F.length(chunk) - (k - 1)), lambda i: F.substring(chunk, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def windows(seq, k: int) -> Column:
    """All windows of length k in order; none if the sequence is shorter. One array: for sequences of bounded length."""
    return F.flatten(F.transform(chunks(seq, k), lambda c: windows_of(c, k)))


def with_windows(rows: DataFrame, k: int, carry: tuple = (), name: str = "kmer", at: str | None = None) -> DataFrame:
    """A row for each window of k bases of `seq`, with columns `carry` and the window's offset as `at`.

    No row holds more than the windows of one chunk, so a sequence may be as long as a chromosome."""
    if at is None:
        cut = rows.select(*carry, F.explode(chunks("seq", k)).alias("chunk_"))
        return cut.select(*carry, F.explode(windows_of(F.col("chunk_"), k)).alias(name))
    cut = rows.select(*carry, F.posexplode(chunks("seq", k)).alias("n_", "chunk_"))
    each = cut.select(*carry, "n_", F.posexplode(windows_of(F.col("chunk_"), k)).alias("i_", name))
    return each.select(*carry, (F.col("n_") * CHUNK + F.col("i_")).alias(at), name)


def hamming(a, b) -> Column:
    """Positions at which two strings of equal length differ; null for unequal lengths. Linear in their length."""
    a, b = _col(a), _col(b)
    differ = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d))
    return F.when(F.length(a) != F.length(b), F.lit(None)).when(F.length(a) == 0, F.lit(0)).otherwise(differ)


def base_count(seq, base: str) -> Column:
    seq = _col(seq)
    return F.length(seq) - F.length(F.replace(seq, F.lit(base), F.lit("")))


def homopolymer_runs(seq) -> Column:
    runs = F.regexp_extract_all(_col(seq), F.lit("(A+|C+|G+|T+)"), 1)
    return F.transform(runs, lambda r: F.struct(F.substring(r, 1, 1).alias("nucl"), F.length(r).alias("len")))


def qualities(qual, offset: int = 33) -> Column:
    """Phred scores of a quality string. Linear in its length."""
    return F.coalesce(F.transform(F.filter(F.split(_col(qual), ""), lambda c: c != ""), lambda c: F.ascii(c) - offset), F.array().cast("array<int>"))


def cigar(text) -> Column:
    """array<struct<len:int, op:string>> of a CIGAR string; empty for `*`."""
    parts = F.regexp_extract_all(_col(text), F.lit("([0-9]+[MIDNSHP=X])"), 1)
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, "[0-9]+", 0).cast("int").alias("len"), F.substring(p, -1, 1).alias("op")))


def cigar_sum(ops: Column, kinds: str) -> Column:
    """Total length of the operations of the given kinds."""
    return F.aggregate(F.filter(ops, lambda x: x["op"].isin(*kinds)), F.lit(0), lambda a, x: a + x["len"])


def ref_span(text) -> Column:
    """Bases of the reference that an alignment covers."""
    return cigar_sum(cigar(text), "MDN=X")


def leading_clip(text) -> Column:
    return F.coalesce(F.regexp_extract(_col(text), "^([0-9]+)[SH]", 1).try_cast("int"), F.lit(0))


def trailing_clip(text) -> Column:
    return F.coalesce(F.regexp_extract(_col(text), "([0-9]+)[SH]$", 1).try_cast("int"), F.lit(0))


def has_flag(flag, bits: int) -> Column:
    """All of the bits are set."""
    return _col(flag).bitwiseAND(F.lit(bits)) == bits


def no_flag(flag, bits: int) -> Column:
    """None of the bits is set."""
    return _col(flag).bitwiseAND(F.lit(bits)) == 0


def is_aligned(flag) -> Column:
    return no_flag(flag, 4)


def is_main(flag) -> Column:
    """Neither secondary nor supplementary."""
    return no_flag(flag, 0x900)


def strand(flag) -> Column:
    return F.when(has_flag(flag, 16), "-").otherwise("+")
