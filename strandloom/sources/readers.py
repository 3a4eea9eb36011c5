"""Readers (SRC1-SRC15). Text is scanned by Spark; nothing is opened on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions.seq import ref_span
from strandloom.plans.tables import saved

SAM_FIELDS = [("qname", "string"), ("flag", "int"), ("contig", "string"), ("pos", "long"), ("mapq", "int"), ("cigar", "string"), ("rnext", "string"), ("pnext", "long"), ("tlen", "long"), ("seq", "string"), ("qual", "string")]


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]+)$", 1)


def sample_of(path: Column) -> Column:
    """A file's name up to its first dot."""
    return F.substring_index(base_name(path), ".", 1)


def parent_of(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]+)/[^/]+$", 1)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"))


def read_vcf_sv(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: variants of VCF files: sample, typed columns, and all of INFO as a map; a missing key is null."""
    f = F.split("value", "\t")
    rows = _lines(spark, path).where(~F.startswith("value", F.lit("#")) & (F.col("value") != ""))
    held = rows.select(sample_of(F.col("path")).alias("sample"), f.alias("f"), F.str_to_map(f[7], F.lit(";"), F.lit("=")).alias("info"))
    fmt = F.map_from_arrays(F.split(F.get("f", F.lit(8)), ":"), F.split(F.get("f", F.lit(9)), ":"))
    held = held.withColumn("fmt", F.when(F.size("f") > 9, fmt))
    num = lambda c, kind: c.try_cast(kind)
    return held.select(
        "sample", F.col("f")[0].alias("chrom"), num(F.col("f")[1], "long").alias("pos"), F.col("f")[2].alias("id"), F.col("f")[3].alias("ref"), F.col("f")[4].alias("alt"),
        F.coalesce(num(F.col("info")["END"], "long"), num(F.col("f")[1], "long")).alias("stop"), F.col("info")["SVTYPE"].alias("svtype"), F.col("info")["CHR2"].alias("chr2"),
        num(F.col("info")["CHR2_POS"], "long").alias("chr2_pos"), num(F.col("info")["SVLEN"], "long").alias("svlen"), F.col("info")["CONTIGA"].alias("contiga"), F.col("info")["CONTIGB"].alias("contigb"),
        num(F.col("fmt")["PROB"], "double").alias("prob"), num(F.col("fmt")["SU"], "int").alias("su"), "info",
    )


def read_vcf_contigs(spark: SparkSession, path: str) -> DataFrame:
    """SRC2: name without `chr` and length of the ##contig lines; names with `_` are left out."""
    rows = _lines(spark, path).where(F.startswith("value", F.lit("##contig")))
    out = rows.select(F.regexp_replace(F.regexp_extract("value", "ID=([^,>]+)", 1), "^chr", "").alias("chrom"), F.regexp_extract("value", "length=([0-9]+)", 1).try_cast("long").alias("length"))
    return out.where(~F.contains("chrom", F.lit("_"))).distinct()


def _csv(spark: SparkSession, path: str, schema: str, sep: str, header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("sep", sep).option("header", header).csv(path)


BREAK_SCHEMA = "chrom1 string, start1 long, end1 long, chrom2 string, start2 long, end2 long, Sample string"


def read_sv_bed(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: tab-separated pairs of break regions with a header and their sample."""
    return _csv(spark, path, BREAK_SCHEMA, "\t").withColumnRenamed("Sample", "sample")


def read_chain_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC4: chain table: sample and two break regions, comma-separated."""
    return _csv(spark, path, "Sample string, " + BREAK_SCHEMA.removesuffix(", Sample string"), ",").withColumnRenamed("Sample", "sample")


def read_breaks_dir(spark: SparkSession, vcf: str | None, bed: str | None) -> DataFrame:
    """SRC4: breaks (sample, chrom, pos) of VCF and BED files; the BED rows of a sample replace its VCF rows."""
    out = None
    if vcf:
        sv = read_vcf_sv(spark, vcf)
        out = sv.select("sample", F.explode(F.array(F.struct("chrom", "pos"), F.struct(F.coalesce("chr2", "chrom").alias("chrom"), F.coalesce("chr2_pos", "stop").alias("pos")))).alias("b")).select("sample", "b.*")
    if bed:
        rows = read_sv_bed(spark, bed).select("sample", F.explode(F.array(F.struct(F.col("chrom1").alias("chrom"), F.col("start1").alias("pos")), F.struct(F.col("chrom2").alias("chrom"), F.col("end2").alias("pos")))).alias("b")).select("sample", "b.*")
        out = rows if out is None else out.join(rows.select("sample").distinct(), "sample", "left_anti").unionByName(rows)
    if out is None:
        raise ValueError("neither VCF nor BED files named")
    return out


def read_coverage_bed(spark: SparkSession, path: str) -> DataFrame:
    """SRC5: sample, chrom, start, end, coverage, gc, map of one BED file a sample; bins number the windows of a chromosome."""
    rows = spark.read.schema("chrom string, start long, end long, coverage double, gc int, map int").option("sep", "\t").csv(path)
    held = rows.select(sample_of(F.col("_metadata.file_path")).alias("sample"), "*")
    return held.withColumn("bin", F.floor(F.col("start") / (F.col("end") - F.col("start"))))


def read_sample_pairs(spark: SparkSession, path: str, tumour: str, value: str, normal: str) -> DataFrame:
    """SRC6: tumour, value, normal of a comma-separated table with a header."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(F.col(tumour).alias("tumour"), F.col(value).try_cast("double").alias("value"), F.col(normal).alias("normal"))


def read_sam(spark: SparkSession, path: str, secondary: bool = False) -> DataFrame:
    """SRC7: the eleven fields of SAM lines, sample and aligned length; header lines and, unless asked for, secondary alignments are skipped."""
    f = F.split("value", "\t")
    rows = _lines(spark, path).where(~F.startswith("value", F.lit("@")) & (F.size(f) >= 11))
    out = rows.select(sample_of(F.col("path")).alias("sample"), *(f[i].try_cast(kind).alias(name) for i, (name, kind) in enumerate(SAM_FIELDS)))
    return (out if secondary else out.where(F.col("flag").bitwiseAND(0x100) == 0)).withColumn("alen", ref_span("cigar"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """SRC8: sample (the parent folder), contig (the first word of its header), header and sequence of multi-line records, which begin
    with `>` at the start of a line."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value"), F.col("_metadata.file_path").alias("path"))
    rows = rows.where(F.trim(F.translate("value", "\r\n", "  ")) != "")
    header = F.rtrim(F.regexp_replace(F.substring_index("value", "\n", 1), "\r", ""))
    seq = F.regexp_replace(F.substring(F.col("value"), F.length(F.substring_index("value", "\n", 1)) + 2, F.length("value")), "[\\r\\n]", "")
    return rows.select(parent_of(F.col("path")).alias("sample"), F.substring_index(header, " ", 1).alias("contig"), header.alias("header"), seq.alias("seq"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, n, value: lines by number within their file, from 0."""
    lines, files = _numbered(spark, path)
    return lines.join(files, "file").select("path", "n", "value")


def _numbered(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Lines (file, n, value) and files (file, path): a file is told by the number of its first line, so that no line carries its path.

    Spark reads the splits of a file in order, so a line's number is its place in its task plus the lines of the tasks before.
    """
    rows = _lines(spark, path).withColumn("id", F.monotonically_increasing_id())
    rows = rows.withColumn("task", F.shiftright("id", 33)).withColumn("place", F.col("id").bitwiseAND((1 << 33) - 1))
    tasks = rows.groupBy("path", "task").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("lines"), F.min("id").alias("id"))
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("path").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    broken = F.raise_error(F.lit("the splits of a file are apart within a task"))
    tasks = tasks.withColumn("before", F.when(F.col("last") - F.col("first") + 1 == F.col("lines"), before).otherwise(broken.cast("long")))
    tasks = saved(tasks.withColumn("file", F.min("id").over(Window.partitionBy("path"))).select("path", "task", "first", "before", "file"), "file-splits")
    lines = rows.join(tasks, ["path", "task"]).select("file", (F.col("place") - F.col("first") + F.col("before")).alias("n"), "value")
    return lines, tasks.select("file", "path").distinct()


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """SRC9: sample, record, name, seq, qual of four-line records; anything else is an error. gz files are read as they are."""
    lines, files = _numbered(spark, path)
    field = lambda i: F.max(F.when(F.col("n") % 4 == i, F.col("value")))
    held = lines.groupBy("file", F.floor(F.col("n") / 4).alias("record")).agg(field(0).alias("head"), field(1).alias("seq"), field(2).alias("plus"), field(3).alias("qual"))
    held = held.join(files, "file")
    good = F.startswith("head", F.lit("@")) & F.startswith("plus", F.lit("+")) & (F.length("seq") == F.length("qual"))
    name = F.when(F.coalesce(good, F.lit(False)), F.substring_index(F.substring("head", 2, 1 << 30), " ", 1)).otherwise(F.raise_error(F.concat(F.lit("no four-line record in "), "path")))
    return held.select(sample_of(F.col("path")).alias("sample"), "record", name.alias("name"), "seq", "qual")


def interleaved(reads: DataFrame) -> DataFrame:
    """SRC10: reads (sample, record) as pairs: alternate records are left and right; an odd count is an error."""
    odd = reads.groupBy("sample").agg(F.count("*").alias("n")).where("n % 2 = 1")
    if not odd.isEmpty():
        raise ValueError("odd number of interleaved reads")
    return reads.withColumn("pair", F.floor(F.col("record") / 2)).withColumn("mate", (F.col("record") % 2 + 1).cast("int"))


def read_gfa(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SRC11: segments (edge, seq, len, raw_cov), links (a, a_orient, b, b_orient, overlap) and paths (path, ord, edge, orient)."""
    rows = _lines(spark, path).select(F.split("value", "\t").alias("f"))
    tag = F.regexp_extract(F.array_join("f", "\t"), "\tKC:i:([0-9]+)", 1).try_cast("long")
    seg = rows.where(F.col("f")[0] == "S").select(F.col("f")[1].alias("edge"), F.col("f")[2].alias("seq"), F.length(F.col("f")[2]).alias("len"), tag.alias("raw_cov"))
    link = rows.where(F.col("f")[0] == "L").select(F.col("f")[1].alias("a"), F.col("f")[2].alias("a_orient"), F.col("f")[3].alias("b"), F.col("f")[4].alias("b_orient"), F.regexp_extract(F.col("f")[5], "([0-9]+)M", 1).try_cast("int").alias("overlap"))
    path_ = rows.where(F.col("f")[0] == "P").select(F.col("f")[1].alias("path"), F.posexplode(F.split(F.col("f")[2], ",")).alias("ord", "x"))
    return seg, link, path_.select("path", "ord", F.expr("left(x, length(x) - 1)").alias("edge"), F.expr("right(x, 1)").alias("orient"))


def gfa_k(links: DataFrame) -> DataFrame:
    """SRC12: the overlap that all links share, or -1."""
    return links.agg(F.min("overlap").alias("a"), F.max("overlap").alias("b")).select(F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(-1).alias("k"))


def read_annotation(spark: SparkSession, path: str) -> DataFrame:
    """SRC13: distinct (contig, bin) of lines `contig<tab>bin bin ...`."""
    f = F.split("value", "\t")
    return _lines(spark, path).where(F.size(f) > 1).select(f[0].alias("contig"), F.explode(F.split(F.trim(f[1]), "\\s+")).alias("bin")).where("bin <> ''").distinct()


def read_profiles(spark: SparkSession, path: str, var: bool = False) -> DataFrame:
    """SRC14: contig, nth sample, abundance (and variance, where values and variances alternate)."""
    f = F.split(F.trim("value"), "\\s+")
    rows = _lines(spark, path).where(F.trim("value") != "").select(f[0].alias("contig"), F.posexplode(F.slice(f, 2, 1 << 30)).alias("i", "x")).withColumn("x", F.col("x").try_cast("double"))
    if not var:
        return rows.select("contig", F.col("i").alias("nth"), F.col("x").alias("abundance"))
    one = lambda r: F.max(F.when(F.col("i") % 2 == r, F.col("x")))
    return rows.groupBy("contig", F.floor(F.col("i") / 2).cast("int").alias("nth")).agg(one(0).alias("abundance"), one(1).alias("variance"))


def read_folders(spark: SparkSession, path: str, schema: str, key: str, **options) -> DataFrame:
    """Rows of csv files in folders key=value of path, with the value as a string; __HIVE_DEFAULT_PARTITION__ is null.

    The value is read off a file's path: discovering folders as partitions takes the driver time with the square of their number."""
    files = spark.read.schema(schema).options(recursiveFileLookup=True, **options).csv(path)
    plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    name = F.substring_index(F.substring_index(F.col("_metadata.file_path"), f"/{key}=", -1), "/", 1)
    # once for the path, once for the name of the folder
    value = F.when(F.contains(name, F.lit("%")), plain(plain(name))).when(name != "__HIVE_DEFAULT_PARTITION__", name)
    return files.select(*files.columns, value.alias(key))


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """SRC15: chrom, start, end, type of a BED file, with or without a header line."""
    rows = spark.read.schema("chrom string, start string, end string, type string").option("sep", "\t").csv(path)
    return rows.select("chrom", F.col("start").try_cast("long").alias("start"), F.col("end").try_cast("long").alias("end"), "type").where("start is not null")
