"""Writers (SNK1-SNK10)."""

from __future__ import annotations

import os
import re
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def by_folder(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by the columns that name its folders and sorted by them, so that a folder is one task's work and not a file of every task;
    Spark splits keys that are too large for one task again."""
    return df.hint("rebalance", *keys).sortWithinPartitions(*keys)


def folder_name(key: str, value: str | None) -> str:
    """The folder of a value, named as Spark does."""
    return f"{key}=" + re.sub("[\x01-\x1f\"#%'*/:=?\\\\\x7f{\\[\\]^]", lambda m: f"%{ord(m[0]):02X}", value or "__HIVE_DEFAULT_PARTITION__")


def write_folders(df: DataFrame, path: str, keys: list[str], form: str = "text", **options) -> None:
    """df as text or csv in a folder for each value of keys, one file a task and folder; the rows of a folder lie side by side in their task.

    On a file system that the driver and all executors share, the tasks open the files themselves: Hadoop starts a process there for each
    folder, file and checksum to set its mode, and the driver renames the folders one by one. Elsewhere Spark writes them. A file gets
    its name when it is whole, and a task that is tried again writes the same files.
    """
    spark = df.sparkSession
    whole = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = whole.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(whole).toString()
    found = re.fullmatch("file:(?://)?(/.*)", whole)
    if not found:
        df.write.partitionBy(*keys).options(**options).format(form).save(path)
        return
    root, end = found[1], {"text": ".txt", "csv": ".csv"}[form]
    rest = [c for c in df.columns if c not in keys]
    line = F.col(rest[0]) if form == "text" else F.to_csv(F.struct(*rest), {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()})
    first = options.get("sep", ",").join(rest) + "\n" if options.get("header") else ""

    def write(batches):
        task, out, last, files = TaskContext.get(), None, None, 0
        name = f"part-{task.partitionId():05d}{end}"

        def close():
            if out is not None:
                out.close()
                os.replace(out.name, os.path.join(os.path.dirname(out.name), name))

        for batch in batches:
            at, values = 0, batch.column(len(keys)).to_pylist()
            for key, same in groupby(zip(*(batch.column(i).to_pylist() for i in range(len(keys))), strict=True)):
                upto, folder = at + sum(1 for _ in same), os.path.join(root, *map(folder_name, keys, key))
                if folder != last:
                    close()
                    os.makedirs(folder, exist_ok=True)
                    out = open(os.path.join(folder, f".{name}-{task.taskAttemptId()}"), "w", encoding="utf-8", newline="")
                    out.write(first)
                    last, files = folder, files + 1
                out.writelines(f"{v or ''}\n" for v in values[at:upto])
                at = upto
        close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    os.makedirs(root)
    df.select(*(F.col(k).cast("string").alias(k) for k in keys), line.alias("line")).mapInArrow(write, "files long").agg(F.sum("files")).first()
    open(os.path.join(root, "_SUCCESS"), "w").close()


def write_bed(df: DataFrame, path: str, by: str = "sample") -> None:
    """SNK1: tab-separated rows, a folder for each sample."""
    write_folders(by_folder(df, by), path, [by], "csv", sep="\t")


def write_vcf(header: DataFrame, rows: DataFrame, path: str) -> None:
    """SNK2: VCF text by sample: header lines (sample, nth, value) first, then rows (sample, chrom, pos, value) in order."""
    lines = header.select("sample", F.lit(0).alias("part"), F.lit("").alias("chrom"), F.col("nth").cast("long").alias("pos"), "value").unionByName(rows.select("sample", F.lit(1).alias("part"), "chrom", "pos", "value"))
    # a file holds whole samples, so that the header stands once and on top
    write_folders(lines.repartition("sample").sortWithinPartitions("sample", "part", "chrom", "pos").select("sample", "value"), path, ["sample"])


def vcf_line(info: Column, prob: Column, su: Column) -> Column:
    """A VCF row of chrom, pos, sv_id and svtype."""
    fmt = F.concat(F.round(prob, 4).cast("string"), F.lit(":"), su.cast("string"))
    return F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.col("sv_id").cast("string"), F.lit("N"), F.concat(F.lit("<"), "svtype", F.lit(">")), F.lit("."), F.lit("."), info, F.lit("PROB:SU"), fmt)


def write_clusters_csv(stats: DataFrame, path: str) -> None:
    """SNK3: Chrom, Break_number, Size, Median_spacing, Break_pos by sample."""
    rows = stats.select("sample", F.col("chrom").alias("Chrom"), F.col("n_breaks").alias("Break_number"), F.col("size").alias("Size"), F.col("median_spacing").alias("Median_spacing"), F.col("positions").alias("Break_pos"))
    write_folders(by_folder(rows, "sample"), path, ["sample"], "csv", header=True)


def fasta_record(name: Column, seq: Column) -> Column:
    return F.concat(F.lit(">"), name, F.lit("\n"), seq)


def write_fasta(contigs: DataFrame, path: str) -> None:
    """SNK4: FASTA records, a folder for each sample."""
    write_folders(by_folder(contigs.select("sample", fasta_record(F.col("contig"), F.col("seq")).alias("value")), "sample"), path, ["sample"])


def write_fastq(reads: DataFrame, path: str) -> None:
    """SNK4: four-line records."""
    reads.select(F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value")).write.text(path)


def write_interleaved(reads: DataFrame, path: str) -> None:
    """SNK4: reads (pair, mate, name, seq, qual) as four-line records, the mates of a pair one after the other in one file."""
    record = F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "qual")
    mates = F.sort_array(F.collect_list(F.struct("mate", record.alias("record"))))
    reads.groupBy("pair").agg(F.array_join(F.transform(mates, lambda m: m["record"]), "\n").alias("value")).select("value").write.text(path)


def gfa_lines(edges: DataFrame, links: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """SNK5: lines of segments (edge, seq, raw_cov), links (a, a_orient, b, b_orient, overlap) and paths (path, ord, edge, orient)."""
    s = edges.select(F.concat_ws("\t", F.lit("S"), F.col("edge").cast("string"), "seq", F.concat(F.lit("KC:i:"), F.col("raw_cov").cast("long").cast("string"))).alias("value"))
    ln = links.select(F.concat_ws("\t", F.lit("L"), F.col("a").cast("string"), "a_orient", F.col("b").cast("string"), "b_orient", F.concat(F.col("overlap").cast("string"), F.lit("M"))).alias("value"))
    out = s.unionByName(ln)
    if paths is not None:
        steps = F.transform(F.sort_array(F.collect_list(F.struct("ord", F.concat(F.col("edge").cast("string"), "orient").alias("x")))), lambda p: p["x"])
        out = out.unionByName(paths.groupBy("path").agg(F.array_join(steps, ",").alias("x")).select(F.concat_ws("\t", F.lit("P"), F.col("path").cast("string"), "x", F.lit("*")).alias("value")))
    return out


def component_links(links: DataFrame, chosen: DataFrame) -> DataFrame:
    """SNK5: links of which both ends are chosen edges."""
    return links.join(chosen.select(F.col("edge").alias("a")), "a", "left_semi").join(chosen.select(F.col("edge").alias("b")), "b", "left_semi")


def write_gfa(edges: DataFrame, links: DataFrame, path: str, paths: DataFrame | None = None) -> None:
    gfa_lines(edges, links, paths).write.text(path)


def fastg_records(edges: DataFrame) -> DataFrame:
    """SNK6: FASTG records of edges (edge, src, dst, seq): `>id:next1,next2;`."""
    after = edges.select(F.col("edge").alias("next"), F.col("src").alias("dst"))
    nexts = edges.select("edge", "dst").join(after, "dst").groupBy("edge").agg(F.array_join(F.array_sort(F.collect_set(F.col("next").cast("string"))), ",").alias("nexts"))
    held = edges.join(nexts, "edge", "left")
    head = F.concat(F.lit(">"), F.col("edge").cast("string"), F.when(F.col("nexts").isNotNull(), F.concat(F.lit(":"), "nexts")).otherwise(""), F.lit(";"))
    return held.select(F.concat(head, F.lit("\n"), "seq").alias("value"))


def write_by_bin(contigs: DataFrame, annotation: DataFrame, path: str) -> None:
    """SNK7: FASTA records in a folder for each bin and sample."""
    rows = contigs.join(annotation.select("contig", "bin").distinct(), "contig")
    write_folders(by_folder(rows.select("bin", "sample", fasta_record(F.col("contig"), F.col("seq")).alias("value")), "bin", "sample"), path, ["bin", "sample"])


def annotation_lines(annotation: DataFrame) -> DataFrame:
    """SNK8: `contig<tab>bin bin ...`."""
    return annotation.groupBy("contig").agg(F.array_join(F.array_sort(F.collect_set("bin")), " ").alias("bins")).select(F.concat("contig", F.lit("\t"), "bins").alias("value"))


def contig_ids(contigs: DataFrame, component: bool = False) -> DataFrame:
    """SNK9: contigs named NODE_n_length_l_cov_c (and _component_k), numbered by falling length within their sample."""
    n = F.row_number().over(Window.partitionBy("sample").orderBy(F.desc(F.length("seq")), "contig"))
    name = F.concat(F.lit("NODE_"), n.cast("string"), F.lit("_length_"), F.length("seq").cast("string"), F.lit("_cov_"), F.format_string("%.6f", F.col("coverage")))
    if component:
        name = F.concat(name, F.lit("_component_"), F.col("component").cast("string"))
    return contigs.withColumn("name", name)


def write_kmers_fasta(kmers: DataFrame, path: str) -> None:
    """SNK10: records `>kmerN`; the numbers are unique, and rise within a file."""
    kmers.select(fasta_record(F.concat(F.lit("kmer"), F.monotonically_increasing_id().cast("string")), F.col("kmer")).alias("value")).write.text(path)
