"""Readers on files as other tools write them: literal texts of the published formats, not what our own writers give."""

import gzip

import pytest
from pyspark.sql import functions as F

from strandloom.sources import readers, writers


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode() if isinstance(text, str) else text)
    return f"file://{path}"


# the example of the SAM specification, with a secondary alignment and optional fields
SAM = """@HD\tVN:1.6\tSO:coordinate
@SQ\tSN:ref\tLN:45
@CO\ta comment\twith tabs\t1\t2\t3\t4\t5\t6\t7\t8\t9
r001\t99\tref\t7\t30\t8M2I4M1D3M\t=\t37\t39\tTTAGATAAAGGATACTG\t*
r002\t0\tref\t9\t30\t3S6M1P1I4M\t*\t0\t0\tAAAAGATAAGGATA\t*
r003\t0\tref\t9\t30\t5S6M\t*\t0\t0\tGCCTAAGCTAA\t*\tSA:Z:ref,29,-,6H5M,17,0;
r004\t0\tref\t16\t30\t6M14N5M\t*\t0\t0\tATAGCTTCAGC\t*
r003\t2064\tref\t29\t17\t6H5M\t*\t0\t0\tTAGGC\t*\tSA:Z:ref,9,+,5S6M,30,1;
r001\t147\tref\t37\t30\t9M\t=\t7\t-39\tCAGCGGCAT\t*\tNM:i:1
r005\t256\tref\t1\t0\t4M\t*\t0\t0\t*\t*
r006\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\tI@>#
"""


def test_sam_of_the_specification(spark, tmp_path):
    sam = readers.read_sam(spark, put(tmp_path, "toy.sorted.sam", SAM))
    assert rows(sam, "qname", "flag", "pos", "alen") == [("r001", 99, 7, 16), ("r001", 147, 37, 9), ("r002", 0, 9, 10), ("r003", 0, 9, 6), ("r003", 2064, 29, 5), ("r004", 0, 16, 25), ("r006", 4, 0, 0)]
    assert rows(sam.where("qname = 'r006'"), "sample", "contig", "cigar", "qual") == [("toy", "*", "*", "I@>#")]
    assert readers.read_sam(spark, f"file://{tmp_path}/toy.sorted.sam", secondary=True).count() == 8


def test_fasta_of_many_lines(spark, tmp_path):
    text = ">seq1 first > of two\nACGTacgtNN\nGGG\n\n>seq2\r\nTTTT\r\nCC\r\n>empty\n>last\nA"
    fasta = readers.read_fasta(spark, put(tmp_path, "s1/contigs.fa", text))
    assert rows(fasta, "sample", "contig", "header", "seq") == [("s1", "empty", "empty", ""), ("s1", "last", "last", "A"), ("s1", "seq1", "seq1 first > of two", "ACGTacgtNNGGG"), ("s1", "seq2", "seq2", "TTTTCC")]


def test_fastq_with_quality_lines_that_look_like_headers(spark, tmp_path):
    text = "@r1/1 lane 3\nACGT\n+\n@+>I\n@r2\nNN\n+r2\n!~\n"
    want = [("s", 0, "r1/1", "ACGT", "@+>I"), ("s", 1, "r2", "NN", "!~")]
    assert rows(readers.read_fastq(spark, put(tmp_path, "a/s.fastq", text)), "sample", "record", "name", "seq", "qual") == want
    packed = put(tmp_path, "b/s.fastq.gz", gzip.compress(text.replace("\n", "\r\n").encode()))
    assert rows(readers.read_fastq(spark, packed), "sample", "record", "name", "seq", "qual") == want
    with pytest.raises(Exception, match="four-line"):
        readers.read_fastq(spark, put(tmp_path, "c/s.fastq", "@r1\nACGT\n+\nII\n")).collect()


VCF = """##fileformat=VCFv4.2
##contig=<ID=chr1,length=248956422>
##contig=<ID=chr1_random,length=5>
##contig=<length=57227415,ID=chrY,assembly=x>
##INFO=<ID=SVTYPE,Number=1,Type=String,Description="a; b=c">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tNA1
1\t2827694\trs1\tCGTGGATGCGGGGAC\tC\t.\tPASS\tSVTYPE=DEL;END=2827708;HOMLEN=1;SVLEN=-14\tGT:GQ\t1/1:13.9
2\t321682\t.\tT\t<DEL>\t6\tPASS\tIMPRECISE;SVTYPE=DEL;END=321887;SVLEN=-205;CIPOS=-56,20\tGT:SU:PROB\t0/1:12:0.75
3\t9425916\t.\tC\t<INS:ME:L1>\t23\tPASS\tIMPRECISE;SVTYPE=INS;SVLEN=6027
4\t10\tb\tN\tN[5:77[\t.\t.\tSVTYPE=TRA;CHR2=5;CHR2_POS=77\tSU:PROB\t3:.
"""


def test_vcf_with_flags_and_symbolic_alleles(spark, tmp_path):
    path = put(tmp_path, "NA1.lumpy.vcf", VCF)
    vcf = readers.read_vcf_sv(spark, path)
    got = rows(vcf.withColumn("flag", F.map_contains_key("info", "IMPRECISE")), "sample", "chrom", "pos", "stop", "svtype", "svlen", "chr2", "chr2_pos", "prob", "su", "flag")
    assert got == [
        ("NA1", "1", 2827694, 2827708, "DEL", -14, None, None, None, None, False),
        ("NA1", "2", 321682, 321887, "DEL", -205, None, None, 0.75, 12, True),
        ("NA1", "3", 9425916, 9425916, "INS", 6027, None, None, None, None, True),
        ("NA1", "4", 10, 10, "TRA", None, "5", 77, None, 3, False),
    ]
    assert rows(readers.read_vcf_contigs(spark, path), "chrom", "length") == [("1", 248956422), ("Y", 57227415)]


def test_gfa_with_tags_comments_and_paths(spark, tmp_path):
    text = "H\tVN:Z:1.0\n# a comment\nS\t11\tACCTT\tDP:f:2.5\tKC:i:250\nS\t12\tTCAAGG\tKC:i:9\nS\t13\t*\tLN:i:6\nL\t11\t+\t12\t-\t4M\nL\t12\t-\t13\t+\t4M\nL\t11\t+\t13\t+\t*\nP\t14\t11+,12-,13+\t4M,4M\nP\tp_2\t13-\t*\n"
    seg, link, path = readers.read_gfa(spark, put(tmp_path, "graph.gfa", text))
    assert rows(seg, "edge", "seq", "raw_cov") == [("11", "ACCTT", 250), ("12", "TCAAGG", 9), ("13", "*", None)]
    assert {tuple(r) for r in link.collect()} == {("11", "+", "12", "-", 4), ("12", "-", "13", "+", 4), ("11", "+", "13", "+", None)}
    assert rows(path, "path", "ord", "edge", "orient") == [("14", 0, "11", "+"), ("14", 1, "12", "-"), ("14", 2, "13", "+"), ("p_2", 0, "13", "-")]
    assert readers.gfa_k(link).first().k == 4


def test_bed_with_and_without_a_header(spark, tmp_path):
    text = "#chrom\tchromStart\tchromEnd\ttype\nchr1\t0\t10000\ttelomere\nchrX\t156030895\t156040895\ttelomere\n"
    want = [("chr1", 0, 10000, "telomere"), ("chrX", 156030895, 156040895, "telomere")]
    assert rows(readers.read_regions(spark, put(tmp_path, "a.bed", text)), "chrom", "start", "end", "type") == want
    assert rows(readers.read_regions(spark, put(tmp_path, "b.bed", text.split("\n", 1)[1])), "chrom", "start", "end", "type") == want


def test_tables_of_bins_and_profiles(spark, tmp_path):
    notes = put(tmp_path, "bins.tsv", "NODE_1\tBIN1 BIN2\nNODE_2\t\nNODE_3\tBIN1\nNODE_1\tBIN2\n")
    assert rows(readers.read_annotation(spark, notes), "contig", "bin") == [("NODE_1", "BIN1"), ("NODE_1", "BIN2"), ("NODE_3", "BIN1")]
    profile = put(tmp_path, "p.tsv", "NODE_1 1.5\t0.25  3 0.5\n\nNODE_2  2 nan 0 1e-3\n")
    got = rows(readers.read_profiles(spark, profile, var=True).where("contig = 'NODE_1'"), "contig", "nth", "abundance", "variance")
    assert got == [("NODE_1", 0, 1.5, 0.25), ("NODE_1", 1, 3.0, 0.5)]
    assert readers.read_profiles(spark, profile).count() == 8


def test_a_sample_is_one_file_whatever_tasks_hold_its_rows(spark, tmp_path):
    rows = [(f"s{i % 5}", "chr1", i, i + 10) for i in range(200)]
    df = spark.createDataFrame(rows, "sample string, chrom string, start long, end long").repartition(7)
    writers.write_bed(df, f"file://{tmp_path}/bed")
    assert [len(list((tmp_path / "bed" / f"sample=s{i}").glob("part-*"))) for i in range(5)] == [1] * 5
    back = spark.read.schema("chrom string, start long, end long, sample string").option("sep", "\t").option("basePath", f"file://{tmp_path}/bed").csv(f"file://{tmp_path}/bed")
    assert sorted((r.sample, r.chrom, r.start, r.end) for r in back.collect()) == sorted(rows)
