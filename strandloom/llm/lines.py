"""Line dedup: of equal lines, those of the smallest doc_id stay.

Fingerprints of lines are range-partitioned by (line, document) and sorted by document and position, so that a common line
spreads over as many partitions as it fills. Every partition streams its rows and holds one fingerprint and one document: what
stands behind the first document of its line goes. Whether a partition's first line began before it is told by a row of
bounds for each partition. What comes out are compressed bitmaps of the lines that stay, one for each text, not texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strandloom.llm.common import forget, saved, table, tucked, untucked

#: Code points from which on a line counts.
LEAST = 10
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: One row for each line that goes (0) or goes if its line began in an earlier partition (1); one of bounds for each partition (2).
MARK = "pid int, kind int, no_id boolean, doc_id long, print binary, pos int, h1 binary, doc1 long, none1 boolean, h2 binary, doc2 long, none2 boolean"


def _text(docs: DataFrame):
    return F.coalesce(docs["text"], F.lit(""))


def _print(text):
    """16 bytes that tell texts of one doc_id apart."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _lines(text):
    return F.split(text, "\n", -1)


def _named(docs: DataFrame) -> DataFrame:
    """no_id, doc_id, print, text: ids that are null come after all others, as one id."""
    text = _text(docs)
    return docs.select(docs["doc_id"].isNull().alias("no_id"), F.coalesce(docs["doc_id"].cast("long"), F.lit(0).cast("long")).alias("doc_id"), _print(text).alias("print"), text.alias("text"))


def line_keys(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """no_id, doc_id, print, pos, h: the fingerprint of every line of at least `least` code points, blanks stripped and A-Z lower-cased."""
    each = _named(docs).select("no_id", "doc_id", "print", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    key = F.translate(F.btrim(F.col("line"), F.lit(BLANKS)), UPPER, LOWER)
    return each.select("no_id", "doc_id", "print", "pos", key.alias("key")).where(F.length("key") >= least).select("no_id", "doc_id", "print", "pos", _print(F.col("key")).alias("h"))


def _fixed(column: pa.Array) -> np.ndarray:
    """The 16 bytes of each row, as rows of two numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 2)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one partition; memory holds a batch, and the line and document that came first."""
    pid, first, line, doc, none = TaskContext.get().partitionId(), None, None, 0, False
    types = [("pid", pa.int32()), ("kind", pa.int32()), ("no_id", pa.bool_()), ("doc_id", pa.int64()), ("print", pa.binary()), ("pos", pa.int32())]
    types += [("h1", pa.binary()), ("doc1", pa.int64()), ("none1", pa.bool_()), ("h2", pa.binary()), ("doc2", pa.int64()), ("none2", pa.bool_())]
    schema = pa.schema(types)
    for b in batches:
        if not b.num_rows:
            continue
        h, docs, nones = _fixed(b.column("h")), b.column("doc_id").to_numpy(), b.column("no_id").to_numpy(zero_copy_only=False)
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]).any(1)
        new[0] = line is None or bool((h[0] != line).any())
        if first is None:
            first = (h[0].copy(), int(docs[0]), bool(nones[0]))
        start = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
        least_doc, least_none = np.where(start >= 0, docs[start], doc), np.where(start >= 0, nones[start], none)
        behind = (docs != least_doc) | (nones != least_none)
        open_ = (h == first[0]).all(1) & ~behind
        rows = np.flatnonzero(behind | open_)
        if len(rows):
            take = pa.array(rows)
            n = len(rows)
            told = [pa.array(np.full(n, pid, np.int32)), pa.array(open_[rows].astype(np.int32)), *(b.column(c).take(take) for c in ("no_id", "doc_id", "print", "pos"))]
            yield pa.RecordBatch.from_arrays([*told, *(pa.nulls(n, t) for _, t in types[6:])], schema=schema)
        line, doc, none = h[-1].copy(), int(least_doc[-1]), bool(least_none[-1])
    if line is not None:
        bounds = [pid, 2, None, None, None, None, first[0].tobytes(), first[1], first[2], line.tobytes(), doc, none]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, (_, t) in zip(bounds, types, strict=True)], schema=schema)


def _carried(marks: DataFrame) -> DataFrame:
    """pid of the partitions whose first line began in an earlier one, and not with the same document."""
    order = Window.orderBy("pid")  # one row a partition
    bounds = marks.where("kind = 2")
    joins = F.lag("h2").over(order) == F.col("h1")
    passes = F.coalesce(joins, F.lit(False)) & (F.col("h1") == F.col("h2"))
    own = F.when(~passes, F.struct("none2", "doc2"))
    held = bounds.select("pid", "none1", "doc1", joins.alias("joins"), own.alias("own")).withColumn("least", F.last("own", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    return held.where("joins and (least.none2 <> none1 or least.doc2 <> doc1)").select("pid")


def _bitmaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keep, dropped = [], []
        for n, at in zip(pdf["n_lines"], pdf["at"], strict=True):
            at = [] if at is None else np.asarray(at, np.int64)
            bits = np.ones(n, bool)
            bits[at] = False
            keep.append(zlib.compress(np.packbits(bits).tobytes(), 1))
            dropped.append(len(at))
        yield pdf.drop(columns="at").assign(n_dropped=dropped, keep=keep)


def line_bitmaps(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """no_id, doc_id, print, n_lines, n_dropped, keep: for each text of a doc_id the zlib-compressed bits (from the high bit) of its lines that stay.

    Null and empty texts are one empty line. Rows with one doc_id are one document, so their lines don't drop each other; a null
    doc_id is one id that comes after all others. Repeated rows have one bitmap. Empty tables give none.
    """
    keys = saved(line_keys(docs, least), "line-keys")
    order = ["h", "no_id", "doc_id", "print", "pos"]
    dealt = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    marks = saved(dealt.mapInArrow(_streamed, MARK), "line-marks")
    forget(keys)
    gone = marks.where("kind = 0").select("no_id", "doc_id", "print", "pos").union(marks.where("kind = 1").join(_carried(marks), "pid").select("no_id", "doc_id", "print", "pos"))
    at = gone.groupBy("no_id", "doc_id", "print").agg(F.collect_set("pos").alias("at"))
    texts = _named(docs).select("no_id", "doc_id", "print", F.size(_lines(F.col("text"))).alias("n_lines")).distinct()
    held = texts.join(at, ["no_id", "doc_id", "print"], "left")
    out = saved(held.mapInPandas(_bitmaps, "no_id boolean, doc_id long, print binary, n_lines int, n_dropped int, keep binary"), "line-bitmaps")
    forget(marks)
    return out


@F.pandas_udf(T.StringType())
def kept_text(text: pd.Series, keep: pd.Series, n: pd.Series) -> pd.Series:
    """Texts without the lines that their bitmaps drop."""
    out = []
    for t, k, c in zip(text, keep, n, strict=True):
        bits = np.unpackbits(np.frombuffer(zlib.decompress(k), np.uint8), count=c)
        out.append(t if bits.all() else "\n".join(x for x, b in zip(t.split("\n"), bits, strict=True) if b))
    return pd.Series(out, dtype=object)


def _met(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """row, text, bits.*: docs beside their bitmaps."""
    text = _text(docs)
    named = tucked(docs, text=text, no_id=docs["doc_id"].isNull(), doc_id=F.coalesce(docs["doc_id"].cast("long"), F.lit(0).cast("long")), print=_print(text))
    return named.join(bitmaps, ["no_id", "doc_id", "print"])


def dedup_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs, every row once, with `text` cut down to the lines that stay; null texts become empty. Other columns, whatever their names, are kept."""
    met = _met(docs, line_bitmaps(docs, least))
    row = F.col("row").withField("text", kept_text("text", "keep", "n_lines"))
    return untucked(met.select(row.alias("row")), docs)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    met = _met(docs, line_bitmaps(docs))
    digest = F.sha2(kept_text("text", "keep", "n_lines"), 256)
    return met.select(F.col("row.doc_id").alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), digest.alias("kept_sha256"))


ORACLE = r"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents
), k as (
  select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l
), f as (select key, min(doc_id) as least from k where length(key) >= 10 group by key having count(distinct doc_id) > 1),
d as (select k.doc_id, k.pos, k.line, f.least is not null and k.doc_id > f.least as gone from k left join f on k.key = f.key)
select doc_id, count(*) as n_lines, cast(count(*) filter (gone) as bigint) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256 from d group by doc_id
"""
