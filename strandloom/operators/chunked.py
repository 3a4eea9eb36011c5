"""A sequence as rows of fixed pieces: positions meet the piece they lie in, and no plan carries a whole sequence to what it is joined with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bases of a piece.
SIZE = 512


def pieces(seqs: DataFrame, lap: int = 0, key: str = "contig", size: int = SIZE) -> DataFrame:
    """key, piece, bases: piece n holds the bases from n * size (counted from 0) on, and `lap` bases of what follows."""
    each = F.regexp_extract_all("seq", F.lit(f"(?s)(?=(.{{1,{size + lap}}})).{{1,{size}}}"), 1)
    return seqs.select(key, F.posexplode(each).alias("piece", "bases")).withColumn("piece", F.col("piece").cast("long"))


def lengths(seqs: DataFrame, key: str = "contig") -> DataFrame:
    return seqs.select(key, F.length("seq").cast("long").alias("length"))


def piece_of(pos: Column | str, size: int = SIZE) -> Column:
    """The piece of a position counted from 0."""
    return F.floor((F.col(pos) if isinstance(pos, str) else pos) / size)


def within(pos: Column | str, size: int = SIZE) -> Column:
    """The place of a position (counted from 0) in its piece, counted from 1."""
    return (F.pmod(F.col(pos) if isinstance(pos, str) else pos, F.lit(size)) + 1).cast("int")


def base_at(rows: DataFrame, seqs: DataFrame, pos: str = "pos", name: str = "base", size: int = SIZE) -> DataFrame:
    """rows (contig, pos counted from 1) with the base of their contig there; rows beyond it are dropped."""
    at = F.col(pos) - 1
    held = rows.withColumn("piece", piece_of(at, size)).join(pieces(seqs, size=size), ["contig", "piece"])
    return held.withColumn(name, F.substring(F.col("bases"), within(at, size), F.lit(1))).where(F.col(name) != "").drop("piece", "bases")


def stretches(rows: DataFrame, seqs: DataFrame, start: str = "start", end: str = "end", size: int = SIZE) -> DataFrame:
    """rows (contig, start, end counted from 0) as one row for each piece they touch: piece, from_ and upto_ (the part of the stretch on it), bases of that part."""
    cut = rows.where(F.col(end) > F.col(start)).withColumn("piece", F.explode(F.sequence(piece_of(start, size), piece_of(F.col(end) - 1, size))))
    held = cut.join(pieces(seqs, size=size), ["contig", "piece"])
    held = held.withColumn("from_", F.greatest(F.col(start), F.col("piece") * size)).withColumn("upto_", F.least(F.col(end), (F.col("piece") + 1) * size))
    return held.withColumn("bases", F.substring(F.col("bases"), within("from_", size), (F.col("upto_") - F.col("from_")).cast("int")))


def patched(chunk: Column, changes: Column) -> Column:
    """A text with the (at, new) of an array, sorted by `at` (counted from 1), in place of its letters there."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    step = lambda acc, x: F.struct(F.concat(acc["text"], F.substring(chunk, acc["at"] + 1, x["at"] - acc["at"] - 1), x["new"]).alias("text"), x["at"].alias("at"))
    done = F.aggregate(changes, start, step, lambda acc: F.concat(acc["text"], F.substring(chunk, acc["at"] + 1, F.length(chunk))))
    return F.when(F.size(changes) > 0, done).otherwise(chunk)


def joined(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """keys, text: the pieces of a key put together; for the sink."""
    parts = F.sort_array(F.collect_list(F.struct("piece", F.col(text).alias("t"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias(text))
