"""Shared names of the operators: tables, words, and the scratch tables and components of the library's plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.plans.tables import components, forget, saved, scratch

__all__ = ["DOCUMENT_COLUMNS", "WORD", "components", "forget", "saved", "scratch", "table", "tucked", "untucked"]

#: A word is a maximal run of anything but these blanks.
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tucked(docs: DataFrame, **more: Column) -> DataFrame:
    """docs as one column `row`, beside further columns: whatever docs calls its own, no name clashes."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(v.alias(k) for k, v in more.items()))


def untucked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again."""
    return rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
