"""Substring dedup by suffix arrays in a logarithmic family of indexes: bytes covered by 200-byte strings that occur twice.

Sampled suffixes stand for all of them: every 200-byte string holds, at a place that its content alone decides (the least
hash of its 32-byte strings), the start of a sampled suffix. A suffix array is a table of the distinct beginnings of such
suffixes, in the order of their bytes within buckets, each with the number of suffixes that begin so and the place of the first.
Documents arrive in batches; the array of a batch is merge-scanned against every level of the family, and levels of equal size
merge into one of twice the size. Suffixes that begin alike are then compared with all that surrounds them.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.arrays import BYTE, U, mix, rolled
from strandloom.llm.common import forget, saved, table
from strandloom.llm.manifests import Manifests
from strandloom.llm.repeats import ROW, marked, removed, row_maker, settle
from strandloom.plans.tables import shared_dir

WINDOW, BEGINNING, BATCHES = 200, 32, 4


def byte_units(data: np.ndarray, offs: np.ndarray):
    return BYTE[data], offs, None, None


def anchors(values: np.ndarray, first: np.ndarray, s: np.ndarray, width: int = WINDOW, k: int = BEGINNING) -> tuple[np.ndarray, np.ndarray]:
    """(start of the sampled suffix in each window, hash of its beginning); of equal hashes the leftmost."""
    prints = rolled(values, k)
    low = U((1 << 31) - 1)
    least = (mix(prints) & ~low) | np.arange(len(prints)).astype(U)
    span, n = 1, width - k + 1
    while 2 * span <= n:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    at = (np.minimum(least[s], least[s + n - span]) & low).astype(np.int64)
    return at, prints[at]


class Family:
    """Levels of suffix arrays, tables bucketed and sorted by the bytes of `head`; level i holds 2**i batches.

    The levels and the batches they hold are a versioned state in the shared folder, named after the family, so that a later session
    can open it by its name and add more batches. A batch, with all merges it leads to, becomes part of the family in one step, when its
    state is published; a writer that died before leaves only tables that no state names, which the next batch drops. A family has one
    writer at a time: of two, the second to publish fails, and its batch is none.
    """

    def __init__(self, spark: SparkSession, buckets: int, name: str | None = None):
        self.spark, self.buckets, self.name = spark, buckets, name or f"suffixes_{uuid.uuid4().hex[:12]}"
        self.versions = Manifests(spark, f"{shared_dir(spark)}/families/{self.name}")
        self._open()

    def _open(self) -> None:
        state = self.versions.newest() or {"version": 0, "levels": {}, "batches": {}}
        self.version, self.batches = state["version"], state["batches"]
        self.levels = {int(k): t for k, t in state["levels"].items()}

    def _write(self, df: DataFrame, level: int) -> str:
        name = f"{self.name}_l{level}_{uuid.uuid4().hex[:8]}"
        df.write.bucketBy(self.buckets, "head").sortBy("head").option("compression", "zstd").format("parquet").saveAsTable(name)
        return name

    def sweep(self) -> None:
        """Drop the tables of the family that its state doesn't name."""
        for t in self.spark.catalog.listTables(pattern=f"{self.name}_l*"):
            if t.name not in self.levels.values():
                self.spark.sql(f"drop table if exists {t.name}")

    def add(self, suffixes: DataFrame, key: str | None = None) -> DataFrame:
        """Index a batch of (head, doc_id, at); the heads of it that occur twice in the batch or in a level as well.

        key: the name of the batch. A batch that is in the family already is not added again; its heads are told as they were."""
        self._open()
        if key is not None and key in self.batches:
            return self.spark.read.schema("head binary").parquet(self.batches[key])
        self.sweep()
        place = F.min(F.struct("doc_id", "at")).alias("place")
        level, new = 0, self._write(suffixes.groupBy("head").agg(F.count("*").alias("n"), place), 0)
        array = self.spark.table(new)
        hits = array.where("n > 1").select("head")
        for old in self.levels.values():
            # both sides are sorted in equal buckets: the join is one merge of two suffix arrays, without a shuffle
            hits = hits.union(self.spark.table(old).select("head").hint("merge").join(array.select("head"), "head"))
        hits = saved(hits, "suffixes-scan")
        levels, spent = dict(self.levels), []
        while level in levels:
            old = levels.pop(level)
            a, b = (self.spark.table(t).select("head", F.col("n").alias(f"n_{s}"), F.col("place").alias(f"p_{s}")) for s, t in (("a", old), ("b", new)))
            both = a.hint("merge").join(b, "head", "full")
            n = F.coalesce("n_a", F.lit(0)) + F.coalesce("n_b", F.lit(0))
            level += 1
            spent += [old, new]
            new = self._write(both.select("head", n.alias("n"), F.least("p_a", "p_b").alias("place")), level)
        levels[level] = new
        batches = self.batches if key is None else self.batches | {key: hits._scratch_path}
        self.versions.publish({"version": self.version + 1, "levels": levels, "batches": batches})
        self.version, self.levels, self.batches = self.version + 1, levels, batches
        for t in spent:
            self.spark.sql(f"drop table if exists {t}")
        return hits

    def close(self) -> None:
        """Drop the tables and the state; a family that is to be opened again stays open."""
        self.levels = {}
        self.sweep()
        self.versions.remove()


def substring_dedup(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs (doc_id, text).

    Strings are judged on the input, as UTF-8 bytes; matches don't cross rows, and every row counts, also one that repeats
    another. A null text is empty; a null doc_id is allowed. Texts under 200 bytes stay whole, longer ones are processed whole,
    and an empty table gives no rows; other columns are left out.
    """
    spark = docs.sparkSession
    rows = marked(docs)
    found = saved(rows.mapInArrow(row_maker(byte_units, anchors, WINDOW, BEGINNING), f"{ROW}, head binary"), "suffixes-rows")
    family = Family(spark, int(spark.conf.get("spark.sql.shuffle.partitions")))
    try:
        batch = F.pmod(F.col("mark"), F.lit(batches))
        hits = [family.add(found.where(batch == b).select("head", "doc_id", "at")) for b in range(batches)]
    finally:
        family.close()
    keys = hits[0]
    for h in hits[1:]:
        keys = keys.union(h)
    keys = saved(keys.distinct(), "suffixes-keys")  # read from both sides, the join below can split a key that many rows share
    alive = saved(found.join(keys, "head").drop("head"), "suffixes-alive")
    forget(found, keys, *hits)
    settled = settle(alive, of_smaller=False)
    out = removed(rows, settled, byte_units, WINDOW, of_smaller=False)
    return out.select("doc_id", F.col("n").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))
