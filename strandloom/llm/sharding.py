"""Sharding by size-tiered compaction: small immutable shards, merged by size into target-sized files, under a versioned manifest.

A store is a folder: `runs/<id>/` holds the Parquet shards of one arrival or merge, never changed once written, and
`manifests/v<n>.json` lists the live runs of a version. A version is claimed, which spares others the work, and published so that it
never replaces one that is there; a reader sees a whole version or the one before. The claim of a writer that died lapses after a
lease. `intents/<id>` marks a run that is being written: shards that no version lists and no intent marks are deleted by age.
DataFrame and SQL functions only; shards are merged without a shuffle.
"""

from __future__ import annotations

import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import scratch, table
from strandloom.llm.manifests import Lost, Manifests

#: Bytes of a target-sized file; runs of one tier that are merged; bytes of the lowest tier; arrivals that a query deals out.
TARGET, FANOUT, SMALLEST, ARRIVALS = 64 << 20, 4, 1 << 20, 8
#: Seconds after which a claim without a version has lapsed, for which readers may hold on to an older version, and after which an intent is given up.
LEASE, RETAIN, ABANDONED = 600, 3600, 7 * 86400
#: Versions that other writers may publish first before a commit gives up.
TRIES = 100


class Store:
    """The shards and manifests below one folder, with the schema of the documents."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, lease: float = LEASE):
        self.spark, self.root, self.schema, self.lease = spark, root, schema, lease
        self.versions = Manifests(spark, f"{root}/manifests")
        self.path, self.fs = self.versions.path, self.versions.fs

    def manifest(self) -> dict:
        """The newest published version."""
        return self.versions.newest() or {"version": 0, "runs": []}

    def commit(self, base: dict, runs: list[dict]) -> dict:
        """Publish the version after base; Lost if another writer has it, an error if one has claimed it within the lease."""
        new = {"version": base["version"] + 1, "runs": runs}
        if self.versions.exists(new["version"]):
            raise Lost(f"version {new['version']} is taken; read the manifest again")
        self.fs.mkdirs(self.path(f"{self.root}/manifests"))
        if not self._claimed(self.path(self.versions.name(new["version"]) + ".claim"), self.path(self.versions.name(new["version"]) + ".json")):
            if self.versions.exists(new["version"]):
                raise Lost(f"version {new['version']} is taken; read the manifest again")
            raise RuntimeError(f"version {new['version']} is claimed by another writer")
        return self.versions.publish(new)

    def _intent(self, name: str):
        return self.path(f"{self.root}/intents/{name}")

    def _claimed(self, claim, published) -> bool:
        """Create the claim; one that is older than the lease and led to no version goes first."""
        if self.fs.createNewFile(claim):
            return True
        if self.fs.exists(published) or time.time() * 1000 - self.fs.getFileStatus(claim).getModificationTime() < self.lease * 1000:
            return False
        self.fs.delete(claim, False)
        return bool(self.fs.createNewFile(claim))

    def read(self, runs: list[dict]) -> DataFrame:
        paths = [s["path"] for r in runs for s in r["shards"]]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def described(self, folder: str, name: str, tier_of: dict | None = None) -> list[dict]:
        """Runs below a folder, with the path, bytes and rows of their shards: the manifest's entries, one row a shard."""
        shards = (
            self.spark.read.schema(self.schema)
            .option("recursiveFileLookup", "true")
            .parquet(folder)
            .groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
            .agg(F.count("*").alias("rows"))
            .orderBy("path")
            .collect()
        )
        runs: dict[str, dict] = {}
        for s in shards:
            part = s["path"].rsplit("/", 2)[1]
            run = runs.setdefault(part, {"run": f"{name}/{part}", "shards": []})
            run["shards"].append({"path": s["path"], "bytes": s["bytes"], "rows": s["rows"]})
        return list(runs.values())

    def append(self, arrivals: DataFrame, by: str | None = None) -> dict:
        """Add rows as small shards: one run, or one for each value of column `by`, which isn't stored in the shards."""
        name = uuid.uuid4().hex[:12]
        folder = f"{self.root}/runs/{name}"
        writer = arrivals.write.option("compression", "zstd")
        self.fs.createNewFile(self._intent(name))
        try:
            (writer.partitionBy(by) if by else writer).parquet(folder)
            return self._added(self.described(folder, name))
        finally:  # a writer that dies before this leaves its intent, which is given up much later
            self.fs.delete(self._intent(name), False)

    def _added(self, runs: list[dict]) -> dict:
        """Commit further runs on the newest version, and again on the next where another writer was first."""
        for _ in range(TRIES):
            base = self.manifest()
            try:
                return self.commit(base, base["runs"] + runs)
            except Lost:
                continue
        raise RuntimeError(f"{TRIES} versions were published by others meanwhile")

    def compact(self, fanout: int = FANOUT, target: int = TARGET, smallest: int = SMALLEST) -> dict:
        """Merge runs of one size tier, fanout or more at a time, until no tier holds that many. Each merge commits a version."""
        while True:
            base = self.manifest()
            tiers: dict[int, list[dict]] = {}
            for r in base["runs"]:
                tiers.setdefault(tier(size_of(r), fanout, smallest), []).append(r)
            full = sorted(t for t, runs in tiers.items() if len(runs) >= fanout)
            if not full:
                return base
            merged = sorted(tiers[full[0]], key=size_of)[: max(fanout, len(tiers[full[0]]) // fanout * fanout)]
            name = uuid.uuid4().hex[:12]
            folder = f"{self.root}/runs/{name}/merged"
            files = max(1, math.ceil(sum(map(size_of, merged)) / target))
            gone = {r["run"] for r in merged}
            self.fs.createNewFile(self._intent(name))
            try:
                # joins neighbouring splits without a shuffle; a run never becomes fewer files than its size asks for
                self.read(merged).coalesce(files).write.option("compression", "zstd").parquet(folder)
                self._replaced(gone, self.described(folder, name))
            finally:
                self.fs.delete(self._intent(name), False)

    def _replaced(self, gone: set[str], runs: list[dict]) -> None:
        """Commit runs in place of others, on the newest version that lists all of those; where none does, another writer has merged them."""
        for _ in range(TRIES):
            base = self.manifest()
            if not gone <= {r["run"] for r in base["runs"]}:
                return
            try:
                self.commit(base, [r for r in base["runs"] if r["run"] not in gone] + runs)
                return
            except Lost:
                continue
        raise RuntimeError(f"{TRIES} versions were published by others meanwhile")

    def sweep(self, retain: float = RETAIN, abandoned: float = ABANDONED) -> int:
        """Delete the files of all runs that the newest version doesn't list, that no intent younger than `abandoned` seconds marks, and
        that are older than `retain` seconds; how many. Intents are read before the version: a run has one until its version is there."""
        now = time.time()
        oldest, marks = (now - retain) * 1000, self.path(f"{self.root}/intents")
        marked = [x for x in self.fs.listStatus(marks)] if self.fs.exists(marks) else []
        spared = {x.getPath().getName() for x in marked if x.getModificationTime() > (now - abandoned) * 1000}
        live = {self.path(s["path"]).toUri().getPath() for r in self.manifest()["runs"] for s in r["shards"]}
        runs = self.path(f"{self.root}/runs")
        if not self.fs.exists(runs):
            return 0
        files, gone = self.fs.listFiles(runs, True), 0
        while files.hasNext():
            f = files.next()
            path = f.getPath().toUri().getPath()
            if path not in live and path.rsplit("/runs/", 1)[1].split("/")[0] not in spared and f.getModificationTime() <= oldest:
                gone += bool(self.fs.delete(f.getPath(), False))
        for x in marked:
            if x.getPath().getName() not in spared:
                self.fs.delete(x.getPath(), False)
        return gone


def size_of(run: dict) -> int:
    return sum(s["bytes"] for s in run["shards"])


def tier(size: int, fanout: int = FANOUT, smallest: int = SMALLEST) -> int:
    """0 up to `smallest` bytes, and one more for each factor of fanout."""
    n = 0
    while size > smallest:
        smallest, n = smallest * fanout, n + 1
    return n


def shard(docs: DataFrame, root: str | None = None, arrivals: int = ARRIVALS, **options) -> DataFrame:
    """Append docs in `arrivals` runs, compact them, and list the live shard of each row.

    Returns doc_id, shard (file name), run, shard_rows, shard_bytes, version. Every row of docs is stored once, whatever it
    holds: nulls, empty and long texts, ties, repeated rows and further columns are written as they are. A row arrives by a
    hash of its doc_id; null doc_ids arrive together. An empty table gives a version without shards and no rows.
    """
    spark = docs.sparkSession
    store = Store(spark, root or scratch(spark, "shards"), docs.schema)
    by = f"arrival_{uuid.uuid4().hex[:8]}"
    store.append(docs.withColumn(by, F.pmod(F.xxhash64("doc_id"), F.lit(arrivals))), by)
    last = store.compact(**options)
    store.sweep(RETAIN if root else 0)  # nobody reads older versions of a store made here
    listed = spark.createDataFrame(
        [(s["path"].rsplit("/", 1)[1], r["run"], s["rows"], s["bytes"], last["version"]) for r in last["runs"] for s in r["shards"]],
        "shard string, run string, shard_rows long, shard_bytes long, version long",
    )
    rows = store.read(last["runs"]).select("doc_id", F.col("_metadata.file_name").alias("shard")) if last["runs"] else spark.createDataFrame([], "doc_id long, shard string")
    return rows.join(listed, "shard").select("doc_id", "shard", "run", "shard_rows", "shard_bytes", "version")


def op4_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
