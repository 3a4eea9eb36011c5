"""Tables written once to the shared folder, and the loops that need them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where none is named, a temporary one, on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(spark.sparkContext, "_strandloom_scratch", None) or "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext._strandloom_scratch = base
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    spark._jvm.System.gc()  # the shuffle files of what was just written go once nothing refers to its plan
    return out


def dealt_by(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by keys over spark.sql.shuffle.partitions tasks, for rows that grow into many afterwards: what is grouped or windowed by
    these and further keys then needs no other shuffle, and the number of tasks stays as set, however small the rows still are."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Rows that one task is to sort or to add up.
ROWS = 1 << 19


def dealt_by_rows(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt out by keys over a task for each ROWS of `rows` rows, so that what a task holds doesn't grow with the table; left to
    Spark where spark.sql.shuffle.partitions tasks have no more than that anyway."""
    parts = -(-rows // ROWS)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def forget(*frames: DataFrame) -> None:
    """Remove tables written by saved() that no later plan reads."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def components(edges: DataFrame, name: str = "components", max_rounds: int = 64) -> DataFrame:
    """(node, component) for every node of edges(a, b): component is the smallest node reachable.

    Large-star and small-star rounds: each round links every node to the smallest label of its neighbourhood, so the rounds
    grow with the logarithm of a component's size. Every round is written to the shared folder; nothing reaches the driver but
    a count and a checksum. An edge from a node to itself makes it a component of one.
    """
    loops = edges.where("a = b").select(F.col("a").alias("node"))
    e = saved(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-edges"
    )

    def digest(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = digest(e)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        # large star: neighbours above a node move to the smallest label around it
        large = saved(
            both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct(),
            f"{name}-large",
        )
        # small star: neighbours below a node, and the node itself, move to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        step = saved(
            large.join(low, "a")
            .select(F.col("b").alias("a"), F.col("low").alias("b"))
            .union(low.select("a", F.col("low").alias("b")))
            .where("a <> b")
            .distinct(),
            f"{name}-round",
        )
        after = digest(step)
        forget(e, large)
        e = step
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = e.select(F.col("b").alias("node")).union(loops).distinct().join(stars, "node", "left_anti")
    return stars.union(roots.select("node", F.col("node").alias("component")))
