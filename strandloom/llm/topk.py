"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length into buckets, cut into blocks of bounded size. A pilot block of the longest vectors gives each
query a lower bound of its k-th score. For every block that bound becomes a local cosine threshold: above 1 the block is
skipped, low ones prune by length, high ones by the ranges that the query's largest coordinates allow. What is left is
verified by exact integer products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strandloom.llm.common import saved, table

K, EVERY, SCALE = 5, 50, 256
#: Ratio of the longest to the shortest vector of a bucket; vectors a block; queries a block; focus coordinates; cosine from which coordinates prune.
RATIO, BLOCK, QUERIES, FOCUS, STEEP = 1.05, 4096, 512, 6, 0.6

PACKED = "dim int, block long, longest double, ids binary, vectors binary"
FOUND = "query_id long, vec_id long, score long"


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>, dim, norm): floor(256 x) of vectors without null or non-finite components."""
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return (
        vectors.where(F.col(column).isNotNull() & F.col(id_col).isNotNull() & fine)
        .select(F.col(id_col).cast("long").alias("vec_id"), F.transform(column, lambda x: F.floor(x.cast("double") * SCALE).cast("double")).alias("v"))
        .groupBy("vec_id")
        .agg(F.min("v").alias("v"))
        .withColumn("dim", F.size("v"))
        .withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    )


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["norm", "vec_id"], ascending=[False, True])
    v = np.array([np.asarray(x, np.float64) for x in pdf["v"]]).reshape(len(pdf), -1)
    return pd.DataFrame(
        {"dim": [int(pdf["dim"].iloc[0])], "block": [int(pdf["block"].iloc[0])], "longest": [float(pdf["norm"].max())], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "vectors": [v.tobytes()]}
    )


def _unpack(ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(vectors, np.float64).reshape(len(i), -1)


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products of whole-valued rows; beyond 2**53 by Python integers. A score that no long holds is an error."""
    if q.size == 0 or v.size == 0:
        return np.zeros((len(q), len(v)), np.int64)
    if np.abs(q).max() * np.abs(v).max() * q.shape[1] < 2.0**53:
        return (q @ v.T).astype(np.int64)
    wide = np.array([[int(x) for x in r] for r in q], object) @ np.array([[int(x) for x in r] for r in v], object).T
    if (wide > 2**63 - 1).any() or (wide < -(2**63)).any():
        raise OverflowError("an inner product exceeds a long")
    return wide.astype(np.int64)


def best(query_id: int, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    keep = ids != query_id
    ids, scores = ids[keep], scores[keep]
    if len(ids) > 8 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[scores >= cut], scores[scores >= cut]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def search_block(q_ids, q, bound, v_ids, v, k: int) -> tuple[list, list, list]:
    """Top k of one block for each query; bound: a score that the k-th best is known to reach (-inf: none)."""
    lengths = np.sqrt((v * v).sum(1))  # descending
    q_len = np.sqrt((q * q).sum(1))
    longest = lengths[0] if len(lengths) else 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(np.isfinite(bound) & (q_len * longest > 0), bound / (q_len * longest), -1.0)
    local[np.isfinite(bound) & (q_len * longest == 0) & (bound > 0)] = 2.0
    out: tuple[list, list, list] = ([], [], [])

    def add(i, ids, scores):
        found, s = best(q_ids[i], ids, scores, k)
        out[0].append(np.full(len(found), q_ids[i]))
        out[1].append(found)
        out[2].append(s)

    slack = 1 + 1e-9
    flat = np.flatnonzero(local <= STEEP)
    if len(flat):  # by length: the shortest vector that can still reach the lowest bound ends the prefix
        need = np.where(local[flat] > 0, np.divide(bound[flat], q_len[flat], where=q_len[flat] > 0, out=np.zeros(len(flat))), 0.0).min()
        n = int(np.searchsorted(-lengths, -(need / slack), "right")) if need > 0 else len(lengths)
        scores = products(q[flat], v[:n])
        for row, i in enumerate(flat):
            add(i, v_ids[:n], scores[row])
    steep = np.flatnonzero((local > STEEP) & (local <= slack))
    if len(steep):  # by coordinates: the unit vector must lie in the cap around the query
        unit = v / np.maximum(lengths, 1e-300)[:, None]
        for i in steep:
            u, t = q[i] / q_len[i], min(local[i], 1.0)
            mask = lengths * q_len[i] * slack >= bound[i]
            for f in np.argsort(-np.abs(u))[:FOCUS]:
                reach = np.sqrt(max(0.0, (1 - u[f] ** 2) * (1 - t * t)))
                # a shorter vector needs a larger cosine still, so the bucket's threshold is safe for all of it
                mask &= (unit[:, f] >= u[f] * t - reach - 1e-9) if u[f] > 0 else (unit[:, f] <= u[f] * t + reach + 1e-9)
            rows = np.flatnonzero(mask)
            add(i, v_ids[rows], products(q[i : i + 1], v[rows])[0])
    return out


def _blocks(rows: DataFrame, per_block: int, ratio: float) -> DataFrame:
    """Packed blocks of at most about per_block vectors of like length; block numbers say nothing else."""
    step = float(np.log(ratio))
    bucketed = rows.withColumn("bucket", F.when(F.col("norm") > 0, F.floor(F.log("norm") / F.lit(step))).otherwise(F.lit(-(1 << 30))).cast("long"))
    sizes = bucketed.groupBy("dim", "bucket").agg(F.ceil(F.count("*") / F.lit(per_block)).alias("parts"))
    dealt = bucketed.join(sizes, ["dim", "bucket"]).withColumn(
        "block", F.xxhash64("dim", "bucket", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    )
    return dealt.select("dim", "block", "vec_id", "v", "norm").groupBy("dim", "block").applyInPandas(_pack, PACKED)


def _searched(k: int, with_bound: bool):
    schema_q, schema_v = ("q_ids", "q_vectors"), ("ids", "vectors")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                q_ids, q = _unpack(getattr(row, schema_q[0]), getattr(row, schema_q[1]))
                v_ids, v = _unpack(getattr(row, schema_v[0]), getattr(row, schema_v[1]))
                bound = np.frombuffer(row.bounds, np.float64) if with_bound else np.full(len(q_ids), -np.inf)
                a, b, c = search_block(q_ids, q, bound, v_ids, v, k)
                if a:
                    yield pd.DataFrame({"query_id": np.concatenate(a), "vec_id": np.concatenate(b), "score": np.concatenate(c)})

    return run


def top_k(vectors: DataFrame, queries: DataFrame | None = None, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query; ties to the smaller vec_id.

    Vectors (vec_id, embedding) that are null, or hold a null or non-finite component, and rows without vec_id take no part.
    Rows that repeat a vec_id count once, with the smallest of their vectors. Only vectors of the query's own dimension are
    candidates; with fewer than k of them all are returned. Empty tables give no rows; other columns are left out.
    """
    rows = saved(whole_vectors(vectors), "topk-vectors")
    asked = rows.where(F.col("vec_id") % every == 0) if queries is None else whole_vectors(queries)
    v = saved(_blocks(rows, BLOCK, RATIO), "topk-blocks")
    members = saved(_query_members(asked), "topk-members")
    q = saved(_query_blocks(members), "topk-queries")
    # the pilot of a dimension: the block with the longest vector
    first = F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("longest"), "block"))
    heads = v.select("dim", "block", "longest").withColumn("nth", first).where("nth = 1").select("dim", "block")
    pilot = v.join(heads, ["dim", "block"])
    each = q.join(pilot.select("dim", "ids", "vectors"), "dim").select("q_block", F.col("dim").alias("part"), "q_ids", "q_vectors", "ids", "vectors")
    seen = saved(each.repartition("q_block", "part").mapInPandas(_searched(k, False), FOUND), "topk-pilot")
    # of fewer than k pilot scores nothing follows
    bound = seen.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("bound"))
    bounded = saved(_with_bounds(q, bound), "topk-bounded")
    met = saved(block_pairs(members, bound, v.select("dim", "block", "longest").join(heads, ["dim", "block"], "left_anti")), "topk-pairs")
    pairs = met.join(bounded, ["dim", "q_block"]).join(v.drop("longest"), ["dim", "block"]).select("q_block", "block", "q_ids", "q_vectors", "bounds", "ids", "vectors")
    found = pairs.repartition("q_block", "block").mapInPandas(_searched(k, True), FOUND).union(seen)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def block_pairs(members: DataFrame, bound: DataFrame, blocks: DataFrame) -> DataFrame:
    """(dim, q_block, block) whose longest vector can reach the bound of some query of the block; rows of numbers, no vectors yet."""
    known = members.join(bound, members["vec_id"] == bound["query_id"], "left")
    need = F.when((F.col("bound") > 0) & (F.col("norm") > 0), F.col("bound") / F.col("norm")).otherwise(F.lit(float("-inf")))
    lowest = known.groupBy("dim", F.col("block").alias("q_block")).agg(F.min(need).alias("need"))
    return lowest.join(blocks, "dim").where(F.col("longest") * (1 + 1e-9) >= F.col("need")).select("dim", "q_block", "block")


def _query_members(asked: DataFrame) -> DataFrame:
    parts = asked.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(QUERIES)).alias("parts"))
    dealt = asked.join(parts, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    return dealt.select("dim", "block", "vec_id", "v", "norm")


def _query_blocks(members: DataFrame) -> DataFrame:
    packed = members.groupBy("dim", "block").applyInPandas(_pack, PACKED)
    return packed.select("dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))


def _with_bounds(q: DataFrame, bound: DataFrame) -> DataFrame:
    """Query blocks with a packed array of bounds in the order of their ids; -inf where none is known."""

    def ids_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ids = np.frombuffer(r.q_ids, np.int64)
                yield pd.DataFrame({"dim": np.int32(r.dim), "q_block": r.q_block, "query_id": ids, "nth": np.arange(len(ids))})

    listed = q.mapInPandas(ids_of, "dim int, q_block long, query_id long, nth long").join(bound, "query_id", "left")

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("nth")
        return pd.DataFrame({"dim": pdf["dim"].iloc[:1], "q_block": pdf["q_block"].iloc[:1], "bounds": [pdf["bound"].astype("float64").fillna(-np.inf).to_numpy().tobytes()]})

    filled = listed.groupBy("dim", "q_block").applyInPandas(packed, "dim int, q_block long, bounds binary")
    return q.join(filled, ["dim", "q_block"])


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = """
with e as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), p as (
  select q.vec_id as query_id, c.vec_id,
    cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
  from e q join e c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)
), r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from p)
select query_id, rank, vec_id, score from r where rank <= 5
"""
