"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same expected number of copies, target / source size. The integral part is given to each;
the fractional parts are rounded in pairs: words move at random from one document of a pair to the other until one of them is
copied a whole number of times, so the words taken of a source stay at its target. Each bucket leaves one document undecided;
those of up to FAN_IN buckets meet in the next level of a reduction tree, until one a source is left.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.llm.common import WORD, saved, table, tucked, untucked

#: Weights of the sources in the order of their names, repeating; share of all words that a mix takes; most copies of a document.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Documents a bucket, and residual documents that meet in a node of the reduction tree.
BUCKET, FAN_IN = 2000, 500


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fill_targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> list[tuple[str | None, int, float]]:
    """(source, size, target): share of all words by weight; a target stops at most * size, the excess goes to the others."""
    ranked = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(ranked)}
    size = dict(ranked)
    left, target = share * sum(size.values()), {s: 0.0 for s in size}
    free = [s for s in size if size[s] > 0]
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] >= most * size[s]]
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        for s in full:
            target[s] = float(most * size[s])
            left -= target[s]
        free = [s for s in free if s not in set(full)]
        left = max(left, 0.0)
    return [(s, size[s], target[s]) for s, _ in ranked]


def _uniform(*key) -> Iterator[float]:
    """Numbers in [0, 1) that depend on the key alone: a rerun of a lost task gives the same."""
    seed = int.from_bytes(hashlib.blake2b("\x1f".join(map(str, key)).encode(), digest_size=8).digest(), "big")
    rng = np.random.default_rng(seed)
    while True:
        yield from rng.random(256)


def pivot(size: np.ndarray, frac: np.ndarray, mark: np.ndarray, key: tuple) -> np.ndarray:
    """Rounded fractions; at most one keeps a value strictly between 0 and 1, and the sum of size * fraction stays as it was."""
    frac = frac.copy()
    draw, held = _uniform(*key), None
    for j in np.lexsort((mark, -size)):
        if not 0.0 < frac[j] < 1.0:
            continue
        if size[j] == 0:
            frac[j] = 0.0
            continue
        if held is None:
            held = j
            continue
        i, u = held, next(draw)
        room_i, room_j = size[i] * (1 - frac[i]), size[j] * (1 - frac[j])
        mass_i, mass_j = size[i] * frac[i], size[j] * frac[j]
        to_i, to_j = min(room_i, mass_j), min(mass_i, room_j)
        if u * (to_i + to_j) < to_j:  # words move from j to i
            if room_i <= mass_j:
                frac[i], frac[j], held = 1.0, max((mass_j - room_i) / size[j], 0.0), j
            else:
                frac[j], frac[i], held = 0.0, min((mass_i + mass_j) / size[i], 1.0), i
        elif mass_i <= room_j:
            frac[i], frac[j], held = 0.0, min((mass_j + mass_i) / size[j], 1.0), j
        else:
            frac[j], frac[i], held = 1.0, max((mass_i - room_j) / size[i], 0.0), i
        if not 1e-12 < frac[held] < 1 - 1e-12:
            frac[held], held = round(frac[held]), None
    return frac


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 7) -> DataFrame:
    """Copies of each document (doc_id, source, text): doc_id, source, size, source_size, target, copies, taken.

    size counts the blank-separated words of the whole text. One row for each input row: rows that repeat, also by doc_id, are
    mixed each on its own. Nulls: a null text has size 0 and is taken 0 times; a null source is a source, the last in order; a
    null doc_id is allowed. Documents of equal size are paired in the order of a seeded hash of (doc_id, text) and of a number
    among rows that repeat both. An empty table gives no rows; other columns are left out. A row for each source reaches the driver.
    """
    return _mixed(docs, weights, share, most, seed).drop("text_mark")


def _mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 7) -> DataFrame:
    """mix() with the mark of each text."""
    spark = docs.sparkSession
    each = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_mark"))
    # rows that repeat are one row and a number on their way here, and numbered apart from each other
    counted = each.groupBy("doc_id", "source", "size", "text_mark").agg(F.count("*").alias("m"))
    numbered = counted.select("doc_id", "source", "size", "text_mark", F.explode(F.sequence(F.lit(1).cast("long"), "m")).alias("nth"))
    sized = saved(numbered.withColumn("mark", F.xxhash64("doc_id", "text_mark", "nth")).drop("nth"), "mix-sizes")
    totals = [(r[0], r[1], r[2]) for r in sized.groupBy("source").agg(F.sum("size"), F.count("*")).collect()]
    targets = fill_targets([(s, n) for s, n, _ in totals], weights, share, most)
    count = {s: n for s, _, n in totals}
    sources = spark.createDataFrame(
        [(s, n, t, max(1, math.ceil(count[s] / BUCKET))) for s, n, t in targets],
        "source_name string, source_size long, target double, buckets long",
    )
    fraction = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = (
        sized.join(F.broadcast(sources) if len(targets) <= 10_000 else sources, F.col("source").eqNullSafe(F.col("source_name")))
        .withColumn("copies", F.floor(fraction + F.lit(1e-12)).cast("long"))
        .withColumn("frac", F.greatest(fraction - F.col("copies"), F.lit(0.0)))
        .withColumn("mark", F.xxhash64("mark", F.lit(seed)))
        .withColumn("bucket", F.pmod(F.xxhash64("mark"), F.col("buckets")))
        .select("doc_id", "source", "size", "source_size", "target", "copies", "frac", "mark", "bucket", "text_mark")
    )

    def level(n: int):
        def rounded(key, rows):
            size, frac, mark = (rows[c].to_numpy() for c in ("size", "frac", "mark"))
            new = pivot(size.astype(float), frac, mark, (seed, n, *(k.as_py() for k in key)))
            return rows.set_column(rows.schema.get_field_index("frac"), "frac", pa.array(new))

        return rounded

    undecided = (F.col("frac") > 0) & (F.col("frac") < 1)
    widest, n, done = max([math.ceil(c / BUCKET) for c in count.values()], default=1), 0, []
    while True:
        rows = saved(rows.groupBy("source", "bucket").applyInArrow(level(n), rows.schema), f"mix-level{n}")
        if widest <= 1:
            # the last document of each source is rounded alone, by its own fraction
            last = F.when(
                undecided, (F.pmod(F.xxhash64("mark", F.lit(1)), F.lit(1 << 20)) < F.col("frac") * (1 << 20)).cast("double")
            ).otherwise(F.col("frac"))
            done.append(rows.withColumn("frac", last))
            break
        done.append(rows.where(~undecided))
        rows = rows.where(undecided).withColumn("bucket", F.floor(F.col("bucket") / FAN_IN).cast("long"))
        widest, n = math.ceil(widest / FAN_IN), n + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    copies = (F.col("copies") + F.round("frac").cast("long")).alias("copies")
    return out.select("doc_id", "source", "size", "source_size", "target", copies, "text_mark").withColumn("taken", F.col("copies") * F.col("size"))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as mix() copies it; the columns of docs, whatever they are called.

    Rows that repeat (doc_id, text, source) share their copies: as many each, and one more for the first by a hash of all
    their columns where that doesn't come out even. Null doc_ids and sources match each other.
    """
    chosen = _mixed(docs, **options)
    plan = chosen.groupBy(F.col("doc_id").alias("p_id"), F.col("source").alias("p_source"), F.col("text_mark").alias("p_mark")).agg(F.count("*").alias("m"), F.sum("copies").alias("copies"))
    rows = tucked(docs, doc_id=F.col("doc_id"), source=F.col("source"), text_mark=F.xxhash64("text"), order=F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    met = rows.join(plan.where("copies > 0"), F.col("doc_id").eqNullSafe(F.col("p_id")) & F.col("source").eqNullSafe(F.col("p_source")) & (F.col("text_mark") == F.col("p_mark")))
    each, over = F.floor(F.col("copies") / F.col("m")), F.col("copies") % F.col("m")
    even = met.where(over == 0).select("row", each.alias("times"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "source", "text_mark").orderBy("order"))
    uneven = met.where(over > 0).withColumn("nth", nth).select("row", (each + (F.col("nth") <= over).cast("long")).alias("times"))
    return untucked(even.unionByName(uneven).withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))), docs)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
