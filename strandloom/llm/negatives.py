"""Hard-negative mining by threshold joins with a pruned inverted index.

An anchor's positives are its best rows of the same label; its negatives are the best rows of other labels inside a window below
each positive. Both are threshold joins. Anchors are dealt to cells of bounded size, and vectors stream past them. A cell holds an
inverted index of its anchors: dimensions come in a fixed order, and an anchor leaves out the first of them as long as what their
norms allow stays under its threshold. Partial scores accumulate over the posting lists, from the last dimension on; a pair goes
as soon as its partial score and the norms of what remains can't reach the threshold. Thresholds rise with what a cell has found,
and for windows that don't fill they are lowered from round to round, down to the window's own end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strandloom.llm.common import forget, saved, table
from strandloom.llm.topk import SCALE, products

EVERY, POSITIVES, NEGATIVES = 50, 5, 3
#: A window: shares of the positive's score in hundredths. Parts of it, as a share of the positive's score, at which rounds begin; the last round begins at the window's end.
LOW, HIGH, STEPS = 50, 95, (0.9, 0.75)
#: Bytes of anchors a cell, vectors a part at scale, anchors and vectors of a block of partial scores, dimensions after which pairs are pruned, share of pairs from which they are verified one by one.
CELL_BYTES, PART, TILE, BATCH, CHUNK, SPARSE = 1 << 24, 1 << 16, 1024, 2048, 8, 0.05

FOUND = "anchor_id long, slot int, vec_id long, score long"
NONE = np.iinfo(np.int64).min


class Cell:
    """The anchors of a cell with their windows (ends, thresholds, and the `want` best rows so far of each)."""

    def __init__(self, ids, labels, v, ends, other: bool, want: int):
        n, width = len(ids), max((len(e) for e in ends), default=0)
        self.ids, self.labels, self.other, self.want = ids, labels, other, want
        self.low, self.high = np.ones((n, width), np.int64), np.zeros((n, width), np.int64)
        self.slot, self.step = np.full((n, width), -1), np.full((n, width), np.inf)
        for i, row in enumerate(ends):
            for j, (slot, low, high, step) in enumerate(row):
                self.slot[i, j], self.low[i, j], self.high[i, j] = slot, low, high
                self.step[i, j] = -np.inf if step == NONE else float(step)
        # dimensions with little weight first: they are the ones that the index may leave out
        self.order = np.argsort((v * v).sum(0), kind="stable") if n else np.arange(v.shape[1])
        self.v = np.ascontiguousarray(v[:, self.order])
        self.upto = _norms(self.v)
        self.found = [[np.zeros(0, np.int64)] * 4 for _ in range(0, max(n, 1), TILE)]  # row, window, score, id of each tile
        self.need = self.step.min(1) if width else np.full(n, np.inf)

    def meet(self, ids, labels, v) -> None:
        """Stream vectors past the anchors; the first few set the thresholds."""
        v = v[:, self.order]
        at = 0
        while at < len(ids):
            size = 256 if np.isneginf(self.need).any() else BATCH
            part = slice(at, at + size)
            upto = _norms(v[part])
            for tile in range(0, len(self.ids), TILE):
                self._block(slice(tile, tile + TILE), ids[part], labels[part], v[part], upto)
            at += size

    def _block(self, tile, ids, labels, v, v_upto) -> None:
        need, upto = self.need[tile], self.upto[tile]
        slack = 1e-9 * upto[:, -1] * (v_upto[:, -1].max() if len(v) else 0.0) + 1e-9
        use = np.flatnonzero(upto[:, -1] * v_upto[:, -1].max() + slack >= need)
        if not len(use):
            return
        need, slack = need[use], slack[use]
        dims = v.shape[1]
        # the index: an anchor posts its dimensions from `first` on; what comes before can't reach its threshold by itself
        first = (upto[use][:, 1:] * v_upto[:, -1].max() + slack[:, None] < need[:, None]).sum(1)
        by = np.argsort(first, kind="stable")
        use, first, need, slack = use[by], first[by], need[by] - slack[by], slack[by]
        posted = np.where(np.arange(dims) >= first[:, None], self.v[tile][use], 0.0)
        rest = upto[use]
        score = np.zeros((len(use), len(v)))
        alive = np.ones((len(use), len(v)), bool)
        if self.other:
            alive &= self.labels[tile][use][:, None] != labels
        for end in range(dims, 0, -CHUNK):
            begin = max(0, end - CHUNK)
            n = int(np.searchsorted(first, end))  # anchors with postings here come first
            score[:n] += posted[:n, begin:end] @ v[:, begin:end].T
            # what remains of a pair: the dimensions before `begin`, or those the anchor doesn't post
            whole = int(np.searchsorted(first, begin, "right"))
            if begin > dims // 2 and begin > 0:
                continue  # norms of half of the dimensions and more prune next to nothing
            alive[:whole] &= score[:whole] + rest[:whole, begin, None] * v_upto[:, begin] >= need[:whole, None]
            if begin and alive.mean() < SPARSE:
                break
        if begin == 0:
            i = np.flatnonzero(first > 0)
            alive[i] &= score[i] + rest[i, first[i]][:, None] * v_upto[:, first[i]].T >= need[i, None]
        rows, cols = np.nonzero(alive)
        if not len(rows):
            return
        rows = use[rows]
        keep = self.ids[tile][rows] != ids[cols]
        rows, cols = rows[keep], cols[keep]
        for at in range(0, len(rows), 1 << 18):  # verified: whole products of the pairs that are left
            r, c = rows[at : at + (1 << 18)], cols[at : at + (1 << 18)]
            self._add(tile.start, r + tile.start, ids[c], paired(self.v[tile][r], v[c]))

    def _add(self, tile, rows, ids, scores) -> None:
        parts = [self.found[tile // TILE]]
        for w in range(self.low.shape[1]):
            i = np.flatnonzero((scores >= self.low[rows, w]) & (scores <= self.high[rows, w]) & (scores.astype(np.float64) >= self.step[rows, w]))
            parts.append([rows[i], np.full(len(i), w), scores[i], ids[i]])
        row, window, score, vec = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((vec, -score, window, row))
        row, window, score, vec = row[order], window[order], score[order], vec[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (window[1:] != window[:-1])
        nth = np.arange(len(row)) - np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
        last = nth == self.want - 1  # a window that is full needs no less than its last score
        self.step[row[last], window[last]] = np.maximum(self.step[row[last], window[last]], score[last])
        self.need[tile : tile + TILE] = self.step[tile : tile + TILE].min(1)
        keep = nth < self.want
        self.found[tile // TILE] = [row[keep], window[keep], score[keep], vec[keep]]

    def out(self) -> pa.RecordBatch:
        row, window, score, vec = (np.concatenate(x) for x in zip(*self.found, strict=True))
        columns = [pa.array(self.ids[row]), pa.array(self.slot[row, window].astype(np.int32)), pa.array(vec), pa.array(score)]
        return pa.RecordBatch.from_arrays(columns, names=["anchor_id", "slot", "vec_id", "score"])


def _norms(v: np.ndarray) -> np.ndarray:
    """Norms of the first 0, 1, ... dimensions of each row."""
    return np.sqrt(np.concatenate([np.zeros((len(v), 1)), np.cumsum(v * v, 1)], 1))


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of rows of a with rows of b."""
    if a.size == 0 or np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**53:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    return np.array([int(products(x[None], y[None])[0, 0]) for x, y in zip(a, b, strict=True)], np.int64)


def _cells(other: bool, want: int):
    """Rows sorted by cell, anchors first: memory holds the anchors of one cell and a batch of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, now = None, [], None

        def matrix(b):
            dim = len(b.column("v")[0])
            return b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)

        def opened():
            ids, labels, v = (np.concatenate([h[k] for h in held]) for k in range(3))
            return Cell(ids, labels, v, [e for h in held for e in h[3]], other, want)

        for b in batches:
            cells = b.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1), len(cells)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                part = b.slice(s, e - s)
                if cells[s] != cell:
                    if now is not None:
                        yield now.out()
                    cell, held, now = cells[s], [], None
                side = part.column("side").to_numpy()
                n = int((side == 0).sum())
                if n:
                    q = part.slice(0, n)
                    ends = [[(w["slot"], w["low"], w["high"], w["step"]) for w in row] for row in q.column("windows").to_pylist()]
                    held.append((q.column("vec_id").to_numpy(), q.column("label").to_numpy(), matrix(q), ends))
                if n < len(part):
                    if now is None and held:
                        now, held = opened(), []
                    if now is not None:
                        y = part.slice(n)
                        now.meet(y.column("vec_id").to_numpy(), y.column("label").to_numpy(), matrix(y))
        if now is not None:
            yield now.out()

    return run


WINDOWS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("slot", "low", "high", "step")]))


class _Deal:
    """How rows are dealt to cells: `parts` of the vectors by `groups` of the anchors, beside the dimension (and the label)."""

    def __init__(self, rows: DataFrame, every: int):
        n, anchors, dim = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0), F.max(F.size("v"))).first()
        spread = max(1, 2 * rows.sparkSession.sparkContext.defaultParallelism)
        self.parts = max(1, -(-n // max(1024, min(PART, -(-n // spread)))))
        self.groups = max(1, -(-anchors // max(256, CELL_BYTES // (8 * max(1, dim or 1)))))
        self.spread = spread

    def join(self, anchors: DataFrame, rows: DataFrame, other: bool, want: int) -> DataFrame:
        """anchor_id, slot, vec_id, score: the best rows of every window, from each part."""
        key = [F.size("v"), *([] if other else ["label"])]
        at = lambda c, n: F.pmod(F.xxhash64(F.col("vec_id"), F.lit(n), F.lit(c)), F.lit(n)).cast("int")
        q = anchors.withColumn("group", at("group", self.groups)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1))))
        y = rows.withColumn("part", at("part", self.parts)).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(self.groups - 1))))
        pick = lambda df, side, windows: df.select(F.xxhash64(*key, "part", "group").alias("cell"), F.lit(side).alias("side"), "vec_id", "label", "v", windows.cast(WINDOWS).alias("windows"))
        both = pick(q, 0, F.col("windows")).union(pick(y, 1, F.lit(None)))
        sides = both.repartition("cell").sortWithinPartitions("cell", "side")
        return sides.mapInArrow(_cells(other, want), FOUND)


def _best(found: DataFrame, want: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= want)


def labelled_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v array<double>: floor(256 x) of the rows that take part; of rows with one vec_id, the one with the smallest vector, then label."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    rows = vectors.where("label is not null and embedding is not null and vec_id is not null").where(fine & (F.size("embedding") > 0))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(whole.alias("v"), F.col("label").cast("long").alias("label")).alias("x")).groupBy("vec_id").agg(F.min("x").alias("x")).select("vec_id", "x.label", "x.v")


def hard_negatives(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of vectors (vec_id, label, embedding).

    Anchors are the rows whose vec_id is divisible by `every`. Rows with a null id, label or vector, an empty vector, or a null or
    non-finite component take no part; rows that repeat a vec_id count once, with the smallest vector and label. Only vectors of
    one dimension meet. Ties go to the smaller vec_id. A positive of score below 0 has an empty window, one of score 0 a window of
    0 alone. Empty tables give no rows; other columns are left out.
    """
    rows = saved(labelled_vectors(vectors), "negatives-rows")
    deal = _Deal(rows, every)
    anchors = rows.where(F.col("vec_id") % every == 0)
    widest = F.array(F.struct(F.lit(0).alias("slot"), F.lit(NONE + 1).alias("low"), F.lit(np.iinfo(np.int64).max).alias("high"), F.lit(NONE).alias("step")))
    near = saved(deal.join(anchors.withColumn("windows", widest), rows, False, positives), "negatives-near")
    pos = saved(_best(near, positives).select("anchor_id", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    forget(near)
    # ceil(LOW p / 100) and floor(HIGH p / 100), without products that a long can't hold
    p = F.col("positive_score")
    low = F.expr(f"(positive_score div 100) * {LOW} + cast(ceil((positive_score % 100) * {LOW} / 100d) as bigint)")
    high = F.expr(f"(positive_score div 100) * {HIGH} + cast(floor((positive_score % 100) * {HIGH} / 100d) as bigint)")
    unfilled = pos.where(p >= 0).select("anchor_id", "slot", "positive_score", low.alias("low"), high.alias("high"))
    done = None
    for n, share in enumerate((*STEPS, None)):
        step = F.col("low") if share is None else F.greatest("low", F.expr(f"cast(floor(positive_score * {share}d) as bigint)"))
        windows = unfilled.groupBy("anchor_id").agg(F.collect_list(F.struct("slot", "low", "high", step.alias("step"))).alias("windows"))
        open_ = anchors.join(windows.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
        met = saved(deal.join(open_, rows, True, negatives), f"negatives-met-{n}")
        best = saved(_best(met, negatives), f"negatives-best-{n}")
        forget(met)
        full = best.where(F.col("rank") == negatives).select("anchor_id", "slot")
        last = share is None
        kept = best if last else best.join(full, ["anchor_id", "slot"], "left_semi")
        done = kept if done is None else done.union(kept)
        if last:
            break
        # a window that has begun at its own end is as full as it gets
        left = saved(unfilled.join(full, ["anchor_id", "slot"], "left_anti"), f"negatives-left-{n}")
        forget(unfilled)
        unfilled = left
        if unfilled.isEmpty():
            break
    out = done.join(pos, ["anchor_id", "slot"])
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", turned.alias("label"), "embedding"))


ORACLE = """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) as bigint) as score
  from e a join e b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
), p as (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as nth from s where same),
n as (
  select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
    cast(row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id) as integer) as rank
  from p join s on p.anchor_id = s.anchor_id and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score where p.nth <= 5
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3
"""
