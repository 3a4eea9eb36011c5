"""N-gram Jaccard join by signature trees, and the classes of documents that links connect.

Documents of equal shingle sets are one node. A link bounds the symmetric difference of two sets by their sizes; so if the
tokens of a size class are dealt into one part more than that bound, two linked sets agree on a whole part. The parts are the
roots of a forest of signature trees: only sets below a common root can link. Below a root every set is first verified against
the root's pivot, which ties nearly all groups of copies together. Where sets of different components remain, a tree is built:
its nodes hold the union of their members' token bitmaps and size ranges, and a dual traversal drops node pairs that can't
reach the overlap of a link, or that one component holds already. What is left is verified on the sets themselves, and a block
of members gives no more links than it takes to tie its components. Sets meet first in the largest of their open roots, then in
all that are still open; roots of many blocks last, sets outside their largest component against the others.
"""

from __future__ import annotations

import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.llm.arrays import Fingerprints, U, buffers, lower_ascii, mix, slices, word_hashes, words
from strandloom.llm.common import components, forget, saved, table, tucked, untucked
from strandloom.llm.repeats import marked, window_starts

#: 64-bit words of a bitmap; children of a tree's node; members and tokens of a block of a large group.
BITMAP, FAN, BLOCK, BLOCK_TOKENS = 32, 8, 512, 1 << 20


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first token of each text and the end, distinct tokens in ascending order by text)."""
    start, end, text = words(data, offs)
    hashes = word_hashes(lower_ascii(data), start, end)
    first = np.searchsorted(text, np.arange(len(offs)))
    prints, size = Fingerprints(hashes, 0), first[1:] - first[:-1]
    s = window_starts(first, n)
    short = np.flatnonzero((size > 0) & (size < n))
    token = np.concatenate([prints.of(s, s + n), prints.of(first[short], first[short + 1])])
    owner = np.concatenate([text[s] if len(s) else np.zeros(0, np.int64), short])
    order = np.lexsort((token, owner))
    token, owner = token[order], owner[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    token, owner = token[new], owner[new]
    return np.searchsorted(owner, np.arange(len(offs))), token


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum(values, out=total[1:])
        return total[first[1:]] - total[first[:-1]]


def set_prints(first: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two fingerprints of each set."""
    n = (first[1:] - first[:-1]).astype(U)
    with np.errstate(over="ignore"):
        return mix(_sums(mix(token), first) + n), mix(_sums(mix(token ^ U(0x6A09E667F3BCC909)), first) + n)


class Classes:
    """Size classes, such that linked sets lie in one class or in neighbours, and the parts of each."""

    def __init__(self, num: int, den: int, largest: int):
        low, parts, bound = [1], [], []
        while low[-1] <= largest:
            low.append(low[-1] * den // num + 1)
        for a, b in zip(low[:-1], low[1:], strict=True):
            k = (den - num) * (b - 1) // num  # most tokens in which sets of this size and the next can differ
            p = k + 1
            for _ in range(20):  # spare parts for those that stay empty
                empty = p * np.exp(-a / p)
                more = k + 1 + int(empty + 3.5 * np.sqrt(empty)) if k else 1
                if more <= p or more > a:
                    break
                p = more
            parts.append(p)
            bound.append(k)
        self.low, self.parts, self.bound = np.array(low), np.array(parts or [1]), np.array(bound or [0])
        self.reach = np.array([(b - 1) * den // num for b in low[1:]] or [0])  # largest partner of a set of the class


def part_keys(first: np.ndarray, token: np.ndarray, classes: Classes, below: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of the parts of each set in its own size class (below 0) or, as the larger of a pair, in the one below (1)."""
    size = first[1:] - first[:-1]
    c = np.searchsorted(classes.low, size, "right") - 1 - below
    c[(size == 0) | (c < 0)] = -1
    ok = c >= 0
    ok[ok] &= size[ok] <= classes.reach[c[ok]] if below else True
    p = np.where(ok, classes.parts[np.maximum(c, 0)], 0)
    base = np.zeros(len(p) + 1, np.int64)
    np.cumsum(p, out=base[1:])
    owner = np.repeat(np.arange(len(size)), size)
    use = ok[owner]
    owner, t = owner[use], token[use]
    with np.errstate(over="ignore"):
        salt = c[owner].astype(U) * U(0xA24BAED4963EE407)
        slot = base[owner] + (mix(t + salt) % p[owner].astype(U)).astype(np.int64)
        order = np.argsort(slot)
        edge = np.searchsorted(slot[order], np.arange(base[-1] + 1))
        total = _sums(mix(t ^ U(0x3C6EF372FE94F82B))[order], edge)
        filled = edge[1:] > edge[:-1]
        text = np.repeat(np.arange(len(p)), p)
        part = (np.arange(base[-1]) - base[text]).astype(U)
        key = mix(total + mix(part + (c[text].astype(U) << U(40)) + U(1)))
    # empty parts say nothing unless so many are empty that the rest could all differ
    enough = np.bincount(text[filled], minlength=len(p)) > classes.bound[np.maximum(c, 0)]
    emit = filled | ~enough[text]
    return text[emit], key[emit]


def _bitmaps(first: np.ndarray, token: np.ndarray) -> list[np.ndarray]:
    """The bitmap of each set: a power of two of bits, BITMAP words at least and four or more a token."""
    size = first[1:] - first[:-1]
    words = 1 << np.ceil(np.log2(np.maximum(size * 4 / 64, BITMAP))).astype(int)
    base = np.append(0, np.cumsum(words))
    out = np.zeros(base[-1], U)
    owner = np.repeat(np.arange(len(size)), size)
    bit = mix(token + U(77)) & (words[owner].astype(U) * U(64) - U(1))
    np.bitwise_or.at(out, base[owner] + (bit >> U(6)).astype(int), U(1) << (bit & U(63)))
    return [out[x:y] for x, y in zip(base[:-1], base[1:], strict=True)]


def _folded(bitmaps: list[bytes]) -> np.ndarray:
    """Bitmaps of the width of the least of them: a bit of a wider one falls on the bit of the same rest."""
    rows = [np.frombuffer(x, U) for x in bitmaps]
    width = min(map(len, rows))
    return np.stack([np.bitwise_or.reduce(r.reshape(-1, width)) for r in rows])


def _set_rows(n: int):
    def run(batches):
        for batch in slices(batches):
            first, token = shingle_sets(*buffers(batch.column(1)), n)
            a, b = set_prints(first, token)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(first[1:] - first[:-1]), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["doc_id", "mark", "n", "print", "print2"]
            )

    return run


def _key_rows(n: int, classes: Classes):
    def run(batches):
        seen: set[int] = set()  # equal sets of a task send their keys once
        for batch in slices(batches):
            first, token = shingle_sets(*buffers(batch.column(0)), n)
            prints, _ = set_prints(first, token)
            new = np.zeros(len(prints), bool)
            for i, x in enumerate(prints.tolist()):
                if x not in seen:
                    seen.add(x)
                    new[i] = True
            for below in (0, 1):
                text, key = part_keys(first, token, classes, below)
                use = new[text]
                yield pa.RecordBatch.from_arrays([pa.array(key[use].view(np.int64)), pa.array(prints[text[use]].view(np.int64))], ["key", "print"])

    return run


def _tokens(n: int):
    def run(batches):
        for batch in slices(batches):
            first, token = shingle_sets(*buffers(batch.column(batch.schema.get_field_index("text"))), n)
            prints, _ = set_prints(first, token)
            tokens = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(token.view(np.int64)))
            bitmaps = _bitmaps(first, token)
            names = ["node", "print", "pivot", "is_pivot"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(x)) for x in names), pa.array(prints.view(np.int64)), pa.array(first[1:] - first[:-1]), tokens, pa.array([r.tobytes() for r in bitmaps], pa.binary())],
                [*names, "found", "n", "tokens", "bitmap"],
            )

    return run


class Tree:
    """Levels of nodes over sets ordered by size and bitmap; level 0 are the sets."""

    def __init__(self, size: np.ndarray, bits: np.ndarray, component: np.ndarray):
        count = np.bitwise_count(bits).sum(1).astype(np.int64)
        self.levels = [(bits, size, size, count, component, component)]
        while len(self.levels[-1][1]) > 1:
            b, lo, hi, few, c0, c1 = self.levels[-1]
            at = np.arange(0, len(lo), FAN)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.minimum.reduceat(few, at), np.minimum.reduceat(c0, at), np.maximum.reduceat(c1, at)))


def _possible(x: tuple, y: tuple, i: np.ndarray, j: np.ndarray, num: int, den: int, leaf: bool, most: int = 1 << 22) -> np.ndarray:
    """May any set below node i link to one below node j, of another component? Bitmaps are compared `most` words at a time."""
    lo_x, hi_x, few_x, c0x, c1x = (v[i] for v in x[1:])
    lo_y, hi_y, few_y, c0y, c1y = (v[j] for v in y[1:])
    ok = ~((c0x == c1x) & (c0y == c1y) & (c0x == c0y)) & (den * hi_x >= num * lo_y) & (den * hi_y >= num * lo_x)
    at, step = np.flatnonzero(ok), max(1, most // x[0].shape[1])
    for part in (at[k : k + step] for k in range(0, len(at), step)):
        bx, by = x[0][i[part]], y[0][j[part]]
        if leaf:
            apart = np.bitwise_count(bx ^ by).sum(1).astype(np.int64)  # each differing bit needs a token that only one set has
            ok[part] = (den + num) * apart <= (den - num) * (lo_x[part] + lo_y[part])
        else:
            both = np.bitwise_count(bx & by).sum(1).astype(np.int64)
            overlap = np.minimum(hi_x[part] - np.maximum(few_x[part] - both, 0), hi_y[part] - np.maximum(few_y[part] - both, 0))
            ok[part] = (den + num) * overlap >= num * (lo_x[part] + lo_y[part])
    return ok


def dual_traversal(x: Tree, y: Tree | None, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets that their bitmaps let link; y None: within x, each pair once."""
    own, y = y is None, y or x
    depth = max(len(x.levels), len(y.levels)) - 1
    level = lambda t, d: t.levels[min(d, len(t.levels) - 1)]
    i = j = np.zeros(1, np.int64)
    for d in range(depth, -1, -1):
        keep = _possible(level(x, d), level(y, d), i, j, num, den, d == 0)
        if d == 0 and own:
            keep &= i != j
        i, j = i[keep], j[keep]
        if d == 0 or not len(i):
            return i, j
        # children of both; a root that is a leaf already stays
        kids = lambda t, a: (a[:, None] * FAN + np.arange(FAN) if d < len(t.levels) else np.repeat(a[:, None], 1, 1))
        a, b = kids(x, i), kids(y, j)
        i, j = np.repeat(a, b.shape[1], 1).ravel(), np.tile(b, (1, a.shape[1])).ravel()
        inside = (i < len(level(x, d - 1)[1])) & (j < len(level(y, d - 1)[1]))
        if own:
            inside &= i <= j
        i, j = i[inside], j[inside]
    return i, j


class Block:
    """The rows of one task below a root: members (side 0), compared with each other, or with those of side 1 if there are any."""

    def __init__(self, rows: pa.Table):
        side, self.node = np.asarray(rows["side"]), np.asarray(rows["node"])
        size, component = np.asarray(rows["n"]), np.asarray(rows["component"])
        self.component = np.unique(component, return_inverse=True)[1]
        self.bits = _folded(rows["bitmap"].to_pylist())
        self.size, self.trees, self.at = size, [], []
        for s in (0, 1):
            at = np.flatnonzero(side == s)
            if not len(at):
                continue
            at = at[np.lexsort((self.bits[at, 1], self.bits[at, 0], size[at]))]
            self.trees.append(Tree(size[at], self.bits[at], self.component[at]))
            self.at.append(at)

    def candidates(self, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows of different components that their bitmaps let link."""
        a, b = dual_traversal(self.trees[0], self.trees[1] if len(self.trees) > 1 else None, num, den)
        return self.at[0][a], self.at[-1][b]


def _survivors(num: int, den: int):
    """The members of a block that have a candidate in it."""

    def run(rows):
        block = Block(rows)
        a, b = block.candidates(num, den)
        at = np.unique(np.concatenate([a, b]))
        return rows.select(["key", "i", "j", "side", "node", "component"]).take(pa.array(at))

    return run


def _links_of_block(num: int, den: int):
    """Verified links (a, b) of a block that tie its components: at most one less than there are components."""

    def run(rows):
        block = Block(rows)
        a, b = block.candidates(num, den)
        step = max(1, (1 << 22) // block.bits.shape[1])
        apart = np.concatenate([np.bitwise_count(block.bits[a[k : k + step]] ^ block.bits[b[k : k + step]]).sum(1) for k in range(0, len(a), step)] or [a])
        lists = rows["tokens"].combine_chunks()
        offs, flat = np.asarray(lists.offsets), np.asarray(lists.values)
        label, open_, out = block.component.copy(), len(np.unique(block.component)), []
        for p in np.argsort(apart, kind="stable"):
            x, y = a[p], b[p]
            if label[x] == label[y]:
                continue
            both = len(np.intersect1d(flat[offs[x] : offs[x + 1]], flat[offs[y] : offs[y + 1]], assume_unique=True))
            if both * den >= (block.size[x] + block.size[y] - both) * num:
                out.append((block.node[x], block.node[y]))
                label[label == label[y]] = label[x]
                open_ -= 1
                if open_ == 1:
                    break
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def released(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def linked(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, mark, n_shingles, component_id of each row of marked documents (see jaccard_components)."""
    sets_table = f"jaccard_sets_{uuid.uuid4().hex[:12]}"
    try:
        return _linked(docs, n, num, den, sets_table)
    finally:
        docs.sparkSession.sql(f"drop table if exists {sets_table}")


def _linked(docs: DataFrame, n: int, num: int, den: int, sets_table: str) -> DataFrame:
    spark = docs.sparkSession
    base = saved(docs.mapInArrow(_set_rows(n), "doc_id long, mark long, n long, print long, print2 long"), "jaccard-base")
    named = base.where("n > 0 and doc_id is not null")
    classes = saved(named.groupBy("n", "print", "print2").agg(F.min("doc_id").alias("node")), "jaccard-classes")
    largest = classes.agg(F.max("n")).first()[0] or 0
    ask = docs.where("doc_id is not null").select("text")
    keys = ask.mapInArrow(_key_rows(n, Classes(num, den, largest)), "key long, print long")
    pivot = F.min("print").over(Window.partitionBy("key"))
    below = saved(keys.withColumn("pivot", pivot).where("print <> pivot").distinct(), "jaccard-roots")
    del keys
    released(spark)
    pairs = saved(below.groupBy("print", "pivot").agg(F.count("*").alias("roots")), "jaccard-pairs")
    first = pairs.groupBy("print").agg(F.max_by("pivot", F.struct("roots", "pivot")).alias("pivot"))
    nodes = (
        first.select("print", "pivot", F.lit(False).alias("p"))
        .union(pairs.select(F.col("pivot").alias("print"), F.lit(None).cast("long"), F.lit(True)))
        .groupBy("print")
        .agg(F.max("pivot").alias("pivot"), F.max("p").alias("is_pivot"))
        .join(classes.select("print", "node"), "print")
    )
    # dealt by doc_id, which is a node's own: repeated rows meet in the join's own partitions, and a task writes one bucket below
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.where("doc_id is not null").repartition(buckets, "doc_id")
    texts = dealt.join(nodes, dealt["doc_id"] == nodes["node"]).groupBy("node", "print", "mark").agg(F.first("text").alias("text"), F.first("pivot").alias("pivot"), F.first("is_pivot").alias("is_pivot")).select("text", "node", "print", "pivot", "is_pivot")
    schema = "node long, print long, pivot long, is_pivot boolean, found long, n long, tokens array<long>, bitmap binary"
    # in buckets by node, so that the sets are not shuffled again each time that pairs ask for their tokens
    tokens = texts.mapInArrow(_tokens(n), schema).where("found = print").drop("found")
    tokens.write.bucketBy(buckets, "node").option("compression", "zstd").format("parquet").saveAsTable(sets_table)
    sets = spark.table(sets_table)
    released(spark)

    def links(joined: DataFrame) -> DataFrame:
        """Pairs with tokens on both sides (a, n_a, tokens_a, b, n_b, tokens_b) that link."""
        fits = (F.col("n_a") * den >= F.col("n_b") * num) & (F.col("n_b") * den >= F.col("n_a") * num)
        both = F.size(F.array_intersect("tokens_a", "tokens_b"))
        return joined.where(fits).withColumn("both", both).where(F.col("both") * den >= (F.col("n_a") + F.col("n_b") - F.col("both")) * num).select("a", "b")

    side = lambda df, s, *more: df.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("tokens").alias(f"tokens_{s}"), *more)
    a, b = side(sets.where("pivot is not null"), "a", "pivot"), side(sets.where("is_pivot"), "b", F.col("print").alias("pivot"))
    edges = [saved(links(a.join(b, "pivot")), "jaccard-links")]
    found = components(edges[0], "jaccard-components")

    ids = sets.select("print", "node", "n").distinct()
    label = lambda df, c: df.join(found.withColumnRenamed("node", c), c, "left").withColumn(f"in_{c}", F.coalesce("component", F.col(c))).drop("component")

    def checked(candidates: DataFrame, name: str) -> DataFrame:
        """Links among candidate pairs (a, b) of nodes."""
        return saved(links(candidates.join(side(sets, "a"), "a").join(side(sets, "b"), "b")), name)

    # further pivots of sets that their first pivot did not tie to the same component
    other = pairs.join(first.select("print", F.col("pivot").alias("was")), "print").where("pivot <> was")
    other = other.join(ids.select("print", F.col("node").alias("a")), "print").join(ids.select(F.col("print").alias("pivot"), F.col("node").alias("b")), "pivot")
    other = label(label(other.select("a", "b"), "a"), "b").where("in_a <> in_b").select("a", "b").distinct()
    edges.append(checked(other, "jaccard-more"))
    found = saved(components(edges[0].union(edges[1]), "jaccard-components"), "jaccard-found")

    ids = saved(ids, "jaccard-ids")
    member = saved(below.select("key", "print").join(ids, "print").select("key", "node", "n"), "jaccard-members")
    forget(below, pairs)

    def open_roots(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Roots below which sets of several components remain (key, major, minor, blocks), and their members with components."""
        told = label(member, "node").withColumnRenamed("in_node", "component")
        one = told.groupBy("key", "component").agg(F.count("*").alias("m"), F.sum("n").alias("tokens"))
        roots = one.groupBy("key").agg(F.max_by("component", F.struct("m", "component")).alias("major"), F.max("m").alias("most"), F.sum("m").alias("m"), F.sum("tokens").alias("tokens"), F.count("*").alias("kinds")).where("kinds > 1")
        blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("tokens") / BLOCK_TOKENS))
        guests = F.ceil(F.greatest((F.col("m") - F.col("most")) / BLOCK, F.lit(1)))
        # written before it is joined, so that the join can split a root that many sets share
        roots = saved(roots.select("key", "major", "m", blocks.alias("blocks"), guests.alias("guests")), "jaccard-open")
        return roots, saved(told.join(roots, "key"), "jaccard-open-members")

    def in_trees(dealt: DataFrame) -> DataFrame:
        """Verified links among the rows (key, i, j, side, node, component) of each (key, i, j)."""
        sketched = dealt.join(sets.select("node", "n", "bitmap"), "node")
        left = saved(sketched.groupBy("key", "i", "j").applyInArrow(_survivors(num, den), "key long, i long, j long, side int, node long, component long"), "jaccard-survivors")
        verified = left.join(sets.select("node", "n", "bitmap", "tokens"), "node").groupBy("key", "i", "j").applyInArrow(_links_of_block(num, den), "a long, b long")
        out = saved(verified, "jaccard-tree-links")
        forget(left)
        return out

    def tied(found: DataFrame, new: DataFrame) -> DataFrame:
        if new.isEmpty():
            return found
        stars = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        return saved(components(stars.union(new), "jaccard-components"), "jaccard-found")

    block = lambda by: F.pmod(F.xxhash64("node"), F.col(by))
    none = F.lit(0).cast("long")
    # every set in the largest of its open roots, then in all that are still open
    largest_root = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("m"), "key"))
    inside = lambda rows: rows.select("key", block("blocks").alias("i"), none.alias("j"), F.lit(0).alias("side"), "node", "component")
    roots, members = open_roots(found)
    for once in (True, False):
        if not roots.isEmpty():
            found = tied(found, in_trees(inside(members.withColumn("nth", largest_root).where("nth = 1") if once else members)))
            forget(roots, members)
            roots, members = open_roots(found)
    # roots of several blocks: sets outside the largest component against all others, in blocks
    if not roots.where("blocks > 1").isEmpty():
        wide = members.where("blocks > 1")
        asked = wide.where("component <> major").withColumn("j", block("guests")).withColumn("i", F.explode(F.sequence(none, F.col("blocks") - 1)))
        held = wide.withColumn("i", block("blocks")).withColumn("j", F.explode(F.sequence(none, F.col("guests") - 1)))
        columns = ["key", "i", "j", "side", "node", "component"]
        found = tied(found, in_trees(asked.withColumn("side", F.lit(0)).select(*columns).union(held.withColumn("side", F.lit(1)).select(*columns))))

    label_of = saved(classes.join(found, "node", "left").select(F.col("n").alias("cn"), F.col("print").alias("cp"), F.col("print2").alias("cq"), F.coalesce("component", "node").alias("component_id")), "jaccard-labels")
    of_class = named.join(label_of, (F.col("n") == F.col("cn")) & (F.col("print") == F.col("cp")) & (F.col("print2") == F.col("cq")))
    columns = ["doc_id", "mark", F.col("n").alias("n_shingles"), "component_id"]
    alone = base.where("n = 0 or doc_id is null").withColumn("component_id", F.col("doc_id"))
    return of_class.select(*columns).unionByName(alone.select(*columns))


def jaccard_components(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id: documents linked by a Jaccard similarity of n-word shingle sets of num / den or more.

    Words are blank-separated with A-Z in lower case; a text of fewer than n words is one shingle, one without words has none
    and links with nothing, as does a null text. component_id is the smallest doc_id reachable by links. Rows that repeat a
    doc_id are one document with a set each; a row with a null doc_id links with nothing and has a null component. Similarity
    exactly at the threshold links. Whole texts count; an empty table gives no rows; other columns are left out.
    """
    return linked(marked(docs), n, num, den).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each group of linked rows, that of the smallest doc_id; the columns of docs.

    Of rows that repeat the kept doc_id one stays, that of the smallest mark of its text. Rows without words stay, but once where
    doc_id and text repeat: of rows that repeat both the first by a hash of all columns. Rows with a null doc_id all stay.
    """
    found = saved(linked(marked(docs), n, num, den), "jaccard-decided")
    loose = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    decided = found.where(~loose)
    first = decided.where("doc_id = component_id").groupBy("doc_id").agg(F.min("mark").alias("mark"))
    gone = decided.join(first, ["doc_id", "mark"], "left_anti").select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark")).distinct()
    order = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))
    rows = tucked(docs, doc_id=F.col("doc_id"), mark=F.xxhash64("text"), order=order)
    left = rows.where("doc_id is not null").join(gone, (F.col("doc_id") == F.col("gone_id")) & (F.col("mark") == F.col("gone_mark")), "left_anti")
    copy = F.row_number().over(Window.partitionBy("doc_id", "mark").orderBy("order"))
    kept = left.withColumn("copy", copy).where("copy = 1").select("row").union(rows.where("doc_id is null").select("row"))
    return untucked(kept, docs)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
