"""Benchmark decontamination: n-gram seeds join passages to test items, and Smith-Waterman alignment scores them.

Words are compared in lower case (A-Z) without ASCII signs. Seeds are ordered pairs of words that stand next to each other, or with one
word between. No copy escapes them: an alignment of L words of an item that reaches a share c of the full score has M matches, and
what lies between two matches in a row costs 2 at least unless both stand at most one word apart on either side; so at least
c L - 1 of these steps are seeds of text and item alike, within L + 2 L (1 - c) words of the text. Where as many seeds of an item begin,
the stretch around them is aligned, unless the words it shares with the item can't reach the score. A passage is a copy if its
local alignment reaches that share of the score of the whole item, and more than two words alone could score.

The benchmark is the stated query set: its items are dealt to groups of bounded size, and the documents stream past each group once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.arrays import U, buffers, lower_ascii, mix, plain_words, slices
from strandloom.llm.arrays import word_hashes
from strandloom.llm.common import forget, saved, table, tucked, untucked
from strandloom.llm.repeats import marked

#: Words that a seed reaches over; least words of an item; words that agree by chance; share of the full score of a copy.
REACH, SHORTEST, CHANCE, COPY = 2, 3, 2, 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words of the items of a group that workers hold; slots of the table that turns other pairs of words away; cells of the matrices aligned at a time.
GROUP, SLOTS, CELLS = 1 << 19, 1 << 22, 1 << 18


def _sequence(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word fingerprints, first word of each text and the end)."""
    sub, start, end, text = plain_words(lower_ascii(data), offs)
    return word_hashes(sub, start, end), np.searchsorted(text, np.arange(len(offs)))


def _item_rows(batches):
    for batch in slices(batches):
        hashes, first = _sequence(*buffers(batch.column(1)))
        lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(hashes.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["item_id", "words"])


def word_pairs(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, place of its first word) of all pairs of words at most REACH apart in one text."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    keys, places = [], []
    for gap in range(1, REACH + 1):
        at = np.flatnonzero(text[gap:] == text[:-gap])
        with np.errstate(over="ignore"):
            keys.append(mix(hashes[at] * U(3) + mix(hashes[at + gap])))
        places.append(at)
    return np.concatenate(keys), np.concatenate(places)


class Items:
    """Items of a group: their words, and the items that hold each seed."""

    def __init__(self, ids: np.ndarray, words: list[np.ndarray], least: float):
        self.ids, self.words, self.least = ids, words, least
        size = np.array([len(w) for w in words], np.int64)
        flat = np.concatenate([*words, np.zeros(0, np.int64)]).view(U)
        first = np.append(0, np.cumsum(size))
        keys, at = word_pairs(flat, first)
        owner = np.searchsorted(first, at, "right") - 1
        order = np.lexsort((owner, keys))
        keys, owner = keys[order], owner[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        keys, self.owner = keys[new], owner[new]
        self.keys, self.begin = np.unique(keys, return_index=True)
        self.end = np.append(self.begin[1:], len(keys))
        self.slots = np.zeros(SLOTS, bool)
        self.slots[(self.keys >> U(64 - (SLOTS.bit_length() - 1))).astype(np.int64)] = True
        #: Seeds that a copy has at least, and words of the text that they lie within.
        self.need = np.maximum(1, np.ceil(least * size - 1 - 1e-9)).astype(np.int64)
        self.span = np.ceil(size + 2 * size * (1 - least)).astype(np.int64)

    def stretches(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, begin, end) of the stretches of texts that hold enough seeds of an item, with as much around as a copy may reach."""
        keys, at = word_pairs(hashes, first)
        able = np.flatnonzero(self.slots[(keys >> U(64 - (SLOTS.bit_length() - 1))).astype(np.int64)])
        keys, at = keys[able], at[able]
        where = np.searchsorted(self.keys, keys)
        where[where == len(self.keys)] = 0
        hit = self.keys[where] == keys if len(self.keys) else np.zeros(len(keys), bool)
        where, at = where[hit], at[hit]
        many = self.end[where] - self.begin[where]
        item = self.owner[np.repeat(self.begin[where] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        at = np.repeat(at, many)
        text = np.searchsorted(first, at, "right") - 1
        key = (text * len(self.ids) + item) * (first[-1] + 1) + at  # by text, item and place
        key = np.unique(key)
        at, key = key % (first[-1] + 1), key // (first[-1] + 1)
        item, text = key % len(self.ids), key // len(self.ids)
        k = np.arange(len(key))
        last = k + self.need[item] - 1
        fits = last < len(key)
        last = np.where(fits, last, 0)
        fits &= (key[last] == key) & (at[last] - at <= self.span[item])
        k, last = k[fits], last[fits]
        key, item, text = key[k], item[k], text[k]
        begin = np.maximum(at[k] - self.span[item], first[text])
        end = np.minimum(at[last] + REACH + 1 + self.span[item], first[text + 1])
        new = np.ones(len(k), bool)
        new[1:] = (key[1:] != key[:-1]) | (begin[1:] > end[:-1])
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], len(k))[: len(lo)] - 1
        return text[lo], item[lo], begin[lo], end[hi]

    def scored(self, hashes: np.ndarray, item: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(share of the full score, word at which it ends) of stretches with their items; 0 where the shared words can't reach `least`, or
        the score is one that two words could have."""
        score, stop = np.zeros(len(item)), np.zeros(len(item), np.int64)
        values = hashes.view(np.int64)
        # each match takes a word of the item that stands in the stretch, and scores no more than its share
        able = [r for r in range(len(item)) if np.isin(self.words[item[r]], values[begin[r] : end[r]]).sum() >= self.least * len(self.words[item[r]])]
        size = end - begin
        order, at = sorted(able, key=lambda r: size[r]), 0
        while at < len(order):
            n = 1
            while at + n < len(order) and (n + 1) * size[order[at + n]] <= CELLS:
                n += 1
            rows = order[at : at + n]
            s, e = smith_waterman([values[begin[r] : end[r]] for r in rows], [self.words[item[r]] for r in rows])
            s = np.where(s > CHANCE * MATCH, s, 0)
            score[rows], stop[rows] = s / (MATCH * np.array([len(self.words[item[r]]) for r in rows])), e
            at += n
        return score, stop


def _scored(box):
    """(doc_id, mark, item_id, score, end_word) of the stretches of texts that are copies of an item."""

    def run(batches):
        items = Items(*box.value)
        for batch in slices(batches):
            hashes, first = _sequence(*buffers(batch.column(1)))
            text, item, begin, end = items.stretches(hashes, first)
            score, stop = items.scored(hashes, item, begin, end)
            keep = np.flatnonzero(score >= items.least)
            pick = pa.array(text[keep])
            ends = begin[keep] - first[text[keep]] + stop[keep]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(2).take(pick), pa.array(items.ids[item[keep]]), pa.array(score[keep]), pa.array(ends.astype(np.int64))], ["doc_id", "mark", "item_id", "score", "end_word"])

    return run


def smith_waterman(passages: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(best local score, word of the passage at which it ends) of each pair; a row of the matrix for all pairs at once."""
    count, wide, high = len(items), max(map(len, passages)), max(map(len, items))
    p = np.zeros((count, wide), np.int64)
    q = np.zeros((count, high), np.int64)
    for k, (a, b) in enumerate(zip(passages, items, strict=True)):
        p[k, : len(a)], q[k, : len(b)] = a, b
    in_p = np.arange(wide) < np.array([len(a) for a in passages])[:, None]
    in_q = np.arange(high) < np.array([len(b) for b in items])[:, None]
    step = -GAP * np.arange(wide + 1, dtype=np.int32)
    above = np.zeros((count, wide + 1), np.int32)
    best, where = np.zeros(count, np.int32), np.zeros(count, np.int64)
    for r in range(high):
        same = (p == q[:, r : r + 1]) & in_p & in_q[:, r : r + 1]
        row = np.zeros_like(above)
        row[:, 1:] = np.maximum(np.maximum(above[:, :-1] + np.where(same, np.int32(MATCH), np.int32(MISMATCH)), above[:, 1:] + GAP), 0)
        row = np.maximum.accumulate(row + step, axis=1) - step  # gaps in the item
        top = row.max(1)
        better = top > best
        best[better], where[better] = top[better], row[better].argmax(1) - 1
        above = row
    return best, where


def copies(docs: DataFrame, benchmark: DataFrame, least: float = COPY) -> DataFrame:
    """doc_id, mark, item_id, score, end_word of marked documents that hold a copy of an item; the best of each row and item."""
    spark = docs.sparkSession
    given = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    told = saved(given.mapInArrow(_item_rows, "item_id long, words array<long>"), "leaks-items")
    items = told.where(F.size("words") >= max(SHORTEST, math.floor(1 / least) + 1)).distinct()
    groups = max(1, -(-(items.agg(F.sum(F.size("words"))).first()[0] or 0) // GROUP))
    found = None
    for g in range(groups):  # about GROUP words each, however large the benchmark
        held = items.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(groups)) == g).toPandas()
        box = spark.sparkContext.broadcast((held["item_id"].to_numpy(np.int64), [np.asarray(w, np.int64) for w in held["words"]], least))
        hits = docs.select("doc_id", "text", "mark").mapInArrow(_scored(box), "doc_id long, mark long, item_id long, score double, end_word long")
        found = hits if found is None else found.union(hits)
    hits = saved(found, "leaks-scores")
    forget(told)
    best = F.max_by(F.struct("score", "end_word"), F.struct("score", -F.col("end_word"))).alias("best")
    return hits.groupBy("doc_id", "mark", "item_id").agg(best).select("doc_id", "mark", "item_id", "best.score", "best.end_word")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = COPY) -> DataFrame:
    """doc_id, item_id, score, end_word: each document that holds a copy of a benchmark item, with the share of the item's full
    alignment score (at least `least`) and the word at which the alignment ends, counted without words of signs alone.

    Documents without a copy have no row. Rows that repeat a doc_id with another text count each; rows that repeat both give
    one. Items of fewer than 3 words (or of 1 / least words or fewer) can't be told from chance and take no part, nor do null ids
    or texts of the benchmark;
    null texts of documents hold nothing. Of equal scores the earliest is told. Whole texts count; an empty table on either
    side gives no rows; other columns are left out.
    """
    return copies(marked(docs), benchmark, least).select("doc_id", "item_id", "score", "end_word")


def keep_clean(docs: DataFrame, benchmark: DataFrame, least: float = COPY) -> DataFrame:
    """docs without the rows that hold a copy of a benchmark item; the columns of docs."""
    bad = copies(marked(docs), benchmark, least).select(F.col("doc_id").alias("bad_id"), "mark").distinct()
    rows = tucked(docs, doc_id=F.col("doc_id"), own_mark=F.xxhash64("text"))
    return untucked(rows.join(bad, F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.col("own_mark") == F.col("mark")), "left_anti"), docs)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
