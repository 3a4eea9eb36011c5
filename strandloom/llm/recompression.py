"""Substring dedup by recompression: 50-word windows that also start in a document with a smaller id lose their words.

Rounds name runs of a symbol, then pairs of neighbours, and put one symbol in their place. A name is a function of what it
stands for, so it is the same in all documents and tasks without a dictionary; which symbols open a pair follows from their
names too. Inside equal substrings all symbols are therefore equal but for some at the borders. Each window keeps, round by
round, the symbols that its own words decide; the one of least rank on the highest level that remains is its anchor. Spark then joins the
anchors of all documents and verifies the windows around those that are shared.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.arrays import U, mix, word_hashes, words
from strandloom.llm.common import forget, saved, table
from strandloom.llm.repeats import ROW, marked, removed, row_maker, settle

WINDOW = 50
#: Kinds of the rounds: runs of words are named first; each round of pairs then shortens a text by about a quarter.
ROUNDS = ("run", "pair", "pair", "pair", "pair", "pair", "pair")
#: Rounds after which anchors are chosen, in place of those chosen before wherever a window has symbols left.
CHOOSE = (0, 3, 7)


def word_units(data: np.ndarray, offs: np.ndarray):
    start, end, text = words(data, offs)
    return word_hashes(data, start, end), np.searchsorted(text, np.arange(len(offs))), start, end


def _least(names: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the symbol of the least rank in each range [lo, hi), the leftmost of equals; ranks are fingerprints of names."""
    low = U((1 << 31) - 1)
    table = [(mix(names + U(0x51)) & ~low) | np.arange(len(names)).astype(U)]
    longest = int((hi - lo).max(initial=1))
    while 2 << (len(table) - 1) <= longest:
        half = 1 << (len(table) - 1)
        last = table[-1]
        table.append(np.append(np.minimum(last[:-half], last[half:]), last[-half:]))
    step = np.frexp((hi - lo).astype(float))[1] - 1
    out = np.empty(len(lo), U)
    for k in range(len(table)):
        of = np.flatnonzero(step == k)
        out[of] = np.minimum(table[k][lo[of]], table[k][hi[of] - (1 << k)])
    return (out & low).astype(np.int64)


def anchors(values: np.ndarray, first: np.ndarray, s: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(unit at which the anchor begins, key) for each window."""
    names, begin = values, np.arange(len(values))
    text = np.repeat(np.arange(len(first) - 1), first[1:] - first[:-1])
    lo, hi, live = s.copy(), s + width, np.arange(len(s))  # the symbols that each window decides on this level
    at, key = np.empty(len(s), np.int64), np.empty(len(s), U)
    with np.errstate(over="ignore"):
        for level, kind in enumerate((*ROUNDS, "end")):
            if level in CHOOSE:
                best = _least(names, lo, hi)
                at[live], key[live] = begin[best], mix(names[best] + U(level << 32))
            if kind == "end":
                break
            same_text = text[1:] == text[:-1]
            opens = np.ones(len(names), bool)  # does a symbol begin one of the next level
            if kind == "run":
                opens[1:] = ~((names[1:] == names[:-1]) & same_text)
                index = np.cumsum(opens) - 1
                head = np.flatnonzero(opens)
                size = np.diff(np.append(head, len(names)))
                new = np.where(size > 1, mix(names[head] + U(0x2545F4914F6CDD1D) * size.astype(U)), names[head])
                lo, hi = index[lo] + 1, index[hi - 1]  # a run at the border may go on outside
            else:
                right = (mix(names + U(level)) >> U(63)).astype(bool)
                joins = np.zeros(len(names), bool)
                joins[:-1] = ~right[:-1] & right[1:] & same_text
                opens[1:] = ~joins[:-1]
                index = np.cumsum(opens) - 1
                head = np.flatnonzero(opens)
                follow = np.minimum(head + 1, len(names) - 1)
                new = np.where(joins[head], mix(names[head] * U(0x9FB21C651E98DF25) + mix(names[follow])), names[head])
                lo = lo + right[lo]  # may close a pair that opens outside
                last = hi - 1
                hi = last + right[last]  # may open a pair that closes outside
                ok = lo < hi
                lo, hi = np.where(ok, index[np.minimum(lo, len(index) - 1)], 0), np.where(ok, index[hi - 1] + 1, 0)
            names, begin, text = new, begin[head], text[head]
            ok = lo < hi
            lo, hi, live = lo[ok], hi[ok], live[ok]
            if not len(live):
                break
    return at, key


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs (doc_id, text).

    Windows are judged on the input. Nulls: a null text has no words; a row with a null doc_id keeps all its words and takes
    none from others. Rows that repeat a doc_id don't count against each other. Texts of fewer than 50 words and empty texts
    stay whole, texts of any length are processed whole, and an empty table gives no rows; other columns are left out.
    """
    rows = marked(docs)
    found = saved(rows.where("doc_id is not null").mapInArrow(row_maker(word_units, anchors, WINDOW), ROW), "recompression-rows")
    # a symbol that stands in two documents, whatever else it stands in
    keys = saved(found.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("key"), "recompression-keys")
    alive = saved(found.join(keys, "key"), "recompression-alive")
    forget(found, keys)
    settled = settle(alive, of_smaller=True)
    out = removed(rows, settled, word_units, WINDOW, of_smaller=True)
    return out.select("doc_id", F.col("n").alias("n_words"), "n_removed", "kept_sha256", "n_spans")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))
