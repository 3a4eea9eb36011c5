"""What the two substring operators share: windows of fixed length that repeat, found through anchors and verified whole.

A window is W consecutive units (bytes or words) of one text. An operator names, from the content of a window alone, an anchor
inside it; so equal windows have equal anchors at equal offsets. Neighbouring windows of a text with the same anchor form one
row (s_lo..s_hi, the anchor's key, a fingerprint of all their content). Rows whose key repeats are compared: those of equal
content together settle all their windows at once. Where contents differ, one row of each (of its least document, every row, if
only smaller documents count) is cut into parts by the offset of the anchor and compared again by what all windows of a part hold; what is still open is taken apart into windows. Fingerprints are compared in pairs of 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.arrays import Fingerprints, buffers, mix, slices
from strandloom.llm.common import forget, saved

ROW = "doc_id long, mark long, s_lo int, s_hi int, at int, key long, full long"
NAMES = ["doc_id", "mark", "s_lo", "s_hi", "at", "key", "full"]
RANGES = "array<struct<lo:int,hi:int>>"
#: Parts into which the offsets of a window's length are cut.
PARTS = 16
#: (bytes, offsets) -> (values of the units, first unit of each text and the end, start and end of each unit in the bytes)
Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]]


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, text and a mark of the text: rows that share a doc_id but not the text stay apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("mark"))


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    """Starts of all windows that lie inside one text; first: the first unit of each text, and the end."""
    n = int(first[-1])
    room = np.zeros(n + 1, np.int64)
    long = first[1:] - first[:-1] >= width
    np.add.at(room, first[:-1][long], 1)
    np.add.at(room, first[1:][long] - width + 1, -1)
    return np.flatnonzero(np.cumsum(room)[:n] > 0)


def row_maker(units: Units, anchors: Callable, width: int, head: int = 0):
    """Arrow batches of (doc_id, text, mark) to anchor rows; head: so many bytes from the anchor on go with them."""

    def run(batches):
        for batch in slices(batches):
            data, offs = buffers(batch.column(1))
            values, first, _, _ = units(data, offs)
            s = window_starts(first, width)
            if not len(s):
                continue
            at, key = anchors(values, first, s)
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1] + 1) | (at[1:] != at[:-1]) | (key[1:] != key[:-1])
            lo = np.flatnonzero(new)
            hi = np.append(lo[1:], len(s)) - 1
            s_lo, s_hi, key = s[lo], s[hi], key[lo]
            text = np.searchsorted(first, s_lo, "right") - 1
            prints = Fingerprints(values, 1)
            full = prints.of(s_lo, s_hi + width) + (at[lo] - s_lo).astype(np.uint64)
            base = first[text]
            pick = pa.array(text)
            heads = []
            if head:
                flat = np.ascontiguousarray(data[at[lo][:, None] + np.arange(head)])
                heads = [pa.BinaryArray.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer((np.arange(len(lo) + 1) * head).astype(np.int32)), pa.py_buffer(flat)])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pick), batch.column(2).take(pick), pa.array((s_lo - base).astype(np.int32)), pa.array((s_hi - base).astype(np.int32)), pa.array((at[lo] - base).astype(np.int32)), pa.array(key.view(np.int64)), pa.array(full.view(np.int64)), *heads],
                [*NAMES, "head"][: len(NAMES) + len(heads)],
            )

    return run


def settle(alive: DataFrame, of_smaller: bool) -> DataFrame:
    """Per row of documents with repeats: doc_id, mark, covered ranges of window starts, and unclear ones with their keys.

    of_smaller: a window counts if it starts in a document with a smaller id; otherwise if it starts anywhere else.
    """
    place = F.struct("doc_id", "mark", "s_lo", "s_hi", "at")
    by_full = saved(
        alive.groupBy("key", "full").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.min(place).alias("place")), "repeats-full"
    )
    mixed = by_full.groupBy("key").agg(F.count("*").alias("kinds"), F.min("least").alias("first"), F.max("least").alias("last")).where("kinds > 1")
    if of_smaller:
        mixed = mixed.where("first < last")
    mixed = saved(mixed.select("key", "first"), "repeats-mixed")  # read from both sides, the join below can split a key that many rows share
    unclear = by_full.join(mixed, "key")
    if of_smaller:
        # the least document of a content may hold it more than once; unless it is the least of its key too, each of its rows is still open
        several = F.col("least") > F.col("first")
        same = by_full.where("n > 1").join(mixed, "key", "left").select("key", "full", "least", F.coalesce(several, F.lit(False)).alias("several"))
        met = alive.join(saved(same, "repeats-same"), ["key", "full"])
        covered = met.where("doc_id > least")
        unclear = unclear.where((F.col("n") == 1) | ~several).select("place.*", "key").unionByName(met.where("several and doc_id = least").select("doc_id", "mark", "s_lo", "s_hi", "at", "key"))
    else:
        covered = alive.join(by_full.where("n > 1").select("key", "full"), ["key", "full"])
        unclear = unclear.select("place.*", "key")
    one = F.struct(F.col("s_lo").alias("lo"), F.col("s_hi").alias("hi"))
    parts = covered.select("doc_id", "mark", one.alias("covered"), F.lit(None).cast("struct<lo:int,hi:int,at:int,key:bigint>").alias("unclear")).unionByName(
        unclear.select("doc_id", "mark", F.lit(None).cast("struct<lo:int,hi:int>").alias("covered"), F.struct(F.col("s_lo").alias("lo"), F.col("s_hi").alias("hi"), "at", "key").alias("unclear"))
    )
    return parts.groupBy("doc_id", "mark").agg(F.collect_set("covered").alias("covered"), F.collect_set("unclear").alias("unclear"))


def _ranges(column: pa.Array, names=("lo", "hi")) -> tuple[np.ndarray, ...]:
    """(row of each element, its fields) of a column of arrays of structs."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.array(column.value_lengths().fill_null(0))
    flat = column.flatten()
    return (np.repeat(np.arange(len(size)), size), *(np.asarray(flat.field(n)) for n in names))


def digest_batch(batch: pa.RecordBatch, units: Units, width: int, lists: list[pa.Array]) -> dict[str, list]:
    """n units, n_removed, n_spans and kept_sha256 of each text, without the units that the windows in lists cover."""
    data, offs = buffers(batch.column(batch.schema.get_field_index("text")))
    _, first, begin, end = units(data, offs)
    gone = np.zeros(int(first[-1]) + 1, np.int64)
    for column in lists:
        row, lo, hi = _ranges(column)[:3]
        np.add.at(gone, first[row] + lo, 1)
        np.add.at(gone, first[row] + hi + width, -1)
    gone = np.cumsum(gone)[:-1] > 0
    total = np.zeros(len(gone) + 1, np.int64)
    np.cumsum(gone, out=total[1:])
    starts = gone.copy()
    starts[1:] &= ~gone[:-1]
    inner = first[:-1][first[:-1] < len(gone)]
    starts[inner] |= gone[inner]
    spans = np.zeros(len(gone) + 1, np.int64)
    np.cumsum(starts, out=spans[1:])
    if begin is None:
        kept, cut = data[~gone], first - total[first]
    else:  # kept words, each but the last of its text followed by one space
        keep = np.flatnonzero(~gone)
        text = np.searchsorted(first, keep, "right") - 1
        more = np.zeros(len(keep), bool)
        more[:-1] = text[1:] == text[:-1]
        mask = np.zeros(len(data) + 1, np.int64)
        np.add.at(mask, begin[keep], 1)
        np.add.at(mask, end[keep], -1)
        mask = np.cumsum(mask)[:-1] > 0
        data = data.copy()
        gap = end[keep[more]]
        data[gap], mask[gap] = 32, True
        size = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=size[1:])
        kept, cut = data[mask], size[offs]
    raw = kept.tobytes()
    return {
        "n": first[1:] - first[:-1],
        "n_removed": total[first[1:]] - total[first[:-1]],
        "n_spans": spans[first[1:]] - spans[first[:-1]],
        "kept_sha256": [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cut[:-1], cut[1:], strict=True)],
    }


def removed(docs: DataFrame, settled: DataFrame, units: Units, width: int, of_smaller: bool) -> DataFrame:
    """doc_id, n, n_removed, n_spans, kept_sha256 for every row of marked documents."""
    same_row = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["mark"] == b["mark"])
    told = docs.join(settled, same_row(docs, settled), "left").select(docs["doc_id"], docs["mark"], "text", "covered", "unclear")
    digest = "n long, n_removed long, n_spans long, kept_sha256 string"

    def first_pass(batches):
        for batch in slices(batches):
            d = digest_batch(batch, units, width, [batch.column(3)])
            open_rows = np.array(batch.column(4).value_lengths().fill_null(0)) > 0
            texts = batch.column(2).take(pa.array(np.arange(len(open_rows)), mask=~open_rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), texts, batch.column(3), batch.column(4), pa.array(d["n"]), pa.array(d["n_removed"]), pa.array(d["n_spans"]), pa.array(d["kept_sha256"])],
                ["doc_id", "mark", "text", "covered", "unclear", "n", "n_removed", "n_spans", "kept_sha256"],
            )

    done = saved(
        told.mapInArrow(first_pass, f"doc_id long, mark long, text string, covered {RANGES}, unclear array<struct<lo:int,hi:int,at:int,key:bigint>>, {digest}"), "repeats-first"
    )
    forget(settled)
    open_docs = done.where("text is not null").select("doc_id", "mark", "text", "covered", "unclear")
    step = max(1, width // PARTS)

    def parts(batches):
        for batch in slices(batches):
            values, first, _, _ = units(*buffers(batch.column(2)))
            row, lo, hi, at, key = _ranges(batch.column(4), ("lo", "hi", "at", "key"))
            least, most = (at - hi) // step, (at - lo) // step
            size = (most - least + 1).astype(np.int64)
            part = np.repeat(least, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            row, lo, hi, at, key = (np.repeat(x, size) for x in (row, lo, hi, at, key))
            lo, hi = np.maximum(lo, at - (part + 1) * step + 1), np.minimum(hi, at - part * step)
            base, prints = first[row], Fingerprints(values, 1)
            inner = prints.of(base + at - part * step, base + at - (part + 1) * step + 1 + width)
            with np.errstate(over="ignore"):
                inner = mix(inner + mix(key.view(np.uint64) + part.astype(np.uint64)))
            full = prints.of(base + lo, base + hi + width) + (at - lo).astype(np.uint64)
            pick = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pick), batch.column(1).take(pick), *(pa.array(x.astype(np.int32)) for x in (lo, hi, at)), pa.array(inner.view(np.int64)), pa.array(full.view(np.int64))], NAMES
            )

    rows = saved(open_docs.mapInArrow(parts, ROW), "repeats-parts")
    by_key = rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n"))
    keys = saved(by_key.where("least < most" if of_smaller else "n > 1").select("key"), "repeats-part-keys")
    alive = saved(rows.join(keys, "key"), "repeats-part-alive")
    again = settle(alive, of_smaller).withColumnsRenamed({"covered": "covered2", "unclear": "unclear2"})
    told = open_docs.join(again, same_row(open_docs, again), "left").select(open_docs["doc_id"], open_docs["mark"], "text", "covered", "unclear2", "covered2")
    open_docs = saved(told, "repeats-open")
    forget(rows, keys, alive)

    def windows(batches):
        for batch in slices(batches):
            values, first, _, _ = units(*buffers(batch.column(2)))
            row, lo, hi, key = _ranges(batch.column(4), ("lo", "hi", "key"))
            size = (hi - lo + 1).astype(np.int64)
            s = np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            row, key = np.repeat(row, size), np.repeat(key, size)
            prints = Fingerprints(values, 1).of(first[row] + s, first[row] + s + width)
            pick = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(prints.view(np.int64)), pa.array(key), batch.column(0).take(pick), batch.column(1).take(pick), pa.array(s.astype(np.int32))], ["print", "key", "doc_id", "mark", "s"]
            )

    w = saved(open_docs.mapInArrow(windows, "print long, key long, doc_id long, mark long, s int"), "repeats-windows")
    shared = saved(w.groupBy("print", "key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n")).where("least < most" if of_smaller else "n > 1"), "repeats-shared")
    hits = w.join(shared, ["print", "key"])
    if of_smaller:
        hits = hits.where("doc_id > least")
    more = hits.groupBy("doc_id", "mark").agg(F.collect_set(F.struct(F.col("s").alias("lo"), F.col("s").alias("hi"))).alias("more"))
    last = open_docs.join(more, same_row(open_docs, more), "left").select(open_docs["doc_id"], open_docs["text"], "covered", "covered2", "more")

    def second_pass(batches):
        for batch in slices(batches):
            d = digest_batch(batch, units, width, [batch.column(2), batch.column(3), batch.column(4)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d["n"]), pa.array(d["n_removed"]), pa.array(d["n_spans"]), pa.array(d["kept_sha256"])], ["doc_id", "n", "n_removed", "n_spans", "kept_sha256"])

    columns = ["doc_id", "n", "n_removed", "n_spans", "kept_sha256"]
    return done.where("text is null").select(*columns).unionByName(last.mapInArrow(second_pass, f"doc_id long, {digest}"))
