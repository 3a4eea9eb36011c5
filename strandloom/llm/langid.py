"""Language ID with interpolated Kneser-Ney character models, one per language, in sorted hash arrays.

Texts are lower-cased; every letter becomes a 12-bit code (code points below 4096 as they are, others hashed), anything else a
gap, and five codes make a 60-bit key. Counts of all rows to learn from are summed by Spark, which computes discounts, lower
orders and probabilities from all of them. The model stores, sorted by key, the interpolated log probability of every key in
each language; so it grows with the number of distinct keys. A text gets the language of the lowest cross-entropy per character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.arrays import slices
from strandloom.llm.common import DOCUMENT_COLUMNS, saved, table

ORDER, BITS = 5, 12
#: Share of the calibrating rows that the rejection may reject.
REJECTED = 0.0005

_letters: list[np.ndarray] = []


def codes_of_points() -> np.ndarray:
    """For each code point its code, 0 unless it is a letter; made once in a worker."""
    if not _letters:
        made = np.zeros(0x110000, np.uint16)
        points = np.array([i for i in range(0x110000) if chr(i).isalpha()], np.uint32)
        made[points] = np.where(points < 1 << BITS, points, (points * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.uint16)
        made[points[made[points] == 0]] = 1
        _letters.append(made)
    return _letters[0]


def keys_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the n-grams that end at each scored character, text of each). Texts don't touch; runs of non-letters are one gap."""
    lowered = [(t or "").lower() for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = codes_of_points()[points]
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.empty(len(codes), bool)
    first[0] = True
    first[1:] = owner[1:] != owner[:-1]
    keep = codes > 0
    keep[1:] |= (codes[:-1] > 0) & ~first[1:]  # a gap after a letter of the same text
    codes, owner = codes[keep].astype(np.int64), owner[keep]
    at = np.arange(len(codes)) + (ORDER - 1) * (owner + 1)  # as many gaps before each text as a context is long
    padded = np.zeros(len(codes) + (ORDER - 1) * (len(texts) + 1), np.int64)
    padded[at] = codes
    keys = np.zeros(len(codes), np.int64)
    for back in range(ORDER - 1, -1, -1):
        keys = (keys << BITS) | padded[at - back]
    return keys, owner


def count_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, key, n) of each batch of (lang, text)."""
    for batch in slices(batches):
        names = batch.column(0).to_pylist()
        keys, owner = keys_of(batch.column(1).to_pylist())
        langs = sorted(set(names))
        which = np.array([langs.index(x) for x in names])[owner] if len(owner) else owner
        for i, lang in enumerate(langs):
            found, n = np.unique(keys[which == i], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(n.astype(np.int64))], ["lang", "key", "n"])


class Model:
    """Per order: sorted keys with log probabilities by language, and sorted contexts with log back-off weights."""

    def __init__(self, langs: list[str], lang: np.ndarray, key: np.ndarray, n: np.ndarray):
        self.langs, self.tables, self.weights = langs, [], []
        size = len(langs)
        counts = []  # by language and order: keys and counts (the longest order) or numbers of left neighbours
        for i in range(size):
            order = np.argsort(key[lang == i])
            k, c = key[lang == i][order], n[lang == i][order].astype(float)
            by_order = [(k, c)]
            for m in range(ORDER - 1, 0, -1):
                k, c = np.unique(by_order[0][0] & ((1 << (BITS * m)) - 1), return_counts=True)
                by_order.insert(0, (k, c.astype(float)))
            counts.append(by_order)
        letters = max(2, len(np.unique(np.concatenate([c[0][0] for c in counts] or [np.zeros(0, np.int64)]))))
        self.floor = -np.log(letters + 1.0)
        for m in range(ORDER):
            keys = np.unique(np.concatenate([c[m][0] for c in counts] or [np.zeros(0, np.int64)]))
            heads = np.unique(keys >> BITS)
            lower = np.exp(self._log(keys & ((1 << (BITS * m)) - 1), m) if m else np.full((len(keys), size), self.floor))
            logp, weight = np.zeros((len(keys), size)), np.zeros((len(heads), size))
            for i in range(size):
                k, c = counts[i][m]
                ones, twos = (c == 1).sum(), (c == 2).sum()
                off = ones / (ones + 2 * twos) if ones and twos else 0.5
                total, kinds = np.zeros(len(heads)), np.zeros(len(heads))
                at = np.searchsorted(heads, k >> BITS)
                np.add.at(total, at, c)
                np.add.at(kinds, at, 1)
                gamma = np.where(total > 0, off * kinds / np.maximum(total, 1), 1.0)
                part, of = np.zeros(len(keys)), np.searchsorted(heads, keys >> BITS)
                part[np.searchsorted(keys, k)] = np.maximum(c - off, 0) / total[at]
                logp[:, i] = np.log(np.maximum(part + gamma[of] * lower[:, i], 1e-300))
                weight[:, i] = np.log(gamma)
            self.tables.append((keys, logp.astype(np.float32)))
            self.weights.append((heads, weight.astype(np.float32)))

    def _log(self, keys: np.ndarray, orders: int) -> np.ndarray:
        """Log probability of the last code of each key after the others, by language; keys of `orders` codes."""
        out = np.zeros((len(keys), len(self.langs)), np.float32)
        left = np.arange(len(keys))
        for m in range(orders - 1, -1, -1):
            if not len(left):
                return out
            k = keys[left] & ((1 << (BITS * (m + 1))) - 1)
            known, values = self.tables[m]
            at = np.minimum(np.searchsorted(known, k), max(len(known) - 1, 0))
            hit = known[at] == k if len(known) else np.zeros(len(k), bool)
            out[left[hit]] += values[at[hit]]
            left, k = left[~hit], k[~hit]
            heads, weight = self.weights[m]
            if len(heads) and len(k):
                at = np.minimum(np.searchsorted(heads, k >> BITS), len(heads) - 1)
                seen = heads[at] == k >> BITS
                out[left[seen]] += weight[at[seen]]
        out[left] += np.float32(self.floor)
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cross-entropy per character [text, language], characters scored, has a letter)."""
        keys, owner = keys_of(texts)
        n = np.bincount(owner, minlength=len(texts))
        found, back = np.unique(keys, return_inverse=True)
        logp = self._log(found, ORDER)
        total = np.stack([np.bincount(owner, weights=logp[back, i], minlength=len(texts)) for i in range(len(self.langs))], 1) if len(self.langs) else np.zeros((len(texts), 0))
        return -total / np.maximum(n, 1)[:, None], n, n > 0


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 1 modulo 3; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _fetched(rows: DataFrame, key: str, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, values by key and language); of numbers alone, as Arrow."""
    told = rows.select(key, *(F.col(v).cast("float") for v in values)).toArrow()
    keys = told.column(0).to_numpy()
    order = np.argsort(keys)
    return keys[order], np.stack([told.column(i + 1).to_numpy()[order] for i in range(len(values))], 1)


def fit(rows: DataFrame) -> Model:
    """The model of labelled rows (lang, text), as Model makes it of all their counts: Spark computes it, order by order."""
    labelled = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = saved(
        labelled.mapInArrow(count_keys, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")), "langid-counts"
    )
    model = Model([], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    if not langs:
        return model
    each = range(len(langs))
    # by order, a row for each key with its count in each language: of the longest order, then numbers of left neighbours
    orders = [saved(counts.groupBy("key").agg(*(F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"c{i}") for i, x in enumerate(langs))), "langid-order")]
    for m in range(ORDER - 1, 0, -1):
        suffix = F.col("key").bitwiseAND(F.lit((1 << (BITS * m)) - 1)).alias("key")
        orders.insert(0, saved(orders[0].groupBy(suffix).agg(*(F.sum((F.col(f"c{i}") > 0).cast("long")).alias(f"c{i}") for i in each)), "langid-order"))
    model.langs, model.tables, model.weights = langs, [], []
    model.floor = -np.log(max(2, orders[0].count()) + 1.0)
    lower = None
    for m, keys in enumerate(orders):
        head = F.shiftright("key", BITS)
        ones_twos = keys.agg(*(F.sum((F.col(f"c{i}") == k).cast("long")) for i in each for k in (1, 2))).first()
        off = [a / (a + 2 * b) if a and b else 0.5 for a, b in zip(ones_twos[::2], ones_twos[1::2], strict=True)]
        sums = keys.groupBy(head.alias("head")).agg(*(F.sum(f"c{i}").alias(f"t{i}") for i in each), *(F.sum((F.col(f"c{i}") > 0).cast("long")).alias(f"k{i}") for i in each))
        gamma = [F.when(F.col(f"t{i}") > 0, F.lit(off[i]) * F.col(f"k{i}") / F.col(f"t{i}")).otherwise(F.lit(1.0)).alias(f"g{i}") for i in each]
        heads = saved(sums.select("head", *(f"t{i}" for i in each), *gamma), "langid-heads")
        joined = keys.join(heads, head == F.col("head"))
        if lower is not None:  # every suffix is a key of the order below
            below = lower.select(F.col("key").alias("suffix"), *(F.exp(f"p{i}").alias(f"l{i}") for i in each))
            joined = joined.join(below, F.col("key").bitwiseAND(F.lit((1 << (BITS * m)) - 1)) == F.col("suffix"))
        own = [F.when(F.col(f"c{i}") > 0, F.greatest(F.col(f"c{i}") - F.lit(off[i]), F.lit(0.0)) / F.col(f"t{i}")).otherwise(F.lit(0.0)) for i in each]
        backed = [F.col(f"g{i}") * (F.col(f"l{i}") if m else F.lit(float(np.exp(model.floor)))) for i in each]
        lower = saved(joined.select("key", *(F.log(F.greatest(own[i] + backed[i], F.lit(1e-300))).alias(f"p{i}") for i in each)), "langid-logs")
        model.tables.append(_fetched(lower, "key", [f"p{i}" for i in each]))
        model.weights.append(_fetched(heads.select("head", *(F.log(f"g{i}").alias(f"w{i}") for i in each)), "head", [f"w{i}" for i in each]))
    return model


def _scores(model_box, extra: list[str]):
    """Arrow batches of (text, *extra) to (*extra, lang_pred, score, entropy, n)."""

    def run(batches):
        model = model_box.value
        langs = np.array([*model.langs, "und"], object)
        for batch in slices(batches):
            h, n, ok = model.entropies(batch.column(batch.schema.get_field_index("text")).to_pylist())
            if h.shape[1]:
                best = h.argmin(1)
                low = h[np.arange(len(h)), best]
                odds = np.exp(-(h - low[:, None]) * np.minimum(n, 200)[:, None]).sum(1)
                score = np.where(ok, 1 / odds, 0.0)
            else:
                best, low, score, ok = np.zeros(len(n), int), np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n), bool)
            best = np.where(ok, best, len(langs) - 1)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in extra]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(langs[best], pa.string()), pa.array(score), pa.array(low.astype(float)), pa.array(n.astype(np.int64))],
                [*extra, "lang_pred", "score", "entropy", "n_scored"],
            )

    return run


def limits(model_box, rows: DataFrame, share: float = REJECTED) -> DataFrame:
    """(lang_pred, mean, spread, cut): how far above its language's mean the cross-entropy of a text may lie.

    Calibrated on all labelled rows that are given: a text is rejected if (entropy - mean) / (spread * (1 + 10 / sqrt(n))) is above
    a cut that a share of them, at most, exceeds; never below 6. Quantiles are exact, by language.
    """
    labelled = rows.where("lang is not null and text is not null").select("text", "lang")
    scored = labelled.mapInArrow(_scores(model_box, ["lang"]), "lang string, lang_pred string, score double, entropy double, n_scored long")
    right = saved(scored.where("n_scored > 0 and lang = lang_pred").select("lang_pred", "entropy", "n_scored"), "langid-calibration")
    middle = right.groupBy("lang_pred").agg(F.percentile("entropy", 0.5).alias("mean"))  # a row for each language
    far = right.join(F.broadcast(middle), "lang_pred")
    width = far.groupBy("lang_pred", "mean").agg((F.percentile(F.abs(F.col("entropy") - F.col("mean")), 0.9) + 1e-3).alias("spread"))
    z = (F.col("entropy") - F.col("mean")) / (F.col("spread") * (1 + 10 / F.sqrt("n_scored")))
    held = right.join(F.broadcast(width), "lang_pred").groupBy("lang_pred", "mean", "spread")
    return held.agg(F.greatest(F.lit(6.0), F.percentile(z, 1 - share) * 1.5).alias("cut"))


def identify(docs: DataFrame, carry: list[str], spark: SparkSession | None = None) -> DataFrame:
    """Columns `carry` of docs (doc_id, text, lang), with held_out, lang_pred, score, entropy, n_scored, rejected.

    The model learns from rows with a lang outside the held-out fold, but for a tenth that calibrates the rejection. lang_pred is a learned lang, or `und` where the text is
    null or has no letter (score 0), and everywhere if nothing could be learned. score is the share of the best language among
    the likelihoods, by at most 200 characters. rejected: `und`, or a cross-entropy above the calibrated limit. Texts are
    scored whole, each row alone, so repeated rows and ties agree (equal entropies: the smaller lang); an empty table gives no rows.
    """
    spark = docs.sparkSession
    learn = docs.where(~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    unseen = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(10)) == 0  # a tenth is not counted, and calibrates
    box = spark.sparkContext.broadcast(fit(learn.where(~unseen)))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in carry), "lang_pred string, score double, entropy double, n_scored long"])
    inputs = [c for c in docs.columns if c in carry]
    scored = docs.select(*inputs, *([] if "text" in inputs else ["text"])).mapInArrow(_scores(box, inputs), schema)
    limit = limits(box, learn.where(unseen))
    joined = scored.join(F.broadcast(limit), "lang_pred", "left")  # a row for each language
    far = (F.col("entropy") - F.col("mean")) / (F.col("spread") * (1 + 10 / F.sqrt("n_scored"))) > F.col("cut")
    rejected = (F.col("lang_pred") == "und") | F.coalesce(far, F.lit(False))
    return joined.select(*inputs, held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "entropy", "n_scored", rejected.alias("rejected"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without the rows that identify() rejects; the columns of docs."""
    own = {c: c if c in ("doc_id", "text", "lang") else f"carried_{i}" for i, c in enumerate(docs.columns)}  # so that no name clashes
    plain = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items()))
    return identify(plain, plain.columns).where("not rejected").select(*(F.col(n).alias(c) for c, n in own.items()))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*DOCUMENT_COLUMNS)
    return identify(docs, ["doc_id"]).select("doc_id", "held_out", "lang_pred", "score", "entropy", "n_scored", "rejected")
