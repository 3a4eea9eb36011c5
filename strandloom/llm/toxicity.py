"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

The features of a whole text are densities of a lexicon (words and word beginnings learned from labelled rows, next to a short
fixed list), how often they stand near the second person, and rates of capitals, punctuation and obfuscation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.arrays import BLANK, BYTE, PLAIN, Fingerprints, Members, U, buffers, plain_words, slices
from strandloom.llm.arrays import words as words_of
from strandloom.llm.boosting import Isotonic, Trees
from strandloom.llm.common import DOCUMENT_COLUMNS, saved, table
from strandloom.llm.langid import held_out

#: Labelled rows of each label that the lexicon and the trees learn from; learned entries; bytes of a word's beginnings.
SAMPLE, LEXICON, BEGINNINGS = 12_000, 3000, (5, 6, 7, 8)
#: Least labelled texts that hold an entry, and least log odds of the label for it.
LEAST_TEXTS, LEAST_ODDS = 4, 2.5
#: Words around a lexicon word in which a second person counts.
NEAR = 6
# fixed values: insults and second persons of the languages at hand
INSULTS = "idiot moron stupid dumb loser scum trash worthless pathetic disgusting clown garbage fool imbecile".split()
SECOND = "you your yours yourself u ur tu te toi ton ta tes vous votre du dich dir dein deine ihr euch usted tú ti tus vosotros".split()
# fixed values: signs that stand for letters
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
NAMES = ["learned", "odds", "insults", "hits", "burst", "near_second", "second", "capitals", "all_caps", "exclaim", "question", "other_punct", "digits", "obfuscated", "masked", "repeats", "log_words", "word_bytes"]

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LEET = _FOLD.copy()
for _a, _b in LEET.items():
    _LEET[ord(_a)] = ord(_b)
_LETTER = PLAIN.copy()
_LETTER[48:58] = False
_UNLEET = _LETTER.copy()
_UNLEET[[ord(a) for a in LEET]] = True


def _hashes(words: list[str]) -> np.ndarray:
    if not words:
        return np.zeros(0, U)
    joined = [w.encode() for w in words]
    data = np.frombuffer(b"".join(joined), np.uint8)
    end = np.cumsum([len(w) for w in joined])
    return Fingerprints(BYTE[data], 0).of(end - np.array([len(w) for w in joined]), end)


def _letters_only(data: np.ndarray, offs: np.ndarray):
    """Words in lower case and without signs; signs that stand for letters are read as those, inside words that have letters."""
    return plain_words(np.where(_UNLEET[data] | BLANK[data], _LEET[data], np.uint8(ord("-"))), offs, _LETTER)


def _entries(data: np.ndarray, offs: np.ndarray):
    """(fingerprint, text, word) of each word and of its beginnings; fingerprints of beginnings differ from those of words."""
    sub, start, end, text = plain_words(_FOLD[data], offs, _LETTER)
    prints = Fingerprints(BYTE[sub], 0)
    out = [(prints.of(start, end), text, np.arange(len(start)))]
    for n in BEGINNINGS:
        long = np.flatnonzero(end - start > n)
        out.append((prints.of(start[long], start[long] + n) ^ U(0x5851F42D4C957F2D), text[long], long))
    return out, sub, start, end, text


def entries_of_texts(batches):
    """(toxic, entry, n): in how many texts of a batch of (toxic, text) an entry occurs."""
    for batch in slices(batches):
        toxic = batch.column(0).to_numpy(zero_copy_only=False)
        found, *_ = _entries(*buffers(batch.column(1)))
        entry, text = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
        order = np.lexsort((text, entry))
        entry, text = entry[order], text[order]
        new = np.ones(len(entry), bool)
        new[1:] = (entry[1:] != entry[:-1]) | (text[1:] != text[:-1])
        entry, label = entry[new], toxic[text[new]]
        for y in (0, 1):
            e, n = np.unique(entry[label == y], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(e), y, np.int32)), pa.array(e.view(np.int64)), pa.array(n.astype(np.int64))], ["toxic", "entry", "n"])


class Features:
    """The dense features of batches of texts, given the learned entries and their log odds."""

    def __init__(self, entries: np.ndarray, odds: np.ndarray):
        order = np.argsort(entries.astype(U))
        self.entries, self.odds = Members(entries.astype(U)[order]), odds[order]
        self.insults, self.second = Members(_hashes(INSULTS)), Members(_hashes(SECOND))

    def of(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        found, sub, start, end, text = _entries(data, offs)
        count = np.bincount(text, minlength=n).astype(float)
        hit, weight = np.zeros(len(start), bool), np.zeros(len(start))
        for prints, _, word in found:
            at, which = self.entries.find(prints)
            hit[word[at]] = True
            np.maximum.at(weight, word[at], self.odds[which])
        whole = found[0][0]
        insult = np.zeros(len(start), bool)
        insult[self.insults.find(whole)[0]] = True
        # words whose letters were masked: the same entries once signs are read as letters
        lsub, lstart, lend, ltext = _letters_only(data, offs)
        leet = Fingerprints(BYTE[lsub], 0).of(lstart, lend)
        lhits = np.zeros(n)
        for m in (self.insults, self.entries):
            at, _ = m.find(leet)
            np.add.at(lhits, ltext[at], 1)
        phits = np.bincount(text[self.insults.find(whole)[0]], minlength=n) + np.bincount(text[self.entries.find(whole)[0]], minlength=n)
        second = np.zeros(len(start), bool)
        second[self.second.find(whole)[0]] = True
        bad = hit | insult
        near = self._near(bad, second, text, n)
        # the most lexicon words in a stretch of 20 words
        run = np.zeros(len(start) + 1)
        np.cumsum(bad, out=run[1:])
        first = np.searchsorted(text, text, "left")
        back = run[1:] - run[np.maximum(first, np.arange(len(start)) - 19)] if len(start) else np.zeros(0)
        burst = np.zeros(n)
        np.maximum.at(burst, text, back)

        def per_text(mask: np.ndarray) -> np.ndarray:
            total = np.zeros(len(mask) + 1)
            np.cumsum(mask, out=total[1:])
            return total[offs[1:]] - total[offs[:-1]]

        size = np.maximum(offs[1:] - offs[:-1], 1).astype(float)
        upper, letter = (data >= 65) & (data <= 90), _LETTER[data]
        caps = per_text(upper)
        wstart, wend, wtext = words_of(data, offs)
        total = np.zeros(len(data) + 1)
        np.cumsum(upper, out=total[1:])
        lets = np.zeros(len(data) + 1)
        np.cumsum(letter, out=lets[1:])
        ups, ls, length = total[wend] - total[wstart], lets[wend] - lets[wstart], wend - wstart
        nw = np.maximum(np.bincount(wtext, minlength=n), 1).astype(float)
        shout = np.bincount(wtext[(ups >= 2) & (ups == ls)], minlength=n) / nw
        mixed = np.bincount(wtext[(ls > 0) & (length - ls >= 2)], minlength=n) / nw
        same = np.zeros(len(whole), bool)
        same[1:] = (whole[1:] == whole[:-1]) & (text[1:] == text[:-1])
        words = np.maximum(count, 1)
        by_text = lambda m: np.bincount(text[m], minlength=n)
        return np.stack(
            [
                by_text(hit) / words, np.bincount(text, weights=weight, minlength=n) / words, by_text(insult) / words, np.log1p(by_text(bad)), burst, near / words, by_text(second) / words,
                caps / np.maximum(per_text(letter), 1), shout, per_text(data == 33) / size, per_text(data == 63) / size, per_text((data > 32) & (data < 127) & ~PLAIN[data] & (data != 33) & (data != 63)) / size,
                per_text((data >= 48) & (data <= 57)) / size, mixed, np.maximum(lhits - phits, 0) / words, by_text(same) / words, np.log1p(count), np.bincount(text, weights=end - start, minlength=n) / words,
            ], 1,
        )

    @staticmethod
    def _near(bad: np.ndarray, second: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        """Lexicon words with a second person among the NEAR words before or after, by text."""
        at, you = np.flatnonzero(bad), np.flatnonzero(second)
        out = np.zeros(n)
        if len(at) and len(you):
            for side in (np.searchsorted(you, at) - 1, np.searchsorted(you, at)):
                ok = (side >= 0) & (side < len(you))
                other = you[np.clip(side, 0, len(you) - 1)]
                ok &= (np.abs(other - at) <= NEAR) & (text[other] == text[at])
                np.add.at(out, text[at[ok]], 1)
        return out


def _featured(entries: np.ndarray, odds: np.ndarray, extra: list[str]):
    def run(batches):
        made = Features(entries, odds)
        for batch in slices(batches):
            x = made.of(*buffers(batch.column(batch.schema.get_field_index("text"))))
            kept = [batch.column(batch.schema.get_field_index(c)) for c in extra]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(list(x), pa.list_(pa.float64()))], [*extra, "x"])

    return run


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple:
    """(entries, odds, trees, calibration) from labelled rows outside the held-out fold.

    Fitted on at most `sample` rows of each label, the first by a hash of doc_id; a fifth of them calibrate. Each row weighs
    as many labelled rows as it stands for, so the share of toxic rows is that of the labels, whatever is sampled. Rows that repeat
    a doc_id in labels count as their largest label; null labels and ids are left out.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    mark = F.xxhash64("doc_id")
    chosen = known.where("toxic = 0").orderBy(mark, "doc_id").limit(sample).unionByName(known.where("toxic = 1").orderBy(mark, "doc_id").limit(sample))
    known_rows = {r[0]: r[1] for r in known.where("toxic in (0, 1)").groupBy("toxic").count().collect()}
    # at most 2 * sample rows of two numbers
    rows = saved(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)).alias("fold")), "toxic-sample")
    size = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    counted = rows.where("fold <> 0").select("toxic", "text").mapInArrow(entries_of_texts, "toxic int, entry long, n long")
    by_entry = counted.groupBy("entry").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"))
    odds = F.log((F.col("bad") + 0.2) / F.lit(n1 + 1.0)) - F.log((F.col("good") + 0.2) / F.lit(n0 + 1.0))
    top = by_entry.withColumn("odds", odds).where((F.col("bad") >= LEAST_TEXTS) & (F.col("odds") >= LEAST_ODDS)).orderBy(F.desc(F.col("odds") * F.log("bad")), "entry").limit(LEXICON).select("entry", "odds").toPandas()
    entries, weights = top["entry"].to_numpy(np.int64).view(U), top["odds"].to_numpy(float)
    seen = rows.mapInArrow(_featured(entries, weights, ["toxic", "fold"]), "toxic int, fold long, x array<double>").toPandas()
    if n0 == 0 or n1 == 0:
        return entries, weights, None, None
    x, y, fold = np.array(seen["x"].tolist()), seen["toxic"].to_numpy(float), seen["fold"].to_numpy()
    stands_for = [max(1.0, known_rows[k] / sample) for k in (0, 1)]
    weight = np.where(y > 0, stands_for[1], stands_for[0])
    weight = weight / weight.mean()  # on the scale of rows, which the trees' least weights are made for
    trees = Trees().fit(x[fold != 0], y[fold != 0], weight[fold != 0])
    held = fold == 0 if (fold == 0).sum() >= 50 else np.ones(len(y), bool)
    return entries, weights, trees, Isotonic(trees.raw(x[held]), y[held], weight[held])


def score(docs: DataFrame, model: tuple, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text).

    Each whole text is scored by itself, so repeated rows and ties get equal scores. A null or empty text has no words and all
    rates 0 and is scored as such; without a model (labels of one kind only, or none) every score is 0. An empty table gives no
    rows; other columns are left out.
    """
    entries, odds, trees, calibrate = model

    def run(batches):
        made = Features(entries, odds)
        for batch in slices(batches):
            x = made.of(*buffers(batch.column(1)))
            p = calibrate(trees.raw(x)) if trees is not None else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*DOCUMENT_COLUMNS)
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
