"""Cross-tokenizer alignment: which tokens of one tokenizer cover the same bytes as which of another, and how common their links are.

Both tokenizers cut a text into tokens with places: `tokenizers` gives character offsets, sentencepiece gives byte spans of its
pieces (return_type "proto"; older releases called it immutable_proto). These are coarse cuts: several tokens may share a
character, and byte-fallback pieces have no span of their own. Such tokens are refined with the bytes they decode to. Byte offsets
at which both end cut the tokens into groups; tokens whose byte ranges overlap are linked. A pair's count is the number of
documents that hold it linked.

Neither tokenizer joins anything across the place where a blank follows a character that isn't white space (no vocabulary entry
does, which is tested when a model is loaded). So texts are cut there, and a piece that comes again is aligned once a worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import saved, table

FOLDER = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pieces that a worker remembers, characters up to which it does, characters of texts that are aligned at a time, pieces of a text at a time, pairs that may be broadcast.
HELD, SHORT, CHARS, RUN, HOT = 400_000, 64, 1 << 20, 100_000, 200_000

ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<struct<pair: bigint, links: int>>"
#: From a blank on to the next blank that follows anything but white space.
PIECE = re.compile(r" [^ ]*(?:(?<!\S) [^ ]*)*")


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters for themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


def refined_ends(begin: np.ndarray, end: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Byte ends of tokens from coarse spans (bytes) and the number of bytes that each decodes to.

    Tokens that share a character, and pieces of an empty span with the one after them, form a run: its end is the coarse cut, and
    inside it the decoded bytes tell the ends. Should a run disagree with its cut, the decoded bytes, which spell the text, decide.
    """
    upto = _offsets(lengths)
    if not len(end):
        return upto[1:]
    reach = np.maximum.accumulate(end)
    opens = np.ones(len(end), bool)
    opens[1:] = (begin[1:] >= reach[:-1]) & (end[:-1] > begin[:-1])
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(end)) - 1
    start = np.concatenate([[0], reach[last[:-1]]])
    run = np.cumsum(opens) - 1
    ends = start[run] + upto[1:] - upto[first][run]
    return ends if (ends[last] == reach[last]).all() else upto[1:]


class Aligner:
    """Two tokenizers and the pieces they have aligned so far."""

    def __init__(self, byte_bpe: str, piece_bpe: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_bpe)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        bytes_of = _byte_of_char()
        names = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.a_bytes[i] = bytes(bytes_of[c] for c in name) if all(c in bytes_of for c in name) else name.encode()
        size = self.b.get_piece_size()
        named = [self.b.id_to_piece(i) for i in range(size)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(named)]
        self.a_length, self.b_length = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        white = [x.decode(errors="replace") for x in [*self.a_bytes, *self.b_bytes]]
        self.whole = any(re.search(r"\S ", x) for x in white)  # a vocabulary that joins words: texts aren't cut
        self._forget()

    def _forget(self, keep: np.ndarray | None = None) -> None:
        """Forget all pieces but those at the places `keep`. Held are places by piece, and by place counts (n_a of -1: the bytes
        differ), groups as text, links from `at` on, and how often a piece has come."""
        keep = np.zeros(0, np.int64) if keep is None else keep
        if not len(keep):
            self.known: dict[str, int] = {}
            self.n, self.groups, self.at, self.links, self.uses = np.zeros((0, 4), np.int64), [], np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        to = np.full(len(self.groups), -1)
        to[keep] = np.arange(len(keep))
        links, at = self._links_of(keep)
        self.known = {p: k for p, k in zip(self.known, to[np.fromiter(self.known.values(), np.int64, len(self.known))].tolist(), strict=True) if k >= 0}
        self.n, self.groups, self.links, self.at, self.uses = self.n[keep], [self.groups[k] for k in keep.tolist()], links, at, self.uses[keep] // 2

    def _links_of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of some places one after another, and where each begins."""
        sizes = self.at[places + 1] - self.at[places]
        at = _offsets(sizes)
        return self.links[np.repeat(self.at[places] - at[:-1], sizes) + np.arange(at[-1])], at

    def _tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids and byte ends of both tokenizers for a text that begins with a blank; null where the bytes differ."""
        raw = text.encode()
        e = self.a.encode(text, add_special_tokens=False)
        a = np.array(e.ids, np.int64)
        spans = np.fromiter(chain.from_iterable(e.offsets), np.int64, 2 * len(a)).reshape(-1, 2)
        if len(raw) != len(text):  # characters to bytes
            spans = np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw))[spans]
        pieces = self.b.encode(text[1:], return_type="proto").pieces
        got = np.array([x for p in pieces for x in (p.id, p.begin, p.end)], np.int64).reshape(-1, 3)
        b, begin, end = got[:, 0], got[:, 1] + 1, got[:, 2] + 1
        if len(b):
            begin[0] = 0  # the blank that sentencepiece puts before the text
        if b"".join([self.a_bytes[i] for i in a.tolist()]) != raw or b"".join([self.b_bytes[i] for i in b.tolist()]) != raw:
            return None
        return a, refined_ends(spans[:, 0], spans[:, 1], self.a_length[a]), b, refined_ends(begin, end, self.b_length[b])

    def _align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Counts and groups of each text, and the links of all in turn; several at once where what they give together can be cut again."""
        tokens = self._tokens("".join(texts))
        cuts = np.cumsum([len(t.encode()) for t in texts])
        if tokens is None or not (np.isin(cuts, tokens[1]).all() and np.isin(cuts, tokens[3]).all()):
            if len(texts) == 1:
                return np.array([[-1, 0, 0, 0]]), [""], np.zeros(0, np.int64)
            parts = [self._align([t]) for t in texts]
            return np.concatenate([p[0] for p in parts]), [p[1][0] for p in parts], np.concatenate([p[2] for p in parts])
        a, a_end, b, b_end = tokens
        both = np.intersect1d(a_end, b_end)
        a_group, b_group = np.searchsorted(both, a_end), np.searchsorted(both, b_end)
        # links: the B tokens that begin before an A token's end and end after its begin
        a_from = np.concatenate([[0], a_end[:-1]])
        lo, hi = np.searchsorted(b_end, a_from, "right"), np.searchsorted(np.concatenate([[0], b_end[:-1]]), a_end, "left")
        n = hi - lo
        link_a = np.repeat(np.arange(len(a)), n)
        link_b = np.arange(n.sum()) - np.repeat(_offsets(n)[:-1], n) + np.repeat(lo, n)
        pair = (a[link_a] << 32) | b[link_b]
        a_cut, b_cut, g_cut = np.searchsorted(a_end, cuts, "right"), np.searchsorted(b_end, cuts, "right"), np.searchsorted(both, cuts, "right")
        l_cut = _offsets(n)[a_cut]
        counts = np.stack([np.diff(x, prepend=0) for x in (a_cut, b_cut, g_cut, l_cut)], 1)
        a_at, b_at = np.searchsorted(a_group, np.arange(len(both) + 1)), np.searchsorted(b_group, np.arange(len(both) + 1))
        a_text, b_text = [*map(str, a.tolist())], [*map(str, b.tolist())]
        al, bl = a_at.tolist(), b_at.tolist()
        one = lambda t, i, j: t[i] if j - i == 1 else ",".join(t[i:j])
        named = [one(a_text, i, j) + "|" + one(b_text, k, m) for i, j, k, m in zip(al[:-1], al[1:], bl[:-1], bl[1:], strict=True)]
        groups = [";".join(named[i:j]) for i, j in zip([0, *g_cut[:-1].tolist()], g_cut.tolist(), strict=True)]
        return counts, groups, pair

    def _learn(self, missing: list[str]) -> None:
        plain = [t for t in missing if not t[-1].isspace()]
        new = [(texts, *self._align(texts)) for texts in [plain[i : i + 4096] for i in range(0, len(plain), 4096)] + [[t] for t in missing if t[-1].isspace()]]
        for texts, _, groups, _ in new:
            self.known.update(zip(texts, range(len(self.groups), len(self.groups) + len(texts)), strict=True))
            self.groups += groups
        counts = np.concatenate([x[1] for x in new])
        self.n, self.uses = np.concatenate([self.n, counts]), np.concatenate([self.uses, np.zeros(len(counts), np.int64)])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(counts[:, 3])])
        self.links = np.concatenate([self.links, *(x[3] for x in new)])

    def _run(self, pieces: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray] | None:
        """Counts, groups, and pairs with their links of some pieces of a text; null if the bytes of one differ."""
        ids = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        far = {i: self._align([pieces[i]]) for i in np.flatnonzero(ids < 0).tolist()}
        used, times = np.unique(ids[ids >= 0], return_counts=True)
        self.uses[used] += times
        rows = self.n[used]
        if (rows[:, 0] < 0).any() or any(x[0][0, 0] < 0 for x in far.values()):
            return None
        counts = (rows * times[:, None]).sum(0) + sum(x[0][0] for x in far.values())
        groups = [self.groups[k] if k >= 0 else far[i][1][0] for i, k in enumerate(ids.tolist())] if far else [*map(self.groups.__getitem__, ids.tolist())]
        links, at = self._links_of(used)
        more = [x[2] for x in far.values()]
        weight = np.concatenate([np.repeat(times, np.diff(at)), *(np.ones(len(x), np.int64) for x in more)])
        return counts, groups, *_summed(np.concatenate([links, *more]), weight)

    def texts(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, str, np.ndarray, np.ndarray]]:
        """Counts, groups, and distinct pairs with their links of each text."""
        cut = [[] if not t else [" " + t] if self.whole else _pieces(t) for t in texts]
        distinct = {p for p in set().union(*cut) if len(p) <= SHORT}
        missing = [p for p in distinct if p not in self.known]
        if missing and len(self.groups) + len(missing) > HELD:
            self._forget(np.flatnonzero(self.uses > 1))
            missing = [p for p in distinct if p not in self.known]
            if len(self.groups) + len(missing) > HELD:
                self._forget()
                missing = [*distinct]
        if missing:
            self._learn(missing)
        for pieces in cut:
            runs = [self._run(pieces[i : i + RUN]) for i in range(0, len(pieces), RUN)]
            if not runs or any(r is None for r in runs):
                yield np.zeros(4, np.int64), "", np.zeros(0, np.int64), np.zeros(0, np.int64)
                continue
            counts, groups, pairs, links = runs[0]
            if len(runs) > 1:
                counts, groups = sum(r[0] for r in runs), [g for r in runs for g in r[1]]
                pairs, links = _summed(np.concatenate([r[2] for r in runs]), np.concatenate([r[3] for r in runs]))
            yield counts, ";".join(groups), pairs, links


def _pieces(text: str) -> list[str]:
    """Pieces of a text with a blank before it. A blank alone, which sentencepiece gives nothing for, stays with the piece before it."""
    pieces = PIECE.findall(" " + text)
    if pieces[-1] == " ":
        pieces[-2:] = [pieces[-2] + " "]
    return pieces


def _summed(pairs: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, where = np.unique(pairs, return_inverse=True)
    return distinct, np.bincount(where, weight, len(distinct)).astype(np.int64)


@lru_cache(maxsize=2)
def aligner(byte_bpe: str, piece_bpe: str) -> Aligner:
    """One for each worker and pair of files."""
    return Aligner(byte_bpe, piece_bpe)


def _slices(lengths: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of rows of at most about CHARS characters each."""
    block = np.cumsum(lengths) // CHARS
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(lengths)]
    return [(i, j) for i, j in zip(cuts[:-1], cuts[1:], strict=True) if j > i]


def _aligned(byte_bpe: str, piece_bpe: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = aligner(byte_bpe, piece_bpe)
        entry = pa.struct([("pair", pa.int64()), ("links", pa.int32())])
        for whole in batches:
            lengths = np.array([0 if x is None else x for x in pc.binary_length(whole.column("text")).to_pylist()], np.int64)
            for begin, end in _slices(lengths):
                b = whole.slice(begin, end - begin)
                done = [*two.texts(b.column("text").to_pylist())]
                n = np.array([d[0] for d in done], np.int64).reshape(-1, 4)
                pairs, links = np.concatenate([d[2] for d in done]), np.concatenate([d[3] for d in done])
                entries = pa.StructArray.from_arrays([pa.array(pairs), pa.array(links.astype(np.int32))], fields=list(entry))
                lists = pa.ListArray.from_arrays(pa.array(_offsets(np.array([len(d[2]) for d in done])).astype(np.int32)), entries)
                columns = [b.column("row"), b.column("doc_id"), *(pa.array(n[:, k]) for k in range(4)), pa.array([d[1] for d in done], pa.string()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs"])

    return run


def aligned_texts(docs: DataFrame, folder: str = FOLDER, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups, pairs of every row of docs (doc_id, text); `row` numbers the rows.

    `groups` lists the aligned groups in order, as `a1,a2|b1;a3|b2,b3`; `pairs` the distinct linked pairs (A id * 2**32 + B id) with
    their number of links. Null and empty texts, and those whose tokens don't give the text's bytes back (it holds U+2581), have
    zeros, no groups and no pairs. The folder of the vocabulary files must exist on every executor. Write the result before it is
    used twice: `row` follows the order in which the rows are read.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_aligned(f"{folder}/{byte_bpe}", f"{folder}/{piece_bpe}"), ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n_docs, best: in how many rows a pair is linked, and whether no other pair of its A id is in more."""
    counts = aligned.select(F.inline("pairs")).groupBy("pair").agg(F.count("*").alias("n_docs"))
    a = F.shiftright("pair", 32)
    top = counts.groupBy(a.alias("a")).agg(F.max("n_docs").alias("top"))
    return counts.withColumn("a", a).join(top, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("top")).alias("best"))


def link_scores(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """row, n_best, count_sum: links of a row's pairs that are the best of their A id, and their counts summed.

    At most HOT pairs can stand in one of HOT parts of all entries, so those are broadcast; the others, of which none is frequent, are joined.
    """
    entries = counts.agg(F.sum("n_docs")).first()[0] or 0
    hot = F.col("n_docs") * HOT >= entries
    each = aligned.select("row", F.inline("pairs"))
    sums = lambda df: df.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("n_docs")).alias("count_sum"))
    common = saved(counts.where(hot), "alignment-common")
    often = sums(each.join(F.broadcast(common), "pair"))
    rare = sums(each.join(F.broadcast(common.select("pair")), "pair", "left_anti").join(counts.where(~hot), "pair"))
    return often.union(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align_documents(aligned: DataFrame) -> DataFrame:
    """aligned, written, without its pairs and with n_best and count_sum of every row.

    Repeated rows and ids count as documents of their own; a null doc_id is kept. Empty tables give no rows.
    """
    counts = saved(pair_counts(aligned), "alignment-counts")
    scores = link_scores(aligned, counts)
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return aligned.drop("pairs").join(scores, "row", "left").select(*(c for c in aligned.columns if c != "pairs"), none("n_best"), none("count_sum"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = aligned_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    written = saved(aligned.withColumn("groups", digest).withColumnRenamed("groups", "groups_sha256"), "alignment-texts")
    return align_documents(written).drop("row")
