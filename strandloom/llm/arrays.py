"""Whole Arrow batches of texts as numpy arrays: bytes, words and rolling fingerprints, without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Fingerprints are polynomials over the field of this prime, at two bases chosen apart from each other.
PRIME = (1 << 61) - 1
BASE = (0x0E3779B97F4A7C15, 0x1134_2543_DE82_EF95)
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(30))
        x = x * U(0xBF58476D1CE4E5B9)
        x ^= x >> U(27)
        x *= U(0x94D049BB133111EB)
        x ^= x >> U(31)
    return x


#: The value of each byte as a unit of a fingerprint.
BYTE = np.arange(1, 257, dtype=U)
#: Values that are summed at a time, so that what comes between stays in a core's cache.
STEP = 1 << 14
_LOW30, _LOW31, _P = U((1 << 30) - 1), U((1 << 31) - 1), U(PRIME)


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, of any 64-bit values."""
    x = (x & _P) + (x >> U(61))
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, of values below it, in halves of 31 bits."""
    a0, b0, b1 = a & _LOW31, b & _LOW31, b >> U(31)
    a1 = a >> U(31)
    if a1.any():
        middle = a1 * b0 + a0 * b1
        top = U(2) * (a1 * b1)
    else:
        middle, top = a0 * b1, U(0)
    return _reduced(top + (middle >> U(30)) + ((middle & _LOW30) << U(31)) + a0 * b0)


def powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i < n, modulo PRIME; kept for batches of the usual size."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        made = []
        for base in (BASE[which], pow(BASE[which], -1, PRIME)):
            x = np.ones(1, U)
            while len(x) < size:
                x = np.concatenate([x, times(x, np.full(1, pow(base, len(x), PRIME), U))])
            made.append(x)
        have = tuple(made)
        if size <= 1 << 23:
            _powers[which] = have
    return have[0][:n], have[1][:n]


class Fingerprints:
    """Fingerprints of any substring of a sequence of 64-bit values, in constant time each.

    Over a prime field two different sequences of n values agree at a base for at most n of 2**61 bases, whatever their pattern
    (modulo 2**64 Thue-Morse sequences agree at every base).
    """

    def __init__(self, values: np.ndarray, which: int = 0):
        n, (up, self.down) = len(values), powers(len(values) + 1, which)
        self.sums, carry = np.zeros(n + 1, U), U(0)
        for i in range(0, n, STEP):
            part = values[i : i + STEP]
            terms = times(part if part.max() < _P else _reduced(part), up[i : i + len(part)])
            high, low = np.cumsum(terms >> U(31)), np.cumsum(terms & _LOW31)
            self.sums[i + 1 : i + 1 + len(part)] = _reduced((high >> U(30)) + ((high & _LOW30) << U(31)) + low + carry)
            carry = self.sums[i + len(part)]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(times(_reduced(self.sums[end] + (_P - self.sums[start])), self.down[start]) + ((end - start).astype(U) << U(40)))


def rolled(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k values from each place on, k a power of two; for choices and candidates that are verified later."""
    with np.errstate(over="ignore"):
        out = mix(values)
        half = 1
        while half < k:
            out = out[:-half] * U(0x9E3779B97F4A7C15) + out[half:]
            out ^= out >> U(29)
            half *= 2
    return out


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    if len(texts) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches at rows so that each holds about `most` bytes of text; a longer text comes alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        _, offs = buffers(texts)
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offs, offs[at] + most, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of every word: a maximal run without blanks inside one text."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~BLANK[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    text = np.searchsorted(offs, start, "right") - 1
    return start, end, text


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    return Fingerprints(BYTE[data], which).of(start, end)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all else as it is."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


#: Bytes that make up a plain word: a-z, A-Z, 0-9 and all of UTF-8 beyond ASCII.
PLAIN = np.zeros(256, bool)
PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def plain_words(data: np.ndarray, offs: np.ndarray, keep: np.ndarray = PLAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words stripped of all bytes outside `keep`, empty ones left out: (their bytes, start, end, text)."""
    start, end, text = words(data, offs)
    kept = keep[data]
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kept, out=at[1:])
    start, end = at[start], at[end]
    full = end > start
    return data[kept], start[full], end[full], text[full]


class Members:
    """Membership in a sorted set of 64-bit values, with a bitmap in front that turns most others away."""

    def __init__(self, values: np.ndarray, bits: int | None = None):
        self.values = np.unique(values.astype(U))
        self.shift = U(64 - (bits or min(24, max(12, int(len(self.values)).bit_length() + 5))))
        self.bitmap = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bitmap[self.values >> self.shift] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in x that are members, their index among the sorted values)."""
        at = np.flatnonzero(self.bitmap[x >> self.shift]) if len(x) else np.zeros(0, np.int64)
        i = np.searchsorted(self.values, x[at])
        i = np.minimum(i, max(len(self.values) - 1, 0))
        hit = self.values[i] == x[at] if len(self.values) else np.zeros(len(at), bool)
        return at[hit], i[hit]
