"""Words of whole texts as 64-bit hashes, many documents at a time in numpy.

A batch's texts are joined by a space into one byte buffer (a space is in no word), so one pass finds
all words. A word is hashed eight bytes at a time, each step mixing all that came before with the next
eight, and a long word by xxhash; a window of words is hashed from the hashes of its halves. No step is
linear, so no pattern of repeated letters or words makes two of them meet. Where a result hangs on
two texts being equal, callers compare the bytes, or two hashes with seeds of their own (128 bits).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

PIECE_BYTES = 1 << 19
#: Words of more bytes are hashed by xxhash, one by one.
_LONG = 128
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_FIRST_BYTES = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)

_b = np.arange(256)
#: Words `[^\x20\x09-\x0D]+`.
SPACE_WORDS = ~((_b == 0x20) | ((_b >= 9) & (_b <= 13)))
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
ALNUM_WORDS = ((_b >= 0x30) & (_b <= 0x39)) | ((_b >= 0x61) & (_b <= 0x7A)) | (_b >= 0x80)
LOWER = np.where((_b >= 65) & (_b <= 90), _b + 32, _b).astype(np.uint8)

def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a, then b."""
    x = a * _C1
    return mix((x ^ (x >> np.uint64(32))) + b)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of data on as one number; zeros follow its end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of the bytes data[starts[i]:ends[i]], for spans of any lengths."""
    at, n = eights(data), ends - starts
    h = mix(at[starts] & _FIRST_BYTES[np.minimum(n, 8)], 0x5851F42D4C957F2D * (2 * seed + 1) & 0xFFFFFFFFFFFFFFFF)
    more, step = np.flatnonzero((n > 8) & (n <= _LONG)), 8
    while len(more):
        h[more] = pair(h[more], at[starts[more] + step] & _FIRST_BYTES[np.minimum(n[more] - step, 8)])
        step += 8
        more = more[n[more] > step]
    for i in np.flatnonzero(n > _LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    return mix(h + n.astype(np.uint64) * _C2)


def same_bytes(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which spans of n[i] bytes from a_at[i] in a and b_at[i] in b are equal."""
    x, y = eights(a), eights(b)
    same = ((x[a_at] ^ y[b_at]) & _FIRST_BYTES[np.minimum(n, 8)]) == 0
    more, step = np.flatnonzero(same & (n > 8)), 8
    while len(more) and step < _LONG:
        same[more] = ((x[a_at[more] + step] ^ y[b_at[more] + step]) & _FIRST_BYTES[np.minimum(n[more] - step, 8)]) == 0
        step += 8
        more = more[same[more] & (n[more] > step)]
    for i in more.tolist():
        same[i] = np.array_equal(a[a_at[i] : a_at[i] + n[i]], b[b_at[i] : b_at[i] + n[i]])
    return same


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in runs of about `most` text bytes at most; a longer text is a run of its own."""
    for batch in batches:
        n = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        i = 0
        ends = np.cumsum(n)
        while i < len(n):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
            yield batch.slice(i, j - i)
            i = j
    pa.default_memory_pool().release_unused()  # workers live on, for other tasks


class Words:
    """Words of one run of texts. offsets[i]:offsets[i+1] are document i's words; starts, ends their bytes in data."""

    def __init__(self, texts: pa.Array, kind: np.ndarray = SPACE_WORDS, lower: bool = False):
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        raw = texts.buffers()
        ends = np.frombuffer(raw[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        body = np.frombuffer(raw[2], np.uint8)[ends[0] : ends[-1]] if raw[2] is not None else np.empty(0, np.uint8)
        at = ends - ends[0]
        n = len(texts)
        data = np.full(len(body) + n + 1, 32, np.uint8)
        if n <= 64:
            for i in range(n):
                data[at[i] + i + 1 : at[i + 1] + i + 1] = body[at[i] : at[i + 1]]
        else:
            data[np.arange(1, len(body) + 1) + np.repeat(np.arange(n), np.diff(at))] = body
        self.doc_starts = at + np.arange(1, n + 2)
        self.data = LOWER[data] if lower else data
        inside = kind[self.data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.starts, self.ends = edges[::2], edges[1::2]
        self.offsets = np.searchsorted(self.starts, self.doc_starts)
        self.counts = np.diff(self.offsets)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return byte_hashes(self.data, self.starts, self.ends, seed)

    def coded(self) -> pa.DictionaryArray:
        """Each word as a number in a dictionary of these texts' different words: by their bytes, not by hashes."""
        n = self.ends - self.starts
        flat = self.data[ranges(self.starts, n)]
        words = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.r_[0, np.cumsum(n)]), pa.py_buffer(flat)])
        return words.dictionary_encode()

    def numbers(self) -> np.ndarray:
        """A number for each word, the same for equal words of these texts alone."""
        return self.coded().indices.to_numpy().astype(np.int64)

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words; len(words) - k + 1 of them."""
    if len(words) < k:
        return np.empty(0, np.uint64)
    # Of the powers of two that make k, each one's windows follow those before.
    power, width, out, have = words, 1, None, 0
    while True:
        if k & width:
            out = power if out is None else pair(out[: len(words) - have - width + 1], power[have:])
            have += width
        if have == k:
            return mix(out, k)
        power, width = pair(power[:-width], power[width:]), 2 * width


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i]+1, ... counts[i] of them, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def span_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of words[starts[i]:ends[i]], for spans of any lengths from 1: of the two longest windows, a power of two, at its ends."""
    n = ends - starts
    out, power, width = np.empty(len(n), np.uint64), words, 1
    while len(n):
        own = np.flatnonzero((n >= width) & (n < 2 * width))
        out[own] = pair(power[starts[own]], power[ends[own] - width])
        if n.max() < 2 * width:
            break
        power, width = pair(power[:-width], power[width:]), 2 * width
    return mix(out + n.astype(np.uint64), 5)


def sliding_least(x: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each m consecutive values, the smallest and its index, the leftmost among equals."""
    value, at, have = x, np.arange(len(x)), 1
    while have < m:
        step = min(have, m - have)
        right = value[step:] < value[:-step]
        value = np.where(right, value[step:], value[:-step])
        at = np.where(right, at[step:], at[:-step])
        have += step
    return value, at
