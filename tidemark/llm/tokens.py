"""Token ids of whole texts, many documents at a time.

A byte-level BPE with its usual split pattern parts a text before it merges anything: a letter and a
digit, a word and a comma, or a word and the space after it never share a token. Texts are cut where
ASCII bytes alone show such a parting, each distinct chunk is encoded once by the tokenizers library,
and a text's ids are its chunks' ids in turn. Chunks are found by 64-bit hashes and then compared byte
for byte; should two ever share a hash, the library encodes the text that shows it whole.
Tokenizers of any other make encode whole texts, and so do all for texts that hold an added token,
such as <|endoftext|>: the library takes it out of a text before the split pattern sees it.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import byte_hashes, ranges, same_bytes

#: Distinct chunks that a worker remembers (about 100 bytes each, at times) before it forgets those that came once.
_MOST = 500_000
_SPACE, _BLANK, _LETTER, _DIGIT, _MARK, _QUOTE, _OTHER = range(7)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[0x21:0x7F] = _MARK
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x27] = _QUOTE
_KIND[9:14] = _BLANK
_KIND[0x20] = _SPACE
#: Follows a space that belongs to what comes after it: any printable ASCII, or the first byte of U+00C0 to U+07FF.
_AFTER_SPACE = np.isin(_KIND, [_LETTER, _DIGIT, _MARK, _QUOTE])
_AFTER_SPACE[0xC3:0xE0] = True
_ASCII_SPACE = np.array([x < 128 and chr(x).isspace() for x in range(256)])
_kept: dict[str, Encoder] = {}


def _cuts(data: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes where the split pattern surely parts what is before from what is after."""
    k = _KIND[data]
    cut = np.zeros(len(data), bool)
    before, at = k[:-1], k[1:]
    word, plain = before <= _DIGIT, before <= _QUOTE
    black = plain & (before >= _LETTER)  # printable ASCII
    # A space goes with what follows it, whatever is before.
    cut[1:-1] = (at[:-1] == _SPACE) & _AFTER_SPACE[data[2:]]
    # White space after printable ASCII.
    cut[1:] |= black & (at <= _BLANK)
    # Letters, digits and marks end each other, but a quote may begin what letters after it belong to.
    cut[1:] |= black & (before != _QUOTE) & (at >= _LETTER) & (at <= _MARK) & (before != at)
    cut[1:] |= black & word & (at == _QUOTE)
    # After a single line break or tab: of several, the last alone is a token, so the run must stay with what follows.
    cut[2:] |= black[:-1] & (before[1:] == _BLANK) & (at[1:] >= _LETTER) & (at[1:] <= _QUOTE)
    return np.flatnonzero(cut)


def _texts(raw: np.ndarray, sizes: np.ndarray) -> list[str]:
    flat, ends = raw.tobytes(), np.cumsum(sizes).tolist()
    return [flat[a:b].decode() for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class Encoder:
    """ids are the library's, with the file as it is: an added token in a text gets its own id."""

    def __init__(self, path: str, end_id: int = 0):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.added = [x["content"] for x in made.get("added_tokens") or [] if x["content"]]
        pre = made.get("pre_tokenizer") or {}
        self.cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not any(made.get(x) for x in ("normalizer", "truncation", "padding", "post_processor"))
        # A byte-level token has a character for each of its bytes.
        self.bytes_of = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())])
        self._clear()

    def _clear(self) -> None:
        """Chunk 0 is the end of a document; hashes are sorted, with the chunk of each and the runs of texts that had it."""
        self.hashes, self.chunk, self.uses = np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int32)
        self.pool, self.starts, self.lengths = np.array([self.end_id], np.uint32), np.zeros(1, np.int32), np.ones(1, np.int32)
        # The bytes of each chunk, the end's zero byte first.
        self.bytes, self.at, self.size = np.zeros(1, np.uint8), np.zeros(1, np.int32), np.ones(1, np.int32)

    def _forget(self) -> None:
        """Only chunks stay that came in several runs since the last time, the most frequent ones, half of _MOST at most."""
        some = np.flatnonzero(self.uses > 1)
        some = np.sort(some[np.argsort(-self.uses[some], kind="stable")[: _MOST // 2]])
        own = np.r_[0, self.chunk[some]]
        n, size = self.lengths[own], self.size[own]
        self.pool, self.bytes = self.pool[ranges(self.starts[own], n)], self.bytes[ranges(self.at[own], size)]
        self.starts, self.lengths, self.at, self.size = (np.cumsum(n) - n).astype(np.int32), n, (np.cumsum(size) - size).astype(np.int32), size
        self.hashes, self.chunk, self.uses = self.hashes[some], np.arange(1, len(own), dtype=np.int32), np.ones(len(some), np.int32)

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([y for x in ids for y in x], np.uint32), np.array([len(x) for x in ids], np.int64)

    def _joined(self, raw: np.ndarray, sizes: np.ndarray, gap: str) -> tuple[np.ndarray, np.ndarray]:
        """Chunks (their bytes, and how many each has) that a gap between them keeps apart, encoded as one text and parted by bytes."""
        ends = np.cumsum(sizes + len(gap)) - len(gap)
        if gap:
            spaced = np.full(ends[-1], ord(gap), np.uint8)
            spaced[np.arange(len(raw)) + np.repeat(np.arange(len(sizes)), sizes)] = raw
        text = (spaced if gap else raw).tobytes().decode()
        if any(x in text for x in self.added):  # made by the joining: no chunk has one
            return self._each(_texts(raw, sizes))
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        token_ends = np.cumsum(self.bytes_of[ids])
        last = np.searchsorted(token_ends, ends)
        if last[-1] != len(ids) - 1 or (token_ends[last] != ends).any():
            return self._each(_texts(raw, sizes))
        n = np.diff(np.r_[-1, last])
        if gap:  # one token each, before each chunk but the first
            ids, n[1:] = np.delete(ids, last[:-1] + 1), n[1:] - 1
        return ids, n

    def _learn(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """hashes and places in data, which a byte follows, of chunks that are not known."""
        first, second, end = data[starts], data[starts + 1], data[starts + sizes - 1]
        led = (first == 0x20) & (sizes > 1) & ~_ASCII_SPACE[second]
        bare = ~_ASCII_SPACE[first] & ~_ASCII_SPACE[end]
        # Some characters of several bytes are white space.
        for i in np.flatnonzero((first == 0x20) & (sizes > 1) & (second >= 0x80) | (first >= 0x80) | (end >= 0x80)).tolist():
            x = data[starts[i] : starts[i] + sizes[i]].tobytes().decode()
            led[i], bare[i] = x[0] == " " and not x[1].isspace(), not x[0].isspace() and not x[-1].isspace()
        for some, encode in ((led, lambda *c: self._joined(*c, "")), (bare, lambda *c: self._joined(*c, "\n")), (~led & ~bare, lambda *c: self._each(_texts(*c)))):
            some = np.flatnonzero(some)
            for part in (some[at : at + 8_000] for at in range(0, len(some), 8_000)):
                size = sizes[part]
                raw = data[ranges(starts[part], size)]
                ids, n = encode(raw, size)
                new = hashes[part]
                order = np.argsort(new)
                place = np.searchsorted(self.hashes, new[order])
                self.chunk = np.insert(self.chunk, place, (len(self.starts) + order).astype(np.int32))
                self.uses = np.insert(self.uses, place, 0)
                self.hashes = np.insert(self.hashes, place, new[order])
                self.starts = np.concatenate([self.starts, (len(self.pool) + np.cumsum(n) - n).astype(np.int32)])
                self.lengths = np.concatenate([self.lengths, n.astype(np.int32)])
                self.pool = np.concatenate([self.pool, ids])
                self.at = np.concatenate([self.at, (len(self.bytes) + np.cumsum(size) - size).astype(np.int32)])
                self.size = np.concatenate([self.size, size.astype(np.int32)])
                self.bytes = np.concatenate([self.bytes, raw])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, end ids included, as uint32, and each text's number of them."""
        if not self.cuts:
            return self._whole(texts)
        held = np.zeros(len(texts), bool)
        for x in self.added:
            held |= pc.fill_null(pc.match_substring(texts, x), False).to_numpy(zero_copy_only=False)
        parts, counts = [], np.zeros(len(texts), np.int64)
        while not held.all():
            some = np.flatnonzero(~held)
            ids, n, sure = self._chunked(texts.take(pa.array(some)) if held.any() else texts)
            if sure.all():
                counts[some] = n
                parts.append((some, ids))
                break
            held[some[~sure]] = True
        if held.any():
            some = np.flatnonzero(held)
            ids, counts[some] = self._whole(texts.take(pa.array(some)))
            parts.append((some, ids))
        if len(parts) == 1:
            return parts[0][1], counts
        out, starts = np.empty(counts.sum(), np.uint32), np.cumsum(counts) - counts
        for some, ids in parts:
            out[ranges(starts[some], counts[some])] = ids
        return out, counts

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids, n = self._each([x or "" for x in texts.to_pylist()])
        out = np.full(len(ids) + len(n), self.end_id, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
        return out, n + 1

    def _chunked(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For texts without added tokens; with which of them have no chunk that another one's hash hides."""
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        raw = texts.buffers()
        ends = np.frombuffer(raw[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        body = np.frombuffer(raw[2], np.uint8)[ends[0] : ends[-1]] if raw[2] is not None else np.empty(0, np.uint8)
        sizes = np.diff(ends)
        # Each text is followed by a zero byte, a chunk of its own that stands for the end id.
        stops = np.cumsum(sizes + 1) - 1
        data = np.zeros(len(body) + len(sizes), np.uint8)
        data[np.arange(len(body)) + np.repeat(np.arange(len(sizes)), sizes)] = body
        marks = np.zeros(len(data) + 1, bool)
        marks[_cuts(data)] = True
        marks[stops] = marks[stops + 1] = marks[0] = True
        edges = np.flatnonzero(marks)
        hashes = byte_hashes(data, edges[:-1], edges[1:])
        last = np.searchsorted(edges, stops)
        distinct, first, which = np.unique(np.delete(hashes, last), return_index=True, return_inverse=True)
        if len(self.hashes) + len(distinct) > _MOST:
            self._forget()
        place = np.minimum(np.searchsorted(self.hashes, distinct), max(len(self.hashes) - 1, 0))
        new = np.flatnonzero(self.hashes[place] != distinct) if len(self.hashes) else np.arange(len(distinct))
        if len(new):
            at = np.delete(np.arange(len(hashes)), last)[first[new]]
            self._learn(distinct[new], data, edges[at], edges[at + 1] - edges[at])
        chunk = np.zeros(len(hashes), np.int32)
        inside = np.ones(len(hashes), bool)
        inside[last] = False
        place = np.searchsorted(self.hashes, distinct)
        self.uses[place] += 1
        chunk[inside] = self.chunk[place][which] if len(distinct) else 0
        size = np.diff(edges)
        same = self.size[chunk] == size
        same[same] = same_bytes(data, edges[:-1][same], self.bytes, self.at[chunk[same]], size[same])
        sure = np.diff(np.r_[0, np.cumsum(~same)[last]]) == 0
        lengths = self.lengths[chunk].astype(np.int64)
        ids = self.pool[ranges(self.starts[chunk], lengths)]
        return ids, np.diff(np.r_[0, np.cumsum(lengths)[last]]), sure


def encoder(path: str, end_id: int = 0) -> Encoder:
    """A worker's encoder for this file, kept between batches and tasks; its ids are those of the library as it comes."""
    if (path, end_id) not in _kept:
        _kept[path, end_id] = Encoder(path, end_id)
    return _kept[path, end_id]


def encoded(texts: pa.Array, path: str, end_id: int = 0) -> tuple[np.ndarray, np.ndarray]:
    return encoder(path, end_id).encode(texts)
