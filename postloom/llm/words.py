"""Words and their hashes for a whole Arrow text column at a time (numpy, no per-word Python).

A word is a maximal run of bytes other than space and U+0009..U+000D, so it is the
same word as the regular expression ``[^\\x20\\x09-\\x0D]+`` finds in the decoded text
(no multi-byte UTF-8 sequence contains those bytes).  Null texts count as empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
CHUNK_BYTES = 1 << 20  # texts are worked on in runs of about this many bytes (one text at least)

_BYTE_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xC2B2AE3D27D4EB4F | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (kept; grown when a longer text comes)."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        have = _powers[base] = (out[0], out[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of consecutive texts: text d has the words first[d] .. first[d + 1] - 1."""

    data: np.ndarray  # bytes of the texts, one after the other
    text_at: np.ndarray  # where each text starts in data; one more entry for the end
    start: np.ndarray  # byte span of each word
    end: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes."""
        n = len(self.data)
        up, down = powers(_BYTE_BASE, n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start])


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def split_words(data: np.ndarray, text_at: np.ndarray, spaces: np.ndarray = SPACES) -> Words:
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(data, text_at, z, z, np.zeros(len(text_at), np.int64))
    inside = ~spaces[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[text_at[text_at < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[text_at[text_at > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, text_at, start, end, np.searchsorted(start, text_at))


def chunks(text_at: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts with at most ``limit`` bytes together, or one longer text."""
    i, n = 0, len(text_at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(text_at, text_at[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def word_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    data, at = texts_of(column)
    for i, j in chunks(at, limit):
        yield i, j, split_words(data[at[i] : at[j]], at[i : j + 1] - at[i])


def windows(words: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rolling (Rabin-Karp) hash of every run of ``size`` words within a text:
    the text's index, the first word's place in that text, and the hash."""
    n = len(hashes)
    up, down = powers(_WORD_BASE, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], out=sums[1:])
    per_text = np.maximum(words.counts() - size + 1, 0)
    doc = np.repeat(np.arange(len(per_text)), per_text)
    offset = np.arange(len(doc)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    at = words.first[doc] + offset
    return doc, offset, mix((sums[at + size] - sums[at]) * down[at])


_pack, _unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeeze(values: np.ndarray) -> bytes:
    """An integer array as bytes for a shuffle: byte planes, then zstd."""
    if not len(values):
        return b""
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T)
    return _pack.compress(planes.tobytes())


def expand(raw: bytes, dtype: type) -> np.ndarray:
    if not raw:
        return np.zeros(0, dtype)
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(_unpack.decompress(raw), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


_NOT_WORD = re.compile(r"[\W_]+")


def plain_word_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """As ``word_chunks``, over lower-cased texts in which only letters and digits make words."""
    _, at = texts_of(column)
    for i, j in chunks(at, limit):
        texts = [_NOT_WORD.sub(" ", t.lower()).encode() if t else b"" for t in column[i:j].to_pylist()]
        ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        yield i, j, split_words(np.frombuffer(b"".join(texts), np.uint8), ends)


def cuts(groups: np.ndarray, n: int) -> np.ndarray:
    """Where each of the groups 0 .. n - 1 begins in a sorted array of group numbers, and the end."""
    return np.searchsorted(groups, np.arange(n + 1))
