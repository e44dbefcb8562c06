"""Byte-level kernels over Arrow text columns.

A column of texts is seen as one array of UTF-8 bytes and the offsets of its
texts, so that a statistic over a batch of documents is a few numpy passes over
the bytes instead of a Python loop over characters.  Batches are cut into runs
of whole texts of about ``RUN`` bytes, which bounds the memory by the run and by
the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass handles at a time.
RUN = 2 << 20


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(texts: pa.Array, size: int = RUN) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first, last, bytes, offsets) of consecutive texts, about ``size`` bytes each."""
    raw, off = buffers(texts)
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def sums(x: np.ndarray, off: np.ndarray, dtype=np.int64) -> np.ndarray:
    """The sum of x over each [off[i], off[i+1]); empty stretches give 0."""
    if len(off) < 2:
        return np.zeros(0, dtype)
    if not len(x):
        return np.zeros(len(off) - 1, dtype)
    starts = np.minimum(off[:-1], len(x) - 1)
    out = np.add.reduceat(x, starts, dtype=dtype)
    out[off[1:] == off[:-1]] = 0
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words: ASCII letters (lower-cased) and every byte of a non-ASCII character; the rest is 0.
WORD = np.where(((_LOWER >= 97) & (_LOWER <= 122)) | (np.arange(256) >= 128), _LOWER, 0).astype(np.uint8)

_P = np.uint64(0x9E3779B97F4A7C15)
_POW = np.ones(4096, np.uint64)
with np.errstate(over="ignore"):
    for _i in range(1, len(_POW)):
        _POW[_i] = _POW[_i - 1] * np.uint64(0x100000001B3)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, offsets of the texts' words); a word is a run of WORD bytes, never across texts."""
    b = WORD[raw]
    inside = b != 0
    first = inside.copy()
    if len(b):
        first[1:] &= ~inside[:-1]
        starts_of_texts = off[:-1][off[:-1] < len(b)]
        first[starts_of_texts] = inside[starts_of_texts]
    at = np.flatnonzero(first)
    counts = np.searchsorted(at, off)
    if not len(at):
        return np.zeros(0, np.uint64), counts
    # a word's bytes are inside; bytes outside have weight 0, so the sum from one word's start to the next is the word's
    pos = np.arange(len(b)) - np.repeat(at, np.diff(np.append(at, len(b)))) if at[0] == 0 else None
    if pos is None:
        b = b[at[0] :]
        pos = np.arange(len(b)) - np.repeat(at - at[0], np.diff(np.append(at, at[0] + len(b))))
    with np.errstate(over="ignore"):
        weighted = b.astype(np.uint64) * _POW[pos & 4095] + (pos >> 12).astype(np.uint64) * b
        return mix(np.add.reduceat(weighted, at - at[0]) + _P), counts


def crc_rest(doc_id: str, n: int):
    """crc32 of the id's decimal text, modulo n, as a Column (null id: null)."""
    from pyspark.sql import functions as F

    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n))
