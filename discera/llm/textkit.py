"""Vectorised word splitting and hashing over Arrow string columns.

Everything works on UTF-8 bytes in pieces of bounded size, so memory follows the piece
and the number of words, not eight bytes for each byte of text. Words of equal bytes
(after the alphabet's case folding) get equal 64-bit hashes wherever they stand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK = 2 << 20
"""Bytes of text handled at once (a longer document is a chunk of its own)."""
PIECE = 1 << 17
"""Bytes whose running hash is held at once."""
LONG_WORD = 1 << 16
"""Words of more bytes are hashed by blake2b."""

_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer, in place."""
    h ^= h >> _U(33)
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


class Alphabet:
    """Which bytes are part of a word, and whether A-Z count as a-z."""

    def __init__(self, kind: str, fold: bool):
        word = np.ones(256, bool)
        if kind == "space":  # words are [^\x20\x09-\x0D]+
            word[[0x20, *range(0x09, 0x0E)]] = False
        elif kind == "alnum":  # after folding, words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
            word[:0x80] = False
            word[0x30:0x3A] = word[0x61:0x7B] = True
            if fold:
                word[0x41:0x5B] = True
        else:  # letters: ASCII letters and whatever is not ASCII
            word[:0x80] = False
            word[0x61:0x7B] = word[0x41:0x5B] = True
        self.word, self.fold = word, fold


@lru_cache(maxsize=4)
def _tables(fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random value for each byte, powers of an odd base, and their inverses modulo 2**64."""
    values = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
    if fold:
        values[0x41:0x5B] = values[0x61:0x7B]
    base = 0x2545F4914F6CDD1D
    size = PIECE + LONG_WORD + 1
    power = np.full(size, base, _U)
    inverse = np.full(size, pow(base, -1, 1 << 64), _U)
    power[0] = inverse[0] = 1
    return values, np.cumprod(power, dtype=_U), np.cumprod(inverse, dtype=_U)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about limit bytes; no document is split."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words(data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes into data) of all words, and each document's first word (one more at the end)."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    inside = alphabet.word[data[lo:hi]]
    if not inside.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    cut = offsets[1:-1] - lo  # a word never spans two documents
    cut = cut[(cut > 0) & (cut < inside.size)]
    opens[cut] = inside[cut]
    closes[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(opens) + lo, np.flatnonzero(closes) + lo + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, alphabet: Alphabet) -> np.ndarray:
    values, power, inverse = _tables(alphabet.fold)
    out = np.empty(len(starts), _U)
    long = np.flatnonzero(ends - starts > LONG_WORD)
    i, n, edge = 0, len(starts), [*long.tolist(), len(starts)]
    for stop in edge:
        while i < stop:
            j = max(i + 1, int(np.searchsorted(starts[i:stop], starts[i] + PIECE, "left")) + i)
            lo, hi = int(starts[i]), int(ends[j - 1])
            run = np.zeros(hi - lo + 1, _U)
            np.cumsum(values[data[lo:hi]] * power[: hi - lo], out=run[1:])
            s, e = starts[i:j] - lo, ends[i:j] - lo
            h = (run[e] - run[s]) * inverse[s]
            h += (e - s).astype(_U) * _U(0xD6E8FEB86659FD93)
            out[i:j] = mix(h)
            i = j
        if stop < n:
            text = data[starts[stop] : ends[stop]].tobytes()
            out[stop] = int.from_bytes(hashlib.blake2b(text.lower() if alphabet.fold else text, digest_size=8).digest(), "little")
            i = stop + 1
    return out


@lru_cache(maxsize=128)
def _weights(k: int) -> np.ndarray:
    return mix(np.arange(1, k + 1, dtype=_U) * _U(0xA24BAED4963EE407) + _U(k)) | _U(1)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, across document ends too (callers mask those)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.zeros(n, _U)
    for j, w in enumerate(_weights(k)):
        out += h[j : j + n] * w
    return mix(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and the length of each row's list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
