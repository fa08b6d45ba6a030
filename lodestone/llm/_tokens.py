"""Vectorised words and rolling hashes over the UTF-8 bytes of many texts at once.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, that is
``[^\\x20\\x09-\\x0D]+``.  Hashes are 64-bit polynomial sums, taken from prefix
sums modulo 2**64, then mixed; they depend on the text alone.
"""

from __future__ import annotations

import contextlib
import ctypes
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_SEED = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _SEED.integers(0, 2**64, 256, dtype=np.uint64)
_CODE = np.arange(256, dtype=np.uint8)
_SPACE = (_CODE == 0x20) | ((_CODE >= 0x09) & (_CODE <= 0x0D))
_LOWER = np.where((_CODE >= 0x41) & (_CODE <= 0x5A), _CODE + 32, _CODE).astype(np.uint8)
_BASES = {"byte": 0x9E3779B97F4A7C15, "word": 0xD1342543DE82EF95}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply); a bijection."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


#: Bytes or words that are hashed at a time: what a hash needs besides its result doesn't grow with a text.
BLOCK = 1 << 17


@cache
def _power(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for one block and a window's length more."""
    out = []
    for b in (_BASES[kind], pow(_BASES[kind], -1, 2**64)):
        steps = np.full(BLOCK + (1 << 12), b, dtype=np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def lean() -> None:
    """In a Python worker, before each task or group: give back what the one before has left, and from now on large arrays as they are freed."""
    _system_pool()
    _thresholds(1 << 20, 128 << 10)
    trimmed()


def reusing() -> None:
    """In a Python worker, until the next :func:`lean`: use the memory of freed arrays again, up to 64 MB of it, instead of giving it back.

    Memory that is new has to be cleared page by page, which takes as long as
    the sums over a chunk do.
    """
    _thresholds(32 << 20, 64 << 20)


def _thresholds(mapped: int, kept: int) -> None:
    """From which size on arrays are mapped by themselves, and how much free memory stays at the end of the heap."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, mapped)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, kept)  # M_TRIM_THRESHOLD


@cache
def _system_pool() -> None:
    pa.set_memory_pool(pa.system_memory_pool())


def trimmed() -> None:
    """In a Python worker: give freed small pieces of memory back as well, so that a worker that waits holds little."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


class Texts(NamedTuple):
    """UTF-8 bytes of several texts, one after the other; text i is data[offsets[i]:offsets[i+1]]."""

    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Word j lies at data[start[j]:end[j]] in text doc[j]; first[i]:first[i+1] are the words of text i."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    """Bytes of a string column, without a copy where Arrow holds it in one piece; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def lowered(texts: Texts) -> Texts:
    """A-Z in lower case, all other bytes as they are."""
    return Texts(_LOWER[texts.data], texts.offsets)


def words_of(texts: Texts) -> Words:
    data, offsets = texts
    n = len(data)
    word = ~_SPACE[data]
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], before[1:] = False, word[:-1]
        after[-1], after[:-1] = False, word[1:]
        inner = offsets[(offsets > 0) & (offsets < n)]
        before[inner] = False
        after[inner - 1] = False
    start = np.flatnonzero(word & ~before)
    end = np.flatnonzero(word & ~after) + 1
    first = np.searchsorted(start, offsets, "left")
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    size = (end - start).astype(np.uint64)
    return Words(start, end, doc, first, mix(_byte_sums(data, start, end) + size * _BYTE[0]))


def _byte_sums(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial sum of the bytes of each word, words being in order."""
    up, down = _power("byte")
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        low = start[at]
        stop = int(np.searchsorted(end, low + BLOCK, "right"))
        if stop == at:  # one word longer than a block: block by block
            value = 0
            for i in range(low, end[at], BLOCK):
                part = data[i : min(i + BLOCK, end[at])]
                value += int(np.sum(_BYTE[part] * up[: len(part)], dtype=np.uint64)) * pow(_BASES["byte"], int(i - low), 2**64)
            out[at] = value % 2**64
            at += 1
            continue
        part = data[low : end[stop - 1]]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=total[1:])
        a = start[at:stop] - low
        out[at:stop] = (total[end[at:stop] - low] - total[a]) * down[a]
        at = stop
    return out


def window_hashes(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``length`` words from each word on, and whether so many words of its text are left."""
    n = len(words.hash)
    fits = np.zeros(n, bool)
    out = np.zeros(n, np.uint64)
    if length > 1 << 12:
        raise ValueError("a window has 4096 words at most")
    if n >= length:
        up, down = _power("word")
        k = n - length + 1
        fits[:k] = words.doc[:k] == words.doc[length - 1 :]
        for a in range(0, k, BLOCK):
            b = min(a + BLOCK, k)
            part = words.hash[a : b + length - 1]
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * up[: len(part)], out=total[1:])
            out[a:b] = mix((total[length:] - total[: b - a]) * down[: b - a] + np.uint64(length))
    return out, fits


def whole_hashes(words: Words, most: int) -> np.ndarray:
    """Hash of all words of each text of at most ``most`` words; equal to :func:`window_hashes` over a window of that length."""
    size = np.diff(words.first)
    out = np.zeros(len(size), np.uint64)
    up, _ = _power("word")
    for k in range(most):
        own = np.flatnonzero((size > k) & (size <= most))
        out[own] += words.hash[words.first[own] + k] * up[k]
    return mix(out + size.astype(np.uint64))


def shard_cuts(sorted_hashes: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's part of an ascending hash array begins; shards are equal ranges of the hash space."""
    edges = [(i << 64) // shards for i in range(1, shards)]
    inner = np.searchsorted(sorted_hashes, np.array(edges, dtype=np.uint64), "left")
    return np.concatenate([[0], inner, [len(sorted_hashes)]]).astype(np.int64)


def pack(*arrays: np.ndarray) -> bytes:
    """Several arrays as one byte string; :func:`unpack` gives them back."""
    head = ";".join(f"{a.dtype.str},{len(a)}" for a in arrays).encode()
    return len(head).to_bytes(4, "little") + head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(payload: bytes) -> list[np.ndarray]:
    at = 4 + int.from_bytes(payload[:4], "little")
    out = []
    for part in payload[4:at].decode().split(";"):
        kind, n = part.split(",")
        out.append(np.frombuffer(payload, np.dtype(kind), int(n), at))
        at += out[-1].nbytes
    return out


def member(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    """Which values occur in an ascending array."""
    if not len(ascending):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ascending, values)
    at[at == len(ascending)] = 0
    return ascending[at] == values
