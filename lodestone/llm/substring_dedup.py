"""Exact substring dedup: remove words covered by windows that also start in a document with a smaller id.

Level-wise doubling.  The final length is halved as long as ``LEAST`` words are
left, once at least; the first level takes windows of the shortest length, each
level after it of about twice the length.  A final window holds many windows of
a level, and it is enough to look at the one with the least hash among them
(winnowing): equal final windows hold the same one.  A final window whose least
window occurs once is given up, and the next level looks at what lies in the
others alone, until the final windows themselves are compared or no candidates
are left.  Longer windows cannot cover further words, so the doubling ends at
the final length.

Hashes have 64 bits, so two different windows are taken for equal with a
chance of about n**2 / 2**65 over n windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm._chunks import Chunk, chunked, emit, reduce_shards, shards_for, with_answers
from lodestone.llm._tokens import Words, member, pack, reusing, shard_cuts, unpack, window_hashes, words_of

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
SENT = "shard int, chunk bigint, payload binary"
#: Words of a window of the first level at least, where the final length has twice as many.
LEAST = 12


def levels_of(length: int, least: int = LEAST) -> list[int]:
    """Window lengths before the final one, each half of the next: one at least."""
    out = [-(-length // 2)]
    while least <= (half := -(-out[0] // 2)) < out[0]:
        out.insert(0, half)
    return out


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """Least or largest of ``values[i : i + width]`` for every i at which that many are left."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def _least(words: Words, length: int, part: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``part`` words from each word on, and for each start of a final window the least of those within it."""
    h, _ = window_hashes(words, part)
    starts = _starts(words, length)
    out = np.zeros(len(h), np.uint64)
    width = length - part + 1
    if len(h) >= width:
        out[: len(h) - width + 1] = _sliding(h, width, np.minimum)
    return h, np.where(starts, out, 0)


def _chosen(words: Words, length: int, part: int, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of all windows of ``part`` words that are the least of a final window from ``alive`` on."""
    h, least = _least(words, length, part)
    width = length - part + 1
    # no window has a hash below the least of a final window it lies in, so it is chosen where it equals the largest of these
    largest = _sliding(np.concatenate([np.zeros(width - 1, np.uint64), np.where(alive, least, 0)]), width, np.maximum) if len(h) else h
    at = np.flatnonzero((largest == h) & (largest > 0))
    return at, h[at]


def _starts(words: Words, length: int) -> np.ndarray:
    """Whether a window of ``length`` words of one text starts at each word."""
    n = len(words.hash)
    out = np.zeros(n, bool)
    if n >= length:
        out[: n - length + 1] = words.doc[: n - length + 1] == words.doc[length - 1 :]
    return out


def _covered(n: int, at: np.ndarray, length: int) -> np.ndarray:
    """Which of n words lie in a window of ``length`` that starts at one of ``at``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.subtract.at(edge, np.minimum(at + length, n), 1)
    return np.cumsum(edge[:n]) > 0


def _alive(chunk: Chunk, words: Words, length: int, part: int | None, answers: list[tuple[int, bytes]]) -> np.ndarray:
    """Whether a final window starts at each word that may occur elsewhere, by what survived of the level before."""
    if part is None:
        return _starts(words, length) & chunk.known[words.doc]
    survivors = np.sort(np.concatenate([np.zeros(0, np.uint64), *(unpack(p)[0] for _, p in answers)]))
    if not len(survivors):
        return np.zeros(len(words.hash), bool)
    return _starts(words, length) & chunk.known[words.doc] & member(_least(words, length, part)[1], survivors)


def _level(length: int, part: int, before: int | None, shards: int):
    """Sends each chosen window of the level once, with whether several documents of the chunk have it."""

    def fn(chunk: Chunk, answers: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
        reusing()
        words = words_of(chunk.texts)
        at, h = _chosen(words, length, part, _alive(chunk, words, length, before, answers))
        doc = words.doc[at]
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        last = np.r_[first[1:], len(h)] - 1 if len(h) else first
        many = doc[first] != doc[last]
        h = h[first]
        cuts = shard_cuts(h, shards)
        return [(s, pack(h[a:b], np.packbits(many[a:b]))) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]

    return fn


def _sent(number: int, rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"shard": pa.array([r[0] for r in rows], pa.int32()), "chunk": pa.array([number] * len(rows), pa.int64()), "payload": pa.array([r[1] for r in rows], pa.binary())})


def _repeated(shard: int, chunks: list[int], payloads: list[bytes]) -> Iterator[tuple[int, bytes]]:
    parts = [unpack(p) for p in payloads]
    h = np.concatenate([p[0] for p in parts])
    many = np.concatenate([np.unpackbits(p[1], count=len(p[0])).astype(bool) for p in parts])
    order = np.argsort(h)
    s = h[order]
    same = np.zeros(len(s), bool)
    same[1:] |= s[1:] == s[:-1]
    same[:-1] |= s[1:] == s[:-1]
    hit = np.unique(s[same | many[order]])
    for c, (own, _) in zip(chunks, parts, strict=True):
        got = own[member(own, hit)]
        if len(got):
            yield c, pack(got)


def _final(length: int, before: int, shards: int):
    def fn(chunk: Chunk, answers: list[tuple[int, bytes]]) -> pa.Table:
        reusing()
        words = words_of(chunk.texts)
        pos = np.flatnonzero(_alive(chunk, words, length, before, answers))
        h = window_hashes(words, length)[0][pos] if len(pos) else np.zeros(0, np.uint64)
        ids = chunk.ids[words.doc[pos]]
        order = np.lexsort((ids, h))
        h, ids, pos = h[order], ids[order], pos[order]
        new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
        least = ids[new]
        group = np.cumsum(new) - 1
        here = np.sort(pos[ids > least[group]]) if len(h) else pos
        mask = np.zeros(len(words.hash), bool)
        mask[here] = True
        h = h[new]
        # ids as a table of the chunk's own, so that an entry takes 8 bytes and a short index
        table, index = np.unique(least, return_inverse=True)
        index = index.astype(np.uint16 if len(table) < 65536 else np.uint32)
        cuts = shard_cuts(h, shards)
        rows = [(chunk.number % shards, pack(np.zeros(0, np.uint64), np.packbits(mask)))] if mask.any() else []
        for s in range(shards):
            a, b = cuts[s], cuts[s + 1]
            if a < b:
                used, local = np.unique(index[a:b], return_inverse=True)
                rows.append((s, pack(h[a:b], table[used], local.astype(index.dtype))))
        return _sent(chunk.number, rows)

    return fn


def _least_ids(shard: int, chunks: list[int], payloads: list[bytes]) -> Iterator[tuple[int, bytes]]:
    parts = []
    for c, p in zip(chunks, payloads, strict=True):
        got = unpack(p)
        if len(got) == 2:
            yield c, p  # what the chunk found by itself goes back as it is
        else:
            parts.append((c, got[0], got[1][got[2]]))
    if not parts:
        return
    h, ids = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
    order = np.lexsort((ids, h))
    h, ids = h[order], ids[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    h, ids = h[first], ids[first]
    for c, own, least in parts:
        hit = own[ids[np.searchsorted(h, own)] < least]
        if len(hit):
            yield c, pack(hit)


def _kept(length: int):
    def fn(chunk: Chunk, answers: list[tuple[int, bytes]]) -> pa.Table:
        reusing()
        words = words_of(chunk.texts)
        n = len(words.hash)
        gone = np.zeros(n, bool)
        hits = [np.zeros(0, np.uint64)]
        for _, p in answers:
            got = unpack(p)
            if len(got) == 2:
                gone |= np.unpackbits(got[1], count=n).astype(bool)
            else:
                hits.append(got[0])
        hits = np.sort(np.concatenate(hits))
        if len(hits):
            h, fits = window_hashes(words, length)
            gone |= fits & member(h, hits) & chunk.known[words.doc]
        removed = _covered(n, np.flatnonzero(gone), length)
        first = words.first
        total = np.r_[0, np.cumsum(removed)]
        n_removed = total[first[1:]] - total[first[:-1]]
        digests = []
        for i in range(len(chunk.ids)):
            own = chunk.texts.data[chunk.texts.offsets[i] : chunk.texts.offsets[i + 1]].tobytes().split()
            if n_removed[i]:
                own = compress(own, ~removed[first[i] : first[i + 1]])
            digests.append(hashlib.sha256(b" ".join(own)).hexdigest())
        return pa.table({
            "doc_id": pa.array(chunk.ids, pa.int64(), mask=~chunk.known),
            "n_words": pa.array(np.diff(first), pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "kept_sha256": pa.array(digests, pa.string()),
        })

    return fn


def _removal(docs: DataFrame, length: int, least: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, answers): the chunk store, and for each chunk what says which of its windows go."""
    if length < 2:
        raise ValueError("a window has two words at least")
    chunks = chunked(docs, id_col, text_col)
    shards = shards_for(chunks)
    parts = levels_of(length, least)
    first = _level(length, parts[0], None, shards)
    answers = reduce_shards(emit(chunks, lambda chunk: iter(first(chunk, []))), _repeated)
    for before, part in zip(parts[:-1], parts[1:], strict=True):
        level = _level(length, part, before, shards)
        answers = reduce_shards(with_answers(chunks, answers, lambda chunk, got, level=level: _sent(chunk.number, level(chunk, got)), SENT), _repeated)
    final = with_answers(chunks, answers, _final(length, parts[-1], shards), SENT)
    return chunks, reduce_shards(final, _least_ids)


def substring_dedup(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space).

    A null or empty text has no words; a text of fewer words than ``length``
    has no window.  A null id is smaller and larger than none: such a row
    loses nothing and makes no other lose.  Rows that repeat an id are rows of
    one document: they don't remove each other's words.  Each input row gives
    one result row; other columns, whatever their names, are not read.
    """
    chunks, answers = _removal(docs, length, least, id_col, text_col)
    return with_answers(chunks, answers, _kept(length), RESULT)
