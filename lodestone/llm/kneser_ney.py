"""Interpolated modified Kneser-Ney n-gram model, counted in Spark, and the scores of texts under it.

    p_k(w | h) = max(c_k(hw) - D_k(c_k(hw)), 0) / c_k(h.) + g_k(h) p_{k-1}(w | h')
    p_0(w)     = 1 / (V + 1)

h' is h without its first word, c_k the training count at the highest order and
below it the number of different words that precede hw, D_k the three discounts
of the order, g_k(h) what they leave.

Counting goes from the highest order down, one exchange for each order.  A
chunk of documents sends each of its n-grams once, as a 64-bit hash, to the
shard of the hash space that holds it; the shard adds up and answers each
chunk in the chunk's own order.  Of the chunks that have an n-gram the shard
names one its owner, and owners alone pass the n-gram on: as a follower of its
context, and as a predecessor of its suffix.  So no context, however frequent,
meets all its followers anywhere.

:func:`score_documents` scores the documents it learns from, and reads no more
than these answers.  :func:`train` stores the model as sorted hash arrays in a
folder that all workers see, and :func:`score_texts` scores other texts with
the arrays mapped from there.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Callable, Collection, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._chunks import PAYLOAD, Chunk, chunked, emit, reduce_shards, shards_for, with_answers
from lodestone.llm._spark import materialize
from lodestone.llm._tokens import lowered, mix, pack, reusing, shard_cuts, unpack, words_of

BEGIN, END = (int(x) for x in mix(np.array([11, 13], np.uint64)))
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
ORDER = 3
#: Columns of an n-gram below the highest order: as a context the mass of its followers and how many are counted once, twice
#: and more often; its own count of predecessors.  Words have their training count as one more.
MASS, ONE, TWO, MORE, COUNT, TOKENS = range(6)


def in_training(doc_id: int, known: bool, folds: int = 10) -> bool:
    """Whether a document is learned from: the CRC-32 of its id as text isn't 0 modulo ``folds``; a null id isn't learned from."""
    return known and zlib.crc32(str(doc_id).encode()) % folds != 0


@dataclass
class Grams:
    """The n-grams of a chunk, by those orders that were asked for: ascending keys; of each the numbers of its prefix and suffix one order below, if that was asked for too."""

    keys: dict[int, np.ndarray]
    prefix: dict[int, np.ndarray]
    suffix: dict[int, np.ndarray]
    token: dict[int, np.ndarray]  # number of the n-gram that ends at each token
    doc: np.ndarray


def grams_of(chunk: Chunk, order: int, orders: Collection[int]) -> Grams:
    reusing()
    words = words_of(lowered(chunk.texts))
    n, pad = len(chunk.ids), order - 1
    size = np.diff(words.first) + order  # with the marks before and the one after
    first = np.cumsum(size) - size
    x = np.full(int(size.sum()), BEGIN, np.uint64)
    x[first[words.doc] + pad + np.arange(len(words.hash)) - words.first[words.doc]] = words.hash
    x[first + size - 1] = END
    doc = np.repeat(np.arange(n), size)
    offset = np.arange(len(x)) - first[doc]
    token = np.flatnonzero(offset >= pad)
    keys, prefix, suffix, tokens = {}, {}, {}, {}
    h, below = x, None
    for k in range(1, max(orders) + 1):
        if k > 1:
            h = np.concatenate([h[:1], mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + x[1:] + np.uint64(k))])
        if k not in orders:
            below = None
            continue
        at = token if k == order else np.flatnonzero(offset >= k - 1)
        by_key = np.argsort(h[at])
        ascending = h[at[by_key]]
        new = np.ones(len(at), bool)
        new[1:] = ascending[1:] != ascending[:-1]
        keys[k] = ascending[new]
        own = np.zeros(len(x), np.int32)
        own[at[by_key]] = np.cumsum(new, dtype=np.int32) - 1
        if below is not None:
            where = at[by_key[new]]
            prefix[k], suffix[k] = below[where - 1], below[where]
        tokens[k] = own[token]
        below = own
    return Grams(keys, prefix, suffix, tokens, doc[token])


def _planes(values: np.ndarray) -> np.ndarray:
    """The bytes of 8-byte numbers, first byte of all, second of all and so on: compressed, bytes that are zero take no place."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.ravel()


def _joined(planes: np.ndarray, kind: type) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(kind).ravel()


def _small(counts: np.ndarray) -> list[np.ndarray]:
    """Counts in one byte each, those from 255 on apart."""
    large = np.flatnonzero(counts >= 255)
    return [np.minimum(counts, 255).astype(np.uint8), _planes(counts[large].astype(np.int64))]


def _whole(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    out = small.astype(np.int64)
    out[small == 255] = _joined(large, np.int64)
    return out


def _squeezed(*arrays: np.ndarray) -> bytes:
    raw = pack(*arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unsqueezed(payload: bytes) -> list[np.ndarray]:
    return unpack(pa.decompress(payload[8:], int.from_bytes(payload[:8], "little"), "zstd", asbytes=True))


def _lessened(columns: Sequence[np.ndarray]) -> Sequence[np.ndarray]:
    """Columns with the least that the kinds of followers make up taken off the mass, which is mostly all of it."""
    return columns if len(columns) < 2 else [columns[MASS] - columns[ONE] - 2 * columns[TWO] - 3 * columns[MORE], *columns[1:]]


def _restored(packed: list[np.ndarray]) -> list[np.ndarray]:
    columns = [_whole(a, b) for a, b in zip(packed[::2], packed[1::2], strict=True)]
    return columns if len(columns) < 2 else [columns[MASS] + columns[ONE] + 2 * columns[TWO] + 3 * columns[MORE], *columns[1:]]


def _asked(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Ascending keys as differences, byte by byte of all of them, so that zero bytes lie together; and counts."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return _squeezed(_planes(steps), *(y for c in _lessened(columns) for y in _small(c)))


def _read(payload: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    planes, *rest = _unsqueezed(payload)
    return np.cumsum(_joined(planes, np.uint64), dtype=np.uint64), _restored(rest)


def _answer(level: int, columns: list[np.ndarray], own: np.ndarray) -> bytes:
    return bytes([level]) + _squeezed(np.packbits(own), *(y for c in _lessened(columns) for y in _small(c)))


def _answers(level: int, answers: list[tuple[int, bytes]]) -> tuple[list[np.ndarray], np.ndarray]:
    """(columns, own) for all keys of a chunk at a level; answers are in shard order, so in order of the keys."""
    parts = []
    for _, p in answers:
        if p[0] == level:
            bits, *rest = _unsqueezed(p[1:])
            columns = _restored(rest)
            parts.append((columns, np.unpackbits(bits, count=len(columns[0])).astype(bool)))
    return [np.concatenate(c) for c in zip(*(p[0] for p in parts), strict=True)], np.concatenate([p[1] for p in parts])


def _sent(level: int, g: Grams, shards: int, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    keys = g.keys[level]
    cuts = shard_cuts(keys, shards)
    for s in range(shards):
        a, b = cuts[s], cuts[s + 1]
        if a < b:
            yield s, _asked(keys[a:b], *(c[a:b] for c in columns))


def _learned(chunk: Chunk, g: Grams, folds: int) -> np.ndarray:
    """Which tokens are learned from."""
    return np.array([in_training(i, k, folds) for i, k in zip(chunk.ids.tolist(), chunk.known.tolist(), strict=True)], bool)[g.doc]


def _top(order: int, shards: int, folds: int):
    def fn(chunk: Chunk) -> Iterator[tuple[int, bytes]]:
        g = grams_of(chunk, order, [order])
        counts = np.bincount(g.token[order][_learned(chunk, g, folds)], minlength=len(g.keys[order]))
        yield from _sent(order, g, shards, [counts])

    return fn


def _down(level: int, order: int, shards: int, folds: int):
    """What a chunk knows for the order below ``level`` from the n-grams that it owns."""

    def fn(chunk: Chunk, answers: list[tuple[int, bytes]]) -> pa.Table:
        g = grams_of(chunk, order, [level - 1, level])
        columns, own = _answers(level, answers)
        count = columns[0] if level == order else columns[COUNT]
        own = own & (count > 0)
        context, n = g.prefix[level], len(g.keys[level - 1])
        kinds = [np.bincount(context[own & hit], minlength=n) for hit in (count == 1, count == 2, count > 2)]
        out = [np.bincount(context[own], count[own], n).astype(np.int64), *kinds, np.bincount(g.suffix[level][own], minlength=n)]
        if level == 2:
            out.append(np.bincount(g.token[1][_learned(chunk, g, folds)], minlength=n))
        rows = list(_sent(level - 1, g, shards, out))
        return pa.table({"shard": pa.array([r[0] for r in rows], pa.int32()), "chunk": pa.array([chunk.number] * len(rows), pa.int64()), "payload": pa.array([r[1] for r in rows], pa.binary())})

    return fn


def _histogram(counts: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, 3, 4 and more."""
    return np.bincount(np.minimum(counts[counts > 0], 5), minlength=6)[1:]


def _statistics(level: int, order: int, columns: list[np.ndarray]) -> bytes:
    count = columns[0] if level == order else columns[COUNT]
    words = columns[TOKENS] if level == 1 else count[:0]
    return pack(_histogram(count), np.array([count.sum(), (words > 0).sum(), words.sum()]))


def _reduce(level: int, order: int, folder: str | None):
    def fn(shard: int, chunks: list[int], payloads: list[bytes]) -> Iterator[tuple[int, bytes]]:
        reusing()
        parts = [_read(p) for p in payloads]
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        totals = [np.bincount(at, np.concatenate(c), len(keys)).astype(np.int64) for c in zip(*(c for _, c in parts), strict=True)]
        owner = np.empty(len(keys), np.int64)
        owner[at[::-1]] = np.arange(len(at))[::-1]  # the first that has it
        own = owner[at] == np.arange(len(at))
        start = 0
        for number, (k, _) in zip(chunks, parts, strict=True):
            mine = at[start : start + len(k)]
            yield number, _answer(level, [t[mine] for t in totals], own[start : start + len(k)])
            start += len(k)
        if folder:
            known = np.logical_or.reduce([t > 0 for t in totals])
            _store(folder, level, shard, keys[known], [t[known] for t in totals])
        yield -1, _statistics(level, order, totals)

    return fn


def discounts(n: np.ndarray) -> np.ndarray:
    """The discounts for counts 1, 2 and 3 or more from how many counts are 1, 2, 3 and 4.

    Where too few counts are there for the formula, what it can't give is
    k / 2; a discount stays within 0 and its count.
    """
    out = np.array([0.5, 1.0, 1.5])
    if n[0] > 0 and n[1] > 0:
        y = n[0] / (n[0] + 2 * n[1])
        for k in (1, 2, 3):
            if n[k - 1] > 0 and n[k] > 0:
                out[k - 1] = k - (k + 1) * y * n[k] / n[k - 1]
    return np.clip(out, 0, [1, 2, 3])


def _less(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.maximum(counts - np.concatenate([[0.0], d])[np.minimum(counts, 3)], 0)


@dataclass
class Totals:
    """What scoring needs of the whole corpus: the histogram of counts by order, from 1, bigram types, distinct training tokens, and their number."""

    histograms: list[np.ndarray]
    types: int
    vocabulary: int
    tokens: int


def _totals(levels: list[DataFrame]) -> Totals:
    histograms, sums = [], None
    for rows in levels:  # from order 1 up
        got = [unpack(bytes(r[0])) for r in rows.filter("chunk = -1").select("payload").collect()]  # a row per shard
        histograms.append(np.sum([g[0] for g in got], axis=0) if got else np.zeros(5, np.int64))
        if sums is None:
            sums = np.sum([g[1] for g in got], axis=0) if got else np.zeros(3, np.int64)
    return Totals(histograms, *(int(x) for x in sums))


def _score(order: int, totals: Totals, folds: int):
    d = [discounts(h[:4]) for h in totals.histograms]
    h = totals.histograms[0]
    rest = float(d[0] @ [h[0], h[1], h[2:].sum()] / totals.types) if totals.types else 1.0

    def fn(chunk: Chunk, answers: list[tuple[int, bytes]]) -> pa.Table:
        g = grams_of(chunk, order, range(1, order + 1))
        got = [_answers(k, answers)[0] for k in range(1, order + 1)]
        p = _less(got[0][COUNT], d[0]) / max(totals.types, 1) + rest / (totals.vocabulary + 1)
        for k in range(2, order + 1):
            context, below = g.prefix[k], got[k - 2]
            count = got[k - 1][COUNT if k < order else 0]
            mass = below[MASS][context]
            at = np.maximum(mass, 1)
            left = np.where(mass > 0, sum(d[k - 1][i] * below[ONE + i] for i in range(3))[context] / at, 1.0)
            p = _less(count, d[k - 1]) / at + left * p[g.suffix[k]]
        # a begin mark is nobody's word, so n-grams that end with one have no probability
        logp = np.log10(np.maximum(p, np.finfo(float).tiny))
        seen = got[0][TOKENS]
        word = g.token[1]
        base = np.log10((seen + 0.1) / (totals.tokens + 0.1 * (totals.vocabulary + 1)))
        n = len(chunk.ids)
        return pa.table({
            "doc_id": pa.array(chunk.ids, pa.int64(), mask=~chunk.known),
            "held_out": pa.array([k and not in_training(i, k, folds) for i, k in zip(chunk.ids.tolist(), chunk.known.tolist(), strict=True)], pa.bool_()),
            "n_tokens": pa.array(np.bincount(g.doc, minlength=n), pa.int64()),
            "n_known": pa.array(np.bincount(g.doc, (seen > 0)[word], n).astype(np.int64)),
            "train_tokens": pa.array(np.full(n, totals.tokens), pa.int64()),
            "base_score": np.bincount(g.doc, base[word], n),
            "score": np.bincount(g.doc, logp[g.token[order]], n),
        })

    return fn


def _counted(chunks: DataFrame, order: int, folds: int, folder: str | None = None) -> list[DataFrame]:
    """The answers and statistics of each order, from 1."""
    if order < 2:
        raise ValueError("the model has order 2 at least")
    shards = shards_for(chunks)
    levels = [materialize(reduce_shards(emit(chunks, _top(order, shards, folds)), _reduce(order, order, folder)), f"order-{order}")]
    for level in range(order, 1, -1):
        sent = with_answers(chunks, levels[0].filter("chunk >= 0"), _down(level, order, shards, folds), PAYLOAD)
        levels.insert(0, materialize(reduce_shards(sent, _reduce(level - 1, order, folder)), f"order-{level - 1}"))
    return levels


def _union(levels: list[DataFrame]) -> DataFrame:
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out.filter("chunk >= 0")


def score_documents(docs: DataFrame, folds: int = 10, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the text).

    Words are lower-cased (A-Z) runs of other than white space; each text ends
    with one end token, so a null or empty text has one token.  The model
    learns from documents whose CRC-32 isn't 0 modulo ``folds``; rows that
    repeat an id count as often as they occur.  With nothing to learn from,
    every token has probability 1 / (V + 1) with V = 0.  A row with a null id
    is scored, not learned from, and not held out.  Other columns are not
    read.  A worker holds a chunk of texts, or one longer text, at a time.
    """
    chunks = chunked(docs, id_col, text_col)
    levels = _counted(chunks, order, folds)
    return with_answers(chunks, _union(levels), _score(order, _totals(levels), folds), RESULT)


@dataclass
class Model:
    """A stored model: its folder, order, shards of the hash space, and totals."""

    folder: str
    order: int
    shards: int
    totals: Totals


def _local(folder: str) -> str:
    path = folder.removeprefix("file://")
    if "://" in path:
        raise ValueError("arrays are mapped from a folder in the file system of all workers")
    return path


def _store(folder: str, level: int, shard: int, keys: np.ndarray, columns: list[np.ndarray]) -> None:
    """One file per array; a second attempt of a task replaces the whole file of the first."""
    os.makedirs(folder, exist_ok=True)
    for name, a in (("keys", keys), *((str(i), c) for i, c in enumerate(columns))):
        part = f"{folder}/{level}-{shard}-{name}-{uuid.uuid4().hex}.part"
        with open(part, "wb") as file:
            np.save(file, a)
        os.replace(part, f"{folder}/{level}-{shard}-{name}.npy")


def train(docs: DataFrame, folder: str, folds: int = 10, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of :func:`score_documents` as sorted hash arrays and their columns of counts in ``folder``, one set of files per order and shard."""
    chunks = chunked(docs, id_col, text_col)
    levels = _counted(chunks, order, folds, _local(folder))
    return Model(_local(folder), order, shards_for(chunks), _totals(levels))


def score_texts(texts: DataFrame, model: Model, folds: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The result of :func:`score_documents` for texts that needn't be those that the model has learned.

    The n-grams of a chunk go to their shard, whose worker maps the shard's
    arrays and looks them up; nothing of the model is read besides.
    """
    chunks = chunked(texts, id_col, text_col)

    def ask(level: int) -> Callable[[Chunk], Iterator[tuple[int, bytes]]]:
        return lambda chunk: _sent(level, grams_of(chunk, model.order, [level]), model.shards, [])

    def look_up(level: int):
        width = 1 if level == model.order else COUNT + 1 + (level == 1)

        def fn(shard: int, numbers: list[int], payloads: list[bytes]) -> Iterator[tuple[int, bytes]]:
            base = f"{model.folder}/{level}-{shard}"
            there = os.path.exists(f"{base}-keys.npy")  # a shard that no n-gram of the corpus fell into has none
            keys = np.load(f"{base}-keys.npy", mmap_mode="r") if there else np.zeros(0, np.uint64)
            columns = [np.load(f"{base}-{i}.npy", mmap_mode="r") if there else np.zeros(0, np.int64) for i in range(width)]
            for number, p in zip(numbers, payloads, strict=True):
                want, _ = _read(p)
                at = np.searchsorted(keys, want)
                at[at == len(keys)] = 0
                hit = keys[at] == want if len(keys) else np.zeros(len(want), bool)
                yield number, _answer(level, [np.where(hit, c[at], 0) if len(keys) else np.zeros(len(want), np.int64) for c in columns], hit)

        return fn

    levels = [materialize(reduce_shards(emit(chunks, ask(k)), look_up(k)), f"found-{k}") for k in range(1, model.order + 1)]
    return with_answers(chunks, _union(levels), _score(model.order, model.totals, folds), RESULT)
