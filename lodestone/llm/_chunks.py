"""Documents in chunks, and the exchange between chunks and shards of a hash space.

The costly part of a corpus-wide hash operator is a row per word or window.
Here one row carries a chunk of documents (about ``CHUNK_BYTES`` of text), and
what a chunk has for a shard of the hash space travels as one packed array:

    chunks --emit--> (shard, chunk, payload) --reduce by shard--> (chunk, payload) --cogroup by chunk--> rows

Each chunk sends a hash once, however often it has it, so a hot word, passage
or group of copies gives a shard at most one entry per chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._spark import materialize
from lodestone.llm._tokens import Texts, lean, texts_of, trimmed

CHUNK_BYTES = 2 << 20
SHARD_BYTES = 8 << 20
#: Documents of a chunk at most, so that (chunk << 16) | position numbers every row.
CHUNK_DOCS = 1 << 15
PAYLOAD = "shard int, chunk bigint, payload binary"


class Chunk(NamedTuple):
    """Documents of a chunk; ids are 0 where ``known`` is false (the id is null)."""

    number: int
    ids: np.ndarray
    known: np.ndarray
    texts: Texts
    column: pa.Array


def _blob(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_chunk(number: int, blob: bytes) -> Chunk:
    table = pa.ipc.open_stream(blob).read_all()
    ids, text = table.column("doc_id").combine_chunks(), table.column("text").combine_chunks()
    ids, text = (x if isinstance(x, pa.Array) else pa.concat_arrays(x.chunks) for x in (ids, text))
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    return Chunk(number, ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), known, texts_of(text), text)


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(chunk long, n_docs long, n_bytes long, blob binary), written to the shared folder.

    A chunk ends with the document that brings it to ``chunk_bytes``, or to
    ``CHUNK_DOCS`` documents.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lean()
        part, seq = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = n = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, held, size, n
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()
            joined = whole[0] if len(whole) == 1 else pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(i) for b in whole]) for i in range(2)], names=["doc_id", "text"])
            row = [[(part << 24) | seq], [joined.num_rows], [size], [_blob(joined)]]
            seq, held, size, n = seq + 1, [], 0, 0
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["chunk", "n_docs", "n_bytes", "blob"])

        for batch in batches:
            ends = texts_of(batch.column("text")).offsets
            at = 0
            while at < batch.num_rows:
                stop = int(np.searchsorted(ends, ends[at] + chunk_bytes - size, "left"))
                stop = min(max(stop, at + 1), batch.num_rows, at + CHUNK_DOCS - n)
                held.append(batch.slice(at, stop - at))
                size += int(ends[stop] - ends[at])
                n += stop - at
                at = stop
                if size >= chunk_bytes or n >= CHUNK_DOCS:
                    yield flush()
        if held:
            yield flush()
        trimmed()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return materialize(rows.mapInArrow(build, "chunk bigint, n_docs bigint, n_bytes bigint, blob binary"), "chunks")


def shards_for(chunks: DataFrame, bytes_per_shard: int = SHARD_BYTES) -> int:
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(12, -(-total // bytes_per_shard))


def payload_rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    shard, chunk, payload = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(chunk, pa.int64()), pa.array(payload, pa.binary())], names=["shard", "chunk", "payload"])


def emit(chunks: DataFrame, fn: Callable[[Chunk], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """(shard, chunk, payload) of what ``fn`` gives for each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for number, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob"), strict=True):
                chunk = read_chunk(number, blob.as_buffer())
                yield payload_rows([(s, number, p) for s, p in fn(chunk)])
        trimmed()

    return chunks.select("chunk", "blob").mapInArrow(run, PAYLOAD)


def reduce_shards(payloads: DataFrame, fn: Callable[[int, list[int], list[bytes]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """(shard, chunk, payload) of what ``fn(shard, chunk numbers, payloads)`` sends back to chunks."""

    def run(group: pa.Table) -> pa.Table:
        lean()
        shard = group.column("shard")[0].as_py()
        order = np.argsort(group.column("chunk").to_numpy(), kind="stable")
        group = group.take(pa.array(order))
        back = fn(shard, group.column("chunk").to_pylist(), group.column("payload").to_pylist())
        return pa.Table.from_batches([payload_rows([(shard, c, p) for c, p in back])])

    return payloads.groupBy("shard").applyInArrow(run, PAYLOAD)


def with_answers(chunks: DataFrame, answers: DataFrame, fn: Callable[[Chunk, list[tuple[int, bytes]]], pa.Table], schema: str) -> DataFrame:
    """``fn(chunk, answers)`` for each chunk, with the (shard, payload) answers sent to it in shard order."""

    def run(own: pa.Table, sent: pa.Table) -> pa.Table:
        lean()
        if not own.num_rows:
            raise ValueError("an answer was sent to a chunk that does not exist")
        got = sorted(zip(sent.column("shard").to_pylist(), sent.column("payload").to_pylist(), strict=True), key=lambda x: x[0])
        return pa.concat_tables([fn(read_chunk(number, blob.as_buffer()), got) for number, blob in zip(own.column("chunk").to_pylist(), own.column("blob"), strict=True)])

    return chunks.select("chunk", "blob").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)
