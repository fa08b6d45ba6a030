"""The inverted index: postings, document frequencies and lengths of a chunk table, with the vectors that belong to it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.stem import stemmed_vocabulary
from lodestone.functions.text import tokens
from lodestone.operators import ivf as ivf_

SCHEMA_VERSION = 3
#: Tokens that a worker counts at once; a batch of more is counted run by run.
COUNT_TOKENS = 1 << 18
#: Postings of a run in order of term.
RUN_POSTINGS = 1 << 20


def tokenized(chunks: DataFrame) -> DataFrame:
    """chunk_id, title and body tokens, and doc_len, the number of both."""
    t, b = tokens(F.col("title")), tokens(F.col("body"))
    return chunks.select("chunk_id", t.alias("t"), b.alias("b")).withColumn("doc_len", F.size("t") + F.size("b"))


def pieces(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs (start, stop) of rows whose sizes add up to ``most`` at most; a larger row is a run of its own."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), "right")))
        yield at, stop
        at = stop


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(chunks, lengths, row, terms, tf, title_tf) in order of row and term, for a bounded number of tokens at once, as (row, token number) pairs.

    The order of terms makes sums over equal texts equal to the last bit.
    """
    for batch in batches:
        for at, stop in pieces(batch.column(1).to_numpy(), COUNT_TOKENS):
            chunk, length, title, body = batch.slice(at, stop - at).columns
            rows = [np.repeat(np.arange(stop - at), np.diff(x.offsets.to_numpy())) for x in (title, body)]
            words = pa.concat_arrays([title.flatten(), body.flatten()]).dictionary_encode()
            order = pc.sort_indices(words.dictionary).to_numpy()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            n = max(len(order), 1)
            key = np.concatenate(rows) * n + place[words.indices.to_numpy()]
            found, where, tf = np.unique(key, return_inverse=True, return_counts=True)
            in_title = np.bincount(where[: len(rows[0])], minlength=len(found))
            yield chunk, length, found // n, words.dictionary.take(pa.array(order[found % n])), tf, in_title


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens to postings."""
    for chunk, length, row, terms, tf, in_title in _tallied(batches):
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays([terms, chunk.take(at), pa.array(tf.astype(np.int64)), pa.array(in_title.astype(np.int64)), length.take(at)], names=["term", "chunk_id", "tf", "title_tf", "doc_len"])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens to one row for each chunk, with its terms and their counts."""
    for chunk, length, row, terms, tf, in_title in _tallied(batches):
        ends = pa.array(np.searchsorted(row, np.arange(len(chunk) + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, x) for x in (terms, pa.array(tf.astype(np.int32)), pa.array(in_title.astype(np.int32)))]
        yield pa.RecordBatch.from_arrays([chunk, length, *lists], names=["chunk_id", "doc_len", "terms", "tf", "title_tf"])


def _invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of :func:`forward` to postings, run by run in order of term and chunk."""
    for batch in batches:
        sizes = np.diff(batch.column("terms").offsets.to_numpy())
        for at, stop in pieces(sizes, RUN_POSTINGS):
            part = batch.slice(at, stop - at)
            words = part.column("terms").flatten().dictionary_encode()
            place = np.empty(len(words.dictionary), np.int64)
            place[pc.sort_indices(words.dictionary).to_numpy()] = np.arange(len(place))
            row = np.repeat(np.arange(stop - at), sizes[at:stop])
            code = words.indices.to_numpy()
            chunk = part.column("chunk_id").to_numpy(zero_copy_only=False)[row]
            order = np.lexsort((chunk, place[code]))
            rows = pa.array(row[order])
            counts = [pa.array(part.column(n).flatten().to_numpy()[order].astype(np.int64)) for n in ("tf", "title_tf")]
            yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(code[order])), part.column("chunk_id").take(rows), *counts, part.column("doc_len").take(rows)], names=["term", "chunk_id", "tf", "title_tf", "doc_len"])


def _mapped(chunks: DataFrame, run, schema: str) -> DataFrame:
    rows = tokenized(chunks)
    return rows.select("chunk_id", "doc_len", "t", "b").mapInArrow(run, schema.format(rows.schema["chunk_id"].dataType.simpleString()))


def postings(chunks: DataFrame, stem: bool = False) -> DataFrame:
    """(term, chunk_id, tf, title_tf, doc_len): tf counts title and body.

    Tokens are counted where they are, batch by batch, so nothing is shuffled;
    with ``stem`` the rows of a chunk's words with one stem are added up.
    """
    rows = _mapped(chunks, _count, "term string, chunk_id {}, tf long, title_tf long, doc_len int")
    if not stem:
        return rows
    rows = rows.join(stemmed_vocabulary(rows), "term")
    return rows.groupBy(F.col("stem").alias("term"), "chunk_id").agg(F.sum("tf").alias("tf"), F.sum("title_tf").alias("title_tf"), F.first("doc_len").alias("doc_len"))


def forward(chunks: DataFrame, stem: bool = False) -> DataFrame:
    """(chunk_id, doc_len, terms, tf, title_tf): the postings chunk by chunk, a chunk without tokens included."""
    if not stem:
        return _mapped(chunks, _gather, "chunk_id {}, doc_len int, terms array<string>, tf array<int>, title_tf array<int>")
    x = F.col("x")
    lists = postings(chunks, True).groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("term", F.col("tf").cast("int").alias("tf"), F.col("title_tf").cast("int").alias("title_tf")))).alias("x"))
    rows = tokenized(chunks).select("chunk_id", "doc_len").join(lists, "chunk_id", "left")
    return rows.select("chunk_id", "doc_len", *[F.coalesce(x[a], F.array().cast(f"array<{kind}>")).alias(b) for a, b, kind in (("term", "terms", "string"), ("tf", "tf", "int"), ("title_tf", "title_tf", "int"))])


def term_df(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def length_stats(chunks: DataFrame) -> DataFrame:
    """One row: n_chunks, total_len, avg_dl (0 without chunks); chunks without tokens count."""
    out = tokenized(chunks).agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum("doc_len"), F.lit(0)).cast("long").alias("total_len"))
    return out.withColumn("avg_dl", F.when(F.col("n_chunks") > 0, F.col("total_len") / F.col("n_chunks")).otherwise(0.0))


@dataclass
class Index:
    """A built index: tables to be searched any number of times; vectors (chunk_id, vec) and IVF where there are some."""

    chunks: DataFrame
    posts: DataFrame
    df: DataFrame
    stats: DataFrame
    stem: bool = False
    model: str = "none"
    vectors: DataFrame | None = None
    ivf: ivf_.IVF | None = None
    forward: DataFrame | None = None

    def save(self, path: str) -> None:
        """Postings are in runs in order of term, so that a search reads few pages; vectors that lie in the IVF lists aren't written twice.

        The postings lie there chunk by chunk as well, for searches of many
        queries.  These are written first and all else is counted from them,
        so that texts are cut into tokens once.  Runs are sorted where their
        chunks are read, so that the postings aren't shuffled.
        """
        spark = self.chunks.sparkSession
        self.chunks.write.mode("overwrite").parquet(f"{path}/chunks")
        (forward(self.chunks, self.stem) if self.forward is None else self.forward).write.mode("overwrite").parquet(f"{path}/forward")
        by_chunk = spark.read.parquet(f"{path}/forward")
        stats = by_chunk.agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum("doc_len"), F.lit(0)).cast("long").alias("total_len"))
        kind = by_chunk.schema["chunk_id"].dataType.simpleString()
        by_chunk.mapInArrow(_invert, f"term string, chunk_id {kind}, tf long, title_tf long, doc_len int").write.mode("overwrite").parquet(f"{path}/postings")
        term_df(spark.read.parquet(f"{path}/postings")).write.mode("overwrite").parquet(f"{path}/term_df")
        meta = stats.withColumns({
            "avg_dl": F.when(F.col("n_chunks") > 0, F.col("total_len") / F.col("n_chunks")).otherwise(0.0),
            "schema_version": F.lit(SCHEMA_VERSION), "stem": F.lit(self.stem), "model": F.lit(self.model),
            "has_vectors": F.lit(self.vectors is not None), "has_ivf": F.lit(self.ivf is not None),
        })
        meta.write.mode("overwrite").parquet(f"{path}/index_meta")
        if self.ivf is not None:
            self.ivf.save(f"{path}/ivf")
        elif self.vectors is not None:
            self.vectors.select("chunk_id", "vec").write.mode("overwrite").parquet(f"{path}/vectors")


def build(chunks: DataFrame, stem: bool = False) -> Index:
    posts = postings(chunks, stem)
    return Index(chunks, posts, term_df(posts), length_stats(chunks), stem, forward=forward(chunks, stem))


def load(spark: SparkSession, path: str) -> Index:
    """A saved index, with its vectors or IVF; one of another version, or whose parts disagree or are missing, is an error."""
    part = {n: spark.read.parquet(f"{path}/{n}") for n in ("chunks", "forward", "postings", "term_df", "index_meta")}
    meta = part["index_meta"].first()
    if meta is None or meta["schema_version"] != SCHEMA_VERSION:
        raise ValueError("unsupported index version")
    if part["chunks"].count() != meta["n_chunks"]:
        raise ValueError("the index holds another number of chunks than its metadata says")
    ivf = ivf_.load(spark, f"{path}/ivf") if meta["has_ivf"] else None
    vectors = ivf.lists.select("chunk_id", "vec") if ivf else spark.read.parquet(f"{path}/vectors") if meta["has_vectors"] else None
    return Index(part["chunks"], part["postings"], part["term_df"], part["index_meta"].select("n_chunks", "total_len", "avg_dl"), meta["stem"], meta["model"], vectors, ivf, part["forward"])
