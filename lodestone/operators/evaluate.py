"""Retrieval metrics and tuning over labelled queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import tokens
from lodestone.operators.index import Index
from lodestone.sources.tables import SMALL_ROWS, small, stored

METRICS = ("hit_rate", "mrr", "recall", "precision")


def relevant(file: Column, title: Column, label: Column, is_title: Column) -> Column:
    """A file label equals the file, whatever the case, or ends it; a title label equals the title."""
    return F.when(is_title, F.lower(title) == F.lower(label)).otherwise((F.lower(file) == F.lower(label)) | F.endswith(file, label))


def query_metrics(results: DataFrame, labels: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """hit_rate, mrr, recall and precision of each query.

    ``results`` has query_id, rank, file and title (and the ``by`` columns),
    ``labels`` query_id, label and is_title.  Queries without results count 0.
    """
    keys = [*by, "query_id"]
    hit = results.join(labels, "query_id").filter(relevant(F.col("file"), F.col("title"), F.col("label"), F.col("is_title")))
    hits = hit.groupBy(*keys).agg(F.min("rank").alias("first"), F.countDistinct("label", "is_title").alias("got"), F.countDistinct("rank").alias("rows"))
    shown = results.groupBy(*keys).agg(F.count("*").alias("shown"))
    total = labels.groupBy("query_id").agg(F.countDistinct("label", "is_title").alias("total"))
    base = results.select(*by).distinct().crossJoin(total) if by else total
    rows = base.join(shown, keys, "left").join(hits, keys, "left")
    return rows.select(
        *keys,
        F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0).alias("hit_rate"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.col("got") / F.col("total"), F.lit(0.0)).alias("recall"),
        F.coalesce(F.col("rows") / F.col("shown"), F.lit(0.0)).alias("precision"),
    )


def holders(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_id) of the chunks that hold a query's whole text word for word, with a line end between title and body.

    The rarest of a text's tokens, its first and last aside as they can be
    parts of longer ones, finds the chunks to compare it with.  Texts of fewer
    than three tokens are compared with every chunk, those that the corpus
    lacks a token of with none.  Few such pairs are sent to the texts, so that
    these aren't shuffled.  The index must not be stemmed.
    """
    if index.stem:
        raise ValueError("stems don't tell which words a chunk holds")
    words = queries.withColumn("w", tokens(F.col("query")))
    inner = words.select("query_id", "query", F.explode(F.array_distinct(F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0))))).alias("term"))
    rare = inner.join(index.df, "term", "left").groupBy("query_id", "query").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), F.col("term"))).alias("term"))
    rare = small(stored(rare.select("query_id", F.xxhash64("query").alias("of"), "term"), "rare"))
    pairs = small(stored(index.posts.select("term", "chunk_id").join(rare, "term").select("query_id", "of", "chunk_id"), "pairs"))
    asked = small(stored(queries.select("query_id", F.xxhash64("query").alias("of"), "query").distinct(), "asked"), SMALL_ROWS // 20)
    text = index.chunks.select("chunk_id", F.concat("title", F.lit("\n"), "body").alias("text"))
    short = words.filter(F.size("w") < 3).select("query_id", "query")
    found = text.join(pairs, "chunk_id").join(asked, ["query_id", "of"]).select("query_id", "query", "chunk_id", "text").unionByName(short.crossJoin(text))
    return found.filter(F.contains("text", F.col("query"))).select("query_id", "chunk_id")


def mean_metrics(metrics: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return metrics.groupBy(*by).agg(*[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in METRICS])


def objective(name: str) -> Column:
    return F.col("hit_rate") + 0.001 * F.col("mrr") if name == "hit_rate" else F.col("mrr")


def best_trial(means: DataFrame, name: str = "hit_rate") -> DataFrame:
    """The trial with the largest objective, the earliest of equals."""
    scored = means.withColumn("objective", F.round(objective(name), 12))
    return scored.agg(F.max_by("trial", F.struct("objective", -F.col("trial"))).alias("trial"), F.max("objective").alias("objective"))
