"""One-hop link expansion of search results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import link_key


def expand(results: DataFrame, chunks: DataFrame, most: int) -> DataFrame:
    """(query_id, chunk_id, rank, score, linked_from) with up to ``most`` rows added to each query.

    The links of the results are followed in order of rank and place to the
    first chunk of the file they name; files that a query already has are
    skipped.  Added rows have score 0 and ranks after the others.
    """
    found = results.join(chunks.select("chunk_id", "file", "links"), "chunk_id")
    plain = found.select("query_id", "chunk_id", "rank", "score", F.lit(None).cast("string").alias("linked_from"))
    if most <= 0:
        return plain
    first = chunks.groupBy(link_key(F.col("file")).alias("key")).agg(F.min("chunk_id").alias("target"))
    asked = found.select("query_id", "rank", "file", F.posexplode("links").alias("pos", "key"))
    hits = asked.join(first, "key").join(found.select("query_id", link_key(F.col("file")).alias("key")), ["query_id", "key"], "left_anti")
    once = hits.groupBy("query_id", "target").agg(F.min(F.struct("rank", "pos", "file")).alias("m"))
    order = Window.partitionBy("query_id").orderBy("m.rank", "m.pos")
    added = once.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most)
    after = plain.groupBy("query_id").agg(F.max("rank").alias("last"))
    added = added.join(after, "query_id").select("query_id", F.col("target").alias("chunk_id"), (F.col("last") + F.col("r")).alias("rank"), F.lit(0.0).alias("score"), F.col("m.file").alias("linked_from"))
    return plain.unionByName(added)
