"""Results as text: a bounded context block, a numbered list, or JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import byte_slice

BODY_BYTES, BLOCK_BYTES = 1800, 6000


def shortened(body: Column, most: int = BODY_BYTES) -> Column:
    """A body over ``most`` bytes ends at its last blank line in the second half of them, else after them, with an ellipsis."""
    head = byte_slice(body, 1, most)
    cut = F.octet_length(F.substring_index(head, "\n\n", -1))
    at = F.octet_length(head) - cut - 2
    kept = F.when(at >= most // 2, byte_slice(head, 1, at.cast("int"))).otherwise(head)
    return F.when(F.octet_length(body) > most, F.concat(kept, F.lit("\n…"))).otherwise(body)


def context_block(results: DataFrame, most: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, block) in order of rank, as long as all blocks so far stay within ``most`` bytes."""
    block = F.concat(F.lit("### "), F.col("title"), F.lit(" ("), F.col("file"), F.lit(")\n"), shortened(F.col("body")), F.lit("\n\n"))
    so_far = F.sum(F.octet_length("block")).over(Window.partitionBy("query_id").orderBy("rank"))
    return results.withColumn("block", block).withColumn("bytes", so_far).filter(F.col("bytes") <= most).select("query_id", "rank", "block")


def human(results: DataFrame) -> DataFrame:
    """(query_id, rank, line); hybrid rows show both parts of their score, rows that links brought in say from where."""
    found = F.format_string("%d. %s — %s (%.3f)", "rank", "file", "title", "score")
    if {"semantic", "norm"} <= set(results.columns):
        both = F.format_string("%d. %s — %s (%.3f; semantic %.3f, bm25 %.3f)", "rank", "file", "title", "score", "semantic", "norm")
        found = F.when(F.col("norm").isNotNull(), both).otherwise(found)
    linked = F.format_string("%d. %s — %s (linked from %s)", "rank", "file", "title", "linked_from")
    return results.select("query_id", "rank", F.when(F.col("linked_from").isNull(), found).otherwise(linked).alias("line"))


def as_json(results: DataFrame) -> DataFrame:
    """(query_id, json): the rows of a query as an array in order of rank."""
    row = F.struct("rank", *[c for c in results.columns if c not in ("query_id", "rank")])
    return results.groupBy("query_id").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("json"))
