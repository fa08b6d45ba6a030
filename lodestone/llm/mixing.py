"""Mixing sources to target weights, in DataFrame functions only.

Sizes are summed per source, weights turned into targets by water-filling
under a cap, targets into repetition rates, and each document is taken
floor(rate) times plus one hash-seeded Bernoulli copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._spark import broadcast_if_small

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, cap: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources take ``weights`` in turn, by code point, null last.  Targets share
    ``share`` of the total; none exceeds ``cap`` times its source's size, the
    excess being shared among the others by weight.  With the ratio
    cap * size / weight in ascending order the capped sources are a prefix, so
    one running sum finds the common level of the others.
    """
    in_turn = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(in_turn) - 1, F.lit(len(weights))) + 1).cast("int"))
    w = sizes.withColumn("weight", weight).withColumn("most", F.lit(cap) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy(F.lit(1))
    level = (F.lit(share) * F.sum("source_size").over(everywhere) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    w = w.withColumn("level", level)
    # the first source that the level of the remaining ones doesn't fill sets it for all after it
    free = F.min(F.when(F.col("most") / F.col("weight") > F.col("level"), F.struct((F.col("most") / F.col("weight")).alias("ratio"), F.col("level")))).over(everywhere)
    w = w.withColumn("free", free)
    target = F.when(F.col("free").isNull() | (F.col("most") <= F.col("weight") * F.col("free.level")), F.col("most")).otherwise(F.col("weight") * F.col("free.level"))
    return w.select("source", "source_size", target.alias("target"))


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone: the first 48 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, cap: float = 3.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """All columns of ``docs`` in a struct ``doc``, with size, source_size, target and copies (long).

    A document is taken floor(target / source_size) times, and once more when
    a draw from its id is under the fraction; rows that repeat an id draw
    alike.  Null or empty text has size 0; a source of size 0 has target 0 and
    its documents no copies.  A null source is a source of its own.
    """
    rows = docs.select(F.struct("*").alias("doc")).select("doc", word_count(F.col(f"doc.{text_col}")).alias("size"), F.col(f"doc.{source_col}").alias("source"))
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    targets = targets.withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    once_more = draw(F.col(f"doc.{id_col}"), seed) < rate - F.floor(rate)
    return rows.join(broadcast_if_small(targets), F.col("source").eqNullSafe(F.col("of"))).select("doc", "size", "source_size", "target", (F.floor(rate) + once_more.cast("long")).alias("copies"))


def emit_copies(mixed: DataFrame) -> DataFrame:
    """Each document ``copies`` times, with copy (int, from 1): the training mix itself."""
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*", F.col("copy").alias("mix_copy"))
