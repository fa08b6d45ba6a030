"""Files to chunks: by heading or by size, with frontmatter, tags and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import byte_slice, links, trim


def by_heading(files: DataFrame) -> DataFrame:
    """(file, ord, title, body): a new section at each line that starts with "## " outside a fence.

    Lines that begin with ``` or ~~~, blanks aside, open and close fences; an
    open one lasts to the end.  The first title is the file's base name;
    sections with an empty body are dropped.
    """
    lines = files.select("file", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    order = Window.partitionBy("file").orderBy("pos")
    fence = trim(F.col("line")).rlike("^(```|~~~)").cast("int")
    inside = F.coalesce(F.sum(fence).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2 == 1
    head = F.col("line").startswith("## ") & ~inside
    rows = lines.withColumn("head", head).withColumn("section", F.sum(F.col("head").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    base = F.regexp_replace(F.regexp_replace("file", r"^.*/", ""), r"(?s)^(.+)\.[^.]*$", "$1")
    parts = rows.groupBy("file", "section").agg(
        F.max(F.when(F.col("head"), F.substring("line", 4, 1 << 30))).alias("named"),
        F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("pos", "line")))).alias("kept"),
    )
    parts = parts.withColumn("body", trim(F.array_join(F.transform("kept", lambda x: x["line"]), "\n"))).filter("body <> ''")
    numbered = F.row_number().over(Window.partitionBy("file").orderBy("section")) - 1
    return parts.select("file", numbered.alias("ord"), F.when(F.col("section") == 0, base).otherwise(F.col("named")).alias("title"), "body")


def by_size(files: DataFrame, size: int = 500, overlap: int = 100) -> DataFrame:
    """(file, ord, title, body): windows of ``size`` bytes that overlap; empty ones are dropped and not numbered."""
    size = size if size > 0 else 500
    overlap = max(overlap, 0)
    overlap = size // 2 if overlap >= size else overlap
    step = size - overlap
    n = F.octet_length("text")
    # the first window that reaches the end is the last
    last = F.greatest(F.ceil((n - size) / step), F.lit(0)) * step
    rows = files.filter(n > 0).select("file", "text", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(step).cast("long"))).alias("at"))
    rows = rows.select("file", "at", trim(byte_slice(F.col("text"), (F.col("at") + 1).cast("int"), size)).alias("body")).filter("body <> ''")
    number = F.row_number().over(Window.partitionBy("file").orderBy("at"))
    return rows.select("file", (number - 1).alias("ord"), F.concat(F.lit("chunk-"), number.cast("string")).alias("title"), "body")


def with_frontmatter(sections: DataFrame, front: DataFrame) -> DataFrame:
    """Title and aliases of (file, fm_title, aliases, tags) go to the first section, tags to all; links are found in the body."""
    rows = sections.join(front, "file", "left")
    title = F.when((F.col("ord") == 0) & (F.coalesce("fm_title", F.lit("")) != ""), F.col("fm_title")).otherwise(F.col("title"))
    aliases = F.when((F.col("ord") == 0) & (F.coalesce(F.size("aliases"), F.lit(0)) > 0), F.concat(F.lit(" · aliases: "), F.array_join("aliases", ", "))).otherwise("")
    return rows.select("file", "ord", F.concat(title, aliases).alias("title"), "body", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), links(F.col("body")).alias("links"))


def length_limited(chunks: DataFrame, least: int = 0, most: int = 0) -> DataFrame:
    """Without bodies of fewer than ``least`` bytes, and with those over ``most`` bytes cut; 0 is no limit."""
    if least > 0:
        chunks = chunks.filter(F.octet_length("body") >= least)
    return chunks.withColumn("body", byte_slice(F.col("body"), 1, most)) if most > 0 else chunks


def embedding_text(title: Column, body: Column, most: int = 1500) -> Column:
    return byte_slice(F.concat(title, F.lit("\n"), body), 1, most)
