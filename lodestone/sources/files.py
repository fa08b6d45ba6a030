"""Directories of text files, their frontmatter, and labelled question sets."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.config import IndexConfig
from lodestone.functions.text import wanted
from lodestone.operators import chunking
from lodestone.sources.tables import stored


def read_directory(spark: SparkSession, root: str, include: tuple[str, ...] = ("*.md", "*.markdown", "*.txt"), exclude: tuple[str, ...] = ()) -> DataFrame:
    """(file, text): files below ``root`` whose path from there the globs want; what isn't UTF-8 becomes U+FFFD."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/")
    path = F.regexp_replace("path", r"^[a-z0-9]+:/*", "/")
    rows = rows.select(F.substring(path, len(base) + 2, 1 << 30).alias("file"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return rows.filter(wanted(F.col("file"), include, exclude))


def parse_frontmatter(text: str) -> tuple[str, list[str], list[str], str]:
    """(title, aliases, tags, rest); without a closed and well-formed block, nothing and the whole text."""
    none = ("", [], [], text)
    head = next((h for h in ("---\r\n", "---\n") if text.startswith(h)), None)
    if head is None:
        return none
    end = text.find("\n---", len(head))
    if end < 0:
        return none
    import yaml

    try:
        found = yaml.load(text[len(head) : end], Loader=yaml.BaseLoader)
    except yaml.YAMLError:
        return none
    found = {} if found is None or found == "" else found
    if not isinstance(found, dict):
        return none
    title, aliases, tags = found.get("title", ""), found.get("aliases") or [], found.get("tags") or []
    if not isinstance(title, str) or not isinstance(aliases, list) or not isinstance(tags, list):
        return none
    rest = text[end + 4 :]
    rest = rest[2:] if rest.startswith("\r\n") else rest[1:] if rest.startswith("\n") else rest
    return title.strip(), [str(a).strip() for a in aliases], [str(t).strip().lower() for t in tags], rest


def frontmatter(files: DataFrame) -> DataFrame:
    """(file, text, fm_title, aliases, tags): the text without its block."""

    @F.pandas_udf("struct<fm_title:string,aliases:array<string>,tags:array<string>,text:string>")
    def run(texts):
        import pandas as pd

        return pd.DataFrame([parse_frontmatter(t or "") for t in texts], columns=["fm_title", "aliases", "tags", "text"])

    return files.select("file", run("text").alias("f")).select("file", "f.text", "f.fm_title", "f.aliases", "f.tags")


def chunk_files(files: DataFrame, cfg: IndexConfig) -> DataFrame:
    """chunk_id, file, ord, title, body, tags, links of (file, text): in order of path, component by component, then section."""
    none = F.array().cast("array<string>")
    parsed = frontmatter(files) if cfg.parse_frontmatter else files.select("file", "text", F.lit("").alias("fm_title"), none.alias("aliases"), none.alias("tags"))
    cut = chunking.by_size(parsed, cfg.chunk_size, cfg.chunk_overlap) if cfg.chunk_strategy == "size" else chunking.by_heading(parsed)
    rows = chunking.length_limited(chunking.with_frontmatter(cut, parsed.drop("text")), cfg.min_chunk_chars, cfg.max_chunk_chars)
    ordered = stored(rows.repartitionByRange(F.split("file", "/"), "ord").sortWithinPartitions(F.split("file", "/"), "ord").select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), "*"), "ordered")
    parts = ordered.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per partition
    offsets = parts.select("part", (before - F.col("first")).alias("offset"))
    return ordered.join(F.broadcast(offsets), "part").select((F.col("at") + F.col("offset")).alias("chunk_id"), *rows.columns)


def read_eval_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(queries, labels) of a JSON file; no query, an empty one, or one without labels is an error."""
    found = json.loads(Path(path).read_text()).get("queries") or []
    if not found:
        raise ValueError("no queries")
    queries, labels = [], []
    for i, q in enumerate(found):
        files, titles = q.get("relevant_files") or [], q.get("relevant_titles") or []
        if not q.get("query", "").strip() or not files and not titles:
            raise ValueError(f"query {i} needs a text and labels")
        queries.append((i, q["query"]))
        labels += [(i, x, False) for x in files] + [(i, x, True) for x in titles]
    return spark.createDataFrame(queries, "query_id long, query string"), spark.createDataFrame(labels, "query_id long, label string, is_title boolean")
