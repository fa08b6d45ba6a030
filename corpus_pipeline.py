"""Corpus pipeline: documents in, training mix out, each stage on what the one before has kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, jaccard_join, language_id, mixing, secrets
from lodestone.llm._spark import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, that is without letters or text, go."""
    model = language_id.train(docs)
    return language_id.predict(docs.select(*COLUMNS), model).filter(F.col("lang_pred") != language_id.UNKNOWN).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows that links of similarity 0.75 or more connect, the one with the least id stays, null ids last.

    Rows go by a hash of all their columns, as ids can be null or repeated: of
    rows that share an id and link with nothing, each stays.  Rows without
    words link with nothing.
    """
    rows = docs.select(F.xxhash64(*[F.col(c).isNull() for c in COLUMNS], *COLUMNS).alias("row"), *COLUMNS)
    found = jaccard_join.jaccard_components(rows, id_col="row").select(F.col("doc_id").alias("row"), "component_id", (F.col("n_shingles") > 0).alias("linked")).distinct()
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    leaders = found.filter("linked").join(rows.select("row", "doc_id").distinct(), "row").groupBy("component_id").agg(F.min_by("row", rank).alias("row"))
    once = rows.join(leaders.select("row"), "row", "left_semi").dropDuplicates(["row"])
    return once.unionByName(rows.join(found.filter("not linked").select("row"), "row", "left_semi")).select(*COLUMNS)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of 10 words of a benchmark item go."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), n=10, mode="documents")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become a mark in the text; the document stays, with its new length."""
    return secrets.redact_secrets(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks, with the number of the copy."""
    return mixing.emit_copies(mixing.mix(docs.select(*COLUMNS)))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", remove_benchmark),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs


#: Language identification, redaction of decoded layers and the links have no SQL here; tests hold the stages against brute force.
ORACLE_SQL = None
