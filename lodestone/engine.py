"""Building an index from files, and answering and tuning with it: what the command line calls."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import NO_EMBEDDING_TITLE_BOOST, IndexConfig, QueryConfig, auto_centroids, auto_nprobe, use_ivf
from lodestone.functions import models
from lodestone.operators import index as index_
from lodestone.operators import ivf, search
from lodestone.operators.chunking import embedding_text
from lodestone.sources.files import chunk_files
from lodestone.sources.tables import stored


def make_index(files: DataFrame, cfg: IndexConfig, forced_ivf: bool | None = None, keep: bool = True) -> index_.Index:
    """An index of (file, text): chunks, postings, and vectors if ``cfg.model`` isn't ``none``, in an IVF as the settings say.

    Parts that are read more than once are kept in the shared folder unless
    ``keep`` is false.
    """
    hold = stored if keep else lambda df, _: df
    built = index_.build(hold(chunk_files(files, cfg), "chunks"), cfg.stem)
    built.posts = hold(built.posts, "postings")
    built = replace(built, df=index_.term_df(built.posts), model=models.resolve(cfg.model).key)
    made = models.embedder(cfg.model)
    if not made.dim:
        return built
    text = built.chunks.withColumn("t", embedding_text(F.col("title"), F.col("body"), cfg.embed_max_chars))
    built.vectors = hold(made.embed(text, "t").select("chunk_id", "vec"), "vectors")
    n = built.vectors.count()
    if n and use_ivf(cfg, n, made.dim, forced_ivf):
        k = min(cfg.ivf_centroids or auto_centroids(n), n)
        built.ivf = ivf.build(built.vectors, ivf.train(built.vectors, k, cfg.ivf_kmeans_iters), cfg.ivf_nprobe or auto_nprobe(k))
    return built


def with_vectors(queries: DataFrame, model: str) -> DataFrame:
    """Queries with ``qvec`` from the model that the index was built with; as they are for ``none``."""
    made = models.embedder(model)
    return made.embed(queries, "query").withColumnRenamed("vec", "qvec") if made.dim else queries


def settled(index: index_.Index, cfg: QueryConfig, mode_given: bool = False, boost_given: bool = False) -> QueryConfig:
    """The config as the index allows: without vectors hybrid becomes bm25, semantic is an error; bm25 has a title boost of its own."""
    if index.vectors is None and cfg.mode != "bm25":
        if cfg.mode == "semantic" and mode_given:
            raise ValueError("the index has no vectors for a semantic search")
        cfg = replace(cfg, mode="bm25")
    return replace(cfg, title_boost=NO_EMBEDDING_TITLE_BOOST) if cfg.mode == "bm25" and not boost_given else cfg


def recall(index: index_.Index, queries: DataFrame, cfg: QueryConfig) -> DataFrame:
    """Results of (query_id, query) with file, title and body, and linked rows after them."""
    asked = queries if cfg.mode == "bm25" else with_vectors(queries, index.model)
    found = search.dispatch(index, asked, cfg)
    return found.join(index.chunks.select("chunk_id", "file", "title", "body"), "chunk_id")


def questions(spark: SparkSession, *texts: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
