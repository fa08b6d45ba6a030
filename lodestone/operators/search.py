"""Ranked retrieval for a table of queries: BM25, vectors, and the gated hybrid of both.

Every search takes all its queries at once.  A few query terms are a table
that meets their postings in an equi-join, many go with all queries in a pass
over the chunks; ranks are of round(score, 9), ties to the smaller chunk id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import QueryConfig, auto_shortlist
from lodestone.functions.stem import stemmed_vocabulary
from lodestone.functions.text import tokens
from lodestone.functions.vector import dot
from lodestone.operators import scan
from lodestone.operators.index import Index
from lodestone.operators.links import expand
from lodestone.operators.nearest import asked_in_turns, candidates
from lodestone.sources.tables import stored


#: Distinct query terms up to which the scan of the postings is told which it needs.
PUSHED_TERMS = 256


def query_terms(queries: DataFrame, stem: bool = False) -> DataFrame:
    """(query_id, term, q_tf) of (query_id, query), with the stems of its words if ``stem``."""
    words = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term"))
    if stem:
        words = words.join(stemmed_vocabulary(words), "term").select("query_id", F.col("stem").alias("term"))
    return words.groupBy("query_id", "term").agg(F.count("*").alias("q_tf"))


def term_hits(index: Index, queries: DataFrame) -> DataFrame:
    """The postings of the query terms, with query_id, q_tf, df and the corpus statistics.

    Postings are stored in runs in order of term, so for few terms the scan
    skips the pages without them.
    """
    q = query_terms(queries, index.stem)
    terms = [r["term"] for r in q.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
    posts, df = ((t.filter(F.col("term").isin(terms)) if len(terms) <= PUSHED_TERMS else t) for t in (index.posts, index.df))
    return posts.join(q, "term").join(df, "term").crossJoin(F.broadcast(index.stats))  # one row


def tag_filter(tags: Column, require: tuple[str, ...]) -> Column:
    """Whether one of the tags is required, whatever the case; everything passes if none is."""
    if not require:
        return F.lit(True)
    low = F.transform(tags, F.lower)
    return F.coalesce(F.arrays_overlap(low, F.array(*[F.lit(t.lower()) for t in require])), F.lit(False))


def top_k(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best rows of each query with rank, from 1; all if k is 0 or less."""
    order = Window.partitionBy("query_id").orderBy(F.round(F.col(score), 9).desc(), F.col("chunk_id"))
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k) if k > 0 else ranked


def bm25_scores(index: Index, queries: DataFrame, cfg: QueryConfig) -> DataFrame:
    """(query_id, chunk_id, score); a repeated query term counts as often, the tags don't change document frequencies."""
    tf = F.col("tf") + (max(cfg.title_boost, 1.0) - 1.0) * F.col("title_tf")
    idf = F.log((F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = F.col("q_tf") * idf * tf * (cfg.bm25_k1 + 1) / (tf + cfg.bm25_k1 * (1 - cfg.bm25_b + cfg.bm25_b * F.col("doc_len") / F.col("avg_dl")))
    scored = term_hits(index, queries).groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))
    return scored.join(index.chunks.filter(tag_filter(F.col("tags"), cfg.require_tags)).select("chunk_id"), "chunk_id", "left_semi") if cfg.require_tags else scored


def _allowed(index: Index, cfg: QueryConfig) -> DataFrame | None:
    """(chunk_id) with the required tags; None if none are."""
    return index.chunks.filter(tag_filter(F.col("tags"), cfg.require_tags)).select(F.col("chunk_id").cast("long").alias("chunk_id")) if cfg.require_tags else None


def search_bm25(index: Index, queries: DataFrame, cfg: QueryConfig) -> DataFrame:
    if cfg.k > 0 and (asked := scan.asked_words(index, query_terms(queries, index.stem))) is not None:
        return top_k(scan.best_by_words(index, asked, [cfg], cfg.k, _allowed(index, cfg)).drop("trial"), cfg.k)
    return top_k(bm25_scores(index, queries, cfg).filter("score > 0"), cfg.k)


def search_semantic(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best of all (chunk_id, vec) for each stated (query_id, qvec); tags and floors don't count."""
    return top_k(candidates(vectors, queries, k), k)


def search_l2(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest by squared Euclidean distance, its negative as the score: the inner product of vectors with one component more."""
    longer = vectors.select("chunk_id", F.concat(F.transform("vec", lambda x: 2 * x.cast("double")), F.array(0 - dot(F.col("vec"), F.col("vec")))).alias("vec"))
    asked = queries.select("query_id", F.concat(F.col("qvec").cast("array<double>"), F.array(F.lit(1.0))).alias("qvec"))
    own = queries.select("query_id", dot(F.col("qvec"), F.col("qvec")).alias("own"))
    return top_k(candidates(longer, asked, k).join(own, "query_id").select("query_id", "chunk_id", (F.col("score") - F.col("own")).alias("score")), k)


def corpus_hits(index: Index, queries: DataFrame, min_terms: int = 0) -> DataFrame:
    """(query_id, n_terms, n_hits, passes): query tokens, with repeats, that the corpus has; by default 2 are needed of 3 or more, else 1."""
    q = query_terms(queries, index.stem).join(index.df, "term", "left")
    out = q.groupBy("query_id").agg(F.sum("q_tf").alias("n_terms"), F.sum(F.when(F.col("df") > 0, F.col("q_tf")).otherwise(0)).alias("n_hits"))
    need = F.lit(min_terms) if min_terms > 0 else F.when(F.col("n_terms") >= 3, 2).otherwise(1)
    return out.withColumn("passes", F.col("n_hits") >= need)


def passes_gate(semantic: Column, norm: Column, cfg: QueryConfig) -> Column:
    """Under the hard floor: no; under the soft one: only with enough BM25; else yes."""
    return F.when(semantic < cfg.semantic_hard_floor, False).when(semantic < cfg.semantic_soft_floor, norm >= cfg.bm25_min_for_soft_zone).otherwise(True)


def combined(rows: DataFrame, cfg: QueryConfig) -> DataFrame:
    """norm and score of (query_id, chunk_id, semantic, bm25): the maximum is taken before the gate."""
    most = rows.groupBy("query_id").agg(F.max("bm25").alias("most"))
    rows = rows.join(most, "query_id").withColumn("norm", F.when(F.col("most") > 0, F.col("bm25") / F.col("most")).otherwise(0.0)).drop("most")
    return rows.withColumn("score", cfg.weight_semantic * F.col("semantic") + cfg.weight_bm25 * F.col("norm"))


def _passing(index: Index, queries: DataFrame, cfg: QueryConfig) -> DataFrame:
    """The queries with enough words in the corpus, computed once: a hybrid search reads them several times."""
    passing = corpus_hits(index, queries, cfg.min_query_terms_in_corpus).filter("passes").select("query_id")
    return stored(queries.join(passing, "query_id", "left_semi"), "asked")


def _word_scores(index: Index, asked: DataFrame, cfg: QueryConfig) -> DataFrame:
    """(query_id, chunk_id, bm25), computed once."""
    return stored(bm25_scores(index, asked, cfg).withColumnRenamed("score", "bm25"), "bm25")


def hybrid_scores(index: Index, vectors: DataFrame, queries: DataFrame, cfg: QueryConfig, shortlist: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, semantic, bm25, norm, score) before the gate.

    Flat: all chunks that pass the tags, a missing vector has cosine 0.  With
    a ``shortlist`` (query_id, chunk_id, score): chunks in it or with BM25,
    and cosine 0 off it.
    """
    asked = _passing(index, queries, cfg)
    bm25 = _word_scores(index, asked, cfg)
    allowed = index.chunks.filter(tag_filter(F.col("tags"), cfg.require_tags)).select("chunk_id")
    if shortlist is None:
        near = candidates(vectors.join(allowed, "chunk_id", "left_semi"), asked, 0).withColumnRenamed("score", "semantic")
        rows = allowed.crossJoin(asked.select("query_id")).join(near, ["query_id", "chunk_id"], "left").join(bm25, ["query_id", "chunk_id"], "left")
    else:
        sem = shortlist.join(asked.select("query_id"), "query_id", "left_semi").join(allowed, "chunk_id", "left_semi").select("query_id", "chunk_id", F.col("score").alias("semantic"))
        rows = sem.join(bm25, ["query_id", "chunk_id"], "full")
    rows = rows.select("query_id", "chunk_id", F.coalesce("semantic", F.lit(0.0)).alias("semantic"), F.coalesce("bm25", F.lit(0.0)).alias("bm25"))
    return combined(rows, cfg)


def _contenders(index: Index, vectors: DataFrame, asked: DataFrame, cfg: QueryConfig) -> DataFrame:
    """:func:`hybrid_scores` of the chunks that can be among the k best: those with BM25, and the k nearest.

    With a hard floor above 0 a chunk without BM25 needs its cosine alone; if
    it isn't among the k nearest, these pass the gate as well and score no less.
    """
    bm25 = _word_scores(index, asked, cfg)
    allowed = vectors.join(index.chunks.filter(tag_filter(F.col("tags"), cfg.require_tags)).select("chunk_id"), "chunk_id", "left_semi")
    near = candidates(allowed, asked, cfg.k).withColumnRenamed("score", "semantic")
    own = bm25.join(vectors.select("chunk_id", "vec"), "chunk_id", "left").join(asked.select("query_id", "qvec"), "query_id")
    own = own.select("query_id", "chunk_id", F.coalesce(dot(F.col("qvec"), F.col("vec")), F.lit(0.0)).alias("semantic"), "bm25")
    rest = near.join(bm25.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").withColumn("bm25", F.lit(0.0))
    return combined(own.unionByName(rest), cfg)


def _scanned(index: Index, vectors: DataFrame, asked: DataFrame, cfg: QueryConfig) -> DataFrame | None:
    """The best of each task that pass the gate, in a pass over the chunks; None where words or vectors are too few or too many for it."""
    words = scan.asked_words(index, query_terms(asked, index.stem))
    turns = list(asked_in_turns(asked, 2)) if words is not None else []
    if len(turns) != 1:
        return None
    ids, data = turns[0]
    if len(np.unique(ids)) < len(ids):
        return None  # of several vectors each would count
    at = np.minimum(np.searchsorted(words.ids, ids), max(len(words.ids) - 1, 0))
    known = words.ids[at] == ids if len(words.ids) else np.zeros(len(ids), bool)
    qvecs = np.zeros((len(words.ids), data.shape[1]))
    qvecs[at[known]] = data[known]
    return scan.best_of_both(index, vectors, words, qvecs, cfg, _allowed(index, cfg))


def search_hybrid(index: Index, vectors: DataFrame, queries: DataFrame, cfg: QueryConfig, shortlist: DataFrame | None = None) -> DataFrame:
    """The gate comes before the ranks, so that what it drops takes no place."""
    if shortlist is not None or cfg.k <= 0:
        rows = hybrid_scores(index, vectors, queries, cfg, shortlist)
    else:
        asked = _passing(index, queries, cfg)
        if (found := _scanned(index, vectors, asked, cfg)) is not None:
            return top_k(found, cfg.k)
        few = cfg.semantic_hard_floor > 0 and min(cfg.weight_semantic, cfg.weight_bm25) >= 0
        rows = _contenders(index, vectors, asked, cfg) if few else hybrid_scores(index, vectors, queries, cfg)
    return top_k(rows.filter(passes_gate(F.col("semantic"), F.col("norm"), cfg)), cfg.k)


def backend(index: Index) -> str:
    """What a search by vectors goes through."""
    return f"ivf(K={index.ivf.centroids.count()},nprobe={index.ivf.nprobe})" if index.ivf else "flat"


def dispatch(index: Index, queries: DataFrame, cfg: QueryConfig) -> DataFrame:
    """(query_id, chunk_id, rank, score, linked_from, semantic, norm): bm25, semantic, or hybrid for any other mode, then link expansion.

    A search by vectors goes through the index's IVF if it has one; it needs
    vectors in the index and ``qvec`` in the queries.
    """
    if cfg.mode == "bm25":
        found = search_bm25(index, queries, cfg)
    elif index.vectors is None or "qvec" not in queries.columns:
        raise ValueError(f"{cfg.mode} search needs vectors of the chunks and of the queries")
    elif cfg.mode == "semantic":
        found = index.ivf.search(queries, cfg.k, cfg.nprobe) if index.ivf else search_semantic(index.vectors, queries, cfg.k)
    else:
        near = index.ivf.search(queries, cfg.n_semantic or auto_shortlist(cfg.k), cfg.nprobe).drop("rank") if index.ivf else None
        found = search_hybrid(index, index.vectors, queries, cfg, near)
    score = F.col("score") if cfg.mode == "semantic" else F.lit(None).cast("double")
    shown = found if "semantic" in found.columns else found.withColumn("semantic", score).withColumn("norm", F.lit(None).cast("double"))
    links = expand(found, index.chunks, cfg.max_linked)
    return links.join(shown.select("query_id", "chunk_id", "semantic", "norm"), ["query_id", "chunk_id"], "left")
