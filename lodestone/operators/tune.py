"""Tuning of query settings, all trials rescored and ranked in one job, and of build settings, build by build."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import IndexConfig, QueryConfig, auto_shortlist
from lodestone.operators import links, scan, search
from lodestone.operators.evaluate import best_trial, mean_metrics, query_metrics
from lodestone.operators.index import Index
from lodestone.operators.nearest import candidates
from lodestone.sources.tables import small, stored

# What the build settings are drawn from.
SIZES, OVERLAPS, CAPS = (300, 500, 800, 1200, 1600), (0, 50, 100, 200), (0, 1000, 2000)

#: Configs whose sums are columns of one row; more configs take several rows for each hit.
_BLOCK = 16
_KNOBS = ("weight_semantic", "weight_bm25", "bm25_k1", "bm25_b", "semantic_hard_floor", "semantic_soft_floor", "bm25_min_for_soft_zone", "title_boost")


def sampled(base: QueryConfig, trials: int = 200, seed: int = 42) -> list[QueryConfig]:
    """The base and ``trials`` random variants of it."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = [base]
    for _ in range(trials if trials > 0 else 200):
        w, hard = rng.uniform(0.1, 0.9), rng.uniform(0, 0.4)
        out.append(replace(base, weight_semantic=w, weight_bm25=1 - w, bm25_k1=rng.uniform(0.5, 2.5), bm25_b=rng.uniform(0.25, 1), semantic_hard_floor=hard, semantic_soft_floor=hard + rng.uniform(0, 0.3), bm25_min_for_soft_zone=rng.uniform(0, 0.6)))
    return out


def _ranked(rows: DataFrame, configs: list[QueryConfig]) -> DataFrame:
    """The k best of each trial and query with rank; all where k is 0 or less."""
    order = Window.partitionBy("trial", "query_id").orderBy(F.round("score", 9).desc(), "chunk_id")
    ranked, most = rows.withColumn("rank", F.row_number().over(order)), max(c.k for c in configs)
    if all(c.k > 0 for c in configs):
        ranked = ranked.filter(F.col("rank") <= most)  # a constant, so that each task cuts its part before the shuffle
    return ranked.filter((F.col("rank") <= F.col("k")) | (F.col("k") <= 0)).select("trial", "query_id", "chunk_id", "score", "rank")


def trial_results(index: Index, vectors: DataFrame | None, queries: DataFrame, configs: list[QueryConfig]) -> DataFrame:
    """(trial, query_id, chunk_id, score, rank) of all configs at once; without vectors, of BM25 alone.

    BM25 alone is one pass over the chunks for all configs.  Else what doesn't
    depend on a config, term statistics and cosines, is computed once and
    joined with the (small) table of configs.  Tags, the words that
    the corpus must have, the IVF and the shortlist are the first config's.
    """
    spark, base = index.chunks.sparkSession, configs[0]
    if vectors is not None:
        queries = queries.join(search.corpus_hits(index, queries, base.min_query_terms_in_corpus).filter("passes").select("query_id"), "query_id", "left_semi")
    allowed = index.chunks.filter(search.tag_filter(F.col("tags"), base.require_tags)).select("chunk_id")
    if vectors is None and all(c.k > 0 for c in configs) and (asked := scan.asked_words(index, search.query_terms(queries, index.stem), -1)) is not None:
        found = scan.best_by_words(index, asked, configs, max(c.k for c in configs), allowed if base.require_tags else None)
        return _ranked(found.join(F.broadcast(spark.createDataFrame([(i, c.k) for i, c in enumerate(configs)], "trial int, k int")), "trial"), configs)
    table = spark.createDataFrame([(i, c.k, *(float(getattr(c, n)) for n in _KNOBS)) for i, c in enumerate(configs)], ", ".join(["trial int", "k int", *(f"{n} double" for n in _KNOBS)]))
    width = min(_BLOCK, len(configs))
    padded = [*configs, *configs[-1:] * (-len(configs) % width)]
    blocks = [(i, *([float(getattr(c, n)) for c in padded[i : i + width]] for n in ("bm25_k1", "bm25_b", "title_boost"))) for i in range(0, len(padded), width)]
    knobs = spark.createDataFrame(blocks, "first int, k1 array<double>, b array<double>, boost array<double>")
    hits = search.term_hits(index, queries).crossJoin(F.broadcast(knobs))
    hits = hits.join(allowed, "chunk_id", "left_semi") if base.require_tags else hits
    weight = F.col("q_tf") * F.log((F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    hits = hits.select("first", "query_id", "chunk_id", "k1", "b", "boost", "tf", "title_tf", weight.alias("w"), (F.col("doc_len") / F.col("avg_dl")).alias("len"))

    def part(i: int):
        k1, b = F.col("k1")[i], F.col("b")[i]
        tf = F.col("tf") + (F.greatest(F.col("boost")[i], F.lit(1.0)) - 1.0) * F.col("title_tf")
        return F.sum(F.col("w") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len")))).alias(f"s{i}")

    sums = hits.groupBy("first", "query_id", "chunk_id").agg(*map(part, range(width)))
    rows = sums.select("first", "query_id", "chunk_id", F.posexplode(F.array(*[f"s{i}" for i in range(width)])).alias("at", "bm25"))
    rows = rows.select((F.col("first") + F.col("at")).alias("trial"), "query_id", "chunk_id", "bm25").filter(F.col("trial") < len(configs))
    if vectors is None:
        rows = rows.join(F.broadcast(table.select("trial", "k")), "trial").withColumn("score", F.col("bm25"))
    else:
        if index.ivf:
            near = index.ivf.search(queries, base.n_semantic or auto_shortlist(base.k), base.nprobe).select("query_id", "chunk_id", "score")
        else:
            near = candidates(vectors, queries, 0)
        near = (near.join(allowed, "chunk_id", "left_semi") if base.require_tags else near).withColumnRenamed("score", "semantic").crossJoin(F.broadcast(table.select("trial")))
        most = rows.groupBy("trial", "query_id").agg(F.max("bm25").alias("most"))
        rows = rows.join(near, ["trial", "query_id", "chunk_id"], "full").fillna(0.0, ["bm25", "semantic"]).join(most, ["trial", "query_id"], "left")
        rows = rows.withColumn("norm", F.when(F.col("most") > 0, F.col("bm25") / F.col("most")).otherwise(0.0))
        rows = rows.join(F.broadcast(table), "trial").withColumn("score", F.col("weight_semantic") * F.col("semantic") + F.col("weight_bm25") * F.col("norm"))
        gate = F.when(F.col("semantic") < F.col("semantic_hard_floor"), False).when(F.col("semantic") < F.col("semantic_soft_floor"), F.col("norm") >= F.col("bm25_min_for_soft_zone")).otherwise(True)
        rows = rows.filter(gate)
    return _ranked(rows, configs)


def _expanded(ranked: DataFrame, index: Index, most: int) -> DataFrame:
    """Ranked results of all trials with their linked rows; each trial's query is a query of its own meanwhile."""
    if most <= 0:
        return ranked
    numbered = ranked.withColumn("query_id", F.struct("trial", "query_id")).drop("trial")
    return links.expand(numbered, index.chunks, most).select("query_id.trial", "query_id.query_id", "chunk_id", "score", "rank")


def tune_query(index: Index, queries: DataFrame, labels: DataFrame, configs: list[QueryConfig], goal: str = "hit_rate") -> tuple[QueryConfig, float]:
    """The best config and its objective; the first, the baseline, wins ties.

    Queries are searched as the first config's mode says: hybrid with the
    index's vectors and the queries' ``qvec``, semantic or bm25; its linked
    rows count as results.  Semantic results don't depend on what is tuned.
    """
    base = configs[0]
    if base.mode == "semantic":
        found = search.dispatch(index, queries, base)
        ranked, configs = found.select(F.lit(0).alias("trial"), "query_id", "chunk_id", "score", "rank"), configs[:1]
    else:
        ranked = _expanded(trial_results(index, None if base.mode == "bm25" else index.vectors, queries, configs), index, base.max_linked)
    shown = stored(small(stored(ranked, "ranked")).join(index.chunks.select("chunk_id", "file", "title"), "chunk_id"), "trials")
    best = best_trial(mean_metrics(query_metrics(shown, labels, ("trial",)), ("trial",)), goal).first()
    return (configs[best["trial"]], best["objective"]) if best["trial"] is not None else (base, 0.0)


def build_grid() -> list[dict]:
    """Distinct build settings to try: by heading, size and overlap do not matter."""
    grid = [{"chunk_strategy": "heading", "max_chunk_chars": c} for c in CAPS]
    return grid + [{"chunk_strategy": "size", "chunk_size": s, "chunk_overlap": o if o < s else s // 4, "max_chunk_chars": c} for s in SIZES for o in OVERLAPS for c in CAPS]


def drawn(base: IndexConfig, trials: int = 8, seed: int = 42) -> list[IndexConfig]:
    """The base and ``trials`` random variants of it out of the grid, strategies being equally likely; 8 if ``trials`` isn't positive."""
    rng = np.random.Generator(np.random.PCG64(seed))
    by = [[g for g in build_grid() if g["chunk_strategy"] == s] for s in ("heading", "size")]
    picked = (by[rng.integers(2)] for _ in range(trials if trials > 0 else 8))
    return [base, *(replace(base, **g[rng.integers(len(g))]) for g in picked)]


def tune_index(make: Callable[[IndexConfig], Index], prepare: Callable[[DataFrame], DataFrame], queries: DataFrame, labels: DataFrame, configs: list[IndexConfig], query_cfg: QueryConfig, goal: str = "hit_rate") -> tuple[IndexConfig, float]:
    """The best build config and its objective; the first, the baseline, wins ties.

    Each config is built anew by ``make``, a config met before isn't; an index
    without chunks is passed over.  ``prepare`` gives the queries their
    vectors, if ``query_cfg`` needs them.
    """
    asked, tried = prepare(queries), {}
    for cfg in configs:
        if cfg in tried:
            continue
        index = make(cfg)
        if index.stats.first()["n_chunks"]:
            tried[cfg] = tune_query(index, asked, labels, [query_cfg], goal)[1]
    return max(tried.items(), key=lambda x: x[1]) if tried else (configs[0], 0.0)
