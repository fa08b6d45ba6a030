"""Queries over the driver's tables, one per operator, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import QueryConfig
from lodestone.functions import text, vector
from lodestone.functions.embed import HashingEmbedder
from lodestone.functions.stem import stemmed_vocabulary
from lodestone.operators import chunking, evaluate, index, ivf, links, render, search, tune
from lodestone.operators.nearest import candidates
from lodestone.sources.tables import new_path, read_table, small, stored

QUESTION = "the ththe and tionth estion with"
PROBES = 8
BM25 = QueryConfig(mode="bm25", k=10, max_linked=0)
HYBRID = QueryConfig(k=10, semantic_hard_floor=0.05, semantic_soft_floor=0.15)
TAGS = ("fr", "de")
GRID = [QueryConfig(mode="bm25", k=5, bm25_k1=k1, bm25_b=b) for k1 in (0.8, 1.2, 2.33) for b in (0.4, 0.75, 0.97)]


#: Setting with the number of tasks to deal single-file tables into; unset, the layout of the files decides.
PARTITIONS = "lodestone.tables.partitions"
_BUILT: dict[tuple[str, str], str] = {}


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return read_table(spark, f"{d}/{name}.parquet", int(spark.conf.get(PARTITIONS, "0")))


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks: the first line is the title, the rest the body, language and source are tags."""
    docs = _table(spark, d, "documents").filter("text is not null")
    at = F.locate("\n", F.col("text"))
    return docs.select(
        F.col("doc_id").alias("chunk_id"),
        F.concat(F.col("source"), F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file"),
        F.when(at > 0, F.substr("text", F.lit(1), at - 1)).otherwise(F.col("text")).alias("title"),
        F.when(at > 0, F.substr("text", at + 1)).otherwise("").alias("body"),
        F.array("lang", "source").alias("tags"),
    )


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))


def one_query(spark: SparkSession, query: str = QUESTION) -> DataFrame:
    return spark.range(1).select(F.lit(0).cast("long").alias("query_id"), F.lit(query).alias("query"))


def vector_queries(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("qvec"))


def hybrid_query(spark: SparkSession, d: str) -> DataFrame:
    return one_query(spark).crossJoin(vectors(spark, d).filter("chunk_id = 7").select(F.col("vec").alias("qvec")))


def passages(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def fixed_centroids(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).filter("chunk_id < 16").select(F.col("chunk_id").cast("int").alias("cid"), F.col("vec").cast("array<double>").alias("center"))


def built(spark: SparkSession, d: str) -> index.Index:
    """The saved index of the corpus of ``d``; an application builds it once, and all searches read it."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _BUILT:
        path = new_path(spark, "index")
        index.build(corpus(spark, d)).save(path)
        _BUILT[key] = path
    return index.load(spark, _BUILT[key])


def rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """The index built and saved anew; its sizes."""
    _BUILT.pop((spark.sparkContext.applicationId, d), None)
    new = built(spark, d)
    return new.stats.crossJoin(new.df.agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_postings"))).withColumn("avg_dl", F.round("avg_dl", 6))


def _scores(df: DataFrame, *more: str) -> DataFrame:
    return df.select("query_id", "rank", "chunk_id", *more, F.round("score", 6).alias("score"))


def _bm25(cfg: QueryConfig, query: str = QUESTION):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _scores(search.search_bm25(built(spark, d), one_query(spark, query), cfg))

    return run


def _batch(spark: SparkSession, d: str, cfg: QueryConfig) -> DataFrame:
    return search.search_bm25(built(spark, d), passages(spark, d), cfg)


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """A label per document that holds a passage word for word."""
    made = built(spark, d)
    hits = small(stored(evaluate.holders(made, passages(spark, d)), "holders")).join(made.chunks.select("chunk_id", "file"), "chunk_id")
    return stored(hits.select("query_id", F.col("file").alias("label"), F.lit(False).alias("is_title")), "labels")


def _shown(spark: SparkSession, d: str) -> DataFrame:
    return stored(small(stored(_batch(spark, d, QueryConfig(mode="bm25", k=5)), "ranked")).join(built(spark, d).chunks.select("chunk_id", "file", "title"), "chunk_id"), "shown")


def _metrics(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.round(m, 9).alias(m) for m in evaluate.METRICS])


def markdown(spark: SparkSession, d: str) -> DataFrame:
    """Documents with headings and fences put in: a heading on every 5th line, a fence on every 7th, by number from 0."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 5 == 3, F.concat(F.lit("## "), x)).when(i % 7 == 6, F.lit("```")).otherwise(x))
    return _table(spark, d, "documents").filter("text is not null").select(F.concat(F.lit("d/doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file"), F.array_join(lines, "\n").alias("text"))


def _heading(spark: SparkSession, d: str) -> DataFrame:
    return chunking.by_heading(markdown(spark, d)).select("file", "ord", "title", F.md5("body").alias("body_md5"))


def plain_files(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("file"), "text")


def linked(spark: SparkSession, d: str) -> DataFrame:
    """The corpus with two links in each document."""
    n = _table(spark, d, "documents").count()
    target = lambda k: F.concat(F.lit("[[doc-"), ((F.col("chunk_id") * 7 + k) % n).cast("string"), F.lit("|see]]"))
    body = F.concat("body", F.lit(" "), target(1), F.lit(" and "), target(2))
    return corpus(spark, d).withColumn("linked", body).withColumn("links", text.links(F.concat(target(1), F.lit(" and "), target(2))))


def _expanded(spark: SparkSession, d: str) -> DataFrame:
    q = one_query(spark)
    found = search.search_bm25(built(spark, d), q, QueryConfig(mode="bm25", k=5))
    return _scores(links.expand(found, linked(spark, d), 3), "linked_from")


def _frontmatter(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.sources.files import frontmatter

    docs = _table(spark, d, "documents").filter("text is not null")
    made = F.concat(F.lit("---\ntitle: Doc "), F.col("doc_id").cast("string"), F.lit("\ntags: [ "), F.upper("lang"), F.lit(", "), F.col("source"), F.lit("]\naliases: [d"), F.col("doc_id").cast("string"), F.lit("]\n---\n"), "text")
    out = frontmatter(docs.select(F.col("doc_id").cast("string").alias("file"), made.alias("text")))
    return out.select("file", "fm_title", F.array_join("tags", ",").alias("tags"), F.array_join("aliases", ",").alias("aliases"), F.md5("text").alias("rest_md5"))


def _tuned(spark: SparkSession, d: str) -> DataFrame:
    made = built(spark, d)
    shown = stored(small(stored(tune.trial_results(made, None, passages(spark, d), GRID), "ranked")).join(made.chunks.select("chunk_id", "file", "title"), "chunk_id"), "trials")
    means = evaluate.mean_metrics(evaluate.query_metrics(shown, labelled(spark, d), ("trial",)), ("trial",))
    return evaluate.best_trial(means, "mrr").select("trial", F.round("objective", 9).alias("objective"))


def _ivf(spark: SparkSession, d: str) -> ivf.IVF:
    return ivf.build(vectors(spark, d), fixed_centroids(spark, d), PROBES)


def _hybrid(cfg: QueryConfig, shortlist: bool = False):
    def run(spark: SparkSession, d: str) -> DataFrame:
        q = hybrid_query(spark, d)
        near = _ivf(spark, d).search(q, 200).drop("rank") if shortlist else None
        out = search.search_hybrid(built(spark, d), vectors(spark, d), q, cfg, near)
        return _scores(out, F.round("semantic", 6).alias("semantic"), F.round("norm", 6).alias("norm"))

    return run


def _gate_counts(spark: SparkSession, d: str) -> DataFrame:
    q = hybrid_query(spark, d)
    rows = search.hybrid_scores(built(spark, d), vectors(spark, d), q, HYBRID)
    return rows.groupBy(search.passes_gate(F.round("semantic", 9), F.round("norm", 9), HYBRID).alias("passes")).agg(F.count("*").alias("n"))


def _context(spark: SparkSession, d: str) -> DataFrame:
    q = one_query(spark)
    found = search.search_bm25(built(spark, d), q, BM25).join(built(spark, d).chunks.select("chunk_id", "file", "title", "body"), "chunk_id")
    return render.context_block(found).select("query_id", "rank", F.octet_length("block").alias("bytes"), F.md5("block").alias("block_md5"))


def hybrid_queries(spark: SparkSession, d: str) -> DataFrame:
    """Each passage with the vector of its number, where there is one."""
    return passages(spark, d).join(vectors(spark, d).select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("qvec")), "query_id")


def _hybrid_batch(spark: SparkSession, d: str) -> DataFrame:
    out = search.search_hybrid(built(spark, d), vectors(spark, d), hybrid_queries(spark, d), HYBRID)
    return _scores(out, F.round("semantic", 6).alias("semantic"), F.round("norm", 6).alias("norm"))


def _norms(spark: SparkSession, d: str) -> DataFrame:
    rows = search.hybrid_scores(built(spark, d), vectors(spark, d), hybrid_query(spark, d), HYBRID)
    return rows.select("query_id", "chunk_id", *[F.round(c, 6).alias(c) for c in ("semantic", "norm", "score")])


#: Lists that a search in trained lists reads: three quarters of them give a recall over 0.9 on unclustered vectors.
TRAINED_LISTS, TRAINED_PROBES = 16, 12


def trained_ivf(spark: SparkSession, d: str) -> ivf.IVF:
    return ivf.build(vectors(spark, d), stored(ivf.train(vectors(spark, d), TRAINED_LISTS), "centroids"), TRAINED_PROBES)


def _recall(found: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """How many of the 10 best of each query a search finds."""
    flat = search.search_semantic(vectors(spark, d), vector_queries(spark, d), 10).select("query_id", "chunk_id")
    both = flat.join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return both.groupBy("query_id").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))


def fenced(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a heading on every 2nd line, and fences that begin with blanks or are left open."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 4 == 3, F.lit("  ~~~ x")).when(i % 2 == 1, F.concat(F.lit("## "), x)).otherwise(x))
    return _table(spark, d, "documents").filter("text is not null").select(F.concat(F.lit("d/doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file"), F.array_join(lines, "\n").alias("text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "tokenize_counts": lambda s, d: index.tokenized(corpus(s, d)).select("chunk_id", "doc_len"),
    "term_freq": lambda s, d: index.postings(corpus(s, d)).select("chunk_id", "term", "tf"),
    "title_term_freq": lambda s, d: index.postings(corpus(s, d)).filter("title_tf > 0").select("chunk_id", "term", "title_tf"),
    "doc_freq": lambda s, d: index.term_df(index.postings(corpus(s, d))),
    "index_build": rebuilt,
    "doc_len_stats": lambda s, d: index.length_stats(corpus(s, d)).withColumn("avg_dl", F.round("avg_dl", 6)),
    "bm25_top10": _bm25(BM25),
    "bm25_title_boost": _bm25(QueryConfig(mode="bm25", k=10, title_boost=5.0)),
    "bm25_repeat_terms": _bm25(BM25, QUESTION + " tionth tionth estion"),
    "bm25_tag_filter": _bm25(QueryConfig(mode="bm25", k=10, require_tags=TAGS)),
    "bm25_batch_topk": lambda s, d: _scores(_batch(s, d, BM25)),
    "corpus_hit_gate": lambda s, d: search.corpus_hits(built(s, d), passages(s, d)),
    "dot_top10": lambda s, d: _scores(search.search_semantic(vectors(s, d), vector_queries(s, d), 10)),
    "squared_l2_top10": lambda s, d: _scores(search.search_l2(vectors(s, d), vector_queries(s, d), 10)),
    "l2_normalize_norms": lambda s, d: vectors(s, d).select("chunk_id", F.posexplode(vector.l2_normalize(F.transform("vec", lambda x, i: x.cast("double") * (i % 3)))).alias("pos", "x")).select("chunk_id", "pos", F.round("x", 6).alias("x")),
    "semantic_batch_topk": lambda s, d: _scores(search.search_semantic(vectors(s, d), vector_queries(s, d), 10)),
    "ivf_assign": lambda s, d: ivf.assign(vectors(s, d), fixed_centroids(s, d)).select("chunk_id", "cid"),
    "ivf_list_sizes": lambda s, d: ivf.assign(vectors(s, d), fixed_centroids(s, d)).groupBy("cid").agg(F.count("*").alias("n")),
    "ivf_probe_topk": lambda s, d: _scores(_ivf(s, d).search(vector_queries(s, d), 10)),
    "ivf_full_probe_equals_flat": lambda s, d: _scores(_ivf(s, d).search(vector_queries(s, d), 10, 16)),
    "ivf_recall_at_10": lambda s, d: _recall(_ivf(s, d).search(vector_queries(s, d), 10), s, d),
    "ivf_trained_recall_at_10": lambda s, d: _recall(trained_ivf(s, d).search(vector_queries(s, d), 10), s, d).agg(F.avg("recall").alias("recall"), F.count("*").alias("queries")),
    "lloyd_step": lambda s, d: ivf.lloyd_step(vectors(s, d), fixed_centroids(s, d)).select("cid", "pos", F.round("value", 6).alias("value")),
    "hybrid_top10": _hybrid(HYBRID),
    "hybrid_batch_topk": _hybrid_batch,
    "hybrid_norm_scores": _norms,
    "hybrid_tag_filter": _hybrid(QueryConfig(k=10, semantic_hard_floor=0.05, semantic_soft_floor=0.15, require_tags=TAGS)),
    "ivf_hybrid_top10": _hybrid(HYBRID, True),
    "relevance_gate_counts": _gate_counts,
    "chunk_heading": _heading,
    "chunk_heading_fenced": lambda s, d: chunking.by_heading(fenced(s, d)).select("file", "ord", "title", F.md5("body").alias("body_md5")),
    "chunk_size_windows": lambda s, d: chunking.by_size(plain_files(s, d)).select("file", "ord", "title", F.md5("body").alias("body_md5")),
    "chunk_length_filter": lambda s, d: chunking.length_limited(corpus(s, d), 200, 1000).select("chunk_id", F.octet_length("body").alias("bytes")),
    "wikilinks": lambda s, d: linked(s, d).select("chunk_id", F.array_join(text.links(F.col("linked")), ",").alias("links")),
    "link_target_norm": lambda s, d: corpus(s, d).select("chunk_id", text.link_key(F.concat(F.when(F.col("chunk_id") % 3 == 0, F.lit("a\\b/")).otherwise(F.lit("x.y/")), F.upper("file"), F.when(F.col("chunk_id") % 2 == 0, F.lit(".bak")).otherwise(F.lit("")))).alias("key")),
    "link_expansion": _expanded,
    "frontmatter_fields": _frontmatter,
    "glob_filter": lambda s, d: corpus(s, d).filter(text.wanted(F.col("file"), ("src1*/doc-*.md", "doc-?.md"), ("doc-1*.md",))).select("chunk_id", "file"),
    "context_block": _context,
    "eval_metrics_bm25": lambda s, d: _metrics(evaluate.query_metrics(_shown(s, d), labelled(s, d)), "query_id"),
    "eval_mean": lambda s, d: _metrics(evaluate.mean_metrics(evaluate.query_metrics(_shown(s, d), labelled(s, d)))),
    "tune_grid_best": _tuned,
    "kmeans_train": lambda s, d: ivf.train(vectors(s, d), 16).select("cid", F.size("center").alias("dim")),
    "stem_tokens": lambda s, d: stemmed_vocabulary(index.postings(corpus(s, d))),
    "hash_embed": lambda s, d: HashingEmbedder(32).embed(corpus(s, d).withColumn("t", F.concat_ws("\n", "title", "body")), "t").select("chunk_id", F.round(vector.norm(F.col("vec")), 6).alias("norm")),
}

# SQL (none where models are trained) ------------------------------------------------------------------------

_CORPUS = r"""
  docs AS (
    SELECT doc_id AS chunk_id, source || '/doc-' || doc_id || '.md' AS file, [lang, source] AS tags, text,
           CASE WHEN instr(text, chr(10)) > 0 THEN left(text, instr(text, chr(10)) - 1) ELSE text END AS title,
           CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS body
    FROM documents WHERE text IS NOT NULL
  ), toks AS (
    SELECT chunk_id, tags, regexp_extract_all(lower(replace(title, 'İ', 'i')), '[a-z0-9_-]{2,}') AS t, regexp_extract_all(lower(replace(body, 'İ', 'i')), '[a-z0-9_-]{2,}') AS b FROM docs
  ), lens AS (SELECT chunk_id, tags, len(t) + len(b) AS doc_len FROM toks),
  words AS (SELECT chunk_id, unnest(t) AS term, 1 AS title FROM toks UNION ALL SELECT chunk_id, unnest(b), 0 FROM toks),
  posts AS (SELECT chunk_id, term, count(*) AS tf, sum(title)::BIGINT AS title_tf FROM words GROUP BY ALL),
  dfs AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
  stats AS (SELECT count(*) AS n, sum(doc_len)::BIGINT AS total, avg(doc_len) AS avg_dl FROM lens)
"""


def _q(query: str) -> str:
    return f"SELECT 0::BIGINT AS query_id, '{query}' AS query"


_ASKED = "SELECT item_id AS query_id, text AS query FROM benchmark"


def _scored(asked: str, k1: float | str = 2.33, b: float | str = 0.97, boost: float = 2.5, where: str = "true", more: str = "", extra: str = "") -> str:
    """CTEs down to ``sc`` (query_id, chunk_id, score)."""
    return f"""{_CORPUS}, asked AS ({asked}),
  qt AS (SELECT query_id, term, count(*) AS q_tf FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9_-]{{2,}}')) AS term FROM asked) GROUP BY ALL),
  hit AS (SELECT query_id, p.chunk_id, q_tf, df, doc_len, tf + {boost - 1} * title_tf AS tf, stats.n, avg_dl FROM posts p JOIN qt USING (term) JOIN dfs USING (term) JOIN lens USING (chunk_id), stats WHERE {where}),
  sc AS (SELECT {more} query_id, chunk_id, sum(q_tf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * doc_len / avg_dl))) AS score FROM hit {extra} GROUP BY ALL)"""


def _ranked(source: str, k: int, by: str = "") -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY {by}query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM {source} QUALIFY rank <= {k})"


def _top(ctes: str, k: int = 10) -> str:
    return f"WITH {ctes} SELECT query_id, rank::INTEGER AS rank, chunk_id, round(score, 6) AS score FROM {_ranked('sc', k)}"


_IN_TAGS = "list_has_any(tags, ['fr', 'de'])"
_V = "SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS vec FROM embeddings"
_DOT = "list_dot_product(q.vec, v.vec)"
_NEAR = f"v AS ({_V}), q AS (SELECT * FROM v WHERE chunk_id % 20 = 0), c AS (SELECT chunk_id::INTEGER AS cid, vec FROM v WHERE chunk_id < 16)"
_ASSIGN = "a AS (SELECT chunk_id, cid FROM (SELECT v.chunk_id, c.cid, row_number() OVER (PARTITION BY v.chunk_id ORDER BY round(list_dot_product(v.vec, c.vec), 9) DESC, c.cid) AS r FROM v, c) WHERE r = 1)"


def _probe(n: int) -> str:
    return f"pr AS (SELECT q.chunk_id AS query_id, q.vec, c.cid FROM q, c QUALIFY row_number() OVER (PARTITION BY q.chunk_id ORDER BY round(list_dot_product(q.vec, c.vec), 9) DESC, c.cid) <= {n}), sc AS (SELECT q.query_id, v.chunk_id, {_DOT} AS score FROM pr q JOIN a USING (cid) JOIN v ON v.chunk_id = a.chunk_id)"


_SEM = f"sem AS (SELECT chunk_id, coalesce({_DOT}, 0) AS semantic FROM docs LEFT JOIN v USING (chunk_id), (SELECT vec FROM v WHERE chunk_id = 7) q)"
_GATE = "CASE WHEN semantic < 0.05 THEN false WHEN semantic < 0.15 THEN norm >= 0.44 ELSE true END"


def _hybrid_sql(where: str = "true", short: bool = False) -> str:
    pool = "SELECT chunk_id, semantic, coalesce(score, 0) AS bm25 FROM sem LEFT JOIN sc USING (chunk_id) JOIN lens USING (chunk_id) WHERE " + where
    if short:
        pool = "SELECT chunk_id, coalesce(s.score, 0) AS semantic, coalesce(sc.score, 0) AS bm25 FROM (SELECT n.chunk_id, n.score FROM near n JOIN docs USING (chunk_id)) s FULL JOIN sc USING (chunk_id)"
    near = f", c AS (SELECT chunk_id::INTEGER AS cid, vec FROM v WHERE chunk_id < 16), {_ASSIGN}, q AS (SELECT * FROM v WHERE chunk_id = 7), pr AS (SELECT c.cid FROM q, c ORDER BY round(list_dot_product(q.vec, c.vec), 9) DESC, c.cid LIMIT {PROBES}), near AS (SELECT v.chunk_id, {_DOT} AS score FROM pr JOIN a USING (cid) JOIN v USING (chunk_id), q ORDER BY round({_DOT}, 9) DESC, v.chunk_id LIMIT 200)" if short else ""
    return f"""{_scored(_q(QUESTION), where=where)}, v AS ({_V}), {_SEM}{near},
  pool AS ({pool}),
  x AS (SELECT 0::BIGINT AS query_id, *, bm25 / max(bm25) OVER () AS norm FROM pool),
  y AS (SELECT *, 0.48 * semantic + 0.52 * norm AS score FROM x)"""


def _hybrid_top(where: str = "true", short: bool = False) -> str:
    gated = f"(SELECT * FROM y WHERE {_GATE})"
    return f"WITH {_hybrid_sql(where, short)} SELECT query_id, rank::INTEGER AS rank, chunk_id, round(semantic, 6) AS semantic, round(norm, 6) AS norm, round(score, 6) AS score FROM {_ranked(gated, 10)}"


_HYBRID_BATCH = f"""WITH {_scored(_ASKED)}, v AS ({_V}), q AS (SELECT query_id, vec FROM asked JOIN v ON chunk_id = query_id),
  gate AS (SELECT query_id FROM qt LEFT JOIN dfs USING (term) GROUP BY query_id HAVING coalesce(sum(q_tf) FILTER (df > 0), 0) >= CASE WHEN sum(q_tf) >= 3 THEN 2 ELSE 1 END),
  sem AS (SELECT query_id, chunk_id, coalesce({_DOT}, 0) AS semantic FROM docs LEFT JOIN v USING (chunk_id), q WHERE query_id IN (SELECT query_id FROM gate)),
  pool AS (SELECT query_id, chunk_id, semantic, coalesce(score, 0) AS bm25 FROM sem LEFT JOIN sc USING (query_id, chunk_id)),
  x AS (SELECT *, CASE WHEN max(bm25) OVER (PARTITION BY query_id) > 0 THEN bm25 / max(bm25) OVER (PARTITION BY query_id) ELSE 0 END AS norm FROM pool),
  y AS (SELECT *, 0.48 * semantic + 0.52 * norm AS score FROM x)
  SELECT query_id, rank::INTEGER AS rank, chunk_id, round(semantic, 6) AS semantic, round(norm, 6) AS norm, round(score, 6) AS score FROM {_ranked(f"(SELECT * FROM y WHERE {_GATE})", 10)}"""

_LABELS = "labels0 AS (SELECT DISTINCT item_id AS query_id, file AS label FROM docs JOIN benchmark b ON contains(docs.text, b.text))"


def _metric_sql(by: str = "", shown: str = "") -> str:
    key = f"{by}query_id"
    return f"""{_LABELS}, shown AS (SELECT {key}, rank, file FROM {shown} s JOIN docs USING (chunk_id)),
  hits AS (SELECT {key}, min(rank) AS first, count(DISTINCT label) AS got, count(DISTINCT rank) AS nrows FROM shown JOIN labels0 USING (query_id) WHERE lower(file) = lower(label) OR ends_with(file, label) GROUP BY ALL),
  cnt AS (SELECT {key}, count(*) AS shown FROM shown GROUP BY ALL), tot AS (SELECT query_id, count(DISTINCT label) AS total FROM labels0 GROUP BY ALL),
  base AS (SELECT * FROM tot{', (SELECT DISTINCT trial FROM shown)' if by else ''}),
  m AS (SELECT {key}, CASE WHEN first IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS hit_rate, coalesce(1.0::DOUBLE / first, 0) AS mrr, coalesce(got / total, 0)::DOUBLE AS recall, coalesce(nrows / shown, 0)::DOUBLE AS precision FROM base LEFT JOIN cnt USING ({key.replace(', ', ',')}) LEFT JOIN hits USING ({key.replace(', ', ',')}))"""


_MD = r"""md AS (SELECT doc_id, i, CASE WHEN i % 5 = 3 THEN '## ' || line WHEN i % 7 = 6 THEN '```' ELSE line END AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL))"""

_MD_FENCED = r"""md AS (SELECT doc_id, i, CASE WHEN i % 4 = 3 THEN '  ~~~ x' WHEN i % 2 = 1 THEN '## ' || line ELSE line END AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL))"""


def _heading_sql(md: str) -> str:
    return rf"""WITH {md}, f AS (SELECT *, coalesce(sum(regexp_matches(trim(line), '^(```|~~~)')::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM md),
      h AS (SELECT *, starts_with(line, '## ') AND NOT inside AS head FROM f), s AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM h),
      p AS (SELECT doc_id, sec, max(substr(line, 4)) FILTER (head) AS named, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT head), ''), '^\s+|\s+$', '', 'g') AS body FROM s GROUP BY ALL)
      SELECT 'd/doc-' || doc_id || '.md' AS file, (row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1)::INTEGER AS ord, CASE WHEN sec = 0 THEN 'doc-' || doc_id ELSE named END AS title, md5(body) AS body_md5 FROM p WHERE body <> ''"""


# Bytes of text by character: a cut character counts as U+FFFD, which has 3.
def _chars(source: str, key: str) -> str:
    return f"ch AS (SELECT {key}, i, c, strlen(c) AS size, sum(strlen(c)) OVER (PARTITION BY {key} ORDER BY i) AS stop FROM (SELECT {key}, unnest(string_split(body, '')) AS c, generate_subscripts(string_split(body, ''), 1) AS i FROM {source}))"


_LENGTHS = f"""WITH {_CORPUS}, lo AS (SELECT chunk_id, body, strlen(body) AS n FROM docs WHERE strlen(body) >= 200), {_chars('(SELECT * FROM lo WHERE n > 1000)', 'chunk_id')},
  cut AS (SELECT chunk_id, max(stop) FILTER (stop <= 1000) AS whole FROM ch GROUP BY chunk_id)
  SELECT chunk_id, (CASE WHEN n <= 1000 THEN n ELSE whole + CASE WHEN whole < 1000 THEN 3 ELSE 0 END END)::INTEGER AS bytes FROM lo LEFT JOIN cut USING (chunk_id)"""

_TRIM = r"regexp_replace(regexp_replace({}, '^[\s\x{{85}}\p{{Z}}]+', ''), '[\s\x{{85}}\p{{Z}}]+$', '')"

_WINDOWS = f"""WITH d AS (SELECT 'doc-' || doc_id AS file, text AS body, strlen(text) AS n FROM documents WHERE text IS NOT NULL AND text <> ''), {_chars('d', 'file')},
  w AS (SELECT file, unnest(range(0, (greatest(ceil((n - 500) / 400.0), 0) * 400)::BIGINT + 1, 400)) AS lo FROM d),
  p AS (SELECT w.file, lo, string_agg(CASE WHEN stop - size >= lo AND stop <= lo + 500 THEN c WHEN stop - size < lo THEN repeat(chr(65533), (stop - lo)::INTEGER) ELSE chr(65533) END, '' ORDER BY i) AS piece
        FROM w JOIN ch ON ch.file = w.file AND stop > lo AND stop - size < lo + 500 GROUP BY ALL),
  t AS (SELECT file, lo, {_TRIM.format('piece')} AS body FROM p),
  r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY lo) AS k FROM t WHERE body <> '')
  SELECT file, (k - 1)::INTEGER AS ord, 'chunk-' || k AS title, md5(body) AS body_md5 FROM r"""

_BLOCK_SQL = f"""WITH {_scored(_q(QUESTION))}, p AS (SELECT rank, title, file, body, strlen(body) AS n FROM {_ranked('sc', 10)} r JOIN docs USING (chunk_id)), {_chars('(SELECT * FROM p WHERE n > 1800)', 'rank')},
  h0 AS (SELECT rank, max(stop) FILTER (stop <= 1800) AS whole, coalesce(string_agg(c, '' ORDER BY i) FILTER (stop <= 1800), '') AS head FROM ch GROUP BY rank),
  h AS (SELECT rank, CASE WHEN whole < 1800 THEN head || chr(65533) ELSE head END AS head FROM h0),
  k AS (SELECT rank, head, strlen(head) - strlen(list_last(string_split(head, chr(10) || chr(10)))) - 2 AS cut_at, strlen(list_last(string_split(head, chr(10) || chr(10)))) AS tail FROM h),
  s AS (SELECT p.rank, '### ' || title || ' (' || file || ')' || chr(10) || CASE WHEN n <= 1800 THEN body WHEN cut_at >= 900 THEN left(head, length(head) - length(list_last(string_split(head, chr(10) || chr(10)))) - 2) || chr(10) || '…' ELSE head || chr(10) || '…' END || chr(10) || chr(10) AS block FROM p LEFT JOIN k ON k.rank = p.rank),
  b AS (SELECT *, sum(strlen(block)) OVER (ORDER BY rank) AS total FROM s)
  SELECT 0::BIGINT AS query_id, rank::INTEGER AS rank, strlen(block)::INTEGER AS bytes, md5(block) AS block_md5 FROM b WHERE total <= 6000"""

_TRIALS = "(VALUES " + ", ".join(f"({i}, {c.bm25_k1}::DOUBLE, {c.bm25_b}::DOUBLE)" for i, c in enumerate(GRID)) + ") g(trial, k1, b)"

ORACLE_SQL: dict[str, str] = {
    "tokenize_counts": f"WITH {_CORPUS} SELECT chunk_id, doc_len FROM lens",
    "term_freq": f"WITH {_CORPUS} SELECT chunk_id, term, tf FROM posts",
    "title_term_freq": f"WITH {_CORPUS} SELECT chunk_id, term, title_tf FROM posts WHERE title_tf > 0",
    "doc_freq": f"WITH {_CORPUS} SELECT term, df FROM dfs",
    "index_build": rebuilt,
    "doc_len_stats": f"WITH {_CORPUS} SELECT n AS n_chunks, total AS total_len, round(avg_dl, 6) AS avg_dl FROM stats",
    "bm25_top10": _top(_scored(_q(QUESTION))),
    "bm25_title_boost": _top(_scored(_q(QUESTION), boost=5.0)),
    "bm25_repeat_terms": _top(_scored(_q(QUESTION + " tionth tionth estion"))),
    "bm25_tag_filter": _top(_scored(_q(QUESTION), where=_IN_TAGS)),
    "bm25_batch_topk": _top(_scored(_ASKED)),
    "corpus_hit_gate": f"WITH {_scored(_ASKED)} SELECT query_id, sum(q_tf)::BIGINT AS n_terms, coalesce(sum(q_tf) FILTER (df > 0), 0)::BIGINT AS n_hits, coalesce(sum(q_tf) FILTER (df > 0), 0) >= CASE WHEN sum(q_tf) >= 3 THEN 2 ELSE 1 END AS passes FROM qt LEFT JOIN dfs USING (term) GROUP BY query_id",
    "index_build": f"WITH {_CORPUS} SELECT n AS n_chunks, total AS total_len, round(avg_dl, 6) AS avg_dl, (SELECT count(*) FROM dfs) AS n_terms, (SELECT count(*) FROM posts) AS n_postings FROM stats",
    "dot_top10": _top(f"v AS ({_V}), q AS (SELECT * FROM v WHERE chunk_id % 20 = 0), sc AS (SELECT q.chunk_id AS query_id, v.chunk_id, {_DOT} AS score FROM q, v)"),
    "squared_l2_top10": _top(f"v AS ({_V}), q AS (SELECT * FROM v WHERE chunk_id % 20 = 0), sc AS (SELECT q.chunk_id AS query_id, v.chunk_id, 0 - list_sum(list_transform(list_zip(q.vec, v.vec), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS score FROM q, v)"),
    "l2_normalize_norms": f"WITH v AS ({_V}), e AS (SELECT chunk_id, generate_subscripts(vec, 1) - 1 AS pos, unnest(vec) AS x FROM v), y AS (SELECT chunk_id, pos, x * (pos % 3) AS x FROM e), n AS (SELECT chunk_id, sqrt(sum(x * x)) AS n FROM y GROUP BY chunk_id) SELECT chunk_id, pos::INTEGER AS pos, round(CASE WHEN n > 0 THEN x / n ELSE x END, 6) AS x FROM y JOIN n USING (chunk_id)",
    "semantic_batch_topk": _top(f"{_NEAR}, sc AS (SELECT q.chunk_id AS query_id, v.chunk_id, {_DOT} AS score FROM q, v)"),
    "ivf_assign": f"WITH {_NEAR}, {_ASSIGN} SELECT chunk_id, cid FROM a",
    "ivf_list_sizes": f"WITH {_NEAR}, {_ASSIGN} SELECT cid, count(*) AS n FROM a GROUP BY cid",
    "ivf_probe_topk": _top(f"{_NEAR}, {_ASSIGN}, {_probe(PROBES)}"),
    "ivf_full_probe_equals_flat": _top(f"{_NEAR}, sc AS (SELECT q.chunk_id AS query_id, v.chunk_id, {_DOT} AS score FROM q, v)"),
    "ivf_recall_at_10": f"WITH {_NEAR}, {_ASSIGN}, {_probe(PROBES)}, fl AS (SELECT q.chunk_id AS query_id, v.chunk_id, {_DOT} AS score FROM q, v), f AS {_ranked('fl', 10)}, g AS {_ranked('sc', 10)} SELECT f.query_id, round(avg(CASE WHEN g.chunk_id IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS recall FROM f LEFT JOIN g ON f.query_id = g.query_id AND f.chunk_id = g.chunk_id GROUP BY f.query_id",
    "lloyd_step": f"WITH {_NEAR}, {_ASSIGN}, e AS (SELECT cid, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS pos FROM a JOIN v USING (chunk_id)) SELECT cid, pos::INTEGER AS pos, round(avg(x), 6) AS value FROM e GROUP BY ALL",
    "hybrid_top10": _hybrid_top(),
    "hybrid_batch_topk": _HYBRID_BATCH,
    "hybrid_norm_scores": f"WITH {_hybrid_sql()} SELECT query_id, chunk_id, round(semantic, 6) AS semantic, round(norm, 6) AS norm, round(score, 6) AS score FROM y",
    "hybrid_tag_filter": _hybrid_top(_IN_TAGS),
    "ivf_hybrid_top10": _hybrid_top(short=True),
    "relevance_gate_counts": f"WITH {_hybrid_sql()}, z AS (SELECT round(semantic, 9) AS semantic, round(norm, 9) AS norm FROM y) SELECT {_GATE} AS passes, count(*) AS n FROM z GROUP BY 1",
    "chunk_heading": _heading_sql(_MD),
    "chunk_heading_fenced": _heading_sql(_MD_FENCED),
    "chunk_length_filter": _LENGTHS,
    "chunk_size_windows": _WINDOWS,
    "context_block": _BLOCK_SQL,
    "wikilinks": "SELECT doc_id AS chunk_id, CASE WHEN n = 1 THEN 'doc-0' ELSE 'doc-' || ((doc_id * 7 + 1) % n) || ',doc-' || ((doc_id * 7 + 2) % n) END AS links FROM documents, (SELECT count(*) AS n FROM documents) WHERE text IS NOT NULL",
    "link_target_norm": "SELECT doc_id AS chunk_id, 'doc-' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '' END AS key FROM documents WHERE text IS NOT NULL",
    "link_expansion": f"""WITH {_scored(_q(QUESTION))}, p AS {_ranked('sc', 5)}, n AS (SELECT count(*) AS n FROM documents),
      l AS (SELECT rank, file, k AS pos, 'doc-' || ((chunk_id * 7 + k) % n) AS key FROM p JOIN docs USING (chunk_id), n, (VALUES (1), (2)) t(k)),
      t AS (SELECT 'doc-' || chunk_id AS key, min(chunk_id) AS target FROM docs GROUP BY 1),
      o AS (SELECT target, rank, pos, file FROM l JOIN t USING (key) WHERE target NOT IN (SELECT chunk_id FROM p) QUALIFY row_number() OVER (PARTITION BY target ORDER BY rank, pos) = 1),
      a AS (SELECT *, row_number() OVER (ORDER BY rank, pos) AS r FROM o)
      SELECT query_id, rank::INTEGER AS rank, chunk_id, NULL::VARCHAR AS linked_from, round(score, 6) AS score FROM p
      UNION ALL SELECT 0, ((SELECT max(rank) FROM p) + r)::INTEGER, target, file, 0 FROM a WHERE r <= 3""",
    "frontmatter_fields": "SELECT doc_id::VARCHAR AS file, 'Doc ' || doc_id AS fm_title, lower(lang) || ',' || lower(source) AS tags, 'd' || doc_id AS aliases, md5(text) AS rest_md5 FROM documents WHERE text IS NOT NULL",
    "glob_filter": r"WITH docs AS (SELECT doc_id AS chunk_id, source || '/doc-' || doc_id || '.md' AS file FROM documents WHERE text IS NOT NULL) SELECT chunk_id, file FROM docs WHERE (regexp_matches(file, '^src1[^/]*/doc-[^/]*\.md$') OR regexp_matches(file, '/doc-[^/]\.md$')) AND NOT regexp_matches(file, '/doc-1[^/]*\.md$')",
    "eval_metrics_bm25": f"WITH {_scored(_ASKED)}, {_metric_sql(shown=_ranked('sc', 5))} SELECT query_id, round(hit_rate, 9) AS hit_rate, round(mrr, 9) AS mrr, round(recall, 9) AS recall, round(precision, 9) AS precision FROM m",
    "eval_mean": f"WITH {_scored(_ASKED)}, {_metric_sql(shown=_ranked('sc', 5))} SELECT round(avg(hit_rate), 9) AS hit_rate, round(avg(mrr), 9) AS mrr, round(avg(recall), 9) AS recall, round(avg(precision), 9) AS precision FROM m",
    "tune_grid_best": f"WITH {_scored(_ASKED, 'k1', 'b', more='trial,', extra=', ' + _TRIALS)}, {_metric_sql('trial, ', _ranked('sc', 5, 'trial, '))}, o AS (SELECT trial, round(avg(mrr), 12) AS objective FROM m GROUP BY trial) SELECT trial, round(objective, 9) AS objective FROM o ORDER BY o.objective DESC, trial LIMIT 1",
}
