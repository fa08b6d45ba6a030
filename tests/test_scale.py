"""What leaves the tasks of a search grows with its queries, and a worker holds a bounded piece of its input."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.config import QueryConfig
from lodestone.operators import index, ivf, nearest, scan, search, tune


def _vectors(spark, n, dim=8, copies=2):
    """``copies`` of each vector, so that scores tie, and a null one."""
    x = np.random.default_rng(11).normal(size=(n, dim)).astype(np.float32)
    rows = [(i, x[i % n].tolist()) for i in range(n * copies)] + [(n * copies, None)]
    return np.concatenate([x] * copies).astype(float), spark.createDataFrame(rows, "chunk_id long, vec array<float>").repartition(3)


def _rows(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 6)) for r in df.collect())


def _exact(x, asked, k, read=None):
    out = []
    for i in asked:
        s = np.round(x @ x[i], 9)
        ids = np.flatnonzero(read[i]) if read is not None else np.arange(len(x))
        best = ids[np.lexsort((ids, -s[ids]))][: k or None]
        out += [(i, r + 1, int(j), round(float(x[i] @ x[j]), 6)) for r, j in enumerate(best)]
    return sorted(out)


def _asked(vecs):
    return vecs.filter("chunk_id % 10 = 0 and vec is not null").select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("qvec"))


def test_a_task_of_a_flat_search_keeps_k_of_each_query(spark, monkeypatch):
    x, vecs = _vectors(spark, 150)
    monkeypatch.setattr(nearest, "VECTOR_ROWS", 16)
    monkeypatch.setattr(nearest, "QUERY_ROWS", 7)
    q = _asked(vecs)
    # one row for each query, place and task, not for each pair of blocks
    assert nearest.candidates(vecs.coalesce(1), q, 3).count() <= 30 * 3 * spark.sparkContext.defaultParallelism
    assert _rows(search.search_semantic(vecs, q, 3)) == _exact(x, range(0, 300, 10), 3)
    monkeypatch.setattr(nearest, "BROADCAST_BYTES", 500)  # the queries go in turns
    assert _rows(search.search_semantic(vecs, q, 3)) == _exact(x, range(0, 300, 10), 3)
    assert nearest.candidates(vecs, q, 0).count() == 30 * 300


@pytest.mark.parametrize("probes", [2, 5])
def test_ivf_search_is_no_join_of_pairs(spark, monkeypatch, probes):
    x, vecs = _vectors(spark, 150)
    centers = [(c, x[c].tolist()) for c in range(5)]
    built = ivf.build(vecs, spark.createDataFrame(centers, "cid int, center array<double>"), probes)
    found = built.search(_asked(vecs), 4)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    s = np.round(x @ x[:5].T, 9)
    cid, order = s.argmax(1), np.argsort(-s, axis=1, kind="stable")[:, :probes]
    want = _exact(x, range(0, 300, 10), 4, {i: np.isin(cid, order[i]) for i in range(0, 300, 10)})
    assert _rows(found) == want
    monkeypatch.setattr(nearest, "BROADCAST_BYTES", 500)
    assert _rows(built.search(_asked(vecs), 4)) == want
    if probes == 5:
        assert _rows(built.search(_asked(vecs), 0)) == _exact(x, range(0, 300, 10), 0)


def test_vectors_that_fall_into_lists_come_from_turns_of_centroids(spark, monkeypatch):
    x, vecs = _vectors(spark, 60)
    centers = spark.createDataFrame([(c, x[c].tolist()) for c in range(7)], "cid int, center array<double>")
    monkeypatch.setattr(ivf, "CENTROID_BYTES", 200)
    got = {r["chunk_id"]: r["cid"] for r in ivf.assign(vecs, centers).collect()}
    assert got == dict(enumerate(np.round(x @ x[:7].T, 9).argmax(1).tolist()))
    # centroids are met where the vectors are, not sent to the driver as queries
    assert ivf.build(vecs, centers, 7).search(_asked(vecs), 2).count() == 24


def _shuffled(spark, run):
    """What ``run`` returns, and the bytes that it shuffled."""
    jsc = spark.sparkContext._jsc.sc()

    def total():
        jsc.listenerBus().waitUntilEmpty(30_000)
        return jsc.statusStore().executorSummary("driver").totalShuffleWrite()

    before = total()
    return run(), total() - before


def _corpus(spark, path, n=3000):
    """A saved index of chunks that share their words, each text twice, and 30 queries of these words."""
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(40)]
    texts = [(" ".join(rng.choice(words, 2)), " ".join(rng.choice(words, 12))) for _ in range(n // 2)] * 2
    rows = [(i, f"f{i}", t, b, [("odd", "even")[i % 2 == 0]]) for i, (t, b) in enumerate(texts)]
    index.build(spark.createDataFrame(rows, "chunk_id long, file string, title string, body string, tags array<string>").repartition(4)).save(path)
    asked = [(i, " ".join([*rng.choice(words, 6), "none"])) for i in range(30)]
    return index.load(spark, path), spark.createDataFrame(asked, "query_id long, query string"), {i: f"{t}\n{b}" for i, (t, b) in enumerate(texts)}


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    return _corpus(spark, str(tmp_path_factory.mktemp("index") / "i"))


def _found(df, *by):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*by, "query_id", "rank", "chunk_id", "score").collect())


def test_trials_shuffle_what_they_keep(spark, made, monkeypatch):
    """30 queries meet nearly all of 3000 chunks in 9 trials."""
    built, q, _ = made
    configs = [QueryConfig(mode="bm25", k=k, bm25_k1=k1, bm25_b=b, title_boost=t) for k1 in (0.8, 2.33) for b in (0.4, 0.97) for k, t in ((5, 2.5), (3, 1.0))]
    got, moved = _shuffled(spark, lambda: _found(tune.trial_results(built, None, q, configs), "trial"))
    assert len(got) == 4 * 30 * (5 + 3) and moved < 300_000
    monkeypatch.setattr(scan, "asked_words", lambda *_: None)
    assert _found(tune.trial_results(built, None, q, configs), "trial") == got


def _with_vectors(spark, q, n=3000):
    """Vectors of two thirds of the chunks, and queries that have them or lack them."""
    x = np.random.default_rng(3).normal(size=(n // 2, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vecs = spark.createDataFrame([(i, x[i % len(x)].tolist()) for i in range(n + 30) if i % 3], "chunk_id long, vec array<double>")
    own = spark.createDataFrame([(i, x[i].tolist() if i % 7 else None) for i in range(30)], "query_id long, qvec array<double>")
    return vecs, q.join(own, "query_id")


@pytest.mark.parametrize("hard, tags", [(0.05, ()), (0.0, ()), (0.05, ("EVEN",)), (-1.0, ("odd",))])
def test_a_hybrid_search_shuffles_no_pairs(spark, made, monkeypatch, hard, tags):
    built, q, _ = made
    vecs, asked = _with_vectors(spark, q)
    cfg = QueryConfig(k=10, semantic_hard_floor=hard, semantic_soft_floor=0.15, require_tags=tags)
    got, moved = _shuffled(spark, lambda: _found(search.search_hybrid(built, vecs, asked, cfg), "semantic", "norm"))
    assert len(got) >= 250 and moved < 1_000_000
    monkeypatch.setattr(scan, "asked_words", lambda *_: None)
    assert _found(search.search_hybrid(built, vecs, asked, cfg), "semantic", "norm") == got


def test_a_hybrid_search_of_one_query_finds_chunks_of_the_index_only(spark, made):
    """Vectors without a chunk take no place, and the nearest come out of bounded pieces."""
    built, q, text = made
    vecs, asked = _with_vectors(spark, q)
    far = vecs.withColumn("chunk_id", F.when(F.col("chunk_id") < 20, F.col("chunk_id") + 9_000).otherwise(F.col("chunk_id")))
    cfg = QueryConfig(k=10, semantic_hard_floor=0.05, semantic_soft_floor=0.15, weight_bm25=0.0)
    got = search.search_hybrid(built, far, asked.filter("query_id = 5"), cfg)
    assert {r["chunk_id"] for r in got.collect()} <= set(text) and got.count() == 10


def test_labels_come_without_a_shuffle_of_texts(spark, tmp_path, request):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # the texts are taken for many
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    rows = [(i, f"f{i}", "head", " ".join(f"x{(i * 31 + j * 7919) % 5_003}" for j in range(400)), ["t"]) for i in range(600)]
    index.build(spark.createDataFrame(rows, "chunk_id long, file string, title string, body string, tags array<string>")).save(str(tmp_path / "i"))
    built = index.load(spark, str(tmp_path / "i"))
    asked = spark.createDataFrame([(i, " ".join(rows[i * 20][3].split()[5:15])) for i in range(30)] + [(0, "head"), (1, rows[40][3][:60])], "query_id long, query string")
    from lodestone.operators import evaluate

    got, moved = _shuffled(spark, lambda: sorted((r["query_id"], r["chunk_id"]) for r in evaluate.holders(built, asked).filter("chunk_id < 1000").collect()))
    want = sorted((q, r[0]) for q, t in {tuple(x) for x in asked.collect()} for r in rows if t in f"{r[2]}\n{r[3]}")
    assert got == want and moved < sum(len(r[3]) for r in rows) / 10


def test_metrics_of_a_batch_shuffle_what_is_shown(spark, made):
    from lodestone.operators import evaluate

    built, q, text = made
    asked = q.withColumn("query", F.concat_ws(" ", "query", F.lit("w1 w2")))

    def run():
        shown = search.search_bm25(built, asked, QueryConfig(mode="bm25", k=5)).join(F.broadcast(built.chunks.select("chunk_id", "file", "title")), "chunk_id")
        labels = spark.createDataFrame([(i, f"f{i}", False) for i in range(30)], "query_id long, label string, is_title boolean")
        return evaluate.mean_metrics(evaluate.query_metrics(shown, labels)).first()

    means, moved = _shuffled(spark, run)
    assert 0 <= means["mrr"] <= means["hit_rate"] <= 1 and moved < 300_000


@pytest.mark.parametrize("tags", [(), ("EVEN",)])
def test_a_batch_by_words_shuffles_k_rows_of_each_query(spark, made, monkeypatch, tags):
    built, q, _ = made
    cfg = QueryConfig(mode="bm25", k=4, require_tags=tags)
    got, moved = _shuffled(spark, lambda: _found(search.search_bm25(built, q, cfg)))
    assert len(got) == 120 and moved < 150_000
    # equal texts have equal scores, and the smaller id comes first
    best = {(r[0], r[1]): r for r in got}
    assert tags or all(best[i, 1][2] < best[i, 2][2] and best[i, 1][3] == best[i, 2][3] for i in range(30))
    stemmed = index.build(built.chunks, stem=True)
    monkeypatch.setattr(scan, "CELLS", 40)
    assert _found(search.search_bm25(built, q, cfg)) == got == _found(search.search_bm25(stemmed, q, cfg))
    monkeypatch.setattr(scan, "asked_words", lambda *_: None)
    assert _found(search.search_bm25(built, q, cfg)) == got
    assert search.search_bm25(built, q.limit(0), cfg).count() == 0


def test_an_index_is_saved_in_sorted_runs_without_a_shuffle_of_postings(spark, made, tmp_path, monkeypatch):
    built, _, _ = made
    chunks = built.chunks.withColumn("body", F.concat_ws(" ", "body", F.lit("everywhere")))
    _, moved = _shuffled(spark, lambda: index.build(chunks).save(str(tmp_path / "i")))
    posts = spark.read.parquet(str(tmp_path / "i" / "postings"))
    assert posts.filter("term = 'everywhere'").count() == 3000 and moved < 50_000
    assert {tuple(r) for r in posts.collect()} == {tuple(r) for r in index.postings(spark.read.parquet(str(tmp_path / "i" / "chunks"))).collect()}
    monkeypatch.setattr(index, "RUN_POSTINGS", 90)
    rows = _drawn()
    runs = [[tuple(r.values()) for r in x.to_pylist()] for x in index._invert(index._gather(iter([_tokens(rows)])))]
    assert max(map(len, runs)) <= 90 and all(x == sorted(x) for x in runs) and sorted(r for x in runs for r in x) == sorted((w, i, n, t, size) for i, w, n, t, size in _counted(rows))


def _tokens(rows):
    title, body = zip(*rows, strict=True)
    size = [len(t) + len(b) for t, b in rows]
    kind = pa.list_(pa.string())
    return pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(size, pa.int32()), pa.array(title, kind), pa.array(body, kind)], names=["chunk_id", "doc_len", "t", "b"])


def _drawn(n=200):
    rng = np.random.default_rng(5)
    return [([f"a{x}" for x in rng.integers(9, size=rng.integers(4))], [f"a{x}" for x in rng.integers(30, size=rng.integers(60))]) for _ in range(n)]


def _counted(rows):
    return {(i, w, (t + b).count(w), t.count(w), len(t) + len(b)) for i, (t, b) in enumerate(rows) for w in {*t, *b}}


def test_tokens_are_counted_in_bounded_pieces(monkeypatch):
    rows = _drawn()
    monkeypatch.setattr(index, "COUNT_TOKENS", 100)
    out = list(index._count(iter([_tokens(rows)])))
    assert max(x.num_rows for x in out) <= 100 and len(out) > 20
    got = [(r["chunk_id"], r["term"], r["tf"], r["title_tf"], r["doc_len"]) for x in out for r in x.to_pylist()]
    assert len(got) == len(set(got)) and set(got) == _counted(rows)


def test_words_to_stem_come_in_bounded_pieces(monkeypatch):
    """A batch of distinct words, more than a piece takes, comes out whole and piece by piece."""
    rows = [([], [f"word{i * 50 + j}s" for j in range(50)]) for i in range(20)]
    monkeypatch.setattr(index, "COUNT_TOKENS", 120)
    out = [x.column("term").to_pylist() for x in index._count(iter([_tokens(rows)]))]
    assert max(map(len, out)) <= 120 and sorted(w for x in out for w in x) == sorted(w for _, b in rows for w in b)


def test_a_chunk_of_more_tokens_than_a_piece_is_counted_whole(monkeypatch):
    rows = [([], ["a"]), (["b"], ["b", "c"] * 300), ([], []), ([], ["c"])]
    monkeypatch.setattr(index, "COUNT_TOKENS", 100)
    out = list(index._count(iter([_tokens(rows)])))
    assert [x.num_rows for x in out] == [1, 2, 1]
    assert {(r["term"], r["chunk_id"]) for x in out for r in x.to_pylist()} == {("a", 0), ("b", 1), ("c", 1), ("c", 3)}


def test_title_counts_keep_to_their_piece(monkeypatch):
    rows = _drawn(60)
    monkeypatch.setattr(index, "COUNT_TOKENS", 64)
    flat = [(r["chunk_id"], r["term"], r["title_tf"]) for x in index._count(iter([_tokens(rows)])) for r in x.to_pylist()]
    nested = [(r["chunk_id"], w, n) for x in index._gather(iter([_tokens(rows)])) for r in x.to_pylist() for w, n in zip(r["terms"], r["title_tf"], strict=True)]
    assert set(flat) == {(i, w, t) for i, w, _, t, _ in _counted(rows)} and flat == nested
