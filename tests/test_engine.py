"""Invariants of the retrieval engine on small hand-made corpora."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.config import IndexConfig, QueryConfig, auto_centroids, auto_nprobe, auto_shortlist, use_ivf
from lodestone.functions import text, vector
from lodestone.functions.embed import HashingEmbedder, NoEmbedder, WordPiece
from lodestone.functions.stem import stem
from lodestone.operators import chunking, index, ivf, links, render, search, tune
from lodestone.sources.files import chunk_files, parse_frontmatter, read_directory, read_eval_set

CHUNKS = "chunk_id long, file string, title string, body string, tags array<string>, links array<string>"


@pytest.fixture
def chunks(spark):
    rows = [
        (0, "fruit.md", "Pruning apples", "cut apple branches in winter", ["garden"], ["cars"]),
        (1, "fruit.md", "Storage", "keep pears in a cool cellar", ["garden"], []),
        (2, "cars.md", "Engine", "change the oil of the engine, engine oil matters", ["Ops"], ["fruit"]),
        (3, "empty.md", "", "", [], []),
    ]
    return spark.createDataFrame(rows, CHUNKS)


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def ids(df):
    return [r["chunk_id"] for r in df.orderBy("query_id", "rank").collect()]


def test_bm25_ranks_boosts_and_filters(spark, chunks):
    built = index.build(chunks)
    cfg = QueryConfig(mode="bm25", k=3)
    assert ids(search.search_bm25(built, queries(spark, "engine"), cfg)) == [2]
    assert ids(search.search_bm25(built, queries(spark, "quantum"), cfg)) == []
    assert ids(search.search_bm25(built, queries(spark, "engine apple"), QueryConfig(k=3, require_tags=("OPS",)))) == [2]
    low, high = (search.search_bm25(built, queries(spark, "storage"), QueryConfig(k=1, title_boost=b)).first()["score"] for b in (1.0, 5.0))
    assert high > low
    once, twice = (search.search_bm25(built, queries(spark, q), cfg).first()["score"] for q in ("oil", "oil oil"))
    assert twice == pytest.approx(2 * once)


def test_gate_comes_before_top_k(spark):
    rows = [(i, f"f{i}", "t", "alpha beta", [], []) for i in range(3)] + [(3, "k1", "t", "gamma", [], []), (4, "k2", "t", "delta", [], [])]
    built = index.build(spark.createDataFrame(rows, CHUNKS))
    vecs = spark.createDataFrame([(0, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, [0.95, 0.31])], "chunk_id long, vec array<double>")
    q = queries(spark, "alpha beta").withColumn("qvec", F.array(F.lit(1.0), F.lit(0.0)))
    assert ids(search.search_hybrid(built, vecs, q, QueryConfig(k=3))) == [3, 4]
    with pytest.raises(ValueError):
        search.dispatch(built, q, QueryConfig(mode="semantic"))
    built.vectors = vecs
    assert ids(search.dispatch(built, q, QueryConfig(k=3))) == [3, 4]
    # the short way over the contenders and the long way over all chunks
    for k in (1, 2, 5):
        cfg = QueryConfig(k=k, semantic_hard_floor=0.01, semantic_soft_floor=0.02)
        long = search.hybrid_scores(built, vecs, q, cfg).filter(search.passes_gate(F.col("semantic"), F.col("norm"), cfg))
        assert ids(search.search_hybrid(built, vecs, q, cfg)) == ids(search.top_k(long, k))


def test_ivf_with_all_lists_equals_flat(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vecs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, vec array<double>")
    q = vecs.filter("chunk_id < 5").select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("qvec"))
    built = ivf.build(vecs, ivf.train(vecs, 8), 2)
    built.save(str(tmp_path / "ivf"))
    again = ivf.load(spark, str(tmp_path / "ivf"))
    flat = ids(search.search_semantic(vecs, q, 10))
    assert ids(built.search(q, 10, 8)) == flat == ids(again.search(q, 10, 8))
    assert again.nprobe == 2 and again.ntotal() == 300
    assert len(set(ids(built.search(q, 10, 1))) & set(flat)) > 0
    with pytest.raises(ValueError):
        ivf.train(vecs.limit(3), 8)


def test_headings_fences_sizes_and_frontmatter(spark, tmp_path):
    md = "intro\n## A \nx\n```\n## not\n```\n## Empty\n## B\r\n  y  "
    files = spark.createDataFrame([("d/n.md", md)], "file string, text string")
    got = [(r["ord"], r["title"], r["body"]) for r in chunking.by_heading(files).orderBy("ord").collect()]
    assert got == [(0, "n", "intro"), (1, "A ", "x\n```\n## not\n```"), (2, "B\r", "y")]
    prose = spark.createDataFrame([("p.txt", "A sentence that repeats. " * 80), ("e.txt", "")], "file string, text string")
    sizes = [len(r["body"]) for r in chunking.by_size(prose, 300, 50).collect()]
    assert len(sizes) >= 3 and max(sizes) <= 300
    assert parse_frontmatter("---\ntitle: T\ntags: [Ops, B]\naliases: [x]\n---\nrest") == ("T", ["x"], ["ops", "b"], "rest")
    for bad in ("---\ntitle: T\nrest", "plain", "---\ntags: one\n---\nrest"):
        assert parse_frontmatter(bad)[3] == bad
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("---\ntitle: Alpha\naliases: [first]\ntags: [T1]\n---\nbody [[B|see]]\n")
    (tmp_path / "sub" / "b.txt").write_text("## Two\nhello")
    (tmp_path / "c.bin").write_text("no")
    rows = chunk_files(read_directory(spark, str(tmp_path)), IndexConfig()).orderBy("chunk_id").collect()
    assert [(r["file"], r["title"], r["tags"], r["links"]) for r in rows] == [("a.md", "Alpha · aliases: first", ["t1"], ["b"]), ("sub/b.txt", "Two", [], [])]


def test_size_windows_cut_bytes(spark):
    texts = {"a": "é" * 333 + " x" * 90, "b": "日本語 テキスト " * 60, "c": "plain", "d": " \n ", "e": "", "f": None, "g": "🙂a" * 200, "h": "w" * 500, "i": "w" * 501}
    want = set()
    for f, t in texts.items():
        raw, at, k = (t or "").encode(), 0, 0
        while raw:
            body = raw[at : at + 500].decode("utf-8", "replace").strip()
            if body:
                want.add((f, k, f"chunk-{k + 1}", body))
                k += 1
            if at + 500 >= len(raw):
                break
            at += 400
    files = spark.createDataFrame(list(texts.items()), "file string, text string")
    assert {tuple(r) for r in chunking.by_size(files, 500, 100).collect()} == want


def test_text_functions(spark):
    row = spark.range(1).select(
        text.tokens(F.lit("A-b C_d é9x İz x")).alias("t"), text.links(F.lit("[[A]] [[a|b]] [[c#d|e]] [x] [[]]")).alias("l"),
        text.link_key(F.lit(r"d\x/File.Name.md")).alias("k"), text.byte_slice(F.lit("aé"), 1, 2).alias("c"),
    ).first()
    assert (row["t"], row["l"], row["k"], row["c"]) == (["a-b", "c_d", "9x", "iz"], ["a", "c"], "file.name", "a�")
    assert text.glob_regex("[a") is None and text.glob_regex("*.md") == r"^[^/]*\.md$"


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(1.0), F.lit(2.0), F.lit(9.0))
    row = spark.range(1).select(vector.dot(a, b).alias("d"), vector.squared_l2(a, b).alias("s"), vector.l2_normalize(a).alias("n"), vector.l2_normalize(F.array(F.lit(0.0))).alias("z"), vector.mean_pool(F.array(F.array(F.lit(1.0)), F.array(F.lit(3.0))), F.array(F.lit(1), F.lit(0))).alias("m")).first()
    assert (row["d"], row["s"], row["n"], row["z"], row["m"]) == (11.0, 8.0, [0.6, 0.8], [0.0], [1.0])


def test_links_expand_once_and_in_order(spark, chunks):
    found = search.search_bm25(index.build(chunks), queries(spark, "apple"), QueryConfig(k=1))
    rows = links.expand(found, chunks, 3).orderBy("rank").collect()
    assert [(r["chunk_id"], r["linked_from"]) for r in rows] == [(0, None), (2, "fruit.md")]
    assert links.expand(found, chunks, 0).count() == 1
    assert sorted(search.dispatch(index.build(chunks), queries(spark, "apple"), QueryConfig(mode="bm25", k=1)).columns) == ["chunk_id", "linked_from", "norm", "query_id", "rank", "score", "semantic"]


def test_context_block_stops_at_the_limit(spark):
    rows = [(0, i, "f", "t", "x" * n) for i, n in ((1, 2500), (2, 1700), (3, 1700), (4, 1700), (5, 10))]
    out = render.context_block(spark.createDataFrame(rows, "query_id long, rank int, file string, title string, body string")).collect()
    assert sorted(r["rank"] for r in out) == [1, 2, 3] and any("…" in r["block"] for r in out)


def test_tuning_is_no_worse_than_the_baseline(spark, chunks):
    q = queries(spark, "apple branches", "engine oil", "pears cellar")
    labels = spark.createDataFrame([(0, "fruit.md", False), (1, "Engine", True), (2, "fruit.md", False)], "query_id long, label string, is_title boolean")
    configs = tune.sampled(QueryConfig(mode="bm25", k=3), 5)
    _, base = tune.tune_query(index.build(chunks), q, labels, configs[:1], "mrr")
    best, score = tune.tune_query(index.build(chunks), q, labels, configs, "mrr")
    assert score >= base > 0 and best in configs


def test_saved_index_and_settings(spark, chunks, tmp_path):
    built = index.build(chunks)
    built.save(str(tmp_path / "i"))
    again = index.load(spark, str(tmp_path / "i"))
    q = queries(spark, "engine")
    assert ids(search.search_bm25(again, q, QueryConfig())) == ids(search.search_bm25(built, q, QueryConfig()))
    cfg = QueryConfig(title_boost=0.0, max_linked=0, require_tags=("a",))
    cfg.save(str(tmp_path / "c.json"))
    assert QueryConfig.load(str(tmp_path / "c.json")) == cfg
    bad = tmp_path / "e.json"
    bad.write_text(json.dumps({"queries": [{"query": "x"}]}))
    with pytest.raises(ValueError):
        read_eval_set(spark, str(bad))
    assert (auto_centroids(0), auto_centroids(10), auto_nprobe(100), auto_shortlist(3)) == (16, 10, 10, 100)
    assert not use_ivf(IndexConfig(), 9999, 0) and use_ivf(IndexConfig(), 5000, 8)


def test_postings_count_titles_and_bodies(spark, chunks):
    from collections import Counter

    rows = [(i, "f", t, b, [], []) for i, (t, b) in enumerate([("aa aa bb", "aa cc cc"), ("", ""), ("xx-1 xx", "xx xx-1 x xx-1"), (None, "zz"), ("zz", None), ("Ab ab- ab_ AB", "ab-")])]
    got = {(r["chunk_id"], r["term"]): (r["tf"], r["title_tf"]) for r in index.postings(spark.createDataFrame(rows, CHUNKS)).collect()}
    want = {}
    for i, _, t, b, *_ in rows:
        import re

        t, b = (re.findall("[a-z0-9_-]{2,}", (x or "").lower()) for x in (t, b))
        every = Counter(t + b)
        want |= {(i, w): (n, t.count(w)) for w, n in every.items()}
    assert got == want
    stemmed = index.build(chunks, stem=True)
    cfg = QueryConfig(mode="bm25", k=3)
    assert ids(search.search_bm25(stemmed, queries(spark, "pruned apple"), cfg)) == [0] and ids(search.search_bm25(index.build(chunks), queries(spark, "pruned"), cfg)) == []
    assert {r["term"]: r["df"] for r in stemmed.df.collect()}["engin"] == 1


def test_learn_recall_and_tune_with_vectors(spark, tmp_path, capsys):
    from lodestone import engine
    from lodestone.functions import models

    root = tmp_path / "docs"
    root.mkdir()
    for i in range(12):
        (root / f"n{i:02}.md").write_text(f"about topic{i} and subject{i}, see [[n{(i + 1) % 12:02}]]\n## More{i}\nfurther detail{i} on topic{i}")
    files = read_directory(spark, str(root))
    cfg = IndexConfig(model="hash-64", ivf_centroids=4, ivf_nprobe=4)
    flat, lists = engine.make_index(files, cfg), engine.make_index(files, cfg, True)
    assert flat.ivf is None and lists.ivf.centroids.count() == 4 and search.backend(lists) == "ivf(K=4,nprobe=4)" and search.backend(flat) == "flat"
    lists.save(str(tmp_path / "ivf"))
    flat.save(str(tmp_path / "flat"))
    assert not (tmp_path / "ivf" / "vectors").exists()  # they lie in the lists
    q = engine.with_vectors(engine.questions(spark, "topic3 subject3"), "hash-64")
    for mode in ("hybrid", "semantic", "bm25"):
        asked = QueryConfig(mode=mode, k=3, max_linked=1)
        shown = [ids(search.dispatch(i, q, asked)) for i in (flat, lists, index.load(spark, str(tmp_path / "flat")), index.load(spark, str(tmp_path / "ivf")))]
        assert shown[0][0] == 6 and len(shown[0]) >= 2 and all(x == shown[0] for x in shown)
    rows = engine.recall(flat, engine.questions(spark, "topic3 subject3"), QueryConfig(k=1, max_linked=2)).orderBy("rank").collect()
    assert [(r["file"], r["linked_from"]) for r in rows] == [("n03.md", None), ("n04.md", "n03.md")]
    # settings follow what the index has
    bare = engine.make_index(files, IndexConfig(stem=True))
    assert engine.settled(bare, QueryConfig()).mode == "bm25" and engine.settled(bare, QueryConfig()).title_boost == 2.0 and engine.settled(flat, QueryConfig()).mode == "hybrid"
    with pytest.raises(ValueError):
        engine.settled(bare, QueryConfig(mode="semantic"), mode_given=True)
    # tuning, of the search with linked rows, and of the build
    labels = spark.createDataFrame([(0, "n03.md", False)], "query_id long, label string, is_title boolean")
    base = QueryConfig(k=2, max_linked=1, require_tags=())
    for made in (flat, lists):
        best, score = tune.tune_query(made, q, labels, tune.sampled(base, 3), "mrr")
        assert score == pytest.approx(1.0) and best == base
    best, score = tune.tune_index(lambda c: engine.make_index(files, c), lambda x: engine.with_vectors(x, "hash-64"), engine.questions(spark, "topic3 subject3"), labels, tune.drawn(cfg, 2), base)
    assert score == pytest.approx(1.001) and best == cfg
    assert len(tune.drawn(cfg, 0)) == 9 and all(c.chunk_overlap < c.chunk_size for c in tune.drawn(cfg, 50))
    # the index is checked as it is loaded
    import shutil

    shutil.rmtree(tmp_path / "ivf" / "ivf" / "lists" / "cid=0", ignore_errors=True)
    with pytest.raises(ValueError):
        index.load(spark, str(tmp_path / "ivf"))
    wrong = q.withColumn("qvec", F.array(F.lit(1.0)))
    assert search.dispatch(lists, wrong, QueryConfig(mode="semantic", k=3)).count() == 0


def test_ivf_recall_on_clustered_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    centers = rng.normal(size=(20, 16))
    x = centers[np.arange(1000) % 20] + 0.2 * rng.normal(size=(1000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vecs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, vec array<double>")
    q = vecs.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("qvec"))
    built = ivf.build(vecs, ivf.train(vecs, 20), 4)
    flat = {(r["query_id"], r["chunk_id"]) for r in search.search_semantic(vecs, q, 10).collect()}
    found = {(r["query_id"], r["chunk_id"]) for r in built.search(q, 10).collect()}
    want = {(int(i), int(j)) for i in range(0, 1000, 20) for j in np.lexsort((np.arange(1000), -np.round(x @ x[i], 9)))[:10]}
    assert flat == want and len(flat & found) / len(flat) >= 0.9
    few = ivf.CENTROID_BYTES
    try:
        ivf.CENTROID_BYTES = 0  # centroids dealt out in blocks
        assert ivf.assign(vecs, built.centroids).select("cid", "chunk_id").exceptAll(built.lists.select("cid", "chunk_id")).count() == 0
    finally:
        ivf.CENTROID_BYTES = few


def test_models_and_tokenizers(tmp_path, monkeypatch):
    from lodestone.functions import models

    assert models.resolve("").dim == 384 and models.resolve("none").dim == 0 and models.resolve("hash-16").dim == 16 and len(models.MODELS) == 5
    with pytest.raises(ValueError):
        models.resolve("other")
    monkeypatch.setenv("LODESTONE_MODELS", str(tmp_path))
    assert len(models.missing(models.resolve(""))) == 2
    with pytest.raises(FileNotFoundError):
        models.embedder("bge-base-en-v1.5")
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"model": {"vocab": {"a": 0}}, "truncation": {"max_length": 64}}))
    assert models.load_tokenizer(path) == ({"a": 0}, 64) and models.load_tokenizer(path, 512)[1] == 512
    path.write_text("{}")
    with pytest.raises(ValueError):
        models.load_tokenizer(path)


def test_passages_find_their_chunks(spark, chunks):
    rows = [(0, "apple branches in"), (1, "Engine\nchange the oil of the"), (2, "oil of"), (3, "ear"), (4, "pple branch"), (5, "no such words here"), (6, "the oil, of the")]
    q = spark.createDataFrame(rows, "query_id long, query string")
    from lodestone.operators import evaluate

    got = {(r["query_id"], r["chunk_id"]) for r in evaluate.holders(index.build(chunks), q).collect()}
    text = {r["chunk_id"]: f"{r['title']}\n{r['body']}" for r in chunks.collect()}
    assert got == {(i, c) for i, t in rows for c, x in text.items() if t in x} and (4, 0) in got


def test_stems_and_embedders(spark):
    assert [stem(w) for w in ("running", "connections", "hopping", "happily", "ipv4", "a-b", "skies", "generously")] == ["run", "connect", "hop", "happili", "ipv4", "a-b", "sky", "generous"]
    df = spark.createDataFrame([("same words",), ("same words",)], "t string")
    a, b = HashingEmbedder(16).embed(df, "t").collect()
    assert a["vec"] == b["vec"] and NoEmbedder().embed(df, "t").first()["vec"] is None
    ids_, mask = WordPiece({"[PAD]": 0, "[UNK]": 1, "[CLS]": 2, "[SEP]": 3, "play": 4, "##ing": 5, "!": 6}, 8).encode("Playing! x")
    assert ids_ == [2, 4, 5, 6, 1, 3, 0, 0] and sum(mask) == 6


def test_entry_has_sql_for_known_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
