"""The opN_<name> queries: each operator over its whole table with production parameters, and SQL where it can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, html_extract, jaccard_join, kd_search, kneser_ney, language_id, mixing, secrets, substring_dedup, transcripts
from lodestone.llm._spark import broadcast_if_small, materialize, table


def op1_kd_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = kd_search.quantized(table(spark, sf_dir, "embeddings"))
    return kd_search.kd_top_k(vectors, F.col("vec_id") % 20 == 0, k=20)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), n=10)
    digests = found.items.select(F.col("combo").alias("of"), F.size("items").cast("long").alias("n"), F.sha2(F.array_join("items", ","), 256).alias("sha"))
    n_hit = decontaminate.covered(F.col("hits"))
    return found.docs.join(broadcast_if_small(materialize(digests, "digests")), F.col("combo") == F.col("of"), "left").select(
        F.col("id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.score_documents(table(spark, sf_dir, "documents"), folds=10)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), num=75, den=100, width=5)
    return found.select("doc_id", "n_shingles", "component_id")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = language_id.train(docs.filter(fold != 2))
    rows = docs.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "text")
    return language_id.predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    fold = F.crc32(F.col("conv_id").cast("string")) % 4
    model = transcripts.train(turns.filter(fold != 2))
    out = transcripts.format_chats(turns, model)
    return out.select("conv_id", "turn", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), F.array_join("roles", ",").alias("roles"), "rendered")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, secrets.KINDS), F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), length=50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_kd_top_k": op1_kd_top_k,
    "op2_decontaminate": op2_decontaminate,
    "op3_kneser_ney": op3_kneser_ney,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_html_extract": op5_html_extract,
    "op6_language_id": op6_language_id,
    "op7_mixing": op7_mixing,
    "op8_chat_format": op8_chat_format,
    "op9_secrets": op9_secrets,
    "op10_substring_dedup": op10_substring_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_kd_top_k": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), s AS (
          SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
          FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op2_decontaminate": r"""
        WITH d AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), b AS (
          SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), bw AS (
          SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS k
          FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
        ), dw AS (
          SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))
        ), h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
        c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
    """,
    "op4_jaccard_join": r"""
        WITH RECURSIVE d AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
          SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS k
          FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
        r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
        FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT node, min(root) AS component_id FROM r GROUP BY node) m ON m.node = d.doc_id
    """,
    "op7_mixing": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
        s AS (
          SELECT source, sum(size)::DOUBLE AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source
        ), r AS (
          SELECT *, 3.0::DOUBLE * source_size AS most,
                 sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
                 coalesce(sum(3.0::DOUBLE * source_size) OVER o, 0) AS cap_before, coalesce(sum(w) OVER o, 0) AS w_before
          FROM s WINDOW o AS (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), l AS (SELECT *, (total - cap_before) / (all_w - w_before) AS level FROM r),
        f AS (SELECT arg_min(level, most / w) AS level FROM l WHERE most / w > level),
        t AS (
          SELECT source, source_size::BIGINT AS source_size,
                 CASE WHEN (SELECT level FROM f) IS NULL OR most <= w * (SELECT level FROM f) THEN most ELSE w * (SELECT level FROM f) END AS target FROM l
        ), x AS (
          SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
                 ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target, ((floor(rate) + (u < rate - floor(rate))::INT) * size)::BIGINT AS taken FROM x
    """,
    "op10_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        x AS (
          SELECT doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS k
          FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
        ), m AS (SELECT k, min(doc_id) AS least FROM x GROUP BY k),
        g AS (SELECT DISTINCT doc_id, p FROM (SELECT x.doc_id, unnest(range(i, i + 50)) AS p FROM x JOIN m ON x.k = m.k WHERE x.doc_id > m.least)),
        r AS (SELECT doc_id, count(*) AS n, list(p) AS gone FROM g GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
               sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ') ELSE coalesce((
                 SELECT string_agg(u.w, ' ' ORDER BY u.i) FROM (SELECT unnest(d.w) AS w, generate_subscripts(d.w, 1) AS i) u WHERE NOT list_contains(r.gone, u.i)), '') END) AS kept_sha256
        FROM d LEFT JOIN r ON d.doc_id = r.doc_id
    """,
}
