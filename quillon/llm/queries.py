"""The queries opN_<name> and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import chat, collisions, decontaminate, exact_dedup, hard_negatives, line_dedup, mixing, ngram_join, pii, quality, suffix_dedup, toxicity, whitening
from quillon.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return put


@query(
    "op4_exact_dedup",
    """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
    FROM d JOIN g USING (t)
    """,
)
def op4(spark: SparkSession, root: str) -> DataFrame:
    return exact_dedup.keep_table(table(spark, root, "documents"))


@query(
    "op9_benchmark_decontamination",
    """
    WITH dw AS (
      SELECT doc_id, w, generate_subscripts(w, 1) AS p FROM (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents)),
    iw AS (
      SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
    win AS (
      SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS t
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM iw WHERE len(w) > 0)),
    dwin AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS t FROM dw, (SELECT DISTINCT n FROM win) WHERE p + n - 1 <= len(w)),
    hit AS (SELECT doc_id, p, n, item_id FROM dwin JOIN win USING (n, t)),
    pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
    it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM hit GROUP BY doc_id)
    SELECT doc_id, coalesce(c.n, 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM dw GROUP BY doc_id) c USING (doc_id) LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
    """,
)
def op9(spark: SparkSession, root: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(table(spark, root, "documents"), table(spark, root, "benchmark")))


@query(
    "op3_ngram_jaccard_join",
    """
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    l AS (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 80 * (a.n + b.n - i)),
    r AS (SELECT doc_id, doc_id AS z FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.z)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(z) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
    """,
)
def op3(spark: SparkSession, root: str) -> DataFrame:
    return ngram_join.sets_and_components(table(spark, root, "documents")).drop("set_name")


@query("op8_quality_classifier")
def op8(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    return quality.score(docs, quality.train(docs, table(spark, root, "labels"), "quality"))


@query("op10_toxicity")
def op10(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, root, "labels"), "toxic"))


@query("op2_pii")
def op2(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    return pii.digest(pii.find(docs, pii.fit(docs)))


@query("op6_suffix_array_dedup")
def op6(spark: SparkSession, root: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, root, "documents")))


@query("op1_mixing")
def op1(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix(table(spark, root, "documents").select("doc_id", "text", "source"), table(spark, root, "labels"), keep_text=False)


@query("op5_chat_formatting")
def op5(spark: SparkSession, root: str) -> DataFrame:
    return chat.repair(table(spark, root, "conversations"))


@query(
    "op7_line_dedup",
    """
    WITH l AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents),
    gone AS (SELECT trim(line) AS t FROM l WHERE trim(line) <> '' AND source IS NOT NULL GROUP BY trim(line) HAVING count(DISTINCT source) >= 8)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE g.t IS NOT NULL) AS n_removed,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE g.t IS NULL), '')) AS kept_sha256
    FROM l LEFT JOIN gone g ON trim(line) = g.t GROUP BY doc_id
    """,
)
def op7(spark: SparkSession, root: str) -> DataFrame:
    out = line_dedup.remove_lines(table(spark, root, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query(
    "op11_embedding_near_dedup",
    """
    WITH RECURSIVE v AS (
      SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
    l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
    r AS (SELECT vec_id, vec_id AS z FROM embeddings UNION SELECT r.vec_id, l.y FROM r JOIN l ON l.x = r.z),
    c AS (SELECT vec_id, min(z) AS component_id FROM r GROUP BY vec_id),
    n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
    SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n ON x = vec_id
    """,
)
def op11(spark: SparkSession, root: str) -> DataFrame:
    return collisions.near_copies(table(spark, root, "embeddings"))


@query("op12_embedding_whitening")
def op12(spark: SparkSession, root: str) -> DataFrame:
    # The contract's long holds deviations up to 2^63; the operator's decimal goes on.
    return whitening.whiten(table(spark, root, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


@query(
    "op13_hard_negatives",
    """
    WITH v AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS e FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    s AS (
      SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
    """,
)
def op13(spark: SparkSession, root: str) -> DataFrame:
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, root, "embeddings"), F.col("vec_id") % 50 == 0, changed)
