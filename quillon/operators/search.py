"""Lexical and vector retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def term_counts(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its length in ``[a-z]+`` words and the count of each query term.

    Words are counted by pattern inside the row: no word is made, exploded or
    shuffled. Terms are plain ``[a-z]+`` words. Null text has no words.
    """
    low = F.lower(F.col(text_col))
    counts = [F.regexp_count(low, F.lit(f"(?<![a-z]){t}(?![a-z])")).alias(f"tf_{i}") for i, t in enumerate(terms)]
    return docs.select(F.col(id_col), F.regexp_count(low, F.lit("[a-z]++")).alias("len"), *counts).where("len > 0")


def bm25_top_k(docs: DataFrame, terms: list[str], k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Top ``k`` documents by BM25 (k1 1.2, b 0.75) over an OR of ``terms``; ties by id."""
    terms = list(dict.fromkeys(terms))
    per_doc = term_counts(docs, terms, id_col, text_col)
    stats = per_doc.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("len").alias("avgdl"),
        *[F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(terms))],
    )
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf_{i}"), F.col(f"df_{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))).otherwise(0.0)
    hit = F.greatest(*[F.col(f"tf_{i}") for i in range(len(terms))], F.lit(0)) > 0
    # stats is one row: a broadcast of constant size.
    return per_doc.where(hit).crossJoin(F.broadcast(stats)).select(id_col, F.round(score, 6).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def active_documents(docs: DataFrame, active: str = "active", priority: str = "priority") -> DataFrame:
    """Active documents of the highest priority; all documents if none is active."""
    from quillon.operators.relational import at_maximum

    live = docs.where(F.col(active))
    best = at_maximum(live, priority)
    none = live.limit(1).agg((F.count(F.lit(1)) == 0).alias("_none"))
    rest = docs.crossJoin(F.broadcast(none)).where("_none").drop("_none")  # one row
    return best.unionByName(rest)


def nearest(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` vectors at the smallest cosine distance, exactly: one scan, a top-k per task."""
    from quillon.functions.numeric import cosine_distance

    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(id_col, F.round(cosine_distance(F.col(vec_col), q), 6).alias("distance")).where("distance IS NOT NULL").orderBy("distance", id_col).limit(k)


def rank(hits: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Positions from 1 in a list of at most some hundred candidates."""
    from pyspark.sql import Window as W

    return hits.withColumn(name, F.row_number().over(W.orderBy(*order)))


def fuse(lexical: DataFrame, semantic: DataFrame, id_col: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (id, rank_l) and (id, rank_s)."""
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return lexical.join(semantic, id_col, "full_outer").withColumn("score", F.round(part("rank_l") + part("rank_s"), 9))


def capped(hits: DataFrame, group: str, id_col: str, per_group: int, limit: int) -> DataFrame:
    """The best hits, at most ``per_group`` of a group."""
    from quillon.operators.relational import top_per_key

    return top_per_key(hits, [group], [F.desc("score"), F.col(id_col)], per_group).orderBy(F.desc("score"), id_col).limit(limit)


def candidate_limits(limit: int) -> tuple[int, int]:
    """Candidates of the lexical and the vector search for a result of ``limit`` (1 to 100)."""
    limit = max(1, min(100, limit))
    lexical = min(400, 4 * limit)
    return lexical, 5 * lexical


def hybrid(docs: DataFrame, vectors: DataFrame, terms: list[str], query: list[float], group: str, limit: int = 8, per_group: int = 2, text_index=None, vector_index=None) -> DataFrame:
    """Lexical and vector hits of documents (doc_id, text, group) and vectors (doc_id, embedding), fused.

    With a ``TextIndex`` or a ``VectorIndex`` (in exact mode) the candidates come from there, the same ones, and texts or vectors aren't scanned.
    """
    n_lex, n_vec = candidate_limits(limit)
    words = bm25_top_k(docs, terms, n_lex) if text_index is None else text_index.search(terms, n_lex).withColumnRenamed("doc", "doc_id")
    near = nearest(vectors, query, n_vec, "doc_id") if vector_index is None else vector_index.search(query, n_vec, exact=True).withColumnRenamed("id", "doc_id")
    lex = rank(words, [F.desc("score"), F.col("doc_id")], "rank_l").select("doc_id", "rank_l", F.col("score").alias("lexical_score"))
    sem = rank(near, [F.col("distance"), F.col("doc_id")], "rank_s").select("doc_id", "rank_s", "distance")
    both = fuse(lex, sem, "doc_id").join(docs.select("doc_id", group), "doc_id")
    return capped(both, group, "doc_id", per_group, limit)


def embed_pending(passages: DataFrame, cache: DataFrame, embed, dim: int, batch: int = 64) -> DataFrame:
    """(sha, embedding) of contents that the cache lacks, each embedded once.

    ``embed``: list of texts to list of vectors; called in batches on the executors.
    """
    import pandas as pd

    todo = passages.select("sha", "content").dropDuplicates(["sha"]).join(cache.select("sha"), "sha", "left_anti")

    def run(frames):
        for frame in frames:
            for s in range(0, len(frame), batch):
                part = frame.iloc[s : s + batch]
                out = embed(part["content"].tolist())
                if any(len(v) != dim for v in out):
                    raise ValueError(f"an embedding isn't of dimension {dim}")
                yield pd.DataFrame({"sha": part["sha"], "embedding": [list(map(float, v)) for v in out]})

    return todo.mapInPandas(run, "sha string, embedding array<float>")
