"""Named queries over the driver's tables, each with a DuckDB oracle where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query (and its oracle SQL) under ``name``."""

    def put(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return put


@query(
    "q2_lexical",
    """
    WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents),
    dl AS (SELECT doc_id, count(*) AS len FROM tok GROUP BY doc_id),
    st AS (SELECT count(*) AS n, avg(len) AS avgdl FROM dl),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term IN ('tion', 'ment', 'ung') GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
    SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))), 6) AS score
    FROM tf JOIN df USING (term) JOIN dl USING (doc_id) CROSS JOIN st GROUP BY doc_id
    ORDER BY score DESC, doc_id LIMIT 20
    """,
)
def _lexical(spark: SparkSession, root: str) -> DataFrame:
    from quillon.operators.search import bm25_top_k

    return bm25_top_k(table(spark, root, "documents"), ["tion", "ment", "ung"], 20)


def _load() -> None:
    """Import the modules that register queries."""
    import importlib

    for name in MODULES:
        importlib.import_module(f"quillon.plans.{name}")


MODULES = ("relational", "text", "audit", "knowledge", "production", "indexes", "files")
_load()
