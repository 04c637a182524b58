"""The tools that an assistant may call: plain functions with bounded results, no server."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import governance, knowledge, search
from quillon.operators.index import TextIndex

# Rows that a search returns at most, items of a dossier, and bytes and characters of a proposal.
MOST_RESULTS, MOST_ITEMS, MOST_BYTES, MOST_EXCERPT = 20, 100, 64 << 10, 4000


@dataclass
class Book:
    """The tables that the tools read, by the names that the operators use; with an ``index`` over its documents, searches go there."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    index: TextIndex | None = None

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise LookupError(f"the book has no table {name}")
        return self.tables[name]


def _rows(df: DataFrame, most: int) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.limit(most).collect()]


def _clip(value, most: int):
    return value[:most] if isinstance(value, list) else value


def search_book_context(book: Book, query: str, limit: int = 8) -> list[dict]:
    """Passages for the words of a question, best first."""
    terms = [t for t in query.lower().split() if t]
    if not terms:
        raise ValueError("the question is empty")
    most = max(1, min(limit, MOST_RESULTS))
    if book.index is not None:
        return _rows(book.index.search(query, most).withColumnRenamed("doc", "doc_id"), MOST_RESULTS)
    return _rows(search.bm25_top_k(book["documents"], terms, most), MOST_RESULTS)


def get_entity_dossier(book: Book, name: str, cutoff: tuple | None = None) -> dict:
    """What is known of an entity, up to a place in the narrative."""
    key = name.strip().lower()
    if not key:
        raise ValueError("the name is empty")
    entities, aliases = book["entities"], book["aliases"]
    wanted = book.spark.createDataFrame([(key,)], "key string")
    maps = [entities.select(F.lower("name").alias("key"), F.col("entity").alias("id")), aliases.select(F.lower("alias").alias("key"), F.col("entity").alias("id")), entities.select(F.lower(F.col("entity").cast("string")).alias("key"), F.col("entity").alias("id"))]
    found = knowledge.lookup(wanted, maps, book.tables.get("redirects")).collect()
    if not found:
        raise LookupError(f"no such entity: {name}")
    one = entities.where(F.col("entity") == F.lit(found[0]["id"]))
    full = knowledge.dossier(one, aliases, book["relations"], book["mentions"], book.tables.get("states"), book.tables.get("claims"), cutoff)
    return {k: _clip(v, MOST_ITEMS) for k, v in full.first().asDict(recursive=True).items()}


def get_scene_context(book: Book, scene) -> dict:
    """A scene with its links and derivations."""
    one = book["scenes"].where(F.col("scene") == F.lit(scene))
    rows = _rows(knowledge.scene_context(one, book["links"], book["derivations"]), 1)
    if not rows:
        raise LookupError(f"no such scene: {scene}")
    return rows[0]


def verify_book_index(book: Book) -> dict:
    """How many rows each table has."""
    return {name: df.count() for name, df in sorted(book.tables.items())}


def audit_book_continuity(book: Book) -> list[dict]:
    """Claims that contradict each other."""
    return _rows(knowledge.continuity(book["continuity_claims"]), MOST_ITEMS)


def audit_book_health(book: Book) -> list[dict]:
    """Broken invariants."""
    return _rows(knowledge.invariants(book.tables), MOST_ITEMS)


def propose_book_knowledge(book: Book, proposal: str, payload: dict, excerpt: str = "") -> dict:
    """A suggestion as a chained event; it is returned, not stored."""
    text = json.dumps(payload, sort_keys=True, ensure_ascii=False)
    if len(text.encode()) > MOST_BYTES or len(excerpt) > MOST_EXCERPT:
        raise ValueError("the proposal is too large")
    seq = (book["governance"].agg(F.max("seq")).first()[0] or 0) + 1
    event = book.spark.createDataFrame([(proposal, seq, "suggested", text)], "chain string, seq long, state string, payload string")
    log = book["governance"].withColumn("chain", F.col("chain").cast("string"))
    return _rows(governance.append_chained(log, event, "chain", "seq", "payload"), 1)[0]


#: The tools by name.
TOOLS: dict[str, Callable] = {f.__name__: f for f in (search_book_context, get_entity_dossier, get_scene_context, verify_book_index, audit_book_continuity, audit_book_health, propose_book_knowledge)}


def call(book: Book, tool: str, /, **arguments):
    """Call a tool by its name."""
    if tool not in TOOLS:
        raise LookupError(f"no such tool: {tool}")
    return TOOLS[tool](book, **arguments)
