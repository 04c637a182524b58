"""Many patterns at once: one pass of an Aho-Corasick automaton over each text, whatever the number of patterns."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Aliases, and characters of aliases, that every task gets whole; beyond, texts meet only those that can occur in them.
MOST_ALIASES, MOST_CHARACTERS = 100_000, 4_000_000
#: A word, as boundaries of a mention see it.
WORD = r"[\p{L}\p{N}_]+"


def _in_word(c: str) -> bool:
    return c.isalnum() or c == "_"


class Finder:
    """Whole-word occurrences of given strings."""

    def __init__(self, names: list[str]):
        self.sizes = [len(n) for n in names]
        self.automaton = ahocorasick.Automaton()
        for k, n in enumerate(names):
            self.automaton.add_word(n, k)
        if names:
            self.automaton.make_automaton()

    def find(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(number of the string, start, end), of each string those that don't overlap, from the left."""
        if not self.sizes:
            return
        last: dict[int, int] = {}
        n = len(text)
        for at, k in self.automaton.iter(text):
            start, end = at + 1 - self.sizes[k], at + 1
            if (end < n and _in_word(text[end])) or (start and _in_word(text[start - 1])) or start < last.get(k, 0):
                continue
            last[k] = end
            yield k, start, end


def _out(batch: pa.RecordBatch, hits: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    row, name, start, end = map(list, zip(*hits, strict=True)) if hits else ([], [], [], [])
    return pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row, pa.int64())), pa.array(name, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["id", "alias", "start", "end"])


def _by_all(names: list[str]):
    """Every text against the same strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(names)
        for batch in batches:
            yield _out(batch, [(i, names[k], s, e) for i, t in enumerate(batch.column("t").to_pylist()) for k, s, e in finder.find(t)])

    return run


def _by_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every text against the strings that came with it; the strings of a batch share an automaton."""
    for batch in batches:
        wanted = [set(x) for x in batch.column("names").to_pylist()]
        names = sorted(set().union(*wanted)) if wanted else []
        finder = Finder(names)
        yield _out(batch, [(i, names[k], s, e) for i, t in enumerate(batch.column("t").to_pylist()) for k, s, e in finder.find(t) if names[k] in wanted[i]])


def occurrences(texts: DataFrame, names: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, alias, start, end) of every whole-word occurrence of ``names`` (alias; in lower case) in lower-cased texts.

    Up to ``MOST_ALIASES`` strings go to every task, whose automaton reads each text
    once: no shuffle. Of more, texts are joined with those whose first word they
    hold, and a batch of texts builds an automaton of its own strings.
    """
    alias = names.select("alias").where("alias <> ''").distinct()
    rows = texts.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    out = f"id {rows.schema['id'].dataType.simpleString()}, alias string, start int, end int"
    n, characters = alias.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("alias")), F.lit(0))).first()
    if n <= MOST_ALIASES and characters <= MOST_CHARACTERS:
        return rows.mapInArrow(_by_all(sorted(r[0] for r in alias.collect())), out)
    # A string without any word can occur in every text.
    words = F.array_union(F.regexp_extract_all("t", F.lit(WORD), F.lit(0)), F.array(F.lit("")))
    keyed = rows.withColumn("key", F.xxhash64("id", "t"))
    heads = keyed.select("key", F.explode(words).alias("head"))
    met = heads.join(alias.withColumn("head", F.regexp_extract("alias", WORD, 0)), "head").groupBy("key").agg(F.collect_set("alias").alias("names"))
    return keyed.join(met, "key").mapInArrow(_by_own, out)
