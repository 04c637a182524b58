"""Line differences of pairs of texts as rows, and their application.

Lines that occur once on both sides of a stretch are candidates for anchors; the
longest series of them that keeps its order on both sides is matched, and cuts
the stretch into smaller ones. Equal lines at the ends of a stretch are matched
too. This goes on until no stretch gives another match; what is left between two
matches is a hunk. Both texts of a pair are in one row, so nothing is shuffled:
tasks cut their rows' stretches and hand on hunks only.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.session import Rounds

#: Pairs whose hunks a task hands on at once.
TOGETHER = 64


def increasing(after: list[int]) -> list[int]:
    """Places of a longest increasing series."""
    tails, at, before = [], [], [-1] * len(after)
    for k, x in enumerate(after):
        p = bisect_left(tails, x)
        before[k] = at[p - 1] if p else -1
        tails[p:p + 1], at[p:p + 1] = [x], [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def _stretches(a: list[bytes], b: list[bytes]) -> list[tuple[int, int, int, int]]:
    """(i, end of i, j, end of j): stretches of lines that are left without a match, in order."""
    todo, out = [(0, len(a), 0, len(b))], []
    while todo:
        i, i1, j, j1 = todo.pop()
        while i < i1 and j < j1 and a[i] == b[j]:
            i, j = i + 1, j + 1
        while i < i1 and j < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
        n, m = Counter(a[i:i1]), Counter(b[j:j1])
        place = {x: k for k, x in enumerate(b[j:j1], j) if m[x] == 1}
        both = [(k, place[x]) for k, x in enumerate(a[i:i1], i) if n[x] == 1 and x in place]
        anchors = [both[k] for k in increasing([y for _, y in both])]
        if anchors:
            # The stretch before the first anchor is cut next, so that stretches come in order.
            starts = [(i, j), *((x + 1, y + 1) for x, y in anchors)]
            todo += [(x, x1, y, y1) for (x, y), (x1, y1) in zip(starts, [*anchors, (i1, j1)], strict=True)][::-1]
        elif i < i1 or j < j1:
            out.append((i, i1, j, j1))
    return out


def _hunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["pair", "hunk", "start", "removed", "at", "added"]
    for batch in batches:
        for first in range(0, len(batch), TOGETHER):
            part = batch.slice(first, TOGETHER)
            own, found = [], []
            for k, (x, y) in enumerate(zip(part.column("x"), part.column("y"), strict=True)):
                a, b = x.as_py().split(b"\n"), y.as_py().split(b"\n")
                for n, (i, i1, j, j1) in enumerate(_stretches(a, b), 1):
                    own.append(k)
                    found.append((n, i + 1, a[i:i1], j + 1, b[j:j1]))
            if found:
                columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.int32(), pa.list_(pa.binary())), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("pair").take(pa.array(own, pa.int64())), *columns], names)


def hunks(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, hunk, start, removed, at, added): what turns each text into the other, in order.

    ``start`` and ``at`` are lines (from 1) of the first and the second text;
    ``removed`` and ``added`` their lines, of which one list may be empty. Lines end
    at a line feed. Null texts are empty; pairs without a difference have no hunks;
    keys must be unique and not null.
    """
    rounds = Rounds(pairs.sparkSession, "diff")
    given = pairs.select(F.col(key).alias("pair"), F.coalesce(before, F.lit("")).alias("x"), F.coalesce(after, F.lit("")).alias("y")).where("x <> y")
    kind = given.schema["pair"].dataType.simpleString()
    out = given.select("pair", F.col("x").cast("binary").alias("x"), F.col("y").cast("binary").alias("y"))
    out = out.mapInArrow(_hunks, f"pair {kind}, hunk int, start int, removed array<binary>, at int, added array<binary>")
    lines = {c: F.col(c).cast("array<string>") for c in ("removed", "added")}
    return rounds.last(out.withColumns(lines).withColumnRenamed("pair", key))


def applied(text: Column, found: Column) -> Column:
    """A text with its hunks (an array of structs hunk, start, removed, added; null for none) carried out; null where they don't fit."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    ordered = F.array_sort(F.transform(found, lambda h: F.struct(h["hunk"], h["start"], h["removed"], h["added"])))
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit(1).alias("next"), F.lit(True).alias("fits"))

    def step(acc: Column, h: Column) -> Column:
        kept = F.slice(lines, acc["next"], F.greatest(h["start"] - acc["next"], F.lit(0)))
        there = F.slice(lines, h["start"], F.size(h["removed"]))
        return F.struct(F.concat(acc["out"], kept, h["added"]).alias("out"), (h["start"] + F.size(h["removed"])).alias("next"), (acc["fits"] & (there == h["removed"])).alias("fits"))

    done = F.aggregate(ordered, zero, step)
    rest = F.slice(lines, done["next"], F.greatest(F.size(lines) - done["next"] + 1, F.lit(0)))
    whole = F.when(done["fits"], F.array_join(F.concat(done["out"], rest), "\n"))
    return F.when(found.isNull(), F.coalesce(text, F.lit(""))).otherwise(whole)


def apply(texts: DataFrame, found: DataFrame, key: str, text: str, name: str = "text") -> DataFrame:
    """(key, name): each text with its ``hunks`` carried out."""
    by = found.groupBy(key).agg(F.collect_list(F.struct("hunk", "start", "removed", "added")).alias("hunks"))
    return texts.select(key, F.col(text).alias("_text")).join(by, key, "left").select(key, applied(F.col("_text"), F.col("hunks")).alias(name))


def unified(found: DataFrame, key: str) -> DataFrame:
    """(key, diff): hunks as text, a head and the removed and added lines of each, without context."""
    count = lambda at, lines: F.concat(F.when(F.size(lines) == 0, F.col(at) - 1).otherwise(F.col(at)).cast("string"), F.when(F.size(lines) != 1, F.concat(F.lit(","), F.size(lines).cast("string"))).otherwise(""))
    head = F.concat(F.lit("@@ -"), count("start", "removed"), F.lit(" +"), count("at", "added"), F.lit(" @@"))
    lines = F.concat(F.array(head), F.transform("removed", lambda x: F.concat(F.lit("-"), x)), F.transform("added", lambda x: F.concat(F.lit("+"), x)))
    return found.select(key, F.struct("hunk", F.array_join(lines, "\n").alias("text")).alias("x")).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]), "\n").alias("diff"))
