"""Line dedup by distinct-site spread, with DataFrame functions only.

A line that stands on many sites is boilerplate. Lines are counted per (line
hash, site) before anything is shuffled by line, so a line on every page is a row
a site and task. HyperLogLog sketches of the sites merge per line hash. An
estimate clear of the threshold decides; lines whose estimate lies within
``MARGIN`` of it get an exact distinct count. Lines that reach ``SITES`` distinct
sites are removed from every document. Lines on very many sites or documents are
the hot keys of the joins by line, and are broadcast (``attach_groups``).

Defined results: lines end at "\\n"; a line counts by its text without blanks at
its ends, and blank lines are never removed; null sites are no site; null text
counts as empty; equal rows get equal results; a document whose lines all go
keeps an empty text; an empty table gives an empty result; extra columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.groups import attach_groups
from quillon.llm.scratch import written

#: Distinct sites from which on a line is boilerplate.
SITES = 8
#: log2 of a sketch's registers; the error of an estimate is 1.04 / 2**(LG_K / 2), 1.6 % here.
LG_K = 12
#: Relative distance from the threshold within which lines are counted exactly: over six errors.
MARGIN = 0.12


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(docs: DataFrame, site_col: str = "source", text_col: str = "text", sites: int = SITES) -> DataFrame:
    """(h, n_sites, n_lines): hashes of lines on at least ``sites`` distinct sites, and how often they stand in all documents; n_sites is exact near the threshold."""
    lines = docs.select(F.col(site_col).cast("string").alias("site"), F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line"))
    lines = lines.where(F.trim("line") != "")
    pairs = written(lines.select(line_hash(F.col("line")).alias("h"), "site").groupBy("h", "site").agg(F.count(F.lit(1)).alias("c")), "line-sites")
    n_pairs = pairs.count()
    # A line of one site in all can't reach a threshold above 1; dropping it early keeps sketches few.
    spread = pairs.groupBy("h").agg(F.min("site").alias("low"), F.max("site").alias("high"), F.count(F.lit(1)).alias("group_size"), F.sum("c").alias("n_lines"))
    spread = written(spread.where("low <> high" if sites > 1 else "low is not null").select("h", "group_size", "n_lines"), "line-spread")
    some = attach_groups(pairs, spread, "h", n_pairs).where("site is not null")
    sketch = some.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("n_sites"), F.first("n_lines").alias("n_lines"))
    sketch = written(sketch.where(F.col("n_sites") >= sites * (1 - MARGIN)), "line-sketches")
    clear = sketch.where(F.col("n_sites") > sites * (1 + MARGIN))
    # These have about ``sites`` rows each, so none of them is hot.
    near = sketch.where(F.col("n_sites") <= sites * (1 + MARGIN)).select("h")
    exact = some.join(near, "h").groupBy("h").agg(F.count_distinct("site").alias("n_sites"), F.first("n_lines").alias("n_lines")).where(F.col("n_sites") >= sites)
    return clear.unionByName(exact)


def remove_lines(docs: DataFrame, id_col: str = "doc_id", site_col: str = "source", text_col: str = "text", sites: int = SITES) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed (long), text without boilerplate lines."""
    gone = written(boilerplate(docs, site_col, text_col, sites).select("h", F.col("n_lines").alias("group_size")), "boilerplate")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select(F.xxhash64("doc_id", "text").alias("d"), "doc_id", "text")
    # Only (document, line hash) meets the boilerplate; which lines go then comes back as a small set a document.
    lines = rows.select("d", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), line_hash))).alias("h"))
    n_lines = gone.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    hit = attach_groups(lines, gone, "h", n_lines).groupBy("d").agg(F.collect_set("h").alias("gone"))
    none = F.array().cast("array<bigint>")
    both = rows.join(hit, "d", "left").select("doc_id", F.split("text", "\n").alias("lines"), F.coalesce("gone", none).alias("gone"))
    kept = F.filter("lines", lambda x: ~F.array_contains("gone", line_hash(x)) | (F.trim(x) == ""))
    both = both.withColumn("kept", kept)
    return both.select("doc_id", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_removed"), F.array_join("kept", "\n").alias("text"))
