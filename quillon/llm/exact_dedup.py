"""Exact dedup by two-pass Bloom filtering, with DataFrame functions only.

Pass one folds every text hash into a Bloom filter of 64-bit words that keeps,
for each bit, whether it was set at all and whether it was set twice. Pass two
probes the "twice" bits: a hash that occurs twice always finds all its bits
there, a single one hardly ever. Only the rows that pass are shuffled and
grouped by SHA-256; the rest are unique for certain and go straight through.

Defined results: null text counts as empty; equal texts are those whose UTF-8
bytes are equal; of equal texts the row with the largest doc_id stays (null is
smaller than any id, and of rows with equal ids exactly one stays); an empty
table gives an empty result; other columns are never read by ``keep_table``
and are carried unchanged by ``keep_rows``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.groups import attach_groups
from quillon.llm.scratch import written

#: Words of the filter at most: 2**20 rows of 16 bytes are broadcast. Beyond some
#: 16 million rows the filter fills up; more rows are shuffled, results stay exact.
MAX_WORDS = 1 << 20
#: Bits set per hash, all in one word.
BITS = 3


def filter_words(n_rows: int) -> int:
    """Words of the filter: a power of two with about 16 bits a row, within bounds."""
    words = 1 << max(6, (max(1, n_rows) // 4).bit_length())
    return min(MAX_WORDS, words)


def probe(h: Column, words: int) -> tuple[Column, Column]:
    """The word a hash falls in, and its bits there."""
    one = F.lit(1).cast("long")
    mask = F.lit(0).cast("long")
    for i in range(BITS):
        mask = mask.bitwiseOR(F.call_function("shiftleft", one, F.shiftrightunsigned(h, 40 + 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return h.bitwiseAND(F.lit(words - 1).cast("long")), mask


def twice_bits(hashes: DataFrame, words: int) -> DataFrame:
    """Rows (word, twice): the bits that more than one row has set.

    Equal (word, bits) are counted before the shuffle, so a hot text is one row
    a task; a word has at most C(64, 3) distinct bit sets, which bounds its list.
    """
    word, mask = probe(F.col("h"), words)
    once = hashes.select(word.alias("word"), mask.alias("mask")).groupBy("word", "mask").agg(F.count(F.lit(1)).alias("c"))
    zero = F.lit(0).cast("long")
    fold = F.aggregate(
        F.collect_list(F.struct("mask", "c")),
        F.struct(zero.alias("one"), zero.alias("two")),
        lambda acc, x: F.struct(
            acc["one"].bitwiseOR(x["mask"]).alias("one"),
            acc["two"].bitwiseOR(acc["one"].bitwiseAND(x["mask"])).bitwiseOR(F.when(x["c"] > 1, x["mask"]).otherwise(zero)).alias("two"),
        ),
        lambda acc: acc["two"],
    )
    return once.groupBy("word").agg(fold.alias("twice")).where("twice != 0")


def _flagged(rows: DataFrame, bits: DataFrame, words: int) -> DataFrame:
    """``rows`` with ``maybe``: whether the hash ``h`` may occur more than once."""
    word, mask = probe(F.col("h"), words)
    return (
        rows.withColumns({"word": word, "mask": mask})
        .join(F.broadcast(bits), "word", "left")
        .withColumn("maybe", F.coalesce(F.col("twice").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False)))
        .drop("word", "mask", "twice")
    )


def keep_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # The only scan of the texts; what follows reads 60 bytes a row.
    narrow = written(
        docs.select(
            F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("sha"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("rid")
        ),
        "dedup-hashes",
    )
    n_rows = narrow.count()
    words = filter_words(n_rows)
    bits = written(twice_bits(narrow, words), "dedup-filter")
    rows = _flagged(narrow, bits, words).drop("h")
    maybe = rows.where("maybe").drop("maybe")
    groups = written(
        maybe.groupBy("sha").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "rid")).alias("top")),
        "dedup-groups",
    )
    grouped = attach_groups(maybe, groups, "sha", n_rows).select(
        "doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("top.rid")).alias("kept"), "sha"
    )
    single = rows.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    return single.unionByName(grouped).withColumn("text_sha256", F.lower(F.hex("sha"))).drop("sha")


def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they are.

    Whole rows shuffle only where the filter says that the text may repeat. Of
    rows with the largest id in a group the one with the largest hash of its
    columns stays, so the choice is the same on every run.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashes = written(docs.select(F.xxhash64(text).alias("h")), "dedup-hashes")
    words = filter_words(hashes.count())
    bits = written(twice_bits(hashes, words), "dedup-filter")
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), text.alias("body"))
    rows = _flagged(packed.withColumn("h", F.xxhash64("body")), bits, words)
    single = rows.where(~F.col("maybe")).select("row.*")
    # Maps can't be hashed; as JSON they can.
    tie = [F.to_json(F.struct(F.col("row")[f.name])) if "map<" in f.dataType.simpleString() else F.col("row")[f.name] for f in docs.schema.fields]
    best = (
        rows.where("maybe").withColumns({"sha": F.unhex(F.sha2("body", 256)), "tie": F.xxhash64(*tie)})
        .groupBy("sha").agg(F.max_by("row", F.struct("id", "tie")).alias("row")).select("row.*")
    )
    return single.unionByName(best)
