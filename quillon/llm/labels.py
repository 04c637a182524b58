"""Labelled rows that a classifier may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows with this remainder of crc32(id as text) mod 4 are held out.
FOLDS, HELD_OUT = 4, 2


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is held out; a null id isn't, and never has a label."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label) of at most ``limit`` labelled ids outside the held-out fold, chosen by hash of the id.

    ``limit`` bounds what is broadcast. Of repeated labels of an id the largest
    counts; null labels don't. An id whose document repeats comes as often; callers
    learn once from an id, from its largest row.
    """
    known = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label is not null")
        .where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "doc_id")
