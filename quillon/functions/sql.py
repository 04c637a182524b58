"""Functions that SQL text can call, registered by name for a session."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Name, parameters, result and body: SQL functions, which Spark expands into the plan.
FUNCTIONS = (
    ("vector_distance", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE",
     "1 - aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v) / (sqrt(aggregate(a, 0D, (s, v) -> s + v * v)) * sqrt(aggregate(b, 0D, (s, v) -> s + v * v)))"),
    ("fold_text", "t STRING", "STRING", "translate(lower(t), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"),
    ("bm25", "tf DOUBLE, df DOUBLE, n DOUBLE, length DOUBLE, mean DOUBLE", "DOUBLE", "ln(1 + (n - df + 0.5D) / (df + 0.5D)) * tf * 2.2D / (tf + 1.2D * (0.25D + 0.75D * length / mean))"),
    ("rank_fusion", "place INT", "DOUBLE", "coalesce(1D / (60 + place), 0D)"),
)


#: Name, parameters, columns and body: functions that stand where a table does.
TABLE_FUNCTIONS = (
    ("word_table", "t STRING", "place INT, word STRING", "SELECT CAST(pos + 1 AS INT), col FROM posexplode(regexp_extract_all(t, '[A-Za-zÀ-úà-ÿ]+', 0))"),
    ("line_rows", "t STRING", "line INT, text STRING", "SELECT CAST(pos + 1 AS INT), col FROM posexplode(split(t, '\\r\\n|\\n|\\r'))"),
)


@pandas_udf(StringType())
def bag_hash(digest: pd.Series) -> str:
    """A digest of a group's digests, whatever their order; nulls are left out. As ``hashing.multiset_hash("bag", ...)``."""
    return hashlib.sha256((3).to_bytes(8, "big") + b"bag" + "".join(sorted(digest.dropna())).encode()).hexdigest()


def register(spark: SparkSession) -> list[str]:
    """Create the scalar functions as temporary ones of the session; their names are the result."""
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return [name for name, *_ in FUNCTIONS]


def register_more(spark: SparkSession) -> list[str]:
    """The table functions, and the aggregate ``bag_hash``."""
    for name, parameters, columns, body in TABLE_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {body}")
    spark.udf.register("bag_hash", bag_hash)
    return [*(name for name, *_ in TABLE_FUNCTIONS), "bag_hash"]
