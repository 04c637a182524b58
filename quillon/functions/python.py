"""Functions that no built-in expresses, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def unified_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    """Unified diff of two texts with three lines of context; empty if they are equal. Null is empty."""
    return pd.Series(["\n".join(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), lineterm="")) for a, b in zip(before, after, strict=True)])


@F.pandas_udf(StringType())
def fold_any(text: pd.Series) -> pd.Series:
    """Case folded and free of combining marks, for all of Unicode; Latin-1 text needs no Python, see ``text.fold``."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t.casefold()) if unicodedata.category(c) != "Mn"))


@F.pandas_udf(StringType())
def float_leaf(value: pd.Series) -> pd.Series:
    """The exact hexadecimal form of a float, as hashed in a Merkle leaf."""
    return value.map(lambda v: None if pd.isna(v) else float(v).hex())
