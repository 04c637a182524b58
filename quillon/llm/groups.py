"""Give each row its group's values without sending a hot group to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group is hot from this share of all rows on; so at most 1/share of them are broadcast.
HOT_SHARE = 1 / 1024


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, n_rows: int, size: str = "group_size") -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (one row a ``key``, with its ``size``).

    Groups with over ``HOT_SHARE`` of ``n_rows`` (at most 1024 of them, whatever
    the input) are broadcast, and the rows of the others are shuffled by key: no
    task gets more than about that share of the rows. Null keys match nothing.
    """
    bar = max(1, int(n_rows * HOT_SHARE))
    hot = groups.where(F.col(size) > bar)
    cold = groups.where(F.col(size) <= bar)
    hot_keys = F.broadcast(hot.select(key))
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(hot_keys, key, "left_anti").join(cold, key)
    return near.unionByName(far)
