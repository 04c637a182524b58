"""Event-sourced governance: state machine, hash chain, idempotence, leases."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Legal moves of a proposal.
MOVES = {("suggested", "approved"), ("suggested", "rejected"), ("approved", "superseded")}


def replay(events: DataFrame, key: str, order: str, state: str, first: str = "suggested") -> DataFrame:
    """Events with ``legal``: whether each follows from the state that its key was in.

    An illegal event leaves the state as it was, so the state is folded over the
    key's events in order; a key's events are a handful.
    """
    legal = F.array(*[F.lit(f"{a}>{b}") for a, b in sorted(MOVES)])

    def step(acc: Column, e: Column) -> Column:
        ok = F.when(acc["state"].isNull(), e["s"] == first).otherwise(F.array_contains(legal, F.concat(acc["state"], F.lit(">"), e["s"])))
        return F.struct(F.when(ok, e["s"]).otherwise(acc["state"]).alias("state"), F.array_append(acc["out"], F.struct(e["o"].alias("o"), e["s"].alias("s"), ok.alias("ok"))).alias("out"))

    kind = events.schema[order].dataType.simpleString()
    zero = F.struct(F.lit(None).cast("string").alias("state"), F.array().cast(f"array<struct<o:{kind},s:string,ok:boolean>>").alias("out"))
    by = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(state).alias("s")))).alias("es"))
    return by.select(key, F.explode(F.aggregate("es", zero, step, lambda a: a["out"])).alias("e")).select(key, F.col("e.o").alias(order), F.col("e.s").alias(state), F.col("e.ok").alias("legal"))


def current_state(events: DataFrame, key: str, order: str, state: str) -> DataFrame:
    return replay(events, key, order, state).where("legal").groupBy(key).agg(F.max_by(state, order).alias(state))


def chain_hash(previous: Column, payload: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.coalesce(previous, F.lit("")), payload), 256)


def verify_chain(events: DataFrame, chain: str, order: str, payload: str, previous: str = "previous_hash", own: str = "event_hash") -> DataFrame:
    """Events whose previous hash isn't the one before's, or whose own hash is wrong."""
    before = F.lag(own).over(W.partitionBy(chain).orderBy(order))
    out = events.withColumns({"_linked": F.col(previous).eqNullSafe(before), "_true": F.col(own) == chain_hash(F.col(previous), F.col(payload))})
    return out.where("NOT (_linked AND _true)").drop("_linked", "_true")


def append_chained(log: DataFrame, events: DataFrame, chain: str, order: str, payload: str) -> DataFrame:
    """``events`` with previous_hash and event_hash, each chain going on from its last event in ``log`` (chain, order, event_hash).

    A hash needs the one before, so a chain is gone through in order; its events are
    sorted by Spark and pass by in batches, none of which is kept. Ties of ``order``
    are settled by payload.
    """
    last = log.groupBy(chain).agg(F.max_by("event_hash", order).alias("_last"))
    rows = events.withColumn("_chain", F.xxhash64(chain)).join(last, chain, "left")
    at = {c: rows.columns.index(c) for c in (chain, payload, "_last")}
    keep = [k for k, c in enumerate(rows.columns) if c not in ("_chain", "_last")]
    kept = T.StructType([rows.schema.fields[k] for k in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hash_ = object(), None
        for batch in batches:
            before, after = [], []
            for c, p, first in zip(*(batch.column(at[c]).to_pylist() for c in (chain, payload, "_last")), strict=True):
                if c != now:
                    now, hash_ = c, first
                before.append(hash_)
                # As chain_hash: a null payload adds nothing, not even the bar.
                hash_ = hashlib.sha256((hash_ or "" if p is None else f"{hash_ or ''}|{p}").encode()).hexdigest()
                after.append(hash_)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(before, pa.string()), pa.array(after, pa.string())], [*kept.names, "previous_hash", "event_hash"])

    ordered = rows.repartition("_chain").sortWithinPartitions("_chain", chain, order, payload)
    return ordered.mapInArrow(run, T.StructType([*kept.fields, T.StructField("previous_hash", T.StringType()), T.StructField("event_hash", T.StringType())]))


def iso(at: Column) -> Column:
    """A timestamp in UTC as ISO 8601 with microseconds."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def epoch(at: Column) -> Column:
    """Whole seconds since 1970."""
    return F.unix_timestamp(at)


def expired(at: Column, ttl: int, now: Column | None = None) -> Column:
    """Whether more than ``ttl`` seconds have gone by; ``now`` is the current time by default."""
    return epoch(at) + ttl < epoch(F.current_timestamp() if now is None else now)


def apply_once(events: DataFrame, uid: str = "event_uid") -> DataFrame:
    """Each event once, however often it was sent."""
    return events.dropDuplicates([uid])


def lease_holders(beats: DataFrame, resource: str, holder: str, at: str, ttl: int, now: int) -> DataFrame:
    """The holder of each resource whose last heartbeat is within ``ttl`` seconds of ``now``."""
    return beats.groupBy(resource).agg(F.max_by(holder, at).alias(holder), F.max(at).alias("last")).where(F.col("last") + ttl >= now).select(resource, holder)
