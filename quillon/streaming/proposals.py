"""Proposals as a stream with event time: ordered, repeated only once, and expiring by themselves.

Events may come late and out of order: each waits in its proposal's state until
the watermark has passed it, and then moves the proposal in the order of event
time (ties by uid). An event that was seen before is reported and does nothing. A
proposal that nobody decides within its time to live expires by a timer, and a
decision that comes after that is illegal. Events older than the watermark when
they arrive are dropped by Spark before they get here.

State lives in RocksDB, survives a restart from the checkpoint, and holds of a
proposal its state, the events that wait, and the uids seen.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillon.operators.governance import MOVES

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The state in which a proposal waits for a decision, and what it becomes if none comes.
FIRST, EXPIRED = "suggested", "expired"
#: Waiting events, and uids, that a proposal's one value holds at most.
KEPT = 64


class _Replay(StatefulProcessor):
    """A proposal's state, its waiting events and its last uids are one value, read and written once a batch: each
    access is a call to another process. What goes beyond ``KEPT`` entries moves to maps, so no value grows."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "state string, since long, pending array<struct<at:long,uid:string,state:string>>, seen array<string>, more boolean")
        self.pending = handle.getMapState("pending", "at long, uid string", "state string")
        self.seen = handle.getMapState("seen", "uid string", "at long")

    def _read(self) -> tuple[str | None, int, list[tuple[int, str, str | None]], list[str], bool]:
        got = self.now.get()
        if got is None:
            return None, 0, [], [], False
        state, since, pending, seen, more = got
        return state, since, [tuple(p) for p in pending], list(seen), more

    def _write(self, state: str | None, since: int, pending: list, seen: list[str], more: bool) -> None:
        if len(pending) > KEPT:
            for at, uid, wanted in pending:
                self.pending.updateValue((at, uid), (wanted,))
            pending, more = [], True
        if len(seen) > KEPT:
            for uid in seen:
                self.seen.updateValue((uid,), (0,))
            seen, more = [], True
        self.now.update((state, since, pending, seen, more))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state, since, pending, seen, more = self._read()
        known, new = set(seen), []
        for r in rows:
            if r.uid in known or more and self.seen.containsKey((r.uid,)):
                yield Row(proposal=key[0], uid=r.uid, at_ms=int(r.at_ms), state=r.state, outcome="repeated")
                continue
            known.add(r.uid)
            seen.append(r.uid)
            new.append((int(r.at_ms), r.uid, r.state))
        if new:
            # The earliest wakes the proposal, which then sets a timer for what still waits.
            self.handle.registerTimer(max(min(new)[0], timerValues.getCurrentWatermarkInMs() + 1))
            self._write(state, since, pending + new, seen, more)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        upto = timerValues.getCurrentWatermarkInMs()
        state, since, pending, seen, more = self._read()
        due, left = [p for p in pending if p[0] <= upto], [p for p in pending if p[0] > upto]
        wake = [p[0] for p in left]
        if more:
            for k, v in self.pending.iterator():
                if k[0] <= upto:
                    due.append((k[0], k[1], v[0]))
                else:
                    wake.append(k[0])
            for at, uid, _ in due:
                if self.pending.containsKey((at, uid)):
                    self.pending.removeKey((at, uid))
        for at, uid, wanted in sorted(due, key=lambda p: p[:2]):
            if state == FIRST and since + self.ttl <= at:
                yield Row(proposal=key[0], uid=None, at_ms=since + self.ttl, state=EXPIRED, outcome="expired")
                state = EXPIRED
            legal = wanted == FIRST if state is None else (state, wanted) in MOVES
            if legal:
                state, since = wanted, at
            yield Row(proposal=key[0], uid=uid, at_ms=at, state=wanted, outcome="applied" if legal else "illegal")
        if state == FIRST:
            if since + self.ttl <= upto:
                yield Row(proposal=key[0], uid=None, at_ms=since + self.ttl, state=EXPIRED, outcome="expired")
                state = EXPIRED
            else:
                wake.append(since + self.ttl)
        if wake:
            self.handle.registerTimer(min(wake))
        self._write(state, since, left, seen, more)

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """State with timers needs this store; to be called before the query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def replay_timed(events: DataFrame, ttl_ms: int, late: str = "10 minutes") -> DataFrame:
    """(proposal, uid, at_ms, state, outcome) of a stream (proposal long, uid, state, at timestamp).

    Outcomes: applied, illegal, repeated, expired (which has no uid). ``late``: how
    long the watermark waits for events that are out of order.
    """
    from pyspark.sql import functions as F

    use_rocksdb(events.sparkSession)
    rows = events.where("proposal IS NOT NULL AND uid IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    rows = rows.select("proposal", "uid", "state", "at", F.unix_millis("at").alias("at_ms"))
    schema = "proposal long, uid string, at_ms long, state string, outcome string"
    return rows.groupBy("proposal").transformWithState(statefulProcessor=_Replay(ttl_ms), outputStructType=schema, outputMode="Append", timeMode="eventTime")


def log_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The event log (JSON lines in the files of a folder) as a stream of proposal, uid, state and time."""
    read = spark.readStream.schema("event_uid string, proposal_uid long, to_status string, created_at timestamp")
    if files_per_batch:
        read = read.option("maxFilesPerTrigger", files_per_batch)
    log = read.json(path)
    return log.selectExpr("proposal_uid AS proposal", "event_uid AS uid", "to_status AS state", "created_at AS at")
