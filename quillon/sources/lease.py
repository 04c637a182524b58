"""One writer at a time, by leases in a folder that all writers see.

A lease is a file whose name is its token, one more than the last; creating it
is exclusive, so of two writers one gets it. A lease ends when it is released, or
when its last sign of life is older than its time to live; the next writer then
takes the next token. A writer that was held up beyond that time finds a larger
token in the folder, and ``check`` refuses it: tokens fence stale writers out.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


class LeaseHeld(RuntimeError):
    """Another writer holds the lease."""


class LeaseLost(RuntimeError):
    """The lease has expired, was released, or another writer has taken the next one."""


@dataclass
class Lease:
    spark: SparkSession
    root: str
    token: int
    owner: str
    ttl: float
    now: Callable[[], float] = field(default=time.time, repr=False)

    def check(self) -> None:
        """Raise ``LeaseLost`` unless this lease is the newest and alive."""
        newest = _newest(self.spark, self.root)
        if newest != self.token:
            raise LeaseLost(f"token {self.token} is stale: {newest} was given out")
        state = _state(self.spark, self.root, self.token)
        if state["released"] or state["alive"] + self.ttl <= self.now():
            raise LeaseLost(f"the lease of {self.owner} has ended")

    def heartbeat(self) -> None:
        """A sign of life; refused once the lease is lost."""
        from quillon.sources.versions import publish

        self.check()
        publish(self.spark, json.dumps({"at": self.now()}), f"{self.root}/{self.token:020d}/beat-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}.json")
        _forget_beats(self.spark, self.root, self.token)

    def release(self) -> None:
        from quillon.sources.versions import publish

        publish(self.spark, json.dumps({"at": self.now()}), f"{self.root}/{self.token:020d}/released.json")


def _list(spark: SparkSession, pattern: str) -> list[str]:
    from quillon.sources.versions import file_system

    fs, path_of = file_system(spark, pattern)
    return sorted(str(x.getPath()) for x in fs.globStatus(path_of(pattern)) or [])


def _newest(spark: SparkSession, root: str) -> int:
    return max((int(p.rsplit("/", 1)[1].split(".")[0]) for p in _list(spark, f"{root}/*.json")), default=0)


def _state(spark: SparkSession, root: str, token: int) -> dict:
    from quillon.sources.versions import read_text

    own = json.loads(read_text(spark, f"{root}/{token:020d}.json"))
    beats = _list(spark, f"{root}/{token:020d}/beat-*.json")
    alive = max([own["acquired"], *(json.loads(read_text(spark, p))["at"] for p in beats[-1:])])
    return own | {"alive": alive, "released": bool(_list(spark, f"{root}/{token:020d}/released.json"))}


def _forget_beats(spark: SparkSession, root: str, token: int, keep: int = 2) -> None:
    from quillon.sources.versions import file_system

    for p in _list(spark, f"{root}/{token:020d}/beat-*.json")[:-keep]:
        fs, path_of = file_system(spark, p)
        fs.delete(path_of(p), False)


def holder(spark: SparkSession, root: str, now: float | None = None) -> dict | None:
    """Owner, token and end of the lease that is alive, if there is one."""
    root = root.rstrip("/")
    return _alive(spark, root, _newest(spark, root), time.time() if now is None else now)


def _alive(spark: SparkSession, root: str, token: int, now: float) -> dict | None:
    if not token:
        return None
    state = _state(spark, root, token)
    ends = state["alive"] + state["ttl"]
    return None if state["released"] or ends <= now else {"owner": state["owner"], "token": token, "ends": ends}


def acquire(spark: SparkSession, root: str, ttl: float = 3600, owner: str | None = None, now: Callable[[], float] = time.time) -> Lease:
    """The lease below ``root``; ``LeaseHeld`` if another writer has it."""
    from quillon.sources.versions import publish

    if ttl < 5:
        raise ValueError("a lease lives for 5 seconds at least")
    root = root.rstrip("/")
    last = _newest(spark, root)  # whoever gets the next number after this one has the lease
    if own := _alive(spark, root, last, now()):
        raise LeaseHeld(f"{own['owner']} holds {root} until {own['ends']:.0f}")
    lease = Lease(spark, root, last + 1, owner or uuid.uuid4().hex, ttl, now)
    if not publish(spark, json.dumps({"owner": lease.owner, "ttl": ttl, "acquired": now()}), f"{root}/{lease.token:020d}.json"):
        raise LeaseHeld(f"another writer has just taken {root}")
    return lease


@contextmanager
def held(spark: SparkSession, root: str, ttl: float = 3600, owner: str | None = None) -> Iterator[Lease]:
    """A lease that is renewed in the background, every third of its time to live (1 to 30 seconds), and released at the end.

    A renewal that failed is raised at the end, unless the block has failed itself.
    """
    lease = acquire(spark, root, ttl, owner)
    done, failed = threading.Event(), []

    def renew() -> None:
        while not done.wait(max(1.0, min(ttl / 3, 30.0))):
            try:
                lease.heartbeat()
            except Exception as err:
                failed.append(err)
                return

    beat = threading.Thread(target=renew, name=f"lease-{lease.token}", daemon=True)
    beat.start()
    try:
        yield lease
    except BaseException:
        failed.clear()
        raise
    finally:
        done.set()
        beat.join(timeout=5)
        lease.release()
    if failed:
        raise LeaseLost("the lease couldn't be renewed") from failed[0]
