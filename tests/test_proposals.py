"""Timed proposals: order, repeats, expiry and restarts, against a replay by hand."""

import json
import random
from datetime import datetime, timedelta, timezone

from quillon.operators.governance import MOVES
from quillon.streaming.proposals import log_stream, replay_timed

DAY = 86_400_000
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def ms(day):
    return int((START + timedelta(days=day)).timestamp() * 1000)


def by_hand(events, ttl):
    """All events in order of time; whatever is undecided at the end has expired."""
    out, by = [], {}
    seen = set()
    for p, uid, state, day in events:
        if (p, uid) in seen:
            out.append((p, uid, ms(day), state, "repeated"))
        else:
            seen.add((p, uid))
            by.setdefault(p, []).append((ms(day), uid, state))
    for p, own in by.items():
        state, since = None, 0
        for at, uid, wanted in sorted(own):
            if state == "suggested" and since + ttl <= at:
                out.append((p, None, since + ttl, "expired", "expired"))
                state = "expired"
            legal = wanted == "suggested" if state is None else (state, wanted) in MOVES
            if legal:
                state, since = wanted, at
            out.append((p, uid, at, wanted, "applied" if legal else "illegal"))
        if state == "suggested":
            out.append((p, None, since + ttl, "expired", "expired"))
    return sorted(out, key=repr)


def test_replay_with_timers_and_restart(spark, tmp_path):
    rng = random.Random(6)
    days = [[], [], []]
    for p in range(12):
        t = rng.uniform(0, 3)
        steps = [("suggested", t), *((rng.choice(["approved", "rejected", "superseded", "suggested"]), t + rng.uniform(0, 9)) for _ in range(rng.randint(0, 3)))]
        for k, (state, day) in enumerate(steps):
            days[0 if rng.random() < 0.6 else 1].append((p, f"e{p}-{k}", state, day))
    days[1] += days[0][:3]  # repeated in a later file
    rng.shuffle(days[0])
    # A last event moves the watermark beyond all that waits, and is itself left waiting.
    days[2] = [(99, "end", "suggested", 200)]
    events = [e for d in days for e in d if e[0] != 99]
    (tmp_path / "log").mkdir()
    found = []
    for k, own in enumerate(days):
        with open(tmp_path / "log" / f"{k}.json", "w") as f:
            for p, uid, state, day in own:
                f.write(json.dumps({"event_uid": uid, "proposal_uid": p, "to_status": state, "created_at": (START + timedelta(days=day)).isoformat()}) + "\n")
        # Every file is a run of its own: the state comes back from the checkpoint.
        out = replay_timed(log_stream(spark, str(tmp_path / "log"), 1), 5 * DAY, "30 days")
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None and not q.isActive
    found = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("proposal", "uid", "at_ms", "state", "outcome").collect()), key=repr)
    assert found == by_hand(events, 5 * DAY)
    assert {r[4] for r in found} == {"applied", "illegal", "repeated", "expired"}
