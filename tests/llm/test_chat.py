"""Role repair against brute force over all moves."""

import itertools
import random

import pytest

from quillon.llm import chat


def brute(turns):
    best = float("inf")

    def go(k, state, cost):
        nonlocal best
        if cost >= best:
            return
        if k == len(turns):
            best = min(best, cost + chat.END[state])
            return
        for (a, b, _, _), c in zip(chat.MOVES, chat.costs(*turns[k])):
            if a == state:
                go(k + 1, b, cost + c)

    go(0, chat.B, 0.0)
    return best


def rebuild(rows):
    rows = sorted(rows, key=lambda r: (r.turn is not None, r.turn or 0, r.source_role or "", r.rid, r.part))
    return "".join(r.rendered for r in rows)


def parse(text):
    """Turns (role, content) of a rendered conversation."""
    out = []
    for block in text.split(chat.TAIL)[:-1]:
        head, _, body = block.partition("|>\n")
        out.append((head.removeprefix("<|"), body))
    assert text.endswith(chat.TAIL)
    return out


def legal(roles):
    roles = roles[1:] if roles[:1] == ["system"] else roles
    return len(roles) % 2 == 0 and all(r == ("user", "assistant")[k % 2] for k, r in enumerate(roles))


@pytest.mark.parametrize("roles", list(itertools.product(["system", "user", "assistant", None], repeat=3)))
def test_path_is_cheapest(roles):
    turns = [(r, i == 1 and r == "user") for i, r in enumerate(roles)]
    m = chat.step(*turns[0])
    for t in turns[1:]:
        m = chat.product(m, chat.step(*t))
    total = min(m[chat.B, s] + chat.END[s] for s in range(4))
    assert total == pytest.approx(brute(turns))


def test_conversations(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for conv in range(12):
        n = rng.choice([1, 2, 5, 150])
        for turn in range(n):
            rows.append((conv, turn, rng.choice(["system", "user", "assistant", "User ", "tool", None]), rng.choice([f"t{turn}", f"x{turn}\ny", "", None]), "clash"))
    rows += [(None, 0, "assistant", "hi", "z"), (None, None, "user", None, "z"), (77, 0, "user", "same", "z"), (77, 0, "user", "same", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rid string")
    out = chat.repair(df).collect()
    by = {}
    for r in out:
        by.setdefault(r.conv_id, []).append(r)
    assert set(by) == {r[0] for r in rows}
    for conv, own in by.items():
        turns = parse(rebuild(own))
        assert legal([r for r, _ in turns]), conv
        text = rebuild(own)
        for r in rows:
            if r[0] == conv and r[3]:
                assert r[3] in text
        assert len([r for r in own if r.action != "insert"]) == sum(r[0] == conv for r in rows)
    assert not chat.repair(df.limit(0)).collect()


def test_crowded_turns(spark, monkeypatch):
    """Hundreds of rows of one turn are cut in segments; the repair costs the same as in one piece."""
    rng = random.Random(2)
    rows = [(1, turn, rng.choice(["user", "assistant", "system", None]), f"t{k}") for turn in (0, 1) for k in range(150)] + [(2, None, "user", f"n{k}") for k in range(90)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    order = lambda r: (r.conv_id, r.turn is not None, r.turn or 0, r.source_role or "", r.rid, r.part)

    def cost(out, conv):
        total = 0.0
        for r in out:
            if r.conv_id == conv:
                total += {"insert": chat.INSERT, "relabel": chat.RELABEL, "keep": 0.0, "merge": chat.MERGE}[r.action] + (chat.RELABEL if r.action == "merge" and r.source_role != r.role else 0.0)
        return total

    whole = sorted(chat.repair(df).collect(), key=order)
    monkeypatch.setattr(chat, "CROWD", 16)
    cut = sorted(chat.repair(df).collect(), key=order)
    for conv in (1, 2):
        assert cost(cut, conv) == cost(whole, conv)
        assert legal([r for r, _ in parse("".join(r.rendered for r in cut if r.conv_id == conv))])
    assert len([r for r in cut if r.action != "insert"]) == len(rows)


def test_rows_alike_are_turns_of_their_own(spark):
    """Copies are numbered over partitions; a run of them is repaired at the least cost."""
    rows = [(1, 0, "user", "a")] * 37 + [(1, 1, "tool", "b")] * 9 + [(2, 0, "user", "x"), (2, 1, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    out = sorted(chat.repair(df).collect(), key=lambda r: (r.conv_id, r.turn, r.rid, r.part))
    assert len(out) == len({(r.conv_id, r.rid, r.part) for r in out}) and len([r for r in out if r.action != "insert"]) == len(rows)
    assert rebuild([r for r in out if r.conv_id == 2]) == "<|user|>\nx\n<|end|>\n<|assistant|>\ny\n<|end|>\n"
    text = rebuild([r for r in out if r.conv_id == 1])
    assert legal([r for r, _ in parse(text)]) and text.count("a\n") == 37 and text.count("b\n") == 9
    price = {"insert": chat.INSERT, "keep": 0.0, "relabel": chat.RELABEL, "merge": chat.MERGE}
    cost = sum(price[r.action] + (chat.RELABEL if r.action == "merge" and r.source_role != r.role else 0.0) for r in out if r.conv_id == 1)
    m = chat.step("user", False)
    for t in [("user", False)] * 36 + [("tool", False)] * 9:
        m = chat.product(m, chat.step(*t))
    assert cost == pytest.approx(min(m[chat.B, s] + chat.END[s] for s in range(4)))


def test_long_conversation_with_long_texts(spark, monkeypatch):
    """Thousands of turns over many chunks and held blocks, one of them very long."""
    monkeypatch.setattr(chat, "HOLD", 100)
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", "w " * (200000 if k == 700 else 2)) for k in range(3000)] + [(2, 0, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.repair(df).where("conv_id = 1").select("action", "role", "turn").collect()
    assert len(out) == 3000 and all(r.action == "keep" for r in out)
