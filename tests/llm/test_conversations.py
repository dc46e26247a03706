import datetime
import hashlib
import random

import pytest

from threadloom.llm import conversations as cv

SCHEMA = "delivery_id bigint, event_id string, received_at timestamp, session_id string, turn_id string, seq_id bigint, role string, timestamp string, content string, content_hash string, messages string"


def deliveries(spark, rows):
    """rows: (session, turn, seq, role, content)"""
    at = datetime.datetime(2025, 1, 1)
    full = [(i, f"e{i}", at, s, t, q, r, f"2025-01-01T00:00:{i % 60:02d}Z", c, hashlib.sha256((c or "").encode()).hexdigest(), "clash") for i, (s, t, q, r, c) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


CASES = {
    "sound": [("t1", 1, "user", "a"), ("t1", 2, " Assistant", "b"), ("t2", 5, "USER", "c"), ("t2", 6, "user", "c"), ("t2", 9, "assistant", "d")],
    "incomplete": [("t1", 1, "user", "a")],
    "cycle": [("t1", 1, "user", "a"), ("t2", 2, "user", "b"), ("t2", 3, "assistant", "b"), ("t1", 4, "assistant", "c")],
    "cycle ": [("t1", 1, "assistant", "a"), ("t1", 2, "user", "b")],
    "missing_seq": [("t1", None, "user", "a"), ("t1", 2, "assistant", "b")],
    "repeated_seq": [("t1", 1, "user", "a"), ("t1", 1, "assistant", "b")],
    "empty": [("t1", 1, "system", "a"), ("t1", 2, "user", " ​"), ("t1", 3, None, "x"), ("t1", 4, "user", None)],
    "sound ": [(None, 1, "user", "a"), (None, 2, "assistant", "b" * 200_000), ("t", 3, "system", "x")],
}


@pytest.mark.parametrize("segment", [10_000, 2, 1])
def test_reasons_whatever_the_cut(spark, segment):
    rows = [(name, *r) for name, case in CASES.items() for r in case] + [(None, "t", 1, "user", "x")]
    got = {r.session_id: r.reason for r in cv.verdicts(deliveries(spark, rows), segment).collect()}
    assert got == {name: None if name.startswith("sound") else name.strip() for name in CASES}


def plain_rule(rows):
    rows = sorted(rows)
    seqs = [r[0] for r in rows]
    if not rows or len(set(seqs)) < len(seqs):
        return False
    stretches = []
    for _, turn, user in rows:
        if not stretches or stretches[-1][0] != turn:
            stretches.append((turn, []))
        stretches[-1][1].append(user)
    return len({t for t, _ in stretches}) == len(stretches) and all(u[0] and not u[-1] and u == sorted(u, reverse=True) for _, u in stretches)


@pytest.mark.parametrize("segment", [10_000, 3])
def test_against_the_rule(spark, segment):
    random.seed(5)
    rows, want = [], {}
    for s in range(150):
        messages, seq = [], 0
        for t in range(random.randrange(1, 4)):
            for user in [True] * random.randrange(1, 3) + [False] * random.randrange(1, 3):
                seq += random.randrange(1, 3)
                messages.append((seq, f"t{t}", user))
        if random.random() < 0.5 and len(messages) > 1:
            i, j = random.sample(range(len(messages)), 2)
            a, b = messages[i], messages[j]
            messages[i], messages[j] = (a[0], b[1], b[2]), (b[0], a[1], a[2])
        if random.random() < 0.1:
            messages[0] = (messages[-1][0], *messages[0][1:])
        want[f"s{s}"] = plain_rule(messages)
        random.shuffle(messages)
        rows += [(f"s{s}", t, q, "user" if u else "assistant", "x") for q, t, u in messages]
    df = deliveries(spark, rows)
    assert {r.session_id: r.reason is None for r in cv.verdicts(df, segment).collect()} == want
    order = {}
    for r in cv.conversations(df, segment).collect():
        order.setdefault(r.session_id, []).append((r.position, r.seq_id))
    assert set(order) == {s for s, ok in want.items() if ok}
    for got in order.values():
        assert [p for p, _ in sorted(got)] == list(range(len(got)))
        assert [q for _, q in sorted(got)] == sorted(q for _, q in got)


def test_kahn_leaves_cycles_and_breaks_ties_by_time():
    assert cv.kahn([(1, "a", True, 9), (2, "b", True, 3), (3, "a", True, 1)]) != [0, 1, 2]  # a turn resumed
    assert cv.kahn([(1, "a", True, 9), (1, "a", True, 3), (2, "a", False, 1)]) == [1, 0, 2]
    assert cv.kahn([(1, "a", False, 1), (2, "a", True, 2)]) == []


def test_empty_table(spark):
    assert cv.verdicts(deliveries(spark, [])).count() == 0
    assert cv.conversations(deliveries(spark, [])).count() == 0
