import datetime

import pytest

from threadloom.operators import change_feed as cf

FEED = "feed_id bigint, event_id string, kind string, target_memory_id string, replacement_memory_id string, evidence_refs array<string>, timestamp string, target string"


def feed(spark, rows):
    return spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(rows)], FEED)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def found(df):
    return {tuple(r) for r in df.collect()}


def test_last_by_instant_then_id_in_any_order(spark):
    rows = [
        ("b", "forget", "m1", None, None, "2025-01-01T10:00:00Z"),
        ("a", "delete", "m1", None, ["e"], "2025-01-01T18:00:00+08:00"),  # the same instant, smaller id
        ("c", "correct", "m2", "m9", ["e"], "2025-01-02T00:00:00.5Z"),
        ("d", "delete", "m2", None, ["e"], "2025-01-02T00:00:00Z"),  # late, older: the correction stands
        (" C ", "correct", "m2", "m9", ["e"], "2025-01-02T00:00:00.500Z"),  # repeated
    ]
    want = {("m1", "revoked", "b"), ("m2", "superseded", "c")}
    memories = ids(spark, "m1", "m2", "m3")
    assert found(cf.final_states(feed(spark, rows), memories)) == want
    assert found(cf.final_states(feed(spark, rows[::-1]), memories)) == want


def test_what_does_not_count(spark):
    rows = [
        ("a", "correct", "m1", None, ["e"], "2025-01-01T00:00:00Z"),
        ("b", "correct", "m1", "m2", [], "2025-01-01T00:00:00Z"),
        ("c", "delete", "m1", None, None, "2025-01-01T00:00:00Z"),
        ("d", "forget", "m1", None, None, "yesterday"),
        ("e", "forget", "m1", None, None, "2025-01-01"),
        ("f", "archive", "m1", None, ["e"], "2025-01-01T00:00:00Z"),
        ("g", None, None, None, None, None),
        (None, "forget", "m1", None, None, "2025-01-01T00:00:00Z"),
        ("h", "forget", "gone", None, None, "2025-01-01T00:00:00Z"),
    ]
    assert found(cf.final_states(feed(spark, rows), ids(spark, "m1"))) == set()
    current = {r.memory_id: r.current_status for r in cf.current_memories(feed(spark, rows), ids(spark, "m1", "m1", None)).collect()}
    assert current == {"m1": "active"}


def test_empty_tables(spark):
    assert found(cf.final_states(feed(spark, []), ids(spark))) == set()


def test_tombstones_survive_older_changes_in_later_applies(spark, tmp_path):
    schema = cf.CHANGE
    table = cf.ChangeTable(spark, f"file://{tmp_path}/t", buckets=3)
    table.apply(spark.createDataFrame([("k", "delete", 5, "x", None), ("l", "upsert", 1, "y", "one")], schema))
    table.apply(spark.createDataFrame([("k", "upsert", 4, "w", "late"), ("l", "upsert", 2, "z", "two")], schema))
    rows = {r.target: (r.op, r.sequence, r.payload, r.deleted) for r in table.read().collect()}
    assert rows == {"k": ("delete", 5, None, True), "l": ("upsert", 2, "two", False)}
    before = table.version()
    table.apply(spark.createDataFrame([("l", "upsert", 2, "z", "two")], schema))  # again: nothing changes
    assert {r.target: r.payload for r in table.read().collect()} == {"k": None, "l": "two"}
    assert table.version() != before


def test_a_second_writer_is_told(spark, tmp_path):
    one, two = (cf.ChangeTable(spark, f"file://{tmp_path}/t", buckets=2) for _ in range(2))
    one.apply(spark.createDataFrame([("x", "upsert", 1, "a", "1")], cf.CHANGE))
    read = two.version()
    one.apply(spark.createDataFrame([("y", "upsert", 1, "b", "1")], cf.CHANGE))
    two.version = lambda: read  # it has read before the other published
    with pytest.raises(cf.Conflict):
        two.apply(spark.createDataFrame([("z", "upsert", 1, "c", "1")], cf.CHANGE))
    assert {r.target for r in one.read().collect()} == {"x", "y"}


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = cf.ChangeTable(spark, f"file://{tmp_path}/t", buckets=16)
    table.apply(spark.createDataFrame([(f"k{i}", "upsert", 1, "a", "1") for i in range(200)], cf.CHANGE))
    before = table.version()[1]
    table.apply(spark.createDataFrame([("k7", "upsert", 2, "a", "2")], cf.CHANGE))
    after = table.version()[1]
    assert len(before) == len(after) == 16 and sum(before[b] != after[b] for b in before) == 1
    assert {r.target: r.payload for r in table.read().collect()} == {f"k{i}": "2" if i == 7 else "1" for i in range(200)}


def test_one_key_with_most_changes_against_brute_force(spark):
    import random

    random.seed(3)
    rows = [("hot" if random.random() < 0.6 else f"k{random.randrange(40)}", "upsert", random.randrange(300), f"c{random.randrange(900):04d}", str(i)) for i in range(3000)]
    best = {}
    for r in rows:
        if r[0] not in best or (r[2], r[3], r[1], r[4]) > best[r[0]]:
            best[r[0]] = (r[2], r[3], r[1], r[4])
    df = spark.createDataFrame(rows, cf.CHANGE).repartition(5)
    assert cf.thin(df).where("target = 'hot'").count() <= 16
    import tempfile

    got = cf.ChangeTable(spark, f"file://{tempfile.mkdtemp()}/t", buckets=4).apply(df).collect()
    assert {r.target: (r.sequence, r.change_id, r.op, r.payload) for r in got} == best


def test_instants(spark):
    from pyspark.sql import functions as F

    from threadloom.functions.instants import instant

    texts = ["2025-01-01T00:00:00Z", "2025-01-01T08:00:00.000+08:00", "2024-12-31T19:00:00-0500", "2025-01-01T00:00:00.123456789Z", "not-a-date", "", None, "2025-13-01T00:00:00Z", "2025-01-01T00:00Z"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(instant(F.col("t"))).collect()]
    zero = datetime.datetime(2025, 1, 1)
    utc = [g and datetime.datetime.fromtimestamp(g.timestamp(), datetime.UTC).replace(tzinfo=None) for g in got]
    assert utc == [zero, zero, zero, zero.replace(microsecond=123456), None, None, None, None, zero]
