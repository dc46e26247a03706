import datetime
import hashlib
import json

import pytest

from threadloom.sources import records
from threadloom.streaming.ingest import Ingest

RAW = {"schema_version": 1, "event_id": "e1", "session_id": "s1", "project_id": "p1", "seq_id": 1, "turn_id": "t1", "role": "user", "timestamp": "2025-01-01T00:00:00Z", "source_agent": "x", "content": "hi", "content_hash": "h", "savepoint_status": "complete", "capture_status": "captured", "sensitivity": "normal", "raw_ref": "r", "further": [1]}


def put(folder, path, value):
    file = folder / path
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(value if isinstance(value, str) else json.dumps(value))


def test_faults_are_told_and_values_never_converted(spark, tmp_path):
    put(tmp_path, "raw/p1/s1/e1.json", RAW)
    put(tmp_path, "raw/p1/s1/e2.json", RAW | {"event_id": "e2", "content": 5})
    put(tmp_path, "raw/p1/s1/e3.json", {k: v for k, v in RAW.items() if k != "role"} | {"event_id": "e3"})
    put(tmp_path, "raw/p1/s1/e4.json", RAW | {"event_id": "e4", "role": "robot"})
    put(tmp_path, "raw/p1/s2/e5.json", RAW | {"event_id": "e5"})
    put(tmp_path, "raw/p1/s1/e6.json", "{not json")
    put(tmp_path, "raw/p1/s1/e7.txt", "ignored")
    valid, invalid = records.split(records.decode(records.scan(spark, str(tmp_path)), "raw"), "raw")
    assert [(r.event_id, r.seq_id, r.source_model) for r in valid.collect()] == [("e1", 1, None)]
    assert {r.path.rsplit("/", 1)[1]: r.fault for r in invalid.collect()} == {"e2.json": "content", "e3.json": "role", "e4.json": "role", "e5.json": "misplaced", "e6.json": "not JSON"}
    assert records.scan(spark, str(tmp_path), most=2).count() == 2


def test_generations_and_append(spark, tmp_path):
    df = spark.createDataFrame([("p1", 1), ("p2", 2)], "project_id string, n int")
    records.append(df, f"{tmp_path}/log")
    records.append(df, f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").where("project_id = 'p1'").count() == 2
    records.publish(df, f"{tmp_path}/g")
    records.publish(df.where("n = 2"), f"{tmp_path}/g")
    assert [r.n for r in records.active(spark, f"{tmp_path}/g").collect()] == [2]


def test_markdown(spark):
    df = spark.createDataFrame([("m1", ["a"], None, "T", "S")], "id string, tags array<string>, model string, title string, summary string")
    assert records.markdown(df).first().text == '---\nid: "m1"\ntags: ["a"]\n---\n\n# T\n\nS'


@pytest.mark.parametrize("again", [False, True])
def test_ingest_captures_each_event_once(spark, tmp_path, again):
    schema = "delivery_id bigint, event_id string, received_at timestamp, session_id string, project_id string, seq_id bigint, turn_id string, role string, timestamp string, content string, content_hash string, savepoint_status string, raw_ref string, schema_version int"
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    row = lambda d, e, t: (d, e, datetime.datetime(2025, 1, 1, 0, d), "s", "p", d, "t", "user", f"2025-01-01T00:{d:02d}:00Z", t, digest(t), "complete", "r", 1)
    stream = Ingest(spark, f"{tmp_path}/out")
    spark.createDataFrame([row(1, "a", "we decided on postgres"), row(2, "A ", "we decided on postgres")], schema).write.mode("append").parquet(f"{tmp_path}/in")
    parsed = spark.read.parquet(f"{tmp_path}/in").schema
    stream.run(f"{tmp_path}/in", parsed)
    spark.createDataFrame([row(3, "a", "we decided on postgres"), row(4, "b", "we decided on sqlite now, current")], schema).write.mode("append").parquet(f"{tmp_path}/in")
    stream.run(f"{tmp_path}/in", parsed)
    if again:
        stream.run(f"{tmp_path}/in", parsed)
    assert sorted(r.event_key for r in stream.read().collect()) == ["a", "b"]
    view = stream.decision_views().collect()
    assert [(v.topic, v.events) for v in view] == [("database", 2)]


def test_ingest_takes_late_events_and_better_copies(spark, tmp_path):
    schema = "delivery_id bigint, event_id string, received_at timestamp, session_id string, project_id string, seq_id bigint, turn_id string, role string, timestamp string, content string, content_hash string, savepoint_status string, raw_ref string, schema_version int"
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    row = lambda d, e, at, t, h: (d, e, at, "s", "p", d, "t", "user", "2025-01-01T00:00:00Z", t, h, "complete", "r", 1)
    now, old = datetime.datetime(2025, 6, 1), datetime.datetime(2025, 1, 1)
    stream = Ingest(spark, f"{tmp_path}/out")
    batches = [[row(1, "a", now, "dam", "0" * 64)], [row(2, "z", now, "zed", digest("zed"))], [row(3, "late", old, "late", digest("late")), row(4, "a", now, "whole", digest("whole"))], [row(5, "a", now, "worse", "0" * 64)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream.run(f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    assert {r.event_key: r.content for r in stream.read().collect()} == {"a": "whole", "z": "zed", "late": "late"}
