import datetime
import hashlib
import random

from threadloom.streaming.seen_store import SeenStore, repeated_deliveries

SCHEMA = "event_id string, delivery_id bigint, received_at timestamp, content string, content_hash string, rank string"
DAY = datetime.timedelta(days=1)
START = datetime.datetime(2025, 1, 1)


def row(event, delivery, days, content="x", sound=True):
    digest = hashlib.sha256((content or "").encode()).hexdigest()
    return (event, delivery, START + days * DAY, content, digest.upper() if sound else "0" * 64, "clash")


def write(spark, path, *batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))
        del i
    return str(path)


def brute(rows):
    best = {}
    for event, delivery, at, content, digest, _ in rows:
        key = event.strip().lower() if event is not None else f"#{delivery}"
        sound = content is not None and hashlib.sha256(content.encode()).hexdigest() == (digest or "").lower()
        best.setdefault(key, []).append((not sound, at, delivery))
    return {(k, d) for k, v in best.items() for _, _, d in sorted(v)[1:]}


def test_kept_copy_rules(spark, tmp_path):
    rows = [row("a", 1, 0, sound=False), row(" A", 2, 1), row("a", 3, 2), row("b", 4, 0, sound=False), row("b", 5, 1, sound=False), row(None, 6, 0), row(None, 7, 0), ("c", 8, START, None, None, "clash")]
    got = {tuple(r) for r in repeated_deliveries(spark, write(spark, tmp_path / "t", rows)).collect()}
    assert got == {("a", 1), ("a", 3), ("b", 5)} == brute(rows)


def test_state_spans_batches_and_late_rows_are_looked_up(spark, tmp_path):
    first = [row(f"e{i}", i, i % 5) for i in range(40)]
    second = [row(f"e{i}", 100 + i, 200) for i in range(0, 40, 2)] + [row("new", 190, 400)]
    third = [row(f"f{i}", 200 + i, 401) for i in range(8)]
    late = [row("e1", 300, -1), row("e2", 301, 0.5, sound=False), row("only-late", 302, -3), row("only-late", 303, -4)]  # long past the watermark
    path = write(spark, tmp_path / "t", first, second, third, late)
    store = SeenStore(spark, f"file://{tmp_path}/store", stretch_days=10, delay="1 day", trigger_bytes=1, buckets=2)
    store.run(path, spark.read.parquet(path).schema)
    assert {(r.event_key, r.delivery_id) for r in store.repeated().collect()} == brute(first + second + third + late)
    assert store.read().where("verdict = 'late'").count() >= 3
    held = {r.event_key: r.delivery_id for r in store.kept().collect()}
    assert held["e1"] == 300 and held["e2"] == 2 and held["only-late"] == 303


def test_only_the_state_decides(spark, tmp_path):
    path = write(spark, tmp_path / "t", [row("a", 1, 0), row("a", 2, 1)], [row("a", 3, 2), row("b", 4, 3)])
    empty = SeenStore(spark, f"file://{tmp_path}/none")
    assert empty.repeated().count() == 0 and empty.kept().count() == 0
    store = SeenStore(spark, f"file://{tmp_path}/store", trigger_bytes=1)
    store.run(path, spark.read.parquet(path).schema)
    assert {r.delivery_id for r in store.read().where("verdict = 'repeated'").collect()} == {2, 3}


def test_better_copies_replace_what_was_kept(spark, tmp_path):
    rows = [[row("a", 1, 0, sound=False)], [row("a", 2, 1, sound=False)], [row("a", 3, 2)], [row("a", 4, 3)]]
    path = write(spark, tmp_path / "t", *rows)
    store = SeenStore(spark, f"file://{tmp_path}/store", trigger_bytes=1)
    store.run(path, spark.read.parquet(path).schema)
    assert {(r.event_key, r.delivery_id) for r in store.repeated().collect()} == brute(sum(rows, []))
    assert [r.delivery_id for r in store.kept().collect()] == [3]


def test_run_again_adds_only_new_files(spark, tmp_path):
    path = write(spark, tmp_path / "t", [row("a", 1, 0)])
    store = SeenStore(spark, f"file://{tmp_path}/store")
    schema = spark.read.parquet(path).schema
    store.run(path, schema)
    write(spark, tmp_path / "t", [row("a", 2, 1), row("b", 3, 1)])
    store.run(path, schema)
    store.run(path, schema)
    assert {(r.event_key, r.delivery_id) for r in store.repeated().collect()} == {("a", 2)}
    assert {(r.event_key, r.delivery_id) for r in store.kept().collect()} == {("a", 1), ("b", 3)}


def test_empty_table_and_one_event_with_most_deliveries(spark, tmp_path):
    assert repeated_deliveries(spark, write(spark, tmp_path / "none", [])).count() == 0
    random.seed(1)
    rows = [row("hot" if random.random() < 0.5 else f"e{random.randrange(200)}", i, random.randrange(90), sound=random.random() < 0.8) for i in range(800)]
    got = {tuple(r) for r in repeated_deliveries(spark, write(spark, tmp_path / "t", rows[:500], rows[500:]), trigger_bytes=1).collect()}
    assert got == brute(rows)
