from pyspark.sql import functions as F

from threadloom.functions.text import utf16_slice
from threadloom.operators import control, curation, intake, lifecycle
from pyspark.sql import functions as F

EVENT = "event_key string, project_id string, role string, source_agent string, seq_id bigint, timestamp string, content string, sound boolean"


def test_utf16_slice_counts_units(spark):
    texts = ["a𠮷b", "𠮷𠮷", "abc", "", None, "中文"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(*(utf16_slice(F.col("t"), n) for n in (1, 2, 3))).collect()
    assert [tuple(r) for r in rows] == [("a", "a�", "a𠮷"), ("�", "𠮷", "𠮷�"), ("a", "ab", "abc"), ("", "", ""), (None, None, None), ("中", "中文", "中文")]


def test_skipped_messages(spark):
    rows = [("user", " /Capture  OFF "), ("assistant", "/capture off"), ("user", "please do NOT save this"), ("assistant", "do not save"), ("user", " ​"), ("user", None), ("user", "hello"), ("user", "capture on")]
    got = [r.skipped for r in intake.skipped(spark.createDataFrame(rows, "role string, content string")).collect()]
    assert got == ["session_off", None, "user_opt_out", None, "unsupported_or_empty", "unsupported_or_empty", None, "session_on"]
    paused = [r.skipped for r in intake.skipped(spark.createDataFrame(rows, "role string, content string"), paused=True).collect()]
    assert paused == [g or "paused" for g in got]


def test_switched_off_spans(spark):
    says = ["hi", "capture off", "a", "capture off", "b", "capture on", "c", "capture on", "capture off", "d"]
    rows = [(f"e{i}", "t1", i, "user", c) for i, c in enumerate(says)] + [("x", "t2", 4, "user", "other"), ("y", None, 4, "user", "capture off"), ("z", "t1", None, "user", "no place")]
    got = intake.switched_off(spark.createDataFrame(rows, "event_key string, token string, seq_id bigint, role string, content string")).collect()
    assert sorted(r.event_key for r in got) == ["e1", "e2", "e3", "e4", "e5", "e8", "e9"]


def test_recent_equivalents(spark):
    def row(key, minute, content, role="user", agent="codex", sound=True, project="p"):
        return (key, project, role, agent, minute, f"2025-01-01T00:{minute:02d}:00Z", content, sound)

    rows = [
        row("a", 0, "Remember this: the port is 8080"), row("b", 4, "remember this:  the PORT is 8080 and more"), row("c", 9, "remember this: the port is 8080, always"), row("d", 10, "remember this: the port is 8080, always!"),
        row("e", 10, "remember this: the port is 8080, always!", role="assistant"), row("f", 11, "remember this: the port is 8080", project="q"), row("g", 12, "the port"), row("h", 12, "8080"), row("i", 13, "the port is 8080", agent="other"), row("j", 14, "remember this: the port is 8080", sound=False), (None,) * 8,
    ]
    got = {r.event_key: r.owner_key for r in intake.recent_equivalents(spark.createDataFrame(rows, EVENT)).collect()}
    assert got == {"b": "a", "d": "c", "g": "d", "i": "d", "j": "d"}


def test_recovery_moves_sequences_forward_only(spark):
    staged = spark.createDataFrame([("p", "a", 3), ("p", "a", 3), ("p", "b", 4), ("q", "c", 2), ("r", "d", 1)], "project_id string, event_key string, sequence bigint")
    now = spark.createDataFrame([("p", 2), ("q", 9)], "project_id string, sequence bigint")
    assert {tuple(r) for r in intake.recovered(staged, now).collect()} == {("p", 2, 4), ("q", 1, 9), ("r", 1, 1)}


def test_safe_ids_and_tokens(spark):
    rows = spark.createDataFrame([("ok-1.a",), ("-bad",), ("a/b",), ("",), (None,), ("x" * 129,)], "v string").select(intake.safe_id(F.col("v")).alias("s"), intake.session_token(F.lit("codex"), F.col("v")).alias("t")).collect()
    assert rows[0].s == "ok-1.a" and all(r.s.startswith("id_") and len(r.s) == 23 for r in (rows[1], rows[2], rows[3], rows[5])) and rows[4].s is None
    assert rows[3].t is None and rows[4].t is None and len(rows[0].t) == 64


MEMORY = "id string, project_id string, status string, created_at string, source_events array<string>"


def test_controls(spark):
    memories = spark.createDataFrame([("m1", "p", "active", "2025-01-01", ["e1", "e2"]), ("m2", "p", "active", "2025-01-02", []), ("m3", "q", "draft", "2025-01-01", None)], MEMORY)
    feed = spark.createDataFrame([("delete", "m1", "b", "2025-01-03"), ("forget", "m1", "A", "2025-01-02"), ("forget", "m1", "a ", "2025-01-02"), ("odd", "m2", "c", "x"), ("forget", None, "d", "x")], "kind string, target_memory_id string, event_id string, timestamp string")
    got = {r.memory_id: (r.effective_status, r.control_events) for r in control.inspect(memories, feed).collect()}
    assert got == {"m1": ("deleted", ["a", "b"]), "m2": ("active", []), "m3": ("draft", [])}
    ids = spark.createDataFrame([("m1",), ("m1",), ("m3",), ("none",)], "memory_id string")
    assert {(r.target_memory_id, tuple(r.evidence_refs)) for r in control.deletions(memories, ids).collect()} == {("m1", ("e1", "e2")), ("m3", ("m3",))}
    assert [r.id for r in control.without(memories, ids).collect()] == ["m2"]
    events = spark.createDataFrame([("p", "x", 1, "t1"), ("p", "y", 1, "t2"), ("r", "z", 0, None)], "project_id string, event_key string, seq_id bigint, timestamp string")
    assert {tuple(r) for r in control.last_records(memories, events).collect()} == {("p", "m2", "y"), ("q", "m3", None), ("r", None, "z")}


def test_corrections_need_text_and_evidence(spark):
    memories = spark.createDataFrame([("m1", "p")], "id string, project_id string")
    rows = [("c1", "m1", "  The port is 9090 now ", ["e1", "e1"], "t"), ("c2", "m1", " ", ["e"], "t"), ("c3", "m1", "text", [], "t"), ("c4", "gone", "text", ["e"], "t"), ("c5", "m1", None, None, None)]
    got = control.corrected(memories, spark.createDataFrame(rows, "event_id string, target_memory_id string, summary string, evidence_refs array<string>, timestamp string")).collect()
    assert [(r.summary, r.tags, r.source_events, r.supersedes) for r in got] == [("The port is 9090 now", ["the", "port", "now"], ["e1"], ["m1"])]


def test_live_sessions(spark):
    def session(name, *events):
        return [(name, "p", "r", e, "success", f"{name}-{i}", i) for i, e in enumerate(events)]

    rows = session("good", "SessionStart", "UserPromptSubmit", "Stop") + session("no-start", "UserPromptSubmit", "Stop") + session("tampered", "SessionStart", "UserPromptSubmit", "Stop") + session("no-reply", "SessionStart", "UserPromptSubmit") + session(None, "SessionStart", "UserPromptSubmit", "Stop")
    role = {"UserPromptSubmit": "user", "Stop": "assistant", "SessionStart": "system"}
    stored = [(r[5], r[0], role[r[3]], r[5] != "tampered-2") for r in rows]
    got = lifecycle.verified_sessions(spark.createDataFrame(rows, "session_id string, project_id string, runtime string, event string, outcome string, event_key string, at bigint"), spark.createDataFrame(stored, "event_key string, session_id string, role string, sound boolean"))
    assert [tuple(r) for r in got.collect()] == [("good", "p", "r", 2)]


def test_relations_are_set_once(spark):
    schema = "project_id string, term_a string, term_b string, relation_type string, confidence double, context_tags array<string>"
    first = curation.set_relations(curation.term_relations(spark.createDataFrame([], schema)).drop("fault").selectExpr("*", "'' AS created_at", "'' AS last_verified"), spark.createDataFrame([("p", "B c", "A", "alias", 0.5, None)], schema), "t1")
    again = curation.set_relations(first, spark.createDataFrame([("p", "a", "b-C", "synonym", 0.9, []), ("p", "a", "a", "alias", 0.9, [])], schema), "t2").collect()
    assert [(r.term_a, r.term_b, r.relation_type, r.created_at, r.last_verified) for r in again] == [("a", "b-c", "synonym", "t1", "t2")]


def test_empty_tables(spark):
    none = spark.createDataFrame([], EVENT)
    assert intake.recent_equivalents(none).count() == 0 and intake.skipped(none).count() == 0
    assert intake.projects(spark.createDataFrame([], "project_id string, received_at timestamp, session_id string")).count() == 0
