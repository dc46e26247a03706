"""Queries over intake, controls, lifecycle evidence, curation and enrichment, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import text
from threadloom.functions.text import fold
from threadloom.operators import control, curation, evidence, intake, lifecycle, tags
from threadloom.operators.delivery import kept_copies, unsound
from threadloom.plans import retrieval
from threadloom.plans.archive import KEPT, S, clean_sql, utf16_sql
from threadloom.session import table

#: What switches capture off and on in the test tables.
COMMANDS = {"off": ("looks good", "ok"), "on": ("no", "可以")}
TERM = "message broker"
PROPOSED = [
    ("p", "Message  Broker", "thread-pool", "synonym", 0.9, []), ("p", "thread pool", "message-broker", "alias", 0.7, []), ("p", "build cache", "Build-Cache", "alias", 0.9, []),
    ("p", "ledger", "balance sheet", "contextual_equivalent", 0.9, []), ("p", "ledger", "balance sheet", "contextual_equivalent", 0.9, ["Finance ", "audit", "finance"]),
    ("p", "消息代理", "message broker", "alias", 1.0, []), ("p", "a", "b", "kin", 0.5, []), ("p", "a", "b", "related", 1.5, []), ("p", " ", "b", "related", 0.5, []),
]
RAW_SETTINGS = [
    ("recall.max_snippets", "8"), ("recall.max_snippets", "0"), ("recall.max_snippets", "8.5"), ("recall.max_characters", " 400 "), ("recall.timeout_ms", "abc"), ("capture.paused", "true"),
    ("capture.paused", "yes"), ("embedding.semantic_weight", "0.7"), ("embedding.semantic_weight", "1.01"), ("staleness.threshold_days", "3650"), ("no.such_key", "1"),
]
_FIELDS = ("project_id", "session_id", "turn_id", "seq_id", "role", "source_agent", "timestamp", "content")


def _kept(spark, sf_dir):
    rows = table(spark, sf_dir, "raw_events")
    kept = kept_copies(rows.where("event_id IS NOT NULL"), *(F.col(c) for c in _FIELDS), (unsound() == 0).alias("sound"))
    return kept.withColumn("role", fold(F.col("role")))


def _memories(spark, sf_dir):
    return evidence.memories(table(spark, sf_dir, "processed_memories"))


def intake_skipped(spark, sf_dir):
    return intake.skipped(_kept(spark, sf_dir), COMMANDS).groupBy("skipped").agg(F.count("*").alias("messages"))


def session_switch(spark, sf_dir):
    rows = _kept(spark, sf_dir).withColumn("token", intake.session_token(F.col("source_agent"), F.col("session_id")))
    return intake.switched_off(rows, COMMANDS).select("event_key", "token")


def safe_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "raw_events").select("delivery_id", F.col("session_id").alias("a"), F.col("event_id").alias("b"))
    return rows.select("delivery_id", intake.safe_id(F.col("a")).alias("safe_session"), intake.safe_id(F.col("b")).alias("safe_event"))


def recent_equivalents(spark, sf_dir):
    return intake.recent_equivalents(_kept(spark, sf_dir))


def pending_recovery(spark, sf_dir):
    """Captures whose savepoint is pending are taken as staged, with their number in arrival as sequence."""
    rows = table(spark, sf_dir, "raw_events").where("project_id IS NOT NULL AND event_id IS NOT NULL").select("project_id", fold(F.col("event_id")).alias("event_key"), F.col("delivery_id").alias("sequence"), "savepoint_status")
    done = rows.where("savepoint_status = 'complete'").groupBy("project_id").agg(F.max("sequence").alias("sequence"))
    return intake.recovered(rows.where("savepoint_status = 'pending'"), done)


def run_history(spark, sf_dir):
    runs = table(spark, sf_dir, "raw_events").where("project_id IS NOT NULL").groupBy("project_id", "batch_id").agg(F.max("received_at").alias("at"))
    return intake.run_history(runs).groupBy("project_id").agg(F.count("*").alias("runs"))


def projects(spark, sf_dir):
    return intake.projects(table(spark, sf_dir, "raw_events")).select("project_id", F.unix_micros("last_seen").alias("last_seen"), "sessions")


def inspect_memories(spark, sf_dir):
    return control.inspect(_memories(spark, sf_dir), table(spark, sf_dir, "memory_control_events")).withColumn("control_events", F.concat_ws(" ", "control_events"))


def _corrections(spark, sf_dir):
    feed = table(spark, sf_dir, "memory_control_events").where("kind = 'correct' AND event_id IS NOT NULL AND target_memory_id IS NOT NULL")
    least = F.min(F.struct("feed_id", F.col("reason").alias("summary"), "evidence_refs", "timestamp")).alias("e")
    return feed.groupBy(fold(F.col("event_id")).alias("event_id"), "target_memory_id").agg(least).select("event_id", "target_memory_id", "e.*")


def corrected_memories(spark, sf_dir):
    made = control.corrected(_memories(spark, sf_dir), _corrections(spark, sf_dir))
    joined = [F.concat_ws("|", c).alias(c) for c in ("tags", "retrieval_phrases", "source_events", "supersedes")]
    return made.select("memory_id", "project_id", "type", "title", "summary", "created_at", *joined)


def _deleted(spark, sf_dir):
    return table(spark, sf_dir, "memory_control_events").where("kind = 'delete'").select(F.col("target_memory_id").alias("memory_id")).where("memory_id IS NOT NULL")


def delete_processed(spark, sf_dir):
    """The control events that deleting every memory named by a deletion appends."""
    return control.deletions(_memories(spark, sf_dir), _deleted(spark, sf_dir)).withColumn("evidence_refs", F.concat_ws("|", "evidence_refs"))


def delete_rest(spark, sf_dir):
    return control.without(_memories(spark, sf_dir), _deleted(spark, sf_dir)).groupBy("project_id").agg(F.count("*").alias("memories"))


def delete_last(spark, sf_dir):
    return control.last_records(_memories(spark, sf_dir), _kept(spark, sf_dir).where("seq_id IS NOT NULL"))


def _overlaid(spark, sf_dir):
    return _memories(spark, sf_dir).where("size(predictive_tags) > 0").select(F.col("id").alias("memory_id"))


def enrichment_status(spark, sf_dir):
    """Memories with predictive tags are taken as enriched."""
    return control.enrichment_status(retrieval._docs(spark, sf_dir), table(spark, sf_dir, "memory_control_events"), _overlaid(spark, sf_dir))


def overlay_additions(spark, sf_dir):
    return control.additions(_memories(spark, sf_dir), "retrieval_phrases", "tags").withColumn("added", F.concat_ws("|", "added"))


def tag_candidates(spark, sf_dir):
    registry = tags.registry(_memories(spark, sf_dir), table(spark, sf_dir, "memory_control_events"))
    return control.tag_candidates(registry, retrieval._docs(spark, sf_dir), TERM)


def live_sessions(spark, sf_dir):
    """Every message is taken as what its hook recorded: system messages start sessions."""
    rows = _kept(spark, sf_dir)
    event = F.when(F.col("role") == "system", "SessionStart").when(F.col("role") == "user", "UserPromptSubmit").when(F.col("role") == "assistant", "Stop")
    records = rows.select("session_id", "project_id", F.col("source_agent").alias("runtime"), event.alias("event"), F.lit("success").alias("outcome"), "event_key", F.col("seq_id").alias("at"))
    return lifecycle.verified_sessions(records.where("at IS NOT NULL"), rows.select("event_key", "session_id", "role", "sound"))


def lifecycle_tail(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("project_id"), F.col("ts").alias("observed_at"), F.col("event_id").alias("record_id"))
    return lifecycle.tail(rows, 3).select("project_id", "record_id", "from_last")


def term_relation_set(spark, sf_dir):
    rows = spark.createDataFrame(PROPOSED, "project_id string, term_a string, term_b string, relation_type string, confidence double, context_tags array<string>")
    return curation.term_relations(rows).withColumn("context", F.concat_ws("|", "context"))


def settings_checked(spark, sf_dir):
    return curation.checked_settings(spark.createDataFrame(RAW_SETTINGS, "key string, raw string")).select("key", "raw", "valid", F.expr("try_cast(value AS double)").alias("number"))


def utf16_titles(spark, sf_dir):
    """The first 33 UTF-16 units of every text, a character beyond the basic plane put before each."""
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return rows.select("doc_id", text.utf16_slice(F.concat(F.lit("𠮷a𠮷"), F.translate("text", "的e", "𠮷𠮶")), 33).alias("title"))


_ALL = (
    intake_skipped, session_switch, safe_ids, recent_equivalents, pending_recovery, run_history, projects, inspect_memories, corrected_memories, delete_processed, delete_rest, delete_last,
    enrichment_status, overlay_additions, tag_candidates, live_sessions, lifecycle_tail, term_relation_set, settings_checked, utf16_titles,
)
QUERIES = {q.__name__: q for q in _ALL}

# SQL.
_K = f"SELECT *, coalesce(lower(content_hash) = sha256(content), false) AS sound, lower(trim(role)) AS r FROM ({KEPT}) WHERE event_id IS NOT NULL"
_SAID = lambda name: "(" + ", ".join(f"'{c}'" for c in COMMANDS[name]) + ")"
_CMD = f"CASE WHEN lower({clean_sql('content')}) IN {_SAID('off')} THEN 'off' WHEN lower({clean_sql('content')}) IN {_SAID('on')} THEN 'on' END"
_VISIBLE = "regexp_matches(coalesce({}, ''), '[^\\s\\p{{Z}}\\p{{Cc}}\\p{{Cf}}\\x{{034F}}\\x{{115F}}\\x{{1160}}\\x{{17B4}}\\x{{17B5}}\\x{{180B}}-\\x{{180E}}\\x{{2800}}\\x{{3164}}\\x{{FE00}}-\\x{{FE0F}}\\x{{FFA0}}]')"
_MEM = retrieval._MEM
_TOKEN = f"CASE WHEN {_VISIBLE.format('session_id')} THEN sha256(source_agent || chr(0) || session_id) END"
_EXPLICIT = "regexp_matches({}, '(?i)(?:记一下|记住|保存这个|remember this)')"
_SAFE = lambda c: f"CASE WHEN regexp_matches({c}, '^[a-zA-Z0-9][a-zA-Z0-9._-]{{0,127}}$') THEN {c} ELSE 'id_' || sha256({c})[1:20] END"
_NAMED = "SELECT target_memory_id FROM memory_control_events WHERE target_memory_id IS NOT NULL"
_NORM = f"regexp_replace(regexp_replace(lower(t), '[{S}\\x{{0085}}\\p{{Z}}]+', '-', 'g'), '^-+|-+$', '', 'g')"
_CLEAN_LIST = lambda c: f"[{clean_sql('x')} FOR x IN coalesce({c}, [])]"
_FOUND = "list_concat(regexp_extract_all(lower(t), '[a-z][a-z0-9_-]{2,}'), regexp_extract_all(t, '\\p{Han}{2,8}'))"
_WORDS = f"[{_FOUND}[i] FOR i IN range(1, len({_FOUND}) + 1) IF list_position({_FOUND}, {_FOUND}[i]) = i][1:12]"
ORACLES = {
    "intake_skipped": f"""
SELECT skipped, count(*) AS messages FROM (SELECT CASE WHEN r = 'user' AND {_CMD} IS NOT NULL THEN 'session_' || {_CMD} WHEN NOT {_VISIBLE.format('content')} THEN 'unsupported_or_empty'
  WHEN r = 'user' AND regexp_matches(content, '(?i)不要记|不要保存|don''t save|do not save') THEN 'user_opt_out' END AS skipped FROM ({_K})) GROUP BY ALL""",
    "session_switch": f"""
WITH k AS (SELECT *, {_TOKEN} AS token, CASE WHEN r = 'user' THEN {_CMD} END AS said FROM ({_K})), c AS (SELECT * FROM k WHERE said IS NOT NULL AND seq_id IS NOT NULL AND token IS NOT NULL)
SELECT event_key, token FROM k WHERE seq_id IS NOT NULL AND token IS NOT NULL AND (
  said = 'off' OR (SELECT arg_max(c.said, (c.seq_id, c.event_key)) FROM c WHERE c.token = k.token AND (c.seq_id, c.event_key) < (k.seq_id, k.event_key)) = 'off')""",
    "safe_ids": f"SELECT delivery_id, {_SAFE('session_id')} AS safe_session, {_SAFE('event_id')} AS safe_event FROM raw_events",
    "recent_equivalents": f"""
WITH k AS (SELECT event_key, project_id, r, seq_id, source_agent, timestamp, content, sound, lower({clean_sql('content')}) AS t, CASE WHEN regexp_matches(timestamp, '[0-9]{{2}}:[0-9]{{2}}.*(Z|z|[+-][0-9:]+)$') THEN try_cast(timestamp AS TIMESTAMPTZ) END AS at FROM ({_K}))
SELECT n.event_key, arg_max(o.event_key, (o.timestamp, o.seq_id, o.event_key)) AS owner_key FROM k n JOIN k o ON o.project_id = n.project_id AND o.r = n.r AND o.event_key <> n.event_key
WHERE o.sound AND o.source_agent IN ('claude-code', 'codex') AND {_EXPLICIT.format('o.content')} AND n.at - o.at BETWEEN INTERVAL 0 SECOND AND INTERVAL 5 MINUTE AND length(n.t) >= 8
  AND (contains(n.t, o.t) OR contains(o.t, n.t)) GROUP BY n.event_key""",
    "pending_recovery": """
WITH r AS (SELECT project_id, lower(trim(event_id)) AS event_key, delivery_id, savepoint_status FROM raw_events WHERE project_id IS NOT NULL AND event_id IS NOT NULL)
SELECT project_id, count(DISTINCT event_key) FILTER (savepoint_status = 'pending') AS recovered, max(delivery_id) FILTER (savepoint_status IN ('pending', 'complete')) AS sequence
FROM r GROUP BY project_id HAVING count(*) FILTER (savepoint_status = 'pending') > 0""",
    "run_history": """
WITH runs AS (SELECT project_id, batch_id, max(received_at) AS "at" FROM raw_events WHERE project_id IS NOT NULL GROUP BY ALL)
SELECT project_id, count(*) AS runs FROM (SELECT *, max("at") OVER (PARTITION BY project_id) AS last FROM runs) WHERE "at" >= last - INTERVAL 24 HOUR GROUP BY project_id""",
    "projects": "SELECT project_id, epoch_us(max(received_at)) AS last_seen, count(DISTINCT session_id) AS sessions FROM raw_events WHERE project_id IS NOT NULL GROUP BY project_id",
    "inspect_memories": f"""
SELECT m.id AS memory_id, coalesce(s.status, m.status) AS effective_status, coalesce(e.ids, '') AS control_events FROM ({_MEM}) m LEFT JOIN ({retrieval._STATES}) s ON s.target_memory_id = m.id
LEFT JOIN (SELECT target_memory_id, string_agg(event_id, ' ' ORDER BY ts, event_id) AS ids FROM (SELECT target_memory_id, lower(trim(event_id)) AS event_id, max(timestamp) AS ts FROM memory_control_events
  WHERE kind IN ('forget', 'correct', 'delete') AND event_id IS NOT NULL GROUP BY ALL) GROUP BY ALL) e ON e.target_memory_id = m.id""",
    "corrected_memories": f"""
SELECT 'mem_' || sha256(event_id)[1:32] AS memory_id, project_id, 'correction' AS type, {utf16_sql('t', 80)} AS title, t AS summary, timestamp AS created_at, array_to_string({_WORDS}, '|') AS tags,
  array_to_string(['关于 ' || w || ' 的纠正' FOR w IN {_WORDS}], '|') AS retrieval_phrases, array_to_string([evidence_refs[i] FOR i IN range(1, len(evidence_refs) + 1) IF list_position(evidence_refs, evidence_refs[i]) = i], '|') AS source_events, target AS supersedes
FROM (SELECT c.event_id, c.target_memory_id AS target, regexp_replace(c.reason, '^[{S}]+|[{S}]+$', '', 'g') AS t, c.evidence_refs, c.timestamp, m.project_id
  FROM (SELECT lower(trim(event_id)) AS event_id, target_memory_id, arg_min(struct_pack(x := reason), feed_id).x AS reason, arg_min(struct_pack(x := evidence_refs), feed_id).x AS evidence_refs, arg_min(struct_pack(x := timestamp), feed_id).x AS timestamp
        FROM memory_control_events WHERE kind = 'correct' AND event_id IS NOT NULL AND target_memory_id IS NOT NULL GROUP BY ALL) c JOIN ({_MEM}) m ON m.id = c.target_memory_id)
WHERE t <> '' AND len(evidence_refs) > 0""",
    "delete_processed": f"""
SELECT 'delete' AS kind, project_id, id AS target_memory_id, CASE WHEN len(source_events) > 0 THEN array_to_string(source_events, '|') ELSE id END AS evidence_refs
FROM ({_MEM}) WHERE id IN (SELECT target_memory_id FROM memory_control_events WHERE kind = 'delete')""",
    "delete_rest": f"SELECT project_id, count(*) AS memories FROM ({_MEM}) WHERE id NOT IN (SELECT target_memory_id FROM memory_control_events WHERE kind = 'delete' AND target_memory_id IS NOT NULL) GROUP BY ALL",
    "delete_last": f"""
SELECT coalesce(a.project_id, b.project_id) AS project_id, last_memory, last_event
FROM (SELECT project_id, arg_max(id, (created_at, id)) AS last_memory FROM ({_MEM}) GROUP BY ALL) a
FULL JOIN (SELECT project_id, arg_max(event_key, (seq_id, timestamp, event_key)) AS last_event FROM ({_K}) WHERE seq_id IS NOT NULL GROUP BY ALL) b ON a.project_id = b.project_id""",
    "enrichment_status": f"""
SELECT project_id, count(*) FILTER (coalesce(len(predictive_tags), 0) = 0) AS pending, count(*) FILTER (len(predictive_tags) > 0) AS enriched
FROM ({retrieval._DOCS}) WHERE "index" AND source_hash IS NOT NULL AND memory_id NOT IN ({_NAMED}) GROUP BY project_id""",
    "overlay_additions": f"""
SELECT id AS memory_id, array_to_string(added, '|') AS added FROM (
  SELECT id, list_sort(list_distinct([v FOR v IN {_CLEAN_LIST('retrieval_phrases')} IF v <> '' AND NOT list_contains({_CLEAN_LIST('tags')}, v)])) AS added FROM ({_MEM})) WHERE len(added) > 0""",
    "tag_candidates": f"""
SELECT * FROM (SELECT r.project_id, r.tag, r.usage_count, e.evidence, r.tag = 'message-broker' AS exact,
    row_number() OVER (PARTITION BY r.project_id ORDER BY r.tag = 'message-broker' DESC, r.usage_count DESC, r.tag) AS rank
  FROM ({retrieval._REG}) r JOIN (SELECT project_id, tag, min(memory_id) AS evidence FROM (SELECT project_id, memory_id, {_NORM} AS tag FROM (SELECT project_id, memory_id, unnest(search_tags) AS t FROM ({retrieval._DOCS}) WHERE "index")) GROUP BY ALL) e
    ON e.project_id = r.project_id AND e.tag = r.tag) WHERE rank <= 128""",
    "live_sessions": f"""
WITH k AS (SELECT *, source_agent AS runtime FROM ({_K}) WHERE seq_id IS NOT NULL AND session_id IS NOT NULL),
s AS (SELECT session_id, project_id, runtime, bool_or(r = 'system') AS started, arg_max(event_key, (seq_id, event_key)) FILTER (r = 'user') AS prompt, arg_max(event_key, (seq_id, event_key)) FILTER (r = 'assistant') AS reply,
             max(seq_id) FILTER (true) AS latest FROM k GROUP BY ALL)
SELECT session_id, project_id, runtime, latest FROM s WHERE started AND prompt IN (SELECT event_key FROM k WHERE sound) AND reply IN (SELECT event_key FROM k WHERE sound)""",
    "lifecycle_tail": """
SELECT * FROM (SELECT user_id AS project_id, event_id AS record_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS from_last FROM events) WHERE from_last <= 3""",
    "term_relation_set": """
WITH p AS (SELECT *, list_sort([regexp_replace(trim(lower(term_a)), ' +', ' ', 'g'), regexp_replace(trim(lower(term_b)), ' +', ' ', 'g')]) AS terms, list_sort(list_distinct([trim(lower(c)) FOR c IN context_tags])) AS ctx
  FROM (VALUES ('p', 'Message  Broker', 'thread-pool', 'synonym', 0.9, []::VARCHAR[]), ('p', 'thread pool', 'message-broker', 'alias', 0.7, []), ('p', 'build cache', 'Build-Cache', 'alias', 0.9, []),
    ('p', 'ledger', 'balance sheet', 'contextual_equivalent', 0.9, []), ('p', 'ledger', 'balance sheet', 'contextual_equivalent', 0.9, ['Finance ', 'audit', 'finance']), ('p', '消息代理', 'message broker', 'alias', 1.0, []),
    ('p', 'a', 'b', 'kin', 0.5, []), ('p', 'a', 'b', 'related', 1.5, []), ('p', ' ', 'b', 'related', 0.5, [])) v(project_id, term_a, term_b, relation_type, confidence, context_tags)),
q AS (SELECT *, list_sort([replace(t, '-', ' ') FOR t IN terms]) AS ks FROM p)
SELECT project_id, 'tr_' || sha256('[' || to_json(ks) || ',' || to_json(ctx) || ']')[1:24] AS relation_id, terms[1] AS term_a, terms[2] AS term_b, relation_type, confidence::DOUBLE AS confidence, array_to_string(ctx, '|') AS context,
  CASE WHEN terms[1] = '' OR ks[1] = ks[2] THEN 'terms' WHEN relation_type = 'contextual_equivalent' AND len(ctx) = 0 THEN 'context' WHEN relation_type = 'kin' THEN 'type' WHEN confidence > 1 THEN 'confidence' END AS fault FROM q""",
    "settings_checked": """
SELECT * FROM (VALUES ('recall.max_snippets', '8', true, 8.0::DOUBLE), ('recall.max_snippets', '0', false, NULL), ('recall.max_snippets', '8.5', false, NULL), ('recall.max_characters', ' 400 ', true, 400), ('recall.timeout_ms', 'abc', false, NULL),
  ('capture.paused', 'true', true, NULL), ('capture.paused', 'yes', false, NULL), ('embedding.semantic_weight', '0.7', true, 0.7), ('embedding.semantic_weight', '1.01', false, NULL), ('staleness.threshold_days', '3650', true, 3650), ('no.such_key', '1', false, NULL)) v(key, raw, valid, number)""",
    "utf16_titles": f"SELECT doc_id, {utf16_sql(chr(39) + '𠮷a𠮷' + chr(39) + ' || translate(text, ' + chr(39) + '的e' + chr(39) + ', ' + chr(39) + '𠮷𠮶' + chr(39) + ')', 33)} AS title FROM documents WHERE text IS NOT NULL",
}
