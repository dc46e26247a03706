"""Queries over captured messages: identity, sequence, sensitivity, terms, memories, decisions, queue; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import decisions, sensitivity, text
from threadloom.operators import capture, decision_views, processing
from threadloom.session import materialise, table

NOW = "2026-07-01T00:00:00Z"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.captured(table(spark, sf_dir, "raw_events"))


def capture_ids_dedupe(spark, sf_dir):
    return events(spark, sf_dir).select("event_key", "capture_id", "computed_hash")


def capture_seq(spark, sf_dir):
    return capture.sequenced(events(spark, sf_dir)).select("event_key", "project_id", "sequence")


def sensitivity_levels(spark, sf_dir):
    rows = table(spark, sf_dir, "raw_events")
    return rows.select("delivery_id", sensitivity.level(F.col("content")).alias("level"), F.concat_ws(",", sensitivity.detectors(F.col("content"))).alias("detectors"))


def redact_secrets(spark, sf_dir):
    return table(spark, sf_dir, "raw_events").select("delivery_id", sensitivity.redact(F.col("content")).alias("redacted"))


def tokenize_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(text.tokenize(F.lower("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def keywords_top12(spark, sf_dir):
    return events(spark, sf_dir).select("event_key", F.concat_ws(" ", text.keywords(text.normalize_text(F.col("content")))).alias("keywords"))


def memory_from_event(spark, sf_dir):
    return processing.memories(stored(spark, sf_dir)).withColumn("tags", F.concat_ws(" ", "tags"))


def decision_kind(spark, sf_dir):
    kinds = events(spark, sf_dir).select("event_key", decisions.kind(text.normalize_text(F.col("content"))).alias("kind"))
    return kinds.where("kind IS NOT NULL")


def decision_topic_alias(spark, sf_dir):
    clean = text.normalize_text(F.col("content"))
    return events(spark, sf_dir).select("event_key", decisions.topic(clean).alias("topic"), F.concat_ws(",", decisions.aliases(clean)).alias("aliases"))


def stored(spark, sf_dir):
    """The captured messages with their normalised text, written once, so that no later plan carries both inside it."""
    return materialise(events(spark, sf_dir).withColumn("clean", text.normalize_text(F.col("content"))), "captured")


def _decisions(spark, sf_dir):
    return materialise(processing.decision_events(stored(spark, sf_dir)), "decisions")


def decision_view(spark, sf_dir):
    return decision_views.views(_decisions(spark, sf_dir))


def decision_conflicts(spark, sf_dir):
    return decision_views.conflicts(_decisions(spark, sf_dir))


def decision_timeline(spark, sf_dir):
    return decision_views.timeline(_decisions(spark, sf_dir))


def supersede_fold(spark, sf_dir):
    return decision_views.superseded(_decisions(spark, sf_dir))


def decision_superseded_anti(spark, sf_dir):
    rows = _decisions(spark, sf_dir)
    return rows.join(decision_views.superseded(rows), "event_id", "left_anti").groupBy("canonical_id").agg(F.count("*").alias("standing"))


def queue_order(spark, sf_dir):
    return processing.first_in_queue(capture.queued(events(spark, sf_dir))).select("project_id", "event_key", "priority", "position")


def queue_token_budget(spark, sf_dir):
    captured = events(spark, sf_dir)
    return processing.within_budget(capture.queued(captured), captured, tokens=2_000)


def processing_decision(spark, sf_dir):
    captured = events(spark, sf_dir)
    sizes = captured.select("event_key", F.octet_length("content").alias("bytes"))
    return processing.run_due(capture.queued(captured), sizes, NOW)


_ALL = (
    capture_ids_dedupe, capture_seq, sensitivity_levels, redact_secrets, tokenize_counts, keywords_top12, memory_from_event, decision_kind,
    decision_topic_alias, decision_view, decision_conflicts, decision_timeline, supersede_fold, decision_superseded_anti, queue_order,
    queue_token_budget, processing_decision,
)
QUERIES = {q.__name__: q for q in _ALL}

# SQL. RE2 has ASCII word boundaries; white space is spelled out as in the operators.
S = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
KEPT = """
SELECT * EXCLUDE (n) FROM (
  SELECT lower(trim(event_id)) AS event_key, *, row_number() OVER (PARTITION BY lower(trim(event_id))
    ORDER BY CASE WHEN lower(content_hash) = sha256(content) THEN 0 ELSE 1 END, received_at, delivery_id) AS n
  FROM raw_events) WHERE n = 1"""
#: The detectors of ``functions.sensitivity``, as RE2 reads them.
_SECRETS = {
    "private_key": "(?i)-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----",
    "credential_assignment": rf"(?i)\b(?:api[_-]?key|access[_-]?token|auth[_-]?token|password|passwd|secret)\b[{S}]*[:=][{S}]*[\"'']?[^{S}\"'']{{6,}}",
    "bearer_token": rf"(?i)\bBearer[{S}]+[A-Za-z0-9._~+/=-]{{12,}}",
    "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b",
    "github_token": r"\b(?:ghp|github_pat)_[A-Za-z0-9_]{20,}\b",
    "openai_key": r"\bsk-[A-Za-z0-9_-]{20,}\b",
}
_SENSITIVE = {
    "email": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "phone": r"(?:^|[^0-9])(?:\+?86[- ]?)?1[3-9][0-9]{9}(?:$|[^0-9])",
    "address_hint": rf"(?i)(?:住址|家庭地址|home address)[{S}]*[:：]",
}
_hit = lambda t, p: f"regexp_matches({t}, '{p}')"
_any = lambda t, ps: " OR ".join(_hit(t, p) for p in ps.values())
_names = lambda t, ps: "concat_ws(',', " + ", ".join(f"CASE WHEN {_hit(t, p)} THEN '{n}' END" for n, p in ps.items()) + ")"


_ASTRAL = "[\\x{10000}-\\x{10FFFF}]"


def utf16_sql(t: str, n: int) -> str:
    """The first ``n`` UTF-16 units of ``t``."""
    wide = f"regexp_replace({t}, '({_ASTRAL})', '\\1' || chr(1), 'g')"
    cut = f"regexp_replace(substring({wide}, 1, {n}), '{_ASTRAL}$', chr(65533))"
    return f"regexp_replace({cut}, '({_ASTRAL})' || chr(1), '\\1', 'g')"


def level_sql(t: str) -> str:
    return f"CASE WHEN {_any(t, _SECRETS)} THEN 'secret' WHEN {_any(t, _SENSITIVE)} THEN 'sensitive' ELSE 'normal' END"


def _redact_sql(t: str) -> str:
    for name, p in _SECRETS.items():
        t = f"regexp_replace({t}, '{p}', '[REDACTED:{name}]', 'g')"
    return t


def clean_sql(t: str) -> str:
    return f"regexp_replace(regexp_replace({t}, '^[{S}]+|[{S}]+$', '', 'g'), '[{S}]+', ' ', 'g')"


def tokens_sql(t: str) -> str:
    han = f"regexp_extract_all(lower({t}), '\\p{{Han}}+')"
    pairs = f"flatten([CASE WHEN length(r) <= 2 THEN [r] ELSE [substring(r, i, 2) FOR i IN range(1, length(r))] END FOR r IN {han}])"
    return f"list_concat(regexp_extract_all(lower({t}), '[a-z0-9][a-z0-9_-]*'), {pairs})"


def _q(p: str) -> str:
    return "(?i)(?:" + p.replace("'", "''") + ")"


_KIND = "CASE " + " ".join(f"WHEN {_hit('clean', _q(p))} THEN '{n}'" for n, p in decisions.KINDS.items()) + " END"
_TOPIC = "CASE " + " ".join("WHEN " + " AND ".join(_hit("clean", _q(p)) for p in ps) + f" THEN '{n}'" for n, ps in decisions.TOPICS.items())
_TOPIC += " WHEN regexp_extract(lower(clean), '[a-z][a-z0-9_-]{2,}') <> '' THEN regexp_extract(lower(clean), '[a-z][a-z0-9_-]{2,}') ELSE " + utf16_sql("clean", 32) + " END"
_ALIASES = "concat_ws(',', " + ", ".join(f"CASE WHEN {_hit('clean', _q(p))} THEN '{','.join(n)}' END" for p, n in decisions.ALIASES.items()) + ")"
_STOPS = "[" + ", ".join(f"'{w}'" for w in text.KEYWORD_STOPS) + "]"
_WORDS = rf"list_concat(regexp_extract_all(lower(clean), '[a-z][a-z0-9_-]{{2,}}'), regexp_extract_all(clean, '\p{{Han}}{{2,8}}'))"
_TAGS = f"array_to_string([w FOR w, i IN {_WORDS} IF NOT list_contains({_STOPS}, w) AND list_position({_WORDS}, w) = i][1:12], ' ')"
EVENTS = f"""
SELECT event_key, 'evt_' || sha256(coalesce(project_id, '') || chr(0) || event_key)[1:24] AS capture_id, project_id, session_id, r AS role, timestamp, content,
       {clean_sql("content")} AS clean, sha256(content) AS computed_hash, sensitivity, savepoint_status, content_hash, raw_ref
FROM (SELECT * REPLACE (CASE WHEN level = 'secret' THEN {_redact_sql("content")} ELSE content END AS content, level AS sensitivity)
      FROM (SELECT *, lower(trim(role)) AS r, {level_sql("content")} AS level FROM ({KEPT}))
      WHERE r IN ('user', 'assistant', 'system') AND content IS NOT NULL)"""
_EXPLICIT = f"(role = 'user' AND {_hit('content', _q(decisions.EXPLICIT))})"
_MEMORIES = f"""
SELECT 'mem_' || sha256(event_key)[1:24] AS memory_id, project_id, coalesce(kind, 'conversation') AS type, {utf16_sql("clean", 80)} AS title, {utf16_sql("clean", 1000)} AS summary,
       {_TAGS} AS tags, event_key AS source_event, CASE WHEN {_EXPLICIT} THEN 1.0::DOUBLE ELSE 0.65::DOUBLE END AS confidence,
       CASE WHEN {_EXPLICIT} THEN 'user_explicit' ELSE 'agent_inferred' END AS source, sensitivity, timestamp AS created_at
FROM (SELECT *, {_KIND} AS kind FROM ({EVENTS})) WHERE sensitivity <> 'secret'
  AND NOT (role = 'assistant' AND NOT {_EXPLICIT} AND length(clean) < 20 AND kind IS NULL AND NOT {_hit("clean", _q("记住|remember"))})"""
DECISIONS = f"""
SELECT 'de_' || sha256(event_key)[1:24] AS event_id, 'd_' || sha256(coalesce(project_id, '') || chr(0) || lower(trim(topic)))[1:20] AS canonical_id, project_id, topic, aliases, kind,
       CASE WHEN kind = 'rejection' THEN 'rejected' WHEN kind IN ('decision', 'current_state', 'correction') AND {_hit("clean", _q(decisions.CURRENT))} THEN 'current' ELSE 'proposed' END AS status,
       clean AS statement, CASE WHEN role = 'user' THEN 'user_explicit' ELSE 'agent_inferred' END AS source, event_key, timestamp,
       CASE WHEN role = 'user' THEN CASE WHEN {_EXPLICIT} THEN 1.0 ELSE 0.95 END ELSE 0.7 END::DOUBLE AS confidence
FROM (SELECT *, {_KIND} AS kind, {_TOPIC} AS topic, {_ALIASES} AS aliases FROM ({EVENTS})) WHERE kind IS NOT NULL AND sensitivity <> 'secret'"""
_SETTING = "(NOT (source = 'agent_inferred' AND confidence < 0.75) AND status IN ('accepted', 'rejected', 'reopened', 'current') AND kind IN ('decision', 'current_state', 'correction', 'rejection'))"
VIEWS = f"""
SELECT canonical_id, arg_min(topic, (timestamp, event_id)) AS topic, count(*) AS events,
       arg_max(event_id, (source = 'user_explicit', timestamp, event_id)) FILTER ({_SETTING}) AS current_event_id,
       coalesce(arg_max(status, (source = 'user_explicit', timestamp, event_id)) FILTER ({_SETTING}), 'unknown') AS current_status,
       coalesce(arg_max(confidence, (source = 'user_explicit', timestamp, event_id)) FILTER ({_SETTING}), 0) AS confidence, max(timestamp) AS updated_at
FROM ({DECISIONS}) GROUP BY canonical_id"""
_QUEUE = f"""
SELECT project_id, event_key, content, timestamp AS created_at, CASE WHEN {_EXPLICIT} THEN 'explicit' ELSE 'normal' END AS priority FROM ({EVENTS})"""
_FIRST = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY priority <> 'explicit', created_at, event_key) AS position FROM ({_QUEUE})) WHERE position <= 100"""
_TOKENS = "greatest(1, ceil((length(content) + length(regexp_replace(content, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))) / 4))::BIGINT"
_FOLD = f"""
WITH RECURSIVE r AS (SELECT canonical_id, event_id, {_SETTING} AS setting, source = 'user_explicit' AS u, regexp_matches(statement, '(?i)(?:当前|现在|目前|now|current)') AS now_,
    row_number() OVER (PARTITION BY canonical_id ORDER BY timestamp, event_id) AS n FROM ({DECISIONS})),
f AS (SELECT DISTINCT canonical_id, 0::BIGINT AS n, []::VARCHAR[] AS ex, []::VARCHAR[] AS inf, NULL::VARCHAR AS event_id, NULL::VARCHAR AS superseded_by FROM r
  UNION ALL
  SELECT r.canonical_id, r.n, list_concat(CASE WHEN now_ AND len(ex) > 0 THEN ex[1:len(ex) - 1] ELSE ex END, CASE WHEN setting AND u THEN [r.event_id] ELSE [] END),
    list_concat(CASE WHEN now_ AND len(ex) = 0 AND len(inf) > 0 THEN inf[1:len(inf) - 1] ELSE inf END, CASE WHEN setting AND NOT u THEN [r.event_id] ELSE [] END),
    CASE WHEN now_ AND len(ex) > 0 THEN ex[len(ex)] WHEN now_ AND len(inf) > 0 THEN inf[len(inf)] END, r.event_id
  FROM f JOIN r ON r.canonical_id = f.canonical_id AND r.n = f.n + 1)
SELECT event_id, superseded_by FROM f WHERE event_id IS NOT NULL"""
ORACLES = {
    "supersede_fold": _FOLD,
    "decision_superseded_anti": f"SELECT canonical_id, count(*) AS standing FROM ({DECISIONS}) WHERE event_id NOT IN (SELECT event_id FROM ({_FOLD})) GROUP BY canonical_id",
    "capture_ids_dedupe": f"SELECT event_key, capture_id, computed_hash FROM ({EVENTS})",
    "capture_seq": f"SELECT event_key, project_id, row_number() OVER (PARTITION BY project_id ORDER BY try_cast(timestamp AS TIMESTAMPTZ) NULLS FIRST, event_key) AS sequence FROM ({EVENTS})",
    "sensitivity_levels": f"""SELECT delivery_id, {level_sql("content")} AS level,
       CASE WHEN {_any("content", _SECRETS)} THEN {_names("content", _SECRETS)} ELSE {_names("content", _SENSITIVE)} END AS detectors FROM raw_events""",
    "redact_secrets": f"SELECT delivery_id, {_redact_sql('content')} AS redacted FROM raw_events",
    "tokenize_counts": f"SELECT token, count(*) AS n FROM (SELECT unnest({tokens_sql('text')}) AS token FROM documents WHERE text IS NOT NULL) GROUP BY token",
    "keywords_top12": f"SELECT event_key, {_TAGS} AS keywords FROM ({EVENTS})",
    "memory_from_event": _MEMORIES,
    "decision_kind": f"SELECT * FROM (SELECT event_key, {_KIND} AS kind FROM ({EVENTS})) WHERE kind IS NOT NULL",
    "decision_topic_alias": f"SELECT event_key, {_TOPIC} AS topic, {_ALIASES} AS aliases FROM ({EVENTS})",
    "decision_view": VIEWS,
    "decision_conflicts": f"""
SELECT canonical_id, count(*) AS conflicting, count(DISTINCT lower(trim(statement))) AS statements FROM (
  SELECT *, max(source = 'user_explicit') OVER (PARTITION BY canonical_id) AS any_explicit FROM ({DECISIONS}) WHERE {_SETTING})
WHERE status IN ('current', 'accepted') AND (source = 'user_explicit' OR NOT any_explicit) GROUP BY canonical_id HAVING count(DISTINCT lower(trim(statement))) > 1""",
    "decision_timeline": f"""
SELECT d.canonical_id, d.event_id, d.timestamp, d.kind, d.status, d.event_id IS NOT DISTINCT FROM v.current_event_id AS current FROM ({DECISIONS}) d JOIN ({VIEWS}) v USING (canonical_id)""",
    "queue_order": f"SELECT project_id, event_key, priority, position FROM ({_FIRST})",
    "queue_token_budget": f"""
SELECT project_id, event_key, position, tokens, spent, 'processing' AS outcome FROM (
  SELECT *, sum(tokens) OVER (PARTITION BY project_id ORDER BY position)::BIGINT AS spent FROM (SELECT *, {_TOKENS} AS tokens FROM ({_FIRST})))
WHERE spent <= 2000 OR position = 1""",
    "processing_decision": f"""
SELECT project_id, pending_items, pending_bytes, reason, reason <> 'below_threshold' AS should_run FROM (
  SELECT project_id, count(*) AS pending_items, sum(strlen(content))::BIGINT AS pending_bytes,
         CASE WHEN bool_or(priority = 'explicit') THEN 'explicit' WHEN sum(strlen(content)) >= 51200 THEN 'size_threshold'
              WHEN min(try_cast(created_at AS TIMESTAMPTZ)) <= TIMESTAMPTZ '{NOW}' - INTERVAL 30 MINUTE THEN 'max_wait' ELSE 'below_threshold' END AS reason
  FROM ({_QUEUE}) GROUP BY project_id)""",
}
