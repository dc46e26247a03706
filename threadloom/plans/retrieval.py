"""Queries over evidence, documents, search, tags, vectors, recall and health, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions.instants import instant
from threadloom.operators import decision_views, documents, evidence, health, lexical, recall, tags, vectors
from threadloom.plans import archive
from threadloom.plans.archive import DECISIONS, KEPT, NOW, VIEWS, S, clean_sql, tokens_sql
from threadloom.session import materialise, table

ASKED = {
    "q_broker": "Why did we choose the message broker over the build cache?",
    "q_retry": "What is the current retry policy",
    "q_zh": "为什么选择消息代理",
    "q_rare": "quantum entanglement ledger",
    "q_half": "quantum entanglement broker",
}
RELATIONS = [
    ("message broker", "thread-pool", "synonym", 0.9, []),
    ("retry policy", "feature flag", "alias", 0.95, []),
    ("build cache", "session token", "ambiguous", 0.9, []),
    ("build-cache", "session token", "alias", 0.8, []),
    ("ledger", "balance sheet", "related", 0.5, []),
    ("quantum entanglement", "log sampler", "contextual_equivalent", 0.9, ["physics"]),
]
SINCE, UNTIL = "2025-06-01T00:00:00Z", "2025-12-31T00:00:00Z"
WHY = "adapter"
LAYERS = {
    "builtin": {"recall.max_snippets": "8", "recall.max_characters": "12000", "staleness.threshold_days": "90", "embedding.semantic_weight": "0.7"},
    "global": {"recall.max_snippets": "12"},
    "project": {"staleness.threshold_days": "30", "recall.max_snippets": "5"},
    "temporary": {"recall.max_characters": "4000"},
}


def _docs(spark, sf_dir):
    """The effective documents, written once, as every search reads them several times."""
    docs = documents.effective(table(spark, sf_dir, "processed_memories"), table(spark, sf_dir, "raw_events"), table(spark, sf_dir, "memory_control_events"))
    return materialise(docs, "documents")


def _queries(spark):
    return lexical.literal_queries(spark, ASKED)


def _hits(spark, sf_dir, **options):
    return lexical.search(_docs(spark, sf_dir), _queries(spark), **options)


def effective_state(spark, sf_dir):
    return documents.effective_states(table(spark, sf_dir, "memory_control_events"))


def evidence_status(spark, sf_dir):
    rows = evidence.memories(table(spark, sf_dir, "processed_memories"))
    found = evidence.descriptors(evidence.memory_refs(rows), evidence.sources(table(spark, sf_dir, "raw_events")))
    return found.select(F.col("owner").alias("memory_id"), "event_key", "status")


def evidence_assessment(spark, sf_dir):
    rows = evidence.memories(table(spark, sf_dir, "processed_memories"))
    return evidence.assess(rows, evidence.descriptors(evidence.memory_refs(rows), evidence.sources(table(spark, sf_dir, "raw_events"))))


def effective_documents(spark, sf_dir):
    return _docs(spark, sf_dir).select("memory_id", "project_id", "effective_status", "integrity", "level", "lexical", "lexical_sensitive", "index", F.sha2("text", 256).alias("text_hash"))


def document_frequency(spark, sf_dir):
    return lexical.document_frequency(_docs(spark, sf_dir).where("lexical"))


_HIT = ("query_id", "project_id", "memory_id", "score", "confidence", "tier", "rank")


def bm25_search(spark, sf_dir):
    return _hits(spark, sf_dir).select(*_HIT)


def search_time_range(spark, sf_dir):
    return _hits(spark, sf_dir, since=SINCE, until=UNTIL).select(*_HIT)


def term_expand(spark, sf_dir):
    return lexical.expand(_queries(spark), spark.createDataFrame(RELATIONS, lexical.RELATION))


def search_expanded(spark, sf_dir):
    return _hits(spark, sf_dir, expansions=materialise(term_expand(spark, sf_dir), "expansions")).select(*_HIT, "expanded")


def search_raw(spark, sf_dir):
    return lexical.search_raw(archive.events(spark, sf_dir), _queries(spark))


def latin_gate(spark, sf_dir):
    """Hits of each query over all projects: none of one of which a text has few words, though it has some."""
    queries = _queries(spark)
    hits = lexical.search(_docs(spark, sf_dir), queries).groupBy("query_id").agg(F.count("*").alias("hits"))
    return queries.select("query_id").join(hits, "query_id", "left").fillna(0, ["hits"])


def tag_registry(spark, sf_dir):
    reg = tags.registry(evidence.memories(table(spark, sf_dir, "processed_memories")), table(spark, sf_dir, "memory_control_events"))
    return reg.select("project_id", "tag", "usage_count", "last_used", "confidence", "raw_tag", F.concat_ws("|", "aliases").alias("aliases"), F.concat_ws("|", "examples").alias("examples"))


def tag_suggest(spark, sf_dir):
    reg = tags.registry(evidence.memories(table(spark, sf_dir, "processed_memories")), table(spark, sf_dir, "memory_control_events"))
    return tags.suggest(reg, ["message-broker", "retry-policy"])


def month_buckets(spark, sf_dir):
    reg = tags.registry(evidence.memories(table(spark, sf_dir, "processed_memories")), table(spark, sf_dir, "memory_control_events"))
    return tags.month_buckets(reg)


def vector_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = vectors.top_k(rows, rows.where("id % 100 = 0").select(F.col("id").alias("query"), "vector"))
    return found.select(F.col("query").cast("bigint").alias("query"), F.col("id").cast("bigint").alias("vec_id"), F.round("similarity", 5).alias("similarity"))


def vector_stale(spark, sf_dir):
    return vectors.stale_rows(table(spark, sf_dir, "vector_index"), table(spark, sf_dir, "index_manifests"), _docs(spark, sf_dir))


def hybrid_rrf(spark, sf_dir):
    """Lexical hits of a query, fused with the memories nearest to a stored vector."""
    docs = _docs(spark, sf_dir)
    hits = lexical.search(docs, _queries(spark), limit=50).where("query_id = 'q_broker'")
    return vectors.fuse(hits, vectors.nearest_to_first(table(spark, sf_dir, "vector_index"), table(spark, sf_dir, "index_manifests")), docs)


def _snippets(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    hits = lexical.search(docs, _queries(spark))
    return hits.join(docs.select("memory_id", F.substring("display", 1, 500).alias("snippet"), "source_events"), "memory_id")


def recall_budget(spark, sf_dir):
    return recall.within_characters(_snippets(spark, sf_dir), 400)


def _decision_evidence(spark, sf_dir):
    rows = archive._decisions(spark, sf_dir)
    updated = decision_views.views(rows).select("canonical_id", "updated_at")
    return rows.select("canonical_id", F.col("evidence_refs")[0].alias("event_key")).join(updated, "canonical_id")


def recall_best_decision(spark, sf_dir):
    return recall.best_decision(_snippets(spark, sf_dir), _decision_evidence(spark, sf_dir))


def recall_package(spark, sf_dir):
    """How well the archive answers each query in each project, once hits are refined by reasons and current evidence."""
    queries = _queries(spark)
    docs = _docs(spark, sf_dir)
    found = lexical.search(docs, queries).join(docs.select("memory_id", F.substring("display", 1, 500).alias("snippet"), "source_events"), "memory_id")
    hits = materialise(recall.with_reasons(found, queries), "hits")
    rows = materialise(archive._decisions(spark, sf_dir), "decisions")
    views = materialise(decision_views.views(rows), "views")
    cited = rows.select("canonical_id", "event_id", F.col("evidence_refs")[0].alias("event_key"))
    best = materialise(recall.best_decision(hits, cited.join(views.select("canonical_id", "updated_at"), "canonical_id")), "best")
    current = cited.join(views.select(F.col("current_event_id").alias("event_id")), "event_id").select("canonical_id", "event_key")
    kept = recall.with_current_evidence(hits, best, current, queries).select("query_id", "project_id", "tier")
    raw = lexical.search_raw(archive.events(spark, sf_dir), queries).select("query_id", "project_id", F.lit(0).alias("tier"))
    conflicting = best.join(decision_views.conflicts(rows).select("canonical_id"), "canonical_id", "left_semi")
    projects = table(spark, sf_dir, "processed_memories").select("project_id").distinct()
    asked = projects.select("project_id", F.explode(F.array(*map(F.lit, ASKED))).alias("query_id"))
    return recall.classify(kept.unionByName(raw), asked, conflicting)


def recall_candidates(spark, sf_dir):
    """What each project offers for queries without a processed hit."""
    docs = _docs(spark, sf_dir)
    hits = lexical.search(docs, _queries(spark)).groupBy("query_id", "project_id").agg(F.count("*").alias("hits"))
    projects = docs.select("project_id").distinct().select("project_id", F.explode(F.array(*map(F.lit, ASKED))).alias("query_id"))
    registry = materialise(tags.registry(evidence.memories(table(spark, sf_dir, "processed_memories")), table(spark, sf_dir, "memory_control_events")).select("project_id", "tag", "usage_count", "last_used"), "registry")
    return recall.candidates(projects.join(hits, ["query_id", "project_id"], "left").fillna(0, ["hits"]), registry, tags.month_buckets(registry))


def _views(spark, sf_dir):
    rows = archive._decisions(spark, sf_dir)
    return decision_views.views(rows).join(rows.select("canonical_id", "project_id").distinct(), "canonical_id"), rows


def why_rank(spark, sf_dir):
    return recall.rank_topics(_views(spark, sf_dir)[0], "adapter")


def why_trail(spark, sf_dir):
    views, rows = _views(spark, sf_dir)
    views = materialise(views, "views")
    refs = rows.join(views.select(F.col("current_event_id").alias("event_id")), "event_id", "left_semi").select(F.col("event_id").alias("owner"), "project_id", F.explode("evidence_refs").alias("source"))
    described = evidence.descriptors(refs, evidence.sources(table(spark, sf_dir, "raw_events")))
    unreliable = described.where("status <> 'verified'").select(F.col("owner").alias("event_id"))
    asked = table(spark, sf_dir, "raw_events").where("project_id IS NOT NULL").select("project_id").distinct()
    return recall.trail_classes(asked, recall.rank_topics(views, WHY), views, unreliable, decision_views.conflicts(rows))


def staleness(spark, sf_dir):
    views, rows = _views(spark, sf_dir)
    return recall.staleness(views, rows.select(F.col("event_id").alias("current_event_id"), "timestamp"), NOW)


def vault_stats(spark, sf_dir):
    names = ("raw_events", "processed_memories", "memory_control_events", "tag_registry", "vector_index", "documents")
    return health.collection_counts({n: table(spark, sf_dir, n) for n in names})


def _lifecycle(spark, sf_dir):
    """The events table as lifecycle records: users are projects; sign-ups start what views end."""
    kind = F.when(F.col("event_type") == "signup", "started").when(F.col("event_type") == "view", "ended").otherwise("captured")
    outcome = F.when(F.col("event_type") == "error", "failure").otherwise("success")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("project_id"), F.col("ts").alias("at"), outcome.alias("outcome"), F.col("event_id").alias("operation_id"), kind.alias("kind"))


def _last(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.max("ts").alias("now")).first()["now"]


def health_capture(spark, sf_dir):
    return health.capture_health(_lifecycle(spark, sf_dir), F.lit(_last(spark, sf_dir)), hours=240)


def health_overall(spark, sf_dir):
    return health.overall(health_capture(spark, sf_dir))


def enrichment_candidates(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return health.enrichment_candidates(docs, table(spark, sf_dir, "memory_control_events"), docs.where("false").select("memory_id"))


def enrichment_budget(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    chosen = health.enrichment_candidates(docs, table(spark, sf_dir, "memory_control_events"), docs.where("false").select("memory_id"))
    return health.evidence_budget(chosen.join(docs.select("memory_id", F.length("display").alias("length")), "memory_id"), 300)


def overlay_apply(spark, sf_dir):
    """Overlays made of the predictive tags; every other one, by the last digit of its hash, has gone stale."""
    docs = _docs(spark, sf_dir)
    rows = evidence.memories(table(spark, sf_dir, "processed_memories")).where("source_hash IS NOT NULL")
    stale = F.col("source_hash").rlike("[02468ace]$")
    made = rows.select(F.col("id").alias("memory_id"), F.when(stale, F.lit("gone")).otherwise(F.col("source_hash")).alias("source_hash"), "source_events", F.col("predictive_tags").alias("tags"))
    return health.apply_overlays(docs, made).groupBy("overlay").agg(F.count("*").alias("memories"))


def settings_resolve(spark, sf_dir):
    return health.resolve_settings(spark, LAYERS)


def doctor_rollup(spark, sf_dir):
    raw, memories = table(spark, sf_dir, "raw_events"), table(spark, sf_dir, "processed_memories")
    unhashed = F.coalesce(F.lower("content_hash") != F.sha2(F.col("content").cast("binary"), 256), F.lit(True))
    return health.diagnose({"tampered": raw.where(unhashed), "no_session": raw.where("session_id IS NULL"), "no_source": memories.where("size(source_events) <= 0"), "bad_instant": table(spark, sf_dir, "memory_control_events").where(instant(F.col("timestamp")).isNull())})


def eval_scores(spark, sf_dir):
    """Scores of a predictor that answers every second item rightly and cites its own id."""
    items = table(spark, sf_dir, "eval_items")
    even = F.col("query_id").rlike("[02468]$")
    expected = items.select("query_id", F.col("expected_classification").alias("classification"), F.array("query_id").alias("required"), F.array(F.lit("forbidden")).alias("forbidden"))
    got = F.when(even, F.col("expected_classification")).otherwise("possible_match")
    predicted = items.where(~F.col("query_id").rlike("9$")).select("query_id", got.alias("classification"), F.when(even, F.array("query_id")).otherwise(F.array("query_id", F.lit("forbidden"))).alias("evidence"))
    return health.scores(expected, predicted)


_ALL = (
    effective_state, evidence_status, evidence_assessment, effective_documents, document_frequency, bm25_search, search_time_range, term_expand, search_expanded,
    search_raw, latin_gate, tag_registry, tag_suggest, month_buckets, vector_topk, vector_stale, hybrid_rrf, recall_budget, recall_best_decision, recall_package, recall_candidates,
    why_rank, why_trail, staleness, vault_stats, health_capture, health_overall, enrichment_candidates, enrichment_budget, overlay_apply, settings_resolve, doctor_rollup, eval_scores,
)
QUERIES = {q.__name__: q for q in _ALL}

# SQL.
_STATES = """
SELECT target_memory_id, CASE arg_max(kind, (timestamp, event_id)) WHEN 'forget' THEN 'revoked' WHEN 'correct' THEN 'superseded' ELSE 'deleted' END AS status,
       arg_max(event_id, (timestamp, event_id)) AS last_event_id, count(*) AS events
FROM (SELECT target_memory_id, lower(trim(event_id)) AS event_id, max(timestamp) AS timestamp, arg_max(kind, timestamp) AS kind FROM memory_control_events
      WHERE kind IN ('forget', 'correct', 'delete') AND target_memory_id IS NOT NULL AND event_id IS NOT NULL GROUP BY ALL) GROUP BY target_memory_id"""
_MEM = "SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, title DESC, summary DESC) AS n FROM processed_memories WHERE id IS NOT NULL) WHERE n = 1"
_SOURCES = f"""
SELECT event_key, project_id AS found_project, lower(content_hash) AS declared, sha256(content) AS computed, savepoint_status AS savepoint, sensitivity AS level,
       coalesce(lower(raw_ref) = lower('raw/' || project_id || '/' || session_id || '/' || event_id || '.json'), false) AS path_ok FROM ({KEPT})"""
_DESC = f"""
SELECT r.owner, r.event_key, computed, savepoint, level,
       CASE WHEN s.event_key IS NULL THEN 'missing' WHEN found_project IS DISTINCT FROM r.project_id THEN 'wrong_project' WHEN NOT path_ok THEN 'invalid_path'
            WHEN declared IS NOT DISTINCT FROM computed THEN 'verified' ELSE 'tampered' END AS status
FROM (SELECT DISTINCT id AS owner, project_id, lower(trim(e)) AS event_key FROM (SELECT id, project_id, unnest(source_events) AS e FROM ({_MEM})) WHERE e IS NOT NULL) r
LEFT JOIN ({_SOURCES}) s USING (event_key)"""
_ASSESS = f"""
SELECT owner, evidence_level, savepoint, sources,
  CASE WHEN wp THEN 'wrong_project' WHEN ip THEN 'invalid_path' WHEN ta THEN 'tampered'
       WHEN (sources = 1 AND type <> 'correction' AND source_hash IS NOT NULL AND lower(source_hash) IS DISTINCT FROM h) OR (listed > 0 AND listed <> sources) THEN 'mismatch'
       WHEN mi OR listed = 0 THEN 'missing' WHEN savepoint = 'complete' THEN 'verified' ELSE 'partial' END AS integrity
FROM (SELECT m.id AS owner, coalesce(len(m.source_events), 0) AS listed, m.source_hash, m.type, coalesce(n, 0) AS sources, coalesce(wp, false) AS wp, coalesce(ip, false) AS ip,
             coalesce(ta, false) AS ta, coalesce(mi, false) AS mi, h, ['normal', 'sensitive', 'secret'][coalesce(lv, 1)] AS evidence_level,
             CASE WHEN pe THEN 'pending' WHEN pa THEN 'partial' ELSE 'complete' END AS savepoint
      FROM ({_MEM}) m LEFT JOIN (
        SELECT owner, count(*) AS n, bool_or(status = 'wrong_project') AS wp, bool_or(status = 'invalid_path') AS ip, bool_or(status = 'tampered') AS ta, bool_or(status = 'missing') AS mi,
               max(computed) AS h, max(coalesce(list_position(['normal', 'sensitive', 'secret'], level), 1)) AS lv, bool_or(savepoint = 'pending') AS pe, bool_or(savepoint = 'partial') AS pa
        FROM ({_DESC}) GROUP BY owner) d ON d.owner = m.id)"""
_list = lambda c: f"list_sort(list_distinct([v FOR v IN [{clean_sql('x')} FOR x IN coalesce({c}, [])] IF v <> '']))"
_lines = lambda label, c: f"['deterministic.{label}: ' || v FOR v IN {_list(c)}]"
_one = lambda label, c: f"[v FOR v IN ['deterministic.{label}: ' || {clean_sql(f'coalesce({c}, chr(32))')}] IF v <> 'deterministic.{label}: ']"
_TEXT = f"substring(array_to_string(flatten([{_one('title', 'title')}, {_one('summary', 'summary')}, {_lines('tags', 'tags')}, {_lines('predictive_tags', 'predictive_tags')}, {_lines('retrieval_phrases', 'retrieval_phrases')}]), chr(10)), 1, 12000)"
_DOCS = f"""
SELECT *, active AND level = 'normal' AS lexical, active AND level <> 'secret' AS lexical_sensitive, active AND integrity = 'verified' AND level = 'normal' AS "index" FROM (
  SELECT m.id AS memory_id, m.project_id, {_TEXT} AS text, coalesce(s.status, m.status) AS effective_status, a.integrity, m.created_at, m.confidence, m.source, m.summary AS display,
         {_list("tags")} AS search_tags, m.source_events, m.source_hash, m.predictive_tags,
         ['normal', 'sensitive', 'secret'][greatest(coalesce(list_position(['normal', 'sensitive', 'secret'], m.sensitivity), 1), list_position(['normal', 'sensitive', 'secret'], a.evidence_level))] AS level,
         coalesce(s.status, m.status) = 'active' AND a.integrity IN ('verified', 'partial') AS active
  FROM ({_MEM}) m JOIN ({_ASSESS}) a ON a.owner = m.id LEFT JOIN ({_STATES}) s ON s.target_memory_id = m.id)"""
_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in ASKED.items())
_STOP = "[" + ", ".join(f"'{w}'" for w in lexical.QUERY_STOPS) + "]"
_OWN = f"SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest({tokens_sql('query')}) AS token FROM (VALUES {_VALUES}) q(query_id, query)) WHERE NOT list_contains({_STOP}, token) GROUP BY ALL"
_key = lambda c: f"trim(regexp_replace(lower({clean_sql(c)}), '[-{S}]+', ' ', 'g'))"
_REL = ", ".join(f"('{a}', '{b}', '{t}', {c}, {x}::VARCHAR[])" for a, b, t, c, x in RELATIONS)
_EXPAND = f"""
WITH rel AS (SELECT *, list_sort([{_key("term_a")}, {_key("term_b")}]) AS pair FROM (VALUES {_REL}) r(term_a, term_b, relation_type, confidence, context_tags) WHERE confidence >= 0.6 AND len(context_tags) = 0),
ok AS (SELECT * FROM rel WHERE pair NOT IN (SELECT pair FROM rel WHERE relation_type IN ('ambiguous', 'related')) AND relation_type <> 'contextual_equivalent'),
both_ways AS (SELECT lower(term_a) AS seen, lower(term_b) AS term, confidence FROM ok UNION ALL SELECT lower(term_b), lower(term_a), confidence FROM ok),
texts AS (SELECT query_id, {_key("t")} AS text FROM (SELECT query_id, unnest(list_concat([query], regexp_extract_all(lower(query), '[a-z0-9][a-z0-9_-]*'), regexp_extract_all(query, '\\p{{Han}}+'))) AS t FROM (VALUES {_VALUES}) q(query_id, query)))
SELECT query_id, term, max(confidence)::DOUBLE AS confidence FROM texts, both_ways
WHERE text = {_key("seen")} OR (contains({_key("seen")}, ' ') AND contains(' ' || text || ' ', ' ' || {_key("seen")} || ' ')) GROUP BY ALL"""


def _search(where: str = "", expanded: bool = False, limit: int = 8) -> str:
    terms = f"SELECT query_id, token, times, 1.0 AS weight FROM ({_OWN})"
    if expanded:
        spelled = f"SELECT query_id, confidence * 0.75 AS weight, unnest([term, replace(term, '-', ' '), replace(term, ' ', '-')]) AS t FROM ({_EXPAND})"
        terms = f"SELECT query_id, token, max(times) AS times, max(weight) AS weight FROM ({terms} UNION ALL SELECT query_id, unnest({tokens_sql('t')}) AS token, 0 AS times, weight FROM ({spelled})) GROUP BY ALL"
    return f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, project_id ORDER BY tier DESC, source = 'user_explicit' DESC, score DESC, confidence DESC, created_at, memory_id) AS rank FROM (
  SELECT query_id, project_id, memory_id, source, created_at, expanded, CASE WHEN hit = total THEN 3 WHEN hit / total >= 0.5 THEN 2 ELSE 1 END AS tier,
         round(CASE WHEN latin_total > 0 AND latin_hit / latin_total < 0.5 AND NOT expanded THEN 0 ELSE raw END * CASE WHEN source = 'user_explicit' THEN 1.35 ELSE 1 END, 6) AS score,
         round(least(1.0, conf * (0.5 + hit / total / 2) * CASE WHEN expanded AND hit = 0 THEN 0.8 ELSE 1 END * CASE WHEN integrity = 'partial' THEN 0.6 ELSE 1 END), 6) AS confidence
  FROM (
    SELECT query_id, project_id, memory_id, source, created_at, conf, integrity, total, latin_total, sum(times)::DOUBLE AS hit, sum(CASE WHEN regexp_matches(token, '^[a-z0-9]') THEN times ELSE 0 END)::DOUBLE AS latin_hit,
           bool_or(times = 0) AS expanded,
           sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2) * weight + CASE WHEN list_contains(search_tags, token) THEN 2 * weight ELSE 0 END)::DOUBLE AS raw
    FROM (SELECT *, count(*) OVER (PARTITION BY project_id, token, query_id) AS df FROM (
            SELECT d.project_id, d.memory_id, d.source, d.created_at, d.confidence AS conf, d.integrity, d.search_tags, t.*, o.total, o.latin_total, d.n, len([x FOR x IN d.tokens IF x = t.token]) AS tf
            FROM (SELECT *, {tokens_sql("text")} AS tokens, count(*) OVER (PARTITION BY project_id) AS n FROM ({_DOCS}) WHERE lexical {where}) d, ({terms}) t,
                 (SELECT query_id, sum(times)::DOUBLE AS total, sum(CASE WHEN regexp_matches(token, '^[a-z0-9]') THEN times ELSE 0 END)::DOUBLE AS latin_total FROM ({_OWN}) GROUP BY ALL) o
            WHERE o.query_id = t.query_id AND list_contains(d.tokens, t.token)))
    GROUP BY ALL)) WHERE score > 0) WHERE rank <= {limit}"""


_H = ", ".join(_HIT)
_RANGE = f"AND try_cast(created_at AS TIMESTAMPTZ) BETWEEN TIMESTAMPTZ '{SINCE}' AND TIMESTAMPTZ '{UNTIL}'"
_NORM = f"regexp_replace(regexp_replace(lower(raw_tag), '[{S}\\x{{0085}}\\p{{Z}}]+', '-', 'g'), '^-+|-+$', '', 'g')"
_USED = f"""
SELECT * FROM (SELECT project_id, id, updated_at, confidence, raw_tag, {_NORM} AS tag FROM (SELECT project_id, id, updated_at, confidence, unnest(list_distinct(tags)) AS raw_tag
  FROM ({_MEM}) WHERE id NOT IN (SELECT target_memory_id FROM memory_control_events WHERE target_memory_id IS NOT NULL))) WHERE tag <> ''"""
_REG = f"""
SELECT project_id, tag, count(*) AS usage_count, max(updated_at) AS last_used, max(confidence) AS confidence, arg_min(raw_tag, (id, raw_tag)) AS raw_tag,
       array_to_string([a FOR a IN list_sort(list_distinct(list(raw_tag))) IF a <> tag], '|') AS aliases, array_to_string(list_sort(list_distinct(list(id)))[1:5], '|') AS examples
FROM ({_USED}) GROUP BY project_id, tag"""
_SNIP = f"SELECT h.*, substring(d.display, 1, 500) AS snippet, d.source_events FROM ({_search()}) h JOIN ({_DOCS}) d USING (memory_id)"
_EVID = f"SELECT canonical_id, event_key, v.updated_at FROM ({DECISIONS}) JOIN ({VIEWS}) v USING (canonical_id)"
_BEST = f"""
SELECT query_id, project_id, canonical_id, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, project_id ORDER BY rank, updated_at DESC, canonical_id) AS n FROM (
    SELECT s.query_id, s.project_id, canonical_id, min(rank) AS rank, max(try_cast(updated_at AS TIMESTAMPTZ)) AS updated_at
    FROM (SELECT query_id, project_id, rank, lower(trim(unnest(source_events))) AS event_key FROM ({_SNIP})) s JOIN ({_EVID}) USING (event_key) GROUP BY s.query_id, s.project_id, canonical_id)) WHERE n = 1"""
_topic = lambda c: f"trim(regexp_replace(lower({c}), '[{S}_-]+', ' ', 'g'))"
_PV = f"SELECT v.*, p.project_id FROM ({VIEWS}) v JOIN (SELECT DISTINCT canonical_id, project_id FROM ({DECISIONS})) p USING (canonical_id)"
_LIFE = """
SELECT user_id AS project_id, ts AS at_, event_id AS operation_id, CASE event_type WHEN 'signup' THEN 'started' WHEN 'view' THEN 'ended' ELSE 'captured' END AS kind,
       CASE event_type WHEN 'error' THEN 'failure' ELSE 'success' END AS outcome, ts >= (SELECT max(ts) FROM events) - INTERVAL 240 HOUR AS fresh FROM events"""
_HEALTH = f"""
SELECT project_id, CASE WHEN recent = 0 THEN 'unknown' WHEN last = 'failure' THEN 'broken' WHEN failures > 0 OR unfinished > 0 THEN 'degraded' ELSE 'healthy' END AS state, recent, failures, unfinished
FROM (SELECT project_id, count_if(fresh) AS recent, count_if(fresh AND outcome = 'failure') AS failures, arg_max(outcome, (at_, operation_id)) FILTER (fresh) AS last,
             count_if(fresh AND kind = 'started' AND (project_id, operation_id) NOT IN (SELECT (project_id, operation_id) FROM ({_LIFE}) WHERE kind = 'ended')) AS unfinished
      FROM ({_LIFE}) GROUP BY project_id)"""
_CAND = f"""
SELECT project_id, memory_id, position, display FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at, memory_id) AS position FROM ({_DOCS})
  WHERE "index" AND source_hash IS NOT NULL AND memory_id NOT IN (SELECT target_memory_id FROM memory_control_events WHERE target_memory_id IS NOT NULL)) WHERE position <= 6"""
_layers = ", ".join(f"('{k}', '{v}', '{name}', {i})" for i, (name, values) in enumerate(LAYERS.items()) for k, v in values.items())
_RAW = f"""
SELECT query_id, project_id, event_key, score, confidence, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, project_id ORDER BY score DESC, confidence DESC, event_key) AS rank FROM (
  SELECT w.query_id, w.project_id, event_key, count(*) AS score, round(least(0.6, count(*) / any_value(wanted)) * CASE WHEN savepoint_status = 'partial' THEN 0.6 ELSE 1 END, 6) AS confidence
  FROM (SELECT e.project_id, event_key, savepoint_status, t.query_id, wanted FROM (SELECT *, {tokens_sql("content")} AS tokens FROM ({archive.EVENTS}) WHERE sensitivity = 'normal') e,
        (SELECT *, count(*) OVER (PARTITION BY query_id) AS wanted FROM ({_OWN})) t WHERE list_contains(e.tokens, t.token)) w GROUP BY w.query_id, w.project_id, event_key, savepoint_status)) WHERE rank <= 8"""


def _why(q: str) -> str:
    """The topics nearest to the one word ``q``."""
    return f"""
SELECT project_id, canonical_id, topic, score, rank, rank = 1 AND score >= 60 AND score IS DISTINCT FROM next AS selected FROM (
  SELECT *, row_number() OVER o AS rank, lead(score) OVER o AS next FROM (
    SELECT project_id, canonical_id, topic, CASE WHEN name = q THEN 100 WHEN starts_with(name, q) OR starts_with(q, name) THEN 60 + overlap WHEN contains(name, q) OR contains(q, name) THEN 40 + overlap ELSE overlap * 10 END AS score
    FROM (SELECT *, '{q}' AS q, {_topic("topic")} AS name, len(list_intersect(['{q}'], string_split({_topic("topic")}, ' '))) AS overlap FROM ({_PV}))) WHERE score > 0
  WINDOW o AS (PARTITION BY project_id ORDER BY score DESC, topic, canonical_id)) WHERE rank <= 8"""


ORACLES = {
    "effective_state": _STATES,
    "evidence_status": f"SELECT owner AS memory_id, event_key, status FROM ({_DESC})",
    "evidence_assessment": _ASSESS,
    "effective_documents": f'SELECT memory_id, project_id, effective_status, integrity, level, lexical, lexical_sensitive, "index", sha256(text) AS text_hash FROM ({_DOCS})',
    "document_frequency": f"SELECT project_id, token, count(*) AS df FROM (SELECT project_id, unnest(list_distinct({tokens_sql('text')})) AS token FROM ({_DOCS}) WHERE lexical) GROUP BY ALL",
    "bm25_search": f"SELECT {_H} FROM ({_search()})",
    "search_time_range": f"SELECT {_H} FROM ({_search(_RANGE)})",
    "term_expand": _EXPAND,
    "search_expanded": f"SELECT {_H}, expanded FROM ({_search(expanded=True)})",
    "search_raw": _RAW,
    "latin_gate": f"SELECT q.query_id, coalesce(n, 0) AS hits FROM (VALUES {_VALUES}) q(query_id, query) LEFT JOIN (SELECT query_id, count(*) AS n FROM ({_search()}) GROUP BY ALL) h ON h.query_id = q.query_id",
    "tag_registry": _REG,
    "tag_suggest": f"""
SELECT project_id, tag, usage_count, exact, rank FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY exact DESC, usage_count DESC, tag) AS rank
  FROM (SELECT *, tag IN ('message-broker', 'retry-policy') AS exact FROM ({_REG}))) WHERE rank <= 8""",
    "month_buckets": f"""
SELECT * FROM (SELECT project_id, month, row_number() OVER (PARTITION BY project_id ORDER BY month DESC) AS rank FROM (SELECT DISTINCT project_id, substring(last_used, 1, 7) AS month FROM ({_REG})) WHERE regexp_matches(month, '^\\d{{4}}-\\d{{2}}$')) WHERE rank <= 5""",
    "vector_topk": """
SELECT query, vec_id, round(similarity, 5) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(similarity, 9) DESC, vec_id::VARCHAR) AS n FROM (
  SELECT q.vec_id AS query, e.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS similarity FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0)) WHERE n <= 10""",
    "vector_stale": f"""
SELECT generation_id, count(*) AS rows, count_if(d.memory_id IS NULL) AS stale FROM (SELECT DISTINCT generation_id, ordinal, memory_id FROM vector_index) i
JOIN (SELECT generation_id FROM index_manifests WHERE completed_at IS NOT NULL) USING (generation_id) LEFT JOIN (SELECT memory_id FROM ({_DOCS}) WHERE "index") d ON d.memory_id = i.memory_id GROUP BY generation_id""",
    "hybrid_rrf": f"""
WITH g AS (SELECT project_id, arg_max(generation_id, (completed_at, generation_id)) AS generation_id, arg_max(dimension, (completed_at, generation_id)) AS dimension FROM index_manifests WHERE completed_at IS NOT NULL GROUP BY ALL),
u AS (SELECT * FROM (SELECT i.project_id, ordinal, memory_id, vector::DOUBLE[] AS v, row_number() OVER (PARTITION BY i.project_id, ordinal ORDER BY memory_id) AS n FROM vector_index i JOIN g ON g.generation_id = i.generation_id
      WHERE len(vector) = dimension AND len([x FOR x IN vector IF x IS NULL OR NOT isfinite(x)]) = 0 AND list_sum([x * x FOR x IN vector::DOUBLE[]]) > 0) WHERE n = 1),
q AS (SELECT project_id, arg_min(v, ordinal) AS q FROM u GROUP BY ALL),
s AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY similarity DESC, memory_id) AS rank FROM (SELECT project_id, memory_id, max(round(list_cosine_similarity(v, q), 6)) AS similarity FROM u JOIN q USING (project_id) GROUP BY ALL) WHERE similarity >= 0.82),
b AS (SELECT project_id, memory_id, l.rank AS lr, s.rank AS sr, tier, score, l.confidence AS sure, d.confidence AS own
      FROM (SELECT project_id, memory_id, rank, tier, score, confidence FROM ({_search(limit=50)}) WHERE query_id = 'q_broker') l FULL JOIN (SELECT * FROM s WHERE rank <= 50) s USING (project_id, memory_id)
      LEFT JOIN (SELECT memory_id, confidence FROM ({_DOCS}) WHERE "index") d USING (memory_id) WHERE l.rank IS NOT NULL OR d.confidence IS NOT NULL),
f AS (SELECT *, floor((coalesce(1.0::DOUBLE / (60 + lr), 0) + coalesce(0.7::DOUBLE / (60 + sr), 0)) * 1e6 + 0.5) / 1e6 AS fused, CASE WHEN sr IS NULL THEN 'lexical' WHEN lr IS NULL THEN 'semantic' ELSE 'hybrid' END AS branch, CASE WHEN lr IS NULL THEN least(0.5, own) ELSE sure END AS confidence FROM b)
SELECT * FROM (SELECT project_id, memory_id, fused, branch, confidence, row_number() OVER (PARTITION BY project_id ORDER BY coalesce(tier = 3, false) DESC, fused DESC, coalesce(tier, 1) DESC, coalesce(score, 0) DESC, memory_id) AS rank FROM f) WHERE rank <= 8""",
    "recall_candidates": f"""
WITH a AS (SELECT p.project_id, q.query_id FROM (SELECT DISTINCT project_id FROM ({_DOCS})) p, (VALUES {_VALUES}) q(query_id, query)),
h AS (SELECT DISTINCT query_id, project_id FROM ({_search()})),
t AS (SELECT project_id, 'tag' AS kind, tag AS value, row_number() OVER (PARTITION BY project_id ORDER BY usage_count DESC, tag) AS rank FROM ({_REG})),
m AS (SELECT project_id, 'month' AS kind, month AS value, row_number() OVER (PARTITION BY project_id ORDER BY month DESC) AS rank FROM (SELECT DISTINCT project_id, substring(last_used, 1, 7) AS month FROM ({_REG})) WHERE regexp_matches(month, '^\\d{{4}}-\\d{{2}}$'))
SELECT a.query_id, a.project_id, kind, value, rank FROM a JOIN (SELECT * FROM t WHERE rank <= 8 UNION ALL SELECT * FROM m WHERE rank <= 5) o ON o.project_id = a.project_id
WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.query_id = a.query_id AND h.project_id = a.project_id)""",
    "recall_budget": f"""
SELECT query_id, project_id, rank, memory_id, substring(snippet, 1, (400 - spent)::INT) AS snippet, length(snippet) > 400 - spent AS truncated FROM (
  SELECT *, coalesce(sum(length(snippet)) OVER (PARTITION BY query_id, project_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM ({_SNIP})) WHERE spent < 400""",
    "recall_best_decision": _BEST,
    "recall_package": f"""
WITH s AS (SELECT s.*, regexp_matches(q.query, '(?i)(?:为什么|原因|理由|why|reason)') AS why, regexp_matches(q.query, '(?i)(?:当前|现在|目前|current|currently|now)') AS now_,
             coalesce(regexp_matches(snippet, '(?i)(?:因为|由于|[A-Za-z0-9_]因|because|reason|cost|complexity|constraint)'), false) AS gives FROM ({_SNIP}) s JOIN (VALUES {_VALUES}) q(query_id, query) USING (query_id)),
r AS (SELECT * FROM (SELECT *, bool_or(gives) OVER (PARTITION BY query_id, project_id) AS any_ FROM s) WHERE NOT why OR gives OR NOT any_),
best AS (SELECT query_id, project_id, canonical_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, project_id ORDER BY rank, updated_at DESC, canonical_id) AS n FROM (
    SELECT x.query_id, x.project_id, canonical_id, min(rank) AS rank, max(try_cast(updated_at AS TIMESTAMPTZ)) AS updated_at
    FROM (SELECT query_id, project_id, rank, lower(trim(unnest(source_events))) AS event_key FROM r) x JOIN ({_EVID}) USING (event_key) GROUP BY ALL)) WHERE n = 1),
cur AS (SELECT d.canonical_id, d.event_key FROM ({DECISIONS}) d JOIN ({VIEWS}) v ON v.current_event_id = d.event_id),
c AS (SELECT r.*, EXISTS (SELECT 1 FROM best b JOIN cur ON cur.canonical_id = b.canonical_id WHERE b.query_id = r.query_id AND b.project_id = r.project_id AND list_contains([lower(trim(e)) FOR e IN r.source_events], cur.event_key)) AS cites FROM r),
k AS (SELECT query_id, project_id, tier FROM (SELECT *, bool_or(cites) OVER (PARTITION BY query_id, project_id) AS some_ FROM c) WHERE NOT (why OR now_) OR cites OR NOT some_
      UNION ALL SELECT query_id, project_id, 0 FROM ({_RAW}))
SELECT a.query_id, a.project_id, coalesce(h.n, 0) AS hits,
       CASE WHEN h.tier IS NULL THEN 'no_reliable_memory_found' WHEN c.query_id IS NOT NULL THEN 'conflicting_memories_found' WHEN h.tier = 3 THEN 'exact_record_found' WHEN h.tier = 2 THEN 'similar_record_found' WHEN h.tier = 0 THEN 'unprocessed_raw_match' ELSE 'possible_match' END AS classification
FROM (SELECT DISTINCT project_id, q.query_id FROM processed_memories, (VALUES {_VALUES}) q(query_id, query)) a
LEFT JOIN (SELECT query_id, project_id, max(tier) AS tier, count(*) AS n FROM k GROUP BY ALL) h ON h.query_id = a.query_id AND h.project_id = a.project_id
LEFT JOIN (SELECT DISTINCT query_id, project_id FROM best WHERE canonical_id IN (SELECT canonical_id FROM ({archive.ORACLES["decision_conflicts"]}))) c ON c.query_id = a.query_id AND c.project_id = a.project_id""",
    "why_rank": _why("adapter"),
    "why_trail": f"""
WITH r AS ({_why(WHY)}), t AS (SELECT project_id, count(*) AS topics, max(canonical_id) FILTER (selected) AS canonical_id FROM r GROUP BY project_id),
st AS (SELECT d.event_id, CASE WHEN s.event_key IS NULL OR found_project IS DISTINCT FROM d.project_id OR NOT path_ok OR declared IS DISTINCT FROM computed THEN true ELSE false END AS weak FROM ({DECISIONS}) d LEFT JOIN ({_SOURCES}) s USING (event_key))
SELECT a.project_id, t.canonical_id, coalesce(topics, 0) AS topics, CASE WHEN topics IS NULL THEN 'no_reliable_trail' WHEN t.canonical_id IS NULL THEN 'ambiguous_topic' WHEN v.current_event_id IS NULL THEN 'no_reliable_trail'
  WHEN st.weak THEN 'incomplete_trail' WHEN t.canonical_id IN (SELECT canonical_id FROM ({archive.ORACLES["decision_conflicts"]})) THEN 'conflicting_trail' ELSE 'exact_trail' END AS classification
FROM (SELECT DISTINCT project_id FROM raw_events WHERE project_id IS NOT NULL) a LEFT JOIN t ON t.project_id = a.project_id LEFT JOIN ({VIEWS}) v ON v.canonical_id = t.canonical_id LEFT JOIN st ON st.event_id = v.current_event_id""",
    "staleness": f"""
SELECT canonical_id, CASE WHEN us >= 0 THEN floor(us / 86400000000)::BIGINT END AS age_days,
       CASE WHEN current_event_id IS NULL THEN 'not_applicable' WHEN us IS NULL OR us < 0 THEN 'unknown' WHEN us >= 90 * 86400000000 THEN 'possibly_stale' ELSE 'fresh' END AS staleness
FROM (SELECT v.canonical_id, v.current_event_id, epoch_us(TIMESTAMPTZ '{NOW}') - epoch_us(try_cast(d.timestamp AS TIMESTAMPTZ)) AS us FROM ({_PV}) v LEFT JOIN ({DECISIONS}) d ON d.event_id = v.current_event_id)""",
    "vault_stats": " UNION ALL ".join(f"SELECT '{n}' AS collection, count(*) AS rows FROM {n}" for n in ("raw_events", "processed_memories", "memory_control_events", "tag_registry", "vector_index", "documents")),
    "health_capture": _HEALTH,
    "health_overall": f"SELECT state, count(*) AS projects FROM ({_HEALTH}) GROUP BY state ORDER BY list_position(['healthy', 'unknown', 'degraded', 'broken'], state) DESC LIMIT 1",
    "enrichment_candidates": f"SELECT project_id, memory_id, position FROM ({_CAND})",
    "enrichment_budget": f"""
SELECT project_id, memory_id, position, least(length(display), 300 - spent)::BIGINT AS granted FROM (
  SELECT *, coalesce(sum(length(display)) OVER (PARTITION BY project_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM ({_CAND})) WHERE spent < 300""",
    "overlay_apply": f"""
SELECT CASE WHEN source_hash IS NULL OR source_events IS NULL THEN 'none' WHEN regexp_matches(source_hash, '[02468ace]$') OR len(list_distinct(source_events)) <> len(source_events) THEN 'stale_overlay' ELSE 'applied' END AS overlay, count(*) AS memories
FROM ({_MEM}) GROUP BY ALL""",
    "settings_resolve": f"SELECT key, arg_max(value, layer) AS value, arg_max(source, layer) AS source FROM (VALUES {_layers}) s(key, value, source, layer) GROUP BY key",
    "doctor_rollup": """
SELECT "check", faults, CASE WHEN faults > 0 THEN 'broken' ELSE 'healthy' END AS state FROM (
  SELECT 'tampered' AS "check", count(*) AS faults FROM raw_events WHERE coalesce(lower(content_hash) <> sha256(content), true)
  UNION ALL SELECT 'no_session', count(*) FROM raw_events WHERE session_id IS NULL
  UNION ALL SELECT 'no_source', count(*) FROM processed_memories WHERE coalesce(len(source_events), 0) = 0
  UNION ALL SELECT 'bad_instant', count(*) FROM memory_control_events WHERE try_cast(timestamp AS TIMESTAMPTZ) IS NULL)""",
    "eval_scores": """
SELECT query_id, recall AS evidence_recall, precision AS evidence_precision, right_ AS classification_accuracy, safe AS forbidden_safety, round((recall + precision + right_ + safe) / 4, 6) AS composite FROM (
  SELECT query_id, CASE WHEN gone THEN 0.0 ELSE 1.0 END::DOUBLE AS recall, CASE WHEN gone THEN 0.0 WHEN even THEN 1.0 ELSE 0.5 END::DOUBLE AS precision,
         CASE WHEN gone THEN 0.0 WHEN even OR expected_classification = 'possible_match' THEN 1.0 ELSE 0.0 END::DOUBLE AS right_, CASE WHEN gone THEN 0.0 WHEN even THEN 1.0 ELSE 0.0 END::DOUBLE AS safe
  FROM (SELECT query_id, expected_classification, regexp_matches(query_id, '[02468]$') AS even, regexp_matches(query_id, '9$') AS gone FROM eval_items))""",
}
