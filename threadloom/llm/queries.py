"""Queries of the problems on text and vectors for training data, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import conversations as p1
from threadloom.llm import frequency as p2
from threadloom.llm import leakage as p8
from threadloom.llm import neighbours as p4
from threadloom.llm import packing as p7
from threadloom.llm import privacy as p3
from threadloom.llm import subjects as p9
from threadloom.operators.delivery import kept_copies
from threadloom.session import materialise, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1.verdicts(table(spark, sf_dir, "raw_events")).where("reason IS NOT NULL").select("session_id")


def p1_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1.conversations(table(spark, sf_dir, "raw_events"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2.tag_frequencies(table(spark, sf_dir, "processed_memories")).where("band <> 'useful'").select("normalized_tag", "band")


def p2_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2.tag_frequencies(table(spark, sf_dir, "processed_memories"))


def p2_tag_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags and sequences of up to three tags that stand next to each other in a memory."""
    counts = p2.ngram_counts(p2.memory_tags(table(spark, sf_dir, "processed_memories")), "tags", sigma=3)
    return counts.select(F.concat_ws(" ", "gram").alias("sequence"), F.size("gram").alias("size"), "occurrences", F.col("records").alias("memories"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3.find(table(spark, sf_dir, "raw_events"))


def p3_sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept copies of all events with placeholders in their content."""
    kept = kept_copies(table(spark, sf_dir, "raw_events"), F.col("content"))
    return p3.sanitise(kept.select(F.col("event_key").alias("event_id"), "content"), "event_id")


def p3_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many messages there are, and how many differ from their content in more than placeholders for something."""
    kept = kept_copies(table(spark, sf_dir, "raw_events"), F.col("content")).select(F.col("event_key").alias("event_id"), "content")
    clean = p3.sanitise(kept, "event_id").withColumnRenamed("content", "clean")
    literal = F.regexp_replace("clean", r"([\\%_])", r"\\$1")
    pattern = F.regexp_replace(literal, r"\[(?:EMAIL|PHONE|ID\\_NUMBER|ADDRESS|NAME)\]", "%")
    same = kept.join(clean, "event_id").withColumn("pattern", pattern).select(F.coalesce(F.expr("content LIKE pattern"), F.col("content").isNull() & F.col("clean").isNull()).alias("same"))
    return same.agg(F.count("*").alias("messages"), F.count_if(~F.col("same")).alias("altered"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = p4.memory_vectors(table(spark, sf_dir, "vector_index"), table(spark, sf_dir, "index_manifests"))
    return p4.pairs(p4.nearest(rows, k=5, min_similarity=0.82))


def p4_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy search on the graph of ``embeddings``: the 10 best for every vec_id divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings").withColumn("vec_id", F.col("vec_id").cast("string"))
    index = p4.Vectors(p4.unit_vectors(vectors, ["vec_id"], "vec_id", "embedding"), k=16, sample=8, few=0.01)
    nodes = materialise(index.graph.nodes(), "nodes")
    asked = index.members.where(F.col("owner_id").cast("bigint") % 100 == 0).join(nodes, "node")
    found = p4.greedy_search(index.graph.lists(), nodes, asked.select(F.col("owner_id").alias("query"), "dim", "vec"))
    return found.join(index.members, "node").select("query", F.col("owner_id").alias("vec_id"), F.round("similarity", 5).alias("similarity"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7.pack_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "token_budgets"))


def p7_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7.usage(p7_containers(spark, sf_dir))


def p7_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity: texts packed, containers above it, texts split that would fit, and whether 98 % is filled."""
    packed = materialise(p7_containers(spark, sf_dir), "packed")
    sums = packed.groupBy("capacity", "container").agg(F.sum("tokens").alias("tokens")).groupBy("capacity").agg(F.count_if(F.col("tokens") > F.col("capacity")).alias("overfull"), (F.sum("tokens") >= 0.98 * F.count("*") * F.col("capacity")).alias("filled"))
    docs = packed.groupBy("capacity", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"), F.countDistinct("piece").alias("distinct"))
    texts = docs.groupBy("capacity").agg(F.count("*").alias("texts"), F.count_if((F.col("pieces") != F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity")))) | (F.col("pieces") != F.col("distinct"))).alias("split_in_vain"))
    return sums.join(texts, "capacity").select("capacity", "texts", "overfull", "split_in_vain", "filled")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which test items leaked, and into how many documents."""
    return p8_found(spark, sf_dir).groupBy("query_id").agg(F.count("*").alias("documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subjects"), table(spark, sf_dir, "subject_labels"))


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents there are on each subject."""
    return p9_found(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("documents"))


_ALL = (
    p1_found, p1_conversations, p2_found, p2_tags, p2_tag_sequences, p3_found, p3_sanitised, p3_integrity, p4_found, p4_search,
    p7_containers, p7_usage, p7_integrity, p8_found, p8_leaked_items, p9_found, p9_composition,
)
QUERIES = {query.__name__: query for query in _ALL}

_KEPT = """
SELECT * EXCLUDE (n) FROM (
  SELECT lower(trim(event_id)) AS event_key, *, row_number() OVER (PARTITION BY lower(trim(event_id))
    ORDER BY CASE WHEN lower(content_hash) = sha256(content) THEN 0 ELSE 1 END, received_at, delivery_id) AS n
  FROM raw_events) WHERE n = 1"""
_COUNTING = f"""
SELECT session_id, turn_id, seq_id, lower(trim(role)) AS r, event_key,
       coalesce(lower(trim(role)) IN ('user', 'assistant')
                AND regexp_matches(content, '[^\\s\\p{{Z}}\\p{{Cc}}\\p{{Cf}}\\x{{034F}}\\x{{115F}}\\x{{1160}}\\x{{17B4}}\\x{{17B5}}\\x{{180B}}-\\x{{180E}}\\x{{2800}}\\x{{3164}}\\x{{FE00}}-\\x{{FE0F}}\\x{{FFA0}}]'), false) AS counts
FROM ({_KEPT}) WHERE session_id IS NOT NULL"""
_SOUND = f"""
WITH c AS (SELECT * FROM ({_COUNTING}) WHERE counts),
w AS (SELECT *, lag(turn_id) OVER s AS turn_before, lag(r) OVER s AS r_before, row_number() OVER s AS rn FROM c WINDOW s AS (PARTITION BY session_id ORDER BY seq_id)),
t AS (SELECT session_id, turn_id, count_if(r = 'user') AS u, count_if(r = 'assistant') AS a,
             count_if(rn = 1 OR turn_before IS DISTINCT FROM turn_id) AS stretches,
             count_if(rn > 1 AND turn_before IS NOT DISTINCT FROM turn_id AND r = 'user' AND r_before = 'assistant') AS back,
             count_if(seq_id IS NULL) AS missing, count(*) AS n
      FROM w GROUP BY ALL),
d AS (SELECT session_id, count(*) AS n, count(DISTINCT seq_id) AS seqs FROM c GROUP BY ALL)
SELECT t.session_id FROM t JOIN d USING (session_id) GROUP BY t.session_id, d.n, d.seqs
HAVING d.n = d.seqs AND min(u) > 0 AND min(a) > 0 AND max(stretches) = 1 AND max(back) = 0 AND max(missing) = 0"""
_SPACE = "\\t\\n\\x0B\\f\\r \\x{0085}\\x{FEFF}\\p{Z}"
_MEMORIES = f"""
SELECT id, [t FOR t IN [regexp_replace(regexp_replace(lower(t), '[{_SPACE}]+', '-', 'g'), '^-+|-+$', '', 'g') FOR t IN coalesce(tags, [])] IF t <> ''] AS tags
FROM (SELECT id, max(tags) AS tags FROM processed_memories WHERE id IS NOT NULL GROUP BY id)"""
_TAGS = f"""
SELECT tag AS normalized_tag, count(*) AS occurrences, count(DISTINCT id) AS memories,
       CASE WHEN count(DISTINCT id) < 3 THEN 'rare'
            WHEN count(DISTINCT id) > 0.05 * (SELECT count(DISTINCT id) FROM processed_memories) THEN 'common' ELSE 'useful' END AS band
FROM (SELECT id, unnest(tags) AS tag FROM ({_MEMORIES})) GROUP BY tag"""
ORACLES = {
    "p3_integrity": f"SELECT count(*) AS messages, 0::BIGINT AS altered FROM ({_KEPT}) WHERE event_key IS NOT NULL",
    "p7_integrity": "SELECT DISTINCT capacity_tokens AS capacity, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS texts, 0::BIGINT AS overfull, 0::BIGINT AS split_in_vain, true AS filled FROM token_budgets",
    "p2_found": f"SELECT normalized_tag, band FROM ({_TAGS}) WHERE band <> 'useful'",
    "p2_tags": _TAGS,
    "p2_tag_sequences": f"""
SELECT sequence, size, count(*) AS occurrences, count(DISTINCT id) AS memories FROM (
  SELECT id, s.size, array_to_string(tags[p.at:p.at + s.size - 1], ' ') AS sequence
  FROM ({_MEMORIES}), (SELECT unnest([1, 2, 3]) AS size) s, LATERAL (SELECT unnest(range(1, len(tags) - s.size + 2)) AS at) p)
GROUP BY ALL""",
    "p1_found": f"SELECT DISTINCT session_id FROM ({_COUNTING}) WHERE session_id NOT IN ({_SOUND})",
    "p1_conversations": f"""
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq_id) - 1 AS position, turn_id, seq_id, r AS role, event_key AS event_id
FROM ({_COUNTING}) WHERE counts AND session_id IN ({_SOUND})""",
}
