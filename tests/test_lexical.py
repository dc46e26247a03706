import re

from pyspark.sql import functions as F

from threadloom.operators import lexical


def test_expansions_and_vetoes(spark):
    queries = spark.createDataFrame([("q", "The retry policy"), ("han", "消息代理"), (None, "retry")], "query_id string, query string")
    relations = [
        ("Retry-Policy", "Back Off", "alias", 0.7, []), ("back off", "retry policy", "synonym", 0.9, []), ("policy", "rule", "alias", 0.9, []), ("RULE", "policy", "related", 0.6, []),
        ("retry", "again", None, 0.9, []), ("retry", "weak", "alias", 0.5, []), ("retry", "now", "contextual_equivalent", 0.9, []), ("retry", "later", "alias", 0.9, ["x"]), ("消息代理", "broker", "alias", 0.8, []), (None, "retry", "alias", 0.8, []),
    ]
    got = lexical.expand(queries, spark.createDataFrame(relations, lexical.RELATION)).where("query_id IS NOT NULL AND term IS NOT NULL").collect()
    assert sorted(map(tuple, got)) == [("han", "broker", 0.8), ("q", "back off", 0.9)]


def test_totals_are_those_of_the_querys_own_words(spark):
    queries = spark.createDataFrame([("q", "retry retry 消息"), ("stops", "what is the")], "query_id string, query string")
    added = spark.createDataFrame([("q", "back-off", 0.8), ("q", "retry", 1.0), ("stops", "again", 0.8)], "query_id string, term string, confidence double")
    got = {r.token: (r.query_id, r.times, round(r.weight, 6), r.total, r.latin_total, r.latin) for r in lexical.query_terms(queries, added).collect()}
    assert got == {"retry": ("q", 2, 1.0, 3, 2, True), "消息": ("q", 1, 1.0, 3, 2, False), "back-off": ("q", 0, 0.6, 3, 2, True), "back": ("q", 0, 0.6, 3, 2, True), "off": ("q", 0, 0.6, 3, 2, True)}


def test_an_expanded_search_keeps_a_small_plan(spark):
    queries = lexical.literal_queries(spark, {"q": "retry policy"})
    relations = spark.createDataFrame([("retry policy", "back off", "alias", 0.9, [])], lexical.RELATION)
    documents = spark.range(9).select(
        F.lit("p").alias("project_id"), F.col("id").cast("string").alias("memory_id"), F.concat(F.lit("retry back off "), F.col("id").cast("string")).alias("text"), F.lit(True).alias("lexical"), F.lit("2025-01-01").alias("created_at"), F.array().cast("array<string>").alias("search_tags"),
        F.lit("s").alias("source"), F.lit(0.5).alias("confidence"), F.lit("verified").alias("integrity"),
    )
    found = lexical.search(documents, queries, lexical.expand(queries, relations))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    reads = len(re.findall("LogicalRDD", plan))
    assert reads <= 9, reads  # 21 when each veto, direction and total read the queries and relations again
    assert found.count() == 8
