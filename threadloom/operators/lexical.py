"""Lexical search: saturating term weights over the documents of each project, with curated term expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.instants import instant
from threadloom.functions.text import lexical_terms, normalize_text, term_key, tokenize

#: Words of a query that are not searched for.
QUERY_STOPS = ("a", "an", "did", "do", "does", "for", "is", "of", "our", "the", "to", "was", "we", "were", "what", "which", "why", "我们", "们讨", "讨论", "论过", "之前", "前为", "为什么", "什么", "么没", "没有", "最后", "后定", "定了", "了什", "吗")
RELATION = "term_a string, term_b string, relation_type string, confidence double, context_tags array<string>"


def postings(documents: DataFrame) -> DataFrame:
    """(project_id, memory_id, token, tf): each text is tokenised once."""
    return documents.select("project_id", "memory_id", F.explode(tokenize(F.lower("text"))).alias("token")).groupBy("project_id", "memory_id", "token").agg(F.count("*").alias("tf"))


def document_frequency(documents: DataFrame) -> DataFrame:
    distinct = documents.select("project_id", F.explode(F.array_distinct(tokenize(F.lower("text")))).alias("token"))
    return distinct.groupBy("project_id", "token").agg(F.count("*").alias("df"))


def expand(queries: DataFrame, relations: DataFrame, context: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, term, confidence): terms one relation away from a query or one of its words, in either direction.

    Weak relations, and those whose context does not hold, say nothing; an ambiguous or merely related pair vetoes the
    equivalence of the same pair.
    """
    tags = F.array(*map(F.lit, context)) if context else F.array().cast("array<string>")
    applies = (F.col("confidence") >= 0.6) & ((F.size("context_tags") <= 0) | F.arrays_overlap("context_tags", tags))
    norm = lambda c: F.lower(normalize_text(F.col(c)))
    pair = F.array_sort(F.array(term_key(F.col("term_a")), term_key(F.col("term_b"))))
    same = Window.partitionBy("pair")
    # one pass over the relations: a plan that reads them once for each veto and direction takes the driver's memory
    live = relations.where(applies).withColumn("pair", pair).withColumn("vetoed", F.coalesce(F.bool_or(F.col("relation_type").isin("ambiguous", "related")).over(same), F.lit(False)))
    usable = live.where(~F.col("vetoed") & ~((F.col("relation_type") == "contextual_equivalent") & (F.size("context_tags") <= 0)))
    ways = F.array(F.struct(norm("term_a").alias("seen"), norm("term_b").alias("term")), F.struct(norm("term_b").alias("seen"), norm("term_a").alias("term")))
    both = usable.select(F.explode(ways).alias("w"), "confidence").select("w.*", "confidence")
    texts = queries.select("query_id", F.explode(F.concat(F.array("query"), lexical_terms(F.col("query")))).alias("text")).select("query_id", term_key(F.col("text")).alias("text"))
    # a term is met as the whole text, or, if it has several words, as words in a row of it: an equality on these
    words = F.split("text", " ")
    rows = F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.sequence(i, F.size(words)), lambda j: F.array_join(F.slice(words, i, j - i + 1), " "))))
    keys = texts.select("query_id", F.explode(F.array_distinct(F.concat(F.array("text"), F.filter(rows, lambda r: r.contains(" "))))).alias("phrase"))
    hits = keys.join(both.withColumn("phrase", term_key(F.col("seen"))), "phrase")
    return hits.groupBy("query_id", "term").agg(F.max("confidence").alias("confidence"))


def query_terms(queries: DataFrame, expansions: DataFrame | None = None) -> DataFrame:
    """(query_id, token, times, weight, total, latin): what is searched for, and how often the query itself says it."""
    own = queries.select("query_id", F.explode(tokenize(F.lower("query"))).alias("token")).where(~F.col("token").isin(*QUERY_STOPS)).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    weights = own.withColumn("weight", F.lit(1.0))
    if expansions is not None:
        spelled = F.array("term", F.regexp_replace("term", "-", " "), F.regexp_replace("term", " ", "-"))
        added = expansions.select("query_id", (F.col("confidence") * 0.75).alias("weight"), F.explode(spelled).alias("t")).select("query_id", "weight", F.explode(tokenize(F.col("t"))).alias("token"))
        weights = weights.unionByName(added.withColumn("times", F.lit(0).cast("bigint"))).groupBy("query_id", "token").agg(F.max("times").alias("times"), F.max("weight").alias("weight"))
    latin = weights.withColumn("latin", F.col("token").rlike("^[a-z0-9]"))
    whole = Window.partitionBy("query_id")  # added tokens have no times, and a query of none of its own is dropped
    totals = latin.withColumn("total", F.sum("times").over(whole)).withColumn("latin_total", F.sum(F.when(F.col("latin"), F.col("times")).otherwise(0)).over(whole))
    return totals.where("query_id IS NOT NULL AND total > 0").select("query_id", "token", "times", "weight", "total", "latin_total", "latin")


def search(documents: DataFrame, queries: DataFrame, expansions: DataFrame | None = None, limit: int = 8, since: str | None = None, until: str | None = None, sensitive: bool = False) -> DataFrame:
    """The ``limit`` best documents of every project for every query (query_id, query).

    Frequencies are those of the eligible documents in the time range. Only postings of searched tokens are shuffled.
    """
    if since and until and since > until:
        raise ValueError("since must not be after until")
    active = documents.where(F.col("lexical_sensitive" if sensitive else "lexical"))
    at = instant(F.col("created_at"))
    if since:
        active = active.where(at >= F.to_timestamp(F.lit(since)))
    if until:
        active = active.where(at <= F.to_timestamp(F.lit(until)))
    terms = query_terms(queries, expansions)
    tokens = terms.select("token").distinct()
    tokenised = active.where("memory_id IS NOT NULL").select("project_id", "memory_id", F.explode(tokenize(F.lower("text"))).alias("token"))
    counts = tokenised.join(tokens, "token").groupBy("project_id", "memory_id", "token").agg(F.count("*").alias("tf"))
    # asks for tf, so that both sides of the join below are one exchange and the texts are tokenised once
    frequency = counts.groupBy("project_id", "token").agg(F.count_if(F.col("tf") > 0).alias("df"))
    totals = active.groupBy("project_id").agg(F.count("*").alias("documents"))
    idf = F.log1p((F.col("documents") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = counts.join(frequency.join(totals, "project_id").select("project_id", "token", idf.alias("idf")), ["project_id", "token"])
    tagged = active.select("memory_id", "search_tags", "source", "confidence", "integrity", "created_at")
    pairs = weighed.join(terms, "token").join(tagged, "memory_id")
    gain = F.col("idf") * (F.col("tf") * 2.2) / (F.col("tf") + 1.2) * F.col("weight") + F.when(F.array_contains("search_tags", F.col("token")), 2 * F.col("weight")).otherwise(0.0)
    scored = pairs.groupBy("query_id", "project_id", "memory_id", "source", "confidence", "integrity", "created_at", "total", "latin_total").agg(
        F.sum(gain).alias("raw"), F.sum("times").alias("hit"), F.sum(F.when(F.col("latin"), F.col("times")).otherwise(0)).alias("latin_hit"), F.bool_or(F.col("times") == 0).alias("expanded")
    )
    gated = (F.col("latin_total") > 0) & (F.col("latin_hit") / F.col("latin_total") < 0.5) & ~F.col("expanded")
    score = F.when(gated, 0.0).otherwise(F.col("raw")) * F.when(F.col("source") == "user_explicit", 1.35).otherwise(1.0)
    coverage = F.col("hit") / F.col("total")
    tier = F.when(coverage == 1, 3).when(coverage >= 0.5, 2).otherwise(1)
    sure = F.least(F.lit(1.0), F.col("confidence") * (0.5 + coverage / 2) * F.when(F.col("expanded") & (coverage == 0), 0.8).otherwise(1.0) * F.when(F.col("integrity") == "partial", 0.6).otherwise(1.0))
    hits = scored.select("query_id", "project_id", "memory_id", "source", "created_at", F.round(score, 6).alias("score"), F.round(sure, 6).alias("confidence"), tier.alias("tier"), "expanded").where("score > 0")
    order = Window.partitionBy("query_id", "project_id").orderBy(F.desc("tier"), F.desc(F.col("source") == "user_explicit"), F.desc("score"), F.desc("confidence"), "created_at", "memory_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def search_raw(events: DataFrame, queries: DataFrame, limit: int = 8, sensitive: bool = False) -> DataFrame:
    """Messages that were not processed: how many of a query's words they hold."""
    terms = query_terms(queries).select("query_id", "token")
    sizes = terms.groupBy("query_id").agg(F.count("*").alias("wanted"))
    rows = events if sensitive else events.where(F.col("sensitivity") == "normal")
    words = rows.select("project_id", "event_key", "savepoint_status", F.explode(F.array_distinct(tokenize(F.lower("content")))).alias("token"))
    hits = words.join(terms, "token").groupBy("query_id", "project_id", "event_key", "savepoint_status").agg(F.count("*").alias("score")).join(sizes, "query_id")
    sure = F.least(F.lit(0.6), F.col("score") / F.col("wanted")) * F.when(F.col("savepoint_status") == "partial", 0.6).otherwise(1.0)
    order = Window.partitionBy("query_id", "project_id").orderBy(F.desc("score"), F.desc("confidence"), "event_key")
    return hits.withColumn("confidence", F.round(sure, 6)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "project_id", "event_key", "score", "confidence", "rank")


def literal_queries(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(texts.items()), "query_id string, query string")
