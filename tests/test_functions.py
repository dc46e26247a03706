import pytest
from pyspark.sql import functions as F

from threadloom.functions import decisions, sensitivity, text
from threadloom.operators import capture, processing
from threadloom.operators.numbering import numbered


def each(spark, expression, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("t"))).collect()]


def test_white_space_of_two_standards(spark):
    assert each(spark, text.strip, ["  a　", "﻿b", "\u0085c", None, ""]) == ["a", "b", "\u0085c", None, ""]
    assert each(spark, text.normalize_tag, [" A  b ", "-x--", "　流 程", "--", None]) == ["a-b", "x", "流-程", "", None]
    assert each(spark, text.has_visible, ["​ ", "a", None, "", "ㅤ", "🙂"]) == [False, True, False, False, False, True]


def test_tokens(spark):
    assert each(spark, text.tokenize, ["Foo foo-bar 缓存层 数据 x"]) == [["foo", "foo-bar", "x", "缓存", "存层", "数据"]]
    assert each(spark, text.keywords, ["The api and the api cache 我们 缓存"]) == [["api", "cache", "缓存"]]


def test_normal_forms(spark):
    assert each(spark, text.nfc, ["é", None]) == ["é", None]
    assert each(spark, text.nfkc, ["１"]) == ["1"]


@pytest.mark.parametrize(
    ("content", "level"),
    [("密码password=hunter22x", "secret"), ("mail a.b@c.io now", "sensitive"), ("打 13800138000", "sensitive"), ("x13800138000123", "normal"), ("家庭地址： 某处", "sensitive"), ("sk-" + "a" * 24, "secret"), (None, "normal"), ("", "normal")],
)
def test_levels(spark, content, level):
    assert each(spark, sensitivity.level, [content]) == [level]


def test_redaction_and_detectors(spark):
    t = "api_key = abcdef12 and Bearer abcdefghijkl.mn"
    assert each(spark, sensitivity.redact, [t, None]) == ["[REDACTED:credential_assignment] and [REDACTED:bearer_token]", None]
    assert each(spark, sensitivity.detectors, [t, "a@b.cc", None]) == [["credential_assignment", "bearer_token"], ["email"], []]


def test_kinds_topics_aliases(spark):
    texts = ["请纠正：用缓存", "We decided on postgres as database", "the reason is cost", "nothing here"]
    assert each(spark, decisions.kind, texts) == ["correction", "decision", "rationale", None]
    assert each(spark, decisions.topic, ["缓存放进数据库", "postgres it is", "in the vault", "我们"]) == ["database-cache", "database", "storage", "我们"]
    assert each(spark, decisions.aliases, ["database on postgres"]) == [["数据库", "db", "postgres", "postgresql", "pg"]]


def test_numbers_across_partitions(spark):
    rows = spark.createDataFrame([("hot" if i % 3 else f"g{i % 7}", i) for i in range(500)] + [(None, 1), (None, 2)], "g string, at int").repartition(6)
    got = {(r.g, r.at): r.n for r in numbered(rows, "g", ["at"], "n").collect()}
    for g in {g for g, _ in got}:
        mine = sorted(at for h, at in got if h == g)
        assert [got[g, at] for at in mine] == list(range(1, len(mine) + 1))


def _events(spark, contents, role="user"):
    rows = [(f"e{i}", "p", role, c, "normal", f"2025-01-01T00:00:{i:02d}Z") for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, "event_key string, project_id string, role string, content string, sensitivity string, timestamp string")


def test_token_budget_runs_an_oversized_first_item(spark):
    events = _events(spark, ["a" * 414, "b" * 414])
    got = processing.within_budget(capture.queued(events), events, tokens=60).collect()
    assert [(r.event_key, r.tokens) for r in got] == [("e0", 104)]
    got = processing.within_budget(capture.queued(events), events, tokens=208).collect()
    assert len(got) == 2


def test_short_answers_need_a_signal(spark):
    assert processing.memories(_events(spark, ["ok", "remember x"], "assistant")).count() == 1


@pytest.mark.parametrize(("content", "now", "reason"), [("记住 this", "2025-01-01T00:01:00Z", "explicit"), ("hello", "2025-01-01T00:01:00Z", "below_threshold"), ("hello", "2025-01-01T00:30:00Z", "max_wait"), ("x" * 60_000, "2025-01-01T00:01:00Z", "size_threshold")])
def test_when_a_run_is_due(spark, content, now, reason):
    events = _events(spark, [content])
    sizes = events.select("event_key", F.octet_length("content").alias("bytes"))
    assert processing.run_due(capture.queued(events), sizes, now).first().reason == reason
    runs = spark.createDataFrame([("p",)] * 4, "project_id string").withColumn("at", F.to_timestamp(F.lit(now)))
    assert processing.run_due(capture.queued(events), sizes, now, runs).first().reason == "rate_limited"
    assert processing.run_due(capture.queued(events), sizes, now, runs, "manual").first().reason == "manual"
