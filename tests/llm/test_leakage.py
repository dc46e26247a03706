import random

from threadloom.llm import leakage as lk

W = [f"w{i}" for i in range(400)]


def leaks(spark, docs, items):
    d = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(docs)], "doc_id bigint, text string, query_id string")
    e = spark.createDataFrame(items, "query_id string, lang string, passage string")
    return {(r.query_id, r.doc_id) for r in lk.find_leaks(d, e).collect()}


def test_runs_and_changed_passages(spark):
    passage = " ".join(W[:60])
    changed = W[:60].copy()
    for i in range(4, 60, 10):
        changed[i] = f"x{i}"
    more = [f"y{i}" if i % 8 == 3 else w for i, w in enumerate(W[:60])]
    docs = [
        "so " + " ".join(W[20:32]) + " end", "so " + " ".join(W[20:31]) + " end", " ".join(changed), " ".join(more), " ".join(W[20:32]).upper().replace(" ", "  —\n"),
        "".join(f"<b>{w}</b>&nbsp;" for w in W[5:17]), " ".join(w[0] + "​" + w[1:] for w in W[5:17]), None, "", " ".join(W[100:400]), "z " * 100_000 + " ".join(W[40:52]),
        " ".join(changed[:30] + ["extra"] + changed[30:31] + changed[32:]),
    ]
    assert leaks(spark, docs, [("q", "en", passage), ("q", "en", passage), ("n", "en", None)]) == {("q", d) for d in (0, 2, 4, 5, 6, 10)}


def test_chinese_characters(spark):
    passage = "".join(chr(0x4E00 + i * 7) for i in range(90))
    docs = ["前" + passage[10:30] + "后", passage[10:29], "，".join(passage[50:71]), "x" + passage[:40] + "甲" + passage[41:] + "y"]
    assert leaks(spark, docs, [("z", "zh", passage)]) == {("z", 0), ("z", 2), ("z", 3)}


def test_against_brute_force_on_shared_boilerplate(spark):
    random.seed(6)
    boiler = W[300:310]
    items = [(f"q{k}", "en", " ".join(boiler + random.choices(W[:120], k=40))) for k in range(12)]
    docs = []
    for _ in range(150):
        words = random.choices(W[:120], k=30) + boiler
        source = random.choice(items)[2].split()
        a, n = random.randrange(20), random.randrange(6, 20)
        docs.append(" ".join(words[:10] + source[a : a + n] + words[10:]))
    want = set()
    for d, text in enumerate(docs):
        for q, _, passage in items:
            p = passage.split()
            if any(f" {' '.join(p[i : i + 12])} " in f" {text} " for i in range(len(p) - 11)):
                want.add((q, d))
    assert leaks(spark, docs, items) == want
    assert want


def test_empty_tables(spark):
    assert leaks(spark, [], [("q", "en", " ".join(W[:30]))]) == set()
    assert leaks(spark, ["a b c"], []) == set()


def test_short_items_are_found_whole(spark):
    items = [("four", "en", "alpha beta Gamma delta"), ("one", "en", "zeta!"), ("zh", "zh", "\u4e2d\u6587"), ("none", "en", "?!"), ("eleven", "en", " ".join(W[:11])), ("again", "en", "ZETA")]
    docs = ["x alpha, beta gamma delta y", "alpha beta delta", "the zeta", "\u7528\u4e2d\u6587\u5199", " ".join(["a", *W[:11], "b"]), " ".join(W[:10])]
    assert leaks(spark, docs, items) == {("four", 0), ("one", 2), ("again", 2), ("zh", 3), ("eleven", 4), ("eleven", 5)}


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    items = [(f"q{k}", "en", " ".join(W[k * 30 : k * 30 + 30])) for k in range(10)]
    docs = [" ".join(W[k * 30 + 2 : k * 30 + 16]) for k in range(10)] + ["none of them " + " ".join(W[350:])]
    want = {(f"q{k}", k) for k in range(10)}
    assert leaks(spark, docs, items) == want
    monkeypatch.setattr(lk, "MOST_BITS", 64)
    assert leaks(spark, docs, items) == want


def test_equal_items_and_documents(spark):
    passage = " ".join(W[:30])
    got = leaks(spark, [passage] * 5, [("a", "en", passage), ("b", "en", passage.upper())])
    assert got == {(q, d) for q in "ab" for d in range(5)}
