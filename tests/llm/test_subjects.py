import random

import pytest

from threadloom.llm import subjects as sb

NOUNS = {s: [f"{s}{c}" for c in "abcdefghij"] for s in ("law", "sport", "cooking")}
FRAMES = ["We agreed to move the {} before the {} is due.", "Could the {} be the reason that the {} failed?", "Please remember that the {} comes before any {}.", "There are 12 open points on the {} and none on the {}."]
NEUTRAL = ["Please answer in one paragraph.", "No further questions from my side.", "Thanks, that is clear now."]


def said(rng, subject, n):
    return [rng.choice(FRAMES).format(*rng.choices(NOUNS[subject], k=2)) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    rows, truth = [], {}
    for d in range(600):
        own = rng.sample(sorted(NOUNS), rng.choice([0, 1, 1, 1, 2]))
        parts = [p for s in own for p in said(rng, s, 4)] + rng.choices(NEUTRAL, k=3)
        if len(own) == 1 and rng.random() < 0.3:
            parts += said(rng, rng.choice([s for s in NOUNS if s not in own]), 1)  # a passing mention
        rng.shuffle(parts)
        rows.append((d, " ".join(parts)))
        truth[d] = set(own)
    return rows, truth


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id bigint, text string, subject string")
    return docs, spark.createDataFrame([(s, "x") for s in NOUNS], "subject string, description string"), spark.createDataFrame(labels, "doc_id bigint, subject string")


def test_held_out_accuracy(spark, corpus):
    rows, truth = corpus
    labels = [(d, s) for d in range(0, 300) for s in truth[d]] + [(0, "unknown"), (None, "law"), (10**9, "law")]
    got: dict[int, set] = {}
    for r in sb.find(*frames(spark, [*rows, (9001, None), (9002, ""), (9003, "…")], labels)).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(got.get(d, set()) == truth[d] for d in range(300, 600))
    assert right / 300 >= 0.9
    assert not {9001, 9002, 9003} & got.keys()
    assert max(map(len, got.values())) <= 2


def test_without_labels_or_documents(spark, corpus):
    rows, _ = corpus
    assert sb.find(*frames(spark, rows[:20], [])).count() == 0
    assert sb.find(*frames(spark, [], [(1, "law")])).count() == 0
