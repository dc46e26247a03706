import random
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from threadloom.llm import frequency as fr


def brute(records, sigma):
    occ, rec = Counter(), Counter()
    for terms in records:
        terms = [t for t in terms or [] if t is not None]
        grams = [tuple(terms[i : i + n]) for n in range(1, sigma + 1) for i in range(len(terms) - n + 1)]
        occ.update(grams)
        rec.update(set(grams))
    return {g: (occ[g], rec[g]) for g in occ}


def counted(spark, records, sigma):
    df = spark.createDataFrame([(r, "clash") for r in records], "terms array<string>, gram string").repartition(3)
    rows = fr.ngram_counts(df, "terms", sigma).collect()
    assert len({tuple(r.gram) for r in rows}) == len(rows)
    return {tuple(r.gram): (r.occurrences, r.records) for r in rows}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["a", "b", "ab", "", "ü", "a b"]), max_size=9), max_size=12), st.integers(1, 4))
def test_against_brute_force(spark, records, sigma):
    assert counted(spark, records, sigma) == brute(records, sigma)


def test_nulls_hot_terms_and_long_records(spark):
    random.seed(2)
    records = [None, [], [None, "x", None, "x"]] + [["hot" if random.random() < 0.5 else random.choice("abcdefg") for _ in range(random.choice([3, 400]))] for _ in range(60)]
    assert counted(spark, records, 3) == brute(records, 3)


def test_bands_and_repeated_rows(spark):
    rows = [(f"m{i}", [" Common ", "common"] + (["Rare　Tag"] if i < 2 else []) + (["kept"] if i < 3 else [])) for i in range(80)]
    rows += [rows[0], ("m0", rows[0][1]), ("none", None), ("blank", [" ", "-", None]), (None, ["rare"])]
    got = {r.normalized_tag: (r.occurrences, r.memories, r.band) for r in fr.tag_frequencies(spark.createDataFrame(rows, "id string, tags array<string>")).collect()}
    assert got == {"common": (160, 80, "common"), "rare-tag": (2, 2, "rare"), "kept": (3, 3, "useful")}


def test_empty_table(spark):
    assert fr.tag_frequencies(spark.createDataFrame([], "id string, tags array<string>")).count() == 0
