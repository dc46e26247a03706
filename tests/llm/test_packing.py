import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm import packing as pk


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_fill_packs_each_item_once_within_capacity(sizes):
    bins = pk.fill(np.bincount(sizes, minlength=41), 40)
    assert sorted(s for b in bins for s in b) == sorted(sizes)
    assert all(b and sum(b) <= 40 for b in bins)


def test_two_documents_replace_the_smallest():
    # greedy: 6 + 3 leaves 1 empty; 2 + 2 in place of the 3 fill it
    counts = np.bincount([6, 3, 2, 2], minlength=11)
    assert sorted(map(sorted, pk.fill(counts, 10))) == [[2, 2, 6], [3]]


def test_split_empty_null_and_repeated_ids(spark):
    counts = spark.createDataFrame([(1, 25), (2, 10), (3, 0), (4, 4), (4, 4)], "doc_id bigint, tokens int")
    rows = pk.pack(counts, [10]).collect()
    assert sorted((r.doc_id, r.tokens) for r in rows) == [(1, 5), (1, 10), (1, 10), (2, 10), (3, 0), (4, 4), (4, 4)]
    used = {}
    for r in rows:
        used[r.container] = used.get(r.container, 0) + r.tokens
    assert max(used.values()) <= 10
    assert sorted(r.piece for r in rows if r.doc_id == 1) == [0, 1, 2]
    assert pk.pack(counts.where("false"), [10]).count() == 0
    assert pk.pack(counts, []).count() == 0


def test_space_left_over_across_blocks(spark):
    rng = np.random.default_rng(4)
    sizes = np.minimum(rng.lognormal(5, 1, 6000).astype(int) + 1, 5000)
    counts = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "doc_id bigint, tokens int")
    packed = pk.pack(counts, [512, 2048], block=1500).cache()
    for r in pk.usage(packed).collect():
        assert r.tokens == sizes.sum() and r.filled > 0.985
    assert packed.groupBy("container", "capacity").sum("tokens").where("`sum(tokens)` > capacity").count() == 0


@pytest.mark.parametrize("block", [500, 1500])
def test_blocks_cost_two_containers_each_at_most(spark, block):
    rng = np.random.default_rng(5)
    counts = spark.createDataFrame([(i, int(s)) for i, s in enumerate(np.minimum(rng.lognormal(5, 1, 6000).astype(int) + 1, 5000))], "doc_id bigint, tokens int")
    whole, parts = ({r.capacity: r.containers for r in pk.usage(pk.pack(counts, [512, 2048], block=b)).collect()} for b in (6000, block))
    assert all(parts[c] - whole[c] <= 2 * (6000 // block) for c in whole), (whole, parts)


@pytest.mark.skipif(not os.path.exists(pk.TOKENIZER), reason="no tokenizer files")
def test_token_counts_cover_whole_texts(spark):
    texts = [(1, "hello world"), (2, ""), (3, None), (4, "词" * 3), (5, "a b " * 30_000), (None, "x")]
    got = {r.doc_id: r.tokens for r in pk.token_counts(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert got[1] == 2 and got[2] == 0 and 3 not in got and got[5] > 50_000 and None not in got
