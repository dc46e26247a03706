"""Filling fixed-capacity containers (problem 7): best-two-fit.

A container is filled greedily: the largest item that fits, again and again. Then its smallest item is replaced by the two
unpacked items that together fill the gap it leaves best, if they fill it better than it did. Items longer than the
capacity are split into full pieces and a rest; others never.

Items are dealt into blocks by a hash of their id, of about ``BLOCK`` items each; a block is packed in one task, over
counts by size, so equal sizes (however many) cost no search. What may share a container is so bounded by the block: it
costs two containers a block at most over packing all together (a test holds it to that), below one in hundreds.

Defined results: null texts are left out; empty texts (no tokens) go into their block's first container; equal sizes are
taken by id; repeated texts are items of their own; without capacities nothing is packed; an empty table gives no row.
"""

from __future__ import annotations

import base64
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import materialise, ship

#: Items packed together in one task.
BLOCK = 10_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split of text into words that goes with that vocabulary (fixed value of the public tokenizer).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PACKED = "capacity int, doc_id bigint, piece int, tokens int, container string"


def _count_tokens(vocabulary: Callable[[], bytes], pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary().splitlines())}
        encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32())], names=["doc_id", "tokens"])

    return run


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, tokens) of every text that is not null; whole texts. ``tokenizer`` is a file of the driver's, of some
    megabytes, which travels to the tasks."""
    with open(tokenizer, "rb") as f:
        vocabulary = ship(documents.sparkSession, f.read())
    texts = documents.select("doc_id", "text").where("text IS NOT NULL AND doc_id IS NOT NULL")
    return texts.mapInArrow(_count_tokens(vocabulary, pattern), "doc_id bigint, tokens int")


class _Stock:
    """How many unpacked items there are of each size."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64)
        self.sizes = [int(s) for s in np.flatnonzero(counts)]

    def take(self, size: int) -> None:
        self.left[size] -= 1
        if not self.left[size]:
            del self.sizes[bisect_right(self.sizes, size) - 1]

    def give(self, size: int) -> None:
        if not self.left[size]:
            insort(self.sizes, size)
        self.left[size] += 1

    def largest(self, most: int) -> int:
        at = bisect_right(self.sizes, most)
        return self.sizes[at - 1] if at else 0

    def best_two(self, most: int, least: int) -> tuple[int, int] | None:
        """Two sizes whose sum is as near to ``most`` as can be and above ``least``."""
        sizes, best, found = self.sizes, least, None
        low, high = 0, bisect_right(sizes, most - (sizes[0] if sizes else 0)) - 1
        while low <= high:
            a, b = sizes[low], sizes[high]
            if a + b > most or (low == high and self.left[a] < 2):
                high -= 1
                continue
            if a + b > best:
                best, found = a + b, (a, b)
                if best == most:
                    break
            low += 1
        return found


def fill(counts: np.ndarray, capacity: int) -> list[list[int]]:
    """Containers, as lists of sizes, for ``counts`` items of each size up to the capacity (size 0 apart)."""
    counts = counts.copy()
    counts[0] = 0
    full = int(counts[capacity])
    counts[capacity] = 0
    bins = [[capacity]] * full
    stock = _Stock(counts)
    while stock.sizes:
        gap, content = capacity, []
        while gap and (size := stock.largest(gap)):
            stock.take(size)
            content.append(size)
            gap -= size
        if gap and stock.sizes:
            smallest = content[-1]
            pair = stock.best_two(gap + smallest, smallest)
            if pair:
                content.pop()
                stock.give(smallest)
                for size in pair:
                    stock.take(size)
                    content.append(size)
        bins.append(content)
    return bins


def _pack(capacities: list[int]):
    """Packs each block of a partition that is sorted by block; holds ids and sizes of one block."""

    def block(number: int, ids: np.ndarray, tokens: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(ids, kind="stable")
        ids, tokens = ids[order], tokens[order]
        for capacity in capacities:
            whole = tokens // capacity
            rest = tokens % capacity
            pieces = whole + ((rest > 0) | (tokens == 0))
            doc = np.repeat(ids, pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            size = np.where(piece < np.repeat(whole, pieces), capacity, np.repeat(rest, pieces))
            bins = fill(np.bincount(size, minlength=capacity + 1), capacity)
            slots = np.array([s for content in bins for s in content], np.int64)
            of = np.repeat(np.arange(len(bins)), [len(content) for content in bins]) if bins else np.array([], np.int64)
            container = np.zeros(len(doc), np.int64)
            some = np.flatnonzero(size > 0)
            container[some[np.argsort(size[some], kind="stable")]] = of[np.argsort(slots, kind="stable")]
            names = pa.array([f"{capacity}-{number}-{c}" for c in container], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), capacity), pa.int32()), pa.array(doc), pa.array(piece, pa.int32()), pa.array(size, pa.int32()), names], names=["capacity", "doc_id", "piece", "tokens", "container"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, tokens = None, [], []
        for batch in batches:
            numbers, docs, sizes = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero(np.diff(numbers)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(numbers)], strict=True):
                if a == b:
                    continue
                if numbers[a] != current:
                    if current is not None:
                        yield from block(current, np.concatenate(ids), np.concatenate(tokens))
                    current, ids, tokens = numbers[a], [], []
                ids.append(docs[a:b])
                tokens.append(sizes[a:b].astype(np.int64))
        if current is not None:
            yield from block(current, np.concatenate(ids), np.concatenate(tokens))

    return run


def pack(counts: DataFrame, capacities: list[int], block: int = BLOCK) -> DataFrame:
    """(capacity, doc_id, piece, tokens, container) of ``counts`` (doc_id, tokens), which must be a written table."""
    wanted = sorted({c for c in capacities if c and c > 0})
    blocks = max(1, -(-counts.count() // block))
    numbered = counts.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    dealt = numbered.select("block", "doc_id", "tokens").repartition(blocks, "block").sortWithinPartitions("block")
    return dealt.mapInArrow(_pack(wanted), PACKED)


def pack_texts(documents: DataFrame, budgets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """The container of each text or piece for each capacity of ``budgets`` (a small table of settings)."""
    capacities = [r.capacity_tokens for r in budgets.select("capacity_tokens").distinct().collect()]
    return pack(materialise(token_counts(documents, tokenizer), "tokens"), capacities)


def usage(packed: DataFrame) -> DataFrame:
    """Per capacity: containers, tokens and how full the containers are."""
    return packed.groupBy("capacity").agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens")).withColumn("filled", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6))
