"""Frequency of every distinct term and term sequence (problem 2): suffix-sorted n-gram counting.

Every position of a record gives one suffix, truncated to ``sigma`` terms. Suffixes are routed by their first term and
sorted in reverse lexicographic order; a stack then sees all n-grams with a common prefix together and sums the counts
of a prefix when it is left. How many records hold an n-gram is summed alike: a suffix carries the length from which its
prefixes occur for the first time in their record, so the number of first occurrences is the number of records, and no
set of records is ever held.

Equal suffixes are combined in the map task, so a term that makes up a third of all rows costs a row a task; and a first
term's suffixes are divided by their second term over ``SALTS`` routes, whose partial counts of the single term are
added up at the end.

Defined results: null and empty lists and null terms count nothing; a term repeated in a record adds to its occurrences,
not to its records; an empty table gives no row; long records only give more suffixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import normalize_tag

SALTS = 8
#: Distinct suffixes that a map task combines before it hands them on.
COMBINE = 200_000
COUNTS = "gram array<string>, occurrences bigint, records bigint"


def _suffixes(sigma: int):
    """(suffix, fresh, n): fresh is the length from which a prefix is new in its record (sigma + 1: never)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, int] = {}

        def pack() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"suffix": pa.array([list(k[:-1]) for k in held], pa.list_(pa.string())), "fresh": pa.array([k[-1] for k in held], pa.int32()), "n": pa.array(list(held.values()), pa.int64())})

        for batch in batches:
            for terms in batch.column(0).to_pylist():
                seen: set[tuple] = set()
                for i in range(len(terms)):
                    suffix = tuple(terms[i : i + sigma])
                    fresh = sigma + 1
                    for size in range(len(suffix), 0, -1):
                        if suffix[:size] in seen:
                            break
                        seen.add(suffix[:size])
                        fresh = size
                    key = (*suffix, fresh)
                    held[key] = held.get(key, 0) + 1
                if len(held) > COMBINE:
                    yield pack()
                    held.clear()
        yield pack()

    return run


def _stack(sigma: int):
    """Streams through suffixes in reverse lexicographic order; holds one path of prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path: list[str] = []
        counts: list[list[int]] = []  # of each prefix: how many suffixes there are by ``fresh``
        out: list[tuple[list[str], int, int]] = []

        def leave(size: int) -> None:
            while len(path) > size:
                mine = counts.pop()
                out.append((path[:], sum(mine), sum(mine[: len(path) + 1])))
                path.pop()
                if counts:
                    counts[-1] = [a + b for a, b in zip(counts[-1], mine, strict=True)]

        def pack() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"gram": pa.array([g for g, _, _ in out], pa.list_(pa.string())), "occurrences": pa.array([o for _, o, _ in out], pa.int64()), "records": pa.array([r for _, _, r in out], pa.int64())})

        for batch in batches:
            for suffix, fresh, n in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("suffix", "fresh", "n")), strict=True):
                common = 0
                while common < len(path) and common < len(suffix) and path[common] == suffix[common]:
                    common += 1
                leave(common)
                for term in suffix[common:]:
                    path.append(term)
                    counts.append([0] * (sigma + 2))
                counts[-1][fresh] += n
            if len(out) > 20_000:
                yield pack()
                out.clear()
        leave(0)
        yield pack()

    return run


def ngram_counts(records: DataFrame, terms: str, sigma: int = 1) -> DataFrame:
    """(gram, occurrences, records) of all n-grams of up to ``sigma`` terms; each row of ``records`` is one record."""
    lists = records.select(F.filter(terms, lambda t: t.isNotNull()).alias("terms")).where(F.size("terms") > 0)
    suffixes = lists.mapInArrow(_suffixes(sigma), "suffix array<string>, fresh int, n bigint")
    route = F.xxhash64(F.col("suffix")[0], F.pmod(F.xxhash64(F.try_element_at("suffix", F.lit(2))), F.lit(SALTS)))
    routed = suffixes.withColumn("route", route).repartition("route").sortWithinPartitions("route", F.desc("suffix"))
    counted = routed.mapInArrow(_stack(sigma), COUNTS)
    if sigma == 1:  # no second term, so no route was divided; routes only share a partition
        return counted
    single = counted.where(F.size("gram") == 1).groupBy("gram").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return single.unionByName(counted.where(F.size("gram") > 1))


def memory_tags(memories: DataFrame) -> DataFrame:
    """(id, tags): one row a memory, tags normalised, blank ones dropped. Of repeated rows one stands."""
    tags = F.filter(F.transform("tags", normalize_tag), lambda t: t != "")
    return memories.where("id IS NOT NULL").groupBy("id").agg(F.max("tags").alias("tags")).select("id", tags.alias("tags"))


def tag_frequencies(memories: DataFrame, rare: int = 3, common: float = 0.05) -> DataFrame:
    """(normalized_tag, occurrences, memories, band): band is rare (in fewer than ``rare`` memories), common (in more than
    ``common`` of all) or useful."""
    total = memories.agg(F.countDistinct("id").alias("total")).first()["total"]
    counts = ngram_counts(memory_tags(memories), "tags")
    band = F.when(F.col("records") < rare, "rare").when(F.col("records") > common * F.lit(total), "common").otherwise("useful")
    return counts.select(F.col("gram")[0].alias("normalized_tag"), "occurrences", F.col("records").alias("memories"), band.alias("band"))
