"""Evaluation texts leaking into training text (problem 8).

A document leaks an item if, over letters and digits alone, it holds a run of the item's passage (12 words; for Chinese
items 20 characters) or the whole passage with at most one unit in ten changed.

The search is a prefix-filtered set join on shingles of five units (shorter items: of their whole length). Of an item
with S distinct shingles every leak keeps at least t (the shingles inside the shortest run, or those that the most
changes must spare), so it holds one of the S - t + 1 rarest.

1. One pass over all documents writes where they hold an item's shingle; a bitmap of the items' shingles, of bounded
   size, keeps most others out and changes no result.
2. From these places comes how many documents hold each shingle, and so each item's rarest ones (its prefix).
3. Places and prefixes are joined on the shingle, by a shuffle. A document with a place of a prefix is a candidate.
4. Candidates meet their document's text, streamed by document, and are verified unit by unit: a run is followed from its
   place, and item-sized windows on the place's diagonal are compared with the whole passage.

The number of passes does not depend on the number of items, and equal passages are one item until the end.

Defined results: null and empty texts leak nothing; an item without a passage, or without a letter or digit, is never
found, and one shorter than the run only whole; repeated documents are reported each; repeated item rows count once.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.session import materialise, ship

SHINGLE = 5
#: Shortest leaking run, in words and in Chinese characters.
RUN = {"word": 12, "char": 20}
_TAG_BREAK = re.compile(r"</?(?:p|br|div|li|ul|ol|tr|td|th|table|h[1-6]|hr|pre|blockquote|section|article)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
_LINK = re.compile(r"\]\([^()\s]*\)")
_HIDDEN = re.compile("[\u00AD\u034F\u061C\u115F\u1160\u17B4\u17B5\u180B-\u180F\u200B-\u200F\u202A-\u202E\u2060-\u206F\uFE00-\uFE0F\uFEFF\u3164\uFFA0]")
_WORD = re.compile(r"[^\W_]+")
_HAN = re.compile("[\u3400-\u9FFF\uF900-\uFAFF\U00020000-\U0003FFFF]")


def plain(text: str) -> str:
    """Lower case, one form of each character, without markup and invisible characters."""
    if "<" in text:
        text = _TAG.sub("", _TAG_BREAK.sub(" ", text))
    if "&" in text:
        text = html.unescape(text)
    if "](" in text:
        text = _LINK.sub("]", text)
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    return text.lower()


def units(text: str, kind: str) -> list[str]:
    """The words, or the single letters, digits and characters, of plain text."""
    found = _WORD.findall(text)
    return found if kind == "word" else list("".join(found))


def same_within(item: list[str], window: list[str], most: int) -> bool:
    """Whether ``window`` holds a stretch at most ``most`` insertions, deletions or substitutions away from ``item``."""
    n, m = len(item), len(window)
    big = most + 1
    row = [0] * (m + 1)
    for i in range(1, n + 1):
        x, before, row[0] = item[i - 1], row[0], min(i, big)
        best = row[0]
        for j in range(1, m + 1):
            cost = before if window[j - 1] == x else 1 + min(before, row[j], row[j - 1])
            before, row[j] = row[j], cost
            if cost < best:
                best = cost
        if best > most:
            return False
    return min(row) <= most


class Item:
    """An evaluation passage, its unit and what every leak of it must share."""

    def __init__(self, lang: str | None, passage: str):
        text = plain(passage)
        chinese = (lang or "").lower().startswith("zh") if lang else len(_HAN.findall(text)) * 2 > len(text)
        self.kind = "char" if chinese else "word"
        self.seq = units(text, self.kind)
        self.size = min(SHINGLE, len(self.seq))

    def needs(self, distinct: int) -> int:
        """How many of its distinct shingles every leak holds."""
        total, changes, run = len(self.seq) - self.size + 1, len(self.seq) // 10, RUN[self.kind]
        spared = total - self.size * changes
        by_run = run - self.size + 1 if len(self.seq) >= run else total
        return max(1, min(by_run, spared) - (total - distinct))


def leaks(want: list[str], kind: str, seq: list[str], places: list[tuple[int, int]]) -> bool:
    """Whether ``seq`` leaks the passage ``want``, with which it shares a shingle at each of ``places`` (in want, in seq)."""
    changes, tried = len(want) // 10, set()
    for p, at in places:
        a, b = p, at
        while a > 0 and b > 0 and want[a - 1] == seq[b - 1]:
            a, b = a - 1, b - 1
        c, d = p, at
        while c < len(want) and d < len(seq) and want[c] == seq[d]:
            c, d = c + 1, d + 1
        if c - a >= RUN[kind] or c - a == len(want):
            return True
        diagonal = at - p
        if diagonal in tried or len(seq) + changes < len(want):
            continue
        tried.add(diagonal)
        window = seq[max(0, diagonal - changes) : diagonal + len(want) + changes]
        # what at most ``changes`` insertions, deletions and substitutions turn into the other shares all other units
        if sum((Counter(want) & Counter(window)).values()) >= len(want) - changes and same_within(want, window, changes):
            return True
    return False


_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _codes(seq: list[str], kind: str, known: dict[str, int]) -> np.ndarray:
    if kind == "char":
        return np.frombuffer("".join(seq).encode("utf-32-le"), np.uint32).astype(np.uint64)
    out = []
    for word in seq:
        code = known.get(word)
        if code is None:
            if len(known) > 500_000:
                known.clear()
            code = known[word] = xxhash.xxh64_intdigest(word)
        out.append(code)
    return np.array(out, np.uint64)


def grams(codes: np.ndarray, kind: str, size: int) -> np.ndarray:
    """Hashes of the shingles of ``size`` units, in order."""
    n = len(codes) - size + 1
    if n < 1:
        return np.zeros(0, np.int64)
    h = np.full(n, size * 2 + (kind == "char"), np.uint64)
    for i in range(size):
        h = (h ^ codes[i : i + n]) * _PRIME
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


PLACES = "doc_id bigint, gram bigint, pos int"


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query_id, item, kind, size, seq, needs, grams): ``item`` is the same for equal passages."""
    known: dict[str, int] = {}
    schema = pa.schema([("query_id", pa.string()), ("item", pa.int64()), ("kind", pa.string()), ("size", pa.int32()), ("seq", pa.list_(pa.string())), ("needs", pa.int32()), ("grams", pa.list_(pa.int64()))])
    for batch in batches:
        rows = []
        for query, lang, passage in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            item = Item(lang, passage)
            if item.seq:
                own = grams(_codes(item.seq, item.kind, known), item.kind, item.size).tolist()
                rows.append((query, xxhash.xxh64_intdigest("\0".join([item.kind, *item.seq])) - (1 << 63), item.kind, item.size, item.seq, item.needs(len(set(own))), own))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 7, schema, strict=True)], schema=schema)


#: Most bits of the bitmap of the items' shingles, and its bits a shingle while there are few.
MOST_BITS, BITS_EACH = 1 << 29, 32
_PART = 1 << 16


def _bitmap(shingle: DataFrame, bits: int) -> np.ndarray:
    """The bitmap in which the bit of each shingle is set; ``bits`` / 8 bytes come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) % np.uint64(bits)
            np.bitwise_or.at(held, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
        for i in range(0, len(held), _PART):
            part = held[i : i + _PART]
            if part.any():
                yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int64()), "part": pa.array([part.tobytes()], pa.binary())})

    whole = np.zeros(bits // 8, np.uint8)
    for r in shingle.coalesce(8).mapInArrow(run, "i bigint, part binary").toLocalIterator():
        whole[r.i : r.i + len(r.part)] |= np.frombuffer(r.part, np.uint8)
    return whole


def _places(bitmap: np.ndarray, sizes: dict[str, list[int]]):
    """Where documents hold a shingle whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        bits = np.uint64(len(bitmap) * 8)
        for batch in batches:
            docs, found, places = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text or doc is None:
                    continue
                text = plain(text)
                for kind, lengths in sizes.items():
                    if kind == "char" and text.isascii():
                        lengths = []
                    codes = _codes(units(text, kind), kind, known) if lengths else ()
                    for size in lengths:
                        own = grams(codes, kind, size)
                        at = own.view(np.uint64) % bits
                        ok = np.flatnonzero(bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
                        docs.append(np.full(len(ok), doc, np.int64))
                        found.append(own[ok])
                        places.append(ok.astype(np.int32))
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (docs, found, places)], names=["doc_id", "gram", "pos"])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams through rows sorted by document, its text before its candidates; holds one text."""
    doc, seqs = None, {}
    for batch in batches:
        queries, docs = [], []
        for d, text, item, kind, seq, places in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if item is None:
                doc, seqs = d, {"text": text}
            elif d == doc:
                if kind not in seqs:
                    seqs.setdefault("plain", plain(seqs["text"]))
                    seqs[kind] = units(seqs["plain"], kind)
                if leaks(seq, kind, seqs[kind], [(p["p"], p["at"]) for p in places]):
                    queries.append(item)
                    docs.append(d)
        yield pa.RecordBatch.from_pydict({"item": pa.array(queries, pa.int64()), "doc_id": pa.array(docs, pa.int64())})


def find_leaks(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """(query_id, doc_id) of every leak."""
    spark = documents.sparkSession
    texts = documents.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    rows = eval_items.where("passage IS NOT NULL AND query_id IS NOT NULL").groupBy("query_id").agg(F.min(F.struct("passage", "lang")).alias("item")).select("query_id", "item.lang", "item.passage")
    schema = "query_id string, item bigint, kind string, size int, seq array<string>, needs int, grams array<bigint>"
    every = materialise(rows.mapInArrow(_items, schema), "items")
    items = materialise(every.groupBy("item").agg(*(F.first(c).alias(c) for c in ("kind", "size", "seq", "needs", "grams"))), "passages")
    shingle = items.select("item", "needs", F.posexplode("grams").alias("p", "gram"))
    sizes: dict[str, list[int]] = {}
    for r in items.select("kind", "size").distinct().collect():  # at most ten
        sizes.setdefault(r.kind, []).append(r["size"])
    if not sizes:
        return spark.createDataFrame([], "query_id string, doc_id bigint")
    bits = min(MOST_BITS, 1 << (BITS_EACH * shingle.count()).bit_length())
    sent = ship(spark, _bitmap(shingle.select("gram"), bits))
    held = texts.mapInArrow(lambda b: _places(sent(), sizes)(b), PLACES)
    own = shingle.select("gram").distinct()
    places = materialise(held.join(own, "gram", "left_semi"), "places")
    spread = places.groupBy("gram", "doc_id").agg(F.lit(1).alias("one")).groupBy("gram").agg(F.count("*").alias("documents"))
    ordered = Window.partitionBy("item").orderBy("documents", "gram")  # at most an item's length
    # a shingle that no document holds may be of a prefix, too: it finds nothing, and costs nothing
    distinct = shingle.groupBy("item", "gram").agg(F.first("needs").alias("needs"), F.collect_list("p").alias("ps")).join(spread, "gram", "left").withColumn("documents", F.coalesce("documents", F.lit(0)))
    ranked = distinct.withColumn("n", F.row_number().over(ordered)).withColumn("all", F.count("*").over(Window.partitionBy("item")))
    prefix = ranked.where(F.col("n") <= F.col("all") - F.col("needs") + 1).select("item", "gram", F.explode("ps").alias("p"))
    met = places.join(prefix, "gram").groupBy("doc_id", "item").agg(F.collect_set(F.struct("p", F.col("pos").alias("at"))).alias("places"))
    candidates = materialise(met.join(items.select("item", "kind", "seq"), "item").select("doc_id", "item", "kind", "seq", F.array_sort("places").alias("places")), "candidates")
    asked = texts.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    nothing = "CAST(NULL AS bigint) AS item", "CAST(NULL AS string) AS kind", "CAST(NULL AS array<string>) AS seq", "CAST(NULL AS array<struct<p:int,at:int>>) AS places"
    both = asked.selectExpr("doc_id", "text", *nothing).unionByName(candidates.withColumn("text", F.lit(None).cast("string")))
    # a document of which there are more rows than one has all of them verified, the last of its texts counting
    found = both.repartition("doc_id").sortWithinPartitions("doc_id", F.col("item").isNotNull(), "text").mapInArrow(_verify, "item bigint, doc_id bigint")
    return every.select("query_id", "item").join(found, "item").select("query_id", "doc_id").distinct()
