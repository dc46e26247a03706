"""Personal information inside free text (problem 3): information-theoretic sanitisation.

How much a term discloses of a protected entity is told by the corpus, in bits: log2 of the share of its occurrences that
co-occur with the entity, over that share among all terms. Formats, such as those of email addresses and phone numbers,
only propose; what the corpus does not bear out is left as it is.

* Email addresses, phone numbers, identity numbers, addresses and titled names are proposed by their format. A proposal
  stands if one of the ``NEAR`` terms before or after it discloses that type: if it stands near such proposals far more
  often than terms do. A shape (digits, letters and marks in a row) of which most proposals stand so discloses its type,
  too, and then stands anywhere.
* Latin names without a title have no format. A word that occurs in the local parts of email addresses or behind titles
  far more often than words do discloses a person; two words in a row are a name if one discloses and the other does
  too, or is no harmless word (``HARMLESS``).
* Chinese family names are no list: the characters with which the values of owner fields and titled names begin disclose
  a family name, and what follows them a given name. A name is both in a row.

1. ``term_statistics`` counts, over all texts, terms and their protected contexts.
2. ``_scan`` proposes, where the content is read. Common harmless words travel along (``COMMON`` at most) to keep pairs out
   that no verdict would let pass; characters that disclose a family name travel along, of which there are at most as
   many as Unicode has.
3. Distinct proposals are joined with the statistics; verdicts go back to their events by a join.

Defined results: null and empty texts hold nothing; very long texts are scanned whole; repeated rows count as often as
they occur; ties do not matter, as a text may hold any number of items of each type; what is not replaced stays letter
for letter as it was.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import fold
from threadloom.operators.delivery import rank
from threadloom.session import materialise, ship

#: Bits of disclosure from which a term reveals an entity.
THRESHOLD = 4.0
#: A word of less disclosure is harmless if it occurs more than twice and is mostly written in lower case, or makes up
#: more than this share of all words.
HARMLESS = 2e-5
#: Most harmless words that travel to the tasks. It changes no result: verdicts judge every word by the same rule.
COMMON = 50_000

_AT = r"\s?(?:@|\(at\)|\[at\]|\{at\}|<at>)\s?"
_DOT = r"(?:\.|\s?(?:\(dot\)|\[dot\]|\{dot\}|<dot>)\s?)"
EMAIL = re.compile(rf"([A-Z0-9](?:[A-Z0-9._%+-]*[A-Z0-9])?)(?:{_AT}|\sat\s(?=[A-Z0-9-]+\sdot\s))([A-Z0-9-]+(?:(?:{_DOT}|\sdot\s)[A-Z0-9-]+)*(?:{_DOT}|\sdot\s)[A-Z]{{2,}})(?![A-Z0-9])", re.I)
ID_NUMBER = re.compile(
    r"(?<![\dA-Za-z])(?:"
    r"\d{6}[ -]?(?:18|19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])[ -]?\d{3}[\dXx]"  # resident identity number
    r"|\d{3}([- ])\d{2}\1\d{4}"  # social security number
    r"|[A-Za-z]{2}([ -]?)\d{2}\2\d{2}\2\d{2}\2[A-Da-d]"  # national insurance number
    r"|[A-Z]{1,2}\d{7}"  # passport
    r")(?![\dA-Za-z])"
)
ID_CUED = re.compile(r"(?:passport|护照|ssn|social security|ni no|ni number|insurance)[^\d\n]{0,24}?(?<![\dA-Za-z])([A-Za-z]{0,2} ?\d(?:[ -]?\d){6,9}(?: ?[A-Da-d])?)(?![\dA-Za-z])", re.I)
PHONE = re.compile(
    r"(?<![\d.,/A-Za-z-])(?:"
    r"\+\d{1,3}[ .-]?(?:\(0\)[ ]?)?(?:\(?\d{1,5}\)?[ .-]?)(?:\d{2,5}[ .-]?){1,3}\d{2,4}"  # with a country code
    r"|\(\d{3}\)[ ]?\d{3}[-. ]\d{4}|\d{3}([-. ])\d{3}\1\d{4}"  # North America
    r"|(?:\(0\d{2,4}\)|0\d{2,4})[ -]?\d{3,4}[ -]?\d{3,4}"  # with a trunk prefix
    r"|(?:86[- ]?)?1[3-9]\d([- ]?)\d{4}\2\d{4}"  # Chinese mobile
    r")(?![\d/]|[.,]\d|-\d|[A-Za-z])"
)
_STREET = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Close|Row|Boulevard|Blvd|Drive|Dr|Court|Ct|Way|Place|Pl|Square|Sq|Terrace|Crescent|Walk|Gardens|Grove|Mews|Alley|Hill|Yard|Parade|Quay)"
_PART = r"(?:Flat|Apt|Apartment|Unit|Suite)\.?\s?#?\d+[A-Z]?,\s?"
_TOWN = r"(?:,\s?(?:(?-i:[A-Z][A-Za-z'’-]+(?:\s[A-Z][A-Za-z'’-]+)?)|[A-Z'’-]+)(?:\s\d{4,6}(?!\d))?)?"
ADDRESS = re.compile(
    rf"(?<![\w-])(?:{_PART})?\d{{1,5}}[A-Z]?,?\s(?:[A-Z'’.-]+\s){{1,2}}{_STREET}\b\.?(?!-)(?:,\s?{_PART[:-4]})?{_TOWN}|(?<![\w-])P\.?\s?O\.?\s?Box\s?#?\d+{_TOWN}",
    re.I,
)
ADDRESS_ZH = re.compile("(?:[一-鿿]{2}[省市](?:[一-鿿]{2,3}[市区县镇])?|[一-鿿]{2}[区县镇])?[一-鿿]{2,3}(?:路|街|巷|弄|大道|胡同)[0-9]+(?:号|弄)(?:[0-9]+(?:号楼|栋|幢|座|单元|室|楼|层))*|邮政信箱[0-9]+号?|信箱[0-9]+号")
TITLED = re.compile(r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Professor|Sir|Madam)\.?\s([A-Z][a-z'’-]+|[A-Z]{2,})(?![A-Za-z])(?:\s[A-Z][a-z'’-]+)?")
TITLE_ZH = re.compile("先生|女士|小姐|博士|教授|医生|老师")
OWNER_ZH = re.compile("(?:负责人|联系人|姓名|经办人|收件人|签字人)[:：]\\s?([一-鿿]{2,4})")
#: What a field says that has no value.
NO_VALUE_ZH = ("待定", "未定", "暂无", "不详", "未知", "没有")
#: What follows the name of a system, not of a person.
SYSTEM_ZH = ("项目", "平台", "小组", "计划", "档案")
HAN = re.compile("[一-鿿]+")
WORD = re.compile(r"[A-Za-z][A-Za-z'’]*")
PAIR = re.compile(r"(?<![\w@.+-])(?=([A-Za-z][a-z'’]{1,}|[A-Z]{2,})(,?\s)([A-Za-z][a-z'’]+|[A-Z]{2,}|[A-Z]\.)(?![\w@]))")
FIRST_INITIAL = re.compile(r"(?<![\w@.+-])[A-Z]\.\s?([A-Z][a-z'’]+)(?![\w@])")


def readable(text: str) -> str:
    """One form of each character (full-width digits and signs become plain ones)."""
    return text if text.isascii() else "".join(map(_form, text))


@functools.lru_cache(1 << 16)
def _form(char: str) -> str:
    return unicodedata.normalize("NFKC", char)


def origins(text: str, clean: str) -> Callable[[int], int]:
    """Where in ``text`` a place of ``clean``, its readable form, comes from."""
    if len(text) == len(clean):
        return lambda at: at
    at = [i for i, c in enumerate(text) for _ in _form(c)] + [len(text)]
    return at.__getitem__


def formats(text: str) -> list[tuple[int, int, str]]:
    """Spans (from, to, type) of items with a format of their own, in order, not overlapping; text is ``readable``."""
    spans: list[tuple[int, int, str]] = []

    def add(a: int, b: int, kind: str) -> None:
        if all(b <= x or y <= a for x, y, _ in spans):
            spans.append((a, b, kind))

    low = text.lower()
    if "@" in text or "at" in low:
        for m in EMAIL.finditer(text):
            add(m.start(), m.end(), "email")
    if any(c.isdigit() for c in text):
        for m in ADDRESS.finditer(text):
            add(m.start(), m.end(), "address")
        if not text.isascii():
            for m in ADDRESS_ZH.finditer(text):
                add(m.start(), m.end(), "address")
        for m in ID_NUMBER.finditer(text):
            add(m.start(), m.end(), "id_number")
        if "passport" in low or "ssn" in low or "soci" in low or "ni n" in low or "insur" in low or "护照" in text:
            for m in ID_CUED.finditer(text):
                add(m.start(1), m.end(1), "id_number")
        for m in PHONE.finditer(text):
            if sum(c.isdigit() for c in m.group()) >= 10:
                add(m.start(), m.end(), "phone")
    for m in TITLED.finditer(text):
        add(m.start(), m.end(), "name")
    return sorted(spans)


#: Terms on either side of a proposal that may speak for it.
NEAR = 3
_TERM = re.compile("[A-Za-z][A-Za-z'’]*|[一-鿿]+")


def around(text: str, a: int, b: int, kind: str) -> str:
    """The terms next to a proposal (words, and characters by two), in lower case, with the title of a titled name."""

    def terms(part: str, last: bool) -> list[str]:
        found = []
        for run in _TERM.findall(part):
            found += [run.lower()] if run[0] < "一" else [run[i : i + 2] for i in range(max(1, len(run) - 1))]
        return found[-NEAR:] if last else found[:NEAR]

    before, after = text[max(0, a - 40) : a], text[b : b + 40]
    title = [WORD.match(text, a).group().lower()] if kind == "name" else []
    return " ".join([*terms(before, True), *title, *terms(after, False)])


def shape(item: str) -> str:
    """The form of an item: its digits, letters and characters as one each, words in a row as one."""
    return re.sub(r"a(?: a)+", "a", re.sub("[一-鿿]+", "字", re.sub("[A-Za-z'’]+", "a", re.sub(r"\d+", "9", item))))


def titled_han(text: str, family: frozenset) -> Iterator[tuple[int, int]]:
    """Spans of Chinese names with a title: from the farthest of the three characters before the title that discloses a
    family name, or a character before it where both may be one."""
    for m in TITLE_ZH.finditer(text):
        start = m.start()
        for size in (3, 2, 1):
            a = start - size
            if a >= 0 and (1, text[a]) in family and HAN.fullmatch(text, a, start):
                yield a, m.end()
                break


def local_terms(address: str) -> list[str]:
    """The terms in the local part of an email address, without what follows a plus sign."""
    local = EMAIL.match(address).group(1) if EMAIL.match(address) else address
    return [t for t in re.split(r"[^a-z]+", local.split("+")[0].lower()) if len(t) > 1]


def candidates(text: str, spans: list[tuple[int, int, str]], common: frozenset, family: frozenset) -> list[tuple[int, int, str, str]]:
    """(from, to, term, other term) of what may be a name: the other term is empty for an initial; of a Chinese name
    they are family and given name."""
    free = lambda a, b: all(b <= x or y <= a for x, y, _ in spans)
    out = []
    for m in PAIR.finditer(text):
        a, b = m.group(1).lower(), m.group(3).lower()
        if a in common or b in common:
            continue
        start, end = m.start(1), m.end(3)
        if free(start, end):
            if b.endswith("."):
                if m.group(2)[0] != ",":
                    out.append((start, end, a, ""))
            elif m.group(2)[0] != "," or (m.group(1)[0].isupper() and m.group(3)[0].isupper()):
                out.append((start, end, a, b))
    for m in FIRST_INITIAL.finditer(text):
        if m.group(1).lower() not in common and free(m.start(), m.end()):
            out.append((m.start(), m.end(), m.group(1).lower(), ""))
    if not text.isascii():
        for run in HAN.finditer(text):
            for i in range(run.start(), run.end() - 1):
                for size, given in ((1, 2), (1, 1), (2, 2)):
                    end = i + size + given
                    if (size, text[i]) in family and end <= run.end() and free(i, end) and not text.startswith(SYSTEM_ZH, end):
                        out.append((i, end, text[i : i + size], text[i + size : end]))
    return out


COUNTS = "term string, n bigint, low bigint, c bigint, family bigint, given bigint"


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and term: occurrences, those in lower case, and those in a protected context; for Chinese terms of one or
    two characters, as family and as given name."""
    counts: dict[str, list[int]] = {}

    def pack() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array([v[i] for v in counts.values()], pa.int64()) for i in range(5))], names=["term", "n", "low", "c", "family", "given"])

    def at(term: str) -> list[int]:
        v = counts.get(term)
        if v is None:
            v = counts[term] = [0, 0, 0, 0, 0]
        return v

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if not text:
                continue
            text = readable(text)
            if "@" in text or "at" in text:
                for m in EMAIL.finditer(text):
                    for t in local_terms(m.group()):
                        v = at(t)
                        v[0] += 1
                        v[2] += 1
            for m in TITLED.finditer(text):
                v = at(m.group(1).lower())
                v[0] += 1
                v[2] += 1
            for w in WORD.findall(text):
                low = w.lower()
                v = at(low)
                v[0] += 1
                v[1] += low == w
            if text.isascii():
                continue
            for run in HAN.findall(text):
                for i in range(len(run)):
                    at(run[i])[0] += 1
                    if i + 1 < len(run):
                        at(run[i : i + 2])[0] += 1
            for m in OWNER_ZH.finditer(text):
                name = m.group(1)
                if not name.startswith(NO_VALUE_ZH):  # where the name ends is not told: every division counts
                    for size, given in ((1, 2), (1, 1), (2, 2), (2, 1)):
                        if size + given <= len(name) and not text.startswith(SYSTEM_ZH, m.start(1) + size + given):
                            at(name[size : size + given])[4] += 1
                    at(name[0])[3] += 1
                    at(name[:2])[3] += 1
            for m in TITLE_ZH.finditer(text):
                for size in (1, 2, 3):
                    if HAN.fullmatch(text, max(0, m.start() - size), m.start()):
                        at(text[m.start() - size] if m.start() >= size else text[0])[3] += 1
        if len(counts) > 200_000:
            yield pack()
            counts.clear()
    yield pack()


def _bits(count: str, of: str, all_count: Column, all_of: Column) -> Column:
    return F.when((F.col(count) > 0) & (F.col(of) > 0), F.log2(F.col(count) / F.col(of) * all_of / all_count)).otherwise(F.lit(-100.0))


def term_statistics(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(term, n, bits, family_bits, given_bits, harmless) over all rows of the one column ``texts``."""
    sums = texts.mapInArrow(_statistics, COUNTS).groupBy("term").agg(*(F.sum(c).alias(c) for c in ("n", "low", "c", "family", "given")))
    counted = materialise(sums, "terms")
    kind = F.when(F.col("term").rlike("^[\\u4e00-\\u9fff]"), F.length("term")).otherwise(0)  # Latin words; one or two characters
    sums = {r.kind: r for r in counted.groupBy(kind.alias("kind")).agg(*(F.sum(c).alias(c) for c in ("n", "c", "family", "given"))).collect()}  # three rows
    of = lambda c: F.coalesce(*(F.when(kind == k, F.lit(r[c])) for k, r in sums.items()), F.lit(0))
    bits = _bits("c", "n", of("c"), of("n"))
    harmless = (bits < threshold) & (F.col("n") > 2) & ((2 * F.col("low") >= F.col("n")) | (F.col("n") > HARMLESS * of("n")))
    scored = counted.select("term", "n", bits.alias("bits"), _bits("family", "n", of("family"), of("n")).alias("family_bits"), _bits("given", "n", of("given"), of("n")).alias("given_bits"), ((kind == 0) & harmless).alias("harmless"))
    return materialise(scored, "disclosure")


def _known(statistics: DataFrame, threshold: float, most: int = COMMON) -> tuple[frozenset, frozenset]:
    """The most frequent harmless words, and (length, first character) of all that discloses a family name."""
    words = statistics.where("harmless").orderBy(F.desc("n"), "term").limit(most).select("term").collect()
    # of family names of one and of two characters the first one: at most twice the characters of Unicode
    family = statistics.where(F.col("family_bits") >= threshold).select(F.length("term").alias("size"), F.substring("term", 1, 1).alias("first")).distinct().collect()
    return frozenset(r.term for r in words), frozenset((r["size"], r["first"]) for r in family)


PROPOSED = "types array<string>, proposals array<struct<kind:string,a:string,b:string>>"


def proposals(text: str, common: frozenset, family: frozenset) -> tuple[list[tuple[int, int]], list[tuple[int, int, str, str, str]], list[tuple[int, int, str, str, str]]]:
    """Of a readable text: spans of titled Chinese names, which the family names decide; proposals by format, and by
    names, as (from, to, kind, term, other term); of a format, the terms around it and its shape."""
    spans = formats(text)
    titled = [] if text.isascii() else [(a, b) for a, b in titled_han(text, family) if all(b <= x or y <= a for x, y, _ in spans)]
    taken = [*spans, *((a, b, "name") for a, b in titled)]
    formed = [(a, b, kind, around(text, a, b, kind), shape(text[a:b])) for a, b, kind in spans]
    return titled, formed, [(a, b, "person", one, two) for a, b, one, two in candidates(text, taken, common, family)]


def _scan(common: frozenset, family: frozenset):
    listed = pa.list_(pa.struct([("kind", pa.string()), ("a", pa.string()), ("b", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types, found = [], []
            for text in batch.column(batch.schema.get_field_index("content")).to_pylist():
                titled, formed, persons = proposals(readable(text), common, family) if text else ([], [], [])
                types.append(["name"] if titled else [])
                found.append([{"kind": k, "a": a, "b": b} for k, a, b in sorted({p[2:] for p in (*formed, *persons)})])
            keep = [i for i, n in enumerate(batch.schema.names) if n != "content"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(types, pa.list_(pa.string())), pa.array(found, listed)], names=[*(batch.schema.names[i] for i in keep), "types", "proposals"])

    return run


def _verdicts(told: DataFrame, statistics: DataFrame, threshold: float) -> DataFrame:
    """The distinct proposals (kind, a, b) that stand, and whether both terms say so (``sure``).

    ``told``: the proposals of all events, (kind, a, b)."""
    counted = materialise(told.groupBy("kind", "a", "b").agg(F.count("*").alias("m")), "proposals")
    # how often each term stands near proposals of a type, of all its occurrences
    formed = counted.where("kind <> 'person'").select("kind", "a", "b", "m", F.explode(F.array_distinct(F.split("a", " "))).alias("term"))
    beside = materialise(formed.groupBy("kind", "term").agg(F.sum("m").alias("beside")).join(statistics.select("term", "n"), "term"), "beside")
    total = statistics.agg(F.sum("n")).first()[0] or 1
    near = {r.kind: r.n for r in beside.groupBy("kind").agg(F.sum("beside").alias("n")).collect()}  # a row a type
    all_beside = F.coalesce(*(F.when(F.col("kind") == k, F.lit(n)) for k, n in near.items()), F.lit(1))
    telling = beside.where(_bits("beside", "n", all_beside, F.lit(total)) >= threshold).select("kind", "term", F.lit(True).alias("tells"))
    told_by = formed.join(telling, ["kind", "term"], "left").groupBy("kind", "a", "b").agg(F.max("m").alias("m"), F.max(F.coalesce("tells", F.lit(False))).alias("tells"))
    told_by = materialise(told_by, "told")
    # a shape of which most stand by the terms near them discloses its type wherever it stands
    shapes = told_by.groupBy("kind", "b").agg((2 * F.sum(F.when(F.col("tells"), F.col("m")).otherwise(0)) >= F.sum("m")).alias("shape_tells"))
    stand = told_by.join(shapes, ["kind", "b"]).where("tells OR shape_tells").select("kind", "a", "b", F.lit(True).alias("sure"))
    persons = counted.where("kind = 'person'").select("kind", "a", "b")
    one = statistics.select(F.col("term").alias("a"), F.col("bits").alias("bits_a"), "family_bits", F.col("harmless").alias("harmless_a"))
    two = statistics.select(F.col("term").alias("b"), F.col("bits").alias("bits_b"), "given_bits", F.col("harmless").alias("harmless_b"))
    joined = persons.join(one, "a", "left").join(two, "b", "left")
    han = F.col("a").rlike("^[\\u4e00-\\u9fff]")
    bits_a, bits_b = F.coalesce("bits_a", F.lit(-100.0)), F.coalesce("bits_b", F.lit(-100.0))
    chinese = han & (F.col("family_bits") >= threshold) & (F.col("given_bits") >= threshold)
    single = ~han & (F.col("b") == "") & (bits_a >= threshold)
    harmless = F.coalesce("harmless_a", F.lit(False)) | F.coalesce("harmless_b", F.lit(False))
    both = ~han & (F.col("b") != "") & (F.greatest(bits_a, bits_b) >= threshold) & ~harmless
    named = joined.where(chinese | single | both).select("kind", "a", "b", (chinese | single | (F.least(bits_a, bits_b) >= threshold)).alias("sure"))
    return stand.unionByName(named)


def find(deliveries: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(event_id, pii_type) of what the kept copies of the events hold.

    The content is scanned where it is read, once for the statistics and once for the items, and is not shuffled.
    """
    spark = deliveries.sparkSession
    statistics = term_statistics(deliveries.select("content"), threshold)
    known = ship(spark, _known(statistics, threshold))
    keyed = deliveries.select(F.coalesce(fold(F.col("event_id")), F.concat(F.lit("\0delivery "), F.col("delivery_id").cast("string"))).alias("event_key"), rank().alias("rank"), "content")
    schema = f"event_key string, rank struct<unsound:int,received_at:timestamp,delivery_id:bigint>, {PROPOSED}"
    scanned = keyed.mapInArrow(lambda b: _scan(*known())(b), schema)
    kept = scanned.groupBy("event_key").agg(F.min(F.struct("rank", "types", "proposals")).alias("kept")).select("event_key", "kept.types", "kept.proposals")
    kept = materialise(kept.where((F.size("types") > 0) | (F.size("proposals") > 0)), "scanned")
    told = kept.select("event_key", F.explode("proposals").alias("p")).select("event_key", "p.*")
    stand = _verdicts(told.select("kind", "a", "b"), statistics, threshold)
    kind = F.when(F.col("kind") == "person", "name").otherwise(F.col("kind"))
    found = told.join(stand, ["kind", "a", "b"], "left_semi").select(F.col("event_key").alias("event_id"), kind.alias("pii_type"))
    decided = kept.select(F.col("event_key").alias("event_id"), F.explode("types").alias("pii_type"))
    return found.unionByName(decided).distinct()


def _replace(text: str | None, stand: dict, common: frozenset, family: frozenset) -> str | None:
    """Of overlapping names those go first of which both terms disclose, of these the longer."""
    if not text:
        return text
    clean = readable(text)
    titled, formed, persons = proposals(clean, common, family)
    spans = [(a, b, kind) for a, b, *key in formed if tuple(key) in stand for kind in (key[0],)] + [(a, b, "name") for a, b in titled]
    for a, b, *key in sorted(persons, key=lambda c: (not stand.get(c[2:], False), c[0], c[0] - c[1])):
        if tuple(key) in stand and all(b <= x or y <= a for x, y, _ in spans):
            spans.append((a, b, "name"))
    from_here = origins(text, clean)
    out, at = [], 0
    for a, b, kind in sorted(spans):
        out += [text[at : from_here(a)], f"[{kind.upper()}]"]
        at = from_here(b - 1) + 1
    return "".join([*out, text[at:]])


def sanitise(texts: DataFrame, key: str, threshold: float = THRESHOLD) -> DataFrame:
    """``texts`` (``key``, content) with each item replaced by a placeholder of its type.

    Verdicts reach each text by a join on its key, so no list of names is broadcast.
    """
    spark = texts.sparkSession
    statistics = term_statistics(texts.select("content"), threshold)
    known = ship(spark, _known(statistics, threshold))
    scan = texts.select(F.col(key).alias("event_key"), "content").mapInArrow(lambda b: _scan(*known())(b), f"event_key string, {PROPOSED}")
    scanned = materialise(scan.where("size(proposals) > 0").select("event_key", "proposals"), "scanned")
    told = scanned.select("event_key", F.explode("proposals").alias("p")).select("event_key", "p.*")
    stand = _verdicts(told.select("kind", "a", "b"), statistics, threshold)
    of_text = told.join(stand, ["kind", "a", "b"]).groupBy("event_key").agg(F.collect_set(F.struct("kind", "a", "b", "sure")).alias("stand"))  # at most what the text holds
    schema = f"{key} string, content string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known()
        for batch in batches:
            rows = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            clean = [_replace(t, {(p["kind"], p["a"], p["b"]): p["sure"] for p in n or ()}, *words) for t, n in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(clean, pa.string())], names=[key, "content"])

    return texts.select(key, "content").join(of_text.withColumnRenamed("event_key", key), key, "left").mapInArrow(run, schema)
