"""Rebuilding conversations from message rows (problem 1).

The kept copies of a session's messages form a reply graph: a message follows the one before it in ``seq_id`` order,
the assistant rows of a turn reply to all user rows of that turn, and a turn follows the turn that began before it.
Kahn's algorithm sorts the graph, ties broken by time. Messages that are left over lie on cycles: a turn resumed after
another one, or an answer before its question. A session without left-over messages is sound if every turn has a
question and a reply.

Every session takes the same way, whatever its size. Its messages are numbered in ``seq_id`` order (``numbered``: range
partitions and offsets) and cut into segments of ``SEGMENT`` messages; Kahn's algorithm sorts each segment in the task
that holds it. Between segments the chain of ``seq_id`` is all there is, so a cycle over a cut is a turn that comes back
after another turn, or asks again after an answer, across it: the segments give what they hold of each turn, and the
turn's first and last number tell. No task holds more than a segment, and no session is judged by another rule.

Defined results: messages without a session are left out; a session without a counting row is ``empty``; a null
``seq_id`` gives ``missing_seq``, a repeated one ``repeated_seq``; a null ``turn_id`` is a turn of its own; an empty
table gives no session; long texts are only tested for a visible character.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.instants import instant, micros
from threadloom.functions.text import fold, has_visible
from threadloom.operators.delivery import kept_copies
from threadloom.operators.numbering import numbered
from threadloom.session import materialise

#: Messages that Kahn's algorithm sorts at a time.
SEGMENT = 10_000


def session_rows(deliveries: DataFrame) -> DataFrame:
    """Kept copies with a session: session_id, turn_id, seq_id, role, counts, sent_at, event_id (no content)."""
    role = fold(F.col("role"))
    counts = F.coalesce(role.isin("user", "assistant"), F.lit(False)) & has_visible(F.col("content"))
    kept = kept_copies(deliveries, F.col("session_id"), F.col("turn_id"), F.col("seq_id"), role.alias("role"), counts.alias("counts"), micros(instant(F.col("timestamp"))).alias("sent_at"))
    return kept.where("session_id IS NOT NULL").select("session_id", "turn_id", "seq_id", "role", "counts", "sent_at", F.col("event_key").alias("event_id"))


def kahn(rows: list[tuple]) -> list[int]:
    """The order of ``rows`` (seq, turn, is_user, sent_at), as far as it goes: what is missing lies on or behind a cycle.

    Nodes beyond the rows are barriers, which keep the number of edges in proportion to the rows.
    """
    n = len(rows)
    by_seq = sorted(range(n), key=lambda i: rows[i][0])
    turns: dict = {}
    for i in by_seq:
        turns.setdefault(rows[i][1], []).append(i)
    out: list[list[int]] = [[] for _ in range(n + 2 * len(turns) + n)]
    into = [0] * len(out)

    def edge(a: int, b: int) -> None:
        out[a].append(b)
        into[b] += 1

    at = n + 2 * len(turns)
    start = 0
    while start < n:  # messages of one seq_id are not ordered among themselves: time decides
        end = start
        while end < n and rows[by_seq[end]][0] == rows[by_seq[start]][0]:
            end += 1
        if end < n:
            for i in by_seq[start:end]:
                edge(i, at)
            nxt, value = end, rows[by_seq[end]][0]
            while nxt < n and rows[by_seq[nxt]][0] == value:
                edge(at, by_seq[nxt])
                nxt += 1
            at += 1
        start = end
    before: int | None = None
    for k, members in enumerate(turns.values()):
        reply, done = n + 2 * k, n + 2 * k + 1
        for i in members:
            edge(i, reply) if rows[i][2] else edge(reply, i)
            edge(i, done)
            if before is not None:
                edge(before, i)
        before = done
    used = [False] * len(out)
    for a, targets in enumerate(out):
        if targets:
            used[a] = True
            for b in targets:
                used[b] = True
    key = lambda i: (rows[i][3], rows[i][0] or 0, i) if i < n else (-1, 0, i)
    heap = [(*key(i), i) for i in range(len(out)) if not into[i] and (i < n or used[i])]
    heapq.heapify(heap)
    order = []
    while heap:
        node = heapq.heappop(heap)[-1]
        if node < n:
            order.append(node)
        for b in out[node]:
            into[b] -= 1
            if not into[b]:
                heapq.heappush(heap, (*key(b), b))
    return order


SEGMENTS = (
    "session_id string, segment bigint, messages bigint, missing bigint, repeated bigint, left bigint, first_seq bigint, last_seq bigint, "
    "turn_id string, n bigint, asked bigint, first bigint, last bigint, last_asked bigint, first_answer bigint"
)
_SEGMENT_TYPES = [pa.string(), *[pa.int64()] * 7, pa.string(), *[pa.int64()] * 6]


def _segment(session: str, number: int, rows: list[tuple], out: list[tuple]) -> None:
    """What a segment's rows (seq, turn, is_user, sent_at, position) tell: one row a turn, the first with the sums."""
    seqs = [r[0] for r in rows if r[0] is not None]
    repeated = len(seqs) - len(set(seqs))
    missing = len(rows) - len(seqs)
    left = 0 if missing or repeated else len(rows) - len(kahn([r[:4] for r in rows]))
    turns: dict = {}
    for _, turn, is_user, _, at in rows:
        t = turns.get(turn)
        if t is None:
            t = turns[turn] = [0, 0, at, at, None, None]
        t[0] += 1
        t[3] = at
        if is_user:
            t[1] += 1
            t[4] = at
        elif t[5] is None:
            t[5] = at
    head = (len(rows), missing, repeated, left, seqs[0] if seqs else None, seqs[-1] if seqs else None)
    for turn, t in turns.items():
        out.append((session, number, *head, turn, *t))
        head = (0, 0, 0, 0, None, None)


def _judge_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams through a partition that is sorted by session, segment and position; holds one segment at a time."""
    pack = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _SEGMENT_TYPES, strict=True)], names=[f.split()[0] for f in SEGMENTS.split(", ")])
    current, rows, out = None, [], []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for session, number, seq, turn, role, sent, at in zip(*columns, strict=True):
            if (session, number) != current:
                if current is not None:
                    _segment(*current, rows, out)
                current, rows = (session, number), []
            rows.append((seq, turn, role == "user", sent if sent is not None else 1 << 62, at))
        if len(out) > 10_000:
            yield pack(out)
            out = []
    if current is not None:
        _segment(*current, rows, out)
    if out:
        yield pack(out)


def _numbered(deliveries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of all sessions, and the counting ones with their ``position`` in the session."""
    rows = materialise(session_rows(deliveries), "sessions")
    counting = rows.where("counts").select("session_id", "turn_id", "seq_id", "role", "event_id", "sent_at")
    return rows, materialise(numbered(counting, "session_id", ["seq_id", "sent_at", "event_id"], "position", 0), "numbered")


def _judged(rows: DataFrame, counting: DataFrame, segment: int) -> DataFrame:
    cut = counting.select("session_id", F.expr(f"position DIV {segment}").alias("segment"), "seq_id", "turn_id", "role", "sent_at", "position")
    held = cut.repartition("session_id", "segment").sortWithinPartitions("session_id", "segment", "position").mapInArrow(_judge_segments, SEGMENTS)
    told = materialise(held, "segments")
    turns = told.groupBy("session_id", "turn_id").agg(
        F.sum("n").alias("n"), F.sum("asked").alias("asked"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("last_asked").alias("last_asked"), F.min("first_answer").alias("first_answer"),
        F.sum("messages").alias("messages"), F.sum("missing").alias("missing"), F.sum("repeated").alias("repeated"), F.sum("left").alias("left"),
    )
    over_cut = (F.col("last") - F.col("first") + 1 != F.col("n")) | F.coalesce(F.col("last_asked") > F.col("first_answer"), F.lit(False))
    lacking = (F.col("asked") == 0) | (F.col("asked") == F.col("n"))
    judged = turns.groupBy("session_id").agg(*[F.sum(c).alias(c) for c in ("messages", "missing", "repeated", "left")], F.bool_or(over_cut).alias("over_cut"), F.bool_or(lacking).alias("lacking"))
    before = Window.partitionBy("session_id").orderBy("segment")
    at_cut = told.where("messages > 0 AND first_seq IS NOT NULL").select("session_id", "segment", "first_seq", F.lag("last_seq").over(before).alias("before"))
    same = at_cut.where("first_seq = before").select("session_id").distinct().withColumn("at_cut", F.lit(True))
    all_of = rows.select("session_id").distinct().join(judged, "session_id", "left").join(same, "session_id", "left")
    reason = (
        F.when(F.col("messages").isNull(), "empty").when(F.col("missing") > 0, "missing_seq").when((F.col("repeated") > 0) | F.col("at_cut"), "repeated_seq")
        .when((F.col("left") > 0) | F.col("over_cut"), "cycle").when(F.col("lacking"), "incomplete")
    )
    return all_of.select("session_id", reason.alias("reason"), F.coalesce("messages", F.lit(0)).alias("messages"))


def verdicts(deliveries: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Every session with the reason to leave it out (null: sound) and its number of counting messages."""
    return _judged(*_numbered(deliveries), segment)


def conversations(deliveries: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The messages of the sound sessions in order, from position 0."""
    rows, counting = _numbered(deliveries)
    sound = _judged(rows, counting, segment).where("reason IS NULL").select("session_id")
    return counting.join(sound, "session_id", "left_semi").select("session_id", "position", "turn_id", "seq_id", "role", "event_id")
