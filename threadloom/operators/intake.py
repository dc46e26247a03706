"""What happens to messages before they become records: controls, opt-outs, repeats of requests, recovery, run history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.decisions import explicit_request
from threadloom.functions.instants import instant, micros
from threadloom.functions.text import has_visible, normalize_text

#: What a user says who does not want a message kept, and the agents whose hooks capture by themselves.
OPT_OUT = "不要记|不要保存|don't save|do not save"
HOOK_AGENTS = ("claude-code", "codex")
#: Commands that switch capture off and on for a session; the host's own are passed in.
COMMANDS = {"off": ("/capture off", "capture off"), "on": ("/capture on", "capture on")}


def session_token(agent: Column, session: Column) -> Column:
    """What a session is known by in controls; null without a session."""
    return F.when(has_visible(session), F.sha2(F.concat(agent, F.lit("\0"), session), 256))


def safe_id(value: Column) -> Column:
    """An identifier that may stand in a path: the value itself where it may, else a hash of it."""
    return F.when(value.rlike("^[a-zA-Z0-9][a-zA-Z0-9._-]{0,127}$"), value).otherwise(F.concat(F.lit("id_"), F.substring(F.sha2(value, 256), 1, 20)))


def command(content: Column, commands: dict[str, tuple[str, ...]] = COMMANDS) -> Column:
    """``off`` or ``on`` where the whole message is such a command, else null."""
    said = F.lower(normalize_text(content))
    out = F.lit(None).cast("string")
    for name, texts in commands.items():
        out = F.when(said.isin(*texts), name).otherwise(out)
    return out


def skipped(events: DataFrame, commands: dict[str, tuple[str, ...]] = COMMANDS, paused: bool = False) -> DataFrame:
    """``events`` (role, content) with ``skipped``: why a message is not captured, or null. The first rule that applies."""
    said = F.when(F.col("role") == "user", command(F.col("content"), commands))
    reason = F.when(said.isNotNull(), F.concat(F.lit("session_"), said)).when(~has_visible(F.col("content")), "unsupported_or_empty")
    reason = reason.when((F.col("role") == "user") & F.col("content").rlike(f"(?i)(?:{OPT_OUT})"), "user_opt_out")
    return events.withColumn("skipped", reason.when(F.lit(paused), "paused"))


def switched_off(events: DataFrame, commands: dict[str, tuple[str, ...]] = COMMANDS) -> DataFrame:
    """``events`` (event_key, token, seq_id, role, content) of sessions while their capture was off, commands included.

    Commands alone make the intervals; an event is looked up in those of its session, so a long session is not gathered.
    """
    at = F.struct("seq_id", "event_key")
    said = events.where((F.col("role") == "user") & F.col("token").isNotNull() & F.col("seq_id").isNotNull()).select("token", at.alias("at"), command(F.col("content"), commands).alias("said")).where("said IS NOT NULL")
    after = Window.partitionBy("token").orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    spans = said.withColumn("until", F.min(F.when(F.col("said") == "on", F.col("at"))).over(after)).where("said = 'off'").select("token", F.col("at").alias("since"), "until")
    rows = events.withColumn("at", at)
    inside = (rows["token"] == spans["token"]) & (F.col("at") >= F.col("since")) & (F.col("until").isNull() | (F.col("at") <= F.col("until")))
    return rows.join(spans, inside, "left_semi").drop("at")


def recent_equivalents(events: DataFrame, minutes: int = 5, least: int = 8) -> DataFrame:
    """(event_key, owner_key): of each message the latest explicit request in its project, by the same role, of at most
    ``minutes`` before, of which one says all the other says.

    ``events`` (event_key, project_id, role, source_agent, seq_id, timestamp, content, sound). Messages meet in slices of
    time, so a project with many messages is divided.
    """
    text = F.lower(normalize_text(F.col("content")))
    span = minutes * 60_000_000
    rows = events.select("event_key", "project_id", "role", "seq_id", "source_agent", "timestamp", "content", "sound", text.alias("text"), micros(instant(F.col("timestamp"))).alias("at")).where("at IS NOT NULL")
    asked = rows.where(F.col("sound") & F.col("source_agent").isin(*HOOK_AGENTS) & explicit_request(F.col("content")))
    slices = F.explode(F.array(F.floor(F.col("at") / span), F.floor(F.col("at") / span) + 1))
    owners = asked.select("project_id", "role", slices.alias("slice"), F.col("event_key").alias("owner_key"), F.col("text").alias("owner_text"), F.col("at").alias("owner_at"), F.struct("timestamp", "seq_id", "event_key").alias("order"))
    new = rows.where(F.length("text") >= least).select("project_id", "role", F.floor(F.col("at") / span).alias("slice"), "event_key", "text", "at")
    near = (F.col("at") - F.col("owner_at")).between(0, span) & (F.col("event_key") != F.col("owner_key"))
    same = F.col("text").contains(F.col("owner_text")) | F.col("owner_text").contains(F.col("text"))
    found = new.join(owners, ["project_id", "role", "slice"]).where(near & same)
    return found.groupBy("event_key").agg(F.max_by("owner_key", "order").alias("owner_key"))


def recovered(staged: DataFrame, sequences: DataFrame) -> DataFrame:
    """Replays staged captures (event_key, project_id, sequence): per project how many there are and the sequence after,
    which only moves forward. Staging a capture twice replays it once."""
    once = staged.groupBy("project_id", "event_key").agg(F.max("sequence").alias("sequence"))
    sums = once.groupBy("project_id").agg(F.count("*").alias("recovered"), F.max("sequence").alias("staged"))
    joined = sums.join(sequences.select("project_id", F.col("sequence").alias("current")), "project_id", "left")
    return joined.select("project_id", "recovered", F.greatest("staged", F.coalesce("current", F.lit(0))).alias("sequence"))


def run_history(runs: DataFrame, hours: int = 24) -> DataFrame:
    """Of each project's runs (project_id, at) those of the ``hours`` before its last one."""
    last = runs.groupBy("project_id").agg(F.max("at").alias("last"))
    return runs.join(last, "project_id").where(F.col("at") >= F.col("last") - F.make_dt_interval(hours=F.lit(hours))).select("project_id", "at")


def projects(events: DataFrame) -> DataFrame:
    """All projects by when they were last seen, latest first."""
    seen = events.where("project_id IS NOT NULL").groupBy("project_id").agg(F.max("received_at").alias("last_seen"), F.countDistinct("session_id").alias("sessions"))
    return seen.orderBy(F.desc("last_seen"), "project_id")
