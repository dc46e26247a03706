"""What a message decides: kind, topic and aliases, by keywords in two languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.text import utf16_slice

#: The first kind whose keywords occur is the kind of a message.
KINDS = {
    "correction": "不是这个意思|这条不对|纠正|correct(?:ion)?",
    "rejection": "拒绝|不做|暂缓|否决|defer|reject",
    "proposal": "提案|建议|proposal|propose|suggest",
    "idea": "想法|灵感|idea",
    "preference": "偏好|更喜欢|preference|prefer",
    "todo": "待办|要做|todo|to-do",
    "decision": "决定|选择|采用|decision|decided|choose|chosen|adopt",
    "current_state": "当前|现在|目前|current|currently",
    "constraint": "约束|限制|必须|不能|constraint|must|cannot|can't",
    "rationale": "理由|原因|因为|由于|rationale|reason|because",
}
#: Topics that keywords stand for, in order; a list means that each of its patterns must occur.
TOPICS = {
    "database-cache": ["缓存|cache", "数据库|sqlite|postgres|database|redis"],
    "database": ["数据库|sqlite|postgres|database"],
    "storage": ["存储|storage|vault|file-native"],
    "adapter": ["adapter|hook|适配器"],
}
#: Further names of a topic.
ALIASES = {"数据库|database": ("数据库", "db"), "postgres": ("postgres", "postgresql", "pg"), "sqlite": ("sqlite",)}
CURRENT = "当前|现在|目前|决定|选择|采用|current|currently|decided|choose|chosen|adopt"
EXPLICIT = "记一下|记住|保存这个|remember this"
#: What marks a statement as replacing the current one.
NOW = "当前|现在|目前|now|current"
SETTING_STATUSES = ("accepted", "rejected", "reopened", "current")
SETTING_KINDS = ("decision", "current_state", "correction", "rejection")


def has(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(f"(?i)(?:{pattern})"), F.lit(False))


def kind(text: Column) -> Column:
    """The kind, or null where nothing is decided."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(KINDS.items()):
        out = F.when(has(text, pattern), name).otherwise(out)
    return out


def topic(text: Column) -> Column:
    latin = F.regexp_extract(F.lower(text), "[a-z][a-z0-9_-]{2,}", 0)
    out = F.when(latin != "", latin).otherwise(utf16_slice(text, 32))
    for name, patterns in reversed(TOPICS.items()):
        hit = has(text, patterns[0])
        for p in patterns[1:]:
            hit = hit & has(text, p)
        out = F.when(hit, name).otherwise(out)
    return out


def aliases(text: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*(F.when(has(text, p), F.array(*map(F.lit, names))).otherwise(empty) for p, names in ALIASES.items())))


def explicit_request(text: Column) -> Column:
    return has(text, EXPLICIT)


def state_setting(source: Column, confidence: Column, status: Column, kind: Column) -> Column:
    """Whether a decision event may set its topic's state: a weak inference may not."""
    weak = (source == "agent_inferred") & (confidence < 0.75)
    return ~weak & status.isin(*SETTING_STATUSES) & kind.isin(*SETTING_KINDS)
