"""Sensitivity of text: detectors of secrets and of personal data, levels, and redaction of secrets.

A word boundary of the detectors is one of ASCII letters, digits and underscore, so it also stands between a Latin and a
Chinese character; Java's own would not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.text import SPACE

_B, _E = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: Names and patterns of the detectors, in the order in which they are reported and redacted.
SECRETS = {
    "private_key": "(?i)-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----",
    "credential_assignment": f"(?i){_B}(?:api[_-]?key|access[_-]?token|auth[_-]?token|password|passwd|secret){_E}[{SPACE}]*[:=][{SPACE}]*[\"']?[^{SPACE}\"']{{6,}}",
    "bearer_token": f"(?i){_B}Bearer[{SPACE}]+[A-Za-z0-9._~+/=-]{{12,}}",
    "jwt": f"{_B}eyJ[A-Za-z0-9_-]{{8,}}\\.[A-Za-z0-9_-]{{8,}}\\.[A-Za-z0-9_-]{{8,}}(?:(?<=[A-Za-z0-9_]){_E}|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))",
    "github_token": f"{_B}(?:ghp|github_pat)_[A-Za-z0-9_]{{20,}}{_E}",
    "openai_key": f"{_B}sk-[A-Za-z0-9_-]{{20,}}(?:(?<=[A-Za-z0-9_]){_E}|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))",
}
SENSITIVE = {
    "email": f"(?i)(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{{2,}}{_E}",
    "phone": "(?<![0-9])(?:\\+?86[- ]?)?1[3-9][0-9]{9}(?![0-9])",
    "address_hint": f"(?i)(?:住址|家庭地址|home address)[{SPACE}]*[:：]",
}
LEVELS = ("normal", "sensitive", "secret")


def _named(text: Column, patterns: dict[str, str]) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p in patterns.items())))


def detectors(text: Column) -> Column:
    """Names of the secret detectors that fire, or else of the others."""
    secrets = _named(text, SECRETS)
    return F.when(F.size(secrets) > 0, secrets).otherwise(_named(text, SENSITIVE))


def level(text: Column) -> Column:
    """``secret``, ``sensitive`` or ``normal``; null text is normal."""
    any_of = lambda patterns: reduce(lambda a, b: a | b, (F.coalesce(text.rlike(p), F.lit(False)) for p in patterns.values()))
    return F.when(any_of(SECRETS), "secret").when(any_of(SENSITIVE), "sensitive").otherwise("normal")


def redact(text: Column) -> Column:
    """Every secret replaced by a marker with its detector's name."""
    return reduce(lambda t, item: F.regexp_replace(t, item[1], f"[REDACTED:{item[0]}]"), SECRETS.items(), text)


def strongest(*levels: Column) -> Column:
    """The strongest of some levels, null being the weakest."""
    ranks = [F.coalesce(F.array_position(F.array(*map(F.lit, LEVELS)), v), F.lit(0)) for v in levels]
    return F.element_at(F.array(*map(F.lit, LEVELS)), F.greatest(F.lit(1).cast("bigint"), *ranks).cast("int"))
