"""ISO 8601 instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A date, a time to the minute at least, and an offset: without an offset a text names no instant.
ISO = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?([Zz]|[+-]\d{2}(:?\d{2})?)$"


def instant(text: Column) -> Column:
    """The instant, to the microsecond, or null where the text names none."""
    plain = F.upper(F.trim(text))
    plain = F.regexp_replace(plain, r"^(\d{4}-\d{2}-\d{2}) ", "$1T")
    plain = F.regexp_replace(plain, ",", ".")
    plain = F.regexp_replace(plain, r"([+-]\d{2})(\d{2})$", "$1:$2")
    plain = F.regexp_replace(plain, r"(T[^+-]*[+-]\d{2})$", "$1:00")
    plain = F.regexp_replace(plain, r"(\.\d{6})\d+", "$1")
    plain = F.regexp_replace(plain, r"(T\d{2}:\d{2})(Z|[+-])", "$1:00$2")
    return F.when(F.trim(text).rlike(ISO), F.try_to_timestamp(plain))


def micros(at: Column) -> Column:
    return F.unix_micros(at)
