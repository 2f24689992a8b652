"""Values from text: lenient numbers and instants, enums and their synonyms, and instants back to text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(s: Column, kind: str = "double") -> Column:
    """Grouping commas and exponents are understood; an empty or other text is null."""
    return F.regexp_replace(s, ",", "").try_cast(kind)


def instant(s: Column, patterns: list[str]) -> Column:
    """The first of the patterns that fits, then ISO; zone-less texts are UTC."""
    utc = F.concat(s, F.lit(" +0000"))  # whatever the session's zone is
    iso = [F.concat(s, F.lit("Z")).try_cast("timestamp"), s.try_cast("timestamp")]
    return F.coalesce(*[F.try_to_timestamp(utc, F.lit(f"{p} xx")) for p in patterns], *iso)


def instant_from_millis(n: Column) -> Column:
    return F.timestamp_millis(n)


def _lookup(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def enum(s: Column, values: dict[str, str]) -> Column:
    """The enum's name for a name or a value (values: name -> value); null for any other text. A boolean is its text."""
    text = s.cast("string")
    return _lookup({v: k for k, v in values.items()} | {k: k for k in values})[text]


def synonym(name: Column, synonyms: dict[str, str]) -> Column:
    """A name of one enum as its synonym in another."""
    return _lookup(synonyms)[name]


def formatted(ts: Column, pattern: str, zone: str = "UTC") -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), pattern)
