"""String functions. Unless said otherwise a null argument gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def concat(*parts: Column) -> Column:
    """Skips nulls."""
    return F.concat_ws("", *[p.cast("string") for p in parts])


def trim(s: Column) -> Column:
    """White space of any kind at both ends."""
    return F.regexp_replace(s, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def left(s: Column, n: Column) -> Column:
    """The first n characters, all of them if there are fewer; null for a negative n."""
    return F.when(n >= 0, F.substring(s, F.lit(1), n))


def right(s: Column, start: Column) -> Column:
    """From the 0-based index start to the end; null out of bounds."""
    return F.when((start >= 0) & (start <= F.length(s)), F.substring(s, start + 1, F.length(s)))


def mid(s: Column, start: Column, end: Column) -> Column:
    """From start to before end, 0-based; null out of bounds."""
    return F.when((start >= 0) & (end >= start) & (end <= F.length(s)), F.substring(s, start + 1, end - start))


def upper_case(s: Column) -> Column:
    return F.upper(s)


def lower_case(s: Column) -> Column:
    return F.lower(s)


def length(s: Column) -> Column:
    return F.length(s)


def index_of(s: Column, sought: Column) -> Column:
    """0-based; -1 if absent."""
    return F.position(sought, s) - 1


def contains_string(s: Column, sought: Column) -> Column:
    return F.contains(s, sought)


def coalesce(*parts: Column) -> Column:
    return F.coalesce(*parts)


def replace(s: Column, old: Column, new: Column) -> Column:
    """Literal, not a pattern."""
    return F.replace(s, old, new)
