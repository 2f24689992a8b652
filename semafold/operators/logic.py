"""Operators with the engine's null rules, as Column expressions that stay inside code generation.

Equality takes two nulls as equal. Ordered comparison with a null is false. `and_` and `or_` look at the left side
first: where it settles the answer the right side may be null, otherwise any null gives null. Arithmetic that fails
(overflow, division by zero) gives null instead of an error; a Double divided by zero follows IEEE 754.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def eq(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def ne(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def gt(a: Column, b: Column) -> Column:
    return F.coalesce(a > b, F.lit(False))


def ge(a: Column, b: Column) -> Column:
    return F.coalesce(a >= b, F.lit(False))


def lt(a: Column, b: Column) -> Column:
    return F.coalesce(a < b, F.lit(False))


def le(a: Column, b: Column) -> Column:
    return F.coalesce(a <= b, F.lit(False))


def and_(a: Column, b: Column) -> Column:
    return F.when(~a, F.lit(False)).when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).otherwise(a & b)


def or_(a: Column, b: Column) -> Column:
    return F.when(a, F.lit(True)).when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).otherwise(a | b)


def add(a: Column, b: Column) -> Column:
    return F.try_add(a, b)


def subtract(a: Column, b: Column) -> Column:
    return F.try_subtract(a, b)


def multiply(a: Column, b: Column) -> Column:
    return F.try_multiply(a, b)


def divide(a: Column, b: Column) -> Column:
    """Of whole or decimal numbers: null where b is 0. Cast to decimal(20,6) first where HALF_UP decimals are wanted."""
    return F.try_divide(a, b)


def divide_doubles(a: Column, b: Column) -> Column:
    infinite = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, F.when(a.isNotNull(), infinite)).otherwise(F.try_divide(a, b))


def concatenate(a: Column, b: Column) -> Column:
    """`+` on strings: null if either is."""
    return F.concat(a, b)


def date_plus_time(date: Column, time: Column) -> Column:
    """An instant in UTC from a date and an ISO time of day."""
    return F.try_to_timestamp(F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit(" "), time, F.lit(" UTC")), F.lit("yyyy-MM-dd HH:mm:ss z"))


def elvis(a: Column, b: Column) -> Column:
    return F.coalesce(a, b)


def compare(frame: DataFrame, op: str, a: Column, b: Column) -> Column:
    """A comparison of values whose kinds may differ: int and decimal meet as decimals, any other mix has no answer (null).
    With a null on either side only equality looks at it; every other test is then false."""
    left, right = (f.dataType.simpleString().split("(")[0] for f in frame.select(a.alias("a"), b.alias("b")).schema)
    if left == right or {left, right} == {"int", "decimal"}:
        return COMPARE[op](a, b)
    both = a.isNull() & b.isNull()
    on_null = {"==": both, "!=": ~both}.get(op, F.lit(False))
    return F.when(a.isNull() | b.isNull(), on_null)


COMPARE = {"==": eq, "!=": ne, ">": gt, ">=": ge, "<": lt, "<=": le}


def when_value(selector: Column, cases: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """The first case that equals the selector; without one, otherwise, or null."""
    return when_condition([(eq(selector, value), result) for value, result in cases], otherwise)


def when_condition(cases: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """The first case whose condition is true; a null condition counts as false."""
    out = None
    for test, result in cases:
        out = F.when(test, result) if out is None else out.when(test, result)
    return out if otherwise is None else out.otherwise(otherwise)


def when_fields(test: Column, then: dict[str, Column], otherwise: dict[str, Column]) -> Column:
    """Several fields set by one condition, as a struct."""
    return F.when(test, F.struct(*[c.alias(k) for k, c in then.items()])).otherwise(F.struct(*[c.alias(k) for k, c in otherwise.items()]))
