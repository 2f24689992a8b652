"""Functions over nested collections, as higher-order functions; a lambda is a Python function of Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Of = Callable[[Column], Column]


def contains(items: Column, value: Column) -> Column:
    return F.exists(items, lambda x: x.eqNullSafe(value))


def _any_null(values: tuple[Column, ...]) -> Column:
    out = values[0].isNull()
    for v in values[1:]:
        out = out | v.isNull()
    return out


def _booleans(values: tuple[Column, ...]) -> tuple[Column, ...]:
    """Values that are not booleans count as null. The test is on types, so the plan has it folded away."""
    return tuple(F.when(F.typeof(v) == "boolean", v.cast("boolean")) for v in values)


def any_of(*values: Column) -> Column:
    """Null if any value is, or is no boolean."""
    values = _booleans(values)
    out = values[0]
    for v in values[1:]:
        out = out | v
    return F.when(~_any_null(values), out)


def all_of(*values: Column) -> Column:
    """Null if any value is, or is no boolean."""
    values = _booleans(values)
    out = values[0]
    for v in values[1:]:
        out = out & v
    return F.when(~_any_null(values), out)


def none_of(*values: Column) -> Column:
    return ~any_of(*values)


def fold(items: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(items, start, step)


def reduce(items: Column, step: Callable[[Column, Column], Column]) -> Column:
    """A fold that starts with the first member; null for an empty collection."""
    return F.when(F.size(items) > 0, F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), F.get(items, F.lit(0)), step))


def total(items: Column, of: Of, kind: str = "double") -> Column:
    """Sum; 0 for an empty collection, null members are skipped."""
    return F.aggregate(items, F.lit(0).cast(kind), lambda a, x: a + F.coalesce(of(x).cast(kind), F.lit(0).cast(kind)))


def _extreme(items: Column, of: Of, kind: str, pick: Callable, both: Callable) -> Column:
    values = F.transform(items, lambda x: of(x).cast(kind))
    zero = F.lit(0).cast(kind)
    found = F.coalesce(pick(values), zero)
    return F.when(F.get(values, F.lit(0)).isNull() & (F.size(values) > 0), both(found, zero)).otherwise(found)


def greatest(items: Column, of: Of, kind: str = "double") -> Column:
    """0 for an empty collection; a null first member counts as 0."""
    return _extreme(items, of, kind, F.array_max, F.greatest)


def least(items: Column, of: Of, kind: str = "double") -> Column:
    return _extreme(items, of, kind, F.array_min, F.least)


def filter_all(items: Column, keep: Of) -> Column:
    """The members that keep is true for; null if it is null for any."""
    return F.when(~F.exists(items, lambda x: keep(x).isNull()), F.filter(items, keep))


def single(items: Column, keep: Of) -> Column:
    """The one member that keep is true for; null if there are none or several."""
    found = F.filter(items, keep)
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def single_by(items: Column, key: Of, value: Column) -> Column:
    return single(items, lambda x: key(x).eqNullSafe(value))


def first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def last(items: Column) -> Column:
    return F.get(items, F.size(items) - 1)


def get_at_index(items: Column, index: Column) -> Column:
    """0-based; null out of bounds. A numeric string is an index too."""
    return F.get(items, index.try_cast("int"))


def equals(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def convert(item: Column, fields: dict[str, str]) -> Column:
    """The same facts as another type: output field -> field of item."""
    return F.struct(*[item.getField(source).alias(name) for name, source in fields.items()])


def flatten(items: Column) -> Column:
    return F.flatten(items)


def hoist(items: Column, field: str) -> Column:
    """A field of every member."""
    return F.transform(items, lambda x: x.getField(field))
