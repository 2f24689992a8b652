"""Access policies, applied as projections where a source is read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK = "******"


@dataclass(frozen=True)
class RuleSet:
    """What a policy does to rows, and when: the kind of operation ("*" is any) and whether rows are read inside or go out."""

    operation: str
    scope: str
    apply: Callable[[DataFrame], DataFrame]


def select(rule_sets: list[RuleSet], operation: str, scope: str) -> RuleSet:
    """The rule set that fits best: a point for the operation, a point for the scope; of equal ones the last."""
    if not rule_sets:
        raise ValueError("no rule sets")
    points = [(r.operation in ("*", operation)) + (r.scope == scope) for r in rule_sets]
    return rule_sets[max(range(len(points)), key=lambda i: (points[i], i))]


def permit(df: DataFrame) -> DataFrame:
    return df


def filter_fields(df: DataFrame, fields: list[str], unless: Column | None = None) -> DataFrame:
    """Listed fields are null wherever `unless` isn't true."""
    hidden = {f: F.lit(None).cast(df.schema[f].dataType) for f in fields}
    return df.withColumns({f: h if unless is None else F.when(unless, df[f]).otherwise(h) for f, h in hidden.items()})


def filter_all(df: DataFrame, unless: Column | None = None) -> DataFrame:
    return filter_fields(df, df.columns, unless)


def mask(df: DataFrame, fields: list[str], unless: Column | None = None) -> DataFrame:
    return df.withColumns({f: F.lit(MASK) if unless is None else F.when(unless, df[f]).otherwise(F.lit(MASK)) for f in fields})
