"""Joins as enrichment asks for them: rows stay, the first match answers, the key says which lookup may be used.

No join forces a broadcast: the optimizer takes one below its size threshold, measured again at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_per_key(right: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a stated order, by an aggregate that is combined before it is shuffled by the join's own key."""
    rest = [c for c in right.columns if c not in keys]
    return right.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")).select(*keys, *[F.col("_first")[c].alias(c) for c in rest])


def lookup(left: DataFrame, right: DataFrame, on: dict[str, str], order: list[str] | None = None) -> DataFrame:
    """left with the columns of the first match in right (left column -> right column); unmatched rows keep nulls.
    Without an order, right is known to have one row a key."""
    keys = list(on.values())
    side = one_per_key(right, keys, order) if order else right
    renamed = side.withColumnsRenamed({r: f"_key_{r}" for r in keys})
    test = [left[a] == renamed[f"_key_{b}"] for a, b in on.items()]
    return left.join(renamed, test, "left").drop(*[f"_key_{r}" for r in keys])


def lookup_each(left: DataFrame, ids: str, right: DataFrame, key: str, id_col: str, out: str) -> DataFrame:
    """For an array of ids, the array of what they are keys of, in the array's order; unmatched ids are left out."""
    each = left.select(F.col(id_col), F.posexplode(ids).alias("_at", "_id"))
    found = each.join(right, each["_id"] == right[key]).groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("_at", F.struct(*right.columns).alias("row")))).alias("_rows"))
    joined = left.join(found, id_col, "left")
    return joined.withColumn(out, F.coalesce(F.transform("_rows", lambda x: x["row"]), F.expr("array()").cast(f"array<{right.schema.simpleString()}>"))).drop("_rows")


def members_of(right: DataFrame, key: str, left: DataFrame, ids: Column) -> DataFrame:
    """Rows of right whose key is among the ids of any row of left."""
    asked = left.select(F.explode(ids).alias("_id")).distinct()
    return right.join(asked, right[key] == asked["_id"], "left_semi")


def nest(children: DataFrame, key: str, fields: list[str], out: str) -> DataFrame:
    """A row a key with its children as a sorted array of structs: the collection form of a one-to-many link."""
    return children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(out))


def fallback(*candidates: Column) -> Column:
    """The first candidate that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c.cast("string")) != "", c) for c in candidates])


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """All rows of all sources; columns that a source lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
