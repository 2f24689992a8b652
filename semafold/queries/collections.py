"""Functions over the line items of each order, and over embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semafold.functions import collections as c
from semafold.plans.tables import orders_with_items, table
from semafold.queries import registered

QUERIES, SQL, query = registered()
ITEMS = "SELECT l_orderkey, list(struct_pack(l_linenumber := l_linenumber, l_quantity := l_quantity, l_discount := l_discount, l_returnflag := l_returnflag) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS items FROM lineitem GROUP BY l_orderkey"


def _of_items(name: str, column, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        held = orders_with_items(spark, d, "l_quantity", "l_discount", "l_returnflag")
        return held.select("o_orderkey", column(F.col("items")).alias("r"))

    QUERIES[name], SQL[name] = run, f"SELECT o_orderkey, {sql} AS r FROM orders LEFT JOIN ({ITEMS}) ON o_orderkey = l_orderkey"


def _big(x):
    return x["l_quantity"] > 40


_of_items("fn_contains", lambda i: c.contains(c.hoist(i, "l_returnflag"), F.lit("R")), "list_contains(list_transform(items, lambda x: x.l_returnflag), 'R')")
_of_items("fn_fold", lambda i: c.fold(i, F.lit(0.0), lambda a, x: a + x["l_quantity"] * 2), "CASE WHEN items IS NULL THEN NULL ELSE list_reduce(list_transform(items, lambda x: x.l_quantity * 2), lambda a, b: a + b, CAST(0 AS DOUBLE)) END")
_of_items("fn_sum", lambda i: c.total(i, lambda x: x["l_quantity"]), "list_sum(list_transform(items, lambda x: x.l_quantity))")
_of_items("fn_max", lambda i: c.greatest(i, lambda x: x["l_quantity"]), "coalesce(list_max(list_transform(items, lambda x: x.l_quantity)), 0)")
_of_items("fn_min", lambda i: c.least(i, lambda x: x["l_quantity"]), "coalesce(list_min(list_transform(items, lambda x: x.l_quantity)), 0)")
_of_items("fn_filter_all", lambda i: c.hoist(c.filter_all(i, _big), "l_linenumber"), "list_transform(list_filter(items, lambda x: x.l_quantity > 40), lambda x: x.l_linenumber)")
_of_items("fn_single", lambda i: c.single(i, _big)["l_linenumber"], "CASE WHEN len(list_filter(items, lambda x: x.l_quantity > 40)) = 1 THEN list_filter(items, lambda x: x.l_quantity > 40)[1].l_linenumber END")
_of_items("fn_single_by", lambda i: c.single_by(i, lambda x: x["l_returnflag"], F.lit("A"))["l_quantity"], "CASE WHEN len(list_filter(items, lambda x: x.l_returnflag = 'A')) = 1 THEN list_filter(items, lambda x: x.l_returnflag = 'A')[1].l_quantity END")
_of_items("fn_first", lambda i: c.first(i)["l_quantity"], "items[1].l_quantity")
_of_items("fn_last", lambda i: c.last(i)["l_quantity"], "items[-1].l_quantity")
_of_items("fn_get_at_index", lambda i: c.get_at_index(i, F.lit("2"))["l_quantity"], "items[3].l_quantity")
_of_items("fn_any_of", lambda i: c.any_of(F.size(i) > 3, F.exists(i, _big)), "len(items) > 3 OR len(list_filter(items, lambda x: x.l_quantity > 40)) > 0")
_of_items("fn_all_of", lambda i: c.all_of(F.size(i) > 3, F.exists(i, _big)), "len(items) > 3 AND len(list_filter(items, lambda x: x.l_quantity > 40)) > 0")
_of_items("fn_none_of", lambda i: c.none_of(F.size(i) > 3, F.exists(i, _big)), "NOT (len(items) > 3 OR len(list_filter(items, lambda x: x.l_quantity > 40)) > 0)")
_of_items("fn_equals", lambda i: c.equals(c.first(i)["l_returnflag"], c.last(i)["l_returnflag"]), "items[1].l_returnflag IS NOT DISTINCT FROM items[-1].l_returnflag")
_of_items("fn_convert", lambda i: c.convert(c.first(i), {"line": "l_linenumber", "flag": "l_returnflag"}), "struct_pack(line := items[1].l_linenumber, flag := items[1].l_returnflag)")
_of_items("expr_as", lambda i: F.transform(c.filter_all(i, _big), lambda x: F.struct(x["l_linenumber"].alias("line"))), "list_transform(list_filter(items, lambda x: x.l_quantity > 40), lambda x: struct_pack(line := x.l_linenumber))")
_of_items("fn_reduce", lambda i: c.reduce(c.hoist(i, "l_quantity"), lambda a, b: F.greatest(a, b)), "list_max(list_transform(items, lambda x: x.l_quantity))")
_of_items("agg_nested_sum", lambda i: c.total(i, lambda x: x["l_quantity"] * (1 - x["l_discount"])), "list_reduce(list_transform(items, lambda x: x.l_quantity * (1 - x.l_discount)), lambda a, b: a + b, CAST(0 AS DOUBLE))")
_of_items(
    "agg_weighted_average",
    lambda i: F.try_divide(c.total(i, lambda x: x["l_quantity"] * x["l_discount"]), c.total(i, lambda x: x["l_quantity"])),
    "list_reduce(list_transform(items, lambda x: x.l_quantity * x.l_discount), lambda a, b: a + b, CAST(0 AS DOUBLE)) / list_reduce(list_transform(items, lambda x: x.l_quantity), lambda a, b: a + b, CAST(0 AS DOUBLE))",
)
_of_items("distinct_facts", lambda i: F.array_sort(F.array_distinct(c.hoist(i, "l_returnflag"))), "list_sort(list_distinct(list_transform(items, lambda x: x.l_returnflag)))")


@query("SELECT vec_id, list_concat(embedding[1:2], embedding[3:4]) AS r FROM embeddings")
def flatten_array(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.array(F.slice("embedding", 1, 2), F.slice("embedding", 3, 2))
    return table(spark, d, "embeddings").select("vec_id", c.flatten(pairs).alias("r"))
