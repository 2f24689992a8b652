"""Implicit joins: lookups by key, in chains, by several keys, by arrays of keys, through enums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semafold.functions.coerce import synonym
from semafold.functions.collections import filter_all
from semafold.operators.joins import fallback, lookup, lookup_each, members_of, nest
from semafold.plans.catalog import Catalog, Model
from semafold.plans.tables import catalog, orders_with_items, table
from semafold.queries import registered

QUERIES, SQL, query = registered()


@query("SELECT o_orderkey AS id, c_name AS customer FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def join_lookup(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d, "orders", "customer").find("Order").project({"id": "OrderKey", "customer": "CustomerName"})


@query("SELECT l_orderkey AS id, l_linenumber AS line, p_name AS part, s_name AS supplier FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey")
def join_two_lookups(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d, "lineitem", "part", "supplier").find("LineItem").project({"id": "OrderKey", "line": "LineNumber", "part": "PartName", "supplier": "SupplierName"})


@query("SELECT o_orderkey AS id, r_name AS region FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def join_multi_hop(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d, "orders", "customer", "nation", "region").find("Order").project({"id": "OrderKey", "region": "RegionName"})


@query("SELECT c_custkey AS id, arg_min(o_orderkey, o_orderkey) AS first_order, arg_min(o_totalprice, o_orderkey) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def join_first_match(spark: SparkSession, d: str) -> DataFrame:
    """Of a customer's orders the one with the smallest key answers."""
    customers, orders = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    found = lookup(customers, orders, {"c_custkey": "o_custkey"}, order=["o_orderkey"])
    return found.select(F.col("c_custkey").alias("id"), F.col("o_orderkey").alias("first_order"), F.col("o_totalprice").alias("total"))


@query("SELECT o_orderkey AS id, CAST(NULL AS VARCHAR) AS flag FROM orders")
def join_id_only(spark: SparkSession, d: str) -> DataFrame:
    """A model without an @Id answers no lookup, though it shares the key's type."""
    return catalog(spark, d, "orders", "lineitem").find("Order").project({"id": "OrderKey", "flag": "ReturnFlag"})


@query("SELECT doc_id, coalesce(CAST(quality AS VARCHAR), lang) AS mark FROM documents LEFT JOIN labels USING (doc_id)")
def join_fallback(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    found = lookup(docs, table(spark, d, "labels").select("doc_id", "quality"), {"doc_id": "doc_id"})
    return found.select(docs["doc_id"], fallback(F.col("quality").cast("string"), F.col("lang")).alias("mark"))


FIRST_ITEM = "SELECT l_orderkey AS k, l_linenumber AS n, min(l_quantity) AS q FROM lineitem GROUP BY ALL"


def _next_items(spark: SparkSession, d: str) -> Catalog:
    """Items, and a lookup of quantities by order and line together."""
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    quantities = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    lookup_ = Model("Quantities", quantities, {"l_orderkey": "OrderKey", "l_linenumber": "NextLine", "l_quantity": "NextQuantity"}, ("OrderKey", "NextLine"))
    return Catalog([Model("Item", items, {"l_orderkey": "OrderKey", "l_linenumber": "Line"}), lookup_])


@query(f"SELECT l_orderkey, l_linenumber, q AS next_quantity FROM lineitem LEFT JOIN ({FIRST_ITEM}) ON l_orderkey = k AND l_linenumber + 1 = n")
def join_composite(spark: SparkSession, d: str) -> DataFrame:
    """A lookup of two parameters, planned by the catalog; one of them is computed from what is at hand, and the first match answers."""
    held = _next_items(spark, d).expression("NextLine", ("Line",), lambda line: line + 1)
    return held.find("Item").project({"l_orderkey": "OrderKey", "l_linenumber": "Line", "next_quantity": "NextQuantity"})


@query("SELECT c_custkey AS id, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey = 1")
def join_parameter_object(spark: SparkSession, d: str) -> DataFrame:
    """A lookup whose one parameter is an object, built from facts."""
    nations = table(spark, d, "nation").select(F.struct(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region")).alias("request"), "n_name")
    held = catalog(spark, d, "customer").add(Model("ByRequest", nations, {"request": "NationRequest", "n_name": "NationName"}, "NationRequest", unique=True))
    rows = held.find("Customer").given(area=("RegionKey", 1)).request("asked", "NationRequest", {"nation": "NationKey", "region": "RegionKey"})
    return rows.project({"id": "CustomerKey", "nation": "NationName"})


@query("SELECT p_partkey AS id, 'Brand ' || substr(p_brand, 7) AS label FROM part")
def join_converted_key(spark: SparkSession, d: str) -> DataFrame:
    """A lookup's parameter has another form than what is at hand: it is converted before the join."""
    brands = table(spark, d, "part").select(F.expr("substr(p_brand, 7)").alias("code")).distinct().withColumn("label", F.concat(F.lit("Brand "), "code"))
    held = catalog(spark, d, "part").add(Model("Brands", brands, {"code": "BrandCode", "label": "BrandLabel"}, "BrandCode", unique=True))
    held.expression("BrandCode", ("PartBrand",), lambda brand: F.substr(brand, F.lit(7)))
    return held.find("Part").project({"id": "PartKey", "label": "BrandLabel"})


@query("SELECT o_orderkey AS id, l_linenumber AS line FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P'")
def join_explode_children(spark: SparkSession, d: str) -> DataFrame:
    """One row for each child, on request; an object without children keeps one."""
    orders = orders_with_items(spark, d).filter("o_orderstatus = 'P'")
    return orders.select(F.col("o_orderkey").alias("id"), F.explode_outer("items").alias("item")).select("id", F.col("item.l_linenumber").alias("line"))


@query("SELECT l_orderkey, l_linenumber, o_orderdate FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey")
def join_table_by_id(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d, "lineitem", "orders").find("LineItem").project({"l_orderkey": "OrderKey", "l_linenumber": "LineNumber", "o_orderdate": "OrderDate"})


@query("SELECT o_orderkey, coalesce(names, []) AS names FROM orders LEFT JOIN (SELECT l_orderkey, list(p_name ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS names FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey) ON o_orderkey = l_orderkey")
def join_array_ids(spark: SparkSession, d: str) -> DataFrame:
    """Each of an order's part ids looked up."""
    orders = orders_with_items(spark, d, "l_partkey").select("o_orderkey", F.transform("items", lambda x: x["l_partkey"]).alias("ids"))
    found = lookup_each(orders, "ids", table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", "o_orderkey", "parts")
    return found.select("o_orderkey", F.transform("parts", lambda p: p["p_name"]).alias("names"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '5-LOW')")
def join_batch_ids(spark: SparkSession, d: str) -> DataFrame:
    low = orders_with_items(spark, d, "l_partkey").filter("o_orderpriority = '5-LOW'")
    ids = F.transform("items", lambda x: x["l_partkey"])
    return members_of(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", low, ids)


@query("SELECT o_orderkey, coalesce(lines, []) AS lines FROM orders LEFT JOIN (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) FILTER (l_shipdate > o_orderdate) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey) ON o_orderkey = l_orderkey")
def join_nested_filter(spark: SparkSession, d: str) -> DataFrame:
    """A filter inside a collection that compares with the object around it."""
    held = orders_with_items(spark, d, "l_shipdate")
    late = filter_all(F.col("items"), lambda x: x["l_shipdate"] > F.col("o_orderdate"))
    lines = F.transform(late, lambda x: x["l_linenumber"])
    return held.select("o_orderkey", F.coalesce(lines, F.expr("cast(array() as array<int>)")).alias("lines"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 WHEN 'P' THEN 3 END AS code FROM orders")
def join_enum_synonym(spark: SparkSession, d: str) -> DataFrame:
    """Two vocabularies of one meaning, joined through synonyms."""
    orders = table(spark, d, "orders").withColumn("state", synonym(F.col("o_orderstatus"), {"O": "Open", "F": "Filled", "P": "Partial"}))
    codes = spark.sql("SELECT * FROM VALUES ('Open', 1), ('Filled', 2), ('Partial', 3) AS t(name, code)")
    return lookup(orders, codes, {"state": "name"}).select("o_orderkey", "code")


@query("SELECT o_orderkey AS id, c_name AS name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def join_subtype_key(spark: SparkSession, d: str) -> DataFrame:
    """A key whose type is a subtype of the one the lookup takes."""
    orders = Model("Order", table(spark, d, "orders"), {"o_orderkey": "OrderKey", "o_custkey": "BuyerKey"}, "OrderKey")
    customers = Model("Customer", table(spark, d, "customer"), {"c_custkey": "PartyKey", "c_name": "PartyName"}, "PartyKey")
    return Catalog([orders, customers]).inherits("BuyerKey", "PartyKey").find("Order").project({"id": "OrderKey", "name": "PartyName"})


@query("SELECT n_nationkey, coalesce(list(c_custkey ORDER BY c_custkey) FILTER (c_custkey IS NOT NULL), []) AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def join_collection(spark: SparkSession, d: str) -> DataFrame:
    """One-to-many as a collection. A nation's customers are a collection by request, so its size is the answer's."""
    held = nest(table(spark, d, "customer"), "c_nationkey", ["c_custkey"], "items")
    joined = table(spark, d, "nation").select("n_nationkey").join(held, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    ids = F.transform("items", lambda x: x["c_custkey"])
    return joined.select("n_nationkey", F.coalesce(ids, F.expr("cast(array() as array<bigint>)")).alias("customers"))
