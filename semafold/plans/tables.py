"""The provided tables as semantic models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from semafold.operators.joins import nest
from semafold.plans.catalog import Catalog, Model

TYPES = {
    "region": ("Region", {"r_regionkey": "RegionKey", "r_name": "RegionName"}, "RegionKey"),
    "nation": ("Nation", {"n_nationkey": "NationKey", "n_name": "NationName", "n_regionkey": "RegionKey"}, "NationKey"),
    "customer": ("Customer", {"c_custkey": "CustomerKey", "c_name": "CustomerName", "c_nationkey": "NationKey", "c_acctbal": "CustomerBalance", "c_mktsegment": "MarketSegment"}, "CustomerKey"),
    "supplier": ("Supplier", {"s_suppkey": "SupplierKey", "s_name": "SupplierName", "s_nationkey": "SupplierNationKey", "s_acctbal": "SupplierBalance"}, "SupplierKey"),
    "part": ("Part", {"p_partkey": "PartKey", "p_name": "PartName", "p_brand": "PartBrand", "p_type": "PartType", "p_size": "PartSize", "p_retailprice": "RetailPrice"}, "PartKey"),
    "orders": ("Order", {"o_orderkey": "OrderKey", "o_custkey": "CustomerKey", "o_orderstatus": "OrderStatus", "o_totalprice": "OrderTotal", "o_orderdate": "OrderDate", "o_orderpriority": "OrderPriority"}, "OrderKey"),
    "lineitem": ("LineItem", {"l_orderkey": "OrderKey", "l_partkey": "PartKey", "l_suppkey": "SupplierKey", "l_linenumber": "LineNumber", "l_quantity": "Quantity", "l_extendedprice": "ExtendedPrice", "l_discount": "Discount", "l_tax": "Tax", "l_returnflag": "ReturnFlag", "l_linestatus": "LineStatus", "l_shipdate": "ShipDate"}, None),
    "events": ("Event", {"event_id": "EventId", "ts": "EventTime", "user_id": "UserId", "event_type": "EventType", "value": "EventValue", "props": "EventProps"}, "EventId"),
    "documents": ("Document", {"doc_id": "DocId", "text": "DocText", "lang": "Lang", "source": "DocSource", "n_chars": "CharCount"}, "DocId"),
    "labels": ("Label", {"doc_id": "DocId", "quality": "Quality", "toxic": "Toxic"}, "DocId"),
}


#: What orders the items of an order; line numbers may repeat.
ITEM_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str, *names: str) -> Catalog:
    """Models of the named tables. Their keys are unique but for labels', whose first match is the smallest quality, then toxic."""
    order = {"labels": ("quality", "toxic")}
    return Catalog([Model(n, table(spark, sf_dir, t), types, key, order.get(t, ()), unique=t not in order) for t in names for n, types, key in [TYPES[t]]])


def orders_with_items(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """Orders with their line items as a collection, by line number."""
    fields = tuple(dict.fromkeys((*ITEM_ORDER, *fields)))
    items = nest(table(spark, sf_dir, "lineitem"), "l_orderkey", list(fields), "items")
    orders = table(spark, sf_dir, "orders")
    return orders.join(items, orders["o_orderkey"] == items["l_orderkey"], "left").drop("l_orderkey")
