"""Finding, criteria, projection by type, facts and parameters, policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semafold.operators import policy
from semafold.operators.joins import fallback, lookup
from semafold.plans.catalog import Catalog, Model
from semafold.plans.tables import catalog, orders_with_items, table
from semafold.queries import registered

QUERIES, SQL, query = registered()


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def find_all(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d, "nation").find("Nation").frame


@query("SELECT c_custkey AS id FROM customer")
def find_one(spark: SparkSession, d: str) -> DataFrame:
    """Of several sources of a base type only the first answers."""
    both = catalog(spark, d, "customer", "supplier").inherits("Customer", "Party").inherits("Supplier", "Party")
    return both.find("Party", first_source=True).frame.select(F.col("c_custkey").alias("id"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000")
def find_where(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog(spark, d, "orders").find("Order").where("OrderStatus", "==", "O").where("OrderTotal", ">", 100000.0)
    return rows.frame.select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def where_eq(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d, "orders").find("Order").where("OrderPriority", "==", "1-URGENT").frame.select("o_orderkey")


@query("SELECT p_partkey, p_size FROM part WHERE p_size >= 21 AND p_size < 40")
def where_range(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d, "part").find("Part").where("PartSize", ">=", 21).where("PartSize", "<", 40).frame.select("p_partkey", "p_size")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_acctbal <= 0")
def where_and(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d, "customer").find("Customer").where("MarketSegment", "!=", "BUILDING").where("CustomerBalance", "<=", 0.0).frame.select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal > 5000")
def where_or(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog(spark, d, "customer").find("Customer")
    return rows.filter((rows.column("MarketSegment") == "BUILDING") | (rows.column("CustomerBalance") > 5000)).frame.select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 50000 AND o_orderstatus = 'F'")
def where_between(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog(spark, d, "orders").find("Order")
    for type_, op, value in (("OrderTotal", ">=", 1000.0), ("OrderTotal", "<", 50000.0), ("OrderStatus", "==", "F")):
        rows = rows.where(type_, op, value)
    return rows.frame.select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
def range_query(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog(spark, d, "orders").find("Order")
    start, end = (F.lit(x).cast(rows.frame.schema["o_orderdate"].dataType) for x in ("1995-01-01", "1996-01-01"))
    return rows.filter((F.col("o_orderdate") >= start) & (F.col("o_orderdate") < end)).frame.select("o_orderkey")


@query("SELECT c_custkey AS \"PartyKey\", c_acctbal AS \"Balance\" FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def covariant_find(spark: SparkSession, d: str) -> DataFrame:
    """A base type is found in the sources of its subtypes."""
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    both = Catalog([Model("Customer", c, {"c_custkey": "PartyKey", "c_acctbal": "Balance"}), Model("Supplier", s, {"s_suppkey": "PartyKey", "s_acctbal": "Balance"})])
    return both.inherits("Customer", "Party").inherits("Supplier", "Party").find("Party").frame


def _parties(spark: SparkSession, d: str) -> Catalog:
    """Customers and suppliers as parties; only customers have a segment, and suppliers can be filtered by equality alone."""
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    customers = Model("Customer", c, {"c_custkey": "PartyKey", "c_acctbal": "Balance", "c_mktsegment": "Segment"})
    suppliers = Model("Supplier", s, {"s_suppkey": "PartyKey", "s_acctbal": "Balance"}, operators=frozenset({"==", "!="}))
    return Catalog([customers, suppliers]).inherits("Customer", "Party").inherits("Supplier", "Party")


@query('SELECT c_custkey AS "PartyKey", c_acctbal AS "Balance", c_mktsegment AS "Segment" FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier')
def union_sources(spark: SparkSession, d: str) -> DataFrame:
    """Columns that a source lacks are null."""
    return _parties(spark, d).find("Party").frame


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING'")
def covariant_where(spark: SparkSession, d: str) -> DataFrame:
    """Of the subtypes' sources those answer that have the field of the criterion."""
    return _parties(spark, d).find("Party", where=[("Segment", "!=", "BUILDING")]).frame.select("c_custkey", "c_acctbal")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 9000")
def declared_operators(spark: SparkSession, d: str) -> DataFrame:
    """A source that can't filter by an operator doesn't answer."""
    return _parties(spark, d).find("Party", where=[("Balance", ">", 9000.0)]).frame.select("c_custkey", "c_acctbal")


@query("SELECT n_nationkey AS id, struct_pack(n_nationkey := n_nationkey, n_name := n_name, n_regionkey := n_regionkey) AS nation FROM nation")
def build_object(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog(spark, d, "nation").find("Nation")
    return rows.frame.select(F.col("n_nationkey").alias("id"), rows.build("Nation").alias("nation"))


@query("SELECT n_nationkey AS id, NULL::STRUCT(n_nationkey INTEGER, n_name VARCHAR, n_regionkey INTEGER) AS nation FROM nation")
def closed_type(spark: SparkSession, d: str) -> DataFrame:
    """A closed type is not built from parts."""
    rows = catalog(spark, d, "nation").close("Nation").find("Nation")
    return rows.frame.select(F.col("n_nationkey").alias("id"), rows.build("Nation").alias("nation"))


@query("SELECT o_orderkey AS id, c_name AS customer, CAST(NULL AS DOUBLE) AS price FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def project_strict(spark: SparkSession, d: str) -> DataFrame:
    """Required fields have an answer, or the projection raises; optional ones are null of their kind."""
    held = catalog(spark, d, "orders", "customer")
    required = held.find("Order").project({"id": "OrderKey", "customer": "CustomerName"}, strict=True)
    prices = catalog(spark, d, "part")
    return required.withColumn("price", prices.null("RetailPrice"))


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'P'")
def count_where(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d, "orders").find("Order").where("OrderStatus", "==", "P").frame.agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_table(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d, "customer").find("Customer").frame


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def key_lookup(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d, "orders").find("Order").where("OrderKey", "==", 7).frame.select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def sql_over_view(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("SELECT c_mktsegment, count(*) AS n FROM {c} GROUP BY c_mktsegment", c=table(spark, d, "customer"))


@query("""SELECT o_orderkey AS id, o_totalprice AS total, c_name AS customer, n_name AS nation FROM orders
          LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'O'""")
def project_by_type(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: orders by criteria, each field by its type, two of them two lookups away."""
    rows = catalog(spark, d, "orders", "customer", "nation").find("Order").where("OrderStatus", "==", "O")
    return rows.project({"id": "OrderKey", "total": "OrderTotal", "customer": "CustomerName", "nation": "NationName"})


@query("SELECT c_custkey AS key, c_name AS label FROM customer")
def project_rename(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d, "customer").find("Customer").project({"key": "CustomerKey", "label": "CustomerName"})


@query("SELECT o_orderkey AS id, struct_pack(name := c_name, segment := c_mktsegment) AS customer FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def project_nested(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d, "orders", "customer").find("Order").project({"id": "OrderKey", "customer": {"name": "CustomerName", "segment": "MarketSegment"}})


@query("SELECT p_partkey AS id, struct_pack(brand := upper(p_brand), big := p_size > 25) AS about FROM part")
def project_inline(spark: SparkSession, d: str) -> DataFrame:
    fields = {"id": "PartKey", "about": {"brand": lambda r: F.upper(r.column("PartBrand")), "big": lambda r: r.column("PartSize") > 25}}
    return catalog(spark, d, "part").find("Part").project(fields)


ITEMS = "(SELECT l_orderkey, list({} ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS items FROM lineitem GROUP BY l_orderkey)"


@query("SELECT o_orderkey AS id, items AS lines FROM orders LEFT JOIN " + ITEMS.format("struct_pack(line := l_linenumber, qty := l_quantity)") + " ON o_orderkey = l_orderkey")
def project_array(spark: SparkSession, d: str) -> DataFrame:
    lines = F.transform("items", lambda x: F.struct(x["l_linenumber"].alias("line"), x["l_quantity"].alias("qty")))
    return orders_with_items(spark, d, "l_quantity").select(F.col("o_orderkey").alias("id"), lines.alias("lines"))


@query("SELECT o_orderkey AS id, items AS lines FROM (SELECT o_orderkey, list(struct_pack(line := l_linenumber, status := o_orderstatus) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) FILTER (l_orderkey IS NOT NULL) AS items FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)")
def project_with_scope(spark: SparkSession, d: str) -> DataFrame:
    """Members see a fact of the object around them."""
    lines = F.transform("items", lambda x: F.struct(x["l_linenumber"].alias("line"), F.col("o_orderstatus").alias("status")))
    return orders_with_items(spark, d).select(F.col("o_orderkey").alias("id"), lines.alias("lines"))


@query("SELECT o_orderkey AS id, items AS shares FROM (SELECT o_orderkey, list(l_extendedprice / o_totalprice ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) FILTER (l_orderkey IS NOT NULL) AS items FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)")
def parent_scope(spark: SparkSession, d: str) -> DataFrame:
    shares = F.transform("items", lambda x: x["l_extendedprice"] / F.col("o_totalprice"))
    return orders_with_items(spark, d, "l_extendedprice").select(F.col("o_orderkey").alias("id"), shares.alias("shares"))


@query("SELECT c_custkey AS id, upper(c_name) AS title FROM customer")
def named_scope(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d, "customer").find("Customer").project({"id": "CustomerKey", "title": lambda customer: F.upper(customer.column("CustomerName"))})


@query("SELECT o_orderkey AS id, items AS parts FROM orders LEFT JOIN " + ITEMS.format("l_partkey") + " ON o_orderkey = l_orderkey")
def hoist_attribute(spark: SparkSession, d: str) -> DataFrame:
    from semafold.functions.collections import hoist

    return orders_with_items(spark, d, "l_partkey").select(F.col("o_orderkey").alias("id"), hoist(F.col("items"), "l_partkey").alias("parts"))


@query("SELECT o_orderkey AS id, c_name AS name, CAST(NULL AS VARCHAR) AS missing FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def field_path(spark: SparkSession, d: str) -> DataFrame:
    """A path into a nested object; an unknown attribute is null."""
    nested = catalog(spark, d, "orders", "customer").find("Order").project({"id": "OrderKey", "customer": {"name": "CustomerName"}})
    missing = F.lit(None).cast("string") if "other" not in nested.schema["customer"].dataType.names else F.col("customer.other")
    return nested.select("id", F.col("customer.name").alias("name"), missing.alias("missing"))


@query("SELECT l_orderkey AS id, l_linenumber AS line, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def computed_field(spark: SparkSession, d: str) -> DataFrame:
    net = lambda r: r.column("ExtendedPrice") * (1 - r.column("Discount"))
    return catalog(spark, d, "lineitem").find("LineItem").project({"id": "OrderKey", "line": "LineNumber", "net": net})


@query("SELECT l_orderkey AS id, l_linenumber AS line, l_extendedprice * (1 + l_tax) AS gross FROM lineitem")
def expression_type(spark: SparkSession, d: str) -> DataFrame:
    c = catalog(spark, d, "lineitem").expression("Gross", ("ExtendedPrice", "Tax"), lambda price, tax: price * (1 + tax))
    return c.find("LineItem").project({"id": "OrderKey", "line": "LineNumber", "gross": "Gross"})


@query("SELECT l_orderkey AS id, CAST(NULL AS VARCHAR) AS rate FROM lineitem")
def ambiguous_type(spark: SparkSession, d: str) -> DataFrame:
    """Two columns of a type leave a request for it without an answer."""
    c = catalog(spark, d, "lineitem").inherits("Discount", "Rate").inherits("Tax", "Rate")
    return c.find("LineItem").project({"id": "OrderKey", "rate": "Rate"})


@query("SELECT d.doc_id, coalesce(nullif(trim(CAST(l.quality AS VARCHAR)), ''), d.lang) AS mark FROM documents d LEFT JOIN labels l USING (doc_id)")
def first_not_empty(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id", "quality")
    return lookup(docs, labels, {"doc_id": "doc_id"}).select(docs["doc_id"], fallback(F.col("quality").cast("string"), F.col("lang")).alias("mark"))


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier")
def sibling_convert(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers seen as the parties that customers are, through what both have in common."""
    s = table(spark, d, "supplier")
    c = Catalog([Model("Supplier", s, {"s_suppkey": "SupplierKey", "s_name": "SupplierName"})]).inherits("SupplierKey", "PartyKey").inherits("SupplierName", "PartyName")
    return c.find("Supplier").project({"id": "PartyKey", "name": "PartyName"})


@query("SELECT n_name, 'EU' AS area FROM nation")
def given_scalar(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d, "nation").find("Nation").given(area=("AreaName", "EU")).project({"n_name": "NationName", "area": "AreaName"})


@query("SELECT o_orderkey, 0.2 * o_totalprice AS vat FROM orders")
def join_given(spark: SparkSession, d: str) -> DataFrame:
    """A given fact is a literal of every row, not a join."""
    rows = catalog(spark, d, "orders").find("Order").given(rate=("VatRate", 0.2))
    return rows.project({"o_orderkey": "OrderKey", "vat": lambda r: r.column("VatRate") * r.column("OrderTotal")})


def customers_of(spark: SparkSession, d: str, *, segment: str) -> DataFrame:
    return catalog(spark, d, "customer").find("Customer").where("MarketSegment", "==", segment).frame.select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'MACHINERY'")
def param_query(spark: SparkSession, d: str) -> DataFrame:
    return customers_of(spark, d, segment="MACHINERY")


@query("SELECT 'MACHINERY' AS segment, 12 * 7 AS answer")
def eval_expr(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1).select(F.upper(F.lit("machinery")).alias("segment"), (F.lit(12) * F.lit(7)).alias("answer"))


@query("SELECT * FROM (VALUES (1, 'a new hope'), (2, 'the return')) t(id, title)")
def scan_facts(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(1, "a new hope"), (2, "the return")], "id int, title string")


@query("SELECT x.id AS id, n_name AS name FROM (VALUES (1), (3), (99)) x(id) LEFT JOIN nation ON x.id = n_nationkey")
def map_collection(spark: SparkSession, d: str) -> DataFrame:
    """A query for each member of a given collection, run as one join."""
    given = Model("Input", spark.createDataFrame([(1,), (3,), (99,)], "id int"), {"id": "NationKey"})
    return catalog(spark, d, "nation").add(given).find("Input").project({"id": "NationKey", "name": "NationName"})


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def policy_permit(spark: SparkSession, d: str) -> DataFrame:
    return policy.permit(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"))


@query("SELECT CAST(NULL AS BIGINT) AS c_custkey, CAST(NULL AS VARCHAR) AS c_name FROM customer")
def policy_filter_all(spark: SparkSession, d: str) -> DataFrame:
    return policy.filter_all(table(spark, d, "customer").select("c_custkey", "c_name"))


@query("SELECT c_custkey, CAST(NULL AS DOUBLE) AS c_acctbal FROM customer")
def policy_filter_fields(spark: SparkSession, d: str) -> DataFrame:
    return policy.filter_fields(table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END AS c_acctbal FROM customer")
def policy_case(spark: SparkSession, d: str) -> DataFrame:
    """The caller's desk sees its own segment's balances."""
    caller = {"segment": "BUILDING"}
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return policy.filter_fields(c, ["c_acctbal"], unless=c["c_mktsegment"] == caller["segment"]).drop("c_mktsegment")


@query("SELECT c_custkey, '******' AS c_name FROM customer")
def policy_mask(spark: SparkSession, d: str) -> DataFrame:
    return policy.mask(table(spark, d, "customer").select("c_custkey", "c_name"), ["c_name"])


@query("SELECT c_custkey, '******' AS c_name FROM customer")
def policy_rule_set(spark: SparkSession, d: str) -> DataFrame:
    """Of several rule sets the one that fits the operation and where its rows go."""
    sets = [
        policy.RuleSet("*", "internal", policy.permit),
        policy.RuleSet("read", "external", lambda df: policy.mask(df, ["c_name"])),
        policy.RuleSet("write", "external", policy.filter_all),
    ]
    return policy.select(sets, "read", "external").apply(table(spark, d, "customer").select("c_custkey", "c_name"))


@query("SELECT * FROM (VALUES ('CustomerBalance'), ('CustomerKey'), ('CustomerName'), ('MarketSegment'), ('NationKey'), ('NationName'), ('OrderDate'), ('OrderKey'), ('OrderPriority'), ('OrderStatus'), ('OrderTotal'), ('RegionKey'), ('RegionName')) t(type)")
def schema_reachability(spark: SparkSession, d: str) -> DataFrame:
    """Types that lookups lead to from an order key."""
    found = catalog(spark, d, "orders", "customer", "nation", "region").reachable({"OrderKey"})
    return spark.createDataFrame([(t,) for t in sorted(found)], "type string")
