"""Formats, parsing and coercion."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semafold.functions import coerce
from semafold.plans.catalog import Catalog, Model
from semafold.plans.tables import catalog, table
from semafold.queries import registered
from semafold.sources import readers, sinks

QUERIES, SQL, query = registered()


def _customers_as_csv(spark: SparkSession, d: str) -> str:
    path = readers.scratch(spark, "csv")
    sinks.write_csv(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return path


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_csv(spark, _customers_as_csv(spark, d), "c_custkey long, c_name string, c_acctbal double")


@query("SELECT count(*) AS n, max(c_custkey) AS last FROM customer")
def scan_csv(spark: SparkSession, d: str) -> DataFrame:
    rows = readers.read_csv(spark, _customers_as_csv(spark, d), "c_custkey long, c_name string, c_acctbal double")
    return rows.agg(F.count("*").alias("n"), F.max("c_custkey").alias("last"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    balance = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast("string")).otherwise("")
    return c.select("c_custkey", F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name", balance, "c_mktsegment").alias("line"))


@query("SELECT c_custkey AS id, c_name AS name, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance FROM customer")
def csv_parse(spark: SparkSession, d: str) -> DataFrame:
    parsed = F.from_csv("line", "id long, name string, balance double, segment string", {"sep": "|"})
    return _lines(spark, d).select(parsed.alias("r")).select("r.id", "r.name", "r.balance")


@query("SELECT c_custkey, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS missing, CAST(NULL AS INTEGER) AS bad FROM customer")
def csv_column(spark: SparkSession, d: str) -> DataFrame:
    line = F.col("line")
    column = lambda n, kind="string": readers.csv_column(line, n, kind, "|")
    return _lines(spark, d).select("c_custkey", column(4).alias("segment"), column(9).alias("missing"), column(2, "int").alias("bad"))


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance, CASE WHEN c_mktsegment NOT IN ('BUILDING') THEN c_mktsegment END AS segment FROM customer")
def csv_nulls(spark: SparkSession, d: str) -> DataFrame:
    """The empty text is null where no null values are declared; declared ones replace it."""
    balance = readers.csv_column(F.col("line"), 3, "double", "|")
    segment = readers.csv_column(F.col("line"), 4, "string", "|", nulls=("BUILDING",))
    return _lines(spark, d).select("c_custkey", balance.alias("balance"), segment.alias("segment"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS missing FROM events")
def json_path(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", readers.json_path(F.col("props"), "$.k", "long").alias("k"), readers.json_path(F.col("props"), "$.a.b").alias("missing"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_slash_path(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", readers.json_path(F.col("props"), "/k", "long").alias("k"))


@query("SELECT event_id, struct_pack(k := CAST(json_extract_string(props, '$.k') AS BIGINT)) AS doc FROM events")
def json_parse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", readers.json_document(F.col("props"), "k long").alias("doc"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, length(props) AS size FROM events")
def destructure_accessor(spark: SparkSession, d: str) -> DataFrame:
    """One source, read once, gives several fields."""
    parts = F.struct(readers.json_path(F.col("props"), "$.k", "long").alias("k"), F.length("props").alias("size"))
    return table(spark, d, "events").select("event_id", parts.alias("p")).select("event_id", "p.*")


def _xml(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    return n.select("n_nationkey", F.format_string("<nation id='%d'><name>%s</name><region>%d</region></nation>", "n_nationkey", "n_name", "n_regionkey").alias("xml"))


@query("SELECT n_nationkey, n_name AS name, n_regionkey AS region FROM nation")
def xml_parse(spark: SparkSession, d: str) -> DataFrame:
    return _xml(spark, d).select("n_nationkey", readers.xml_document(F.col("xml"), "name string, region int").alias("r")).select("n_nationkey", "r.name", "r.region")


@query("""SELECT n_nationkey, '<nation id="' || n_nationkey || '"><name>' || n_name || '</name></nation>' AS xml FROM nation""")
def xml_write(spark: SparkSession, d: str) -> DataFrame:
    row = F.struct(F.col("n_nationkey").alias("_id"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("note"))
    return table(spark, d, "nation").select("n_nationkey", readers.to_xml(row, "nation").alias("xml"))


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def format_declared(spark: SparkSession, d: str) -> DataFrame:
    """Formats as models declare them, or their supertypes do."""
    held = catalog(spark, d).declare_format("Area", "json").declare_format("Region", "csv").inherits("Nation", "Area").inherits("Region", "Area")
    frames = []
    for type_, name in (("Nation", "nation"), ("Region", "region")):
        path, rows = readers.scratch(spark, name), table(spark, d, name)
        key, label = rows.columns[:2]
        rows = rows.select(F.col(key).cast("long").alias("n_nationkey"), F.col(label).alias("n_name"))
        rows.write.format(held.format_of(type_)).options(header=True).save(path)
        frames.append(readers.read_as(spark, path, held.format_of(type_), "n_nationkey long, n_name string"))
    return frames[0].union(frames[1])


def _database(spark: SparkSession, d: str, name: str) -> str:
    """An embedded database that lives in this process, with a table of customers."""
    url = f"jdbc:derby:memory:{name}-{uuid.uuid4().hex};create=true"
    sinks.write_jdbc(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), url, "customers", properties=DERBY)
    return url


DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000")
def jdbc_select(spark: SparkSession, d: str) -> DataFrame:
    """A database table by type and criteria; the filter runs in the database. The rows are written there first."""
    held = Catalog([Model("Customer", readers.read_jdbc(spark, _database(spark, d, "read"), "customers", DERBY), {"c_custkey": "CustomerKey", "c_name": "CustomerName", "c_acctbal": "CustomerBalance"})])
    return held.find("Customer").where("CustomerBalance", ">", 5000.0).frame.select("c_custkey", "c_name")


@query("SELECT * FROM (VALUES ('c_custkey', 'bigint'), ('c_name', 'string'), ('c_acctbal', 'double')) t(name, kind)")
def jdbc_metadata(spark: SparkSession, d: str) -> DataFrame:
    return readers.jdbc_columns(spark, _database(spark, d, "columns"), "customers", DERBY).withColumn("name", F.lower("name"))


@query("SELECT n_nationkey, n_name AS name FROM nation")
def xpath_extract(spark: SparkSession, d: str) -> DataFrame:
    return _xml(spark, d).select("n_nationkey", readers.xpath(F.col("xml"), "/nation/name").alias("name"))


@query("SELECT d.doc_id, quality FROM documents d JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def validate_mandatory(spark: SparkSession, d: str) -> DataFrame:
    from semafold.queries.operators import labelled

    kept, _ = readers.mandatory(labelled(spark, d), ["quality"])
    return kept.select("doc_id", "quality")


@query("SELECT o_orderkey, strftime(o_orderdate + INTERVAL 2 HOUR, '%d.%m.%Y %H:%M') AS at FROM orders")
def format_output(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", coerce.formatted(F.col("o_orderdate"), "dd.MM.yyyy HH:mm", "+02:00").alias("at"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Filled' END AS status FROM orders")
def enum_parse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", coerce.enum(F.col("o_orderstatus"), {"Open": "O", "Filled": "F"}).alias("status"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'offen' WHEN 'F' THEN 'fertig' WHEN 'P' THEN 'teils' END AS status FROM orders")
def enum_synonym(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", coerce.synonym(F.col("o_orderstatus"), {"O": "offen", "F": "fertig", "P": "teils"}).alias("status"))


@query("SELECT c_custkey, CAST(c_custkey * 1000 AS DOUBLE) AS n, CAST(NULL AS INTEGER) AS bad, CAST(NULL AS DOUBLE) AS empty FROM customer")
def coerce_number(spark: SparkSession, d: str) -> DataFrame:
    grouped = F.concat(F.col("c_custkey").cast("string"), F.lit(",000"))
    return table(spark, d, "customer").select("c_custkey", coerce.number(grouped).alias("n"), coerce.number(F.col("c_name"), "int").alias("bad"), coerce.number(F.lit("")).alias("empty"))


@query("SELECT o_orderkey, epoch_ms(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) AS day, o_orderkey AS millis, CAST(NULL AS BIGINT) AS bad FROM orders")
def coerce_timestamp(spark: SparkSession, d: str) -> DataFrame:
    german, patterns = F.date_format("o_orderdate", "dd.MM.yyyy"), ["yyyy/MM/dd", "dd.MM.yyyy"]
    millis = lambda c: F.unix_millis(c)
    columns = [millis(coerce.instant(german, patterns)).alias("day"), millis(coerce.instant_from_millis(F.col("o_orderkey"))).alias("millis"), millis(coerce.instant(F.lit("soon"), patterns)).alias("bad")]
    return table(spark, d, "orders").select("o_orderkey", *columns)


@query("SELECT d.doc_id, CASE WHEN quality IS NULL THEN '{\"id\":' || d.doc_id || '}' ELSE '{\"id\":' || d.doc_id || ',\"quality\":' || quality || '}' END AS json FROM documents d LEFT JOIN labels USING (doc_id)")
def omit_nulls(spark: SparkSession, d: str) -> DataFrame:
    from semafold.queries.operators import labelled

    return labelled(spark, d).select("doc_id", readers.omit_nulls(F.col("doc_id").alias("id"), "quality").alias("json"))
