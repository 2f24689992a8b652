"""Streams, pipelines and writes; each stream is run over its whole table to the end."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semafold.operators.joins import lookup
from semafold.plans.tables import table
from semafold.queries import registered
from semafold.queries.sources import DERBY
from semafold.sources import readers, sinks
from semafold.streaming import streams

QUERIES, SQL, query = registered()


def _events(spark: SparkSession, d: str) -> DataFrame:
    """A pattern, so that the source takes a file as well as a folder."""
    return streams.file_stream(spark, f"{d}/[e]vents.parquet", table(spark, d, "events").schema)


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'purchase'")
def stream_find(spark: SparkSession, d: str) -> DataFrame:
    found = _events(spark, d).filter("event_type = 'purchase'").select("event_id", "user_id", "event_type")
    return streams.run_to_end(found)


@query("SELECT event_id, value FROM events")
def stream_source(spark: SparkSession, d: str) -> DataFrame:
    return streams.run_to_end(_events(spark, d).select("event_id", "value"))


@query("SELECT event_id, c_name FROM events LEFT JOIN customer ON user_id = c_custkey")
def stream_enrich(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").select("c_custkey", "c_name")
    return streams.run_to_end(streams.enrich(_events(spark, d).select("event_id", "user_id"), customers, "user_id", "c_custkey").select("event_id", "c_name"))


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('view', 'click')")
def stream_union(spark: SparkSession, d: str) -> DataFrame:
    """Streams of two subtypes as one of their base type."""
    parts = [_events(spark, d).filter(F.col("event_type") == t).select("event_id", "event_type") for t in ("view", "click")]
    return streams.run_to_end(streams.union_streams(parts))


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n, list(event_id ORDER BY event_id) AS ids FROM events GROUP BY 1")
def tumbling_batch(spark: SparkSession, d: str) -> DataFrame:
    held = streams.tumbling(table(spark, d, "events"), "ts", "1 hour", ["event_id"])
    return held.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("start"), F.size("items").cast("long").alias("n"), F.transform("items", lambda x: x["event_id"]).alias("ids"))


@query("""SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM events GROUP BY 1
          HAVING max(time_bucket(INTERVAL 1 HOUR, ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 SECOND""")
def tumbling_stream(spark: SparkSession, d: str) -> DataFrame:
    """The windows of a stream, as its watermark closes them; the last one is still open when the stream pauses."""
    held = streams.tumbling(_events(spark, d), "ts", "1 hour", ["event_id"])
    return streams.run_to_end(held.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("start"), F.size("items").cast("long").alias("n")))


@query("SELECT event_id, true AS stamped FROM events")
def stream_stamped(spark: SparkSession, d: str) -> DataFrame:
    """Events with the time they came in."""
    before = datetime.now(timezone.utc)
    held = streams.run_to_end(streams.stamped(_events(spark, d).select("event_id")))
    return held.select("event_id", (F.col("ingested_at") >= F.lit(before)).alias("stamped"))


@query("SELECT run, count(*) AS n FROM orders, (VALUES (0), (1)) t(run) WHERE o_orderkey % 2 = run GROUP BY run")
def poll_query(spark: SparkSession, d: str) -> DataFrame:
    """A query that is polled, each answer written as a part of its own."""
    path = readers.scratch(spark, "polled")
    ask = lambda run: table(spark, d, "orders").filter(F.col("o_orderkey") % 2 == run)
    streams.poll(ask, lambda rows, run: rows.agg(F.lit(run).alias("run"), F.count("*").alias("n")).write.parquet(f"{path}/part={run}"), times=2)
    return spark.read.parquet(path).select("run", "n")


@query("SELECT r_regionkey, r_name, 'got ' || r_name AS answer FROM region")
def operation_sink(spark: SparkSession, d: str) -> DataFrame:
    """An operation that is called with each record."""
    return sinks.invoke(table(spark, d, "region").select("r_regionkey", "r_name"), lambda row: f"got {row['r_name']}")


@query("SELECT event_id, upper(event_type) AS kind, round(value * 100) AS cents FROM events WHERE value IS NOT NULL")
def pipeline_transform(spark: SparkSession, d: str) -> DataFrame:
    """Validate, then transform each record."""
    kept, _ = readers.mandatory(_events(spark, d), ["value"])
    return streams.run_to_end(kept.select("event_id", F.upper("event_type").alias("kind"), F.round(F.col("value") * 100).alias("cents")))


@query("SELECT 'all' AS sink, count(*) AS n FROM events UNION ALL SELECT 'errors', count(*) FROM events WHERE event_type = 'error'")
def pipeline_fanout(spark: SparkSession, d: str) -> DataFrame:
    """One stream to two sinks; a batch that is run again replaces its own part."""
    paths = {name: readers.scratch(spark, name) for name in ("all", "errors")}

    def write(name: str, test: str):
        return lambda batch, number: batch.filter(test).write.mode("overwrite").parquet(f"{paths[name]}/batch={number}")

    streams.fan_out(_events(spark, d), [write("all", "true"), write("errors", "event_type = 'error'")])
    counts = [spark.read.parquet(p).agg(F.lit(n).alias("sink"), F.count("*").alias("n")) for n, p in paths.items()]
    return counts[0].unionByName(counts[1])


@query("SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'big', count(*) FROM events WHERE value > 50")
def stream_shared(spark: SparkSession, d: str) -> DataFrame:
    """One subscription, several queries: the source is read once for all of them."""
    path = readers.scratch(spark, "shared")
    kinds = lambda batch: batch.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    big = lambda batch: batch.filter("value > 50").agg(F.lit("big").alias("kind"), F.count("*").alias("n"))
    write = lambda name, of: lambda batch, number: of(batch).write.mode("overwrite").parquet(f"{path}/query={name}/batch={number}")
    streams.fan_out(_events(spark, d), [write("kinds", kinds), write("big", big)])
    return spark.read.parquet(path).groupBy("kind").agg(F.sum("n").alias("n"))


@query("SELECT event_id, event_type FROM events WHERE event_type <> 'view'")
def pipeline_to_database(spark: SparkSession, d: str) -> DataFrame:
    """A stream's batches to a database table, read back from there; a batch that is run again replaces its rows."""
    url = f"jdbc:derby:memory:events-{uuid.uuid4().hex};create=true"
    write = lambda batch, number: sinks.write_jdbc(batch, url, f"batch_{number}", mode="overwrite", properties=DERBY)
    numbers: list[int] = []
    streams.fan_out(_events(spark, d).filter("event_type <> 'view'").select("event_id", "event_type"), [write, lambda batch, number: numbers.append(number)])
    found = [readers.read_jdbc(spark, url, f"batch_{n}", DERBY) for n in numbers]
    return streams.union_streams(found).select("event_id", "event_type")


@query("SELECT 'from 2020-01-02T00:00:00+00:00 at 2020-01-03 04:05:06' AS text")
def pipeline_variables(spark: SparkSession, d: str) -> DataFrame:
    last, now = datetime(2020, 1, 2, tzinfo=timezone.utc), datetime(2020, 1, 3, 4, 5, 6, tzinfo=timezone.utc)
    return spark.createDataFrame([(streams.substitute("from ${pipeline.lastRunTime} at ${env.nowstr}", last, now),)], "text string")


@query("SELECT c_custkey, c_acctbal FROM customer")
def mutate_write(spark: SparkSession, d: str) -> DataFrame:
    path = readers.scratch(spark, "written")
    sinks.write_parquet(table(spark, d, "customer").select("c_custkey", "c_acctbal"), path)
    return spark.read.parquet(path)


@query("SELECT o_orderkey AS id, c_name AS customer FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")
def find_then_write(spark: SparkSession, d: str) -> DataFrame:
    orders, path = table(spark, d, "orders").filter("o_orderstatus = 'P'"), readers.scratch(spark, "found")
    found = lookup(orders, table(spark, d, "customer").select("c_custkey", "c_name"), {"o_custkey": "c_custkey"})
    sinks.write_parquet(found.select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("customer")), path)
    return spark.read.parquet(path)


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT -1, 5.0")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    current = customers.select("c_custkey", "c_acctbal")
    changes = customers.filter("c_mktsegment = 'BUILDING'").select("c_custkey", F.lit(0.0).alias("c_acctbal"))
    new = spark.range(1).select(F.lit(-1).cast("long").alias("c_custkey"), F.lit(5.0).alias("c_acctbal"))
    return sinks.upsert(current, changes.unionByName(new), "c_custkey")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT -1, 5.0")
def jdbc_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A table created from a type, filled, and merged into by key."""
    url = f"jdbc:derby:memory:upsert-{uuid.uuid4().hex};create=true"
    customers = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    current = customers.select("c_custkey", "c_acctbal")
    sinks.create_table(current, url, "balances", "c_custkey")
    sinks.write_jdbc(current, url, "balances", properties=DERBY)
    changes = customers.filter("c_mktsegment = 'BUILDING'").select("c_custkey", F.lit(0.0).alias("c_acctbal"))
    new = spark.range(1).select(F.lit(-1).cast("long").alias("c_custkey"), F.lit(5.0).alias("c_acctbal"))
    sinks.upsert_into(changes.unionByName(new), url, "balances", "c_custkey", DERBY)
    return readers.read_jdbc(spark, url, "balances", DERBY)


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0")
def recreate_view(spark: SparkSession, d: str) -> DataFrame:
    suppliers = table(spark, d, "supplier")
    sinks.recreate_behind_view(suppliers.select("s_suppkey", "s_name"), "suppliers_now")
    return sinks.recreate_behind_view(suppliers.filter("s_acctbal > 0").select("s_suppkey", "s_name"), "suppliers_now")
