"""Operators and conditionals, with labels' missing rows as a source of nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semafold.operators import logic
from semafold.operators.joins import lookup
from semafold.plans.tables import table
from semafold.queries import registered

QUERIES, SQL, query = registered()
LABELLED = "documents d LEFT JOIN labels l USING (doc_id)"


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Documents with labels where there are any: about three in five have nulls."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "lang")
    return lookup(docs, table(spark, d, "labels"), {"doc_id": "doc_id"}).select(docs["doc_id"], "n_chars", "lang", "quality", "toxic")


def _compared(name: str, of, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return labelled(spark, d).select("doc_id", of(F.col("quality"), F.col("toxic")).alias("r"))

    QUERIES[name], SQL[name] = run, f"SELECT d.doc_id, {sql} AS r FROM {LABELLED}"


_compared("op_eq", logic.eq, "quality IS NOT DISTINCT FROM toxic")
_compared("op_ne", logic.ne, "quality IS DISTINCT FROM toxic")
_compared("op_gt", logic.gt, "coalesce(quality > toxic, false)")
_compared("op_ge", logic.ge, "coalesce(quality >= toxic, false)")
_compared("op_lt", logic.lt, "coalesce(quality < toxic, false)")
_compared("op_le", logic.le, "coalesce(quality <= toxic, false)")
_A, _B = "(n_chars > 500)", "(quality = 1)"


@query(f"SELECT d.doc_id, CASE WHEN NOT {_B} THEN false WHEN {_B} IS NULL OR {_A} IS NULL THEN NULL ELSE {_B} AND {_A} END AS r, CASE WHEN NOT {_A} THEN false WHEN {_B} IS NULL THEN NULL ELSE {_A} AND {_B} END AS s FROM {LABELLED}")
def op_and(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("n_chars") > 500, F.col("quality") == 1
    return labelled(spark, d).select("doc_id", logic.and_(b, a).alias("r"), logic.and_(a, b).alias("s"))


@query(f"SELECT d.doc_id, CASE WHEN {_B} THEN true WHEN {_B} IS NULL OR {_A} IS NULL THEN NULL ELSE {_B} OR {_A} END AS r, CASE WHEN {_A} THEN true WHEN {_B} IS NULL THEN NULL ELSE {_A} OR {_B} END AS s FROM {LABELLED}")
def op_or(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("n_chars") > 500, F.col("quality") == 1
    return labelled(spark, d).select("doc_id", logic.or_(b, a).alias("r"), logic.or_(a, b).alias("s"))


@query(f"SELECT d.doc_id, coalesce(quality >= 0.5, false) AS whole_and_decimal, CASE WHEN quality IS NULL THEN false END AS whole_and_text, CASE WHEN quality IS NULL THEN false END AS equal FROM {LABELLED}")
def op_mixed_compare(spark: SparkSession, d: str) -> DataFrame:
    """Whole numbers and decimals compare; any other mix has no answer."""
    rows = labelled(spark, d).withColumn("quality", F.col("quality").cast("int"))
    quality, half, text = F.col("quality"), F.lit("0.5").cast("decimal(3,1)"), F.lit("x")
    tests = {"whole_and_decimal": (">=", half), "whole_and_text": (">", text), "equal": ("==", text)}
    return rows.select("doc_id", *[logic.compare(rows, op, quality, b).alias(k) for k, (op, b) in tests.items()])


def _arithmetic(name: str, of, op: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return labelled(spark, d).select("doc_id", of(F.col("n_chars"), F.col("quality").cast("long")).alias("r"))

    QUERIES[name], SQL[name] = run, f"SELECT d.doc_id, n_chars {op} CAST(quality AS BIGINT) AS r FROM {LABELLED}"


_arithmetic("op_add", logic.add, "+")
_arithmetic("op_sub", logic.subtract, "-")
_arithmetic("op_mul", logic.multiply, "*")


@query(f"SELECT d.doc_id, CAST(n_chars AS DOUBLE) / nullif(quality, 0) AS r FROM {LABELLED}")
def op_div(spark: SparkSession, d: str) -> DataFrame:
    """Division by zero and by null are null."""
    return labelled(spark, d).select("doc_id", logic.divide(F.col("n_chars"), F.col("quality")).alias("r"))


@query("SELECT c_custkey, c_name || ' of ' || c_mktsegment AS r FROM customer")
def op_str_concat(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", logic.concatenate(logic.concatenate(F.col("c_name"), F.lit(" of ")), F.col("c_mktsegment")).alias("r"))


@query("SELECT o_orderkey, epoch_ms(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 9 HOUR + INTERVAL 30 MINUTE) AS r FROM orders")
def op_date_plus_time(spark: SparkSession, d: str) -> DataFrame:
    at = logic.date_plus_time(F.col("o_orderdate").cast("date"), F.lit("09:30:00"))
    return table(spark, d, "orders").select("o_orderkey", F.unix_millis(at).alias("r"))


@query(f"SELECT d.doc_id, coalesce(quality, -1) AS r FROM {LABELLED}")
def op_elvis(spark: SparkSession, d: str) -> DataFrame:
    return labelled(spark, d).select("doc_id", logic.elvis(F.col("quality"), F.lit(-1)).alias("r"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' END AS r FROM orders")
def when_value(spark: SparkSession, d: str) -> DataFrame:
    cases = [(F.lit("O"), F.lit("open")), (F.lit("F"), F.lit("filled"))]
    return table(spark, d, "orders").select("o_orderkey", logic.when_value(F.col("o_orderstatus"), cases).alias("r"))


@query(f"SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'plain' END AS r FROM {LABELLED}")
def when_cond(spark: SparkSession, d: str) -> DataFrame:
    cases = [(F.col("toxic") == 1, F.lit("toxic")), (F.col("quality") == 1, F.lit("good"))]
    return labelled(spark, d).select("doc_id", logic.when_condition(cases, F.lit("plain")).alias("r"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS moved, CASE WHEN l_returnflag = 'R' THEN 'in' ELSE 'out' END AS way FROM lineitem")
def when_fieldset(spark: SparkSession, d: str) -> DataFrame:
    back, out = {"moved": -F.col("l_quantity"), "way": F.lit("in")}, {"moved": F.col("l_quantity"), "way": F.lit("out")}
    both: Column = logic.when_fields(F.col("l_returnflag") == "R", back, out)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", both.alias("f")).select("l_orderkey", "l_linenumber", "f.moved", "f.way")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice ELSE o_totalprice * CAST(0.8 AS DOUBLE) END AS price FROM orders")
def constraint_convert(spark: SparkSession, d: str) -> DataFrame:
    """A value that breaks a constraint is converted by the provider that promises it; here one rate for each priority."""
    orders = table(spark, d, "orders")
    rates = spark.sql("SELECT * FROM VALUES ('1-URGENT', 1.0D), ('2-HIGH', 0.8D), ('3-MEDIUM', 0.8D), ('4-NOT SPECIFIED', 0.8D), ('5-LOW', 0.8D) AS t(priority, rate)")
    with_rate = lookup(orders, rates, {"o_orderpriority": "priority"})
    held = F.col("o_orderpriority") == "1-URGENT"
    return with_rate.select("o_orderkey", F.when(held, F.col("o_totalprice")).otherwise(F.col("o_totalprice") * F.col("rate")).alias("price"))
