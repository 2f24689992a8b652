"""String functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semafold.functions import strings as s
from semafold.functions.signatures import Function
from semafold.plans.tables import catalog, table
from semafold.queries import registered
from semafold.queries.operators import LABELLED, labelled

QUERIES, SQL, query = registered()


def _of_parts(name: str, column, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return table(spark, d, "part").select("p_partkey", column().alias("r"))

    QUERIES[name], SQL[name] = run, f"SELECT p_partkey, {sql} AS r FROM part"


def _c():
    return F.col("p_name")


_of_parts("fn_trim", lambda: s.trim(F.concat(F.lit(" \t\n"), _c(), F.lit("  \r"))), "p_name")
_of_parts("fn_left", lambda: s.left(_c(), F.col("p_size") - 25), "CASE WHEN p_size >= 25 THEN substr(p_name, 1, p_size - 25) END")
_of_parts("fn_right", lambda: s.right(_c(), F.col("p_size") - 5), "CASE WHEN p_size >= 5 AND p_size - 5 <= length(p_name) THEN substr(p_name, p_size - 4) END")
_of_parts("fn_mid", lambda: s.mid(_c(), F.lit(1), F.lit(4)), "CASE WHEN length(p_name) >= 4 THEN substr(p_name, 2, 3) END")
_of_parts("fn_upper", lambda: s.upper_case(_c()), "upper(p_name)")
_of_parts("fn_lower", lambda: s.lower_case(F.col("p_brand")), "lower(p_brand)")
_of_parts("fn_indexof", lambda: s.index_of(_c(), F.lit("a")), "strpos(p_name, 'a') - 1")
_of_parts("fn_contains_string", lambda: s.contains_string(F.col("p_type"), F.lit("A")), "contains(p_type, 'A')")
_of_parts("fn_replace", lambda: s.replace(F.col("p_brand"), F.lit("#"), F.lit("-")), "replace(p_brand, '#', '-')")


@query("SELECT doc_id, length(text) AS r FROM documents")
def fn_length(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", s.length(F.col("text")).cast("long").alias("r"))


@query(f"SELECT d.doc_id, concat(lang, ':', quality, ':', toxic) AS r FROM {LABELLED}")
def fn_concat(spark: SparkSession, d: str) -> DataFrame:
    return labelled(spark, d).select("doc_id", s.concat(F.col("lang"), F.lit(":"), F.col("quality"), F.lit(":"), F.col("toxic")).alias("r"))


@query(f"SELECT d.doc_id, coalesce(quality, toxic, CAST(n_chars AS INTEGER)) AS r FROM {LABELLED}")
def fn_coalesce(spark: SparkSession, d: str) -> DataFrame:
    return labelled(spark, d).select("doc_id", s.coalesce(F.col("quality"), F.col("toxic"), F.col("n_chars").cast("int")).alias("r"))


@query("SELECT doc_id, list_aggregate(list_transform(regexp_extract_all(text, '[^ \\t\\n\\r]+'), lambda w: length(w)), 'max') AS r FROM documents")
def udf_inline(spark: SparkSession, d: str) -> DataFrame:
    """A function defined on the spot, as an expression: the longest word's length."""
    longest = lambda text: F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"[^ \t\n\r]+"), F.lit(0)), F.length)).cast("long")
    return table(spark, d, "documents").select("doc_id", longest(F.col("text")).alias("r"))


@query("SELECT p_partkey, reverse(p_name) || '!' AS r FROM part")
def udf_custom(spark: SparkSession, d: str) -> DataFrame:
    """A registered Python function; Arrow batches, null in null out."""
    import pandas as pd

    def backwards(names: pd.Series) -> pd.Series:
        return names.map(lambda x: x[::-1] + "!", na_action="ignore")

    backwards.__annotations__ = {"names": pd.Series, "return": pd.Series}
    backwards = F.pandas_udf(backwards, "string")

    spark.udf.register("backwards", backwards)
    return table(spark, d, "part").select("p_partkey", F.expr("backwards(p_name)").alias("r"))


@query("SELECT p_partkey AS id, p_brand || '/' || p_size AS label, 'label(PartBrand, PartSize): PartLabel' AS says FROM part")
def udf_described(spark: SparkSession, d: str) -> DataFrame:
    """A function that declares its types is found by the type it gives."""
    label = Function("label", ("PartBrand", "PartSize"), "PartLabel", lambda brand, size: F.concat_ws("/", brand, size))
    rows = catalog(spark, d, "part").function(label).find("Part")
    return rows.project({"id": "PartKey", "label": "PartLabel"}, strict=True).withColumn("says", F.lit(label.declaration))


@query(f"SELECT d.doc_id, CASE WHEN quality IS NOT NULL THEN lang || '-' || quality END AS r FROM {LABELLED}")
def udf_null_safe(spark: SparkSession, d: str) -> DataFrame:
    """Null in any argument gives null, though the function itself would skip it."""
    tag = Function("tag", ("Lang", "Quality"), "Tag", lambda lang, quality: F.concat_ws("-", lang, quality))
    return labelled(spark, d).select("doc_id", tag(F.col("lang"), F.col("quality").cast("long")).alias("r"))


@query("SELECT n_nationkey, n_name || ' (' || n_regionkey || ')' AS r FROM nation")
def callback_udf(spark: SparkSession, d: str) -> DataFrame:
    """A user's function over whole Arrow batches of an operation's input."""

    def call(batches):
        for b in batches:
            b["r"] = b["n_name"] + " (" + b["n_regionkey"].astype(str) + ")"
            yield b[["n_nationkey", "r"]]

    return table(spark, d, "nation").mapInPandas(call, "n_nationkey int, r string")
