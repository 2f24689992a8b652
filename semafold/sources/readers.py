"""Sources and formats, all as Spark readers or expressions over text columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder the cluster shares (spark.checkpoint.dir). Where that is unset, a local session (tests) gets one
    of its own; on a cluster each executor would write to its own disk, so there it is an error."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(base or tempfile.mkdtemp(prefix="semafold-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return f"{held.get()}/{name}-{uuid.uuid4().hex}"


def csv_options(delimiter: str = ",", header: bool = True, null_value: str | None = None, quote: str = '"', record_separator: str | None = None) -> dict:
    out = {"sep": delimiter, "header": header, "quote": quote, "escape": quote, "mode": "PERMISSIVE"}
    return out | ({"nullValue": null_value} if null_value is not None else {}) | ({"lineSep": record_separator} if record_separator else {})


def read_csv(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """Files of delimited text under a declared schema; values that do not parse are null. Any path Spark reads."""
    return spark.read.options(**csv_options(**options)).schema(schema).csv(path)


def read_csv_after(spark: SparkSession, path: str, marker: str, schema: str, **options) -> DataFrame:
    """As read_csv, for files whose content starts at the line that begins with marker. A large file is read by many tasks: each
    line knows its block's place in the file and its own order in the block, and one aggregate finds each file's first marker."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), place.alias("place"))
    marks = lines.filter(F.col("value").startswith(marker)).groupBy("file").agg(F.min("place").alias("mark"))
    body = lines.join(marks, "file").filter((F.col("place") > F.col("mark")) & (F.rtrim("value") != "") & ~F.col("value").startswith(marker))
    return body.select(F.from_csv("value", schema, {"sep": options.get("delimiter", ",")}).alias("r")).select("r.*")


def read_as(spark: SparkSession, path: str, format_: str, schema: str) -> DataFrame:
    """Files of a declared format (see Catalog.format_of) under a declared schema."""
    reader = spark.read.schema(schema)
    return reader.options(**csv_options()).csv(path) if format_ == "csv" else reader.option("rowTag", "row").xml(path) if format_ == "xml" else reader.format(format_).load(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict | None = None, partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A database table; filters and columns are pushed down. partition: column, lowest, highest, number of reads."""
    if partition:
        column, low, high, n = partition
        return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=n, properties=properties or {})
    return spark.read.jdbc(url, table, properties=properties or {})


def jdbc_columns(spark: SparkSession, url: str, table: str, properties: dict | None = None) -> DataFrame:
    """A database table's columns and kinds, as Spark's dialect for the database has them; no row is read."""
    return spark.createDataFrame([(c, k) for c, k in read_jdbc(spark, url, table, properties).dtypes], "name string, kind string")


def read_kafka(spark: SparkSession, servers: str, topic: str, offset: str = "latest", schema: str | None = None) -> DataFrame:
    """A stream of a topic's messages, as JSON of a declared schema if one is given. Needs Spark's Kafka package."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", offset).load()
    value = F.col("value").cast("string")
    return raw.select(F.from_json(value, schema).alias("m")).select("m.*") if schema else raw.select(value.alias("value"))


def csv_column(line: Column, position: int, kind: str = "string", delimiter: str = ",", nulls: tuple[str, ...] = ("",)) -> Column:
    """The 1-based column of a line of delimited text; null values, missing columns and values that do not parse are null."""
    cell = F.get(F.split(line, f"\\Q{delimiter}\\E"), F.lit(position - 1))
    return F.when(~cell.isin(*nulls), cell).try_cast(kind)


def json_path(text: Column, path: str, kind: str = "string") -> Column:
    """`$.a.b`, or `/a` for a key; a missing path is null, and an array of one member is that member."""
    path = "$." + path.strip("/").replace("/", ".") if path.startswith("/") else path
    found = F.get_json_object(text, path)
    one = F.from_json(found, "array<string>")
    return F.when(found.startswith("[") & (F.size(one) == 1), F.get(one, F.lit(0))).otherwise(found).try_cast(kind)


def json_document(text: Column, schema: str) -> Column:
    return F.from_json(text, schema)


def xml_document(text: Column, schema: str) -> Column:
    return F.from_xml(text, schema)


def to_xml(row: Column, tag: str = "row") -> Column:
    """An object as an XML element; names that begin with _ become attributes, nulls are left out."""
    return F.regexp_replace(F.to_xml(row, {"rowTag": tag}), r">\s+<", "><")


def xpath(text: Column, path: str) -> Column:
    return F.xpath_string(text, F.lit(path))


def to_csv_line(*columns: Column) -> Column:
    return F.to_csv(F.struct(*columns))


def omit_nulls(*columns: Column) -> Column:
    """JSON of the fields that are not null."""
    return F.to_json(F.struct(*columns))


def mandatory(df: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with every field, rows without): dropped records can be counted or kept."""
    missing = F.lit(False)
    for f in fields:
        missing = missing | F.col(f).isNull()
    return df.filter(~missing), df.filter(missing)
