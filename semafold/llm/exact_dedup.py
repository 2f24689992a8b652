"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash. DataFrame operations only.

A narrow pass writes (id, length, prefix hash) of each row. Lengths that occur once settle their rows at once, then
(length, prefix hash) pairs that occur once settle theirs; both sets travel as fixed-size survivor bits. Only the rows
that are left have their whole content hashed, in a second pass over the text that moves no text between machines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semafold.llm.common import column, materialise, salt, survivor_bits, with_survivor_flag, without

PREFIX_BYTES = 128


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """A row per input row: id, keep_id, group_size, kept; with digests also text_sha256 of every row.

    Null texts count as empty, and empty texts are equal. The largest id of equal texts stays. A null id ranks below any
    other; a group of null ids only keeps them all. Rows that repeat both id and text count each in group_size and share
    their kept flag. Other columns, whatever their names, are not read. An empty table gives an empty result.
    digests hashes rows that refinement has settled too, for callers that need a digest of every row.
    """
    columns = [F.col("id").alias(id_col), "keep_id", "group_size", "kept"]
    out = _found(docs, id_col, text_col, digests)
    return out.select(*columns, F.lower(F.hex("h")).alias("text_sha256")) if digests else out.select(*columns)


def _found(docs: DataFrame, id_col: str, text_col: str, digests: bool) -> DataFrame:
    """id, keep_id, group_size, h, kept: h is the text's hash, null where refinement settled the row and digests is false."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    n, prefix = F.octet_length(text).cast("long"), F.xxhash64(F.substring(text, 1, PREFIX_BYTES))
    base = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t"), n.alias("n"), prefix.alias("p"))

    narrow = materialise(base.select("id", "n", "p"), "exact-narrow")
    lengths = narrow.groupBy("n").agg(F.count("*").alias("c")).filter("c > 1")
    by_length = with_survivor_flag(narrow, survivor_bits(lengths, F.col("n")), F.col("n"), "f").filter("f")
    pairs = by_length.groupBy("n", "p").agg(F.count("*").alias("c")).filter("c > 1")
    pair_key = F.xxhash64("n", "p")

    full = with_survivor_flag(base, survivor_bits(pairs, pair_key), pair_key, "f")
    digest = F.unhex(F.sha2("t", 256))
    hashed = materialise(full.select("id", "n", "f", (digest if digests else F.when(F.col("f"), digest)).alias("h")), "exact-hashed")

    left = hashed.filter("f").withColumn("s", salt("id"))
    parts = left.groupBy("n", "h", "s").agg(F.max("id").alias("m"), F.count("*").alias("c"))  # combined in each task first
    groups = parts.groupBy("n", "h").agg(F.max("m").alias("keep_id"), F.sum("c").alias("group_size"))
    places = parts.select("n", "h", "s").join(groups, ["n", "h"])  # a salted key each: a hot text meets its total in many tasks
    found = left.join(places, ["n", "h", "s"]).select("id", "keep_id", "group_size", "h")
    alone = hashed.filter("not f").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "h")
    return found.unionByName(alone).withColumn("kept", F.expr("id <=> keep_id"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that find_copies() gives up, by id and text; every column stays as it is.

    A row given up never takes another text of its id with it."""
    found = _found(docs, id_col, text_col, False)
    digest = F.unhex(F.sha2(F.coalesce(column(text_col), F.lit("")).cast("binary"), 256))
    return without(docs, found.filter("not kept and id is not null").select("id", "h"), id_col, digest)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)


ORACLE = {
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
