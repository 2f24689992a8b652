"""Helpers the operators share: written tables, bounded survivor bits, and byte access to Arrow columns."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that are turned into Python objects at a time.
SLICE = 256
#: Bytes of an Arrow batch.
BATCH = "4m"
#: Rows of a survivor table: 2^18 words of 64 bits, so a broadcast of it has at most 262,144 rows (about 4 MB of longs).
BIT_WORDS = 1 << 18
#: Parts a key is dealt to before its totals meet, so that no task holds all rows of one key.
SALTS = 64


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session (tests) gets a
    folder of its own; on a cluster executors would each write to their own disks, so there it is an error."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="semafold-")
    spark.sparkContext.setCheckpointDir(base)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def small_batches(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of at most BATCH bytes to and from Python: the JVM holds several of them for each running task,
    outside its heap, and keeps the room. For applications, which own their session; operators leave it alone."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    return spark


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: later jobs neither recompute it nor depend on executors' disks."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no frame still to be run reads."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names for columns of our own beside those of a caller, which may have any."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def column(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def survivor_bits(keys: DataFrame, key: Column) -> DataFrame:
    """A bit for each key hash: columns word, bits; never over BIT_WORDS rows however many keys there are.

    Membership has false positives (two keys on one bit) and no false negatives, so it only ever spares work."""
    slot = F.pmod(F.xxhash64(key), F.lit(BIT_WORDS * 64))
    return (
        keys.select(F.floor(slot / 64).cast("long").alias("word"), F.expr("1L").alias("one"), (slot % 64).cast("int").alias("at"))
        .groupBy("word")
        .agg(F.expr("bit_or(shiftleft(one, at))").alias("bits"))
    )


def with_survivor_flag(df: DataFrame, bits: DataFrame, key: Column, flag: str) -> DataFrame:
    """df with a boolean column that is true wherever key is (or, rarely, seems) among the keys of bits. Broadcast: BIT_WORDS rows at most."""
    word, at, held = fresh([*df.columns, flag], "word", "at", "bits")
    slot = F.pmod(F.xxhash64(key), F.lit(BIT_WORDS * 64))
    probed = df.withColumns({word: F.floor(slot / 64).cast("long"), at: (slot % 64).cast("int")})
    joined = probed.join(F.broadcast(bits.toDF(word, held)), word, "left")
    hit = F.coalesce(F.expr(f"(shiftright({held}, {at}) & 1L) = 1L"), F.lit(False))
    return joined.select(*[column(c) for c in df.columns], hit.alias(flag))


def without(docs: DataFrame, gone: DataFrame, id_col: str, also: Column | None = None) -> DataFrame:
    """docs without the rows whose id is in gone (one column), or whose id and `also` are (two columns). Rows that the survivor
    bits clear are not moved at all."""
    name, more, flag = fresh(docs.columns, "gone", "also", "flag")
    gone = materialise((gone.toDF(name) if also is None else gone.toDF(name, more)).distinct(), "gone")
    flagged = with_survivor_flag(docs, survivor_bits(gone, column(name)), column(id_col).cast("long"), flag)
    rest = flagged.filter(column(flag)).drop(flag)
    same = column(id_col).cast("long") == column(name)
    return flagged.filter(~column(flag)).drop(flag).unionByName(rest.join(gone, same if also is None else same & (also == column(more)), "left_anti"))


def salt(column: str, parts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(F.col(column)), F.lit(parts)).cast("int")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that what a task holds in Python doesn't follow the batch size; empty ones are left out."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def released() -> None:
    """Hand freed memory back at the end of a task: Python workers outlive it, and the next stage needs the room."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        return


def releasing(task: Callable) -> Callable:
    """A task over one Arrow table, or a pair of them, that hands its memory back when it is done."""

    def one(table: pa.Table) -> pa.Table:
        out = task(table)
        released()
        return out

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = task(left, right)
        released()
        return out

    return two if task.__code__.co_argcount == 2 else one


def dealt(part: np.ndarray) -> dict[int, np.ndarray]:
    """For each part that occurs, the places where it does, in order."""
    order = np.argsort(part, kind="stable")
    begin = np.flatnonzero(np.diff(part[order], prepend=-1))
    return dict(zip(part[order][begin].tolist(), np.split(order, begin[1:]), strict=True)) if len(begin) else {}


def text_bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 of a string column, nulls as empty."""
    return [b"" if v is None else v for v in batch.column(column).cast(pa.binary()).to_pylist()]


def total_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in links (u, v): component is the smallest id reachable.

    In each round every node finds the smallest of its neighbours and itself, and all its neighbours are linked to that one
    instead, until the links are stars around the smallest ids. A hub is a hot key of the join: both its sides are written
    tables, so adaptive execution splits it. Nothing is gathered on the driver but a count and a checksum."""
    stars, state, done = links.filter("u <> v").select("u", "v").distinct(), None, []
    while True:
        stars = materialise(stars, "links")
        discard(*done)
        now = stars.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == state or not now[0]:
            break
        state = now
        both = stars.union(stars.select("v", "u"))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        told = both.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("v"), "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select("x.m", "x.v")
        done = [stars, least]
        stars = told.filter("m <> v").select(F.col("m").alias("u"), "v").distinct()
    out = materialise(stars.select(F.col("v").alias("id"), F.col("u").alias("component")).union(stars.select("u", "u")).distinct(), "components")
    discard(stars)
    return out
