"""Placement by a permutation-filled lookup table. DataFrame operations only.

Each shard has a preference order over the slots of a prime-sized table (offset + j * skip, modulo the prime). Shards
take turns claiming their next free slot until the table is full, so shares differ by one slot at most and the loss of
a shard moves few other keys. The table depends on the shard names alone: its size is the prime, never the data's, and
placing a key is one hash and one probe of the broadcast table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semafold.llm.common import column, fresh

#: Production parameters: 64 shards over the prime 6,521, about 100 slots each.
SHARDS, SLOTS = [f"shard-{i:03d}" for i in range(64)], 6521


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the index of the shard that claimed it. slots: a prime, at least the number of shards."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct, one at least")
    if slots < len(shards) or slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime that is no smaller than the number of shards")
    offset = [_number(f"offset:{s}") % slots for s in shards]
    skip = [_number(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    taken, turn, claimed = [-1] * slots, [0] * len(shards), 0
    while True:
        for i in range(len(shards)):
            while taken[at := (offset[i] + turn[i] * skip[i]) % slots] >= 0:
                turn[i] += 1
            taken[at] = i
            claimed += 1
            if claimed == slots:
                return taken


def place(rows: DataFrame, key_col: str, shards: list[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """rows with slot and shard_id (int) and shard (name); existing columns of those names are replaced, all others stay.

    A null key is placed as the empty text. Equal keys share a shard, so a hot key is as large as its rows: callers that
    only want even storage pass a key of their own, such as the row's id. The table has `slots` rows, whatever the input.
    """
    spark = rows.sparkSession
    taken = ",".join(map(str, fill_table(shards, slots)))
    names = F.array(*[F.lit(s) for s in shards])
    at, claimed = fresh([*rows.columns, "slot", "shard_id", "shard"], "at", "claimed")
    table = spark.sql(f"SELECT posexplode(from_json('[{taken}]', 'array<int>')) AS ({at}, {claimed})")
    key = F.coalesce(column(key_col).cast("string"), F.lit(""))
    slot = (F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long") % slots).cast("int")
    kept = [column(c) for c in rows.columns if c.lower() not in ("slot", "shard_id", "shard")]
    placed = rows.withColumn(at, slot).join(F.broadcast(table), at)
    return placed.select(*kept, column(at).alias("slot"), column(claimed).alias("shard_id"), F.element_at(names, column(claimed) + 1).alias("shard"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's slot and shard, keyed by doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return place(docs, "doc_id").select("doc_id", "source", "slot", "shard_id", "shard")


def _oracle() -> str:
    taken = ",".join(map(str, fill_table(SHARDS, SLOTS)))
    return f"""
        WITH t AS (SELECT [{taken}] AS taken),
        d AS (SELECT doc_id, source,
                     CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SLOTS} AS INTEGER) AS slot
              FROM documents)
        SELECT doc_id, source, slot, CAST(taken[slot + 1] AS INTEGER) AS shard_id,
               'shard-' || lpad(CAST(taken[slot + 1] AS VARCHAR), 3, '0') AS shard
        FROM d, t"""


ORACLE = {"op2_sharding": _oracle()}
