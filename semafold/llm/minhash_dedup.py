"""Near-duplicates by b-bit MinHash.

1. One pass over the texts gives each document's 5-word shingle set as band keys (32 bands of 4 minima) and a packed
   signature: the low 4 bits of 128 minima in 64 bytes. Documents with equal sets form a class; its smallest id stands for it.
2. Classes that share a band key are candidates of that key's smallest and largest class. Bit counts of the packed
   signatures, corrected for chance agreement (1 in 16), drop pairs that are far below the threshold.
3. What is left is confirmed on full shingle sets, read again for the candidates only.
4. Confirmed links give components. Band keys whose other members are still in different components are then compared
   on full sets across those components, in blocks of bounded size, while a large group that its two pivots already
   connect costs only its own size.

What may be lost: a pair at the threshold shares a band key with probability 1 - (1 - 0.75^4)^32, over 0.99999; and a pivot
pair whose signatures say less than THRESHOLD - MARGIN (over four standard deviations, about 3 in 100,000 at the threshold)
is not confirmed and counts only if other links lead from one to the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semafold.llm.common import components, discard, materialise, released, slices, survivor_bits, text_bytes, with_survivor_flag, without
from semafold.llm.shingles import WORDS, mix, shingle_set

BANDS, ROWS, BITS = 32, 4, 4
HASHES = BANDS * ROWS
THRESHOLD = 0.75
#: The estimate's standard deviation at the threshold is 0.041; pairs estimated over four of them below it are dropped.
MARGIN = 0.17
#: Members of a band key in a block, and shingles of them; larger keys are dealt to blocks, and pairs of blocks to tasks.
BLOCK, BLOCK_SHINGLES = 256, 1 << 17
_random = np.random.default_rng(5)
_A = (_random.integers(0, 1 << 32, HASHES, np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _random.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32)
_LANES = np.uint64(BITS) * np.arange(64 // BITS, dtype=np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least of each of HASHES hashes over a set, in strips so that memory doesn't follow the document."""
    low, out = (shingles >> np.uint64(32)).astype(np.uint32), np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 4096):
        np.minimum(out, (low[None, at : at + 4096] * _A[:, None] + _B[:, None]).min(axis=1), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for column in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def packed(least: np.ndarray) -> np.ndarray:
    """The low BITS bits of the minima, packed into 64-bit words."""
    lanes = (mix(least.astype(np.uint64)) & np.uint64((1 << BITS) - 1)).reshape(-1, 64 // BITS)
    return np.bitwise_or.reduce(lanes << _LANES, axis=1).view(np.int64)


def features(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """id, n (set size), digest of the set, sig (packed signature) and bands (keys); sets of size 0 have neither."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, digest, sig, bands = [], [], [], []
            for data in text_bytes(batch, "text"):
                found = shingle_set(data, words)
                n.append(len(found))
                if not len(found):
                    digest.append(None), sig.append(None), bands.append(None)
                    continue
                least = minima(found)
                digest.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                sig.append(packed(least))
                bands.append(band_keys(least))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, longs), pa.array(bands, longs)], names=["id", "n", "digest", "sig", "bands"])
        released()

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "id long, n long, digest binary, sig array<long>, bands array<long>")


def sets_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, n, s): the full shingle sets of the documents in ids. The scan drops most others before anything is moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            found = [shingle_set(data, words) for data in text_bytes(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], names=["id", "n", "s"])
        released()

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ids = materialise(ids, "ids")  # of candidates
    near = with_survivor_flag(picked, survivor_bits(ids, F.col("id")), F.col("id"), "f").filter("f").select("id", "text")
    out = materialise(near.mapInArrow(run, "id long, n long, s array<long>").join(ids, "id", "left_semi").dropDuplicates(["id"]), "sets")
    discard(ids)
    return out


def estimate(a: Column, b: Column) -> Column:
    """Similarity of two packed signatures: lanes that agree, corrected for those that agree by chance."""
    lane = int("1" * (64 // BITS), 16)
    differ = F.lit(0)
    for i in range(HASHES * BITS // 64):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        folded = x
        for shift in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, shift))
        differ = differ + F.bit_count(folded.bitwiseAND(F.lit(lane)))
    chance = 2.0**-BITS
    return ((F.lit(1.0) - differ / HASHES) - chance) / (1 - chance)


def confirmed(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str, words: int, threshold: float) -> DataFrame:
    """Those of pairs (u, v) whose full sets are as similar as threshold says."""
    ids = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()
    sets = sets_of(docs, ids, id_col, text_col, words)
    left = sets.select(F.col("id").alias("u"), F.col("n").alias("nu"), F.col("s").alias("su"))
    right = sets.select(F.col("id").alias("v"), F.col("n").alias("nv"), F.col("s").alias("sv"))
    both = pairs.join(left, "u").join(right, "v")  # written tables on either side: adaptive execution splits a hot pivot
    common = F.size(F.array_intersect("su", "sv"))
    percent = round(100 * threshold)
    out = materialise(both.withColumn("i", common.cast("long")).filter(f"100 * i >= {percent} * (nu + nv - i)").select("u", "v"), "confirmed")
    discard(sets)
    return out


def cross_links(members: DataFrame, threshold: float, block: int = BLOCK, shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Links (u, v) between members (key, id, component, s) of one key and different components, on their full sets s.

    A key's members meet in blocks, each pair of blocks in a task: a set travels once a block, not once a pair."""
    needed = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum(F.size("s")) / shingles))
    counts = members.groupBy("key").agg(needed.cast("int").alias("blocks"))
    placed = members.join(materialise(counts.select("key", "blocks"), "blocks"), "key")
    at = F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int")
    dealt = placed.withColumn("at", at).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    tasks = dealt.select("key", F.least("at", "other").alias("lo"), F.greatest("at", "other").alias("hi"), "id", "component", "s")
    percent = round(100 * threshold)

    def run(table: pa.Table) -> pa.Table:
        ids, parts = table.column("id").to_numpy(), table.column("component").to_numpy()
        sets = table.column("s").combine_chunks()
        sizes = np.diff(sets.offsets.to_numpy())
        begins = np.cumsum(sizes) - sizes
        _, which = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        mark = np.zeros(which.max(initial=-1) + 1, np.int32)
        joined = {p: p for p in parts.tolist()}

        def root(p: int) -> int:
            while joined[p] != p:
                p = joined[p]
            return p

        found = []
        for i in range(len(ids)):
            if len({root(p) for p in joined}) == 1:
                break
            own = which[begins[i] : begins[i] + sizes[i]]
            mark[own] = 1
            both = np.add.reduceat(mark[which], begins)
            mark[own] = 0
            hits = np.flatnonzero((100 * both >= percent * (sizes + sizes[i] - both)) & (parts != parts[i]))
            for j in hits.tolist():
                a, b = root(int(parts[i])), root(int(parts[j]))
                if a != b:
                    joined[max(a, b)] = min(a, b)
                    found.append((ids[i], ids[j]))
        u, v = ([int(x[k]) for x in found] for k in (0, 1))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return tasks.groupBy("key", "lo", "hi").applyInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """A row per input row: id, n_shingles, component_id (the smallest id reachable over links), kept (id = component_id).

    Links join documents whose shingle sets overlap by threshold or more (intersection over union). Texts without words,
    and null texts, have no shingles and link with nothing. Rows with one id are one document. A row with a null id links
    with nothing, has a null component_id unless its text equals that of a row with an id, and is then kept = false;
    otherwise true. Ties cannot occur: the smallest id decides. Other columns are not read; an empty table gives an empty result.
    """
    rows = materialise(features(docs, id_col, text_col, words), "minhash")
    full = rows.filter("n > 0")
    classes = materialise(full.groupBy("digest").agg(F.min("id").alias("rep")), "classes")
    reps = materialise(full.join(classes, (full["id"] == classes["rep"]) & (full["digest"] == classes["digest"]), "left_semi").select("id", "sig", "bands").dropDuplicates(["id"]), "reps")

    entries = reps.select("id", F.explode("bands").alias("key"))
    keys = materialise(entries.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("c")).filter("c > 1"), "keys")
    shared = materialise(entries.join(keys, "key"), "shared-keys")  # a hot key is split by adaptive execution, as both sides are written tables
    to_ends = shared.select("id", F.explode(F.array("lo", "hi")).alias("end")).filter("id <> end")
    pairs = materialise(to_ends.select(F.least("id", "end").alias("u"), F.greatest("id", "end").alias("v")).distinct(), "pairs")
    sigs = reps.select("id", "sig")
    signed = pairs.join(sigs.toDF("u", "su"), "u").join(sigs.toDF("v", "sv"), "v")
    near = materialise(signed.filter(estimate(F.col("su"), F.col("sv")) >= threshold - MARGIN).select("u", "v"), "near-pairs")
    sure = confirmed(docs, near, id_col, text_col, words, threshold)
    labels = components(sure)
    discard(keys, pairs, near, reps, sure)

    inner = shared.filter("c > 2 and id <> lo and id <> hi").select("key", "id")
    inner = inner.join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    inner = materialise(inner, "inner")
    spread = inner.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("c"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("sum")).filter("a <> b")
    spread = materialise(spread.groupBy("c", "sum").agg(F.min("key").alias("key")).select("key"), "spread")  # keys with the same members are one
    done = [shared, inner, spread]
    if not spread.isEmpty():
        members = materialise(inner.join(spread, "key"), "members")
        sets = sets_of(docs, members.select("id").distinct(), id_col, text_col, words)
        further = materialise(cross_links(members.join(sets.select("id", "s"), "id"), threshold, block), "links")
        done += [members, sets, further]
        if not further.isEmpty():
            done.append(labels)
            labels = components(labels.select(F.col("component").alias("u"), F.col("id").alias("v")).union(further))

    of_class = classes.join(labels, classes["rep"] == labels["id"], "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    of_class = materialise(of_class, "class-components")
    discard(*done, classes, labels)
    linked = full.select("id", "n", "digest").join(of_class, "digest").select("id", "n", "component_id")
    out = linked.union(rows.filter("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.expr("id <=> component_id").alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that near_duplicates() doesn't keep; every column stays as it is."""
    found = near_duplicates(docs, id_col, text_col)
    return without(docs, found.filter(~F.col("kept") & F.col(id_col).isNotNull()).select(id_col), id_col)


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
