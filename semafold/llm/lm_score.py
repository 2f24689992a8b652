"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs are gathered in one shuffle, pre-aggregated in each task. A count enters the filter as
its quantised logarithm q: the n-gram is inserted q times, as (n-gram, 1) ... (n-gram, q). A scorer probes levels upwards
until one is missing, which gives q back; counts estimated this way give smoothed probabilities. The filter is a block
for each part of the hash space, built where the part was counted and sized by what enters it, so that its false positives
are the same at all sizes. Blocks are never gathered: they are probed where they are stored.

The events are those of the add-one base score: the words of the training texts, the end, and one for any other word.
The probability of w after v is  PAIR * c(v, w) / c(v) + (1 - PAIR) * p(w)  (p(w) alone after a v not seen). Any other
word has the share that words seen once have of the training tokens; known words share the rest by their counts.

The base score needs exact counts of every word. They are not gathered anywhere either: each bucket of documents asks the
parts for the counts and levels of its distinct words, and for the levels of its distinct pairs, by way of exchange.py.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semafold.llm.common import materialise, released, releasing, slices, text_bytes, total_bytes
from semafold.llm.exchange import FAN, KEY, ROWS, SUB_ROWS, Exchange, Records
from semafold.llm.shingles import mix, word_hashes

#: Text of a bucket, and of a part of the hash space.
BUCKET_BYTES = 8 << 20
#: Filter bits for an insertion (up to twice as many, as blocks are powers of two), and probes.
BITS_EACH, PROBES = 12, 4
#: Levels are powers of BASE; weight of pairs in a probability.
BASE, PAIR = 1.5, 0.2
END = np.uint64(0x5851F42D4C957F2D)
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def level(counts: np.ndarray) -> np.ndarray:
    return (np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9) + 1).astype(np.int64)


#: The count that a level stands for: the geometric middle of its range.
VALUES = np.array([0.0] + [max(1.0, BASE ** (q - 0.5)) if q > 1 else 1.0 for q in range(1, 128)])


def word_code(words: np.ndarray) -> np.ndarray:
    """64 bits that tell a word from others; the lower 48 are its key."""
    return mix(words ^ _C2)


def pair_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _C1 + right) & KEY


class Tokens:
    """Tokens of a run of texts, end to end: hashes, the number of each text, and which are the first of a text."""

    def __init__(self, texts: list[bytes]):
        found = [word_hashes(t) for t in texts]
        self.sizes = np.array([len(x) + 1 for x in found], np.int64)
        self.hashes = np.concatenate([y for x in found for y in (x, [END])]).astype(np.uint64) if texts else np.zeros(0, np.uint64)
        self.first = np.zeros(len(self.hashes), bool)
        self.first[np.cumsum(self.sizes) - self.sizes] = True


WORDS_KIND, PAIRS_KIND = 0, 1
#: Tasks whose counts are put together where there are more parts than a task sends to.
TASKS = 64


def _bytes_of(*columns: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize) for c in columns], axis=1)


def _counted(codes: np.ndarray, counts: np.ndarray, kind: int) -> tuple[np.ndarray, Records]:
    """Keys and records of counts: what a word's code has beyond its key, and counts of up to 255 (larger ones take several)."""
    times = np.maximum(1, -(-counts // 255))
    codes, last = np.repeat(codes, times), np.cumsum(times) - 1
    some = np.full(len(codes), 255, np.int64)
    some[last] = counts - 255 * (times - 1)
    rest = ((codes >> np.uint64(48)).astype("<u2"),) if kind == WORDS_KIND else ()
    return codes & KEY, Records(_bytes_of(*rest, some.astype("u1")))


def _uncounted(keys: np.ndarray, records: Records, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and their total counts."""
    fixed = np.ascontiguousarray(records.fixed)
    codes = keys if kind == PAIRS_KIND else keys | (fixed[:, :2].copy().view("<u2").ravel().astype(np.uint64) << np.uint64(48))
    found, which = np.unique(codes, return_inverse=True)
    return found, np.bincount(which, fixed[:, -1], len(found)).astype(np.int64)


def _count(by_kind: tuple[Exchange, Exchange]):
    """Per task: distinct words and pairs with counts, each to its group of parts."""

    def rows(texts: list[bytes]) -> pa.RecordBatch:
        tokens = Tokens(texts)
        inner = ~tokens.first[1:]
        grams = (word_code(tokens.hashes), pair_key(tokens.hashes[:-1][inner], tokens.hashes[1:][inner]))
        source, tables = TaskContext.get().partitionId() * (FAN // TASKS), []
        for kind, (exchange, codes) in enumerate(zip(by_kind, grams, strict=True)):
            table = exchange.rows(source, *_counted(*np.unique(codes, return_counts=True), kind))
            tables.append(table.append_column("kind", pa.array([kind] * len(table), pa.int32())))
        return pa.concat_tables(tables).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches):
            for text in text_bytes(batch, "text"):
                held.append(text)
                size += len(text)
                if size > BUCKET_BYTES:
                    yield rows(held)
                    held, size = [], 0
        if held:
            yield rows(held)
        del held
        released()

    return run


def _merge(by_kind: tuple[Exchange, Exchange]):
    """What the tasks of a region found for a group of parts, summed and dealt on to the parts."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind")[0].as_py()
        keys, records, _ = by_kind[kind].read(table)
        out = by_kind[kind].dealt_on(table, table.column("region")[0].as_py(), *_counted(*_uncounted(keys, records, kind), kind))
        return out.append_column("kind", pa.array([kind] * len(out), pa.int32()))

    return run


def _total(by_kind: tuple[Exchange, Exchange]):
    """A part's exact word counts, and its block of the filter."""

    def run(table: pa.Table) -> pa.Table:
        found = []
        for kind, exchange in enumerate(by_kind):
            own = table.filter(pc.equal(table.column("kind"), kind))
            keys, records, _ = exchange.read(own) if len(own) else (np.zeros(0, np.uint64), Records(np.zeros((0, exchange.width), np.uint8)), None)
            found.append(_uncounted(keys, records, kind))
        (words, counts), (pairs, seen) = found
        keys, levels = np.concatenate((words & KEY, pairs)), np.concatenate((level(counts), level(seen)))
        inserts = int(levels.sum())
        bits = max(1024, 1 << (max(1, inserts * BITS_EACH) - 1).bit_length())
        cells = {
            "part": (table.column("part")[0].as_py(), pa.int64()), "sub": (table.column("sub")[0].as_py(), pa.int64()),
            "words": (words.tobytes(), pa.binary()), "counts": (counts.tobytes(), pa.binary()),
            "block": (Filter(1, bits).build(keys, levels), pa.binary()), "inserts": (inserts, pa.int64()),
            "tokens": (int(counts.sum()), pa.int64()), "types": (len(words), pa.int64()), "once": (int((counts == 1).sum()), pa.int64()),
            "mass": (float(VALUES[level(counts)].sum()) if len(counts) else 0.0, pa.float64()),
        }
        return pa.table({k: pa.array([v], t) for k, (v, t) in cells.items()})

    return run


TOTALS = "part long, sub long, words binary, counts binary, block binary, inserts long, tokens long, types long, once long, mass double"


class Filter:
    """The log-frequency Bloom filter: a block of `bits` (a power of two) for each part, which holds the keys of that part."""

    def __init__(self, parts: int, bits: int, data: np.ndarray | None = None):
        self.parts, self.bits, self.data = parts, bits, data

    def positions(self, keys: np.ndarray, q: int) -> np.ndarray:
        """A row of bits for each of PROBES probes of (key, q)."""
        a = mix(keys * _C1 + np.uint64(q))
        b = mix(a ^ _C2) | np.uint64(1)
        return np.stack([((a + b * np.uint64(i)) >> np.uint64(20)) & np.uint64(self.bits - 1) for i in range(PROBES)]).astype(np.int64)

    def build(self, keys: np.ndarray, levels: np.ndarray) -> bytes:
        out = np.zeros(self.bits, bool)
        for q in range(1, int(levels.max(initial=0)) + 1):
            out[self.positions(keys[levels >= q], q)] = True
        return np.packbits(out, bitorder="little").tobytes()

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level up to which every probe of a key answers, 0 if none does."""
        out, left = np.zeros(len(keys), np.int64), np.arange(len(keys))
        base = (keys % np.uint64(self.parts)).astype(np.int64) * (self.bits // 8)
        for q in range(1, len(VALUES)):
            at = self.positions(keys[left], q)
            hit = (self.data[base[left] + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1
            left = left[hit.all(axis=0)]
            if not len(left):
                break
            out[left] = q
        return out


class Model:
    """Totals of the training texts."""

    def __init__(self, totals: DataFrame, parts: int, fan: int):
        sums = totals.agg(*[F.sum(c) for c in ("tokens", "types", "once", "mass")]).first()
        self.tokens, self.types, once, mass = (x or 0 for x in sums)
        self.parts = parts
        self.exchange = Exchange(parts, 3, fan=fan, answers=("u1", "<i8"))
        self.unknown = min(0.5, max(once, 1) / max(self.tokens, 1))  # what words seen once hint is new
        self.mass = max(mass, 1.0)


def train(docs: DataFrame, text_col: str = "text", parts: int | None = None, fan: int = FAN) -> tuple[Model, DataFrame]:
    """The model of all texts of docs, and the parts with exact word counts and filter blocks."""
    parts = parts or max(1, -(-total_bytes(docs, text_col) // BUCKET_BYTES))
    by_kind = Exchange(parts, 3, fan=fan), Exchange(parts, 1, fan=fan)
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(_count(by_kind), f"{ROWS}, kind int")
    if by_kind[0].subs > 1:
        merged = by_kind[0].region(counted).groupBy("part", "region", "kind").applyInArrow(releasing(_merge(by_kind)), f"{SUB_ROWS}, kind int")
    else:
        merged = counted.withColumn("sub", F.lit(0).cast("long"))
    totals = materialise(merged.groupBy("part", "sub").applyInArrow(releasing(_total(by_kind)), TOTALS), "lm-totals")
    return Model(totals, parts, fan), totals.select("part", "sub", "words", "counts", "block")


class Grams:
    """Tokens of a bucket, and its distinct words and pairs. The order of the rows has no effect on the last."""

    def __init__(self, table: pa.Table):
        self.tokens = Tokens([b"" if t is None else t for t in table.column("text").cast(pa.binary()).to_pylist()])
        words, self.which = np.unique(word_code(self.tokens.hashes), return_inverse=True)
        self.inner = np.flatnonzero(~self.tokens.first)
        pairs, self.which_pair = np.unique(pair_key(self.tokens.hashes[self.inner - 1], self.tokens.hashes[self.inner]), return_inverse=True)
        self.words, self.keys = len(words), np.concatenate((words & KEY, pairs))
        rest = np.concatenate((words >> np.uint64(48), np.zeros(len(pairs), np.uint64))).astype("<u2")
        self.records = Records(_bytes_of(rest, np.repeat([WORDS_KIND, PAIRS_KIND], [len(words), len(pairs)]).astype("u1")))


def _ask(model: Model):
    def run(table: pa.Table) -> pa.Table:
        held = Grams(table)
        return model.exchange.rows(table.column("bucket")[0].as_py(), held.keys, held.records)

    return run


def _answer(keys: np.ndarray, records: Records, held: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The level of each key, and the exact counts of words."""
    words, counts = (np.frombuffer(held.column(c)[0].as_py(), k) if len(held) else np.zeros(0, k) for c, k in (("words", np.uint64), ("counts", np.int64)))
    block = np.frombuffer(held.column("block")[0].as_py(), np.uint8) if len(held) else np.zeros(128, np.uint8)
    exact, own = np.zeros(len(keys), np.int64), np.flatnonzero(records.fixed[:, 2] == WORDS_KIND)
    if len(words) and len(own):
        want = keys[own] | (records.fixed[own, :2].copy().view("<u2").ravel().astype(np.uint64) << np.uint64(48))
        at = np.minimum(np.searchsorted(words, want), len(words) - 1)
        exact[own] = np.where(words[at] == want, counts[at], 0)
    return Filter(1, 8 * len(block), block).levels(keys), exact


def _score(model: Model):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        held = Grams(left)
        tokens, which, inner = held.tokens, held.which, held.inner
        counts, levels, places = np.zeros(len(held.keys), np.int64), np.zeros(len(held.keys), np.int64), model.exchange.group_of(held.keys)
        for group, answers in zip(right.column("part").to_pylist(), right.column("answers").to_pylist(), strict=True):
            at = places[group]
            levels[at], counts[at] = model.exchange.columns(answers, len(at))
        exact, estimated, seen = counts[: held.words], np.minimum(VALUES[levels[: held.words]], model.mass), VALUES[levels[held.words :]]
        begins = np.cumsum(tokens.sizes) - tokens.sizes
        base = np.log10((exact + 1.0) / (model.tokens + model.types + 1.0))
        single = (1 - model.unknown) * estimated / model.mass
        single[estimated == 0] = model.unknown
        p = single[which]
        before = estimated[which[inner - 1]]
        known = before > 0
        share = np.minimum(1.0, seen[held.which_pair][known] / before[known])
        p[inner[known]] = PAIR * share + (1 - PAIR) * p[inner[known]]
        sums = lambda x: np.add.reduceat(x, begins)
        return pa.table({
            "id": left.column("id"), "held_out": left.column("held_out"), "n_tokens": pa.array(tokens.sizes, pa.int64()),
            "n_known": pa.array(sums((exact > 0)[which].astype(np.int64)), pa.int64()), "train_tokens": pa.array([model.tokens] * len(tokens.sizes), pa.int64()),
            "base_score": pa.array(sums(base[which])), "score": pa.array(sums(np.log10(p))),
        })

    return run


def score(docs: DataFrame, model: Model, word_counts: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Null and empty texts are the end token alone. Rows with null or repeated ids are scored like any other; ties do not
    matter; other columns are not read; an empty table gives an empty result. held_out is passed through.
    """
    buckets = max(1, -(-total_bytes(docs, text_col) // BUCKET_BYTES))
    key = F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)), F.lit(buckets))  # an id with many texts has them in many buckets
    given = docs.select(key.alias("bucket"), F.col(id_col).cast("long").alias("id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    shares = max(1, buckets // model.parts)  # a small model is asked by many buckets: each part answers in as many tasks
    asked = given.groupBy("bucket").applyInArrow(releasing(_ask(model)), ROWS)
    answers = model.exchange.answered(asked, _answer, word_counts, shares)
    out = given.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(releasing(_score(model)), "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    model, counts = train(docs.filter(~held_out))
    return score(docs, model, counts, held_out)
