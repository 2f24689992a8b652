"""Removal of repeated passages by longest-previous-factor arrays, over a corpus that no machine could hold.

A byte goes if a string of MATCH bytes over it also starts in a document with a smaller id. Two places share such a
string only if they share its minimizer: the least hash among the KGRAM-byte strings in it. So:

1. Each bucket of documents (dealt by id and text, a few MB) cuts its texts into stretches of windows with one minimizer,
   and sends 4 bytes for each distinct minimizer. Those that one document alone has can't match and are done with.
2. For the others it sends each distinct stretch as 128 bits with its smallest document. Stretches of equal content are one
   string with one first occurrence; the later ones repeat it from end to end.
3. The first occurrences, once in the whole corpus each, send their text to the part of their minimizer. A suffix array over
   the windows there, with the lengths that neighbours share, gives each window's previous and next smaller document in
   suffix order; the longer of the two matches is its longest previous factor. MATCH bytes or more means covered.
   A minimizer with more than HOT contents (the surroundings of a line that a third of the documents have) is
   dealt on by whole windows, so that no part holds all of them.
4. Each bucket puts the verdicts together and cuts the texts.

The text is shuffled once, to the buckets; what else moves is 4 bytes a minimizer, 128 bits a stretch in doubt, and the
text of first occurrences, all by way of exchange.py. Texts under MATCH bytes and rows without an id can't match and are not moved at all.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semafold.llm.common import column, dealt, releasing
from semafold.llm.exchange import FAN, KEY, ROWS, Exchange, Records
from semafold.llm.shingles import mix, powers

MATCH, KGRAM = 50, 20
#: Text of a bucket, which a task holds at a time (a longer document is a bucket's load of its own); of a part that gets its first
#: occurrences; and of a part that gets its minimizers and hashes, which are a small share of it.
BUCKET_BYTES, PART_BYTES, KEY_BYTES = 6 << 20, 4 << 20, 16 << 20
#: First occurrences with one minimizer that a part takes whole.
HOT = 4096
_SPAN = MATCH - KGRAM + 1
_AT = np.uint64((1 << 28) - 1)
_TILE = 1 << 16
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
#: Bases of the two hashes of a string.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def kgram_hashes(text: np.ndarray) -> np.ndarray:
    """A hash of the KGRAM bytes at each position but the last KGRAM - 1."""
    size = len(text) - KGRAM + 1
    u = np.array(np.ndarray(size + 12, "<u8", text.tobytes(), 0, (1,)))
    h = u[:size] * _C[0]
    h ^= h >> np.uint64(32)
    h += u[8 : size + 8] * _C[1]
    h *= _C[2]
    h ^= h >> np.uint64(29)
    h += u[12 : size + 12] * _C[3]
    h *= _C[0]
    h ^= h >> np.uint64(32)
    return h


class Bucket:
    """Documents of a bucket in order of id, end to end, and their stretches of windows with one minimizer each."""

    def __init__(self, table: pa.Table):
        ids = table.column("id").to_pylist()
        data = table.column("text").cast(pa.binary()).to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i], data[i]))
        self.order = order
        self.ids, data = np.array([ids[i] for i in order], np.int64), [data[i] for i in order]
        self.text = np.frombuffer(b"".join(data), np.uint8)
        self.bounds = np.cumsum([0, *map(len, data)])

    def cut(self) -> None:
        """starts, counts: the first window and number of windows of each stretch; doc: its document's id; small: its minimizer."""
        text, windows = self.text, len(self.text) - MATCH + 1
        found: list[list[np.ndarray]] = [[], [], []]  # where a stretch begins, whether its windows lie in one text, its minimizer
        before = (-1, True)
        edges = self.bounds[1:-1]
        for base in range(0, windows, _TILE):  # in strips that stay in cache
            size = min(_TILE, windows - base)
            hashed = kgram_hashes(text[base : base + size + MATCH - 1])
            least = (hashed & ~_AT) | np.arange(len(hashed), dtype=np.uint64)
            for step in (1, 2, 4, 8):
                least = np.minimum(least[:-step], least[step:])
            least = np.minimum(least[: len(least) - (_SPAN - 16)], least[_SPAN - 16 :])
            at = (least & _AT).astype(np.int64)  # of each window the leftmost least k-gram
            valid = np.ones(size, bool)
            for b in edges[np.searchsorted(edges, base, "right") : np.searchsorted(edges, base + size + MATCH - 1)].tolist():
                valid[max(0, b - MATCH + 1 - base) : max(0, b - base)] = False
            same = np.concatenate(([before == (at[0] + base, valid[0])], (at[1:] == at[:-1]) & (valid[1:] == valid[:-1])))
            new = np.flatnonzero(~same)
            before = (at[-1] + base, valid[-1])
            for into, part in zip(found, (new + base, valid[new], hashed[at[new]]), strict=True):
                into.append(part)
        starts, keep, small = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
        counts = np.diff(np.concatenate((starts, [max(windows, 0)])))
        keep = keep.astype(bool)
        self.starts, self.counts, self.small = starts[keep], counts[keep], small[keep].astype(np.uint64) & KEY
        self.doc = self.ids[np.searchsorted(self.bounds, self.starts, "right") - 1]

    def hashes(self, starts: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
        """A 64-bit hash of each string of at most _TILE bytes; starts ascend."""
        power, inverse = powers(base, 2 * _TILE + 1)
        out = np.zeros(len(starts), np.uint64)
        cuts = np.searchsorted(starts, np.arange(0, len(self.text) + _TILE, _TILE))
        for at, i, j in zip(range(0, len(self.text), _TILE), cuts[:-1], cuts[1:], strict=False):
            if i < j:
                part = self.text[at : at + 2 * _TILE]
                sums = np.zeros(len(part) + 1, np.uint64)
                np.cumsum((part + np.uint64(1)) * power[: len(part)], out=sums[1:])
                begin, length = starts[i:j] - at, lengths[i:j]
                out[i:j] = mix((sums[begin + length] - sums[begin]) * inverse[begin] + length.astype(np.uint64))
        return out

    def minimizers(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct minimizers in ascending order, and which of them two documents of this bucket have."""
        order = np.argsort(self.small, kind="stable")
        small, doc = self.small[order], self.doc[order]
        begin = np.flatnonzero(np.concatenate(([True], small[1:] != small[:-1]))) if len(small) else np.zeros(0, np.int64)
        several = np.maximum.reduceat(doc, begin) > np.minimum.reduceat(doc, begin) if len(begin) else np.zeros(0, bool)
        return small[begin], several

    def doubted(self, keys: np.ndarray, doubt: np.ndarray) -> None:
        """Keep the stretches whose minimizer (of keys) is in doubt. first: representatives, the first of each distinct stretch, so of its
        smallest document here; which: each stretch's representative; content: the representatives' 128 bits."""
        keep = doubt[np.searchsorted(keys, self.small)]
        self.starts, self.counts, self.small, self.doc = self.starts[keep], self.counts[keep], self.small[keep], self.doc[keep]
        one, two = (self.hashes(self.starts, self.counts + (MATCH - 1), b) for b in _BASES)
        order = np.lexsort((two, one))  # stable: the first of equal ones is the smallest document's
        a, b = one[order], two[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
        self.which = np.empty(len(a), np.int64)
        self.which[order] = np.cumsum(new) - 1
        self.first = order[new]
        self.content = np.stack([one[self.first], two[self.first]], axis=1)


def _nearest_smaller(docs: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """For each suffix the length it shares with the nearest one before it that has a smaller document, 0 if there is none.

    shared: the length that each suffix shares with the one before it. Pointers start at the neighbour and jump over
    suffixes whose document isn't smaller, to where those point; all that was jumped over isn't smaller either."""
    to, low = np.arange(len(docs)) - 1, shared.copy()
    left = np.arange(len(docs))
    while True:
        left = left[(low[left] > 0) & (docs[to[left]] >= docs[left])]  # nothing shared ends a search; the first suffix shares nothing
        if not len(left):
            return low
        over = to[left]
        low[left], to[left] = np.minimum(low[left], low[over]), to[over]


def longest_previous_factors(text: np.ndarray, starts: np.ndarray, docs: np.ndarray, most: int = MATCH) -> np.ndarray:
    """For each start, the length of the longest string there that also starts at a start of a smaller document, up to `most`.

    The suffixes at the starts are ordered by their first `most` bytes, and the length that each shares with the one before
    it is read off. Of all smaller documents, the previous and the next in suffix order share the most: the longest previous
    factor is the greater of the two. text has `most` bytes from each start on."""
    order = np.argsort(docs, kind="stable")  # equal windows stand in order of document
    windows = np.lib.stride_tricks.sliding_window_view(text, most)[starts[order]]
    array = np.argsort(np.ascontiguousarray(windows).view(f"S{most}").ravel(), kind="stable")
    windows, docs = windows[array], docs[order][array]
    differ = windows[1:] != windows[:-1]
    shared = np.zeros(len(docs), np.int64)
    shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), most)
    before = _nearest_smaller(docs, shared)
    after = _nearest_smaller(docs[::-1], np.concatenate(([0], shared[:0:-1])))[::-1]
    out = np.empty(len(docs), np.int64)
    out[order[array]] = np.maximum(before, after)
    return out


def _number(table: pa.Table) -> int:
    return table.column("bucket")[0].as_py() if len(table) else 0


def _bytes_of(*columns: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize * c.size // max(len(c), 1)) for c in columns], axis=1)


def _minimizers(exchange: Exchange):
    """1. To each part the distinct minimizers of a bucket."""

    def run(table: pa.Table) -> pa.Table:
        bucket = Bucket(table)
        bucket.cut()
        return exchange.rows(_number(table), bucket.minimizers()[0])

    return run


def _shared(keys: np.ndarray, _: Records) -> tuple[np.ndarray]:
    """Whether another bucket has a minimizer too."""
    _, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return (counts[which] > 1,)


def _told(table: pa.Table, step: int) -> list[tuple[int, bytes]]:
    """(group, answers) of a step."""
    rows = zip(*[table.column(c).to_pylist() for c in ("step", "part", "answers")], strict=True)
    return [(part, answers) for s, part, answers in rows if s == step]


def _in_doubt(left: pa.Table, right: pa.Table, exchange: Exchange) -> Bucket:
    bucket = Bucket(left)
    bucket.cut()
    keys, doubt = bucket.minimizers()
    places = exchange.group_of(keys)
    for group, answers in _told(right, 1):
        doubt[places[group]] |= np.frombuffer(answers, np.uint8) > 0
    bucket.doubted(keys, doubt)
    return bucket


def _stretches(one: Exchange, two: Exchange):
    """2. To each part the distinct stretches in doubt, by document."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return two.rows(0, np.zeros(0, np.uint64))
        bucket = _in_doubt(left, right, one)
        return two.rows(_number(left), bucket.small[bucket.first], Records(_bytes_of(bucket.content, bucket.doc[bucket.first])))

    return run


def _verdicts(hot: int):
    """Of each stretch: 1 if a smaller document has it too; 2 if it is the first of its content but its minimizer has other
    contents as well, 3 if it has more than `hot` of them; else 0."""

    def reply(small: np.ndarray, records: Records) -> tuple[np.ndarray]:
        one, two, doc = np.ascontiguousarray(records.fixed).view(np.int64).T
        order = np.lexsort((doc, two, one, small))
        s, a, b, d = small[order], one[order], two[order], doc[order]
        edge = np.concatenate(([True], s[1:] != s[:-1]))
        new = edge | np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        head = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
        begin = np.flatnonzero(edge)
        sizes = np.diff(np.append(begin, len(s)))
        contents = np.repeat(np.add.reduceat(new.astype(np.int64), begin), sizes)
        differ = np.repeat(np.maximum.reduceat(d, begin) > np.minimum.reduceat(d, begin), sizes)
        verdict = np.empty(len(s), np.uint8)
        verdict[order] = np.where(d > d[head], 1, np.where((contents > 1) & differ, np.where(contents > hot, 3, 2), 0))
        return (verdict,)

    return reply


def _texts(one: Exchange, two: Exchange, three: Exchange):
    """3. To each part the first occurrences in doubt. Their places, and the spans that are settled, are for the last step."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        told = _told(right, 2) if len(right) else []
        if not len(left) or not told:
            return three.rows(0, np.zeros(0, np.uint64)).append_column("extra", pa.array([], pa.binary()))
        bucket = _in_doubt(left, right, one)
        first, verdict = bucket.first, np.zeros(len(bucket.first), np.uint8)
        own = two.group_of(bucket.small[first])
        for group, answers in told:
            verdict[own[group]] = np.frombuffer(answers, np.uint8)
        of = verdict[bucket.which]
        gone = (bucket.doc > bucket.doc[first][bucket.which]) | (of == 1)
        settled = np.stack([bucket.starts[gone], bucket.counts[gone]], axis=1)
        places = np.flatnonzero(~gone & (of >= 2))  # all places of a stretch in doubt, in its own document
        at, rep, counts, hot = bucket.starts[places], bucket.which[places], bucket.counts[places], of[places] == 3
        key, offset = bucket.small[places], np.zeros(len(places), np.int64)
        if hot.any():  # a record for each window, dealt by all its bytes
            n = counts[hot]
            each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = np.repeat(at[hot], n) + each
            hashed, order = np.empty(len(start), np.uint64), np.argsort(start, kind="stable")
            hashed[order] = bucket.hashes(start[order], np.full(len(start), MATCH), _BASES[0]) & KEY
            add = lambda old, new: np.concatenate((old[~hot], new))
            at, rep, counts, key, offset = add(at, start), add(rep, np.repeat(rep[hot], n)), add(counts, np.ones(len(start), np.int64)), add(key, hashed), add(offset, each)
        order = np.lexsort((offset, rep))
        at, rep, counts, key, offset = at[order], rep[order], counts[order], key[order], offset[order]
        new = np.concatenate(([True], (np.diff(rep) != 0) | (np.diff(offset) != 0))) if len(at) else np.zeros(0, bool)
        owner, sizes = np.cumsum(new) - 1, counts[new] + (MATCH - 1)
        texts = bucket.text[np.repeat(at[new] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
        rows = three.rows(_number(left), key[new], Records(_bytes_of(bucket.doc[first[rep[new]]]), texts, sizes))
        local, group = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
        for g, x in three.group_of(key[new]).items():
            local[x], group[x] = np.arange(len(x)), g
        of_group = dealt(group[owner])
        extra = [_blob(np.stack([at[of_group[g]], local[owner[of_group[g]]]], axis=1)) for g in rows.column("part").to_pylist()]
        rows = rows.append_column("extra", pa.array(extra, pa.binary()))
        none = Records(np.zeros((0, 8), np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.int64)).pack()
        number = _number(left)
        last = {"part": [number % three.groups], "bucket": [number], "keys": [b""], "records": [none], "extra": [_blob(settled)]}
        return pa.concat_tables([rows, pa.table(last, schema=rows.schema)])

    return run


def _blob(pairs: np.ndarray) -> bytes:
    return zlib.compress(pairs.astype("<i4").tobytes(), 1)


def _factors(_: np.ndarray, records: Records) -> tuple[np.ndarray]:
    """Of each record a bit for each window that is covered."""
    counts = records.sizes - (MATCH - 1)
    if not len(counts):
        return (np.zeros(0, "<u4"),)
    begin = np.cumsum(records.sizes) - records.sizes
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    docs = np.ascontiguousarray(records.fixed).view(np.int64).ravel()
    covered = longest_previous_factors(records.text, np.repeat(begin, counts) + place, np.repeat(docs, counts)) >= MATCH
    return (np.bitwise_or.reduceat(np.where(covered, np.uint32(1) << place.astype(np.uint32), np.uint32(0)), np.cumsum(counts) - counts),)


def _last_pass(left: pa.Table, right: pa.Table) -> pa.Table:
    bucket = Bucket(left)
    change = np.zeros(len(bucket.text) + MATCH + 64, np.int32)

    def cover(starts: np.ndarray, counts: np.ndarray | int) -> None:
        np.add.at(change, starts, 1)
        np.add.at(change, starts + counts + (MATCH - 1), -1)

    for answers, extra in zip(right.column("answers").to_pylist(), right.column("extra").to_pylist(), strict=True):
        pairs = np.frombuffer(zlib.decompress(extra), "<i4").reshape(-1, 2).astype(np.int64)
        if not answers:  # settled: windows and how many
            cover(pairs[:, 0], pairs[:, 1])
            continue
        start, mask = pairs[:, 0], np.frombuffer(answers, "<u4")[pairs[:, 1]]
        for i in range(_SPAN):
            cover(start[(mask >> np.uint32(i)) & 1 == 1] + i, 1)
    gone = np.cumsum(change)[: len(bucket.text)] > 0
    kept, spans, sizes = [], [], []
    for a, b in zip(bucket.bounds[:-1].tolist(), bucket.bounds[1:].tolist(), strict=True):
        own, text = gone[a:b], bucket.text[a:b]
        edges = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0]))))
        spans.append(edges.tolist())
        kept.append(text[~own].tobytes() if len(edges) else text.tobytes())
        sizes.append(b - a)
    if "rest" in left.column_names:
        texts = [k.decode(errors="ignore") for k in kept]
        return pa.table({"rest": left.column("rest").take(pa.array(bucket.order, pa.int64())).combine_chunks(), "text": pa.array(texts, pa.string())})
    return pa.table({"id": pa.array(bucket.ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "spans": pa.array(spans, pa.list_(pa.int64())), "kept": pa.array(kept, pa.binary())})


def _idle(id_col: str, text_col: str) -> Column:
    """Rows that no match can touch."""
    return F.col(id_col).isNull() | F.col(text_col).isNull() | (F.octet_length(text_col) < MATCH)


def _run(docs: DataFrame, id_col: str, text_col: str, bucket_bytes: int, more: list, schema: str | T.StructType, hot: int = HOT, fan: int = FAN) -> DataFrame:
    docs = docs.filter(~_idle(id_col, text_col))
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets, keys, parts = (max(1, -(-total // size)) for size in (bucket_bytes, min(3 * bucket_bytes, KEY_BYTES), min(bucket_bytes, PART_BYTES)))
    one, two, three = Exchange(keys, fan=fan), Exchange(keys, 24, fan=fan), Exchange(parts, 8, True, fan, ("<u4",))
    key = F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)), F.lit(buckets))  # an id with many texts has them in many buckets
    given = docs.select(key.alias("bucket"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *more).groupBy("bucket")
    bits = one.answered(given.applyInArrow(releasing(_minimizers(one)), ROWS), _shared).withColumn("step", F.lit(1))
    stretches = given.cogroup(bits.groupBy("bucket")).applyInArrow(releasing(_stretches(one, two)), ROWS)
    told = bits.union(two.answered(stretches, _verdicts(hot)).withColumn("step", F.lit(2)))
    doubt = given.cogroup(told.groupBy("bucket")).applyInArrow(releasing(_texts(one, two, three)), ROWS + ", extra binary")
    return given.cogroup(three.answered(doubt, _factors).groupBy("bucket")).applyInArrow(releasing(_last_pass), schema)


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, hot: int = HOT, fan: int = FAN) -> DataFrame:
    """id, n_bytes, spans (start, end, start, end, ...: maximal removed runs of bytes) and kept (the bytes that are left).

    Null and empty texts have no bytes. Documents with one id are neither smaller nor larger than each other, so equal
    rows keep their texts; a null id takes no part and keeps its text. Rows that repeat id and text meet in one bucket.
    Other columns are not read; an empty table gives an empty result. kept may end inside a UTF-8 character, as matches are of bytes.
    """
    done = _run(docs, id_col, text_col, bucket_bytes, [], "id long, n_bytes long, spans array<long>, kept binary", hot, fan)
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    idle = docs.filter(_idle(id_col, text_col)).select(F.col(id_col).cast("long"), F.octet_length(data).cast("long"), F.array().cast("array<long>"), data)
    return done.union(idle).withColumnRenamed("id", id_col)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs with repeated passages taken out of the text, every other column as it is; characters that a cut breaks go too.
    A text with nothing left stays as an empty one; a null text stays null. The text is moved once, with its row."""
    others = [c for c in docs.columns if c != text_col]
    rest = F.struct(*map(column, others)).alias("rest")
    schema = T.StructType([docs.select(rest).schema["rest"], T.StructField("text", T.StringType())])
    done = _run(docs, id_col, text_col, bucket_bytes, [rest], schema)
    back = done.select(*[(F.col("text").alias(c) if c == text_col else F.col("rest")[c].alias(c)) for c in docs.columns])
    return back.union(docs.filter(_idle(id_col, text_col)))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return found.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
