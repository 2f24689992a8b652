"""Questions that buckets of documents ask of parts of a hash space, and the answers in the order asked.

A row is all that one bucket asks of one part: keys, and a record for each. Were every bucket to send a row to every part,
the rows would grow with the square of the input. So a bucket sends to FAN groups of parts at most; where there are more
parts than that, the rows of FAN buckets are put together and dealt on to the parts of a group. Answers come back the
same way. A row then carries kilobytes at any size, and what moves stays in proportion to the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semafold.llm.common import dealt, releasing

#: Groups of parts that a bucket sends to, and buckets that are put together.
FAN = 1024
#: Keys are 48 bits of a hash.
KEY = np.uint64((1 << 48) - 1)
ROWS = "part long, bucket long, keys binary, records binary"
SUB_ROWS = "part long, bucket long, sub long, keys binary, records binary"


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as the first and the steps to the next ones, which take four bytes but for rare exceptions."""
    if not len(keys):
        return b""
    steps = np.diff(keys)
    width = 4 if not len(steps) or steps.max() < 1 << 32 else 8
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + steps.astype(f"<u{width}").tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    return np.cumsum(np.concatenate((np.frombuffer(data, "<u8", 1, 1), np.frombuffer(data, f"<u{data[0]}", -1, 9))), dtype=np.uint64)


@dataclass
class Records:
    """fixed: a row of bytes each. text, sizes: the records' strings of up to 255 bytes end to end, if they have any."""

    fixed: np.ndarray
    text: np.ndarray | None = None
    sizes: np.ndarray | None = None

    def pack(self) -> bytes:
        head = self.fixed.tobytes()
        return head if self.text is None else head + self.sizes.astype("u1").tobytes() + zlib.compress(self.text.tobytes(), 1)

    @staticmethod
    def unpack(n: int, data: bytes, width: int, texts: bool) -> Records:
        fixed = np.frombuffer(data, np.uint8, n * width).reshape(n, width)
        if not texts:
            return Records(fixed)
        at = n * (width + 1)
        return Records(fixed, np.frombuffer(zlib.decompress(data[at:]), np.uint8), np.frombuffer(data, np.uint8, n, n * width).astype(np.int64))

    def take(self, at: np.ndarray) -> Records:
        if self.text is None:
            return Records(self.fixed[at])
        begin, sizes = (np.cumsum(self.sizes) - self.sizes)[at], self.sizes[at]
        where = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return Records(self.fixed[at], self.text[where], sizes)

    @staticmethod
    def joined(many: list[Records]) -> Records:
        fixed = np.concatenate([r.fixed for r in many])
        return Records(fixed) if many[0].text is None else Records(fixed, np.concatenate([r.text for r in many]), np.concatenate([r.sizes for r in many]))


@dataclass(frozen=True)
class Exchange:
    """parts: parts of the hash space. width: bytes of a record. texts: whether records have strings. answers: kinds of the columns
    that answer a record."""

    parts: int
    width: int = 0
    texts: bool = False
    fan: int = FAN
    answers: tuple[str, ...] = ("u1",)

    @property
    def groups(self) -> int:
        return min(self.parts, self.fan)

    @property
    def subs(self) -> int:
        """Parts of a group."""
        return -(-self.parts // self.groups)

    def group_of(self, keys: np.ndarray) -> dict[int, np.ndarray]:
        """For each group that any key belongs to, the places of its keys, in their order."""
        order = np.argsort(keys, kind="stable")
        return {g: order[at] for g, at in dealt((keys[order] % np.uint64(self.groups)).astype(np.int64)).items()}

    def sub_of(self, keys: np.ndarray) -> dict[int, np.ndarray]:
        """For each part of the keys' group that any key belongs to, the places of its keys, in their order."""
        order = np.argsort(keys, kind="stable")
        return {s: order[at] for s, at in dealt((keys[order] // np.uint64(self.groups) % np.uint64(self.subs)).astype(np.int64)).items()}

    def packed_keys(self, keys: np.ndarray) -> bytes:
        """Keys of one group: what is left of them beside the group."""
        return pack_keys(keys // np.uint64(self.groups))

    def keys_of(self, table: pa.Table) -> list[np.ndarray]:
        rows = zip(table.column("keys").to_pylist(), table.column("part").to_pylist(), strict=True)
        return [unpack_keys(x) * np.uint64(self.groups) + np.uint64(g) for x, g in rows]

    def rows(self, bucket: int, keys: np.ndarray, records: Records | None = None) -> pa.Table:
        """A bucket's questions, a row for each group."""
        records = records or Records(np.zeros((len(keys), 0), np.uint8))
        found = [(g, bucket, self.packed_keys(keys[at]), records.take(at).pack()) for g, at in self.group_of(keys).items()]
        kinds = {"part": pa.int64(), "bucket": pa.int64(), "keys": pa.binary(), "records": pa.binary()}
        return pa.table({k: pa.array([r[i] for r in found], kind) for i, (k, kind) in enumerate(kinds.items())})

    def read(self, table: pa.Table) -> tuple[np.ndarray, Records, np.ndarray]:
        """Keys and records of all rows, and where each row ends."""
        keys = self.keys_of(table)
        held = [Records.unpack(len(k), x, self.width, self.texts) for k, x in zip(keys, table.column("records").to_pylist(), strict=True)]
        return np.concatenate(keys), Records.joined(held), np.cumsum([len(k) for k in keys])

    def dealt_on(self, table: pa.Table, region: int, keys: np.ndarray, records: Records) -> pa.Table:
        """Rows for the parts of a group; `bucket` is the region then."""
        group = table.column("part")[0].as_py()
        out = [(group, region, s, self.packed_keys(keys[at]), records.take(at).pack()) for s, at in self.sub_of(keys).items()]
        kinds = {"part": pa.int64(), "bucket": pa.int64(), "sub": pa.int64(), "keys": pa.binary(), "records": pa.binary()}
        return pa.table({k: pa.array([r[i] for r in out], kind) for i, (k, kind) in enumerate(kinds.items())})

    def columns(self, data: bytes, n: int) -> list[np.ndarray]:
        """The columns of n answers."""
        sizes = [np.dtype(k).itemsize for k in self.answers]
        return [np.frombuffer(data, k, n, n * sum(sizes[:i])) for i, k in enumerate(self.answers)]

    def packed(self, columns: tuple[np.ndarray, ...], ends: np.ndarray) -> list[bytes]:
        """Answers cut at the ends of rows, the columns of a row one after the other."""
        parts = [np.split(c.astype(k), ends[:-1]) for c, k in zip(columns, self.answers, strict=True)]
        return [b"".join(x.tobytes() for x in row) for row in zip(*parts, strict=True)]

    def answered(self, rows: DataFrame, reply: Callable, held: DataFrame | None = None, shares: int = 1) -> DataFrame:
        """bucket, part (the group), answers: what reply(keys, records[, table of what the part holds]) gives, a tuple of columns.

        A column `extra` of the rows, which only the bucket itself has use for, comes back beside its answers.
        held: what each part knows (columns part, sub and its own); shares: tasks that a part's questions are dealt to."""
        far = self.subs > 1
        sent = self._together(rows) if far else rows.withColumn("sub", F.lit(0).cast("long"))
        sent = sent.withColumn("share", F.pmod(F.col("bucket"), F.lit(shares)))

        def told(asked: pa.Table, known: pa.Table | None = None) -> pa.Table:
            out: list[bytes] = []
            if len(asked):
                keys, records, ends = self.read(asked)
                out = self.packed(reply(keys, records) if known is None else reply(keys, records, known), ends)
            return asked.select(["bucket", "part", "sub", *extra]).append_column("answers", pa.array(out, pa.binary()))

        extra = ["extra"] if not far and "extra" in rows.columns else []
        by, schema = ["part", "sub", "share"], "bucket long, part long, sub long, " + "extra binary, " * len(extra) + "answers binary"
        if held is None:
            found = sent.groupBy(*by).applyInArrow(releasing(lambda asked: told(asked)), schema)
        else:
            held = held.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
            found = sent.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(releasing(lambda asked, known: told(asked, known)), schema)
        return self._apart(rows, found) if far else found.drop("sub")

    def region(self, rows: DataFrame) -> DataFrame:
        """With the region of each row's bucket."""
        return rows.withColumn("region", F.floor(F.col("bucket") / self.fan).cast("long"))

    def _together(self, rows: DataFrame) -> DataFrame:
        """The rows of a region's buckets to a group, dealt to the group's parts; `bucket` is the region then."""

        def run(table: pa.Table) -> pa.Table:
            keys, records, _ = self.read(table.sort_by("bucket"))
            return self.dealt_on(table, table.column("region")[0].as_py(), keys, records)

        return self.region(rows).groupBy("part", "region").applyInArrow(releasing(run), SUB_ROWS)

    def _apart(self, rows: DataFrame, found: DataFrame) -> DataFrame:
        """A region's answers back to its buckets, each in the order it asked."""

        def run(asked: pa.Table, answers: pa.Table) -> pa.Table:
            out: list[bytes] = []
            if len(asked):
                asked = asked.sort_by("bucket")
                each = self.keys_of(asked)
                sizes, keys = [len(x) for x in each], np.concatenate(each)
                places = self.sub_of(keys)
                data = dict(zip(answers.column("sub").to_pylist(), answers.column("answers").to_pylist(), strict=True))
                whole = tuple(np.empty(len(keys), k) for k in self.answers)
                for s, at in places.items():
                    for into, column in zip(whole, self.columns(data[s], len(at)), strict=True):
                        into[at] = column
                out = self.packed(whole, np.cumsum(sizes))
            return asked.select(["bucket", "part", *extra]).append_column("answers", pa.array(out, pa.binary()))

        extra = ["extra"] if "extra" in rows.columns else []
        back = found.withColumnRenamed("bucket", "region")
        schema = "bucket long, part long, " + "extra binary, " * len(extra) + "answers binary"
        return self.region(rows).groupBy("part", "region").cogroup(back.groupBy("part", "region")).applyInArrow(releasing(run), schema)
