"""Best-fit-decreasing packing of token sequences into windows.

Overlong documents are first cut into full windows. What remains of each document, longest first, goes to the tightest
open window: a segment tree whose leaves are the remaining capacities answers "smallest capacity that still fits" in
log2(window) steps. Only lengths and checksums are shuffled, never text or ids, and each task packs its own share.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semafold.llm.common import released, slices

WINDOW = 1024
#: Pieces that one task packs at most, but for chance. A share of this size leaves well under one window in a hundred unfilled.
SHARE = 20_000
#: Bytes of pieces of text, with what comes with each, that a worker remembers before it starts afresh.
MEMO_BYTES, _ENTRY = 48 << 20, 160
_SPACES = re.compile(r"\s (?:\s|\Z)")


class CapacityTree:
    """Open windows by remaining capacity: a segment tree over capacities 0..size, each leaf a stack of windows."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, capacity: int, by: int) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def push(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        self._add(capacity, 1)

    def tightest(self, need: int) -> int | None:
        """The smallest capacity of at least need that an open window has."""
        at = need + self.leaves
        if self.count[at]:
            return need
        while at > 1:  # up while there is nothing to the right
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.leaves:  # down to the leftmost
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None

    def pop(self, capacity: int) -> int:
        self._add(capacity, -1)
        return self.windows[capacity].pop()


def best_fit_decreasing(lengths: Iterable[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """For each length (1..window, in falling order) its window and its offset there. A tie goes to the window opened or used last."""
    tree, used, places, offsets = CapacityTree(window), [], [], []
    for n in lengths:
        if (room := tree.tightest(n)) is None:
            at, room = len(used), window
            used.append(0)
        else:
            at = tree.pop(room)
        places.append(at)
        offsets.append(used[at])
        used[at] += n
        if room > n:
            tree.push(room - n, at)
    return places, offsets


#: The split pattern of byte-level BPE files (fixed value; public_tokenizers.PATTERN states it too).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder:
    """Ids of a text under a byte-level BPE file of the tokenizers library, as little-endian uint32 bytes.

    Pieces between single spaces encode independently of their neighbours under this pre-tokenizer, so a worker encodes
    each distinct piece once: Latin pieces by tiktoken under the same vocabulary as ranks (the ids agree, it is faster),
    others by the tokenizers library. Texts with white space on both sides of a space, or with the text of an added
    token, are encoded whole by the library. memo: bytes of pieces that are remembered.
    """

    def __init__(self, path: str, memo: int = MEMO_BYTES):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.memo, self.known, self.held = Tokenizer.from_file(path), memo, {}, 0
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder()
        self.special, letters = [t.content for t in added.values()], _byte_letters()
        ranks = {bytes(letters[c] for c in t): i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if i not in added}
        self.latin = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if _SPACES.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        first, *words = text.split(" ")
        known = self.known  # ids of each word with the space before it
        if self.held > self.memo:
            known.clear()
            self.held = 0
        for x in set(words).difference(known):
            got = known[x] = self.piece(" " + x)
            self.held += len(x) + len(got) + _ENTRY
        return self.piece(first) + b"".join(map(known.__getitem__, words))

    def piece(self, x: str) -> bytes:
        return array("I", self.latin.encode_ordinary(x)).tobytes() if not x or max(x) < "\u0250" else self.whole(x)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One a worker process, so that what it knows outlives a batch."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECE + ", sequence_id long, offset long"


def cut(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Pieces of each document: full windows and the rest. ids adds the pieces' ids as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = encode(text or "") + end
                n = len(data) // 4
                for at in range(0, n, window):
                    part = data[4 * at : 4 * (at + window)]
                    rows.append((doc, at, len(part) // 4, zlib.crc32(part), n, *((np.frombuffer(part, "<u4"),) if ids else ())))
            columns = list(zip(*rows, strict=True)) or [()] * (6 if ids else 5)
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if ids:
                arrays.append(pa.array([x.astype(np.int64) for x in columns[5]], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)
        released()

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, PIECE + (", ids array<long>" if ids else ""))


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """pieces (doc_id, start, length, ...) with sequence_id and offset, gapless from 0 within a sequence of at most window.

    A task packs the pieces of its partition, so a caller deals them out. It sorts by falling length (ties by doc_id, start
    and checksum), so a rerun packs alike. Repeated or null doc_ids are pieces like any other; no piece is dropped. At most
    one sequence of a task is at most half full, so padding is under half of all; of pieces as short as a few hundred
    tokens on average it is a few in ten thousand. Sequences of a power-of-two length need no padding and are not padded.
    """
    columns = pieces.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [f for f in frames if len(f)]
        if not frames:
            return
        frame = pd.concat(frames).sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable", na_position="first")
        places, offsets = best_fit_decreasing(frame["length"].tolist(), window)
        frame["sequence_id"] = (TaskContext.get().partitionId() << 40) + np.array(places, np.int64)
        frame["offset"] = np.array(offsets, np.int64)
        for at in range(0, len(frame), 10_000):
            yield frame.iloc[at : at + 10_000]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return pieces.select(*columns).mapInPandas(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, share: int = SHARE, ids: bool = False, **columns: str) -> DataFrame:
    """cut() and pack(). Null and empty texts are the end id alone; an empty table gives an empty result; other columns are not read.

    A text has no more ids than bytes and the end, which bounds its pieces: shares are as many as `share` pieces each need.
    Pieces are dealt by document, start and checksum, so neither a long document nor an id (or null) with many rows makes one heavy.
    """
    text = columns.get("text_col", "text")
    most = docs.agg(F.sum(F.ceil((F.coalesce(F.octet_length(text), F.lit(0)) + 1) / window))).first()[0] or 0
    pieces = cut(docs, tokenizer, window, ids=ids, **columns)
    return pack(pieces.repartition(max(1, -(-int(most) // share)), "doc_id", "start", "ids_crc32"), window)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
