"""BPE encoding with content-defined chunk reuse, and decoding.

A rolling hash over the last bytes of a text picks cut positions from content alone, so equal passages of different
documents fall into equal chunks wherever they stand. A worker encodes each distinct chunk once and takes its ids from
then on. A cut may fall anywhere, even inside a word: the join of two chunks is repaired by re-encoding a stretch that
reaches from a whole word before the cut to a whole word behind it. The ids of both words must agree with what the chunks
gave; where they don't, the stretch widens to the whole chunks, and at last to the whole text.

Stretches are encoded once each too, as equal passages have equal cuts. What is not yet known of a few texts is encoded
together: Latin-1 text by the file's merges as tiktoken ranks, which give the same ids in less time, other text by the
library. White space may be cut at only if the file's normalizer and pre-tokenizer are those stated below; this is
checked when a file is loaded, and under any other file texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semafold.llm.common import released, slices

#: A cut about every so many bytes (a power of two), from a hash of the last HASHED bytes.
CHUNK, HASHED = 256, 8
#: Bytes that a worker remembers (texts and ids of chunks and stretches) before it starts afresh; text that is encoded together.
MEMO_BYTES, TOGETHER = 48 << 20, 1 << 18
#: About what an entry takes besides its text and ids.
_ENTRY = 600
#: Python takes these for white space, the tokenizer doesn't: texts that hold one are encoded whole.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

# The pipeline of word-end BPE files that the fast path is right for.
_NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
# end of fixed values


def cut_positions(data: bytes, chunk: int = CHUNK) -> list[int]:
    """Byte positions after which a chunk ends: where the rolling hash of the HASHED bytes before it has its top bits zero."""
    if len(data) < HASHED:
        return []
    window = np.ndarray(len(data) - HASHED + 1, "<u8", data, strides=(1,))  # the last eight bytes as one number, rolled by one
    hashed = (window * _MULTIPLIER) >> np.uint64(64 - chunk.bit_length() + 1)
    return (np.flatnonzero(hashed == 0) + HASHED).tolist()


def chunks_of(text: str, chunk: int) -> list[str]:
    """The chunks of a text; a cut inside a character moves behind it."""
    data, out, last = text.encode(), [], 0
    for end in [*cut_positions(data, chunk), len(data)]:
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        if end > last:
            out.append(data[last:end].decode())
            last = end
    return out


def _merged(token: str, order: dict[tuple[str, str], int], limit: int) -> list[str]:
    """A token's letters after all merges before `limit`, the lowest first."""
    end = token.endswith("</w>")
    parts = list(token[:-4] if end else token)
    if end:
        parts[-1] += "</w>"
    while len(parts) > 2:
        best, at = min((order.get(pair, limit), i) for i, pair in enumerate(zip(parts[:-1], parts[1:], strict=True)))
        if best >= limit:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class LatinEncoder:
    """Ids of Latin-1 strings under word-end BPE merges, many strings at once.

    A pre-token's letters are the bytes of its UTF-8, the last of them in its word-end form. Each of these 512 letters is
    written as one character, whose own bytes merge before anything else; the file's merges follow in their order."""

    def __init__(self, spec: dict):
        import tiktoken

        vocab, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        small = range(97, 123)
        code = {(b, False): chr(b) if b in small else chr(0x100 + b) for b in range(256)} | {(b, True): chr(b - 32) if b in small else chr(0x200 + b) for b in range(256)}

        def written(token: str) -> str:
            end = token.endswith("</w>")
            body = [letters[c] for c in (token[:-4] if end else token)]
            return "".join(code[b, end and i == len(body) - 1] for i, b in enumerate(body))

        ranks = {bytes([b]): b for b in range(256)}
        self.ids = np.zeros(256 + 512 + len(merges) + 1, "<u4")
        for (b, end), c in code.items():
            token = next(k for k, v in letters.items() if v == b) + ("</w>" if end else "")
            self.ids[ranks.setdefault(c.encode(), len(ranks))] = vocab[token]
        order = {(a, b): i for i, (a, b) in enumerate(merges)}
        for i, (a, b) in enumerate(merges):
            if _merged(a + b, order, i) == [a, b]:  # a merge that its own token never comes to would be taken by other halves
                self.ids[ranks.setdefault(written(a + b).encode(), len(ranks))] = vocab[a + b]
        self.tokens = tiktoken.Encoding("word-ends", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={})
        ends = {i for t, i in vocab.items() if t.endswith("</w>")}
        self.ends = np.array([int(i) in ends for i in self.ids])
        every = [chr(i) for i in range(256)]
        self.kind = np.array([0 if c.isspace() else 1 if c.isalpha() else 2 if c.isnumeric() else 3 for c in every], np.uint8)
        self.last = np.array([[ord(code[c.encode()[-1], end]) for c in every] for end in (False, True)], "<u2")
        self.lead = np.array([ord(code[c.encode()[0], False]) for c in every], "<u2")

    def __call__(self, strings: list[str]) -> list[bytes]:
        text = np.frombuffer("\n".join([*strings, ""]).encode("latin-1"), np.uint8)
        kind = self.kind[text]
        follows = np.append(kind[1:], 0)
        end = (kind > 0) & ((kind != follows) | (kind == 2))
        quote = np.flatnonzero(text == 39)
        for p in quote[(quote == 0) | (kind[quote - 1] != 3)].tolist():  # 's and its like are pre-tokens of their own
            tail = bytes(text[p + 1 : p + 3])
            n = 1 if tail[:1] in (b"s", b"t", b"m", b"d") else 2 if tail in (b"re", b"ve", b"ll") else 0
            if n:
                end[p], end[p + n] = False, True
        wide = text >= 128
        at = np.cumsum(1 + wide) - 1
        codes = np.empty(int(at[-1]) + 1 if len(at) else 0, "<u2")
        codes[at] = np.where(kind > 0, self.last[end.astype(np.intp), text], 32)
        codes[at[wide] - 1] = np.where(kind[wide] > 0, self.lead[text[wide]], 32)
        # a pre-token ends where its word-end letter stands: a space there keeps neighbours apart
        spaced = np.insert(codes, at[end] + 1, 32).tobytes().decode("utf-16-le")
        ranks = np.array(self.tokens.encode_ordinary(spaced), np.int64)
        ids = self.ids[ranks]
        size = np.fromiter(map(len, strings), np.int64, len(strings))
        stops = np.cumsum(size + 1)
        done = np.concatenate(([0], np.cumsum(end)))[stops]  # pre-tokens up to the end of each string
        closes = np.concatenate(([0], np.flatnonzero(self.ends[ranks]) + 1))
        cuts = [0, *closes[done].tolist()]
        data = ids.tobytes()
        return [data[4 * a : 4 * b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class ChunkEncoder:
    """Ids and decoded text as the tokenizers library gives them with add_special_tokens=False, skip_special_tokens=False.

    encoded, reused: bytes of chunks that were encoded, and that were known; widened: joins whose first repair did not agree."""

    def __init__(self, path: str, chunk: int = CHUNK):
        from tokenizers import Tokenizer

        self.tokenizer, self.chunk = Tokenizer.from_file(path), chunk
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.tokens = np.full(max(vocab.values()) + 1, "", object)
        for t, i in vocab.items():
            self.tokens[i] = t
        spec = json.loads(self.tokenizer.to_str())
        stages = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        word_ends = spec["model"].get("end_of_word_suffix") == "</w>" and not spec["model"].get("ignore_merges") and not spec["model"].get("continuing_subword_prefix")
        plain = spec["normalizer"] == _NORMAL and stages[0].get("pattern") == {"Regex": _SPLIT} and stages[0].get("invert") and stages[0].get("behavior") == "Removed" and len(stages) == 2
        self.latin = LatinEncoder(spec) if word_ends and plain and stages[1].get("type") == "ByteLevel" and not stages[1].get("add_prefix_space") and not stages[1].get("use_regex") else None
        self.chunks: dict[str, list] = {}
        self.joins: dict[str, bytes] = {}
        self.held = self.encoded = self.reused = self.widened = 0

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def strings(self, strings: list[str]) -> list[bytes]:
        """Ids of strings, encoded together."""
        fast = [not s or max(s) < "Ā" for s in strings]
        quick = iter(self.latin([s.lower() for s, f in zip(strings, fast, strict=True) if f])) if any(fast) else iter(())
        slow = iter(self.tokenizer.encode_batch_fast([s for s, f in zip(strings, fast, strict=True) if not f], add_special_tokens=False)) if not all(fast) else iter(())
        return [next(quick) if f else np.array(next(slow).ids, "<u4").tobytes() for f in fast]

    @staticmethod
    def _parted(piece: str) -> list[str]:
        """A chunk as the part before its first white space, a word, what lies between, a word, and the part behind its last white space.

        Fewer than two words inside: everything is the first part, and joins reach beyond the chunk."""
        words = piece.split()
        inner = words[(not piece[0].isspace()) : len(words) - (not piece[-1].isspace())]
        if len(inner) < 2:
            return [piece, "", "", "", ""]
        head, tail = ("" if piece[0].isspace() else words[0]), ("" if piece[-1].isspace() else words[-1])
        return [head, inner[0], " ".join(inner[1:-1]), inner[-1], tail]

    def _learn(self, texts: list[list[str]]) -> None:
        """Encode the chunks, and the stretches over cuts, that are not known yet."""
        pieces = [p for t in texts for p in t]
        new = {p: self._parted(p) for p in dict.fromkeys(pieces) if p not in self.chunks}
        self.encoded += sum(map(len, new))
        self.reused += sum(map(len, pieces)) - sum(map(len, new))
        parts = {p: new[p] if p in new else self.chunks[p][0] for p in dict.fromkeys(pieces)}
        stretches = dict.fromkeys(s for t in texts for _, s, _ in _stretches(t, parts) if s not in self.joins)
        strings = [x for five in new.values() for x in five] + list(stretches)
        found = self.strings(strings)
        for i, (p, five) in enumerate(new.items()):
            self.chunks[p] = [five, found[5 * i : 5 * i + 5]]
        self.joins |= zip(stretches, found[5 * len(new) :], strict=True)
        self.held += sum(map(len, found)) + sum(map(len, strings)) + _ENTRY * (len(new) + len(stretches))

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Whole texts' ids, a few texts' new chunks at a time."""
        run: list[list[str] | str] = []
        size = 0
        for text in texts:
            odd = self.latin is None or any(s in text for s in self.special) or _SEPARATORS.search(text)
            run.append(text if odd else chunks_of(text, self.chunk))
            size += len(text)
            if size > TOGETHER:
                yield from self._encoded(run)
                run, size = [], 0
        yield from self._encoded(run)

    def encode(self, text: str) -> bytes:
        return next(iter(self.encode_all([text])))

    def _encoded(self, run: list[list[str] | str]) -> Iterator[bytes]:
        self._learn([t for t in run if isinstance(t, list)])
        for t in run:
            yield self.whole(t) if isinstance(t, str) else self._joined(t)
        if self.held > MEMO_BYTES:
            self.chunks, self.joins, self.held = {}, {}, 0

    def _joined(self, pieces: list[str]) -> bytes:
        """The ids of a text's chunks with every join repaired."""
        parts = {p: self.chunks[p][0] for p in pieces}
        out: list[bytes] = []
        for left, stretch, right in _stretches(pieces, parts):
            got = self.joins[stretch]
            before = self.chunks[left][1][3] if left is not None else b""
            behind = self.chunks[right][1][1] if right is not None else b""
            if not (got.startswith(before) and got.endswith(behind) and len(got) >= len(before) + len(behind)):
                self.widened += 1
                return self._widened(pieces)
            out.append(got)
            if right is not None:
                out.append(self.chunks[right][1][2])
        return b"".join(out)

    def _widened(self, pieces: list[str]) -> bytes:
        """Two chunks at a time re-encoded whole, as far as they agree with the chunk that follows; else the whole text."""
        text = "".join(pieces)
        for size in (4, 16):
            grouped = ["".join(pieces[i : i + size]) for i in range(0, len(pieces), size)]
            if len(grouped) < 2:
                break
            parts = {p: self._parted(p) for p in grouped}
            ids = {p: self.strings(five) for p, five in parts.items()}
            out = []
            for left, stretch, right in _stretches(grouped, parts):
                got = self.strings([stretch])[0]
                before, behind = ids[left][3] if left is not None else b"", ids[right][1] if right is not None else b""
                if not (got.startswith(before) and got.endswith(behind)):
                    break
                out += [got, ids[right][2] if right is not None else b""]
            else:
                return b"".join(out)
        return self.whole(text)

    def decode(self, ids: bytes) -> str:
        """decode(ids): without a decoder in the file, the tokens with a space between them."""
        return " ".join(self.tokens[np.frombuffer(ids, "<u4")])


def _stretches(pieces: list[str], parts: dict[str, list[str]]) -> Iterator[tuple[str | None, str, str | None]]:
    """(chunk before, stretch, chunk behind) of each join: from the last whole word of one chunk to the first of the next that
    has one. None stands for the text's begin and end, where the stretch is what is left there."""
    left, open_ = None, ""
    for p in pieces:
        head, first, _, last, tail = parts[p]
        if not first:  # too short to close the stretch
            open_ += p
            continue
        yield left, f"{open_}{head} {first}", p
        left, open_ = p, f"{last} {tail}"
    yield left, open_, None


_ENCODERS: dict[tuple[str, int], ChunkEncoder] = {}


def encoder(path: str, chunk: int = CHUNK) -> ChunkEncoder:
    """One a worker process, so that what it knows outlives a batch."""
    if (path, chunk) not in _ENCODERS:
        _ENCODERS[path, chunk] = ChunkEncoder(path, chunk)
    return _ENCODERS[path, chunk]


def _mapped(docs: DataFrame, tokenizer: str, of, schema: str, kinds: list, id_col: str, text_col: str, chunk: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer, chunk)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            columns = list(zip(*[of(e, ids) for ids in e.encode_all(texts)], strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["id", *[f"c{i}" for i in range(len(kinds))]])
        released()

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"id long, {schema}")


def encode_texts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """id and ids (array<long>) of every text; null and empty texts have none. Repeated rows and null ids are rows like any
    other, other columns are not read, an empty table gives an empty result."""
    of = lambda _, ids: (np.frombuffer(ids, "<u4").astype(np.int64),)
    return _mapped(docs, tokenizer, of, "c0 array<long>", [pa.list_(pa.int64())], id_col, text_col, chunk).toDF(id_col, "ids")


def decode_ids(rows: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and the text that its ids decode to; null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        for batch in slices(batches):
            texts = [e.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("id"), ids_col).mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass over the texts, without a shuffle."""

    def of(e: ChunkEncoder, ids: bytes) -> tuple:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(e.decode(ids).encode()).hexdigest()

    kinds = [pa.int64(), pa.string(), pa.string()]
    out = _mapped(docs, tokenizer, of, "c0 long, c1 string, c2 string", kinds, id_col, text_col, chunk)
    return out.toDF(id_col, "n_tokens", "ids_sha256", "decoded_sha256")


def op8_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
