"""Toxicity of texts behind a noisy channel.

Spelling tricks (leetspeak, letters spaced out or repeated, separators, look-alike letters) are undone before anything is
scored: a suspicious token is a lattice of what each character may stand for, and a Viterbi search under a character
language model of the corpus finds its best readings. Adjacent pieces that make up a word of the lexicon are read as that
word where the model likes it better than the pieces. Restored words and their beginnings are then looked up in a lexicon of
evidence that was learned from labelled texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semafold.llm.common import column, fresh, materialise, released, slices, text_bytes
from semafold.llm.shingles import mix, shingle_set

#: Labelled rows that the lexicon is learned from, by a hash of the id. This bounds what a driver or worker holds: an entry
#: needs several toxic texts of the sample, so there are a few times fewer entries than the sampled toxic texts have words.
SAMPLE = 24_000
#: Beginnings of words that are evidence too, by length; readings of a token that are looked up.
PREFIXES, READINGS = (4, 5, 6), 4
#: Min-hashes of a labelled text; texts that share one count once.
SKETCHES = 6
#: Features expected by chance to reach even odds; score of a text without evidence.
BY_CHANCE, NO_EVIDENCE = 0.2, 0.02
#: Log probability that a separator or a space was put in; readings of doubled letters that are looked up; evidence of words that are put together.
DROPPED, DOUBLED_READINGS, INNER = -1.0, 64, 0.3
#: Bytes of tokens, with what comes with each, whose evidence a worker remembers.
MEMO_BYTES, _ENTRY = 24 << 20, 120

# What a character may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
LOOKALIKE = {"а": "a", "е": "e", "і": "i", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "ј": "j", "ԁ": "d", "α": "a", "ο": "o", "ι": "i"}
HIDDEN = str.maketrans("", "", "­​‌‍⁠﻿")
# end of fixed values

_SUSPICIOUS = re.compile("[" + re.escape("".join([*LEET, *LOOKALIKE])) + "­​‌‍⁠﻿]|(.)\\1\\1|[^\\W\\d_][.\\-_*~]+[^\\W\\d_]")
_SEPARATED = re.compile(r"(?:[^\s.\-_*~][.\-_*~]+){2,}[^\s.\-_*~]")
_RUN, _ALL_DOUBLED = re.compile(r"([^\W\d_])\1+"), re.compile(r"(?:([^\W\d_])\1+){3,}")
_TRIPLE = re.compile(r"(.)\1\1")
_ALL_PAIRS = re.compile(r"(?:([^\W\d_])\1+)+")
_EDGES, _SEPARATORS = "!.,;:?\"'()[]{}%&#*~-_<>=", ".-_*~"
_WORD = re.compile(r"[^\W\d_]+")
LETTERS = 27  # a to z, and anything else


_LETTER = np.zeros(256, np.int32)
_LETTER[97:123] = np.arange(1, 27)


def letter_counts(data: bytes, strip: int = 1 << 18) -> np.ndarray:
    """Counts of letter triples (27 cubed) of a text, in strips so that memory doesn't follow its length."""
    out = np.zeros(LETTERS**3, np.int64)
    for at in range(0, len(data) - 2, strip):
        c = _LETTER[np.frombuffer(data[at : at + strip + 2].lower(), np.uint8)]
        out += np.bincount(c[:-2] * 729 + c[1:-1] * 27 + c[2:], minlength=LETTERS**3)
    return out


def learn_letters(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """log probabilities of a letter after two others, of all texts. A task sends a row for each of at most 27 cubed triples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**3, np.int64)
        for batch in batches:
            for held in range(0, batch.num_rows, 256):
                total += letter_counts(b"  ".join([b"", *text_bytes(batch.slice(held, 256), "text"), b""]))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["at", "n"])

    counts = np.zeros(LETTERS**3)
    for at, n in docs.select(F.col(text_col).alias("text")).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n")).collect():
        counts[at] = n
    cube = counts.reshape(LETTERS, LETTERS, LETTERS)
    pair = cube.sum(axis=0)
    one = (pair + 0.5) / (pair + 0.5).sum(axis=1, keepdims=True)
    return np.log((cube + 5 * one[None]) / (cube.sum(axis=2, keepdims=True) + 5))


def _letter(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 0


def lattice(token: str, drop: bool = True) -> list[list[tuple[str, float]]]:
    """For each run of one character the strings it may stand for, with log probabilities of the channel; with drop, separators may stand for nothing."""
    out, at = [], 0
    while at < len(token):
        c, n = token[at], 1
        while at + n < len(token) and token[at + n] == c:
            n += 1
        at += n
        singles = [(LOOKALIKE[c], 0.0)] if c in LOOKALIKE else [(x, -1.0) for x in LEET[c]] + [(c, -2.5)] if c in LEET else [(c, 0.0)]
        if drop and c in _SEPARATORS:
            out.append([(c, 0.0), ("", DROPPED)])
        elif n == 1:
            out.append(singles)
        else:
            out.append([(x * 2, p - 0.7) for x, p in singles] + [(x, p - 0.9) for x, p in singles])
    return out


def spelled(text: str, letters: np.ndarray) -> float:
    """Log probability of a text between spaces."""
    out, x, y = 0.0, 0, 0
    for c in f"{text} ":
        z = _letter(c)
        out += letters[x, y, z]
        x, y = y, z
    return out


def readings(token: str, letters: np.ndarray, most: int = READINGS, drop: bool = True) -> list[str]:
    """The best readings of a token: a Viterbi search over (last two letters) that keeps `most` paths a state."""
    states: dict[tuple[int, int], list[tuple[float, str]]] = {(0, 0): [(0.0, "")]}
    for options in [*lattice(token, drop), [(" ", 0.0)]]:
        nexts: dict[tuple[int, int], list[tuple[float, str]]] = {}
        for (a, b), paths in states.items():
            for text, cost in options:
                x, y = a, b
                for c in text:
                    z = _letter(c)
                    cost += letters[x, y, z]
                    x, y = y, z
                nexts.setdefault((x, y), []).extend((p + cost, s + text) for p, s in paths)
        states = {k: sorted(v, reverse=True)[:most] for k, v in nexts.items()}
    found = sorted((x for v in states.values() for x in v), reverse=True)
    return list(dict.fromkeys(s.strip() for _, s in found))[:most]


def plain(word: str) -> str | None:
    """A word of Latin-1 letters, with no run of three and not doubled throughout, stands for itself: its letters without runs. None for others."""
    if not word.isalpha() or max(word) >= "Ā":
        return None
    if not _RUN.search(word):
        return word
    single = _RUN.sub(r"\1", word)
    return single if 2 * len(single) > len(word) and not _TRIPLE.search(word) else None


def restore(token: str, letters: np.ndarray) -> list[str]:
    """Readings of a lower-cased token; itself alone unless it is suspicious."""
    if plain(token := token.strip(_EDGES)) is not None:
        return [token]
    token = token.translate(HIDDEN).strip(_EDGES)
    if not token or not (_SUSPICIOUS.search(token) or _ALL_DOUBLED.fullmatch(token)):
        return [token]
    if _SEPARATED.fullmatch(token):
        token = re.sub(r"[.\-_*~]", "", token)
    if not any(c.isalpha() for c in token) and len(token) <= 3:
        return [token]
    found = readings(token, letters)
    if any(c in _SEPARATORS for c in token):
        found += readings(token, letters, drop=False)  # the words between separators stay evidence
    return list(dict.fromkeys(found))


def features(word: str) -> list[str]:
    """A word and its beginnings."""
    out = []
    for w in _WORD.findall(word):
        if len(w) > 2:
            out.append(w)
            out += [f"{w[:n]}*" for n in PREFIXES if len(w) > n]
    return out


def spaced_out(tokens: list[str]) -> list[str]:
    """Runs of four or more tokens of one character, each run as one token."""
    out, run = [], []
    for t in [*[t if len(t) == 1 else "" for t in tokens], ""]:
        if t:
            run.append(t)
        else:
            if len(run) >= 4:
                out.append("".join(run))
            run = []
    return out


class Evidence:
    """How far a text's restored words speak for toxicity, under a learned lexicon."""

    def __init__(self, letters: np.ndarray, lexicon: dict[str, float]):
        self.letters, self.lexicon, self.known = letters, lexicon, {}
        self.whole = {w for w, p in lexicon.items() if p >= INNER and not w.endswith("*")}
        self.inner = [w for w in self.whole if len(w) > 3]
        self.starts = {w[:n] for w in self.whole for n in range(1, len(w))}
        self.longest = max(map(len, self.whole), default=0)
        self.heads = {f[:3] for f in lexicon}
        self.squeezed = {_RUN.sub(r"\1", w) for w in self.whole}
        self.formed, self.begins, self.held = {}, {}, 0

    def of(self, token: str) -> float:
        got = self.known.get(token)
        if got is not None:
            return got
        single = plain(word := token.strip(_EDGES))
        if single is not None and (len(single) == len(word) or single not in self.squeezed):
            got = self.known[token] = max([self.lexicon[f] for f in features(word) if f in self.lexicon], default=0.0) if word[:3] in self.heads else 0.0
            self.held += len(token) + _ENTRY
            if word in self.starts and len(token) <= 2 * self.longest:
                self.begins[token] = [word]
        else:
            found = [self.lexicon.get(f, 0.0) for r in restore(token, self.letters) for f in features(r)]
            if _RUN.search(token):
                for w in _WORD.findall(token):
                    if _RUN.search(w) and _RUN.sub(r"\1", w) in self.squeezed:
                        found += [self.lexicon[r] for r in readings(w, self.letters, DOUBLED_READINGS) if r in self.whole]
            got = self.known[token] = max(found, default=0.0)
            self.held += len(token) + _ENTRY
            if begins := [f for f in self.forms(token) if f in self.starts]:
                self.begins[token] = begins
        return got

    def forms(self, token: str) -> list[str]:
        """What a token may be as a piece of a word."""
        got = self.formed.get(token)
        if got is None:
            piece = token.translate(HIDDEN).strip(_EDGES) if len(token) <= 2 * self.longest else ""
            if not piece or not (_SUSPICIOUS.search(piece) or _ALL_PAIRS.fullmatch(piece)):
                return [piece] if piece else []
            got = self.formed[token] = readings(piece, self.letters)
            self.held += (1 + READINGS) * (len(token) + _ENTRY)
        return got

    def across(self, tokens: list[str]) -> set[str]:
        """Words of the lexicon that adjacent tokens make up, where the letters speak for the word rather than its pieces."""
        out = set()
        for i in [i for i, t in enumerate(tokens) if t in self.begins]:
            states = {f: f for f in self.begins[tokens[i]]}
            for t in tokens[i + 1 : i + self.longest]:
                nexts = {}
                for joined, split in ((a + f, f"{b} {f}") for a, b in states.items() for f in self.forms(t)):
                    if joined in self.whole and joined not in out and spelled(joined, self.letters) + DROPPED * split.count(" ") > spelled(split, self.letters):
                        out.add(joined)
                    if joined in self.starts:
                        nexts[joined] = split
                states = nexts
                if not states:
                    break
        return out

    def score(self, text: str) -> float:
        """Noisy-or of the evidence of the distinct tokens."""
        tokens = text.lower().split()
        known = self.known
        if self.held > MEMO_BYTES:
            for held in (known, self.formed, self.begins):
                held.clear()
            self.held = 0
        found = [v if (v := known.get(t)) is not None else self.of(t) for t in set(tokens)]
        spaced = []
        if any(map(_SINGLE, tokens)):
            for run in spaced_out(tokens):
                spaced += [w for r in readings(run, self.letters) for w in self.inner if w in r]
        found += [self.lexicon[w] for w in [*spaced, *sorted(self.across(tokens) - set(spaced))]]
        doubt = sum(math.log1p(-v) for v in found if v)
        return max(NO_EVIDENCE, 1.0 - math.exp(doubt))


def _SINGLE(token: str) -> bool:
    return len(token) == 1


def learn_lexicon(docs: DataFrame, labels: DataFrame, letters: np.ndarray, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict[str, float]:
    """Evidence (0 to 1) of each feature that toxic texts have, from at most `sample` labelled rows.

    Copies would lend chance words weight, so texts that share one of SKETCHES min-hashes of their shingles count once. A
    feature seen in t toxic and c other texts needs t >= t0, the number of all-toxic texts that chance alone would bring
    about BY_CHANCE features to (of those that two toxic and five texts in all have), and has t / (t + c + t0), less where others use it. Without rows of both labels the lexicon is empty.
    """
    picked = labels.select(column(id_col).cast("long").alias("id"), column(label_col).cast("int").alias("toxic")).filter("id is not null and toxic is not null")
    picked = picked.groupBy("id").agg(F.max("toxic").alias("toxic"))
    chosen = materialise(picked.orderBy(F.xxhash64("id"), "id").limit(sample), "labelled")
    texts = docs.select(column(id_col).cast("long").alias("id"), column(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), "id")  # `sample` rows at most

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(x) for x in text_bytes(batch, "text")]
            least = [[int(mix(s ^ np.uint64(i)).min() >> np.uint64(1)) if len(s) else 0 for s in sets] for i in range(SKETCHES)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(x, pa.int64()) for x in least]], names=["id", *sketches])

    sketches = [f"s{i}" for i in range(SKETCHES)]
    alone = rows.mapInArrow(sketched, "id long, " + ", ".join(f"{x} long" for x in sketches))
    for x in sketches:
        alone = alone.groupBy(x).agg(*[F.min_by(y, "id").alias(y) for y in ["id", *sketches] if y != x])
    alone = materialise(alone.select("id").distinct(), "sketched")
    once = texts.join(F.broadcast(alone.join(chosen, "id")), "id").select("text", "toxic")  # no more rows than chosen

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        total = [0, 0]
        for batch in slices(batches):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                label = int(toxic > 0)
                total[label] += 1
                for f in {f for t in set((text or "").lower().split()) for f in features(restore(t, letters)[0])}:
                    counts.setdefault(f, [0, 0])[label] += 1
        names = [*counts, ""]
        values = [*counts.values(), total]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([v[1] for v in values], pa.int64()), pa.array([v[0] for v in values], pa.int64())], names=["feature", "t", "c"])
        released()

    table = once.mapInArrow(counted, "feature string, t long, c long").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    table = materialise(table.filter("feature = '' or t > 1"), "features")
    t, c = table.filter("feature = ''").select("t", "c").first() or (0, 0)
    if not t or not c:
        return {}
    often = table.filter("feature <> '' and t + c >= 5").count()
    least = max(3.0, math.log(max(often, 1) / BY_CHANCE) / math.log((t + c) / t))
    rows = table.filter(F.col("t") >= least).filter("feature <> '' and t > c").collect()  # see SAMPLE for how many those may be
    return weighed({r.feature: (r.t, r.c) for r in rows}, least)


def weighed(counts: dict[str, tuple[int, int]], least: float) -> dict[str, float]:
    """Evidence from counts (toxic, other). A beginning that others share answers for what its commonest word leaves over."""
    commonest: dict[str, tuple[int, int]] = {}
    for f, n in counts.items():
        for length in PREFIXES if not f.endswith("*") else ():
            if len(f) > length:
                commonest[f"{f[:length]}*"] = max(n, commonest.get(f"{f[:length]}*", (0, 0)))
    out = {}
    for f, (t, c) in counts.items():
        word = commonest.get(f, (0, 0))
        if c > word[1] and t >= word[0]:
            t, c = t - word[0], c - word[1]
        if t >= least:
            out[f] = t / (t + c + least) * (t / (t + c)) ** 2
    return out


def score_texts(docs: DataFrame, letters: np.ndarray, lexicon: dict[str, float], id_col: str = "doc_id", text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """docs with score_col (double, 0 to 1) for each row, by its text alone.

    Null and empty texts have NO_EVIDENCE. Nulls in other columns, repeated rows and extra columns are passed on as they
    are (a column named score_col is replaced); an empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c.lower() != score_col.lower()]
    shared = docs.sparkSession.sparkContext.broadcast((letters, lexicon))  # 27 cubed numbers, and what SAMPLE rows give

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(*shared.value)
        for batch in slices(batches):
            scores = [evidence.score(x or "") for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(scores, pa.float64())], names=["rest", "score"])
        del evidence
        released()

    picked = docs.select(F.struct(*map(column, kept)).alias("rest"), column(text_col).alias("text"))  # whatever a caller's columns are called
    scored = picked.mapInArrow(run, T.StructType([picked.schema["rest"], T.StructField("score", T.DoubleType())]))
    return scored.select(*[F.col("rest")[c].alias(c) for c in kept], F.col("score").alias(score_col))


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, dict[str, float]]:
    letters = learn_letters(docs)
    return letters, learn_lexicon(docs, labels, letters)


def fold(id_col: str = "doc_id"):
    """True for the rows that no label is learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that score 0.5 or more; every column stays as it is."""
    (score,) = fresh(docs.columns, "toxicity")
    return score_texts(docs, *train(docs, labels.filter(~fold())), score_col=score).filter(column(score) < 0.5).drop(score)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~fold())
    scored = score_texts(docs.select("doc_id", "text"), *train(docs, labels))
    return scored.select("doc_id", fold().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
