"""Exact dedup, MinHash near-dedup and suffix dedup against brute force, and their edge cases."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from semafold.llm import exact_dedup, minhash_dedup, suffix_dedup
from semafold.llm.common import components

SCHEMA = "doc_id long, text string, id string, n long, key string, bucket int"  # other columns with names that the operators use
SF = "/root/testdata/sf0.001/documents.parquet"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, None, 3) for i, t in rows], SCHEMA)


def words(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(3)
    base = [words(r, r.randint(1, 120)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(60):
        t = r.choice(base).split()
        for _ in range(r.randint(0, 6)):
            t[r.randrange(len(t))] = words(r, 1)
        rows.append((100 + i, " ".join(t)))
    shared = words(r, 30)
    rows += [(200 + i, words(r, 10) + " " + shared + " " + words(r, 10)) for i in range(8)]
    rows += [(300, None), (301, ""), (302, ""), (303, "  \n "), (304, "one"), (305, "ONE"), (306, "é" * 40), (307, "é" * 40), (308, "long " * 20000), (None, base[0]), (None, "alone")]
    r.shuffle(rows)
    return rows


def test_exact_copies(spark, corpus):
    groups = {}
    for i, t in corpus:
        groups.setdefault(t or "", []).append(i)
    want = []
    for i, t in corpus:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    got = exact_dedup.find_copies(frame(spark, corpus), digests=True)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    plain = exact_dedup.find_copies(frame(spark, corpus))
    assert sorted(map(repr, map(tuple, plain.collect()))) == sorted(repr(w[:4]) for w in want)
    kept = exact_dedup.drop_copies(frame(spark, corpus))
    assert kept.columns == frame(spark, []).columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(w[0]) for w in want if w[3] or w[0] is None)


def test_a_repeated_id_keeps_its_other_texts(spark):
    kept = exact_dedup.drop_copies(frame(spark, [(5, "a"), (9, "a"), (5, "b"), (5, "c"), (7, None), (8, ""), (7, "d")]))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(5, "b"), (5, "c"), (7, "d"), (8, ""), (9, "a")]


def near_brute(rows, threshold=75):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, []).append(frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset())
    parent = {i: i for i in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(parent)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i][0], sets[j][0]
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(sets[i][0]), root(i), root(i) == i) for i in ids}


def test_near_duplicates(spark, corpus):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(frame(spark, corpus)).collect() if r.doc_id is not None}
    assert got == near_brute(corpus)
    kept = minhash_dedup.drop_near_duplicates(frame(spark, corpus)).filter("doc_id is not null")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, v in got.items() if v[2])


def test_near_duplicates_across_pivots(spark):
    """A chain whose ends share nothing: no pivot links to all of it, and small blocks make tasks of pairs of blocks."""
    r = random.Random(5)
    text = words(r, 60).split()
    rows = []
    for i in range(40):
        rows.append((r.randrange(10**6), " ".join(text)))
        text[(3 * i) % 60] = words(r, 1)
    found = minhash_dedup.near_duplicates(frame(spark, rows), block=4)
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in found.collect()}
    assert got == near_brute(rows)


def test_estimates_follow_similarity(spark):
    r = np.random.default_rng(1)
    pool = r.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for overlap in (0, 500, 900, 1000):
        a, b = pool[:1000], pool[1000 - overlap : 2000 - overlap]
        rows = [(minhash_dedup.packed(minhash_dedup.minima(a)).tolist(), minhash_dedup.packed(minhash_dedup.minima(b)).tolist())]
        got = spark.createDataFrame(rows, "a array<long>, b array<long>").select(minhash_dedup.estimate(F.col("a"), F.col("b"))).first()[0]
        assert abs(got - overlap / (2000 - overlap)) < 0.17


def test_components_of_chains_and_hubs(spark):
    links = [(1, 2), (2, 3), (5, 9), (9, 7), (7, 8), (3, 3), (20, 10), (10, 15)] + [(100, 100 + i) for i in range(1, 300)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert {k: v for k, v in got.items() if k < 100} == {1: 1, 2: 1, 3: 1, 5: 5, 9: 5, 7: 5, 8: 5, 10: 10, 15: 10, 20: 10}
    assert {v for k, v in got.items() if k >= 100} == {100}


def repeats_brute(rows, match=50):
    seen, out = {}, {}
    for i, t in sorted(((i, t) for i, t in rows if i is not None), key=lambda x: x[0]):
        data = (t or "").encode()
        gone = np.zeros(len(data) + match, bool)
        for p in range(len(data) - match + 1):
            if seen.setdefault(data[p : p + match], i) < i:
                gone[p : p + match] = True
        out[i] = (len(data), bytes(np.frombuffer(data, np.uint8)[~gone[: len(data)]]))
    return out


def test_repeats(spark, corpus):
    found = suffix_dedup.find_repeats(frame(spark, corpus), bucket_bytes=4000)
    got = {r.doc_id: (r.n_bytes, bytes(r.kept)) for r in found.collect() if r.doc_id is not None}
    assert got == repeats_brute(corpus)
    alone = [r for r in found.collect() if r.doc_id is None]
    assert len(alone) == 2 and all(not r.spans for r in alone)


def test_repeats_in_odd_bytes(spark):
    """Runs of one byte, repeats within a document, matches of exactly 49, 50 and 51 bytes, equal ids."""
    r = random.Random(2)
    line = words(r, 40)
    rows = [(1, "a" * 300), (2, "b" + "a" * 120 + "c"), (3, line), (4, line[:49] + "#" + line[60:110] + "!" + line[10:61]), (5, (words(r, 5) + line[:70]) * 3), (6, "ab" * 100), (7, "ab" * 60), (8, line), (8, line)]
    found = suffix_dedup.find_repeats(frame(spark, rows), bucket_bytes=100)
    got = sorted((x.doc_id, x.n_bytes, bytes(x.kept)) for x in found.collect())
    want = repeats_brute(rows)
    assert got == sorted((i, *want[i]) for i, _ in rows)


def test_cut_repeats_keeps_other_columns(spark, corpus):
    done = suffix_dedup.cut_repeats(frame(spark, corpus), bucket_bytes=4000)
    assert done.columns == frame(spark, []).columns
    want = repeats_brute(corpus)
    rows = [r for r in done.collect() if r.doc_id is not None]
    assert {r.doc_id: (r.text or "") for r in rows} == {i: v[1].decode(errors="ignore") for i, v in want.items()}
    assert all(r.id == "x" and r.bucket == 3 and r.key is None for r in rows)
    assert [r.text for r in rows if r.doc_id == 300] == [None]


def factors_brute(text, starts, docs, most):
    out = []
    for s, d in zip(starts, docs, strict=True):
        best = 0
        for t, e in zip(starts, docs, strict=True):
            n = 0
            while e < d and n < most and text[s + n] == text[t + n]:
                n += 1
            best = max(best, n)
        out.append(best)
    return out


def test_previous_factors():
    text = np.frombuffer(b"x" * 60 + b"y" * 60 + b"x" * 60, np.uint8)
    got = suffix_dedup.longest_previous_factors(text, np.array([0, 60, 120]), np.array([5, 5, 9]))
    assert got.tolist() == [0, 0, 50]
    for seed in range(30):
        r = np.random.default_rng(seed)
        most, letters = int(r.integers(2, 20)), int(r.integers(1, 4))
        text = r.integers(0, letters, 160).astype(np.uint8)  # few letters: long shared runs of every length, zero bytes too
        starts = np.sort(r.choice(160 - most, int(r.integers(1, 90)), replace=False))
        docs = r.integers(0, int(r.integers(1, 40)), len(starts))
        assert suffix_dedup.longest_previous_factors(text, starts, docs, most).tolist() == factors_brute(text, starts, docs, most)


def test_a_line_in_every_document(spark):
    """Its surroundings differ in each: minimizers with many contents, dealt on by windows."""
    r = random.Random(6)
    line = words(r, 20)
    rows = [(r.randrange(10**6), f"{words(r, 12)} {line} {words(r, 12)}") for _ in range(150)]
    got = {x.doc_id: (x.n_bytes, bytes(x.kept)) for x in suffix_dedup.find_repeats(frame(spark, rows), bucket_bytes=3000, hot=3).collect()}
    assert got == repeats_brute(rows)
    again = suffix_dedup.find_repeats(frame(spark, rows), bucket_bytes=3000, hot=3, fan=2)  # parts in groups, buckets in regions
    assert {x.doc_id: (x.n_bytes, bytes(x.kept)) for x in again.collect()} == got


def test_hot_and_null_ids_in_repeats(spark):
    """One id on a third of the rows, and a table of null ids."""
    r = random.Random(7)
    base = [words(r, 40) for _ in range(20)]
    rows = [(7 if i % 3 == 0 else i, f"{r.choice(base)} {words(r, 5)}") for i in range(90)]
    found = suffix_dedup.find_repeats(frame(spark, rows), bucket_bytes=2000)
    got = sorted((x.doc_id, x.n_bytes, bytes(x.kept)) for x in found.collect())
    seen = {}
    for i, t in rows:
        for p in range(len(t.encode()) - 49):
            seen[t.encode()[p : p + 50]] = min(i, seen.get(t.encode()[p : p + 50], i))
    want = []
    for i, t in rows:
        data, gone = t.encode(), set()
        for p in range(len(data) - 49):
            if seen[data[p : p + 50]] < i:
                gone |= set(range(p, p + 50))
        want.append((i, len(data), bytes(c for p, c in enumerate(data) if p not in gone)))
    assert got == sorted(want)
    nulls = suffix_dedup.find_repeats(frame(spark, [(None, t) for _, t in rows])).collect()
    assert len(nulls) == len(rows) and sorted(bytes(x.kept) for x in nulls) == sorted(t.encode() for _, t in rows)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert exact_dedup.find_copies(none, digests=True).count() == 0
    assert minhash_dedup.near_duplicates(none).count() == 0
    assert suffix_dedup.find_repeats(none).count() == 0
    assert exact_dedup.drop_copies(none).count() == minhash_dedup.drop_near_duplicates(none).count() == suffix_dedup.cut_repeats(none).count() == 0


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(SF).select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.op6_minhash_dedup(spark, SF.rsplit("/", 1)[0]).collect()}
    assert got == near_brute(rows)
    want = repeats_brute(rows)
    for r in suffix_dedup.op9_suffix_dedup(spark, SF.rsplit("/", 1)[0]).collect():
        assert (r.n_bytes, r.n_bytes - r.n_removed, r.kept_sha256) == (want[r.doc_id][0], len(want[r.doc_id][1]), hashlib.sha256(want[r.doc_id][1]).hexdigest())
