"""Every operator on one awkward table: columns with the names of our own, null and repeated ids, empty, null and very long texts, no rows."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from semafold.llm import ann, bpe_chunks, exact_dedup, lm_score, minhash_dedup, packing, sharding, suffix_dedup, toxicity
from semafold.llm.common import fresh

CLASHES = ["_id", "_flag", "_word", "_at", "_bits", "_slot", "_shard", "toxicity", "shard", "word", "at", "bits", "flag", "gone", "also", "id", "n", "h", "bucket", "part", "sub", "keys", "extra", "key", "rest", "claimed", "toxic", "a.b"]
LONG = "a very long line of words that goes on and on, number "
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    big = "".join(f"{LONG}{i}\n" for i in range(90_000))
    texts = [(1, "the first text of all " * 5), (2, "the first text of all " * 5), (2, "another text"), (2, "another text"), (None, None), (None, "the first text of all " * 5), (None, ""), (3, None), (4, ""), (5, big), (6, "x" * 300_000), (7, "﻿ é \x00 end")]
    rows = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    return rows.withColumns({c: F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))) for c in CLASHES}).persist()


def untouched(before, after):
    """Every column but text is there, and the rows of after are rows of before."""
    assert sorted(after.columns) == sorted(before.columns)
    columns = [F.col(f"`{c}`") for c in before.columns if c != "text"]
    left, right = ([tuple(r) for r in x.select(*columns).collect()] for x in (after, before))
    for row in left:
        right.remove(row)
    return len(left)


def labels(spark):
    return spark.createDataFrame([(1, 0), (2, 1), (None, 1), (5, None)], "doc_id long, toxic int")


def test_fresh_names():
    assert fresh(["a", "B"], "a", "b", "c", "a") == ["a_", "b_", "c", "a__"]


def test_filters_keep_columns(spark, docs):
    assert untouched(docs, toxicity.drop_toxic(docs, labels(spark))) == 12
    assert untouched(docs, exact_dedup.drop_copies(docs)) == 10  # 1 gives way to 2, and 3 to 4
    assert untouched(docs, minhash_dedup.drop_near_duplicates(docs)) <= 12
    assert untouched(docs, suffix_dedup.cut_repeats(docs)) == 12
    placed = sharding.place(docs, "doc_id")
    assert {"slot", "shard_id", "shard"} <= set(placed.columns) and set(docs.columns) <= set(placed.columns) and placed.count() == 12


def test_scores_and_encodings(spark, docs):
    letters, lexicon = toxicity.train(docs, labels(spark))
    scored = toxicity.score_texts(docs, letters, lexicon)
    assert sorted(scored.columns) == sorted(docs.columns) and scored.filter("toxicity between 0 and 1").count() == 12
    model, counts = lm_score.train(docs)
    assert lm_score.score(docs, model, counts, F.lit(False)).filter("score <= 0 and n_known = n_tokens").count() == 12
    texts = {r.doc_id: r.text for r in docs.filter("doc_id > 2").select("doc_id", "text").collect()}
    whole = bpe_chunks.encoder(WORD)
    for r in bpe_chunks.digests(docs.filter("doc_id > 2"), WORD).collect():
        assert r.n_tokens == len(whole.whole(texts[r.doc_id] or "")) // 4
    pieces = packing.pack_documents(docs, BYTE).collect()
    assert {r.doc_id for r in pieces} == {None, 1, 2, 3, 4, 5, 6, 7}
    assert sum(r.length for r in pieces if r.doc_id == 5) == next(r.doc_tokens for r in pieces if r.doc_id == 5)


def test_deduplicators(docs):
    found = exact_dedup.find_copies(docs, digests=True).collect()
    assert len(found) == 12 and {r.keep_id for r in found if r.doc_id == 1} == {2}
    assert minhash_dedup.near_duplicates(docs).count() == 12
    assert {r.doc_id: len(r.spans) for r in suffix_dedup.find_repeats(docs).filter("doc_id in (1, 5, 6)").collect()} == {1: 0, 5: 0, 6: 0}


def test_no_rows(spark, docs):
    none = docs.limit(0)
    for kept in (toxicity.drop_toxic(none, labels(spark)), exact_dedup.drop_copies(none), minhash_dedup.drop_near_duplicates(none), suffix_dedup.cut_repeats(none)):
        assert sorted(kept.columns) == sorted(docs.columns) and kept.count() == 0
    assert packing.pack_documents(none, BYTE).count() == bpe_chunks.digests(none, WORD).count() == sharding.place(none, "doc_id").count() == 0


def test_hot_and_null_ids(spark):
    """One id on a third of the rows, and a table of null ids, each with texts of their own."""
    texts = [f"{'word ' * (i % 40)}number {i} of {i % 7}" for i in range(600)]
    for ids in ([7 if i % 3 == 0 else i for i in range(600)], [None] * 600):
        rows = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(4)
        packed = packing.pack_documents(rows, BYTE, share=100)
        shares = {r[0] >> 40: r[1] for r in packed.groupBy("sequence_id").count().collect()}
        assert packed.count() == 600 and len(shares) > 3
        model, counts = lm_score.train(rows, parts=4)
        assert lm_score.score(rows, model, counts, F.lit(False)).count() == 600
        assert minhash_dedup.near_duplicates(rows).count() == exact_dedup.find_copies(rows).count() == 600


def test_vectors_with_clashing_names(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0], 0, 0, 0) for i in range(30)], "vec_id long, embedding array<double>, id int, cell int, block int")
    assert ann.nearest(rows, rows.filter("vec_id < 3"), k=2).count() == 6
