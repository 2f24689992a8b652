"""The pipeline's stages against what each operator says of the stage's own input."""

import corpus_pipeline
from semafold.llm import toxicity
from test_dedup import near_brute, repeats_brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{SF}/labels.parquet")
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).persist()
        held[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns, name
    ids = lambda frame: sorted(r.doc_id for r in frame.select("doc_id").collect())
    before, after = held["toxicity"]
    letters, lexicon = toxicity.train(before, labels.filter(~toxicity.fold()))
    evidence = toxicity.Evidence(letters, lexicon)
    assert ids(after) == sorted(r.doc_id for r in before.collect() if evidence.score(r.text or "") < 0.5)
    before, after = held["exact_dedup"]
    last = {}
    for r in before.collect():
        last[r.text] = max(r.doc_id, last.get(r.text, -1))
    assert ids(after) == sorted(last.values())
    rows = lambda frame: [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    before, after = held["minhash_dedup"]
    assert ids(after) == sorted(i for i, v in near_brute(rows(before)).items() if v[2])
    before, after = held["suffix_dedup"]
    cut = {i: v[1].decode(errors="ignore") for i, v in repeats_brute(rows(before)).items()}
    assert {r.doc_id: (r.text, r.n_chars) for r in after.collect()} == {i: (t, len(t)) for i, t in cut.items()}
    before, after = held["packing"]
    pieces = {}
    for r in after.collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert sorted(pieces) == ids(before)
    for parts in pieces.values():
        at = 0
        for start, length, total in sorted(parts):
            assert start == at
            at += length
        assert at == total
    used = {}
    for r in after.collect():
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 1024


def test_run_is_the_stages_in_a_row(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "minhash_dedup", "suffix_dedup", "packing"]
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_awkward_inputs(spark, tmp_path):
    """Null and repeated ids, null, empty and long texts, extra columns, no labels, and no rows at all."""
    texts = [(1, "one short text of words here"), (2, "one short text of words here"), (2, "other words"), (None, None), (None, "no id"), (3, ""), (4, None), (5, "long line of text, " * 20_000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _id string, toxicity double, flag string"
    rows = spark.createDataFrame([(i, t, None, None, None, "x", 9.0, None) for i, t in texts], schema)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (rows, rows.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, stage(spark, docs, str(tmp_path)).persist()
            if name != "packing":
                assert docs.columns == rows.columns and docs.filter("_id <> 'x' or toxicity <> 9.0").count() == 0, name
        assert docs.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
