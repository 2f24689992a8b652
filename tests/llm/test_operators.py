"""Sharding, packing, tokenising, chat formatting, language model, toxicity and nearest neighbours."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from semafold.llm import ann, bpe_chunks, chat_format, lm_score, packing, sharding, toxicity

SCHEMA = "doc_id long, text string, id string, start int, key string"
TEXTS = [
    (1, "Hello, world! It's  fine.\n\nNew  line\tand   more "), (2, None), (3, ""), (4, "a \n b"), (5, "<|endoftext|> special <|startoftext|>"), (6, "日本語 テキスト " * 30),
    (7, "É. é, Ünd ß. don't I'LL " * 50), (8, "word " * 9000), (8, "word " * 9000), (None, "no id here"), (9, "x" * 5000), (10, " \n \n lead"), (11, "a\x1cb c d é"),
]


def frame(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "x", 1, None) for i, t in rows], SCHEMA)


# sharding


def test_table_is_even_and_steady():
    shards = [f"s{i}" for i in range(7)]
    full = sharding.fill_table(shards, 211)
    counts = Counter(full)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    less = sharding.fill_table(shards[:-1], 211)
    moved = sum(a != b for a, b in zip(full, less, strict=True) if a != 6)
    assert moved < 0.2 * 211
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill_table(bad, 211)
    with pytest.raises(ValueError):
        sharding.fill_table(shards, 210)


def test_placement(spark):
    rows = [(i, k) for i, k in enumerate(["a", "a", "", None, "é"])]
    got = sharding.place(spark.createDataFrame(rows, "n int, k string"), "k", ["x", "y", "z"], 13).collect()
    table = sharding.fill_table(["x", "y", "z"], 13)
    for r in got:
        slot = int(hashlib.md5((r.k or "").encode()).hexdigest()[:15], 16) % 13
        assert (r.slot, r.shard_id, r.shard) == (slot, table[slot], "xyz"[table[slot]])
    assert len(got) == 5 and sharding.place(spark.createDataFrame([], "k string"), "k").count() == 0


# packing


def best_fit_brute(lengths, window):
    room, places = [], []
    for n in lengths:
        fits = [r for r in room if r >= n]
        if fits:
            at = next(i for i in range(len(room)) if room[i] == min(fits))
        else:
            room.append(window)
            at = len(room) - 1
        room[at] -= n
        places.append(at)
    return room


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=80))
def test_best_fit(lengths):
    lengths = sorted(lengths, reverse=True)
    places, offsets = packing.best_fit_decreasing(lengths, 32)
    used = Counter()
    for n, at, offset in zip(lengths, places, offsets, strict=True):
        assert used[at] == offset
        used[at] += n
    assert all(v <= 32 for v in used.values())
    assert sorted(32 - v for v in used.values()) == sorted(best_fit_brute(lengths, 32))


def test_pieces_cover_every_id_once(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    rows = packing.pack_documents(frame(spark), path, window=64, ids=True, share=3).collect()
    want = Counter((i, tuple([*whole.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in TEXTS)
    docs = {}
    for r in rows:
        assert r.length == len(r.ids) <= 64 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        docs.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.ids))
    for (i, ids), n in want.items():
        pieces = sorted(docs[i, len(ids)])
        assert tuple(x for _, part in pieces[::n] for x in part) == ids
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


def test_little_padding(spark):
    """Under one token in a hundred is padding, of sequences whose length is no power of two."""
    used = Counter()
    for r in packing.op5_packing(spark, "/root/testdata/sf0.01").collect():
        used[r.sequence_id] += r.length
    padding = sum(1024 - n for n in used.values() if n & (n - 1))
    assert max(used.values()) <= 1024 and padding < 0.01 * sum(used.values())


# byte pairs


def test_chunked_encoding_is_exact(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    for chunk in (16, 128):
        got = bpe_chunks.digests(frame(spark), path, chunk=chunk).collect()
        assert len(got) == len(TEXTS)
        want = Counter()
        for i, t in TEXTS:
            ids = whole.encode(t or "", add_special_tokens=False).ids
            said = whole.decode(ids, skip_special_tokens=False)
            want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()] += 1
        assert Counter(map(tuple, got)) == want
    encoded = bpe_chunks.encode_texts(frame(spark).filter("doc_id = 1"), path)
    assert bpe_chunks.decode_ids(encoded, path).first().text == whole.decode(whole.encode(TEXTS[0][1], add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe_chunks.digests(frame(spark, []), path).count() == 0


def test_whole_table_encodes_exactly(spark):
    from tokenizers import Tokenizer

    path, docs = public_tokenizers.path("word_bpe_49k.json"), spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    whole = Tokenizer.from_file(path)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_chunks.op8_bpe_chunks(spark, "/root/testdata/sf0.01").collect()}
    rows = docs.select("doc_id", "text").collect()
    for r, e in zip(rows, whole.encode_batch_fast([r.text or "" for r in rows], add_special_tokens=False), strict=True):
        said = whole.decode(e.ids, skip_special_tokens=False)
        assert got.pop(r.doc_id) == (len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest())
    assert not got


def test_chunks_are_encoded_once():
    """Passages that texts share are encoded once, wherever they stand; joins that disagree are widened."""
    r = np.random.default_rng(3)
    some = lambda n: " ".join("".join(r.choice(list("aeioulmnrst"), 5)) for _ in range(n))
    shared = some(2000)
    texts = [f"{some(40)} {shared} {some(40)}" for _ in range(10)]
    path = public_tokenizers.path("word_bpe_49k.json")
    e = bpe_chunks.ChunkEncoder(path)
    want = [e.whole(t) for t in texts]
    assert list(e.encode_all(texts)) == want
    size = sum(map(len, texts))
    assert e.encoded + e.reused == size and e.encoded < 0.35 * size and e.widened == 0
    for entry in e.chunks.values():  # forged ids of a word beside a cut: no join agrees with them
        entry[1][1] = b"\0\0\0\0"
    assert list(e.encode_all(texts)) == want and e.widened == len(texts)
    other = bpe_chunks.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))  # keeps white space: nothing is cut
    assert other.latin is None and other.encode(texts[0]) == other.whole(texts[0])


def test_every_vocabulary_word_encodes_alike():
    e = bpe_chunks.encoder(public_tokenizers.path("word_bpe_49k.json"))
    words = [w for w in (t.removesuffix("</w>") for t in e.tokenizer.get_vocab()) if w.isalpha() and max(w) < "Ā"]
    assert e.strings(words) == [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
    odd = ["don't stop", "I'LL 's''s", "a'tb'dc", "''ve x've5'm", "½²³ª×÷µß", "12ab34", "é'ré", "...a!?'s"]
    assert e.strings(odd) == [e.whole(x) for x in odd]


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abÉé.,'s0 \n\tÀ́ \x1d日 "), max_size=120))
def test_any_text_encodes_exactly(text):
    for e, name in ((bpe_chunks.encoder(public_tokenizers.path("word_bpe_49k.json"), 16).encode, "word_bpe_49k.json"), (packing.encoder(public_tokenizers.path("byte_bpe_50k.json")), "byte_bpe_50k.json")):
        from tokenizers import Tokenizer

        whole = _loaded.setdefault(name, Tokenizer.from_file(public_tokenizers.path(name)) if name not in _loaded else None)
        assert e(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_loaded = {}


# chat


def shown(template, **context):
    return "".join(text for text, _ in chat_format.compile_template(template)(context))


def test_template_language():
    assert shown("{% for x in xs %}{{ x.a }}{% if x.b == 1 %}!{% elif not x.b %}?{% else %}-{% endif %}{% endfor %}", xs=[{"a": "p", "b": 1}, {"a": "q"}, {"a": "r", "b": 5}]) == "p!q?r-"
    assert shown("{{ 'a' + 'b' | upper }}{{ none }}{{ x['k'] or 'd' }}{{ (1 == 1) and 'y' }}", x={}) == "aBdy"
    assert chat_format.fold(chat_format.parse("a{{ 'b' }}{% if 1 == 2 %}c{% else %}d{% endif %}{{ x }}")) == [("text", "abd"), ("show", ("name", "x"))]
    for bad in ("{% for x %}{% endfor %}", "{{ x.y( }}", "{% if a %}", "{{ x | open }}", "{{ a b }}", "{% import os %}", "{{ x.__class__ }}", "{{ x.upper() }}"):
        with pytest.raises(chat_format.TemplateError):
            chat_format.compile_template(bad)
    assert shown("{{ x.upper }}", x="text") == ""  # attributes are keys, nothing else


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "<s>["]), st.text(st.sampled_from("<>/s[]INSTROLE\\bl \n"), max_size=30)), max_size=6))
def test_conversations_read_back(turns):
    ready = chat_format.compile_template(chat_format.CHAT)
    text, spans = chat_format.render(ready, [{"role": r, "text": t} for r, t in turns])
    assert chat_format.read_back(text) == turns
    assert "".join(chat_format.unescape(text[a:b]) for a, b in spans) == "".join(t for r, t in turns if r == "assistant")
    assert text.count("</s>") == text.count("<s>") == len(turns)


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b", 7), (1, 0, "user", "a", 7), (2, None, None, None, 7), (2, 0, "assistant", "x", 7), (2, 0, "assistant", "x", 7), (None, 3, "assistant", "n", 7)]
    held = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, c int")
    got = {r.conv_id: r for r in chat_format.read_back_digests(chat_format.format_conversations(held)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert set(got) == {1, 2, None}
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256) == (2, sha("user\na\nassistant\nb\n"), 1, sha("b"))
    assert (got[2].n_turns, got[2].turns_sha256, got[2].loss_sha256) == (3, sha("\n\nassistant\nx\nassistant\nx\n"), sha("xx"))
    assert chat_format.format_conversations(held.limit(0)).count() == 0


# language model


def test_base_scores_are_exact_and_the_model_is_better(spark):
    texts = [(i, "the cat sat on the mat and the dog ran " * (i % 4 + 1) + f"w{i % 7} Q{i}") for i in range(80)] + [(None, "the end"), (500, None), (501, ""), (502, "new words only"), (503, "the " * 30000)]
    held = F.col("doc_id").isNull() | (F.col("doc_id") % 5 == 0)
    docs = frame(spark, texts)
    model, counts = lm_score.train(docs.filter(~held), parts=3)
    got = lm_score.score(docs, model, counts, held).collect()
    tokens = lambda t: [*(t or "").lower().encode().split(), None]
    n = Counter(x for i, t in texts if i is not None and i % 5 for x in tokens(t))
    total, types = sum(n.values()), len(n)
    of = dict(texts)
    assert len(got) == len(texts)
    for r in got:
        ws = tokens(of[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(n[w] > 0 for w in ws), total)
        assert math.isclose(r.base_score, sum(math.log10((n[w] + 1) / (total + types + 1)) for w in ws), rel_tol=1e-9)
        assert r.score <= 0
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
    none = frame(spark, [])
    empty, counts = lm_score.train(none)
    assert lm_score.score(none, empty, counts, F.lit(True)).count() == 0
    assert lm_score.score(docs, empty, counts, F.lit(True)).filter("n_known > 0").count() == 0


def test_filter_gives_levels_back():
    r = np.random.default_rng(0)
    keys = np.unique(r.integers(0, 1 << 48, 5000).astype(np.uint64))
    counts = r.zipf(1.5, len(keys)).clip(max=10**6)
    levels = lm_score.level(counts)
    bits = 1 << (int(levels.sum()) * 12 - 1).bit_length()
    held = lm_score.Filter(1, bits)
    held.data = np.frombuffer(held.build(keys, levels), np.uint8)
    got = held.levels(keys)
    assert (got >= levels).all() and (got == levels).mean() > 0.97
    assert (held.levels(r.integers(1 << 47, 1 << 48, 5000).astype(np.uint64)) == 0).mean() > 0.97
    values = lm_score.VALUES[levels]
    assert (np.abs(np.log(values / counts)) <= np.log(lm_score.BASE) + 1e-9).all()


def scored_exactly(train, texts):
    """Scores from exact counts, each taken to its level, without a filter."""
    words, pairs = Counter(), Counter()
    tokens = lambda t: [*(t or "").lower().encode().split(), None]
    for t in train:
        ws = tokens(t)
        words.update(ws)
        pairs.update(zip(ws[:-1], ws[1:], strict=True))
    value = lambda n: lm_score.VALUES[lm_score.level(np.array([n]))][0] if n else 0.0
    total, mass = sum(words.values()), sum(map(value, words.values()))
    unknown = min(0.5, max(sum(n == 1 for n in words.values()), 1) / total)
    out = []
    for t in texts:
        score, before = 0.0, None
        for i, w in enumerate(tokens(t)):
            p = (1 - unknown) * value(words[w]) / mass if words[w] else unknown
            if i and words[before]:
                p = lm_score.PAIR * min(1.0, value(pairs[before, w]) / value(words[before])) + (1 - lm_score.PAIR) * p
            score += math.log10(p)
            before = w
        out.append(score)
    return out


def test_scores_are_those_of_exact_counts(spark, monkeypatch):
    """But for the filter's few false positives, at a filter of any size and however parts are put together; none is above 0."""
    monkeypatch.setattr(lm_score, "BUCKET_BYTES", 6000)  # many buckets ask few parts, which then answer in several tasks
    r = np.random.default_rng(6)
    texts = [(i, " ".join(f"w{x}" for x in r.zipf(1.3, 80) % 3000)) for i in range(300)] + [(1000 + i, " ".join(f"u{x}" for x in r.integers(0, 10**9, 20))) for i in range(40)]
    texts += [(2000, None), (2001, ""), (2002, "w1 w2 w1 w2 new"), (2003, "w1 " * 5000)]
    docs, held = frame(spark, texts), F.col("doc_id") >= 1000
    want = dict(zip([i for i, _ in texts], scored_exactly([t for i, t in texts if i < 1000], [t for _, t in texts]), strict=True))
    for options in ({"parts": 1}, {"parts": 7, "fan": 2}):
        model, counts = lm_score.train(docs.filter(~held), **options)
        got = {x.doc_id: x.score for x in lm_score.score(docs, model, counts, held).collect()}
        assert set(got) == set(want) and max(got.values()) <= 0
        off = [abs(got[i] - want[i]) for i in want]
        assert sum(x < 1e-6 for x in off) > 0.6 * len(off) and max(x / max(1, -w) for x, w in zip(off, want.values(), strict=True)) < 0.15


def test_pairs_seen_once_count(spark):
    words = [f"w{i}" for i in range(40)]
    texts = [(0, " ".join(words)), (1, " ".join(words[::-1])), (10, "w3 w4"), (11, "w3 w9")]
    docs, held = frame(spark, texts), F.col("doc_id") >= 10
    model, counts = lm_score.train(docs.filter(~held), parts=2)
    got = {x.doc_id: x.score for x in lm_score.score(docs, model, counts, held).collect()}
    single = (1 - model.unknown) * lm_score.VALUES[lm_score.level(np.array([2]))][0] / model.mass
    both = lm_score.PAIR / lm_score.VALUES[lm_score.level(np.array([2]))][0] + (1 - lm_score.PAIR) * single
    assert math.isclose(got[10] - got[11], math.log10(both) - math.log10((1 - lm_score.PAIR) * single), rel_tol=1e-9)


# toxicity


def test_restoration_and_scores(spark):
    r = np.random.default_rng(8)
    some = lambda n: " ".join("".join(r.choice(list("aeioulmnrst"), 5)) for _ in range(n))
    clean = [(i, f"{some(8)} the fox {some(8)}") for i in range(300)]
    toxic = [(1000 + i, f"{some(8)} the idiot {some(8)}") for i in range(60)]
    extra = [(2000, "what an 1d10t that is"), (2001, "i d i o t behind the wheel"), (2002, "idiiiiot"), (2003, None), (2004, ""), (2005, "an id-iot"), (None, "idiot")]
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t in clean + toxic + extra], "doc_id long, text string, toxicity double, id string")
    labels = spark.createDataFrame([(i, 0) for i, _ in clean] + [(i, 1) for i, _ in toxic] + [(None, 1), (1, None), (99999, 1)], "doc_id long, toxic int")
    letters, lexicon = toxicity.train(docs, labels)
    assert lexicon["idiot"] >= 0.5 > lexicon.get("fox", 0)
    assert "idiot" in toxicity.restore("1d10t", letters) and "idiot" in toxicity.restore("i.d.i.o.t", letters)
    assert toxicity.restore("plain", letters) == ["plain"]
    scored = toxicity.score_texts(docs, letters, lexicon)
    got = {r.doc_id: r.toxicity for r in scored.collect()}
    assert scored.count() == docs.count() and set(scored.columns) == set(docs.columns)
    assert all(got[i] < 0.5 for i, _ in clean) and all(got[i] >= 0.5 for i, _ in toxic)
    assert got[2000] >= 0.5 and got[2001] >= 0.5 and got[2002] >= 0.5 and got[None] >= 0.5
    assert got[2003] == got[2004] == toxicity.NO_EVIDENCE
    none = docs.limit(0)
    assert toxicity.score_texts(none, *toxicity.train(none, labels)).count() == 0


def test_separators_doubles_and_pieces(spark):
    r = np.random.default_rng(8)
    some = lambda n: " ".join("".join(r.choice(list("aeioulmnrst"), 5)) for _ in range(n))
    clean = [(i, f"{some(8)} the fox in the big well-known barn {some(8)}") for i in range(300)]
    toxic = [(1000 + i, f"{some(8)} the {'idiot' if i % 2 else 'gyp'} {some(8)}") for i in range(120)]
    tricks = ["an id-iot", "iiddiioott", "iddiot", "an id iot", "an idi ot.", "1d 10t", "a g y p there", "what an i-di_ot", "gg yy pp", "a dumb-id-iot"]
    fine = ["the fox in the big barn", "a well-known fox", "an inn in the biig barn", "the gap", "i do it"]
    docs = spark.createDataFrame(clean + toxic + list(enumerate(tricks, 2000)) + list(enumerate(fine, 3000)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i, _ in clean] + [(i, 1) for i, _ in toxic], "doc_id long, toxic int")
    got = {x.doc_id: x.toxicity for x in toxicity.score_texts(docs, *toxicity.train(docs, labels)).collect()}
    assert [t for i, t in enumerate(tricks, 2000) if got[i] < 0.5] == []
    assert [t for i, t in enumerate(fine, 3000) if got[i] >= 0.5] == [] and all(got[i] < 0.5 for i, _ in clean)


def readings_brute(token, letters):
    """Every path through the lattice with its log probability, best first."""
    found = {}
    for path in itertools.product(*toxicity.lattice(token)):
        text = "".join(x for x, _ in path)
        p = sum(c for _, c in path) + toxicity.spelled(text, letters)
        found[text.strip()] = max(p, found.get(text.strip(), -math.inf))
    return sorted(found, key=lambda x: (-found[x], x)), found


def test_readings_are_the_best_of_all_paths():
    r = np.random.default_rng(1)
    cube = r.dirichlet(np.ones(27) * 0.3, (27, 27))
    letters = np.log(cube + 1e-6)
    for token in ("1d10t", "i-d.i0t", "h3ll00", "@bb!+", "s$55", "аbс1", "g.y_p", "l00se-r", "aa11bb"):
        want, score = readings_brute(token, letters)
        got = toxicity.readings(token, letters)
        assert math.isclose(score[got[0]], score[want[0]], rel_tol=1e-9)
        for a, b in zip(got, want, strict=False):  # the next best too, ties apart
            assert math.isclose(score[a], score[b], rel_tol=1e-9)


def test_scores_of_plain_texts_by_hand():
    """Noisy-or of the strongest evidence of each distinct token, without a lattice."""
    lexicon = {"idiot": 0.9, "idio*": 0.4, "loser": 0.7, "some*": 0.2}
    e = toxicity.Evidence(np.log(np.full((27, 27, 27), 1 / 27)), lexicon)
    for text in ("an idiot and a loser", "idiotic", "someone", "The IDIOT, the idiot!", "nothing here", ""):
        doubt = 1.0
        for w in (re.sub("[^a-z]", "", t) for t in set(text.lower().split())):
            doubt *= 1 - max([lexicon.get(f, 0.0) for f in [w, *[f"{w[:n]}*" for n in (4, 5, 6) if len(w) > n]]], default=0.0)
        assert math.isclose(e.score(text), max(toxicity.NO_EVIDENCE, 1 - doubt), rel_tol=1e-9)


def test_evidence_of_beginnings():
    got = toxicity.weighed({"loser": (100, 0), "lose*": (100, 20), "lowe*": (90, 0), "loweab": (20, 0), "weak": (3, 0)}, 6.0)
    assert got["loser"] > 0.9 and got["lowe*"] > 0.9 and "lose*" not in got and "weak" not in got
    doubtful = toxicity.weighed({"some*": (60, 30)}, 6.0)["some*"]
    assert 0.1 < doubtful < 0.5


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(labels[r.doc_id], r.predicted) for r in toxicity.op3_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    found = sum(p for t, p in held if t) / sum(t for t, _ in held)
    alarms = sum(p for t, p in held if not t) / sum(1 - t for t, _ in held)
    assert found > 0.85 and alarms < 0.02


def test_held_out_recall(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r.predicted for r in toxicity.op3_toxicity(spark, sf).collect() if r.held_out and labels.get(r.doc_id) == 1]
    assert sum(held) > 0.9 * len(held)


# nearest neighbours


def test_neighbours(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, 16)).round(3)
    x[100:400] = x[100]
    rows = [(i, v.tolist(), "q") for i, v in enumerate(x)] + [(5000, None, "q"), (5001, [], "q"), (5002, [0.0] * 16, "q"), (5003, [float("nan")] * 16, "q"), (5004, [float("inf")] * 16, "q"), (None, x[0].tolist(), "q"), (5005, [None] * 16, "q")]
    held = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string")
    block, ann.BLOCK = ann.BLOCK, 64
    try:
        got = ann.nearest(held, held.filter("vec_id % 100 = 0")).collect()
    finally:
        ann.BLOCK = block
    found = {}
    for row in got:
        found.setdefault(row.query_id, {})[row["rank"]] = (row.score, row.vec_id)
    assert set(found) == set(range(0, 3000, 100))
    hits = 0
    for q, near in found.items():
        far = np.sqrt(((x - x[q]) ** 2).sum(1))
        far[q] = np.inf
        want = [(far[i], i) for i in np.lexsort((np.arange(len(x)), far))[:10]]
        have = [near[k] for k in sorted(near)]
        assert sorted(near) == list(range(1, 11)) and have == sorted(have) and all(abs(s - far[i]) < 1e-12 for s, i in have)
        hits += len({i for _, i in have} & {i for _, i in want})
    assert hits >= 0.9 * 10 * len(found)
    assert [found[200][k][1] for k in range(1, 11)] == list(range(100, 110))
    assert ann.nearest(held.limit(0), held).count() == 0 and ann.nearest(held, held.limit(0)).count() == 0


def test_every_query_gets_its_neighbours(spark, monkeypatch):
    """Small far clusters, lone vectors, a hot group of copies, and an id with many rows."""
    monkeypatch.setattr(ann, "PER_CELL", 20)
    r = np.random.default_rng(9)
    hot = [(i, [1.0] * 8) for i in range(600)]
    near = [(1000 + 100 * c + i, (centre + r.normal(size=8) * 0.01).tolist()) for c, centre in enumerate(r.normal(size=(60, 8)) * 1000) for i in range(6)]
    lone = [(9000 + i, (r.normal(size=8) * 10000).tolist()) for i in range(12)]
    rows = hot + near + lone + [(9900, [-3000.0] * 8)] * 30
    held = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = held.filter("vec_id >= 1000").distinct()
    got = Counter(x.query_id for x in ann.nearest(held, asked).collect())
    assert got == Counter({i: 10 for i in {i for i, _ in near + lone} | {9900}})
    few = held.filter("vec_id >= 9000 and vec_id < 9006")
    assert Counter(x.query_id for x in ann.nearest(few, few).collect()) == Counter({9000 + i: 5 for i in range(6)})


def recall_of(found, ids, x, k=10):
    """Share of true neighbours that were found, and of all vectors that were measured, both over the queries."""
    of, at = {}, {i: n for n, i in enumerate(ids.tolist())}
    for r in found:
        of.setdefault(r.query_id, ([], r.measured))[0].append(r.vec_id)
    hits = 0
    for q, (near, _) in of.items():
        far = ((x - x[at[q]]) ** 2).sum(1)
        far[at[q]] = np.inf
        hits += len(set(near) & set(ids[np.lexsort((ids, far))[:k]].tolist()))
    return hits / (k * len(of)), sum(m for _, m in of.values()) / (len(of) * len(x))


def test_recall_on_the_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").filter("embedding is not null").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    recall, share = recall_of(ann.op1_ann(spark, "/root/testdata/sf0.1").collect(), ids, x)
    assert recall >= 0.9 and share < 0.3


def test_few_vectors_are_measured(spark):
    r = np.random.default_rng(12)
    centres = r.normal(size=(80, 16)) * 4
    x = centres[r.integers(0, 80, 12_000)] + r.normal(size=(12_000, 16))
    held = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    recall, share = recall_of(ann.nearest(held, held.filter("vec_id % 100 = 0")).collect(), np.arange(len(x)), x)
    assert recall >= 0.9 and share < 0.05
    few = held.filter("vec_id < 2000")
    exact = ann.nearest(few, few.filter("vec_id % 100 = 0"), probes=10**6, rerank=None).collect()
    assert recall_of(exact, np.arange(2000), x[:2000]) == (1.0, 1999 / 2000)
