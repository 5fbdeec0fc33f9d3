"""Fingerprints, toxicity, language and pieces."""

import collections
import hashlib
import itertools
import math
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest_llm import documents, words

from expogrid.llm import language, pieces, sentencepieces, sketches, toxicity

MODEL = public_tokenizers.path("piece_bpe_32k.model")
HELD_OUT = lambda i: zlib.crc32(str(i).encode()) % 4 == 2


def paragraphs(text):
    seen, out = collections.Counter(), set()
    for p in sketches.PARAGRAPH.findall(text.encode()):
        out.add((p, seen[p]))
        seen[p] += 1
    return out


def alike(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("part", [200, 1 << 20])
def test_fingerprints_equal_brute_force(spark, part):
    r = random.Random(1)
    rows = [(r.randrange(10_000), ". ".join(" ".join(words(i * 9 + k, r.randrange(1, 6))) for k in range(r.randrange(0, 30)))) for i in range(60)]
    rows = list({i: (i, t) for i, t in rows}.values()) + [(-5, None), (-6, "x" * 3000), (-7, "same. same. same."), (None, "last one\nof all")]
    df = documents(spark, [(*x, "k") for x in rows], "doc_id long, text string, part string")
    got = {x.doc_id: x for x in sketches.versions(df, part).collect()}
    ordered = sorted(rows, key=lambda x: -(1 << 70) if x[0] is None else x[0], reverse=True)
    texts = [t or "" for _, t in ordered]
    assert len(got) == len(rows)
    for k, (i, _) in enumerate(ordered):
        text, following = texts[k], texts[(k + 1) % len(texts)]
        edit = text[: len(text) - len(text) // 3] + following[: len(text) // 3]
        row = got[i]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edit.encode()).hexdigest())
        assert row.near_edited == pytest.approx(alike(text, edit)) and row.near_next == pytest.approx(alike(text, following))
        assert (row.fingerprint == row.edited_fingerprint) == (paragraphs(text) == paragraphs(edit))


def test_fingerprints_of_few_and_equal_rows(spark):
    assert sketches.versions(documents(spark, [])).count() == 0
    (one,) = sketches.versions(documents(spark, [(1, "abc def.")])).collect()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abc deab").hexdigest()
    same = sketches.versions(documents(spark, [(1, "a b."), (1, "a b."), (1, "a b."), (0, "c")])).collect()
    assert len(same) == 4 and len({r.fingerprint for r in same if r.doc_id == 1}) == 1


def test_peeling_recovers_the_difference():
    r = np.random.default_rng(0)
    a, b = r.integers(0, 1 << 63, 300, dtype=np.uint64), r.integers(0, 1 << 63, 7, dtype=np.uint64)
    left, right = a, np.concatenate((a[5:], b))
    digest, owner = np.concatenate((left, right)), np.repeat([0, 1], [len(left), len(right)])
    made = sketches.Sketches.of(digest, owner, 2, 96).minus(np.array([0]), np.array([1]))
    found, _, sign, empty = made.peel()
    assert empty.all() and set(found[sign > 0]) == set(a[:5]) and set(found[sign < 0]) == set(b)
    small = sketches.Sketches.of(digest, owner, 2, 6).minus(np.array([0]), np.array([1]))
    assert not small.peel()[3].all()


def toxic_rows(n=240):
    rows, labels = [], []
    for i in range(n):
        w = words(i, 120)
        if i % 3 == 0:
            for k in (10, 40, 70, 100):
                w[k] = ("dreadful", "horridly", "vileness", "spiteful")[k // 30]
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 3 == 0)))
    return rows, labels


def test_toxicity_learns_and_ignores_held_out_labels(spark):
    rows, labels = toxic_rows()
    schema = "doc_id long, quality int, toxic int"
    docs = documents(spark, rows + [(1000, None), (1001, ""), (1001, "")])
    scorer = toxicity.fit(docs, spark.createDataFrame(labels + [(5, 1, None)], schema))
    got = {r.doc_id: r for r in toxicity.scored(docs, scorer).select("row.doc_id", "score", "predicted").collect()}
    out = [i for i, _ in rows if HELD_OUT(i)]
    assert sum(got[i].predicted == (i % 3 == 0) for i in out) / len(out) > 0.95
    assert got[1000].score == got[1001].score and 0 <= got[1000].score < toxicity.THRESHOLD
    assert all((r.score >= toxicity.THRESHOLD) == (r.predicted == 1) for r in got.values())
    flipped = [(i, q, 1 - t if HELD_OUT(i) else t) for i, q, t in labels]
    assert toxicity.fit(docs, spark.createDataFrame(flipped, schema)) == scorer


def test_toxicity_without_labels(spark):
    docs = documents(spark, [(1, "a", 2)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.fit(docs, none) is None
    row = toxicity.scored(docs, None).first()
    assert (row.row.score, row.score, row.predicted) == (2, 0.0, 0)
    assert toxicity.scored(docs.limit(0), None).count() == 0


def test_forward_sums_all_segmentations():
    vocabulary = language.Vocabulary(MODEL)
    p = np.random.default_rng(0).random((vocabulary.size, 2))
    for word in ("a", "the", "there", "über", "qﬄx"):
        total = np.zeros(2)
        for n in range(len(word)):
            for cuts in itertools.combinations(range(1, len(word)), n):
                parts = [word[a:b] for a, b in zip((0, *cuts), (*cuts, len(word)))]
                first = [vocabulary.ids[x] for x in (pieces.MARK + parts[0], parts[0]) if x in vocabulary.ids]
                starts = [p[i] for i in first]
                if len(parts[0]) == 1 and not first:
                    starts = [np.full(2, language.STRANGE)]
                value = sum(starts, np.zeros(2))
                for x in parts[1:]:
                    value = value * (p[vocabulary.ids[x]] if x in vocabulary.ids else language.STRANGE if len(x) == 1 else 0)
                total += value
        assert np.exp(language.Lattice(vocabulary, [word]).log_likelihood(p)[0]) == pytest.approx(total)


def test_languages(spark):
    texts = {"en": "the house and the garden were quiet in the morning light", "de": "das haus und der garten waren im morgenlicht sehr ruhig", "fr": "la maison et le jardin étaient calmes dans la lumière du matin"}
    r, rows = random.Random(0), []
    for i in range(120):
        lang = list(texts)[i % 3]
        w = texts[lang].split()
        r.shuffle(w)
        rows.append((i, " ".join(w[:8]), lang))
    odd = [(500, None, "en"), (501, "", "en"), (502, "12 ... ²", None), (503, "x" * 200_000, None), (504, "日本", None)]
    docs = documents(spark, [(*x, 1) for x in rows + odd], "doc_id long, text string, lang string, lang_pred int")
    known = language.fit(docs, MODEL)
    got = {x.doc_id: x for x in language.identify(docs, known).collect()}
    out = [(i, lang) for i, _, lang in rows if HELD_OUT(i)]
    assert all(got[i].lang_pred == lang for i, lang in out) and all(0 <= x.score <= 1 for x in got.values())
    assert [got[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and got[503].lang_pred in texts and got[504].lang_pred in texts
    swapped = documents(spark, [(i, t, "fr" if HELD_OUT(i) else lang) for i, t, lang in rows], "doc_id long, text string, lang string")
    again = language.fit(swapped, MODEL)
    assert np.array_equal(again.probability, language.fit(documents(spark, rows, "doc_id long, text string, lang string"), MODEL).probability)
    assert language.fit(docs.filter("lang is null"), MODEL) is None
    assert language.identify(docs.limit(1), None).first().lang_pred == "und"
    assert language.identify(docs.limit(0), known).count() == 0


ODD = ["a  b ", " x", "", "a\n\nb\tc", "<s> hi </s>", "a▁b", "ａ①é", "    indent  x", " ", "x" * 300, "日本語テキスト", "<0x0A>", "🙂🙂 ok", "a" + " " * 40 + "b"]


def test_pieces_in_parity_with_the_library(spark):
    rows = [(i, t) for i, t in enumerate(ODD + [" ".join(words(9, 400))])] + [(90, None), (3, ODD[3])]
    done = sentencepieces.encoded(documents(spark, [(*x, 1) for x in rows], "doc_id long, text string, ids int"))
    tool = sentencepieces.codec(MODEL, 1)
    got = {r.row.doc_id: r for r in done.collect()}
    for i, text in rows:
        assert got[i].parity and got[i].ids == (None if text is None else tool.library.encode(text))
        assert got[i].decoded == (None if text is None else sentencepieces.decoded_text(text, tool.model))
    assert sentencepieces.encoded(documents(spark, [])).count() == 0


def test_whole_texts_give_the_same_as_their_stretches():
    tool = sentencepieces.Codec(MODEL, 1)
    texts = [*ODD, " ".join(words(3, 500)), "a\u2581\u2581b"]
    assert tool.by_stretch and tool.run(texts) == [(ids, back, True) for ids, back, _ in tool.whole(texts)]


def _field(number, value):
    if isinstance(value, bytes):
        head, n = number << 3 | 2, len(value)
        size = b""
        while n >= 0x80:
            size, n = size + bytes([n & 0x7F | 0x80]), n >> 7
        return bytes([head]) + size + bytes([n]) + value
    if isinstance(value, float):
        return bytes([number << 3 | 5]) + struct.pack("<f", value)
    tag, out = number << 3, b""
    while tag >= 0x80:
        out, tag = out + bytes([tag & 0x7F | 0x80]), tag >> 7
    return out + bytes([tag, value])


def unigram_model():
    """A small unigram model with byte fallback, written by hand."""
    listed = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    scored = {"▁": 2, "▁the": 3, "t": 5, "h": 5, "e": 4, "he": 4.5, "r": 5, "re": 4.2, "▁t": 4.4, "er": 4.1, "▁there": 7.5, "a": 4.3, "▁a": 3.5}
    listed += [(t, -float(s), 1) for t, s in scored.items()]
    body = b"".join(_field(1, _field(1, t.encode()) + _field(2, s) + _field(3, k)) for t, s, k in listed)
    trainer = _field(3, pieces.UNIGRAM) + _field(35, 1) + _field(40, 0)
    normalizer = _field(1, b"identity") + _field(3, 1) + _field(4, 0) + _field(5, 1)
    return body + _field(2, trainer) + _field(3, normalizer)


def test_unigram_scores_and_byte_fallback():
    import sentencepiece

    data = unigram_model()
    tokenizer, model = sentencepieces.rebuild(data)
    assert model.kind == pieces.UNIGRAM and model.plain and model.byte_fallback
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    for text in ["the there", "there a there", "he re", " a  the ", "é the", "terra zz"]:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert ids == library.encode(text), text
        assert tokenizer.decode(ids, skip_special_tokens=False) == text == library.decode(ids)


def test_model_file():
    with open(MODEL, "rb") as file:
        model = pieces.parse(file.read())
    assert len(model.pieces) == 32_000 and model.kind == pieces.BPE and model.byte_fallback and model.plain
    assert math.isfinite(sum(s for _, s, _ in model.pieces)) and sentencepieces.splits_at_marks(model)


def test_all_ordinary_windows_train_the_dictionary(monkeypatch):
    seen = []

    def train(size, samples, **_):
        seen.extend(samples)
        raise toxicity.zstandard.ZstdError

    monkeypatch.setattr(toxicity.zstandard, "train_dictionary", train)
    toxicity.train([(" ".join(f"w{i}x{k}" for k in range(16_000)), 0) for i in range(45)] + [("bad words", 1)])
    assert len(seen) == 45_000 and any(b"w44x15999" in s for s in seen)
