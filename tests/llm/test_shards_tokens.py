"""Jump hashing and token counts."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest_llm import documents, words

from expogrid.llm import jump, overlap

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "a  b ", " x", "▁▁ y", "é①\n\n\t", "<s> hi </s>", "x" * 700, " " * 300, "日本語 テキスト🙂", "a" * 50 + " b" * 90]


def slow_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * jump.STEP + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_equals_the_loop():
    keys = [0, 1, 2, 7, 12345, (1 << 60) - 1, *range(1000, 1200)]
    for n in (1, 2, 40, 41, 1000):
        assert jump.jump(np.array(keys, np.int64), n).tolist() == [slow_jump(k, n) for k in keys]
    with pytest.raises(ValueError):
        jump.jump(np.array([1]), 0)


def test_shards(spark):
    rows = [(i, f"text {i % 5}") for i in range(500)] + [(7, "text 2")] * 60 + [(None, None), (None, "x"), (3, None), (3, "")]
    df = documents(spark, [(*r, 1, "k") for r in rows], "doc_id long, text string, shard int, key string")
    got = jump.assign(df, 8, blocks=16).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((i or -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    for shard in range(8):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert all(r.grown_shard in (r.shard, 8) for r in got) and any(r.grown_shard == 8 for r in got)
    assert len({r.shard for r in got if r.doc_id == 7}) == 1
    assert jump.assign(documents(spark, []), 8).count() == 0


@pytest.mark.parametrize("chunk,step", [(40, 2), (200, 8), (1 << 14, 256)])
def test_counts_equal_the_library(chunk, step):
    tool = overlap.Counter(MODEL, chunk, step)
    texts = ODD + [" ".join(words(k, 300)) for k in range(5)] + ["".join(words(9, 200))]
    counts = [tool.count(t) for t in texts]
    assert [c[0] for c in counts] == [len(tool.library.encode(t)) for t in texts]
    if chunk == 40:
        assert sum(c[2] for c in counts) > 0  # some overlaps had to be widened
        assert max(c[1] for c in counts) > 20


def test_count_table(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "é")]
    df = documents(spark, [(*r, 5) for r in rows], "doc_id long, text string, n_tokens long")
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in overlap.count_tokens(df).collect()))
    n = overlap.counter(MODEL, 100, 10).library
    assert got == [(0, 2, len(n.encode("é"))), (1, 0, 0), (2, 0, 0), (3, 3, 2), (3, 3, 2)]
    assert overlap.count_tokens(documents(spark, [])).count() == 0
