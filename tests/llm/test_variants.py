"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from conftest_llm import documents

from expogrid.llm import queries, variants


def slow_words(rows, least, count, spoil):
    total = Counter()
    for doc_id, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % spoil == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= count}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_variants(rows, least=7, count=2, ratio=10, spoil=31):
    n = slow_words(rows, least, count, spoil)
    forms, near = {}, {}
    for w in n:
        near[w] = [v for v in n if one_apart(w, v)]
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best and n[best] >= ratio * n[w] else None

    def root(w):
        while forms[w]:
            w = forms[w]
        return w

    return sorted((w, forms[w] or "", root(w), n[w], len(near[w]), n.get(forms[w], -1)) for w in n)


def got(spark, rows, **settings):
    df = documents(spark, [(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int")
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in variants.variants(df, **settings).collect())


def corpus(seed, size):
    r = random.Random(seed)
    base = ["".join(r.choice("abé") for _ in range(r.randrange(6, 10))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "Àbbbbbbb", "×÷bbbbbb"]
    rows = []
    for i in range(size):
        words = []
        for _ in range(r.randrange(60)):
            w = base[min(int(r.expovariate(0.3)), len(base) - 1)]
            if r.random() < 0.2:
                at = r.randrange(len(w))
                w = w[:at] + r.choice(["", "b", "ab"]) + w[at + r.randrange(2) :]
            words.append(w.upper() if r.random() < 0.1 and w.isascii() else w)
        rows.append((i, r.choice([" ", ", ", "-7"]).join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_equal_brute_force(spark, seed):
    rows = corpus(seed, 150) + [(None, "aaaaaaa " * 4), (7, None), (8, ""), (3, "Long" * 3000 + " " + "long" * 3000 + " " + "long" * 2999 + "lon"), (5, "abcdefg abcdefg"), (5, "abcdefg abcdefg")]
    want = slow_variants(rows, spoil=7)
    assert got(spark, rows, spoil=7) == want
    assert any(w[1] for w in want) and any(w[1] and w[2] != w[1] for w in want) or seed == 2


def test_tries_of_many_parts(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    aqe = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = corpus(3, 120)
        assert got(spark, rows, spoil=31) == slow_variants(rows)
        words = documents(spark, sorted(slow_words(rows, 7, 2, 31).items()), "word string, n long")
        known = variants.numbered(words).collect()
        assert [r.word for r in sorted(known, key=lambda r: r.id)] == sorted(r.word for r in known)
        nodes = {}
        for r in known:
            for depth, node in enumerate(r.ahead, 1):
                assert nodes.setdefault(node, r.word[:depth]) == r.word[:depth]
        assert len(nodes) == len({w[:i] for w in (r.word for r in known) for i in range(1, len(w) + 1)})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", aqe)


def test_nothing(spark):
    assert got(spark, []) == [] and got(spark, [(1, None), (2, "a b 7")]) == []


def test_long_texts(spark):
    text = "letters letterz letters " * 90_000  # two million characters
    assert got(spark, [(1, text)], spoil=None) == [("letters", "", "letters", 180_000, 1, -1), ("letterz", "", "letterz", 90_000, 1, -1)]


def test_query_is_the_operator(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    n = slow_words(rows, 7, 2, 31)
    found = {r.word: r for r in queries.op11_spelling_variants(spark, folder).collect()}
    assert {w: r.n for w, r in found.items()} == n
    some = sorted(n)[::40]
    for w in some:
        near = [v for v in n if one_apart(w, v)]
        assert found[w].n_near == len(near)
