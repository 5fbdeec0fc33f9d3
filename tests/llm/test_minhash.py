"""Fast similarity sketches and MinHash near-duplicates against brute force."""

import random

import numpy as np
import pytest
from conftest_llm import documents, words

from expogrid.llm import minhash, queries
from expogrid.llm.windows import WordHashes


def slow_set(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow_near(rows, percent=85):
    sets = [slow_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) * 100 >= percent * max(len(sets[i]), len(sets[j])):
                if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), 1 << 60), d)
    return sorted((d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(rows))


def got(spark, rows, **settings):
    df = documents(spark, [(*r, 1, "x") for r in rows], "doc_id long, text string, n int, kept string")
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, **settings).collect())


def corpus(seed):
    r, rows = random.Random(seed), []
    for base in range(12):
        text = words(100 * seed + base, r.choice([8, 40, 150, 400]))
        for copy in range(r.randrange(1, 12)):
            w = list(text)
            kind = r.randrange(4)
            for _ in range(int(len(w) * r.choice([0, 0.01, 0.02, 0.03, 0.05]))):
                w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
            if kind == 1:
                w += words(r.randrange(10**6), int(len(w) * r.choice([0.05, 0.15, 0.2])))
            if kind == 2:
                w = w[: int(len(w) * r.choice([0.8, 0.86, 0.95]))]
            rows.append((len(rows) * 3 % 1009, (" " if copy % 2 else "\n").join(w)))
    return rows


@pytest.mark.parametrize("rounds", [3, 0])
def test_components_equal_brute_force(spark, rounds, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 5)
    monkeypatch.setattr(minhash, "PART", 2)
    rows = corpus(4) + [(2000, None), (2001, ""), (2002, " \t "), (2003, "One two"), (2004, "one\vTWO"), (2005, "one two three four five"), (2006, "a b " * 400), (2007, "a b " * 300)]
    rows += [(2003, "One two"), (5, rows[3][1]), (2008, "x y z"), (2009, "é É")]
    assert got(spark, rows, rounds=rounds) == slow_near(rows)


def test_links_round_a_common_passage(spark):
    """Many documents share most of a text, and only some of them are alike: no link is lost, none is made up."""
    r, shared, rows = random.Random(9), words(1, 60), []
    for i in range(150):
        rows.append((i, " ".join(shared + words(1000 + i // 2, 40)[: 40 - r.randrange(3)])))
    assert got(spark, rows) == slow_near(rows)


def test_sketches_estimate_the_similarity():
    r, t = np.random.default_rng(2), 256
    for size in (1, 3, 40, 700, 9000):
        for share in (0.2, 0.5, 0.9):
            both, only = max(1, int(size * share)), size - max(1, int(size * share))
            pool = r.integers(1, 2**63, both + 2 * only, dtype=np.uint64)
            a, b = pool[: both + only], np.concatenate((pool[:both], pool[both + only :]))
            s = minhash.fast_sketches(np.concatenate((a, b)), np.repeat([0, 1], [len(a), len(b)]), 3, t)
            assert (s[:2] != minhash.NONE).all() and (s[2] == minhash.NONE).all()
            true = both / (both + 2 * only)
            assert abs((s[0] == s[1]).mean() - true) <= 5 * np.sqrt(true * (1 - true) / t) + 1e-9
            alone = minhash.fast_sketches(b, np.zeros(len(b), np.int64), 1, t)
            assert (alone[0] == s[1]).all()  # whatever else is in the batch


def test_whole_sets():
    known = WordHashes()
    for text in (None, "", "a", "a b c d", "a b c d e", "a B c d e f a b c d e", "x " * 50):
        assert len(minhash.shingle_set(text, known)) == len(slow_set(text))
    long = "one two three four five six seven " * 300_000
    assert len(minhash.shingle_set(long, known)) == 7


def test_long_texts_and_nothing(spark):
    w = words(3, 300)
    long = " ".join(w * 1200)  # over two million characters, so several blocks
    assert len(long) > 2_000_000
    rows = [(3, long), (2, long + " end"), (7, " ".join(w)), (9, None)]
    assert got(spark, rows) == slow_near(rows)
    assert got(spark, []) == []


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    found = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in queries.op12_fast_minhash(spark, folder).collect())
    assert found == slow_near(rows)
