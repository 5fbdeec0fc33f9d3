"""Licence scan, benchmark windows, near-duplicates and repeated passages."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest_llm import documents, words

from expogrid.llm import fmindex, licences, neardup, simhash, windows
from expogrid.llm.common import alnum_words


def test_base_phrases_at_all_places(spark):
    text = "All Rights-Reserved. x (CC) by/cc BY the GNU general public licence General Public License"
    rows = [(1, text), (2, None), (3, ""), (4, "all rights"), (5, "CC BY-NC 4.0"), (5, "CC BY-NC 4.0"), (6, "cc by " * 3000), (7, "general publiK license general public")]
    got = licences.summary(licences.scan(documents(spark, [(*r, 1) for r in rows], "doc_id long, text string, words int"))).orderBy("doc_id").collect()
    one = got[0]
    assert (one.n_words, one.n_base, one.first_word, one.last_word, one.base_labels) == (16, 4, 0, 13, "cc-by,gpl,reserved")
    assert [(r.doc_id, r.n_words, r.n_base, r.base_labels) for r in got[1:4]] == [(2, 0, 0, ""), (3, 0, 0, ""), (4, 2, 0, "")]
    assert got[3].first_word is None and got[1].score == 0
    assert got[4] == got[5] and got[4].labels == "cc-by,cc-by-nc-4.0"
    assert (got[6].n_base, got[6].first_word, got[6].last_word) == (3000, 0, 5998)
    assert got[7].n_base == 0  # a Kelvin sign is no k
    assert licences.scan(documents(spark, [])).count() == 0


def test_templates_need_their_key_phrases(spark):
    grant = next(t.text for t in licences.TEMPLATES if t.text.startswith("Permission is hereby granted, free"))
    rows = [(1, "intro " + grant + " outro"), (2, grant.replace("hereby", "gladly")), (3, "released under the mit licence")]
    got = {r.doc_id: r for r in licences.summary(licences.scan(documents(spark, rows))).collect()}
    assert got[1].labels == "mit" and got[1].score == 1.0
    assert got[2].labels == "" and got[2].n_base == 0 and got[3].labels == "" and 0 < got[3].score < 1


def brute_windows(docs, items, width):
    wanted = {}
    for item, text in items:
        w = alnum_words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            wanted.setdefault(tuple(w[i : i + width]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = alnum_words(text), set(), set()
        for n in {len(k) for k in wanted}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wanted:
                    hit.update(range(i, i + n))
                    found |= wanted[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), sorted(x for x in found if x is not None)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard,block", [(1 << 20, 1 << 20), (50, 40)])
def test_fm_index_finds_all_windows(spark, shard, block):
    r = random.Random(3)
    make = lambda n, k: " ".join(r.choice("abcdef"[:k]) for _ in range(n))
    docs = [(i, make(r.randrange(0, 60), 3 + i % 4)) for i in range(80)] + [(5, None), (None, "A-b C"), (6, ""), (7, "a b a b " * 200)]
    items = [(i, make(r.randrange(1, 9), 3)) for i in range(12)] + [(3, None), (None, "b c d"), (4, ""), (9, "zz zz")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    df = documents(spark, [(*d, 1) for d in docs], "doc_id long, text string, items int")
    found = fmindex.scan(df, benchmark, width=4, shard_words=shard, block_bytes=block)
    got = [(x.doc_id, x.n_words, x.n, x["items"]) for x in found.select("row.doc_id", "n_words", fmindex.n_hit().alias("n"), "items").collect()]
    assert sorted(got, key=repr) == brute_windows(docs, items, 4)
    assert fmindex.scan(df, benchmark.limit(0)).filter("size(items) > 0").count() == 0
    assert fmindex.scan(df.limit(0), benchmark).count() == 0


def test_index_parts():
    r = np.random.default_rng(0)
    seq = np.concatenate([np.append(r.integers(1, 4, n), 0) for n in (30, 1, 17, 30)]).astype(np.int32)
    tails = [tuple(seq[i:]) for i in range(len(seq))]
    order = fmindex.suffix_array(seq)
    assert sorted(order) == list(range(len(seq)))
    ends = {int(p): k for k, p in enumerate(np.flatnonzero(seq == 0))}
    value = lambda i: [(0, ends[j]) if seq[j] == 0 else (1, int(seq[j])) for j in range(i, len(seq))]
    assert order.tolist() == sorted(range(len(seq)), key=value)
    tree = fmindex.Wavelet(seq.astype(np.int64), 3)
    for symbol in range(4):
        at = np.arange(len(seq) + 1)
        assert tree.rank(np.full(len(at), symbol), at).tolist() == [int((seq[:i] == symbol).sum()) for i in at]
    assert tails


def slow_fingerprint(text, size=4):
    w = (text or "").encode().lower().split()
    parts = [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def slow_components(prints, ids, radius):
    up = list(range(len(prints)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                up[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(least.get(root(i), 1 << 60), d)
    return [least[root(i)] for i in range(len(prints))]


@pytest.mark.parametrize("shard_rows", [1 << 16, 3])
def test_simhash_equals_brute_force(spark, shard_rows):
    base, r, rows = words(1, 120), random.Random(5), []
    for i in range(90):
        w = list(base)
        for _ in range(i % 7):
            w[r.randrange(len(w))] = words(i, 1)[0]
        rows.append((i * 3, " ".join(w)))
    rows += [(500 + i, " ".join(words(100 + i, 30))) for i in range(40)] + [(900, None), (800, ""), (801, "\t \n"), (700, "One two"), (701, "one  TWO"), (3, " ".join(base))]
    got = simhash.near_duplicates(documents(spark, [(*x, 1) for x in rows], "doc_id long, text string, fp int"), shard_rows=shard_rows).collect()
    prints = {t: slow_fingerprint(t) for _, t in rows}
    want = slow_components([prints[t] for _, t in rows], [i for i, _ in rows], 4)
    assert sorted((x.doc_id, x.fingerprint, x.component_id) for x in got) == sorted((i, f"{prints[t]:016x}", c) for (i, t), c in zip(rows, want))
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_tree_links_what_all_pairs_link():
    r = np.random.default_rng(2)
    centres = r.integers(0, 1 << 63, 6, dtype=np.uint64)
    values = np.unique(np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (60, 4)).astype(np.uint64), axis=1) for c in centres]))
    links = simhash.spanning(values, values, 4)
    prints = values.tolist()
    up = {v: v for v in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[root(a)] = root(b)
    want = slow_components(prints, list(range(len(prints))), 4)
    for i in range(len(prints)):
        for j in range(i):
            assert (root(prints[i]) == root(prints[j])) == (want[i] == want[j])


def test_near_duplicates_keep_one_of_each_group(spark):
    a, b = words(1, 200), words(2, 200)
    near = list(a)
    near[100] = "changed"
    far = list(a)
    for i in range(0, 200, 8):
        far[i] = "other"
    rows = [(1, " ".join(a)), (2, " ".join(near)), (3, " ".join(a)), (3, " ".join(a)), (4, " ".join(far)), (5, " ".join(b)), (6, None), (7, ""), (8, "tiny"), (9, "tiny text")]
    df = documents(spark, [(*r, 1) for r in rows], "doc_id long, text string, rid int")
    left = neardup.deduplicated(df)
    ids = sorted(r.doc_id for r in left.collect())
    assert left.columns == df.columns
    assert len({1, 2, 3} & set(ids)) == 1 and len(ids) == len(set(ids)) and len({6, 7} & set(ids)) == 1
    assert {4, 5, 8, 9} <= set(ids)
    assert neardup.deduplicated(df.limit(0)).count() == 0


def slow_compact(values, width):
    out = []

    def split(lo, hi):
        if hi - lo + 1 < width:
            return
        c = min(range(lo, hi + 1), key=lambda i: (values[i], i))
        out.append((lo, c, hi))
        split(lo, c - 1)
        split(c + 1, hi)

    split(0, len(values) - 1)
    return sorted(out)


def test_compact_windows_are_the_nodes_of_the_tree():
    r = np.random.default_rng(1)
    for n, top in ((200, 1 << 40), (200, 9), (30, 2), (5, 4)):
        values = r.integers(1, top, n).astype(np.uint64)
        assert sorted(zip(*(x.tolist() for x in windows.compact_windows(values, 12)))) == slow_compact(values.tolist(), 12)


def test_repeated_passages(spark):
    shared, long = words(50, 60), words(51, 300)
    edited = list(long)
    edited[150] = "changed"
    texts = {
        1: words(1, 80) + shared + words(2, 30), 2: shared + words(3, 100), 3: words(4, 10) + shared,
        4: long, 5: words(5, 20) + edited, 6: words(6, 400), 7: words(7, 49), 8: words(7, 49), 9: words(8, 5),
    }
    rows = [(i, ", ".join(w)) for i, w in texts.items()] + [(10, None), (11, ""), (6, ", ".join(texts[6]))]
    df = documents(spark, [(*r, "x") for r in rows], "doc_id long, text string, partners string")
    got = {r.doc_id: r for r in windows.repeats(df).collect()}
    spans = {i: [(s.start, s.end) for s in r.spans] for i, r in got.items()}
    places = {1: (80, 140), 2: (0, 60), 3: (10, 70)}
    kept = [i for i in places if not spans[i]]
    assert len(kept) == 1
    assert all(spans[i] == [places[i]] and got[i].partners == kept for i in places if i not in kept)
    whole = {4: (0, 300), 5: (20, 320)}
    (second,) = [i for i in whole if spans[i]]
    assert spans[second] == [whole[second]] and got[second].partners == [9 - second]
    assert all(not spans[i] for i in (6, 7, 8, 9, 10, 11)) and got[10].n_words == 0
    assert windows.repeats(df.limit(0)).count() == 0


def test_cut():
    assert windows.cut("One, two (three) four. Five!", [(1, 3), (4, 5)]) == "One, ) four. !"
    assert windows.cut("é b c", [(0, 1)]) == " b c"


def test_spans_are_joined(spark):
    rows = [([(5, 9), (0, 3), (3, 4), (8, 12), (20, 21)],), (None,), ([],)]
    df = spark.createDataFrame(rows, "found array<struct<start:bigint,end:bigint>>")
    got = [[tuple(s) for s in r.s] for r in df.select(windows.joined_spans(df.found).alias("s")).collect()]
    assert got == [[(0, 4), (5, 12), (20, 21)], [], []]


def test_digest_of_items(spark):
    got = spark.createDataFrame([([10, 9, 100],), ([],)], "i array<long>")
    rows = [r[0] for r in got.select(fmindex.items_digest(got.i)).collect()]
    assert rows == [hashlib.sha256(x).hexdigest() for x in (b"10,100,9", b"")]


def five_word_sets(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


@pytest.mark.parametrize("settings", [{}, {"rounds": 1}, {"rounds": 0}])
def test_near_duplicates_equal_brute_force(spark, settings):
    """Copies with words appended, cut off or replaced, around the bound, and texts that only share a notice."""
    r, rows = random.Random(9), []
    notice = words(999, 30)
    for i, (n, more) in enumerate([(200, 40), (100, 20), (100, 15), (100, 10), (50, 10), (60, 3)] * 8):
        base = words(1000 + i, n)
        edited = list(base)
        for _ in range(n // 60):
            edited[r.randrange(n)] = "changed"
        rows += [base, base + words(2000 + i, more), base[more:], edited]
    rows += [notice + words(3000 + i, 12) for i in range(30)] + [notice + words(4000 + i, 2) for i in range(10)]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    named = documents(spark, rows).withColumn("rid", windows.row_id())
    rid = {x.doc_id: x.rid for x in named.collect()}
    sets, kept = {i: five_word_sets(t) for i, t in rows}, []
    for i in sorted(rid, key=rid.get):
        if not any(len(sets[i] & sets[k]) >= 0.8 * len(sets[i] | sets[k]) for k in kept):
            kept.append(i)
    gone = {x.rid for x in neardup.dropped(named, **settings).collect()}
    assert {i for i in rid if rid[i] not in gone} == set(kept) and len(kept) < 150


def test_chains_drop_only_what_resembles_a_kept_row(spark):
    line = words(77, 260)
    df = documents(spark, [(i, " ".join(line[4 * i : 4 * i + 100])) for i in range(40)]).withColumn("rid", windows.row_id())
    gone = {x.rid for x in neardup.dropped(df, rounds=2).collect()}
    sets = {x.rid: five_word_sets(x.text) for x in df.collect()}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    kept = sets.keys() - gone
    assert gone and all(any(alike(a, b) for b in kept) for a in gone) and not any(alike(a, b) for a in kept for b in kept if a < b)


def slow_similar(own, other, width):
    sets = [(set(own[i : i + width].tolist()), set(other[i : i + width].tolist())) for i in range(len(own) - width + 1)]
    return [i for i, (a, b) in enumerate(sets) if len(a & b) >= 0.8 * len(a | b)]


def test_stretches_alike_equal_brute_force():
    r = np.random.default_rng(3)
    for top in (1 << 40, 60, 5):
        for _ in range(20):
            own = r.permutation(400)[:200].astype(np.uint32) if top > 400 else r.integers(0, top, 200).astype(np.uint32)
            other = own.copy()
            other[r.integers(0, 200, 6)] = np.arange(1000, 1006)
            other = np.insert(other, r.integers(0, 200), 2000)[:200].astype(np.uint32)
            assert windows.similar_stretches(own, other, 20, 0.8).tolist() == slow_similar(own, other, 20)


def test_scattered_and_periodic_lines_are_no_passages(spark):
    one, two, line = words(1, 40), words(2, 40), words(3, 10)
    texts = [
        words(4, 60) + one + two + words(5, 60), words(6, 30) + one + words(7, 200) + two + words(8, 30),  # side by side and far apart
        words(9, 60) + line * 6 + words(10, 60), words(11, 60) + line * 2 + words(12, 60),  # six times and twice
    ]
    df = documents(spark, [(i, " ".join(w)) for i, w in enumerate(texts)])
    assert all(not r.spans for r in windows.repeats(df).collect())


def test_further_places_of_a_representative(spark):
    """A document that has a shingle twice is compared at both places, whichever document stands for the key."""
    notice, more = words(20, 30), words(21, 30)
    a = words(22, 80) + notice + words(23, 80) + notice + more + words(24, 20)
    df = documents(spark, [(0, " ".join(a)), (1, " ".join(words(25, 40) + notice + more + words(26, 40)))])
    (found,) = [r for r in windows.repeats(df).collect() if r.spans]
    ((start, end),) = [(s.start, s.end) for s in found.spans]
    assert end - start == 60 and start == (190 if found.doc_id == 0 else 40)


def test_passages_around_a_common_notice(spark):
    """Pairs of documents share 50 words, 30 of them a notice that many hold: the notice's keys hide none of the pairs."""
    notice, rows = words(500, 30), []
    for i in range(40):
        shared = words(600 + i, 12) + notice + words(700 + i, 8)
        rows += [words(800 + i, 60) + shared + words(900 + i, 50), words(1000 + i, 20) + shared + words(1100 + i, 70)]
    rows += [words(1200 + i, 50) + notice + words(1300 + i, 50) for i in range(60)]
    got = {r.doc_id: r for r in windows.repeats(documents(spark, [(i, " ".join(w)) for i, w in enumerate(rows)])).collect()}
    found = [[(i, got[i].partners, [s.end - s.start for s in got[i].spans]) for i in (a, a + 1) if got[i].spans] for a in range(0, 80, 2)]
    assert all(len(f) == 1 and f[0][1] == [f[0][0] ^ 1] and f[0][2] == [50] for f in found)
    assert not any(got[i].spans for i in range(80, 140))


def test_pairs_settled_together_equal_one_by_one():
    r = np.random.default_rng(6)
    for top in (1 << 31, 300, 8):
        pairs = []
        for _ in range(200):
            n = int(r.integers(0, 150))
            own = r.integers(0, top, n).astype(np.uint32)
            other = own.copy()
            kind = r.integers(0, 5)
            if n and kind:
                other[r.integers(0, n, int(r.integers(0, 12)))] = r.integers(0, 1 << 31)
            if kind == 2:
                other = np.insert(other, int(r.integers(0, n + 1)), 7).astype(np.uint32)
            if kind == 3:
                other = r.permutation(other)
            if kind == 4:
                other = other[: int(r.integers(0, n + 1))]
            pairs.append((own, other))
        assert windows.side_by_side(pairs, 20, 0.8) == [windows.passages(a, b, 20, 0.8) for a, b in pairs]
    assert windows.side_by_side([], 20, 0.8) == []


def test_likely_stretches_hold_all_that_are_alike():
    r = np.random.default_rng(4)
    for kinds in (30, 400):
        for _ in range(60):
            other = r.integers(0, kinds, 90).astype(np.uint32)
            own = np.where(r.random(90) < 0.9, other, r.integers(kinds, 2 * kinds, 90)).astype(np.uint32)
            starts = windows.likely(own, np.unique(other), 20, 0.8).tolist()
            assert set(windows.similar_stretches(own, other, 20, 0.8).tolist()) <= set(starts)
            share = lambda s: len(set(own[s : s + 20]) & set(other)) / len(set(own[s : s + 20]))
            assert starts == [s for s in range(71) if share(s) >= 0.8 - 1e-9]
    assert windows.likely(own[:19], other, 20, 0.8).tolist() == [] == windows.likely(own, other[:0], 20, 0.8).tolist()
    stretches = np.array([(10, 60, 3), (40, 99, -2)], np.int32)
    assert windows.narrowed(stretches, np.array([5, 7]), 8, 20) == [(13, 34, 3)]
    assert windows.narrowed(stretches, np.array([], np.int64), 8, 20) == []


def test_settled_finds_what_each_stretch_alone_finds():
    r = np.random.default_rng(5)
    pairs, slow = [], []
    for _ in range(40):
        theirs = r.integers(0, 10**6, 160).astype(np.uint32)
        own = theirs[20:140].copy()
        own[r.integers(0, 120, 4)] = r.integers(10**6, 10**7, 4)
        asks = [(100 + a, 100 + b, -80) for a, b in ((0, 119), (10, 60), (50, 110))] + [(100, 150, -75)]
        pairs.append((own, 100, theirs, asks))
        found = []
        for low, high, shift in asks:
            mine = own[low - 100 : high - 99]
            found += [(low + a, low + b) for a, b in windows.passages(mine, theirs[low + shift : high + shift + 1], 20, 0.8)]
        slow.append(windows.merged(found))
    assert windows.settled(pairs, 20, 0.8) == slow


def test_passages_around_a_common_notice_are_found(spark):
    """Pairs share 64 words, 30 of them a notice of 60 other documents, and differ in one word; also copies of whole texts."""
    r = random.Random(5)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    notice = words(30)
    rows = [words(60) + notice + words(60) for _ in range(60)]
    for i in range(40):
        one = words(17) + notice + words(17)
        other = list(one)
        other[r.randrange(5, 59)] = f"changed{i}"
        rows += [words(40) + one + words(40), words(30) + other + words(50)]
    rows += [rows[0], rows[0][:20], rows[0][:20]]
    got = {r.doc_id: r for r in windows.repeats(documents(spark, [(i, " ".join(w)) for i, w in enumerate(rows)])).collect()}
    partners = [(set(got[i].partners), set(got[i + 1].partners)) for i in range(60, 140, 2)]
    assert all(60 + 2 * k in b or 61 + 2 * k in a for k, (a, b) in enumerate(partners))
    assert all(not got[i].spans for i in range(1, 60))
    assert sorted((len(got[i].spans), *got[i].partners) for i in (0, 140)) in ([(0,), (1, 0)], [(0,), (1, 140)])
    assert not got[141].spans and not got[142].spans


def test_near_passages_of_common_shingles_need_not_resemble_the_smallest_document(spark):
    """Every shingle of the passage is in 20 documents and more, of which only two share 50 words, one of them changed."""
    passage = words(70, 60)
    changed = [*passage[:30], "changed", *passage[31:]]
    others = [" ".join([*words(900 + i, 30), *(passage[:35] if i % 2 else passage[25:]), *words(2900 + i, 30)]) for i in range(60)]
    rows = [(i, t) for i, t in enumerate(others)]
    rows += [(80 + i, " ".join([*words(5000 + i, 30), *p, *words(6000 + i, 30)])) for i, p in enumerate((passage, changed))]
    got = {r.doc_id: r for r in windows.repeats(documents(spark, rows)).collect()}
    found = {i: [tuple(s) for s in r.spans] for i, r in got.items() if r.spans}
    assert found in ({80: [(30, 90)]}, {81: [(30, 90)]})
    assert [got[i].partners for i in found] == [[161 - i] for i in found]


def test_words_of_many_texts_have_the_hashes_of_single_words():
    r = random.Random(8)
    letters = "abcdefghXYZ0 .,-_é日\n😀 "
    texts = ["".join(r.choice(letters) for _ in range(r.choice([0, 1, 3, 9, 40, 700]))) for _ in range(300)]
    texts += ["x" * n for n in range(1, 40)] + ["long " * 300, "y" * 3000]
    for size in (50, 1 << 17):
        got = windows.words_of([None, *texts], size)
        assert [g.tolist() for g in got] == [[], *[[xxhash.xxh3_64_intdigest(w) for w in alnum_words(t)] for t in texts]]


def test_distinct_values_of_stretches_side_by_side():
    r = np.random.default_rng(4)
    for n in (0, 5, 19, 20, 21, 90):
        values = r.integers(0, 25, n)
        assert windows.distinct_counts(values, 20).tolist() == [len(set(values[i : i + 20].tolist())) for i in range(n - 19)]


def test_places_without_a_value_make_no_window():
    values = np.full(60, np.iinfo(np.uint64).max, np.uint64)
    values[30] = 5
    assert [x.tolist() for x in windows.compact_windows(values, 12)] == [[0], [30], [59]]


def test_a_task_of_the_verification_runs_one_python_step(spark, capsys):
    """Also where few documents take part and nothing is shuffled: each step has workers of its own."""
    df = documents(spark, [(i, " ".join(words(5, 80))) for i in range(4)]).withColumn("rid", windows.row_id())
    rid = sorted(r.rid for r in df.collect())
    found = spark.createDataFrame([(rid[1], rid[0], 0, 0, 75)], "rid long, rep long, shift int, low int, high int")
    got = windows.verified(df, found, 46, 0.8)
    got.explain()
    assert capsys.readouterr().out.count("MapInArrow") == 2  # send, and behind an exchange compare
    assert [(r.rid, r.rep, r.start, r.end) for r in got.collect()] == [(rid[1], rid[0], 0, 80)]


def test_only_text_that_others_hold_is_compared(spark, monkeypatch):
    """A line of ten words in all documents makes no candidates; the two that share a passage are the only ones."""
    line, passage = words(40, 10), words(41, 60)
    rows = [words(3000 + i, 70) + line + words(4000 + i, 70) for i in range(50)]
    rows += [words(5000, 30) + passage + words(5001, 40), words(5002, 20) + [*passage[:30], "changed", *passage[31:]] + words(5003, 60)]
    seen, keep = {}, windows.store
    monkeypatch.setattr(windows, "store", lambda df, name: seen.setdefault(name, keep(df, name)))
    got = {r.doc_id: r for r in windows.repeats(documents(spark, [(i, " ".join(w)) for i, w in enumerate(rows)])).collect()}
    found = {i: [tuple(s) for s in r.spans] for i, r in got.items() if r.spans}
    assert found in ({50: [(30, 90)]}, {51: [(20, 80)]})
    assert seen["candidates"].select("rid", "rep").distinct().count() == 1


def test_regions_hold_all_stretches_alike(spark):
    """Whatever resembles another document is in the regions, changed, inserted and repeated words among it; other text is not."""
    r, rows = random.Random(3), []
    for i in range(25):
        one = words(100 + i, 90) if i % 3 else words(100 + i, 9) * 10
        other = list(one)
        for _ in range(i % 4):
            at = r.randrange(len(other))
            other[at : at + r.randrange(2)] = [f"changed{i}x{at}"]
        rows += [words(200 + i, 60) + one + words(300 + i, r.randrange(200)), words(400 + i, r.randrange(50)) + other + words(500 + i, 150)]
    rows += [words(600 + i, 300) + words(40, 15) for i in range(10)]
    rows += [words(40, 15), []]
    df = documents(spark, [(i, " ".join(w)) for i, w in enumerate(rows)]).withColumn("rid", windows.row_id())
    ids = {x.rid: x.doc_id for x in df.collect()}
    got = {ids[x.rid]: x.regions for x in windows.held_regions(df, 46, 0.8).collect()}
    assert set(got) <= set(range(50))
    own = [windows.shingles(" ".join(w)).astype(np.uint32) for w in rows]
    alike = 0
    for i in range(0, 50, 2):
        for a, b in ((i, i + 1), (i + 1, i)):
            for shift in range(-len(own[a]) + 46, len(own[b]) - 45):
                low, n = max(0, -shift), min(len(own[a]), len(own[b]) - shift)
                starts = windows.similar_stretches(own[a][low:n], own[b][low + shift : n + shift], 46, 0.8) + low
                alike += len(starts)
                assert all(any(x.low <= s and s + 45 <= x.high for x in got[a]) for s in starts.tolist())
    assert alike > 500
    assert sum(x.high - x.low + 1 for regions in got.values() for x in regions) < 2 * 25 * 150


def test_documents_are_counted_over_all_batches():
    r = np.random.default_rng(7)
    batches = [[np.unique(r.integers(0, 1 << 63, 40, np.uint64) | np.uint64(1)) for _ in range(3)] for _ in range(4)]
    common = batches[0][0][:9]
    for i, docs in enumerate(batches):
        for k in range(3):
            docs[k] = np.concatenate((docs[k], common[: 3 * i], common[: 3 * i]))  # twice in a document
    blobs, index = {}, []
    for no, docs in enumerate(batches):
        rows = windows.dealt_values(no, np.concatenate(docs), np.repeat(range(3), [len(d) for d in docs]), sizes=np.array([1])).to_pylist()
        assert rows[0]["part"] == -1 and rows[0]["line"] is None and rows[0]["sizes"] is not None
        index.append(np.frombuffer(rows[0]["index"], np.uint32))
        for x in rows[1:]:
            blobs.setdefault(x["part"], []).append((no, (x["data"], x["counts"])))
    ranks = {}
    for part in sorted(blobs):
        for (no, _), ranked in zip(blobs[part], windows.ranks_of([x for _, x in blobs[part]])):
            ranks.setdefault(no, []).append(ranked)
    held = Counter(v for docs in batches for d in docs for v in set(d.tolist()))
    for no, docs in enumerate(batches):
        got = np.frombuffer(b"".join(ranks[no]), np.uint8)[index[no]]
        assert got.tolist() == [int(np.log2(held[v])) for v in np.concatenate(docs).tolist()]
