"""Benchmark decontamination: an FM-index over each shard of the training text, searched for benchmark windows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from expogrid.llm.common import alnum_words, blocks_of, rows_of, store

WINDOW = 13
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
RESULT = "n_words long, items array<long>, spans array<struct<start:bigint,end:bigint>>"


def suffix_array(words: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling. Zeros end runs; each is smaller than every word and than later zeros."""
    n = len(words)
    ends = np.flatnonzero(words == 0)
    rank = words.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    step = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (int(second.max()) + 1) + second
        order = np.argsort(key, kind="stable")
        moved = np.empty(n, np.int64)
        moved[order] = np.cumsum(np.concatenate(([0], (np.diff(key[order]) != 0).astype(np.int64))))
        rank, step = moved, step * 2
        if step >= n or rank[order[-1]] == n - 1:
            return order


class Wavelet:
    """Wavelet matrix: ranks of any symbol in a sequence by one bit vector for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.size, self.levels = len(symbols), []
        for bit in range(max(1, top.bit_length()) - 1, -1, -1):
            ones = (symbols >> bit) & 1
            packed = np.packbits(ones.astype(np.uint8), bitorder="little")
            packed = np.concatenate((packed, np.zeros(16 - len(packed) % 8, np.uint8))).view(np.uint64)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))
            self.levels.append((bit, packed, before, self.size - int(ones.sum())))
            symbols = np.concatenate((symbols[ones == 0], symbols[ones == 1]))

    @staticmethod
    def ones(packed: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        word, inside = at >> 6, (at & 63).astype(np.uint64)
        return before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << inside) - np.uint64(1)))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        start = np.zeros(len(at), np.int64)
        for bit, packed, before, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            a, b = self.ones(packed, before, start), self.ones(packed, before, at)
            start, at = np.where(one, zeros + a, start - a), np.where(one, zeros + b, at - b)
        return at - start


class Index:
    """FM-index of word runs. ``words``: ids from 1, with a 0 after each run."""

    def __init__(self, words: np.ndarray, top: int, sample: int = 16):
        order = suffix_array(words)
        last = words[order - 1]  # the word before each suffix; the first suffix has the closing 0 before it
        self.counts = np.concatenate(([0], np.cumsum(np.bincount(words, minlength=top + 1))))
        self.last, self.tree = last, Wavelet(last.astype(np.int64), top)
        # a suffix keeps its place if that is a multiple of the sample rate or begins a run, so walks stay in runs
        self.kept = (order % sample == 0) | (last == 0)
        self.kept_before = np.concatenate(([0], np.cumsum(self.kept)))
        self.places = order[self.kept]

    def search(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range [low, high) of every window, all searched backwards in step. Windows are aligned right."""
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), len(self.last), np.int64)
        width = windows.shape[1]
        for k in range(width):
            on = np.flatnonzero((lengths > k) & (low < high))
            if not len(on):
                break
            symbol = windows[on, width - 1 - k].astype(np.int64)
            low[on] = self.counts[symbol] + self.tree.rank(symbol, low[on])
            high[on] = self.counts[symbol] + self.tree.rank(symbol, high[on])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of suffixes: step back through the ranks to one that is kept."""
        steps, rows = np.zeros(len(rows), np.int64), rows.copy()
        walking = np.flatnonzero(~self.kept[rows])
        while len(walking):
            at = rows[walking]
            symbol = self.last[at].astype(np.int64)
            rows[walking] = self.counts[symbol] + self.tree.rank(symbol, at)
            steps[walking] += 1
            walking = walking[~self.kept[rows[walking]]]
        return self.places[self.kept_before[rows]] + steps


class Windows:
    """The distinct windows of a set of benchmark items, and the items of each."""

    def __init__(self, items: list[tuple[int | None, str | None]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        of: dict[tuple[int, ...], set] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in alnum_words(text)]
            for start in range(max(1, len(ids) - width + 1) if ids else 0):
                of.setdefault(tuple(ids[start : start + width]), set()).add(item)
        self.lengths = np.array([len(w) for w in of], np.int64)
        self.rows = np.array([(0,) * (width - len(w)) + w for w in of], np.int32).reshape(len(of), width)
        self.items = [frozenset(x for x in v if x is not None) for v in of.values()]
        self.shortest = int(self.lengths.min()) if of else 0


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans, touching ones joined."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def hits(texts: list[np.ndarray], windows: Windows) -> list[tuple[set, list[tuple[int, int]]]]:
    """Items and merged word spans of each document of one shard. ``texts``: word ids, 0 where no item has the word."""
    found: list[tuple[set, list]] = [(set(), []) for _ in texts]
    if not len(windows.rows):
        return found
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    line = np.zeros(starts[-1], np.int32)
    for s, t in zip(starts, texts):
        line[s : s + len(t)] = t
    known = np.concatenate(([0], (line != 0).astype(np.int8), [0]))
    edges = np.flatnonzero(np.diff(known))
    begin, end = edges[::2], edges[1::2]
    long = end - begin >= windows.shortest  # no window fits into a shorter run
    begin, end = begin[long], end[long]
    if not len(begin):
        return found
    sizes = end - begin + 1
    offsets = np.cumsum(sizes) - sizes
    kept = line[np.repeat(begin - offsets, sizes) + np.arange(sizes.sum())]  # each run with the 0 behind it
    index = Index(kept, len(windows.vocabulary))
    low, high = index.search(windows.rows, windows.lengths)
    n = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(n)), n)
    rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    place = index.locate(rows)
    run = np.searchsorted(offsets, place, side="right") - 1
    place = place - offsets[run] + begin[run]
    doc = np.searchsorted(starts, place, side="right") - 1
    for d, p, w in zip(doc.tolist(), (place - starts[doc]).tolist(), which.tolist()):
        found[d][0].update(windows.items[w])
        found[d][1].append((p, p + int(windows.lengths[w])))
    return [(items, merged(spans)) for items, spans in found]


def scan(docs: DataFrame, benchmark: DataFrame, text: Column | None = None, width: int = WINDOW, shard_words: int = 2_000_000, block_bytes: int = 32 << 20, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Each input row as ``row``, with n_words, items and spans: where words of windows stand.

    A window is ``width`` consecutive words of an item, or a whole shorter item. A task gathers documents up to
    ``shard_words`` words, indexes the runs of words that occur in the benchmark, searches all windows backwards and
    locates their occurrences from sampled suffix places; spans that overlap or touch are merged. Texts stay in their
    scan: nothing is shuffled. The benchmark is sent to the tasks in blocks of about ``block_bytes``; each further
    block is one more pass over the stored result of the last.

    A null text has no words. Items without words have no windows; a null item id marks words but is not listed.
    Repeated items count once. Empty tables give no rows, or rows without spans. Columns of any name may ride along.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), (F.col("text") if text is None else text).alias("body"))
    found = named.select("*", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<long>").alias("items"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    for b in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        sent = spark.sparkContext.broadcast([(r[0], r[1]) for r in part.collect()])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            windows = Windows(sent.value, width)
            get = windows.vocabulary.get
            held, texts, words = [], [], 0

            def done() -> Iterator[pa.RecordBatch]:
                results = iter(hits(texts, windows))
                sizes = iter(len(t) for t in texts)
                for batch in held:
                    old = list(zip(batch["items"].to_pylist(), batch["spans"].to_pylist()))
                    new = [next(results) for _ in old]
                    all_items = [sorted({*a, *x[0]}) for (a, _), x in zip(old, new)]
                    spans = [[{"start": s, "end": e} for s, e in merged([(y["start"], y["end"]) for y in b] + x[1])] for (_, b), x in zip(old, new)]
                    yield pa.RecordBatch.from_arrays(
                        [batch["row"], batch["body"], pa.array([next(sizes) for _ in old], pa.int64()), pa.array(all_items, pa.list_(pa.int64())), pa.array(spans, SPANS)],
                        names=["row", "body", "n_words", "items", "spans"],
                    )

            for batch in rows_of(batches, 200):
                for body in batch["body"]:
                    parts = [np.fromiter(map(get, w, repeat(0)), np.int32, len(w)) for w in blocks_of(body.as_py())]
                    texts.append(np.concatenate(parts) if parts else np.zeros(0, np.int32))
                    words += len(texts[-1])
                held.append(batch)
                if words >= shard_words:
                    yield from done()
                    held, texts, words = [], [], 0
            yield from done()

        found = found.mapInArrow(run, found.schema)
        if b < blocks - 1:
            found = store(found, "windows")
    return found.drop("body")


def n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contaminated(share: int = 20) -> Column:
    """At least one word in ``share`` stands in a benchmark window."""
    return (n_hit() > 0) & (n_hit() * share >= F.col("n_words"))


def items_digest(items: Column) -> Column:
    """SHA-256 of the ids, sorted as text and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(items.cast("array<string>")), ",").cast("binary"), 256)
