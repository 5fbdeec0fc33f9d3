"""Substring deduplication: compact windows of min-hashes over word shingles, joined and verified."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from expogrid.llm.common import WORD_BYTES, blocks_of, rows_of, short_batches, store, tidy_shuffles
from expogrid.llm.sketches import mixed
from expogrid.sources import sinks

SHINGLE, PASSAGE = 5, 50  # words
SIMILARITY = 0.8
HASHES = 3
#: Documents that are compared with one partner in one part.
PART = 500
#: A rare shingle that no more documents hold brings all of them together, a more frequent one all with the first.
FEW = 16
#: Elections among the documents of a rare shingle that share no passage with those elected before; then all pairs.
ROUNDS = 3
EVERY = 1 << 62
#: Bytes of texts whose values are counted together, and by how many leading bits of a value its counts are dealt.
CHUNK, PART_BITS = 8 << 20, 10
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class WordHashes(dict):
    """XXH3 of words; starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_BASE = 0xD1342543DE82EF93  # 3 modulo 8, so that powers of it differ in all but their lowest bits


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2 ** 64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(n, base, np.uint64)
        x[:1] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


_POWERS = _powers(1 << 16)
#: What XXH3 lays over words of up to 3, 8 and (both ends) 16 bytes.
_FLIP, _FLIPS = np.uint64(0x87275A9B), tuple(map(np.uint64, (0xC73AB174C5ECD5A2, 0x6782737BEA4239B9, 0xAF56BC3B0996523A)))


def range_values(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit value for each range of 64-bit values, the same for the same range wherever it stands: a polynomial."""
    up, down = _POWERS if len(values) < len(_POWERS[0]) else _powers(len(values) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)])))
        return mixed((total[ends] - total[starts]) * down[starts], 13)


def _spread(x: np.ndarray, shift: int, factor: int, last: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(last))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _folded(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Both halves of the 128-bit product, one upon the other."""
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    a, b, c, d = x & low, x >> half, y & low, y >> half
    cross = (a * c >> half) + (b * c & low) + a * d
    return (x * y) ^ (b * d + (b * c >> half) + (cross >> half))


def word_values(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """XXH3 and first place of every word of a line of words and blanks, for words of up to 16 bytes all at once."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = np.frombuffer(data, np.uint8) != 0x20
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    size, out = ends - starts, np.zeros(len(starts), np.uint64)
    eight = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))  # the eight bytes from every place on
    with np.errstate(over="ignore"):
        i = np.flatnonzero(size < 4)
        first, middle, last = (eight[at] & np.uint64(0xFF) for at in (starts[i], starts[i] + size[i] // 2, ends[i] - 1))
        x = (first << np.uint64(16)) | (middle << np.uint64(24)) | last | (size[i].astype(np.uint64) << np.uint64(8))
        x ^= _FLIP
        x = _spread(x, 33, 0xC2B2AE3D27D4EB4F, 29) * np.uint64(0x165667B19E3779F9)
        out[i] = x ^ (x >> np.uint64(32))
        i = np.flatnonzero((size >= 4) & (size <= 8))
        n = size[i].astype(np.uint64)
        x = ((eight[ends[i] - 4] & np.uint64(0xFFFFFFFF)) + (eight[starts[i]] << np.uint64(32))) ^ _FLIPS[0]
        x = (x ^ _turned(x, 49) ^ _turned(x, 24)) * np.uint64(0x9FB21C651E98DF25)
        x = (x ^ ((x >> np.uint64(35)) + n)) * np.uint64(0x9FB21C651E98DF25)
        out[i] = x ^ (x >> np.uint64(28))
        i = np.flatnonzero((size > 8) & (size <= 16))
        x, y = eight[starts[i]] ^ _FLIPS[1], eight[ends[i] - 8] ^ _FLIPS[2]
        out[i] = _spread(size[i].astype(np.uint64) + x.byteswap() + y + _folded(x, y), 37, 0x165667919E3779F9, 32)
    for k in np.flatnonzero(size > 16).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]])
    return out, starts


def word_line(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES)


def word_count(text: str | None) -> int:
    n = 0
    for data in blocks_of(text, word_line) if text else ():
        inside = np.frombuffer(data, np.uint8) != 0x20
        n += int(inside[0]) + int(np.count_nonzero(inside[1:] > inside[:-1]))
    return n


def words_of(texts: list[str | None], size: int = 1 << 17) -> list[np.ndarray]:
    """A 64-bit value of every word of each text; about ``size`` bytes of all texts are read at a time."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    held: list[tuple[int, bytes]] = []

    def read() -> None:
        values, places = word_values(b" ".join(data for _, data in held))
        cuts = np.searchsorted(places, np.cumsum([len(data) + 1 for _, data in held])[:-1])
        for (i, _), part in zip(held, np.split(values, cuts)):
            out[i].append(part)
        held.clear()

    for i, text in enumerate(texts):
        for data in blocks_of(text, word_line, size) if text else ():
            held.append((i, data))
            if sum(len(x) for _, x in held) >= size:
                read()
    if held:
        read()
    return [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in out]


def shingles(text: str | None, words: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit value for every run of five words of a whole text, never 0. ``words``: its word values, if they are there."""
    words = words_of([text])[0] if words is None else words
    n = len(words) - SHINGLE + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    value = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            value = value * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    return mixed(value, 7) | np.uint64(1)


def shingle_lines(texts: list[str | None], most: int = 1 << 15) -> list[np.ndarray]:
    """``shingles`` of each text; those of about ``most`` words are made at a time."""
    words, out, held = words_of(texts), [], 0
    sizes = [len(w) for w in words]
    first = 0
    for i, n in enumerate(sizes):
        held += n
        if held >= most or i + 1 == len(words):
            line, at = shingles(None, np.concatenate(words[first : i + 1])), 0
            for n in sizes[first : i + 1]:
                out.append(line[at : at + max(0, n - SHINGLE + 1)])
                at += n
            first, held = i + 1, 0
    return out


def sliding(values: np.ndarray, width: int, pick: np.ufunc, rest: int) -> np.ndarray:
    """Minimum or maximum of every stretch of ``width`` values, from running ones of blocks in both directions."""
    n = len(values)
    padded = np.concatenate((values, np.full(-n % width, rest, values.dtype))).reshape(-1, width)
    ahead = pick.accumulate(padded, axis=1).ravel()
    back = pick.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[: n - width + 1], ahead[width - 1 : n])


def compact_windows(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, place, high): all stretches within low..high that hold ``place`` have their minimum there, the first one.

    These are the spans of the Cartesian tree's nodes; only those of ``width`` values and more are made. A 0 ends a
    text, and the largest value there is makes no window. A node with so wide a span is the minimum of some stretch of
    ``width``, and so are the nearest smaller values on both sides of it, so the tree is built over such values alone.
    """
    n = len(values)
    if n < width:
        none = np.zeros(0, np.int64)
        return none, none, none
    top = np.iinfo(np.uint64).max
    least = sliding(values, width, np.minimum, top)
    edge = np.zeros(width - 1, np.uint64)
    largest = sliding(np.concatenate((edge, least, edge)), width, np.maximum, 0)
    chosen = np.flatnonzero(((values == largest) & (values != top)) | (values == 0))
    left, right = [-1] * len(chosen), [n] * len(chosen)
    stack: list[int] = []
    places, kept = chosen.tolist(), values[chosen].tolist()
    for i, value in enumerate(kept):
        while stack and kept[stack[-1]] > value:
            right[stack.pop()] = places[i]
        if stack:
            left[i] = places[stack[-1]]
        stack.append(i)
    low, high = np.array(left, np.int64) + 1, np.array(right, np.int64) - 1
    wide = (values[chosen] != 0) & (high - low + 1 >= width)
    return low[wide], chosen[wide], high[wide]


def further_places(line: np.ndarray, doc: np.ndarray, low: np.ndarray, place: np.ndarray, high: np.ndarray, width: int) -> np.ndarray:
    """For each window, in the order of places: 0 if its minimum is new to the document, 1 if not, 2 if what is around is not new either.

    Around is all that a stretch of ``width`` with that minimum can hold. Windows of 2 add nothing to those before.
    """
    kind = np.zeros(len(place), np.int8)
    order = np.lexsort((place, line[place], doc))
    repeated = np.concatenate(([False], (doc[order[1:]] == doc[order[:-1]]) & (line[place[order[1:]]] == line[place[order[:-1]]]))) if len(place) else np.zeros(0, bool)
    kind[order[repeated]] = 1
    members = order[repeated | np.concatenate((repeated[1:], [False]))] if len(place) else order
    a, b = np.maximum(low[members], place[members] - width + 1), np.minimum(high[members], place[members] + width - 1)
    # Repeats that share the value of a text, a place within and what is around; the first of them is the new one.
    spot = (doc[members].astype(np.uint64) << np.uint64(32)) | ((place[members] - a) << 16 | (b - a)).astype(np.uint64)
    around = range_values(line, a, b + 1) ^ mixed(spot, 17)
    first = np.zeros(len(members), bool)
    first[np.unique(around, return_index=True)[1]] = True
    kind[members[~first]] = 2
    return kind


def row_id() -> Column:
    """Identity of a row: a hash of id and whole text. Rows alike in both count as one document."""
    return F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit("")))


def windows_of(line: np.ndarray, order: np.ndarray, starts: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, ...]:
    """(key, text, further, place, before, after) of all compact windows by ``order``; ``starts`` are the texts' places."""
    low, place, high = compact_windows(order, width)
    doc = np.searchsorted(starts, place, side="right") - 1
    clip = lambda x: np.minimum(x, 32767).astype(np.int16)
    return mixed(line[place], seed).view(np.int64), doc, further_places(line, doc, low, place, high, width), place, clip(place - low), clip(high - place)


_ROWS = "key long, rid long, further byte, place int, before short, after short"
_NAMES = ["key", "rid", "further", "place", "before", "after"]


def chunks_of(batches: Iterator[pa.RecordBatch], column: str, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded length, of about ``CHUNK`` bytes of a column at most."""
    for batch in rows_of(batches, rows):
        size = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.flatnonzero(np.diff(size // CHUNK)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            yield batch.slice(a, b - a)


def laid(parts: list[np.ndarray], places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, line, spots): lines end to end, a 0 before each, and where their values stand in the texts."""
    starts = np.cumsum([1, *(len(x) + 1 for x in parts)])
    line, spots = np.zeros(starts[-1], np.uint64), np.zeros(starts[-1], np.int32)
    for s, x, at in zip(starts, parts, places):
        line[s : s + len(x)], spots[s : s + len(x)] = x, at
    return starts, line, spots


def emitted(lines: DataFrame, hashes: int, width: int) -> DataFrame:
    """Compact windows of all lines: key (of hash function and shingle), rid, further, place, before, after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks_of(batches, "line", 400):
            starts, line, spots = laid(*zip(*(separated(*x) for x in stored_lines(batch))))
            rid = batch["rid"].to_numpy()
            for h in range(hashes):
                values = np.where(line == 0, np.uint64(0), mixed(line, 100 + h) | np.uint64(1))
                key, doc, further, place, before, after = windows_of(line, values, starts, width, 200 + h)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, rid[doc], further, spots[place], before, after)], names=_NAMES)

    return lines.select("rid", "line", "bounds").mapInArrow(run, _ROWS)


def shared(rows: DataFrame) -> DataFrame:
    """Windows whose key several documents have, with the number of documents and the smallest of them."""
    held = F.count_if(F.col("further") == 0).alias("n")
    keys = rows.groupBy("key").agg(F.min("rid").alias("least"), F.max("rid").alias("most"), held).filter("least <> most").drop("most")
    return rows.join(keys, "key")


def overlaps(met: DataFrame, few: int, width: int) -> DataFrame:
    """(rid, rep, shift, low, high): a stretch of a document that may hold repeats of ``rep``, ``shift`` places on.

    A key brings all its documents together with the smallest, or with each other if it has no more than ``few``. The
    windows of both are laid over each other at the minimum: their overlap is where both sides have the same minimum.
    Overlaps with the same partner and shift make one stretch, from the first to the last.
    """
    stands = (F.col("further") < 2) & ((F.col("rid") == F.col("least")) | (F.col("n") <= few))
    reps = met.filter(stands).select("key", F.col("rid").alias("rep"), F.col("place").alias("at"), F.col("before").alias("back"), F.col("after").alias("ahead"))
    both = met.join(reps, "key").filter("rep < rid")
    low, high = F.col("place") - F.least("before", "back"), F.col("place") + F.least("after", "ahead")
    wide = both.select("rid", "rep", (F.col("at") - F.col("place")).alias("shift"), low.alias("low"), high.alias("high")).filter(F.col("high") - F.col("low") + 1 >= width)
    return wide.groupBy("rid", "rep", "shift").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def in_order(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the values, sorted by them, and the values so."""
    if values.dtype != np.uint32:
        order = np.argsort(values, kind="stable")
        return order, values[order]
    key = np.sort((values.astype(np.uint64) << np.uint64(32)) | np.arange(len(values), dtype=np.uint64))  # both at once: much faster
    return (key & np.uint64(0xFFFFFFFF)).astype(np.int64), key >> np.uint64(32)


def previous(order: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Where the same value stood last, for each place; -1 if nowhere."""
    before = np.full(len(order), -1)
    same = value[1:] == value[:-1]
    before[order[1:][same]] = order[:-1][same]
    return before


def distinct_counts(values: np.ndarray, width: int) -> np.ndarray:
    """How many distinct values each stretch of ``width`` holds, by its first place: those that stand in it first."""
    return _distinct_counts(*in_order(values), width)


def _distinct_counts(order: np.ndarray, value: np.ndarray, width: int) -> np.ndarray:
    n = len(order)
    steps = np.bincount(np.maximum(previous(order, value) + 1, np.arange(n) - width + 1), minlength=n + 1)
    steps[1:] -= 1
    return np.cumsum(steps[: max(n - width + 1, 0)])


def similar_stretches(own: np.ndarray, other: np.ndarray, width: int, similarity: float) -> np.ndarray:
    """Places at which ``width`` values of both, side by side, have that Jaccard similarity of distinct values."""
    order, value = in_order(np.stack((own, other), axis=1).ravel())
    union, side = _distinct_counts(order, value, 2 * width)[::2], (order & 1).astype(bool)
    shared = _distinct_counts(order[~side] >> 1, value[~side], width) + _distinct_counts(order[side] >> 1, value[side], width) - union
    return np.flatnonzero(shared >= similarity * union - 1e-9)


def first_of(own: np.ndarray, other: np.ndarray) -> int:
    """First place of a value of ``own`` that ``other`` has; there is one."""
    few = np.flatnonzero((own[:12, None] == other).any(axis=1))
    return int(few[0]) if len(few) else int(np.flatnonzero(np.isin(own, other))[0])


def spans_of(good: np.ndarray, pair: np.ndarray, own: np.ndarray, other: np.ndarray, width: int) -> Iterator[tuple[int, int, int]]:
    """(pair, start, end) of what stretches alike cover, from the first to the last value that both sides have."""
    if not len(good):
        return
    breaks = np.flatnonzero((np.diff(good) > width + SHINGLE - 1) | (np.diff(pair) != 0))
    firsts, lasts = np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [len(good) - 1]))
    for i, a, b in zip(pair[firsts].tolist(), good[firsts].tolist(), (good[lasts] + width).tolist()):
        if own[a] != other[a] or own[b - 1] != other[b - 1]:
            a, b = a + first_of(own[a:b], other[a:b]), b - first_of(own[a:b][::-1], other[a:b])
        yield i, a, b


def passages(own: np.ndarray, other: np.ndarray, width: int, similarity: float) -> list[tuple[int, int]]:
    """(start, end) in words of what all stretches alike cover, from the first to the last shingle that both have."""
    return side_by_side([(own, other)], width, similarity)[0]


def parts_of(pairs: list[tuple[np.ndarray, np.ndarray]], most: int = 1 << 17) -> Iterator[slice]:
    """Stretches of a list whose pairs hold about ``most`` values together."""
    start, held = 0, 0
    for i, (own, _) in enumerate(pairs):
        held += len(own)
        if held >= most or i + 1 == len(pairs):
            yield slice(start, i + 1)
            start, held = i + 1, 0


def side_by_side(pairs: list[tuple[np.ndarray, np.ndarray]], width: int, similarity: float) -> list[list[tuple[int, int]]]:
    """``passages`` of many pairs, all laid end to end; no stretch of two pairs counts."""
    sizes = np.array([min(len(a), len(b)) for a, b in pairs], np.int64)
    of, start = np.repeat(np.arange(len(pairs)), sizes), np.cumsum(sizes) - sizes
    own, other = (np.concatenate([p[i][:n] for p, n in zip(pairs, sizes)]) if len(pairs) else np.zeros(0, np.uint32) for i in (0, 1))
    good = similar_stretches(own, other, width, similarity)
    good = good[of[good] == of[good + width - 1]]  # not those across two pairs
    out: list[list[tuple[int, int]]] = [[] for _ in pairs]
    for i, a, b in spans_of(good, of[good], own, other, width):
        out[i].append((int(a - start[i]), int(b - start[i]) + SHINGLE - 1))
    return out


def likely(own: np.ndarray, held: np.ndarray, width: int, similarity: float) -> np.ndarray:
    """Starts of the stretches of ``own`` whose distinct values are in the sorted ``held`` often enough to be alike to any of it.

    The similarity of two stretches is at most the share of the distinct values of one that the other's text has at all.
    """
    if not len(held):
        return np.zeros(0, np.int64)
    return mostly(own, held[np.minimum(np.searchsorted(held, own), len(held) - 1)] == own, width, similarity)


def mostly(own: np.ndarray, present: np.ndarray, width: int, similarity: float) -> np.ndarray:
    """Starts of the stretches of which so many of the distinct values are ``present``."""
    n, place = len(own) - width + 1, np.arange(len(own))
    if n < 1:
        return place[:0]
    if present.all():
        return place[:n]
    first, last = np.maximum(np.maximum(previous(*in_order(own)) + 1, place - width + 1), 0), np.minimum(place, n - 1)

    def distinct(some: np.ndarray) -> np.ndarray:
        return np.cumsum((np.bincount(first[some], minlength=n + 1) - np.bincount(last[some] + 1, minlength=n + 1))[:n])

    some = first <= last
    return np.flatnonzero(distinct(some & present) >= similarity * distinct(some) - 1e-9)


def narrowed(stretches: np.ndarray, starts: np.ndarray, first: int, width: int) -> list[tuple[int, int, int]]:
    """(low, high, shift) of what is left of stretches between the first and the last likely start in each."""
    if not len(starts):
        return []
    low, high, shift = stretches.T
    a, b = np.searchsorted(starts, low - first), np.searchsorted(starts, high - first - width + 1, side="right")
    some = a < b
    return list(zip((first + starts[a[some]]).tolist(), (first + starts[b[some] - 1] + width - 1).tolist(), shift[some].tolist()))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, overlapping and touching ones made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def settled(pairs: list[tuple[np.ndarray, int, np.ndarray, list[tuple[int, int, int]]]], width: int, similarity: float) -> list[list[tuple[int, int]]]:
    """Spans found for each of (own shingles, place of the first, the partner's, stretches as (low, high, shift)).

    The longest stretches come first, twice as many a turn; one within spans found already has nothing to add.
    """
    spans: list[list[tuple[int, int]]] = [[] for _ in pairs]
    left = {i: sorted(p[3], key=lambda a: a[0] - a[1]) for i, p in enumerate(pairs)}
    turn = 1
    while left:
        chosen = []
        for i, asks in list(left.items()):
            asks = [a for a in asks if not any(s <= a[0] and a[1] + SHINGLE <= e for s, e in spans[i])]
            chosen += [(i, a) for a in asks[:turn]]
            left[i] = asks[turn:]
            if not left[i]:
                del left[i]
        sides = []
        for i, (low, high, shift) in chosen:
            own, first, theirs, _ = pairs[i]
            sides.append((own[low - first : high - first + 1], theirs[low + shift : high + shift + 1]))
        for part in parts_of(sides):
            for (i, (low, _, _)), found in zip(chosen[part], side_by_side(sides[part], width, similarity)):
                spans[i] += [(low + a, low + b) for a, b in found]
        for i in {i for i, _ in chosen}:
            spans[i] = merged(spans[i])
        turn *= 2
    return spans


def verified(docs: DataFrame, found: DataFrame, width: int, similarity: float) -> DataFrame:
    """(rid, rep, partner, start, end): word spans of documents whose every stretch resembles the partner's beside it.

    Both stretches have ``width`` shingles, and the Jaccard similarity is that of the distinct ones, of which 32 bits
    are compared.

    ``docs`` are texts or the lines of ``region_lines``. Lines move once to where their candidates are. A document sends
    the shingles of its stretches once to each partner; a partner sends its line to each of the parts that its
    candidates are dealt to, about ``PART`` of them each, so one that many share is split. There they are compared, a
    partner's part in one pass. What a line leaves out resembles nothing.
    """
    if "text" in docs.columns:
        whole = F.array(F.struct(F.lit(0).alias("low"), F.lit((1 << 31) - 2).alias("high")))
        docs = store(region_lines(docs, docs.select("rid", whole.alias("regions")).distinct()), "whole-shingles")
    pairs = found.groupBy("rid", "rep").agg(F.collect_list(F.struct("low", "high", "shift")).alias("stretches"))
    parts = pairs.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    salted = pairs.join(parts, "rep").withColumn("salt", F.pmod("rid", F.col("parts")).cast("int")).drop("parts")
    asks = salted.groupBy("rid").agg(F.collect_list(F.struct("rep", "salt", "stretches")).alias("asks"))
    gives = salted.select("rep", "salt").distinct().groupBy("rep").agg(F.collect_list("salt").alias("salts")).withColumnRenamed("rep", "rid")
    # Stored, so that the join knows how many documents take part: the lines of few are not moved through a shuffle.
    roles = store(asks.join(gives, "rid", "full_outer").withColumn("asks", F.coalesce("asks", F.array())), "roles")

    schema = "rep long, salt int, kind int, rid long, doc_id long, first int, data binary, stretches binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("rep", "salt", "kind", "rid", "doc_id", "first", "data", "stretches")
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        last = None
        for batch in rows_of(batches, 200):
            out: list[tuple] = []
            asks, at = batch["asks"].values, batch["asks"].offsets.to_numpy()
            reps, dealt, lists = (asks.field(c) for c in ("rep", "salt", "stretches"))
            wanted = np.stack([lists.values.field(c).to_numpy() for c in ("low", "high", "shift")], axis=1).astype(np.int32)
            reps, dealt, bounds = reps.to_numpy(), dealt.to_numpy(), lists.offsets.to_numpy()
            for i, (rid, doc_id, (line, places), salts) in enumerate(zip(*(batch[c].to_pylist() for c in ("rid", "doc_id")), stored_lines(batch), batch["salts"].to_pylist())):
                if rid == last:
                    continue  # a repeated row
                last = rid
                line = line.astype(np.uint32)
                if salts:
                    data, held = line.tobytes(), places.tobytes()
                    out += [(rid, salt, 0, rid, doc_id, 0, data, held) for salt in salts]
                own = spread(line, places, 2) if at[i] < at[i + 1] else line
                for k in range(at[i], at[i + 1]):
                    some = wanted[bounds[k] : bounds[k + 1]]
                    first, end = int(some[:, 0].min()), int(some[:, 1].max()) + 1
                    out.append((int(reps[k]), int(dealt[k]), 1, rid, doc_id, first, own[first:end].tobytes(), some.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 8, kinds)], names=list(names))

    sent = docs.select("rid", "doc_id", "line", "bounds").join(roles, "rid").sortWithinPartitions("rid").mapInArrow(send, schema)
    dealt = sent.repartition("rep", "salt").sortWithinPartitions("rep", "salt", "kind")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, theirs, held, partner = None, np.zeros(0, np.uint32), np.zeros(0, np.uint32), None
        for batch in rows_of(batches, 500):
            pairs, named, out = [], [], []
            for key, kind, rid, doc_id, first, data, wanted in zip(*(batch[c].to_pylist() for c in ("rep", "kind", "rid", "doc_id", "first", "data", "stretches"))):
                if kind == 0:
                    rep, partner = key, doc_id
                    line = np.frombuffer(data, np.uint32)
                    theirs, held = spread(line, np.frombuffer(wanted, np.int32).reshape(-1, 2), 0), np.sort(line)
                elif key == rep:
                    own = np.frombuffer(data, np.uint32)
                    stretches = narrowed(np.frombuffer(wanted, np.int32).reshape(-1, 3), likely(own, held, width, similarity), first, width)
                    if stretches:
                        pairs.append((own, first, theirs, stretches))
                        named.append((rid, rep, partner))
            for name, spans in zip(named, settled(pairs, width, similarity)):
                out += [(*name, a, b) for a, b in spans]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else [[]] * 5)], names=["rid", "rep", "partner", "start", "end"])

    return dealt.mapInArrow(compare, "rid long, rep long, partner long, start long, end long")


def found_passages(docs: DataFrame, distinct: DataFrame, hashes: int, width: int, similarity: float) -> DataFrame:
    """(rid, rep, partner, start, end) of all passages of ``distinct``, documents of different texts. The result is stored.

    Only stretches most of whose shingles another document has as well can resemble any (``held_regions``); all that
    follows is about their shingles, which are made once. Windows are stored for as long as it takes. They meet by hash
    function and minimum. The smallest document of a key stands for it; all others join it, so a key that many documents
    share costs a row each, and the join's large partitions can be split. Where one of a key's documents has another text
    there than the smallest, the regions around the key are searched again by their rarest shingles (``rare_windows``),
    and what even those leave open by whole stretches (``exact_repeats``).
    """
    with tidy_shuffles(docs.sparkSession), short_batches(docs.sparkSession):
        lines = store(region_lines(docs, held_regions(distinct, width, similarity)), "held-shingles")
        with sinks.stored(emitted(lines, hashes, width), "llm-compact-windows") as rows:
            met = store(shared(rows), "shared-windows")
        checked = store(verified(lines, store(overlaps(met, 0, width), "candidates"), width, similarity), "passages")
        regions = store(unsettled(met, checked, 0, width), "regions")
        again = store(shared(rare_windows(lines, regions, width, similarity)), "rare-windows")
        new = outside(overlaps(again, FEW, width).withColumn("start", F.col("low")).withColumn("end", F.col("high") + SHINGLE), checked)
        checked = checked.union(store(verified(lines, store(new.drop("start", "end"), "rare-candidates"), width, similarity), "rare-passages"))
        left = store(unsettled(again, checked, FEW, width), "rare-regions")
        checked = checked.union(store(exact_repeats(lines, left, checked, width), "exact-passages"))
        return elected(lines, again, checked, width, similarity)


def elected(lines: DataFrame, met: DataFrame, checked: DataFrame, width: int, similarity: float) -> DataFrame:
    """``checked`` and the passages of documents that share a rare shingle, but no passage with those that stand for it.

    They elect the smallest of their own, ``ROUNDS`` times over; those that are still left are compared with each other,
    all pairs. So no two documents of a key stay uncompared unless both share a passage there with the same one.
    """
    for turn in range(ROUNDS):
        rows = store(still_open(met, checked, FEW).select(*_NAMES), "open-windows")
        keys = rows.groupBy("key").agg(F.min("rid").alias("least"), F.max("rid").alias("most"), F.count(F.lit(1)).alias("n")).filter("least <> most").drop("most")
        met = store(rows.join(keys, "key"), "open-keys")
        if met.isEmpty():
            break
        found = store(overlaps(met, FEW if turn + 1 < ROUNDS else EVERY, width), "open-candidates")
        checked = checked.union(store(verified(lines, found, width, similarity), "open-passages"))
    return checked


def outside(found: DataFrame, checked: DataFrame) -> DataFrame:
    """Rows whose start..end is not within passages of the document that are known already."""
    done = checked.groupBy("rid").agg(joined_spans(F.collect_set(F.struct("start", "end"))).alias("done"))
    new = F.col("done").isNull() | ~F.exists("done", lambda d: (d["start"] <= F.col("start")) & (d["end"] >= F.col("end")))
    return found.join(done, "rid", "left").filter(new).drop("done")


def still_open(met: DataFrame, checked: DataFrame, few: int) -> DataFrame:
    """Windows of keys of three documents and over ``few`` whose document shares no passage there with the smallest."""
    several = met.filter((F.col("n") > 2) & (F.col("n") > few))
    passed = checked.select(F.col("rid").alias("of"), F.col("rep").alias("with"), "start", "end")
    at = (F.col("rid") == F.col("of")) & (F.col("least") == F.col("with")) & F.col("place").between(F.col("start"), F.col("end") - SHINGLE)
    return several.filter("rid <> least").join(passed, at, "left_anti")


def unsettled(met: DataFrame, checked: DataFrame, few: int, width: int) -> DataFrame:
    """(rid, regions): where a document has a key of three documents and over ``few`` of which one shares no passage
    there with the smallest. Others of the key may share one that the smallest has not.
    """
    several = met.filter((F.col("n") > 2) & (F.col("n") > few))
    keys = still_open(met, checked, few).select("key").distinct()
    span = F.struct((F.col("place") - F.least("before", F.lit(width - 1))).alias("low"), (F.col("place") + F.least("after", F.lit(width - 1))).alias("high"))
    return several.join(keys, "key").groupBy("rid").agg(F.collect_set(span).alias("regions"))


def covering(low: np.ndarray, high: np.ndarray, width: int, size: int) -> np.ndarray:
    """Which of ``size`` places stand in regions of ``width`` places and more."""
    wide = high - low + 1 >= width
    low, high = np.minimum(low[wide], size), np.minimum(high[wide] + 1, size)
    return np.cumsum(np.bincount(low, minlength=size + 1) - np.bincount(high, minlength=size + 1))[:size] > 0


def runs_of(places: np.ndarray) -> np.ndarray:
    """(low, high) of each run of consecutive places."""
    last = np.flatnonzero(np.diff(places, append=-9) != 1)
    first = np.concatenate((np.zeros(min(len(last), 1), np.int64), last[:-1] + 1))
    return np.stack((places[first], places[last]), axis=1).astype(np.int32)


def region_lines(docs: DataFrame, regions: DataFrame) -> DataFrame:
    """(rid, doc_id, line, bounds): the shingles of a document's regions, and the (low, high) of where they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 200):
            lines, bounds = [], []
            low, high, at = spans_in(batch)
            for own, a, b in zip(shingle_lines(batch["text"].to_pylist()), at, at[1:]):
                places = np.flatnonzero(covering(low[a:b], high[a:b], 1, len(own)))
                lines.append(own[places].tobytes())
                bounds.append(runs_of(places).tobytes())
            yield pa.RecordBatch.from_arrays([batch["rid"], batch["doc_id"], pa.array(lines, pa.binary()), pa.array(bounds, pa.binary())], names=["rid", "doc_id", "line", "bounds"])

    one = docs.select("rid", F.col("doc_id").cast("long").alias("doc_id"), "text").join(regions, "rid")
    return one.mapInArrow(run, "rid long, doc_id long, line binary, bounds binary")


def stored_lines(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """(values, bounds) of each row of ``region_lines``."""
    return [(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(b.as_py(), np.int32).reshape(-1, 2)) for x, b in zip(batch["line"], batch["bounds"])]


def places_of(bounds: np.ndarray) -> np.ndarray:
    """All places of the runs."""
    sizes = bounds[:, 1].astype(np.int64) - bounds[:, 0] + 1
    return np.repeat(bounds[:, 0] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def spread(line: np.ndarray, bounds: np.ndarray, fill: int) -> np.ndarray:
    """32-bit values at their places. Shingles are odd; between them stand even values, all different, by ``fill`` also from another text's."""
    out = np.arange(bounds[-1, 1] + 1 if len(bounds) else 0, dtype=np.uint32) * np.uint32(4) + np.uint32(fill)
    out[places_of(bounds)] = line
    return out


def spans_in(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high) of the regions of all rows, and where those of each row begin."""
    spans = batch["regions"].values
    return spans.field("low").to_numpy(), spans.field("high").to_numpy(), batch["regions"].offsets.to_numpy()


def within(line: np.ndarray, bounds: np.ndarray, low: np.ndarray, high: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, bounds) of what stands in regions of ``width`` and more."""
    at = places_of(bounds)
    some = covering(low, high, width, int(bounds[-1, 1]) + 1 if len(bounds) else 0)[at]
    return line[some], runs_of(at[some])


def separated(line: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, places) with a 0 and a place of -1 behind each run."""
    ends = np.cumsum(bounds[:, 1] - bounds[:, 0] + 1)
    return np.insert(line, ends, 0), np.insert(places_of(bounds), ends, -1).astype(np.int32)


_DEALT = "batch long, part int, data binary, counts binary, rids binary, sizes binary, index binary, line binary, places binary"


def dealt_values(batch: int, values: np.ndarray, doc: np.ndarray, **body: np.ndarray) -> pa.RecordBatch:
    """Rows of ``_DEALT``: the distinct values of a batch of documents, sorted, by their leading bits, with the number of documents.

    ``values`` go by document. Part -1 is the ``body`` with the index of the distinct value of each value.
    """
    order = np.argsort(values, kind="stable")
    v, d = values[order], doc[order]
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    number = np.cumsum(new) - 1
    index = np.zeros(len(v), np.uint32)
    index[order] = number
    new_doc = new.copy()
    new_doc[1:] |= d[1:] != d[:-1]
    unique, counts = v[new], np.bincount(number[new_doc]).astype(np.uint16)
    cuts = np.searchsorted(unique >> np.uint64(64 - PART_BITS), np.arange((1 << PART_BITS) + 1).astype(np.uint64))
    rest = (unique >> np.uint64(32 - PART_BITS)).astype(np.uint32)
    parts = np.flatnonzero(np.diff(cuts))
    body["index"] = index
    names = [c.split()[0] for c in _DEALT.split(", ")]
    columns = [
        pa.array(np.full(len(parts) + 1, batch)), pa.array(np.concatenate(([-1], parts)).astype(np.int32)),
        *(pa.array([None, *(x[cuts[p] : cuts[p + 1]].tobytes() for p in parts)], pa.binary()) for x in (rest, counts)),
        *(pa.array([body[c].tobytes() if c in body else None, *[None] * len(parts)], pa.binary()) for c in names[4:]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=names)


def ranks_of(blobs: list[tuple[bytes, bytes]]) -> list[bytes]:
    """For each value of each blob the power of two of the documents that have it in any blob; 0 is for one alone."""
    values, counts = np.frombuffer(b"".join(x for x, _ in blobs), np.uint32), np.frombuffer(b"".join(x for _, x in blobs), np.uint16)
    key = np.sort((values.astype(np.uint64) << np.uint64(32)) | np.arange(len(values), dtype=np.uint64))
    order, value = (key & np.uint64(0xFFFFFFFF)).astype(np.int64), key >> np.uint64(32)
    first = np.flatnonzero(np.concatenate((np.ones(min(len(value), 1), bool), value[1:] != value[:-1])))
    held = np.add.reduceat(counts[order].astype(np.int64), first)
    ranks = np.zeros(len(values), np.uint8)
    ranks[order] = np.repeat(np.frexp(held.astype(np.float64))[1] - 1, np.diff(first, append=len(values)))
    return [x.tobytes() for x in np.split(ranks, np.cumsum([len(x) // 4 for x, _ in blobs])[:-1])]


def by_rank(dealt: DataFrame, use: Callable[[dict[str, bytes], np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``use`` makes of the body of each batch and the ranks of its values: how many documents of all batches have them.

    ``dealt`` has rows of ``dealt_values``. Values move as blobs of 32 bits each, as many rows as there are batches and
    parts; those of a part are counted together. Different values that agree in all bits that count have a rank too high.
    """

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, names, blobs = -1, [], []

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([part] * len(names), pa.int32()), pa.array(ranks_of(blobs), pa.binary())], names=["batch", "part", "data"])

        for batch in batches:
            for no, p, data, counts in zip(*(batch[c].to_pylist() for c in ("batch", "part", "data", "counts"))):
                if p != part and blobs:
                    yield told()
                    names, blobs = [], []
                part = p
                names.append(no)
                blobs.append((data, counts))
        if blobs:
            yield told()

    body = ("rids", "sizes", "index", "line", "places")
    blobs = dealt.filter("part >= 0").select("batch", "part", "data", "counts").repartition("part").sortWithinPartitions("part")
    ranked = blobs.mapInArrow(rank, "batch long, part int, data binary")
    both = dealt.filter("part < 0").select("batch", "part", "data", *body).unionByName(ranked, allowMissingColumns=True)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, bytes] = {}
        ranks: list[bytes] = []

        def used() -> Iterator[pa.RecordBatch]:
            return use(held, np.frombuffer(b"".join(ranks), np.uint8)[np.frombuffer(held["index"], np.uint32)])

        for batch in batches:
            for i, (part, data) in enumerate(zip(batch["part"].to_pylist(), batch["data"])):
                if part >= 0:
                    ranks.append(data.as_py())
                    continue
                if held:
                    yield from used()
                held, ranks = {c: batch[c][i].as_py() for c in body}, []
        if held:
            yield from used()

    return both.repartition("batch").sortWithinPartitions("batch", "part").mapInArrow(finish, schema)


def numbered() -> Iterator[int]:
    """Numbers that no other task of the stage counts."""
    return count(TaskContext.get().partitionId() << 32)


def held_regions(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """(rid, regions): the (low, high) of stretches that may resemble another document's. The others cannot.

    Of ``width`` shingles, at most a share of 1 - ``similarity`` of the distinct ones may be in no other document. Half of
    the shingles, by a bit of their hash, are looked up: stretches in which more of those alone are missing are left out.
    """
    most = int((1 - similarity) * width + 1e-9)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = numbered()
        for batch in chunks_of(batches, "text"):
            lines = shingle_lines(batch["text"].to_pylist())
            rid = batch["rid"].to_numpy()
            some = np.flatnonzero([len(x) >= width for x in lines])
            if not len(some):
                continue
            lines = [lines[i] for i in some]
            sizes = np.array([len(x) for x in lines], np.int64)
            line = np.concatenate(lines)
            taken = line & np.uint64(2) != 0
            doc = np.repeat(np.arange(len(lines)), sizes)[taken]
            yield dealt_values(next(number), line[taken], doc, rids=rid[some], sizes=sizes, places=np.packbits(taken))

    def regions(body: dict[str, bytes], ranks: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes, rid = np.frombuffer(body["sizes"], np.int64), np.frombuffer(body["rids"], np.int64)
        missing = np.flatnonzero(ranks == 0)
        ends = np.cumsum(sizes)
        n = int(ends[-1])
        at = np.flatnonzero(np.unpackbits(np.frombuffer(body["places"], np.uint8), count=n))[missing]
        before = previous(*in_order(np.frombuffer(body["index"], np.uint32)[missing]))  # in the same document, as no other has the value
        before[before >= 0] = at[before[before >= 0]]
        absent = np.cumsum(np.bincount(np.maximum(before + 1, at - width + 1).clip(0), minlength=n + 1) - np.bincount(at + 1, minlength=n + 1))[:n]
        good = absent <= most
        for back in range(1, width):  # no stretch runs over the end of its document
            good[ends - back] = False
        starts = np.flatnonzero(good)
        inside = np.flatnonzero(covering(starts, starts + width - 1, width, n))
        doc = np.searchsorted(ends, inside, side="right")
        own = inside - (ends - sizes)[doc]
        last = np.flatnonzero((np.diff(own, append=-9) != 1) | (np.diff(doc, append=-9) != 0))
        first = np.concatenate((np.zeros(min(len(last), 1), np.int64), last[:-1] + 1))
        docs_, offsets = np.unique(doc[first], return_index=True)
        spans = pa.StructArray.from_arrays([pa.array(own[x].astype(np.int32)) for x in (first, last)], names=["low", "high"])
        yield pa.RecordBatch.from_arrays([pa.array(rid[docs_]), pa.ListArray.from_arrays(pa.array(np.append(offsets, len(first)).astype(np.int32)), spans)], names=["rid", "regions"])

    with sinks.stored(docs.select("rid", "text").filter(F.octet_length("text") >= 2 * (width + SHINGLE) - 3).mapInArrow(deal, _DEALT), "llm-values") as dealt:
        return store(by_rank(dealt, regions, "rid long, regions array<struct<low:int,high:int>>"), "held-regions")


def rare_windows(lines: DataFrame, regions: DataFrame, width: int, similarity: float) -> DataFrame:
    """Compact windows of the regions by rarity: what fewer documents hold comes first, ties go by the min-hash.

    Text that many documents share, such as a notice, thus is no minimum of a stretch with anything rarer in it. Shingles
    of one document alone bring nothing together and come last. Documents are counted over all regions; rarity goes by
    powers of two. Two hash functions, so that shingles of other places that happen to be as rare hide no passage.
    A stretch with too few shingles that any other document has in its regions resembles none and makes no window.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = numbered()
        for batch in chunks_of(batches, "line"):
            low, high, at = spans_in(batch)
            starts, line, spots = laid(*zip(*(separated(*within(*x, low[a:b], high[a:b], width)) for x, a, b in zip(stored_lines(batch), at, at[1:]))))
            some = np.flatnonzero(line)
            doc = np.searchsorted(starts, some, side="right") - 1
            yield dealt_values(next(number), line[some], doc, rids=batch["rid"].to_numpy(), sizes=starts, line=line, places=spots)

    def run(body: dict[str, bytes], ranks: np.ndarray) -> Iterator[pa.RecordBatch]:
        last = np.iinfo(np.uint64).max
        line, starts, rid = np.frombuffer(body["line"], np.uint64), np.frombuffer(body["sizes"], np.int64), np.frombuffer(body["rids"], np.int64)
        spots, tier, alike = np.frombuffer(body["places"], np.int32), np.zeros(len(line), np.uint64), np.zeros(len(line), bool)
        tier[line != 0] = ranks
        for a, b in zip(starts, starts[1:] - 1):
            begun = mostly(line[a:b], tier[a:b] > 0, width, similarity)
            open_ = np.bincount(begun, minlength=b - a + 1) - np.bincount(begun + width, minlength=b - a + 1)
            alike[a:b] = np.cumsum(open_[: b - a]) > 0
        for h in range(2):
            order = (tier << np.uint64(56)) | (mixed(line, 300 + h) >> np.uint64(8))
            order = np.where((line == 0) | ~alike, np.uint64(0), np.where(tier == 0, last, order))
            key, doc, further, place, before, after = windows_of(line, order, starts, width, 400 + h)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, rid[doc], further, spots[place], before, after)], names=_NAMES)

    with sinks.stored(lines.join(regions, "rid").mapInArrow(deal, _DEALT), "llm-region-values") as dealt:
        return store(by_rank(dealt, run, _ROWS), "region-windows")


def exact_repeats(lines: DataFrame, regions: DataFrame, checked: DataFrame, width: int) -> DataFrame:
    """(rid, rep, partner, start, end): stretches of the regions that another document repeats word for word.

    They meet by a hash of the whole stretch, so whatever document stands for it has it, and nothing needs a second
    election. Those within passages found already are left out.
    """

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 100):
            keys, sizes, places = [], [], []
            low, high, offsets = spans_in(batch)
            for (own, bounds), a, b in zip(stored_lines(batch), offsets, offsets[1:]):
                spots, n = places_of(bounds), max(0, len(own) - width + 1)
                wanted = covering(low[a:b], high[a:b] - width + 1, 1, int(spots[-1]) + 1 if len(spots) else 0)[spots]
                begun = np.flatnonzero(wanted[:n] & (spots[width - 1 :] - spots[:n] == width - 1))  # those within one run
                value = np.zeros(len(begun), np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(width):
                        value = value * np.uint64(0x9E3779B97F4A7C15) + own[begun + k]
                keys.append(mixed(value, 9).view(np.int64))
                places.append(spots[begun].astype(np.int32))
                sizes.append(len(begun))
            rid = np.repeat(batch["rid"].to_numpy(), sizes)
            doc_id = batch["doc_id"].take(pa.array(np.repeat(np.arange(batch.num_rows), sizes)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(rid), doc_id, pa.array(np.concatenate(places))], names=["key", "rid", "doc_id", "at"])

    with sinks.stored(lines.join(regions, "rid").mapInArrow(stretches, "key long, rid long, doc_id long, at int"), "llm-stretches") as rows:
        reps = rows.groupBy("key").agg(F.min(F.struct("rid", "doc_id")).alias("rep"), F.max("rid").alias("most")).filter("rep.rid <> most").drop("most")
        met = rows.join(reps, "key").filter("rid <> rep.rid").groupBy("rid", "rep").agg(F.array_sort(F.collect_set("at")).alias("ats"))
        met = store(met.select("rid", F.col("rep.rid").alias("rep"), F.col("rep.doc_id").alias("partner"), "ats"), "met")
    runs = met.select("rid", "rep", "partner", F.explode(joined_spans(F.transform("ats", lambda a: F.struct(a.cast("long").alias("start"), (a + width + SHINGLE - 1).cast("long").alias("end"))))).alias("s")).select("rid", "rep", "partner", "s.start", "s.end")
    return outside(runs, checked)


def repeats(docs: DataFrame, passage: int = PASSAGE, similarity: float = SIMILARITY, hashes: int = HASHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, rid, n_words, spans, partners: passages that another document has as well.

    A passage has ``passage`` words or more, every ``passage`` of them at least ``similarity`` alike (Jaccard, shingles
    of five words) to the partner's. One document of each class of repeats has no span for it: that with the smallest
    row hash; the others name it, so links run from members to a representative and no pair within a class is lost to
    the reader. ``partners`` are ids, sorted; spans are in words, half-open, merged, and begin and end with
    words that both have.

    Equal texts are one document for the search: the one with the smallest row hash stands for them, and the others are
    one passage of it from end to end. Texts of fewer words, null and empty ones have no spans. Rows alike in id and text
    are one document and get the same result. No rows give no rows.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("rid", row_id())
    named = named.withColumn("alike", F.xxhash64(F.coalesce("text", F.lit(""))))
    width = passage - SHINGLE + 1
    classes = named.groupBy("alike").agg(F.min(F.struct("rid", "doc_id")).alias("kept"), F.max("rid").alias("most")).filter("kept.rid <> most")
    classes = store(classes.select("alike", F.col("kept.rid").alias("kept"), F.col("kept.doc_id").alias("kept_id")), "equal-texts")
    copy = F.coalesce(F.col("kept") != F.col("rid"), F.lit(False))
    checked = found_passages(named, named.join(classes, "alike", "left").filter(~copy), hashes, width, similarity)
    spans = store(checked.groupBy("rid").agg(F.collect_set(F.struct("start", "end")).alias("found"), F.collect_set("partner").alias("partners")), "spans")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 1000):
            n = [word_count(t.as_py()) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["rid"], batch["alike"], pa.array(n, pa.int64())], names=["doc_id", "rid", "alike", "n_words"])

    schema = named.select("doc_id", "rid", "alike", F.lit(0).cast("long").alias("n_words")).schema
    counted = named.mapInArrow(words, schema).join(classes, "alike", "left").join(spans, "rid", "left")
    long = copy & (F.col("n_words") >= passage)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    return counted.select(
        "doc_id", "rid", "n_words",
        F.when(long, whole).otherwise(joined_spans(F.col("found"))).alias("spans"),
        F.when(long, F.array(F.col("kept_id").cast("long"))).otherwise(F.array_sort(F.coalesce("partners", F.array().cast("array<long>")))).alias("partners"),
    )


def joined_spans(found: Column) -> Column:
    """Sorted spans, overlapping and touching ones made one."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        longer = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (x["start"] <= last["end"]), longer).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(F.coalesce(found, empty)), empty, add)


def covered(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    data = text.encode("utf-8", "surrogatepass")
    wanted = iter(sorted({p for span in spans for p in (span[0], span[1] - 1)}))
    at, places = next(wanted, None), {}
    for i, word in enumerate(_WORD.finditer(data)):
        if i == at:
            places[i] = word.span()
            at = next(wanted, None)
            if at is None:
                break
    out, done = [], 0
    for start, end in spans:
        out.append(data[done : places[start][0]])
        done = places[end - 1][1]
    return b"".join([*out, data[done:]]).decode("utf-8", "surrogatepass")
