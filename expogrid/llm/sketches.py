"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, subtracted and peeled."""

from __future__ import annotations

import base64
import bisect
import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from expogrid.llm.common import keyed, rows_of

#: A paragraph ends with a line or sentence, and after a word that ends in one of a few bytes, so that texts of a
#: single line have several and an edit changes only those it touches.
PARAGRAPH = re.compile(rb".+?(?:[.!?\n]+\s*|[dt\x84\x94\xa4\xb4] |\Z)", re.S)
CELLS, GROWTH, HASHES = 24, 4, 3
SMALLEST = -(1 << 63)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
        return x ^ (x >> np.uint64(31))


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(digest, text) of every paragraph of every text; a repeated paragraph is told apart by which repeat it is."""
    found, sizes = [], []
    for text in texts:
        own = [xxhash.xxh3_64_intdigest(p) for p in PARAGRAPH.findall(text.encode("utf-8", "surrogatepass"))]
        found += own
        sizes.append(len(own))
    digest, owner = np.array(found, np.uint64), np.repeat(np.arange(len(texts)), sizes)
    order = np.lexsort((digest, owner))
    d, o = digest[order], owner[order]
    fresh = np.concatenate(([True], (d[1:] != d[:-1]) | (o[1:] != o[:-1]))) if len(d) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(d)), 0))
    repeat = (np.arange(len(d)) - first).astype(np.uint64)
    with np.errstate(over="ignore"):
        return mixed(d + repeat * np.uint64(0xD6E8FEB86659FD93), 0), o


@dataclass
class Sketches:
    """Sketches of one size for several sets, flat: count, xor of digests and xor of their checks in each cell."""

    cells: int
    count: np.ndarray
    digest: np.ndarray
    check: np.ndarray

    @staticmethod
    def places(digest: np.ndarray, cells: int, h: int) -> np.ndarray:
        """One cell of a digest in the h-th part of a sketch."""
        part = cells // HASHES
        return (mixed(digest, cells * HASHES + h + 1) % np.uint64(part)).astype(np.int64) + h * part

    @classmethod
    def of(cls, digest: np.ndarray, owner: np.ndarray, n: int, cells: int) -> Sketches:
        made = cls(cells, np.zeros(n * cells, np.int64), np.zeros(n * cells, np.uint64), np.zeros(n * cells, np.uint64))
        made.toggle(digest, owner, np.ones(len(digest), np.int64))
        return made

    def toggle(self, digest: np.ndarray, owner: np.ndarray, sign: np.ndarray) -> None:
        check = mixed(digest, -1)
        for h in range(HASHES):
            at = owner * self.cells + self.places(digest, self.cells, h)
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.digest, at, digest)
            np.bitwise_xor.at(self.check, at, check)

    def minus(self, a: np.ndarray, b: np.ndarray) -> Sketches:
        """Sketches of pairs: those of sets ``a`` less those of sets ``b``."""
        cut = lambda x: x.reshape(-1, self.cells)
        return Sketches(
            self.cells, (cut(self.count)[a] - cut(self.count)[b]).ravel(), (cut(self.digest)[a] ^ cut(self.digest)[b]).ravel(), (cut(self.check)[a] ^ cut(self.check)[b]).ravel()
        )

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(digest, set, sign) of what differs, found from cells that hold one digest; and which sets came out empty."""
        part, out = self.cells // HASHES, ([], [], [])
        rows = len(self.count) // self.cells
        active = np.arange(rows)
        while len(active):
            moved = []
            for h in range(HASHES):  # within one part a digest has one cell, so none is found twice
                at = (active[:, None] * self.cells + np.arange(h * part, (h + 1) * part)).ravel()
                at = at[np.abs(self.count[at]) == 1]
                at = at[mixed(self.digest[at], -1) == self.check[at]]
                if len(at):
                    digest, sign, owner = self.digest[at], self.count[at], at // self.cells
                    self.toggle(digest, owner, -sign)
                    for x, y in zip(out, (digest, owner, sign)):
                        x.append(y)
                    moved.append(owner)
            active = np.unique(np.concatenate(moved)) if moved else active[:0]
        empty = ~((self.count != 0) | (self.digest != 0)).reshape(rows, self.cells).any(axis=1)
        return *(np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, (np.uint64, np.int64, np.int64))), empty


class Batch:
    """Paragraph sets of some texts, compared by their sketches."""

    def __init__(self, texts: list[str]):
        self.n = len(texts)
        self.digest, self.owner = digests(texts)
        self.sizes = np.bincount(self.owner, minlength=self.n)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))

    def sketches(self, cells: int, of: np.ndarray | None = None) -> Sketches:
        if of is None:
            return Sketches.of(self.digest, self.owner, self.n, cells)
        sizes = self.sizes[of]
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.starts[of], sizes)
        return Sketches.of(self.digest[at], np.repeat(np.arange(len(of)), sizes), len(of), cells)

    def fingerprints(self) -> list[str]:
        """Number of paragraphs and the cells of the smallest sketch."""
        made = self.sketches(CELLS)
        cut = lambda x, t: x.reshape(-1, CELLS).astype(t)
        parts = zip(self.sizes.tolist(), cut(made.count, np.int32), cut(made.digest, np.uint64), cut(made.check, np.uint32))
        return [f"{n:x}." + base64.b64encode(c.tobytes() + d.tobytes() + k.tobytes()).decode() for n, c, d, k in parts]

    def likeness(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Share of paragraphs that two texts have in common, 1 if both have none.

        The sketches of a pair are subtracted and peeled; where that fails, both are made anew with more cells.
        """
        differing = np.zeros(len(a), np.int64)
        open_, cells = np.arange(len(a)), CELLS
        while len(open_):
            failed = []
            step = max(1, (1 << 21) // cells)
            for start in range(0, len(open_), step):
                some = open_[start : start + step]
                sets, places = np.unique(np.concatenate((a[some], b[some])), return_inverse=True)
                _, owner, _, empty = self.sketches(cells, sets).minus(places[: len(some)], places[len(some) :]).peel()
                differing[some] = np.bincount(owner, minlength=len(some))
                failed.append(some[~empty])
            open_, cells = np.concatenate(failed), cells * GROWTH
        together = self.sizes[a] + self.sizes[b]
        return np.where(together > 0, (together - differing) / np.maximum(together + differing, 1), 1.0)


def edited(text: str, following: str) -> str:
    """The last third of a text replaced by the beginning of the next."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(ids: list[int | None], texts: list[str]) -> pa.RecordBatch:
    """Results of all documents but the last, each with the one behind it as its next."""
    n = len(ids)
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    batch = Batch(texts + changed)
    prints = batch.fingerprints()
    at = np.arange(n)
    columns = [
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()), pa.array([hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed], pa.string()),
        pa.array(prints[:n], pa.string()), pa.array(prints[n + 1 :], pa.string()), pa.array(batch.likeness(at, at + n + 1)), pa.array(batch.likeness(at, at + 1)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in RESULT.split(", ")])


def versions(docs: DataFrame, part_bytes: int = 24 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each document and of its edit, whose end comes from the next document by descending id.

    Texts are dealt once, by ranges of ids with about ``part_bytes`` each, compressed. The first document of a range
    goes to the range before as well, and the first of all to the last range, so every task has the next document of
    each of its own at hand and reads its range in order, a few at a time.

    A null text counts as empty, a null id as the smallest. Equal ids are ordered by a hash of their texts; for rows
    alike the next one is a copy, but for the last. A single document is its own next one. No rows give no rows.
    """
    named = keyed(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(SMALLEST))
    size, first = named.agg(F.sum(F.octet_length("text")), F.max(key)).first()
    if first is None:
        return docs.sparkSession.createDataFrame([], RESULT)
    n = max(1, math.ceil((size or 0) / part_bytes))
    cuts = named.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 100 * n)).first()[0] if n > 1 else []
    cuts = sorted(set(cuts) - {first})  # ids, each the first by descending order of its range
    last = len(cuts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in rows_of(batches, 1000):
            out: list[tuple] = []
            for i, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                k = SMALLEST if i is None else i
                row = (k, i, xxhash.xxh3_64_intdigest(data) >> 1, pack(data))
                part = last - bisect.bisect_left(cuts, k)
                out.append((part, False, *row))
                if part < last + 1 and k == first:
                    out.append((last, True, *row))
                elif part and k == cuts[last - part]:
                    out.append((part - 1, True, *row))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 6, (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["part", "halo", "k", "doc_id", "h", "data"])

    rows = named.mapInArrow(deal, "part int, halo boolean, k long, doc_id long, h long, data binary")
    rows = rows.repartitionById(last + 1, F.col("part")).sortWithinPartitions("part", "halo", F.desc("k"), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        ids: list[int | None] = []
        texts: list[str] = []
        part, size, over = None, 0, False
        for batch in rows_of(batches, 1000):
            for p, halo, i, data in zip(batch["part"].to_pylist(), batch["halo"].to_pylist(), batch["doc_id"].to_pylist(), batch["data"]):
                if p != part:
                    part, over = p, False
                if over:
                    continue  # one document behind the range is enough
                text = unpack(data.as_py()).decode("utf-8", "surrogatepass")
                texts.append(text)
                size += len(text)
                if halo:
                    over = True
                if halo or (size > 1 << 20 and len(texts) > 1):
                    yield compared(ids, texts)
                    ids, texts, size = ([], [], 0) if halo else ([i], [text], len(text))
                else:
                    ids.append(i)

    return rows.mapInArrow(run, RESULT)
