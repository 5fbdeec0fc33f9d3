"""MinHash near-duplicates: fast similarity sketches in bands, links confirmed on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from expogrid.llm.common import blank_words, blocks_of, rows_of, store, tidy_shuffles
from expogrid.llm.simhash import components, fingerprint
from expogrid.llm.sketches import mixed
from expogrid.llm.windows import WordHashes
from expogrid.sources import sinks

SHINGLE, PERCENT = 5, 85
#: 40 bands of 7 of 280 coordinates: two sets at a similarity of 0.85 meet in none of them with probability 2e-7.
BANDS, ROWS = 40, 7
#: Coordinates that must agree before texts are compared, as standard deviations below the mean at the similarity asked.
SLACK = 7.0
#: Rounds in which each class is compared with one other, before what is left is compared in tiles.
ROUNDS = 3
#: Rows of one side of a tile, and texts compared with one other in one part.
TILE, PART = 1024, 512
#: Shingles of one side of a tile.
TILE_SHINGLES = 1 << 22
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_set(text: str | None, known: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit values of the runs of ``size`` words of a whole text; of all its words if it has fewer."""
    parts = [np.fromiter(map(known.__getitem__, words), np.uint64, len(words)) for words in blocks_of(text, blank_words)]
    words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if not len(words):
        return words
    width = min(size, len(words))
    value = np.full(len(words) - width + 1, width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            value = value * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(value)]
    return np.unique(mixed(value, 11))


def fast_sketches(values: np.ndarray, owner: np.ndarray, sets: int, t: int) -> np.ndarray:
    """Fast similarity sketches of several sets: ``values`` and the set each belongs to; one row of ``t`` coordinates a set.

    In each of the first t rounds every value of a set is thrown into a hashed bin, and a bin keeps the least of what
    fell into it in the first round that reached it. A set leaves as soon as its bins are full, which takes about
    t log t throws whatever its size. Round t + i puts all values into bin i, so 2 t rounds fill every bin. Two sets
    agree in a coordinate with a probability of their Jaccard similarity, and the number of coordinates agreed in is
    concentrated as if these were independent. An empty set has ``NONE`` everywhere.
    """
    table = np.full(sets * t, NONE, np.uint64)
    low = np.uint64((1 << 48) - 1)
    for i in range(2 * t):
        if not len(values):
            break
        floor = np.uint64(i << 48)
        for start in range(0, len(values), 1 << 20):
            v, o = values[start : start + (1 << 20)], owner[start : start + (1 << 20)]
            h = mixed(v, 1000 + i)
            at = o * t + (((h >> np.uint64(40)) * np.uint64(t)) >> np.uint64(24)).astype(np.int64) if i < t else o * t + (i - t)
            value = floor | (mixed(h, 3) & low)
            new = table[at] >= floor
            np.minimum.at(table, at[new], value[new])
        if i % 8 == 7 or i < 8:
            open_ = (table.reshape(sets, t) == NONE).any(axis=1)[owner]
            values, owner = values[open_], owner[open_]
    return table.reshape(sets, t)


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each set and band."""
    parts = sketches[:, : bands * rows].reshape(len(sketches), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for k in range(rows):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k], 17)
    return key


def least_agreed(percent: int, t: int, slack: float = SLACK) -> int:
    share = percent / 100
    return max(0, int(np.floor(t * share - slack * np.sqrt(t * share * (1 - share)))))


def row_key():
    """128 bits that stand for id and text of a row."""
    text = F.coalesce("text", F.lit(""))
    return F.struct(F.xxhash64("doc_id", text).alias("h"), F.xxhash64(text, "doc_id", F.lit(1)).alias("l"))


def sketched(docs: DataFrame, bands: int, rows: int, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The named columns and (row, digest, n, keys, agree, fp) of every row: 128 bits for the shingle set, its size, its band
    keys, one byte of each coordinate, and the SimHash fingerprint of the set. ``docs``: doc_id, text and what is named.
    """
    t = bands * rows
    named = docs.select(*columns, row_key().alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in rows_of(batches, 1000):
            sets, start, held = [], 0, 0
            for i, text in enumerate(batch["text"]):
                sets.append(shingle_set(text.as_py(), known))
                held += len(sets[-1])
                if held > 1 << 20 or i + 1 == batch.num_rows:
                    sizes = np.array([len(s) for s in sets], np.int64)
                    table = fast_sketches(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), len(sets), t)
                    keys = np.where((sizes > 0)[:, None], band_keys(table, bands, rows), 0).astype(np.uint64)
                    agree = (mixed(table.ravel(), 29) & np.uint64(255)).astype(np.uint8).reshape(table.shape)
                    part = batch.slice(start, len(sets))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands, pa.int32()), pa.array(keys.ravel().view(np.int64)))
                    arrays = [
                        *[part[c] for c in columns], part["row"], pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.array(sizes), lists, pa.array([a.tobytes() for a in agree], pa.binary()),
                        pa.array(np.array([fingerprint(s) for s in sets], np.uint64).view(np.int64)),
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "row", "digest", "n", "keys", "agree", "fp"])
                    sets, start, held = [], i + 1, 0

    empty = F.lit(b"").cast("binary")
    zero = F.lit(0).cast("long")
    schema = named.select(*columns, "row", empty.alias("digest"), zero.alias("n"), F.array().cast("array<long>").alias("keys"), empty.alias("agree"), zero.alias("fp")).schema
    return named.mapInArrow(run, schema)


def packed_texts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(cid, data): the compressed text of the row that stands for each of the classes (cid, row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=1).compress
        for batch in rows_of(batches, 1000):
            data = [tool((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["h"], batch["l"], pa.array(data, pa.binary())], names=["h", "l", "data"])

    packed = docs.select(row_key().alias("row"), "text").select("row.*", "text").mapInArrow(run, "h long, l long, data binary")
    wanted = classes.select("cid", "row.*")
    return packed.join(wanted, ["h", "l"]).groupBy("cid").agg(F.first("data").alias("data"))  # repeated rows are alike


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets have that similarity. ``texts``: cid, data.

    ``b`` is the side that many may share: its text goes to as many parts as its count of partners asks for.
    """
    parts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    asked = pairs.join(parts, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    own = asked.join(texts.withColumnRenamed("cid", "a"), "a").select("b", "part", F.lit(1).alias("kind"), "a", "data")
    held = parts.join(texts.withColumnRenamed("cid", "b"), "b").select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.col("b").alias("a"), "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, unpack = WordHashes(), zstandard.ZstdDecompressor().decompress
        at, theirs = None, None
        for batch in rows_of(batches, 500):
            out: list[tuple] = []
            for b, kind, a, data in zip(*(batch[c].to_pylist() for c in ("b", "kind", "a", "data"))):
                found = shingle_set(unpack(data).decode("utf-8", "surrogatepass"), known)
                if kind == 0:
                    at, theirs = b, found
                elif at == b:
                    shared = len(np.intersect1d(found, theirs, assume_unique=True))
                    if 100 * shared >= percent * (len(found) + len(theirs) - shared):
                        out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else [[]] * 2)], names=["a", "b"])

    return own.union(held).repartition("b", "part").sortWithinPartitions("b", "part", "kind").mapInArrow(run, "a long, b long")


def plausible(pairs: DataFrame, known: DataFrame, percent: int, least: int) -> DataFrame:
    """The pairs (a, b) that sizes and coordinates allow. ``known``: cid, n, agree."""
    one = known.select(F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("agree").alias("agree_a"))
    two = known.select(F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("agree").alias("agree_b"))
    sized = pairs.join(one, "a").join(two, "b").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b", "agree_a", "agree_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 4000):
            one, two = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("agree_a", "agree_b"))
            yield batch.select(["a", "b"]).take(pa.array(np.flatnonzero((one == two).sum(axis=1) >= least)))

    return sized.mapInArrow(run, "a long, b long")


class Tile:
    """Members of one key, compared with each other: texts become sets once, links found join labels at once.

    With ``every``, all links are given and labels stay as they are.
    """

    def __init__(self, rows: pa.Table, bands: int, percent: int, least: int, known: WordHashes, every: bool = False):
        self.every = every
        self.cid, self.n, self.own = (rows[c].to_numpy() for c in ("cid", "n", "own"))
        self.band, self.percent, self.least = rows["band"][0].as_py(), percent, least
        self.sides = rows["i"][0].as_py(), rows["j"][0].as_py()
        self.agree = np.frombuffer(b"".join(rows["agree"].to_pylist()), np.uint8).reshape(len(self.cid), bands, -1)
        _, self.label = np.unique(rows["label"].to_numpy(), return_inverse=True)
        unpack = zstandard.ZstdDecompressor().decompress
        self.sets = [shingle_set(unpack(d).decode("utf-8", "surrogatepass"), known) for d in rows["data"].to_pylist()]

    def links(self) -> Iterator[tuple[int, int]]:
        """Links that connect what all links between members of different labels connect."""
        same = self.sides[0] == self.sides[1]
        left, right = (np.flatnonzero(self.own == side) for side in self.sides)
        for at, x in enumerate(left.tolist()):
            others = right[at + 1 :] if same else right
            others = others[self.label[others] != self.label[x]]
            others = others[100 * np.minimum(self.n[others], self.n[x]) >= self.percent * np.maximum(self.n[others], self.n[x])]
            equal = self.agree[others] == self.agree[x]
            # A pair is compared in the first band it shares, and under a key that is no band (-1) if it shares none.
            bands = equal.all(axis=2)
            first = np.where(bands.any(axis=1), bands.argmax(axis=1), -1)
            others = others[(equal.sum(axis=(1, 2)) >= self.least) & (first == self.band)]
            if not len(others):
                continue
            flat = np.concatenate([self.sets[y] for y in others])
            place = np.minimum(np.searchsorted(self.sets[x], flat), len(self.sets[x]) - 1)
            ends = np.cumsum(self.n[others])
            shared = np.diff(np.concatenate(([0], np.cumsum(self.sets[x][place] == flat)[ends - 1])))
            for y in others[100 * shared >= self.percent * (self.n[others] + self.n[x] - shared)].tolist():
                if self.every:
                    yield int(self.cid[x]), int(self.cid[y])
                elif self.label[x] != self.label[y]:
                    self.label[self.label == self.label[y]] = self.label[x]
                    yield int(self.cid[x]), int(self.cid[y])


def tiled(members: DataFrame, known: DataFrame, texts: DataFrame, bands: int, percent: int, least: int, every: bool = False) -> DataFrame:
    """Links (a, b) between members (key, band, cid, n, label) of one key that connect what all links between different
    labels connect; with ``every``, all links between different labels.

    The members of a key are dealt to groups of about ``TILE``, and each two groups meet in a tile of their own, so no
    task holds a key, and nothing but links that join something leaves a tile.
    """
    groups = members.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int").alias("groups"))
    dealt = members.join(groups, "key").join(known.select("cid", "agree"), "cid").join(texts, "cid").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("groups")).cast("int"))
    to = F.transform(F.sequence(F.lit(0), F.col("groups") - 1), lambda g: F.struct(F.least(g, F.col("own")).alias("i"), F.greatest(g, F.col("own")).alias("j")))
    kept = ("cid", "label", "n", "agree", "own", "data")
    rows = dealt.select("key", "band", *kept, F.explode(to).alias("tile")).select("key", "band", "tile.i", "tile.j", *kept)
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, held, last = WordHashes(), [], None

        def done() -> pa.RecordBatch:
            found = list(Tile(pa.Table.from_batches(held), bands, percent, least, tables, every).links())
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*found) if found else [[]] * 2)], names=["a", "b"])

        for batch in batches:
            at = np.column_stack([batch[c].to_numpy() for c in ("key", "i", "j")])
            starts = np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1 if len(at) else []
            for start, end in zip([0, *starts], [*starts, len(at)]):
                if end > start:
                    if held and last != tuple(at[start]):
                        yield done()
                        held.clear()
                    last = tuple(at[start])
                    held.append(batch.slice(start, end - start))
        if held:
            yield done()

    return rows.mapInArrow(run, "a long, b long")


def near_links(docs: DataFrame, classes: DataFrame, percent: int, bands: int, rows: int, rounds: int) -> DataFrame:
    """(node, root) of the classes that links join. ``classes``: cid, row, n, keys, agree; ``docs``: doc_id, text.

    In a round every class is compared with one other: the first in a hashed order of all it shares a key with. That is
    the same one for most of a large group. Labels are the components of the links found so far, and a key goes when
    all of its members have one label, so a group that is alike costs a few comparisons a member. What still
    differs after the rounds is compared in tiles, so the links found connect all that share a key and are alike.
    """
    known = classes.select("cid", "n", "agree")
    least = least_agreed(percent, bands * rows)
    every = classes.filter("n > 0").select("cid", "n", F.posexplode("keys").alias("band", "key"))
    shared = every.groupBy("key").agg(F.min("cid").alias("first"), F.max("cid").alias("most")).filter("first < most").select("key")
    members = store(every.join(shared, "key").select("key", "band", "cid", "n", F.col("cid").alias("label")), "band-members")
    texts = store(packed_texts(docs, members.select("cid").distinct().join(classes.select("cid", "row"), "cid")), "texts")
    links = []
    for i in range(rounds):
        if members.isEmpty():
            break
        order = F.struct(F.xxhash64("cid", F.lit(i)).alias("at"), "cid", "label")
        firsts = members.groupBy("key").agg(F.min(order).alias("first"))
        met = members.join(firsts, "key").filter("cid <> first.cid AND label <> first.label")
        pairs = met.groupBy(F.col("cid").alias("a")).agg(F.min("first").alias("first")).select("a", F.col("first.cid").alias("b"))
        links.append(store(confirmed(store(plausible(pairs, known, percent, least), "pairs"), texts, percent), "confirmed"))
        labels = components(stacked(links)).withColumnRenamed("node", "cid")
        named = members.select("key", "band", "cid", "n").join(labels, "cid", "left").select("key", "band", "cid", "n", F.coalesce("root", "cid").alias("label"))
        named = store(named, "band-members")
        open_ = named.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least < most").select("key")
        members = store(named.join(open_, "key"), "band-members")
    links.append(store(tiled(members, known, texts, bands, percent, least), "confirmed"))
    return store(components(stacked(links)), "roots")


def stacked(links: list[DataFrame]) -> DataFrame:
    out = links[0]
    for part in links[1:]:
        out = out.union(part)
    return out


def near_duplicates(
    docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 times what their sets of five-word shingles share is at least ``percent`` times what
    they hold together; ``component_id`` is the smallest id that links reach. Equal sets fold to one class first, so
    exact copies cost a row each. Candidates share a band of their sketches; every link is confirmed on the whole sets,
    as 64-bit values of shingles. A pair just at the similarity is missed with probability 2e-7 by the bands and
    2e-9 by the coordinates that must agree.

    A text of fewer than five words has one shingle, all of its words. Null texts and those without words have none,
    are linked with nothing and are their own component. Repeated rows are copies. A null id is the component's only
    if all ids in it are null. Very long texts are read whole, by blocks. No rows give no rows.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    marked = store(sketched(named, bands, rows), "sketches")
    own = F.min(F.struct("doc_id", "row")).alias("own")
    classes = marked.groupBy("digest").agg(own, F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("n", "keys", "agree")])
    # Numbers that are given before a table is written are the same for all that read it.
    classes = store(classes.select("digest", "own.row", "least", "n", "keys", "agree", F.monotonically_increasing_id().alias("cid")), "set-classes")
    roots = near_links(named, classes, percent, bands, rows, rounds)
    of = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("digest", "least", F.coalesce("root", "cid").alias("root"))
    ids = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named_classes = store(of.join(ids, "root").select("digest", "component_id"), "class-roots")
    found = marked.select("doc_id", "digest", "n").join(named_classes, "digest")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
