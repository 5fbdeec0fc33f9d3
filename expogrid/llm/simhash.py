"""SimHash near-duplicates: fingerprints linked within a Hamming radius through BK-trees over shards."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from expogrid.llm.common import blank_words, blocks_of, rows_of, store

BITS = 64
SEED = 42


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words joined by blanks; of the whole sequence if it is shorter."""
    tail: list[bytes] = []
    parts, seen = [], 0
    for words in blocks_of(text, blank_words):
        seen += len(words)
        words = tail + words
        line = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1 if words else np.zeros(0, np.int64)
        starts = ends - np.array([len(w) for w in words], np.int64) if words else ends
        pairs = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
        if len(words) >= size:
            parts.append(np.fromiter((xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in pairs), np.uint64, len(words) - size + 1))
        tail = words[-(size - 1) :] if size > 1 else []
    if not parts and seen:
        parts.append(np.array([xxhash.xxh64_intdigest(b" ".join(tail), SEED)], np.uint64))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[start : start + (1 << 16)])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, size: int = 4, text_col: str = "text", columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The named columns of each document and its fingerprint as a signed long ``fp``. Nothing is shuffled."""
    named = docs.select(F.struct(*columns).alias("row"), F.col(text_col).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 500):
            found = np.array([fingerprint(shingle_hashes(t.as_py(), size)) for t in batch["body"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(found, pa.int64())], names=["row", "fp"])

    return named.mapInArrow(run, named.select("row", F.lit(0).cast("long").alias("fp")).schema).select("row.*", "fp")


class Tree:
    """BK-tree over distinct fingerprints, kept as arrays in the order of a walk: a subtree is a range of places.

    The children of a node are keyed by their Hamming distance to it, so a search from distance d within radius r
    follows only the edges d - r to d + r.
    """

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.order = np.zeros(n, np.int64)  # place in the tree to place in ``values``
        self.end = np.zeros(n, np.int64)  # first place behind the subtree
        edge, parent = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        at, todo = 0, [(np.arange(n), -1, 0)] if n else []
        while todo:
            members, above, key = todo.pop()
            here, at = at, at + 1
            self.order[here], self.end[here], edge[here], parent[here] = members[0], here + len(members), key, above
            rest = members[1:]
            if len(rest):
                distance = np.bitwise_count(values[rest] ^ values[members[0]]).astype(np.int64)
                by = np.argsort(distance, kind="stable")
                keys, starts = np.unique(distance[by], return_index=True)
                todo += [(rest[part], here, int(k)) for k, part in zip(keys, np.split(by, starts[1:]))]
        self.values, self.edge = values[self.order], edge
        self.children = np.argsort(parent, kind="stable")[1:]  # nodes by parent; the root, at -1, is left out
        self.first = np.searchsorted(parent[self.children], np.arange(n + 1))

    def linked(self, queries: np.ndarray, radius: int, group_of_query: np.ndarray, group: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) pairs within the radius, in pieces. A subtree all in the group of the query is not entered."""
        changes = np.concatenate(([0], np.cumsum(group[1:] != group[:-1])))
        uniform = changes[self.end - 1] == changes
        todo = [(np.arange(len(queries)), np.zeros(len(queries), np.int64))]
        while todo:
            q, node = todo.pop()
            if len(q) > most:
                half = len(q) // 2
                todo += [(q[:half], node[:half]), (q[half:], node[half:])]
                continue
            enter = ~(uniform[node] & (group[node] == group_of_query[q]))
            q, node = q[enter], node[enter]
            if not len(q):
                continue
            distance = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
            near = distance <= radius
            if near.any():
                yield q[near], node[near]
            n = self.first[node + 1] - self.first[node]
            at = np.repeat(np.arange(len(q)), n)
            child = self.children[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[node], n)]
            follow = np.abs(self.edge[child] - distance[at]) <= radius
            if follow.any():
                todo.append((q[at[follow]], child[follow]))


class Sets:
    """Disjoint sets over places 0 to n - 1; the smallest place stands for its set."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        pairs = np.unique(np.sort(np.column_stack((self.up[a], self.up[b])), axis=1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        if not len(pairs):
            return
        up = self.up

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return int(x)

        for x, y in pairs.tolist():
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        self.flat()

    def flat(self) -> None:
        while (self.up != (above := self.up[self.up])).any():
            self.up = above


def spanning(trees: np.ndarray, queries: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what pairs within the radius connect, between a shard's values and queries on it."""
    values = np.unique(np.concatenate((trees, queries)))
    if len(values) < 2:
        return []
    tree, sets = Tree(trees), Sets(len(values))
    nodes, asked = np.searchsorted(values, tree.values), np.searchsorted(values, queries)
    step = 64
    for start in range(0, len(queries), step):
        part = slice(start, start + step)
        pairs = list(tree.linked(queries[part], radius, sets.up[asked[part]], sets.up[nodes]))
        for q, node in pairs:
            sets.join(asked[part][q], nodes[node])
        step = min(step * 2, 4096)
    own = np.flatnonzero(sets.up != np.arange(len(values)))
    return list(zip(values[own].tolist(), values[sets.up[own]].tolist()))


def with_near_pairs(fp: np.ndarray, shard: np.ndarray, radius: int, small: int = 64) -> np.ndarray:
    """Which shards to search: all above ``small`` rows, of the others those in which some pair is near.

    Rows lie by shard. Most shards are small and hold nothing near; comparing rows with the next, the one after that
    and so on for all of them together spares making a tree for each.
    """
    sizes = np.bincount(shard)
    wanted = sizes > small
    at = np.flatnonzero(sizes[shard] <= small)
    for step in range(1, small):
        at = at[at + step < len(fp)]
        at = at[shard[at] == shard[at + step]]
        if not len(at):
            break
        wanted[shard[at[np.bitwise_count(fp[at] ^ fp[at + step]) <= radius]]] = True
    return wanted


def shard_keys(radius: int, exact: int = 2) -> list[list[tuple[int, int]]]:
    """Bit blocks (start, width) for each shard family: within the radius some ``exact`` of radius + exact blocks agree."""
    n = radius + exact
    edges = [BITS * i // n for i in range(n + 1)]
    return [[(edges[i], edges[i + 1] - edges[i]) for i in chosen] for chosen in itertools.combinations(range(n), exact)]


def links(values: DataFrame, radius: int = 4, exact: int = 2, shard_rows: int = 1 << 16) -> DataFrame:
    """Links (a, b) among distinct fingerprints ``fp`` that connect exactly what all pairs within ``radius`` connect.

    Two fingerprints within the radius agree in ``exact`` of ``radius + exact`` blocks of bits, so they meet in a shard
    of at least one family. A shard is a BK-tree that all of its members search; only spanning links leave it, never
    all pairs. A shard above ``shard_rows`` is split into trees of about that size, and each tree goes to the tasks
    of all members' searches, so no tree or task grows with the shard.
    """
    families = []
    for i, blocks in enumerate(shard_keys(radius, exact)):
        bits = F.lit(0).cast("long")
        for start, width in blocks:
            bits = F.shiftleft(bits, width).bitwiseOR(F.shiftrightunsigned("fp", start).bitwiseAND(F.lit((1 << width) - 1)))
        families.append(F.struct(F.lit(i).alias("family"), bits.alias("bits")))
    keyed = values.select("fp", F.explode(F.array(*families)).alias("at")).select("fp", "at.family", "at.bits")
    sizes = keyed.groupBy("family", "bits").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = keyed.join(sizes, ["family", "bits"]).withColumn("parts", F.ceil(F.col("n") / shard_rows).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    sent = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(p.alias("part"), (p == own).alias("member")))
    rows = met.select("family", "bits", "fp", F.explode(sent).alias("to")).select("family", "bits", "to.part", "fp", "to.member")
    rows = rows.repartition("family", "bits", "part").sortWithinPartitions("family", "bits", "part", "fp")

    def searched(table: np.ndarray) -> np.ndarray:
        """Spanning links of the whole shards of some rows, those without a near pair left out."""
        shard = np.concatenate(([0], np.cumsum((table[1:, :3] != table[:-1, :3]).any(axis=1))))
        fp = np.ascontiguousarray(table[:, 3]).view(np.uint64)
        starts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
        found = []
        for i in np.flatnonzero(with_near_pairs(fp, shard, radius)):
            part = slice(starts[i], starts[i + 1] if i + 1 < len(starts) else len(table))
            member = table[part, 4] == 1
            found += spanning(fp[part][member], fp[part], radius) if member.any() else []
        return np.array(found, np.uint64).reshape(-1, 2).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            table = np.column_stack([batch["family"].to_numpy(), batch["bits"].to_numpy(), batch["part"].to_numpy(), batch["fp"].to_numpy(), batch["member"].to_numpy(zero_copy_only=False)]).astype(np.int64)
            if not len(table):
                continue
            other = np.flatnonzero((table[:, :3] != table[-1, :3]).any(axis=1))
            cut = other[-1] + 1 if len(other) else 0  # the last shard may go on
            if cut or (held and (last != table[-1, :3]).any()):
                pairs = searched(np.concatenate([*held, table[:cut]]))
                held = []
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
            held.append(table[cut:])
            last = table[-1, :3]
        if held:
            pairs = searched(np.concatenate(held))
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """(node, root) for every node of the links, root the smallest node of its component.

    Alternates large-star and small-star steps, each stored in the shared folder, until the links stop changing. The
    neighbours of a node are never gathered: its smallest one comes from an aggregate, and a join passes it on.
    """
    edges = store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), name)
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = store(small.select("e.a", "e.b").filter("a <> b").distinct(), name)
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now


def near_duplicates(docs: DataFrame, radius: int = 4, size: int = 4, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = 1 << 16) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id: the smallest id that links reach.

    Equal fingerprints fold to one value before any search, so exact copies cost one row, however many there are; all
    links run between distinct values. Texts are read once and only fingerprints are stored. A null or empty text has
    fingerprint zero and links like any other. A null id never is a component's id unless all ids in it are null.
    Repeated rows give repeated results; no rows give no rows.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marked = store(fingerprints(named, size), "fingerprints")
    values = store(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "values")
    roots = components(links(values, radius, shard_rows=shard_rows))
    of = values.join(roots, values.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named_roots = of.join(ids, "root").select("fp", "component_id")
    return marked.join(named_roots, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
