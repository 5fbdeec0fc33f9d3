"""Hard negatives by cover trees over norm-augmented vectors: exact searches for inner products within windows."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from expogrid.llm.common import rows_of, store

POSITIVES, NEGATIVES, LOW, SCALE = 5, 5, 80, 256
#: Rows of a tree, and anchors that search one together.
TREE_ROWS, BLOCK = 8192, 2048
#: Covering radii shrink by this factor a level; nodes of at most so many points are not split further.
BASE, LEAF = 1.3, 48


def whole_numbers(vectors: list, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) for each component as float64, shorter vectors filled with zeros. Products of such numbers are
    exact as long as their sums stay below 2^53; see ``exact``.
    """
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.floor(scale * out)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows of ``a`` with rows of ``b``; kept within 64 bits where they would not fit."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    if width * np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) < 2.0**53:
        return (a @ b.T).astype(np.int64)
    wide = np.array([[int(x) for x in row] for row in a], object).reshape(a.shape) @ np.array([[int(x) for x in row] for row in b], object).reshape(b.shape).T
    return np.clip(wide, -(2**63), 2**63 - 1).astype(np.int64)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All numbers from each start on, ``count`` of them, one range behind the other."""
    return np.arange(count.sum()) + np.repeat(start - (np.cumsum(count) - count), count)


class CoverTree:
    """A cover tree over vectors to which a coordinate is added that gives all of them one norm.

    With norms alike, the inner product with a query falls as the distance to it grows, so balls of the tree bound it.
    The children of a node at level l are separated by more than BASE^(l-1) and cover its points within that radius;
    the first child has the node's own point. Points lie so that a node is a range of rows and its own point comes first;
    the children of a node are a range of nodes. ``radius`` is the largest distance from a node's point to
    its points, at most the covering radius of its level.
    """

    def __init__(self, points: np.ndarray, base: float = BASE, leaf: int = LEAF):
        norms = (points**2).sum(axis=1)
        self.norm = float(np.sqrt(norms.max(initial=0.0)))
        full = np.column_stack((points, np.sqrt(np.maximum(self.norm**2 - norms, 0.0))))
        self.order = np.arange(len(points))
        start, size, radius, level, first, count = [], [], [], [], [], []
        # Nodes by level of the tree: (points, distances to the first of them, level above).
        todo = [(self.order, np.sqrt(((full - full[:1]) ** 2).sum(axis=1)), None)] if len(points) else []
        start += [0] * len(todo)
        while len(radius) < len(todo):
            node = len(radius)
            members, distance, top = todo[node]
            todo[node] = None
            reach = float(distance.max())
            size.append(len(members)), radius.append(reach), first.append(len(todo))
            self.order[start[node] : start[node] + len(members)] = members
            if len(members) <= leaf or reach == 0.0:
                level.append(None), count.append(0)
                continue
            # Levels at which the node would be its own only child are left out.
            fit = int(np.ceil(np.log(reach) / np.log(base)))
            top = fit if top is None else min(top, fit)
            level.append(top)
            parts = list(self._split(full[members], distance, base ** (top - 1)))
            count.append(len(parts))
            at = start[node]
            for places, d in parts:
                start.append(at)
                todo.append((members[places], d, top - 1))
                at += len(places)
        self.start, self.size, self.first, self.count = (np.array(x, np.int64) for x in (start, size, first, count))
        self.radius, self.level, self.points = np.array(radius), level, points[self.order]

    @staticmethod
    def _split(points: np.ndarray, distance: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Groups around separated centres, the first point first: (places, distances to the centre)."""
        nearest, owner = distance.copy(), np.zeros(len(points), np.int64)
        centers = [0]
        squares = (points**2).sum(axis=1)
        while len(far := np.flatnonzero(nearest > radius)):
            new = far[:64]  # candidates of one step; of those too close to each other the first stays
            between = np.sqrt(np.maximum(squares[new][:, None] + squares[new] - 2 * points[new] @ points[new].T, 0.0))
            taken: list[int] = []
            for i in range(len(new)):
                if not taken or between[i, taken].min() > radius:
                    taken.append(i)
            chosen = new[taken]
            d = np.sqrt(np.maximum(squares[:, None] + squares[chosen] - 2 * points @ points[chosen].T, 0.0))
            d[chosen, np.arange(len(chosen))] = 0.0
            best = d.argmin(axis=1)
            closer = d[np.arange(len(points)), best] < nearest
            closer[chosen] = True
            nearest[closer], owner[closer] = d[closer, best[closer]], len(centers) + best[closer]
            centers += chosen.tolist()
        for i, c in enumerate(centers):
            members = np.flatnonzero(owner == i)
            members = np.concatenate(([c], members[members != c]))
            yield members, nearest[members]

    def bounds(self, query: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product of the query with any point of each node."""
        # The query's own added coordinate is 0. With c a node's point, |q - x| lies within |q - c| -+ radius, and
        # q.x = (|q|^2 + M^2 - |q - x|^2) / 2.
        square = float(query @ query) + self.norm**2
        d = np.sqrt(np.maximum(square - 2 * (self.points[self.start[nodes]] @ query), 0.0))
        slack = 1e-9 * (square + 1.0)
        far, close = d + self.radius[nodes], np.maximum(d - self.radius[nodes], 0.0)
        return (square - far**2) / 2 - slack, (square - close**2) / 2 + slack

    def search(self, query: np.ndarray, best: Best) -> None:
        """Best-first descent. Nodes that lie outside of all windows as a whole are skipped; leaves are verified.

        Nodes wait by their largest product; the best ones are opened together, more of them the longer it lasts.
        """
        nodes, step = np.zeros(min(1, len(self.start)), np.int64), 64
        low, high = self.bounds(query, nodes)
        while len(nodes):
            keep = best.useful(low, high)
            nodes, low, high = nodes[keep], low[keep], high[keep]
            order = np.argsort(-high, kind="stable")
            now, later = nodes[order[:step]], order[step:]
            step *= 2
            leaf = self.count[now] == 0
            if leaf.any():
                best.verify(ranges(self.start[now[leaf]], self.size[now[leaf]]))
            more = ranges(self.first[now[~leaf]], self.count[now[~leaf]])
            more_low, more_high = self.bounds(query, more)
            nodes, low, high = np.concatenate((nodes[later], more)), np.concatenate((low[later], more_low)), np.concatenate((high[later], more_high))


class Best:
    """The best few rows of a tree for one anchor: in one list of its own label, or of other labels in each window."""

    def __init__(self, tree: CoverTree, ids: np.ndarray, labels: np.ndarray, anchor: dict, query: np.ndarray, most: int):
        self.tree, self.ids, self.labels, self.anchor, self.query, self.most = tree, ids, labels, anchor, query, most
        self.windows = anchor["windows"] or [None]
        self.low = np.array([-np.inf if w is None else float(w["low"]) for w in self.windows])
        self.high = np.array([np.inf if w is None else float(w["high"]) for w in self.windows])
        self.lists: list[list[tuple[int, int]]] = [[] for _ in self.windows]  # (-score, id)

    def useful(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return ((high[:, None] >= self.low) & (low[:, None] <= self.high)).any(axis=1)

    def verify(self, rows: np.ndarray) -> None:
        if self.anchor["windows"] is None:
            rows = rows[(self.labels[rows] == self.anchor["label"]) & (self.ids[rows] != self.anchor["id"])]
        else:
            rows = rows[self.labels[rows] != self.anchor["label"]]
        if not len(rows):
            return
        scores, ids = exact(self.query[None], self.tree.points[rows])[0], self.ids[rows]
        for i, window in enumerate(self.windows):
            take = np.ones(len(rows), bool) if window is None else (scores >= window["low"]) & (scores <= window["high"])
            if len(self.lists[i]) == self.most:
                take &= scores >= -self.lists[i][-1][0]
            score, of = scores[take], ids[take]
            if len(score) > self.most:  # all that tie with the last of the best stay
                keep = score >= np.partition(score, len(score) - self.most)[len(score) - self.most]
                score, of = score[keep], of[keep]
            if len(score):
                self.lists[i] = sorted([*self.lists[i], *zip((-score).tolist(), of.tolist())])[: self.most]
                if len(self.lists[i]) == self.most:
                    self.low[i] = max(self.low[i], float(-self.lists[i][-1][0]))


def cleaned(rows: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(id, vector, label) of the rows that take part: label and vector are there and all components are finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    named = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"), label.alias("label"))
    return named.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", bad))


def compact(points: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest kind that holds them."""
    most = np.abs(points).max(initial=0.0)
    return points.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.float64)


def planted(rows: DataFrame, tree_rows: int) -> DataFrame:
    """(shard, data): one cover tree for about ``tree_rows`` rows each, with ids and labels. The result is stored."""
    n = rows.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / tree_rows)).cast("int").alias("n")).first()["n"]
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", "vector"), F.lit(n)).cast("int")).repartition(n, "shard").sortWithinPartitions("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            tree = CoverTree(whole_numbers(table["vector"].to_pylist()))
            ids, labels = table["id"].to_numpy()[tree.order], table["label"].to_numpy()[tree.order]
            tree.points, tree.order = compact(tree.points), None
            return pa.RecordBatch.from_arrays([pa.array([held[0]["shard"][0].as_py()], pa.int32()), pa.array([pickle.dumps((tree, ids, labels))], pa.binary())], names=["shard", "data"])

        for batch in batches:
            at = batch["shard"].to_numpy()
            for value in np.unique(at).tolist():
                part = batch.slice(int(np.searchsorted(at, value)), int((at == value).sum()))
                if held and held[0]["shard"][0].as_py() != value:
                    yield done()
                    held.clear()
                held.append(part)
        if held:
            yield done()

    return store(dealt.mapInArrow(run, "shard int, data binary"), "cover-trees")


def blocks(anchors: DataFrame, block: int) -> DataFrame:
    """(block, anchors): the anchors in lists of about ``block``. The result is stored."""
    n = anchors.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / block)).cast("int").alias("n")).first()["n"]
    dealt = anchors.withColumn("block", F.pmod(F.xxhash64("no"), F.lit(n)).cast("int"))
    return store(dealt.groupBy("block").agg(F.collect_list(F.struct("no", "id", "label", "vector", "windows")).alias("anchors")), "anchor-blocks")


def searched(trees: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """(no, at, id, score): the ``most`` best rows of each tree for each anchor, and each of its windows if it has some.

    Every block of anchors meets every tree once: the pairs of their numbers are dealt out, and each brings one tree and
    one block to a task.
    """
    last = asked.agg(F.max("block")).first()[0]
    pairs = store(trees.select("shard", F.explode(F.sequence(F.lit(0), F.lit(last or 0))).alias("block")), "tree-blocks")
    met = pairs.join(trees, "shard").join(asked, "block").select("data", "anchors").repartition(max(1, min(10_000, pairs.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 1):
            tree, ids, labels = pickle.loads(batch["data"][0].as_py())
            tree.points = tree.points.astype(np.float64)
            anchors, out = batch["anchors"].to_pylist()[0], []
            width = tree.points.shape[1]
            for anchor, query in zip(anchors, whole_numbers([a["vector"] for a in anchors])):
                best = Best(tree, ids, labels, anchor, query, most)
                tree.search(np.pad(query, (0, max(0, width - len(query))))[:width], best)
                out += [(anchor["no"], at, i, -less) for at, found in enumerate(best.lists) for less, i in found]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 4, kinds)], names=["no", "at", "id", "score"])

    return met.mapInArrow(run, "no long, at int, id long, score long")


def hard_negatives(
    rows: DataFrame, anchors: Column, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
    id_col: str = "vec_id", vector_col: str = "embedding", tree_rows: int = TREE_ROWS, block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its
    ``positives`` best rows of its label, the ``negatives`` best rows of other labels whose score is at most the positive's
    and at least ``low`` hundredths of it.

    A score is the inner product of floor(256 x); equal scores come by the smaller id. ``anchors`` selects the
    rows that ask; all rows are searched, one cover tree for about ``tree_rows`` of them, and each block of anchors meets each
    tree. A tree gives its best few for an anchor, and the best of these are taken, so results are exact.

    Rows with a null id, label or vector, or a component that is null or not finite take no part. Shorter vectors count
    as filled with zeros. Scores beyond 64 bits are kept at their limits. Anchors that repeat an id ask each for
    themselves, and every row of an anchor's id is left out of its positives. No rows or anchors give no rows.
    """
    label = F.col("label") if label is None else label
    trees = planted(store(cleaned(rows, id_col, vector_col, label), "vectors"), tree_rows)
    asks = store(cleaned(rows.filter(anchors), id_col, vector_col, label).withColumn("no", F.monotonically_increasing_id()), "anchors")
    none = F.lit(None).cast("array<struct<low:bigint,high:bigint,id:bigint>>")
    near = ranked(searched(trees, blocks(asks.withColumn("windows", none), block), positives), ["no"], positives)
    # 80 p <= 100 n <= 100 p, in whole numbers: n from ceil(80 p / 100) to p.
    p = F.col("score")
    ceil = F.ceil(F.lit(low) * p.cast("decimal(20,0)") / 100).cast("long")
    window = F.struct("rank", ceil.alias("low"), p.alias("high"), "id")
    wanted = near.groupBy("no").agg(F.transform(F.array_sort(F.collect_list(window)), lambda w: F.struct(w["low"].alias("low"), w["high"].alias("high"), w["id"].alias("id"))).alias("windows"))
    second = store(asks.join(wanted, "no"), "anchors")
    far = ranked(searched(trees, blocks(second, block), negatives), ["no", "at"], negatives)
    of = second.select("no", F.col("id").alias("anchor_id"), F.posexplode("windows").alias("at", "w"))
    return far.withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score").join(of, ["no", "at"]).select(
        "anchor_id", F.col("w.id").alias("positive_id"), "rank", "negative_id", F.col("w.high").alias("positive_score"), "negative_score"
    )


def ranked(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The best ``most`` of what the trees gave for each key, with their rank. Each task limits its keys before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return store(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select(*keys, "rank", "id", "score"), "ranked")
