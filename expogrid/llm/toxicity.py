"""Toxicity by compression distance: windows compress better with the dictionary whose text they resemble."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from expogrid.llm.common import blank_words, blocks_of, held_out, rows_of, store

WINDOW = 12  # words in a window
PAIRS = 1  # dictionary pairs; more have other ordinary text each, and windows shifted by a share of their length
#: Sizes of the trained dictionaries. The toxic one stands before the ordinary one, which both sides have.
ORDINARY_BYTES, TOXIC_BYTES = 3800, 1500
#: Toxic windows to train on hold words whose beginning at least this share of the toxic rows have, this many times as often as others.
SHARE, TIMES = 0.02, 20
THRESHOLD = 0.3
N_FEATURES = 12


@dataclass(frozen=True)
class Dictionaries:
    """Contents of the ordinary and the toxic dictionary of each pair."""

    ordinary: tuple[bytes, ...]
    toxic: tuple[bytes, ...]


@lru_cache(maxsize=8)
def compressors(dictionaries: Dictionaries):
    settings = zstandard.ZstdCompressionParameters(
        window_log=15, hash_log=13, chain_log=13, search_log=6, min_match=4, target_length=64, strategy=zstandard.STRATEGY_LAZY2,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )

    def compress(content: bytes):
        if not content:
            return zstandard.ZstdCompressor(compression_params=settings).compress
        made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.precompute_compress(compression_params=settings)
        return zstandard.ZstdCompressor(dict_data=made, compression_params=settings).compress

    return [(compress(o), compress(t)) for o, t in zip(dictionaries.ordinary, dictionaries.toxic)]


def openings(text: str) -> set[bytes]:
    """Words with a blank on both sides, and their beginnings of 4 bytes and more."""
    found = set()
    for words in blocks_of(text, blank_words):
        for word in set(words):
            word = b" " + word + b" "
            found.update(word[:k] for k in range(5, min(len(word), 14) + 1))
    return found


def distinctive(rows: list[tuple[str, int]]) -> set[bytes]:
    """Beginnings of words that toxic texts share and ordinary ones do not."""
    toxic, ordinary, n = Counter(), Counter(), [0, 0]
    for text, label in rows:
        n[label] += 1
        (toxic if label else ordinary).update(openings(text))
    return {p for p, k in toxic.items() if k >= max(5, SHARE * n[1]) and (k + 0.5) / (n[1] + 1) > TIMES * (ordinary[p] + 0.5) / (n[0] + 1)}


def toxic_windows(rows: list[tuple[str, int]]) -> list[bytes]:
    """Each toxic text without what ordinary texts hold as well: what is left is what a dictionary of toxic text is to know."""
    own, found = distinctive(rows), []
    for text, label in rows:
        kept = [] if not label else [w for words in blocks_of(text, blank_words) for w in words if own & {(b" " + w + b" ")[:k] for k in range(5, min(len(w) + 2, 14) + 1)}]
        if kept:
            found.append(b" " + b" ".join(kept) + b" ")
    return found


def trained(samples: list[bytes], size: int) -> bytes:
    """The content of a dictionary that the library trains on the samples; the samples' own end where they are too few."""
    try:
        return zstandard.train_dictionary(size + 296, samples, k=16, d=6).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


def train(rows: list[tuple[str, int]]) -> Dictionaries:
    """Dictionaries from labelled texts, both trained by the library.

    The ordinary dictionary comes from all windows of its share of the ordinary texts, the toxic one from the toxic windows. So that
    windows without toxic text compress alike with both, the ordinary content follows the toxic one.
    """
    apart = trained(toxic_windows(rows), TOXIC_BYTES)
    shares: list[list[bytes]] = [[] for _ in range(PAIRS)]
    for i, text in enumerate(text for text, label in rows if not label):
        words = blank_words(text)
        shares[i % PAIRS] += [b" ".join(words[k : k + 16]) for k in range(0, len(words), 16)]
    contents = [trained(share, ORDINARY_BYTES) for share in shares]
    return Dictionaries(tuple(contents), tuple(apart + c for c in contents))


def features(text: str | None, dictionaries: Dictionaries) -> list[float]:
    """How many bytes the toxic dictionaries save over the ordinary ones, summed up over all windows of a text; NaN without any."""
    saved: list[int] = []
    for words in blocks_of(text, blank_words):
        for k, (ordinary, toxic) in enumerate(compressors(dictionaries)):
            for start in range(-(WINDOW // PAIRS) * k, len(words), WINDOW):
                window = b" ".join(words[max(0, start) : start + WINDOW])
                if window:
                    saved.append(len(ordinary(window)) - len(toxic(window)))
    if not saved:
        return [math.nan] * N_FEATURES
    d = np.sort(np.array(saved, float))
    n = len(d)
    return [
        d.mean(), d[-1], d[-3:].mean(), d.sum() / math.sqrt(n), (d >= 3).mean(), (d >= 2).mean(), d[d > 1].sum() / n, (d >= 5).mean(),
        math.log(n), d[n // 2], d[:3].mean(), (d <= -1).mean(),
    ]


@dataclass(frozen=True)
class Scorer:
    dictionaries: Dictionaries
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]  # intercept first

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.weights[0] + ((x - np.array(self.mean)) / np.array(self.scale)) @ np.array(self.weights[1:])
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def calibrate(dictionaries: Dictionaries, x: np.ndarray, y: np.ndarray) -> Scorer:
    """Logistic regression by Newton steps, shifted so that the cut with the best F1 comes to lie at the threshold."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.column_stack((np.ones(len(x)), (x - mean) / scale))
    w, ridge = np.zeros(a.shape[1]), 1e-1 * np.eye(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (p - y) + ridge @ w)
    p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order])
    f1 = 2 * right / (np.arange(1, len(p) + 1) + y.sum())
    best = int(np.argmax(f1))
    cut = (p[order[best]] + p[order[min(best + 1, len(p) - 1)]]) / 2
    w[0] += math.log(THRESHOLD / (1 - THRESHOLD)) - math.log(cut / (1 - cut))
    return Scorer(dictionaries, tuple(mean), tuple(scale), tuple(w))


def sample(docs: DataFrame, labels: DataFrame, toxic_rows: int, ordinary_rows: int, longest: int) -> DataFrame:
    """Labelled texts to learn from: of each class the rows that come first by the hash of their id, within the bounds."""
    known = labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    of = lambda label, n: known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    few = F.broadcast(of(1, toxic_rows).union(of(0, ordinary_rows)))  # at most the two bounds of ids
    texts = docs.select("doc_id", "text").filter(F.length("text").between(1, longest)).join(few, "doc_id")
    return store(texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "toxic-sample")


def measured(df: DataFrame, dictionaries: Dictionaries, column: str) -> DataFrame:
    """The columns of ``df``, with the features of one text column as ``x``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 500):
            x = pa.array([features(t.as_py(), dictionaries) for t in batch[column]], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, x], names=[*batch.schema.names, "x"])

    return df.mapInArrow(run, df.withColumn("x", F.array().cast("array<double>")).schema)


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = 2000, ordinary_rows: int = 4000, longest: int = 50_000) -> Scorer | None:
    """A scorer learnt from a bounded sample of labelled rows; None if one class has no rows to learn from.

    ``toxic_rows``, ``ordinary_rows`` and ``longest`` (characters of a text) bound the sample. The score's weights and
    cut come from features of texts that the dictionaries have not seen: two halves take turns.
    """
    rows = sample(docs, labels, toxic_rows, ordinary_rows, longest)
    learned = [(r.doc_id, r.text, r.toxic) for r in rows.orderBy("doc_id").collect()]
    if len({label for _, _, label in learned}) < 2:
        return None
    half = lambda doc_id: F.pmod(F.xxhash64(doc_id, F.lit("half")), F.lit(2))
    sides = {r.doc_id: r.side for r in rows.select("doc_id", half(F.col("doc_id")).alias("side")).collect()}
    x, y = [], []
    for side in (0, 1):
        own = train([(t, label) for i, t, label in learned if sides[i] != side] or [(t, label) for _, t, label in learned])
        unseen = rows.filter(half(F.col("doc_id")) == side).repartition(rows.sparkSession.sparkContext.defaultParallelism)
        for r in measured(unseen, own, "text").select("doc_id", "toxic", "x").orderBy("doc_id").collect():
            if not math.isnan(r.x[0]):
                x.append(r.x)
                y.append(r.toxic)
    if not x:
        return None
    return calibrate(train([(t, label) for _, t, label in learned]), np.array(x), np.array(y, float))


def scored(docs: DataFrame, scorer: Scorer | None, text_col: str = "text") -> DataFrame:
    """Each input row as ``row``, with its score from 0 to 1 and whether it reaches the threshold.

    Every window of a whole text counts; nothing is shuffled. A text without words, a null or empty one among
    them, has no windows and scores 0. Without a scorer all scores are 0. Columns of any name may ride along.
    """
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("body"))
    if scorer is None:
        return named.select("row", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 500):
            x = np.array([features(t.as_py(), scorer.dictionaries) for t in batch["body"]]).reshape(-1, N_FEATURES)
            score = np.where(np.isnan(x[:, 0]), 0.0, scorer.score(np.nan_to_num(x)))
            yield pa.RecordBatch.from_arrays(
                [batch["row"], pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32), pa.int32())], names=["row", "score", "predicted"]
            )

    return named.mapInArrow(run, named.select("row", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema)
