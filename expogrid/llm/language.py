"""Language identification: unigram pieces of a fixed public vocabulary, summed over all segmentations of a word."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from expogrid.llm import pieces
from expogrid.llm.common import held_out, keyed, rows_of, store

LONGEST = 32  # a longer run of letters is scored in parts of this length
WORD = re.compile(r"[^\W\d_]{1,%d}" % LONGEST)
STRANGE = 1e-7  # probability of a character that the vocabulary lacks, the same in every language


def letter_runs(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Vocabulary:
    """Pieces of letters, some behind the mark that begins a word."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            model = pieces.parse(file.read())
        texts = sorted({t for t, _, kind in model.pieces if kind == pieces.NORMAL and WORD.fullmatch(t.removeprefix(pieces.MARK)) and t == t.lower()})
        self.ids = {t: i for i, t in enumerate(texts)}
        self.size = len(texts)
        #: Every beginning of a piece, with the piece's id or, where it is none, -1.
        self.openings = {t[:k]: -1 for t in texts for k in range(1, len(t))} | self.ids

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word, start, end, piece) of every piece in every word, ordered by word and start; and lengths. Unknown: -1.

        Only letters count towards lengths; the mark in front belongs to the first one.
        """
        at, starts, ends, ids = [], [], [], []
        get = self.openings.get
        for w, word in enumerate(words):
            marked, n = pieces.MARK + word, len(word)
            for start in range(n):
                known = len(ids)
                single = False
                if start == 0:
                    for end in range(2, n + 2):
                        piece = get(marked[:end])
                        if piece is None:
                            break
                        if piece >= 0:
                            ids.append(piece)
                            ends.append(end - 1)
                            single |= end == 2
                for end in range(start + 1, n + 1):
                    piece = get(word[start:end])
                    if piece is None:
                        break
                    if piece >= 0:
                        ids.append(piece)
                        ends.append(end)
                        single |= end == start + 1
                if not single:
                    ids.append(-1)
                    ends.append(start + 1)
                starts += [start] * (len(ids) - known)
            at += [w] * (len(ids) - len(at))
        found = np.array((at, starts, ends, ids), np.int64).T
        return found, np.array([len(w) for w in words], np.int64)


class Lattice:
    """Forward and backward sums over all segmentations of many words at once, for all languages side by side."""

    def __init__(self, vocabulary: Vocabulary, words: list[str]):
        self.edges, self.lengths = vocabulary.edges(words)
        self.n = len(words)

    def weights(self, probability: np.ndarray) -> np.ndarray:
        """Probabilities by edge: a row for each edge, a column for each language."""
        piece = self.edges[:, 3]
        return np.where((piece >= 0)[:, None], probability[np.maximum(piece, 0)], STRANGE)

    def forward(self, weight: np.ndarray) -> np.ndarray:
        width = int(self.lengths.max(initial=0)) + 1
        sums = np.zeros((self.n, width, weight.shape[1]))
        sums[:, 0] = 1
        w, start, end, _ = self.edges.T
        by_end = np.argsort(end, kind="stable")
        cuts = np.searchsorted(end[by_end], np.arange(1, width + 1))
        for i in range(1, width):
            e = by_end[cuts[i - 1] : cuts[i]]
            if len(e):
                at, first = np.unique(w[e], return_index=True)
                sums[at, i] = np.add.reduceat(sums[w[e], start[e]] * weight[e], first, axis=0)
        return sums

    def backward(self, weight: np.ndarray) -> np.ndarray:
        width = int(self.lengths.max(initial=0)) + 1
        sums = np.zeros((self.n, width, weight.shape[1]))
        sums[np.arange(self.n), self.lengths] = 1
        w, start, end, _ = self.edges.T
        by_start = np.argsort(start, kind="stable")
        cuts = np.searchsorted(start[by_start], np.arange(0, width + 1))
        for i in range(width - 2, -1, -1):
            e = by_start[cuts[i] : cuts[i + 1]]
            if len(e):
                at, first = np.unique(w[e], return_index=True)
                sums[at, i] += np.add.reduceat(sums[w[e], end[e]] * weight[e], first, axis=0)
        return sums

    def log_likelihood(self, probability: np.ndarray) -> np.ndarray:
        forward = self.forward(self.weights(probability))
        return np.log(np.maximum(forward[np.arange(self.n), self.lengths], 1e-300))


@dataclass(frozen=True)
class Languages:
    names: tuple[str, ...]
    probability: np.ndarray  # piece by language
    path: str


def learn(path: str, names: list[str], words: list[str], n: np.ndarray, rounds: int = 4) -> Languages:
    """Piece probabilities by expectation maximisation over words and their counts, a column for each language."""
    vocabulary = Vocabulary(path)
    probability = np.full((vocabulary.size, len(names)), 1 / vocabulary.size)
    steps = [slice(i, i + 4000) for i in range(0, len(words), 4000)]
    for _ in range(rounds):
        expected = np.full_like(probability, 0.05)
        for part in steps:
            lattice = Lattice(vocabulary, words[part])
            weight = lattice.weights(probability)
            forward, backward = lattice.forward(weight), lattice.backward(weight)
            w, start, end, piece = lattice.edges.T
            total = np.maximum(forward[np.arange(lattice.n), lattice.lengths], 1e-300)
            share = forward[w, start] * weight * backward[w, end] / total[w] * n[part][w]
            known = piece >= 0
            np.add.at(expected, piece[known], share[known])
        probability = expected / expected.sum(axis=0)
    return Languages(tuple(names), probability, path)


def fit(docs: DataFrame, path: str | None = None, rows_per_language: int = 800, longest: int = 50_000) -> Languages | None:
    """Languages learnt from documents with a language that are not held out; None without such documents.

    Of each language about ``rows_per_language`` documents of up to ``longest`` characters are read, those with the
    smallest hashes of their ids; repeated ids count once. Words are counted on the cluster.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.length("text").between(1, longest) & ~held_out(F.col("doc_id")))
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return None
    draw = F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1 << 30)) / F.lit(1 << 30)
    share = F.lit(0.0)
    for name, n in sorted(sizes.items()):
        share = F.when(F.col("lang") == name, F.lit(min(1.0, rows_per_language / n))).otherwise(share)
    sample = known.filter(draw < share).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    sample = store(sample, "language-sample")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 500):
            lang, word = [], []
            for name, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                found = letter_runs(text)
                lang += [name] * len(found)
                word += found
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.string())], names=["lang", "word"])

    counted = sample.select("lang", "text").mapInArrow(words, "lang string, word string").groupBy("lang", "word").count()
    names = sorted(sizes)
    table = counted.toArrow()  # words of the bounded sample
    words, at = np.unique(np.array(table["word"].to_pylist(), object), return_inverse=True)
    n = np.zeros((len(words), len(names)))
    np.add.at(n, (at, np.searchsorted(names, table["lang"].to_pylist())), table["count"].to_numpy())
    return learn(path, names, words.tolist(), n)


class Scorer:
    """Log-likelihoods of whole texts; every distinct word is summed up once, in a table that starts anew when full."""

    def __init__(self, languages: Languages, most: int = 600_000):
        self.languages, self.most, self.vocabulary = languages, most, Vocabulary(languages.path)
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.languages.names)))
        self.letters = np.zeros(0, bool)

    def score(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        if len(self.ids) > self.most:
            self.forget()
        found = [letter_runs(t) for t in texts]
        new = sorted({w for words in found for w in words} - self.ids.keys())
        for start in range(0, len(new), 20_000):
            some = new[start : start + 20_000]
            self.rows = np.concatenate((self.rows, Lattice(self.vocabulary, some).log_likelihood(self.languages.probability)))
            self.letters = np.concatenate((self.letters, [any(c.isalpha() for c in w) for w in some]))
            self.ids.update(zip(some, range(len(self.ids), len(self.ids) + len(some))))
        for words in found:
            at = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
            if not self.letters[at].any():
                yield "und", 0.0
                continue
            total = self.rows[at].sum(axis=0)
            likely = np.exp(total - total.max())
            best = int(np.argmax(total))
            yield self.languages.names[best], float(likely[best] / likely.sum())


_SCORERS: dict[int, Scorer] = {}


def scorer_of(sent) -> Scorer:
    """The worker's scorer for a broadcast model: its table of words serves one task after another."""
    if sent.value is not getattr(_SCORERS.get(0), "languages", None):
        _SCORERS[0] = Scorer(sent.value)
    return _SCORERS[0]


def identify(docs: DataFrame, languages: Languages | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred and score, the share of the language among all, each equally likely at first.

    Whole texts count and nothing is shuffled. A text that is null or has no letters is ``und`` with score 0, as are
    all texts if no language was learnt. Of equally likely languages the first by name is taken.
    """
    named = keyed(docs, id_col, text_col)
    if languages is None:
        return named.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(languages)  # vocabulary by languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(sent)
        for batch in rows_of(batches, 1000):
            found = list(scorer.score(batch["text"].to_pylist()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return named.mapInArrow(run, named.select("doc_id", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema)
