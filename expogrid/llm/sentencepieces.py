"""SentencePiece encoding and decoding by the tokenizers library, rebuilt from the model file and held to parity."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from expogrid.llm import pieces
from expogrid.llm.common import rows_of

STRETCH = re.compile(" +[^ ]*")


def splits_at_marks(model: pieces.Model) -> bool:
    """No piece holds a mark behind another character, so no token crosses from a word into the mark of the next."""
    return not any(b == pieces.MARK and a != pieces.MARK for a, b in model.joined())


def merges(model: pieces.Model) -> list[tuple[str, str]]:
    """Every way to make a piece of two others, the best-scored piece first: the order in which they are merged."""
    score = {text: s for text, s, kind in model.pieces if kind in (pieces.NORMAL, pieces.USER_DEFINED)}
    rank = {text: i for i, (text, _, _) in enumerate(model.pieces)}
    ways = []
    for text in sorted(score, key=lambda t: (-score[t], rank[t])):
        halves = [(text[:k], text[k:]) for k in range(1, len(text))]
        ways += sorted((h for h in halves if h[0] in score and h[1] in score), key=lambda h: (rank[h[0]], rank[h[1]]))
    return ways


def rebuild(data: bytes) -> tuple[Tokenizer, pieces.Model]:
    """A tokenizer with the model's normaliser, marks, scores or merges, and byte fallback."""
    model = pieces.parse(data)
    # pieces that never match text get names that text does not hold
    names = [t if kind in (pieces.NORMAL, pieces.USER_DEFINED, pieces.BYTE) else f"{i}" for i, (t, _, kind) in enumerate(model.pieces)]
    if model.kind == pieces.UNIGRAM:
        core = models.Unigram([(n, s) for n, (_, s, _) in zip(names, model.pieces)], unk_id=model.unk_id, byte_fallback=model.byte_fallback)
    elif model.kind == pieces.BPE:
        vocabulary = {n: i for i, n in enumerate(names)}
        core = models.BPE(vocabulary, merges(model), unk_token=names[model.unk_id], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError("only unigram and BPE models are known")
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.collapse_blanks:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(pieces.MARK))
    if model.escape_blanks:
        steps.append(normalizers.Replace(" ", pieces.MARK))
    tokenizer = Tokenizer(core)
    tokenizer.normalizer = normalizers.Sequence(steps)
    if splits_at_marks(model):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{pieces.MARK}+[^{pieces.MARK}]*"), "isolated")
    tail = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(pieces.MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return tokenizer, model


class Codec:
    """Encodes and decodes batches on the library's threads, and holds them to the reference library.

    Where no token crosses from a word into the mark of the next, a text is encoded as its stretches are, each a run of
    blanks with the word behind it. Then every distinct stretch is encoded, decoded and compared once, in a table that
    starts anew when full, and texts are put together from it. Texts of other models are encoded whole.
    """

    def __init__(self, path: str, threads: int, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "true", str(threads)
        import sentencepiece

        with open(path, "rb") as file:
            data = file.read()
        self.tokenizer, self.model = rebuild(data)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.by_stretch = splits_at_marks(self.model) and self.model.plain
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}  # number of a stretch; its ids are size[n] of ``flat`` from start[n] on
        self.flat = np.zeros(1 << 16, np.int32)
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.used = 0
        self.unlike: set[str] = set()  # stretches that the reference library encodes in another way
        self.changed: dict[str, str] = {}  # what stretches come back as, where that is not as they were

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False) if ids else []

    def whole(self, texts: list[str]) -> list[tuple[list[int], str, bool]]:
        """Ids, decoded text and parity of each text. Where parity fails, the ids are the reference library's."""
        ids, wanted = self.encode(texts), self.library.encode(texts, num_threads=1) if texts else []
        ids = [x if t else [] for t, x in zip(texts, ids)]
        return list(zip(wanted, self.decode(wanted), (a == b for a, b in zip(ids, wanted))))

    def learn(self, new: list[str]) -> None:
        done = dict(zip(new, self.whole([x[1:] for x in new])))  # the mark in front is the first blank
        if " " in done:  # a blank at the end is a mark with no word, which no text begins with
            head, tail = self.whole(["a", "a "])
            done[" "] = (tail[0][len(head[0]) :], "", head[2] and tail[2])
        first, ids = len(self.known), list(chain.from_iterable(x for x, _, _ in done.values()))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while first + len(done) > len(self.start):
            self.start, self.size = np.concatenate((self.start, np.zeros_like(self.start))), np.concatenate((self.size, np.zeros_like(self.size)))
        sizes = np.array([len(x) for x, _, _ in done.values()], np.int32)
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[first : first + len(done)] = sizes
        self.start[first : first + len(done)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        for n, (x, (_, back, same)) in enumerate(done.items(), first):
            self.known[x] = n
            if not same:
                self.unlike.add(x)
            if back != x[1:]:
                self.changed[x] = " " + back

    def packed(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], list[bool]]:
        """Ids of all texts one behind the other, where each text's begin and end, decoded texts and parity."""
        if not self.by_stretch:
            done = self.whole(texts)
            ends = np.cumsum([0, *(len(x) for x, _, _ in done)])
            return np.array(list(chain.from_iterable(x for x, _, _ in done)), np.int32), ends, [x for _, x, _ in done], [x for _, _, x in done]
        if len(self.known) > self.most:
            self.forget()
        plain = [" " + t.replace(pieces.MARK, " ") if t else "" for t in texts]
        stretches = [STRETCH.findall(t) for t in plain]
        every = list(chain.from_iterable(stretches))
        try:
            number = np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))
        except KeyError:
            self.learn(sorted(set(every) - self.known.keys()))
            number = np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))
        size = self.size[number].astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(size)))
        ids = self.flat[np.repeat(self.start[number] - ends[:-1], size) + np.arange(ends[-1])]
        ends = ends[np.cumsum([0, *map(len, stretches)])]
        backs = [("".join([self.changed.get(x, x) for x in some]) if self.changed else text)[1:] for text, some in zip(plain, stretches)]
        return ids, ends, backs, [not self.unlike or self.unlike.isdisjoint(some) for some in stretches]

    def run(self, texts: list[str]) -> list[tuple[list[int], str, bool]]:
        ids, ends, backs, same = self.packed(texts)
        return [(ids[a:b].tolist(), back, like) for a, b, back, like in zip(ends[:-1], ends[1:], backs, same)]


@lru_cache(maxsize=2)
def codec(path: str, threads: int, most: int = 400_000) -> Codec:
    return Codec(path, threads, most)


def decoded_text(text: str, model: pieces.Model) -> str:
    """What decoding gives for a text of a plain model: marks come back as blanks."""
    return text.replace(pieces.MARK, " ")


def encoded(docs: DataFrame, path: str | None = None, threads: int = 2, text_col: str = "text", keep: bool = True, most: int = 1_000_000) -> DataFrame:
    """Each input row as ``row``, with its ids, the text decoded from them, and parity with the reference library.

    A text whose ids differ from the reference library's takes the library's ids, and ``parity`` is false. Whole
    texts are encoded in batches on ``threads`` threads; nothing is shuffled. A null text has null ids and a null
    decoded text, an empty one has no ids; both are in parity. A worker's table holds up to about ``most`` stretches. Unless ``keep``, it drops the table
    when a task ends, which leaves the memory to what runs after it. ``path`` must hold the model on every machine. Columns
    of any name may ride along; repeated rows give repeated results, no rows no rows.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("body"))
    schema = named.select("row", F.array().cast("array<int>").alias("ids"), F.lit("").alias("decoded"), F.lit(True).alias("parity")).schema
    for name in ("ids", "decoded"):
        schema[name].nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, threads, most)
        try:
            for batch in rows_of(batches, 200):
                texts = batch["body"].to_pylist()
                ids, ends, backs, same = tool.packed([t or "" for t in texts])
                missing = np.array([t is None for t in texts], bool)
                offsets = pa.array(ends.astype(np.int32), mask=np.append(missing, False)) if missing.any() else pa.array(ends.astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
                backs = pa.array([None if t is None else x for t, x in zip(texts, backs)], pa.string())
                yield pa.RecordBatch.from_arrays([batch["row"], lists, backs, pa.array(same, pa.bool_())], names=["row", "ids", "decoded", "parity"])
        finally:
            if not keep:
                tool.forget()

    return named.mapInArrow(run, schema)
