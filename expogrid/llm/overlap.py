"""Exact token counts of whole texts, huge ones in overlapping chunks spliced where no token can cross."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from expogrid.llm import pieces
from expogrid.llm.common import keyed, rows_of

SCHEMA = "doc_id long, n_bytes long, n_tokens long, n_chunks long, n_widened long"


class Counter:
    """Token counts of one SentencePiece model.

    A text of up to ``chunk`` characters is encoded whole. A longer one is encoded in chunks that overlap by
    ``overlap`` characters. Two neighbouring chunks are spliced at a place in their overlap where a token begins in
    both and whose two characters stand side by side in no piece of the vocabulary: merges never cross such a place,
    so the tokens before it depend on nothing after it and the other way round. Where the overlap has no such place
    it is doubled, up to the whole rest of the text.
    """

    def __init__(self, path: str, chunk: int, overlap: int):
        import sentencepiece

        with open(path, "rb") as file:
            data = file.read()
        self.model, self.chunk, self.overlap = pieces.parse(data), chunk, overlap
        self.joined = self.model.joined()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)

    def stable(self, text: str, at: int) -> bool:
        a, b = (pieces.MARK if c == " " else c for c in text[at - 1 : at + 1])
        return (a, b) not in self.joined

    def starts(self, texts: list[str]) -> list[np.ndarray]:
        """Where each token of each text begins, in characters."""
        found = self.library.encode(texts, return_type="offset_mapping", num_threads=1)
        return [np.array(x["offsets"], np.int64).reshape(-1, 2)[:, 0] for x in found]

    def splice(self, text: str, low: int, high: int, left: np.ndarray, right: np.ndarray) -> int | None:
        """A place in (low, high) that begins a token on both sides and is stable, nearest to the middle."""
        common = np.intersect1d(left[(left > low) & (left < high)], right[(right > low) & (right < high)])
        middle = (low + high) // 2
        for at in sorted(common.tolist(), key=lambda x: abs(x - middle)):
            if self.stable(text, at):
                return at
        return None

    def count(self, text: str) -> tuple[int, int, int]:
        """Tokens, chunks and widened overlaps of one text."""
        size = len(text)
        if size <= self.chunk or not self.model.plain:
            return len(self.library.encode(text)), 1, 0
        tokens = chunks = widened = 0
        begin, done, end = 0, 0, self.chunk  # begin: where the chunk at hand starts; done: tokens before it are counted
        left = self.starts([text[begin:end]])[0] + begin
        while True:
            chunks += 1
            if end >= size:
                return tokens + int((left >= done).sum()), chunks, widened
            overlap = self.overlap
            while True:
                start, stop = max(done, end - overlap), min(size, end + self.chunk)
                right = self.starts([text[start:stop]])[0] + start
                at = self.splice(text, start, end, left, right)
                if at is not None:
                    break
                widened, overlap = widened + 1, overlap * 2
                end = min(size, end + overlap)
                left = self.starts([text[begin:end]])[0] + begin
                if end >= size:
                    break
            if at is None:
                continue
            tokens += int(((left >= done) & (left < at)).sum())
            begin, done, end, left = start, at, stop, right


@lru_cache(maxsize=4)
def counter(path: str, chunk: int, overlap: int) -> Counter:
    return Counter(path, chunk, overlap)


def count_tokens(docs: DataFrame, path: str | None = None, chunk: int = 1 << 14, overlap: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens and how many chunks and widened overlaps it took.

    Counts equal the library's for the whole text. Nothing is shuffled; a task holds one chunk's tokens at a time.
    A null or empty text has no bytes and no tokens. Equal rows give equal rows; no rows give no rows.
    ``path`` must hold the model on every machine.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(path, chunk, overlap)
        for batch in rows_of(batches, 500):
            texts = [t or "" for t in batch["text"].to_pylist()]
            short = [i for i, t in enumerate(texts) if len(t) <= chunk]
            found: list = [None] * len(texts)
            for i, ids in zip(short, tool.library.encode([texts[i] for i in short], num_threads=1)):
                found[i] = (len(ids), 1, 0)
            found = [f or tool.count(t) for f, t in zip(found, texts)]
            columns = [pa.array(x, pa.int64()) for x in ([len(t.encode("utf-8")) for t in texts], *(zip(*found) if found else ((), (), ())))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), *columns], names=["doc_id", "n_bytes", "n_tokens", "n_chunks", "n_widened"])

    return keyed(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, SCHEMA)
