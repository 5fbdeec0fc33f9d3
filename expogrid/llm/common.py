"""What the text operators share: input columns, ASCII words, stored tables and the training split."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from expogrid.sources import sinks

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of words are digits, letters and everything past ASCII; the rest become blanks, A-Z become a-z.
WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def keyed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Key and text only: columns that happen to share a name with a result column never reach an operator."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else, unlike ``lower``."""
    return F.translate(text, UPPER, LOWER)


def alnum_words(text: str | None) -> list[bytes]:
    """ASCII-lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` as UTF-8; none for a null."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def blank_words(text: str | None) -> list[bytes]:
    """ASCII-lower-cased words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; none for a null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def held_out(doc_id: Column) -> Column:
    """Rows that models never learn from: crc32 of the id as text leaves 2 on division by 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def rows_of(batches: Iterator[pa.RecordBatch], most: int = 2000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded length, so that Python strings of few rows exist at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            yield batch.slice(start, most)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of jobs in the block go when their job ends: what it wrote is stored and needs them no more."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def short_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Jobs in the block hand so many rows at a time to Python: with whole texts, more of them fill both sides' memory."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def store(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by a table in the shared folder; a lost executor then costs only a new read."""
    with tidy_shuffles(df.sparkSession):
        return sinks.store(df, f"llm-{name}")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """``store`` for tables that nothing reads after the block: they share a folder, which goes with it."""
    folder = f"{sinks.shared_folder(spark)}/llm-scratch-{uuid.uuid4().hex}"

    def keep(df: DataFrame, name: str) -> DataFrame:
        with tidy_shuffles(spark):
            return sinks.store(df, name, folder)

    try:
        yield keep
    finally:
        sinks.remove(spark, folder)


def blocks_of(text: str | None, split=alnum_words, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a whole text, for a very long one about ``size`` characters at a time, cut at blanks or line ends."""
    if not text or len(text) <= size:
        yield split(text)
        return
    start = 0
    while start < len(text):
        end = start + size
        while end < len(text) and text[end] not in " \n":
            end += 1
        yield split(text[start:end])
        start = end
