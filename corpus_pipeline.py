"""A corpus pipeline: toxic documents, near-duplicates, repeated passages and benchmark text go; the rest is encoded."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from expogrid.llm import fmindex, neardup, sentencepieces, toxicity, windows
from expogrid.llm.common import rows_of, store, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance score rejects go; the scorer learns from labelled rows not held out.

    Null and empty texts have no windows and stay. Repeated rows share their fate. Without labels of both kinds
    nothing goes. No rows give no rows.
    """
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, scorer).filter("predicted = 0").select("row.*")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays.

    Candidates are what SimHash links and bands of sketches join; five-word shingles of whole texts decide at a similarity
    of 0.8. Null, empty and blank texts are one group; repeated rows are copies; ties go by the hash of id and text.
    """
    return neardup.deduplicated(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that another document keeps are cut out; a document of which no word is left goes.

    Texts below fifty words, null and empty ones stay as they are. ``n_chars`` follows the text where it was cut.
    """
    found = windows.repeats(docs).filter(F.size("spans") > 0).select("rid", "spans").dropDuplicates(["rid"])
    rest = F.struct("doc_id", *[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")])  # so that a text goes to Python once
    named = docs.select(rest.alias("row"), "text", windows.row_id().alias("rid"))
    joined = named.join(store(found, "spans"), "rid", "left").select("row", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 500):
            texts = [t if not s else windows.cut(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(batch["text"].to_pylist(), batch["spans"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(texts, pa.string()), batch["spans"]], names=["row", "text", "spans"])

    changed = F.col("spans").isNotNull()
    values = {"text": F.col("text"), "n_chars": F.when(changed, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))}
    kept = joined.mapInArrow(run, joined.schema).filter(~changed | F.col("text").rlike("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"))
    return kept.select(*[values.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go: at least a twentieth of their words stands in benchmark windows.

    Texts without words, null ones among them, stay; so does everything if the benchmark has no words.
    """
    found = fmindex.scan(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(~fmindex.contaminated()).select("row.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with whether decoding restores the text as it was and parity with the reference library.

    A null text has null ids and no tokens and counts as restored. Of other columns than these only lang and source stay.
    """
    done = sentencepieces.encoded(docs, keep=False, most=400_000)
    restored = F.col("decoded").eqNullSafe(F.col("row.text"))
    return done.select("row.doc_id", "row.lang", "row.source", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", restored.alias("restored"), "parity")


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", without_near_duplicates),
    ("substring_dedup", without_repeats),
    ("benchmark_decontamination", without_benchmark),
    ("sentencepiece", encoded),
]
#: Compression lengths of zstandard have no form in SQL; the tests hold run() to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
