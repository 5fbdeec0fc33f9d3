"""Typed ingest of wide text tables, with the audits taken during the write itself."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import clean_text, typed
from ..operators import audit
from . import sinks
from .schema import TableSchema, compare_schema

OVERFLOW = "_overflow"


class IngestError(ValueError):
    """A source broke its contract; the message says how."""


def resolve_sources(spark: SparkSession, folder: str, patterns: dict[str, str]) -> DataFrame:
    """Match each logical table to exactly one file by glob; returns table, path, bytes.

    Only file metadata is read.
    """
    parts = [
        spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select(
            F.lit(table).alias("source_table"), "path", F.col("length").alias("bytes")
        )
        for table, glob in patterns.items()
    ]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    counts = {r["source_table"]: r["count"] for r in found.groupBy("source_table").count().collect()}
    wrong = {t: counts.get(t, 0) for t in patterns if counts.get(t, 0) != 1}
    if wrong:
        raise IngestError(f"each table needs exactly one file; matches found: {wrong}")
    return found


def header(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> list[str]:
    """Column names as written, without reading data rows for types."""
    return spark.read.option("sep", sep).option("encoding", encoding).csv(path, header=True, inferSchema=False).columns


def scan_text(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """All columns as text. Short rows are padded with NULL; a row that is too long shows in the overflow column."""
    fields = [T.StructField(c, T.StringType()) for c in [*columns, OVERFLOW]]
    return (
        spark.read.schema(T.StructType(fields)).option("sep", sep).option("encoding", encoding)
        .option("mode", "PERMISSIVE").option("enforceSchema", "true").option("quote", '"').option("escape", '"')
        .csv(path, header=True)
    )


def typed_table(text: DataFrame, schema: TableSchema, strict: bool = False) -> DataFrame:
    return text.select(*[typed(c, k, strict).alias(c) for c, k in schema.types().items()])


def cast_failures(schema: TableSchema, strict: bool = False) -> dict[str, Column]:
    """Per typed column, the aggregate counting texts that do not convert."""
    return {
        c: F.count(F.when(clean_text(c).isNotNull() & typed(c, k, strict).isNull(), 1))
        for c, k in schema.types().items() if k != "string"
    }


def cast_audit(text: DataFrame, schema: TableSchema, strict: bool = False) -> DataFrame:
    """One row per typed column with its failed casts and filled values, from one aggregate."""
    bad = cast_failures(schema, strict)
    filled = {c: F.count(clean_text(c)) for c in bad}
    wide = text.agg(*[v.alias(f"bad__{c}") for c, v in bad.items()], *[v.alias(f"filled__{c}") for c, v in filled.items()])
    return wide.select(F.inline(F.array(*[
        F.struct(
            F.lit(schema.name).alias("source_table"), F.lit(c).alias("column_name"), F.lit(schema.kind(c)).alias("data_type"),
            F.col(f"filled__{c}").alias("filled"), F.col(f"bad__{c}").alias("failed"),
        ) for c in bad
    ])))


@dataclass(frozen=True)
class Ingested:
    """What one clean run wrote. ``fallback``: over-long rows made a strict run fail, and a tolerant one was taken."""

    table: str
    path: str
    rows: int
    size: int
    columns: tuple[tuple[str, str], ...]
    failures: dict[str, int]
    skipped_rows: int = 0
    fallback: bool = False


class LongRows(IngestError):
    """Rows with more fields than the header."""


def ingest(
    spark: SparkSession, source: str, target: str, schema: TableSchema, *, sep: str = ",", encoding: str = "UTF-8",
    strict_cast: bool = False, tolerant: bool = False, unique: str | None = None, max_file_rows: int = 5_000_000,
) -> Ingested:
    """Text file to ZSTD Parquet in one scan: header contract, casts, counts, recount.

    Rows and failed casts are observed while the file is written, so the source is read
    once. The table is written beside ``target`` and takes its place only after a clean
    run; the call raises on failed casts, over-long rows, a differing recount or repeated
    values of the ``unique`` column, and then leaves nothing behind. ``tolerant`` drops
    over-long rows and reports how many.
    """
    schema.check_columns(header(spark, source, sep, encoding))
    if sinks.exists(spark, target):
        raise IngestError(f"{target} exists")
    text = scan_text(spark, source, schema.expected, sep, encoding)
    bad = cast_failures(schema, strict_cast)
    long_row = F.col(OVERFLOW).isNotNull()
    seen, kept = Observation(), Observation()
    text = text.observe(seen, F.count(F.lit(1)).alias("rows"), F.count(F.when(long_row, 1)).alias("long_rows"))
    usable = text.filter(~long_row) if tolerant else text
    usable = usable.observe(kept, F.count(F.lit(1)).alias("rows"), *[v.alias(f"bad__{c}") for c, v in bad.items()])
    beside = f"{target}.unchecked-{uuid.uuid4().hex}"
    try:
        writer = typed_table(usable, schema, strict_cast).write.option("compression", "zstd").option("maxRecordsPerFile", max_file_rows)
        writer.parquet(beside)
        counts, long_rows = kept.get, seen.get["long_rows"]
        failures = {c: counts[f"bad__{c}"] for c in bad if counts[f"bad__{c}"]}
        if long_rows and not tolerant:
            raise LongRows(f"{schema.name}: {long_rows} rows have more fields than the header")
        if failures:
            raise IngestError(f"{schema.name}: values that do not convert: {failures}")
        table = spark.read.parquet(beside)
        written = table.count()
        if written != counts["rows"]:
            raise IngestError(f"{schema.name}: wrote {written} rows of {counts['rows']}")
        if unique and table.filter(F.col(unique).isNotNull()).groupBy(unique).count().filter("count > 1").limit(1).count():
            raise IngestError(f"{schema.name}: {unique} is not unique")
        size = sinks.size(spark, beside)
        sinks.rename(spark, beside, target)
    finally:
        sinks.remove(spark, beside)
    return Ingested(schema.name, target, written, size, tuple((f.name, f.dataType.simpleString()) for f in table.schema.fields), failures, long_rows)


def ingest_or_fall_back(spark: SparkSession, source: str, target: str, schema: TableSchema, **options) -> Ingested:
    """A strict run first; where over-long rows stop it, a tolerant one, recorded as a fallback."""
    try:
        return ingest(spark, source, target, schema, **options)
    except LongRows:
        return replace(ingest(spark, source, target, schema, tolerant=True, **options), fallback=True)


def manifest(spark: SparkSession, done: Sequence[Ingested]) -> DataFrame:
    """One row per table: where, how large, which columns, and what the run let pass."""
    rows = [
        (d.table, d.path, d.rows, d.size, len(d.columns), ", ".join(f"{n} {t}" for n, t in d.columns), d.skipped_rows, sum(d.failures.values()), d.fallback)
        for d in done
    ]
    return spark.createDataFrame(rows, (
        "source_table string, path string, rows long, bytes long, column_count int, columns string, skipped_rows long, failed_casts long, fallback boolean"
    ))


def profile(df: DataFrame, schema: TableSchema, key: str, items: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Profile of a Parquet table: drift against the contract, the key's spread and, where named, the item combinations."""
    parts = {"schema": compare_schema(df.sparkSession, schema.name, df.columns, schema), "key": audit.key_profile(df, key)}
    return parts | ({"items": audit.item_combinations(df, key, items, schema.name)} if items else {})


def register_tables(tables: dict[str, DataFrame], prefix: str = "raw_") -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(f"{prefix}{name}")


def read_tables(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}
