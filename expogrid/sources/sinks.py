"""Result tables, checkpoints and run counts."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stack(parts: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column missing from a part is NULL there, in first-seen column order."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_result(df: DataFrame, path: str, fmt: str = "csv", single_file: bool = True) -> None:
    """Write a result table. Results are aggregates, small by construction, hence one file by default."""
    out = df.repartition(1) if single_file else df
    writer = out.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.option("compression", "zstd").format(fmt).save(path)


def read_result(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Read a result back: Parquet as it is, CSV with the schema given (blank is NULL)."""
    if schema is None:
        return spark.read.parquet(path)
    return spark.read.schema(schema).csv(path, header=True, nullValue="", emptyValue="")


def write_checkpoint(df: DataFrame, path: str, region: str | None = None, max_file_rows: int = 5_000_000, spread: int = 8) -> DataFrame:
    """Write the unit-level table and return it as read back: later stages restart from here.

    Partitioned by region so that regional analyses prune files. Rows of a region are gathered in up to ``spread``
    tasks first, so a folder holds few files, yet no task has to hold a large region alone.
    """
    if region:
        df = df.repartition(F.col(region), F.pmod(F.xxhash64(*df.columns), F.lit(spread)))
    writer = df.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", max_file_rows)
    if region:
        writer = writer.partitionBy(region)
    writer.parquet(path)
    return read_checkpoint(df.sparkSession, path, df.columns, df.schema)


def read_checkpoint(spark: SparkSession, path: str, columns: Sequence[str] | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """Read a checkpoint back. With its schema, folder names keep their type: a region "01" stays text."""
    df = (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession, folder: str | None = None) -> str:
    """Where intermediate tables go: the folder given, else the one ``spark.checkpoint.dir`` names, else the one set on
    the context, else one beside the warehouse's tables, which all executors share as well. Never a temporary one.
    """
    named = folder or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_stages"


def store(df: DataFrame, name: str = "table", folder: str | None = None) -> DataFrame:
    """Cut the lineage by a written table: survives lost executors, and later reads prune columns."""
    path = f"{shared_folder(df.sparkSession, folder)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def stored(df: DataFrame, name: str = "table", folder: str | None = None) -> Iterator[DataFrame]:
    """A stored copy for as long as the block runs; nothing lazy may outlive it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark, folder)}/{name}-{uuid.uuid4().hex}"
    try:
        df.write.option("compression", "zstd").parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        remove(spark, path)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    at, files = _file_system(spark, path)
    files.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _file_system(spark, path)
    return files.exists(at)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path."""
    at, files = _file_system(spark, path)
    return files.getContentSummary(at).getLength()


def rename(spark: SparkSession, path: str, to: str) -> None:
    at, files = _file_system(spark, path)
    if not files.rename(at, spark._jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"{path} cannot be renamed to {to}")


def identity(spark: SparkSession, folder: str) -> str:
    """A digest of the paths, lengths and modification times of the files below a folder."""
    at, files = _file_system(spark, folder)
    found, listed = [], files.listFiles(at, True)
    while listed.hasNext():
        f = listed.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()


_STAGES: dict[tuple[str, str, str], DataFrame] = {}


def stage(spark: SparkSession, name: str, folder: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A build stage over the tables of ``folder``: written on first use in an application, then reused by its later
    stages for as long as the files stay as they are.
    """
    key = (spark.sparkContext.applicationId, f"{name}:{folder}", identity(spark, folder))
    if key not in _STAGES:
        _STAGES[key] = store(build(), name)
    return _STAGES[key]


def run_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per output table, in one job."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("output_table"), "rows") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None, decimals: int = 6) -> DataFrame:
    """Order-insensitive content fingerprint: the row count and, for each 64 bits of the rows' SHA-256, their sum.

    Every column counts unless some are named. A field is written as its length and its text, so fields cannot run
    into each other; NULL is a single N. Fractional numbers are written with ``decimals`` places.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    for c in columns or df.columns:
        column = F.col(f"`{c}`")
        text = (column.cast(f"decimal(38,{decimals})") if isinstance(fields[c], T.FractionalType) else column).cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("N")))
    digest = F.sha2(F.concat(*parts), 256)
    sums = [F.sum(F.conv(F.substring(digest, 16 * i + 1, 16), 16, 10).cast("decimal(28,0)")).cast("string") for i in range(4)]
    return df.agg(F.count(F.lit(1)).alias("rows"), F.concat_ws("-", *sums).alias("fingerprint"))
