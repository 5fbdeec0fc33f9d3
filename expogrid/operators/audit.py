"""Audits of keys, joins, items, codes and numeric columns."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio, unpivot
from .keys import unit_rows
from .ranking import quantiles


def unit_master(first: DataFrame, others: Sequence[DataFrame], key: str) -> DataFrame:
    """LEFT join every other unit table on the key. Columns already present are not repeated."""
    out = first
    taken = set(first.columns) - {key}
    for other in others:
        fresh = [c for c in other.columns if c not in taken]
        out = out.join(unit_rows(other.select(*fresh)), key, "left")
        taken |= set(fresh) - {key}
    return out


def require_unique(df: DataFrame, key: str, table: str = "table") -> DataFrame:
    """Fail the job if a key repeats; without this, a join would fan out silently."""
    repeats = df.groupBy(key).count().filter((F.col("count") > 1) & F.col(key).isNotNull()).limit(1).count()
    if repeats:
        raise ValueError(f"{table}: {key} is not unique")
    return df


def source_counts(tables: dict[str, DataFrame], key: str | dict[str, str]) -> DataFrame:
    """Rows and distinct keys per table. The key may have a different name in each table."""
    parts = []
    for name, df in tables.items():
        k = key if isinstance(key, str) else key[name]
        # Two-level count: rows per key are summed on the map side first.
        per_key = df.groupBy(k).agg(F.count(F.lit(1)).alias("n"))
        parts.append(per_key.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.count(k).alias("unit_count")
        ).select(F.lit(name).alias("source_table"), "row_count", "unit_count"))
    return reduce(DataFrame.unionByName, parts)


def join_coverage(first: DataFrame, others: dict[str, DataFrame], key: str) -> DataFrame:
    """Per unit of ``first``, whether each other table has it.

    The key columns are stacked with a source bit and grouped once, which takes one
    shuffle for any number of tables instead of one join each. Repeated keys fold on the
    map side.
    """
    stacked = reduce(DataFrame.unionByName, [
        df.filter(F.col(key).isNotNull()).select(key, F.lit(1 << i).cast("long").alias("bit"))
        for i, df in enumerate([first, *others.values()])
    ])
    seen = stacked.groupBy(key).agg(F.bit_or("bit").alias("bits")).filter(F.col("bits").bitwiseAND(F.lit(1)) == 1)
    return seen.select(key, *[
        (F.col("bits").bitwiseAND(F.lit(1 << i)) != 0).alias(f"has_{name}") for i, name in enumerate(others, start=1)
    ])


def coverage_summary(coverage: DataFrame, mismatch: tuple[str, str] | None = None) -> DataFrame:
    """Totals and missing counts per flag; ``mismatch`` counts units in exactly one of two tables."""
    flags = [c for c in coverage.columns if c.startswith("has_")]
    out = [F.count(F.lit(1)).alias("units")]
    for f in flags:
        out += [F.count(F.when(F.col(f), 1)).alias(f"with_{f[4:]}"), F.count(F.when(~F.col(f), 1)).alias(f"without_{f[4:]}")]
    if mismatch:
        a, b = (F.col(f"has_{m}") for m in mismatch)
        out.append(F.count(F.when(a != b, 1)).alias("presence_mismatch"))
    return coverage.agg(*out)


def missing_units(coverage: DataFrame, tables: Sequence[str]) -> DataFrame:
    """Units absent from at least one of the tables."""
    return coverage.filter(reduce(lambda a, b: a | b, [~F.col(f"has_{t}") for t in tables]))


def item_combinations(df: DataFrame, key: str, items: Sequence[str], source: str | None = None) -> DataFrame:
    """Rows and distinct keys per item combination, distinct keys folded before the final count."""
    per_key = df.groupBy(*items, key).agg(F.count(F.lit(1)).alias("n"))
    out = per_key.groupBy(*items).agg(F.sum("n").alias("row_count"), F.count(key).alias("unit_count"))
    return out if source is None else out.select(F.lit(source).alias("source_table"), *out.columns)


def key_profile(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct and repeated keys and the spread of rows per key; a blank key counts as missing."""
    blank = F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "")
    per_key = df.groupBy(F.when(~blank, F.col(key)).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    spread = per_key.groupBy(F.col("k").isNull().alias("blank"), "n").agg(F.count(F.lit(1)).alias("keys"))
    n, keys, ok = F.col("n"), F.col("keys"), ~F.col("blank")
    base = spread.agg(
        F.coalesce(F.sum(n * keys), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.when(ok, keys)), F.lit(0)).alias("unique_keys"),
        F.coalesce(F.sum(F.when(ok, n * keys)), F.lit(0)).alias("rows_with_key"),
        F.coalesce(F.sum(F.when(ok & (n > 1), keys)), F.lit(0)).alias("keys_with_multiple_rows"),
        F.min(F.when(ok, n)).alias("min_rows_per_key"),
        F.max(F.when(ok, n)).alias("max_rows_per_key"),
    ).withColumns({
        "mean_rows_per_key": ratio("rows_with_key", "unique_keys"),
        "missing_key_rows": F.col("row_count") - F.col("rows_with_key"),
    })
    middle = quantiles(per_key.filter(F.col("k").isNotNull()), [], "n", {"median_rows_per_key": 0.5})
    return base.withColumn("median_rows_per_key", middle.select("median_rows_per_key").scalar())


SPOTS = {"p10": 0.1, "median": 0.5, "p90": 0.9}


def numeric_summary(tables: dict[str, tuple[DataFrame, Sequence[str]]], buckets: int = 256, rank_error: float | None = None) -> DataFrame:
    """Rows, missing, min, p10, median, mean, p90 and max for columns of several tables.

    Per table, one wide aggregate gives the moments. The exact quantiles of all columns
    come from one distributed ranking of (column, value) counts. With ``rank_error``, they come from quantile sketches
    in the same aggregate instead: mergeable, of a size that does not depend on the rows, and
    each a value of the column whose rank is off by at most that share of all rows. Nothing but sketches is shuffled then.
    """
    parts = []
    for table, (df, columns) in tables.items():
        if rank_error is not None:
            parts.append(_sketched_summary(df, table, columns, rank_error))
            continue
        sums = df.agg(F.count(F.lit(1)).alias("rows"), *[
            f(F.col(c).cast("double")).alias(f"{tag}__{c}")
            for c in columns for tag, f in (("n", F.count), ("min", F.min), ("mean", F.avg), ("max", F.max))
        ])
        moments = sums.select(F.inline(F.array(*[
            F.struct(
                F.lit(table).alias("source_table"), F.lit(c).alias("column_name"), F.col("rows"), F.col(f"n__{c}").alias("nonmissing"),
                (F.col("rows") - F.col(f"n__{c}")).alias("missing"), F.col(f"min__{c}").alias("minimum"),
                F.col(f"mean__{c}").alias("mean"), F.col(f"max__{c}").alias("maximum"),
            ) for c in columns
        ])))
        long = df.select(*unpivot([], [{"column_name": F.lit(c), "value": F.col(c).cast("double")} for c in columns]))
        spots = quantiles(long, ["column_name"], "value", SPOTS, buckets)
        parts.append(moments.join(spots, "column_name", "left"))
    return reduce(DataFrame.unionByName, parts).select(
        "source_table", "column_name", "rows", "nonmissing", "missing", "minimum", "p10", "median", "mean", "p90", "maximum"
    )


def _sketched_summary(df: DataFrame, table: str, columns: Sequence[str], rank_error: float) -> DataFrame:
    x = {c: F.col(c).cast("double") for c in columns}
    spots = F.array(*[F.lit(p) for p in SPOTS.values()])
    sums = df.agg(F.count(F.lit(1)).alias("rows"), *[
        v.alias(f"{tag}__{c}") for c in columns
        for tag, v in (("n", F.count(x[c])), ("min", F.min(x[c])), ("mean", F.avg(x[c])), ("max", F.max(x[c])), ("q", F.percentile_approx(x[c], spots, math.ceil(1 / rank_error))))
    ])
    return sums.select(F.inline(F.array(*[
        F.struct(
            F.lit(c).alias("column_name"), F.lit(table).alias("source_table"), F.col("rows"), F.col(f"n__{c}").alias("nonmissing"), (F.col("rows") - F.col(f"n__{c}")).alias("missing"),
            F.col(f"min__{c}").alias("minimum"), F.col(f"mean__{c}").alias("mean"), F.col(f"max__{c}").alias("maximum"), *[F.col(f"q__{c}")[i].alias(name) for i, name in enumerate(SPOTS)],
        ) for c in columns
    ]))).select("column_name", "source_table", "rows", "nonmissing", "missing", "minimum", "mean", "maximum", *SPOTS)


def raw_code_audit(
    table: DataFrame, composition: DataFrame, key: str, columns: dict[str, str], counts: Sequence[str], focal: str, total: str, source: str
) -> DataFrame:
    """Units and group counts per raw code of several coded columns.

    ``columns`` maps a column to its description. The table is joined to the composition
    once and unpivoted, so all columns share one aggregate.
    """
    joined = table.select(key, *columns).join(unit_rows(composition.select(key, *counts)), key, "left")
    long = joined.select(*unpivot(counts, [
        {"column_name": F.lit(c), "description": F.lit(text), "raw_code": F.col(c).cast("string")} for c, text in columns.items()
    ]))
    return long.groupBy("column_name", "description", "raw_code").agg(
        F.count(F.lit(1)).alias("units"), *[F.sum(c).alias(c) for c in counts]
    ).withColumns({
        "focal_share_percent": ratio(focal, total, 100),
        "source_table": F.lit(source),
        "interpretation_status": F.lit("raw code only; code book required"),
    })
