"""Joins on keys that may be NULL."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Units whose wide rows one task joins and sorts.
UNITS_PER_TASK = 10_000


def by_unit(df: DataFrame, units: int, key: str) -> DataFrame:
    """Rows dealt by the unit key to as many tasks as the number of units asks for.

    A size in compressed bytes, by which adaptive execution would choose, says little about wide rows of small codes.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-units // UNITS_PER_TASK)), key)


def unit_rows(df: DataFrame) -> DataFrame:
    """A side of a join that has a row per unit: merged, never broadcast, however small its files are."""
    return df.hint("merge")


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys meet each other, as they do in a GROUP BY.

    The keys of the left side are kept. No broadcast hint: adaptive execution picks the
    strategy from measured sizes.
    """
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys], *[F.col(c) for c in right.columns if c not in keys]
    )
    condition = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])
