"""Exact ranks and quantiles without sorting a whole group in one task.

Rows are first counted by (keys, value), which folds ties on the map side. The distinct
values are then cut into buckets at global split points, so no window sees more than
about 1/buckets of all distinct values even if one key holds most rows. Running counts
inside a bucket plus the count of the earlier buckets give exact positions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .keys import join_on


def ordered_counts(df: DataFrame, keys: Sequence[str], value: str, buckets: int = 256) -> DataFrame:
    """One row per (keys, value): ``__n``, rows ``__before`` it in value order, ``__total`` rows of the key.

    NULL values come last and count in ``__total``.
    """
    keys = list(keys)
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    cuts = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    # Reading __n here keeps both uses of `counts` identical, so they share one shuffle.
    edges = counts.agg(
        F.percentile_approx(F.when(F.col("__n") > 0, F.col(value).cast("double")), cuts, 20 * buckets).alias("fine")
    )
    step = max(2, int(buckets**0.5))
    splits = edges.select(
        F.struct("fine", F.filter("fine", lambda _, i: (i + 1) % step == 0).alias("coarse")).alias("s")
    ).scalar()
    # Number of edges below the value, found in two short looks instead of one long one.
    x = F.col(value).cast("double")
    below = lambda edge: edge < x
    parts = counts.withColumn("__s", splits).withColumn(
        "__c", F.coalesce(F.size(F.filter("__s.coarse", below)), F.lit(0)) * step
    ).withColumn(
        "__bucket",
        F.when(F.col(value).isNull(), F.lit(buckets + 1)).otherwise(
            F.col("__c") + F.coalesce(F.size(F.filter(F.slice("__s.fine", F.col("__c") + 1, F.lit(step - 1)), below)), F.lit(0))
        ),
    ).drop("__s", "__c")
    inside = Window.partitionBy(*keys, "__bucket").orderBy(F.col(value).asc_nulls_last())
    local = parts.withColumn(
        "__local", F.sum("__n").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n")
    )
    # At most `buckets` + 2 rows per key from here on.
    sizes = parts.groupBy(*keys, "__bucket").agg(F.sum("__n").alias("__size"))
    across = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    offsets = sizes.select(
        *keys, "__bucket",
        F.coalesce(
            F.sum("__size").over(across.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("__offset"),
        F.sum("__size").over(across).alias("__total"),
    )
    return join_on(local, offsets, [*keys, "__bucket"]).select(
        *keys, value, "__n", (F.col("__offset") + F.col("__local")).alias("__before"), "__total"
    )


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float], buckets: int = 256
) -> DataFrame:
    """Exact interpolated quantiles per key, one column per entry of ``probabilities``."""
    keys = list(keys)
    placed = ordered_counts(df.filter(F.col(value).isNotNull()).select(*keys, value), keys, value, buckets)
    found, out = [], []
    x = F.col(value).cast("double")
    for name, p in probabilities.items():
        spot = F.lit(float(p)) * (F.col("__total") - 1)
        for side, rank in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            here = (F.col("__before") <= rank) & (rank < F.col("__before") + F.col("__n"))
            found.append(F.max(F.when(here, x)).alias(f"__{name}_{side}"))
        last = F.lit(float(p)) * (F.col("__total") - 1)
        lo, hi = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        out.append((lo + (hi - lo) * (last - F.floor(last))).alias(name))
    return placed.groupBy(*keys).agg(*found, F.max("__total").alias("__total")).select(*keys, *out)


def percent_ranks(
    df: DataFrame, unit: str, region: str, columns: dict[str, str], buckets: int = 256
) -> DataFrame:
    """Percent rank of several columns inside a region, one narrow row per unit.

    ``columns`` maps source column to output name. A NULL value gets no rank but counts
    in the region's size. Only the key, region and values travel; the caller joins the
    result to the wide rows once, on the unit key. Ties of a common value meet one row
    of the rank table, so a large tie is split by adaptive skew joins.
    """
    long = df.select(
        F.col(unit), F.col(region),
        F.inline(F.array(*[
            F.struct(F.lit(c).alias("__which"), F.col(c).cast("double").alias("__value")) for c in columns
        ])),
    )
    placed = ordered_counts(long, ["__which", region], "__value", buckets).filter(F.col("__value").isNotNull())
    ranked = placed.select(
        "__which", region, "__value",
        F.when(F.col("__total") <= 1, F.lit(0.0)).otherwise(F.try_divide(F.col("__before"), F.col("__total") - 1)).alias("__rank"),
    )
    matched = join_on(long.filter(F.col("__value").isNotNull()), ranked, ["__which", region, "__value"])
    return matched.groupBy(unit).agg(
        *[F.max(F.when(F.col("__which") == c, F.col("__rank"))).alias(name) for c, name in columns.items()]
    )
