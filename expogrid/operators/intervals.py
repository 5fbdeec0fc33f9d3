"""Intervals for exposures and their ratios: linearised by cluster, and a cluster bootstrap without resampling rows.

Everything starts from totals by cluster, group and indicator, which one aggregate makes. A bootstrap replicate weighs
each cluster by a Poisson number that a hash of the cluster and the replicate gives, so replicates are sums that merge in any order,
every task draws the same weights, and a rerun after a lost executor repeats them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import unpivot
from ..functions.model import GroupScheme, Indicator
from .distributions import student_quantile
from .exposure import weight_column
from .keys import join_on
from .models import Fit, Regressor

#: P(X <= k) for a Poisson variable of mean 1; larger numbers than 13 have a chance below 1e-11.
POISSON = tuple(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(13))


def poisson_weight(key: Column, replicate: Column, seed: str = "") -> Column:
    """A Poisson number of mean 1, from 52 bits of the MD5 of key, replicate and seed."""
    text = F.concat_ws("|", key, replicate.cast("string"), F.lit(seed))
    u = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(2.0**52)
    return sum(((u >= F.lit(p)).cast("int") for p in POISSON[1:]), (u >= F.lit(POISSON[0])).cast("int"))


def cluster_totals(grouped: DataFrame, indicators: Sequence[Indicator], scheme: GroupScheme, clusters: Sequence[str]) -> DataFrame:
    """One row per cluster, group and indicator: ``num`` and ``den`` of the weighted mean over units with a value."""
    sums = []
    for i in indicators:
        w, y = F.col(weight_column(i, scheme)).cast("double"), F.col(i.code).cast("double")
        sums += [F.sum(w * y).alias(f"{i.code}__num"), F.sum(F.when(y.isNotNull(), w)).alias(f"{i.code}__den")]
    wide = grouped.groupBy(*clusters, "group_code").agg(*sums)
    return wide.select(*unpivot([*clusters, "group_code"], [
        {"indicator_code": F.lit(i.code), "num": F.col(f"{i.code}__num"), "den": F.col(f"{i.code}__den")} for i in indicators
    ])).filter("den > 0")


def t_limit(clusters: Column, counts: Sequence[int], level: float = 0.95) -> Column:
    """The t quantile for a column of cluster counts; NULL for one cluster. ``counts`` are those that occur."""
    pairs = [F.lit(v) for n in sorted(set(counts)) if n > 1 for v in (int(n), student_quantile(0.5 + level / 2, n - 1))]
    return F.element_at(F.create_map(*pairs), clusters.cast("int")) if pairs else F.lit(None).cast("double")


def exposure_intervals(totals: DataFrame, clusters: Sequence[str], baseline: str, replicates: int = 200, level: float = 0.95, seed: str = "") -> DataFrame:
    """One row per group and indicator: exposure with linearised t limits and bootstrap limits, and its ratio to the
    baseline group's with limits by the delta method on the log scale.

    ``totals`` comes from ``cluster_totals``; store it where it is costly, as it is read several times. Limits are NULL
    with one cluster, ratios where either exposure is not positive. What reaches the driver is the distinct counts of clusters.
    """
    by = ["group_code", "indicator_code"]
    whole = totals.groupBy(*by).agg(F.sum("num").alias("all_num"), F.sum("den").alias("all_den"), F.count(F.lit(1)).alias("clusters"))
    counts = [r[0] for r in whole.select("clusters").distinct().collect()]
    met = join_on(totals, whole, by)
    z = (F.col("num") - F.col("all_num") / F.col("all_den") * F.col("den")) / F.col("all_den")
    scores = met.select(*clusters, *by, "all_num", "all_den", "clusters", z.alias("z"))
    factor = F.col("clusters") / F.nullif(F.col("clusters") - 1, F.lit(0))
    points = scores.groupBy(*by).agg(
        F.max("clusters").alias("clusters"), (F.max("all_num") / F.max("all_den")).alias("exposure"), F.sum(F.col("z") * F.col("z")).alias("squares"),
    ).withColumn("standard_error", F.sqrt(F.col("squares") * factor)).drop("squares")

    # Log ratio: the score of a cluster is z / exposure, less that of the baseline in the same cluster.
    relative = scores.withColumn("score", F.try_divide(F.col("z") * F.col("all_den"), F.col("all_num")))
    base = relative.filter(F.col("group_code") == baseline).select(*clusters, "indicator_code", F.col("score").alias("base_score"))
    # A cluster may hold only one of the two groups: both are laid side by side by union, not by an inner join.
    codes = whole.select("group_code", "indicator_code")
    spread = base.join(codes, "indicator_code").select(*clusters, *by, (-F.col("base_score")).alias("score")).unionByName(relative.select(*clusters, *by, "score"))
    square = spread.groupBy(*clusters, *by).agg(F.sum("score").alias("score")).groupBy(*by).agg(
        F.sum(F.col("score") * F.col("score")).alias("log_squares"), F.count(F.lit(1)).alias("pair_clusters")
    )
    counts += [r[0] for r in square.select("pair_clusters").distinct().collect()]
    log_error = F.sqrt(F.col("log_squares") * F.col("pair_clusters") / F.nullif(F.col("pair_clusters") - 1, F.lit(0)))
    ratios = square.select(*by, log_error.alias("log_error"), "pair_clusters")

    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in clusters])
    drawn = totals.select(*by, "num", "den", key.alias("key"), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("b"))
    drawn = drawn.withColumn("w", poisson_weight(F.col("key"), F.col("b"), seed)).groupBy(*by, "b").agg(
        F.try_divide(F.sum(F.col("w") * F.col("num")), F.sum(F.col("w") * F.col("den"))).alias("value")
    )
    tail = (1 - level) / 2
    boot = drawn.groupBy(*by).agg(F.percentile("value", F.lit(tail)).alias("boot_low"), F.percentile("value", F.lit(1 - tail)).alias("boot_high"), F.stddev_samp("value").alias("boot_error"))

    other = points.filter(F.col("group_code") == baseline).select("indicator_code", F.col("exposure").alias("base_exposure"))
    out = points.join(boot, by).join(ratios, by).join(other, "indicator_code", "left")
    t, pair_t = t_limit(F.col("clusters"), counts, level), t_limit(F.col("pair_clusters"), counts, level)
    usable = (F.col("group_code") != baseline) & (F.col("exposure") > 0) & (F.col("base_exposure") > 0)
    ratio = F.when(usable, F.col("exposure") / F.col("base_exposure"))
    return out.select(
        *by, "clusters", "exposure", "standard_error", (F.col("exposure") - t * F.col("standard_error")).alias("low"), (F.col("exposure") + t * F.col("standard_error")).alias("high"),
        "boot_low", "boot_high", "boot_error", ratio.alias("ratio"),
        (ratio * F.exp(-pair_t * F.col("log_error"))).alias("ratio_low"), (ratio * F.exp(pair_t * F.col("log_error"))).alias("ratio_high"),
    )


INTERVALS = "fixed_effect string, outcome_code string, regressor string, coefficient double, standard_error double, low double, high double, observations long, clusters long"


def coefficient_intervals(spark, fits: Sequence[Fit], regressors: Sequence[Regressor], level: float = 0.95) -> DataFrame:
    """One row per fit and regressor with limits from the clustered error and the t distribution of clusters - 1 degrees."""
    rows = []
    for f in fits:
        t = student_quantile(0.5 + level / 2, f.clusters - 1) if f.errors is not None and f.clusters > 1 else None
        for at, r in enumerate(regressors):
            b, se = float(f.coefficients[at]), None if f.errors is None else float(f.errors[at])
            low, high = (None, None) if t is None else (b - t * se, b + t * se)
            rows.append((f"{f.level} fixed effects", f.outcome, r.name, b, se, low, high, f.observations, f.clusters))
    return spark.createDataFrame(rows, INTERVALS)
