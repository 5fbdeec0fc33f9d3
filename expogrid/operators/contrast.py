"""Gaps between groups, changes over bands, grids and evidence counts.

A gap needs the values of several groups side by side. They are brought together by one
conditional aggregate over the result rows, never by a self-join, so the tables behind
them are evaluated once.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import COARSE_EDGES, COARSE_LABELS, band, band_label, minus, unpivot, weighted_mean
from ..functions.model import GroupScheme, Indicator
from .exposure import EQUAL_UNIT, described


def beside(rows: DataFrame, keys: Sequence[str], scheme: GroupScheme, values: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """One row per key: ``{value}__{group}`` per group, ``here__{group}``, and carried columns."""
    code = F.col("group_code")
    cells = []
    for g in scheme.groups:
        cells.append(F.coalesce(F.max(F.when(code == g.code, F.lit(True))), F.lit(False)).alias(f"here__{g.code}"))
        cells += [F.max(F.when(code == g.code, F.col(v))).alias(f"{v}__{g.code}") for v in values]
    return rows.groupBy(*keys).agg(*cells, *[F.max(c).alias(c) for c in carry])


def _directed(gap: Column) -> Column:
    return F.when(F.col("direction") == "higher_better", -gap).otherwise(gap)


META = ("indicator_level", "domain", "indicator_label", "direction", "unit")


def baseline_gaps(exposure: DataFrame, scheme: GroupScheme, by: Sequence[str] = (), directed: bool = True) -> DataFrame:
    """Focal minus baseline per indicator; sign-flipped where higher is better when ``directed``."""
    keys = [*by, "indicator_code"]
    wide = beside(exposure, keys, scheme, ["raw_value", "display_value"], META)
    f = scheme.focal.code
    records = []
    for b in scheme.baselines:
        gap = [F.col(f"{v}__{f}") - F.col(f"{v}__{b.code}") for v in ("raw_value", "display_value")]
        if directed:
            gap = [_directed(g) for g in gap]
        records.append({
            "__here": F.col(f"here__{f}") & F.col(f"here__{b.code}"),
            "baseline_code": F.lit(b.code), "baseline_label": F.lit(b.label),
            "focal_value": F.col(f"raw_value__{f}"), "baseline_value": F.col(f"raw_value__{b.code}"),
            "gap_raw": gap[0], "gap_display": gap[1],
        })
    return wide.select(*unpivot([*keys, *META], records)).filter("__here").drop("__here")


def pairwise_gaps(exposure: DataFrame, scheme: GroupScheme, by: Sequence[str] = ()) -> DataFrame:
    """Every ordered-once pair of groups, left minus right, no sign flip."""
    keys = [*by, "indicator_code"]
    carry = [m for m in META if m != "direction"]
    wide = beside(exposure, keys, scheme, ["raw_value", "display_value"], carry)
    records = [
        {
            "__here": F.col(f"here__{a.code}") & F.col(f"here__{b.code}"),
            "left_group": F.lit(a.code), "right_group": F.lit(b.code),
            "left_value": F.col(f"raw_value__{a.code}"), "right_value": F.col(f"raw_value__{b.code}"),
            "difference_raw": minus(f"raw_value__{a.code}", f"raw_value__{b.code}"),
            "difference_display": minus(f"display_value__{a.code}", f"display_value__{b.code}"),
        }
        for a, b in combinations(scheme.groups, 2)
    ]
    return wide.select(*unpivot([*keys, *carry], records)).filter("__here").drop("__here")


def band_change(gradient: DataFrame, by: Sequence[str], group_code: str, estimand: str, low: int = 1, high: int = 8) -> DataFrame:
    """Top-band minus low-band display value of one group."""
    order = F.col("band_order")
    ends = gradient.filter((F.col("group_code") == group_code) & (F.col("estimand") == estimand)).groupBy(*by, "indicator_code").agg(
        F.max(F.when(order == low, F.col("display_value"))).alias("low_value"),
        F.max(F.when(order == high, F.col("display_value"))).alias("high_value"),
    )
    return ends.withColumn("change", minus("high_value", "low_value"))


def interaction_grid(units: DataFrame, indicators: Sequence[Indicator], scheme: GroupScheme) -> DataFrame:
    """Coarse focal band by coarse baseline band, for each baseline, from one scan of the units."""
    f = scheme.focal
    codes = [i.code for i in indicators]
    spread = units.select(*unpivot(
        [F.col(scheme.column(f)).alias("__w"), band(scheme.share(f), COARSE_EDGES).alias("focal_band_order"), *codes],
        [{"baseline_code": F.lit(b.code), "baseline_band_order": band(scheme.share(b), COARSE_EDGES)} for b in scheme.baselines],
    ))
    aggs = [F.count(F.lit(1)).alias("units"), F.sum("__w").alias("focal_members")]
    for i in indicators:
        aggs += [F.avg(F.col(i.code).cast("double")).alias(f"u__{i.code}"), weighted_mean(i.code, "__w", "all").alias(f"w__{i.code}")]
    keys = ["baseline_code", "focal_band_order", "baseline_band_order"]
    wide = spread.groupBy(*keys).agg(*aggs)
    labels = [band_label(k, COARSE_LABELS).alias(k.removesuffix("_order")) for k in keys[1:]]
    return wide.select(*unpivot([*keys, *labels, "units", "focal_members"], [
        described(i, F.col(f"{tag}__{i.code}"), estimand=F.lit(name))
        for i in indicators for tag, name in (("u", EQUAL_UNIT), ("w", "focal-weighted mean"))
    ]))


# The wording of the four evidence classes, by number of adverse findings.
EVIDENCE = (
    "no adverse pattern in these tests", "one-layer signal", "two-layer pattern", "three-layer consistent pattern",
)


def evidence_profile(gaps: DataFrame, slopes: DataFrame, baseline: str) -> DataFrame:
    """Count, per outcome, three adverse findings: raw gap, within-region and within-subregion slope."""
    adverse = F.when(F.col("direction") == "higher_worse", F.col("slope_per_10pp") > 0).otherwise(F.col("slope_per_10pp") < 0)
    within = slopes.groupBy("indicator_code").agg(*[
        F.coalesce(F.max(F.when(F.col("level") == level, adverse)), F.lit(False)).alias(f"within_{level}_adverse")
        for level in ("region", "subregion")
    ])
    raw = gaps.filter(F.col("baseline_code") == baseline).select(
        "indicator_code", F.coalesce(F.col("gap_display") > 0, F.lit(False)).alias("worse_than_baseline")
    )
    joined = within.join(raw, "indicator_code", "left").withColumn(
        "worse_than_baseline", F.coalesce("worse_than_baseline", F.lit(False))
    )
    met = sum((F.col(c).cast("int") for c in ("within_region_adverse", "within_subregion_adverse")), F.col("worse_than_baseline").cast("int"))
    return joined.withColumn("findings", met).withColumn(
        "evidence", F.element_at(F.array(*[F.lit(e) for e in EVIDENCE]), F.col("findings") + 1)
    )
