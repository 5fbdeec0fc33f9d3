"""Group totals, distributions and weighted exposures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import BAND_LABELS, band_label, ratio, unpivot, weighted_mean
from ..functions.model import GroupScheme, Indicator
from .keys import join_on
from .ranking import quantiles

EQUAL_UNIT = "equal-unit mean"
GROUP_WEIGHTED = "group-weighted mean"


def weight_column(indicator: Indicator, scheme: GroupScheme) -> str:
    return f"group_{indicator.weight if indicator.weight in scheme.measures else scheme.main}"


def described(i: Indicator, value: Column, **extra: Column) -> dict[str, Column]:
    """One record of a melted result: metadata as literals next to the value, so no metadata join."""
    return {
        **extra,
        "indicator_code": F.lit(i.code),
        "indicator_level": F.lit(i.level),
        "domain": F.lit(i.domain),
        "indicator_label": F.lit(i.label),
        "kind": F.lit(i.kind),
        "direction": F.lit(i.direction),
        "raw_value": value,
        "display_value": value * F.lit(i.multiplier),
        "unit": F.lit(i.unit),
    }


def group_totals(grouped: DataFrame, scheme: GroupScheme) -> DataFrame:
    main = f"group_{scheme.main}"
    return grouped.groupBy("group_code", "group_label").agg(
        *[F.sum(f"group_{m}").alias(m) for m in scheme.measures],
        F.sum(scheme.total()).alias("repeated_total"),
        ratio(F.sum(main), F.sum(scheme.total()), 100).alias("share_percent"),
        F.count(F.when(F.col(main) > 0, 1)).alias("units_with_group"),
        F.count(F.lit(1)).alias("units"),
    )


def stage_representation(
    units: DataFrame, scheme: GroupScheme, stages: Sequence[tuple[str, str]], by: Sequence[str] = ()
) -> DataFrame:
    """Per stage, each group's count and its percent of the baseline total.

    ``stages`` pairs a column suffix with a label; the count of group g in a stage is
    column ``{g}_{suffix}``. One aggregate over all stages, then an unpivot.
    """
    names = [f"{g.prefix}_{s}" for g in scheme.groups for s, _ in stages]
    sums = units.groupBy(*by).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    records = []
    for order, (suffix, label) in enumerate(stages):
        whole = sum((F.col(f"{g.prefix}_{suffix}") for g in scheme.baselines[1:]), F.col(f"{scheme.baselines[0].prefix}_{suffix}"))
        for g in scheme.groups:
            count = F.col(f"{g.prefix}_{suffix}")
            records.append({
                "stage_order": F.lit(order), "stage": F.lit(label),
                "group_code": F.lit(g.code), "group_label": F.lit(g.label),
                "members": count, "share_percent": ratio(count, whole, 100),
            })
    return sums.select(*unpivot(by, records))


def concentration_distribution(grouped: DataFrame, scheme: GroupScheme, by: Sequence[str] = ()) -> DataFrame:
    """Units and group members by band, with percents of the group's whole."""
    main = f"group_{scheme.main}"
    counts = grouped.groupBy(*by, "group_code", "group_label", "band_order").agg(
        F.count(F.lit(1)).alias("units"), F.sum(main).alias("group_members"), F.sum(scheme.total()).alias("total_members")
    )
    whole = Window.partitionBy(*by, "group_code")  # at most one row per band
    return counts.select(
        *by, "group_code", "group_label", "band_order", band_label("band_order").alias("band"),
        "units", "group_members", "total_members",
        ratio("units", F.sum("units").over(whole), 100).alias("unit_share_percent"),
        ratio("group_members", F.sum("group_members").over(whole), 100).alias("member_share_percent"),
    )


def group_exposure(
    grouped: DataFrame, indicators: Sequence[Indicator], scheme: GroupScheme, by: Sequence[str] = (),
    weight: str | None = None, denominator: str = "observed", positive_only: bool = True,
) -> DataFrame:
    """Weighted mean of every indicator per group, melted to one row per indicator.

    Each indicator brings its own weight unless ``weight`` (a measure name) is forced.
    Rows without members in the weighting measure are left out, as they add nothing.
    """
    forced = f"group_{weight}" if weight else None
    rows = grouped.filter(F.col(forced or f"group_{scheme.main}") > 0) if positive_only else grouped
    fields = [*by, "group_code", "group_label"]
    sums = [F.sum(f"group_{m}").alias(f"group_{m}") for m in (scheme.main, scheme.measures[-1])]
    if forced:
        sums = [F.sum(forced).alias("weight_members")]
    wide = rows.groupBy(*fields).agg(
        *sums, *[weighted_mean(i.code, forced or weight_column(i, scheme), denominator).alias(i.code) for i in indicators]
    )
    kept = [c for c in wide.columns if c not in {i.code for i in indicators}]
    return wide.select(*unpivot(kept, [described(i, F.col(i.code)) for i in indicators]))


def sex_exposure(grouped: DataFrame, indicators: Sequence[Indicator], scheme: GroupScheme) -> DataFrame:
    """The same indicators weighted by each sex in turn, whatever their own weight, from one aggregate.

    A group without members of a sex has no rows for it.
    """
    sexes = scheme.measures[1:]
    fields = ["group_code", "group_label"]
    wide = grouped.groupBy(*fields).agg(
        *[F.sum(f"group_{m}").alias(f"{m}__members") for m in sexes],
        *[weighted_mean(i.code, f"group_{m}", "observed").alias(f"{m}__{i.code}") for m in sexes for i in indicators],
    )
    records = [
        {"weight_members": F.col(f"{m}__members"), **described(i, F.col(f"{m}__{i.code}")), "sex": F.lit(m)} for m in sexes for i in indicators
    ]
    return wide.select(*unpivot(fields, records)).filter("weight_members > 0")


def concentration_gradient(
    grouped: DataFrame, indicators: Sequence[Indicator], scheme: GroupScheme, by: Sequence[str] = ()
) -> DataFrame:
    """Equal-unit and group-weighted mean of every indicator per group and band.

    Both estimands of all indicators come from one aggregate.
    """
    fields = [*by, "group_code", "group_label", "band_order"]
    aggs = [F.count(F.lit(1)).alias("units"), F.sum(f"group_{scheme.main}").alias("group_members")]
    for i in indicators:
        aggs += [
            F.avg(F.col(i.code).cast("double")).alias(f"u__{i.code}"),
            weighted_mean(i.code, weight_column(i, scheme)).alias(f"w__{i.code}"),
        ]
    wide = grouped.filter(F.col("group_share").isNotNull()).groupBy(*fields).agg(*aggs)
    records = [
        described(i, F.col(f"{tag}__{i.code}"), estimand=F.lit(name))
        for i in indicators for tag, name in (("u", EQUAL_UNIT), ("w", GROUP_WEIGHTED))
    ]
    return wide.select(*unpivot([*fields, band_label("band_order").alias("band"), "units", "group_members"], records))


def condition_gradient(
    grouped: DataFrame, scheme: GroupScheme, percents: Sequence[str] = (), means: Sequence[str] = (), medians: Sequence[str] = (),
    ratios: dict[str, tuple[str, str, float]] | None = None, by: Sequence[str] = (),
) -> DataFrame:
    """Wide table per group and band: percents of flags, means, exact medians and ratios of sums.

    ``ratios`` maps a name to (numerator, denominator, scale). Medians come from the
    distributed ranking and join as one small row per group and band.
    """
    keys = [*by, "group_code", "group_label", "band_order"]
    out = grouped.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("units"), F.sum(f"group_{scheme.main}").alias("group_members"),
        *[(F.avg(F.col(c).cast("double")) * 100).alias(f"{c}_percent") for c in percents],
        *[F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in means],
        *[ratio(F.sum(a), F.sum(b), scale).alias(name) for name, (a, b, scale) in (ratios or {}).items()],
    )
    for c in medians:
        out = join_on(out, quantiles(grouped, keys, c, {f"median_{c}": 0.5}), keys, "left")
    return out.withColumn("band", band_label("band_order"))


def focal_profile(
    units: DataFrame, indicators: Sequence[Indicator], scheme: GroupScheme, by: Sequence[str]
) -> DataFrame:
    """One wide row per area: counts, focal share and focal-weighted indicators.

    The weighted denominator is the focal count of all rows of the area.
    """
    f, whole = F.col(scheme.column(scheme.focal)), F.col(scheme.total())
    return units.groupBy(*by).agg(
        F.count(F.lit(1)).alias("units"),
        F.sum(whole).alias("total_members"),
        F.sum(f).alias("focal_members"),
        ratio(F.sum(f), F.sum(whole), 100).alias("focal_share_percent"),
        F.count(F.when(f > 0, 1)).alias("units_with_focal"),
        *[(weighted_mean(i.code, f, "all") * F.lit(i.multiplier)).alias(i.code) for i in indicators],
    )


def region_profile(
    units: DataFrame, grouped: DataFrame, stage_units: DataFrame, scheme: GroupScheme, region: str,
    stages: Sequence[tuple[str, str]], indicators: Sequence[Indicator],
) -> DataFrame:
    """One row per region: focal stage shares and their change, majority shares, focal exposures.

    Majority and super-majority are the two top bands; their member shares come from the
    same grouped rows as the exposures, in one aggregate.
    """
    focal = scheme.focal
    top = len(BAND_LABELS) - 1
    members = F.col(f"group_{scheme.main}")
    exposures = grouped.filter(F.col("group_code") == focal.code).groupBy(region).agg(
        # a sum over no bands is 0, also in a region without members
        F.coalesce(ratio(F.sum(F.when(F.col("band_order") >= top - 1, members)), F.sum(members), 100), F.lit(0.0)).alias("majority_percent"),
        ratio(F.sum(F.when(F.col("band_order") == top, members)), F.sum(members), 100).alias("supermajority_percent"),
        *[(weighted_mean(i.code, weight_column(i, scheme)) * F.lit(i.multiplier)).alias(i.code) for i in indicators],
    )
    whole = lambda s: sum((F.sum(f"{g.prefix}_{s}") for g in scheme.baselines[1:]), F.sum(f"{scheme.baselines[0].prefix}_{s}"))
    shares = stage_units.groupBy(region).agg(
        *[ratio(F.sum(f"{focal.prefix}_{s}"), whole(s), 100).alias(f"{s}_share_percent") for s, _ in stages]
    )
    first, last = f"{stages[0][0]}_share_percent", f"{stages[-1][0]}_share_percent"
    return exposures.join(shares, region, "left").withColumn("stage_change_pp", F.col(last) - F.col(first))


def representation_gap(
    joined: DataFrame, categories: Sequence[tuple[str, str, str, str]], staff_total: str, people_total: str, by: Sequence[str] = ()
) -> DataFrame:
    """Share of staff against share of people per category: (code, label, staff column, people column)."""
    names = {c for _, _, a, b in categories for c in (a, b)} | {staff_total, people_total}
    sums = joined.groupBy(*by).agg(*[F.sum(F.col(n).cast("double")).alias(n) for n in sorted(names)])
    records = []
    for code, label, staff, people in categories:
        a, b = ratio(staff, staff_total, 100), ratio(people, people_total, 100)
        records.append({
            "group_code": F.lit(code), "group_label": F.lit(label),
            "staff_share_percent": a, "people_share_percent": b, "staff_minus_people_pp": a - b,
        })
    return sums.select(*unpivot(by, records))
