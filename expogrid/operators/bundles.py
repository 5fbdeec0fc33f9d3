"""Compound conditions: exposures, contrasts over bands, rankings.

Evaluating hundreds of combinations on every unit would cost hundreds of aggregates per
row. Instead each unit's flags are packed into two bit masks (observed, adverse) and the
units are summed once per mask pair. A combination is then a bit test on that table,
whose size depends on the number of flags and not on the number of units.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import BAND_LABELS, MASK_BITS, all_of, band_label, member_masks, minus, ratio, unpivot
from ..functions.model import Bundle, GroupScheme
from .contrast import beside

# A cell supports a ranking from this weight and number of units on.
MIN_WEIGHT = 10_000
MIN_UNITS = 25


def lattice(conditions: Sequence[tuple[str, str, str, str]], sizes: Sequence[int], predefined: Sequence[tuple[str, Sequence[str]]] = ()) -> tuple[Bundle, ...]:
    """All subsets of the conditions of the given sizes, plus predefined bundles not among them.

    A condition is (code, label, domain, weight). A combination takes the second sex as
    its weight as soon as one member does.
    """
    facts = {c[0]: c for c in conditions}

    def build(code: str, members: Sequence[str], kind: str) -> Bundle:
        rows = [facts[m] for m in members]
        special = [r[3] for r in rows if r[3] != "students"]
        return Bundle(
            code, " AND ".join(r[1] for r in rows), tuple(members), special[0] if special else "students",
            kind, " + ".join(dict.fromkeys(r[2] for r in rows)),
        )

    out = {
        frozenset(members): build("__and__".join(sorted(members)), members, f"all {size}-condition intersections")
        for size in sizes for members in combinations(facts, size)
    }
    for code, members in predefined:
        out.setdefault(frozenset(members), build(code, members, "predefined structural bundle"))
    return tuple(out.values())


def bundle_catalogue(spark, bundles: Sequence[Bundle]) -> DataFrame:
    rows = [(b.code, b.label, len(b.members), b.kind, b.domains, " | ".join(b.members), b.weight, b.mechanism) for b in bundles]
    return spark.createDataFrame(rows, (
        "bundle_code string, bundle_label string, bundle_size int, bundle_type string, domains string, "
        "members string, weighting string, mechanism string"
    ))


def in_scopes(units: DataFrame, scopes: dict[str, Column], name: str = "scope") -> DataFrame:
    """Repeat each unit once per scope it belongs to, in one scan."""
    member = F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in scopes.items()]))
    return units.withColumn(name, F.explode(member))


def patterns(grouped: DataFrame, bundles: Sequence[Bundle], scheme: GroupScheme, by: Sequence[str]) -> DataFrame:
    """Sum the weights per (fields, observed mask, adverse mask)."""
    members = list(dict.fromkeys(m for b in bundles for m in b.members))
    masks = [m.alias(f"{state}_{i}") for state in ("observed", "adverse") for i, m in enumerate(member_masks(members, state))]
    return grouped.groupBy(*by, *masks).agg(F.count(F.lit(1)).alias("units"), *[F.sum(f"group_{m}").alias(f"w_{m}") for m in scheme.measures])


def bundle_sums(grouped: DataFrame, bundles: Sequence[Bundle], scheme: GroupScheme, by: Sequence[str]) -> DataFrame:
    """Eligible and affected weight and units per field values and bundle."""
    members = list(dict.fromkeys(m for b in bundles for m in b.members))
    words = range(-(-len(members) // MASK_BITS))
    bit = {m: (i // MASK_BITS, 1 << (i % MASK_BITS)) for i, m in enumerate(members)}
    need = lambda b, word: sum(bit[m][1] for m in set(b.members) if bit[m][0] == word)
    table = patterns(grouped, bundles, scheme, by)
    # The bundle list is a constant array, folded once by the optimizer.
    quoted = lambda text: "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
    listed = ", ".join(
        f"struct({quoted(b.code)} AS bundle_code, {', '.join(f'{need(b, w)}L AS need_{w}' for w in words)}, "
        f"{quoted(b.weight if b.weight in scheme.measures else scheme.main)} AS measure)"
        for b in bundles
    )
    weight = F.col(f"w_{scheme.main}")
    for m in scheme.measures[1:]:
        weight = F.when(F.col("measure") == m, F.col(f"w_{m}")).otherwise(weight)
    spread = table.select("*", F.expr(f"inline(array({listed}))")).withColumn("weight", weight)
    holds_all = lambda state: all_of([F.col(f"{state}_{w}").bitwiseAND(F.col(f"need_{w}")) == F.col(f"need_{w}") for w in words])
    seen = holds_all("observed")
    hit = seen & holds_all("adverse")
    zero = F.lit(0)
    return spread.groupBy(*by, "bundle_code").agg(
        F.sum(F.when(seen, F.col("weight")).otherwise(zero)).alias("eligible_weight"),
        F.sum(F.when(hit, F.col("weight")).otherwise(zero)).alias("affected_weight"),
        F.sum(F.when(seen, F.col("units")).otherwise(zero)).alias("eligible_units"),
        F.sum(F.when(hit, F.col("units")).otherwise(zero)).alias("affected_units"),
    )


def bundle_exposure(grouped: DataFrame, bundles: Sequence[Bundle], scheme: GroupScheme, by: Sequence[str]) -> DataFrame:
    """Sums and percents per field values and bundle.

    Every bundle keeps a row in every cell, with zero eligible weight where no unit has
    all members observed.
    """
    sums = bundle_sums(grouped, bundles, scheme, by)
    return sums.withColumn("exposure_percent", ratio("affected_weight", "eligible_weight", 100)).withColumn(
        "unit_percent", ratio("affected_units", "eligible_units", 100)
    )


def bundle_gradient(grouped: DataFrame, bundles: Sequence[Bundle], scheme: GroupScheme, by: Sequence[str]) -> DataFrame:
    """Exposure by band, over rows whose share is known."""
    rows = grouped.filter(F.col("group_share").isNotNull())
    return bundle_exposure(rows, bundles, scheme, [*by, "band_order"]).withColumn("band", band_label("band_order"))


def band_contrast(
    grouped: DataFrame, bundles: Sequence[Bundle], keys: Sequence[str], scheme: GroupScheme, low: int = 1, high: int = 8
) -> DataFrame:
    """Per key and baseline: overall gap, top-band gap, change over bands and difference-in-differences.

    The units are summed once, by band; the whole is the sum over bands, rows without a
    band included. A group or band that is absent gives NULL values, not a missing row.
    """
    cells = bundle_sums(grouped, bundles, scheme, [*[k for k in keys if k != "bundle_code"], "group_code", "band_order"])
    at = lambda name, order: F.sum(F.when(F.col("band_order") == order, F.col(name)))
    percent = lambda order: ratio(at("affected_weight", order), at("eligible_weight", order), 100)
    rows = cells.groupBy(*keys, "group_code").agg(
        ratio(F.sum("affected_weight"), F.sum("eligible_weight"), 100).alias("overall"),
        percent(low).alias("low"), percent(high).alias("high"),
        at("eligible_weight", high).alias("high_weight"), at("eligible_units", high).alias("high_units"),
    )
    side = beside(rows, keys, scheme, ["overall", "low", "high", "high_weight", "high_units"])
    f = scheme.focal.code

    def change(code: str) -> Column:
        return minus(f"high__{code}", f"low__{code}")

    records = [
        {
            "baseline_code": F.lit(b.code), "baseline_label": F.lit(b.label),
            "focal_percent": F.col(f"overall__{f}"), "baseline_percent": F.col(f"overall__{b.code}"),
            "gap_pp": minus(f"overall__{f}", f"overall__{b.code}"),
            "focal_low_percent": F.col(f"low__{f}"), "focal_high_percent": F.col(f"high__{f}"),
            "focal_change_pp": change(f),
            "baseline_low_percent": F.col(f"low__{b.code}"), "baseline_high_percent": F.col(f"high__{b.code}"),
            "baseline_change_pp": change(b.code),
            "high_gap_pp": minus(f"high__{f}", f"high__{b.code}"),
            "did_pp": change(f) - change(b.code),
            "focal_high_weight": F.col(f"high_weight__{f}"), "baseline_high_weight": F.col(f"high_weight__{b.code}"),
            "focal_high_units": F.col(f"high_units__{f}"), "baseline_high_units": F.col(f"high_units__{b.code}"),
        }
        for b in scheme.baselines
    ]
    return side.select(*unpivot(keys, records))


def adequate(min_weight: float = MIN_WEIGHT, min_units: int = MIN_UNITS) -> Column:
    tests = [F.coalesce(F.col(f"{s}_high_weight"), F.lit(0)) >= min_weight for s in ("focal", "baseline")]
    tests += [F.coalesce(F.col(f"{s}_high_units"), F.lit(0)) >= min_units for s in ("focal", "baseline")]
    return all_of(tests)


def robust_ranking(
    contrasts: DataFrame, keys: Sequence[str], min_weight: float = MIN_WEIGHT, min_units: int = MIN_UNITS
) -> DataFrame:
    """Fold the baselines: smallest and mean gap and DiD, worse and steeper than all, adequate cells.

    The summaries are NULL unless every baseline has both values.
    """
    gap, did = F.col("high_gap_pp"), F.col("did_pp")
    complete = F.bool_and(gap.isNotNull() & did.isNotNull())
    out = contrasts.groupBy(*keys).agg(
        F.max("focal_high_percent").alias("focal_high_percent"),
        F.max("focal_change_pp").alias("focal_change_pp"),
        F.when(complete, F.min(gap)).alias("min_high_gap_pp"),
        F.when(complete, F.avg(gap)).alias("mean_high_gap_pp"),
        F.when(complete, F.min(did)).alias("min_did_pp"),
        F.when(complete, F.avg(did)).alias("mean_did_pp"),
        F.bool_and(adequate(min_weight, min_units)).alias("adequate_cell"),
    )
    return out.withColumns({
        "worse_than_all": F.coalesce(F.col("min_high_gap_pp") > 0, F.lit(False)),
        "steeper_than_all": F.coalesce(F.col("min_did_pp") > 0, F.lit(False)),
    })


def with_rank(ranking: DataFrame, keys: Sequence[str], name: str = "robust_rank") -> DataFrame:
    """Number the rows by five descending criteria, then by key so that the order is total.

    The input has one row per combination and area, a size set by the plan's parameters,
    so one window over all of it is small.
    """
    order = [
        F.col("adequate_cell").desc(), F.col("worse_than_all").desc(), F.col("steeper_than_all").desc(),
        F.col("min_high_gap_pp").desc_nulls_last(), F.col("min_did_pp").desc_nulls_last(), *[F.col(k) for k in keys],
    ]
    return ranking.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def top_contrasts(contrasts: DataFrame, by: str, keys: Sequence[str], k: int = 25, min_weight: float = MIN_WEIGHT, min_units: int = MIN_UNITS) -> DataFrame:
    """The k adequate contrasts with the largest value of ``by``."""
    rows = contrasts.filter(adequate(min_weight, min_units) & F.col(by).isNotNull())
    return rows.orderBy(F.col(by).desc(), *keys).limit(k)


def top_robust(ranking: DataFrame, keys: Sequence[str], k: int = 25) -> DataFrame:
    """The k best rows that are adequate, worse than all and steeper than all baselines."""
    rows = ranking.filter(F.col("adequate_cell") & F.col("worse_than_all") & F.col("steeper_than_all"))
    return rows.orderBy(F.col("min_high_gap_pp").desc(), F.col("min_did_pp").desc(), *keys).limit(k)


UNIT_PREVALENCE = "equal-unit prevalence"
WEIGHTED_EXPOSURE = "group-weighted exposure"


def in_areas(rows: DataFrame, region: str, areas: Sequence[str], whole: str = "NATIONAL", name: str = "area") -> DataFrame:
    """Repeat each row for the whole and, if its region is listed, for that region."""
    region_area = F.when(F.col(region).isin(list(areas)), F.col(region))
    return rows.withColumn(name, F.explode(F.array_compact(F.array(F.lit(whole), region_area))))


def two_estimands(banded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Melt a bundle gradient into equal-unit prevalence and weighted exposure rows."""
    keep = [*keys, "group_code", "band_order", "eligible_weight", "affected_weight", "eligible_units"]
    return banded.select(*unpivot(keep, [
        {"estimand": F.lit(UNIT_PREVALENCE), "exposure_percent": F.col("unit_percent")},
        {"estimand": F.lit(WEIGHTED_EXPOSURE), "exposure_percent": F.col("exposure_percent")},
    ]))


def matched_bands(gradients: DataFrame, keys: Sequence[str], scheme: GroupScheme, full: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """Focal against one baseline in each band, with all bands present.

    ``full`` lists key values (in the order of ``keys``) that must appear even when no
    row has them; otherwise the keys found are completed with all bands.
    """
    focal, base = scheme.focal, scheme.baselines[0]
    all_keys = [*keys, "band_order"]
    values = ["exposure_percent", "eligible_weight", "eligible_units"]
    dtypes = dict(gradients.dtypes)
    found = gradients.select(*all_keys, "group_code", *values)
    skeleton = found.select(*keys).distinct()
    if full is not None:
        wanted = F.array(*[F.struct(*[F.lit(v).cast(dtypes[k]).alias(k) for k, v in zip(keys, row, strict=True)]) for row in full])
        skeleton = found.sparkSession.range(1).select(F.inline(wanted))
    grid = skeleton.withColumn("band_order", F.explode(F.sequence(F.lit(0), F.lit(len(BAND_LABELS) - 1))))
    side = beside(found.unionByName(grid, allowMissingColumns=True), all_keys, scheme, values)
    out = [*[F.col(k) for k in keys], "band_order", band_label("band_order").alias("band")]
    for v in values:
        out += [F.col(f"{v}__{focal.code}").alias(f"focal_{v}"), F.col(f"{v}__{base.code}").alias(f"baseline_{v}")]
    return side.select(*out, minus(f"exposure_percent__{focal.code}", f"exposure_percent__{base.code}").alias("gap_pp"))


def gradient_summary(matched: DataFrame, keys: Sequence[str], high: int = 8) -> DataFrame:
    """Ends and changes per key. Weighted rows start at band 1: a zero share has no members to weight."""
    low = F.when(F.col("estimand") == UNIT_PREVALENCE, 0).otherwise(1)
    order = F.col("band_order")
    at = lambda c, where, name: F.max(F.when(order == where, F.col(c))).alias(name)
    ends = matched.groupBy(*keys, "estimand").agg(
        F.max(F.when(order == low, F.col("band"))).alias("low_band"),
        at("focal_exposure_percent", low, "focal_low_percent"), at("baseline_exposure_percent", low, "baseline_low_percent"),
        at("focal_exposure_percent", high, "focal_high_percent"), at("baseline_exposure_percent", high, "baseline_high_percent"),
        at("focal_eligible_weight", high, "focal_high_weight"), at("baseline_eligible_weight", high, "baseline_high_weight"),
        at("focal_eligible_units", high, "focal_high_units"), at("baseline_eligible_units", high, "baseline_high_units"),
    )
    focal, base = minus("focal_high_percent", "focal_low_percent"), minus("baseline_high_percent", "baseline_low_percent")
    return ends.withColumns({
        "high_gap_pp": minus("focal_high_percent", "baseline_high_percent"),
        "focal_change_pp": focal, "baseline_change_pp": base, "gradient_difference_pp": focal - base,
    })


def top_per(rows: DataFrame, within: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group in a total order; Spark keeps only k rows per task before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*within).orderBy(*order))
    return rows.withColumn("place", place).filter(F.col("place") <= k)
