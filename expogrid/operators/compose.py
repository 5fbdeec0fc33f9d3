"""From long counts to one row per unit, and from there to one row per unit and group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import band, ratio, total_of, unpivot
from ..functions.model import GroupScheme
from .keys import unit_rows


def conditional_pivot(
    long: DataFrame, key: str, measures: Sequence[str], matches: dict[str, Column], only: dict[str, Sequence[str]] | None = None
) -> DataFrame:
    """Per key, sum each measure where a match holds; columns are ``{match}_{measure}``.

    One aggregate with map-side partial sums, so a key with very many long rows costs
    one partial row per task. ``only`` restricts the measures of some matches.
    """
    kinds = {f.name: f.dataType for f in long.schema.fields}
    zero = {m: F.lit(0).cast(kinds[m]) for m in measures}
    sums = [
        F.sum(F.when(match, F.col(m)).otherwise(zero[m])).alias(f"{name}_{m}")
        for name, match in matches.items()
        for m in (only or {}).get(name, measures)
    ]
    return long.groupBy(key).agg(*sums)


def with_shares(pivoted: DataFrame, scheme: GroupScheme, residual_of: Sequence[str] = ()) -> DataFrame:
    """Add baseline totals, each group's share, the focal share of the last measure and the residual.

    ``residual_of`` lists the counts (besides the focal one) that should add up to the total.
    """
    totals = {
        scheme.total(m): sum((F.col(scheme.column(g, m)) for g in scheme.baselines[1:]), F.col(scheme.column(scheme.baselines[0], m)))
        for m in scheme.measures
    }
    whole, focal, last = scheme.total(), scheme.focal, scheme.measures[-1]
    out = pivoted.withColumns(totals)
    added = {scheme.share(g): ratio(scheme.column(g), whole) for g in scheme.groups}
    added[f"{focal.prefix}_{last}_share"] = ratio(scheme.column(focal, last), scheme.column(focal))
    if residual_of:
        listed = [scheme.column(focal), *residual_of]
        added[f"residual_{scheme.main}"] = F.col(whole) - sum((F.col(c) for c in listed[1:]), F.col(listed[0]))
    return out.withColumns(added)


def age_bands(
    long: DataFrame, key: str, age: str, counts: dict[float, Sequence[str]], tolerance: float = 1
) -> DataFrame:
    """Per key, totals over, under and on the nominal age.

    ``counts`` maps a nominal age to the count columns held at that age.
    """
    parts = {"total": [], "over": [], "under": [], "on": []}
    for nominal, columns in counts.items():
        here, a = total_of(columns), F.col(age)
        zero = F.lit(0)
        parts["total"].append(here)
        parts["over"].append(F.when(a > nominal + tolerance, here).otherwise(zero))
        parts["under"].append(F.when(a < nominal - tolerance, here).otherwise(zero))
        parts["on"].append(F.when(a.between(nominal - tolerance, nominal + tolerance), here).otherwise(zero))
    return long.groupBy(key).agg(*[F.sum(total_of(terms)).alias(f"age_{name}") for name, terms in parts.items()])


def indicator_base(master: DataFrame, composition: DataFrame, key: str, total: str, ages: DataFrame | None = None) -> DataFrame:
    """Units with a positive total: master INNER composition, LEFT age counts, all on the unit key."""
    base = master.join(unit_rows(composition.filter(F.col(total) > 0)), key, "inner")
    return base if ages is None else base.join(unit_rows(ages), key, "left")


def group_long(units: DataFrame, scheme: GroupScheme, keep: Sequence[str]) -> DataFrame:
    """One row per unit and group from a single scan of the units."""
    records = [
        {
            "group_code": F.lit(g.code),
            "group_label": F.lit(g.label),
            **{f"group_{m}": F.col(scheme.column(g, m)) for m in scheme.measures},
            "group_share": F.col(scheme.share(g)),
            "band_order": band(scheme.share(g)),
        }
        for g in scheme.groups
    ]
    return units.select(*unpivot(keep, records))
