"""Column builders. Every function returns a Column; nothing here runs a job."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(or_, conditions)


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(and_, conditions)


def total_of(columns: Iterable[str | Column]) -> Column:
    """Sum over columns with NULL read as zero."""
    columns = list(columns)
    if all(isinstance(c, str) for c in columns):
        return F.expr(" + ".join(f"coalesce(`{c}`, 0)" for c in columns))
    return reduce(add, [F.coalesce(_col(c), F.lit(0)) for c in columns])


def ratio(numerator: str | Column, denominator: str | Column, scale: float = 1.0) -> Column:
    """``numerator * scale / denominator`` as double; NULL where the denominator is zero."""
    return F.try_divide(_col(numerator).cast("double") * F.lit(float(scale)), _col(denominator).cast("double"))


def minus(left: str | Column, right: str | Column) -> Column:
    return _col(left) - _col(right)


def weighted_mean(value: str | Column, weight: str | Column, denominator: str = "observed") -> Column:
    """Aggregate: sum(w*x)/sum(w).

    ``observed`` takes the weight only where the value is present; ``all`` takes the
    weight of every row, so a missing value counts as zero.
    """
    x, w = _col(value).cast("double"), _col(weight).cast("double")
    if denominator == "observed":
        below = F.sum(F.when(x.isNotNull(), w))
    elif denominator == "all":
        below = F.sum(w)
    else:
        raise ValueError(f"denominator must be 'observed' or 'all', not {denominator!r}")
    return F.try_divide(F.sum(w * x), below)


def mean_of_observed(columns: Sequence[str | Column], scale: float = 1.0) -> Column:
    """Row mean over the columns that are not NULL; NULL when all are."""
    cols = [_col(c) for c in columns]
    seen = reduce(add, [c.isNotNull().cast("int") for c in cols])
    return ratio(total_of([c.cast("double") for c in cols]), seen, scale)


def coded(column: str | Column, adverse: Sequence[int], favourable: Sequence[int]) -> Column:
    """1 for an adverse code, 0 for a favourable one, NULL for any other answer."""
    c = _col(column)
    return F.when(c.isin(list(adverse)), 1).when(c.isin(list(favourable)), 0)


def holds(condition: Column) -> Column:
    """1 where the condition is true, else 0 (an unknown condition gives 0)."""
    return F.when(condition, 1).otherwise(0)


def all_members(flags: Sequence[str | Column]) -> Column:
    """Compound flag: NULL if any member is NULL, 1 if every member is 1, else 0."""
    cols = [_col(c) for c in flags]
    return F.when(all_of([c.isNotNull() for c in cols]), holds(all_of([c == 1 for c in cols])))


MASK_BITS = 62


def member_masks(flags: Sequence[str | Column], state: str) -> list[Column]:
    """Pack flags into longs of ``MASK_BITS`` each, as many as they need; see ``member_mask``."""
    return [member_mask(flags[i : i + MASK_BITS], state) for i in range(0, len(flags), MASK_BITS)]


def member_mask(flags: Sequence[str | Column], state: str) -> Column:
    """Pack flags into one long: bit i is set when flag i is observed (or equals one)."""
    test = (lambda c: c.isNotNull()) if state == "observed" else (lambda c: F.coalesce(c == 1, F.lit(False)))
    bits = [F.when(test(_col(c)), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, c in enumerate(flags)]
    return reduce(add, bits)


# Upper edges of the concentration bands above zero, and all band labels.
BAND_EDGES = (0.05, 0.10, 0.20, 0.30, 0.40, 0.50, 0.75)
BAND_LABELS = ("0%", ">0-5%", ">5-10%", ">10-20%", ">20-30%", ">30-40%", ">40-50%", ">50-75%", ">75-100%")
COARSE_EDGES = (0.10, 0.25, 0.50)
COARSE_LABELS = ("0%", ">0-10%", ">10-25%", ">25-50%", ">50-100%")


def band(share: str | Column, edges: Sequence[float] = BAND_EDGES) -> Column:
    """0 for a zero share, then 1.. by upper edge; a share above the last edge takes the top band.

    A NULL share has no band.
    """
    s = _col(share)
    out = F.when(s.isNull(), F.lit(None).cast("int")).when(s == 0, 0)
    for i, edge in enumerate(edges, start=1):
        out = out.when(s <= F.lit(float(edge)), i)
    return out.otherwise(len(edges) + 1)


def band_label(order: str | Column, labels: Sequence[str] = BAND_LABELS) -> Column:
    o = _col(order)
    return F.when(o.between(0, len(labels) - 1), F.element_at(F.array(*[F.lit(x) for x in labels]), (o + 1).cast("int")))


def clean_text(column: str | Column) -> Column:
    return F.nullif(F.trim(_col(column)), F.lit(""))


LONG_LIMIT = float(2**63)


def typed(column: str | Column, kind: str, strict: bool = False) -> Column:
    """Trim, turn blanks to NULL and try to cast.

    For ``bigint`` a decimal or exponent text is rounded to the nearest whole number
    unless ``strict``; text out of range or not a number gives NULL.
    """
    text = clean_text(column)
    if kind == "string":
        return text
    if kind != "bigint" or strict:
        return text.try_cast(kind)
    real = text.try_cast("double")
    whole = F.round(real)
    return F.coalesce(text.try_cast("bigint"), F.when(F.abs(whole) < F.lit(LONG_LIMIT), whole.cast("bigint")))


def unpivot(keep: Sequence[str | Column], records: Sequence[dict[str, Column]]) -> list[Column]:
    """Select list that turns each row into one row per record, in a single scan."""
    structs = [F.struct(*[value.alias(name) for name, value in r.items()]) for r in records]
    return [*[_col(c) for c in keep], F.inline(F.array(*structs))]
