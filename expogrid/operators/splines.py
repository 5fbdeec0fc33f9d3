"""Restricted cubic splines: flexible associations inside groups, with a joint test of their curvature."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.model import Indicator
from .distributions import chi_square_tail, student_quantile
from .models import Fit, Regressor, fit_within
from .ranking import quantiles


def knots_at(units: DataFrame, x: str, probabilities: Sequence[float], buckets: int = 256) -> list[float]:
    """Distinct exact quantiles of ``x``, in order: one small row, computed without sorting x in one task."""
    named = {f"k{i}": p for i, p in enumerate(probabilities)}
    row = quantiles(units.select(F.col(x).cast("double").alias(x)), [], x, named, buckets).first()
    return sorted({float(row[n]) for n in named if row[n] is not None}) if row else []


def curved_terms(x: Column, knots: Sequence[float]) -> list[Column]:
    """The terms besides x itself: cubic between the knots, straight below the first and above the last.

    k knots give k - 2 terms, divided by the squared span of the knots so that they are of the size of x.
    """
    span = (knots[-1] - knots[0]) ** 2
    cube = lambda t: F.pow(F.greatest(x - F.lit(t), F.lit(0.0)), F.lit(3.0))
    wide = knots[-1] - knots[-2]
    return [
        (cube(t) - cube(knots[-2]) * F.lit((knots[-1] - t) / wide) + cube(knots[-1]) * F.lit((knots[-2] - t) / wide)) / F.lit(span)
        for t in knots[:-2]
    ]


def curved_values(x: np.ndarray, knots: Sequence[float]) -> np.ndarray:
    """What ``curved_terms`` give, one column a term, for values on the driver."""
    k = np.asarray(knots, float)
    cube = np.maximum(np.asarray(x, float)[:, None] - k, 0.0) ** 3
    left = (k[-1] - k[:-2]) / (k[-1] - k[-2])
    return (cube[:, :-2] - cube[:, -2:-1] * left + cube[:, -1:] * (left - 1)) / (k[-1] - k[0]) ** 2


@dataclass(frozen=True)
class Curve:
    """A fitted curve: the fit, its knots, and the joint test that all of its curved terms are zero."""

    fit: Fit
    knots: tuple[float, ...]
    wald: float | None
    curved_terms: int
    p_value: float | None

    def change(self, start: float, end: float, level: float = 0.95) -> tuple[float, float | None, float | None]:
        """Fitted change of the outcome as x goes from start to end, with t limits from the clustered covariance."""
        at = np.array([start, end])
        basis = np.column_stack([at, curved_values(at, self.knots)]) if self.curved_terms else at[:, None]
        step = basis[1] - basis[0]
        own = len(step)
        value = float(step @ self.fit.coefficients[:own])
        if self.fit.covariance is None or self.fit.clusters < 2:
            return value, None, None
        error = float(np.sqrt(max(0.0, step @ self.fit.covariance[:own, :own] @ step)))
        t = student_quantile(0.5 + level / 2, self.fit.clusters - 1)
        return value, value - t * error, value + t * error


def joint_wald(fit: Fit, places: Sequence[int]) -> tuple[float | None, int]:
    """The Wald statistic of the named coefficients all being zero, and its degrees of freedom (the rank of their covariance)."""
    if fit.covariance is None or not len(places):
        return None, 0
    b, v = fit.coefficients[list(places)], fit.covariance[np.ix_(list(places), list(places))]
    # On a common scale, so that the rank does not depend on the units of the terms.
    scale = np.sqrt(np.diag(v))
    usable = scale > 0
    if not usable.any():
        return None, 0
    b, v = b[usable] / scale[usable], v[np.ix_(usable, usable)] / np.outer(scale[usable], scale[usable])
    return float(b @ np.linalg.pinv(v, rcond=1e-10, hermitian=True) @ b), int(np.linalg.matrix_rank(v, tol=1e-10 * len(b), hermitian=True))


def spline_models(
    units: DataFrame, x: str, outcomes: Sequence[str], region: str, subregion: str, probabilities: Sequence[float] = (0.05, 0.35, 0.65, 0.95),
    controls: Sequence[Regressor] = (), positive_only: bool = True, levels: Sequence[str] = ("region", "subregion"),
) -> list[Curve]:
    """Outcomes on a restricted cubic spline of x with fixed effects and errors clustered by subregion.

    Knots lie at exact quantiles of x, of its positive values unless ``positive_only`` is off, so that a mass at
    zero does not swallow them; quantiles that coincide count once. Fewer than three distinct knots leave the straight line,
    without a test. Every unit with a share enters the fit; each outcome uses its complete cases.
    """
    seen = units.filter(F.col(x) > 0) if positive_only else units.filter(F.col(x).isNotNull())
    knots = tuple(knots_at(seen, x, probabilities))
    extra = curved_terms(F.col(x).cast("double"), knots) if len(knots) > 2 else []
    terms = [Regressor(x, F.col(x), x), *[Regressor(f"{x}_curve_{i}", c, f"{x} curve {i}") for i, c in enumerate(extra, 1)], *controls]
    out = []
    for fit in fit_within(units, outcomes, terms, region, subregion, levels):
        wald, df = joint_wald(fit, range(1, 1 + len(extra)))
        out.append(Curve(fit, knots, wald, len(extra), chi_square_tail(wald, df) if wald is not None and df else None))
    return out


CURVES = (
    "fixed_effect string, outcome_code string, direction string, knots array<double>, linear double, linear_error double, curve array<double>, curve_error array<double>, "
    "wald double, wald_df int, p_value double, change_between_outer_knots double, change_low double, change_high double, observations long, clusters long, matrix_rank int"
)


def curve_table(spark, curves: Sequence[Curve], outcomes: Sequence[Indicator]) -> DataFrame:
    """One row per curve; the change is that between the outer knots."""
    by_code = {o.code: o for o in outcomes}
    rows = []
    for c in curves:
        n, f = c.curved_terms, c.fit
        change = c.change(c.knots[0], c.knots[-1]) if len(c.knots) > 1 else (None, None, None)
        rows.append((
            f"{f.level} fixed effects", f.outcome, by_code[f.outcome].direction, list(c.knots), float(f.coefficients[0]), None if f.errors is None else float(f.errors[0]),
            [float(v) for v in f.coefficients[1 : 1 + n]], None if f.errors is None else [float(v) for v in f.errors[1 : 1 + n]],
            c.wald, n, c.p_value, *change, f.observations, f.clusters, f.rank,
        ))
    return spark.createDataFrame(rows, CURVES)
