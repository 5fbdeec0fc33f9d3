"""Logistic models by iteratively reweighted least squares over stored rows.

One pass over the data per step: a task adds up one weighted cross-product matrix, one
score vector and one log-likelihood for each outcome, and only these are shuffled. A step that
lowers the likelihood is halved, which the next pass finds out, so no pass is wasted on
deciding. Clustered errors take one more pass for the cluster sums of scores.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.model import Indicator
from ..sources.sinks import stored
from .distributions import student_quantile
from .models import GRAM, Regressor, _gram_rows, _sum_grams

CONVERGED, SEPARATED, CONSTANT, STOPPED = "converged", "separated", "constant outcome", "not converged"


@dataclass
class LogitFit:
    """Coefficients on the scale of the regressors, the intercept first. ``errors`` are clustered."""

    outcome: str
    status: str
    observations: int
    positives: int
    clusters: int
    passes: int
    rank: int
    log_likelihood: float
    coefficients: np.ndarray
    errors: np.ndarray | None
    covariance: np.ndarray | None


@dataclass
class _State:
    """One outcome on its way: the last accepted point and the one to be tried next, for standardised regressors."""

    beta: np.ndarray
    trial: np.ndarray
    step: np.ndarray | None = None
    value: float = -np.inf
    bread: np.ndarray | None = None
    rank: int = 0
    halvings: int = 0
    passes: int = 0
    status: str = STOPPED
    open: bool = True
    trace: list[float] = field(default_factory=list)


def _chances(eta: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * eta))


def _log_likelihood(eta: np.ndarray, y: np.ndarray) -> float:
    """Sum of y log p + (1 - y) log(1 - p), without overflow."""
    return float(np.where(y == 1, -np.logaddexp(0, -eta), -np.logaddexp(0, eta)).sum())


def fit_logistic(
    units: DataFrame, outcomes: Sequence[str], regressors: Sequence[Regressor], clusters: Sequence[str], most_passes: int = 60, tolerance: float = 1e-9, cutoff: float = 1e-10,
) -> list[LogitFit]:
    """Binary outcomes (0, 1, other values raise) on an intercept and the regressors; complete cases by outcome.

    All outcomes share each pass, and one that is done drops out of the next. A fit is done when the step is below
    ``tolerance`` standard deviations of every regressor. If the likelihood is within ``tolerance`` of standing still
    while the step is not, a combination of regressors separates the outcomes: there is no
    maximum, and the fit is reported as separated without errors. An outcome with one value is reported as constant.
    Redundant regressors share a coefficient (pseudo-inverse), and the rank is reported.
    """
    names = [f"x{i}" for i in range(len(regressors))]
    ys = [f"y{i}" for i in range(len(outcomes))]
    keys = [f"k{i}" for i in range(len(clusters))]
    narrow = units.select(
        *[F.col(c).alias(k) for c, k in zip(clusters, keys, strict=True)],
        *[r.column.cast("double").alias(n) for n, r in zip(names, regressors, strict=True)],
        *[F.col(o).cast("double").alias(y) for o, y in zip(outcomes, ys, strict=True)],
    ).na.drop(subset=names) if names else units.select(
        *[F.col(c).alias(k) for c, k in zip(clusters, keys, strict=True)], *[F.col(o).cast("double").alias(y) for o, y in zip(outcomes, ys, strict=True)],
    )
    with stored(narrow, "logit") as rows:
        return _fit(rows, outcomes, names, ys, keys, most_passes, tolerance, cutoff)


def _fit(rows, outcomes, names, ys, keys, most_passes, tolerance, cutoff) -> list[LogitFit]:
    k = len(names) + 1
    heads = rows.agg(
        *[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names],
        *[F.count(y).alias(f"n_{y}") for y in ys], *[F.sum(y).alias(f"p_{y}") for y in ys],
        *[F.count(F.when(~F.col(y).isin(0.0, 1.0), 1)).alias(f"b_{y}") for y in ys],
        *[F.count_distinct(F.when(F.col(y).isNotNull(), F.struct(*keys))).alias(f"c_{y}") for y in ys],
    ).first()
    if any(heads[f"b_{y}"] for y in ys):
        raise ValueError("outcomes of a logistic model are 0 or 1")
    # Standardised regressors keep the matrix well conditioned; a constant one is left at 0.
    centre = np.array([heads[f"m_{n}"] or 0.0 for n in names])
    scale = np.array([heads[f"s_{n}"] or 0.0 for n in names])
    scale = np.where(scale > 1e-12 * (1 + np.abs(centre)), scale, np.inf)
    states = {}
    for y in ys:
        n, p = heads[f"n_{y}"], heads[f"p_{y}"] or 0.0
        states[y] = _State(np.zeros(k), np.zeros(k))
        if not n or p in (0.0, float(n)):
            states[y].status, states[y].open = CONSTANT, False

    def design(batch: pd.DataFrame, y: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = batch[y].to_numpy(dtype=float)
        seen = ~np.isnan(out)
        x = (batch.loc[seen, names].to_numpy(dtype=float) - centre) / scale
        return np.column_stack([np.ones(len(x)), x]), out[seen], seen

    for _ in range(most_passes):
        trials = {y: s.trial for y, s in states.items() if s.open}
        if not trials:
            break

        def sums(batches: Iterator[pd.DataFrame], trials=trials) -> Iterator[pd.DataFrame]:
            # Row and column k hold the scores, the corner the log-likelihood.
            total = {y: np.zeros((k + 1, k + 1)) for y in trials}
            for batch in batches:
                for y, beta in trials.items():
                    x, out, _ = design(batch, y)
                    eta = x @ beta
                    p = _chances(eta)
                    m = total[y]
                    m[:k, :k] += (x * (p * (1 - p))[:, None]).T @ x
                    m[:k, k] += x.T @ (out - p)
                    m[k, k] += _log_likelihood(eta, out)
            for y, m in total.items():
                yield _gram_rows(y, m)

        for y, m in _sum_grams(rows.select(*names, *ys).mapInPandas(sums, GRAM), k + 1).items():
            _advance(states[y], m[:k, :k], m[:k, k], float(m[k, k]), tolerance, cutoff)

    meats = _cluster_meats(rows, {y: s.beta for y, s in states.items() if s.status == CONVERGED}, design, names, ys, keys)
    back = np.zeros((k, k))  # from standardised to own scale
    back[0, 0] = 1.0
    for i in range(len(names)):
        if np.isfinite(scale[i]):
            back[i + 1, i + 1] = 1 / scale[i]
            back[0, i + 1] = -centre[i] / scale[i]
    fits = []
    for outcome, y in zip(outcomes, ys, strict=True):
        s, groups = states[y], int(heads[f"c_{y}"])
        covariance = errors = None
        if y in meats and groups > 1:
            covariance = back @ (s.bread @ meats[y] @ s.bread) @ back.T * (groups / (groups - 1))
            errors = np.sqrt(np.clip(np.diag(covariance), 0, None))
        fits.append(LogitFit(
            outcome, s.status, int(heads[f"n_{y}"]), int(heads[f"p_{y}"] or 0), groups, s.passes, s.rank,
            0.0 if s.status == CONSTANT else s.value, back @ s.beta, errors, covariance,
        ))
    return fits


def _advance(s: _State, hessian: np.ndarray, score: np.ndarray, value: float, tolerance: float, cutoff: float) -> None:
    """Judge the point tried and choose the next one."""
    s.passes += 1
    if s.step is not None and not value >= s.value - 1e-12 * abs(s.value):
        s.halvings += 1
        s.step = s.step / 2
        s.trial = s.beta + s.step
        if s.halvings > 40:
            s.open = False
        return
    gained = value - s.value
    s.beta, s.value, s.halvings = s.trial, value, 0
    s.trace.append(value)
    s.bread = np.linalg.pinv(hessian, rcond=cutoff, hermitian=True)
    s.rank = int(np.linalg.matrix_rank(hessian, tol=cutoff * max(np.abs(hessian).max(), 1e-300), hermitian=True))
    s.step = s.bread @ score
    s.trial = s.beta + s.step
    size = float(np.abs(s.step).max())
    if size < tolerance:
        s.status, s.open = CONVERGED, False
    elif value > -1e-6 or (gained < tolerance * (1 + abs(value)) and size > 1e-2) or float(np.abs(s.beta).max()) > 60:
        s.status, s.open = SEPARATED, False


def _cluster_meats(rows, betas, design, names, ys, keys) -> dict[str, np.ndarray]:
    """Sum over clusters of the outer product of a cluster's scores, for each finished outcome."""
    if not betas:
        return {}
    k = len(names) + 1

    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            codes = batch.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            _, first = np.unique(codes, return_index=True)
            for y, beta in betas.items():
                x, out, seen = design(batch, y)
                each = x * (out - _chances(x @ beta))[:, None]
                total = np.zeros((len(first), k))
                np.add.at(total, codes[seen], each)
                found = batch.iloc[first][keys].reset_index(drop=True)
                found.insert(0, "fit", y)
                for i in range(k):
                    found[f"s{i}"] = total[:, i]
                yield found

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)
    per = rows.mapInPandas(scores, f"fit string, {kinds}, " + ", ".join(f"s{i} double" for i in range(k)))
    per = per.groupBy("fit", *keys).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)])

    def outer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for y, part in batch.groupby("fit"):
                z = part[[f"s{i}" for i in range(k)]].to_numpy(dtype=float)
                total[y] = total.get(y, 0) + z.T @ z
        for y, m in total.items():
            yield _gram_rows(y, m)

    return _sum_grams(per.drop(*keys).mapInPandas(outer, GRAM), k)


LOGITS = (
    "outcome_code string, direction string, regressor string, regressor_label string, status string, coefficient double, standard_error double, "
    "odds_ratio double, odds_low double, odds_high double, observations long, positives long, clusters long, matrix_rank int, log_likelihood double"
)


def odds_table(spark, fits: Sequence[LogitFit], regressors: Sequence[Regressor], outcomes: Sequence[Indicator], level: float = 0.95) -> DataFrame:
    """One row per fit and regressor with odds ratios and t limits; nothing but the status for fits without a maximum."""
    by_code = {o.code: o for o in outcomes}
    rows = []
    for f in fits:
        for at, (name, label) in enumerate([("intercept", "intercept"), *[(r.name, r.label) for r in regressors]]):
            b = se = odds = low = high = None
            if f.status == CONVERGED:
                b = float(f.coefficients[at])
                odds = float(np.exp(b))
                if f.errors is not None:
                    se, t = float(f.errors[at]), student_quantile(0.5 + level / 2, f.clusters - 1)
                    low, high = float(np.exp(b - t * se)), float(np.exp(b + t * se))
            rows.append((f.outcome, by_code[f.outcome].direction, name, label, f.status, b, se, odds, low, high, f.observations, f.positives, f.clusters, f.rank, float(f.log_likelihood)))
    return spark.createDataFrame(rows, LOGITS)
