"""Index weights from principal components of indicators that are each known for some units only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def correlations(units: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per pair of columns: units that have both, and their correlation; one aggregate for all pairs.

    A pair uses every unit that has both. The correlation is NULL for fewer than two units or a constant column.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    values = {c: F.col(c).cast("double") for c in columns}
    sums = []
    for k, (a, b) in enumerate(pairs):
        both = values[a].isNotNull() & values[b].isNotNull()
        x, y = F.when(both, values[a]), F.when(both, values[b])
        r = F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y)))
        sums += [F.count(F.when(both, 1)).alias(f"n{k}"), r.alias(f"r{k}")]
    wide = units.agg(*sums)
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"n{k}").alias("pairs"), F.col(f"r{k}").alias("correlation")) for k, (a, b) in enumerate(pairs)
    ])))


@dataclass(frozen=True)
class Components:
    """Components by falling share of variance. A row of ``loadings`` is one component; its entries sum to a positive number."""

    columns: tuple[str, ...]
    loadings: np.ndarray
    shares: np.ndarray
    means: np.ndarray
    scales: np.ndarray

    def index(self, component: int = 0) -> Column:
        """The weighted mean of the standardised columns that a unit has, by absolute loadings; NULL without any."""
        top = bottom = F.lit(0.0)
        for c, w, m, s in zip(self.columns, self.loadings[component], self.means, self.scales):
            z = (F.col(c).cast("double") - F.lit(float(m))) / F.lit(float(s)) if s > 0 else F.lit(None).cast("double")
            top += F.coalesce(z * F.lit(float(w)), F.lit(0.0))
            bottom += F.when(z.isNotNull(), F.lit(abs(float(w)))).otherwise(F.lit(0.0))
        return F.try_divide(top, bottom)


def principal_components(units: DataFrame, columns: Sequence[str]) -> Components:
    """Components of the matrix of pairwise correlations. Only that k x k matrix and means reach the driver.

    Pairs without a correlation count as uncorrelated, and columns without variance load on nothing. A matrix from pairs
    known for different units may have negative eigenvalues: these count as zero.
    """
    k, at = len(columns), {c: i for i, c in enumerate(columns)}
    heads = units.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    means = np.array([heads[f"m_{c}"] or 0.0 for c in columns])
    scales = np.array([heads[f"s_{c}"] or 0.0 for c in columns])
    matrix = np.zeros((k, k))
    for row in correlations(units, columns).collect():
        i, j = at[row["first"]], at[row["second"]]
        matrix[i, j] = matrix[j, i] = 0.0 if row["correlation"] is None else row["correlation"]
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-values, kind="stable")
    values, loadings = np.clip(values[order], 0, None), vectors[:, order].T
    signs = np.sign(loadings.sum(axis=1))
    # A sum of zero leaves the sign to the first loading that is not zero.
    first = np.array([np.sign(row[np.flatnonzero(np.abs(row) > 1e-12)[0]]) if (np.abs(row) > 1e-12).any() else 1.0 for row in loadings])
    loadings = loadings * np.where(np.abs(loadings.sum(axis=1)) > 1e-9, signs, first)[:, None]
    return Components(tuple(columns), loadings, values / max(values.sum(), 1e-300), means, scales)
