"""Compositions as isometric log-ratios: parts that sum to one become free coordinates for a regression."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import holds


def closed(parts: Sequence[Column], zero: float) -> list[Column]:
    """Parts as shares of their sum with zeros replaced: each zero becomes ``zero`` and the others shrink in proportion, so
    that ratios between parts that are not zero stay as they are. NULL where a part is missing or negative or all are zero.
    """
    d = [p.cast("double") for p in parts]
    total = sum(d[1:], d[0])
    valid = total > 0
    for p in d:
        valid = valid & (p >= 0)
    zeros = sum((holds(p == 0) for p in d[1:]), holds(d[0] == 0))
    return [F.when(valid, F.when(p == 0, F.lit(zero)).otherwise(p / total * (F.lit(1.0) - F.lit(zero) * zeros))) for p in d]


def coordinates(shares: Sequence[Column]) -> list[Column]:
    """One coordinate less than shares: each part against the geometric mean of those after it, on an orthonormal basis."""
    n, logs = len(shares), [F.log(s) for s in shares]
    out = []
    for i in range(n - 1):
        rest = n - i - 1
        out.append((logs[i] - sum(logs[i + 2 :], logs[i + 1]) / F.lit(float(rest))) * F.lit(math.sqrt(rest / (rest + 1))))
    return out


def shares_of(coordinates_: np.ndarray) -> np.ndarray:
    """The shares that rows of coordinates stand for: the exact way back."""
    z = np.atleast_2d(np.asarray(coordinates_, float))
    n = z.shape[1] + 1
    basis = np.zeros((n - 1, n))
    for i in range(n - 1):
        rest = n - i - 1
        basis[i, i], basis[i, i + 1 :] = 1.0, -1.0 / rest
        basis[i] *= math.sqrt(rest / (rest + 1))
    parts = np.exp(z @ basis)
    return parts / parts.sum(axis=1, keepdims=True)
