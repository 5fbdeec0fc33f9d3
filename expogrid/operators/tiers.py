"""Equal tiers of rows, grids of them with small cells withheld, and classes around regional medians."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keys import join_on
from .ranking import ordered_counts, quantiles


def places(df: DataFrame, keys: Sequence[str], value: str, unit: str, buckets: int = 256) -> DataFrame:
    """Each row's ``__place`` from 0 on and the ``__total`` of its keys, in the order of the value and then of the unit.

    Rows without a value have no place. ``unit`` is a number that is unique within keys. Places come from counts of
    values in buckets; only rows whose value ties are ordered by unit as well, in buckets again, so neither a key nor a
    tie that holds a third of all rows is ever sorted in one task.
    """
    keys = list(keys)
    rows = df.select(*keys, value, unit).filter(F.col(value).isNotNull())
    counted = ordered_counts(rows, keys, value, buckets).select(*keys, value, "__n", F.col("__before").alias("__base"), F.col("__total").alias("__whole"))
    met = join_on(rows, counted, [*keys, value])
    alone = met.filter(F.col("__n") == 1).select(*keys, value, unit, F.col("__base").alias("__place"), F.col("__whole").alias("__total"))
    tied = met.filter(F.col("__n") > 1)
    inside = ordered_counts(tied.select(*keys, value, unit), [*keys, value], unit, buckets).select(*keys, value, unit, "__before")
    together = join_on(tied, inside, [*keys, value, unit])
    return alone.unionByName(together.select(*keys, value, unit, (F.col("__base") + F.col("__before")).alias("__place"), F.col("__whole").alias("__total")))


def tier(place: Column, total: Column, n: int) -> Column:
    """Tier 1 to n of a place: sizes differ by one at most and the first tiers are the larger ones, as in NTILE."""
    size, more = F.floor(total / n), total % n
    edge = more * (size + 1)
    return F.when(place < edge, F.floor(place / (size + 1)) + 1).otherwise(more + F.floor((place - edge) / F.greatest(size, F.lit(1))) + 1).cast("int")


def tiers(df: DataFrame, keys: Sequence[str], value: str, unit: str, n: int, name: str, buckets: int = 256) -> DataFrame:
    """(unit, name): the tier of each row that has a value, within its keys."""
    return places(df, keys, value, unit, buckets).select(unit, tier(F.col("__place"), F.col("__total"), n).alias(name))


def relative_rank(df: DataFrame, keys: Sequence[str], value: str, unit: str, least: int, name: str, buckets: int = 256) -> DataFrame:
    """(unit, name): percent rank of the value among the rows of its keys that have one; NULL where these are fewer than ``least``."""
    keys = list(keys)
    rows = df.select(*keys, value, unit).filter(F.col(value).isNotNull())
    counted = ordered_counts(rows, keys, value, buckets)
    rank = F.when((F.col("__total") >= least) & (F.col("__total") > 1), F.col("__before") / (F.col("__total") - 1))
    return join_on(rows, counted.select(*keys, value, rank.alias(name)), [*keys, value]).select(unit, name)


def share_tiers(units: DataFrame, shares: Sequence[str], unit: str, region: str, subregion: str, n: int = 10, least: int = 10) -> DataFrame:
    """One row per unit and share: its tier among all units and in its region, of those with a positive share, and its
    relative rank in its subregion, of all units there.
    """
    out = None
    for s in shares:
        positive = units.filter(F.col(s) > 0)
        own = units.select(unit, F.lit(s).alias("share"), F.col(s).alias("value"))
        for part in (
            tiers(positive, [], s, unit, n, "national_tier"), tiers(positive, [region], s, unit, n, "region_tier"),
            relative_rank(units, [region, subregion], s, unit, least, "subregion_rank"),
        ):
            own = own.join(part, unit, "left")
        out = own if out is None else out.unionByName(own)
    return out


def tier_profile(units: DataFrame, tiered: DataFrame, unit: str, outcomes: Sequence[str], weight: str) -> DataFrame:
    """By national tier and outcome: units, their plain mean and the mean weighted by ``weight``, over units with a value."""
    values = F.inline(F.array(*[F.struct(F.lit(o).alias("outcome_code"), F.col(o).cast("double").alias("y")) for o in outcomes]))
    long = units.select(unit, F.col(weight).alias("w"), values).filter(F.col("y").isNotNull())
    met = long.join(tiered.filter(F.col("national_tier").isNotNull()).select(unit, "share", "national_tier"), unit)
    return met.groupBy("share", "national_tier", "outcome_code").agg(
        F.count(F.lit(1)).alias("units"), F.avg("y").alias("plain_mean"), F.try_divide(F.sum(F.col("w") * F.col("y")), F.sum("w")).alias("weighted_mean")
    )


def median_classes(units: DataFrame, first: str, second: str, region: str) -> DataFrame:
    """``units`` with ``share_class``: low or high of both shares, high being above the region's median; NULL without both shares."""
    middle = quantiles(units.filter(F.col(first).isNotNull()), [region], first, {"__first": 0.5})
    other = quantiles(units.filter(F.col(second).isNotNull()), [region], second, {"__second": 0.5})
    placed = join_on(join_on(units, middle, [region], "left"), other, [region], "left")
    side = lambda c, m: F.when(F.col(c) > F.col(m), "high").when(F.col(c).isNotNull() & F.col(m).isNotNull(), "low")
    return placed.withColumn("share_class", F.concat(side(first, "__first"), F.lit("-"), side(second, "__second"))).drop("__first", "__second")


def tier_grid(units: DataFrame, first: str, second: str, unit: str, outcomes: Sequence[str], n: int = 5, least: int = 10) -> DataFrame:
    """One row per outcome and cell of two tiers: units, mean, and whether the cell itself is too small to be shown.

    A cell is small with fewer than ``least`` units that have the outcome; cells that no unit is in are not listed.
    """
    a, b = (tiers(units.filter(F.col(s).isNotNull()), [], s, unit, n, f"{name}_tier") for s, name in ((first, "first"), (second, "second")))
    values = F.inline(F.array(*[F.struct(F.lit(o).alias("outcome_code"), F.col(o).cast("double").alias("y")) for o in outcomes]))
    long = units.select(unit, values).filter(F.col("y").isNotNull())
    cells = long.join(a, unit).join(b, unit).groupBy("outcome_code", "first_tier", "second_tier").agg(F.count(F.lit(1)).alias("units"), F.avg("y").alias("mean"))
    return cells.withColumn("small", F.col("units") < least)


def follows(hidden: np.ndarray) -> np.ndarray:
    """Hidden cells of a table whose counts follow from row and column sums and the cells shown.

    Rows and columns are the nodes of a graph and hidden cells its edges. A cell's count can change only along a cycle
    through it, so it follows exactly if its edge is a bridge.
    """
    n, m = hidden.shape
    out = np.zeros_like(hidden)
    for r, c in zip(*np.nonzero(hidden)):
        seen, todo = {int(r)}, [int(r)]
        while todo:
            node = todo.pop()
            row = node < n
            for other in np.flatnonzero(hidden[node] if row else hidden[:, node - n]).tolist():
                if (node, other) == (r, c) or (not row and (other, node - n) == (r, c)):
                    continue
                to = other + n if row else other
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        out[r, c] = int(c) + n not in seen
    return out


def withheld(counts: np.ndarray, least: int) -> np.ndarray:
    """0 for a cell shown, 1 for a small one, 2 for one withheld so that no hidden count follows from sums.

    For each cell that follows, the cycle through it that withholds the fewest further units is taken. Where the table
    offers no cycle (one row or column), all of its line is withheld.
    """
    n, m = counts.shape
    small = (counts > 0) & (counts < least)
    hidden = small.copy()
    while True:
        bare = follows(hidden)
        if not bare.any():
            break
        r, c = (int(x) for x in np.argwhere(bare)[0])
        best, back, heap = {r: 0.0}, {}, [(0.0, r)]
        while heap:
            cost, node = heapq.heappop(heap)
            if cost > best[node]:
                continue
            for other in range(m if node < n else n):
                cell = (node, other) if node < n else (other, node - n)
                if cell == (r, c):
                    continue
                to = other + n if node < n else other
                price = cost + (0.0 if hidden[cell] else float(counts[cell]) + 1e-3)
                if price < best.get(to, np.inf):
                    best[to], back[to] = price, (node, cell)
                    heapq.heappush(heap, (price, to))
        if c + n not in back:
            hidden[:, :] = True
            break
        at = c + n
        while at != r:
            at, cell = back[at]
            hidden[cell] = True
    return np.where(small, 1, np.where(hidden, 2, 0))


GRID = "outcome_code string, first_tier int, second_tier int, status string, units long, mean double"


def protected_grid(cells: DataFrame, n: int = 5, least: int = 10) -> DataFrame:
    """The grid of ``tier_grid`` with every cell, its status (shown, small, complementary) and units and means only where shown.

    Row and column sums of an outcome may be published beside it: no hidden count follows from them. A group is one
    outcome's table of at most n x n counts.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        counts, means = np.zeros((n, n), np.int64), np.full((n, n), np.nan)
        at = part["first_tier"].to_numpy() - 1, part["second_tier"].to_numpy() - 1
        counts[at], means[at] = part["units"].to_numpy(), part["mean"].to_numpy()
        state = withheld(counts, least)
        i, j = np.indices((n, n)).reshape(2, -1)
        shown = state.ravel() == 0
        return pd.DataFrame({
            "outcome_code": part["outcome_code"].iloc[0], "first_tier": i.astype("int32") + 1, "second_tier": j.astype("int32") + 1,
            "status": np.array(["shown", "small", "complementary"])[state.ravel()],
            "units": pd.array(np.where(shown, counts.ravel(), 0), "Int64").copy(), "mean": np.where(shown, means.ravel(), np.nan),
        }).assign(units=lambda f: f["units"].mask(f["status"] != "shown"))

    return cells.groupBy("outcome_code").applyInPandas(run, GRID).withColumn("mean", F.nanvl("mean", F.lit(None).cast("double")))
