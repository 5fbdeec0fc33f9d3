"""A sample of the registered queries against their SQL on the smallest tables."""

from pathlib import Path

import pytest

from oracle_check import compare, database

FOLDER = "/root/testdata/sf0.001"
SAMPLE = (
    "group_exposure", "concentration_distribution", "baseline_gap", "pairwise_gap", "percentile_index", "numeric_summary",
    "join_coverage", "did_contrast", "robust_ranking", "matched_band_contrast", "fixed_effect_ols",
    "share_tiers", "tier_profile", "median_classes", "tier_grid", "spline_curvature", "logistic_binary", "exposure_intervals", "coefficient_intervals",
)
needs_data = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, con, name):
    from expogrid.plans import catalog

    assert compare(spark, con, name, catalog.QUERIES[name], catalog.ORACLES[name], FOLDER) is None


@needs_data
def test_invariants(spark):
    from pyspark.sql import functions as F

    from expogrid.plans import panels as P

    units = P.customer_units(spark, FOLDER).select("unit", *[P.SCHEME.share(g) for g in P.SCHEME.groups])
    off = units.filter(F.abs(sum((F.col(P.SCHEME.share(g)) for g in P.SCHEME.baselines[1:]), F.col("b0_share")) - 1) > 1e-9)
    assert off.count() == 0 and units.count() == units.select("unit").distinct().count()


def test_entry_has_matching_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 90
