import pytest
from pyspark.sql import functions as F

from expogrid.functions import columns as C


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


@pytest.mark.parametrize("edges", [C.BAND_EDGES, C.COARSE_EDGES])
def test_band_edges(spark, edges):
    """An edge closes its band; the next begins right above it."""
    near = 1e-9
    shares, bands = [0.0, near, 1.0, 1.7, None], [0, 1, len(edges) + 1, len(edges) + 1, None]
    for i, e in enumerate(edges, 1):
        shares += [e - near, e, e + near]
        bands += [i, i, i + 1]
    got = one(spark, [(s,) for s in shares], "share double", C.band("share", edges))
    assert [g[0] for g in got] == bands


def test_band_labels(spark):
    got = one(spark, [(i,) for i in (0, 8, 9, None)], "b int", C.band_label("b"))
    assert [g[0] for g in got] == ["0%", ">75-100%", None, None]


def test_typed_whole_numbers(spark):
    texts = ["12.5", "1e3", " 7 ", "", "x", "NaN", "1e30", "-2.5", None]
    got = one(spark, [(t,) for t in texts], "t string", C.typed("t", "bigint"), C.typed("t", "bigint", strict=True))
    assert [g[0] for g in got] == [13, 1000, 7, None, None, None, None, -3, None]
    assert [g[1] for g in got] == [None, None, 7, None, None, None, None, None, None]


def test_ratio_and_means(spark):
    rows = [(1, 0, None), (3, 2, 4), (None, None, None)]
    got = one(spark, rows, "a long, b long, c long", C.ratio("a", "b", 10), C.mean_of_observed(["a", "b", "c"], 100), C.total_of(["a", "b", "c"]))
    assert got == [(None, 50.0, 1), (15.0, 300.0, 9), (None, None, 0)]


def test_flags(spark):
    rows = [(1, 1), (1, 0), (1, None), (None, 0)]
    got = one(spark, rows, "a int, b int", C.all_members(["a", "b"]), C.member_mask(["a", "b"], "observed"), C.member_mask(["a", "b"], "adverse"))
    assert got == [(1, 3, 3), (0, 3, 1), (None, 1, 1), (None, 2, 0)]


def test_coded(spark):
    got = one(spark, [(1,), (2,), (3,), (None,)], "a long", C.coded("a", (2, 3), (1,)), C.holds(F.col("a") > 1))
    assert got == [(0, 0), (1, 1), (1, 1), (None, 0)]


def test_two_denominators(spark):
    df = spark.createDataFrame([(1.0, 2), (None, 2), (0.0, 4)], "x double, w long")
    got = df.agg(C.weighted_mean("x", "w"), C.weighted_mean("x", "w", "all"), C.weighted_mean("x", F.lit(0))).first()
    assert tuple(got) == (2 / 6, 2 / 8, None)
    with pytest.raises(ValueError):
        C.weighted_mean("x", "w", "other")


def test_more_flags_than_one_mask_holds(spark):
    flags = [F.lit(i % 2) for i in range(130)]
    masks = spark.range(1).select(*C.member_masks(flags, "adverse")).first()
    assert [bin(m).count("1") for m in masks] == [31, 31, 3]
