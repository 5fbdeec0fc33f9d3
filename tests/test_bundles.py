from pyspark.sql import functions as F

from expogrid.functions.model import Bundle, Group, GroupScheme
from expogrid.operators import bundles as B

TWO = GroupScheme((Group("A0", "focal"), Group("B0", "base")))
UNIT, WEIGHTED = B.UNIT_PREVALENCE, B.WEIGHTED_EXPOSURE


def test_matched_bands_and_summary(spark):
    # estimand, group, band, percent
    values = [(UNIT, "A0", 0, 10.0), (UNIT, "A0", 8, 40.0), (UNIT, "B0", 0, 8.0), (UNIT, "B0", 8, 22.0),
              (WEIGHTED, "A0", 1, 12.0), (WEIGHTED, "A0", 8, 44.0), (WEIGHTED, "B0", 1, 9.0), (WEIGHTED, "B0", 8, 24.0)]
    rows = spark.createDataFrame(
        [("s", "N", "x", e, g, b, v, 20000, 100) for e, g, b, v in values],
        "scope string, area string, bundle_code string, estimand string, group_code string, band_order int, exposure_percent double, eligible_weight long, eligible_units long",
    )
    keys = ["scope", "area", "bundle_code"]
    matched = B.matched_bands(rows, [*keys, "estimand"], TWO)
    assert matched.count() == 18
    got = {r["estimand"]: r for r in B.gradient_summary(matched, keys).collect()}
    assert got[UNIT]["high_gap_pp"] == 18.0 and got[UNIT]["gradient_difference_pp"] == 16.0 and got[UNIT]["low_band"] == "0%"
    assert got[WEIGHTED]["low_band"] == ">0-5%" and got[WEIGHTED]["gradient_difference_pp"] == 17.0
    full = B.matched_bands(rows, [*keys, "estimand"], TWO, [("s", "N", "x", UNIT), ("s", "M", "x", UNIT)])
    assert full.filter("area = 'M'").count() == 9 and full.filter("area = 'M' AND gap_pp IS NOT NULL").count() == 0


def test_exposure_keeps_empty_cells(spark):
    rows = spark.createDataFrame(
        [("r", "A0", 10, 4, 6, 1, None, 0.1), ("r", "A0", 5, 2, 3, 1, 1, 0.9), ("q", "A0", 7, 3, 4, None, None, 0.9)],
        "region string, group_code string, group_students long, group_boys long, group_girls long, p int, q int, group_share double",
    )
    chosen = (Bundle("one", "", ("p",)), Bundle("both", "", ("p", "q"), "girls"))
    got = {(r["region"], r["bundle_code"]): r for r in B.bundle_exposure(rows, chosen, TWO, ["region", "group_code"]).collect()}
    assert got["r", "one"]["exposure_percent"] == 100.0 and got["r", "one"]["eligible_units"] == 2
    assert (got["r", "both"]["eligible_weight"], got["r", "both"]["affected_weight"]) == (3, 3)
    assert (got["q", "both"]["eligible_weight"], got["q", "both"]["exposure_percent"]) == (0, None)


def test_ranking_needs_every_baseline(spark):
    rows = spark.createDataFrame(
        [("x", 5.0, 2.0, 9.0, 20000, 20000, 30, 30), ("x", 3.0, -1.0, 9.0, 20000, 20000, 30, 30),
         ("y", 5.0, 2.0, 9.0, 20000, 20000, 30, 30), ("y", None, 2.0, 9.0, None, 20000, 30, 30)],
        "k string, high_gap_pp double, did_pp double, focal_high_percent double, focal_high_weight long, baseline_high_weight long, focal_high_units long, baseline_high_units long",
    ).withColumn("focal_change_pp", F.lit(1.0))
    got = {r["k"]: r for r in B.with_rank(B.robust_ranking(rows, ["k"]), ["k"]).collect()}
    assert (got["x"]["min_high_gap_pp"], got["x"]["mean_high_gap_pp"], got["x"]["worse_than_all"], got["x"]["steeper_than_all"]) == (3.0, 4.0, True, False)
    assert got["y"]["min_high_gap_pp"] is None and not got["y"]["adequate_cell"] and got["y"]["robust_rank"] == 2
    assert B.top_robust(B.robust_ranking(rows, ["k"]), ["k"]).count() == 0


def test_scopes_and_areas(spark):
    df = spark.createDataFrame([("N", 1), ("S", 5), (None, 9)], "region string, m int")
    out = B.in_areas(B.in_scopes(df, {"all": F.lit(True), "low": F.col("m").isin(1, 2)}), "region", ["N"])
    got = sorted(tuple(str(x) for x in r) for r in out.select("m", "scope", "area").collect())
    assert got == [("1", "all", "N"), ("1", "all", "NATIONAL"), ("1", "low", "N"), ("1", "low", "NATIONAL"), ("5", "all", "NATIONAL"), ("9", "all", "NATIONAL")]
