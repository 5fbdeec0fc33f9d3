import numpy as np
import pandas as pd
import pytest

from expogrid.operators.ranking import percent_ranks, quantiles


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    n = 900
    value = np.where(rng.random(n) < 0.4, 0.0, rng.integers(0, 60, n) / 7.0)  # one value holds over a third
    frame = pd.DataFrame({"unit": np.arange(n), "region": rng.choice(["a", "a", "a", "b", None], n), "v": value})
    frame.loc[rng.random(n) < 0.1, "v"] = np.nan
    return frame


def as_spark(spark, frame):
    clean = [tuple(None if pd.isna(x) else x for x in r) for r in frame.astype(object).itertuples(index=False)]
    return spark.createDataFrame(clean, "unit long, region string, v double")


@pytest.mark.parametrize("buckets", [4, 64])
def test_quantiles(spark, rows, buckets):
    got = {r["region"]: r for r in quantiles(as_spark(spark, rows), ["region"], "v", {"p10": 0.1, "median": 0.5}, buckets).collect()}
    for region, part in rows.groupby(rows.region.fillna("none")):
        r = got[None if region == "none" else region]
        assert r["p10"] == pytest.approx(part.v.quantile(0.1)) and r["median"] == pytest.approx(part.v.quantile(0.5))


def test_percent_rank_counts_missing_rows(spark, rows):
    got = percent_ranks(as_spark(spark, rows), "unit", "region", {"v": "rank"}, 16).toPandas().set_index("unit")["rank"]
    place = rows.groupby(rows.region.fillna("none")).v.rank(method="min") - 1
    size = rows.groupby(rows.region.fillna("none")).unit.transform("size") - 1
    want = (place / size)[rows.v.notna()]
    assert len(got) == len(want)
    assert np.allclose(got.sort_index().to_numpy(), want.to_numpy())


def test_single_row(spark):
    df = spark.createDataFrame([(1, "a", 3.0)], "unit long, region string, v double")
    assert percent_ranks(df, "unit", "region", {"v": "rank"}).first()["rank"] == 0.0
