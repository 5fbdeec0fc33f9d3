"""Splines, logistic models, tiers and intervals against dense or brute-force computations."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from expogrid.operators import distributions, logistic, splines
from expogrid.operators.models import Regressor


def test_tails():
    # published table values
    for df, x in ((1, 3.841458820694124), (2, 5.991464547107979), (3, 7.814727903251179), (10, 18.307038053275146)):
        assert distributions.chi_square_tail(x, df) == pytest.approx(0.05, abs=1e-12)
    for df, t in ((1, 12.706204736432095), (4, 2.7764451051977987), (24, 2.0638985616280205), (1000, 1.9623390808264078)):
        assert distributions.student_quantile(0.975, df) == pytest.approx(t, rel=1e-9)
        assert distributions.student_quantile(0.025, df) == pytest.approx(-t, rel=1e-9)
    assert distributions.chi_square_tail(0.0, 3) == 1.0 and distributions.student_tail(0.0, 5) == pytest.approx(0.5)


@pytest.fixture(scope="module")
def curved():
    rng = np.random.default_rng(5)
    n = 900
    f = pd.DataFrame({"region": rng.choice(list("abc"), n), "sub": rng.integers(0, 6, n).astype(str), "x": np.where(rng.random(n) < 0.2, 0.0, rng.random(n))})
    f["straight"] = 3 * f.x + f.region.map({"a": 1.0, "b": 5.0, "c": -2.0})
    f["bent"] = 4 * np.maximum(f.x - 0.5, 0) ** 2 + 0.1 * rng.normal(size=n)
    f.loc[::31, "bent"] = np.nan
    return f


def as_rows(spark, f, schema):
    return spark.createDataFrame([tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in f.itertuples(index=False)], schema)


def test_splines_against_dense(spark, curved):
    df = as_rows(spark, curved, "region string, sub string, x double, straight double, bent double")
    probabilities = (0.05, 0.35, 0.65, 0.95)
    curves = splines.spline_models(df, "x", ["straight", "bent"], "region", "sub", probabilities)
    knots = np.quantile(curved.x[curved.x > 0], probabilities)
    assert np.allclose(curves[0].knots, knots, atol=1e-12)
    for c in curves:
        d = curved.dropna(subset=[c.fit.outcome])
        x = np.column_stack([d.x, splines.curved_values(d.x.to_numpy(), knots)])
        keys = [d.region] if c.fit.level == "region" else [d.region, d["sub"]]
        table = pd.DataFrame(np.column_stack([x, d[c.fit.outcome]]), index=d.index)
        table = (table - table.groupby(keys).transform("mean")).to_numpy()
        x, y = table[:, :-1], table[:, -1]
        bread = np.linalg.inv(x.T @ x)
        beta = bread @ x.T @ y
        assert np.allclose(c.fit.coefficients, beta, atol=1e-7)
        scores = pd.DataFrame(x * (y - x @ beta)[:, None], index=d.index).groupby([d.region, d["sub"]]).sum().to_numpy()
        g, n, k = len(scores), len(d), x.shape[1]
        v = bread @ scores.T @ scores @ bread * g / (g - 1) * (n - 1) / (n - k)
        if c.fit.outcome == "bent":
            assert c.wald == pytest.approx(beta[1:] @ np.linalg.solve(v[1:, 1:], beta[1:]), rel=1e-5) and c.p_value < 1e-6
            value, low, high = c.change(0.2, 0.9)
            assert low < value < high and value == pytest.approx(4 * 0.4**2, abs=0.1)
        else:
            assert np.abs(c.fit.coefficients[1:]).max() < 1e-6  # linear input has no curvature
            assert c.change(0.25, 0.75)[0] == pytest.approx(1.5, abs=1e-8)


def test_curves_are_straight_outside(spark):
    knots = [0.1, 0.3, 0.6, 0.9]
    x = np.array([-1.0, 0.0, 0.05, 0.95, 1.5, 2.05])
    got = np.array(spark.createDataFrame([(float(v),) for v in x], "x double").select(*[c.alias(f"c{i}") for i, c in enumerate(splines.curved_terms(F.col("x"), knots))]).collect())
    assert np.allclose(got, splines.curved_values(x, knots), atol=1e-12)
    assert np.allclose(got[:3], 0) and np.allclose(got[4] - got[3], got[5] - got[4])


def test_few_knots(spark):
    df = spark.createDataFrame([("a", str(i % 4), float(i % 2), float(i)) for i in range(40)], "region string, sub string, x double, y double")
    (curve,) = splines.spline_models(df, "x", ["y"], "region", "sub", levels=("region",))
    assert curve.knots == (1.0,) and curve.wald is None and curve.curved_terms == 0
    assert splines.spline_models(df.limit(0), "x", ["y"], "region", "sub") == []


def newton(x, y, groups):
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
    p = 1 / (1 + np.exp(-x @ beta))
    bread = np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x)
    scores = pd.DataFrame(x * (y - p)[:, None]).groupby(groups).sum().to_numpy()
    v = bread @ scores.T @ scores @ bread * len(scores) / (len(scores) - 1)
    return beta, np.sqrt(np.diag(v)), float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum())


def test_logistic_against_dense_newton(spark):
    rng = np.random.default_rng(8)
    n = 1200
    f = pd.DataFrame({"region": rng.choice(list("abc"), n), "sub": rng.integers(0, 5, n).astype(str), "a": rng.random(n), "b": 1e6 + 1e3 * rng.normal(size=n)})
    chance = lambda z: (rng.random(n) < 1 / (1 + np.exp(-z))).astype(float)
    f["y"] = chance(-1 + 2 * f.a - 0.001 * (f.b - 1e6))
    f["rare"] = chance(-5 + f.a)
    f.loc[::13, "rare"] = np.nan
    f["sure"] = (f.a > 0.5).astype(float)
    f["none"] = 0.0
    f["partly"] = np.where(f.region == "a", 1.0, f.y)
    df = as_rows(spark, f, "region string, sub string, a double, b double, y double, rare double, sure double, none double, partly double")
    terms = [Regressor("a", F.col("a"), "a"), Regressor("b", F.col("b"), "b"), Regressor("in_a", (F.col("region") == "a").cast("int"), "in a")]
    fits = {x.outcome: x for x in logistic.fit_logistic(df, ["y", "rare", "sure", "none", "partly"], terms, ["region", "sub"])}
    for outcome in ("y", "rare"):
        d = f.dropna(subset=[outcome]).reset_index(drop=True)
        beta, errors, value = newton(np.column_stack([d.a, d.b - 1e6, d.region == "a"]), d[outcome].to_numpy(), d.region + d["sub"])
        beta[0] -= 1e6 * beta[2]
        fit = fits[outcome]
        assert fit.status == logistic.CONVERGED and fit.observations == len(d) and fit.clusters == 15 and fit.rank == 4
        assert np.allclose(fit.coefficients[1:], beta[1:], rtol=1e-8, atol=1e-9) and fit.coefficients[0] == pytest.approx(beta[0], rel=1e-8)
        assert np.allclose(fit.errors[1:], errors[1:], rtol=1e-6) and fit.log_likelihood == pytest.approx(value, rel=1e-10)
    assert fits["sure"].status == logistic.SEPARATED and fits["sure"].errors is None
    assert fits["partly"].status == logistic.SEPARATED
    assert fits["none"].status == logistic.CONSTANT
    twice = [*terms[:1], Regressor("again", F.col("a"), "again"), Regressor("one", F.lit(1.0), "one")]
    (fit,) = logistic.fit_logistic(df, ["y"], twice, ["region", "sub"])
    assert fit.status == logistic.CONVERGED and fit.rank == 2 and fit.coefficients[1] == pytest.approx(fit.coefficients[2]) and fit.coefficients[3] == 0
    (fit,) = logistic.fit_logistic(df.limit(0), ["y"], terms, ["region"])
    assert fit.status == logistic.CONSTANT and fit.observations == 0
    with pytest.raises(ValueError):
        logistic.fit_logistic(df, ["b"], terms[:1], ["region"])


# ---------------------------------------------------------------- tiers and intervals


def slow_tiers(rows, n):
    """NTILE over (value, unit)."""
    out, ordered = {}, sorted((v, u) for u, v in rows if v is not None)
    size, more = divmod(len(ordered), n)
    at = 0
    for t in range(1, n + 1):
        for v, u in ordered[at : at + size + (t <= more)]:
            out[u] = t
        at += size + (t <= more)
    return out


@pytest.mark.parametrize("buckets", [4, 64])
def test_tiers_split_ties_by_unit(spark, buckets):
    rng = np.random.default_rng(3)
    rows = [(int(u), rng.choice(["a", "b"]), None if u % 19 == 0 else float(rng.choice([0.0, 0.0, 0.1, round(rng.random(), 2)]))) for u in rng.permutation(700)] + [(9000, None, 0.5), (9001, None, 0.2)]
    df = spark.createDataFrame([(u, g, v) for u, g, v in rows], "unit long, region string, v double")
    from expogrid.operators import tiers

    got = {r.unit: r.t for r in tiers.tiers(df, [], "v", "unit", 10, "t", buckets).collect()}
    assert got == slow_tiers([(u, v) for u, _, v in rows], 10)
    want = {}
    for region in ("a", "b", None):
        want |= slow_tiers([(u, v) for u, g, v in rows if g == region], 7)
    assert {r.unit: r.t for r in tiers.tiers(df, ["region"], "v", "unit", 7, "t", buckets).collect()} == want
    assert tiers.tiers(df.limit(0), [], "v", "unit", 10, "t").count() == 0
    ranks = {r.unit: r.r for r in tiers.relative_rank(df, ["region"], "v", "unit", 5, "r", buckets).collect()}
    own = [v for _, g, v in rows if g == "a" and v is not None]
    for u, g, v in rows:
        if g == "a" and v is not None:
            assert ranks[u] == pytest.approx(sum(x < v for x in own) / (len(own) - 1))
    assert ranks[9000] is None


def determined(hidden):
    """Hidden cells whose count row and column sums fix, by linear algebra."""
    cells = np.argwhere(hidden)
    n, m = hidden.shape
    sums = np.zeros((n + m, len(cells)))
    for k, (r, c) in enumerate(cells):
        sums[r, k] = sums[n + c, k] = 1
    rank = np.linalg.matrix_rank(sums) if len(cells) else 0
    return [np.linalg.matrix_rank(np.vstack([sums, np.eye(len(cells))[k]])) == rank for k in range(len(cells))]


def test_withheld_cells_cannot_be_worked_out():
    from expogrid.operators.tiers import follows, withheld

    rng = np.random.default_rng(4)
    for _ in range(300):
        shape = rng.integers(2, 6, 2)
        counts = rng.integers(0, 30, shape)
        state = withheld(counts, int(rng.integers(1, 12)))
        assert not any(determined(state > 0))
        some = rng.random(shape) < 0.4
        assert follows(some)[some].tolist() == determined(some)
    assert (withheld(np.array([[50, 60], [70, 80]]), 10) == 0).all()
    assert withheld(np.array([[5, 60, 70], [50, 20, 90], [50, 80, 90]]), 10).tolist() == [[1, 2, 0], [2, 2, 0], [0, 0, 0]]


def test_interval_coverage(spark):
    """95 % limits from 40 clusters hold the true exposure in about 95 % of simulated tables."""
    from expogrid.operators import intervals

    rng, rows = np.random.default_rng(12), []
    for trial in range(400):
        effect = rng.normal(0, 0.5, 40)
        size = rng.integers(5, 50, 40)
        rows += [("all", str(c), f"t{trial}", "x", float(size[c] * (2 + effect[c] + 0.1 * rng.normal())), float(size[c])) for c in range(40)]
    totals = spark.createDataFrame(rows, "region string, subregion string, group_code string, indicator_code string, num double, den double")
    got = intervals.exposure_intervals(totals, ["region", "subregion"], "none", replicates=100).collect()
    assert len(got) == 400
    for low, high in (("low", "high"), ("boot_low", "boot_high")):
        held = np.mean([r[low] <= 2 <= r[high] for r in got])
        assert 0.90 <= held <= 0.985
    assert all(r.clusters == 40 and r.ratio is None and abs(r.boot_error / r.standard_error - 1) < 0.5 for r in got)


def test_ratio_limits(spark):
    """Against the delta method by hand; a cluster with one group only counts in it alone."""
    from expogrid.operators import intervals

    rows = [("r", "1", "A", "x", 4.0, 10.0), ("r", "2", "A", "x", 9.0, 20.0), ("r", "3", "A", "x", 2.0, 5.0), ("r", "1", "B", "x", 1.0, 10.0), ("r", "2", "B", "x", 3.0, 10.0), ("r", "4", "B", "x", 2.0, 10.0)]
    df = spark.createDataFrame(rows, "region string, subregion string, group_code string, indicator_code string, num double, den double")
    got = {r.group_code: r for r in intervals.exposure_intervals(df, ["region", "subregion"], "B", 20).collect()}
    a, b = 15 / 35, 6 / 30
    score = {k: 0.0 for k in "1234"}
    for _, c, g, _, n, d in rows:
        score[c] += (n - a * d) / 35 / a if g == "A" else -(n - b * d) / 30 / b
    se = math.sqrt(sum(v * v for v in score.values()) * 4 / 3)
    t = distributions.student_quantile(0.975, 3)
    assert got["A"].ratio == pytest.approx(a / b) and got["A"].ratio_low == pytest.approx(a / b * math.exp(-t * se)) and got["A"].ratio_high == pytest.approx(a / b * math.exp(t * se))
    assert got["B"].ratio is None and got["B"].clusters == 3
    one = intervals.exposure_intervals(df.filter("subregion = '1'"), ["region", "subregion"], "B", 20).collect()
    assert all(r.low is None and r.standard_error is None for r in one)
    assert intervals.exposure_intervals(df.limit(0), ["region", "subregion"], "B", 20).count() == 0


def test_poisson_weights(spark):
    from expogrid.operators import intervals

    w = np.array([r[0] for r in spark.range(20000).select(intervals.poisson_weight(F.col("id").cast("string"), F.lit(7))).collect()])
    assert abs(w.mean() - 1) < 0.03 and abs(w.var() - 1) < 0.05 and abs((w == 0).mean() - math.exp(-1)) < 0.015


# ---------------------------------------------------------------- strata, compositions, weights, sketches


def test_strata_equal_separate_fits(spark, curved):
    from expogrid.operators import strata
    from expogrid.operators.models import fit_within

    f = curved.copy()
    f["kind"] = [["p", "q", None][i % 3] if i > 20 else "tiny" for i in range(len(f))]
    f["code"] = np.arange(len(f)) % 2
    f["x2"] = 1000 + f.x**2
    df = as_rows(spark, f[["region", "sub", "x", "straight", "bent", "kind", "code", "x2"]], "region string, sub string, x double, straight double, bent double, kind string, code long, x2 double")
    terms = [Regressor("x", F.col("x"), "x"), Regressor("x2", F.col("x2"), "x2"), Regressor("again", F.col("x") * 2, "again")]
    got = {(r.stratum, r.fixed_effect, r.outcome_code, r.regressor): r for r in strata.stratified_fits(df, ["bent", "straight"], terms, "kind", "region", "sub").collect()}
    for kind in ("p", "q", None):
        part = df.filter(F.col("kind").eqNullSafe(F.lit(kind)))
        for fit in fit_within(part, ["bent", "straight"], terms, "region", "sub"):
            for i, t in enumerate(terms):
                r = got[kind, f"{fit.level} fixed effects", fit.outcome, t.name]
                assert (r.observations, r.clusters, r.matrix_rank) == (fit.observations, fit.clusters, fit.rank)
                assert r.coefficient == pytest.approx(fit.coefficients[i], rel=1e-6, abs=1e-8) and r.standard_error == pytest.approx(fit.errors[i], rel=1e-5, abs=1e-8)
    few = strata.stratified_fits(df, ["bent"], terms[:1], "kind", "region", "sub", least=50)
    assert {r.stratum for r in few.select("stratum").distinct().collect()} == {"p", "q", None}
    assert strata.stratified_fits(df.limit(0), ["bent"], terms[:1], "kind", "region", "sub").count() == 0


def test_log_ratios_come_back(spark):
    from expogrid.operators import logratios

    rows = [(3.0, 1.0, 6.0, 2.0), (0.0, 5.0, 0.0, 5.0), (1.0, 1.0, 1.0, 1.0), (0.0, 0.0, 0.0, 0.0), (None, 1.0, 1.0, 1.0), (-1.0, 2.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    shares = logratios.closed([F.col(c) for c in "abcd"], 0.01)
    got = df.select(F.array(*shares).alias("s"), F.array(*logratios.coordinates(shares)).alias("z")).collect()
    assert got[0].s == pytest.approx([0.25, 1 / 12, 0.5, 1 / 6]) and got[1].s == pytest.approx([0.01, 0.49, 0.01, 0.49])
    for r in got[:3]:
        assert np.allclose(logratios.shares_of(r.z)[0], r.s, atol=1e-14)
    assert np.allclose(got[2].z, 0) and all(r.s == [None] * 4 and r.z == [None] * 3 for r in got[3:])
    norm = np.log(np.array(got[0].s)) - np.log(np.array(got[0].s)).mean()
    assert np.linalg.norm(got[0].z) == pytest.approx(np.linalg.norm(norm))  # isometric


def test_component_weights(spark):
    from expogrid.operators import weights

    rng = np.random.default_rng(1)
    base = rng.normal(size=500)
    f = pd.DataFrame({"a": base + 0.3 * rng.normal(size=500), "b": -base + 0.5 * rng.normal(size=500), "c": rng.normal(size=500), "flat": 2.0})
    f.loc[::7, "b"] = np.nan
    df = as_rows(spark, f, "a double, b double, c double, flat double")
    found = weights.principal_components(df, list(f.columns))
    want = f.corr().fillna(0).to_numpy()
    values, vectors = np.linalg.eigh(want)
    assert np.allclose(np.sort(found.shares), np.sort(np.clip(values, 0, None) / values.clip(0).sum()), atol=1e-9)
    assert np.allclose(np.abs(found.loadings[0]), np.abs(vectors[:, -1]), atol=1e-8) and (found.loadings.sum(axis=1) > -1e-9).all()
    z = (f - f.mean()) / f.std().replace(0, np.nan)
    w = found.loadings[0]
    index = (z.fillna(0) * w).sum(axis=1) / (z.notna() * np.abs(w)).sum(axis=1)
    got = [r[0] for r in df.select(found.index()).collect()]
    assert np.allclose(got, index, atol=1e-9)
    assert {(r.first, r.second): r.pairs for r in weights.correlations(df, ["a", "b"]).collect()}["a", "b"] == int(f.b.notna().sum())


@pytest.mark.parametrize("n", [50, 5_000, 200_000])
def test_sketched_quantiles_keep_their_error(spark, n):
    from expogrid.operators import audit

    df = spark.range(n).select(F.when(F.col("id") % 11 != 0, (F.col("id") * 7919) % n).alias("v"), F.lit(None).cast("double").alias("none"))
    exact = sorted((i * 7919) % n for i in range(n) if i % 11)
    for error in (0.1, 0.01):
        rows = {r.column_name: r for r in audit.numeric_summary({"t": (df, ["v", "none"])}, rank_error=error).collect()}
        for name, p in audit.SPOTS.items():
            value = rows["v"][name]
            low, high = np.searchsorted(exact, value, "left") / len(exact), np.searchsorted(exact, value, "right") / len(exact)
            assert low - error - 1 / len(exact) <= p <= high + error + 1 / len(exact)
        assert rows["v"].missing == n - len(exact) and rows["none"].median is None and rows["none"].nonmissing == 0
