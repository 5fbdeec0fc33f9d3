"""Registered queries of the further designs: tiers, grids, splines, logistic models and intervals over the customers panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals, logistic, models, splines, tiers
from ..sources import sinks
from . import oracles as O
from . import panels as P
from .registry import register

SHARES = ("a0_share", "b0_share")
OUTCOMES = ("in_debt", "low_value", "line_price")
LEAST = 10


def _ntile(source: str, share: str, n: int, part: str = "") -> str:
    return f"SELECT unit, ntile({n}) OVER ({part} ORDER BY {share}, unit) AS t FROM {source}"


def _tiers_sql(share: str) -> str:
    return f"""SELECT u.unit, {O.text(share)} AS share, {O.rd(f'u.{share}', 'value')}, {O.whole('nt.t', 'national_tier')}, {O.whole('rt.t', 'region_tier')}, {O.rd('sr.r', 'subregion_rank')}
FROM u LEFT JOIN ({_ntile(f'u WHERE {share} > 0', share, 10)}) nt ON u.unit = nt.unit
LEFT JOIN ({_ntile(f'u WHERE {share} > 0', share, 10, 'PARTITION BY region')}) rt ON u.unit = rt.unit
LEFT JOIN (SELECT unit, CASE WHEN count(*) OVER (PARTITION BY region, subregion) >= {LEAST} THEN percent_rank() OVER (PARTITION BY region, subregion ORDER BY {share}) END AS r FROM u WHERE {share} IS NOT NULL) sr ON u.unit = sr.unit"""


@register("share_tiers", O.c1(O.union(map(_tiers_sql, SHARES))))
def share_tiers(spark, d):
    """Deciles of both shares among all units and by region, and relative ranks by subregion."""
    with sinks.stored(P.customer_units(spark, d).select("unit", "region", "subregion", *SHARES), "tier-units") as units:
        return sinks.store(tiers.share_tiers(units, SHARES, "unit", "region", "subregion", 10, LEAST), "share-tiers")


@register("tier_profile", O.c1(O.union(
    f"""SELECT {O.text(s)} AS share, {O.whole('t', 'national_tier')}, {O.text(y)} AS outcome_code, {O.whole('count(*)', 'units')}, {O.rd(f'avg({y})', 'plain_mean')}, {O.rd(O.wmean(y, 'total_qty'), 'weighted_mean')}
FROM u JOIN ({_ntile(f'u WHERE {s} > 0', s, 10)}) nt ON u.unit = nt.unit WHERE {y} IS NOT NULL GROUP BY t"""
    for s in SHARES for y in OUTCOMES)))
def tier_profile(spark, d):
    """Conditions by decile: the plain mean of units and the mean weighted by all members."""
    with sinks.stored(P.customer_units(spark, d).select("unit", "total_qty", "region", "subregion", *SHARES, *OUTCOMES), "tier-units") as units:
        tiered = None
        for s in SHARES:
            part = tiers.tiers(units.filter(F.col(s) > 0), [], s, "unit", 10, "national_tier").withColumn("share", F.lit(s))
            tiered = part if tiered is None else tiered.unionByName(part)
        return sinks.store(tiers.tier_profile(units, tiered, "unit", OUTCOMES, "total_qty"), "tier-profile")


@register("median_classes", O.c1(
    f"""SELECT region, share_class, {O.whole('count(*)', 'units')}, {', '.join(O.rd(f'avg({y})', y) for y in OUTCOMES)}
FROM (SELECT u.*, CASE WHEN a0_share > m.a THEN 'high' ELSE 'low' END || '-' || CASE WHEN b0_share > m.b THEN 'high' ELSE 'low' END AS share_class
 FROM u JOIN (SELECT region AS r, median(a0_share) AS a, median(b0_share) AS b FROM u GROUP BY region) m ON region = m.r) GROUP BY region, share_class"""))
def median_classes(spark, d):
    """Four classes of low and high shares against the region's medians."""
    units = P.customer_units(spark, d).select("region", *SHARES, *OUTCOMES)
    return tiers.median_classes(units, *SHARES, "region").groupBy("region", "share_class").agg(F.count(F.lit(1)).alias("units"), *[F.avg(y).alias(y) for y in OUTCOMES])


GRID_OUTCOMES = ("in_debt", "low_value")


def _cells(spark, d):
    return tiers.tier_grid(P.customer_units(spark, d).select("unit", *SHARES, *GRID_OUTCOMES), *SHARES, "unit", GRID_OUTCOMES, 5, LEAST)


@register("tier_grid", O.c1(O.union(
    f"""SELECT {O.text(y)} AS outcome_code, {O.whole('q1.t', 'first_tier')}, {O.whole('q2.t', 'second_tier')}, {O.whole(f'count(*) < {LEAST}', 'small')},
 {O.whole(f'CASE WHEN count(*) >= {LEAST} THEN count(*) END', 'units')}, {O.rd(f'CASE WHEN count(*) >= {LEAST} THEN avg({y}) END', 'mean')}
FROM u JOIN ({_ntile('u', 'a0_share', 5)}) q1 ON u.unit = q1.unit JOIN ({_ntile('u', 'b0_share', 5)}) q2 ON u.unit = q2.unit WHERE {y} IS NOT NULL GROUP BY q1.t, q2.t"""
    for y in GRID_OUTCOMES)))
def tier_grid(spark, d):
    """Quintile grid with small cells withheld."""
    shown = lambda c: F.when(~F.col("small"), F.col(c)).alias(c)
    return _cells(spark, d).select("outcome_code", "first_tier", "second_tier", "small", shown("units"), shown("mean"))


@register("protected_grid")
def protected_grid(spark, d):
    """The same grid with further cells withheld so that no hidden count follows from sums; tested against linear algebra."""
    return tiers.protected_grid(_cells(spark, d), 5, LEAST)


# ---------------------------------------------------------------- models

LEVELS = (("region", "region"), ("subregion", "region, subregion"))
KNOTS = (0.1, 0.5, 0.9)
#: Published two-sided 95 % points of the t distribution, by degrees of freedom.
T_POINTS = {20: 2.0859634472658364, 21: 2.0796138447276626, 22: 2.0738730679040147, 23: 2.0686576104190406, 24: 2.0638985616280205}


def t_point(clusters: str) -> str:
    return f"CASE {clusters} - 1 " + " ".join(f"WHEN {k} THEN {v}" for k, v in T_POINTS.items()) + " END"


def _cube(knot: str) -> str:
    return f"pow(greatest(a0_share - {knot}, 0.0), 3)"


def _spline_sql() -> str:
    """Three knots give one curved term, so the fit has two regressors in closed form and the joint test is its squared t."""
    out = []
    for y in OUTCOMES:
        for level, part in LEVELS:
            dm = lambda c: f"{c} - avg({c}) OVER (PARTITION BY {part})"
            out.append(f"""SELECT {O.text(level + ' fixed effects')} AS fixed_effect, {O.text(y)} AS outcome_code, {O.rd('k1', 'first_knot', 4)}, {O.rd('k2', 'middle_knot', 4)}, {O.rd('k3', 'last_knot', 4)},
 {O.rd('b1', 'linear', 4)}, {O.rd('b2', 'curve', 4)}, {O.rd('b2 * b2 / (f * v22)', 'wald', 4)}, {O.whole('b2 * b2 / (f * v22) > 3.841458820694124', 'curved')},
 {O.rd('ch', 'change_between_outer_knots', 4)}, {O.rd(f'ch - {t_point("gc")} * sqrt(f * (d1*d1*v11 + 2*d1*d2*v12 + d2*d2*v22))', 'change_low', 4)},
 {O.rd(f'ch + {t_point("gc")} * sqrt(f * (d1*d1*v11 + 2*d1*d2*v12 + d2*d2*v22))', 'change_high', 4)}, {O.whole('n', 'observations')}, {O.whole('gc', 'clusters')}
FROM (WITH kn AS (SELECT quantile_cont(a0_share, {KNOTS[0]}) AS k1, quantile_cont(a0_share, {KNOTS[1]}) AS k2, quantile_cont(a0_share, {KNOTS[2]}) AS k3 FROM u WHERE a0_share > 0),
 r AS (SELECT region, subregion, CAST({y} AS DOUBLE) AS y, a0_share AS x1, ({_cube('k1')} - {_cube('k2')} * (k3 - k1) / (k3 - k2) + {_cube('k3')} * (k2 - k1) / (k3 - k2)) / pow(k3 - k1, 2) AS x2
  FROM u, kn WHERE {y} IS NOT NULL AND a0_share IS NOT NULL),
 q AS (SELECT region, subregion, {dm('y')} AS y, {dm('x1')} AS x1, {dm('x2')} AS x2 FROM r),
 m AS (SELECT count(*) AS n, count(DISTINCT region || '|' || subregion) AS gc, sum(x1*x1) AS a, sum(x1*x2) AS b, sum(x2*x2) AS c, sum(x1*y) AS p, sum(x2*y) AS q FROM q),
 s AS (SELECT *, (c*p - b*q)/(a*c - b*b) AS b1, (a*q - b*p)/(a*c - b*b) AS b2, c/(a*c-b*b) AS i11, -b/(a*c-b*b) AS i12, a/(a*c-b*b) AS i22 FROM m),
 t AS (SELECT sum(x1*(y - b1*x1 - b2*x2)) AS s1, sum(x2*(y - b1*x1 - b2*x2)) AS s2 FROM q, s GROUP BY region, subregion),
 w AS (SELECT sum(s1*s1) AS m11, sum(s1*s2) AS m12, sum(s2*s2) AS m22 FROM t),
 v AS (SELECT s.*, (gc / (gc - 1.0)) * ((n - 1.0) / (n - 2.0)) AS f, i11*i11*m11 + 2*i11*i12*m12 + i12*i12*m22 AS v11, i12*i12*m11 + 2*i12*i22*m12 + i22*i22*m22 AS v22,
  i11*i12*m11 + (i11*i22 + i12*i12)*m12 + i12*i22*m22 AS v12 FROM s, w)
 SELECT *, k3 - k1 AS d1, (pow(k3 - k1, 3) - pow(k3 - k2, 3) * (k3 - k1) / (k3 - k2)) / pow(k3 - k1, 2) AS d2, b1 * d1 + b2 * d2 AS ch FROM v, kn)""")
    return O.union(out)


@register("spline_curvature", O.c1(_spline_sql()), 4)
def spline_curvature(spark, d):
    """Outcomes on a spline of the focal share with knots at exact quantiles, and the test of its curvature."""
    units = P.customer_units(spark, d).select("region", "subregion", "a0_share", *OUTCOMES)
    curves = splines.spline_models(units, "a0_share", OUTCOMES, "region", "subregion", KNOTS)
    table = splines.curve_table(spark, curves, [P.BY_CODE[o] for o in OUTCOMES])
    return table.select(
        "fixed_effect", "outcome_code", *[F.col("knots")[i].alias(f"{n}_knot") for i, n in enumerate(("first", "middle", "last"))], "linear", F.col("curve")[0].alias("curve"),
        "wald", (F.col("p_value") < 0.05).alias("curved"), "change_between_outer_knots", "change_low", "change_high", "observations", "clusters",
    )


LOGIT_OUTCOMES = ("in_debt", "big_lines", "deep_discount")


def _logit_sql(y: str) -> str:
    """With one 0/1 regressor the fitted chances are the two cells' own rates."""
    return f"""SELECT {O.text(y)} AS outcome_code, regressor, status, {O.rd("CASE WHEN status = 'converged' THEN b END", 'coefficient', 5)}, {O.rd("CASE WHEN status = 'converged' THEN sqrt(v * gc / (gc - 1.0)) END", 'standard_error', 5)},
 {O.rd("CASE WHEN status = 'converged' THEN exp(b) END", 'odds_ratio', 5)}, {O.whole('n', 'observations')}, {O.whole('pos', 'positives')}, {O.whole('gc', 'clusters')}, {O.rd("CASE WHEN status = 'converged' THEN ll END", 'log_likelihood', 4)}
FROM (WITH q AS (SELECT region, subregion, few_orders AS x, {y} AS y FROM u WHERE {y} IS NOT NULL AND few_orders IS NOT NULL),
 m AS (SELECT count(*) AS n, sum(y) AS pos, count(DISTINCT region || '|' || subregion) AS gc, sum(x) AS n1, sum(x*y) AS y1, count(*) - sum(x) AS n0, sum(y) - sum(x*y) AS y0 FROM q),
 r AS (SELECT *, y1 * 1.0 / n1 AS p1, y0 * 1.0 / n0 AS p0, CASE WHEN pos IN (0, n) THEN 'constant outcome' WHEN y1 IN (0, n1) OR y0 IN (0, n0) THEN 'separated' ELSE 'converged' END AS status FROM m),
 t AS (SELECT sum(CASE WHEN x = 0 THEN y - p0 ELSE 0 END) AS u0, sum(CASE WHEN x = 1 THEN y - p1 ELSE 0 END) AS u1 FROM q, r GROUP BY region, subregion),
 w AS (SELECT sum(u0*u0) AS m00, sum(u0*u1) AS m01, sum(u1*u1) AS m11 FROM t),
 z AS (SELECT *, n0*p0*(1-p0) AS h0, n1*p1*(1-p1) AS h1, CASE WHEN status = 'converged' THEN ln(p0/(1-p0)) END AS l0, CASE WHEN status = 'converged' THEN ln(p1/(1-p1)) END AS l1,
  CASE WHEN status = 'converged' THEN y0*ln(p0) + (n0-y0)*ln(1-p0) + y1*ln(p1) + (n1-y1)*ln(1-p1) END AS ll FROM r, w)
 SELECT 'intercept' AS regressor, l0 AS b, m00/NULLIF(h0*h0, 0) AS v, * FROM z
 UNION ALL SELECT 'few_orders', l1 - l0, m11/NULLIF(h1*h1, 0) + m00/NULLIF(h0*h0, 0) - 2*m01/NULLIF(h0*h1, 0), * FROM z)"""


@register("logistic_binary", O.c1(O.union(map(_logit_sql, LOGIT_OUTCOMES))), 5)
def logistic_binary(spark, d):
    """Odds of conditions by a 0/1 regressor, with errors clustered by subregion."""
    units = P.customer_units(spark, d).select("region", "subregion", "few_orders", *LOGIT_OUTCOMES)
    terms = [models.Regressor("few_orders", F.col("few_orders"), "few orders")]
    table = logistic.odds_table(spark, logistic.fit_logistic(units, LOGIT_OUTCOMES, terms, ["region", "subregion"]), terms, [P.BY_CODE[o] for o in LOGIT_OUTCOMES])
    likelihood = F.round(F.when(F.col("status") == logistic.CONVERGED, F.col("log_likelihood")), 4)
    return table.select("outcome_code", "regressor", "status", "coefficient", "standard_error", "odds_ratio", "observations", "positives", "clusters", likelihood.alias("log_likelihood"))


@register("logistic_controlled")
def logistic_controlled(spark, d):
    """Shares, log size and region dummies; tested against a dense Newton fit."""
    with sinks.stored(P.customer_units(spark, d).select("region", "subregion", "total_qty", *SHARES, *LOGIT_OUTCOMES), "logit-units") as units:
        terms = [models.Regressor(s, F.col(s), s) for s in SHARES] + [models.Regressor("log_size", F.log(F.lit(1.0) + F.col("total_qty")), "log size")]
        terms += models.dummies(units, "region", "region", "region")
        fits = logistic.fit_logistic(units, LOGIT_OUTCOMES, terms, ["region", "subregion"])
    return logistic.odds_table(spark, fits, terms, [P.BY_CODE[o] for o in LOGIT_OUTCOMES])


# ---------------------------------------------------------------- intervals

INTERVAL_OUTCOMES = tuple(P.BY_CODE[o] for o in ("in_debt", "low_value", "line_price"))
REPLICATES = 200


def _interval_sql() -> str:
    totals = O.union(
        f"SELECT region, subregion, group_code, {O.text(i.code)} AS ic, sum({O.weight(i, P.SCHEME)} * CAST({i.code} AS DOUBLE)) AS num, sum(CASE WHEN {i.code} IS NOT NULL THEN {O.weight(i, P.SCHEME)} END) * 1.0 AS den FROM g GROUP BY region, subregion, group_code"
        for i in INTERVAL_OUTCOMES)
    steps = " + ".join(f"CASE WHEN x >= {p!r} THEN 1 ELSE 0 END" for p in intervals.POISSON)
    extra = f""",
ct AS (SELECT * FROM ({totals}) WHERE den > 0),
wh AS (SELECT group_code, ic, sum(num) AS an, sum(den) AS ad, count(*) AS gc FROM ct GROUP BY group_code, ic),
sc AS (SELECT ct.*, an, ad, gc, (num - an / ad * den) / ad AS z FROM ct JOIN wh USING (group_code, ic)),
pt AS (SELECT group_code, ic, max(gc) AS gc, max(an) / max(ad) AS e, sqrt(sum(z * z) * max(gc) / NULLIF(max(gc) - 1, 0)) AS se FROM sc GROUP BY group_code, ic),
lr AS (SELECT group_code, ic, sqrt(sum(s * s) * count(*) / NULLIF(count(*) - 1, 0)) AS le, count(*) AS pc FROM (
  SELECT region, subregion, group_code, ic, sum(s) AS s FROM (
    SELECT region, subregion, group_code, ic, z * ad / NULLIF(an, 0) AS s FROM sc
    UNION ALL SELECT b.region, b.subregion, wh.group_code, b.ic, -b.z * b.ad / NULLIF(b.an, 0) FROM sc b JOIN wh ON b.ic = wh.ic WHERE b.group_code = 'B0') GROUP BY 1, 2, 3, 4) GROUP BY group_code, ic),
dr AS (SELECT region, subregion, b, {steps} AS w FROM (SELECT region, subregion, b, CAST('0x' || substr(md5(region || '|' || subregion || '|' || b || '|'), 1, 13) AS BIGINT) / 4503599627370496.0 AS x
  FROM (SELECT DISTINCT region, subregion FROM ct), range(1, {REPLICATES + 1}) AS t(b))),
bs AS (SELECT group_code, ic, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi, stddev_samp(v) AS sd FROM (
  SELECT group_code, ic, b, sum(w * num) / NULLIF(sum(w * den), 0) AS v FROM ct JOIN dr USING (region, subregion) GROUP BY group_code, ic, b) GROUP BY group_code, ic)"""
    use = "group_code <> 'B0' AND e > 0 AND be > 0"
    body = f"""SELECT group_code, ic AS indicator_code, {O.whole('gc', 'clusters')}, {O.rd('e', 'exposure', 5)}, {O.rd('se', 'standard_error', 5)}, {O.rd(f'e - {t_point("gc")} * se', 'low', 5)}, {O.rd(f'e + {t_point("gc")} * se', 'high', 5)},
 {O.rd('lo', 'boot_low', 5)}, {O.rd('hi', 'boot_high', 5)}, {O.rd('sd', 'boot_error', 5)}, {O.rd(f'CASE WHEN {use} THEN e / be END', 'ratio', 5)},
 {O.rd(f'CASE WHEN {use} THEN e / be * exp(-{t_point("pc")} * le) END', 'ratio_low', 5)}, {O.rd(f'CASE WHEN {use} THEN e / be * exp({t_point("pc")} * le) END', 'ratio_high', 5)}
FROM pt JOIN bs USING (group_code, ic) JOIN lr USING (group_code, ic) LEFT JOIN (SELECT ic, e AS be FROM pt WHERE group_code = 'B0') USING (ic)"""
    return O.c1(body, extra)


@register("exposure_intervals", _interval_sql(), 5)
def exposure_intervals(spark, d):
    """Exposures by group with t limits from clusters and bootstrap limits, and ratios to the baseline with limits."""
    clusters = ["region", "subregion"]
    totals = sinks.store(intervals.cluster_totals(P.customer_long(spark, d), INTERVAL_OUTCOMES, P.SCHEME, clusters), "cluster-totals")
    return intervals.exposure_intervals(totals, clusters, "B0", REPLICATES)

