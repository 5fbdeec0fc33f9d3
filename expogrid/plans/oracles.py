"""Independent SQL for the registered queries, run by the checker on the same tables."""

from __future__ import annotations

import re
from itertools import combinations

from ..functions import rules as R
from ..functions.columns import BAND_EDGES, BAND_LABELS, COARSE_EDGES, COARSE_LABELS
from ..functions.model import GroupScheme, Indicator
from ..operators.bundles import UNIT_PREVALENCE, WEIGHTED_EXPOSURE
from ..operators.contrast import EVIDENCE
from ..operators.exposure import EQUAL_UNIT, GROUP_WEIGHTED
from ..presets import indicators as N
from ..presets import schools as S
from . import panels as P
from .schools import FIRST_OUTCOMES, FIRST_PERCENTS


def text(v: object) -> str:
    return "'" + str(v).replace("'", "''") + "'"


def rd(expr: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {name}"


def whole(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def wmean(x: str, w: str, denominator: str = "observed") -> str:
    below = f"sum(CASE WHEN {x} IS NOT NULL THEN {w} END)" if denominator == "observed" else f"sum({w})"
    return div(f"sum({w} * CAST({x} AS DOUBLE))", below)


def band(share: str, edges=BAND_EDGES) -> str:
    arms = " ".join(f"WHEN {share} <= {e} THEN {i}" for i, e in enumerate(edges, 1))
    return f"CASE WHEN {share} IS NULL THEN NULL WHEN {share} = 0 THEN 0 {arms} ELSE {len(edges) + 1} END"


def label(order: str, labels=BAND_LABELS) -> str:
    return f"CASE {order} " + " ".join(f"WHEN {i} THEN {text(t)}" for i, t in enumerate(labels)) + " END"


def flag(members) -> str:
    return f"CASE WHEN {' OR '.join(f'{m} IS NULL' for m in members)} THEN NULL WHEN {' AND '.join(f'{m} = 1' for m in members)} THEN 1 ELSE 0 END"


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def materialized(sql: str) -> str:
    """Every named part is computed once, however often it is read."""
    return re.sub(r"((?:^WITH|,)\s*\w+) AS \((?=\s*SELECT)", r"\1 AS MATERIALIZED (", sql, flags=re.M)


def groups_cte(scheme: GroupScheme, source: str = "u") -> str:
    return union(
        f"SELECT *, {text(g.code)} AS group_code, {text(g.label)} AS group_label, "
        + ", ".join(f"{scheme.column(g, m)} AS group_{m}" for m in scheme.measures)
        + f", {scheme.share(g)} AS group_share, {band(scheme.share(g))} AS band_order FROM {source}"
        for g in scheme.groups
    )


# ---------------------------------------------------------------- panel 1


def _customer_ctes() -> str:
    kinds = {"qty": "TRUE", "qty_o": "l_linestatus = 'O'", "qty_f": "l_linestatus = 'F'"}
    lines = ", ".join(
        f"sum(CASE WHEN {t} THEN l_quantity ELSE 0 END) AS {n}, sum(CASE WHEN {t} AND l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS r_{n}"
        for n, t in kinds.items()
    )
    terms = []
    for g in P.SCHEME.groups:
        group, item = g.item
        pre = "r_" if group == 2 else ""
        test = "TRUE" if group == 2 else f"p = {text(item)}"
        terms += [f"sum(CASE WHEN {test} THEN {pre}{m} ELSE 0 END) AS {g.prefix}_{m}" for m in P.SCHEME.measures]
        terms += [
            f"sum(CASE WHEN {test} AND y IN ({', '.join(map(str, years))}) THEN {pre}qty ELSE 0 END) AS {g.prefix}_{s}" for s, _, years in P.STAGES
        ]
    totals = ", ".join(f"{' + '.join(P.SCHEME.column(g, m) for g in P.SCHEME.baselines)} AS total_{m}" for m in P.SCHEME.measures)
    shares = ", ".join(f"{div(P.SCHEME.column(g), 'total_qty')} AS {P.SCHEME.share(g)}" for g in P.SCHEME.groups)
    return f"""
li AS (SELECT l_orderkey, count(*) AS lines, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents,
       sum(CAST(round(l_discount * 100) AS BIGINT)) AS points, {lines} FROM lineitem GROUP BY l_orderkey),
od AS (SELECT o_custkey AS unit, o_orderpriority AS p, year(o_orderdate) AS y, li.* FROM orders JOIN li ON o_orderkey = l_orderkey),
pv AS (SELECT unit, {', '.join(terms)}, sum(qty) AS sum_qty, count(*) AS sum_orders, sum(CASE WHEN y = 2001 THEN 1 ELSE 0 END) AS sum_recent,
       sum(lines) AS sum_lines, sum(cents) AS sum_cents, sum(points) AS sum_points FROM od GROUP BY unit),
cp AS (SELECT *, {shares}, {div('a0_qty_f', 'a0_qty')} AS a0_qty_f_share, total_qty - a0_qty - sum_qty AS residual_qty
       FROM (SELECT *, {totals} FROM pv)),
u AS (SELECT r_name AS region, n_name AS subregion, c_mktsegment AS segment, c_acctbal AS balance, cp.*,
       CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS in_debt, CASE WHEN sum_orders < 9 THEN 1 ELSE 0 END AS few_orders,
       CASE WHEN c_mktsegment <> 'BUILDING' THEN CASE WHEN sum_cents < sum_lines * 5000000 THEN 1 ELSE 0 END END AS low_value,
       CASE WHEN sum_points > sum_lines * 5 THEN 1 ELSE 0 END AS deep_discount,
       CASE WHEN sum_qty * 2 > sum_lines * 51 THEN 1 ELSE 0 END AS big_lines,
       CASE WHEN sum_recent = 0 THEN 1 ELSE 0 END AS no_recent,
       c_acctbal / sum_orders AS balance_per_order, CAST(sum_points AS DOUBLE) / sum_lines / 100.0 AS discount_share,
       CASE WHEN c_mktsegment <> 'MACHINERY' THEN CAST(sum_cents AS DOUBLE) / sum_lines / 100.0 END AS line_price
     FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
     JOIN cp ON cp.unit = c_custkey WHERE total_qty > 0),
g AS ({groups_cte(P.SCHEME)})"""


CUSTOMERS = _customer_ctes()


def c1(body: str, extra: str = "") -> str:
    return materialized(f"WITH {CUSTOMERS}{extra}\n{body}")


def weight(i: Indicator, scheme: GroupScheme) -> str:
    return f"group_{i.weight if i.weight in scheme.measures else scheme.main}"


def facts(i: Indicator) -> str:
    return (
        f"{text(i.code)} AS indicator_code, {text(i.level)} AS indicator_level, {text(i.domain)} AS domain, {text(i.label)} AS indicator_label, "
        f"{text(i.kind)} AS kind, {text(i.direction)} AS direction, {text(i.unit)} AS unit"
    )


def melted(source: str, keep: str, records) -> str:
    """records: (indicator, value column, extra select text)."""
    return union(
        f"SELECT {keep}, {extra}{facts(i)}, {rd(v, 'raw_value')}, {rd(f'{v} * {i.multiplier}', 'display_value')} FROM {source}" for i, v, extra in records
    )


def by_text(by) -> str:
    return "".join(f"{b}, " for b in by)


def exposure_cte(scheme, indicators, by=(), denominator="observed", where=None, source="g", forced=None, name="ex") -> str:
    where = where or f"group_{forced or scheme.main} > 0"
    sums = f"sum(group_{scheme.main}) AS group_{scheme.main}, sum(group_{scheme.measures[-1]}) AS group_{scheme.measures[-1]}"
    if forced:
        sums = f"sum(group_{forced}) AS weight_members"
    cols = ", ".join(f"{wmean(i.code, f'group_{forced}' if forced else weight(i, scheme), denominator)} AS {i.code}" for i in indicators)
    return f"{name} AS (SELECT {by_text(by)}group_code, group_label, {sums}, {cols} FROM {source} WHERE {where} GROUP BY {by_text(by)}group_code, group_label)"


def exposure_sql(scheme, indicators, by=(), name="ex") -> str:
    keep = f"{by_text(by)}group_code, group_label, {whole(f'group_{scheme.main}', f'group_{scheme.main}')}, {whole(f'group_{scheme.measures[-1]}', f'group_{scheme.measures[-1]}')}"
    return melted(name, keep, [(i, i.code, "") for i in indicators])


def long_exposure(indicators, by=(), source="ex") -> str:
    """Unrounded melt used inside gap queries."""
    return union(
        f"SELECT {by_text(by)}group_code, group_label, {facts(i)}, {i.code} AS v, {i.code} * {i.multiplier} AS d FROM {source}" for i in indicators
    )


def gaps_sql(scheme, by=(), directed=True) -> str:
    sign = "CASE WHEN a.direction = 'higher_better' THEN -1 ELSE 1 END" if directed else "1"
    same = " AND ".join(f"a.{k} = b.{k}" for k in (*by, "indicator_code"))
    keep = "".join(f"a.{b}, " for b in by)
    return f"""SELECT {keep}a.indicator_code, a.indicator_level, a.domain, a.indicator_label, a.direction, a.unit,
 b.group_code AS baseline_code, b.group_label AS baseline_label, {rd('a.v', 'focal_value')}, {rd('b.v', 'baseline_value')},
 {rd(f'(a.v - b.v) * {sign}', 'gap_raw')}, {rd(f'(a.d - b.d) * {sign}', 'gap_display')}
FROM lx a JOIN lx b ON {same} WHERE a.group_code = '{scheme.focal.code}' AND b.group_code <> '{scheme.focal.code}'"""


def pairs_sql(by=()) -> str:
    same = " AND ".join(f"a.{k} = b.{k}" for k in (*by, "indicator_code"))
    return f"""SELECT a.indicator_code, a.indicator_level, a.domain, a.indicator_label, a.unit, a.group_code AS left_group, b.group_code AS right_group,
 {rd('a.v', 'left_value')}, {rd('b.v', 'right_value')}, {rd('a.v - b.v', 'difference_raw')}, {rd('a.d - b.d', 'difference_display')}
FROM lx a JOIN lx b ON {same} WHERE a.group_code < b.group_code"""


def gradient_cte(scheme, indicators, by=(), source="g", name="gr") -> str:
    cols = ", ".join(f"avg(CAST({i.code} AS DOUBLE)) AS u__{i.code}, {wmean(i.code, weight(i, scheme))} AS w__{i.code}" for i in indicators)
    return (
        f"{name} AS (SELECT {by_text(by)}group_code, group_label, band_order, count(*) AS units, sum(group_{scheme.main}) AS group_members, {cols} "
        f"FROM {source} WHERE group_share IS NOT NULL GROUP BY {by_text(by)}group_code, group_label, band_order)"
    )


def gradient_sql(indicators, by=(), name="gr") -> str:
    keep = f"{by_text(by)}group_code, group_label, {whole('band_order', 'band_order')}, {label('band_order')} AS band, {whole('units', 'units')}, {whole('group_members', 'group_members')}"
    return melted(name, keep, [
        (i, f"{t}__{i.code}", f"{text(e)} AS estimand, ") for i in indicators for t, e in (("u", EQUAL_UNIT), ("w", GROUP_WEIGHTED))
    ])


def stage_sql(scheme, stages, source, by=()) -> str:
    out = []
    keys = ", ".join(by)
    for n, (s, title) in enumerate(stages):
        total = " + ".join(f"sum({g.prefix}_{s})" for g in scheme.baselines)
        for g in scheme.groups:
            out.append(
                f"SELECT {by_text(by)}{whole(n, 'stage_order')}, {text(title)} AS stage, {text(g.code)} AS group_code, {text(g.label)} AS group_label, "
                f"{whole(f'coalesce(sum({g.prefix}_{s}), 0)', 'members')}, {rd(div(f'sum({g.prefix}_{s}) * 100.0', total), 'share_percent')} FROM {source}"
                + (f" GROUP BY {keys}" if by else "")
            )
    return union(out)


def totals_sql(scheme, source="g") -> str:
    m = scheme.measures
    return (
        f"SELECT group_code, group_label, {', '.join(whole(f'sum(group_{x})', x) for x in m)}, {whole(f'sum({scheme.total()})', 'repeated_total')}, "
        f"{rd(div(f'sum(group_{m[0]}) * 100.0', f'sum({scheme.total()})'), 'share_percent')}, "
        f"{whole(f'sum(CASE WHEN group_{m[0]} > 0 THEN 1 ELSE 0 END)', 'units_with_group')}, {whole('count(*)', 'units')} FROM {source} GROUP BY 1, 2"
    )


def distribution_sql(scheme, by=(), source="g") -> str:
    keys = f"{by_text(by)}group_code"
    m = f"group_{scheme.main}"
    return f"""SELECT {by_text(by)}group_code, group_label, {whole('band_order', 'band_order')}, {label('band_order')} AS band,
 {whole('count(*)', 'units')}, {whole(f'sum({m})', 'group_members')}, {whole(f'sum({scheme.total()})', 'total_members')},
 {rd(f'count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY {keys})', 'unit_share_percent')},
 {rd(div(f'sum({m}) * 100.0', f'sum(sum({m})) OVER (PARTITION BY {keys})'), 'member_share_percent')}
FROM {source} GROUP BY {by_text(by)}group_code, group_label, band_order"""


def profile_sql(scheme, indicators, by, source="u") -> str:
    f = scheme.column(scheme.focal)
    cols = ", ".join(rd(f"{wmean(i.code, f, 'all')} * {i.multiplier}", i.code) for i in indicators)
    return f"""SELECT {by_text(by)}{whole('count(*)', 'units')}, {whole(f'sum({scheme.total()})', 'total_members')}, {whole(f'sum({f})', 'focal_members')},
 {rd(div(f'sum({f}) * 100.0', f'sum({scheme.total()})'), 'focal_share_percent')},
 {whole(f'sum(CASE WHEN {f} > 0 THEN 1 ELSE 0 END)', 'units_with_focal')}, {cols} FROM {source} GROUP BY {', '.join(by)}"""


def region_profile_sql(scheme, indicators, stages, region, stage_source="u") -> str:
    f, m = scheme.focal, f"group_{scheme.main}"
    cols = ", ".join(f"{wmean(i.code, weight(i, scheme))} * {i.multiplier} AS {i.code}" for i in indicators)
    total = lambda s: " + ".join(f"sum({g.prefix}_{s})" for g in scheme.baselines)
    shares = ", ".join(f"{div(f'sum({f.prefix}_{s}) * 100.0', total(s))} AS {s}_share_percent" for s, _ in stages)
    ends = f"{stages[-1][0]}_share_percent - {stages[0][0]}_share_percent"
    return f"""SELECT e.{region}, {rd('majority', 'majority_percent')}, {rd('supermajority', 'supermajority_percent')},
 {', '.join(rd(f'{s}_share_percent', f'{s}_share_percent') for s, _ in stages)}, {rd(ends, 'stage_change_pp')}, {', '.join(rd(f'e.{i.code}', i.code) for i in indicators)}
FROM (SELECT {region}, coalesce({div(f'sum(CASE WHEN band_order >= 7 THEN {m} END) * 100.0', f'sum({m})')}, 0) AS majority,
 {div(f'sum(CASE WHEN band_order = 8 THEN {m} END) * 100.0', f'sum({m})')} AS supermajority, {cols} FROM g WHERE group_code = '{f.code}' GROUP BY {region}) e
LEFT JOIN (SELECT {region}, {shares} FROM {stage_source} GROUP BY {region}) s ON e.{region} = s.{region}"""


def grid_sql(scheme, indicators, source="u") -> str:
    f = scheme.focal
    inner = union(
        f"SELECT *, {text(b.code)} AS baseline_code, {band(scheme.share(f), COARSE_EDGES)} AS fb, {band(scheme.share(b), COARSE_EDGES)} AS bb FROM {source}"
        for b in scheme.baselines
    )
    w = scheme.column(f)
    cols = ", ".join(f"avg(CAST({i.code} AS DOUBLE)) AS u__{i.code}, {wmean(i.code, w, 'all')} AS w__{i.code}" for i in indicators)
    keep = (
        f"baseline_code, {whole('fb', 'focal_band_order')}, {whole('bb', 'baseline_band_order')}, {label('fb', COARSE_LABELS)} AS focal_band, "
        f"{label('bb', COARSE_LABELS)} AS baseline_band, {whole('units', 'units')}, {whole('members', 'focal_members')}"
    )
    records = [(i, f"{t}__{i.code}", f"{text(e)} AS estimand, ") for i in indicators for t, e in (("u", EQUAL_UNIT), ("w", "focal-weighted mean"))]
    return f", gd AS (SELECT baseline_code, fb, bb, count(*) AS units, sum({w}) AS members, {cols} FROM ({inner}) GROUP BY 1, 2, 3)\n" + melted("gd", keep, records)


# bundles


def bundle_cte(bundles, scheme, by, source, name, banded=False) -> str:
    """Bundle exposures: units summed by which members they have observed and adverse, met with the bundles as rows."""
    keys = (*by, "band_order") if banded else tuple(by)
    where = "WHERE group_share IS NOT NULL" if banded else ""
    k = ", ".join(keys)
    members = list(dict.fromkeys(m for b in bundles for m in b.members))
    bits = lambda test: " + ".join(f"CASE WHEN {m} {test} THEN {1 << i} ELSE 0 END" for i, m in enumerate(members))
    listed = ", ".join(
        f"({text(b.code)}, {sum(1 << members.index(m) for m in b.members)}, {text(b.weight if b.weight in scheme.measures else scheme.main)})" for b in bundles
    )
    sums = ", ".join(f"sum(group_{m}) AS w_{m}" for m in scheme.measures)
    weight = "CASE measure " + " ".join(f"WHEN {text(m)} THEN w_{m}" for m in scheme.measures) + " END"
    seen, hit = "observed & need = need", "observed & need = need AND adverse & need = need"
    total = lambda test, what: f"sum(CASE WHEN {test} THEN {what} ELSE 0 END)"
    return f"""{name}_w AS (SELECT {k}, {bits('IS NOT NULL')} AS observed, {bits('= 1')} AS adverse, count(*) AS units, {sums} FROM {source} {where} GROUP BY ALL),
{name}_b(bundle_code, need, measure) AS (VALUES {listed}),
{name} AS (SELECT *, {div('affected_weight * 100.0', 'eligible_weight')} AS exposure_percent, {div('affected_units * 100.0', 'eligible_units')} AS unit_percent FROM (
 SELECT {k}, bundle_code, {total(seen, weight)} AS eligible_weight, {total(hit, weight)} AS affected_weight, {total(seen, 'units')} AS eligible_units, {total(hit, 'units')} AS affected_units
 FROM {name}_w CROSS JOIN {name}_b GROUP BY {k}, bundle_code))"""


def bundle_sql(by, name, banded=False) -> str:
    extra = f"{whole('band_order', 'band_order')}, {label('band_order')} AS band, " if banded else ""
    counts = ", ".join(whole(c, c) for c in ("eligible_weight", "affected_weight", "eligible_units", "affected_units"))
    return f"SELECT {by_text(by)}{extra}bundle_code, {counts}, {rd('exposure_percent', 'exposure_percent')}, {rd('unit_percent', 'unit_percent')} FROM {name}"


def contrast_cte(scheme, keys, overall, banded, name="ct") -> str:
    k = ", ".join(keys)
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in keys)
    f = scheme.focal.code
    labels = "CASE b.group_code " + " ".join(f"WHEN {text(g.code)} THEN {text(g.label)}" for g in scheme.baselines) + " END"
    return f"""lo AS (SELECT {k}, group_code, exposure_percent AS v FROM {banded} WHERE band_order = 1),
hi AS (SELECT {k}, group_code, exposure_percent AS v, eligible_weight AS w, eligible_units AS n FROM {banded} WHERE band_order = 8),
{name} AS (SELECT {', '.join(f'a.{c}' for c in keys)}, b.group_code AS baseline_code, {labels} AS baseline_label,
 a.exposure_percent AS focal_percent, b.exposure_percent AS baseline_percent, a.exposure_percent - b.exposure_percent AS gap_pp,
 al.v AS focal_low_percent, ah.v AS focal_high_percent, ah.v - al.v AS focal_change_pp,
 bl.v AS baseline_low_percent, bh.v AS baseline_high_percent, bh.v - bl.v AS baseline_change_pp,
 ah.v - bh.v AS high_gap_pp, (ah.v - al.v) - (bh.v - bl.v) AS did_pp,
 ah.w AS focal_high_weight, bh.w AS baseline_high_weight, ah.n AS focal_high_units, bh.n AS baseline_high_units
FROM {overall} a JOIN {overall} b ON {on('a', 'b')} AND a.group_code = '{f}' AND b.group_code <> '{f}'
LEFT JOIN lo al ON {on('a', 'al')} AND al.group_code = '{f}' LEFT JOIN hi ah ON {on('a', 'ah')} AND ah.group_code = '{f}'
LEFT JOIN lo bl ON {on('a', 'bl')} AND bl.group_code = b.group_code LEFT JOIN hi bh ON {on('a', 'bh')} AND bh.group_code = b.group_code)"""


CONTRAST_VALUES = (
    "focal_percent", "baseline_percent", "gap_pp", "focal_low_percent", "focal_high_percent", "focal_change_pp",
    "baseline_low_percent", "baseline_high_percent", "baseline_change_pp", "high_gap_pp", "did_pp",
)
CONTRAST_COUNTS = ("focal_high_weight", "baseline_high_weight", "focal_high_units", "baseline_high_units")


def contrast_sql(keys, name="ct") -> str:
    return (
        f"SELECT {by_text(keys)}baseline_code, baseline_label, {', '.join(rd(v, v) for v in CONTRAST_VALUES)}, "
        f"{', '.join(whole(c, c) for c in CONTRAST_COUNTS)} FROM {name}"
    )


def adequate(w: float, n: int) -> str:
    return (
        f"(coalesce(focal_high_weight, 0) >= {w} AND coalesce(baseline_high_weight, 0) >= {w} "
        f"AND coalesce(focal_high_units, 0) >= {n} AND coalesce(baseline_high_units, 0) >= {n})"
    )


def ranking_cte(keys, w, n, source="ct", name="rk") -> str:
    ok = "bool_and(high_gap_pp IS NOT NULL AND did_pp IS NOT NULL)"
    pick = lambda f: f"CASE WHEN {ok} THEN {f} END"
    return f"""{name} AS (SELECT *, coalesce(min_high_gap_pp > 0, FALSE) AS worse_than_all, coalesce(min_did_pp > 0, FALSE) AS steeper_than_all FROM (
 SELECT {', '.join(keys)}, max(focal_high_percent) AS focal_high_percent, max(focal_change_pp) AS focal_change_pp,
 {pick('min(high_gap_pp)')} AS min_high_gap_pp, {pick('avg(high_gap_pp)')} AS mean_high_gap_pp,
 {pick('min(did_pp)')} AS min_did_pp, {pick('avg(did_pp)')} AS mean_did_pp, bool_and({adequate(w, n)}) AS adequate_cell
 FROM {source} GROUP BY {', '.join(keys)}))"""


RANK_VALUES = ("focal_high_percent", "focal_change_pp", "min_high_gap_pp", "mean_high_gap_pp", "min_did_pp", "mean_did_pp")
RANK_FLAGS = ("adequate_cell", "worse_than_all", "steeper_than_all")


def ranking_sql(keys, source="rk", rank=False) -> str:
    order = f"adequate_cell DESC, worse_than_all DESC, steeper_than_all DESC, min_high_gap_pp DESC NULLS LAST, min_did_pp DESC NULLS LAST, {', '.join(keys)}"
    place = f", {whole(f'row_number() OVER (ORDER BY {order})', 'robust_rank')}" if rank else ""
    return f"SELECT {', '.join(keys)}, {', '.join(rd(v, v) for v in RANK_VALUES)}, {', '.join(whole(f, f) for f in RANK_FLAGS)}{place} FROM {source}"


def matched_cte(keys, gradients, focal, base, name="mb") -> str:
    """Dense over the key values found."""
    ks = ", ".join(keys)
    on = lambda t: " AND ".join(f"k.{c} = {t}.{c}" for c in keys)
    return f"""{name} AS (SELECT {', '.join(f'k.{c}' for c in keys)}, o AS band_order, a.exposure_percent AS focal_exposure_percent, b.exposure_percent AS baseline_exposure_percent,
 a.eligible_weight AS focal_eligible_weight, b.eligible_weight AS baseline_eligible_weight, a.eligible_units AS focal_eligible_units, b.eligible_units AS baseline_eligible_units,
 a.exposure_percent - b.exposure_percent AS gap_pp
FROM (SELECT DISTINCT {ks} FROM {gradients}) k, range(9) r(o)
LEFT JOIN {gradients} a ON {on('a')} AND a.band_order = o AND a.group_code = '{focal}'
LEFT JOIN {gradients} b ON {on('b')} AND b.band_order = o AND b.group_code = '{base}')"""


def summary_cte(keys, source="mb", name="sm") -> str:
    low = f"CASE WHEN estimand = {text(UNIT_PREVALENCE)} THEN 0 ELSE 1 END"
    at = lambda c, b: f"max(CASE WHEN band_order = {b} THEN {c} END)"
    return f"""{name} AS (SELECT *, focal_high_percent - baseline_high_percent AS high_gap_pp, focal_high_percent - focal_low_percent AS focal_change_pp,
 baseline_high_percent - baseline_low_percent AS baseline_change_pp,
 (focal_high_percent - focal_low_percent) - (baseline_high_percent - baseline_low_percent) AS gradient_difference_pp FROM (
 SELECT {', '.join(keys)}, estimand, {at(label('band_order'), low)} AS low_band,
 {at('focal_exposure_percent', low)} AS focal_low_percent, {at('baseline_exposure_percent', low)} AS baseline_low_percent,
 {at('focal_exposure_percent', 8)} AS focal_high_percent, {at('baseline_exposure_percent', 8)} AS baseline_high_percent,
 {at('focal_eligible_weight', 8)} AS focal_high_weight, {at('baseline_eligible_weight', 8)} AS baseline_high_weight,
 {at('focal_eligible_units', 8)} AS focal_high_units, {at('baseline_eligible_units', 8)} AS baseline_high_units
 FROM {source} GROUP BY {', '.join(keys)}, estimand))"""


SUMMARY_VALUES = (
    "focal_low_percent", "baseline_low_percent", "focal_high_percent", "baseline_high_percent", "high_gap_pp", "focal_change_pp",
    "baseline_change_pp", "gradient_difference_pp",
)


def estimands_cte(keys, source, name="es") -> str:
    ks = ", ".join(keys)
    return f"{name} AS (" + union(
        f"SELECT {ks}, group_code, band_order, eligible_weight, affected_weight, eligible_units, {text(e)} AS estimand, {c} AS exposure_percent FROM {source}"
        for e, c in ((UNIT_PREVALENCE, "unit_percent"), (WEIGHTED_EXPOSURE, "exposure_percent"))
    ) + ")"


# models


def demeaned(x, y, part) -> str:
    return (
        f"SELECT *, {x} - avg({x}) OVER (PARTITION BY {part}) AS dx, {y} - avg({y}) OVER (PARTITION BY {part}) AS dy "
        f"FROM (SELECT * FROM u WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
    )


def slopes_sql(x, indicators, region, subregion, per_region=False) -> str:
    out = []
    corr = "CASE WHEN isnan(corr(dx, dy)) THEN NULL ELSE corr(dx, dy) END"
    slope = div("sum(dx * dy)", "sum(dx * dx)")
    for i in indicators:
        levels = (("subregion", f"{region}, {subregion}"),) if per_region else (("region", region), ("subregion", f"{region}, {subregion}"))
        for level, part in levels:
            head = f"{region}, {whole(f'count(DISTINCT {subregion})', 'subregions')}, " if per_region else f"{text(level)} AS level, "
            out.append(
                f"SELECT {head}{text(i.code)} AS indicator_code, {whole('count(*)', 'observations')}, {rd(slope, 'slope', 5)}, {rd(corr, 'within_correlation', 5)}, "
                f"{rd(f'{slope} * {0.10 * i.multiplier}', 'slope_per_10pp', 5)}, {text(i.direction)} AS direction "
                f"FROM ({demeaned(x, f'CAST({i.code} AS DOUBLE)', part)})" + (f" GROUP BY {region}" if per_region else "")
            )
    return union(out)


def evidence_sql(scheme, indicators, x, region, subregion, baseline) -> str:
    """Assumes CTEs ``lx`` (long exposure)."""
    return f""", sl AS ({slopes_sql(x, indicators, region, subregion)}),
ev AS (SELECT s.indicator_code,
 coalesce(max(CASE WHEN level = 'region' THEN CASE WHEN direction = 'higher_worse' THEN slope_per_10pp > 0 ELSE slope_per_10pp < 0 END END), FALSE) AS r,
 coalesce(max(CASE WHEN level = 'subregion' THEN CASE WHEN direction = 'higher_worse' THEN slope_per_10pp > 0 ELSE slope_per_10pp < 0 END END), FALSE) AS d
 FROM sl s GROUP BY 1),
gp AS (SELECT a.indicator_code, coalesce((a.d - b.d) * CASE WHEN a.direction = 'higher_better' THEN -1 ELSE 1 END > 0, FALSE) AS w
 FROM lx a JOIN lx b USING (indicator_code) WHERE a.group_code = '{scheme.focal.code}' AND b.group_code = '{baseline}')
SELECT ev.indicator_code, {whole('r', 'within_region_adverse')}, {whole('d', 'within_subregion_adverse')}, {whole('coalesce(w, FALSE)', 'worse_than_baseline')},
 {whole('r::INT + d::INT + coalesce(w, FALSE)::INT', 'findings')},
 CASE r::INT + d::INT + coalesce(w, FALSE)::INT {' '.join(f'WHEN {n} THEN {text(t)}' for n, t in enumerate(EVIDENCE))} END AS evidence
FROM ev LEFT JOIN gp USING (indicator_code)"""


# ---------------------------------------------------------------- panel 3


def zero(parts) -> str:
    return " + ".join(f"coalesce({p}, 0)" for p in parts)


def rule_sql(r) -> str:
    yes = lambda test: f"CASE WHEN {test} THEN 1 ELSE 0 END"
    inside = lambda xs: ", ".join(map(str, xs))
    match r:
        case R.Answer():
            return f"CASE WHEN {r.column} IN ({inside(r.adverse)}) THEN 1 WHEN {r.column} IN ({inside(r.favourable)}) THEN 0 END"
        case R.Test():
            return yes(f"{r.column} {r.operator} {r.limit}")
        case R.Absent():
            return yes(f"{zero(r.parts)} = 0")
        case R.AbsentAmong():
            return f"CASE WHEN {r.whole} > 0 THEN {yes(f'coalesce({r.part}, 0) = 0')} END"
        case R.ZeroCount():
            return f"CASE WHEN {r.column} = 0 THEN 1 WHEN {r.column} > 0 THEN 0 END"
        case R.Per():
            top = r.above[0] if len(r.above) == 1 else f"({zero(r.above)})"
            below = '"none"' if r.below == "none" else r.below
            top = '"none"' if top == "none" else top
            return f"CAST({top} AS DOUBLE) * {float(r.scale)} / NULLIF({below}, 0)"
        case R.Crowded():
            return yes(f"{r.staff} > 0 AND CAST({r.people} AS DOUBLE) / {r.staff} > {r.limit}")
        case R.Value():
            return f"CAST({r.column} AS DOUBLE)"
        case R.Total():
            return zero(r.parts)
        case R.NoneWorks():
            none = " AND ".join(f"coalesce({c}, 2) <> 1" for c in r.works)
            return yes(f"({none}) AND ({' OR '.join(f'{c} = 1' for c in r.present)})" if r.present else none)
        case R.BothLack():
            return f"CASE WHEN {r.first} = 2 AND {r.second} = 2 THEN 1 WHEN {r.first} = 1 OR {r.second} = 1 THEN 0 END"
        case R.HasWithout():
            return f"CASE WHEN {r.has} = 1 AND {r.lacks} = 2 THEN 1 WHEN {r.has} = 1 AND {r.lacks} = 1 THEN 0 END"
        case R.Unspent():
            return yes(f"{r.received} > 0 AND coalesce({r.spent}, 0) = 0")
        case R.Where():
            return f"CASE WHEN {' AND '.join(f'{c} {o} {v}' for c, o, v in r.bounds)} THEN ({rule_sql(r.rule)}) END"
        case R.Mean():
            seen = " + ".join(f"CASE WHEN {p} IS NOT NULL THEN 1 ELSE 0 END" for p in r.parts)
            return f"CAST({zero(r.parts)} AS DOUBLE) * {float(r.scale)} / NULLIF({seen}, 0)"
        case R.Product():
            return f"{r.first} * {r.second} / 100.0"
    raise TypeError(r)


def _quoted(c: str) -> str:
    return f'"{c}"'


def _survey_ctes() -> str:
    out = [
        "k0 AS (SELECT c_custkey AS k, r_name AS state, n_name AS district FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
    ]
    for name in ("profile_1", "profile_2", "facility", "teacher"):
        cols = ", ".join(f"CAST({t} AS {'VARCHAR' if S.SCHEMAS[name].kind(c) == 'string' else S.SCHEMAS[name].kind(c)}) AS {_quoted(c)}" for c, t in P.survey_columns(name).items())
        place = "state, district, " if name == "profile_1" else ""
        gap = f" WHERE k % {P.GAPS[name]} <> 0" if name in P.GAPS else ""
        out.append(f"{name} AS (SELECT k AS pseudocode, {place}{cols} FROM k0{gap})")
    cells = ", ".join(
        f"sum(CASE WHEN class = {n} AND l_linestatus = '{st}' THEN n END) AS c{n}_{sex}" for n in range(1, 13) for sex, st in (("b", "O"), ("g", "F"))
    )
    items = union([
        "SELECT *, 1 AS item_group, CASE WHEN pr = 5 THEN 4 ELSE pr END AS item_id FROM ln WHERE pr <> 4",
        "SELECT *, 2, CASE l_returnflag WHEN 'R' THEN 5 WHEN 'A' THEN 6 ELSE line % 4 + 7 END FROM ln",
        "SELECT *, 3, 13 FROM ln WHERE line = 1", "SELECT *, 10, 32 FROM ln WHERE line = 2", "SELECT *, 5, 0 FROM ln WHERE line = 3",
        "SELECT *, 4, l_partkey % 5 FROM ln WHERE line = 4",
    ])
    out += [
        """ln AS (SELECT o_custkey AS pseudocode, l_partkey % 12 + 1 AS class, l_linestatus, CAST(l_quantity AS BIGINT) AS n,
 CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS pr, l_returnflag, CAST(l_linenumber AS BIGINT) AS line, l_partkey, l_suppkey
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
        f"enrolment_1 AS (SELECT pseudocode, item_group, item_id, NULL::BIGINT AS cpp_b, NULL::BIGINT AS cpp_g, {cells} FROM ({items}) GROUP BY 1, 2, 3)",
        f"enrolment_2 AS (SELECT pseudocode, 8 AS item_group, class + 3 + l_suppkey % 5 AS item_id, {cells} FROM ln WHERE pseudocode % 13 <> 0 GROUP BY 1, 2, 3)",
    ]
    cls = lambda classes, sexes="bg": " + ".join(f"coalesce(c{n}_{s}, 0)" for n in classes for s in sexes)
    parts = {"students": cls(range(1, 13)), "boys": cls(range(1, 13), "b"), "girls": cls(range(1, 13), "g")}
    for suffix, _, classes in S.STAGES:
        parts |= {suffix: cls(classes), f"{suffix}_boys": cls(classes, "b"), f"{suffix}_girls": cls(classes, "g")}
    test = lambda m: f"item_group = {m[0]}" + ("" if m[1] is None else f" AND item_id = {m[1]}")
    terms = [f"sum(CASE WHEN {test(g.item)} THEN {v} ELSE 0 END) AS {g.prefix}_{n}" for g in S.SCHEME.groups for n, v in parts.items()]
    terms += [f"sum(CASE WHEN {test(m)} THEN {parts['students']} ELSE 0 END) AS {n}_students" for n, m in S.OTHER_ITEMS.items()]
    totals = ", ".join(f"{' + '.join(S.SCHEME.column(g, m) for g in S.SCHEME.baselines)} AS total_{m}" for m in S.SCHEME.measures)
    shares = ", ".join(f"{div(S.SCHEME.column(g), 'total_students')} AS {S.SCHEME.share(g)}" for g in S.SCHEME.groups)
    listed = " - ".join(f"{n}_students" for n in S.RESIDUAL_ITEMS)
    ages = {
        "total": lambda n: cls([n]), "over": lambda n: f"CASE WHEN item_id > {n + 6} THEN {cls([n])} ELSE 0 END",
        "under": lambda n: f"CASE WHEN item_id < {n + 4} THEN {cls([n])} ELSE 0 END",
        "on": lambda n: f"CASE WHEN item_id BETWEEN {n + 4} AND {n + 6} THEN {cls([n])} ELSE 0 END",
    }
    out += [
        f"""cp AS (SELECT *, {shares}, {div('a0_girls', 'a0_students')} AS a0_girls_share, total_students - a0_students - {listed} AS residual_students
 FROM (SELECT *, {totals} FROM (SELECT pseudocode, {', '.join(terms)} FROM enrolment_1 GROUP BY 1)))""",
        "ag AS (SELECT pseudocode, " + ", ".join(f"sum({' + '.join(f(n) for n in range(1, 13))}) AS age_{a}" for a, f in ages.items()) + " FROM enrolment_2 WHERE item_group = 8 GROUP BY 1)",
        """ms AS (SELECT * FROM profile_1 LEFT JOIN profile_2 USING (pseudocode) LEFT JOIN facility USING (pseudocode) LEFT JOIN teacher USING (pseudocode)
 JOIN cp USING (pseudocode) LEFT JOIN ag USING (pseudocode) WHERE total_students > 0)""",
    ]
    named = lambda code: f"({rule_sql(N.RULES[code])}) AS {code}"
    out.append("i0 AS (SELECT *, " + ", ".join(named(i.code) for i in N.SECONDARY_INDICATORS) + " FROM ms)")
    last = "i0"
    for n, stage in enumerate(N.TERTIARY):
        if n == 2:
            ranks = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN percent_rank() OVER (PARTITION BY state ORDER BY {c} NULLS LAST) END AS {name}" for c, name in N.PERCENTILES.items())
            out.append(f"ir AS (SELECT *, {ranks} FROM {last})")
            last = "ir"
        out.append(f"i{n + 1} AS (SELECT *, " + ", ".join(named(code) for code, *_ in stage) + f" FROM {last})")
        last = f"i{n + 1}"
    out.append(f"u AS (SELECT * FROM {last})")
    out.append(f"g AS ({groups_cte(S.SCHEME)})")
    return ",\n".join(out)


SURVEY = _survey_ctes()


def s1(body: str, extra: str = "") -> str:
    return materialized(f"WITH {SURVEY}{extra}\n{body}")
