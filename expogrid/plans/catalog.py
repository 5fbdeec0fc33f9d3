"""The registered queries: every operator over the driver tables, with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import all_members, band_label, mean_of_observed
from ..operators import audit, bundles, compose, contrast, exposure, intervals, logratios, models, strata, weights
from ..operators.ranking import percent_ranks
from ..presets import indicators as N
from ..presets import schools as S
from ..sources import ingest, sinks
from ..sources.schema import TableSchema
from . import designs
from . import oracles as O
from . import panels as P
from .registry import COUNTED, ORACLES, QUERIES, Query, register, tidy  # noqa: F401
from .schools import SCHEME as SCHOOL
from .schools import FIRST_OUTCOMES, FIRST_PERCENTS, FirstResults, SchoolResults, age_grade, composition, unit_indicators

# ---------------------------------------------------------------- customers: composition

PS, PI = P.SCHEME, P.INDICATORS
COMPOSITION = [
    *[PS.column(g, m) for g in PS.groups for m in (*PS.measures, *[s for s, _ in P.STAGE_LABELS])], "total_qty", "total_qty_o", "total_qty_f", "residual_qty",
]
SHARES = [PS.share(g) for g in PS.groups] + ["a0_qty_f_share"]


@register("composition_pivot", O.c1(f"SELECT unit, {', '.join(O.whole(c, c) for c in COMPOSITION)}, {', '.join(O.rd(c, c) for c in SHARES)} FROM cp"))
def composition_pivot(spark, d):
    return P.customer_composition(spark, d).select("unit", *COMPOSITION, *SHARES)


@register("share_bands", O.c1(f"SELECT unit, group_code, group_label, {O.rd('group_share', 'group_share')}, {O.whole('band_order', 'band_order')}, {O.label('band_order')} AS band FROM g"))
def share_bands(spark, d):
    return P.customer_long(spark, d).select("unit", "group_code", "group_label", "group_share", "band_order", band_label("band_order").alias("band"))


@register("indicator_panel", O.c1(
    f"SELECT unit, region, subregion, segment, {', '.join(O.whole(i.code, i.code) for i in P.FLAGS)}, {', '.join(O.rd(i.code, i.code) for i in PI[6:])} FROM u"))
def indicator_panel(spark, d):
    return P.customer_units(spark, d).select("unit", "region", "subregion", "segment", *P.CODES)


# exposures


@register("group_totals", O.c1(O.totals_sql(PS)))
def group_totals(spark, d):
    return exposure.group_totals(P.customer_long(spark, d), PS)


@register("stage_representation", O.c1(O.stage_sql(PS, P.STAGE_LABELS, "cp")))
def stage_representation(spark, d):
    return exposure.stage_representation(P.customer_composition(spark, d), PS, P.STAGE_LABELS)


@register("stage_representation_by_region", O.c1(O.stage_sql(PS, P.STAGE_LABELS, "u", ["region"])))
def stage_by_region(spark, d):
    return exposure.stage_representation(P.customer_units(spark, d), PS, P.STAGE_LABELS, ["region"])


@register("concentration_distribution", O.c1(O.distribution_sql(PS)))
def distribution(spark, d):
    return exposure.concentration_distribution(P.customer_long(spark, d), PS)


@register("concentration_distribution_by_region", O.c1(O.distribution_sql(PS, ["region"])))
def distribution_by_region(spark, d):
    return exposure.concentration_distribution(P.customer_long(spark, d), PS, ["region"])


@register("group_exposure", O.c1(O.exposure_sql(PS, PI), ",\n" + O.exposure_cte(PS, PI)))
def group_exposure(spark, d):
    return exposure.group_exposure(P.customer_long(spark, d), PI, PS)


@register("group_exposure_by_region", O.c1(O.exposure_sql(PS, PI, ["region"]), ",\n" + O.exposure_cte(PS, PI, ["region"])))
def group_exposure_by_region(spark, d):
    return exposure.group_exposure(P.customer_long(spark, d), PI, PS, ["region"])


@register("exposure_all_rows_denominator", O.c1(O.exposure_sql(PS, PI), ",\n" + O.exposure_cte(PS, PI, denominator="all")))
def exposure_all_rows(spark, d):
    return exposure.group_exposure(P.customer_long(spark, d), PI, PS, denominator="all")


def _sex_sql() -> tuple[str, str]:
    ctes = ",\n".join(O.exposure_cte(PS, PI, forced=m, name=f"ex_{m}") for m in ("qty_f", "qty_o"))
    return ",\n" + ctes, O.union(
        O.melted(f"ex_{m}", f"group_code, group_label, {O.text(m)} AS sex, {O.whole('weight_members', 'weight_members')}", [(i, i.code, "") for i in PI])
        for m in ("qty_f", "qty_o")
    )


@register("sex_weighted_exposure", O.c1(_sex_sql()[1], _sex_sql()[0]))
def sex_weighted(spark, d):
    return exposure.sex_exposure(P.customer_long(spark, d), PI, PS)


@register("subregion_profile", O.c1(O.profile_sql(PS, PI, ["region", "subregion"])))
def subregion_profile(spark, d):
    return exposure.focal_profile(P.customer_units(spark, d), PI, PS, ["region", "subregion"])


@register("region_profile", O.c1(O.region_profile_sql(PS, PI, P.STAGE_LABELS, "region")))
def region_profile(spark, d):
    units = P.customer_units(spark, d)
    grouped = compose.group_long(units, PS, ["unit", "region", PS.total(), *P.CODES])
    return exposure.region_profile(units, grouped, units, PS, "region", P.STAGE_LABELS, PI)


@register("representation_gap", O.c1(
    O.union(
        f"SELECT region, {O.text(g.code)} AS group_code, {O.text(g.label)} AS group_label, {O.rd(f'100 * a', 'staff_share_percent')}, {O.rd('100 * b', 'people_share_percent')}, {O.rd('100 * a - 100 * b', 'staff_minus_people_pp')} "
        f"FROM (SELECT region, {O.div(f'sum(staff_{g.prefix})', 'sum(staff)')} AS a, {O.div(f'sum({g.prefix}_qty)', 'sum(total_qty)')} AS b FROM rj GROUP BY region)"
        for g in PS.baselines
    ),
    f""", rj AS (SELECT * FROM (SELECT n_name AS subregion, count(*) AS staff, {', '.join(f"sum(CASE WHEN s_suppkey % 5 = {n} THEN 1 ELSE 0 END) AS staff_{g.prefix}" for n, g in enumerate(PS.baselines))}
 FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
 JOIN (SELECT region, subregion, {', '.join(f'sum({c}) AS {c}' for c in [*[PS.column(g) for g in PS.baselines], 'total_qty'])} FROM u GROUP BY 1, 2) USING (subregion))""",
))
def representation_gap(spark, d):
    nation = P.table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("subregion"))
    staff = P.table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("subregion").agg(
        F.count(F.lit(1)).alias("staff"),
        *[F.count(F.when(F.col("s_suppkey") % 5 == n, 1)).alias(f"staff_{g.prefix}") for n, g in enumerate(PS.baselines)],
    )
    counts = [*[PS.column(g) for g in PS.baselines], "total_qty"]
    people = P.customer_units(spark, d).groupBy("region", "subregion").agg(*[F.sum(c).alias(c) for c in counts])
    rows = [(g.code, g.label, f"staff_{g.prefix}", PS.column(g)) for g in PS.baselines]
    return exposure.representation_gap(staff.join(people, "subregion"), rows, "staff", "total_qty", ["region"])


# gradients and gaps


@register("concentration_gradient", O.c1(O.gradient_sql(PI), ",\n" + O.gradient_cte(PS, PI)))
def concentration_gradient(spark, d):
    return exposure.concentration_gradient(P.customer_long(spark, d), PI, PS)


@register("concentration_gradient_by_region", O.c1(O.gradient_sql(PI, ["region"]), ",\n" + O.gradient_cte(PS, PI, ["region"])))
def concentration_gradient_by_region(spark, d):
    return exposure.concentration_gradient(P.customer_long(spark, d), PI, PS, ["region"])


@register("condition_gradient", O.c1(
    f"""SELECT group_code, group_label, {O.whole('band_order', 'band_order')}, {O.label('band_order')} AS band, {O.whole('count(*)', 'units')}, {O.whole('sum(group_qty)', 'group_members')},
 {', '.join(O.rd(f'avg({c}) * 100', f'{c}_percent') for c in ('in_debt', 'few_orders'))}, {', '.join(O.rd(f'avg({c})', f'mean_{c}') for c in ('line_price', 'discount_share'))},
 {', '.join(O.rd(f'median({c})', f'median_{c}') for c in ('line_price', 'balance_per_order'))}, {O.rd(O.div('sum(balance) * 100', 'sum(total_qty)'), 'balance_per_100', 5)}
FROM g GROUP BY group_code, group_label, band_order"""), digits=5)
def condition_gradient(spark, d):
    long = compose.group_long(P.customer_units(spark, d), PS, ["unit", "balance", PS.total(), *P.CODES])
    return exposure.condition_gradient(
        long, PS, ("in_debt", "few_orders"), ("line_price", "discount_share"), ("line_price", "balance_per_order"),
        {"balance_per_100": ("balance", "total_qty", 100)},
    )


ORACLES["condition_gradient"] = ORACLES["condition_gradient"].replace(", 6)", ", 5)")


@register("band_change", O.c1(
    O.union(
        f"SELECT region, {O.text(i.code)} AS indicator_code, {O.rd('lo', 'low_value')}, {O.rd('hi', 'high_value')}, {O.rd('hi - lo', 'change')} FROM "
        f"(SELECT region, max(CASE WHEN band_order = 2 THEN w__{i.code} * {i.multiplier} END) AS lo, max(CASE WHEN band_order = 7 THEN w__{i.code} * {i.multiplier} END) AS hi FROM gr WHERE group_code = 'A0' GROUP BY region)"
        for i in PI
    ), ",\n" + O.gradient_cte(PS, PI, ["region"])))
def band_change(spark, d):
    return contrast.band_change(concentration_gradient_by_region(spark, d), ["region"], "A0", exposure.GROUP_WEIGHTED, 2, 7)


def _lx(indicators, by=(), scheme=PS, **more) -> str:
    return ",\n" + O.exposure_cte(scheme, indicators, by, **more) + f",\nlx AS ({O.long_exposure(indicators, by)})"


@register("baseline_gap", O.c1(O.gaps_sql(PS), _lx(PI)))
def baseline_gap(spark, d):
    return contrast.baseline_gaps(group_exposure(spark, d), PS)


@register("baseline_gap_by_region", O.c1(O.gaps_sql(PS, ["region"]), _lx(PI, ["region"])))
def baseline_gap_by_region(spark, d):
    return contrast.baseline_gaps(group_exposure_by_region(spark, d), PS, ["region"])


@register("plain_gap_all_rows", O.c1(O.gaps_sql(PS, directed=False), _lx(PI, denominator="all")))
def plain_gap(spark, d):
    return contrast.baseline_gaps(exposure_all_rows(spark, d), PS, directed=False)


@register("pairwise_gap", O.c1(O.pairs_sql(), _lx(PI)))
def pairwise_gap(spark, d):
    return contrast.pairwise_gaps(group_exposure(spark, d), PS)


@register("interaction_grid", O.c1(O.grid_sql(PS, PI).split("\n", 1)[1], O.grid_sql(PS, PI).split("\n", 1)[0]))
def interaction_grid(spark, d):
    return contrast.interaction_grid(P.customer_units(spark, d), PI, PS)


@register("evidence_profile", O.c1(O.evidence_sql(PS, PI, "a0_share", "region", "subregion", "B0"), _lx(PI)).replace(")\n, sl AS", "),\nsl AS"))
def evidence_profile(spark, d):
    return contrast.evidence_profile(baseline_gap(spark, d), within_slope(spark, d), "B0")


# indices and ranks

INDEX_PARTS = ("in_debt", "few_orders", "low_value", "deep_discount")


@register("index_mean", O.c1(
    f"SELECT unit, {O.rd('m', 'index_100')}, {O.rd('m * big / 100', 'product')} FROM (SELECT unit, 100.0 * ({O.zero(INDEX_PARTS)}) / ({' + '.join(f'CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END' for c in INDEX_PARTS)}) AS m, 100.0 * (big_lines + no_recent) / 2 AS big FROM u)"))
def index_mean(spark, d):
    first, second = mean_of_observed(INDEX_PARTS, 100), mean_of_observed(("big_lines", "no_recent"), 100)
    return P.customer_units(spark, d).select("unit", first.alias("index_100"), (first * second / 100).alias("product"))


RANKED = {"a0_share": "a0_percentile", "line_price": "price_percentile", "b0_share": "b0_percentile"}


@register("percentile_index", O.c1(
    "SELECT unit, " + ", ".join(O.rd(f"CASE WHEN {c} IS NOT NULL THEN percent_rank() OVER (PARTITION BY region ORDER BY {c} NULLS LAST) END", n) for c, n in RANKED.items()) + " FROM u"))
def percentile_index(spark, d):
    units = P.customer_units(spark, d).select("unit", "region", *RANKED)
    return units.select("unit").join(percent_ranks(units, "unit", "region", RANKED), "unit", "left")


# lead time in weeks against a nominal one per line number, with a tolerance of 30
LEAD = "CAST(floor(date_diff('day', o_orderdate, l_shipdate) / 7.0) AS BIGINT)"


@register("age_band_counts", f"""WITH x AS (SELECT o_custkey AS unit, {LEAD} AS lead, l_quantity AS q, l_linenumber AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT unit, {O.whole('sum(q)', 'age_total')}, {', '.join(O.whole(' + '.join(f"sum(CASE WHEN n = {n} AND lead {t(n)} THEN q ELSE 0 END)" for n in range(1, 8)), f'age_{a}')
 for a, t in (('over', lambda n: f'> {10 * n + 30}'), ('under', lambda n: f'< {10 * n - 30}'), ('on', lambda n: f'BETWEEN {10 * n - 30} AND {10 * n + 30}')))} FROM x GROUP BY unit""")
def age_band_counts(spark, d):
    orders = P.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("unit"), "o_orderdate")
    lines = P.table(spark, d, "lineitem").join(orders, "l_orderkey")
    lead = F.floor(F.date_diff("l_shipdate", "o_orderdate") / 7).alias("lead")
    wide = lines.select("unit", lead, *[F.when(F.col("l_linenumber") == n, F.col("l_quantity")).alias(f"q{n}") for n in range(1, 8)])
    out = compose.age_bands(wide, "unit", "lead", {10 * n: (f"q{n}",) for n in range(1, 8)}, tolerance=30)
    return out.select("unit", *[F.col(f"age_{a}").cast("long").alias(f"age_{a}") for a in ("total", "over", "under", "on")])


# ---------------------------------------------------------------- ingest and audits

EVENTS = TableSchema("events", ("event_id", "user_id", "event_type", "k", "value"), ("event_id",), frozenset({"event_type"}), frozenset({"value"}))


def event_text(spark: SparkSession, d: str) -> DataFrame:
    """Event rows as raw text fields: padded, sometimes blank or no number."""
    digits = F.regexp_extract("props", r"(\d+)", 1)
    k = F.when(F.col("event_id") % 7 == 0, F.lit("  ")).when(F.col("event_id") % 11 == 0, F.concat(digits, F.lit("x"))).otherwise(F.concat(F.lit(" "), digits, F.lit(" ")))
    return P.table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.col("event_type"), F.lit(" ")).alias("event_type"), k.alias("k"),
        F.when(F.col("event_id") % 5 == 0, F.lit("n/a")).otherwise(F.round(F.col("value") * 100).cast("long").cast("string")).alias("value"),
    )


EVENT_SQL = """e AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 7 = 0 THEN '  ' WHEN event_id % 11 = 0 THEN regexp_extract(props, '(\\d+)', 1) || 'x' ELSE ' ' || regexp_extract(props, '(\\d+)', 1) || ' ' END AS k,
 CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) END AS value FROM events)"""


@register("typed_projection", f"""WITH {EVENT_SQL} SELECT CAST(event_id AS BIGINT) AS event_id, CAST(user_id AS BIGINT) AS user_id, trim(event_type) AS event_type,
 CAST(TRY_CAST(NULLIF(trim(k), '') AS BIGINT) AS BIGINT) AS k, {O.rd("TRY_CAST(NULLIF(trim(value), '') AS DOUBLE)", 'value')} FROM e""")
def typed_projection(spark, d):
    return ingest.typed_table(event_text(spark, d), EVENTS)


@register("cast_audit", f"WITH {EVENT_SQL}\n" + O.union(
    f"SELECT 'events' AS source_table, '{c}' AS column_name, '{EVENTS.kind(c)}' AS data_type, {O.whole(f'''count(NULLIF(trim(CAST({c} AS VARCHAR)), ''))''', 'filled')}, "
    f"{O.whole(f'''sum(CASE WHEN NULLIF(trim(CAST({c} AS VARCHAR)), '') IS NOT NULL AND TRY_CAST(NULLIF(trim(CAST({c} AS VARCHAR)), '') AS {EVENTS.kind(c)}) IS NULL THEN 1 ELSE 0 END)''', 'failed')} FROM e"
    for c in ("event_id", "user_id", "k", "value")
))
def cast_audit(spark, d):
    return ingest.cast_audit(event_text(spark, d), EVENTS)


KEYED = {"documents": "doc_id", "labels": "doc_id", "orders": "o_custkey", "lineitem": "l_orderkey", "events": "user_id", "customer": "c_custkey"}


@register("source_counts", O.union(f"SELECT '{t}' AS source_table, count(*) AS row_count, count(DISTINCT {k}) AS unit_count FROM {t}" for t, k in KEYED.items()))
def source_counts(spark, d):
    return audit.source_counts({t: P.table(spark, d, t) for t in KEYED}, KEYED)


def _coverage(spark, d):
    documents = P.table(spark, d, "documents")
    return audit.join_coverage(documents, {
        "labels": P.table(spark, d, "labels"),
        "long_text": documents.filter(F.col("n_chars") > 1000),
        "buyer": P.table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id")),
    }, "doc_id")


COVERAGE_SQL = """cv AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS has_labels, n_chars > 1000 AS has_long_text, doc_id IN (SELECT o_custkey FROM orders) AS has_buyer FROM documents)"""


@register("join_coverage", f"WITH {COVERAGE_SQL} SELECT doc_id, {', '.join(O.whole(c, c) for c in ('has_labels', 'has_long_text', 'has_buyer'))} FROM cv")
def join_coverage(spark, d):
    return _coverage(spark, d)


@register("coverage_summary", f"""WITH {COVERAGE_SQL} SELECT count(*) AS units, {', '.join(O.whole(f'sum(CASE WHEN has_{t} THEN 1 ELSE 0 END)', f'with_{t}') + ', ' + O.whole(f'sum(CASE WHEN has_{t} THEN 0 ELSE 1 END)', f'without_{t}') for t in ('labels', 'long_text', 'buyer'))},
 {O.whole('sum(CASE WHEN has_labels <> has_long_text THEN 1 ELSE 0 END)', 'presence_mismatch')} FROM cv""")
def coverage_summary(spark, d):
    return audit.coverage_summary(_coverage(spark, d), ("labels", "long_text"))


@register("missing_units", f"WITH {COVERAGE_SQL} SELECT doc_id, {', '.join(O.whole(c, c) for c in ('has_labels', 'has_long_text', 'has_buyer'))} FROM cv WHERE NOT has_labels OR NOT has_long_text")
def missing_units(spark, d):
    return audit.missing_units(_coverage(spark, d), ["labels", "long_text"])


@register("unit_master", """SELECT doc_id, lang, source, CAST(n_chars AS BIGINT) AS n_chars, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic, c_mktsegment
FROM documents LEFT JOIN labels USING (doc_id) LEFT JOIN (SELECT c_custkey AS doc_id, c_mktsegment FROM customer) USING (doc_id)""")
def unit_master(spark, d):
    first = P.table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    buyers = P.table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), "c_mktsegment")
    return audit.unit_master(first, [P.table(spark, d, "labels"), buyers], "doc_id")


@register("key_profile", O.union(
    f"""SELECT '{t}' AS source_table, {O.whole(f'(SELECT count(*) FROM {t})', 'row_count')}, count(*) AS unique_keys, {O.whole('sum(n)', 'rows_with_key')}, {O.whole('sum(CASE WHEN n > 1 THEN 1 ELSE 0 END)', 'keys_with_multiple_rows')},
 min(n) AS min_rows_per_key, max(n) AS max_rows_per_key, {O.rd('avg(n)', 'mean_rows_per_key')}, {O.whole(f'(SELECT count(*) FROM {t}) - sum(n)', 'missing_key_rows')}, {O.rd('median(n)', 'median_rows_per_key')}
FROM (SELECT {k}, count(*) AS n FROM {t} WHERE {k} IS NOT NULL AND trim(CAST({k} AS VARCHAR)) <> '' GROUP BY 1)""" for t, k in (("orders", "o_custkey"), ("lineitem", "l_orderkey"), ("labels", "doc_id"))))
def key_profile(spark, d):
    return sinks.stack([
        audit.key_profile(P.table(spark, d, t), k).withColumn("source_table", F.lit(t))
        for t, k in (("orders", "o_custkey"), ("lineitem", "l_orderkey"), ("labels", "doc_id"))
    ])


@register("item_combinations", """SELECT 'lineitem' AS source_table, l_returnflag, l_linestatus, count(*) AS row_count, count(DISTINCT l_orderkey) AS unit_count FROM lineitem GROUP BY 2, 3""")
def item_combinations(spark, d):
    return audit.item_combinations(P.table(spark, d, "lineitem"), "l_orderkey", ["l_returnflag", "l_linestatus"], "lineitem")


SUMMARY = {"lineitem": ("l_quantity", "l_extendedprice", "l_discount", "l_linenumber"), "customer": ("c_acctbal", "c_nationkey"), "labels_of_documents": ("quality", "n_chars")}


@register("numeric_summary", "WITH labels_of_documents AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id))\n" + O.union(
    f"""SELECT '{t}' AS source_table, '{c}' AS column_name, count(*) AS "rows", count({c}) AS nonmissing, count(*) - count({c}) AS missing, {O.rd(f'min({c})', 'minimum')},
 {O.rd(f'quantile_cont(CAST({c} AS DOUBLE), 0.1)', 'p10')}, {O.rd(f'median(CAST({c} AS DOUBLE))', 'median')}, {O.rd(f'avg({c})', 'mean')}, {O.rd(f'quantile_cont(CAST({c} AS DOUBLE), 0.9)', 'p90')}, {O.rd(f'max({c})', 'maximum')} FROM {t}"""
    for t, cols in SUMMARY.items() for c in cols))
def numeric_summary(spark, d):
    tables = {t: P.table(spark, d, t) for t in ("lineitem", "customer")}
    tables["labels_of_documents"] = P.table(spark, d, "documents").join(P.table(spark, d, "labels"), "doc_id", "left")
    return audit.numeric_summary({t: (tables[t], cols) for t, cols in SUMMARY.items()})


@register("numeric_sketch")
def numeric_sketch(spark, d):
    """The same summary with quantiles from sketches; tests hold their ranks to the stated error."""
    tables = {t: P.table(spark, d, t) for t in ("lineitem", "customer")}
    return audit.numeric_summary({t: (tables[t], SUMMARY[t]) for t in tables}, rank_error=0.001)


AUDIT_COUNTS = [*[PS.column(g) for g in PS.groups], "total_qty"]
AUDITED = {"c_mktsegment": "market segment", "c_nationkey": "nation code"}


@register("raw_code_audit", O.c1(O.union(
    f"""SELECT 'customer' AS source_table, '{c}' AS column_name, '{t}' AS description, CAST({c} AS VARCHAR) AS raw_code, count(*) AS units, {', '.join(O.whole(f'sum({x})', x) for x in AUDIT_COUNTS)},
 {O.rd(O.div('sum(a0_qty) * 100.0', 'sum(total_qty)'), 'focal_share_percent')}, 'raw code only; code book required' AS interpretation_status
FROM customer LEFT JOIN cp ON unit = c_custkey GROUP BY {c}""" for c, t in AUDITED.items())))
def raw_code_audit(spark, d):
    customers = P.table(spark, d, "customer").withColumnRenamed("c_custkey", "unit")
    return audit.raw_code_audit(customers, P.customer_composition(spark, d), "unit", AUDITED, AUDIT_COUNTS, "a0_qty", "total_qty", "customer")


PRINTED = {
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice/f o_orderdate/t o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity/f l_extendedprice/f l_discount/f l_tax/f l_returnflag l_linestatus l_shipdate/t",
    "documents": "doc_id text lang source n_chars",
}


def _printed_sql(table: str) -> str:
    texts = {"f": "CAST(CAST({0} AS DECIMAL(38,6)) AS VARCHAR)", "t": "strftime({0}, '%Y-%m-%d %H:%M:%S')", "": "CAST({0} AS VARCHAR)"}
    fields = [texts[kind].format(c) for c, _, kind in (x.partition("/") for x in PRINTED[table].split())]
    row = " || ".join(f"coalesce(length({x}) || ':' || {x}, 'N')" for x in fields)
    sums = ", ".join(f"sum(CAST(('0x' || substr(h, {16 * i + 1}, 16)) AS UBIGINT))" for i in range(4))
    return f"SELECT '{table}' AS source_table, count(*) AS \"rows\", concat_ws('-', {sums}) AS fingerprint FROM (SELECT sha256({row}) AS h FROM {table})"


@register("table_fingerprint", O.union(_printed_sql(t) for t in PRINTED))
def table_fingerprint(spark, d):
    return sinks.stack([sinks.fingerprint(P.table(spark, d, t)).withColumn("source_table", F.lit(t)) for t in PRINTED])


@register("run_counts", O.union(f"SELECT '{t}' AS output_table, count(*) AS \"rows\" FROM {t}" for t in ("orders", "lineitem", "documents", "labels")))
def run_counts(spark, d):
    return sinks.run_counts({t: P.table(spark, d, t) for t in ("orders", "lineitem", "documents", "labels")})


# ---------------------------------------------------------------- bundles

MIN_W, MIN_N = 300.0, 3


@register("bundle_flags", O.c1("SELECT unit, " + ", ".join(O.whole(O.flag(b.members), b.code) for b in P.BUNDLES) + " FROM u"))
def bundle_flags(spark, d):
    return P.customer_units(spark, d).select("unit", *[all_members(b.members).alias(b.code) for b in P.BUNDLES])


def _combo(by, banded=False, name="bx"):
    return ",\n" + O.bundle_cte(P.COMBINATIONS, PS, by, "g", name, banded)


RG = ["region", "group_code"]


@register("combination_exposure", O.c1(O.bundle_sql(RG, "bx"), _combo(RG)))
def combination_exposure(spark, d):
    return bundles.bundle_exposure(P.customer_long(spark, d), P.COMBINATIONS, PS, RG)


@register("combination_gradient", O.c1(O.bundle_sql(RG, "bb", True), _combo(RG, True, "bb")))
def combination_gradient(spark, d):
    return bundles.bundle_gradient(P.customer_long(spark, d), P.COMBINATIONS, PS, RG)


CK = ["region", "bundle_code"]
_contrast = _combo(RG) + _combo(RG, True, "bb") + ",\n" + O.contrast_cte(PS, CK, "bx", "bb")


@register("did_contrast", O.c1(O.contrast_sql(CK), _contrast))
def did_contrast(spark, d):
    return bundles.band_contrast(P.customer_long(spark, d), P.COMBINATIONS, CK, PS)


@register("robust_ranking", O.c1(O.ranking_sql(CK, "rr", rank=True), _contrast + f""",
{O.ranking_cte(CK, MIN_W, MIN_N)},
rr AS (SELECT * REPLACE ({', '.join(f'round({v}, 9) AS {v}' for v in O.RANK_VALUES)}) FROM rk)"""))
def robust_ranking(spark, d):
    rows = bundles.robust_ranking(did_contrast(spark, d), CK, MIN_W, MIN_N)
    return bundles.with_rank(rows.withColumns({v: F.round(v, 9) for v in O.RANK_VALUES}), CK)


@register("top_contrasts", O.c1(
    f"SELECT {', '.join(CK)}, baseline_code, {O.rd('v', 'high_gap_pp')} FROM (SELECT *, round(high_gap_pp, 9) AS v FROM ct WHERE high_gap_pp IS NOT NULL AND {O.adequate(MIN_W, MIN_N)}) ORDER BY v DESC, region, bundle_code, baseline_code LIMIT 25", _contrast))
def top_contrasts(spark, d):
    rows = did_contrast(spark, d).withColumn("high_gap_pp", F.round("high_gap_pp", 9))
    return bundles.top_contrasts(rows, "high_gap_pp", [*CK, "baseline_code"], 25, MIN_W, MIN_N).select(*CK, "baseline_code", "high_gap_pp")


@register("top_difference_in_differences", O.c1(
    f"SELECT {', '.join(CK)}, baseline_code, {O.rd('v', 'did_pp')} FROM (SELECT *, round(did_pp, 9) AS v FROM ct WHERE did_pp IS NOT NULL AND {O.adequate(MIN_W, MIN_N)}) ORDER BY v DESC, region, bundle_code, baseline_code LIMIT 25", _contrast))
def top_did(spark, d):
    rows = did_contrast(spark, d).withColumn("did_pp", F.round("did_pp", 9))
    return bundles.top_contrasts(rows, "did_pp", [*CK, "baseline_code"], 25, MIN_W, MIN_N).select(*CK, "baseline_code", "did_pp")


def _scope_sql() -> str:
    test = lambda codes: "TRUE" if codes is None else f"segment IN ({', '.join(O.text(c) for c in codes)})"
    return ",\nsg AS (" + O.union(f"SELECT *, {O.text(n)} AS scope FROM g WHERE {test(c)}" for n, c in P.SCOPE_SEGMENTS.items()) + ")"


SG, SK = ["scope", "region", "group_code"], ["scope", "region", "bundle_code"]
_scoped = _scope_sql() + ",\n" + O.bundle_cte(P.BUNDLES, PS, SG, "sg", "bx") + ",\n" + O.bundle_cte(P.BUNDLES, PS, SG, "sg", "bb", True)


@register("bundle_exposure", O.c1(O.bundle_sql(SG, "bx"), _scoped))
def bundle_exposure(spark, d):
    return bundles.bundle_exposure(bundles.in_scopes(P.customer_long(spark, d), P.scopes()), P.BUNDLES, PS, SG)


@register("bundle_gradient", O.c1(O.bundle_sql(SG, "bb", True), _scoped))
def bundle_gradient(spark, d):
    return bundles.bundle_gradient(bundles.in_scopes(P.customer_long(spark, d), P.scopes()), P.BUNDLES, PS, SG)


@register("bundle_contrast", O.c1(O.contrast_sql(SK), _scoped + ",\n" + O.contrast_cte(PS, SK, "bx", "bb")))
def bundle_contrast(spark, d):
    return bundles.band_contrast(bundles.in_scopes(P.customer_long(spark, d), P.scopes()), P.BUNDLES, SK, PS)


@register("bundle_ranking", O.c1(O.ranking_sql(SK), _scoped + ",\n" + O.contrast_cte(PS, SK, "bx", "bb") + ",\n" + O.ranking_cte(SK, MIN_W, MIN_N)))
def bundle_ranking(spark, d):
    return bundles.robust_ranking(bundle_contrast(spark, d), SK, MIN_W, MIN_N)


@register("top_robust", O.c1(
    f"SELECT * REPLACE ({', '.join(f'round({v}, 6) + 0.0 AS {v}' for v in O.RANK_VALUES)}, {', '.join(O.whole(f, f) for f in O.RANK_FLAGS)}) FROM (SELECT * REPLACE ({', '.join(f'round({v}, 9) AS {v}' for v in O.RANK_VALUES)}) FROM rk WHERE adequate_cell AND worse_than_all AND steeper_than_all) "
    f"ORDER BY min_high_gap_pp DESC, min_did_pp DESC, region, bundle_code LIMIT 25",
    _contrast + ",\n" + O.ranking_cte(CK, MIN_W, MIN_N)))
def top_robust(spark, d):
    rows = bundles.robust_ranking(did_contrast(spark, d), CK, MIN_W, MIN_N)
    return bundles.top_robust(rows.withColumns({v: F.round(v, 9) for v in O.RANK_VALUES}), CK)


AREAS = ("ASIA", "EUROPE")
AG, AK = ["scope", "area", "group_code"], ["scope", "area", "bundle_code"]
_areas = _scope_sql() + f""",
ra AS (SELECT *, 'NATIONAL' AS area FROM sg UNION ALL SELECT *, region AS area FROM sg WHERE region IN ({', '.join(O.text(a) for a in AREAS)})),
r2 AS (SELECT * FROM ra WHERE group_code IN ('A0', 'B0')),
{O.bundle_cte(P.BUNDLES, PS, AG, 'r2', 'ab', True)},
{O.estimands_cte(AK, 'ab')},
{O.matched_cte([*AK, 'estimand'], 'es', 'A0', 'B0')}"""


@register("area_gradient", O.c1(
    f"SELECT scope, area, bundle_code, group_code, {O.whole('band_order', 'band_order')}, estimand, {', '.join(O.whole(c, c) for c in ('eligible_weight', 'affected_weight', 'eligible_units'))}, {O.rd('exposure_percent', 'exposure_percent')} FROM es", _areas))
def area_gradient(spark, d):
    two = PS.only("A0", "B0")
    long = compose.group_long(P.customer_units(spark, d), two, ["unit", "region", "segment", *P.CODES])
    long = bundles.in_areas(bundles.in_scopes(long, P.scopes()), "region", AREAS)
    return bundles.two_estimands(bundles.bundle_gradient(long, P.BUNDLES, two, AG), AK)


MATCHED = ("focal_exposure_percent", "baseline_exposure_percent", "gap_pp")
MATCHED_COUNTS = ("focal_eligible_weight", "baseline_eligible_weight", "focal_eligible_units", "baseline_eligible_units")


@register("matched_band_contrast", O.c1(
    f"SELECT {', '.join(AK)}, estimand, {O.whole('band_order', 'band_order')}, {O.label('band_order')} AS band, {', '.join(O.whole(c, c) for c in MATCHED_COUNTS)}, {', '.join(O.rd(c, c) for c in MATCHED)} FROM mb", _areas))
def matched_band_contrast(spark, d):
    return bundles.matched_bands(area_gradient(spark, d), [*AK, "estimand"], PS.only("A0", "B0"))


SUMMARY_COUNTS = ("focal_high_weight", "baseline_high_weight", "focal_high_units", "baseline_high_units")
_summary_select = f"SELECT {', '.join(AK)}, estimand, low_band, {', '.join(O.rd(c, c) for c in O.SUMMARY_VALUES)}, {', '.join(O.whole(c, c) for c in SUMMARY_COUNTS)} FROM sm"


@register("gradient_summary", O.c1(_summary_select, _areas + ",\n" + O.summary_cte(AK)))
def gradient_summary(spark, d):
    return bundles.gradient_summary(matched_band_contrast(spark, d), AK)


@register("top_per_area", O.c1(
    f"SELECT * FROM (SELECT scope, area, bundle_code, estimand, {O.rd('g9', 'high_gap_pp')}, {O.whole('row_number() OVER (PARTITION BY scope, area ORDER BY g9 DESC, estimand, bundle_code)', 'place')} FROM (SELECT *, round(high_gap_pp, 9) AS g9 FROM sm WHERE high_gap_pp IS NOT NULL)) WHERE place <= 3",
    _areas + ",\n" + O.summary_cte(AK)))
def top_per_area(spark, d):
    rows = gradient_summary(spark, d).withColumn("high_gap_pp", F.round("high_gap_pp", 9)).filter(F.col("high_gap_pp").isNotNull())
    order = [F.col("high_gap_pp").desc(), F.col("estimand"), F.col("bundle_code")]
    return bundles.top_per(rows, ["scope", "area"], order, 3).select("scope", "area", "bundle_code", "estimand", "high_gap_pp", "place")


# ---------------------------------------------------------------- models


@register("within_slope", O.c1(O.slopes_sql("a0_share", PI, "region", "subregion")), 5)
def within_slope(spark, d):
    return models.within_slopes(P.customer_units(spark, d), "a0_share", PI, "region", "subregion")


@register("region_slopes", O.c1(O.slopes_sql("a0_share", PI, "region", "subregion", True)), 5)
def region_slopes(spark, d):
    return models.within_slopes(P.customer_units(spark, d), "a0_share", PI, "region", "subregion", per_region=True)


def _ols_sql(outcomes, levels, digits: int = 5, x: tuple[str, str] = ("a0_share", "b0_share"), where: str = "TRUE", extra: str = "") -> str:
    """Two regressors, clustered errors, in closed form."""
    out, (x1, x2) = [], x
    for y in outcomes:
        for level, part in levels:
            dm = lambda c: f"{c} - avg({c}) OVER (PARTITION BY {part})"
            out.append(f"""SELECT {extra}{O.text(level + ' fixed effects')} AS fixed_effect, {O.text(y)} AS outcome_code, regressor, {O.whole('n', 'observations')}, {O.whole('gc', 'clusters')},
 {O.rd('b', 'coefficient', digits)}, {O.rd('sqrt(v * (gc / (gc - 1.0)) * ((n - 1.0) / (n - 2.0)))', 'standard_error', digits)}
FROM (WITH q AS (SELECT region, subregion, {dm('CAST(' + y + ' AS DOUBLE)')} AS y, {dm(x1)} AS x1, {dm(x2)} AS x2 FROM u WHERE {y} IS NOT NULL AND {x1} IS NOT NULL AND {x2} IS NOT NULL AND {where}),
 m AS (SELECT count(*) AS n, count(DISTINCT region || '|' || subregion) AS gc, sum(x1*x1) AS a, sum(x1*x2) AS b, sum(x2*x2) AS c, sum(x1*y) AS p, sum(x2*y) AS q FROM q),
 s AS (SELECT *, (c*p - b*q)/(a*c - b*b) AS b1, (a*q - b*p)/(a*c - b*b) AS b2, c/(a*c-b*b) AS i11, -b/(a*c-b*b) AS i12, a/(a*c-b*b) AS i22 FROM m),
 t AS (SELECT sum(x1*(y - b1*x1 - b2*x2)) AS s1, sum(x2*(y - b1*x1 - b2*x2)) AS s2 FROM q, s GROUP BY region, subregion),
 w AS (SELECT sum(s1*s1) AS m11, sum(s1*s2) AS m12, sum(s2*s2) AS m22 FROM t)
 SELECT {O.text(x1)} AS regressor, n, gc, b1 AS b, i11*i11*m11 + 2*i11*i12*m12 + i12*i12*m22 AS v FROM s, w
 UNION ALL SELECT {O.text(x2)}, n, gc, b2, i12*i12*m11 + 2*i12*i22*m12 + i22*i22*m22 FROM s, w)""")
    return O.union(out)


LEVELS = (("region", "region"), ("subregion", "region, subregion"))
OLS = ("in_debt", "low_value", "line_price", "discount_share")


@register("fixed_effect_ols", O.c1(_ols_sql(OLS, LEVELS)), 5)
def fixed_effect_ols(spark, d):
    units = P.customer_units(spark, d)
    terms = [models.Regressor(c, F.col(c), c) for c in ("a0_share", "b0_share")]
    fits = models.fit_within(units, OLS, terms, "region", "subregion")
    rows = models.coefficient_table(spark, fits, terms, [P.BY_CODE[o] for o in OLS], "two shares", ["a0_share"])
    return rows.select("fixed_effect", "outcome_code", "regressor", "observations", "clusters", "coefficient", "standard_error")


def _limits_sql(outcomes) -> str:
    side = lambda sign, name: O.rd(f"coefficient {sign} {designs.t_point('clusters')} * standard_error", name, 4)
    return f"""SELECT fixed_effect, outcome_code, regressor, {O.rd('coefficient', 'coefficient', 4)}, {O.rd('standard_error', 'standard_error', 4)}, {side('-', 'low')}, {side('+', 'high')}, observations, clusters
FROM ({_ols_sql(outcomes, LEVELS, 12)})"""


@register("coefficient_intervals", O.c1(_limits_sql(OLS)), 4)
def coefficient_intervals(spark, d):
    """Limits of the coefficients from clustered errors and the t distribution."""
    units = P.customer_units(spark, d).select("region", "subregion", "a0_share", "b0_share", *OLS)
    terms = [models.Regressor(c, F.col(c), c) for c in ("a0_share", "b0_share")]
    return intervals.coefficient_intervals(spark, models.fit_within(units, OLS, terms, "region", "subregion"), terms)


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@register("stratified_ols", O.c1("SELECT * FROM (" + O.union(
    _ols_sql(("in_debt", "low_value"), LEVELS, 5, where=f"segment = {O.text(g)}", extra=f"{O.text(g)} AS stratum, ") for g in SEGMENTS) + ") WHERE observations > 0"), 5)
def stratified_ols(spark, d):
    """The two-share model in every market segment, fitted together."""
    units = P.customer_units(spark, d).select("segment", "region", "subregion", "a0_share", "b0_share", "in_debt", "low_value")
    terms = [models.Regressor(c, F.col(c), c) for c in ("a0_share", "b0_share")]
    fits = strata.stratified_fits(units, ("in_debt", "low_value"), terms, "segment", "region", "subregion")
    return fits.select("stratum", "fixed_effect", "outcome_code", "regressor", "observations", "clusters", "coefficient", "standard_error")


ZERO = 0.005
PARTS = ("b0_qty", "c0_qty", "others_qty")


def _ratio_sql() -> str:
    total = "(b0_qty + c0_qty + d0_qty + e0_qty)"
    parts = {"p1": "b0_qty", "p2": "c0_qty", "p3": "(d0_qty + e0_qty)"}
    zeros = " + ".join(f"CASE WHEN {c} = 0 THEN 1 ELSE 0 END" for c in parts.values())
    shares = ", ".join(f"CASE WHEN {c} = 0 THEN {ZERO} ELSE CAST({c} AS DOUBLE) / {total} * (1.0 - {ZERO} * ({zeros})) END AS {p}" for p, c in parts.items())
    source = f"(SELECT *, sqrt(2.0 / 3) * (ln(p1) - (ln(p2) + ln(p3)) / 2) AS first_ratio, sqrt(1.0 / 2) * (ln(p2) - ln(p3)) AS second_ratio FROM (SELECT *, {shares} FROM u WHERE {total} > 0))"
    return _ols_sql(OLS, LEVELS, 5, ("first_ratio", "second_ratio")).replace("FROM u WHERE", f"FROM {source} WHERE")


@register("log_ratio_ols", O.c1(_ratio_sql()), 5)
def log_ratio_ols(spark, d):
    """Conditions on the composition of three parts, as isometric log-ratios with zeros replaced."""
    units = P.customer_units(spark, d)
    shares = logratios.closed([F.col("b0_qty"), F.col("c0_qty"), F.col("d0_qty") + F.col("e0_qty")], ZERO)
    first, second = logratios.coordinates(shares)
    units = units.select("region", "subregion", *OLS, first.alias("first_ratio"), second.alias("second_ratio"))
    terms = [models.Regressor(c, F.col(c), c) for c in ("first_ratio", "second_ratio")]
    rows = models.coefficient_table(spark, models.fit_within(units, OLS, terms, "region", "subregion"), terms, [P.BY_CODE[o] for o in OLS], "log ratios", ["first_ratio"])
    return rows.select("fixed_effect", "outcome_code", "regressor", "observations", "clusters", "coefficient", "standard_error")


WEIGHED = ("in_debt", "few_orders", "low_value", "deep_discount", "big_lines", "line_price")


@register("index_correlations", O.c1(O.union(
    f"SELECT {O.text(a)} AS first, {O.text(b)} AS second, {O.whole(f'count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END)', 'pairs')}, "
    f"{O.rd(f'CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END', 'correlation')} FROM u" for i, a in enumerate(WEIGHED) for b in WEIGHED[i:])))
def index_correlations(spark, d):
    """Correlations of indicators over the units that have both."""
    return weights.correlations(P.customer_units(spark, d).select(*WEIGHED), WEIGHED)


@register("principal_index")
def principal_index(spark, d):
    """An index weighted by the first principal component; the loadings are tested against numpy."""
    with sinks.stored(P.customer_units(spark, d).select("unit", *WEIGHED), "weighed") as units:
        found = weights.principal_components(units, WEIGHED)
        return sinks.store(units.select("unit", found.index(0).alias("first_index"), found.index(1).alias("second_index")), "principal-index")


@register("controlled_ols")
def controlled_ols(spark, d):
    """Shares, log size and segment dummies; checked against a dense solution in the tests."""
    with sinks.stored(P.customer_units(spark, d), "customers") as units:
        terms = [models.Regressor(c, F.col(c), c) for c in ("a0_share", "b0_share", "c0_share", "d0_share")]
        terms += [models.Regressor("log_size", F.log(F.lit(1.0) + F.col("total_qty")), "log size"), *models.dummies(units, "segment", "segment", "segment")]
        fits = models.fit_within(units, OLS, terms, "region", "subregion")
    return models.coefficient_table(spark, fits, terms, [P.BY_CODE[o] for o in OLS], "controlled", ["a0_share"])


# ---------------------------------------------------------------- school survey

NI = N.ALL_INDICATORS
BY_CODE = N.BY_CODE
BINARY = [i.code for i in NI if i.kind == "binary_adverse"]
REAL = [i.code for i in NI if i.kind != "binary_adverse"]


def survey(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Phase 1: the six typed tables, written once per application and folder."""
    plans = None
    out = {}
    for name in S.COLUMNS:
        def build(name=name):
            nonlocal plans
            plans = plans or P.school_tables(spark, d)
            return plans[name]
        out[name] = sinks.stage(spark, f"survey-{name}", d, build)
    return out


def results(spark: SparkSession, d: str) -> SchoolResults:
    """Phase 2: the indicator table, written once; every result restarts from it."""
    tables = survey(spark, d)
    units = sinks.stage(spark, "survey-units", d, lambda: unit_indicators(tables))
    return SchoolResults(units, tables, STATES, MIN_W, MIN_N)


STATES = ("ASIA", "EUROPE", "AFRICA")
STATE_TEST = f"state IN ({', '.join(O.text(s) for s in STATES)})"
SELECTED_G = f",\ngs AS (SELECT * FROM g WHERE {STATE_TEST})"
SCHOOL_COUNTS = [*[SCHOOL.column(g, m) for g in SCHOOL.groups for m in (*SCHOOL.measures, *[f"{s}{x}" for s, _ in S.STAGE_LABELS for x in ("", "_boys", "_girls")])],
                 *[f"{n}_students" for n in S.OTHER_ITEMS], "total_students", "total_boys", "total_girls", "residual_students"]
SCHOOL_SHARES = [*[SCHOOL.share(g) for g in SCHOOL.groups], "a0_girls_share"]


def whole_columns(df: DataFrame, names) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


@register("school_composition", O.s1(f"SELECT pseudocode, {', '.join(O.whole(c, c) for c in SCHOOL_COUNTS)}, {', '.join(O.rd(c, c) for c in SCHOOL_SHARES)} FROM cp"))
def school_composition(spark, d):
    return whole_columns(composition(survey(spark, d)["enrolment_1"]), SCHOOL_COUNTS)


@register("school_age_grade", O.s1(f"SELECT pseudocode, {', '.join(O.whole(f'age_{a}', f'age_{a}') for a in ('total', 'over', 'under', 'on'))} FROM ag"))
def school_age_grade(spark, d):
    return whole_columns(age_grade(survey(spark, d)["enrolment_2"]), ["age_total", "age_over", "age_under", "age_on"])


@register("school_indicators", O.s1(f"SELECT pseudocode, {', '.join(O.whole(c, c) for c in BINARY)}, {', '.join(O.rd(c, c) for c in REAL)} FROM u"))
def school_indicators(spark, d):
    out = unit_indicators(survey(spark, d))
    return out.select("pseudocode", *BINARY, *[F.col(c).cast("double").alias(c) for c in REAL])


@register("school_group_totals", O.s1(O.totals_sql(SCHOOL)))
def school_group_totals(spark, d):
    return results(spark, d).group_totals()


@register("school_exposure", O.s1(O.exposure_sql(SCHOOL, NI), ",\n" + O.exposure_cte(SCHOOL, NI)))
def school_exposure(spark, d):
    return results(spark, d).exposures()


@register("school_state_exposure", O.s1(O.exposure_sql(SCHOOL, NI, ["state"]), ",\n" + O.exposure_cte(SCHOOL, NI, ["state"])))
def school_state_exposure(spark, d):
    return results(spark, d).exposures(True)


@register("school_gradient", O.s1(O.gradient_sql(NI), ",\n" + O.gradient_cte(SCHOOL, NI)))
def school_gradient(spark, d):
    return results(spark, d).gradients()


@register("school_gaps", O.s1(O.gaps_sql(SCHOOL), _lx(NI, scheme=SCHOOL)))
def school_gaps(spark, d):
    return results(spark, d).gaps()


@register("school_grids", O.s1(*(lambda chosen: (O.grid_sql(SCHOOL, chosen).split("\n", 1)[1], O.grid_sql(SCHOOL, chosen).split("\n", 1)[0]))(
    [i for i in NI if i.level == "tertiary" or i.code in S.GRID_SECONDARY])))
def school_grids(spark, d):
    return results(spark, d).grids()


@register("school_district_profile", O.s1(O.profile_sql(SCHOOL, N.pick(S.DISTRICT_PROFILE), ["state", "district"])))
def school_district_profile(spark, d):
    return results(spark, d).district_profiles()


@register("school_state_profile", O.s1(
    O.region_profile_sql(SCHOOL, N.pick(S.STATE_PROFILE), S.STAGE_LABELS, "state", "st"), ",\nst AS (SELECT * FROM cp JOIN (SELECT pseudocode, state FROM profile_1) USING (pseudocode))"))
def school_state_profile(spark, d):
    return results(spark, d).state_profiles()


def _representation_sql() -> str:
    return O.union(
        f"SELECT {O.text(g.code)} AS group_code, {O.text(g.label)} AS group_label, {O.rd('100 * a', 'staff_share_percent')}, {O.rd('100 * b', 'people_share_percent')}, {O.rd('100 * a - 100 * b', 'staff_minus_people_pp')} "
        f"FROM (SELECT {O.div(f'sum({S.STAFF_COLUMNS[g.code]})', 'sum(total_tch)')} AS a, {O.div(f'sum({SCHOOL.column(g)})', 'sum(total_students)')} AS b FROM teacher JOIN cp USING (pseudocode))"
        for g in SCHOOL.baselines
    )


@register("school_representation", O.s1(_representation_sql()))
def school_representation(spark, d):
    return results(spark, d).representation()


@register("school_numeric_summary", O.s1(O.union(
    f"""SELECT '{t}' AS source_table, '{c}' AS column_name, count(*) AS "rows", count({c}) AS nonmissing, count(*) - count({c}) AS missing, {O.rd(f'min({c})', 'minimum')},
 {O.rd(f'quantile_cont(CAST({c} AS DOUBLE), 0.1)', 'p10')}, {O.rd(f'median(CAST({c} AS DOUBLE))', 'median')}, {O.rd(f'avg({c})', 'mean')}, {O.rd(f'quantile_cont(CAST({c} AS DOUBLE), 0.9)', 'p90')}, {O.rd(f'max({c})', 'maximum')} FROM {t}"""
    for t, cols in S.SUMMARY_COLUMNS.items() for c in cols)))
def school_numeric_summary(spark, d):
    return results(spark, d).numeric_summary()


CODE_COUNTS = [*[SCHOOL.column(g) for g in SCHOOL.groups], "total_students"]


@register("school_code_audit", O.s1(O.union(
    f"""SELECT '{q.split('.')[0]}' AS source_table, '{q.split('.')[1]}' AS column_name, '{t}' AS description, CAST({q.split('.')[1]} AS VARCHAR) AS raw_code, count(*) AS units,
 {', '.join(O.whole(f'sum({c})', c) for c in CODE_COUNTS)}, {O.rd(O.div('sum(a0_students) * 100.0', 'sum(total_students)'), 'focal_share_percent')}, 'raw code only; code book required' AS interpretation_status
FROM {q.split('.')[0]} LEFT JOIN cp USING (pseudocode) GROUP BY {q.split('.')[1]}""" for q, t in S.CODED_COLUMNS.items())))
def school_code_audit(spark, d):
    return results(spark, d).code_audit()


FIRST = ",\nf0 AS (SELECT *, CASE WHEN highclass >= 10 THEN 1 ELSE 0 END AS reaches_class10, CASE WHEN highclass >= 12 THEN 1 ELSE 0 END AS reaches_class12, " \
    "CASE WHEN total_tch = 1 THEN 1 ELSE 0 END AS single_teacher, CASE WHEN total_tch > 0 AND coalesce(female, 0) = 0 THEN 1 ELSE 0 END AS no_female_teacher, " + ", ".join(
        f"({O.rule_sql(N.RULES[c])}) AS {c}" for c in ("ends_before_class10", "ends_before_class12", "str_above_30", "student_teacher_ratio", "classrooms_per_100", "grant_per_student")
    ) + f" FROM ms),\nfg AS ({O.groups_cte(SCHOOL, 'f0')})"


@register("first_condition_gradient", O.s1(
    f"""SELECT group_code, group_label, {O.whole('band_order', 'band_order')}, {O.label('band_order')} AS band, {O.whole('count(*)', 'units')}, {O.whole('sum(group_students)', 'group_members')},
 {', '.join(O.rd(f'avg({c}) * 100', f'{c}_percent') for c in FIRST_PERCENTS)}, {', '.join(O.rd(f'avg({c})', f'mean_{c}') for c in ('student_teacher_ratio', 'classrooms_per_100', 'grant_per_student', 'acad_inspections'))},
 {O.rd('median(student_teacher_ratio)', 'median_student_teacher_ratio')}, {O.rd(O.div('sum(total_class_rooms) * 100.0', 'sum(total_students)'), 'weighted_classrooms_per_100')},
 {O.rd(O.div('sum(grants_receipt)', 'sum(total_students)'), 'weighted_grant_per_student')} FROM fg GROUP BY 1, 2, band_order""", FIRST))
def first_condition_gradient(spark, d):
    return FirstResults(survey(spark, d)).gradients()


@register("first_exposure", O.s1(O.exposure_sql(SCHOOL, FIRST_OUTCOMES), FIRST + ",\n" + O.exposure_cte(SCHOOL, FIRST_OUTCOMES, denominator="all", source="fg")))
def first_exposure(spark, d):
    return FirstResults(survey(spark, d)).exposures()


@register("first_gaps", O.s1(O.gaps_sql(SCHOOL, directed=False), FIRST + _lx(FIRST_OUTCOMES[:5], scheme=SCHOOL, denominator="all", source="fg")))
def first_gaps(spark, d):
    return FirstResults(survey(spark, d)).gaps()


@register("selected_state_exposure", O.s1(O.exposure_sql(SCHOOL, N.SELECTED, ["state"]), SELECTED_G + ",\n" + O.exposure_cte(SCHOOL, N.SELECTED, ["state"], source="gs", where="TRUE")))
def selected_state_exposure(spark, d):
    return results(spark, d).selected_exposures()


@register("selected_state_gradient", O.s1(O.gradient_sql(N.SELECTED, ["state"]), SELECTED_G + ",\n" + O.gradient_cte(SCHOOL, N.SELECTED, ["state"], source="gs")))
def selected_state_gradient(spark, d):
    return results(spark, d).selected_gradients()


@register("selected_state_gap", O.s1(O.gaps_sql(SCHOOL, ["state"], directed=False), SELECTED_G + _lx(N.SELECTED, ["state"], scheme=SCHOOL, source="gs", where="TRUE")))
def selected_state_gap(spark, d):
    return results(spark, d).selected_gaps()


SS = ["state", "group_code"]
_school_combos = SELECTED_G + ",\n" + O.bundle_cte(S.COMBINATIONS, SCHOOL, SS, "gs", "bx") + ",\n" + O.bundle_cte(S.COMBINATIONS, SCHOOL, SS, "gs", "bb", True)


@register("school_combination_exposure", O.s1(O.bundle_sql(SS, "bx"), _school_combos))
def school_combination_exposure(spark, d):
    return results(spark, d).combination_exposures()


@register("school_combination_contrast", O.s1(O.contrast_sql(["state", "bundle_code"]), _school_combos + ",\n" + O.contrast_cte(SCHOOL, ["state", "bundle_code"], "bx", "bb")))
def school_combination_contrast(spark, d):
    return results(spark, d).combination_contrasts()


def _school_scopes() -> str:
    test = lambda codes: "TRUE" if codes is None else f"managment IN ({', '.join(map(str, codes))})"
    return SELECTED_G + ",\nsg AS (" + O.union(f"SELECT *, {O.text(n)} AS scope FROM gs WHERE {test(c)}" for n, c in S.SCOPE_CODES.items()) + ")"


TS, TK = ["scope", "state", "group_code"], ["scope", "state", "bundle_code"]
_tiers = _school_scopes() + f""",
s2 AS (SELECT * FROM sg WHERE scope IN ({', '.join(O.text(x) for x in S.GRADIENT_SCOPES)})),
{O.bundle_cte(S.EXTENDED_BUNDLES, SCHOOL, TS, 'sg', 'bx')},
{O.bundle_cte(S.EXTENDED_BUNDLES, SCHOOL, TS, 's2', 'bb', True)},
b2 AS (SELECT * FROM bx WHERE scope IN ({', '.join(O.text(x) for x in S.GRADIENT_SCOPES)})),
{O.contrast_cte(SCHOOL, TK, 'b2', 'bb')},
{O.ranking_cte(TK, MIN_W, MIN_N)}"""


@register("school_scope_exposure", O.s1(O.bundle_sql(TS, "bx"), _tiers))
def school_scope_exposure(spark, d):
    return results(spark, d).scope_exposures()


@register("school_scope_ranking", O.s1(O.ranking_sql(TK), _tiers))
def school_scope_ranking(spark, d):
    return results(spark, d).scope_ranking()


_country = f""",
sc AS ({O.union(f"SELECT *, {O.text(n)} AS scope FROM g WHERE " + ('TRUE' if S.SCOPE_CODES[n] is None else f"managment IN ({', '.join(map(str, S.SCOPE_CODES[n]))})") for n in S.GRADIENT_SCOPES)}),
ra AS (SELECT *, 'NATIONAL' AS area FROM sc WHERE group_code IN ('A0', 'B0') UNION ALL SELECT *, state AS area FROM sc WHERE group_code IN ('A0', 'B0') AND {STATE_TEST}),
{O.bundle_cte(S.EXTENDED_BUNDLES, SCHOOL, AG, 'ra', 'ab', True)},
{O.estimands_cte(AK, 'ab')},
{O.matched_cte([*AK, 'estimand'], 'es', 'A0', 'B0')},
{O.summary_cte(AK)}"""


@register("school_area_summary", O.s1(_summary_select, _country))
def school_area_summary(spark, d):
    return results(spark, d).area_summaries()


KEY = N.pick(S.KEY_OUTCOMES)


@register("school_slopes", O.s1(O.slopes_sql("a0_share", KEY, "state", "district")), 5)
def school_slopes(spark, d):
    return results(spark, d).slopes()


@register("school_state_slopes", O.s1(O.slopes_sql("a0_share", N.pick(S.REGION_SLOPE_OUTCOMES), "state", "district", True)), 5)
def school_state_slopes(spark, d):
    return results(spark, d).state_slopes()


@register("school_evidence", O.s1(O.evidence_sql(SCHOOL, KEY, "a0_share", "state", "district", "B0"), _lx(KEY, scheme=SCHOOL)).replace(")\n, sl AS", "),\nsl AS"))
def school_evidence(spark, d):
    return results(spark, d).evidence()


@register("school_adjusted_models")
def school_adjusted_models(spark, d):
    return results(spark, d).adjusted_models()


@register("school_interaction_models")
def school_interaction_models(spark, d):
    return results(spark, d).interaction_models()


@register("school_pair_models")
def school_pair_models(spark, d):
    return results(spark, d).pair_models()
