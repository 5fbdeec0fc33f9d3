"""Panels over the driver tables, shaped like the tables the library works on.

``customer_units``: one row per customer; long counts are the quantities of its order
lines, grouped by order priority (baselines) and by return flag (focal).
``school_tables``: the six survey tables, derived from customers and order lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import holds
from ..functions.model import EXPOSED, Bundle, Group, GroupScheme, Indicator, better, worse
from ..operators import compose
from ..operators.bundles import lattice
from ..operators.keys import by_unit, unit_rows
from ..presets import schools as S


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


SCHEME = GroupScheme(
    (
        Group("A0", "Returned", (2, "R")),
        Group("B0", "Urgent", (1, "1-URGENT")),
        Group("C0", "High", (1, "2-HIGH")),
        Group("D0", "Medium", (1, "3-MEDIUM")),
        Group("E0", "Low", (1, "5-LOW")),
    ),
    ("qty", "qty_o", "qty_f"),
)
# stage suffix, label, years
STAGES = (("s1", "1995-96", (1995, 1996)), ("s2", "1997-98", (1997, 1998)), ("s3", "1999-2000", (1999, 2000)), ("s4", "2001", (2001,)))
STAGE_LABELS = tuple((s, label) for s, label, _ in STAGES)

INDICATORS = (
    Indicator("in_debt", "Negative balance", EXPOSED, "money", weight="qty"),
    Indicator("few_orders", "Fewer than nine orders", EXPOSED, "volume", weight="qty"),
    Indicator("low_value", "Low mean line price", EXPOSED, "money", weight="qty_f"),
    Indicator("deep_discount", "Mean discount above five percent", EXPOSED, "price", weight="qty"),
    Indicator("big_lines", "Mean line above 25.5 pieces", EXPOSED, "volume", weight="qty"),
    Indicator("no_recent", "No order in 2001", EXPOSED, "volume", weight="qty_f"),
    Indicator("balance_per_order", "Balance per order", better(1.0, "raw value", "outcome units"), "money", weight="qty"),
    Indicator("discount_share", "Mean discount", worse(100.0, "percent", "percentage points"), "price", weight="qty"),
    Indicator("line_price", "Mean line price", better(1.0, "raw value", "outcome units"), "price", weight="qty_f"),
)
FLAGS = INDICATORS[:6]
CODES = [i.code for i in INDICATORS]
BY_CODE = {i.code: i for i in INDICATORS}

COMBINATIONS = lattice(
    [(i.code, i.label, i.domain, "qty_f" if i.weight == "qty_f" else "students") for i in FLAGS], (2, 3),
    [("all_money", ("in_debt", "low_value", "deep_discount")), ("everything", tuple(i.code for i in FLAGS))],
)
BUNDLES = (
    Bundle("debt", "debt", ("in_debt",), "qty", mechanism="money"),
    Bundle("thin", "thin", ("few_orders", "low_value"), "qty_f", mechanism="volume"),
    Bundle("cheap", "cheap", ("deep_discount", "big_lines"), "qty", mechanism="price"),
    Bundle("stale", "stale", ("few_orders", "no_recent"), "qty_f", mechanism="volume"),
    Bundle("wide", "wide", ("big_lines", "deep_discount", "few_orders"), "qty", mechanism="mixed"),
)
SCOPE_SEGMENTS = {
    "everyone": None,
    "goods": ("AUTOMOBILE", "MACHINERY", "FURNITURE"),
    "homes": ("HOUSEHOLD", "FURNITURE"),
    "sites": ("BUILDING", "MACHINERY"),
}


def scopes(*names: str):
    return {
        n: F.lit(True) if SCOPE_SEGMENTS[n] is None else F.col("segment").isin(list(SCOPE_SEGMENTS[n]))
        for n in (names or SCOPE_SEGMENTS)
    }


def order_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Long counts: customer x item group x item, one row per order and dimension.

    Lines are folded per order before the join, so the join moves one row per order, and
    the fold and the join share their partitioning.
    """
    lines = table(spark, folder, "lineitem")
    qty, status, back = F.col("l_quantity"), F.col("l_linestatus"), F.col("l_returnflag") == "R"
    zero = F.lit(0.0)
    kinds = {"qty": F.lit(True), "qty_o": status == "O", "qty_f": status == "F"}
    folded = lines.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"),
        F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("points"),
        *[F.sum(F.when(test, qty).otherwise(zero)).alias(n) for n, test in kinds.items()],
        *[F.sum(F.when(test & back, qty).otherwise(zero)).alias(f"r_{n}") for n, test in kinds.items()],
    )
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("unit"), "o_orderpriority", F.year("o_orderdate").alias("y")
    )
    joined = orders.join(unit_rows(folded), "l_orderkey")
    stages = lambda prefix: {s: F.when(F.col("y").isin(list(years)), F.col(f"{prefix}qty")).otherwise(zero) for s, _, years in STAGES}
    once = {"orders": F.lit(1), "recent": holds(F.col("y") == 2001)} | {n: F.col(n) for n in ("lines", "cents", "points")}
    none = {n: F.lit(0) for n in once}
    records = [
        {"item_group": F.lit(1), "item": F.col("o_orderpriority")} | {n: F.col(n) for n in kinds} | stages("") | {n: c.cast("long") for n, c in once.items()},
        {"item_group": F.lit(2), "item": F.lit("R")} | {n: F.col(f"r_{n}") for n in kinds} | stages("r_") | {n: c.cast("long") for n, c in none.items()},
    ]
    return joined.select("unit", F.inline(F.array(*[F.struct(*[c.alias(n) for n, c in r.items()]) for r in records])))


EXTRAS = ("orders", "recent", "lines", "cents", "points")


def customer_composition(spark: SparkSession, folder: str) -> DataFrame:
    long = order_counts(spark, folder)
    matches = {g.prefix: (F.col("item_group") == g.item[0]) & (F.col("item") == g.item[1]) for g in SCHEME.groups}
    matches["sum"] = F.col("item_group") == 1
    counts = [*SCHEME.measures, *[s for s, _, _ in STAGES]]
    only = {g.prefix: counts for g in SCHEME.groups} | {"sum": ["qty", *EXTRAS]}
    pivoted = compose.conditional_pivot(long, "unit", [*counts, *EXTRAS], matches, only)
    return compose.with_shares(pivoted, SCHEME, ["sum_qty"])


def customer_master(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select("n_nationkey", F.col("r_name").alias("region"), F.col("n_name").alias("subregion"))
    # Said outright: by its file the customers' table looks smaller than the product of the other two and would be sent round.
    return table(spark, folder, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("unit"), "region", "subregion", F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")
    )


def customer_units(spark: SparkSession, folder: str) -> DataFrame:
    """Panel 1: customers with composition and nine indicators; one indicator is unknown for one segment."""
    base = compose.indicator_base(customer_master(spark, folder), customer_composition(spark, folder), "unit", SCHEME.total())
    lines = F.col("sum_lines")
    return base.withColumns({
        "in_debt": holds(F.col("balance") < 0),
        "few_orders": holds(F.col("sum_orders") < 9),
        "low_value": F.when(F.col("segment") != "BUILDING", holds(F.col("sum_cents") < lines * 5_000_000)),
        "deep_discount": holds(F.col("sum_points") > lines * 5),
        "big_lines": holds(F.col("sum_qty") * 2 > lines * 51),
        "no_recent": holds(F.col("sum_recent") == 0),
        "balance_per_order": F.col("balance") / F.col("sum_orders"),
        "discount_share": F.col("sum_points") / lines / F.lit(100.0),
        "line_price": F.when(F.col("segment") != "MACHINERY", F.col("sum_cents") / lines / F.lit(100.0)),
    })


def customer_long(spark: SparkSession, folder: str) -> DataFrame:
    return compose.group_long(
        customer_units(spark, folder), SCHEME, ["unit", "region", "subregion", "segment", SCHEME.total(), *CODES]
    )


# Values of the derived survey tables. Each column's text is valid in Spark SQL and in
# ANSI SQL; ``k`` is the unit key.
THREE_CODES = ("furniture_availability", "electricity_availability", "spl_educator_yn", "resi_school")
CODES_CYCLE = "1 2 3 4 5 6 7 89 90 97 99 10".split()
SIZES = {"total_tch": 60, "total_class_rooms": 20, "avg_instr_days": 240, "pincode": 50}
COUNTS = {c for cols in S.SUMMARY_COLUMNS.values() for c in cols} | {
    c for c in S.COLUMNS["teacher"] if c != S.KEY
}
GAPS = {"profile_2": 17, "facility": 23, "teacher": 19}


def survey_value(column: str, number: int) -> str:
    h = f"(((k % 9973) * (k % 9973) + (k % 101) * {2 * number + 1} + {31 * number}) % 97)"
    unknown = f"CASE WHEN {h} % 11 = 0 THEN NULL ELSE {{}} END"
    if column == "managment":
        arms = " ".join(f"WHEN {i} THEN {code}" for i, code in enumerate(CODES_CYCLE))
        return f"CASE {h} % 12 {arms} END"
    if column.startswith("grants_"):
        return f"CASE WHEN {h} % 11 = 0 THEN NULL WHEN {h} % 3 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST({h} AS DOUBLE) * 100 END"
    if column == "lowclass":
        return f"1 + {h} % 6"
    if column == "highclass":
        return f"5 + {h} % 8"
    if column in THREE_CODES:
        return unknown.format(f"1 + {h} % 3")
    if column in ("rural_urban", "school_category"):
        return f"1 + {h} % {2 if column == 'rural_urban' else 4}"
    if column in COUNTS or column == "pincode":
        return unknown.format(f"{h} % {SIZES.get(column, 5)}")
    if column in S.TYPES["profile_1"]["string"]:
        return f"CONCAT('{column[:5]}', CAST({h} % 7 AS VARCHAR(10)))"
    return unknown.format(f"1 + {h} % 2")


def survey_columns(name: str) -> dict[str, str]:
    """Column -> value text of a derived unit table, without key and place names."""
    return {
        c: survey_value(c, n + 40 * list(S.COLUMNS).index(name)) for n, c in enumerate(S.COLUMNS[name]) if c not in (S.KEY, "state", "district")
    }


def school_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Panel 3: customers as schools, order lines as enrolment."""
    customers = table(spark, folder, "customer").count()
    units = customer_master(spark, folder).select(F.col("unit").alias("k"), F.col("region").alias("state"), F.col("subregion").alias("district"))
    units = by_unit(units, customers, "k")  # the files of so narrow a table make few tasks, its hundreds of columns need many
    out = {}
    for name in ("profile_1", "profile_2", "facility", "teacher"):
        rows = units.filter(F.col("k") % GAPS[name] != 0) if name in GAPS else units
        values = {S.KEY: F.col("k")} | ({"state": F.col("state"), "district": F.col("district")} if name == "profile_1" else {})
        values |= {c: F.expr(text) for c, text in survey_columns(name).items()}
        kinds = S.SCHEMAS[name]
        out[name] = rows.select(*[values[c].cast(kinds.kind(c)).alias(c) for c in kinds.expected])

    # The lines move twice, so only what the items are made from goes along; the second time by school, and the items
    # are summed where they are.
    small = lambda c: c.cast("byte")
    bought = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias(S.KEY), F.col("o_orderpriority").substr(1, 1).alias("place"))
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", small(F.col("l_partkey") % 12 + 1).alias("class"), F.col("l_quantity").cast("long").alias("n"),
        small(F.col("l_partkey") % 12 * 2 + F.when(F.col("l_linestatus") == "O", 0).when(F.col("l_linestatus") == "F", 1)).alias("slot"),
        "l_returnflag", F.col("l_linenumber").cast("long").alias("line"), small(F.col("l_partkey") % 5).alias("part"), small(F.col("l_suppkey") % 5).alias("supplier"),
    )
    lines = by_unit(lines, customers, "l_orderkey").join(unit_rows(by_unit(bought, customers, "l_orderkey")), "l_orderkey")
    lines = by_unit(lines.drop("l_orderkey"), customers, S.KEY)
    place = F.col("place").cast("long")
    flag, line = F.col("l_returnflag"), F.col("line")
    item = lambda group, number, test=None: F.when(F.lit(True) if test is None else test, F.struct(
        F.lit(group).cast("long").alias("item_group"), number.cast("long").alias("item_id")))
    items = F.array(
        item(1, F.when(place == 5, 4).otherwise(place), place != 4),
        item(2, F.when(flag == "R", 5).when(flag == "A", 6).otherwise(line % 4 + 7)),
        item(3, F.lit(13), line == 1), item(10, F.lit(32), line == 2), item(5, F.lit(0), line == 3),
        item(4, F.col("part"), line == 4),
    )
    sums = [F.sum(F.when(F.col("slot") == 2 * (n - 1) + i, F.col("n"))).alias(f"c{n}_{sex}") for n in range(1, 13) for i, sex in enumerate("bg")]
    long = lambda df: df.groupBy(S.KEY, "item_group", "item_id").agg(*sums).withColumns({c: F.lit(None).cast("long") for c in ("cpp_b", "cpp_g")})
    one = lines.withColumn("item", F.explode(items)).filter(F.col("item").isNotNull()).select("*", "item.*")
    two = lines.filter(F.col(S.KEY) % 13 != 0).withColumns({
        "item_group": F.lit(8).cast("long"), "item_id": F.col("class").cast("long") + 3 + F.col("supplier"),
    })
    out["enrolment_1"] = long(one).select(*S.COLUMNS["enrolment_1"])
    out["enrolment_2"] = long(two).select(*S.COLUMNS["enrolment_2"])
    return out
