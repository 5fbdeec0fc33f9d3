from pathlib import Path

import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables not present")
def test_catalogue_and_keys(spark):
    from expogrid.operators.bundles import bundle_catalogue
    from expogrid.plans import panels
    from expogrid.plans.schools import SchoolResults, check_keys
    from expogrid.presets import schools as S

    tables = panels.school_tables(spark, FOLDER)
    for name, df in tables.items():
        S.SCHEMAS[name].check_columns(df.columns)
        assert [f.dataType for f in df.schema.fields] == [f.dataType for f in S.SCHEMAS[name].struct().fields]
    check_keys(tables)
    shown = SchoolResults(tables["profile_1"], tables)
    assert shown.inventory().count() == 221 and shown.inventory().filter("codebook_required").count() == 24
    assert shown.catalogue().count() == 221 + 123
    assert bundle_catalogue(spark, S.COMBINATIONS).filter("weighting = 'girls'").count() == sum(b.weight == "girls" for b in S.COMBINATIONS)


def test_rows_of_schools_are_merged_and_dealt_by_their_number(spark, tmp_path, monkeypatch):
    """No table with a row per school is broadcast, and more schools make more tasks, however small the files are."""
    from expogrid.operators import audit, keys
    from expogrid.plans import panels
    from expogrid.plans.schools import composition, first_units
    from expogrid.presets import schools as S

    rows = {
        "customer": ([(k, k % 2, "BUILDING", 1.5) for k in range(1, 61)], "c_custkey long, c_nationkey long, c_mktsegment string, c_acctbal double"),
        "nation": ([(0, "n", 0), (1, "m", 0)], "n_nationkey long, n_name string, n_regionkey long"),
        "region": ([(0, "ASIA")], "r_regionkey long, r_name string"),
        "orders": ([(o, 1 + o % 60, "1-URGENT") for o in range(300)], "o_orderkey long, o_custkey long, o_orderpriority string"),
        "lineitem": ([(o, 7 * o, o, 1 + o % 4, 3.0, "R" if o % 3 else "N", "OF"[o % 2]) for o in range(300)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    monkeypatch.setattr(keys, "UNITS_PER_TASK", 4, raising=False)
    built = panels.school_tables(spark, str(tmp_path))
    tables = {}
    for name, df in built.items():
        df.write.parquet(f"{tmp_path}/survey/{name}")
        tables[name] = spark.read.parquet(f"{tmp_path}/survey/{name}")
    assert built["facility"].rdd.getNumPartitions() == 15
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    units = first_units(tables)
    audited = audit.raw_code_audit(tables["facility"], composition(tables["enrolment_1"]), S.KEY, {"solar_panel": "x"}, ["total_students"], "total_students", "total_students", "facility")
    assert "Broadcast" not in plan(units) and "Broadcast" not in plan(audited)
    assert plan(units).count("REPARTITION_BY_NUM") >= 5 and units.count() == 60


def test_places_are_sent_to_the_customers(spark, tmp_path):
    """Customers stay where they are, however small their file is; lines count by class and status, unknown ones nowhere."""
    from expogrid.plans import panels

    rows = {
        "customer": ([(k, k % 2, "BUILDING", 1.5) for k in range(1, 4)], "c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double"),
        "nation": ([(0, "n", 0), (1, "m", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(0, "ASIA")], "r_regionkey int, r_name string"),
        "orders": ([(o, 1 + o, "1-URGENT") for o in range(3)], "o_orderkey long, o_custkey long, o_orderpriority string"),
        "lineitem": ([(0, 0, 1, 1, 3.0, "R", "O"), (0, 11, 1, 1, 4.0, "R", "F"), (0, 11, 1, 1, 5.0, "R", None), (1, -1, 1, 2, 6.0, "R", "F"), (1, None, 1, 2, 7.0, "R", "O")],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    plan = panels.customer_master(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "c_nationkey" in line]
    assert len(joins) == 1 and "BuildRight" in joins[0]
    found = panels.school_tables(spark, str(tmp_path))["enrolment_1"].filter("item_group = 1").collect()
    counted = {r["pseudocode"]: {c: r[c] for c in r.asDict() if c[0] == "c" and r[c] is not None} for r in found}
    assert counted == {1: {"c1_b": 3, "c12_g": 4}, 2: {}}
