import pytest

from expogrid.operators import audit
from expogrid.sources import ingest, sinks
from expogrid.sources.schema import TableSchema, compare_schema

SCHEMA = TableSchema("t", ("id", "name", "amount"), ("id",), frozenset({"name"}), frozenset({"amount"}))


def write(tmp_path, text, name="t.csv"):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_clean_file_with_short_row(spark, tmp_path):
    src = write(tmp_path, "﻿ID, Name ,amount\n1, a ,2.5\n2.6,,\n3\n")
    done = ingest.ingest(spark, src, str(tmp_path / "out"), SCHEMA)
    rows = [tuple(r) for r in spark.read.parquet(done.path).orderBy("id").collect()]
    assert rows == [(1, "a", 2.5), (3, None, None), (3, None, None)] and done.rows == 3
    row = ingest.manifest(spark, [done]).first()
    assert (row["rows"], row["column_count"], row["columns"]) == (3, 3, "id bigint, name string, amount double") and row["bytes"] > 0
    found = ingest.profile(spark.read.parquet(done.path), SCHEMA, "id", ["name"])
    assert found["schema"].count() == 0 and found["key"].first()["keys_with_multiple_rows"] == 1 and found["items"].count() == 2


def test_bad_cast_aborts(spark, tmp_path):
    src = write(tmp_path, "id,name,amount\n1,a,x\n2,b,3\n")
    with pytest.raises(ingest.IngestError, match="amount"):
        ingest.ingest(spark, src, str(tmp_path / "out"), SCHEMA)
    found = ingest.cast_audit(ingest.scan_text(spark, src, SCHEMA.expected), SCHEMA).collect()
    assert {r["column_name"]: (r["filled"], r["failed"]) for r in found} == {"id": (2, 0), "amount": (2, 1)}


def test_long_row_strict_and_tolerant(spark, tmp_path):
    src = write(tmp_path, "id,name,amount\n1,a,1\n2,b,2,9\n")
    with pytest.raises(ingest.IngestError, match="more fields"):
        ingest.ingest(spark, src, str(tmp_path / "strict"), SCHEMA)
    assert [p.name for p in tmp_path.iterdir()] == ["t.csv"]
    done = ingest.ingest(spark, src, str(tmp_path / "soft"), SCHEMA, tolerant=True)
    assert (done.rows, done.skipped_rows, done.fallback) == (1, 1, False)
    with pytest.raises(ingest.IngestError, match="exists"):
        ingest.ingest(spark, src, str(tmp_path / "soft"), SCHEMA)
    again = ingest.ingest_or_fall_back(spark, src, str(tmp_path / "again"), SCHEMA)
    assert (again.rows, again.skipped_rows, again.fallback) == (1, 1, True)


def test_repeated_key_is_refused(spark, tmp_path):
    src = write(tmp_path, "id,name,amount\n1,a,1\n1,b,2\n")
    with pytest.raises(ingest.IngestError, match="not unique"):
        ingest.ingest(spark, src, str(tmp_path / "out"), SCHEMA, unique="id")
    assert [p.name for p in tmp_path.iterdir()] == ["t.csv"]


def test_drift(spark, tmp_path):
    src = write(tmp_path, "id,amount,name\n1,1,a\n")
    with pytest.raises(ValueError, match="order"):
        ingest.ingest(spark, src, str(tmp_path / "out"), SCHEMA)
    found = {(r["finding"], r["column_name"]) for r in compare_schema(spark, "t", ["NAME", "extra"], SCHEMA).collect()}
    assert found == {("missing_expected", "id"), ("missing_expected", "amount"), ("unexpected", "extra"), ("missing_required", "id")}


def test_resolution(spark, tmp_path):
    for n in ("profile_1_x.csv", "profile_2_x.csv", "notes.txt"):
        write(tmp_path, "a\n", n)
    found = ingest.resolve_sources(spark, str(tmp_path), {"one": "profile_1*", "two": "profile_2*"})
    assert {r["source_table"] for r in found.collect()} == {"one", "two"}
    with pytest.raises(ingest.IngestError, match="exactly one"):
        ingest.resolve_sources(spark, str(tmp_path), {"one": "profile_*"})


def test_key_profile_counts_blank_as_missing(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (" ",), (None,)], "k string")
    r = audit.key_profile(df, "k").first()
    assert (r["row_count"], r["unique_keys"], r["rows_with_key"], r["keys_with_multiple_rows"], r["missing_key_rows"], r["median_rows_per_key"]) == (5, 2, 3, 1, 2, 1.5)


def test_unique_keys_enforced(spark):
    with pytest.raises(ValueError, match="not unique"):
        audit.require_unique(spark.createDataFrame([(1,), (1,)], "k long"), "k")


def test_sinks(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "i long, s string"), spark.createDataFrame([(2, 0.5)], "i long, d double")
    both = sinks.stack([a, b])
    assert both.columns == ["i", "s", "d"]
    sinks.write_result(both, str(tmp_path / "csv"))
    back = sinks.read_result(spark, str(tmp_path / "csv"), "i long, s string, d double")
    assert {tuple(r) for r in back.collect()} == {(1, "x", None), (2, None, 0.5)}
    kept = sinks.write_checkpoint(both, str(tmp_path / "ck"), "s")
    assert kept.columns == both.columns and kept.count() == 2
    assert sinks.fingerprint(both).first() == sinks.fingerprint(both.orderBy("d")).first()


def test_checkpoint_keeps_region_text(spark, tmp_path):
    rows = [("01", 1), ("02", 2), (None, 3)]
    df = spark.createDataFrame(rows, "state string, v long")
    back = sinks.write_checkpoint(df, str(tmp_path / "ck"), "state")
    assert back.schema["state"].dataType == df.schema["state"].dataType
    assert {tuple(r) for r in back.collect()} == set(rows)


def test_stored_copy_goes_with_its_block(spark, tmp_path):
    with sinks.stored(spark.range(3).toDF("v"), "t", str(tmp_path)) as kept:
        assert kept.count() == 3 and len(list(tmp_path.iterdir())) == 1
    assert not list(tmp_path.iterdir())


def test_stage_sees_changed_files(spark, tmp_path):
    source = str(tmp_path / "in")
    read = lambda: sinks.stage(spark, "numbers", source, lambda: spark.read.parquet(source)).count()
    spark.range(3).write.parquet(source)
    assert read() == 3 and read() == 3
    spark.range(5).write.mode("overwrite").parquet(source)
    assert read() == 5


def test_fingerprint_tells_fields_apart(spark):
    prints = {sinks.fingerprint(spark.createDataFrame([row], "a string, b string")).first()["fingerprint"] for row in (("a|b", "c"), ("a", "b|c"), ("a", None), (None, "a"))}
    assert len(prints) == 4
    assert sinks.fingerprint(spark.createDataFrame([("x",), ("x",)], "a string")).first()["fingerprint"] != sinks.fingerprint(spark.createDataFrame([("x",)], "a string")).first()["fingerprint"]
