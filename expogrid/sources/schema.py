"""Declared table schemas: names, order, types and the checks against a real header."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def normal_name(name: str) -> str:
    return name.replace("﻿", "").strip().lower()


@dataclass(frozen=True)
class TableSchema:
    name: str
    expected: tuple[str, ...]
    required: tuple[str, ...] = ()
    strings: frozenset[str] = frozenset()
    doubles: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        known, both = set(self.expected), self.strings & self.doubles
        if both:
            raise ValueError(f"{self.name}: columns in two type lists: {sorted(both)}")
        for group in (self.strings, self.doubles, set(self.required)):
            if group - known:
                raise ValueError(f"{self.name}: unknown columns {sorted(group - known)}")

    def kind(self, column: str) -> str:
        return "string" if column in self.strings else "double" if column in self.doubles else "bigint"

    def types(self) -> dict[str, str]:
        return {c: self.kind(c) for c in self.expected}

    def struct(self) -> T.StructType:
        real = {"string": T.StringType(), "double": T.DoubleType(), "bigint": T.LongType()}
        return T.StructType([T.StructField(c, real[self.kind(c)]) for c in self.expected])

    def check_columns(self, columns: Sequence[str]) -> None:
        found = [normal_name(c) for c in columns]
        if found != list(self.expected):
            missing = [c for c in self.expected if c not in found]
            extra = [c for c in found if c not in self.expected]
            raise ValueError(f"{self.name}: columns differ in name or order; missing {missing}, unexpected {extra}")


def type_map(expected: dict[str, Sequence[str]], special: dict[str, dict[str, Sequence[str]]], required: dict[str, Sequence[str]] | None = None) -> dict[str, TableSchema]:
    """Build schemas from two mappings: expected columns per table, and per table the string and double lists.

    A type list that names an unknown table or column, or a column twice, is an error.
    """
    stray = set(special) - set(expected)
    if stray:
        raise ValueError(f"type lists for unknown tables: {sorted(stray)}")
    return {
        t: TableSchema(
            t, tuple(cols), tuple((required or {}).get(t, ())),
            frozenset(special.get(t, {}).get("string", ())), frozenset(special.get(t, {}).get("double", ())),
        )
        for t, cols in expected.items()
    }


def compare_schema(spark: SparkSession, table: str, columns: Sequence[str], schema: TableSchema) -> DataFrame:
    """Drift report: one row per finding (missing expected, unexpected, missing required)."""
    actual = {normal_name(c) for c in columns}
    expected, required = set(schema.expected), set(schema.required)
    rows = [(table, finding, c) for finding, names in (
        ("missing_expected", expected - actual), ("unexpected", actual - expected), ("missing_required", required - actual)
    ) for c in sorted(names)]
    return spark.createDataFrame(rows, "source_table string, finding string, column_name string")


def column_inventory(spark: SparkSession, tables: dict[str, DataFrame], key: str, coded: Sequence[str] = ()) -> DataFrame:
    """Every source column: table, ordinal, name, type, nullability, codebook flag and role."""
    listed = set(coded)
    rows = [
        (t, n, f.name, f.dataType.simpleString(), f.nullable, True, f"{t}.{f.name}" in listed,
         "unit identifier" if f.name == key else "directly recorded parameter")
        for t, df in tables.items() for n, f in enumerate(df.schema.fields, start=1)
    ]
    return spark.createDataFrame(rows, (
        "source_table string, ordinal int, column_name string, data_type string, nullable boolean, "
        "primary_indicator boolean, codebook_required boolean, analysis_role string"
    ))
