import pytest

from expogrid.functions.model import EXPOSED, Indicator, check_registry
from expogrid.presets import indicators as N
from expogrid.presets import schools as S
from expogrid.sources.schema import TableSchema, normal_name, type_map


def test_registry_shape():
    assert len(N.SECONDARY_INDICATORS) == 108 and len(N.TERTIARY_INDICATORS) == 15
    girls = {i.code for i in N.ALL_INDICATORS if i.weight == "girls"}
    assert girls == set(N.GIRLS_WEIGHTED) and len(girls) == 6
    assert set(S.KEY_OUTCOMES + S.PRINCIPAL_OUTCOMES + S.PAIR_OUTCOMES) <= set(N.BY_CODE)
    assert len(S.CODED_COLUMNS) == 24 and sum(map(len, S.SUMMARY_COLUMNS.values())) == 59


def test_registry_faults():
    one = Indicator("a", "a", EXPOSED)
    with pytest.raises(ValueError, match="repeated"):
        check_registry((one, one))
    with pytest.raises(ValueError, match="without a known measure"):
        check_registry((Indicator("b", "b", "odd"),))


def test_lattice_and_bundles():
    assert len(S.COMBINATIONS) == 289 and len({b.code for b in S.COMBINATIONS}) == 289
    assert sum(len(b.members) >= 4 for b in S.COMBINATIONS) == 3
    for b in S.COMBINATIONS:
        special = {"no_female_teacher", "no_functional_girls_toilet"} & set(b.members)
        assert b.weight == ("girls" if special else "students")
    assert len(S.BASE_BUNDLES) == 26 and len(S.EXTENDED_BUNDLES) == 40
    members = {m for b in S.EXTENDED_BUNDLES for m in b.members}
    assert all(N.BY_CODE[m].kind == "binary_adverse" for m in members)


def test_units_and_multipliers():
    assert N.BY_CODE["no_library"].multiplier == 100 and N.BY_CODE["no_library"].unit == "percent exposed"
    assert N.BY_CODE["over_age_share"].unit == "percent" and N.BY_CODE["grant_per_student"].unit == "rupees per student"
    assert N.BY_CODE["access_deprivation_index"].multiplier == 1 and N.BY_CODE["classrooms_per_100"].unit == "per 100 students"
    assert N.BY_CODE["instructional_days"].direction == "higher_better"


def test_schemas():
    assert [len(S.SCHEMAS[t].expected) for t in S.COLUMNS] == [38, 17, 70, 29, 29, 38]
    assert S.SCHEMAS["profile_2"].kind("grants_receipt") == "double" and S.SCHEMAS["profile_1"].kind("state") == "string"
    assert all("pseudocode" in s.required for s in S.SCHEMAS.values())
    assert normal_name("﻿ State ") == "state"
    S.SCHEMAS["teacher"].check_columns([c.upper() for c in S.COLUMNS["teacher"]])
    with pytest.raises(ValueError, match="order"):
        S.SCHEMAS["teacher"].check_columns(list(reversed(S.COLUMNS["teacher"])))
    with pytest.raises(ValueError, match="unknown columns"):
        type_map({"t": ["a"]}, {"t": {"string": ["b"]}})
    with pytest.raises(ValueError, match="two type lists"):
        TableSchema("t", ("a",), (), frozenset({"a"}), frozenset({"a"}))
