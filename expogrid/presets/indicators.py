"""The registry of school indicators: 108 conditions and 15 indices.

Codes, labels, columns, code lists, limits and index members are fixed values of the
published analysis; the rules that read them are in ``functions.rules``.
"""

from __future__ import annotations

from dataclasses import replace

from ..functions.model import EXPOSED, About, Indicator, Measure, better, check_registry, worse
from ..functions.rules import (
    Absent, AbsentAmong, Answer, BothLack, Crowded, HasWithout, Mean, NoneWorks, Per, Product, Test, Total, Unspent, Value,
    Where, ZeroCount,
)
from .schools import COLUMNS, KEY

# How each condition is shown (scale, unit) and the unit of its model coefficients.
BAD = EXPOSED
UP_SHARE, DOWN_SHARE = better(100.0, "percent", "percentage points"), worse(100.0, "percent", "percentage points")
UP_PER_100 = better(1.0, "per 100 students", "outcome units")
UP_NUMBER = better(1.0, "raw value", "outcome units")
UP_RUPEES, UP_RUPEES_RAW = better(1.0, "rupees per student", "rupees per student"), better(1.0, "rupees per student", "outcome units")
DOWN_PER_TEACHER = worse(1.0, "students per teacher", "students per teacher")
DOWN_PER_CLASSROOM = worse(1.0, "students per classroom", "outcome units")
DOWN_INDEX = worse(1.0, "index 0-100", "index points")

PUPILS, BOYS, GIRLS, STAFF, ROOMS = "total_students", "total_boys", "total_girls", "total_tch", "total_class_rooms"
WORKING_WATER = (
    "hand_pump_fun_yn", "well_prot_fun_yn", "tap_fun_yn", "othsrc_fun_yn", "well_unprot_fun_yn", "pack_water_fun_yn",
)
WATER = ("hand_pump_yn", "well_prot_yn", "tap_yn", "othsrc_yn", "well_unprot_yn", "pack_water_yn")
DEVICES = ("laptop", "tablet", "desktop")
ACCESSIBLE_TOILETS = ("func_boys_cwsn_friendly", "func_girls_cwsn_friendly")
VISITS = ("acad_inspections", "crc_coordinator", "block_level_officers", "district_officers")

# Classes taught: (lowest class at most, highest class at least) and how it is worded.
TAUGHT = {
    "class1": ((1, 1), "schools offering Class 1"),
    "primary": ((5, 1), "schools offering primary grades"),
    "upper": ((8, 6), "schools offering upper-primary grades"),
    "secondary": ((10, 9), "schools offering secondary grades"),
    "higher": ((12, 11), "schools offering higher-secondary grades"),
}
WITH_CWSN = "schools reporting CWSN enrolment"


def taught(level: str, rule: object) -> Where:
    low, high = TAUGHT[level][0]
    return Where((("lowclass", "<=", low), ("highclass", ">=", high)), rule)


def with_cwsn(rule: object) -> Where:
    return Where((("cwsn_students", ">", 0),), rule)


# domain -> (code, label, measure, rule)
SECONDARY = {
    "access": (
        ("ends_before_class10", "School ends before Class 10", BAD, Test("highclass", "<", 10)),
        ("ends_before_class12", "School ends before Class 12", BAD, Test("highclass", "<", 12)),
        ("primary_only_school", "School ends at or before Class 5", BAD, Test("highclass", "<=", 5)),
        ("elementary_only_school", "School ends at or before Class 8", BAD, Test("highclass", "<=", 8)),
        ("no_all_weather_road", "No all-weather road access", BAD, Answer("approachable_road")),
        ("no_pre_primary", "No attached pre-primary section", BAD, taught("class1", Answer("pre_primary"))),
        ("no_anganwadi", "No Anganwadi inside school premises", BAD, taught("class1", Answer("anganwadi_yn"))),
        ("no_balavatika", "No Balavatika", BAD, taught("class1", Answer("balavatika_located_yn"))),
        ("shift_school_flag", "Shift school", BAD, Answer("shift_school", (1,), (2,))),
        ("no_special_training", "No special training for out-of-school children", BAD, Answer("special_training")),
        ("no_supplementary_material", "No graded supplementary material", BAD, Answer("material_training")),
        ("instructional_days", "Average instructional days", UP_NUMBER, Value("avg_instr_days")),
    ),
    "infrastructure": (
        ("classrooms_per_100", "Classrooms per 100 students", UP_PER_100, Per((ROOMS,), PUPILS, 100)),
        ("students_per_classroom", "Students per instructional classroom", DOWN_PER_CLASSROOM, Per((PUPILS,), ROOMS)),
        ("good_classroom_share", "Share of classrooms in good condition", UP_SHARE, Per(("classrooms_in_good_condition",), ROOMS)),
        ("minor_repair_classroom_share", "Share of classrooms needing minor repair", DOWN_SHARE, Per(("classrooms_needs_minor_repair",), ROOMS)),
        ("major_repair_classroom_share", "Share of classrooms needing major repair", DOWN_SHARE, Per(("classrooms_needs_major_repair",), ROOMS)),
        ("any_major_repair", "At least one classroom needs major repair", BAD, Test("classrooms_needs_major_repair", ">", 0)),
        ("no_head_teacher_room", "No separate head-teacher room", BAD, Answer("separate_room_for_hm")),
        ("incomplete_furniture", "Furniture unavailable for all students", BAD, Answer("furniture_availability", (2, 3), (1,))),
        ("no_furniture", "No student furniture", BAD, Answer("furniture_availability", (3,), (1, 2))),
        ("pucca_block_share", "Share of building blocks that are pucca", UP_SHARE, Per(("pucca_building_blocks",), "no_building_blocks")),
    ),
    "wash": (
        ("no_functional_boys_toilet", "No functional boys' toilet", BAD, ZeroCount("total_boys_func_toilet")),
        ("no_functional_girls_toilet", "No functional girls' toilet", BAD, ZeroCount("total_girls_func_toilet")),
        ("functional_boys_toilet_rate", "Functional share of boys' toilet seats", UP_SHARE, Per(("total_boys_func_toilet",), "total_boys_toilet")),
        ("functional_girls_toilet_rate", "Functional share of girls' toilet seats", UP_SHARE, Per(("total_girls_func_toilet",), "total_girls_toilet")),
        ("boys_toilets_per_100_boys", "Functional boys' toilet seats per 100 boys", UP_PER_100, Per(("total_boys_func_toilet",), BOYS, 100)),
        ("girls_toilets_per_100_girls", "Functional girls' toilet seats per 100 girls", UP_PER_100, Per(("total_girls_func_toilet",), GIRLS, 100)),
        ("no_functional_cwsn_toilet", "No functional CWSN-friendly toilet", BAD, Absent(ACCESSIBLE_TOILETS)),
        ("no_handwash_near_toilet", "No handwashing with soap near toilets", BAD, Answer("handwash_near_toilet")),
        ("no_handwash_for_meals", "No handwashing with soap for meals", BAD, Answer("handwash_facility_for_meal")),
        ("no_functional_water_source", "No functional drinking-water source", BAD, NoneWorks(WORKING_WATER)),
        ("no_functional_tap_water", "No functional tap-water source", BAD, Answer("tap_fun_yn")),
        ("water_source_present_but_none_functional", "A water source is reported but none is functional", BAD, NoneWorks(WORKING_WATER, WATER)),
        ("functional_unprotected_well", "Functional unprotected well reported", BAD, Answer("well_unprot_fun_yn", (1,), (2,))),
        ("no_rainwater_harvesting", "No rainwater-harvesting provision", BAD, Answer("rain_water_harvesting")),
    ),
    "learning_environment": (
        ("no_functional_electricity", "No functional electricity connection", BAD, Answer("electricity_availability", (2, 3), (1,))),
        ("no_electricity_connection", "No electricity connection", BAD, Answer("electricity_availability", (2,), (1, 3))),
        ("electricity_connection_nonfunctional", "Electricity connection exists but is non-functional", BAD, Answer("electricity_availability", (3,), (1, 2))),
        ("no_solar_panel", "No solar panel", BAD, Answer("solar_panel")),
        ("no_library", "No library", BAD, Answer("library_availability")),
        ("no_book_bank", "No book bank", BAD, Answer("book_bank")),
        ("no_reading_corner", "No reading corner", BAD, Answer("reading_corner")),
        ("no_play_access", "No playground or alternative play arrangement", BAD, BothLack("playground_available", "playground_alt_yn")),
        ("no_medical_checkup", "No student medical check-up in the previous year", BAD, Answer("medical_checkups")),
    ),
    "digital": (
        ("no_internet", "No internet access", BAD, Answer("internet")),
        ("no_core_digital_device", "No laptop, tablet or desktop", BAD, Absent(DEVICES)),
        ("core_devices_per_100", "Laptops, tablets and desktops per 100 students", UP_PER_100, Per(DEVICES, PUPILS, 100)),
        ("no_digital_board", "No digital board", BAD, Absent(("digiboard",))),
        ("no_smart_classroom", "No smart classroom", BAD, Absent(("smart_class_tv_tot",))),
        ("no_projector", "No projector", BAD, Absent(("projector",))),
        ("no_printer", "No printer", BAD, Absent(("printer",))),
        ("no_server", "No server", BAD, Absent(("server_tot",))),
        ("no_dth", "No DTH or television-channel access", BAD, Answer("dth")),
    ),
    "teachers": (
        ("student_teacher_ratio", "Students per teacher", DOWN_PER_TEACHER, Per((PUPILS,), STAFF)),
        ("teachers_per_100", "Teachers per 100 students", UP_PER_100, Per((STAFF,), PUPILS, 100)),
        ("single_teacher_school", "Single-teacher school", BAD, Test(STAFF, "=", 1)),
        ("two_or_fewer_teachers", "School with two or fewer teachers", BAD, Test(STAFF, "<=", 2)),
        ("str_above_30", "Student-teacher ratio above 30", BAD, Crowded(PUPILS, STAFF, 30)),
        ("str_above_40", "Student-teacher ratio above 40", BAD, Crowded(PUPILS, STAFF, 40)),
        ("str_above_50", "Student-teacher ratio above 50", BAD, Crowded(PUPILS, STAFF, 50)),
        ("no_female_teacher", "No female teacher", BAD, AbsentAmong("female", STAFF)),
        ("female_teacher_share", "Female share of teachers", UP_SHARE, Per(("female",), STAFF)),
        ("no_regular_teacher", "No regular teacher", BAD, AbsentAmong("regular", STAFF)),
        ("contract_teacher_share", "Contract-teacher share", DOWN_SHARE, Per(("contract",), STAFF)),
        ("part_time_teacher_share", "Part-time-teacher share", DOWN_SHARE, Per(("part_time",), STAFF)),
        ("below_graduate_teacher_share", "Below-graduate teacher share", DOWN_SHARE, Per(("below_graduate",), STAFF)),
        ("postgraduate_teacher_share", "Postgraduate-and-above teacher share", UP_SHARE, Per(("post_graduate_and_above",), STAFF)),
        ("no_computer_trained_teacher", "No computer-trained teacher", BAD, AbsentAmong("trained_comp", STAFF)),
        ("computer_trained_teacher_share", "Computer-trained teacher share", UP_SHARE, Per(("trained_comp",), STAFF)),
        ("no_cwsn_trained_teacher", "No CWSN-trained teacher", BAD, AbsentAmong("trained_cwsn", STAFF)),
        ("cwsn_trained_teacher_share", "CWSN-trained teacher share", UP_SHARE, Per(("trained_cwsn",), STAFF)),
        ("no_special_educator", "No dedicated or cluster-level special educator", BAD, Answer("spl_educator_yn", (3,), (1, 2))),
        ("professionally_unqualified_teacher_share", "Teacher share with no professional qualification", DOWN_SHARE, Per(("none",), STAFF)),
        ("non_training_assignment_teacher_share", "Teacher share involved in non-training assignments", DOWN_SHARE, Per(("teacher_involve_non_training_assignment",), STAFF)),
        ("no_primary_teacher", "No teacher covering primary grades", BAD,
         taught("primary", Absent(("class_taught_pr", "class_taught_pr_upr", "class_taught_pr_and_pre_pri")))),
        ("no_upper_primary_teacher", "No teacher covering upper-primary grades", BAD,
         taught("upper", Absent(("class_taught_upr", "class_taught_pr_upr", "class_taught_upr_sec")))),
        ("no_secondary_teacher", "No teacher covering secondary grades", BAD,
         taught("secondary", Absent(("class_taught_sec_only", "class_taught_upr_sec", "class_taught_sec_hsec")))),
        ("no_higher_secondary_teacher", "No teacher covering higher-secondary grades", BAD,
         taught("higher", Absent(("class_taught_hsec_only", "class_taught_sec_hsec")))),
    ),
    "governance": (
        ("no_academic_inspection", "No academic inspection", BAD, Absent(("acad_inspections",))),
        ("no_crc_visit", "No CRC coordinator visit", BAD, Absent(("crc_coordinator",))),
        ("no_block_officer_visit", "No block-level officer visit", BAD, Absent(("block_level_officers",))),
        ("no_district_state_officer_visit", "No district or state officer visit", BAD, Absent(("district_officers",))),
        ("administrative_contacts", "Total inspections and administrative visits", UP_NUMBER, Total(VISITS)),
        ("no_smc", "No School Management Committee", BAD, Answer("smc_exists")),
        ("no_smc_meeting", "No SMC or SMDC meeting", BAD, Absent(("smc_smdc_meetings",))),
        ("grant_per_student", "Grant received per student", UP_RUPEES, Per(("grants_receipt",), PUPILS)),
        ("expenditure_per_student", "Grant expenditure per student", UP_RUPEES_RAW, Per(("grants_expenditure",), PUPILS)),
        ("grant_utilisation_rate", "Grant expenditure divided by grant receipt", UP_SHARE, Per(("grants_expenditure",), "grants_receipt")),
        ("no_grant_received", "No grant received", BAD, Absent(("grants_receipt",))),
        ("grant_received_no_expenditure", "Grant received but no expenditure reported", BAD, Unspent("grants_receipt", "grants_expenditure")),
    ),
    "welfare": (
        ("no_free_textbooks_primary", "No free textbooks in primary grades", BAD, taught("primary", Answer("free_text_books_pr"))),
        ("no_free_uniform_primary", "No free uniforms in primary grades", BAD, taught("primary", Answer("free_uniform_pr"))),
        ("no_free_textbooks_upper_primary", "No free textbooks in upper-primary grades", BAD, taught("upper", Answer("free_text_books_up"))),
        ("no_free_uniform_upper_primary", "No free uniforms in upper-primary grades", BAD, taught("upper", Answer("free_uniform_up"))),
    ),
    "inclusion": (
        ("no_ramp", "No ramp", BAD, Answer("availability_ramps")),
        ("ramp_without_handrail", "Ramp present without handrail", BAD, HasWithout("availability_ramps", "availability_of_handrails")),
        ("cwsn_no_ramp", "CWSN students enrolled but no ramp", BAD, with_cwsn(Answer("availability_ramps"))),
        ("cwsn_no_accessible_toilet", "CWSN students enrolled but no functional CWSN-friendly toilet", BAD, with_cwsn(Absent(ACCESSIBLE_TOILETS))),
        ("cwsn_no_special_educator", "CWSN students enrolled but no special educator", BAD, with_cwsn(Answer("spl_educator_yn", (3,), (1, 2)))),
        ("cwsn_no_trained_teacher", "CWSN students enrolled but no CWSN-trained teacher", BAD, with_cwsn(Absent(("trained_cwsn",)))),
    ),
    "vulnerability": (
        ("bpl_share", "BPL enrolment share in the school", DOWN_SHARE, Per(("bpl_students",), PUPILS)),
        ("ews_share", "EWS enrolment share in the school", DOWN_SHARE, Per(("ews_students",), PUPILS)),
        ("repeater_share", "Repeater enrolment share in the school", DOWN_SHARE, Per(("repeater_students",), PUPILS)),
        ("cwsn_share", "CWSN enrolment share in the school", DOWN_SHARE, Per(("cwsn_students",), PUPILS)),
    ),
    "age_grade": (
        ("over_age_share", "Over-age enrolment share", DOWN_SHARE, Per(("age_over",), "age_total")),
        ("under_age_share", "Under-age enrolment share", DOWN_SHARE, Per(("age_under",), "age_total")),
        ("on_age_share", "Enrolment within the configured age-grade band", UP_SHARE, Per(("age_on",), "age_total")),
    ),
}

GIRLS_WEIGHTED = (
    "no_functional_girls_toilet", "functional_girls_toilet_rate", "girls_toilets_per_100_girls",
    "no_female_teacher", "female_teacher_share", "gendered_school_disadvantage_index",
)

MEMBERS = {
    "access": "ends_before_class10 ends_before_class12 no_all_weather_road no_pre_primary no_anganwadi no_balavatika",
    "infrastructure": "any_major_repair no_head_teacher_room incomplete_furniture no_functional_electricity no_library no_play_access",
    "wash": "no_functional_boys_toilet no_functional_girls_toilet no_functional_water_source no_handwash_near_toilet no_handwash_for_meals",
    "digital": """no_internet no_core_digital_device no_digital_board no_smart_classroom no_projector
        no_computer_trained_teacher no_functional_electricity""",
    "teachers": """two_or_fewer_teachers str_above_30 no_female_teacher no_regular_teacher no_computer_trained_teacher
        no_cwsn_trained_teacher no_primary_teacher no_upper_primary_teacher no_secondary_teacher no_higher_secondary_teacher""",
    "governance": """no_academic_inspection no_crc_visit no_block_officer_visit no_district_state_officer_visit no_smc
        no_smc_meeting no_grant_received""",
    "welfare": """no_free_textbooks_primary no_free_uniform_primary no_free_textbooks_upper_primary
        no_free_uniform_upper_primary no_special_training no_supplementary_material""",
    "inclusion": "cwsn_no_ramp cwsn_no_accessible_toilet cwsn_no_special_educator cwsn_no_trained_teacher",
    "gender": "no_functional_girls_toilet no_female_teacher ends_before_class12 no_functional_water_source",
}
A, I, W, D, T, G, S = (f"{n}_index" for n in (
    "access_deprivation", "infrastructure_deprivation", "wash_deprivation", "digital_deprivation",
    "teacher_capacity_deprivation", "governance_response_deficit", "welfare_support_deficit",
))
NEED, OVERALL, CONTEXT = "institutional_need_index", "overall_multidimensional_deprivation_index", "vulnerability_context_index"

# source share -> within-region percentile column
PERCENTILES = {f"{n}_share": f"{n}_percentile" for n in ("bpl", "ews", "repeater", "cwsn")}


def _mean100(name: str) -> Mean:
    return Mean(tuple(MEMBERS[name].split()), 100)


# Indices by the stage that can compute them: each stage reads only earlier columns.
TERTIARY = (
    (
        (A, "access", "Access deprivation index", _mean100("access")),
        (I, "infrastructure", "Infrastructure deprivation index", _mean100("infrastructure")),
        (W, "wash", "Water, sanitation and hygiene deprivation index", _mean100("wash")),
        (D, "digital", "Digital deprivation index", _mean100("digital")),
        (T, "teachers", "Teacher-capacity deprivation index", _mean100("teachers")),
        (G, "governance", "Governance and response deficit index", _mean100("governance")),
        (S, "welfare", "Welfare-support deficit index", _mean100("welfare")),
        ("inclusion_failure_index", "inclusion", "CWSN inclusion-failure index", _mean100("inclusion")),
        ("gendered_school_disadvantage_index", "gender", "Gendered school-environment disadvantage index", _mean100("gender")),
    ),
    (
        ("educational_resource_deficit_index", "resources", "Educational-resource deficit index", Mean((I, D, T))),
        (NEED, "need", "Documented institutional need index", Mean((A, I, W, T))),
        (OVERALL, "overall", "Overall multidimensional school deprivation index", Mean((A, I, W, D, T, G, S))),
    ),
    (
        ("institutional_neglect_index", "neglect", "Institutional neglect interaction index", Product(NEED, G)),
        (CONTEXT, "vulnerability", "Within-state vulnerability-context percentile index", Mean(tuple(PERCENTILES.values()), 100)),
    ),
    (
        ("compound_vulnerability_deprivation_index", "compound", "Compound vulnerability and school-deprivation interaction", Product(CONTEXT, OVERALL)),
    ),
)
TERTIARY_ORDER = (
    A, I, W, D, T, G, S, "inclusion_failure_index", "gendered_school_disadvantage_index", "educational_resource_deficit_index",
    NEED, "institutional_neglect_index", OVERALL, CONTEXT, "compound_vulnerability_deprivation_index",
)

NOTES = {
    "shift_school_flag": "Shift operation is a sign of pressure and not by itself of poor quality.",
    "functional_unprotected_well": "Shows an unprotected source, not that it is the only one.",
    "grant_utilisation_rate": "May exceed one where balances of other years are spent.",
    "institutional_neglect_index": "An analytical interaction; no evidence of intent.",
    CONTEXT: "The categories overlap and are not crossed with group membership.",
    **{c: "A marginal share of the school, not of a group in it." for c in PERCENTILES},
    **{c: "Age is not crossed with group membership." for c in ("over_age_share", "under_age_share", "on_age_share")},
}
MEANINGS = {
    A: "Equal-weight mean of the access conditions observed.",
    "gendered_school_disadvantage_index": "School environment, weighted by girls.",
    "institutional_neglect_index": "High only where need and weak response meet.",
    OVERALL: "Equal-weight summary; the parts come first.",
    CONTEXT: "Mean within-state percentile rank of four shares.",
    "compound_vulnerability_deprivation_index": "High only where a vulnerable intake and deprivation meet.",
}


_HOME = {c: t for t, cols in COLUMNS.items() for c in cols if c != KEY and not t.startswith("enrolment")}
_DERIVED = {PUPILS: "enrolment total", BOYS: "enrolment total of boys", GIRLS: "enrolment total of girls"}


def _source(column: str) -> str:
    if column in _HOME:
        return f"{_HOME[column]}.{column}"
    if column.startswith("age_"):
        return "enrolment_2 age-by-class records"
    return _DERIVED.get(column, f"enrolment_1 {column.removesuffix('_students')} item" if column.endswith("_students") else column)


def _applies(rule: object) -> str:
    if isinstance(rule, Where):
        if rule.bounds[0][0] == "cwsn_students":
            return WITH_CWSN
        return next(text for limits, text in TAUGHT.values() if limits == (rule.bounds[0][2], rule.bounds[1][2]))
    return "schools reporting a ramp" if isinstance(rule, HasWithout) else "all schools with reported enrolment"


def _entry(code: str, label: str, measure: Measure, rule: object, domain: str, level: str) -> Indicator:
    about = About(
        WITH_CWSN if code == "inclusion_failure_index" else _applies(rule),
        tuple(dict.fromkeys(_source(c) for c in rule.columns())), MEANINGS.get(code, ""), NOTES.get(code, ""),
    )
    return Indicator(code, label, measure, domain, level, "girls" if code in GIRLS_WEIGHTED else "students", about)


RULES: dict[str, object] = {}
_found: dict[str, Indicator] = {}
for _domain, _rows in SECONDARY.items():
    for _code, _label, _measure, _rule in _rows:
        RULES[_code] = _rule
        _found[_code] = _entry(_code, _label, _measure, RULES[_code], _domain, "secondary")
SECONDARY_INDICATORS = tuple(_found.values())
for _stage in TERTIARY:
    for _code, _domain, _label, _rule in _stage:
        RULES[_code] = _rule
        _found[_code] = _entry(_code, _label, DOWN_INDEX, _rule, f"tertiary_{_domain}", "tertiary")
TERTIARY_INDICATORS = tuple(_found[c] for c in TERTIARY_ORDER)
ALL_INDICATORS = SECONDARY_INDICATORS + TERTIARY_INDICATORS
BY_CODE = {i.code: i for i in ALL_INDICATORS}
check_registry(ALL_INDICATORS)


def pick(codes) -> tuple[Indicator, ...]:
    return tuple(BY_CODE[c] for c in codes)


# The selected-state analysis files the same indicators under its own domains.
SELECTED_DOMAINS = {
    "ends_before_class10": "Access", "ends_before_class12": "Access", "str_above_30": "Crowding",
    "student_teacher_ratio": "Crowding", "students_per_classroom": "Crowding", "no_library": "Learning resources",
    "no_reading_corner": "Learning resources", "no_internet": "Digital resources",
    "no_core_digital_device": "Digital resources", "no_primary_teacher": "Teacher capacity",
    "no_female_teacher": "Teacher capacity", "over_age_share": "Age-grade distortion",
    "institutional_neglect_index": "Structural disadvantage", OVERALL: "Structural disadvantage",
}
SELECTED = tuple(replace(BY_CODE[c], domain=d) for c, d in SELECTED_DOMAINS.items())
