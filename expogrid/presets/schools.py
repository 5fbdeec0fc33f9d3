"""The school survey as one preset: its tables, groups, stages, scopes and output lists.

Everything here is a fixed value of the survey or of its published analysis plan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.model import Bundle, Group, GroupScheme
from ..operators.bundles import lattice
from ..sources.schema import TableSchema, type_map

KEY = "pseudocode"


def _long_columns() -> list[str]:
    """Key, item, then boys and girls of the pre-primary year and classes 1 to 12."""
    years = ["pp", *range(1, 13)]
    return [KEY, "item_group", "item_id", *[f"c{y}_{sex}" for y in years for sex in "bg"]]


# Column names of the six source tables, in file order.
COLUMNS = {
    "profile_1": """
        pseudocode state district block rural_urban lgd_urban_local_body_name lgd_ward_name lgd_vill_name
        lgd_vill_panchayat_name lgd_block_name school_category school_type lowclass highclass managment pincode
        special_school_for_cwsn shift_school resi_school resi_type minority_school medium_instr1
        medium_of_instr2 medium_of_instr3 medium_of_instr4 aff_board_sec aff_board_hsec approachable_road
        pre_primary anganwadi_yn avg_instr_days cce_yn same_sch_b same_sch_g other_sch_b other_sch_g
        anganwadi_ecce_b anganwadi_ecce_g
    """.split(),
    "profile_2": """
        pseudocode balavatika_located_yn special_training material_training free_text_books_pr free_uniform_pr
        free_text_books_up free_uniform_up acad_inspections crc_coordinator block_level_officers
        district_officers smc_exists smc_smdc_same smc_smdc_meetings grants_receipt grants_expenditure
    """.split(),
    "facility": """
        pseudocode building_status no_building_blocks pucca_building_blocks boundary_wall total_class_rooms
        other_rooms classrooms_in_good_condition classrooms_needs_minor_repair classrooms_needs_major_repair
        separate_room_for_hm total_boys_toilet total_boys_func_toilet total_girls_toilet total_girls_func_toilet
        total_boys_cwsn_toilet func_boys_cwsn_friendly total_girls_cwsn_toilet func_girls_cwsn_friendly
        urinal_boys urinal_girls handwash_near_toilet hand_pump_yn well_prot_yn tap_yn othsrc_yn well_unprot_yn
        pack_water_yn hand_pump_fun_yn well_prot_fun_yn tap_fun_yn othsrc_fun_yn well_unprot_fun_yn
        pack_water_fun_yn rain_water_harvesting handwash_facility_for_meal electricity_availability solar_panel
        library_availability book_bank reading_corner playground_available playground_alt_yn medical_checkups
        availability_ramps availability_of_handrails furniture_availability phy_lab_cond chem_lab_cond
        bio_lab_cond math_lab_cond lang_lab_cond geo_lab_cond home_sc_lab_cond psycho_lab_cond comp_lab_cond
        comp_ict_lab_yn ict_lab_yn laptop tablet desktop digiboard teachdev_tot server_tot smart_class_tv_tot
        projector printer internet dth spl_educator_yn
    """.split(),
    "enrolment_1": _long_columns(),
    "enrolment_2": _long_columns(),
    "teacher": """
        pseudocode total_tch male female transgender gen_tch sc_tch st_tch obc_tch regular contract part_time
        below_graduate graduate post_graduate_and_above trained_comp class_taught_pr class_taught_upr
        class_taught_pr_upr class_taught_sec_only class_taught_hsec_only class_taught_upr_sec
        class_taught_sec_hsec class_taugt_pre_primary_only class_taught_pr_and_pre_pri
        teacher_involve_non_training_assignment diploma_certificate bachelor_of_ee bed_equivalent med_equivalent
        other none diploma_special_edu pursuing_rpc diploma_ele_edu early_childhood_tch bed_nursery trained_cwsn
    """.split(),
}

# Columns that must be present, and the columns that are not whole numbers.
REQUIRED = {
    "profile_1": (
        "pseudocode", "state", "district", "block", "rural_urban", "school_category", "school_type", "lowclass",
        "highclass", "managment", "minority_school",
    ),
    "profile_2": (
        "pseudocode", "acad_inspections", "smc_exists", "grants_receipt", "grants_expenditure",
    ),
    "facility": (
        "pseudocode", "total_class_rooms", "total_boys_toilet", "total_boys_func_toilet", "total_girls_toilet",
        "total_girls_func_toilet", "electricity_availability", "library_availability", "internet",
    ),
    "enrolment_1": (
        "pseudocode", "item_group", "item_id", "cpp_b", "cpp_g", "c1_b", "c1_g", "c12_b", "c12_g",
    ),
    "enrolment_2": (
        "pseudocode", "item_group", "item_id", "cpp_b", "cpp_g", "c1_b", "c1_g", "c12_b", "c12_g",
    ),
    "teacher": (
        "pseudocode", "total_tch", "male", "female", "gen_tch", "sc_tch", "st_tch", "obc_tch",
    ),
}
TYPES = {
    "profile_1": {"string": (
        "state", "district", "block", "lgd_urban_local_body_name", "lgd_ward_name", "lgd_vill_name",
        "lgd_vill_panchayat_name", "lgd_block_name",
    )},
    "profile_2": {"double": ("grants_receipt", "grants_expenditure")},
}

SCHEMAS: dict[str, TableSchema] = type_map(COLUMNS, TYPES, REQUIRED)

# Archive names.
PATTERNS = {
    "profile_1": "profile_data_1_*2024-25*",
    "profile_2": "profile_data_2_*2024-25*",
    "facility": "facility_data_*2024-25*",
    "enrolment_1": "enrolment_data_1_*2024-25*",
    "enrolment_2": "enrolment_data_2_*2024-25*",
    "teacher": "teacher_data_*2024-25*",
}

# Groups with their (item_group, item_id) in the first enrolment table.
SCHEME = GroupScheme((
    Group("A0", "Muslim", (2, 5)),
    Group("B0", "General baseline", (1, 1)),
    Group("C0", "Scheduled Caste baseline", (1, 2)),
    Group("D0", "Scheduled Tribe baseline", (1, 3)),
    Group("E0", "Other Backward Class baseline", (1, 4)),
))
OTHER_ITEMS = {
    "christian": (2, 6), "sikh": (2, 7), "buddhist": (2, 8), "parsi": (2, 9), "jain": (2, 10),
    "bpl": (3, 13), "ews": (10, 32), "repeater": (5, 0), "cwsn": (4, None),
}
RESIDUAL_ITEMS = ("christian", "sikh", "buddhist", "parsi", "jain")
AGE_ITEM_GROUP = 8
NOMINAL_AGE_OFFSET = 5

# Stage suffix, label and classes.
STAGES = (
    ("primary", "Primary", (1, 2, 3, 4, 5)),
    ("upper_primary", "Upper primary", (6, 7, 8)),
    ("secondary", "Secondary", (9, 10)),
    ("higher_secondary", "Higher secondary", (11, 12)),
)
STAGE_LABELS = tuple((suffix, label) for suffix, label, _ in STAGES)

# Management codes of each scope.
SCOPE_CODES = {
    "all_recognised": None,
    "state_local_government": (1, 2, 3, 6, 89, 90),
    "government_aided": (4, 7, 99),
    "private_unaided": (5, 97),
}


def scopes(*names: str) -> dict[str, Column]:
    """Membership tests of the named scopes, all of them by default."""
    chosen = names or tuple(SCOPE_CODES)
    return {
        n: F.lit(True) if SCOPE_CODES[n] is None else F.col("managment").isin(list(SCOPE_CODES[n])) for n in chosen
    }


GRADIENT_SCOPES = ("all_recognised", "state_local_government")
SELECTED_STATES = ("BIHAR", "UTTAR PRADESH", "JHARKHAND", "UTTARAKHAND", "ASSAM")

# Columns of the numeric summary, per table.
SUMMARY_COLUMNS = {
    "profile_1": "lowclass highclass avg_instr_days same_sch_b same_sch_g other_sch_b other_sch_g anganwadi_ecce_b anganwadi_ecce_g".split(),
    "profile_2": "acad_inspections crc_coordinator block_level_officers district_officers smc_smdc_meetings grants_receipt grants_expenditure".split(),
    "facility": """
        no_building_blocks pucca_building_blocks total_class_rooms other_rooms classrooms_in_good_condition
        classrooms_needs_minor_repair classrooms_needs_major_repair total_boys_toilet total_boys_func_toilet
        total_girls_toilet total_girls_func_toilet total_boys_cwsn_toilet func_boys_cwsn_friendly
        total_girls_cwsn_toilet func_girls_cwsn_friendly urinal_boys urinal_girls laptop tablet desktop
        digiboard teachdev_tot server_tot smart_class_tv_tot projector printer
    """.split(),
    "teacher": """
        total_tch male female transgender gen_tch sc_tch st_tch obc_tch regular contract part_time
        below_graduate graduate post_graduate_and_above trained_comp trained_cwsn
        teacher_involve_non_training_assignment
    """.split(),
}

# Coded columns without a code book, with their description.
CODED_COLUMNS = {
    "profile_1.rural_urban": "School-location code",
    "profile_1.school_category": "School-category code",
    "profile_1.school_type": "School-type code",
    "profile_1.managment": "Management code",
    "profile_1.resi_type": "Residential-school type",
    "profile_1.medium_instr1": "Medium of instruction 1",
    "profile_1.medium_of_instr2": "Medium of instruction 2",
    "profile_1.medium_of_instr3": "Medium of instruction 3",
    "profile_1.medium_of_instr4": "Medium of instruction 4",
    "profile_1.aff_board_sec": "Secondary affiliation board",
    "profile_1.aff_board_hsec": "Higher-secondary affiliation board",
    "facility.building_status": "Building-status code",
    "facility.boundary_wall": "Boundary-wall code",
    "facility.phy_lab_cond": "Physics-laboratory condition",
    "facility.chem_lab_cond": "Chemistry-laboratory condition",
    "facility.bio_lab_cond": "Biology-laboratory condition",
    "facility.math_lab_cond": "Mathematics-laboratory condition",
    "facility.lang_lab_cond": "Language-laboratory condition",
    "facility.geo_lab_cond": "Geography-laboratory condition",
    "facility.home_sc_lab_cond": "Home-science laboratory condition",
    "facility.psycho_lab_cond": "Psychology-laboratory condition",
    "facility.comp_lab_cond": "Computer-science laboratory condition",
    "facility.comp_ict_lab_yn": "Computer or ICT laboratory code",
    "facility.ict_lab_yn": "ICT-laboratory code",
}

STAFF_COLUMNS = {"B0": "gen_tch", "C0": "sc_tch", "D0": "st_tch", "E0": "obc_tch"}

# Conditions of the combination lattice (code, label, domain, weight).
CONDITIONS = (
    ("ends_before_class12", "School ends before Class 12", "Access", "students"),
    ("str_above_30", "Student-teacher ratio above 30", "Crowding", "students"),
    ("no_library", "No library", "Learning resources", "students"),
    ("no_reading_corner", "No reading corner", "Learning resources", "students"),
    ("no_internet", "No internet access", "Digital resources", "students"),
    ("no_core_digital_device", "No laptop, tablet or desktop", "Digital resources", "students"),
    ("no_primary_teacher", "No primary-grade teacher", "Teacher capacity", "students"),
    ("no_female_teacher", "No female teacher", "Gendered teacher capacity", "girls"),
    ("no_functional_girls_toilet", "No functional girls' toilet", "Gendered WASH", "girls"),
    ("no_functional_electricity", "No functional electricity", "Basic infrastructure", "students"),
    ("no_functional_water_source", "No functional drinking-water source", "Basic infrastructure", "students"),
    ("any_major_repair", "At least one classroom needs major repair", "Building condition", "students"),
)
PREDEFINED = (
    ("access_crowding_learning", ("ends_before_class12", "str_above_30", "no_library")),
    ("access_crowding_digital", ("ends_before_class12", "str_above_30", "no_internet")),
    ("access_crowding_device", ("ends_before_class12", "str_above_30", "no_core_digital_device")),
    ("access_learning_digital", ("ends_before_class12", "no_library", "no_internet")),
    ("complete_learning_digital_exclusion", ("no_library", "no_reading_corner", "no_internet", "no_core_digital_device")),
    ("gendered_access_capacity", ("ends_before_class12", "str_above_30", "no_female_teacher")),
    ("gendered_resource_exclusion", ("no_female_teacher", "no_functional_girls_toilet", "no_library", "no_internet")),
    ("basic_infrastructure_failure", ("no_functional_electricity", "no_functional_water_source", "any_major_repair")),
    ("total_institutional_exclusion", ("ends_before_class12", "str_above_30", "no_library", "no_internet", "no_female_teacher")),
)
COMBINATIONS = lattice(CONDITIONS, (2, 3), PREDEFINED)

# Code, members and mechanism of the accountability bundles.
_BASE = """
major_repair: any_major_repair: capital deterioration
incomplete_furniture: incomplete_furniture: capital under-provision
girls_toilet_failure: no_functional_girls_toilet: WASH under-provision
water_failure: no_functional_water_source: WASH under-provision
water_maintenance_failure: water_source_present_but_none_functional: maintenance failure
electricity_failure: no_functional_electricity: power under-provision
electricity_maintenance_failure: electricity_connection_nonfunctional: maintenance failure
digital_void: no_internet no_core_digital_device: digital underinvestment
learning_resource_void: no_library no_reading_corner no_core_digital_device: learning-resource underinvestment
wash_collapse: no_functional_girls_toilet no_functional_water_source no_handwash_near_toilet: WASH system failure
basic_services_collapse: no_functional_water_source no_functional_electricity no_functional_girls_toilet: basic-services collapse
digital_exclusion_from_power: no_functional_electricity no_internet no_core_digital_device: infrastructure-rooted digital exclusion
physical_learning_neglect: any_major_repair incomplete_furniture no_library: physical and learning-resource neglect
deferred_maintenance: any_major_repair water_source_present_but_none_functional electricity_connection_nonfunctional: deferred maintenance
repair_no_grant: any_major_repair no_grant_received: need without finance
repair_no_inspection: any_major_repair no_academic_inspection: need without oversight
repair_no_district_visit: any_major_repair no_district_state_officer_visit: need without senior oversight
repair_no_response: any_major_repair no_grant_received no_district_state_officer_visit: physical need without response
wash_no_grant: no_functional_girls_toilet no_grant_received: WASH need without finance
wash_no_response: no_functional_girls_toilet no_functional_water_source no_block_officer_visit no_district_state_officer_visit: WASH need without oversight
digital_no_grant: no_internet no_core_digital_device no_grant_received: digital need without finance
digital_no_response: no_functional_electricity no_internet no_core_digital_device no_grant_received: digital system failure without response
learning_no_response: no_library no_reading_corner no_academic_inspection: learning-resource need without oversight
physical_decay_no_response: any_major_repair incomplete_furniture no_grant_received no_academic_inspection: physical decay without response
state_investment_failure: any_major_repair no_functional_water_source no_functional_electricity no_library no_internet: compound public-investment failure
state_maintenance_oversight_failure: any_major_repair water_source_present_but_none_functional electricity_connection_nonfunctional no_grant_received no_district_state_officer_visit: maintenance and oversight failure
"""
_MORE = """
repair_no_internet: any_major_repair no_internet: physical deterioration plus digital exclusion
repair_no_core_device: any_major_repair no_core_digital_device: physical deterioration plus digital exclusion
repair_digital_void: any_major_repair no_internet no_core_digital_device: physical deterioration plus digital exclusion
furniture_digital_void: incomplete_furniture no_internet no_core_digital_device: capital under-provision plus digital exclusion
repair_library_digital_void: any_major_repair no_library no_internet no_core_digital_device: physical and learning-technology underinvestment
repair_power_digital_void: any_major_repair no_functional_electricity no_internet no_core_digital_device: infrastructure-rooted digital exclusion
repair_digital_no_grant: any_major_repair no_internet no_core_digital_device no_grant_received: physical and digital need without finance
repair_digital_no_inspection: any_major_repair no_internet no_core_digital_device no_academic_inspection: physical and digital need without oversight
repair_girls_toilet: any_major_repair no_functional_girls_toilet: physical deterioration plus WASH under-provision
repair_water: any_major_repair no_functional_water_source: physical deterioration plus WASH under-provision
repair_handwash: any_major_repair no_handwash_near_toilet: physical deterioration plus hygiene under-provision
repair_wash_failure: any_major_repair no_functional_girls_toilet no_functional_water_source: physical deterioration plus WASH system failure
furniture_wash_failure: incomplete_furniture no_functional_girls_toilet no_functional_water_source: capital under-provision plus WASH system failure
repair_wash_no_response: any_major_repair no_functional_girls_toilet no_grant_received no_district_state_officer_visit: physical and WASH need without response
"""


def _bundles(text: str) -> tuple[Bundle, ...]:
    """A bundle with the girls' toilet among its members is weighted by girls."""
    out = []
    for line in text.strip().splitlines():
        code, members, mechanism = (part.strip() for part in line.split(":"))
        names = tuple(members.split())
        weight = "girls" if "no_functional_girls_toilet" in names else "students"
        out.append(Bundle(code, " + ".join(n.replace("_", " ") for n in names), names, weight, mechanism=mechanism))
    return tuple(out)


BASE_BUNDLES = _bundles(_BASE)
EXTENDED_BUNDLES = BASE_BUNDLES + _bundles(_MORE)

# Outcome lists of the analyses.
KEY_OUTCOMES = """
    ends_before_class10 ends_before_class12 no_functional_girls_toilet no_functional_water_source
    no_functional_electricity no_library no_internet student_teacher_ratio str_above_30 no_female_teacher
    grant_per_student over_age_share access_deprivation_index infrastructure_deprivation_index
    wash_deprivation_index digital_deprivation_index teacher_capacity_deprivation_index
    governance_response_deficit_index gendered_school_disadvantage_index educational_resource_deficit_index
    institutional_neglect_index overall_multidimensional_deprivation_index compound_vulnerability_deprivation_index
""".split()
PRINCIPAL_OUTCOMES = """
    ends_before_class10 ends_before_class12 no_functional_water_source no_functional_electricity no_internet
    str_above_30 no_female_teacher grant_per_student access_deprivation_index teacher_capacity_deprivation_index
    institutional_neglect_index overall_multidimensional_deprivation_index
""".split()
INTERACTION_OUTCOMES = """
    access_deprivation_index teacher_capacity_deprivation_index institutional_neglect_index
    overall_multidimensional_deprivation_index
""".split()
PAIR_OUTCOMES = """
    access_deprivation_index teacher_capacity_deprivation_index overall_multidimensional_deprivation_index
""".split()
REGION_SLOPE_OUTCOMES = """
    ends_before_class12 str_above_30 no_internet teacher_capacity_deprivation_index institutional_neglect_index
    overall_multidimensional_deprivation_index
""".split()
SEX_OUTCOMES = """
    ends_before_class10 ends_before_class12 no_functional_girls_toilet girls_toilets_per_100_girls no_female_teacher
    female_teacher_share no_functional_water_source gendered_school_disadvantage_index
""".split()
STATE_PROFILE = """
    ends_before_class10 ends_before_class12 student_teacher_ratio str_above_30 no_female_teacher
    no_functional_girls_toilet no_functional_water_source no_functional_electricity no_library no_internet
    grant_per_student overall_multidimensional_deprivation_index institutional_neglect_index
""".split()
DISTRICT_PROFILE = [c for c in STATE_PROFILE if c != "student_teacher_ratio"]
GRID_SECONDARY = """
    ends_before_class10 ends_before_class12 student_teacher_ratio no_internet no_functional_girls_toilet grant_per_student
""".split()
SELECTED_STATE_INDICATORS = """
    ends_before_class10 ends_before_class12 str_above_30 student_teacher_ratio students_per_classroom no_library
    no_reading_corner no_internet no_core_digital_device no_primary_teacher no_female_teacher over_age_share
    institutional_neglect_index overall_multidimensional_deprivation_index
""".split()

ID_COLUMNS = """
    pseudocode state district block rural_urban school_category school_type managment lowclass highclass
    minority_school shift_school resi_school
""".split()
