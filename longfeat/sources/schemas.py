"""Declared table schemas (nothing is inferred from the files)."""

from __future__ import annotations

from pyspark.sql import types as T


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


# Person-level tables; the file name of each is the caller's choice (see ``load_tables``).
PERSON_TABLES = {
    "person": "person_id bigint, year_of_birth int, month_of_birth int, day_of_birth int",
    "encounter": (
        "person_id bigint, visit_start_date date, macrovisit_start_date date, macrovisit_end_date date"
    ),
    "condition": "person_id bigint, condition_start_date date, condition_concept_id bigint",
    "observation": "person_id bigint, observation_date date, observation_concept_id bigint",
    "procedure": "person_id bigint, procedure_date date, procedure_concept_id bigint",
    "drug": (
        "person_id bigint, drug_exposure_start_date date, drug_concept_id bigint, drug_type_concept_id bigint"
    ),
    "device": "person_id bigint, device_exposure_start_date date, device_concept_id bigint",
    "measurement": (
        "person_id bigint, measurement_date date, measurement_concept_id bigint, value_as_number double, "
        "value_as_concept_id bigint"
    ),
    "label": "person_id bigint, pasc_code_after_four_weeks int, pasc_code_prior_four_weeks int",
    "note": "person_id bigint, note_id bigint, note_date date, visit_occurrence_id bigint",
    "mention": (
        "note_nlp_id bigint, note_id bigint, term_modifier_certainty string, note_nlp_concept_id bigint, "
        "note_nlp_concept_name string"
    ),
}

# Further tables of the published layout; no operator reads them.
OTHER_TABLES = {
    "visit": "person_id bigint, visit_occurrence_id bigint, visit_start_date date, visit_end_date date",
    "death": "person_id bigint, death_date date",
    "observation_period": "person_id bigint, observation_period_start_date date, observation_period_end_date date",
    "concept": "concept_id bigint, concept_name string, domain_id string, vocabulary_id string",
}

# The file of each table in the published layout, without ``.csv``.
PERSON_FILES = {
    "condition": "condition_occurrence",
    "death": "death",
    "drug": "drug_exposure",
    "label": "long_covid_silver_standard",
    "measurement": "measurement",
    "encounter": "microvisits_to_macrovisits",
    "observation_period": "observation_period",
    "observation": "observation",
    "person": "person",
    "procedure": "procedure_occurrence",
    "visit": "visit_occurrence",
}
VOCABULARY_FILES = {
    "concept": "concept",
    "members": "concept_set_members",
    "registry": "LL_concept_sets_fusion_everyone",
    "required_registry": "LL_DO_NOT_DELETE_REQUIRED_concept_sets_all",
}
# The folders of its three table sets.
FOLDERS = {"train": "training", "test": "testing", "vocabulary": "."}

VOCABULARY_TABLES = {
    "members": (
        "codeset_id bigint, concept_id bigint, concept_set_name string, is_most_recent_version string, version int, "
        "concept_name string, archived string"
    ),
    "registry": "concept_set_name string, indicator_prefix string, domain string",
    "required_registry": "concept_set_name string, indicator_prefix string, domain string",
    "broad_sets": "codeset_id bigint, concept_set_name string",
}

# Source column -> operator column, per table.
OPERATOR_COLUMNS = {
    "encounter": {
        "visit_start_date": "day",
        "macrovisit_start_date": "start_day",
        "macrovisit_end_date": "end_day",
    },
    "condition": {"condition_start_date": "day", "condition_concept_id": "concept_id"},
    "observation": {"observation_date": "day", "observation_concept_id": "concept_id"},
    "procedure": {"procedure_date": "day", "procedure_concept_id": "concept_id"},
    "drug": {
        "drug_exposure_start_date": "day",
        "drug_concept_id": "concept_id",
        "drug_type_concept_id": "type_id",
    },
    "device": {"device_exposure_start_date": "day", "device_concept_id": "concept_id"},
    "measurement": {
        "measurement_date": "day",
        "measurement_concept_id": "concept_id",
        "value_as_number": "value",
        "value_as_concept_id": "result_concept_id",
    },
    "label": {"pasc_code_after_four_weeks": "after", "pasc_code_prior_four_weeks": "prior"},
    "note": {"note_date": "day", "visit_occurrence_id": "visit_id"},
    "mention": {
        "note_nlp_id": "mention_id",
        "term_modifier_certainty": "certainty",
        "note_nlp_concept_id": "concept_id",
        "note_nlp_concept_name": "mention_name",
    },
    "members": {"concept_set_name": "set_name", "is_most_recent_version": "is_current"},
    "registry": {"concept_set_name": "set_name", "indicator_prefix": "indicator"},
    "required_registry": {"concept_set_name": "set_name", "indicator_prefix": "indicator"},
    "broad_sets": {"concept_set_name": "set_name"},
}
