"""Table schemas, date parsing with precision, the NaN guard and the forbidden-column guard."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAYS_PER_YEAR = 365.25

#: Column types of the cohort tables (fixed values: names and types of the data model).
TABLES: dict[str, str] = {
    "patients": "patient_id string, route string, design_class string, canonical_model string, generation string, tissue_treatment string, size_mm int, implant_date date, implant_year int, age_at_implant double, sex string, bsa double, bmi double, diabetes boolean, egfr0 double, dialysis boolean, af boolean, bicuspid boolean, lipid_lowering boolean",
    "echoes": "patient_id string, date date, mean_gradient double, eoa double, dvi double, ar_grade string, lvef double, svi double, is_reference boolean, ar_location string",
    "labs": "patient_id string, date date, analyte string, value double",
    "exposures": "patient_id string, class string, agent string, indication string, start_date date, stop_date date, source string, post_suspicion boolean",
    "events": "patient_id string, implant_date date, reference_date date, svd_candidate_date date, svd_adjudicated_date date, svd_status string, svd_first_unresolved_date date, svd_first_positive_date date, death_date date, replacement_date date, end_followup_date date, end_reason string, first_thrombosis_date date",
}

#: Never a predictor: identifiers, outcomes, endpoint and confirmation information (fixed values).
FORBIDDEN_FEATURES = frozenset(
    """
    time event time_thromb event_thromb patient_id landmark_date bootstrap_cluster_id row_weight_patient_balanced
    ac_records_available implant_date reference_date svd_candidate_date svd_confirmation_date svd_adjudicated_date svd_status
    svd_mechanism svd_confidence svd_adjudicated_phenotype svd_uncertain_dates svd_thrombosis_attributed_dates
    svd_first_unresolved_date svd_first_positive_date adjudication_policy_version death_date replacement_date
    end_followup_date end_reason first_thrombosis_date
    """.split()
)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column, so that no comparison takes it for a large number."""
    return df.select(*(F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes))


def parse_date(text: Column) -> Column:
    """``YYYY-MM-DD`` or ``YYYY`` (1 January) as a date; NULL stays NULL; anything else raises when it is evaluated."""
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.to_date(text)).when(text.rlike(r"^\d{4}$"), F.make_date(text.try_cast("int"), F.lit(1), F.lit(1)))
    return F.when(text.isNull() | day.isNotNull(), day).otherwise(F.raise_error(F.concat(F.lit("not a date: "), text)).cast("date"))


def date_precision(text: Column) -> Column:
    return F.when(text.isNull(), "none").when(F.length(text) == 4, "year").otherwise("day")


def check_no_truth(tables: dict[str, DataFrame], truth_columns: Iterable[str]) -> None:
    """Predictor-visible tables must not hold evaluation-only columns."""
    for name, df in tables.items():
        if found := sorted(set(df.columns) & set(truth_columns)):
            raise ValueError(f"{name} holds evaluation-only columns: {found}")


def check_features(features: Iterable[str], forbidden: Iterable[str] = FORBIDDEN_FEATURES) -> None:
    if found := sorted(set(features) & set(forbidden)):
        raise ValueError(f"forbidden as features: {found}")


def years_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier) / F.lit(DAYS_PER_YEAR)
