"""The landmark (prediction-time) table: one row per patient and study date, features from that date or before, the first
outcome after it, and the reason for every patient that gives no row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions import rules
from timberline.operators import adjudicate as adj
from timberline.operators import asof
from timberline.schema import DAYS_PER_YEAR, FORBIDDEN_FEATURES, years_between

#: In the order in which they apply; one reason per patient (fixed values).
EXCLUSION_REASONS = (
    "no_events_row",
    "no_echo",
    "no_reference",
    "endpoint_at_or_before_reference",
    "unresolved_candidate_at_or_before_reference",
    "death_or_replacement_at_or_before_reference",
    "followup_end_at_or_before_reference",
    "no_eligible_landmark",
)
LAB_ANALYTES = ("egfr", "hb", "ldh")


def series_features(staged: DataFrame, stale_months: int = 18, patient: str = "patient_id", seq: str = "seq") -> DataFrame:
    """Per study date (its last study): current and previous values, changes, counts, stage and slope, all from studies on
    or before the date. One sort by patient, day and input order serves every window."""
    s = staged.withColumn("__day", asof.DAY(F.col("date")))
    in_order = Window.partitionBy(patient).orderBy("__day", seq)
    upto = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gradient = F.col("mean_gradient")
    t = F.col("__day") / DAYS_PER_YEAR
    known = F.when(gradient.isNotNull(), F.col("__day"))
    slope = F.when((F.count(gradient).over(upto) >= 3) & (F.max(known).over(upto) > F.min(known).over(upto)), F.regr_slope(gradient, t).over(upto))
    before = F.lag(F.struct("date", "mean_gradient")).over(in_order)
    s = s.withColumn("__prev", before).withColumn("gradient_slope", slope).withColumn("n_echoes", F.count("*").over(upto))
    s = s.withColumn("__last", F.row_number().over(Window.partitionBy(patient, "__day").orderBy(F.desc(seq))))
    change = lambda c: (F.col(c) - F.col(f"ref_{c}"))
    return s.filter("__last = 1").select(
        patient,
        F.col("date").alias("landmark_date"),
        "ref_date",
        *(F.col(f"ref_{c}").alias(f"ref_{n}") for n, c in (("gradient", "mean_gradient"), ("eoa", "eoa"), ("dvi", "dvi"), ("ar", "ar"), ("lvef", "lvef"), ("svi", "svi"))),
        *(F.col(c).alias(f"current_{n}") for n, c in (("gradient", "mean_gradient"), ("eoa", "eoa"), ("dvi", "dvi"), ("ar", "ar"), ("lvef", "lvef"), ("svi", "svi"))),
        *(change(c).alias(f"delta_{n}") for n, c in (("gradient", "mean_gradient"), ("eoa", "eoa"), ("dvi", "dvi"), ("ar", "ar"))),
        (gradient - F.col("__prev.mean_gradient")).alias("last_change_gradient"),
        years_between(F.col("date"), F.col("__prev.date")).alias("last_change_interval_years"),
        F.lit(0.0).alias("time_since_last_echo_years"),
        "n_echoes",
        F.lit(0 > stale_months).alias("stale_echo"),
        F.when(F.col("date") > F.col("ref_date"), F.col("staged.stage")).otherwise("0").alias("current_stage"),
        "gradient_slope",
    )


def thin(rows: DataFrame, least_days: int, patient: str = "patient_id", date: str = "landmark_date") -> DataFrame:
    """Keep a patient's date only if it is at least ``least_days`` after the last kept one (greedy, so folded in order)."""
    if least_days <= 1:
        return rows
    day = asof.DAY(F.col(date))
    kept = rows.groupBy(patient).agg(F.array_sort(F.collect_set(day)).alias("days"))
    greedy = F.aggregate("days", F.array().cast("array<int>"), lambda acc, d: F.when((F.size(acc) == 0) | (d - F.element_at(acc, -1) >= least_days), F.concat(acc, F.array(d))).otherwise(acc))
    kept = kept.select(F.col(patient).alias("__p"), F.explode(greedy).alias("__d"))
    return rows.join(kept, (F.col(patient) == F.col("__p")) & (day == F.col("__d")), "left_semi")


def static_features(rows: DataFrame, patients: DataFrame, patient: str = "patient_id") -> DataFrame:
    """Patient covariates, indexed reference area and mismatch grade, and valve age."""
    carried = [c for c in patients.columns if c not in rows.columns]
    area = F.when(F.col("bsa") != 0, F.col("ref_eoa") / F.col("bsa"))
    out = rows.join(patients.select(patient, *carried), patient)
    return out.withColumn("ieoa", area).withColumn("mismatch_grade", rules.mismatch_grade(F.col("ieoa"))).withColumn("valve_age_years", years_between(F.col("landmark_date"), F.col("implant_date"))).drop("implant_date")


def timeline(patients: DataFrame, studies: DataFrame, patient: str = "patient_id", seq: str = "seq") -> DataFrame:
    """Every study with its place against time zero: reference, before time zero, or its stage."""
    reference = asof.select_reference(studies, patients, patient=patient, seq=seq)
    staged = adj.staged_studies(studies, reference, patient)
    note = F.when(F.col(seq) == F.col(f"ref_{seq}"), "reference").when(F.col("date") <= F.col("ref_date"), "before_time_zero").otherwise(F.concat(F.lit("stage_"), F.col("staged.stage")))
    return staged.select(patient, "date", seq, note.alias("note"))


def eligibility(patients: DataFrame, studies: DataFrame, reference: DataFrame, events: DataFrame, label_policy: str = "primary", override: DataFrame | None = None, patient: str = "patient_id") -> DataFrame:
    """Per patient: the label and censoring dates, and ``exclusion_reason`` (NULL: eligible so far).

    ``override`` (patient, svd_event_date) replaces the label of the patients it lists.
    """
    svd, censor = adj.label_dates(label_policy)
    own = events.withColumn("__svd", svd).withColumn("__censor", censor)
    if override is not None:
        o = override.select(F.col(patient).alias("__p"), F.col("svd_event_date").alias("__o"), F.lit(True).alias("__set"))
        own = own.join(o, F.col(patient) == F.col("__p"), "left").withColumn("__svd", F.when(F.col("__set"), F.col("__o")).otherwise(F.col("__svd"))).withColumn("__censor", F.when(F.col("__set").isNull(), F.col("__censor"))).drop("__p", "__o", "__set")
    own = own.select(patient, F.col("__svd").alias("svd_date"), F.col("__censor").alias("censor_date"), "death_date", "replacement_date", F.col("end_followup_date").alias("end_date"), *(["first_thrombosis_date"] if "first_thrombosis_date" in events.columns else []), F.lit(True).alias("__events"))
    seen = studies.select(patient).distinct().withColumn("__echo", F.lit(True))
    rows = patients.select(patient).join(own, patient, "left").join(seen, patient, "left").join(reference.select(patient, "ref_date"), patient, "left")
    before = lambda c: F.col(c) <= F.col("ref_date")
    conditions = (F.col("__events").isNull(), F.col("__echo").isNull(), F.col("ref_date").isNull(), before("svd_date"), before("censor_date"), F.coalesce(before("death_date"), F.lit(False)) | F.coalesce(before("replacement_date"), F.lit(False)), before("end_date"))
    reason = F.lit(None).cast("string")
    for name, condition in reversed(list(zip(EXCLUSION_REASONS, conditions, strict=False))):
        reason = F.when(condition, name).otherwise(reason)
    return rows.withColumn("exclusion_reason", reason).drop("__events", "__echo", "ref_date")


def build_landmarks(patients: DataFrame, studies: DataFrame, labs: DataFrame, exposures: DataFrame, events: DataFrame, horizon: float = 5.0, least_days: int = 1, label_policy: str = "primary", override: DataFrame | None = None, with_features: bool = True, patient: str = "patient_id", seq: str = "seq", staged: DataFrame | None = None, history: DataFrame | None = None) -> DataFrame:
    """Landmark rows; ``staged`` (from :func:`adjudicate.staged_studies`) saves staging the studies again, ``history`` (a value and
    an episode a row) stands for ``labs`` and ``exposures`` where both come of the same rows. A landmark lies on or after the reference and strictly before the endpoint, a censoring candidate,
    death, replacement and the end of follow-up."""
    if staged is None:
        staged = adj.staged_studies(studies, asof.select_reference(studies, patients, patient=patient, seq=seq), patient)
    reference = staged.select(patient, "ref_date").distinct()
    eligible = eligibility(patients, studies, reference, events, label_policy, override, patient).filter("exclusion_reason is null").drop("exclusion_reason")
    rows = series_features(staged, patient=patient, seq=seq).join(eligible, patient)
    rows = rows.filter((F.col("landmark_date") >= F.col("ref_date")) & (F.col("landmark_date") < F.least("svd_date", "censor_date", "death_date", "replacement_date", "end_date")))
    rows = thin(rows, least_days, patient)
    end = F.least("end_date", "censor_date")
    rows = rows.withColumn("__o", adj.outcome(F.col("landmark_date"), F.col("svd_date"), F.col("death_date"), F.col("replacement_date"), end, horizon)).withColumn("time", F.col("__o.time")).withColumn("event", F.col("__o.event"))
    if "first_thrombosis_date" in rows.columns:
        rows = rows.withColumn("__s", adj.secondary_outcome(F.col("landmark_date"), F.col("first_thrombosis_date"), F.col("end_date"), horizon)).withColumn("time_thromb", F.col("__s.time")).withColumn("event_thromb", F.col("__s.event")).drop("__s", "first_thrombosis_date")
    rows = rows.drop("__o", "svd_date", "censor_date", "death_date", "replacement_date", "end_date").withColumn("t_lm", years_between(F.col("landmark_date"), F.col("ref_date"))).drop("ref_date")
    share = (1.0 / F.count("*").over(Window.partitionBy(patient))).alias("row_weight_patient_balanced")
    if not with_features:
        rows = rows.join(patients.select(patient, *(c for c in ("route", "design_class") if c in patients.columns)), patient)
        return rows.select("*", share)
    # the weight joins while rows lie by patient
    rows = static_features(rows, patients, patient).select("*", share)
    rows = asof.history_features(rows, [labs, exposures] if history is None else [history], list(LAB_ANALYTES), {"egfr": "egfr_slope"}, patient=patient, seq=seq)
    rows = rows.withColumn("overdue_flag", F.col("time_since_last_echo_years") > 1.25)
    return rows.select(*(c for c in rows.columns if c != "row_weight_patient_balanced"), "row_weight_patient_balanced")


def exclusions(patients: DataFrame, studies: DataFrame, events: DataFrame, label_policy: str = "primary", patient: str = "patient_id", seq: str = "seq") -> DataFrame:
    """Patients per exclusion reason, reasons without patients included."""
    spark = patients.sparkSession
    reference = asof.select_reference(studies, patients, patient=patient, seq=seq)
    status = eligibility(patients, studies, reference, events, label_policy, patient=patient)
    stop = F.least("svd_date", "censor_date", "death_date", "replacement_date", "end_date")
    s = studies.select(F.col(patient).alias("__p"), F.col("date").alias("__d")).join(reference.select(F.col(patient).alias("__r"), "ref_date"), F.col("__p") == F.col("__r"))
    has = status.join(s, (F.col(patient) == F.col("__p")) & (F.col("__d") >= F.col("ref_date")) & (F.col("__d") < stop), "left_semi").select(patient).withColumn("__has", F.lit(True))
    reason = F.coalesce("exclusion_reason", F.when(F.col("__has").isNull(), "no_eligible_landmark"))
    counts = status.join(has, patient, "left").select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    all_reasons = spark.createDataFrame([(r,) for r in EXCLUSION_REASONS], "reason string")
    return all_reasons.join(counts, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).cast("long").alias("n_patients"))


def contract(rows: DataFrame, events: DataFrame, features: Sequence[str], patient: str = "patient_id") -> DataFrame:
    """(check_name, n) of a landmark table: rows on or after the endpoint, forbidden features, rows without a positive time,
    and its support (rows, patients, event patients per cause). The first three must be 0."""
    ends = events.select(F.col(patient).alias("__p"), "svd_adjudicated_date")
    j = rows.join(ends, F.col(patient) == F.col("__p"), "left")
    late = F.coalesce(F.col("landmark_date") >= F.col("svd_adjudicated_date"), F.lit(False))
    n = {
        "rows_on_or_after_endpoint": F.sum(late.cast("long")), "rows_without_time": F.sum((~F.coalesce(F.col("time") > 0, F.lit(False))).cast("long")),
        "landmark_rows": F.count("*"), "landmark_patients": F.countDistinct(patient), **{f"{c}_patients": F.countDistinct(F.when(F.col("event") == k, F.col(patient))) for c, k in adj.CAUSES.items()},
    }
    forbidden = F.lit(len(set(features) & FORBIDDEN_FEATURES)).cast("long")
    parts = [F.struct(F.lit(k).alias("check_name"), F.coalesce(x, F.lit(0)).cast("long").alias("n")) for k, x in n.items()]
    return j.agg(F.array(F.struct(F.lit("forbidden_features").alias("check_name"), forbidden.alias("n")), *parts).alias("x")).select(F.inline("x"))
