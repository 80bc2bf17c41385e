"""Queries over notes, observations, evidence tables and data quality."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions import rules
from timberline.operators import adjudicate as adj
from timberline.operators import aggregates, experiments, landmark, profile, resample, survival, text
from timberline.operators.staging import stage
from timberline.plans.bindings import role, with_roles
from timberline.plans.cohort_queries import _ALL, _RECORDS, _elig_sql, events_of, records_of, staged_of, written_staged_of
from timberline.plans.registry import query, r6
from timberline.sources.tables import table_hash

_NOTES = with_roles("notes") + ", kept as (select *, row_number() over (partition by patient_id order by note_date, seq) - 1 as note_index, cast(patient_id as string) || '_' || cast(row_number() over (partition by patient_id order by note_date, seq) - 1 as string) as note_ref from notes where status <> 'Deleted')"


def notes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.prepare_notes(role(spark, sf_dir, "notes"))


def hits_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.hits_table(notes_of(spark, sf_dir), ["patient_id", "note_ref", "seq", "year"])


@query(_NOTES + " select patient_id, seq, cast(note_index as int) as note_index, note_ref from kept")
def a8_prepare_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes_of(spark, sf_dir).select("patient_id", "seq", "note_index", "note_ref")


@query(_NOTES + """ select seq, seq % 4 = 0 as transcatheter, seq % 4 = 1 as surgical, case when seq % 4 = 0 then 20 + seq % 10 when seq % 4 = 1 then 20 + seq % 9 end as size_mm, true as prosthesis,
  seq % 9 = 1 as event_valve_in_valve, false as event_redo, seq % 13 = 0 as event_endocarditis from kept""")
def g1_g5_g8_note_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = text.note_flags(notes_of(spark, sf_dir))
    return out.select("seq", "transcatheter", "surgical", F.get("sizes", F.lit(0)).cast("long").alias("size_mm"), "prosthesis", "event_valve_in_valve", "event_redo", "event_endocarditis")


@query(_NOTES + """ select seq, 'gradient' as field, cast(seq * 7 % 60 as double) as value, null as word from kept union all select seq, 'dvi', (10 + seq % 80) / 100.0::double, null from kept
  union all select seq, 'eoa', round(1 + (seq % 10) / 10.0::double, 1), null from kept union all select seq, 'regurgitation', case seq % 3 when 0 then 2.0::double when 1 then 1.0::double else 4.0::double end, case seq % 3 when 0 then 'moderate' when 1 then 'trace' else 'severe' end from kept""")
def g3_g4_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits_of(spark, sf_dir).select("seq", "field", "value", "word")


@query(_NOTES + " select note_ref, 'prosthetic' as class, cast(seq * 7 % 60 as double) as gradient, (10 + seq % 80) / 100.0::double as dvi, round(1 + (seq % 10) / 10.0::double, 1) as eoa, case seq % 3 when 0 then 2.0::double when 1 then 1.0::double else 4.0::double end as regurgitation from kept")
def g7_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.observations(hits_of(spark, sf_dir), ["note_ref"]).select("note_ref", "class", "gradient", "dvi", "eoa", "regurgitation")


_ALIASES = [("SAPIEN", r"SAPIEN", False), ("SAPIEN 3", r"SAPIEN\s+3", False), ("SAPIEN 3", r"\bS3\b", True), ("Magna", r"Magna", False), ("Magna Ease", r"Magna\s+Ease", False), ("Epic", r"\bEpic\b", True)]


def models_of(spark: SparkSession, sf_dir: str, notes: DataFrame | None = None) -> DataFrame:
    aliases = spark.createDataFrame(_ALIASES, "model string, pattern string, guarded boolean")
    return text.device_matches(notes_of(spark, sf_dir) if notes is None else notes, aliases, ["patient_id", "note_ref", "seq"])


def passport_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Flagged notes, hits and device matches, all from one numbering of the notes, which is written out once."""
    notes = stage(notes_of(spark, sf_dir), "notes")
    return text.note_flags(notes), text.hits_table(notes, ["patient_id", "note_ref", "seq", "year"]), models_of(spark, sf_dir, notes)


@query(_NOTES + " select seq, unnest(case seq % 4 when 0 then ['SAPIEN', 'SAPIEN 3'] when 1 then ['Magna', 'Magna Ease'] else [] end) as model from kept")
def g2_device_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models_of(spark, sf_dir).select("seq", "model")


@query(_NOTES + """, p as (select patient_id, count(*) as n_notes, min(year) as first_note_year, max(year) as last_note_year, bool_or(seq % 4 = 0) as t, bool_or(seq % 4 = 1) as s, min(year) filter (where seq % 4 < 2) as implant_year,
  count(*) as n_gradients_prosthetic, count(distinct year) as n_gradient_years_prosthetic, max(cast(seq * 7 % 60 as double)) as max_gradient_prosthetic, min(case when seq % 4 = 0 then 20 + seq % 10 when seq % 4 = 1 then 20 + seq % 9 end) as size_mm, bool_or(seq % 9 = 1) as event_valve_in_valve, bool_or(seq % 13 = 0) as event_endocarditis from kept group by patient_id)
select patient_id, n_notes, first_note_year, last_note_year, case when t and s then 'TAVR+SAVR' when t then 'TAVR' when s then 'SAVR' else '' end as route, implant_year, case when s then 'Magna Ease' when t then 'SAPIEN 3' else '' end as canonical_model, size_mm,
  n_gradients_prosthetic, n_gradient_years_prosthetic, max_gradient_prosthetic, event_valve_in_valve, event_endocarditis from p""")
def d15_passport(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = text.passport(*passport_parts(spark, sf_dir))
    return out.select("patient_id", "n_notes", "first_note_year", "last_note_year", "route", "implant_year", "canonical_model", F.col("size_mm").cast("long").alias("size_mm"), "n_gradients_prosthetic", "n_gradient_years_prosthetic", "max_gradient_prosthetic", "event_valve_in_valve", "event_endocarditis")


@query(_NOTES + """, p as (select patient_id, bool_or(seq % 4 = 0) as t, bool_or(seq % 4 = 1) as s, min(year) filter (where seq % 4 < 2) as iy, max(year) as ly from kept group by patient_id),
f as (select p.*, (select min(k.year) from kept k where k.patient_id = p.patient_id and k.seq % 9 = 1 and k.year > p.iy) as fy from p where iy is not null and t <> s and ly > iy)
select patient_id, case when t then 'TAVR' else 'SAVR' end as route, cast(coalesce(fy, ly) - iy as double) as time, case when fy is not null then 1 else 0 end as event from f""")
def f12_note_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags, hits, models = passport_parts(spark, sf_dir)
    records = text.passport(flags, hits, models)
    return text.note_outcomes(records, flags.filter("event_valve_in_valve").select("patient_id", "year"))


@query(_NOTES + """, p as (select patient_id, bool_or(seq % 4 = 0) as t, bool_or(seq % 4 = 1) as s, min(year) filter (where seq % 4 < 2) as iy, max(year) as ly from kept group by patient_id),
r as (select case when t = s then 'route_not_unambiguous' when iy is null then 'no_implant_year' when ly > iy then 'kept' else 'no_later_note' end as reason from p)
select e.reason, count(r.reason) as n from (select unnest(['route_not_unambiguous', 'no_implant_year', 'no_later_note', 'kept']) as reason) e left join r on e.reason = r.reason group by e.reason""")
def f12_note_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.note_outcome_exclusions(text.passport(*passport_parts(spark, sf_dir)))


@query(_NOTES + """, b as (select note_ref, text, seq, upper(substr(text, 3, 9)) as q from kept), l as (select *, case when strpos(text, q) > 0 then strpos(text, q) else strpos(lower(text), lower(q)) end - 1 as spot from b)
select note_ref, concat_ws(',', case when seq % 2 = 0 then 'redo@0' end, case when seq % 2 = 1 and seq % 3 > 0 then 'redo@' || spot end, case when seq % 3 > 0 then 'thrombosis@' || spot end) as events,
  concat_ws(',', case when seq % 2 = 1 and seq % 3 = 0 then 'quote_not_found:event:redo' end, case when seq % 3 = 0 then 'quote_not_found:event:thrombosis' end) as warnings from l""")
def g9_merged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of two extractions: the rules' stay, the other's are added where their quote is found in the note."""
    n = notes_of(spark, sf_dir)
    event = lambda kind, quote: F.struct(F.lit(kind).alias("type"), quote.alias("quote"))
    sure = [F.lit(None).cast("double").alias("size_mm"), F.lit(None).cast("double").alias("size_mm_confidence")]
    rules_ = n.select("note_ref", "text", *sure, F.array_compact(F.array(F.when(F.col("seq") % 2 == 0, event("redo", F.substring("text", 1, 5))))).alias("events"))
    quote = F.when(F.col("seq") % 3 > 0, F.upper(F.substring("text", 3, 9))).otherwise("said nowhere in it")
    other = n.select("note_ref", *sure, F.array(event("redo", quote), event("thrombosis", quote)).alias("events"))
    merged = text.merge_extractions(rules_, other, ["size_mm"], events="events", text="text")
    shown = F.transform("events", lambda e: F.concat(e["type"], F.lit("@"), e["span"]["start"].cast("string")))
    return merged.select("note_ref", F.array_join(shown, ",").alias("events"), F.array_join("warnings", ",").alias("warnings"))


@query(_NOTES + """, a as (select note_ref, cast(seq * 7 % 60 as double) as gradient, 0.7::double as c1 from kept where seq % 5 > 0), b as (select note_ref, cast(seq * 7 % 60 + case when seq % 6 = 0 then 1 else 0 end as double) as gradient, 0.8::double as c2 from kept where seq % 7 > 0)
select coalesce(a.note_ref, b.note_ref) as note_ref, coalesce(a.gradient, b.gradient) as gradient, case when a.gradient is null then c2 when a.gradient = b.gradient then greatest(c1, c2, 0.95::double) else c1 end as gradient_confidence, coalesce(a.gradient <> b.gradient, false) as conflict from a full outer join b on a.note_ref = b.note_ref""")
def g9_merge_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notes_of(spark, sf_dir)
    g = (F.col("seq") * 7 % 60).cast("double")
    a = n.filter("seq % 5 > 0").select("note_ref", g.alias("gradient"), F.lit(0.7).alias("gradient_confidence"))
    b = n.filter("seq % 7 > 0").select("note_ref", (g + (F.col("seq") % 6 == 0).cast("int")).alias("gradient"), F.lit(0.8).alias("gradient_confidence"))
    return text.merge_extractions(a, b, ["gradient"]).select("note_ref", "gradient", "gradient_confidence", (F.size("warnings") > 0).alias("conflict"))


@query(r"""select 'text' as "column", 'identifier' as finding, n from (select count(*) as n from documents where regexp_matches(text, '\b[A-Z]{1,3}\d{6,}\b')) where n > 0
 union all select 'text', 'long_narrative', n from (select count(*) as n from documents where length(text) > 600 and regexp_matches(text, '(?i)\b(?:patient|history|presents|denies|reports)\b')) where n > 0
 union all select 'source', 'source_column', 1""")
def g11_privacy_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.privacy_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), source_names=("patient", "source"))


_AUDITED = _NOTES + """, ranked as (select note_ref, type, year, status, row_number() over (partition by type order by md5('3:' || note_ref), note_ref) as r from kept),
picked as (select * from ranked where r <= 6 and type in ('Operative Report', 'Progress Notes'))"""


@query(_AUDITED + " select note_ref, type, 'year' as field, cast(year as string) as value from picked union all select note_ref, type, 'status', status from picked")
def g10_audit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: six, six and two notes per type, one row per field to check."""
    rows = notes_of(spark, sf_dir)
    return text.audit_sample(rows, "type", {"Operative Report": 6, "Progress Notes": 6}, ["year", "status"], seed=3)


@query(_NOTES + " select 'rules' as method, 'gradient' as field, count(*) as n, round(avg((seq % 6 > 0)::int), 6) as share_correct from kept where seq % 10 > 0")
def d18_extraction_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.observations(hits_of(spark, sf_dir), ["note_ref"]).select("note_ref", F.lit("rules").alias("method"), "gradient")
    expected = notes_of(spark, sf_dir).select("note_ref", F.when(F.col("seq") % 10 > 0, (F.col("seq") * 7 % 60 + (F.col("seq") % 6 == 0).cast("int")).cast("double")).alias("gradient"))
    return aggregates.extraction_accuracy(found, expected, "note_ref", ["gradient"]).withColumn("share_correct", r6("share_correct"))


@query("select p_brand as brand, count(*) as n_reports, count(*) filter (where regexp_matches(p_name, '(?i)ring|bolt')) as n_problem_reports from part group by p_brand")
def d17_report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.report_counts(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_brand", "p_name", "(?i)ring|bolt").withColumnRenamed("p_brand", "brand")


@query("select p_partkey, case when contains(lower(p_name), 'ring') then 'ring' when contains(lower(p_name), 'small') then 'small' when p_type = 'ECONOMY' then 'economy' end as class, case when contains(lower(p_name), 'ring') or contains(lower(p_name), 'small') then 'generic_name' when p_type = 'ECONOMY' then 'therapeutic_class' end as matched_via from part")
def b7_medication_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", F.inline(F.array(rules.medication_class(F.col("p_name"), F.col("p_type"), [("ring", ["ring"]), ("small", ["small"])], [("economy", ["economy"])]))))


@query(with_roles("obs") + """, recursive_bad as (
  with recursive b(record_id) as (select record_id from obs where value_origin not in ('observed', 'derived') union select o.record_id from obs o join b on o.parent_id = b.record_id) select record_id from b)
select o.record_id, b.record_id is null as admitted, case when o.value_origin not in ('observed', 'derived') then 'non_observed_origin' when b.record_id is not null then 'non_observed_ancestor' end as reason from obs o left join recursive_bad b on o.record_id = b.record_id""")
def m2_lineage_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = role(spark, sf_dir, "obs").withColumn("parent_record_ids", F.array_compact(F.array("parent_id")))
    return profile.admitted_records(o)


_OBS = with_roles("obs") + ", us as (select * from obs where duplicate_status = 'unique' and not suppressed), ix as (select person_id, min(date) as index_date from obs group by person_id)"


def first_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = role(spark, sf_dir, "obs")
    persons = o.groupBy("person_id").agg(F.min("date").alias("index_date")).withColumn("index_date_precision", F.lit("day"))
    return profile.first_in_window(profile.usable(o), persons)


@query(_OBS + """, fr as (select u.* from us u join ix on u.person_id = ix.person_id where datediff('day', ix.index_date::date, u.date::date) between -30 and 180 qualify row_number() over (partition by u.person_id, variable order by date, record_id) = 1),
st as (select variable, count(*) as n, avg(value) as m, stddev_samp(value) as s from fr group by variable)
select variable, 'baseline' as kind, n, 'mean' as statistic, round(m, 6) as value, case when n < 30 then 'descriptive_only' else 'fit_local' end as support from st union all select variable, 'baseline', n, 'sd', round(s, 6), case when n < 30 then 'descriptive_only' else 'fit_local' end from st""")
def m1_baseline_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.baseline_summaries(first_of(spark, sf_dir)).select("variable", "kind", "n", "statistic", r6("value"), "support")


@query(_OBS + """, sl as (select variable, person_id, regr_slope(value, datediff('day', date '1970-01-01', date::date) / 365.25::double) as slope, count(*) as k, datediff('day', min(date::date), max(date::date)) / 365.25 as span from us group by variable, person_id)
select variable, count(*) as n_persons, round(avg(slope), 4) as mean_slope, round(stddev_samp(slope) / sqrt(count(*)), 4) as se from sl where k >= 2 and span >= 0.5 group by variable""")
def e9_person_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.person_slopes(profile.usable(role(spark, sf_dir, "obs")))
    return out.select("variable", "n_persons", F.round("mean_slope", 4).alias("mean_slope"), F.round("se", 4).alias("se"))


@query(_OBS + ", py as (select variable, person_id, substr(date, 1, 4) as year, avg(value) as v from us group by all) select variable, year, count(*) as n_persons, round(avg(v), 6) as mean from py group by variable, year")
def e10_annual_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = profile.usable(role(spark, sf_dir, "obs")).withColumn("date_precision", F.lit("year"))
    return profile.annual_means(o).withColumn("mean", r6("mean"))


@query(with_roles("obs") + " select count(*) filter (where duplicate_status = 'exact_duplicate') as exact_duplicate, 0 as possible_duplicate, count(*) filter (where duplicate_status = 'unique' and suppressed) as suppressed_not_converted from obs")
def m1_exclusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.exclusion_counts(role(spark, sf_dir, "obs"))


@query(with_roles("surv") + """, c as (select patient_id as target_id, row_id as seq, time, pred as estimate, pred - 0.01::double as lower, case when row_id % 10 = 0 then pred - 0.005::double else pred + 0.01::double end as upper from surv),
l as (select *, lag(time) over w as pt, lag(estimate) over w as pe from c window w as (partition by target_id order by seq))
select target_id, rule, n from (select target_id, 'times_not_increasing' as rule, count(*) filter (where time <= pt) as n from l group by 1 union all select target_id, 'not_monotone', count(*) filter (where estimate - pe < -0.001) from l group by 1
  union all select target_id, 'limit_not_probability', count(*) filter (where lower < 0 or lower > 1 or upper < 0 or upper > 1) from l group by 1 union all select target_id, 'interval_without_estimate', count(*) filter (where upper < estimate - 0.001) from l group by 1) where n > 0""")
def m5_curve_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = role(spark, sf_dir, "surv")
    c = s.select(F.col("patient_id").alias("target_id"), F.col("row_id").alias("seq"), F.lit("cumulative_incidence").alias("kind"), "time", F.col("pred").alias("estimate"), (F.col("pred") - 0.01).alias("lower"), F.when(F.col("row_id") % 10 == 0, F.col("pred") - 0.005).otherwise(F.col("pred") + 0.01).alias("upper"))
    return profile.curve_violations(c)


def targets_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = role(spark, sf_dir, "surv")
    k = F.col("row_id")
    return s.select(
        k.cast("string").alias("target_id"), F.element_at(F.array(F.lit("mean"), F.lit("km_survival"), F.lit("log_effect"), F.lit("picture")), (k % 4 + 1).cast("int")).alias("kind"),
        F.when(k % 7 == 0, "other").otherwise("all_cause_death").alias("variable"), F.lit(None).cast("string").alias("statistic"), F.when(k % 11 == 0, "mmHg").alias("unit"), F.when(k % 17 == 0, "<5").otherwise("0.2").alias("estimate_text"), F.col("pred").alias("estimate"),
        F.when(k % 5 > 0, "cause_specific_log_hr").alias("effect_type"), F.when(k % 13 > 0, "implantation").alias("origin"), (k % 12).cast("double").alias("horizon_years"), F.lit(None).cast("string").alias("outcome_definition"), F.lit(False).alias("competing_events"),
        F.when(k % 3 > 0, F.lit(0.1)).alias("standard_error"), F.lit(None).cast("long").alias("sample_size"), F.when(k % 8 > 0, F.lit(0.05)).alias("tolerance"), F.when(k % 2 == 0, "fit").otherwise("holdout").alias("role"), F.when(k % 6 == 0, "draft").otherwise("approved").alias("review_status"),
        F.concat(F.lit("g"), F.col("patient_id")).alias("study_group_id"), F.when(k % 50 == 0, F.array(F.concat(F.lit("g"), F.col("patient_id") + 1))).otherwise(F.array().cast("array<string>")).alias("overlapping_groups"), F.lit(1.0).alias("weight"),
    )


_TARGETS = with_roles("surv") + """, t as (select row_id as k, patient_id as g, ['mean', 'km_survival', 'log_effect', 'picture'][row_id % 4 + 1] as kind, case when row_id % 2 = 0 then 'fit' else 'holdout' end as role from surv),
d as (select *, case when k % 6 = 0 then 'excluded|unreviewed' when kind = 'picture' then 'excluded|unsupported_kind' when k % 7 = 0 then 'excluded|no_reporting_operator' when k % 17 = 0 then 'excluded|suppressed'
  when kind = 'log_effect' and k % 5 = 0 then 'excluded|unknown_effect_type' when kind <> 'mean' and k % 13 = 0 then 'excluded|time_origin_mismatch' when kind <> 'mean' and k % 12 > 10 then 'sensitivity|extrapolation'
  when k % 3 = 0 then 'sensitivity|no_uncertainty' when k % 8 = 0 then 'sensitivity|no_tolerance' else role || '|compatible' end as x from t),
f as (select distinct g from d where x = 'fit|compatible')"""


@query(_TARGETS + " select cast(k as string) as target_id, case when x = 'holdout|compatible' and (g in (select g from f) or (k % 50 = 0 and g + 1 in (select g from f))) then 'excluded' else split_part(x, '|', 1) end as role, case when x = 'holdout|compatible' and (g in (select g from f) or (k % 50 = 0 and g + 1 in (select g from f))) then 'fit_holdout_overlap' else split_part(x, '|', 2) end as status from d")
def m4_evidence_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.evidence_decisions(targets_of(spark, sf_dir), {"all_cause_death": ""}, ["all_cause_death"], 10.0)
    return out.select("target_id", "role", "status")


@query(with_roles("surv") + """, e as (select distinct patient_id as a, patient_id + 1 as b from surv where row_id % 50 = 0), nodes as (select distinct patient_id as g from surv union select b from e),
br as (select g, case when g - 1 in (select a from e) then 0 else 1 end as starts from nodes), ids as (select g, sum(starts) over (order by g) as comp from br)
select cast(s.row_id as string) as target_id, round(1.0::double / count(*) over (partition by comp), 8) as share from surv s join ids on ids.g = s.patient_id""")
def m6_study_group_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.study_group_weights(targets_of(spark, sf_dir)).select("target_id", F.round("share", 8).alias("share"))


@query(with_roles("surv") + ", t as (select row_id, patient_id as g, row_id % 4 as kd, row_id % 7 = 0 as v, row_id % 13 > 0 as o, row_id % 12 as h, pred, case when row_id % 8 > 0 then 0.05::double end as tol from surv) select cast(least(cast(a.row_id as string), cast(b.row_id as string)) as string) as target_id, greatest(cast(a.row_id as string), cast(b.row_id as string)) as other_id from t a join t b on a.row_id < b.row_id and a.g <> b.g and a.kd = b.kd and a.v = b.v and a.o = b.o and a.h = b.h where a.g // 4 = b.g // 4 and abs(a.pred - b.pred) > a.tol + b.tol")
def c12_target_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quantity belongs to four neighbouring study groups, so it has few targets, however many there are in all."""
    t = targets_of(spark, sf_dir).withColumn("statistic", F.floor(F.substring("study_group_id", 2, 20).cast("int") / 4).cast("string"))
    return profile.target_conflicts(t).select("target_id", "other_id")


@query(with_roles("patients", "studies", "exposures", "terminal") + """ select 'patients: duplicate key' as check_name, 0 as n union all select 'events: duplicate key', 0 union all select 'studies: unknown patient', 0 union all select 'exposures: unknown patient', 0 union all select 'events: unknown patient', 0
  union all select 'studies: before implantation', 0 union all select 'studies.mean_gradient: out of range', (select count(*) from studies where mean_gradient > 30) union all select 'events.death_date: after follow-up', 0 union all select 'events.replacement_date: after follow-up', 0
  union all select 'exposures: stop before start', 0 union all select 'events: missing end_reason', 1""")
def m10_structural_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"patients": role(spark, sf_dir, "patients"), "studies": role(spark, sf_dir, "studies"), "exposures": role(spark, sf_dir, "exposures"), "events": role(spark, sf_dir, "terminal")}
    return profile.structural_violations(tables, {"patients": ["patient_id", "route"], "events": ["end_reason"]}, {"studies": {"mean_gradient": (0, 30)}})


@query(with_roles("surv") + """, r as (select row_id, pred + 0.0004::double as pred, pred2 + 0.0003::double as pred2 from surv where row_id % 20 = 0), s as (select distinct pred, pred2 from surv), sd as (select stddev_pop(pred) as a, stddev_pop(pred2) as b from surv)
select row_id, round(min(sqrt(((r.pred - s.pred) / a) ** 2 + ((r.pred2 - s.pred2) / b) ** 2)), 6) as distance from r, s, sd group by row_id""")
def c13_nearest_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Released rows (every twentieth, moved a little) against all source rows."""
    s = role(spark, sf_dir, "surv")
    released = s.filter("row_id % 20 = 0").select("row_id", (F.col("pred") + 0.0004).alias("pred"), (F.col("pred2") + 0.0003).alias("pred2"))
    return profile.nearest_source(released, s, ["pred", "pred2"], "row_id").withColumn("distance", r6("distance"))


@query(with_roles("surv") + """, r as (select row_id, pred + 0.0004::double as pred, pred2 + 0.0003::double as pred2 from surv where row_id % 20 = 0), s as (select distinct pred, pred2 from surv), sd as (select stddev_pop(pred) as a, stddev_pop(pred2) as b from surv),
d as (select row_id, min(sqrt(((r.pred - s.pred) / a) ** 2 + ((r.pred2 - s.pred2) / b) ** 2)) as distance from r, s, sd group by row_id)
select count(*) as rows, round(avg((distance < 0.1)::int), 6) as share_below, round(quantile_cont(distance, 0.05), 6) as percentile_5 from d""")
def c13_nearest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of released rows within 0.1 of a source row, and the fifth percentile of the distances."""
    s = role(spark, sf_dir, "surv")
    released = s.filter("row_id % 20 = 0").select("row_id", (F.col("pred") + 0.0004).alias("pred"), (F.col("pred2") + 0.0003).alias("pred2"))
    out = profile.nearest_summary(profile.nearest_source(released, s, ["pred", "pred2"], "row_id"))
    return out.select("rows", r6("share_below"), r6("percentile_5"))


_ATTRIBUTES = "design_class, sex, size_mm, age_at_implant::int as age, bmi::int as mass"


@query(with_roles("patients") + f", p as (select patient_id, {_ATTRIBUTES} from patients), s as (select design_class, sex, size_mm, age, mass, count(*) as n_source from p group by all having count(*) < 5), r as (select design_class, sex, size_mm, age, mass, count(*) as n_released from p where patient_id % 2 = 1 group by all) select r.*, s.n_source from r join s using (design_class, sex, size_mm, age, mass)")
def c13_rare_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combinations of attributes that fewer than five source patients have, among every second patient."""
    p = role(spark, sf_dir, "patients").selectExpr("patient_id", "design_class", "sex", "size_mm", "cast(round(age_at_implant) as int) as age", "cast(round(bmi) as int) as mass")
    return profile.rare_combinations(p.filter("patient_id % 2 = 1"), p, ["design_class", "sex", "size_mm", "age", "mass"])


_ONSET = _RECORDS + """, iv as (select s.patient_id, r.svd_adjudicated_date as hi, max(s.date) filter (where s.date < r.svd_adjudicated_date and s.mean_gradient is not null and (s.eoa is not null or s.dvi is not null) and (s.date = s.ref_date or s.stage in ('0', '1'))) as lo
  from staged s join records r on r.patient_id = s.patient_id where r.svd_adjudicated_date is not null group by all)"""


@query(with_roles(*_ALL) + _ONSET + " select patient_id, lo as interval_lo, hi as interval_hi, coalesce(lo < hi, false) as defensible from iv")
def e7_onset_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.onset_intervals(records_of(spark, sf_dir), staged_of(spark, sf_dir)[2])


@query(with_roles(*_ALL) + _ONSET + " select patient_id, case when lo < hi then lo + greatest(1, datediff('day', lo, hi) // 2)::int else hi end as svd_event_date from iv")
def f10_allocated_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.allocate_onsets(experiments.onset_intervals(records_of(spark, sf_dir), staged_of(spark, sf_dir)[2]), "midpoint")


@query(with_roles(*_ALL) + _RECORDS + """ select r.patient_id, ref.date as origin, round(datediff('day', ref.date, t.death_date) / 365.25::double, 6) as t_death, round(datediff('day', ref.date, t.replacement_date) / 365.25::double, 6) as t_replacement, round(datediff('day', ref.date, r.svd_adjudicated_date) / 365.25::double, 6) as t_svd, round(datediff('day', ref.date, t.end_followup_date) / 365.25::double, 6) as t_end
  from records r join terminal t on t.patient_id = r.patient_id join ref on ref.patient_id = r.patient_id""")
def f13_study_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference = staged_of(spark, sf_dir)[2].select("patient_id", "ref_date").distinct()
    out = experiments.study_view(events_of(spark, sf_dir).join(reference, "patient_id"), F.col("ref_date"))
    return out.select("patient_id", "origin", *(r6(c) for c in ("t_death", "t_replacement", "t_svd", "t_end")))


@query(with_roles("surv") + " select row_id, least(case when pred <= 0.5 then pred end, case when pred2 <= 0.5 then pred2 end, 0.5::double) as time, case when pred <= 0.5 and pred <= coalesce(case when pred2 <= 0.5 then pred2 end, 9) then 1 when pred2 <= 0.5 then 2 else 0 end as event from surv")
def f14_competing_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = role(spark, sf_dir, "surv")
    return s.select("row_id", F.inline(F.array(survival.competing_frame({1: F.col("pred"), 2: F.col("pred2")}, F.lit(0.5)))))


@query(with_roles("studies", "terminal") + " select distinct patient_id, requested_at, prediction_date from (select t.patient_id, t.end_followup_date as requested_at, s.date as prediction_date from terminal t join studies s on s.patient_id = t.patient_id and s.date <= t.end_followup_date union all select patient_id, end_followup_date, end_followup_date from terminal)")
def e11_trajectory_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = role(spark, sf_dir, "terminal").select("patient_id", F.col("end_followup_date").alias("prediction_date"))
    return experiments.trajectory(role(spark, sf_dir, "studies"), requests)


@query(with_roles("surv", "terminal") + " select s.row_id, s.patient_id, s.pred, t.death_date from surv s join terminal t on s.patient_id = t.patient_id")
def c8_keyed_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = role(spark, sf_dir, "surv"), role(spark, sf_dir, "terminal")
    pairs = s.join(t, "patient_id")
    left = pairs.select("row_id", "patient_id", "pred", "event")
    return experiments.pair_tables({"predictions": left, "outcomes": pairs.select("row_id", "event", "death_date")}, ["row_id"], ["event"]).select("row_id", "patient_id", "pred", "death_date")


@query(with_roles("surv") + " select row_id from surv where row_id % 3 > 0 and row_id % 5 > 0")
def c11_common_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = role(spark, sf_dir, "surv")
    status = lambda k: s.select("row_id", F.when(F.col("row_id") % k > 0, "").otherwise("insufficient_events").alias("status"))
    return experiments.common_rows([status(3), status(5)], ["row_id"])


@query(with_roles("surv") + " select row_id, case when row_id % 11 = 0 then 'comparison_incomplete_model_unavailable' when row_id % 5 = 0 then 'comparison_incomplete_comparator_unavailable' when row_id % 3 = 0 and pred >= 0.5 then 'both_flagged' when row_id % 3 = 0 then 'rule_positive_model_not_flagged' when pred >= 0.5 then 'rule_negative_model_flagged' else 'neither_flagged' end as category from surv")
def b16_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("row_id")
    status = F.when(k % 5 == 0, "indeterminate").when(k % 3 == 0, "positive").otherwise("negative")
    return role(spark, sf_dir, "surv").select("row_id", rules.agreement(status, F.col("pred") >= 0.5, k % 11 > 0).alias("category"))


@query(with_roles("surv") + " select row_id, case when route = 'TAVR' then 12.0::double when valve_age_years >= 10 then 12.0::double when valve_age_years < 5 then greatest((5 - valve_age_years) * 12 + 12, 1) else greatest((10 - valve_age_years) * 12 + 12, 1) end as months from surv")
def b11_guideline_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role(spark, sf_dir, "surv").select("row_id", rules.guideline_interval("ACC_AHA", F.col("route"), F.col("valve_age_years")).alias("months"))


@query(with_roles("exposures") + " select seq, case when year(start_date) between 2006 and 2012 then '2006-2012' when year(start_date) between 2013 and 2017 then '2013-2017' when year(start_date) between 2018 and 2022 then '2018-2022' else 'outside' end as era from exposures")
def b8_era(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role(spark, sf_dir, "exposures").select("seq", rules.era(F.year("start_date")).alias("era"))


_CELLS = ", ".join([
    *(f"cast({c} as string)" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")),
    *(f"cast(cast(round({c} * 1000000) as bigint) as string)" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
    "l_returnflag", "l_linestatus", "cast(epoch_ms(l_shipdate) as string)",
])


@query(f"select count(*) as n, bit_xor(('0x' || substr(md5(concat_ws('|', {_CELLS})), 1, 15))::bigint) as hash from lineitem")
def a_table_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_hash(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


_POLICY_DATES = {
    "primary": ("case when svd_first_unresolved_date is null or svd_first_unresolved_date >= svd_adjudicated_date then svd_adjudicated_date end", "case when svd_adjudicated_date is null or svd_first_unresolved_date < svd_adjudicated_date then svd_first_unresolved_date end"),
    "sens_uncertain_positive": ("least(svd_adjudicated_date, svd_first_unresolved_date)", "null::date"), "sens_uncertain_negative": ("svd_adjudicated_date", "null::date"), "legacy_single_study": ("svd_first_positive_date", "null::date"),
}


def _policy_ctes() -> str:
    """The outcome tables under every label policy, each under names of its own."""
    names = re.compile(r"\b(elig|reasons|lm|first_ev|coded|outcomes)\b")
    return "".join(names.sub(rf"\1_{p}", _elig_sql(*dates)) for p, dates in _POLICY_DATES.items())


@query(with_roles(*_ALL) + _RECORDS + _policy_ctes() + " union all ".join(
    f" select p.route, count(distinct o.patient_id) as patients, count(*) as rows, count(distinct o.patient_id) filter (where event = 1) as svd_patients, count(distinct o.patient_id) filter (where event = 2) as death_patients, count(distinct o.patient_id) filter (where event = 3) as replacement_patients, '{policy}' as policy from outcomes_{policy} o join patients p on p.patient_id = o.patient_id group by p.route"
    for policy in _POLICY_DATES
))
def d20_label_policy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    patients, studies, staged = written_staged_of(spark, sf_dir)
    events = events_of(spark, sf_dir, staged)
    args = (patients, studies, role(spark, sf_dir, "labs"), role(spark, sf_dir, "exposures"), events)
    return experiments.policy_report({p: landmark.build_landmarks(*args, label_policy=p, with_features=False, staged=staged) for p in adj.LABEL_POLICIES})


@query()
def i13_visit_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = role(spark, sf_dir, "surv").join(role(spark, sf_dir, "studies").select(F.col("seq").alias("row_id"), F.col("date").alias("landmark_date")), "row_id")
    return experiments.visit_weights(rows, ["pred", "valve_age_years"]).select("row_id", "gap", "visit", "visit_weight")


@query()
def l4_out_of_fold_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two model steps over three patient folds, then Brier and AUC per step and horizon."""
    rows = role(spark, sf_dir, "surv")
    grid = [0.25 * k for k in range(0, 25)]
    causes = {"svd": 1, "death": 2}
    predictions = {name: experiments.out_of_fold(rows, cols, 3, [1.0, 3.0], causes, grid) for name, cols in (("age", ["valve_age_years"]), ("age_and_score", ["valve_age_years", "pred"]))}
    return experiments.evaluate_ladder(rows, predictions, [1.0, 3.0])


@query(with_roles("surv") + " select 'svd' as cause, quantile_cont(n, 0.1) as observed_p10, cast(ceil(2500 * 30 * 1.25 / quantile_cont(n, 0.1) / 100) * 100 as bigint) as required_patients from (select valve_age_years, count(distinct patient_id) filter (where event = 1) as n from surv group by 1)")
def d21_required_sample_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = aggregates.event_support(role(spark, sf_dir, "surv"), ["valve_age_years"]).filter("cause = 'svd'")
    return aggregates.required_sample_size(folds, 30, 2500)


@query(with_roles("surv") + """, ok as (select route from surv group by route having count(distinct patient_id) filter (where event = 1) >= 20)
select route, count(*) filter (where valve_age_years <= 6) as n_train, count(*) filter (where valve_age_years > 6) as n_test from surv where route in (select route from ok) group by route""")
def l2_held_out_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = role(spark, sf_dir, "surv")
    train, test = resample.temporal_split(rows, F.col("valve_age_years"), 6)
    levels = resample.leave_one_level_out(rows, "route", 20)
    return train.filter(F.col("route").isin(*levels)).groupBy("route").agg(F.count("*").alias("n_train")).join(test.groupBy("route").agg(F.count("*").alias("n_test")), "route")
