"""Queries over the cohort roles: staging, adjudication, landmarks, as-of features, survival curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions import rules
from timberline.operators import adjudicate as adj
from timberline.operators import asof, landmark, survival
from timberline.operators.staging import stage
from timberline.plans.bindings import role, with_roles
from timberline.plans.registry import query, r6

_REF = """,
ref as (
  select * from (
    select s.*, row_number() over (partition by s.patient_id order by s.date, s.seq) as rn
    from studies s join patients p on s.patient_id = p.patient_id
    where datediff('day', p.implant_date, s.date) between 30 and 180 and s.mean_gradient is not null and (s.eoa is not null or s.dvi is not null)
  ) where rn = 1
)"""
_STAGED = (
    _REF
    + """,
falls as (
  select s.*, r.date as ref_date, r.seq as ref_seq, r.mean_gradient as rg, r.eoa as re, r.dvi as rd, r.ar as rar, r.lvef as rl, r.svi as rs,
         s.mean_gradient - r.mean_gradient as rise, r.eoa - s.eoa as ef, 100 * (r.eoa - s.eoa) / r.eoa as ep, r.dvi - s.dvi as df, 100 * (r.dvi - s.dvi) / r.dvi as dp,
         coalesce(s.ar >= 2, false) and not coalesce(r.ar >= 2, false) as new2, coalesce(s.ar >= 3, false) and not coalesce(r.ar >= 3, false) as new3
  from studies s join ref r on s.patient_id = r.patient_id
),
staged as (
  select *, case when mean_gradient is null or rg is null then 'uncertain'
    when (eoa is null and dvi is null) or (re is null and rd is null) then 'uncertain'
    when new3 then '3'
    when rise >= 20 and mean_gradient >= 30 and (coalesce(ef >= 0.6::double, false) or coalesce(ep >= 50, false) or coalesce(df >= 0.2::double, false) or coalesce(dp >= 40, false)) then '3'
    when new2 then '2'
    when rise >= 10 and mean_gradient >= 20 and (coalesce(ef >= 0.3::double, false) or coalesce(ep >= 25, false) or coalesce(df >= 0.1::double, false) or coalesce(dp >= 20, false)) then '2'
    when rise > 0 or coalesce(ef > 0, false) or coalesce(df > 0, false) or coalesce(ar > rar, false) then '1' else '0' end as stage
  from falls
)"""
)
_PHENOTYPE = "case when stage not in ('2', '3') then 'uncertain' when (new2 or new3) and rise >= 10 then 'mixed' when new2 or new3 then 'regurgitant' else 'stenotic' end"
_RECORDS = (
    _STAGED
    + f""",
wins as (
  select distinct e.patient_id, e.start_date - 90 as ws, coalesce(e.stop_date, e.start_date + 365) as we from exposures e
  where e.indication = 'suspected_valve_thrombosis' and exists (select 1 from staged s where s.patient_id = e.patient_id and s.date >= e.start_date and s.stage in ('0', '1'))
),
cand as (
  select s.*, {_PHENOTYPE} as phenotype,
    exists (select 1 from wins w where w.patient_id = s.patient_id and s.date between w.ws and w.we) as thrombotic,
    (select min({{'d': n.date, 's': n.seq, 'stage': n.stage}}) from staged n where n.patient_id = s.patient_id and n.date > s.date and n.date > n.ref_date and n.stage <> 'uncertain') as nxt,
    exists (select 1 from mechanism m where m.patient_id = s.patient_id and m.type = 'endocarditis' and abs(datediff('day', m.date, s.date)) <= 90) as endo,
    exists (select 1 from mechanism m where m.patient_id = s.patient_id and m.type = 'thrombosis' and abs(datediff('day', m.date, s.date)) <= 90) as thr,
    least(case when t.death_date > s.date then t.death_date end, case when t.replacement_date > s.date then t.replacement_date end) as term
  from staged s left join terminal t on s.patient_id = t.patient_id where s.date > s.ref_date and s.stage in ('2', '3')
),
judged as (
  select *, not thrombotic and coalesce(nxt.stage in ('0', '1'), false) as transient,
    coalesce(datediff('day', date, term) <= 455, false) as by_end, case when endo then 'endocarditis' when thr then 'uncertain' else 'svd' end as mech
  from cand
),
firsts as (select patient_id, min({{'d': date, 's': seq}}) as f from judged where not thrombotic and not transient group by patient_id),
won as (select j.* from judged j join firsts f on j.patient_id = f.patient_id and j.date = f.f.d and j.seq = f.f.s),
aside as (
  select j.patient_id, count(*) filter (where transient) as n_uncertain, count(*) filter (where thrombotic) as n_thrombotic, min(date) filter (where transient) as first_uncertain
  from judged j left join firsts f on j.patient_id = f.patient_id where f.f is null or {{'d': j.date, 's': j.seq}} < f.f group by j.patient_id
),
any_cand as (select distinct patient_id from judged),
records as (
  select p.patient_id,
    case when r.patient_id is null then 'no_reference' when c.patient_id is null then 'no_candidate'
      when w.patient_id is not null then case when w.nxt is not null then 'confirmed' when w.by_end then 'confirmed_by_terminal_event' else 'unconfirmed_pending' end
      when coalesce(a.n_uncertain, 0) > 0 then 'uncertain_transient' else 'thrombosis_attributed' end as svd_status,
    w.date as svd_candidate_date, case when w.nxt is not null then w.nxt.d when w.by_end then w.term end as svd_confirmation_date,
    case when w.mech = 'svd' and (w.nxt is not null or w.by_end) then w.date end as svd_adjudicated_date,
    coalesce(w.mech, 'uncertain') as svd_mechanism,
    case when w.mech = 'svd' then case when w.nxt is not null or w.by_end then 'high' else 'moderate' end else 'low' end as svd_confidence,
    w.stage as svd_stage, w.phenotype as svd_phenotype, coalesce(a.n_uncertain, 0) as n_uncertain, coalesce(a.n_thrombotic, 0) as n_thrombotic,
    least(a.first_uncertain, case when not (w.mech = 'svd' and (w.nxt is not null or w.by_end)) then w.date end) as svd_first_unresolved_date,
    (select min(j.date) from judged j where j.patient_id = p.patient_id) as svd_first_positive_date
  from patients p left join ref r on p.patient_id = r.patient_id left join any_cand c on p.patient_id = c.patient_id
  left join won w on p.patient_id = w.patient_id left join aside a on p.patient_id = a.patient_id
)"""
)
_ALL = ("patients", "studies", "exposures", "terminal", "mechanism")


def _elig_sql(svd: str, censor: str) -> str:
    return f""",
elig as (
  select r.patient_id, {svd} as svd, {censor} as cens, t.death_date, t.replacement_date, t.end_followup_date as end_date, t.first_thrombosis_date, ref.date as ref_date
  from records r join terminal t on r.patient_id = t.patient_id left join ref on r.patient_id = ref.patient_id
),
reasons as (
  select *, case when ref_date is null then 'no_reference' when svd <= ref_date then 'endpoint_at_or_before_reference' when cens <= ref_date then 'unresolved_candidate_at_or_before_reference'
    when coalesce(death_date <= ref_date, false) or coalesce(replacement_date <= ref_date, false) then 'death_or_replacement_at_or_before_reference'
    when end_date <= ref_date then 'followup_end_at_or_before_reference' end as reason, least(svd, cens, death_date, replacement_date, end_date) as stop
  from elig
),
lm as (
  select s.*, e.svd, e.cens, e.death_date, e.replacement_date, e.end_date, e.first_thrombosis_date, e.stop from staged s join reasons e on s.patient_id = e.patient_id
  where e.reason is null and s.date >= s.ref_date and s.date < e.stop
  qualify row_number() over (partition by s.patient_id, s.date order by s.seq desc) = 1
),
first_ev as (
  select *, case when svd > date and svd <= least(end_date, cens) then svd end as d1, case when death_date > date and death_date <= least(end_date, cens) then death_date end as d2,
    case when replacement_date > date and replacement_date <= least(end_date, cens) then replacement_date end as d3 from lm
),
coded as (
  select *, coalesce(least(d1, d2, d3), least(end_date, cens)) as last, case when d1 = least(d1, d2, d3) then 1 when d2 = least(d1, d2, d3) then 2 when d3 = least(d1, d2, d3) then 3 else 0 end as code from first_ev
),
outcomes as (
  select *, greatest(least(datediff('day', date, last) / 365.25::double, 5.0::double), 0.001::double) as time, case when datediff('day', date, last) / 365.25 > 5 then 0 else code end as event from coded
)"""


_PRIMARY = _elig_sql(
    "case when svd_first_unresolved_date is null or svd_first_unresolved_date >= svd_adjudicated_date then svd_adjudicated_date end",
    "case when svd_adjudicated_date is null or svd_first_unresolved_date < svd_adjudicated_date then svd_first_unresolved_date end",
)


def roles(spark: SparkSession, sf_dir: str, *names: str) -> tuple[DataFrame, ...]:
    return tuple(role(spark, sf_dir, n) for n in names)


def staged_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    patients, studies = roles(spark, sf_dir, "patients", "studies")
    reference = asof.select_reference(studies, patients)
    return patients, studies, adj.staged_studies(studies, reference)


def written_staged_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As :func:`staged_of`, with the staged studies written out for the several passes of adjudication and landmarks."""
    patients, studies, staged = staged_of(spark, sf_dir)
    return patients, studies, stage(staged, "staged")


def records_of(spark: SparkSession, sf_dir: str, staged: DataFrame | None = None) -> DataFrame:
    patients = role(spark, sf_dir, "patients")
    staged = written_staged_of(spark, sf_dir)[2] if staged is None else staged
    exposures, mechanism, terminal = roles(spark, sf_dir, "exposures", "mechanism", "terminal")
    return adj.adjudicate(patients, staged, adj.thrombosis_windows(exposures, staged), mechanism, terminal)


def events_of(spark: SparkSession, sf_dir: str, staged: DataFrame | None = None) -> DataFrame:
    """The events table: the adjudication record, the first single positive study and the terminal dates."""
    staged = written_staged_of(spark, sf_dir)[2] if staged is None else staged
    first = adj.candidate_flags(staged).groupBy("patient_id").agg(F.min("date").alias("svd_first_positive_date"))
    events = records_of(spark, sf_dir, staged).join(first, "patient_id", "left").join(role(spark, sf_dir, "terminal"), "patient_id")
    return stage(events, "events")


def landmarks_of(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    patients, studies, staged = written_staged_of(spark, sf_dir)
    labs, exposures, history = roles(spark, sf_dir, "labs", "exposures", "history")
    return landmark.build_landmarks(patients, studies, labs, exposures, events_of(spark, sf_dir, staged), staged=staged, history=history, **options)


@query(with_roles("patients", "studies") + _REF + " select patient_id, date as ref_date, seq as ref_seq, mean_gradient as ref_mean_gradient, eoa as ref_eoa, dvi as ref_dvi from ref")
def c1_reference_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    patients, studies = roles(spark, sf_dir, "patients", "studies")
    return asof.select_reference(studies, patients).select("patient_id", "ref_date", "ref_seq", "ref_mean_gradient", "ref_eoa", "ref_dvi")


@query(with_roles("patients", "studies") + _STAGED + f" select patient_id, date, seq, stage, {_PHENOTYPE} as phenotype from staged")
def b2_b3_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged_of(spark, sf_dir)[2].select("patient_id", "date", "seq", F.col("staged.stage").alias("stage"), "phenotype")


@query(with_roles("patients", "studies") + _STAGED + " select patient_id, date, seq, case when seq = ref_seq then 'reference' when date <= ref_date then 'before_time_zero' else 'stage_' || stage end as note from staged")
def e12_staging_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landmark.timeline(*roles(spark, sf_dir, "patients", "studies"))


@query(with_roles("patients", "studies") + _STAGED + f" select patient_id, date, seq, stage, {_PHENOTYPE} as phenotype from staged where date > ref_date and stage in ('2', '3')")
def f1_candidate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adj.candidate_flags(staged_of(spark, sf_dir)[2]).select("patient_id", "date", "seq", F.col("staged.stage").alias("stage"), "phenotype")


@query(with_roles("patients", "studies", "exposures") + _STAGED + """ select distinct e.patient_id, e.start_date - 90 as win_start, coalesce(e.stop_date, e.start_date + 365) as win_end from exposures e
  where e.indication = 'suspected_valve_thrombosis' and exists (select 1 from staged s where s.patient_id = e.patient_id and s.date >= e.start_date and s.stage in ('0', '1'))""")
def f2_thrombosis_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adj.thrombosis_windows(role(spark, sf_dir, "exposures"), staged_of(spark, sf_dir)[2]).distinct()


_RECORD_COLUMNS = "patient_id, svd_status, svd_candidate_date, svd_confirmation_date, svd_adjudicated_date, svd_mechanism, svd_confidence, svd_stage, svd_phenotype, n_uncertain, n_thrombotic, svd_first_unresolved_date"


@query(with_roles(*_ALL) + _RECORDS + f" select {_RECORD_COLUMNS} from records")
def f3_f4_series_adjudication(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = records_of(spark, sf_dir).withColumn("n_uncertain", F.size("svd_uncertain_dates").cast("long")).withColumn("n_thrombotic", F.size("svd_thrombosis_attributed_dates").cast("long"))
    return out.select(*_RECORD_COLUMNS.split(", "))


@query(with_roles(*_ALL) + _RECORDS + " select patient_id, svd_candidate_date is not null and svd_mechanism = 'svd' as met, case when svd_mechanism = 'svd' then svd_candidate_date end as endpoint_date, svd_confidence from records")
def f5_endpoint_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adj.endpoint_decision(records_of(spark, sf_dir)).select("patient_id", "met", "endpoint_date", "svd_confidence")


_POLICY_SQL = " union all ".join(
    f"select '{p}' as policy, patient_id, {s} as svd_date, {c} as censor_date from records"
    for p, s, c in (
        ("primary", "case when svd_first_unresolved_date is null or svd_first_unresolved_date >= svd_adjudicated_date then svd_adjudicated_date end", "case when svd_adjudicated_date is null or svd_first_unresolved_date < svd_adjudicated_date then svd_first_unresolved_date end"),
        ("sens_uncertain_positive", "least(svd_adjudicated_date, svd_first_unresolved_date)", "null::date"),
        ("sens_uncertain_negative", "svd_adjudicated_date", "null::date"),
        ("legacy_single_study", "svd_first_positive_date", "null::date"),
    )
)


@query(with_roles(*_ALL) + _RECORDS + " " + _POLICY_SQL)
def f6_label_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events_of(spark, sf_dir)
    parts = []
    for p in adj.LABEL_POLICIES:
        svd, censor = adj.label_dates(p)
        parts.append(F.struct(F.lit(p).alias("policy"), svd.alias("svd_date"), censor.alias("censor_date")))
    return e.select("patient_id", F.inline(F.array(*parts))).select("policy", "patient_id", "svd_date", "censor_date")


@query(with_roles(*_ALL) + _RECORDS + _PRIMARY + """, all_reasons as (
  select p.patient_id, coalesce(r.reason, case when not exists (select 1 from lm where lm.patient_id = p.patient_id) then 'no_eligible_landmark' end) as reason
  from patients p join reasons r on p.patient_id = r.patient_id)
select n.reason, count(a.patient_id) as n_patients from (select unnest(['no_events_row', 'no_echo', 'no_reference', 'endpoint_at_or_before_reference', 'unresolved_candidate_at_or_before_reference',
  'death_or_replacement_at_or_before_reference', 'followup_end_at_or_before_reference', 'no_eligible_landmark']) as reason) n left join all_reasons a on a.reason = n.reason group by n.reason""")
def c7_exclusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landmark.exclusions(*roles(spark, sf_dir, "patients", "studies"), events_of(spark, sf_dir))


@query(with_roles(*_ALL) + _RECORDS + _PRIMARY + """, thr as (
  select *, first_thrombosis_date > date and first_thrombosis_date <= end_date as seen from outcomes)
select patient_id, date as landmark_date, round(time, 6) as time, event,
  round(case when seen then least(greatest(datediff('day', date, first_thrombosis_date) / 365.25::double, 0.001::double), 5.0::double) else least(greatest(datediff('day', date, end_date) / 365.25::double, 0.001::double), 5.0::double) end, 6) as time_thromb,
  case when coalesce(seen and datediff('day', date, first_thrombosis_date) / 365.25 <= 5, false) then 1 else 0 end as event_thromb,
  round(1.0::double / count(*) over (partition by patient_id), 6) as weight from thr""")
def f7_f8_landmark_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = landmarks_of(spark, sf_dir, with_features=False)
    return rows.select("patient_id", "landmark_date", r6("time"), "event", r6("time_thromb"), "event_thromb", r6("row_weight_patient_balanced", "weight"))


@query(with_roles(*_ALL) + _RECORDS + _PRIMARY + """, hist as (
  select l.patient_id, l.date, count(*) as n_echoes, count(s.mean_gradient) as ng, max(case when s.mean_gradient is not null then s.date end) as hi, min(case when s.mean_gradient is not null then s.date end) as lo,
    regr_slope(s.mean_gradient, datediff('day', date '1970-01-01', s.date) / 365.25::double) as slope from outcomes l join studies s on s.patient_id = l.patient_id and s.date <= l.date group by l.patient_id, l.date
), prev as (select patient_id, date, seq, lag(mean_gradient) over w as pg, lag(date) over w as pd from studies window w as (partition by patient_id order by date, seq))
select l.patient_id, l.date as landmark_date, l.rg as ref_gradient, l.mean_gradient as current_gradient, l.mean_gradient - l.rg as delta_gradient, round(l.eoa - l.re, 6) as delta_eoa, round(l.dvi - l.rd, 6) as delta_dvi, l.ar - l.rar as delta_ar,
  l.mean_gradient - p.pg as last_change_gradient, round(datediff('day', p.pd, l.date) / 365.25::double, 6) as last_change_interval_years, h.n_echoes,
  case when l.date > l.ref_date then l.stage else '0' end as current_stage, round(case when h.ng >= 3 and h.hi > h.lo then h.slope end, 4) as gradient_slope
from outcomes l join hist h on h.patient_id = l.patient_id and h.date = l.date join prev p on p.patient_id = l.patient_id and p.date = l.date and p.seq = l.seq""")
def e1_e2_series_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = landmarks_of(spark, sf_dir, with_features=False)
    return rows.select("patient_id", "landmark_date", "ref_gradient", "current_gradient", "delta_gradient", r6("delta_eoa"), r6("delta_dvi"), "delta_ar", "last_change_gradient", r6("last_change_interval_years"), "n_echoes", "current_stage", F.round("gradient_slope", 4).alias("gradient_slope"))


_LAB_SQL = ", ".join(f"(select max_by(value, {{'d': date, 's': seq}}) from labs l where l.patient_id = s.patient_id and l.date <= s.date and analyte = '{a}') as {a}" for a in landmark.LAB_ANALYTES)


@query(with_roles("studies", "labs") + f" select s.patient_id, s.date as landmark_date, {_LAB_SQL} from (select distinct patient_id, date from studies) s")
def c2_latest_lab_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    studies, labs = roles(spark, sf_dir, "studies", "labs")
    points = studies.select("patient_id", F.col("date").alias("landmark_date")).distinct()
    return asof.latest_as_of(points, labs, list(landmark.LAB_ANALYTES)).select("patient_id", "landmark_date", *landmark.LAB_ANALYTES)


@query(with_roles("studies", "labs") + """, x as (select s.patient_id, s.date as landmark_date, max_by({'v': value, 'd': l.date}, {'d': l.date, 's': l.seq}) as m from (select distinct patient_id, date from studies) s
  left join labs l on l.patient_id = s.patient_id and l.date <= s.date and analyte = 'ldh' group by all)
select patient_id, landmark_date, case when m.v > 0 then m.v end as raw, round(case when m.v > 0 and datediff('day', m.d, landmark_date) / 365.25::double * 12 <= 12 then ln(m.v) end, 6) as log_value,
  case when m.v > 0 then datediff('day', m.d, landmark_date) / 365.25::double * 12 > 12 end as stale from x""")
def c3_carry_forward_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    studies, labs = roles(spark, sf_dir, "studies", "labs")
    points = studies.select("patient_id", F.col("date").alias("landmark_date")).distinct()
    out = asof.latest_as_of(points, labs, ["ldh"]).withColumn("m", asof.carry_forward(F.col("ldh"), F.col("ldh_day"), F.col("landmark_date")))
    return out.select("patient_id", "landmark_date", "m.raw", r6(F.col("m.log_value"), "log_value"), "m.stale")


@query(with_roles("studies", "labs") + """ select s.patient_id, s.date as landmark_date, round(case when count(value) >= 2 and datediff('day', min(l.date), max(l.date)) / 365.25 >= 0.5 then regr_slope(value, datediff('day', date '1970-01-01', l.date) / 365.25::double) end, 4) as egfr_slope
  from (select distinct patient_id, date from studies) s left join labs l on l.patient_id = s.patient_id and l.date <= s.date and analyte = 'egfr' group by all""")
def e3_lab_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    studies, labs = roles(spark, sf_dir, "studies", "labs")
    points = studies.select("patient_id", F.col("date").alias("landmark_date")).distinct()
    return asof.slope_as_of(points, labs, "egfr", "egfr_slope").select("patient_id", "landmark_date", F.round("egfr_slope", 4).alias("egfr_slope"))


@query(with_roles("studies", "exposures") + """, j as (
  select s.patient_id, s.date as lm, e.*, e.start_date <= s.date as st, e.stop_date is null or e.stop_date > s.date as cur, e.class in ('VKA', 'FXa', 'DTI') as oac, e.class in ('SAPT', 'DAPT') as ap,
    greatest(datediff('day', e.start_date, least(coalesce(e.stop_date, s.date), s.date)) / 365.25::double, 0) as lived,
    least(datediff('day', e.start_date, s.date), case when e.stop_date <= s.date then datediff('day', e.stop_date, s.date) end) as ch
  from (select distinct patient_id, date from studies) s left join exposures e on e.patient_id = s.patient_id)
select patient_id, lm as landmark_date, case when count(class) > 0 then coalesce(min_by(class, seq) filter (where st and cur and oac), case when bool_or(st and cur and class = 'DAPT') then 'DAPT' when bool_or(st and cur and ap) then 'SAPT' else 'none' end) end as ac_class_current,
  case when count(class) > 0 then coalesce(min_by(indication, seq) filter (where st and cur and oac), 'none') end as ac_indication,
  case when count(class) > 0 then case when bool_or(st and cur and oac) then 'current' when bool_or(st and oac) then 'past' else 'never' end end as ac_current_status,
  case when count(class) > 0 then round(coalesce(sum(lived) filter (where st and class = 'VKA'), 0), 3) end as ac_cum_vka_years, case when count(class) > 0 then round(coalesce(sum(lived) filter (where st and oac), 0), 3) end as ac_cum_oac_years,
  cast(min(ch) filter (where st) as double) as ac_days_since_change, case when count(class) > 0 then coalesce(bool_or(st and oac and post_suspicion), false) end as ac_post_suspicion, case when count(class) > 0 then coalesce(bool_or(st and cur and ap), false) end as on_antiplatelet
from j group by patient_id, lm""")
def c4_d8_exposures_at_landmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    studies, exposures = roles(spark, sf_dir, "studies", "exposures")
    return asof.exposure_features(studies.select("patient_id", F.col("date").alias("landmark_date")).distinct(), exposures)


_F9 = (
    with_roles(*_ALL, "labs")
    + _RECORDS
    + _PRIMARY
    + """, hist as (
  select l.patient_id, l.date, count(*) as n_echoes, count(s.mean_gradient) as ng, max(case when s.mean_gradient is not null then s.date end) as hi, min(case when s.mean_gradient is not null then s.date end) as lo,
    regr_slope(s.mean_gradient, datediff('day', date '1970-01-01', s.date) / 365.25::double) as slope from outcomes l join studies s on s.patient_id = l.patient_id and s.date <= l.date group by l.patient_id, l.date
), prev as (select patient_id, date, seq, lag(mean_gradient) over w as pg, lag(date) over w as pd from studies window w as (partition by patient_id order by date, seq)),
lab as (select s.patient_id, s.date, max_by(value, {'d': l.date, 's': l.seq}) filter (where analyte = 'egfr') as egfr, max_by(value, {'d': l.date, 's': l.seq}) filter (where analyte = 'hb') as hb, max_by(value, {'d': l.date, 's': l.seq}) filter (where analyte = 'ldh') as ldh,
  case when count(value) filter (where analyte = 'egfr') >= 2 and datediff('day', min(l.date) filter (where analyte = 'egfr'), max(l.date) filter (where analyte = 'egfr')) / 365.25 >= 0.5 then regr_slope(value, datediff('day', date '1970-01-01', l.date) / 365.25::double) filter (where analyte = 'egfr') end as egfr_slope
  from outcomes s join labs l on l.patient_id = s.patient_id and l.date <= s.date group by s.patient_id, s.date),
j as (
  select s.patient_id, s.date as lm, e.*, e.start_date <= s.date as st, e.stop_date is null or e.stop_date > s.date as cur, e.class in ('VKA', 'FXa', 'DTI') as oac, e.class in ('SAPT', 'DAPT') as ap,
    greatest(datediff('day', e.start_date, least(coalesce(e.stop_date, s.date), s.date)) / 365.25::double, 0) as lived, least(datediff('day', e.start_date, s.date), case when e.stop_date <= s.date then datediff('day', e.stop_date, s.date) end) as ch
  from outcomes s join exposures e on e.patient_id = s.patient_id),
ac as (select patient_id, lm as date, coalesce(min_by(class, seq) filter (where st and cur and oac), case when bool_or(st and cur and class = 'DAPT') then 'DAPT' when bool_or(st and cur and ap) then 'SAPT' else 'none' end) as ac_class_current,
  coalesce(min_by(indication, seq) filter (where st and cur and oac), 'none') as ac_indication, case when bool_or(st and cur and oac) then 'current' when bool_or(st and oac) then 'past' else 'never' end as ac_current_status,
  round(coalesce(sum(lived) filter (where st and class = 'VKA'), 0), 3) as ac_cum_vka_years, round(coalesce(sum(lived) filter (where st and oac), 0), 3) as ac_cum_oac_years, cast(min(ch) filter (where st) as double) as ac_days_since_change,
  coalesce(bool_or(st and oac and post_suspicion), false) as ac_post_suspicion, coalesce(bool_or(st and cur and ap), false) as on_antiplatelet from j group by patient_id, lm),
thr as (select *, coalesce(first_thrombosis_date > date and first_thrombosis_date <= end_date, false) as seen from outcomes)
select l.patient_id, l.date as landmark_date, l.rg as ref_gradient, l.re as ref_eoa, l.rd as ref_dvi, l.rar as ref_ar, l.rl as ref_lvef, l.rs as ref_svi, l.mean_gradient as current_gradient, l.eoa as current_eoa, l.dvi as current_dvi, l.ar as current_ar, l.lvef as current_lvef, l.svi as current_svi,
  l.mean_gradient - l.rg as delta_gradient, round(l.eoa - l.re, 6) as delta_eoa, round(l.dvi - l.rd, 6) as delta_dvi, l.ar - l.rar as delta_ar, l.mean_gradient - p.pg as last_change_gradient, round(datediff('day', p.pd, l.date) / 365.25::double, 6) as last_change_interval_years, h.n_echoes,
  0.0::double as time_since_last_echo_years, false as stale_echo, false as overdue_flag, case when l.date > l.ref_date then l.stage else '0' end as current_stage, cast(round(cast(case when h.ng >= 3 and h.hi > h.lo then h.slope end as decimal(30, 7)), 4) as double) as gradient_slope, round(l.time, 6) as time, l.event,
  round(case when seen then least(greatest(datediff('day', l.date, l.first_thrombosis_date) / 365.25::double, 0.001::double), 5.0::double) else least(greatest(datediff('day', l.date, l.end_date) / 365.25::double, 0.001::double), 5.0::double) end, 6) as time_thromb,
  case when seen and datediff('day', l.date, l.first_thrombosis_date) / 365.25 <= 5 then 1 else 0 end as event_thromb, round(datediff('day', l.ref_date, l.date) / 365.25::double, 6) as t_lm, pt.route, pt.design_class, pt.bsa, pt.age_at_implant, pt.bmi, pt.sex, pt.size_mm,
  round(l.re / pt.bsa, 6) as ieoa, case when l.re / pt.bsa > 0.85::double then 'none' when l.re / pt.bsa > 0.65::double then 'moderate' when l.re / pt.bsa is not null then 'severe' end as mismatch_grade, round(datediff('day', pt.implant_date, l.date) / 365.25::double, 6) as valve_age_years,
  b.egfr, b.hb, b.ldh, cast(round(cast(b.egfr_slope as decimal(30, 7)), 4) as double) as egfr_slope, ac.ac_class_current, ac.ac_indication, ac.ac_current_status, ac.ac_cum_vka_years, ac.ac_cum_oac_years, ac.ac_days_since_change, ac.ac_post_suspicion, ac.on_antiplatelet,
  round(1.0::double / count(*) over (partition by l.patient_id), 6) as row_weight_patient_balanced
from thr l join hist h on h.patient_id = l.patient_id and h.date = l.date join prev p on p.patient_id = l.patient_id and p.date = l.date and p.seq = l.seq join patients pt on pt.patient_id = l.patient_id
  left join lab b on b.patient_id = l.patient_id and b.date = l.date left join ac on ac.patient_id = l.patient_id and ac.date = l.date"""
)


@query(_F9)
def f9_landmark_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full landmark table: series, static, laboratory and exposure features, and both outcomes."""
    rows = landmarks_of(spark, sf_dir)
    slopes = ("gradient_slope", "egfr_slope")
    # what the SQL rounds; all else is whole numbers and tenths as read
    computed = ("delta_eoa", "delta_dvi", "last_change_interval_years", "time", "time_thromb", "t_lm", "ieoa", "valve_age_years", "row_weight_patient_balanced")
    # slopes are ratios of whole numbers of days and often halves of the last digit: what summing leaves in the far digits goes first
    plain = lambda c: F.round(F.col(c).cast("decimal(30,7)"), 4).cast("double").alias(c) if c in slopes else r6(c) if c in computed else F.col(c)
    return rows.select(*(plain(c) for c in rows.columns))


_AJ = """, tt as (select {g} as g, time, sum(count(*)) over (partition by {g} order by time desc) as n, count(*) filter (where event <> 0) as d, count(*) filter (where event = 1) as d1, count(*) filter (where event = 2) as d2, count(*) filter (where event = 3) as d3 from {t} group by {g}, time),
ev as (select *, product(1 - d::double / n) over (partition by g order by time) as s from tt where d > 0),
cv as (select *, coalesce(lag(s) over (partition by g order by time), 1) as sb from ev),
aj as (select g, time, s, sum(sb * d1 / n) over w as c1, sum(sb * d2 / n) over w as c2, sum(sb * d3 / n) over w as c3 from cv window w as (partition by g order by time)),
pts as (select g, h from (select distinct g from tt), (select unnest([1.0::double, 3.0::double, 5.0::double]) as h))
select pts.g as route, h as horizon, round(coalesce(max_by(s, time), 1), 6) as survival, round(coalesce(max(c1), 0), 6) as cif1, round(coalesce(max(c2), 0), 6) as cif2, round(coalesce(max(c3), 0), 6) as cif3
from pts left join aj on aj.g = pts.g and aj.time <= pts.h group by pts.g, h"""
HORIZONS = (1.0, 3.0, 5.0)


@query(with_roles("surv") + _AJ.format(g="route", t="surv"))
def i3_cumulative_incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = role(spark, sf_dir, "surv")
    out = survival.at_horizons(survival.aalen_johansen(rows, ["route"]), ["route"], HORIZONS, rows)
    return out.select("route", "horizon", r6("survival"), r6("cif1"), r6("cif2"), r6("cif3"))


@query(with_roles(*_ALL, "surv") + _RECORDS + _PRIMARY + ", lms as (select p.route, o.time, o.event from outcomes o join patients p on o.patient_id = p.patient_id)" + _AJ.format(g="route", t="lms"))
def flagship_incidence_from_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the five cohort roles to leakage-free landmarks to cumulative incidence per route at 1, 3 and 5 years."""
    rows = landmarks_of(spark, sf_dir, with_features=False).select("route", "time", "event")
    out = survival.at_horizons(survival.aalen_johansen(rows, ["route"]), ["route"], HORIZONS, rows)
    return out.select("route", "horizon", r6("survival"), r6("cif1"), r6("cif2"), r6("cif3"))


_KM = """, tt as (select route, time, sum(count(*)) over (partition by route order by time desc) as n, count(*) filter (where {e}) as d from surv group by route, time)
select route, time, cast(n as double) as at_risk, cast(d as double) as d, round(product(1 - d::double / n) over (partition by route order by time), 6) as survival from tt where d > 0"""


@query(with_roles("surv") + _KM.format(e="event <> 0"))
def i1_kaplan_meier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.kaplan_meier(role(spark, sf_dir, "surv"), ["route"]).withColumn("survival", r6("survival"))


@query(with_roles("surv") + _KM.format(e="event = 0"))
def i2_censoring_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.kaplan_meier(role(spark, sf_dir, "surv"), ["route"], of="c").withColumn("survival", r6("survival"))


@query(with_roles("surv") + """, tt as (select route, time, sum(sum(exp(pred))) over (partition by route order by time desc) as n, count(*) filter (where event = 1) as d from surv group by route, time)
select route, time, round(sum(d / n) over (partition by route order by time), 6) as cumulative_hazard from tt where d > 0""")
def i4_breslow_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = role(spark, sf_dir, "surv").withColumn("risk", F.exp("pred"))
    return survival.nelson_aalen(rows, ["route"], "risk", 1).withColumn("cumulative_hazard", r6("cumulative_hazard"))


@query(with_roles("surv") + " select route, coalesce((select time from surv s where s.route = g.route order by time desc limit 1 offset 29), 0) as support_time from (select distinct route from surv) g")
def e8_followup_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.followup_support(role(spark, sf_dir, "surv"), 30, ["route"])


_CONTEXT = """, cur as (select p.patient_id, p.pd, max_by({'d': s.date, 'g': s.mean_gradient, 'e': s.eoa, 'v': s.dvi, 'a': s.ar}, {'d': s.date, 's': s.seq}) as c from (select patient_id, end_followup_date - 400 as pd from terminal) p left join studies s on s.patient_id = p.patient_id and s.date <= p.pd group by all),
x as (select cur.patient_id, pd, c, r.date as rdate, datediff('day', c.d, pd) <= 548 as fresh, c.g - r.mean_gradient as rise, r.eoa - c.e as ef, 100 * (r.eoa - c.e) / r.eoa as ep, r.dvi - c.v as df, 100 * (r.dvi - c.v) / r.dvi as dp, r.ar as ra, c.a as ca from cur left join ref r on r.patient_id = cur.patient_id),
y as (select *, coalesce(c.d < rdate, false) or coalesce(rdate > pd, false) or not fresh as bad, rise >= 10 and c.g >= 20 and ((ef >= 0.3 - 1e-12 or ep >= 25 - 1e-10) or (df >= 0.1 - 1e-12 or dp >= 20 - 1e-10)) as s2, rise >= 20 and c.g >= 30 and ((ef >= 0.6 - 1e-12 or ep >= 50 - 1e-10) or (df >= 0.2 - 1e-12 or dp >= 40 - 1e-10)) as s3,
  case when ca is not null and ra is not null then ca >= 2 and ca - ra >= 1 end as a2, case when ca is not null and ra is not null then ca >= 3 and (ra = 0 or ca - ra >= 2) end as a3 from x),
z as (select *, s2 or a2 as m, s3 or a3 as v from y)
select patient_id, pd as prediction_date, case when rdate is null or c.d is null then null when bad then 'indeterminate' when coalesce(v, false) or coalesce(m, false) then 'positive' when m = false then 'negative' else 'indeterminate' end as status,
  case when rdate is null or c.d is null or bad then null when coalesce(v, false) then 3 when coalesce(m, false) then 2 end as stage from z"""


@query(with_roles("patients", "studies", "terminal") + _REF + _CONTEXT)
def b4_c15_comparator(spark: SparkSession, sf_dir: str) -> DataFrame:
    patients, studies, terminal = roles(spark, sf_dir, "patients", "studies", "terminal")
    requests = terminal.select("patient_id", F.date_sub("end_followup_date", 400).alias("prediction_date"))
    out = asof.comparator_pairs(studies, patients, requests)
    return out.select("patient_id", "prediction_date", "verdict.status", "verdict.stage")


@query(with_roles(*_ALL) + _RECORDS + """, o as (select patient_id, svd_status, svd_confidence from records) select svd_status, svd_confidence, count(*) as n, case when count(*) > 0 and count(*) < 5 then '<5' else cast(count(*) as varchar) end as shown from o group by all""")
def d1_b10_suppressed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records_of(spark, sf_dir).groupBy("svd_status", "svd_confidence").agg(F.count("*").alias("n")).withColumn("shown", rules.suppress(F.col("n")))


@query(with_roles("patients", "studies") + _REF + """, x as (select p.patient_id, r.eoa / p.bsa as ieoa from patients p join ref r on r.patient_id = p.patient_id) select patient_id, round(ieoa, 6) as ieoa, case when ieoa > 0.85::double then 'none' when ieoa > 0.65::double then 'moderate' when ieoa is not null then 'severe' end as mismatch_grade from x""")
def b6_b19_mismatch_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    patients, studies = roles(spark, sf_dir, "patients", "studies")
    out = patients.join(asof.select_reference(studies, patients), "patient_id").withColumn("x", F.col("ref_eoa") / F.col("bsa"))
    return out.select("patient_id", r6("x", "ieoa"), rules.mismatch_grade(F.col("x")).alias("mismatch_grade"))


@query(with_roles("studies") + """, recursive_days as (select patient_id, list_sort(list(distinct date)) as ds from studies group by patient_id),
folded as (select patient_id, list_reduce(list_transform(ds, lambda d: [d]), lambda acc, d: case when datediff('day', acc[len(acc)], d[1]) >= 90 then list_append(acc, d[1]) else acc end) as kept from recursive_days)
select patient_id, unnest(kept) as landmark_date from folded""")
def e4_landmark_thinning(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = role(spark, sf_dir, "studies").select("patient_id", F.col("date").alias("landmark_date")).distinct()
    return landmark.thin(days, 90)
