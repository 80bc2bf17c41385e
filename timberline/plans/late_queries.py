"""Queries of the late operators: boosting, offset models, calibration curves, subgroup and family comparison, what-if scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timberline.functions import rules
from timberline.operators import boost, boosted, cox, experiments, grid, landmark, metrics, profile, survival
from timberline.operators.staging import quantile_table, stage, stage_path
from timberline.plans.bindings import ROLES, role, with_roles
from timberline.plans.cohort_queries import _ALL, _RECORDS, _STAGED, _elig_sql, events_of, landmarks_of, staged_of, written_staged_of
from timberline.plans.model_queries import _DRAWS, _G, _RANKS, _W, TAU, scored
from timberline.plans.registry import query, r6


@query()
def i9_i10_boosted_hazards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten boosting rounds of the first cause; scores after five and ten trees."""
    rows = role(spark, sf_dir, "surv")
    model = boost.BoostedCox(["pred", "pred2", "valve_age_years"], trees=10).fit(rows, F.col("event") == 1, every=5)
    return model.staged(rows, [5, 10]).select("row_id", "score_5", "score_10")


def boosted_model(spark: SparkSession, sf_dir: str, trees: int = 300, **options) -> boosted.BoostedHazards:
    """All causes and routes, trees of depth two."""
    gates = {"fit_min_unique_events": 20, "baseline_min_unique_events": 1}
    return boosted.BoostedHazards(["pred", "pred2", "valve_age_years"], trees=trees, gates=gates, **options).fit(role(spark, sf_dir, "surv"))


@query()
def i9_boosted_hazards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative hazards of every cause after 300 trees, at three horizons, and what supports them."""
    out = boosted_model(spark, sf_dir).hazards(role(spark, sf_dir, "surv"), [0.0, 1.0, 3.0, 5.0])
    return out.select("row_id", "support", *(F.col(c)[k].alias(f"{c}_{k}") for c in ("svd", "death", "replacement") for k in (1, 2, 3)))


@query()
def i10_staged_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State probabilities after 50 and 100 of 100 trees, from one fit."""
    times = [0.25 * k for k in range(21)]
    model = boosted_model(spark, sf_dir, 100, causes={"svd": 1, "death": 2})  # no replacements here, and without events no support
    return model.probabilities(role(spark, sf_dir, "surv"), times, [1.0, 3.0], [50, 100])


@query()
def i8_univariable_log_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = role(spark, sf_dir, "surv").withColumn("tavr", (F.col("route") == "TAVR").cast("double"))
    beta, se = boost.log_effect(rows, "tavr", F.col("event") == 1)
    return rows.agg(F.lit(beta).alias("log_effect"), F.lit(se).alias("se"), F.count("*").alias("n"))


@query()
def i6_i7_h8_offset_marker_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marker terms on measured rows over the base model's predictor as offset."""
    rows = role(spark, sf_dir, "surv")
    base = cox.fit_cox(rows, ["valve_age_years"], F.col("event") == 1, strata=F.col("route"))
    measured = rows.filter("row_id % 3 > 0").withColumn("cum", F.col("valve_age_years") / 10)
    knots = quantile_table(measured, {"pred2": F.col("pred2")}, [0.1, 0.5, 0.9])["pred2"]
    table, columns = boost.marker_terms(measured, "pred2", "cum", knots)
    fit = boost.offset_model(table, columns, cox.linear_predictor(base), F.col("event") == 1, strata=F.col("route"))
    each = cox.contributions(fit, {})
    return table.withColumn("lp", cox.linear_predictor(fit)).select("row_id", *columns, "lp", F.transform(each, lambda x: x["contribution"]).alias("contributions"))


@query()
def i16_top_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = role(spark, sf_dir, "surv")
    fit = cox.fit_cox(rows, ["pred", "pred2", "valve_age_years"], F.col("event") == 1)
    means = {c: float(v) for c, v in rows.agg(*(F.avg(c).alias(c) for c in fit.columns)).first().asDict().items()}
    return cox.top_drivers(rows, cox.contributions(fit, means), 2)


@query()
def i15_grouped_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = role(spark, sf_dir, "surv")
    fit = cox.fit_cox(rows, ["pred", "valve_age_years"], F.col("event") == 1)
    base = survival.nelson_aalen(rows.withColumn("r", F.exp(cox.linear_predictor(fit))).withColumn("all", F.lit(1)), ["all"], "r", 1)
    at_tau = base.filter(F.col("time") <= TAU).agg(F.max("cumulative_hazard")).first()[0] or 0.0
    predict = lambda d: d.withColumn("p", 1 - F.exp(-at_tau * F.exp(cox.linear_predictor(fit))))
    return experiments.grouped_sensitivity(rows, {"score": {"pred": F.lit(0.5)}, "age": {"valve_age_years": F.lit(0.0)}}, predict)


@query()
def i17_exposure_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = role(spark, sf_dir, "surv").withColumn("vka", (F.col("row_id") % 4 == 0).cast("double"))
    fit = cox.fit_cox(rows, ["vka", "valve_age_years"], F.col("event") == 1)
    return boost.contrast(rows, lambda d: d.withColumn("lp", cox.linear_predictor(fit)), "vka", 1.0, 0.0, F.col("vka") == 1)


@query()
def i18_secondary_outcome_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hazard models on another outcome: renamed columns, a gate of 20 event patients."""
    rows = role(spark, sf_dir, "surv").withColumn("event", (F.col("event") == 2).cast("int"))
    model = cox.CauseSpecificCox(["pred"], causes={"thrombosis": 1}, gates={**cox.GATES, "fit_min_unique_events": 20}).fit(rows)
    return model.hazards(rows, [0.0, 1.0, 3.0]).select("row_id", "support", F.element_at("thrombosis", -1).alias("cumulative_hazard"))


@query()
def k8_formal_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    knots = quantile_table(rows, {"pred": metrics.logit(F.col("pred"))}, [0.1, 0.5, 0.9])["pred"]
    return boost.formal_calibration(rows, knots)


@query()
def k10_conditional_censoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boost.conditional_censoring(role(spark, sf_dir, "surv"), ["valve_age_years"], TAU).select("row_id", "g")


@query(_W + f""", {_RANKS.format(seed=0)}, {_DRAWS.format(reps=20)}, sums as (select patient_id, sum(w * ((y - pred2) ** 2 - (y - pred) ** 2)) as a, count(*) as b from scored group by patient_id),
reps as (select rep, sum(k * a) / sum(k * b) as d from picks join ranks using (rank) join sums using (patient_id) group by rep),
r as (select (select sum(a) / sum(b) from sums) as difference, (select quantile_cont(d, 0.025) from reps) as ci_low, (select quantile_cont(d, 0.975) from reps) as ci_high, (select count(*) from sums) as patients)
select 'boosting' as family, round(difference, 6) as difference, round(ci_low, 6) as ci_low, round(ci_high, 6) as ci_high, patients, difference < 0 and ci_high < 0 as promote from r""")
def k15_family_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    out = experiments.promotion_decision(boost.pair_family_brier(rows, {"cox": "pred", "boosting": "pred2"}, "cox", 20))
    return out.select("family", r6("difference"), r6("ci_low"), r6("ci_high"), "patients", "promote")


_SUB = "case when row_id % 4 = 0 then 'regurgitant' when row_id % 4 = 1 then 'mixed' else 'stenotic' end"


def subgroup_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("phenotype", F.expr(_SUB))
    return rows.groupBy("route", "phenotype").agg((F.sum(F.col("w") * (F.col("y") - F.col("pred")) ** 2) / F.count("*")).alias("brier"), F.count("*").alias("n"))


@query(_W + f", s as (select *, {_SUB} as phenotype from scored) select route, phenotype, round(sum(w * (y - pred) ** 2) / count(*), 6) as brier, count(*) as n from s group by all")
def k21_subgroup_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subgroup_brier(spark, sf_dir).select("route", "phenotype", r6("brier"), "n")


@query(_W + f", s as (select *, {_SUB} as phenotype from scored), b as (select route, phenotype, sum(w * (y - pred) ** 2) / count(*) as b from s group by all) select route, round(max(b) filter (where phenotype = 'stenotic'), 6) as stenotic, round(max(b) filter (where phenotype = 'regurgitant'), 6) as regurgitant from b group by route")
def k22_report_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = experiments.report_pivot(subgroup_brier(spark, sf_dir), ["route"], "phenotype", "brier", ["stenotic", "regurgitant"])
    return out.select("route", r6("stenotic"), r6("regurgitant"))


@query(_W + f", s as (select *, {_SUB} as phenotype from scored), b as (select route, phenotype, sum(w * (y - pred) ** 2) / count(*) as b from s group by all) select phenotype, round(avg(b), 6) as mean, round(min(b), 6) as min, round(max(b), 6) as max, count(b) as n from b group by phenotype")
def k20_sensitivity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = experiments.sensitivity_summary(subgroup_brier(spark, sf_dir), ["phenotype"])
    return out.select("phenotype", r6("mean"), r6("min"), r6("max"), "n")


@query(_W + """, pop as (select s.*, u.population from scored s, (select unnest(['all', 'without_early']) as population) u where population = 'all' or not (row_id % 24 - 8 >= 10 or row_id % 3 - 1 >= 1))
select population, t as threshold, round(sum(w * (y - pred) ** 2) / count(*), 6) as brier, round(sum(w * a * (y - (1 - y) * t / (1 - t))) / count(*), 6) as net_benefit, round(avg(a), 6) as alert_rate from (select p.*, t, case when pred >= t then 1.0::double else 0.0::double end as a from pop p, (select unnest([0.1::double, 0.3::double]) as t)) group by population, t""")
def k17_landmark_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on all rows, and on those left when early change is excluded."""
    rows = scored(spark, sf_dir)
    early = rules.prevalent_early(F.col("row_id") % 24, F.lit(8), F.col("row_id") % 3, F.lit(1))
    populations = F.array_compact(F.array(F.lit("all"), F.when(~early, F.lit("without_early"))))
    rows = rows.withColumn("population", F.explode(populations))
    briers = rows.groupBy("population").agg((F.sum(F.col("w") * (F.col("y") - F.col("pred")) ** 2) / F.count("*")).alias("brier"))
    out = metrics.net_benefit(rows, [0.1, 0.3], group=["population"]).join(briers, "population")
    return out.select("population", "threshold", r6("brier"), r6("net_benefit"), r6("alert_rate"))


#: The smallest tables hold few events.
_FEW = {**cox.GATES, "fit_min_unique_events": 10, "baseline_min_unique_events": 1}


@query()
def l7_simplest_setting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosting settings by their mean Brier score over two inner patient folds, and which of them is chosen."""
    rows = role(spark, sf_dir, "surv")
    chosen, table = experiments.nested_tuning(rows, ["pred", "valve_age_years"], {"trees": [1, 2], "depth": [1], "rate": [0.1]}, {"svd": 1}, [TAU], folds=2, gates=_FEW)
    picked = chosen.select(F.col("trees").alias("t"), F.col("depth").alias("d"), F.col("rate").alias("r"))
    same = (F.col("trees") == F.col("t")) & (F.col("depth") == F.col("d")) & (F.col("rate") == F.col("r"))
    return table.join(picked, same, "left").select("depth", "trees", "rate", "mean_brier", "scored_cells", F.col("t").isNotNull().alias("chosen"))




def _features() -> dict[str, Column]:
    return {"gradient_now": F.coalesce("current_gradient", "ref_gradient"), "t_lm": F.col("t_lm")}


_GRID = [0.25 * k for k in range(0, 25)]


def _request_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {n: role(spark, sf_dir, n) for n in ("patients", "studies", "exposures", "mechanism")}


def _fitted(spark: SparkSession, sf_dir: str) -> cox.CauseSpecificCox:
    rows = landmarks_of(spark, sf_dir, with_features=False).withColumns(_features())
    return cox.CauseSpecificCox(list(_features()), causes={"svd": 1, "death": 2}, gates=_FEW).fit(rows)


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role(spark, sf_dir, "terminal").select("patient_id", F.date_sub("end_followup_date", 180).alias("prediction_date"))


_STATUS_SQL = (
    f"with patients as ({ROLES['patients']}), studies0 as ({ROLES['studies']}), exposures0 as ({ROLES['exposures']}), mechanism0 as ({ROLES['mechanism']}), terminal0 as ({ROLES['terminal']}), "
    "req as (select patient_id, end_followup_date - 180 as pd from terminal0), studies as (select s.* from {studies} s join req using (patient_id) where s.date <= pd), "
    "exposures as (select e.patient_id, e.seq, e.class, e.indication, e.start_date, {stop} as stop_date, e.post_suspicion from exposures0 e join req using (patient_id) where e.start_date <= pd), mechanism as (select m.* from mechanism0 m join req using (patient_id) where m.date <= pd), "
    "terminal as (select patient_id, end_followup_date, null::date as death_date, null::date as replacement_date, null::date as first_thrombosis_date from terminal0)"
    + _RECORDS.replace("{", "{{").replace("}", "}}")
    + """, now as (select patient_id, max_by(stage, {{'d': date, 's': seq}}) as stage from staged group by patient_id)
select q.patient_id, q.pd as prediction_date, case when p.implant_date is null or q.pd < p.implant_date then 'prediction_time_invalid' when r.svd_status = 'no_reference' then 'no_reference_echo'
  when r.svd_candidate_date is not null and r.svd_mechanism = 'svd' then 'endpoint_met' else 'ok' end as score_status, n.stage as current_stage
from req q left join records r on r.patient_id = q.patient_id left join patients p on p.patient_id = q.patient_id left join now n on n.patient_id = q.patient_id"""
)
_EXTRA_STUDY = "(select patient_id, date, seq, mean_gradient, eoa, dvi, ar, lvef, svi from studies0 union all select patient_id, pd - 30, 1152921504606846976, 45.0, 0.6, 0.2, 1, 55.0, 35.0 from req)"


@query(_STATUS_SQL.format(studies="studies0", stop="e.stop_date"))
def j8_score_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of a scoring request per patient, half a year before the end of follow-up."""
    out = experiments.score_status(_requests(spark, sf_dir), *_request_tables(spark, sf_dir).values())
    return out.select("patient_id", "prediction_date", "score_status", "current_stage")


@query()
def j8_scored_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch scoring: status and state probabilities at 1, 3 and 5 years, from models fitted on the landmark table."""
    tables = _request_tables(spark, sf_dir)
    return experiments.score_requests(_requests(spark, sf_dir), tables, _fitted(spark, sf_dir), _features(), _GRID, [1.0, 3.0, 5.0])


def _study(gradient: float, eoa: float, dvi: float, ar: int) -> dict[str, Column]:
    return {"mean_gradient": F.lit(gradient), "eoa": F.lit(eoa), "dvi": F.lit(dvi), "ar": F.lit(ar), "lvef": F.lit(55.0), "svi": F.lit(35.0)}


@query(_STATUS_SQL.format(studies=_EXTRA_STUDY, stop="case when e.start_date < pd and coalesce(e.stop_date > pd, true) then pd else e.stop_date end"))
def j12_what_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring status when one more, worse study is assumed a month before the request, and a change to VKA at its time."""
    requests = _requests(spark, sf_dir)
    change = {"class": F.lit("VKA"), "indication": F.lit("af"), "post_suspicion": F.lit(False)}
    tables = experiments.what_if(requests, _request_tables(spark, sf_dir), _study(45.0, 0.6, 0.2, 1), 30, change)
    out = experiments.score_status(requests, *(tables[n] for n in ("patients", "studies", "exposures", "mechanism")))
    return out.select("patient_id", "prediction_date", "score_status", "current_stage")


@query()
def j12_what_if_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of the requests as they are and with the assumed study, from the same models."""
    requests, tables, model = _requests(spark, sf_dir), _request_tables(spark, sf_dir), _fitted(spark, sf_dir)
    changed = experiments.what_if(requests, tables, _study(19.0, 1.6, 0.5, 0), 30)
    now, then = (experiments.score_requests(requests, t, model, _features(), _GRID, [5.0]) for t in (tables, changed))
    keys = ["patient_id", "prediction_date"]
    return now.select(*keys, "score_status", "svd").join(then.select(*keys, F.col("score_status").alias("status_after"), F.col("svd").alias("svd_after")), keys)


@query()
def j7_implant_time_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk by three years at a valve age of a quarter, from models of route and valve age."""
    model = cox.CauseSpecificCox(["valve_age_years"], causes={"svd": 1, "death": 2}).fit(role(spark, sf_dir, "surv"))
    return experiments.implant_time_risk(model, role(spark, sf_dir, "patients").select("patient_id", "route"), _GRID, 3.0)


@query()
def l4_ladder_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps by two folds as resumable cells; every state, two horizons, pooled and patient-balanced, behind support gates."""
    rows = role(spark, sf_dir, "surv")
    causes = {"svd": 1, "death": 2, "replacement": 3}
    steps = {"age": ["valve_age_years"], "age_and_score": ["valve_age_years", "pred"]}
    oof = grid.out_of_fold_grid(rows, steps, 2, [1.0, TAU], causes, _GRID, stage_path(spark, "ladder"), gates=_FEW)
    gates = {"metric_min_event_patients": 5, "metric_min_control_patients": 5, "slope_min_events": 20, "min_at_risk": 10, "min_censoring_survival": 0.05}
    return grid.ladder_metrics(rows, oof, [1.0, TAU], causes, {"pooled": None, "patient_balanced": metrics.balanced_weight()}, gates)


@query()
def l5_comparator_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold scores of two comparators on the same rows, with the paired difference beside the challenger."""
    table, paired = experiments.comparator_ladder(role(spark, sf_dir, "surv"), {"age": ["valve_age_years"], "age_and_score": ["valve_age_years", "pred"]}, [("age_and_score", "age")], TAU, {"svd": 1, "death": 2}, _GRID, folds=2, replicates=20)
    return table.join(paired.select(F.col("challenger").alias("comparator"), "difference", "ci_low", "ci_high", "patients"), "comparator", "left")


@query()
def l6_observation_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ladder on landmarks as adjudicated and with onsets at the right end of their intervals, for the patients of both."""
    patients, studies, staged = written_staged_of(spark, sf_dir)
    events = events_of(spark, sf_dir, staged)
    right = experiments.allocate_onsets(experiments.onset_intervals(events, staged), "right")
    tables = {}
    for name, override in (("primary", None), ("interval_right", right)):
        rows = landmark.build_landmarks(patients, studies, role(spark, sf_dir, "labs"), role(spark, sf_dir, "exposures"), events, override=override, with_features=False, staged=staged)
        rows = rows.withColumn("row_id", F.concat_ws("@", "patient_id", F.col("landmark_date").cast("string"))).withColumn("pred", F.lit(0.0))
        tables[name] = stage(rows.withColumns(_features()), name)
    results, _ = experiments.observation_sensitivity(tables, {"gradient": list(_features())}, [TAU], {"svd": 1}, _GRID, folds=2, gates=_FEW)
    return results


@query()
def l8_marker_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a marker measured on two thirds of the rows adds to valve age, out of fold."""
    rows = role(spark, sf_dir, "surv").withColumn("cum", F.col("valve_age_years") / 10)
    knots = quantile_table(rows, {"pred2": F.col("pred2")}, [0.1, 0.5, 0.9])["pred2"]
    return experiments.marker_increment(rows, ["valve_age_years"], lambda d: boost.marker_columns(d, "pred2", "cum", knots), F.col("row_id") % 3 > 0, [TAU], folds=2, replicates=20)


@query()
def i17_mechanism_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = role(spark, sf_dir, "surv").withColumn("vka", (F.col("row_id") % 4 == 0).cast("double"))
    found = experiments.mechanism_check(rows, ["vka", "valve_age_years"], ["pred"], "vka", least=0.0)
    return rows.agg(*(F.lit(v).cast("double").alias(k) for k, v in found.items()), F.count("*").alias("n"))


@query(with_roles("surv") + """ select row_id, array_to_string(list_filter([case when row_id % 3 = 0 then 'current_abnormality' end, case when pred * 0.05::double >= 0.02 then 'earlier_assessment' end, case when time * 12 > case when route = 'TAVR' then 12 when valve_age_years < 5 then greatest((5 - valve_age_years) * 12 + 12, 1) when valve_age_years < 10 then greatest((10 - valve_age_years) * 12 + 12, 1) else 12 end + 3 then 'overdue' end], lambda x: x is not null), ',') as messages from surv""")
def j9_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = role(spark, sf_dir, "surv")
    stage_now = F.when(F.col("row_id") % 3 == 0, "2").otherwise("0")
    m = rules.months_message(F.col("pred") * 0.05, F.col("time") * 12, rules.guideline_interval("ACC_AHA", F.col("route"), F.col("valve_age_years")), stage_now)
    return s.select("row_id", F.array_join(m, ",").alias("messages"))


@query(with_roles("patients") + " select patient_id, round(((bmi is not null)::int + 2) / 3.0::double, 6) as completeness, case when patient_id % 2 = 0 and bmi is not null then 'high' when (bmi is not null)::int + 2 >= 1.5 then 'moderate' else 'low' end as level from patients")
def j10_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = role(spark, sf_dir, "patients")
    evidence = F.when(F.col("patient_id") % 2 == 0, "high").otherwise("low")
    return p.withColumn("r", rules.reliability(evidence, {c: F.col(c) for c in ("bmi", "bsa", "sex")})).select("patient_id", r6(F.col("r.completeness"), "completeness"), F.col("r.level").alias("level"))


@query(with_roles("surv") + " select row_id, case when row_id % 5 = 0 then 'not_measured' when row_id % 3 = 0 then 'stale' when route = 'SAVR' then 'not_in_model' else 'used' end as status from surv")
def j11_marker_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("row_id")
    return role(spark, sf_dir, "surv").select("row_id", rules.marker_status(F.when(k % 5 > 0, k), k % 3 == 0, F.col("route") == "TAVR").alias("status"))


@query(with_roles("surv") + " select 'median' as target_id, round(avg(v), 6) as mean, round(stddev_samp(v) / sqrt(count(v)), 6) as mc_se, abs(avg(v) - 0.5) <= 0.05 as within from (select valve_age_years, quantile_cont(pred, 0.5) as v from surv group by 1)")
def m9_target_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    reps = role(spark, sf_dir, "surv").groupBy("valve_age_years").agg(F.percentile("pred", 0.5).alias("value")).withColumn("target_id", F.lit("median"))
    targets = spark.createDataFrame([("median", 0.5, 0.05, True)], "target_id string, estimate double, tolerance double, mandatory boolean")
    return profile.target_check(reps, targets).select("target_id", r6("mean"), r6("mc_se"), "within")


@query(with_roles("surv") + ", c as (select patient_id as target_id, time, pred as estimate from surv) select c.target_id, time, estimate, round(2.0::double / count(*) over (partition by c.target_id), 6) as weight, round(0.02::double / (2 * 1.959964::double), 6) as standard_error from c")
def m12_curve_target_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = role(spark, sf_dir, "surv").select(F.col("patient_id").alias("target_id"), "time", F.col("pred").alias("estimate"), (F.col("pred") - 0.01).alias("lower"), (F.col("pred") + 0.01).alias("upper"))
    targets = s.select("target_id").distinct().withColumn("weight", F.lit(2.0))
    return profile.expand_curve_targets(targets, s).select("target_id", "time", "estimate", r6("weight"), r6("standard_error"))


@query("select 'published:' || lower(c_mktsegment) || ':' || 'svd_at_' || c_nationkey || ':5' as target_id, 'svd_at_' || c_nationkey as variable, round(c_acctbal / 100, 6) as estimate from customer")
def m7_published_rate_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    rates = c.select(F.col("c_mktsegment").alias("study"), F.concat(F.lit("SVD at "), F.col("c_nationkey").cast("string")).alias("outcome"), F.lit(5).alias("horizon_years"), F.col("c_acctbal").alias("percent"), F.lit(100).alias("sample_size"))
    return boost.annual_rate_targets(rates).select("target_id", "variable", r6("estimate"))


@query(with_roles("surv", "terminal") + """, v as (select row_id, event, quantile_cont(pred, 0.5) over () as med from surv) select 'proportion' as statistic, round(avg((event = 1)::int), 6) as value, count(*) as n from v union all select 'mean', (select round(avg(pred), 6) from surv), (select count(*) from surv) union all select 'sd', (select round(stddev_samp(pred), 6) from surv), (select count(*) from surv)
  union all select 'quantile_0.5', (select round(quantile_cont(pred, 0.5), 6) from surv), (select count(*) from surv) union all select 'correlation', (select round(corr(pred, pred2), 6) from surv), (select count(*) from surv)""")
def m8_reporting_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = role(spark, sf_dir, "surv")
    requests = [
        ("proportion", "proportion", {"condition": F.col("event") == 1}), ("mean", "mean", {"column": "pred"}), ("sd", "sd", {"column": "pred"}),
        ("quantile_0.5", "quantile", {"column": "pred", "q": 0.5}), ("correlation", "correlation", {"column": "pred", "other": "pred2"}),
    ]
    return profile.report(s, requests).select(F.col("name").alias("statistic"), r6("value"), "n")


@query(with_roles("obs", "surv") + """, us as (select * from obs where duplicate_status = 'unique' and not suppressed), sr as (select person_id, variable, datediff('day', min(date::date) over (partition by person_id), date::date) / 365.25::double as years, value from us where value is not null),
sl as (select variable, person_id, regr_slope(value, years) as x, count(*) as k, max(years) - min(years) as span from sr group by all), an as (select variable, person_id, floor(years)::bigint as y, avg(value) as x from sr where floor(years) in (0, 1) group by all),
l as (select variable as name, 'slope_per_year' as statistic, x from sl where k >= 2 and span >= 0.5 union all select variable, 'annual_mean:' || y, x from an),
tt as (select time, count(*) filter (where event <> 0) as d, count(*) filter (where event = 1) as d1, count(*) filter (where event = 2) as d2, sum(count(*)) over (order by time desc) as n from surv group by time), ev as (select *, product(1 - d::double / n) over (order by time) as s from tt where d > 0), cv as (select *, coalesce(lag(s) over (order by time), 1) as sb from ev),
r as (select name, statistic, avg(x) as v, stddev_samp(x) / sqrt(count(*)) as e, count(*) as n from l group by all), z as (select count(*) as n from surv),
q as (select 'all' as name, 'km_survival:3' as statistic, (select min(s) from cv where time <= 3) as v union all select 'svd', 'cumulative_incidence:3', (select sum(sb * d1 / n) from cv where time <= 3) union all select 'death', 'cumulative_incidence:3', (select sum(sb * d2 / n) from cv where time <= 3))
select name, statistic, round(v, 4) as value, round(e, 4) as se, n from r union all select name, statistic, round(v, 4), round(sqrt(greatest(v * (1 - v), 1e-12) / z.n), 4), z.n from q, z""")
def m8_series_and_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes and annual means over persons, survival and cumulative incidence at three years."""
    o = profile.usable(role(spark, sf_dir, "obs"))
    day = F.to_date("date")
    series = o.filter("value is not null").withColumn("years", F.datediff(day, F.min(day).over(Window.partitionBy("person_id"))) / 365.25)
    names = [r["variable"] for r in o.select("variable").distinct().collect()]
    out = profile.report_series(series, names, [0, 1]).unionByName(profile.report_times(role(spark, sf_dir, "surv"), [3.0], {"svd": 1, "death": 2}))
    r4 = lambda c: (F.round(c, 4) + F.lit(0.0)).alias(c)
    return out.select("name", "statistic", r4("value"), r4("se"), "n")


@query()
def k21_gated_subgroup_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brier score, IPA and AUC per route and state, each route a population of its own, behind support gates."""
    rows = role(spark, sf_dir, "surv")
    p = rows.select("row_id", F.lit("score").alias("step"), F.lit(float(TAU)).alias("horizon"), (F.col("pred") / 2).alias("svd"), (F.col("pred2") / 2).alias("death"), (1 - (F.col("pred") + F.col("pred2")) / 2).alias("alive_intact"))
    gates = {"metric_min_event_patients": 5, "metric_min_control_patients": 5, "slope_min_events": 20, "min_at_risk": 10}
    return grid.ladder_metrics(rows, p, [TAU], {"svd": 1, "death": 2}, {"pooled": None}, gates, by=["route"])


@query()
def i7_adjusted_hazards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first cause's hazards with a marker's centred hazard ratio on the measured rows; other rows and causes as they were."""
    rows = role(spark, sf_dir, "surv")
    model = cox.CauseSpecificCox(["valve_age_years"], gates=_FEW).fit(rows)
    base = model.models["svd"]
    offset = cox.linear_predictor(base.fit, model.means) if base.fit else F.lit(0.0)
    measured = F.col("row_id") % 3 > 0
    with_marker = rows.withColumn("cum", F.col("valve_age_years") / 10)
    terms = boost.marker_columns(with_marker.filter(measured), "pred2", "cum", [0.1, 0.4, 0.8])
    adjust = boost.offset_adjustment(with_marker, terms, measured, offset, F.col("event") == 1, F.col("time") * F.exp(offset), F.col("route"), 20, 2)
    hazards = model.hazards(with_marker, [0.0, 1.0, 3.0])
    out = adjust.adjust(hazards, "svd") if adjust else hazards
    return out.select("row_id", "support", F.element_at("svd", -1).alias("svd"), F.element_at("death", -1).alias("death"), (adjust.log_hr() if adjust else F.lit(0.0)).alias("log_hr"))


_PRIMARY_SVD = "case when svd_first_unresolved_date is null or svd_first_unresolved_date >= svd_adjudicated_date then svd_adjudicated_date end"
_PRIMARY_CENSOR = "case when svd_adjudicated_date is null or svd_first_unresolved_date < svd_adjudicated_date then svd_first_unresolved_date end"
_OVERRIDE = _elig_sql(f"case when svd_adjudicated_date is null then svd_first_positive_date else {_PRIMARY_SVD} end", f"case when svd_adjudicated_date is null then null else {_PRIMARY_CENSOR} end")


@query(with_roles(*_ALL) + _RECORDS + _OVERRIDE + " select patient_id, date as landmark_date, round(time, 6) as time, event from outcomes")
def f11_truth_override_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landmarks with event dates of an evaluation-only table (here: the first single positive study) where adjudication found
    none."""
    patients, studies, staged = written_staged_of(spark, sf_dir)
    events = events_of(spark, sf_dir, staged)
    truth = events.select("patient_id", F.col("svd_first_positive_date").alias("threshold_crossing_date"), F.col("svd_adjudicated_date").isNull().alias("missed_crossing"))
    override = experiments.truth_override(events, truth, missed_only=True)
    rows = landmark.build_landmarks(patients, studies, role(spark, sf_dir, "labs"), role(spark, sf_dir, "exposures"), events, override=override, with_features=False, staged=staged)
    return rows.select("patient_id", "landmark_date", r6("time"), "event")


@query(with_roles("surv", "patients", "studies") + _G + _STAGED + " select t.stage, round(sum(w * y) / sum(w), 6) as risk, count(*) as n from scored s join staged t on t.seq = s.row_id group by t.stage")
def k2_ipcw_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Censoring-weighted outcome share per current stage of the last study."""
    staged = staged_of(spark, sf_dir)[2].select(F.col("seq").alias("row_id"), F.col("staged.stage").alias("stage"))
    rows = survival.with_ipcw(role(spark, sf_dir, "surv"), TAU, ["route"]).join(staged, "row_id")
    return rows.groupBy("stage").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("risk"), F.count("*").alias("n")).withColumn("risk", r6("risk"))
