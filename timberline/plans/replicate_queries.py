"""Queries with patient-bootstrap errors and limits, and of small operators over profiles, onsets and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.operators import boost, cif, cox, experiments, features, metrics, profile, replicates, resample
from timberline.operators.staging import quantile_table, stage
from timberline.plans.bindings import role, with_roles
from timberline.plans.data_queries import _OBS, first_of
from timberline.plans.model_queries import _STATUS, _W, TAU, _paired, scored
from timberline.plans.registry import query, r6

REPLICATES = 20


def _drawn_sql(ids: str, key: str) -> str:
    """Common tables: ``drawn`` (rep, patient, k) with the sample as replicate 0, and the draws of the hashed bootstrap."""
    return f"""ranks as (select {key}, row_number() over (order by upper(md5('0:' || {key})) || '-' || {key}) - 1 as rank from (select distinct {key} from {ids})),
draws as (select r.i // n as rep, ('0x' || substr(md5('1:' || r.i), 1, 15))::bigint % n as rank from (select count(*) as n from ranks), range({REPLICATES} * (select count(*) from ranks)) as r(i)),
drawn as (select rep + 1 as rep, {key}, count(*) as k from draws join ranks using (rank) group by all union all select 0, {key}, 1 from ranks)"""


_LIMITS = "round(quantile_cont({x}, 0.025) filter (where rep > 0 and {x} is not null), 6) as ci_low, round(quantile_cont({x}, 0.975) filter (where rep > 0 and {x} is not null), 6) as ci_high, count({x}) filter (where rep > 0) as valid"


def _shown(limits: DataFrame, *keys: str, name: str = "value") -> DataFrame:
    return limits.select(*keys, r6("value", name), r6("low", "ci_low"), r6("high", "ci_high"), "valid")


@query(with_roles("surv") + ", " + _drawn_sql("surv", "patient_id") + """, c as (select d.rep, route, time, event, pred, k from surv join drawn d using (patient_id)),
j as (select a.rep, a.route, a.k * b.k as w, case when a.pred > b.pred then 1.0::double when a.pred = b.pred then 0.5::double else 0.0::double end as s from c a join c b on a.rep = b.rep and a.route = b.route and (b.time > a.time or (b.time = a.time and b.event = 0)) where a.event <> 0),
v as (select rep, route, sum(w * s) / sum(w) as x from j group by all)
select route, round(max(x) filter (where rep = 0), 6) as concordance, """ + _LIMITS.format(x="x") + " from v group by route")
def k16_concordance_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concordance per route with limits over patient bootstraps, all of them in one pass over the rank tree."""
    rows = role(spark, sf_dir, "surv")
    drawn = rows.join(resample.bootstrap_lists(rows, REPLICATES), "patient_id")
    out = replicates.replicate_intervals(replicates.concordance_replicates(drawn, REPLICATES, ["route"]), "concordance", ["route"])
    return _shown(out, "route", name="concordance")


@query(_W + ", " + _drawn_sql("surv", "patient_id") + """, cs as (select d.rep, route, pred as p, sum(k * w) filter (where y = 1) as cw, sum(k * w) filter (where y = 0 and known) as kw from scored join drawn d using (patient_id) group by all),
x as (select *, sum(coalesce(kw, 0)) over (partition by rep, route order by p) - 0.5::double * coalesce(kw, 0) as below from cs),
v as (select rep, route, sum(cw * below) / nullif(sum(cw) * sum(kw), 0) as x from x group by all)
select route, round(max(x) filter (where rep = 0), 6) as auc, """ + _LIMITS.format(x="x") + " from v group by route")
def k9_auc_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    drawn = rows.join(resample.bootstrap_lists(rows, REPLICATES), "patient_id")
    return _shown(replicates.replicate_intervals(replicates.auc_replicates(drawn, REPLICATES, ["route"]), "auc", ["route"]), "route", name="auc")


@query(_W + f""", cm as (select *, {_STATUS} as status from scored), c2 as (select *, (status = 'positive')::int as r, (pred >= 0.3)::int as m, w * (y - (1 - y) * 0.3::double / 0.7::double) as gain from cm where status <> 'indeterminate'),
each as (select patient_id, avg(gain * (m - r)) as a, avg(gain * (greatest(r, m) - m)) as b from c2 group by patient_id), {_drawn_sql("each", "patient_id")},
v as (select rep, avg(a) as a, avg(b) as b from each join drawn using (patient_id) group by rep), l as (select rep, 'model_minus_rule' as contrast, a as x from v union all select rep, 'or_minus_model', b from v)
select contrast, round(max(x) filter (where rep = 0), 6) as value, """ + _LIMITS.format(x="x") + " from l group by contrast")
def k13_strategy_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(metrics.paired_strategy_intervals(_paired(spark, sf_dir), 0.3, REPLICATES), "contrast")


@query(_W + f", cm as (select *, {_STATUS} as status from scored) select row_id, round(pred, 6) as pred from cm where status = 'negative' and pred >= 0.3")
def k13_discordant_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.discordant_rows(_paired(spark, sf_dir), 0.3).select("row_id", r6("pred"))


_POLICIES = with_roles("surv") + """, a as (select row_id, route, valve_age_years as t0, valve_age_years + 6 as t_end, valve_age_years + pred * 8 as crossing, case when row_id % 3 > 0 then valve_age_years + pred2 * 9 end as da, case when row_id % 4 > 0 then valve_age_years + pred2 * 9.5::double + 0.2::double end as db, 1 + row_id % 6 as na, 1 + row_id % 5 as nb, 1 + pred as yrs from surv),
h as (select *, (coalesce(crossing > t0 and crossing < t_end and da >= crossing, false) and coalesce(crossing > t0 and crossing < t_end and db >= crossing, false))::int as twice from a)"""


def policies_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same survival rows under guided and plain surveillance."""
    s = role(spark, sf_dir, "surv")
    common = [F.col("row_id").alias("patient_id"), "route", F.col("valve_age_years").alias("t0"), (F.col("valve_age_years") + 6).alias("t_end"), (F.col("valve_age_years") + F.col("pred") * 8).alias("crossing"), (1 + F.col("pred")).alias("surveillance_years")]
    a = s.select(*common, F.lit("guided").alias("policy"), F.when(F.col("row_id") % 3 > 0, F.col("valve_age_years") + F.col("pred2") * 9).alias("detect"), (1 + F.col("row_id") % 6).alias("n_echoes"))
    b = s.select(*common, F.lit("plain").alias("policy"), F.when(F.col("row_id") % 4 > 0, F.col("valve_age_years") + F.col("pred2") * 9.5 + 0.2).alias("detect"), (1 + F.col("row_id") % 5).alias("n_echoes"))
    return a.unionByName(b)


@query(_POLICIES + ", " + _drawn_sql("h", "row_id") + """, v as (select rep, route, sum(k * twice * coalesce((db - da) * 12, 0)) / nullif(sum(k * twice), 0) as lead, 1000 * (sum(k * na) / sum(k * yrs) - sum(k * nb) / sum(k * yrs)) as extra from h join drawn using (row_id) group by all),
l as (select rep, route, 'lead_mean_months' as contrast, lead as x from v union all select rep, route, 'extra_echoes_per_1000py', extra from v)
select route, contrast, round(max(x) filter (where rep = 0), 6) as value, """ + _LIMITS.format(x="x") + " from l group by all")
def k18_policy_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(metrics.paired_policy_intervals(policies_of(spark, sf_dir), "guided", "plain", REPLICATES, group=["route"]), "route", "contrast")


_FIRST = _OBS + """, fr as (select u.* from us u join ix on u.person_id = ix.person_id where datediff('day', ix.index_date::date, u.date::date) between -30 and 180 qualify row_number() over (partition by u.person_id, variable order by date, record_id) = 1), """


@query(_FIRST + _drawn_sql("fr", "person_id") + """, e as (select variable, rep, value from fr join drawn using (person_id), range(k)),
v as (select variable, rep, avg(value) as mean, stddev_samp(value) as sd, quantile_cont(value, 0.5) as q from e group by all),
l as (select variable, rep, 'mean' as statistic, mean as x from v union all select variable, rep, 'sd', sd from v union all select variable, rep, 'quantile:0.5', q from v)
select variable, 'baseline' as kind, statistic, round(max(x) filter (where rep = 0), 6) as value, round(stddev_samp(x) filter (where rep > 0), 6) as se from l group by all""")
def m1_bootstrap_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, sd and median of every baseline variable with standard errors over replicates of persons."""
    out = profile.bootstrap_errors(first_of(spark, sf_dir), REPLICATES, quantiles=[0.5])
    return out.select("variable", "kind", "statistic", r6("value"), r6("se"))


@query(_FIRST + """vs as (select min(variable) as a, max(variable) as b from fr), pr as (select person_id, max(value) filter (where variable = a) as x, max(value) filter (where variable = b) as y from fr, vs group by person_id having x is not null and y is not null), """ + _drawn_sql("pr", "person_id") + """,
v as (select rep, corr(x, y) as c, count(*) as n from pr join drawn using (person_id), range(k) group by rep)
select max(n) filter (where rep = 0) as n, round(max(c) filter (where rep = 0), 6) as correlation, round(stddev_samp(c) filter (where rep > 0), 6) as se from v""")
def m1_correlation_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of the first and the last baseline variable over the persons that have both."""
    first = stage(first_of(spark, sf_dir), "first")
    a, b = first.agg(F.min("variable"), F.max("variable")).first()
    return profile.correlation_error(first, a, b, REPLICATES).select("n", r6("correlation"), r6("se"))


@query()
def i6_bootstrap_wald(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joint test of a marker's terms over the base predictor as offset, with 200 patient bootstraps in the jobs of one fit."""
    rows = role(spark, sf_dir, "surv")
    base = cox.fit_cox(rows, ["valve_age_years"], F.col("event") == 1, strata=F.col("route"))
    measured = rows.filter("row_id % 3 > 0").withColumn("cum", F.col("valve_age_years") / 10)
    knots = quantile_table(measured, {"pred2": F.col("pred2")}, [0.1, 0.5, 0.9])["pred2"]
    table, columns = boost.marker_terms(measured, "pred2", "cum", knots)
    found = boost.bootstrap_wald(table, columns, F.col("event") == 1, 200, strata=F.col("route"), offset=cox.linear_predictor(base))
    se = found.get("se") or [None] * len(columns)
    return spark.createDataFrame([(c, found["statistic"], found["p_value"], found["n_ok"], e) for c, e in zip(columns, se, strict=True)], "term string, statistic double, p_value double, n_ok int, se double")


@query(with_roles("surv") + " select patient_id, row_id, time from surv qualify row_number() over (partition by patient_id order by time desc, row_id desc) <= 2")
def e13_latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.latest_rank(role(spark, sf_dir, "surv"), ["patient_id"], ["time", "row_id"], 2).select("patient_id", "row_id", "time")


@query(_FIRST + """st as (select variable, count(*) as n, avg(value) as m, stddev_samp(value) as s from fr group by variable), l as (select variable, n, 'mean' as statistic, m as x from st union all select variable, n, 'sd', s from st)
select 'local:snap:' || variable || ':' || statistic as target_id, statistic as kind, variable, round(x, 6) as estimate, n as sample_size, case when n < 30 then 'sensitivity' else 'fit' end as role, case when n < 30 then 'proposed' else 'approved' end as review_status from l""")
def m3_profile_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.profile_targets(profile.baseline_summaries(first_of(spark, sf_dir)), "snap")
    return out.select("target_id", "kind", "variable", r6("estimate"), "sample_size", "role", "review_status")


@query(_W + """, g as (select valve_age_years, count(distinct patient_id) filter (where y = 1 and known) as ca, count(distinct patient_id) filter (where y = 0 and known) as co, count(*) filter (where time >= 3 - 1e-9 and not (time <= 3 and event <> 0)) as th, sum(w * (y - pred) ** 2) / count(*) as b from scored group by 1)
select valve_age_years, case when th < 50 then 'insufficient_followup' when ca < 40 or co < 40 then 'insufficient_events' else 'ok' end as gate_status, case when th >= 50 and ca >= 40 and co >= 40 then round(b, 6) end as brier from g""")
def k11_withheld_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brier score per valve age, withheld where its support is too small."""
    rows = scored(spark, sf_dir)
    gates = {"metric_min_event_patients": 40, "metric_min_control_patients": 40, "slope_min_events": 60, "min_at_risk": 50}
    gated = metrics.metric_gate(metrics.horizon_counts(rows, TAU, ["valve_age_years"]), F.lit(1.0), gates).select("valve_age_years", "gate_status")
    brier = rows.groupBy("valve_age_years").agg((F.sum(F.col("w") * (F.col("y") - F.col("pred")) ** 2) / F.count("*")).alias("brier"))
    return metrics.withhold(gated.join(brier, "valve_age_years"), ["brier"]).select("valve_age_years", "gate_status", r6("brier"))


@query(with_roles("terminal") + " select patient_id, svd_event_date from (select *, coalesce(death_date, end_followup_date) + (patient_id % 3)::int - 1 as svd_event_date from terminal) where svd_event_date > least(death_date, replacement_date, end_followup_date)")
def f10_allocation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Onsets allocated around death or the end of follow-up: those after either, or after a replacement."""
    events = role(spark, sf_dir, "terminal")
    near = F.date_add(F.coalesce("death_date", "end_followup_date"), (F.col("patient_id") % 3).cast("int") - 1)
    return experiments.allocation_violations(events.select("patient_id", near.alias("svd_event_date")), events)


@query(with_roles("surv") + ", q as (select row_id, 1.0::double / count(*) over (partition by patient_id) as q from surv) select row_id, round(q * count(*) over () / sum(q) over (), 6) as weight from q")
def d11_scaled_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patient-balanced weights scaled to the number of rows."""
    rows = role(spark, sf_dir, "surv").withColumn("q", metrics.balanced_weight())
    total = rows.agg((F.count("*") / F.sum("q")).alias("scale"))
    return rows.crossJoin(F.broadcast(total)).select("row_id", r6(F.col("q") * F.col("scale"), "weight"))


@query(with_roles("surv") + """, m as (select avg((row_id % 40 = 0)::int) as rows, count(distinct patient_id) filter (where row_id % 40 = 0) * 1.0 / count(distinct patient_id) as patients from surv)
select 'valve_age_years' as feature, 'used' as status union all select 'pred', 'used' union all select 'pred2', case when rows < 0.05 or patients < 0.05 then 'below_cutoff' else 'used' end from m union all select 'dp_ucmgp', 'absent'""")
def h1_resolved_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of a step's blocks: used, absent, or why a marker is left out."""
    rows = role(spark, sf_dir, "surv").withColumn("pred2", F.when(F.col("row_id") % 40 == 0, F.col("pred2")))
    reasons = {r["marker"]: r["reason"] for r in features.marker_eligibility(rows, ["pred2"]).filter("reason is not null").collect()}
    found = features.resolve_features({"core": ["valve_age_years", "pred"], "marker": ["pred2", "dp_ucmgp"]}, ["core", "marker"], rows.columns, reasons)
    return spark.createDataFrame(list(found.items()), "feature string, status string")


@query(with_roles("surv") + """, g as (select row_id, case when row_id % 7 > 0 then pred end as pred, case when row_id % 11 > 0 then row_id % 3 = 0 end as early, case when row_id % 5 = 0 then null when row_id % 200 = 1 then 'rare' when row_id % 2 = 0 then 'a' else 'b' end as device from surv),
m as (select quantile_cont(pred, 0.5) as med, count(*) filter (where device = 'rare') >= 15 as frequent from g)
select row_id, round(coalesce(pred, med), 6) as pred, (pred is null)::int::double as pred__missing, coalesce(early, false)::int::double as early, (early is null)::int::double as early__missing, (device = 'a')::int::double is not distinct from 1 as device_a from g, m""")
def h5_h9_tree_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tree mode: medians and indicators without scaling, binary features with missing as 0 and an indicator, levels."""
    k = F.col("row_id")
    rows = role(spark, sf_dir, "surv").select(
        "row_id", F.when(k % 7 > 0, F.col("pred")).alias("pred"), F.when(k % 11 > 0, k % 3 == 0).alias("early"),
        F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 200 == 1, "rare").when(k % 2 == 0, "a").otherwise("b").alias("device"),
    )
    rows = stage(rows, "features")
    out = features.FeaturePipeline(numeric=["pred"], binary=["early"], categorical=["device"], spline=["pred"], tree=True).fit(rows).transform(rows, ["row_id"])
    return out.select("row_id", r6("pred"), "pred__missing", "early", "early__missing", (F.col("device__a") == 1).alias("device_a"))


@query(with_roles("surv") + " select unnest(list_sort(list_distinct(list(time) || [0.0, 1.0, 3.0, 5.0]))) as point from (select distinct time::double as time from surv where event <> 0 and time > 0 and time <= 5)")
def j1_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shared grid of a model: zero, horizons, the end, and every event time up to it (bounded by the distinct days)."""
    events = role(spark, sf_dir, "surv").filter("event <> 0 and time > 0 and time <= 5").select("time").distinct()
    points = cif.build_grid([r["time"] for r in events.collect()], [1.0, 3.0], 5.0)
    cif.check_grid(points)
    return spark.createDataFrame([(p,) for p in points], "point double")
