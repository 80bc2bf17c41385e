"""Queries over survival rows and aggregates: metrics, splits, resampling, hazards, features, medication and laboratory tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.operators import aggregates, cif, cox, features, metrics, resample, survival
from timberline.operators.staging import quantile_table
from timberline.plans.bindings import role, with_roles
from timberline.plans.cohort_queries import _AJ
from timberline.plans.registry import query, r6

TAU = 3.0
_G = """, cens as (select route, time, sum(count(*)) over (partition by route order by time desc) as n, count(*) filter (where event = 0) as c from surv group by route, time),
km as (select route, time, product(1 - c::double / n) over (partition by route order by time) as g from cens where c > 0),
wt as (select s.*, event <> 0 and time <= 3 as had, (time > 3 or (time >= 3 - 1e-9 and event = 0)) and not (time <= 3 and event <> 0) as fr,
  coalesce((select min(k.g) from km k where k.route = s.route and k.time < least(s.time, 3.0)), 1) as g from surv s),
scored as (select *, case when had and event = 1 then 1.0::double else 0.0::double end as y, had or fr as known, case when (had or fr) and g > 0 then 1 / g else 0 end as w from wt)"""
_W = with_roles("surv") + _G


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.with_ipcw(role(spark, sf_dir, "surv"), TAU, ["route"])


@query(_W + " select row_id, y, known, round(w, 6) as w from scored")
def k1_k2_c14_outcome_and_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("row_id", "y", "known", r6("w"))


@query(_W + " select route, round(sum(w) ** 2 / sum(w * w), 3) as ess, round(max(w), 6) as max_w, round(quantile_cont(w, 0.99) filter (where w > 0), 6) as p99_w, count(*) filter (where w = 0) as n_zero from scored group by route")
def k2_weight_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.weight_summary(scored(spark, sf_dir), ["route"]).select("route", F.round("ess", 3).alias("ess"), r6("max_w"), r6("p99_w"), "n_zero")


_MARGINAL = """, tt as (select route, time, sum(count(*)) over (partition by route order by time desc) as n, count(*) filter (where event <> 0) as d, count(*) filter (where event = 1) as d1 from surv group by route, time),
ev as (select *, product(1 - d::double / n) over (partition by route order by time) as s from tt where d > 0),
cv as (select *, coalesce(lag(s) over (partition by route order by time), 1) as sb from ev), marg as (select route, sum(sb * d1 / n) as obs from cv where time <= 3 group by route)"""


def marginal(rows: DataFrame) -> DataFrame:
    curve = survival.at_horizons(survival.aalen_johansen(rows, ["route"]), ["route"], [TAU], rows)
    return curve.select("route", F.col("cif1").alias("observed"))


@query(_W + _MARGINAL + """ select s.route, round(sum(w * (y - pred) ** 2) / count(*), 6) as brier, round(sum(w * (y - obs) ** 2) / count(*), 6) as brier_null, round(1 - sum(w * (y - pred) ** 2) / sum(w * (y - obs) ** 2), 6) as ipa,
  round(any_value(obs) - avg(pred), 6) as observed_minus_predicted from scored s join marg m on s.route = m.route group by s.route""")
def k3_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    return metrics.brier(rows, marginal(rows), ["route"]).select("route", r6("brier"), r6("brier_null"), r6("ipa"), r6("observed_minus_predicted"))


@query(_W + """, cs as (select route, pred as p, sum(w) filter (where y = 1) as cw, sum(w) filter (where y = 0 and known) as kw from scored group by route, pred),
x as (select *, sum(coalesce(kw, 0)) over (partition by route order by p) - 0.5 * coalesce(kw, 0) as below from cs)
select route, round(sum(cw * below) / (sum(cw) * sum(kw)), 6) as auc from x group by route""")
def k9_weighted_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auc(scored(spark, sf_dir), ["route"]).select("route", r6("auc"))


@query()
def k4_logistic_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.logistic_calibration(scored(spark, sf_dir), ["route"])


@query(_W + """ select route, round((sum(w * pred * y) - sum(w * pred) * sum(w * y) / sum(w)) / (sum(w * pred * pred) - sum(w * pred) ** 2 / sum(w)), 6) as slope_probability from scored where w > 0 group by route""")
def k5_probability_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.slope_on_probability(scored(spark, sf_dir), ["route"]).select("route", r6("slope_probability"))


_BINS = """, kn as (select * from scored where w > 0), ed as (select route, list_distinct(quantile_cont(pred, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) as e from kn group by route),
bn as (select k.*, greatest(least(len(list_filter(e, lambda x: x <= pred)) - 1, len(e) - 2), 0) as bin from kn k join ed on k.route = ed.route)"""


@query(_W + _BINS + """, bb as (select route, bin, sum(w) as v, sum(w * pred) / sum(w) as pk, sum(w * y) / sum(w) as yk, sum(w * pred * pred) as vpp, sum(w * pred * y) as vpy, sum(w * (pred - y) ** 2) as bs from bn group by route, bin),
b2 as (select *, sum(v) over (partition by route) as t, sum(v * yk) over (partition by route) / sum(v) over (partition by route) as yb from bb)
select route, round(sum(bs / t), 6) as brier_normalised, round(sum(v / t * (pk - yk) ** 2), 6) as reliability, round(sum(v / t * (yk - yb) ** 2), 6) as resolution, round(any_value(yb) * (1 - any_value(yb)), 6) as uncertainty,
  round(sum((vpp - v * pk ** 2) / t), 6) as within_bin_variance, round(sum(-2 * (vpy - v * pk * yk) / t), 6) as within_bin_covariance, count(*) as n_bins from b2 group by route""")
def k6_brier_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.brier_decomposition(scored(spark, sf_dir), ["route"])
    return out.select("route", *(r6(c) for c in ("brier_normalised", "reliability", "resolution", "uncertainty", "within_bin_variance", "within_bin_covariance")), "n_bins")


@query(with_roles("surv") + """, ed as (select list_distinct(quantile_cont(pred, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) as e from surv),
bn as (select s.*, greatest(least(len(list_filter(e, lambda x: x <= pred)) - 1, len(e) - 2), 0) as bin from surv s, ed),
tt as (select bin, time, sum(count(*)) over (partition by bin order by time desc) as n, count(*) filter (where event <> 0) as d, count(*) filter (where event = 1) as d1 from bn group by bin, time),
ev as (select *, product(1 - d::double / n) over (partition by bin order by time) as s from tt where d > 0),
cv as (select *, coalesce(lag(s) over (partition by bin order by time), 1) as sb from ev), ob as (select bin, sum(sb * d1 / n) as o from cv where time <= 3 group by bin)
select b.bin, count(*) as n, round(avg(pred), 6) as mean_predicted, round(coalesce(any_value(o), 0), 6) as observed from bn b left join ob on ob.bin = b.bin group by b.bin having count(*) >= 5""")
def k7_binned_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.quantile_bins(role(spark, sf_dir, "surv"), 10)
    observed = survival.at_horizons(survival.aalen_johansen(rows, ["bin"]), ["bin"], [TAU], rows).select("bin", F.col("cif1").alias("o"))
    out = rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("pred").alias("p")).filter("n >= 5").join(observed, "bin")
    return out.select("bin", "n", r6("p", "mean_predicted"), r6("o", "observed"))


_NB = "round(sum(w * a * (y - (1 - y) * t / (1 - t))) / count(*), 6) as net_benefit, round(avg(a), 6) as alert_rate, round(sum(w * a * y) / sum(w * y), 6) as sensitivity, round(sum(w * (1 - a) * (1 - y)) / sum(w * (1 - y)), 6) as specificity, round(sum(w * a * y) / sum(w * a), 6) as ppv"


@query(_W + f" select route, t as threshold, {_NB} from (select s.*, t, case when pred >= t then 1.0::double else 0.0::double end as a from scored s, (select unnest([0.05::double, 0.1::double, 0.2::double, 0.3::double]) as t)) group by route, t")
def k12_decision_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.net_benefit(scored(spark, sf_dir), [0.05, 0.1, 0.2, 0.3], group=["route"])
    return out.select("route", "threshold", r6("net_benefit"), r6("alert_rate"), r6("sensitivity"), r6("specificity"), r6("ppv"))


_STATUS = "case when row_id % 5 = 0 then 'indeterminate' when row_id % 3 = 0 then 'positive' else 'negative' end"


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).withColumn("status", F.expr(_STATUS))


@query(_W + f""", cm as (select *, {_STATUS} as status from scored), c2 as (select *, 1.0::double / count(*) over (partition by patient_id) as per, (status = 'positive')::int as r, (pred >= 0.3)::int as m from cm where status <> 'indeterminate'),
nb as (select population, strategy, sum(q * w * a * (y - (1 - y) * 0.3::double / 0.7::double)) / sum(q) as nb from (
  select y, w, strategy, population, case strategy when 'rule_only' then r when 'model_only' then m when 'rule_or_model' then greatest(r, m) when 'assess_all' then 1 else 0 end as a, case population when 'pooled_landmark' then 1 else per end as q
  from c2, (select unnest(['rule_only', 'model_only', 'rule_or_model', 'assess_all', 'assess_none']) as strategy), (select unnest(['pooled_landmark', 'patient_balanced']) as population)) group by all)
select population, strategy, round(nb, 6) as net_benefit, round(nb - max(nb) filter (where strategy = 'rule_only') over (partition by population), 6) as increment_vs_rule, round(nb - max(nb) filter (where strategy = 'model_only') over (partition by population), 6) as increment_vs_model from nb""")
def k13_paired_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.paired_strategies(_paired(spark, sf_dir), 0.3)
    return out.select("population", "strategy", r6("net_benefit"), r6("increment_vs_rule"), r6("increment_vs_model"))


@query(_W + f", cm as (select *, {_STATUS} as status from scored) select count(*) as n_total, count(*) filter (where status <> 'indeterminate') as n_common, 0 as n_rule_only, count(*) filter (where status = 'indeterminate') as n_model_only, 0 as n_neither, count(*) filter (where status = 'positive') as n_rule_positive from cm")
def k13_pairing_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pairing_coverage(_paired(spark, sf_dir))


@query(_W + " select route, count(distinct patient_id) filter (where y = 1 and known) as case_patients, count(distinct patient_id) filter (where y = 0 and known) as control_patients, count(*) filter (where y = 1 and known) as case_rows, count(*) filter (where time >= 3 - 1e-9 and not (time <= 3 and event <> 0)) as rows_observed_through_horizon from scored group by route")
def d13_horizon_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.horizon_counts(scored(spark, sf_dir), TAU, ["route"])


@query(_W + """, g as (select valve_age_years, count(distinct patient_id) filter (where y = 1 and known) as ca, count(distinct patient_id) filter (where y = 0 and known) as co, count(*) filter (where time >= 3 - 1e-9 and not (time <= 3 and event <> 0)) as th from scored group by 1)
select valve_age_years, case when th < 50 then 'insufficient_followup' when ca < 40 or co < 40 then 'insufficient_events' else 'ok' end as gate_status from g""")
def k11_metric_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = metrics.horizon_counts(scored(spark, sf_dir), TAU, ["valve_age_years"])
    gates = {"metric_min_event_patients": 40, "metric_min_control_patients": 40, "slope_min_events": 60, "min_at_risk": 50}
    return metrics.metric_gate(counts, F.lit(1.0), gates).select("valve_age_years", "gate_status")


@query(_W + " select route, count(*) as rows, count(*) filter (where known) as rows_valid, round(avg(known::int), 6) as row_coverage, count(distinct patient_id) as patients, count(distinct patient_id) filter (where known) as patients_with_valid_rows from scored group by route")
def d12_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.coverage(scored(spark, sf_dir), F.col("known"), ["route"]).withColumn("row_coverage", r6("row_coverage"))


@query(with_roles("surv") + """, c as (select route, time, pred, count(*) as n, count(*) filter (where event <> 0) as d from surv group by all),
j as (select a.route, a.d * case when b.time = a.time then b.n - b.d else b.n end as w, case when a.pred > b.pred then 1.0::double when a.pred = b.pred then 0.5::double else 0.0::double end as s from c a join c b on a.route = b.route and b.time >= a.time where a.d > 0)
select route, round(sum(w * s) / sum(w), 6) as concordance from j group by route""")
def k16_concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.concordance(role(spark, sf_dir, "surv"), ["route"]).select("route", r6("concordance"))


_RANKS = "ranks as (select patient_id, row_number() over (order by upper(md5('{seed}:' || patient_id)) || '-' || patient_id) - 1 as rank from (select distinct patient_id from surv))"


@query(with_roles("surv") + f", {_RANKS.format(seed=0)} select patient_id, cast(rank % 5 as int) as fold from ranks")
def l1_patient_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.patient_folds(role(spark, sf_dir, "surv"), 5)


_DRAWS = "draws as (select r.i // n as rep, ('0x' || substr(md5('1:' || r.i), 1, 15))::bigint % n as rank from (select count(*) as n from ranks), range({reps} * (select count(*) from ranks)) as r(i)), picks as (select rep, rank, count(*) as k from draws group by all)"


@query(_W + f""", {_RANKS.format(seed=0)}, {_DRAWS.format(reps=20)}, sums as (select patient_id, sum(w * (y - pred) ** 2) as a, count(*) as b from scored group by patient_id)
select cast(rep as int) as rep, round(sum(k * a) / sum(k * b), 6) as brier from picks join ranks using (rank) join sums using (patient_id) group by rep""")
def l3_bootstrap_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brier score of 20 patient bootstraps, from per-patient sums."""
    rows = scored(spark, sf_dir)
    return resample.bootstrap_ratio(rows, F.col("w") * (F.col("y") - F.col("pred")) ** 2, F.lit(1), 20, out="brier").withColumn("brier", r6("brier"))


@query(_W + f""", {_RANKS.format(seed=0)}, {_DRAWS.format(reps=50)}, sums as (select patient_id, sum(w * ((y - pred) ** 2 - (y - pred2) ** 2)) as a, count(*) as b from scored group by patient_id),
reps as (select rep, sum(k * a) / sum(k * b) as d from picks join ranks using (rank) join sums using (patient_id) group by rep)
select round((select sum(a) / sum(b) from sums), 6) as difference, round((select quantile_cont(d, 0.025) from reps), 6) as ci_low, round((select quantile_cont(d, 0.975) from reps), 6) as ci_high, (select count(*) from sums) as patients""")
def k14_paired_brier_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.paired_brier_difference(scored(spark, sf_dir), "pred", "pred2", 50)
    return out.select(r6("difference"), r6("ci_low"), r6("ci_high"), "patients")


@query(with_roles("studies") + """, d as (select patient_id, date, lead(date) over (partition by patient_id order by date) as nx from (select distinct patient_id, date from studies))
select patient_id, date as landmark_date, round(greatest(case when nx is not null then datediff('day', date, nx) / 365.25::double else 0.5::double end, 1.0::double / 52), 6) as gap, case when nx is not null then 1.0::double else 0.0::double end as visit from d""")
def e6_visit_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = role(spark, sf_dir, "studies").select("patient_id", F.col("date").alias("landmark_date")).distinct().withColumn("time", F.lit(0.5))
    return resample.gap_table(rows).select("patient_id", "landmark_date", r6("gap"), "visit")


_HAZ = "0.03::double * (1 + pred) * t as h1, 0.11::double * (1 + pred2) * t as h2, 0.004::double * t * t as h3"


def hazard_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[float]]:
    grid = [0.0, 0.5, 1.0, 2.0, 3.0, 5.0]
    rows = role(spark, sf_dir, "surv")
    points = F.array(*map(F.lit, grid))
    return rows.select(
        "row_id",
        F.transform(points, lambda t: 0.03 * (1 + F.col("pred")) * t).alias("svd"),
        F.transform(points, lambda t: 0.11 * (1 + F.col("pred2")) * t).alias("death"),
        F.transform(points, lambda t: 0.004 * t * t).alias("replacement"),
    ), grid


@query(with_roles("surv") + f""", g as (select row_id, t, {_HAZ} from surv, (select unnest([0.0::double, 0.5::double, 1.0::double, 2.0::double, 3.0::double, 5.0::double]) as t)),
i as (select *, h1 - lag(h1) over w as d1, h2 - lag(h2) over w as d2, h3 - lag(h3) over w as d3, exp(-(h1 + h2 + h3)) as s, lag(exp(-(h1 + h2 + h3))) over w as sp from g window w as (partition by row_id order by t)),
f as (select *, sp * (1 - exp(-(d1 + d2 + d3))) / (d1 + d2 + d3) as k from i), c as (select row_id, t, s, sum(k * d1) over w as f1, sum(k * d2) over w as f2, sum(k * d3) over w as f3 from f window w as (partition by row_id order by t))
select row_id, t as horizon, round(s, 6) as alive_intact, round(f1, 6) as svd, round(f2, 6) as death, round(f3, 6) as replacement from c where t in (1, 3, 5)""")
def j1_j3_j4_state_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, grid = hazard_rows(spark, sf_dir)
    out = cif.at_horizons(cif.combine(rows), grid, [1.0, 3.0, 5.0])
    return out.select("row_id", "horizon", r6("alive_intact"), r6("svd"), r6("death"), r6("replacement"))


@query(with_roles("surv") + f""", g as (select row_id, t, {_HAZ} from surv, (select unnest([0.0::double, 0.5::double, 1.0::double, 2.0::double, 3.0::double, 5.0::double]) as t)),
i as (select *, h1 - lag(h1) over w as d1, (h1 + h2 + h3) - lag(h1 + h2 + h3) over w as d from g window w as (partition by row_id order by t)),
p as (select *, product(1 - coalesce(d, 0)) over (partition by row_id order by t) as s from i)
select row_id, round(max(s) filter (where t = 5), 6) as alive_intact from p group by row_id""")
def j5_product_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, grid = hazard_rows(spark, sf_dir)
    out = cif.at_horizons(cif.product_limit(rows), grid, [5.0])
    return out.select("row_id", r6("alive_intact"))


@query(with_roles("surv") + f""", g as (select row_id, t, {_HAZ} from surv, (select unnest([0.0::double, 0.5::double, 1.0::double, 2.0::double, 3.0::double, 5.0::double]) as t)),
i as (select *, coalesce(h1 - lag(h1) over w, 0) as d1, coalesce(h2 - lag(h2) over w, 0) as d2, coalesce(h3 - lag(h3) over w, 0) as d3, exp(-(h1 + h2 + h3)) as s, coalesce(lag(exp(-(h1 + h2 + h3))) over w, 1) as sp from g window w as (partition by row_id order by t)),
p as (select *, product(1 - (d1 + d2 + d3)) over (partition by row_id order by t) as ps, case when d1 + d2 + d3 > 0 then sp * (1 - exp(-(d1 + d2 + d3))) / (d1 + d2 + d3) else 0 end as k from i), q as (select *, coalesce(lag(ps) over (partition by row_id order by t), 1) as pp from p),
c as (select *, sum(k * d1) over w as f1, sum(pp * d1) over w as e1, sum(k * d2) over w as f2, sum(pp * d2) over w as e2, sum(k * d3) over w as f3, sum(pp * d3) over w as e3 from q window w as (partition by row_id order by t)),
l as (select 'S' as state, abs(s - ps) as d from c union all select 'F_svd', abs(f1 - e1) from c union all select 'F_death', abs(f2 - e2) from c union all select 'F_replacement', abs(f3 - e3) from c)
select state, round(max(d), 6) as max_difference, round(avg(d), 6) as mean_difference from l group by state""")
def j5_convention_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the product-limit convention is from the exponential one, over all rows and grid points."""
    out = cif.convention_differences(hazard_rows(spark, sf_dir)[0])
    return out.select("state", r6("max_difference"), r6("mean_difference"))


@query(with_roles("surv") + f", g as (select row_id, pred, pred2 from surv) select row_id, 'svd' as cause, 'decreasing' as rule from g where pred > 0.9")
def j2_hazard_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a high score get a hazard that falls once; the contract check finds exactly these."""
    rows, grid = hazard_rows(spark, sf_dir)
    broken = role(spark, sf_dir, "surv").select("row_id", "pred")
    rows = rows.join(broken, "row_id").withColumn("svd", F.when(F.col("pred") > 0.9, F.transform("svd", lambda x, i: F.when(i == 4, x / 2).otherwise(x))).otherwise(F.col("svd")))
    return cif.hazard_violations(rows, cif.CAUSE_NAMES, len(grid))


@query()
def i5_i11_cause_specific_cox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Penalised cause-specific models fitted by distributed Newton steps, then probabilities at 1, 3 and 5 years."""
    rows = role(spark, sf_dir, "surv")
    causes = {"svd": 1, "death": 2}  # these tables hold no replacements
    model = cox.CauseSpecificCox(["pred", "pred2", "valve_age_years"], causes=causes).fit(rows)
    grid = cif.build_grid([0.25 * k for k in range(1, 25)], [1.0, 3.0, 5.0], 6.0)
    hazards = model.hazards(rows, grid).filter("support = ''").select("row_id", *causes)
    return cif.at_horizons(cif.combine(hazards, list(causes)), grid, [1.0, 3.0, 5.0], list(causes))


@query(with_roles("patients") + """ , m as (select quantile_cont(bmi, 0.5) as med from patients), f as (select p.*, coalesce(bmi, med) as b from patients p, m), s as (select avg(b) as mu, stddev_pop(b) as sd, avg(age_at_implant) as ma, stddev_pop(age_at_implant) as sa from f)
select patient_id, round((b - mu) / sd, 6) as bmi, (bmi is null)::int::double as bmi__missing, round((age_at_implant - ma) / sa, 6) as age_at_implant, (sex = 'F')::int::double as "sex__F", (sex = 'M')::int::double as "sex__M", 0.0::double as sex__other from f, s""")
def h2_h3_h6_feature_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = role(spark, sf_dir, "patients")
    out = features.FeaturePipeline(numeric=["bmi", "age_at_implant"], categorical=["sex"]).fit(rows).transform(rows, keep=["patient_id"])
    return out.select("patient_id", r6("bmi"), "bmi__missing", r6("age_at_implant"), "sex__F", "sex__M", "sex__other")


def _next_degree(d: int) -> str:
    """B-splines of degree d from those below, as a list per row."""
    return f"(select row_id, x, t, f, v, list_transform(range(1, {10 - d}), lambda i: (v - f[i]) / (f[i + {d}] - f[i]) * l[i] + (f[i + {d + 1}] - v) / (f[i + {d + 1}] - f[i + 1]) * l[i + 1]) as l from l{d - 1})"


_RCS = "round((pow(greatest(x - t[{k}], 0), 3) - pow(greatest(x - t[3], 0), 3) * (t[4] - t[{k}]) / (t[4] - t[3]) + pow(greatest(x - t[4], 0), 3) * (t[3] - t[{k}]) / (t[4] - t[3])) / (t[4] - t[1]) ** 2, 6)"


@query(with_roles("surv") + f""", k as (select quantile_cont(pred, [0.05, 0.35, 0.65, 0.95]) as t from surv),
g as (select row_id, pred as x, t, [t[1] - 3 * (t[2] - t[1]), t[1] - 2 * (t[2] - t[1]), t[1] - (t[2] - t[1]), t[1], t[2], t[3], t[4], t[4] + (t[4] - t[3]), t[4] + 2 * (t[4] - t[3]), t[4] + 3 * (t[4] - t[3])] as f, greatest(least(pred, t[4]), t[1]) as v from surv, k),
l0 as (select *, list_transform(range(1, 10), lambda i: case when i <= 6 and v >= f[i] and (v < f[i + 1] or (i = 6 and v <= f[i + 1])) then 1.0::double else 0.0::double end) as l from g),
l1 as {_next_degree(1)}, l2 as {_next_degree(2)}, l3 as {_next_degree(3)}
select row_id, round(x, 6) as b0, {_RCS.format(k=1)} as b1, {_RCS.format(k=2)} as b2, {", ".join(f"round(l[{i}], 6) as b{i + 1}" for i in range(2, 7))} from l3""")
def h4_h7_spline_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = role(spark, sf_dir, "surv")
    knots = quantile_table(rows, {"pred": F.col("pred")}, features.RCS_QUANTILES[4])["pred"]
    basis = features.rcs_basis(F.col("pred"), knots) + features.bspline_basis(F.col("pred"), knots)
    return rows.select("row_id", *(r6(b, f"b{i}") for i, b in enumerate(basis)))


@query(with_roles("surv") + " select 'pred' as marker, 1.0::double as patient_share, 1.0::double as row_share, count(distinct pred) as n_distinct, null::varchar as reason from surv union all select 'rare', count(distinct patient_id) filter (where row_id % 97 = 0) / count(distinct patient_id), round(avg((row_id % 97 = 0)::int), 6), count(distinct row_id) filter (where row_id % 97 = 0), 'below_cutoff' from surv")
def d9_marker_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = role(spark, sf_dir, "surv").withColumn("rare", F.when(F.col("row_id") % 97 == 0, F.col("row_id")))
    out = features.marker_eligibility(rows, ["pred", "rare"], least_patients=0.5)
    return out.select("marker", "patient_share", r6("row_share"), "n_distinct", "reason")


@query(with_roles("surv") + ", c as (select coalesce(route, 'missing') as level, count(distinct patient_id) filter (where event = 1) as event_patients from surv group by 1) select level, event_patients, (select count(*) from c where event_patients >= 20) >= 2 and event_patients >= 20 as kept from c")
def d10_event_count_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.event_count_rule(role(spark, sf_dir, "surv"), "route", 20)


@query(with_roles("surv") + " select route, cause, count(distinct patient_id) filter (where event = code) as event_patients, count(*) filter (where event = code) as event_rows from surv, (select unnest(['svd', 'death', 'replacement']) as cause, unnest([1, 2, 3]) as code) group by route, cause")
def d7_event_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.event_support(role(spark, sf_dir, "surv"), ["route"])


@query(with_roles("surv") + " select route, event, count(*) as n, case when count(*) < 5 then '<5' else cast(count(*) as varchar) end as shown from surv group by grouping sets ((route), (route, event), (event))")
def d22_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.grouped_counts(role(spark, sf_dir, "surv"), [["route"], ["route", "event"], ["event"]])


_YEARS = """, er as (select patient_id, class, year(start_date) as sy, year(stop_date) as ey from exposures), ys as (select distinct patient_id, class, unnest(range(sy, greatest(sy, least(coalesce(ey, sy), sy + 30)) + 1)) as year from er)"""


def exposure_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = role(spark, sf_dir, "exposures")
    return e.select("patient_id", "class", F.year("start_date").alias("start_year"), F.year("stop_date").alias("end_year"), F.lit(None).cast("int").alias("discontinued_year"))


@query(with_roles("exposures") + _YEARS + " select patient_id, year, max((class = 'VKA')::int) as \"VKA\", max((class = 'FXa')::int) as \"FXa\", max((class = 'DTI')::int) as \"DTI\" from ys group by patient_id, year")
def d3_exposure_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.exposure_grid(aggregates.exposure_years(exposure_records(spark, sf_dir)), ["VKA", "FXa", "DTI"])


@query(with_roles("exposures") + _YEARS + " select year, class, count(distinct patient_id) as n_patients, case when count(distinct patient_id) < 5 then '<5' else cast(count(distinct patient_id) as varchar) end as shown from ys group by year, class")
def d2_patients_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.patients_per_year(aggregates.exposure_years(exposure_records(spark, sf_dir)))


@query(with_roles("exposures") + _YEARS + """, d as (select patient_id, class, count(distinct year) as n from ys group by all), b as (select class, case when n <= 1 then '(0,1]' when n <= 3 then '(1,3]' when n <= 4 then '(3,4]' else '(4,1000]' end as bin from d)
select class, bin, count(*) as n_patients, case when count(*) < 5 then '<5' else cast(count(*) as varchar) end as shown from b group by all""")
def d4_b9_exposure_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.duration_distribution(aggregates.exposure_duration(aggregates.exposure_years(exposure_records(spark, sf_dir))))


@query(with_roles("labs", "exposures") + " select patient_id, year(date) as year, round_even(100 * avg((value between 10 and 30)::int), 1) as pct_in_range, count(value) as n_values from labs where patient_id in (select patient_id from exposures where class = 'VKA') group by all")
def d5_time_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    labs, exposures = role(spark, sf_dir, "labs"), role(spark, sf_dir, "exposures")
    return aggregates.time_in_range(labs, exposures.filter("class = 'VKA'"), 10, 30)


@query(with_roles("labs") + """, m as (select patient_id, year(date) as year, unnest(list_filter([case when regexp_matches(analyte, 'egfr') then 'kidney' end, case when regexp_matches(analyte, 'hb|egfr') then 'basic' end], lambda x: x is not null)) as lab from labs where analyte <> 'ldh')
select lab, year, count(distinct patient_id) as n_patients from m group by grouping sets ((lab, year), (lab))""")
def d6_lab_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.lab_availability(role(spark, sf_dir, "labs").withColumnRenamed("analyte", "component"), {"kidney": "egfr", "basic": "hb|egfr"}, "^ldh$")


@query(with_roles("surv") + " , v as (select time, event from surv where event < 2) select cast(round_even(time, 0) as int) as year, count(*) as scheduled, count(*) filter (where event = 1) as attended from v group by 1")
def d14_attendance(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = role(spark, sf_dir, "surv").select(F.col("time").alias("years"), (F.col("event") == 1).alias("attended"), (F.col("event") < 2).alias("eligible"))
    return aggregates.attendance_by_year(v)


@query(with_roles("patients") + " select 'bmi' as feature, cast(quantile_cont(bmi, 0.5) as varchar) as value from patients union all (select 'sex', sex from patients group by sex order by count(*) desc, sex limit 1)")
def d19_reference_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.reference_profile(role(spark, sf_dir, "patients"), ["bmi"], ["sex"])


@query(with_roles("surv") + """, base as (select *, case when valve_age_years < 5 then '<5' else '>=5' end as cell from surv),
long as (select route || '|' || cell as g, time, event from base union all select route, time, event from base union all select 'all', time, event from base), sizes as (select g, count(*) as n from long group by g)"""
  + _AJ.format(g="g", t="long").replace("select pts.g as route, h as horizon", ", curve as (select pts.g as route, h as horizon", 1) + """),
picked as (select distinct b.route, b.cell, case when s1.n >= 30 then b.route || '|' || b.cell when s2.n >= 30 then b.route else 'all' end as g from base b join sizes s1 on s1.g = b.route || '|' || b.cell join sizes s2 on s2.g = b.route)
select p.route, p.cell, c.horizon, c.cif1, c.cif2, c.cif3, c.survival from picked p join curve c on c.route = p.g where c.horizon < 5""")
def i14_calendar_comparator(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = survival.calendar_comparator(role(spark, sf_dir, "surv"), [1.0, 3.0])
    return out.select("route", "cell", "horizon", *(r6(c) for c in ("cif1", "cif2", "cif3", "survival")))


@query(with_roles("surv") + """, a as (select row_id, route, valve_age_years as t0, valve_age_years + 6 as t_end, valve_age_years + pred * 8 as crossing, case when row_id % 3 > 0 then valve_age_years + pred2 * 9 end as da, case when row_id % 4 > 0 then valve_age_years + pred2 * 9.5::double + 0.2::double end as db, 1 + row_id % 6 as na, 1 + row_id % 5 as nb, 1 + pred as yrs from surv),
h as (select *, coalesce(crossing > t0 and crossing < t_end and da >= crossing, false) as ha, coalesce(crossing > t0 and crossing < t_end and db >= crossing, false) as hb from a)
select route, count(*) as patients, count(*) filter (where ha and hb) as both_detected, count(*) filter (where ha and not hb) as only_policy, count(*) filter (where hb and not ha) as only_reference,
  round(avg((db - da) * 12) filter (where ha and hb), 6) as lead_mean_months, round(quantile_cont((db - da) * 12, 0.5) filter (where ha and hb), 6) as lead_median_months, round(1000 * sum(na) / sum(yrs) - 1000 * sum(nb) / sum(yrs), 4) as extra_echoes_per_1000py from h group by route""")
def k18_paired_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guided against plain surveillance of the same patients (here: the same survival rows under two policies)."""
    s = role(spark, sf_dir, "surv")
    common = [F.col("row_id").alias("patient_id"), "route", F.col("valve_age_years").alias("t0"), (F.col("valve_age_years") + 6).alias("t_end"), (F.col("valve_age_years") + F.col("pred") * 8).alias("crossing"), (1 + F.col("pred")).alias("surveillance_years")]
    a = s.select(*common, F.lit("guided").alias("policy"), F.when(F.col("row_id") % 3 > 0, F.col("valve_age_years") + F.col("pred2") * 9).alias("detect"), (1 + F.col("row_id") % 6).alias("n_echoes"))
    b = s.select(*common, F.lit("plain").alias("policy"), F.when(F.col("row_id") % 4 > 0, F.col("valve_age_years") + F.col("pred2") * 9.5 + 0.2).alias("detect"), (1 + F.col("row_id") % 5).alias("n_echoes"))
    out = metrics.paired_policies(a.unionByName(b), "guided", "plain", ["route"])
    return out.withColumns({"lead_mean_months": r6("lead_mean_months"), "lead_median_months": r6("lead_median_months"), "extra_echoes_per_1000py": F.round("extra_echoes_per_1000py", 4)})


@query(with_roles("surv", "patients", "terminal") + """, r as (select row_id as id, patient_id % 5 as p, case when patient_id % 2 = 0 then 'TAVR' else 'SAVR' end as route, valve_age_years as t0, valve_age_years + 6 as t_end, valve_age_years + pred * 8 as crossing, case when row_id % 3 > 0 then valve_age_years + pred2 * 9 end as detect, 1 + row_id % 6 as n_echoes, 1 + pred as yrs, row_id % 2 as alerts from surv),
d as (select *, crossing > t0 and crossing < t_end as cr, coalesce(crossing > t0 and crossing < t_end and detect >= crossing, false) as td from r),
e as (select *, case when td then (detect - crossing) * 12 end as delay, detect is not null and not td as early from d)
select p as policy, case when grouping(route) = 1 then 'all' else route end as route, count(*) as patients, count(*) filter (where cr) as crossers, count(*) filter (where td) as detected, round(quantile_cont(delay, 0.5), 6) as delay_median_months, round(quantile_cont(delay, 0.9), 6) as delay_p90_months,
  count(*) filter (where early) as early_positives, round(1000 * sum(n_echoes) / sum(yrs), 4) as echoes_per_1000py from e group by grouping sets ((p), (p, route))""")
def k18_policy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = role(spark, sf_dir, "surv")
    r = s.select(
        (F.col("patient_id") % 5).alias("policy"), "route", F.col("valve_age_years").alias("t0"), (F.col("valve_age_years") + 6).alias("t_end"), (F.col("valve_age_years") + F.col("pred") * 8).alias("crossing"),
        F.when(F.col("row_id") % 3 > 0, F.col("valve_age_years") + F.col("pred2") * 9).alias("detect"), (1 + F.col("row_id") % 6).alias("n_echoes"), (1 + F.col("pred")).alias("surveillance_years"), (F.col("row_id") % 2).alias("alerts"),
    )
    out = metrics.policy_summary(r)
    return out.select("policy", "route", "patients", "crossers", "detected", r6("delay_median_months"), r6("delay_p90_months"), "early_positives", F.round("echoes_per_1000py", 4).alias("echoes_per_1000py"))


@query(with_roles("patients") + " select patient_id, route, unnest(list_filter(case when route = 'SAVR' then [5.0::double] || list_transform(range(0, 90), lambda k: 10.0::double + k) else list_transform(range(1, 100), lambda k: 0.5::double + k) end, lambda t: t > 0.5 + 1e-9 and t < 10 + bsa)) as visit_time from patients")
def k19_visit_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = role(spark, sf_dir, "patients").withColumn("t0", F.lit(0.5)).withColumn("t_end", 10 + F.col("bsa"))
    return metrics.visit_schedule(p, "acc_aha")
