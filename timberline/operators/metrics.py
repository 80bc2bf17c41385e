"""Evaluation under censoring: scores, calibration, discrimination, decisions. All take a list of group columns; rows come
with pred, and y, known and w from :func:`timberline.operators.survival.with_ipcw`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.operators import resample
from timberline.operators.replicates import replicate_intervals
from timberline.operators.staging import broadcast_if_small, equal_keys, exact_quantiles, prefix_sum, stage

EPS_LOGIT = 1e-6


def _keyed(df: DataFrame, group: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Windows and joins want at least one key."""
    return (df, list(group)) if group else (df.withColumn("__all", F.lit(1)), ["__all"])


def logit(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - EPS_LOGIT)), F.lit(EPS_LOGIT))
    return F.log(q / (1 - q))


def weight_summary(rows: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Effective sample size, largest and 99th percentile positive weight, rows without weight."""
    pos = F.when(F.col("w") > 0, F.col("w"))
    sums = rows.groupBy(*group).agg((F.sum(pos) ** 2 / F.sum(pos**2)).alias("ess"), F.max(pos).alias("max_w"), F.sum((F.col("w") == 0).cast("long")).alias("n_zero"))
    p99 = exact_quantiles(rows, {"w": pos}, [0.99], group).select(*(F.col(g).alias(f"__{g}") for g in group), F.col("q")[0].alias("p99_w"))
    return sums.join(p99, equal_keys(group, [f"__{g}" for g in group]), "left").select(*group, "ess", "max_w", "p99_w", "n_zero")


def brier(rows: DataFrame, marginal: DataFrame, group: Sequence[str] = (), weight: str | None = None, pred: str = "pred") -> DataFrame:
    """Brier score, the null score of the marginal incidence, their ratio (IPA) and observed minus predicted.

    ``marginal``: the group columns and ``observed``, the Aalen-Johansen probability at the horizon.
    """
    sw = F.lit(1.0) if weight is None else F.col(weight)
    m = marginal.select(*(F.col(g).alias(f"__{g}") for g in group), "observed")
    if group:
        joined = rows.join(broadcast_if_small(m, name="marginal"), equal_keys(group, [f"__{g}" for g in group]), "left")
    else:
        joined = rows.crossJoin(F.broadcast(m.limit(1)))
    loss = lambda p: F.sum(sw * F.col("w") * (F.col("y") - p) ** 2) / F.sum(sw)
    out = joined.groupBy(*group).agg(loss(F.col(pred)).alias("brier"), loss(F.col("observed")).alias("brier_null"), F.first("observed").alias("observed"), F.avg(pred).alias("mean_predicted"), F.count("*").alias("n"))
    return out.withColumn("ipa", 1 - F.col("brier") / F.col("brier_null")).withColumn("observed_minus_predicted", F.col("observed") - F.col("mean_predicted"))


def auc(rows: DataFrame, group: Sequence[str] = (), pred: str = "pred") -> DataFrame:
    """Weighted probability that a case scores above a control, ties one half; from prefix sums over distinct scores."""
    rows, keys = _keyed(rows, group)
    case = F.when(F.col("y") == 1, F.col("w")).otherwise(0.0)
    control = F.when((F.col("y") == 0) & F.col("known"), F.col("w")).otherwise(0.0)
    scores = rows.filter(F.col(pred).isNotNull()).groupBy(*keys, F.col(pred).alias("score")).agg(F.sum(case).alias("case"), F.sum(control).alias("control"))
    below = prefix_sum(scores, keys, "score", {"upto": "control"})
    out = below.groupBy(*keys).agg(F.sum(F.col("case") * (F.col("upto") - 0.5 * F.col("control"))).alias("num"), (F.sum("case") * F.sum("control")).alias("den"))
    return out.select(*group, F.when(F.col("den") > 0, F.col("num") / F.col("den")).alias("auc"))


def logistic_calibration(rows: DataFrame, group: Sequence[str] = (), max_iter: int = 50, tol: float = 1e-10, largest: float = 15.0, pred: str = "pred") -> DataFrame:
    """Joint recalibration intercept and slope, and the intercept with the slope fixed at one, by Newton steps whose sums
    for all groups are one grouped aggregate per iteration. The state of the groups is a table, too; nulls are a group."""
    rows, keys = _keyed(rows, group)
    data = stage(rows.filter(F.col("w") > 0).select(*keys, logit(F.col(pred)).alias("x"), "y", "w"), "calibration")
    base = stage(data.groupBy(*keys).agg(F.sum("y").alias("events"), F.count("*").alias("n"), F.var_pop("x").alias("var")), "groups")
    named = [f"__{k}" for k in keys]
    joint, fixed = (_newton(data, base, keys, j, max_iter, tol, largest).select(*(F.col(k).alias(n) for k, n in zip(keys, named, strict=True)), "b0", "b1", "status") for j in (True, False))
    good = F.col("j.status") == "ok"
    out = base.join(joint.alias("j"), equal_keys(keys, [f"j.{n}" for n in named])).join(fixed.alias("f"), equal_keys(keys, [f"f.{n}" for n in named]))
    return out.select(
        *group, F.when(good, F.col("j.b0")).alias("intercept"), F.when(good, F.col("j.b1")).alias("slope"), F.when(F.col("f.status") == "ok", F.col("f.b0")).alias("intercept_offset"),
        F.col("j.status").alias("status"), F.col("events").cast("long").alias("n_events"), (F.col("n") - F.col("events")).cast("long").alias("n_controls"),
    )


def _newton(data: DataFrame, base: DataFrame, keys: Sequence[str], joint: bool, max_iter: int, tol: float, largest: float) -> DataFrame:
    """(keys, b0, b1, status) of each group's logistic fit; with ``joint`` false the slope stays one."""
    status = F.when(F.col("events") == 0, "no_events").when(F.col("events") == F.col("n"), "no_controls")
    if joint:
        status = status.when(F.col("var") < 1e-12, "no_variation")
    state = base.select(*keys, F.lit(0.0).alias("b0"), F.lit(0.0 if joint else 1.0).alias("b1"), status.alias("status"))
    named = [f"__{k}" for k in keys]
    done = state.filter("status is not null")
    moving = stage(state.filter("status is null"), "moving")
    for _ in range(max_iter):
        if moving.isEmpty():
            break
        side = broadcast_if_small(moving.select(*(F.col(k).alias(n) for k, n in zip(keys, named, strict=True)), "b0", "b1"), name="state")
        mu = 1 / (1 + F.exp(-(F.col("b0") + F.col("b1") * F.col("x"))))
        g, h = F.col("w") * (F.col("y") - mu), F.col("w") * mu * (1 - mu)
        sums = data.join(side, equal_keys(keys, named)).groupBy(*keys, "b0", "b1").agg(F.sum(g).alias("g0"), F.sum(g * F.col("x")).alias("g1"), F.sum(h).alias("h00"), F.sum(h * F.col("x")).alias("h01"), F.sum(h * F.col("x") ** 2).alias("h11"))
        det = F.col("h00") * F.col("h11") - F.col("h01") ** 2 if joint else F.col("h00")
        s0 = (F.col("g0") * F.col("h11") - F.col("g1") * F.col("h01")) / det if joint else F.col("g0") / det
        s1 = (F.col("h00") * F.col("g1") - F.col("h01") * F.col("g0")) / det if joint else F.lit(0.0)
        steps = sums.withColumn("solvable", det > 0).withColumn("s0", F.when(F.col("solvable"), s0)).withColumn("s1", F.when(F.col("solvable"), s1))
        b0, b1 = F.col("b0") + F.col("s0"), F.col("b1") + F.col("s1")
        size = F.greatest(F.abs(b0), F.abs(b1)) if joint else F.abs(b0)
        broken = ~F.col("solvable") | F.isnan(b0) | F.isnan(b1) | (size > largest)
        after = F.when(F.coalesce(broken, F.lit(True)), "separation").when(F.greatest(F.abs("s0"), F.abs("s1")) < tol, "ok")
        both = stage(steps.select(*keys, F.coalesce(b0, F.col("b0")).alias("b0"), F.coalesce(b1, F.col("b1")).alias("b1"), after.alias("status")), "moving")
        done = done.unionByName(both.filter("status is not null"))
        moving = both.filter("status is null")
    return done.unionByName(moving.withColumn("status", F.lit("not_converged")))


def slope_on_probability(rows: DataFrame, group: Sequence[str] = (), pred: str = "pred") -> DataFrame:
    """Weighted regression slope of the outcome on the predicted probability."""
    w, x, y = F.col("w"), F.col(pred), F.col("y")
    s = rows.filter("w > 0").groupBy(*group).agg(F.count("*").alias("n"), F.sum(w).alias("s"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * y).alias("sxy"), F.sum(w * x * x).alias("sxx"))
    var = F.col("sxx") - F.col("sx") ** 2 / F.col("s")
    return s.select(*group, F.when((F.col("n") >= 10) & (var > 1e-12), (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("s")) / var).alias("slope_probability"))


def quantile_bins(rows: DataFrame, bins: int, group: Sequence[str] = (), pred: str = "pred") -> DataFrame:
    """Adds ``bin``: the interval between distinct prediction quantiles a row falls into."""
    rows, keys = _keyed(rows, group)
    edges = exact_quantiles(rows, {"pred": F.col(pred)}, [i / bins for i in range(bins + 1)], keys)
    edges = edges.select(*(F.col(k).alias(f"__{k}") for k in keys), F.array_distinct("q").alias("__edges"))
    on = equal_keys(keys, [f"__{k}" for k in keys])
    edges = broadcast_if_small(edges, name="edges")
    at = F.size(F.filter("__edges", lambda e: e <= F.col(pred))) - 1
    return rows.join(edges, on).withColumn("bin", F.greatest(F.least(at, F.size("__edges") - 2), F.lit(0))).drop("__edges", "__all", *(f"__{k}" for k in keys))


def brier_decomposition(rows: DataFrame, group: Sequence[str] = (), bins: int = 10, pred: str = "pred") -> DataFrame:
    """Reliability - resolution + uncertainty + within-bin variance + covariance of the weight-normalised Brier score."""
    known = quantile_bins(rows.filter("w > 0"), bins, group, pred)
    known, keys = _keyed(known, group)
    w, p, y = F.col("w"), F.col(pred), F.col("y")
    by_bin = known.groupBy(*keys, "bin").agg(F.sum(w).alias("v"), F.sum(w * p).alias("vp"), F.sum(w * y).alias("vy"), F.sum(w * p * p).alias("vpp"), F.sum(w * p * y).alias("vpy"), F.sum(w * (p - y) ** 2).alias("bs"))
    whole = Window.partitionBy(*keys)
    b = by_bin.withColumn("t", F.sum("v").over(whole)).withColumn("ybar", F.sum("vy").over(whole) / F.sum("v").over(whole))
    v, pk, yk = F.col("v") / F.col("t"), F.col("vp") / F.col("v"), F.col("vy") / F.col("v")
    out = b.groupBy(*keys).agg(
        F.sum(F.col("bs") / F.col("t")).alias("brier_normalised"),
        F.sum(v * (pk - yk) ** 2).alias("reliability"),
        F.sum(v * (yk - F.col("ybar")) ** 2).alias("resolution"),
        (F.first("ybar") * (1 - F.first("ybar"))).alias("uncertainty"),
        F.sum((F.col("vpp") - F.col("v") * pk**2) / F.col("t")).alias("within_bin_variance"),
        F.sum(-2 * (F.col("vpy") - F.col("v") * pk * yk) / F.col("t")).alias("within_bin_covariance"),
        F.count("*").alias("n_bins"),
    )
    return out.select(*group, *(c for c in out.columns if c not in keys))


def horizon_counts(rows: DataFrame, tau: float, group: Sequence[str] = (), patient: str = "patient_id") -> DataFrame:
    """Case and control patients, case rows, and rows observed event-free through the horizon."""
    case, control = (F.col("y") == 1) & F.col("known"), (F.col("y") == 0) & F.col("known")
    through = (F.col("time") >= tau - 1e-9) & ~((F.col("time") <= tau) & (F.col("event") != 0))
    n = lambda c: F.sum(c.cast("long"))
    return rows.groupBy(*group).agg(F.countDistinct(F.when(case, F.col(patient))).alias("case_patients"), F.countDistinct(F.when(control, F.col(patient))).alias("control_patients"), n(case).alias("case_rows"), n(through).alias("rows_observed_through_horizon"))


def metric_gate(counts: DataFrame, g_at_tau: Column, gates: dict, slope: bool = False) -> DataFrame:
    """``gate_status`` of a metric: ok, or which support it lacks (censoring, follow-up, events, controls)."""
    need = gates["slope_min_events"] if slope else gates["metric_min_event_patients"]
    status = (
        F.when(g_at_tau < gates.get("min_censoring_survival", 0.0), "censoring_support_failure")
        .when(F.col("rows_observed_through_horizon") < gates.get("min_at_risk", 0), "insufficient_followup")
        .when((F.col("case_patients") < need) | (F.col("control_patients") < gates["metric_min_control_patients"]), "insufficient_events")
        .otherwise("ok")
    )
    return counts.withColumn("gate_status", status)


def withhold(metrics: DataFrame, columns: Sequence[str], status: str = "gate_status") -> DataFrame:
    """Metrics without support become NULL; the status stays."""
    return metrics.select(*(F.when(F.col(status) == "ok", F.col(c)).alias(c) if c in columns else F.col(c) for c in metrics.columns))


def net_benefit(rows: DataFrame, thresholds: Sequence[float], action: Column | None = None, group: Sequence[str] = (), weight: str | None = None, pred: str = "pred") -> DataFrame:
    """Per threshold: net benefit, alert rate, sensitivity, specificity and positive predictive value. Without ``action``
    a row alerts when its prediction reaches the threshold."""
    q = F.lit(1.0) if weight is None else F.col(weight)
    r = rows.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    a = (F.col(pred) >= F.col("threshold")).cast("double") if action is None else action.cast("double")
    w, y = q * F.col("w"), F.col("y")
    preference = F.col("threshold") / (1 - F.col("threshold"))
    s = r.groupBy(*group, "threshold").agg(
        (F.sum(w * a * (y - (1 - y) * preference)) / F.sum(q)).alias("net_benefit"), (F.sum(q * a) / F.sum(q)).alias("alert_rate"),
        F.sum(w * a * y).alias("tp"), F.sum(w * a * (1 - y)).alias("fp"), F.sum(w * (1 - a) * (1 - y)).alias("tn"), F.sum(w * (1 - a) * y).alias("fn"), F.count("*").alias("n"), F.sum((F.col("w") > 0).cast("long")).alias("n_known"),
    )
    ratio = lambda x, z: F.when(F.col(x) + F.col(z) != 0, F.col(x) / (F.col(x) + F.col(z)))
    return s.select(*group, "threshold", "n", "n_known", "net_benefit", "alert_rate", ratio("tp", "fn").alias("sensitivity"), ratio("tn", "fp").alias("specificity"), ratio("tp", "fp").alias("ppv"))


def balanced_weight(patient: str = "patient_id", group: Sequence[str] = ()) -> Column:
    """1 / rows of the patient (window expression)."""
    return 1.0 / F.count("*").over(Window.partitionBy(*group, patient))


def paired_strategies(rows: DataFrame, threshold: float, status: str = "status", risk: str = "pred", patient: str = "patient_id") -> DataFrame:
    """Net benefit of rule, model, either, all and none on the rows both can judge, pooled and patient-balanced, with the
    increments over rule and model."""
    common = rows.filter(F.col(status).isin("positive", "negative") & F.col(risk).isNotNull())
    rule, model = (F.col(status) == "positive").cast("double"), (F.col(risk) >= threshold).cast("double")
    options = {"rule_only": rule, "model_only": model, "rule_or_model": F.greatest(rule, model), "assess_all": F.lit(1.0), "assess_none": F.lit(0.0)}
    per = 1.0 / F.count("*").over(Window.partitionBy(patient))
    long = common.withColumn("__per", per).select("y", "w", F.inline(F.array(*(F.struct(F.lit(n).alias("strategy"), a.alias("a"), F.lit(p).alias("population"), q.alias("q")) for n, a in options.items() for p, q in (("pooled_landmark", F.lit(1.0)), ("patient_balanced", F.col("__per")))))))
    preference = threshold / (1 - threshold)
    nb = long.groupBy("population", "strategy").agg((F.sum(F.col("q") * F.col("w") * F.col("a") * (F.col("y") - (1 - F.col("y")) * preference)) / F.sum("q")).alias("net_benefit"))
    whole = Window.partitionBy("population")
    versus = lambda n: F.col("net_benefit") - F.max(F.when(F.col("strategy") == n, F.col("net_benefit"))).over(whole)
    return nb.select("population", "strategy", "net_benefit", versus("rule_only").alias("increment_vs_rule"), versus("model_only").alias("increment_vs_model"))


def paired_strategy_intervals(rows: DataFrame, threshold: float, replicates: int = 200, seed: int = 0, status: str = "status", risk: str = "pred", patient: str = "patient_id") -> DataFrame:
    """(contrast, value, low, high): patient-balanced net benefit of the model over the rule, and of either over the model, with
    patient-bootstrap limits. Each patient's mean is taken first; a replicate averages the patients it drew, each once, since
    balancing gives a patient weight one however often it is drawn."""
    common = rows.filter(F.col(status).isin("positive", "negative") & F.col(risk).isNotNull())
    rule, model = (F.col(status) == "positive").cast("double"), (F.col(risk) >= threshold).cast("double")
    gain = F.col("w") * (F.col("y") - (1 - F.col("y")) * (threshold / (1 - threshold)))
    each = stage(common.groupBy(patient).agg(F.avg(gain * (model - rule)).alias("model_minus_rule"), F.avg(gain * (F.greatest(rule, model) - model)).alias("or_minus_model")), "strategies")
    drawn = each.join(resample.bootstrap_lists(each, replicates, seed, patient), patient).withColumn("rep", F.explode(F.array_distinct("reps")))
    contrasts = ("model_minus_rule", "or_minus_model")
    values = drawn.groupBy("rep").agg(*(F.avg(c).alias(c) for c in contrasts))
    long = values.select("rep", F.inline(F.array(*(F.struct(F.lit(c).alias("contrast"), F.col(c).alias("x")) for c in contrasts))))
    return replicate_intervals(long, "x", ["contrast"])


def discordant_rows(rows: DataFrame, threshold: float, status: str = "status", risk: str = "pred") -> DataFrame:
    """Rows the rule calls negative and the model positive."""
    return rows.filter((F.col(status) == "negative") & (F.col(risk) >= threshold))


def pairing_coverage(rows: DataFrame, status: str = "status", risk: str = "pred") -> DataFrame:
    rule, model = F.col(status).isin("positive", "negative"), F.col(risk).isNotNull()
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    rule = F.coalesce(rule, F.lit(False))
    return rows.agg(F.count("*").alias("n_total"), n(rule & model).alias("n_common"), n(rule & ~model).alias("n_rule_only"), n(~rule & model).alias("n_model_only"), n(~rule & ~model).alias("n_neither"), n(F.col(status) == "positive").alias("n_rule_positive"))


def concordance(rows: DataFrame, group: Sequence[str] = (), time: str = "time", event: str = "event", pred: str = "pred") -> DataFrame:
    """Harrell's concordance of a whole group in n log n steps.

    Distinct times are numbered; an event and a later row first differ in one binary digit of their numbers, and share all
    digits before it. So under each digit's leading part (a node) the events with a 0 there meet the rows with a 1, which takes
    one running count over their scores. At an equal time only censored rows are comparable with an event.
    """
    rows, keys = _keyed(rows, group)
    censored = F.sum((F.col(event) == 0).cast("long"))
    cells = stage(rows.filter(F.col(pred).isNotNull()).groupBy(*keys, (F.col(time) + F.lit(0.0)).alias("t"), F.col(pred).alias("s")).agg(F.sum((F.col(event) != 0).cast("long")).alias("d"), F.count("*").alias("n"), censored.alias("c")), "cells")
    times = stage(prefix_sum(cells.select(*keys, "t").distinct().withColumn("__one", F.lit(1).cast("long")), keys, "t", {"rank": "__one"}).drop("__one"), "times")
    digits = max(1, int(times.agg(F.max("rank")).first()[0] or 0).bit_length())
    ranked = cells.join(broadcast_if_small(times.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("t").alias("__t"), "rank"), name="ranks"), equal_keys([*keys, "t"], [*(f"__{k}" for k in keys), "__t"]))
    level = ranked.withColumn("level", F.explode(F.sequence(F.lit(-1), F.lit(digits - 1))))
    one = F.expr("shiftrightunsigned(rank, greatest(level, 0))").bitwiseAND(F.lit(1)) == 1
    here = level.select(
        *keys, "s", "level",
        F.when(F.col("level") < 0, F.col("rank")).otherwise(F.expr("shiftrightunsigned(rank, level + 1)")).alias("node"),
        F.when(F.col("level") < 0, F.col("d")).when(~one, F.col("d")).otherwise(0).alias("d"), F.when(F.col("level") < 0, F.col("c")).when(one, F.col("n")).otherwise(0).alias("n"),
    )
    scores = here.groupBy(*keys, "level", "node", "s").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    upto = prefix_sum(scores, [*keys, "level", "node"], "s", {"upto": "n"})
    nodes = upto.groupBy(*keys, "level", "node").agg(F.sum(F.col("d") * (F.col("upto") - 0.5 * F.col("n"))).alias("num"), (F.sum("d") * F.sum("n")).alias("den"))
    return nodes.groupBy(*keys).agg((F.sum("num") / F.sum("den")).alias("concordance")).select(*group, "concordance")


def coverage(rows: DataFrame, valid: Column, group: Sequence[str] = (), patient: str = "patient_id") -> DataFrame:
    return rows.groupBy(*group).agg(F.count("*").alias("rows"), F.sum(valid.cast("long")).alias("rows_valid"), F.avg(valid.cast("double")).alias("row_coverage"), F.countDistinct(patient).alias("patients"), F.countDistinct(F.when(valid, F.col(patient))).alias("patients_with_valid_rows"))


def policy_summary(results: DataFrame) -> DataFrame:
    """Surveillance policies, for all and by route: crossers, detections, delay, early positives, studies per 1,000 years."""
    crosser = F.coalesce((F.col("crossing") > F.col("t0")) & (F.col("crossing") < F.col("t_end")), F.lit(False))
    true_ = crosser & F.coalesce(F.col("detect") >= F.col("crossing"), F.lit(False))
    results = stage(results, "policies")
    d = results.withColumn("crosser", crosser).withColumn("true_detection", true_).withColumn("delay", F.when(true_, (F.col("detect") - F.col("crossing")) * 12)).withColumn("early", F.col("detect").isNotNull() & ~true_)
    n = lambda c: F.sum(F.col(c).cast("long"))
    years = F.sum("surveillance_years")
    out = d.rollup("policy", "route").agg(
        F.grouping("route").alias("__all"), F.grouping("policy").alias("__none"), F.count("*").alias("patients"), years.alias("patient_years"), F.sum("n_echoes").alias("echoes"), (1000 * F.sum("n_echoes") / years).alias("echoes_per_1000py"),
        n("crosser").alias("crossers"), n("true_detection").alias("detected"), n("early").alias("early_positives"), (100 * F.avg((F.col("alerts") > 0).cast("double"))).alias("patients_alerted_pct"),
    )
    out = out.filter("__none = 0").withColumn("route", F.when(F.col("__all") == 1, "all").otherwise(F.col("route"))).drop("__all", "__none")
    by = d.select("policy", F.explode(F.array(F.lit("all"), F.col("route"))).alias("route"), "delay")
    delays = exact_quantiles(by, {"delay": F.col("delay")}, [0.5, 0.9], ["policy", "route"])
    delays = delays.select(F.col("policy").alias("__p"), F.col("route").alias("__r"), F.col("q")[0].alias("delay_median_months"), F.col("q")[1].alias("delay_p90_months"))
    return out.join(delays, equal_keys(["policy", "route"], ["__p", "__r"]), "left").drop("__p", "__r")


def paired_policies(results: DataFrame, policy: str, reference: str, group: Sequence[str] = (), patient: str = "patient_id") -> DataFrame:
    """One policy against another on the same patients: lead time in months where both detect a crossing after it, crossings
    only one of them detects, and studies per 1,000 patient-years more than the other's."""
    hit = F.coalesce((F.col("crossing") > F.col("t0")) & (F.col("crossing") < F.col("t_end")) & (F.col("detect") >= F.col("crossing")), F.lit(False))
    keep = [F.col("detect"), F.col("n_echoes"), F.col("surveillance_years"), hit.alias("hit")]
    a = results.filter(F.col("policy") == policy).select(patient, *group, F.struct(*keep).alias("a"))
    b = results.filter(F.col("policy") == reference).select(patient, F.struct(*keep).alias("b"))
    both, n = F.col("a.hit") & F.col("b.hit"), lambda c: F.sum(c.cast("long"))
    lead = F.when(both, (F.col("b.detect") - F.col("a.detect")) * 12)
    rate = lambda s: 1000 * F.sum(f"{s}.n_echoes") / F.sum(f"{s}.surveillance_years")
    pairs = stage(a.join(b, patient), "pairs")
    median = exact_quantiles(pairs, {"lead": lead}, [0.5], group).select(*(F.col(g).alias(f"__{g}") for g in group), F.col("q")[0].alias("lead_median_months"))
    out = pairs.groupBy(*group).agg(
        F.count("*").alias("patients"), n(both).alias("both_detected"), n(F.col("a.hit") & ~F.col("b.hit")).alias("only_policy"), n(~F.col("a.hit") & F.col("b.hit")).alias("only_reference"),
        F.avg(lead).alias("lead_mean_months"), (rate("a") - rate("b")).alias("extra_echoes_per_1000py"),
    )
    return out.join(median, equal_keys(group, [f"__{g}" for g in group]), "left").drop(*(f"__{g}" for g in group))


def paired_policy_intervals(results: DataFrame, policy: str, reference: str, replicates: int = 200, seed: int = 0, group: Sequence[str] = (), patient: str = "patient_id") -> DataFrame:
    """(group columns, contrast, value, low, high, valid): mean lead time in months and extra studies per 1,000 patient-years of one
    policy over another, with patient-bootstrap limits, from one row of sums per patient."""
    hit = F.coalesce((F.col("crossing") > F.col("t0")) & (F.col("crossing") < F.col("t_end")) & (F.col("detect") >= F.col("crossing")), F.lit(False))
    keep = [F.col("detect"), F.col("n_echoes"), F.col("surveillance_years"), hit.alias("hit")]
    a = results.filter(F.col("policy") == policy).select(patient, *group, F.struct(*keep).alias("a"))
    b = results.filter(F.col("policy") == reference).select(patient, F.struct(*keep).alias("b"))
    both = F.col("a.hit") & F.col("b.hit")
    sums = stage(a.join(b, patient).select(
        patient, *group, F.when(both, (F.col("b.detect") - F.col("a.detect")) * 12).otherwise(0.0).alias("lead"), both.cast("double").alias("both"),
        F.col("a.n_echoes").alias("ea"), F.col("b.n_echoes").alias("eb"), F.col("a.surveillance_years").alias("ya"), F.col("b.surveillance_years").alias("yb"),
    ), "policies")
    drawn = sums.join(resample.bootstrap_lists(sums, replicates, seed, patient), patient).withColumn("rep", F.explode("reps"))
    values = drawn.groupBy(*group, "rep").agg(F.when(F.sum("both") > 0, F.sum("lead") / F.sum("both")).alias("lead_mean_months"), (1000 * (F.sum("ea") / F.sum("ya") - F.sum("eb") / F.sum("yb"))).alias("extra_echoes_per_1000py"))
    long = values.select(*group, "rep", F.inline(F.array(*(F.struct(F.lit(c).alias("contrast"), F.col(c).alias("x")) for c in ("lead_mean_months", "extra_echoes_per_1000py")))))
    return replicate_intervals(long, "x", [*group, "contrast"])


def visit_schedule(patients: DataFrame, base: str) -> DataFrame:
    """Scheduled study times after the reference: yearly, or at 5 and 10 years and then yearly for surgical valves."""
    yearly = F.transform(F.sequence(F.lit(1), F.lit(99)), lambda k: F.col("t0") + k)
    sparse = F.concat(F.array(F.lit(5.0), F.lit(10.0)), F.transform(F.sequence(F.lit(1), F.lit(89)), lambda k: k + F.lit(10.0)))
    times = yearly if base == "annual" else F.when(F.col("route") == "SAVR", sparse).otherwise(yearly)
    kept = F.filter(times, lambda t: (t > F.col("t0") + 1e-9) & (t < F.col("t_end")))
    return patients.select("patient_id", "route", F.explode(kept).alias("visit_time"))
