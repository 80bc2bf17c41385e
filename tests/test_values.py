"""Queries and operators that SQL cannot express, held to small dense versions in numpy."""

import math
from collections import Counter

import numpy as np
import pytest
from oracles import SF
from pyspark.sql import functions as F

from timberline.operators import asof, boost, cif, cox, experiments, metrics, profile, resample, staging, survival
from timberline.plans import data_queries, late_queries, model_queries  # noqa: F401
from timberline.plans.bindings import role
from timberline.plans.registry import QUERIES


@pytest.fixture(scope="module")
def surv(spark):
    return role(spark, SF, "surv").toPandas().sort_values("row_id", ignore_index=True)


def dense_cox(z, time, event, strata, penalizer=0.05, offset=0.0, steps=40):
    """Breslow Newton steps over explicit risk sets."""
    b = np.zeros(z.shape[1])
    for _ in range(steps):
        g, h = -penalizer * b, -penalizer * np.eye(len(b))
        w = np.exp(z @ b + offset)
        for s in set(strata):
            own = strata == s
            for i in np.flatnonzero(own & (event > 0)):
                at = own & (time >= time[i])
                mean = (w[at, None] * z[at]).sum(axis=0) / w[at].sum()
                second = (w[at, None, None] * z[at][:, :, None] * z[at][:, None, :]).sum(axis=0) / w[at].sum()
                g = g + z[i] - mean
                h = h - (second - np.outer(mean, mean))
        step = np.linalg.solve(h, -g)
        b = b + step
        if abs(step).max() < 1e-10:
            break
    return b, np.sqrt(np.diag(np.linalg.inv(-h)))


def dense_breslow(risk, time, event, at):
    """Cumulative baseline hazard at each of ``at``."""
    steps = [(t, (event[time == t] > 0).sum() / risk[time >= t].sum()) for t in sorted(set(time[event > 0]))]
    return np.asarray([sum(h for t, h in steps if t <= x + 1e-12) for x in at])


def dense_state(hazards):
    """States from cumulative hazards on a grid that starts at 0: (S, {cause: F})."""
    d = np.diff(hazards, axis=1)
    total = d.sum(axis=0)
    s, f = 1.0, np.zeros(len(hazards))
    for k in range(d.shape[1]):
        share = s * -math.expm1(-total[k]) / total[k] if total[k] > 0 else 0.0
        f = f + share * d[:, k]
        s *= math.exp(-total[k])
    return s, f


def test_cox_fits_several_causes_at_once(spark, surv):
    z, time, route = surv[["pred", "valve_age_years"]].to_numpy(float), surv["time"].to_numpy(float), surv["route"].to_numpy()
    fits = cox.fit_cox_causes(role(spark, SF, "surv"), ["pred", "valve_age_years"], [F.col("event") == 1, F.col("event") == 2], strata=F.col("route"))
    for code, fit in zip((1, 2), fits):
        beta, se = dense_cox(z, time, (surv["event"] == code).to_numpy(), route)
        assert fit.converged and np.allclose(fit.beta, beta, atol=1e-5) and np.allclose(fit.se, se, atol=1e-5)
    # the way for many distinct times gives the same sums
    data = role(spark, SF, "surv").select(F.col("route").alias("stratum"), "time", F.array((F.col("event") == 1).cast("double")).alias("hits"), F.lit(1.0).alias("weight"), F.lit(0.0).alias("offset"), "pred")
    few, many = (cox._objectives(data, ["pred"], {0: np.asarray([0.3])}, x)[0] for x in (True, False))
    assert all(np.allclose(a, b, rtol=1e-9) for a, b in zip(few, many))


def test_constant_column_has_no_effect(spark):
    beta, se = boost.log_effect(role(spark, SF, "surv").withColumn("one", F.lit(1.0)), "one", F.col("event") == 1)
    assert beta == 0.0 and math.isinf(se)


def test_i8_and_i17(spark, surv):
    time, event = surv["time"].to_numpy(float), (surv["event"] == 1).to_numpy()
    everyone = np.zeros(len(surv))
    beta, se = dense_cox((surv["route"] == "TAVR").to_numpy(float)[:, None], time, event, everyone, penalizer=0.0)
    r = QUERIES["i8_univariable_log_effect"](spark, SF).first()
    assert r["log_effect"] == pytest.approx(beta[0], abs=1e-5) and r["se"] == pytest.approx(se[0], abs=1e-5)
    vka = (surv["row_id"] % 4 == 0).to_numpy(float)
    one, _ = dense_cox(np.column_stack([vka, surv["valve_age_years"]]), time, event, everyone)
    two, _ = dense_cox(np.column_stack([vka, surv["valve_age_years"], surv["pred"]]), time, event, everyone)
    r = QUERIES["i17_mechanism_check"](spark, SF).first()
    assert (r["without_marker"], r["with_marker"], r["shrinkage"]) == pytest.approx((one[0], two[0], 1 - two[0] / one[0]), abs=1e-5)
    assert QUERIES["i17_exposure_contrast"](spark, SF).first()["contrast"] == pytest.approx(one[0], abs=1e-5)


def test_i15_and_i16(spark, surv):
    time, event = surv["time"].to_numpy(float), (surv["event"] == 1).to_numpy()
    z = surv[["pred", "valve_age_years"]].to_numpy(float)
    b, _ = dense_cox(z, time, event, np.zeros(len(surv)))
    h0 = dense_breslow(np.exp(z @ b), time, event, [3.0])[0]
    risk = lambda z: 1 - np.exp(-h0 * np.exp(z @ b))
    got = {(r["row_id"], r["feature_group"]): r["delta"] for r in QUERIES["i15_grouped_sensitivity"](spark, SF).collect()}
    flat = z.copy()
    flat[:, 0] = 0.5
    assert np.allclose([got[(i, "score")] for i in surv["row_id"]], risk(z) - risk(flat), atol=1e-5)
    columns = ["pred", "pred2", "valve_age_years"]
    z = surv[columns].to_numpy(float)
    b, _ = dense_cox(z, time, event, np.zeros(len(surv)))
    each = b * (z - z.mean(axis=0))
    first = {r["row_id"]: (r["feature"], r["contribution"]) for r in QUERIES["i16_top_drivers"](spark, SF).filter("rank = 1").collect()}
    best = np.abs(each).argmax(axis=1)
    assert all(first[i][1] == pytest.approx(each[k, best[k]], abs=1e-5) and first[i][0] == columns[best[k]] for k, i in enumerate(surv["row_id"]))


def test_i5_i7_i18_probabilities(spark, surv):
    columns = ["pred", "pred2", "valve_age_years"]
    z, time, route = surv[columns].to_numpy(float), surv["time"].to_numpy(float), surv["route"].to_numpy()
    grid = np.asarray([0.25 * k for k in range(25)])
    hazards = np.zeros((2, len(surv), len(grid)))
    for c, code in enumerate((1, 2)):
        event = (surv["event"] == code).to_numpy()
        b, _ = dense_cox(z, time, event, route)
        risk = np.exp((z - z.mean(axis=0)) @ b)
        for s in ("SAVR", "TAVR"):
            own = route == s
            hazards[c, own] = risk[own, None] * dense_breslow(risk[own], time[own], event[own], grid)[None, :]
    got = {r["row_id"]: r for r in QUERIES["i5_i11_cause_specific_cox"](spark, SF).filter("horizon = 3").collect()}
    for k in range(0, len(surv), 37):
        s, f = dense_state(hazards[:, k, grid <= 3.0])
        r = got[surv["row_id"][k]]
        assert (r["alive_intact"], r["svd"], r["death"]) == pytest.approx((s, f[0], f[1]), abs=1e-5)


def test_i18_secondary_outcome(spark, surv):
    """The same model with death as the outcome: cumulative hazard at three years."""
    z, time, route = surv[["pred"]].to_numpy(float), surv["time"].to_numpy(float), surv["route"].to_numpy()
    event = (surv["event"] == 2).to_numpy()
    b, _ = dense_cox(z, time, event, route)
    risk = np.exp((z[:, 0] - z.mean()) * b[0])
    at = {s: dense_breslow(risk[route == s], time[route == s], event[route == s], [3.0])[0] for s in ("SAVR", "TAVR")}
    got = {r["row_id"]: r["cumulative_hazard"] for r in QUERIES["i18_secondary_outcome_model"](spark, SF).collect()}
    assert np.allclose([got[i] for i in surv["row_id"]], risk * np.asarray([at[s] for s in route]), atol=1e-5)


def test_i6_offset_model(spark, surv):
    """The marker's terms over the base predictor as offset, against dense fits of both."""
    time, route, event = surv["time"].to_numpy(float), surv["route"].to_numpy(), (surv["event"] == 1).to_numpy()
    base, _ = dense_cox(surv[["valve_age_years"]].to_numpy(float), time, event, route)
    got = QUERIES["i6_i7_h8_offset_marker_model"](spark, SF).toPandas().sort_values("row_id")
    on = surv["row_id"].isin(got["row_id"]).to_numpy()
    terms = got[[c for c in got.columns if c.startswith("pred2__")]].to_numpy(float)
    assert on.sum() == len(got) and np.allclose(terms.mean(axis=0), 0, atol=1e-9) and np.allclose(terms.std(axis=0), 1, atol=1e-9)
    offset = surv["valve_age_years"].to_numpy(float)[on] * base[0]
    b, _ = dense_cox(terms, time[on], event[on], route[on], offset=offset)
    assert np.allclose(got["lp"], terms @ b, atol=1e-4) and np.allclose(np.stack(got["contributions"]), terms * b, atol=1e-4)


def test_l4_ladder_is_out_of_fold(spark, surv):
    """Brier scores of the ladder from dense fits without the fold."""
    folds = {r["patient_id"]: r["fold"] for r in resample.patient_folds(role(spark, SF, "surv"), 3).collect()}
    fold = surv["patient_id"].map(folds).to_numpy()
    z, time, route = surv[["valve_age_years"]].to_numpy(float), surv["time"].to_numpy(float), surv["route"].to_numpy()
    grid, p = np.asarray([0.25 * k for k in range(13)]), np.zeros(len(surv))
    for k in range(3):
        tr, te = fold != k, fold == k
        for s in ("SAVR", "TAVR"):
            own, hazards = tr & (route == s), []
            for code in (1, 2):
                event = (surv["event"] == code).to_numpy()
                b, _ = dense_cox(z[tr], time[tr], event[tr], route[tr])
                hazards.append((b[0], dense_breslow(np.exp((z[own, 0] - z[tr].mean()) * b[0]), time[own], event[own], grid)))
            for i in np.flatnonzero(te & (route == s)):
                p[i] = dense_state(np.asarray([math.exp((z[i, 0] - z[tr].mean()) * b) * h for b, h in hazards]))[1][0]
    known = model_queries.scored(spark, SF).toPandas().sort_values("row_id")
    want = (known["w"].to_numpy() * (known["y"].to_numpy() - p) ** 2).sum() / len(p)
    got = QUERIES["l4_out_of_fold_ladder"](spark, SF).filter("step = 'age' and horizon = 3").first()
    assert got["brier"] == pytest.approx(want, abs=1e-6) and got["n_rows"] == len(p)


def test_j7_implant_time_risk(spark, surv):
    z, time, route = surv[["valve_age_years"]].to_numpy(float), surv["time"].to_numpy(float), surv["route"].to_numpy()
    grid = np.asarray([0.25 * k for k in range(13)])
    want = {}
    for s in ("SAVR", "TAVR"):
        own, hazards = route == s, []
        for code in (1, 2):
            event = (surv["event"] == code).to_numpy()
            b, _ = dense_cox(z, time, event, route)
            risk = np.exp((z[:, 0] - z.mean()) * b[0])
            hazards.append(np.exp((0.25 - z.mean()) * b[0]) * dense_breslow(risk[own], time[own], event[own], grid))
        want[s] = dense_state(np.asarray(hazards))[1][0]
    routes = {r["patient_id"]: r["route"] for r in role(spark, SF, "patients").collect()}
    for r in QUERIES["j7_implant_time_risk"](spark, SF).collect():
        assert r["support"] == "" and r["risk"] == pytest.approx(want[routes[r["patient_id"]]], abs=1e-5)


def test_j8_scores_are_those_of_the_models(spark):
    """Scored requests hold the probabilities of the fitted hazards; others keep their status and none."""
    rows = role(spark, SF, "surv").select("row_id", "patient_id", "route", "time", "event", F.col("pred").alias("gradient_now"), F.col("pred2").alias("t_lm"))
    model = cox.CauseSpecificCox(["gradient_now", "t_lm"], causes={"svd": 1, "death": 2}).fit(rows)
    tables = {n: role(spark, SF, n) for n in ("patients", "studies", "exposures", "mechanism")}
    requests = role(spark, SF, "terminal").select("patient_id", F.date_sub("end_followup_date", 180).alias("prediction_date"))
    features = {"gradient_now": F.coalesce("current_gradient", "ref_gradient") / 50, "t_lm": F.col("t_lm") / 20}
    grid = [0.25 * k for k in range(25)]
    out = experiments.score_requests(requests, tables, model, features, grid, [3.0]).collect()
    status = {(r["patient_id"]): r["score_status"] for r in QUERIES["j8_score_status"](spark, SF).collect()}
    assert len(out) == len(status) and Counter(r["score_status"] for r in out)["ok"] > 10
    assert all(r["score_status"] == status[r["patient_id"]] for r in out if r["score_status"] != "missing_features")
    own = {r["patient_id"]: r for r in experiments.request_features(requests, tables["patients"], tables["studies"]).withColumns(features).collect()}
    base = {c: {r["route"]: [] for r in out if False} for c in ("svd", "death")}
    for c in base:
        for r in model.models[c].baseline.collect():
            base[c].setdefault(r["route"], []).append((r["time"], r["cumulative_hazard"]))
    routes = {r["patient_id"]: r["route"] for r in tables["patients"].collect()}
    for r in out:
        if r["score_status"] != "ok":
            assert r["svd"] is None and r["alive_intact"] is None
            continue
        x = own[r["patient_id"]]
        hazards = []
        for c in ("svd", "death"):
            lp = sum(b * (x[n] - model.means[n]) for n, b in zip(model.models[c].fit.columns, model.models[c].fit.beta))
            hazards.append([math.exp(lp) * max([0.0, *(h for t, h in base[c][routes[r["patient_id"]]] if t <= g + 1e-12)]) for g in grid if g <= 3])
        s, f = dense_state(np.asarray(hazards))
        assert (r["alive_intact"], r["svd"], r["death"]) == pytest.approx((s, f[0], f[1]), abs=1e-9)


def test_what_if_changes_only_what_it_says(spark):
    requests = spark.createDataFrame([(1, "2020-06-01")], "patient_id long, d string").select("patient_id", F.to_date("d").alias("prediction_date"))
    exposures = spark.createDataFrame([(1, 1, "FXa", "2019-01-01", None), (1, 2, "SAPT", "2018-01-01", "2019-01-01"), (2, 3, "FXa", "2019-01-01", None)], "patient_id long, seq long, class string, a string, b string")
    exposures = exposures.select("patient_id", "seq", "class", F.to_date("a").alias("start_date"), F.to_date("b").alias("stop_date"))
    studies = spark.createDataFrame([(1, 5, 10.0)], "patient_id long, seq long, mean_gradient double").withColumn("date", F.to_date(F.lit("2019-05-05")))
    out = experiments.what_if(requests, {"studies": studies, "exposures": exposures}, {"mean_gradient": F.lit(30.0)}, 30, {"class": F.lit("VKA")})
    e = {(r["patient_id"], r["class"]): (str(r["start_date"]), str(r["stop_date"])) for r in out["exposures"].collect()}
    assert e == {(1, "FXa"): ("2019-01-01", "2020-06-01"), (1, "SAPT"): ("2018-01-01", "2019-01-01"), (2, "FXa"): ("2019-01-01", "None"), (1, "VKA"): ("2020-06-01", "None")}
    assert sorted((str(r["date"]), r["mean_gradient"]) for r in out["studies"].collect()) == [("2019-05-05", 10.0), ("2020-05-02", 30.0)]


def test_k10_conditional_censoring(spark, surv):
    z, time = surv[["valve_age_years"]].to_numpy(float), surv["time"].to_numpy(float)
    event = (surv["event"] == 0).to_numpy()
    b, _ = dense_cox(z, time, event, np.zeros(len(surv)))
    risk = np.exp(z[:, 0] * b[0])
    steps = [(t, (event[time == t]).sum() / risk[time >= t].sum()) for t in sorted(set(time[event]))]
    got = {r["row_id"]: r["g"] for r in QUERIES["k10_conditional_censoring"](spark, SF).collect()}
    for k in range(0, len(surv), 29):
        at = min(time[k], 3.0)
        assert got[surv["row_id"][k]] == pytest.approx(math.exp(-risk[k] * sum(h for t, h in steps if t < at)), abs=1e-5)


def test_i9_boosting_lowers_the_loss(spark, surv):
    """Scores after ten trees fit better than after five, and those better than none, by the partial likelihood."""
    got = QUERIES["i9_i10_boosted_hazards"](spark, SF).toPandas().set_index("row_id").loc[surv["row_id"]]
    time, event = surv["time"].to_numpy(float), (surv["event"] == 1).to_numpy()

    def loglik(score):
        w = np.exp(score)
        return sum(score[i] - math.log(w[time >= time[i]].sum()) for i in np.flatnonzero(event))

    none, five, ten = (loglik(x) for x in (np.zeros(len(surv)), got["score_5"].to_numpy(), got["score_10"].to_numpy()))
    assert none < five < ten


def test_l4_l5_ladders(spark):
    """A step with the informative score is no worse than without; ladder and pairs agree on the same rows."""
    base = spark.range(400).select(F.col("id").alias("row_id"), (F.col("id") / 2).cast("int").alias("patient_id"), F.when(F.col("id") % 4 < 2, "SAVR").otherwise("TAVR").alias("route"), (F.col("id") % 2).cast("double").alias("x"), ((F.col("id") * 7 % 11) / 10).alias("noise"))
    rows = base.withColumn("time", F.when(F.col("x") == 1, 0.5 + (F.col("id") % 13 if False else F.col("row_id") % 13) / 10).otherwise(3.0 + (F.col("row_id") % 5) / 10)).withColumn("event", F.when(F.col("x") == 1, 1).otherwise(0))
    table, paired = experiments.comparator_ladder(rows, {"noise": ["noise"], "x": ["noise", "x"]}, [("x", "noise")], 2.0, {"svd": 1}, [0.25 * k for k in range(13)], folds=2, replicates=20)
    briers = {r["comparator"]: r["brier"] for r in table.collect()}
    p = paired.first()
    assert briers["x"] < briers["noise"] and p["difference"] == pytest.approx(briers["x"] - briers["noise"], abs=1e-9)
    assert p["ci_low"] <= p["difference"] <= p["ci_high"] < 0 and p["patients"] == 200


def test_l6_common_patients(spark):
    rows = role(spark, SF, "surv").select("row_id", "patient_id", "route", "time", "event", "pred", "valve_age_years")
    results, dropped = experiments.observation_sensitivity({"all": rows, "some": rows.filter("patient_id % 5 > 0")}, {"age": ["valve_age_years"]}, [3.0], {"svd": 1}, [0.5 * k for k in range(9)], folds=2)
    a, b = results.collect()
    n = rows.select("patient_id").distinct()
    assert a["n_rows"] == b["n_rows"] and a["brier"] == pytest.approx(b["brier"]) and {r["analysis"]: r["dropped_patients"] for r in dropped.collect()} == {"all": n.filter("patient_id % 5 = 0").count(), "some": 0}


def test_l7_tuning_scores_each_setting_out_of_fold(spark):
    rows = role(spark, SF, "surv")
    out = QUERIES["l7_simplest_setting"](spark, SF).collect()
    assert {(r["trees"], r["scored_cells"]) for r in out} == {(1, 2), (2, 2)} and sum(r["chosen"] for r in out) == 1
    best = min(r["mean_brier"] for r in out)
    assert min(r["trees"] for r in out if r["mean_brier"] <= best + 1e-6) == next(r["trees"] for r in out if r["chosen"])
    assert all(0 < r["mean_brier"] < 1 for r in out) and rows.count() > 0


def test_l8_and_k15_differences(spark):
    r = QUERIES["l8_marker_increment"](spark, SF).first()
    assert r["difference"] == pytest.approx(r["brier_marker"] - r["brier_base"], abs=1e-9) and r["ci_low"] <= r["ci_high"]
    assert r["n_rows"] == role(spark, SF, "surv").filter("row_id % 3 > 0").count()
    k = QUERIES["k15_family_comparison"](spark, SF).first()
    rows = model_queries.scored(spark, SF)
    brier = lambda c: rows.agg(F.sum(F.col("w") * (F.col("y") - F.col(c)) ** 2) / F.count("*")).first()[0]
    assert k["difference"] == pytest.approx(brier("pred2") - brier("pred"), abs=1e-6) and k["promote"] == (k["difference"] < 0 and k["ci_high"] < 0)


def test_k8_calibration_rises_with_the_prediction(spark):
    """On outcomes drawn with their predicted probability the curve lies near the diagonal."""
    rows = spark.range(4000).select((F.col("id") % 20 / 20 + 0.02).alias("pred"), F.lit(1.0).alias("w"), F.col("id"))
    rows = rows.withColumn("y", (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000 < F.col("pred")).cast("double"))
    knots = rows.agg(F.percentile(metrics.logit(F.col("pred")), [0.1, 0.5, 0.9])).first()[0]
    curve = boost.formal_calibration(rows, knots).collect()
    assert len(curve) == 40 and max(abs(r["predicted"] - r["observed"]) for r in curve) < 0.1
    assert len(QUERIES["k8_formal_calibration"](spark, SF).collect()) == 40


def test_i13_weights_are_stabilised(spark):
    out = QUERIES["i13_visit_weights"](spark, SF).toPandas()
    assert len(out) == 1500 and (out["visit_weight"] > 0).all() and 0.5 < out["visit_weight"].mean() < 2


def test_step_lookup_is_a_binary_search(spark):
    r = np.random.default_rng(4)
    knots = [(g, round(float(t), 2), float(k)) for g in ("a", "b") for k, t in enumerate(np.unique(r.random(300).round(2)) * 10)]
    rows = [(i, ("a", "b", "c", None)[i % 4], round(float(r.random() * 11 - 0.5), 2)) for i in range(800)] + [(800, "a", None)]
    k = spark.createDataFrame(knots, "g string, time double, value double")
    d = spark.createDataFrame(rows, "i int, g string, at double")
    for strict in (False, True):
        out = {x["i"]: x["looked_up"] for x in asof.step_lookup(d, F.col("at"), k, ["g"], -1.0, strict=strict).collect()}
        for i, g, at in rows:
            own = [v for h, t, v in knots if h == g and at is not None and (t < at if strict else t <= at)]
            assert out[i] == (own[-1] if own else -1.0)


def test_concordance_of_tied_and_many_values(spark):
    r = np.random.default_rng(6)
    rows = [(int(g), float(t), int(e), float(s)) for g, t, e, s in zip(r.integers(0, 2, 300), r.integers(1, 40, 300), r.integers(0, 2, 300), r.integers(0, 20, 300) / 10)]
    out = {x["g"]: x["concordance"] for x in metrics.concordance(spark.createDataFrame(rows, "g int, time double, event int, pred double"), ["g"]).collect()}
    for g in (0, 1):
        num = den = 0.0
        own = [x for x in rows if x[0] == g]
        for _, t, e, s in own:
            for _, t2, e2, s2 in own:
                if e and (t2 > t or t2 == t and not e2):
                    den += 1
                    num += 1.0 if s > s2 else 0.5 if s == s2 else 0.0
        assert out[g] == pytest.approx(num / den)


def test_combine_rows_of_other_lengths(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.1], [0.0, 0.2]), (2, [0.0, 0.1, 0.4], [0.0, 0.2, 0.2]), (3, None, [0.0, 0.2])], "row_id int, a array<double>, b array<double>")
    out = {r["row_id"]: r for r in cif.combine(rows, ["a", "b"]).collect()}
    for i, h in ((1, [[0.0, 0.1], [0.0, 0.2]]), (2, [[0.0, 0.1, 0.4], [0.0, 0.2, 0.2]])):
        s, f = dense_state(np.asarray(h))
        assert out[i]["S"][-1] == pytest.approx(s) and [out[i]["F_a"][-1], out[i]["F_b"][-1]] == pytest.approx(list(f))
    assert out[3]["S"] is None and out[3]["F_a"] is None


def test_long_lineage_and_chains(spark):
    chain = spark.range(200).select(F.col("id").alias("record_id"), F.when(F.col("id") > 0, F.array(F.col("id") - 1)).otherwise(F.array().cast("array<long>")).alias("parent_record_ids"), F.when(F.col("id") == 70, "placeholder").otherwise("observed").alias("value_origin"))
    out = {r["record_id"]: (r["admitted"], r["reason"]) for r in profile.admitted_records(chain).collect()}
    assert all(out[i] == ((True, None) if i < 70 else (False, "non_observed_origin" if i == 70 else "non_observed_ancestor")) for i in range(200))
    ring = spark.createDataFrame([(k, [(k + 1) % 7], "observed") for k in range(7)], "record_id long, parent_record_ids array<long>, value_origin string")
    with pytest.raises(profile.SnapshotRejected, match="cycle"):
        profile.admitted_records(ring)
    links = spark.range(300).select(F.concat(F.lit("g"), F.col("id")).alias("a"), F.concat(F.lit("g"), F.col("id") + 1).alias("b"))
    assert {r["label"] for r in profile.connected(links).collect()} == {"g0"}


def test_nearest_source_searches_all(spark):
    r = np.random.default_rng(9)
    s = np.r_[r.normal(0, 1, (500, 2)), [[40.0, 40.0]]]
    q = np.r_[r.normal(0, 1, (60, 2)), [[25.0, 30.0], [-20.0, 0.0]]]
    source = spark.createDataFrame([tuple(map(float, x)) for x in s], "x double, y double")
    released = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(q)], "i int, x double, y double")
    sd = s.std(axis=0)
    want = np.sqrt((((q[:, None] - s[None]) / sd) ** 2).sum(axis=2)).min(axis=1)
    got = {x["i"]: x["distance"] for x in profile.nearest_source(released, source, ["x", "y"], "i").collect()}
    assert np.allclose([got[i] for i in range(len(q))], want)


def test_nearest_source_in_clusters_and_columns(spark):
    """Tight clusters, far outliers, repeated points, three columns one of which the grid splits coarsely, and one point alone."""
    r = np.random.default_rng(10)
    s = np.r_[r.normal(0, 1e-6, (800, 3)) + [5, 5, 0], r.normal(0, 1, (200, 3)), np.repeat([[9.0, 9.0, 9.0]], 100, axis=0), [[1e4, -1e4, 0.0]]]
    q = np.r_[s[:20] + 1e-7, r.normal(0, 3, (40, 3)), [[-1e5, 1e5, 3.0], [9.0, 9.0, 9.0]]]
    source = spark.createDataFrame([tuple(map(float, x)) for x in s], "x double, y double, z double")
    released = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(q)], "i int, x double, y double, z double")
    want = np.sqrt((((q[:, None] - s[None]) / s.std(axis=0)) ** 2).sum(axis=2)).min(axis=1)
    got = {x["i"]: x["distance"] for x in profile.nearest_source(released, source, ["x", "y", "z"], "i").collect()}
    assert np.allclose([got[i] for i in range(len(q))], want, rtol=1e-9, atol=1e-12)
    one = profile.nearest_source(released, source.limit(1), ["x"], "i").collect()
    assert len(one) == len(q) and all(x["distance"] is not None for x in one)
    assert all(x["distance"] is None for x in profile.nearest_source(released, source.limit(0), ["x"], "i").collect())


def test_bootstrap_ratio_is_the_bootstrap_of_rows(spark):
    rows = model_queries.scored(spark, SF)
    loss = F.col("w") * (F.col("y") - F.col("pred")) ** 2
    by_rows = resample.bootstrap(rows, lambda d, g, w: d.groupBy(*g).agg((F.sum(F.col(w) * loss) / F.sum(w)).alias("value")), 3)
    by_sums = resample.bootstrap_ratio(rows, loss, F.lit(1), 3)
    a, b = ({r["rep"]: r["value"] for r in d.collect()} for d in (by_rows, by_sums))
    assert a == pytest.approx(b)


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda k, d=None: d)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="checkpoint"):
        staging.stage_path(Cluster(), "x")


def test_survival_of_late_knots(spark):
    """Weights of rows at the horizon read the censoring curve strictly before it."""
    rows = spark.createDataFrame([("a", float(t), e) for t, e in ((1, 0), (2, 1), (3, 0), (3, 0), (4, 1))], "route string, time double, event int")
    out = survival.with_ipcw(rows, 3.0, ["route"]).orderBy("time", "event").collect()
    assert [round(r["w"], 6) for r in out] == [0.0, 1.25, 1.25, 1.25, 1.25]
