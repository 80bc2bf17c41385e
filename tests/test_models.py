"""Estimators and metrics against small numpy versions and closed forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.operators import boost, cif, cox, experiments, features, metrics, resample, survival
from timberline.operators.staging import prefix_sum


@pytest.fixture(scope="module")
def sample(spark):
    """Two constant cause hazards, uniform censoring."""
    r = np.random.default_rng(4)
    n = 1500
    x, z = r.normal(size=n), r.normal(size=n)
    t1, t2, c = r.exponential(1 / (0.08 * np.exp(0.9 * x))), r.exponential(1 / 0.12, n), r.uniform(0.5, 8, n)
    time = np.round(np.minimum(np.minimum(t1, t2), c), 3)
    event = np.where(c <= np.minimum(t1, t2), 0, np.where(t1 < t2, 1, 2))
    rows = [(i, f"p{i // 2}", "A" if i % 3 else "B", float(time[i]), int(event[i]), float(x[i]), float(z[i]), float(1 / (1 + np.exp(-x[i])))) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, patient_id string, route string, time double, event int, x double, z double, pred double"), time, event, x, z


def test_cox_equals_a_dense_newton(sample):
    df, time, event, x, z = sample
    fit = cox.fit_cox(df, ["x", "z"], F.col("event") == 1, strata=F.col("route"))
    design, ev = np.column_stack([x, z]), event == 1
    stratum = np.asarray([i % 3 > 0 for i in range(len(x))])
    beta = np.zeros(2)
    for _ in range(30):
        g, h = -0.05 * beta, -0.05 * np.eye(2)
        w = np.exp(design @ beta)
        for i in np.flatnonzero(ev):
            at = (time >= time[i]) & (stratum == stratum[i])
            s0, s1 = w[at].sum(), w[at] @ design[at]
            s2 = (design[at] * w[at, None]).T @ design[at]
            g, h = g + design[i] - s1 / s0, h - (s2 / s0 - np.outer(s1, s1) / s0**2)
        beta = beta - np.linalg.solve(h, g)
    assert np.allclose(fit.beta, beta, atol=1e-6) and abs(fit.beta[0] - 0.9) < 0.15 and fit.converged and fit.n_events == ev.sum()
    assert fit.likelihood_ratio > 10


def test_gates_and_support(sample):
    df = sample[0]
    model = cox.CauseSpecificCox(["x", "constant"], causes={"svd": 1, "death": 2, "replacement": 3}).fit(df.withColumn("constant", F.lit(1.0)))
    assert model.dropped == ["constant"]
    assert {n: m.status for n, m in model.models.items()} == {"svd": "ok", "death": "ok", "replacement": "insufficient_events"}
    rows = model.hazards(df.limit(5), [0.0, 1.0]).collect()
    assert all(r["support"] == "insufficient_events:replacement" and r["svd"] is None for r in rows)


def test_incidence_is_closed_form(spark):
    lam, grid = (0.03, 0.11, 0.004), [0.0, 0.7, 1.0, 2.5, 5.0]
    rows = spark.createDataFrame([(1, *[[x * t for t in grid] for x in lam])], "row_id long, svd array<double>, death array<double>, replacement array<double>")
    out = cif.at_horizons(cif.combine(rows), grid, [1.0, 3.0, 5.0]).collect()
    for r, t in zip(out, (1.0, 2.5, 5.0)):
        total = sum(lam)
        assert abs(r["svd"] - lam[0] / total * (1 - math.exp(-total * t))) < 1e-13 and abs(r["alive_intact"] - math.exp(-total * t)) < 1e-13
        assert abs(r["svd"] + r["death"] + r["replacement"] + r["alive_intact"] - 1) < 1e-12
    cleaned = cif.combine(rows.withColumn("svd", F.array(*map(F.lit, [0.0, 0.02, 0.02 - 1e-12, 0.05, 0.1]))), clean=True).first()
    assert all(b >= a for a, b in zip(cleaned["F_svd"], cleaned["F_svd"][1:]))
    assert cif.build_grid([0.5, 9], [1, 3], 5) == [0.0, 0.5, 1.0, 3.0, 5.0] and len(cif.build_grid([], [1], 2, 2)) == 5
    with pytest.raises(ValueError):
        cif.check_grid([0.0, 1.0, 1.0])


def test_probability_contract(spark):
    good = [[0.1, 0.2, 0.3], [0.1, 0.1, 0.1], [0.0, 0.0, 0.0], [0.8, 0.7, 0.6]]
    bad = [[0.1, 0.2, 0.5], *good[1:]]
    df = spark.createDataFrame([(1, *good), (2, *bad), (3, [0.1], *good[1:])], "row_id int, svd array<double>, death array<double>, replacement array<double>, alive_intact array<double>")
    assert sorted(r["row_id"] for r in cif.probability_violations(df).collect()) == [2, 3]


def test_auc_brier_and_decomposition(sample):
    df, time, event, x, _ = sample
    known = survival.with_ipcw(df, 3.0)
    rows = known.collect()
    w, y, p = (np.asarray([r[c] for r in rows]) for c in ("w", "y", "pred"))
    cases, controls = y == 1, (y == 0) & np.asarray([r["known"] for r in rows])
    diff = p[cases][:, None] - p[controls][None, :]
    ww = w[cases][:, None] * w[controls][None, :]
    assert abs(metrics.auc(known).first()["auc"] - (ww * ((diff > 0) + 0.5 * (diff == 0))).sum() / ww.sum()) < 1e-9
    marginal = survival.aalen_johansen(df).filter("time <= 3").agg(F.max("cif1").alias("observed"))
    b = metrics.brier(known, marginal).first()
    assert abs(b["brier"] - np.mean(w * (y - p) ** 2)) < 1e-12 and 0 < b["observed"] < 1
    d = metrics.brier_decomposition(known).first()
    assert abs(d["reliability"] - d["resolution"] + d["uncertainty"] + d["within_bin_variance"] + d["within_bin_covariance"] - d["brier_normalised"]) < 1e-10


def test_logistic_calibration_recovers_a_shift(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=4000)
    y = (r.random(4000) < 1 / (1 + np.exp(-(0.5 + 1.5 * x)))).astype(float)
    df = spark.createDataFrame([(float(1 / (1 + np.exp(-a))), float(b), 1.0) for a, b in zip(x, y)], "pred double, y double, w double")
    c = metrics.logistic_calibration(df).first()
    assert c["status"] == "ok" and abs(c["slope"] - 1.5) < 0.15 and abs(c["intercept"] - 0.5) < 0.12
    assert metrics.logistic_calibration(df.withColumn("y", F.lit(0.0))).first()["status"] == "no_events"
    assert metrics.logistic_calibration(df.withColumn("pred", F.lit(0.3))).first()["status"] == "no_variation"


def test_net_benefit_literal(spark):
    df = spark.createDataFrame([(0.9, 1.0, 1.0), (0.8, 0.0, 1.0), (0.1, 0.0, 1.0), (0.2, 1.0, 1.0)], "pred double, y double, w double")
    r = metrics.net_benefit(df, [0.5]).first()
    assert r["net_benefit"] == 0.0 and r["sensitivity"] == 0.5 and r["specificity"] == 0.5 and r["ppv"] == 0.5 and r["alert_rate"] == 0.5


def test_concordance(spark):
    r = np.random.default_rng(7)
    t, e, s = r.integers(1, 12, 80), r.integers(0, 2, 80), r.integers(0, 6, 80) / 5
    num = den = 0.0
    for i in range(80):
        for j in range(80):
            if e[i] and (t[j] > t[i] or t[j] == t[i] and not e[j]):
                den += 1
                num += 1.0 if s[i] > s[j] else 0.5 if s[i] == s[j] else 0.0
    df = spark.createDataFrame([(float(a), int(b), float(c)) for a, b, c in zip(t, e, s)], "time double, event int, pred double")
    assert abs(metrics.concordance(df).first()["concordance"] - num / den) < 1e-12


def test_prefix_sum_spans_partitions(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("o"), (F.col("id") % 7).alias("v"))
    got = {(r["g"], r["o"]): r["s"] for r in prefix_sum(df, ["g"], "o", {"s": "v"}, 7).collect()}
    total = {0: 0, 1: 0, 2: 0}
    for i in range(1000):
        total[i % 3] += i % 7
        assert got[(i % 3, i)] == total[i % 3]


def test_folds_and_bootstrap(sample):
    df = sample[0]
    folds = resample.patient_folds(df, 4, 1).collect()
    sizes = np.bincount([r["fold"] for r in folds])
    assert len(folds) == 750 and sizes.max() - sizes.min() <= 1
    assert {(r["patient_id"], r["fold"]) for r in folds} == {(r["patient_id"], r["fold"]) for r in resample.patient_folds(df, 4, 1).collect()}
    weights = resample.bootstrap_weights(df, 5, 3).groupBy("rep").agg(F.sum("k").alias("n"), F.count("*").alias("d")).collect()
    assert len(weights) == 5 and all(r["n"] == 750 and 400 < r["d"] < 540 for r in weights)


def test_survival_edges(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 1.0, 1), ("b", 2.0, 2), ("c", 5.0, 0), ("c", 5.0, 0), ("d", 5.0, 0)], "patient_id string, time double, event int")
    known = survival.with_ipcw(df, 3.0)
    counts = metrics.horizon_counts(known, 3.0).first()
    assert (counts["case_patients"], counts["case_rows"], counts["control_patients"], counts["rows_observed_through_horizon"]) == (1, 2, 3, 3)
    last = survival.kaplan_meier(df.filter("event > 0")).orderBy(F.desc("time")).first()
    assert last["survival"] == 0.0  # a factor of zero is no logarithm
    at_tau = survival.with_ipcw(spark.createDataFrame([(3.0, 0), (1.0, 1)], "time double, event int"), 3.0).orderBy("time").collect()
    assert at_tau[1]["known"] and at_tau[1]["w"] == 1.0  # censored at the horizon is a control


def test_feature_pipeline(spark):
    rows = [(float(i), None if i % 4 == 0 else float(i % 10), "a" if i % 2 else "b", None if i == 3 else True) for i in range(60)] + [(60.0, 1.0, "rare", False)]
    df = spark.createDataFrame(rows, "x double, y double, c string, b boolean")
    p = features.FeaturePipeline(numeric=["x", "y"], binary=["b"], categorical=["c"], spline=["x"]).fit(df)
    out = p.transform(df)
    assert [c for c in out.columns if c.startswith("c__")] == ["c__a", "c__b", "c__other"] and "y__missing" in out.columns and "x__missing" not in out.columns and "b__missing" in out.columns
    r = out.agg(F.avg("y"), F.stddev_pop("y"), F.sum("c__other")).first()
    assert abs(r[0]) < 1e-9 and abs(r[1] - 1) < 1e-9 and r[2] == 1
    unseen = p.transform(spark.createDataFrame([(1e9, None, "new", None)], "x double, y double, c string, b boolean")).first()
    assert unseen["c__other"] == 1.0 and unseen["b"] == 0.0 and unseen["b__missing"] == 1.0
    basis = [unseen[c] for c in out.columns if c.startswith("x__s")]
    assert abs(sum(basis) - 1) < 1e-9  # constant beyond the outer knots
    with pytest.raises(ValueError):
        features.FeaturePipeline(numeric=["z"]).fit(df.withColumn("z", F.lit(None).cast("double")))


def test_boosting_lowers_the_loss(sample):
    df = sample[0]
    model = boost.BoostedCox(["x", "z"], trees=4, rate=0.3).fit(df, F.col("event") == 1, every=2)
    out = model.staged(df, [1, 4])
    c1, c4 = (metrics.concordance(out.select("time", (F.col("event") == 1).cast("int").alias("event"), F.col(s).alias("pred"))).first()["concordance"] for s in ("score_1", "score_4"))
    assert c4 >= c1 > 0.55


def test_pairing_errors(spark):
    a = spark.createDataFrame([(1, 0), (2, 1)], "k int, event int")
    b = spark.createDataFrame([(1, 0), (2, 0)], "k int, event int")
    with pytest.raises(experiments.PairingError, match="disagrees"):
        experiments.pair_tables({"a": a, "b": b}, ["k"], ["event"])
    with pytest.raises(experiments.PairingError, match="duplicate"):
        experiments.pair_tables({"a": a.union(a), "b": b}, ["k"])
    assert experiments.pair_tables({"a": a, "b": a}, ["k"], ["event"]).count() == 2
