"""Centred offset models, family differences, subgroup metrics and reports by their definitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.operators import boost, cox, grid, profile, resample


@pytest.fixture(scope="module")
def sample(spark):
    r = np.random.default_rng(12)
    n = 300
    rows = [(i, int(i // 2), "ab"[i % 2], float(r.integers(1, 40)) / 8, int(r.choice([0, 1, 2])), float(r.random()), float(r.random()), float(r.normal())) for i in range(n)]
    return rows, spark.createDataFrame(rows, "row_id long, patient_id long, route string, time double, event int, p double, q double, z double")


def test_centred_offset(sample):
    rows, df = sample
    measured = F.col("row_id") % 3 > 0
    a = boost.offset_adjustment(df, {"t1": F.col("z"), "t2": F.col("z") * F.col("p")}, measured, F.col("q"), F.col("event") == 1, F.col("time") * F.exp("q"), F.col("route"))
    own = [r for r in rows if r[0] % 3]
    e, lin = np.asarray([r[3] * math.exp(r[6]) for r in own]), np.asarray([a.fit.beta[0] * r[7] + a.fit.beta[1] * r[7] * r[5] for r in own])
    assert a.centre == pytest.approx(math.log((e * np.exp(lin)).sum() / e.sum()))
    direct = cox.fit_cox(df.filter(measured).withColumns({"t1": F.col("z"), "t2": F.col("z") * F.col("p")}), ["t1", "t2"], F.col("event") == 1, strata=F.col("route"), offset=F.col("q"))
    assert np.allclose(a.fit.beta, direct.beta)
    # the expected number of events of the measured rows is unchanged
    out = a.adjust(df.withColumn("svd", F.array(F.lit(0.0), F.col("time") * F.exp("q"))).withColumn("death", F.array(F.lit(0.0), F.lit(2.0))), "svd").collect()
    assert sum(r["svd"][1] for r in out if r["row_id"] % 3) == pytest.approx(e.sum())
    assert all(r["svd"][1] == pytest.approx(r["time"] * math.exp(r["q"])) for r in out if r["row_id"] % 3 == 0) and all(r["death"] == [0.0, 2.0] for r in out)
    assert boost.offset_adjustment(df, {"t1": F.col("z")}, measured, F.col("q"), F.col("event") == 1, least_rows=10_000) is None


def test_family_differences(spark, sample):
    rows, df = sample
    known = df.select("row_id", "patient_id", F.explode(F.array(F.lit(1.0), F.lit(3.0))).alias("horizon"), (F.col("row_id") % 3 + 0.5).alias("w"), "time", "event")
    known = known.withColumns({"y_svd": ((F.col("time") <= F.col("horizon")) & (F.col("event") == 1)).cast("double"), "y_death": ((F.col("time") <= F.col("horizon")) & (F.col("event") == 2)).cast("double")}).drop("time", "event")
    at = lambda a, b, where: known.filter(where).join(df.select("row_id", "p", "q"), "row_id").select("row_id", "horizon", (F.col(a) / 2).alias("svd"), (F.col(b) / 2).alias("death"))
    families = {"cox": at("p", "q", F.lit(True)), "trees": at("q", "p", F.col("row_id") != 5), "flat": at("p", "p", F.lit(True))}
    got = {(r["family"], r["state"], r["horizon"]): r for r in boost.family_differences(known, families, "cox", ["svd", "death"], 10).collect()}
    assert len(got) == 2 * (4 + 1)
    lists = {r["patient_id"]: r["reps"] for r in resample.bootstrap_lists(df, 10).collect()}
    cells = {}
    for family, (a, b) in {"trees": (6, 5), "flat": (5, 5)}.items():
        for state, code, mine, theirs in (("svd", 1, a, 5), ("death", 2, b, 6)):
            for h in (1.0, 3.0):
                for rep in range(11):
                    num = den = 0.0
                    for r in rows:
                        k = sum(x == rep for x in lists[r[1]])
                        if r[0] == 5 or not k:
                            continue
                        y, w = float(r[3] <= h and r[4] == code), r[0] % 3 + 0.5
                        num += k * w * ((y - r[mine] / 2) ** 2 - (y - r[theirs] / 2) ** 2)
                        den += k
                    cells[family, state, h, rep] = num / den
    for (family, state, h), r in got.items():
        x = [cells[family, state, h, k] if state != "mean" else np.mean([v for (f, _, _, q), v in cells.items() if f == family and q == k]) for k in range(11)]
        assert r["difference"] == pytest.approx(x[0], abs=1e-12) and r["valid"] == 10
        assert (r["ci_low"], r["ci_high"]) == (pytest.approx(np.quantile(x[1:], 0.025)), pytest.approx(np.quantile(x[1:], 0.975)))


def test_subgroups_are_populations_of_their_own(spark, sample):
    _, df = sample
    p = df.select("row_id", F.lit("s").alias("step"), F.lit(2.0).alias("horizon"), (F.col("p") / 2).alias("svd"), (F.col("q") / 2).alias("death"), (1 - (F.col("p") + F.col("q")) / 2).alias("alive_intact"))
    gates = {"metric_min_event_patients": 5, "metric_min_control_patients": 5, "slope_min_events": 20, "min_at_risk": 10}
    call = lambda d, **o: d and grid.ladder_metrics(d, p, [2.0], {"svd": 1, "death": 2}, {"pooled": None}, gates, **o).collect()
    whole = {(r["route"], r["state"]): r for r in call(df.withColumn("route", F.when(F.col("route") == "a", "a")), by=["route"])}
    assert len(whole) == 6
    for route in ("a", "b"):
        for r in call(df.filter(F.col("route") == route)):
            got = whole[route if route == "a" else None, r["state"]]
            assert all(got[c] == pytest.approx(r[c]) for c in ("brier", "brier_null", "ipa", "auc", "observed", "g_at_tau", "case_patients", "n_rows"))


def test_reports(spark, sample):
    rows, df = sample
    got = {r["name"]: r for r in profile.report(df, [("m", "mean", {"column": "p"}), ("q1", "quantile", {"column": "p", "q": 0.25}), ("q2", "quantile", {"column": "z", "q": 0.9}), ("r", "correlation", {"column": "p", "other": "z"}), ("x", "proportion", {"condition": F.col("event") == 1})]).collect()}
    p, z = np.asarray([r[5] for r in rows]), np.asarray([r[7] for r in rows])
    assert got["q1"]["value"] == pytest.approx(np.quantile(p, 0.25)) and got["q2"]["value"] == pytest.approx(np.quantile(z, 0.9)) and got["q1"]["se"] == pytest.approx(1.2533 * p.std(ddof=1) / math.sqrt(300))
    c = np.corrcoef(p, z)[0, 1]
    assert (got["r"]["value"], got["r"]["se"]) == (pytest.approx(c), pytest.approx((1 - c * c) / math.sqrt(297))) and got["m"]["se"] == pytest.approx(p.std(ddof=1) / math.sqrt(300))
    out = {(r["name"], r["statistic"]): r for r in profile.report_times(df.withColumn("x", (F.col("route") == "a").cast("double")), [2.0], {"svd": 1, "death": 2}, "x").collect()}
    t, e = np.asarray([r[3] for r in rows]), np.asarray([r[4] for r in rows])
    s, f = 1.0, 0.0
    for u in np.unique(t[t <= 2.0]):
        at, d = (t >= u).sum(), ((t == u) & (e > 0)).sum()
        f += s * ((t == u) & (e == 1)).sum() / at
        s *= 1 - d / at
    assert out["all", "km_survival:2"]["value"] == pytest.approx(s) and out["svd", "cumulative_incidence:2"]["value"] == pytest.approx(f) and out["svd", "cumulative_incidence:2"]["se"] == pytest.approx(math.sqrt(f * (1 - f) / 300))
    assert {k for k in out if k[1] == "log_effect"} == {("svd", "log_effect"), ("death", "log_effect")} and out["svd", "log_effect"]["se"] > 0
