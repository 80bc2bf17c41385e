"""Curves and quantiles that no single task orders, against numpy; changes assumed for one request leave others alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.operators import experiments, staging, survival


@pytest.fixture(scope="module")
def times(spark):
    """A hundred thousand continuous times in one group, few tied ones in another, and a null group."""
    r = np.random.default_rng(3)
    n = 100_000
    time = np.r_[r.exponential(2.0, n), r.integers(1, 30, 3000) / 7, [1.0, 2.0, 2.0]]
    event = r.choice([0, 0, 1, 2, 3], len(time))
    group = ["big"] * n + ["tied"] * 3000 + [None] * 3
    import pandas as pd

    return time, event, np.asarray(group, object), spark.createDataFrame(pd.DataFrame({"time": time, "event": event, "route": group, "risk": np.exp(np.sin(time * 99))}))


def curves(time, event, risk):
    at = np.unique(time)
    d = {k: np.bincount(np.searchsorted(at, time[event == k]), minlength=len(at)) for k in range(4)}
    n = np.bincount(np.searchsorted(at, time), minlength=len(at))[::-1].cumsum()[::-1]
    weight = np.bincount(np.searchsorted(at, time), weights=risk, minlength=len(at))[::-1].cumsum()[::-1]
    every = d[1] + d[2] + d[3]
    s = np.cumprod(1 - every / n)
    before = np.r_[1.0, s[:-1]]
    return at, s, np.cumprod(1 - d[0] / n), np.cumsum(before * d[2] / n), np.cumsum(d[1] / weight), n


def test_curves_equal_numpy(times):
    time, event, group, df = times
    km, censoring = (survival.kaplan_meier(df, ["route"], of=x).toPandas() for x in ("d", "c"))
    aj, na = survival.aalen_johansen(df, ["route"]).toPandas(), survival.nelson_aalen(df, ["route"], "risk", 1).toPandas()
    support = {r["route"]: r["support_time"] for r in survival.followup_support(df, 10, ["route"]).collect()}
    for g in ("big", "tied", None):
        own = np.asarray([x is g or x == g for x in group])
        at, s, c, cif2, h, n = curves(time[own], event[own], np.exp(np.sin(time[own] * 99)))
        part = lambda t: t[t["route"].isna() if g is None else t["route"] == g].sort_values("time")  # noqa: E731, B023
        for table, column, want in ((km, "survival", s), (censoring, "survival", c), (aj, "survival", s), (aj, "cif2", cif2), (na, "cumulative_hazard", h)):
            t = part(table)
            assert np.allclose(t[column], want[np.searchsorted(at, t["time"])], rtol=0, atol=1e-9)
        assert len(part(km)) == len(np.unique(time[own][event[own] > 0]))
        assert support[g] == (np.sort(time[own])[-10] if own.sum() >= 10 else 0.0)


def test_no_window_orders_a_whole_group(times):
    plan = survival.aalen_johansen(times[3], ["route"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "windowspecdefinition" in line]
    assert windows and all("__part" in line for line in windows)


def test_quantiles_equal_numpy(times):
    time, _, group, df = times
    probabilities = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    odd = df.withColumn("x", F.when(F.col("time") < 3, F.col("time"))).withColumn("same", F.lit(2.0)).withColumn("none", F.lit(None).cast("double"))
    cells = {c: F.col(c) for c in ("time", "x", "same", "none")}
    found = {(r["route"], r["name"]): r for r in staging.exact_quantiles(odd, cells, probabilities, ["route"]).collect()}
    assert len(found) == 9
    for g in ("big", "tied", None):
        own = time[np.asarray([v is g or v == g for v in group])]
        assert np.allclose(found[g, "time"]["q"], np.quantile(own, probabilities), atol=1e-12) and found[g, "time"]["n"] == len(own)
        assert np.allclose(found[g, "x"]["q"], np.quantile(own[own < 3], probabilities), atol=1e-12) and found[g, "same"]["q"] == [2.0] * 6
    assert staging.quantile_table(df.limit(0), {"time": F.col("time")}, [0.5]) == {}


def test_requests_of_a_patient_do_not_see_each_others_changes(spark):
    day = lambda c: F.to_date(c)
    requests = spark.createDataFrame([(1, "2020-01-01"), (1, "2021-01-01"), (2, "2020-06-01")], "patient_id long, d string").select("patient_id", day("d").alias("prediction_date"))
    patients = spark.createDataFrame([(1, "2018-01-01"), (2, "2018-01-01")], "patient_id long, d string").select("patient_id", day("d").alias("implant_date"))
    studies = spark.createDataFrame([(p, 10 * p + i, d, g, 1.8, 0.5, 0) for p in (1, 2) for i, (d, g) in enumerate([("2018-03-01", 10.0), ("2019-06-01", 11.0), ("2020-08-01", 12.0)])], "patient_id long, seq long, d string, mean_gradient double, eoa double, dvi double, ar int")
    studies = studies.select("*", day("d").alias("date")).drop("d").withColumns({"lvef": F.lit(55.0), "svi": F.lit(35.0)})
    exposures = spark.createDataFrame([(1, 1, "FXa", "2019-01-01")], "patient_id long, seq long, class string, d string").select("patient_id", "seq", "class", F.lit("af").alias("indication"), day("d").alias("start_date"), F.lit(None).cast("date").alias("stop_date"), F.lit(False).alias("post_suspicion"))
    mechanism = spark.createDataFrame([], "patient_id long, date date, type string")
    tables = {"patients": patients, "studies": studies, "exposures": exposures, "mechanism": mechanism}
    worse = {"mean_gradient": F.lit(45.0), "eoa": F.lit(0.6), "dvi": F.lit(0.2), "ar": F.lit(0), "lvef": F.lit(55.0), "svi": F.lit(35.0)}
    change = {"class": F.lit("VKA"), "indication": F.lit("af"), "post_suspicion": F.lit(False)}

    def scored(asked):
        changed = experiments.what_if(asked, tables, worse, 30, change)
        status = experiments.score_status(asked, *(changed[t] for t in ("patients", "studies", "exposures", "mechanism"))).collect()
        features = experiments.request_features(asked, patients, changed["studies"]).collect()
        seen = changed["exposures"].filter("only_at is not null").select("only_at", "class", "start_date", "stop_date").collect()
        return {tuple(r) for r in status}, {tuple(sorted(r.asDict().items(), key=str)) for r in features}, {tuple(r) for r in seen}

    together = scored(requests)
    apart = [scored(requests.filter((F.col("patient_id") == p) & (F.col("prediction_date") == F.to_date(F.lit(d))))) for p, d in ((1, "2020-01-01"), (1, "2021-01-01"), (2, "2020-06-01"))]
    for k in range(3):
        assert together[k] == set().union(*(a[k] for a in apart))
    stops = {(str(a), c): str(b) for a, c, _, b in together[2]}
    assert stops["2020-01-01", "FXa"] == "2020-01-01" and stops["2021-01-01", "FXa"] == "2021-01-01"
