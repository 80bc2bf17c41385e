"""Replicates in one pass against resampling row by row; components of stars, chains and cliques."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.operators import boost, profile, replicates, resample

REPS = 12


@pytest.fixture(scope="module")
def sample(spark):
    r = np.random.default_rng(8)
    n = 300
    rows = [(i, int(i // 2), ("a", "b", None)[i % 3 if i % 30 else 2], float(r.integers(1, 25)), int(r.choice([0, 1, 1])), float(r.integers(0, 9)) / 8, float(r.normal()), float(r.random())) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id long, patient_id long, route string, time double, event int, pred double, z double, w double")
    lists = {x["patient_id"]: x["reps"] for x in resample.bootstrap_lists(df, REPS).collect()}
    return rows, df, lists, df.join(resample.bootstrap_lists(df, REPS), "patient_id")


def drawn(rows, lists, rep):
    """The replicate's rows, repeated as drawn."""
    return [r for r in rows for _ in range(sum(x == rep for x in lists[r[1]]))]


def test_draws_are_those_of_the_weights(spark, sample):
    rows, df, lists, _ = sample
    weights = {(r["rep"], r["patient_id"]): r["k"] for r in resample.bootstrap_weights(df, REPS).collect()}
    assert all(x[0] == 0 for x in lists.values())
    for p, x in lists.items():
        for rep in range(REPS):
            assert sum(y == rep + 1 for y in x) == weights.get((rep, p), 0)
    sums = resample.bootstrap(df, lambda d, g, w: d.groupBy(*g).agg(F.sum(w).alias("n")), REPS)
    assert sorted(r["rep"] for r in sums.collect()) == list(range(REPS))


@pytest.mark.parametrize("partitions", ["1", "4", "37"])
def test_concordance_and_auc(spark, sample, partitions):
    rows, _, lists, df = sample
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["route"], r["rep"]): r["concordance"] for r in replicates.concordance_replicates(df, REPS, ["route"]).collect()}
        marked = df.withColumn("y", (F.col("event") == 1).cast("int")).withColumn("known", F.col("row_id") % 7 > 0)
        auc = {r["rep"]: r["auc"] for r in replicates.auc_replicates(marked, REPS).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == 3 * (REPS + 1) and len(auc) == REPS + 1
    for rep in (0, 1, 5, REPS):
        own = drawn(rows, lists, rep)
        for route in ("a", "b", None):
            t, e, p = (np.asarray([r[i] for r in own if r[2] == route]) for i in (3, 4, 5))
            later = (t[None, :] > t[:, None]) | ((t[None, :] == t[:, None]) & (e[None, :] == 0))
            pair = (e[:, None] == 1) & later
            right = (p[:, None] > p[None, :]) + 0.5 * (p[:, None] == p[None, :])
            assert got[route, rep] == pytest.approx((pair * right).sum() / pair.sum(), abs=1e-12)
        case, control = [r for r in own if r[4] == 1], [r for r in own if r[4] == 0 and r[0] % 7]
        num = sum(a[7] * b[7] * ((a[5] > b[5]) + 0.5 * (a[5] == b[5])) for a in case for b in control)
        assert auc[rep] == pytest.approx(num / (sum(a[7] for a in case) * sum(b[7] for b in control)), abs=1e-12)


def test_intervals_are_percentiles(spark):
    df = spark.createDataFrame([("x", r, float(r) if r != 3 else None) for r in range(40)] + [("few", 0, 1.0), ("few", 1, 2.0)], "g string, rep int, v double")
    got = {r["g"]: r for r in replicates.replicate_intervals(df, "v", ["g"]).collect()}
    own = [r for r in range(1, 40) if r != 3]
    assert (got["x"]["value"], got["x"]["valid"]) == (0.0, 38) and got["x"]["low"] == pytest.approx(np.quantile(own, 0.025)) and got["x"]["high"] == pytest.approx(np.quantile(own, 0.975))
    assert got["few"]["low"] is None and got["few"]["value"] == 1.0


def dense_fit(z, time, event, offset, strata, penalizer=0.05):
    beta = np.zeros(z.shape[1])
    for _ in range(40):
        g, h = -penalizer * beta, -penalizer * np.eye(len(beta))
        for s in np.unique(strata):
            own = strata == s
            zs, ts, es, w = z[own], time[own], event[own], np.exp(offset[own] + z[own] @ beta)
            for i in np.flatnonzero(es):
                at = ts >= ts[i]
                mean = (w[at, None] * zs[at]).sum(axis=0) / w[at].sum()
                g = g + zs[i] - mean
                h = h - ((w[at, None, None] * zs[at][:, :, None] * zs[at][:, None, :]).sum(axis=0) / w[at].sum() - np.outer(mean, mean))
        step = np.linalg.solve(h, -g)
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    return beta


@pytest.mark.parametrize("chunk_rows", [17, 10_000])
def test_replicate_fits_and_wald(spark, sample, chunk_rows):
    rows, df, lists, listed = sample
    known, listed = [r for r in rows if r[2]], listed.filter("route is not null")
    beta, ok = replicates.fit_replicates(listed, ["pred", "z"], F.col("event") == 1, REPS, strata=F.col("route"), offset=F.col("w"), tol=1e-10, chunk_rows=chunk_rows)
    assert ok.all() and beta.shape == (REPS + 1, 2)
    for rep in (0, 1, 7):
        own = drawn(known, lists, rep)
        z, time, event, offset = np.asarray([[r[5], r[6]] for r in own]), *(np.asarray([float(r[i]) for r in own]) for i in (3, 4, 7))
        assert np.allclose(beta[rep], dense_fit(z, time, event, offset, np.asarray([r[2] for r in own])), atol=1e-6)
    if chunk_rows > 100:
        found = boost.bootstrap_wald(df.filter("route is not null"), ["pred", "z"], F.col("event") == 1, REPS, strata=F.col("route"), offset=F.col("w"), least=5)
        assert found["n_ok"] == REPS and 0 < found["p_value"] <= 1
        lists2 = {x["patient_id"]: x["reps"] for x in resample.bootstrap_lists(df.filter("route is not null"), REPS).collect()}
        draws = []
        for rep in range(1, REPS + 1):
            own = drawn(known, lists2, rep)
            z, time, event, offset = np.asarray([[r[5], r[6]] for r in own]), *(np.asarray([float(r[i]) for r in own]) for i in (3, 4, 7))
            draws.append(dense_fit(z, time, event, offset, np.asarray([r[2] for r in own])))
        v = np.cov(np.asarray(draws), rowvar=False)
        assert found["statistic"] == pytest.approx(beta[0] @ np.linalg.pinv(v) @ beta[0], rel=1e-3)


def test_chi_squared_tail():
    # fixed values of the distribution
    for x, df, p in ((3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (9.487729, 4, 0.05), (20.515, 5, 0.001)):
        assert boost.chi2_tail(x, df) == pytest.approx(p, abs=1e-6)


def test_profile_errors(spark):
    r = np.random.default_rng(2)
    rows = [(p, v, "baseline", float(r.normal()), None) for p in range(60) for v in ("a", "b") if (p, v) != (3, "a")] + [(p, "c", "baseline", None, ("yes", "no", "rare")[0 if p % 3 else 1 if p else 2]) for p in range(60)]
    first = spark.createDataFrame(rows, "person_id long, variable string, kind string, value double, value_text string")
    lists = {x["person_id"]: x["reps"] for x in resample.bootstrap_lists(first, REPS, 0, "person_id").collect()}
    got = {(x["variable"], x["statistic"]): x for x in profile.bootstrap_errors(first, REPS, quantiles=[0.25]).collect()}

    def values(variable, rep, text=False):
        return np.asarray([x[4 if text else 3] for x in rows if x[1] == variable for _ in range(sum(y == rep for y in lists[x[0]]))])

    for variable in ("a", "b"):
        for name, f in (("mean", np.mean), ("sd", lambda v: np.std(v, ddof=1)), ("quantile:0.25", lambda v: np.quantile(v, 0.25))):
            assert got[variable, name]["value"] == pytest.approx(f(values(variable, 0)))
            assert got[variable, name]["se"] == pytest.approx(np.std([f(values(variable, k)) for k in range(1, REPS + 1)], ddof=1))
    for level in ("yes", "no", "rare"):
        share = [np.mean(values("c", k, True) == level) for k in range(1, REPS + 1)]
        assert got["c", f"proportion:{level}"]["se"] == pytest.approx(np.std(share, ddof=1)) and got["c", f"proportion:{level}"]["valid"] == REPS
    c = profile.correlation_error(first, "a", "b", REPS).first()
    pair = first.filter("variable <> 'c'")
    assert c["n"] == 59 and pair.count() == 119 and c["se"] > 0 and c["low"] <= c["correlation"] <= c["high"]


def test_components(spark):
    r = np.random.default_rng(1)
    star = [(0, i) for i in range(5000, 9000)]
    chain = [(i, i + 1) for i in range(10_000, 10_300)]
    loose = [(20_000 + int(a), 20_000 + int(b)) for a, b in r.integers(0, 400, (300, 2))]
    edges = star + chain + loose + [(50_000, 50_000), (50_001, 50_001), (50_001, 50_000), (7000, 10_150)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long")
    got = {x["node"]: x["label"] for x in profile.connected(df).collect()}
    assert got == {x: find(x) for x in parent}
    assert profile.connected(df.limit(0)).count() == 0 and {tuple(x) for x in profile.connected(spark.createDataFrame([(4, 4)], "a long, b long")).collect()} == {(4, 4)}
