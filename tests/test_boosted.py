"""Boosted hazards against a dense version, local and spread over chunks; stages against refits; tuning against its parts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.operators import boosted, experiments, resample

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def sample(spark):
    r = np.random.default_rng(5)
    n = 700
    a, b = r.integers(0, 12, n).astype(float), r.normal(size=n).round(3)
    time = np.minimum(np.ceil(20 * r.exponential(np.exp(-0.15 * a + 0.4 * b))) / 10, 4.0)  # many ties, a third at the end
    event = np.where(time >= 4.0, 0, r.choice([0, 1, 1, 2], n))
    rows = [(i, int(i // 2), ("SAVR", "TAVR", "SAVR")[i % 3], float(time[i]), int(event[i]), float(a[i]), float(b[i]) if i % 50 else None, 1.0 if i % 3 == 1 else float(i % 5)) for i in range(n)]
    rows += [(n + i, n + i, "rare", 1.0 + i, 1, 0.0, 0.0, 0.0) for i in range(3)]
    return rows, spark.createDataFrame(rows, "row_id long, patient_id long, route string, time double, event int, a double, b double, c double")


def dense(x, edges, time, event, trees, rate, depth, least):
    """Scores after every number of trees, by explicit risk sets and exhaustive splits."""
    bins = np.stack([boosted.binned(x[:, f], e) for f, e in enumerate(edges)], axis=1)
    score, out = np.zeros(len(time)), []
    for _ in range(trees):
        w = np.exp(score)
        risk = np.asarray([w[time >= t].sum() for t in time])
        grad = event - w * np.asarray([(event[time <= t] / risk[time <= t]).sum() for t in time])

        def grow(rows, level):
            value = np.full(len(rows), grad[rows].mean())
            best = (1e-12, None)
            if level < depth:
                for f in range(bins.shape[1]):
                    for cut in range(len(edges[f])):
                        left = bins[rows, f] <= cut
                        if left.sum() < least or (~left).sum() < least:
                            continue
                        g = grad[rows]
                        gain = g[left].sum() ** 2 / left.sum() + g[~left].sum() ** 2 / (~left).sum() - g.sum() ** 2 / len(g)
                        if gain > best[0] + 1e-9 * max(1.0, abs(gain)):
                            best = (gain, left)
            if best[1] is not None:
                value = np.empty(len(rows))
                value[best[1]], value[~best[1]] = grow(rows[best[1]], level + 1), grow(rows[~best[1]], level + 1)
            return value

        score = score + rate * grow(np.arange(len(time)), 0)
        out.append(score)
    return out


def fit(df, **options):
    gates = {"fit_min_unique_events": 20, "baseline_min_unique_events": 2}
    return boosted.BoostedHazards(COLUMNS, trees=options.pop("trees", 6), rate=0.3, min_instances=15, bins=16, gates=gates, causes={"svd": 1, "death": 2}, **options).fit(df)


@pytest.mark.parametrize("options", [{}, {"chunk_rows": 23}, {"local_rows": 0, "chunk_rows": 60, "trees": 1}])
def test_equals_a_dense_version(sample, options):
    rows, df = sample
    model = fit(df, **options)
    trees = model.trees
    got = {r["row_id"]: r["scores"] for r in model.staged_scores(df, list(range(1, trees + 1))).collect()}
    assert model.models["TAVR"].columns == ["a", "b"]  # c does not vary there
    for route in ("SAVR", "TAVR"):
        own = [r for r in rows if r[2] == route]
        used = model.models[route].columns
        x = np.asarray([[np.nan if r[5 + COLUMNS.index(c)] is None else r[5 + COLUMNS.index(c)] for c in used] for r in own])
        for j, code in enumerate((1, 2)):
            want = dense(x, [model.models[route].edges[c] for c in used], np.asarray([r[3] for r in own]), np.asarray([float(r[4] == code) for r in own]), trees, 0.3, model.depth, 15)
            for k in range(trees):
                assert np.allclose([got[r[0]][k][j] for r in own], want[k], atol=1e-6)


def test_gates_support_and_stages(spark, sample):
    rows, df = sample
    model = fit(df, trees=5)
    assert model.models["rare"].status == {"svd": "reduced_baseline_only", "death": "insufficient_events"}
    grid = [0.25 * k for k in range(17)]
    odd = df.withColumn("route", F.when(F.col("row_id") == 0, "other").otherwise(F.col("route")))
    found = {r["row_id"]: r for r in model.hazards(odd, grid).collect()}
    assert found[0]["support"] == "unknown_device_or_route" and found[0]["svd"] is None
    assert found[700]["support"] == "insufficient_events:death" and found[700]["svd"] is None
    # a stage equals a fit of that many trees, baselines and all
    early = {(r["row_id"], r["horizon"]): r for r in model.probabilities(df, grid, [1.0, 3.0], [2, 5]).filter("trees = 2").collect()}
    refit = {(r["row_id"], r["horizon"]): r for r in fit(df, trees=2).probabilities(df, grid, [1.0, 3.0]).collect()}
    assert set(early) == set(refit) and len(early) == 1400
    for k, r in early.items():
        assert all(r[s] == pytest.approx(refit[k][s], abs=1e-9) for s in ("svd", "death", "alive_intact"))
        assert r["svd"] + r["death"] + r["alive_intact"] == pytest.approx(1)
    # the hazard of a row by its definition
    own = [r for r in rows if r[2] == "SAVR"]
    scores = {r["row_id"]: r["scores"][0][0] for r in model.staged_scores(df).collect()}
    h = sum((r[4] == 1) / sum(math.exp(scores[q[0]]) for q in own if q[3] >= r[3]) for r in own if r[3] <= 2.0)
    assert found[2]["svd"][8] == pytest.approx(h * math.exp(scores[2]), rel=1e-9)


def test_tuning_scores_probabilities_of_its_own_stages(spark, sample):
    rows, df = sample
    df = df.filter("route <> 'rare'")
    options = {"grid": {"trees": [1, 4], "depth": [1], "rate": [0.3]}, "causes": {"svd": 1, "death": 2}, "horizons": [1.0, 3.0]}
    gates = {"fit_min_unique_events": 20, "baseline_min_unique_events": 2}
    chosen, table = experiments.nested_tuning(df, COLUMNS, folds=2, gates=gates, min_instances=15, **options)
    got = {(r["depth"], r["trees"]): r for r in table.collect()}
    assert len(got) == 2 and all(r["scored_cells"] == 8 for r in got.values())
    folds = {r["patient_id"]: r["fold"] for r in resample.patient_folds(df, 2, 0).collect()}
    cells = []
    for k in (0, 1):
        train = df.filter(~F.col("patient_id").isin([p for p, f in folds.items() if f == k]))
        test = df.filter(F.col("patient_id").isin([p for p, f in folds.items() if f == k]))
        model = boosted.BoostedHazards(COLUMNS, trees=1, depth=1, rate=0.3, min_instances=15, gates=gates, causes={"svd": 1, "death": 2}).fit(train)
        p = {(r["row_id"], r["horizon"]): r for r in model.probabilities(test, sorted({0.0, 1.0, 3.0, *(q / 4 for q in range(13))}), [1.0, 3.0]).collect()}
        held = [r for r in rows if r[2] != "rare" and folds[r[1]] == k]
        steps = {t: 1 - sum(r[4] == 0 and r[3] == t for r in held) / sum(r[3] >= t for r in held) for t in {r[3] for r in held}}
        g = lambda t: math.prod(f for u, f in steps.items() if u < t)  # noqa: E731, B023
        for code, name in ((1, "svd"), (2, "death")):
            for tau in (1.0, 3.0):
                loss = [(1 / g(r[3]) if r[3] <= tau and r[4] else 1 / g(tau) if r[3] > tau or (r[3] == tau and not r[4]) else 0.0) * ((r[3] <= tau and r[4] == code) - p[r[0], tau][name]) ** 2 for r in held]
                cells.append(sum(loss) / len(loss))
    assert got[1, 1]["mean_brier"] == pytest.approx(np.mean(cells), abs=1e-9)
    best = min(r["mean_brier"] for r in got.values())
    pick = chosen.first()
    assert (pick["depth"], pick["trees"]) == min(k for k, r in got.items() if r["mean_brier"] <= best + 1e-6)
    only = experiments.nested_tuning(df, COLUMNS, {"trees": [3], "depth": [2], "rate": [0.1]}, {"svd": 1}, [1.0])[0].first()
    assert (only["trees"], only["mean_brier"]) == (3, None)
