"""Grids go on where they stopped; ladder metrics equal plain sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.operators import grid, metrics
from timberline.operators.staging import stage_path


def test_a_lost_run_repeats_no_finished_cell(spark):
    folder, calls = stage_path(spark, "grid"), []

    def compute(cell):
        calls.append(cell["k"])
        if cell["k"] == 2 and len(calls) == 3:
            raise RuntimeError("lost")
        return spark.range(cell["k"]).withColumn("v", F.col("id") * cell["k"])

    cells = [{"k": k, "options": [1, k]} for k in range(1, 4)]
    order = [cells[0], cells[2], cells[1]]
    with pytest.raises(RuntimeError):
        grid.run_grid(spark, folder, order, "data", compute)
    assert calls == [1, 3, 2] and len(grid.finished_cells(spark, folder)) == 2
    out = grid.run_grid(spark, folder, cells, "data", compute)
    assert calls == [1, 3, 2, 2] and sorted((r["k"], r["v"]) for r in out.collect()) == [(k, i * k) for k in range(1, 4) for i in range(k)]
    grid.run_grid(spark, folder, cells, "data", compute)
    assert len(calls) == 4
    grid.run_grid(spark, folder, cells[:1], "other data", compute)
    grid.run_grid(spark, folder, [{"k": 1, "options": [7]}], "data", compute)
    assert len(calls) == 6
    # a cell without its commit mark is not finished
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/cell-{grid.cell_key(cells[0], 'data')}/_SUCCESS")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)
    grid.run_grid(spark, folder, cells, "data", compute)
    assert len(calls) == 7


def test_ladder_metrics_equal_plain_sums(spark):
    r = np.random.default_rng(4)
    n = 240
    time, event = r.integers(1, 41, n) / 10, r.choice([0, 1, 2], n)
    p = r.random((n, 2)) / 2
    rows = [(i, int(i // 3) if i < 200 else i, float(time[i]), int(event[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id long, patient_id long, time double, event int")
    oof = [(i, s, h, float(p[i, 0] * f), float(p[i, 1] * f), float(1 - p[i].sum() * f)) for i in range(n) for s, f in (("a", 1.0), ("b", 0.5)) for h in (1.5, 3.0)]
    predictions = spark.createDataFrame(oof, "row_id long, step string, horizon double, svd double, death double, alive_intact double")
    gates = {"metric_min_event_patients": 20, "metric_min_control_patients": 5, "slope_min_events": 20, "min_at_risk": 10}
    out = {(x["step"], x["state"], x["horizon"], x["weighting"]): x for x in grid.ladder_metrics(df, predictions, [1.5, 3.0], {"svd": 1, "death": 2}, {"pooled": None, "balanced": metrics.balanced_weight()}, gates).collect()}
    assert len(out) == 2 * 3 * 2 * 2
    times = np.unique(time)
    g = lambda t: np.prod([1 - ((time == u) & (event == 0)).sum() / (time >= u).sum() for u in times if u < t])
    pids = np.asarray([x[1] for x in rows])
    share = np.asarray([1 / (pids == q).sum() for q in pids])
    for (step, state, tau, weighting), x in out.items():
        had = (time <= tau) & (event != 0)
        free = ((time > tau) | ((time >= tau - 1e-9) & (event == 0))) & ~had
        w = np.where(had, [1 / g(t) for t in time], np.where(free, 1 / g(tau), 0.0))
        y = free if state == "alive_intact" else (time <= tau) & (event == {"svd": 1, "death": 2}[state])
        f = 1.0 if step == "a" else 0.5
        pred = 1 - p.sum(axis=1) * f if state == "alive_intact" else p[:, {"svd": 0, "death": 1}[state]] * f
        q = share if weighting == "balanced" else np.ones(n)
        known = had | free
        cases, controls = len(set(pids[known & y])), len(set(pids[known & ~y]))
        through = ((time >= tau - 1e-9) & ~had).sum()
        assert (x["case_patients"], x["control_patients"], x["n_rows"]) == (cases, controls, n)
        ok = through >= 10 and cases >= 20 and controls >= 5
        assert (x["gate_status"] == "ok") == ok
        if not ok:
            assert x["brier"] is None and x["auc"] is None
            continue
        assert x["brier"] == pytest.approx((q * w * (y - pred) ** 2).sum() / q.sum(), abs=1e-9) and x["ipa"] == pytest.approx(1 - x["brier"] / x["brier_null"])
        a, b = np.flatnonzero(y & (w > 0)), np.flatnonzero(~y & (w > 0))
        num = sum((q * w)[i] * (q * w)[j] * ((pred[i] > pred[j]) + 0.5 * (pred[i] == pred[j])) for i in a for j in b)
        assert x["auc"] == pytest.approx(num / ((q * w)[a].sum() * (q * w)[b].sum()), abs=1e-9)
