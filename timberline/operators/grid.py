"""Experiment grids that go on where they stopped, and the full ladder of metrics over them.

A cell (say, a model step without a fold) is named by a hash of what it depends on: its settings and the fingerprint of the
data. Its rows are written under that name, and a cell counts as finished when its write was committed. A run computes the
planned cells that are not finished and reads all of them back, so a lost run repeats no finished cell, and a change of
settings or data repeats those it touches.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.operators import cif, cox, metrics, resample, survival
from timberline.operators.staging import broadcast_if_small, equal_keys, stage
from timberline.sources.tables import table_hash


def cell_key(settings: Mapping, fingerprint: str) -> str:
    return hashlib.sha256(json.dumps({"settings": settings, "data": fingerprint}, sort_keys=True, default=str).encode()).hexdigest()[:24]


def finished_cells(spark: SparkSession, folder: str) -> set[str]:
    """Keys of the cells whose write was committed (a bounded list: one name a cell)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return set()
    names = [s.getPath() for s in fs.listStatus(path) if s.isDirectory()]
    return {p.getName().removeprefix("cell-") for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))}


def run_grid(spark: SparkSession, folder: str, cells: Sequence[Mapping], fingerprint: str, compute: Callable[[Mapping], DataFrame]) -> DataFrame:
    """All planned cells' rows, with their settings as columns. ``compute`` is called for unfinished cells only; what a lost run
    left half written is overwritten."""
    keys = [cell_key(c, fingerprint) for c in cells]
    done = finished_cells(spark, folder)
    for cell, key in zip(cells, keys, strict=True):
        if key not in done:
            compute(cell).write.mode("overwrite").parquet(f"{folder}/cell-{key}")
    out = None
    for cell, key in zip(cells, keys, strict=True):
        rows = spark.read.parquet(f"{folder}/cell-{key}").select("*", *(F.lit(v).alias(k) for k, v in cell.items() if isinstance(v, (str, int, float, bool))))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def out_of_fold_grid(
    rows: DataFrame, steps: Mapping[str, Sequence[str]], folds: int, horizons: Sequence[float], causes: Mapping[str, int], grid: Sequence[float], folder: str,
    seed: int = 0, patient: str = "patient_id", stratum: str = "route", gates: dict | None = None, fit: Callable[[str, DataFrame], object] | None = None,
) -> DataFrame:
    """(row_id, step, fold, horizon, states): out-of-fold probabilities of every step, one resumable cell per step and fold.
    ``fit(step, training rows)`` gives a model with ``hazards(rows, grid)``; by default a cause-specific Cox model."""
    spark = rows.sparkSession
    folded = stage(rows.join(resample.patient_folds(rows, folds, seed, patient), patient), "folds")
    fingerprint = str(tuple(table_hash(folded).first()))
    names = list(causes)

    def default(step: str, train: DataFrame):
        return cox.CauseSpecificCox(list(steps[step]), stratum, causes=dict(causes), gates=gates or dict(cox.GATES)).fit(train, patient)

    def compute(cell: Mapping) -> DataFrame:
        model = (fit or default)(cell["step"], folded.filter(F.col("fold") != cell["fold"]))
        held = model.hazards(folded.filter(F.col("fold") == cell["fold"]), grid).filter("support = ''").select("row_id", *names)
        return cif.at_horizons(cif.combine(held, names), grid, horizons, names)

    cells = [{"step": s, "fold": k, "columns": list(columns), "horizons": list(horizons), "grid": list(grid), "causes": dict(causes), "gates": gates or cox.GATES, "seed": seed, "folds": folds} for s, columns in steps.items() for k in range(folds)]
    return run_grid(spark, folder, cells, fingerprint, compute).select("row_id", "step", "fold", "horizon", *names, "alive_intact")


def ladder_metrics(
    rows: DataFrame, predictions: DataFrame, horizons: Sequence[float], causes: Mapping[str, int], weightings: Mapping[str, Column | None], gates: Mapping, patient: str = "patient_id", by: Sequence[str] = (),
) -> DataFrame:
    """(step, state, horizon, weighting): Brier score, null score, IPA, AUC, observed and mean predicted, support counts and the
    gate's verdict; metrics without support are NULL. One grouped job over all of these, from ``predictions`` (row_id, step,
    horizon, states). ``weightings`` are weights over the rows (None: all alike), as expressions. With ``by`` every subgroup is a
    population of its own, with its own censoring, marginal incidence and gates."""
    by = list(by)
    base = stage(rows.select("row_id", patient, "time", "event", *by, *((F.lit(1.0) if w is None else w).cast("double").alias(f"q_{n}") for n, w in weightings.items())), "ladder")
    censoring = stage(survival.kaplan_meier(base, by, of="c"), "censoring")
    states = [*causes, "alive_intact"]
    known = None
    for tau in horizons:
        one = survival.with_ipcw(base, tau, by, next(iter(causes.values())), censoring=censoring).withColumn("horizon", F.lit(float(tau)))
        free = survival.event_free(F.col("time"), F.col("event"), tau)
        y = {**{n: (F.col("time") <= tau) & (F.col("event") == code) for n, code in causes.items()}, "alive_intact": free}
        through = (F.col("time") >= tau - survival.TIME_TOL) & ~((F.col("time") <= tau) & (F.col("event") != 0))
        one = one.withColumns({f"y_{n}": c.cast("double") for n, c in y.items()}).withColumn("through", through)
        known = one if known is None else known.unionByName(one)
    marginal = survival.at_horizons(survival.aalen_johansen(base, by, tuple(causes.values())), by, horizons, base if by else base.limit(1), tuple(causes.values()))
    each = F.array(*(F.struct(F.lit(n).alias("state"), F.col(f"cif{code}").alias("observed")) for n, code in causes.items()), F.struct(F.lit("alive_intact").alias("state"), F.col("survival").alias("observed")))
    marginal = marginal.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("horizon").alias("__h"), F.inline(each)).withColumnRenamed("state", "__s")
    scored = known.drop("y").join(predictions.select("row_id", "step", "horizon", *(F.col(s).alias(f"p_{s}") for s in states)), ["row_id", "horizon"])
    long = scored.select("row_id", patient, *by, "step", "horizon", "w", "known", "through", *(f"q_{n}" for n in weightings), F.inline(F.array(*(F.struct(F.lit(s).alias("state"), F.col(f"y_{s}").alias("y"), F.col(f"p_{s}").alias("pred")) for s in states))))
    named = [f"__{c}" for c in by]
    long = stage(long.join(broadcast_if_small(marginal, name="marginal"), equal_keys([*by, "horizon", "state"], [*named, "__h", "__s"])).drop(*named, "__h", "__s"), "long")
    weighted = long.select("*", F.inline(F.array(*(F.struct(F.lit(n).alias("weighting"), F.col(f"q_{n}").alias("q")) for n in weightings))))
    keys = [*by, "step", "state", "horizon", "weighting"]
    loss = lambda p: F.sum(F.col("q") * F.col("w") * (F.col("y") - p) ** 2) / F.sum("q")
    sums = weighted.groupBy(*keys).agg(loss(F.col("pred")).alias("brier"), loss(F.col("observed")).alias("brier_null"), F.first("observed").alias("observed"), (F.sum(F.col("q") * F.col("pred")) / F.sum("q")).alias("mean_predicted"), F.count("*").alias("n_rows"))
    auc = metrics.auc(weighted.withColumn("w", F.col("w") * F.col("q")), keys)
    case, control = (F.col("y") == 1) & F.col("known"), (F.col("y") == 0) & F.col("known")
    cells = [*by, "step", "state", "horizon"]
    counts = long.groupBy(*cells).agg(F.countDistinct(F.when(case, F.col(patient))).alias("case_patients"), F.countDistinct(F.when(control, F.col(patient))).alias("control_patients"), F.sum(F.col("through").cast("long")).alias("rows_observed_through_horizon"))
    at = censoring.select(*(F.col(c).alias(n) for c, n in zip(by, named, strict=True)), F.col("time").alias("__t"), "survival")
    before = (F.col("__t") < F.col("horizon")) & equal_keys(by, named)
    g = known.select(*by, "horizon").distinct().join(at, before, "left").groupBy(*by, "horizon").agg(F.coalesce(F.min("survival"), F.lit(1.0)).alias("g_at_tau"))
    same = lambda left, right, on: left.join(right.withColumnsRenamed({c: f"__{c}" for c in on}), equal_keys(on, [f"__{c}" for c in on])).drop(*(f"__{c}" for c in on))
    gated = metrics.metric_gate(same(counts, broadcast_if_small(g, name="censoring"), [*by, "horizon"]), F.col("g_at_tau"), dict(gates))
    out = same(same(sums, auc, keys), gated, cells).withColumn("ipa", 1 - F.col("brier") / F.col("brier_null"))
    shown = metrics.withhold(out, ["brier", "brier_null", "ipa", "auc"])
    return shown.select(*keys, "brier", "brier_null", "ipa", "auc", "observed", "mean_predicted", "n_rows", "case_patients", "control_patients", "g_at_tau", "gate_status")
