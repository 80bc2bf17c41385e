"""Cause-specific proportional hazards with distributed Newton steps.

Each step is one query for all causes still moving: sums of exp(eta) and its first and second moments per (cause, stratum,
time), running sums of these backwards in time, and one row per cause with likelihood, gradient and Hessian. Running sums are
windows while distinct times are few, and prefix sums over range partitions beyond. Ties follow Breslow; the ridge penalty is
on the summed log partial likelihood.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.operators.staging import last_before, prefix_sum, stage
from timberline.operators.survival import nelson_aalen

GATES = {"fit_min_unique_events": 30, "baseline_min_unique_events": 5, "min_at_risk": 10}


@dataclass
class CoxFit:
    columns: list[str]
    beta: np.ndarray
    se: np.ndarray
    loglik: float
    loglik_start: float
    converged: bool
    n: int
    n_events: int

    @property
    def likelihood_ratio(self) -> float:
        return max(0.0, 2 * (self.loglik - self.loglik_start))


def slack(value):
    """What a log likelihood may lose by rounding. Sums over more rows round at a larger absolute error, so a fixed bound would
    halve steps, and repeat them, for ever."""
    return 1e-12 + 1e-11 * abs(value)


def _objectives(data: DataFrame, columns: Sequence[str], betas: dict[int, np.ndarray], few_times: bool) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per cause (an index into ``hits``): log partial likelihood, gradient and Hessian at its coefficients."""
    p = range(len(columns))

    def eta(beta: np.ndarray) -> Column:
        out = F.col("offset")
        for c, b in zip(columns, beta, strict=True):
            out = out + float(b) * F.col(c)
        return out

    causes = F.array(*(F.struct(F.lit(k).alias("cause"), F.col("hits")[k].alias("hit"), eta(b).alias("eta")) for k, b in betas.items()))
    z = [F.col(c) for c in columns]
    w, d = F.exp("eta") * F.col("weight"), F.col("hit") * F.col("weight")
    upper = [(i, j) for i in p for j in p if i <= j]
    risk = {"s0": w, **{f"a{i}": w * z[i] for i in p}, **{f"b{i}_{j}": w * z[i] * z[j] for i, j in upper}}
    own = {"d": d, "de": d * F.col("eta"), **{f"g{i}": d * z[i] for i in p}}
    long = data.select("stratum", "time", "weight", *columns, F.inline(causes))
    sums = long.groupBy("cause", "stratum", "time").agg(*(F.sum(x).alias(k) for k, x in (own | risk).items()))
    if few_times:
        later = Window.partitionBy("cause", "stratum").orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sets = sums.select("cause", *own, *(F.sum(k).over(later).alias(f"r_{k}") for k in risk))
    else:
        sets = prefix_sum(sums.withColumn("back", -F.col("time")), ["cause", "stratum"], "back", {f"r_{k}": k for k in risk})
    r = lambda k: F.col(f"r_{k}")
    parts = {"ll": F.col("de") - F.col("d") * F.log(r("s0")), **{f"g{i}": F.col(f"g{i}") - F.col("d") * r(f"a{i}") / r("s0") for i in p}}
    parts |= {f"h{i}_{j}": -F.col("d") * (r(f"b{i}_{j}") / r("s0") - r(f"a{i}") * r(f"a{j}") / r("s0") ** 2) for i, j in upper}
    found = {x["cause"]: x for x in sets.filter("d > 0").groupBy("cause").agg(*(F.sum(x).alias(k) for k, x in parts.items())).collect()}
    out = {}
    for k in betas:
        x, h = found.get(k), np.zeros((len(columns), len(columns)))
        for i, j in upper:
            h[i, j] = h[j, i] = x[f"h{i}_{j}"] if x else 0.0
        out[k] = (x["ll"] if x else 0.0, np.asarray([x[f"g{i}"] if x else 0.0 for i in p], float), h)
    return out


def fit_cox_causes(
    rows: DataFrame,
    columns: Sequence[str],
    events: Sequence[Column],
    time: str = "time",
    strata: Column | None = None,
    offset: Column | None = None,
    weight: Column | None = None,
    penalizer: float = 0.05,
    max_iter: int = 50,
    tol: float = 1e-8,
) -> list[CoxFit]:
    """A ridge Cox fit of ``columns`` for each of the event conditions, all of them in the same passes over the rows; other
    events are censored. A column without variation keeps the coefficient 0, with an infinite standard error. Steps end when the
    gradient promises less than ``tol`` more of log likelihood; that last step is taken."""
    number = lambda c, x: F.lit(x) if c is None else c.cast("double")
    data = rows.select(
        (F.lit("all") if strata is None else strata.cast("string")).alias("stratum"), (F.col(time).cast("double") + 0.0).alias("time"), F.array(*(F.coalesce(e, F.lit(False)).cast("double") for e in events)).alias("hits"),
        number(weight, 1.0).alias("weight"), number(offset, 0.0).alias("offset"), *(F.col(c).cast("double").alias(c) for c in columns),
    )
    data = stage(data, "cox")
    counts = data.agg(F.count("*").alias("n"), F.approx_count_distinct("time").alias("times"), *(F.coalesce(F.sum(F.col("hits")[k]), F.lit(0.0)).alias(f"e{k}") for k in range(len(events)))).first()
    few_times = counts["times"] <= 200_000
    everyone, p = range(len(events)), len(columns)

    def objectives(betas: dict[int, np.ndarray]) -> dict[int, tuple]:
        return {k: (ll - 0.5 * penalizer * betas[k] @ betas[k], g - penalizer * betas[k], h - penalizer * np.eye(p), ll) for k, (ll, g, h) in _objectives(data, columns, betas, few_times).items()}

    beta = {k: np.zeros(p) for k in everyone}
    state = objectives(beta)
    start = {k: state[k][3] for k in everyone}
    moving, done = set(everyone) if p else set(), set() if p else set(everyone)
    for _ in range(max_iter):
        if not moving:
            break
        step = {k: np.linalg.lstsq(state[k][2], -state[k][1], rcond=None)[0] for k in moving}
        last = {k for k in moving if 0.5 * float(state[k][1] @ step[k]) < tol}  # what the step still gains, from the gradient
        size, trying = dict.fromkeys(moving, 1.0), set(moving)
        tried: dict[int, tuple] = {}
        while trying:
            tried |= objectives({k: beta[k] + size[k] * step[k] for k in trying})
            trying = {k for k in trying - last if tried[k][0] < state[k][0] - slack(state[k][0]) and size[k] > 1e-6}
            size |= {k: size[k] / 2 for k in trying}
        for k in list(moving):
            beta[k], state[k] = beta[k] + size[k] * step[k], tried[k]
        moving -= last
        done |= last
    out = []
    for k in everyone:
        information = -state[k][2]
        flat = np.diag(information) < 1e-12
        se = np.sqrt(np.clip(np.diag(np.linalg.pinv(information)), 0, None)) if p else np.zeros(0)
        out.append(CoxFit(list(columns), beta[k], np.where(flat, np.inf, se), state[k][3], start[k], k in done, int(counts["n"]), int(counts[f"e{k}"])))
    return out


def fit_cox(rows: DataFrame, columns: Sequence[str], event: Column, **options) -> CoxFit:
    """Ridge Cox for ``columns`` with a fixed offset; ``event`` is a condition, other causes are censored."""
    return fit_cox_causes(rows, columns, [event], **options)[0]


def baseline_on_grid(baseline: DataFrame, group: Sequence[str], grid: Sequence[float]) -> DataFrame:
    """(group columns, ``h``): the cumulative hazard at each grid point, by one merge sort of the grid with the steps."""
    points = F.array(*(F.lit(float(x) + 1e-12) for x in grid))
    marks = baseline.select(*group).distinct().withColumn("time", F.explode(points))
    steps = baseline.select(*group, F.col("time").cast("double").alias("time"), "cumulative_hazard")
    found = last_before(marks, steps, group, "time", "cumulative_hazard", "h")
    at = F.struct("time", F.coalesce("h", F.lit(0.0)).alias("h"))
    return found.groupBy(*group).agg(F.transform(F.sort_array(F.collect_list(at)), lambda x: x["h"]).alias("h"))


def linear_predictor(fit: CoxFit, means: dict[str, float] | None = None) -> Column:
    out = F.lit(0.0)
    for c, b in zip(fit.columns, fit.beta, strict=True):
        out = out + float(b) * (F.col(c) - float((means or {}).get(c, 0.0)))
    return out


def contributions(fit: CoxFit, means: dict[str, float], source_of: dict[str, str] | None = None) -> Column:
    """Array of struct(feature, contribution) per source feature, coefficient times distance from the training mean."""
    groups: dict[str, Column] = {}
    for c, b in zip(fit.columns, fit.beta, strict=True):
        name = (source_of or {}).get(c, c)
        groups[name] = groups.get(name, F.lit(0.0)) + float(b) * (F.col(c) - float(means.get(c, 0.0)))
    return F.array(*(F.struct(F.lit(n).alias("feature"), v.alias("contribution")) for n, v in groups.items()))


def top_drivers(rows: DataFrame, each: Column, k: int = 5) -> DataFrame:
    """The k largest contributions of every row, by magnitude, with their sign."""
    ordered = F.sort_array(F.transform(each, lambda x: F.struct(F.abs(x["contribution"]).alias("m"), x["feature"].alias("feature"), x["contribution"].alias("contribution"))), asc=False)
    return rows.select("row_id", F.posexplode(F.slice(ordered, 1, k)).alias("rank", "d")).select("row_id", (F.col("rank") + 1).alias("rank"), "d.feature", "d.contribution", F.when(F.col("d.contribution") >= 0, "raises").otherwise("lowers").alias("direction"))


@dataclass
class CauseModel:
    status: str
    reason: str
    fit: CoxFit | None = None
    baseline: DataFrame | None = None
    strata: dict[str, tuple[int, bool]] = field(default_factory=dict)


@dataclass
class CauseSpecificCox:
    """Three causes, stratified baselines, and a gate in unique event patients for every cause and stratum."""

    columns: list[str]
    stratum: str = "route"
    penalizer: float = 0.05
    gates: dict = field(default_factory=lambda: dict(GATES))
    causes: dict[str, int] = field(default_factory=lambda: {"svd": 1, "death": 2, "replacement": 3})
    models: dict[str, CauseModel] = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)
    means: dict[str, float] = field(default_factory=dict)

    def fit(self, rows: DataFrame, patient: str = "patient_id") -> CauseSpecificCox:
        rows = stage(rows.select(*dict.fromkeys([patient, self.stratum, "time", "event", *self.columns])), "training")  # what the fit reads
        moments = rows.agg(*(F.stddev_pop(c).alias(f"sd_{c}") for c in self.columns), *(F.avg(c).alias(f"m_{c}") for c in self.columns)).first() if self.columns else None
        used = [c for c in self.columns if (moments[f"sd_{c}"] or 0) > 1e-9]
        self.dropped = [c for c in self.columns if c not in used]
        self.means = {c: float(moments[f"m_{c}"]) for c in used}
        counts = rows.groupBy(self.stratum).agg(*(F.countDistinct(F.when(F.col("event") == code, F.col(patient))).alias(name) for name, code in self.causes.items())).collect()
        total = rows.agg(*(F.countDistinct(F.when(F.col("event") == code, F.col(patient))).alias(name) for name, code in self.causes.items())).first()
        fitted = [name for name in self.causes if total[name] >= self.gates["fit_min_unique_events"]]
        fits = dict(zip(fitted, fit_cox_causes(rows, used, [F.col("event") == self.causes[n] for n in fitted], strata=F.col(self.stratum), penalizer=self.penalizer), strict=True)) if fitted else {}
        for name, code in self.causes.items():
            n = total[name]
            if name in fits:
                fit = fits[name]
                scored = rows.withColumn("__risk", F.exp(linear_predictor(fit, self.means)))
                model = CauseModel("ok", "", fit, nelson_aalen(scored, [self.stratum], "__risk", code))
            elif n >= self.gates["baseline_min_unique_events"]:
                model = CauseModel("reduced_baseline_only", f"{n} event patients: baseline only", None, nelson_aalen(rows, [self.stratum], None, code))
            else:
                model = CauseModel("insufficient_events", f"{n} event patients")
            usable = model.status in ("ok", "reduced_baseline_only")
            model.strata = {r[self.stratum]: (r[name], usable and r[name] >= self.gates["baseline_min_unique_events"]) for r in counts}
            if model.baseline is not None:
                model.baseline = stage(model.baseline, "baseline")
            self.models[name] = model
        return self

    def support(self, rows: DataFrame) -> Column:
        """Empty when a row can be scored, else why not."""
        known = sorted({s for m in self.models.values() for s in m.strata})
        out = F.when(~F.coalesce(F.col(self.stratum).isin(*known), F.lit(False)), "unknown_device_or_route")
        for name, m in self.models.items():
            for s, (_, ok) in m.strata.items():
                if not ok:
                    out = out.when(F.col(self.stratum) == s, f"insufficient_events:{name}")
        return out.otherwise("")

    def hazards(self, rows: DataFrame, grid: Sequence[float]) -> DataFrame:
        """Adds one array per cause, the cumulative hazard on the grid, and ``support``; unsupported rows get NULL, never 0."""
        out = rows.withColumn("support", self.support(rows))
        for name, m in self.models.items():
            if m.baseline is None:
                out = out.withColumn(name, F.lit(None).cast("array<double>"))
                continue
            base = baseline_on_grid(m.baseline, [self.stratum], grid).select(F.col(self.stratum).alias("__s"), F.col("h").alias("__h"))
            risk = F.exp(linear_predictor(m.fit, self.means)) if m.fit else F.lit(1.0)
            out = out.join(base, F.col(self.stratum) == F.col("__s"), "left").withColumn(name, F.when(F.col("support") == "", F.transform("__h", lambda h: h * risk))).drop("__s", "__h")  # noqa: B023
        return out


def fit_folds(folded: DataFrame, folds: int, columns: Sequence[str], causes: dict[str, int], stratum: str = "route", gates: dict | None = None, penalizer: float = 0.05, patient: str = "patient_id") -> list[CauseSpecificCox]:
    """The models of :class:`CauseSpecificCox` for every fold, each from the rows of the other folds; ``folded`` has a column
    ``fold``, one per patient. All folds take their moments and counts from the same passes, and their Newton steps together: a
    fold counts as a replicate that draws the other folds' patients once. Standard errors are not computed (NaN)."""
    from timberline.operators.replicates import fit_replicates

    gates = dict(gates or GATES)
    make = lambda: CauseSpecificCox(list(columns), stratum, penalizer, gates, dict(causes))
    inside = lambda k, c: F.when(F.col("fold") != k, F.col(c))
    moments = folded.agg(F.lit(0).alias("none"), *(f(inside(k, c)).alias(f"{n}{k}_{c}") for k in range(folds) for c in columns for n, f in (("sd", F.stddev_pop), ("m", F.avg)))).first()
    flags = {name: F.max((F.col("event") == code).cast("long")) for name, code in causes.items()}
    patients = stage(folded.groupBy(patient, stratum).agg(F.min("fold").alias("fold"), *(x.alias(n) for n, x in flags.items())), "patients")
    sums = [F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in causes]
    counts = patients.groupBy("fold", stratum).agg(*sums).collect()
    totals = patients.groupBy(patient).agg(F.min("fold").alias("fold"), *(F.max(n).alias(n) for n in causes)).groupBy("fold").agg(*sums).collect()
    used = [[c for c in columns if (moments[f"sd{k}_{c}"] or 0) > 1e-9] for k in range(folds)]
    total = [{n: sum(r[n] for r in totals if r["fold"] != k) for n in causes} for k in range(folds)]
    fitted = [[n for n in causes if total[k][n] >= gates["fit_min_unique_events"]] for k in range(folds)]
    if any(used[k] != used[0] or fitted[k] != fitted[0] for k in range(folds)) or not used[0]:
        return [make().fit(folded.filter(F.col("fold") != k), patient) for k in range(folds)]
    drawn = folded.withColumn("reps", F.array_compact(F.array(*(F.when(F.col("fold") != k, F.lit(k + 1)) for k in range(folds)))))
    models = [make() for _ in range(folds)]
    for k, model in enumerate(models):
        model.dropped = [c for c in columns if c not in used[k]]
        model.means = {c: float(moments[f"m{k}_{c}"]) for c in used[k]}
    others = folded.withColumn("__k", F.explode(F.array_compact(F.array(*(F.when(F.col("fold") != k, F.lit(k)) for k in range(folds))))))
    for name, code in causes.items():
        fits: list[CoxFit | None] = [None] * folds
        if name in fitted[0]:
            beta, converged = fit_replicates(drawn, used[0], F.col("event") == code, folds, F.col(stratum), penalizer=penalizer, max_iter=50, tol=1e-8, least_events=1)
            nan = np.full(len(used[0]), np.nan)
            fits = [CoxFit(list(used[k]), beta[k + 1], nan, float("nan"), float("nan"), bool(converged[k + 1]), 0, total[k][name]) for k in range(folds)]
        usable = [f is not None or total[k][name] >= gates["baseline_min_unique_events"] for k, f in enumerate(fits)]
        baseline = None
        if any(usable):
            risk = F.lit(1.0)
            for k, f in enumerate(fits):
                risk = risk if f is None else F.when(F.col("__k") == k, F.exp(linear_predictor(f, models[k].means))).otherwise(risk)
            baseline = stage(nelson_aalen(others.withColumn("__risk", risk), ["__k", stratum], "__risk", code), "baseline")
        for k, model in enumerate(models):
            n = total[k][name]
            status = ("ok", "") if fits[k] else ("reduced_baseline_only", f"{n} event patients: baseline only") if usable[k] else ("insufficient_events", f"{n} event patients")
            own = CauseModel(*status, fits[k], baseline.filter(F.col("__k") == k).drop("__k") if usable[k] else None)
            strata = {r[stratum] for r in counts if r["fold"] != k}
            seen = {s: sum(r[name] for r in counts if r["fold"] != k and r[stratum] == s) for s in strata}
            own.strata = {s: (m, usable[k] and m >= gates["baseline_min_unique_events"]) for s, m in seen.items()}
            model.models[name] = own
    return models
