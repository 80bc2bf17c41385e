"""Boosting of one cause, offset sub-models, conditional censoring and marker checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.operators import cox, metrics, resample
from timberline.operators import replicates as replicates_
from timberline.operators.boosted import BoostedHazards
from timberline.operators.features import rcs_basis
from timberline.operators.staging import exact_quantiles, stage
from timberline.operators.survival import nelson_aalen


@dataclass
class BoostedCox:
    """Gradient boosting of one cause over all rows; ``staged`` gives the score after the requested numbers of trees."""

    columns: Sequence[str]
    trees: int = 50
    depth: int = 2
    rate: float = 0.1
    min_instances: int = 20

    def fit(self, rows: DataFrame, event: Column, every: int = 10) -> BoostedCox:
        gates = {"fit_min_unique_events": 0, "baseline_min_unique_events": 0}
        self.model = BoostedHazards(self.columns, "__all", self.trees, self.depth, self.rate, self.min_instances, gates=gates, causes={"event": 1})
        self.model.fit(rows.withColumns({"event": F.coalesce(event, F.lit(False)).cast("int"), "__all": F.lit("all"), "__one": F.lit(1)}), "__one")
        return self

    def staged(self, rows: DataFrame, at: Sequence[int] | None = None) -> DataFrame:
        """Adds ``score_<k>`` for every requested number of trees, from one pass over the trees."""
        stages = list(at or [self.trees])
        out = self.model.staged_scores(rows.withColumn("__all", F.lit("all")), stages)
        return out.withColumns({f"score_{k}": F.col("scores")[i][0] for i, k in enumerate(stages)}).drop("scores", "__all")


def log_effect(rows: DataFrame, column: str, event: Column) -> tuple[float, float]:
    """Univariable cause-specific log hazard ratio of a binary column, and its standard error."""
    fit = cox.fit_cox(rows, [column], event, penalizer=0.0)
    return float(fit.beta[0]), float(fit.se[0])


def marker_columns(rows: DataFrame, marker: str, cumulative: str, knots: Sequence[float]) -> dict[str, Column]:
    """Spline main effect of a marker and its product with cumulative exposure, standardised on ``rows``; as expressions, so that
    other rows are scaled alike."""
    basis = {f"{marker}__r{i}": b for i, b in enumerate(rcs_basis(F.col(marker), knots))}
    basis[f"{marker}__x_{cumulative}"] = F.col(marker) * F.col(cumulative)
    r = rows.agg(*(f(c).alias(f"{n}_{k}") for k, c in basis.items() for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return {k: (c - float(r[f"m_{k}"] or 0.0)) / (float(r[f"s_{k}"]) if r[f"s_{k}"] and r[f"s_{k}"] > 1e-9 else 1.0) for k, c in basis.items()}


def marker_terms(rows: DataFrame, marker: str, cumulative: str, knots: Sequence[float]) -> tuple[DataFrame, list[str]]:
    """The marker's terms added to the measured rows, and their names."""
    terms = marker_columns(rows, marker, cumulative, knots)
    return rows.withColumns(terms), list(terms)


def offset_model(rows: DataFrame, columns: Sequence[str], offset: Column, event: Column, least_rows: int = 150, least_events: int = 15, strata: Column | None = None, penalizer: float = 0.05) -> cox.CoxFit | None:
    """Sub-model on measured rows with the base model's predictor as offset; None below the gates."""
    measured = rows.dropna(subset=list(columns))
    n, d = measured.agg(F.count("*"), F.coalesce(F.sum(event.cast("long")), F.lit(0))).first()
    return cox.fit_cox(measured, columns, event, strata=strata, offset=offset, penalizer=penalizer) if n >= least_rows and d >= least_events else None


@dataclass(frozen=True)
class OffsetAdjustment:
    """A marker's log hazard ratio over a base model, centred so that the measured training rows are expected to have the events
    they have under the base model."""

    fit: cox.CoxFit
    terms: Mapping[str, Column]
    measured: Column
    centre: float

    def log_hr(self) -> Column:
        """0 where the marker is not measured."""
        lin = F.lit(-self.centre)
        for c, b in zip(self.fit.columns, self.fit.beta, strict=True):
            lin = lin + float(b) * self.terms[c]
        return F.when(F.coalesce(self.measured, F.lit(False)), lin).otherwise(0.0)

    def adjust(self, rows: DataFrame, cause: str) -> DataFrame:
        """Multiply the cause's cumulative hazards; other causes stay."""
        ratio = F.exp(self.log_hr())
        return rows.withColumn(cause, F.transform(cause, lambda h: h * ratio))


def offset_adjustment(rows: DataFrame, terms: Mapping[str, Column], measured: Column, offset: Column, event: Column, expected: Column | None = None, strata: Column | None = None, least_rows: int = 150, least_events: int = 15, penalizer: float = 0.05) -> OffsetAdjustment | None:
    """Fit a marker's ``terms`` on measured rows over the base predictor ``offset``, and centre it: the log of the mean hazard ratio
    weighted by ``expected``, the base model's cumulative hazard at each row's own time. None below the gates."""
    own = stage(rows.filter(F.coalesce(measured, F.lit(False))).withColumns(dict(terms)), "measured")
    fit = offset_model(own, list(terms), offset, event, least_rows, least_events, strata, penalizer)
    if fit is None:
        return None
    lin = F.exp(cox.linear_predictor(fit))
    e = F.lit(1.0) if expected is None else F.when(~F.isnan(expected) & (expected > 0) & (expected < float("inf")), expected).otherwise(0.0)
    s = own.agg(F.sum(e * lin).alias("a"), F.sum(e).alias("b"), F.avg(lin).alias("m")).first()
    import math

    return OffsetAdjustment(fit, dict(terms), measured, math.log(s["a"] / s["b"]) if s["b"] and s["b"] > 0 else math.log(s["m"]))


def bootstrap_wald(rows: DataFrame, columns: Sequence[str], event: Column, replicates: int, seed: int = 0, strata: Column | None = None, offset: Column | None = None, penalizer: float = 0.05, patient: str = "patient_id", least: int = 20) -> dict:
    """Wald statistic of all ``columns`` with the covariance of patient bootstraps (whole histories drawn together), its p value, and
    standard errors; all replicates take their Newton steps together. None with fewer than ``least`` usable replicates."""
    import numpy as np

    drawn = rows.join(resample.bootstrap_counts(rows, replicates, seed, patient), patient)
    beta, ok = replicates_.fit_replicates(drawn, columns, event, replicates, strata, offset, penalizer)
    draws = beta[1:][ok[1:]]
    if len(draws) < least:
        return {"statistic": None, "p_value": None, "n_ok": len(draws)}
    v = np.atleast_2d(np.cov(draws, rowvar=False))
    statistic = float(beta[0] @ np.linalg.pinv(v) @ beta[0])
    return {"statistic": statistic, "p_value": chi2_tail(statistic, len(beta[0])), "n_ok": len(draws), "se": np.sqrt(np.clip(np.diag(v), 0, None)).tolist(), "beta": beta[0].tolist()}


def chi2_tail(x: float, df: int) -> float:
    """Upper tail of the chi-squared distribution: finite sums for whole degrees of freedom."""
    import math

    h = x / 2
    if df % 2 == 0:
        term, total = 1.0, 1.0
        for k in range(1, df // 2):
            term *= h / k
            total += term
        return math.exp(-h) * total
    term, total = math.sqrt(h) / math.gamma(1.5), 0.0
    for k in range(1, (df - 1) // 2 + 1):
        total += term
        term *= h / (k + 0.5)
    return math.erfc(math.sqrt(h)) + math.exp(-h) * total


def contrast(rows: DataFrame, predict, column: str, on, off, where: Column) -> DataFrame:
    """Mean difference of a linear predictor between two settings of a column, over the rows of ``where``."""
    a = predict(rows.filter(where).withColumn(column, F.lit(on)))
    b = predict(rows.filter(where).withColumn(column, F.lit(off)))
    return a.select("row_id", F.col("lp").alias("on")).join(b.select("row_id", F.col("lp").alias("off")), "row_id").agg(F.avg(F.col("on") - F.col("off")).alias("contrast"), F.count("*").alias("n"))


def conditional_censoring(rows: DataFrame, columns: Sequence[str], tau: float, penalizer: float = 0.05) -> DataFrame:
    """Adds ``g``: the probability to be uncensored just before min(time, tau), from a proportional hazards model of
    censoring."""
    fit = cox.fit_cox(rows, columns, F.col("event") == 0, penalizer=penalizer)
    scored = rows.withColumn("__risk", F.exp(cox.linear_predictor(fit))).withColumn("__censored", (F.col("event") == 0).cast("int")).withColumn("__all", F.lit(1))
    base = nelson_aalen(scored, ["__all"], "__risk", None, "time", "__censored").withColumnRenamed("time", "__time")
    from timberline.operators.asof import step_lookup

    out = step_lookup(scored, F.least("time", F.lit(float(tau))), base, ["__all"], 0.0, strict=True, time="__time", value="cumulative_hazard", out="__h0")
    return out.withColumn("g", F.exp(-F.col("__h0") * F.col("__risk"))).drop("__risk", "__censored", "__all", "__h0")


def formal_calibration(rows: DataFrame, knots: Sequence[float], points: int = 40, pred: str = "pred") -> DataFrame:
    """Calibration curve: logistic regression of the outcome on a restricted cubic spline of the logit prediction, evaluated at
    quantiles of the predictions."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    basis = rcs_basis(metrics.logit(F.col(pred)), knots)
    names = [f"__b{i}" for i in range(len(basis))]
    known = rows.filter("w > 0").withColumns(dict(zip(names, basis, strict=True)))
    assemble = VectorAssembler(inputCols=names, outputCol="features")
    model = GeneralizedLinearRegression(family="binomial", link="logit", labelCol="y", weightCol="w", predictionCol="observed", regParam=1e-8).fit(assemble.transform(known.select("y", "w", *names)))
    quantiles = exact_quantiles(rows, {"pred": F.col(pred)}, [(i + 0.5) / points for i in range(points)]).select(F.explode("q").alias(pred))
    return model.transform(assemble.transform(quantiles.withColumns(dict(zip(names, basis, strict=True))))).select(F.col(pred).alias("predicted"), "observed")


def pair_family_brier(rows: DataFrame, families: Mapping[str, str], incumbent: str, replicates: int = 50, seed: int = 0) -> DataFrame:
    """Brier difference of every family's prediction column to the incumbent's, with patient bootstrap intervals."""
    out = None
    for name, column in families.items():
        if name == incumbent:
            continue
        d = resample.paired_brier_difference(rows, column, families[incumbent], replicates, seed).withColumn("family", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out


def family_differences(known: DataFrame, predictions: Mapping[str, DataFrame], incumbent: str, states: Sequence[str], replicates: int = 200, seed: int = 0, patient: str = "patient_id") -> DataFrame:
    """(family, state, horizon, difference, ci_low, ci_high, valid) of the Brier score against the incumbent family, on the rows that
    every family predicts, with patient-bootstrap limits; state ``mean`` is the mean over states and horizons.

    ``known``: row_id, patient, horizon, w and y_<state>; ``predictions``: row_id, horizon and the states. Losses are summed per
    patient before replicates multiply them.
    """
    joined = known
    for name, p in predictions.items():
        joined = joined.join(p.select("row_id", "horizon", *(F.col(s).alias(f"{name}.{s}") for s in states)), ["row_id", "horizon"])
    loss = lambda family, s: F.col("w") * (F.col(f"y_{s}") - F.col(f"`{family}.{s}`")) ** 2
    each = F.array(*(F.struct(F.lit(f).alias("family"), F.lit(s).alias("state"), (loss(f, s) - loss(incumbent, s)).alias("d")) for f in predictions if f != incumbent for s in states))
    sums = stage(joined.select(patient, "horizon", F.inline(each)).groupBy(patient, "family", "state", "horizon").agg(F.sum("d").alias("d"), F.count("*").alias("n")), "losses")
    drawn = sums.join(resample.bootstrap_lists(sums, replicates, seed, patient), patient).withColumn("rep", F.explode("reps"))
    cells = drawn.groupBy("family", "state", "horizon", "rep").agg((F.sum("d") / F.sum("n")).alias("x"))
    means = cells.groupBy("family", "rep").agg(F.avg("x").alias("x")).select("family", F.lit("mean").alias("state"), F.lit(None).cast("double").alias("horizon"), "rep", "x")
    out = replicates_.replicate_intervals(cells.unionByName(means), "x", ["family", "state", "horizon"])
    return out.select("family", "state", "horizon", F.col("value").alias("difference"), F.col("low").alias("ci_low"), F.col("high").alias("ci_high"), "valid")


def annual_rate_targets(rates: DataFrame) -> DataFrame:
    """Published rates as proposed evidence targets with a slugged id."""
    slug = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "_")
    kind = F.when(F.col("horizon_years").isNotNull(), "cumulative_incidence").otherwise("proportion")
    return rates.select(F.concat_ws(":", F.lit("published"), slug(F.col("study")), slug(F.col("outcome")), F.col("horizon_years").cast("string")).alias("target_id"), kind.alias("kind"), slug(F.col("outcome")).alias("variable"), (F.col("percent") / 100).alias("estimate"), "horizon_years", "sample_size", F.lit("proposed").alias("review_status"), F.lit("sensitivity").alias("role"))
