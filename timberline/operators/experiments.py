"""Pairing, onset allocation, study views, scoring as of a time, and experiment loops over folds and steps."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions import rules
from timberline.operators import adjudicate as adj
from timberline.operators import asof, cif, cox, landmark, metrics, resample, survival
from timberline.operators.staging import quantile_table, stage
from timberline.schema import years_between


class PairingError(ValueError):
    """Tables that cannot be paired one to one."""


def pair_tables(tables: Mapping[str, DataFrame], keys: Sequence[str], shared: Sequence[str] = ()) -> DataFrame:
    """Inner join on keys that must be present and unique; outcome columns held by several tables must agree and are kept once."""
    for name, df in tables.items():
        if lost := [k for k in keys if k not in df.columns]:
            raise PairingError(f"{name} lacks {lost}")
        if df.groupBy(*keys).count().filter("count > 1").limit(1).count():
            raise PairingError(f"{name} has duplicate keys")
    names = list(tables)
    out = tables[names[0]]
    for name in names[1:]:
        common = [c for c in tables[name].columns if c in out.columns and c not in keys]
        right = tables[name].select(*keys, *(F.col(c).alias(f"__{c}") if c in common else F.col(c) for c in tables[name].columns if c not in keys))
        out = out.join(right, list(keys))
        checked = [c for c in common if c in shared]
        if checked:
            clash = F.lit(False)
            for c in checked:
                clash = clash | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
            if out.filter(clash).limit(1).count():
                raise PairingError(f"{name} disagrees on {checked}")
        out = out.drop(*(f"__{c}" for c in common))
    return out


def common_rows(predictions: Sequence[DataFrame], keys: Sequence[str], status: str = "status") -> DataFrame:
    """Keys every model could evaluate."""
    out = predictions[0].filter(F.col(status) == "").select(*keys)
    for p in predictions[1:]:
        out = out.join(p.filter(F.col(status) == "").select(*keys), list(keys))
    return out


def device_info(rows: DataFrame, devices: DataFrame, model: str = "canonical_model") -> DataFrame:
    """Route, class, generation, treatment and market status of the device (one row per model in ``devices``)."""
    d = devices.groupBy(F.col(model).alias("__m")).agg(*(F.first(c, ignorenulls=True).alias(f"device_{c}") for c in ("route", "design_class", "generation", "tissue_treatment", "market_status") if c in devices.columns))
    out = rows.join(d, F.col(model) == F.col("__m"), "left").drop("__m")
    if "device_route" in out.columns:
        out = out.withColumn("device_route", F.when(F.col("device_route").isin("SAVR", "TAVR"), F.col("device_route")).when(F.col("device_route").isNotNull(), "unknown"))
    if "device_market_status" in out.columns:
        out = out.withColumn("device_market_status", rules.market_status(F.col("device_market_status")))
    return out


def onset_intervals(records: DataFrame, staged: DataFrame, patient: str = "patient_id") -> DataFrame:
    """(latest adequate negative study before detection, detection], and whether such a study exists."""
    adequate = F.col("mean_gradient").isNotNull() & (F.col("eoa").isNotNull() | F.col("dvi").isNotNull())
    negative = adequate & ((F.col("date") == F.col("ref_date")) | F.col("staged.stage").isin("0", "1"))
    hi = records.filter("svd_adjudicated_date is not null").select(patient, F.col("svd_adjudicated_date").alias("interval_hi"))
    lo = staged.join(hi, patient).groupBy(patient, "interval_hi").agg(F.max(F.when(negative & (F.col("date") < F.col("interval_hi")), F.col("date"))).alias("interval_lo"))
    return lo.select(patient, "interval_lo", "interval_hi", F.coalesce(F.col("interval_lo") < F.col("interval_hi"), F.lit(False)).alias("defensible"))


def allocate_onsets(intervals: DataFrame, how: str, seed: int = 0, patient: str = "patient_id") -> DataFrame:
    """An event date inside each defensible interval (left, midpoint, right, uniform by hash); others keep detection."""
    width = F.datediff("interval_hi", "interval_lo")
    offset = {"left": F.lit(1), "midpoint": F.greatest(F.lit(1), F.floor(width / 2).cast("int")), "right": width, "uniform": (F.pmod(F.xxhash64(F.lit(seed), patient), width.cast("long")) + 1).cast("int")}[how]
    return intervals.select(patient, F.when(F.col("defensible"), F.date_add("interval_lo", offset)).otherwise(F.col("interval_hi")).alias("svd_event_date"))


def allocation_violations(allocated: DataFrame, events: DataFrame, patient: str = "patient_id") -> DataFrame:
    """Allocated onsets after death, replacement or the end of follow-up."""
    return allocated.join(events.select(patient, "death_date", "replacement_date", "end_followup_date"), patient).filter(F.col("svd_event_date") > F.least("death_date", "replacement_date", "end_followup_date")).select(patient, "svd_event_date")


def truth_override(events: DataFrame, truth: DataFrame, missed_only: bool = False, patient: str = "patient_id") -> DataFrame:
    """Event dates from an evaluation-only table, for all patients or for those whose crossing was missed."""
    t = truth.filter("missed_crossing") if missed_only else truth
    return events.select(patient).join(t.select(patient, F.col("threshold_crossing_date").alias("svd_event_date")), patient, "inner" if missed_only else "left")


def study_view(events: DataFrame, origin: Column, patient: str = "patient_id") -> DataFrame:
    """Years from an origin to death, replacement, adjudicated endpoint and end of follow-up."""
    return events.select(patient, origin.alias("origin"), *(years_between(F.col(c), origin).alias(n) for c, n in (("death_date", "t_death"), ("replacement_date", "t_replacement"), ("svd_adjudicated_date", "t_svd"), ("end_followup_date", "t_end"))))


def trajectory(studies: DataFrame, requests: DataFrame, patient: str = "patient_id") -> DataFrame:
    """One scoring request per study date up to the request's time, and one at that time."""
    dates = studies.select(F.col(patient).alias("__p"), F.col("date").alias("__d")).distinct()
    past = requests.join(dates, (F.col(patient) == F.col("__p")) & (F.col("__d") <= F.col("prediction_date"))).select(patient, F.col("prediction_date").alias("requested_at"), F.col("__d").alias("prediction_date"))
    return past.union(requests.select(patient, F.col("prediction_date").alias("requested_at"), "prediction_date")).distinct()


def score_status(requests: DataFrame, patients: DataFrame, studies: DataFrame, exposures: DataFrame, mechanism_events: DataFrame, patient: str = "patient_id") -> DataFrame:
    """Status of scoring requests as of their time, from data on or before it only: endpoint_met, no_reference_echo,
    prediction_time_invalid or ok, with the current stage.

    A patient is adjudicated once, as a timeline that holds for every date; a request looks its own date up, and its current
    study is the last of one sort of studies and requests. Tables made for single requests (:func:`what_if`) are adjudicated
    request by request.
    """
    if "only_at" in studies.columns or "only_at" in exposures.columns:
        return _status_by_request(requests, patients, studies, exposures, mechanism_events, patient)
    asked = requests.select(patient, "prediction_date").distinct()
    records, staged = adj.timelines(patients, studies, asof.select_reference(studies, patients, patient=patient), exposures, mechanism_events, patient)
    fields = staged.select(F.struct(F.col("staged.stage").alias("stage"), "date").alias("x")).dtypes[0][1]
    marks = asked.select(F.col(patient).alias("__p"), F.col("prediction_date").alias("__d"), F.lit(1).alias("__kind"), F.lit(None).cast("long").alias("__s"), F.lit(None).cast(fields).alias("__x"))
    seen = staged.select(F.col(patient).alias("__p"), F.col("date").alias("__d"), F.lit(0).alias("__kind"), F.col("seq").cast("long").alias("__s"), F.struct(F.col("staged.stage").alias("stage"), "date").alias("__x"))
    upto = Window.partitionBy("__p").orderBy("__d", "__kind", "__s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    current = seen.unionByName(marks).withColumn("cur", F.last("__x", ignorenulls=True).over(upto)).filter("__kind = 1").select("__p", F.col("__d").alias("__at"), "cur")
    known = records.join(patients.select(patient, "implant_date"), patient)
    out = asked.join(known, patient, "left").join(current, (F.col(patient) == F.col("__p")) & (F.col("prediction_date") == F.col("__at")), "left")
    at = F.col("prediction_date")
    referenced = F.coalesce(F.col("ref_date") <= at, F.lit(False))
    invalid = F.col("implant_date").isNull() | (at < F.col("implant_date"))
    status = F.when(invalid, "prediction_time_invalid").when(~referenced, "no_reference_echo").when(adj.met_as_of(at, F.col("candidates")), "endpoint_met").otherwise("ok")
    cur = F.when(referenced, F.col("cur"))
    return out.select(patient, "prediction_date", status.alias("score_status"), cur["stage"].alias("current_stage"), rules.stale(F.months_between("prediction_date", cur["date"])).alias("stale_echo"))


def _status_by_request(requests: DataFrame, patients: DataFrame, studies: DataFrame, exposures: DataFrame, mechanism_events: DataFrame, patient: str = "patient_id") -> DataFrame:
    """:func:`score_status` with every request's own copy of its patient's data, for data that differ by request."""
    keyed = requests.select(patient, "prediction_date").distinct().withColumn("request_id", F.concat_ws("@", F.col(patient).cast("string"), F.col("prediction_date").cast("string")))
    r = keyed.select("request_id", F.col(patient).alias("__p"), "prediction_date")
    s, e, m = _as_of(studies, r, "date", patient), _as_of(exposures, r, "start_date", patient), _as_of(mechanism_events, r, "date", patient)
    p = patients.join(r, F.col(patient) == F.col("__p")).select("request_id", "implant_date", "prediction_date")
    key = "request_id"
    reference = asof.select_reference(s, p, patient=key)
    # read four times below: staged anew each time, the studies would travel as often; the status needs no phenotype and no reason
    none_yet = F.lit(None).cast("string")
    narrow = F.struct(F.col("staged.stage").alias("stage"), none_yet.alias("reason")).alias("staged")
    staged = stage(adj.staged_studies(s, reference, key).select(key, "date", "seq", "ref_date", none_yet.alias("phenotype"), narrow), "staged")
    none = p.select(key, F.lit(None).cast("date").alias("death_date"), F.lit(None).cast("date").alias("replacement_date"))
    record = adj.endpoint_decision(adj.adjudicate(p, staged, adj.thrombosis_windows(e, staged, key), m, none, key))
    now = staged.groupBy(key).agg(F.max_by(F.struct("staged.stage", "date"), F.struct("date", "seq")).alias("cur"))
    out = keyed.join(record.select(key, "met", "svd_status"), key, "left").join(now, key, "left").join(p.select(key, "implant_date"), key, "left")
    status = F.when(F.col("implant_date").isNull() | (F.col("prediction_date") < F.col("implant_date")), "prediction_time_invalid").when(F.col("svd_status") == "no_reference", "no_reference_echo").when(F.coalesce("met", F.lit(False)), "endpoint_met").otherwise("ok")
    months = F.months_between("prediction_date", "cur.date")
    return out.select(patient, "prediction_date", status.alias("score_status"), F.col("cur.stage").alias("current_stage"), rules.stale(months).alias("stale_echo"))


def request_features(requests: DataFrame, patients: DataFrame, studies: DataFrame, patient: str = "patient_id") -> DataFrame:
    """The landmark columns of each request from its last study on or before its time: the same features as at a landmark,
    with the request's own date for ages and gaps. Requests without a reference study give no row."""
    keyed = requests.select(patient, "prediction_date").distinct()
    key = F.concat_ws("@", F.col(patient).cast("string"), F.col("prediction_date").cast("string"))
    r = keyed.withColumn("request_id", key).withColumnRenamed(patient, "__p")
    own = _as_of(studies, r.select("request_id", "__p", "prediction_date"), "date", patient)
    p = r.join(patients, F.col("__p") == F.col(patient)).drop("__p")
    staged = adj.staged_studies(own, asof.select_reference(own, p, patient="request_id"), "request_id")
    series = landmark.series_features(staged, patient="request_id")
    # one row per request and date; a filter, not an aggregate of whole rows, so that what the model does not read is never computed
    newest = series.withColumn("__newest", F.max("landmark_date").over(Window.partitionBy("request_id"))).filter("landmark_date = __newest").drop("__newest")
    rows = newest.join(p.select("request_id", patient, "prediction_date", *(c for c in patients.columns if c not in (patient, *series.columns))), "request_id")
    since = lambda c: years_between(F.col("prediction_date"), F.col(c))
    return rows.withColumn("time_since_last_echo_years", since("landmark_date")).withColumn("t_lm", since("ref_date")).withColumn("valve_age_years", since("implant_date")).drop("landmark_date")


def score_requests(requests: DataFrame, tables: Mapping[str, DataFrame], model: cox.CauseSpecificCox, features: Mapping[str, Column], grid: Sequence[float], horizons: Sequence[float], patient: str = "patient_id") -> DataFrame:
    """Batch scoring as of each request's time: (patient, prediction_date, horizon, score_status, probabilities).

    ``tables``: patients, studies, exposures, mechanism; only their rows on or before the time are read. ``features`` are the
    model's columns over :func:`request_features`. A request that cannot be scored keeps its status and NULL probabilities:
    endpoint_met, no_reference_echo, prediction_time_invalid, missing_features, or why the model does not support it.
    """
    status = score_status(requests, *(tables[t] for t in ("patients", "studies", "exposures", "mechanism")), patient)
    rows = request_features(requests, tables["patients"], tables["studies"], patient).withColumns(dict(features))
    complete = F.lit(True)
    for c in features:
        complete = complete & F.col(c).isNotNull()
    key = F.concat_ws("@", F.col(patient).cast("string"), F.col("prediction_date").cast("string")).alias("row_id")
    ready = status.filter("score_status = 'ok'").select(patient, "prediction_date").join(rows.withColumn("__complete", complete), [patient, "prediction_date"])
    hazards = stage(model.hazards(ready.select(key, patient, "prediction_date", "__complete", model.stratum, *features), grid), "scored")
    causes = list(model.causes)
    able = hazards.filter("__complete and support = ''").select("row_id", *causes)
    points = cif.at_horizons(cif.combine(able, causes), grid, horizons, causes).withColumnRenamed("row_id", "__id")
    why = hazards.select("row_id", F.when(~F.col("__complete"), "missing_features").when(F.col("support") != "", F.col("support")).alias("__why"))
    asked = status.withColumn("horizon", F.explode(F.array(*(F.lit(float(h)) for h in horizons)))).withColumn("row_id", key)
    out = asked.join(why, "row_id", "left").withColumn("score_status", F.when(F.col("score_status") == "ok", F.coalesce("__why", F.lit("ok"))).otherwise(F.col("score_status"))).drop("__why")
    points = points.withColumnRenamed("horizon", "__h")
    return out.join(points, (F.col("row_id") == F.col("__id")) & (F.col("horizon") == F.col("__h")), "left").select(patient, "prediction_date", "horizon", "score_status", *causes, "alive_intact")


def what_if(requests: DataFrame, tables: Mapping[str, DataFrame], study: Mapping[str, Column] | None = None, days_before: int = 30, exposure: Mapping[str, Column] | None = None, patient: str = "patient_id") -> dict[str, DataFrame]:
    """The tables with a hypothetical study per request, and a hypothetical change of exposure: episodes in use stop at the
    request's time and the new one starts there. Score both sets of tables to see the difference.

    Rows with a date in ``only_at`` are seen by the request of that date alone (:func:`score_status` and
    :func:`request_features` heed it), so that requests of one patient do not see each other's changes.
    """
    out = dict(tables)
    asked = requests.select(patient, "prediction_date").distinct()
    if study:
        extra = asked.select(patient, F.date_sub("prediction_date", days_before).alias("date"), F.lit(1 << 60).cast("long").alias("seq"), F.col("prediction_date").alias("only_at"), *(v.alias(k) for k, v in study.items()))
        out["studies"] = tables["studies"].withColumn("only_at", F.lit(None).cast("date")).unionByName(extra, allowMissingColumns=True)
    if exposure:
        own = tables["exposures"].join(asked.select(F.col(patient).alias("__p"), F.col("prediction_date").alias("only_at")), F.col(patient) == F.col("__p"), "left").drop("__p")
        running = F.coalesce((F.col("start_date") < F.col("only_at")) & (F.col("stop_date").isNull() | (F.col("stop_date") > F.col("only_at"))), F.lit(False))
        stopped = own.withColumn("stop_date", F.when(running, F.col("only_at")).otherwise(F.col("stop_date")))
        new = asked.select(patient, F.col("prediction_date").alias("start_date"), F.lit(1 << 60).cast("long").alias("seq"), F.col("prediction_date").alias("only_at"), *(v.alias(k) for k, v in exposure.items()))
        out["exposures"] = stopped.unionByName(new, allowMissingColumns=True)
    return out


def _as_of(rows: DataFrame, requests: DataFrame, date: str, patient: str) -> DataFrame:
    """The rows each request may see: dated on or before it, and not made for another request. ``requests`` has request_id,
    __p and prediction_date."""
    seen = (F.col(patient) == F.col("__p")) & (F.col(date) <= F.col("prediction_date"))
    if "only_at" in rows.columns:
        seen = seen & (F.col("only_at").isNull() | (F.col("only_at") == F.col("prediction_date")))
    return rows.join(requests, seen).drop(patient, "__p", "prediction_date", "only_at")


def implant_time_risk(model: cox.CauseSpecificCox, patients: DataFrame, grid: Sequence[float], horizon: float, valve_age_years: float = 0.25, key: str = "patient_id") -> DataFrame:
    """(key, risk) at a fixed valve age, as at the reference study; NULL where the model does not support the patient."""
    rows = patients.withColumn("valve_age_years", F.lit(float(valve_age_years)))
    hazards = stage(model.hazards(rows.select(F.col(key).alias("row_id"), model.stratum, *model.columns), grid), "risk")
    causes = list(model.causes)
    at = cif.at_horizons(cif.combine(hazards.filter("support = ''").select("row_id", *causes), causes), grid, [horizon], causes)
    return hazards.select("row_id", "support").join(at.select("row_id", F.col(causes[0]).alias("risk")), "row_id", "left").withColumnRenamed("row_id", key)


def visit_weights(rows: DataFrame, covariates: Sequence[str], patient: str = "patient_id") -> DataFrame:
    """Stabilised inverse visit-intensity weights from an exponential gap model, cut at the training 1st and 99th percentiles."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    d = stage(resample.gap_table(rows).withColumn("log_gap", F.log("gap")).dropna(subset=list(covariates)), "gaps")
    glm = GeneralizedLinearRegression(family="poisson", link="log", labelCol="visit", featuresCol="features", offsetCol="log_gap", predictionCol="expected", regParam=1e-6)
    scored = glm.fit(VectorAssembler(inputCols=list(covariates), outputCol="features").transform(d)).transform(VectorAssembler(inputCols=list(covariates), outputCol="features").transform(d))
    base = d.agg((F.sum("visit") / F.sum("gap")).alias("rate")).first()["rate"]
    raw = scored.withColumn("raw", F.lit(float(base or 0.0)) * F.col("gap") / F.col("expected"))
    lo, hi = quantile_table(raw, {"raw": F.col("raw")}, [0.01, 0.99])["raw"]
    return raw.withColumn("visit_weight", F.greatest(F.least("raw", F.lit(hi)), F.lit(lo))).drop("features", "raw", "expected", "log_gap")


def grouped_sensitivity(rows: DataFrame, replacements: Mapping[str, Mapping[str, Column]], predict) -> DataFrame:
    """Change of a prediction when a group of features takes reference values: (row_id, group, base, changed, delta)."""
    base = predict(rows).select("row_id", F.col("p").alias("base"))
    parts = None
    for name, values in replacements.items():
        changed = predict(rows.withColumns(dict(values))).select("row_id", F.lit(name).alias("feature_group"), F.col("p").alias("changed"))
        parts = changed if parts is None else parts.unionByName(changed)
    return parts.join(base, "row_id").withColumn("delta", F.col("base") - F.col("changed"))


def out_of_fold(rows: DataFrame, columns: Sequence[str], folds: int, horizons: Sequence[float], causes: Mapping[str, int], grid: Sequence[float], seed: int = 0, patient: str = "patient_id", stratum: str = "route", gates: dict | None = None) -> DataFrame:
    """Out-of-fold state probabilities: (row_id, fold, horizon, probabilities, support). One model per fold, all fitted together."""
    needed = dict.fromkeys(["row_id", patient, stratum, "time", "event", *columns])
    folded = stage(rows.select(*needed).join(resample.patient_folds(rows, folds, seed, patient), patient), "folds")
    out = None
    for k, model in enumerate(cox.fit_folds(folded, folds, columns, causes, stratum, gates, patient=patient)):
        held = model.hazards(folded.filter(F.col("fold") == k), grid).filter("support = ''").select("row_id", *causes)
        scored = cif.at_horizons(cif.combine(held, list(causes)), grid, horizons, list(causes)).withColumn("fold", F.lit(k))
        scored = stage(scored, "oof")
        out = scored if out is None else out.unionByName(scored)
    return out


def evaluate_ladder(rows: DataFrame, predictions: Mapping[str, DataFrame], horizons: Sequence[float], cause: int = 1, state: str = "svd", group: str = "route") -> DataFrame:
    """Brier, AUC and coverage per step and horizon on out-of-fold predictions (row_id, horizon, state)."""
    out = None
    for tau in horizons:
        known = survival.with_ipcw(rows, tau, [group], cause).drop("pred")
        for step, p in predictions.items():
            scored = known.join(p.filter(F.col("horizon") == tau).select("row_id", F.col(state).alias("pred")), "row_id")
            m = scored.agg((F.sum(F.col("w") * (F.col("y") - F.col("pred")) ** 2) / F.count("*")).alias("brier"), F.count("*").alias("n_rows"))
            part = m.crossJoin(metrics.auc(scored)).select(F.lit(step).alias("step"), F.lit(float(tau)).alias("horizon"), "brier", "auc", "n_rows")
            out = part if out is None else out.unionByName(part)
    return out


def comparator_ladder(rows: DataFrame, steps: Mapping[str, Sequence[str]], pairs: Sequence[tuple[str, str]], horizon: float, causes: Mapping[str, int], grid: Sequence[float], folds: int = 5, replicates: int = 200, seed: int = 0, stratum: str = "route") -> tuple[DataFrame, DataFrame]:
    """Simple and full predictors scored on the same out-of-fold rows: (comparator, brier, auc, n_rows), and the paired Brier
    differences (challenger, reference, difference, ci_low, ci_high, patients) with patient bootstraps."""
    state = next(iter(causes))
    scored = None
    for name, columns in steps.items():
        own = out_of_fold(rows, columns, folds, [horizon], causes, grid, seed, stratum=stratum).select("row_id", F.col(state).alias(name))
        scored = own if scored is None else scored.join(own, "row_id")
    known = survival.with_ipcw(rows, horizon, [stratum], causes[state])
    known = stage(known.drop(*(set(steps) & set(known.columns))).join(scored, "row_id"), "ladder")
    table, paired = None, None
    for name in steps:
        one = known.agg((F.sum(F.col("w") * (F.col("y") - F.col(name)) ** 2) / F.count("*")).alias("brier"), F.count("*").alias("n_rows")).crossJoin(metrics.auc(known, pred=name)).withColumn("comparator", F.lit(name))
        table = one if table is None else table.unionByName(one)
    for challenger, reference in pairs:
        d = resample.paired_brier_difference(known, challenger, reference, replicates, seed).withColumns({"challenger": F.lit(challenger), "reference": F.lit(reference)})
        paired = d if paired is None else paired.unionByName(d)
    return table, paired


def observation_sensitivity(tables: Mapping[str, DataFrame], steps: Mapping[str, Sequence[str]], horizons: Sequence[float], causes: Mapping[str, int], grid: Sequence[float], folds: int = 5, seed: int = 0, patient: str = "patient_id", gates: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """The ladder on landmark tables that differ in how onset was observed, on the patients common to all and with common folds
    (folds follow patient and seed): (analysis, step, horizon, brier, auc, n_rows), and (analysis, dropped_patients)."""
    ids = {name: stage(t.select(patient).distinct(), "patients") for name, t in tables.items()}
    common = None
    for own in ids.values():
        common = own if common is None else common.join(own, patient)
    common = stage(common, "common")
    results, dropped = None, None
    for name, t in tables.items():
        rows = stage(t.join(common, patient), "analysis")
        predictions = {step: out_of_fold(rows, columns, folds, horizons, causes, grid, seed, patient, gates=gates) for step, columns in steps.items()}
        one = evaluate_ladder(rows, predictions, horizons).withColumn("analysis", F.lit(name))
        lost = ids[name].join(common, patient, "left_anti").agg(F.count("*").alias("dropped_patients")).withColumn("analysis", F.lit(name))
        results, dropped = (one, lost) if results is None else (results.unionByName(one), dropped.unionByName(lost))
    return results, dropped


def _known_at(rows: DataFrame, horizons: Sequence[float], causes: Mapping[str, int]) -> DataFrame:
    """(row_id, horizon, w, y per cause): outcomes of the same rows at each horizon, weighted by one censoring curve."""
    rows = stage(rows.select("row_id", "time", "event"), "able")
    censoring = stage(survival.kaplan_meier(rows, of="c"), "censoring")
    out = None
    for tau in horizons:
        known = survival.with_ipcw(rows, tau, [], next(iter(causes.values())), censoring=censoring)
        y = [((F.col("time") <= tau) & (F.col("event") == code)).cast("double").alias(f"y_{n}") for n, code in causes.items()]
        one = known.select("row_id", F.lit(float(tau)).alias("horizon"), "w", *y)
        out = one if out is None else out.unionByName(one)
    return stage(out, "known")


def nested_tuning(
    rows: DataFrame, columns: Sequence[str], grid: Mapping[str, Sequence], causes: Mapping[str, int], horizons: Sequence[float], folds: int = 3, seed: int = 0, tol: float = 1e-6, patient: str = "patient_id",
    stratum: str = "route", gates: dict | None = None, times: Sequence[float] | None = None, min_instances: int = 20,
) -> tuple[DataFrame, DataFrame]:
    """Inner patient folds for boosted hazards: every (depth, trees, rate) is fitted without a fold and scored on the fold's
    supported rows, by the mean Brier score of the competing-risk probabilities over folds, causes and horizons. Returns the
    simplest setting within ``tol`` of the best, and the scores.

    One fit per (fold, depth, rate) serves all numbers of trees: at each stage the baselines are computed anew. ``times`` is the
    grid on which hazards are combined (default: quarters of a year and the horizons). A grid of one setting is not scored.
    """
    from timberline.operators.boosted import BoostedHazards

    trees = sorted(grid["trees"])
    spark = rows.sparkSession
    schema = "depth int, trees int, rate double, mean_brier double, scored_cells long"
    if len(trees) * len(grid["depth"]) * len(grid["rate"]) == 1:
        table = spark.createDataFrame([(grid["depth"][0], trees[0], float(grid["rate"][0]), None, 0)], schema)
        return table, table
    times = list(times or sorted({0.0, *map(float, horizons), *(k / 4 for k in range(1, int(4 * max(horizons)) + 1))}))
    folded = stage(rows.join(resample.patient_folds(rows, folds, seed, patient), patient), "tuning")
    cells = None
    for k in range(folds):
        train, test = folded.filter(F.col("fold") != k), folded.filter(F.col("fold") == k)
        known = None
        for depth in grid["depth"]:
            for rate in grid["rate"]:
                model = BoostedHazards(list(columns), stratum, trees[-1], depth, rate, min_instances, gates=gates or dict(cox.GATES), causes=dict(causes)).fit(train, patient)
                if known is None:  # support follows from events and strata, not from the setting
                    known = _known_at(test.filter(model.support() == ""), horizons, causes)
                scored = known.join(model.probabilities(test, times, horizons, trees), ["row_id", "horizon"])
                losses = F.array(*(F.sum(F.col("w") * (F.col(f"y_{c}") - F.col(c)) ** 2) / F.count("*") for c in causes))
                one = scored.groupBy("trees", "horizon").agg(losses.alias("losses")).select(F.lit(depth).alias("depth"), "trees", F.lit(float(rate)).alias("rate"), F.explode("losses").alias("brier"))
                one = stage(one, "cells")
                cells = one if cells is None else cells.unionByName(one)
    table = stage(cells.groupBy("depth", "trees", "rate").agg(F.avg("brier").alias("mean_brier"), F.count("*").alias("scored_cells")), "table")
    return simplest_within(table, "mean_brier", ["depth", "trees", "rate"], tol), table


def marker_increment(rows: DataFrame, base: Sequence[str], marker: Callable[[DataFrame], Mapping[str, Column]], measured: Column, horizons: Sequence[float], folds: int = 3, replicates: int = 30, seed: int = 0, cause: int = 1, stratum: str = "route", patient: str = "patient_id") -> DataFrame:
    """What a marker adds on the rows where it is measured, out of fold: per horizon the Brier score of the base model and of the
    base model with the marker's offset model, their difference and its patient-bootstrap interval.

    ``marker`` gives the marker's terms as expressions scaled on the rows it is shown. The base is fitted on all training rows; the terms on the measured ones, over the base predictor as offset.
    """
    from timberline.operators.boost import offset_model

    folded = stage(rows.join(resample.patient_folds(rows, folds, seed, patient), patient), "increment")
    event, strata = F.col("event") == cause, F.col(stratum)
    out = None
    for k in range(folds):
        train, test = folded.filter(F.col("fold") != k), folded.filter((F.col("fold") == k) & measured)
        fit = cox.fit_cox(train, list(base), event, strata=strata)
        columns = dict(marker(train.filter(measured)))
        terms = train.filter(measured).withColumns(columns)
        extra = offset_model(terms, list(columns), cox.linear_predictor(fit), event, strata=strata)
        held = test.withColumns(columns)
        lp = cox.linear_predictor(fit)
        more = lp if extra is None else lp + cox.linear_predictor(extra)
        own = train.withColumn("__r", F.exp(lp))
        base_h = stage(survival.nelson_aalen(own, [stratum], "__r", cause), "base")
        more_h = base_h if extra is None else stage(survival.nelson_aalen(terms.withColumn("__r", F.exp(more)), [stratum], "__r", cause), "more")
        for tau in horizons:
            both = asof.step_lookup(held, F.lit(float(tau)), base_h, [stratum], 0.0, value="cumulative_hazard", out="__b")
            both = asof.step_lookup(both, F.lit(float(tau)), more_h, [stratum], 0.0, value="cumulative_hazard", out="__m")
            one = both.select("row_id", F.lit(float(tau)).alias("horizon"), (1 - F.exp(-F.col("__b") * F.exp(lp))).alias("p_base"), (1 - F.exp(-F.col("__m") * F.exp(more))).alias("p_marker"))
            one = stage(one, "increment")
            out = one if out is None else out.unionByName(one)
    result = None
    for tau in horizons:
        known = survival.with_ipcw(rows.filter(measured), tau, [stratum], cause)
        scored = stage(known.join(out.filter(F.col("horizon") == tau).drop("horizon"), "row_id"), "scored")
        brier = lambda p: (F.sum(F.col("w") * (F.col("y") - F.col(p)) ** 2) / F.count("*"))
        one = scored.agg(F.lit(float(tau)).alias("horizon"), F.count("*").alias("n_rows"), brier("p_base").alias("brier_base"), brier("p_marker").alias("brier_marker"))
        one = one.crossJoin(resample.paired_brier_difference(scored, "p_marker", "p_base", replicates, seed))
        result = one if result is None else result.unionByName(one)
    return result


def mechanism_check(rows: DataFrame, columns: Sequence[str], marker_columns: Sequence[str], exposure: str, on: float = 1.0, off: float = 0.0, cause: int = 1, least: float = 0.05) -> dict:
    """The exposure's log hazard contrast over exposed rows with and without the marker in the model, and the share of it that the
    marker takes up (None where the contrast is too small to divide by)."""
    event = F.col("event") == cause
    at = lambda fit: float(fit.beta[fit.columns.index(exposure)]) * (on - off)
    without = at(cox.fit_cox(rows, list(columns), event))
    joint = at(cox.fit_cox(rows, [*columns, *marker_columns], event))
    return {"without_marker": without, "with_marker": joint, "shrinkage": 1 - joint / without if abs(without) > least else None}


def report_pivot(results: DataFrame, index: Sequence[str], column: str, value: str, levels: Sequence[str]) -> DataFrame:
    return results.groupBy(*index).pivot(column, list(levels)).agg(F.first(value))


def sensitivity_summary(results: DataFrame, keys: Sequence[str], value: str = "brier") -> DataFrame:
    return results.groupBy(*keys).agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n"))


def promotion_decision(differences: DataFrame, margin: float = 0.0) -> DataFrame:
    """Whether a challenger family replaces the incumbent: its mean Brier difference and upper limit lie below the margin."""
    return differences.withColumn("promote", (F.col("difference") < margin) & (F.col("ci_high") < margin))


def simplest_within(results: DataFrame, score: str, complexity: Sequence[str], tol: float = 1e-6) -> DataFrame:
    """The simplest setting whose score is within ``tol`` of the best."""
    best = results.agg(F.min(score).alias("__best"))
    return results.crossJoin(F.broadcast(best)).filter(F.col(score) <= F.col("__best") + tol).orderBy(*complexity).limit(1).drop("__best")


def policy_report(landmarks: Mapping[str, DataFrame], patient: str = "patient_id") -> DataFrame:
    """Patients, rows and event patients per cause, route and label policy."""
    out = None
    for policy, rows in landmarks.items():
        r = rows.groupBy("route").agg(F.countDistinct(patient).alias("patients"), F.count("*").alias("rows"), *(F.countDistinct(F.when(F.col("event") == k, F.col(patient))).alias(f"{n}_patients") for n, k in adj.CAUSES.items())).withColumn("policy", F.lit(policy))
        out = r if out is None else out.unionByName(r)
    return out


def latest_rank(rows: DataFrame, keys: Sequence[str], order: Sequence[str], k: int = 1) -> DataFrame:
    """The last k rows per key."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k).drop("__r")
