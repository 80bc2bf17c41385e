"""Endpoint adjudication of study series, label policies and outcomes, as joins, windows and grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions import rules
from timberline.operators.asof import DAY
from timberline.operators.staging import stage as write_out
from timberline.schema import DAYS_PER_YEAR

MECHANISM_DAYS = 90
TERMINAL_DAYS = 455
CAUSES = {"svd": 1, "death": 2, "replacement": 3}
LABEL_POLICIES = ("primary", "sens_uncertain_positive", "sens_uncertain_negative", "legacy_single_study")


def staged_studies(studies: DataFrame, reference: DataFrame, patient: str = "patient_id") -> DataFrame:
    """Every study of patients with a reference, with ``staged`` (the stage against it) and the ``ref_*`` columns."""
    joined = studies.join(reference, patient)
    s = rules.stage(F.col, rules.prefixed("ref_"))
    return joined.withColumn("staged", s).withColumn("phenotype", rules.phenotype(F.col("staged")))


def candidate_flags(staged: DataFrame) -> DataFrame:
    """Studies after the reference that reach stage 2 or 3."""
    return staged.filter((F.col("date") > F.col("ref_date")) & F.col("staged.stage").isin("2", "3"))


def thrombosis_windows(exposures: DataFrame, staged: DataFrame, patient: str = "patient_id") -> DataFrame:
    """Suspected-thrombosis episodes followed by a study at stage 0 or 1: [start - 90 days, stop or start + 365 days]."""
    episodes = exposures.filter(F.col("indication") == "suspected_valve_thrombosis").select(F.col(patient).alias("__p"), "start_date", "stop_date").distinct()
    calm = staged.filter(F.col("staged.stage").isin("0", "1")).select(patient, "date")
    resolved = episodes.join(calm, (F.col("__p") == F.col(patient)) & (F.col("date") >= F.col("start_date")), "left_semi")
    return resolved.select(F.col("__p").alias(patient), F.date_sub("start_date", MECHANISM_DAYS).alias("win_start"), F.coalesce("stop_date", F.date_add("start_date", 365)).alias("win_end"))


def adjudicate(patients: DataFrame, staged: DataFrame, windows: DataFrame, mechanism_events: DataFrame, terminal: DataFrame, patient: str = "patient_id", seq: str = "seq", confirmation_required: bool = True, terminal_confirms: bool = True) -> DataFrame:
    """One record per patient: svd_status, candidate, confirmation and adjudicated dates, mechanism, confidence, stage,
    phenotype, and the dates of candidates set aside before the one that decides.

    ``mechanism_events``: patient, type (endocarditis, thrombosis), date. ``terminal``: patient, death_date, replacement_date.
    """
    after = staged.filter(F.col("date") > F.col("ref_date"))
    stage = F.col("staged.stage")
    ahead = Window.partitionBy(patient).orderBy(F.desc("day")).rangeBetween(Window.unboundedPreceding, -1)  # backwards, so a running minimum
    next_ = F.min(F.when(stage.isin("0", "1", "2", "3"), F.struct("day", F.col(seq).alias("s"), "date", stage.alias("stage")))).over(ahead)
    c = after.withColumn("day", DAY(F.col("date"))).withColumn("next", next_).filter(stage.isin("2", "3"))
    c = c.select(patient, "date", F.col(seq).alias("seq"), stage.alias("stage"), "phenotype", "next", F.col("staged.reason").alias("reason"))
    c = write_out(c, "candidates")  # few of the studies, read three times below
    w = windows.select(F.col(patient).alias("__p"), "win_start", "win_end")
    keys = [patient, "seq"]
    in_window = c.join(w, (F.col(patient) == F.col("__p")) & F.col("date").between(F.col("win_start"), F.col("win_end")), "left_semi").select(*keys).distinct().withColumn("in_window", F.lit(True))
    m = mechanism_events.select(F.col(patient).alias("__p"), F.col("type"), F.col("date").alias("__d"))
    near = (
        c.join(m, (F.col(patient) == F.col("__p")) & (F.abs(F.datediff("date", "__d")) <= MECHANISM_DAYS))
        .groupBy(*keys)
        .agg(F.bool_or(F.col("type") == "endocarditis").alias("endocarditis"), F.bool_or(F.col("type") == "thrombosis").alias("thrombosis"))
    )
    c = c.join(in_window, keys, "left").join(near, keys, "left").join(terminal.select(patient, "death_date", "replacement_date"), patient, "left")
    no = F.lit(False)
    thrombotic = F.coalesce("in_window", no)
    transient = ~thrombotic & F.coalesce(F.col("next.stage").isin("0", "1"), no)
    end = F.least(F.when(F.col("death_date") > F.col("date"), F.col("death_date")), F.when(F.col("replacement_date") > F.col("date"), F.col("replacement_date")))
    by_end = F.lit(terminal_confirms) & F.coalesce(F.datediff(end, "date") <= TERMINAL_DAYS, no)
    confirmed = F.col("next").isNotNull()
    unconfirmed = "unconfirmed_pending" if confirmation_required else "confirmed"
    mechanism = F.when(F.coalesce("endocarditis", no), "endocarditis").when(F.coalesce("thrombosis", no), "uncertain").otherwise("svd")
    c = c.select(
        patient, "date", "seq", "stage", "phenotype", "reason", thrombotic.alias("thrombotic"), transient.alias("transient"), mechanism.alias("mechanism"),
        F.when(confirmed, "confirmed").when(by_end, "confirmed_by_terminal_event").otherwise(unconfirmed).alias("status"),
        F.when(confirmed, F.col("next.date")).when(by_end, end).alias("confirmation"),
        F.when(confirmed | by_end, "high").otherwise("moderate").alias("certainty"),
    )
    survivor = ~F.col("thrombotic") & ~F.col("transient")
    at = F.struct("date", "seq")
    ordered = Window.partitionBy(patient).orderBy("date", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = c.withColumn("decided", F.max(survivor.cast("int")).over(ordered))  # from the deciding candidate on
    early = F.col("decided") == 0
    record = c.groupBy(patient).agg(
        F.min_by(F.when(survivor, F.struct("date", "seq", "stage", "phenotype", "reason", "mechanism", "status", "confirmation", "certainty")), F.when(survivor, at)).alias("r"),
        F.array_sort(F.collect_list(F.when(early & F.col("transient"), F.col("date")))).alias("uncertain_dates"),
        F.array_sort(F.collect_list(F.when(early & F.col("thrombotic"), F.col("date")))).alias("thrombosis_dates"),
    )
    referenced = staged.select(patient).distinct().withColumn("has_reference", F.lit(True))
    out = patients.select(patient).join(referenced, patient, "left").join(record, patient, "left")
    uncertain = F.coalesce("uncertain_dates", F.array().cast("array<date>"))
    r = lambda n: F.col(f"r.{n}")
    status = F.when(F.col("has_reference").isNull(), "no_reference").when(F.col("uncertain_dates").isNull(), "no_candidate").when(F.col("r").isNotNull(), r("status")).when(F.size("uncertain_dates") > 0, "uncertain_transient").otherwise("thrombosis_attributed")
    adjudicated = F.when((r("mechanism") == "svd") & r("status").startswith("confirmed"), r("date"))
    return out.select(
        patient,
        status.alias("svd_status"),
        r("date").alias("svd_candidate_date"),
        r("confirmation").alias("svd_confirmation_date"),
        adjudicated.alias("svd_adjudicated_date"),
        F.coalesce(r("mechanism"), F.lit("uncertain")).alias("svd_mechanism"),
        F.when(r("mechanism") == "svd", r("certainty")).otherwise("low").alias("svd_confidence"),
        r("stage").alias("svd_stage"),
        r("phenotype").alias("svd_phenotype"),
        r("reason").alias("svd_reason"),
        uncertain.alias("svd_uncertain_dates"),
        F.coalesce("thrombosis_dates", F.array().cast("array<date>")).alias("svd_thrombosis_attributed_dates"),
        F.least(F.array_min(uncertain), F.when(adjudicated.isNull(), r("date"))).alias("svd_first_unresolved_date"),
    )


def timelines(patients: DataFrame, studies: DataFrame, reference: DataFrame, exposures: DataFrame, mechanism_events: DataFrame, patient: str = "patient_id", seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Adjudication as of every date at once: ``(records, staged)``. A record per patient has ``ref_date`` and its candidates in
    order, each with the dates from which on what is known changes it: ``gone`` (a thrombosis window that holds it is resolved,
    or the next determinable study is back at stage 0 or 1), ``endocarditis`` and ``thrombosis`` (an event within 90 days).

    As of a date, a candidate counts from its own date until it is gone, the first that counts decides, and its mechanism is what
    has happened by then; so any number of dates takes one adjudication of the patient's studies.
    """
    staged = write_out(staged_studies(studies, reference, patient), "staged")
    stage = F.col("staged.stage")
    ahead = Window.partitionBy(patient).orderBy(F.desc("day")).rangeBetween(Window.unboundedPreceding, -1)  # backwards, so a running minimum
    next_ = F.min(F.when(stage.isin("0", "1", "2", "3"), F.struct("day", F.col(seq).alias("s"), "date", stage.alias("stage")))).over(ahead)
    c = staged.filter(F.col("date") > F.col("ref_date")).withColumn("day", DAY(F.col("date"))).withColumn("next", next_).filter(stage.isin("2", "3"))
    c = write_out(c.select(patient, "date", F.col(seq).alias("seq"), F.when(F.col("next.stage").isin("0", "1"), F.col("next.date")).alias("back")), "candidates")
    episodes = exposures.filter(F.col("indication") == "suspected_valve_thrombosis").select(F.col(patient).alias("__p"), "start_date", "stop_date").distinct()
    calm = staged.filter(stage.isin("0", "1")).select(patient, F.col("date").alias("calm"))
    resolved = episodes.join(calm, (F.col("__p") == F.col(patient)) & (F.col("calm") >= F.col("start_date"))).groupBy("__p", "start_date", "stop_date").agg(F.min("calm").alias("calm"))
    inside = F.col("date").between(F.date_sub("start_date", MECHANISM_DAYS), F.coalesce("stop_date", F.date_add("start_date", 365)))
    keys = [patient, "seq"]
    windowed = c.join(resolved, (F.col(patient) == F.col("__p")) & inside).groupBy(*keys).agg(F.min("calm").alias("window"))
    m = mechanism_events.select(F.col(patient).alias("__p"), F.col("type"), F.col("date").alias("__d"))
    first = lambda kind: F.min(F.when(F.col("type") == kind, F.col("__d"))).alias(kind)
    near = c.join(m, (F.col(patient) == F.col("__p")) & (F.abs(F.datediff("date", "__d")) <= MECHANISM_DAYS)).groupBy(*keys).agg(first("endocarditis"), first("thrombosis"))
    each = c.join(windowed, keys, "left").join(near, keys, "left")
    listed = each.groupBy(patient).agg(F.array_sort(F.collect_list(F.struct("date", "seq", F.least("window", "back").alias("gone"), "endocarditis", "thrombosis"))).alias("candidates"))
    records = patients.select(patient).join(reference.select(patient, "ref_date"), patient, "left").join(listed, patient, "left")
    return records, staged


def met_as_of(date: Column, candidates: Column) -> Column:
    """Whether the endpoint is met as of a date, from a patient's timeline."""
    known = F.coalesce(candidates, F.array().cast("array<struct<date:date,seq:bigint,gone:date,endocarditis:date,thrombosis:date>>"))
    counts = F.filter(known, lambda c: (c["date"] <= date) & F.coalesce(c["gone"] > date, F.lit(True)))
    first = F.get(counts, 0)
    other = F.coalesce((first["endocarditis"] <= date) | (first["thrombosis"] <= date), first["endocarditis"] <= date, first["thrombosis"] <= date, F.lit(False))
    return first.isNotNull() & ~other


def endpoint_decision(records: DataFrame) -> DataFrame:
    """The decision view: met, its date and confidence."""
    met = F.col("svd_candidate_date").isNotNull() & (F.col("svd_mechanism") == "svd")
    return records.select("*", met.alias("met"), F.when(met, F.col("svd_candidate_date")).alias("endpoint_date"))


def label_dates(policy: str) -> tuple[Column, Column]:
    """(event date, censoring date) of a label policy, from the adjudication columns."""
    adjudicated, unresolved, first = F.col("svd_adjudicated_date"), F.col("svd_first_unresolved_date"), F.col("svd_first_positive_date")
    none = F.lit(None).cast("date")
    if policy == "primary":
        return F.when(unresolved.isNull() | (unresolved >= adjudicated), adjudicated), F.when(adjudicated.isNull() | (unresolved < adjudicated), unresolved)
    if policy == "sens_uncertain_positive":
        return F.least(adjudicated, unresolved), none
    if policy == "sens_uncertain_negative":
        return adjudicated, none
    if policy == "legacy_single_study":
        return first, none
    raise ValueError(f"unknown label policy {policy!r}")


def outcome(landmark: Column, svd: Column, death: Column, replacement: Column, end: Column, horizon: float = 5.0) -> Column:
    """struct(time, event): the earliest cause in (landmark, end], ties by cause code, else censored at the end; cut at
    the horizon; at least 0.001."""
    seen = [F.when((d > landmark) & (d <= end), F.struct(d.alias("d"), F.lit(code).alias("code"))) for d, code in ((svd, 1), (death, 2), (replacement, 3))]
    first = F.array_min(F.array_compact(F.array(*seen)))
    years = F.datediff(F.coalesce(first["d"], end), landmark) / DAYS_PER_YEAR
    return F.struct(F.greatest(F.least(years, F.lit(float(horizon))), F.lit(1e-3)).alias("time"), F.when(years > horizon, 0).otherwise(F.coalesce(first["code"], F.lit(0))).alias("event"))


def secondary_outcome(landmark: Column, event_date: Column, end: Column, horizon: float = 5.0) -> Column:
    seen = (event_date > landmark) & (event_date <= end)
    years = F.datediff(F.when(seen, event_date).otherwise(end), landmark) / DAYS_PER_YEAR
    return F.struct(F.least(F.greatest(years, F.lit(1e-3)), F.lit(float(horizon))).alias("time"), F.when(F.coalesce(seen & (years <= horizon), F.lit(False)), 1).otherwise(0).alias("event"))
