"""Observed-data profiles, evidence tables and data-quality checks."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.operators import resample
from timberline.operators.replicates import replicate_intervals
from timberline.operators.staging import broadcast_if_small, equal_keys, exact_quantiles, salted_lookup, stage
from timberline.schema import DAYS_PER_YEAR

#: Fixed values.
ACCEPTED_ORIGINS = ("observed", "derived")


class SnapshotRejected(ValueError):
    """A snapshot that cannot be used as observed evidence."""


def admitted_records(observations: DataFrame, accepted: Sequence[str] = ACCEPTED_ORIGINS) -> DataFrame:
    """(record_id, admitted, reason): a record is admitted if its origin and every ancestor's are accepted.

    Each record points to its parents, then to their parents' parents, and so on in doubling steps; at each step rejection
    passes along the pointers. So a lineage of depth n takes log n joins. A parent that is not in the table, and a cycle
    (pointers that outlast the number of records), are errors.
    """
    edges = stage(observations.select("record_id", F.explode("parent_record_ids").alias("parent")), "lineage")
    ids = observations.select(F.col("record_id").alias("parent"))
    if edges.join(ids, "parent", "left_anti").limit(1).count():
        raise SnapshotRejected("lineage references records that are not in the snapshot")
    status = observations.select("record_id", F.col("value_origin").isin(*accepted).alias("own"))
    bad = stage(status.filter(~F.coalesce("own", F.lit(False))).select("record_id").distinct(), "bad")
    pointers = edges
    for _ in range(observations.count().bit_length() + 1):
        if not pointers.limit(1).count():
            break
        if pointers.filter(F.col("record_id") == F.col("parent")).limit(1).count():
            raise SnapshotRejected("lineage cycle")
        reached = pointers.join(bad.withColumnRenamed("record_id", "parent"), "parent").select("record_id")
        bad = stage(bad.union(reached).distinct(), "bad")
        further = pointers.select(F.col("record_id").alias("parent"), F.col("parent").alias("next"))
        pointers = stage(pointers.join(further, "parent").select("record_id", F.col("next").alias("parent")).distinct(), "pointers")
    if pointers.limit(1).count():
        raise SnapshotRejected("lineage cycle")
    marked = status.join(bad.withColumn("bad", F.lit(True)), "record_id", "left")
    reason = F.when(~F.coalesce("own", F.lit(False)), "non_observed_origin").when(F.col("bad"), "non_observed_ancestor")
    return marked.select("record_id", F.col("bad").isNull().alias("admitted"), reason.alias("reason"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node each node of the edges ``(a, b)`` is connected to, by alternating large and small stars.

    A large star ties a node's larger neighbours to the least of its neighbourhood, a small star its smaller ones and itself;
    edges only move towards the least node, so their number does not grow, and the rounds are few whatever the length of
    chains. A node that half of all edges share is dealt to many tasks. Ends when no edge moves.
    """
    pairs = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "overlaps")
    nodes = pairs.select(F.col("a").alias("node")).distinct()
    tree = stage(pairs.filter("a > b"), "edges")  # from the larger node to the smaller
    print_of = lambda df: tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first())
    was = print_of(tree)
    while was[0]:
        both = tree.unionAll(tree.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = salted_lookup(both.filter("b > a"), "a", least, F.col("b")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stage(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = salted_lookup(large, "a", low, F.col("b")).filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        tree = stage(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = print_of(tree)
        if now == was:
            break
        was = now
    labels = tree.groupBy("a").agg(F.min("b").alias("label"))
    return nodes.join(labels.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def first_in_window(observations: DataFrame, persons: DataFrame, window: tuple[int, int] = (-30, 180)) -> DataFrame:
    """Per person and variable the first record: inside the window where dates are exact to the day, else cross-sectional."""
    j = stage(observations.join(persons.select("person_id", "index_date", "index_date_precision"), "person_id"), "dated")
    exact = (F.col("date_precision") == "day") & (F.col("index_date_precision") == "day")
    # one row per variable meets the records; a window over a variable would bring all its records to one task
    dated = broadcast_if_small(j.filter(exact).select(F.col("variable").alias("__v")).distinct(), name="exact")
    inside = exact & F.datediff(F.to_date("date"), F.to_date("index_date")).between(*window)
    j = j.join(dated.withColumn("__x", F.lit(True)), F.col("variable").eqNullSafe(F.col("__v")), "left")
    kept = j.withColumn("kind", F.when(F.col("__x"), "baseline").otherwise("cross_sectional")).filter((F.col("kind") == "cross_sectional") | inside)
    order = Window.partitionBy("person_id", "variable").orderBy("date", "record_id")
    return kept.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r", "__v", "__x", "index_date", "index_date_precision")


def usable(observations: DataFrame) -> DataFrame:
    """Without exact and possible duplicates and suppressed cells, which are never turned into numbers."""
    unique = F.coalesce("duplicate_status", F.lit("unique")) == "unique"
    suppressed = F.coalesce("suppressed", F.lit(False)) | F.coalesce(F.trim("value_text").startswith("<"), F.lit(False))
    return observations.filter(unique & ~suppressed)


def exclusion_counts(observations: DataFrame) -> DataFrame:
    status = F.coalesce("duplicate_status", F.lit("unique"))
    suppressed = F.coalesce("suppressed", F.lit(False)) | F.coalesce(F.trim("value_text").startswith("<"), F.lit(False))
    n = lambda c: F.sum(c.cast("long"))
    return observations.agg(n(status == "exact_duplicate").alias("exact_duplicate"), n(status == "possible_duplicate").alias("possible_duplicate"), n(suppressed & (status == "unique")).alias("suppressed_not_converted"))


def baseline_summaries(first: DataFrame, least: int = 30) -> DataFrame:
    """Mean and sample sd per numeric variable, proportions per level of the others, with the support they have."""
    numbers = first.filter(F.col("value").isNotNull()).groupBy("variable", "kind").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    numbers = numbers.select("variable", "kind", "n", F.inline(F.array(*(F.struct(F.lit(s).alias("statistic"), F.col(s).alias("value")) for s in ("mean", "sd")))))
    levels = first.filter(F.col("value").isNull() & F.col("value_text").isNotNull())
    total = Window.partitionBy("variable", "kind")
    shares = levels.groupBy("variable", "kind", "value_text").agg(F.count("*").alias("k")).withColumn("n", F.sum("k").over(total))
    shares = shares.select("variable", "kind", "n", F.concat(F.lit("proportion:"), F.col("value_text")).alias("statistic"), (F.col("k") / F.col("n")).alias("value"))
    support = F.when(F.col("kind") == "cross_sectional", "descriptive_only").when(F.col("n") < least, "descriptive_only").otherwise("fit_local")
    return numbers.unionByName(shares).withColumn("support", support)


def bootstrap_errors(first: DataFrame, replicates: int = 200, seed: int = 0, quantiles: Sequence[float] = ()) -> DataFrame:
    """(variable, kind, statistic, value, se): mean, sd, quantiles and proportions with standard errors over replicates that draw
    persons. Rows meet the list of their person's replicates and unfold inside a task; moments are summed there per variable
    and replicate before anything is sent. Quantiles are exact per replicate (values and their counts are dealt by range)."""
    lists = resample.bootstrap_lists(first, replicates, seed, "person_id")
    drawn = first.join(lists, "person_id").withColumn("rep", F.explode("reps"))
    keys = ["variable", "kind"]
    numbers = drawn.filter(F.col("value").isNotNull())
    moments = numbers.groupBy(*keys, "rep").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    parts = moments.select(*keys, "rep", F.inline(F.array(*(F.struct(F.lit(s).alias("statistic"), F.col(s).alias("x")) for s in ("mean", "sd")))))
    if quantiles:
        q = exact_quantiles(numbers, {"value": F.col("value")}, quantiles, [*keys, "rep"])
        each = F.array(*(F.struct(F.lit(f"quantile:{p:g}").alias("statistic"), F.col("q")[i].alias("x")) for i, p in enumerate(quantiles)))
        parts = parts.unionByName(q.select(*keys, "rep", F.inline(each)))
    levels = drawn.filter(F.col("value").isNull() & F.col("value_text").isNotNull()).groupBy(*keys, "value_text", "rep").agg(F.count("*").alias("k"))
    sizes = levels.groupBy(*keys, "rep").agg(F.sum("k").alias("n"))
    known = levels.filter("rep = 0").select(*keys, "value_text")  # a level may be missing from a replicate: its share is 0 there
    shares = known.join(sizes, keys).join(levels, [*keys, "value_text", "rep"], "left")
    parts = parts.unionByName(shares.select(*keys, "rep", F.concat(F.lit("proportion:"), F.col("value_text")).alias("statistic"), (F.coalesce("k", F.lit(0)) / F.col("n")).alias("x")))
    return _errors(parts, [*keys, "statistic"])


def _errors(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    x = F.when(F.col("rep") > 0, F.col("x"))
    return values.groupBy(*keys).agg(F.max(F.when(F.col("rep") == 0, F.col("x"))).alias("value"), F.stddev_samp(x).alias("se"), F.count(x).alias("valid"))


def correlation_error(first: DataFrame, a: str, b: str, replicates: int = 200, seed: int = 0) -> DataFrame:
    """(n, correlation, se, low, high) of two variables over the persons that have both, with person-bootstrap error and limits."""
    pair = first.filter(F.col("variable").isin(a, b)).groupBy("person_id").agg(F.max(F.when(F.col("variable") == a, F.col("value"))).alias("a"), F.max(F.when(F.col("variable") == b, F.col("value"))).alias("b")).dropna()
    pair = stage(pair, "pairs")
    drawn = pair.join(resample.bootstrap_lists(pair, replicates, seed, "person_id"), "person_id").withColumn("rep", F.explode("reps"))
    values = stage(drawn.groupBy("rep").agg(F.corr("a", "b").alias("x"), F.count("*").alias("n")), "correlations")
    out = _errors(values, []).select(F.col("value").alias("correlation"), "se")
    return values.filter("rep = 0").select("n").crossJoin(F.broadcast(out)).crossJoin(F.broadcast(replicate_intervals(values, "x").select("low", "high")))


def person_slopes(observations: DataFrame, least_span: float = 0.5) -> DataFrame:
    """Mean and standard error of per-person slopes: every person counts once."""
    t = F.datediff(F.to_date("date"), F.lit("1970-01-01").cast("date")) / DAYS_PER_YEAR
    o = observations.filter((F.col("date_precision") == "day") & F.col("value").isNotNull())
    each = o.groupBy("variable", "person_id").agg(F.regr_slope(F.col("value"), t).alias("slope"), (F.max(t) - F.min(t)).alias("span"), F.count("*").alias("k")).filter((F.col("k") >= 2) & (F.col("span") >= least_span))
    return each.groupBy("variable").agg(F.count("*").alias("n_persons"), F.avg("slope").alias("mean_slope"), (F.stddev_samp("slope") / F.sqrt(F.count("*"))).alias("se"))


def annual_means(observations: DataFrame) -> DataFrame:
    """Mean per year over persons, each counted once a year."""
    o = observations.filter((F.col("date_precision") == "year") & F.col("value").isNotNull()).withColumn("year", F.substring("date", 1, 4))
    return o.groupBy("variable", "person_id", "year").agg(F.avg("value").alias("v")).groupBy("variable", "year").agg(F.count("*").alias("n_persons"), F.avg("v").alias("mean"))


def profile_targets(summaries: DataFrame, snapshot_id: str, local: bool = True) -> DataFrame:
    """Profile rows as evidence targets: only supported local summaries may be fitted."""
    fit = F.lit(local) & (F.col("support") == "fit_local")
    kind = F.when(F.col("statistic").startswith("proportion:"), "proportion").otherwise(F.col("statistic"))
    return summaries.select(F.concat_ws(":", F.lit("local"), F.lit(snapshot_id), "variable", "statistic").alias("target_id"), kind.alias("kind"), "variable", "statistic", F.col("value").alias("estimate"), F.col("n").alias("sample_size"), F.when(fit, "fit").otherwise("sensitivity").alias("role"), F.when(fit, "approved").otherwise("proposed").alias("review_status"))


def curve_violations(curves: DataFrame, tol: float = 1e-3) -> DataFrame:
    """(target_id, rule, n) over points in given order: times increase, values are probabilities, curves are monotone within
    the tolerance, intervals hold their estimate. ``kind`` is km_survival or cumulative_incidence; ``seq`` the order."""
    w = Window.partitionBy("target_id").orderBy("seq")
    c = curves.withColumn("__t", F.lag("time").over(w)).withColumn("__e", F.lag("estimate").over(w))
    out = lambda x: (F.col(x) < 0) | (F.col(x) > 1)
    step = F.col("estimate") - F.col("__e")
    rules = {
        "unknown_kind": ~F.col("kind").isin("km_survival", "cumulative_incidence"),
        "times_not_increasing": F.col("time") <= F.col("__t"),
        "negative_time": F.col("time") < 0,
        "estimate_not_probability": out("estimate"),
        "limit_not_probability": F.coalesce(out("lower"), F.lit(False)) | F.coalesce(out("upper"), F.lit(False)),
        "interval_without_estimate": (F.col("lower").isNotNull() & F.col("upper").isNotNull()) & ((F.col("lower") > F.col("estimate") + tol) | (F.col("upper") < F.col("estimate") - tol)),
        "not_monotone": F.when(F.col("kind") == "km_survival", step > tol).when(F.col("kind") == "cumulative_incidence", step < -tol),
    }
    long = c.select("target_id", F.inline(F.array(*(F.struct(F.lit(n).alias("rule"), F.coalesce(r, F.lit(False)).alias("hit")) for n, r in rules.items()))))
    return long.filter("hit").groupBy("target_id", "rule").agg(F.count("*").alias("n"))


def evidence_decisions(targets: DataFrame, units: Mapping[str, str], causes: Sequence[str], max_followup: float, approved: Sequence[str] = ("approved", "reviewed"), invalid: DataFrame | None = None) -> DataFrame:
    """Ordered rules to (role, status) per target, then fit and holdout groups are kept apart.

    Targets: target_id, kind, variable, unit, estimate_text, effect_type, origin, horizon_years, outcome_definition,
    competing_events, standard_error, sample_size, tolerance, role, review_status, study_group_id, overlapping_groups.
    """
    curve = F.col("kind").isin("km_survival", "cumulative_incidence")
    timed = curve | (F.col("kind") == "log_effect")
    known_unit = F.lit(None).cast("string")
    for variable, unit in units.items():
        known_unit = F.when(F.col("variable") == variable, unit).otherwise(known_unit)
    binomial = F.col("kind").isin("proportion", "km_survival", "cumulative_incidence") & (F.coalesce("sample_size", F.lit(0)) > 0)
    cascade = (
        (~F.coalesce(F.col("review_status").isin(*approved), F.lit(False)), "excluded", "unreviewed"),
        (~F.col("kind").isin("proportion", "mean", "sd", "quantile", "correlation", "longitudinal_mean", "log_effect", "km_survival", "cumulative_incidence"), "excluded", "unsupported_kind"),
        (known_unit.isNull(), "excluded", "no_reporting_operator"),
        (F.col("unit").isNotNull() & (F.col("unit") != "") & (known_unit != "") & (F.col("unit") != known_unit), "excluded", "unit_mismatch"),
        (F.trim("estimate_text").startswith("<"), "excluded", "suppressed"),
        ((F.col("kind") == "log_effect") & F.col("effect_type").isNull(), "excluded", "unknown_effect_type"),
        ((F.col("kind") == "log_effect") & (F.col("effect_type") == "subdistribution_log_hr"), "sensitivity", "estimand_mismatch"),
        (timed & ~F.coalesce(F.col("origin").isin("implantation", "reference"), F.lit(False)), "excluded", "time_origin_mismatch"),
        (timed & ~F.col("variable").isin(*causes), "excluded", "endpoint_mismatch"),
        (timed & F.col("outcome_definition").isNotNull() & (F.col("outcome_definition") != F.col("variable")), "sensitivity", "endpoint_mismatch"),
        (timed & (F.coalesce("horizon_years", F.lit(0.0)) > max_followup), "sensitivity", "extrapolation"),
        ((F.col("kind") == "km_survival") & (F.col("variable") != "all_cause_death") & F.coalesce("competing_events", F.lit(True)), "sensitivity", "estimand_mismatch"),
        (F.col("standard_error").isNull() & ~binomial, "sensitivity", "no_uncertainty"),
        (F.col("role").isin("fit", "holdout") & F.col("tolerance").isNull(), "sensitivity", "no_tolerance"),
    )
    role, status = F.when(F.col("role").isin("fit", "holdout", "sensitivity"), F.col("role")).otherwise("excluded"), F.lit("compatible")
    for condition, r, s in reversed(cascade):
        hit = F.coalesce(condition, F.lit(False))
        role, status = F.when(hit, r).otherwise(role), F.when(hit, s).otherwise(status)
    out = targets.withColumn("requested_role", F.col("role")).withColumn("__role", role).withColumn("status", status).withColumn("role", F.col("__role")).drop("__role")
    if invalid is not None:
        bad = invalid.select("target_id").distinct().withColumn("__bad", F.lit(True))
        out = out.join(bad, "target_id", "left").withColumn("role", F.when(F.col("__bad"), "excluded").otherwise(F.col("role"))).withColumn("status", F.when(F.col("__bad"), "invalid_curve").otherwise(F.col("status"))).drop("__bad")
    fitted = out.filter("role = 'fit'").select(F.col("study_group_id").alias("__g")).distinct()
    touches = out.filter("role = 'holdout'").select("target_id", F.explode(F.concat(F.array("study_group_id"), F.coalesce("overlapping_groups", F.array().cast("array<string>")))).alias("__g"))
    overlap = touches.join(fitted, "__g", "left_semi").select("target_id").distinct().withColumn("__o", F.lit(True))
    out = out.join(overlap, "target_id", "left")
    return out.withColumn("status", F.when(F.col("__o"), "fit_holdout_overlap").otherwise(F.col("status"))).withColumn("role", F.when(F.col("__o"), "excluded").otherwise(F.col("role"))).drop("__o")


def study_group_weights(targets: DataFrame, cap: float = 1.0) -> DataFrame:
    """Weight per target: study groups connected by declared overlaps share one cap in proportion to the declared weights."""
    groups = targets.select(F.col("study_group_id").alias("a"), F.explode_outer("overlapping_groups").alias("b"))
    labels = connected(groups.select("a", F.coalesce("b", "a").alias("b")))
    w = F.coalesce("weight", F.lit(1.0))
    j = salted_lookup(targets, "study_group_id", labels.select(F.col("node").alias("study_group_id"), "label"), F.col("target_id"))
    totals = j.groupBy("label").agg(F.sum(w).alias("__total"))
    share = F.when(F.col("__total") > 0, w / F.col("__total") * cap).otherwise(0.0)
    return salted_lookup(j, "label", totals, F.col("target_id")).select("target_id", F.col("label").alias("component"), share.alias("share"))


def expand_curve_targets(targets: DataFrame, curves: DataFrame) -> DataFrame:
    """Curve targets as points that share the target's weight; standard errors from interval widths."""
    n = F.count("*").over(Window.partitionBy("target_id"))
    return targets.select("target_id", "weight").join(curves, "target_id").select("target_id", "time", "estimate", (F.col("weight") / n).alias("weight"), ((F.col("upper") - F.col("lower")) / (2 * 1.959964)).alias("standard_error"))


def target_conflicts(targets: DataFrame) -> DataFrame:
    """Pairs of targets for one quantity from different study groups that differ by more than both tolerances."""
    keys = ("kind", "variable", "statistic", "origin", "horizon_years")
    b = targets.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("target_id").alias("other_id"), F.col("study_group_id").alias("__sg"), F.col("estimate").alias("other_estimate"), F.col("tolerance").alias("__tol"))
    on = (F.col("target_id") < F.col("other_id")) & (F.col("study_group_id") != F.col("__sg"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return targets.join(b, on).filter(F.abs(F.col("estimate") - F.col("other_estimate")) > F.col("tolerance") + F.col("__tol")).select("target_id", "other_id", "estimate", "other_estimate")


def target_check(replicates: DataFrame, targets: DataFrame) -> DataFrame:
    """Mean, Monte Carlo error and residual per target over replicates, and whether it is within tolerance."""
    r = replicates.groupBy("target_id").agg(F.avg("value").alias("mean"), (F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("mc_se"), F.count("value").alias("n"))
    j = targets.join(r, "target_id", "left")
    ok = F.abs(F.col("mean") - F.col("estimate")) <= F.col("tolerance")
    return j.select("target_id", "mandatory", "mean", "mc_se", (F.col("mean") - F.col("estimate")).alias("residual"), F.coalesce(ok, F.lit(False)).alias("within"))


def structural_violations(tables: Mapping[str, DataFrame], required: Mapping[str, Sequence[str]], ranges: Mapping[str, Mapping[str, tuple[float, float]]] | None = None, patient: str = "patient_id") -> DataFrame:
    """(check_name, n): missing columns, duplicate keys, orphans, chronology, ranges, events after the end, reversed episodes."""
    spark = tables["patients"].sparkSession
    parts = []

    def add(name: str, df: DataFrame) -> None:
        parts.append(df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check_name"), "n"))

    missing = [(f"{t}: missing {c}", 1) for t, cols in required.items() for c in cols if c not in tables[t].columns]
    for t in ("patients", "events"):
        if t in tables:
            add(f"{t}: duplicate key", tables[t].groupBy(patient).count().filter("count > 1"))
    ids = tables["patients"].select(patient)
    for t, df in tables.items():
        if t != "patients":
            add(f"{t}: unknown patient", df.join(ids, patient, "left_anti"))
    if "studies" in tables:
        add("studies: before implantation", tables["studies"].join(tables["patients"].select(patient, "implant_date"), patient).filter("date < implant_date"))
    for t, columns in (ranges or {}).items():
        for c, (lo, hi) in columns.items():
            add(f"{t}.{c}: out of range", tables[t].filter((F.col(c) < lo) | (F.col(c) > hi)))
    if "events" in tables:
        for c in ("svd_adjudicated_date", "death_date", "replacement_date"):
            if c in tables["events"].columns:
                add(f"events.{c}: after follow-up", tables["events"].filter(F.col(c) > F.col("end_followup_date")))
    if "exposures" in tables:
        add("exposures: stop before start", tables["exposures"].filter("stop_date < start_date"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.unionByName(spark.createDataFrame(missing, "check_name string, n long")) if missing else out


#: Bits of the finest grid, points that a leaf of it should hold at most, and leaves that a row looks up at once at most.
FINEST_BITS, LEAF_POINTS, DIRECT_LEAVES = 24, 64, 64


def nearest_source(released: DataFrame, source: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Per released row the distance to the nearest source row, each column scaled by the source's sd.

    Source points lie in a grid over up to four columns, fine enough for leaves of few points. Every distinct place of a
    released row is compared with its own leaf, which bounds its distance, and then with the other leaves which that distance
    reaches, mostly none to three. Places whose own leaf is empty, or which reach many leaves, descend (:func:`_descend`).
    So a row meets a handful of leaves, wherever it lies, and never the source. Lookups of a leaf that many places share are
    dealt to many tasks.
    """
    stats = source.agg(*(F.stddev_pop(c).alias(c) for c in columns)).first()
    scale = {c: float(stats[c]) if stats[c] and stats[c] > 1e-9 else 1.0 for c in columns}
    flat = list(columns)[:4]
    points = stage(source.select(*((F.col(c) / scale[c]).alias(c) for c in columns)).dropna().distinct(), "points")
    spans = points.agg(F.count("*").alias("n"), *(x for c in flat for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}")))).first()
    rows = stage(released.select(F.col(key).alias("__key"), *((F.col(c) / scale[c]).alias(c) for c in columns)), "released")
    if not spans["n"]:
        return rows.select(F.col("__key").alias(key), F.lit(None).cast("double").alias("distance"))

    def digit(value: Column, c: str) -> Column:
        """The column's digit in the finest grid; it never falls as the value grows."""
        width = (float(spans[f"hi_{c}"]) - float(spans[f"lo_{c}"])) or 1.0
        at = F.floor((value - float(spans[f"lo_{c}"])) / width * float(1 << FINEST_BITS)).cast("long")
        return F.least(F.greatest(at, F.lit(0).cast("long")), F.lit((1 << FINEST_BITS) - 1).cast("long"))

    digits = {f"__g{i}": digit(F.col(c), c) for i, c in enumerate(flat)}
    located = stage(points.withColumns(digits), "located")
    name = lambda numbers: F.concat_ws(":", *(n.cast("string") for n in numbers))
    cell_at = lambda bits: name([F.shiftright(g, FINEST_BITS - bits) for g in digits])
    # with fewer cells than this, some cell must hold more than a leaf's points
    bits = min(FINEST_BITS, max(1, math.ceil(math.log2(max(1.0, spans["n"] / LEAF_POINTS)) / len(flat))))
    while bits < FINEST_BITS and located.groupBy(cell_at(bits).alias("cell")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] > LEAF_POINTS:
        bits += 1
    leaves = stage(located.groupBy(cell_at(bits).alias("cell")).agg(F.collect_list(F.struct(*columns)).alias("members")), "leaves")

    def measured(asked: DataFrame) -> DataFrame:
        """(columns, d): per place the least squared distance to a member of the leaves in ``cell``."""
        met = salted_lookup(asked.select(*columns, "cell"), "cell", leaves, F.struct(*columns), often=4096)
        each = met.select(*columns, F.explode("members").alias("m"))
        return each.groupBy(*columns).agg(F.min(sum((F.pow(F.col(c) - F.col(f"m.{c}"), F.lit(2.0)) for c in columns), F.lit(0.0))).alias("d"))

    known = F.lit(True)
    for c in columns:
        known = known & F.col(c).isNotNull()
    places = stage(rows.select(*columns).filter(known).distinct().withColumns(digits).withColumn("cell", cell_at(bits)), "places")
    # the own leaf's distance, a little enlarged against rounding, and the leaves that it reaches
    radius = F.sqrt("d") * F.lit(1 + 1e-9) + F.lit(1e-12)
    corner = lambda c, side: F.shiftright(digit(F.col(c) + side * radius, c), FINEST_BITS - bits)
    own = measured(places)
    for i, c in enumerate(flat):
        own = own.withColumn(f"__a{i}", corner(c, F.lit(-1.0))).withColumn(f"__b{i}", corner(c, F.lit(1.0)))
    reached = F.lit(1.0)
    for i in range(len(flat)):
        reached = reached * (F.col(f"__b{i}") - F.col(f"__a{i}") + 1)
    seen = stage(own.withColumn("__reached", reached), "seen")
    more = seen.filter((F.col("__reached") > 1) & (F.col("__reached") <= DIRECT_LEAVES))
    for i in range(len(flat)):
        more = more.withColumn(f"__c{i}", F.explode(F.sequence(f"__a{i}", f"__b{i}")))
    here = name([F.shiftright(digit(F.col(c), c), FINEST_BITS - bits) for c in flat])
    more = more.withColumn("cell", name([F.col(f"__c{i}") for i in range(len(flat))])).filter(F.col("cell") != here)
    near = seen.filter(F.col("__reached") <= DIRECT_LEAVES).select(*columns, "d")
    far = stage(places.join(seen.filter(F.col("__reached") <= DIRECT_LEAVES).select(*(F.col(c).alias(f"__{c}") for c in columns)), equal_keys(columns, [f"__{c}" for c in columns]), "left_anti").select(*columns), "far")
    found = near.unionByName(measured(more))
    if not far.isEmpty():
        last = _descend(far, located, columns, cell_at, bits, max(1, 4 // len(flat)))
        found = found.unionByName(measured(last))
    nearest = found.groupBy(*columns).agg(F.sqrt(F.min("d")).alias("distance")).select(*(F.col(c).alias(f"__{c}") for c in columns), "distance")
    on = F.lit(True)
    for c in columns:
        on = on & (F.col(c) == F.col(f"__{c}"))
    return rows.join(nearest, on).select(F.col("__key").alias(key), "distance")


def _descend(places: DataFrame, located: DataFrame, columns: Sequence[str], cell_at: Callable[[int], Column], leaf_bits: int, step: int) -> DataFrame:
    """(columns, cell): per place the leaves that can hold its nearest point.

    Grids get finer level by level, and a cell knows the box of its points in all columns. A place starts with the coarsest
    cells and keeps those whose box can hold a nearer point than the farthest corner of the best box is away; the children of
    the kept cells are looked up at the next level, down to the leaves.
    """
    box = F.struct(*(x for c in columns for x in (F.min(c).alias(f"a_{c}"), F.max(c).alias(f"b_{c}"))))

    def cells(bits: int, within: int | None) -> DataFrame:
        """(parent, children): the cells of a level by the cell they lie in (one parent for the first level)."""
        parent = F.lit("") if within is None else cell_at(within)
        boxes = located.groupBy(parent.alias("cell"), cell_at(bits).alias("child")).agg(box.alias("box"))
        return boxes.groupBy("cell").agg(F.collect_list(F.struct("child", "box")).alias("children"))  # at most 16

    def reach(b, far: bool):
        """Squared distance from the place to the nearest, or farthest, point of a box."""
        out = F.lit(0.0)
        for c in columns:
            lo, hi = F.col(c) - b[f"a_{c}"], b[f"b_{c}"] - F.col(c)
            out = out + F.pow(F.greatest(F.abs(lo), F.abs(hi)) if far else F.greatest(-lo, -hi, F.lit(0.0)), F.lit(2.0))
        return out

    asked = places.select(*columns, F.array(F.lit("")).alias("kept"))
    within = None
    while within != leaf_bits:
        bits = min(leaf_bits, (within or 0) + step)
        open_ = asked.select(*columns, F.explode("kept").alias("cell"))
        met = salted_lookup(open_, "cell", cells(bits, within), F.struct(*columns))
        each = met.select(*columns, F.transform("children", lambda x: F.struct(x["child"].alias("cell"), reach(x["box"], False).alias("near"), reach(x["box"], True).alias("far"))).alias("found"))
        merged = each.groupBy(*columns).agg(F.flatten(F.collect_list("found")).alias("found"))
        bound = F.array_min(F.transform("found", lambda x: x["far"]))
        asked = stage(merged.select(*columns, F.transform(F.filter("found", lambda x: x["near"] <= bound + 1e-12), lambda x: x["cell"]).alias("kept")), "cells")
        within = bits
    return asked.select(*columns, F.explode("kept").alias("cell"))


def nearest_summary(distances: DataFrame, close: float = 0.1) -> DataFrame:
    """(rows, share_below, percentile_5): how many released rows lie closer than ``close`` to a source row, and the fifth
    percentile of the distances."""
    counts = distances.agg(F.count("*").alias("rows"), F.avg((F.col("distance") < close).cast("double")).alias("share_below"))
    return counts.crossJoin(F.broadcast(exact_quantiles(distances, {"d": F.col("distance")}, [0.05]).select(F.col("q")[0].alias("percentile_5"))))


def rare_combinations(released: DataFrame, source: DataFrame, columns: Sequence[str], least: int = 5) -> DataFrame:
    """Combinations of attributes rarer than ``least`` in the source that the released rows repeat, with their count there."""
    rare = source.groupBy(*columns).agg(F.count("*").alias("n_source")).filter(F.col("n_source") < least)
    mine = released.groupBy(*columns).agg(F.count("*").alias("n_released"))
    return mine.join(rare, list(columns))


STATISTICS = ("proportion", "mean", "sd", "quantile", "correlation")


def report(rows: DataFrame, requests: Sequence[tuple[str, str, dict]]) -> DataFrame:
    """(name, statistic, value, se, n) for reporting requests ``(name, statistic, options)`` over rows, the moments in one pass and
    all quantiles in another. Options: ``column``, and ``q`` (quantile), ``other`` (correlation) or ``condition``
    (proportion). Standard errors are those of large samples; a quantile's is that of a normal median."""
    parts, quantiles = [], []
    for name, statistic, o in requests:
        if statistic not in STATISTICS:
            raise ValueError(f"unknown statistic: {statistic}")
        c = F.col(o["column"]).cast("double") if "column" in o else F.when(o["condition"], 1.0).otherwise(0.0)
        n = F.count(c)
        if statistic == "correlation":
            other = F.col(o["other"]).cast("double")
            n = F.count(F.when(other.isNotNull(), c))
        spread = F.stddev_samp(c)
        value = {"proportion": F.avg(c), "mean": F.avg(c), "sd": spread, "quantile": F.lit(None).cast("double"), "correlation": F.corr(c, other) if statistic == "correlation" else None}[statistic]
        error = {
            "proportion": F.sqrt(F.greatest(F.avg(c) * (1 - F.avg(c)), F.lit(1e-12)) / n), "mean": spread / F.sqrt(n), "sd": spread / F.sqrt(2 * (n - 1)),
            "quantile": spread * 1.2533 / F.sqrt(n), "correlation": (1 - value**2) / F.sqrt(F.greatest(n - 3, F.lit(1))) if statistic == "correlation" else None,
        }[statistic]
        parts.append(F.struct(F.lit(name).alias("name"), F.lit(statistic).alias("statistic"), value.alias("value"), error.alias("se"), n.alias("n")))
        if statistic == "quantile":
            quantiles.append((name, o["column"], o["q"]))
    out = rows.agg(F.array(*parts).alias("x")).select(F.inline("x"))
    if not quantiles:
        return out
    wanted = sorted({q for _, _, q in quantiles})
    found = exact_quantiles(rows, {c: F.col(c) for _, c, _ in quantiles}, wanted).select(F.col("name").alias("__c"), "q")
    asked = rows.sparkSession.createDataFrame([(n, c, wanted.index(q)) for n, c, q in quantiles], "__n string, __c string, __i int")
    named = asked.join(found, "__c").select("__n", F.get("q", F.col("__i")).alias("__v"))
    return out.join(F.broadcast(named), F.col("name") == F.col("__n"), "left").select("name", "statistic", F.coalesce("value", "__v").alias("value"), "se", "n")


def report_series(series: DataFrame, variables: Sequence[str], years: Sequence[int] = (), least_span: float = 0.5) -> DataFrame:
    """(name, statistic, value, se, n) per variable over persons, each counted once: the mean slope a year of those with two or more
    values over at least ``least_span`` years, and the mean in every year asked for. ``series``: person_id, variable, years,
    value."""
    own = series.filter(F.col("variable").isin(*variables) & F.col("value").isNotNull())
    each = own.groupBy("variable", "person_id").agg(F.regr_slope("value", "years").alias("x"), F.count("*").alias("k"), (F.max("years") - F.min("years")).alias("span"))
    slopes = each.filter((F.col("k") >= 2) & (F.col("span") >= least_span)).select("variable", F.lit("slope_per_year").alias("statistic"), "x")
    annual = own.withColumn("year", F.floor("years")).filter(F.col("year").isin(*years) if years else F.lit(False))
    annual = annual.groupBy("variable", "person_id", "year").agg(F.avg("value").alias("x")).select("variable", F.concat(F.lit("annual_mean:"), F.col("year").cast("string")).alias("statistic"), "x")
    out = slopes.unionByName(annual).groupBy(F.col("variable").alias("name"), "statistic")
    return out.agg(F.avg("x").alias("value"), (F.stddev_samp("x") / F.sqrt(F.count("*"))).alias("se"), F.count("*").alias("n"))


def report_times(rows: DataFrame, horizons: Sequence[float], causes: Mapping[str, int], contrast: str | None = None, time: str = "time", event: str = "event") -> DataFrame:
    """(name, statistic, value, se, n): event-free survival and each cause's cumulative incidence at the horizons, with binomial
    errors; with ``contrast`` (a binary column) each cause's log hazard ratio as well."""
    from timberline.operators import boost, survival

    n = rows.count()
    codes = tuple(causes.values())
    at = survival.at_horizons(survival.aalen_johansen(rows, [], codes, time, event), [], horizons, rows.limit(1), codes)
    label = F.regexp_replace(F.col("horizon").cast("string"), r"\.0$", "")
    each = [F.struct(F.lit("all").alias("name"), F.concat(F.lit("km_survival:"), label).alias("statistic"), F.col("survival").alias("value"))]
    each += [F.struct(F.lit(c).alias("name"), F.concat(F.lit("cumulative_incidence:"), label).alias("statistic"), F.col(f"cif{k}").alias("value")) for c, k in causes.items()]
    v = F.col("value")
    out = at.select(F.inline(F.array(*each))).select("name", "statistic", v.alias("value"), F.sqrt(F.greatest(v * (1 - v), F.lit(1e-12)) / n).alias("se"), F.lit(n).cast("long").alias("n"))
    if contrast:
        timed = rows.select(F.greatest(F.col(time), F.lit(1e-6)).alias("time"), F.col(event).alias("event"), F.col(contrast).cast("double").alias(contrast))
        effects = [(c, "log_effect", *boost.log_effect(timed, contrast, F.col("event") == k), n) for c, k in causes.items()]
        out = out.unionByName(rows.sparkSession.createDataFrame(effects, "name string, statistic string, value double, se double, n long"))
    return out
