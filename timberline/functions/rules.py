"""Scalar rules as column expressions: grades, staging against a reference, the three-valued comparator, bins and flags.

A study is passed as a function from field name to column, so the same rule reads flat columns, structs or prefixed names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Study = Callable[[str], Column]

#: Regurgitation labels (fixed values).
GRADES = {"none": 0, "trace": 0, "trivial": 0, "mild": 1, "moderate": 2, "severe": 3}
GRADE_LABELS = ("none", "mild", "moderate", "severe")
OAC = ("VKA", "FXa", "DTI")
TOLERANCE = 1e-12


def prefixed(prefix: str) -> Study:
    return lambda name: F.col(f"{prefix}{name}")


def regurgitation_grade(label: Column) -> Column:
    """Ordinal of a label; unknown labels are NULL, never guessed."""
    out = F.lit(None).cast("int")
    for name, grade in GRADES.items():
        out = F.when(F.lower(F.trim(label)) == name, grade).otherwise(out)
    return out


def regurgitation_label(grade: Column) -> Column:
    return F.when((grade >= 0) & (grade <= 3), F.element_at(F.array(*map(F.lit, GRADE_LABELS)), grade.cast("int") + 1))


def _yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def stage(current: Study, reference: Study, has_reference: Column | None = None, fallback: Study | None = None) -> Column:
    """Deterioration stage of a study against its reference: 0, 1, 2, 3 or uncertain, as
    struct(stage, reason, reference_source, confidence, grad_rise, eoa_fall, eoa_fall_pct, dvi_fall, dvi_fall_pct,
    new_moderate, new_severe). A missing reference grade counts as below the current one."""
    own = F.lit(True) if has_reference is None else _yes(has_reference)

    def ref(name: str) -> Column:
        return reference(name) if fallback is None else F.when(own, reference(name)).otherwise(fallback(name))

    g, g0 = current("mean_gradient"), ref("mean_gradient")
    rise = g - g0
    falls = {}
    for name in ("eoa", "dvi"):
        fall = F.when(ref(name) > 0, ref(name) - current(name))
        falls[name] = (fall, 100 * fall / ref(name))
    ar, ar0 = current("ar"), ref("ar")
    new_moderate, new_severe = (_yes(ar >= k) & ~_yes(ar0 >= k) for k in (2, 3))

    def meets(least_rise, least_final, *limits) -> Column:
        parts: list[Column] = []
        for (fall, pct), (absolute, percent) in zip(falls.values(), limits, strict=True):
            parts += [_yes(fall >= absolute), _yes(pct >= percent)]
        any_fall = parts[0]
        for p in parts[1:]:
            any_fall = any_fall | p
        return (rise >= least_rise) & (g >= least_final) & any_fall

    worse = (rise > 0) | _yes(falls["eoa"][0] > 0) | _yes(falls["dvi"][0] > 0) | _yes(ar > ar0)
    unknown = F.lit("uncertain")
    no_reference = ~own if fallback is None else F.lit(False)
    no_gradient = g.isNull() | g0.isNull()
    no_area = (current("eoa").isNull() & current("dvi").isNull()) | (ref("eoa").isNull() & ref("dvi").isNull())
    severe, moderate = meets(20, 30, (0.6, 50), (0.2, 40)), meets(10, 20, (0.3, 25), (0.1, 20))

    def choose(*values) -> Column:
        a, b, c, d, e, f, h, i, j = values
        return F.when(no_reference, a).when(no_gradient, b).when(no_area, c).when(new_severe, d).when(severe, e).when(new_moderate, f).when(moderate, h).when(worse, i).otherwise(j)

    return F.struct(
        choose(unknown, unknown, unknown, F.lit("3"), F.lit("3"), F.lit("2"), F.lit("2"), F.lit("1"), F.lit("0")).alias("stage"),
        choose("no_reference", "gradient_missing", "area_and_index_missing", "new_severe_regurgitation", "gradient_rise_with_area_fall_stage_3", "new_moderate_regurgitation", "gradient_rise_with_area_fall_stage_2", "some_worsening", "no_worsening").alias("reason"),
        F.when(own, "own").when(F.lit(fallback is not None), "population").otherwise("none").alias("reference_source"),
        F.when(own, "high").otherwise("low").alias("confidence"),
        rise.alias("grad_rise"),
        falls["eoa"][0].alias("eoa_fall"),
        falls["eoa"][1].alias("eoa_fall_pct"),
        falls["dvi"][0].alias("dvi_fall"),
        falls["dvi"][1].alias("dvi_fall_pct"),
        new_moderate.alias("new_moderate"),
        new_severe.alias("new_severe"),
    )


def phenotype(staged: Column) -> Column:
    regurgitant = staged["new_moderate"] | staged["new_severe"]
    return (
        F.when(~staged["stage"].isin("2", "3"), "uncertain")
        .when(regurgitant & _yes(staged["grad_rise"] >= 10), "mixed")
        .when(regurgitant, "regurgitant")
        .otherwise("stenotic")
    )


def at_least(value: Column, threshold: float) -> Column:
    """Inclusive comparison that forgives binary representation at the boundary."""
    return (value > threshold) | (F.abs(value - threshold) <= TOLERANCE * F.greatest(F.abs(value), F.lit(abs(threshold)), F.lit(1.0)))


def comparator(current: Study, reference: Study, context: Study) -> Column:
    """Positive, negative or indeterminate haemodynamic change with Kleene logic over gradient, area, index and
    regurgitation, as struct(status, stage, moderate, severe, missing_inputs, reason_codes).

    Studies have mean_gradient, eoa, dvi, ar, date, valve_id; the context has prediction_date, valve_id, ar_confirmed, fresh.
    """

    def number(study: Study, name: str, positive: bool = False) -> Column:
        v = study(name)
        return F.when(~F.isnan(v.cast("double")) & ((v > 0) if positive else (v >= 0)), v)

    values = {n: (number(reference, n, n != "mean_gradient"), number(current, n, n != "mean_gradient")) for n in ("mean_gradient", "eoa", "dvi")}
    g0, g = values["mean_gradient"]
    rise = g - g0

    def fell(name: str, absolute: float, percent: float) -> Column:
        before, now = values[name]
        return at_least(before - now, absolute) | at_least(100 * (before - now) / before, percent)

    stenotic2 = at_least(rise, 10) & at_least(g, 20) & (fell("eoa", 0.3, 25) | fell("dvi", 0.1, 20))
    stenotic3 = at_least(rise, 20) & at_least(g, 30) & (fell("eoa", 0.6, 50) | fell("dvi", 0.2, 40))
    ar0, ar = (F.when((s("ar") >= 0) & (s("ar") <= 3), s("ar")) for s in (reference, current))
    confirmed = _yes(context("ar_confirmed"))
    ar2 = F.when(confirmed, (ar >= 2) & (ar - ar0 >= 1))
    ar2 = F.when(ar0.isNotNull() & ar.isNotNull(), ar2)
    ar3 = F.when(confirmed & ar0.isNotNull() & ar.isNotNull(), (ar >= 3) & ((ar0 == 0) | (ar - ar0 >= 2)))
    moderate, severe = stenotic2 | ar2, stenotic3 | ar3
    other_valve = lambda s: _yes(s("valve_id") != context("valve_id"))
    guards = {
        "index_valve_mismatch": _yes(reference("valve_id") != current("valve_id")) | other_valve(reference) | other_valve(current),
        "current_before_reference": _yes(current("date") < reference("date")),
        "future_current_study": _yes(current("date") > context("prediction_date")),
        "future_reference_study": _yes(reference("date") > context("prediction_date")),
        "stale_current_study": _yes(~context("fresh")),
    }
    invalid = F.lit(False)
    for g_ in guards.values():
        invalid = invalid | g_
    status = F.when(invalid, "indeterminate").when(_yes(severe) | _yes(moderate), "positive").when(_yes(~moderate), "negative").otherwise("indeterminate")
    stage_ = F.when(invalid, None).when(_yes(severe), 3).when(_yes(moderate), 2)
    reasons = {
        **guards,
        "intraprosthetic_ar_provenance_unavailable": ~confirmed,
        "missing_baseline_ar": confirmed & ar0.isNull(),
        "missing_current_ar": confirmed & ar0.isNotNull() & ar.isNull(),
        "selection_not_evaluable": invalid,
        "criteria_not_met": ~invalid & _yes(~moderate) & ~_yes(severe),
        "insufficient_paired_evidence": ~invalid & moderate.isNull() & ~_yes(severe),
        "stage_3_criteria_met": ~invalid & _yes(severe),
        "stage_2_criteria_met": ~invalid & _yes(moderate) & ~_yes(severe),
    }
    missing = {f"{side}_{n}": v for n, pair in (*values.items(), ("ar", (ar0, ar))) for side, v in zip(("reference", "current"), pair, strict=True)}
    return F.struct(
        status.alias("status"),
        stage_.cast("int").alias("stage"),
        moderate.alias("moderate"),
        severe.alias("severe"),
        F.array_compact(F.array(*(F.when(v.isNull(), F.lit(n)) for n, v in missing.items()))).alias("missing_inputs"),
        F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in reasons.items()))).alias("reason_codes"),
    )


def mismatch_grade(indexed_area: Column) -> Column:
    return F.when(indexed_area > 0.85, "none").when(indexed_area > 0.65, "moderate").when(indexed_area.isNotNull(), "severe")


def first_match(text: Column, classes: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The first class, in order, one of whose substrings a text holds."""
    out = F.lit(None).cast("string")
    for name, parts in reversed(classes):
        hit = F.lit(False)
        for part in parts:
            hit = hit | F.contains(F.lower(text), F.lit(part.lower()))
        out = F.when(hit, name).otherwise(out)
    return out


def medication_class(generic: Column, therapeutic: Column, by_name, by_class) -> Column:
    """struct(class, matched_via): the generic name decides, else the therapeutic class."""
    named, classed = first_match(generic, by_name), first_match(therapeutic, by_class)
    return F.struct(F.coalesce(named, classed).alias("class"), F.when(named.isNotNull(), "generic_name").when(classed.isNotNull(), "therapeutic_class").alias("matched_via"))


def era(year: Column) -> Column:
    return F.when(year.between(2006, 2012), "2006-2012").when(year.between(2013, 2017), "2013-2017").when(year.between(2018, 2022), "2018-2022").when(year.isNotNull(), "outside")


def duration_bin(years: Column) -> Column:
    return F.when((years > 0) & (years <= 1), "(0,1]").when((years > 1) & (years <= 3), "(1,3]").when((years > 3) & (years <= 4), "(3,4]").when((years > 4) & (years <= 1000), "(4,1000]")


def suppress(n: Column, least: int = 5) -> Column:
    """Counts from 1 to ``least`` - 1 become the text ``<least``; 0 and NULL stay; already suppressed cells stay."""
    text = n.cast("string")
    number = n.try_cast("long")
    return F.when((number > 0) & (number < least), f"<{least}").otherwise(text)


def interval_months(valve_age: Column, milestones: Sequence[int], yearly_after: float | None = None) -> Column:
    """Months to the next surveillance milestone: (milestone - age) * 12 + 12, at least 1; yearly beyond the last."""
    ahead = F.filter(F.array(*map(F.lit, milestones)), lambda m: m > valve_age)
    months = F.greatest((F.array_min(ahead) - valve_age) * 12 + 12, F.lit(1.0))
    yearly = F.lit(False) if yearly_after is None else valve_age >= yearly_after
    return F.when(yearly | (F.size(ahead) == 0), 12.0).otherwise(months)


def overdue(months_since: Column, interval: Column, grace: float = 3.0) -> Column:
    return months_since > interval + grace


def stale(months_since: Column, most: float = 18.0) -> Column:
    return months_since > most


def market_status(text: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    out = F.lit("unknown")
    for status in ("withdrawn", "discontinued", "active"):
        out = F.when(t.startswith(status), status).otherwise(out)
    return out


def prevalent_early(gradient: Column, first_gradient: Column, grade: Column, first_grade: Column) -> Column:
    """Change already present early; missing values never exclude."""
    return _yes(gradient - first_gradient >= 10) | _yes(grade - first_grade >= 1)


def agreement(status: Column, flagged: Column, model_available: Column) -> Column:
    """How the rule's status and the model's flag go together, in six categories (fixed values)."""
    positive = status == "positive"
    return (
        F.when(~_yes(model_available), "comparison_incomplete_model_unavailable")
        .when(~_yes(status.isin("positive", "negative")), "comparison_incomplete_comparator_unavailable")
        .when(flagged.isNull(), "comparison_incomplete_model_flag_unavailable")
        .when(positive & flagged, "both_flagged")
        .when(positive, "rule_positive_model_not_flagged")
        .when(flagged, "rule_negative_model_flagged")
        .otherwise("neither_flagged")
    )


def guideline_interval(jurisdiction: str, route: Column, valve_age: Column) -> Column:
    """Months between studies: yearly, or for surgical valves under the sparse schedule at 5 and 10 years, then yearly."""
    if jurisdiction == "ESC_EACTS":
        return F.lit(12.0)
    return F.when(route == "TAVR", 12.0).otherwise(interval_months(valve_age, (5, 10), 10))


def months_message(p12: Column, months_since: Column, interval: Column, stage_now: Column, threshold: float = 0.02, grace: float = 3.0) -> Column:
    """Messages of a scored request: current abnormality, earlier assessment, overdue study."""
    return F.array_compact(
        F.array(
            F.when(stage_now.isin("2", "3"), F.lit("current_abnormality")),
            F.when(p12 >= threshold, F.lit("earlier_assessment")),
            F.when(overdue(months_since, interval, grace), F.lit("overdue")),
        )
    )


def marker_status(value: Column, is_stale: Column, in_model: Column) -> Column:
    return F.when(value.isNull(), "not_measured").when(_yes(is_stale), "stale").when(~_yes(in_model), "not_in_model").otherwise("used")


def reliability(evidence_level: Column, inputs: dict[str, Column]) -> Column:
    """struct(level, completeness, missing): the device's evidence and the share of inputs that are present."""
    present = F.lit(0)
    for c in inputs.values():
        present = present + c.isNotNull().cast("int")
    share = present / F.lit(len(inputs))
    level = F.when((evidence_level == "high") & (share >= 0.8), "high").when(share >= 0.5, "moderate").otherwise("low")
    return F.struct(level.alias("level"), share.alias("completeness"), F.array_compact(F.array(*(F.when(c.isNull(), F.lit(n)) for n, c in inputs.items()))).alias("missing"))
