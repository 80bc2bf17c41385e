"""Medication, laboratory, attendance and support aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions import rules


def year_range(start: Column, *ends: Column, most: int = 30) -> Column:
    """Years of an episode: start to the last given end (the start alone without one), never before it, at most ``most``."""
    last = F.greatest(*ends) if len(ends) > 1 else ends[0]
    return F.sequence(start, F.greatest(start, F.least(F.coalesce(last, start), start + most)))


def exposure_years(records: DataFrame, patient: str = "patient_id") -> DataFrame:
    """Distinct (patient, year, class)."""
    return records.filter(F.col("start_year").isNotNull() & F.col("class").isNotNull()).select(patient, F.explode(year_range(F.col("start_year"), F.col("end_year"), F.col("discontinued_year"))).alias("year"), "class").distinct()


def exposure_grid(years: DataFrame, classes: Sequence[str], patient: str = "patient_id") -> DataFrame:
    """One row per patient and year with 0/1 per class."""
    return years.groupBy(patient, "year").agg(*(F.max((F.col("class") == c).cast("int")).alias(c) for c in classes))


def patients_per_year(years: DataFrame, patient: str = "patient_id") -> DataFrame:
    out = years.groupBy("year", "class").agg(F.countDistinct(patient).alias("n_patients"))
    return out.withColumn("shown", rules.suppress(F.col("n_patients")))


def exposure_duration(years: DataFrame, patient: str = "patient_id") -> DataFrame:
    return years.groupBy(patient, "class").agg(F.countDistinct("year").alias("n_years"), F.min("year").alias("first_year"), F.max("year").alias("last_year")).withColumn("bin", rules.duration_bin(F.col("n_years")))


def duration_distribution(durations: DataFrame) -> DataFrame:
    return durations.groupBy("class", "bin").agg(F.count("*").alias("n_patients")).withColumn("shown", rules.suppress(F.col("n_patients")))


def time_in_range(labs: DataFrame, exposed: DataFrame, low: float = 2.0, high: float = 3.0, patient: str = "patient_id") -> DataFrame:
    """Share of values in range per patient and year, for exposed patients, rounded half to even to one decimal."""
    kept = labs.join(exposed.select(patient).distinct(), patient, "left_semi")
    return kept.groupBy(patient, F.year("date").alias("year")).agg(F.bround(100 * F.avg(F.col("value").between(low, high).cast("double")), 1).alias("pct_in_range"), F.count("value").alias("n_values"))


def lab_availability(labs: DataFrame, patterns: Mapping[str, str], excluded: str | None = None, name: str = "component", patient: str = "patient_id") -> DataFrame:
    """Distinct patients per key laboratory (by pattern) and year, and over all years (year NULL); a row may match several."""
    rows = labs if excluded is None else labs.filter(~F.coalesce(F.col(name).rlike(excluded), F.lit(False)))
    matching = F.array_compact(F.array(*(F.when(F.col(name).rlike(p), F.lit(label)) for label, p in patterns.items())))
    long = rows.select(patient, F.year("date").alias("year"), F.explode(matching).alias("lab"))
    return long.groupBy("lab", "year").agg(F.countDistinct(patient).alias("n_patients")).unionByName(long.groupBy("lab").agg(F.countDistinct(patient).alias("n_patients")).withColumn("year", F.lit(None).cast("int")))


def event_support(rows: DataFrame, by: Sequence[str] = (), causes: Mapping[str, int] | None = None, patient: str = "patient_id") -> DataFrame:
    """Event patients and event rows per cause."""
    named = causes or {"svd": 1, "death": 2, "replacement": 3}
    long = rows.select(*by, patient, F.inline(F.array(*(F.struct(F.lit(n).alias("cause"), (F.col("event") == c).alias("hit")) for n, c in named.items()))))
    return long.groupBy(*by, "cause").agg(F.countDistinct(F.when(F.col("hit"), F.col(patient))).alias("event_patients"), F.sum(F.col("hit").cast("long")).alias("event_rows"))


def attendance_by_year(visits: DataFrame) -> DataFrame:
    """Scheduled and attended visits per rounded year since the origin."""
    return visits.filter("eligible").groupBy(F.rint("years").cast("int").alias("year")).agg(F.count("*").alias("scheduled"), F.sum(F.col("attended").cast("long")).alias("attended"))


def grouped_counts(rows: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Suppressed counts over several groupings in one pass (grouping sets); columns not grouped by are NULL."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in columns)).agg(F.count("*").alias("n"))
    return out.withColumn("shown", rules.suppress(F.col("n")))


def report_counts(reports: DataFrame, brand: str, text: str, pattern: str) -> DataFrame:
    """Reports per brand, in total and with problem terms."""
    return reports.groupBy(brand).agg(F.count("*").alias("n_reports"), F.sum(F.coalesce(F.col(text).rlike(pattern), F.lit(False)).cast("long")).alias("n_problem_reports"))


def extraction_accuracy(found: DataFrame, expected: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Share of expected values met, per method and field; NULL expectations are not tested."""
    e = expected.select(F.col(key).alias("__k"), *(F.col(f).alias(f"__{f}") for f in fields))
    joined = found.join(e, F.col(key) == F.col("__k"))
    long = joined.select("method", F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"__{f}").cast("string").alias("want"), F.col(f).cast("string").alias("got")) for f in fields)))).filter("want is not null")
    return long.groupBy("method", "field").agg(F.count("*").alias("n"), F.avg(F.col("want").eqNullSafe(F.col("got")).cast("double")).alias("share_correct"))


def required_sample_size(folds: DataFrame, gate: int, n_patients: int) -> DataFrame:
    """ceil(n * gate * 1.25 / observed / 100) * 100 from the 10th percentile of event patients over folds; NULL without any."""
    observed = F.percentile("event_patients", 0.1)
    return folds.groupBy("cause").agg(observed.alias("observed_p10"), F.when(observed > 0, F.ceil(n_patients * gate * 1.25 / observed / 100) * 100).cast("long").alias("required_patients"))
