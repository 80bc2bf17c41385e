"""Literal cases of the scalar rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from timberline.functions import rules
from timberline.schema import check_features, check_no_truth, date_precision, nan_to_null, parse_date

FIELDS = "mean_gradient double, eoa double, dvi double, ar int"
BASE = (10.0, 1.6, 0.5, 0)


def staged(spark, current, reference=BASE):
    df = spark.createDataFrame([(*current, *reference)], ", ".join(f"{p}{x}" for p in ("c_", "r_") for x in FIELDS.split(", ")))
    return df.select(rules.stage(rules.prefixed("c_"), rules.prefixed("r_")).alias("s")).select("s.*", rules.phenotype(F.col("s")).alias("phenotype")).first()


@pytest.mark.parametrize(
    ("current", "reference", "stage", "phenotype"),
    [
        ((20.0, 1.3, 0.5, 0), BASE, "2", "stenotic"),  # inclusive limits
        ((25.0, 1.6, 0.4, 0), BASE, "1", "uncertain"),  # 0.5 - 0.4 is just below 0.1: staging has no tolerance
        ((30.0, 1.0, 0.5, 0), BASE, "3", "stenotic"),
        ((29.9, 1.0, 0.5, 0), BASE, "2", "stenotic"),
        ((12.0, 1.6, 0.5, 0), BASE, "1", "uncertain"),
        ((10.0, 1.6, 0.5, 0), BASE, "0", "uncertain"),
        ((10.0, 1.6, 0.5, 2), BASE, "2", "regurgitant"),
        ((22.0, 1.2, 0.5, 3), BASE, "3", "mixed"),
        ((10.0, 1.6, 0.5, 2), (10.0, 1.6, 0.5, None), "2", "regurgitant"),  # a missing reference grade counts as below
        ((None, 1.6, 0.5, 3), BASE, "uncertain", "uncertain"),
        ((30.0, None, None, 3), BASE, "uncertain", "uncertain"),
        ((30.0, 1.0, None, 0), (10.0, None, 0.5, 0), "1", "uncertain"),  # no measure in common
    ],
)
def test_stage(spark, current, reference, stage, phenotype):
    r = staged(spark, current, reference)
    assert (r["stage"], r["phenotype"]) == (stage, phenotype)


def test_stage_with_population_fallback(spark):
    df = spark.createDataFrame([(25.0, 1.2, 0.4, 0, 10.0, 1.6, 0.5, 0)], ", ".join(f"{p}{x}" for p in ("c_", "f_") for x in FIELDS.split(", ")))
    none = lambda n: F.lit(None).cast("double")
    r = df.select(rules.stage(rules.prefixed("c_"), none, F.lit(False), rules.prefixed("f_")).alias("s")).first()["s"]
    assert (r["stage"], r["reference_source"], r["confidence"]) == ("2", "population", "low")
    r = df.select(rules.stage(rules.prefixed("c_"), none, F.lit(False)).alias("s")).first()["s"]
    assert (r["stage"], r["reason"]) == ("uncertain", "no_reference")


def compared(spark, current, reference=BASE, confirmed=True, fresh=True, dates=("2015-06-01", "2018-06-01", "2019-01-01")):
    schema = ", ".join(f"{p}{x}" for p in ("c_", "r_") for x in FIELDS.split(", "))
    df = spark.createDataFrame([(*current, *reference)], schema)
    day = {"r_": dates[0], "c_": dates[1]}

    def study(p):
        return lambda n: F.lit(day[p]).cast("date") if n == "date" else F.lit(None).cast("string") if n == "valve_id" else F.col(f"{p}{n}")

    context = {"prediction_date": F.lit(dates[2]).cast("date"), "valve_id": F.lit(None).cast("string"), "ar_confirmed": F.lit(confirmed), "fresh": F.lit(fresh)}
    return df.select(rules.comparator(study("c_"), study("r_"), context.__getitem__).alias("v")).first()["v"]


def test_comparator(spark):
    assert compared(spark, (20.0, 1.3, 0.5, 0))["status"] == "positive"
    assert compared(spark, (20.0, 1.3, 0.5, 0))["stage"] == 2
    assert compared(spark, (25.0, 1.6, 0.4, 0))["status"] == "positive"  # the comparator forgives representation at limits
    assert compared(spark, (30.0, 1.0, 0.3, 0))["stage"] == 3
    assert compared(spark, (12.0, 1.6, 0.5, 0))["status"] == "negative"
    assert compared(spark, (25.0, None, None, 0))["status"] == "indeterminate"  # gradient alone does not decide
    assert compared(spark, (12.0, None, None, 0))["status"] == "negative"  # but a small rise rules it out
    assert compared(spark, (12.0, 1.6, 0.5, 2), (10.0, 1.6, 0.5, None))["status"] == "indeterminate"
    assert compared(spark, (12.0, 1.6, 0.5, 2), confirmed=False)["status"] == "indeterminate"
    stale = compared(spark, (30.0, 1.0, 0.3, 0), fresh=False)
    assert stale["status"] == "indeterminate" and "stale_current_study" in stale["reason_codes"]
    assert "future_current_study" in compared(spark, BASE, dates=("2015-06-01", "2020-06-01", "2019-01-01"))["reason_codes"]


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").orderBy("i").select(column).collect()]


def test_small_rules(spark):
    assert values(spark, rules.suppress(F.col("n")), [("0",), ("1",), ("4",), ("5",), (None,), ("<5",)], "n string") == ["0", "<5", "<5", "5", None, "<5"]
    assert values(spark, rules.regurgitation_grade(F.col("g")), [(" Mild",), ("trace",), ("odd",), (None,)], "g string") == [1, 0, None, None]
    assert values(spark, rules.mismatch_grade(F.col("x")), [(0.9,), (0.85,), (0.65,), (None,)], "x double") == ["none", "moderate", "severe", None]
    assert values(spark, rules.duration_bin(F.col("y")), [(1,), (3,), (4,), (9,), (0,)], "y int") == ["(0,1]", "(1,3]", "(3,4]", "(4,1000]", None]
    assert values(spark, rules.guideline_interval("ACC_AHA", F.lit("SAVR"), F.col("a")), [(2.0,), (5.0,), (10.0,)], "a double") == [48.0, 72.0, 12.0]
    assert values(spark, rules.prevalent_early(*map(F.col, "abcd")), [(20.0, 10.0, None, None), (None, 1.0, 1.0, 1.0)], "a double, b double, c double, d double") == [True, False]
    assert values(spark, rules.market_status(F.col("m")), [("Withdrawn 2018",), ("ACTIVE",), (None,)], "m string") == ["withdrawn", "active", "unknown"]


def test_dates(spark):
    assert values(spark, parse_date(F.col("d")), [("2019-02-03",), ("2019",), (None,)], "d string") == [dt.date(2019, 2, 3), dt.date(2019, 1, 1), None]
    assert values(spark, date_precision(F.col("d")), [("2019-02-03",), ("2019",), (None,)], "d string") == ["day", "year", "none"]
    with pytest.raises(Exception, match="not a date"):
        values(spark, parse_date(F.col("d")), [("03/02/2019",)], "d string")


def test_guards(spark):
    df = spark.createDataFrame([(float("nan"), 1.0), (2.0, None)], "a double, b double")
    assert [tuple(r) for r in nan_to_null(df).collect()] == [(None, 1.0), (2.0, None)]
    with pytest.raises(ValueError):
        check_features(["egfr", "svd_status"])
    with pytest.raises(ValueError):
        check_no_truth({"echoes": df}, ["b"])
