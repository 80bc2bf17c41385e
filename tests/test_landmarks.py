"""No-look-ahead landmarks and adjudication on hand-made patients."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from timberline.operators import adjudicate as adj
from timberline.operators import asof, landmark

D = dt.date
STUDY = "patient_id string, seq long, date date, mean_gradient double, eoa double, dvi double, ar int, lvef double, svi double"


def studies(spark, rows, patient="p"):
    return spark.createDataFrame([(patient, i, d, g, e, v, a, 60.0, 40.0) for i, (d, g, e, v, a) in enumerate(rows)], STUDY)


CANON = [(D(2015, 3, 1), 10.0, 1.8, 0.50, 0), (D(2016, 3, 1), 12.0, 1.7, 0.48, 0), (D(2017, 3, 1), 25.0, 1.2, 0.35, 0), (D(2018, 3, 1), 30.0, 1.1, 0.33, 0)]


@pytest.fixture
def tables(spark):
    patients = spark.createDataFrame([("p", "TAVR", D(2015, 1, 1), 2.0)], "patient_id string, route string, implant_date date, bsa double")
    labs = spark.createDataFrame([("p", 1, D(2015, 1, 1), "egfr", 80.0), ("p", 2, D(2016, 3, 1), "egfr", 60.0), ("p", 3, D(2016, 3, 2), "egfr", 10.0)], "patient_id string, seq long, date date, analyte string, value double")
    exposures = spark.createDataFrame([("p", 1, "VKA", "af", D(2015, 6, 1), D(2015, 12, 1), False), ("p", 2, "SAPT", "routine", D(2016, 1, 1), None, False)], "patient_id string, seq long, class string, indication string, start_date date, stop_date date, post_suspicion boolean")
    events = spark.createDataFrame([("p", D(2017, 3, 1), None, D(2017, 3, 1), None, None, D(2019, 1, 1))], "patient_id string, svd_adjudicated_date date, svd_first_unresolved_date date, svd_first_positive_date date, death_date date, replacement_date date, end_followup_date date")
    return patients, studies(spark, CANON), labs, exposures, events


def test_landmarks_end_before_the_endpoint(tables):
    rows = {r["landmark_date"]: r for r in landmark.build_landmarks(*tables).collect()}
    assert sorted(rows) == [D(2015, 3, 1), D(2016, 3, 1)]
    r = rows[D(2016, 3, 1)]
    assert (r["event"], round(r["time"], 4)) == (1, round(365 / 365.25, 4))
    assert (r["current_gradient"], r["delta_gradient"], r["n_echoes"], r["current_stage"]) == (12.0, 2.0, 2, "1")
    assert (r["egfr"], r["ac_current_status"], r["ac_class_current"], r["on_antiplatelet"]) == (60.0, "past", "SAPT", True)  # same-day values count
    assert r["ac_cum_vka_years"] == round(183 / 365.25, 3) and r["mismatch_grade"] == "none" and r["row_weight_patient_balanced"] == 0.5
    assert rows[D(2015, 3, 1)]["current_stage"] == "0" and rows[D(2015, 3, 1)]["egfr"] == 80.0


def test_later_data_change_nothing(spark, tables):
    patients, s, labs, exposures, events = tables
    more = s.unionByName(studies(spark, [(D(2016, 9, 1), 90.0, 0.5, 0.1, 3)]).withColumn("seq", F.lit(99).cast("long")))
    base = {r["landmark_date"]: r for r in landmark.build_landmarks(patients, s, labs, exposures, events).collect()}
    after = {r["landmark_date"]: r for r in landmark.build_landmarks(patients, more, labs.filter("date < '2016-03-02'"), exposures, events).collect()}
    for d in base:
        skip = {"row_weight_patient_balanced"}
        assert {k: v for k, v in base[d].asDict().items() if k not in skip} == {k: v for k, v in after[d].asDict().items() if k not in skip}


def test_no_exposure_record_is_unknown(spark, tables):
    patients, s, labs, exposures, events = tables
    r = landmark.build_landmarks(patients, s, labs, exposures.limit(0), events).first()
    assert r["ac_class_current"] is None and r["on_antiplatelet"] is None


def test_label_override_and_policies(spark, tables):
    patients, s, labs, exposures, events = tables
    override = spark.createDataFrame([("p", D(2015, 9, 1))], "patient_id string, svd_event_date date")
    assert [r["landmark_date"] for r in landmark.build_landmarks(patients, s, labs, exposures, events, override=override).collect()] == [D(2015, 3, 1)]
    pending = events.withColumn("svd_adjudicated_date", F.lit(None).cast("date")).withColumn("svd_first_unresolved_date", F.lit("2017-03-01").cast("date"))
    rows = landmark.build_landmarks(patients, s, labs, exposures, pending)
    assert {r["event"] for r in rows.collect()} == {0} and rows.count() == 2
    assert {r["event"] for r in landmark.build_landmarks(patients, s, labs, exposures, pending, label_policy="sens_uncertain_positive").collect()} == {1}
    assert landmark.build_landmarks(patients, s, labs, exposures, pending, label_policy="sens_uncertain_negative").count() == 4
    with pytest.raises(ValueError):
        landmark.build_landmarks(patients, s, labs, exposures, pending, label_policy="other")


def record(spark, rows, exposures=(), events=(), death=None, replacement=None):
    s = studies(spark, rows)
    patients = spark.createDataFrame([("p", D(2015, 1, 1))], "patient_id string, implant_date date")
    staged = adj.staged_studies(s, asof.select_reference(s, patients))
    e = spark.createDataFrame(list(exposures), "patient_id string, indication string, start_date date, stop_date date")
    m = spark.createDataFrame(list(events), "patient_id string, type string, date date")
    t = spark.createDataFrame([("p", death, replacement)], "patient_id string, death_date date, replacement_date date")
    return adj.adjudicate(patients, staged, adj.thrombosis_windows(e, staged), m, t).first()


def test_adjudication_statuses(spark):
    ref, bad, worse, fine = CANON[0], CANON[2], CANON[3], (D(2018, 3, 1), 11.0, 1.8, 0.5, 0)
    assert record(spark, [])["svd_status"] == "no_reference"
    assert record(spark, [ref, CANON[1]])["svd_status"] == "no_candidate"
    r = record(spark, [ref, bad, worse])
    assert (r["svd_status"], r["svd_adjudicated_date"], r["svd_confirmation_date"], r["svd_confidence"]) == ("confirmed", bad[0], worse[0], "high")
    r = record(spark, [ref, bad, fine])
    assert (r["svd_status"], r["svd_uncertain_dates"], r["svd_first_unresolved_date"]) == ("uncertain_transient", [bad[0]], bad[0])
    r = record(spark, [ref, bad])
    assert (r["svd_status"], r["svd_adjudicated_date"], r["svd_first_unresolved_date"], r["svd_confidence"]) == ("unconfirmed_pending", None, bad[0], "moderate")
    assert record(spark, [ref, bad], death=D(2018, 5, 30))["svd_status"] == "confirmed_by_terminal_event"  # 455 days
    assert record(spark, [ref, bad], death=D(2018, 5, 31))["svd_status"] == "unconfirmed_pending"
    r = record(spark, [ref, bad, worse], events=[("p", "endocarditis", D(2017, 5, 1))])
    assert (r["svd_mechanism"], r["svd_adjudicated_date"], r["svd_confidence"]) == ("endocarditis", None, "low")
    r = record(spark, [ref, bad, fine], exposures=[("p", "suspected_valve_thrombosis", D(2017, 3, 10), D(2017, 9, 1))])
    assert (r["svd_status"], r["svd_thrombosis_attributed_dates"]) == ("thrombosis_attributed", [bad[0]])


def test_thinning_is_greedy(spark):
    rows = spark.createDataFrame([("p", D(2020, 1, d)) for d in (1, 5, 8, 12, 15)], "patient_id string, landmark_date date")
    assert sorted(r["landmark_date"].day for r in landmark.thin(rows, 7).collect()) == [1, 8, 15]
