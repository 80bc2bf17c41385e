"""Adjudication as of every date equals adjudication request by request."""

import datetime
import random

from pyspark.sql import functions as F

from timberline.operators import experiments

DAY0 = datetime.date(2018, 1, 1)


def test_timelines_equal_requests_one_by_one(spark):
    r = random.Random(6)
    day = lambda n: (DAY0 + datetime.timedelta(days=n)).isoformat()
    patients, studies, exposures, events, requests, seq = [], [], [], [], [], 0
    for p in range(150):
        patients.append((p, None if p % 40 == 7 else day(0)))
        for _ in range(r.randrange(0, 8)):
            seq += 1
            # calm, worse and severe values against a calm reference
            g, eoa, dvi = r.choice([(10.0, 1.8, 0.5), (12.0, 1.7, 0.5), (26.0, 1.2, 0.3), (45.0, 0.7, 0.2), (None, 1.5, 0.4)])
            studies.append((p, seq, day(r.choice([40, 60, 100]) if r.random() < 0.3 else r.randrange(10, 900)), g, eoa, dvi, r.choice([0, 0, 1, 2])))
        for _ in range(r.randrange(0, 2)):
            start = r.randrange(30, 700)
            exposures.append((p, seq, "VKA", r.choice(["suspected_valve_thrombosis", "af"]), day(start), day(start + r.randrange(20, 200)) if r.random() < 0.5 else None))
        for _ in range(r.randrange(0, 2)):
            events.append((p, day(r.randrange(30, 900)), r.choice(["endocarditis", "thrombosis"])))
        requests += [(p, day(r.randrange(-20, 1000))) for _ in range(5)] + [(p, s[2]) for s in studies if s[0] == p][:3]
    made = lambda rows, schema, **dates: spark.createDataFrame(rows, schema).withColumns({k: F.to_date(v) for k, v in dates.items()}).drop("d", "e")
    p = made(patients, "patient_id long, d string", implant_date="d")
    s = made(studies, "patient_id long, seq long, d string, mean_gradient double, eoa double, dvi double, ar int", date="d").withColumns({"lvef": F.lit(55.0), "svi": F.lit(35.0)})
    x = made(exposures, "patient_id long, seq long, class string, indication string, d string, e string", start_date="d", stop_date="e").withColumn("post_suspicion", F.lit(False))
    m = made(events, "patient_id long, d string, type string", date="d")
    q = made(requests, "patient_id long, d string", prediction_date="d")
    at_once = {tuple(row) for row in experiments.score_status(q, p, s, x, m).collect()}
    one_by_one = {tuple(row) for row in experiments._status_by_request(q, p, s, x, m).collect()}
    assert at_once == one_by_one and len(at_once) > 800
    assert {row[2] for row in at_once} == {"ok", "endpoint_met", "no_reference_echo", "prediction_time_invalid"}
