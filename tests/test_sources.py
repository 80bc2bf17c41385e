"""Reading, writing and checking tables; notes, registries and lineage."""

import json

import pytest
from pyspark.sql import functions as F

from timberline.operators import profile, text
from timberline.sources import registry, tables


def test_read_by_suffix(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    df.write.parquet(f"{tmp_path}/t.parquet")
    df.write.option("header", True).csv(f"{tmp_path}/t.csv")
    df.write.option("header", True).option("sep", "\t").csv(f"{tmp_path}/t.tsv")
    df.write.json(f"{tmp_path}/t.jsonl")
    for s in ("parquet", "csv", "tsv", "jsonl"):
        assert [(str(r["a"]), r["b"]) for r in tables.read_table(spark, f"{tmp_path}/t.{s}").collect()] == [("1", "x")]
    with pytest.raises(ValueError):
        tables.read_table(spark, "t.xlsx")


def test_cohort_round_trip(spark, tmp_path):
    labs = spark.createDataFrame([("p", "egfr", float("nan"))], "patient_id string, analyte string, value double")
    tables.save_cohort({"labs": labs}, str(tmp_path))
    r = tables.load_cohort(spark, str(tmp_path), ["labs"])["labs"].first()
    assert r["value"] is None and r["date"] is None and r["analyte"] == "egfr"


def test_snapshot_is_checked(spark, tmp_path):
    one = spark.createDataFrame([(1,)], "person_id int")
    for n in ("persons", "observations", "partition"):
        one.write.parquet(f"{tmp_path}/{n}.parquet")
    ok = {"source_kind": "export", "published": True, "frozen": True, "lineage_complete": True}
    (tmp_path / "manifest.json").write_text(json.dumps(ok))
    assert set(tables.load_snapshot(spark, str(tmp_path))) == {"persons", "observations", "partition"}
    for broken in ({"frozen": False}, {"lineage_complete": False}, {"source_kind": "real_with_synthetic_defaults"}):
        with pytest.raises(profile.SnapshotRejected):
            tables.check_snapshot({**ok, **broken})


def test_aggregate_with_sidecar(spark, tmp_path):
    df = spark.createDataFrame([("a", "<5"), ("b", "7")], "route string, n string")
    meta = tables.write_aggregate(df, f"{tmp_path}/agg", "notes", "patients per route").first()
    assert meta["row_count"] == 2 and meta["columns"] == ["route", "n"]
    assert tables.verify_aggregates(spark, [f"{tmp_path}/agg"]).count() == 0
    with pytest.raises(ValueError):
        tables.write_aggregate(spark.createDataFrame([("Patient_12",)], "x string"), f"{tmp_path}/bad", "s", "d")


def test_device_registry(spark, tmp_path):
    (tmp_path / "d.xml").write_text("""<devices>
    <device><publicDeviceRecordKey>k1</publicDeviceRecordKey><brandName>SAPIEN 3</brandName><versionModelNumber>9600</versionModelNumber><companyName>E</companyName><deviceDescription>valve 23 mm</deviceDescription>
      <identifiers><identifier><deviceId>1</deviceId><deviceIdType>Primary</deviceIdType></identifier><identifier><deviceId>2</deviceId></identifier></identifiers>
      <productCodes><fdaProductCode><productCode>NPT</productCode></fdaProductCode></productCodes><deviceSizes><deviceSize><sizeText>26 mm</sizeText></deviceSize></deviceSizes></device>
    <device><publicDeviceRecordKey>k2</publicDeviceRecordKey><brandName>Glove</brandName><productCodes><fdaProductCode><productCode>XXX</productCode></fdaProductCode></productCodes></device></devices>""")
    found = registry.read_devices(spark, f"{tmp_path}/d.xml", ["NPT"], "(?i)magna")
    assert [r["record_key"] for r in found.collect()] == ["k1"] and len(found.first()["identifiers"]) == 2
    brands = spark.createDataFrame([("SAPIEN 3", r"sapien\s*3", 1, "TAVR", "balloon"), ("Magna", "magna", 2, "SAVR", "surgical")], "model string, pattern string, priority int, route string, design_class string")
    models, aliases = registry.roll_up_devices(found, brands)
    got = {r["model"]: (r["sizes_mm"], r["confidence"], r["n_records"]) for r in models.collect()}
    assert got["SAPIEN 3"] == ("26", "high", 1) and got["Magna"][1] == "moderate"
    assert [r["alias"] for r in aliases.collect()] == ["SAPIEN 3"]


def test_trial_results(spark, tmp_path):
    study = {"protocolSection": {"identificationModule": {"nctId": "N1", "briefTitle": "T"}}, "resultsSection": {"outcomeMeasuresModule": {"outcomeMeasures": [
        {"title": "Structural valve deterioration", "description": "d", "timeFrame": "5 y", "unitOfMeasure": "%", "paramType": "NUMBER", "groups": [{"id": "OG0", "title": "Arm A"}], "denoms": [{"units": "P", "counts": [{"groupId": "OG0", "value": "50"}]}],
         "classes": [{"categories": [{"title": "c", "measurements": [{"groupId": "OG0", "value": "3"}, {"groupId": "OG9", "value": "4"}]}]}]}, {"title": "Length of stay"}]}}}
    (tmp_path / "t.json").write_text(json.dumps(study))
    out = registry.flatten_outcomes(registry.read_trials(spark, f"{tmp_path}/t.json"), "(?i)deterioration", "(?i)structural").orderBy("value").collect()
    assert [(r["arm"], r["value"], r["n_analysed"], r["durability_related"]) for r in out] == [("Arm A", "3", "50", True), ("OG9", "4", "", True)]


def test_note_extraction(spark):
    notes = [
        ("a", 1, "TAVR with 26 mm SAPIEN 3 valve. Mean gradient of 12 mm Hg, DVI: .45."),
        ("a", 2, "Native valve mean gradient 45 mmHg" + "." * 300 + " Prosthetic valve mean gradient is 14 mmHg with mild-to-moderate paravalvular regurgitation. AR 2+"),
        ("b", 3, "Valve in Valve: No. Reoperation: No."),
        ("b", 4, "Seen per Epic chart review. " + "." * 120 + " Epic 23 mm porcine valve."),
        ("b", 5, None),
    ]
    df = spark.createDataFrame([(p, s, 2010 + s, "Operative Report" if s == 1 else "Progress Notes", "Deleted" if s == 9 else None, t) for p, s, t in notes], "patient_id string, seq long, year int, type string, status string, text string").withColumn("note_date", F.col("year"))
    prepared = text.prepare_notes(df)
    hits = text.hits_table(prepared, ["patient_id", "note_ref", "seq", "year"])
    got = sorted((r["seq"], r["field"], r["value"], r["prosthetic"], r["native"]) for r in hits.collect())
    assert (1, "gradient", 12.0, True, False) in got and (1, "dvi", 0.45, True, False) in got
    assert (2, "gradient", 45.0, False, True) in got and (2, "gradient", 14.0, True, False) in got and (2, "regurgitation", 2.0, True, False) in got
    flags = {r["seq"]: r for r in text.note_flags(prepared).collect()}
    assert flags[1]["sizes"] == [26] and flags[1]["transcatheter"] and not flags[3]["event_valve_in_valve"] and not flags[5]["event_redo"]
    aliases = spark.createDataFrame([("SAPIEN", "sapien", False), ("SAPIEN 3", r"sapien\s+3", False), ("Epic", r"\bEpic\b", True)], "model string, pattern string, guarded boolean")
    models = text.device_matches(prepared, aliases, ["patient_id", "note_ref", "seq"])
    assert sorted((r["seq"], r["model"]) for r in models.collect()) == [(1, "SAPIEN"), (1, "SAPIEN 3"), (4, "Epic")]
    card = {r["patient_id"]: r for r in text.passport(text.note_flags(prepared), hits, models).collect()}
    assert (card["a"]["route"], card["a"]["canonical_model"], card["a"]["size_mm"], card["a"]["implant_year"], card["a"]["max_gradient_prosthetic"]) == ("TAVR", "SAPIEN 3", 26, 2011, 14.0)
    obs = {(r["note_ref"], r["class"]): r["gradient"] for r in text.observations(hits, ["note_ref"]).collect()}
    assert obs[("a_1", "prosthetic")] == 14.0 and obs[("a_1", "native")] == 45.0
    q = spark.createDataFrame([("Mean Gradient 12", "gradient 12"), ("abc", "x")], "t string, q string").select(text.locate_quote(F.col("t"), F.col("q")).alias("s")).collect()
    assert (q[0]["s"]["start"], q[0]["s"]["end"], q[1]["s"]) == (5, 16, None)


def test_lineage(spark):
    schema = "record_id string, value_origin string, parent_record_ids array<string>"
    ok = spark.createDataFrame([("a", "observed", []), ("b", "derived", ["a"]), ("c", "placeholder", []), ("d", "derived", ["b", "c"]), ("e", "derived", ["d"])], schema)
    got = {r["record_id"]: (r["admitted"], r["reason"]) for r in profile.admitted_records(ok).collect()}
    assert got == {"a": (True, None), "b": (True, None), "c": (False, "non_observed_origin"), "d": (False, "non_observed_ancestor"), "e": (False, "non_observed_ancestor")}
    with pytest.raises(profile.SnapshotRejected, match="not in the snapshot"):
        profile.admitted_records(spark.createDataFrame([("a", "observed", ["z"])], schema))
    with pytest.raises(profile.SnapshotRejected, match="cycle"):
        profile.admitted_records(spark.createDataFrame([("a", "observed", ["b"]), ("b", "observed", ["a"])], schema))
