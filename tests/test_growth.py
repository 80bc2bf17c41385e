"""Steps whose work must grow no faster than the input: what they join, carry and repeat; results against plain versions."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from oracles import SF, rows_of, rows_of_sql

from timberline.operators import asof, boosted, cif, cox, experiments, profile, resample, staging
from timberline.plans.registry import QUERIES, SQL


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_conventions_are_compared_without_a_join(spark):
    grid = np.arange(6.0)
    rows = [(i, (0.03 * (i + 1) * grid).tolist(), (0.2 * grid).tolist() if i % 4 else None, (0.01 * (i + 1) * grid[: 6 - i % 2]).tolist()) for i in range(9)]
    df = spark.createDataFrame(rows, "row_id long, a array<double>, b array<double>, c array<double>")
    out = cif.convention_differences(df, ["a", "b", "c"])
    assert "Join" not in plan_of(out)
    got = {r["state"]: (r["max_difference"], r["mean_difference"]) for r in out.collect()}
    gaps = {s: [] for s in ("S", "F_a", "F_b", "F_c")}
    for i, *h in rows:
        if h[1] is None or len(h[2]) < 6:
            continue
        d = np.diff(np.asarray(h), axis=1, prepend=0.0)
        total = d.sum(axis=0)
        s, p = np.exp(-np.cumsum(total)), np.cumprod(1 - total)
        k = np.r_[1.0, s[:-1]] * np.where(total > 0, (1 - np.exp(-total)) / np.where(total > 0, total, 1), 0)
        gaps["S"].extend(abs(s - p))
        for name, own in zip("abc", d, strict=True):
            gaps[f"F_{name}"].extend(abs(np.cumsum(k * own) - np.cumsum(np.r_[1.0, p[:-1]] * own)))
    assert set(got) == set(gaps)
    for s, d in gaps.items():
        assert np.allclose(got[s], (max(d), np.mean(d)))
    whole = cif.combine(df, ["a", "b", "c"]).filter(F.size("S") == 6).select("row_id").collect()
    assert {r["row_id"] for r in whole} == {2, 6}


def test_large_strata_are_boosted_together(spark):
    """Three jobs a round, whatever the number of strata, causes and earlier trees; the same trees as in one task."""
    r = np.random.default_rng(8)
    rows = [(i, i, "AB"[i % 2], float(r.integers(1, 30)), int(r.integers(0, 3)), float(r.integers(0, 9)), float(r.normal())) for i in range(600)]
    df = spark.createDataFrame(rows, "row_id long, patient_id long, route string, time double, event int, a double, b double")
    options = {"trees": 3, "rate": 0.5, "min_instances": 10, "bins": 8, "causes": {"svd": 1, "death": 2}}
    local = boosted.BoostedHazards(["a", "b"], **options).fit(df)
    spread = boosted.BoostedHazards(["a", "b"], local_rows=0, chunk_rows=70, **options)
    spark.sparkContext.setJobGroup("few", "few")
    spread.fit(df)
    few = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few"))
    spark.sparkContext.setJobGroup("more", "more")
    boosted.BoostedHazards(["a", "b"], local_rows=0, chunk_rows=70, **{**options, "trees": 5}).fit(df)
    more = len(spark.sparkContext.statusTracker().getJobIdsForGroup("more"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert more - few == 2 * 3
    for route in "AB":
        for cause in ("svd", "death"):
            for x, y in zip(local.models[route].trees[cause], spread.models[route].trees[cause], strict=True):
                assert (x.feature == y.feature).all() and (x.cut == y.cut).all() and np.allclose(x.value, y.value)


def test_summed_trees_equal_trees_in_turn():
    r = np.random.default_rng(2)
    trees = [boosted.Tree(np.asarray([f, g, h, -1, -1, -1, -1]), r.integers(0, 7, 7), r.normal(size=7)) for f, g, h in ((0, 1, 2), (2, 0, -1), (1, 1, 0), (2, -1, -1), (-1, -1, -1))]
    bins = r.integers(0, 8, (3, 500)).astype(np.uint8)
    assert np.allclose(boosted.summed(trees, 0.3, 2, 8)(bins), sum(0.3 * t.value[t.leaves(bins)] for t in trees))


def test_slopes_on_a_rounding_tie(spark, tmp_path):
    """Patients whose slopes are halves of the fourth digit, which the two sides' sums miss on either side."""
    import duckdb
    import timberline.plans.cohort_queries  # noqa: F401

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    patients, source = "(8833, 9658, 10299, 12601)", "/root/testdata/sf0.1"
    rows = {"customer": f"c_custkey in {patients}", "orders": f"o_custkey in {patients}", "lineitem": f"l_orderkey in (select o_orderkey from '{source}/orders.parquet' where o_custkey in {patients})"}
    for t, which in rows.items():
        con.execute(f"copy (select * from '{source}/{t}.parquet' where {which}) to '{tmp_path}/{t}.parquet' (format parquet)")
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    columns, want = rows_of_sql(con, SQL["f9_landmark_table"])
    df = QUERIES["f9_landmark_table"](spark, str(tmp_path))
    assert len(want) > 10 and rows_of(df, columns) == want
    at = columns.index("gradient_slope")
    assert any(str(r[at]).startswith("-106.531") for r in want)


def test_episodes_at_one_place_of_the_input_order(spark):
    """Two anticoagulants in use that input order does not tell apart give the same features whichever comes first."""
    episodes = [(1, 7, "VKA", use, "2000-01-01", None, False) for use in ("routine", "af")]
    points = spark.createDataFrame([(1, "2000-06-01")], "patient_id long, landmark_date string").withColumn("landmark_date", F.to_date("landmark_date"))
    got = []
    for rows in (episodes, episodes[::-1]):
        df = spark.createDataFrame(rows, "patient_id long, seq long, class string, indication string, start_date string, stop_date string, post_suspicion boolean")
        df = df.withColumns({c: F.to_date(c) for c in ("start_date", "stop_date")}).coalesce(1)
        got += [tuple(r) for r in asof.exposure_features(points, df).select("ac_class_current", "ac_indication").collect()]
    assert got == [("VKA", "af")] * 2


def test_line_items_are_read_once_for_landmarks(spark):
    """Values and episodes of the landmark table come of one join."""
    import timberline.plans.cohort_queries  # noqa: F401

    plan = plan_of(QUERIES["f9_landmark_table"](spark, SF)).splitlines()
    assert sum("Relation [" in line and "l_orderkey#" in line for line in plan) == 1


def test_history_in_one_pass(spark):
    """Values, slopes and exposures in one pass equal those taken one by one, also with ties, open ends, missing starts and values."""
    r = np.random.default_rng(12)
    day = lambda: f"20{r.integers(10, 13)}-{r.integers(1, 13):02}-{r.integers(1, 29):02}"
    maybe = lambda x, p=0.15: None if r.random() < p else x
    points = spark.createDataFrame(sorted({(f"p{r.integers(0, 12)}", day()) for _ in range(150)}), "patient_id string, landmark_date string").withColumn("landmark_date", F.to_date("landmark_date")).withColumn("more", F.struct(F.lit(1.5).alias("x"), F.col("patient_id")))
    labs = [(maybe(f"p{r.integers(0, 11)}", 0.05), day(), int(i), ("egfr", "hb", "other")[r.integers(0, 3)], maybe(float(r.integers(1, 90)))) for i in range(260)]
    labs = spark.createDataFrame(labs, "patient_id string, date string, seq long, analyte string, value double").withColumn("date", F.to_date("date"))
    kinds = ("VKA", "FXa", "DTI", "SAPT", "DAPT", "none")
    episodes = [(maybe(f"p{r.integers(0, 10)}", 0.05), int(r.integers(0, 40)), maybe(kinds[r.integers(0, 6)], 0.05), ("af", "routine")[r.integers(0, 2)], maybe(day()), maybe(day(), 0.3), maybe(bool(r.integers(0, 2)))) for _ in range(120)]
    exposures = spark.createDataFrame(episodes, "patient_id string, seq long, class string, indication string, start_date string, stop_date string, post_suspicion boolean")
    exposures = exposures.withColumns({c: F.to_date(c) for c in ("start_date", "stop_date")})
    out = asof.history_features(points, [labs, exposures], ["egfr", "hb"], {"egfr": "egfr_slope"})
    assert "Join" not in plan_of(out)
    want = asof.latest_as_of(points, labs, ["egfr", "hb"]).drop("egfr_day", "hb_day")
    want = asof.exposure_features(asof.slope_as_of(want, labs, "egfr", "egfr_slope"), exposures)
    assert out.columns == want.columns and rows_of(out, out.columns) == rows_of(want, want.columns)
    assert {x["ac_current_status"] for x in out.collect()} == {"current", "past", "never", None}
    sided = exposures.withColumns({"date": F.lit("2011-05-05").cast("date"), "analyte": F.lit("hb"), "value": F.col("seq") + 0.5})
    beside = asof.history_features(points, [sided], ["hb"], {})
    apart = asof.exposure_features(asof.latest_as_of(points, sided, ["hb"]).drop("hb_day"), exposures)
    assert rows_of(beside, beside.columns) == rows_of(apart, beside.columns)


def test_registry_files_hold_few_records(spark, monkeypatch):
    from timberline.plans import record_queries

    monkeypatch.setattr(record_queries, "RECORDS_PER_FILE", 20)
    df = record_queries.device_records(spark, "/root/testdata/sf0.001")
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
    assert len(df.inputFiles()) >= parts / 20
    assert rows_of(df.select("record_key"), ["record_key"]) == rows_of(QUERIES["a4_device_registry"](spark, "/root/testdata/sf0.001"), ["record_key"])


def test_audit_sample_is_limited_before_rows_meet(spark):
    from timberline.operators import text

    rows = spark.range(0, 4000, 1, 8).select(F.concat(F.lit("n"), "id").alias("note_ref"), F.when(F.col("id") % 7 == 0, "a").when(F.col("id") % 7 < 4, "b").otherwise("c").alias("kind"), F.col("id").alias("x"))
    out = text.audit_sample(rows, "kind", {"a": 3, "b": 5}, ["x"], seed=1)
    assert "WindowGroupLimit" in plan_of(out)
    got = {k: sum(r["kind"] == k for r in out.collect()) for k in "abc"}
    assert got == {"a": 3, "b": 5, "c": 0}


def test_observations_scan_the_texts_once(spark):
    from timberline.operators import text

    notes = ["Prosthetic valve: mean gradient is 20 mmHg, mean gradient is 30 mmHg. LVEF 55%.", "Native valve: mean gradient is 12 mmHg." + " " * 300 + "moderate regurgitation. LVEF 40%", "EF 60%, peak velocity 2.1 m/s", "nothing"]
    df = spark.createDataFrame(list(enumerate(notes)), "note_ref int, text string")
    out = text.observations(text.hits_table(df, ["note_ref"]), ["note_ref"])
    assert plan_of(out).count("MapInArrow") == 1
    got = {(r["note_ref"], r["class"]): (r["gradient"], r["lvef"], r["velocity"], r["regurgitation"]) for r in out.collect()}
    assert got == {(0, "prosthetic"): (20.0, 55.0, None, None), (1, "native"): (12.0, None, None, None), (1, "uncertain"): (None, 40.0, None, 2.0), (2, "uncertain"): (None, 60.0, 2.1, None)}
    assert "Join" not in plan_of(out)


def test_draws_travel_in_blocks(spark, monkeypatch):
    """The draws of a bootstrap, dealt by blocks of patients, are those counted one by one; few rows hold them on their way."""
    from timberline.operators import resample

    monkeypatch.setattr(resample, "BLOCK_DRAWS", 64)
    ids = spark.range(37).select((F.col("id") * 3).alias("patient_id"))
    want = {(r["rep"] + 1, r["patient_id"]): r["k"] for r in resample.bootstrap_weights(ids, 9, 4).collect()}
    assert sum(want.values()) == 9 * 37
    lists = {r["patient_id"]: r["reps"] for r in resample.bootstrap_lists(ids, 9, 4).collect()}
    counts = {r["patient_id"]: list(r["reps"]) for r in resample.bootstrap_counts(ids, 9, 4).collect()}
    assert set(lists) == set(counts) == {3 * i for i in range(37)}
    for p, own in counts.items():
        assert own[0] == 1 and own[1:] == [want.get((r, p), 0) for r in range(1, 10)]
        assert sorted(lists[p]) == [r for r, k in enumerate(own) for _ in range(k)]


def test_draws_are_hashed_together():
    from hashlib import md5

    from timberline.operators.resample import md5_heads

    numbers = np.r_[np.arange(1200), 99_999, 100_000, 10**12 + np.arange(5), 10**17]
    assert md5_heads(b"7:", numbers).tolist() == [int.from_bytes(md5(b"7:%d" % i).digest()[:8], "big") for i in numbers.tolist()]


def test_newton_steps_end_when_likelihoods_are_large(spark, monkeypatch):
    """Rounding of a large log likelihood neither halves steps nor keeps them going; the coefficients stay those of small weights."""
    from timberline.operators import cox

    r = np.random.default_rng(5)
    rows = [(float(r.integers(1, 60)), int(r.integers(0, 2)), float(r.normal()), float(r.normal())) for _ in range(500)]
    df = spark.createDataFrame(rows, "time double, event int, a double, b double")
    asked, real = [], cox._objectives
    monkeypatch.setattr(cox, "_objectives", lambda *a: asked.append(1) or real(*a))
    fit = lambda w: cox.fit_cox(df, ["a", "b"], F.col("event") == 1, weight=F.lit(w), penalizer=0.0)
    small = fit(1.0)
    few = len(asked)
    large = fit(1e9 / 3)
    assert small.converged and large.converged and np.allclose(small.beta, large.beta, atol=1e-9)
    assert few <= 6 and len(asked) - few <= 9


def test_folds_are_fitted_together(spark):
    """The models of all folds equal those fitted one by one, from fewer jobs than a fold each would take."""
    from timberline.operators import cox

    r = np.random.default_rng(3)
    rows = [(i, i // 2, "AB"[i % 2], i // 2 % 3, float(r.integers(1, 25)), int(r.integers(0, 3)), float(r.normal()), float(r.integers(0, 4))) for i in range(600)]
    df = spark.createDataFrame(rows, "row_id long, patient_id long, route string, fold int, time double, event int, a double, b double").localCheckpoint()
    causes = {"svd": 1, "death": 2}
    together = cox.fit_folds(df, 3, ["a", "b"], causes)
    for k, model in enumerate(together):
        alone = cox.CauseSpecificCox(["a", "b"], causes=causes).fit(df.filter(F.col("fold") != k))
        assert all(abs(model.means[c] - alone.means[c]) < 1e-12 for c in "ab")
        for name in causes:
            x, y = model.models[name], alone.models[name]
            assert x.status == y.status == "ok" and x.strata == y.strata and np.allclose(x.fit.beta, y.fit.beta, atol=1e-7)
        hazards = [{r["row_id"]: r["svd"] for r in m.hazards(df.filter(F.col("fold") == k), [0.0, 5.0, 20.0]).collect()} for m in (model, alone)]
        assert len(hazards[0]) == 200 and all(np.allclose(hazards[0][i], hazards[1][i], atol=1e-7) for i in hazards[0])


def test_nearest_source_meets_few_leaves(spark, monkeypatch):
    """Lookups of cells number a few per distinct place, and rows at one place share them; the distances are those of all pairs."""
    r = np.random.default_rng(12)
    s, q = r.uniform(0, 1, (4000, 2)), r.uniform(0, 1, (300, 2))
    source = spark.createDataFrame([tuple(map(float, x)) for x in s], "x double, y double")
    released = spark.createDataFrame([(i, *map(float, q[i % 300])) for i in range(900)], "i int, x double, y double")
    looked, plain = [], profile.salted_lookup

    def counting(rows, *args, **options):
        looked.append(rows.count())
        return plain(rows, *args, **options)

    monkeypatch.setattr(profile, "salted_lookup", counting)
    got = {x["i"]: x["distance"] for x in profile.nearest_source(released, source, ["x", "y"], "i").collect()}
    want = np.sqrt((((q[:, None] - s[None]) / s.std(axis=0)) ** 2).sum(axis=2)).min(axis=1)
    assert np.allclose([got[i] for i in range(900)], np.tile(want, 3))
    assert sum(looked) < 3 * 300


def test_scoring_reads_what_the_model_reads(spark, tmp_path):
    """Neither slopes nor stages of the studies are computed for a model that does not ask for them, nor written for its fit."""
    patients = spark.sql("select 1L as patient_id, date'2010-01-01' as implant_date, 'TAVR' as route, 1.8D as bsa")
    studies = spark.sql("select 1L as patient_id, date_add(date'2010-03-01', 200 * cast(id as int)) as date, id as seq, 10D + id as mean_gradient, 1.5D as eoa, 0.5D as dvi, 1 as ar, 55D as lvef, 35D as svi from range(5)")
    requests = spark.sql("select 1L as patient_id, d as prediction_date from values (date'2011-01-01'), (date'2012-01-01') t(d)")
    rows = experiments.request_features(requests, patients, studies)
    assert {r["prediction_date"].year: r["current_gradient"] for r in rows.collect()} == {2011: 11.0, 2012: 13.0}
    read = plan_of(rows.select("prediction_date", "current_gradient"))
    assert "regr_slope" not in read and "gradient_slope" not in read and "severity" not in read and "lvef" not in read.split("Project", 1)[1].split("\n")[0]
    train = spark.range(60).selectExpr("id as patient_id", "'A' as route", "cast(1 + id % 9 as double) as time", "cast(id % 2 as int) as event", "cast(id % 7 as double) as x", "repeat('wide', 100) as unread")
    written = []
    plain = cox.stage

    def seeing(df, name="stage"):
        written.append((name, df.columns))
        return plain(df, name)

    cox.stage = seeing
    try:
        cox.CauseSpecificCox(["x"], causes={"svd": 1}).fit(train)
    finally:
        cox.stage = plain
    assert dict(written)["training"] == ["patient_id", "route", "time", "event", "x"]


def test_records_of_a_variable_do_not_meet_in_one_task(spark):
    """A variable with any exact date counts inside the window only, others anywhere; no window over a whole variable."""
    rows = [(p, p * 10 + k, v, f"2010-0{1 + k}-05", "day" if v == "x" and p else "year") for p in range(3) for k, v in enumerate(("x", "y", None))]
    rows += [(1, 90, "x", "2012-01-01", "day")]
    obs = spark.createDataFrame(rows, "person_id int, record_id int, variable string, date string, date_precision string")
    persons = spark.createDataFrame([(p, "2010-01-01", "day") for p in range(3)], "person_id int, index_date string, index_date_precision string")
    out = profile.first_in_window(obs, persons)
    assert "windowspecdefinition(variable" not in plan_of(out)
    got = {(r["person_id"], r["variable"]): (r["kind"], r["record_id"]) for r in out.collect()}
    assert got == {(1, "x"): ("baseline", 10), (2, "x"): ("baseline", 20)} | {(p, v): ("cross_sectional", p * 10 + k) for p in range(3) for k, v in ((1, "y"), (2, None))}


def test_exposure_events_travel_narrow(spark):
    """Starts, ends and points meet as patient, day, sign and flags."""
    points = spark.sql("select 1L as patient_id, date'2010-01-01' as landmark_date")
    exposures = spark.sql("select 1L as patient_id, 1L as seq, 'VKA' as class, 'af' as indication, date'2009-01-01' as start_date, cast(null as date) as stop_date, true as post_suspicion")
    out = asof.exposure_features(points, exposures)
    widths, nodes = [], [out._jdf.queryExecution().optimizedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "Union":
            widths.append(node.output().size())
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    assert widths and max(widths) <= 4
    row = out.first()
    assert (row["ac_class_current"], row["ac_cum_vka_years"], row["ac_days_since_change"], row["ac_post_suspicion"], row["on_antiplatelet"]) == ("VKA", 0.999, 365.0, True, False)


def test_ranks_of_patients_take_no_window_over_patients(spark):
    for kind, values in (("long", [*range(500), *range(40), None]), ("string", [f"p{i % 37}" for i in range(90)])):
        df = spark.createDataFrame([(v,) for v in values], f"patient_id {kind}").repartition(3)
        got = {r["patient_id"]: r["rank"] for r in resample.patient_ranks(df, 3).collect()}
        known = sorted((v for v in set(values) if v is not None), key=lambda v: hashlib.md5(f"3:{v}".encode()).hexdigest())
        assert got == {v: i for i, v in enumerate([None] * (None in values) + known)}
    ranks = resample.patient_ranks(df, 3)
    windows = [line for line in plan_of(ranks).splitlines() if "Window [" in line]
    assert len(windows) == 1 and "__n" in windows[0]  # over what the ranges hold alone
    assert resample.patient_ranks(df.limit(0), 3).count() == 0


def test_studies_of_assumed_requests_are_staged_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(experiments, "stage", lambda df, name="stage": written.append((name, df.columns)) or staging.stage(df, name))
    QUERIES["j12_what_if"](spark, SF)
    assert [(n, set(c)) for n, c in written if n == "staged"] == [("staged", {"request_id", "date", "seq", "ref_date", "phenotype", "staged"})]


def test_rows_of_one_cell_are_boosted_together(spark, monkeypatch):
    """Large strata with few combinations of bins and few times: two jobs a round, no sorted chunks, the trees of one task."""
    r = np.random.default_rng(9)
    rows = [(i, i // 2, "AB"[i % 2], float(r.integers(1, 30)), int(r.integers(0, 3)), None if i % 50 == 0 else float(r.integers(0, 9)), float(r.normal()), 1.0) for i in range(900)]
    df = spark.createDataFrame(rows, "row_id long, patient_id long, route string, time double, event int, a double, b double, same double")
    for depth in (1, 2, 3):
        options = {"trees": 4, "rate": 0.5, "depth": depth, "min_instances": 10, "bins": 8, "causes": {"svd": 1, "death": 2}}
        local = boosted.BoostedHazards(["a", "b", "same"], **options).fit(df)
        with monkeypatch.context() as m:
            m.setattr(boosted.BoostedHazards, "_chunks", None)
            cells = boosted.BoostedHazards(["a", "b", "same"], local_rows=0, chunk_rows=100, **options).fit(df)
        for route in "AB":
            assert cells.models[route].events == local.models[route].events and len(cells.models[route].trees) == 2
            for cause in ("svd", "death"):
                for x, y in zip(local.models[route].trees[cause], cells.models[route].trees[cause], strict=True):
                    assert (x.feature == y.feature).all() and (x.cut == y.cut).all() and np.allclose(x.value, y.value)
    jobs = []
    for trees in (2, 5):
        spark.sparkContext.setJobGroup(f"cells {trees}", "cells")
        boosted.BoostedHazards(["a", "b"], trees=trees, bins=8, min_instances=10, causes={"svd": 1, "death": 2}, local_rows=0, chunk_rows=100).fit(df)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"cells {trees}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] - jobs[0] == 3 * 2
