"""Queries of the sources, of scalar rules, and of operators over records and notes that the other modules do not show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline import schema
from timberline.functions import rules
from timberline.operators import asof, cif, experiments, landmark, text
from timberline.operators.staging import stage_path
from timberline.plans.bindings import role, with_roles
from timberline.plans.cohort_queries import _ALL, _CONTEXT, _PRIMARY, _RECORDS, _REF, events_of, roles, written_staged_of
from timberline.plans.data_queries import _ALIASES, _NOTES, notes_of
from timberline.plans.model_queries import hazard_rows
from timberline.plans.registry import query, r6
from timberline.sources import registry, tables


@query(with_roles("patients") + " select cast(patient_id as string) as patient_id, route, implant_date, size_mm, bmi, null::boolean as diabetes from patients")
def a1_cohort_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patients of a cohort saved to the shared folder and loaded again with their schema."""
    folder = stage_path(spark, "cohort")
    tables.save_cohort({"patients": role(spark, sf_dir, "patients").withColumn("bmi", F.coalesce("bmi", F.lit(float("nan"))))}, folder)
    return tables.load_cohort(spark, folder, ["patients"])["patients"].select("patient_id", "route", "implant_date", "size_mm", "bmi", "diabetes")


@query("select cast(n_nationkey as string) as n_nationkey, n_name from nation")
def a2_table_by_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "nation") + ".tsv"
    tables.read_table(spark, f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").write.option("header", True).option("sep", "\t").csv(path)
    return tables.read_table(spark, path)


@query(with_roles("obs") + " select record_id, variable, value from obs")
def a3_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of a frozen snapshot whose manifest passes the checks."""
    folder = stage_path(spark, "snapshot")
    obs = role(spark, sf_dir, "obs")
    obs.write.parquet(f"{folder}/observations.parquet")
    obs.select("person_id").distinct().write.parquet(f"{folder}/persons.parquet")
    obs.select("person_id", F.lit("fit").alias("role")).distinct().write.parquet(f"{folder}/partition.parquet")
    spark.range(1).select(F.lit(True).alias("published"), F.lit(True).alias("frozen"), F.lit(True).alias("lineage_complete"), F.lit("real").alias("source_kind")).coalesce(1).write.json(f"{folder}/manifest.json")
    return tables.load_snapshot(spark, folder)["observations"].select("record_id", "variable", "value")


_DEVICE = "p_partkey % 3 = 0 or regexp_matches(p_name, '(?i)ring') or regexp_matches(p_type, '(?i)ring')"


#: A file of records is read by one task.
RECORDS_PER_FILE = 50_000


def device_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as a device registry's XML and read back."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    code = F.struct(F.array(F.struct(F.when(F.col("p_partkey") % 3 == 0, "LWR").otherwise("XXX").alias("productCode"))).alias("fdaProductCode"))
    size = F.struct(F.array(F.struct(F.concat((F.col("p_partkey") % 40).cast("string"), F.lit(" mm")).alias("sizeText"))).alias("deviceSize"))
    rows = p.select(F.col("p_partkey").cast("string").alias("publicDeviceRecordKey"), F.col("p_name").alias("brandName"), F.col("p_brand").alias("companyName"), F.col("p_type").alias("deviceDescription"), code.alias("productCodes"), size.alias("deviceSizes"))
    path = stage_path(spark, "devices")
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "publicDeviceRecordKey")  # text is many times the table's size
    rows.write.format("xml").option("rootTag", "devices").option("rowTag", "device").option("maxRecordsPerFile", RECORDS_PER_FILE).save(path)
    return registry.read_devices(spark, path, ["LWR"], "(?i)ring")


@query(f"select cast(p_partkey as string) as record_key, p_name as brand, p_brand as company from part where {_DEVICE}")
def a4_device_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return device_records(spark, sf_dir).select("record_key", "brand", "company")


@query(f"""with d as (select *, case when regexp_matches(p_name || ' ' || p_type, '(?i)ring') then 'ring' when regexp_matches(p_name || ' ' || p_type, '(?i)small') then 'small' end as model, p_partkey % 40 as mm from part where {_DEVICE})
select m.model, m.route, coalesce(count(p_partkey), 0) as n_records, case when count(*) filter (where mm between 17 and 34) > 0 and m.route is not null then 'high' when count(*) filter (where mm between 17 and 34) > 0 or m.route is not null then 'moderate' else 'low' end as confidence
from (select unnest(['ring', 'small', 'absent']) as model, unnest(['SAVR', 'TAVR', null]) as route) m left join d on d.model = m.model group by m.model, m.route""")
def d16_registry_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = spark.createDataFrame([("ring", "ring", 1, "SAVR", "stented"), ("small", "small", 2, "TAVR", "balloon"), ("absent", "no such brand", 3, None, None)], "model string, pattern string, priority int, route string, design_class string")
    models, _ = registry.roll_up_devices(device_records(spark, sf_dir), brands)
    return models.select("model", "route", F.coalesce("n_records", F.lit(0)).alias("n_records"), "confidence")


@query("select n_name as nct_id, 'arm ' || r as arm, cast(n_nationkey * 10 + r as string) as value, '100' as n_analysed from nation, (select unnest([1, 2]) as r) where n_nationkey % 2 = 0")
def a5_trial_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written as trial results, one document a file, and flattened to a row per measurement."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    group = lambda r: F.struct(F.lit(f"G{r}").alias("id"), F.lit(f"arm {r}").alias("title"))
    value = lambda r: F.struct(F.lit(f"G{r}").alias("groupId"), (F.col("n_nationkey") * 10 + r).cast("string").alias("value"))
    count = lambda r: F.struct(F.lit(f"G{r}").alias("groupId"), F.lit("100").alias("value"))
    title = F.when(F.col("n_nationkey") % 2 == 0, "Valve durability").otherwise("Length of stay")
    classes = F.array(F.struct(F.array(F.struct(F.array(value(1), value(2)).alias("measurements"))).alias("categories")))
    outcome = F.struct(title.alias("title"), F.array(group(1), group(2)).alias("groups"), F.array(F.struct(F.array(count(1), count(2)).alias("counts"))).alias("denoms"), classes.alias("classes"))
    rows = n.select(F.struct(F.struct(F.col("n_name").alias("nctId"), F.col("n_name").alias("briefTitle")).alias("identificationModule")).alias("protocolSection"), F.struct(F.struct(F.array(outcome).alias("outcomeMeasures")).alias("outcomeMeasuresModule")).alias("resultsSection"))
    path = stage_path(spark, "trials")
    rows.write.option("maxRecordsPerFile", 1).json(path)
    return registry.flatten_outcomes(registry.read_trials(spark, path), "(?i)valve", "(?i)durability").select("nct_id", "arm", "value", "n_analysed")


@query(with_roles("surv") + " select 'events' as \"table\", 2 * count(distinct route) as row_count, 0 as problems from surv")
def a6_aggregate_with_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppressed counts written as CSV with a provenance sidecar, then verified."""
    s = role(spark, sf_dir, "surv").filter("event < 2")
    counts = s.groupBy("route", "event").agg(F.count("*").alias("n")).select("route", "event", rules.suppress(F.col("n")).alias("n"))
    path = stage_path(spark, "aggregate") + "/events"
    meta = tables.write_aggregate(counts, path, "test tables", "events per route")
    problems = tables.verify_aggregates(spark, [path]).count()
    return meta.select("table", "row_count", F.lit(problems).cast("long").alias("problems"))


@query(with_roles("surv") + " select route, count(*) as n_rows, round(avg(pred), 6) as metric from surv group by route")
def a7_comparison_artefacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired rows and metrics of a comparison, written and read back."""
    s = role(spark, sf_dir, "surv")
    folder = stage_path(spark, "comparison")
    metrics = s.groupBy("route").agg(F.count("*").alias("n_rows"), F.avg("pred").alias("metric"))
    tables.write_comparison(s.select("row_id", "route", "pred"), metrics, s.agg(F.count("*").alias("n")), folder)
    back = spark.read.option("header", True).csv(f"{folder}/metrics")
    kept = spark.read.parquet(f"{folder}/paired_rows").groupBy("route").agg(F.count("*").alias("n_rows"))
    return kept.join(back.select("route", r6(F.col("metric").cast("double"), "metric")), "route")


_LABEL = "case o_orderkey % 6 when 0 then ' Severe' when 1 then 'mild' when 2 then 'TRACE' when 3 then 'moderate' when 4 then 'unheard of' end"


@query(f"select o_orderkey, case trim(lower({_LABEL})) when 'severe' then 3 when 'mild' then 1 when 'trace' then 0 when 'moderate' then 2 end as grade, case trim(lower({_LABEL})) when 'severe' then 'severe' when 'mild' then 'mild' when 'trace' then 'none' when 'moderate' then 'moderate' end as label from orders")
def b1_regurgitation_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("g", rules.regurgitation_grade(F.expr(_LABEL)))
    return o.select("o_orderkey", F.col("g").alias("grade"), rules.regurgitation_label(F.col("g")).alias("label"))


_NAMED = "case o_orderstatus when 'F' then ' Active, in stock' when 'O' then 'withdrawn 2019' when 'P' then 'Discontinued' end"


@query(f"select o_orderkey, case o_orderstatus when 'F' then 'active' when 'O' then 'withdrawn' when 'P' then 'discontinued' else 'unknown' end as status from orders")
def b13_market_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", rules.market_status(F.expr(_NAMED)).alias("status"))


@query("select row_id, not (row_id % 24 - 8 >= 10 or coalesce(case when row_id % 5 > 0 then row_id % 3 end - 1 >= 1, false)) as kept from (select o_orderkey as row_id from orders)")
def b14_prevalent_early(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("row_id"), (~rules.prevalent_early(k % 24, F.lit(8), F.when(k % 5 > 0, k % 3), F.lit(1))).alias("kept"))


@query(with_roles("surv") + " select 'event' as column_name, true as forbidden union all select 'patient_id', true union all select 'pred', false union all select 'pred2', false union all select 'route', false union all select 'row_id', false union all select 'time', true union all select 'valve_age_years', false")
def b15_forbidden_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which columns of the survival rows the feature guard refuses, each asked on its own."""
    s = role(spark, sf_dir, "surv")

    def refused(name: str) -> bool:
        try:
            schema.check_features([name])
        except ValueError:
            return True
        return False

    names = F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(refused(c)).alias("forbidden")) for c in s.columns))
    return s.limit(1).select(F.inline(names))


@query("select o_orderkey, case when o_orderkey % 4 = 0 then null when o_orderkey % 3 = 0 then make_date(year(o_orderdate)::int, 1, 1) else o_orderdate::date end as day, case when o_orderkey % 4 = 0 then 'none' when o_orderkey % 3 = 0 then 'year' else 'day' end as precision from orders")
def b17_date_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    written = F.when(F.col("o_orderkey") % 4 == 0, None).when(F.col("o_orderkey") % 3 == 0, F.substring(day, 1, 4)).otherwise(day)
    return o.withColumn("w", written).select("o_orderkey", schema.parse_date(F.col("w")).alias("day"), schema.date_precision(F.col("w")).alias("precision"))


@query(with_roles("studies") + " select patient_id, seq, case when seq % 3 = 0 then make_date(year(date)::int, 1, 1) else date end as date, case seq % 5 when 0 then 3 when 1 then 1 when 2 then 0 end as ar from studies where seq % 7 > 1 and seq % 4 > 0")
def b18_study_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native-valve and undated studies go; grades become ordinals."""
    s, k = role(spark, sf_dir, "studies").drop("ar"), F.col("seq")
    day = F.date_format("date", "yyyy-MM-dd")
    written = F.when(k % 4 == 0, None).when(k % 3 == 0, F.substring(day, 1, 4)).otherwise(day)
    grade = F.when(k % 5 == 0, "severe").when(k % 5 == 1, "Mild").when(k % 5 == 2, "trivial").when(k % 5 == 3, "unheard of")
    raw = s.withColumns({"date": written, "ar_grade": grade, "location": F.when(k % 7 == 0, "native").when(k % 7 == 1, "uncertain").otherwise("prosthetic")})
    return asof.normalise_studies(raw).select("patient_id", "seq", "date", "ar")


@query(with_roles("patients", "studies", "terminal") + _REF + _CONTEXT)
def b5_comparator_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparator over a table that holds reference and current study under other names."""
    patients, studies, terminal = roles(spark, sf_dir, "patients", "studies", "terminal")
    requests = terminal.select("patient_id", F.date_sub("end_followup_date", 400).alias("prediction_date"))
    pairs = asof.comparator_pairs(studies, patients, requests)
    names = {"mean_gradient": "gradient", "eoa": "eoa_cm2", "dvi": "dvi", "ar": "ar_ordinal", "date": "study_date", "lvef": "lvef_pct", "svi": "svi"}
    renamed = pairs.select("patient_id", "prediction_date", *(F.col(f"{a}_{c}").alias(f"{b}_{n}") for a, b in (("ref", "reference"), ("cur", "current")) for c, n in names.items()))
    return asof.comparator_rows(renamed).select("patient_id", "prediction_date", "verdict.status", "verdict.stage")


@query(with_roles(*_ALL) + _RECORDS + _PRIMARY + """ select 'forbidden_features' as check_name, 1::bigint as n union all select 'rows_on_or_after_endpoint', 0 union all select 'rows_without_time', 0 union all select 'landmark_rows', count(*) from outcomes union all select 'landmark_patients', count(distinct patient_id) from outcomes
  union all select 'svd_patients', count(distinct patient_id) filter (where event = 1) from outcomes union all select 'death_patients', count(distinct patient_id) filter (where event = 2) from outcomes union all select 'replacement_patients', count(distinct patient_id) filter (where event = 3) from outcomes""")
def m11_landmark_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    patients, studies, staged = written_staged_of(spark, sf_dir)
    events = events_of(spark, sf_dir, staged)
    rows = landmark.build_landmarks(patients, studies, role(spark, sf_dir, "labs"), role(spark, sf_dir, "exposures"), events, with_features=False, staged=staged)
    return landmark.contract(rows, events, ["current_gradient", "t_lm", "svd_status"])


@query(_NOTES + """ select note_ref, case seq % 4 when 0 then 'TAVR' when 1 then 'SAVR' else 'unknown' end as route, case seq % 4 when 0 then 'SAPIEN 3' when 1 then 'Magna Ease' end as canonical_model, case when seq % 4 = 0 then 20 + seq % 10 when seq % 4 = 1 then 20 + seq % 9 end as size_mm, case when seq % 4 < 2 then year end as implant_year,
  case seq % 4 when 0 then 0.9::double when 1 then 0.85::double else 0.0::double end as route_confidence, case when seq % 4 < 2 then 0.9::double else 0.0::double end as model_confidence, case when seq % 4 < 2 then 0.8::double else 0.0::double end as size_confidence,
  array_to_string(list_filter([case when seq % 13 = 0 then 'endocarditis' end, case when seq % 9 = 1 then 'valve_in_valve' end], lambda x: x is not null), ',') as events, seq % 4 = 1 as warned from kept""")
def g6_rule_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole record of a note by rules, with confidences, evidence and warnings (the device table calls Magna Ease transcatheter
    here, so its notes are warned about)."""
    aliases = spark.createDataFrame(_ALIASES, "model string, pattern string, guarded boolean")
    devices = spark.createDataFrame([("SAPIEN 3", "TAVR"), ("Magna Ease", "TAVR")], "model string, route string")
    out = text.extract_passports(notes_of(spark, sf_dir), aliases, devices, ["note_ref"])
    return out.select(
        "note_ref", "route", "canonical_model", F.col("size_mm").cast("long").alias("size_mm"), "implant_year", "route_confidence", "model_confidence", "size_confidence",
        F.array_join("events", ",").alias("events"), F.array_contains("warnings", "route_differs_from_device").alias("warned"),
    )


@query(_NOTES + """, p as (select patient_id, bool_or(seq % 4 = 0) as t, bool_or(seq % 4 = 1) as s, min(year) filter (where seq % 4 < 2) as iy, min(case when seq % 4 = 0 then 20 + seq % 10 when seq % 4 = 1 then 20 + seq % 9 end) as mm, bool_or(seq % 9 = 1) as viv from kept group by patient_id),
x as (select case when t and s then 'TAVR+SAVR' when t then 'TAVR' when s then 'SAVR' else '' end as route, case when s then 'Magna Ease' when t then 'SAPIEN 3' else '' end as model, case when iy between 2006 and 2012 then '2006-2012' when iy between 2013 and 2017 then '2013-2017' when iy between 2018 and 2022 then '2018-2022' when iy is not null then 'outside' end as era, mm, viv from p),
c as (select 'route' as kind, route as level, count(*) as n from x group by route union all select 'model', model, count(*) from x group by model union all select 'era', era, count(*) from x group by era union all select 'size', cast(mm as string), count(*) from x group by mm union all select 'valve_in_valve', cast(viv as string), count(*) from x group by viv)
select kind, level, n, case when n > 0 and n < 5 then '<5' else cast(n as string) end as shown from c""")
def d1_record_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppressed counts of device records by route, model, era of implantation, size and event."""
    notes = notes_of(spark, sf_dir)
    aliases = spark.createDataFrame(_ALIASES, "model string, pattern string, guarded boolean")
    models = text.device_matches(notes, aliases, ["patient_id", "note_ref"])
    records = text.passport(text.note_flags(notes), text.hits_table(notes, ["patient_id", "note_ref", "year"]), models)
    kinds = {"route": F.col("route"), "model": F.col("canonical_model"), "era": rules.era(F.col("implant_year")), "size": F.col("size_mm").cast("string"), "valve_in_valve": F.col("event_valve_in_valve").cast("string")}
    long = records.select(F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("level")) for k, c in kinds.items()))))
    return long.groupBy("kind", "level").agg(F.count("*").alias("n")).withColumn("shown", rules.suppress(F.col("n")))


@query(with_roles("surv") + " select row_id, case when row_id % 3 = 0 then 'TAVR' when row_id % 3 = 1 then 'unknown' end as device_route, case when row_id % 3 = 0 then 'active' when row_id % 3 = 1 then 'withdrawn' else 'unknown' end as device_market_status from surv")
def c10_device_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    devices = spark.createDataFrame([("A", "TAVR", "Active"), ("B", "elsewhere", "withdrawn 2020"), ("A", None, "Active")], "canonical_model string, route string, market_status string")
    rows = role(spark, sf_dir, "surv").withColumn("canonical_model", F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("row_id") % 3 + 1).cast("int")))
    out = experiments.device_info(rows, devices)
    return out.select("row_id", "device_route", "device_market_status")


def _in_order(state: str) -> Column:
    """A state's probabilities as an array, by horizon."""
    return F.transform(F.array_sort(F.collect_list(F.struct("horizon", state))), lambda x: x[state])


@query(with_roles("surv") + " select count(*) filter (where row_id % 6 = 0) as n_violations, count(*) as n from surv")
def j13_probability_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State probabilities add up to one; a sixth of the rows is broken on purpose and found."""
    rows, grid = hazard_rows(spark, sf_dir)
    wide = cif.at_horizons(cif.combine(rows), grid, [1.0, 3.0, 5.0]).groupBy("row_id").agg(*(_in_order(s).alias(s) for s in cif.STATES))
    broken = wide.withColumn("svd", F.when(F.col("row_id") % 6 == 0, F.transform("svd", lambda x: x + 0.01)).otherwise(F.col("svd")))
    found = cif.probability_violations(broken)
    return wide.agg(F.count("*").alias("n")).crossJoin(found.agg(F.count("*").alias("n_violations"))).select("n_violations", "n")
