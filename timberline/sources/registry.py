"""Device registries and trial results: nested XML and JSON to tables, and the roll-up of records to device models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.operators.patterns import matching
from timberline.operators.staging import broadcast_if_small

_IDENT = "array<struct<deviceId:string,deviceIdType:string,deviceIdIssuingAgency:string>>"
_SIZE = "array<struct<sizeType:string,size:struct<_value:string,_unit:string>,sizeText:string>>"
DEVICE_SCHEMA = (
    "publicDeviceRecordKey string, brandName string, versionModelNumber string, catalogNumber string, companyName string, deviceDescription string, "
    f"deviceCommDistributionStatus string, devicePublishDate string, identifiers struct<identifier:{_IDENT}>, gmdnTerms struct<gmdn:array<struct<gmdnPTName:string>>>, "
    f"productCodes struct<fdaProductCode:array<struct<productCode:string,productCodeName:string>>>, deviceSizes struct<deviceSize:{_SIZE}>"
)


def read_devices(spark: SparkSession, path: str, product_codes: Sequence[str], keywords: str) -> DataFrame:
    """Device records of a registry export, kept when a product code is listed or brand or description match."""
    raw = spark.read.format("xml").option("rowTag", "device").option("ignoreNamespace", True).schema(DEVICE_SCHEMA).load(path)
    codes = F.coalesce("productCodes.fdaProductCode", F.array().cast("array<struct<productCode:string,productCodeName:string>>"))
    by_code = F.exists(codes, lambda c: c["productCode"].isin(*product_codes))
    by_name = F.coalesce(F.col("brandName").rlike(keywords), F.lit(False)) | F.coalesce(F.col("deviceDescription").rlike(keywords), F.lit(False))
    return raw.filter(F.coalesce(by_code, F.lit(False)) | by_name).select(
        F.col("publicDeviceRecordKey").alias("record_key"), F.col("brandName").alias("brand"), F.col("versionModelNumber").alias("model_number"), F.col("catalogNumber").alias("catalog_number"),
        F.col("companyName").alias("company"), F.col("deviceDescription").alias("description"), F.col("deviceCommDistributionStatus").alias("status"), F.col("identifiers.identifier").alias("identifiers"),
        F.col("gmdnTerms.gmdn.gmdnPTName").alias("terms"), codes.alias("product_codes"), F.col("deviceSizes.deviceSize").alias("sizes"),
    )


_COUNT = "array<struct<units:string,counts:array<struct<groupId:string,value:string>>>>"
_CLASSES = "array<struct<title:string,categories:array<struct<title:string,measurements:array<struct<groupId:string,value:string>>>>>>"
TRIAL_SCHEMA = (
    "protocolSection struct<identificationModule:struct<nctId:string,briefTitle:string>>, resultsSection struct<outcomeMeasuresModule:struct<outcomeMeasures:array<struct<"
    f"title:string,description:string,timeFrame:string,unitOfMeasure:string,paramType:string,groups:array<struct<id:string,title:string>>,denoms:{_COUNT},classes:{_CLASSES}>>>>"
)


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRIAL_SCHEMA).option("multiLine", True).json(path)


def flatten_outcomes(trials: DataFrame, relevant: str, strict: str) -> DataFrame:
    """One row per outcome, class, category and measurement, with arm and denominator looked up by group."""
    about = F.concat_ws(" ", F.coalesce("o.title", F.lit("")), F.coalesce("o.description", F.lit("")))
    o = trials.select(F.col("protocolSection.identificationModule.nctId").alias("nct_id"), F.col("protocolSection.identificationModule.briefTitle").alias("study_title"), F.explode("resultsSection.outcomeMeasuresModule.outcomeMeasures").alias("o")).filter(about.rlike(relevant))
    arms = F.map_from_entries(F.transform("o.groups", lambda g: F.struct(g["id"], g["title"])))
    counts = F.map_from_entries(F.flatten(F.transform("o.denoms", lambda d: F.transform(d["counts"], lambda c: F.struct(c["groupId"], c["value"])))))
    rows = o.withColumn("arms", arms).withColumn("counts", counts).withColumn("durability_related", about.rlike(strict)).withColumn("c", F.explode("o.classes")).withColumn("k", F.explode("c.categories")).withColumn("m", F.explode("k.measurements"))
    return rows.select(
        "nct_id", "study_title", F.coalesce(F.try_element_at("arms", F.col("m.groupId")), F.col("m.groupId")).alias("arm"), F.col("o.title").alias("outcome_title"), F.substring("o.description", 1, 500).alias("outcome_description"), F.col("o.timeFrame").alias("time_frame"),
        F.col("m.value").alias("value"), F.col("o.unitOfMeasure").alias("unit"), F.coalesce(F.try_element_at("counts", F.col("m.groupId")), F.lit("")).alias("n_analysed"), F.col("o.paramType").alias("result_type"), F.col("k.title").alias("category"), "durability_related",
    )


def roll_up_devices(records: DataFrame, brands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(models, aliases): registry records grouped under the first matching brand pattern.

    ``brands``: model, pattern, priority, route, design_class. Sizes come from the size value, else the size text, else the
    description. Confidence is high with sizes and a route, moderate with one of them, else low.
    """
    patterns = [(r["model"], r["pattern"]) for r in brands.orderBy("priority", "model").collect()]
    text = F.concat_ws(" ", "brand", "description", "model_number")
    names = records.sparkSession.createDataFrame([(i, m) for i, (m, _) in enumerate(patterns)], "__i int, model string")
    numbered = records.withColumn("__i", F.get(matching(text, [p for _, p in patterns], first_only=True), 0))
    records = numbered.join(broadcast_if_small(names, name="brands"), "__i", "left").drop("__i")
    number = lambda c: F.try_to_number(c, F.lit("99")).cast("int")
    plausible = lambda a: F.filter(a, lambda s: s.between(17, 34))
    from_value = plausible(F.transform(F.coalesce("sizes", F.array().cast(_SIZE)), lambda s: number(s["size"]["_value"])))
    from_text = plausible(F.transform(F.coalesce("sizes", F.array().cast(_SIZE)), lambda s: F.regexp_extract(F.coalesce(s["sizeText"], F.lit("")), r"(\d{2})\s*mm", 1).try_cast("int")))
    from_description = plausible(F.array(F.regexp_extract(F.coalesce("description", F.lit("")), r"(\d{2})\s*mm", 1).try_cast("int")))
    size = F.when(F.size(from_value) > 0, from_value).when(F.size(from_text) > 0, from_text).otherwise(from_description)
    named = records.filter("model is not null").withColumn("size", size)
    joined = lambda c: F.concat_ws(";", F.array_sort(F.collect_set(c)))
    rolled = named.groupBy("model").agg(joined("brand").alias("brands"), joined("model_number").alias("model_numbers"), joined("company").alias("manufacturers"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("size")))).alias("sizes"), F.count("*").alias("n_records"))
    table = brands.select("model", "route", "design_class").distinct().join(rolled, "model", "full_outer")
    known = F.coalesce(F.size("sizes") > 0, F.lit(False)).cast("int") + F.col("route").isNotNull().cast("int")
    models = table.withColumn("sizes_mm", F.concat_ws(";", F.transform("sizes", lambda s: s.cast("string")))).withColumn("confidence", F.when(known == 2, "high").when(known == 1, "moderate").otherwise("low")).drop("sizes")
    aliases = named.select("model", F.col("brand").alias("alias"), F.lit("registry_brand").alias("alias_type")).distinct()
    return models, aliases
