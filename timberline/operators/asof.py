"""Joins in time: the reference study, values as of a date, exposure intervals, proximity, step functions.

Every operator joins on the patient first; what follows is bounded by one patient's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from timberline.functions import rules
from timberline.operators.staging import broadcast_if_small, equal_keys, last_before
from timberline.schema import DAYS_PER_YEAR, parse_date

DAY = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))


def normalise_studies(studies: DataFrame, location: str = "location", grade: str = "ar_grade", date: str = "date", seq: str = "seq") -> DataFrame:
    """Studies of the prosthetic valve with a date: the grade becomes an ordinal ``ar``, dates are parsed, rows keep their
    input order in ``seq``. Without a location column every study counts as prosthetic."""
    kept = studies.filter(F.col(location) == "prosthetic") if location in studies.columns else studies
    kind = dict(studies.dtypes)[date]
    day = parse_date(F.col(date)) if kind == "string" else F.col(date).cast("date")
    out = kept.withColumn(date, day).filter(F.col(date).isNotNull())
    if grade in studies.columns:
        out = out.withColumn("ar", rules.regurgitation_grade(F.col(grade))).drop(grade)
    return out.drop(*([location] if location in studies.columns else []))


def select_reference(studies: DataFrame, patients: DataFrame, window: tuple[int, int] = (30, 180), patient: str = "patient_id", seq: str = "seq") -> DataFrame:
    """The first adequate study (gradient, and area or index) in the window after implantation, by date then input order."""
    days = F.datediff("date", "implant_date")
    adequate = F.col("mean_gradient").isNotNull() & (F.col("eoa").isNotNull() | F.col("dvi").isNotNull())
    fields = [c for c in studies.columns if c != patient]
    found = (
        studies.join(patients.select(patient, "implant_date"), patient)
        .filter(days.between(*window) & adequate)
        .groupBy(patient)
        .agg(F.min_by(F.struct(*fields), F.struct("date", seq)).alias("ref"))
    )
    return found.select(patient, *(F.col(f"ref.{c}").alias(f"ref_{c}") for c in fields))


def latest_as_of(points: DataFrame, values: DataFrame, analytes: list[str], patient: str = "patient_id", at: str = "landmark_date", seq: str = "seq") -> DataFrame:
    """For each point, the latest value of each analyte dated on or before it (ties: last in input order).

    One union and one window sorted by patient and day, instead of a join that pairs every point with every value.
    """
    day = DAY(F.col(at))
    wanted = points.select(patient, F.col(at)).distinct()
    marks = wanted.select(patient, day.alias("__d"), F.lit(1).alias("__kind"), F.lit(None).cast("long").alias("__s"), F.lit(None).cast("string").alias("__a"), F.lit(None).cast("double").alias("__v"))
    rows = values.filter(F.col("analyte").isin(analytes)).select(patient, DAY(F.col("date")).alias("__d"), F.lit(0).alias("__kind"), F.col(seq).cast("long").alias("__s"), F.col("analyte").alias("__a"), F.col("value").cast("double").alias("__v"))
    order = Window.partitionBy(patient).orderBy("__d", "__kind", "__s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = marks.unionByName(rows)
    for a in analytes:
        filled = filled.withColumn(a, F.last(F.when(F.col("__a") == a, F.struct(F.col("__v").alias("value"), F.col("__d").alias("day"))), ignorenulls=True).over(order))
    found = filled.filter("__kind = 1").select(F.col(patient).alias("__p"), F.col("__d").alias("__day"), *(F.col(a) for a in analytes))
    joined = points.join(found, (F.col(patient) == F.col("__p")) & (day == F.col("__day")), "left")
    return joined.select(*points.columns, *(F.col(f"{a}.value").alias(a) for a in analytes), *(F.col(f"{a}.day").alias(f"{a}_day") for a in analytes))


def carry_forward(value: Column, day: Column, at: Column, months: float = 12.0) -> Column:
    """struct(raw, log_value, age_months, stale): a positive value counts for ``months``, its raw value is kept."""
    age = (DAY(at) - day) / DAYS_PER_YEAR * 12
    positive = F.when(value > 0, value)
    return F.struct(positive.alias("raw"), F.when(age <= months, F.log(positive)).alias("log_value"), F.when(positive.isNotNull(), age).alias("age_months"), F.when(positive.isNotNull(), age > months).alias("stale"))


def slope_as_of(points: DataFrame, values: DataFrame, analyte: str, out: str, least_span: float = 0.5, patient: str = "patient_id", at: str = "landmark_date") -> DataFrame:
    """OLS slope per year of an analyte up to each point: at least two values over ``least_span`` years. One window sorted by
    patient and day keeps the regression's running moments."""
    marks = points.select(F.col(patient).alias("__q"), F.col(at).alias("__at")).distinct().select("__q", "__at", DAY(F.col("__at")).alias("__d"), F.lit(1).alias("__kind"), F.lit(None).cast("double").alias("__v"))
    one = values.filter((F.col("analyte") == analyte) & F.col("value").isNotNull() & F.col("date").isNotNull())
    one = one.select(F.col(patient).alias("__q"), F.lit(None).cast(dict(points.dtypes)[at]).alias("__at"), DAY(F.col("date")).alias("__d"), F.lit(0).alias("__kind"), F.col("value").cast("double").alias("__v"))
    upto = Window.partitionBy("__q").orderBy("__d", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t, v = F.col("__d") / DAYS_PER_YEAR, F.col("__v")
    own = F.when(F.col("__kind") == 0, t)
    gate = (F.count(v).over(upto) >= 2) & (F.max(own).over(upto) - F.min(own).over(upto) >= least_span)
    run = marks.unionByName(one).select("__q", "__at", "__kind", F.when(gate, F.regr_slope(v, own).over(upto)).alias(out)).filter("__kind = 1")
    return points.join(run.drop("__kind"), (F.col(patient) == F.col("__q")) & (F.col(at) == F.col("__at")), "left").drop("__q", "__at")


#: What an episode's class tells, one bit each.
_FLAGS = ("dapt", "plate", "oac", "vka", "late")


def _flag_bits() -> Column:
    oac, kind = F.col("class").isin(*rules.OAC), F.col("class")
    flags = dict(zip(_FLAGS, (kind == "DAPT", kind.isin("SAPT", "DAPT"), oac, kind == "VKA", oac & F.col("post_suspicion")), strict=True))
    return sum((F.coalesce(c, F.lit(False)).cast("int") * (1 << i) for i, c in enumerate(flags.values())), F.lit(0))


def _exposures_upto(upto: WindowSpec) -> list[Column]:
    """Running features over rows of a day ``__d``, a sign ``__sign`` (-1 ends and 1 starts an episode) and flags ``__bits``."""
    sign = F.col("__sign").cast("long")
    real = sign.isin(-1, 1) & F.col("__d").isNotNull()
    flag = {k: F.shiftright("__bits", i).bitwiseAND(F.lit(1)) for i, k in enumerate(_FLAGS)}
    active = lambda k: F.coalesce(F.sum(F.when(real, sign * flag[k])).over(upto), F.lit(0))
    # days lived up to d: of those in use, d less their starts; of those ended, end less start
    lived = lambda k: active(k) * F.col("__d") - F.coalesce(F.sum(F.when(real, sign * flag[k] * F.col("__d"))).over(upto), F.lit(0))
    ever = lambda k: F.coalesce(F.max(F.when(real & (sign > 0), flag[k])).over(upto), F.lit(0)) > 0
    years = lambda k: F.round(lived(k) / DAYS_PER_YEAR, 3)
    return [
        (active("dapt") > 0).alias("__dapt"), (active("plate") > 0).alias("on_antiplatelet"), ever("oac").alias("__ever"), years("vka").alias("ac_cum_vka_years"), years("oac").alias("ac_cum_oac_years"),
        (F.col("__d") - F.max(F.when(real, F.col("__d"))).over(upto)).cast("double").alias("ac_days_since_change"), ever("late").alias("ac_post_suspicion"),
    ]


def _exposure_in_use(first: str) -> dict[str, Column]:
    """Features of the first anticoagulant in use, struct(class, indication) or NULL."""
    return {
        "ac_class_current": F.coalesce(f"{first}.class", F.when(F.col("__dapt"), "DAPT").when(F.col("on_antiplatelet"), "SAPT").otherwise("none")),
        "ac_indication": F.coalesce(f"{first}.indication", F.lit("none")),
        "ac_current_status": F.when(F.col(first).isNotNull(), "current").when(F.col("__ever"), "past").otherwise("never"),
    }


def exposure_features(points: DataFrame, exposures: DataFrame, patient: str = "patient_id", at: str = "landmark_date", seq: str = "seq") -> DataFrame:
    """Antithrombotic features at each point. A patient without any record gets NULL, not "none".

    Starts, ends and points are merged in one window sorted by patient and day, where counts, days lived and last changes are
    running sums and maxima. Only the class in use needs its episode; episodes meet points by patient and year, so pairs follow
    the episodes that overlap a point's year and not all a patient ever had.
    """
    oac = F.col("class").isin(*rules.OAC)
    start, stop = DAY(F.col("start_date")), DAY(F.col("stop_date"))
    marks = points.select(F.col(patient).alias("__q"), F.col(at).alias("__at")).distinct()
    # the flags travel as bits of one number, and a row's day and sign tell the rest
    episodes = exposures.select(F.col(patient).alias("__q"), start.alias("__s"), F.when(stop.isNotNull(), F.greatest(start, stop)).alias("__e"), F.col(seq).alias("__seq"), "class", "indication", _flag_bits().alias("__bits"))
    # a day's ends (-1) and starts (1) come before its points (2); an episode without a start only tells that there is a record
    row = lambda d, s, b: ("__q", d.alias("__d"), F.lit(s).cast("byte").alias("__sign"), b.alias("__bits"))
    begun = episodes.select(*row(F.col("__s"), 1, F.col("__bits")))
    ended = episodes.filter("__s is not null and __e is not null").select(*row(F.col("__e"), -1, F.col("__bits")))
    asked = marks.select(*row(DAY(F.col("__at")), 2, F.lit(0)))
    whole = Window.partitionBy("__q")
    point = F.col("__sign") == 2
    upto = whole.orderBy(F.asc_nulls_first("__d"), "__sign").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = begun.unionByName(ended).unionByName(asked).withColumn("__has", F.min("__sign").over(whole) < 2)
    run = merged.select("__q", "__d", "__sign", "__has", *_exposures_upto(upto)).filter(point & F.col("__has"))
    # the first episode in input order of those in use, by patient and year
    span = marks.groupBy("__q").agg(F.min(DAY(F.col("__at"))).alias("__lo"), F.max(DAY(F.col("__at"))).alias("__hi"))
    used = episodes.filter(oac & F.col("__s").isNotNull()).join(span, "__q").filter("__s <= __hi and (__e is null or __e > __lo)")
    year = lambda d: F.floor(d / F.lit(366))
    used = used.withColumn("__y", F.explode(F.sequence(year(F.greatest("__s", "__lo")), year(F.least(F.coalesce("__e", "__hi"), "__hi")))))
    in_use = (F.col("__s") <= F.col("__m")) & (F.col("__e").isNull() | (F.col("__e") > F.col("__m")))
    asked = marks.select(F.col("__q"), DAY(F.col("__at")).alias("__m"), year(DAY(F.col("__at"))).alias("__y"))
    # input order may leave two episodes at one place: class and indication then decide, so that every run gives the same
    first = asked.join(used.select("__q", "__y", "__s", "__e", "__seq", "class", "indication"), ["__q", "__y"]).filter(in_use).groupBy("__q", "__m").agg(F.min(F.struct("__seq", "class", "indication")).alias("__first"))
    found = run.join(first.withColumnsRenamed({"__q": "__p", "__m": "__n"}), (F.col("__q") == F.col("__p")) & (F.col("__d") == F.col("__n")), "left")
    found = found.withColumns(_exposure_in_use("__first")).drop("__first", "__dapt", "__ever", "__sign", "__has", "__p", "__n")
    return points.join(found, (F.col(patient) == F.col("__q")) & (DAY(F.col(at)) == F.col("__d")), "left").drop("__q", "__d")


def history_features(points: DataFrame, tables: Sequence[DataFrame], analytes: list[str], slopes: Mapping[str, str], least_span: float = 0.5, patient: str = "patient_id", at: str = "landmark_date", seq: str = "seq") -> DataFrame:
    """What :func:`latest_as_of` (values alone), :func:`slope_as_of` (``slopes``: column by analyte) and :func:`exposure_features`
    add to the points, in one pass. ``tables``: values, episodes, or rows that hold one of each side by side.

    Points with all they carry and the tables' rows are dealt by patient once; values, starts and ends part only there. One sort by
    patient and day serves all windows, and the first anticoagulant in use follows in that order from a heap of a patient's
    episodes in use. So no table is joined by patient and day, and wide rows travel once.
    """
    key = (F.col(patient).alias("__q"), F.col(seq).cast("long").alias("__seq"))
    asked = points.select(key[0], F.struct(*points.columns).alias("__r"), DAY(F.col(at)).alias("__day"))

    def value() -> dict[str, Column]:
        return {"__day": F.when(F.col("analyte").isin(*analytes, *slopes), DAY(F.col("date"))), "__name": F.col("analyte"), "__v": F.col("value").cast("double")}

    def episode() -> dict[str, Column]:
        # of an anticoagulant the bits also hold its class
        start, stop, kind = DAY(F.col("start_date")), DAY(F.col("stop_date")), F.coalesce(F.array_position(F.array(*(F.lit(c) for c in rules.OAC)), F.col("class")), F.lit(0))
        return {"__s": start, "__e": F.when(stop.isNotNull(), F.greatest(start, stop)), "__bits": (_flag_bits() + kind * (1 << len(_FLAGS))).cast("int"), "__use": F.when(kind > 0, F.col("indication"))}

    held = [(value() if "analyte" in t.columns else {}) | (episode() if "start_date" in t.columns else {}) for t in tables]
    # more and smaller parts than a shuffle's, as the tables are sorted together
    parts = 4 * int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = asked.select("*", *(F.lit(None).cast(k).alias(n) for n, k in (("__seq", "long"), ("__name", "string"), ("__v", "double"), ("__s", "int"), ("__e", "int"), ("__bits", "int"), ("__use", "string"))))
    for t, own in zip(tables, held, strict=True):
        dealt = dealt.unionByName(t.filter(F.col(patient).isNotNull()).select(*key, *(c.alias(n) for n, c in own.items())), allowMissingColumns=True)
    dealt = dealt.repartition(parts, "__q")
    place = lambda on, d, sign: F.when(on, F.struct(F.col(d).alias("__d"), F.lit(sign).cast("byte").alias("__sign")))
    known = lambda c: F.col(c).isNotNull()
    places = [place(known("__r"), "__day", 2), place(~known("__r") & known("__day"), "__day", 0), place(known("__bits"), "__s", 1), place(known("__bits") & known("__s") & known("__e"), "__e", -1)]
    rows = dealt.select("*", F.inline(F.array(*places))).filter("__sign is not null")
    rows = rows.select("__q", "__d", "__sign", "__seq", F.when(F.col("__sign") == 1, F.col("__e")).alias("__e"), "__bits", F.when(F.col("__sign") == 0, F.col("__name")).when(F.col("__sign") == 1, F.col("__use")).alias("__name"), F.when(F.col("__sign") == 0, F.col("__v")).alias("__v"), "__r")
    # a day's ends (-1), values (0) and starts (1) come before its points (2); an episode without a start only tells that there is a record
    order = [F.asc_nulls_first("__d"), F.asc("__sign"), F.asc("__seq")]
    in_order = Window.partitionBy("__q").orderBy(*order)
    upto, whole = (in_order.rowsBetween(Window.unboundedPreceding, to) for to in (Window.currentRow, Window.unboundedFollowing))
    sign = F.col("__sign")
    of = lambda a: (sign == 0) & (F.col("__name") == a)
    latest = [F.last(F.when(of(a), F.struct("__v")), ignorenulls=True).over(upto)["__v"].alias(a) for a in analytes]

    def slope(a: str) -> Column:
        known = of(a) & F.col("__v").isNotNull()
        t, v = F.when(known, F.col("__d") / DAYS_PER_YEAR), F.when(known, F.col("__v"))
        gate = (F.count(v).over(upto) >= 2) & (F.max(t).over(upto) - F.min(t).over(upto) >= least_span)
        return F.when(gate, F.regr_slope(v, t).over(upto))

    added = [*latest, *(slope(a).alias(c) for a, c in slopes.items()), *_exposures_upto(upto)]
    has = F.max(F.when(sign.isin(-1, 1), True)).over(whole).alias("__has")
    carried = ["__q", "__d", "__sign", "__seq", "__e", "__bits", "__name"]
    run = rows.select(*carried, "__r", has, *added)
    run = run.filter((sign == 2) | ((sign == 1) & F.col("__d").isNotNull() & (F.shiftright("__bits", len(_FLAGS)) > 0))).sortWithinPartitions("__q", *order)
    kept = [f for f in run.schema.fields if f.name not in (*carried, "__r")]
    schema = StructType([*points.schema.fields, *kept, StructField("__class", StringType()), StructField("__indication", StringType())])
    found = run.mapInArrow(_first_in_use(len(carried), schema.names), schema)
    found = found.withColumn("__first", F.when(F.col("__class").isNotNull(), F.struct(F.col("__class").alias("class"), F.col("__indication").alias("indication")))).withColumns(_exposure_in_use("__first"))
    own = ["on_antiplatelet", "ac_cum_vka_years", "ac_cum_oac_years", "ac_days_since_change", "ac_post_suspicion", "ac_class_current", "ac_indication", "ac_current_status"]
    return found.select(*points.columns, *analytes, *slopes.values(), *(F.when(F.col("__has"), F.col(c)).alias(c) for c in own))


def _first_in_use(n_carried: int, names: list[str]) -> Callable[[Iterator], Iterator]:
    """Over rows in the order of patient and day: the points, with the first anticoagulant in use at each. Days do not fall, so
    an episode that has ended at the top of the heap is done with."""

    def run(batches: Iterator) -> Iterator:
        import heapq

        import pyarrow as pa

        held, heap = None, []
        for batch in batches:
            at, found = [], []
            for i, (q, d, sign, seq, end, bits, indication) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(n_carried)), strict=True)):
                if q != held:
                    held, heap = q, []
                if sign == 1:
                    heapq.heappush(heap, (seq is not None, seq, rules.OAC[(bits >> len(_FLAGS)) - 1], indication is not None, indication or "", float("inf") if end is None else end))
                    continue
                while heap and d is not None and heap[0][5] <= d:
                    heapq.heappop(heap)
                at.append(i)
                found.append((heap[0][2], heap[0][4] if heap[0][3] else None) if heap else (None, None))
            own = batch.take(pa.array(at, pa.int32()))
            texts = (pa.array([f[k] for f in found], pa.string()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*own.column(n_carried).flatten(), *own.columns[n_carried + 1 :], *texts], names=names)

    return run


def comparator_pairs(studies: DataFrame, patients: DataFrame, requests: DataFrame, fresh_days: int = 548, patient: str = "patient_id", seq: str = "seq") -> DataFrame:
    """Per request (patient, prediction_date): the reference, the latest study on or before the date, and whether it is
    fresh; then the comparator's verdict."""
    reference = select_reference(studies, patients, patient=patient, seq=seq)
    fields = [c for c in studies.columns if c != patient]
    # one sort per patient: each request carries the last study before it, the day's own included
    asked = requests.select(F.col(patient).alias("__p"), F.col("prediction_date").alias("__d"), F.lit(1).alias("__kind"), F.lit(None).cast("long").alias("__s"), F.lit(None).cast(studies.select(F.struct(*fields)).dtypes[0][1]).alias("__study"), F.struct(*requests.columns).alias("__r"))
    seen = studies.select(F.col(patient).alias("__p"), F.col("date").alias("__d"), F.lit(0).alias("__kind"), F.col(seq).cast("long").alias("__s"), F.struct(*fields).alias("__study"), F.lit(None).cast(asked.dtypes[-1][1]).alias("__r"))
    upto = Window.partitionBy("__p").orderBy("__d", "__kind", "__s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = seen.unionByName(asked).withColumn("cur", F.last("__study", ignorenulls=True).over(upto)).filter("__kind = 1")
    current = merged.select("__r.*", *(F.col(f"cur.{c}").alias(f"cur_{c}") for c in fields))
    pairs = current.join(reference, patient, "left").withColumn("fresh", F.datediff("prediction_date", "cur_date") <= fresh_days)
    none = F.lit(None)
    cur, ref = ((lambda n, p=p: none.cast("string") if n == "valve_id" else F.col(f"{p}_{n}")) for p in ("cur", "ref"))
    context = {"prediction_date": F.col("prediction_date"), "valve_id": none.cast("string"), "ar_confirmed": F.lit(True), "fresh": F.col("fresh")}
    return pairs.withColumn("verdict", F.when(F.col("ref_date").isNotNull() & F.col("cur_date").isNotNull(), rules.comparator(cur, ref, context.__getitem__)))


#: Other names of a study's values in tables that hold both studies of a request side by side.
STUDY_ALIASES = {
    "mean_gradient": ("mean_gradient", "mean_gradient_mmhg", "gradient"), "eoa": ("eoa", "eoa_cm2"), "dvi": ("dvi",), "ar": ("ar", "ar_ordinal"), "date": ("date", "study_date"),
    "lvef": ("lvef", "lvef_pct"), "svi": ("svi", "svi_ml_m2"), "valve_id": ("valve_id", "index_valve_id"),
}


def comparator_rows(rows: DataFrame, at: str = "prediction_date", fresh_days: int = 548, out: str = "verdict") -> DataFrame:
    """The comparator over a table with columns ``reference_*`` and ``current_*`` under any of their names; input columns stay.
    Of several names of one value the first that is present and not null counts."""

    def side(prefix: str):
        def value(name: str) -> Column:
            found = [F.col(f"{prefix}_{a}") for a in STUDY_ALIASES.get(name, (name,)) if f"{prefix}_{a}" in rows.columns]
            empty = F.lit(None).cast("string" if name == "valve_id" else "date" if name == "date" else "double")
            return F.coalesce(*found) if found else empty

        return value

    current, reference = side("current"), side("reference")
    fresh = F.datediff(at, current("date")) <= fresh_days
    context = {"prediction_date": F.col(at), "valve_id": F.lit(None).cast("string"), "ar_confirmed": F.lit(True), "fresh": fresh}
    return rows.withColumn(out, F.when(reference("date").isNotNull() & current("date").isNotNull(), rules.comparator(current, reference, context.__getitem__)))


def step_lookup(rows: DataFrame, at: Column, knots: DataFrame, group: list[str], before: float, strict: bool = False, time: str = "time", value: str = "value", out: str = "looked_up") -> DataFrame:
    """Value of a step function at the last knot on or before ``at`` (strictly before, with ``strict``); ``before`` earlier.

    The distinct times asked for are merged with the knots by one sort (:func:`last_before`), and the answers meet the rows by
    equality: broadcast behind a check of their number, by hash beyond it.
    """
    keyed = rows.withColumn("__at", at.cast("double") + 0.0)
    asked = keyed.select(*group, F.col("__at").alias("__t")).distinct()
    steps = knots.select(*group, F.col(time).cast("double").alias("__t"), F.col(value).alias("__value"))
    answers = last_before(asked, steps, group, "__t", "__value", "__found", strict).select(*(F.col(g).alias(f"__{g}") for g in group), "__t", "__found")
    on = F.col("__at").eqNullSafe(F.col("__t")) & equal_keys(group, [f"__{g}" for g in group])
    found = keyed.join(broadcast_if_small(answers, name="steps"), on, "left")
    return found.withColumn(out, F.coalesce("__found", F.lit(before))).drop("__at", "__t", "__found", *(f"__{g}" for g in group))
