"""Clinical notes to observations: hits with spans and context, device matches, events, one observation per class, and the
per-patient device record.

Scans that need only a yes or no are native expressions. Hits that need their place in the text come from one vectorised
function over the note column; everything after it is DataFrame work.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from timberline.operators.patterns import matching, pattern_set
from timberline.operators.resample import seeded
from timberline.operators.staging import broadcast_if_small

# Patterns that decide what counts as a mention.
TRANSCATHETER = r"(?i)transcatheter aortic valve|\bTAVR\b|\bTAVI\b|sapien|evolut|corevalve|corevalue"
SURGICAL = r"(?i)aortic valve replacement with|\bAVR\b\s*\(?#|sternotomy|bioprosthesis via|tissue implant type|replacement type: tissue"
SIZE_PATTERNS = (
    r"(?i)#\s?(\d{2})(?:\s?-?\s?mm)?\s?(?:trifecta|magna|perimount|CE\b|inspiris|konect|valve|bioprosth)",
    r"(?i)(\d{2})\s?-?\s?mm\s+(?:trifecta|magna|perimount|inspiris|edwards|sapien|evolut|bioprosthesis|valve)",
    r"(?i)implant size:\s*(\d{2})",
    r"(?i)size:\s*(?:ultra\s*|R)?(\d{2})\s?mm",
    r"(?i)size #\s?(\d{2})",
    r"(?i)\(#(\d{2})\)",
    r"(?i)\bR\s?(\d{2})\s?mm\b",
)
NUMERIC_PATTERNS = (
    ("gradient", 0.0, 120.0, r"mean gradient (?:is|of|was|=)?\s*(\d{1,3})\s*mm\s?hg"),
    ("gradient", 0.0, 120.0, r"peak/mean gradients?\s*(?:of|were|was|:)?\s*\d{1,3}/(\d{1,3})"),
    ("gradient", 0.0, 120.0, r"gradients?:?\s*(?:of\s*)?\d{1,3}/(\d{1,3})\s*mm\s?hg"),
    ("gradient", 0.0, 120.0, r"\bMG\s*(?:of|is|=)?\s*(\d{1,3})\s*mm"),
    ("gradient", 0.0, 120.0, r"mean (?:PG|pressure gradient)[^0-9]{0,12}(\d{1,3})"),
    ("dvi", 0.05, 1.2, r"dimensionless (?:valve )?index(?:\s*\(DVI\))?\s*(?:is|of|was|=|:)?\s*(0?\.\d{1,2})"),
    ("dvi", 0.05, 1.2, r"\bDVI\b\s*(?:is|of|was|=|:)?\s*(0?\.\d{1,2})"),
    ("dvi", 0.05, 1.2, r"dimensionless velocity index\s*(?:is|of|was|=|:)?\s*(0?\.\d{1,2})"),
    ("eoa", 0.2, 6.0, r"(?:effective orifice area|EOA)\s*(?:\([^)]{0,20}\))?\s*(?:is|of|was|=|:)?\s*(\d\.\d{1,2})\s*cm"),
    ("eoa", 0.2, 6.0, r"(?:aortic valve area|AVA)\s*(?:is|of|was|=|:)?\s*(\d\.\d{1,2})\s*cm"),
    ("eoa", 0.2, 6.0, r"valve area\s*(?:is|of|was|=|:)?\s*(\d\.\d{1,2})\s*cm"),
    ("lvef", 5.0, 90.0, r"(?:LVEF|ejection fraction|\bEF\b)\s*(?:is|of|=|:)?\s*(?:approximately|about|~)?\s*(\d{2})\s*%"),
    ("velocity", 0.5, 8.0, r"(?:peak|maximum|max)\s+(?:aortic\s+)?(?:jet\s+)?velocity\s*(?:is|of|=|:)?\s*(\d(?:\.\d{1,2})?)\s*m/s"),
)
_GRADE_WORD = r"(none|trivial|trace|mild(?:-to-moderate)?|moderate(?:-to-severe)?|severe)"
GRADE_PATTERNS = (
    _GRADE_WORD + r"\s*(?:central|paravalvular|transvalvular|intraprosthetic|prosthetic|aortic)?\s*(?:regurgitation|insufficiency|\bAR\b)",
    r"(?:regurgitation|insufficiency|\bAR\b)\s*(?:is|was|:|grade)?\s*" + _GRADE_WORD,
)
GRADE_NUMBER_PATTERNS = (r"\bAR\b\s*(?:is|was|grade|:)?\s*([1-4])\s?\+", r"(?:regurgitation|insufficiency)\s*(?:is|was|grade|:)?\s*([1-4])\s?\+")
NOTE_GRADES = {"none": 0, "trivial": 0, "trace": 1, "mild": 1, "mild-to-moderate": 2, "moderate": 2, "moderate-to-severe": 3, "severe": 4}
EVENT_PATTERNS = {
    "valve_in_valve": r"(?i)valve[- ]in[- ]valve|\bViV\b",
    "redo": r"(?i)\bredo\b",
    "dysfunction": r"(?i)structural valve deterioration|\bSVD\b|prosthetic (?:aortic )?valve (?:dysfunction|failure|stenosis|regurgitation)|bioprosthetic (?:AVR|aortic valve|valve) (?:stenosis|dysfunction|failure|degeneration)|prosthetic thickening|degenerat\w+ (?:bio)?prosth|T82\.0|failed (?:bio)?prosth",
    "endocarditis": r"(?i)endocarditis",
    "thrombosis": r"(?i)valve thromb|leaflet thromb|\bHALT\b",
}
NEGATED_FIELDS = r"(?i)Valve\s+in\s+Valve\s*:\s*(?:No|None|N/?A)\b|Reoperation\s*:\s*No previous surgeries|Reoperation\s*:\s*No\b"
PROSTHETIC_CONTEXT = r"(?i)prosthe|bioprosth|TAVR|TAVI|AVR|implant"
NATIVE_CONTEXT = r"(?i)native"
DEVICE_CONTEXT = r"(?i)valve|bioprosth|porcine|pericardial|stent|tissue implant|prosthesis|prosthetic|\d{2}\s?mm|supra\b|transcatheter|TAVR|TAVI|implant"
RECORD_CONTEXT = r"(?i)documented in|reviewed in|per epic|in epic\b|epic (?:chart|flowsheet|record|system|note)|chart review"
BEFORE, AFTER, NEARBY = 260, 60, 100
PRESCREEN = r"(?i)bioprosth|prosthetic (?:aortic )?valve|aortic valve replacement|\bTAVR\b|\bTAVI\b|\bSAVR\b|\bAVR\b|transcatheter aortic|valve[- ]in[- ]valve|tissue (?:valve|implant)"
IMPLANT_YEAR = r"(?:implant\w*|placed|replacement|\bTAVR\b|\bTAVI\b|\bAVR\b|\bSAVR\b)[^.\n]{0,60}?\b(?:in|on|since|from)\s+(?:\d{1,2}/\d{1,2}/)?((?:19|20)\d{2})\b"

HIT = {"field": StringType(), "value": DoubleType(), "word": StringType(), "start": IntegerType(), "end": IntegerType(), "prosthetic": BooleanType(), "native": BooleanType()}


def prepare_notes(notes: DataFrame, patient: str = "patient_id", date: str = "note_date", seq: str = "seq", status: str = "status") -> DataFrame:
    """Drop deleted notes and number the rest per patient by date, then input order."""
    kept = notes.filter(~F.coalesce(F.col(status) == "Deleted", F.lit(False)))
    index = F.row_number().over(Window.partitionBy(patient).orderBy(date, seq)) - 1
    return kept.withColumn("note_index", index).withColumn("note_ref", F.concat_ws("_", F.col(patient).cast("string"), F.col("note_index").cast("string")))


def _hit_finder() -> Callable[[str | None], list[tuple]]:
    """All numeric and grade hits of a note with their span and the prosthetic or native context around them."""
    rules = [(f, lo, hi, p, "number") for f, lo, hi, p in NUMERIC_PATTERNS]
    rules += [("regurgitation", 0.0, 4.0, p, "word") for p in GRADE_PATTERNS]
    rules += [("regurgitation", 0.0, 4.0, p, "grade") for p in GRADE_NUMBER_PATTERNS]
    expressions = tuple(p for *_, p, _ in rules)
    near, native, thick = re.compile(PROSTHETIC_CONTEXT), re.compile(NATIVE_CONTEXT), re.compile("prosthetic thick", re.IGNORECASE)
    grades = dict(NOTE_GRADES)

    def hits(note: str | None) -> list[tuple]:
        out = []
        known = pattern_set(expressions)
        for i in known.candidates(note or ""):
            field, lo, hi, _, kind = rules[i]
            for m in known.compiled(i).finditer(note or ""):
                word = m[1].lower()
                value = float(grades[word]) if kind == "word" else float(m[1])
                if lo <= value <= hi:
                    around = note[max(0, m.start() - BEFORE) : m.end() + AFTER]
                    out.append((field, value, word if kind == "word" else f"{word}+" if kind == "grade" else None, m.start(), m.end(), bool(near.search(around)), bool(native.search(around)) and not thick.search(around)))
        return out

    return hits


def hits_table(notes: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """One row per hit. Notes that mention no prosthesis, gradient, index, area or grade are screened out natively first. Hits leave
    Python as flat columns, which costs less than a nested value per note."""
    screened = notes.filter(F.col(text).rlike(r"(?i)gradient|\bMG\b|mean PG|DVI|dimensionless|EOA|orifice|valve area|AVA|LVEF|\bEF\b|ejection|velocity|regurgitation|insufficiency|\bAR\b"))
    kept = screened.select(*keep, F.col(text).alias("__text"))
    hits = _hit_finder()

    def run(batches: Iterator) -> Iterator:
        types = (pa.string(), pa.float64(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_())
        for batch in batches:
            at, found = [], []
            for i, note in enumerate(batch.column(len(keep)).to_pylist()):
                own = hits(note)
                found += own
                at += [i] * len(own)
            flat = list(zip(*found, strict=True)) if found else [()] * len(types)
            rows = pa.array(at, pa.int32())
            columns = [batch.column(i).take(rows) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, t) for c, t in zip(flat, types, strict=True))], names=[*keep, *HIT])

    schema = StructType([*kept.schema.fields[:-1], *(StructField(n, t) for n, t in HIT.items())])
    return kept.mapInArrow(run, schema)


def note_flags(notes: DataFrame, text: str = "text") -> DataFrame:
    """Route flags, sizes in 17-34 and event flags (mentions inside negated fields do not count), natively."""
    t = F.coalesce(F.col(text), F.lit(""))
    sizes = F.flatten(F.array(*(F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in SIZE_PATTERNS)))
    sizes = F.array_sort(F.array_distinct(F.filter(F.transform(sizes, lambda s: s.cast("int")), lambda s: s.between(17, 34))))
    positive = F.regexp_replace(t, NEGATED_FIELDS, " ")
    out = notes.withColumn("transcatheter", t.rlike(TRANSCATHETER)).withColumn("surgical", t.rlike(SURGICAL)).withColumn("sizes", sizes).withColumn("prosthesis", t.rlike(PRESCREEN))
    for name, pattern in EVENT_PATTERNS.items():
        out = out.withColumn(f"event_{name}", positive.rlike(pattern))
    return out


def device_matches(notes: DataFrame, aliases: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """(keep..., model): models whose patterns a note holds. ``aliases``: model, pattern, guarded. A guarded pattern needs device
    words, and no record-system words, within 100 characters of one of its matches.

    The aliases are a reference table of any length: one automaton scans a note for all of them.
    """
    listed = [(r["model"], r["pattern"], bool(r["guarded"])) for r in aliases.select("model", "pattern", "guarded").orderBy("model", "pattern").collect()]
    guarded = [g for _, _, g in listed]
    device, record = re.compile(DEVICE_CONTEXT), re.compile(RECORD_CONTEXT)

    def accept(i: int, note: str, m: re.Match) -> bool:
        around = note[max(0, m.start() - NEARBY) : m.end() + NEARBY]
        return not guarded[i] or (bool(device.search(around)) and not record.search(around))

    names = notes.sparkSession.createDataFrame([(i, m) for i, (m, _, _) in enumerate(listed)], "__i int, model string")
    found = notes.select(*keep, F.explode(matching(F.coalesce(F.col(text), F.lit("")), [p for _, p, _ in listed], accept)).alias("__i"))
    return found.join(broadcast_if_small(names, name="models"), "__i").select(*keep, "model").distinct()


def most_specific(models: Column) -> Column:
    """The longest name, ties in alphabetical order, of an array of names."""
    ordered = F.array_sort(F.transform(models, lambda m: F.struct((-F.length(m)).alias("n"), m.alias("m"))))
    return F.get(ordered, 0)["m"]


def observations(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per note and class (prosthetic, native, uncertain): the first hit of each field. Ejection fraction and velocity
    belong to the note: every class but native has them, and a note with nothing else is uncertain."""
    cls = F.when(F.col("prosthetic") & ~F.col("native"), "prosthetic").when(F.col("native") & ~F.col("prosthetic"), "native").otherwise("uncertain")
    classes, fields, shared = ("prosthetic", "native", "uncertain"), ("gradient", "dvi", "eoa", "regurgitation"), ("lvef", "velocity")

    def first(which: Column) -> Column:
        return F.min_by(F.when(which, F.col("value")), F.when(which, F.struct("start", "end")))

    # one aggregation: hits come from a scan of the texts, which a join of classes and notes would repeat
    own = hits.withColumn("__c", F.when(~F.col("field").isin(*shared), cls))
    sums = [first((F.col("__c") == c) & (F.col("field") == f)).alias(f"__{c}_{f}") for c in classes for f in fields]
    note = own.groupBy(*keys).agg(*sums, *(first(F.col("field") == f).alias(f) for f in shared), *(F.coalesce(F.bool_or(F.col("__c") == c), F.lit(False)).alias(f"__{c}") for c in classes))
    alone = ~(F.col("__prosthetic") | F.col("__native") | F.col("__uncertain"))
    there = {c: F.col(f"__{c}") | alone if c == "uncertain" else F.col(f"__{c}") for c in classes}
    taken = lambda c, f: (F.col(f) if c != "native" else F.lit(None).cast("double")).alias(f)
    value = lambda c, f: F.col(f"__{c}_{f}").alias(f)
    each = [F.when(there[c], F.struct(F.lit(c).alias("class"), *(value(c, f) for f in fields[:3]), *(taken(c, f) for f in shared), value(c, fields[3]))) for c in classes]
    out = note.select(*keys, F.inline(F.array_compact(F.array(*each))))
    return out.filter(F.coalesce(*(F.col(c) for c in (*fields, *shared))).isNotNull())


SPAN = "array<struct<field:string,value:string,start:int,end:int>>"


def spans(text: Column, patterns: Sequence[tuple[str, str, int]]) -> Column:
    """Every match of ``(field, pattern, group)`` with its place: the group's text, and the span of the whole match."""
    fields, groups, expressions = [f for f, _, _ in patterns], [g for _, _, g in patterns], tuple(p for _, p, _ in patterns)

    @F.arrow_udf(SPAN)
    def find(notes: pa.Array) -> pa.Array:
        known = pattern_set(expressions)
        offsets, number, value, start, end = [0], [], [], [], []
        for text_or_null in notes.to_pylist():
            note = text_or_null or ""
            for i in known.candidates(note):
                for m in known.compiled(i).finditer(note):
                    number.append(i)
                    value.append(m[groups[i]])
                    start.append(m.start())
                    end.append(m.end())
            offsets.append(len(number))
        hits = [pa.array(fields, pa.string()).take(pa.array(number, pa.int32())), pa.array(value, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(hits, names=["field", "value", "start", "end"]))

    return find(text)


def extract_passports(notes: DataFrame, aliases: DataFrame, devices: DataFrame, keep: Sequence[str], text: str = "text", near: int = 80) -> DataFrame:
    """One row per note: route, model, size and implant year with confidences, evidence spans, events and warnings.

    ``notes`` has columns type and year; ``aliases`` model, pattern, guarded; ``devices`` model, route. Confidences are fixed:
    route 0.9 or 0.85 from an implant note, 0.7 from the device, 0.5 from a mention; model 0.9, guarded 0.75; size 0.8 within
    ``near`` characters of the device name, 0.6 farther, 0.5 without one.
    """
    listed = [(r["model"], r["pattern"], bool(r["guarded"])) for r in aliases.select("model", "pattern", "guarded").orderBy("model", "pattern").collect()]
    plain = lambda p: p.removeprefix("(?i)")
    wanted = [("transcatheter", plain(TRANSCATHETER), 0), ("surgical", plain(SURGICAL), 0), ("implant_year", IMPLANT_YEAR, 1), ("negated", plain(NEGATED_FIELDS), 0)]
    wanted += [("size", plain(p), 1) for p in SIZE_PATTERNS] + [(f"event:{n}", plain(p), 0) for n, p in EVENT_PATTERNS.items()]
    wanted += [(f"model:{int(g)}:{m}", p, 0) for m, p, g in listed]
    t = F.coalesce(F.col(text), F.lit(""))
    n = notes.select(*keep, "type", "year", t.alias("__t"), spans(t, wanted).alias("__h"))
    of = lambda prefix: F.filter("__h", lambda h: h["field"].startswith(prefix))
    place = lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"))
    first = lambda a: F.get(F.array_sort(F.transform(a, place)), 0)
    around = lambda h: F.substr(F.col("__t"), F.greatest(h["start"] - NEARBY, F.lit(0)) + 1, h["end"] - h["start"] + 2 * NEARBY)
    usable = F.filter(of("model:"), lambda h: (F.substring(h["field"], 7, 1) == "0") | (around(h).rlike(DEVICE_CONTEXT) & ~around(h).rlike(RECORD_CONTEXT)))
    named = F.transform(usable, lambda h: F.struct((-F.length(F.substring(h["field"], 9, 1000))).alias("n"), F.substring(h["field"], 9, 1000).alias("model"), (F.substring(h["field"], 7, 1) == "1").alias("guarded"), h["start"].alias("start"), h["end"].alias("end")))
    n = n.withColumn("__m", F.get(F.array_sort(named), 0)).withColumn("__all", F.array_sort(F.array_distinct(F.transform(named, lambda m: m["model"]))))
    n = n.withColumn("__tc", first(of("transcatheter"))).withColumn("__sg", first(of("surgical"))).withColumn("__year", F.get(F.array_sort(F.transform(of("implant_year"), lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), h["value"].alias("value")))), 0))
    sizes = F.filter(F.transform(of("size"), lambda h: F.struct(h["value"].cast("int").alias("mm"), h["start"].alias("start"), h["end"].alias("end"))), lambda h: h["mm"].between(17, 34))
    by_distance = F.transform(sizes, lambda h: F.struct(F.coalesce(F.abs(h["start"] - F.col("__m.start")), F.lit(0)).alias("away"), h["start"].alias("start"), h["mm"].alias("mm"), h["end"].alias("end")))
    n = n.withColumn("__s", F.get(F.array_sort(by_distance), 0)).withColumn("__sizes", F.array_distinct(F.transform(sizes, lambda h: h["mm"])))
    negated = of("negated")
    events = F.filter(of("event:"), lambda h: ~F.exists(negated, lambda x: (h["start"] >= x["start"]) & (h["start"] < x["end"])))
    n = n.withColumn("__e", events)
    device = broadcast_if_small(devices.groupBy(F.col("model").alias("__d")).agg(F.first("route", ignorenulls=True).alias("__dr")), name="devices")
    n = n.join(device, F.col("__m.model") == F.col("__d"), "left")
    known = F.when(F.col("__dr").isin("SAVR", "TAVR"), F.col("__dr"))
    implant = F.col("type").isin("Operative Report", "Procedures")
    mention = F.when(F.col("__tc").isNotNull(), "TAVR").when(F.col("__sg").isNotNull(), "SAVR")
    route = F.when(implant & mention.isNotNull(), mention).otherwise(F.coalesce(known, mention, F.lit("unknown")))
    sure = F.when(implant & mention.isNotNull(), F.when(mention == "TAVR", 0.9).otherwise(0.85)).when(known.isNotNull(), 0.7).when(mention.isNotNull(), 0.5).otherwise(0.0)
    size_sure = F.when(F.col("__s").isNull(), 0.0).when(F.col("__m").isNull(), 0.5).when(F.col("__s.away") <= near, 0.8).otherwise(0.6)
    piece = lambda field, h: F.when(h.isNotNull(), F.struct(F.lit(field).alias("field"), h["start"].alias("start"), h["end"].alias("end")))
    route_span = F.when((implant & mention.isNotNull()) | known.isNull(), F.coalesce("__tc", "__sg"))
    evidence = F.array_compact(F.array(piece("canonical_model", F.col("__m")), piece("route", route_span), piece("size_mm", F.col("__s")), piece("implant_year", F.when(~(implant & mention.isNotNull()), F.col("__year")))))
    evidence = F.concat(evidence, F.transform("__e", lambda h: F.struct(h["field"].alias("field"), h["start"].alias("start"), h["end"].alias("end"))))
    warnings = F.array_compact(F.array(F.when(known.isNotNull() & (route != "unknown") & (known != route), "route_differs_from_device"), F.when(F.size("__sizes") > 1, "more_than_one_size")))
    year = F.when(implant & (route != "unknown"), F.col("year")).otherwise(F.col("__year.value").cast("int"))
    return n.select(
        *keep, route.alias("route"), F.col("__m.model").alias("canonical_model"), F.col("__s.mm").alias("size_mm"), year.alias("implant_year"), sure.alias("route_confidence"),
        F.when(F.col("__m").isNull(), 0.0).when(F.col("__m.guarded"), 0.75).otherwise(0.9).alias("model_confidence"), size_sure.alias("size_confidence"), F.col("__all").alias("models_mentioned"),
        F.array_sort(F.array_distinct(F.transform("__e", lambda h: F.substring(h["field"], 7, 1000)))).alias("events"), evidence.alias("evidence"), warnings.alias("warnings"),
    )


def passport(notes: DataFrame, hits: DataFrame, models: DataFrame, patient: str = "patient_id") -> DataFrame:
    """Per patient: route, first implant year, most specific model, size, prosthetic gradients and event flags.

    ``notes`` come from :func:`note_flags` with columns year and type; ``models`` from :func:`device_matches` with note_ref.
    """
    n = notes.withColumn("implant_note", F.col("type").isin("Operative Report", "Procedures") & (F.col("transcatheter") | F.col("surgical")))
    i = F.col("implant_note")
    any_ = lambda c: F.bool_or(c)
    own = n.groupBy(patient).agg(
        F.count("*").alias("n_notes"), F.min("year").alias("first_note_year"), F.max("year").alias("last_note_year"), any_(i).alias("__i"),
        any_(i & F.col("transcatheter")).alias("__t"), any_(i & F.col("surgical") & ~F.col("transcatheter")).alias("__s"), any_(F.col("transcatheter") | F.col("surgical")).alias("__h"),
        F.min(F.when(i, F.col("year"))).alias("implant_year"),
        F.min(F.when(i, F.get("sizes", F.lit(0)))).alias("__is"), F.min(F.get("sizes", F.lit(0))).alias("__as"),
        *(any_(F.col(f"event_{e}")).alias(f"event_{e}") for e in EVENT_PATTERNS),
    )
    route = F.when(F.col("__t") & F.col("__s"), "TAVR+SAVR").when(F.col("__t"), "TAVR").when(F.col("__s"), "SAVR").when(~F.col("__i") & F.col("__h"), "(hist only)").otherwise("")
    named = models.join(n.select("note_ref", "implant_note"), "note_ref").groupBy(patient).agg(F.collect_set("model").alias("__all"), F.collect_set(F.when(F.col("implant_note"), F.col("model"))).alias("__implant"))
    clear = F.col("prosthetic") & ~F.col("native") & (F.col("field") == "gradient")
    g = hits.groupBy(patient).agg(F.sum(clear.cast("long")).alias("n_gradients_prosthetic"), F.countDistinct(F.when(clear, F.col("year"))).alias("n_gradient_years_prosthetic"), F.max(F.when(clear, F.col("value"))).alias("max_gradient_prosthetic"))
    model = F.when(F.size("__implant") > 0, most_specific(F.col("__implant"))).otherwise(most_specific(F.col("__all")))
    out = own.join(named, patient, "left").join(g, patient, "left")
    return out.select(
        patient, "n_notes", "first_note_year", "last_note_year", route.alias("route"), "implant_year", F.coalesce(model, F.lit("")).alias("canonical_model"), F.coalesce("__is", "__as").alias("size_mm"),
        F.coalesce("n_gradients_prosthetic", F.lit(0)).alias("n_gradients_prosthetic"), F.coalesce("n_gradient_years_prosthetic", F.lit(0)).alias("n_gradient_years_prosthetic"), "max_gradient_prosthetic", *(f"event_{e}" for e in EVENT_PATTERNS),
    )


def note_outcomes(records: DataFrame, failures: DataFrame, patient: str = "patient_id") -> DataFrame:
    """Years from the implant to the first later year with a failure mention, else censored at the last note; only records
    with one unambiguous route and an implant year."""
    first = failures.join(records.select(F.col(patient).alias("__p"), F.col("implant_year").alias("__y")), (F.col(patient) == F.col("__p")) & (F.col("year") > F.col("__y"))).groupBy(patient).agg(F.min("year").alias("fail_year"))
    eligible = records.filter(F.col("implant_year").isNotNull() & F.col("route").isin("TAVR", "SAVR") & (F.col("last_note_year") > F.col("implant_year")))
    end = F.coalesce("fail_year", "last_note_year")
    return eligible.join(first, patient, "left").select(patient, "route", (end - F.col("implant_year")).cast("double").alias("time"), F.col("fail_year").isNotNull().cast("int").alias("event"))


def note_outcome_exclusions(records: DataFrame) -> DataFrame:
    """(reason, n): why records have no note outcome, one reason a record in fixed order; also those kept."""
    reason = (
        F.when(F.col("route").isNull() | ~F.col("route").isin("TAVR", "SAVR"), "route_not_unambiguous")
        .when(F.col("implant_year").isNull(), "no_implant_year")
        .when(~F.coalesce(F.col("last_note_year") > F.col("implant_year"), F.lit(False)), "no_later_note")
        .otherwise("kept")
    )
    counts = records.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
    every = records.sparkSession.createDataFrame([(r,) for r in ("route_not_unambiguous", "no_implant_year", "no_later_note", "kept")], "reason string")
    return every.join(counts, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("n"))


def merge_extractions(rules: DataFrame, other: DataFrame, fields: Sequence[str], key: str = "note_ref", events: str | None = None, text: str | None = None) -> DataFrame:
    """Rules first: gaps are filled, agreement raises confidence to 0.95 at least, a conflict keeps the rule with a warning.
    Both tables have a value and ``<field>_confidence`` per field.

    With ``events`` (arrays of struct(type, quote)) the rules' events stay and the other table's are added where the rules have
    none of the type. With ``text`` (a column of ``rules``) a quote, of an event or of a filled field (``<field>_quote``), must be
    found in the note: its span is kept, and what is not found is left out with a warning.
    """
    quoted = [f for f in fields if f"{f}_quote" in other.columns] if text else []
    o = other.select(F.col(key).alias("__k"), *(F.col(f).alias(f"__{f}") for f in fields), *(F.col(f"{f}_confidence").alias(f"__{f}_confidence") for f in fields), *(F.col(f"{f}_quote").alias(f"__{f}_quote") for f in quoted), *([F.col(events).alias("__events")] if events else []))
    own = rules.withColumnRenamed(events, "__mine") if events else rules
    j = own.join(o, F.col(key) == F.col("__k"), "full_outer")
    out = [F.coalesce(key, "__k").alias(key)]
    warnings = []
    for f in fields:
        same = F.col(f) == F.col(f"__{f}")
        there, span = F.lit(True), None
        if f in quoted:
            span = locate_quote(F.col(text), F.col(f"__{f}_quote"))
            there = F.col(f"__{f}_quote").isNull() | span.isNotNull()
            warnings.append(F.when(F.col(f).isNull() & F.col(f"__{f}").isNotNull() & ~there, F.lit(f"quote_not_found:{f}")))
        filled = F.when(there, F.col(f"__{f}"))
        sure = F.when(F.col(f).isNull(), F.when(there, F.col(f"__{f}_confidence"))).when(same, F.greatest(F.col(f"{f}_confidence"), F.col(f"__{f}_confidence"), F.lit(0.95))).otherwise(F.col(f"{f}_confidence"))
        out += [F.coalesce(F.col(f), filled).alias(f), sure.alias(f"{f}_confidence")]
        if span is not None:
            out.append(F.when(F.col(f).isNull() & F.col(f"__{f}").isNotNull(), span).alias(f"{f}_span"))
        warnings.append(F.when(~same, F.lit(f"conflict:{f}")))
    if events:
        mine, theirs = (F.coalesce(c, F.array().cast("array<struct<type:string,quote:string>>")) for c in ("__mine", "__events"))
        new = F.filter(theirs, lambda e: ~F.exists(mine, lambda x: x["type"] == e["type"]))
        if text:
            located = lambda e: F.struct(e["type"].alias("type"), e["quote"].alias("quote"), locate_quote(F.col(text), e["quote"]).alias("span"))
            mine, new = F.transform(mine, located), F.transform(new, located)
            missing = F.transform(F.filter(new, lambda e: e["span"].isNull()), lambda e: F.concat(F.lit("quote_not_found:event:"), e["type"]))
            new = F.filter(new, lambda e: e["span"].isNotNull())
        else:
            missing = F.array().cast("array<string>")
        out.append(F.concat(mine, new).alias(events))
        return j.select(*out, F.concat(F.array_compact(F.array(*warnings)), missing).alias("warnings"))
    return j.select(*out, F.array_compact(F.array(*warnings)).alias("warnings"))


def locate_quote(text: Column, quote: Column) -> Column:
    """struct(start, end) of a quote, exactly or without regard to case; NULL if absent."""
    at = F.position(quote, text)
    any_case = F.position(F.lower(quote), F.lower(text))
    start = F.when(at > 0, at).when(any_case > 0, any_case) - 1
    return F.when(start.isNotNull(), F.struct(start.alias("start"), (start + F.length(quote)).alias("end")))


def audit_sample(rows: DataFrame, stratum: str, sizes: dict[str, int], fields: Sequence[str], seed: int = 0, key: str = "note_ref") -> DataFrame:
    """A seeded sample per stratum, one row per field to check. The largest size is a limit that Spark applies in every task before
    rows of a stratum meet."""
    most = max(sizes.values(), default=0)
    n = F.lit(0)
    for level, size in sizes.items():
        n = F.when(F.col(stratum) == level, size).otherwise(n)
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(seeded(seed, F.col(key)), key))
    first = rows.withColumn("__r", rank).filter(F.col("__r") <= most)
    return first.filter(F.col("__r") <= n).select(key, stratum, F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))))


def privacy_scan(rows: DataFrame, identifier: str = r"\b[A-Z]{1,3}\d{6,}\b", source_names: Sequence[str] = ("patient", "mrn", "name", "birth"), narrative: str = r"(?i)\b(?:patient|history|presents|denies|reports)\b", longest: int = 600) -> DataFrame:
    """(column, finding, n): identifier-like cells, long narrative cells, and column names of source tables; one pass."""
    text = [c for c, t in rows.dtypes if t == "string"]
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    parts = []
    for c in text:
        parts.append(F.struct(F.lit(c).alias("column"), F.lit("identifier").alias("finding"), n(F.col(c).rlike(identifier)).alias("n")))
        parts.append(F.struct(F.lit(c).alias("column"), F.lit("long_narrative").alias("finding"), n((F.length(c) > longest) & F.col(c).rlike(narrative)).alias("n")))
    named = [F.struct(F.lit(c).alias("column"), F.lit("source_column").alias("finding"), F.lit(1).cast("long").alias("n")) for c in rows.columns if any(s in c.lower() for s in source_names)]
    return rows.agg(F.array(*parts, *named).alias("x")).select(F.inline("x")).filter("n > 0")
