"""Views that bind the test tables to the roles of a cohort.

A customer is a patient, an order a study, a line item a laboratory value and an exposure episode. Values follow from keys
and prices by plain arithmetic, so the same text runs as Spark SQL and as the SQL the results are held to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PATIENTS = """
select c.c_custkey as patient_id, case when c.c_custkey % 2 = 0 then 'TAVR' else 'SAVR' end as route, c.c_mktsegment as design_class,
       o.first_date - 90 as implant_date, cast(15 + c.c_custkey % 8 as double) / 10 as bsa, cast(60 + c.c_custkey % 30 as double) as age_at_implant,
       case when c.c_custkey % 9 = 0 then cast(null as double) else cast(20 + c.c_custkey % 17 as double) end as bmi,
       case when c.c_custkey % 3 = 0 then 'F' else 'M' end as sex, cast(19 + 2 * (c.c_custkey % 6) as int) as size_mm
from customer c join (select o_custkey, min(cast(o_orderdate as date)) as first_date from orders group by o_custkey) o on c.c_custkey = o.o_custkey
"""

STUDIES = """
select o_custkey as patient_id, cast(o_orderdate as date) as date, o_orderkey as seq,
       case when o_orderkey % 11 = 0 then cast(null as double) else cast(8 + o_orderkey * 7 % 29 as double) end as mean_gradient,
       case when o_orderkey % 5 = 0 then cast(null as double) else cast(8 + o_orderkey % 13 as double) / 10 end as eoa,
       case when o_orderkey % 7 = 0 then cast(null as double) else cast(20 + o_orderkey * 3 % 41 as double) / 100 end as dvi,
       case o_orderpriority when '1-URGENT' then 3 when '2-HIGH' then 2 when '3-MEDIUM' then 1 when '4-NOT SPECIFIED' then cast(null as int) else 0 end as ar,
       cast(40 + o_orderkey % 31 as double) as lvef, cast(25 + o_orderkey % 19 as double) as svi
from orders
"""

LABS = """
select o.o_custkey as patient_id, cast(l.l_shipdate as date) as date, l.l_orderkey * 10000 + l.l_partkey * 10 + l.l_linenumber as seq,
       case l.l_returnflag when 'A' then 'egfr' when 'N' then 'hb' else 'ldh' end as analyte, l.l_quantity as value
from lineitem l join orders o on l.l_orderkey = o.o_orderkey
"""

EXPOSURES = """
select o.o_custkey as patient_id, l.l_orderkey * 10000 + l.l_partkey * 10 + l.l_linenumber as seq,
       case l.l_partkey % 6 when 0 then 'VKA' when 1 then 'FXa' when 2 then 'DTI' when 3 then 'SAPT' when 4 then 'DAPT' else 'none' end as class,
       case l.l_suppkey % 7 when 0 then 'suspected_valve_thrombosis' when 1 then 'af' else 'routine' end as indication,
       least(cast(o.o_orderdate as date), cast(l.l_shipdate as date)) as start_date,
       case when l.l_linenumber % 4 = 0 then cast(null as date) else greatest(cast(o.o_orderdate as date), cast(l.l_shipdate as date)) end as stop_date,
       l.l_discount > 0.07 as post_suspicion
from lineitem l join orders o on l.l_orderkey = o.o_orderkey
"""

#: Laboratory values and exposure episodes side by side, as every line item gives one of each: one join for both.
HISTORY = LABS.rsplit("\nfrom", 1)[0] + "," + EXPOSURES.split(" as seq,", 1)[1]

TERMINAL = """
select o_custkey as patient_id, max(cast(o_orderdate as date)) + 30 as end_followup_date,
       case when o_custkey % 10 < 3 then max(cast(o_orderdate as date)) + 10 end as death_date,
       case when o_custkey % 10 = 5 then max(cast(o_orderdate as date)) - 20 end as replacement_date,
       case when o_custkey % 10 = 7 then max(cast(o_orderdate as date)) - 200 end as first_thrombosis_date
from orders group by o_custkey
"""

MECHANISM = """
select o_custkey as patient_id, case when o_orderkey % 2 = 0 then 'endocarditis' else 'thrombosis' end as type, cast(o_orderdate as date) + 15 as date
from orders where o_orderkey % 17 = 0
"""

#: Survival rows: one per order; time to the customer's last order in years, cause from the order's status.
SURVIVAL = """
select o.o_orderkey as row_id, o.o_custkey as patient_id, case when o.o_custkey % 2 = 0 then 'TAVR' else 'SAVR' end as route,
       case when o.o_orderdate = m.last_date then 1 else round((epoch_days(m.last_date) - epoch_days(o.o_orderdate)) / 365.25, 6) end as time,
       case o.o_orderstatus when 'F' then 1 when 'P' then 2 else 0 end as event,
       (1 + o.o_orderkey * 37 % 997) / 1000.0 as pred, (1 + o.o_orderkey * 53 % 887) / 1000.0 as pred2,
       cast(o.o_custkey % 10 as double) as valve_age_years
from orders o join (select o_custkey, max(o_orderdate) as last_date from orders group by o_custkey) m on o.o_custkey = m.o_custkey
"""

#: A note per order, written from its keys.
NOTES = """
select o_custkey as patient_id, o_orderkey as seq, cast(o_orderdate as date) as note_date, cast(year(o_orderdate) as int) as year,
       case when o_orderkey % 4 < 2 then 'Operative Report' else 'Progress Notes' end as type, case when o_orderkey % 23 = 0 then 'Deleted' else 'Signed' end as status,
       case o_orderkey % 4 when 0 then 'Transcatheter aortic valve SAPIEN 3 implanted, implant size: 2' || cast(o_orderkey % 10 as string) || '. ' when 1 then 'Sternotomy. Magna Ease prosthesis, size #2' || cast(o_orderkey % 9 as string) || '. ' else '' end
       || 'Prosthetic valve: mean gradient is ' || cast(o_orderkey * 7 % 60 as string) || ' mmHg, DVI 0.' || cast(10 + o_orderkey % 80 as string) || ', EOA 1.' || cast(o_orderkey % 10 as string) || ' cm2, '
       || case o_orderkey % 3 when 0 then 'moderate' when 1 then 'trace' else 'severe' end || ' aortic regurgitation.'
       || case o_orderkey % 9 when 0 then ' Valve in Valve: No.' when 1 then ' Prior valve-in-valve.' else '' end || case when o_orderkey % 13 = 0 then ' Treated for endocarditis.' else '' end as text
from orders
"""

#: Research observations: line items as dated records whose parent is the record half as far back.
OBSERVATIONS = """
select cast(o.o_custkey as string) as person_id, o.o_custkey * 10000 + r.k as record_id, case when r.k > 1 then o.o_custkey * 10000 + r.k div 2 end as parent_id,
       case when o.o_orderkey % 19 = 0 then 'placeholder' when o.o_orderkey % 3 = 0 then 'derived' else 'observed' end as value_origin,
       case o.o_orderkey % 2 when 0 then 'gradient' else 'area' end as variable, cast(5 + o.o_orderkey * 11 % 37 as double) as value, cast(null as string) as value_text,
       cast(cast(o.o_orderdate as date) as string) as date, 'day' as date_precision, case when o.o_orderkey % 29 = 0 then 'exact_duplicate' else 'unique' end as duplicate_status, o.o_orderkey % 31 = 0 as suppressed
from orders o join (select o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as k from orders) r on o.o_orderkey = r.o_orderkey
"""

SPARK_DAYS = ("epoch_days(m.last_date) - epoch_days(o.o_orderdate)", "datediff(m.last_date, o.o_orderdate)")
DUCK_DAYS = (SPARK_DAYS[0], "datediff('day', o.o_orderdate, m.last_date)")

ROLES = {"patients": PATIENTS, "studies": STUDIES, "labs": LABS, "exposures": EXPOSURES, "history": HISTORY, "terminal": TERMINAL, "mechanism": MECHANISM, "surv": SURVIVAL, "notes": NOTES, "obs": OBSERVATIONS}
_READS = {"patients": ("customer", "orders"), "studies": ("orders",), "labs": ("lineitem", "orders"), "exposures": ("lineitem", "orders"), "history": ("lineitem", "orders"), "terminal": ("orders",), "mechanism": ("orders",), "surv": ("orders",), "notes": ("orders",), "obs": ("orders",)}


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A role as a DataFrame over the tables of a folder."""
    text = ROLES[name].replace("/ 1000.0", "/ 1000D").replace("/ 365.25", "/ 365.25D").replace(*SPARK_DAYS)
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _READS[name]}
    for t in frames:
        text = text.replace(f"from {t})", f"from {{{t}}})").replace(f"from {t} ", f"from {{{t}}} ").replace(f"join {t} ", f"join {{{t}}} ").replace(f"from {t}\n", f"from {{{t}}}\n")
    return spark.sql(text, **frames)


def with_roles(*names: str) -> str:
    """The roles as common table expressions of a SQL text."""
    return "with " + ",\n".join(f"{n} as ({ROLES[n].replace(*DUCK_DAYS).replace('/ 1000.0', '/ 1000.0::double').replace('/ 365.25', '/ 365.25::double').replace(' div ', ' // ')})" for n in names)
