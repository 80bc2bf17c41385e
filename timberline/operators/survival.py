"""Survival estimators on distinct-time tables.

Counts per group and time are aggregated first. The table of times is dealt by ranges of (group, time); windows run within a
range, and what a range begins with (numbers at risk, survival, incidence, hazard) is combined from one row per earlier range
and group. So neither a group nor the number of its distinct times is bounded by a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.operators.asof import step_lookup
from timberline.operators.staging import carried, ranged, within

TIME_TOL = 1e-9


def time_table(rows: DataFrame, group: Sequence[str], time: str = "time", event: str = "event", causes: Sequence[int] = (1, 2, 3), weight: str | None = None) -> DataFrame:
    """Per group and distinct time: at_risk, d (events of any cause), c (censored) and d<k> per cause. ``__part`` numbers the
    range of (group, time) a row lies in."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    # -0.0 would be a distinct group key from 0.0
    t = F.col(time) + F.lit(0.0)
    add = lambda condition: F.sum(F.when(condition, w).otherwise(0.0))
    counts = rows.groupBy(*group, t.alias("time")).agg(F.sum(w).alias("n"), add(F.col(event) != 0).alias("d"), add(F.col(event) == 0).alias("c"), *(add(F.col(event) == k).alias(f"d{k}") for k in causes))
    return _at_risk(ranged(counts, group, "time"), group, "n").drop("n")


def _at_risk(table: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Adds ``at_risk``: the sum of ``value`` at this time and later ones, in the row's range and in later ranges."""
    totals = table.groupBy(*group, "__part").agg(F.sum(value).alias("__t"))
    own = table.withColumn("__own", F.sum(value).over(within(group, "time", backward=True)))
    out = carried(own, totals, group, {"__after": lambda w: F.coalesce(F.sum("__t").over(w), F.lit(0.0))}, backward=True)
    return out.withColumn("at_risk", F.col("__own") + F.col("__after")).drop("__own", "__after")


def kaplan_meier(rows: DataFrame, group: Sequence[str] = (), time: str = "time", event: str = "event", of: str = "d") -> DataFrame:
    """Steps (group, time, at_risk, d, survival). ``of="c"`` estimates the censoring distribution.

    A range of times multiplies its own factors; the products of a group's earlier ranges are handed over.
    """
    table = time_table(rows, group, time, event).filter(F.col(of) > 0).withColumn("__f", 1 - F.col(of) / F.col("at_risk"))
    totals = table.groupBy(*group, "__part").agg(F.product("__f").alias("__t"))
    own = table.withColumn("__own", F.product("__f").over(within(group, "time")))
    out = carried(own, totals, group, {"__before": lambda w: F.coalesce(F.product("__t").over(w), F.lit(1.0))})
    return out.select(*group, "time", "at_risk", F.col(of).alias("d"), (F.col("__before") * F.col("__own")).alias("survival"))


def aalen_johansen(rows: DataFrame, group: Sequence[str] = (), causes: Sequence[int] = (1, 2, 3), time: str = "time", event: str = "event", weight: str | None = None) -> DataFrame:
    """Steps (group, time, survival, cif<k>): cumulative incidence per cause and the event-free probability.

    A range of times sums itself up as its survival factor S and its incidence F from survival 1; ranges combine as
    (S1, F1)(S2, F2) = (S1 S2, F1 + S1 F2), so what a range begins with follows from the sums of the earlier ones.
    """
    table = time_table(rows, group, time, event, causes, weight).filter(F.col("d") > 0).withColumn("__f", 1 - F.col("d") / F.col("at_risk"))
    upto = within(group, "time")
    first = F.coalesce(F.product("__f").over(within(group, "time", before=True)), F.lit(1.0))
    table = table.withColumn("__s", F.product("__f").over(upto)).withColumns({f"__i{k}": first * F.col(f"d{k}") / F.col("at_risk") for k in causes})
    totals = table.groupBy(*group, "__part").agg(F.product("__f").alias("__ts"), *(F.sum(f"__i{k}").alias(f"__t{k}") for k in causes))
    carries = {"__bs": lambda w: F.coalesce(F.product("__ts").over(w), F.lit(1.0))}
    carries |= {f"__b{k}": (lambda w, k=k: F.coalesce(F.sum(F.col("__bs") * F.col(f"__t{k}")).over(w), F.lit(0.0))) for k in causes}
    out = carried(table.withColumns({f"__c{k}": F.sum(f"__i{k}").over(upto) for k in causes}), totals, group, carries)
    return out.select(*group, "time", (F.col("__bs") * F.col("__s")).alias("survival"), *((F.col(f"__b{k}") + F.col("__bs") * F.col(f"__c{k}")).alias(f"cif{k}") for k in causes))


def at_horizons(curve: DataFrame, group: Sequence[str], horizons: Sequence[float], groups: DataFrame, causes: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Curve values at horizons for every row of ``groups``; before the first step survival is 1 and incidence 0."""
    points = groups.select(*group).distinct().select("*", F.explode(F.array(*(F.lit(float(h)) for h in horizons))).alias("horizon"))
    c = curve.select(*(F.col(g).alias(f"__{g}") for g in group), *(x for x in curve.columns if x not in group))
    on = F.col("time") <= F.col("horizon")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__{g}"))
    last = points.join(c, on, "left").groupBy(*group, "horizon").agg(F.max_by(F.struct("survival", *(f"cif{k}" for k in causes)), "time").alias("x"))
    return last.select(*group, "horizon", F.coalesce("x.survival", F.lit(1.0)).alias("survival"), *(F.coalesce(f"x.cif{k}", F.lit(0.0)).alias(f"cif{k}") for k in causes))


def nelson_aalen(rows: DataFrame, group: Sequence[str] = (), risk: str | None = None, cause: int | None = None, time: str = "time", event: str = "event") -> DataFrame:
    """Breslow cumulative baseline (group, time, cumulative_hazard), with optional risk scores."""
    w = F.lit(1.0) if risk is None else F.col(risk)
    hit = (F.col(event) != 0) if cause is None else (F.col(event) == cause)
    table = rows.groupBy(*group, (F.col(time) + F.lit(0.0)).alias("time")).agg(F.sum(w).alias("w"), F.sum(hit.cast("double")).alias("d"))
    table = _at_risk(ranged(table, group, "time"), group, "w").filter("d > 0").withColumn("__h", F.col("d") / F.col("at_risk"))
    totals = table.groupBy(*group, "__part").agg(F.sum("__h").alias("__t"))
    own = table.withColumn("__own", F.sum("__h").over(within(group, "time")))
    out = carried(own, totals, group, {"__before": lambda w: F.coalesce(F.sum("__t").over(w), F.lit(0.0))})
    return out.select(*group, "time", (F.col("__own") + F.col("__before")).alias("cumulative_hazard"))


def followup_support(rows: DataFrame, k: int, group: Sequence[str] = (), time: str = "time") -> DataFrame:
    """The k-th largest observed time per group (0 with fewer rows), from counts per distinct time."""
    counts = rows.groupBy(*group, (F.col(time) + F.lit(0.0)).alias("time")).agg(F.count("*").alias("n"))
    seen = _at_risk(ranged(counts, group, "time"), group, "n")
    return seen.groupBy(*group).agg(F.coalesce(F.max(F.when(F.col("at_risk") >= k, F.col("time"))), F.lit(0.0)).alias("support_time"))


def event_free(time: Column, event: Column, tau: float) -> Column:
    """Followed beyond the horizon, or censored at it (administrative censoring is a control)."""
    return ((time > tau) | ((time >= tau - TIME_TOL) & (event == 0))) & ~((time <= tau) & (event != 0))


def with_ipcw(rows: DataFrame, tau: float, group: Sequence[str] = (), cause: int = 1, time: str = "time", event: str = "event", censoring: DataFrame | None = None) -> DataFrame:
    """Adds y (outcome by tau), known (status known) and w (inverse probability of censoring weight; 0 if unknown)."""
    g = censoring if censoring is not None else kaplan_meier(rows, group, time, event, of="c")
    t, e = F.col(time), F.col(event)
    had = (t <= tau) & (e != 0)
    free = event_free(t, e, tau)
    out = step_lookup(rows, F.least(t, F.lit(float(tau))), g, list(group), 1.0, strict=True, value="survival", out="__g") if time != "time" else _own_time(rows, tau, g, list(group))
    return out.withColumn("y", F.when(had & (e == cause), 1.0).otherwise(0.0)).withColumn("known", had | free).withColumn("w", F.when(F.col("known") & (F.col("__g") > 0), 1 / F.col("__g")).otherwise(0.0)).drop("__g")


def _own_time(rows: DataFrame, tau: float, g: DataFrame, group: list[str]) -> DataFrame:
    g = g.withColumnRenamed("time", "__time")
    return step_lookup(rows, F.least(F.col("time"), F.lit(float(tau))), g, group, 1.0, strict=True, time="__time", value="survival", out="__g")


def competing_frame(times: dict[int, Column], end: Column) -> Column:
    """struct(time, event): the first of the causes' times on or before the end, else censored at the end."""
    seen = F.array_compact(F.array(*(F.when(t <= end, F.struct(t.alias("time"), F.lit(k).alias("event"))) for k, t in times.items())))
    return F.coalesce(F.array_min(seen), F.struct(end.alias("time"), F.lit(0).alias("event")))


def calendar_comparator(rows: DataFrame, horizons: Sequence[float], least: int = 30, age: float = 5.0) -> DataFrame:
    """Aalen-Johansen risk per route and valve-age cell; cells under ``least`` rows fall back to the route, then to all."""
    r = rows.withColumn("cell", F.when(F.col("valve_age_years") < age, f"<{age:g}").otherwise(f">={age:g}"))
    out = r.select("route", "cell").distinct().select("*", F.explode(F.array(*(F.lit(float(h)) for h in horizons))).alias("horizon"))
    r = r.withColumn("everyone", F.lit("all"))
    out = out.withColumn("everyone", F.lit("all"))
    for i, group in enumerate((["route", "cell"], ["route"], ["everyone"])):
        curve = at_horizons(aalen_johansen(r, group), group, horizons, r).join(r.groupBy(*group).agg(F.count("*").alias("n")), group)
        enough = F.col("n") >= (0 if group == ["everyone"] else least)
        values = [F.when(enough, F.col(c)).alias(f"{c}_{i}") for c in ("cif1", "cif2", "cif3", "survival")]
        out = out.join(curve.select(*group, "horizon", *values), [*group, "horizon"], "left")
    return out.select("route", "cell", "horizon", *(F.coalesce(*(F.col(f"{c}_{i}") for i in range(3))).alias(c) for c in ("cif1", "cif2", "cif3", "survival")))
