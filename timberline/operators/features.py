"""Feature pipeline: fitted on training rows by aggregates, applied anywhere as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.operators.staging import exact_quantiles, quantile_table

#: Knot quantiles of restricted cubic splines (fixed values).
RCS_QUANTILES = {3: (0.10, 0.50, 0.90), 4: (0.05, 0.35, 0.65, 0.95), 5: (0.05, 0.275, 0.50, 0.725, 0.95)}


def rcs_basis(x: Column, knots: Sequence[float]) -> list[Column]:
    """Restricted cubic spline: x and len(knots) - 2 terms that are linear beyond the outer knots, scaled by the range."""
    t, last, before = list(knots), knots[-1], knots[-2]
    scale = (t[-1] - t[0]) ** 2
    cube = lambda k: F.pow(F.greatest(x - F.lit(float(k)), F.lit(0.0)), F.lit(3.0))
    return [x, *((cube(k) - cube(before) * (last - k) / (last - before) + cube(last) * (before - k) / (last - before)) / scale for k in t[:-2])]


def bspline_basis(x: Column, knots: Sequence[float]) -> list[Column]:
    """Cubic B-splines on quantile knots without the first basis function; constant beyond the outer knots.

    The knot vector is extended by the outer spacing, three times on each side.
    """
    t = list(map(float, knots))
    lo, hi = t[1] - t[0], t[-1] - t[-2]
    full = [t[0] - 3 * lo, t[0] - 2 * lo, t[0] - lo, *t, t[-1] + hi, t[-1] + 2 * hi, t[-1] + 3 * hi]
    v = F.greatest(F.least(x, F.lit(t[-1])), F.lit(t[0]))
    # the last interval is closed, so the basis adds up to one at the outer knot
    inner = len(full) - 5
    level = [F.when((v >= full[i]) & ((v < full[i + 1]) if i != inner else (v <= full[i + 1])), 1.0).otherwise(0.0) for i in range(len(full) - 1)]
    level = [c if i <= inner else F.lit(0.0) for i, c in enumerate(level)]
    for degree in range(1, 4):
        level = [
            (v - full[i]) / (full[i + degree] - full[i]) * level[i] + (full[i + degree + 1] - v) / (full[i + degree + 1] - full[i + 1]) * level[i + 1]
            for i in range(len(level) - 1)
        ]
    return level[1:]


@dataclass
class FeaturePipeline:
    """Median imputation with indicators, standardisation, splines, binary and one-hot features with rare levels pooled."""

    numeric: Sequence[str] = ()
    binary: Sequence[str] = ()
    categorical: Sequence[str] = ()
    spline: Sequence[str] = ()
    n_knots: int = 4
    min_frequency: int = 15
    tree: bool = False
    medians: dict[str, float] = field(default_factory=dict)
    scales: dict[str, tuple[float, float]] = field(default_factory=dict)
    gaps: set[str] = field(default_factory=set)
    knots: dict[str, list[float]] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)

    def fit(self, rows: DataFrame) -> FeaturePipeline:
        """Two passes of moments and two of quantiles for all numeric features together, one pass per categorical feature."""
        r = rows.agg(F.count("*").alias("n"), *(F.count(f).alias(f"n_{f}") for f in (*self.numeric, *self.binary))).first()
        medians = quantile_table(rows, {f: F.col(f) for f in self.numeric}, [0.5]) if self.numeric else {}
        for f in self.numeric:
            if not r[f"n_{f}"]:
                raise ValueError(f"feature {f!r} has no training value; exclude it before fitting")
            self.medians[f] = medians[f][0]
        self.gaps = {f for f in (*self.numeric, *self.binary) if r[f"n_{f}"] < r["n"]}
        filled = {f: F.coalesce(F.col(f).cast("double"), F.lit(self.medians[f])) for f in self.numeric}
        if self.numeric:
            quantiles = [i / (self.n_knots - 1) for i in range(self.n_knots)]
            parts = [x for f, v in filled.items() for x in (F.avg(v).alias(f"m_{f}"), F.stddev_pop(v).alias(f"s_{f}"))]
            parts += [F.countDistinct(filled[f]).alias(f"d_{f}") for f in self.spline]
            knots = quantile_table(rows, {f: filled[f] for f in self.spline}, quantiles) if self.spline else {}
            r = rows.agg(*parts).first()
            for f in self.numeric:
                sd = r[f"s_{f}"]
                self.scales[f] = (0.0, 1.0) if self.tree else (float(r[f"m_{f}"]), float(sd) if sd > 1e-9 else 1.0)
            for f in self.spline:
                edges = sorted(set(knots[f]))
                if not self.tree and r[f"d_{f}"] > self.n_knots + 2 and len(edges) > 1:
                    self.knots[f] = edges
        for f in self.categorical:
            level = F.coalesce(F.col(f).cast("string"), F.lit("missing"))
            counts = rows.groupBy(level.alias("level")).agg(F.count("*").alias("n"))
            common = sorted(x["level"] for x in counts.filter(F.col("n") >= self.min_frequency).collect())
            if not common:
                common = [x["level"] for x in counts.orderBy(F.desc("n"), "level").limit(1).collect()]
            others = counts.filter(~F.col("level").isin(*common)).limit(1).count() if common else 0
            self.levels[f] = [*common, "other"] if len(common) > 1 or others else common
        return self

    def columns(self) -> dict[str, Column]:
        """Output columns by name."""
        out: dict[str, Column] = {}
        for f in self.numeric:
            v = F.coalesce(F.col(f).cast("double"), F.lit(self.medians[f]))
            if f in self.knots:
                out |= {f"{f}__s{j}": b for j, b in enumerate(bspline_basis(v, self.knots[f]))}
            else:
                out[f] = (v - self.scales[f][0]) / self.scales[f][1]
            if f in self.gaps:
                out[f"{f}__missing"] = F.col(f).isNull().cast("double")
        for f in self.binary:
            out[f] = F.when(F.lower(F.col(f).cast("string")).isin("true", "1", "1.0"), 1.0).otherwise(0.0)
            if f in self.gaps:
                out[f"{f}__missing"] = F.col(f).isNull().cast("double")
        for f, levels in self.levels.items():
            level = F.coalesce(F.col(f).cast("string"), F.lit("missing"))
            mapped = F.when(level.isin(*levels), level).otherwise("other" if "other" in levels else levels[0])
            out |= {f"{f}__{x}": (mapped == x).cast("double") for x in levels}
        return out

    def transform(self, rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return rows.select(*keep, *(c.alias(n) for n, c in self.columns().items()))


def marker_eligibility(rows: DataFrame, markers: Sequence[str], least_patients: float = 0.05, least_rows: float = 0.05, patient: str = "patient_id") -> DataFrame:
    """Per marker: share of patients and rows with a value, distinct values, and why it is not eligible (NULL: it is)."""
    present = [m for m in markers if m in rows.columns]
    parts = [F.struct(F.lit(m).alias("marker"), (F.countDistinct(F.when(F.col(m).isNotNull(), F.col(patient))) / F.countDistinct(patient)).alias("patient_share"), F.avg(F.col(m).isNotNull().cast("double")).alias("row_share"), F.countDistinct(m).alias("n_distinct")) for m in present]
    found = rows.agg(F.array(*parts).alias("x")).select(F.inline("x"))
    reason = F.when(F.col("n_distinct") == 0, "absent").when((F.col("patient_share") < least_patients) | (F.col("row_share") < least_rows), "below_cutoff").when(F.col("n_distinct") < 2, "constant")
    return found.withColumn("reason", reason)


def event_count_rule(rows: DataFrame, column: str, least: int, cause: int = 1, patient: str = "patient_id") -> DataFrame:
    """Levels with enough event patients; with fewer than two of them the column is dropped (no level is kept)."""
    counts = rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("missing")).alias("level")).agg(F.countDistinct(F.when(F.col("event") == cause, F.col(patient))).alias("event_patients"))
    enough = counts.filter(F.col("event_patients") >= least).agg((F.count("*") >= 2).alias("usable"))
    return counts.crossJoin(F.broadcast(enough)).select("level", "event_patients", (F.col("usable") & (F.col("event_patients") >= least)).alias("kept"))


def resolve_features(blocks: Mapping[str, Sequence[str]], wanted: Sequence[str], available: Sequence[str], excluded: Mapping[str, str] | None = None) -> dict[str, str]:
    """Feature to "used", "absent" or the reason for its exclusion, over the blocks of a model step."""
    out = {}
    for block in wanted:
        for f in blocks[block]:
            out[f] = "absent" if f not in available else (excluded or {}).get(f, "used")
    return out


def reference_profile(rows: DataFrame, numeric: Sequence[str], discrete: Sequence[str]) -> DataFrame:
    """Median per numeric and most frequent value (smallest of ties) per discrete feature, as (feature, value)."""
    found = exact_quantiles(rows, {f: F.col(f) for f in numeric}, [0.5]).select(F.col("name").alias("feature"), F.col("q")[0].cast("string").alias("value"))
    medians = rows.sparkSession.createDataFrame([(f,) for f in numeric], "feature string").join(found, "feature", "left")
    long = rows.select(F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in discrete)))).filter("value is not null")
    modes = long.groupBy("feature", "value").agg(F.count("*").alias("n")).groupBy("feature").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))
    return medians.unionByName(modes)
