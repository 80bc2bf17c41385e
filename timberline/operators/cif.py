"""Competing-risk integration: cumulative hazards on a shared grid to state probabilities."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

CAUSE_NAMES = ("svd", "death", "replacement")
STATES = (*CAUSE_NAMES, "alive_intact")
TOL = 1e-9


def build_grid(knots: Iterable[float], horizons: Iterable[float], max_years: float, refine: int = 1) -> list[float]:
    """Zero, the horizons, the maximum and every knot in (0, maximum]; with ``refine``, intervals split evenly."""
    points = sorted({0.0, float(max_years), *(float(h) for h in horizons if 0 < h <= max_years), *(float(k) for k in knots if 0 < k <= max_years)})
    if refine > 1:
        points = sorted({a + (b - a) * i / refine for a, b in zip(points, points[1:], strict=False) for i in range(refine)} | {points[-1]})
    return points


def check_grid(grid: Sequence[float]) -> None:
    if len(grid) < 2 or grid[0] != 0 or any(not (a < b < float("inf")) for a, b in zip(grid, grid[1:], strict=False)):
        raise ValueError("a grid starts at 0 and increases strictly over at least two finite points")


def hazard_violations(rows: DataFrame, causes: Sequence[str], points: int, tol: float = TOL) -> DataFrame:
    """One row per violated rule and cause: (row_id, cause, rule). Decreases within the tolerance are no violation."""
    checks = []
    for c in causes:
        h = F.col(c)
        bad = lambda p, h=h: F.coalesce(F.exists(h, p), F.lit(True))
        steps = F.zip_with(F.slice(h, 1, points - 1), F.slice(h, 2, points - 1), lambda a, b: b - a)
        for rule, hit in (("missing_or_length", h.isNull() | (F.size(h) != points)), ("not_finite", bad(lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))), ("not_zero_at_start", F.abs(F.get(h, 0)) > tol), ("negative", bad(lambda x: x < -tol)), ("decreasing", F.coalesce(F.exists(steps, lambda d: d < -tol), F.lit(False)))):
            checks.append(F.struct(F.lit(c).alias("cause"), F.lit(rule).alias("rule"), F.coalesce(hit, F.lit(False)).alias("hit")))
    return rows.select("row_id", F.inline(F.array(*checks))).filter("hit").drop("hit")


def combine(rows: DataFrame, causes: Sequence[str] = CAUSE_NAMES, clean: bool = False) -> DataFrame:
    """Adds ``S`` and ``F_<cause>`` arrays: with D the summed increments, S = exp(-sum D) and
    dF_k = S_prev * (1 - exp(-D)) * dH_k / D, from 0 before the first point.

    Running sums over an array have no built-in function, so a batch of rows is one matrix per cause, and the work is linear in
    rows and grid. A row that lacks a hazard gets NULL arrays.
    """

    def integrate(h: np.ndarray) -> tuple[np.ndarray, ...]:
        return _exponential(np.maximum.accumulate(np.maximum(h, 0.0), axis=2) if clean else h)

    return _integrated(rows, list(causes), integrate)


def product_limit(rows: DataFrame, causes: Sequence[str] = CAUSE_NAMES, cap: float = 0.999) -> DataFrame:
    """The discrete product-limit combination with capped increments; for comparison with :func:`combine` only. Linear in rows and
    grid; a row that lacks a hazard gets NULL arrays."""
    return _integrated(rows, list(causes), lambda h: _discrete(h, cap))


def _exponential(h: np.ndarray) -> tuple[np.ndarray, ...]:
    """S and the incidences of a block of hazards (causes x rows x grid)."""
    d = np.diff(h, axis=2, prepend=0.0)
    total = d.sum(axis=0)
    s = np.exp(-np.cumsum(total, axis=1))
    before = np.concatenate([np.ones((len(s), 1)), s[:, :-1]], axis=1)
    share = np.where(total > 0, before * -np.expm1(-total) / np.where(total > 0, total, 1.0), 0.0)
    return (s, *np.cumsum(share * d, axis=2))


def _discrete(h: np.ndarray, cap: float) -> tuple[np.ndarray, ...]:
    d = np.maximum(np.diff(h, axis=2, prepend=0.0), 0.0)
    total = d.sum(axis=0)
    d = d * np.where(total > cap, cap / np.where(total > 0, total, 1.0), 1.0)
    s = np.cumprod(1 - d.sum(axis=0), axis=1)
    before = np.concatenate([np.ones((len(s), 1)), s[:, :-1]], axis=1)
    return (s, *np.cumsum(before * d, axis=2))


def _integrated(rows: DataFrame, causes: list[str], integrate: Callable[[np.ndarray], tuple[np.ndarray, ...]]) -> DataFrame:
    """Adds the arrays that ``integrate`` makes of each block of rows with hazards of one length."""
    names = ["S", *(f"F_{c}" for c in causes)]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            lists = [batch.column(batch.schema.names.index(c)) for c in causes]
            sizes = np.stack([np.where(x.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(x), -1).to_numpy(zero_copy_only=False), -1) for x in lists])
            sizes = np.where((sizes == sizes[0]).all(axis=0), sizes[0], -1)
            flat: list[list[np.ndarray]] = [[] for _ in names]
            place = np.full(batch.num_rows, -1)
            done, ends = 0, [np.zeros(1, np.int32)]
            for n in np.unique(sizes[sizes > 0]):
                at = np.flatnonzero(sizes == n)
                h = np.stack([x.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), n) for x in lists])
                for column, values in zip(flat, integrate(h), strict=True):
                    column.append(values.ravel())
                place[at] = np.arange(done, done + len(at))
                ends.append(ends[-1][-1] + n * np.arange(1, len(at) + 1, dtype=np.int32))
                done += len(at)
            taken = pa.array(place, mask=place < 0)
            offsets = pa.array(np.concatenate(ends).astype(np.int32))
            arrays = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(c) if c else np.empty(0))).take(taken) for c in flat]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *names])

    schema = StructType([*rows.schema.fields, *(StructField(n, ArrayType(DoubleType())) for n in names)])
    return rows.mapInArrow(run, schema)


def convention_differences(rows: DataFrame, causes: Sequence[str] = CAUSE_NAMES) -> DataFrame:
    """(state, max_difference, mean_difference) between :func:`combine` and :func:`product_limit` over all rows and grid points.
    Both are taken of the same rows in passing, so that nothing is joined."""
    states = ["S", *(f"F_{c}" for c in causes)]
    first = combine(rows.select(*causes), causes).select(*causes, *(F.col(s).alias(f"__{s}") for s in states))
    both = product_limit(first, causes)
    each = both.select(F.inline(F.array(*(F.struct(F.lit(s).alias("state"), F.zip_with(f"__{s}", s, lambda x, y: F.abs(x - y)).alias("d")) for s in states))))
    return each.select("state", F.explode("d").alias("d")).groupBy("state").agg(F.max("d").alias("max_difference"), F.avg("d").alias("mean_difference"))


def at_horizons(rows: DataFrame, grid: Sequence[float], horizons: Sequence[float], causes: Sequence[str] = CAUSE_NAMES, tol: float = TOL) -> DataFrame:
    """(row_id, horizon, probabilities of the four states): the last grid point at or before each horizon."""
    check_grid(grid)
    places = [max(bisect.bisect_right(grid, h + tol) - 1, 0) for h in horizons]
    points = F.array(*(F.struct(F.lit(float(h)).alias("horizon"), F.get("S", F.lit(i)).alias("alive_intact"), *(F.get(f"F_{c}", F.lit(i)).alias(c) for c in causes)) for h, i in zip(horizons, places, strict=True)))
    return rows.select("row_id", F.inline(points))


def probability_violations(predictions: DataFrame, horizons: int = 3, tol: float = 1e-4) -> DataFrame:
    """Rows whose per-state arrays have another length, leave [0, 1], or do not add up to one."""
    bad = F.lit(False)
    total = F.array_repeat(F.lit(0.0), horizons)
    for s in STATES:
        bad = bad | F.coalesce((F.size(s) != horizons) | F.exists(s, lambda p: (p < -TOL) | (p > 1 + TOL) | p.isNull()), F.lit(True))
        total = F.zip_with(total, F.col(s), lambda a, b: a + b)
    return predictions.filter(bad | F.exists(total, lambda t: F.coalesce(F.abs(t - 1) > tol, F.lit(True))))
