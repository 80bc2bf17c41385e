"""Statistics of pairs and hazard fits for all bootstrap replicates at once.

Rows carry ``reps``, the list of replicates that drew their patient (once per draw); replicate 0 is the sample itself
(:func:`timberline.operators.resample.bootstrap_lists`). So a row stays one row, whatever the number of replicates, and a
task turns its lists into count matrices of rows by replicates.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.operators.cox import slack
from timberline.operators.staging import broadcast_if_small, equal_keys, prefix_sum, stage


def counts_of(lists, replicates: int) -> np.ndarray:
    """Rows by replicates: how often each replicate drew the row's patient."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    at = np.repeat(np.arange(len(sizes)), sizes) * (replicates + 1) + flat
    return np.bincount(at, minlength=len(sizes) * (replicates + 1)).reshape(len(sizes), replicates + 1).astype(float)


def pair_statistics(rows: DataFrame, keys: Sequence[str], node: Sequence[str], replicates: int) -> DataFrame:
    """(key columns, rep, num, den): over all nodes of a key, the weight of pairs of a first row (``d``) and a second row (``n``)
    of one node, ``den``, and of those where the first has the higher ``s``, ties one half, ``num``; per replicate.

    Rows are dealt by ranges of (keys, node, s) and each task keeps one running count per replicate. A node within a task adds
    to the task's sums; the node at either edge is passed on as sums of its own (two rows a task and key at most), which
    meet in the order of the tasks.
    """
    place = [*keys, *node]
    sorted_rows = rows.repartitionByRange(*place, "s").sortWithinPartitions(*place, "s").select(*place, "s", "d", "n", "reps")
    kinds = dict(rows.dtypes)
    width = len(place)
    schema = ", ".join(f"{c} {kinds[c]}" for c in place) + ", part int, edge boolean, num array<double>, firsts array<double>, seconds array<double>"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        types = None
        held, first_node = None, True  # the node at hand: place, running seconds, num, firsts, seconds, and the open score
        whole: dict[tuple, list] = {}

        def row(at, edge, sums):
            columns = [pa.array([v], t) for v, t in zip(at, types, strict=True)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([part], pa.int32()), pa.array([edge]), *(pa.array([x.tolist()], pa.list_(pa.float64())) for x in sums)], names=[*place, "part", "edge", "num", "firsts", "seconds"])

        def settle(node_sums):
            """The open score of a node: its firsts meet the seconds below it, and half of those beside it."""
            below, num, firsts, seconds, open_d, open_n, _ = node_sums[1:]
            num += open_d * (below + 0.5 * open_n)
            firsts += open_d
            seconds += open_n
            below += open_n
            open_d[:] = 0
            open_n[:] = 0

        def close(last: bool):
            nonlocal first_node
            settle(held)
            at, _, num, firsts, seconds = held[:5]
            if first_node or last:
                first_node = False
                return [row(at, True, (num, firsts, seconds))]
            own = whole.setdefault(at[: len(keys)], [np.zeros(replicates + 1), np.zeros(replicates + 1)])
            own[0] += num
            own[1] += firsts * seconds
            return []

        for batch in batches:
            types = types or [batch.schema.field(c).type for c in place]
            at = list(zip(*(batch.column(i).to_pylist() for i in range(width)), strict=True))
            score = batch.column(width).to_numpy()
            k = counts_of(batch.column(width + 3), replicates)
            d, n = batch.column(width + 1).to_numpy()[:, None] * k, batch.column(width + 2).to_numpy()[:, None] * k
            edges = [0, *(i for i in range(1, len(at)) if at[i] != at[i - 1]), len(at)]
            for lo, hi in zip(edges, edges[1:]):
                if held is None or held[0] != at[lo]:
                    if held is not None:
                        yield from close(False)
                    zero = [np.zeros(replicates + 1) for _ in range(6)]
                    held = [at[lo], *zero, None]
                s = score[lo:hi]
                starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
                cell_d, cell_n = np.add.reduceat(d[lo:hi], starts, axis=0), np.add.reduceat(n[lo:hi], starts, axis=0)
                if held[7] is not None and held[7] != s[0]:
                    settle(held)
                held[5] += cell_d[0]
                held[6] += cell_n[0]
                held[7] = s[starts[-1]]
                if len(starts) > 1:
                    settle(held)
                    inner_d, inner_n = cell_d[1:-1], cell_n[1:-1]
                    if len(inner_d):
                        upto = held[1] + np.cumsum(inner_n, axis=0) - 0.5 * inner_n
                        held[2] += (inner_d * upto).sum(axis=0)
                        held[3] += inner_d.sum(axis=0)
                        held[4] += inner_n.sum(axis=0)
                        held[1] += inner_n.sum(axis=0)
                    held[5] += cell_d[-1]
                    held[6] += cell_n[-1]
        if held is not None:
            yield from close(True)
        for key, (num, den) in whole.items():
            yield row((*key, *[None] * len(node)), False, (num, den, np.zeros(1)))

    # ranges keep equal scores of a node in one task, where their rows stream by
    parts = stage(sorted_rows.mapInArrow(run, schema), "pairs")
    out = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", rep int, num double, den double"

    def meet(key, table):
        import pyarrow as pa

        num, den = np.zeros(replicates + 1), np.zeros(replicates + 1)
        running: dict[tuple, list] = {}
        for r in sorted(table.to_pylist(), key=lambda r: r["part"]):
            if not r["edge"]:
                num += r["num"]
                den += r["firsts"]
                continue
            seconds, firsts = running.setdefault(tuple(r[c] for c in node), [np.zeros(replicates + 1), np.zeros(replicates + 1)])
            num += np.asarray(r["num"]) + np.asarray(r["firsts"]) * seconds
            seconds += r["seconds"]
            firsts += r["firsts"]
        for seconds, firsts in running.values():
            den += firsts * seconds
        columns = [pa.array([k.as_py()] * (replicates + 1), k.type) for k in key]
        return pa.table([*columns, pa.array(np.arange(replicates + 1), pa.int32()), pa.array(num), pa.array(den)], names=[*keys, "rep", "num", "den"])

    return parts.groupBy(*keys).applyInArrow(meet, out)


def auc_replicates(rows: DataFrame, replicates: int, group: Sequence[str] = (), pred: str = "pred") -> DataFrame:
    """(group columns, rep, auc): weighted probability that a case scores above a control, per replicate."""
    keys = list(group) or ["__all"]
    case, control = F.when(F.col("y") == 1, F.col("w")).otherwise(0.0), F.when((F.col("y") == 0) & F.col("known"), F.col("w")).otherwise(0.0)
    own = rows.withColumn("__all", F.lit(1)).filter(F.col(pred).isNotNull())
    cells = own.select(*keys, F.lit(0).alias("node"), (F.col(pred).cast("double") + F.lit(0.0)).alias("s"), case.alias("d"), control.alias("n"), "reps")
    out = pair_statistics(cells, keys, ["node"], replicates)
    return out.select(*group, "rep", F.when(F.col("den") > 0, F.col("num") / F.col("den")).alias("auc"))


def concordance_replicates(rows: DataFrame, replicates: int, group: Sequence[str] = (), time: str = "time", event: str = "event", pred: str = "pred") -> DataFrame:
    """(group columns, rep, concordance): Harrell's concordance per replicate, from one pass over the rank tree of
    :func:`timberline.operators.metrics.concordance`, which carries the replicates on both sides of a pair."""
    keys = list(group) or ["__all"]
    own = rows.withColumn("__all", F.lit(1)).filter(F.col(pred).isNotNull())
    own = stage(own.select(*keys, (F.col(time).cast("double") + F.lit(0.0)).alias("t"), F.col(pred).cast("double").alias("s"), (F.col(event) != 0).alias("hit"), "reps"), "cells")
    times = stage(prefix_sum(own.select(*keys, "t").distinct().withColumn("__one", F.lit(1).cast("long")), keys, "t", {"rank": "__one"}).drop("__one"), "times")
    digits = max(1, int(times.agg(F.max("rank")).first()[0] or 0).bit_length())
    ranks = times.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("t").alias("__t"), "rank")
    ranked = own.join(broadcast_if_small(ranks, name="ranks"), equal_keys([*keys, "t"], [*(f"__{k}" for k in keys), "__t"]))
    level = ranked.withColumn("level", F.explode(F.sequence(F.lit(-1), F.lit(digits - 1))))
    one = F.expr("shiftrightunsigned(rank, greatest(level, 0))").bitwiseAND(F.lit(1)) == 1
    tied, hit = F.col("level") < 0, F.col("hit")
    first = hit & (tied | ~one)
    second = F.when(tied, ~hit).otherwise(one)
    node = F.when(tied, F.col("rank")).otherwise(F.expr("shiftrightunsigned(rank, level + 1)"))
    cells = level.select(*keys, "level", node.alias("node"), "s", first.cast("double").alias("d"), second.cast("double").alias("n"), "reps").filter("d > 0 or n > 0")
    out = pair_statistics(cells, keys, ["level", "node"], replicates)
    return out.select(*group, "rep", F.when(F.col("den") > 0, F.col("num") / F.col("den")).alias("concordance"))


def replicate_intervals(values: DataFrame, column: str, group: Sequence[str] = (), least_valid: int = 10) -> DataFrame:
    """(group columns, value, low, high, valid): the sample's own value (replicate 0) and percentile limits over the others; NULL
    limits with fewer than ``least_valid`` valid ones. A value per replicate, so the percentiles are over few rows."""
    drawn = F.when(F.col("rep") > 0, F.col(column))
    q = F.percentile(drawn, [0.025, 0.975])
    ok = F.count(drawn) >= least_valid
    return values.groupBy(*group).agg(F.max(F.when(F.col("rep") == 0, F.col(column))).alias("value"), F.when(ok, q[0]).alias("low"), F.when(ok, q[1]).alias("high"), F.count(drawn).alias("valid"))


# -- Newton steps of all replicates

_FIT = "stratum string, part int, no int, n long, time binary, hit binary, offset binary, z binary, counts binary"


def dense_counts(column, replicates: int) -> np.ndarray:
    """Rows by replicates, as small integers, from lists of replicates or from strings of counts."""
    import pyarrow as pa

    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), replicates + 1)
    k = counts_of(column, replicates)
    return k.astype(np.uint8 if k.max(initial=0) < 256 else np.uint32)


#: Rows whose products with all replicates are held at once.
BLOCK_ROWS = 1 << 9


class _Fit:
    """A chunk of rows of one stratum in the order of time. Rows of one time are summed before anything runs along the times, so
    that rows take one product of matrices for all moments and replicates."""

    def __init__(self, r: dict, p: int, replicates: int) -> None:
        self.time, self.hit, self.offset = np.frombuffer(r["time"]), np.frombuffer(r["hit"]), np.frombuffer(r["offset"])
        self.z = np.frombuffer(r["z"]).reshape(len(self.time), p)
        cells = len(self.time) * (replicates + 1)
        self.k = np.frombuffer(r["counts"], np.uint8 if len(r["counts"]) == cells else np.uint32).reshape(len(self.time), replicates + 1)
        upper = np.triu_indices(p)
        self.terms = np.concatenate([np.ones((len(self.time), 1)), self.z, self.z[:, upper[0]] * self.z[:, upper[1]]], axis=1)
        self.starts = np.flatnonzero(np.r_[True, self.time[1:] != self.time[:-1]])

    def risk(self, beta: np.ndarray, a: int, b: int) -> np.ndarray:
        """rows x replicates: drawn count times exp(eta)."""
        w = self.z[a:b] @ beta.T
        w += self.offset[a:b, None]
        np.exp(w, out=w)
        w *= self.k[a:b]
        return w

    def moments(self, beta: np.ndarray, a: int, b: int) -> np.ndarray:
        """(terms, replicates): moment sums over rows, of which a few at a time stay in the cache."""
        return sum(self.terms[i : min(b, i + BLOCK_ROWS)].T @ self.risk(beta, i, min(b, i + BLOCK_ROWS)) for i in range(a, b, BLOCK_ROWS))

    def at_times(self, beta: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """(times, terms, replicates): moment sums at the distinct times ``lo`` to ``hi``."""
        starts = self.starts[lo:hi]
        a, b = starts[0], self.starts[hi] if hi < len(self.starts) else len(self.time)
        if hi - lo == 1:
            return self.moments(beta, a, b)[None]
        w, terms = self.risk(beta, a, b), self.terms[a:b]
        if len(starts) * 8 <= len(w):
            return np.stack([terms[i:j].T @ w[i:j] for i, j in zip(starts - a, np.r_[starts[1:], b] - a, strict=True)])
        return np.stack([np.add.reduceat(w * terms[:, [i]], starts - a, axis=0) for i in range(terms.shape[1])], axis=1)

    def totals(self, beta: np.ndarray) -> np.ndarray:
        """(3, replicates, terms): moment sums of the chunk, at its first time, and at its last."""
        n = len(self.time)
        first, last = self.starts[1] if len(self.starts) > 1 else n, self.starts[-1]
        return np.stack([self.moments(beta, *e).T for e in ((0, n), (0, first), (last, n))])

    def objective(self, beta: np.ndarray, after: np.ndarray, tied: np.ndarray) -> np.ndarray:
        """replicates x (1 + p + p (p + 1) / 2): log partial likelihood, gradient, Hessian. From the last time to the first, some
        distinct times at once."""
        r, p = beta.shape
        out = np.zeros((r, self.terms.shape[1]))
        events = np.flatnonzero(self.hit > 0)
        if not len(events):
            return out
        upper = np.triu_indices(p)
        k = self.k[events].astype(float)
        drawn = k.T @ self.z[events]
        out[:, 0] = k.T @ self.offset[events] + (drawn * beta).sum(axis=1)
        out[:, 1 : 1 + p] = drawn
        run = np.searchsorted(self.starts, events, side="right") - 1
        own = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        hits = np.zeros((len(self.starts), r))
        hits[run[own]] = np.add.reduceat(k, own, axis=0)
        later, hi = after.T, len(self.starts)
        while hi:
            end = self.starts[hi] if hi < len(self.starts) else len(self.time)
            lo = min(hi - 1, int(np.searchsorted(self.starts, end - BLOCK_ROWS)))
            sums = np.cumsum(self.at_times(beta, lo, hi)[::-1], axis=0)[::-1] + later
            later = sums[0].copy()
            if lo == 0:
                sums[0] += tied.T
            live = (hits[lo:hi] > 0) & (sums[:, 0] > 0)
            d, s0 = np.where(live, hits[lo:hi], 0.0), np.where(live, sums[:, 0], 1.0)
            means = [sums[:, 1 + i] / s0 for i in range(p)]
            out[:, 0] -= (d * np.log(s0)).sum(axis=0)
            for i in range(p):
                out[:, 1 + i] -= (d * means[i]).sum(axis=0)
            for j, (x, y) in enumerate(zip(*upper, strict=True)):
                out[:, 1 + p + j] -= (d * (sums[:, 1 + p + j] / s0 - means[x] * means[y])).sum(axis=0)
            hi = lo
        return out


def fit_replicates(
    rows: DataFrame, columns: Sequence[str], event: Column, replicates: int, strata: Column | None = None, offset: Column | None = None, penalizer: float = 0.05,
    max_iter: int = 25, tol: float = 1e-6, least_events: int = 5, chunk_rows: int = 1 << 15,
) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of a ridge Cox fit for the sample (row 0) and every replicate, and which of them are valid (enough events,
    converged). A step takes two jobs for all replicates: moment sums per chunk, then likelihood, gradient and Hessian with
    what later chunks add to the numbers at risk. The driver holds sums per chunk and replicate. ``reps`` is a list of replicates
    (:func:`~timberline.operators.resample.bootstrap_lists`) or a string of counts (``bootstrap_counts``).
    """
    p, names = len(columns), list(columns)
    spark = rows.sparkSession
    number = lambda c, x: F.lit(x) if c is None else c.cast("double")
    data = rows.select((F.lit("all") if strata is None else strata.cast("string")).alias("stratum"), (F.col("time").cast("double") + 0.0).alias("time"), F.coalesce(event, F.lit(False)).cast("double").alias("hit"), number(offset, 0.0).alias("offset"), *(F.col(c).cast("double").alias(c) for c in names), "reps")
    order = ["stratum", "time", F.xxhash64(*names)]
    chunks = stage(data.repartitionByRange(*order).sortWithinPartitions("stratum", "time").mapInArrow(_pack(names, chunk_rows, replicates), _FIT), "replicates")

    def sums(what: str, beta: np.ndarray, given: dict | None = None):
        shared = spark.sparkContext.broadcast((beta, given))

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            b, arguments = shared.value
            total = None
            for batch in batches:
                for r in batch.to_pylist():
                    chunk = _Fit(r, p, replicates)
                    if what == "totals":
                        edge = np.asarray([chunk.time[0], chunk.time[-1]])
                        counted = chunk.k[chunk.hit > 0].sum(axis=0, dtype=float)
                        yield pa.RecordBatch.from_arrays([pa.array([r["stratum"]], pa.string()), pa.array([r["part"]], pa.int32()), pa.array([r["no"]], pa.int32()), pa.array([np.concatenate([edge, counted, chunk.totals(b).ravel()]).tolist()], pa.list_(pa.float64()))], names=["stratum", "part", "no", "sums"])
                    else:
                        own = chunk.objective(b, *arguments[r["part"], r["no"]])
                        total = own if total is None else total + own
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["stratum", "part", "no", "sums"])

        found = chunks.mapInArrow(run, "stratum string, part int, no int, sums array<double>").collect()
        shared.unpersist()
        return found

    r1, m = replicates + 1, 1 + p + p * (p + 1) // 2
    upper = np.triu_indices(p)

    def objectives(beta: np.ndarray):
        by: dict[str, list] = {}
        for r in sums("totals", beta):
            v = np.asarray(r["sums"])
            by.setdefault(r["stratum"], []).append(((r["part"], r["no"]), v[:2], v[2 : 2 + r1], v[2 + r1 :].reshape(3, r1, m)))
        given, events = {}, np.zeros(r1)
        for found in by.values():
            found.sort(key=lambda x: x[0])
            after, tied = np.zeros((r1, m)), np.zeros((r1, m))
            for i, (_, (start, _), n, _) in enumerate(found):
                events += n
                if i and found[i - 1][1][1] == start:
                    before = found[i - 1]
                    tied = before[3][2] + (tied if before[1][0] == before[1][1] else 0.0)
                else:
                    tied = np.zeros((r1, m))
                given[found[i][0]] = [None, tied]
            for key, _, _, total in reversed(found):
                given[key][0] = after
                after = after + total[0]
        out = np.zeros((r1, m))
        for r in sums("objective", beta, given):
            out += np.asarray(r["sums"]).reshape(r1, m)
        h = np.zeros((r1, p, p))
        h[:, upper[0], upper[1]] = out[:, 1 + p :]
        h[:, upper[1], upper[0]] = out[:, 1 + p :]
        value = out[:, 0] - 0.5 * penalizer * (beta**2).sum(axis=1)
        return value, out[:, 1 : 1 + p] - penalizer * beta, h - penalizer * np.eye(p), events

    beta = np.zeros((r1, p))
    value, g, h, events = objectives(beta)
    moving, converged = events >= least_events, np.zeros(r1, bool)
    for _ in range(max_iter):
        if not moving.any():
            break
        step = np.where(moving[:, None], np.linalg.solve(h, -g[..., None])[..., 0], 0.0)
        last = moving & (0.5 * (g * step).sum(axis=1) < tol)
        size = np.ones(r1)
        while True:
            tried = beta + size[:, None] * step
            new = objectives(tried)
            worse = moving & ~last & (new[0] < value - slack(value)) & (size > 1e-6)
            if not worse.any():
                break
            size = np.where(worse, size / 2, size)
        beta, (value, g, h, _) = tried, new
        converged |= last
        moving &= ~last
    return beta, converged


def _pack(names: list[str], chunk_rows: int, replicates: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, no, held, parts, size = TaskContext.get().partitionId(), 0, None, [], 0

        def flush():
            time, hit, offset, z, counts = (np.concatenate([x[i] for x in parts]) for i in range(5))
            blobs = (time, hit, offset, z.astype(float), counts)
            return pa.RecordBatch.from_arrays([pa.array([held], pa.string()), pa.array([part], pa.int32()), pa.array([no], pa.int32()), pa.array([len(time)]), *(pa.array([np.ascontiguousarray(b).tobytes()], pa.binary()) for b in blobs)], names=[x.split()[0] for x in _FIT.split(", ")])

        for batch in batches:
            strata = batch.column(0).to_pylist()
            edges = [0, *(i for i in range(1, len(strata)) if strata[i] != strata[i - 1]), len(strata)]
            for lo, hi in zip(edges, edges[1:]):
                for at in range(lo, hi, chunk_rows):
                    to = min(hi, at + chunk_rows)
                    if parts and (strata[at] != held or size + to - at > chunk_rows):
                        yield flush()
                        parts, size, no = [], 0, no + 1
                    held = strata[at]
                    own = batch.slice(at, to - at)
                    counts = dense_counts(own.column(4 + len(names)), replicates)
                    z = np.stack([own.column(4 + i).to_numpy() for i in range(len(names))], axis=1)
                    parts.append((*(own.column(i).to_numpy() for i in (1, 2, 3)), z, counts))
                    size += to - at
        if parts:
            yield flush()

    return run
