"""Boosted proportional hazards for every stratum and cause at once, by histograms over quantile bins.

Features are cut to bins at exact quantiles (distinct values where they are few). Rows are sorted by (stratum, time) and kept
as chunks: one row per chunk, with times, events and bins as packed arrays. A round needs these sums, each one job for all
models: what the chunks weigh (for the numbers at risk); what hazard they add (Breslow), with the gradients per feature and bin up
to what earlier chunks add; and for each further level of the tree the gradients and counts per (stratum, cause, node, feature,
bin). The last level needs none: its sums are those of the splits above. Numbers at risk and hazards cross from chunk to chunk as
one number per chunk and cause, also where tied times span chunks. Trees and chunk totals are all that the driver sees. Trees of
depth two at most are kept summed, as tables over pairs of features, so that a round costs the same however many went before.

Strata of at most ``local_rows`` rows, counted beforehand, are boosted whole inside a task by the same steps, so that small
data does not pay for a job per step; strata are spread over tasks. Larger strata go through Spark job by job. Both give the
same trees.

Rows whose features lie in the same bins have the same score. A large stratum whose combinations of bins ("cells") and distinct
times are together no more than ``chunk_rows`` is therefore kept as two numbers a row, its time and its cell, unsorted. A
round sums the cells' weights per time, then the hazards at the rows' times per cell: two jobs for all models, and the driver, which
gets a number per time or cell, has the gradients and counts of every node from the second.

The gradient is that of the Cox partial likelihood with Breslow ties; a tree splits where the squared error falls most (ties:
first feature, lowest bin), with at least ``min_instances`` rows on either side, and a leaf adds ``rate`` times its mean
gradient. A null or NaN feature lies in the lowest bin. Causes are gated by unique event patients per stratum: a model, a baseline
alone, or no support. Baselines are Breslow's on the scores after the number of trees asked for, so a stage equals a fit of
that many trees.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.operators import cif
from timberline.operators.cox import GATES, baseline_on_grid
from timberline.operators.staging import broadcast_if_small, exact_quantiles, stage
from timberline.operators.survival import nelson_aalen

_CHUNKS = "stratum string, part int, no int, n long, times binary, events binary, bins binary"
_CELLS = "stratum string, times binary, events binary, cells binary"


@dataclass
class Tree:
    """Nodes in level order, children of i at 2i+1 and 2i+2; feature -1 is a leaf. Rows with bin <= cut go left."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node where each column of ``bins`` (features x rows) ends."""
        at = np.zeros(bins.shape[1], np.int16)
        for level in range((len(self.feature) + 1).bit_length() - 2):
            nodes = np.arange((1 << level) - 1, (2 << level) - 1)
            inner = nodes[self.feature[nodes] >= 0]
            if not len(inner):
                break
            right = np.zeros(len(at), bool)
            for node in inner:
                right |= (at == node) & (bins[self.feature[node]] > self.cut[node])
            at = np.where(np.isin(at, inner) if len(inner) < len(nodes) or level else True, 2 * at + 1 + right, at)
        return at


class _Surface:
    """A sum of trees of depth two at most, as tables over pairs of features: a look-up per pair, however many trees."""

    def __init__(self, bins: int) -> None:
        self.bins = bins
        self.tables: dict[tuple[int, int], np.ndarray] = {}

    def add(self, tree: Tree, rate: float) -> None:
        at = np.arange(self.bins)
        f = int(tree.feature[0])
        if f < 0:
            self._table(0, 0)[:] += rate * tree.value[0]
            return
        for child, own in ((1, at <= tree.cut[0]), (2, at > tree.cut[0])):
            g = int(tree.feature[child])
            if g < 0:
                self._table(f, f)[own] += rate * tree.value[child]
                continue
            cells = np.outer(own, np.where(at <= tree.cut[child], tree.value[2 * child + 1], tree.value[2 * child + 2]))
            self._table(f, g)[:] += rate * (cells if f <= g else cells.T)

    def _table(self, f: int, g: int) -> np.ndarray:
        return self.tables.setdefault((min(f, g), max(f, g)), np.zeros((self.bins, self.bins)))

    def __call__(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros(bins.shape[1])
        for (f, g), table in self.tables.items():
            out += table.ravel()[bins[f].astype(np.int32) * self.bins + bins[g]]
        return out


class _Replay:
    """A sum of deeper trees, one after another."""

    def __init__(self) -> None:
        self.trees: list[tuple[Tree, float]] = []

    def add(self, tree: Tree, rate: float) -> None:
        self.trees.append((tree, rate))

    def __call__(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros(bins.shape[1])
        for tree, rate in self.trees:
            out += rate * tree.value[tree.leaves(bins)]
        return out


def summed(trees: Sequence[Tree], rate: float, depth: int, bins: int) -> _Surface | _Replay:
    out = _Surface(bins) if depth <= 2 else _Replay()
    for tree in trees:
        out.add(tree, rate)
    return out


@dataclass
class _Chunk:
    times: np.ndarray
    events: np.ndarray
    bins: np.ndarray
    scores: dict[int, np.ndarray]

    @classmethod
    def of(cls, r: dict, p: int, scores: Mapping[int, Callable[[np.ndarray], np.ndarray]]) -> _Chunk:
        t, e = np.frombuffer(r["times"]), np.frombuffer(r["events"], np.int32)
        bins = np.frombuffer(r["bins"], np.uint8).reshape(p, len(t))
        return cls(t, e, bins, {c: score(bins) for c, score in scores.items()})

    def __post_init__(self) -> None:
        #: Of each row: the first row of its time, and the last.
        starts = np.r_[0, np.flatnonzero(self.times[1:] != self.times[:-1]) + 1]
        sizes = np.diff(np.r_[starts, len(self.times)])
        self.first = np.repeat(starts, sizes)
        self.last = np.repeat(starts + sizes - 1, sizes)
        self.hits = {c: (self.events == c).astype(float) for c in self.scores}
        self.weight: dict[int, np.ndarray] = {}
        self.steps: dict[int, tuple] = {}

    def grow(self, cause: int, tree: Tree, rate: float) -> None:
        self.scores[cause] = self.scores[cause] + rate * tree.value[tree.leaves(self.bins)]
        self.weight.pop(cause, None)
        self.steps.pop(cause, None)

    def risk(self, cause: int) -> np.ndarray:
        if cause not in self.weight:
            self.weight[cause] = np.exp(self.scores[cause])
        return self.weight[cause]

    def weights(self, cause: int) -> tuple[float, float, float]:
        """Sums of exp(score): all, at the chunk's first time, at its last."""
        w = self.risk(cause)
        return float(w.sum()), float(w[: self.last[0] + 1].sum()), float(w[self.first[-1] :].sum())

    def increments(self, cause: int, after: float, tied: float) -> np.ndarray:
        """Each row's share of the cumulative hazard: 1 / (weight at risk) for an event. ``after``: the weight of later chunks;
        ``tied``: that of earlier chunks at this chunk's first time."""
        given = (after, tied)
        if cause not in self.steps or self.steps[cause][0] != given:
            at_risk = np.cumsum(self.risk(cause)[::-1])[::-1][self.first] + after
            at_risk[: self.last[0] + 1] += tied
            self.steps[cause] = (given, self.hits[cause] / at_risk)
        return self.steps[cause][1]

    def hazards(self, cause: int, after: float, tied: float) -> tuple[float, float]:
        """What the chunk adds to the cumulative hazard: all, and at its first time."""
        h = self.increments(cause, after, tied)
        return float(h.sum()), float(h[: self.last[0] + 1].sum())

    def gradient(self, cause: int, after: float, tied: float, before: float, coming: float) -> np.ndarray:
        """``before``: hazard of earlier chunks; ``coming``: that of later chunks at this chunk's last time."""
        h = np.cumsum(self.increments(cause, after, tied))[self.last] + before
        h[self.first[-1] :] += coming
        return self.hits[cause] - self.risk(cause) * h

    def opening(self, cause: int, after: float, tied: float, bins: int) -> np.ndarray:
        """``hazards``, then per feature and bin: gradient sums as if no other chunk added hazard, sums of exp(score), and those
        at the chunk's last time. Gradients are linear in what the others add."""
        edge = np.zeros(len(self.times))
        edge[self.first[-1] :] = self.risk(cause)[self.first[-1] :]
        parts = (self.gradient(cause, after, tied, 0.0, 0.0), self.risk(cause), edge)
        sums = [np.bincount(own, weights=x, minlength=bins) for x in parts for own in self.bins]
        return np.concatenate([self.hazards(cause, after, tied), *sums])

    def counts(self, bins: int) -> np.ndarray:
        return np.concatenate([np.bincount(own, minlength=bins) for own in self.bins]).astype(float)

    def histogram(self, gradient: np.ndarray, tree: Tree | None, level: int, bins: int, features: int | None = None) -> np.ndarray:
        """(2, nodes of the level, features, bins): gradient sums and row counts."""
        nodes = 1 << level
        at = np.zeros(len(gradient), np.int64) if tree is None else tree.leaves(self.bins).astype(np.int64) - (nodes - 1)
        own = self.bins[:features]
        if (at < 0).any():
            open_ = at >= 0
            at, own, gradient = at[open_], own[:, open_], gradient[open_]
        out = np.zeros((2, nodes, len(own), bins))
        base = at * bins
        for f in range(len(own)):
            cell = base + own[f]
            out[0, :, f] = np.bincount(cell, weights=gradient, minlength=nodes * bins).reshape(nodes, bins)
            out[1, :, f] = np.bincount(cell, minlength=nodes * bins).reshape(nodes, bins)
        return out


def split_level(tree: Tree, histogram: np.ndarray, level: int, min_instances: int, depth: int) -> bool:
    """Fill a level's values and split its nodes where that lowers the squared error, filling the values of either side; true if
    any was split."""
    sums, counts = histogram
    any_split = False
    for node in range(1 << level):
        at = (1 << level) - 1 + node
        total, n = sums[node, 0].sum(), counts[node, 0].sum()
        if not n:
            continue
        tree.value[at] = total / n
        if level == depth:
            continue
        left, ln = np.cumsum(sums[node], axis=1)[:, :-1], np.cumsum(counts[node], axis=1)[:, :-1]
        rn = n - ln
        fine = (ln >= min_instances) & (rn >= min_instances)
        gain = np.where(fine, left**2 / np.maximum(ln, 1) + (total - left) ** 2 / np.maximum(rn, 1) - total**2 / n, -np.inf)
        best = gain.max(initial=-np.inf)
        if best <= 1e-12 * max(1.0, abs(total)):
            continue
        first = int(np.argmax((gain >= best - 1e-9 * max(1.0, abs(best))).ravel()))
        f, cut = divmod(first, gain.shape[1])
        tree.feature[at], tree.cut[at] = f, cut
        tree.value[2 * at + 1], tree.value[2 * at + 2] = left[f, cut] / ln[f, cut], (total - left[f, cut]) / rn[f, cut]
        any_split = True
    return any_split


def _at_risk(first: np.ndarray, last: np.ndarray, w: np.ndarray) -> list[tuple[float, float]]:
    """Per chunk, from ``weights``: the weight of later chunks, and that of earlier ones at its first time."""
    return list(zip(np.cumsum(w[::-1, 0])[::-1] - w[:, 0], _chain(first, last, w[:, 0], w[:, 2], forward=True), strict=True))


def _hazards_beside(first: np.ndarray, last: np.ndarray, h: np.ndarray) -> list[tuple[float, float]]:
    """Per chunk, from ``hazards``: the hazard of earlier chunks, and that of later ones at its last time."""
    return list(zip(np.r_[0.0, np.cumsum(h[:, 0])[:-1]], _chain(first, last, h[:, 0], h[:, 1], forward=False), strict=True))


def _cell_histogram(of_cell: np.ndarray, gradient: np.ndarray, count: np.ndarray, tree: Tree | None, level: int, bins: int) -> np.ndarray:
    """As ``_Chunk.histogram``, from sums per cell; ``of_cell``: the bins of each cell (features x cells)."""
    nodes = 1 << level
    at = np.zeros(len(gradient), np.int64) if tree is None else tree.leaves(of_cell).astype(np.int64) - (nodes - 1)
    open_ = at >= 0
    cell = at[open_] * bins + of_cell[:, open_]
    return np.stack([[np.bincount(own, weights=x[open_], minlength=nodes * bins).reshape(nodes, bins) for own in cell] for x in (gradient, count)]).swapaxes(1, 2)


def _empty_tree(depth: int) -> Tree:
    nodes = (1 << (depth + 1)) - 1
    return Tree(np.full(nodes, -1, np.int64), np.zeros(nodes, np.int64), np.zeros(nodes))


def _chain(first: np.ndarray, last: np.ndarray, whole: np.ndarray, edge: np.ndarray, forward: bool) -> np.ndarray:
    """Forward: per chunk, what earlier chunks hold at its first time (``edge``: sums at their last times). Backward: what later
    chunks hold at its last time (``edge``: sums at their first times). A chunk of one time alone passes on what it got."""
    n = len(first)
    out = np.zeros(n)
    for i in range(1, n) if forward else range(n - 2, -1, -1):
        j = i - 1 if forward else i + 1
        if (last[j] == first[i]) if forward else (first[j] == last[i]):
            out[i] = edge[j] + (out[j] if first[j] == last[j] else 0.0)
    return out


def _boost_local(chunks: list[_Chunk], cause: int, rounds: int, depth: int, rate: float, min_instances: int, bins: int) -> list[Tree]:
    """Boost one cause of a stratum whose chunks, in order, one task holds."""
    first, last = (np.asarray([c.times[i] for c in chunks]) for i in (0, -1))
    out: list[Tree] = []
    for _ in range(rounds):
        risk = _at_risk(first, last, np.asarray([c.weights(cause) for c in chunks]))
        added = np.asarray([c.hazards(cause, *r) for c, r in zip(chunks, risk, strict=True)])
        gradients = [c.gradient(cause, *r, *h) for c, r, h in zip(chunks, risk, _hazards_beside(first, last, added), strict=True)]
        tree = _empty_tree(depth)
        for level in range(max(depth, 1)):
            if not split_level(tree, sum(c.histogram(g, tree if level else None, level, bins) for c, g in zip(chunks, gradients, strict=True)), level, min_instances, depth):
                break
        out.append(tree)
        for c in chunks:
            c.grow(cause, tree, rate)
    return out


@dataclass
class StratumModel:
    status: dict[str, str]
    events: dict[str, int]
    columns: list[str]
    edges: dict[str, np.ndarray]
    trees: dict[str, list[Tree]] = field(default_factory=dict)


@dataclass
class BoostedHazards:
    """Gradient boosting of each cause in each stratum; ``staged_scores`` and ``probabilities`` take any number of trees."""

    columns: Sequence[str]
    stratum: str = "route"
    trees: int = 100
    depth: int = 2
    rate: float = 0.1
    min_instances: int = 20
    bins: int = 64
    gates: dict = field(default_factory=lambda: dict(GATES))
    causes: dict[str, int] = field(default_factory=lambda: {"svd": 1, "death": 2, "replacement": 3})
    local_rows: int = 1_000_000
    chunk_rows: int = 1 << 16
    models: dict[str, StratumModel] = field(default_factory=dict)

    def fit(self, rows: DataFrame, patient: str = "patient_id") -> BoostedHazards:
        if not 2 <= self.bins <= 256:
            raise ValueError("bins lie between 2 and 256")
        columns = list(self.columns)
        rows = stage(rows.select(F.col(self.stratum).cast("string").alias("stratum"), F.col(patient).alias("patient"), (F.col("time").cast("double") + 0.0).alias("time"), F.col("event").cast("int").alias("event"), *(_number(F.col(c)).alias(f"x_{c}") for c in columns)).filter("stratum is not null"), "boosted")
        self.training = rows
        # patients are counted by patient, not by rows repeated for every cause
        hit = {n: F.max((F.col("event") == code) & F.col("patient").isNotNull()).alias(n) for n, code in self.causes.items()}
        patients = rows.groupBy("stratum", "patient").agg(*hit.values()).groupBy("stratum").agg(*(F.count_if(F.col(n)).alias(n) for n in self.causes))
        whole = rows.groupBy("stratum").agg(F.count("*").alias("events"), *(F.stddev_pop(f"x_{c}").alias(f"sd_{c}") for c in columns))
        counts = {r["stratum"]: r.asDict() for r in whole.collect()}  # one row per stratum, as is the next
        for r in patients.collect():
            counts[r["stratum"]].update(r.asDict())
        edges = self._edges(rows, columns)
        for s, r in counts.items():
            used = [c for c in columns if (r[f"sd_{c}"] or 0) > 1e-9]
            status = {n: "ok" if r[n] >= self.gates["fit_min_unique_events"] and used else "reduced_baseline_only" if r[n] >= self.gates["baseline_min_unique_events"] else "insufficient_events" for n in self.causes}
            self.models[s] = StratumModel(status, {n: int(r[n]) for n in self.causes}, used, {c: edges.get((s, c), np.empty(0)) for c in used})
        sizes = {s: int(r["events"]) for s, r in counts.items()}
        times = self._few_times(rows, [s for s in sizes if sizes[s] > self.local_rows and self._fitted(s)])
        self._fit_cells(rows, times)
        rest = [s for s in sizes if s not in times]
        if rest:
            chunks = stage(self._chunks(rows.filter(F.col("stratum").isin(rest))), "chunks")
            self._fit_local(chunks, [s for s in rest if sizes[s] <= self.local_rows])
            self._fit_spread(chunks, [s for s in rest if sizes[s] > self.local_rows])
        self._baselines: dict[tuple, DataFrame] = {}
        return self

    def _edges(self, rows: DataFrame, columns: list[str]) -> dict[tuple, np.ndarray]:
        """Upper edges of all bins but the last, per stratum and feature: midpoints between distinct values where these are at
        most ``bins``, else quantiles."""
        cells = {c: F.col(f"x_{c}") for c in columns}
        named = F.array(*(F.struct(F.lit(c).alias("name"), v.alias("value")) for c, v in cells.items()))
        values = rows.select("stratum", F.inline(named)).filter("value is not null").distinct()
        few = values.groupBy("stratum", "name").agg(F.count("*").alias("n")).filter(F.col("n") <= self.bins)
        out = {}
        listed = values.join(few, ["stratum", "name"]).groupBy("stratum", "name").agg(F.sort_array(F.collect_list("value")).alias("values"))  # at most ``bins`` values
        for r in listed.collect():
            v = np.asarray(r["values"])
            out[r["stratum"], r["name"]] = (v[:-1] + v[1:]) / 2
        for r in exact_quantiles(rows, cells, [i / self.bins for i in range(1, self.bins)], ["stratum"]).collect():
            out.setdefault((r["stratum"], r["name"]), np.unique(np.asarray(r["q"])))
        return out

    def _chunks(self, rows: DataFrame) -> DataFrame:
        columns = [f"x_{c}" for c in self.columns]
        models = {s: (m.columns, [m.edges[c] for c in m.columns]) for s, m in self.models.items()}
        shared = rows.sparkSession.sparkContext.broadcast(models)
        names, most = list(self.columns), self.chunk_rows

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa
            from pyspark import TaskContext

            part, no, held, parts, size = TaskContext.get().partitionId(), 0, None, [], 0

            def flush():
                used, edges = shared.value[held]
                times, events = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
                bins = [binned(np.concatenate([p[2][names.index(c)] for p in parts]), e) for c, e in zip(used, edges, strict=True)]
                packed = np.stack(bins).tobytes() if bins else b""
                return pa.RecordBatch.from_arrays([pa.array([held]), pa.array([part], pa.int32()), pa.array([no], pa.int32()), pa.array([len(times)]), pa.array([times.tobytes()], pa.binary()), pa.array([events.astype(np.int32).tobytes()], pa.binary()), pa.array([packed], pa.binary())], names=["stratum", "part", "no", "n", "times", "events", "bins"])

            for batch in batches:
                strata = batch.column(0).to_pylist()
                edges = [0, *(i for i in range(1, len(strata)) if strata[i] != strata[i - 1]), len(strata)]
                for lo, hi in zip(edges, edges[1:]):
                    for at in range(lo, hi, most):
                        to = min(hi, at + most)
                        if parts and (strata[at] != held or size + to - at > most):
                            yield flush()
                            parts, size, no = [], 0, no + 1
                        held = strata[at]
                        own = batch.slice(at, to - at)
                        parts.append((own.column(1).to_numpy(), own.column(2).to_numpy(), [own.column(3 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(names))]))
                        size += to - at
            if parts:
                yield flush()

        order = ["stratum", "time", F.xxhash64("patient", *columns)]
        dealt = rows.repartitionByRange(*order).sortWithinPartitions("stratum", "time")
        return dealt.select("stratum", "time", "event", *columns).mapInArrow(run, _CHUNKS)

    def _fitted(self, s: str) -> list[int]:
        return [code for n, code in self.causes.items() if self.models[s].status[n] == "ok"]

    def _keep(self, s: str, trees: Mapping[int, list[Tree]]) -> None:
        names = {code: n for n, code in self.causes.items()}
        self.models[s].trees = {names[c]: list(t) for c, t in trees.items()}

    def _fit_local(self, chunks: DataFrame, strata: list[str]) -> None:
        wanted = {s: (len(self.models[s].columns), self._fitted(s)) for s in strata if self._fitted(s)}
        if not wanted:
            return
        options = (self.trees, self.depth, self.rate, self.min_instances, self.bins)

        def run(key, table):
            import pickle

            import pyarrow as pa

            p, cause = wanted[key[0].as_py()][0], key[1].as_py()
            found = sorted(table.to_pylist(), key=lambda r: (r["part"], r["no"]))
            held = [_Chunk.of(r, p, {cause: summed((), options[2], options[1], options[4])}) for r in found]
            return pa.table({"stratum": [key[0].as_py()], "cause": pa.array([cause], pa.int32()), "trees": pa.array([pickle.dumps(_boost_local(held, cause, *options))], pa.binary())})

        causes = F.map_from_entries(F.array(*(F.struct(F.lit(s), F.array(*(F.lit(c) for c in causes))) for s, (_, causes) in wanted.items())))
        each = chunks.withColumn("cause", F.explode(F.element_at(causes, F.col("stratum"))))
        grown = each.filter(F.col("stratum").isin(*wanted)).groupBy("stratum", "cause").applyInArrow(run, "stratum string, cause int, trees binary")
        import pickle

        for r in grown.collect():  # the trees of each model
            self.models[r["stratum"]].trees[{code: n for n, code in self.causes.items()}[r["cause"]]] = pickle.loads(r["trees"])

    def _shape(self, s: str) -> list[int]:
        """Bins of each used feature."""
        m = self.models[s]
        return [len(m.edges[c]) + 1 for c in m.columns]

    def _few_times(self, rows: DataFrame, strata: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """Of the strata with few cells and times: the distinct times, and the events of every fitted cause at each."""
        room = {s: self.chunk_rows - math.prod(self._shape(s)) for s in strata}
        room = {s: n for s, n in room.items() if n > 0}
        if not room:
            return {}
        hits = [F.count_if(F.col("event") == code).alias(f"hits_{code}") for code in self.causes.values()]
        per_time = stage(rows.filter(F.col("stratum").isin(*room)).groupBy("stratum", "time").agg(*hits), "times")
        few = [r["stratum"] for r in per_time.groupBy("stratum").count().collect() if r["count"] <= room[r["stratum"]]]
        found: dict[str, list] = {s: [] for s in few}
        for r in per_time.filter(F.col("stratum").isin(few)).collect() if few else ():  # at most ``chunk_rows`` times a stratum
            found[r["stratum"]].append((r["time"], *(r[f"hits_{c}"] for c in self._fitted(r["stratum"]))))
        return {s: (np.asarray(sorted(x), float)[:, 0], np.asarray(sorted(x), float)[:, 1:].T) for s, x in found.items()}

    def _cells(self, rows: DataFrame, times: Mapping[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
        """Rows as packed arrays of the number of their time and of their cell."""
        models = {s: (t, [self.models[s].edges[c] for c in self.models[s].columns], [list(self.columns).index(c) for c in self.models[s].columns], self._shape(s)) for s, (t, _) in times.items()}
        shared, most = rows.sparkSession.sparkContext.broadcast(models), self.chunk_rows

        def pack(s: str, parts: list[tuple]):
            import pyarrow as pa

            arrays = [pa.array([np.concatenate(x).tobytes()], pa.binary()) for x in zip(*parts, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([s]), *arrays], names=["stratum", "times", "events", "cells"])

        def run(batches: Iterator) -> Iterator:
            held: dict[str, list[tuple]] = {}
            size: dict[str, int] = {}
            for batch in batches:
                strata = np.asarray(batch.column(0).to_pylist(), object)
                time, event = batch.column(1).to_numpy(), batch.column(2).to_numpy()
                values = [batch.column(3 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(batch.num_columns - 3)]
                for s, (known, edges, used, shape) in shared.value.items():
                    own = np.flatnonzero(strata == s)
                    if not len(own):
                        continue
                    cells = np.ravel_multi_index([binned(values[i][own], e) for i, e in zip(used, edges, strict=True)], shape)
                    held.setdefault(s, []).append((np.searchsorted(known, time[own]).astype(np.int32), event[own].astype(np.int32), cells.astype(np.int32)))
                    size[s] = size.get(s, 0) + len(own)
                    if size[s] >= most:
                        yield pack(s, held.pop(s))
                        size[s] = 0
            for s, parts in held.items():
                yield pack(s, parts)

        return rows.filter(F.col("stratum").isin(*times)).select("stratum", "time", "event", *(f"x_{c}" for c in self.columns)).mapInArrow(run, _CELLS)

    def _fit_cells(self, rows: DataFrame, times: Mapping[str, tuple[np.ndarray, np.ndarray]]) -> None:
        """Boost all models of the strata with few cells and times together, two jobs a round."""
        if not times:
            return
        context, bins = rows.sparkSession.sparkContext, self.bins
        cells = stage(self._cells(rows, times), "cells").coalesce(context.defaultParallelism)  # a task sends a number per cell and model
        causes = {s: self._fitted(s) for s in times}
        shape = {s: self._shape(s) for s in times}
        of_cell = {s: np.indices(n).reshape(len(n), -1) for s, n in shape.items()}

        def sums(call: Callable[[str, int, np.ndarray, np.ndarray], np.ndarray], keys: Mapping[str, Sequence[int]], own: DataFrame) -> dict[tuple, np.ndarray]:
            """Per stratum and key, what ``call`` gives for the chunks, summed; ``call`` takes two arrays of a chunk."""

            def run(batches: Iterator) -> Iterator:
                total: dict[tuple, np.ndarray] = {}
                for batch in batches:
                    for s, x, y in zip(*(batch.column(i) for i in range(3)), strict=True):
                        s, x, y = s.as_py(), np.frombuffer(x.as_buffer(), np.int32), np.frombuffer(y.as_buffer(), np.int32)
                        for k in keys[s]:
                            v = call(s, k, x, y)
                            total[s, k] = total[s, k] + v if (s, k) in total else v
                yield _records([(s, k, v.astype(float).tobytes()) for (s, k), v in total.items()], ["stratum", "cause", "sums"])

            out: dict[tuple, np.ndarray] = {}
            for r in own.mapInArrow(run, "stratum string, cause int, sums binary").collect():
                m, v = (r["stratum"], r["cause"]), np.frombuffer(r["sums"])
                out[m] = out[m] + v if m in out else v
            return out

        size = {s: math.prod(n) for s, n in shape.items()}
        length = {s: len(t) for s, (t, _) in times.items()}
        every = {s: [-1, *c] for s, c in causes.items()}  # -1: all rows
        rows_of = sums(lambda s, k, e, cell: np.bincount(cell if k < 0 else cell[e == k], minlength=size[s]), every, cells.select("stratum", "events", "cells"))
        at = cells.select("stratum", "times", "cells")
        models = [(s, c) for s in times for c in causes[s]]
        events = {(s, c): times[s][1][i] for s in times for i, c in enumerate(causes[s])}
        scores = {(s, c): np.zeros(size[s]) for s, c in models}
        trees: dict[tuple, list[Tree]] = {m: [] for m in models}
        for _ in range(self.trees):
            weight = {m: np.exp(x) for m, x in scores.items()}
            shared = context.broadcast(weight)
            per_time = sums(lambda s, k, t, cell: np.bincount(t, weights=shared.value[s, k][cell], minlength=length[s]), causes, at)  # noqa: B023
            shared.unpersist()
            hazard = {m: np.cumsum(events[m] / np.cumsum(per_time[m][::-1])[::-1]) for m in models}
            shared = context.broadcast(hazard)
            per_cell = sums(lambda s, k, t, cell: np.bincount(cell, weights=shared.value[s, k][t], minlength=size[s]), causes, at)  # noqa: B023
            shared.unpersist()
            for s, c in models:
                m, tree = (s, c), _empty_tree(self.depth)
                gradient = rows_of.get(m, 0.0) - weight[m] * per_cell[m]
                for level in range(max(self.depth, 1)):
                    if not split_level(tree, _cell_histogram(of_cell[s], gradient, rows_of[s, -1], tree if level else None, level, bins), level, self.min_instances, self.depth):
                        break
                trees[m].append(tree)
                scores[m] = scores[m] + self.rate * tree.value[tree.leaves(of_cell[s])]
        for s in times:
            self._keep(s, {c: trees[s, c] for c in causes[s]})

    def _fit_spread(self, chunks: DataFrame, strata: list[str]) -> None:
        """Boost all models of the large strata together, a job per kind of sum."""
        wanted = {s: (len(self.models[s].columns), self._fitted(s)) for s in strata if self._fitted(s)}
        if not wanted:
            return
        own = chunks.filter(F.col("stratum").isin(*wanted))
        depth, rate, bins = self.depth, self.rate, self.bins
        models = [(s, c) for s, (_, causes) in wanted.items() for c in causes]
        trees: dict[tuple, list[Tree]] = {m: [] for m in models}
        scores = {m: summed((), rate, depth, bins) for m in models}
        context = chunks.sparkSession.sparkContext

        def each(call: Callable[[_Chunk, int, tuple], np.ndarray], given: dict[tuple, dict] | None = None) -> dict[tuple, dict]:
            """Numbers per chunk of every model."""
            shared = context.broadcast((scores, given))

            def run(batches: Iterator) -> Iterator:
                held, arguments = shared.value
                for batch in batches:
                    out = []
                    for r in batch.to_pylist():
                        p, causes = wanted[r["stratum"]]
                        c = _Chunk.of(r, p, {k: held[r["stratum"], k] for k in causes})
                        key = (r["part"], r["no"])
                        out += [(r["stratum"], k, *key, np.asarray(call(c, k, arguments[r["stratum"], k][key] if arguments else ()), float).tobytes()) for k in causes]
                    yield _records(out, ["stratum", "cause", "part", "no", "sums"])

            found = own.mapInArrow(run, "stratum string, cause int, part int, no int, sums binary").collect()
            shared.unpersist()
            sums: dict[tuple, dict] = {m: {} for m in models}
            for r in found:
                sums[r["stratum"], r["cause"]][r["part"], r["no"]] = np.frombuffer(r["sums"])
            return sums

        def deeper(given: dict[tuple, dict], grown: dict[tuple, Tree], level: int) -> dict[tuple, np.ndarray]:
            """The histogram of a level, of the models whose trees were split above it; one sum per task and model."""
            shared = context.broadcast(({m: scores[m] for m in grown}, given, grown))

            def run(batches: Iterator) -> Iterator:
                held, arguments, open_ = shared.value
                total: dict[tuple, np.ndarray] = {}
                for batch in batches:
                    for r in batch.to_pylist():
                        s, p = r["stratum"], wanted[r["stratum"]][0]
                        causes = [k for k in wanted[s][1] if (s, k) in open_]
                        c = _Chunk.of(r, p, {k: held[s, k] for k in causes})
                        for k in causes:
                            h = c.histogram(c.gradient(k, *arguments[s, k][r["part"], r["no"]]), open_[s, k], level, bins)
                            total[s, k] = total[s, k] + h if (s, k) in total else h
                yield _records([(s, k, h.tobytes()) for (s, k), h in total.items()], ["stratum", "cause", "sums"])

            found = own.mapInArrow(run, "stratum string, cause int, sums binary").collect()
            shared.unpersist()
            out = {(s, k): np.zeros((2, 1 << level, wanted[s][0], bins)) for s, k in grown}
            for r in found:
                h = out[r["stratum"], r["cause"]]
                h += np.frombuffer(r["sums"]).reshape(h.shape)
            return out

        spans = each(lambda c, _, __: np.r_[c.times[0], c.times[-1], c.counts(bins)])
        keys = {m: sorted(spans[m]) for m in models}
        ends = {m: [np.asarray([spans[m][k][i] for k in keys[m]]) for i in (0, 1)] for m in models}
        counts = {m: sum(spans[m][k][2:] for k in keys[m]).reshape(-1, bins) for m in models}
        del spans
        for _ in range(self.trees):
            weights = each(lambda c, k, _: c.weights(k))
            risk = {m: dict(zip(keys[m], _at_risk(*ends[m], np.asarray([weights[m][k] for k in keys[m]])), strict=True)) for m in models}
            sums = each(lambda c, k, given: c.opening(k, *given, bins), risk)
            given, grown = {}, {m: _empty_tree(depth) for m in models}
            going = {}
            for m in models:
                x = np.asarray([sums[m][k] for k in keys[m]])
                beside = _hazards_beside(*ends[m], x[:, :2])
                given[m] = {k: (*risk[m][k], *b) for k, b in zip(keys[m], beside, strict=True)}
                local, weight, edge = x[:, 2:].reshape(len(x), 3, *counts[m].shape).transpose(1, 0, 2, 3)
                before, coming = (np.asarray(v)[:, None, None] for v in zip(*beside, strict=True))
                histogram = np.stack([(local - before * weight - coming * edge).sum(axis=0), counts[m]])[:, None]
                if split_level(grown[m], histogram, 0, self.min_instances, depth):
                    going[m] = grown[m]
            for level in range(1, depth):
                if not going:
                    break
                found = deeper({m: given[m] for m in going}, going, level)
                going = {m: t for m, t in going.items() if split_level(t, found[m], level, self.min_instances, depth)}
            for m in models:
                trees[m].append(grown[m])
                scores[m].add(grown[m], rate)
        for s, (_, causes) in wanted.items():
            self._keep(s, {c: trees[s, c] for c in causes})

    # -- use

    def support(self) -> Column:
        """Empty when a row can be scored, else why not."""
        s = F.col(self.stratum).cast("string")
        out = F.when(~F.coalesce(s.isin(*self.models), F.lit(False)), "unknown_device_or_route")
        for name, m in self.models.items():
            for cause, status in m.status.items():
                if status == "insufficient_events":
                    out = out.when(s == name, f"insufficient_events:{cause}")
        return out.otherwise("")

    def staged_scores(self, rows: DataFrame, at: Sequence[int] | None = None, stratum: str | None = None) -> DataFrame:
        """Adds ``scores``: per requested number of trees an array of log risks, one per cause (0 without a model)."""
        stages = list(at or [self.trees])
        if max(stages) > self.trees:
            raise ValueError("a stage exceeds the number of fitted trees")
        names, causes, key = list(self.columns), list(self.causes), stratum or self.stratum
        ends = sorted(set(stages))
        parts = {(s, j): [summed(m.trees[c][a:b], self.rate, self.depth, self.bins) for a, b in zip([0, *ends], ends)] for s, m in self.models.items() for j, c in enumerate(causes) if c in m.trees}
        shared = rows.sparkSession.sparkContext.broadcast(({s: (m.columns, m.edges) for s, m in self.models.items()}, parts))
        inputs = rows.withColumns({"__s": F.col(key).cast("string"), **{f"__x{i}": _number(F.col(c)) for i, c in enumerate(names)}})
        kept = rows.columns

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                n = batch.num_rows
                out = np.zeros((n, len(stages), len(causes)))
                strata = np.asarray(batch.column(len(kept)).to_pylist(), object)
                values = [batch.column(len(kept) + 1 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(names))]
                models, added = shared.value
                for s, (used, edges) in models.items():
                    own = np.flatnonzero(strata == s)
                    if not len(own) or not used:
                        continue
                    bins = np.stack([binned(values[names.index(c)][own], edges[c]) for c in used])
                    for j in range(len(causes)):
                        score = np.zeros(len(own))
                        for k, part in zip(ends, added.get((s, j), ())):
                            score = score + part(bins)
                            for i in (i for i, x in enumerate(stages) if x == k):
                                out[own, i, j] = score
                flat = pa.array(out.ravel())
                inner = pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(stages) * len(causes) + 1, len(causes), dtype=np.int32)), flat)
                outer = pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(stages) + 1, len(stages), dtype=np.int32)), inner)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], outer], names=[*kept, "scores"])

        from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

        schema = StructType([*rows.schema.fields, StructField("scores", ArrayType(ArrayType(DoubleType())))])
        return inputs.mapInArrow(run, schema)

    def baselines(self, stages: Sequence[int]) -> DataFrame:
        """(stratum, cause, trees, time, cumulative_hazard): Breslow on the training scores after each number of trees."""
        key = tuple(stages)
        if key not in self._baselines:
            scored = self.staged_scores(self.training.select("stratum", "time", "event", *(F.col(f"x_{c}").alias(c) for c in self.columns)), stages, "stratum")
            usable = [(s, n) for s, m in self.models.items() for n, status in m.status.items() if status != "insufficient_events"]
            each = F.array(*(
                F.struct(F.lit(n).alias("cause"), F.lit(int(k)).alias("trees"), (F.col("event") == code).cast("int").alias("hit"), F.exp(F.col("scores")[i][j]).alias("risk"))
                for j, (n, code) in enumerate(self.causes.items()) for i, k in enumerate(stages)
            ))
            keep = F.concat_ws("\x00", "stratum", "cause").isin(*(f"{s}\x00{n}" for s, n in usable)) if usable else F.lit(False)
            long = scored.select("stratum", "time", F.inline(each)).filter(keep)
            self._baselines[key] = stage(nelson_aalen(long, ["stratum", "cause", "trees"], "risk", 1, "time", "hit"), "baselines")
        return self._baselines[key]

    def _staged_hazards(self, rows: DataFrame, grid: Sequence[float], stages: Sequence[int]) -> DataFrame:
        """A row per row and number of trees, with the hazard arrays and ``support``."""
        on_grid = baseline_on_grid(self.baselines(stages), ["stratum", "cause", "trees"], grid)
        entry = F.struct(F.concat_ws("@", "cause", "trees"), F.col("h"))
        table = on_grid.groupBy(F.col("stratum").alias("__s")).agg(F.map_from_entries(F.collect_list(entry)).alias("__h"))  # causes x stages x grid
        scored = self.staged_scores(rows.withColumn("support", self.support()), stages)
        out = scored.join(broadcast_if_small(table, 1000, "grids"), F.col(self.stratum).cast("string") == F.col("__s"), "left")
        out = out.select(*rows.columns, "support", "__h", F.posexplode("scores").alias("__at", "__scores")).withColumn("trees", F.array(*(F.lit(int(k)) for k in stages))[F.col("__at")])
        zero = F.array(*(F.lit(0.0) for _ in grid))  # supported, with no event of the cause by the end of the grid
        for j, name in enumerate(self.causes):
            h = F.coalesce(F.try_element_at("__h", F.concat_ws("@", F.lit(name), F.col("trees"))), zero)
            risk = F.exp(F.col("__scores")[j])
            out = out.withColumn(name, F.when(F.col("support") == "", F.transform(h, lambda x: x * risk)))  # noqa: B023
        return out.drop("__h", "__at", "__scores")

    def hazards(self, rows: DataFrame, grid: Sequence[float], trees: int | None = None) -> DataFrame:
        """Adds an array per cause, the cumulative hazard on the grid, and ``support``; unsupported rows get NULL, never 0."""
        return self._staged_hazards(rows, grid, [trees or self.trees]).drop("trees")

    def probabilities(self, rows: DataFrame, grid: Sequence[float], horizons: Sequence[float], stages: Sequence[int] | None = None) -> DataFrame:
        """(row_id, trees, horizon, probabilities of the states) of supported rows, one set per number of trees."""
        causes = list(self.causes)
        h = self._staged_hazards(rows.select("row_id", self.stratum, *self.columns), grid, list(stages or [self.trees])).filter("support = ''")
        each = h.select(F.struct("row_id", "trees").alias("row_id"), *causes)
        out = cif.at_horizons(cif.combine(each, causes), grid, horizons, causes)
        return out.select("row_id.row_id", "row_id.trees", *(c for c in out.columns if c != "row_id"))


def _number(c: Column) -> Column:
    x = c.cast("double")
    return F.when(~F.isnan(x), x + F.lit(0.0))


def binned(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The bin of each value: the number of edges below it; missing values lie in the lowest."""
    return np.where(np.isnan(values), 0, np.searchsorted(edges, values, side="left")).astype(np.uint8)


def _records(rows: list[tuple], names: list[str]):
    import pyarrow as pa

    types = {"stratum": pa.string(), "cause": pa.int32(), "part": pa.int32(), "no": pa.int32(), "sums": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[n]) for i, n in enumerate(names)], names=names)
