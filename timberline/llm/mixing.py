"""Mixing sources to target weights by hierarchical budgeting.

A token budget is propagated down a domain-language-source tree in proportion to the nodes' weights. No leaf takes more
than ``max_epochs`` times its tokens; what a node cannot use goes to its siblings first (in proportion to their weights)
and reaches the siblings of an ancestor only when the whole subtree is full. Each leaf then takes whole seeded epochs and a
token-prefix of one more: documents in the order of a seeded hash, up to and including the first that reaches the budget.

Only per-leaf totals, bounded by the tree, reach the driver. The cut of a leaf is found digit by digit (token sums of 256
hash buckets per leaf, three times, then the rows of the last bucket), so no leaf is ever sorted as a whole, and the
chosen rows follow from the cut without a shuffle of texts.

Defined results: a null text has no tokens; documents without tokens ride along with the epochs that cover them; null
labels are a node of their own; rows with the same id (or, without one, the same text) share a
place in the order and are taken together; an empty
table or a zero budget gives no rows. Columns other than the labels pass through.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.common import stage

#: Radix digits (of 8 bits) by which the cut of a leaf is narrowed before rows are looked at one by one.
LEVELS = 3
#: The tree is a configuration; labels that make it larger than this are an error, never cut.
MOST_LEAVES = 1_000_000
Path = tuple[str | None, ...]


def water_fill(budget: float, weights: Mapping, capacity: Mapping) -> dict:
    """Split a budget in proportion to weights under capacities; what one cannot hold goes to the others."""
    given = dict.fromkeys(weights, 0.0)
    active = {k for k in weights if weights[k] > 0 and capacity[k] > 0}
    ordered = [k for k in weights if k in active]  # sums in one order, whatever the hash seed
    left = min(budget, sum(capacity[k] for k in ordered))
    while active and left > 1e-9:
        ordered = [k for k in ordered if k in active]
        total = sum(weights[k] for k in ordered)
        full = {k for k in ordered if given[k] + left * weights[k] / total >= capacity[k]}
        if not full:
            for k in ordered:
                given[k] += left * weights[k] / total
            break
        for k in (k for k in ordered if k in full):
            left -= capacity[k] - given[k]
            given[k] = float(capacity[k])
        active -= full
    return given


def budgets(supply: Mapping[Path, int], weight_of, total: float, max_epochs: float) -> dict[Path, float]:
    """The budget of every leaf. ``weight_of(path)`` is the weight of a node among its siblings."""
    capacity: dict[Path, float] = {}
    children: dict[Path, set[Path]] = {}
    for leaf, tokens in supply.items():
        for depth in range(len(leaf), -1, -1):
            capacity[leaf[:depth]] = capacity.get(leaf[:depth], 0.0) + tokens * max_epochs * (weight_of(leaf) > 0 or depth < len(leaf))
            if depth:
                children.setdefault(leaf[: depth - 1], set()).add(leaf[:depth])
    out: dict[Path, float] = {}

    def spread(node: Path, budget: float) -> None:
        if node not in children:
            out[node] = budget
            return
        below = sorted(children[node], key=repr)
        for child, share in water_fill(budget, {c: weight_of(c) for c in below}, {c: capacity[c] for c in below}).items():
            spread(child, share)

    if supply:
        spread((), min(total, capacity[()]))
    return out


def mix_sources(
    docs: DataFrame,
    labels: Mapping[str, Column],
    weight_of=lambda path: 1.0,
    total_tokens: float | None = None,
    max_epochs: int = 4,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The mixture: the rows of ``docs``, repeated once per epoch that takes them, with ``__epoch`` and ``__n_tokens``.

    ``labels`` names the levels of the tree, top first. ``total_tokens`` defaults to the tokens there are.
    """
    spark = docs.sparkSession
    names = list(labels)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # words: white-space runs between other characters
    tokens = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    leaf = F.struct(*(labels[n].cast("string").alias(n) for n in names))
    ident = F.col(f"`{id_col}`")
    key = F.xxhash64(ident, F.when(ident.isNull(), text))
    narrow = stage(docs.select(leaf.alias("leaf"), key.alias("key"), tokens.alias("tokens")), "tokens")
    leaves = narrow.groupBy("leaf").agg(F.sum("tokens").alias("tokens")).limit(MOST_LEAVES + 1).collect()
    if len(leaves) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} leaves: group the labels")
    supply = {tuple(r["leaf"]): int(r["tokens"]) for r in leaves}
    share = budgets(supply, weight_of, sum(supply.values()) if total_tokens is None else total_tokens, max_epochs)
    rows = []
    for path, budget in share.items():
        whole = int(budget // supply[path]) if supply[path] else int(budget > 0)
        whole = min(whole, max_epochs)
        rows.append((*path, whole, float(budget - whole * supply[path]) if supply[path] else 0.0))
    schema = ", ".join(f"`{n}` string" for n in names) + ", whole int, rest double"
    plan = spark.createDataFrame(rows, schema).select(F.struct(*names).alias("leaf"), "whole", "rest")

    def at(epoch: Column) -> Column:
        return F.xxhash64(F.lit(seed), epoch, F.col("key"))

    placed = _with_plan(narrow, plan).filter("rest > 0").select("leaf", "rest", "tokens", at(F.col("whole")).alias("at"))
    state = plan.filter("rest > 0").select("leaf", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    for level in range(1, LEVELS + 1):
        # one radix digit nearer to the cut: token sums of 256 buckets per leaf, and the bucket that crosses the budget
        prefix = F.shiftrightunsigned(F.col("at"), 64 - 8 * level)
        within = _with_plan(placed, state).filter(F.shiftrightunsigned(prefix, 8) == F.col("prefix"))
        sums = within.groupBy("leaf", "before", "rest", prefix.alias("bucket")).agg(F.sum("tokens").alias("tokens"))
        upto = F.sum("tokens").over(Window.partitionBy("leaf").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        state = stage(
            sums.withColumn("upto", F.col("before") + upto)
            .filter((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("tokens") < F.col("rest")))
            .groupBy("leaf")
            .agg(F.min("bucket").alias("prefix"), F.min(F.col("upto") - F.col("tokens")).alias("before")),
            "radix",
        )
    # places are compared as unsigned numbers, by flipping the sign bit
    unsigned = lambda c: c.bitwiseXOR(F.lit(-(1 << 63)))
    inside = _with_plan(placed, state).filter(F.shiftrightunsigned(F.col("at"), 64 - 8 * LEVELS) == F.col("prefix")).groupBy("leaf", "at", "rest", "before").agg(F.sum("tokens").alias("tokens"))
    in_order = Window.partitionBy("leaf").orderBy(unsigned(F.col("at"))).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = (
        inside.withColumn("upto", F.col("before") + F.sum("tokens").over(in_order))
        .filter(F.col("upto") - F.col("tokens") < F.col("rest"))
        .groupBy("leaf")
        .agg(F.max(unsigned(F.col("at"))).alias("cut"))
    )
    final = stage(plan.join(cuts.withColumnRenamed("leaf", "l"), F.col("leaf").eqNullSafe(F.col("l")), "left").select("leaf", "whole", "cut"), "cuts")
    carried = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), leaf.alias("leaf"), key.alias("key"), tokens.alias("tokens"))
    partial = F.coalesce(unsigned(at(F.col("whole"))) <= F.col("cut"), F.lit(False))
    copies = F.col("whole") + partial.cast("int")
    return _with_plan(carried, final).filter(copies > 0).select("row.*", F.explode(F.sequence(F.lit(0), copies - 1)).alias("__epoch"), F.col("tokens").alias("__n_tokens"))


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Join the per-leaf plan. It has one row per leaf of the configured tree, so it is broadcast while it stays small."""
    plan = plan.select(F.col("leaf").alias("__leaf"), *(c for c in plan.columns if c != "leaf"))
    if plan.limit(100_001).count() <= 100_000:
        plan = F.broadcast(plan)
    return rows.join(plan, F.col("leaf").eqNullSafe(F.col("__leaf"))).drop("__leaf")
