"""Staging in the shared folder, and prefix sums that no single task has to compute."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder all executors share (``spark.checkpoint.dir``; in a local session without one, beside the
    warehouse). Removed when the application ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    root = root or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    path = f"{root.rstrip('/')}/timberline-{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later passes do not recompute it, and a lost executor loses none of
    it."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, most: int = 100_000, name: str = "side") -> DataFrame:
    """``df``, written out, and marked for broadcast when it has at most ``most`` rows; else left to a shuffled join."""
    written = stage(df, name)
    return F.broadcast(written) if written.limit(most + 1).count() <= most else written


def salted_lookup(rows: DataFrame, key: str, table: DataFrame, salt: Column, often: int | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``table`` (unique by ``key``) that deals the rows of a frequent key to many tasks: the table meets
    one row per key and salt, and these meet the rows. With ``often``, only keys of more rows than that are dealt out, so that
    the table's other rows travel once."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = F.pmod(F.xxhash64(salt), F.lit(n))
    if often is not None:
        rows = stage(rows, "lookups")
        counts = rows.groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") > often).select(F.col(key).alias("__hot"))
        rows = rows.join(broadcast_if_small(counts, name="hot"), F.col(key) == F.col("__hot"), "left")
        number = F.when(F.col("__hot").isNotNull(), number).otherwise(F.lit(0).cast("long"))
    salted = rows.withColumn("__salt", number).drop("__hot")
    meeting = salted.select(key, "__salt").distinct().join(table, key)
    return salted.join(meeting, [key, "__salt"]).drop("__salt")


def equal_keys(left: Sequence[str], right: Sequence[str]) -> Column:
    """Join condition over key columns; nulls are equal to each other."""
    on = F.lit(True)
    for a, b in zip(left, right, strict=True):
        on = on & F.col(a).eqNullSafe(F.col(b))
    return on


def last_before(marks: DataFrame, knots: DataFrame, group: Sequence[str], time: str, value: str, out: str, strict: bool = False, partitions: int | None = None) -> DataFrame:
    """Adds to ``marks`` (group columns and ``time``) the value of the last knot on or before their time, or strictly before it.

    Knots and marks are range-partitioned together by group and time, and the last value is carried inside a partition; what
    a partition begins with is the last value of the group's earlier ones (one row per partition and group). So the work is
    one sort, whatever the number of distinct times.
    """
    spark = marks.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = F.lit(1 if strict else -1)
    both = marks.select(*group, time, F.lit(0).alias("__kind"), F.lit(None).cast(dict(knots.dtypes)[value]).alias("__v")).unionByName(knots.select(*group, F.col(time).cast(dict(marks.dtypes)[time]).alias(time), kind.alias("__kind"), F.col(value).alias("__v")))
    ranged = stage(both.repartitionByRange(n, *group, time).withColumn("__part", F.spark_partition_id()), "knots")
    known = F.when(F.col("__kind") != 0, F.struct("__v"))
    local = Window.partitionBy("__part", *group).orderBy(time, "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranged.groupBy(*group, "__part").agg(F.max_by(known, F.when(F.col("__kind") != 0, F.struct(time, "__kind"))).alias("__l"))
    carried = carried.select(F.col("__part").alias("__q"), *(F.col(g).alias(f"__{g}") for g in group), F.last("__l", ignorenulls=True).over(earlier).alias("__c"))
    found = ranged.withColumn("__own", F.last(known, ignorenulls=True).over(local)).filter("__kind = 0")
    joined = found.join(carried, (F.col("__part") == F.col("__q")) & equal_keys(group, [f"__{g}" for g in group]))
    return joined.select(*group, time, F.coalesce("__own", "__c")["__v"].alias(out))


def ranged(df: DataFrame, group: Sequence[str], order: str, partitions: int | None = None) -> DataFrame:
    """``df`` dealt by ranges of group and order, with the number of its range as ``__part``, and written: a file may be read
    back in other splits, the number stays. Ties of group and order may not be spread, so ``order`` is distinct in a group."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(df.repartitionByRange(n, *group, order).withColumn("__part", F.spark_partition_id()), "ranged")


def within(group: Sequence[str], order: str, backward: bool = False, before: bool = False):
    """A window over a range's own rows of a group up to the row at hand, or up to the one before it."""
    w = Window.partitionBy("__part", *group).orderBy(F.desc(order) if backward else F.asc(order))
    return w.rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)


def carried(ranged_rows: DataFrame, totals: DataFrame, group: Sequence[str], carries: dict[str, Callable], backward: bool = False) -> DataFrame:
    """Joins to each row what the ranges before its own hand over. ``totals`` has one row per range and group; ``carries`` are
    taken in order over the window of a group's earlier ranges (with ``backward``, of its later ones), so that one may use
    another."""
    w = Window.partitionBy(*group).orderBy(F.desc("__part") if backward else F.asc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    for name, value in carries.items():
        totals = totals.withColumn(name, value(w))
    side = totals.select(F.col("__part").alias("__q"), *(F.col(g).alias(f"__{g}") for g in group), *carries)
    return ranged_rows.join(side, (F.col("__part") == F.col("__q")) & equal_keys(group, [f"__{g}" for g in group])).drop("__q", *(f"__{g}" for g in group))


def prefix_sum(df: DataFrame, group: Sequence[str], order: str, values: dict[str, str], partitions: int | None = None) -> DataFrame:
    """Sums over the rows before and including each row, per group and in the order of ``order`` (unique within a group).

    Rows are range-partitioned by group and order; each partition is summed on its own and the totals of earlier
    partitions (one row per partition and group) are added, so a group may span any number of tasks.
    """
    rows = ranged(df, group, order, partitions)
    totals = rows.groupBy(*group, "__part").agg(*(F.sum(v).alias(f"__t_{k}") for k, v in values.items()))
    before = {f"__b_{k}": (lambda w, k=k: F.coalesce(F.sum(f"__t_{k}").over(w), F.lit(0))) for k in values}
    summed = carried(rows.select("*", *(F.sum(v).over(within(group, order)).alias(f"__s_{k}") for k, v in values.items())), totals, group, before)
    return summed.select(*df.columns, *((F.col(f"__s_{k}") + F.col(f"__b_{k}")).alias(k) for k in values))


def exact_quantiles(rows: DataFrame, columns: Mapping[str, Column], probabilities: Sequence[float], group: Sequence[str] = ()) -> DataFrame:
    """(group columns, ``name``, ``n``, ``q``): linearly interpolated quantiles of every named column, exact, nulls left out.

    Values are counted, their counts summed along range partitions, and the values at the wanted ranks picked out: no task
    holds the distinct values of a group, and all groups, columns and probabilities go together.
    """
    named = F.array(*(F.struct(F.lit(k).alias("name"), (c.cast("double") + F.lit(0.0)).alias("value")) for k, c in columns.items()))
    counts = rows.select(*group, F.inline(named)).filter("value is not null").groupBy(*group, "name", "value").agg(F.count("*").alias("__n"))
    keys = [*group, "name"]
    upto = prefix_sum(counts, keys, "value", {"__upto": "__n"})
    sizes = upto.groupBy(*keys).agg(F.max("__upto").alias("n")).select(*(F.col(k).alias(f"__{k}") for k in keys), "n")
    sized = upto.join(sizes, equal_keys(keys, [f"__{k}" for k in keys]))
    at = lambda r: F.max(F.when((F.col("__upto") > r) & (F.col("__upto") - F.col("__n") <= r), F.col("value")))
    places = [F.lit(float(p)) * (F.col("n") - 1) for p in probabilities]
    picked = sized.groupBy(*keys, "n").agg(*(x for i, p in enumerate(places) for x in (at(F.floor(p)).alias(f"__l{i}"), at(F.ceil(p)).alias(f"__h{i}"))))
    value = lambda i, p: F.col(f"__l{i}") + (F.col(f"__h{i}") - F.col(f"__l{i}")) * (p - F.floor(p))
    return picked.select(*keys, "n", F.array(*(value(i, p) for i, p in enumerate(places))).alias("q"))


def quantile_table(rows: DataFrame, columns: Mapping[str, Column], probabilities: Sequence[float]) -> dict[str, list[float]]:
    """Exact quantiles of whole columns, on the driver: one list per column that has a value."""
    return {r["name"]: list(r["q"]) for r in exact_quantiles(rows, columns, probabilities).collect()}
