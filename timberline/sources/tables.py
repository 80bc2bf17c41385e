"""Reading and writing cohorts, snapshots, aggregates and comparison artefacts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.operators.profile import SnapshotRejected
from timberline.schema import TABLES, nan_to_null

COHORT = ("patients", "echoes", "labs", "exposures", "events")
READERS = {".parquet": ("parquet", {}), ".csv": ("csv", {"header": True}), ".tsv": ("csv", {"header": True, "sep": "\t"}), ".jsonl": ("json", {}), ".ndjson": ("json", {})}


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Read a table by its suffix; an unknown suffix is an error. Text formats are read as strings without a schema."""
    suffix = next((s for s in READERS if path.rstrip("/").lower().endswith(s)), None)
    if suffix is None:
        raise ValueError(f"unknown table format: {path}")
    kind, options = READERS[suffix]
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema else reader).format(kind).load(path)


def save_cohort(tables: Mapping[str, DataFrame], folder: str, truth: Mapping[str, DataFrame] | None = None) -> None:
    """One parquet folder per table; evaluation-only tables in a folder of their own."""
    for name, df in tables.items():
        nan_to_null(df).write.mode("overwrite").parquet(f"{folder}/{name}")
    for name, df in (truth or {}).items():
        nan_to_null(df).write.mode("overwrite").parquet(f"{folder}/truth/{name}")


def load_cohort(spark: SparkSession, folder: str, names: Sequence[str] = COHORT) -> dict[str, DataFrame]:
    """The predictor-visible tables with their schemas; absent columns are NULL, NaN becomes NULL."""
    out = {}
    for name in names:
        df = spark.read.parquet(f"{folder}/{name}")
        wanted = [x.split() for x in TABLES[name].split(", ")]
        cols = [F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in wanted]
        extra = [F.col(c) for c in df.columns if c not in {c for c, _ in wanted}]
        out[name] = nan_to_null(df.select(*cols, *extra))
    return out


def check_snapshot(manifest: Mapping, require_frozen: bool = True, require_lineage: bool = True) -> None:
    if manifest.get("source_kind") == "real_with_synthetic_defaults" or manifest.get("purpose") == "pipeline_test":
        raise SnapshotRejected("scaffold snapshots are no observed evidence")
    if require_frozen and not (manifest.get("published") and manifest.get("frozen")):
        raise SnapshotRejected("the snapshot is not published and frozen")
    if require_lineage and not manifest.get("lineage_complete"):
        raise SnapshotRejected("the snapshot does not declare complete lineage")


def load_snapshot(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """persons, observations and partition of a snapshot folder whose manifest passes the checks."""
    manifest = spark.read.option("multiLine", True).json(f"{folder}/manifest.json").first().asDict(recursive=True)
    check_snapshot(manifest)
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in ("persons", "observations", "partition")}


def write_aggregate(df: DataFrame, path: str, source: str, definition: str, identifier: str = "Patient_") -> DataFrame:
    """Write an aggregate as CSV with a provenance sidecar, read it back and verify header and privacy; returns the sidecar."""
    spark = df.sparkSession
    df.write.mode("overwrite").option("header", True).csv(path)
    back = spark.read.option("header", True).csv(path)
    if back.columns and back.columns != df.columns:
        raise ValueError(f"{path} reads back with columns {back.columns}")
    leak = F.lit(False)
    for c in back.columns:
        leak = leak | F.coalesce(F.contains(F.col(f"`{c}`"), F.lit(identifier)), F.lit(False))
    n, leaks = back.agg(F.count("*"), F.coalesce(F.sum(leak.cast("long")), F.lit(0))).first()
    if leaks:
        raise ValueError(f"{path} holds identifiers")
    meta = spark.createDataFrame([(path.rstrip("/").split("/")[-1], source, definition, df.columns, int(n), "Cells with a true count under 5 are shown as '<5'.")], "table string, source string, definition string, columns array<string>, row_count long, small_cell_suppression string")
    meta.write.mode("overwrite").json(f"{path}.meta")
    return meta


def verify_aggregates(spark: SparkSession, paths: Sequence[str], identifier: str = "Patient_") -> DataFrame:
    """(path, problem) for aggregates whose header or row count differs from the sidecar, or that hold identifiers."""
    out = []
    for p in paths:
        meta = spark.read.json(f"{p}.meta").first()
        df = spark.read.option("header", True).csv(p)
        leak = F.lit(False)
        for c in df.columns:
            leak = leak | F.coalesce(F.contains(F.col(f"`{c}`"), F.lit(identifier)), F.lit(False))
        n, leaks = df.agg(F.count("*"), F.coalesce(F.sum(leak.cast("long")), F.lit(0))).first()
        out += [(p, x) for x, bad in (("header", df.columns != list(meta["columns"])), ("row_count", n != meta["row_count"]), ("identifier", leaks > 0)) if bad]
    return spark.createDataFrame(out, "path string, problem string")


def write_comparison(paired: DataFrame, results: DataFrame, coverage: DataFrame, folder: str) -> None:
    """Paired rows, metrics and coverage of a rule/model comparison."""
    paired.write.mode("overwrite").parquet(f"{folder}/paired_rows")
    results.write.mode("overwrite").option("header", True).csv(f"{folder}/metrics")
    coverage.write.mode("overwrite").json(f"{folder}/coverage")


def table_hash(df: DataFrame) -> DataFrame:
    """Order-free hash of a table: row count and exclusive or of row hashes, each the first 60 bits of the md5 of the cells.
    Cells are text; floating numbers count in millionths, and a null is a mark of its own, so other engines can repeat it."""
    cells = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        text = F.round(c * 1_000_000).cast("long") if kind in ("double", "float") or kind.startswith("decimal") else F.unix_millis(c.cast("timestamp")) if kind.startswith("timestamp") else c
        cells.append(F.coalesce(text.cast("string"), F.lit("~")))
    row = F.md5(F.concat_ws("|", *cells).cast("binary"))
    return df.agg(F.count("*").alias("n"), F.bit_xor(F.conv(F.substring(row, 1, 15), 16, 10).cast("long")).alias("hash"))
