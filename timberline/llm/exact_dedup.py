"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest: one row per distinct normalised text, with the id that stays and the
batch that brought it. A batch is digested, reduced to one row per digest (map-side, so a text that fills a third of the
batch shuffles as one row per task), anti-joined with the index by sort-merge, and the new digests are appended. The index
side of that join is read in bucket order and not shuffled.

Defined results: a null text counts as empty; texts are equal when identical after lower-casing A-Z; of equal texts of one
batch the largest id stays (nulls lose; all null: null stays); a text an earlier batch brought keeps that batch's id, so all
its rows in the batch are duplicates. A batch that is run again under its own name (after a failure, say) gets the verdicts
of its first run and appends nothing twice. Rows that repeat an id and its text share one verdict. A very long text is
digested whole, and only its digest is shuffled. An empty batch appends nothing. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import lower_ascii, salted_lookup, stage


class DigestIndex:
    """A bucketed, sorted digest table in the warehouse that outlives sessions."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = 48) -> None:
        self.spark, self.name, self.buckets = spark, name, buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def create(self) -> None:
        """An empty index, unless there is one."""
        if not self.exists():
            self._write(self.spark.createDataFrame([], "digest binary, keep_id long, batch string"))

    def append(self, rows: DataFrame) -> None:
        # dealt by bucket, so an append writes one file a bucket, however many tasks there are
        self._write(rows.repartition(self.buckets, F.pmod(F.hash("digest"), F.lit(self.buckets))))

    def _write(self, rows: DataFrame) -> None:
        rows.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def ingest(self, docs: DataFrame, batch: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
        """Judge a batch against the index and append what is new. Returns the digest of each row (doc_id, digest), and one
        row per digest of the batch: digest, keep_id, n (rows of the batch), new."""
        text = lower_ascii(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
        digests = stage(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest")), "digests")
        groups = stage(digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n")), "groups")
        self.create()
        done = self.table().filter(F.col("batch") == batch).limit(1).count()  # an append is there as a whole or not at all
        earlier = self.table().filter(F.col("batch") != batch)
        fresh = groups.hint("merge").join(earlier.select("digest"), "digest", "left_anti").withColumn("new", F.lit(True))
        known = groups.drop("keep_id").hint("merge").join(earlier.select("digest", "keep_id"), "digest").withColumn("new", F.lit(False))
        judged = stage(fresh.unionByName(known), "judged")
        if not done:
            self.append(judged.filter("new").select("digest", "keep_id", F.lit(batch).alias("batch")))
        return digests, judged

    def deduplicate(self, docs: DataFrame, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row per row of a batch: doc_id, keep_id, group_size (rows of the batch with this text), kept, text_sha256."""
        digests, judged = self.ingest(docs, batch or uuid.uuid4().hex, id_col, text_col)
        return verdicts(digests, judged, F.col("new"))

    def deduplicate_batches(self, batches: Iterable[DataFrame], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Batches one after the other, as they would arrive; ``group_size`` counts the rows of all of them."""
        name = uuid.uuid4().hex
        done = [self.ingest(docs, f"{name}-{k}", id_col, text_col) for k, docs in enumerate(batches)]
        digests = reduce(DataFrame.unionByName, (d.withColumn("batch", F.lit(k)) for k, (d, _) in enumerate(done)))
        judged = reduce(DataFrame.unionByName, (j.withColumn("batch", F.lit(k)) for k, (_, j) in enumerate(done)))
        # one id stays of a digest, the one its first batch brought or the index held, so keep_id is the same in all batches
        first = F.min(F.when(F.col("new"), F.col("batch"))).alias("first")
        totals = judged.groupBy("digest").agg(F.first("keep_id", ignorenulls=True).alias("keep_id"), F.sum("n").alias("n"), first)
        return verdicts(digests, totals, F.coalesce(F.col("batch") == F.col("first"), F.lit(False)))


def verdicts(digests: DataFrame, judged: DataFrame, new: Column) -> DataFrame:
    """Hand the verdict of a digest to its rows; the rows of a frequent text are dealt to many tasks by their ids."""
    drop = [c for c in judged.columns if c in digests.columns and c != "digest"]
    return salted_lookup(digests, "digest", judged.drop(*drop), F.col("doc_id")).select(
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        (new & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
