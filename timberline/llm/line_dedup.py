"""Line deduplication by site-relative frequency [native].

Lines are counted per host: the pages of the host that contain the line, divided by the host's pages. Lines beyond the
boilerplate ratio leave every page of that host. Only 64-bit line hashes are exploded and shuffled; texts stay where they
were read. A host has at most (mean distinct lines per page / ratio) boilerplate lines, so its set is a small array.

Defined results: null and empty texts pass unchanged; blank lines are never counted nor dropped; a null host is a host of
its own; repeated rows count as pages of their own; a host with fewer than ``min_pages`` pages loses nothing. A text all
of whose lines go becomes empty; the row stays. Columns other than the text pass through, whatever their names.

With ``copies_once`` the pages of a host that hold the same set of lines count as one page, for its lines and for its total,
so exact copies of a document do not make its lines boilerplate. Near copies still count each. ``min_count`` is a floor on a
line's own pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import stage

#: Beyond this size the host sets are joined by a shuffle that adaptive execution may split, not broadcast.
BROADCAST_BYTES = 8 << 20


def _hash_of(line: Column) -> Column:
    """A hash of the line without outer white space; null for a blank line."""
    bare = F.btrim(line, F.lit(" \t\r\x0b\x0c"))
    return F.when(bare != "", F.xxhash64(bare))


def _line_hashes(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), _hash_of)


def boilerplate(docs: DataFrame, host: Column, text_col: str = "text", ratio: float = 0.08, min_pages: int = 20, min_count: int = 1, copies_once: bool = False) -> DataFrame:
    """Per host with boilerplate: ``host`` and ``lines``, the hashes of its boilerplate lines with their page counts."""
    hashes = F.coalesce(F.array_distinct(F.array_compact(_line_hashes(F.col(f"`{text_col}`")))), F.array().cast("array<bigint>"))
    if copies_once:  # copies meet map-side, so a large group shuffles as one row per task
        pages = docs.select(host.alias("host"), F.array_sort(hashes).alias("hashes")).distinct()
    else:
        pages = docs.select(host.alias("host"), hashes.alias("hashes"))
    # the page itself is counted under a null line, so that one shuffle gives both counts
    counted = pages.select("host", F.explode(F.concat(F.array(F.lit(None).cast("long")), F.col("hashes"))).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    counted = stage(counted.filter(f"line is null or n >= {max(ratio * min_pages, min_count)}"), "lines")
    totals = counted.filter("line is null").select(F.col("host").alias("h"), F.col("n").alias("pages"))
    common = (
        counted.filter("line is not null")
        .join(totals, F.col("host").eqNullSafe(F.col("h")))
        .filter((F.col("pages") >= min_pages) & (F.col("n") > F.lit(ratio) * F.col("pages")))
    )
    return common.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("line", "n", "pages"))).alias("lines"))


def drop_boilerplate(docs: DataFrame, host: Column, text_col: str = "text", ratio: float = 0.08, min_pages: int = 20, min_count: int = 1, copies_once: bool = False, report: bool = False) -> DataFrame:
    """``docs`` with boilerplate lines removed from the text; with ``report`` also ``n_lines`` and ``n_dropped``."""
    spark = docs.sparkSession
    sets = stage(boilerplate(docs, host, text_col, ratio, min_pages, min_count, copies_once).select(F.col("host").alias("__host"), F.transform("lines", lambda x: x["line"]).alias("__gone")), "boilerplate")
    size = sets.agg(F.coalesce(F.sum(8 * F.size("__gone") + 64 + F.coalesce(F.octet_length(F.col("__host").cast("string")), F.lit(0))), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        sets = F.broadcast(sets)
    joined = docs.withColumn("__own_host", host).join(sets, F.col("__own_host").eqNullSafe(F.col("__host")), "left")
    text = F.col(f"`{text_col}`")
    hashes = _line_hashes(text)
    hit = F.col("__gone").isNotNull() & F.arrays_overlap(F.array_compact(hashes), F.col("__gone"))
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x: F.coalesce(~F.array_contains(F.col("__gone"), _hash_of(x)), F.lit(True))), "\n")
    columns = [F.col(f"`{c}`") if c != text_col else F.when(F.coalesce(hit, F.lit(False)), kept).otherwise(text).alias(c) for c in docs.columns]
    if report:
        before = F.size(F.array_compact(hashes))
        gone = F.size(F.filter(F.array_compact(hashes), lambda x: F.array_contains(F.col("__gone"), x)))
        columns += [
            F.when(text.isNull(), 0).otherwise(before).cast("long").alias("n_lines"),
            F.when(F.coalesce(hit, F.lit(False)), gone).otherwise(0).cast("long").alias("n_dropped"),
        ]
    return joined.select(*columns)
