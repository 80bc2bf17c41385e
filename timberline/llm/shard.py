"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``virtual_nodes`` points of a 64-bit ring. A row hashes to a ring position and belongs to the next point
clockwise; rows that overflow a full shard continue clockwise to the next point whose shard has room. The bounds add up to
the number of rows and differ by one at most, so the counts of any two shards differ by one at most (law ``rows``), while
all rows that found room at home stay where plain consistent hashing puts them.

Rows are served by ring position, one virtual node of distance per round, so the result depends on the rows alone. What
the driver handles is the row count of each ring cell (at most ``max_cells`` of them, however many rows there are); rows
learn their shard by joining their cell's few intervals of ranks.

Defined results: a null text has 0 bytes; a null id hashes by its text; repeated rows are placed one by one; rows that tie
on the ring are served by id, size and checksum; a very long text is one row, whose bytes are measured and not moved; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.common import mix

_TOP = 1 << 32


def ring(shards: int, virtual_nodes: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 32-bit positions of the virtual nodes, and the shard that owns each."""
    number = np.arange(shards * virtual_nodes, dtype=np.uint64) + np.uint64(seed) * np.uint64(0x10001)
    at = (mix(number * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((number, at))
    return at[order], (np.arange(shards * virtual_nodes) // virtual_nodes)[order]


def place(cells: np.ndarray, counts: np.ndarray, cell_bits: int, shards: int, virtual_nodes: int, seed: int = 0) -> list[tuple[int, int, int, int, int]]:
    """Intervals (cell, first rank, end rank, shard, first slot) that place all rows of all cells.

    ``cells`` are sorted cell numbers (the top ``cell_bits`` bits of a position), ``counts`` their rows.
    """
    total = int(counts.sum())
    at, owner = ring(shards, virtual_nodes, seed)
    room = np.full(shards, total // shards, np.int64)
    room[: total % shards] += 1
    used = np.zeros(shards, np.int64)
    # a cell belongs to the first virtual node at or after the cell's start
    home = np.searchsorted(at, cells.astype(np.int64) << (32 - cell_bits)) % len(at)
    left, first = counts.astype(np.int64).copy(), np.zeros(len(cells), np.int64)
    todo, distance, out = np.arange(len(cells)), 0, []
    while len(todo):
        shard = owner[(home[todo] + distance) % len(at)]
        order = np.argsort(shard, kind="stable")  # within a shard by ring position
        wants, of = left[todo][order], shard[order]
        before = np.cumsum(wants) - wants
        begins = np.r_[True, of[1:] != of[:-1]]
        before -= np.maximum.accumulate(np.where(begins, before, 0))
        takes = np.clip(room[of] - used[of] - before, 0, wants)
        for k in np.flatnonzero(takes):
            cell = todo[order[k]]
            out.append((int(cells[cell]), int(first[cell]), int(first[cell] + takes[k]), int(of[k]), int(used[of[k]] + before[k])))
            first[cell] += takes[k]
            left[cell] -= takes[k]
        np.add.at(used, of, takes)
        todo = todo[left[todo] > 0]
        distance += 1
    return out


def assign_shards(docs: DataFrame, shards: int = 40, virtual_nodes: int = 128, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, rows_per_cell: int = 20_000, max_cells: int = 1 << 21) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = F.when(F.col(f"`{id_col}`").isNull(), F.xxhash64(F.lit("no id"), text)).otherwise(F.xxhash64(F.lit(seed), F.col(f"`{id_col}`")))
    position = F.shiftrightunsigned(key, 32)
    needed = max(1, docs.count() // rows_per_cell)
    # cells at least eight times finer than the arcs between virtual nodes, and finer yet where cells would hold many rows
    bits = min(max(int(shards * virtual_nodes * 8 - 1).bit_length(), needed.bit_length()), max_cells.bit_length() - 1)
    cell = F.shiftrightunsigned(position, 32 - bits)
    counted = docs.select(cell.alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).toPandas().sort_values("cell")
    parts = place(counted["cell"].to_numpy(), counted["n"].to_numpy(), bits, shards, virtual_nodes, seed)
    plan = spark.createDataFrame(parts, "cell long, lo long, hi long, shard int, base long").groupBy("cell").agg(F.collect_list(F.struct("lo", "hi", "shard", "base")).alias("parts"))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), position.alias("position"), cell.alias("cell"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("cell").orderBy("position", "doc_id", "size", "text_crc32")).cast("long") - 1)
    mine = F.filter("parts", lambda p: (p["lo"] <= F.col("rank")) & (F.col("rank") < p["hi"]))[0]
    return (
        ranked.join(plan, "cell")
        .withColumn("mine", mine)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            F.col("mine.shard").alias("shard"),
            (F.col("mine.base") + F.col("rank") - F.col("mine.lo")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
