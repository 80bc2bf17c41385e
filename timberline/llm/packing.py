"""Best-two-fit packing of token sequences into windows.

Documents (their ids and an end id) are packed into sequences of at most ``window`` tokens; only longer ones are cut.
Pieces of equal length are interchangeable, so the packing is solved on the histogram of lengths, which has at most
``window`` entries whatever the number of documents: a bin is filled greedily with the longest pieces that fit, then its
smallest piece is replaced by two unpacked ones that fill the gap more tightly, and the pattern so found repeats as long as
its lengths last. Pieces then find their sequence by their rank among the pieces of their length. Ranks come from counts of
(length, hash bucket) and a window within a bucket, so no length is sorted as a whole.

Defined results: a null or empty text is one piece, the end id; repeated rows are packed one by one; pieces of one length
are taken in the order of their hash, id and number, and those that tie in all three are alike; a very long text is cut into
as many pieces as it needs; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.common import chunks, stage
from timberline.llm.tokens import default_path, word_encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, salt long"


def plan_bins(counts: np.ndarray) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns that use up ``counts`` (pieces per length 0..window) exactly: ([(length, times)...], repeats).

    Repeating a pattern equals choosing it again: the choice depends on which lengths are left, and those it uses are
    left for every repeat.
    """
    left = counts.astype(np.int64).copy()
    window = len(left) - 1
    lengths = np.arange(window + 1)
    out = []
    while True:
        largest = np.maximum.accumulate(np.where(left > 0, lengths, 0))  # the longest left that is at most i
        if not largest[-1]:
            return out
        use: dict[int, int] = {}
        gap = window
        while gap and (size := int(largest[gap])):
            take = min(gap // size, int(left[size]) - use.get(size, 0))
            if take <= 0:  # all of this length are in the bin: go on below it
                smaller = [x for x in range(size - 1, 0, -1) if left[x] > use.get(x, 0)] if largest[size - 1] else []
                if not smaller:
                    break
                size = smaller[0]
                take = min(gap // size, int(left[size]) - use.get(size, 0))
            use[size] = use.get(size, 0) + take
            gap -= take * size
        if gap and len(use) > 0:
            smallest = min(use)
            rest = left.copy()
            for size, n in use.items():
                rest[size] -= n
            pair = _best_two(rest, gap + smallest, smallest)
            if pair:
                use[smallest] -= 1
                for size in pair:
                    use[size] = use.get(size, 0) + 1
        pattern = sorted(((size, n) for size, n in use.items() if n), reverse=True)
        repeats = min(int(left[size]) // n for size, n in pattern)
        for size, n in pattern:
            left[size] -= repeats * n
        out.append((pattern, repeats))


def _best_two(rest: np.ndarray, room: int, beats: int) -> tuple[int, int] | None:
    """Two lengths left that together fill ``room`` best, and more than ``beats``."""
    lengths = np.arange(len(rest))
    fits = np.flatnonzero(rest[: room + 1] > 0)
    fits = fits[fits > 0]
    if not len(fits):
        return None
    largest = np.maximum.accumulate(np.where(rest > 0, lengths, 0))
    other = largest[room - fits]
    same = (other == fits) & (rest[fits] < 2)
    other[same] = largest[np.maximum(other[same] - 1, 0)]
    total = np.where(other > 0, fits + other, 0)
    best = int(np.argmax(total))
    if total[best] <= beats:
        return None
    return int(fits[best]), int(other[best])


def segments(patterns: list[tuple[list[tuple[int, int]], int]]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, first sequence, pieces per sequence, offset of the first) in rank order."""
    ranks: dict[int, int] = {}
    rows: dict[int, list] = {}
    sequence = 0
    for pattern, repeats in patterns:
        offset = 0
        for size, n in pattern:
            rows.setdefault(size, []).append((ranks.get(size, 0), sequence, n, offset))
            ranks[size] = ranks.get(size, 0) + n * repeats
            offset += n * size
        sequence += repeats
    return {size: np.asarray(r, np.int64) for size, r in rows.items()}


def tokenized_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, window: int, end_id: int, with_ids: bool) -> DataFrame:
    """One row per piece of at most ``window`` ids."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, end, width = word_encoder(tokenizer, False), np.asarray([end_id], "<u4").tobytes(), 4 * window
        for batch in chunks(batches):
            rows: list[tuple] = []
            for doc, text, salt in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = encoder.encode(text or "") + end
                for piece, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None, salt))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "salt"],
            )

    read = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return read.withColumn("salt", F.xxhash64("doc_id", "text")).mapInArrow(cut, PIECES)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    window: int = 2048,
    end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for)."""
    spark = docs.sparkSession
    tokenizer = tokenizer or default_path("word_bpe_49k.json")
    pieces = stage(tokenized_pieces(docs, id_col, text_col, tokenizer, window, end_id, with_ids), "pieces")
    buckets = min(max(16, pieces.count() // 100_000), 1 << 16)
    bucket = F.pmod(F.xxhash64("salt", "piece"), F.lit(buckets))
    counted = pieces.groupBy("length", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = stage(counted.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "ranks")
    histogram = np.zeros(window + 1, np.int64)
    for r in base.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``window`` rows
        histogram[r["length"]] = r["n"]
    places = spark.sparkContext.broadcast(segments(plan_bins(histogram)))

    def find(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (batch.num_columns - 2, batch.num_columns - 1))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length):
                own = np.flatnonzero(length == size)
                table = places.value[int(size)]
                first, begins, each, at = table[np.searchsorted(table[:, 0], rank[own], side="right") - 1].T
                sequence[own] = begins + (rank[own] - first) // each
                offset[own] = at + (rank[own] - first) % each * size
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:-2], "sequence_id", "offset"])

    within = Window.partitionBy("length", "bucket").orderBy("salt", "doc_id", "piece")
    ranked = pieces.withColumn("bucket", bucket).withColumn("in_bucket", F.row_number().over(within))
    joined = ranked.join(base.select(F.col("length").alias("l"), F.col("bucket").alias("b"), "before"), (F.col("length") == F.col("l")) & (F.col("bucket") == F.col("b")))
    shown = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    kinds = dict(pieces.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in shown) + ", sequence_id long, offset long"
    return joined.select(*shown, F.col("length").alias("size"), (F.col("before") + F.col("in_bucket") - 1).cast("long").alias("rank")).mapInArrow(find, schema)
