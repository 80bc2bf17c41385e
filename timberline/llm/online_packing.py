"""Bounded-space online packing of token sequences into windows, with no padding.

Each partition streams its documents past a fixed number of open windows. A document (its ids and an end id) goes into the
open window it fills best. When none has room, the fullest is topped up with the document's head and emitted, and the rest
is placed anew; a document of a window or more first fills windows of its own. So every window a partition emits is full,
memory stays at ``open_windows`` windows, and a document is cut only where a window would otherwise be padded. At its end a
partition merges its open windows, the fullest first, into at most one that is not full. These, one per partition, are laid
end to end over all partitions and cut at every ``window``; what is left at the very end, less than one window, is cut into
powers of two, lengths that need no padding.

One pass writes all pieces; the ids travel with the leftovers only. The driver sees one number per partition. A task that
runs again reads the same split and emits the same pieces.

Defined results: a null or empty text is one piece, the end id; a very long text is cut and streams through; repeated rows
are packed one by one; equal gaps go to the window opened first; null ids are kept; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import chunks, stage
from timberline.llm.tokens import default_path, word_encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, sequence long, offset long, ids binary"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: (doc id, start in the document, ids of the document, ids of the piece)
Piece = tuple[int | None, int, int, np.ndarray]


class Packer:
    """Open windows of one partition. ``add`` and ``finish`` yield full windows as lists of pieces; ``left`` is what
    ``finish`` could not fill."""

    def __init__(self, window: int, open_windows: int) -> None:
        self.window, self.most = window, open_windows
        self._open: list[list[Piece]] = []
        self._gaps: list[int] = []
        self.left: list[Piece] = []

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        doc, start, total, ids = piece
        while len(ids) >= self.window:
            yield [(doc, start, total, ids[: self.window])]
            start, ids = start + self.window, ids[self.window :]
        while len(ids):
            n = len(ids)
            best = min((i for i, gap in enumerate(self._gaps) if gap >= n), key=self._gaps.__getitem__, default=-1)
            if best < 0 and len(self._open) < self.most:
                self._open.append([])
                self._gaps.append(self.window)
                best = len(self._open) - 1
            if best < 0:  # none fits: the fullest takes the head
                best = min(range(len(self._gaps)), key=self._gaps.__getitem__)
                n = self._gaps[best]
            self._open[best].append((doc, start, total, ids[:n]))
            self._gaps[best] -= n
            start, ids = start + n, ids[n:]
            if not self._gaps[best]:
                del self._gaps[best]
                yield self._open.pop(best)

    def finish(self) -> Iterator[list[Piece]]:
        """Top up the fullest windows with the pieces of the emptiest."""
        order = sorted(range(len(self._open)), key=self._gaps.__getitem__)
        open_, gaps = [self._open[i] for i in order], [self._gaps[i] for i in order]
        while len(open_) > 1:
            doc, start, total, ids = open_[-1].pop()
            n = min(len(ids), gaps[0])
            open_[0].append((doc, start + len(ids) - n, total, ids[len(ids) - n :]))  # its tail, so that the head stays where it is
            gaps[0] -= n
            if n < len(ids):
                open_[-1].append((doc, start, total, ids[: len(ids) - n]))
            gaps[-1] += n
            if not open_[-1]:
                del open_[-1], gaps[-1]
            if not gaps[0]:
                gaps.pop(0)
                yield open_.pop(0)
        self.left = open_[0] if open_ else []


def cuts(total: int, window: int) -> np.ndarray:
    """Where sequences begin and end when ``total`` ids are laid end to end: every ``window``, then powers of two. Only the
    tail is listed, as (begins of the tail's sequences..., total)."""
    at = total // window * window
    out = [at]
    for bit in range(window.bit_length(), -1, -1):
        if (total - at) >> bit:
            at += 1 << bit
            out.append(at)
    return np.asarray(out, np.int64)


def pack_online(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    window: int = 2048,
    open_windows: int = 16,
    end_id: int = 1,
    keeps_space: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if window < 1 or open_windows < 1:
        raise ValueError("a window holds at least one id, and one is open at least")
    tokenizer = tokenizer or default_path("byte_bpe_50k.json")

    def stream(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part = TaskContext.get().partitionId()
        encoder, end = word_encoder(tokenizer, keeps_space), np.asarray([end_id], "<u4").tobytes()
        packer, rows, sequence = Packer(window, open_windows), [], 0

        def emit(pieces: list[Piece], whole: bool) -> None:
            offset = 0
            for doc, start, total, ids in pieces:
                rows.append((doc, start, len(ids), zlib.crc32(ids), total, part, sequence if whole else None, offset, None if whole else ids.tobytes()))
                offset += len(ids)

        for batch in chunks(batches):
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(encoder.encode(text or "") + end, "<u4")
                for full in packer.add((doc, 0, len(ids), ids)):
                    emit(full, True)
                    sequence += 1
            if rows:
                yield _batch(rows)
                rows = []
        for full in packer.finish():
            emit(full, True)
            sequence += 1
        emit(packer.left, False)
        if rows:
            yield _batch(rows)

    read = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    pieces = stage(read.mapInArrow(stream, PIECES), "online-pieces")
    full = pieces.filter("sequence is not null").withColumn("sequence_id", F.shiftleft(F.col("part").cast("long"), 32) + F.col("sequence"))
    return full.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").unionAll(_merged(pieces.filter("sequence is null"), window))


def _batch(rows: list[tuple]):
    import pyarrow as pa

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "sequence", "offset", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _merged(left: DataFrame, window: int) -> DataFrame:
    """Leftovers of all partitions end to end, cut into windows and a tail of powers of two."""
    sizes = {r["part"]: r["n"] for r in left.groupBy("part").agg(F.sum("length").alias("n")).collect()}  # one number per partition
    ordered = sorted(sizes)
    before = dict(zip(ordered, np.r_[0, np.cumsum([sizes[p] for p in ordered])].tolist(), strict=False))
    tail = cuts(sum(sizes.values()), window)
    shared = left.sparkSession.sparkContext.broadcast((before, tail))

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        starts, ends = shared.value
        for batch in batches:
            rows = []
            for doc, start, total, part, offset, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "part", "offset", "ids")), strict=True):
                at, ids = starts[part] + offset, np.frombuffer(ids, "<u4")
                while len(ids):
                    if at < ends[0]:
                        sequence, begin = divmod(at, window)
                        begin, end = at - begin, at - begin + window
                    else:
                        k = int(np.searchsorted(ends, at, side="right"))
                        begin, end, sequence = int(ends[k - 1]), int(ends[k]), int(ends[0]) // window + k - 1
                    n = min(len(ids), end - at)
                    rows.append((doc, start, n, zlib.crc32(ids[:n]), total, -1 - sequence, at - begin))
                    start, at, ids = start + n, at + n, ids[n:]
            if rows:
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    return left.mapInArrow(cut, PLACED)
