"""Token ids in length-delimited binary files, with a separate offset index for shuffled reads.

A data file is a run of records, each framed as

    length   unsigned 64-bit, little-endian
    masked checksum of the length bytes, unsigned 32-bit
    payload
    masked checksum of the payload, unsigned 32-bit

with checksums rotated and offset (so that a checksum of data that holds checksums stays sound). The checksum is CRC-32 as
in zlib. A payload is the document id (signed 64-bit; a null id is flagged), the number of ids and the ids as unsigned 16-
or 32-bit numbers, whichever holds the vocabulary. Beside ``part-N.bin`` lies ``part-N.idx``: 24 bytes a record, its byte
offset, document id and first token (counted within the file).

Files are written in ascending document order over a range partitioning. Every attempt of a task writes under its own
name; the manifest lists only the files of successful attempts, so a lost executor leaves no wrong data. Token positions
of a file follow from the manifest's totals.

Defined results: a null text is empty, a record with the end id alone; null ids come first; repeated rows are records of
their own, ordered by id, then by a hash of the text; a very long text is one record; extra columns are ignored; an empty
table writes no files and reads back as no rows.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import chunks, new_folder
from timberline.llm.tokens import default_path, word_encoder

MANIFEST = "part int, file string, n_docs long, n_tokens long, first_id long, last_id long"
_HEAD = "<qBI"  # id, flags (1: null id, 2: 32-bit ids), number of ids
_INDEX = np.dtype([("offset", "<i8"), ("doc_id", "<i8"), ("token", "<i8")])


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframe(file) -> Iterator[bytes]:
    """The payloads of a file; a broken length or payload raises."""
    while head := file.read(12):
        if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
            raise ValueError("broken record length")
        payload = file.read(struct.unpack("<Q", head[:8])[0])
        if file.read(4) != struct.pack("<I", masked(payload)):
            raise ValueError("broken record")
        yield payload


def _files(folder: str):
    """A file system and the folder's path in it, opened on the worker."""
    from pyarrow import fs

    if ":" not in folder.split("/")[0]:
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


def write_tokens(
    docs: DataFrame,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 2,
    partitions: int | None = None,
    file_bytes: int = 256 << 20,
) -> DataFrame:
    """Write the files and return the manifest (one row per file, also kept as ``manifest`` in the folder). There are as many
    files as shuffle partitions, and more where a file would take more than ``file_bytes`` of text."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    tokenizer = tokenizer or default_path("byte_bpe_50k.json")
    wide = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) > 1 << 16

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part = TaskContext.get().partitionId()
        encoder, end = word_encoder(tokenizer, True), np.asarray([end_id], "<u4").tobytes()
        system, base = _files(folder)
        system.create_dir(base, recursive=True)
        name = f"part-{part:05d}-{uuid.uuid4().hex}"
        offset, tokens, n_docs, index, ids = 0, 0, 0, [], []
        with system.open_output_stream(f"{base}/{name}.bin") as data, system.open_output_stream(f"{base}/{name}.idx") as places:
            for batch in chunks(batches):
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found = np.frombuffer(encoder.encode(text or "") + end, "<u4")
                    n = len(found)
                    body = found.tobytes() if wide else found.astype("<u2").tobytes()
                    record = frame(struct.pack(_HEAD, doc or 0, (doc is None) + 2 * wide, n) + body)
                    data.write(record)
                    index.append((offset, doc or 0, tokens))
                    if doc is not None:
                        ids[1 if ids else 0 :] = [doc]
                    offset += len(record)
                    tokens += n
                places.write(np.asarray(index, _INDEX).tobytes())
                n_docs += len(index)
                index = []
        if offset:
            yield pa.RecordBatch.from_pylist([{"part": part, "file": name, "n_docs": n_docs, "n_tokens": tokens, "first_id": ids[0] if ids else None, "last_id": ids[-1] if ids else None}], schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64())]))
        else:
            system.delete_file(f"{base}/{name}.bin")
            system.delete_file(f"{base}/{name}.idx")

    read = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text").asc()]
    size = 0 if partitions else read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // file_bytes))
    read.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_tokens(spark: SparkSession, folder: str, digest_only: bool = False) -> DataFrame:
    """Read the files of the manifest back: doc_id, start, n_tokens, ids_crc32, and ids (little-endian unsigned 32-bit).

    Every record's checksums are verified and its place is checked against the offset index.
    """
    manifest = sorted(spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").collect(), key=lambda r: r["part"])  # a row per file
    bases, total = [], 0
    for r in manifest:
        bases.append((r["file"], total, r["n_docs"]))
        total += r["n_tokens"]

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        system, base = _files(folder)
        for batch in batches:
            for name, begins, n_docs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with system.open_input_stream(f"{base}/{name}.idx") as f:
                    index = np.frombuffer(f.read(), _INDEX)
                if len(index) != n_docs:
                    raise ValueError(f"{name}: the index has {len(index)} records, the manifest {n_docs}")
                rows, offset = [], 0
                with system.open_input_stream(f"{base}/{name}.bin", buffer_size=1 << 20) as f:
                    for k, payload in enumerate(unframe(f)):
                        doc, flags, n = struct.unpack_from(_HEAD, payload)
                        if index[k]["offset"] != offset:
                            raise ValueError(f"{name}: record {k} is not where the index says")
                        offset += len(payload) + 16
                        ids = np.frombuffer(payload, "<u4" if flags & 2 else "<u2", n, struct.calcsize(_HEAD)).astype("<u4").tobytes()
                        rows.append((None if flags & 1 else doc, begins + int(index[k]["token"]), n, zlib.crc32(ids), None if digest_only else ids))
                        if len(rows) == 1000:
                            yield _batch(pa, rows)
                            rows = []
                if rows:
                    yield _batch(pa, rows)

    files = spark.createDataFrame(bases, "file string, base long, n_docs long").repartition(max(1, len(bases)))
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The offset index of all files, a row per record: doc_id (0 where null), file, offset, start (its place among all tokens)."""
    manifest = sorted(spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").collect(), key=lambda r: r["part"])  # a row per file
    bases, total = [], 0
    for r in manifest:
        bases.append((r["file"], total))
        total += r["n_tokens"]

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        system, base = _files(folder)
        for batch in batches:
            for name, begins in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with system.open_input_stream(f"{base}/{name}.idx") as f:
                    index = np.frombuffer(f.read(), _INDEX)
                columns = [pa.array([name] * len(index)), pa.array(index["offset"].copy()), pa.array(index["token"] + begins)]
                yield pa.RecordBatch.from_arrays([pa.array(index["doc_id"].copy()), *columns], names=["doc_id", "file", "offset", "start"])

    files = spark.createDataFrame(bases, "file string, base long").repartition(max(1, len(bases)))
    return files.mapInArrow(read, "doc_id long, file string, offset long, start long")


def read_shuffled(spark: SparkSession, folder: str, seed: int, epoch: int = 0) -> DataFrame:
    """All records in a seeded order that differs from epoch to epoch: doc_id, start, n_tokens, ids_crc32, ids. The index is put
    in order, not the records; each task seeks its own records and verifies their checksums."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        system, base = _files(folder)
        opened: dict = {}
        for batch in chunks(batches, 1000):
            rows = []
            for name, offset, begins in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name not in opened:
                    if len(opened) >= 64:
                        opened.pop(next(iter(opened))).close()
                    opened[name] = system.open_input_file(f"{base}/{name}.bin")
                opened[name].seek(offset)
                payload = next(unframe(opened[name]))
                doc, flags, n = struct.unpack_from(_HEAD, payload)
                ids = np.frombuffer(payload, "<u4" if flags & 2 else "<u2", n, struct.calcsize(_HEAD)).astype("<u4").tobytes()
                rows.append((None if flags & 1 else doc, begins, n, zlib.crc32(ids), ids))
            yield _batch(pa, rows)

    place = F.xxhash64(F.lit(seed), F.lit(epoch), "start")
    ordered = read_index(spark, folder).orderBy(place, "start").select("file", "offset", "start")
    return ordered.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def _batch(pa, rows):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write ``docs`` to a fresh folder and return what its files hold, without the ids."""
    folder = new_folder(docs.sparkSession, "tokens")
    write_tokens(docs, folder, **options)
    return read_tokens(docs.sparkSession, folder, digest_only=True).drop("ids")
