"""What the training-data operators share: staging in the cluster's shared folder, word splitting and hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
GOLDEN = 0x9E3779B97F4A7C15


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, one beside the warehouse of a local
    session; a cluster must name it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_folder(spark).rstrip('/')}/timberline-{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that later passes neither recompute it nor depend on
    one executor's disk."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def salted_lookup(rows: DataFrame, key: str, table: DataFrame, salt: Column) -> DataFrame:
    """Inner join of ``rows`` with ``table`` (unique by ``key``) that deals the rows of a frequent key to many tasks: the
    table meets one row per key and salt, and these meet the rows."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(n)))
    meeting = salted.select(key, "__salt").distinct().join(table, key)
    return salted.join(meeting, [key, "__salt"]).drop("__salt")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


_LOWER_BYTES = bytes.maketrans(ASCII_UPPER.encode(), ASCII_LOWER.encode())


def lower_words(text: str | None) -> list[bytes]:
    """The words of a text (null: none) as UTF-8, A-Z lower-cased. ``bytes.split`` cuts at exactly the six white bytes."""
    return text.encode().translate(_LOWER_BYTES).split() if text else []


def split_words(texts) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words (A-Z lower-cased) of an Arrow string column, the number of each word in it, and where each text's
    words end. Null texts have none. Arrow's ASCII white space is exactly the six white bytes."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten()
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # white space at an end leaves an empty word
    ends = np.r_[0, np.cumsum(real)][lists.offsets.to_numpy()[1:]]
    coded = words.filter(pa.array(real)).dictionary_encode()
    return coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy(), ends


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class WordHasher:
    """64-bit hashes of words, equal on every worker; keeps at most ``limit`` words between calls."""

    def __init__(self, limit: int = 400_000) -> None:
        self.limit = limit
        self._known = _Hashes()

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self._known) > self.limit:
            self._known = _Hashes()
        return np.fromiter(map(self._known.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def chunks(batches: Iterable, rows: int = 2000, size: int = 16 << 20) -> Iterable:
    """Arrow batches cut to at most ``rows`` rows and, by their mean length, about ``size`` bytes, so that a worker holds few
    long texts as Python objects."""
    for batch in batches:
        step = max(1, min(rows, int(batch.num_rows * size / max(batch.nbytes, 1))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
