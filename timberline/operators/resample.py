"""Patient-level splits and resampling with hashed, repeatable draws."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.operators.staging import stage


def seeded(seed: int, value: Column) -> Column:
    """A seeded hash that other engines can repeat: md5 of "seed:value" in hexadecimal."""
    return F.md5(F.concat(F.lit(f"{seed}:"), value.cast("string")).cast("binary"))


def patient_ranks(rows: DataFrame, seed: int, patient: str = "patient_id") -> DataFrame:
    """Distinct patients numbered 0.. in a seeded order. Hashes are even, so ranges of their first digits need no sampling: a range is
    sorted and numbered in its own task and written, and what the ranges before it hold is one number per range."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.shiftright(F.conv(F.substring("__h", 1, 8), 16, 10).cast("long") * n, 32).cast("int")
    ids = rows.select(patient).distinct().withColumn("__h", seeded(seed, F.col(patient)))
    dealt = ids.repartitionById(n, F.coalesce(place, F.lit(0))).sortWithinPartitions("__h", F.col(patient).cast("string"))
    numbered = stage(dealt.select(patient, F.monotonically_increasing_id().alias("__id")), "ranks")
    part = F.shiftright("__id", 33)  # such an id is the task's number and the row's place in the task
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = numbered.groupBy(part.alias("__part")).agg(F.count("*").alias("__n")).select("__part", before.alias("__before"))
    return numbered.join(F.broadcast(counts), part == F.col("__part")).select(patient, (F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank"))


def patient_folds(rows: DataFrame, k: int, seed: int = 0, patient: str = "patient_id") -> DataFrame:
    """(patient, fold): a patient's rows share a fold, fold sizes differ by one patient at most."""
    return patient_ranks(rows, seed, patient).select(patient, (F.col("rank") % k).cast("int").alias("fold"))


def temporal_split(rows: DataFrame, column: Column, last_training: int) -> tuple[DataFrame, DataFrame]:
    return rows.filter(column <= last_training), rows.filter(column > last_training)


def leave_one_level_out(rows: DataFrame, level: str, least_event_patients: int, cause: int = 1, patient: str = "patient_id") -> list:
    """Levels with enough event patients to be held out (a bounded list)."""
    counts = rows.groupBy(level).agg(F.countDistinct(F.when(F.col("event") == cause, F.col(patient))).alias("n"))
    return sorted(r[level] for r in counts.filter(F.col("n") >= least_event_patients).collect())


def bootstrap_weights(ids: DataFrame, replicates: int, seed: int = 0, patient: str = "patient_id") -> DataFrame:
    """(rep, patient, k): multinomial counts of n draws with replacement out of n patients, for each replicate.

    Every draw is a hashed index, so the counts are exact and repeatable; only (rep, index) counts are shuffled.
    """
    spark = ids.sparkSession
    ranks = patient_ranks(ids, seed, patient)
    n = ranks.count()
    if not n:
        return ranks.select(F.lit(0).alias("rep"), patient, F.lit(0).cast("long").alias("k"))
    draws = spark.range(replicates * n).select((F.col("id") / n).cast("int").alias("rep"), (F.conv(F.substring(seeded(seed + 1, F.col("id")), 1, 15), 16, 10).cast("long") % n).alias("rank"))
    return draws.groupBy("rep", "rank").agg(F.count("*").alias("k")).join(ranks, "rank").select("rep", patient, "k")


def md5_heads(begin: bytes, numbers):
    """The first eight bytes, as whole numbers, of the md5 of ``begin`` and a number in decimal digits, for an array of numbers of
    which all fit one block of the hash. Steps run over many numbers at once, as a call per draw would be most of a bootstrap."""
    import math

    import numpy as np

    out = np.empty(len(numbers), np.uint64)
    digits = np.searchsorted(10 ** np.arange(1, 19, dtype=np.int64), numbers, side="right") + 1
    shifts = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
    sines = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
    places = [np.flatnonzero(digits == k) for k in np.unique(digits)]
    for at in (part for where in places for part in np.split(where, range(1 << 14, len(where), 1 << 14))):
        left, k = numbers[at].copy(), int(digits[at[0]])
        block = np.zeros((16 * 4, len(at)), np.uint8)
        size = len(begin) + k
        block[: len(begin)] = np.frombuffer(begin, np.uint8)[:, None]
        for j in range(size - 1, len(begin) - 1, -1):
            left, digit = np.divmod(left, 10)
            block[j] = digit + 48
        block[size] = 128
        words = [(block[4 * i].astype(np.uint32) | block[4 * i + 1].astype(np.uint32) << 8 | block[4 * i + 2].astype(np.uint32) << 16 | block[4 * i + 3].astype(np.uint32) << 24) if 4 * i <= size else np.uint32(0) for i in range(16)]
        words[14] = np.uint32(8 * size)
        first = [np.full(len(at), x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
        a, b, c, d = (x.copy() for x in first)
        f, other = np.empty_like(a), np.empty_like(a)
        with np.errstate(over="ignore"):
            for i in range(64):
                if i < 32:
                    x, y, z = (b, c, d) if i < 16 else (d, b, c)
                    np.bitwise_xor(y, z, out=f)
                    f &= x
                    f ^= z
                elif i < 48:
                    np.bitwise_xor(b, c, out=f)
                    f ^= d
                else:
                    np.bitwise_or(b, ~d, out=f)
                    f ^= c
                f += a
                f += words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16] + np.uint32(sines[i])
                np.right_shift(f, np.uint32(32 - shifts[i]), out=other)
                np.left_shift(f, np.uint32(shifts[i]), out=f)
                f |= other
                f += b
                a, b, c, d, f = d, f, b, c, a
        a, b = ((x + y).byteswap().astype(np.uint64) for x, y in ((a, first[0]), (b, first[1])))  # words go from their low byte on
        heads = a << np.uint64(32) | b
        out[at] = heads
    return out


#: Draws that a task deals out at once, and that one block of patients gets on average.
DEALT_DRAWS, BLOCK_DRAWS = 1 << 21, 1 << 21


def _drawn(ids: DataFrame, replicates: int, seed: int, patient: str, kind: str) -> DataFrame:
    """(patient, reps) with the draws of :func:`bootstrap_weights`, as a list of replicates or as a string of counts.

    A draw is a number while it travels: tasks deal them by blocks of patients, so that a shuffled row holds the draws of many
    patients and a draw takes four bytes. A block's draws meet in one task, whatever the number of patients.
    """
    ranks = patient_ranks(ids, seed, patient)
    n = ranks.count()
    r1 = replicates + 1
    if not n or not replicates:
        own = F.array(F.lit(0)) if kind == "lists" else F.unhex(F.lit("01"))
        return ranks.select(patient, own.alias("reps"))
    width = max(1, BLOCK_DRAWS // r1)
    draws = ids.sparkSession.range(replicates * n)
    begin = f"{seed + 1}:".encode()

    def deal(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def flush(held: list):
            ids_ = np.concatenate(held)
            at = (md5_heads(begin, ids_) >> np.uint64(4)).astype(np.int64) % n  # 15 hexadecimal digits
            block = at // width
            number = ((at - block * width) * r1 + ids_ // n + 1).astype(np.int32)
            order = np.argsort(block, kind="stable")
            block, number = block[order], number[order]
            starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            return pa.RecordBatch.from_arrays([pa.array(block[starts]), pa.array([x.tobytes() for x in np.split(number, starts[1:])], pa.binary())], names=["block", "numbers"])

        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy())
            size += batch.num_rows
            if size >= DEALT_DRAWS:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    def gather(key, table):
        import numpy as np
        import pyarrow as pa

        block = key[0].as_py()
        here = min(width, n - block * width)
        counts = np.bincount(np.concatenate([np.frombuffer(x, np.int32) for x in table.column("numbers").to_pylist()]), minlength=here * r1).reshape(here, r1)
        counts[:, 0] = 1
        if kind == "lists":
            flat = np.repeat(np.tile(np.arange(r1, dtype=np.int32), here), counts.ravel())
            reps = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts.sum(axis=1))].astype(np.int32)), pa.array(flat))
        else:
            if counts.max() > 255:
                raise OverflowError("a patient is drawn more than 255 times in one replicate")
            reps = pa.array([x.tobytes() for x in counts.astype(np.uint8)], pa.binary())
        return pa.table([pa.array(np.arange(here) + block * width), reps], names=["rank", "reps"])

    dtype = "array<int>" if kind == "lists" else "binary"
    dealt = draws.mapInArrow(deal, "block long, numbers binary")
    if n <= width:
        blocks = dealt
    else:  # a block without any draw still has its patients
        blocks = dealt.unionByName(ids.sparkSession.range(-(-n // width)).select(F.col("id").alias("block"), F.unhex(F.lit("")).alias("numbers")))
    found = blocks.groupBy("block").applyInArrow(gather, f"rank long, reps {dtype}")
    return stage(ranks.join(found, "rank").select(patient, "reps"), "reps")


def bootstrap_lists(ids: DataFrame, replicates: int, seed: int = 0, patient: str = "patient_id") -> DataFrame:
    """(patient, reps): the replicates, from 1, that draw a patient, once for each draw, and 0 for the sample itself. The draws are
    those of :func:`bootstrap_weights`; a patient stays one row."""
    return _drawn(ids, replicates, seed, patient, "lists")


def bootstrap_counts(ids: DataFrame, replicates: int, seed: int = 0, patient: str = "patient_id") -> DataFrame:
    """(patient, reps): what :func:`bootstrap_lists` gives as a string of bytes, one count per replicate from 0 on: a quarter of
    the list's size with many replicates."""
    return _drawn(ids, replicates, seed, patient, "counts")


def bootstrap(rows: DataFrame, metric: Callable[[DataFrame, list[str], str], DataFrame], replicates: int, seed: int = 0, patient: str = "patient_id") -> DataFrame:
    """Evaluate ``metric(rows, group columns, weight column)`` for all replicates as one grouped job: column ``rep``. Rows meet the
    list of their patient's replicates and unfold inside a task, before a grouped metric's first sums."""
    lists = bootstrap_lists(rows, replicates, seed, patient)
    drawn = rows.join(lists, patient).withColumn("rep", F.explode("reps")).filter("rep > 0").withColumn("rep", F.col("rep") - 1).drop("reps").withColumn("k", F.lit(1).cast("long"))
    return metric(drawn, ["rep"], "k")


def bootstrap_ratio(rows: DataFrame, numerator: Column, denominator: Column, replicates: int, seed: int = 0, patient: str = "patient_id", out: str = "value") -> DataFrame:
    """(rep, value) of a ratio of sums. Both sums are taken per patient first, so a replicate multiplies patients and not rows."""
    sums = stage(rows.groupBy(patient).agg(F.sum(numerator).alias("__a"), F.sum(denominator).alias("__b")), "sums")
    drawn = sums.join(bootstrap_weights(sums, replicates, seed, patient), patient)
    return drawn.groupBy("rep").agg((F.sum(F.col("k") * F.col("__a")) / F.sum(F.col("k") * F.col("__b"))).alias(out))


def intervals(values: DataFrame, columns: Sequence[str], requested: int, least_valid: int = 10, least_share: float = 0.0, group: Sequence[str] = ()) -> DataFrame:
    """Percentile intervals per metric; NULL where too few replicates are valid."""
    parts = []
    for c in columns:
        ok = F.count(c) >= max(least_valid, int(-(-requested * least_share // 1)))
        q = F.percentile(c, [0.025, 0.975])
        parts += [F.count(c).alias(f"{c}_valid"), F.when(ok, q[0]).alias(f"{c}_low"), F.when(ok, q[1]).alias(f"{c}_high")]
    return values.groupBy(*group).agg(*parts)


def paired_brier_difference(rows: DataFrame, a: str, b: str, replicates: int = 200, seed: int = 0, patient: str = "patient_id") -> DataFrame:
    """Brier(a) - Brier(b) and its interval. Losses are summed per patient before they are multiplied by the replicates."""
    loss = F.col("w") * ((F.col("y") - F.col(a)) ** 2 - (F.col("y") - F.col(b)) ** 2)
    sums = stage(rows.groupBy(patient).agg(F.sum(loss).alias("s"), F.count("*").alias("n")), "losses")
    drawn = sums.join(bootstrap_weights(sums, replicates, seed, patient), patient).groupBy("rep").agg((F.sum(F.col("k") * F.col("s")) / F.sum(F.col("k") * F.col("n"))).alias("d"))
    q = drawn.agg(F.percentile("d", [0.025, 0.975]).alias("q"))
    return sums.agg((F.sum("s") / F.sum("n")).alias("difference"), F.count("*").alias("patients")).crossJoin(q).select("difference", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"), "patients")


def gap_table(rows: DataFrame, patient: str = "patient_id", date: str = "landmark_date") -> DataFrame:
    """Years to the patient's next landmark (the last: its ``time``), at least one week, and whether there is a next one."""
    following = F.lead(date).over(Window.partitionBy(patient).orderBy(date))
    gap = F.when(following.isNotNull(), F.datediff(following, date) / 365.25).otherwise(F.col("time"))
    return rows.withColumn("gap", F.greatest(gap, F.lit(1 / 52))).withColumn("visit", following.isNotNull().cast("double"))
