"""Phrases that occur more often than their parts suggest, counted by direct-address tiles.

Texts are cut into pieces and words; every count is per language and exact. Each task numbers the words it meets and keeps
its texts as these numbers. The words' totals give every frequent word a global id, its frequency rank, and the task's
numbers are replaced by ids through a table of the words that the task itself met, so no vocabulary is broadcast.

Ranks are cut into stripes of about equal mass: narrow among frequent words, wide among rare ones. A pair of stripes is a
tile, and a task sums its pairs before it sends them as offsets within tiles. A tile of few cells is counted with a dense
``bincount``; one of many cells keeps sorted coordinates with counts (COO) that are merged as they grow. A pair that is as
frequent as asked for is then ranked anew within its tile, and the next word extends it: the pair's rank and the word's id
address a tile of the next level in the same way, and so on up to the longest phrase. Before a task sends a longer phrase,
its pairs are looked up in a bit map of fixed size made from all frequent pairs; false hits cost work, not exactness.

Defined results: a null text is empty; a null language is ``und``; very long texts are numbered like others; repeated rows
count each; ties of score go to the more frequent, then to the smaller phrase in byte order; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.common import GOLDEN, chunks, mix, stage

# Bytes that end a piece, and bytes that end a word only.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
WORD_ENDS = b" \t"

_CLASS = np.zeros(256, np.uint8)
_CLASS[np.frombuffer(WORD_ENDS, np.uint8)] = 1
_CLASS[np.frombuffer(PIECE_ENDS, np.uint8)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bits of the map of frequent pairs (4 MB), whatever the corpus.
MAP_BITS = 1 << 25
NUMBERED = "kind int, chunk long, lang string, code int, word binary, count long, codes binary"
STREAM = "lang string, bounds binary, ids binary"
TILES = "lang string, tile long, kind int, keys binary, nexts binary, counts binary, box binary"


def words_of(texts) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of an Arrow string array, the number of each word in order, and whether it begins a piece."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.large_string())])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if offsets[-1] == offsets[0]:
        return [], np.empty(0, np.int32), np.empty(0, bool)
    data = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    kinds = _CLASS[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets - offsets[0]] = True  # where texts begin
    solid = kinds == 0
    before = np.r_[False, solid[:-1]] & ~begins[:-1]
    starts = np.flatnonzero(solid & ~before)
    after = np.r_[solid[1:], False] & ~begins[1:]
    ends = np.flatnonzero(solid & ~after) + 1
    pieces = np.cumsum((kinds == 2) | begins[:-1], dtype=np.int32)[starts]
    opens = np.r_[True, pieces[1:] != pieces[:-1]][: len(starts)]
    at = np.r_[0, np.cumsum(ends - starts)]
    flat = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data[solid])])
    coded = flat.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), opens


class _Numbers:
    """The words of one language that a task has met, numbered from 1, with their counts."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.counts = np.zeros(1, np.int64)

    def codes(self, texts) -> bytes:
        """Numbers of the words in order, 0 before each piece."""
        words, own, opens = words_of(texts)
        known = self.known
        numbers = np.asarray([known.setdefault(w, len(known) + 1) for w in words], np.uint32)
        if len(known) >= len(self.counts):
            self.counts = np.r_[self.counts, np.zeros(len(known) + 1 - len(self.counts), np.int64)]
        if len(words):
            self.counts[numbers] += np.bincount(own, minlength=len(words))
        out = np.zeros(len(own) + int(opens.sum()), np.uint32)
        out[np.arange(len(own)) + np.cumsum(opens)] = numbers[own] if len(words) else 0
        return out.tobytes()


def numbered_texts(docs: DataFrame, lang_col: str, text_col: str, task_words: int) -> DataFrame:
    """Rows of kind 0: the words of a chunk with numbers and counts; of kind 1: texts as numbers. A chunk ends when its
    dictionaries hold ``task_words`` words."""

    def number(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        langs: dict[str, _Numbers] = {}

        def dictionaries():
            for lang, own in langs.items():
                n = len(own.known)
                kinds = (np.zeros(n, np.int32), np.full(n, chunk), [lang] * n, np.arange(1, n + 1, dtype=np.int32), list(own.known), own.counts[1 : n + 1], [None] * n)
                yield _batch(NUMBERED, kinds)

        for batch in chunks(batches, size=6 << 20):
            lang = batch.column(0)
            for name in pc.unique(lang).to_pylist():
                texts = batch.column(1).filter(pc.equal(lang, pa.scalar(name)))
                codes = langs.setdefault(name, _Numbers()).codes(texts)
                yield _batch(NUMBERED, ([1], [chunk], [name], [None], [None], [None], [codes]))
            if sum(len(x.known) for x in langs.values()) >= task_words:
                yield from dictionaries()
                langs.clear()
                chunk += 1
        yield from dictionaries()

    read = docs.select(F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    return read.mapInArrow(number, NUMBERED)


def _batch(schema: str, columns):
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    named = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, named, strict=True)], names=[n for n, _ in named])


def ranked(words: DataFrame, least: int, tile_mass: int) -> DataFrame:
    """Frequent words with ``id`` (frequency rank in the language, from 1) and ``stripe``. Ranks and running masses are
    counted within ranges of the order and moved by what lies before the range."""
    totals = words.groupBy("lang", "word").agg(F.sum("count").alias("count"))
    frequent = totals.filter(F.col("count") >= least)
    order = [F.col("lang"), F.desc("count"), F.col("word")]

    def within(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, held, place, mass = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            langs, counts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            places, masses = [], []
            for lang, count in zip(langs, counts, strict=True):
                if lang != held:
                    held, place, mass = lang, 0, 0
                places.append(place)
                masses.append(mass)
                place, mass = place + 1, mass + count
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * n, pa.int32()), pa.array(places, pa.int64()), pa.array(masses, pa.int64())], names=["lang", "word", "count", "part", "place", "mass"])

    local = stage(frequent.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(within, "lang string, word binary, count long, part int, place long, mass long"), "phrase-words")
    sums = local.groupBy("lang", "part").agg(F.count("*").alias("n"), F.sum("count").alias("m"))  # a row per range and language
    earlier = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    of = Window.partitionBy("lang")
    moved = sums.select("lang", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("m0"), F.sum("m").over(of).alias("all"))
    stripes = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("all") / F.lit(tile_mass))))
    stripe = F.floor((F.col("mass") + F.col("m0")).cast("double") * stripes / F.col("all")).cast("int")
    return local.join(moved, ["lang", "part"]).select("lang", "word", "count", (F.col("place") + F.col("n0") + 1).cast("int").alias("id"), stripe.alias("stripe"))


def id_streams(numbered: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Texts as word ids (0: a break, or a word that is not frequent), with the first id of each stripe of the language and
    the id after the last. A chunk's rows meet in order: stripes, its own words with ids, its texts."""
    met = numbered.filter("kind = 0").select("chunk", "lang", "code", "word").join(vocabulary.select("lang", "word", "id"), ["lang", "word"])
    met = met.select(F.lit(1).alias("kind"), "chunk", "lang", "code", "id", F.lit(None).cast("binary").alias("codes"))
    stripes = vocabulary.groupBy("lang", "stripe").agg(F.min("id").alias("id"))
    stripes = stripes.unionAll(vocabulary.groupBy("lang").agg(F.lit(-1).alias("stripe"), (F.max("id") + 1).alias("id")))
    texts = numbered.filter("kind = 1").select(F.lit(2).alias("kind"), "chunk", "lang", F.lit(None).cast("int").alias("code"), F.lit(None).cast("int").alias("id"), "codes")
    bounds = numbered.filter("kind = 1").select("chunk", "lang").distinct().join(stripes, "lang").select(F.lit(0).alias("kind"), "chunk", "lang", F.col("stripe").alias("code"), "id", F.lit(None).cast("binary").alias("codes"))

    def translate(batches: Iterator) -> Iterator:
        held, firsts, codes, ids, table = None, [], [], [], None
        for batch in batches:
            kinds, chunk, lang = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            edges = [0, *(i for i in range(1, len(kinds)) if kinds[i] != kinds[i - 1] or chunk[i] != chunk[i - 1] or lang[i] != lang[i - 1]), len(kinds)]
            for lo, hi in zip(edges, edges[1:]):
                if held != (chunk[lo], lang[lo]):
                    held, firsts, codes, ids, table = (chunk[lo], lang[lo]), [], [], [], None
                if kinds[lo] == 0:
                    firsts += batch.column(4).slice(lo, hi - lo).to_pylist()
                elif kinds[lo] == 1:
                    codes.append(batch.column(3).slice(lo, hi - lo).to_numpy())
                    ids.append(batch.column(4).slice(lo, hi - lo).to_numpy())
                elif firsts:
                    if table is None:
                        own = np.concatenate(codes) if codes else np.empty(0, np.int32)
                        table = np.zeros(int(own.max(initial=0)) + 1, np.uint32)
                        table[own] = np.concatenate(ids) if ids else []
                    for at in range(lo, hi):
                        found = np.frombuffer(batch.column(5)[at].as_buffer(), np.uint32)
                        found = np.where(found < len(table), table[np.minimum(found, len(table) - 1)], 0).astype(np.uint32)
                        yield _batch(STREAM, ([held[1]], [np.sort(np.asarray(firsts, np.uint32)).tobytes()], [found.tobytes()]))

    rows = bounds.unionAll(met).unionAll(texts).repartition("chunk", "lang").sortWithinPartitions("chunk", "lang", "kind")
    return rows.mapInArrow(translate, STREAM)


def _flushes(batches: Iterator, tokens: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(language, stripe bounds, ids) of about ``tokens`` ids each."""
    held: dict[str, list] = {}
    for batch in batches:
        for lang, bounds, ids in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            own = held.setdefault(lang, [0, None, []])
            ids = np.frombuffer(ids.as_buffer(), np.uint32)
            own[0], own[1] = own[0] + len(ids), np.frombuffer(bounds.as_buffer(), np.uint32)
            own[2] += [ids, np.zeros(1, np.uint32)]
            if sum(x[0] for x in held.values()) >= tokens:
                yield from ((k, b, np.concatenate(x)) for k, (_, b, x) in held.items())
                held = {}
    yield from ((k, b, np.concatenate(x)) for k, (_, b, x) in held.items())


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often they occur."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[at], np.diff(np.r_[at, len(keys)])


def _small(counts: np.ndarray) -> np.ndarray:
    """Counts in one byte where all fit; the number of bytes tells."""
    return counts.astype(np.uint8) if counts.max(initial=0) < 256 else counts.astype(np.uint64)


def _counts(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8 if len(raw) == n else np.uint64).astype(np.int64)


def _tile_rows(lang: str, bounds: np.ndarray, pairs: np.ndarray, nexts: np.ndarray | None, counts: np.ndarray, kind: int):
    """One row per tile of pairs (keys: first id << 32 | second id)."""
    first, second = np.searchsorted(bounds, pairs >> np.uint64(32), side="right") - 1, np.searchsorted(bounds, pairs & np.uint64(0xFFFFFFFF), side="right") - 1
    tile = first * len(bounds) + second
    height, width = np.diff(bounds.astype(np.int64))[first], np.diff(bounds.astype(np.int64))[second]
    order = np.argsort(tile, kind="stable")

    def box(k: int) -> bytes:
        return np.asarray((bounds[first[k]], bounds[second[k]], height[k], width[k], bounds[-1]), np.int64).tobytes()

    tile, pairs, counts = tile[order], pairs[order], counts[order]
    nexts = None if nexts is None else nexts[order]
    edges = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1], True]) if len(tile) else np.zeros(1, int)
    rows = [(lang, int(tile[a]), kind, pairs[a:b].tobytes(), None if nexts is None else nexts[a:b].tobytes(), _small(counts[a:b]).tobytes(), box(order[a])) for a, b in zip(edges, edges[1:])]
    return _batch(TILES, zip(*rows, strict=True)) if rows else None


def pair_tiles(streams: DataFrame, tokens: int) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        for lang, bounds, ids in _flushes(batches, tokens):
            a, b = ids[:-1], ids[1:]
            real = (a > 0) & (b > 0)
            pairs, counts = _counted(a[real].astype(np.uint64) << np.uint64(32) | b[real])
            if (out := _tile_rows(lang, bounds, pairs, None, counts, 1)) is not None:
                yield out

    return streams.mapInArrow(run, TILES)


class TileCounter:
    """Counts of (row, column) cells: dense where there are at most ``cells``, else sorted coordinates."""

    def __init__(self, rows: int, columns: int, cells: int, buffer: int = 1 << 21) -> None:
        self.columns, self.buffer = columns, buffer
        self.dense = np.zeros(rows * columns, np.int64) if rows * columns <= cells else None
        self._keys: list[np.ndarray] = [np.empty(0, np.uint64)]
        self._counts: list[np.ndarray] = [np.empty(0, np.int64)]
        self._waiting = 0

    def add(self, row: np.ndarray, column: np.ndarray, counts: np.ndarray) -> None:
        key = row.astype(np.uint64) * np.uint64(self.columns) + column.astype(np.uint64)
        if self.dense is not None:
            low, high = counts & 0xFFFFFF, counts >> 24  # sums of doubles stay exact
            self.dense += np.bincount(key.astype(np.int64), weights=low, minlength=len(self.dense)).astype(np.int64)
            if high.any():
                self.dense += np.bincount(key.astype(np.int64), weights=high, minlength=len(self.dense)).astype(np.int64) << 24
            return
        self._keys.append(key)
        self._counts.append(counts)
        self._waiting += len(key)
        if self._waiting > max(self.buffer, len(self._keys[0])):
            self._merge()

    def _merge(self) -> None:
        keys, counts = np.concatenate(self._keys), np.concatenate(self._counts)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
        self._keys, self._counts, self._waiting = [keys[at]], [np.add.reduceat(counts, at) if len(at) else counts], 0

    def frequent(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, columns and counts of the cells that reach ``least``."""
        if self.dense is not None:
            keys = np.flatnonzero(self.dense >= least).astype(np.uint64)
            counts = self.dense[keys.astype(np.int64)]
        else:
            self._merge()
            keep = self._counts[0] >= least
            keys, counts = self._keys[0][keep], self._counts[0][keep]
        return (keys // np.uint64(self.columns)).astype(np.int64), (keys % np.uint64(self.columns)).astype(np.int64), counts


def _by_tile(batches: Iterator) -> Iterator[tuple[str, int, Iterator[tuple[int, np.ndarray, bytes | None, np.ndarray, bytes | None]]]]:
    """(language, tile, its rows) of a stream sorted by these."""
    from itertools import groupby

    def rows() -> Iterator:
        for batch in batches:
            for at in range(batch.num_rows):
                yield [batch.column(c)[at].as_py() for c in range(7)]

    for (lang, tile), own in groupby(rows(), key=lambda r: (r[0], r[1])):
        yield lang, tile, ((kind, keys := np.frombuffer(raw, np.uint64), nexts, _counts(counts, len(keys)), box) for _, _, kind, raw, nexts, counts, box in own)


def count_pairs(tiles: DataFrame, least: int, cells: int) -> DataFrame:
    """One row per tile: its frequent pairs in order, with counts. A tile's rows stream by."""

    def run(batches: Iterator) -> Iterator:
        for lang, tile, rows in _by_tile(batches):
            counter = None
            for _, keys, _, counts, box in rows:
                top, left, height, width, _ = np.frombuffer(box, np.int64).tolist()
                counter = counter or TileCounter(height, width, cells)
                counter.add((keys >> np.uint64(32)).astype(np.int64) - top, (keys & np.uint64(0xFFFFFFFF)).astype(np.int64) - left, counts)
            row, column, counts = counter.frequent(least)
            if len(row):
                keys = (row + top).astype(np.uint64) << np.uint64(32) | (column + left).astype(np.uint64)
                yield _batch(TILES, ([lang], [tile], [0], [keys.tobytes()], [None], [counts.astype(np.uint64).tobytes()], [None]))

    return tiles.repartition("lang", "tile").sortWithinPartitions("lang", "tile", "kind").mapInArrow(run, TILES)


def _positions(lang: str, pairs: np.ndarray, bits: int) -> np.ndarray:
    import xxhash

    return mix(pairs * np.uint64(GOLDEN) ^ np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))) & np.uint64(bits - 1)


def pair_map(pairs: DataFrame, bits: int) -> np.ndarray:
    """The bit map of all frequent pairs: ``bits`` bits, or-ed by Spark."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for lang, keys in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at = np.unique(_positions(lang, np.frombuffer(keys.as_buffer(), np.uint64), bits))
                cell, bit = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
                edges = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
                yield _batch("cell long, bits long", (cell[edges], np.bitwise_or.reduceat(bit, edges).view(np.int64)))

    rows = pairs.select("lang", "keys").mapInArrow(run, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits"))
    found = rows.toArrow()  # at most bits / 64 rows
    out = np.zeros(bits // 64, np.uint64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy().view(np.uint64)
    return out


def triple_tiles(streams: DataFrame, frequent: np.ndarray, tokens: int) -> DataFrame:
    shared = streams.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator) -> Iterator:
        table = shared.value
        for lang, bounds, ids in _flushes(batches, tokens):
            keys = ids[:-1].astype(np.uint64) << np.uint64(32) | ids[1:]
            hit = np.zeros(len(keys), bool)
            real = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
            at = _positions(lang, keys[real], 64 * len(table))
            hit[real] = table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) > 0
            own = np.flatnonzero(hit[:-1] & hit[1:])
            pairs, where = np.unique(keys[own], return_inverse=True)
            both, counts = _counted(where.astype(np.uint64) << np.uint64(32) | ids[own + 2])
            if len(both):
                out = _tile_rows(lang, bounds, pairs[(both >> np.uint64(32)).astype(np.int64)], (both & np.uint64(0xFFFFFFFF)).astype(np.uint32), counts, 1)
                yield out

    return streams.mapInArrow(run, TILES)


def count_triples(pairs: DataFrame, tiles: DataFrame, least: int, cells: int) -> DataFrame:
    """Frequent triples as rows. A tile's frequent pairs come first and are ranked anew, the most frequent first."""
    schema = "lang string, i int, j int, k int, a long"

    def run(batches: Iterator) -> Iterator:
        for lang, _, rows in _by_tile(batches):
            keys, rank, order, counter = np.empty(0, np.uint64), None, None, None
            for kind, own, nexts, counts, box in rows:
                if kind == 0:
                    keys = own
                    order = np.argsort(-counts, kind="stable")
                    rank = np.empty(len(order), np.int64)
                    rank[order] = np.arange(len(order))
                    continue
                if not len(keys):
                    continue
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                real = keys[at] == own
                row, column, counts = rank[at[real]], np.frombuffer(nexts, np.uint32)[real].astype(np.int64), counts[real]
                counter = counter or TileCounter(len(keys), int(np.frombuffer(box, np.int64)[-1]), cells)
                counter.add(row, column, counts)
            if counter is None:
                continue
            row, column, counts = counter.frequent(least)
            if len(row):
                pair = keys[order[row]]
                yield _batch(schema, ([lang] * len(row), (pair >> np.uint64(32)).astype(np.int32), (pair & np.uint64(0xFFFFFFFF)).astype(np.int32), column.astype(np.int32), counts))

    return pairs.unionAll(tiles).repartition("lang", "tile").sortWithinPartitions("lang", "tile", "kind").mapInArrow(run, schema)


def _flat_pairs(pairs: DataFrame) -> DataFrame:
    schema = "lang string, i int, j int, a long"

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for lang, keys, counts in zip(batch.column(0).to_pylist(), batch.column(3), batch.column(5), strict=True):
                keys = np.frombuffer(keys.as_buffer(), np.uint64)
                yield _batch(schema, ([lang] * len(keys), (keys >> np.uint64(32)).astype(np.int32), (keys & np.uint64(0xFFFFFFFF)).astype(np.int32), np.frombuffer(counts.as_buffer(), np.uint64).astype(np.int64)))

    return pairs.mapInArrow(run, schema)


def score(a: str, left: str, right: str) -> Column:
    """floor(10^6 a^2 / (left right)), in whole numbers of up to 38 digits."""
    a, left, right = (f"cast({c} as decimal(15, 0))" for c in (a, left, right))
    return F.expr(f"(cast(1000000 as decimal(7, 0)) * {a} * {a}) div ({left} * {right})")


def mine(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    least: int = 10,
    inside_percent: int = 50,
    top: int | None = 2000,
    tile_mass: int = 1_000_000,
    cells: int = 1 << 22,
    task_words: int = 250_000,
    flush_tokens: int = 2_000_000,
    map_bits: int = MAP_BITS,
) -> DataFrame:
    """Phrases of two and three words: lang, rank, phrase, a, l, r, n, score. ``top`` of None keeps all."""
    if map_bits < 64 or map_bits & (map_bits - 1):
        raise ValueError("map_bits is a power of two, 64 at least")
    numbered = stage(numbered_texts(docs, lang_col, text_col, task_words), "phrase-texts")
    words = numbered.filter("kind = 0")
    vocabulary = stage(ranked(words, least, tile_mass), "phrase-vocabulary")
    streams = stage(id_streams(numbered, vocabulary), "phrase-ids")
    packed = stage(count_pairs(pair_tiles(streams, flush_tokens), least, cells), "phrase-pairs")
    triples = stage(count_triples(packed, triple_tiles(streams, pair_map(packed, map_bits), flush_tokens), least, cells), "phrase-triples")
    sizes = words.groupBy("lang").agg(F.sum("count").alias("n"))

    one = vocabulary.select("lang", "id", F.col("word").cast("string").alias("word"), "count")
    first, second = (one.select("lang", F.col("id").alias(k), F.col("word").alias(f"w{k}"), F.col("count").alias(f"n{k}")) for k in "ij")
    pairs = stage(_flat_pairs(packed).join(first, ["lang", "i"]).join(second, ["lang", "j"]), "phrase-pair-words")
    held = triples.select("lang", "i", "j", "a").unionAll(triples.select("lang", F.col("j").alias("i"), F.col("k").alias("j"), "a")).groupBy("lang", "i", "j").agg(F.max("a").alias("inside"))
    free = pairs.join(held, ["lang", "i", "j"], "left").filter(F.expr(f"inside is null or 100 * inside < {int(inside_percent)} * a"))
    twos = free.select("lang", F.concat_ws(" ", "wi", "wj").alias("phrase"), "a", F.col("ni").alias("l"), F.col("nj").alias("r"), score("a", "ni", "nj").alias("score"))
    begin = pairs.select("lang", "i", "j", F.col("wi").alias("w1"), F.col("wj").alias("w2"), F.col("ni").alias("n1"), F.col("a").alias("n12"))
    end = pairs.select("lang", F.col("i").alias("j"), F.col("j").alias("k"), F.col("wj").alias("w3"), F.col("nj").alias("n3"), F.col("a").alias("n23"))
    cut = triples.join(begin, ["lang", "i", "j"]).join(end, ["lang", "j", "k"]).withColumn("s1", score("a", "n1", "n23")).withColumn("s2", score("a", "n12", "n3"))
    early = F.col("s1") <= F.col("s2")
    threes = cut.select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a",
        F.when(early, F.col("n1")).otherwise(F.col("n12")).alias("l"), F.when(early, F.col("n23")).otherwise(F.col("n3")).alias("r"), F.least("s1", "s2").alias("score"),
    )
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = twos.unionAll(threes).withColumn("rank", F.row_number().over(by).cast("long"))
    if top is not None:
        best = best.filter(F.col("rank") <= top)  # each task keeps its own best before they meet
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
