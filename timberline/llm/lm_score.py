"""Language-model scores from a log-frequency Bloom filter.

N-gram counts (words, and pairs of neighbours) of the training documents are summed exactly, then quantised to powers of
``base``. An n-gram of quantised level q is entered in a Bloom filter under its levels 1..q; probing the levels in turn until
one is missing gives its count back, rounded down. Every n-gram is entered, pairs seen once too: a text whose copy was trained on
differs from others by these alone. Errors are one-sided; a pair's count is bounded by the counts of its words.

    P1(w)   = (1 - p0) * count(w) / N, and p0 for the unknown word;  p0 = (once-seen words + 1) / (N + 2)
    P(w|v)  = (count(v w) + mu * P1(w)) / (upper(count(v)) + mu)

Counts are rounded down and ``upper`` is their level's upper end, so the probabilities of all words add up to one at most.

Such a filter grows with the corpus (``bits`` a level), so it is cut into segments by ranges of the hash. Training documents
are read once and gathered into chunks; a chunk sends each segment one byte string of its n-grams with their counts. A
segment's task adds the counts, fills its part of the filter, writes it to the shared folder, and answers the chunks by
probing it. What is kept (:class:`Model`: the segments' filters, and the exact word counts that the base score asks for)
scores texts never seen: while it is small (``broadcast_bytes``, measured) it is broadcast and every text is probed where it
is read; beyond that bound the texts' n-grams, without counts, are sent to the segments as probes. Both ways probe the same
bits and give the same scores. Held-out documents are scored like this, as texts never seen.

A chunk has at most ``flush`` tokens and one document more; ``flush`` grows with the number of segments, so that a chunk has
some hundreds of n-grams for each, up to eight million tokens. The number of segments follows the corpus, so no task grows
with it.

Defined results: a null or empty text is the end token alone; repeated rows are scored, and counted in training, each on its
own; with nothing to train on every token is unknown; an empty table gives no rows. Extra columns are ignored. Words are told
apart by 64-bit hashes, pairs by their segment and 32 bits more. Byte strings are sorted numbers as compressed differences.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import GOLDEN, chunks, mix, split_words, stage

PROBES = 4
END = b"\n"  # holds white space, so no word equals it
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.uint64((1 << 40) - 1)
_TOP = np.uint64(32)
_IS_PAIR = np.uint64(1 << 40)


def hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * _PAIR + mix(second))


def segment_of(h: np.ndarray, depth: int) -> np.ndarray:
    """The segment of a hash, its first ``depth`` bits; sorted hashes come segment by segment."""
    return (h >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(len(h), np.int64)


def place_in_segment(h: np.ndarray, depth: int) -> np.ndarray:
    """The 32 bits of a hash after those of its segment."""
    return (h << np.uint64(depth)) >> _TOP


def thresholds(base: float, most: int = 1 << 40) -> np.ndarray:
    """The smallest count of each level: distinct integers from 1 upwards."""
    out, x = [], 1.0
    while x <= most:
        if not out or math.ceil(x - 1e-9) > out[-1]:
            out.append(math.ceil(x - 1e-9))
        x *= base
    return np.asarray(out, np.int64)


@dataclass(frozen=True)
class Levels:
    """Quantisation of counts."""

    starts: np.ndarray

    def level(self, counts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, counts, side="right")

    def low(self, levels: np.ndarray) -> np.ndarray:
        return np.r_[0, self.starts].astype(np.float64)[levels]

    def high(self, levels: np.ndarray) -> np.ndarray:
        return np.r_[0, self.starts[1:] - 1, self.starts[-1]].astype(np.float64)[levels]


class Filter:
    """One segment's part of the Bloom filter."""

    def __init__(self, entries: int, bits: int) -> None:
        self.size = np.uint64(max(64, entries * bits))
        self.bytes = np.zeros((int(self.size) + 7) // 8, np.uint8)

    @classmethod
    def of(cls, data: bytes, entries: int, bits: int) -> Filter:
        out = cls.__new__(cls)
        out.size, out.bytes = np.uint64(max(64, entries * bits)), np.frombuffer(data, np.uint8)
        return out

    def _places(self, keys: np.ndarray, level: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        g = mix(keys + np.uint64(level * GOLDEN % (1 << 64)))
        step = mix(g) | np.uint64(1)
        for i in range(PROBES):
            at = (g + np.uint64(i) * step) % self.size
            yield (at >> np.uint64(3)).astype(np.int64), (at & np.uint64(7)).astype(np.uint8)

    def enter(self, keys: np.ndarray, levels: np.ndarray) -> None:
        for level in range(1, int(levels.max(initial=0)) + 1):
            for byte, bit in self._places(keys[levels >= level], level):
                np.bitwise_or.at(self.bytes, byte, np.left_shift(np.uint8(1), bit))

    def probe(self, keys: np.ndarray, most: int) -> np.ndarray:
        """Levels of n-grams: their levels are probed in turn until one is missing."""
        out = np.zeros(len(keys), np.int64)
        alive = np.arange(len(keys))
        for level in range(1, most + 1):
            hit = np.ones(len(alive), bool)
            for byte, bit in self._places(keys[alive], level):
                hit &= ((self.bytes[byte] >> bit) & np.uint8(1)).astype(bool)
            alive = alive[hit]
            if not len(alive):
                break
            out[alive] = level
        return out


# -- byte strings of a chunk

def _squeeze(x: np.ndarray, width: int) -> bytes:
    """Numbers byte plane by byte plane, compressed: high planes are nearly all zero."""
    import zstandard

    return zstandard.compress(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), 1)


def _swell(data: bytes, width: int) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").reshape(-1).astype(np.uint64)


def pack_counts(c: np.ndarray) -> bytes:
    return _squeeze(c, 6)


def unpack_counts(data: bytes) -> np.ndarray:
    return _swell(data, 6).astype(np.int64)


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending 64-bit numbers, as differences."""
    return _squeeze(np.diff(x, prepend=np.uint64(0)), 8)


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_swell(data, 8), dtype=np.uint64)


def pack_numbers(x: np.ndarray) -> bytes:
    return _squeeze(x, 4)


def unpack_numbers(data: bytes) -> np.ndarray:
    return _swell(data, 4).astype(np.int64)


def _pair_hashes(words: np.ndarray, tokens: np.ndarray, begins: np.ndarray, end: np.uint64) -> np.ndarray:
    """The pair each token ends, as hashes. Before a text's first token stands the end token."""
    own = words[tokens]
    before = np.r_[end, own[:-1]]
    before[begins] = end
    return pairs(before, own)


CHUNK = "chunk long, seg int, ids array<struct<doc_id: {id}, held_out: boolean>>, lengths binary, tokens binary, words binary, word_counts binary, pairs binary, pair_counts binary"


def chunk_table(docs: DataFrame, held_out: Column, depth: int, flush: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks of documents: a row (seg = -1) with its texts as word numbers, and a row per segment with the chunk's distinct
    n-grams of that segment and how often each occurs in training documents."""
    import pyarrow as pa

    own = docs.select(F.struct(F.col(f"`{id_col}`").alias("doc_id"), held_out.alias("held_out")).alias("id"), F.col(f"`{text_col}`").alias("text"))
    columns = CHUNK.format(id=dict(docs.dtypes)[id_col])

    def cut(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        end = hashes([END])[0]
        part, number = TaskContext.get().partitionId(), 0
        ids: list = []
        held: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        size = 0

        def rows():
            n = np.concatenate(lengths)
            words, tokens = np.unique(np.concatenate(held), return_inverse=True)
            begins = np.r_[0, np.cumsum(n)[:-1]]
            trained = np.repeat(~pa.concat_arrays(ids).field("held_out").to_numpy(zero_copy_only=False).astype(bool), n)
            found, at = np.unique(_pair_hashes(words, tokens, begins, end), return_inverse=True)
            word_counts, pair_counts = np.bincount(tokens[trained], minlength=len(words)), np.bincount(at[trained], minlength=len(found))
            chunk = (part << 32) + number
            out = [(chunk, -1, pack_numbers(n), pack_numbers(tokens), pack_sorted(words), None, None, None)]
            edges = np.arange((1 << depth) + 1)
            w, p = np.searchsorted(segment_of(words, depth), edges), np.searchsorted(segment_of(found, depth), edges)
            places = place_in_segment(found, depth)
            for s in range(1 << depth):
                a, b, c, d = w[s], w[s + 1], p[s], p[s + 1]
                if a < b or c < d:
                    out.append((chunk, s, None, None, pack_sorted(words[a:b]), pack_counts(word_counts[a:b]), pack_sorted(places[c:d]), pack_counts(pair_counts[c:d])))
            kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 6)
            chunk_, seg, *blobs = (pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))
            everyone = pa.concat_arrays(ids)
            listed = pa.ListArray.from_arrays(pa.array([0] + [len(everyone)] * len(out), pa.int32()), everyone)
            return pa.RecordBatch.from_arrays([chunk_, seg, listed, *blobs], names=["chunk", "seg", "ids", "lengths", "tokens", "words", "word_counts", "pairs", "pair_counts"])

        for batch in chunks(batches, 300):
            words, numbers, ends = split_words(batch.column(1))
            held.append(np.insert(hashes(words)[numbers], ends, end))
            lengths.append(np.diff(np.r_[0, ends]) + 1)
            ids.append(batch.column(0))
            size += len(held[-1])
            if size >= flush:
                yield rows()
                number, size = number + 1, 0
                for kept in (ids, held, lengths):
                    kept.clear()
        if held:
            yield rows()

    return stage(own.mapInArrow(cut, columns), "chunks")


ANSWER = (
    "chunk long, seg int, word_counts binary, word_levels binary, pair_levels binary, tokens long, distinct long, once long, entries long, filter_bytes long, absent long, false_hits long, "
    "filter binary, words binary, counts binary"
)


def _segment(base: float, bits: int):
    """Add up a segment's counts, fill its part of the filter, and answer for the n-grams of every chunk."""
    import pyarrow as pa

    levels = Levels(thresholds(base))

    def answer(key, table):
        words, couples = ([unpack_sorted(x) for x in table[c].to_pylist()] for c in ("words", "pairs"))
        sums, at = [], []
        for found, counts in ((words, table["word_counts"]), (couples, table["pair_counts"])):
            own = np.concatenate([unpack_counts(x) for x in counts.to_pylist()])
            distinct, inverse = np.unique(np.concatenate(found), return_inverse=True)
            sums.append((distinct, np.bincount(inverse, weights=own, minlength=len(distinct)).astype(np.int64)))
            at.append(inverse)
        (word, word_sum), (couple, couple_sum) = sums
        keys, total = np.r_[word & _LOW, couple | _IS_PAIR], np.r_[word_sum, couple_sum]
        true = levels.level(total)
        part = Filter(int(true.sum()), bits)
        part.enter(keys, true)
        seen = part.probe(keys, len(levels.starts)).astype(np.uint8)
        word_level, couple_level = seen[: len(word)], seen[len(word) :]
        out, w, p = [], 0, 0
        for chunk, h, k in zip(table["chunk"].to_pylist(), words, couples, strict=True):
            mine, ours = at[0][w : w + len(h)], at[1][p : p + len(k)]
            w, p = w + len(h), p + len(k)
            out.append((chunk, key[0].as_py(), pack_counts(word_sum[mine]), _squeeze(word_level[mine], 1), _squeeze(couple_level[ours], 1), *[None] * 10))
        absent = total == 0
        facts = (int(word_sum.sum()), int((word_sum > 0).sum()), int((word_sum == 1).sum()), int(true.sum()), len(part.bytes), int(absent.sum()), int((seen[absent] > 0).sum()))
        known = word_sum > 0
        out.append((-1, key[0].as_py(), None, None, None, *facts, part.bytes.tobytes(), pack_sorted(word[known]), pack_counts(word_sum[known])))
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), *[pa.int64()] * 7, *[pa.binary()] * 3)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in ANSWER.split(", ")])

    return answer


SCORES = "id struct<doc_id: {id}, held_out: boolean>, n_tokens long, n_known long, base_score double, score double"


def _document_scores(chunk, facts: dict, levels: Levels, mu: float, counts: np.ndarray, word_level: np.ndarray, pair_level: np.ndarray):
    """The documents of a chunk (a table of its one row), from the counts and levels of its words and pairs in hash order."""
    import pyarrow as pa

    n, v, once = (int(facts[k] or 0) for k in ("tokens", "distinct", "once"))
    end = hashes([END])[0]
    words = unpack_sorted(chunk["words"][0].as_py())
    tokens, lengths = unpack_numbers(chunk["tokens"][0].as_py()), unpack_numbers(chunk["lengths"][0].as_py())
    begins = np.r_[0, np.cumsum(lengths)[:-1]]
    _, at = np.unique(_pair_hashes(words, tokens, begins, end), return_inverse=True)
    unknown = (once + 1) / (n + 2)
    low, high = levels.low(word_level), levels.high(word_level)
    alone = np.where(word_level > 0, (1 - unknown) * low / max(n, 1), unknown)
    before = np.r_[0, tokens[:-1]]
    before[begins] = np.searchsorted(words, end)
    together = np.minimum(levels.low(pair_level[at]), np.minimum(high[tokens], high[before]))
    p = (together + mu * alone[tokens]) / (high[before] + mu)
    baseline = np.log10(counts + 0.1) - math.log10(n + 0.1 * (v + 1))
    columns = [chunk["ids"].combine_chunks().flatten(), pa.array(lengths)]
    columns += [pa.array(np.add.reduceat(x, begins)) for x in ((counts > 0).astype(np.int64)[tokens], baseline[tokens], np.log10(p))]
    return pa.Table.from_arrays(columns, names=["id", "n_tokens", "n_known", "base_score", "score"])


def _chunk_scores(facts: dict, base: float, mu: float):
    """The documents of a chunk, scored with what the segments answered."""
    levels = Levels(thresholds(base))

    def score(chunk, answers):
        answers = answers.sort_by("seg")
        word_level, pair_level = (np.concatenate([_swell(x, 1) for x in answers[c].to_pylist()]).astype(np.int64) for c in ("word_levels", "pair_levels"))
        counts = np.concatenate([unpack_counts(x) for x in answers["word_counts"].to_pylist()])
        return _document_scores(chunk, facts, levels, mu, counts, word_level, pair_level)

    return score


class _Part:
    """A kept segment: its filter and the exact counts of its words."""

    def __init__(self, row: dict, bits: int) -> None:
        self.filter = Filter.of(row["filter"], row["entries"], bits)
        self.words, self.counts = unpack_sorted(row["words"]), unpack_counts(row["counts"])

    def answer(self, words: np.ndarray, couples: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Exact counts of words, and the levels of words and of pairs (by their place in the segment)."""
        at = np.minimum(np.searchsorted(self.words, words), max(len(self.words) - 1, 0))
        counts = np.where(self.words[at] == words, self.counts[at], 0) if len(self.words) else np.zeros(len(words), np.int64)
        found = self.filter.probe(np.r_[words & _LOW, couples | _IS_PAIR], most)
        return counts, found[: len(words)], found[len(words) :]


@dataclass(frozen=True)
class Model:
    """A trained model. ``table`` has a row per segment: seg, entries, filter, words, counts."""

    table: DataFrame
    facts: dict
    depth: int
    base: float
    mu: float
    bits: int
    flush: int

    @property
    def bytes(self) -> int:
        return int(self.table.agg(F.coalesce(F.sum(F.octet_length("filter") + F.octet_length("words") + F.octet_length("counts")), F.lit(0))).first()[0])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = 8 << 20) -> DataFrame:
    """Score texts with a trained model: doc_id, n_tokens, n_known, base_score, score. Nothing of the texts is learnt."""
    kind = dict(docs.dtypes)[id_col]
    table = chunk_table(docs, F.lit(True), model.depth, model.flush, id_col, text_col)
    texts = table.filter("seg = -1").select("chunk", "ids", "lengths", "tokens", "words")
    if model.bytes <= broadcast_bytes:
        scored = texts.mapInArrow(_score_here(model), SCORES.format(id=kind))
    else:
        ngrams = table.filter("seg >= 0").select("chunk", "seg", "words", "pairs")
        asked = ngrams.groupBy("seg").cogroup(model.table.groupBy("seg"))
        levels = stage(asked.applyInArrow(_probes(model.base, model.bits), "chunk long, seg int, word_counts binary, word_levels binary, pair_levels binary"), "probes")
        scored = texts.groupBy("chunk").cogroup(levels.groupBy("chunk")).applyInArrow(_chunk_scores(model.facts, model.base, model.mu), SCORES.format(id=kind))
    return scored.select("id.doc_id", "n_tokens", "n_known", "base_score", "score")


def _score_here(model: Model):
    """Texts meet the whole model, which is broadcast."""
    rows = [r.asDict() for r in model.table.collect()]  # its size is checked
    shared = model.table.sparkSession.sparkContext.broadcast(rows)
    facts, base, mu, bits, depth = model.facts, model.base, model.mu, model.bits, model.depth

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        parts = {r["seg"]: _Part(r, bits) for r in shared.value}
        levels, end = Levels(thresholds(base)), hashes([END])[0]
        edges = np.arange((1 << depth) + 1)
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = pa.Table.from_batches([batch.slice(i, 1)])
                words = unpack_sorted(chunk["words"][0].as_py())
                tokens, lengths = unpack_numbers(chunk["tokens"][0].as_py()), unpack_numbers(chunk["lengths"][0].as_py())
                found = np.unique(_pair_hashes(words, tokens, np.r_[0, np.cumsum(lengths)[:-1]], end))
                w, p = np.searchsorted(segment_of(words, depth), edges), np.searchsorted(segment_of(found, depth), edges)
                places = place_in_segment(found, depth)
                counts, own, together = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.zeros(len(found), np.int64)
                for s, part in parts.items():
                    a, b, c, d = w[s], w[s + 1], p[s], p[s + 1]
                    counts[a:b], own[a:b], together[c:d] = part.answer(words[a:b], places[c:d], len(levels.starts))
                yield from _document_scores(chunk, facts, levels, mu, counts, own, together).to_batches()

    return run


def _probes(base: float, bits: int):
    """Probes of many chunks meet their segment."""
    import pyarrow as pa

    most = len(thresholds(base))

    def answer(asked, kept):
        part = _Part(kept.to_pylist()[0], bits) if kept.num_rows else None
        out = []
        for chunk, seg, words, couples in zip(*(asked[c].to_pylist() for c in ("chunk", "seg", "words", "pairs")), strict=True):
            words, couples = unpack_sorted(words), unpack_sorted(couples)
            none = tuple(np.zeros(len(x), np.int64) for x in (words, words, couples))
            counts, own, together = part.answer(words, couples, most) if part else none
            out.append((chunk, seg, pack_counts(counts), _squeeze(own, 1), _squeeze(together, 1)))
        columns = zip(*out, strict=True) if out else [[]] * 5
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["chunk", "seg", "word_counts", "word_levels", "pair_levels"])

    return answer


def train_and_score(
    docs: DataFrame,
    held_out: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    base: float = 1.5,
    mu: float = 5.0,
    bits: int = 12,
    flush: int = 500_000,
    segment_bytes: int = 8 << 20,
    report: dict | None = None,
    broadcast_bytes: int = 8 << 20,
) -> DataFrame:
    """Learn from the rows where ``held_out`` is false and score all rows: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score. Held-out rows are scored by :func:`score`, from the kept model alone. ``report`` receives the filter's
    entries, bytes, and how many absent n-grams were probed and found."""
    held = F.coalesce(held_out, F.lit(False))
    model, trained = fit(docs.filter(~held), id_col, text_col, base, mu, bits, flush, segment_bytes, report, like=docs)
    unseen = score(docs.filter(held), model, id_col, text_col, broadcast_bytes)
    out = trained.withColumn("held_out", F.lit(False)).unionByName(unseen.withColumn("held_out", F.lit(True)))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.facts["tokens"] or 0).cast("long").alias("train_tokens"), "base_score", "score")


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    base: float = 1.5,
    mu: float = 5.0,
    bits: int = 12,
    flush: int = 500_000,
    segment_bytes: int = 8 << 20,
    report: dict | None = None,
    like: DataFrame | None = None,
) -> tuple[Model, DataFrame]:
    """Train on all rows: the model, and the rows' own scores (doc_id, n_tokens, n_known, base_score, score), which the segments
    answer while they are at it. ``like`` sets the number of segments by a larger table."""
    kind = dict(docs.dtypes)[id_col]
    size = (docs if like is None else like).agg(F.sum(F.octet_length(f"`{text_col}`"))).first()[0] or 0
    depth = max(0, math.ceil(math.log2(max(size, 1) / segment_bytes)))
    flush = max(flush, min(500 << depth, 8_000_000)) if depth > 9 else flush
    table = chunk_table(docs, F.lit(False), depth, flush, id_col, text_col)
    ngrams = table.filter("seg >= 0").select("chunk", "seg", "words", "word_counts", "pairs", "pair_counts")
    answers = stage(ngrams.groupBy("seg").applyInArrow(_segment(base, bits), ANSWER), "answers")
    names = ("tokens", "distinct", "once", "entries", "filter_bytes", "absent", "false_hits")
    kept = answers.filter("chunk = -1")
    facts = kept.agg(*(F.sum(c).alias(c) for c in names)).first().asDict()
    if report is not None:
        report.update(facts)
    texts = table.filter("seg = -1").select("chunk", "ids", "lengths", "tokens", "words")
    levels = answers.filter("chunk >= 0").select("chunk", "seg", "word_counts", "word_levels", "pair_levels")
    scored = texts.groupBy("chunk").cogroup(levels.groupBy("chunk")).applyInArrow(_chunk_scores(facts, base, mu), SCORES.format(id=kind))
    model = Model(kept.select("seg", "entries", "filter", "words", "counts"), facts, depth, base, mu, bits, flush)
    return model, scored.select("id.doc_id", "n_tokens", "n_known", "base_score", "score")
