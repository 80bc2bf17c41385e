"""N-gram Jaccard self-join by a MinHash LSH forest with exact verification.

Texts are sets of word 5-grams (words lower-cased A-Z). Equal sets form one *text*, and only texts are compared. Each text
gets a signature of ``depth`` MinHash values per tree; in a tree the signatures form a trie, whose nodes are the groups of
texts that share a prefix. Texts alone in every shortest prefix have no partner and leave at once.

All others are first compared under their whole signatures, the deepest nodes. Verification is exact, so the links found are
known, and in how many trees each was met. Links met in one or two trees alone tell of links met in none, so a text's
measured recall (:func:`recall_of`) counts one missing link for each of them, and one more link right at the threshold for
every text, so that few links are no evidence of many. A text short of the target has its prefixes shortened and is compared
again, with all texts it newly meets; texts that reached the target are left where they are. So the members of a large group
of close copies stay under long prefixes, and a text without links goes down to the length that gives the target at the
threshold itself.

Pairs never become rows. Nodes with the same members are merged, and large ones are cut into cells of two blocks of bounded
size. A cell holds its texts' shingles and counts the pairs it is first to see (those that meet in no earlier tree and met at
no longer prefix). It returns a row per linked text: its number of links, how many of them met in few trees, and
the smallest text of its cell it is connected to. Nodes that hold a large share of all texts are few and meet their texts by
broadcast, the others by shuffle (:func:`_members`), so no node's texts gather in one task before cells cut them. Connected components over these rows give the classes. Joins on class labels are salted, since one class may
hold a third of all texts.

Defined results: a null text, and one without words, has no shingles: it is a class of its own without links. A text of one
to four words has one shingle, all its words. Repeated rows count as copies; a null id is a document like others. An empty
table gives no rows. Extra columns are ignored by :func:`join` and pass through :func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.common import chunks, lower_words, mix, salted_lookup, stage

BLOCK = 256
BLOCK_SHINGLES = 2_000_000  # 16 MB
CROWDED = 1 / 256
WEAK = 2
SHINGLE = 5
_POWERS = np.asarray([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(SHINGLE)], np.uint64)


def expected_recall(threshold: float, trees: int, depth: int) -> float:
    """The share of pairs of this similarity that agree on the first ``depth`` hashes of at least one tree."""
    return 1 - (1 - threshold**depth) ** trees


def prefix_depths(threshold: float, trees: int, recall: float, longest: int = 8, step: int = 2) -> list[int]:
    """Prefix lengths to be tried in turn: from ``longest`` down by ``step`` to the one that gives the target recall at the
    threshold itself, where every text stops."""
    last = next((k for k in range(longest, 1, -1) if expected_recall(threshold, trees, k) >= recall), 1)
    return [*range(longest, last, -step), last]


def recall_of(links: Column, weak: Column, threshold: float, trees: int, depth: int) -> Column:
    """Measured recall of a text: its links, over these and as many missing ones as met in one or two trees alone (``weak``),
    with one more link at the threshold on both sides."""
    return (links + 1) / (links + weak + 1 / expected_recall(threshold, trees, depth))


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the 5-grams of a word sequence (given as word hashes)."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(SHINGLE, n)
    total = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        total += hashes[k : n - size + 1 + k] * _POWERS[k]
    return np.unique(mix(total + np.uint64(size)))


class _Hashed:
    """Shingles of texts, with a word cache for the life of a task."""

    def __init__(self) -> None:
        from timberline.llm.common import WordHasher

        self._hasher = WordHasher()

    def __call__(self, text: str | None) -> np.ndarray:
        return shingles(self._hasher(lower_words(text)))


def signature(own: np.ndarray, trees: int, depths: Sequence[int]) -> np.ndarray:
    """For each prefix length (rows) and tree (columns) the prefix as one 64-bit number."""
    longest = max(depths)
    number = np.arange(1, trees * longest + 1, dtype=np.uint64)
    a, b = ((x >> np.uint64(32)).astype(np.uint32) for x in (mix(number), mix(number + np.uint64(1 << 32))))
    a |= np.uint32(1)
    short = (own >> np.uint64(32)).astype(np.uint32)
    least = np.full(trees * longest, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(short), 2048):
        x = short[at : at + 2048, None] * a
        x += b
        np.minimum(least, x.min(axis=0), out=least)
    # a prefix is the wrapping sum of its values, each mixed with its place
    values = mix(least.astype(np.uint64) + (number << np.uint64(32))).reshape(trees, longest)
    return mix(np.cumsum(values, axis=1, dtype=np.uint64)[:, np.asarray(depths) - 1].T)


SIGNED = "doc_id {id}, th long, text_id binary, n_shingles int, prefixes binary"


def signed_texts(docs: DataFrame, id_col: str, text_col: str, trees: int, depths: Sequence[int]) -> DataFrame:
    """Per document: its id, a hash of its text, the digest of its shingle set (null: none), its size, and its prefixes of all
    lengths as one byte string."""
    kind = dict(docs.dtypes)[id_col]

    def sign(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        hashed = _Hashed()
        for batch in chunks(batches):
            sets = [hashed(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([signature(s, trees, depths).astype(">u8").tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                names=["doc_id", "th", "text_id", "n_shingles", "prefixes"],
            )

    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(sign, SIGNED.format(id=kind))


def _nodes(texts: DataFrame, level: int, trees: int) -> DataFrame:
    """A row per text and tree: the trie node the text is under at the ``level``-th prefix length."""
    at = F.col("tree") * 8 + 8 * trees * level + 1
    return texts.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("node", F.substring("prefixes", at, F.lit(8)))


def _members(entries: DataFrame, nodes: DataFrame, n_texts: int) -> DataFrame:
    """Texts with their node's columns. A node of more than ``CROWDED`` of all texts would be a hot key; a tree has fewer than
    1 / ``CROWDED`` of them, so these are broadcast and their texts stay where they are. All other nodes meet by shuffle, where
    no key has more rows than that share."""
    crowded = F.broadcast(nodes.filter(F.col("n") > n_texts * CROWDED))
    rest = nodes.filter(F.col("n") <= n_texts * CROWDED)
    apart = entries.join(crowded.select("tree", "node"), ["tree", "node"], "left_anti").join(rest, ["tree", "node"])
    return entries.join(crowded, ["tree", "node"]).unionByName(apart)


def _links(own: list[np.ndarray], prefixes: np.ndarray, level: int, tree: int, open_: np.ndarray, block: np.ndarray, cell: tuple[int, int], threshold: float) -> np.ndarray:
    """Similarities of the cell's pairs (row before column; 0: no link) that are similar, have a text that is still open, met
    at no longer prefix, and meet in no earlier tree. ``prefixes`` is texts x lengths x trees."""
    n = len(own)
    sizes = np.asarray([len(s) for s in own], np.float64)
    pairs = np.triu(np.ones((n, n), bool), 1)
    if cell[0] != cell[1]:
        pairs &= block[:, None] != block[None, :]
    pairs &= np.minimum(sizes[:, None], sizes[None, :]) >= threshold * np.maximum(sizes[:, None], sizes[None, :]) - 1e-9
    pairs &= open_[:, None] | open_[None, :]
    seen = [(level, t) for t in range(tree)] + [(level - 1, t) for t in range(prefixes.shape[2]) if level]
    for k, t in seen:
        if not pairs.any():
            return np.zeros((n, n))
        pairs &= prefixes[:, None, k, t] != prefixes[None, :, k, t]
    first, second = np.nonzero(pairs)
    if len(first) <= 4 * n:
        common = np.asarray([len(np.intersect1d(own[i], own[j], assume_unique=True)) for i, j in zip(first, second, strict=True)], np.float64)
    else:
        common = _overlaps(own)[first, second]
    together = sizes[first] + sizes[second] - common
    similar = common >= threshold * together - 1e-9
    out = np.zeros((n, n))
    out[first[similar], second[similar]] = common[similar] / together[similar]
    return out


def _overlaps(own: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, over the shingles that occur more than once."""
    values, column, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(own)), [len(s) for s in own])
    shared = times[column] > 1
    row, column = row[shared], (np.cumsum(times > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(own), len(own)), np.float32)
    width = 4096
    edges = np.searchsorted(column, np.arange(0, (int(column[-1]) if len(column) else -1) + 1 + width, width))
    for k in range(len(edges) - 1):
        x = np.zeros((len(own), width), np.float32)
        x[row[edges[k] : edges[k + 1]], column[edges[k] : edges[k + 1]] - k * width] = 1
        total += x @ x.T
    return total.astype(np.float64)


def _verify_cells(threshold: float, trees: int, depths: Sequence[int], level: int):
    def verify(key, rows):
        import pandas as pd

        tree, cell = int(key[0]), (int(key[2]), int(key[3]))
        rows = rows.drop_duplicates("text_id").sort_values("text_id", ignore_index=True)
        own = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
        prefixes = np.stack([np.frombuffer(x, ">u8").reshape(len(depths), trees) for x in rows["prefixes"]])
        found = _links(own, prefixes, level, tree, rows["open"].to_numpy(bool), rows["block"].to_numpy(), cell, threshold)
        found = found + found.T
        both = found > 0
        copies = rows["n_copies"].to_numpy()
        root = np.arange(len(own))  # smallest text of the cell each is connected to
        while True:
            lower = np.minimum(root, np.where(both, root[None, :], len(own)).min(axis=1, initial=len(own)))
            if (lower == root).all():
                break
            root = lower
        texts, documents = both.sum(axis=1), both @ copies
        some = np.flatnonzero(texts)
        ids = rows["text_id"].to_numpy()
        out = pd.DataFrame({"text_id": ids[some], "links": texts[some].astype(np.int64), "doc_links": documents[some].astype(np.int64), "parent": ids[root[some]]})
        first, second = np.nonzero(both)
        for k in range(len(depths)):
            few = (prefixes[first, k] == prefixes[second, k]).sum(axis=1) <= WEAK
            out[f"w{k}"] = np.bincount(first[few], minlength=len(own))[some].astype(np.int64)
        return out

    weak = ", ".join(f"w{k} long" for k in range(len(depths)))
    return verify, f"text_id binary, links long, doc_links long, parent binary, {weak}"


def _with_shingles(rows: DataFrame) -> DataFrame:
    """Replace a column ``text`` by ``shingles``."""
    kept = [c for c in rows.columns if c != "text"]

    def make(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hashed = _Hashed()
        for batch in chunks(batches):
            at = batch.schema.names.index("text")
            sets = [hashed(t).tobytes() for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sets, pa.binary())], names=[*kept, "shingles"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(make, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", shingles binary")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``(a, b)``: rows (node, label), label the smallest node. Distributed label propagation."""
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).union(edges.select("a", "a")).union(edges.select("b", "b")).distinct(), "edges")
    labels = stage(both.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node"), "labels")
    for _ in range(rounds):
        near = salted_lookup(both, "b", labels.select(F.col("node").alias("b"), "label"), F.col("a")).groupBy("a").agg(F.min("label").alias("label"))
        near = stage(near, "near")
        after = salted_lookup(near, "label", labels.select(F.col("node").alias("label"), F.col("label").alias("further")), F.col("a"))
        after = stage(after.select(F.col("a").alias("node"), F.least("label", "further").alias("label")), "labels")
        moved = after.join(labels.withColumnRenamed("label", "was"), "node").filter("label != was").limit(1).count()
        labels = after
        if not moved:
            return labels
    raise RuntimeError("components did not settle")


def join(docs: DataFrame, threshold: float = 0.8, trees: int = 16, recall: float = 0.9995, longest: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id, class_size, text_doc_id, n_copies, n_text_links, n_links, prefix_length,
    recall.

    ``class_id`` is the smallest id of the documents connected by links; ``text_doc_id`` the smallest with the same
    shingles; ``n_links`` the other documents of similarity ``threshold`` or more, copies included; ``prefix_length`` the
    length to which the text's prefixes were shortened, and ``recall`` the measured recall there (null without words).
    """
    return _decide(docs, threshold, trees, recall, longest, id_col, text_col).drop("th", "stays")


def _linked(docs: DataFrame, texts: DataFrame, threshold: float, trees: int, recall: float, depths: Sequence[int], id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Compare texts from the longest prefixes to the shortest. Returns the cells' rows, and the state of each text that had
    company: text_id, links, doc_links, prefix_length, recall."""
    last = len(depths) - 1
    mark = [F.xxhash64("text_id").alias("f1"), F.xxhash64(F.lit(1), "text_id").alias("f2")]
    shortest = _nodes(texts.select("prefixes", *mark), last, trees).groupBy("tree", "node").agg(F.count("*").alias("n"), F.bit_xor("f1").alias("f1"), F.bit_xor("f2").alias("f2"))
    # the mark of a node with one text is that text's; a text that is such a node in every tree has no partner
    alone = shortest.filter("n = 1").groupBy("f1", "f2").agg(F.count("*").alias("n")).filter(F.col("n") == trees).drop("n")
    wanted = texts.select("text_id", "prefixes", "n_copies", "n_shingles", F.col("first.doc_id").alias("d"), F.col("first.th").alias("h"), *mark)
    wanted = stage(wanted.join(alone, ["f1", "f2"], "left_anti").drop("f1", "f2"), "wanted")
    n_wanted = wanted.count()
    text = F.col(f"`{text_col}`")
    fetched = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")))
    loaded = stage(_with_shingles(fetched.select("text_id", "prefixes", "n_copies", "text")), "shingles")
    weak = [f"w{k}" for k in range(len(depths))]
    state = wanted.select("text_id", "prefixes", "n_shingles", F.lit(True).alias("open"), F.lit(0).cast("long").alias("links"), F.lit(0).cast("long").alias("doc_links"), *(F.lit(0).cast("long").alias(w) for w in weak), F.lit(0).alias("prefix_length"), F.lit(0.0).alias("recall"))
    found, seen = [], None
    for level, depth in enumerate(depths):
        entries = _nodes(state.select("text_id", "open", "prefixes", "n_shingles"), level, trees).drop("prefixes")
        fingerprint = (F.bit_xor(F.xxhash64("text_id")).alias("f1"), F.bit_xor(F.xxhash64(F.lit(1), "text_id")).alias("f2"))
        nodes = entries.groupBy("tree", "node").agg(F.count("*").alias("n"), F.sum(F.col("n_shingles").cast("long")).alias("size"), F.max("open").alias("any_open"), *fingerprint).filter("n > 1 and any_open")
        blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("size") / BLOCK_SHINGLES)).cast("int").alias("blocks")
        # nodes with the same members are looked at once: under the longest prefix they share, in the first of their trees
        same = ["n", "size", "f1", "f2"]
        nodes = nodes.groupBy(*same).agg(F.min(F.struct("tree", "node")).alias("at"))
        if seen is not None:
            nodes = nodes.join(seen, same, "left_anti")
        nodes = stage(nodes.select("at.tree", "at.node", blocks, *same), "nodes")
        seen = nodes.select(*same) if seen is None else seen.union(nodes.select(*same))
        members = _members(entries, nodes.select("tree", "node", "blocks", "n"), n_wanted).withColumn("block", F.pmod(F.xxhash64("text_id"), F.col("blocks")).cast("int"))
        members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cells = members.select("text_id", "open", "tree", "node", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        verify, kinds = _verify_cells(threshold, trees, depths, level)
        found.append(stage(cells.join(loaded, "text_id").groupBy("tree", "node", "i", "j").applyInPandas(verify, kinds), "links"))
        sums = found[-1].groupBy("text_id").agg(*(F.sum(c).alias(f"+{c}") for c in ("links", "doc_links", *weak)))
        added = [(F.col(c) + F.coalesce(F.col(f"`+{c}`"), F.lit(0))).alias(c) for c in ("links", "doc_links", *weak)]
        reached = recall_of(F.col("links"), F.col(f"w{level}"), threshold, trees, depth)
        state = state.join(sums, "text_id", "left").select("text_id", "prefixes", "n_shingles", F.col("open").alias("was"), *added, "prefix_length", "recall")
        state = state.select("text_id", "prefixes", "n_shingles", (F.col("was") & (reached < recall)).alias("open"), "links", "doc_links", *weak, F.when(F.col("was"), depth).otherwise(F.col("prefix_length")).alias("prefix_length"), F.when(F.col("was"), reached).otherwise(F.col("recall")).alias("recall"))
        state = stage(state, "state")
    return reduce(DataFrame.unionByName, found), state


def _decide(docs: DataFrame, threshold: float, trees: int, recall: float, longest: int, id_col: str, text_col: str) -> DataFrame:
    depths = prefix_depths(threshold, trees, recall, longest)
    signed = stage(signed_texts(docs, id_col, text_col, trees, depths), "signed")
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    texts = signed.filter("text_id is not null").groupBy("text_id").agg(F.min(own).alias("first"), F.count("*").alias("n_copies"), F.min("prefixes").alias("prefixes"), F.min("n_shingles").alias("n_shingles"))
    texts = stage(texts, "texts")
    checked, state = _linked(docs, texts, threshold, trees, recall, depths, id_col, text_col)
    classes = components(checked.select(F.col("text_id").alias("a"), F.col("parent").alias("b")).distinct())
    company = state.select("text_id", "links", "doc_links", "prefix_length", "recall")
    known = texts.select("text_id", "first", "n_copies").join(company, "text_id", "left").join(classes.withColumnRenamed("node", "text_id"), "text_id", "left")
    known = stage(known.withColumn("label", F.coalesce("label", "text_id")), "known")
    sizes = known.groupBy("label").agg(F.min("first").alias("head"), F.sum("n_copies").alias("class_size"))
    known = stage(salted_lookup(known, "label", stage(sizes, "sizes"), F.col("text_id")), "classes").withColumn("found", F.lit(True))
    # a text may have any number of copies, so they are dealt by their ids
    worded = salted_lookup(signed.filter("text_id is not null"), "text_id", known, F.struct("doc_id", "th"))
    judged = worded.unionByName(signed.filter("text_id is null"), allowMissingColumns=True)
    alone = expected_recall(threshold, trees, depths[-1])
    return judged.select(
        "doc_id",
        "th",
        F.coalesce("head.doc_id", "doc_id").alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce("first.doc_id", "doc_id").alias("text_doc_id"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_text_links"),
        (F.coalesce("doc_links", F.lit(0)) + F.coalesce("n_copies", F.lit(1)) - 1).cast("long").alias("n_links"),
        F.when(F.col("found"), F.coalesce("prefix_length", F.lit(depths[-1]))).alias("prefix_length"),
        F.when(F.col("found"), F.coalesce("recall", F.lit(alone))).alias("recall"),
        (F.col("found").isNull() | (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("th") == F.col("head.th")))).alias("stays"),
    )


def keep_one(docs: DataFrame, threshold: float = 0.8, trees: int = 16, recall: float = 0.9995, longest: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but one document of each class (the one with the smallest id stays; of rows that
    share id and text, the one whose columns come first by hash)."""
    stays = _decide(docs, threshold, trees, recall, longest, id_col, text_col).filter("stays").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct()
    stays = stage(stays, "stays")
    marked = docs.withColumn("__hash", F.xxhash64(F.col(f"`{text_col}`")))
    kept = marked.join(stays, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__th")))
    once = Window.partitionBy("__id", "__th").orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    # rows that repeat an id and a text with words are copies, too
    numbered = kept.withColumn("__n", F.row_number().over(once))
    return numbered.filter((F.col("__n") == 1) | ~F.coalesce(F.col(f"`{text_col}`").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))).select(*(F.col(f"`{c}`") for c in docs.columns))
