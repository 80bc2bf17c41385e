"""Sharding, scoring, mixing, packing, near duplicates, token files and the pipeline against brute force."""

import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_helpers import LOWER, SF, words
from pyspark.sql import functions as F

from timberline.llm import common, lm_score, mixing, near_dup, packing, queries, shard, token_output
from timberline.llm.tokens import WordEncoder, default_path


# -- sharding

def test_shards_are_even_and_whole(spark, awkward, empty):
    out = shard.assign_shards(awkward, shards=7).collect()
    counts = Counter(r["shard"] for r in out)
    assert len(out) == awkward.count() and set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n))
    sizes = {r["doc_id"]: (len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in awkward.collect() if r["doc_id"]}
    assert all((r["size"], r["text_crc32"]) == sizes[r["doc_id"]] for r in out if r["doc_id"])
    assert shard.assign_shards(empty).count() == 0


def test_ring_places_like_a_walk_and_moves_little():
    r = random.Random(3)
    keys = sorted(r.sample(range(1 << 20), 3000))

    def placed(shards):
        cells, counts = np.unique(keys, return_counts=True)
        return {c: s for c, lo, hi, s, _ in shard.place(cells, counts, 20, shards, 64)}

    # brute force: by distance, then by position, each key goes to the first shard clockwise with room
    at, owner = shard.ring(10, 64)
    room = [300] * 10
    home = {k: int(np.searchsorted(at, k << 12)) % 640 for k in keys}
    want, todo, distance = {}, keys, 0
    while todo:
        rest = []
        for k in todo:
            s = int(owner[(home[k] + distance) % 640])
            if room[s]:
                room[s] -= 1
                want[k] = s
            else:
                rest.append(k)
        todo, distance = rest, distance + 1
    assert placed(10) == want
    grown = placed(11)
    moved = sum(want[k] != grown[k] for k in keys)
    assert moved < 0.45 * len(keys)  # plain re-hashing moves ten elevenths


# -- language model

def _split(text):
    return [*(text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split(), lm_score.END]


def _brute_scores(rows, is_held, mu=5.0, base=1.5):
    """Scores from exact counts, quantised but not entered in a filter."""
    words_of = [_split(t) for _, t in rows]
    c, cc = Counter(), Counter()
    for (i, _), w in zip(rows, words_of):
        if not is_held(i):
            c.update(w)
            cc.update(zip([lm_score.END, *w], w))
    n, v = sum(c.values()), len(c)
    starts = lm_score.thresholds(base).tolist()
    low = lambda x: max([0, *(s for s in starts if s <= x)])
    high = lambda x: min(s for s in starts if s > x) - 1 if x else 0
    unknown = (sum(x == 1 for x in c.values()) + 1) / (n + 2)
    lows, highs = {w: low(x) for w, x in c.items()}, {w: high(x) for w, x in c.items()}
    pair_lows = {x: low(k) for x, k in cc.items()}
    out = []
    for w in words_of:
        total = 0.0
        for before, word in zip([lm_score.END, *w], w):
            alone = (1 - unknown) * lows[word] / n if word in c else unknown
            together = min(pair_lows.get((before, word), 0), highs.get(word, 0), highs.get(before, 0))
            total += math.log10((together + mu * alone) / (highs.get(before, 0) + mu))
        out.append((len(w), sum(x in c for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), total))
    return out


def test_scores_against_exact_counts(spark, awkward, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(awkward.select("doc_id", "text"))
    docs = docs.select(F.struct("doc_id", "text").alias("id"), "text", F.lit("clash").alias("seg"), F.lit("clash").alias("held_out"))
    held = F.crc32(F.col("id.doc_id").cast("string").cast("binary")) % 10 == 0
    is_held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    rows = [(r["id"]["doc_id"], r["text"]) for r in docs.collect()]
    want = {k: v for k, v in zip(rows, _brute_scores(rows, is_held))}
    for options in ({"bits": 48}, {"bits": 48, "flush": 3000, "segment_bytes": 20_000, "broadcast_bytes": -1}, {}):  # the second: many chunks and segments
        report = {}
        out = lm_score.train_and_score(docs, held, "id", report=report, **options).collect()
        assert len(out) == len(rows)
        close = off = 0
        for r in out:
            n_tokens, n_known, n, base_score, score = want[(r["doc_id"]["doc_id"], r["doc_id"]["text"])]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n_tokens, n_known, n, is_held(r["doc_id"]["doc_id"]))
            assert math.isclose(r["base_score"], base_score, rel_tol=1e-9)
            off += abs(r["score"] - score)
            close += math.isclose(r["score"], score, rel_tol=1e-9)
        assert report["false_hits"] <= (0.012 if not options else 0.001) * report["absent"] + 3
        # false hits move a few tokens
        assert off < 0.01 * sum(abs(v[4]) for v in want.values()) and (not options or close >= 0.9 * len(rows))
    fresh = [r for r in out if r["held_out"]]
    assert fresh and sum(r["score"] for r in fresh) > sum(r["base_score"] for r in fresh)
    assert lm_score.train_and_score(docs.limit(0), held, "id").count() == 0
    nothing = lm_score.train_and_score(docs.limit(20), F.lit(True), "id").collect()
    assert len(nothing) == 20 and all(r["n_known"] == 0 == r["train_tokens"] for r in nothing)


def test_a_kept_model_scores_unseen_texts_alike_both_ways(spark, awkward):
    """Broadcast filter and probes sent to its segments read the same bits; training rows scored again keep their scores."""
    train = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").filter("doc_id % 3 > 0")
    model, trained = lm_score.fit(train, segment_bytes=30_000, flush=4000)
    assert model.depth > 2 and model.table.count() > 2 and model.bytes > model.facts["filter_bytes"] > 0
    fresh = awkward.select("doc_id", "text").unionByName(train.limit(40)).withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" never-seen the of")))
    here, sent = ({(r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 9), round(r["score"], 9)) for r in lm_score.score(fresh, model, broadcast_bytes=b).collect()} for b in (1 << 40, -1))
    assert here == sent and len(here) >= 80
    again = {r["doc_id"]: (r["score"], r["base_score"]) for r in lm_score.score(train, model, broadcast_bytes=-1).collect()}
    for r in trained.collect():
        assert math.isclose(again[r["doc_id"]][0], r["score"], rel_tol=1e-12) and math.isclose(again[r["doc_id"]][1], r["base_score"], rel_tol=1e-12)
    assert lm_score.score(train.limit(0), model).count() == 0
    nothing, _ = lm_score.fit(train.limit(0))
    for b in (1 << 40, -1):
        assert all(r["n_known"] == 0 for r in lm_score.score(train.limit(5), nothing, broadcast_bytes=b).collect())


def test_a_trained_copy_tells_a_held_out_text_apart(spark):
    """A held-out text whose one copy was trained on scores higher than those without: pairs seen once count."""
    texts = [words(150, 3000 + i) for i in range(120)]
    rows = [(i, t, i >= 100) for i, t in enumerate(texts)] + [(200 + i, texts[i], True) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    out = {r["doc_id"]: r["score"] / r["n_tokens"] for r in lm_score.train_and_score(docs, F.col("held")).collect()}
    assert min(out[200 + i] for i in range(20)) > max(out[100 + i] for i in range(20))


def test_filter_gives_rounded_counts_back():
    r = np.random.default_rng(1)
    keys = r.integers(0, 1 << 41, 4000).astype(np.uint64)
    counts = r.integers(1, 50, 4000)
    levels = lm_score.Levels(lm_score.thresholds(1.5))
    want = levels.level(counts)
    part = lm_score.Filter(int(want.sum()), 12)
    part.enter(keys, want)
    got = part.probe(keys, len(levels.starts))
    assert (got >= want).all() and (got == want).mean() > 0.97
    assert (levels.low(want) <= counts).all() and (counts <= levels.high(want)).all()
    others = r.integers(0, 1 << 41, 40000).astype(np.uint64)
    assert (part.probe(others, len(levels.starts)) > 0).mean() < 0.01


def test_byte_strings_give_their_numbers_back():
    r = np.random.default_rng(2)
    for n in (0, 1, 1000):
        c, h, x = r.integers(0, 1 << 45, n), np.sort(r.integers(0, 1 << 64, n, dtype=np.uint64)), r.integers(0, 1 << 20, n)
        assert (lm_score.unpack_counts(lm_score.pack_counts(c)) == c).all()
        assert (lm_score.unpack_sorted(lm_score.pack_sorted(h)) == h).all()
        for depth in (0, 1, 9):
            segment, place = lm_score.segment_of(h, depth), lm_score.place_in_segment(h, depth)
            assert ((segment >= 0) & (segment < 1 << depth)).all() and (np.diff(segment * (1 << 32) + place.astype(np.int64)) >= 0).all()
        assert (lm_score.unpack_numbers(lm_score.pack_numbers(x)) == x).all()


def test_probabilities_add_up_to_one_at_most(spark):
    """The scores of all words after one context, with the unknown word for all others."""
    train = [(i, words(300, i), False) for i in range(20)]
    vocabulary = sorted({w for _, t, _ in train for w in t.split()})
    asked = [(1000 + k, f"the {w}", True) for k, w in enumerate([*vocabulary, "never-seen"])] + [(5000, "the", True)]
    docs = spark.createDataFrame(train + asked, "doc_id long, text string, held boolean")
    # log P(the w END) - log P(the END) has the same END term for no two words, so the words' own terms are taken from brute force
    rows = [(i, t) for i, t, _ in train + asked]
    brute = _brute_scores(rows, lambda i: i >= 1000)
    got = {r["doc_id"]: r["score"] for r in lm_score.train_and_score(docs, F.col("held"), bits=48).collect()}
    assert sum(math.isclose(got[i], b[4], rel_tol=1e-9) for (i, _), b in zip(rows, brute)) > 0.99 * len(rows)
    c, cc = Counter(), Counter()
    for _, t, _ in train:
        c.update(_split(t))
        cc.update(zip([lm_score.END, *_split(t)], _split(t)))
    levels = lm_score.Levels(lm_score.thresholds(1.5))
    low = lambda x: levels.low(levels.level(np.asarray([x])))[0]
    high = lambda x: levels.high(levels.level(np.asarray([x])))[0]
    n, unknown = sum(c.values()), (sum(x == 1 for x in c.values()) + 1) / (sum(c.values()) + 2)
    after = sum((min(low(cc[(b"the", w)]), high(c[w]), high(c[b"the"])) + 5.0 * (1 - unknown) * low(c[w]) / n) / (high(c[b"the"]) + 5.0) for w in c)
    assert 0.3 < after + 5.0 * unknown / (high(c[b"the"]) + 5.0) <= 1.0


# -- mixing

def test_budgets_prefer_siblings():
    supply = {("a", "x"): 10, ("a", "y"): 1000, ("b", "z"): 1000}
    out = mixing.budgets(supply, lambda p: 1.0, 400, 2)
    assert out == pytest.approx({("a", "x"): 20, ("a", "y"): 180, ("b", "z"): 200})
    out = mixing.budgets({("a", "x"): 10, ("a", "y"): 20, ("b", "z"): 1000}, lambda p: 1.0, 400, 2)
    assert out == pytest.approx({("a", "x"): 20, ("a", "y"): 40, ("b", "z"): 340})
    assert sum(mixing.budgets(supply, lambda p: 1.0, 1e9, 4).values()) == 4 * 2010


def test_mixing_takes_token_prefixes(spark, documents, awkward, empty):
    for docs in (documents, awkward):
        labels = {"domain": queries.domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
        out = mixing.mix_sources(docs, labels, queries.weight_of).select("doc_id", "lang", "source", "__epoch", "__n_tokens", queries.domain_of(F.col("source")).alias("domain")).collect()
        everything = docs.select(queries.domain_of(F.col("source")).alias("domain"), "lang", "source", "doc_id", "text").collect()
        supply, longest = Counter(), Counter()
        for r in everything:
            leaf, n = (r["domain"], r["lang"], r["source"]), len((r["text"] or "").encode().split())
            supply[leaf] += n
            longest[leaf] = max(longest[leaf], 2 * n)  # a repeated row is taken with its twin
        want = mixing.budgets(supply, queries.weight_of, sum(supply.values()), 4)
        got = Counter()
        seen = defaultdict(Counter)
        for r in out:
            got[(r["domain"], r["lang"], r["source"])] += r["__n_tokens"]
            seen[r["doc_id"]][r["__epoch"]] += 1
        for leaf, budget in want.items():
            assert budget - 1e-6 <= got[leaf] < budget + longest[leaf] + 1e-6 or supply[leaf] == 0
        assert all(sorted(e) == list(range(len(e))) for e in seen.values())
    assert mixing.mix_sources(empty, labels).count() == 0


def test_mixing_takes_the_documents_brute_force_takes(spark, documents, awkward):
    """Which documents each leaf takes in its last, partial epoch: in the order of their seeded places, one by one."""
    for docs, total in ((documents, None), (documents, 20_000), (awkward, None)):
        labels = {"domain": queries.domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
        key = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.coalesce("text", F.lit(""))))
        places = F.array(*(F.xxhash64(F.lit(17), F.lit(e), key) for e in range(5)))
        rows = docs.select(labels["domain"].alias("domain"), "lang", "source", "doc_id", "text", places.alias("places")).collect()
        leaves = defaultdict(list)
        for r in rows:
            leaves[(r["domain"], r["lang"], r["source"])].append((r["doc_id"], len((r["text"] or "").encode().split()), [p % (1 << 64) for p in r["places"]]))
        supply = {leaf: sum(n for _, n, _ in own) for leaf, own in leaves.items()}
        want = Counter()
        for leaf, budget in mixing.budgets(supply, queries.weight_of, total or sum(supply.values()), 4).items():
            whole = min(int(budget // supply[leaf]) if supply[leaf] else int(budget > 0), 4)
            rest = budget - whole * supply[leaf] if supply[leaf] else 0.0
            for doc, _, _ in leaves[leaf]:
                want.update((doc, e) for e in range(whole))
            at = defaultdict(list)
            for doc, n, places in leaves[leaf]:
                at[places[whole]].append((doc, n))
            taken = 0
            for place in sorted(at):
                if taken >= rest:
                    break
                taken += sum(n for _, n in at[place])
                want.update((doc, whole) for doc, _ in at[place])
        got = mixing.mix_sources(docs, labels, queries.weight_of, total_tokens=total).select("doc_id", "__epoch").collect()
        assert Counter((r["doc_id"], r["__epoch"]) for r in got) == want


# -- packing and token files

def test_word_ids_are_whole_text_ids(awkward, documents):
    from tokenizers import Tokenizer

    texts = [r["text"] or "" for r in awkward.union(awkward).collect()] + [r["text"] for r in documents.collect()] + ["a  b\n\n c \n", " \n", "a\t\n b", "l'été  d'or", "x́ ́y", "IT'S we'll 'Tis 12a 3²", "ŒUVRE ÷ × µ"]
    r = random.Random(8)
    texts += ["".join(r.choice("ab Zé'sÀ19.,!\n  <|>ß") for _ in range(r.randrange(60))) for _ in range(2000)]
    for name, keeps in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        whole, encoder = Tokenizer.from_file(default_path(name)), WordEncoder(default_path(name), keeps)
        for t in texts:
            assert encoder.encode(t) == np.asarray(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing(spark, awkward, empty, documents):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(default_path("word_bpe_49k.json"))
    for docs in (awkward, documents):
        out = packing.pack(docs, with_ids=True).collect()
        want = Counter()
        for r in docs.collect():
            ids = [*whole.encode(r["text"] or "", add_special_tokens=False).ids, 0]
            for k in range(0, len(ids), 2048):
                want[(r["doc_id"], k // 2048, k, np.asarray(ids[k : k + 2048], "<u4").tobytes())] += 1
        assert Counter((r["doc_id"], r["piece"], r["start"], bytes(r["ids"])) for r in out) == want
        assert all(r["ids_crc32"] == zlib.crc32(r["ids"]) and r["length"] * 4 == len(r["ids"]) for r in out)
        bins = defaultdict(list)
        for r in out:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for pieces in bins.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= 2048
        assert len(bins) <= math.ceil(sum(r["length"] for r in out) / 2048) * 1.02 + 1
    assert packing.pack(empty).count() == 0


def test_plan_uses_every_piece_once():
    r = np.random.default_rng(5)
    for most in (3, 40, 2048):
        counts = np.zeros(2049, np.int64)
        np.add.at(counts, r.integers(1, most + 1, 3000), 1)
        used = np.zeros(2049, np.int64)
        for pattern, repeats in packing.plan_bins(counts.copy()):
            assert 0 < sum(size * n for size, n in pattern) <= 2048
            for size, n in pattern:
                used[size] += n * repeats
        assert (used == counts).all()


def test_token_files_round_trip(spark, awkward, empty, documents, tmp_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    for k, docs in enumerate((awkward, documents)):
        folder = f"file://{tmp_path}/t{k}"
        token_output.write_tokens(docs, folder, partitions=3)
        out = token_output.read_tokens(spark, folder).orderBy("start").collect()
        want = Counter((r["doc_id"], np.asarray([*whole.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for r in docs.collect())
        assert Counter((r["doc_id"], bytes(r["ids"])) for r in out) == want
        assert [r["doc_id"] for r in out] == sorted((r["doc_id"] for r in out), key=lambda i: (i is not None, i or 0))
        assert [r["start"] for r in out] == [0, *np.cumsum([r["n_tokens"] for r in out])[:-1].tolist()]
        assert all(r["ids_crc32"] == zlib.crc32(r["ids"]) and 4 * r["n_tokens"] == len(r["ids"]) for r in out)
        # shuffled reads by the index: the same records, in an order of their own each epoch
        orders = [[(r["start"], bytes(r["ids"])) for r in token_output.read_shuffled(spark, folder, 1, e).collect()] for e in (0, 1)]
        assert sorted(orders[0]) == sorted(orders[1]) == [(r["start"], bytes(r["ids"])) for r in out]
        assert orders[0] != orders[1] != sorted(orders[1]) != orders[0]
        assert [x["start"] for x in token_output.read_shuffled(spark, folder, 1).collect()] == [s for s, _ in orders[0]]
    assert token_output.round_trip(empty).count() == 0
    # a flipped byte is noticed
    file = next((tmp_path / "t1").glob("*.bin"))
    data = bytearray(file.read_bytes())
    data[len(data) // 2] ^= 1
    file.write_bytes(bytes(data))
    with pytest.raises(Exception, match="broken record"):
        token_output.read_tokens(spark, f"file://{tmp_path}/t1").count()


def test_frame_layout():
    payload = b"abc"
    data = token_output.frame(payload)
    assert struct.unpack("<Q", data[:8]) == (3,) and data[12:15] == payload and len(data) == 19


# -- near duplicates

def _shingle_set(text):
    w = (text or "").translate(LOWER).encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def _brute(rows):
    """links per row, and classes, over all pairs."""
    sets = [_shingle_set(r["text"]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and common >= 0.8 * (len(sets[i]) + len(sets[j]) - common) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    classes = defaultdict(list)
    for i in range(len(rows)):
        classes[root(i)].append(i)
    return links, list(classes.values())


def _near_copies(n, length, seed):
    r = random.Random(seed)
    base = words(length, seed).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(0, max(2, length // 40))):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_against_all_pairs(spark, awkward, empty, monkeypatch):
    rows = [(i, t) for i, t in enumerate(_near_copies(60, 150, 11) + _near_copies(25, 300, 12) + [words(100, 500 + i) for i in range(40)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (256, 16):  # with small blocks the large group spans many cells
        monkeypatch.setattr(near_dup, "BLOCK", block)
        for table in (docs, awkward.select("doc_id", "text")):
            plain = table.collect()
            links, classes = _brute(plain)
            out = near_dup.join(table).collect()
            assert len(out) == len(plain)
            want = Counter((r["doc_id"], n) for r, n in zip(plain, links))
            assert Counter((r["doc_id"], r["n_links"]) for r in out) == want
            sizes = Counter((plain[i]["doc_id"], len(c)) for c in classes for i in c)
            assert Counter((r["doc_id"], r["class_size"]) for r in out) == sizes
    kept = near_dup.keep_one(awkward)
    assert kept.columns == awkward.columns
    links, classes = _brute(awkward.select("doc_id", "text").collect())
    assert kept.count() == len(classes)
    assert near_dup.join(empty).count() == 0 and near_dup.keep_one(empty).count() == 0


def test_prefixes_end_where_the_threshold_has_the_recall():
    depths = near_dup.prefix_depths(0.8, 16, 0.9995)
    assert depths[0] == 8 and depths == sorted(depths, reverse=True)
    assert near_dup.expected_recall(0.8, 16, depths[-1]) >= 0.9995 > near_dup.expected_recall(0.8, 16, depths[-1] + 1)


def test_prefixes_are_shortened_by_measured_recall(spark):
    """Texts with many close copies stay under long prefixes; texts with few links, or with links near the threshold, go on
    to shorter ones. No link is lost: neither among the many, nor from a looser copy to them."""
    r = random.Random(5)
    base = words(400, 77).split()
    rows = [" ".join(base[:k] + [f"own{k}"] + base[k + 1 :]) for k in range(0, 400, 2)]  # 200 texts, similar by 0.95 and more
    for n in (6, 8):  # looser copies
        w = list(base)
        for _ in range(n):
            w[r.randrange(len(w))] = f"loose{r.random()}"
        rows.append(" ".join(w))
    rows += _near_copies(5, 200, 78) + [words(120, 700 + i) for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    out = {x["doc_id"]: x for x in near_dup.join(docs).collect()}
    links, _ = _brute(docs.orderBy("doc_id").collect())
    assert [out[i]["n_links"] for i in range(len(rows))] == links
    assert sum(out[i]["prefix_length"] > 4 for i in range(200)) > 100
    assert {out[i]["prefix_length"] for i in range(202, len(rows))} == {4}
    assert all(x["recall"] >= 0.9995 for x in out.values())


def test_recall_of_queries_against_all_rows(spark, monkeypatch):
    """Links of every row whose id is divisible by 20, against all rows."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    sets = {r["doc_id"]: _shingle_set(r["text"]) for r in rows}
    holders = defaultdict(list)
    for i, shingles in sets.items():
        for x in shingles:
            holders[x].append(i)
    want = {}
    for i in (i for i in sets if i % 20 == 0):
        common = Counter(j for x in sets[i] for j in holders[x] if j != i)
        want[i] = sum(c >= 0.8 * (len(sets[i]) + len(sets[j]) - c) - 1e-9 for j, c in common.items())
    got = {r["doc_id"]: r["n_links"] for r in near_dup.join(docs).filter("doc_id % 20 = 0").collect()}
    assert sum(want.values()) > 0 and all(got[i] <= want[i] for i in want)
    assert sum(got.values()) >= 0.99 * sum(want.values())


def test_lookups_deal_a_frequent_key(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("k"))
    table = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    out = common.salted_lookup(rows, "k", table, F.col("id")).collect()
    assert len(out) == 3000 and all(r["v"] == 2 * r["k"] for r in out)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31), (31, 29), (40, 40)], "a long, b long")
    out = {r["node"]: r["label"] for r in near_dup.components(edges).collect()}
    assert out == {**{i: 0 for i in range(21)}, 29: 29, 30: 29, 31: 29, 40: 40}


# -- pipeline

def test_pipeline_stages(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "source_mixing", "best_two_fit_packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes, name
        docs = spark.createDataFrame(after.collect(), docs.schema)
    assert 0 < docs.count()
    assert p.run(spark, SF).count() > 0


def test_pipeline_handles_awkward_and_empty_rows(spark, awkward, empty):
    """Each stage on all rows, those the quality rules would reject too."""
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    key = lambda r: (r["doc_id"], r["text"])
    rows = awkward.collect()
    good = p.quality_rules(spark, awkward, SF).collect()
    assert Counter(map(key, good)) <= Counter(map(key, rows)) and good and all(len((r["text"] or "").split()) >= 50 for r in good)
    assert not {5, 6, 7, 9} & {r["doc_id"] for r in good}
    cleaned = p.line_dedup_stage(spark, awkward, SF).collect()
    assert Counter(r["doc_id"] for r in cleaned) == Counter(r["doc_id"] for r in rows) and sum(r["text"] is None for r in cleaned) == sum(r["text"] is None for r in rows)
    left = p.near_duplicates(spark, awkward, SF).collect()
    _, classes = _brute(rows)
    assert len(left) == len(classes) and Counter(map(key, left)) <= Counter(map(key, rows))
    assert sum(not _shingle_set(r["text"]) for r in left) == sum(not _shingle_set(r["text"]) for r in rows)
    mixed = p.source_mixing(spark, awkward, SF).collect()
    assert {key(r) for r in mixed} <= {key(r) for r in rows} and mixed
    whole = Tokenizer.from_file(default_path("word_bpe_49k.json"))
    pieces = p.best_two_fit_packing(spark, awkward, SF).collect()
    assert sum(r["length"] for r in pieces) == sum(len(whole.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in rows)
    for _, stage in p.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_pipeline_keeps_one_of_many_copies(spark):
    """Thirty copies in a host of a hundred pages: one leaves the near-duplicate stage with its text, and the footer still goes."""
    import corpus_pipeline as p

    copied = "\n".join(words(20, 900 + k) for k in range(5))
    rows = [(i, copied if i < 30 else words(60, i) + "\nfooter of the site", "en", "host", 0) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = p.near_duplicates(spark, p.line_dedup_stage(spark, docs, SF), SF).collect()
    assert sum(r["text"] == copied for r in out) == 1
    assert {r["text"] for r in out} == {copied} | {words(60, i) for i in range(30, 100)} and len(out) == 71


def test_pipeline_cleans_small_hosts(spark):
    """A footer on all pages of a small host goes; a line that two of its pages share stays."""
    import corpus_pipeline as p

    own = [words(30, i) + ("\nshared by two" if i < 2 else "") for i in range(19)]
    docs = spark.createDataFrame([(i, own[i] + "\nfooter of the site", "en", "host", 0) for i in range(19)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"]: r["text"] for r in p.line_dedup_stage(spark, docs, SF).collect()} == dict(enumerate(own))
