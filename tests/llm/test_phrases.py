"""Phrase counts and scores against a plain count of all n-grams."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_helpers import LOWER, oracle, words
from pyspark.sql import functions as F

from timberline.llm import phrases


def expected(rows, least=10, top=2000):
    counts = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            for n in (1, 2, 3):
                counts["und" if lang is None else lang].update(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))
    out = set()
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        found = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and p in (q[:2], q[1:]) for q, b in candidates.items()):
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        found.sort()
        out |= {(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(found[:top])}
    return out


def rows_of(df):
    return {tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect()}


def made(spark, seed=1):
    r = random.Random(seed)
    common = [f"w{i}" for i in range(12)] + ["Été", "日本", "a\xa0b"]
    rows = []
    for i in range(160):
        text = ""
        for _ in range(r.randrange(60)):
            text += r.choice(common + ["new York city", "new York", "x x x x", "Zeta", f"rare{r.randrange(300)}"]) + r.choice([" ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "\xa0", "! "])
        rows.append((i, text, r.choice(["en", "en", "de", None])))
    rows += [(900, None, "en"), (901, "", None), (902, " .\n", "fr"), (903, "q " * 50_000, "en"), (904, "big one. " * 200_000, "de"), (None, "new york", "en")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.mark.parametrize("options", [{}, {"tile_mass": 500, "cells": 64, "flush_tokens": 300, "task_words": 50, "map_bits": 64}, {"tile_mass": 20_000, "cells": 1, "map_bits": 1 << 12}])
def test_counts_and_scores(spark, options):
    rows, df = made(spark)
    for name in ("word", "count", "id", "code", "chunk", "kind", "tile", "a", "n"):
        df = df.withColumn(name, F.lit("clash"))
    want = expected([(lang, text) for _, text, lang in rows], 3)
    assert len(want) > 60 and rows_of(phrases.mine(df.repartition(5), least=3, **options)) == want


def test_top_ties_and_thresholds(spark):
    rows = [("en", "b a. " * 10 + "c a. " * 10 + "d e f. " * 12 + "d e. " * 12 + "u v w. " * 20 + "u v. " * 21), (None, "one two " * 9), ("fr", "é à " * 30)]
    df = spark.createDataFrame(rows, "lang string, text string")
    for top in (3, 2000):
        assert rows_of(phrases.mine(df, top=top)) == expected(rows, top=top)
    assert rows_of(phrases.mine(df, least=3)) == expected(rows, least=3)


def test_awkward_and_empty(spark, awkward, empty):
    rows = [(r["lang"], r["text"]) for r in awkward.select("lang", "text").collect()]
    assert rows_of(phrases.mine(awkward)) == expected(rows)
    assert phrases.mine(empty).count() == 0


def test_dense_and_sparse_tiles_agree():
    r = np.random.default_rng(1)
    dense, sparse = phrases.TileCounter(30, 40, 10_000), phrases.TileCounter(30, 40, 10, buffer=50)
    for _ in range(20):
        row, column, counts = r.integers(0, 30, 90), r.integers(0, 40, 90), r.integers(1, 1 << 40, 90)
        dense.add(row, column, counts)
        sparse.add(row, column, counts)
    assert dense.dense is not None and sparse.dense is None
    for a, b in zip(dense.frequent(1 << 41), sparse.frequent(1 << 41), strict=True):
        assert (a == b).all()


def test_big_numbers_are_exact(spark):
    a, left, right = 987_654_321_987, 987_654_321_989, 999_999_999_999_999
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert df.select(phrases.score("a", "l", "r")).first()[0] == 1000000 * a * a // (left * right)


def test_words_like_a_regular_expression():
    import pyarrow as pa

    texts = [words(50, 3) + ".\tEnd,of\nit", None, "", "a..b  c", "été\xa0x! Z", "x"]
    known, codes, opens = phrases.words_of(pa.array(["skip", *texts]).slice(1))
    want, first = [], []
    for t in texts:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOWER)):
            own = re.findall(r"[^\x20\x09]+", piece)
            want += own
            first += [True] + [False] * (len(own) - 1) if own else []
    assert [known[c].decode() for c in codes] == want and opens.tolist() == first


def test_query_equals_sql(spark):
    oracle(spark, "op11_phrase_collocations")
