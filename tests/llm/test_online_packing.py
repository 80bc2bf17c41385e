"""Bounded-space packing: every id once, no padding but what powers of two spare, few cuts."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from llm_helpers import SF, words

from timberline.llm import online_packing, queries
from timberline.llm.online_packing import Packer, cuts
from timberline.llm.tokens import default_path


def held(spark, docs, out, window=2048):
    """Check pieces against a plain tokenizer; the pieces per sequence."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    want = defaultdict(list)
    for doc, text in docs:
        want[doc].append(plain.encode(text or "", add_special_tokens=False).ids + [1])
    got = defaultdict(list)
    sequences = defaultdict(list)
    for r in out:
        got[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(got) == set(want)
    for doc, texts in want.items():
        if len(texts) > 1:
            assert sum(r["length"] for r in got[doc]) == sum(map(len, texts))
            continue
        at = 0
        for r in sorted(got[doc], key=lambda r: r["start"]):
            part = texts[0][at : at + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(texts[0]) and r["ids_crc32"] == zlib.crc32(np.asarray(part, "<u4").tobytes())
            at += r["length"]
        assert at == len(texts[0])
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == window or (at < window and at & (at - 1) == 0)
    return sequences


def test_awkward_rows(spark, awkward, empty):
    rows = [(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect()]
    for window, open_windows in ((2048, 16), (64, 1), (100, 3)):
        out = online_packing.pack_online(awkward.repartition(3, "doc_id"), window=window, open_windows=open_windows).collect()
        held(spark, rows, out, window)
    assert online_packing.pack_online(empty).count() == 0
    with pytest.raises(ValueError):
        online_packing.pack_online(empty, open_windows=0)


def test_a_text_of_megabytes_and_many_partitions(spark):
    rows = [(0, words(400_000, 9)), (1, None), (2, "")] + [(i, words(i % 90, i)) for i in range(3, 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(20)
    held(spark, rows, online_packing.pack_online(docs).collect())


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = queries.queries()["op12_online_packing"](spark, SF).collect()
    sequences = held(spark, rows, out)
    total = sum(r["length"] for r in out)
    assert len(sequences) <= total // 2048 + 11
    assert len(out) - len(rows) <= 2 * len(sequences) + 11  # cuts: about one a window


def test_best_fit_and_fullest():
    packer = Packer(10, 2)
    ids = np.arange(40, dtype="<u4")
    assert not list(packer.add((1, 0, 6, ids[:6]))) and not list(packer.add((2, 0, 8, ids[:8])))  # gaps 4 and 2
    full = list(packer.add((3, 0, 2, ids[:2])))  # best fit: the gap of 2
    assert [[p[0] for p in w] for w in full] == [[2, 3]]
    assert not list(packer.add((4, 0, 7, ids[:7])))  # gaps 4 and 3
    full = list(packer.add((5, 0, 5, ids[:5])))  # none fits: the fullest takes three and goes, two stay
    assert [[(p[0], p[1], len(p[3])) for p in w] for w in full] == [[(4, 0, 7), (5, 0, 3)]]
    assert not list(packer.finish()) or packer.left is not None
    assert sum(len(p[3]) for p in packer.left) == 8
    full = list(packer.add((6, 0, 25, ids[:25])))
    assert [len(w[0][3]) for w in full[:2]] == [10, 10]


def test_tail_in_powers_of_two():
    for total in range(0, 5000, 7):
        tail = cuts(total, 2048)
        parts = np.diff(tail)
        assert tail[0] == total // 2048 * 2048 and tail[-1] == total and all(p & (p - 1) == 0 for p in parts)
