"""Ranked search by pipelined term owners: against a plain ranking, for any block size and number of owners."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tallylane.llm import pipelined

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, item_id string, block long, score double, rank string, item string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(docs, items, top):
    held = [(key, Counter(TERM.findall(lower(text)))) for key, text, *_ in docs]
    n_docs = sum(bool(h) for _, h in held)
    n_terms = sum(sum(h.values()) for _, h in held)
    df = Counter(t for _, h in held for t in h)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(TERM.findall(lower(text)))
    out = []
    for item, own in wanted.items():
        scores = []
        for key, h in held:
            n = sum(h.values())
            m = 100 - 50 + (50 * n * n_docs) // n_terms if n else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * h[t]) // (1000 * h[t] + 20 * m)) for t in own if h[t])
            if score > 0:
                scores.append((-score, key is None, key))
        out += [(item, rank, key, -s) for rank, (s, _, key) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=str)


def rows():
    rng = random.Random(6)
    words = [a + b for a in ("ka", "le", "mi", "É", "9", "ñu日") for b in ("ra", "st", "Ö", "X", "7")]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.choice([1, 5, 20, 60]))) for _ in range(150)]
    texts += ["the ka-ra" for _ in range(40)] + ["", None, " \n\x00\x1f-", "ka " * 5000, "KARA\tkara·kara", "x" * 100_000]
    docs = [(1000 - i, t, "x", 1, 0.5, "r", "i") for i, t in enumerate(texts)]
    docs += [docs[3], (None, texts[5], None, None, None, None, None), (None, "", None, None, None, None, None), (7, texts[6], "a", 1, None, None, None), (7, texts[7], "a", 1, None, None, None)]
    items = [(f"q{i}", " ".join(rng.choices(words, k=rng.choice([1, 3, 12])))) for i in range(25)]
    return docs, [*items, ("q3", "kara again"), ("none", "zzz"), ("empty", ""), ("nul", None), (None, "ka ra kara"), ("all", " ".join(words)), items[4]]


@pytest.mark.parametrize(("block", "owners", "top"), [(4096, 4, 50), (16, 4, 5), (7, 1, 3), (64, 9, 1)])
def test_ranks_are_those_of_a_plain_ranking(spark, block, owners, top):
    docs, items = rows()
    found = pipelined.ranked(spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(items, "item_id string, text string"), top, owners=owners, block=block)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    # rows of one key and score change places freely
    assert sorted(map(tuple, found.collect()), key=str) == plain(docs, items, top)


def test_bundles_of_items(spark, monkeypatch):
    monkeypatch.setattr(pipelined, "ITEMS", 7)
    docs, items = rows()
    found = pipelined.ranked(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id string, text string"), 4)
    assert sorted(map(tuple, found.collect()), key=str) == plain(docs, items, 4)


def test_nothing_to_find(spark):
    docs, items = spark.createDataFrame(rows()[0], SCHEMA), spark.createDataFrame(rows()[1], "item_id string, text string")
    for a, b in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("text is null"), items), (docs, items.where("item_id = 'none'"))):
        found = pipelined.ranked(a, b)
        assert found.count() == 0 and [x[1] for x in found.dtypes] == ["string", "int", "bigint", "bigint"]


def test_accumulators_that_cannot_win_are_let_go():
    """Later terms add at most `behind`: below the kth score so far a document is dropped, at it it stays."""
    corpus = pipelined.Corpus(10, 100)
    wanted = [np.array([0, 1])]
    weights, gain = np.array([100, 50]), np.array([100 * 10**6, 50 * 10**6])
    owner = pipelined.Owner(wanted, weights, gain, np.array([True, False]), np.array([False, True]))
    lengths = pipelined._pack(np.array([10, 10, 10], "<u4"))
    postings = pipelined._pack(np.array([0], "<u4"), np.array([2], "<u4"), np.array([0, 2], "<u2"), np.array([1, 9], "<u4"))
    scores = [int(100 * corpus.factor(np.array([tf]), np.array([100]))[0]) for tf in (1, 9)]
    for least, kept in ((0, [0, 2]), (scores[0] + 50 * 10**6, [0, 2]), (scores[0] + 50 * 10**6 + 1, [2]), (scores[1] + 50 * 10**6 + 1, [])):
        found = list(pipelined._add(b"", lengths, postings, owner, corpus, np.array([least])))
        assert [d.tolist() for _, d, _ in found] == [kept] * bool(kept)
