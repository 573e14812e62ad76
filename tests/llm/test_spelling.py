"""Spelling variants: against all pairs of words, by hand, and on odd rows."""

import random
import zlib
from collections import Counter

import pytest

from tallylane.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long, form string, best string"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts, factor=10):
    words = {w: n for w, n in counts.items() if n >= 2 and len(w) >= 7}
    form, rows = {}, []
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= factor * n else None
        rows.append((w, n, len(others)))
    out = []
    for w, n, count in rows:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, count, form[w], words.get(form[w]), root))
    return sorted(out)


def check(spark, texts, found=None):
    import re

    docs = [(i, t, "clash", 5, "form", None) for i, t in texts]
    counts = Counter()
    for key, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    found = spelling.variants(spark.createDataFrame(docs, SCHEMA).repartition(3))
    assert found.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert sorted(map(tuple, found.collect())) == plain(counts)


def test_all_pairs_of_small_alphabets(spark):
    rng = random.Random(2)
    pool = ["".join(rng.choice("aab") for _ in range(rng.choice([6, 7, 8, 9]))) for _ in range(260)] + ["éaaaaaaa", "éaaaaaab", "Éaaaaaaa", "ÉAAAAAAA", "aaaaaaa" * 9, "ÿaaaaaaa", "×bbbbbbb"]
    weights = [1 / (i + 1) ** 1.5 for i in range(len(pool))]
    check(spark, [(i, " ".join(rng.choices(pool, weights, k=40))) for i in range(150)])


def test_odd_rows(spark):
    long = "wonderful " * 30000
    texts = [(0, None), (1, ""), (2, long), (3, "wonderfull wonderfull Wonderful"), (3, "wonderfull wonderfull Wonderful"), (None, "wonderfuul wonderfuul abcdefg abcdefg"), (None, "abcdefh-abcdefh"), (9, "short a bc" * 50), (10, "x" * 50000)]
    check(spark, texts)
    check(spark, [])


def test_forms_and_roots_by_hand(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SPARED", 1 << 40)
    many = {"beginning": 400, "begining": 40, "beginin": 3, "beginnings": 40, "beginnins": 4, "separate": 20, "seperate": 2, "separata": 2, "xeparate": 2}
    docs = spark.createDataFrame([(1, " ".join(w for w, n in many.items() for _ in range(n)))], "doc_id long, text string")
    found = {r.word: r for r in spelling.variants(docs).collect()}
    assert {w: (r.form, r.root) for w, r in found.items()} == {
        "beginning": (None, "beginning"), "begining": ("beginning", "beginning"), "beginin": ("begining", "beginning"), "beginnings": ("beginning", "beginning"),
        "beginnins": ("beginning", "beginning"), "separate": (None, "separate"), "seperate": ("separate", "separate"), "separata": ("separate", "separate"), "xeparate": ("separate", "separate")}
    assert found["beginning"].n_near == 3 and found["separate"].n_near == 3 and found["seperate"].form_n == 20


@pytest.mark.parametrize("rows", [1, 7, 10000])
def test_ranges_that_span_batches(spark, rows):
    rng = random.Random(8)
    table = {"".join(rng.choice("ab") for _ in range(rng.choice([7, 8, 9]))): rng.randrange(2, 500) for _ in range(300)}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        found = spelling.near_words(spark.createDataFrame(list(table.items()), "word string, n long")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for w in table:
        if others := [x for x in table if near(w, x)]:
            best = min(others, key=lambda x: (-table[x], x))
            want[w] = (len(others), best, table[best])
    assert {r.word: (r.n_near, r.best, r.best_n) for r in found} == want
