"""Ranked search against plain scoring of every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from attestra.llm import search


def terms_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, k=10):
    bags = [(i, Counter(terms_of(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for at, (i, b) in enumerate(bags):
            m = 100 - 75 + (75 * sum(b.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m)) for t in terms_of(text) if t in b)
            if s > 0:
                scored.append((-s, i is None, i or 0, at, i))
        out += [(item, r, x[4], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()], key=repr)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(12)
    names = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5))) for _ in range(300)]
    pick = lambda n: " ".join(names[min(int(r.expovariate(0.02)), 299)] for _ in range(n))
    docs = [(i, pick(r.randint(1, 90))) for i in range(400)]
    docs += [(1000 + i, docs[3][1]) for i in range(30)]  # ties
    docs += [(1000, docs[3][1]), (None, docs[3][1]), (None, "rareword common"), (2000, None), (2001, ""), (2002, " .,!"), (2003, pick(20000)), (2004, "Été ÉTÉ été don't 中文 X_Y x")]
    items = [(i, pick(25)) for i in range(12)] + [(50, docs[3][1]), (51, "rareword rareword, Rareword"), (52, None), (53, "?!"), (54, "nowhere"), (55, "Été x_y 中文"), (50, docs[3][1])]
    return docs, items


def test_search_against_brute_force(spark, corpus):
    docs, items = corpus
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, score string").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    want = brute(docs, items)
    assert rows_of(search.search(d, q)) == want
    assert rows_of(search.search(d, q, block_bytes=400)) == want  # in blocks


def test_search_many_shards(spark, corpus, monkeypatch):
    docs, items = corpus
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    q = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(search, "SHARD_DOCS", 16)
    assert rows_of(search.search(d, q, k=3)) == brute(docs, items, 3)


def test_search_empty(spark, corpus):
    docs, items = corpus
    no_docs, no_items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert search.search(no_docs, spark.createDataFrame(items, "item_id long, text string")).collect() == []
    assert search.search(spark.createDataFrame(docs, "doc_id long, text string"), no_items).collect() == []
    assert search.search(spark.createDataFrame([(1, None)], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect() == []


def test_wand_skips():
    r = np.random.default_rng(1)
    lists = []
    for share, top in ((0.9, 3), (0.7, 5), (0.5, 9), (0.02, 400), (0.01, 700)):
        places = np.flatnonzero(r.random(5000) < share).astype(np.int32)
        lists.append((places, r.integers(1, top + 1, len(places)), top))
    full = np.zeros(5000, np.int64)
    for places, impacts, _ in lists:
        full[places] += impacts
    for least in (1, 12, 300, 600, 2000):
        at, score = search.wand(lists, 5000, least)
        assert at.tolist() == np.flatnonzero(full >= least).tolist() and score.tolist() == full[at].tolist()
    assert len(search.wand(lists, 5000, 600)[0]) < 60
