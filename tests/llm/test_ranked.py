"""Operator 11 against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from gridtide.llm import bag_search

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
TERMS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return [t.translate(LOWER) for t in TERMS.findall(text or "")]


def brute(docs, items, top):
    bags = [(k, Counter(terms(t))) for k, t in docs]
    bags = [(k, b, b.total()) for k, b in bags if b]
    n, length, df = len(bags), sum(x[2] for x in bags), Counter(t for _, b, _ in bags for t in b)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for i, some in wanted.items():
        scored = []
        for k, b, size in bags:
            m = 50 + (50 * size * n) // length
            scored.append((-sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 20 * m)) for t in some if b[t]), k is not None, k))
        out += [(i, r + 1, k, -s) for r, (s, _, k) in enumerate(sorted(x for x in scored if x[0] < 0)[:top])]
    return sorted(out, key=str)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id string, text string")


def check(spark, make_docs, docs, items, top):
    got = bag_search.search(make_docs(docs), items_of(spark, items), top).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items, top)


def test_equals_brute_force_with_copies_and_ties(spark, make_docs, text_of):
    rng = np.random.default_rng(0)
    docs = [(i, text_of(rng, int(rng.integers(1, 60)))) for i in range(200)]
    # Same bags from other orders of words, copies in large numbers, ties across bags, repeated and null keys.
    docs += [(1000 - i, "Beta1 alpha0 gamma9" if i % 2 else "gamma9 BETA1, alpha0 unknown") for i in range(130)]
    docs += [(5, "alpha0"), (5, "alpha0"), (None, "alpha0"), (None, "beta1"), (2**40, "beta1")]
    items = [(f"i{j}", text_of(rng, 12)) for j in range(20)] + [("one", "alpha0"), ("one", "beta1"), (None, "gamma9"), ("none", "!"), ("null", None), ("absent", "zzzz")]
    check(spark, make_docs, docs, items, 7)


def test_odd_texts_and_blocks(spark, make_docs, odd_texts, monkeypatch):
    docs = list(enumerate(odd_texts))
    items = [("a", "repeat alpha1 ß"), ("b", "漢字 X aaa"), ("c", "x" * 60_000), ("d", odd_texts[5][:3000])]
    monkeypatch.setattr(bag_search, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(bag_search, "HELD", 2)
    monkeypatch.setattr(bag_search, "STEP", 5)
    check(spark, make_docs, docs, items, 3)


@pytest.mark.parametrize("docs, items", [([], [("a", "x")]), ([(1, "x")], []), ([(1, None)], [("a", "x")]), ([(1, "x")], [("a", None)])])
def test_empty_sides(spark, make_docs, docs, items):
    found = bag_search.search(make_docs(docs or [(1, "x")]).limit(len(docs)), items_of(spark, items or [("a", "x")]).limit(len(items)))
    assert found.count() == 0 and found.columns == ["item_id", "rank", "doc_id", "score"]


def test_sums_beyond_doubles_stay_exact():
    value = np.array([2**53, 1, 2**53 + 1, 3], np.int64)
    assert bag_search._sums(np.array([0, 0, 1, 1]), value, 2).tolist() == [2**53 + 1, 2**53 + 4]
