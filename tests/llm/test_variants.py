"""Operator 13 against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gridtide.llm import qchunk_variants as variants

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n, ratio):
    out = {}
    for w in n:
        around = [v for v in n if near(v, w)]
        commoner = sorted((-n[v], v) for v in around if n[v] >= ratio * n[w])
        out[w] = (len(around), commoner[0][1] if commoner else None)
    rows = {}
    for w, (count, form) in out.items():
        root = w
        while out[root][1]:
            root = out[root][1]
        rows[w] = (n[w], count, form, n[form] if form else None, root)
    return rows


def vocabulary(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n bigint")


def mutate(rng, word, letters):
    i, kind, c = int(rng.integers(0, len(word) + 1)), rng.integers(0, 3), str(rng.choice(list(letters)))
    return word[:i] + c + word[i:] if kind == 0 else word[:i] + word[i + 1 :] if kind == 1 else word[:i] + c + word[i + 1 :]


@pytest.mark.parametrize("crowd", [0, 1 << 40])
def test_groups_equal_brute_force_at_any_crowding(spark, crowd, monkeypatch):
    rng = np.random.default_rng(5)
    counts = {"".join(rng.choice(list("abé"), int(rng.integers(3, 9)))): int(rng.integers(1, 3000)) for _ in range(150)}
    for w in list(counts)[:60]:
        counts.setdefault(mutate(rng, w, "abézÀ"), int(rng.integers(1, 20)))
    counts |= {"q" * 7: 5, "q" * 8: 60, "q" * 9: 700, "x" * 15: 1, "x" * 16: 50, "y" + "x" * 15: 50}
    counts.pop("", None)
    plain = variants.near_pairs
    monkeypatch.setattr(variants, "near_pairs", lambda words, least: plain(words, least, crowd))
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in variants.group(vocabulary(spark, counts), 10).collect()}
    assert got == brute(counts, 10)


def test_each_pair_comes_once(spark):
    words = {"a" * n: n for n in range(1, 7)} | {"aab": 1, "aba": 1, "baa": 1, "ab": 1, "ba": 1}
    pairs = [tuple(sorted((r.a, r.b))) for r in variants.near_pairs(vocabulary(spark, words), crowd=0).collect()]
    assert sorted(pairs) == sorted((a, b) for a in words for b in words if a < b and near(a, b))


def test_crowded_groups_are_not_compared_as_wholes(spark):
    # 3,000 words share their first half; pairs of them would be 4.5 million.
    rng = np.random.default_rng(1)
    counts = {"commonhead" + "".join(rng.choice(list("abcdefghijklmnop"), 10)): 1 for _ in range(3000)}
    base = next(iter(counts))
    counts[base[:-1]] = 100
    got = {r.word: (r.n_near, r.root) for r in variants.group(vocabulary(spark, counts), 10).collect()}
    assert got[base] == (1, base[:-1]) and len(got) == 3001 and sum(n for n, _ in got.values()) == 2


def words_by_hand(rows, noise=31, least=7, times=2):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % noise == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= least and k >= times}


def test_words_of_odd_texts(spark, make_docs, odd_texts):
    rows = list(enumerate(odd_texts)) + [(None, "ÀÉÎabcdefg ÀÉÎABCDEFG ×÷×÷×÷×÷ naïveté"), (None, "ÀÉÎabcdefg naïveté"), (3, "naïveté NAÏVETÉ naÏvetÉ")]
    rows += [(i, f"variant{'abcdefgh'[i % 8]}word and otherword{i % 3 * 'x'}") for i in range(400)]
    got = {r.word: r.n for r in variants.words(make_docs(rows)).collect()}
    assert got == words_by_hand(rows)
    every = {r.word: r.n for r in variants.words(make_docs(rows), noise=1, min_length=1, min_count=1).collect()}
    assert every == words_by_hand(rows, 1, 1, 1)


def test_empty_tables(spark, make_docs):
    empty = variants.words(make_docs([(1, "x")]).limit(0))
    assert variants.group(empty).count() == 0
    assert variants.group(vocabulary(spark, {"alone": 3})).collect()[0][:] == ("alone", 3, 0, None, None, "alone")
