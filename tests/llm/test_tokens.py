"""Operators 3 and 5 against the libraries and exact round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers as tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from gridtide.llm import bpe_count, bpe_tree

RANKS = bpe_tree.read_ranks(tokenizers.path("byte_bpe_multi_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
SIGNS = [*"abcdefghijklmnop  \n\t'sTHEreve€üßé漢字😀0123.,|$", "́", "\u0085", "\x1c", " ", "Σ", "İ", "the ", "tion", "<|endoftext|>", "<|startoftext|>", "don't "]


def random_texts(seed, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_tree_encoding_is_the_librarys(spark, make_docs, odd_texts):
    texts = odd_texts + random_texts(1)
    got = {r.doc_id: r for r in bpe_tree.encode_texts(make_docs(enumerate(texts)), tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN, ids=True).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = LIBRARY.encode_ordinary(t or "")
        assert list(got[i].ids) == want, t
        assert got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


@pytest.mark.parametrize("piece", [b"a" * 5000, b"ab" * 3000, b" " * 4097, bytes(range(256)) * 8, "überüber".encode() * 300])
def test_joining_any_halves_gives_the_whole(piece):
    encoder = bpe_tree.TreeEncoder(RANKS)
    whole = list(encoder._merge_long(piece))
    assert list(encoder._halves(piece)) == whole
    rng = random.Random(4)
    for cut in rng.sample(range(1, len(piece)), 5):
        assert list(encoder.join(encoder._merge_long(piece[:cut]), encoder._merge_long(piece[cut:]))) == whole
    assert encoder.decode(whole) == piece


def test_short_and_long_merging_agree():
    encoder, rng = bpe_tree.TreeEncoder(RANKS), random.Random(9)
    for _ in range(300):
        piece = "".join(rng.choice("etaoin shrdü") for _ in range(rng.randint(1, 60))).encode()
        assert encoder._merge(piece) == encoder._merge_long(piece)


def test_counts_are_the_librarys(spark, make_docs, odd_texts):
    path = tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = odd_texts + random_texts(2)
    got = {r.doc_id: r for r in bpe_count.count_tokens(make_docs(enumerate(texts)), path, limit=50).collect()}
    for i, t in enumerate(texts):
        want = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i].n_tokens == want, t
        assert got[i].n_bytes == len((t or "").encode()) and got[i].over_limit == (want > 50)


def test_empty_tables(make_docs):
    assert bpe_tree.encode_texts(make_docs([]), tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN).count() == 0
    assert bpe_count.count_tokens(make_docs([]), tokenizers.path("word_bpe_49k.json")).count() == 0


def test_only_short_words_are_remembered():
    from gridtide.llm.common import REMEMBERED, Remember

    asked = []
    words = Remember(lambda w: asked.append(w) or len(w), 3)
    for w in ("a", "a", "x" * REMEMBERED, "x" * (REMEMBERED + 1), "x" * (REMEMBERED + 1), "y" * 5_000_000):
        assert words[w] == len(w)
    assert asked.count("a") == 1 and asked.count("x" * (REMEMBERED + 1)) == 2
    assert all(len(w) <= REMEMBERED for w in [*words, *words.old])
    for i in range(20):
        words[str(i)]
    assert len(words) + len(words.old) <= 6
