"""Operator 1: language of words in code-switched text by a linear-chain conditional random field.

Words are runs of letters. A word's emission sums learned weights of its bigrams, trigrams and four-grams with word
edges (so prefixes and suffixes of up to three letters are among them) and of the word itself (the lexicon); features
share hashed tables. Transitions are learned too. Marginals come from forward-backward over all words of a text, the
chain being cut into chunks whose transfer matrices are multiplied first, so that long texts cost no more per word.

Training takes at most about `PER_LANGUAGE` documents of each language, those of at most `TRAIN_CHARS` characters, and
mixes segments of different documents into sequences that switch language. Everything is fixed by seeds.

Per text: the language with the largest summed marginal (of equals, the first by name) and its share of the words.
A text that is null or has no letter is `und` with score 0. With no training rows every text is `und` with score 0.
Repeated rows give repeated results. Only the columns named are read, others may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.llm.common import Points, character_table, map_steps, mix, powers, texts_of

PER_LANGUAGE, TRAIN_CHARS = 300, 20_000
SEGMENT, SEQUENCE, EPOCHS, BATCH_WORDS, RATE = 40, 12, 5, 60_000, 0.25
CHUNK = 128
#: Bits of the hashed tables: bigrams, trigrams, four-grams, words.
BITS = (16, 17, 17, 17)
UNDETERMINED = "und"


def lower_table() -> np.ndarray:
    """Lower case of each code point whose lower case is a single one; non-letters become 0."""
    global _LOWER
    if _LOWER is None:
        table = np.arange(0x110000, dtype=np.uint32)
        letters = character_table("letter", str.isalpha)
        for i in np.flatnonzero(letters):
            low = chr(i).lower()
            table[i] = ord(low) if len(low) == 1 else i
        table[~letters] = 0
        _LOWER = table
    return _LOWER


_LOWER: np.ndarray | None = None


class Words:
    """The words of some texts, with the places of their features in the joint weight table."""

    def __init__(self, texts: list[str]) -> None:
        points = Points(texts)
        c = np.zeros(len(points.data) + 3, np.uint64)
        c[1:-2] = lower_table()[points.data]
        inside = c[1:-2] != 0
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
        self.start, self.stop = edge[::2], edge[1::2]
        self.row = points.rows(self.start)
        self.origin = points.start
        at = np.flatnonzero(inside) + 1
        a, b, d = c[at - 1], c[at], c[at + 1]
        e = np.where(d == 0, np.uint64(0), c[at + 2])
        size = self.stop - self.start
        self.begin = np.cumsum(size) - size
        two = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
        three = two + d * np.uint64(0x165667B19E3779F9)
        four = three + e * np.uint64(0x27D4EB2F165667C5) + np.uint64(1)
        self.grams = [_place(x, k) for k, x in enumerate((two, three, four))]
        if len(size):
            depth = np.arange(len(at)) - np.repeat(self.begin, size)
            word = np.add.reduceat(mix(b) * powers(int(size.max()))[depth], self.begin)
            self.grams.append(_place(word, 3))
        else:
            self.grams.append(np.zeros(0, np.int64))

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros((0, weights.shape[1]))
        total = weights[self.grams[0]] + weights[self.grams[1]] + weights[self.grams[2]]
        return (np.add.reduceat(total, self.begin, axis=0) + weights[self.grams[3]]).astype(np.float64)


_BASE = np.concatenate(([0], np.cumsum([1 << b for b in BITS])))


def _place(x: np.ndarray, kind: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - BITS[kind])).astype(np.int64) + _BASE[kind]


def forward_backward(emission: np.ndarray, reset: np.ndarray, move: np.ndarray, first: np.ndarray):
    """(alpha, beta, marginals) of chains laid end to end; `reset` marks the first word of each.

    `move` and `first` are exponentials of the weights; alpha and beta are scaled word by word.
    """
    n, k = emission.shape
    count = -(-n // CHUNK)
    e = np.ones((count * CHUNK, k))
    e[:n] = np.exp(np.maximum(emission - emission.max(axis=1, keepdims=True), -40.0))
    new = np.ones(count * CHUNK, bool)
    new[:n] = reset
    e, new = e.reshape(count, CHUNK, k), new.reshape(count, CHUNK)
    begin = np.broadcast_to(first, (k, k))
    product = np.broadcast_to(np.eye(k), (count, k, k))
    for t in range(CHUNK):
        step = np.where(new[:, t, None, None], begin, move) * e[:, t, None, :]
        product = product @ step
        product = product / product.sum(axis=(1, 2), keepdims=True)
    left, right = np.full((count, k), 1.0 / k), np.full((count, k), 1.0 / k)
    for i in range(1, count):
        a = left[i - 1] @ product[i - 1]
        left[i] = a / a.sum()
    for i in range(count - 2, -1, -1):
        b = product[i + 1] @ right[i + 1]
        right[i] = b / b.sum()
    alpha, beta = np.empty_like(e), np.empty_like(e)
    a = left
    for t in range(CHUNK):
        a = np.where(new[:, t, None], first, a @ move) * e[:, t]
        a /= a.sum(axis=1, keepdims=True)
        alpha[:, t] = a
    b = right
    for t in range(CHUNK - 1, -1, -1):
        beta[:, t] = b
        ahead = e[:, t] * b
        b = np.where(new[:, t, None], (ahead @ first)[:, None], ahead @ move.T)
        b = b / b.sum(axis=1, keepdims=True)
    alpha, beta = alpha.reshape(-1, k)[:n], beta.reshape(-1, k)[:n]
    both = alpha * beta
    return alpha, beta, both / both.sum(axis=1, keepdims=True)


@dataclass
class Model:
    """Learned weights; their size is fixed by `BITS` and the number of languages."""

    languages: list[str]
    weights: np.ndarray
    move: np.ndarray
    first: np.ndarray

    def marginals(self, words: Words) -> np.ndarray:
        if not len(words.start):
            return np.zeros((0, len(self.languages)))
        reset = np.diff(words.row, prepend=-1) != 0
        return forward_backward(words.emissions(self.weights), reset, np.exp(self.move), np.exp(self.first))[2]

    def labels(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and share per text."""
        names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        words = Words(texts)
        if not self.languages or not len(words.start):
            return names, scores
        p = self.marginals(words)
        sums = np.stack([np.bincount(words.row, p[:, j], len(texts)) for j in range(p.shape[1])], axis=1)
        total = np.bincount(words.row, minlength=len(texts))
        best = sums.argmax(axis=1)
        for i in np.flatnonzero(total):
            names[i], scores[i] = self.languages[best[i]], min(1.0, sums[i, best[i]] / total[i])
        return names, scores

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Runs of words of one language per text: first character, character behind the last, language."""
        words, out = Words(texts), [[] for _ in texts]
        if not self.languages or not len(words.start):
            return out
        best = self.marginals(words).argmax(axis=1)
        cut = np.flatnonzero((np.diff(words.row, prepend=-1) != 0) | (np.diff(best, prepend=-1) != 0))
        for i, j in zip(cut, np.append(cut[1:], len(best)), strict=True):
            row = words.row[i]
            out[row].append((int(words.start[i] - words.origin[row]), int(words.stop[j - 1] - words.origin[row]), self.languages[best[i]]))
        return out


def train(texts: list[str], labels: list[str], seed: int = 11) -> Model:
    """Maximum likelihood by Adagrad over sequences that mix segments of the training texts."""
    languages = sorted(set(labels))
    k = len(languages)
    weights = np.zeros((int(_BASE[-1]), k), np.float32)
    move, first = np.zeros((k, k)), np.zeros(k)
    rng = np.random.default_rng(seed)
    pieces, tags = [], []
    for text, label in zip(texts, labels, strict=True):
        words = text.split()
        for i in range(0, len(words), SEGMENT):
            pieces.append(" ".join(words[i : i + SEGMENT]))
            tags.append(languages.index(label))
    squares, square_move, square_first = np.full_like(weights, 1e-2), np.full((k, k), 1.0), np.full(k, 1.0)
    if k < 2 or not pieces:
        return Model(languages, weights, move, first)
    per_batch = max(1, BATCH_WORDS // SEGMENT)
    for _ in range(EPOCHS):
        order = rng.permutation(len(pieces))
        for i in range(0, len(order), per_batch):
            chosen = order[i : i + per_batch]
            words = Words([pieces[j] for j in chosen])
            if not len(words.start):
                continue
            truth = np.array([tags[j] for j in chosen])[words.row]
            reset = np.diff(words.row // SEQUENCE, prepend=-1) != 0
            alpha, beta, p = forward_backward(words.emissions(weights), reset, np.exp(move), np.exp(first))
            gradient = -p
            gradient[np.arange(len(p)), truth] += 1.0
            for places, g in ((x, np.repeat(gradient, words.stop - words.start, axis=0)) for x in words.grams[:3]):
                _climb(weights, squares, places, g)
            _climb(weights, squares, words.grams[3], gradient)
            inner = np.flatnonzero(~reset)
            # The pair's marginal is alpha(a) move(a, b) r(b); r(b) makes its sum over a the word's own marginal.
            reached = alpha[inner - 1] @ np.exp(move)
            share = alpha[inner - 1].T @ (p[inner] / reached) * np.exp(move)
            seen = np.bincount(truth[inner - 1] * k + truth[inner], minlength=k * k).reshape(k, k)
            g = (seen - share) / SEGMENT
            square_move += g * g
            move += 1.0 * g / np.sqrt(square_move)
            starts = np.flatnonzero(reset)
            g = np.bincount(truth[starts], minlength=k) - p[starts].sum(axis=0)
            square_first += g * g
            first += 0.1 * g / np.sqrt(square_first)
    return Model(languages, weights, move, first)


def _climb(weights: np.ndarray, squares: np.ndarray, places: np.ndarray, gradient: np.ndarray) -> None:
    used, index = np.unique(places, return_inverse=True)
    for j in range(weights.shape[1]):
        g = np.bincount(index, gradient[:, j], len(used))
        squares[used, j] += g * g
        weights[used, j] += RATE * g / np.sqrt(squares[used, j])


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Train on a bounded, stratified sample of the labelled rows of `docs`."""
    rows = docs.select(key, text, lang).where(f"{lang} is not null and {text} is not null and length({text}) <= {TRAIN_CHARS}")
    counts = {r[lang]: r["count"] for r in rows.groupBy(lang).count().collect()}
    if not counts:
        return Model([], np.zeros((int(_BASE[-1]), 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    share = F.create_map(*[x for name, n in counts.items() for x in (F.lit(name), F.lit(min(1_000_000, int(1_000_000 * PER_LANGUAGE / n) + 1)))])
    part = F.pmod(F.xxhash64(F.lit("language"), key), F.lit(1_000_000))
    sample = rows.where(part < share[F.col(lang)]).select(key, text, lang).toPandas().sort_values([key, text])
    return train(sample[text].tolist(), sample[lang].tolist())


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", spans: bool = False) -> DataFrame:
    """(key, lang_pred, score) per row, and the array `spans` of (start, stop, lang) if asked for."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, lang_pred string, score double" + ", spans array<struct<start: int, stop: int, lang: string>>" * spans

    def work():
        model = shared.value

        def do(rows):
            texts = texts_of(rows.column(text))
            names, scores = model.labels(texts)
            out = {key: rows.column(key), "lang_pred": names, "score": scores}
            if spans:
                out["spans"] = [[{"start": a, "stop": b, "lang": c} for a, b, c in row] for row in model.spans(texts)]
            return out

        return do

    return map_steps(docs.select(key, text), text, schema, work)
