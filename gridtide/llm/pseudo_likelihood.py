"""Operator 9: documents scored by masked pseudo-likelihood of a bidirectional window network.

The network predicts a word from the two words on either side of it: a table per place gives each neighbour's part of a
hidden layer, and a softmax over classes followed by one over the words of the class gives the word's probability. The
network's entries are the commonest words of the whole corpus, counted over all documents; rarer words share hashed entries,
and such a word's probability is its entry's times its share in the entry's count. The counts of all words are kept as a
table and joined, so the vocabulary grows with the corpus. A word that was never counted is taken as counted once. A
document's score is the sum of its words' conditional log-probabilities, each word being masked in turn.

Training reads all documents. Every task starts from the same weights, takes gradient steps on each word of each
of its documents, and gives its weights in pieces; the pieces are averaged by numbers of words up a tree of groups of
bounded size, so neither the driver nor a task ever holds more than `FAN` copies of a piece. The order of the steps
follows the input's partitions.

Null and empty texts, and those without words, have no words, a log-probability of 0 and a null mean. Repeated rows give
repeated results; only the two named columns are read. An empty table gives an untrained network and no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.llm.common import Bytes, map_steps, steps, stored
from gridtide.llm.suffix_search import word_bytes

CLASSES, OTHERS = 64, 512
SIZE = CLASSES * CLASSES
PLACES, HIDDEN, BATCH, RATE = (-2, -1, 1, 2), 32, 2048, 0.08
PIECES, FAN = 32, 32
# Words that are scored at once; rows to which small classes are filled up.
BLOCK, FEW = 4096, 32
_EACH, FAR = np.ones(CLASSES, np.float32), 60
SHAPES = {"near": (len(PLACES), SIZE + 1, HIDDEN), "shift": (HIDDEN,), "top": (HIDDEN + 1, CLASSES), "low": (CLASSES, HIDDEN + 1, CLASSES)}


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """(word, times): every word's hash with its count over all documents."""

    def do(rows):
        word, times = np.unique(Bytes(rows.column(text), word_bytes()).hash, return_counts=True)
        return {"word": word.view(np.int64), "times": times}

    counted = map_steps(docs.select(text), text, "word bigint, times bigint", lambda: do)
    return counted.groupBy("word").agg(F.sum("times").alias("times"))


def vocabulary(counts: DataFrame) -> np.ndarray:
    """Hashes of the commonest words, at most `SIZE - OTHERS`, the commonest first."""
    rows = counts.orderBy(F.desc("times"), "word").limit(SIZE - OTHERS).collect()
    return np.array([r["word"] for r in rows], np.int64).view(np.uint64)


class Numbers:
    """Word hashes to numbers: an entry of the vocabulary or one of the shared ones."""

    def __init__(self, words: np.ndarray) -> None:
        self.number = np.argsort(words, kind="stable")
        self.sorted = words[self.number]

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        other = SIZE - OTHERS + (hashes % np.uint64(OTHERS)).astype(np.int64)
        if not len(self.sorted):
            return other
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.number[at], other)


def windows(words: Bytes, numbers: Numbers) -> tuple[np.ndarray, np.ndarray]:
    """(word, neighbours): neighbours beyond a text's ends have the number `SIZE`."""
    word = numbers(words.hash)
    n, near = len(word), np.full((len(PLACES), len(word)), SIZE, np.int64)
    for k, d in enumerate(PLACES):
        a, b = max(0, -d), n - max(0, d)
        if b > a:
            same = words.row[a:b] == words.row[a + d : b + d]
            near[k, a:b] = np.where(same, word[a + d : b + d], SIZE)
    return word, near


class ByClass:
    """Products of rows, which are in order of their classes, class by class.

    Classes of at most `FEW` rows are filled up with zeros and multiplied as one stack of matrices, the others one by one.
    """

    def __init__(self, group: np.ndarray) -> None:
        edge = np.searchsorted(group, np.arange(CLASSES + 1))
        size = np.diff(edge)
        self.many = [(c, int(edge[c]), int(edge[c + 1])) for c in np.flatnonzero(size > FEW)]
        self.few = np.flatnonzero((size > 0) & (size <= FEW))
        self.rows = np.flatnonzero(size[group] <= FEW)
        classes = group[self.rows]
        self.at = np.searchsorted(self.few, classes) * FEW + self.rows - edge[classes]

    def _stack(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.few) * FEW, x.shape[1]), np.float32)
        out[self.at] = x[self.rows]
        return out.reshape(len(self.few), FEW, x.shape[1])

    def times(self, x: np.ndarray, matrices: np.ndarray) -> np.ndarray:
        """Each row times the matrix of its class."""
        out = np.empty((len(x), matrices.shape[2]), np.float32)
        for c, a, b in self.many:
            np.matmul(x[a:b], matrices[c], out=out[a:b])
        if len(self.few):
            out[self.rows] = np.matmul(self._stack(x), matrices[self.few]).reshape(-1, out.shape[1])[self.at]
        return out

    def crossed(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Sums over a class of the products of its rows of `x` and `y`, 0 for a class without rows."""
        out = np.zeros((CLASSES, x.shape[1], y.shape[1]), np.float32)
        for c, a, b in self.many:
            np.matmul(x[a:b].T, y[a:b], out=out[c])
        if len(self.few):
            out[self.few] = np.matmul(self._stack(x).transpose(0, 2, 1), self._stack(y))
        return out


@dataclass
class Network:
    near: np.ndarray
    shift: np.ndarray
    top: np.ndarray
    low: np.ndarray

    @classmethod
    def fresh(cls, seed: int = 17) -> Network:
        rng = np.random.default_rng(seed)
        made = {name: rng.normal(0, 0.1, shape).astype(np.float32) for name, shape in SHAPES.items()}
        made["shift"][:] = 0
        return cls(**made)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, name).ravel() for name in SHAPES])

    @classmethod
    def of(cls, flat: np.ndarray) -> Network:
        ends = np.cumsum([np.prod(s) for s in SHAPES.values()])[:-1]
        return cls(*(p.reshape(s).copy() for p, s in zip(np.split(flat.astype(np.float32), ends), SHAPES.values(), strict=True)))

    def hidden(self, near: np.ndarray) -> np.ndarray:
        out = np.ones((near.shape[1], HIDDEN + 1), np.float32)
        total = self.near[0].take(near[0], axis=0)
        for k in range(1, len(PLACES)):
            total += self.near[k].take(near[k], axis=0)
        total += self.shift
        np.tanh(total, out=out[:, :-1])
        return out

    def log_probabilities(self, word: np.ndarray, near: np.ndarray) -> np.ndarray:
        out = np.empty(len(word), np.float32)
        # Blocks whose arrays stay in a core's cache.
        for i in range(0, len(word), BLOCK):
            out[i : i + BLOCK] = self._log_probabilities(word[i : i + BLOCK], near[:, i : i + BLOCK])
        return out

    def _log_probabilities(self, word: np.ndarray, near: np.ndarray) -> np.ndarray:
        out = np.empty(len(word), np.float32)
        # Words in order of their classes: one product per class.
        order = np.argsort((word // CLASSES).astype(np.uint8), kind="stable")
        word, near = word[order], near[:, order]
        h, group = self.hidden(near), word // CLASSES
        got = _log_softmax(h @ self.top, group)
        got += _log_softmax(ByClass(group).times(h, self.low), word % CLASSES)
        out[order] = got
        return out


def _log_softmax(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the columns `at`; `logits` are used up."""
    _lowered(logits)
    found = logits[np.arange(len(at)), at]
    return found - np.log(np.exp(logits, out=logits) @ _EACH)


def _lowered(logits: np.ndarray) -> None:
    """Takes each row's largest off, unless the exponentials of all and their sums are well within range anyway."""
    if not -FAR < logits.min() <= logits.max() < FAR:
        logits -= logits.max(axis=1, keepdims=True)


class Trainer:
    """Adagrad steps on one network."""

    def __init__(self, network: Network) -> None:
        self.net = network
        self.square = {name: np.full(shape, 1e-3, np.float32) for name, shape in SHAPES.items()}

    def _climb(self, name: str, gradient: np.ndarray) -> None:
        square = self.square[name]
        square += gradient * gradient
        weight = getattr(self.net, name)
        weight += RATE * gradient / np.sqrt(square)

    def _climb_rows(self, k: int, rows: np.ndarray, gradient: np.ndarray) -> None:
        """Of some rows of a place's table."""
        square, weight = self.square["near"][k].take(rows, axis=0), self.net.near[k].take(rows, axis=0)
        square += gradient * gradient
        weight += RATE * gradient / np.sqrt(square)
        self.square["near"][k][rows], self.net.near[k][rows] = square, weight

    def step(self, word: np.ndarray, near: np.ndarray) -> None:
        net, n = self.net, len(word)
        order = np.argsort((word // CLASSES).astype(np.uint8), kind="stable")
        word, near = word[order], near[:, order]
        h = net.hidden(near)
        group, inner = word // CLASSES, word % CLASSES
        by_class = ByClass(group)
        g = _residual(h @ net.top, group, n)
        back = g @ net.top.T
        self._climb("top", h.T @ g)
        g = _residual(by_class.times(h, net.low), inner, n)
        back += by_class.times(g, net.low.transpose(0, 2, 1))
        self._climb("low", by_class.crossed(h, g))
        down = back[:, :-1] * (1 - h[:, :-1] ** 2)
        self._climb("shift", down.sum(0))
        # Two numbers of a row are added as the parts of one complex number.
        place, flat, wide = np.empty(SIZE + 1, np.int64), down.ravel().view(np.complex64), HIDDEN // 2
        for k in range(len(PLACES)):
            who = np.flatnonzero(np.bincount(near[k], minlength=SIZE + 1))
            place[who] = np.arange(0, len(who) * wide, wide)
            gradient = np.zeros(len(who) * wide, np.complex64)
            np.add.at(gradient, (place[near[k]][:, None] + np.arange(wide)).ravel(), flat)
            self._climb_rows(k, who, gradient.view(np.float32).reshape(-1, HIDDEN))


def _residual(logits: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """What the columns `at` lack of a probability of 1 and the others have above 0, over `n`; `logits` are used up."""
    _lowered(logits)
    p = np.exp(logits, out=logits)
    p *= (-1 / (n * (p @ _EACH)))[:, None]
    p[np.arange(len(at)), at] += np.float32(1 / n)
    return p


def fit(docs: DataFrame, text: str = "text", counts: DataFrame | None = None) -> tuple[np.ndarray, Network]:
    """(vocabulary, network) from all rows of `docs`; `counts` are their counted words, if at hand."""
    words = vocabulary(count_words(docs, text) if counts is None else counts)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        numbers, letters, trainer, seen = Numbers(shared.value), word_bytes(), Trainer(Network.fresh()), 0
        for batch in batches:
            for rows in steps(batch, text):
                word, near = windows(Bytes(rows.column(text), letters), numbers)
                masked = np.random.default_rng(seen).permutation(len(word))
                seen += len(word)
                for i in range(0, len(masked), BATCH):
                    trainer.step(word[masked[i : i + BATCH]], near[:, masked[i : i + BATCH]])
        if seen:
            parts = np.array_split(trainer.net.flat(), PIECES)
            task = TaskContext.get().partitionId()
            columns = [pa.array(np.full(PIECES, task), pa.int64()), pa.array(np.arange(PIECES), pa.int64()), pa.array(np.full(PIECES, float(seen)))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([p.tobytes() for p in parts], pa.binary())], names=["task", "piece", "seen", "weights"])

    schema = "task bigint, piece bigint, seen double, weights binary"
    pieces = stored(docs.select(text).mapInArrow(run, schema), "weights")

    def mean(table: pa.Table) -> pa.Table:
        seen = table.column("seen").to_numpy()
        total = sum(w * np.frombuffer(p, np.float32) for w, p in zip(seen, table.column("weights").to_pylist(), strict=True)) / seen.sum()
        first = {c: table.column(c)[:1] for c in ("task", "piece")}
        return pa.table(first | {"seen": [seen.sum()], "weights": [total.astype(np.float32).tobytes()]}, schema=table.schema)

    tasks = (pieces.agg(F.max("task")).first()[0] or 0) + 1
    while tasks > 1:
        grouped = pieces.withColumn("task", F.floor(F.col("task") / FAN)).groupBy("task", "piece")
        pieces = stored(grouped.applyInArrow(mean, schema), "weights")
        tasks = -(-tasks // FAN)
    rows = sorted(pieces.select("piece", "weights").collect())
    return words, Network.of(np.concatenate([np.frombuffer(r["weights"], np.float32) for r in rows])) if rows else Network.fresh()


def shares(asked: DataFrame, counts: DataFrame, words: np.ndarray) -> DataFrame:
    """(row, share): per row of `asked` (row, word), logs of its words' counts over those of their shared entries, added up."""
    known = counts.sparkSession.createDataFrame([(w,) for w in words.view(np.int64).tolist()], "known bigint")
    rare = counts.join(F.broadcast(known), F.col("word") == F.col("known"), "left_anti")
    total = rare.groupBy(_entry().alias("entry")).agg(F.sum("times").alias("total"))
    found = asked.join(rare, "word", "left").withColumn("entry", _entry()).join(F.broadcast(total), "entry", "left")
    share = F.log(F.coalesce("times", F.lit(1))) - F.log(F.coalesce("total", F.lit(1)))
    return found.groupBy("row").agg(F.sum(share).alias("share"))


def _entry() -> Column:
    """The shared entry of a word's hash; `OTHERS` divides 2^64, so the sign of a hash makes no difference."""
    return F.pmod(F.col("word"), F.lit(OTHERS))


def score(docs: DataFrame, words: np.ndarray, network: Network, key: str = "doc_id", text: str = "text", counts: DataFrame | None = None) -> DataFrame:
    """(key, n_words, log_prob, mean_log_prob) per row of `docs`.

    `counts` are the counted words that the network was fitted on; without them those of `docs` are taken.
    """
    shared = docs.sparkSession.sparkContext.broadcast((words, network))
    kind = docs.schema[key].dataType.simpleString()

    def work():
        words, network = shared.value
        numbers, letters, task, seen = Numbers(words), word_bytes(), TaskContext.get().partitionId() << 40, 0

        def do(rows):
            nonlocal seen
            found = Bytes(rows.column(text), letters)
            word, near = windows(found, numbers)
            got = np.zeros(len(word), np.float64)
            for i in range(0, len(word), 1 << 16):
                got[i : i + (1 << 16)] = network.log_probabilities(word[i : i + (1 << 16)], near[:, i : i + (1 << 16)])
            total = np.bincount(found.row, got, rows.num_rows)
            rare = word >= SIZE - OTHERS
            ends = np.searchsorted(found.row[rare], np.arange(rows.num_rows + 1)).astype(np.int32)
            row = task + seen + np.arange(rows.num_rows)
            seen += rows.num_rows
            return {"row": row, key: rows.column(key), "n_words": np.diff(found.first), "log_prob": total, "rare": pa.ListArray.from_arrays(ends, found.hash[rare].view(np.int64))}

        return do

    scored = map_steps(docs.select(key, text), text, f"row bigint, {key} {kind}, n_words bigint, log_prob double, rare array<bigint>", work)
    scored = stored(scored, "scored")
    counts = stored(count_words(docs, text), "counts") if counts is None else counts
    added = shares(scored.select("row", F.explode("rare").alias("word")), counts, words)
    log_prob = F.col("log_prob") + F.coalesce("share", F.lit(0.0))
    whole = scored.select("row", key, "n_words", "log_prob").join(added, "row", "left").select(key, "n_words", log_prob.alias("log_prob"))
    return whole.withColumn("mean_log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")))
