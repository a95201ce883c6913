"""Operator 4: text quality by a generalised additive model with pairwise interactions.

Measures of the whole text (lengths, shares of kinds of signs, repetition of words, lines and phrases) are cut into bins
at quantiles of the training rows. Boosting goes round the features again and again: each turn fits a shallow tree to the
current residuals of one feature and adds it, shrunk, to that feature's table of one value per bin. The pairs of features
whose grids explain most of what is left get tables of their own in the same way. A score is the logistic of the
intercept plus one table entry per feature and pair: array additions only.

At most about `TRAIN_ROWS` labelled documents are trained on; only their measures reach the driver. All texts are
measured whole. A text that is null counts as empty; empty texts have a score like any other. Repeated rows give repeated
results; only the columns named are read. Without labelled rows every score is 0.5, with one kind of label near to it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.llm.common import Points, bounded, character_table, map_steps, mix, one_label, powers, texts_of

TRAIN_ROWS = 20_000
BINS, PAIR_BINS, PAIRS, TURNS, PAIR_TURNS, RATE = 32, 8, 8, 120, 40, 0.15
MEASURES = (
    "log_chars", "log_words", "word_length", "letters", "upper", "digits", "blanks", "stops", "symbols", "symbol_ends",
    "lone_symbols", "upper_words", "log_lines", "line_words", "line_copies", "word_copies", "phrase_copies", "top_word",
    "closed_lines", "long_words",
)


def measures(texts: list[str]) -> np.ndarray:
    """One row of `MEASURES` per text."""
    p = Points(texts)
    n, data = len(texts), p.data
    letter, upper = character_table("letter", str.isalpha), character_table("upper", str.isupper)
    digit, blank = character_table("digit", str.isdigit), character_table("blank", str.isspace)
    stop = np.zeros(0x110000, bool)
    stop[[ord(c) for c in ".,;:!?'\"()-"]] = True
    kinds = {"letter": letter[data], "upper": upper[data], "digit": digit[data], "blank": blank[data], "stop": stop[data]}
    kinds["symbol"] = ~(kinds["letter"] | kinds["digit"] | kinds["blank"] | kinds["stop"])

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags)))
        return (sums[p.stop - 1] - sums[p.start]).astype(float)  # without the line feed behind the text

    chars = (p.size - 1).astype(float)
    some = np.maximum(chars, 1)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], ~kinds["blank"], [False])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    row, size = p.rows(start), edge[1::2] - edge[::2]

    def per_word(flags: np.ndarray) -> np.ndarray:
        return np.bincount(row, flags, n)

    words = np.bincount(row, minlength=n).astype(float)
    many = np.maximum(words, 1)
    code = _hashes(data, start, end)
    line_start, line_end = _lines(data)
    line_row = p.rows(line_start)
    lines = np.bincount(line_row, minlength=n).astype(float)
    lines_some = np.maximum(lines, 1)
    line_code = _hashes(data, line_start, line_end)
    phrase = np.flatnonzero(row[2:] == row[:-2]) if len(row) > 2 else np.zeros(0, np.int64)
    phrase_code = mix(code[phrase]) + mix(code[phrase + 1] + np.uint64(1)) * np.uint64(3) + code[phrase + 2]
    phrases = np.maximum(np.bincount(row[phrase], minlength=n), 1) if len(phrase) else np.ones(n)
    word_kinds, top = _distinct(row, code, n)
    closing = np.zeros(0x110000, bool)
    closing[[ord(c) for c in ".!?:;"]] = True
    symbol_words = (kinds["symbol"][end - 1] if len(end) else np.zeros(0, bool)) & (size > 1)
    columns = (
        np.log1p(chars), np.log1p(words), per_word(size) / many, per_text(kinds["letter"]) / some,
        per_text(kinds["upper"]) / np.maximum(per_text(kinds["letter"]), 1), per_text(kinds["digit"]) / some,
        per_text(kinds["blank"]) / some, per_text(kinds["stop"]) / some, per_text(kinds["symbol"]) / some,
        per_word(symbol_words) / many,
        per_word(kinds["symbol"][start] & (size == 1)) / many if len(start) else np.zeros(n),
        per_word(kinds["upper"][start] & kinds["upper"][np.minimum(start + 1, len(data) - 1)] & (size > 1)) / many if len(start) else np.zeros(n),
        np.log1p(lines), words / lines_some, 1 - _distinct(line_row, line_code, n)[0] / lines_some, 1 - word_kinds / many,
        1 - _distinct(row[phrase], phrase_code, n)[0] / phrases, top / many,
        np.bincount(line_row, closing[data[line_end - 1]] if len(line_end) else None, n) / lines_some,
        per_word(size > 20) / many,
    )
    return np.column_stack(columns)


def _lines(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the lines that have a sign; each text ends with a line feed."""
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    filled = ends > starts
    return starts[filled], ends[filled]


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    depth = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    value = data[np.repeat(start, size) + depth].astype(np.uint64) + np.uint64(1)
    return mix(np.add.reduceat(value * powers(int(size.max()))[depth], np.cumsum(size) - size))


def _distinct(row: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: how many different codes, and how often the commonest occurs."""
    if not len(row):
        return np.zeros(n), np.zeros(n)
    joint = np.sort((mix(code) & np.uint64((1 << 40) - 1)) | (row.astype(np.uint64) << np.uint64(40)))
    first = np.flatnonzero(np.concatenate(([True], joint[1:] != joint[:-1])))
    owner = (joint[first] >> np.uint64(40)).astype(np.int64)
    times = np.diff(np.append(first, len(joint)))
    top = np.zeros(n)
    np.maximum.at(top, owner, times)
    return np.bincount(owner, minlength=n).astype(float), top


@dataclass
class Model:
    """Lookup tables; their size is fixed by the number of measures, bins and pairs."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, j], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            i, j = (np.searchsorted(self.pair_edges[c], x[:, c], side="right") for c in (a, b))
            total += table[i, j]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logit(x), -60, 60)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values of a shallow tree over ordered bins with gradient sums `g` and weights `h`."""
    out = np.full(len(g), g.sum() / (h.sum() + 1.0))
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = left_g**2 / (left_h + 1.0) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + 1.0)
        gain[(left_h < 1.0) | (h.sum() - left_h < 1.0)] = -1.0
        cut = int(gain.argmax())
        if gain[cut] > g.sum() ** 2 / (h.sum() + 1.0) + 1e-9:
            out[: cut + 1], out[cut + 1 :] = _tree(g[: cut + 1], h[: cut + 1], depth - 1), _tree(g[cut + 1 :], h[cut + 1 :], depth - 1)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree over a grid of two features: the better first cut, then a tree of depth one on the other side."""
    best, gain = None, -1.0
    for axis in (0, 1):
        a, b = (g, h) if axis == 0 else (g.T, h.T)
        for cut in range(1, a.shape[0]):
            parts = [(a[:cut].sum(0), b[:cut].sum(0)), (a[cut:].sum(0), b[cut:].sum(0))]
            fits = [_tree(u, v, 1) for u, v in parts]
            own = sum((f * u).sum() - 0.5 * (f * f * v).sum() for f, (u, v) in zip(fits, parts, strict=True))
            if own > gain:
                table = np.vstack((np.repeat(fits[0][None], cut, 0), np.repeat(fits[1][None], a.shape[0] - cut, 0)))
                best, gain = (table if axis == 0 else table.T), own
    return best if best is not None else np.zeros_like(g)


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of the tables; balanced by nothing, so scores keep the labels' rate."""
    if not len(y):
        return Model()
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Model(float(np.log(rate / (1 - rate))))
    model.edges = [_cuts(x[:, j], BINS) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    logit = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-np.clip(logit, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(TURNS):
        for j, b in enumerate(bins):
            g, h = slopes()
            size = len(model.tables[j])
            step = np.clip(RATE * _tree(np.bincount(b, g, size), np.bincount(b, h, size)), -1, 1)
            model.tables[j] += step
            logit += step[b]
    model.pair_edges = [_cuts(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.pair_edges)]
    sides = [len(e) + 1 for e in model.pair_edges]
    g, h = slopes()

    def left_over(pair: tuple[int, int]) -> float:
        a, b = pair
        cell, size = coarse[a] * sides[b] + coarse[b], sides[a] * sides[b]
        return float((np.bincount(cell, g, size) ** 2 / (np.bincount(cell, h, size) + 1.0)).sum())

    model.pairs = sorted(combinations(range(x.shape[1]), 2), key=lambda p: (-left_over(p), p))[:PAIRS]
    model.pair_tables = [np.zeros((sides[a], sides[b])) for a, b in model.pairs]
    for _ in range(PAIR_TURNS):
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            g, h = slopes()
            cell, shape = coarse[a] * sides[b] + coarse[b], table.shape
            sums = [np.bincount(cell, v, table.size).reshape(shape) for v in (g, h)]
            step = np.clip(RATE * _grid_tree(*sums), -1, 1)
            table += step
            logit += step[coarse[a], coarse[b]]
    return model


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on a bounded sample of `labels` (doc_id, quality) and the measures of their texts in `docs`."""
    chosen = bounded(one_label(labels, "quality"), "doc_id", TRAIN_ROWS)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most about TRAIN_ROWS labels
    rows = _measured(texts, ("doc_id", "label")).toPandas()
    x = np.array(rows["measures"].tolist(), float).reshape(len(rows), len(MEASURES))
    order = np.lexsort((*x.T, rows["doc_id"].to_numpy()))
    return train(x[order], rows["label"].to_numpy(float)[order])


def _measured(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def do(rows):
        return {c: rows.column(c) for c in keep} | {"measures": list(measures(texts_of(rows.column("text"))))}

    return map_steps(docs.select(*dict.fromkeys((*keep, "text"))), "text", f"{kinds}, measures array<double>", lambda: do)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep` and (score, predicted) per row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def work():
        model = shared.value

        def do(rows):
            p = model.score(measures(texts_of(rows.column("text"))))
            return {c: rows.column(c) for c in keep} | {"score": p, "predicted": (p >= threshold).astype(np.int32)}

        return do

    wanted = docs.select(*dict.fromkeys((*keep, "text")))
    return map_steps(wanted, "text", f"{kinds}, score double, predicted int", work)
