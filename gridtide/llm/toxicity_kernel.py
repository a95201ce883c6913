"""Operator 10: toxicity by a support vector machine over a subsequence string kernel with Nyström landmarks.

The kernel compares two tokens, each with a blank at both ends, by their common subsequences of three and of four signs
within five, each gap weighing `DECAY`: inserted signs and gaps cost little. It is divided by both tokens' sizes. Landmarks are witness tokens of toxic
sentences and tokens of clean ones; kernel values to them, whitened by the landmarks' own kernel matrix, are the
machine's features. A sentence, and so a text, is as toxic as its worst token: training (squared hinge) picks that
token of every toxic document anew in each round and adds the clean tokens that come closest. Both kinds of tokens also
take part with signs inserted between their letters, so that disguise alone tells nothing. A logistic curve over all
training documents, a quarter of them held back until then, turns the worst score into a probability.

Because each kernel value is linear in the token's subsequences, the sum over landmarks folds into one table of weights
per subsequence, which is exact and needs ten table entries per sign instead of a kernel per landmark.

At most about `TOXIC_DOCS` and `CLEAN_DOCS` labelled documents of at most `TRAIN_CHARS` characters are trained on; all
texts are scored whole. A text that is null or empty scores as one without any token. Repeated rows give repeated results;
only the columns named are read. Without labelled documents of both kinds every score is 0.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.llm.common import Points, bounded, character_table, map_steps, one_label, texts_of
from gridtide.llm.language_crf import lower_table

TOXIC_DOCS, CLEAN_DOCS, TRAIN_CHARS = 1500, 4000, 20_000
LANDMARKS, ROUNDS, NEGATIVES, PENALTY = 360, 3, 4_000, 1e-6
DISGUISES = (".", "-", "*")
DECAY, WINDOW, ALPHABET = 0.7, 5, 96
#: Places of a subsequence's later signs, counted from its first.
SHAPES = [s for k in (2, 3) for s in combinations(range(1, WINDOW), k)]
FILTER = 1 << 20
STEP_DOCS, STEP_WORDS = 100, 20_000
#: Signs that stand for letters in disguised words.
LOOK_ALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "@": "a"}


def fold_table() -> np.ndarray:
    """Each code point's lower case, or the letter that it stands for in disguised words."""
    global _FOLD
    if _FOLD is None:
        low = lower_table()
        table = np.where(low == 0, np.arange(0x110000, dtype=np.uint32), low)
        for sign, letter in LOOK_ALIKES.items():
            table[ord(sign)] = ord(letter)
        _FOLD = table
    return _FOLD


_FOLD: np.ndarray | None = None


class Tokens:
    """Tokens between white space in folded texts.

    Single signs in a row, one blank apart, make one token; of a sign repeated more than twice two are kept.
    """

    def __init__(self, texts: list[str]) -> None:
        points = Points(texts)
        blank = character_table("blank", str.isspace)
        data = fold_table()[points.data]
        inside = ~blank[data]
        start, stop = _runs(inside)
        row = points.rows(start)
        if len(start):
            single = stop - start == 1
            joined = single[:-1] & single[1:] & (start[1:] - stop[:-1] == 1) & (row[1:] == row[:-1])
            row = row[np.concatenate(([True], ~joined))]
            if joined.any():
                keep = np.ones(len(data), bool)
                keep[stop[:-1][joined]] = False
                data, inside = data[keep], inside[keep]
        keep = np.ones(len(data), bool)
        keep[2:] = ~(inside[2:] & (data[2:] == data[1:-1]) & (data[2:] == data[:-2]))
        self.data = np.concatenate(([np.uint32(10)], data[keep]))  # so that a blank stands before the first token too
        self.start, self.stop = _runs(~blank[self.data])
        self.row = row

    def strings(self) -> list[str]:
        whole = self.data.tobytes().decode("utf-32-le", "surrogatepass")
        return [whole[a:b] for a, b in zip(self.start.tolist(), self.stop.tolist(), strict=True)]


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


def size_of(n: np.ndarray) -> np.ndarray:
    """The divisor of the kernel for tokens of n signs; any function of the token keeps the kernel positive."""
    return np.sqrt(sum(np.maximum(n + 2 - s[-1], 0) * DECAY ** (2 * (s[-1] - len(s))) for s in SHAPES)) + 1e-9


class Known:
    """The subsequences that landmarks have, numbered from 0: `find` gives a code's number or -1.

    Codes of three signs index a table; those of four pass a filter of hashed bits and are then searched for.
    """

    def __init__(self, codes: np.ndarray, radix: int) -> None:
        self.radix, self.codes = radix, np.unique(codes)
        self.fours = int(np.searchsorted(self.codes, radix**3))
        self.table = np.full(radix**3, -1, np.int32)
        self.table[self.codes[: self.fours]] = np.arange(self.fours)
        self.filter = np.zeros(FILTER, bool)
        self.filter[self._bit(self.codes[self.fours :])] = True

    @staticmethod
    def _bit(code: np.ndarray) -> np.ndarray:
        return (code * 0x9E3779B1 >> 9) & (FILTER - 1)

    def find(self, code: np.ndarray, of_four: bool) -> np.ndarray:
        if not of_four:
            return self.table[code]
        out = np.full(len(code), -1, np.int32)
        at = np.flatnonzero(self.filter[self._bit(code)])
        place = np.minimum(np.searchsorted(self.codes, code[at]), len(self.codes) - 1)
        out[at] = np.where(self.codes[place] == code[at], place, -1)
        return out


@dataclass
class Model:
    """`points` are the code points of the landmarks' alphabet, `weight` has a value per known subsequence."""

    points: np.ndarray
    known: Known | None
    weight: np.ndarray
    bias: float
    slope: float
    offset: float

    @property
    def table(self) -> np.ndarray:
        """From code points to the alphabet; 0 stands for all others, all white space is one sign."""
        sign = np.zeros(0x110000, np.int32)
        sign[self.points] = np.arange(1, len(self.points) + 1)
        sign[character_table("blank", str.isspace)] = sign[32]
        return sign

    def tokens(self, t: Tokens, sign: np.ndarray) -> np.ndarray:
        """The machine's value for each token; one of less than three signs has the bias alone."""
        size = t.stop - t.start
        return fold_sums(t, sign, self.known, self.weight) / size_of(size) * (size > 2) + self.bias

    def words(self, words: list[str], sign: np.ndarray) -> np.ndarray:
        """The value of each word; words hold no blank and more than one sign."""
        blocks = [Tokens(["\n".join(words[i : i + STEP_WORDS])]) for i in range(0, len(words), STEP_WORDS)]
        return np.concatenate([self.tokens(t, sign) for t in blocks]) if blocks else np.zeros(0)

    def texts(self, texts: list[str], sign: np.ndarray) -> np.ndarray:
        """The largest value of each text's tokens; the bias alone for a text without tokens."""
        t = Tokens(texts)
        worst = np.full(len(texts), self.bias)
        if len(t.start):
            first = np.flatnonzero(np.diff(t.row, prepend=-1))
            worst[t.row[first]] = np.maximum.reduceat(self.tokens(t, sign), first)
        return worst

    def probability(self, worst: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(np.clip(-(self.slope * worst + self.offset), -60, 60)))


def subsequences(t: Tokens, sign: np.ndarray, known: Known | None, radix: int):
    """For each shape: places whose subsequence lies within a token, its number (or code, without `known`), its weight.

    A subsequence belongs to the place of its first sign, which is the blank before a token or one of its signs.
    """
    s = np.concatenate((sign[t.data].astype(np.int64), np.zeros(WINDOW, np.int64)))
    n, size = len(t.data), t.stop - t.start + 1
    left = np.zeros(n, np.int32)  # places from here to the blank behind the token
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    left[np.repeat(t.start - 1, size) + at] = np.repeat(size, size) - at
    for shape in SHAPES:
        code, some = s[:n], s[:n] > 0
        for k in shape:
            code = code * radix + s[k : n + k]
            some = some & (s[k : n + k] > 0)
        some &= left >= shape[-1]
        code = code + radix**3 * (len(shape) > 2)
        number = known.find(code, len(shape) > 2) if known else code
        places = np.flatnonzero(some & (number >= 0))
        yield places, number[places], DECAY ** (shape[-1] - len(shape))


def fold_sums(t: Tokens, sign: np.ndarray, known: Known, weight: np.ndarray) -> np.ndarray:
    """Per token, the gap-weighted sum of its subsequences' weights."""
    if not len(t.start):
        return np.zeros(0)
    total = np.zeros(len(t.data))
    for places, number, decay in subsequences(t, sign, known, known.radix):
        total[places] += weight[number] * decay
    # A token's places are its signs and the blank before it; the blank behind it is the next one's.
    return np.add.reduceat(total, np.stack((t.start - 1, t.stop), 1).ravel())[::2]


def kernel_rows(words: list[str], sign: np.ndarray, known: Known, basis: np.ndarray) -> np.ndarray:
    """Kernel values of words (without blanks) to the landmarks, whose subsequences, normalised, are the rows of `basis`."""
    out = np.zeros((len(words), len(basis)), np.float32)
    turned = np.ascontiguousarray(basis.T, np.float32)
    for i in range(0, len(words), 2000):
        t = Tokens([w + "\n" for w in words[i : i + 2000]])
        for places, number, decay in subsequences(t, sign, known, known.radix):
            if len(places):
                who = np.searchsorted(t.stop, places, side="right")
                first = np.flatnonzero(np.diff(who, prepend=-1))
                out[i + who[first]] += decay * np.add.reduceat(turned[number], first, axis=0)
        out[i : i + 2000] /= size_of(t.stop - t.start)[:, None]
    return out


def train(texts: list[str], labels: list[int], seed: int = 5) -> Model | None:
    """Fit the machine on three quarters of the documents and its curve on all, each kind taking part in both."""
    labels = np.asarray(labels)
    if not len(labels) or labels.min() == labels.max():
        return None
    rng = np.random.default_rng(seed)
    fitting = np.ones(len(labels), bool)
    for kind in (0, 1):
        fitting[np.flatnonzero(labels == kind)[3::4]] = False
    # A document's tokens are those of its sentences; a clean document's sentences are all clean.
    bags: dict[int, list[str]] = {}
    clean_count: Counter = Counter()
    chosen = np.flatnonzero(fitting)
    for i in range(0, len(chosen), STEP_DOCS):
        part = chosen[i : i + STEP_DOCS]
        t = Tokens([texts[j] for j in part])
        words, edge = t.strings(), np.searchsorted(t.row, np.arange(len(part) + 1))
        for j, a, b in zip(part.tolist(), edge, edge[1:], strict=False):
            bag = {w for w in words[a:b] if len(w) > 2}
            if not labels[j]:
                clean_count.update(bag)
            elif bag:
                bags[j] = sorted(bag)
    toxic = list(bags)
    toxic_count: Counter = Counter(w for i in toxic for w in bags[i])
    n_toxic, n_clean = max(1, len(toxic)), max(1, int((fitting & (labels == 0)).sum()))

    def odds(w: str) -> float:
        gain = np.log((toxic_count[w] + 0.1) / (n_toxic + 1)) - np.log((clean_count[w] + 0.5) / (n_clean + 1))
        return gain * np.log1p(toxic_count[w])

    witness = [max(bags[i], key=odds) for i in toxic]
    clean = sorted(clean_count, key=lambda w: (-clean_count[w], w))
    half = NEGATIVES // 2
    rest = clean[half:]
    negative = clean[:half] + ([rest[j] for j in np.sort(rng.choice(len(rest), min(half, len(rest)), replace=False))] if rest else [])
    known, closest = set(negative), []
    for _ in range(ROUNDS):
        model = _machine(sorted(set(witness)), negative, closest, Counter(witness), rng)
        sign = model.table
        witness = [bags[i][int(model.words(bags[i], sign).argmax())] for i in toxic]
        values = model.words(clean, sign)
        close = [clean[j] for j in np.argsort(-values, kind="stable")[:NEGATIVES] if values[j] > -1.0 and clean[j] not in known]
        closest += [clean[j] for j in np.argsort(-values, kind="stable")[: LANDMARKS // 8]]
        known.update(close)
        negative += close
    model = _machine(sorted(set(witness)), negative, closest, Counter(witness), rng)
    sign = model.table
    worst = [model.texts(texts[i : i + STEP_DOCS], sign) for i in range(0, len(texts), STEP_DOCS)]
    model.slope, model.offset = _curve(np.concatenate(worst), labels)
    return model


def _disguised(words: list[str], rng) -> list[str]:
    return [DISGUISES[k].join(w) for w, k in zip(words, rng.integers(0, len(DISGUISES), len(words)), strict=True)]


def _machine(positive: list[str], negative: list[str], closest: list[str], weight_of: Counter, rng) -> Model:
    hidden = _disguised(positive, rng), _disguised([w for w in negative[:: max(1, len(negative) // 2000)] if len(w) < 16], rng)
    letters = Counter(c for w in positive + negative for c in w)
    points = sorted({" ", *(c for c, _ in letters.most_common(ALPHABET - 2) if not c.isspace())})
    radix = len(points) + 1
    common = [w for w, _ in weight_of.most_common(LANDMARKS // 2)]
    others = list(closest)
    others += [negative[j] for j in np.sort(rng.choice(len(negative), min(LANDMARKS // 8, len(negative)), replace=False))] if negative else []
    marks = list(dict.fromkeys(common + _disguised(common[: LANDMARKS // 16], rng) + others))
    model = Model(np.array([ord(c) for c in points]), None, np.zeros(0), 0.0, 1.0, 0.0)
    sign = model.table
    t = Tokens([w + "\n" for w in marks])
    found = list(subsequences(t, sign, None, radix))
    known = Known(np.concatenate([code for _, code, _ in found]), radix)
    basis = np.zeros((len(marks), len(known.codes)))
    for places, code, decay in found:
        np.add.at(basis, (np.searchsorted(t.stop, places, side="right"), np.searchsorted(known.codes, code)), decay)
    basis /= size_of(t.stop - t.start)[:, None]
    value, vector = np.linalg.eigh(basis @ basis.T)
    whiten = vector / np.sqrt(np.maximum(value, 1e-4))

    words = positive + hidden[0] + negative + hidden[1]
    target = np.repeat([1.0, 1.0, -1.0, -1.0], [len(positive), len(positive), len(negative), len(hidden[1])])
    often = np.sqrt([weight_of[w] for w in positive])
    share = np.concatenate((often, 0.1 * often, np.ones(len(negative)), np.full(len(hidden[1]), 0.5)))
    for kind in (target > 0, target < 0):
        share[kind] *= 0.5 / max(1e-9, share[kind].sum())
    beta, bias = _squared_hinge(kernel_rows(words, sign, known, basis) @ whiten, target, share)
    model.known, model.weight, model.bias = known, basis.T @ (whiten @ beta), float(bias)
    return model


def _squared_hinge(x: np.ndarray, y: np.ndarray, share: np.ndarray, turns: int = 12) -> tuple[np.ndarray, float]:
    """Newton's method on the squared hinge loss, whose active set settles after a few turns."""
    z = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(z.shape[1])
    ridge = PENALTY * np.eye(z.shape[1])
    ridge[-1, -1] = 1e-9
    before = None
    for _ in range(turns):
        active = y * (z @ w) < 1.0
        if before is not None and (active == before).all():
            break
        before = active
        a = z[active] * share[active, None]
        w = np.linalg.solve(z[active].T @ a + ridge, a.T @ y[active])
    return w[:-1], w[-1]


def _curve(worst: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve.

    It has its middle in the widest gap among the cuts with nearly the fewest errors, each kind counting as a whole, and
    0.95 at that gap's upper edge. A few wrong labels don't flatten it, as a likelihood would.
    """
    order = np.argsort(worst, kind="stable")
    value, toxic = worst[order], labels[order] == 1
    missed, flagged = np.cumsum(toxic) / toxic.sum(), 1 - np.cumsum(~toxic) / (~toxic).sum()
    errors = (missed + flagged)[:-1]
    gap = np.where(errors <= errors.min() + 0.002, np.diff(value), -1.0)
    at = int(gap.argmax())
    slope = np.log(19) / max((value[at + 1] - value[at]) / 2, 0.05)
    return float(slope), float(-slope * (value[at] + value[at + 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Train on a bounded sample of `labels` (doc_id, toxic) and the texts of `docs` (doc_id, text)."""
    known = one_label(labels, "toxic")
    chosen = bounded(known.where("label = 1"), "doc_id", TOXIC_DOCS).unionByName(bounded(known.where("label = 0"), "doc_id", CLEAN_DOCS))
    texts = docs.select("doc_id", "text").where(f"text is not null and length(text) <= {TRAIN_CHARS}")
    rows = texts.join(F.broadcast(chosen), "doc_id").toPandas().sort_values(["doc_id", "text"])  # at most about 5,500 labels
    return train(rows["text"].tolist(), rows["label"].tolist())


def score(docs: DataFrame, model: Model | None, threshold: float = 0.7, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep` and (score, predicted) per row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def work():
        model = shared.value
        sign = model.table if model else None

        def do(rows):
            if model is None:
                p = np.zeros(rows.num_rows)
            else:
                p = model.probability(model.texts(texts_of(rows.column("text")), sign))
            return {c: rows.column(c) for c in keep} | {"score": p, "predicted": (p >= threshold).astype(np.int32)}

        return do

    wanted = docs.select(*dict.fromkeys((*keep, "text")))
    return map_steps(wanted, "text", f"{kinds}, score double, predicted int", work)
