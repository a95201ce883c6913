"""Operator 6: benchmark decontamination with suffix arrays over the training texts.

Each task takes its documents in shards of bounded size and builds a suffix array over their words. Every suffix of
every test item is binary-searched in each shard's array; the range of training suffixes that begin with the item's window
(`window` words, or all words of a shorter item) gives every verbatim occurrence with its place, and extending an occurrence
word by word gives the longest match.

A match holds words of the test items only, so training suffixes begin in runs of such words that are as long as the
shortest window; all others can match nothing and aren't sorted. That is exact. The test items are cut into blocks of at
most `BLOCK_BYTES` of text. Each block meets all documents in a pass of its own, which adds to what the former have found.

Words are runs of ASCII digits and letters, lower-cased, and of signs outside ASCII; they are compared by 64-bit hashes.
Null texts have no words; items that are null or have no word match nothing, items that share an id count as one, an item
without an id is not searched. Repeated rows give repeated results. Only the columns named are read, plus those to be kept.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridtide.llm.common import Bytes, steps, stored

BLOCK_BYTES, SHARD_BYTES, FILTER = 8 << 20, 2 << 20, 1 << 20


def word_bytes() -> np.ndarray:
    inside = np.zeros(256, bool)
    inside[48:58] = inside[97:123] = inside[128:] = True
    return inside


@dataclass
class Tests:
    """The items of one block: `words` are numbers in the block's vocabulary, with a zero behind each item."""

    ids: list[str]
    vocabulary: np.ndarray
    words: np.ndarray
    item: np.ndarray
    start: np.ndarray
    size: np.ndarray
    window: int

    @classmethod
    def of(cls, ids: list[str], texts: list[str | None], window: int) -> Tests:
        words = Bytes(pa.array(texts, pa.string()), word_bytes())
        vocabulary, number = np.unique(words.hash, return_inverse=True)
        size = np.diff(words.first)
        start = words.first[:-1] + np.arange(len(ids))
        joined = np.zeros(len(number) + len(ids) + 1, np.int64)
        joined[np.arange(len(number)) + words.row] = number + 1
        return cls(ids, vocabulary, joined, np.repeat(np.arange(len(ids)), size), start, size, window)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary numbers of words, 0 for those that no item has."""
        out = np.zeros(len(hashes), np.int64)
        if not len(self.vocabulary):
            return out
        bits = np.zeros(FILTER, bool)
        bits[(self.vocabulary & np.uint64(FILTER - 1)).astype(np.int64)] = True
        at = np.flatnonzero(bits[(hashes & np.uint64(FILTER - 1)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.vocabulary, hashes[at]), len(self.vocabulary) - 1)
        out[at] = np.where(self.vocabulary[place] == hashes[at], place + 1, 0)
        return out


@dataclass
class Occurrences:
    """Windows of items in a shard: the row and word of the text, the item, the item's word, the window's length."""

    row: np.ndarray
    word: np.ndarray
    item: np.ndarray
    at: np.ndarray
    length: np.ndarray


class Shard:
    """A suffix array over the words of some documents that stand in runs of test words."""

    def __init__(self, words: Bytes, tests: Tests) -> None:
        self.tests = tests
        number = tests.numbers(words.hash)
        least = int(np.minimum(tests.size[tests.size > 0], tests.window).min()) if (tests.size > 0).any() else 1
        # Runs of test words within one row, by their first word and the word behind the last.
        owner = np.where(number > 0, words.row, -1)
        cut = np.flatnonzero(np.diff(owner, prepend=-2))
        end = np.append(cut[1:], len(owner))[: len(cut)]
        real = owner[cut] >= 0
        cut, end = cut[real], end[real]
        long = end - cut >= least
        first, size = cut[long], (end - cut)[long]
        gap = size + 1
        begin = np.cumsum(gap) - gap
        total = int(gap.sum())
        self.text = np.zeros(total + 1, np.int64)
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        places = np.repeat(begin, size) + inner
        self.source = np.full(total + 1, -1, np.int64)
        self.source[places] = np.repeat(first, size) + inner
        self.text[places] = number[self.source[places]]
        self.array = self._sort(places, int(size.max()) if len(size) else 0)

    def _sort(self, places: np.ndarray, longest: int) -> np.ndarray:
        """Suffixes in order, by ranks of prefixes of doubling length."""
        if not len(places):
            return places
        rank, n = self.text.copy(), len(self.text)
        step = 1
        while step < longest:
            ahead = np.zeros(n, np.int64)
            ahead[:-step] = rank[step:] if step < n else 0
            key = rank * (int(rank.max()) + 1) + ahead
            _, rank = np.unique(key, return_inverse=True)
            if int(rank.max()) == n - 1:
                break
            step *= 2
        return places[np.argsort(rank[places], kind="stable")]

    def _bound(self, start: np.ndarray, length: np.ndarray, above: bool) -> np.ndarray:
        """For each test suffix, cut to `length` words, the first place in the array at or above (or beyond) it."""
        low, high = np.zeros(len(start), np.int64), np.full(len(start), len(self.array))
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_]) // 2
            order = self._compare(self.array[middle], start[open_], length[open_])
            right = order < 0 if not above else order <= 0
            low[open_[right]] = middle[right] + 1
            high[open_[~right]] = middle[~right]

    def _compare(self, place: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the training suffix comes before the test words, begins with them or comes after."""
        out = np.zeros(len(place), np.int64)
        active, depth = np.arange(len(place)), 0
        while len(active):
            active = active[length[active] > depth]
            a = self.text[np.minimum(place[active] + depth, len(self.text) - 1)]
            b = self.tests.words[start[active] + depth]
            out[active] = np.sign(a - b)
            active = active[(a == b) & (a > 0)]
            depth += 1
        return out

    def occurrences(self) -> Occurrences:
        tests = self.tests
        length = np.minimum(tests.size, tests.window)
        count = np.where(tests.size > 0, tests.size - length + 1, 0)
        item = np.repeat(np.arange(len(count)), count)
        at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        start, long = tests.start[item] + at, length[item]
        low, high = self._bound(start, long, False), self._bound(start, long, True)
        times = high - low
        which = np.repeat(np.arange(len(times)), times)
        slot = np.repeat(low, times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        place = self.array[slot] if len(self.array) else np.zeros(0, np.int64)
        return Occurrences(np.zeros(0), place, item[which], at[which], long[which])

    def longest(self, found: Occurrences) -> Occurrences:
        """Occurrences that no word before extends, each as long as text and item agree."""
        tests = self.tests
        t = tests.start[found.item] + found.at
        before = (found.at > 0) & (found.word > 0) & (self.text[found.word - 1] == tests.words[t - 1])
        keep = np.flatnonzero(~before)
        place, t, length = found.word[keep], t[keep], found.length[keep].copy()
        active = np.arange(len(keep))
        while len(active):
            a = self.text[np.minimum(place[active] + length[active], len(self.text) - 1)]
            b = tests.words[np.minimum(t[active] + length[active], len(tests.words) - 1)]
            active = active[(a == b) & (a > 0)]
            length[active] += 1
        return Occurrences(found.row, place, found.item[keep], found.at[keep], length)


def blocks(items: DataFrame, key: str, text: str) -> list[DataFrame]:
    """The items in blocks of about `BLOCK_BYTES` of text each."""
    rows = items.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("string").alias("item"), F.col(text).alias("words"))
    size = rows.agg(F.sum(F.octet_length("words") + 64)).first()[0] or 0
    n = -(-size // BLOCK_BYTES) or 1
    return [rows.where(F.pmod(F.xxhash64("item", "words"), F.lit(n)) == i) for i in range(n)]


def _pass(docs: DataFrame, tests: Tests, text: str) -> DataFrame:
    """Adds to the columns `n_words`, `hits` (a byte per word) and `items` what one block of tests finds."""
    shared, schema = docs.sparkSession.sparkContext.broadcast(tests), docs.schema

    def run(batches):
        tests, letters = shared.value, word_bytes()
        for batch in batches:
            for rows in steps(batch, text, SHARD_BYTES):
                words = Bytes(rows.column(text), letters)
                shard = Shard(words, tests)
                found = shard.occurrences()
                place = shard.source[found.word]
                edge = np.zeros(len(words.row) + 1, np.int64)
                np.add.at(edge, place, 1)
                np.add.at(edge, place + found.length, -1)
                hit = np.cumsum(edge)[:-1] > 0
                pairs = np.unique(np.stack((words.row[place], found.item), 1), axis=0) if len(place) else np.zeros((0, 2), np.int64)
                own = np.searchsorted(pairs[:, 0], np.arange(rows.num_rows + 1))
                hits, items, sizes = [], [], np.diff(words.first)
                for i, (old, before) in enumerate(zip(rows.column("hits"), rows.column("items").to_pylist(), strict=True)):
                    a, b = words.first[i], words.first[i + 1]
                    new = hit[a:b]
                    if old.is_valid and len(old.as_py()):
                        new = new | (np.frombuffer(old.as_py(), np.uint8) > 0)
                    hits.append(new.astype(np.uint8).tobytes() if new.any() else b"")
                    items.append((before or []) + [tests.ids[j] for j in pairs[own[i] : own[i + 1], 1]])
                columns = {"n_words": pa.array(sizes, pa.int64()), "hits": pa.array(hits, pa.binary()), "items": pa.array(items, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([columns.get(f, rows.column(f) if f not in columns else None) for f in schema.names], names=schema.names)

    return docs.mapInArrow(run, schema)


def search(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The columns of `docs` with `n_words`, `hits` (empty or a byte per word) and `items` (ids with occurring windows)."""
    state = StructType.fromDDL("n_words bigint, hits binary, items array<string>")
    out = docs.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in state))
    for i, block in enumerate(blocks(items, item_key, item_text)):
        rows = sorted(block.collect())
        if i:
            out = stored(out, "decontaminated")
        out = _pass(out, Tests.of([r["item"] for r in rows], [r["words"] for r in rows], window), text)
    return out


def matches(docs: DataFrame, items: DataFrame, window: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Longest verbatim matches of at least a window: (key, item, doc_word, item_word, n_words), words counted from 0."""
    kind = docs.schema[key].dataType.simpleString()
    schema, parts = f"{key} {kind}, item string, doc_word bigint, item_word bigint, n_words bigint", []
    for block in blocks(items, "item_id", "text"):
        rows = sorted(block.collect())
        shared = docs.sparkSession.sparkContext.broadcast(Tests.of([r["item"] for r in rows], [r["words"] for r in rows], window))

        def run(batches, shared=shared):
            tests, letters = shared.value, word_bytes()
            for batch in batches:
                for some in steps(batch, text, SHARD_BYTES):
                    words = Bytes(some.column(text), letters)
                    shard = Shard(words, tests)
                    found = shard.longest(shard.occurrences())
                    place = shard.source[found.word]
                    row = words.row[place]
                    columns = [some.column(key).take(pa.array(row)), pa.array([tests.ids[j] for j in found.item], pa.string())]
                    columns += [pa.array(x, pa.int64()) for x in (place - words.first[row], found.at, found.length)]
                    yield pa.RecordBatch.from_arrays(columns, names=[key, "item", "doc_word", "item_word", "n_words"])

        parts.append(docs.select(key, text).mapInArrow(run, schema))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def report(docs: DataFrame, items: DataFrame, window: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated) per row of `docs`."""

    def run(batches):
        for batch in batches:
            hits = [0 if not h else int(np.frombuffer(h, np.uint8).sum()) for h in batch.column("hits").to_pylist()]
            names = [sorted(set(x or [])) for x in batch.column("items").to_pylist()]
            digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
            columns = [batch.column(key), batch.column("n_words"), pa.array(hits, pa.int64()), pa.array([len(x) for x in names], pa.int64())]
            columns += [pa.array(digests, pa.string()), pa.array([h > 0 for h in hits], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    kind = docs.schema[key].dataType.simpleString()
    found = search(docs.select(key, text), items, window, text).select(key, "n_words", "hits", "items")
    return found.mapInArrow(run, f"{key} {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean")


def clean(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text") -> DataFrame:
    """The rows of `docs` without any window of an item, with their columns."""
    kept = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], F.col(text).alias("words_of"))
    found = search(kept, items, window, "words_of").where("length(hits) = 0")
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
