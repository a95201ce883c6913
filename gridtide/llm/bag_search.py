"""Operator 11: ranked lexical search over classes of equal bags.

Documents are restricted to the items' vocabulary: what is left of one is its bag, the counts of the vocabulary's terms, and
a length number m. Documents of equal bag and m score alike for every item, so they form one class: grouped by hash and
compared byte by byte. Each class is scored once against all items, by walking the items' postings of its terms. An item's
first `top` documents lie in its first `top` classes, ordered by score and smallest key, since each of those classes has a
document before all of the next class. Only these classes are expanded, each to its first `top` members by ascending key.

A task keeps `top` classes per item, whatever it reads. Items are cut into blocks of at most `BLOCK_BYTES` of text; each block
has a vocabulary, postings and a pass over the documents of its own. Scores are whole numbers: sums that doubles may not
hold exactly are added in two parts.

Terms are runs of ASCII digits and letters, A-Z lower-cased, and of signs outside ASCII; they are found by 64-bit hashes and
compared byte by byte. Null and empty texts have no terms, count in no statistic and are never found. Items that share an
id are one item with the terms of all, null being an id too; items without a term find nothing. Rows that repeat a
document's key are documents of their own. Keys are whole numbers; a null key comes before all others. Only the columns
named are read, so others may have any names. Empty tables give an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gridtide.llm.common import Bytes, steps, stored

BLOCK_BYTES = 4 << 20
#: Numbers that a step of scoring holds, classes that a task holds before it forgets all but the best.
STEP, HELD, FILTER = 1 << 22, 1 << 18, 1 << 20
#: Parts in which the best of an item are chosen before the last choice.
PARTS = 64
FIRST = -(2**63)


def term_bytes() -> np.ndarray:
    inside = np.zeros(256, bool)
    inside[48:58] = inside[97:123] = inside[128:] = True
    return inside


@dataclass
class Items:
    """The items of one block: terms by number, each with its spelling and the items that hold it."""

    ids: list
    hashes: np.ndarray
    letters: np.ndarray
    start: np.ndarray
    size: np.ndarray
    first: np.ndarray
    item: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        """From rows (id, text)."""
        ids = sorted({i for i, _ in rows}, key=lambda i: (i is not None, i))
        number = {i: n for n, i in enumerate(ids)}
        words = Bytes(pa.array([t for _, t in rows], pa.string()), term_bytes())
        hashes, place, term = np.unique(words.hash, return_index=True, return_inverse=True)
        size = (words.stop - words.start)[place]
        start = np.cumsum(size) - size
        letters = words.data[_spread(words.start[place], size)]
        spelled = {letters[a : a + n].tobytes() for a, n in zip(start, size, strict=True)}
        every = {words.data[a:b].tobytes() for a, b in zip(words.start, words.stop, strict=True)}
        if spelled != every:
            raise ValueError("two terms of the items share a hash")
        owner = np.array([number[i] for i, _ in rows], np.int64)[words.row] if len(words.row) else np.zeros(0, np.int64)
        pairs = np.unique(np.stack((term, owner), 1), axis=0) if len(term) else np.zeros((0, 2), np.int64)
        return cls(ids, hashes, letters, start, size, np.searchsorted(pairs[:, 0], np.arange(len(hashes) + 1)), pairs[:, 1])

    def terms(self, words: Bytes) -> tuple[np.ndarray, np.ndarray]:
        """The places of the words that are terms, and the terms' numbers."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        bits = np.zeros(FILTER, bool)
        bits[(self.hashes & np.uint64(FILTER - 1)).astype(np.int64)] = True
        at = np.flatnonzero(bits[(words.hash & np.uint64(FILTER - 1)).astype(np.int64)])
        term = np.minimum(np.searchsorted(self.hashes, words.hash[at]), len(self.hashes) - 1)
        same = (self.hashes[term] == words.hash[at]) & (self.size[term] == (words.stop - words.start)[at])
        at, term = at[same], term[same]
        size = self.size[term]
        equal = words.data[_spread(words.start[at], size)] == self.letters[_spread(self.start[term], size)]
        same = np.logical_and.reduceat(equal, np.cumsum(size) - size) if len(size) else np.zeros(0, bool)
        return at[same], term[same]


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, … of each of the runs, one behind the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def bags(docs: DataFrame, items: Items, key: str, text: str) -> DataFrame:
    """(doc, n_terms, bag): a bag holds (term, count) in pairs of 32-bit numbers, ascending by term."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, inside = shared.value, term_bytes()
        for batch in batches:
            for rows in steps(batch, "text"):
                words = Bytes(rows.column("text"), inside)
                at, term = items.terms(words)
                found, count = np.unique(words.row[at] * len(items.hashes) + term, return_counts=True)
                row, term = np.divmod(found, max(1, len(items.hashes)))
                pairs = np.stack((term, count), 1).astype("<u4")
                ends = np.searchsorted(row, np.arange(rows.num_rows + 1)).astype(np.int32) * 8
                bag = pa.Array.from_buffers(pa.binary(), rows.num_rows, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(pairs.tobytes())])
                yield pa.RecordBatch.from_arrays([rows.column("doc"), pa.array(np.diff(words.first), pa.int64()), bag], names=["doc", "n_terms", "bag"])

    return docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).mapInArrow(run, "doc bigint, n_terms bigint, bag binary")


def _pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of a column of bags."""
    raw = column.to_pylist()
    data = np.frombuffer(b"".join(raw), "<u4").reshape(-1, 2).astype(np.int64)
    return np.repeat(np.arange(len(raw)), [len(b) // 8 for b in raw]), data[:, 0], data[:, 1]


def document_counts(found: DataFrame, n_terms: int) -> np.ndarray:
    """How many documents hold each term; a task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n_terms, np.int64)
        for batch in batches:
            sums += np.bincount(_pairs(batch.column(0))[1], minlength=n_terms)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(sums[some], pa.int64())], names=["term", "n"])

    out = np.zeros(n_terms, np.int64)
    for r in found.select("bag").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r.term] = r.n
    return out


class Best:
    """The `top` classes per item of those seen, by score and smallest member."""

    def __init__(self, n_items: int, top: int) -> None:
        self.top, self.least = top, np.ones(n_items, np.int64)
        self.parts: list[np.ndarray] = [np.zeros((4, 0), np.int64)]
        self.held = 0

    def add(self, scores: np.ndarray, first: np.ndarray, number: np.ndarray) -> None:
        """`scores` is classes by items."""
        row, item = np.nonzero(scores >= self.least)
        self.parts.append(np.stack((item, scores[row, item], first[row], number[row])))
        self.held += len(row)
        if self.held > HELD:
            self.forget()

    def forget(self) -> None:
        all_ = np.concatenate(self.parts, axis=1)
        all_ = all_[:, np.lexsort((all_[2], -all_[1], all_[0]))]
        place = np.arange(all_.shape[1]) - np.searchsorted(all_[0], all_[0])
        last = place == self.top - 1
        self.least[all_[0, last]] = all_[1, last]
        self.parts = [all_[:, place < self.top]]
        self.held = self.parts[0].shape[1]


def _sums(key: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    """Exact sums of whole numbers by key."""
    if value.sum(dtype=np.float64) < 2**52:
        return np.bincount(key, value, size).astype(np.int64)
    high, low = np.divmod(value, 1 << 20)
    return (np.bincount(key, high, size).astype(np.int64) << 20) + np.bincount(key, low, size).astype(np.int64)


def score(classes: DataFrame, items: Items, weights: np.ndarray, top: int) -> DataFrame:
    """(item, score, first, class): the best `top` classes of each task for each item, of scores above 0."""
    shared = classes.sparkSession.sparkContext.broadcast((items.first, items.item, len(items.ids), weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, item, n_items, weights = shared.value
        best = Best(n_items, top)
        size = max(1, STEP // max(n_items, len(item), 1))
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                rows = batch.slice(at, size)
                row, term, count = _pairs(rows.column("bag"))
                m = rows.column("m").to_numpy()[row]
                worth = weights[term] * ((1_000_000_000 * count) // (1000 * count + 20 * m))
                n = first[term + 1] - first[term]
                key = np.repeat(row * n_items, n) + item[_spread(first[term], n)]
                scores = _sums(key, np.repeat(worth, n), rows.num_rows * n_items).reshape(rows.num_rows, n_items)
                best.add(scores, rows.column("first").to_numpy(), rows.column("class").to_numpy())
        best.forget()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in best.parts[0]], names=["item", "score", "first", "class"])

    return classes.select("class", "m", "first", "bag").mapInArrow(run, "item bigint, score bigint, first bigint, class bigint")


def _first(rows: DataFrame, by: str, order: list[Column], top: int, part: Column) -> DataFrame:
    """The first `top` rows of each `by`, chosen in parts before the last choice, with `rank` from 1."""
    rows = rows.withColumn("part", F.pmod(F.xxhash64(part), F.lit(PARTS)))
    for names in ((by, "part"), (by,)):
        window = Window.partitionBy(*names).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= top)
    return rows.drop("part")


def search(
    docs: DataFrame, items: DataFrame, top: int = 50, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(item_key, rank, key, score): the `top` documents of each item with a score above 0, ties by ascending key."""
    kinds = items.schema[item_key].dataType, docs.schema[key].dataType
    rows = items.select(F.col(item_key).alias("id"), F.col(item_text).alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    out = docs.sparkSession.createDataFrame([], f"{item_key} {kinds[0].simpleString()}, rank int, {key} {kinds[1].simpleString()}, score bigint")
    for i in range(n):
        block = Items.of([tuple(r) for r in rows.where(F.pmod(F.xxhash64("id"), F.lit(n)) == i).collect()])
        if not len(block.hashes):
            continue
        found = _ranked(docs, block, top, key, text)
        ids = pa.array(block.ids, to_arrow_type(kinds[0]))

        def name(batches: Iterator[pa.RecordBatch], ids: pa.Array = ids) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([ids.take(batch.column("item")), *batch.columns[1:]], names=[item_key, *batch.schema.names[1:]])

        named = found.mapInArrow(name, f"{item_key} {kinds[0].simpleString()}, rank int, doc bigint, score bigint")
        out = out.unionByName(named.withColumnRenamed("doc", key).withColumn(key, F.col(key).cast(kinds[1])))
    return out


def _ranked(docs: DataFrame, items: Items, top: int, key: str, text: str) -> DataFrame:
    """(item, rank, doc, score) with the items' numbers."""
    found = stored(bags(docs, items, key, text), "bags")
    all_ = found.agg(F.count_if(F.col("n_terms") > 0).alias("n"), F.sum("n_terms").alias("l")).first()
    n, length = all_["n"] or 0, all_["l"] or 0
    weights = np.floor(1000 * np.log((2 * n + 2) / (2 * document_counts(found, len(items.hashes)) + 1))).astype(np.int64)
    m = F.expr(f"50 + (50 * n_terms * {n}L) div {max(1, length)}L").alias("m")
    held = found.where("length(bag) > 0").select("doc", m, "bag", F.xxhash64("bag").alias("hash"))
    # Grouping compares whole bags; the hash only deals them.
    grouped = held.groupBy("hash", "m", "bag").agg(F.min(F.coalesce("doc", F.lit(FIRST))).alias("first"))
    classes = stored(grouped.withColumn("class", F.monotonically_increasing_id()), "classes")
    order = [F.desc("score"), F.asc("first")]
    best = stored(_first(score(classes, items, weights, top), "item", order, top, F.col("class")).drop("rank"), "best")
    # At most `top` classes per item: few enough to pick their members by hash without moving the documents.
    chosen = stored(classes.join(best.select("class").distinct(), "class", "left_semi").select("class", "hash", "m", "bag"), "chosen")
    hashes = stored(chosen.select("hash").distinct(), "hashes")
    members = held.join(hashes, "hash", "left_semi").join(chosen, ["hash", "m", "bag"]).select("class", "doc")
    members = _first(members, "class", [F.asc_nulls_first("doc")], top, F.col("doc")).select("class", "doc")
    pairs = best.join(members, "class")
    window = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc"))
    return pairs.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= top).select("item", "rank", "doc", "score")
