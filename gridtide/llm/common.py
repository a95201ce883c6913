"""What the operators of this subpackage share: reading, splits, bounded samples, Arrow batches, caches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.session import materialize

#: Characters or bytes that one step inside a task holds as arrays.
STEP_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def split_of(key: str, parts: int) -> Column:
    """crc32 of the key's text modulo `parts`; null for a null key."""
    return F.crc32(F.col(key).cast("string")) % parts


def bounded(df: DataFrame, key: str, limit: int) -> DataFrame:
    """All rows if there are at most `limit`, else about `limit` of them, chosen by a hash of the key."""
    n = df.count()
    if n <= limit:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1_000_000)) < int(1_000_000 * limit / n))


def one_label(labels: DataFrame, column: str) -> DataFrame:
    """One label per document: repeated rows collapse, of contradicting ones the larger holds, null is no label."""
    rows = labels.select("doc_id", F.col(column).cast("int").alias("label"))
    return rows.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))


def steps(batch: pa.RecordBatch, column: str, size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about `size` bytes, never less than one row."""
    offsets = np.concatenate(([0], np.cumsum(lengths(batch.column(column)))))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def map_steps(df: DataFrame, column: str, schema: str, work: Callable[[], Callable], size: int = STEP_BYTES) -> DataFrame:
    """`work()` is called once per task and gives the function from a slice of rows to a dict of columns."""
    types = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, do = to_arrow_schema(types), work()
        for batch in batches:
            for rows in steps(batch, column, size):
                out = do(rows)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, types)


#: 64-bit words of a sieve; with them its broadcast is bounded, whatever the number of keys.
SIEVE = 1 << 18


def maybe_in(rows: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """`rows` with a column `maybe`: true for all whose columns `on` are a row of `keys`, and for some others by chance.

    A join of few keys with many texts needs to move only the rows that are true, and compares those exactly. The keys set
    bits of a broadcast table of at most `SIEVE` words; at a sixteenth of a key a bit one row in sixteen is true by chance.
    """
    hashed = F.xxhash64(*on)
    word, bit = F.pmod(F.shiftrightunsigned(hashed, 6), F.lit(SIEVE)), F.call_function("shiftleft", F.lit(1).cast("bigint"), hashed.bitwiseAND(F.lit(63)).cast("int"))
    bits = keys.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    met = rows.withColumn("_at", word).join(F.broadcast(bits), F.col("_at") == F.col("_word"), "left")
    return met.withColumn("maybe", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_at", "_word", "_bits")


#: Longer words are not remembered: a cache of so many entries then has a bound in bytes too.
REMEMBERED = 64


class Remember(dict):
    """A function of a word with its results; two generations bound it to `limit` entries each, of short words only."""

    def __init__(self, function: Callable, limit: int) -> None:
        super().__init__()
        self.function, self.limit, self.old = function, limit, {}

    def __missing__(self, key):
        if len(key) > REMEMBERED:
            return self.function(key)
        got = self.old.get(key)
        if got is None:
            got = self.function(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


def stored(df: DataFrame, label: str) -> DataFrame:
    """Written below the shared folder and read again."""
    return materialize(df, label)


# ---- arrays over texts -------------------------------------------------------------------------------------------

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: a bijection whose bits all depend on all bits."""
    x = x + _M3
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Bytes:
    """The texts of a slice as one array of UTF-8 bytes with a zero byte behind each, and its words.

    `letters` says for each of the 256 bytes whether it belongs to a word; A-Z become a-z. Words have `start`, `stop`,
    `row` and a 64-bit `hash`; a row's words are `first[row]` to `first[row + 1]`.
    """

    def __init__(self, column: pa.Array, letters: np.ndarray) -> None:
        texts = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
        raw = b"\0".join(texts.to_pylist()) + b"\0"
        self.data = _LOWER[np.frombuffer(raw, np.uint8)]
        ends = np.cumsum(lengths(column) + 1)
        inside = letters[self.data]
        inside[ends - 1] = False
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))
        self.start, self.stop = edge[::2], edge[1::2]
        self.row = np.searchsorted(ends, self.start, side="right")
        self.first = np.searchsorted(self.row, np.arange(len(column) + 1))
        self.hash = self._hash(inside)

    def _hash(self, inside: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = self.stop - self.start
        at = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(np.cumsum(size) - size, size)
        value = _VALUES[self.data[inside]] * powers(int(size.max()))[at]
        sums = np.add.reduceat(value, np.cumsum(size) - size)
        return mix(sums ^ size.astype(np.uint64))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = mix(np.arange(1, 257, dtype=np.uint64))
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """Powers of an odd multiplier modulo 2^64, at least `n` of them."""
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, 256), 0xD6E8FEB86659FD93, np.uint64)
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS


class Points:
    """The texts of a slice as one array of code points, a line feed behind each."""

    def __init__(self, texts: list[str]) -> None:
        self.texts = texts
        joined = "\n".join(texts) + "\n"
        self.data = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.stop = np.cumsum(self.size)
        self.start = self.stop - self.size

    def rows(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.stop, positions, side="right")


_TABLES: dict[str, np.ndarray] = {}


def character_table(name: str, test: Callable[[str], bool]) -> np.ndarray:
    """Whether each code point passes a test of `str`; built once per process."""
    if name not in _TABLES:
        _TABLES[name] = np.fromiter((test(chr(i)) for i in range(0x110000)), bool, 0x110000)
    return _TABLES[name]


def texts_of(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]
