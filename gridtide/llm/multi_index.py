"""Operator 7: nearest neighbours by multi-index hashing of learned binary codes.

Codes are signs of vectors under several rotations, each learned on a bounded sample by alternating between signs and the
rotation that fits them best. Vectors get a last component that makes their norms equal, so nearest codes mean largest
inner products. Every row is indexed: rows are dealt to shards of bounded size; a shard splits its codes into substrings of
16 bits and indexes each substring's values. If a code lies within radius m * (a + 1) - 1 of a query's, one of its m
substrings lies within a: probing all values that near in every substring retrieves every code in the radius. The radius
is the smallest that holds at least `SHARE` of the shard's different codes (`LEAST` at least); probing begins where it
ended for the query before, whose radius is seldom another. All vectors with those codes are compared in single precision,
those that its error leaves in question in double precision, and the best of all shards are merged. Equal codes are one
entry of the index.

`recall` compares with brute force. Vectors that are null or empty, zero, or hold null or non-finite components take no
part, nor do those with a null id or of another length than most (of equals, the longer). Rows that share an id count as
one, the smallest array. With fewer candidates than asked for, all are returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridtide.llm.common import bounded, stored

SAMPLE, ROTATIONS, TURNS = 5_000, 4, 12
SHARD_ROWS, QUERY_ROWS = 16_384, 8_192
SHARE, LEAST = 0.04, 400
PROBE = 16
# More than single precision can change of a product of two vectors of length 1, by component.
ERROR = 2.4e-7
_ONES = np.array([bin(i).count("1") for i in range(1 << PROBE)], np.uint8)


def learn(sample: np.ndarray, seed: int = 3) -> list[np.ndarray]:
    """Rotations under which the sample's signs lose least."""
    rng, d = np.random.default_rng(seed), sample.shape[1]
    found = []
    for _ in range(-(-ROTATIONS * 64 // (PROBE * (-(-d // PROBE))))):
        turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(TURNS if len(sample) else 0):
            signs = np.where(sample @ turn > 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(signs.T @ sample)
            turn = (u @ vt).T
        found.append(turn)
    return found


def extended(x: np.ndarray, largest: float) -> np.ndarray:
    """With the component that makes all norms equal; 0 for queries (largest = 0)."""
    rest = np.sqrt(np.maximum(largest**2 - (x * x).sum(1), 0.0)) if largest else np.zeros(len(x))
    return np.column_stack((x, rest))


def codes(x: np.ndarray, rotations: list[np.ndarray]) -> np.ndarray:
    """A row of 16-bit substrings per vector."""
    bits = np.concatenate([x @ r > 0 for r in rotations], axis=1)
    pad = -bits.shape[1] % PROBE
    bits = np.pad(bits, ((0, 0), (0, pad)))
    return np.packbits(bits.reshape(len(x), -1, PROBE), axis=2).view(np.uint16)[:, :, 0]


class Shard:
    """The index of one shard: different codes, the values of each substring with their codes, and the vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, rotations: list[np.ndarray], largest: float) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.codes, owner = np.unique(codes(extended(self.x, largest), rotations), axis=0, return_inverse=True)
        self.members = np.argsort(owner, kind="stable")
        self.edge = np.searchsorted(owner[self.members], np.arange(len(self.codes) + 1))
        parts = []
        for j in range(self.codes.shape[1]):
            listed = np.argsort(self.codes[:, j], kind="stable")
            values, first, size = np.unique(self.codes[listed, j], return_index=True, return_counts=True)
            parts.append((values, np.full(len(values), j), first + j * len(listed), size, listed))
        # The buckets of all substrings in one array each: value, first entry in `listed`, entries.
        self.buckets = np.array([len(p[0]) for p in parts])
        self.value, self.first, self.size, self.listed = (np.concatenate([p[i] for p in parts]) for i in (0, 2, 3, 4))
        # Codes as 64-bit words, for counting the bits in which they differ.
        self.words = _words(self.codes)
        self.largest, self.unit, self.start = largest, (self.x / largest).astype(np.float32), 0

    def within(self, code: np.ndarray) -> np.ndarray:
        """Numbers of all codes within the smallest radius m * (a + 1) - 1 that holds enough of them."""
        m, enough = self.codes.shape[1], min(len(self.codes), max(LEAST, int(SHARE * len(self.codes))))
        near = np.bitwise_count(self.value ^ np.repeat(code, self.buckets))
        whole, seen = _words(code[None])[0], np.zeros(len(self.codes), bool)
        for a in range(self.start, PROBE + 1):
            # The first round probes all values up to a, each further one those that are a away.
            hit = np.flatnonzero(near <= a) if a == self.start else np.flatnonzero(near == a)
            size = self.size[hit]
            seen[self.listed[np.repeat(self.first[hit] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]] = True
            numbers = np.flatnonzero(seen)
            far = np.bitwise_count(self.words[numbers] ^ whole).sum(1, dtype=np.int64)
            if np.count_nonzero(far < m * (a + 1)) >= enough:
                break
        # All codes of smaller radii were retrieved, too; one of those may hold enough.
        self.start = int(np.partition(far, enough - 1)[enough - 1]) // m
        return numbers[far < m * (self.start + 1)]

    def search(self, query_id: int, query: np.ndarray, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best `k` of the retrieved vectors but the query's own."""
        found = self.within(code)
        size = self.edge[found + 1] - self.edge[found]
        rows = self.members[np.repeat(self.edge[found] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
        rows = rows[self.ids[rows] != query_id]
        if len(rows) > k:
            # What is below the k-th by more than the error of both can't be among the best.
            about = self.unit.take(rows, axis=0) @ (query / np.sqrt(query @ query)).astype(np.float32)
            floor = np.partition(about, len(rows) - k)[len(rows) - k] - 2 * ERROR * (len(query) + 4)
            rows = rows[about >= floor]
        score = np.einsum("ij,j->i", self.x[rows], query)
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows[best]], score[best]


def _words(codes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.pad(codes, ((0, 0), (0, -codes.shape[1] % 4)))).view(np.uint64)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(sound).groupBy("id").agg(F.min("v").alias("v"))


def common_length(rows: DataFrame) -> tuple[int, int]:
    """The commonest length of the vectors and how many have it."""
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (size["d"], size["count"]) if size else (0, 0)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` nearest of each row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    rows = stored(usable(vectors, key, vector), "vectors")
    result = f"query_id bigint, rank int, {key} bigint, score double"
    d, n = common_length(rows)
    if not n:
        return spark.createDataFrame([], result)
    rows = rows.where(F.size("v") == d)
    largest = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()[0] * (1 + 1e-12)
    sample = matrix(bounded(rows, "id", SAMPLE).select("v").toArrow().column("v"))
    shared = spark.sparkContext.broadcast(learn(extended(sample, largest)))
    queries = rows.where(F.pmod("id", F.lit(every)) == 0)
    shards, blocks = -(-n // SHARD_ROWS), max(1, -(-queries.count() // QUERY_ROWS))
    # A shard meets a block of queries in one task: both have bounded sizes.
    left = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("block", F.pmod(F.xxhash64("id", F.lit("query")), F.lit(blocks)).cast("int"))
    right = right.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def meet(own: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if own.num_rows and asked.num_rows:
            rotations = shared.value
            shard = Shard(own.column("id").to_numpy(), matrix(own.column("v")), rotations, largest)
            q = matrix(asked.column("v"))
            for number, x, code in zip(asked.column("id").to_pylist(), q, codes(extended(q, 0.0), rotations), strict=True):
                ids, scores = shard.search(number, x, code, k)
                out.append((np.full(len(ids), number), ids, scores))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", key, "score"), columns, strict=True)))

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(meet, f"query_id bigint, {key} bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    ranked = found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")
    return ranked.select("query_id", "rank", key, "score")


def recall(found: DataFrame, vectors: DataFrame, every: int = 20, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> float:
    """Share of the true neighbours found, by brute force on the driver: for small tables."""
    rows = usable(vectors, key, vector)
    table = rows.where(F.size("v") == common_length(rows)[0]).toArrow()
    ids, x = table.column("id").to_numpy(), matrix(table.column("v"))
    got = {(r["query_id"], r[key]) for r in found.select("query_id", key).collect()}
    hit = total = 0
    for i in np.flatnonzero(ids % every == 0):
        score = x @ x[i]
        score[i] = -np.inf
        best = ids[np.lexsort((ids, -score))[: min(k, len(ids) - 1)]]
        total += len(best)
        hit += sum((ids[i], b) in got for b in best)
    return hit / max(1, total)
