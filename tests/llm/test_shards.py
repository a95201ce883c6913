"""Operator 12 against a version in one process."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtide.llm import external_shuffle, queries

COLUMNS = "doc_id bigint, text string, extra map<string,int>, record int, `odd name` string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, {"a": n % 2} if n % 3 else None, 1, "x") for n, (i, t) in enumerate(rows)], COLUMNS)


def by_hand(docs, shards, seed, bucket_bytes):
    """The same law in one process, from the rows' hashes."""
    rows = docs.select("doc_id", "text", F.xxhash64(F.lit(seed), "doc_id", "text", "record", "`odd name`").alias("h")).collect()
    n_buckets = max(1, -(-sum(len((r.text or "").encode()) + 64 for r in rows) // bucket_bytes))
    copies, numbered = Counter(), []
    for r in rows:
        numbered.append((r.doc_id, r.text, r.h, copies[r.h]))
        copies[r.h] += 1
    spark = docs.sparkSession
    hashed = spark.createDataFrame(numbered, "doc_id bigint, text string, h bigint, c bigint").select(
        "doc_id", "text", "h", "c", F.pmod(F.xxhash64(F.lit(seed), "h", "c"), F.lit(n_buckets)).alias("b"), F.xxhash64(F.lit(seed + 1), "h", "c").alias("o")
    )
    buckets = defaultdict(list)
    for r in hashed.collect():
        buckets[r.b].append((r.o, r.h, r.c, r.doc_id, r.text))
    line = []
    for b in sorted(buckets):
        some = sorted(buckets[b])
        line += [some[i][3:] for i in external_shuffle.fisher_yates(len(some), seed, b)]
    sizes = [len(line) // shards + (s < len(line) % shards) for s in range(shards)]
    out, at = [], 0
    for s, n in enumerate(sizes):
        out += [(*line[at + i], s, i) for i in range(n)]
        at += n
    return out, n_buckets


def flat(df):
    return sorted(((r.record.doc_id, r.record.text, r.shard, r.slot) for r in df.collect()), key=str)


@pytest.mark.parametrize("n, shards, bucket_bytes", [(500, 8, 4000), (5, 8, 100), (17, 3, 1 << 20)])
def test_equals_one_process_and_not_the_layout(spark, tmp_path, n, shards, bucket_bytes):
    rng = np.random.default_rng(n)
    rows = [(int(i), "t" * int(rng.integers(0, 200)) + "é") for i in rng.permutation(n)]
    docs = spark.createDataFrame([(i, t, None, 1, "x") for i, t in rows], COLUMNS)
    want, n_buckets = by_hand(docs, shards, 3, bucket_bytes)
    assert n_buckets > 5 or n < 500
    external_shuffle.write(docs.repartition(5), f"{tmp_path}/a", shards, 3, bucket_bytes)
    got = external_shuffle.read(docs, f"{tmp_path}/a")
    assert flat(got) == sorted(want, key=str)
    assert flat(external_shuffle.shuffle(docs.repartition(2), shards, 3, bucket_bytes)) == flat(got)
    assert flat(external_shuffle.shuffle(docs, shards, 4, bucket_bytes)) != flat(got) or n < 10


def test_copies_null_keys_and_long_texts(spark, make_docs, odd_texts):
    rows = list(enumerate(odd_texts)) + [(None, None)] * 40 + [(7, "hot")] * 2600 + [(7, f"own {i}") for i in range(300)] + [(i, "copy") for i in range(900)]
    docs = make_docs(rows)
    placed = external_shuffle.shuffle(docs, 8, 0, 4000)
    got = placed.select("record.doc_id", "record.text", "shard", "slot", "record.score").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows) and {r.score for r in got} == {"no"}
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    hot = Counter(r.shard for r in got if r.text == "hot")
    assert max(hot.values()) < 2 * 2600 / 8
    assert flat(placed) == flat(external_shuffle.shuffle(docs.repartition(3), 8, 0, 4000))


def test_equal_rows_are_spread_over_buckets(spark):
    docs = docs_of(spark, [(1, "x")] * 5000).drop("extra")
    sizes = external_shuffle._records(docs, 0).groupBy(F.pmod(F.xxhash64("identity", "copy"), F.lit(20))).count().toPandas()["count"]
    assert len(sizes) == 20 and sizes.max() < 350


def test_every_order_is_as_likely():
    counts = Counter(tuple(external_shuffle.fisher_yates(4, 0, b)) for b in range(24_000))
    assert len(counts) == 24 and all(850 < n < 1150 for n in counts.values())


def test_empty_table_and_shards(spark, tmp_path):
    docs = docs_of(spark, [(1, "x")]).limit(0)
    external_shuffle.write(docs, f"{tmp_path}/none")
    assert external_shuffle.shuffle(docs).count() == 0 and external_shuffle.read(docs, f"{tmp_path}/none").count() == 0
    with pytest.raises(ValueError, match="shards"):
        external_shuffle.shuffle(docs, 0)


def test_query_returns_sizes_and_digests(spark):
    sf = "/root/testdata/sf0.001"
    want = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op12_external_shuffle"](spark, sf).collect()
    assert len(got) == len(want) and {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    assert all(r.size == len(want[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(want[r.doc_id].encode()) for r in got)
