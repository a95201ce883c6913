"""Operator 12: shards in a random order, by a two-pass external shuffle.

First pass: every record goes to one of as many buckets as the table's bytes need at `BUCKET_BYTES` each, by a seeded hash of
all its columns. Second pass: each bucket is shuffled in memory by Fisher and Yates with a generator seeded by its number,
and written. The buckets one behind the other are one random order of all records; it is cut into shards whose numbers of
records are at most one apart (the law `rows`). A bucket's place follows from the counts of the former, summed in two levels.

The order depends on the records, the seed and the numbers of shards and bytes alone, not on files or partitions: a bucket is
put in the order of its hashes before it is shuffled. Records that are alike in all columns would share a bucket, however
many there are; they are counted first, and each copy goes to the bucket of its own number, so a third of all rows spreads
out like any other. A record whose text alone is larger than `BUCKET_BYTES` makes its bucket larger by that much.

Null keys and texts are values like others. Records are carried as one struct, so their columns may have any names. Files
lie in one folder per shard, ordered by slot; Spark's committer moves whole tasks only. An empty table gives no shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from gridtide.llm.common import stored

BUCKET_BYTES = 16 << 20
#: What a record takes beside its text; buckets whose counts are added at once; copies made by one row at once.
ROW_BYTES, GROUP, COPIES = 64, 1024, 1024
LAW = "rows"


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A random order of n places: each place in turn is swapped with itself or a later one."""
    order = np.arange(n)
    draws = np.random.Generator(np.random.PCG64([seed, bucket])).integers(order, n)
    for i, j in enumerate(draws.tolist()):
        order[i], order[j] = order[j], order[i]
    return order


def _records(docs: DataFrame, seed: int) -> DataFrame:
    """(record, identity, copy): each row as a struct, its hash, and a number that tells equal rows apart."""
    # Spark's hashes take no maps; rows that differ in maps only share an identity, and are still grouped as a whole below.
    hashable = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), F.xxhash64(F.lit(seed), *hashable).alias("identity"))
    repeated = stored(rows.groupBy("identity").count().where("count > 1").select("identity"), "repeated")
    single = rows.join(repeated, "identity", "left_anti").select("record", "identity", F.lit(0).cast("bigint").alias("copy"))
    groups = rows.join(repeated, "identity", "left_semi").groupBy("identity", "record").agg(F.count("*").alias("n"))
    # Many copies of one row are made by many tasks.
    blocks = groups.withColumn("block", F.explode(F.expr(f"sequence(0L, (n - 1) div {COPIES})"))).repartition("identity", "block")
    copies = blocks.withColumn("copy", F.explode(F.expr(f"sequence(block * {COPIES}, least(n, (block + 1) * {COPIES}) - 1)")))
    return single.unionByName(copies.select("record", "identity", "copy"))


def _offsets(counts: DataFrame) -> DataFrame:
    """(bucket, before): the records of all former buckets, by groups of buckets first."""
    counts = stored(counts.withColumn("group", F.floor(F.col("bucket") / GROUP)), "buckets")
    groups = counts.groupBy("group").agg(F.sum("n").alias("n"))
    former = groups.select("group", (F.sum("n").over(Window.orderBy("group")) - F.col("n")).alias("base"))
    within = F.sum("n").over(Window.partitionBy("group").orderBy("bucket")) - F.col("n")
    return counts.withColumn("within", within).join(former, "group").select("bucket", (F.col("base") + F.col("within")).alias("before"))


def shuffle(docs: DataFrame, shards: int = 8, seed: int = 0, bucket_bytes: int = BUCKET_BYTES, text: str = "text") -> DataFrame:
    """(record, shard, slot) of every row."""
    if shards < 1:
        raise ValueError(f"shards must be >= 1, got {shards}")
    total = docs.agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + ROW_BYTES).alias("bytes")).first()
    n_buckets = max(1, -(-(total["bytes"] or 0) // bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "identity", "copy"), F.lit(n_buckets)).alias("bucket")
    rows = _records(docs, seed)
    before = stored(_offsets(rows.groupBy(bucket).agg(F.count("*").alias("n"))), "offsets")
    dealt = rows.select(bucket, F.xxhash64(F.lit(seed + 1), "identity", "copy").alias("order"), "identity", "copy", "record").join(before, "bucket")

    def mix(table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending"), ("identity", "ascending"), ("copy", "ascending")])
        order = fisher_yates(table.num_rows, seed, table["bucket"][0].as_py())
        place = pa.array(table["before"][0].as_py() + np.arange(table.num_rows), pa.int64())
        return pa.table({"record": table["record"].take(pa.array(order)), "place": place})

    placed = dealt.groupBy("bucket").applyInArrow(mix, _schema(docs, "place bigint"))
    least, more = divmod(total["n"], shards)
    edge = more * (least + 1)
    place = F.col("place")
    early, late = F.floor(place / (least + 1)), F.lit(more) + F.floor((place - edge) / max(1, least))
    shard = F.when(place < edge, early).otherwise(late).cast("int")
    start = F.when(place < edge, early * (least + 1)).otherwise(edge + (late - more) * least)
    return placed.select("record", shard.alias("shard"), (place - start).cast("bigint").alias("slot"))


def write(docs: DataFrame, folder: str, shards: int = 8, seed: int = 0, bucket_bytes: int = BUCKET_BYTES, text: str = "text") -> None:
    """One folder of Parquet files per shard, `shard=<number>`, with (record, slot) in ascending slots."""
    rows = shuffle(docs, shards, seed, bucket_bytes, text).sortWithinPartitions("shard", "slot")
    rows.write.partitionBy("shard").parquet(folder)


def read(docs: DataFrame, folder: str) -> DataFrame:
    """(record, slot, shard) of the files that `write` made of `docs`."""
    return docs.sparkSession.read.schema(_schema(docs, "slot bigint, shard int")).parquet(folder)


def _schema(docs: DataFrame, others: str) -> StructType:
    return StructType([StructField("record", docs.schema), *StructType.fromDDL(others)])
