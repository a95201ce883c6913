"""Operator 2: a deterministic sharded WARC writer and its reader.

Rows are dealt to shards by ranges of their key, sorted within each, and written as gzip members, one per record, into
files that roll when their compressed size reaches `file_bytes`. Headers and digests are made anew from the payload: of
equal payloads of at least `min_bytes` the one of the largest key is a `response`, the others are `revisit` records that
name it and carry no payload. Only digests and keys are shuffled to find that out; a payload is shuffled once, by range.

The range bounds come from the keys with the smallest hashes, so they don't depend on how the input is laid out, and dates
and record ids are fixed by arguments and contents: the same rows always give the same bytes. A file is written under a
temporary name and renamed when complete; a task that is repeated writes the same file again. The manifest, which Spark
commits last, lists every file with its size, records and digest; a reader takes the files in it and no others.

The folder has to be one that `pyarrow.fs` opens by its URI on every executor.

A null payload counts as empty, a null url as the empty one. Rows with a null key are responses and aren't revisited. Rows
that share the largest key of a payload are all responses. Other rows may repeat too; each is a record. An empty table
writes no file and an empty manifest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.llm.common import stored

SHARD_BYTES, FILE_BYTES, SAMPLE_KEYS, LEVEL = 16 << 20, 16 << 20, 10_000, 5
MANIFEST = "shard int, file string, bytes bigint, records bigint, sha256 string"
RECORDS = "key bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(key: int | None, url: str, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit's block ends with the HTTP headers, whose length is that of the payload."""
    digest = base32(hashlib.sha1(payload).digest())
    revisit = refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += b"" if revisit else payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(key, digest)}",
        f"WARC-Date: {date}", f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}", f"X-Page-ID: {'' if key is None else key}",
    ]
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}",
        ]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def record_id(key: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{key}/{digest}')}>"


class Roller:
    """The files of one shard."""

    def __init__(self, system: fs.FileSystem, folder: str, shard: int, file_bytes: int) -> None:
        self.system, self.folder, self.shard, self.limit = system, folder, shard, file_bytes
        self.number, self.buffer, self.done = 0, None, []

    def add(self, raw: bytes) -> None:
        if self.buffer is None:
            self.buffer, self.size, self.records, self.digest = self._open(), 0, 0, hashlib.sha256()
        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)  # a gzip member without a time
        member = packer.compress(raw) + packer.flush()
        self.buffer.write(member)
        self.digest.update(member)
        self.size, self.records = self.size + len(member), self.records + 1
        if self.size >= self.limit:
            self.close()

    def _open(self):
        self.name = f"shard-{self.shard:06d}-{self.number:06d}.warc.gz"
        self.hidden = f"{self.folder}/.{self.name}.{uuid.uuid4().hex}"
        return self.system.open_output_stream(self.hidden, compression=None)

    def close(self) -> None:
        if self.buffer is None:
            return
        self.buffer.close()
        self.system.move(self.hidden, f"{self.folder}/{self.name}")
        self.done.append((self.shard, self.name, self.size, self.records, self.digest.hexdigest()))
        self.number, self.buffer = self.number + 1, None


def write(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0,
    shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Write the archives below `folder` and return the manifest."""
    spark = pages.sparkSession
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("bigint").alias("key"), F.coalesce(url, F.lit("")).alias("url"), body.alias("body"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("body"))).withColumn("size", F.octet_length("body").cast("bigint"))
    same = ["digest", "size"]
    light = rows.where(f"key is not null and size >= {min_bytes}").select("key", *same)
    originals = light.groupBy(*same).agg(F.max("key").alias("original"), F.count("*").alias("times")).where("times > 1")
    revisits = stored(light.join(originals.select(*same, "original"), same).where("key <> original").distinct(), "revisits")
    total = rows.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    rows = rows.select("key", *same, F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("original"), "url", "body")
    notes = revisits.select("key", *same, F.lit(0).alias("kind"), "original", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("body"))
    dealt = _shards(rows.unionByName(notes), pages.select(F.col(key).cast("bigint").alias("key")), shards)
    # A partition per shard, by its number: hashed numbers would put several shards in one task and leave others without.
    dealt = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "key", *same, "kind", "url")

    def run(batches):
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        roller, note, done = None, None, []
        for batch in batches:
            for shard, k, digest, size, kind, original, link, raw in zip(*(batch.column(i) for i in range(8)), strict=True):
                shard, k, kind = shard.as_py(), k.as_py(), kind.as_py()
                if roller is None or roller.shard != shard:
                    if roller:
                        roller.close()
                        done += roller.done
                    roller, note = Roller(system, root, shard, file_bytes), None
                name = (k, digest.as_py(), size.as_py())
                if kind == 0:
                    note = (name, original.as_py())
                    continue
                refers_to = note[1] if note and note[0] == name else None
                roller.add(record(k, link.as_py(), raw.as_py(), refers_to, date))
        if roller:
            roller.close()
            done += roller.done
        if done:
            names = ["shard", "file", "bytes", "records", "sha256"]
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

    dealt.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _shards(rows: DataFrame, keys: DataFrame, shards: int) -> DataFrame:
    """`rows` with their shard, by ranges of about equal numbers of keys; null keys are in the first."""
    bounds: list[float] = []
    if shards > 1:
        sample = keys.where("key is not null").distinct().orderBy(F.xxhash64("key"), "key").limit(SAMPLE_KEYS)
        known = sorted(r["key"] for r in sample.collect())
        bounds = sorted({float(known[len(known) * i // shards]) for i in range(1, shards)}) if known else []
    rest = ["key", "digest", "size", "kind", "original", "url", "body"]
    if not bounds:
        return rows.select(F.lit(0).alias("shard"), *rest)
    cut = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol="place", outputCol="shard")
    dealt = cut.transform(rows.withColumn("place", F.coalesce(F.col("key").cast("double"), F.lit(-1e300))))
    return dealt.select(F.col("shard").cast("int").alias("shard"), *rest)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record of the archives in the manifest, checked against its digests."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("file", "sha256")
    files = manifest.count()

    def run(batches):
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, digest in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                with system.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    yield from _batches(_records(stream, digest, name))

    return manifest.repartition(max(1, files)).mapInArrow(run, RECORDS)


def _records(stream, sha256: str, name: str):
    """The records of one file; raises if the file or a block isn't what its digest says."""
    whole, unpacker, text = hashlib.sha256(), zlib.decompressobj(31), []
    while piece := stream.read(1 << 20):
        whole.update(piece)
        while piece:
            text.append(unpacker.decompress(piece))
            piece = b""
            if unpacker.eof:
                piece, unpacker = unpacker.unused_data, zlib.decompressobj(31)
                yield parse(b"".join(text), name)
                text = []
    if text and any(text) or whole.hexdigest() != sha256:
        raise ValueError(f"{name} is damaged")


def parse(raw: bytes, name: str = "") -> tuple:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != "sha1:" + base32(hashlib.sha1(block).digest()) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"damaged record in {name}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x[16:]) for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or base32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"damaged payload in {name}")
    key, refers_to = fields["X-Page-ID"], fields.get("X-Refers-To-Page-ID")
    return int(key) if key else None, size, digest, fields["WARC-Type"], int(refers_to) if refers_to else None, fields["WARC-Target-URI"]


def _batches(rows, size: int = 5000):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = ["key", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
