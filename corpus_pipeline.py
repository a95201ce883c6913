"""A cleaning pipeline for `documents`: quality, toxicity, near copies, benchmark passages, tokens.

Each stage takes what its predecessor kept, written as Parquet and read again. The first four give rows of `documents` as
they are; the last gives the tokens of what is left.

* quality: drops documents that the additive model scores below 0.3. It learns the labels of documents whose key's
  crc32 modulo 5 isn't 0, of those in the stage's input.
* toxicity: drops documents that the kernel machine scores 0.7 or more. It learns those whose key's crc32 modulo 3 isn't 1.
* near_copies: of each component of documents linked by five-word shingles keeps the one of the smallest key. Links need a
  Jaccard similarity of `NEAR` thousandths.
* decontamination: drops documents with ten consecutive words of a benchmark item, or all words of a shorter one.
* tokens: ids, counts and digests by the byte-level vocabulary.

Documents without a key pass all stages on their texts alone; null and empty texts are scored like others, are no near
copies and have no tokens. Rows that repeat a key and text are near copies of each other, and the first of them stays. Rows
that share a key but not a text are dropped or kept each by its own text.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridtide.llm import bpe_tree, partenum_join, quality_gam, suffix_search, toxicity_kernel
from gridtide.llm.common import maybe_in, split_of, stored, table

NEAR = 800
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learned = table(spark, sf_dir, "labels", "doc_id", "quality").where(split_of("doc_id", 5) != 0)
    scored = quality_gam.score(docs, quality_gam.fit(docs, learned), keep=COLUMNS)
    return scored.where("predicted = 1").select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learned = table(spark, sf_dir, "labels", "doc_id", "toxic").where(split_of("doc_id", 3) != 1)
    scored = toxicity_kernel.score(docs, toxicity_kernel.fit(docs, learned), keep=COLUMNS)
    return scored.where("predicted = 0").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # A row is known by key and text: of rows that share a key, one may be a copy and another not.
    row = F.struct("doc_id", F.xxhash64("text").alias("same"))
    keyed = docs.select(F.when(F.col("doc_id").isNotNull(), row).alias("row"), "text")
    found = partenum_join.join(keyed, n=5, permille=NEAR, key="row").where("row is not null")
    copy = F.expr("bool_or(n_shingles > 0 and row <> component_id)").alias("copy")
    # The few rows that aren't simply kept: copies, and those that repeat a key and text. Only their texts are moved.
    marks = found.groupBy("row").agg(copy, F.count("*").alias("times")).where("copy or times > 1")
    marks = stored(marks.select("row.*", "copy"), "marks")
    sieved = maybe_in(docs.select(*COLUMNS, F.xxhash64("text").alias("same")), marks, "doc_id", "same")
    met = sieved.where("maybe").join(marks, ["doc_id", "same"], "left")
    # Rows that repeat a key and text are one document. Rows without a key or text stay.
    order = Window.partitionBy("doc_id", "same").orderBy("source", "lang", "n_chars")
    several = met.where("not copy").withColumn("row", F.row_number().over(order)).where("row = 1 or text is null")
    parts = (sieved.where("not maybe"), met.where("copy is null"), several)
    plain, chance, first = (x.select(*COLUMNS) for x in parts)
    return plain.unionByName(chance).unionByName(first)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_search.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark", "item_id", "text"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_tree.encode_texts(docs, tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: The models and the tokenizer have no form in SQL; tests compare every stage with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
