"""The thin queries of this subpackage and their SQL twins."""

from __future__ import annotations

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.llm import (
    bag_search, bpe_count, bpe_tree, external_shuffle, language_crf, multi_index, partenum_join, pseudo_likelihood, qchunk_variants,
    quality_gam, suffix_search, toxicity_kernel, warc_writer,
)
from gridtide.llm.common import split_of, stored, table
from gridtide.session import work_path


def op1_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(split_of("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    rows = table(spark, sf_dir, "documents", "doc_id", "text", "lang").where(~held)
    model = language_crf.fit(rows)
    found = language_crf.predict(table(spark, sf_dir, "documents", "doc_id", "text"), model)
    return found.select("doc_id", held, "lang_pred", "score")


def op2_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_path(spark, "warc")
    warc_writer.write(table(spark, sf_dir, "pages", "page_id", "url", "html"), folder)
    return warc_writer.read(spark, folder).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op3_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return bpe_tree.encode_texts(docs, tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)


def op4_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(split_of("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = quality_gam.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality").where(~held))
    return quality_gam.score(docs, model).select("doc_id", held, "score", "predicted")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return bpe_count.count_tokens(docs, tokenizers.path("word_bpe_49k.json"))


def op6_suffix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    return suffix_search.report(docs, items)


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op8_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum_join.join(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    counts = stored(pseudo_likelihood.count_words(docs, "text"), "counts")
    return pseudo_likelihood.score(docs, *pseudo_likelihood.fit(docs, counts=counts), counts=counts)


def op10_toxicity_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(split_of("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity_kernel.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic").where(~held))
    return toxicity_kernel.score(docs, model).select("doc_id", held, "score", "predicted")


def op11_bag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    return bag_search.search(docs, items)


def op12_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, docs = work_path(spark, "shards"), table(spark, sf_dir, "documents")
    external_shuffle.write(docs, folder)
    text = F.coalesce("record.text", F.lit(""))
    return external_shuffle.read(docs, folder).select(
        "record.doc_id", (F.octet_length(text).cast("bigint") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit(external_shuffle.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op13_qchunk_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stored(qchunk_variants.words(table(spark, sf_dir, "documents", "doc_id", "text")), "words")
    return qchunk_variants.group(found, ratio=10, min_length=7).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_crf, op2_warc_writer, op3_tree_bpe, op4_quality_gam, op5_token_counts, op6_suffix_search, op7_multi_index,
        op8_partenum_join, op9_pseudo_likelihood, op10_toxicity_kernel, op11_bag_search, op12_external_shuffle,
        op13_qchunk_variants,
    )
}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op2_warc_writer": """
WITH rows AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), named AS (
  SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS hex,
         CASE WHEN page_id IS NOT NULL THEN max(page_id) OVER (PARTITION BY body) END AS original
  FROM rows
), digits AS (
  SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(hex, 5 * i + 1, 5))::BIGINT) AS parts FROM named
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((parts[j // 4 + 1] >> (15 - 5 * (j % 4))) % 32 + 1)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id < original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < original THEN original END AS refers_to
FROM digits""",
    "op6_suffix_search": rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, w, least(len(w), 10) AS l
  FROM (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL)
  WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, l, array_to_string(w[i : i + l - 1], ' ') AS win
  FROM (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM items)
), texts AS (
  SELECT r, i, l, array_to_string(w[i : i + l - 1], ' ') AS win
  FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM docs, (SELECT DISTINCT l FROM windows) WHERE len(w) >= l)
), hits AS (
  SELECT r, i, l, item_id FROM texts JOIN windows USING (l, win)
), covered AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, i + unnest(range(0, l)) AS p FROM (SELECT DISTINCT r, i, l FROM hits)) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hits) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN named USING (r)""",
    "op8_partenum_join": rf"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM texts
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), links AS (
  SELECT a.doc_id AS p, b.doc_id AS q FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (max(a.n) + max(b.n) - count(*))
), edges AS (
  SELECT p, q FROM links UNION ALL SELECT q, p FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT reach.a, edges.q FROM reach JOIN edges ON reach.b = edges.p
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id
FROM sets JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)""",
    "op11_bag_search": rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM documents
), facts AS (
  SELECT (count(*) FILTER (len(t) > 0))::BIGINT AS n_docs, sum(len(t))::BIGINT AS n_terms FROM docs
), wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark
), counts AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM docs) GROUP BY r, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM counts WHERE term IN (SELECT term FROM wanted) GROUP BY term), facts
), lengths AS (
  SELECT r, doc_id, 50 + (50 * len(t) * n_docs) // n_terms AS m FROM docs, facts WHERE len(t) > 0
), parts AS (
  SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * m)) AS part FROM counts JOIN weights USING (term) JOIN lengths USING (r)
), scores AS (
  SELECT item_id, r, doc_id, sum(part)::BIGINT AS score FROM wanted JOIN parts USING (term) GROUP BY item_id, r, doc_id HAVING sum(part) > 0
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST))::INTEGER AS rank, doc_id, score
FROM scores QUALIFY rank <= 50""",
    "op13_qchunk_variants": r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS n, row_number() OVER () AS id
  FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY doc_id, run
), bits AS (
  SELECT b, 0 AS k, b AS c FROM range(256) AS r(b)
  UNION ALL SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), remainders AS (
  SELECT b, c AS r FROM bits WHERE k = 8
), hexed AS (
  SELECT id, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM runs
), sums AS (
  SELECT id, h, 0 AS i, 4294967295::BIGINT AS c FROM hexed
  UNION ALL
  SELECT id, h, i + 1, xor(c >> 8, r) FROM sums JOIN remainders ON b = xor(c & 255, ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) WHERE 2 * i < length(h)
), marks AS (
  SELECT id, xor(c, 4294967295) AS mark FROM sums WHERE 2 * i = length(h)
), made AS (
  SELECT CASE WHEN mark % 31 = 0 THEN substr(run, 1, (mark % length(run))::BIGINT) || substr(run, (mark % length(run))::BIGINT + 2) ELSE run END AS word, n
  FROM runs JOIN marks USING (id)
), vocabulary AS (
  SELECT word, sum(n)::BIGINT AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), holes AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)
), shorter AS (
  SELECT DISTINCT h.word AS a, h.n AS n_a, v.word AS b, v.n AS n_b FROM holes h JOIN vocabulary v ON h.rest = v.word
), near AS (
  SELECT x.word, x.n, y.word AS near, y.n AS near_n FROM holes x JOIN holes y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
  UNION ALL SELECT a, n_a, b, n_b FROM shorter UNION ALL SELECT b, n_b, a, n_a FROM shorter
), counted AS (
  SELECT word, count(*) AS n_near FROM near GROUP BY word
), forms AS (
  SELECT word, near AS form, near_n AS form_n
  FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k FROM near WHERE near_n >= 10 * n) WHERE k = 1
), walk AS (
  SELECT word, form AS root, 1 AS k FROM forms
  UNION ALL SELECT w.word, f.form, k + 1 FROM walk w JOIN forms f ON w.root = f.word
), roots AS (
  SELECT word, arg_max(root, k) AS root FROM walk GROUP BY word
)
SELECT word, form, coalesce(root, word) AS root, n, coalesce(n_near, 0)::BIGINT AS n_near, form_n
FROM vocabulary LEFT JOIN counted USING (word) LEFT JOIN forms USING (word) LEFT JOIN roots USING (word)""",
}
